"""The dealt operators against brute-force versions, SQL, exact round trips or held-out labels."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from framelake.llm import (bpe, exact_dedup, html_extract, mixing, pii, quality_classifier, queries, secret_scan, simhash,
                           url_filter)

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(queries.SQL[name])
    names = sorted(want.columns)
    got = queries.QUERIES[name](spark, SF).select(names)
    assert got.columns == names and sorted(map(tuple, got.collect()), key=repr) == sorted(want.select(*names).fetchall(), key=repr)


def test_bloom_filter_too_small_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_BITS", 1 << 15)
    monkeypatch.setattr(exact_dedup, "BITS_PER_ROW", 1)
    rows = [(i, f"text {i % 700}") for i in range(20_000)]
    got = {r.doc_id: r for r in exact_dedup.copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 20_000 and all(got[i].keep_id == i % 700 and got[i].kept == (i < 700) for i in got)


# --- SimHash ---------------------------------------------------------------------------------------------------

def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.text(alphabet="aBcÄ \t\n\x0b\u00a0é", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint_of(text) == plain_fingerprint(text)


def test_fingerprint_is_spark_xxhash64(spark):
    row = spark.sql("SELECT xxhash64('a b c') AS h").first()
    assert row.h & (1 << 64) - 1 == simhash.fingerprint_of("a b c")


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("block", [4096, 5])
def test_links_and_components(spark, block):
    rnd = random.Random(7)
    fps = {rnd.getrandbits(64) for _ in range(150)}
    for base in list(fps)[:40]:  # chains, stars and near misses of 1 to 4 bits
        for _ in range(6):
            x = base
            for b in rnd.sample(range(64), rnd.randint(1, 4)):
                x ^= 1 << b
            fps.add(x)
            if rnd.random() < 0.5:
                base = x
    fps = sorted(fps)
    rows = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    df = spark.createDataFrame(rows, "fp long, node long")
    got = {r.node: r.component for r in simhash.components(simhash.links(df, block=block)).collect()}
    want = brute_components(fps)
    assert [got.get(i, i) for i in range(len(fps))] == want
    assert len(set(want)) < len(want)


def test_anchors_cover(spark):
    """Of two halves that differ by at most one bit, the second is replicated to the nearest anchor of the first."""
    rnd = random.Random(3)
    pairs = []
    for _ in range(300):
        x = rnd.getrandbits(32)
        pairs.append((x, x ^ (1 << rnd.randrange(32))))
    df = spark.createDataFrame(pairs, "x long, y long")
    from pyspark.sql import functions as F
    for r in df.select(simhash._anchors(F.col("x")).alias("a"), simhash._anchors(F.col("y")).alias("b"), "y").collect():
        assert r.a[0] in r.b and len(r.b) <= 17 and all((r.y ^ c).bit_count() <= 2 for c in r.b)


def awkward_documents(spark):
    """Texts, some of them near copies, with null ids and with ids that name two texts."""
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) > 1500").orderBy("doc_id").limit(60).collect()]
    rows = [(100 + k, t) for k, t in enumerate(texts)]
    for k, t in enumerate(texts[:40]):
        near = t + " again"  # one more shingle among hundreds
        rows += [[(None, near), (None, near + " and")], [(101 + k, near)], [(k, near)], [(2**60 + k, near)]][k % 4]
    rows += [(None, t + f" once {k}") for k, t in enumerate(texts[:40:4])]
    fps = sorted({simhash.fingerprint_of(t) for _, t in rows})
    return rows, dict(zip(fps, brute_components(fps)))


def brute_one_of_each(rows, classes):
    best = {}
    for i, t in rows:
        fp = simhash.fingerprint_of(t)
        key = (i is None, i or 0, fp - (1 << 64) if fp >> 63 else fp)
        best.setdefault(classes[fp], []).append((key, i, t))
    return [[(i, t) for k, i, t in group if k == min(group)[0]] for group in (sorted(g, key=lambda x: x[0]) for g in best.values())]


def test_one_of_each_class_whatever_the_ids(spark):
    rows, classes = awkward_documents(spark)
    groups = brute_one_of_each(rows, classes)
    assert max(map(len, groups)) == 1 and len(groups) < len(rows) - 20
    df = spark.createDataFrame([(*r, "x") for r in rows + rows[:5]], "doc_id long, text string, fp string")
    got = [(r.doc_id, r.text) for r in simhash.keep_one_of_each(df).collect()]
    assert sorted(got, key=str) == sorted((g[0] for g in groups), key=str)


def test_pipeline_against_brute_force(spark, tmp_path, vocabulary):
    import corpus_pipeline
    rows, _ = awkward_documents(spark)
    docs = spark.createDataFrame([(*r, f"s{k % 2}") for k, r in enumerate(rows)], "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    good = {(r.doc_id, r.text) for r in quality_classifier.keep_good(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    exact = {}
    for i, t in sorted(good, key=lambda r: (r[0] is None, r[0] or 0)):
        exact.setdefault(re.sub("[ \t-\r]+", " ", t), (i, t))
    fps = sorted({simhash.fingerprint_of(t) for _, t in exact.values()})
    kept = [g[0] for g in brute_one_of_each(exact.values(), dict(zip(fps, brute_components(fps))))]
    want = {(i, tuple(vocabulary.library.encode(t, add_special_tokens=False).ids)) for i, t in kept}
    got = [(r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert set(got) == want and len(want) > 20 and max(got.count(g) for g in want) <= 2


# --- BPE ---------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(public_tokenizers.path(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def encoder(vocabulary):
    words = ["the", "them", "hat", "chat", "that", "naïve", "a", "'s", "zebra" * 9]
    entries = {w.encode(): vocabulary.merge(w.encode()) for w in words}
    return bpe.Encoder(vocabulary, bpe.Lexicon(bpe.compile_lexicon(entries)))


TEXTS = st.text(max_size=40) | st.text(alphabet="aAhtTezbr'sld19 \n\t!<|>endoftextİſßσΣé́", max_size=60)


@given(TEXTS)
@settings(max_examples=500, deadline=None)
def test_same_as_library(encoder, text):
    library = encoder.vocabulary.library
    ids = np.frombuffer(encoder.encode(text), "<u4").tolist()
    want = library.encode(text, add_special_tokens=False).ids
    assert ids == want
    assert encoder.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_special_strings_and_long_words(encoder):
    library = encoder.vocabulary.library
    for text in ("x<|endoftext|>Y<|startoftext|>", "a" * 3000, "ab" * 700 + "é" * 300, None, ""):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(
            text or "", add_special_tokens=False).ids


@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 2**31 - 1), max_size=3), max_size=40))
@settings(max_examples=200, deadline=None)
def test_lexicon_round_trip(entries):
    lexicon = bpe.Lexicon(bpe.compile_lexicon(entries))
    for w, ids in entries.items():
        assert np.frombuffer(lexicon.get(w), "<i4").tolist() == ids
    for w in (b"", b"\x00\x01\x02\x03\x04\x05\x06", *(w + b"x" for w in entries)):
        assert (lexicon.get(w) is None) == (w not in entries)


def test_lexicon_shares_suffixes():
    words = {f"{p}ation".encode(): [1] for p in ("n", "st", "cre", "voc")}
    assert len(bpe.Lexicon(bpe.compile_lexicon(words)).final) < sum(map(len, words)) / 2


def test_encode_and_decode_tables(spark, vocabulary):
    path = public_tokenizers.path(bpe.VOCABULARY)
    docs = spark.createDataFrame([(1, "Hello  hello World!"), (2, None), (3, "hello")], "doc_id long, text string")
    got = bpe.encode(docs, path)
    texts = {r.doc_id: r.text for r in bpe.decode(got, path).collect()}
    assert texts == {1: "hello</w> hello</w> world</w> !</w>", 2: "", 3: "hello</w>"}
    for r in bpe.encode(docs, path, digests=True).collect():
        want = vocabulary.library.encode((None, "Hello  hello World!", "", "hello")[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in want)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


# --- Classifier, secrets -----------------------------------------------------------------------------------------

def test_classifier_on_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = quality_classifier.classify(docs).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    met = got.merge(labels, on="doc_id")
    assert ((met.quality == 1) == met.kept).mean() > 0.97
    assert met[met.quality == 1].kept.mean() > 0.99


def plain_spans(text):
    out = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [(m.start(), 0, m.end())] if len(m[2]) >= 6 else []
    for k, pattern, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return sorted(out)


@given(st.text(alphabet="paswordSECRETtokenAPI_key=:'\" 0123abcdefé", max_size=60) | st.lists(st.sampled_from(
    ["token", "PassWord", " = ", ":", '"', "abc", "0" * 23, "f" * 25, "AKIA", "Q2" * 8, "AKIAQ2" * 4, "\n", "é", "api_key", "sſecret"]),
    max_size=12).map("".join))
@settings(max_examples=500, deadline=None)
def test_base_spans(text):
    assert secret_scan.base_spans(text, text.encode()) == plain_spans(text)


def test_markov_held_out(spark):
    model = secret_scan.fit(spark.read.parquet(f"{SF}/documents.parquet"))

    def found(t):
        return bool(secret_scan.markov_spans(t, t.encode(), [], model))

    rnd = random.Random(11)
    drawn = ["".join(rnd.choice(secret_scan.ALPHABET[:62]) for _ in range(rnd.randint(20, 40))) for _ in range(200)]
    drawn = [t for t in drawn if any(c.isdigit() for c in t)]
    assert sum(map(found, drawn)) > 0.95 * len(drawn)
    words = ["request", "handler", "user", "session", "buffer", "index", "thread", "value", "client", "table"]
    names = [rnd.choice(["_", "-", ""]).join(rnd.choice(words) for _ in range(4)) + str(rnd.randint(0, 99)) for _ in range(200)]
    assert sum(map(found, names)) < 0.05 * len(names)


def test_markov_without_a_gate(spark):
    """Keys without digits, short keys, and keys in paths, names and beside base spans; ordinary text stays."""
    model = secret_scan.fit(spark.read.parquet(f"{SF}/documents.parquet"))

    def spans(t):
        raw = t.encode()
        return [t[s:e] for s, _, e in secret_scan.markov_spans(t, raw, secret_scan.base_spans(t, raw), model)]

    rnd = random.Random(12)

    def draw(letters, least, most):
        return ["".join(rnd.choice(letters) for _ in range(rnd.randint(least, most))) for _ in range(300)]

    base62 = secret_scan.ALPHABET[:62]
    drawn = draw(base62, 16, 40)  # digitless ones too
    assert sum(bool(spans(t)) for t in drawn) > 0.95 * len(drawn)
    assert sum(bool(spans(t)) for t in draw(base62[:52], 16, 20)) > 0.8 * 300
    assert sum(bool(spans(t)) for t in draw(base62, 12, 15)) > 0.75 * 300
    keys = [t for t in draw(base62, 20, 24) if spans(t) == [t]]
    assert len(keys) > 280
    for form in ("/services/team/hooks/incoming/messages/channel/{}", "export user_request_handler_name={}", "é /customer/{}/settings/index_table",
                 "password=hunter22/{}", "password=hunter22 see /customer/{}"):
        texts = [form.format(k) for k in keys]
        whole = [" ".join(spans(t)) for t in texts]
        if form.startswith("password=hunter22/"):
            assert whole == [""] * len(keys)  # the base span has it all
        else:
            assert sum(k in w and len(w) < len(k) + 12 for k, w in zip(keys, whole)) > 0.9 * len(keys)
    assert spans(f"AKIA{'Q2' * 8}/{keys[0]}") == ["/" + keys[0]] or spans(f"AKIA{'Q2' * 8}/{keys[0]}") == [keys[0]]
    for t in ("internationalization of authentication/configuration_table", "2024-01-31T23:59:59 1234567890", "getElementById HTTPServerError", "", "é"):
        assert spans(t) == []


# --- Mixing ------------------------------------------------------------------------------------------------------

def test_exponent_meets_both_demands(spark):
    tokens = {"a": 9000, "b": 600, "c": 400, "d": 50}
    df = spark.createDataFrame([(k, v, 1) for k, v in tokens.items()], "source string, tokens long, docs long")

    def entropy(x):
        z = sum(t ** x for t in tokens.values())
        return -sum(t ** x / z * math.log(t ** x / z) for t in tokens.values())

    x = mixing.exponent(df, 0.8, 1e9)
    assert entropy(x) == pytest.approx(0.8 * math.log(4), abs=1e-6)
    y = mixing.exponent(df, 1.0, 3.0)
    assert (9000 / 50) ** (1 - y) == pytest.approx(3.0, abs=1e-6)
    assert mixing.exponent(df, 0.8, 3.0) == pytest.approx(max(x, y))


@pytest.mark.parametrize("budget", [None, 30_000.0])
def test_budgets_are_met(spark, monkeypatch, budget):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)
    monkeypatch.setattr(mixing, "SUPER_BLOCKS", 4)
    rnd = random.Random(5)
    rows = [(i, ("hot", "b", None)[min(2, int(rnd.expovariate(1)))], "w " * rnd.randint(1, 60)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(docs, budget=budget).toPandas()
    thin = docs.select("doc_id", "source", mixing.n_tokens(docs.text).alias("tokens"))
    for p in mixing.plan(thin, budget=budget).collect():
        mine = got[got.source.isna()] if p.source is None else got[got.source == p.source]
        used, want = mine.text.str.split().str.len().sum(), p.repeats * p.tokens
        assert want - 60 <= used <= want + 1e-6  # whole documents only: less than one of them is missing
        per_doc = mine.groupby("doc_id").size()
        assert per_doc.max() - per_doc.min() <= 1 and per_doc.max() <= p.passes + 1
    if budget is None:
        assert got.doc_id.nunique() == len(rows)
    assert got.position.between(0, 1, inclusive="left").all()


# --- PII ---------------------------------------------------------------------------------------------------------

def test_surrogates(spark):
    rows = [(1, "Mr. John Smith +1 (449) 555-7462 JOHN.smith9@Mail4.example.com"),
            (2, "Mr. Smith: +1 449-555-7462 john.smith9@mail4.example.com 4337166598464399 / 4337-1665-9846-4399 and "
                "4337166598464398, 78.118.65.158. 300.1.1.1 123-45-6789"), (3, "nothing 1.5 here 12:30 +1 2 3"),
            (4, "Call +49 30 12 34 56 or +33 1 23 45 67 89"), (5, "555.123.4567")]
    one, two, three, four, five = (r.text for r in pii.pseudonymise(
        spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect())
    assert three == rows[2][1]
    assert re.fullmatch(r"Call \+49 \d\d \d\d \d\d \d\d or \+33 \d \d\d \d\d \d\d \d\d", four) and "12 34" not in four
    assert re.fullmatch(r"\d{3}\.\d{3}\.\d{4}", five) and five != rows[4][1]
    for gone in ("Smith", "449", "7462", "smith9", "4337166598464399", "78.118.65.158", "123-45-6789"):
        assert gone not in one + two
    assert "300.1.1.1" in two  # no address
    assert re.search(r"Mr\. \w+ (\w+)", one)[1] == re.search(r"Mr\. (\w+)", two)[1]
    digits = [re.sub(r"\D", "", re.search(r"\+1.*?-\d{4}", t)[0]) for t in (one, two)]
    assert digits[0] == digits[1]
    mails = [re.search(r"\S+@\S+", t)[0] for t in (one, two)]
    assert mails[0] != mails[1] and mails[0].lower() == mails[1] and mails[1].endswith(".example.com")
    card, dashed = re.search(r"(\d{16}) / ([\d-]{19})", two).groups()
    assert card == dashed.replace("-", "") and card[0] == "4"
    luhn = lambda x: sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(x)) % 10
    odd = re.search(r"and (\d{16}),", two)[1]
    assert luhn(card) == 0 and odd != "4337166598464398" and luhn(odd) == luhn("4337166598464398") == 9


def test_collisions_are_resolved(spark):
    """All 676 names of a small shape: surrogates would be somebody's originals; the next keys separate them."""
    values = [(k, "", v) for k, v in [("ssn", f"{i:09d}") for i in range(500)] + [("name", f"B{x}" + "n") for x in "aeiou"]]
    df = spark.createDataFrame(values, "kind string, code string, value string")
    moved = pii.offenders(df)
    sql = pii._surrogate_part("kind", "value", f"concat_ws('|', {pii._q(pii.KEY)}, kind, code, attempt)")
    from pyspark.sql import functions as F
    full = df if moved is None else df.join(moved, ["kind", "code", "value"], "left")
    full = full.withColumn("attempt", F.coalesce("attempt", F.lit(0))) if moved is not None else df.withColumn("attempt", F.lit(0))
    got = full.withColumn("s", F.expr(sql)).collect()
    assert len({(r.kind, r.s) for r in got}) == len(values)
    assert not {r.s for r in got if r.kind == "ssn"} & {v for k, _, v in values if k == "ssn"}


def surrogates(df, moved):
    from pyspark.sql import functions as F
    sql = pii._surrogate_part("kind", "value", f"concat_ws('|', {pii._q(pii.KEY)}, kind, code, attempt)")
    return df.join(moved, ["kind", "code", "value"], "left").na.fill(0, ["attempt"]).withColumn("s", F.expr(sql)).collect()


def test_full_shapes_are_widened(spark):
    """Shapes that the corpus fills by more than half: names of two and three letters, short local parts, short numbers."""
    names = [f"{a}{b}m" for a in "BCDFGHJKLMNPQRSTVWXYZ" for b in "aeiou"] + [f"{a}u" for a in "BCDFGHJKLMNPQRSTVWXYZ"] + ["Öö", "Ли", "Ми"]
    mails = [f"{a}@example.com" for a in "abcdefghijklmnopqrstuvwxyz"] + ["%@example.com"]
    values = [("name", "", v) for v in names] + [("email", "", v) for v in mails] + [("phone", "449", f"{i:02d}") for i in range(100)]
    df = spark.createDataFrame(values, "kind string, code string, value string")
    got = surrogates(df, pii.offenders(df))
    assert len(got) == len(values) == len({(r.kind, r.code, r.s) for r in got})
    assert not {(r.kind, r.code, r.s) for r in got} & set(values)
    for r in got:
        if r.kind == "name":
            assert r.s[-1] == r.value[-1] and r.s.istitle() and (r.value[0] in "ЛМ") == all(c > "а" for c in r.s[1:])
        assert r.kind != "email" or re.fullmatch(r"[a-z%]+@example\.com", r.s)


def test_texts_with_full_shapes(spark):
    names = [f"{a}u" for a in "BCDFGHJKLMNPQRSTVWXYZ"]
    rows = [(k, f"Mr. {n} {n}-{n}, {n[0]}@Example.com!") for k, n in enumerate(names)] + [(99, "Ms. Wu")]
    got = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen = {k: re.fullmatch(r"M[rs]\. (\w+u)(?: \1-\1, (\w+@Example\.com)!)?", t).groups() for k, t in got.items()}
    assert not {n for n, _ in seen.values()} & set(names) and len({n for n, _ in seen.values()}) == len(names)
    assert seen[99][0] == seen[names.index("Wu")][0]
    mails = {m.lower() for _, m in seen.values() if m}
    assert len(mails) == len(names) and not mails & {f"{n[0]}@example.com".lower() for n in names}


def test_unresolved_collisions_fail(spark, monkeypatch):
    monkeypatch.setattr(pii, "LEVELS", 0)
    with pytest.raises(RuntimeError):
        pii.offenders(spark.createDataFrame([("name", "", "Öö")], "kind string, code string, value string"))


def test_a_full_octet_is_given_up(spark):
    """The surrogate of an address after ATTEMPTS keys, as it would be in a full first octet."""
    sql = pii._surrogate_part("kind", "value", f"concat('k|', {pii.ATTEMPTS})")
    rows = [("ip", f"10.0.{i // 256}.{i % 256}") for i in range(512)]
    got = spark.createDataFrame(rows, "kind string, value string").selectExpr(f"{sql} AS s").collect()
    assert len({r.s for r in got}) == 512 and len({r.s.split(".")[0] for r in got}) > 100
    assert all(re.fullmatch(pii.PATTERNS["ip"], r.s) for r in got)


# --- HTML, URLs --------------------------------------------------------------------------------------------------

def test_main_text():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header class=top>Site</header>
    <nav><ul><li><a href=/>Home</a></ul></nav><div class="ad">Buy the best of the best now and here.</div>
    <article><header><h1>A &amp; B</h1></header><p>The first   part of the<br>story is in <b>this</b> block and it goes on for long.
    <p>Short.<p>x &lt; y <a href="/z">link</a><!-- <p>no --><aside>aside</aside><script>var t="</p>";</script><pre>last &eacute;</pre>
    <div id="comments"><p>Nice post, the best of the year!</p></div></article><form>Name <input></form><footer>&copy; me</footer>"""
    assert html_extract.main_text(page) == ("A & B\n\nThe first part of the story is in this block and it goes on for long.\n\n"
                                            "Short.\n\nx < y link\n\nlast é")


def test_pages_without_an_article():
    body = "It was the best of the times and it was the worst of the times, for all that are in the city. " * 3
    page = f"<div><a href=1>One</a> <a href=2>Two</a></div><div><h2>Head</h2><p>{body}</p><p>Well.</p><p>{body}</p></div><div>Tail<a href=3>linked</a></div>"
    text = html_extract.main_text(page).split("\n\n")
    assert text[:4] == ["Head", body.strip(), "Well.", body.strip()] and not any("One" in t or "linked" in t for t in text)


def test_link_lists_inside_an_article():
    """Links decide inside an article too; text without links stays, whatever its length and neighbours."""
    menu = "".join(f"<li><a href=/{k}>Topic number {k} of the site</a></li>" for k in range(4))
    body = "It was the best of the times and it was the worst of the times, for all that are in the city. "
    lines = ["Zwo Zeilen", "kurz", "1.0 2.0 3.0 4.0 " * 20]
    page = (f"<main><h2>Browse</h2><ul>{menu}</ul><h1><a href=/self>Title</a></h1>" + "".join(f"<p>{x}</p>" for x in lines)
            + f"<ul>{menu}</ul><p>{body}<a href=/r>A source</a></p><p>See <a href=/s>this</a></p><h3>More</h3><ul>{menu}</ul></main>")
    assert html_extract.main_text(page).split("\n\n") == ["Title", *(x.strip() for x in lines), body + "A source", "See this"]


@pytest.mark.parametrize("start", ["<html lang=pl>", "<html>", ""])
def test_pages_in_other_languages(start):
    """Stop words of four languages reject nothing on a page in a fifth."""
    body = "Wczoraj wieczorem nad rzeką zebrali się mieszkańcy miasta, żeby wspólnie obejrzeć pokaz sztucznych ogni. " * 3
    page = f"{start}<body><div><a href=1>Jeden</a> <a href=2>Dwa</a></div><div><h2>Pokaz</h2><p>{body}</p><p>Krótko.</p></div>"
    assert html_extract.main_text(page) == f"Pokaz\n\n{body.strip()}\n\nKrótko."
    junk = "Buy cheap shoes bags belts hats gloves scarves coats boots socks shirts ties rings watches online today " * 3
    good = "It was the best of the times and it was the worst of the times, for all that are in the city. " * 6
    assert html_extract.main_text(f"<html lang=en-GB><p>{junk}") == ""
    assert html_extract.main_text(f"<div><p>{good}</div><div><p>{junk}") == good.strip()


@pytest.mark.parametrize("tag", ["<svg/>", "<svg class=icon />", "<SVG a='b'/>", "<math/>", "<iframe src=x />", '<video src="x"/>',
                                 "<canvas/>", "<script src=x />", "<svg class=icon/>"])
@pytest.mark.parametrize("rest", ["", "<svg><path/>no</svg><iframe>no</iframe><video>no</video><script>no</script><canvas>no</canvas>"])
def test_self_closing_raw_elements(tag, rest):
    assert html_extract.main_text(f"<article><p>One {tag} two.</p>{rest}<p>Three.</p></article>") == "One two.\n\nThree."


@pytest.mark.parametrize("tag", ["<iframe src=http://x.com/></iframe>", "<script src=x/>no</script>", "<svg class=icon/><path/>no</svg>",
                                 "<svg><g/><path d=x />no</svg>", "<svg/>", "<svg />"])
def test_raw_elements_with_an_end(tag):
    assert html_extract.main_text(f"<article><p>One {tag} two.<p>Three.") == "One two.\n\nThree."


def test_pagerank_against_brute_force(spark):
    link = '<a href="http://{}/">x</a>'
    pages = [(1, "http://good.org/fr/a", link.format("mid.com") * 2), (2, "http://mid.com/x", link.format("far.com")),
             (3, "http://spam.net/a", ""), (4, "http://farm.com/x", link.format("SPAM.net") + "<a href='//spam.net/y'>"),
             (5, "http://far.com/", link.format("mid.com")), (6, "http://lone.com/en/", ""), (7, "http://fan.com/", link.format("farm.com"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got == {1: ("org/fr/", "allow"), 2: (None, "allow"), 3: ("net/", "block"), 4: (None, "block"), 5: (None, "allow"),
                   6: (None, "allow"), 7: (None, "block")}
    edges = {("good.org", "mid.com"): 2, ("mid.com", "far.com"): 1, ("farm.com", "spam.net"): 2, ("far.com", "mid.com"): 1,
             ("fan.com", "farm.com"): 1}
    trust, distrust = {"good.org": 1.0}, {"spam.net": 1.0}
    t, d = dict(trust), dict(distrust)
    hosts = {h for e in edges for h in e} | {"lone.com"}
    out = {h: sum(n for (a, _), n in edges.items() if a == h) for h in hosts}
    into = {h: sum(n for (_, b), n in edges.items() if b == h) for h in hosts}
    for _ in range(200):
        t = {h: 0.15 * trust.get(h, 0) + 0.85 * sum(t.get(a, 0) * n / out[a] for (a, b), n in edges.items() if b == h) for h in hosts}
        d = {h: 0.15 * distrust.get(h, 0) + 0.85 * sum(d.get(b, 0) * n / into[b] for (a, b), n in edges.items() if a == h) for h in hosts}
    seeds = spark.createDataFrame([(h, trust.get(h, 0.0), distrust.get(h, 0.0)) for h in hosts],
                                  "host string, trust_seed double, distrust_seed double")
    table = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n long")
    for r in url_filter.propagate(seeds, table, rounds=100, tolerance=1e-9).collect():
        assert r.trust == pytest.approx(t[r.host] / 0.15, abs=1e-5) and r.distrust == pytest.approx(d[r.host] / 0.15, abs=1e-5)


def test_scores_do_not_depend_on_hosts_without_links(spark):
    """20,000 hosts without links beside a chain to a blocked host, and a linker with a sixtieth of its in-links."""
    edges = [("a1", "spam", 59), ("a2", "a1", 1), ("a3", "a2", 1), ("thin", "spam", 1)]
    table = spark.createDataFrame(edges, "src string, dst string, n long")
    seeds = spark.range(20_000).selectExpr("concat('lone', id) AS host", "0.0D AS trust_seed", "0.0D AS distrust_seed").union(
        spark.createDataFrame([("spam", 0.0, 1.0)], "host string, trust_seed double, distrust_seed double"))
    got = {r.host: r.distrust for r in url_filter.propagate(seeds, table).filter("distrust > 0").collect()}
    a1 = 0.85 * 59 / 60
    want = {"spam": 1, "a1": a1, "a2": 0.85 * a1, "a3": 0.85 ** 2 * a1, "thin": 0.85 / 60}
    assert got == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize("url, host, path, rule", [
    ("HTTP://WWW.A.Example.NET/en/x?y#z", "www.a.example.net", "/en/x", "example.net/en/"),
    ("http://example.net/EN/", "example.net", "/EN/", "net/"), ("http://badexample.net/en/", "badexample.net", "/en/", "net/"),
    ("a://b.org?x=/fr/", "b.org", "", None), ("http://org/fr/", "org", "/fr/", "org/fr/"), ("x.net/en/", "", "", None),
    ("a://b://c.net/", "b:", "//c.net/", None), ("http://example.com/de/1", "example.com", "/de/1", "example.com/de/")])
def test_url_parts(spark, url, host, path, rule):
    r = url_filter.judge(spark.createDataFrame([(1, url, None)], "page_id long, url string, html string")).first()
    assert (r.host, r.path, r.rule) == (host, path, rule)
