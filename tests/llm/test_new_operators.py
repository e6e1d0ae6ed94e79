"""Prefix trie, lexical search and decontamination against plain versions, on awkward tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from framelake.llm import decontaminate, lexical_search, prefix_trie

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


# --- prefix trie -----------------------------------------------------------------------------------------------

def plain_trie(rows):
    """Nodes by brute force: rows (conv_id, turn, role, text)."""
    def key(r):
        return hashlib.sha256((hashlib.sha256(r[0].encode()).hexdigest() + r[1]).encode()).digest()

    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), key((role or "", text or "")), (role or "", text or "")))
    turns = {c: [x[2] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = turns.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, cs in members.items():
        words = len(SPACED.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(cs) - 1) * words
    return sorted((min(cs), len(p), min(members[p[:-1]]) if p else -1, len(cs), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(cs) if len(rebuilt[c]) == len(p)).encode()).hexdigest())
                  for p, cs in members.items())


def conversations():
    rnd, rows = random.Random(5), []
    for c in [*range(0, 130), *range(2**60, 2**60 + 45), -3, -21, -40]:
        if c % 17 == 5:
            continue
        n = 0 if c % 23 == 1 else rnd.randint(1, 6)
        rows += [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["a b", "hello  there\tyou", "", None, "x"])) for t in range(n)]
    rows += [(40, None, "system", "first of all"), (40, None, "system", "first of all"), (60, 2, "user", "a b"), (60, 2, "user", "a b"),
             (None, 1, "user", "nobody's"), (21, 0, "user", "alone and soon replaced")]
    long = [(20, t, "user", f"turn {t % 7}") for t in range(100, 160)]  # one conversation of many turns, and its copy
    rows += long + [(3000, t, r, x) for _, t, r, x in long] + [(3000 + 20 * 7, t, r, x) for _, t, r, x in long[:50]]
    rnd.shuffle(rows)
    return rows


def trie_rows(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
                  for r in df.collect())


@pytest.mark.parametrize("chunk, bits", [(4096, 1 << 29), (7, 1 << 17), (7, None)])
def test_trie(spark, monkeypatch, chunk, bits):
    rows = conversations()
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    monkeypatch.setattr(prefix_trie, "ENDS_SPAN", 8)
    if bits is None:  # several ranges of digests, each with a sketch that is far too small: all is exact still
        bits = 1 << 9
        monkeypatch.setattr(prefix_trie, "PAGE", 1 << 7)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    df = df.selectExpr("*", "1L AS depth", "'k' AS key", "2 AS n")
    assert trie_rows(prefix_trie.build(df, sketch_bits=bits)) == plain_trie(rows)


def test_trie_of_few(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.build(spark.createDataFrame([], schema)).collect() == []
    for rows in ([(None, 1, "user", "x")], [(21, 0, "user", "x")], [(0, 0, None, None)], [(5, 1, "user", "y")] * 3):
        assert trie_rows(prefix_trie.build(spark.createDataFrame(rows, schema))) == plain_trie(rows)


def test_screening_proves_singletons(spark):
    """In a sketch with room, hardly any prefix of one conversation only is taken for shared, and no shared one for single."""
    rows = [(c, t, "user", f"{c} {t}") for c in range(0, 40_000, 20) for t in range(4)] + [(20 * c + 10**6, 0, "user", "all the same") for c in range(50)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    digests = prefix_trie.prefixes(prefix_trie.rebuilt_chunks(prefix_trie._thin_turns(df, "conv_id", "turn", "role", "text")))
    flags = prefix_trie.screened(digests, len(rows)).select("conv_id", "maybe").collect()
    single = [sum(r.maybe[1:]) for r in flags if r.conv_id < 10**6]
    assert sum(single) < 0.01 * 4 * 2000 and len(single) >= 2000
    assert all(r.maybe[1] for r in flags if r.conv_id >= 10**6)


# --- lexical search --------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_ranking(docs, items, top=20):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [(i, Counter(TERM.findall((t or "").translate(lower)))) for i, t in docs]
    n_docs, all_terms = sum(bool(c) for _, c in texts), sum(sum(c.values()) for _, c in texts)
    df, out = Counter(w for _, c in texts for w in c), []
    for item, t in items:
        found = []
        for i, c in texts:
            n, score = sum(c.values()), 0
            for w in TERM.findall((t or "").translate(lower)):
                if c[w]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                    score += weight * (1_000_000_000 * c[w] // (1000 * c[w] + 12 * (75 + 25 * n * n_docs // all_terms)))
            if score:
                found.append((-score, i is None, i or 0))
        out += [(item, k, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block, batch", [(2048, 1 << 23), (16, 200)])
def test_search(spark, block, batch):
    rnd = random.Random(11)
    words = ["alpha", "Beta", "gamma3", "ÄÖ", "été", "中文", "x", "the", "THE", "d'or", "42", "zeta", "eta", "theta", "iota", "kappa"]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 40)))) for i in range(300)]
    docs += [(2**60 + 1, "alpha alpha beta"), (2**60 + 3, "alpha alpha beta"), (None, "alpha alpha beta"), (7, "alpha alpha beta"), (7, None), (8, ""),
             (9, "." * 100), (10, "the " * 50_000 + "kappa")] + [(400 + i, "same text kappa") for i in range(40)]
    items = [(1, "alpha, beta!"), (2, "THE the the kappa"), (3, ""), (None, "été 中文 ÄÖ äö"), (4, None), (5, "unknown words"), (6, " ".join(words * 3)),
             (6, "kappa same"), (7, "42-42 x")]
    d = spark.createDataFrame([(*r, "x", 1.0) for r in docs], "doc_id long, text string, item_id string, score double").repartition(5)
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    got = lexical_search.rank(d, i, batch_chars=batch, block=block)
    assert sorted(map(tuple, got.collect()), key=str) == plain_ranking(docs, items)


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.rank(none, items).collect() == []
    some = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    assert lexical_search.rank(some, items.limit(0)).collect() == []
    assert [tuple(r) for r in lexical_search.rank(some, items).collect()] == plain_ranking([(1, "a b"), (2, "c")], [(1, "a")])


def test_search_stops_early():
    """Masks are passed over once the best cannot be reached, and the best are right."""
    rnd = np.random.default_rng(3)
    n, best = 4000, lexical_search._Best(20)
    postings = [(np.sort(rnd.choice(n, n >> k, replace=False)), None) for k in range(1, 9)]
    postings = [(d, rnd.integers(500, 1000, len(d))) for d, _ in postings]
    weights = np.array([100 << k for k in range(8)])
    done = lexical_search.best_of_block(np.arange(8), weights, postings, n, [str(i) for i in range(n)], best)
    scores = np.zeros(n, np.int64)
    for (d, f), w in zip(postings, weights):
        scores[d] += w * f
    assert [-r[0] for r in best.rows] == sorted(scores.tolist(), reverse=True)[:20] and done < n


# --- decontamination -------------------------------------------------------------------------------------------

LEAK_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def leak_words(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return LEAK_WORD.findall((text or "").translate(lower))


def plain_leaks(docs, items, window=10):
    grams = defaultdict(set)
    for item, t in items:
        ws = leak_words(t)
        for k in range(max(1, len(ws) - window + 1) if ws else 0):
            grams[tuple(ws[k:k + window])].add("" if item is None else str(item))
    sizes, out = {len(g) for g in grams}, []
    for i, t in docs:
        ws, hit, its = leak_words(t), set(), set()
        for size, k in itertools.product(sizes, range(len(ws))):
            g = tuple(ws[k:k + size])
            if len(g) == size and g in grams:
                hit |= set(range(k, k + size))
                its |= grams[g]
        out.append((i, len(ws), len(hit), len(its), hashlib.sha256(",".join(sorted(its)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def leak_tables():
    rnd = random.Random(2)
    words = [*"abcdefgh", "été", "ÉTÉ", "ΟΔΟΣ", "οδος", "中文字", "longestword", "Straße", "K", "k", "42"]
    items = [(k, " ".join(rnd.choices(words, k=rnd.randint(10, 16)))) for k in range(12)]
    items += [(100, "three Short words"), (101, "ΟΔΟΣ's"), (102, "?!"), (103, None), (None, "unnamed item here"), (104, "three short words"), (104, "another text of it")]
    docs = [(k, " ".join(rnd.choices(words, k=rnd.randint(0, 60)))) for k in range(60)]
    for k, (_, t) in enumerate(items):
        docs.append((200 + k, f"Before, {(t or '').upper() if k % 2 else t}; AFTER " + " ".join(rnd.choices(words, k=5))))
    docs += [(300, items[0][1] + " " + items[1][1] + " three-short\nwords " * 3), (300, items[2][1]), (None, items[3][1]), (301, None), (302, ""), (303, "ΟΔΟΣ'S Α"),
             (2**60 + 1, items[4][1]), (2**60 + 3, "x " * 30_000 + items[5][1])]
    return docs, items


@pytest.mark.parametrize("most", [1 << 16, 5])
def test_leaks(spark, most):
    docs, items = leak_tables()
    d = spark.createDataFrame([(*r, 1, "h") for r in docs], "doc_id long, text string, start int, gram string").repartition(4)
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, size int")
    found = decontaminate.find(d, i, max_windows=most).selectExpr(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "n_hit > 0 AS contaminated")
    want = plain_leaks(docs, items)
    assert sorted(map(tuple, found.collect()), key=str) == want and 15 < sum(r[-1] for r in want) < len(want)


def test_leaks_removed(spark):
    docs, items = leak_tables()
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, spans string")
    i = spark.createDataFrame(items, "item_id long, text string")
    bad = {r[0] for r in plain_leaks([(k, t) for k, (_, t) in enumerate(docs)], items) if r[-1]}
    left = decontaminate.remove_documents(d, i)
    assert left.columns == d.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted((r for k, r in enumerate(docs) if k not in bad), key=str)
    cut = decontaminate.remove_spans(d, i)
    got = sorted(((r.doc_id, leak_words(r.text)) for r in cut.collect()), key=str)
    hits = {}
    for k, (_, t) in enumerate(docs):
        ws, hit = leak_words(t), set()
        for _, it in items:
            iw = leak_words(it)
            for g in {tuple(iw[a:a + 10]) for a in range(max(1, len(iw) - 9) if iw else 0)}:
                for a in range(len(ws) - len(g) + 1):
                    if tuple(ws[a:a + len(g)]) == g:
                        hit |= set(range(a, a + len(g)))
        hits[k] = [w for a, w in enumerate(ws) if a not in hit]
    assert got == sorted(((docs[k][0], w) for k, w in hits.items()), key=str)


def test_leaks_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.judge(docs, none).collect()) == [
        (1, 3, 0, 0, False), (2, 0, 0, 0, False)]
    assert decontaminate.judge(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect() == []
