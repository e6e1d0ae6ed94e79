"""Surrogates for personal data, in DataFrame functions only.

Entities: e-mail addresses, IBANs, IPv6 and IPv4 addresses, payment cards (16 digits, or 15 that begin with 34 or 37), phone numbers,
US social security numbers, and names after a form of address or title (also in capitals, with apostrophes, or like McDonald). Each gets a surrogate by a keyed
permutation of all values of its own shape (a four-round Feistel network over its letters and digits),
so equal entities get equal surrogates in every document, and different ones different surrogates.
Digits stay digits; a card keeps its first digit (two of 15), an IBAN its country, and a surrogate's check digits are valid exactly if its own are; an
address keeps its first octet or group; a phone number keeps its country code; separators stay. Letters keep case, script (Latin,
Greek, Cyrillic) and kind (vowel, consonant); a name keeps its form of address and its last letter, which carry
the gender. Case (mail) and separators (digits) do not change who is meant: they are put back
afterwards, and each name word is replaced by itself, so "Mr. Smith" and "MR. SMITH" follow "Mr. John Smith".

Collision check: over the distinct entities of the whole corpus, a surrogate must be nobody's original
and nobody else's surrogate. Offenders get the permutation of the next key; this repeats until there is
none. A shape of which the corpus holds more than half has no such permutation, so from the key ``ATTEMPTS`` on, and again with every
``ATTEMPTS`` more, the shape is widened: by a syllable before a name's last letter or at the end of a local part, by two digits at the end of
a phone or security number; an IPv4 address gives up its first octet, an IPv6 address its short form. Cards and IBANs have 10**11 numbers to a shape at least and are only re-keyed.
If offenders are left after ``LEVELS`` such steps, the job fails. The offenders, found again in the documents, are the only
rows joined by entity.

Texts never shuffle unless they hold an offender. Defined cases: null text counts as
empty; texts without entities are returned as they are; repeated rows are treated alike; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, staged

KEY = "surrogates-1"  # production jobs pass a secret of their own
ROUNDS = 4
ATTEMPTS = 8  # keys for each width of a shape
LEVELS = 8

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
# Forms of address, longer ones first.
_FORMS = "Professor|Prof|Doctor|Dr|M(?=\\.)|Mrs|MRS|Mr|MR|Ms|MS|Miss|Herrn|Herr|Frau|Señora|Señor|Sra|Sr|Monsieur|Madame|Mme|Mlle|Κύριος|Κυρία|господин|госпожа"
# The pattern of each type, tried in this order where a match starts.
_HEX = "[0-9A-Fa-f]{1,4}"
_MIXED = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}+(?:\p{Lu}\p{Ll}+)?"
_CAPITALS = r"\p{Lu}(?:['’]\p{Lu}|\p{Lu})\p{Lu}*(?!\p{Ll})"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9])",
    "ip6": rf"(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|(?:{_HEX}:){{1,7}}:)(?![0-9A-Za-z:]|\.[0-9])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[0-9]{12}| [0-9]{4} [0-9]{4} [0-9]{4}|-[0-9]{4}-[0-9]{4}-[0-9]{4})(?![0-9])"
            r"|(?<![0-9])3[47][0-9]{2}(?:[0-9]{11}| [0-9]{6} [0-9]{5}|-[0-9]{6}-[0-9]{5})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"
             r"|(?<![0-9A-Za-z])\+(?=(?:[ .-]?[0-9]){7,15}(?![0-9]))[0-9]{1,3}(?:[ .-]?[0-9]{1,4}){2,6}(?![0-9])"
             r"|(?<![0-9A-Za-z.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "name": rf"(?<!\p{{L}})(?:{_FORMS})\.?(?:(?: (?!(?:{_FORMS})\b){_MIXED}(?:-{_MIXED})*){{1,3}}"
            rf"|(?: (?!(?:{_FORMS})\b){_CAPITALS}(?:-{_CAPITALS})*){{1,3}})(?!\p{{L}})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# A cheap test for texts that may hold an entity: every pattern needs one of these.
MAYBE = rf"[A-Za-z0-9%+._-]@|[0-9]{{3}}|[A-Z]{{2}}[0-9]{{2}}|[0-9A-Fa-f]:[0-9A-Fa-f:]|\+[0-9]|[0-9]\.[0-9]|(?:{_FORMS})\.? \p{{Lu}}"
# Letters that may stand for each other.
CLASSES = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "αεηιουω", "βγδζθκλμνξπρστφχψ",
           "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ"]
_FORM = r"^[^ ]+ "
# Letters of the syllables that widen a shape: consonants, vowels.
_LATIN, _GREEK, _CYRILLIC = (CLASSES[2], CLASSES[1]), (CLASSES[6], CLASSES[5]), (CLASSES[10], CLASSES[9])


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


HEX_DIGITS = "0123456789abcdef"


def _permute(x: str, key: str, classes: list[str] = CLASSES) -> str:
    """SQL: the keyed permutation of string ``x`` among the strings of its shape. The halves take turns; each is
    shifted letter by letter within its class by hashes of the key, the round and the other half."""
    shift = "c"
    for letters in classes:
        n, a = len(letters), _q(letters)
        shift = (f"if(locate(c, {a}) > 0, substr({a}, 1 + CAST(pmod(locate(c, {a}) - 1 + "
                 f"xxhash64({key}, r, k, array_join(s.b, '')), {n}) AS INT), 1), {shift})")
    state = "named_struct('a', slice(u, 1, size(u) div 2), 'b', slice(u, size(u) div 2 + 1, size(u)))"
    return (f"aggregate(sequence(1, {ROUNDS}), transform(array(filter(split({x}, ''), c -> c <> '')), u -> {state})[0], "
            f"(s, r) -> named_struct('a', s.b, 'b', transform(s.a, (c, k) -> {shift})), "
            f"s -> concat(array_join(s.a, ''), array_join(s.b, '')))")


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _redress(digits: str, like: str) -> str:
    """SQL: ``like`` with its digits replaced by ``digits`` in order."""
    return (f"array_join(transform(split({like}, ''), (c, i) -> if(c RLIKE '^[0-9]$', "
            f"substr({digits}, length(regexp_replace(substr({like}, 1, i + 1), '[^0-9]', '')), 1), c)), '')")


def _recase(lower: str, like: str) -> str:
    return (f"array_join(transform(split({like}, ''), (c, i) -> if(c <> lower(c), upper(substr({lower}, i + 1, 1)), "
            f"substr({lower}, i + 1, 1))), '')")


def _check_digit(body: str) -> str:
    """SQL: the Luhn digit that completes ``body``."""
    total = (f"aggregate(transform(split({body}, ''), (c, i) -> if((i + length({body})) % 2 = 1, "
             "if(CAST(c AS INT) > 4, 2 * CAST(c AS INT) - 9, 2 * CAST(c AS INT)), CAST(c AS INT))), 0, (x, y) -> x + y)")
    return f"CAST(pmod(-({total}), 10) AS STRING)"


def _check_digits(country: str, rest: str) -> str:
    """SQL: the two check digits (2 to 98) that complete an IBAN, as a number."""
    letter = "locate(c, '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ') - 1"
    rest = f"filter(split(concat({rest}, {country}, '00'), ''), c -> c <> '')"
    return f"98 - aggregate(transform({rest}, c -> {letter}), 0, (x, y) -> pmod(if(y > 9, 100, 10) * x + y, 97))"


def _type_of(e: str) -> str:
    cases = " ".join(f"WHEN {e} RLIKE {_q('^(?:' + p + ')$')} THEN '{t}'" for t, p in PATTERNS.items())
    return f"CASE {cases} END"


# Words of a name, and how one of them (w) is written.
_CAPITAL, _APOSTROPHE = "w RLIKE '^\\\\p{Lu}[\\\\p{Lu}\\'’]+$'", "w RLIKE '^\\\\p{Lu}[\\'’]'"


def _words(e: str) -> str:
    return f"split(regexp_replace({e}, '{_FORM}', ''), '[ -]')"


def _parts(kind: str, e: str) -> str:
    """SQL: array of the values that identify an entity: what the surrogate depends on, whatever its dress."""
    digits = f"regexp_replace({e}, '[^0-9]', '')"
    return (f"CASE {kind} WHEN 'email' THEN array(lower({e})) WHEN 'ip' THEN array({e}) "
            f"WHEN 'iban' THEN array(replace({e}, ' ', '')) WHEN 'ip6' THEN array(lower({e})) "
            f"WHEN 'name' THEN transform({_words(e)}, w -> if({_CAPITAL} OR {_APOSTROPHE}, concat(substr(w, 1, 1), lower(substr(w, 2))), w)) "
            f"ELSE array({digits}) END")


def _widen(v: str, key: str, letters: tuple[str, ...]) -> str:
    """SQL: what a widened shape adds, one letter of each string in ``letters`` for each ``ATTEMPTS`` keys tried; ``key``
    ends in the number of the attempt."""
    level = f"CAST(substring_index({key}, '|', -1) AS INT) div {ATTEMPTS}"
    one = ", ".join(f"substr({_q(a)}, 1 + CAST(pmod(xxhash64({key}, 'wide', {i}, k, {v}), {len(a)}) AS INT), 1)"
                    for i, a in enumerate(letters))
    return f"if({level} = 0, '', array_join(transform(sequence(1, {level}), k -> concat({one})), ''))"


def _surrogate_part(kind: str, v: str, key: str) -> str:
    """SQL: the surrogate of one identifying value; ``key`` ends in ``|`` and the number of the attempt."""
    local, domain = f"substring_index({v}, '@', 1)", f"substring_index({v}, '@', -1)"
    # top-level domain, and example.* as a whole, are no personal data
    tail = r"regexp_extract(" + domain + r", '((?:^|\\.)(?:example\\.)?[a-z]+)$', 1)"
    head = f"substr({domain}, 1, length({domain}) - length({tail}))"
    mail = f"concat({_permute(local, f'concat({key}, 1)')}, {_widen(v, key, _LATIN)}, '@', {_permute(head, f'concat({key}, 2)')}, {tail})"
    # the last digit's distance from the valid check digit stays: two different cards never meet
    body, keep = f"substr({v}, 1, length({v}) - 1)", f"(17 - length({v}))"
    off = f"CAST(substr({v}, -1) AS INT) - CAST({_check_digit(body)} AS INT)"
    card = _let(f"concat(substr({v}, 1, {keep}), {_permute(f'substr({v}, 1 + {keep}, length({v}) - 1 - {keep})', key)})", "y",
                f"concat(y, CAST(pmod(CAST({_check_digit('y')} AS INT) + {off}, 10) AS STRING))")
    # and so for the check digits of an IBAN, of which there are 97 that can be valid, and 00, 01 and 99
    country, own = f"substr({v}, 1, 2)", f"CAST(substr({v}, 3, 2) AS INT)"
    off = f"{own} - ({_check_digits(country, f'substr({v}, 5)')})"
    iban = _let(_permute(f"substr({v}, 5)", key, [CLASSES[0], CLASSES[3] + CLASSES[4]]), "y", _let(
        f"if({own} BETWEEN 2 AND 98, 2 + pmod({_check_digits(country, 'y')} - 2 + {off}, 97), {own})", "d", f"concat({country}, lpad(d, 2, '0'), y)"))
    first = f"substring_index({v}, ':', 1)"
    groups = ", ".join(f"lpad(lower(hex(xxhash64({key}, {i}, {v}) & 65535)), 4, '0')" for i in range(7))
    ip6 = (f"if(CAST(substring_index({key}, '|', -1) AS INT) < {ATTEMPTS}, concat({first}, {_permute(f'substr({v}, 1 + length({first}))', key, [HEX_DIGITS])}), "
           f"concat_ws(':', {first}, {groups}))")
    # 24 bits below the first octet, as two 12-bit halves; all 32 bits once the shape is widened
    octet = lambda i: f"CAST(split_part({v}, '.', {i}) AS BIGINT)"

    def rounds(half: int) -> str:
        low = (1 << half) - 1
        return (f"aggregate(sequence(1, {ROUNDS}), named_struct('a', shiftright(n, {half}), 'b', n & {low}), (s, r) -> "
                f"named_struct('a', s.b, 'b', (s.a + xxhash64({key}, r, s.b)) & {low}), s -> shiftleft(s.a, {half}) | s.b)")

    low = f"65536 * {octet(2)} + 256 * {octet(3)} + {octet(4)}"
    ip = _let(low, "n", _let(
        rounds(12), "m", f"concat_ws('.', split_part({v}, '.', 1), shiftright(m, 16), shiftright(m, 8) & 255, m & 255)"))
    any_ip = _let(f"16777216 * {octet(1)} + {low}", "n", _let(
        rounds(16), "m", "concat_ws('.', shiftright(m, 24), shiftright(m, 16) & 255, shiftright(m, 8) & 255, m & 255)"))
    ip = f"if(CAST(substring_index({key}, '|', -1) AS INT) < {ATTEMPTS}, {ip}, {any_ip})"
    syllables = (f"CASE WHEN {v} RLIKE '[а-яА-Я]' THEN {_widen(v, key, _CYRILLIC)} "
                 f"WHEN {v} RLIKE '[α-ωΑ-Ω]' THEN {_widen(v, key, _GREEK)} ELSE {_widen(v, key, _LATIN)} END")
    name = f"concat({_permute(f'substr({v}, 1, length({v}) - 1)', key)}, {syllables}, substr({v}, -1, 1))"
    plain = f"concat({_permute(v, key)}, {_widen(v, key, (CLASSES[0], CLASSES[0]))})"
    return (f"CASE {kind} WHEN 'email' THEN {mail} WHEN 'ip' THEN {ip} WHEN 'card' THEN {card} WHEN 'iban' THEN {iban} WHEN 'ip6' THEN {ip6} "
            f"WHEN 'name' THEN {name} ELSE {plain} END")


def _country(e: str) -> str:
    return f"regexp_extract({e}, '^\\\\+([0-9]{{1,3}})', 1)"


def _identity(kind: str, e: str) -> str:
    """SQL: array of (country code, value); only phones have a code, which stays."""
    code = f"if({kind} = 'phone', {_country(e)}, '')"
    return f"transform({_parts(kind, e)}, v -> named_struct('code', {code}, 'value', substr(v, 1 + length({code}))))"


def _replace(e: str, key: str, attempts: str | None) -> str:
    """SQL: the surrogate of entity ``e`` in its own dress; ``attempts`` is a map column from value to key number."""
    number = f"coalesce({attempts}[concat_ws('|', kind, p.code, p.value)], 0)" if attempts else "0"
    keyed = f"concat_ws('|', {_q(key)}, kind, p.code, {number})"
    done = f"transform({_identity('kind', e)}, p -> concat(p.code, {_surrogate_part('kind', 'p.value', keyed)}))"
    # names: form of address, then the words, written as they were, with their own separators
    written = (f"{_let(f'{_words(e)}[i]', 'w', f'if({_CAPITAL}, upper(x), if({_APOSTROPHE}, concat(substr(x, 1, 2), upper(substr(x, 3, 1)), substr(x, 4)), x))')}")
    name = (f"concat(regexp_extract({e}, '{_FORM}', 0), array_join(transform(z, (x, i) -> concat({written}, "
            f"element_at(concat(regexp_extract_all(regexp_replace({e}, '{_FORM}', ''), '[ -]', 0), array('')), i + 1))), ''))")
    # an IBAN's blanks, an IPv6 address's case
    iban = f"array_join(transform(split({e}, ''), (c, i) -> if(c = ' ', c, substr(z[0], length(replace(substr({e}, 1, i + 1), ' ', '')), 1))), '')"
    ip6 = f"if({e} = upper({e}) AND {e} <> lower({e}), upper(z[0]), z[0])"
    # a widened local part is longer than its own dress; widened numbers end in the digits that have no place in theirs
    like = f"concat(substring_index({e}, '@', 1), repeat('a', length(z[0]) - length({e})), substr({e}, locate('@', {e})))"
    more = f"substr(z[0], 1 + length(regexp_replace({e}, '[^0-9]', '')))"
    body = _let(done, "z", f"CASE kind WHEN 'email' THEN {_let(like, 'q', _recase('z[0]', 'q'))} WHEN 'ip' THEN z[0] "
                           f"WHEN 'iban' THEN {iban} WHEN 'ip6' THEN {ip6} WHEN 'name' THEN {name} ELSE concat({_redress('z[0]', e)}, {more}) END")
    return _let(_type_of(e), "kind", f"if(kind IS NULL, {e}, {body})")


def _entities(texts: DataFrame) -> DataFrame:
    """(digest, kind, code, value) of every entity value met, one row per text and value."""
    found = texts.select("digest", F.explode(F.expr("array_distinct(found)")).alias("e"))
    typed = found.select("digest", "e", F.expr(_type_of("e")).alias("kind")).filter("kind IS NOT NULL")
    return typed.select("digest", "kind", F.explode(F.expr(_identity("kind", "e"))).alias("p")).select(
        "digest", "kind", "p.code", "p.value")


def offenders(entities: DataFrame, key: str = KEY) -> DataFrame | None:
    """(kind, code, value, attempt > 0) of the values whose first surrogate is somebody's original or collides; None
    if there are none. ``entities``: distinct (kind, code, value)."""
    sql = _surrogate_part("kind", "value", f"concat_ws('|', {_q(key)}, kind, code, attempt)")
    one, row = ["kind", "code"], ["kind", "code", "value"]

    def keyed(values: DataFrame, attempt: int) -> DataFrame:
        return staged(values.select(*row, F.lit(attempt).alias("attempt")).withColumn("surrogate", F.expr(sql)), "pii-surrogates")

    now = keyed(entities, 0)
    originals = now.select(*one, F.col("value").alias("surrogate"))
    settled, moved, attempt = None, None, 0
    while True:
        # of the values with the newest key: who meets an original, a settled surrogate, or a smaller value's
        least = now.groupBy(*one, "surrogate").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least")).filter("n > 1")
        bad = now.join(originals, [*one, "surrogate"]).select(*row).union(
            now.join(least, [*one, "surrogate"]).filter("value > least").select(*row))
        if settled is not None:
            bad = bad.union(now.join(settled, [*one, "surrogate"]).select(*row))
        bad = staged(bad.distinct(), "pii-offenders")
        done = not bad.limit(1).count()
        if done and not attempt:
            return None
        kept = now.join(bad, row, "left_anti")
        if attempt:
            kept = staged(kept, "pii-settled")
            moved = kept if moved is None else moved.union(kept)
        if done:
            return moved.select(*row, "attempt")
        kept = kept.select(*one, "surrogate")
        settled = kept if settled is None else settled.union(kept)
        attempt += 1
        if attempt >= ATTEMPTS * (LEVELS + 1):
            raise RuntimeError(f"no surrogate of their own for {bad.count()} values after {attempt} keys")
        now = keyed(bad, attempt)


def pseudonymise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """One row per document: doc_id, text with surrogates, n_entities, changed."""
    t = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    t = t.withColumn("found", F.when(F.col("text").rlike(MAYBE), F.regexp_extract_all(
        "text", F.lit(ANY), F.lit(0))).otherwise(none))
    # what is replaced depends on the text alone: texts are known by digest, whatever their ids
    t = t.withColumn("digest", F.when(F.size("found") > 0, F.sha2(F.col("text").cast("binary"), 256)))
    met = staged(_entities(t.filter(F.size("found") > 0)), "pii-entities")
    moved = offenders(met.select("kind", "code", "value").distinct(), key)
    attempts = None
    if moved is not None:
        held = met.join(moved, ["kind", "code", "value"]).groupBy("digest").agg(F.map_from_entries(F.collect_set(F.struct(
            F.concat_ws("|", "kind", "code", "value"), "attempt"))).alias("attempts"))
        held = staged(held.withColumnRenamed("digest", "__of"), "pii-held")
        t = t.join(held, F.col("digest") == F.col("__of"), "left").drop("__of")
        attempts = "attempts"
    # between the pieces of the text stand the surrogates
    swapped = F.expr(f"array_join(zip_with(split(text, {_q(ANY)}, -1), transform(found, e -> {_replace('e', key, attempts)}), "
                     "(p, s) -> concat(p, coalesce(s, ''))), '')")
    new = F.when(F.size("found") > 0, swapped).otherwise(F.col("text"))
    kinds = F.expr(f"size(filter(found, e -> ({_type_of('e')}) IS NOT NULL))")
    out = t.select("doc_id", "text", kinds.cast("long").alias("n_entities"), new.alias("new"))
    return out.select("doc_id", F.col("new").alias("text"), "n_entities", (F.col("new") != F.col("text")).alias("changed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(read_table(spark, sf_dir, "documents"))
