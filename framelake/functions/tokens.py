"""Token ids: vocabulary, whitespace/byte tokenizer, fallbacks, padding, decoding.

Plan shape for the vocabulary tokenizer (T1) and its reverse (T8): rows are numbered into
blocks of bounded size, the distinct words (ids) of a block are looked up in the vocabulary with a join
(the vocabulary grows with its source table, so Spark picks the join from sizes), and every block
meets its own entries in a cogroup, where whole texts are encoded or decoded in Arrow. No row
per word or id is shuffled, sorted or regrouped. The only thing that tasks hold besides is the ids of
single-ASCII-character tokens, at most 128.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.plans import ordered
from framelake.plans.joins import look_up_in_blocks

# Special token ids and texts of the reference tokenizers.
BOS_ID = 151643
EOS_ID = 151645
IMAGE_ID = 151655
VIDEO_ID = 151656
VISION_START_ID = 151652
VISION_END_ID = 151653
VISION_ID = 151654
PAD_ID = BOS_ID
VOCAB_SIZE = 151936
SPECIAL_TEXT = {
    BOS_ID: "<|endoftext|>",
    EOS_ID: "<|im_end|>",
    IMAGE_ID: "<|image|>",
    VIDEO_ID: "<|video|>",
    VISION_START_ID: "<|vision_start|>",
    VISION_END_ID: "<|vision_end|>",
    VISION_ID: "<|vision|>",
}
UNKNOWN_BYTE_ID = 100      # byte without a 1-character vocabulary entry
SPACE_ID = 220             # fallback tokenizer's space, also a pad value
ASCII_OFFSET = 1000        # fallback tokenizer: printable ASCII -> code + 1000
KNOWN_ID_LIMIT = 50000     # decode: ids below this print as [id], others <unk>
BPE_SPACE = "Ġ"       # 'Ġ' marks a leading space in BPE vocabularies
UNK_TEXT = "<unk>"
QWEN_MAX_TOKENS = 2048
LLAMA_MAX_TOKENS = 4096

# istringstream word separators, spelled out (a bare \s differs between engines)
WS_CLASS = "[ \\t\\n\\r\\f\\x0B]"


def words(text: Column) -> Column:
    """Whitespace-separated words, empty pieces dropped."""
    return F.filter(F.split(text, WS_CLASS + "+"), lambda w: w != "")


def chars(text: Column) -> Column:
    """Characters (code points) of a string; empty string -> empty array."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, ""))


# --- vocabulary --------------------------------------------------------------------

def build_vocab(spark: SparkSession, corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """S13-style vocabulary from a corpus: ``a``..``z`` -> 1..26, every other
    distinct word ranked by (frequency desc, word) -> 1000 + rank (0-based).

    Frequencies are a partial aggregate; the global rank uses a range-partitioned
    sort plus per-partition offsets (``ordered.global_positions``), never one task.
    """
    w = corpus.select(F.explode(words(F.col(text_col))).alias("token")).filter(~F.col("token").rlike("^[a-z]$"))
    freq = w.groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    ranked = ordered.global_positions(freq, [F.col("freq").desc(), F.col("token").asc()], out="rank")
    words_part = ranked.select("token", (F.lit(ASCII_OFFSET) + F.col("rank")).cast("long").alias("id"))
    letters = spark.range(26).select(F.chr(F.col("id") + 97).alias("token"), (F.col("id") + 1).alias("id"))
    return words_part.unionByName(letters)


def vocab_from_json(tokenizer_json: Column) -> Column:
    """``model.vocab`` of a tokenizer JSON as map<string, bigint>; missing -> empty."""
    m = F.from_json(F.get_json_object(tokenizer_json, "$.model.vocab"), "map<string,bigint>")
    return F.coalesce(m, F.create_map().cast("map<string,bigint>"))


def single_char_ids(vocab: DataFrame) -> dict[str, int]:
    """1-character ASCII tokens -> id, at most 128 by construction."""
    rows = (vocab.filter((F.length("token") == 1) & (F.ascii("token") < 128))
            .groupBy("token").agg(F.min("id").alias("id")).collect())
    return {r["token"]: int(r["id"]) for r in rows if r["id"] is not None}


def tokenize(texts: DataFrame, vocab: DataFrame, key: str, text_col: str = "text",
             add_special: bool = True, out: str = "input_ids") -> DataFrame:
    """T1 + J2: ``encode(text)`` for every row; returns (key, out array<bigint>).

    Whole-word vocabulary hit -> its id; else the per-character fallback; BOS is
    prepended only to a non-empty result when ``add_special``. Keys may repeat or be NULL: texts are
    not cut up across rows.

    A word missing from the vocabulary goes by characters: an ASCII character maps to its 1-character token or 100; a non-ASCII
    character gives one 100 per UTF-8 byte.
    """
    cmap = single_char_ids(vocab)
    char_ids = np.full(256, UNKNOWN_BYTE_ID, np.int64)
    for ch, i in cmap.items():
        char_ids[ord(ch)] = i

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        hits: dict[bytes, list[int | None]] = {}
        for word, i in zip(_utf8(found["word"]), found["_word_id"].to_pylist()):
            hits.setdefault(word, []).append(i)
        numbers: dict[bytes, int] = {}   # word of the block -> its number, which names its ids
        texts = [[numbers.setdefault(w, len(numbers)) for w in t.split()] if t else [] for t in _utf8(block[text_col])]
        table, starts, sizes = _word_ids(numbers, hits, char_ids, BOS_ID)
        if add_special:
            texts = [[len(numbers), *t] if t else t for t in texts]
        picked = np.fromiter(chain.from_iterable(texts), np.int64)
        n = sizes[picked]
        ends = np.concatenate([[0], np.cumsum(n)])
        flat = table[np.arange(ends[-1]) + np.repeat(starts[picked] - ends[:-1], n)]
        offsets = ends[np.cumsum([0, *map(len, texts)])]
        return pa.table([block[key], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], names=[key, out])

    vocab_w = vocab.select(F.col("token").alias("word"), F.col("id").cast("long").alias("_word_id"))
    return look_up_in_blocks(texts.select(key, text_col), words(F.col(text_col)), F.coalesce(F.octet_length(text_col), F.lit(0)), vocab_w, "word",
                             run, T.StructType([texts.schema[key], T.StructField(out, T.ArrayType(T.LongType()))]))


def _utf8(strings: pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 bytes of strings: ``bytes.split`` cuts them at the six characters of ``WS_CLASS``."""
    return strings.cast(pa.large_binary()).to_pylist()


def _word_ids(words: Iterable[bytes], hits: dict[bytes, list[int | None]], char_ids: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of words in one table, with the start and the number of each word's: those of its vocabulary entries in ascending order, else
    (no entry, or one without id) by bytes. One id more, ``last``, goes by the number after the last word's."""
    words = list(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    table, more = char_ids[np.frombuffer(b"".join(words), np.uint8)], [last]
    for k, word in enumerate(words):
        if word in hits:
            by_bytes = table[starts[k]:starts[k] + sizes[k]].tolist()
            ids = sum(sorted(by_bytes if i is None else [i] for i in hits[word]), [])
            starts[k], sizes[k] = len(table) + len(more), len(ids)
            more += ids
    return np.concatenate([table, np.array(more, np.int64)]), np.append(starts, len(table)), np.append(sizes, 1)


def tokenize_fallback(text: Column) -> Column:
    """Space -> 220, printable ASCII -> code + 1000, everything else dropped."""
    kept = F.filter(chars(text), lambda ch: (F.ascii(ch) >= 32) & (F.ascii(ch) <= 126))
    return F.transform(kept, lambda ch: F.when(ch == " ", F.lit(SPACE_ID).cast("long"))
                       .otherwise((F.ascii(ch) + ASCII_OFFSET).cast("long")))


def signed_bytes(text: Column) -> Column:
    """UTF-8 bytes as signed char values (bytes >= 128 are negative)."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), 0)
    vals = F.transform(pairs, lambda hx: F.conv(hx, 16, 10).cast("int"))
    return F.transform(vals, lambda b: F.when(b >= 128, b - 256).otherwise(b).cast("long"))


def ascii_padded(text: Column, min_len: int = 16) -> Column:
    """T4: per byte, printable ASCII -> code else 32; pad with 32 to ``min_len``."""
    b = signed_bytes(text)
    ids = F.transform(b, lambda x: F.when((x >= 32) & (x <= 126), x).otherwise(F.lit(32).cast("long")))
    return pad_min(ids, min_len, 32)


def pad_or_truncate(ids: Column, length: int, fill: int) -> Column:
    """Exactly ``length`` ids: truncate, or pad with ``fill``."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(fill).cast("long"), length)), 1, length)


def pad_min(ids: Column, min_len: int, fill: int) -> Column:
    """T6 (minimum-length form): pad with ``fill`` up to ``min_len``, never truncate."""
    return F.concat(ids, F.array_repeat(F.lit(fill).cast("long"), F.greatest(F.lit(0), F.lit(min_len) - F.size(ids))))


def truncate_tokens(ids: Column, max_len: int) -> Column:
    """Keep the first ``max_len`` ids."""
    return F.slice(ids, 1, max_len)


def prompt_bytes_512(text: Column) -> Column:
    """T5: signed bytes padded with 0 / truncated to 512."""
    return pad_or_truncate(signed_bytes(text), 512, 0)


SPECIAL_IDS = sorted(SPECIAL_TEXT)


def is_special(token_id: Column) -> Column:
    """Membership in the special ids (pad shares the BOS id)."""
    return token_id.isin(SPECIAL_IDS)


def strip_special(ids: Column) -> Column:
    """Drop special ids, duplicates of others kept."""
    return F.filter(ids, lambda x: ~is_special(x))


def special_text_map() -> Column:
    kv = []
    for k in SPECIAL_IDS:
        kv += [F.lit(k).cast("long"), F.lit(SPECIAL_TEXT[k])]
    return F.create_map(*kv)


def special_id_map() -> Column:
    kv = []
    for k in SPECIAL_IDS:
        kv += [F.lit(SPECIAL_TEXT[k]), F.lit(k).cast("long")]
    return F.create_map(*kv)


def token_to_string(token_id: Column, vocab_token: Column) -> Column:
    """Special text, else vocabulary token (from a J3 join), else NULL."""
    return F.coalesce(F.try_element_at(special_text_map(), token_id), vocab_token)


def string_to_token(token: Column, vocab_id: Column) -> Column:
    """Special id, else vocabulary id (from a J2 join), else -1."""
    return F.coalesce(F.try_element_at(special_id_map(), token), vocab_id, F.lit(-1).cast("long"))


def detokenize(rows: DataFrame, vocab: DataFrame, key: str, ids_col: str = "input_ids",
               skip_special: bool = True, out: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """T8 + J3: decode id arrays.

    Per id (specials skipped when asked): vocabulary text, where a leading 'Ġ'
    becomes one space if something was already written; else the special
    text; else '[id]' for 0 <= id < 50000, else '<unk>'. Then spaces are
    collapsed: leading spaces dropped, runs become one, one trailing kept.
    Reverse lookup is a join of each block's distinct ids with the reverse vocabulary
    (broadcast by the planner when its bytes are few).
    Keys may repeat or be NULL, as in ``tokenize``.
    """
    skipped = set(SPECIAL_IDS) if skip_special else set()

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        tokens = dict(zip(found["tid"].to_pylist(), found["token"].to_pylist()))
        lists = block[ids_col].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        flat = lists.flatten()   # without the null lists, whose length is 0 here
        lengths = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        code = flat.dictionary_encode()
        known = [_piece(i, tokens.get(i), skipped) for i in code.dictionary.to_pylist()]
        # a piece as it is up to the first one that writes, and after it; null writes nothing
        early, late = [k[0] for k in known] + [None], [k[1] for k in known] + [None]
        writes = np.array([bool(p) for p in early])
        codes = code.indices.fill_null(len(known)).to_numpy().astype(np.int64)
        texts, at = [], 0
        for n in lengths:
            c = codes[at:at + n].tolist()
            first = int(np.argmax(writes[codes[at:at + n]])) + 1 if n else 0
            texts.append("".join([p for p in map(early.__getitem__, c[:first]) if p] + [p for p in map(late.__getitem__, c[first:]) if p]))
            at += n
        return block.drop_columns([ids_col]).append_column("_raw", pa.array(texts, pa.string()))

    rev = vocab.groupBy("id").agg(F.min("token").alias("token")).select(F.col("id").cast("long").alias("tid"), "token")
    fields = [rows.schema[key], *[rows.schema[c] for c in carry], T.StructField("_raw", T.StringType())]
    parts = look_up_in_blocks(rows.select(key, *carry, F.col(ids_col).cast("array<bigint>").alias(ids_col)), F.col(ids_col),
                              F.coalesce(F.size(ids_col), F.lit(0)), rev, "tid", run, T.StructType(fields))
    cleaned = F.regexp_replace(F.regexp_replace("_raw", "^ +", ""), " +", " ")
    return parts.select(key, cleaned.alias(out), *carry)


def _piece(token_id: int | None, token: str | None, skipped: set[int]) -> tuple[str | None, str | None]:
    """What an id writes while nothing is written yet, and after that; null for a skipped id."""
    if token_id is None or token_id in skipped:
        return None, None
    if token is not None:
        return (token[1:], " " + token[1:]) if token.startswith(BPE_SPACE) else (token, token)
    text = SPECIAL_TEXT.get(token_id, f"[{token_id}]" if 0 <= token_id < KNOWN_ID_LIMIT else UNK_TEXT)
    return text, text
