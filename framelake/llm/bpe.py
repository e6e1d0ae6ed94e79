"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The frequent words of the corpus (counted over all rows, at most ``LEXICON_WORDS``) are encoded
once and compiled into an automaton over their UTF-8 bytes that shares prefixes and suffixes.
Transitions carry numbers that add up to a word's number, which points to its ids. The
automaton is one file of plain arrays; Spark ships it to every machine and all Python
workers there map the same pages. Words that it lacks are merged exactly by the
vocabulary's merge ranks, so the lexicon changes the speed and never the ids.

Texts are cut into words as the tokenizer file asks (special strings first, then NFC, white
space to one space, lower case, split, UTF-8 bytes). Texts of plain Latin characters, for which
these rules are simple, are cut by one pattern; the tokenizer library's own normaliser and
splitter cut any other text. Decoding joins the tokens with one space, as the library
does for a vocabulary without a decoder.

Defined cases: null text counts as empty and gives no ids; repeated rows and ties are
encoded alike; an empty table gives an empty result; words have no length limit (long ones
are merged with a heap); extra columns are ignored by ``encode`` apart from those asked for.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.session import ensure_checkpoint_dir

from .common import kinds_of, read_table, staged, texts_for

VOCABULARY = "word_bpe_49k.json"
LEXICON_WORDS = 1 << 17
CACHED_WORDS = 1 << 17  # latest words met by one Python worker; as many older ones stay at hand
WORD_END = "</w>"
SLICE = 500  # rows encoded before their ids are handed on

# Characters for which lower-casing, NFC and the split are the same rules everywhere: ASCII
# without control characters, Latin letters up to U+017F (but not the dotted capital I, whose
# lower case has two characters), and common punctuation.
_ODD = re.compile("[^\t\n\x0b\f\r -~¡-©«-¬®-±´¶-¸»¿-įı-ſ"
                  "‐-‧‰-⁞₠-₿]")
_LETTERS = "a-zß-öø-ſ"
_PLAIN_WORDS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9\\s]+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Ids, merge ranks and word splitting of one tokenizer file."""

    def __init__(self, path: str):
        self.path, self._library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        self.tokens = {i: t for t, i in ids.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        merges = spec["model"]["merges"]
        self.pairs = {(ids[a], ids[b]): rank for rank, (a, b) in enumerate(merges)}
        self.merged = [ids[a + b] for a, b in merges]  # by rank
        letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.inner = [ids[c] for c in letters]
        self.last = [ids[c + WORD_END] for c in letters]
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    @property
    def library(self):
        """The tokenizer library's object, made when the first odd text needs it."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def words(self, text: str) -> list[str]:
        """Words of a text without special strings."""
        if not _ODD.search(text):
            return _PLAIN_WORDS.findall(text.lower())
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, w)).decode("utf-8") for w, _ in pieces]

    def segments(self, text: str) -> list[str]:
        """Special strings at the odd places, ordinary text at the even ones."""
        return self._cut.split(text) if "<|" in text else [text]

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of lowest rank (the leftmost of equals) is merged until none is left."""
        ids = [self.inner[b] for b in word[:-1]]
        ids.append(self.last[word[-1]])
        if len(ids) > 48:
            return self._merge_long(ids)
        rank_of, never = self.pairs.get, len(self.merged)
        ranks = [rank_of(p, never) for p in zip(ids, ids[1:])]
        while ranks:
            rank = min(ranks)
            if rank == never:
                break
            k = ranks.index(rank)
            ids[k:k + 2] = [self.merged[rank]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank_of((ids[k - 1], ids[k]), never)
            if k < len(ranks):
                ranks[k] = rank_of((ids[k], ids[k + 1]), never)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over linked positions, for words whose square would be slow."""
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(self.pairs[p], k, p) for k, p in enumerate(zip(ids, ids[1:])) if p in self.pairs]
        heapq.heapify(heap)
        alive = [True] * len(ids)

        def offer(a: int) -> None:
            b = after[a] if a >= 0 else -1
            if b >= 0 and (p := (ids[a], ids[b])) in self.pairs:
                heapq.heappush(heap, (self.pairs[p], a, p))

        while heap:
            _, a, p = heapq.heappop(heap)
            b = after[a]
            if not alive[a] or b < 0 or (ids[a], ids[b]) != p:
                continue
            ids[a], alive[b], after[a] = self.merged[self.pairs[p]], False, after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(a)
            offer(before[a])
        return [x for x, on in zip(ids, alive) if on]


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The minimal automaton of the words, with word numbers as outputs, as one block of arrays.

    Words are added in byte order; when a word leaves a branch, the branch's states are
    replaced by equal states met before (same finality, same transitions), which shares suffixes."""
    known: dict[tuple, int] = {}
    states: list[tuple[bool, list[tuple[int, int]]]] = []

    def settle(final: bool, edges: list[tuple[int, int]]) -> int:
        key = (final, tuple(edges))
        if key not in known:
            known[key] = len(states)
            states.append((final, edges))
        return known[key]

    words = sorted(w for w in entries if w)
    path: list[list] = [[False, [], 0]]  # open states of the latest word: final, edges, byte that led there
    for word, was in zip(words, [b"", *words]):
        same = len(os.path.commonprefix([word, was]))
        while len(path) > same + 1:
            final, edges, byte = path.pop()
            path[-1][1].append((byte, settle(final, edges)))
        path += [[False, [], b] for b in word[same:]]
        path[-1][0] = True
    while len(path) > 1:
        final, edges, byte = path.pop()
        path[-1][1].append((byte, settle(final, edges)))
    root = settle(path[0][0], path[0][1])

    below = [0] * len(states)  # words that can be finished from a state; targets come before their sources
    first, target, add, labels = [0], [], [], bytearray()
    for s, (final, edges) in enumerate(states):
        n = int(final)
        for byte, to in edges:
            labels.append(byte)
            target.append(to)
            add.append(n)
            n += below[to]
        below[s] = n
        first.append(len(target))
    pool_at, pool = [0], []
    for w in words:
        pool += entries[w]
        pool_at.append(len(pool))
    final = [int(f) for f, _ in states]
    parts = [first, target, add, final, pool_at, pool]
    head = struct.pack("<8i", root, *map(len, parts), len(labels))
    return head + b"".join(np.asarray(p, "<i4").tobytes() for p in parts) + bytes(labels)


class Lexicon:
    """A compiled lexicon, read in place from a memory map (or any buffer)."""

    def __init__(self, buffer):
        self.buffer = buffer
        head = struct.unpack_from("<8i", buffer)
        self.root, at, view, parts = head[0], 8, memoryview(buffer), []
        ints = view[:4 * (8 + sum(head[1:7]))].cast("i")
        for n in head[1:7]:
            parts.append(ints[at:at + n])
            at += n
        self.first, self.target, self.add, self.final, self.pool_at, self.pool = parts
        self.labels_at = 4 * at

    @classmethod
    def open(cls, path: str) -> "Lexicon":
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def get(self, word: bytes) -> bytes | None:
        """The word's ids as little-endian 32-bit integers, or None."""
        s, n, base, find = self.root, 0, self.labels_at, self.buffer.find
        for k in range(len(word)):
            e = find(word[k:k + 1], base + self.first[s], base + self.first[s + 1]) - base
            if e < 0:
                return None
            n += self.add[e]
            s = self.target[e]
        return self.pool[self.pool_at[n]:self.pool_at[n + 1]].tobytes() if self.final[s] else None


class _Ids(dict):
    """word -> its ids as little-endian bytes; filled from the lexicon, else by merging."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        got = self.older.get(word)
        if got is None:
            raw = word.encode("utf-8")
            got = self.lexicon.get(raw)
            if got is None:
                ids = self.vocabulary.merge(raw)
                got = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= CACHED_WORDS:
            self.older = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = got
        return got


class Encoder:
    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary = vocabulary
        self.ids_of = _Ids(vocabulary, lexicon)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        v, out = self.vocabulary, []
        for k, part in enumerate(v.segments((text or "").encode("utf-8", "replace").decode("utf-8"))):
            if k % 2:
                out.append(struct.pack("<I", v.special[part]))
            else:
                out += map(self.ids_of.__getitem__, v.words(part))
        return b"".join(out)

    def decode(self, ids) -> str:
        return " ".join(map(self.vocabulary.tokens.__getitem__, ids))


_OPEN: dict[tuple[str, str], Encoder] = {}


def _encoder(vocabulary: str, lexicon: str) -> Encoder:
    """The worker's encoder; the files have been shipped by ``addFile``."""
    if (vocabulary, lexicon) not in _OPEN:
        _OPEN.clear()
        _OPEN[vocabulary, lexicon] = Encoder(Vocabulary(SparkFiles.get(vocabulary)),
                                             Lexicon.open(SparkFiles.get(lexicon)))
    return _OPEN[vocabulary, lexicon]


def frequent_words(docs: DataFrame, text_col: str = "text", most: int = LEXICON_WORDS) -> list[str]:
    """The most frequent lower-case words, counted over all rows: every word at least as
    frequent as some count, chosen so that there are ``most`` at most."""
    # pieces between blanks are counted first; lower case and the split into letters then run on distinct pieces only
    text = F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("\n"), F.lit(" "))
    pieces = docs.select(F.explode(F.split(text, " ")).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    words = pieces.select(F.explode(F.split(F.lower("p"), f"[^{_LETTERS}]+")).alias("w"), "n")
    counted = staged(words.filter("w <> '' AND length(w) <= 40").groupBy("w").agg(F.sum("n").alias("n")).filter("n > 1")
                     .withColumn("level", F.floor(F.log2("n") * 8).cast("int")), "bpe-words")
    left, least = most, None
    for level, words in sorted(counted.groupBy("level").count().collect(), reverse=True):  # under 520 levels
        left -= words
        if left < 0:
            break
        least = level
    return [] if least is None else [w for (w,) in counted.filter(F.col("level") >= least).select("w").collect()]


def build_lexicon(docs: DataFrame, path: str, text_col: str = "text", most: int = LEXICON_WORDS) -> bytes:
    """The compiled lexicon of a corpus for the tokenizer file at ``path``."""
    v = Vocabulary(path)
    return compile_lexicon({w.encode("utf-8"): v.merge(w.encode("utf-8")) for w in frequent_words(docs, text_col, most)})


def _ship(spark: SparkSession, path: str, lexicon: bytes) -> tuple[str, str]:
    """Hand the tokenizer file and the lexicon to every machine. The lexicon goes by the
    shared checkpoint folder, so an executor that starts later fetches it as well."""
    sc = spark.sparkContext
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    where = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}"
    p = sc._jvm.org.apache.hadoop.fs.Path(where)
    stream = p.getFileSystem(sc._jsc.hadoopConfiguration()).create(p)
    for at in range(0, len(lexicon), 1 << 20):
        stream.write(bytearray(lexicon[at:at + (1 << 20)]))
    stream.close()
    sc.addFile(where)
    sc.addFile(path)
    return os.path.basename(path), name


def encode(docs: DataFrame, path: str, columns: tuple[str, ...] = ("doc_id",), text_col: str = "text",
           most: int = LEXICON_WORDS, digests: bool = False) -> DataFrame:
    """``columns`` and n_tokens with, per row, ids (array<int>), or if ``digests`` the SHA-256 of the ids
    (little-endian unsigned 32-bit) and of the decoded text instead."""
    shipped = _ship(docs.sparkSession, path, build_lexicon(docs, path, text_col, most))
    schema = "".join(f"`{c}` string, " for c in columns) + "n_tokens long, "
    schema += "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(*shipped)
        for b in (x.iloc[at:at + SLICE] for x in batches for at in range(0, len(x), SLICE)):
            raw = [enc.encode(t) for t in b["__text"]]
            out = b[list(columns)].copy()
            out["n_tokens"] = [len(r) // 4 for r in raw]
            if digests:
                out["ids_sha256"] = [hashlib.sha256(r).hexdigest() for r in raw]
                out["decoded_sha256"] = [hashlib.sha256(enc.decode(np.frombuffer(r, "<u4").tolist()).encode()).hexdigest()
                                         for r in raw]
            else:
                out["ids"] = [np.frombuffer(r, "<u4").astype(np.int32) for r in raw]
            yield out

    named = texts_for(docs.select(*columns, F.col(text_col).alias("__text")), columns)
    return kinds_of(named.mapInPandas(run, schema), docs, {c: c for c in columns})


def decode(encoded: DataFrame, path: str, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` and text: the tokens of ``ids`` joined by one space (null ids: empty)."""
    encoded.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)
    schema = "".join(f"`{c}` string, " for c in columns) + "text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Vocabulary(SparkFiles.get(name)).tokens
        for b in batches:
            out = b[list(columns)].copy()
            out["text"] = [" ".join(tokens[i] for i in (() if x is None else x)) for x in b["ids"]]
            yield out

    named = texts_for(encoded.select(*columns, "ids"), columns)
    return kinds_of(named.mapInPandas(run, schema), encoded, {c: c for c in columns})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path(VOCABULARY), digests=True)
