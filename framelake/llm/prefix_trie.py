"""The trie of shared conversation prefixes, by count-min screening of prefix digests.

Every conversation c is rebuilt from the first h turns of conversation c - c % 20 and its own turns after its first h
(h = crc32 of c's decimal digits, modulo 4). A node is a distinct sequence of first turns (role, text); its members are the rebuilt conversations
that start with it.

1. Turns are reduced to a digest and a word count, sorted by (conversation, turn) in range partitions, so that one long conversation spreads
   over tasks, and cut into chunks of at most ``CHUNK`` turns. Chunks learn their place from a table with one row a chunk.
2. A prefix's digest is the XOR of 128-bit hashes of (place, turn), so chunks continue the digests of earlier chunks.
3. Screening: a count-min sketch of ``ROWS`` rows counts all prefixes. Its cells saturate at two, so a cell is one bit:
   met once at most, or more often. A prefix with a cell that was met once is in one conversation only. Tasks
   pack the cells that they met as lists of 2 bytes a cell (or as bits, if shorter), so prefixes don't shuffle to be counted.
4. Tails: a node that is proven to have one member is known whole from its conversation, and is emitted where it is. Only
   prefixes that may be shared shuffle, as a digest and a few numbers, for exact grouping.
5. Sums over subtrees: every node is charged to its smallest member at its depth; a member's charges from a depth on are one
   running sum, and a node's subtree is the sum over its members. No pair of node and descendant is made.

The sketch is sent to all tasks, ``SKETCH_BITS`` bits at most (64 MB). With more prefixes than it has room for (16 bits each) the
prefixes are dealt by digest into ranges with a sketch each, made and read one after another, so a singleton is found as often as in a
small table. Whether a prefix is screened depends on its digest alone.

A node's ends are hashed as one text, as asked: ids are sorted within spans of ``ENDS_SPAN`` ids, and one task streams a node's
spans through its hash, holding one at a time.

Defined cases: turns with a null conversation belong to none and are left out; null turns come first; equal turns are ordered by digest;
repeated rows are turns of their own; null role or text is empty; a conversation without turns ends at the root; an
empty table has no node; c - c % 20 rounds towards zero; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, read_table, staged

FAMILY, HEADS = 20, 4  # conversations share the first turns of one in FAMILY; h < HEADS
CHUNK = 4096
ROWS = 4  # of the sketch
BITS_PER_PREFIX = 16
SKETCH_BITS = 1 << 29
PAGE = 1 << 15  # cells of one page of the sketch
ENDS_SPAN = 1 << 12
EMPTY = hashlib.sha256(b"").hexdigest()


# --- 1. chunks of turns ----------------------------------------------------------------------------------------

def _thin_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, turn, key, words): the digest of (role, text) and the words of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    key = F.unhex(F.sha2(F.concat(F.sha2(role, 256), text), 256))
    return turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), key.alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


_CHUNKS = "conv_id long, part int, chunk int, n int, keys binary, words array<long>"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted turns: one row per conversation and CHUNK turns of it."""
    now, rows, chunk = None, [], 0

    def row():
        return {"conv_id": now[0], "part": now[1], "chunk": chunk, "n": len(rows), "keys": b"".join(k for k, _ in rows), "words": [w for _, w in rows]}

    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("chunk", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()),
                        ("words", pa.list_(pa.int64()))])
    for b in batches:
        out = []
        for c, p, k, w in zip(*(b.column(x).to_pylist() for x in ("conv_id", "part", "key", "words"))):
            if (c, p) != now or len(rows) == CHUNK:
                if rows:
                    out.append(row())
                chunk = chunk + 1 if (c, p) == now else 0
                now, rows = (c, p), []
            rows.append((k, w))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if rows:
        yield pa.RecordBatch.from_pylist([row()], schema)


def rebuilt_chunks(turns: DataFrame) -> DataFrame:
    """One row per chunk of a conversation, with its place: conv_id, at (its first turn's place among the own turns), n, keys, words,
    and of the conversation h, head_n, head_keys, head_words (the turns put first) and total (rebuilt turns)."""
    spark = turns.sparkSession
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("key"), F.col("salt")]
    # equal rows get a number, so that a turn repeated many times spreads as well
    thin = staged(turns.withColumn("salt", F.monotonically_increasing_id()), "trie-turns")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = thin.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    chunks = staged(dealt.select("conv_id", "part", "key", "words").mapInArrow(_chunks, _CHUNKS), "trie-chunks")
    earlier = Window.partitionBy("conv_id").orderBy("part", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    meta = chunks.select("conv_id", "part", "chunk", "n", F.expr(f"substring(keys, 1, {32 * (HEADS - 1)})").alias("k"),
                         F.slice("words", 1, HEADS - 1).alias("w"))
    meta = meta.withColumn("at", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long"))).withColumn("own", F.sum("n").over(whole))
    meta = staged(meta, "trie-places")
    # the first turns of every conversation that others may take theirs from: under HEADS chunks each
    heads = meta.filter((F.col("at") < HEADS - 1) & (F.col("conv_id") % FAMILY == 0)).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "k", "w"))).alias("c"))
    keys = F.aggregate("c", F.lit(b""), lambda a, x: F.concat(a, x["k"]))
    heads = heads.select(F.col("conv_id").alias("base"), keys.alias("bk"), F.flatten(F.transform("c", lambda x: x["w"])).alias("bw"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    met = meta.withColumn("h", h).join(heads, (F.col("conv_id") - F.col("conv_id") % FAMILY) == F.col("base"), "left")
    head_n = F.least(F.col("h"), F.coalesce(F.size("bw"), F.lit(0)))
    met = met.withColumn("head_n", F.when(F.col("bw").isNull(), 0).otherwise(head_n))
    place = met.select("conv_id", "part", "chunk", "at", "h", "head_n", F.expr("substring(coalesce(bk, X''), 1, 32 * head_n)").alias("head_keys"),
                       F.expr("slice(coalesce(bw, array()), 1, head_n)").alias("head_words"),
                       (F.col("head_n") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("total"))
    return staged(chunks.join(place, ["conv_id", "part", "chunk"]), "trie-rebuilt")


# --- 2. digests of prefixes ------------------------------------------------------------------------------------

_PREFIXES = "conv_id long, at long, total long, depth long, lo binary, hi binary, words array<long>, sum_lo long, sum_hi long"


def _hashes(first: int, keys: list[bytes]) -> np.ndarray:
    """Two 64-bit words for each turn at the depths from ``first`` on."""
    raw = b"".join(hashlib.sha256(d.to_bytes(8, "little") + k).digest()[:16] for d, k in enumerate(keys, first))
    return np.frombuffer(raw, "<u8").reshape(-1, 2)


def _local_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every chunk: the digests of its prefixes, as if it were the first one. depth: of its first turn, rebuilt."""
    for b in batches:
        out = []
        for r in b.to_pylist():
            keys = [r["keys"][i:i + 32] for i in range(0, len(r["keys"]), 32)]
            drop = min(max(r["h"] - r["at"], 0), len(keys))
            keys, words, first = keys[drop:], r["words"][drop:], r["head_n"] + r["at"] + drop - r["h"] + 1
            if r["at"] == 0:  # the conversation's first chunk brings the turns put first
                keys = [r["head_keys"][i:i + 32] for i in range(0, len(r["head_keys"]), 32)] + keys
                words, first = r["head_words"] + words, 1
            run = np.bitwise_xor.accumulate(_hashes(first, keys), axis=0) if keys else np.zeros((0, 2), "<u8")
            ends = (run[-1] if keys else np.zeros(2, "<u8")).view("<i8")
            out.append({"conv_id": r["conv_id"], "at": r["at"], "total": r["total"], "depth": first, "lo": run[:, 0].tobytes(),
                        "hi": run[:, 1].tobytes(), "words": words, "sum_lo": int(ends[0]), "sum_hi": int(ends[1])})
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema(
                [("conv_id", pa.int64()), ("at", pa.int64()), ("total", pa.int64()), ("depth", pa.int64()), ("lo", pa.binary()), ("hi", pa.binary()),
                 ("words", pa.list_(pa.int64())), ("sum_lo", pa.int64()), ("sum_hi", pa.int64())]))


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """Chunks with the digests of their prefixes (lo, hi: 64 bits each) relative to before_lo, before_hi."""
    local = staged(rebuilt.mapInArrow(_local_prefixes, _PREFIXES), "trie-prefixes")
    earlier = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    sums = local.select("conv_id", "at", "sum_lo", "sum_hi").select(
        "conv_id", "at", *[F.coalesce(F.bit_xor(f"sum_{k}").over(earlier), F.lit(0).cast("long")).alias(f"before_{k}") for k in ("lo", "hi")])
    joined = local.drop("sum_lo", "sum_hi").join(sums, ["conv_id", "at"])
    return staged(joined, "trie-digests")


def _digests(r: dict) -> np.ndarray:
    """(n + 1, 2) words: the prefix before the chunk, and those that end in it."""
    own = np.stack([np.frombuffer(r[k], "<u8") for k in ("lo", "hi")], axis=1)
    before = np.array([r["before_lo"], r["before_hi"]], "<i8").view("<u8")
    return np.concatenate([before[None], own ^ before])


# --- 3. the sketch ---------------------------------------------------------------------------------------------

def _mix(x: np.ndarray, k: int) -> np.ndarray:
    """A different 64-bit number for each k."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def _range_of(d: np.ndarray, ranges: int) -> np.ndarray:
    return (d[:, 1] >> np.uint64(33)) % np.uint64(ranges)


def _cells(d: np.ndarray, bits: int) -> np.ndarray:
    """(n, ROWS) cells of digests; each row of the sketch has cells of its own."""
    width = bits // ROWS
    return np.stack([_mix(d[:, 0], k) % np.uint64(width) + np.uint64(k * width) for k in range(ROWS)], axis=1).astype(np.int64)


def _pack(cells: np.ndarray) -> bytes:
    bits = np.zeros(PAGE, bool)
    bits[cells] = True
    return np.packbits(bits).tobytes() if len(cells) > PAGE // 16 else cells.astype("<u2").tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    """Cells of a page. A page as bits has 4096 bytes; a list that long has over PAGE / 16 cells and would be bits."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8))) if len(raw) == PAGE // 8 else np.frombuffer(raw, "<u2").astype(np.int64)


_PAGES = "page int, once binary, more binary"


def _sketch_of_task(ranges: int, which: int, bits: int, batch: int = 1 << 20):
    """Pages of the cells that a task met, once or more often, a batch of prefixes at a time."""
    def pages(found: list[np.ndarray]) -> pa.RecordBatch:
        cells, n = np.unique(np.concatenate(found), return_counts=True)
        page = cells // PAGE
        starts = np.flatnonzero(np.diff(page, prepend=-1))
        rows = [{"page": int(page[s]), "once": _pack(cells[s:e][n[s:e] == 1] % PAGE), "more": _pack(cells[s:e][n[s:e] > 1] % PAGE)}
                for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(cells)])]
        return pa.RecordBatch.from_pylist(rows, pa.schema([("page", pa.int32()), ("once", pa.binary()), ("more", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for b in batches:
            for r in b.to_pylist():
                d = _digests(r)[1:]
                d = d[_range_of(d, ranges) == which]
                if len(d):
                    found.append(_cells(d, bits).ravel())
                    n += len(d)
                if n >= batch:
                    yield pages(found)
                    found, n = [], 0
        if found:
            yield pages(found)

    return run


def _merge_pages(table: pa.Table) -> pa.Table:
    """One page of the sketch: the cells met more than once, as bits."""
    seen = np.zeros(PAGE, np.uint8)
    for name, times in (("once", 1), ("more", 2)):
        for raw in table.column(name).to_pylist():
            at = _unpack(raw)
            seen[at] = np.minimum(seen[at] + times, 2)
    return pa.table({"page": table.column("page").slice(0, 1), "bits": pa.array([np.packbits(seen > 1).tobytes()], pa.binary())})


def repeated_cells(digests: DataFrame, ranges: int, which: int, bits: int) -> bytes:
    """The sketch of one range of digests: a bit for each cell met more than once. SKETCH_BITS at most."""
    partial = digests.select("conv_id", "lo", "hi", "before_lo", "before_hi").mapInArrow(_sketch_of_task(ranges, which, bits), _PAGES)
    pages = partial.groupBy("page").applyInArrow(_merge_pages, "page int, bits binary")
    out = bytearray(bits // 8)
    for page, raw in staged(pages, "trie-sketch").toLocalIterator():
        out[page * PAGE // 8:(page + 1) * PAGE // 8] = raw
    return bytes(out)


def screened(digests: DataFrame, n: int, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """The chunks with ``maybe``: a byte for the prefix before the chunk and each one in it, 0 where it is proven to be in one
    conversation only. n: the number of prefixes."""
    spark = digests.sparkSession
    ranges = -(-n * BITS_PER_PREFIX // sketch_bits) or 1
    bits = max(PAGE * ROWS, min(sketch_bits, 1 << (n * BITS_PER_PREFIX - 1).bit_length() if n else 0))
    now = digests.withColumn("maybe", F.lit(None).cast("binary"))
    for which in range(ranges):
        sent = spark.sparkContext.broadcast(repeated_cells(digests, ranges, which, bits))

        def run(batches: Iterator[pa.RecordBatch], which=which, sent=sent) -> Iterator[pa.RecordBatch]:
            table = np.frombuffer(sent.value, np.uint8)
            for b in batches:
                flags = []
                for r in b.to_pylist():
                    d = _digests(r)
                    maybe = np.ones(len(d), np.uint8) if r["maybe"] is None else np.frombuffer(r["maybe"], np.uint8).copy()
                    mine = _range_of(d, ranges) == which
                    cells = _cells(d[mine], bits)
                    maybe[mine] = (table[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).all(axis=1)
                    if r["depth"] == 1:
                        maybe[0] = 1  # the root
                    flags.append(maybe.tobytes())
                at = b.schema.get_field_index("maybe")
                yield b.set_column(at, "maybe", pa.array(flags, pa.binary()))

        now = staged(now.mapInArrow(run, now.schema), "trie-screened")
    return now


# --- 4. tails where they are, and the prefixes that may be shared ----------------------------------------------------

_SPLIT = "conv_id long, depth long, lo long, hi long, up_lo long, up_hi long, words long, maybe boolean, up_maybe boolean, last boolean"


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per prefix, with the digest of the one before it (up) and what is known of both."""
    names = [x.split()[0] for x in _SPLIT.split(", ")]

    def columns(r: dict) -> list[np.ndarray]:
        d, maybe = _digests(r).view("<i8"), np.frombuffer(r["maybe"], np.uint8).astype(bool)
        n = len(d) - 1
        depth = np.arange(r["depth"], r["depth"] + n, dtype=np.int64)
        return [np.full(n, r["conv_id"], np.int64), depth, d[1:, 0], d[1:, 1], d[:-1, 0], d[:-1, 1], np.array(r["words"], np.int64),
                maybe[1:], maybe[:-1], depth == r["total"]]

    for b in batches:
        for at in range(0, b.num_rows, 64):  # 64 * CHUNK prefixes at most
            parts = [columns(r) for r in b.slice(at, 64).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], names)


def _ends(ends: DataFrame) -> DataFrame:
    """(lo, hi, ends_sha256) of (lo, hi, conv_id): the hash of each node's ids in numerical order, comma-joined."""
    span = F.expr(f"shiftright(conv_id, {ENDS_SPAN.bit_length() - 1})").alias("span")
    # a span has at most ENDS_SPAN ids, as ids differ
    texts = ends.select("lo", "hi", span, "conv_id").groupBy("lo", "hi", "span").agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    texts = texts.select("lo", "hi", "span", F.array_join("ids", ",").alias("text"))
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.repartition(parts, "lo", "hi").sortWithinPartitions("lo", "hi", "span")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def row(out):
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()),
                                               pa.array([x[2] for x in out], pa.string())], ["lo", "hi", "ends_sha256"])

        for b in batches:
            out = []
            for lo, hi, text in zip(*(b.column(c).to_pylist() for c in ("lo", "hi", "text"))):
                if (lo, hi) == now:
                    state.update(b",")
                else:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = (lo, hi), hashlib.sha256()
                state.update(text.encode())
            if out:
                yield row(out)
        if now is not None:
            yield row([(*now, state.hexdigest())])

    return dealt.select("lo", "hi", "text").mapInArrow(run, "lo long, hi long, ends_sha256 string")


def build(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
          sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rebuilt = rebuilt_chunks(_thin_turns(turns, conv_col, turn_col, role_col, text_col))
    digests = prefixes(rebuilt)
    first = digests.filter("at = 0")  # one row per conversation
    root_id, n_convs, n = digests.agg(F.min("conv_id"), F.sum(F.expr("if(at = 0, 1, 0)")), F.sum(F.size("words"))).first()
    rows = staged(screened(digests, n or 0, sketch_bits).mapInArrow(_split, _SPLIT), "trie-rows")
    alone, shared = rows.filter("NOT maybe"), rows.filter("maybe")
    digest, up = ["lo", "hi"], ["up_lo", "up_hi"]

    nodes = staged(shared.groupBy(*digest).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *[
        F.first(c).alias(c) for c in ("depth", "words", "up_maybe", *up)]), "trie-nodes")
    tops = alone.filter("up_maybe")  # tails begin here; the nodes above them are exact
    below = nodes.select("conv_id", "up_maybe", *up).filter("up_maybe").select(*up).unionByName(tops.select(*up))
    children = staged(below.groupBy(*up).agg(F.count(F.lit(1)).alias("n_children")).withColumnsRenamed({"up_lo": "lo", "up_hi": "hi"}), "trie-children")
    # an exact node under a proven singleton has one member, and so its parent; it is that one's only child
    nodes = staged(nodes.join(children, digest, "left").na.fill(0, ["n_children"]), "trie-counted")

    # leaves: a conversation ends in one if its last prefix is a tail, or an exact node without children whose smallest member it is
    own_leaf = alone.filter("last").select("conv_id").unionByName(nodes.filter("n_children = 0").select("conv_id"))
    # a node that goes on as a proven singleton is no leaf itself: its tail's end is
    own_leaf = staged(own_leaf.withColumn("leaf", F.lit(1).cast("long")), "trie-leaves")
    # charges: of nodes that save something, to their smallest member
    charges = nodes.filter("n_convs > 1").select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saves"))
    charges = staged(charges, "trie-charges")
    on = shared.select("conv_id", "depth", *digest).join(charges, ["conv_id", "depth"], "left").na.fill(0, ["saves"])
    span = F.expr(f"depth div {CHUNK}")
    on = staged(on.withColumn("span", span), "trie-charged")
    later = Window.partitionBy("conv_id", "span").orderBy(F.desc("depth"))
    spans = on.groupBy("conv_id", "span").agg(F.sum("saves").alias("all"))
    after = Window.partitionBy("conv_id").orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    spans = staged(spans.select("conv_id", "span", F.coalesce(F.sum("all").over(after), F.lit(0).cast("long")).alias("after")), "trie-spans")
    summed = on.withColumn("rest", F.sum("saves").over(later)).join(spans, ["conv_id", "span"]).join(own_leaf, "conv_id", "left")
    sums = summed.groupBy(*digest).agg(F.sum(F.col("rest") + F.col("after")).alias("saved_tokens"),
                                       F.sum(F.coalesce("leaf", F.lit(0).cast("long"))).alias("n_leaves"))

    parents = nodes.select(F.col("lo").alias("up_lo"), F.col("hi").alias("up_hi"), F.col("conv_id").alias("parent"))
    ends = _ends(shared.filter("last").select(*digest, "conv_id"))

    def with_parent(df: DataFrame) -> DataFrame:
        """The parent's smallest member: the root's, the node's own if the parent has one member, or looked up."""
        known = df.filter("depth = 1 OR NOT up_maybe").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root_id)).otherwise(F.col("conv_id")))
        asked = df.filter("depth > 1 AND up_maybe").join(parents, up).withColumnRenamed("parent", "parent_conv_id")
        return known.unionByName(asked)

    own = F.sha2(F.col("conv_id").cast("string"), 256)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    long = {k: F.lit(v).cast("long").alias(k) for k, v in (("n_convs", 1), ("n_leaves", 1), ("saved_tokens", 0))}
    tails = with_parent(alone).select(
        "conv_id", "depth", "parent_conv_id", long["n_convs"], F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"),
        long["n_leaves"], long["saved_tokens"], F.when(F.col("last"), own).otherwise(F.lit(EMPTY)).alias("ends_sha256"))
    exact = with_parent(nodes.join(staged(sums, "trie-sums"), digest).join(staged(ends, "trie-ends"), digest, "left")).select(
        *[F.coalesce("ends_sha256", F.lit(EMPTY)).alias(c) if c == "ends_sha256" else F.col(c) for c in names])
    out = exact.unionByName(tails)
    if not n_convs:
        return out
    total = first.sparkSession.range(1)  # the root, from sums over all
    of = [nodes.filter("depth = 1").count() + alone.filter("depth = 1").count(),
          own_leaf.count() + first.filter("total = 0").limit(1).count() * (not n), charges.agg(F.sum("saves")).first()[0] or 0]
    stop = staged(_ends(first.filter("total = 0").select(F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), "conv_id")), "trie-root").first()
    root = total.select(F.lit(root_id).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
                        *[F.lit(v).cast("long").alias(k) for k, v in zip(names[3:7], (n_convs, *of))],
                        F.lit(stop["ends_sha256"] if stop else EMPTY).alias("ends_sha256"))
    return out.unionByName(root)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(read_table(spark, sf_dir, "conversations"))


_CRC32 = """xor(4294967295::UBIGINT, list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
    lambda x: CAST(ascii(x) AS UBIGINT))), lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
    lambda s, z: xor(s >> 1, 3988292384::UBIGINT * (s & 1)))))"""

ORACLE = rf"""
WITH t AS (SELECT conv_id, text, k, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS p FROM (
    SELECT conv_id, turn, coalesce(text, '') AS text, sha256(sha256(coalesce(role, '')) || coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, CAST({_CRC32} % {HEADS} AS BIGINT) AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS own, p, text, k FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % {FAMILY} AND p <= h
  UNION ALL SELECT c.conv_id, 1, p, text, k FROM c JOIN t ON t.conv_id = c.conv_id AND p > h),
d AS (SELECT conv_id, text, row_number() OVER w AS depth, string_agg(k, '') OVER w AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, p)),
m AS (SELECT conv_id, depth, sha256(path) AS key, len(regexp_extract_all(text, '[^ 	-
]+')) AS words FROM d
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
e AS (SELECT *, lag(key) OVER w AS up, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
n AS (SELECT key, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, min(words) AS words, min(up) AS up,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM e GROUP BY key),
ch AS (SELECT up AS key, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (key)),
s AS (SELECT e.key, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.words) AS saved_tokens
  FROM e JOIN f ON f.conv_id = e.conv_id AND f.depth >= e.depth GROUP BY 1)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(f.n_convs AS BIGINT) AS n_convs, CAST(f.n_children AS BIGINT) AS n_children,
  CAST(coalesce(n_leaves, 0) AS BIGINT) AS n_leaves, CAST(coalesce(saved_tokens, 0) AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f LEFT JOIN n u ON f.up = u.key LEFT JOIN s ON s.key = f.key
"""
