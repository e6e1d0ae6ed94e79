"""SimHash near-duplicates by anchor-point covering.

Fingerprints: every text's ``SHINGLE``-word shingles (repeats included) are hashed
with XXH64 (seed 42); a bit is 1 if it is set in over half of the hashes.

Links (``MAX_BITS`` = 3 differing bits or fewer): two fingerprints at 3 bits differ by at
most one bit in one of their 32-bit halves. The anchors of a half are the words of a
covering code of radius 1: a Hamming code on bits 0-30, bit 31 free (2**27 anchors, every
half within one bit of exactly one of them). Each fingerprint is replicated to all anchors
within covering radius + threshold = 1 + 1 bits of each half (17 at most for one half), so
two fingerprints whose halves differ by one bit always meet at the first one's nearest
anchor, and anchors nobody calls nearest need no work. Fingerprints are
compared per anchor over all 64 bits; the comparison emits a spanning forest of the links
it sees, never all pairs. An anchor with over ``BLOCK`` members is dealt in blocks and every
pair of its blocks is compared in a task of its own, so no task holds more than 2 * BLOCK
fingerprints and none is left out. Only distinct fingerprints are replicated: copies never
multiply.

Components: alternating large-star and small-star rounds over the links, each round a
written table, until nothing changes.

Defined cases: null text counts as empty; a text without words has fingerprint zero and is
linked like any other; with fewer words than a shingle the whole sequence is the shingle;
documents are linked by their fingerprints, so rows that repeat an id with another text may be in another class, and
documents with a null id link like any other; a class is named by its smallest id (null if none has one). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kinds_of, read_table, staged, texts_for

SHINGLE = 3
MAX_BITS = 3
SEED = 42
BLOCK = 4096
HASH_CHUNK = 1 << 16


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of one whole text."""
    # bytes.lower() maps A-Z only; bytes.split() cuts at \x20 and \x09-\x0D, as the words are defined
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, size = b" ".join(words), min(shingle, len(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    total, ones, digest = len(words) - size + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, total, HASH_CHUNK):
        to = min(total, at + HASH_CHUNK)
        hashes = np.array([digest(line[a:b - 1], SEED) for a, b in zip(starts[at:to], ends[at + size - 1:to + size - 1])],
                          dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) and the columns ``also`` (without nulls): the fingerprint as a signed long with the same bits."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.fromiter((fingerprint_of(t, shingle) for t in b["text"]), np.uint64, len(b))
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fps.view(np.int64), **{c: b[c] for c in also}})

    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in also)
    named = texts_for(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *also), ("doc_id",))
    return kinds_of(named.mapInPandas(run, f"doc_id string, fp long{kinds}"), docs, {"doc_id": id_col})


def _syndrome_masks() -> list[int]:
    """Mask j covers the positions 1..31 (bit position - 1) whose number has bit j."""
    return [sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1) for j in range(5)]


def _anchors(half: Column) -> Column:
    """All anchors within two bits of a 32-bit half; the nearest one first.

    The syndrome names the bit to flip for the nearest codeword (0: none). Codewords two flips
    away from a non-codeword flip a pair of positions whose numbers XOR to the syndrome."""
    s = sum((F.bit_count(half.bitwiseAND(F.lit(m))).bitwiseAND(F.lit(1)) * (1 << j)
             for j, m in enumerate(_syndrome_masks())), F.lit(0))

    def flip(x: Column, p: Column) -> Column:
        return x.bitwiseXOR(F.when(p > 0, F.call_function("shiftleft", F.lit(1).cast("long"), p - 1))
                            .otherwise(F.lit(0).cast("long")))

    home = flip(half, s)
    near = F.array(home, home.bitwiseXOR(F.lit(1 << 31)))
    positions = F.array(*[F.lit(p) for p in range(1, 32)])
    pairs = F.filter(positions, lambda a: (s > 0) & (a < a.bitwiseXOR(s)))
    return F.concat(near, F.transform(pairs, lambda a: flip(flip(half, a), a.bitwiseXOR(s))))


def replicas(fps: DataFrame) -> DataFrame:
    """(part, anchor, home, fp, node) of distinct fingerprints (fp, node)."""
    # a small table of many replicas each: as many tasks as shuffles have, not as few as the files
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    halves = F.array(F.struct(F.lit(0).alias("part"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("half")),
                     F.struct(F.lit(1).alias("part"), F.shiftrightunsigned("fp", 32).alias("half")))
    cut = fps.select("fp", "node", F.explode(halves).alias("h")).select("fp", "node", "h.part", "h.half")
    dealt = cut.select("fp", "node", "part", F.posexplode(_anchors(F.col("half"))).alias("k", "anchor"))
    return dealt.select("part", "anchor", (F.col("k") == 0).alias("home"), "fp", "node")


def _forest(fps: np.ndarray, nodes: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges (node, root) of a spanning forest of the links among the members.

    Breadth first: a member looks for links only among members not yet reached, so a dense
    group costs little more than its size. The root of a tree is its smallest node."""
    out = []
    order = np.argsort(nodes, kind="stable")
    fps, nodes = fps[order], nodes[order]
    left = np.arange(len(fps))
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = [root]
        while front and len(left):
            near = np.bitwise_count(fps[left] ^ fps[front.pop()]) <= max_bits
            found = left[near]
            left = left[~near]
            front.extend(found.tolist())
            out.extend((int(nodes[x]), int(nodes[root])) for x in found)
    return out


def links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Distinct edges (a, b), a > b, that span every component of the link graph of (fp, node)."""
    if max_bits > 3:
        raise ValueError("the two covering codes of radius 1 find links of at most 3 bits")
    reps = replicas(fps)
    # anchors that are somebody's nearest and have two members at least; counts combine before the shuffle
    busy = (reps.groupBy("part", "anchor").agg(F.count(F.lit(1)).alias("m"), F.max("home").alias("any_home"))
            .filter("m > 1 AND any_home").select("part", "anchor", F.ceil(F.col("m") / block).cast("int").alias("k")))
    # a written table is exchanged for the join alone, so that AQE can split a hot anchor's partition
    met = reps.join(staged(busy, "simhash-anchors"), ["part", "anchor"])
    mine = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    to = F.transform(F.sequence(F.lit(0), F.col("k") - 1),
                     lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j")))
    tasks = met.select("part", "anchor", "fp", "node", F.explode(to).alias("t"))
    groups = (tasks.groupBy("part", "anchor", "t")
              .agg(F.collect_list(F.struct("fp", "node")).alias("members")).filter(F.size("members") > 1)
              .select(F.col("members.fp").alias("fps"), F.col("members.node").alias("nodes")))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            edges: set[tuple[int, int]] = set()
            for f, n in zip(b["fps"], b["nodes"]):
                if len(f) == 2:
                    if n[0] != n[1] and ((int(f[0]) ^ int(f[1])) & 0xFFFFFFFFFFFFFFFF).bit_count() <= max_bits:
                        edges.add((int(max(n)), int(min(n))))
                else:
                    edges.update(_forest(np.asarray(f).view(np.uint64), np.asarray(n), max_bits))
            yield pd.DataFrame(sorted(edges), columns=["a", "b"], dtype="int64")

    return groups.mapInPandas(compare, "a long, b long").filter("a <> b").distinct()


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One large-star or small-star round over edges (a, b), a > b."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("lo")).withColumn("lo", F.least("a", "lo"))
    least = staged(least, "simhash-least")  # so that AQE can split the neighbours of a hot node
    met = both.join(least, "a")
    if small:  # neighbours below a, and a itself, go to the least of them
        out = met.select(F.col("b").alias("a"), F.col("lo").alias("b")).unionByName(
            least.select("a", F.col("lo").alias("b")))
    else:  # neighbours above a go to the least of all
        out = met.filter("b > a").select(F.col("b").alias("a"), F.col("lo").alias("b"))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with a link."""
    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = staged(edges, "simhash-links")
    seen = mark(now)
    while seen[0]:
        now = staged(_star(_star(now, small=False), small=True), "simhash-star")
        was, seen = seen, mark(now)
        if was == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                 max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    thin = staged(fingerprints(docs, id_col, text_col, shingle), "simhash-fingerprints")
    # nodes are fingerprints, whatever ids their documents have
    fps = staged(thin.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.col("fp")), "simhash-distinct")
    joined = components(links(fps, max_bits, block))
    classes = staged(fps.join(joined, "node", "left").select("fp", "least", F.coalesce("component", "fp").alias("class")), "simhash-members")
    least = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    # one row per fingerprint on the right, written; AQE can split a hot fingerprint on the left
    named = staged(classes.join(staged(least, "simhash-least-ids"), "class").select("fp", "component_id"), "simhash-classes")
    return thin.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents, all columns, one of each class: the one with the smallest id (null ids last), then the smallest
    fingerprint, then the smallest hash of its text. Ids may be null or name several texts: classes are made of
    fingerprints, and a document is known by its id and its text's hash."""
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    thin = staged(fingerprints(named, "id", "text", shingle, ("h",)), "simhash-fingerprints")
    fps = staged(thin.select("fp").distinct().withColumn("node", F.col("fp")), "simhash-distinct")
    joined = components(links(fps, max_bits, block=BLOCK))
    classes = staged(fps.join(joined, "node", "left").select("fp", F.coalesce("component", "fp").alias("class")), "simhash-classes")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "h").alias("row")
    rows = thin.join(classes, "fp").select("class", row)
    first = rows.groupBy("class", "row").agg(F.count(F.lit(1)).alias("n")).groupBy("class").agg(
        F.min(F.struct("row", "n")).alias("first"), F.sum("n").alias("size")).filter("size > 1")
    first = staged(first.select("class", F.col("first.row").alias("stays"), F.col("first.n").alias("n")), "simhash-first")
    gone = rows.join(first, "class").filter("row <> stays").select(
        F.col("row.doc_id").alias("__gone"), F.col("row.h").alias("__of")).distinct()
    gone = staged(gone, "simhash-gone")  # its written size lets the planner choose a broadcast or a shuffle
    same = F.col(id_col).eqNullSafe(F.col("__gone")) & (F.col("__h") == F.col("__of"))
    left = docs.withColumn("__h", F.xxhash64(text_col)).join(gone, same, "left_anti")
    repeated = first.filter("n > 1").select(F.col("stays.doc_id").alias("__gone"), F.col("stays.h").alias("__of"))
    if repeated.limit(1).count():
        once = left.join(repeated, same, "left_semi").dropDuplicates([id_col, "__h"])
        left = left.join(repeated, same, "left_anti").unionByName(once)
    return left.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(read_table(spark, sf_dir, "documents"))
