"""Mixing sources to target weights: temperature, bisection, budgeted block permutations.

Weights: source s with t_s tokens weighs t_s ** x / sum(t ** x). The exponent x in [0, 1] is
bisected to the smallest one whose weights meet both demands (x = 1 keeps the natural shares,
x = 0 makes all sources equal): an entropy of at most ``target_entropy`` times the largest possible one, and a
largest repetition of at most ``max_repeats``. Each round evaluates fifteen exponents (four bisection
steps) in one small aggregate over the written table of sources.

Budget: weights are realised over a budget of tokens. By default it is the smallest one with which every
source is used whole at least once, so mixing repeats the small sources and drops no document;
a given ``budget`` may take only part of a source.

Realisation: a source's budget is a number of whole passes and a rest. Every pass is its
own permutation of the documents (by hash of seed, pass and id). The rest takes documents
of one more permutation in order until the budget would be exceeded: token sums per block of
about ``BLOCK_ROWS`` documents find the block where that happens (prefix sums in two levels), and only that
block's documents are summed one by one. So no task sees a whole source, and texts are never
shuffled: each document learns its number of copies from its source's row. A copy's ``position``
in [0, 1) is its place in its source's sequence of permutations; ``block`` cuts positions into
equal training blocks, each of which holds every source by its weight.

Defined cases: null text has no tokens; a null source is a source of its own; a source without
tokens has weight 0 and its documents are used once; rows that repeat an id are taken or left together;
an empty table gives an empty result; extra columns pass through ``mix`` (if one is called copy, position or block, the
new column's name ends in ``_of_mix``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import WORD, hashed_fraction, read_table, staged

TARGET_ENTROPY = 0.97  # of the largest possible entropy, ln(number of sources)
MAX_REPEATS = 2.0
BLOCK_ROWS = 1024
SUPER_BLOCKS = 4096
TRAIN_BLOCK_TOKENS = 1 << 18
ROUNDS, MIDPOINTS = 8, 15  # 16 ** 8 = 2 ** 32
SEED = 17


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_tokens(thin: DataFrame) -> DataFrame:
    """(source, tokens, docs) of rows (doc_id, source, tokens)."""
    return thin.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))


def exponent(sources: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS) -> float:
    """The smallest x in [0, 1] whose weights have at most the target entropy and the repetition limit."""
    used = sources.filter("tokens > 0")
    least, most, n = used.agg(F.min("tokens"), F.max("tokens"), F.count(F.lit(1))).first()
    if not n or least == most:
        return 1.0
    lo, hi = 0.0, 1.0
    share = F.col("tokens") / F.lit(float(most))
    for _ in range(ROUNDS):
        xs = [lo + (hi - lo) * k / (MIDPOINTS + 1) for k in range(1, MIDPOINTS + 1)]
        row = used.agg(*[a for x in xs for a in (F.sum(F.pow(share, F.lit(x))),
                                                 F.sum(F.pow(share, F.lit(x)) * F.log(share)))]).first()
        good = []
        for k, x in enumerate(xs):
            z, zl = row[2 * k], row[2 * k + 1]
            entropy = math.log(z) - x * zl / z
            good.append(entropy <= target_entropy * math.log(n) and (most / least) ** (1 - x) <= max_repeats)
        # both demands hold from some exponent on: entropy and repetition fall as x grows
        first = good.index(True) if True in good else len(xs)
        lo, hi = ([lo, *xs][first], [*xs, hi][first])
    return hi


def plan(thin: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS,
         budget: float | None = None, seed: int = SEED) -> DataFrame:
    """Per source: source, docs, tokens, weight, repeats (budget / tokens), passes (whole ones) and cut: documents whose
    place in permutation number ``passes`` is below it are taken once more."""
    sources = staged(source_tokens(thin), "mix-sources")
    x = exponent(sources, target_entropy, max_repeats)
    z, most = sources.filter("tokens > 0").agg(
        F.sum(F.pow(F.col("tokens").cast("double"), F.lit(x))), F.max("tokens")).first()
    z, most = z or 1.0, most or 1
    whole = budget is None
    total = z * float(most) ** (1 - x) if whole else float(budget)
    part = F.pow(F.col("tokens").cast("double"), F.lit(x)) / F.lit(z)
    weighed = sources.select(
        "source", "docs", "tokens", F.when(F.col("tokens") > 0, part).otherwise(F.lit(0.0)).alias("weight"))
    weighed = weighed.withColumn("repeats", F.when(F.col("tokens") == 0, F.lit(1.0)).otherwise(
        # the largest source is used exactly once; rounding must not turn that into 0.999...
        F.greatest(F.lit(1.0 if whole else 0.0), F.col("weight") * F.lit(total) / F.col("tokens"))))
    weighed = weighed.select("*", F.floor("repeats").alias("passes"),
                             ((F.col("repeats") - F.floor("repeats")) * F.col("tokens")).alias("rest"),
                             F.ceil(F.col("docs") / BLOCK_ROWS).alias("blocks"))

    # the rest of the budget: the first documents of permutation number `passes`
    side = weighed.filter("rest > 0").select(F.col("source").alias("__s"), "passes", "rest", "blocks")
    placed = thin.join(side, F.col("source").eqNullSafe(F.col("__s")))
    placed = placed.select("source", "tokens", "rest", "blocks", place(F.col("doc_id"), F.col("passes"), seed).alias("u"))
    placed = placed.withColumn("b", F.floor(F.col("u") * F.col("blocks")))
    sums = staged(placed.groupBy("source", "b").agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest")), "mix-blocks")
    sums = sums.withColumn("sb", F.floor(F.col("b") / SUPER_BLOCKS))
    tops = sums.groupBy("source", "sb").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("source").orderBy("sb").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(F.col("source").alias("__s"), F.col("sb").alias("__sb"),
                       F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("top"))
    inner = Window.partitionBy("source", "sb").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("low", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    sums = sums.join(tops, F.col("source").eqNullSafe(F.col("__s")) & (F.col("sb") == F.col("__sb")))
    before = F.col("low") + F.col("top")
    edge = staged(sums.filter((before <= F.col("rest")) & (before + F.col("n") > F.col("rest"))).select(
        F.col("source").alias("__s"), F.col("b").alias("__b"), before.alias("before")), "mix-edges")  # one per source
    in_edge = placed.join(edge, F.col("source").eqNullSafe(F.col("__s")) & (F.col("b") == F.col("__b")))
    along = Window.partitionBy("source", "b").orderBy("u")  # a range frame: equal places are taken together
    over = in_edge.withColumn("n", F.col("before") + F.sum("tokens").over(along)).filter("n > rest")
    cuts = over.groupBy("source").agg(F.min("u").alias("cut")).select(F.col("source").alias("__s"), "cut")
    out = weighed.join(cuts, F.col("source").eqNullSafe(F.col("__s")), "left")
    # no document exceeds the rest: all fit, or there is no rest
    cut = F.coalesce("cut", F.when(F.col("rest") > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return out.select("source", "docs", "tokens", "weight", "repeats", "passes", cut.alias("cut"))


def place(doc_id: Column, number: Column, seed: int = SEED) -> Column:
    """A document's place in [0, 1) in permutation ``number``."""
    return hashed_fraction(F.lit(seed), number.cast("long"), doc_id)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, budget: float | None = None,
        seed: int = SEED, names: tuple[str, str, str] = ("copy", "position", "block")) -> DataFrame:
    """The documents, all columns, once per copy, with the copy's number, its position in [0, 1) in
    the training order and its block."""
    thin = staged(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                              n_tokens(F.col(text_col)).alias("tokens")), "mix-tokens")
    sources = staged(plan(thin, target_entropy, max_repeats, budget, seed), "mix-plan")
    total = sources.agg(F.sum(F.col("repeats") * F.col("tokens"))).first()[0] or 0.0
    blocks = max(1, math.ceil(total / TRAIN_BLOCK_TOKENS))
    side = sources.select(F.col("source").alias("__source"), F.col("passes").alias("__passes"),
                          F.col("cut").alias("__cut"))
    met = docs.join(side, F.col(source_col).eqNullSafe(F.col("__source")))
    copies = F.col("__passes") + F.when(place(F.col(id_col), F.col("__passes"), seed) < F.col("__cut"), 1).otherwise(0)
    met = met.withColumn("__copies", copies.cast("int")).filter("__copies > 0")
    met = met.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
    position = ((F.col("__copy") + place(F.col(id_col), F.col("__copy"), seed))
                / F.greatest(F.lit(1e-9), F.col("__passes") + F.col("__cut")))
    met = met.withColumn("__position", F.least(position, F.lit(1 - 2.0 ** -53)))
    taken = set(docs.columns)
    copy, pos, block = (n if n not in taken else f"{n}_of_mix" for n in names)
    return met.select(*docs.columns, F.col("__copy").alias(copy), F.col("__position").alias(pos),
                      F.floor(F.col("__position") * blocks).alias(block))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per copy: doc_id, source, n_tokens, copy, position, block."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mix(docs)
    return out.select("doc_id", "source", n_tokens(F.col("text")).alias("n_tokens"), "copy", "position", "block")
