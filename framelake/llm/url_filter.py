"""URL filter: rules per host and path, and link-graph propagation for hosts without a rule.

Rules name a host (with all its subdomains) and a path prefix; the longest fitting rule decides. For
pages that no rule fits, their host is judged by the link graph: hosts mostly blocked by rules are
distrust seeds, other hosts with pages allowed by rules are trust seeds. Trust flows along
links (personalised PageRank from the trust seeds), distrust against them (from the blocked
seeds to hosts that link to them). Scores are in units of one seed; a host is blocked if its
distrust exceeds its trust by ``THRESHOLD``.

Links are hrefs with a host of their own; they are counted per host pair before any shuffle, so the
graph has one edge for a pair however many pages carry it. Each round joins scores to the edges and sums them per
host, and is written as a table; hosts are never collected. Without edges there are no rounds. Round k adds the
walks of k links. Rounds go on until all later ones together can move no host by more than ``TOLERANCE`` of a seed, however many
hosts there are. What a round moves falls to ``DAMPING`` of the round before, so they end: after about 75 rounds for one
seed, and 14 more for each ten times as many.

Defined cases: null urls, or urls without ``://``, have empty host and path, no rule, and the verdict of host ''
(never a seed, never linked: allow); null html has no links; repeated rows are judged each; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, read_table, staged

# Fixed values: (verdict, host, path prefix).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DAMPING = 0.85
TOLERANCE = 1e-4  # of a seed: what all rounds left out may move
THRESHOLD = 0.05
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # longer ones wrap shorter ones
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts, counted over all pages."""
    targets = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), F.lit(1))
    pairs = pages.select(host_and_path(F.col(url_col))[0].alias("src"), F.explode(targets).alias("dst"))
    pairs = pairs.select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    return pairs.filter("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int | None = None,
              tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trust_seed, distrust_seed) over edges (src, dst, n). ``rounds`` asks for the walks of so
    many links at most; else the tolerance alone ends them."""
    edges = staged(edges, "url-edges")
    ends = edges.select(F.col("src").alias("host")).union(edges.select("dst")).distinct()
    nodes = staged(ends.join(seeds, "host", "full").na.fill(0.0, ["trust_seed", "distrust_seed"]), "url-nodes")
    if not edges.limit(1).count():
        return nodes.select("host", F.col("trust_seed").alias("trust"), F.col("distrust_seed").alias("distrust"))
    # seeds start the walk with weight 1 - damping
    scores = nodes.select("host", *[((1 - damping) * F.col(f"{k}_seed")).alias(k) for k in ("trust", "distrust")])
    by_src = edges.groupBy("src").agg(F.sum("n").alias("out"))
    by_dst = edges.groupBy("dst").agg(F.sum("n").alias("into"))
    shares = staged(edges.join(by_src, "src").join(by_dst, "dst").select(
        "src", "dst", (F.col("n") / F.col("out")).alias("forth"), (F.col("n") / F.col("into")).alias("back")), "url-shares")
    for _ in count() if rounds is None else range(rounds):
        forth = shares.join(scores, F.col("src") == F.col("host")).select(
            F.col("dst").alias("host"), (F.col("trust") * F.col("forth")).alias("t"), F.lit(0.0).alias("d"))
        back = shares.join(scores, F.col("dst") == F.col("host")).select(
            F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("distrust") * F.col("back")).alias("d"))
        got = forth.unionByName(back).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        was = scores.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0"))
        step = nodes.join(got, "host", "left").join(was, "host", "left").na.fill(0.0, ["t", "d"])
        mixed = {k: (1 - damping) * F.col(f"{k}_seed") + damping * F.col(k[0]) for k in ("trust", "distrust")}
        now = staged(step.select("host", *[c.alias(k) for k, c in mixed.items()], (
            F.abs(mixed["trust"] - F.col("t0")) + F.abs(mixed["distrust"] - F.col("d0"))).alias("moved")), "url-scores")
        moved = now.agg(F.sum("moved")).first()[0]
        scores = now.drop("moved")
        # a round moves at most damping times the sum of the round before, and all of it may meet in one host
        if moved * damping / (1 - damping) <= tolerance * (1 - damping):
            break
    # in units of one seed
    return scores.select("host", *[(F.col(k) / (1 - damping)).alias(k) for k in ("trust", "distrust")])


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES,
          threshold: float = THRESHOLD) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    host, path = host_and_path(F.col(url_col))
    thin = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    name, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    thin = staged(thin.select("*", name.alias("rule"), verdict.alias("ruled")), "url-pages")
    hosts = thin.filter("host <> ''").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("ruled") == "block", 1).otherwise(0)).alias("b"),
        F.sum(F.when(F.col("ruled") == "allow", 1).otherwise(0)).alias("a"))
    bad = F.expr("2 * b > n")
    seeds = hosts.select("host", F.when(~bad & (F.col("a") > 0), 1.0).otherwise(0.0).alias("trust_seed"),
                         F.when(bad, 1.0).otherwise(0.0).alias("distrust_seed"))
    scores = propagate(seeds, host_edges(pages, url_col, html_col))
    blocked = scores.filter(F.col("distrust") - F.col("trust") > threshold).select(F.col("host").alias("__host"))
    judged = thin.join(blocked, F.col("host") == F.col("__host"), "left")
    by_host = F.when(F.col("__host").isNotNull(), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"))
