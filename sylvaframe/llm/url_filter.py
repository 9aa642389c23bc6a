"""URL filters: rules, and for the rest personalised PageRank over the graph of hosts, in Spark expressions only.

Trust flows from hosts with allowed pages along links; distrust flows from hosts with blocked pages against them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvaframe.llm.common import materialise

#: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING = 0.85
#: Rounds end when the scores move less than this in all, which they do: each moves them by DAMPING of the last at most.
SETTLED = 1e-6
#: A host is blocked if its distrust is over this part of the mean seed's and over its trust.
THRESHOLD = 0.2
SALTS = 16
_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path by the contract: after the first `://`; A-Z of the host lower-cased; null or no `://`: both empty."""
    known = F.coalesce(F.locate("://", url) > 0, F.lit(False))
    rest = F.regexp_extract(url, "(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1), *_AZ)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(known, host).otherwise(""), F.when(known, path).otherwise("")


def best_rule(host: Column, path: Column, rules) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null."""
    out = None
    for verdict, of, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        hit = F.struct(F.lit(of + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out


def host_edges(judged: DataFrame) -> DataFrame:
    """(src, dst, w): links from pages of one host to other hosts, counted, as parts of the host's links."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit("(?i)<a\\b[^>]*?\\bhref\\s*=\\s*[\"']?\\s*(?:https?:)?//([^/?#\"'\\s>]+)"), F.lit(1))
    pairs = judged.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.transform(links, lambda x: F.translate(x, *_AZ))).alias("dst")).where("src <> dst")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(hosts: DataFrame, edges: DataFrame, seed: str, forward: bool) -> DataFrame:
    """(host, score): personalised PageRank from the column `seed` of hosts, which sums to 1 unless all are 0."""
    out = ("src", "dst") if forward else ("dst", "src")
    total = edges.groupBy(out[0]).agg(F.sum("n").alias("all"))
    step = materialise(edges.join(total, out[0]).select(F.col(out[0]).alias("a"), F.col(out[1]).alias("b"), (F.col("n") / F.col("all")).alias("w")))
    base = hosts.select("host", F.col(seed).alias("seed"))
    score = materialise(base.withColumn("score", F.col("seed")))
    if not step.limit(1).count():
        return score.select("host", "score")
    while True:
        came = step.join(score.select(F.col("host").alias("a"), "score"), "a").groupBy(F.col("b").alias("host")).agg(F.sum(F.col("w") * F.col("score")).alias("came"))
        new = score.join(came, "host", "left").select("host", "seed", ((1 - DAMPING) * F.col("seed") + DAMPING * F.coalesce("came", F.lit(0.0))).alias("new"), "score")
        new = materialise(new.select("host", "seed", F.col("new").alias("score"), F.abs(F.col("new") - F.col("score")).alias("moved")))
        moved = new.agg(F.sum("moved")).first()[0] or 0.0
        score = new.drop("moved")
        if moved < SETTLED:
            break
    return score.select("host", "score")


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict, trust, distrust.

    The longest rule that fits decides. Else the host's scores do: block if distrust is over THRESHOLD of the mean over
    blocked seeds and over trust; hosts that no score reaches, and urls without host, are allowed. A host's seeds are the
    parts of its pages that rules allow and block. Null html has no links. Rows are judged alone but for the graph, to
    which repeated rows add their links again. Empty table: no rows.
    """
    host, path = host_path(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    hit = best_rule(F.col("host"), F.col("path"), rules)
    judged = judged.withColumn("hit", hit)
    edges = materialise(host_edges(judged))
    per = judged.where("host <> ''").groupBy("host").agg(F.avg(F.coalesce(F.expr("cast(hit.verdict = 'allow' AS double)"), F.lit(0.0))).alias("good"), F.avg(F.coalesce(F.expr("cast(hit.verdict = 'block' AS double)"), F.lit(0.0))).alias("bad"))
    linked = edges.select(F.explode(F.array("src", "dst")).alias("host"), F.lit(0.0).alias("good"), F.lit(0.0).alias("bad"))
    hosts = materialise(per.union(linked).groupBy("host").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))
    sums = hosts.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.count(F.expr("CASE WHEN bad > 0 THEN 1 END")).alias("n")).first()
    scaled = hosts.select("host", (F.col("good") / (sums["good"] or 1.0)).alias("good"), (F.col("bad") / (sums["bad"] or 1.0)).alias("bad"))
    trust = propagate(scaled, edges, "good", True).withColumnRenamed("score", "trust")
    distrust = propagate(scaled, edges, "bad", False).withColumnRenamed("score", "distrust")
    # Held against what a blocked seed has of itself, in the mean.
    least = THRESHOLD * (1 - DAMPING) / (sums["n"] or 1)
    scores = trust.join(distrust, "host").select("host", "trust", "distrust", F.when((F.col("distrust") > least) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow").alias("by_graph"))
    # A host can hold a third of the pages: its scores are laid out SALTS times and its pages dealt among them.
    salted = scores.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = judged.select("page_id", "host", "path", "hit", F.pmod(F.hash("page_id", "path"), F.lit(SALTS)).alias("salt"))
    both = own.join(salted, ["host", "salt"], "left")
    return both.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", "by_graph", F.lit("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
