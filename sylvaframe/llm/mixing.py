"""Mixing sources to target weights by soft membership, in Spark expressions only.

A classifier learned from a labelled table gives each document posteriors over domains (toxic, low and high quality).
Document rates r >= 0 minimise sum_d (sum_i r_i t_i p_id - b_d)^2, with tokens t, posteriors p and targets b, and among
rates that do, lie nearest to 1: r_i = max(0, 1 - sum_d p_id m_d). The three numbers m follow by gradient steps, scaled by
the curvature of the documents whose rate isn't 0 and projected on r >= 0; a step is one aggregation over all documents.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvaframe.llm.common import materialise

DOMAINS = ("toxic", "low", "high")
#: Parts of the mixture's tokens.
WEIGHTS = (0.005, 0.145, 0.85)
#: About as many labelled documents are learned from, at most.
FIT_ROWS = 20_000
#: Words that the classifier knows of each domain, at most.
FEATURES = 400
#: A word counts if its presence differs by so many standard errors.
SURE = 6.0
#: ... and if it is so many times as frequent in one domain: words of a language mustn't add up to a verdict.
LIFT = 4.0
#: The mixture has so many times the tokens that let the larger domains keep all of theirs, so that clean documents' rates don't fall below 1.
SPARE = 1.01
#: Steps end when every domain is so near to its target, as a part of all tokens ...
NEAR = 1e-6
#: ... or when a step is cut to so small a part without gain: then no rates are nearer.
LEAST_STEP = 1e-3


def _words(text: Column) -> Column:
    """Hashes of a text's words in lower case; marks after a word are words too."""
    return F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), "\\s+|(?<=\\p{L})(?=[^\\p{L}\\s])"), lambda w: F.xxhash64(w))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, features: int = FEATURES) -> tuple[list[float], list[tuple[int, float, float]]]:
    """Log ratios without any known word, and what each known word adds, against the last domain (Bernoulli naive Bayes). Without labels: none.

    Domains of a label row: toxic = 1 is toxic; else quality 0 is low and 1 high. Rows with null ids or labels are left
    out. Words are the surest `features` of each domain; those that mark a language aren't frequent enough in one
    domain to count.
    """
    named = labels.where("doc_id IS NOT NULL AND (toxic = 1 OR quality IS NOT NULL)").selectExpr("doc_id", "CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END AS d").distinct()
    n = named.count()
    part = min(1.0, fit_rows / max(1, n))
    some = named.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < part * 1_000_003)
    mine = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "d", _words(F.col("text")).alias("w"))
    # Copies would pass for evidence: of documents that share their least hash of five words, that with the smallest id counts.
    five = F.transform("w", lambda x, i: F.xxhash64(x, *[F.get(F.col("w"), i + j) for j in range(1, 5)]))
    one = mine.withColumn("sketch", F.array_min(five)).groupBy("sketch").agg(F.min(F.struct("doc_id", "d", F.array_distinct("w").alias("w"))).alias("x"))
    mine = materialise(one.select("x.d", "x.w"))
    rows = {r["d"]: r["n"] for r in mine.groupBy("d").agg(F.count("*").alias("n")).collect()}
    r = [rows.get(d, 0) for d in range(3)]
    prior = [math.log((x + 1) / (r[2] + 1)) for x in r[:2]]
    counts = mine.select("d", F.explode("w").alias("w")).groupBy("w").agg(*[F.count(F.when(F.col("d") == d, 1)).alias(f"c{d}") for d in range(3)])
    out: dict[int, list[float]] = {}
    for d in range(2):
        p, q = (F.col(f"c{d}") + 0.5) / (r[d] + 1), (F.col("c2") + 0.5) / (r[2] + 1)
        mean = (F.col(f"c{d}") + F.col("c2") + 1) / (r[d] + r[2] + 2)
        error = F.sqrt(mean * (1 - mean) * (1 / (r[d] + 1) + 1 / (r[2] + 1)))
        told = counts.select("w", (F.abs(p - q) / error).alias("z"), F.log(p / q).alias("l"), F.log((1 - p) / (1 - q)).alias("none")).where((F.col("z") > SURE) & (F.abs("l") > math.log(LIFT)))
        for row in told.orderBy(F.col("z").desc(), "w").limit(features).collect():
            out.setdefault(row["w"], [0.0, 0.0])[d] = round(row["l"] - row["none"], 4)
            prior[d] += row["none"]
    return prior, [(w, *x) for w, x in sorted(out.items())]


def posteriors(docs: DataFrame, model: tuple[list[float], list[tuple[int, float, float]]], keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the other columns of keep, n_tokens (words) and p_toxic, p_low, p_high, which sum to 1. Each word counts once; null text has the prior."""
    prior, told = model
    known, first, second = (F.from_json(F.lit(json.dumps([t[i] for t in told])), f"array<{kind}>") for i, kind in enumerate(("bigint", "double", "double")))
    ids = ["doc_id", *(c for c in keep if c != "doc_id")]
    own = docs.select(*ids, _words(F.col("text")).alias("w"))
    own = own.select(*ids, F.size("w").cast("long").alias("n_tokens"), F.transform(F.array_intersect(known, F.col("w")), lambda w: F.array_position(known, w).cast("int") - 1).alias("w"))

    def total(start: float, table: Column) -> Column:
        return F.exp(F.greatest(F.least(F.aggregate("w", F.lit(float(start)), lambda a, w: a + F.get(table, w)), F.lit(40.0)), F.lit(-40.0)))

    own = own.withColumn("e0", total(prior[0], first)).withColumn("e1", total(prior[1], second))
    whole = F.col("e0") + F.col("e1") + 1
    return own.select(*ids, "n_tokens", (F.col("e0") / whole).alias("p_toxic"), (F.col("e1") / whole).alias("p_low"), (1 / whole).alias("p_high"))


def rate(m: list[float]) -> Column:
    """The rate of a document for the three numbers m."""
    moved = sum((F.col(f"p_{d}") * float(x) for d, x in zip(DOMAINS, m, strict=True)), F.lit(0.0))
    return F.greatest(F.lit(0.0), 1 - moved)


def fit_rates(known: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float | None = None) -> tuple[list[float], float]:
    """The numbers m whose rates' expected tokens by domain are weights * total, and the largest miss as a part of total.

    total: of tokens; by default as many as let every domain with a weight of a tenth or more keep all its tokens. The miss
    is over NEAR only where no rates match: where posteriors don't tell the domains apart, or a domain has no tokens.
    """
    p = [F.col(f"p_{d}") for d in DOMAINS]
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]

    def sums(m: list[float]) -> tuple[np.ndarray, np.ndarray]:
        r, t = rate(m), F.col("n_tokens")
        live = F.when(r > 0, t).otherwise(0)
        row = known.agg(*[F.sum(r * t * x) for x in p], *[F.sum(live * p[i] * p[j]) for i, j in pairs]).first()
        row = [float(x or 0.0) for x in row]
        curve = np.zeros((3, 3))
        for (i, j), x in zip(pairs, row[3:], strict=True):
            curve[i, j] = curve[j, i] = x
        return np.array(row[:3]), curve

    m = np.zeros(3)
    now, curve = sums(m.tolist())
    if not now.sum():
        return m.tolist(), 0.0
    total = total or SPARE * max(float(s) / w for s, w in zip(now, weights, strict=True) if w >= 0.1) or float(now.sum())
    target = np.array(weights) * total
    miss = float(np.abs(now - target).max()) / total
    part = 1.0
    while miss > NEAR and part >= LEAST_STEP:
        step = np.linalg.lstsq(curve, now - target, rcond=1e-12)[0]
        tried, bent = sums((m + part * step).tolist())
        if np.square(tried - target).sum() < np.square(now - target).sum() * (1 - 1e-6):
            m, now, curve, part = m + part * step, tried, bent, min(1.0, 2 * part)
            miss = float(np.abs(now - target).max()) / total
        else:
            part /= 2
    return m.tolist(), miss


def mix_sources(docs: DataFrame, labels: DataFrame, weights: tuple[float, ...] = WEIGHTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, the other columns of keep, n_tokens, p_toxic, p_low, p_high, rate (of copies in the mixture), copies, miss.

    miss: how far the expected tokens are from the targets, as a part of the mixture; the same for all rows (see fit_rates).

    copies: rate rounded down or up by a hash of doc_id, so that it is the rate on average; null doc_id has the hash's
    value for null. Null or empty text has few tokens and the prior's posteriors. Repeated rows count as often as they
    stand. Without labels all posteriors are a third. Empty table: no rows.
    """
    known = materialise(posteriors(docs, fit(docs, labels), keep))
    u = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1_000_003)) / 1_000_003.0
    m, miss = fit_rates(known, weights)
    out = known.withColumn("rate", rate(m))
    return out.withColumn("copies", F.floor(F.col("rate") + u).cast("long")).withColumn("miss", F.lit(miss))
