"""Reciprocal-rank fusion and multi-signal rescoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragspark.functions import numbers as N

RRF_K = 60


def rrf(rankings: DataFrame, key: str = "key", identity: str | None = None, k: int = RRF_K) -> DataFrame:
    """``rankings``: a row per item with ranking (number of its list), position (in the list) and payload columns.

    Within a list the first row of a key stays and ranks count the rows that stay; across lists the scores of an
    identity add up, and the payload is that of the last list (its first row there). Columns: identity, rrf_score,
    first_ranking and first_rank (for ties, which go to the first seen), and payload, a struct of the input row."""
    identity = identity or key
    columns = [F.col(f"`{c}`") for c in rankings.columns]
    row = F.struct(*columns).alias("payload")
    once = rankings.withColumn("_n", F.row_number().over(Window.partitionBy("ranking", key).orderBy("position"))).where("_n = 1")
    ranked = once.withColumn("_rank", F.row_number().over(Window.partitionBy("ranking").orderBy("position")))
    out = ranked.groupBy(F.col(identity).alias("identity")).agg(
        F.sum(1.0 / (k + F.col("_rank"))).alias("rrf_score"),
        F.min(F.struct(F.col("ranking"), F.col("_rank"))).alias("first"),
        F.max_by(row, F.struct(F.col("ranking"), -F.col("_rank"))).alias("payload"),
    )
    return out.select("identity", "rrf_score", F.col("first.ranking").alias("first_ranking"), F.col("first._rank").alias("first_rank"), "payload")


def spread(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with low_x and high_x of each named column, by one aggregate of a single row."""
    ends = df.agg(*[f(n).alias(f"{p}_{n}") for n in names for p, f in (("low", F.min), ("high", F.max))])
    return df.crossJoin(F.broadcast(ends))


def scaled(name: str) -> Column:
    return N.min_max(F.col(name), F.col(f"low_{name}"), F.col(f"high_{name}"))


def rescore(items: DataFrame, weights: dict[str, float], signals: list[str], anchor: str = "rrf_score", digits: int = 6) -> DataFrame:
    """``items`` with combined_score: the anchor's weight (``rrfAnchor``) times its min-max, plus each signal times
    its weight (0 without one). The signals are used as they are."""
    df = spread(items, anchor)
    total = F.lit(weights.get("rrfAnchor", 0.0)) * scaled(anchor)
    for s in signals:
        total = total + F.lit(weights.get(s, 0.0)) * F.col(s)
    return df.withColumn("combined_score", F.round(total, digits)).drop(f"low_{anchor}", f"high_{anchor}")


def recency_signal(items: DataFrame, days: Column, half_life: float, name: str = "recency") -> DataFrame:
    """Min-max of exp(-days / half_life); 0 where the age is unknown."""
    df = items.withColumn(name, F.coalesce(N.decay(days, half_life), F.lit(0.0)))
    return spread(df, name).withColumn(name, scaled(name)).drop(f"low_{name}", f"high_{name}")


def log_signal(items: DataFrame, value: Column, name: str) -> DataFrame:
    """Min-max of ln(1 + value)."""
    df = items.withColumn(name, N.log_points(F.coalesce(value, F.lit(0))))
    return spread(df, name).withColumn(name, scaled(name)).drop(f"low_{name}", f"high_{name}")


def web_signals(items: DataFrame, as_of: str, age: str = "age", links: str = "deep_links") -> DataFrame:
    return recency_signal(items, N.age_days(F.col(age), as_of), 7).withColumn("hasDeepLinks", (F.coalesce(F.size(links), F.lit(0)) > 0).cast("double"))


def academic_signals(items: DataFrame, year_now: int, year: str = "year", cites: str = "citations", venue: str = "venue") -> DataFrame:
    age = 365.0 * F.coalesce(F.lit(year_now) - F.col(year), F.lit(10))
    df = recency_signal(items, age, 1095)
    cites_col = F.col(cites)
    df = log_signal(df.withColumn("_cites", cites_col), F.col("_cites"), "citation_signal").drop("_cites")
    return df.withColumn("venue_signal", (F.coalesce(F.length(venue), F.lit(0)) > 0).cast("double"))


def discussion_signals(items: DataFrame, as_of: str, sort: str, created: str, points: str, comments: str) -> DataFrame:
    """Recency unless sorted by date, points unless sorted by top, comments always. Computed on the merged list."""
    df = items
    if sort != "date":
        days = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col(created).cast("timestamp"))) / 86_400_000_000
        df = recency_signal(df, days, 180)
    if sort != "top":
        df = log_signal(df, F.col(points), "engagement")
    return log_signal(df, F.col(comments), "commentEngagement")


def name_score(name: Column, downloads: Column, query: str) -> Column:
    """Tiers of a package name against the query, plus log10 of its downloads; null without a match."""
    import re

    low, whole = F.lower(name), query.lower()
    dash, under = re.sub(r"\s+", "-", whole), re.sub(r"\s+", "_", whole)
    terms = [t for t in re.split(r"[\s\-_]+", whole) if t]
    several = len(terms) > 1
    any_of = lambda tests: F.array_max(F.array(F.lit(False), *tests))
    all_of = lambda tests: F.array_min(F.array(F.lit(True), *tests))
    tier = (
        F.when(low.isin(whole, dash, under), 1000)
        .when(F.lit(several) & any_of([low == t for t in terms]), 800)
        .when(low.startswith(whole) | low.startswith(dash), 500)
        .when(any_of([low.contains(x) for x in (whole, dash, under)]), 100)
        .when(F.lit(several) & all_of([low.contains(t) for t in terms]), 50)
        .when(any_of([low.contains(t) for t in terms if len(t) >= 3]), 10)
    )
    return tier + F.log10(F.greatest(downloads, F.lit(1)))
