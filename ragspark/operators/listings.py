"""Job listings: filters, composite rank, explanations, dedup. A listing's missing field is null, an unknown work mode
is ``unknown``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.functions import numbers as N
from ragspark.functions.urls import RELIABILITY
from ragspark.operators.dedup import keep_best

WEIGHTS = {"semantic": 0.45, "location": 0.2, "work_mode": 0.15, "recency": 0.1, "completeness": 0.1}
CONFIDENCE = {"title": (0.95, 0.4), "location": (0.8, 0.25), "work_mode": (0.9, 0.2), "salary": (0.85, 0.15)}


@dataclass(frozen=True)
class Constraints:
    location: tuple[str, ...] = ()
    work_mode: tuple[str, ...] = ()
    max_salary: float | None = None
    exclude_titles: tuple[str, ...] = ()


def _has(column: str, words: tuple[str, ...]) -> Column:
    tests = [F.lower(F.col(column)).contains(w.strip().lower()) for w in words if w.strip()]
    return F.array_max(F.array(F.lit(False), *tests))


def passes(c: Constraints) -> Column:
    """All constraints; a missing location, mode or salary passes."""
    ok = F.lit(True)
    if c.location:
        ok &= F.col("location").isNull() | _has("location", c.location)
    if c.work_mode:
        ok &= (F.col("work_mode") == "unknown") | F.col("work_mode").isin(*c.work_mode)
    if c.max_salary is not None:
        ok &= F.coalesce(N.salary_max(F.col("salary_raw")) <= c.max_salary, F.lit(True))
    if c.exclude_titles:
        ok &= ~_has("title", c.exclude_titles)
    return ok


def components(c: Constraints, as_of: str) -> dict[str, Column]:
    location = F.coalesce(_has("location", c.location).cast("double"), F.lit(0.0)) if c.location else F.lit(0.5)
    mode = F.when(F.col("work_mode") == "unknown", 0.0).otherwise(F.col("work_mode").isin(*c.work_mode).cast("double")) if c.work_mode else F.lit(0.5)
    filled = [F.col("company").isNotNull(), F.col("location").isNotNull(), F.col("salary_raw").isNotNull(), F.col("work_mode") != "unknown"]
    return {
        "semantic": F.coalesce("semantic", F.lit(0.0)),
        "location_score": location,
        "work_mode_score": mode,
        "recency": N.posted_score(F.col("posted_raw"), as_of),
        "completeness": sum((x.cast("double") for x in filled), F.lit(0.0)) / 4,
    }


def matched(c: Constraints) -> Column:
    """The constraints a listing meets: the first location, the mode, the salary."""
    out = []
    if c.location:
        tests = [F.when(F.lower("location").contains(w.strip().lower()), F.lit(f"location: {w}")) for w in c.location if w.strip()]
        out.append(F.coalesce(*tests, F.lit(None).cast("string")))
    if c.work_mode:
        out.append(F.when(F.col("work_mode").isin(*c.work_mode), F.concat(F.lit("work mode: "), "work_mode")))
    if c.max_salary is not None:
        out.append(F.when(N.salary_max(F.col("salary_raw")) <= c.max_salary, F.lit("salary within budget")))
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def rank(listings: DataFrame, c: Constraints, as_of: str) -> DataFrame:
    """``listings`` (with a column ``semantic``) that pass, with component scores, overall and matched."""
    df = listings.where(passes(c)).withColumns(components(c, as_of))
    parts = [("semantic", "semantic"), ("location_score", "location"), ("work_mode_score", "work_mode"), ("recency", "recency"), ("completeness", "completeness")]
    overall = sum((F.col(a) * WEIGHTS[b] for a, b in parts), F.lit(0.0))
    return df.withColumn("overall", F.round(overall, 6)).withColumn("matched", matched(c))


def with_semantic(listings: DataFrame, scores: DataFrame) -> DataFrame:
    """Adds ``semantic`` from (key, score): by URL, else by position, else 0."""
    by_url = scores.select(F.col("key").alias("source_url"), F.col("score").alias("_url"))
    by_at = scores.select(F.col("key").alias("_at"), F.col("score").alias("_pos"))
    df = listings.join(by_url, "source_url", "left").withColumn("_at", F.col("position").cast("string")).join(by_at, "_at", "left")
    return df.withColumn("semantic", F.coalesce("_url", "_pos", F.lit(0.0))).drop("_url", "_pos", "_at")


def confidence(df: DataFrame) -> DataFrame:
    """Adds ``confidence``: per field and overall."""
    has = {"title": F.col("title").isNotNull(), "location": F.col("location").isNotNull(), "work_mode": F.col("work_mode") != "unknown", "salary": F.col("salary_raw").isNotNull()}
    each = {k: F.when(has[k], CONFIDENCE[k][0]).otherwise(0.0) for k in has}
    return df.withColumn("confidence", F.struct(*[v.alias(k) for k, v in each.items()], sum((v * CONFIDENCE[k][1] for k, v in each.items()), F.lit(0.0)).alias("overall")))


def dedup(listings: DataFrame) -> DataFrame:
    """By URL (the more reliable source wins), by source and id, by company and title (higher confidence wins)."""
    reliability = F.create_map(*[F.lit(x) for p in RELIABILITY.items() for x in p])
    df = keep_best(listings, F.col("source_url"), -reliability[F.col("source")], "position")
    df = keep_best(df, F.when(F.col("job_id").isNotNull(), F.concat("source", F.lit(":"), "job_id")), F.col("confidence.overall"), "position")
    return keep_best(df, F.when(F.col("company").isNotNull(), F.concat(F.lower(F.trim("company")), F.lit("|"), F.lower(F.trim("title")))), F.col("confidence.overall"), "position")
