"""Keep-first, keep-best and order-dependent dedup; budgets and eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragspark.operators.tables import numbered, running, within_reach


def keep_first(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key; rows whose key is null or blank all stay.

    By aggregate and not by window: copies meet already on the map side, so a key in a third of all rows is cheap."""
    keyed = df.withColumn("_key", F.when(key != "", key))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    once = keyed.where("_key IS NOT NULL").groupBy("_key").agg(F.min_by(row, F.struct(*order)).alias("r")).select("r.*")
    return once.unionByName(keyed.where("_key IS NULL").drop("_key"))


def keep_best(df: DataFrame, key: Column, best: Column, position: str) -> DataFrame:
    """Of each key the row with the largest ``best`` (ties: the first), at the first row's position; null keys stay."""
    keyed = df.withColumn("_key", key).withColumn("_best", best)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    won = keyed.where("_key IS NOT NULL").groupBy("_key").agg(F.max_by(row, F.struct("_best", -F.col(position))).alias("r"), F.min(position).alias("_slot")).select("r.*", "_slot")
    out = won.withColumn(position, F.col("_slot")).drop("_slot")
    return out.unionByName(keyed.where("_key IS NULL").drop("_key", "_best"))


def prefix_budget(df: DataFrame, size: Column, budget: int, *order: str, partition: tuple[str, ...] = (), keep_one: bool = False) -> DataFrame:
    """Rows in order until the next would exceed the budget; the first always, if ``keep_one``. Sizes are not negative.

    Over a whole table only the rows near the budget are added up one by one, and those in sorted ranges (a null size
    is nothing there); with a partition each group is a window, for budgets of many groups."""
    if not partition:
        out = running(within_reach(df, size, budget, *order), size, *order, at="_n")
        fits = (F.col("used") <= budget) & F.lit(budget > 0 or keep_one)
        return out.where(fits | (F.col("_n") == 0) if keep_one else fits).drop("_n")
    w = Window.partitionBy(*partition).orderBy(*order)
    out = df.withColumn("used", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    fits = F.col("used") <= budget
    if keep_one:
        out = out.withColumn("_n", F.row_number().over(w))
        return out.where(fits | (F.col("_n") == 1)).drop("_n")
    return out.where(fits & F.lit(budget > 0))


def evict(corpora: DataFrame, as_of: int, ttl_ms: int, most: int = 50, most_bytes: int = 500_000_000, current: str | None = None) -> DataFrame:
    """The corpora that stay: not expired, the ``most`` last used, and of these as many as fit the bytes; the current
    one always. Columns corpus_id, created_at, last_accessed_at (ms), total_bytes (null: none)."""
    mine = F.col("corpus_id") == current if current is not None else F.lit(False)
    alive = corpora.where((F.lit(as_of) - F.col("created_at") <= ttl_ms) | mine)
    few = numbered(alive, F.desc("last_accessed_at"), F.asc("corpus_id"), name="_n").where((F.col("_n") < most) | mine)
    return running(few, F.col("total_bytes"), "_n", name="_bytes", at="_at").where((F.col("_bytes") <= most_bytes) | mine).drop("_n", "_bytes", "_at")


def dedup_papers(papers: DataFrame, title: str = "title", position: str = "position") -> DataFrame:
    """In order of arrival: a later paper of the same title takes the holder's place if it has a citation count, DOI
    or venue that the holder lacks. The fold runs inside each title's own list."""
    key = F.trim(F.regexp_replace(F.lower(title), r"\s+", " "))
    row = F.struct(F.col(position).alias("_at"), *[F.col(f"`{c}`") for c in papers.columns])
    lists = papers.groupBy(key.alias("_key")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    richer = lambda new, old: (new["citations"].isNotNull() & old["citations"].isNull()) | (new["doi"].isNotNull() & old["doi"].isNull()) | (new["venue"].isNotNull() & old["venue"].isNull())
    held = F.aggregate(F.slice("rows", F.lit(2), F.size("rows")), F.element_at("rows", 1), lambda old, new: F.when(richer(new, old), new).otherwise(old))
    out = lists.select(held.alias("h"), F.element_at("rows", 1)["_at"].alias("_slot")).select(*[F.col(f"h.`{c}`") for c in papers.columns], "_slot")
    return out.withColumn(position, F.col("_slot")).drop("_slot")
