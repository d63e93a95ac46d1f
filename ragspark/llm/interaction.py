"""Filter interaction audit: what each filter removes, alone, first, last, and in every order.

A document's failures of the filters are flags. ``CUBE`` over the flags and the part counts the documents for every
subset of the filters at once: of its rows those whose selected flags are all false are the survivors of that subset.
A filter that runs after a subset removes the survivors of the subset less those of the subset with the filter, so
every step of every order is a join of two subsets' rows, and no order is run on the documents.

The documents are reduced to their flags in one pass (words are counted and compared inside the row), equal texts meet
by their SHA-256, and the flags are counted before the cube expands them: it sees at most 32 rows a part.

Defined results: null text is empty, and empty texts equal each other; texts of any length are judged whole; of rows
with equal texts those with the smallest key stay, all of them if several share it, and a null key is neither smaller
nor larger than another; a null part is the empty string's; repeated label rows of a key count once, a label of 1 wins,
null labels and keys without labels are neither good nor toxic; other columns are ignored, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm.shared import save

#: The filters in the order of their bits.
FILTERS = "ABCDE"
#: Fewer words than this fail A; fewer distinct ones than this share (percent) fail B; more capitals than this share
#: of all characters fail C; any of these characters fails D.
WORDS, DISTINCT, CAPITALS, SYMBOLS = 200, 50, 3, "[#$%&*|]"


def failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """A row per document: key, part, and for each filter whether the document fails it."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    words = F.filter(F.split("body", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    own = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), body.alias("body"))
    counted = own.select("key", "part", "body", F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("own")))[0].alias("n"))
    flags = counted.select(
        "key",
        "part",
        F.unhex(F.sha2("body", 256)).alias("content"),
        (F.col("n.all") < WORDS).alias("A"),
        (100 * F.col("n.own") < DISTINCT * F.col("n.all")).alias("B"),
        (100 * F.length(F.regexp_replace("body", "[^A-Z]+", "")) > CAPITALS * F.length("body")).alias("C"),
        F.col("body").rlike(SYMBOLS).alias("D"),
    )
    flags = save(flags, "flags")
    copies = flags.groupBy("content").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("content", "low")
    repeated = F.coalesce(F.col("key") > F.col("low"), F.lit(False))
    return flags.join(copies, "content", "left").select(F.col("key").alias(key), "part", "A", "B", "C", "D", repeated.alias("E"))


def survivors(flags: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, mask, n, good, toxic) for every part and every subset of the filters, zeros included. ``flags``: part,
    a boolean per filter, good and toxic."""
    counts = [F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good"), F.sum(F.col("toxic").cast("long")).alias("toxic")]
    cells = save(flags.groupBy("part", *filters).agg(*counts), "cells")
    cube = cells.cube("part", *filters).agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    mask, passed = F.lit(0), F.col("part").isNotNull()
    for bit, name in enumerate(filters):
        mask = mask + F.when(F.col(name).isNull(), 0).otherwise(1 << bit)
        passed = passed & ~F.coalesce(F.col(name), F.lit(False))
    found = cube.where(passed).select("part", mask.alias("mask"), "n", "good", "toxic")
    every = cells.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("mask"))
    return save(every.join(found, ["part", "mask"], "left").fillna(0, ["n", "good", "toxic"]), "survivors")


def pairs(subsets: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter, before, kept, removed, good_lost, toxic_lost, orders): each filter after each subset of the
    others; ``orders`` of all orders begin with that subset and then the filter."""
    k = len(filters)
    steps = [(f, m, m | 1 << i, factorial(m.bit_count()) * factorial(k - 1 - m.bit_count())) for i, f in enumerate(filters) for m in range(1 << k) if not m >> i & 1]
    table = F.broadcast(subsets.sparkSession.createDataFrame(steps, "filter string, before int, after int, orders long"))  # k * 2^(k - 1) rows
    a = subsets.join(table, F.col("mask") == F.col("before")).select("part", "filter", "before", "after", "orders", *[F.col(c).alias(f"{c}_before") for c in ("n", "good", "toxic")])
    b = subsets.withColumnRenamed("mask", "after")
    lost = [(F.col(f"{c}_before") - F.col(c)).alias(name) for c, name in (("n", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost"))]
    return a.join(b, ["part", "after"]).select("part", "filter", "before", "orders", F.col("n").alias("kept"), *lost)


def audit(flags: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row per part, order of the filters and step: filter_order, step, filter, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley (removed by the step's filter, summed over all orders)."""
    k = len(filters)
    found = save(pairs(survivors(flags, filters), filters), "pairs")
    bit = lambda f: 1 << filters.index(f)
    last = F.element_at(F.create_map(*[F.lit(x) for f in filters for x in (f, (1 << k) - 1 - bit(f))]), F.col("filter"))
    whole = found.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(F.col("before") == last, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("orders") * F.col("removed")).alias("shapley"),
    )
    rows = [("".join(p), i + 1, p[i], sum(bit(f) for f in p[:i])) for p in permutations(filters) for i in range(k)]
    orders = F.broadcast(flags.sparkSession.createDataFrame(rows, "filter_order string, step int, filter string, before int"))  # k * k! rows
    out = found.join(whole, ["part", "filter"]).join(orders, ["filter", "before"])
    return out.select("part", "filter_order", "step", "filter", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def labelled(flags: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """``flags`` with booleans good (quality 1) and toxic (toxic 1) from ``labels``."""
    own = labels.groupBy(F.col(f"`{key}`").alias(key)).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    return flags.join(own, key, "left").fillna(False, ["good", "toxic"])
