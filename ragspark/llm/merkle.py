"""Merkle manifest of a dataset, built and audited level by level with DataFrames.

Every row is a leaf: the SHA-256 of its fields. The leaves of a part (a value of one column) are numbered by their
key, and while a part has several nodes, every ``fanout`` neighbours become the hash of their hashes. What remains is
the part's subroot; the subroots, ordered by part, are reduced to the root in the same way. A row's proof is the list
of the other nodes of its run, on every level from its leaf to the root: with it, a leaf that was read again can be
checked against the root alone.

* Numbers: a range sort by (part, key), ``row_number`` within each range, plus what the ranges before it hold. So no
  part, however large, passes one task.
* Up: the index divided by the fanout groups the nodes; a parent is the hash of its sorted children, which it keeps.
* Down: each level joins its nodes with their parents, which hold the siblings and the path from there on; the leaves
  come last. All levels together are about two rows per document, and a path is 32 bytes per sibling.

Each level is a table in the shared folder.

Defined results: a null field is ``-``, another one its length in UTF-8 bytes, ``:`` and its text, so null and empty
differ, and texts of any length are hashed whole; a null part is a part of its own, the first one; leaves with equal
keys follow their hashes, null keys come first, and rows that are equal in all fields have equal leaves, side by side;
other columns are ignored, whatever their names; an empty table gives no rows. One more than the largest long counts
as null (only in tampered rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark.llm.shared import save

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 2


def field(c: Column) -> Column:
    """The input of a field: ``-`` for null, else its bytes, a colon and its text."""
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def hashed(text: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def told(digest: Column) -> Column:
    """A digest as lower-case hexadecimal text."""
    return F.lower(F.hex(digest))


def joined(digests: Column) -> Column:
    """The texts of an array of digests, one after the other."""
    return F.array_join(F.transform(digests, told), "")


def ranked(df: DataFrame, group: str, *order: str) -> DataFrame:
    """``df`` with ``idx``, each row's number within its group from 0, and ``n``, the group's rows.

    Ranges of the sorted rows are numbered each for themselves; a group that fills many ranges gets its offsets from
    a table with a row per range and group."""
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = df.withColumn("tie", F.monotonically_increasing_id())
    cut = own.repartitionByRange(ranges, group, *order, "tie").withColumn("range", F.spark_partition_id())
    within = Window.partitionBy("range", group).orderBy(*order, "tie")
    numbered = save(cut.withColumn("at", F.row_number().over(within) - 1).drop("tie"), "numbered")
    count = numbered.groupBy(group, "range").agg(F.count("*").alias("here"))
    all_ranges = Window.partitionBy(group)
    before = all_ranges.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offset = count.select(group, "range", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before"), F.sum("here").over(all_ranges).alias("n"))
    return numbered.join(offset, [group, "range"]).withColumn("idx", F.col("before") + F.col("at")).drop("range", "at", "before")


def up(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """The levels above ``nodes`` (grp, idx, n, hash), lowest first, with each node's ``children``; a group ends where
    it has one node."""
    most = nodes.agg(F.max("n")).collect()[0][0] or 0
    levels, level = [], nodes
    while most > 1:
        runs = level.where("n > 1").groupBy("grp", F.floor(F.col("idx") / fanout).alias("idx"))
        kids = F.array_sort(F.collect_list(F.struct("idx", "hash")))
        grouped = runs.agg(F.ceil(F.first("n") / fanout).alias("n"), F.transform(kids, lambda k: k["hash"]).alias("children"))
        level = save(grouped.withColumn("hash", hashed(joined(F.col("children")))), "level")
        levels.append(level)
        most = -(-most // fanout)
    return levels


def down(nodes: DataFrame, levels: list[DataFrame], last, fanout: int) -> DataFrame:
    """``nodes`` with ``path`` (for each level a struct of the node's position in its run and the other nodes),
    ``subroot`` and ``root``. ``last`` adds these three to the nodes that are alone in their group."""
    above = None
    for depth in range(len(levels), -1, -1):
        level = levels[depth - 1] if depth else nodes
        found = last(level.where("n = 1"))
        if above is not None:
            parent = above.select("grp", F.col("idx").alias("up"), F.col("children").alias("run"), F.col("path").alias("rest"), "subroot", "root")
            own = level.where("n > 1").withColumn("up", F.floor(F.col("idx") / fanout)).join(parent, ["grp", "up"])
            pos = (F.col("idx") % fanout).cast("int")
            step = F.struct(pos.alias("pos"), F.filter("run", lambda x, i: i != pos).alias("others"))
            own = own.withColumn("path", F.concat(F.array(step), F.col("rest"))).drop("up", "run", "rest")
            found = found.unionByName(own)
        above = save(found.drop("n", "hash"), "paths") if depth else found
    return above


def folded(leaf: Column, path: Column, fanout: int) -> Column:
    """The root that a leaf and its path give."""

    def step(own: Column, at: Column) -> Column:
        pos, others = at["pos"], at["others"]
        return hashed(F.concat(joined(F.slice(others, F.lit(1), pos)), told(own), joined(F.slice(others, pos + 1, F.lit(fanout)))))

    return F.aggregate(path, leaf, step)


def manifest(docs: DataFrame, key: str = "doc_id", part: str = "lang", fields: tuple[str, ...] = FIELDS, now: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """A row per document: key, part, idx (its place in the part), leaf, subroot, root, path, and folded (the root from
    the leaf as read ``now`` and the path). ``now`` names fields whose values are others by then."""
    if fanout < 2:
        raise ValueError("fanout must be 2 or more")
    now = now or {}
    leaf = hashed(F.concat(*[field(F.col(f"`{c}`")) for c in fields]))
    later = hashed(F.concat(*[field(now.get(c, F.col(f"`{c}`"))) for c in fields]))
    same = F.lit(True)
    for c, value in now.items():
        same = same & F.col(f"`{c}`").eqNullSafe(value)
    group = F.when(F.col(f"`{part}`").isNull(), "").otherwise(F.concat(F.lit("="), F.col(f"`{part}`").cast("string")))
    # The texts are read once, here.
    leaves = save(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{part}`").alias("part"), group.alias("grp"), leaf.alias("hash"), F.when(~same, later).alias("later")), "leaves")
    nodes = save(ranked(leaves, "grp", "key", "hash"), "nodes")
    levels = up(nodes, fanout)

    ends = nodes.where("n = 1").select("grp", "hash")
    for level in levels:
        ends = ends.unionByName(level.where("n = 1").select("grp", "hash"))
    ends = ends.select(F.lit("all").alias("grp"), F.col("grp").alias("name"), "hash")
    tops = save(ranked(ends, "grp", "name"), "subroots")
    none = F.array().cast("array<struct<pos:int,others:array<binary>>>")
    roots = down(tops, up(tops, fanout), lambda df: df.withColumns({"path": none, "subroot": F.col("hash"), "root": F.col("hash")}), fanout)
    roots = save(roots.select(F.col("name").alias("grp"), F.col("path"), F.col("hash").alias("subroot"), "root"), "roots")

    out = down(nodes, levels, lambda df: df.join(roots, "grp"), fanout)
    folds = folded(F.coalesce("later", "hash"), F.col("path"), fanout)
    return out.select(F.col("key").alias(key), F.col("part").alias(part), "idx", F.col("hash").alias("leaf"), "subroot", "root", "path", folds.alias("folded"))


def proof_digest(path: Column) -> Column:
    """SHA-256, as text, of the siblings of a path, from the leaf to the root, left to right."""
    return F.sha2(joined(F.flatten(F.transform(path, lambda p: p["others"]))), 256)
