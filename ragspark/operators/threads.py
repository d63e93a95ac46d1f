"""Conversations and transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.errors import bounded
from ragspark.functions.text import trimmed
from ragspark.functions.urls import absolute
from ragspark.operators.tables import running, saved

SEGMENTS, CHARS, SECONDS = 12, 1200, 60.0


def is_gone(body: Column) -> Column:
    """Deleted, removed or empty."""
    return F.lower(trimmed(F.coalesce(body, F.lit("")))).isin("[deleted]", "[removed]", "")


def bare_id(parent: Column) -> Column:
    """A parent id without its kind prefix (t1_, t3_)."""
    return F.regexp_replace(parent, r"^t\d_", "")


def with_parents(comments: DataFrame, depth: int = 2, base_url: str | None = None, thread: tuple[str, ...] = ()) -> DataFrame:
    """Kept comments (id, parent_id, author, body, permalink) as chunks: text is the ancestors' bodies, oldest first,
    a blank line, and the body; the walk ends at a missing or deleted parent. ``thread``: columns that ids are
    unique within."""
    own = comments.select(*thread, F.col("id").alias("_id"), bare_id(F.col("parent_id")).alias("_up"), F.col("body").alias("_body")).where(~is_gone(F.col("body")))
    df = comments.where(~is_gone(F.col("body"))).withColumn("_next", bare_id(F.col("parent_id")))
    bodies = []
    for level in range(depth):
        up = own.select(*thread, F.col("_id").alias("_next"), F.col("_up").alias(f"_up{level}"), F.col("_body").alias(f"_b{level}"))
        df = df.join(up, [*thread, "_next"], "left").drop("_next").withColumnRenamed(f"_up{level}", "_next")
        bodies.insert(0, F.col(f"_b{level}"))
    context = F.concat_ws("\n", *bodies) if bodies else F.lit("")
    df = df.withColumn("parent_context", context).withColumn("text", F.when(F.col("parent_context") != "", F.concat("parent_context", F.lit("\n\n"), "body")).otherwise(F.col("body")))
    df = df.withColumn("section", F.coalesce("author", F.lit("conversation"))).withColumn("url", absolute(F.col("permalink"), base_url))
    return df.drop("_next", *[f"_b{i}" for i in range(depth)])


def flattened(comments: DataFrame, thread: str, most: int | None = None, paths: bool = True) -> DataFrame:
    """Pre-order of each thread's tree: depth and path (zero-padded positions), for comments that hang together from
    a root (null parent), within ``most`` levels if given. Every comment knows an ancestor, at first its parent, and
    takes over what that one knows, so the reach doubles with each join, and a depth of n takes log2 n of them. Depths
    have no gaps: a round that finds no root leaves orphans and cycles only. ``paths``: a path is as long as its
    comment is deep, so without it deep threads stay small."""
    start = comments.withColumn("depth", F.lit(0))
    start = start.withColumn("path", F.lpad(F.col("position").cast("string"), 10, "0")) if paths else start
    columns = start.columns
    start = saved(start.withColumn("_up", F.col("parent_id")), "threads")
    out, below = start.where("_up IS NULL"), start.where("_up IS NOT NULL")
    while True:
        above = out.unionByName(below).select(thread, F.col("id").alias("_up"), F.col("_up").alias("_next"), F.col("depth").alias("_depth"), *[F.col("path").alias("_path")] * paths)
        made = {"depth": F.col("depth") + 1 + F.col("_depth"), "_up": F.col("_next")} | ({"path": F.concat_ws("/", "_path", "path")} if paths else {})
        level = saved(below.join(above, [thread, "_up"]).withColumns(made).select(*columns, "_up"), "threads")
        found, below = level.where("_up IS NULL"), level.where("_up IS NOT NULL")
        if found.isEmpty():
            break
        out = out.unionByName(found)
        if below.isEmpty():
            break
    out = out.drop("_up")
    return out if most is None else out.where(F.col("depth") < most)


def nested(comments: DataFrame, thread: str, *order: str | Column) -> DataFrame:
    """Comments (id, parent_id, position) as nested intervals: ``depth``, ``lo`` (the place in the thread when replies
    follow what they answer, siblings by ``order``, by position unless given) and ``hi`` (the place of the last comment
    below, its own if there is none), so what is below a comment has its ``lo`` from its own to its ``hi``, and what is
    above holds its ``lo`` between both. There is no bound on depth: sizes and places are handed on over ancestors twice
    as far in every round, and siblings are added up over sorted ranges, so neither a long chain nor a
    comment with most of the replies is one task's work. Rows without a thread or id, and those that hang from no root
    (orphans, cycles), have no place; of rows that share an id the one of the smallest position (then parent) counts."""
    order = order or ("position",)
    own = comments.withColumn("parent_id", bare_id(F.col("parent_id"))).where(F.col(thread).isNotNull() & F.col("id").isNotNull())
    one = own.groupBy(thread, "id").agg(F.min_by(F.struct(*own.columns), F.struct("position", "parent_id")).alias("_row")).select("_row.*")
    rows = saved(flattened(saved(one, "comments"), thread, paths=False), "nested")
    deepest = rows.agg(F.max("depth")).first()[0] or 0

    def further(start: DataFrame, gained) -> DataFrame:
        """``start`` (thread, id, up, v), after rounds in which ``up`` goes twice as far."""
        step = 1
        while step <= deepest:
            start = saved(gained(start).join(start.select(thread, F.col("id").alias("up"), F.col("up").alias("_next")), [thread, "up"], "left").select(thread, "id", F.col("_next").alias("up"), "v"), "nested")
            step *= 2
        return start

    def from_below(start):
        more = start.where("up IS NOT NULL").groupBy(thread, F.col("up").alias("id")).agg(F.sum("v").alias("_more"))
        return start.join(more, [thread, "id"], "left").withColumn("v", F.col("v") + F.coalesce("_more", F.lit(0)))

    def from_above(start):
        more = start.select(thread, F.col("id").alias("up"), F.col("v").alias("_more"))
        return start.join(more, [thread, "up"], "left").withColumn("v", F.col("v") + F.coalesce("_more", F.lit(0)))

    sizes = further(rows.select(thread, "id", F.col("parent_id").alias("up"), F.lit(1).cast("long").alias("v")), from_below)
    sized = rows.join(sizes.select(thread, "id", F.col("v").alias("_subtree")), [thread, "id"])
    placed = running(sized, F.col("_subtree"), thread, "parent_id", *order, "id", name="_used", at="_at").select(thread, "id", F.col("parent_id").alias("up"), "_subtree", (F.col("_used") - F.col("_subtree")).alias("_offset"))
    starts = placed.groupBy(thread, "up").agg(F.min("_offset").alias("_start")).select(F.col(thread).alias("_thread"), F.col("up").alias("_up"), "_start")
    after = placed.join(starts, (F.col(thread) == F.col("_thread")) & F.col("up").eqNullSafe(F.col("_up")))
    # A root's own offset; a reply also counts what it answers.
    places = saved(after.select(thread, "id", "up", "_subtree", (F.col("_offset") - F.col("_start") + F.col("up").isNotNull().cast("int")).alias("v")), "nested")
    ends = further(places.drop("_subtree"), from_above).select(thread, "id", F.col("v").alias("lo")).join(places.select(thread, "id", "_subtree"), [thread, "id"])
    return rows.drop("lo", "hi").join(ends, [thread, "id"]).withColumn("hi", F.col("lo") + F.col("_subtree") - 1).drop("_subtree")


def focused(tree: DataFrame, foci: DataFrame, thread: str, context: int = 0, depth: int | None = None) -> DataFrame:
    """What a link to one comment of a thread shows. ``tree``: a result of ``nested``; ``foci``: (thread, comment). The
    comment, ``context`` ancestors (0 to 8) and ``depth`` levels of it and what is below (1 to 10; none: all), with
    ``comment`` and ``level`` (0 the comment, ancestors negative); ``lo`` orders them. A comment that is
    not there gives no rows. Foci are joined by thread, so each of a thread's foci looks at all of its intervals."""
    bounded("context", context, 0, 8)
    if depth is not None:
        bounded("depth", depth, 1, 10)
    at = foci.select(thread, "comment").distinct().join(tree.select(thread, F.col("id").alias("comment"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("depth").alias("_depth")), [thread, "comment"])
    level = F.col("depth") - F.col("_depth")
    below = F.col("lo").between(F.col("_lo"), F.col("_hi")) & (F.lit(True) if depth is None else level < depth)
    above = (F.col("lo") < F.col("_lo")) & (F.col("hi") >= F.col("_lo")) & (level >= -context)
    return tree.join(at, thread).where(below | above).withColumn("level", level).drop("_lo", "_hi", "_depth")


def _fold(segments: Column) -> Column:
    """Greedy groups over an ordered array of (seg_no, text, offset, duration): the state holds the finished groups
    and the open one's size."""
    zero = F.struct(F.array().cast("array<int>").alias("g"), F.lit(0).alias("n"), F.lit(0).alias("chars"), F.lit(0.0).alias("secs"), F.lit(-1).alias("at"))

    def step(a: Column, s: Column) -> Column:
        secs = F.greatest(s["duration"], F.lit(0.0))
        size = F.length(s["text"])
        flush = (a["n"] > 0) & ((a["n"] >= SEGMENTS) | (a["chars"] + 1 + size > CHARS) | (a["secs"] + secs > SECONDS))
        new = flush | (a["at"] < 0)
        at = a["at"] + new.cast("int")
        return F.struct(F.concat(a["g"], F.array(at)).alias("g"), F.when(new, 1).otherwise(a["n"] + 1).alias("n"), F.when(new, size).otherwise(a["chars"] + 1 + size).alias("chars"), F.when(new, secs).otherwise(a["secs"] + secs).alias("secs"), at.alias("at"))

    return F.aggregate(segments, zero, step, lambda a: a["g"])


def transcript_chunks(segments: DataFrame, video: str = "video_id") -> DataFrame:
    """Chunks of consecutive segments (seg_no, text, offset, duration): at most 12 segments, 1200 characters, 60
    seconds; segments without text do not count. The fold runs inside each transcript's own array."""
    clean = F.coalesce(F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit(""))
    rows = segments.select(video, F.struct("seg_no", clean.alias("text"), F.col("offset").cast("double").alias("offset"), F.col("duration").cast("double").alias("duration")).alias("s")).where("s.text <> ''")
    lists = rows.groupBy(video).agg(F.array_sort(F.collect_list("s")).alias("s"))
    each = lists.select(video, F.explode(F.arrays_zip(F.col("s"), _fold(F.col("s")).alias("g"))).alias("z")).select(video, F.col("z.g").alias("chunk_index"), F.col("z.s").alias("s"))
    ordered = F.array_sort(F.collect_list("s"))
    out = each.groupBy(video, "chunk_index").agg(ordered.alias("s"))
    out = out.select(
        video,
        F.col("chunk_index").cast("long").alias("chunk_index"),
        F.array_join(F.transform("s", lambda s: s["text"]), " ").alias("text"),
        F.element_at("s", 1)["offset"].alias("offset"),
        F.aggregate("s", F.lit(0.0), lambda a, s: a + F.greatest(s["duration"], F.lit(0.0))).alias("duration"),
        (F.element_at("s", -1)["offset"] + F.element_at("s", -1)["duration"]).alias("end_offset"),
        F.size("s").cast("long").alias("segments"),
    )
    return out
