"""Secret scans with corpus-wide ownership frequency, as DataFrame expressions only.

Base findings, leftmost and non-overlapping for each kind: assignments of a value of 6 or more characters to a
credential name, cloud access keys of 20 or more characters, hexadecimal runs of 24 or more.

Ownership: every candidate value - of the base findings and of generic tokens (24 or more characters of the base-64
alphabet with upper case, lower case and digits, not touching a base finding) - is hashed, and its distinct
repositories and distinct owners are counted over the whole corpus. A value that more than ``max_owners`` owners or
more than ``max_repositories`` repositories hold is a widely copied example; a generic token with fewer of both is a
live-looking credential of its owner and joins the findings as kind ``generic``. Base findings stay whatever their
verdict.

Positions are code points, ends exclusive; a match's span is the whole match, its hashed value is the assigned value
or the whole match. Positions come from the text around the matches: split at the pattern, each gap's length is
known, and so is each match's; running sums go by blocks, so nothing is quadratic in a text's matches.

Skew: distinct counts go through (value, owner, repository), so a value in a third of all rows is counted in parts;
the verdicts are written first, so the join back may be broadcast if small or split by the adaptive skew join.

Defined results: null or empty text has no findings, a text of any length is scanned whole; findings with equal starts
are listed in the order of their kinds; a null owner or repository counts as one of its own; repeated rows are judged
each by itself; an empty table gives no rows; other columns pass through (those named like an output are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragspark.llm.shared import fresh, save

#: Fixed values of the contract, in the order in which spans with the same start are listed.
KINDS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""",
    "access": r"((AKIA[A-Z0-9]{16,}))",
    "hex": r"(([0-9a-f]{24,}))",
}
GENERIC = r"((?<![A-Za-z0-9+/_=-])((?=[A-Za-z+/_=-]*[0-9])(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{24,}))"
ORDER = [*KINDS, "generic"]
SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"
BLOCK = 256


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine, start: int = 0) -> Column:
    """The running fold of an array of whole numbers, BLOCK of them at a time: an array that grows by one is copied
    each time, so it is kept short."""

    def fold(xs: Column, first: Column | None = None) -> Column:
        last = lambda acc: F.coalesce(F.element_at(acc, F.when(F.size(acc) > 0, -1)), F.lit(start) if first is None else first)
        return F.aggregate(xs, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(combine(last(acc), x))))

    def joined(blocks: Column) -> Column:
        before = F.concat(F.array(F.lit(start)), fold(F.transform(blocks, lambda b: F.element_at(b, -1))))
        return let(F.struct(blocks.alias("b"), before.alias("at")), lambda p: F.flatten(F.transform(p["b"], lambda b, i: F.transform(b, lambda x: combine(p["at"][i], x)))))

    def cut(xs: Column) -> Column:
        whole = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int"))
        return let(F.transform(whole, lambda i: fold(F.slice(xs, i * BLOCK + 1, F.lit(BLOCK)))), joined)

    return let(values, lambda xs: F.when(F.size(xs) > 0, cut(xs)).otherwise(xs))


def spans(text: Column, pattern: str, rank: int, least: int = 0) -> Column:
    """The matches of ``pattern`` (group 1 the match, group 2 its value) as (start, rank, end, value)."""

    def located(pair: Column) -> Column:
        # Running ends: after each gap and match; a match starts where the ends before it and its gap reach.
        found, gaps = pair["found"], pair["gaps"]
        steps = F.transform(found, lambda m, i: F.length(gaps[i]) + F.length(m))
        return let(F.struct(found.alias("found"), running(steps, lambda a, x: a + x).alias("ends"), pair["values"].alias("values")), _rows)

    def _rows(p: Column) -> Column:
        rows = F.transform(p["found"], lambda m, i: F.struct((p["ends"][i] - F.length(m)).alias("start"), F.lit(rank).alias("rank"), p["ends"][i].alias("end"), p["values"][i].alias("value")))
        return F.filter(rows, lambda r: F.length(r["value"]) >= least) if least else rows

    pair = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("found"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("values"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.rlike(pattern), let(pair, located)).otherwise(F.array().cast(SPAN))


def candidates(text: Column) -> Column:
    """(start, rank, end, value_hash) of the base findings and of all generic tokens."""
    every = [spans(text, p, i, 6 if k == "assign" else 0) for i, (k, p) in enumerate(KINDS.items())]
    return F.transform(F.concat(*every, spans(text, GENERIC, len(KINDS))), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("value_hash")))


def _apart(each: DataFrame) -> DataFrame:
    """``each`` (row, start, rank, end, ...) without the generic tokens that touch a base finding of their row."""
    base = F.col("rank") < len(KINDS)
    # Both ways from the first row on: a frame that only shrinks would be summed up anew for every row.
    onward = lambda *o: Window.partitionBy("row").orderBy(*o).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.max(F.when(base, F.col("end"))).over(onward("start"))
    after = F.min(F.when(base, F.col("start"))).over(onward(F.desc("start")))
    alone = (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", "end") >= F.col("end"))
    return each.withColumn("before", before).withColumn("after", after).where(base | alone).drop("before", "after")


def scan(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id", max_owners: int = 2, max_repositories: int = 10) -> DataFrame:
    """``docs`` without its text, with ``findings``: an array of (start, rank, end, kind, value_hash, n_owners,
    n_repositories, verdict), by start and then kind; verdict is ``copied`` or ``live``."""
    row, held = fresh(docs.columns, "row_"), fresh(docs.columns, "held_")
    plain = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "findings")]
    found = docs.select(F.monotonically_increasing_id().alias(row), *plain, candidates(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias(held))
    found = save(found, "findings")
    each = found.where(F.size(held) > 0).select(F.col(row).alias("row"), F.struct(F.col(f"`{owner}`")).alias("owner"), F.struct(F.col(f"`{repository}`")).alias("repository"), F.explode(held).alias("s"))
    each = save(_apart(each.select("row", "owner", "repository", "s.*")), "candidates")
    by_owner = each.groupBy("value_hash", "owner", "repository").agg(F.lit(1).alias("one")).groupBy("value_hash", "owner").agg(F.count("*").alias("n"))
    owned = save(by_owner.groupBy("value_hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories")), "ownership")
    copied = (F.col("n_owners") > max_owners) | (F.col("n_repositories") > max_repositories)
    judged = each.join(owned, "value_hash").where((F.col("rank") < len(KINDS)) | ~copied)
    kind = F.element_at(F.array(*map(F.lit, ORDER)), F.col("rank") + 1).alias("kind")
    finding = F.struct("start", "rank", "end", kind, "value_hash", "n_owners", "n_repositories", F.when(copied, "copied").otherwise("live").alias("verdict"))
    judged = judged.groupBy(F.col("row").alias(row)).agg(F.array_sort(F.collect_list(finding)).alias("findings"))
    none = F.array().cast(judged.schema["findings"].dataType)
    return found.join(judged, row, "left").select(*plain, F.coalesce("findings", none).alias("findings"))


def of_kind(kind: str) -> Column:
    return F.filter("findings", lambda f: f["kind"] == kind)


def listed(findings: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "<secret>", **options) -> DataFrame:
    """``docs`` with every finding's span replaced by ``mark``; all rows stay, and ``n_chars``, if there, follows."""
    row, held = fresh(docs.columns, "row_"), fresh(docs.columns, "found_")
    own = save(docs.select(F.monotonically_increasing_id().alias(row), *[F.col(f"`{c}`") for c in docs.columns]), "redact")
    found = scan(own, text, **options).where(F.size("findings") > 0).select(row, F.col("findings").alias(held))
    out = own.join(found, row, "left")

    def cut(p: Column) -> Column:
        # Between findings the text stays; a finding that begins inside an earlier one is swallowed by it.
        ends = running(F.transform(p["f"], lambda f: f["end"]), lambda a, x: F.greatest(a, x))
        return let(F.struct(p["t"].alias("t"), p["f"].alias("f"), F.concat(F.array(F.lit(0)), ends, F.array(F.length(p["t"]))).alias("at")), heads)

    def heads(p: Column) -> Column:
        # What stays before each finding that no earlier one reaches into, and after the last one.
        each = F.transform(p["f"], lambda f, i: F.struct(p["at"][i].alias("a"), f["start"].alias("z")))
        whole = F.concat(F.filter(each, lambda g: g["z"] >= g["a"]), F.array(F.struct(p["at"][F.size(p["f"])].alias("a"), F.length(p["t"]).alias("z"))))
        return let(F.struct(p["t"].alias("t"), whole.alias("g")), pieces)

    def pieces(p: Column) -> Column:
        # By blocks, so that the way to a place in the text is short.
        def block(own: Column) -> Column:
            first = own[0]["a"]
            part = p["t"].substr(first + 1, F.element_at(own, -1)["z"] - first)
            return let(F.struct(part.alias("t"), own.alias("g")), lambda q: F.array_join(F.transform(q["g"], lambda g: q["t"].substr(g["a"] - q["g"][0]["a"] + 1, g["z"] - g["a"])), mark))

        whole = F.sequence(F.lit(0), F.floor((F.size(p["g"]) - 1) / BLOCK).cast("int"))
        return F.array_join(F.transform(whole, lambda i: let(F.slice(p["g"], i * BLOCK + 1, F.lit(BLOCK)), block)), mark)

    new = F.when(F.col(held).isNotNull(), let(F.struct(F.col(f"`{text}`").alias("t"), F.col(held).alias("f")), cut)).otherwise(F.col(f"`{text}`"))
    out = out.withColumn(text, new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(held).isNotNull(), F.length(F.col(f"`{text}`")).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
