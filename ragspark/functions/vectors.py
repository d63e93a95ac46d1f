"""Vector expressions, in double whatever the stored type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once per row; inside a lambda nothing else guarantees that."""
    return F.element_at(F.transform(F.array(value), body), 1)


def cosine(a: Column, b: Column) -> Column:
    """0 if either is all zeros; vectors have equal dimensions (checked when a corpus is prepared)."""
    parts = F.struct(dot(a, b).alias("d"), (norm(a) * norm(b)).alias("n"))
    return let(parts, lambda p: F.when(p["n"] > 0, p["d"] / p["n"]).otherwise(F.lit(0.0)))


def unit(a: Column) -> Column:
    scaled = lambda p: F.transform(p["v"], lambda x: F.when(p["n"] > 0, x.cast("double") / p["n"]).otherwise(x.cast("double")))
    return let(a, lambda v: let(F.struct(v.alias("v"), norm(v).alias("n")), scaled))


def shortened(a: Column, dims: int) -> Column:
    """The first ``dims`` elements, at unit length."""
    return unit(F.slice(a, 1, dims))


#: What marks a query as code (fixed values): anywhere in it, or at its start in lower case.
CODE_MARKS = ["{", "}", ";", "(", ")", "=", "def ", "class ", "function ", "const ", "let ", "var ", "import ", "from ", "#include"]


def query_prompt(text: Column) -> Column:
    """A query as the embedding model wants it, with its task."""
    code = F.lit(False)
    for mark in CODE_MARKS:
        code = code | text.contains(mark) | F.lower(text).startswith(mark.strip())
    return F.concat(F.lit("task: "), F.when(code, "code retrieval").otherwise("search result"), F.lit(" | query: "), text)


def document_prompt(text: Column, title: Column | None = None) -> Column:
    """A document as the embedding model wants it; without a title it is none."""
    return F.concat(F.lit("title: "), F.lit("none") if title is None else F.coalesce(title, F.lit("none")), F.lit(" | text: "), text)


def packed(a: Column) -> Column:
    """32-bit little-endian floats as base64, by Arrow batches: Spark has no bytes of a float."""
    import numpy as np

    return F.base64(F.pandas_udf(lambda s: s.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes()), "binary", F.PandasUDFType.SCALAR)(a))


def unpacked(text: Column) -> Column:
    """The floats of ``packed``; null for what is no whole number of them."""
    import numpy as np

    def read(b):
        return None if b is None or len(b) % 4 else np.frombuffer(b, "<f4")

    return F.pandas_udf(lambda s: s.map(read), "array<float>", F.PandasUDFType.SCALAR)(F.try_to_binary(text, F.lit("base64")))


def finite(a: Column) -> Column:
    """Non-empty, without nulls and non-finite elements."""
    return (F.size(a) > 0) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def centroid(df: DataFrame, vector: str, *keys: str) -> DataFrame:
    """The element-wise mean per key at unit length: keys, centroid, n."""
    each = df.select(*keys, F.posexplode(vector).alias("i", "x")).groupBy(*keys, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    mean = each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"), F.max("n").alias("n"))
    return mean.select(*keys, unit(F.col("mean")).alias("centroid"), "n")
