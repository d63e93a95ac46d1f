"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed 1- to 3-grams of all labelled training texts, task by task; the counts meet in a Spark
sum, and the log-probability matrix (2**BITS rows, a column per language, at most MAX_LANGUAGES, so 64 MB) is
broadcast; the sums reach the driver as Arrow columns.
Scoring gathers the matrix rows of a batch's n-grams and sums them per text with numpy.

The training rows are those with a label and an id whose crc32 (of its decimal text) is not divisible by FOLDS;
the label, source and id never enter a prediction.

Defined results: null text or text without a letter is ``und`` with score 0; without any training row every text
is ``und``; a text of any length is scored whole; a null id is held out; ties go to the label that sorts first; other columns pass through (those named
like an output are replaced; ``keep_identified`` gives all back).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragspark.llm import kernel as K
from ragspark.llm.shared import save, set_aside, small_batches

FOLDS, BITS, ORDERS, ALPHA, MAX_LANGUAGES = 5, 15, 3, 0.5, 256
UNKNOWN = "und"


def held_out(doc_id: str = "doc_id", folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % folds == 0, F.lit(True))


def grams(texts: list[str], bits: int = BITS, orders: int = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the lower-cased texts, and where each text's begin (one more at the end)."""
    lowered = [t.lower() for t in texts]
    size = np.fromiter(map(len, lowered), np.int64, len(lowered))
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4").astype(K.U64)
    first = np.concatenate(([0], np.cumsum(size)))
    count = np.maximum(size[:, None] - np.arange(orders)[None, :], 0)
    at = np.concatenate(([0], np.cumsum(count.sum(1))))
    out = np.empty(at[-1], np.int32)
    hashed = np.zeros(len(points), K.U64)
    before = at[:-1].copy()
    for n in range(orders):
        hashed = (hashed[: len(points) - n] * K.U64(0x100000001B3) + points[n:]) * K._M1 if n else (points + K.U64(1)) * K._M1
        owner, place = K.many(count[:, n])
        code = hashed[first[owner] + place]
        out[before[owner] + place] = ((code ^ (code >> K.U64(29))) * K._M2 >> K.U64(64 - bits)).astype(np.int32)
        before += count[:, n]
    return out, at


def _decoded(data: np.ndarray, off: np.ndarray) -> list[str]:
    body = data.tobytes()
    return [body[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang", folds: int = FOLDS, alpha: float = ALPHA):
    """(labels, log prior, log-probability matrix) from the training rows of ``docs``."""
    small_batches(docs.sparkSession)
    size = 1 << BITS

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for rows, data, off in K.chunks(batches, "text", 1 << 20):
            labels = rows.column(rows.schema.get_field_index("label")).to_pylist()
            codes, at = grams(_decoded(data, off))
            own = np.array(labels, object)
            for name in set(labels):
                mine = np.repeat(own == name, np.diff(at))
                total = seen.setdefault(name, np.zeros(size + 1, np.int64))
                total[:size] += np.bincount(codes[mine], minlength=size)
                total[size] += int((own == name).sum())
        for name, total in seen.items():
            code = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(code), pa.string()), pa.array(code, pa.int32()), pa.array(total[code])], names=["label", "code", "n"])

    rows = docs.where(F.col(f"`{label}`").isNotNull() & ~held_out(doc_id, folds)).select(F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{text}`").alias("text"))
    sums = rows.mapInArrow(count, "label string, code int, n long").groupBy("label", "code").agg(F.sum("n").alias("n"))
    sums = save(sums, "counts")
    found = sorted(r["label"] for r in sums.select("label").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels")
    table = sums.toArrow()
    counts = np.zeros((size + 1, len(found)), np.float64)
    column = {label: j for j, label in enumerate(found)}
    at = np.array([column[x] for x in table["label"].to_pylist()], np.int64)
    counts[table["code"].to_numpy(), at] = table["n"].to_numpy()
    rows_of = counts[size]
    smooth = counts[:size] + alpha
    return found, np.log(rows_of / rows_of.sum()) if found else rows_of, np.log(smooth / smooth.sum(0))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def score(texts: list[str], labels: list[str], prior: np.ndarray, matrix: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The most likely label and its posterior for each text."""
    if not labels:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    codes, at = grams(texts)
    total = np.tile(prior, (len(texts), 1))
    full = np.flatnonzero(np.diff(at))
    if len(full):
        total[full] += np.add.reduceat(matrix[codes], at[full], axis=0)
    best = total.argmax(1)
    share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
    letters = [has_letter(t) for t in texts]
    return [labels[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters, strict=True)], np.where(letters, share, 0.0)


def predict(docs: DataFrame, model, text: str = "text", limit: int = 1 << 18) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    plain = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for rows, data, off in K.chunks(batches, text, limit):
            label, share = score(_decoded(data, off), *shared.value)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(label, pa.string()), pa.array(share)], names=[*rows.schema.names, "lang_pred", "score"])

    schema = T.StructType([*plain, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*[F.col(f"`{f.name}`") for f in plain]).mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is identified with a score of ``least`` or more."""
    own, restore = set_aside(docs, "lang_pred", "score")
    return restore(predict(own, model, text).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)))
