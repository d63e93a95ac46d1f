"""Quality rules, line first, as DataFrame expressions only.

Base statistics of the whole text decide ``base_failed``. Then every line with a word is judged alone:

* punctuation: a line of prose ends in a sentence mark (closing quotes and brackets may follow); a line fails if it
  has ``min_words`` words or more and no sentence mark or separator anywhere in its last word;
* navigation: separators (| > » · •) stand between at least ``nav_share`` of the words, three of them at least;
* boilerplate: it contains one of the fixed phrases of BOILERPLATE, which has some of each of four languages.

Lines that fail are removed, and a document that loses more than ``max_lost`` of its word characters is rejected.

A repeated three-word window is found without a shuffle: the windows' hashes are sorted with their places inside
the row, equal neighbours are repeats, and the places they cover are counted.

Defined results: null or empty text has no words and fails; a text of any length is judged whole; of equal lines the
first counts and the others are duplicates; exactly ``max_lost`` is still kept; repeated rows are judged each by itself; an empty table
gives no rows; other columns pass through (those named like an output are replaced). Nothing is quadratic in a
text's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.llm.secrets import let
from ragspark.llm.shared import fresh

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
SEPARATORS = r"[|>»·•]"

#: Phrases that mark a line of a page's furniture, in lower case: English, German, Spanish and French.
BOILERPLATE = [
    "aceptar cookies",
    "accepter les cookies",
    "alle rechte vorbehalten",
    "datenschutzerklärung",
    "en savoir plus",
    "inscrivez-vous",
    "leer más",
    "mehr erfahren",
    "mentions légales",
    "nutzungsbedingungen",
    "politique de confidentialité",
    "política de privacidad",
    "regístrate",
    "todos los derechos reservados",
    "tous droits réservés",
    "weiterlesen",
    "all rights reserved",
    "accept cookies",
    "click here",
    "cookie policy",
    "enable javascript",
    "privacy policy",
    "read more",
    "sign up",
    "skip to content",
    "subscribe to our newsletter",
    "terms of service",
    "terms of use",
]
#: The phrases with their first letters taken out, so that most places of a line fail at once.
PHRASES = "|".join(f"{c}(?:{'|'.join(p[1:] for p in BOILERPLATE if p[0] == c)})" for c in sorted({p[0] for p in BOILERPLATE}))
#: On a line read backwards: its last word ends in a mark and closing characters, or holds a mark that stands for a
#: sentence's end or a separator. Nothing is tried twice (possessive), so a line's length in one word costs no more.
ENDS_WELL = r"""^[\x20\x09-\x0D]*+(?:[)\]}"'”’»›]*+[.!?:;,…。！？]|[^\x20\x09-\x0D.!?:;,…|>]*+[.!?:;,…|>])"""


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _repeats(w: Column) -> Column:
    """Words in three-word windows that the text has twice or more."""

    def places(p: Column) -> Column:
        same = F.filter(p, lambda x, i: ((i > 0) & (x["h"] == F.get(p, i - 1)["h"])) | F.coalesce(x["h"] == F.get(p, i + 1)["h"], F.lit(False)))
        return let(F.sort_array(F.transform(same, lambda x: x["i"])), lambda at: F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(i, a["end"])).alias("n"), (i + 3).alias("end")), lambda a: a["n"]))

    def sorted_places(h: Column) -> Column:
        # Most short texts repeat nothing; only the others are sorted with their places.
        once = F.size(F.array_distinct(h)) == F.size(h)
        return F.when(once, F.lit(0)).otherwise(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), places))

    def grams(x: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(x) - 3), lambda i: F.xxhash64(F.get(x, i), F.get(x, i + 1), F.get(x, i + 2)))
        return F.when(F.size(x) < 3, F.lit(0)).otherwise(let(each, sorted_places))

    return let(F.transform(w, lambda x: F.xxhash64(x)), grams)


def _deleted(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def line_fails(line: Column, min_words: int = 4, nav_share: float = 0.2) -> Column:
    """Whether a line with a word fails a rule."""
    marks = F.length(line) - F.length(_deleted(line, "|>»·•"))
    size = F.size(words(line))  # the costly part, so it comes last
    navigation = line.rlike(SEPARATORS) & (marks >= 3) & (marks >= nav_share * size)
    unmarked = ~F.reverse(line).rlike(ENDS_WELL) & (size >= min_words)
    phrase = F.lower(line).rlike(PHRASES)
    return unmarked | navigation | phrase


def statistics(docs: DataFrame, text: str = "text", max_lost: float = 0.5, **rules) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, cleaned (the
    lines that passed), lost (share of word characters removed) and kept."""
    outputs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "cleaned", "lost", "kept")
    plain = [F.col(f"`{c}`") for c in docs.columns if c not in outputs]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))

    def line_stats(lines: Column) -> Column:
        return let(F.filter(lines, lambda x: x.rlike(WORD)), full_stats)

    def full_stats(full: Column) -> Column:
        good = F.filter(full, lambda x: ~line_fails(x, **rules))
        return F.struct((F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"), F.array_join(good, "\n").alias("cleaned"))

    w, w_, l_ = words(whole), fresh(docs.columns, "w_"), fresh(docs.columns, "l_")
    out = docs.select(
        *plain,
        let(w, lambda x: F.struct(F.size(x).cast("long").alias("n_words"), _repeats(x).cast("long").alias("n_repeat_words"))).alias(w_),
        F.length(_deleted(whole, WHITE)).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(_deleted(whole, SYMBOLS))).cast("long").alias("n_symbols"),
        let(F.split(whole, "\n", -1), line_stats).alias(l_),
    )
    left = F.length(_deleted(F.col(f"{l_}.cleaned"), WHITE))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.select(*plain, F.col(f"{w_}.n_words"), "word_chars", "n_symbols", F.col(f"{l_}.n_dup_lines"), F.col(f"{w_}.n_repeat_words"), F.col(f"{l_}.cleaned"), F.when(F.col("word_chars") > 0, 1 - left / F.col("word_chars")).otherwise(0.0).alias("lost"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= max_lost))
