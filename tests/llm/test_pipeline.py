import pytest
import test_decontaminate
import test_jaccard
import test_language
import test_packing
import test_secrets

import __spark_entry__
import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def brute(rows, items):
    """rows: (doc_id, text, lang, source) to the texts by id that reach the last stage."""
    kept = [r for r, (_, lang, score) in zip(rows, test_language.brute([r[:3] for r in rows]), strict=True) if lang != "und" and score >= 0.5]
    kept = [r for r, (i, _, comp) in zip(kept, test_jaccard.brute([r[:2] for r in kept]), strict=True) if i == comp]
    kept = [r for r, found in zip(kept, test_decontaminate.brute([r[1] for r in kept], items), strict=True) if not found[-1]]
    spans = test_secrets.brute([(r[0], r[1], r[3]) for r in kept])
    return {r[0]: cut(r[1], s[-1]) for r, s in zip(kept, spans, strict=True)}


def cut(text, spans):
    out, at = "", 0
    for _, a, z in (s.split(":") for s in spans.split(",") if s):
        if int(a) >= at:
            out += text[at : int(a)] + "<secret>"
        at = max(at, int(z))
    return out + text[at:]


def test_run_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute(docs, items)
    assert 0 < len(want) < len(docs)
    rows = __spark_entry__.queries()["pipeline"](spark, SF).collect()
    assert test_packing.check([tuple(r) for r in rows], want) >= 1


@pytest.mark.parametrize("n", range(5))
def test_edges(spark, n):
    name, stage = P.STAGES[n]
    prose = "this is a plain sentence with some words number %d in it and more of them follow here today"
    long = prose % 8 + " and " + " ".join(f"this{i} is the{i} very long of and" for i in range(30_000))
    rows = [(8, long, "en", "e", len(long)), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, prose % 3, "en", "a", 91), (3, prose % 3, "en", "a", 91), (None, prose % 4, "en", "b", 91), (5, "password=abcdef123 " + prose % 5, None, None, 99), (6, "123 !", "en", "a", 5), (7, "wort und der die das " * 20, "de", "c", 400)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, id_ string")
    out = stage(spark, df, SF)
    got = out.collect()
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got)
    every = [1, 2, 3, 3, 5, 6, 7, 8, None]
    # Language: what has no letter goes. Near copies: of the repeated row one stays. Packing: a piece for each 1024 ids.
    kept = {"language": [3, 3, 5, 7, 8, None], "near_copies": [1, 2, 3, 5, 6, 7, 8, None], "decontaminate": every, "secrets": every}
    if name == "packing":
        n = 1 + len(test_packing.P.encoder(str(P.tokenizer_path()))([long])[0])
        assert ids == sorted((i is None, i or 0) for i in [*every, *[8] * (-(-n // 1024) - 1)])
    else:
        assert out.columns == df.columns
        assert ids == sorted((i is None, i or 0) for i in kept[name])
        texts = {r["doc_id"]: r["text"] for r in got}
        assert texts[8] == long
        assert texts[5] == ("<secret> " + prose % 5 if name == "secrets" else "password=abcdef123 " + prose % 5)
    assert stage(spark, df.limit(0), SF).count() == 0
