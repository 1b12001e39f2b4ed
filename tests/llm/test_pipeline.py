"""The corpus pipeline on the smallest tables: what its stages promise holds for the rows that each returns."""

import os
import re

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        assert docs.count() > 0.5 * before.count()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    # one document of each group stays
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    was, now = ({r["doc_id"]: shingles(r["text"]) for r in kept[n].collect()} for n in ("line_dedup", "ngram_jaccard_join"))
    linked = lambda a, b: a and b and 5 * len(a & b) >= 4 * len(a | b)
    ids = sorted(now)
    assert not any(linked(now[a], now[b]) for i, a in enumerate(ids) for b in ids[i + 1 :])
    for gone in set(was) - set(now):
        assert any(linked(was[gone], was[b]) for b in was if b != gone)
    # benchmark items that were there verbatim are gone, and nobody else
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r["doc_id"]: r["text"] for r in kept["benchmark_decontamination"].collect()}
    given = {r["doc_id"]: r["text"] for r in kept["ngram_jaccard_join"].collect()}
    assert not any(x in t for t in clean.values() for x in items)
    assert set(given) - set(clean) == {i for i, t in given.items() if any(x in t for x in items)}
    # the mix meets its targets
    m = kept["source_mix"].groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert m and all(abs(r["taken"] - r["target"]) <= 1 for r in m)


def test_odd_rows_and_empty_tables(spark, tmp_path):
    import random

    rng = random.Random(6)
    words = [a + b for a in ("ka", "lo", "mi", "ru", "te", "sa") for b in ("r", "n", "st", "l", "mp", "k", "sh")]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    spark.createDataFrame([(i, 0, i % 2) for i in range(1, 40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, make(30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    near = make(80)
    rows = [(i, make(60) + (" blorg blorg blorg" if i % 2 else "")) for i in range(1, 40)]
    rows += [(50, None), (51, ""), (None, make(40)), (None, None), (52, near), (53, near + " x"), (54, make(45)), (54, make(46)), (55, make(47)), (55, rows[-1][1])]
    rows[-1] = (55, rows[-2][1])
    schema = "doc_id long, text string, lang string, source string, n_chars long, _rows string, _may int, it string, row int"
    docs = spark.createDataFrame([(i, t, "en", None if i == 51 else "s", len(t or ""), "r", 1, "x", 2) for i, t in rows], schema)
    sf = str(tmp_path)
    got = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.where("doc_id < 0"), sf).count() == 0
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got[name] = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in docs.select("doc_id", F.coalesce("text", F.lit("-")).alias("text")).collect()) if k < 4 else docs.count()
        assert k == 4 or {"_rows", "_may", "it", "row"} <= set(docs.columns)
    ids = lambda name: [i for i, _ in got[name]]
    assert not [i for i in ids("toxicity") if 0 < i < 40 and i % 2] and len([i for i in ids("toxicity") if 0 < i < 40]) >= 17
    odd = [-1, -1, 50, 51]
    assert [i for i in ids("ngram_jaccard_join") if i in (-1, 50, 51)] == odd
    assert [i for i in ids("ngram_jaccard_join") if i > 51] == [52, 54, 54, 55]
    assert ids("benchmark_decontamination") == ids("ngram_jaccard_join") and got["source_mix"] > 0
