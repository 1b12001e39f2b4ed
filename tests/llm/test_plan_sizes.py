"""What the driver plans stays small: parts that are used several times are stored and not planned again for each use."""

from pyspark.sql import functions as F

from sigrel.llm.common import sieve
from sigrel.llm.components import connected_components
from sigrel.llm.mixing import mix_sources


def exchanges(df) -> int:
    # an adaptive plan that hasn't run has its exchanges in it, each once
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_a_mix_is_planned_in_parts(spark):
    docs = spark.createDataFrame([(i, "a b c"[: 1 + i % 5], None if i % 7 == 0 else f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    out = mix_sources(docs)
    assert exchanges(out) <= 7
    rows = out.collect()
    assert len(rows) == 300
    taken, target = {}, {}
    for r in rows:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)


def test_edges_are_gone_through_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (7, 7), (None, 4), (8, 9), (9, 5)], "a long, b long").mapInPandas(run, "a long, b long")
    got = {r["id"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 8: 5, 9: 5}
    assert seen.value == 7


def test_a_sieve_is_stored(spark):
    blocks, bits = sieve(spark.range(100).select(F.col("id").alias("key")), "key")
    assert bits == 1 << 15 and exchanges(blocks) == 0
