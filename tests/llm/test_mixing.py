"""Mixing: the schedule, its deviation and the order."""

import pytest
from pyspark.sql import functions as F

from edge import documents
from joeira.llm.mixing import mix, mix_order


def plain_schedule(weights):
    q, done, out = sum(weights), [0] * len(weights), []
    for t in range(q):
        ready = [(-(-(done[i] + 1) * q // a), i) for i, a in enumerate(weights) if done[i] * q // a <= t]
        i = min(ready)[1]
        done[i] += 1
        out.append(i)
    return out


def test_every_prefix_is_within_one_block(spark):
    weights = {"a": 7, "b": 2, "c": 1, "d": 3}
    rows = [(k, s) for s in weights for k in range(260)]
    out = mix_order(spark.createDataFrame(rows, "doc_id bigint, source string"), weights, block_rows=4)
    blocks = out.select("source", "block", "slot", "release", "deadline").distinct().orderBy("slot").collect()
    q, names = sum(weights.values()), sorted(weights)
    want = plain_schedule([weights[n] for n in names])
    for r in blocks:
        assert r.source == names[want[r.slot % q]] and r.release <= r.slot < r.deadline
    first_dry = min((65 // weights[s]) * q for s in weights)
    count = dict.fromkeys(names, 0)
    for r in (r for r in blocks if r.slot < first_dry):
        count[r.source] += 1
        assert all(abs(count[s] - (r.slot + 1) * weights[s] / q) < 1 for s in names)


def test_order_is_whole_and_consecutive(spark):
    docs = documents(spark)
    out = mix(docs.withColumnRenamed("position_", "extra"), {"s0": 3}, block_rows=2)
    rows = out.orderBy("position").collect()
    assert [r.position for r in rows] == list(range(docs.count()))
    assert sorted(r.slot for r in rows) == [r.slot for r in rows]
    assert sorted(map(str, out.select(*docs.columns[:5]).collect())) == sorted(map(str, docs.select(*docs.columns[:5]).collect()))
    for source in {r.source for r in rows}:
        mine = [r for r in rows if r.source == source]
        assert [r.source_index for r in mine] == list(range(len(mine)))
        ids = [r.doc_id for r in mine]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_cases(spark):
    docs = documents(spark)
    assert mix_order(docs.limit(0), {"s0": 3}).count() == 0
    with pytest.raises(ValueError):
        mix(docs.withColumn("slot", F.lit(1)), {"s0": 1})
    with pytest.raises(ValueError):
        mix_order(docs, {"s0": 0.5})


def test_parts_cut_into_many_files(spark):
    docs = documents(spark)
    want = sorted(map(str, mix_order(docs, {"s0": 3}, block_rows=2).collect()))
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "2")
    try:
        assert sorted(map(str, mix_order(docs, {"s0": 3}, block_rows=2).collect())) == want
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


@pytest.mark.parametrize("weights, default", [({"s0": 3}, 1), ({"s0": 3, "s1": 7, "s2": 2, None: 5}, 2)])
def test_schedule_as_a_table_gives_the_same_rows(spark, weights, default):
    docs = documents(spark)
    want = sorted(map(str, mix_order(docs, weights, default, block_rows=2).collect()))
    assert sorted(map(str, mix_order(docs, weights, default, block_rows=2, max_cells=0).collect())) == want
    assert mix_order(docs.limit(0), weights, default, max_cells=0).count() == 0


def test_two_thousand_sources(spark):
    n = 2000
    weights = {f"s{k:04}": 1 + k % 3 for k in range(0, n, 7)}
    rows = spark.range(5 * n + 900).selectExpr("id AS doc_id", f"IF(id < {5 * n}, format_string('s%04d', id % {n}), 's0007') AS source")
    got = mix_order(rows, weights, 2, block_rows=2).orderBy("position").collect()
    assert [r.position for r in got] == list(range(5 * n + 900))
    names = [f"s{k:04}" for k in range(n)]
    want = plain_schedule([weights.get(s, 2) for s in names])
    q = len(want)
    slots = [r.slot for r in got]
    assert slots == sorted(slots) and all(names[want[r.slot % q]] == r.source and r.release <= r.slot < r.deadline for r in got)


def test_plan_is_native(spark):
    for cells in (0, 2_000_000):
        plan = mix_order(documents(spark), {"s0": 2}, max_cells=cells)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "InArrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
