"""Queries on small tables that hold what only larger ones hold otherwise."""

from __future__ import annotations

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from fathomline.operators import models
from fathomline.plans import catalogue


def told(spark, folder, name: str, **tables):
    """Rows of a query and of its SQL over tables that are given."""
    con = duckdb.connect()
    for t, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.execute(catalogue.ORACLE[name])
    names = [d[0] for d in want.description]
    return sorted(tuple(r[c] for c in names) for r in catalogue.QUERIES[name](spark, str(folder)).collect()), sorted(want.fetchall())


def test_spread_of_three_members(spark, tmp_path):
    ids = [1, 1 + 2018, 1 + 2 * 2018, 500]
    got, want = told(spark, tmp_path, "cluster_spread", supplier={"s_suppkey": pa.array(ids, pa.int64()), "s_nationkey": pa.array([0] * 4, pa.int64()), "s_acctbal": [1.0] * 4})
    assert got == want
    assert [r[1] for r in got] == [3, 1]


def test_covariates_as_far_north_as_south(spark, tmp_path):
    rng = random.Random(3)
    size = [[rng.randrange(1, 51) for _ in range(50)] for _ in range(41)]
    at = [(i, j, size[i][j]) for i in range(41) for j in range(50)]
    rows = [((1000 + i) * 50 + j, z) for i, j, z in at] + [((2999 - 40 + i) * 50 + j, size[40 - i][j]) for i, j, _ in at]
    got, want = told(spark, tmp_path, "distinct_covariates", part={"p_partkey": pa.array([r[0] for r in rows], pa.int64()), "p_size": pa.array([r[1] for r in rows], pa.int32())})
    assert got == want
    half = spark.createDataFrame(rows[: len(at)], "k int, s int")
    half.selectExpr("cast(k as bigint) as p_partkey", "s as p_size").write.parquet(f"{tmp_path}/half/part.parquet")
    one = catalogue.QUERIES["distinct_covariates"](spark, f"{tmp_path}/half").first()
    assert got[0][1] == one["distinct_rows"]


def test_quantiles_by_buckets(spark, monkeypatch):
    """Leaves with ties and without targets, ids that share all leaves, and more values than buckets."""
    monkeypatch.setattr(models, "BUCKETS", 4)
    rng = random.Random(8)
    held = [(t, rng.randrange(3), float(rng.randrange(30))) for t in range(4) for _ in range(40)]
    asked = [(k, t, (k * (t + 1)) % 4) for k in range(12) for t in range(4)]
    got = {r["id"]: r for r in models.pooled_quantiles(spark.createDataFrame(held, "tree int, leaf int, y double"), spark.createDataFrame(asked, "id bigint, tree int, leaf int"), 4).collect()}
    for k in range(12):
        pooled: dict[float, float] = {}
        for _, t, leaf in (a for a in asked if a[0] == k):
            ys = [y for tree, own, y in held if (tree, own) == (t, leaf)]
            for y in ys:
                pooled[y] = pooled.get(y, 0.0) + 1 / len(ys) / 4
        run, q16, q84 = 0.0, None, None
        for y in sorted(pooled):
            run += pooled[y]
            q16 = y if q16 is None and run >= 0.16 - 1e-12 else q16
            q84 = y if q84 is None and run >= 0.84 - 1e-12 else q84
        if not pooled:
            assert k not in got
            continue
        assert abs(got[k]["prediction"] - sum(y * w for y, w in pooled.items())) < 1e-9
        assert (got[k]["q16"], got[k]["q84"]) == (q16, q84)
