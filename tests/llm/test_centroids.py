"""Centroid clustering against plain k-means in integers."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from marketlens.llm import centroids as C

SCHEMA = "vec_id long, embedding array<double>, row long, cluster string, v int"


def plain(rows, width, clusters, rounds):
    kept = [(i, [max(-C.LARGEST, min(C.LARGEST, math.floor(1024 * x))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    middle = [v for _, v in sorted(kept, key=key)[:clusters]]
    far = lambda v: [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in middle]
    for _ in range(rounds):
        of = [min(range(len(middle)), key=far(v).__getitem__) for _, v in kept]
        for c in range(len(middle)):
            own = [v for (_, v), o in zip(kept, of, strict=True) if o == c]
            if own:
                middle[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, min((d, c) for c, d in enumerate(far(v)))) for i, v in kept]
    total = [sum(d for _, (d, o) in found if o == c) for c in range(len(middle))]
    held = lambda x: min(x, 2**63 - 1)
    return sorted((str(i), c, d, held(total[c]), held(sum(total)), hashlib.sha256(",".join(map(str, middle[c])).encode()).hexdigest()) for i, (d, c) in found)


def got(spark, rows, width=5, clusters=8, rounds=10, **more):
    df = spark.createDataFrame([(i, v, 7, "c", 1) for i, v in rows], SCHEMA).repartition(3)
    out = C.centroid_clusters(df, clusters, rounds, components=width, **more).collect()
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out)


def test_clusters_equal_plain(spark):
    rnd = np.random.default_rng(8)
    base = np.concatenate([rnd.normal(size=(120, 5)) + 3 * rnd.normal(size=5) for _ in range(4)]).round(4)
    base[50:200] = base[7]  # a third are copies
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(3, rows[3][1]), (3, rows[9][1]), (None, rows[11][1]), (None, [0.0] * 5), (900, None), (901, []), (902, [1.0] * 4), (903, [None] + [1.0] * 4), (904, [float("inf")] + [1.0] * 4), (905, [float("nan")] * 5)]
    rows += [(950, [40.0] * 5), (951, [-60.0, 0.0, 0.0, 0.0, 0.0])]  # far beyond the cells
    assert got(spark, rows, buckets=4) == plain(rows, 5, 8, 10)
    assert got(spark, rows, clusters=3, rounds=2) == plain(rows, 5, 3, 2)


def test_few_equal_and_no_vectors(spark):
    same = [(i, [1.0, -2.0, 0.5, 0.0, 3.0]) for i in range(12)]  # equal centroids: all rows go to the first, the others stay empty
    assert got(spark, same) == plain(same, 5, 8, 10)
    assert got(spark, same[:3]) == plain(same[:3], 5, 8, 10)
    assert got(spark, []) == [] and got(spark, [(1, [1.0])]) == []


def test_large_components(spark):
    rows = [(i, [x, x / 3, 1.0, 0.0, -x]) for i, x in enumerate([1e304, -1e304, 1e5, 2e4, -7e4, 1.0, 2.0, 3.0, 1e300, 5.0, 6.0])]
    assert got(spark, rows, clusters=3) == plain(rows, 5, 3, 10)


def test_intervals_hold_the_nearest():
    rnd = np.random.default_rng(1)
    v, middle = rnd.integers(-900, 900, (3000, 12)), rnd.integers(-500, 500, (6, 12))
    edges = C.cell_edges(v[:500])
    cells, inside = C.cells_of(v, edges)
    assert inside.mean() > 0.9 and ((v < edges[-1]) & (v >= edges[0])).all(axis=1).tolist() == inside.tolist()
    low, high = C.tables(edges, middle)
    far, found = C.squared(v, middle), C.assigned(cells, low, high)
    sure = (found >= 0) & inside
    assert 0.3 < sure.mean() < 1 and (far.argmin(axis=1)[sure] == found[sure]).all()
    assert far.tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, c, strict=True)) for c in middle] for x in v]


def test_a_round_has_no_shuffle_and_fetches_few_vectors(spark):
    rnd = np.random.default_rng(2)
    base = np.concatenate([rnd.normal(size=(400, 5)) + 6 * rnd.normal(size=5) for _ in range(4)])
    rows = C.integers(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>"), 5).withColumn("row", F.col("vec_id"))
    v = np.array([r.v for r in rows.orderBy("row").collect()])
    edges, middle = C.cell_edges(v), np.array([v[i * 400 : i * 400 + 400].mean(axis=0).astype(int) for i in range(4)])
    vectors = C.bucketed(rows.select("row", "v").repartition(4, "row"), 4, "vectors")
    nearest = spark.createDataFrame(list(enumerate(C.squared(v, middle).argmin(axis=1).tolist())), "row long, cluster int")
    cells = C.bucketed(C.approximated(rows, edges).repartition(4, "row"), 4, "cells")
    state = C.bucketed(nearest.repartition(4, "row"), 4, "state")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = C.decided(spark.table(cells[0]), spark.table(state[0]), edges, middle)
        kept = C.bucketed(found, 4, "decided")
        out = C.fetched(spark.table(kept[0]), spark.table(vectors[0]), middle)
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (found, out)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert all("SortMergeJoin" in plan and "Exchange" not in plan for plan in plans)
    assert "v#" not in plans[0]  # the cells alone
    sure = C.assigned(C.cells_of(v, edges)[0], *C.tables(edges, middle)) >= 0
    assert sure.mean() > 0.8 and out.filter("v is not null").count() == 0  # nothing moves
    for made in (vectors, cells, state, kept):
        C.dropped(spark, *made)
        assert not spark.catalog.tableExists(made[0])


def test_a_bucket_is_one_file_with_more_tasks_than_buckets(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rnd.normal(size=(900, 5)).round(4))]
    made, real = {}, C.bucketed

    def counted(df, buckets, name):
        out = real(df, buckets, name)
        made.setdefault(name, []).append(len(spark.table(out[0]).inputFiles()))
        return out

    monkeypatch.setattr(C, "bucketed", counted)
    for name in ("repartition", "repartitionById"):  # a session that deals out to 30 tasks at least
        deal = getattr(type(spark.range(0)), name)
        monkeypatch.setattr(type(spark.range(0)), name, lambda self, n, *by, deal=deal: deal(self, max(n, 30) if by else n, *by))
    assert got(spark, rows, rounds=2, buckets=4) == plain(rows, 5, 8, 2)
    assert made["vectors"] == made["cells"] == [4]
    assert max(n for files in made.values() for n in files) <= 4
