"""Hashes, graph operators and kernels on small graphs worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import hashing, stats
from graphloom.operators import density, graph_ops, graphs, kernels, learning, local_kernels, lsh, records, sampling, skew, vectors_ops
from graphloom.sources.readers import both_ways, edge_rows, vertex_rows


def graph(spark, labels, edges, gid=0, order=None):
    order = order or list(range(len(labels)))
    v = vertex_rows(spark.createDataFrame([(gid, order[i], t) for i, t in enumerate(labels)], "gid bigint, vid int, label string"))
    e = edge_rows(spark.createDataFrame([(gid, order[a], order[b], t) for a, b, t in edges], "gid bigint, src int, dst int, label string"))
    return v, both_ways(e)


PATH = ("ABC", [(0, 1, "-"), (1, 2, "-")])
TAIL = ("ABCD", [(0, 1, "x"), (1, 2, "x"), (0, 2, "x"), (2, 3, "y")])


def features(spark, shape, kernel="NSPDK", order=None, **options):
    rows = local_kernels.local_features(*graph(spark, *shape, order=order), kernel, local_kernels.Config(**options)).collect()
    return {r.fid: round(r.value, 9) for r in rows}


def test_hash_columns_equal_plain_python(spark):
    texts = ["", "a", "click", "naïve café", "x" * 40]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(hashing.hash_text("t").alias("h")).collect()
    assert [r.h for r in got] == [hashing.py_hash(t) for t in texts]
    row = spark.range(1).select(hashing.hash_values(3, 5, 70000, 2**32 - 1, bits=30).alias("a"), hashing.hash_array(F.array(*[F.lit(x).cast("bigint") for x in (3, 5, 70000, 2**32 - 1)]), 30).alias("b")).first()
    assert row.a == row.b == hashing.py_hash([3, 5, 70000, 2**32 - 1], 30)
    keys = [(0, 1), (5, 3), (32767, 10), (2**40 + 7, 2)]
    got = spark.createDataFrame(keys, "k bigint, s int").select(hashing.int_hash(F.col("k"), F.col("s")).alias("h")).collect()
    assert [r.h for r in got] == [hashing.py_int_hash(k & 0xFFFFFFFF, s) for k, s in keys]
    assert all(0 <= r.h < 2**31 for r in got)


def test_prefix_states_end_like_the_hash():
    codes = np.frombuffer(b"hello", np.int8)
    assert hashing.prefix_states(codes, 5)[0, 4] & 32767 == hashing.py_hash("hello")
    assert hashing.prefix_states(codes, 5)[3, 4] == 0


def test_distances_balls_and_paths(spark):
    v, e = graph(spark, *TAIL)
    d = graph_ops.bounded_distances(v, e, 3)
    got = {(r.src, r.dst): r.d for r in d.collect()}
    assert got[0, 3] == 2 and got[0, 0] == 0 and got[3, 1] == 2 and len(got) == 16
    assert graph_ops.ball(d, 1).where("root = 2").count() == 4
    union = {r.vid for r in graph_ops.path_unions(d, 2, 2).where("src = 0 and dst = 3").collect()}
    assert union == {0, 2, 3}
    assert graph_ops.pair_distance(spark.createDataFrame([(0, 0, 9)], "gid bigint, src int, dst int"), d).first().d == -1
    assert graph_ops.bfs_dag(d, e).where("root = 0").count() == 3
    assert graph_ops.unsound(v, d).count() == 0


def test_diamond_keeps_both_parents(spark):
    v, e = graph(spark, "ABCD", [(0, 1, "-"), (0, 2, "-"), (1, 3, "-"), (2, 3, "-")])
    dag = graph_ops.bfs_dag(graph_ops.bounded_distances(v, e, 2), e).where("root = 0 and child = 3")
    assert {r.parent for r in dag.collect()} == {1, 2}


def test_dead_and_abstract_vertices_are_not_entered(spark):
    v, e = graph(spark, *PATH)
    assert graph_ops.bounded_distances(graph_ops.kill_by_label(v, "B"), e, 2).where("d > 0").count() == 0
    assert graph_ops.missing_ends(e.withColumn("dst", F.lit(9)), v).count() == 3


@pytest.mark.parametrize("kernel", ["NSPDK", "SK", "USPK", "WDK", "PBK", "DDK", "NSDDK", "ANSDDK"])
def test_kernels_do_not_depend_on_numbering(spark, kernel):
    options = {"radius": 2, "distance": 2, "radius_two": 1}
    one, two = features(spark, TAIL, kernel, **options), features(spark, TAIL, kernel, order=[2, 0, 3, 1], **options)
    assert one == two and one
    if kernel not in ("NSDDK", "ANSDDK"):
        assert math.isclose(sum(x * x for x in one.values()), 1, abs_tol=1e-6)


def test_plan_and_local_kernel_agree(spark):
    v, e = graph(spark, *TAIL)
    plan = {r.fid: round(r.value, 9) for r in kernels.nspdk(v, e, graph_ops.bounded_distances(v, e, 3), 1).collect()}
    assert plan == features(spark, TAIL, radius=1, distance=3)


def test_hub_has_code_one(spark):
    v, e = graph(spark, "A" + "B" * 11, [(0, i, "-") for i in range(1, 12)])
    assert kernels.vertex_codes(v, e, 1).where("vid = 0").select("code").distinct().first().code == 1


def test_abstract_vertex_needs_both_sides(spark):
    v, e = graph(spark, "AB", [(0, 1, "-")])
    top = vertex_rows(spark.createDataFrame([(0, 2, "^L", False, False, True)], "gid bigint, vid int, label string, is_viewpoint boolean, is_kernel_point boolean, is_abstraction boolean"))
    sides = edge_rows(spark.createDataFrame([(0, 2, 0, "@-", False, True), (0, 2, 1, "^-", True, False)], "gid bigint, src int, dst int, label string, is_abstraction_of boolean, is_part_of boolean"))
    d = graph_ops.bounded_distances(v.unionByName(top), e.unionByName(sides), 1)
    codes = kernels.vertex_codes(v.unionByName(top), e.unionByName(sides), 0)
    assert kernels.abstraction_features(v.unionByName(top), e.unionByName(sides), d, codes).count() == 2
    with pytest.raises(Exception, match="abstract"):
        kernels.abstraction_features(v.unionByName(top), e.unionByName(sides.where("is_part_of")), d, codes).collect()


def test_directed_copy(spark):
    v, e = graph(spark, "AB", [(0, 1, "-")])
    rv, re = graph_ops.reversed_copy(v, e.where("src = 0"))
    assert {(r.vid, r.label) for r in rv.collect()} == {(0, "A"), (1, "B"), (2, "r.A"), (3, "r.B")}
    assert {(r.src, r.dst) for r in re.collect()} == {(0, 1), (3, 2)}


def test_string_kernel_counts_every_place(spark):
    texts = spark.createDataFrame([(1, "abab"), (2, ""), (3, None), (4, "x" * 3000)], "gid bigint, text string")
    got = kernels.string_positions(texts, 0, 0)
    assert {r.gid: r.c for r in got.groupBy("gid").agg(F.sum("value").alias("c")).collect()} == {1: 8, 4: 6000}
    assert {r.vid for r in got.where("gid = 1").collect()} == {0, 1, 2, 3}
    vectors = kernels.string_vectors(texts, 1, 2)
    assert {r.gid: round(r.n, 9) for r in vectors.groupBy("gid").agg(F.sum(F.col("value") * F.col("value")).alias("n")).collect()} == {1: 1.0, 4: 1.0}
    assert {r.fid for r in kernels.string_vectors(texts, 0, 0).where("gid = 1").collect()} == {r.fid for r in got.where("gid = 1").collect()}


def test_minimum_kernel_and_rehash(spark):
    f = spark.createDataFrame([(0, 1, 2.5), (0, 2, 0.4)], "gid bigint, fid bigint, value double")
    assert kernels.minimum_kernel(f, 30).count() == 4
    assert kernels.rehash(f, 42, 30).count() == 2


def test_real_vectors_are_projected(spark):
    f = spark.createDataFrame([(0, 1, [1.0] * 30), (0, 2, None)], "gid bigint, fid bigint, vec array<double>")
    rows = kernels.real_vector_features(f, 4).collect()
    assert len(rows) <= 4 and all(abs(r.value) <= 30 * math.sqrt(3) + 1e-9 for r in rows)


def test_components(spark):
    pairs = [(1, 2), (2, 3), (10, 11), (5, 5)] + [(i, i + 1) for i in range(100, 140)]
    got = {r.id: r.component for r in graphs.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got[3] == 1 and got[11] == 10 and got[5] == 5 and got[140] == 100
    assert graphs.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_current_vectors(spark):
    t = "timestamp '2024-01-0{} 00:00:00'"
    rows = [f"(1, 5, 1.0D, {t.format(1)})", f"(1, 5, 2.0D, {t.format(2)})", f"(1, 5, 3.0D, {t.format(2)})", f"(1, 6, 4.0D, {t.format(1)})", f"(1, 6, null, {t.format(3)})", f"(2, 7, 0.0D, {t.format(1)})", f"(null, 7, 1.0D, {t.format(1)})", "(3, 8, 9.0D, null)", f"(3, 9, double('NaN'), {t.format(1)})"]
    df = spark.sql("select cast(a as bigint) gid, cast(b as bigint) fid, c value, d loaded_at, 'x' id from values " + ", ".join(rows) + " as v(a, b, c, d)")
    got = {r.id: (r.fids, r.vals) for r in records.current_vectors(df.unionByName(df)).collect()}
    assert got == {1: ([5], [3.0]), 3: ([8], [9.0])}
    assert records.current_vectors(df.limit(0)).count() == 0


def test_salted_lookup_keeps_every_row(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    got = skew.with_key_counts(rows, ["k"], 3000, "n")
    assert got.count() == 3000 and got.where("k = 7 and n = 1000").count() == 1000
    assert skew.with_key_counts(rows, ["k"], 3000, "n", least=2).count() == 1000


def test_neighbours_and_density(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 4)) + np.repeat(np.eye(3, 4) * 6, 10, axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    e = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "gid bigint, x array<double>")
    gram = {(r.gid_a, r.gid_b): r.k for r in vectors_ops.dense_dots(e, e, 3).collect()}
    assert len(gram) == 900 and np.allclose([gram[i, j] for i in range(30) for j in range(30)], (x @ x.T).ravel())
    f = vectors_ops.dense_features(e)
    near = lsh.exact_neighbours(f, f, 5)
    assert near.where("rank = 1 and gid = nid").count() == 30
    mutual = {(r.gid, r.nid) for r in lsh.mutual(near).collect()}
    assert mutual == {(b, a) for a, b in mutual}
    d = density.local_density(near)
    pd_ = density.voronoi_density(near, vectors_ops.dot_products(f, f))
    assert math.isclose(pd_.agg(F.sum("p")).first()[0], 1, rel_tol=1e-9)
    clusters = density.quick_shift_clusters(near, d)
    assert clusters.count() == 30 and 3 <= clusters.select("cluster").distinct().count() < 30
    approx = lsh.approximate_neighbours(lsh.sparsified(e), lsh.sparsified(e), 5)
    assert lsh.accuracy(approx, lsh.exact_neighbours(lsh.sparsified(e), lsh.sparsified(e), 5), 5).agg(F.avg("accuracy")).first()[0] > 0.3


def test_order_statistic_is_kept(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 5.0), ("c", -1.0)], "k string, v double")
    got = {r.k: r.m for r in stats.grouped_order_statistic(rows, ["k"], "v", {"m": 0.5}).collect()}
    assert got["a"] == 3.0 and got["b"] == 5.0
    assert {r.k for r in stats.summary(rows, ["k"], "v").collect()} == {"a", "b"}


def test_training_separates(spark):
    rng = np.random.default_rng(1)
    rows, ys = [], []
    for i in range(60):
        y = 1.0 if i % 4 == 0 else -1.0
        ys.append((i, y))
        rows += [(i, f, float(v)) for f, v in enumerate(rng.normal(size=3) * 0.2 + np.array([y, -y, 0.0]))]
    f, t = spark.createDataFrame(rows, "gid bigint, fid bigint, value double"), spark.createDataFrame(ys, "gid bigint, y double")
    model = learning.train(f, t)
    scored = learning.predict(f, model).join(t, "gid")
    assert learning.metrics(scored).first().errors == 0
    cv = learning.cross_validate(f, t, 3)
    assert cv.count() == 60 and learning.metrics(cv).first().f_balanced > 0.95
    assert learning.learning_curve(f, t, 3).select("point").distinct().count() == 2
    balanced = sampling.class_balanced(t).groupBy("y").count().collect()
    assert {r["count"] for r in balanced} == {45}
    single = learning.train(f.where("gid % 4 = 0"), t.where("y > 0"))
    assert learning.predict(f, single).where("gid = 0").first().prediction == 1.0


def test_sampling(spark):
    ids = spark.range(1000).withColumnRenamed("id", "gid")
    assert sampling.partitioned(ids, 0.3).where("chosen").count() == 300
    draws, out = sampling.bootstrap(ids)
    assert draws.count() == 1000 and 250 < out.count() < 480
    assert sampling.random_instances(spark, 20, 10, 0.5).select("gid").distinct().count() <= 20


def test_large_buckets_lose_no_neighbour(spark):
    def value(g, f):
        return 1.0 + (g * 31 + f * 17) % 23 / 100

    rows = [(g, f, value(g, f)) for g in range(150) for f in range(30)]  # all signatures equal, all buckets too large
    rows += [(g, 1000 + g // 5 * 40 + f, value(g, f)) for g in range(150, 200) for f in range(30)]
    f = spark.createDataFrame(rows, "gid bigint, fid bigint, value double")
    exact = lsh.exact_neighbours(f, f, 5)
    got = lsh.accuracy(lsh.approximate_neighbours(f, f, 5, most=100), exact, 5).agg(F.avg("accuracy"), F.count("*")).first()
    assert got[0] >= 0.9 and got[1] == 200
    dropped = lsh.accuracy(lsh.approximate_neighbours(f, f, 5, most=100, whole=False), exact, 5).where("gid < 150").agg(F.max("accuracy")).first()[0]
    assert dropped == 0


def test_kept_tables_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from graphloom.store import shared_folder

    conf = SimpleNamespace(get=lambda *_: None)
    session = lambda master: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="x", getConf=lambda: conf))
    assert shared_folder(session("local[2]")).startswith("file://") and shared_folder(session("local")).startswith("file://")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session("spark://host:7077"))


def test_dense_neighbours_and_products_equal_the_whole_matrix(spark):
    e = spark.createDataFrame([(i, [float(i % 5), float(i % 3), 1.0]) for i in range(30)], "gid bigint, x array<double>")
    dots = {(r.gid_a, r.gid_b): r.k for r in vectors_ops.dense_dots(e, e).collect()}
    want = {i: sorted(range(30), key=lambda j: (-dots[i, j], j))[:4] for i in range(30)}
    near = vectors_ops.dense_neighbours(e, e, 4, block_rows=7)
    assert {i: [r.nid for r in sorted(near.where(f"gid = {i}").collect(), key=lambda r: r["rank"])] for i in (0, 7, 29)} == {i: want[i] for i in (0, 7, 29)}
    pairs = {(r.gid_a, r.gid_b): r.k for r in vectors_ops.neighbour_products(near, e).collect()}
    assert pairs == {p: dots[p] for p in pairs} and {(a, b) for l in want.values() for a in l for b in l if a != b} == set(pairs)
    assert vectors_ops.dense_neighbours(e.limit(0), e.limit(0)).count() == 0
