"""Plans and results that matter only on large tables."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph_ops, kernels, local_kernels, lsh
from graphloom.sources import readers, writers


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sequences_are_not_broadcast(spark, tmp_path, monkeypatch):
    kept, keep = [], readers.keep
    monkeypatch.setattr(readers, "keep", lambda df: kept.append(planned(df)) or keep(df))
    (tmp_path / "s").write_text("AB\n\nXYZ\n")
    v, e = readers.read_sequences(spark, str(tmp_path / "s"), directed=True)
    assert sorted((r.gid, r.src, r.dst) for r in e.collect()) == [(0, 1, 0), (1, 1, 0), (1, 2, 1)]
    assert "SortMergeJoin [gid" in kept[-1] and "BroadcastHashJoin" not in planned(e)


def test_models_are_written_in_several_lines(spark, tmp_path):
    model = spark.range(-1, 120_000).select(F.col("id").alias("fid"), (F.col("id") / 4).alias("w"))
    writers.write_text(writers.model_lines(model), str(tmp_path / "m"))
    heads = [r.n for r in spark.read.text(str(tmp_path / "m")).select(F.length("value").alias("n")).collect()]
    assert len(heads) == 5 and max(heads) < 1_000_000
    assert readers.read_model(spark, str(tmp_path / "m")).exceptAll(model).count() == 0
    assert readers.read_model(spark, str(tmp_path / "m")).count() == 120_001


def test_pairs_are_not_broadcast_and_are_shuffled_once(spark, monkeypatch):
    kept, keep = [], graph_ops.keep
    monkeypatch.setattr(graph_ops, "keep", lambda df: kept.append(planned(df)) or keep(df))
    rows = spark.createDataFrame([(g, t, "AABAC"[t]) for g in (1, 2) for t in range(5 - g)], "u int, t int, l string")
    v, e = (keep(t) for t in graph_ops.sequences(rows, "u", ["t"], F.col("l")))
    d, codes = graph_ops.bounded_distances(v, e, 2), keep(kernels.vertex_codes(v, e, 1))
    by_vertex, whole = kernels.pair_features(v, d, codes), kernels.pair_features(v, d, codes, by_vertex=False)
    assert len(kept) == 3 and "BroadcastHashJoin" not in "".join(kept) + planned(whole)
    summed = by_vertex.groupBy("gid", "r", "d", "fid").agg(F.sum("count").alias("count"))
    assert summed.count() == whole.count() and summed.exceptAll(whole).count() == 0


def test_graphs_reach_a_kernel_in_batches_and_equal_shapes_are_hashed_once(spark, monkeypatch):
    rows = [(g, t, "ABCA"[t], True, True, True, False, False) for g in range(40) for t in range(4)]
    v = spark.createDataFrame(rows, "gid bigint, vid int, label string, is_viewpoint boolean, is_kernel_point boolean, kind boolean, is_dead boolean, is_abstraction boolean")
    ties = [(g, s, s + 1, "-", False, False, False) for g in range(40) for s in range(3)]
    e = spark.createDataFrame(ties + [(g, d, s, *rest) for g, s, d, *rest in ties], "gid bigint, src int, dst int, label string, is_dead boolean, is_abstraction_of boolean, is_part_of boolean")
    found = local_kernels.local_features(v, e, "USPK", local_kernels.Config(radius=1, distance=2))
    assert "gid" not in planned(found).split("FlatMapCoGroupsInArrow [")[1].split("]")[0]
    per = {}
    for r in found.collect():
        per.setdefault(r.gid, {})[r.fid] = r.value
    assert len(per) == 40 and all(x == per[0] for x in per.values())
    calls, real = [], local_kernels.Graph._canonical
    monkeypatch.setattr(local_kernels.Graph, "_canonical", lambda g, *a: calls.append(a) or real(g, *a))
    local_kernels.SHAPES.clear()
    for gid in range(3):
        g = local_kernels.assemble([r[1:5] + r[6:] for r in rows if r[0] == gid], [], local_kernels.Config(radius=1, distance=2))
        assert local_kernels.path_cells(g)[0, 0] == {real(g, {0}, 0): 4.0, real(g, {1}, 1): 2.0, real(g, {2}, 2): 2.0}
    assert len(calls) == 3


def test_buckets_are_not_broadcast(spark):
    signed = spark.createDataFrame([(g, s, 7 + g // 3) for g in range(9) for s in range(3)], "gid bigint, slot int, key bigint")
    indexed = lsh.index(signed, most=4)
    met = lsh.candidates(signed, indexed)
    assert sorted((r.gid, r.nid, r.hits) for r in met.collect()) == [(g, n, 3) for g in range(9) for n in range(9) if g // 3 == n // 3]
    assert "BroadcastHashJoin" not in planned(indexed) and "BroadcastHashJoin" not in planned(met)
