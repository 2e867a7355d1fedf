"""Readers, writers, actions and streaming."""

import gzip
import struct

import pytest
from pyspark.sql import functions as F

from graphloom.plans.actions import RUN, run, save
from graphloom.plans.options import ACTIONS, Options
from graphloom.sources import readers, writers
from graphloom.streaming import scoring

GRAPHS = "t # 0\nv 0 A\nV 1 B\nW 2 C vec: 1.5 2\ne 0 1 x\ne 1 2 y\n\nt # 1\nv 0 A\nv 1 ^L\nv 2 B\ne 1 0 @-\ne 1 2 ^-\nignored line\n"


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_graph_text(spark, tmp_path):
    with gzip.open(tmp_path / "g.gz", "wt") as f:
        f.write(GRAPHS)
    v, e = readers.read_graphs(spark, str(tmp_path / "g.gz"), real_vectors=True)
    rows = {(r.gid, r.vid): r for r in v.collect()}
    assert len(rows) == 6 and not rows[0, 1].is_viewpoint and not rows[0, 2].is_kernel_point and rows[0, 2].vec == [1.5, 2.0]
    assert rows[1, 1].is_abstraction and not rows[1, 1].is_viewpoint
    assert e.where("gid = 0").count() == 4 and e.where("is_part_of").count() == 2
    assert readers.read_graphs(spark, str(tmp_path / "g.gz"), directed=True)[1].count() == 4


@pytest.mark.parametrize("text,message", [("t\nv 0\n", "label"), ("t\nv 0 A\ne 0 9 x\n", "unknown end")])
def test_malformed_graphs_raise(spark, tmp_path, text, message):
    with pytest.raises(Exception, match=message):
        [t.collect() for t in readers.read_graphs(spark, write(tmp_path, "bad", text))]


def test_sequences(spark, tmp_path):
    v, e = readers.read_sequences(spark, write(tmp_path, "s", "AB|CD\n\nXY\n"), pairwise=True)
    assert v.where("gid = 0").count() == 5 and v.where("gid = 1").count() == 2
    assert e.where("gid = 0 and label = '-'").count() == 4 and e.where("is_part_of").count() == 2 and e.where("is_abstraction_of").count() == 2
    v, e = readers.read_sequences(spark, write(tmp_path, "m", "a b c\n1 2 3\n"), degree=2, tokens=True)
    assert [r.label for r in v.orderBy("vid").collect()] == ["a", "1", "b", "2", "c", "3"] and v.where("is_viewpoint").count() == 3
    assert e.count() == 2 * (3 + 2)
    with pytest.raises(Exception, match="parallel"):
        readers.read_sequences(spark, write(tmp_path, "r", "a b c\n1 2\n"), degree=2, tokens=True)[0].collect()


def test_numbers_targets_and_models(spark, tmp_path):
    got = readers.read_targets(spark, write(tmp_path, "t", "1 -1\n0\n\n1\n")).orderBy("gid").collect()
    assert [(r.gid, r.y) for r in got] == [(0, 1.0), (1, -1.0), (2, 0.0), (3, 1.0)]
    assert readers.read_multilabel(spark, write(tmp_path, "ml", "1 -1\n-1 1\n")).count() == 4
    with pytest.raises(ValueError, match="width"):
        readers.read_multilabel(spark, write(tmp_path, "rag", "1 -1\n-1 1 1\n"))
    with pytest.raises(ValueError, match="not a model"):
        readers.read_model(spark, write(tmp_path, "nomodel", "bias 1\n"))
    assert {r.fid: r.w for r in readers.read_model(spark, write(tmp_path, "model_0", "bias 0.5\nwscale 2\nw 3:1 4:-1\n")).collect()} == {-1: 0.5, 3: 2.0, 4: -2.0}
    assert readers.read_models(spark, str(tmp_path)).select("task").distinct().count() == 1
    with pytest.raises(FileNotFoundError):
        readers.read_models(spark, str(tmp_path / "none"))
    assert readers.read_coordinates(spark, write(tmp_path, "c", "1 2\n3 4\n")).count() == 2


def test_sparse_round_trips(spark, tmp_path):
    f = readers.read_sparse(spark, write(tmp_path, "v", "1:0.5 7:2 junk\n3:1\n"))
    assert f.count() == 3
    line = writers.sparse_lines(f).orderBy("gid").first().line
    assert line == " 1:5.000000000e-01 7:2.000000000e+00"
    data = b"".join(r.data for r in writers.sparse_binary(f).orderBy("gid").collect())
    (tmp_path / "b.bin").write_bytes(data)
    back = readers.read_sparse_binary(spark, str(tmp_path / "b.bin"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, f.collect()))
    (tmp_path / "cut.bin").write_bytes(struct.pack("<i", 9))
    with pytest.raises(Exception, match="truncated"):
        readers.read_sparse_binary(spark, str(tmp_path / "cut.bin")).collect()


def test_molecules(spark, tmp_path):
    text = "\n".join(["m", "", "", "  2  1  0  0  0  0            999 V2000", "    0.0       0.0       0.0    C   0  0", "    0.0       0.0       0.0    O   0  0", "  1  2  2  0", "M  END", "$$$$", ""])
    v, e = readers.read_molecules(spark, write(tmp_path, "m.sdf", text))
    assert [r.label for r in v.orderBy("vid").collect()] == ["6", "8"] and {r.label for r in e.collect()} == {"d"} and e.count() == 2


def test_attribute_nodes(spark, tmp_path):
    got = readers.read_attribute_nodes(spark, write(tmp_path, "n", "# 1\nv 4 a = 1 , b = x\n/ note\n")).first()
    assert got.id == 4 and got.attributes == {"a": "1", "b": "x"}


def test_exports_read_back(spark, tmp_path):
    v, e = readers.read_graphs(spark, write(tmp_path, "g", "t\nv 0 A\nV 1 B\nv 2 A\ne 0 1 x\ne 1 2 y\n"))
    text = writers.export("gspan", v, e).first().text
    v2, e2 = readers.read_graphs(spark, write(tmp_path, "again", text))
    assert sorted(map(str, v2.collect())) == sorted(map(str, v.collect())) and sorted(map(str, e2.collect())) == sorted(map(str, e.collect()))
    for name in ("dot", "gml", "gdl"):
        assert '"A"' in writers.export(name, v, e).first().text
    assert writers.export("csv", v, e).count() == 2
    m = writers.export("matrix", v, e).first()
    assert m.am == "0 1 0\n1 0 1\n0 1 0" and m.al == "1\n0 2\n1" and m.nl == "A B A"
    assert writers.serialise(v, e).first().text.startswith("0:A 1:B 2:A 0>1:x")
    assert {r.label: r.colour for r in writers.label_colours(v).collect()} == {"A": "red", "B": "green"}
    with pytest.raises(ValueError, match="unknown format"):
        writers.export("svg", v, e)


def test_options_are_checked():
    assert Options(action="TRAIN")["epochs"] == 10 and set(RUN) == set(ACTIONS) and len(ACTIONS) == 21
    for bad, error in (({"colour": 1}, KeyError), ({"radius": "x"}, TypeError), ({"kernel_type": "NO"}, ValueError), ({"smooth": True}, ValueError)):
        with pytest.raises(error):
            Options(**bad)
    assert "--radius (2)" in Options.describe()


@pytest.fixture(scope="module")
def inputs(spark):
    rows = [(i, f, 1.0 + (i * f) % 3) for i in range(24) for f in range(8) if (i + f) % 3 or f == (0 if i % 2 else 1)]
    f = spark.createDataFrame([(i, f * 10 + (i % 2), v) for i, f, v in rows], "gid bigint, fid bigint, value double")
    return {"features": f, "targets": spark.createDataFrame([(i, 1.0 if i % 2 else -1.0) for i in range(24)], "gid bigint, y double")}


@pytest.mark.parametrize("action", ["FEATURE", "MATRIX", "NEAREST_NEIGHBOR", "CLUSTER", "DENSITY", "PRE_CLUSTER_FILTER", "TRAIN", "CROSS_VALIDATION", "SEMI_SUPERVISED", "TARGET_ALIGNMENT", "EMBED"])
def test_actions_on_tables(spark, inputs, action):
    options = Options(action=action, num_nearest_neighbors=4, epochs=2, num_cross_validation_folds=2, embed_iterations=5)
    results = run(spark, options, **inputs)
    assert results and all(t.count() >= 1 for t in results.values())


def test_train_save_test(spark, inputs, tmp_path):
    options = Options(action="TRAIN", output_directory_path=str(tmp_path))
    save(run(spark, options, **inputs), options)
    model = spark.read.parquet(str(tmp_path / "model"))
    text = readers.read_model(spark, str(tmp_path / "model.txt"))
    a, b = {r.fid: r.w for r in model.collect()}, {r.fid: r.w for r in text.collect()}
    assert set(a) == set(b) and all(abs(a[f] - b[f]) < 1e-9 for f in a)
    margins = run(spark, Options(action="TEST"), features=inputs["features"], model=model)
    assert margins["prediction"].join(inputs["targets"], "gid").where("prediction <> y").count() == 0


def test_graph_actions_from_files(spark, tmp_path):
    path = write(tmp_path, "g", "t\nv 0 A\nv 1 B\ne 0 1 x\nt\nv 0 A\nv 1 C\ne 0 1 x\n")
    for action in ("FEATURE", "FEATURE_PART", "MIN_HASH"):
        assert all(t.count() for t in run(spark, Options(action=action, input_data_file_name=path, radius=1, distance=1)).values())
    with pytest.raises(NotImplementedError):
        run(spark, Options(action="FEATURE_PART", input_data_file_name=path, kernel_type="DDK"))


def test_streams_equal_batches(spark, inputs, tmp_path):
    from graphloom.operators import learning, lsh

    packed = learning.packed(inputs["features"])
    packed.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(packed.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    model = learning.train(inputs["features"], inputs["targets"])
    scoring.score_stream(stream, model, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    whole = learning.predict(inputs["features"], model)
    rounded = lambda d: sorted((r.gid, round(r.margin, 9), r.prediction) for r in d.collect())
    assert rounded(spark.read.parquet(str(tmp_path / "out"))) == rounded(whole)
    scoring.count_buckets(stream, str(tmp_path / "buckets"), str(tmp_path / "c2"), 40, 4).awaitTermination()
    batch = lsh.signatures(inputs["features"], 40, 4).groupBy("slot", "key").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, scoring.bucket_totals(spark, str(tmp_path / "buckets")).collect())) == sorted(map(tuple, batch.collect()))


@pytest.mark.parametrize("name,value", [("num_random_projections", 3), ("use_real_vector_information", True), ("open_babel_file_format", "mol"), ("refine_neighborhood_size", 5), ("neighborhood_size_range", 2)])
def test_missing_options_raise(name, value):
    with pytest.raises(NotImplementedError):
        Options(action="TRAIN", **{name: value})


def test_many_labels_are_saved_and_read(spark, inputs, tmp_path):
    y = inputs["targets"]
    tasks = y.withColumn("task", F.lit(0)).unionByName(y.select("gid", (-F.col("y")).alias("y"), F.lit(1).alias("task")))
    options = Options(action="TRAIN_MULTILABEL", output_directory_path=str(tmp_path), epochs=2)
    save(run(spark, options, features=inputs["features"], task_targets=tasks), options)
    got = run(spark, Options(action="TEST_MULTILABEL", output_directory_path=str(tmp_path)), features=inputs["features"])["margin"]
    right = got.join(tasks, ["gid", "task"]).where(F.signum("margin") == F.col("y")).count()
    assert got.count() == 48 and right == 48


def test_regularised_training_and_search_from_a_graph_file(spark, tmp_path):
    graphs = "".join(f"t\nv 0 {'A' if i % 2 else 'C'}\nv 1 B\nv 2 D\ne 0 1 x\ne 1 2 x\n" for i in range(8))
    path, y = write(tmp_path, "g", graphs), write(tmp_path, "y", "\n".join("1" if i % 2 else "-1" for i in range(8)) + "\n")
    common = {"input_data_file_name": path, "target_file_name": y, "radius": 0, "distance": 1, "epochs": 3}
    models = [{r.fid: r.w for r in run(spark, Options(action="TRAIN", **common, **extra))["model"].collect()} for extra in ({}, {"topological_regularization_num_neighbors": 2, "topological_regularization_decay_rate": 0.05})]
    assert models[0] != models[1]
    tried = run(spark, Options(action="PARAMETERS_OPTIMIZATION", **{**common, "epochs": 1}, num_line_search_iterations=1, num_cross_validation_folds=2))["opt_param"]
    rows = tried.collect()
    assert {r.radius for r in rows} == {0, 1} and {r.distance for r in rows} == {0, 1, 2} and any(r.best for r in rows)


def test_embedding_keeps_the_best_trial(spark):
    near = spark.createDataFrame([(i, (i + d) % 12, 0.9) for i in range(12) for d in (-1, 1)], "gid bigint, nid bigint, k double")
    from graphloom.operators.learning import embed

    single = [embed(near, iterations=30, seed=s).first().distortion for s in (1, 2, 3)]
    best = embed(near, iterations=30, seed=1, restarts=3).collect()
    assert len(best) == 12 and best[0].distortion == min(single)
    start = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(12)], "gid bigint, x array<double>")
    assert {r.gid: r.x for r in embed(near, iterations=0, start=start).collect()} == {i: [float(i), 0.0] for i in range(12)}


def test_self_training_takes_quantiles_by_sign(spark):
    from graphloom.operators.learning import self_train

    f = spark.createDataFrame([(i, 1, float(i - 10)) for i in range(21)], "gid bigint, fid bigint, value double")
    y = spark.createDataFrame([(0, -1.0), (20, 1.0)] + [(i, 0.0) for i in range(1, 20)], "gid bigint, y double")
    model = {r.fid: r.w for r in self_train(f, y, 1, 0.9).collect()}
    assert model[1] > 0
    with pytest.raises(ValueError, match="quantile"):
        self_train(f, y, 1, 1.5)


def test_learning_queries_run_the_whole_job(monkeypatch):
    from graphloom.plans import catalogue
    from graphloom.plans.options import DEFAULTS

    seen = {}
    for name in ("train", "cross_validate", "self_train", "embed"):
        monkeypatch.setattr(catalogue.learning, name, lambda *a, _name=name, **k: seen.update({_name: (a, k)}))
    for name in ("long_features", "clean_targets", "_neighbours"):
        monkeypatch.setattr(catalogue, name, lambda *a: None)
    for name in ("svm_train", "cross_validation", "self_training", "embed_places"):
        catalogue.QUERIES[name](None, None)
    assert seen["train"][0][2].epochs == seen["cross_validate"][0][3].epochs == seen["self_train"][1]["config"].epochs == DEFAULTS["epochs"]
    assert seen["cross_validate"][0][2] == DEFAULTS["num_cross_validation_folds"] and seen["self_train"][1]["rounds"] == DEFAULTS["num_iterations"]
    assert seen["embed"][1]["iterations"] == DEFAULTS["embed_iterations"]
