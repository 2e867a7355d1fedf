"""The actions: input and options to result tables, by name.

``run(spark, Options(action=..., ...))`` reads the input, makes features and returns ``{table name: DataFrame}``; ``save`` writes them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import density, graph_ops, kernels, learning, local_kernels, lsh, vectors_ops
from graphloom.plans.options import Options
from graphloom.sources import readers, writers
from graphloom.store import keep


class Job:
    """Input tables of an action, made when first asked for and kept."""

    def __init__(self, spark: SparkSession, options: Options, **tables: DataFrame):
        self.spark, self.o = spark, options
        self.__dict__.update(tables)  # tables given in place of files: features, targets, model, graph, texts

    @cached_property
    def graph(self) -> tuple[DataFrame, DataFrame]:
        o, directed = self.o, self.o["graph_type"] == "DIRECTED"
        if o["file_type"] == "SEQUENCE":
            v, e = readers.read_sequences(self.spark, o["input_data_file_name"], o["sequence_degree"], o["sequence_token"], directed, o["sequence_pairwise_interaction"])
        elif o["file_type"] == "MOLECULAR_GRAPH":
            v, e = readers.read_molecules(self.spark, o["input_data_file_name"])
        else:
            v, e = readers.read_graphs(self.spark, o["input_data_file_name"], directed, o["use_real_vector_information"])
        if directed:
            v, e = graph_ops.reversed_copy(v, e)
        return keep(v), keep(e)

    @property
    def config(self) -> local_kernels.Config:
        o = self.o
        return local_kernels.Config(o["radius"], o["distance"], o["hash_bit_size"], o["vertex_degree_threshold"], 1, o["tree_lambda"], o["radius_two"], not o["no_normalization"])

    @cached_property
    def features(self) -> DataFrame:
        o = self.o
        if o["file_type"] == "SPARSE_VECTOR":
            f = readers.reader("SPARSE_VECTOR", o["binary_file_type"])(self.spark, o["input_data_file_name"])
            f = f if o["no_normalization"] else kernels.unit_length(f)
        elif o["file_type"] == "STRINGSEQ":
            texts, shape = readers.read_strings(self.spark, o["input_data_file_name"]), (o["radius"], o["distance"], o["hash_bit_size"])
            f = kernels.string_positions(texts, *shape).groupBy("gid", "fid").agg(F.sum("value").alias("value")) if o["no_normalization"] else kernels.string_vectors(texts, *shape)
        elif o["kernel_type"] == "NSPDK" and o["radius"] <= 1:
            v, e = self.graph
            f = kernels.nspdk(v, e, keep(graph_ops.bounded_distances(v, e, o["distance"])), o["radius"], o["hash_bit_size"], not o["no_normalization"])
        else:
            f = local_kernels.local_features(*self.graph, o["kernel_type"], self.config)
        return keep(kernels.minimum_kernel(f, o["hash_bit_size"]) if o["min_kernel"] else f)

    @cached_property
    def vertex_features(self) -> DataFrame:
        if self.o["file_type"] == "SPARSE_VECTOR":
            raise ValueError("sparse vectors have no parts")
        if self.o["file_type"] == "STRINGSEQ":
            texts = readers.read_strings(self.spark, self.o["input_data_file_name"])
            return keep(kernels.string_positions(texts, self.o["radius"], self.o["distance"], self.o["hash_bit_size"]))
        return keep(local_kernels.local_vertex_features(*self.graph, self.o["kernel_type"], self.config))

    @cached_property
    def targets(self) -> DataFrame:
        return keep(readers.read_targets(self.spark, self.o["target_file_name"]))

    @cached_property
    def model(self) -> DataFrame:
        return readers.read_model(self.spark, self.o["model_file_name"])

    @cached_property
    def rows(self) -> DataFrame:
        return self._chosen("row_index_file_name")

    @cached_property
    def columns(self) -> DataFrame:
        return self._chosen("col_index_file_name")

    def _chosen(self, option: str) -> DataFrame:
        if self.o[option] is None:
            return self.features
        return self.features.join(readers.read_index(self.spark, self.o[option], self.features), "gid", "left_semi").select("gid", "fid", "value")

    def approximate(self) -> DataFrame:
        o = self.o
        return lsh.approximate_neighbours(self.rows, self.columns, o["num_nearest_neighbors"], o["num_hash_functions"], o["num_repeat_hash_functions"], o["max_size_bin"], o["eccess_neighbor_size_factor"])

    @cached_property
    def neighbours(self) -> DataFrame:
        near = self.approximate() if self.o["approximate"] else lsh.exact_neighbours(self.rows, self.columns, self.o["num_nearest_neighbors"])
        return keep(lsh.mutual(near) if self.o["shared_neighborhood"] else near)

    @cached_property
    def training(self) -> learning.TrainConfig:
        o = self.o
        return learning.TrainConfig(lam=o["lambda"], epochs=o["epochs"], sparsify=o["sparsification_num_iterations"], seed=o["random_seed"], laplacian_rate=o["topological_regularization_decay_rate"])

    @cached_property
    def laplacian(self) -> dict | None:
        """The correlation Laplacian of the features at the same vertices, if topological regularisation is asked for."""
        near = self.o["topological_regularization_num_neighbors"]
        return learning.laplacian_rows(vectors_ops.correlation_laplacian(self.vertex_features, near)) if near else None


def feature(j: Job):
    f = j.features
    if j.o["smooth"]:
        near = lsh.approximate_neighbours(f, f, j.o["num_nearest_neighbors"])
        f = vectors_ops.smoothed(f, near, j.o["smoother_param"], j.o["hash_bit_size"])
    return {"feature": f}


def matrix(j: Job):
    gram = keep(vectors_ops.dot_products(j.rows, j.columns))
    out = {"matrix": gram}
    if j.o["extended_matrix_information"]:
        out["summary"] = vectors_ops.gram_summary(gram, j.rows, j.columns, vectors_ops.dot_products(j.rows, j.rows), vectors_ops.dot_products(j.columns, j.columns))
    return out


def min_hash(j: Job):
    if j.o["file_type"] == "SPARSE_VECTOR":
        raise ValueError("signatures are printed for graphs and sequences")
    return {"min_hash_feature": lsh.full_signatures(lsh.signatures(j.features, j.o["num_hash_functions"], j.o["num_repeat_hash_functions"]), j.o["num_hash_functions"])}


def nearest_neighbor(j: Job):
    targets = j.targets if j.o["target_file_name"] or "targets" in j.__dict__ else None
    lists = lsh.neighbour_lists(j.neighbours, targets)
    return {"knn": lists.select("gid", "ids"), "knn_kernel_value": lists.select("gid", "products"), "knn_target_value": lists.select("gid", "targets"), "knn_feature": lists.select("gid", "vector")}


def cluster(j: Job):
    o, near = j.o, j.neighbours
    known = keep(density.local_density(near, o["shared_neighborhood"]))
    if o["cluster_type"] == "DENSE_CENTERS":
        return {"dense_centers": density.dense_centres(near, known, o["sample_size"], o["neighborhood_intersection_size"], o["fraction_center_scan"])}
    if o["cluster_type"] == "DENSE_CONNECTED_CENTERS":
        return {"dense_connected_centers": density.connected_centres(near, known, o["sample_size"], o["neighborhood_intersection_size"])}
    if o["cluster_type"] == "APPROXIMATION_ACCURACY":
        signed = keep(lsh.signatures(j.features, o["num_hash_functions"], o["num_repeat_hash_functions"]))
        exact = lsh.exact_neighbours(j.rows, j.columns, o["num_nearest_neighbors"])
        return {"nn_accuracy": lsh.accuracy(j.approximate(), exact, o["num_nearest_neighbors"]), "signature_size": lsh.bucket_sizes(signed, lsh.index(signed, most=o["max_size_bin"])), "density": known}
    found = keep(density.quick_shift_clusters(near, known, o["cluster_threshold"]))
    return {"kquickshift_cluster": found, "kquickshift_cluster_parent_relation": density.quick_shift_parents(near, known, o["cluster_threshold"]), "kquickshift_cluster_neighbor_extension": density.cluster_extension(found, near)}


def density_action(j: Job):
    pairs = j.neighbours.select(F.col("gid").alias("g"), F.col("nid").alias("gid_a")).join(j.neighbours.select(F.col("gid").alias("g"), F.col("nid").alias("gid_b")), "g").select("gid_a", "gid_b").distinct()
    a, b = j.features.toDF("gid_a", "fid", "x"), j.features.toDF("gid_b", "fid", "y")
    products = pairs.join(a, "gid_a").join(b, ["gid_b", "fid"]).groupBy("gid_a", "gid_b").agg(F.sum(F.col("x") * F.col("y")).alias("k"))
    found = keep(density.voronoi_density(j.neighbours, products))
    return {"prob": found.select("gid", "p"), "logprob": found.select("gid", "log_p")}


def pre_cluster_filter(j: Job):
    signed = keep(lsh.signatures(j.features, j.o["num_hash_functions"], j.o["num_repeat_hash_functions"]))
    kept = keep(density.pre_cluster_filter(lsh.bucket_sizes(signed, lsh.index(signed, most=j.o["max_size_bin"])), j.o["num_output_instances"]))
    return {"filtered": j.features.join(kept.select("gid"), "gid", "left_semi"), "filtered_index": kept.select("gid")}


def train(j: Job):
    if j.targets.where("y = 0").limit(1).count():
        only = "positive" if j.o["only_positive"] else "negative" if j.o["only_negative"] else None
        return {"model": learning.self_train(j.features, j.targets, j.o["num_iterations"], j.o["threshold"], only, j.training, j.laplacian)}
    return {"model": learning.train(j.features, j.targets, j.training, j.laplacian)}


def test(j: Job):
    found = keep(learning.predict(j.features, j.model))
    return {"prediction": found.select("gid", "prediction"), "margin": found.select("gid", "margin")}


def test_part(j: Job):
    wide = j.vertex_features.join(j.model, "fid", "left").groupBy("gid", "vid").agg(F.sum(F.coalesce(F.col("value") * F.col("w"), F.lit(0.0))).alias("s"))
    bias = j.model.where(F.col("fid") == learning.BIAS_FID).agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("b"))
    return {"prediction_part": wide.join(bias, F.lit(True)).select("gid", "vid", (F.col("s") + F.col("b")).alias("margin"))}


def _several(j: Job) -> DataFrame:
    return j.__dict__.get("task_targets") or readers.read_multilabel(j.spark, j.o["target_file_name"])


def cross_validation(j: Job):
    found = keep(learning.cross_validate(j.features, j.targets, j.o["num_cross_validation_folds"], j.training))
    return {"cv_predictions": found, "metrics": learning.metrics(found)}


def parameters(j: Job):
    """Line search over the trainer's parameters and, where the input is a graph or string, over the kernel's."""
    o = j.o
    grid = {"lam": [o["lambda"] * 10.0**i for i in (-1, 0, 1)], "epochs": sorted({max(1, o["epochs"] // 2), o["epochs"], o["epochs"] * 2}), "sparsify": [0, 1]}
    names = []
    if "features" not in j.__dict__ and o["file_type"] != "SPARSE_VECTOR":
        names = ["distance", "radius"] + (["tree_lambda"] if o["kernel_type"] in ("DDK", "NSDDK", "ANSDDK") else []) + (["radius_two"] if o["kernel_type"] in ("NSDDK", "ANSDDK") else [])
        around = lambda v: sorted({max(0, v - 1), v, v + 1})
        grid |= {n: [o[n] * x for x in (0.8, 1.0, 1.2)] if n == "tree_lambda" else around(o[n]) for n in names}
    features = (lambda shape: Job(j.spark, Options(**{**o, **shape})).features) if names else j.features
    best, tried = learning.parameter_search(features, j.targets, grid, o["num_line_search_iterations"], o["num_cross_validation_folds"], {n: o[n] for n in names})
    columns = {"lam": float, "epochs": int, "sparsify": int, **{n: float if n == "tree_lambda" else int for n in names}}
    rows = [(*[kind(t[c]) for c, kind in columns.items()], t["f_balanced"], all(t[c] == best[c] for c in columns)) for t in tried]
    schema = ", ".join(f"{c} {'double' if kind is float else 'int'}" for c, kind in columns.items())
    return {"opt_param": j.spark.createDataFrame(rows, schema + ", f_balanced double, best boolean")}


def embed(j: Job):
    o = j.o
    start = readers.read_coordinates(j.spark, o["initial_embedding_coordinates_file_name"]) if o["initial_embedding_coordinates_file_name"] else None
    return {"embedding": learning.embed(j.neighbours, o["dimensionality"], o["embed_iterations"], o["epsilon"], o["tau"], o["non_neighborhood_size"], o["random_seed"], o["num_restarts"], o["tau_exponent_range"], start)}


RUN: dict[str, Callable[[Job], dict[str, DataFrame]]] = {
    "FEATURE": feature,
    "FEATURE_PART": lambda j: {"feature_part": j.vertex_features},
    "FEATURE_SCALED": lambda j: {"feature_scaled": vectors_ops.scaled(j.features, j.model)},
    "MATRIX": matrix,
    "TARGET_ALIGNMENT": lambda j: {"target_alignment": vectors_ops.target_alignment(vectors_ops.dot_products(j.features, j.features), j.targets)},
    "MIN_HASH": min_hash,
    "NEAREST_NEIGHBOR": nearest_neighbor,
    "CLUSTER": cluster,
    "DENSITY": density_action,
    "PRE_CLUSTER_FILTER": pre_cluster_filter,
    "TRAIN": train,
    "TEST": test,
    "TEST_PART": test_part,
    "TRAIN_MULTILABEL": lambda j: {"model": learning.train_tasks(j.features, _several(j), j.training)},
    "TEST_MULTILABEL": lambda j: {"margin": learning.predict_tasks(j.features, j.__dict__.get("models") or readers.read_models(j.spark, j.o["output_directory_path"]))},
    "CROSS_VALIDATION": cross_validation,
    "BIAS_VARIANCE_DECOMPOSITION": lambda j: {"confidence": learning.bias_variance(j.features, j.targets, j.o["num_evaluation_points"], j.o["num_cross_validation_folds"], j.training)},
    "LEARNING_CURVE": lambda j: {"learning_curve": learning.learning_curve(j.features, j.targets, j.o["num_evaluation_points"], j.training)},
    "PARAMETERS_OPTIMIZATION": parameters,
    "SEMI_SUPERVISED": lambda j: {"prediction": density.label_spreading(j.neighbours, j.targets, j.o["semi_supervised_alpha"], j.o["num_iterations"])},
    "EMBED": embed,
}


def run(spark: SparkSession, options: Options, **tables: DataFrame) -> dict[str, DataFrame]:
    """The result tables of ``options['action']``; ``tables`` may give input tables in place of files."""
    if options["action"] is None:
        raise ValueError("an action is needed")
    return RUN[options["action"]](Job(spark, options, **tables))


def save(results: dict[str, DataFrame], options: Options) -> None:
    """Each table as Parquet below the output directory; models as text as well, those of several tasks as model_0, model_1, ..."""
    for name, df in results.items():
        path = f"{options['output_directory_path']}/{name}{options['suffix']}"
        df.write.mode("overwrite").parquet(path)
        if name == "model" and "task" not in df.columns:
            writers.write_text(writers.model_lines(df), path + ".txt")
        elif name == "model":
            for row in df.select("task").distinct().orderBy("task").collect():  # a row per model
                writers.write_text(writers.model_lines(df.where(F.col("task") == row.task).select("fid", "w")), f"{options['output_directory_path']}/model_{row.task}")
