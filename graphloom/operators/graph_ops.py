"""Graph tables and traversal as joins: cleaning, adjacency, bounded distances, balls, path unions, flags.

``vertices (gid, vid, label, is_viewpoint, is_kernel_point, kind, is_dead, is_abstraction, vec)`` and ``edges (gid, src, dst,
label, is_dead, is_abstraction_of, is_part_of)``, every undirected edge in both directions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.skew import unsent
from graphloom.store import keep

VERTEX_FLAGS = ["is_viewpoint", "is_kernel_point", "kind", "is_dead", "is_abstraction"]
EDGE_FLAGS = ["is_dead", "is_abstraction_of", "is_part_of"]


def clean_label(label: Column) -> Column:
    return F.coalesce(F.lower(F.rtrim(label)), F.lit(""))


def clean_vertices(vertices: DataFrame) -> DataFrame:
    """One row per (gid, vid): labels in lower case without trailing blanks, null labels empty; of conflicting rows the least."""
    wanted = [clean_label(F.col("label")).alias("label"), *(F.coalesce(f, F.lit(f not in ("is_dead", "is_abstraction"))).alias(f) for f in VERTEX_FLAGS), F.col("vec")]
    rows = vertices.where("gid is not null and vid is not null").select("gid", "vid", F.struct(*wanted).alias("r"))
    return rows.groupBy("gid", "vid").agg(F.min("r").alias("r")).select("gid", "vid", "r.*")


def clean_edges(edges: DataFrame, vertices: DataFrame, undirected: bool = True) -> DataFrame:
    """One row per (gid, src, dst, label, flags); edges without both ends are left out; undirected ones go both ways."""
    rows = edges.select("gid", "src", "dst", clean_label(F.col("label")).alias("label"), *(F.coalesce(f, F.lit(False)).alias(f) for f in EDGE_FLAGS)).distinct()
    ends = vertices.select("gid", "vid")
    known = rows.join(unsent(ends.withColumnRenamed("vid", "src")), ["gid", "src"], "left_semi").join(unsent(ends.withColumnRenamed("vid", "dst")), ["gid", "dst"], "left_semi")
    known = known.select("gid", "src", "dst", "label", *EDGE_FLAGS)
    if not undirected:
        return known
    back = known.select("gid", F.col("dst").alias("src"), F.col("src").alias("dst"), "label", *EDGE_FLAGS)
    return known.unionByName(back).distinct()


def missing_ends(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges of which an end does not exist; the insertion check."""
    ends = vertices.select("gid", "vid")
    bad = [edges.join(ends.withColumnRenamed("vid", e), ["gid", e], "left_anti").select(edges.columns) for e in ("src", "dst")]
    return bad[0].unionByName(bad[1]).distinct()


def kill_by_label(vertices: DataFrame, label: str) -> DataFrame:
    return vertices.withColumn("is_dead", F.col("is_dead") | (F.col("label") == label))


def alive(vertices: DataFrame) -> DataFrame:
    """Vertices that a traversal may enter."""
    return vertices.where("not is_dead and not is_abstraction").select("gid", "vid")


def adjacency(edges: DataFrame) -> DataFrame:
    """``(gid, src, neighbours, degree)``; the list and the degree come from the same rows."""
    return edges.groupBy("gid", "src").agg(F.sort_array(F.collect_list("dst")).alias("neighbours"), F.count(F.lit(1)).alias("degree"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("gid", F.col("src").alias("vid")).agg(F.count(F.lit(1)).alias("degree"))


def bounded_distances(vertices: DataFrame, edges: DataFrame, horizon: int) -> DataFrame:
    """``(gid, src, dst, d)`` for all live, non-abstract vertices within ``horizon`` steps, (v, v, 0) included.

    One join by (gid, vertex) a step; known pairs are removed by an anti join, so each pair is expanded once.
    """
    live = alive(vertices)
    steps = edges.where("src <> dst").select("gid", "src", "dst").distinct()
    steps = steps.join(unsent(live.withColumnRenamed("vid", "src")), ["gid", "src"], "left_semi").join(unsent(live.withColumnRenamed("vid", "dst")), ["gid", "dst"], "left_semi")
    steps = keep(steps.select("gid", F.col("src").alias("mid"), F.col("dst").alias("next")))
    known = live.select("gid", F.col("vid").alias("src"), F.col("vid").alias("dst"), F.lit(0).alias("d"))
    frontier = known
    for d in range(1, horizon + 1):
        reached = frontier.withColumnRenamed("dst", "mid").join(unsent(steps), ["gid", "mid"]).select("gid", "src", F.col("next").alias("dst")).distinct()
        frontier = keep(reached.join(unsent(known), ["gid", "src", "dst"], "left_anti").withColumn("d", F.lit(d)))
        known = known.unionByName(frontier)
    return known


def pair_distance(pairs: DataFrame, distances: DataFrame) -> DataFrame:
    """``pairs (gid, src, dst)`` with their distance, -1 where unreachable."""
    return pairs.join(distances, ["gid", "src", "dst"], "left").select("gid", "src", "dst", F.coalesce("d", F.lit(-1)).alias("d"))


def at_distance(distances: DataFrame, d: int) -> DataFrame:
    return distances.where(F.col("d") == d)


def ball(distances: DataFrame, radius: int) -> DataFrame:
    """``(gid, root, vid, d)`` of all vertices within ``radius`` of every root."""
    return distances.where(F.col("d") <= radius).select("gid", F.col("src").alias("root"), F.col("dst").alias("vid"), "d")


def path_unions(distances: DataFrame, longest: int, reach: int) -> DataFrame:
    """``(gid, src, dst, vid)``: vertices on a shortest path from src to dst, at most ``reach`` from src."""
    ends = distances.where(F.col("d").between(0, longest)).select("gid", "src", "dst", F.col("d").alias("whole"))
    first = distances.where(F.col("d") <= min(reach, longest)).select("gid", "src", F.col("dst").alias("vid"), F.col("d").alias("d1"))
    second = distances.select("gid", F.col("src").alias("vid"), "dst", F.col("d").alias("d2"))
    met = first.join(second, ["gid", "vid"]).join(ends, ["gid", "src", "dst"])
    return met.where("d1 + d2 = whole").select("gid", "src", "dst", "vid").distinct()


def thick_path_unions(distances: DataFrame, longest: int, reach: int, thickness: int) -> DataFrame:
    paths = path_unions(distances, longest, reach)
    near = ball(distances, thickness).select("gid", F.col("root").alias("vid"), F.col("vid").alias("near"))
    return paths.join(near, ["gid", "vid"]).select("gid", "src", "dst", F.col("near").alias("vid")).distinct()


def induced(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with both ends among ``chosen (gid, vid)``."""
    ends = chosen.select("gid", "vid").distinct()
    return edges.join(ends.withColumnRenamed("vid", "src"), ["gid", "src"], "left_semi").join(ends.withColumnRenamed("vid", "dst"), ["gid", "dst"], "left_semi").select(edges.columns)


def bfs_dag(distances: DataFrame, edges: DataFrame) -> DataFrame:
    """``(gid, root, parent, child, level)``: for every root all edges from one level to the next, every parent kept."""
    d1 = distances.select("gid", F.col("src").alias("root"), F.col("dst").alias("parent"), F.col("d").alias("dp"))
    d2 = distances.select("gid", F.col("src").alias("root"), F.col("dst").alias("child"), F.col("d").alias("level"))
    steps = edges.select("gid", F.col("src").alias("parent"), F.col("dst").alias("child")).distinct()
    return d1.join(steps, ["gid", "parent"]).join(d2, ["gid", "root", "child"]).where("level = dp + 1").select("gid", "root", "parent", "child", "level")


def unsound(vertices: DataFrame, distances: DataFrame) -> DataFrame:
    """Graphs with vertices but no distances; empty when sound."""
    return vertices.select("gid").distinct().join(distances.select("gid").distinct(), "gid", "left_anti")


def reversed_copy(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with a copy of all vertices, labelled ``r.`` and numbered after the others, and all edges reversed in it."""
    size = vertices.groupBy("gid").agg((F.max("vid") + 1).alias("size"))
    copies = vertices.join(size, "gid").withColumn("vid", (F.col("vid") + F.col("size")).cast("int")).withColumn("label", F.concat(F.lit("r."), "label")).select(vertices.columns)
    turned = edges.join(size, "gid").withColumn("s", (F.col("dst") + F.col("size")).cast("int")).withColumn("dst", (F.col("src") + F.col("size")).cast("int")).withColumn("src", F.col("s")).select(edges.columns)
    return vertices.unionByName(copies), edges.unionByName(turned)


def sequences(rows: DataFrame, gid: str, order: list[str], label: Column) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of one chain per ``gid``, in the given order, edges labelled ``-`` both ways."""
    from pyspark.sql import Window

    w = Window.partitionBy("gid").orderBy(*order)
    plain = rows.where(F.col(gid).isNotNull()).select(F.col(gid).cast("bigint").alias("gid"), *order, label.alias("label"))
    v = plain.select("gid", (F.row_number().over(w) - 1).cast("int").alias("vid"), "label")
    vertices = v.select("gid", "vid", "label", F.lit(True).alias("is_viewpoint"), F.lit(True).alias("is_kernel_point"), F.lit(True).alias("kind"), F.lit(False).alias("is_dead"), F.lit(False).alias("is_abstraction"), F.lit(None).cast("array<double>").alias("vec"))
    step = v.where("vid > 0").select("gid", "vid", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"))
    one, two = F.col("vid"), F.col("vid") - 1
    flags = [F.lit(False).alias(f) for f in EDGE_FLAGS]
    edges = step.select("gid", F.when(F.col("back"), two).otherwise(one).alias("src"), F.when(F.col("back"), one).otherwise(two).alias("dst"), F.lit("-").alias("label"), *flags)
    return vertices, edges


def component_links(vertices: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For every two components of a graph one abstract vertex ``^L`` with part-of edges to the first and abstraction-of edges to the second.

    ``parts (gid, vid, part)``; the new vertices are numbered after the others in order of (part, part).
    """
    from pyspark.sql import Window

    first = parts.select("gid", F.col("part").alias("p")).distinct()
    pairs = first.join(first.withColumnRenamed("p", "q"), "gid").where("p < q")
    size = vertices.groupBy("gid").agg((F.max("vid") + 1).alias("size"))
    number = F.row_number().over(Window.partitionBy("gid").orderBy("p", "q")) - 1
    numbered = pairs.join(size, "gid").withColumn("vid", (F.col("size") + number).cast("int")).select("gid", "p", "q", "vid")
    new_vertices = numbered.select("gid", "vid", F.lit("^L").alias("label"))
    seen = parts.join(vertices.where("is_viewpoint").select("gid", "vid"), ["gid", "vid"], "left_semi")
    lower = numbered.join(seen.select("gid", F.col("part").alias("p"), F.col("vid").alias("dst")), ["gid", "p"]).select("gid", F.col("vid").alias("src"), "dst", F.lit("@-").alias("label"), F.lit(False).alias("is_abstraction_of"), F.lit(True).alias("is_part_of"))
    upper = numbered.join(seen.select("gid", F.col("part").alias("q"), F.col("vid").alias("dst")), ["gid", "q"]).select("gid", F.col("vid").alias("src"), "dst", F.lit("^-").alias("label"), F.lit(True).alias("is_abstraction_of"), F.lit(False).alias("is_part_of"))
    return new_vertices, lower.unionByName(upper)
