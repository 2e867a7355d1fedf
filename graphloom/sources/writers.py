"""Writers and exporters: sparse vectors, models, and graphs as text in several formats."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.store import keep


#: Weights of a line of a model's text.
WEIGHTS = 50_000


def write_text(lines: DataFrame, path: str) -> None:
    """One text column, overwriting the folder."""
    lines.write.mode("overwrite").text(path)


def sparse_lines(features: DataFrame, keys: tuple[str, ...] = ("gid",)) -> DataFrame:
    """``(keys, line)`` with `` fid:value`` in scientific form, nine digits, fids ascending."""
    row = features.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("fid", "value"))).alias("e"))
    cell = lambda e: F.concat(F.lit(" "), e["fid"].cast("string"), F.lit(":"), F.format_string("%.9e", e["value"]))
    return row.select(*keys, F.array_join(F.transform("e", cell), "").alias("line"))


def sparse_binary(features: DataFrame) -> DataFrame:
    """``(gid, data)``: int32 count, then (int32, float32) pairs."""
    rows = features.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("fid", "value"))).alias("e")).select("gid", F.col("e.fid").alias("f"), F.col("e.value").alias("v"))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            data = [struct.pack("<i", len(f)) + b"".join(struct.pack("<if", int(a), float(b)) for a, b in zip(f, v)) for f, v in zip(frame.f, frame.v)]
            yield pd.DataFrame({"gid": frame.gid, "data": data})

    return rows.mapInPandas(pack, "gid bigint, data binary")


def model_lines(model: DataFrame, per_line: int = WEIGHTS) -> DataFrame:
    """``(line)``: bias, wscale and w of a model whose bias has fid -1; fids ascend in a line.

    Beyond ``per_line`` weights there are several w lines, each with the weights of one hash bucket, so that no row holds the whole model.
    """
    model = keep(model)
    cut = max(1, -(-model.count() // per_line))
    bias = model.where("fid = -1").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("b"))
    heads = bias.select(F.explode(F.array(F.concat(F.lit("bias "), F.col("b").cast("string")), F.lit("wscale 1"))).alias("line"))
    cell = F.concat(F.lit(" "), F.col("fid").cast("string"), F.lit(":"), F.col("w").cast("string"))
    cells = model.where("fid <> -1").select(F.pmod(F.xxhash64("fid"), F.lit(cut)).alias("part"), F.struct("fid", cell.alias("c")).alias("e"))
    rows = cells.groupBy("part").agg(F.sort_array(F.collect_list("e")).alias("e")) if cut > 1 else cells.agg(F.sort_array(F.collect_list("e")).alias("e"))
    return heads.unionByName(rows.select(F.concat(F.lit("w"), F.array_join("e.c", "")).alias("line")))


#: Colours of labels in order of first use (fixed values).
COLOURS = "red green blue yellow orange purple brown pink cyan magenta gold navy olive teal maroon lime coral indigo violet salmon khaki orchid plum sienna tan turquoise".split()


def label_colours(vertices: DataFrame) -> DataFrame:
    """``(gid, label, colour)``: labels of a graph take the palette in order of their first vertex, around again after its end."""
    from pyspark.sql import Window

    first = vertices.groupBy("gid", "label").agg(F.min("vid").alias("v"))
    place = (F.row_number().over(Window.partitionBy("gid").orderBy("v")) - 1) % len(COLOURS)
    palette = F.array(*[F.lit(c) for c in COLOURS])
    return first.select("gid", "label", F.element_at(palette, (place + 1).cast("int")).alias("colour"))


def _documents(vertex_text, edge_text, vertices: DataFrame, edges: DataFrame, head: str, tail: str, once: bool = True) -> DataFrame:
    """``(gid, text)``: head, vertex lines by id, edge lines by ends, tail."""
    v = vertices.select("gid", F.lit(0).alias("kind"), F.col("vid").alias("a"), F.lit(0).alias("b"), vertex_text.alias("t"))
    e = edges.where("src < dst") if once else edges
    e = e.select("gid", F.lit(1).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), edge_text.alias("t"))
    lines = v.unionByName(e).groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("kind", "a", "b", "t"))).alias("l"))
    return lines.select("gid", F.concat(F.lit(head), F.array_join(F.col("l.t"), "\n"), F.lit(tail)).alias("text"))


def _s(c: str):
    return F.col(c).cast("string")


def export_dot(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    coloured = vertices.join(label_colours(vertices), ["gid", "label"])
    style = F.concat(F.when(F.col("kind"), F.lit("ellipse")).otherwise(F.lit("box")), F.when(F.col("is_dead"), F.lit(" style=dashed")).otherwise(F.lit("")))
    v = F.concat(_s("vid"), F.lit(' [label="'), F.col("label"), F.lit('" color='), F.col("colour"), F.lit(" shape="), style, F.lit("]"))
    e = F.concat(_s("src"), F.lit(" -- "), _s("dst"), F.lit(' [label="'), F.col("label"), F.lit('"]'))
    return _documents(v, e, coloured, edges, "graph g {\n", "\n}")


def export_gml(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    v = F.concat(F.lit("node [ id "), _s("vid"), F.lit(' label "'), F.col("label"), F.lit('" ]'))
    e = F.concat(F.lit("edge [ source "), _s("src"), F.lit(" target "), _s("dst"), F.lit(' label "'), F.col("label"), F.lit('" ]'))
    return _documents(v, e, vertices, edges, "graph [\n", "\n]")


def export_gdl(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    v = F.concat(F.lit('node: { title: "'), _s("vid"), F.lit('" label: "'), F.col("label"), F.lit('" }'))
    e = F.concat(F.lit('edge: { source: "'), _s("src"), F.lit('" target: "'), _s("dst"), F.lit('" label: "'), F.col("label"), F.lit('" }'))
    return _documents(v, e, vertices, edges, "graph: {\n", "\n}")


def export_gspan(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    code = F.when(~F.col("is_kernel_point") & ~F.col("is_abstraction"), "W").when(~F.col("is_viewpoint") & ~F.col("is_abstraction"), "V").otherwise("v")
    v = F.concat(code, F.lit(" "), _s("vid"), F.lit(" "), F.col("label"))
    e = F.concat(F.lit("e "), _s("src"), F.lit(" "), _s("dst"), F.lit(" "), F.col("label"))
    return _documents(v, e, vertices, edges, "t\n", "\n")


def export_csv(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(gid, src, src_label, dst, dst_label, label)`` once per edge."""
    names = vertices.select("gid", "vid", "label")
    both = edges.where("src < dst").join(names.toDF("gid", "src", "src_label"), ["gid", "src"]).join(names.toDF("gid", "dst", "dst_label"), ["gid", "dst"])
    return both.select("gid", "src", "src_label", "dst", "dst_label", "label")


def export_matrix(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(gid, am, al, nl, el)``: adjacency rows, adjacency lists, vertex labels and edge triples, as text."""
    size = vertices.groupBy("gid").agg((F.max("vid") + 1).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("vid", "label"))), lambda r: r["label"]), " ").alias("nl"))
    lists = edges.groupBy("gid", "src").agg(F.sort_array(F.collect_set("dst")).alias("l"))
    per = lists.groupBy("gid").agg(F.map_from_entries(F.collect_list(F.struct("src", "l"))).alias("m"))
    triples = edges.groupBy("gid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("src", "dst", "label"))), lambda r: F.concat(r["src"].cast("string"), F.lit(" "), r["dst"].cast("string"), F.lit(" "), r["label"])), "\n").alias("el"))
    ids = F.sequence(F.lit(0), F.col("n") - 1)
    near = lambda v: F.coalesce(F.col("m")[v], F.array().cast("array<int>"))
    row = lambda v: F.array_join(F.transform(ids, lambda u: F.array_contains(near(v), u).cast("int").cast("string")), " ")
    return size.join(per, "gid", "left").join(triples, "gid", "left").select("gid", F.array_join(F.transform(ids, row), "\n").alias("am"), F.array_join(F.transform(ids, lambda v: F.array_join(near(v).cast("array<string>"), " ")), "\n").alias("al"), "nl", F.coalesce("el", F.lit("")).alias("el"))


def serialise(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(gid, text)``: the whole graph in one line."""
    v = F.concat(_s("vid"), F.lit(":"), F.col("label"))
    e = F.concat(_s("src"), F.lit(">"), _s("dst"), F.lit(":"), F.col("label"))
    return _documents(v, e, vertices, edges, "", "", once=False).select("gid", F.translate("text", "\n", " ").alias("text"))


EXPORTS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"dot": export_dot, "gml": export_gml, "gdl": export_gdl, "csv": export_csv, "gspan": export_gspan, "matrix": export_matrix}


def export(name: str, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The export of that format; an unknown one is an error."""
    if name not in EXPORTS:
        raise ValueError(f"unknown format {name}; known: {', '.join(EXPORTS)}")
    return EXPORTS[name](vertices, edges)
