"""Readers of the text and binary input formats; gzip files are decoded by their extension.

Lines are numbered without gathering them: the place in a partition plus the lines of the partitions before.  Malformed input is an error.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.graph_ops import EDGE_FLAGS, component_links
from graphloom.operators.skew import unsent
from graphloom.store import keep

V_COLUMNS = ["gid", "vid", "label", "is_viewpoint", "is_kernel_point", "kind", "is_dead", "is_abstraction", "vec"]
E_COLUMNS = ["gid", "src", "dst", "label", *EDGE_FLAGS]
_OFFSET = (1 << 33) - 1


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, line)`` from 0 in order of file name, then of place in the file, however the files are split among tasks."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("m"), F.col("value").alias("line")
    )
    pieces = lines.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("first"))  # a row per piece of a file
    before = pieces.select("file", "start", "first", (F.sum("n").over(Window.orderBy("file", "start")) - F.col("n")).alias("before"))
    return lines.join(F.broadcast(before), ["file", "start"]).select((F.col("before") + F.col("m") - F.col("first")).alias("line_no"), "line")


def _fail(message: str, detail, kind: str = "string"):
    return F.raise_error(F.concat(F.lit(message + ": "), detail)).cast(kind)


def vertex_rows(rows: DataFrame) -> DataFrame:
    """Fill the columns that a source does not give."""
    given = {"is_viewpoint": True, "is_kernel_point": True, "kind": True, "is_dead": False, "is_abstraction": False}
    for name, value in given.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(value))
    if "vec" not in rows.columns:
        rows = rows.withColumn("vec", F.lit(None).cast("array<double>"))
    return rows.select(V_COLUMNS)


def edge_rows(rows: DataFrame) -> DataFrame:
    for name in EDGE_FLAGS:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(False))
    return rows.select(E_COLUMNS)


def both_ways(edges: DataFrame) -> DataFrame:
    back = edges.select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in E_COLUMNS])
    return edges.unionByName(back)


def read_graphs(spark: SparkSession, path: str, directed: bool = False, real_vectors: bool = False) -> tuple[DataFrame, DataFrame]:
    """Graph text: ``t`` starts a graph, ``v``/``V``/``W id label [vec: x ...]`` a vertex, ``e src dst label`` an edge.

    ``V`` is no viewpoint, ``W`` no kernel point either; a vertex label ``^...`` is abstract, an edge label ``^`` an abstraction, ``@`` a
    part.  Graphs are numbered by their ``t`` lines; other lines are ignored.  A vertex without label or an edge without
    both ends raises.
    """
    lines = keep(numbered_lines(spark, path).withColumn("w", F.split(F.trim("line"), r"\s+")))
    per = Window.partitionBy("block").orderBy("line_no")
    blocks = lines.withColumn("block", F.floor(F.col("line_no") / 100_000)).withColumn("is_t", (F.col("w")[0] == "t").cast("int"))
    sums = blocks.groupBy("block").agg(F.sum("is_t").alias("t"))
    before = sums.select("block", (F.sum("t").over(Window.orderBy("block")) - F.col("t")).alias("before"))  # a row per 100,000 lines
    numbered = blocks.join(before, "block").withColumn("gid", F.col("before") + F.sum("is_t").over(per) - 1).where("gid >= 0")
    n = F.size("w")
    code = F.col("w")[0]
    label = F.when(n > 2, F.try_element_at("w", F.lit(3))).otherwise(_fail("vertex without a label", F.col("line")))
    abstract = F.col("label").startswith("^")
    vertices = numbered.where(code.isin("v", "V", "W")).select("gid", code.alias("code"), F.try_element_at("w", F.lit(2)).cast("int").alias("vid"), label.alias("label"), "w", "line")
    at = F.array_position("w", "vec:")
    vec = F.when(at > 0, F.transform(F.slice("w", (at + 1).cast("int"), F.greatest(F.size("w") - at, F.lit(0)).cast("int")), lambda x: x.cast("double"))) if real_vectors else F.lit(None).cast("array<double>")
    vertices = vertices.withColumn("vec", vec).withColumn("is_abstraction", abstract).withColumn("is_viewpoint", (F.col("code") == "v") & ~abstract).withColumn("is_kernel_point", (F.col("code") != "W") & ~abstract)
    vertices = keep(vertex_rows(vertices))
    word = lambda i: F.try_element_at("w", F.lit(i))
    found = numbered.where(code == "e").select("gid", word(2).cast("int").alias("src"), word(3).cast("int").alias("dst"), F.coalesce(word(4), F.lit("")).alias("label"), "line")
    found = found.withColumn("is_abstraction_of", F.col("label").startswith("^")).withColumn("is_part_of", F.col("label").startswith("@"))
    ends = vertices.select("gid", "vid", F.lit(True).alias("known"))
    checked = found.join(ends.toDF("gid", "src", "ks"), ["gid", "src"], "left").join(ends.toDF("gid", "dst", "kd"), ["gid", "dst"], "left")
    label = F.when(F.col("ks").isNull() | F.col("kd").isNull(), _fail("edge with an unknown end", F.col("line"))).otherwise(F.col("label"))
    edges = edge_rows(checked.withColumn("label", label))
    return vertices, edges if directed else both_ways(edges)


def read_sequences(spark: SparkSession, path: str, degree: int = 1, tokens: bool = False, directed: bool = False, pairwise: bool = False) -> tuple[DataFrame, DataFrame]:
    """A chain per line, or per ``degree`` parallel lines, one vertex per character or token; ``|`` divides components.

    Of parallel lines, those after the first are attributes: vertices that are no viewpoints, tied both ways to the vertex before.
    Lines of one group must have equal lengths.  Blank lines are left out.  ``pairwise`` adds an abstract vertex per two components.
    """
    lines = numbered_lines(spark, path).where(F.trim("line") != "")
    order = keep(lines)
    block = F.floor(F.col("line_no") / 100_000)  # blank lines leave gaps, so lines are counted anew
    sums = order.groupBy(block.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    before = sums.select("b", (F.sum("n").over(Window.orderBy("b")) - F.col("n")).alias("before"))
    order = order.withColumn("b", block).join(before, "b").withColumn("row", F.col("before") + F.row_number().over(Window.partitionBy("b").orderBy("line_no")) - 1)
    row = F.col("row")
    words = F.split(F.trim("line"), r"\s+") if tokens else F.filter(F.split("line", ""), lambda c: c != "")
    parts = order.select(F.floor(row / degree).alias("gid"), (row % degree).cast("int").alias("m"), words.alias("w"))
    if degree > 1:
        sized = parts.groupBy("gid").agg(F.min(F.size("w")).alias("lo"), F.max(F.size("w")).alias("hi"), F.count(F.lit(1)).alias("lines"))
        bad = (F.col("lo") != F.col("hi")) | (F.col("lines") != degree)
        parts = parts.join(unsent(sized), "gid").withColumn("w", F.when(bad, _fail("parallel lines differ in number or length", F.col("gid").cast("string"), "array<string>")).otherwise(F.col("w")))
    cells = parts.select("gid", "m", F.posexplode("w").alias("c", "label"))
    first = cells.where("m = 0").withColumn("bar", (F.col("label") == "|").cast("int"))
    seen = F.sum("bar").over(Window.partitionBy("gid").orderBy("c"))
    columns = first.withColumn("part", seen.cast("int")).where("bar = 0").withColumn("n", (F.row_number().over(Window.partitionBy("gid").orderBy("c")) - 1).cast("int")).select("gid", "c", "part", "n")
    v = keep(cells.join(unsent(columns), ["gid", "c"]).select("gid", (F.col("n") * degree + F.col("m")).cast("int").alias("vid"), "label", "part", "m", (F.col("m") == 0).alias("is_viewpoint")))
    vertices = vertex_rows(v)
    tie = v.where("m > 0").select("gid", F.col("vid").alias("src"), (F.col("vid") - 1).alias("dst"))
    chain = v.where("m = 0").select("gid", "vid", "part").alias("a").join(unsent(v.where("m = 0").select("gid", (F.col("vid") + degree).alias("vid"), "part")), ["gid", "vid", "part"]).select("gid", F.col("vid").alias("src"), (F.col("vid") - degree).alias("dst"))
    label = lambda d: edge_rows(d.withColumn("label", F.lit("-")))
    edges = both_ways(label(tie)).unionByName(label(chain) if directed else both_ways(label(chain)))
    if pairwise:
        new_v, new_e = component_links(vertices, v.where("m = 0").select("gid", "vid", "part"))
        hidden = new_v.withColumn("is_abstraction", F.lit(True)).withColumn("is_viewpoint", F.lit(False)).withColumn("is_kernel_point", F.lit(False))
        vertices, edges = vertices.unionByName(vertex_rows(hidden)), edges.unionByName(edge_rows(new_e))
    return vertices, edges


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """``(gid, text)``: every line is one string."""
    return numbered_lines(spark, path).select(F.col("line_no").alias("gid"), F.col("line").alias("text"))


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    """``(gid, fid, value)`` of lines of ``fid:value``; tokens without a colon are ignored."""
    words = numbered_lines(spark, path).select(F.col("line_no").alias("gid"), F.explode(F.split(F.trim("line"), r"\s+")).alias("w")).where("w like '%:%'")
    return words.select("gid", F.split_part("w", F.lit(":"), F.lit(1)).cast("bigint").alias("fid"), F.split_part("w", F.lit(":"), F.lit(2)).cast("double").alias("value"))


def unpack_vectors(data: bytes, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks, fids and values of vectors stored one after another as a count and that many (int32, float32)."""
    at, rank, ranks, cells = 0, 0, [], []
    while at < len(data):
        (n,) = struct.unpack_from("<i", data, at) if at + 4 <= len(data) else (-1,)
        if n < 0 or at + 4 + 8 * n > len(data):
            raise ValueError(f"truncated vector in {name}")
        cells.append(np.frombuffer(data, [("fid", "<i4"), ("value", "<f4")], n, at + 4))
        ranks.append(np.full(n, rank))
        at, rank = at + 4 + 8 * n, rank + 1
    every = np.concatenate(cells) if cells else np.zeros(0, [("fid", "<i4"), ("value", "<f4")])
    return np.concatenate([np.zeros(0, np.int64), *ranks]), every["fid"].astype(np.int64), every["value"].astype(np.float64)


def decode_vectors(stored: DataFrame, key: str = "gid", data: str = "data") -> DataFrame:
    """``(<key>, rank, fid, value)`` of a column of stored vectors."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame[key], frame[data]):
                rank, fid, value = unpack_vectors(content, str(name))
                yield pd.DataFrame({key: name, "rank": rank, "fid": fid, "value": value})

    kind = dict(stored.dtypes)[key]
    return stored.select(key, data).mapInPandas(parse, f"{key} {kind}, rank bigint, fid bigint, value double")


def read_sparse_binary(spark: SparkSession, path: str) -> DataFrame:
    """``(gid, fid, value)`` of vectors stored as a count and that many (int32, float32); files follow each other by name."""
    cells = keep(decode_vectors(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content"), "file", "content"))
    sizes = cells.groupBy("file").agg((F.max("rank") + 1).alias("n"))  # a row per file
    before = sizes.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    return cells.join(before, "file").select((F.col("before") + F.col("rank")).alias("gid"), "fid", "value")


def read_numbers(spark: SparkSession, path: str, name: str = "y", kind: str = "double") -> DataFrame:
    """``(gid, <name>)``: white-space separated numbers in order, whatever the line layout."""
    words = numbered_lines(spark, path).select("line_no", F.posexplode(F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != "")).alias("i", "w"))
    sizes = words.groupBy(F.floor(F.col("line_no") / 1000).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("b", (F.sum("n").over(Window.orderBy("b")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("b").orderBy("line_no", "i")) - 1 + F.col("before")
    return words.withColumn("b", F.floor(F.col("line_no") / 1000)).join(before, "b").select(place.alias("gid"), F.col("w").cast(kind).alias(name))


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    return read_numbers(spark, path)


def read_index(spark: SparkSession, path: str | None, features: DataFrame) -> DataFrame:
    """``(gid)`` listed in the file, or all instances."""
    return features.select("gid").distinct() if path is None else read_numbers(spark, path, "id", "bigint").select(F.col("id").alias("gid"))


def read_multilabel(spark: SparkSession, path: str) -> DataFrame:
    """``(gid, task, y)``: one row of targets per instance, all of one width; lines of at most one character are skipped."""
    lines = keep(numbered_lines(spark, path).where(F.length("line") > 1).withColumn("w", F.split(F.trim("line"), r"\s+")))
    if lines.select(F.size("w")).distinct().limit(2).count() > 1:
        raise ValueError("rows of targets differ in width")
    order = Window.partitionBy("b").orderBy("line_no")
    blocks = lines.withColumn("b", F.floor(F.col("line_no") / 100_000))
    sizes = blocks.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("b", (F.sum("n").over(Window.orderBy("b")) - F.col("n")).alias("before"))
    gid = F.row_number().over(order) - 1 + F.col("before")
    return blocks.join(before, "b").withColumn("gid", gid).select("gid", F.posexplode("w").alias("task", "y")).withColumn("y", F.col("y").cast("double"))


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """``(fid, w)`` of a text model with lines ``bias b``, ``wscale s`` and ``w fid:value ...``; weights are scaled, the bias has fid -1.

    Weights may be spread over any number of ``w`` lines; only bias and scale reach the driver.
    """
    text = spark.read.text(path).select(F.trim("value").alias("value"))
    lines = text.select(F.split("value", r"\s+").alias("w"))
    known = text.where(F.substring("value", 1, 6).rlike(r"^(bias|wscale)")).select(F.split("value", r"\s+").alias("w"))
    heads = {r[0][0]: float(r[0][1]) for r in known.where(F.col("w")[0].isin("bias", "wscale") & (F.size("w") > 1)).limit(3).collect()}
    if set(heads) != {"bias", "wscale"} or not text.where(F.col("value").rlike(r"^w(\s|$)")).limit(1).count():
        raise ValueError(f"not a model: {path}")
    cells = lines.where(F.col("w")[0] == "w").select(F.explode(F.slice("w", F.lit(2), F.size("w") - 1)).alias("c"))
    part = lambda i: F.split_part("c", F.lit(":"), F.lit(i))
    weights = cells.select(part(1).cast("bigint").alias("fid"), (part(2).cast("double") * F.lit(heads["wscale"])).alias("w"))
    return spark.createDataFrame([(-1, heads["bias"])], "fid bigint, w double").unionByName(weights)


def read_models(spark: SparkSession, folder: str) -> DataFrame:
    """``(task, fid, w)`` of model_0, model_1, ... until one is missing, on whatever store holds the folder; none is an error."""
    out, task = None, 0
    here = lambda: spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/model_{task}")
    while here().getFileSystem(spark._jsc.hadoopConfiguration()).exists(here()):
        one = read_model(spark, f"{folder}/model_{task}").withColumn("task", F.lit(task))
        out, task = one if out is None else out.unionByName(one), task + 1
    if out is None:
        raise FileNotFoundError(f"no model_0 in {folder}")
    return out.select("task", "fid", "w")


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """``(gid, x array<double>)``: the numbers of every line."""
    return numbered_lines(spark, path).select(F.col("line_no").alias("gid"), F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.cast("double")).alias("x"))


#: Bond labels of the chemical format by its bond type (fixed values).
BONDS = {1: "s", 2: "d", 3: "t", 4: "a"}
#: Chemical symbols in order of atomic number (fixed values).
ELEMENTS = "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe".split()


def read_molecules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Molecules of SDF (V2000) files: vertices labelled by atomic number, edges a, s, d or t both ways.

    Molecules are numbered through all files in order of their names.
    """
    number = {e: str(i + 1) for i, e in enumerate(ELEMENTS)}

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, text in zip(frame.file, frame.value):
                rows = []
                for gid, block in enumerate(b for b in text.split("$$$$") if b.strip()):
                    lines = block.lstrip("\n").split("\n") if not block.startswith("\n\n") else block[1:].split("\n")
                    at = next((i for i, line in enumerate(lines) if "V2000" in line), None)
                    if at is None:
                        raise ValueError("only V2000 molecules are read")
                    atoms, bonds = int(lines[at][:3]), int(lines[at][3:6])
                    for i in range(atoms):
                        symbol = lines[at + 1 + i][31:34].strip()
                        rows.append((name, gid, i, None, number.get(symbol, symbol)))
                    for line in lines[at + 1 + atoms : at + 1 + atoms + bonds]:
                        a, b, kind = int(line[:3]) - 1, int(line[3:6]) - 1, int(line[6:9])
                        rows += [(name, gid, a, b, BONDS.get(kind, "s")), (name, gid, b, a, BONDS.get(kind, "s"))]
                yield pd.DataFrame(rows, columns=["file", "gid", "a", "b", "label"]).astype({"b": "Int64"})

    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = keep(texts.mapInPandas(parse, "file string, gid bigint, a int, b int, label string"))
    sizes = rows.groupBy("file").agg((F.max("gid") + 1).alias("n"))  # a row per file
    before = sizes.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    rows = rows.join(F.broadcast(before), "file").withColumn("gid", F.col("before") + F.col("gid")).drop("file", "before")
    vertices = vertex_rows(rows.where("b is null").select("gid", F.col("a").alias("vid"), "label"))
    return vertices, edge_rows(rows.where("b is not null").select("gid", F.col("a").alias("src"), F.col("b").alias("dst"), "label"))


def read_attribute_nodes(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, id, attributes)`` of lines ``v id key = value , key = value``; ``/`` lines are comments."""
    lines = numbered_lines(spark, path).where("line not like '/%' and line rlike '^v '")
    body = F.regexp_replace("line", r"^v\s+\S+\s*", "")
    pairs = F.transform(F.filter(F.split(body, r"\s*,\s*"), lambda p: p.contains("=")), lambda p: F.struct(F.trim(F.split_part(p, F.lit("="), F.lit(1))), F.trim(F.split_part(p, F.lit("="), F.lit(2)))))
    return lines.select("line_no", F.split(F.trim("line"), r"\s+")[1].cast("bigint").alias("id"), F.map_from_entries(pairs).alias("attributes"))


READERS: dict[str, Callable] = {"GRAPH": read_graphs, "SEQUENCE": read_sequences, "STRINGSEQ": read_strings, "SPARSE_VECTOR": read_sparse, "MOLECULAR_GRAPH": read_molecules}


def reader(file_type: str, binary: bool = False) -> Callable:
    """The reader of a file type."""
    if file_type == "SPARSE_VECTOR" and binary:
        return read_sparse_binary
    if file_type not in READERS:
        raise ValueError(f"unknown file type {file_type}; known: {', '.join(READERS)}")
    return READERS[file_type]
