"""Further queries: files written and read again, and operators of the library on the test tables, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import density, graph_ops, kernels, learning, lsh, node_kernels, sampling, vectors_ops
from graphloom.operators.nodes import current_nodes, profile_entries
from graphloom.operators.skew import unsent
from graphloom.plans import oracles as O
from graphloom.plans.catalogue import _NSPDK, _USIGN, _WEIGHTS, ORACLES, _distances, _user_features, _weights, dense, graph, long_features, query, table
from graphloom.sources import readers, writers
from graphloom.store import keep, scratch


# --- files written and read again -------------------------------------------------------------------------------------
def _written(lines: DataFrame, *order: str) -> str:
    """The path of a text file of the ``line`` column in the given order."""
    path = scratch(lines.sparkSession)
    writers.write_text(lines.orderBy(*order).select("line"), path)
    return path


def _plain(label: str):
    return F.when(F.col(label) == "", "?").otherwise(F.regexp_replace(label, r"\s+", "_"))


_TEXT = f"""WITH {O.GRAPH}, nv AS (SELECT *, dense_rank() OVER (ORDER BY gid) - 1 AS no, CASE WHEN label = '' THEN '?' ELSE regexp_replace(label, '\\s+', '_', 'g') END AS l FROM gv),
ne AS (SELECT no, src, dst, CASE WHEN label = '' THEN '?' ELSE regexp_replace(label, '\\s+', '_', 'g') END AS l FROM ge JOIN (SELECT DISTINCT gid, no FROM nv) USING (gid) WHERE src < dst)"""


def _graph_text(spark, sf_dir):
    v, e = graph(spark, sf_dir)
    text = writers.export("gspan", v.withColumn("label", _plain("label")), e.withColumn("label", _plain("label")))
    return readers.reader("GRAPH")(spark, _written(text.select("gid", F.col("text").alias("line")), "gid"))


@query(_TEXT + """ SELECT no AS gid, vid, l AS label, NOT starts_with(l, '^') AND (is_viewpoint OR is_abstraction) AND (is_kernel_point OR is_abstraction) AS is_viewpoint,
NOT starts_with(l, '^') AND (is_kernel_point OR is_abstraction) AS is_kernel_point, starts_with(l, '^') AS is_abstraction FROM nv""")
def read_graph_vertices(spark, sf_dir):
    return _graph_text(spark, sf_dir)[0].select("gid", "vid", "label", "is_viewpoint", "is_kernel_point", "is_abstraction")


@query(_TEXT + """ SELECT no AS gid, src, dst, l AS label, starts_with(l, '^') AS is_abstraction_of, starts_with(l, '@') AS is_part_of FROM ne
UNION ALL SELECT no, dst, src, l, starts_with(l, '^'), starts_with(l, '@') FROM ne""")
def read_graph_edges(spark, sf_dir):
    return _graph_text(spark, sf_dir)[1].select("gid", "src", "dst", "label", "is_abstraction_of", "is_part_of")


@query(f"WITH {O.CURRENT} SELECT dense_rank() OVER (ORDER BY gid) - 1 AS gid, fid, round(value, 6) AS value FROM fv")
def read_sparse_text(spark, sf_dir):
    path = _written(writers.sparse_lines(long_features(spark, sf_dir)), "gid")
    return readers.reader("SPARSE_VECTOR")(spark, path).withColumn("value", F.round("value", 6))


@query(f"WITH {O.CURRENT} SELECT gid, fid, value::FLOAT::DOUBLE AS value FROM fv")
def sparse_binary(spark, sf_dir):
    return readers.decode_vectors(writers.sparse_binary(long_features(spark, sf_dir))).select("gid", "fid", "value")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS gid, o_totalprice AS y FROM orders")
def read_targets_text(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return readers.read_targets(spark, _written(o.select("o_orderkey", F.col("o_totalprice").cast("string").alias("line")), "o_orderkey"))


@query(f"WITH {O.CURRENT} SELECT DISTINCT gid FROM fv WHERE gid IN (SELECT o_orderkey FROM orders)")
def read_index_text(spark, sf_dir):
    f = long_features(spark, sf_dir)
    path = _written(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("line")), "o_orderkey")
    return f.join(readers.read_index(spark, path, f), "gid", "left_semi").select("gid").distinct()


@query("""WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS gid, * FROM orders) SELECT gid, 0 AS task, o_custkey::DOUBLE AS y FROM o UNION ALL SELECT gid, 1, o_totalprice FROM o""")
def read_multilabel_text(spark, sf_dir):
    line = F.concat_ws(" ", F.col("o_custkey").cast("string"), F.col("o_totalprice").cast("string")).alias("line")
    return readers.read_multilabel(spark, _written(table(spark, sf_dir, "orders").select("o_orderkey", line), "o_orderkey"))


@query(f"WITH {O.CURRENT}, {_WEIGHTS} SELECT fid, w FROM md UNION ALL SELECT -1, 0.05")
def read_model_text(spark, sf_dir):
    path = scratch(spark)
    writers.write_text(writers.model_lines(_weights(long_features(spark, sf_dir))), path)
    return readers.read_model(spark, path)


@query(f"WITH {O.CURRENT}, {_WEIGHTS} SELECT 0 AS task, fid, w FROM md UNION ALL SELECT 0, -1, 0.05 UNION ALL SELECT 1, fid, -2 * w FROM md UNION ALL SELECT 1, -1, -0.1")
def read_models_text(spark, sf_dir):
    folder, model = scratch(spark), _weights(long_features(spark, sf_dir))
    for task, factor in enumerate((1, -2)):
        writers.write_text(writers.model_lines(model.withColumn("w", F.col("w") * factor)), f"{folder}/model_{task}")
    return readers.read_models(spark, folder)


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS gid, o_orderpriority || ' ' || o_orderkey AS text FROM orders")
def read_strings_text(spark, sf_dir):
    line = F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("line")
    return readers.reader("STRINGSEQ")(spark, _written(table(spark, sf_dir, "orders").select("o_orderkey", line), "o_orderkey"))


@query(f"WITH {O.SEQUENCE} SELECT dense_rank() OVER (ORDER BY gid) - 1 AS gid, vid, label FROM sv")
def read_token_sequences(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("user_id is not null")
    lines = e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda r: r["event_type"]), " ").alias("line"))
    return readers.reader("SEQUENCE")(spark, _written(lines, "user_id"), tokens=True)[0].select("gid", "vid", "label")


_CHARS = "p AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS gid, p_brand AS b, reverse(p_brand) AS d FROM part), ch AS (SELECT *, unnest(range(0, len(b)))::INT AS i FROM p)"


@query(f"WITH {_CHARS} SELECT gid, i AS src, (i - 1)::INT AS dst, substr(b, i + 1, 1) AS a, substr(b, i, 1) AS b FROM ch WHERE i > 0")
def read_character_sequences(spark, sf_dir):
    path = _written(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("line")), "p_partkey")
    v, e = readers.reader("SEQUENCE")(spark, path, directed=True)
    names = unsent(v.select("gid", "vid", "label"))
    return e.select("gid", "src", "dst").join(names.toDF("gid", "src", "a"), ["gid", "src"]).join(names.toDF("gid", "dst", "b"), ["gid", "dst"]).select("gid", "src", "dst", "a", "b")


@query(f"WITH {_CHARS} SELECT gid, (2 * i)::INT AS vid, substr(b, i + 1, 1) AS label, true AS is_viewpoint FROM ch UNION ALL SELECT gid, (2 * i + 1)::INT, substr(d, i + 1, 1), false FROM ch")
def read_parallel_sequences(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    lines = p.select("p_partkey", F.posexplode(F.array("p_brand", F.reverse("p_brand"))).alias("m", "line"))
    return readers.reader("SEQUENCE")(spark, _written(lines, "p_partkey", "m"), degree=2)[0].select("gid", "vid", "label", "is_viewpoint")


@query("SELECT gid, (i - 1)::INT AS i, round(x[i]::DOUBLE, 6) AS v FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS gid, embedding AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def read_coordinates_text(spark, sf_dir):
    lines = table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), " ").alias("line"))
    return readers.read_coordinates(spark, _written(lines, "vec_id")).select("gid", F.posexplode("x").alias("i", "v")).withColumn("v", F.round("v", 6))


def _document(vertex: str, edge: str, head: str, tail: str, vertices: str = "gv") -> str:
    return f"""WITH {O.GRAPH}, fs AS (SELECT gid, label, min(vid) AS f FROM gv GROUP BY ALL), cl AS (SELECT gid, label, (row_number() OVER (PARTITION BY gid ORDER BY f) - 1) % {len(writers.COLOURS)} AS c FROM fs),
gc AS (SELECT gv.*, {writers.COLOURS}[c + 1] AS colour FROM gv JOIN cl USING (gid, label)),
li AS (SELECT gid, 0 AS kind, vid AS a, 0 AS b, {vertex} AS t FROM {vertices} UNION ALL SELECT gid, 1, src, dst, {edge} FROM ge WHERE src < dst)
SELECT gid, '{head}' || string_agg(t, chr(10) ORDER BY kind, a, b, t) || '{tail}' AS text FROM li GROUP BY gid""".replace("\\n'", "' || chr(10)").replace("'\\n", "chr(10) || '")


@query(_document("""'node [ id ' || vid || ' label "' || label || '" ]'""", """'edge [ source ' || src || ' target ' || dst || ' label "' || label || '" ]'""", "graph [\\n", "\\n]"))
def export_gml(spark, sf_dir):
    return writers.export("gml", *graph(spark, sf_dir))


@query(_document("""'node: { title: "' || vid || '" label: "' || label || '" }'""", """'edge: { source: "' || src || '" target: "' || dst || '" label: "' || label || '" }'""", "graph: {\\n", "\\n}"))
def export_gdl(spark, sf_dir):
    return writers.export("gdl", *graph(spark, sf_dir))


@query(f"""WITH {O.GRAPH}, li AS (SELECT gid, 0 AS kind, vid AS a, 0 AS b, vid || ':' || label AS t FROM gv UNION ALL SELECT gid, 1, src, dst, src || '>' || dst || ':' || label FROM ge)
SELECT gid, string_agg(t, ' ' ORDER BY kind, a, b, t) AS text FROM li GROUP BY gid""")
def serialised_graphs(spark, sf_dir):
    return writers.serialise(*graph(spark, sf_dir))


@query(_document("x", "y", "", "").split("gc AS")[0].rstrip().rstrip(",") + f" SELECT gid, label, {writers.COLOURS}[c + 1] AS colour FROM cl")
def label_colours(spark, sf_dir):
    return writers.label_colours(graph(spark, sf_dir)[0])


ORACLES["export_dot"] = _document(
    """vid || ' [label="' || label || '" color=' || colour || ' shape=' || CASE WHEN kind THEN 'ellipse' ELSE 'box' END || CASE WHEN is_dead THEN ' style=dashed' ELSE '' END || ']'""",
    """src || ' -- ' || dst || ' [label="' || label || '"]'""", "graph g {\\n", "\\n}", "gc"
).replace("r.kp AS is_kernel_point, ", "r.kp AS is_kernel_point, r.kind AS kind, ").replace("gv.*,", "gv.* EXCLUDE (kind), gv.kind AS kind,").replace("0 AS kind, vid AS a", "0 AS o, vid AS a").replace("SELECT gid, 1, src", "SELECT gid, 1 AS o, src").replace("ORDER BY kind, a", "ORDER BY o, a")
ORACLES["export_matrix"] = f"""WITH {O.GRAPH}, n AS (SELECT gid, max(vid) + 1 AS n, string_agg(label, ' ' ORDER BY vid, label) AS nl FROM gv GROUP BY gid), ids AS (SELECT gid, unnest(range(0, n)) AS v FROM n),
ls AS (SELECT gid, src AS v, list_sort(list(DISTINCT dst)) AS l FROM ge GROUP BY ALL), ro AS (SELECT ids.gid, ids.v, coalesce(l, []) AS l, n FROM ids JOIN n USING (gid) LEFT JOIN ls ON ls.gid = ids.gid AND ls.v = ids.v),
am AS (SELECT gid, string_agg(array_to_string(list_transform(range(0, n), lambda u: CASE WHEN list_contains(l, u) THEN '1' ELSE '0' END), ' '), chr(10) ORDER BY v) AS am, string_agg(array_to_string(l, ' '), chr(10) ORDER BY v) AS al FROM ro GROUP BY gid),
el AS (SELECT gid, string_agg(src || ' ' || dst || ' ' || label, chr(10) ORDER BY src, dst, label) AS el FROM ge GROUP BY gid) SELECT n.gid, am, al, nl, coalesce(el, '') AS el FROM n JOIN am USING (gid) LEFT JOIN el USING (gid)"""


@query(f"WITH {O.GRAPH}, n AS (SELECT gid, max(vid) + 1 AS n FROM gv GROUP BY gid) SELECT gid, src, dst, label FROM g1 UNION ALL SELECT gid, (dst + n)::INT, (src + n)::INT, label FROM g1 JOIN n USING (gid)")
def reverse_graph_edges(spark, sf_dir):
    v = graph_ops.clean_vertices(table(spark, sf_dir, "vertices"))
    return graph_ops.reversed_copy(v, graph_ops.clean_edges(table(spark, sf_dir, "edges"), v, undirected=False))[1].select("gid", "src", "dst", "label")


# --- graphs -----------------------------------------------------------------------------------------------------------
@query(f"WITH {O.GRAPH} SELECT gid, src, dst, label, dead AS is_dead, up AS is_abstraction_of, part AS is_part_of FROM ge")
def graph_edge_flags(spark, sf_dir):
    return graph(spark, sf_dir)[1].select("gid", "src", "dst", "label", *graph_ops.EDGE_FLAGS)


@query(f"WITH {O.GRAPH}{O.distances(2)} SELECT gid, src, dst FROM dist WHERE d = 2")
def vertices_at_distance(spark, sf_dir):
    return graph_ops.at_distance(_distances(spark, sf_dir)[2], 2).select("gid", "src", "dst")


@query(f"""WITH {O.GRAPH}{O.distances(2)}, pu AS (SELECT DISTINCT w.gid, w.src, w.dst, a.dst AS vid FROM dist w JOIN dist a ON a.gid = w.gid AND a.src = w.src AND a.d <= 2 JOIN dist b ON b.gid = w.gid AND b.src = a.dst AND b.dst = w.dst WHERE a.d + b.d = w.d AND w.d <= 2)
SELECT DISTINCT pu.gid, pu.src, pu.dst, n.dst AS vid FROM pu JOIN dist n ON n.gid = pu.gid AND n.src = pu.vid WHERE n.d <= 1""")
def thick_paths(spark, sf_dir):
    return graph_ops.thick_path_unions(_distances(spark, sf_dir)[2], 2, 2, 1)


@query(f"WITH {O.GRAPH} SELECT ge.gid, src, dst, ge.label FROM ge SEMI JOIN (SELECT * FROM gv WHERE is_kernel_point) a ON a.gid = ge.gid AND a.vid = ge.src SEMI JOIN (SELECT * FROM gv WHERE is_kernel_point) b ON b.gid = ge.gid AND b.vid = ge.dst")
def induced_edges(spark, sf_dir):
    v, e = graph(spark, sf_dir)
    return graph_ops.induced(e, v.where("is_kernel_point")).select("gid", "src", "dst", "label")


@query(f"WITH {O.GRAPH}{O.distances(1)} SELECT DISTINCT r.gid, r.src AS root, e.src, e.dst FROM dist r JOIN ge e ON e.gid = r.gid AND e.src = r.dst SEMI JOIN dist q ON q.gid = r.gid AND q.src = r.src AND q.dst = e.dst")
def rooted_subgraphs(spark, sf_dir):
    _, e, d = _distances(spark, sf_dir, 1)
    balls = graph_ops.ball(d, 1).select("gid", "root", "vid")
    inner = balls.select("gid", "root", F.col("vid").alias("src")).join(e.select("gid", "src", "dst"), ["gid", "src"])
    return inner.join(balls.select("gid", "root", F.col("vid").alias("dst")), ["gid", "root", "dst"], "left_semi").select("gid", "root", "src", "dst").distinct()


@query(f"WITH {O.GRAPH} SELECT DISTINCT gid FROM gv WHERE gid NOT IN (SELECT gid FROM live)")
def unsound_graphs(spark, sf_dir):
    v, _, d = _distances(spark, sf_dir, 1)
    return graph_ops.unsound(v, d)


# --- vectors ----------------------------------------------------------------------------------------------------------
@query(f"WITH {O.CURRENT} SELECT gid, fid, least(2.0, greatest(-2.0, value * value))::DOUBLE AS value FROM fv")
def elementwise_product(spark, sf_dir):
    f = keep(long_features(spark, sf_dir))
    return vectors_ops.elementwise(f, f, 2.0)


@query(f"WITH {O.CURRENT} SELECT gid, fid, 1.0::DOUBLE AS value FROM fv")
def binarised(spark, sf_dir):
    return vectors_ops.binarised(long_features(spark, sf_dir))


@query(_NSPDK + ", h AS (" + O.h_list(["fid", "42"], "SELECT gid, fid AS old, fid, value FROM ft", "gid, old, value") + ") SELECT gid, fid, round(arg_max(value, old), 6) AS value FROM h GROUP BY ALL")
def rehashed(spark, sf_dir):
    return kernels.rehash(_user_features(spark, sf_dir), 42).withColumn("value", F.round("value", 6))


@query(_NSPDK + """, dt AS (SELECT a.gid AS g, b.gid AS nid, round(sum(a.value * b.value), 7) AS k FROM ft a JOIN ft b USING (fid) GROUP BY a.gid, b.gid), nb AS (SELECT g, nid, k FROM dt QUALIFY row_number() OVER (PARTITION BY g ORDER BY k DESC, nid) <= 10),
nr2 AS (SELECT g, nid FROM nb WHERE k > 0.925 AND round(k, 6) < 1), sz AS (SELECT g, count(*) AS n FROM nr2 GROUP BY g), me AS (SELECT g, fid AS old, fid, sum(value) / any_value(n) AS value FROM nr2 JOIN sz USING (g) JOIN ft ON ft.gid = nid GROUP BY g, fid),
h AS (""" + O.h_list(["fid", "42"], "SELECT * FROM me", "g, old, value") + """), al AS (SELECT gid, fid, value FROM ft UNION ALL SELECT g, fid, arg_max(value, old) FROM h GROUP BY g, fid), sm AS (SELECT gid, fid, sum(value) AS value FROM al GROUP BY ALL)
SELECT gid, fid, round(value / sqrt(sum(value * value) OVER (PARTITION BY gid)), 6) AS value FROM sm""")
def smoothed_users(spark, sf_dir):
    f = _user_features(spark, sf_dir)
    return vectors_ops.smoothed(f, lsh.exact_neighbours(f, f, 10, 7), 0.925).withColumn("value", F.round("value", 6))


@query(_NSPDK + ", kx AS (" + O.int_hash("fid", "slot", "SELECT gid, fid, unnest(range(1, 9)) AS slot FROM ft", "gid, slot", "key") + ") SELECT gid, slot::INT AS slot, min(key) AS key FROM kx GROUP BY ALL")
def fixed_minhash(spark, sf_dir):
    return lsh.fixed_minhash(_user_features(spark, sf_dir), 8)


@query(_NSPDK + ", kx AS (" + O.int_hash("fid", "l", "SELECT gid, fid, unnest(range(1, 11)) AS l FROM ft", "gid, l", "key") + "), sg AS (SELECT gid, least(key // 53687091, 39) + (l - 1) * 40 AS slot, min(key) AS key FROM kx GROUP BY ALL), g AS (SELECT DISTINCT gid FROM sg), al AS (SELECT g.gid, s, coalesce(key, 2147483648) AS key FROM (SELECT gid, unnest(range(0, 400)) AS s FROM g) g LEFT JOIN sg ON sg.gid = g.gid AND sg.slot = g.s) SELECT gid, list(key ORDER BY s) AS signature FROM al GROUP BY gid")
def minhash_action(spark, sf_dir):
    return lsh.full_signatures(keep(lsh.signatures(_user_features(spark, sf_dir))))


_PROFILES = """WITH ln AS (SELECT nid, m_number, m_discrete, m_bool, m_svector FROM (SELECT *, row_number() OVER (PARTITION BY nid ORDER BY loaded_at DESC NULLS LAST, recorded_at DESC NULLS LAST) AS k FROM nodes WHERE nid IS NOT NULL) WHERE k = 1),
pe AS (SELECT nid, fid, sum(v) AS v FROM (SELECT DISTINCT nid, e.fid AS fid, e."value" AS v FROM (SELECT nid, unnest(m_svector['profile']) AS e FROM ln)) WHERE v <> 0 AND fid IS NOT NULL GROUP BY ALL HAVING sum(v) <> 0)"""
_SIGNS = _PROFILES + ", kx AS (" + O.int_hash("fid", "k", "SELECT nid, fid, v, unnest(range(1, 9)) AS k FROM pe", "nid, k, v", "h") + "), sp AS (SELECT nid AS gid, k::INT AS k, sqrt(3.0::DOUBLE) * sum(CASE h % 6 WHEN 0 THEN v ELSE -v END) AS value FROM kx WHERE h % 6 < 2 GROUP BY ALL)"


def _profile_rows(spark, sf_dir):
    return profile_entries(current_nodes(table(spark, sf_dir, "nodes"), ("m_svector",))).select(F.col("nid").alias("gid"), "fid", "value")


ORACLES["node_projections"] = _SIGNS + " SELECT gid, k, round(value, 6) AS value FROM sp"


@query(_SIGNS + " SELECT gid, (k * 2 + (value < 0)::INT)::BIGINT AS fid, round(abs(value), 6) AS value FROM sp WHERE value <> 0")
def orthant_projections(spark, sf_dir):
    return node_kernels.orthant_projection(_profile_rows(spark, sf_dir), 8).withColumn("value", F.round("value", 6))


@query(_PROFILES + ", ls AS (SELECT nid AS gid, flatten(list([fid, trunc(v * 10000)::BIGINT] ORDER BY fid)) AS l FROM pe GROUP BY nid) SELECT gid, (list_reduce(list_transform(l, lambda b: b & 4294967295), lambda h, v, i: xor(h, CASE WHEN (i + 1) % 2 = 0 THEN xor(h << 7, v * (h >> 3)) ELSE xor(xor(((h << 11) + v) & 4294967295, h >> 5), 4294967295) END) & 4294967295, 2863311530::BIGINT) & 1073741823) AS code FROM ls")
def vector_codes(spark, sf_dir):
    return kernels.vector_codes(_profile_rows(spark, sf_dir))


_B = 30
_NODE_FEATURES = _PROFILES + f""", nu AS (SELECT nid, unnest(map_keys(m_number)) AS key, unnest(map_values(m_number)) AS v FROM ln), di AS (SELECT nid, unnest(map_keys(m_discrete)) AS key, unnest(map_values(m_discrete)) AS tx FROM ln), bo AS (SELECT nid, unnest(map_keys(m_bool)) AS key, unnest(map_values(m_bool)) AS v FROM ln),
kk AS (SELECT key, {O.h_text('key', _B)} AS hk FROM (SELECT key FROM nu UNION SELECT key FROM di UNION SELECT key FROM bo)), tt AS (SELECT tx, {O.h_text('tx', _B)} AS ht FROM (SELECT DISTINCT lower(trim(tx)) AS tx FROM di WHERE tx IS NOT NULL)),
f1 AS (""" + O.h_list(["1", "hk"], "SELECT nid, hk, v FROM nu JOIN kk USING (key) WHERE v IS NOT NULL", "1 AS space, nid, v", _B) + """), f2 AS (""" + O.h_list(["2", "hk", "ht"], "SELECT nid, hk, ht FROM (SELECT nid, key, lower(trim(tx)) AS tx FROM di WHERE tx IS NOT NULL) JOIN kk USING (key) JOIN tt USING (tx)", "2 AS space, nid, 1.0::DOUBLE AS v", _B) + """),
f3 AS (""" + O.h_list(["3", "hk"], "SELECT nid, hk FROM bo JOIN kk USING (key) WHERE v", "3 AS space, nid, 1.0::DOUBLE AS v", _B) + """), f4 AS (""" + O.h_list(["4", "id"], "SELECT nid, fid AS id, v FROM pe", "4 AS space, nid, v", _B) + """),
al AS (SELECT space, nid, fid, sum(v) AS v FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3 UNION ALL SELECT * FROM f4) GROUP BY ALL), nm AS (SELECT space, nid, sqrt(sum(v * v)) AS n FROM al GROUP BY ALL HAVING sqrt(sum(v * v)) > 0), sm AS (SELECT nid, fid, sum(v / n) AS v FROM al JOIN nm USING (space, nid) GROUP BY ALL)
SELECT nid AS gid, fid, round(v / sqrt(sum(v * v) OVER (PARTITION BY nid)), 6) AS value FROM sm"""


ORACLES["node_features"] = _NODE_FEATURES


@query("WITH fk AS (" + O.h_list(["7919", "0", "label"], "SELECT vec_id AS gid, label, embedding::DOUBLE[] AS x FROM embeddings", "gid, x") + "), ex AS (SELECT gid, fid, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS i FROM fk), dr AS (" + O.int_hash("i", "fid & 32767", "SELECT * FROM ex", "gid, fid, v", "h") + ") SELECT gid, fid, round(sqrt(3.0::DOUBLE) * sum(CASE h % 6 WHEN 0 THEN v WHEN 1 THEN -v ELSE 0 END), 6) AS value FROM dr GROUP BY ALL")
def real_vectors(spark, sf_dir):
    pairs = dense(spark, sf_dir).select("gid", F.col("label").cast("bigint").alias("fid"), F.col("x").alias("vec"))
    return kernels.real_vector_features(pairs).withColumn("value", F.round("value", 6))


_NEAR = _USIGN + """, lb AS (SELECT slot, key FROM sg WHERE key <> 0 GROUP BY ALL HAVING count(*) >= 1000), big AS (SELECT DISTINCT gid FROM sg JOIN lb USING (slot, key)),
k1 AS (SELECT ct.gid, ct.nid, coalesce(sum(a.value * b.value), 0) AS k FROM ct JOIN ft a ON a.gid = ct.gid LEFT JOIN ft b ON b.gid = ct.nid AND b.fid = a.fid GROUP BY ALL),
k2 AS (SELECT a.gid, b.gid AS nid, sum(a.value * b.value) AS k FROM ft a JOIN ft b USING (fid) WHERE a.gid IN (SELECT gid FROM big) AND b.gid IN (SELECT gid FROM big) GROUP BY a.gid, b.gid),
k3 AS (SELECT gid, nid, round(max(k), 9) AS k FROM (SELECT * FROM k1 UNION ALL SELECT * FROM k2) GROUP BY ALL), an AS (SELECT gid, (row_number() OVER (PARTITION BY gid ORDER BY k DESC, nid))::INT AS rank, nid, k FROM k3 QUALIFY rank <= 10)"""
ORACLES["knn_approx"] = _NEAR + " SELECT gid, rank, nid, round(k, 6) AS k FROM an"
ORACLES["lsh_accuracy"] = _NEAR + """, xa AS (SELECT a.gid AS g, b.gid AS nid, round(sum(a.value * b.value), 9) AS k FROM ft a JOIN ft b USING (fid) GROUP BY a.gid, b.gid), ex AS (SELECT g AS gid, nid FROM xa WHERE k <> 0 QUALIFY row_number() OVER (PARTITION BY g ORDER BY k DESC, nid) <= 10)
SELECT ex.gid, count(an.nid) / least(10, count(*)) AS accuracy FROM ex LEFT JOIN an ON an.gid = ex.gid AND an.nid = ex.nid GROUP BY ex.gid"""
ORACLES["dense_centers"] = f"""WITH RECURSIVE {O.DENSITY}, tp AS (SELECT gid, row_number() OVER (ORDER BY round(density, 9) DESC, gid) AS r FROM ds WHERE density IS NOT NULL QUALIFY r <= 20), li AS (SELECT tp.gid AS centre, r, list_sort(list(nid)) AS members FROM tp JOIN nb USING (gid) GROUP BY ALL),
g AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS seen, false AS taken, -1::BIGINT AS centre, []::BIGINT[] AS members UNION ALL SELECT li.r, CASE WHEN len(seen) = 0 OR len(list_intersect(seen, li.members)) <= 3 THEN list_distinct(list_concat(seen, li.members)) ELSE seen END, len(seen) = 0 OR len(list_intersect(seen, li.members)) <= 3, li.centre, li.members FROM g JOIN li ON li.r = g.r + 1)
SELECT centre, r::INT AS rank, members FROM g WHERE taken"""


# --- sampling and learning --------------------------------------------------------------------------------------------
_VECS = "SELECT vec_id AS gid FROM embeddings"


@query("SELECT gid FROM (" + O.int_hash("gid", "1", _VECS, "gid") + ") WHERE ih < floor(0.3 * 2147483648)")
def sampled_ids(spark, sf_dir):
    return density.sampled(dense(spark, sf_dir).select("gid"), 0.3)


@query("SELECT gid, row_number() OVER (ORDER BY ih, gid) - 1 AS place FROM (" + O.int_hash("gid", "1", _VECS, "gid") + ")")
def shuffled_ids(spark, sf_dir):
    path = scratch(spark)
    writers.write_text(sampling.shuffled(dense(spark, sf_dir).select("gid")).select(F.col("gid").cast("string")), path)
    return readers.numbered_lines(spark, path).select(F.col("line").cast("bigint").alias("gid"), F.col("line_no").alias("place"))


@query("WITH h AS (" + O.int_hash("gid", "1", _VECS, "gid") + "), n AS (SELECT count(*) AS n FROM h) SELECT h.gid AS draw, ih % n AS gid FROM h, n")
def bootstrap_draws(spark, sf_dir):
    return sampling.bootstrap(dense(spark, sf_dir).select("gid"))[0]


@query(f"WITH {O.CURRENT}, h AS (" + O.int_hash("fid", "1", "SELECT gid, fid, value FROM fv", "gid, fid, value") + "), a AS (SELECT gid, fid, row_number() OVER (PARTITION BY gid ORDER BY fid) AS i FROM h), b AS (SELECT gid, value, row_number() OVER (PARTITION BY gid ORDER BY ih, fid) AS i FROM h) SELECT a.gid, a.fid, b.value FROM a JOIN b USING (gid, i)")
def permuted_vectors(spark, sf_dir):
    return sampling.permuted(keep(long_features(spark, sf_dir)))


@query(f"WITH {O.CURRENT}, {O.TARGETS}, up AS (SELECT gid, fid, value FROM fv SEMI JOIN (SELECT gid FROM tg WHERE y = 1) USING (gid)) SELECT gid, fid, value FROM up UNION ALL SELECT -1 - gid, fid, -value FROM up")
def one_class_copies(spark, sf_dir):
    up = table(spark, sf_dir, "targets").where("gid is not null and y is not null").groupBy("gid").agg(F.max("y").alias("y")).where("y = 1")
    return learning.one_class(long_features(spark, sf_dir).join(up, "gid", "left_semi").select("gid", "fid", "value"), up)[0]


@query(f"WITH {O.CURRENT}, {_WEIGHTS}, s AS (SELECT gid, sum(value * w) AS s FROM fv JOIN md USING (fid) GROUP BY gid) SELECT gid, 0 AS task, round(s + 0.05, 6) AS margin FROM s UNION ALL SELECT gid, 1, round(-2 * s - 0.1, 6) FROM s")
def predict_several(spark, sf_dir):
    f = keep(long_features(spark, sf_dir))
    model = _weights(f)
    models = keep(model.withColumn("task", F.lit(0)).unionByName(model.select("fid", (F.col("w") * -2).alias("w"), F.lit(1).alias("task"))))
    return learning.predict_tasks(f, models).withColumn("margin", F.round("margin", 6))


@query(f"WITH {O.EMBEDDED} SELECT round(avg(pow(sqrt(pow(a.x[1] - b.x[1], 2) + pow(a.x[2] - b.x[2], 2)) - (1 - k), 2)), 6) AS stress FROM gram JOIN ev a ON a.gid = gid_a JOIN ev b ON b.gid = gid_b WHERE gid_a <> gid_b")
def embedding_stress(spark, sf_dir):
    e = dense(spark, sf_dir).select("gid", "x")
    return learning.average_stress(e.select("gid", F.slice("x", 1, 2).alias("x")), vectors_ops.dense_dots(e, e)).select(F.round("stress", 6).alias("stress"))
