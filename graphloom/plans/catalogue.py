"""Queries by name over whole tables, with their DuckDB statements.

Sequence graphs come from ``events`` (a chain per user), labelled graphs from ``vertices`` and ``edges``, sparse vectors from
``features``, dense ones from ``embeddings``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import hashing, stats
from graphloom.operators import density, graph_ops, graphs, kernels, learning, local_kernels, lsh, node_kernels, sampling, skew, vectors_ops
from graphloom.operators.nodes import current_nodes, profile_entries
from graphloom.operators.records import current_vectors
from graphloom.plans import oracles as O
from graphloom.sources import writers
from graphloom.store import keep

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its statement if SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_chains(spark, sf_dir):
    return graph_ops.sequences(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type"))


def graph(spark, sf_dir):
    v = keep(graph_ops.clean_vertices(table(spark, sf_dir, "vertices")))
    return v, keep(graph_ops.clean_edges(table(spark, sf_dir, "edges"), v))


def dense(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("gid"), F.col("embedding").cast("array<double>").alias("x"), "label")


def long_features(spark, sf_dir):
    v = current_vectors(table(spark, sf_dir, "features"))
    return v.select(F.col("id").alias("gid"), F.explode(F.arrays_zip("fids", "vals")).alias("e")).select("gid", F.col("e.fids").alias("fid"), F.col("e.vals").alias("value"))


def clean_targets(spark, sf_dir):
    return table(spark, sf_dir, "targets").where("gid is not null and y is not null").groupBy("gid").agg(F.max("y").alias("y"))


# --- hashes -----------------------------------------------------------------------------------------------------------
@query(f"SELECT DISTINCT event_type AS label, {O.h_text('event_type')} AS code FROM events WHERE event_type IS NOT NULL")
def hash_label(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("label")).where("label is not null").distinct().withColumn("code", hashing.hash_text("label"))


@query(O.h_list(["l_linenumber", "l_partkey", "l_suppkey", "l_orderkey"], "SELECT l_linenumber, l_partkey, l_suppkey, l_orderkey FROM lineitem", "l_orderkey, l_linenumber, l_partkey, l_suppkey", name="code"))
def hash_list(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", hashing.hash_values(*[F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_orderkey")]).alias("code"))


@query(O.int_hash("o_orderkey", "o_custkey % 10", "SELECT o_orderkey, o_custkey FROM orders", "o_orderkey, o_custkey % 10 AS seed"))
def int_hash(spark, sf_dir):
    t = table(spark, sf_dir, "orders")
    return t.select("o_orderkey", (F.col("o_custkey") % 10).alias("seed"), hashing.int_hash(F.col("o_orderkey"), F.col("o_custkey") % 10).alias("ih"))


# --- sequence graphs --------------------------------------------------------------------------------------------------
@query(f"WITH {O.SEQUENCE} SELECT * FROM sv")
def seq_graph_vertices(spark, sf_dir):
    return user_chains(spark, sf_dir)[0].select("gid", "vid", "label")


@query(f"WITH {O.SEQUENCE} SELECT * FROM se")
def seq_graph_edges(spark, sf_dir):
    return user_chains(spark, sf_dir)[1].select("gid", "src", "dst", "label")


_CODES = f"""WITH {O.SEQUENCE}, tx AS (SELECT v.gid, v.vid, v.label || ':' || string_agg(f.label || '-' || e.label, '.' ORDER BY f.label || '-' || e.label) AS t
 FROM sv v JOIN se e ON e.gid = v.gid AND e.src = v.vid JOIN sv f ON f.gid = e.gid AND f.vid = e.dst GROUP BY v.gid, v.vid, v.label
 UNION ALL SELECT gid, vid, label || ':' FROM sv v WHERE NOT EXISTS (SELECT 1 FROM se WHERE se.gid = v.gid AND se.src = v.vid)),
kt AS (SELECT t, {O.h_text('t')} AS code FROM (SELECT DISTINCT t FROM tx)), kl AS (SELECT label, {O.h_text('label')} AS code FROM (SELECT DISTINCT label FROM sv)),
co AS (SELECT gid, 0 AS r, vid, code FROM sv JOIN kl USING (label) UNION ALL SELECT gid, 1, vid, code FROM tx JOIN kt USING (t))"""


@query(_CODES + " SELECT * FROM co")
def vertex_codes(spark, sf_dir):
    return kernels.vertex_codes(*user_chains(spark, sf_dir), 1)


_PAIRS = _CODES + """, pr AS (SELECT a.gid, a.r, abs(a.vid - b.vid) AS d, a.code AS ca, b.code AS cb FROM co a JOIN co b ON a.gid = b.gid AND a.r = b.r AND abs(a.vid - b.vid) <= 2),
xy AS (SELECT gid, r, d, x, y, count(*) AS c FROM (SELECT gid, r, d, least(ca, cb) AS x, greatest(ca, cb) AS y FROM pr UNION ALL SELECT gid, r, d, 0, cb FROM pr) GROUP BY ALL),
ky AS (""" + O.h_list(["r", "d", "x", "y"], "SELECT DISTINCT r, d, x, y FROM xy", "r, d, x, y") + """),
ce AS (SELECT gid, r, d, fid, sum(c)::DOUBLE AS c FROM xy JOIN ky USING (r, d, x, y) GROUP BY ALL)"""
_NSPDK = _PAIRS + """, nr AS (SELECT gid, r, d, sqrt(sum(c * c)) AS n FROM ce GROUP BY ALL), ad AS (SELECT gid, fid, sum(c / n) AS v FROM ce JOIN nr USING (gid, r, d) GROUP BY ALL),
n2 AS (SELECT gid, sqrt(sum(v * v)) AS n FROM ad GROUP BY gid), ft AS (SELECT gid, fid, v / n AS value FROM ad JOIN n2 USING (gid))"""


def _user_parts(spark, sf_dir, by_vertex: bool = False):
    v, e = (keep(t) for t in user_chains(spark, sf_dir))
    return kernels.pair_features(v, graph_ops.bounded_distances(v, e, 2), keep(kernels.vertex_codes(v, e, 1)), by_vertex=by_vertex)


def _user_features(spark, sf_dir):
    return keep(kernels.instance_vectors(_user_parts(spark, sf_dir)))


@query(_PAIRS + " SELECT gid, r, d, fid, c AS count FROM ce")
def nspdk_counts(spark, sf_dir):
    return _user_parts(spark, sf_dir).groupBy("gid", "r", "d", "fid").agg(F.sum("count").alias("count"))


@query(_NSPDK + " SELECT gid, fid, round(value, 6) AS value FROM ft")
def nspdk_features(spark, sf_dir):
    return _user_features(spark, sf_dir).withColumn("value", F.round("value", 6))


@query(_NSPDK + """, dt AS (SELECT a.gid AS g, b.gid AS nid, round(sum(a.value * b.value), 7) AS k FROM ft a JOIN ft b USING (fid) GROUP BY a.gid, b.gid)
SELECT g AS gid, (row_number() OVER (PARTITION BY g ORDER BY k DESC, nid))::INT AS rank, nid, k FROM dt QUALIFY rank <= 10""")
def knn_users(spark, sf_dir):
    f = _user_features(spark, sf_dir)
    return lsh.exact_neighbours(f, f, 10, 7)


@query(_PAIRS + ", mk AS (" + O.h_list(["fid", "j"], "SELECT gid, fid, unnest(range(0, c::BIGINT)) AS j FROM (SELECT gid, fid, sum(c) AS c FROM ce GROUP BY ALL)", "gid", name="f") + ") SELECT DISTINCT gid, f AS fid, 1.0::DOUBLE AS value FROM mk")
def min_kernel(spark, sf_dir):
    return kernels.minimum_kernel(kernels.instance_vectors(_user_parts(spark, sf_dir), normalise=False))


@query()
def string_kernel(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("gid"), "text")
    return kernels.string_vectors(texts)


# --- labelled graphs --------------------------------------------------------------------------------------------------
@query(f"WITH {O.GRAPH} SELECT gid, vid, label, is_viewpoint, is_kernel_point, is_dead, is_abstraction FROM gv")
def graph_vertices(spark, sf_dir):
    return graph_ops.clean_vertices(table(spark, sf_dir, "vertices")).select("gid", "vid", "label", "is_viewpoint", "is_kernel_point", "is_dead", "is_abstraction")


@query(f"WITH {O.GRAPH} SELECT gid, src, dst, label FROM ge")
def graph_edges(spark, sf_dir):
    return graph(spark, sf_dir)[1].select("gid", "src", "dst", "label")


@query(f"WITH {O.GRAPH} SELECT e.gid, e.eid, e.src, e.dst FROM (SELECT DISTINCT gid, eid, src, dst FROM edges) e WHERE NOT EXISTS (SELECT 1 FROM gv WHERE gv.gid = e.gid AND gv.vid = e.src) OR NOT EXISTS (SELECT 1 FROM gv WHERE gv.gid = e.gid AND gv.vid = e.dst)")
def missing_ends(spark, sf_dir):
    e = table(spark, sf_dir, "edges").select("gid", "eid", "src", "dst").distinct()
    return graph_ops.missing_ends(e, graph_ops.clean_vertices(table(spark, sf_dir, "vertices")))


@query(f"WITH {O.GRAPH} SELECT gid, src AS vid, count(*) AS degree, CASE WHEN count(*) > 10 THEN 1 ELSE 0 END AS guarded FROM ge GROUP BY ALL")
def degree_guard(spark, sf_dir):
    return graph_ops.degrees(graph(spark, sf_dir)[1]).withColumn("guarded", F.when(F.col("degree") > kernels.MOST_DEGREE, 1).otherwise(0))


@query(f"WITH {O.GRAPH} SELECT gid, src, list_sort(list(dst)) AS neighbours, count(*) AS degree FROM ge GROUP BY ALL")
def adjacency(spark, sf_dir):
    return graph_ops.adjacency(graph(spark, sf_dir)[1])


def _distances(spark, sf_dir, horizon=2):
    v, e = graph(spark, sf_dir)
    return v, e, keep(graph_ops.bounded_distances(v, e, horizon))


@query(f"WITH {O.GRAPH}{O.distances(3)} SELECT * FROM dist")
def bounded_distance(spark, sf_dir):
    return _distances(spark, sf_dir, 3)[2]


@query(f"WITH {O.GRAPH}{O.distances(2)} SELECT gid, src AS root, count(*) AS size FROM dist GROUP BY ALL")
def ball_size(spark, sf_dir):
    return graph_ops.ball(_distances(spark, sf_dir)[2], 2).groupBy("gid", "root").agg(F.count(F.lit(1)).alias("size"))


@query(f"WITH {O.GRAPH}{O.distances(2)} SELECT DISTINCT w.gid, w.src, w.dst, a.dst AS vid FROM dist w JOIN dist a ON a.gid = w.gid AND a.src = w.src AND a.d <= 2 JOIN dist b ON b.gid = w.gid AND b.src = a.dst AND b.dst = w.dst WHERE a.d + b.d = w.d")
def shortest_path_union(spark, sf_dir):
    return graph_ops.path_unions(_distances(spark, sf_dir)[2], 2, 2)


@query(f"WITH {O.GRAPH}{O.distances(2)} SELECT DISTINCT a.gid, a.src AS root, a.dst AS parent, b.dst AS child, b.d AS level FROM dist a JOIN (SELECT DISTINCT gid, src, dst FROM ge) e ON e.gid = a.gid AND e.src = a.dst JOIN dist b ON b.gid = a.gid AND b.src = a.src AND b.dst = e.dst WHERE b.d = a.d + 1")
def bfs_dag(spark, sf_dir):
    _, e, d = _distances(spark, sf_dir)
    return graph_ops.bfs_dag(d, e)


@query(f"WITH {O.GRAPH}, n AS (SELECT gid, max(vid) + 1 AS n FROM gv GROUP BY gid) SELECT gid, vid, label FROM gv UNION ALL SELECT gid, vid + n, 'r.' || label FROM gv JOIN n USING (gid)")
def reverse_graph(spark, sf_dir):
    v = graph_ops.clean_vertices(table(spark, sf_dir, "vertices"))
    return graph_ops.reversed_copy(v, graph_ops.clean_edges(table(spark, sf_dir, "edges"), v, undirected=False))[0].select("gid", "vid", "label")


@query(f"""WITH RECURSIVE {O.GRAPH}, w AS (SELECT gid, vid, vid AS low FROM live UNION SELECT st.gid, st.dst, w.low FROM w JOIN st ON st.gid = w.gid AND st.src = w.vid)
SELECT gid, vid, min(low) AS component FROM w SEMI JOIN st ON st.gid = w.gid AND st.src = w.vid GROUP BY ALL""")
def graph_components(spark, sf_dir):
    v, e = graph(spark, sf_dir)
    live = graph_ops.alive(v)
    inner = graph_ops.induced(e.where("src <> dst"), live)
    node = lambda c: F.struct("gid", F.col(c).cast("bigint").alias("vid")).alias(c)
    found = graphs.components(inner.select(node("src"), node("dst")), "src", "dst")
    return found.select(F.col("id.gid").alias("gid"), F.col("id.vid").cast("int").alias("vid"), F.col("component.vid").cast("int").alias("component"))


@query(f"""WITH {O.GRAPH}{O.distances(2)}, kl AS (SELECT label, {O.h_text('label')} AS code FROM (SELECT DISTINCT label FROM gv)), dg AS (SELECT gid, src AS vid, count(*) AS n FROM ge GROUP BY ALL),
co AS (SELECT gv.gid, gv.vid, CASE WHEN n > 10 THEN 1 ELSE code END AS code FROM gv JOIN kl USING (label) LEFT JOIN dg ON dg.gid = gv.gid AND dg.vid = gv.vid),
pr AS (SELECT t.gid, t.src AS vid, t.d, a.code AS ca, b.code AS cb FROM dist t JOIN gv s ON s.gid = t.gid AND s.vid = t.src JOIN gv u ON u.gid = t.gid AND u.vid = t.dst JOIN co a ON a.gid = t.gid AND a.vid = t.src JOIN co b ON b.gid = t.gid AND b.vid = t.dst
 WHERE s.is_viewpoint AND s.is_kernel_point AND u.is_kernel_point),
xy AS (SELECT gid, vid, d, x, y, count(*) AS c FROM (SELECT gid, vid, d, least(ca, cb) AS x, greatest(ca, cb) AS y FROM pr UNION ALL SELECT gid, vid, d, 0, cb FROM pr) GROUP BY ALL),
ky AS ({O.h_list(["0", "d", "x", "y"], "SELECT DISTINCT d, x, y FROM xy", "d, x, y")}) SELECT gid, vid, fid, sum(c)::DOUBLE AS value FROM xy JOIN ky USING (d, x, y) GROUP BY ALL""")
def nspdk_per_vertex(spark, sf_dir):
    v, e, d = _distances(spark, sf_dir)
    return kernels.vertex_vectors(kernels.pair_features(v, d, kernels.vertex_codes(v, e, 0)))


def _local(name: str, **options):
    def run(spark, sf_dir):
        v, e = graph(spark, sf_dir)
        ends = skew.unsent(graph_ops.alive(v).select("gid", F.col("vid").alias("dst")))
        sides = e.where("not is_dead and (is_part_of or is_abstraction_of)").join(ends, ["gid", "dst"], "left_semi").groupBy("gid", "src").agg(F.max(F.col("is_part_of")).alias("p"), F.max(F.col("is_abstraction_of")).alias("a")).where("p and a")
        whole = v.join(sides.select("gid", F.col("src").alias("vid"), F.lit(True).alias("both")), ["gid", "vid"], "left")
        v = whole.withColumn("is_dead", F.col("is_dead") | (F.col("is_abstraction") & F.col("both").isNull())).drop("both")
        return local_kernels.local_features(v, e, name, local_kernels.Config(**options)).withColumn("value", F.round("value", 6))

    run.__name__ = f"local_{name.lower()}"
    return query()(run)


for _name, _options in {
    "NSPDK": {"radius": 2, "distance": 3}, "SK": {"radius": 1, "distance": 2}, "USPK": {"radius": 1, "distance": 2}, "WDK": {"radius": 1, "distance": 2}, "PBK": {"radius": 1, "distance": 2, "degree_threshold": 3},
    "DDK": {"radius": 2, "distance": 2}, "NSDDK": {"radius": 1, "distance": 1, "radius_two": 1}, "ANSDDK": {"radius": 1, "distance": 1, "radius_two": 1},
}.items():
    _local(_name, **_options)


# --- dense vectors, neighbours and density ----------------------------------------------------------------------------
def _gram(spark, sf_dir):
    e = dense(spark, sf_dir).select("gid", "x")
    return vectors_ops.dense_dots(e, e)


def _neighbours(spark, sf_dir):
    e = dense(spark, sf_dir).select("gid", "x")
    return keep(vectors_ops.dense_neighbours(e, e))


@query(f"WITH {O.EMBEDDED} SELECT gid_a, gid_b, round(k, 6) AS k FROM gram")
def gram_matrix(spark, sf_dir):
    return _gram(spark, sf_dir).withColumn("k", F.round("k", 6))


@query(f"""WITH {O.EMBEDDED}, r AS (SELECT avg(k) AS v FROM gram), a AS (SELECT sum(k) / (count(DISTINCT gid_a) * (count(DISTINCT gid_a) - 1)) AS v FROM gram WHERE gid_a <> gid_b)
SELECT round(r.v, 6) AS mean_rc, round(a.v, 6) AS mean_rr, round(a.v, 6) AS mean_cc, round(r.v / sqrt(a.v * a.v), 6) AS similarity FROM r, a""")
def gram_summary(spark, sf_dir):
    e, g = dense(spark, sf_dir).select("gid", "x"), keep(_gram(spark, sf_dir))
    return vectors_ops.gram_summary(g, e, e, g, g).select(*[F.round(c, 6).alias(c) for c in ("mean_rc", "mean_rr", "mean_cc", "similarity")])


@query(f"""WITH {O.EMBEDDED}, y AS (SELECT gid, CASE WHEN label >= 5 THEN 1.0 ELSE -1.0 END AS y FROM ev), n AS (SELECT count(*)::DOUBLE AS n FROM y)
SELECT round(sum(k * a.y * b.y) / sqrt(sum(k * k) * (any_value(n) * any_value(n) - any_value(n))), 6) AS alignment FROM gram JOIN y a ON a.gid = gid_a JOIN y b ON b.gid = gid_b, n WHERE gid_a <> gid_b""")
def target_alignment(spark, sf_dir):
    y = dense(spark, sf_dir).select("gid", F.when(F.col("label") >= 5, 1.0).otherwise(-1.0).alias("y"))
    return vectors_ops.target_alignment(_gram(spark, sf_dir), y).select(F.round("alignment", 6).alias("alignment"))


@query(f"WITH {O.NEIGHBOURS} SELECT gid, rank::INT AS rank, nid, round(k, 6) AS k FROM nb")
def knn_exact(spark, sf_dir):
    return _neighbours(spark, sf_dir).withColumn("k", F.round("k", 6))


@query(f"WITH {O.NEIGHBOURS} SELECT nb.gid, list(nid ORDER BY rank) AS ids, list(round(k, 6) ORDER BY rank) AS products, list(CASE WHEN ev.label >= 5 THEN 1.0 ELSE -1.0 END::DOUBLE ORDER BY rank) AS targets FROM nb JOIN ev ON ev.gid = nb.nid GROUP BY nb.gid")
def knn_lists(spark, sf_dir):
    y = dense(spark, sf_dir).select("gid", F.when(F.col("label") >= 5, 1.0).otherwise(-1.0).alias("y"))
    return lsh.neighbour_lists(_neighbours(spark, sf_dir).withColumn("k", F.round("k", 6)), y).select("gid", "ids", "products", "targets")


@query(f"WITH {O.NEIGHBOURS} SELECT a.gid, a.rank::INT AS rank, a.nid, round(a.k, 6) AS k FROM nb a SEMI JOIN nb b ON b.gid = a.nid AND b.nid = a.gid")
def knn_mutual(spark, sf_dir):
    return lsh.mutual(_neighbours(spark, sf_dir)).withColumn("k", F.round("k", 6))


@query(f"WITH {O.NEIGHBOURS}, l AS (SELECT gid, list(nid) AS l FROM nb GROUP BY gid) SELECT nb.gid, nb.nid, len(list_intersect(a.l, b.l))::INT AS shared, round(len(list_intersect(a.l, b.l)) / sqrt(len(a.l) * len(b.l)), 6) AS similarity FROM nb JOIN l a ON a.gid = nb.gid JOIN l b ON b.gid = nb.nid")
def shared_similarity(spark, sf_dir):
    return lsh.shared_neighbours(_neighbours(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {O.DENSITY} SELECT gid, round(density, 6) AS density, round(sd, 6) AS sd FROM ds")
def local_density(spark, sf_dir):
    return density.local_density(_neighbours(spark, sf_dir)).select("gid", F.round("density", 6).alias("density"), F.round("sd", 6).alias("sd"))


@query(f"""WITH {O.NEIGHBOURS}, pr AS (SELECT a.gid, a.nid AS u, round(1 - g.k, 9) AS d FROM nb a JOIN nb b ON a.gid = b.gid AND a.nid <> b.nid JOIN gram g ON g.gid_a = a.nid AND g.gid_b = b.nid),
rk AS (SELECT gid, u, d, count(*) OVER (PARTITION BY gid, u) AS n, row_number() OVER (PARTITION BY gid, u ORDER BY d) AS i FROM pr WHERE d <> 0), md AS (SELECT gid, u, max(d) FILTER (i = least(ceil(n * 0.5) + 1, n)) AS m FROM rk GROUP BY ALL),
vo AS (SELECT nb.gid, exp(sum(ln(abs(coalesce(m, 1))))) AS v FROM nb LEFT JOIN md ON md.gid = nb.gid AND md.u = nb.nid GROUP BY nb.gid) SELECT gid, round((1 / v) / sum(1 / v) OVER (), 6) AS p FROM vo""")
def voronoi_density(spark, sf_dir):
    nb = _neighbours(spark, sf_dir)
    return density.voronoi_density(nb, vectors_ops.neighbour_products(nb, dense(spark, sf_dir))).select("gid", F.round("p", 6).alias("p"))


def _dense_state(spark, sf_dir):
    nb = _neighbours(spark, sf_dir)
    return nb, keep(density.local_density(nb))


@query()
def dense_centers(spark, sf_dir):
    return density.dense_centres(*_dense_state(spark, sf_dir))


@query(f"""WITH RECURSIVE {O.DENSITY}, tp AS (SELECT gid FROM ds WHERE density IS NOT NULL ORDER BY round(density, 9) DESC, gid LIMIT 20), li AS (SELECT gid AS c, nid FROM nb JOIN tp USING (gid)),
me AS (SELECT a.c AS a, b.c AS b FROM li a JOIN li b ON a.nid = b.nid AND a.c <> b.c GROUP BY ALL HAVING count(*) >= 3), w AS (SELECT a AS c, a AS low FROM me UNION SELECT me.b, w.low FROM w JOIN me ON me.a = w.c),
gr AS (SELECT c, min(low) AS cluster FROM w GROUP BY c) SELECT cluster, list_sort(list(DISTINCT nid)) AS members FROM gr JOIN li USING (c) GROUP BY cluster""")
def connected_centers(spark, sf_dir):
    return density.connected_centres(*_dense_state(spark, sf_dir))


@query(f"WITH {O.SHIFT} SELECT * FROM pa")
def quick_shift_parents(spark, sf_dir):
    return density.quick_shift_parents(*_dense_state(spark, sf_dir))


@query(f"""WITH RECURSIVE {O.SHIFT}, up AS (SELECT gid, parent AS at FROM pa UNION SELECT up.gid, pa.parent FROM up JOIN pa ON pa.gid = up.at), ro AS (SELECT up.gid, up.at AS root FROM up JOIN pa ON pa.gid = up.at WHERE pa.parent = up.at),
wt AS (SELECT nb.gid, sum(k) AS w FROM nb JOIN ro a ON a.gid = nb.gid JOIN ro b ON b.gid = nb.nid WHERE a.root = b.root AND nb.gid <> nb.nid GROUP BY nb.gid) SELECT root AS cluster, ro.gid, round(coalesce(w, 0), 6) AS weight FROM ro LEFT JOIN wt USING (gid)""")
def quick_shift_clusters(spark, sf_dir):
    return density.quick_shift_clusters(*_dense_state(spark, sf_dir))


_Y = "y AS (SELECT gid, CASE WHEN gid % 3 = 0 THEN 0.0 WHEN label >= 5 THEN 1.0 ELSE -1.0 END AS y FROM ev)"
_SPREAD = f"WITH {O.NEIGHBOURS}, {_Y}, s AS (SELECT gid, nid, k / sum(k) OVER (PARTITION BY gid) AS s FROM nb WHERE gid <> nid AND k <> 0), f0 AS (SELECT gid, y AS f FROM y)" + "".join(
    f", f{i + 1} AS (SELECT y.gid, 0.99 * coalesce(g, 0) + (1 - 0.99) * y AS f FROM y LEFT JOIN (SELECT s.gid, sum(s.s * f{i}.f) AS g FROM s JOIN f{i} ON f{i}.gid = s.nid GROUP BY s.gid) p ON p.gid = y.gid)" for i in range(3))


@query(_SPREAD + " SELECT gid, round(f, 6) AS f FROM f3")
def label_spreading(spark, sf_dir):
    y = dense(spark, sf_dir).select("gid", F.when(F.col("gid") % 3 == 0, 0.0).when(F.col("label") >= 5, 1.0).otherwise(-1.0).alias("y"))
    return density.label_spreading(_neighbours(spark, sf_dir), y).select("gid", F.round("f", 6).alias("f"))


# --- signatures -------------------------------------------------------------------------------------------------------
_SIGN = f"WITH {O.CURRENT}, kx AS (" + O.int_hash("fid", "l", "SELECT gid, fid, unnest(range(1, 11)) AS l FROM fv", "gid, l", "key") + "), sg AS (SELECT gid, (least(key // 53687091, 39) + (l - 1) * 40)::INT AS slot, min(key) AS key FROM kx GROUP BY ALL)"
_INDEX = _SIGN + ", ix AS (SELECT gid, slot, key FROM sg WHERE key <> 0 QUALIFY count(*) OVER (PARTITION BY slot, key) < 1000)"
_SIZES = _SIGN.replace("sg AS (", "sg AS MATERIALIZED (") + ", cn AS (SELECT gid, slot, key, count(*) OVER (PARTITION BY slot, key) AS n FROM sg), zs AS (SELECT gid, slot, CASE WHEN key <> 0 AND n < 1000 THEN n ELSE 0 END AS size FROM cn)"


def _signed(spark, sf_dir):
    return keep(lsh.signatures(long_features(spark, sf_dir)))


@query(_SIGN + " SELECT * FROM sg")
def minhash_signature(spark, sf_dir):
    return _signed(spark, sf_dir)


@query(_SIZES + " SELECT * FROM zs")
def bucket_sizes(spark, sf_dir):
    s = _signed(spark, sf_dir)
    return lsh.bucket_sizes(s, lsh.index(s))


@query(_SIZES + ", rk AS (SELECT gid, size, count(*) OVER (PARTITION BY gid) AS n, row_number() OVER (PARTITION BY gid ORDER BY size) AS i FROM zs), sc AS (SELECT gid, max(size) FILTER (i = least(ceil(n * 0.5) + 1, n)) AS score FROM rk GROUP BY gid) SELECT * FROM sc WHERE score >= (SELECT min(score) FROM (SELECT score FROM sc ORDER BY score DESC LIMIT 1000))")
def pre_cluster_filter(spark, sf_dir):
    s = _signed(spark, sf_dir)
    return density.pre_cluster_filter(lsh.bucket_sizes(s, lsh.index(s)), 1000)


def _user_signed(spark, sf_dir):
    f = _user_features(spark, sf_dir)
    return f, keep(lsh.signatures(f))


_USIGN = _NSPDK + ", kx AS (" + O.int_hash("fid", "l", "SELECT gid, fid, unnest(range(1, 11)) AS l FROM ft", "gid, l", "key") + "), sg AS (SELECT gid, least(key // 53687091, 39) + (l - 1) * 40 AS slot, min(key) AS key FROM kx GROUP BY ALL), ix AS (SELECT gid, slot, key FROM sg WHERE key <> 0 QUALIFY count(*) OVER (PARTITION BY slot, key) < 1000), cd AS (SELECT a.gid, b.gid AS nid, count(*) AS hits FROM sg a JOIN ix b USING (slot, key) GROUP BY ALL HAVING count(*) >= 2), ct AS (SELECT * FROM cd QUALIFY row_number() OVER (PARTITION BY gid ORDER BY hits DESC, nid) <= 50)"


@query(_USIGN + " SELECT * FROM ct")
def lsh_candidates(spark, sf_dir):
    _, s = _user_signed(spark, sf_dir)
    return lsh.candidates(s, lsh.index(s))


@query()
def knn_approx(spark, sf_dir):
    f = _user_features(spark, sf_dir)
    return lsh.approximate_neighbours(f, f).withColumn("k", F.round("k", 6))


@query()
def lsh_accuracy(spark, sf_dir):
    f = _user_features(spark, sf_dir)
    return lsh.accuracy(lsh.approximate_neighbours(f, f), lsh.exact_neighbours(f, f))


# --- statistics, sampling and learning --------------------------------------------------------------------------------
_RANKED = "WITH r AS (SELECT l_partkey, l_quantity AS v, count(*) OVER (PARTITION BY l_partkey) AS n, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity) AS i FROM lineitem WHERE l_quantity <> -1)"
_AT = "max(v) FILTER (i = least(ceil(n * {q}) + 1, n)) AS q{p}"
_QUANTILES = ", ".join(_AT.format(q=q, p=f"{int(q * 100):02d}") for q in (0.05, 0.25, 0.5, 0.75, 0.95))


@query(f"{_RANKED} SELECT l_partkey, count(*) AS num, round(sum(v), 4) AS sum, round(avg(v), 6) AS avg, round(stddev_samp(v), 6) AS sd, min(v) AS min, max(v) AS max, {_QUANTILES} FROM r GROUP BY l_partkey")
def order_statistics(spark, sf_dir):
    s = stats.summary(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_quantity")
    return s.withColumns({"sum": F.round("sum", 4), "avg": F.round("avg", 6), "sd": F.round("sd", 6)})


@query(f"{_RANKED}, m AS (SELECT l_partkey, {_AT.format(q=0.5, p='m')} FROM r GROUP BY l_partkey), a AS (SELECT l_partkey, abs(v - qm) AS v, n, row_number() OVER (PARTITION BY l_partkey ORDER BY abs(v - qm)) AS i FROM r JOIN m USING (l_partkey)) SELECT l_partkey, max(v) FILTER (i = least(ceil(n * 0.5) + 1, n)) AS mad FROM a GROUP BY l_partkey")
def median_difference(spark, sf_dir):
    return stats.median_absolute_difference(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_quantity")


_DRAWN = f"WITH {O.TARGETS}, hx AS (" + O.int_hash("gid", "1", "SELECT gid, y FROM tg", "gid, y") + ")"


@query(_DRAWN + " SELECT gid, y, CASE WHEN y <> 0 THEN ((row_number() OVER (PARTITION BY y ORDER BY ih, gid) - 1) % 10)::INT END AS fold FROM hx")
def cv_folds(spark, sf_dir):
    return sampling.cross_validation_folds(clean_targets(spark, sf_dir))


@query(_DRAWN + ", rk AS (SELECT gid, y, count(*) OVER (PARTITION BY y) AS n, row_number() OVER (PARTITION BY y ORDER BY ih, gid) - 1 AS r FROM hx WHERE y IN (1, -1)), mx AS (SELECT max(n) AS m FROM rk) SELECT (r + t * n) * 2 + CASE WHEN y < 0 THEN 1 ELSE 0 END AS pos, gid, y FROM (SELECT *, unnest(range(0, (m - 1 - r) // n + 1)) AS t FROM rk, mx)")
def balanced_set(spark, sf_dir):
    return sampling.class_balanced(clean_targets(spark, sf_dir).where("y <> 0"))


@query(_DRAWN + " SELECT gid, row_number() OVER (ORDER BY ih, gid) <= floor(count(*) OVER () * 0.3) AS chosen FROM hx")
def random_partition(spark, sf_dir):
    return sampling.partitioned(clean_targets(spark, sf_dir).select("gid"), 0.3)


_WEIGHTS = "md AS (SELECT DISTINCT fid, ((fid % 7) - 3) / 10.0 AS w FROM fv)"
_MARGINS = f"WITH {O.CURRENT}, {_WEIGHTS}, mg AS (SELECT gid, sum(value * w) + 0.05 AS margin FROM fv JOIN md USING (fid) GROUP BY gid)"


def _weights(features):
    own = features.select("fid").distinct().select("fid", ((F.col("fid") % 7 - 3) / 10.0).alias("w"))
    return own.unionByName(own.sparkSession.createDataFrame([(learning.BIAS_FID, 0.05)], "fid bigint, w double"))


@query(_MARGINS + " SELECT gid, round(margin, 6) AS margin, CASE WHEN margin > 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS prediction FROM mg")
def predict_margins(spark, sf_dir):
    f = long_features(spark, sf_dir)
    return learning.predict(f, _weights(f)).withColumn("margin", F.round("margin", 6))


@query(_MARGINS + f", {O.TARGETS}, s AS (SELECT y, CASE WHEN margin > 0 THEN 1.0 ELSE -1.0 END AS p FROM mg JOIN tg USING (gid)), c AS (SELECT count(*) FILTER (y > 0 AND p > 0) AS tp, count(*) FILTER (y < 0 AND p > 0) AS fp, count(*) FILTER (y < 0 AND p < 0) AS tn, count(*) FILTER (y > 0 AND p < 0) AS fn, count(*) FILTER (y = 0 OR (y > 0) <> (p > 0)) AS errors, count(*) AS total FROM s), m AS (SELECT *, tp / (tp + fp) AS pp, tp / (tp + fn) AS rp, tn / (tn + fn) AS pn, tn / (tn + fp) AS rn FROM c) SELECT tp, fp, tn, fn, errors, total, round((2 * pp * rp / (pp + rp) + 2 * pn * rn / (pn + rn)) / 2, 6) AS f_balanced FROM m")
def confusion_metrics(spark, sf_dir):
    f = long_features(spark, sf_dir)
    scored = learning.predict(f, _weights(f)).join(clean_targets(spark, sf_dir), "gid")
    return learning.metrics(scored).select("tp", "fp", "tn", "fn", "errors", "total", F.round("f_balanced", 6).alias("f_balanced"))


@query(f"WITH {O.CURRENT}, {_WEIGHTS}, p AS (SELECT gid, fid, value * w AS v FROM fv JOIN md USING (fid)), n AS (SELECT gid, sqrt(sum(v * v)) AS n FROM p GROUP BY gid HAVING sqrt(sum(v * v)) > 0) SELECT gid, fid, round(v / n, 6) AS value FROM p JOIN n USING (gid)")
def feature_scaled(spark, sf_dir):
    f = long_features(spark, sf_dir)
    return vectors_ops.scaled(f, _weights(f)).withColumn("value", F.round("value", 6))


@query()
def svm_train(spark, sf_dir):
    return learning.train(long_features(spark, sf_dir), clean_targets(spark, sf_dir), learning.TrainConfig(epochs=10))


@query()
def cross_validation(spark, sf_dir):
    return learning.cross_validate(long_features(spark, sf_dir), clean_targets(spark, sf_dir), 10, learning.TrainConfig(epochs=10))


@query()
def self_training(spark, sf_dir):
    return learning.self_train(long_features(spark, sf_dir), clean_targets(spark, sf_dir), rounds=3, config=learning.TrainConfig(epochs=10))


@query()
def embed_places(spark, sf_dir):
    return learning.embed(_neighbours(spark, sf_dir), iterations=5000)


@query(f"WITH {O.CURRENT} SELECT gid, fid, value FROM fv")
def current_features(spark, sf_dir):
    return long_features(spark, sf_dir)


@query(f"WITH {O.CURRENT} SELECT gid, fid, value, count(*) OVER (PARTITION BY fid) AS held_by FROM fv")
def feature_support(spark, sf_dir):
    f = keep(long_features(spark, sf_dir))
    return skew.with_key_counts(f, ["fid"], f.count(), "held_by")


# --- further graph, export and node queries ---------------------------------------------------------------------------
_YEARS = "ov AS (SELECT o_custkey AS gid, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1)::INT AS vid, o_orderpriority AS label, year(o_orderdate) AS part FROM orders)"


def _year_chains(spark, sf_dir):
    v, _ = graph_ops.sequences(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], F.col("o_orderpriority"))
    from pyspark.sql import Window

    place = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1).cast("int")
    parts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("gid"), place.alias("vid"), F.year("o_orderdate").alias("part"))
    return v, parts


@query(f"""WITH {_YEARS}, ps AS (SELECT DISTINCT gid, part FROM ov), pq AS (SELECT a.gid, a.part AS p, b.part AS q FROM ps a JOIN ps b ON a.gid = b.gid AND a.part < b.part), sz AS (SELECT gid, max(vid) + 1 AS n FROM ov GROUP BY gid),
nw AS (SELECT pq.gid, p, q, (n + row_number() OVER (PARTITION BY pq.gid ORDER BY p, q) - 1)::INT AS vid FROM pq JOIN sz USING (gid))
SELECT nw.gid, nw.vid AS src, ov.vid AS dst, '@-' AS label FROM nw JOIN ov ON ov.gid = nw.gid AND ov.part = nw.p UNION ALL SELECT nw.gid, nw.vid, ov.vid, '^-' FROM nw JOIN ov ON ov.gid = nw.gid AND ov.part = nw.q""")
def component_interaction(spark, sf_dir):
    return graph_ops.component_links(*_year_chains(spark, sf_dir))[1].select("gid", "src", "dst", "label")


_GSPAN = f"""WITH {O.GRAPH}, li AS (SELECT gid, 0 AS kind, vid AS a, 0 AS b, CASE WHEN NOT is_kernel_point AND NOT is_abstraction THEN 'W' WHEN NOT is_viewpoint AND NOT is_abstraction THEN 'V' ELSE 'v' END || ' ' || vid || ' ' || label AS t FROM gv
UNION ALL SELECT gid, 1, src, dst, 'e ' || src || ' ' || dst || ' ' || label FROM ge WHERE src < dst)
SELECT gid, 't\n' || string_agg(t, '\n' ORDER BY kind, a, b, t) || '\n' AS text FROM li GROUP BY gid""".replace("'t\n'", "'t' || chr(10)").replace("'\n'", "chr(10)")


@query(_GSPAN)
def export_gspan(spark, sf_dir):
    return writers.export("gspan", *graph(spark, sf_dir))


@query(f"WITH {O.GRAPH} SELECT e.gid, e.src, a.label AS src_label, e.dst, b.label AS dst_label, e.label FROM ge e JOIN gv a ON a.gid = e.gid AND a.vid = e.src JOIN gv b ON b.gid = e.gid AND b.vid = e.dst WHERE e.src < e.dst")
def export_edges(spark, sf_dir):
    return writers.export("csv", *graph(spark, sf_dir))


@query()
def export_dot(spark, sf_dir):
    return writers.export("dot", *graph(spark, sf_dir))


@query()
def export_matrix(spark, sf_dir):
    return writers.export("matrix", *graph(spark, sf_dir))


@query(f"WITH {O.GRAPH} SELECT gid, vid FROM gv WHERE is_dead OR label = (SELECT min(label) FROM gv WHERE label <> '')")
def killed_vertices(spark, sf_dir):
    v = graph_ops.clean_vertices(table(spark, sf_dir, "vertices"))
    label = v.where("label <> ''").agg(F.min("label")).first()[0]
    return graph_ops.kill_by_label(v, label).where("is_dead").select("gid", "vid")


@query(f"WITH {O.GRAPH}{O.distances(2)} SELECT q.gid, q.src, q.dst, coalesce(dist.d, -1) AS d FROM (SELECT DISTINCT gid, src, dst FROM ge) q LEFT JOIN dist USING (gid, src, dst)")
def pair_distance(spark, sf_dir):
    _, e, d = _distances(spark, sf_dir)
    return graph_ops.pair_distance(e.select("gid", "src", "dst").distinct(), d)


@query()
def feature_dictionary(spark, sf_dir):
    v, e = graph(spark, sf_dir)
    return local_kernels.feature_dictionary(v.where("not is_abstraction"), e, local_kernels.Config(radius=1, distance=1))


_VERTEX_PARTS = _PAIRS.replace("SELECT a.gid, a.r,", "SELECT a.gid, a.vid, a.r,").replace("SELECT gid, r, d, x, y, count(*)", "SELECT gid, vid, r, d, x, y, count(*)").replace("SELECT gid, r, d, least", "SELECT gid, vid, r, d, least").replace("SELECT gid, r, d, 0, cb", "SELECT gid, vid, r, d, 0, cb")
_LAPLACE = _VERTEX_PARTS.replace("ce AS (SELECT gid, r, d, fid, sum(c)::DOUBLE AS c FROM", "ce AS (SELECT gid, vid, fid, sum(c)::DOUBLE AS c FROM") + """,
sm AS (SELECT a.fid AS fid_i, b.fid AS fid_j, round(sum(b.c), 9) AS s FROM ce a JOIN ce b ON a.gid = b.gid AND a.vid = b.vid GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY fid_i ORDER BY s DESC, fid_j) AS r FROM sm),
kp AS (SELECT rk.* FROM rk LEFT JOIN (SELECT fid_i, s AS bar FROM rk WHERE r = 11) b USING (fid_i) WHERE (bar IS NULL OR s > bar) AND fid_i <> fid_j)
SELECT fid_i, fid_j, round(-s / sqrt(sum(s * s) OVER (PARTITION BY fid_i)), 6) AS v FROM kp UNION ALL SELECT DISTINCT fid_i, fid_i, 1.0 FROM sm"""


@query(_LAPLACE)
def correlation_laplacian(spark, sf_dir):
    parts = kernels.vertex_vectors(_user_parts(spark, sf_dir, by_vertex=True))
    return vectors_ops.correlation_laplacian(keep(parts), 10).withColumn("v", F.round("v", 6))


@query("""WITH ln AS (SELECT nid, m_svector FROM (SELECT *, row_number() OVER (PARTITION BY nid ORDER BY loaded_at DESC NULLS LAST, recorded_at DESC NULLS LAST) AS k FROM nodes WHERE nid IS NOT NULL) WHERE k = 1),
pe AS (SELECT nid, e.fid AS fid, e."value" AS v, count(*) AS m FROM (SELECT nid, unnest(m_svector['profile']) AS e FROM ln) WHERE e."value" <> 0 AND e.fid IS NOT NULL GROUP BY ALL)
SELECT nid, fid, round(sum(v), 6) AS value, sum(m)::BIGINT AS occurrences FROM pe GROUP BY nid, fid HAVING sum(v) <> 0""")
def node_profiles(spark, sf_dir):
    return profile_entries(current_nodes(table(spark, sf_dir, "nodes"), ("m_svector",))).withColumn("value", F.round("value", 6))


@query()
def node_projections(spark, sf_dir):
    entries = profile_entries(current_nodes(table(spark, sf_dir, "nodes"), ("m_svector",)))
    return node_kernels.signed_projection(entries.select(F.col("nid").alias("gid"), "fid", "value"), 8).withColumn("value", F.round("value", 6))


@query("""WITH ln AS (SELECT nid, m_svector FROM (SELECT *, row_number() OVER (PARTITION BY nid ORDER BY loaded_at DESC NULLS LAST, recorded_at DESC NULLS LAST) AS k FROM nodes WHERE nid IS NOT NULL) WHERE k = 1),
pe AS (SELECT DISTINCT nid, fid FROM (SELECT nid, e.fid AS fid, e."value" AS v FROM (SELECT nid, unnest(m_svector['profile']) AS e FROM ln)) WHERE v <> 0 AND fid IS NOT NULL), kx AS (""" + O.int_hash("fid", "s", "SELECT nid, fid, unnest(range(1, 5)) AS s FROM pe", "nid, fid, s", "key") + """)
SELECT nid AS gid, s AS k, arg_min(fid, {'key': key, 'fid': fid}) AS fid FROM kx GROUP BY ALL""")
def node_minhash(spark, sf_dir):
    entries = profile_entries(current_nodes(table(spark, sf_dir, "nodes"), ("m_svector",)))
    return node_kernels.minhash_projection(entries.select(F.col("nid").alias("gid"), "fid", "value"), 4)


@query()
def node_features(spark, sf_dir):
    current = current_nodes(table(spark, sf_dir, "nodes"), ("m_number", "m_discrete", "m_bool", "m_svector"))
    return node_kernels.attribute_features(current).withColumn("value", F.round("value", 6))
