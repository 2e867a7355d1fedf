"""Building blocks of the DuckDB statements."""


def h_list(columns: list[str], source: str, keep: str, bits: int = 15, name: str = "fid") -> str:
    """A subquery that adds H of the columns, a nested SELECT per element."""
    inner = f"SELECT *, 2863311530::BIGINT AS h FROM ({source})"
    for i, c in enumerate(columns):
        v = f"(({c})::BIGINT & 4294967295)"
        t = f"xor(xor(((h << 11) + {v}) & 4294967295, h >> 5), 4294967295)" if i % 2 else f"xor(h << 7, {v} * (h >> 3))"
        inner = f"SELECT * EXCLUDE (h), xor(h, {t}) & 4294967295 AS h FROM ({inner})"
    return f"SELECT {keep}, h & {(1 << bits) - 1} AS {name} FROM ({inner})"


def h_text(text: str, bits: int = 15) -> str:
    """H of a string's signed bytes."""
    value = f"list_transform(range(0, octet_length(encode({text}))::BIGINT), lambda p: ('0x' || substr(hex(encode({text})), 2 * p + 1, 2))::BIGINT)"
    signed = f"list_transform({value}, lambda b: CASE WHEN b > 127 THEN b + 4294967040 ELSE b END)"
    step = "xor(h, CASE WHEN (i + 1) % 2 = 0 THEN xor(h << 7, v * (h >> 3)) ELSE xor(xor(((h << 11) + v) & 4294967295, h >> 5), 4294967295) END) & 4294967295"
    return f"(list_reduce({signed}, lambda h, v, i: {step}, 2863311530::BIGINT) & {(1 << bits) - 1})"


def int_hash(key: str, seed: str, source: str, keep: str, name: str = "ih") -> str:
    """A subquery that adds the integer hash of ``key`` under ``seed``."""
    wrap = lambda e: f"((({e}) + 2147483648) & 4294967295) - 2147483648"
    q = f"SELECT *, floor(((({key})::BIGINT * (({seed})::BIGINT + 1)) & 4294967295) * (sqrt(2) - 1))::BIGINT AS k_ FROM ({source})"
    for e in (wrap("(-1 - k_) + (k_ << 15)"), "xor(k_, k_ >> 12)", wrap("k_ + (k_ << 2)"), "xor(k_, k_ >> 4)", wrap("k_ * 2057"), "xor(k_, k_ >> 16) & 2147483647"):
        q = f"SELECT * REPLACE ({e} AS k_) FROM ({q})"
    return f"SELECT {keep}, k_ AS {name} FROM ({q})"


SEQUENCE = """
sv AS (SELECT user_id AS gid, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS vid, event_type AS label FROM events WHERE user_id IS NOT NULL),
se AS (SELECT gid, vid AS src, vid - 1 AS dst, '-' AS label FROM sv WHERE vid > 0 UNION ALL SELECT gid, vid - 1, vid, '-' FROM sv WHERE vid > 0)"""

GRAPH = """
gv AS (SELECT gid, vid, r.label AS label, r.vp AS is_viewpoint, r.kp AS is_kernel_point, r.dead AS is_dead, r.abs AS is_abstraction FROM (SELECT gid, vid, min({'label': coalesce(lower(rtrim(label)), ''),
  'vp': coalesce(is_viewpoint, true), 'kp': coalesce(is_kernel_point, true), 'kind': coalesce(kind, true), 'dead': coalesce(is_dead, false), 'abs': coalesce(is_abstraction, false)}) AS r
  FROM vertices WHERE gid IS NOT NULL AND vid IS NOT NULL GROUP BY gid, vid)),
g1 AS (SELECT DISTINCT e.gid, e.src, e.dst, coalesce(lower(rtrim(e.label)), '') AS label, coalesce(e.is_dead, false) AS dead, coalesce(is_abstraction_of, false) AS up, coalesce(is_part_of, false) AS part
  FROM edges e SEMI JOIN gv a ON a.gid = e.gid AND a.vid = e.src SEMI JOIN gv b ON b.gid = e.gid AND b.vid = e.dst),
ge AS (SELECT * FROM g1 UNION SELECT gid, dst, src, label, dead, up, part FROM g1),
live AS (SELECT gid, vid FROM gv WHERE NOT is_dead AND NOT is_abstraction),
st AS (SELECT DISTINCT ge.gid, src, dst FROM ge SEMI JOIN live a ON a.gid = ge.gid AND a.vid = ge.src SEMI JOIN live b ON b.gid = ge.gid AND b.vid = ge.dst WHERE src <> dst)"""


def distances(horizon: int) -> str:
    """Bounded distances of the graph tables, a step at a time."""
    steps = [", d0 AS (SELECT gid, vid AS src, vid AS dst, 0 AS d FROM live)"]
    for d in range(1, horizon + 1):
        known = " UNION ALL ".join(f"SELECT gid, src, dst FROM d{i}" for i in range(d))
        steps.append(f", d{d} AS (SELECT DISTINCT f.gid, f.src, st.dst, {d} AS d FROM d{d - 1} f JOIN st ON st.gid = f.gid AND st.src = f.dst ANTI JOIN ({known}) k ON k.gid = f.gid AND k.src = f.src AND k.dst = st.dst)")
    return "".join(steps) + ", dist AS (" + " UNION ALL ".join(f"SELECT * FROM d{i}" for i in range(horizon + 1)) + ")"


EMBEDDED = """
ev AS (SELECT vec_id AS gid, embedding::DOUBLE[] AS x, label FROM embeddings),
gram AS (SELECT a.gid AS gid_a, b.gid AS gid_b, list_dot_product(a.x, b.x) AS k FROM ev a, ev b)"""
NEIGHBOURS = EMBEDDED + """,
nb AS (SELECT gid_a AS gid, row_number() OVER (PARTITION BY gid_a ORDER BY round(k, 9) DESC, gid_b) AS rank, gid_b AS nid, round(k, 9) AS k FROM gram QUALIFY rank <= 10)"""
DENSITY = NEIGHBOURS + """,
sz AS (SELECT gid, count(*) AS n FROM nb GROUP BY gid),
de AS (SELECT gid, sum(k) / nullif(any_value(n) - 1, 0) AS density FROM nb JOIN sz USING (gid) WHERE gid <> nid GROUP BY gid),
ds AS (SELECT gid, any_value(density) AS density, sqrt(sum((k - density) * (k - density)) / nullif(any_value(n) - 1, 0)) AS sd FROM nb JOIN sz USING (gid) JOIN de USING (gid) WHERE gid <> nid GROUP BY gid)"""
SHIFT = DENSITY + """,
dr AS (SELECT gid, round(density, 9) AS density, sd FROM ds),
hi AS (SELECT nb.gid, nb.nid, nb.k, nb.rank, a.density, a.sd FROM nb JOIN dr a ON a.gid = nb.gid JOIN dr b ON b.gid = nb.nid WHERE b.density > a.density),
fi AS (SELECT gid, arg_min({'nid': nid, 'k': k, 'density': density, 'sd': sd}, rank) AS p FROM hi GROUP BY gid),
pa AS (SELECT ids.gid, coalesce(CASE WHEN abs(p.k - p.density) / nullif(p.sd, 0) > 1.0 THEN p.nid END, ids.gid) AS parent FROM (SELECT DISTINCT gid FROM nb) ids LEFT JOIN fi USING (gid))"""

CURRENT = """
cu AS (SELECT gid, fid, max(value) AS value FROM (SELECT gid, fid, value, rank() OVER (PARTITION BY gid, fid ORDER BY loaded_at DESC NULLS LAST) AS k FROM features WHERE gid IS NOT NULL AND fid IS NOT NULL) WHERE k = 1 GROUP BY gid, fid),
fv AS (SELECT gid, fid, value FROM cu WHERE value <> 0)"""
TARGETS = "tg AS (SELECT gid, max(y) AS y FROM targets WHERE gid IS NOT NULL AND y IS NOT NULL GROUP BY gid)"
