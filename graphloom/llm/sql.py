"""DuckDB statements of the queries that SQL can express, over the whole tables."""

_CURRENT = """
lv AS (SELECT gid, fid, max(value) AS v FROM (SELECT gid, fid, value, rank() OVER (PARTITION BY gid, fid ORDER BY loaded_at DESC NULLS LAST) AS k
        FROM features WHERE gid IS NOT NULL AND fid IS NOT NULL) WHERE k = 1 GROUP BY gid, fid),
iv AS (SELECT 'mp_instance' AS field_name, gid AS id, fid, v FROM lv WHERE v <> 0)"""
_NODES = """
ln AS (SELECT nid, m_discrete, m_svector FROM (SELECT *, row_number() OVER (PARTITION BY nid ORDER BY loaded_at DESC NULLS LAST, recorded_at DESC NULLS LAST) AS k FROM nodes WHERE nid IS NOT NULL) WHERE k = 1)"""
_PROFILE = """
pe AS (SELECT nid, e.fid AS fid, e."value" AS v, count(*) AS m FROM (SELECT nid, unnest(m_svector['profile']) AS e FROM ln) WHERE e."value" <> 0 AND e.fid IS NOT NULL GROUP BY ALL),
nv AS (SELECT 'm_svector' AS field_name, nid AS id, fid, sum(v) AS v, sum(m) AS m FROM pe GROUP BY nid, fid HAVING sum(v) <> 0)"""

P1 = f"""WITH {_CURRENT},
norm AS (SELECT id, sqrt(sum(v * v)) AS n FROM iv GROUP BY id),
u AS (SELECT iv.id, fid, v / n AS w FROM iv JOIN norm USING (id)),
near AS (SELECT a.id AS x, b.id AS y FROM u a JOIN u b ON a.fid = b.fid AND a.id <> b.id GROUP BY a.id, b.id HAVING round(sum(a.w * b.w), 6) >= 0.5),
around AS (SELECT x, list_sort(list(y)) AS l FROM (SELECT x, y FROM near UNION ALL SELECT DISTINCT x, x FROM near) GROUP BY x),
good AS (SELECT l FROM around GROUP BY l HAVING count(*) = len(l) AND len(l) >= 5),
member AS (SELECT x, l FROM around JOIN good USING (l))
SELECT a.x AS gid_a, b.x AS gid_b FROM member a JOIN member b ON a.l = b.l AND a.x < b.x"""

P3 = f"""WITH {_CURRENT}, {_NODES},
words AS (SELECT DISTINCT nid, attr, unnest(regexp_extract_all(lower(val), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')) AS word FROM (SELECT nid, unnest(map_keys(m_discrete)) AS attr, unnest(map_values(m_discrete)) AS val FROM ln)),
s AS (SELECT field_name, id, fid::VARCHAR AS tok, 0.8 AS t FROM iv UNION ALL SELECT 'm_discrete', nid, attr || ':' || word, 0.75 FROM words),
n AS (SELECT field_name, id, count(*) AS n FROM s GROUP BY ALL HAVING count(*) >= 8),
o AS (SELECT a.field_name, a.id AS id_a, b.id AS id_b, any_value(a.t) AS t, count(*) AS c FROM s a JOIN s b ON a.field_name = b.field_name AND a.tok = b.tok AND a.id < b.id GROUP BY ALL)
SELECT o.field_name, id_a, id_b FROM o JOIN n x ON x.field_name = o.field_name AND x.id = id_a JOIN n y ON y.field_name = o.field_name AND y.id = id_b
WHERE round(c / (x.n + y.n - c), 6) >= t"""

P4 = f"""WITH {_CURRENT}, {_NODES}, {_PROFILE},
e AS (SELECT field_name, id, fid, v FROM iv UNION ALL SELECT field_name, id, fid, v FROM nv),
df AS (SELECT field_name, fid, count(*) AS d FROM e GROUP BY ALL),
tot AS (SELECT field_name, id, sum(v) AS t FROM e GROUP BY ALL)
SELECT e.field_name, e.id AS record_id, e.fid FROM e JOIN df USING (field_name, fid) JOIN tot USING (field_name, id) WHERE d BETWEEN 2 AND 20 AND t <> 0 AND round(v / t, 6) >= 0.1"""

_SCORES = f"""WITH {_CURRENT}, {_NODES}, {_PROFILE},
e AS (SELECT field_name, id, fid, v FROM iv UNION ALL SELECT field_name, id, fid, v FROM nv),
rf AS (SELECT 'mp_instance' AS field_name, gid AS id, fid, row_number() OVER (PARTITION BY gid ORDER BY loaded_at NULLS FIRST, fid) AS p FROM (SELECT DISTINCT f.gid, f.fid, f.value, f.loaded_at FROM features f JOIN iv ON iv.id = f.gid AND iv.fid = f.fid WHERE f.value IS NOT NULL)),
en AS (SELECT nid, unnest(m_svector['profile']) AS e, unnest(range(0, len(m_svector['profile']))) AS i FROM ln),
rn AS (SELECT nv.field_name, en.nid AS id, en.e.fid AS fid, row_number() OVER (PARTITION BY en.nid ORDER BY i) AS p FROM en JOIN nv ON nv.id = en.nid AND nv.fid = en.e.fid WHERE en.e."value" <> 0),
rd AS (SELECT * FROM rf UNION ALL SELECT * FROM rn),
dg AS (SELECT a.field_name, a.id, a.fid, count(DISTINCT b.fid) AS degree FROM rd a JOIN rd b ON a.field_name = b.field_name AND a.id = b.id AND abs(a.p - b.p) < 4 AND a.fid <> b.fid GROUP BY ALL),
df AS (SELECT field_name, fid, count(*) AS d FROM e GROUP BY ALL), tot AS (SELECT field_name, id, sum(v) AS t FROM e GROUP BY ALL), nn AS (SELECT field_name, count(DISTINCT id)::DOUBLE AS n FROM e GROUP BY ALL)
SELECT e.field_name, e.id AS record_id, e.fid, round(v, 6) AS value, CASE WHEN t <> 0 THEN round(v / t, 6) END AS share, coalesce(degree, 0)::INT AS degree, d AS held_by, round(coalesce(degree, 0) * ln(n / d), 6) AS score
FROM e JOIN df USING (field_name, fid) JOIN tot USING (field_name, id) JOIN nn USING (field_name) LEFT JOIN dg ON dg.field_name = e.field_name AND dg.id = e.id AND dg.fid = e.fid"""

_P5 = f"""WITH {_NODES}, {_PROFILE},
d AS (SELECT 'm_discrete' AS field_name, attr, trim(regexp_replace(lower(val), '[\\s\\x{{00a0}}]+', ' ', 'g')) AS term, nid AS id, 1 AS m
      FROM (SELECT nid, unnest(map_keys(m_discrete)) AS attr, unnest(map_values(m_discrete)) AS val FROM ln) WHERE attr IN ('label', 'role', 'origin', 'tissue') AND val IS NOT NULL),
e AS (SELECT * FROM d WHERE term <> '' UNION ALL SELECT field_name, 'profile', fid::VARCHAR, id, m FROM nv),
h AS (SELECT count(m_discrete) AS d, count(m_svector['profile']) AS s FROM ln),
f AS (SELECT field_name, attr, term, count(DISTINCT id)::BIGINT AS records, sum(m)::BIGINT AS occurrences FROM e GROUP BY ALL),
r AS (SELECT field_name, attr, term, records, occurrences, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.4 * CASE WHEN field_name = 'm_discrete' THEN h.d ELSE h.s END THEN 'common' ELSE 'useful' END AS mark FROM f, h)"""
P5_ALL = _P5 + " SELECT * FROM r"
P5 = _P5 + " SELECT field_name, attr, term, mark FROM r WHERE mark <> 'useful'"

P6_CHECKS = """SELECT container_id, (SELECT count(DISTINCT doc_id) FROM documents WHERE text <> '')::BIGINT AS documents, 0::BIGINT AS overfull, 0::BIGINT AS wrong_pieces, 0::BIGINT AS needlessly_divided
FROM (SELECT DISTINCT container_id FROM containers WHERE capacity > 0)"""
P7_CHECKS = """SELECT DISTINCT regexp_replace(lower(trim(source)), '[\\s_\\-]+', '_', 'g') AS source, 0::BIGINT AS records_over_cap, 0::BIGINT AS copies_out_of_line, 0::BIGINT AS strangers FROM mix_targets"""

_LINKS = P3.rsplit("SELECT o.field_name, id_a, id_b", 1)
P3_LINKS = _LINKS[0].rstrip() + f""", pr AS (SELECT o.field_name, id_a, id_b{_LINKS[1]}),
st AS (SELECT s.field_name, id, list_sort(list(tok)) AS l FROM s JOIN n USING (field_name, id) GROUP BY ALL), cl AS (SELECT field_name, id, min(id) OVER (PARTITION BY field_name, l) AS rep, count(*) OVER (PARTITION BY field_name, l) AS k FROM st),
lk AS (SELECT DISTINCT p.field_name, a.rep AS x, b.rep AS y FROM pr p JOIN cl a ON a.field_name = p.field_name AND a.id = id_a JOIN cl b ON b.field_name = p.field_name AND b.id = id_b WHERE a.rep <> b.rep),
ct AS (SELECT field_name, rep, count(DISTINCT other) AS links FROM (SELECT field_name, x AS rep, y AS other FROM lk UNION ALL SELECT field_name, y, x FROM lk) GROUP BY ALL)
SELECT cl.field_name, cl.id, cl.rep AS class_id, k AS copies, coalesce(links, 0) AS links FROM cl LEFT JOIN ct ON ct.field_name = cl.field_name AND ct.rep = cl.rep WHERE k > 1 OR links > 0"""

ORACLES = {"p1_found": P1, "p3_found": P3, "p4_found": P4, "p5_found": P5, "p5_frequencies": P5_ALL, "p3_links": P3_LINKS, "p4_scores": _SCORES, "p6_checks": P6_CHECKS, "p7_checks": P7_CHECKS}
