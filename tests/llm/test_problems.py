"""Each operator against brute force or an exact property, with nulls, empty tables, repeats, ties and clashing names."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import vectors as vectors_module
from graphloom.llm import clusters, distinct, kernels, mixing, neardup, packing, similar, spam, termfreq, tokens
from graphloom.llm.vectors import TASK, classes_of_copies, route, shared_units
from graphloom.operators.nodes import current_nodes, profile_sequences
from graphloom.operators.records import _latest, current_sequences, current_vectors, mix64

VECTORS = "field_name string, id bigint, fids array<bigint>, vals array<double>"


def make_vectors(seed, groups, singles, first=0, size=12):
    """Groups of similar sparse vectors and unrelated ones, as {id: {fid: value}}."""
    rng, out, n = random.Random(seed), {}, first
    for members, drop in groups:
        base = {rng.randrange(10**6): rng.uniform(1, 3) for _ in range(size)}
        for _ in range(members):
            v = {f: x * rng.uniform(0.9, 1.1) for f, x in base.items()}
            for f in rng.sample(sorted(v), drop):
                del v[f]
            v[1] = 0.3
            out[n] = v
            n += 1
    for _ in range(singles):
        out[n] = {rng.randrange(10**6): rng.uniform(1, 3) for _ in range(size)} | {1: 0.3}
        n += 1
    return out


def frame(spark, vectors, field="f"):
    return spark.createDataFrame([(field, i, sorted(v), [v[f] for f in sorted(v)]) for i, v in vectors.items()], VECTORS)


def cosine(a, b):
    dot = sum(x * b[f] for f, x in a.items() if f in b)
    return round(dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())), 6)


@pytest.fixture(scope="module")
def vectors():
    v = make_vectors(1, [(7, 1), (9, 2), (30, 1), (5, 0), (3, 1)], 60)
    v |= {1000 + i: dict(v[0]) for i in range(8)} | {2000 + i: {5: 1.0, 6: 2.0} for i in range(9)}  # copies of a vector and a class of nothing but copies
    v[3000] = {f: float(f % 7 + 1) for f in range(10_000, 13_000)}  # a very long one
    v[3001] = dict(v[3000]) | {1: 5.0}
    return v


def test_exact_cosines(vectors):
    ids = sorted(vectors)
    fids = np.concatenate([np.array(sorted(vectors[i]), np.int64) for i in ids])
    vals = np.concatenate([np.array([vectors[i][f] for f in sorted(vectors[i])]) for i in ids])
    sv = kernels.ShardVectors(fids, vals, np.array([len(vectors[i]) for i in ids]))
    rng = np.random.default_rng(0)
    pick = np.r_[rng.integers(0, len(ids), 200), len(ids) - 1, len(ids) - 2]
    other = np.c_[rng.integers(-1, len(ids), (202, 5)), np.full(202, len(ids) - 1)]
    got = sv.cosines(pick, other)
    for a, line, values in zip(pick, other, got):
        for b, c in zip(line, values):
            if a == b:
                continue  # a row is not compared with itself
            assert c == -np.inf if b < 0 else math.isclose(c, cosine(vectors[ids[a]], vectors[ids[b]]), abs_tol=2e-6)


def test_small_world_ends_with_equal_points():
    x = np.repeat(np.eye(4, dtype=np.float32), 60, axis=0)
    world = kernels.SmallWorld(x, mix64(np.arange(240), 1).view(np.int64), ef=8)
    ids, sims = world.own()
    assert (sims[:, 0] > 0.99).all()
    hints = np.full((10, 1), 30)  # the groups are not tied to each other, so a search enters at a hint
    assert (world.search(x[:10], hints)[1][:, 0] > 0.99).all()


def brute_similar(vectors, k, least):
    out = set()
    for a in vectors:
        near = sorted(((-c, b) for b in vectors if b != a and (c := cosine(vectors[a], vectors[b])) >= least))
        out |= {(a, b) for _, b in near[:k]}
    return out


def test_p2_recall_and_copies(spark, vectors):
    got = similar.most_similar(frame(spark, vectors).withColumn("cosine", F.lit("clash")), 5, 0.8).collect()
    truth, mine = brute_similar(vectors, 5, 0.8), {(r.id_a, r.id_b) for r in got}
    assert len(truth & mine) >= 0.9 * len(truth)
    assert all(r.cosine == cosine(vectors[r.id_a], vectors[r.id_b]) and 1 <= r["rank"] <= 5 for r in got)
    for i in range(2000, 2009):  # ties among copies go to the smaller ids
        assert {b for a, b in mine if a == i} == set([j for j in range(2000, 2007) if j != i][:5])
    assert similar.most_similar(frame(spark, vectors).limit(0)).count() == 0


def test_p2_meets_by_a_third_feature(spark):
    rng, v = random.Random(7), {}
    for g in range(40):  # members share only features that tell less than two of their own
        for _ in range(10):
            v[len(v)] = {1000 * g + f: 0.7 for f in range(20)} | {10**6 + rng.randrange(200): 1.0 for _ in range(2)}
    got = similar.most_similar(frame(spark, v), 5, 0.8, shard_rows=50).collect()
    rank = {a: sorted((-cosine(v[a], v[b]), b) for b in range(a // 10 * 10, a // 10 * 10 + 10) if b != a) for a in v}
    truth = {(a, b) for a in v for c, b in rank[a][:5] if -c >= 0.8}
    assert len(truth & {(r.id_a, r.id_b) for r in got}) >= 0.97 * len(truth)


def test_p2_parts_are_searched_both_ways():
    v = make_vectors(11, [(150, 4), (150, 4)], 1)
    ids, first = sorted(v), {i: mix64(np.array([i]), 5)[0] % 2 == 0 for i in v}
    t = pa.table({
        "field_name": ["f"] * len(ids), "first": [0] * len(ids), "second": [1] * len(ids), "asks": [not first[i] for i in ids], "id": ids,
        "fids": pa.array([sorted(v[i]) for i in ids], pa.list_(pa.int64())), "vals": pa.array([[v[i][f] / math.hypot(*v[i].values()) for f in sorted(v[i])] for i in ids], pa.list_(pa.float64())),
    })
    got = similar._shard_links(5, 0.5)(t)
    mine = set(zip(got["id_a"].to_pylist(), got["id_b"].to_pylist()))
    across = {(a, b) for a, b in brute_similar(v, 5, 0.5) if first[a] != first[b]}
    for side in (True, False):
        of_side = {p for p in across if first[p[0]] == side}
        assert len(of_side & mine) >= 0.95 * len(of_side) > 50


def test_route_keeps_the_pairs_of_a_heavy_feature(spark):
    # all share their most telling feature and differ in every other one
    v = {i: {1: 100.0, 10 + i % 15: 1.0, 30 + i // 15 % 15: 0.9} for i in range(120)}
    units = shared_units(frame(spark, v), features=1).cache()
    rows = route(units, classes_of_copies(units, len(v)), len(v), 20).select(*TASK, "id").collect()
    tasks = {}
    for r in rows:
        tasks.setdefault(r[:4], set()).add(r.id)
    met = {p for m in tasks.values() for p in itertools.combinations(sorted(m), 2)}
    assert len(met) == 120 * 119 // 2 and max(map(len, tasks.values())) < 120


@pytest.mark.parametrize("hot_rows", [8, 10**9])
def test_shared_units_are_exact(spark, monkeypatch, hot_rows):
    """Only entries without a second holder go, and only vectors that can't reach the threshold; hot features travel as counts."""
    monkeypatch.setattr(vectors_module, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(vectors_module, "HOT", 2)
    v = make_vectors(21, [(4, 1), (6, 2)], 30, size=8) | {900: {5: 2.0}, 901: {5: 2.0}, 902: {5: 4.0}, 903: {6: 1.0}}
    holders = {}
    for x in v.values():
        for f in x:
            holders[f] = holders.get(f, 0) + 1
    got = {r.id: r for r in shared_units(frame(spark, v), 0.5).collect()}
    for i, x in v.items():
        norm = math.sqrt(sum(c * c for c in x.values()))
        kept = {f: c / norm for f, c in x.items() if holders[f] > 1}
        if sum(c * c for c in kept.values()) >= 0.25:
            assert dict(zip(got[i].fids, got[i].vals)) == pytest.approx(kept)
        else:
            assert i not in got
    assert got[900].h1 == got[901].h1 == got[902].h1 and 903 not in got
    assert shared_units(frame(spark, {})).count() == 0


def test_route_moves_vectors_in_few_shuffles(spark):
    """Names are found before; sizes of shards, ids, vectors and tasks are what is shuffled then."""
    v = make_vectors(33, [(6, 1), (9, 2)], 20)
    units = shared_units(frame(spark, v)).cache()
    rows = route(units, classes_of_copies(units, len(v)), len(v), 20)
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 4
    tops = {r.id: set(r.light) for r in units.collect()}
    at = {}
    for r in rows.collect():
        at.setdefault(r.id, set()).add((r.shard, r.first, r.second))
    assert at.keys() == tops.keys()
    for a, b in itertools.combinations(tops, 2):
        assert not tops[a] & tops[b] or at[a] & at[b]  # who shares a light feature meets


def test_blocks_in_pieces_hold_every_entry(monkeypatch):
    monkeypatch.setattr(vectors_module, "PIECE", 7)
    n = 50
    ids, vals, bucket = np.arange(n), np.linspace(-1, 1, n), np.arange(n) % 4
    blocks = list(vectors_module._blocks("f", bucket, {"ids": ids, "vals": vals, "counts": ids % 3}))
    assert len(blocks) == 8 and all(b.schema.field("ids").type == pa.binary() for b in blocks)
    for k in range(4):
        mine = [b.filter(pa.compute.equal(b["bucket"], k)) for b in blocks]
        ((field, (i, x, c)),) = vectors_module._by_field(iter([b for b in mine if b.num_rows]), ["ids", "vals", "counts"])
        assert field == "f" and i.tolist() == ids[bucket == k].tolist() and x.tolist() == vals[bucket == k].tolist() and c.tolist() == (i % 3).tolist()


@pytest.mark.parametrize("span", [1, 2**40])  # ids and fids that fit one sort key, and ids and fids that don't
def test_latest_of_narrow_and_wide_keys(span):
    rng = np.random.default_rng(span)
    ids, fids = rng.integers(-5, 5, 400) * span, rng.integers(-4, 4, 400) * span
    vals, times = rng.choice([-np.inf, 0.0, 1.0, 2.0], 400), rng.integers(0, 4, 400)
    last = {}
    for i, f, v, t in zip(ids, fids, vals, times):
        last[i, f] = max(last.get((i, f), (t, v)), (t, v))
    got = _latest(ids, fids, vals, times)
    assert list(zip(*(x.tolist() for x in got))) == [(i, f, v, t) for (i, f), (t, v) in sorted(last.items())]
    assert all(len(x) == 0 for x in _latest(*(x[:0] for x in (ids, fids, vals, times))))


def test_p2_fields_never_meet(spark, vectors):
    both = frame(spark, vectors, "x").unionByName(frame(spark, vectors, "y"))
    got = similar.most_similar(both, 3, 0.9).groupBy("field_name").count().collect()
    assert len({r["count"] for r in got}) == 1 and len(got) == 2


def test_p1_equals_brute_force(spark, vectors):
    near = {a: {b for b in vectors if b == a or cosine(vectors[a], vectors[b]) >= 0.5} for a in vectors}
    truth = {(a, b) for a in vectors for b in near[a] if a < b and len(near[a]) >= 5 and all(near[c] == near[a] for c in near[a])}
    got = [(r.gid_a, r.gid_b) for r in clusters.tight_pairs(frame(spark, vectors)).collect()]
    assert len(got) == len(set(got)) and set(got) == truth and truth


def test_p1_equals_brute_force_above_the_group_bound(spark, vectors):
    near = {a: {b for b in vectors if b == a or cosine(vectors[a], vectors[b]) >= 0.5} for a in vectors}
    truth = {(a, b) for a in vectors for b in near[a] if a < b and len(near[a]) >= 5 and all(near[c] == near[a] for c in near[a])}
    assert {(r.gid_a, r.gid_b) for r in clusters.tight_pairs(frame(spark, vectors), group=6).collect()} == truth


def test_p1_rows_come_through_the_communities(spark, vectors, monkeypatch):
    monkeypatch.setattr(clusters, "divide_by_modularity", lambda n, *_: np.arange(n))
    got = {(r.gid_a, r.gid_b) for r in clusters.tight_pairs(frame(spark, vectors)).collect()}
    assert got == set(itertools.combinations(range(2000, 2009), 2))  # only the class of nothing but copies needs no community


def test_p1_finds_planted_clusters(spark):
    v = make_vectors(31, [(m, 1) for m in (5, 8, 12, 20, 40, 6, 9)], 50)
    planted, n = {}, 0
    for c, m in enumerate((5, 8, 12, 20, 40, 6, 9)):
        planted |= {i: c for i in range(n, n + m)}
        n += m
    rows = clusters.similarity_clusters(frame(spark, v)).collect()
    assert sum(r.size for r in rows) == n
    assert all(len({planted[i] for i in r.typical}) == 1 for r in rows)
    whole = [r for r in rows if r.size == sum(c == planted[r.cluster] for c in planted.values())]
    assert len(whole) >= 6


def test_p1_array_and_join_moves_agree():
    edges = [(a, b) for s in (0, 10) for a, b in itertools.combinations(range(s, s + 6), 2)] + [(5, 10)]
    a, b = np.array(edges).T
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    w = np.array([1.0] * (len(edges) - 1) + [0.2])
    label = clusters.divide_by_modularity(len(nodes), at[: len(a)], at[len(a) :], w, 2 * w.sum())
    assert len(set(label[nodes < 6])) == 1 and len(set(label)) == 2
    path = np.arange(63)
    label = clusters.divide_by_modularity(64, path, path + 1, np.ones(63), 126.0)
    volume = np.bincount(label, np.r_[1, np.full(62, 2), 1])
    assert (label[:-1] == label[1:]).sum() * 2 / 126 - (volume**2).sum() / 126**2 > 0.7


def test_p1_clusters_are_described(spark, vectors):
    rows = clusters.similarity_clusters(frame(spark, vectors)).collect()
    copies = next(r for r in rows if r.cluster == 2000)
    assert copies.size == 9 and copies.typical == [2000] and copies.degree == [8.0]
    assert all(len(r.typical) <= 5 and r.degree == sorted(r.degree, reverse=True) for r in rows)
    assert clusters.similarity_clusters(frame(spark, {})).count() == 0


def test_p1_modularity_divides_two_cliques(spark):
    edges = [(a, b, 1.0) for s in (0, 10) for a, b in itertools.combinations(range(s, s + 6), 2)] + [(5, 10, 0.2)]
    got = {r.id: r.community for r in clusters.modularity_communities(spark.createDataFrame(edges, clusters.EDGES)).collect()}
    assert len({got[i] for i in range(6)}) == 1 and got[0] != got[10] and len(set(got.values())) == 2


def test_p1_modularity_converges_on_a_long_chain(spark):
    n = 64  # a path: the best divisions have runs of several nodes, which few rounds do not reach from single nodes
    edges = [(a, a + 1, 1.0) for a in range(n - 1)]
    label = {r.id: r.community for r in clusters.modularity_communities(spark.createDataFrame(edges, clusters.EDGES)).collect()}
    volume = {}
    for a in range(n):
        volume[label[a]] = volume.get(label[a], 0) + (1 if a in (0, n - 1) else 2)
    total = 2.0 * (n - 1)
    inside = sum(label[a] == label[b] for a, b, _ in edges)
    assert inside * 2 / total - sum(v * v for v in volume.values()) / total**2 > 0.7


def brute_sets(sets, t):
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a]) >= 8 and len(sets[b]) >= 8 and round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) >= t}


@pytest.mark.parametrize("rows,growth,t", [(64, 4, 0.8), (2, 2, 0.8), (2, 2, 0.3)])
def test_p3_equals_brute_force(spark, monkeypatch, rows, growth, t):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", rows)
    monkeypatch.setattr(neardup, "PART_ROWS", 8)
    monkeypatch.setattr(neardup, "GROWTH", growth)
    rng, sets = random.Random(4), {}
    for g in range(25):
        base = set(rng.sample(range(60 if g % 2 else 4000), rng.choice([6, 9, 14, 25])))
        for _ in range(rng.choice([1, 2, 9])):
            s = set(base)
            for _ in range(rng.choice([0, 1, 2])):
                s.discard(rng.choice(sorted(s)))
                s.add(rng.randrange(4000))
            sets[len(sets)] = s
    sets |= {500 + i: set(range(100, 110)) for i in range(6)}
    df = spark.createDataFrame([("f", i, sorted(s), t) for i, s in sets.items()], "field_name string, id bigint, toks array<bigint>, t double")
    found, members = neardup.near_duplicates(df.withColumn("n", F.lit(0)))
    got = [(r.id_a, r.id_b) for r in neardup.all_pairs(found, members).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_sets(sets, t)
    assert neardup.all_pairs(*neardup.near_duplicates(df.limit(0))).count() == 0


NODES = "nid bigint, gid bigint, vid int, recorded_at timestamp, loaded_at timestamp, m_number map<string,double>, m_discrete map<string,string>, m_bool map<string,boolean>, m_svector map<string,array<struct<fid:bigint,value:double>>>"


def nodes(spark):
    from datetime import datetime

    t = lambda d: datetime(2024, 1, d)
    rows = [
        (1, 1, 1, t(1), t(1), None, {"label": "old"}, None, None),
        (1, 1, 1, t(1), t(2), None, {"label": "  Ring   Atom ", "role": None, "remark": "x"}, None, {"profile": [(5, 1.0), (5, 1.0), (6, None), (7, 0.0), (8, 2.0)]}),
        (2, 1, 1, None, t(1), None, {"label": "ring atom"}, None, {"profile": []}),
        (3, 1, 1, None, None, None, None, None, None),
        (4, 1, 1, None, t(1), None, {}, None, {"context": [(9, 1.0)]}),
        (None, 1, 1, None, t(1), None, {"label": "nobody"}, None, None),
    ]
    return spark.createDataFrame(rows * 2, NODES)


def test_p5_counts_and_containers(spark):
    current = current_nodes(nodes(spark))
    assert {r.nid for r in current.collect()} == {1, 2, 3, 4}
    entries, holders = termfreq.node_entries(current)
    got = {(r.attr, r.term): (r.records, r.occurrences, r.mark) for r in termfreq.term_frequencies(termfreq.postings(entries), holders).collect()}
    assert got == {("label", "ring atom"): (2, 2, "rare"), ("profile", "5"): (1, 2, "rare"), ("profile", "8"): (1, 1, "rare")}
    assert {r.field_name: r.holders for r in holders.collect()} == {"m_discrete": 3, "m_svector": 2}
    empty, none = termfreq.node_entries(current_nodes(nodes(spark).limit(0)))
    assert termfreq.term_frequencies(termfreq.postings(empty), none).count() == 0


def test_p5_dense_bitmaps_and_unions(spark):
    rows = spark.range(-5000, 40_000).select(F.lit("f").alias("field_name"), F.lit("a").alias("attr"), F.lit("t").alias("term"), F.col("id").alias("record_id"), F.lit(1).cast("bigint").alias("occurrences"))
    one, two = termfreq.postings(rows.where("record_id < 20000")), termfreq.postings(rows.where("record_id >= 10000"))
    both = termfreq.union_postings(one, two)
    assert both.agg(F.sum(termfreq.cardinality())).first()[0] == 45_000
    assert both.agg(F.max(F.length("container"))).first()[0] == 4097
    ids = both.select(F.explode(termfreq.ids_of("container")).alias("low"), "bucket").select((F.shiftleft("bucket", 15) + F.col("low")).alias("id"))
    assert ids.agg(F.min("id"), F.max("id"), F.countDistinct("id")).first()[:] == (-5000, 39_999, 45_000)


def brute_degrees(record, term, window):
    near = {}
    for i, j in itertools.combinations(range(len(term)), 2):
        if record[i] == record[j] and j - i < window and term[i] != term[j]:
            near.setdefault((record[i], term[i]), set()).add(term[j])
            near.setdefault((record[j], term[j]), set()).add(term[i])
    return [len(near.get((r, t), ())) for r, t in zip(record, term)]


@pytest.mark.parametrize("vocabulary", [4, 10**6])
def test_p4_degrees(vocabulary):
    rng = np.random.default_rng(2)
    record = np.sort(rng.integers(0, 12, 90))
    term = rng.integers(0, vocabulary, 90)
    assert distinct.window_degrees(record, term, 4).tolist() == brute_degrees(record.tolist(), term.tolist(), 4)
    assert len(distinct.window_degrees(record[:0], term[:0], 4)) == 0


def test_p4_scores(spark):
    v = {1: {5: 3.0, 6: 1.0}, 2: {5: 2.0, 7: -2.0}, 3: {5: 1.0}}
    got = {(r.record_id, r.fid): r for r in distinct.distinctive_terms(frame(spark, v)).collect()}
    assert got[1, 6].share == 0.25 and got[1, 6].held_by == 1 and got[1, 6].score == round(math.log(3), 6)
    assert got[2, 7].share is None and got[3, 5].score == 0
    assert distinct.distinctive_terms(frame(spark, {})).count() == 0


def test_p4_graph_of_words_reads_in_recorded_order(spark):
    from datetime import datetime

    rows = [(1, 1, 0.5, 1), (1, 2, 1.0, 1), (1, 1, 0.7, 2), (1, 3, 1.0, 2), (1, 1, 0.7, 2), (1, 1, 0.9, 3), (1, 4, 1.0, 3), (1, 5, 1.0, 3), (1, 6, 2.0, 1), (1, 6, None, 4), (None, 9, 1.0, 1), (2, 7, 1.0, 1)]
    features = spark.createDataFrame([(g, f, v, datetime(2024, 1, d)) for g, f, v, d in rows], "gid bigint, fid bigint, value double, loaded_at timestamp")
    seq = current_sequences(features)
    got = {r.id: r for r in seq.collect()}
    assert got[1].reads == [1, 2, 1, 3, 1, 4, 5] and got[1].fids == [1, 2, 3, 4, 5] and got[1].vals == [0.9, 1, 1, 1, 1] and got[2].reads == [7]
    plain = {r.id: (r.fids, r.vals) for r in current_vectors(features).collect()}
    assert plain == {i: (r.fids, r.vals) for i, r in got.items()}
    scored = {(r.record_id, r.fid): r for r in distinct.distinctive_terms(seq.withColumn("field_name", F.lit("f")), 2).collect()}
    assert [scored[1, f].degree for f in (1, 2, 3, 4, 5)] == [3, 1, 1, 2, 1]  # fid 1 came again and again, beside 2, 3 and 4
    assert scored[1, 1].score == round(3 * math.log(2), 6) > scored[1, 2].score
    assert current_sequences(features.limit(0)).count() == 0
    stored = profile_sequences(current_nodes(nodes(spark)))
    assert {r.id: (r.fids, r.vals, r.reads) for r in stored.collect()} == {1: ([5, 8], [1.0, 2.0], [5, 5, 8])}


def test_p6_pieces_are_whole_and_fit(spark):
    rng = random.Random(5)
    sizes = {i: rng.choice([0, 1, 3, rng.randrange(1, 60), rng.randrange(40, 130), 977]) for i in range(3000)}
    docs = spark.createDataFrame(list(sizes.items()), "doc_id bigint, n_tokens bigint")
    boxes = spark.createDataFrame([(1, 100), (2, 64), (3, None)], "container_id int, capacity bigint")
    packed = packing.pack(docs.withColumn("capacity", F.lit("clash")), boxes)
    rows = packed.collect()
    for box, capacity in ((1, 100), (2, 64)):
        fill, parts = {}, {}
        for r in rows:
            if r.container_id == box:
                fill[r.container_no] = fill.get(r.container_no, 0) + r.tokens
                parts.setdefault(r.doc_id, []).append((r.first_token, r.tokens))
        assert max(fill.values()) <= capacity and set(fill) == set(range(len(fill)))
        for doc, n in sizes.items():
            at = 0
            for first, n_part in sorted(parts.get(doc, [])):
                assert first == at and (n_part == capacity or first + n_part == n)
                at += n_part
            assert at == n and (n > capacity or len(parts.get(doc, [])) == (n > 0))
        assert len(fill) <= 1.03 * sum(sizes.values()) / capacity + 1
    assert packing.pack(docs.limit(0), boxes).count() == 0
    assert {r[0]: r[1:] for r in packing.packing_checks(packed, docs, boxes).collect()} == {i: (sum(n > 0 for n in sizes.values()), 0, 0, 0) for i in (1, 2)}
    broken = packing.packing_checks(packed.where("container_id = 1").withColumn("tokens", F.col("tokens") + 1), docs, boxes).where("container_id = 1").first()
    assert broken.overfull > 0 and broken.wrong_pieces > 0
    report = {r.container_id: r for r in packing.fill_report(packed, boxes).collect()}
    assert 0 <= report[1].unused < 0.05


def test_p6_repeats_approach_the_histogram():
    combos = packing.combinations(np.array([2, 3, 5, 7, 10]), 10)
    assert (combos.sum(1) == 10).all() and len(combos) == len({tuple(c) for c in combos})
    histogram = np.array([0, 0, 0, 40, 0, 10, 0, 40, 0, 0, 5, 0])
    x = packing.solve_repeats(combos, histogram, 2000)
    made = np.bincount(combos[combos > 0], np.broadcast_to(x[:, None], combos.shape)[combos > 0], 12)
    assert np.allclose(made, histogram, atol=0.5)


def test_p7_shares_caps_and_repeats(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["Big", " big ", "big"]) if i < 6000 else "mid-size" if i < 8000 else None if i < 8100 else "small", rng.randrange(1, 200), f"t{i}") for i in range(8400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint, text string").withColumn("copies", F.lit(0))
    tokens = {"big": 0, "mid_size": 0, "small": 0}
    for _, source, n, _ in rows:
        if source:
            tokens[{"big": "big", "mid-size": "mid_size", "small": "small"}[source.strip().lower()]] += n
    goals = spark.createDataFrame([("big", 0.5, 1), ("mid_size", 0.3, 2), ("small", 0.1, 4), ("absent", 0.1, 3)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(docs, goals)
    report = {r.source: r for r in mixing.share_report(mixed, goals).collect()}
    for source, share, cap in (("big", 0.5, 1), ("mid_size", 0.3, 2), ("small", 0.1, 4)):
        reached = min(share / 0.9 * sum(tokens.values()), cap * tokens[source])  # a source at its cap gives what it has
        assert abs(report[source].tokens - reached) < 0.01 * reached and report[source].most <= cap
    assert sum(r.reached_share for r in report.values()) == pytest.approx(1, abs=1e-5)
    assert all(r[1:] == (0, 0, 0) for r in mixing.mixture_checks(mixed, goals).collect())
    assert report["absent"].reached_share == 0 and report["absent"].copies == 0
    order = [r.shuffle_key for r in mixed.select("shuffle_key").collect()]
    assert order == sorted(order) and mixed.collect() == mixing.mix(docs, goals).collect()
    assert mixing.mix(docs.limit(0), goals).count() == 0 and mixing.mix(docs, goals.limit(0)).count() == 0
    most = mixing.share_report(mixing.mix(docs, goals, total_tokens=10**9), goals).where("source = 'small'").first()
    assert most.copies == 4 * most.documents == 1200


def test_p7_poisson_steps():
    steps = mixing.poisson_steps(1.3, 3)
    assert np.allclose(steps, np.cumsum([math.exp(-1.3) * 1.3**j / math.factorial(j) for j in range(3)]))


SPAM = [
    "cheap shoes, buy shoes online, shoes sale, best shoes price, shoes discount, order shoes, shoes shop deal, free shoes delivery",
    "\n".join(f"Offer: https://a{i}.example/x{i}" for i in range(12)),
    "#cheap #shoes #buyshoes #sale #best #online #deal #shop #offer #price #coupon",
    "AB-12 shoes M 12,50; AB-13 lamps S 13,20; AB-14 rings XL 9,99; AB-15 sofas pack 44,10; AB-16 tyres 2x 80,00; AB-17 toys S 5,00",
    "Free lamps in place. Cheap lamps in town. Best lamps in shop. Top lamps in store. New lamps in stock. Order lamps in bulk. Buy lamps in line.",
]
HAM = [
    "I have already tried to patch the cursor by hand and to restart the server, with no luck. Is there any way to do this?",
    "Sieh dir die Liste an, die noch niemand geordnet hat. Das hängt davon ab, wie oft du die Zeile lesen willst.",
    "Here is what I ran:\n```\nfor x in rows: print(x)\nfoo = bar(1)\nbaz = qux[2]\nif foo != baz: stop()\n```\nIt fails with an error that I do not understand.",
    "See https://a.example/x",
    "The list of the options is in the manual, see https://a.example/x and https://b.example/y for more on how they work.\n\nTags: a, b, c",
    "+1, same here.",
    "",
    None,
]


def test_p8_tells_lists_from_sentences(spark):
    docs = spark.createDataFrame(list(enumerate(SPAM + HAM)), "doc_id bigint, text string").withColumn("words", F.lit(1))
    got = {r.doc_id: r for r in spam.stuffed_pages(docs).collect()}
    assert set(got) == set(range(len(SPAM)))
    assert got[1].link_list and not got[0].link_list
    assert spam.stuffed_pages(docs.limit(0)).count() == 0


def test_p8_goes_by_the_shapes_of_lines(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(SPAM)], "doc_id bigint, text string")
    assert {r.pages_alike for r in spam.stuffed_pages(docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 100))).collect()} >= {2}
    short = spark.createDataFrame([(1, "cheap shoes buy shoes online"), (2, "Danke!"), (3, "Use `x` instead."), (4, "a.example/b c.example/d e.example/f")], "doc_id bigint, text string")
    assert {r.doc_id for r in spam.stuffed_pages(short).collect()} == {1, 4}
    assert spam.text_shapes("\n".join(["Buy now."] * 3)) and all(k != "remark" for k in spam.text_shapes("Buy now.\nBuy now."))


def test_p8_reads_to_the_end():
    text = HAM[0] * 200 + "\n" + SPAM[0] * 600
    shapes = spam.text_shapes(text)
    assert sum(v[1] for v in shapes.values()) > 10_000 and sum(v[2] for v in shapes.values()) > sum(v[1] for v in shapes.values()) / 2


def test_tokens_count_whole_texts(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (4, "word " * 5000), (5, "a" * 50_000)], "doc_id bigint, text string")
    got = {r.doc_id: r.n for r in docs.select("doc_id", tokens.token_count("text").alias("n")).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] >= 5000 and got[5] > 1000
