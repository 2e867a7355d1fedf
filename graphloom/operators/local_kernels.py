"""Kernels that need whole small graphs: canonical forms, shells, path unions, soft contexts, trees.

Graphs are brought together in batches by a hash of their ids; balls are bounded by radius and by the hub guard.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.hashing import py_hash

HUB = 10
#: Batches in which graphs reach the kernels.
BATCHES = 4096
#: Codes of small subgraphs by their labels, edges and roots, and how many are kept at most.
SHAPES: dict[tuple, int] = {}
MOST_SHAPES = 200_000


@lru_cache(1 << 17)
def _known_hash(values, bits: int) -> int:
    return py_hash(values, bits)


@dataclass
class Config:
    """Parameters of the kernels, by their usual names."""

    radius: int = 2
    distance: int = 5
    bits: int = 15
    degree_threshold: int = 7
    lower_degree: int = 1
    tree_lambda: float = 1.2
    radius_two: int = 2
    normalise: bool = True


@dataclass
class Graph:
    labels: dict[int, str]
    steps: dict[int, list[tuple[int, str]]]
    sources: list[int]
    targets: set[int]
    abstract: dict[int, tuple[list[int], list[int]]]
    config: Config
    codes: dict = field(default_factory=dict)

    def h(self, values) -> int:
        return _known_hash(values if isinstance(values, str) else tuple(values), self.config.bits)

    def search(self, root: int, horizon: int, inside: set[int] | None = None) -> dict[int, int]:
        """Distances from root within ``horizon``, in the whole graph or inside a vertex set."""
        seen, queue = {root: 0}, deque([root])
        while queue:
            v = queue.popleft()
            if seen[v] == horizon:
                continue
            for u, _ in self.steps.get(v, ()):
                if u not in seen and u not in self.abstract and (inside is None or u in inside):
                    seen[u] = seen[v] + 1
                    queue.append(u)
        return seen

    @cached_property
    def reach(self) -> dict[int, dict[int, int]]:
        horizon = max(self.config.radius, self.config.distance, self.config.radius_two)
        return {v: self.search(v, horizon) for v in self.labels if v not in self.abstract}

    def canonical(self, chosen: set[int], *roots: int) -> int:
        """Hash of the subgraph on ``chosen``, independent of numbering; with roots, of how it is seen from those.

        Subgraphs of equal labels, edges and roots in order of their labels have one hash, which is computed once.
        """
        labels, steps = self.labels, self.steps
        place = {v: i for i, v in enumerate(sorted(chosen, key=lambda v: (labels[v], v)) if len(chosen) > 1 else chosen)}
        inner = tuple(sorted([(i, place[u], e) for v, i in place.items() for u, e in steps.get(v, ()) if u in place]))
        shape = (self.config.bits, tuple([labels[v] for v in place]), inner, tuple([place[v] for v in roots]))
        if shape not in SHAPES:
            if len(SHAPES) >= MOST_SHAPES:
                SHAPES.clear()
            SHAPES[shape] = self._canonical(chosen, *roots)
        return SHAPES[shape]

    def _canonical(self, chosen: set[int], *roots: int) -> int:
        far = {v: self.search(v, len(chosen), chosen) for v in chosen}
        own = {}
        for v in chosen:
            seen = sorted(self.h(f"{far[v].get(u, -1)}{self.labels[u]}") for u in chosen)
            first = sorted(self.h(f"{far[root].get(v, -1)}{self.labels[root]}") for root in roots)
            own[v] = self.h(first + seen)
        pairs, lonely = [], []
        for v in chosen:
            inner = [(u, e) for u, e in self.steps.get(v, ()) if u in chosen]
            pairs += [self.h([min(own[v], own[u]), max(own[v], own[u]), self.h(e)]) for u, e in inner]
            if not inner:
                lonely.append(own[v])
        return self.h(sorted(pairs + lonely))

    def code(self, radius: int, v: int) -> int:
        """Code of the neighbourhood of ``v``; hubs have code 1."""
        key = (radius, v)
        if key not in self.codes:
            around = self.steps.get(v, [])
            if len(around) > HUB:
                value = 1
            elif radius == 0:
                value = self.h(self.labels[v])
            elif radius == 1:
                value = self.h(self.labels[v] + ":" + ".".join(sorted(f"{self.labels[u]}-{e}" for u, e in around)))
            else:
                value = self.canonical({u for u, d in self.reach[v].items() if d <= radius}, v)
            self.codes[key] = value
        return self.codes[key]

    def shell(self, inner: int, outer: int, v: int) -> int:
        key = (inner, outer, v, "shell")
        if key not in self.codes:
            self.codes[key] = 1 if len(self.steps.get(v, [])) > HUB else self.canonical({u for u, d in self.reach[v].items() if inner <= d <= outer})
        return self.codes[key]

    def pairs(self):
        """(source, target, distance) of all pairs the kernels look at."""
        for v in self.sources:
            for u, d in self.reach[v].items():
                if u in self.targets and d <= self.config.distance:
                    yield v, u, d

    def path_union(self, v: int, u: int, d: int, reach: int) -> set[int]:
        return {m for m, t in self.reach[v].items() if t <= min(reach, d) and self.reach[m].get(u) == d - t}

    def sides(self, top: int, d: int) -> tuple[list[int], list[int]]:
        """Vertices at distance d from the part side and from the abstract side of an abstract vertex."""
        part, whole = self.abstract[top]
        if not part or not whole:
            raise ValueError("abstract vertex without a part or an abstract side")
        at = lambda roots: sorted({u for r in roots if r in self.reach for u, t in self.reach[r].items() if t == d})
        return at(part), at(whole)


Cells = dict[tuple[int, int], Counter]


def pair_cells(g: Graph) -> Cells:
    cells: Cells = defaultdict(Counter)
    for r in range(g.config.radius + 1):
        for v, u, d in g.pairs():
            a, b = g.code(r, v), g.code(r, u)
            cells[r, d][g.h([r, d, min(a, b), max(a, b)])] += 1.0
            cells[r, d][g.h([r, d, 0, b])] += 1.0
        for top in g.abstract:
            for d in range(g.config.distance + 1):
                low, high = g.sides(top, d)
                for a in low:
                    for b in high:
                        cells[r, d][g.h([r, d, g.code(r, a), g.code(r, b)])] += 1.0
    return cells


def shell_cells(g: Graph) -> Cells:
    cells: Cells = defaultdict(Counter)
    for r in range(g.config.radius + 1):
        for m in range(r + 1):
            for v, u, d in g.pairs():
                a, b = g.shell(m, r, v), g.shell(m, r, u)
                cells[r, d][g.h([r, d, min(a, b), max(a, b), m])] += 1.0
    return cells


def path_cells(g: Graph) -> Cells:
    cells: Cells = defaultdict(Counter)
    for v, u, d in g.pairs():
        chosen = g.path_union(v, u, d, g.config.radius)
        cells[0, d][g.canonical(chosen | {v}, v)] += 1.0
        cells[0, d][g.canonical(chosen | {u}, u)] += 1.0
    return cells


def soft_context(g: Graph, v: int, radius: int) -> Counter:
    """Histogram of the edges of a ball, labelled by the ends' labels and distances."""
    if len(g.steps.get(v, [])) <= g.config.lower_degree:
        return Counter({1: 1.0})
    near = {u: d for u, d in g.reach[v].items() if d <= radius}
    root = g.h(g.labels[v] + ".0")
    out: Counter = Counter()
    for a, d in near.items():
        for b, e in g.steps.get(a, ()):
            if b in near and a < b:
                x, y = g.h(f"{g.labels[a]}.{d}"), g.h(f"{g.labels[b]}.{near[b]}")
                out[g.h([root, min(x, y), max(x, y), g.h(e)])] += 1.0
    return out


def context_cells(g: Graph) -> Cells:
    cells: Cells = defaultdict(Counter)
    for r in range(g.config.radius + 1):
        contexts = {v: soft_context(g, v, r) for v in g.reach}
        for v, u, d in g.pairs():
            a, b = g.h(g.labels[v]), g.h(g.labels[u])
            code = g.h([r, d, min(a, b), max(a, b)])
            for end in (v, u):
                for f, c in contexts[end].items():
                    cells[r, d][g.h([f, code])] += c
    return cells


def biased_cells(g: Graph) -> Cells:
    """Pair features of vertices up to the degree threshold, soft contexts of those above."""
    few = [v for v in g.sources if len(g.steps.get(v, [])) <= g.config.degree_threshold]
    low = Graph(g.labels, g.steps, few, g.targets, g.abstract, g.config, g.codes)
    high = Graph(g.labels, g.steps, [v for v in g.sources if v not in set(few)], g.targets, {}, g.config, g.codes)
    cells = pair_cells(low)
    for key, values in context_cells(high).items():
        cells[key].update(values)
    return cells


def tree_productions(g: Graph, root: int) -> dict[int, dict[int, list[tuple[int, float]]]]:
    """``{depth: {vertex: [(code, weight)]}}`` of the breadth-first DAG below ``root``."""
    level = g.search(root, g.config.radius)
    children = {v: sorted({u for u, _ in g.steps.get(v, ()) if level.get(u) == level[v] + 1}) for v in level}
    top = max(level.values())
    codes: dict[int, list[int]] = {}
    size: dict[int, list[int]] = {}
    freq: dict[int, int] = {}
    for v in sorted(level, key=lambda x: -level[x]):
        below = children[v]
        codes[v], size[v] = [g.h(g.labels[v])], [1]
        freq[v] = min((freq[c] for c in below), default=top - level[v])
        depth = 1 + max((len(codes[c]) - 1 for c in below), default=-1)
        for d in range(1, depth + 1):
            used = [(codes[c][min(d, len(codes[c])) - 1], size[c][min(d, len(codes[c])) - 1]) for c in below]
            codes[v].append(g.h(g.labels[v] + ":" + ".".join(sorted(str(c) for c, _ in used))))
            size[v].append(1 + sum(s for _, s in used))
    out: dict[int, dict[int, list[tuple[int, float]]]] = defaultdict(lambda: defaultdict(list))
    for v in level:
        for d, (c, s) in enumerate(zip(codes[v], size[v])):
            out[d][v].append((c, (freq[v] + 1) * math.sqrt(g.config.tree_lambda**s)))
    return out


def tree_cells(g: Graph) -> Cells:
    cells: Cells = defaultdict(Counter)
    for root in g.sources:
        for per in tree_productions(g, root).values():
            for found in per.values():
                for code, weight in found:
                    cells[0, 0][code] += weight
    return cells


def _tree_by_root(g: Graph, split: bool) -> dict[int, dict[int, Counter]]:
    out = {}
    for root in g.reach:
        depths: dict[int, Counter] = defaultdict(Counter)
        for d, per in tree_productions(g, root).items():
            for v, found in per.items():
                for code, weight in found:
                    depths[d][g.h([code, g.reach[root].get(v, 0)]) if split else code] += weight
        out[root] = depths
    return out


def tree_pair_cells(g: Graph, with_distance: bool = False) -> Cells:
    """Tree productions of a vertex crossed with the neighbourhood codes of the vertices at a distance from it."""
    trees = _tree_by_root(g, with_distance)
    cells: Cells = defaultdict(Counter)
    for v, u, d in g.pairs():
        for r2 in range(g.config.radius_two + 1):
            code = g.code(r2, u)
            for depth in trees[v].values():
                for f, w in depth.items():
                    cells[r2, d][g.h([r2, d, f, code])] += w
    return cells


def abstract_tree_cells(g: Graph) -> Cells:
    """``tree_pair_cells`` with distances, and for abstract vertices the trees of each side with the codes of the other."""
    cells = tree_pair_cells(g, True)
    trees = _tree_by_root(g, True)
    for top in g.abstract:
        for d in range(g.config.distance + 1):
            low, high = g.sides(top, d)
            for one, other in ((low, high), (high, low)):
                for v in one:
                    for u in other:
                        for r2 in range(g.config.radius_two + 1):
                            for depth in trees[v].values():
                                for f, w in depth.items():
                                    cells[r2, d][g.h([r2, d, f, g.code(r2, u)])] += w
    return cells


#: Cells by kernel name, whether each cell is normalised, and whether the sum is.
KERNELS: dict[str, tuple[Callable[[Graph], Cells], bool, bool]] = {
    "NSPDK": (pair_cells, True, True),
    "SK": (shell_cells, True, True),
    "USPK": (path_cells, True, True),
    "WDK": (context_cells, True, True),
    "PBK": (biased_cells, True, True),
    "DDK": (tree_cells, False, True),
    "NSDDK": (tree_pair_cells, True, False),
    "NSDDK_DISTANCE": (lambda g: tree_pair_cells(g, True), True, False),
    "ANSDDK": (abstract_tree_cells, True, False),
}


def feature_dictionary(vertices: DataFrame, edges: DataFrame, config: Config | None = None) -> DataFrame:
    """``(fid, r, d, near, far, places)``: what a pair feature stands for, with the labels around both ends and how often it occurs.

    The far end alone (no near end) has its own line under its own fid.
    """
    config = config or Config()

    def lines(key, v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        g = build(v, e, config)
        text = lambda r, x: "{" + ",".join(sorted(g.labels[u] for u, d in g.reach[x].items() if d <= r)) + "}"
        out: Counter = Counter()
        for r in range(config.radius + 1):
            for x, u, d in g.pairs():
                (a, ta), (b, tb) = sorted([(g.code(r, x), text(r, x)), (g.code(r, u), text(r, u))])
                out[g.h([r, d, a, b]), r, d, ta, tb] += 1
                out[g.h([r, d, 0, g.code(r, u)]), r, d, "", text(r, u)] += 1
        return pd.DataFrame([(*k, n) for k, n in out.items()], columns=["fid", "r", "d", "near", "far", "places"])

    v = vertices.select("gid", "vid", "label", "is_viewpoint", "is_kernel_point", "is_dead", "is_abstraction").groupBy("gid")
    e = edges.where("not is_dead").select("gid", "src", "dst", "label", "is_abstraction_of", "is_part_of").groupBy("gid")
    each = v.cogroup(e).applyInPandas(lines, "fid bigint, r int, d int, near string, far string, places bigint")
    return each.groupBy("fid", "r", "d", "near", "far").agg(F.sum("places").alias("places"))


def register_kernel(name: str, cells: Callable[[Graph], Cells], by_cell: bool = True, whole: bool = True) -> None:
    """Add a kernel of one's own under a new name."""
    if name in KERNELS:
        raise ValueError(f"kernel {name} exists")
    KERNELS[name] = (cells, by_cell, whole)


def combine(cells: Cells, by_cell: bool, whole: bool) -> Counter:
    out: Counter = Counter()
    for values in cells.values():
        norm = math.sqrt(sum(v * v for v in values.values())) if by_cell else 1.0
        for f, v in values.items():
            out[f] += v / norm if norm else 0.0
    norm = math.sqrt(sum(v * v for v in out.values())) if whole else 1.0
    return Counter({f: v / norm for f, v in out.items()}) if norm else out


V_PARTS = ("vid", "label", "is_viewpoint", "is_kernel_point", "is_dead", "is_abstraction")
E_PARTS = ("src", "dst", "label", "is_abstraction_of", "is_part_of")


def build(vertices: pd.DataFrame, edges: pd.DataFrame, config: Config) -> Graph:
    return assemble(list(zip(*(vertices[c] for c in V_PARTS))), list(zip(*(edges[c] for c in E_PARTS))), config)


def assemble(vertices: list[tuple], edges: list[tuple], config: Config) -> Graph:
    """A graph of rows of V_PARTS and E_PARTS."""
    live = sorted((row for row in vertices if not row[4]), key=lambda row: row[0])
    abstract = {int(row[0]) for row in live if row[5]}
    labels = {int(row[0]): row[1] for row in live}
    steps: dict[int, list[tuple[int, str]]] = defaultdict(list)
    sides = {v: ([], []) for v in abstract}
    for s, t, e, up, part in edges:
        if s in labels and t in labels:
            if s in abstract and (up or part):
                sides[s][0 if part else 1].append(int(t))
            elif s not in abstract and t not in abstract:
                steps[int(s)].append((int(t), e))
    steps = {v: sorted(around) for v, around in steps.items()}
    points = [row for row in live if row[3] and not row[5]]
    return Graph(labels, steps, [int(row[0]) for row in points if row[2]], {int(row[0]) for row in points}, sides, config)


def graphs_of(vertices: pa.Table, edges: pa.Table, config: Config) -> Iterator[tuple[int, Graph]]:
    """``(gid, graph)`` of a batch of graphs."""
    lines: dict[int, list[tuple]] = defaultdict(list)
    around: dict[int, list[tuple]] = defaultdict(list)
    for table, parts, rows in ((vertices, V_PARTS, lines), (edges, E_PARTS, around)):
        for gid, *row in zip(*(table[c].to_pylist() for c in ("gid", *parts))):
            rows[gid].append(tuple(row))
    for gid, own in lines.items():
        yield gid, assemble(own, around.get(gid, []), config)


def local_features(vertices: DataFrame, edges: DataFrame, kernel: str = "NSPDK", config: Config | None = None) -> DataFrame:
    """``(gid, fid, value)`` by the named kernel; both tables are brought together by batches of graphs, one shuffle each."""
    config = config or Config()
    cells, by_cell, whole = KERNELS[kernel]

    def features(v: pa.Table, e: pa.Table) -> pa.Table:
        gids, fids, values = [], [], []
        for gid, g in graphs_of(v, e, config):
            found = combine(cells(g), by_cell and config.normalise, whole and config.normalise)
            gids += [gid] * len(found)
            fids += found
            values += map(float, found.values())
        return pa.table({"gid": pa.array(gids, pa.int64()), "fid": pa.array(fids, pa.int64()), "value": pa.array(values, pa.float64())})

    batch = F.pmod(F.xxhash64("gid"), F.lit(BATCHES)).cast("int").alias("batch")
    v = vertices.select(batch, "gid", *V_PARTS).groupBy("batch")
    e = edges.where("not is_dead").select(batch, "gid", *E_PARTS).groupBy("batch")
    return v.cogroup(e).applyInArrow(features, "gid bigint, fid bigint, value double")


def local_vertex_features(vertices: DataFrame, edges: DataFrame, kernel: str = "NSPDK", config: Config | None = None) -> DataFrame:
    """``(gid, vid, fid, value)`` per source vertex, not normalised; the tree kernels have none and are refused."""
    if kernel not in ("NSPDK", "SK", "USPK", "WDK", "PBK"):
        raise NotImplementedError(f"{kernel} has no features per vertex")
    config = config or Config()
    cells = KERNELS[kernel][0]

    def features(key, v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        g = build(v, e, config)
        rows = []
        for source in g.sources:
            one = Graph(g.labels, g.steps, [source], g.targets, {}, config, g.codes)
            one.__dict__["reach"] = g.reach
            rows += [(key[0], source, f, float(x)) for f, x in combine(cells(one), False, False).items()]
        return pd.DataFrame(rows, columns=["gid", "vid", "fid", "value"])

    v = vertices.select("gid", "vid", "label", "is_viewpoint", "is_kernel_point", "is_dead", "is_abstraction").groupBy("gid")
    e = edges.where("not is_dead").select("gid", "src", "dst", "label", "is_abstraction_of", "is_part_of").groupBy("gid")
    return v.cogroup(e).applyInPandas(features, "gid bigint, vid int, fid bigint, value double")
