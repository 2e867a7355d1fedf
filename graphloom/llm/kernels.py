"""Array kernels that run inside one shard of records: exact sparse cosines, a sketch, and two graph indexes.

All loops run over blocks of records, never over single records; the arrays of a shard are bounded by the
shard size that the router sets.
"""

from __future__ import annotations

import numpy as np

from graphloom.operators.records import mix64

#: Entries of a row that take part in the padded arrays; pairs of longer rows are intersected one by one.
PAD = 64
_CELLS = 1 << 20


class ShardVectors:
    """Sparse rows of one shard with exact cosines between any of them.

    ``normed`` values are parts of unit vectors already; others are divided by the norms of their rows.
    """

    def __init__(self, fids: np.ndarray, vals: np.ndarray, lengths: np.ndarray, normed: bool = False):
        n = len(lengths)
        self.n = n
        self.rows = np.repeat(np.arange(n), lengths)
        norm = np.ones(n) if normed else np.sqrt(np.bincount(self.rows, vals * vals, n))
        self.unit = vals / np.where(norm > 0, norm, 1)[self.rows]
        self.fids = fids
        _, code, count = np.unique(fids, return_inverse=True, return_counts=True)
        shared = count[code] > 1  # a fid of one row adds to no cosine
        renumber = np.cumsum(count > 1) - 1
        self.code = renumber[code[shared]].astype(np.int32)
        self.value = self.unit[shared]
        of = self.rows[shared]
        self.width = int((count > 1).sum())
        self.length = np.bincount(of, minlength=n)
        self.start = np.r_[0, np.cumsum(self.length)]
        self.long = self.length > PAD
        pad = int(min(PAD, self.length.max(initial=1))) or 1
        self.codes = np.full((n, pad), self.width, np.int32)
        self.values = np.zeros((n, pad))
        place = np.arange(len(of)) - self.start[of]
        fit = place < pad
        self.codes[of[fit], place[fit]] = self.code[fit]
        self.values[of[fit], place[fit]] = self.value[fit]
        self.block = int(max(4, _CELLS // (self.width + 1)))

    def sketch(self, dims: int) -> np.ndarray:
        """A signed feature-hash projection; its dot products estimate the cosines."""
        h = mix64(self.fids, 7)
        at = self.rows * dims + (h % np.uint64(dims)).astype(np.int64)
        sign = 1.0 - 2.0 * ((h >> np.uint64(40)) & np.uint64(1)).astype(np.float64)
        return np.bincount(at, self.unit * sign, self.n * dims).reshape(self.n, dims).astype(np.float32)

    def _long_pair(self, a: int, b: int) -> float:
        x, y = slice(self.start[a], self.start[a + 1]), slice(self.start[b], self.start[b + 1])
        _, i, j = np.intersect1d(self.code[x], self.code[y], return_indices=True)
        return float(self.value[x][i] @ self.value[y][j])

    def cosines(self, rows: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Cosines of each of ``rows`` with the other rows in its line of ``other``; -1 in ``other`` gives -inf."""
        out = np.full(other.shape, -np.inf)
        if not len(rows):
            return out
        dense = np.zeros((self.block, self.width + 1))
        for lo in range(0, len(rows), self.block):
            part, cand = rows[lo : lo + self.block], other[lo : lo + self.block]
            lens = self.length[part]
            at_row = np.repeat(np.arange(len(part)), lens)
            flat = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(self.start[part], lens)
            dense[at_row, self.code[flat]] = self.value[flat]
            i, j = np.nonzero(cand >= 0)
            to = cand[i, j]
            got = np.einsum("pl,pl->p", dense[i[:, None], self.codes[to]], self.values[to])
            dense[at_row, self.code[flat]] = 0
            if self.long.any():
                for p in np.flatnonzero(self.long[to]):
                    got[p] = self._long_pair(int(part[i[p]]), int(to[p]))
            out[lo + i, j] = got
        return out


def best(ids: np.ndarray, sims: np.ndarray, k: int):
    """The k largest of each line, in order; equal ids of a line must not occur twice."""
    if ids.shape[1] > k:
        at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        ids, sims = np.take_along_axis(ids, at, 1), np.take_along_axis(sims, at, 1)
    at = np.argsort(-sims, axis=1)
    ids, sims = np.take_along_axis(ids, at, 1), np.take_along_axis(sims, at, 1)
    return np.where(np.isneginf(sims), -1, ids), sims


def once(cand: np.ndarray, known: np.ndarray | None = None, own: np.ndarray | None = None) -> np.ndarray:
    """Each line sorted with repeats, ids already known to the line and its own id made -1."""
    cand = np.sort(cand, axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    if own is not None:
        cand[cand == own[:, None]] = -1
    if known is not None:
        for c in range(known.shape[1]):
            cand[cand == known[:, c : c + 1]] = -1
    return cand


def ranked_within(groups: np.ndarray) -> np.ndarray:
    """Position of every element within its run of equal groups (groups sorted)."""
    if not len(groups):
        return np.zeros(0, np.int64)
    first = np.r_[True, groups[1:] != groups[:-1]]
    starts = np.flatnonzero(first)
    return np.arange(len(groups)) - starts[np.cumsum(first) - 1]


def reverse_lists(ids: np.ndarray, sims: np.ndarray, n: int, k: int):
    """For every row up to k rows that list it, most similar first."""
    src = np.repeat(np.arange(ids.shape[0]), ids.shape[1])
    dst, s = ids.ravel(), sims.ravel()
    ok = dst >= 0
    src, dst, s = src[ok], dst[ok], s[ok]
    order = np.lexsort((src, -s, dst))
    src, dst, s = src[order], dst[order], s[order]
    rank = ranked_within(dst)
    ok = rank < k
    out, sim = np.full((n, k), -1, np.int64), np.full((n, k), -np.inf)
    out[dst[ok], rank[ok]], sim[dst[ok], rank[ok]] = src[ok], s[ok]
    return out, sim


def feature_seeds(vectors: ShardVectors, salt: np.ndarray, features: int, reach: int) -> np.ndarray:
    """Starting neighbours: rows adjacent, in a random order, among those that share a heavy feature."""
    n = vectors.n
    of = np.repeat(np.arange(n), vectors.length)
    if not len(of):
        return np.full((n, 1), -1, np.int64)
    order = np.lexsort((-np.abs(vectors.value), of))
    top = order[ranked_within(of[order]) < features]
    code, row = vectors.code[top], of[top]
    order = np.lexsort((salt[row], code))
    code, row = code[order], row[order]
    column = ranked_within(np.sort(row, kind="stable"))
    slot = np.empty(len(row), np.int64)
    slot[np.argsort(row, kind="stable")] = column
    seeds = np.full((n, features * reach * 2), -1, np.int64)
    for step in range(1, reach + 1):
        same = code[step:] == code[:-step]
        a, b = row[:-step][same], row[step:][same]
        seeds[a, slot[:-step][same] * reach * 2 + 2 * (step - 1)] = b
        seeds[b, slot[step:][same] * reach * 2 + 2 * (step - 1) + 1] = a
    return seeds


def neighbour_descent(vectors: ShardVectors, salt: np.ndarray, k: int, floor: float, rounds: int, edge: float):
    """Approximate neighbour lists by neighbour descent, and each row's leader.

    A round proposes to every row the neighbours, forward and reverse, of its neighbours.  Rows are done when
    a round changes neither them nor a neighbour.  The leader is the row of least salt known to reach ``edge``; leaders
    spread along neighbours and so tie together groups that are larger than k.
    """
    n = vectors.n
    every = np.arange(n)
    seeds = once(feature_seeds(vectors, salt, 6, 2), own=every)
    sims = vectors.cosines(every, seeds)
    leader = every.copy()

    def lead(rows, cand, sim):
        pick = np.where((sim >= edge) & (cand >= 0), salt[cand], np.iinfo(np.int64).max)
        at = pick.argmin(1)
        found = pick[np.arange(len(rows)), at]
        better = found < salt[leader[rows]]
        leader[rows[better]] = cand[better, at[better]]
        return better

    lead(every, seeds, sims)
    sims[sims < floor] = -np.inf
    ids, sims = best(seeds, sims, k)
    active = np.flatnonzero(ids[:, 0] >= 0)
    width = max(4, k)
    for _ in range(rounds):
        back, back_sim = reverse_lists(ids, sims, n, width)
        both, both_sim = np.c_[ids, back], np.c_[sims, back_sim]
        near = once(both[active], own=None)
        touch = near >= 0
        hop = np.where(touch[:, :, None], ids[:, : max(2, k // 2)][near], -1).reshape(len(active), -1)
        heads = np.where(touch, leader[near], -1)
        cand = once(np.c_[hop, near, heads, leader[active]], ids[active], active)
        cand = -np.sort(-cand, axis=1)
        cand = cand[:, : max(1, int((cand >= 0).sum(1).max(initial=0)))]
        sim = vectors.cosines(active, cand)
        moved = lead(active, cand, sim)
        sim[sim < floor] = -np.inf
        new_ids, new_sims = best(np.c_[ids[active], cand], np.c_[sims[active], sim], k)
        moved |= (new_ids != ids[active]).any(1)
        ids[active], sims[active] = new_ids, new_sims
        changed = np.zeros(n, bool)
        changed[active[moved]] = True
        if not changed.any():
            break
        wake = changed | np.where(ids >= 0, changed[ids], False).any(1) | np.where(both >= 0, changed[both], False).any(1)
        active = np.flatnonzero(wake)
    return ids, sims, leader


def refine(vectors: ShardVectors, ids: np.ndarray, sims: np.ndarray, rows: np.ndarray, hops: int, back: int, rounds: int):
    """Exact lists of ``rows`` after also trying the rows that list them and the first ``hops`` neighbours of all those; others stay.

    A row is tried again as long as its own list or that of a neighbour has changed.
    """
    n = len(ids)
    ids, sims, want = ids.copy(), sims.copy(), np.zeros(n, bool)
    want[rows] = True
    for _ in range(rounds):
        if not len(rows):
            break
        rev, _ = reverse_lists(ids, sims, n, back)
        both = np.c_[ids[rows], rev[rows]]
        hop = np.where((both >= 0)[:, :, None], ids[:, :hops][both], -1).reshape(len(rows), -1)
        cand = -np.sort(-once(np.c_[hop, rev[rows]], ids[rows], rows), axis=1)
        cand = cand[:, : max(1, int((cand >= 0).sum(1).max(initial=0)))]
        near, got = best(np.c_[ids[rows], cand], np.c_[sims[rows], vectors.cosines(rows, cand)], ids.shape[1])
        changed = np.zeros(n, bool)
        changed[rows] = (near[:, :hops] != ids[rows][:, :hops]).any(1)
        ids[rows], sims[rows] = near, got
        if not changed.any():
            break
        rows = np.flatnonzero(want & (changed | np.where(ids >= 0, changed[ids], False).any(1)))
    return ids, sims


class SmallWorld:
    """A hierarchical navigable small-world graph held as flat neighbour arrays, one per layer.

    Rows enter layer by layer from the top, in blocks: a block is searched in the graph so far and compared
    within itself, then linked.  Searches advance a whole block of queries in lockstep.  Besides the entry that the
    layers above give, a walk may enter at ``hints``: rows thought to be near, such as those sharing a feature.
    """

    def __init__(self, points: np.ndarray, salt: np.ndarray, hints: np.ndarray | None = None, degree: int = 8, ef: int = 24, block: int = 1024):
        self.points, self.ef, self.degree = points, ef, degree
        n = len(points)
        u = (salt.astype(np.float64) - np.iinfo(np.int64).min + 1) / 2.0**64
        level = np.minimum((-np.log(np.clip(u, 1e-12, 1)) / np.log(degree)).astype(int), 6)
        self.order = np.lexsort((salt, -level))
        sizes = [int((level >= h).sum()) for h in range(level.max(initial=0) + 1)]
        self.sizes = [s for s in sizes if s > 32 or s == n] or [n]
        self.x = np.ascontiguousarray(points[self.order])
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        self.hints = np.full((n, 1), -1, np.int64) if hints is None else np.where(hints >= 0, self.place[hints], -1)[self.order]
        self.layers: list[np.ndarray] = []
        self.found_ids = np.full((n, ef), -1, np.int64)
        self.found_sims = np.full((n, ef), -np.inf, np.float32)
        for h in range(len(self.sizes) - 1, -1, -1):
            self._build(h, block)

    def _build(self, h: int, block: int) -> None:
        size, width = self.sizes[h], 2 * self.degree
        nbrs, sims = np.full((size, width), -1, np.int32), np.full((size, width), -np.inf, np.float32)
        done = self.sizes[h + 1] if self.layers else 0
        if done:  # so far this layer holds the rows of the one above, and so the same links
            nbrs[:done], sims[:done] = self.layers[0], self._sims
        while done < size:
            step = min(size - done, max(64, min(block, done)))
            rows = np.arange(done, done + step)
            q = self.x[rows]
            got_i, got_s = (self._descend(q, nbrs, done, self.hints[rows]) if done else (np.full((step, 1), -1), np.full((step, 1), -np.inf, np.float32)))
            inside = q @ q.T
            np.fill_diagonal(inside, -np.inf)
            k = min(self.ef, step - 1)
            if k > 0:
                at = np.argpartition(-inside, k - 1, axis=1)[:, :k] if k < step - 1 else np.tile(np.arange(step), (step, 1))
                s = np.take_along_axis(inside, at, 1)
                got_i, got_s = np.c_[got_i, at + done], np.c_[got_s, s]
            got_i, got_s = best(got_i, got_s, self.ef)
            self.found_ids[rows, : got_i.shape[1]], self.found_sims[rows, : got_s.shape[1]] = got_i, got_s
            self._link(nbrs, sims, rows, got_i[:, : 2 * self.degree], got_s[:, : 2 * self.degree])
            done += step
        self.layers.insert(0, nbrs)
        self._sims = sims

    def _link(self, nbrs, sims, rows, cand, cand_s) -> None:
        """Link rows to diverse candidates and those back to the rows; full lists keep their nearest."""
        m = cand.shape[1]
        pts = self.x[cand]
        between = pts @ pts.transpose(0, 2, 1)
        taken = np.zeros(cand.shape, bool)
        blocked = cand < 0
        count = np.zeros(len(rows), int)
        for c in range(m):
            pick = ~blocked[:, c] & (count < self.degree)
            taken[:, c] = pick
            count += pick
            blocked |= pick[:, None] & (between[:, c, :] > cand_s)
        free = ~taken & (cand >= 0)  # pruned candidates fill what is left of the list
        room = self.degree - count
        taken |= free & (np.cumsum(free, axis=1) <= room[:, None])
        i, c = np.nonzero(taken)
        src, dst, s = rows[i], cand[i, c], cand_s[i, c]
        src, dst, s = np.r_[src, dst], np.r_[dst, src], np.r_[s, s]
        order = np.lexsort((-s, src))
        src, dst, s = src[order], dst[order], s[order]
        rank = ranked_within(src)
        width = nbrs.shape[1]
        ok = rank < width
        touched, at = np.unique(src[ok], return_inverse=True)
        add_i, add_s = np.full((len(touched), width), -1, np.int32), np.full((len(touched), width), -np.inf, np.float32)
        add_i[at, rank[ok]], add_s[at, rank[ok]] = dst[ok], s[ok]
        same = (add_i[:, :, None] == nbrs[touched][:, None, :]).any(2)
        add_s[same] = -np.inf
        nbrs[touched], sims[touched] = best(np.c_[nbrs[touched], add_i], np.c_[sims[touched], add_s], width)

    def _descend(self, q: np.ndarray, nbrs: np.ndarray, size: int, hints: np.ndarray):
        """Nearest rows of a layer to each query, entering through the layers above."""
        entry = np.zeros((len(q), 1), np.int64)
        for layer in self.layers[::-1]:
            entry = self._walk(layer, q, entry, 4)[0][:, :2]
        return self._walk(nbrs[:size], q, np.c_[entry, np.where(hints < size, hints, -1)], self.ef)

    def _walk(self, nbrs, q, entry, ef, spread: int = 2):
        b, width = len(q), nbrs.shape[1]
        ids, sims = np.full((b, ef), -1, np.int32), np.full((b, ef), -np.inf, np.float32)
        start = once(entry.astype(np.int32))
        s = np.matmul(self.x[start], q[:, :, None])[..., 0]
        s[start < 0] = -np.inf
        e = min(ef, start.shape[1])
        ids[:, :e], sims[:, :e] = best(start, s, e)
        seen = ids < 0
        live, lids, lsims, lseen, lq = np.arange(b), ids.copy(), sims.copy(), seen, q
        while len(live):
            turn = np.cumsum(~lseen, axis=1, dtype=np.int16)
            go = turn[:, -1] > 0
            if not go.all():
                ids[live[~go]], sims[live[~go]] = lids[~go], lsims[~go]
                live, lids, lsims, lseen, lq, turn = live[go], lids[go], lsims[go], lseen[go], lq[go], turn[go]
                if not len(live):
                    break
            pick = ~lseen & (turn <= spread)
            lseen |= pick
            r, c = np.nonzero(pick)
            cand = np.full((len(live), spread, width), -1, np.int32)
            cand[r, turn[r, c] - 1] = nbrs[lids[r, c]]
            cand = cand.reshape(len(live), -1)
            cand.sort(axis=1)
            drop = cand < 0
            drop[:, 1:] |= cand[:, 1:] == cand[:, :-1]
            for k in range(ef):
                drop |= cand == lids[:, k : k + 1]
            cs = np.matmul(self.x[cand], lq[:, :, None])[..., 0]
            drop |= cs <= lsims[:, -1:]  # a row that only equals the last could push others out for ever
            cs[drop] = -np.inf
            both_s = np.concatenate([lsims, cs], axis=1)
            at = np.argpartition(both_s, both_s.shape[1] - ef, axis=1)[:, -ef:]
            part = np.take_along_axis(both_s, at, 1)
            at = np.take_along_axis(at, np.argsort(-part, axis=1), 1)
            lsims = np.take_along_axis(both_s, at, 1)
            gone = np.isneginf(lsims)
            lids = np.take_along_axis(np.concatenate([lids, cand], axis=1), at, 1)
            lids[gone] = -1
            lseen = np.take_along_axis(np.concatenate([lseen, drop], axis=1), at, 1) | gone
        return ids, sims

    def search(self, queries: np.ndarray, hints: np.ndarray | None = None, block: int = 1024):
        """For each query up to ef rows (numbered as given to the constructor) and their similarities."""
        out_i, out_s = np.full((len(queries), self.ef), -1, np.int64), np.full((len(queries), self.ef), -np.inf, np.float32)
        for lo in range(0, len(queries), block):
            q = queries[lo : lo + block]
            entry = np.zeros((len(q), 1), np.int64)
            for layer in self.layers[:0:-1]:
                entry = self._walk(layer, q, entry, 4)[0][:, :2]
            if hints is not None:
                part = hints[lo : lo + block]
                entry = np.c_[entry, np.where(part >= 0, self.place[part], -1)]
            out_i[lo : lo + block], out_s[lo : lo + block] = self._walk(self.layers[0], q, entry, self.ef)
        return np.where(out_i >= 0, self.order[out_i], -1), out_s

    def own(self):
        """What building found for each row, with what later rows found: its nearest rows in the same numbering."""
        back, back_s = reverse_lists(self.found_ids, self.found_sims, len(self.x), self.ef)
        ids = np.c_[self.found_ids, back]
        srt = np.argsort(ids, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, srt, 1), np.take_along_axis(np.c_[self.found_sims, back_s], srt, 1)
        sims[:, 1:][ids[:, 1:] == ids[:, :-1]] = -np.inf
        ids, sims = best(ids, sims, self.ef)
        out_i, out_s = np.empty_like(ids), np.empty_like(sims)
        out_i[self.order], out_s[self.order] = np.where(ids >= 0, self.order[ids], -1), sims
        return out_i, out_s
