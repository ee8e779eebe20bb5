"""Numpy block kernels used inside Arrow batches: distances and top-k of one block."""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from mailvane.functions import fixed_values as V
from mailvane.functions.vectors import metric_name

KEY_SCALE = 1e9  # distances equal to nine decimals are ties, broken by id
_PAIR_CELLS = 1 << 21  # numbers held at once while distances are refined
_BLOCK_CELLS = 1 << 21  # query x row distances held at once
#: Rows of a tile at most, queries that meet it at once, and leading directions that it is bounded by; share of all pairs of queries and tiles
#: above which tiles save nothing.
TILE_ROWS, TILE_QUERIES, DIRECTIONS, TILES_PAY = 128, 2048, 3, 0.8
_TILE_SLACK = 4e-6  # of bounds in single precision


def matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """``array<float|double>`` column as a double matrix; all rows must have one length."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    n = len(vectors)
    flat = np.asarray(vectors.flatten(), dtype=np.float64)
    if n == 0:
        return np.zeros((0, 0))
    lengths = np.asarray(vectors.value_lengths())
    if (lengths != lengths[0]).any():
        raise ValueError("vectors of different dimension: validate the table first")
    return flat.reshape(n, -1)


def sort_key(distance: np.ndarray) -> np.ndarray:
    return np.floor(distance * KEY_SCALE + 0.5).astype(np.int64)


def pair_distance(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Row-wise distance of two equally long matrices."""
    if metric == "euclidean":
        d = a - b
        return np.sqrt(np.einsum("ij,ij->i", d, d))
    dots = np.einsum("ij,ij->i", a, b)
    if metric == "dot":
        return -dots
    denom = np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b))
    flat = denom < V.COSINE_EPS
    return np.where(flat, 1.0, 1.0 - dots / np.where(flat, 1.0, denom))


class Block:
    """Rows of a corpus, sorted by id and by category, ready to be searched.

    Of exact copies within a category only the ``k`` smallest ids can ever be among
    the ``k`` nearest, so the others are left out: a large group of copies does not
    slow the search down and no result changes.
    """

    def __init__(self, ids: pa.Array, vectors: np.ndarray, categories: pa.Array | None, metric: str, k: int, cells: np.ndarray | None = None):
        self.metric, self.k = metric_name(metric), k
        cats = pa.nulls(len(ids), pa.string()) if categories is None else categories
        coded = cats.dictionary_encode()
        self.names = coded.dictionary.to_pylist()
        code = np.asarray(coded.indices.fill_null(-1), dtype=np.int64)
        by_id = np.asarray(pc.sort_indices(ids), dtype=np.int64)
        # copies of a vector may have been given different cells
        apart = code if cells is None else code + cells.astype(np.int64) * (len(self.names) + 1)
        keep = by_id[_first_copies(vectors[by_id], apart[by_id], k)]
        order = keep[np.argsort(code[keep], kind="stable")]
        self.ids, self.rows, self.code = ids.take(pa.array(order)), vectors[order], code[order]
        self.cell_of = None if cells is None else cells[order]
        self.cuts = np.flatnonzero(np.r_[True, self.code[1:] != self.code[:-1], True]) if len(order) else np.zeros(1, int)
        sq = np.einsum("ij,ij->i", self.rows, self.rows) if len(order) else np.zeros(0)
        self.sq = sq
        length = np.sqrt(sq)
        # single precision finds candidates; their distances are computed from the rows
        self.unit = (self.rows / np.where(length > 0, length, 1.0)[:, None]).astype(np.float32).T if len(order) else self.rows.T

    def __len__(self) -> int:
        return len(self.ids)

    def _rough(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance-like scores by one matrix product, with the slack that rounding may need."""
        qsq = np.einsum("ij,ij->i", q, q)
        if self.metric == "cosine":
            return -_unit(q).astype(np.float32) @ self.unit, np.full(len(q), _cosine_slack(q.shape[1]))
        top = self.sq.max()
        if self.metric == "euclidean":
            # squares closer than this may swap once their roots are rounded to nine decimals
            slack = 1e-9 * (qsq + top) + 4e-9 * np.sqrt(qsq + top)
            return (qsq[:, None] + self.sq[None, :]) - 2.0 * (q @ self.rows.T), slack
        return -(q @ self.rows.T), 2e-9 + 1e-12 * np.sqrt(qsq * top)

    def _rough_of(self, distance: np.ndarray) -> np.ndarray:
        """The score that ``_rough`` gives for a distance."""
        return distance - 1.0 if self.metric == "cosine" else distance * distance if self.metric == "euclidean" else distance

    def part(self, lo: int, hi: int) -> Block:
        """Some rows of one category, as a block."""
        some = copy.copy(self)
        some.ids, some.rows, some.code, some.sq, some.unit = self.ids.slice(lo, hi - lo), self.rows[lo:hi], self.code[lo:hi], self.sq[lo:hi], self.unit[:, lo:hi]
        some.cuts = np.array([0, hi - lo])
        return some

    def search_tiles(self, tiled: Tiled, within: np.ndarray):
        """As ``search`` with the cosine metric: rows lie in tiles of near rows, and queries skip tiles out of their reach.

        None if few tiles can be skipped.
        """
        unbound = np.isinf(within).any(axis=0)
        order, cuts, of, low, high = _tiles(places(self.unit.T.astype(np.float64), tiled.basis), self.cuts, np.flatnonzero(~unbound))
        step = TILE_QUERIES
        slices = [slice(at, min(at + step, len(within))) for at in range(0, len(within), step)]
        reach = []
        for part in slices:
            x = tiled.places[part]
            far = np.zeros((len(of), len(x)), np.float32)
            for j in range(x.shape[1]):
                gap = np.maximum(low[:, j, None] - x[None, :, j], x[None, :, j] - high[:, j, None])
                far += np.square(np.maximum(gap, 0.0, out=gap), out=gap)
            reach.append(far <= 2.0 * (within[tiled.order[part]][:, of].T + _TILE_SLACK))
        if sum(int(r.sum()) for r in reach) > TILES_PAY * len(within) * len(of):
            return None
        bars = within - 1.0 + _cosine_slack(self.rows.shape[1])
        bars = np.nextafter(bars.astype(np.float32), np.float32(np.inf))[tiled.order]
        unit, found = np.asfortranarray(self.unit[:, order]), []
        for part, near in zip(slices, reach):
            q, bar = tiled.minus[part], bars[part]
            rs, cs, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
            for n, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
                mine = np.flatnonzero(near[n])
                rough = q[mine] @ unit[:, lo:hi]
                # far faster in one dimension, where few are near
                at = np.flatnonzero((rough <= bar[mine, of[n]][:, None]).ravel())
                r, c = np.divmod(at, hi - lo)
                rs.append(tiled.order[part][mine[r]])
                cs.append(order[lo + c])
                scores.append(rough.ravel()[at])
            r, c = np.concatenate(rs), np.concatenate(cs)
            if len(r) > 2 * self.k * len(q):  # measuring costs far more than this
                keep = _least(r * (len(self.cuts) - 1) + np.searchsorted(self.cuts, c, side="right") - 1, np.concatenate(scores), self.k, 2 * _cosine_slack(self.rows.shape[1]))
                r, c = r[keep], c[keep]
            found.append(self._measured(tiled.queries, r, c))
        for n in np.flatnonzero(unbound):
            r, c, d, rank = self.part(self.cuts[n], self.cuts[n + 1]).search(tiled.queries, within[:, [n]])
            found.append((r, c + self.cuts[n], d, rank))
        return tuple(np.concatenate(p) for p in zip(*found))

    def search(self, queries: np.ndarray, within: np.ndarray | None = None, probes: np.ndarray | None = None):
        """``(query row, block row, distance, rank)`` of the k nearest per category.

        ``within`` has for every query and category of the block (a row per query) a
        distance beyond which nothing is asked for.  ``probes`` has for every query a bit for
        each cell; only rows of these cells are found.
        """
        if not len(self) or not len(queries):
            z = np.zeros(0, dtype=np.int64)
            return z, z, np.zeros(0), z
        step = max(1, _BLOCK_CELLS // len(self))
        cut = lambda x, at: None if x is None else x[at : at + step]
        parts = [self._search(queries[at : at + step], at, cut(within, at), cut(probes, at)) for at in range(0, len(queries), step)]
        return tuple(np.concatenate(p) for p in zip(*parts))

    def _search(self, q: np.ndarray, at: int, within: np.ndarray | None, probes: np.ndarray | None):
        rough, slack = self._rough(q)
        if probes is not None:
            cells, of = np.unique(self.cell_of, return_inverse=True)
            probed = np.take(probes[:, cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1 == 1, of, axis=1)
            rough[~probed] = np.inf
        near = np.empty(rough.shape, dtype=bool)
        for n, (lo, hi) in enumerate(zip(self.cuts[:-1], self.cuts[1:])):
            part = rough[:, lo:hi]
            bar = np.full(len(q), np.inf) if within is None else self._rough_of(within[:, n]) + slack
            unbound = np.flatnonzero(np.isinf(bar))
            if hi - lo > self.k and len(unbound):
                some = part if len(unbound) == len(q) else part[unbound]
                bar[unbound] = np.partition(some, self.k - 1, axis=1)[:, self.k - 1] + slack[unbound]
            # compared in the type of the scores; rounding of the bar is far below the slack
            bar = np.nextafter(bar.astype(part.dtype), np.inf, dtype=part.dtype)
            np.less_equal(part, bar[:, None], out=near[:, lo:hi])
            if hi - lo <= self.k:
                near[unbound, lo:hi] = True
        if probes is not None:
            near &= probed
        # far faster in one dimension, where few are near
        r, c = np.divmod(np.flatnonzero(near.ravel()), rough.shape[1])
        r, c, d, rank = self._measured(q, r, c)
        return r + at, c, d, rank

    def _measured(self, q: np.ndarray, r: np.ndarray, c: np.ndarray):
        """The k nearest of each query and category among candidates ``(query row, block row)``."""
        step = max(1, _PAIR_CELLS // q.shape[1])
        d = np.concatenate(  # there may be no pair within the distances asked for
            [np.zeros(0), *[pair_distance(q[r[i : i + step]], self.rows[c[i : i + step]], self.metric) for i in range(0, len(r), step)]]
        )
        return top_k(r, self.code[c], sort_key(d), c, d, self.k)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.einsum("ij,ij->i", m, m))
    return m / np.where(n > 0, n, 1.0)[:, None]


def _cosine_slack(dim: int) -> float:
    """What rounding of a product of two vectors of length one may need."""
    return 2e-9 + (dim + 4) * 2.0**-22


def _least(group: np.ndarray, score: np.ndarray, k: int, slack: float) -> np.ndarray:
    """Places of the scores that are no more than ``slack`` above the k-th smallest of their group; scores are from -2 to 2."""
    # numbers of one size sort by their bits
    order = np.argsort((group << 32) | (score + np.float32(2.5)).view(np.int32))
    new = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1], True])
    last = np.minimum(new[:-1] + k, new[1:]) - 1
    bar = np.repeat(score[order[last]].astype(np.float64) + slack + 1e-6, np.diff(new))
    return order[score[order] <= bar]


class Tiled:
    """Queries as :meth:`Block.search_tiles` needs them: near ones together, and their places.

    ``basis`` has orthonormal columns that hold most of the queries.
    """

    def __init__(self, queries: np.ndarray):
        unit = _unit(queries)
        some = unit[:: max(1, len(unit) // 4096)]
        self.queries, self.basis = queries, np.linalg.eigh(some.T @ some)[1][:, -DIRECTIONS:]
        at = places(unit, self.basis)
        self.order = _tiles(at, np.array([0, len(at)]), [0])[0]
        self.places, self.minus = at[self.order], -unit.astype(np.float32)[self.order]


def places(unit: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Coordinates by ``basis``, and the length of what is left.

    The distance of two places is at most that of the vectors, as what is left of both
    has no greater product than their lengths have.
    """
    x = unit @ basis
    left = np.sqrt(np.maximum(1.0 - np.einsum("ij,ij->i", x, x), 0.0))
    return np.column_stack([x, left]).astype(np.float32)


def _tiles(x: np.ndarray, cuts: np.ndarray, categories: list[int]):
    """``(order, cuts, category, low, high)`` of tiles: rows of a category, halved along the widest side."""
    tiles, of = [], []
    for n in categories:
        halves = [np.arange(cuts[n], cuts[n + 1])]
        while halves:
            rows = halves.pop()
            if len(rows) <= TILE_ROWS:
                tiles.append(rows)
                of.append(n)
                continue
            side = x[rows, np.argmax(np.ptp(x[rows], axis=0))]
            by_side = np.argpartition(side, len(rows) // 2)
            halves += [rows[by_side[: len(rows) // 2]], rows[by_side[len(rows) // 2 :]]]
    low, high = (np.array([f(x[rows], axis=0) for rows in tiles]).reshape(-1, x.shape[1]) for f in (np.min, np.max))
    order = np.concatenate([np.zeros(0, np.int64), *tiles])
    return order, np.r_[0, np.cumsum([len(rows) for rows in tiles])].astype(np.int64), np.array(of, np.int64), low, high


class Nearest:
    """The k nearest rows so far, per category, of the queries of one task."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.probes: np.ndarray | None = None
        self.names: list[str | None] = []
        self.kth = np.zeros((len(queries), 0))  # distance of the k-th row of each category, if there are k
        self.best: pa.Table | None = None
        self.tiled: Tiled | None = None
        self.tiles = len(queries) >= TILE_ROWS and queries.shape[1] > 4 * DIRECTIONS  # until they save nothing

    def only(self, probes: np.ndarray) -> None:
        """Every query finds only rows of the cells for which it has a bit."""
        self.probes, self.tiles = probes, False

    def meet(self, block: Block) -> None:
        if not len(block) or not len(self.queries):
            return
        of_block = [None if code < 0 else block.names[code] for code in block.code[block.cuts[:-1]]]
        new = [name for name in of_block if name not in self.names]
        self.names += new
        self.kth = np.column_stack([self.kth, np.full((len(self.queries), len(new)), np.inf)])
        mine = np.array([self.names.index(name) for name in of_block])
        # ties to nine decimals may still take a place
        within, found = self.kth[:, mine] + 2e-9, None
        if self.tiles and self.best is not None and block.metric == "cosine" and len(block) > 4 * TILE_ROWS:
            self.tiled = self.tiled or Tiled(self.queries)
            found = block.search_tiles(self.tiled, within)
            self.tiles = found is not None
        r, c, d, _ = found or block.search(self.queries, within, self.probes)
        if not len(r):
            return
        code = mine[np.searchsorted(block.cuts, c, side="right") - 1]
        self._take(pa.table({"r": r, "code": code, "id": block.ids.take(pa.array(c)), "d": d}))

    def _take(self, fresh: pa.Table) -> None:
        n = len(self.names)
        group = lambda t: t["r"].to_numpy() * n + t["code"].to_numpy()
        kept = None
        if self.best is not None:
            # groups without a new row stay as they are
            touched = np.zeros(len(self.queries) * n, dtype=bool)
            touched[group(fresh)] = True
            hit = touched[group(self.best)]
            kept, fresh = self.best.filter(pa.array(~hit)), pa.concat_tables([self.best.filter(pa.array(hit)), fresh])
        ids = fresh["id"].combine_chunks()
        by_id = np.asarray(pc.sort_indices(ids))
        place = np.empty(len(fresh), dtype=np.int64)
        place[by_id] = np.arange(len(fresh))
        d = fresh["d"].to_numpy()
        r, at, d, rank = top_k(fresh["r"].to_numpy(), fresh["code"].to_numpy(), sort_key(d), place, d, self.k)
        fresh = fresh.take(pa.array(by_id[at]))
        last = rank == self.k
        self.kth[r[last], fresh["code"].to_numpy()[last]] = d[last]
        self.best = fresh if kept is None else pa.concat_tables([kept, fresh]).combine_chunks()

    def batches(self, rows: int = 1 << 16):
        """``(query row, category, id, distance)`` of all of them, in slices."""
        names = pa.array(self.names, pa.string())
        for at in range(0, 0 if self.best is None else len(self.best), rows):
            t = self.best.slice(at, rows).combine_chunks()
            yield t["r"].to_numpy(), names.take(t["code"].combine_chunks()), t["id"].combine_chunks(), t["d"].to_numpy()


def _sorted(*keys: np.ndarray) -> np.ndarray:
    """Order by whole numbers, the first of them first; as one number where they fit."""
    packed, bits = 0, 0
    for x in keys if len(keys[0]) else ():
        low, high = int(x.min()), int(x.max())
        bits += (width := (high - low).bit_length())
        if bits > 63:
            return np.lexsort(keys[::-1])
        packed = (packed << width) | (x - low)
    return np.argsort(packed) if len(keys[0]) else np.zeros(0, np.int64)


def top_k(query, category, key, position, distance, k):
    """Keep the k smallest ``(key, position)`` of every ``(query, category)``."""
    order = _sorted(query, category, key, position)
    q, cat = query[order], category[order]
    new = np.r_[True, (q[1:] != q[:-1]) | (cat[1:] != cat[:-1])] if len(q) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(len(q)), 0)) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - start
    keep = rank < k
    order = order[keep]
    return query[order], position[order], distance[order], rank[keep] + 1


def _first_copies(vectors: np.ndarray, code: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k copies of every ``(category, vector)``."""
    n = len(vectors)
    if n <= k:
        return np.arange(n)
    table = np.ascontiguousarray(np.column_stack([code.astype(np.float64), vectors]))
    bits = table.view(np.uint64)
    # numbers instead of rows; rows of one number are compared, and all rows sorted where two differ
    mix = np.random.default_rng(1).integers(1, 1 << 63, bits.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    _, first, group = np.unique((bits ^ (bits >> np.uint64(29))) @ mix, return_index=True, return_inverse=True)
    if len(first) == n:
        return np.arange(n)
    again = np.flatnonzero(first[group] != np.arange(n))
    if (bits[again] != bits[first[group[again]]]).any():
        raw = table.view(np.dtype((np.void, table.itemsize * table.shape[1]))).ravel()
        _, group = np.unique(raw, return_inverse=True)
    order = np.argsort(group, kind="stable")
    g = group[order]
    start = np.maximum.accumulate(np.where(np.r_[True, g[1:] != g[:-1]], np.arange(n), 0))
    return np.sort(order[np.arange(n) - start < k])
