"""The k best entries of a catalogue for each query, by blocks of vectors.

A task holds a block of queries and lets its share of the entries stream by in the order of their ids. Scores of a
block and a chunk of entries come from one matrix product; it adds in another order than a sum from first to last, so
it only tells which pairs may be among the k best. Those are scored anew, from first to last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries scored together, pairs scored anew together, and what a matrix product may differ by.
CHUNK, PAIRS, SLACK = 256, 1 << 16, 1e-9
#: Norms between which a cosine from a matrix product is as exact as that; vectors beyond are scored one by one.
LEAST, MOST = 1e-100, 1e100


def _columns(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a row for each place of a vector, lengths, whether a vector or a component is null); shorter vectors end in zeros."""
    flat = pc.list_flatten(lists).cast(pa.float64())
    length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(len(length)), length)
    place = np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length)
    out = np.zeros((int(length.max(initial=0)), len(length)))
    out[place, of] = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
    void = lists.is_null().to_numpy(zero_copy_only=False).copy()
    void[of[flat.is_null().to_numpy(zero_copy_only=False)]] = True
    return out, length, void


def _padded(x: np.ndarray, places: int) -> np.ndarray:
    return np.vstack([x, np.zeros((places - len(x), x.shape[1]))]) if len(x) < places else x


class Rows:
    """Ids, vectors, samples and types of queries or entries."""

    def __init__(self, b: pa.RecordBatch | pa.Table):
        whole = lambda c: x.combine_chunks() if isinstance(x := b.column(c), pa.ChunkedArray) else x
        self.ids = whole("id").to_numpy(zero_copy_only=False)
        self.x, self.length, self.void = _columns(whole("vector"))
        square = np.zeros(len(self.ids))
        with np.errstate(all="ignore"):
            for v in self.x:
                square = square + v * v
            self.norm = np.sqrt(square)
        self.plain = (self.norm > LEAST) & (self.norm < MOST)
        samples = whole("samples")
        self.unknown = samples.is_null().to_numpy(zero_copy_only=False)
        self.many = whole("many").to_numpy(zero_copy_only=False)
        words = pc.list_flatten(samples).dictionary_encode()
        at = pc.list_parent_indices(samples).to_numpy()
        code = words.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        self.holders = dict(zip(words.dictionary.to_pylist(), np.split(at[order], np.cumsum(np.bincount(code, minlength=len(words.dictionary)))[:-1]))) if len(code) else {}
        self.kinds = whole("dtype").to_pylist()


class Best:
    """The k best entries of each query so far: by score, NaN first and null last, then in the order they came."""

    def __init__(self, queries: Rows, k: int):
        self.q, self.k, self.seen = queries, k, 0
        self.row, self.place = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.score, self.void = np.zeros(0), np.zeros(0, bool)
        self.id = np.zeros(0, queries.ids.dtype)
        self.worst = np.full(len(queries.ids), -np.inf)
        self.kind_code = {v: i for i, v in enumerate(dict.fromkeys(queries.kinds)) if v is not None}
        self.kinds = np.array([self.kind_code.get(v, -1) for v in queries.kinds], np.int32)
        self.rows_of: dict = {}
        for i, v in enumerate(queries.ids):
            self.rows_of.setdefault(v, []).append(i)

    def meet(self, e: Rows) -> None:
        q, n, m = self.q, len(self.q.ids), len(e.ids)
        places = max(len(q.x), len(e.x))
        qx, ex = _padded(q.x, places), _padded(e.x, places)
        shared = np.zeros((n, m), np.float32)
        for sample, at in e.holders.items():
            if sample in q.holders:
                shared[np.ix_(q.holders[sample], at)] += 1
        same = self.kinds[:, None] == np.array([self.kind_code.get(v, -2) for v in e.kinds], np.int32)
        own = np.zeros((n, m), bool)
        for j, v in enumerate(e.ids):
            if v in self.rows_of:
                own[self.rows_of[v], j] = True
        void = (q.void[:, None] | e.void) | (q.length[:, None] != e.length) | ((q.many > 0)[:, None] & e.unknown)
        with np.errstate(all="ignore"):
            about = (qx / q.norm).T @ (ex / e.norm)
            about += shared * (0.3 / np.maximum(q.many, 1))[:, None]
            about += same * 0.1
        about[~q.plain] = np.inf
        about[:, ~e.plain] = np.inf
        about[void | own] = -np.inf
        rows = np.flatnonzero(about.max(axis=1, initial=-np.inf) >= self.worst - SLACK)
        about = about[rows]
        least = self.worst[rows] - SLACK
        if m > self.k:
            least = np.maximum(least, np.partition(about, -self.k, axis=1)[:, -self.k] - 2 * SLACK)
        void, own = void[rows] & ~own[rows], own[rows]
        first_void = void & (np.cumsum(void, axis=1) <= self.k) & (self.worst[rows] == -np.inf)[:, None]
        i, j = np.nonzero(((about >= least[:, None]) & ~void & ~own) | first_void)
        null = void[i, j]
        i = rows[i]
        score = np.empty(len(i))
        with np.errstate(all="ignore"):
            for at in range(0, len(i), PAIRS):
                a, b = i[at:at + PAIRS], j[at:at + PAIRS]
                dot = np.zeros(len(a))
                for x, y in zip(qx, ex):
                    dot += x[a] * y[b]
                part = np.where(q.many[a] > 0, shared[a, b].astype(float) / np.maximum(q.many[a], 1), 0.0)
                score[at:at + PAIRS] = dot / (q.norm[a] * e.norm[b]) + 0.3 * part + np.where(same[a, b], 0.1, 0.0)
        score[null] = 0
        self._keep(i, self.seen + j, score, null, e.ids[j])
        self.seen += m

    def _keep(self, row: np.ndarray, place: np.ndarray, score: np.ndarray, void: np.ndarray, ids: np.ndarray) -> None:
        row, place, score, void, ids = (np.concatenate(x) for x in ((self.row, row), (self.place, place), (self.score, score), (self.void, void), (self.id, ids)))
        key = np.where(np.isnan(score), -np.inf, -score)
        order = np.lexsort((place, key, ~np.isnan(score), void, row))
        row = row[order]
        first = np.searchsorted(row, np.arange(len(self.q.ids)))
        keep = np.arange(len(row)) - first[row] < self.k
        order = order[keep]
        self.row, self.place, self.score, self.void, self.id = row[keep], place[order], score[order], void[order], ids[order]
        full = np.flatnonzero(np.bincount(self.row, minlength=len(self.q.ids)) == self.k)
        last = np.searchsorted(self.row, full, "right") - 1
        self.worst[full] = np.where(self.void[last], -np.inf, np.where(np.isnan(self.score[last]), np.inf, self.score[last]))


def search(k: int):
    """For mapInArrow over (task, role, id, vector, samples, many, dtype), sorted by task, role and id: the queries of a task have role 0.

    Yields (query, entry, raw), at most k rows a query and task.
    """

    def of(best: Best, kind: pa.DataType) -> pa.RecordBatch:
        ids = lambda x: pa.array(x.tolist(), kind)
        return pa.RecordBatch.from_arrays([ids(best.q.ids[best.row]), ids(best.id), pa.array(best.score, mask=best.void)], ["query", "entry", "raw"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: list[pa.RecordBatch] = []
        best = task = kind = None
        for b in batches:
            if not b.num_rows:
                continue
            kind = b.column("id").type
            tasks, roles = b.column("task").to_numpy(), b.column("role").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((tasks[1:] != tasks[:-1]) | (roles[1:] != roles[:-1])) + 1, [b.num_rows]])
            for at, to in zip(cuts[:-1], cuts[1:]):
                if tasks[at] != task:
                    if best is not None:
                        yield of(best, kind)
                    task, best, queries = tasks[at], None, []
                part = b.slice(at, to - at)
                if roles[at] == 0:
                    queries.append(part)
                elif queries:
                    best = best or Best(Rows(pa.Table.from_batches(queries).combine_chunks()), k)
                    for c in range(0, part.num_rows, CHUNK):
                        best.meet(Rows(part.slice(c, CHUNK)))
        if best is not None:
            yield of(best, kind)

    return run
