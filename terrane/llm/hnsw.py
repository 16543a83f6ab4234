"""Hierarchical navigable small-world graphs over unit vectors, in numpy, many vectors at a time.

Insertion and search work on batches: every step expands the best open nodes of all searches of the batch
at once. A batch that is inserted sees the graph before it and the other vectors of the batch.
"""

from __future__ import annotations

import numpy as np


class Layer:
    """Neighbours of some of the vectors; -1 where there are fewer."""

    def __init__(self, n: int, degree: int):
        self.links = np.full((n, degree), -1, np.int32)
        self.nodes: list[int] = []


class Graph:
    def __init__(self, x: np.ndarray, degree: int = 12, beam: int = 48, seed: int = 7):
        self.x = np.ascontiguousarray(x, np.float32)
        self.degree, self.beam = degree, beam
        n = len(x)
        draw = np.random.default_rng(seed)
        top = np.floor(-np.log(np.maximum(draw.random(n), 1e-12)) / np.log(degree)).astype(int)
        self.level = np.minimum(top, 6)
        self.order = np.argsort(-self.level, kind="stable")  # the high ones come first and hold the rest together
        self.layers = [Layer(n, 2 * degree if i == 0 else degree) for i in range(int(self.level.max(initial=0)) + 1)]
        at, size = 0, 1
        while at < n:
            self._insert(self.order[at : at + size])
            at += size
            size = int(min(1024, max(16, at // 2)))

    def _insert(self, batch: np.ndarray) -> None:
        inner = self.x[batch] @ self.x[batch].T
        np.fill_diagonal(inner, -2)
        entry: np.ndarray | None = None
        for i in range(len(self.layers) - 1, -1, -1):
            layer = self.layers[i]
            own = np.flatnonzero(self.level[batch] >= i)
            if layer.nodes:
                start = entry if entry is not None else np.full((len(batch), 1), layer.nodes[0])
                ids, sims = self._beam(layer, self.x[batch], start, self.beam if len(own) else 4)
                entry = ids[:, :4]
            else:
                ids, sims = np.full((len(batch), 0), -1), np.zeros((len(batch), 0), np.float32)
            if not len(own):
                continue
            near = min(self.beam // 2, len(own) - 1)
            if near > 0:
                among = inner[np.ix_(own, own)]
                pick = np.argpartition(-among, near - 1, axis=1)[:, :near]
                ids = np.concatenate((ids[own], batch[own][pick]), axis=1)
                sims = np.concatenate((sims[own], np.take_along_axis(among, pick, 1)), axis=1)
            else:
                ids, sims = ids[own], sims[own]
            if ids.shape[1]:
                chosen = self._select(ids, sims, self.degree)
                layer.links[batch[own], : self.degree] = chosen
                self._back(layer, batch[own], chosen)
            layer.nodes += batch[own].tolist()

    def _select(self, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
        """Up to ``degree`` of the candidates of each row: first those nearer to the row's vector than to any
        one taken before, then the nearest of the rest."""
        order = np.argsort(-np.where(ids >= 0, sims, -3), axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        rows, width = ids.shape
        taken, count = np.full((rows, degree), -1, np.int64), np.zeros(rows, int)
        used = np.zeros((rows, width), bool)
        for j in range(width):
            c = ids[:, j]
            open_ = np.flatnonzero((c >= 0) & (count < degree) & (taken != c[:, None]).all(1))
            if not len(open_):
                continue
            held = taken[open_]
            sim = np.einsum("rkd,rd->rk", self.x[np.maximum(held, 0)], self.x[c[open_]])
            good = open_[np.where(held >= 0, sim, -3).max(1) < sims[open_, j]]
            taken[good, count[good]] = c[good]
            count[good] += 1
            used[good, j] = True
        for j in range(width):
            c = ids[:, j]
            open_ = np.flatnonzero((c >= 0) & (count < degree) & ~used[:, j] & (taken != c[:, None]).all(1))
            taken[open_, count[open_]] = c[open_]
            count[open_] += 1
        return taken

    def _back(self, layer: Layer, new: np.ndarray, chosen: np.ndarray) -> None:
        """Links from what was chosen back to the new nodes."""
        of, to = chosen.ravel(), np.repeat(new, chosen.shape[1])
        of, to = of[chosen.ravel() >= 0], to[chosen.ravel() >= 0]
        order = np.argsort(of, kind="stable")
        of, to = of[order], to[order]
        nodes, first, counts = np.unique(of, return_index=True, return_counts=True)
        width = layer.links.shape[1]
        for lo in range(0, len(nodes), 2048):
            own, f, k = nodes[lo : lo + 2048], first[lo : lo + 2048], counts[lo : lo + 2048]
            more = np.full((len(own), int(k.max())), -1, np.int64)
            flat = np.repeat(np.arange(len(own)), k)
            more[flat, np.arange(len(flat)) - np.repeat(np.cumsum(k) - k, k)] = to[np.repeat(f - (np.cumsum(k) - k), k) + np.arange(len(flat))]
            ids = np.concatenate((layer.links[own], more), axis=1)
            have = (ids >= 0).sum(1)
            fits = have <= width
            packed = np.take_along_axis(ids, np.argsort(ids < 0, axis=1, kind="stable"), 1)
            layer.links[own[fits]] = packed[fits, :width] if packed.shape[1] >= width else -1
            if (~fits).any():
                full = packed[~fits][:, : int(have.max())]
                sims = np.einsum("rkd,rd->rk", self.x[np.maximum(full, 0)], self.x[own[~fits]])
                layer.links[own[~fits]] = self._select(full, sims, width)

    def _beam(self, layer: Layer, q: np.ndarray, start: np.ndarray, beam: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The nearest nodes found for every query, best first."""
        out_ids, out_sims = [], []
        rows = max(16, min(512, (32 << 20) // max(1, len(self.x))))
        for lo in range(0, len(q), rows):
            i, s = self._beam_rows(layer, q[lo : lo + rows], start[lo : lo + rows], beam, step)
            out_ids.append(i)
            out_sims.append(s)
        return np.concatenate(out_ids), np.concatenate(out_sims)

    def _beam_rows(self, layer, q, start, beam, step):
        n = len(q)
        visited = np.zeros((n, len(self.x)), bool)
        row = np.arange(n)[:, None]
        ids = np.full((n, beam), -1, np.int64)
        ids[:, : min(beam, start.shape[1])] = start[:, :beam]
        double = np.zeros_like(ids, bool)
        for j in range(1, start.shape[1] if start.shape[1] < beam else beam):
            double[:, j] = (ids[:, :j] == ids[:, j : j + 1]).any(1)
        ids[double] = -1
        sims = np.where(ids >= 0, np.einsum("rkd,rd->rk", self.x[np.maximum(ids, 0)], q), -3).astype(np.float32)
        r, c = np.nonzero(ids >= 0)
        visited[r, ids[r, c]] = True
        done = ids < 0
        active = np.arange(n)
        while len(active):
            open_sims = np.where(done[active], -4, sims[active])
            k = min(step, beam)
            pick = np.argpartition(-open_sims, k - 1, axis=1)[:, :k]
            fine = np.take_along_axis(open_sims, pick, 1) > -4
            any_open = fine.any(1)
            active, pick, fine = active[any_open], pick[any_open], fine[any_open]
            if not len(active):
                break
            a = active[:, None]
            done[a, pick] = True
            next_ = layer.links[np.where(fine, ids[a, pick], -1)].reshape(len(active), -1).astype(np.int64)
            next_[~np.repeat(fine, layer.links.shape[1], axis=1)] = -1
            next_.sort(axis=1)
            next_[:, 1:][next_[:, 1:] == next_[:, :-1]] = -1
            next_[visited[a, np.maximum(next_, 0)]] = -1
            r, c = np.nonzero(next_ >= 0)
            if not len(r):
                continue
            visited[active[r], next_[r, c]] = True
            new = np.full(next_.shape, -3, np.float32)
            new[r, c] = np.einsum("id,id->i", self.x[next_[r, c]], q[active[r]])
            all_ids = np.concatenate((ids[active], next_), axis=1)
            all_sims = np.concatenate((sims[active], new), axis=1)
            all_done = np.concatenate((done[active], next_ < 0), axis=1)
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[active], sims[active] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1)
            done[active] = np.take_along_axis(all_done, best, 1)
            done[active] |= sims[active] <= -3
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        return np.where(sims > -3, ids, -1), sims

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of about ``beam`` nearest vectors of every query, best first; -1 where fewer."""
        q = np.ascontiguousarray(q, np.float32)
        entry = np.full((len(q), 1), self.order[0])
        for layer in self.layers[:0:-1]:
            entry = self._beam(layer, q, entry, 4, 2)[0][:, :2]
        return self._beam(self.layers[0], q, entry, min(beam, len(self.x)))


    # ---- as arrays without the vectors, so that a graph can be stored

    def arrays(self) -> dict[str, np.ndarray]:
        out = {"level": self.level, "order": self.order, "shape": np.array([self.degree, self.beam, len(self.layers)])}
        for i, layer in enumerate(self.layers):
            out |= {f"links{i}": layer.links, f"nodes{i}": np.array(layer.nodes, np.int64)}
        return out

    @staticmethod
    def of_arrays(x: np.ndarray, found) -> Graph:
        out = object.__new__(Graph)
        out.x, out.level, out.order = np.ascontiguousarray(x, np.float32), found["level"], found["order"]
        out.degree, out.beam, n = found["shape"].tolist()
        out.layers = []
        for i in range(n):
            layer = object.__new__(Layer)
            layer.links, layer.nodes = found[f"links{i}"], found[f"nodes{i}"].tolist()
            out.layers.append(layer)
        return out


def within(graph: Graph, q: np.ndarray, threshold: float, beam: int = 16, target: float = 0.99, audit: int = 64, chunk: int = 1024, evidence: int = 32, own: bool = False) -> list[np.ndarray]:
    """Vectors at ``threshold`` or more for every query, found by searching the graph. All beams are widened until an
    audit of some queries against all vectors passes; what the audit found that the search missed is added.

    Queries are audited, ``audit`` at first and twice as many each time, until ``evidence`` of them have links, but
    fewer than the beam holds, or all are audited. The mean recall of a query has to reach ``target``, for those
    queries and for those with more links. ``own``: the queries are the graph's vectors, and that each finds
    itself counts for nothing."""
    n, few = len(graph.x), beam
    order = np.random.default_rng(len(q)).permutation(len(q))
    truth: dict[int, np.ndarray] = {}
    links: dict[int, int] = {}  # how many, of the audited queries that have any
    while len(truth) < len(q) and sum(k < few for k in links.values()) < evidence:
        part = order[len(truth) : max(audit, 2 * len(truth))]
        for lo in range(0, len(part), 256):
            sims = q[part[lo : lo + 256]].astype(np.float32) @ graph.x.T
            for i, s in zip(part[lo : lo + 256].tolist(), sims):
                truth[i] = np.flatnonzero(s >= threshold)
                if k := len(truth[i]) - int(own and s[i] >= threshold):
                    links[i] = k
    groups = [g for g in ([i for i, k in links.items() if k < few], [i for i, k in links.items() if k >= few]) if g]
    while beam < n:
        found = [_within(graph, q[g], threshold, beam, chunk) for g in groups]
        if all(np.mean([np.isin(truth[i][truth[i] != i] if own else truth[i], f).mean() for i, f in zip(g, fs)]) >= target for g, fs in zip(groups, found)):
            break
        beam *= 2
    out = _within(graph, q, threshold, min(beam, n), chunk)
    for i, t in truth.items():
        out[i] = np.union1d(out[i], t)
    return out


def _within(graph: Graph, q: np.ndarray, threshold: float, beam: int, chunk: int) -> list[np.ndarray]:
    """What a search with this beam finds at the threshold or above. Where the whole beam is, the search goes on from
    there over links between such vectors, so that it finds groups of any size."""
    out: list[np.ndarray] = []
    for lo in range(0, len(q), chunk):
        part = np.ascontiguousarray(q[lo : lo + chunk], np.float32)
        ids, sims = graph.search(part, beam)
        near = (sims >= threshold) & (ids >= 0)
        found = [own[hit] for own, hit in zip(ids, near)]
        full = np.flatnonzero(near.all(1))
        for at in range(0, len(full), 256):
            rows = full[at : at + 256]
            for r, more in zip(rows, _spread(graph, part[rows], [found[r] for r in rows], threshold)):
                found[r] = more
        out += found
    return out


def _spread(graph: Graph, q: np.ndarray, found: list[np.ndarray], threshold: float) -> list[np.ndarray]:
    """From what was found, all that can be reached over links between vectors at the threshold or above."""
    links = graph.layers[0].links
    seen = np.zeros((len(q), len(graph.x)), bool)
    hits = np.zeros_like(seen)
    row = np.repeat(np.arange(len(q)), [len(f) for f in found])
    node = np.concatenate(found)
    seen[row, node] = hits[row, node] = True
    while len(node):
        next_row, next_node = np.repeat(row, links.shape[1]), links[node].ravel()
        fresh = next_node >= 0
        fresh[fresh] = ~seen[next_row[fresh], next_node[fresh]]
        key = np.unique(next_row[fresh].astype(np.int64) * len(graph.x) + next_node[fresh])
        row, node = key // len(graph.x), key % len(graph.x)
        seen[row, node] = True
        sims = np.empty(len(key), np.float32)
        for i in range(0, len(key), 65536):
            sims[i : i + 65536] = np.einsum("id,id->i", graph.x[node[i : i + 65536]], q[row[i : i + 65536]])
        row, node = row[sims >= threshold], node[sims >= threshold]
        hits[row, node] = True
    return [np.flatnonzero(h) for h in hits]
