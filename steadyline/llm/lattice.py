"""SentencePiece encoding by sampling segmentations without replacement, and decoding.

The lattice of a text falls into units (blanks with the word after them; a line break) that no piece crosses, so a
text's segmentations are combinations of its units' segmentations. Perturbed A-star search takes the best k of all
of them under Gumbel noise: a region of segmentations (a common beginning, some choices ruled out at the next
unit, the rest free) has a known mass, so the largest noisy score in it can be drawn at once, given that it is below
its parent's; the region with the largest one is opened next. The search is exact, and the noise depends on the
row's key, the sample and the place only.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, types as T

from steadyline.llm.batches import slices
from steadyline.llm.words import mixed

BASE = np.uint64(0x100000001B3)
STEP = np.uint64(0x9E3779B97F4A7C15)
PLACE = np.uint64(0xD1B54A32D192ED03)
SHIFT = 2.7
SLOT_BITS = 18


class Pieces(NamedTuple):
    text: pa.Array  # bytes of each piece, blanks as blanks
    weight: np.ndarray  # log weight of each piece
    byte: np.ndarray  # piece of each byte
    prefix: np.ndarray  # hashes of the pieces' beginnings, sorted; at the end the largest number
    slot: np.ndarray  # for each value of a hash's first SLOT_BITS bits, the place in prefix from which to look
    piece: np.ndarray  # the piece that such a beginning is, or -1
    short: np.ndarray  # for each byte and each pair of bytes (after the first 256), its place in prefix, or -1
    longest: int


def pieces(model_file: str, sharpness: float = 1.0) -> Pieces:
    """A SentencePiece model with byte fallback. A piece's weight falls with its rank r by score: (r + SHIFT) ** -sharpness.

    The file is read where this is called; what it holds goes to the executors with the job. Pieces with a blank behind
    another character are not supported.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = model.get_piece_size()
    surface = [model.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
    usual = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    byte = np.full(256, -1)
    for i in range(n):
        if model.is_byte(i):
            value = int(model.id_to_piece(i)[3:-1], 16)
            byte[value], surface[i] = i, bytes([value])
    if (byte < 0).any():
        raise ValueError("the model has no byte fallback")
    score = np.full(n, -np.inf)
    for i in usual:
        score[i] = model.get_score(i)
    rank = np.empty(n, np.int64)
    rank[np.argsort(-score, kind="stable")] = np.arange(n)
    begins: dict[int, int] = {}
    for i in usual:
        if b" " in surface[i].lstrip(b" "):
            raise ValueError(f"piece {i} has a blank inside")
        h = 0
        for j, c in enumerate(surface[i]):
            h = (h + c + 1) * int(STEP) & 0xFFFFFFFFFFFFFFFF
            begins.setdefault(h, -1)
            if j == len(surface[i]) - 1:
                begins[h] = i
    keys = np.array(sorted(begins), np.uint64)
    prefix = np.append(keys, np.uint64(0xFFFFFFFFFFFFFFFF))
    slot = np.searchsorted(keys, np.arange(1 << SLOT_BITS, dtype=np.uint64) << np.uint64(64 - SLOT_BITS))
    first = np.arange(256, dtype=np.uint64) + np.uint64(1)
    hashed = np.append(first * STEP, (((first * STEP)[:, None] + first[None, :]) * STEP).reshape(-1))
    at = np.searchsorted(keys, hashed)
    return Pieces(
        pa.array(surface, pa.large_binary()), -sharpness * np.log(rank + SHIFT), byte, prefix, slot,
        np.array([*(begins[int(k)] for k in keys), -1]), np.where(prefix[at] == hashed, at, -1), max(len(surface[i]) for i in usual),
    )


def _places(h: np.ndarray, p: Pieces) -> np.ndarray:
    """Where in ``p.prefix`` each hash is, or would be."""
    k = p.slot[h >> np.uint64(64 - SLOT_BITS)]
    behind = np.flatnonzero(p.prefix[k] < h)
    while len(behind):
        k[behind] += 1
        behind = behind[p.prefix[k[behind]] < h[behind]]
    return k


class Lattices:
    """The lattices of distinct units side by side; a node is a byte position of a unit."""

    def __init__(self, units: pa.Array, p: Pieces):
        off = np.frombuffer(units.buffers()[1], np.int64)[units.offset : units.offset + len(units) + 1]
        data = np.frombuffer(units.buffers()[2], np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        size = np.diff(off)
        unit = np.repeat(np.arange(len(size)), size)
        end = off[unit + 1]
        lead = (data & 0xC0) != 0x80
        place = np.arange(len(data))
        first = place[lead][np.cumsum(lead) - 1] if len(data) else place
        width = np.bincount(first, minlength=len(data))  # bytes of the character that begins here
        widest = int(width.max(initial=0))
        spelled = np.zeros(len(data), bool)
        n_into = np.zeros(len(data) + 1, np.int64)  # edges that end at each byte; where a unit ends, its own
        at, h, found = np.flatnonzero(lead), None, []
        for n in range(1, p.longest + 1):
            room = at + n <= end[at]
            if n < 3:
                at = at[room]
                k = p.short[data[at]] if n == 1 else p.short[256 + (data[at].astype(np.int64) << 8) + data[at + 1]]
                known = k >= 0
            else:
                at, h = at[room], h[room]
                h = (h + data[at + n - 1] + np.uint64(1)) * STEP
                k = _places(h, p)
                known = p.prefix[k] == h
            at, k = at[known], k[known]
            h, piece = p.prefix[k], p.piece[k]
            is_piece = piece >= 0
            starts = at[is_piece]
            found.append((starts, starts + n, piece[is_piece]))
            n_into[starts + n] += 1
            if n <= widest:
                spelled[starts[width[starts] == n]] = True
            if not len(at):
                break
        # characters that are no piece are spelled in bytes
        raw = np.flatnonzero(~spelled[first])
        found.append((raw, raw + 1, p.byte[data[raw]]))
        n_into[raw + 1] += 1
        # edges in the order of the nodes they end at, nodes by length of the way so far; into a node, shorter edges come first
        ends = np.flatnonzero(n_into)
        step = ends - off[unit[ends - 1]]
        order = np.argsort(step.astype(np.uint16) if step.max(initial=0) < 1 << 16 else step, kind="stable")
        ends, step = ends[order], step[order]
        into = n_into[ends]
        bounds = np.concatenate([[0], np.cumsum(into)])
        self.node_first = bounds[:-1]
        free = np.empty(len(data) + 1, np.int64)
        free[ends] = self.node_first
        self.source, self.piece = np.empty(bounds[-1], np.int64), np.empty(bounds[-1], np.int64)
        for start, stop, piece in found:
            at = free[stop]
            free[stop] = at + 1
            self.source[at], self.piece[at] = start + unit[start], piece
        nodes = ends + unit[ends - 1]
        weight = p.weight[self.piece]
        n_nodes = len(data) + len(size)
        self.begin, self.end = off[:-1] + np.arange(len(size)), off[1:] + np.arange(len(size))
        mass = np.full(n_nodes, -np.inf)
        self.ways = np.zeros(n_nodes)
        mass[self.begin], self.ways[self.begin] = 0.0, 1.0
        cuts = np.flatnonzero(np.append(True, np.diff(step) != 0)) if len(step) else []
        for a, z in zip(cuts, np.append(cuts[1:], len(step)) if len(step) else []):
            lo, hi = bounds[a], bounds[z]
            before, group = self.source[lo:hi], self.node_first[a:z] - lo
            weight[lo:hi] += mass[before]
            mass[nodes[a:z]] = np.logaddexp.reduceat(weight[lo:hi], group)
            with np.errstate(over="ignore"):  # infinitely many will do
                self.ways[nodes[a:z]] = np.add.reduceat(self.ways[before], group)
        with np.errstate(invalid="ignore"):
            log_p = weight - np.repeat(mass[nodes], into)
        self.log_p = np.where(np.isfinite(log_p), log_p, -np.inf)
        share = np.exp(self.log_p)
        # shares added up node by node, so that no number depends on the other units; and the likeliest edge into each node
        self.upto = upto = share.copy()
        self.top, which = self.node_first.copy(), np.arange(len(nodes))
        for i in range(1, int(into.max(initial=0))):
            which = which[into[which] > i]
            at, top = self.node_first[which] + i, self.top[which]
            upto[at] += upto[at - 1]
            self.top[which] = np.where(share[at] >= share[top], at, top)
        self.bounds = bounds
        self.top_share, self.top_before = share[self.top], upto[self.top] - share[self.top]
        self.rank = np.full(n_nodes, -1)
        self.rank[nodes] = np.arange(len(nodes))

    def sample(self, units: np.ndarray, seeds: np.ndarray):
        """A segmentation of each unit: (edges front to back, start of each unit's edges, log probability)."""
        node, log_p = self.end[units].copy(), np.zeros(len(units))
        active, steps = np.arange(len(units)), []
        while len(active):
            k, u = self.rank[node[active]], uniform(seeds[active], len(steps))
            e = self.top[k]
            rest = np.flatnonzero(u >= self.top_share[k])
            if len(rest):
                r, x = k[rest], u[rest] - self.top_share[k[rest]]
                x = np.where(x < self.top_before[r], x, x + self.top_share[r])
                at, last = self.bounds[r], self.bounds[r + 1] - 1
                behind = np.flatnonzero((self.upto[at] <= x) & (at < last))
                while len(behind):
                    at[behind] += 1
                    behind = behind[(self.upto[at[behind]] <= x[behind]) & (at[behind] < last[behind])]
                e[rest] = at
            log_p[active] += self.log_p[e]
            node[active] = self.source[e]
            steps.append((active, e))
            active = active[node[active] != self.begin[units[active]]]
        return *_joined(steps, len(units)), log_p

    def others(self, units: np.ndarray, ruled_out: list[list[np.ndarray]], seeds: np.ndarray):
        """Of each unit a segmentation that is none of its ``ruled_out``, by its probability among the others: edges, and starts."""
        node, active, steps = self.end[units].copy(), np.arange(len(units)), []
        left = {j: [r[::-1] for r in own] for j, own in enumerate(ruled_out)}
        while len(active):
            done, k = len(steps), self.rank[node[active]]
            first, last = self.bounds[k], self.bounds[k + 1] - 1
            edges = first[:, None] + np.arange((last - first).max() + 1)
            inside = edges <= last[:, None]
            edges = np.minimum(edges, last[:, None])
            share, free = np.exp(self.log_p[edges]), self.ways[self.source[edges]]
            for row, j in enumerate(active.tolist()):
                for r in left.get(j, ()):
                    i = r[done] - first[row]
                    share[row, i] -= np.exp(self.log_p[r[done:]].sum())
                    free[row, i] -= 1
            open_ = inside & (free > 0)
            share = np.where(open_, np.maximum(share, 0.0), 0.0)
            share = np.where(share.any(axis=1)[:, None], share, open_)  # no share: all that is left is below rounding
            upto = np.cumsum(share, axis=1)
            drawn = uniform(seeds[active], done) * upto[:, -1]
            e = first + np.minimum((upto <= drawn[:, None]).sum(axis=1), share.shape[1] - 1 - (share[:, ::-1] > 0).argmax(axis=1))
            for row, j in enumerate(active.tolist()):
                if j in left:
                    left[j] = [r for r in left[j] if r[done] == e[row]]
            node[active] = self.source[e]
            steps.append((active, e))
            active = active[node[active] != self.begin[units[active]]]
        return _joined(steps, len(units))


def _joined(steps: list[tuple[np.ndarray, np.ndarray]], n: int):
    """Of walks from the end, (walks, their edges) step by step: all edges front to back, and where each walk's begin."""
    counts = np.zeros(n, np.int64)
    for a, _ in steps:
        counts[a] += 1
    start = np.concatenate([[0], np.cumsum(counts)])
    edges = np.empty(start[-1], np.int64)
    for k, (a, e) in enumerate(steps):
        edges[start[a] + counts[a] - 1 - k] = e
    return edges, start


def uniform(seeds: np.ndarray, k: int) -> np.ndarray:
    """Numbers in (0, 1) of (seed, k)."""
    return ((mixed(seeds + np.array([k + 1], np.uint64) * STEP) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _below(location: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel numbers at ``location``, given that they are at most ``bound``."""
    return -np.logaddexp(-bound, -location + np.log(-np.log(u)))


class Leaf(NamedTuple):
    edges: np.ndarray
    start: np.ndarray  # of each unit's edges
    log_p: np.ndarray  # of each unit's segmentation
    after: np.ndarray  # largest noisy score of the region that first differs at this unit; -inf: none


def _units(texts: list[bytes]):
    """Unit boundaries: the joined texts, each with a blank in front, and first unit of each text."""
    data = b"".join(b" " + t if t else b"" for t in texts)
    size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    b = np.frombuffer(data, np.uint8)
    begins = np.zeros(len(b) + 1, bool)
    begins[:-1] = (b == 32) | (b == 10)
    if len(b) > 1:
        begins[1:-1] &= (b[:-1] != 32) | (b[1:] == 10)
        begins[1:-1] |= b[:-1] == 10
    text_at = np.concatenate([[0], np.cumsum(size)])
    begins[text_at] = True
    at = np.flatnonzero(begins)
    units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data)])
    return data, units, np.searchsorted(at, text_at)


def _seeds(keys: list, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest("" if k is None else str(k), seed) for k in keys], np.uint64)


def searched(texts: list[bytes], keys: np.ndarray, k: int, p: Pieces):
    """Of each text its best k segmentations under noise: lists of (ids, start of each text's ids, log_p, score, there), and kappa.

    kappa: the noisy score of the next one, -inf where there is none.
    """
    data, units, first = _units(texts)
    coded = units.dictionary_encode()
    unit = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lat = Lattices(coded.dictionary, p)
    n, texts_n = len(unit), len(texts)
    text = np.repeat(np.arange(texts_n), np.diff(first))
    place = (np.arange(n) - first[text]).astype(np.uint64)
    some = np.flatnonzero(np.diff(first))  # texts with units
    ways = lat.ways[lat.end[unit]]

    def noise(s: int, salt: int) -> np.ndarray:
        return keys[text] + (place + np.uint64(1)) * PLACE + np.array([2 * s + salt + 1], np.uint64) * BASE

    def before(log_p: np.ndarray) -> np.ndarray:
        """Log probability of all units of the text before each unit."""
        total = np.zeros(n)
        for a, z in zip(first[some].tolist(), first[some + 1].tolist()):
            np.cumsum(log_p[a : z - 1], out=total[a + 1 : z])
        return total

    def regions(log_p, s, bound):
        location = before(log_p) + np.where(ways > 1, np.log(np.maximum(-np.expm1(np.minimum(log_p, 0.0)), 1e-300)), -np.inf)
        return np.where(ways > 1, _below(location, bound[text], uniform(noise(s, 1), 0)), -np.inf)

    edges, start, log_p = lat.sample(unit, noise(0, 0))
    score = -np.log(-np.log(uniform(keys, 0)))
    leaves = [Leaf(edges, start, log_p, regions(log_p, 0, score))]
    there = np.ones(texts_n, bool)
    out = [(score, there)]
    ruled: dict[tuple[int, int], list[np.ndarray]] = {}  # (leaf, unit): what is ruled out there, if more than the leaf's own
    for s in range(1, k + 1):
        best, which = np.full(texts_n, -np.inf), np.zeros(texts_n, np.int64)
        for j, leaf in enumerate(leaves):
            if len(some):
                top = np.full(texts_n, -np.inf)
                top[some] = np.maximum.reduceat(leaf.after, first[some])
                which = np.where(top > best, j, which)
                best = np.maximum(best, top)
        if s == k:
            return data, lat, leaves, out, best, first
        there = np.isfinite(best)
        turn = np.full(texts_n, -1)  # the unit at which the new segmentation parts from its parent
        for j, leaf in enumerate(leaves):
            mine = np.flatnonzero(there[text] & (which[text] == j) & (leaf.after == best[text]))
            turn[text[mine][::-1]] = mine[::-1]
        log_p = np.zeros(n)
        fresh = (np.arange(n) > turn[text]) & there[text]
        drawn = np.flatnonzero(fresh)
        new_edges, new_start, log_p[drawn] = lat.sample(unit[drawn], noise(s, 0)[drawn])
        parts: dict[int, np.ndarray] = {}
        after_turn = np.full(texts_n, -np.inf)
        seeds = noise(s, 0)
        at = turn[there]
        out_there = [
            ruled.get((j, i)) or [leaves[j].edges[leaves[j].start[i] : leaves[j].start[i + 1]]] for i, j in zip(at.tolist(), which[there].tolist())
        ]
        paths, cut = lat.others(unit[at], out_there, seeds[at])
        for t, i, own, a, z in zip(np.flatnonzero(there).tolist(), at.tolist(), out_there, cut.tolist(), cut[1:].tolist()):
            parts[i] = path = paths[a:z]
            log_p[i] = lat.log_p[path].sum()
            ruled[s, i] = [*own, path]
            leaves[which[t]].after[i] = -np.inf
            if len(ruled[s, i]) < ways[i]:
                rest = 1.0 - sum(np.exp(lat.log_p[r].sum()) for r in ruled[s, i])
                after_turn[t] = np.log(max(rest, 1e-300))
        counts = np.zeros(n, np.int64)
        counts[drawn] = np.diff(new_start)
        old = np.flatnonzero((np.arange(n) < turn[text]) & there[text])
        for j, leaf in enumerate(leaves):
            own = old[which[text[old]] == j]
            counts[own], log_p[own] = np.diff(leaf.start)[own], leaf.log_p[own]
        for i, path in parts.items():
            counts[i] = len(path)
        start = np.concatenate([[0], np.cumsum(counts)])
        edges = np.empty(start[-1], np.int64)
        edges[_spread(start[drawn], counts[drawn])] = new_edges
        for j, leaf in enumerate(leaves):
            own = old[which[text[old]] == j]
            edges[_spread(start[own], counts[own])] = leaf.edges[_spread(leaf.start[own], counts[own])]
        for i, path in parts.items():
            edges[start[i] : start[i + 1]] = path
        after = np.where(fresh, regions(log_p, s, best), -np.inf)
        if len(at):
            after[at] = np.where(np.isfinite(after_turn[there]), _below(before(log_p)[at] + after_turn[there], best[there], uniform(noise(s, 1)[at], 0)), -np.inf)
        leaves.append(Leaf(edges, start, log_p, after))
        out.append((best, there))
    raise AssertionError


def _spread(start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All positions start, start + 1, ... of runs of ``counts``."""
    return np.repeat(start - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


FIELDS = {
    "sample": T.IntegerType(), "n_pieces": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "ids_xxh64": T.LongType(),
    "log_prob": T.DoubleType(), "inclusion": T.DoubleType(), "exact": T.BooleanType(),
}


def encoded(docs: DataFrame, p: Pieces, k: int = 2, seed: int = 42, key: str = "doc_id", fields: tuple[str, ...] = tuple(FIELDS), limit: int = 1 << 18) -> DataFrame:
    """``docs`` with one row for each of ``k`` distinct segmentations of its ``text``, sampled without replacement.

    Columns of ``docs`` that have a name among ``fields`` are replaced. sample: 1 to k by noisy score; fewer rows where a
    text has fewer segmentations. ids: its pieces. log_prob: its log probability among all segmentations of the
    text. inclusion: log of the probability that it is among the k, given the noisy score of the next one; 0 if there is none.
    exact: the ids decode to the text. ids_xxh64: XXH64 of the ids as little-endian int32. Null and empty texts have one row with no pieces. Rows with
    equal ``key`` (null: as empty text) and text get equal samples. The whole text is encoded. Texts of about ``limit``
    bytes are encoded at a time, with the same result.
    """
    kept = [c for c in docs.columns if c not in fields]
    carried = docs.select(*[f"`{c}`" for c in kept])
    schema = T.StructType([*carried.schema.fields, *[T.StructField(f, FIELDS[f]) for f in fields]])
    held = docs.sparkSession.sparkContext.broadcast(p._replace(text=p.text.to_pylist()))  # as long as the model file
    cache = {}

    def run(batches):
        p = held.value._replace(text=cache.setdefault("text", pa.array(held.value.text, pa.large_binary())))
        for batch in batches:
            for part in slices(batch, "text", limit):
                texts = part.column("text").cast(pa.large_binary()).fill_null(b"").to_pylist()
                data, lat, leaves, out, kappa, first = searched(texts, _seeds(part.column(key).to_pylist(), seed), k, p)
                wanted = np.frombuffer(data, np.uint8)
                for s, (leaf, (_, there)) in enumerate(zip(leaves, out)):
                    rows = np.flatnonzero(there)
                    if not len(rows):
                        continue
                    ids, start = lat.piece[leaf.edges].astype(np.int32), leaf.start[first]
                    log_p = np.bincount(np.repeat(np.arange(len(texts)), np.diff(first)), weights=leaf.log_p, minlength=len(texts))[rows]
                    with np.errstate(over="ignore", divide="ignore"):
                        x = log_p - kappa[rows]
                        inclusion = np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.minimum(x, 700)))))
                    at, size = start[rows], np.diff(start)[rows]
                    made = {
                        "sample": lambda: pa.array(np.full(len(rows), s + 1, np.int32)), "n_pieces": lambda: pa.array(size),
                        "ids": lambda: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(ids)),
                        "ids_xxh64": lambda: pa.array(np.array([xxhash.xxh64_intdigest(ids[a : a + c].tobytes()) for a, c in zip(at, size)], np.uint64).view(np.int64)),
                        "log_prob": lambda: pa.array(log_p), "inclusion": lambda: pa.array(inclusion),
                        "exact": lambda: pa.array(_same(ids, at, size, [texts[r] for r in rows], p.text)),
                    }
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(rows)) for c in kept), *(made[f]() for f in fields)], names=[*kept, *fields])

    return carried.mapInArrow(run, schema)


def _decoded(ids: np.ndarray, size: np.ndarray, text: pa.Array):
    """Bytes of all ids in a row, and where each text ends."""
    taken = text.take(pa.array(ids))
    off = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
    return bytes(taken.buffers()[2] or b"")[off[0] : off[-1]], (off - off[0])[np.append(0, np.cumsum(size))]


def _same(ids, at, size, texts, text) -> np.ndarray:
    data, cut = _decoded(ids, size, text)
    return np.array([data[a + 1 : z] == t if t else a == z for a, z, t in zip(cut.tolist(), cut[1:].tolist(), texts)], bool)


def decoded(encoded_rows: DataFrame, p: Pieces, column: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded_rows`` with the text of their ids. Null: null; no ids: empty. Ids outside the vocabulary fail."""
    kept = [c for c in encoded_rows.columns if c != name]
    carried = encoded_rows.select(*[f"`{c}`" for c in kept])
    schema = T.StructType([*carried.schema.fields, T.StructField(name, T.StringType())])
    surface = p.text.to_pylist()

    def run(batches):
        text = pa.array(surface, pa.large_binary())
        for batch in batches:
            lists = batch.column(column)
            size = np.array([0 if x is None else x for x in pc.list_value_length(lists).to_pylist()], np.int64)
            data, cut = _decoded(lists.flatten().to_numpy(zero_copy_only=False), size, text)
            texts = [data[a + 1 : z].decode(errors="replace") for a, z in zip(cut.tolist(), cut[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([t if v else None for t, v in zip(texts, lists.is_valid().to_pylist())], pa.string())], names=[*kept, name])

    return carried.mapInArrow(run, schema)
