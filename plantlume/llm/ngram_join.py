"""Near duplicates by an exact n-gram Jaccard join over count-vector R-trees.

A text is the set of its 5-word shingles, as 64-bit hashes. Shingles are hashed into groups, and
the counts per group make a text a point. Two sets share at most the sum, over the groups, of the
smaller counts; an R-tree over the points carries that bound upwards, since no point below a node
exceeds the node's upper corner. Pairs that survive are verified on the sets themselves.

One tree can't hold a corpus, so trees are built in two kinds of bounded neighbourhoods:

1. Texts sorted by range of their least shingle hash, in chunks: near copies fall together, most
   links are found, and each chunk's linked texts get one root.
2. Buckets of the prefix filter: order all shingles, those shared most widely last; two sets
   with similarity t have a common shingle among the first n - ceil(t n) + 1 of each. Only buckets
   with several roots are left after the first step, and trees over them find the pairs between
   different roots; small buckets are resolved into pairs, and each pair is bounded once. A first
   round verifies the likeliest pair of any two roots, a second all others between roots that are
   still apart, so no link between different components can be missed.

Both are exact; the order of the shingles and the chunks only affect speed.

That gives components (``near_groups``) and skips pairs which can't change them. ``near_pairs`` gives
the links themselves: every pair of different texts that the bound allows is verified, inside chunks
on the sets at hand and from the prefix buckets for texts of different chunks.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import release
from .common import SPACES, Batches, arrow_map, arrow_type, row_numbers, stored
from .components import connected

WORDS = 5
PERCENT = 75
GROUPS = 64  # of the trees over chunks, where a set is at hand to verify
FINE_GROUPS = 512  # of the points in prefix buckets, whose pairs must fetch their texts to be verified, and of pairs that trees leave
FINEST_GROUPS, LARGE_SET = 4096, 2048  # where both sets have as many shingles
LEAF = 16
CHUNK_TEXTS, CHUNK_BYTES = 4096, 24 << 20
HEAVY_FROM, HEAVY_MOST = 20, 1_000_000  # widely shared shingles known to all tasks: 8 MB at most
PIECE, LONG_WORD = 64 << 10, 64
BUCKET_ROWS = 8192
SMALL = 12  # rows of a bucket that is resolved into pairs at once

_B = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_B), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


_IS_SPACE = np.isin(np.arange(256), np.frombuffer(SPACES, np.uint8))


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of texts.

    The hash of a word is a polynomial of its bytes, taken from running sums over pieces of
    ``PIECE`` bytes; words longer than ``LONG_WORD`` are hashed one by one.
    """

    def __init__(self, words: int = WORDS):
        self.words = words
        self.up, self.down = (np.cumprod(np.full(PIECE + LONG_WORD, base)) for base in (_B, _INV))

    def _word_hashes(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        cuts = np.searchsorted(starts, np.arange(0, len(raw) + PIECE, PIECE))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            lo = starts[a]
            first, last = starts[a:b] - lo, np.minimum(ends[a:b] - lo, PIECE + LONG_WORD)
            total = np.zeros(last[-1] + 1, np.uint64)
            np.cumsum((raw[lo : lo + last[-1]] + np.uint64(1)) * self.up[: last[-1]], out=total[1:])
            out[a:b] = (total[last] - total[first]) * self.down[first]
        out = mix64(out)
        for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
            out[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : ends[k]])
        return out

    def __call__(self, texts: list[bytes | None]) -> list[np.ndarray]:
        k = self.words
        joined = b"\n".join([b"", *(t or b"" for t in texts), b""]).lower()  # bytes: A-Z only
        raw = np.frombuffer(joined, np.uint8)
        turns = np.flatnonzero(np.diff(_IS_SPACE[raw])) + 1  # begins and ends with a space
        starts, stops = turns[::2], turns[1::2]
        hashes = self._word_hashes(raw, starts, stops)
        sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
        ends = np.searchsorted(starts, np.cumsum(sizes))
        counts = np.diff(ends, prepend=0)
        rolled = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
        for i in range(k):
            rolled = rolled * _B + hashes[i : i + len(rolled)]
        rolled = mix64(rolled)
        out = []
        for n, end in zip(counts.tolist(), ends.tolist()):
            if n >= k:
                s = np.sort(rolled[end - n : end - k + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif n:
                h = np.uint64(n)
                with np.errstate(over="ignore"):
                    for x in hashes[end - n : end]:
                        h = h * _B + x
                out.append(mix64(np.array([h], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
        return out


def counts_of(s: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Shingles per group in a byte each; a set too large for that is the largest point, which prunes nothing."""
    c = np.bincount((s >> np.uint64(64 - groups.bit_length() + 1)).astype(np.int64), minlength=groups)
    return c.astype(np.uint8) if c.max(initial=0) < 256 else np.full(groups, 255, np.uint8)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


class Tree:
    """R-tree over count vectors, packed in the given order; only upper corners are needed."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.levels = []
        level, small, large = points, sizes, sizes
        while len(level) > LEAF:
            cuts = np.arange(0, len(level), LEAF)
            level, small, large = (np.maximum.reduceat(level, cuts, axis=0), np.minimum.reduceat(small, cuts), np.maximum.reduceat(large, cuts))
            self.levels.append((level, small, large))

    def pairs(self, lo: int, hi: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (i, j) with lo <= i < hi and j < i whose bound allows the similarity; and that bound."""
        q = np.arange(lo, hi)
        i, node = q, np.zeros(len(q), np.int64)
        i, node = self._children(i, node, len(self.levels))
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, small, large = self.levels[depth]
            first = node * LEAF ** (depth + 1)
            n = self.sizes[i]
            ok = (first < i) & (100 * large[node] >= percent * n) & (percent * small[node] <= 100 * n)
            i, node = i[ok], node[ok]
            bound = _bounds(self.points, i, corner, node)
            # the other set has at least percent/100 of n shingles, so that much must be shared
            ok = 100 * bound >= percent * self.sizes[i]
            i, node = self._children(i[ok], node[ok], depth)
        ok = node < i
        i, node = i[ok], node[ok]
        a, b = self.sizes[i], self.sizes[node]
        ok = (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
        i, node = i[ok], node[ok]
        bound = _bounds(self.points, i, self.points, node)
        ok = (100 + percent) * bound >= percent * (self.sizes[i] + self.sizes[node])
        return i[ok], node[ok], bound[ok]

    def _children(self, i: np.ndarray, node: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries below the nodes; ``depth`` 0 gives points, ``len(levels)`` starts at the top."""
        below = len(self.points) if depth == 0 else len(self.levels[depth - 1][0])
        fan = below if depth == len(self.levels) else LEAF
        kids = (node[:, None] * LEAF + np.arange(fan)).ravel() if depth < len(self.levels) else np.tile(np.arange(fan), len(node))
        i = np.repeat(i, fan)
        ok = kids < below
        return i[ok], kids[ok]


def _bounds(points: np.ndarray, i: np.ndarray, corners: np.ndarray, j: np.ndarray, step: int = 8192) -> np.ndarray:
    out = np.empty(len(i), np.int64)
    for s in range(0, len(i), step):
        out[s : s + step] = np.minimum(points[i[s : s + step]], corners[j[s : s + step]]).sum(1, dtype=np.uint32)
    out[out == 255 * points.shape[1]] = 1 << 40  # two sets too large for the counters
    return out


class Refined:
    """Bounds of pairs that a tree has left, from the counts of more groups; large sets need the most."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, fine: np.ndarray, percent: int):
        self.sizes, self.fine, self.percent = sizes, fine, percent
        large = np.flatnonzero(sizes >= LARGE_SET)
        self.place = np.full(len(sets), -1)
        self.place[large] = np.arange(len(large))
        self.finest = np.array([counts_of(sets[k], FINEST_GROUPS) for k in large.tolist()]).reshape(len(large), FINEST_GROUPS)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bound = _bounds(self.fine, i, self.fine, j)
        i, j, bound = self._allowed(i, j, bound)
        both = np.flatnonzero((self.place[i] >= 0) & (self.place[j] >= 0))
        if len(both):
            finer = _bounds(self.finest, self.place[i[both]], self.finest, self.place[j[both]], 1024)
            bound[both] = np.minimum(bound[both], finer)
            i, j, bound = self._allowed(i, j, bound)
        return i, j, bound

    def _allowed(self, i, j, bound):
        ok = (100 + self.percent) * bound >= self.percent * (self.sizes[i] + self.sizes[j])
        return i[ok], j[ok], bound[ok]


def link_chunk(sets: list[np.ndarray], points: np.ndarray, fine: np.ndarray, percent: int, block: int = 64) -> np.ndarray:
    """Root (least place) of every set of a chunk: linked pairs are joined, joined pairs not verified again.

    ``points`` make the tree, the counts ``fine`` of ``FINE_GROUPS`` groups bound the pairs it leaves.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    tree, label, refined = Tree(points, sizes), np.arange(m), Refined(sets, sizes, fine, percent)
    for lo in range(0, m, block):
        i, j, _ = tree.pairs(lo, min(lo + block, m), percent)
        ok = label[i] != label[j]
        i, j, bound = refined(i[ok], j[ok])
        order = np.lexsort((-bound, i))  # the likeliest partner of each set first
        i, j = i[order], j[order]
        cuts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else ()
        for k, others in zip(cuts, np.split(j, cuts[1:]) if len(i) else ()):
            a = int(i[k])
            others = others[label[others] != label[a]]
            while len(others):
                b, others = int(others[0]), others[1:]
                if similar(sets[a], sets[b], percent):
                    least, most = sorted((label[a], label[b]))
                    label[label == most] = least
                    others = others[label[others] != least]
    return label


def shared_with(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many shingles a set shares with each of others; none is empty."""
    out = []
    for at in range(0, len(others), 512):
        some = others[at : at + 512]
        flat = np.concatenate(some)
        hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
        starts = np.cumsum([0, *(len(s) for s in some[:-1])])
        out.append(np.add.reduceat(hit, starts, dtype=np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)


# ---- 1. sets, and links inside chunks -------------------------------------------------------

_SETS = "row long, n long, node long, check long, place long, text string"


def _sets(batches: Batches, schema: pa.Schema, words: int) -> Batches:
    """Size and digest of every text; the text itself goes on once per task and digest."""
    shingle, seen, at = Shingler(words), set(), 0
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            sets = shingle(part.column("text").cast(pa.binary()).to_pylist())
            n, node, check, place, first = [], [], [], [], []
            for s in sets:
                n.append(len(s))
                d = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                node.append(int.from_bytes(d[:8], "little", signed=True) if d else None)
                check.append(int.from_bytes(d[8:], "little", signed=True) if d else None)
                place.append(int(mix64(s ^ _M2).min() >> np.uint64(1)) if d else None)
                first.append(bool(d) and d not in seen)
                if d:
                    seen.add(d)
            if len(seen) > 500_000:
                seen.clear()
            text = part.column("text").take(pa.array([i if f else None for i, f in enumerate(first)], pa.int64()))
            rows = row_numbers(at, part.num_rows)
            at += part.num_rows
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(rows, pa.int64()), pa.array(n, pa.int64()), pa.array(node, pa.int64()),
                 pa.array(check, pa.int64()), pa.array(place, pa.int64()), text],
                schema=schema,
            )


_ROOTS = "node long, check long, idx long, root long, n long, counts binary, text string, shared array<long>, shared_roots array<long>"


def _chunks(batches: Batches, words: int):
    """Number of texts before, digests, texts and sets of each chunk of distinct texts."""
    shingle, made, last = Shingler(words), 0, None
    nodes, checks, texts, sets, held = [], [], [], [], 0
    for batch in batches:
        part_nodes, part_checks = batch.column("node").to_pylist(), batch.column("check").to_pylist()
        part_texts = batch.column("text").to_pylist()
        pick = []
        for i, key in enumerate(zip(part_nodes, part_checks)):
            if key != last:  # sorted: the same digest from several tasks stands together
                pick.append(i)
            last = key
        for at in range(0, len(pick), 500):
            some = pick[at : at + 500]
            for i, s in zip(some, shingle([part_texts[i].encode() for i in some])):
                nodes.append(part_nodes[i])
                checks.append(part_checks[i])
                texts.append(part_texts[i])
                sets.append(s)
                held += len(part_texts[i])
                if len(sets) >= CHUNK_TEXTS or held >= CHUNK_BYTES:
                    yield made, nodes, checks, texts, sets
                    made += len(sets)
                    nodes, checks, texts, sets, held = [], [], [], [], 0
    if sets:
        yield made, nodes, checks, texts, sets


def _by_size(sizes: np.ndarray) -> np.ndarray:
    """Neighbours in size and, among those, in the order of the least hashes share a leaf."""
    return np.argsort(np.floor(np.log(sizes) / np.log(1.15)), kind="stable")


def _shared(sets: list[np.ndarray], owner: np.ndarray, sizes: np.ndarray) -> tuple[list[int], list[int]]:
    """Shingles that different owners of this chunk share, and in how many texts."""
    flat = np.concatenate(sets)
    owner = np.repeat(owner, sizes)
    order = np.argsort(flat)
    flat, owner = flat[order], owner[order]
    cuts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    many = np.minimum.reduceat(owner, cuts) != np.maximum.reduceat(owner, cuts)
    roots = np.diff(np.append(cuts, len(flat)))
    return flat[cuts[many]].view(np.int64).tolist(), roots[many].tolist()


def _roots(batches: Batches, schema: pa.Schema, words: int, percent: int) -> Batches:
    """Chunks of distinct texts with their root, and which shingles several roots of the chunk share."""
    for made, nodes, checks, texts, sets in _chunks(batches, words):
        sizes = np.array([len(s) for s in sets])
        by_size = _by_size(sizes)
        place = np.empty_like(by_size)
        place[by_size] = np.arange(len(sets))
        points = np.array([counts_of(s, FINE_GROUPS) for s in sets])
        coarse = np.array([counts_of(sets[k]) for k in by_size])
        label = link_chunk([sets[k] for k in by_size], coarse, points[by_size], percent)
        parent = by_size[label][place]
        idx = np.array(row_numbers(made, len(sets)), np.int64)
        shared, roots = _shared(sets, parent, sizes)
        empty = [None] * (len(sets) - 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), pa.array(idx), pa.array(idx[parent]),
             pa.array(sizes, pa.int64()), pa.array([p.tobytes() for p in points], pa.binary()), pa.array(texts, pa.string()),
             pa.array([shared, *empty], pa.list_(pa.int64())), pa.array([roots, *empty], pa.list_(pa.int64()))],
            schema=schema,
        )


_TEXTS = f"{_ROOTS}, near array<long>, near_shared array<long>"


def _linked(batches: Batches, schema: pa.Schema, words: int, percent: int, block: int = 64) -> Batches:
    """Distinct texts with all their links to earlier texts of their chunk; ``root`` stands for the chunk."""
    for made, nodes, checks, texts, sets in _chunks(batches, words):
        order = _by_size(np.array([len(s) for s in sets])).tolist()
        nodes, checks, texts, sets = ([x[k] for k in order] for x in (nodes, checks, texts, sets))
        sizes = np.array([len(s) for s in sets], np.int64)
        fine = np.array([counts_of(s, FINE_GROUPS) for s in sets])
        tree, refined = Tree(np.array([counts_of(s) for s in sets]), sizes), Refined(sets, sizes, fine, percent)
        idx = np.array(row_numbers(made, len(sets)), np.int64)
        lists = [*_shared(sets, np.arange(len(sets)), sizes)]
        for lo in range(0, len(sets), block):
            hi = min(lo + block, len(sets))
            i, j, _ = refined(*tree.pairs(lo, hi, percent)[:2])
            near, near_shared = [], []
            for a in range(lo, hi):
                others = j[i == a]
                shared = shared_with(sets[a], [sets[b] for b in others])
                ok = 100 * shared >= percent * (sizes[a] + sizes[others] - shared)
                near.append(idx[others[ok]].tolist())
                near_shared.append(shared[ok].tolist())
            first = [[x, *[None] * (hi - lo - 1)] for x in lists]
            lists = [None, None]
            columns = [
                nodes[lo:hi], checks[lo:hi], idx[lo:hi], np.full(hi - lo, idx[0]), sizes[lo:hi],
                [c.tobytes() for c in fine[lo:hi]], texts[lo:hi], *first, near, near_shared,
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


# ---- 2. prefix buckets ----------------------------------------------------------------------

_PREFIX = "hash long, idx long, root long"


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _prefixes(batches: Batches, schema: pa.Schema, heavy, words: int, percent: int) -> Batches:
    shingle, common = Shingler(words), heavy.value
    bits = np.zeros(1 << 22, bool)
    bits[common >> np.uint64(42)] = True
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            idx, root = (part.column(c).to_numpy() for c in ("idx", "root"))
            hashes, lengths = [], []
            for s in shingle(part.column("text").cast(pa.binary()).to_pylist()):
                p = prefix_length(len(s), percent)
                wide = np.flatnonzero(bits[s >> np.uint64(42)])
                if len(wide):
                    wide = wide[common[np.minimum(np.searchsorted(common, s[wide]), len(common) - 1)] == s[wide]]
                if len(wide):
                    rare = np.ones(len(s), bool)
                    rare[wide] = False
                    s = np.concatenate([s[rare], s[wide]])
                hashes.append(s[:p] >> np.uint64(16))
                lengths.append(len(hashes[-1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.repeat(idx, lengths)), pa.array(np.repeat(root, lengths))],
                schema=schema,
            )


_CROSSING = "hash long, idx long, root long, other long, other_root long"


def _crossing(batches: Batches, schema: pa.Schema) -> Batches:
    """From rows sorted by hash, what several roots share.

    A bucket of at most ``SMALL`` rows gives its pairs of different roots (``idx`` and ``other``);
    the rows of a larger one, or of one that runs over batches, go on as they are.
    """
    waiting: list[tuple[np.ndarray, np.ndarray]] = []  # rows of the last hash, as long as it has one root
    open_hash, open_root, crossed = None, None, False

    def out(h, i, r, other=None, other_root=None):
        columns = [pa.array(h), pa.array(i), pa.array(r)]
        columns += [pa.nulls(len(i), pa.int64()) if x is None else pa.array(x) for x in (other, other_root)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        h, i, r = (batch.column(c).to_numpy() for c in ("hash", "idx", "root"))
        cuts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        ends = np.append(cuts[1:], len(h))
        several = np.minimum.reduceat(r, cuts) != np.maximum.reduceat(r, cuts)
        if h[0] == open_hash:
            several[0] |= crossed or r[0] != open_root
            if several[0] and waiting:
                wi, wr = (np.concatenate(x) for x in zip(*waiting))
                yield out(np.full(len(wi), open_hash), wi, wr)
                waiting = []
        else:
            waiting = []
        inner = ends - cuts <= SMALL
        inner[[0, -1]] = False
        keep = np.repeat(several & ~inner, ends - cuts)
        if keep.any():
            yield out(h[keep], i[keep], r[keep])
        keep = np.repeat(several & inner, ends - cuts)
        if keep.any():
            hs, idx, root = h[keep], i[keep], r[keep]
            for d in range(1, SMALL):
                at = np.flatnonzero(hs[d:] == hs[:-d]) + d
                if not len(at):
                    break
                at = at[root[at] != root[at - d]]
                swap = root[at] > root[at - d]
                a, b = np.where(swap, at - d, at), np.where(swap, at, at - d)
                yield out(np.zeros(len(a), np.int64), idx[a], root[a], idx[b], root[b])
        if len(cuts) > 1 or h[0] != open_hash:
            waiting = []
        if not several[-1]:
            waiting.append((i[cuts[-1] :], r[cuts[-1] :]))
        open_hash, open_root, crossed = h[-1], r[-1], bool(several[-1])


_PAIRS = "a long, b long, root_a long, root_b long, rank long"


def _bounded_pairs(batches: Batches, schema: pa.Schema, percent: int) -> Batches:
    """Of single pairs with the facts of both sides, those that the bound allows."""
    for batch in batches:
        one, two = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, FINE_GROUPS) for c in ("counts_a", "counts_b")
        )
        n, m = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
        at = np.arange(batch.num_rows)
        bound = _bounds(one, at, two, at)
        ok = ((100 + percent) * bound >= percent * (n + m)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
        part = batch.filter(pa.array(ok))
        rank = bound[ok] * 2_000_000 // (n + m)[ok]
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("a", "b", "root_a", "root_b")), pa.array(rank)], schema=schema)


def _bucket_pairs(batches: Batches, schema: pa.Schema, percent: int, best_only: bool) -> Batches:
    """Pairs of different roots in each bucket (rows sorted by hash, then size) that the bound allows.

    Buckets are cut at ``BUCKET_ROWS`` rows; since rows come by size, the next cut begins with all
    earlier rows that are large enough to be similar to one of its own. ``rank`` tells likelier
    pairs; with ``best_only`` the likeliest of any two roots stands for the others.
    """
    every: dict[tuple[int, int], tuple[int, int, int]] = {}  # by the two texts
    best: dict[tuple[int, int], tuple[int, int, int]] = {}  # by the two roots

    def take(rows, i, j, bound) -> None:
        idx, root, n, _ = rows
        ok = root[i] != root[j]
        i, j, bound = i[ok], j[ok], bound[ok]
        swap = root[i] > root[j]
        a, b = np.where(swap, j, i), np.where(swap, i, j)
        rank = bound * 2_000_000 // (n[a] + n[b])
        if not best_only:
            every.update(zip(zip(idx[a].tolist(), idx[b].tolist()), zip(root[a].tolist(), root[b].tolist(), rank.tolist())))
            return
        order = np.lexsort((-rank, root[b], root[a]))
        a, b, rank = a[order], b[order], rank[order]
        first = np.flatnonzero(np.concatenate([[True], (root[a][1:] != root[a][:-1]) | (root[b][1:] != root[b][:-1])])) if len(a) else []
        for k in first:
            key = (int(root[a[k]]), int(root[b[k]]))
            if key not in best or best[key][2] < rank[k]:
                best[key] = (int(idx[a[k]]), int(idx[b[k]]), int(rank[k]))

    def near(rows, fresh: int) -> None:
        """Pairs within one bucket whose later row is at ``fresh`` or behind."""
        tree = Tree(rows[3], rows[2])
        for lo in range(fresh, len(rows[0]), 64):
            take(rows, *tree.pairs(lo, min(lo + 64, len(rows[0])), percent))

    def emit() -> pa.RecordBatch:
        rows = [(*pair, *more) for pair, more in every.items()] + [(a, b, *roots, rank) for roots, (a, b, rank) in best.items()]
        every.clear()
        best.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)], schema=schema)

    held, held_hash, kept = None, None, 0  # rows of the bucket at the end of the batch, and how many of them were joined
    for batch in batches:
        if not batch.num_rows:
            continue
        h = batch.column("hash").to_numpy()
        points = np.frombuffer(b"".join(batch.column("counts").to_pylist()), np.uint8).reshape(len(h), FINE_GROUPS)
        rows = (*(batch.column(c).to_numpy() for c in ("idx", "root", "n")), points)
        cuts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        ends = np.append(cuts[1:], len(h))
        start = 0  # of the groups that are complete in this batch
        if held is not None:
            if h[0] == held_hash:
                held, start = _stack([held, tuple(c[: ends[0]] for c in rows)]), 1
            if len(cuts) > start or h[0] != held_hash:
                near(held, kept)
                held, kept = None, 0
        if len(cuts) > start:
            held, held_hash = tuple(c[cuts[-1] :] for c in rows), h[-1]
            for k in range(start, len(cuts) - 1):
                near(tuple(c[cuts[k] : ends[k]] for c in rows), 0)
        if len(held[0]) - kept > BUCKET_ROWS:
            near(held, kept)
            held = tuple(c[100 * held[2] >= percent * held[2][-1]] for c in held)
            kept = len(held[0])
        if len(every) + len(best) > 100_000:
            yield emit()
    if held is not None:
        near(held, kept)
    yield emit()


def _stack(parts: list[tuple]) -> tuple:
    return tuple(np.concatenate(c) for c in zip(*parts))


def _verify(batches: Batches, schema: pa.Schema, words: int, percent: int) -> Batches:
    shingle = Shingler(words)
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            one, two = (shingle(part.column(c).cast(pa.binary()).to_pylist()) for c in ("text_a", "text_b"))
            ok = pa.array([similar(x, y, percent) for x, y in zip(one, two)], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column("root_a").filter(ok), part.column("root_b").filter(ok)], schema=schema)


def _verify_pairs(batches: Batches, schema: pa.Schema, words: int, percent: int) -> Batches:
    shingle = Shingler(words)
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            one, two = (shingle(part.column(c).cast(pa.binary()).to_pylist()) for c in ("text_a", "text_b"))
            shared = np.array([shared_with(x, [y])[0] for x, y in zip(one, two)])
            union = np.array([len(x) + len(y) for x, y in zip(one, two)]) - shared
            part = pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(shared)], schema=schema)
            yield part.filter(pa.array(100 * shared >= percent * union))


def _arrow(ddl: str, lead: list[T.StructField] = ()) -> tuple[T.StructType, pa.Schema]:
    kind = T.StructType([*lead, *T._parse_datatype_string(ddl).fields])
    return kind, pa.schema([pa.field(f.name, arrow_type(f.dataType)) for f in kind.fields])


def _prefixed(roots: DataFrame, words: int, percent: int) -> DataFrame:
    """Prefix shingles of all texts, those shared most widely last: ``hash, idx, root``."""
    spark = roots.sparkSession
    shared = (
        roots.where(F.size("shared") > 0)
        .select(F.explode(F.arrays_zip("shared", "shared_roots")).alias("s"))
        .groupBy(F.col("s.shared").alias("hash"))
        .agg(F.sum("s.shared_roots").alias("n"))
        .where(F.col("n") >= HEAVY_FROM)
        .orderBy(F.col("n").desc(), "hash")
        .limit(HEAVY_MOST)
    )
    heavy = np.sort(np.array(shared.select("hash").toPandas()["hash"], np.int64).view(np.uint64))
    if not len(heavy):
        heavy = np.array([np.iinfo(np.uint64).max], np.uint64)
    kind, schema = _arrow(_PREFIX)
    prefix = partial(_prefixes, schema=schema, heavy=spark.sparkContext.broadcast(heavy), words=words, percent=percent)
    return arrow_map(roots.select("idx", "root", "text"), prefix, kind)


def _shared_by_roots(rows: DataFrame) -> DataFrame:
    kind, schema = _arrow(_CROSSING)
    laid = rows.repartition("hash").sortWithinPartitions("hash")
    return stored(arrow_map(laid, partial(_crossing, schema=schema), kind), "crossing")


def _allowed(crossing: DataFrame, facts: DataFrame, percent: int, best_only: bool) -> DataFrame:
    """Pairs of texts of different roots that the bound allows."""
    pair_kind, pair_schema = _arrow(_PAIRS)
    alone = crossing.where(F.col("other").isNotNull()).select(
        F.col("idx").alias("a"), F.col("other").alias("b"), F.col("root").alias("root_a"), F.col("other_root").alias("root_b")
    ).distinct()
    for side in ("a", "b"):
        of = facts.select(F.col("idx").alias(side), F.col("n").alias(f"n_{side}"), F.col("counts").alias(f"counts_{side}"))
        alone = alone.join(of, side)
    laid = crossing.where(F.col("other").isNull()).select("hash", "idx", "root").join(facts, "idx")
    laid = laid.repartition("hash").sortWithinPartitions("hash", "n", "idx")
    single = arrow_map(alone, partial(_bounded_pairs, schema=pair_schema, percent=percent), pair_kind)
    of_buckets = arrow_map(laid, partial(_bucket_pairs, schema=pair_schema, percent=percent, best_only=best_only), pair_kind)
    return stored(single.unionByName(of_buckets).dropDuplicates(["a", "b"]), "near-pairs")


def _with_texts(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    texts = roots.select(F.col("idx").alias("of"), "text")
    return (
        pairs.join(texts.withColumnRenamed("text", "text_a"), F.col("a") == F.col("of")).drop("of")
        .join(texts.withColumnRenamed("text", "text_b"), F.col("b") == F.col("of")).drop("of")
    )


def _links(roots: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between roots of different chunks, found in prefix buckets: ``a, b``."""
    facts = roots.select("idx", "n", "counts")
    crossing = _shared_by_roots(_prefixed(roots, words, percent))
    pairs = _allowed(crossing, facts, percent, True)
    link_kind, link_schema = _arrow("a long, b long")

    def verified(some: DataFrame) -> DataFrame:
        linked = arrow_map(
            _with_texts(some, roots).select("root_a", "root_b", "text_a", "text_b"),
            partial(_verify, schema=link_schema, words=words, percent=percent), link_kind,
        )
        return stored(linked, "near-links")

    likeliest = pairs.groupBy("root_a", "root_b").agg(F.max_by(F.struct("a", "b"), F.struct("rank", "a", "b")).alias("p"))
    chosen = stored(likeliest.select(F.col("p.a").alias("a"), F.col("p.b").alias("b"), "root_a", "root_b"), "near-chosen")
    first = verified(chosen)
    labels = stored(connected(first), "near-labels")
    rest = pairs.join(chosen.select("a", "b"), ["a", "b"], "left_anti").drop("rank")
    for side in ("a", "b"):
        named = labels.select(F.col("id").alias(f"root_{side}"), F.col("label").alias(f"label_{side}"))
        rest = rest.join(named, f"root_{side}", "left").withColumn(f"label_{side}", F.coalesce(f"label_{side}", f"root_{side}"))
    rest = rest.select("a", "b", F.col("label_a").alias("root_a"), F.col("label_b").alias("root_b"))
    large = crossing.where(F.col("other").isNull()).join(labels.select(F.col("id").alias("root"), "label"), "root", "left")
    still = _shared_by_roots(large.select("hash", "idx", F.coalesce("label", "root").alias("root")))
    more = _allowed(still, facts, percent, False)
    release(crossing, still)
    rest = rest.unionByName(more.drop("rank")).where(F.col("root_a") != F.col("root_b")).dropDuplicates(["a", "b"])
    second = verified(rest)
    release(pairs, chosen, labels, more)
    return first.unionByName(second)


def _placed(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """Size and digest of every row, and the texts in the order of their least hashes."""
    kind, schema = _arrow(_SETS, [T.StructField("doc_id", docs.schema["doc_id"].dataType)])
    sets = stored(arrow_map(docs.select("doc_id", "text"), partial(_sets, schema=schema, words=words), kind), "near-sets")
    placed = (
        sets.where(F.col("text").isNotNull()).select("node", "check", "place", "text")
        .repartitionByRange(F.col("place"), F.col("node")).sortWithinPartitions("place", "node", "check")
    )
    return sets, placed.drop("place")


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Component of every row of ``docs`` (``doc_id``, ``text``): ``doc_id, n_shingles, component_id, row, keep_row``.

    Words are split at ASCII white space, A-Z in lower case; a text of fewer than ``words`` words is
    one shingle, one without words is empty and linked with nothing. Texts link if they share
    ``percent`` of their united shingles. ``component_id`` is the smallest ``doc_id`` reachable,
    nulls aside; ``keep_row`` is the number of the first row with it. Repeated rows link to each
    other. No rows give no rows; other columns are ignored.
    """
    sets, placed = _placed(docs, words)
    root_kind, root_schema = _arrow(_ROOTS)
    roots = stored(arrow_map(placed, partial(_roots, schema=root_schema, words=words, percent=percent), root_kind), "near-roots")
    digests = stored(sets.select("doc_id", "row", "n", "node", "check"), "near-digests")
    release(sets)  # its texts are in the roots
    labels = connected(_links(roots, words, percent))
    labelled = stored(
        roots.select("node", "check", "root").join(labels.select(F.col("id").alias("root"), "label"), "root", "left")
        .select("node", "check", F.coalesce("label", "root").alias("label")),
        "near-labelled",
    )
    release(roots)
    rows = stored(digests.join(labelled, ["node", "check"], "left").select("doc_id", "row", "n", "label"), "near-rows")
    release(digests, labelled)
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    groups = stored(rows.where(F.col("label").isNotNull()).groupBy("label").agg(F.min(first).alias("first")), "near-groups")
    own = F.col("label").isNull()
    return rows.join(groups, "label", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(own, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        "row", F.when(own, F.col("row")).otherwise(F.col("first.row")).alias("keep_row"),
    )


def deduplicate_near(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with all columns, one row of each component: that with the smallest ``doc_id``."""
    numbered = stored(docs.withColumn("__near", F.monotonically_increasing_id()), "near-input")
    found = near_groups(numbered.select(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__near").alias("doc_id"), "text"), words, percent)
    kept = found.where(F.col("row") == F.col("keep_row")).select(F.col("doc_id.__near").alias("__near"))
    return numbered.join(kept, "__near", "left_semi").select(*docs.columns)


def near_pairs(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Every link between different texts, and which rows have them.

    Texts with the same shingles are one text. The first table, ``doc_id, row, n_shingles, text_id``,
    has every row of ``docs`` (``text_id`` is null without words), the second, ``text_a, text_b,
    shared, n_a, n_b``, every pair of texts that share ``percent`` of their united shingles, once
    and with ``text_a < text_b``. Rows of one ``text_id`` are linked too and not listed.
    """
    sets, placed = _placed(docs, words)
    kind, schema = _arrow(_TEXTS)
    texts = stored(arrow_map(placed, partial(_linked, schema=schema, words=words, percent=percent), kind), "near-texts")
    inside = texts.where(F.size("near") > 0).select(F.col("idx").alias("b"), F.explode(F.arrays_zip("near", "near_shared")).alias("p"))
    inside = inside.select(F.col("p.near").alias("a"), "b", F.col("p.near_shared").alias("shared"))
    pairs = _allowed(_shared_by_roots(_prefixed(texts, words, percent)), texts.select("idx", "n", "counts"), percent, False)
    kind, schema = _arrow("a long, b long, shared long")
    across = arrow_map(
        _with_texts(pairs.select("a", "b"), texts).select("a", "b", "text_a", "text_b"),
        partial(_verify_pairs, schema=schema, words=words, percent=percent), kind,
    )
    found = inside.unionByName(across).select(F.least("a", "b").alias("text_a"), F.greatest("a", "b").alias("text_b"), "shared")
    for side in ("a", "b"):
        found = found.join(texts.select(F.col("idx").alias(f"text_{side}"), F.col("n").alias(f"n_{side}")), f"text_{side}")
    members = sets.select("doc_id", "row", F.col("n").alias("n_shingles"), "node", "check").join(
        texts.select("node", "check", F.col("idx").alias("text_id")), ["node", "check"], "left"
    )
    return (
        members.select("doc_id", "row", "n_shingles", "text_id"),
        stored(found.select("text_a", "text_b", "shared", "n_a", "n_b"), "near-all-links"),
    )


def link_counts(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, n_texts, n_links`` of every row: linked other texts, and linked other rows, copies included."""
    members, pairs = near_pairs(docs, words, percent)
    members = stored(members, "near-members")
    copies = members.where(F.col("text_id").isNotNull()).groupBy("text_id").agg(F.count(F.lit(1)).alias("copies"))
    both = pairs.select(F.col("text_a").alias("text_id"), F.col("text_b").alias("other")).unionByName(
        pairs.select(F.col("text_b").alias("text_id"), F.col("text_a").alias("other"))
    )
    of_text = both.join(copies.withColumnRenamed("text_id", "other"), "other").groupBy("text_id").agg(
        F.count(F.lit(1)).alias("n_texts"), F.sum("copies").alias("rows")
    )
    none = F.lit(0).cast("long")
    return members.join(copies, "text_id", "left").join(of_text, "text_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("n_texts", none).alias("n_texts"),
        (F.coalesce("rows", none) + F.coalesce(F.col("copies") - 1, none)).alias("n_links"),
    )
