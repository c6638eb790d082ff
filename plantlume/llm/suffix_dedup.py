"""Removal of repeated passages with suffix order and longest-previous-factor arrays.

A passage counts as repeated if a string of ``length`` bytes occurs elsewhere. One suffix array
over a corpus can't be split, so the corpus is first dealt into neighbourhoods that hold all
occurrences of a string together:

* Every window of ``length`` bytes has an anchor, the least hash among its ``GRAM``-byte strings.
  Equal windows have equal anchors, at the same place in them. Neighbouring windows with one
  anchor form a run.
* Runs are grouped by anchor. Runs with equal bytes are repeated whole and stand for each other;
  anchors with one run are done.
* Anchors with several different runs go on with the first run of each kind: these are laid end to end, put
  into suffix order by prefix doubling, and the nearest smaller and greater positions on both
  sides of a suffix give its longest previous and longest next factor. A window whose factor
  reaches ``length`` occurs before, or behind.
* Anchors with very many different runs are not put into one suffix order: their runs are cut into pieces by
  the distance to the anchor, and hashes of pieces, then of the windows of pieces still in doubt, are counted.

Groups meet by a shuffle on the anchor. Which runs go on is told to the second scan by a bit table
of fixed size; a bit set by chance costs a few rows and changes nothing.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import release
from .common import Batches, arrow_map, arrow_type, stored

LENGTH = 200
GRAM = 32
SCAN_BYTES = 128 << 10  # arrays of a scan stay in the processor's cache
SUFFIX_BYTES = 128 << 10
FILTER_BITS = 26  # 8 MB, whatever the input

_B = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INV = pow(_B, -1, 1 << 64)


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out, filled = np.ones(n, np.uint64), 1
    while filled < n:
        step = np.uint64(pow(base, filled, 1 << 64))
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * step
        filled += more
    return out


class Anchors:
    """Runs of windows with one anchor, for many texts at once."""

    def __init__(self, length: int, gram: int = GRAM):
        self.length, self.gram = length, min(gram, length)
        self.up = self.down = self.total = np.ones(0, np.uint64)

    def hash_of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes from ``begin`` to before ``end`` of the texts that ``runs`` had last."""
        return (self.total[end] - self.total[begin]) * self.down[begin]

    def runs(self, texts: list[bytes]):
        """Arrays (text, anchor, print, first window, last window, place of the anchor), a run each.

        ``print`` is a hash of the run's bytes and of where the anchor is in them. Also the joined
        bytes and where each text begins in them.
        """
        raw = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(texts) else np.empty(0, np.int64)
        length, width = self.length, self.length - self.gram + 1
        if len(raw) < length:
            none = np.empty(0, np.int64)
            return none, none.view(np.uint64), none.view(np.uint64), none, none, none, raw, begins
        wide = raw.astype(np.uint64) + np.uint64(1)
        h = self._rolled(wide, self.gram)
        mixed = mix64(h)
        # least hash in the leading 40 bits, then leftmost: decided by the window's bytes alone
        shift = np.uint64(24)
        key = ((mixed >> shift) << shift) | (np.arange(len(h), dtype=np.uint64) & np.uint64((1 << 24) - 1))
        least, span = key, 1
        while 2 * span <= width:
            least = np.minimum(least[: len(least) - span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        starts = np.arange(len(least))
        owner = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
        ok = starts + length <= (begins + sizes)[owner]
        starts, owner, least = starts[ok], owner[ok], least[ok]
        if not len(starts):
            none = np.empty(0, np.int64)
            return none, none.view(np.uint64), none.view(np.uint64), none, none, none, raw, begins
        new = np.concatenate([[True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])])
        cuts = np.flatnonzero(new)
        first, last = starts[cuts], starts[np.append(cuts[1:], len(starts)) - 1]
        low = (least[cuts] & np.uint64((1 << 24) - 1)).astype(np.int64)
        at = first + ((low - first) & ((1 << 24) - 1))
        if len(raw) > len(self.up):
            n = max(len(raw), SCAN_BYTES + (SCAN_BYTES >> 2))
            self.up, self.down = _powers(_B, n), _powers(_INV, n)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(wide * self.up[: len(wide)])])
        print_ = self.hash_of(first, last + length)
        print_ = mix64(print_ ^ mix64(((at - first) << 32 | (last - first)).astype(np.uint64)))
        return owner[cuts], mixed[at], print_, first, last, at, raw, begins

    @staticmethod
    def _rolled(wide: np.ndarray, length: int) -> np.ndarray:
        """Hash of every substring of ``length``, built from halves."""
        parts, span, h, done, out = [], 1, wide, 0, None
        n = len(wide) - length + 1
        while span <= length:
            if length & span:
                piece = h[done : done + n]
                out = piece if out is None else out * np.uint64(pow(_B, span, 1 << 64)) + piece
                done += span
            if 2 * span <= length:
                h = h[: len(h) - span] * np.uint64(pow(_B, span, 1 << 64)) + h[span:]
            span *= 2
        return out


# ---- suffix order ---------------------------------------------------------------------------


def suffix_ranks(text: np.ndarray, depth: int) -> list[np.ndarray]:
    """Prefix doubling: ranks of all suffixes by their first 1, 2, 4 .. bytes, at least ``depth`` in the end.

    ``text`` holds small non-negative numbers; behind its end every suffix is followed by less
    than any of them.
    """
    ranks, span = [text.astype(np.int64) + 1], 1
    while span < depth:
        r = ranks[-1]
        pair = r * (int(r.max()) + 2)
        if span < len(r):
            pair[: len(r) - span] += r[span:]
        order = np.argsort(pair)
        s = pair[order]
        rank = np.empty(len(r), np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], (s[1:] != s[:-1]).astype(np.int64)]))
        ranks.append(rank)
        span *= 2
    return ranks


def common_prefix(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
    """Longest common prefix of the suffixes at i and j, at most ``most``."""
    n = len(ranks[0])
    i, j = i.copy(), j.copy()
    out = np.zeros(len(i), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        span = 1 << level
        ok = (i + span <= n) & (j + span <= n)
        r = ranks[level]
        ok[ok] = r[i[ok]] == r[j[ok]]
        out[ok] += span
        i[ok] += span
        j[ok] += span
    return np.minimum(out, most)


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value to the left of each, -1 if there is none (by jumps)."""
    left = np.arange(-1, len(values) - 1)
    open_ = np.flatnonzero((left >= 0) & (values[left] > values))
    while len(open_):
        left[open_] = left[left[open_]]
        at = left[open_]
        open_ = open_[(at >= 0) & (values[at] > values[open_])]
    return left


def factors(text: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and longest next factor, up to ``depth``, of the suffixes at ``starts`` among them.

    Among all earlier suffixes the longest match is one of the two nearest ones in suffix order that
    begin earlier; likewise for later ones.
    """
    ranks = suffix_ranks(text, depth)
    starts = np.sort(starts)
    # doubling ends at a power of two of at least depth, so the last ranks order by that many bytes
    order = starts[np.argsort(ranks[-1][starts], kind="stable")]
    best = []
    for sign in (1, -1):
        values = order * sign
        before = nearest_smaller(values)
        behind = len(order) - 1 - nearest_smaller(values[::-1])[::-1]
        found = np.zeros(len(order), np.int64)
        for at in (before, behind):
            ok = np.flatnonzero((at >= 0) & (at < len(order)))
            found[ok] = np.maximum(found[ok], common_prefix(ranks, order[ok], order[at[ok]], depth))
        by_place = np.empty(len(order), np.int64)
        by_place[np.searchsorted(starts, order)] = found
        best.append(by_place)
    return best[0], best[1]


# ---- scans and groups -----------------------------------------------------------------------


def _chunks(batches: Batches):
    """(rows, texts) of about ``SCAN_BYTES``; a longer text is alone."""
    for batch in batches:
        rows, texts, held = [], [], 0
        for row, text in zip(batch.column("row").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            if texts and held + len(text or b"") > SCAN_BYTES:
                yield np.array(rows, np.int64), texts
                rows, texts, held = [], [], 0
            rows.append(row)
            texts.append(text or b"")
            held += len(texts[-1])
        if texts:
            yield np.array(rows, np.int64), texts


_RUNS = "anchor long, print long, row long, first int, last int"


def _scan_runs(batches: Batches, schema: pa.Schema, length: int) -> Batches:
    anchors = Anchors(length)
    for rows, texts in _chunks(batches):
        owner, anchor, print_, first, last, _, _, begins = anchors.runs(texts)
        begin = begins[owner]
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor.view(np.int64)), pa.array(print_.view(np.int64)), pa.array(rows[owner]),
             pa.array((first - begin).astype(np.int32)), pa.array((last - begin).astype(np.int32))],
            schema=schema,
        )


_GROUPED = _RUNS + ", whole boolean, leads boolean, wants array<long>, row_key long"


def run_key(print_: np.ndarray, row: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What marks a run in the bit table."""
    place = mix64(row.view(np.uint64) * np.uint64(_B) + first.astype(np.int64).view(np.uint64))
    return mix64(print_.view(np.uint64) ^ place)


def _groups(batches: Batches, schema: pa.Schema) -> Batches:
    """Of runs sorted by anchor, print and place: those whose anchor has others.

    ``whole``: there is another run with the same print; ``leads``: it is the first of its print;
    ``wants``: keys of the leading runs known from here to belong to an anchor of several prints,
    its own, and at the second print that of the first. Only a row's neighbours and the first key
    of the anchor matter, so one row is held back between batches.
    """
    held, before, opening = None, None, None  # opening: key of the first run of the anchor at hand

    def judged(rows, behind) -> pa.RecordBatch:
        nonlocal before, opening
        anchor = np.concatenate([[before[0] if before else 0], rows[0], [behind[0] if behind else 0]])
        print_ = np.concatenate([[before[1] if before else 0], rows[1], [behind[1] if behind else 0]])
        same_a, same_p = anchor[1:] == anchor[:-1], (anchor[1:] == anchor[:-1]) & (print_[1:] == print_[:-1])
        if not before:
            same_a[0] = same_p[0] = False
        if not behind:
            same_a[-1] = same_p[-1] = False
        keep = same_a[:-1] | same_a[1:]
        whole, leads = same_p[:-1] | same_p[1:], ~same_p[:-1]
        keys = run_key(rows[1], rows[2], rows[3]).view(np.int64)
        opens = ~same_a[:-1]
        later = np.flatnonzero(leads & ~opens)  # leaders of the second print and on
        nearest = np.maximum.accumulate(np.where(opens, np.arange(len(opens)), -1))
        wants = [None] * len(keys)
        for k, o in zip(later.tolist(), nearest[later].tolist()):
            wants[k] = [int(keys[k]), int(keys[o]) if o >= 0 else opening]
        before = (rows[0][-1], rows[1][-1])
        if nearest[-1] >= 0:
            opening = int(keys[nearest[-1]])
        at = np.flatnonzero(keep)
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c[at]) for c in (*rows, whole, leads)), pa.array([wants[k] for k in at.tolist()], pa.list_(pa.int64())),
             pa.array(mix64(rows[2][at].view(np.uint64)).view(np.int64))],
            schema=schema,
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [c.to_numpy() for c in batch.columns]
        if held:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        if len(rows[0]) > 1:
            yield judged([c[:-1] for c in rows], (rows[0][-1], rows[1][-1]))
        held = [c[-1:] for c in rows]
    if held:
        yield judged(held, None)


_CONTEXTS = "anchor long, print long, row long, first int, content binary"


def _bits_of(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _bits_of(keys)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _only(chunks, bits: np.ndarray):
    """Chunks without the rows that are not in the bit table of rows."""
    for rows, texts in chunks:
        some = np.flatnonzero(_has(bits, mix64(rows.view(np.uint64))))
        if len(some):
            yield rows[some], [texts[k] for k in some.tolist()]


def _scan_contexts(batches: Batches, schema: pa.Schema, wanted, wanted_rows, hot, length: int) -> Batches:
    """Bytes of the leading runs at anchors of several prints; hot anchors are left out."""
    bits, row_bits = (np.frombuffer(b.value, np.uint8) for b in (wanted, wanted_rows))
    hot, anchors = hot.value, Anchors(length)
    for rows, texts in _only(_chunks(batches), row_bits):
        owner, anchor, print_, first, last, _, raw, begins = anchors.runs(texts)
        if not len(anchor):
            continue
        row, place = rows[owner], (first - begins[owner]).astype(np.int32)
        pick = _has(bits, run_key(print_, row, place))
        if len(hot):
            pick &= ~_among(anchor, hot)
        k = np.flatnonzero(pick)
        if len(k):
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[k].view(np.int64)), pa.array(print_[k].view(np.int64)), pa.array(row[k]), pa.array(place[k]),
                 pa.array([raw[a : b + length].tobytes() for a, b in zip(first[k].tolist(), last[k].tolist())], pa.binary())],
                schema=schema,
            )


def _among(anchor: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor


class Pieces:
    """The runs at hot anchors of a scan, cut where the distance to the anchor passes a multiple of a step.

    Equal windows have their anchor at the same place, so they are in pieces of the same number. All windows
    of a piece hold its ``core``, whatever the run; ``full`` is a hash of all its bytes. Pieces whose
    cores differ share no window, and those whose ``full`` is equal share all.
    """

    def __init__(self, anchors: Anchors, rows: np.ndarray, texts: list[bytes], hot: np.ndarray, wanted: np.ndarray):
        owner, anchor, print_, first, last, at, self.raw, begins = anchors.runs(texts)
        place = (first - begins[owner]).astype(np.int32)
        k = np.flatnonzero(_among(anchor, hot) & _has(wanted, run_key(print_, rows[owner], place))) if len(anchor) else owner
        step = int(np.ceil(np.sqrt(anchors.length - anchors.gram + 1)))
        near, far = (at - last)[k], (at - first)[k]  # distances of the run's windows to the anchor
        n = far // step - near // step + 1
        number = np.repeat(near // step, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        near, far, k = np.maximum(np.repeat(near, n), number * step), np.minimum(np.repeat(far, n), number * step + step - 1), np.repeat(k, n)
        at = at[k]
        self.begin, self.end = at - far, at - near  # first and last window
        self.anchor, self.print, self.row, self.first = anchor[k], print_[k], rows[owner[k]], place[k]
        self.lo, self.hi = (self.begin - first[k]).astype(np.int32), (self.end - first[k]).astype(np.int32)
        core = anchors.hash_of(at - number * step, at - number * step + (anchors.length - step + 1)) if len(k) else self.anchor
        self.core = mix64(core ^ mix64(self.anchor ^ mix64(number.astype(np.uint64))))
        full = anchors.hash_of(self.begin, self.end + anchors.length) if len(k) else self.anchor
        self.full = mix64(full ^ mix64((far << 32 | near).astype(np.uint64)))
        self.key = run_key(self.core ^ self.full, self.row, self.first)


_PIECES = "core long, full long, anchor long, print long, row long, first int, lo int, hi int, key long, row_key long"


def _scan_pieces(batches: Batches, schema: pa.Schema, hot, wanted, hot_rows, length: int) -> Batches:
    """Pieces of the leading runs at hot anchors; copies of a run stay out."""
    anchors = Anchors(length)
    bits, row_bits = (np.frombuffer(b.value, np.uint8) for b in (wanted, hot_rows))
    for rows, texts in _only(_chunks(batches), row_bits):
        p = Pieces(anchors, rows, texts, hot.value, bits)
        if len(p.row):
            longs = (p.core, p.full, p.anchor, p.print, p.row)
            keys = (p.key, mix64(p.row.view(np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c.view(np.int64)) for c in longs), *(pa.array(c) for c in (p.first, p.lo, p.hi)),
                 *(pa.array(c.view(np.int64)) for c in keys)],
                schema=schema,
            )


_WINDOWS = "anchor long, print long, row long, first int, at int, window long"


def _scan_windows(batches: Batches, schema: pa.Schema, hot, wanted, open_pieces, open_rows, length: int) -> Batches:
    """A hash of every window of the open pieces: their core is in other pieces, too, that are not equal."""
    anchors = Anchors(length)
    bits, piece_bits, row_bits = (np.frombuffer(b.value, np.uint8) for b in (wanted, open_pieces, open_rows))
    for rows, texts in _only(_chunks(batches), row_bits):
        p = Pieces(anchors, rows, texts, hot.value, bits)
        k = np.flatnonzero(_has(piece_bits, p.key))
        if not len(k):
            continue
        n = (p.end - p.begin + 1)[k]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(k, n)
        begin = p.begin[wide] + step
        hashes = mix64(anchors.hash_of(begin, begin + length))
        yield pa.RecordBatch.from_arrays(
            [pa.array(p.anchor[wide].view(np.int64)), pa.array(p.print[wide].view(np.int64)), pa.array(p.row[wide]),
             pa.array(p.first[wide]), pa.array((p.lo[wide] + step).astype(np.int32)), pa.array(hashes.view(np.int64))],
            schema=schema,
        )


_HITS = "anchor long, print long, earlier array<struct<a:int,b:int>>, other array<struct<a:int,b:int>>"


def _ranges(places: np.ndarray) -> list[dict]:
    """Ascending numbers as ranges, both ends included."""
    cuts = np.flatnonzero(np.diff(places) != 1) + 1 if len(places) else ()
    return [{"a": int(p[0]), "b": int(p[-1])} for p in np.split(places, cuts)] if len(places) else []


def _match(batches: Batches, schema: pa.Schema, length: int) -> Batches:
    """Windows of the contexts of each anchor that occur in another of its contexts, or earlier ones.

    Anchors are complete when they are laid together; contexts come by the place of their first
    run, so an earlier factor belongs to a run before it.
    """

    def done(held: list[list[tuple]]) -> pa.RecordBatch:
        flat = [c for group in held for c in sorted(group, key=lambda c: c[2:4])]
        sizes = np.array([len(c[4]) for c in flat])
        text = np.frombuffer(b"\0".join(c[4] for c in flat), np.uint8).astype(np.int64) + 1
        begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        text[begins[1:] - 1] = 0
        windows = sizes - length + 1
        owner = np.repeat(np.arange(len(flat)), windows)
        at = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        previous, following = factors(text, begins[owner] + at, length)
        earlier, other = previous >= length, (previous >= length) | (following >= length)
        ends = np.cumsum(windows)
        out = []
        for k in np.unique(owner[other]).tolist():
            part = slice(ends[k] - windows[k], ends[k])
            out.append({"anchor": flat[k][0], "print": flat[k][1], "earlier": _ranges(at[part][earlier[part]]), "other": _ranges(at[part][other[part]])})
        return pa.RecordBatch.from_pylist(out, schema=schema)

    held, size, group, group_size, last = [], 0, [], 0, None
    for batch in batches:
        for c in zip(*(x.to_pylist() for x in batch.columns)):
            if last is not None and c[0] != last[0]:
                if len(group) > 1:
                    held.append(group)
                    size += group_size
                group, group_size = [], 0
                if size >= SUFFIX_BYTES:
                    yield done(held)
                    held, size = [], 0
            if last != c[:2]:
                group.append(c)
                group_size += len(c[4])
            last = c[:2]
    if len(group) > 1:
        held.append(group)
    if held:
        yield done(held)


def _arrow(ddl: str) -> tuple[T.StructType, pa.Schema]:
    kind = T._parse_datatype_string(ddl)
    return kind, pa.schema([pa.field(f.name, arrow_type(f.dataType)) for f in kind.fields])


def _ranges_of(when: F.Column) -> F.Column:
    """The ranges ``a`` to ``b`` of a group where ``when`` holds, in order and joined where they meet."""
    ranges = F.array_sort(F.collect_list(F.when(when, F.struct("a", "b"))))

    def step(done, x):
        end = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(end["a"].alias("a"), F.greatest(end["b"], x["b"]).alias("b"))))
        return F.when(end["b"] >= x["a"] - 1, longer).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.slice(ranges, 2, F.greatest(F.size(ranges), F.lit(1))), F.slice(ranges, 1, 1), step)


def _spans(numbered: DataFrame, length: int, keep: str, hot_prints: int, most_hot: int) -> DataFrame:
    """``row, spans``: ranges of window starts that are repeated (``keep="none"``) or occur earlier."""
    spark = numbered.sparkSession
    share = spark.sparkContext.broadcast
    texts = numbered.select("row", "text")
    run_kind, run_schema = _arrow(_RUNS)
    runs = arrow_map(texts, partial(_scan_runs, schema=run_schema, length=length), run_kind)
    kind, schema = _arrow(_GROUPED)
    laid = runs.repartition("anchor").sortWithinPartitions("anchor", "print", "row", "first")
    grouped = stored(arrow_map(laid, partial(_groups, schema=schema), kind), "suffix-groups")

    odd = grouped.where(F.col("wants").isNotNull()).select("anchor", "row", F.explode("wants").alias("key"))
    hot = odd.groupBy("anchor").count().where(F.col("count") > hot_prints).orderBy(F.col("count").desc(), "anchor").limit(most_hot)
    hot = np.sort(np.array([r["anchor"] for r in hot.collect()], np.int64).view(np.uint64))

    context_kind, context_schema = _arrow(_CONTEXTS)
    hit_kind, hit_schema = _arrow(_HITS)
    shared_hot = share(hot)
    wanted, wanted_rows = share(_bit_table(odd, F.col("key"))), share(_bit_table(grouped.where("leads"), F.col("row_key")))
    scan = partial(_scan_contexts, schema=context_schema, wanted=wanted, wanted_rows=wanted_rows, hot=shared_hot, length=length)
    laid = arrow_map(texts, scan, context_kind).repartition("anchor").sortWithinPartitions("anchor", "print", "row", "first")
    hits, windows = arrow_map(laid, partial(_match, schema=hit_schema, length=length), hit_kind), []
    if len(hot):
        names = spark.createDataFrame([(int(x),) for x in hot.view(np.int64)], "anchor long")
        hot_rows = share(_bit_table(grouped.where("leads").join(F.broadcast(names), "anchor"), F.col("row_key")))
        of_hot, windows = _hot_hits(texts, shared_hot, wanted, hot_rows, length)
        hits = hits.unionByName(of_hot)
    hits = stored(hits, "suffix-hits")
    release(*windows)

    field = "other" if keep == "none" else "earlier"
    everything = F.col("whole") if keep == "none" else F.col("whole") & ~F.col("leads")
    full = grouped.where(everything).select("row", F.array(F.struct(F.col("first").alias("a"), F.col("last").alias("b"))).alias("s"))
    part = (
        grouped.where(~everything).join(hits.select("anchor", "print", F.col(field).alias("h")), ["anchor", "print"])
        .select("row", F.transform("h", lambda h: F.struct((F.col("first") + h["a"]).alias("a"), (F.col("first") + h["b"]).alias("b"))).alias("s"))
    )
    spans = stored(full.unionByName(part).groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("spans")), "suffix-spans")
    release(grouped, hits)
    return spans


def _bit_table(df: DataFrame, key: F.Column) -> bytes:
    """Bits of the leading ``FILTER_BITS`` bits of the keys, gathered as 2048 bitmaps of 4 KB."""
    place = F.shiftrightunsigned(key, 64 - FILTER_BITS) + 1
    bitmaps = df.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("k")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")
    )
    table = bytearray((1 << FILTER_BITS) // 8)
    for r in bitmaps.toLocalIterator():
        table[(r["k"] - 1) * 4096 : r["k"] * 4096] = r["bits"]
    return bytes(table)


def _hot_hits(texts: DataFrame, hot, wanted, hot_rows, length: int) -> tuple[DataFrame, list[DataFrame]]:
    """The same for anchors with very many prints, in as many tasks as it takes.

    Pieces of runs are counted by their hash. Only where one core has different pieces, and of equal ones
    only in the first, are windows counted one by one.
    """
    share = texts.sparkSession.sparkContext.broadcast
    kind, schema = _arrow(_PIECES)
    pieces = stored(
        arrow_map(texts, partial(_scan_pieces, schema=schema, hot=hot, wanted=wanted, hot_rows=hot_rows, length=length), kind), "suffix-pieces"
    )
    # one row per core and piece, so a piece that all runs have is counted in parts first
    equal = stored(
        pieces.groupBy("core", "full").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "first", "key", "row_key")).alias("leader")),
        "suffix-equal",
    )
    several = stored(equal.groupBy("core").count().where(F.col("count") > 1).select("core"), "suffix-cores")
    unequal = stored(equal.join(several, "core").select("leader.key", "leader.row_key"), "suffix-open")
    open_pieces, open_rows = (share(_bit_table(unequal, F.col(c))) for c in ("key", "row_key"))
    release(several, unequal)
    leader = F.struct(F.col("leader.row"), F.col("leader.first"))
    whole = pieces.join(equal.where(F.col("n") > 1).select("core", "full", "leader"), ["core", "full"]).select(
        "anchor", "print", F.col("lo").alias("a"), F.col("hi").alias("b"), (F.struct("row", "first") > leader).alias("is_earlier")
    )

    kind, schema = _arrow(_WINDOWS)
    scan = partial(_scan_windows, schema=schema, hot=hot, wanted=wanted, open_pieces=open_pieces, open_rows=open_rows, length=length)
    by_print = arrow_map(texts, scan, kind).groupBy("anchor", "window", "print", "at").agg(F.min(F.struct("row", "first")).alias("place"))
    by_print = stored(by_print, "suffix-windows")
    # likewise for a hash shared by all prints
    counted = stored(
        by_print.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first_place")).where(F.col("n") > 1),
        "suffix-windows",
    )
    single = by_print.join(counted, ["anchor", "window"]).select(
        "anchor", "print", F.col("at").alias("a"), F.col("at").alias("b"), (F.col("place") > F.col("first_place")).alias("is_earlier")
    )
    ranges = whole.unionByName(single).groupBy("anchor", "print").agg(
        _ranges_of(F.col("is_earlier")).alias("earlier"), _ranges_of(F.lit(True)).alias("other")
    )
    return ranges, [pieces, equal, by_print, counted]


def _covered(spans, size: int, length: int) -> list[tuple[int, int]]:
    """Byte ranges (end exclusive) covered by windows that start in the sorted ranges."""
    out: list[tuple[int, int]] = []
    for s in spans or ():
        a, b = s["a"], s["b"] + length
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _rest(text: bytes, removed: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in removed:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept)


def _report(batches: Batches, schema: pa.Schema, length: int) -> Batches:
    for batch in batches:
        removed_of, sizes, digests = [], [], []
        for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
            text = text or b""
            removed = _covered(spans, len(text), length)
            removed_of.append([{"first": a, "end": b} for a, b in removed])
            sizes.append(len(text))
            digests.append(hashlib.sha256(_rest(text, removed)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed_of, schema.field("removed").type), pa.array(digests, pa.string())],
            schema=schema,
        )


HOT_PRINTS, MOST_HOT = 256, 100_000


def repeated_passages(
    docs: DataFrame, length: int = LENGTH, keep: str = "none", hot_prints: int = HOT_PRINTS, most_hot: int = MOST_HOT
) -> DataFrame:
    """Repeated bytes of every row of ``docs`` (``doc_id``, ``text``): ``doc_id, n_bytes, removed, kept_sha256``.

    A byte is repeated if a string of ``length`` bytes that covers it starts anywhere else, in the
    same text or another; with ``keep="first"`` only if it starts at an earlier place (in the
    order in which the rows are read). ``removed`` has the maximal ranges ``first``, ``end`` (end
    exclusive) in UTF-8 bytes. Overlaps count, all strings are judged on the input. Null texts are
    empty; texts under ``length`` bytes have no strings. Repeated rows repeat each other. No rows
    give no rows; other columns are ignored.

    Anchors with more than ``hot_prints`` different runs are matched by counting hashes of pieces of runs, and of
    windows where pieces differ, instead of in a suffix array; beyond the ``most_hot`` largest of them they stay in one.
    """
    numbered = stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "suffix-input")
    spans = _spans(numbered, length, keep, hot_prints, most_hot)
    id_kind = docs.schema["doc_id"].dataType
    kind = T.StructType(
        [T.StructField("doc_id", id_kind), *T._parse_datatype_string("n_bytes long, removed array<struct<first:long,end:long>>, kept_sha256 string").fields]
    )
    schema = pa.schema([pa.field(f.name, arrow_type(f.dataType)) for f in kind.fields])
    return arrow_map(numbered.join(spans, "row", "left").select("doc_id", "text", "spans"), partial(_report, schema=schema, length=length), kind)


def _cut(batches: Batches, length: int) -> Batches:
    for batch in batches:
        texts = [
            None if t is None else _rest(t, _covered(s, len(t), length)).decode("utf-8", "ignore")
            for t, s in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("__spans").to_pylist())
        ]
        k = batch.schema.get_field_index("text")
        yield batch.drop_columns(["__spans"]).set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: str = "first") -> DataFrame:
    """``docs`` with all columns, repeated passages cut from the texts; by default the first copy stays.

    A character of which only some bytes are repeated goes with them. Null texts stay null.
    """
    numbered = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "suffix-input")
    spans = _spans(numbered.select(F.col("__row").alias("row"), "text"), length, keep, HOT_PRINTS, MOST_HOT)
    joined = numbered.join(spans.select(F.col("row").alias("__row"), F.col("spans").alias("__spans")), "__row", "left")
    return arrow_map(joined.select(*docs.columns, "__spans"), partial(_cut, length=length), docs.schema)
