"""Hard-negative mining over blocks of vectors in Hilbert order, chosen by interval arithmetic.

Vectors of one label are sorted along a Hilbert curve through all dimensions and cut into blocks of a
Parquet table; every block carries its zone map, the least and the greatest value of each
dimension. From a zone map, interval arithmetic bounds the inner products of an anchor with all rows
of the block. Anchors come in chunks, zone maps in groups; each pair of these decides from bounds alone
which blocks its anchors' windows must read, and only those blocks are joined to it. The
greatest lower bounds give thresholds: a block whose upper bound is below what other blocks surely
hold is not read. Within a pair, blocks are read from the highest upper bound down, and what has been
found raises the thresholds further.

Scores are whole numbers and exact; bounds skip blocks but no result.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Batches, arrow_map, columns_of, row_numbers, stored

SCALE = 256
RELABEL_EVERY, LABELS = 7, 10
ANCHOR_EVERY = 50
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # a negative scores between these per cent of its positive
TOO_LARGE = 1 << 28  # scaled components from here on could overflow 64-bit scores
HILBERT_BITS = 2
BLOCK_ROWS = 256
GROUP_BLOCKS = 64
CHUNK_ANCHORS = 512
NOTHING = -(1 << 62)  # below every score

VECTORS = "row long, vec_id long, label int, q binary"
BLOCKS = "group long, block long, label int, n int, dim int, rows binary, ids binary, q binary, lo binary, hi binary"
CHUNKS = "chunk long, rows binary, ids binary, labels binary, q binary, dim int"


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in text.split(", "))])


def _clean(batches: Batches) -> Batches:
    """Rows that take part, relabelled and in whole numbers."""
    schema, seen = _schema(VECTORS), 0
    for batch in batches:
        rows = np.array(row_numbers(seen, batch.num_rows), np.int64)
        seen += batch.num_rows
        vectors = batch.column("embedding")
        known = pc.and_(pc.and_(pc.is_valid(vectors), pc.is_valid(batch.column("label"))), pc.is_valid(batch.column("vec_id")))
        picked = np.flatnonzero(known.to_numpy(zero_copy_only=False))
        vectors = vectors.take(pa.array(picked))
        values = vectors.flatten()
        sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
        scaled = np.floor(SCALE * values.cast(pa.float64()).to_numpy(zero_copy_only=False))  # nulls become NaN
        with np.errstate(invalid="ignore"):
            bad = ~(np.abs(scaled) < TOO_LARGE)
        owner = np.repeat(np.arange(len(picked)), sizes)
        good = np.bincount(owner, bad, len(picked)) == 0
        whole = np.where(bad, 0, scaled).astype("<i4")
        ends = np.cumsum(sizes)
        q = [whole[e - s : e].tobytes() for s, e, ok in zip(sizes, ends, good) if ok]
        picked = picked[good]
        ids = batch.column("vec_id").cast(pa.int64()).take(pa.array(picked)).to_numpy()
        labels = batch.column("label").cast(pa.int64()).take(pa.array(picked)).to_numpy()
        labels = np.where(ids % RELABEL_EVERY == 0, (labels + 1) % LABELS, labels)
        yield columns_of(schema, row=rows[picked], vec_id=ids, label=labels.astype(np.int32), q=q)


def _matrix(q: list[bytes], dim: int) -> np.ndarray:
    """Vectors as rows of a matrix; shorter ones end with zeros."""
    return np.frombuffer(b"".join(v + bytes(4 * dim - len(v)) for v in q), "<i4").reshape(-1, dim)


def _ranges(batches: Batches) -> Batches:
    """Range of every dimension over a task's vectors (a dimension that some lack includes zero)."""
    lo, hi, n = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for batch in batches:
        for v in batch.column("q").to_pylist():
            x = np.frombuffer(v, "<i4")
            if len(x) > len(lo):
                lo, hi = (np.concatenate([b, np.zeros(len(x) - len(b), np.int64) if n else x[len(b) :]]) for b in (lo, hi))
            lo[: len(x)], hi[: len(x)] = np.minimum(lo[: len(x)], x), np.maximum(hi[: len(x)], x)
            n += 1
    if n:
        schema = pa.schema([("place", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64())])
        yield columns_of(schema, place=np.arange(-1, len(lo)).astype(np.int32), lo=[0, *lo.tolist()], hi=[0, *hi.tolist()])


def hilbert_keys(x: np.ndarray, bits: int) -> list[bytes]:
    """Places of the points along the Hilbert curve through as many dimensions as ``x`` has columns.

    ``x`` holds whole numbers of ``bits`` bits. Skilling's transform of axes to the transposed
    index, on all points at once; the bytes of a key sort like the index.
    """
    x = x.T.astype(np.int64)
    dim, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        for i in range(dim):
            hit = (x[i] & q) != 0
            turn = np.where(hit, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(hit, x[0] ^ (q - 1), x[0] ^ turn)
            x[i] ^= turn
        q >>= 1
    for i in range(1, dim):
        x[i] ^= x[i - 1]
    turn, q = np.zeros(x.shape[1], np.int64), top
    while q > 1:
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    planes = np.concatenate([(x >> b) & 1 for b in range(bits - 1, -1, -1)]).astype(np.uint8)
    return [bytes(k) for k in np.packbits(planes, axis=0).T]


def _keys(batches: Batches, lo: np.ndarray, hi: np.ndarray) -> Batches:
    schema = pa.schema([*_schema(VECTORS), ("key", pa.binary())])
    width = np.maximum(hi - lo, 1)
    for batch in batches:
        x = _matrix(batch.column("q").to_pylist(), len(lo))
        cells = (x - lo) * ((1 << HILBERT_BITS) - 1e-9) // width
        yield columns_of(
            schema, row=batch.column("row"), vec_id=batch.column("vec_id"), label=batch.column("label"), q=batch.column("q"),
            key=hilbert_keys(cells.clip(0, (1 << HILBERT_BITS) - 1), HILBERT_BITS) if len(x) else [],
        )


def _blocks(batches: Batches, dim: int, block_rows: int, group_blocks: int) -> Batches:
    """Blocks of consecutive rows of one label, each with its zone map; rows of a block go by ``vec_id``."""
    from pyspark import TaskContext

    schema, base = _schema(BLOCKS), TaskContext.get().partitionId() << 32
    held, made = [], 0

    def block() -> pa.RecordBatch:
        nonlocal held, made
        held.sort(key=lambda r: (r[1], r[0]))
        x = _matrix([r[3] for r in held], dim)
        out = columns_of(
            schema, group=[base + made // group_blocks], block=[base + made], label=[held[0][2]], n=[len(held)], dim=[dim],
            rows=[np.array([r[0] for r in held], np.int64).tobytes()], ids=[np.array([r[1] for r in held], np.int64).tobytes()],
            q=[x.tobytes()], lo=[x.min(0).tobytes()], hi=[x.max(0).tobytes()],
        )
        held, made = [], made + 1
        return out

    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("row", "vec_id", "label", "q"))):
            if held and (r[2] != held[0][2] or len(held) == block_rows):
                yield block()
            held.append(r)
    if held:
        yield block()


def _chunks(batches: Batches, most: int) -> Batches:
    """Anchors of the blocks, in their order."""
    from pyspark import TaskContext

    schema, base = _schema(CHUNKS), TaskContext.get().partitionId() << 32
    held, made, dim = [], 0, 1

    def chunk() -> pa.RecordBatch:
        nonlocal held, made
        part, held = held[:most], held[most:]
        made += 1
        return columns_of(
            schema, chunk=[base + made], rows=[np.array([r[0] for r in part], np.int64).tobytes()],
            ids=[np.array([r[1] for r in part], np.int64).tobytes()], labels=[np.array([r[2] for r in part], "<i4").tobytes()],
            q=[b"".join(r[3] for r in part)], dim=[dim],
        )

    for batch in batches:
        for b in batch.to_pylist():
            dim = b["dim"]
            rows, ids = (np.frombuffer(b[c], np.int64) for c in ("rows", "ids"))
            for k in np.flatnonzero(ids % ANCHOR_EVERY == 0):
                held.append((rows[k], ids[k], b["label"], b["q"][4 * dim * k : 4 * dim * (k + 1)]))
            while len(held) >= most:
                yield chunk()
    if held:
        yield chunk()


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of both: by floating point where no sum can pass 2**53."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max()) < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product that each row of ``a`` can have with a vector between ``lo`` and ``hi``."""
    a = a.astype(np.int64)
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return products(up, lo) + products(down, hi), products(up, hi) + products(down, lo)


class Anchors:
    """A chunk of anchors, with windows once their positives are known."""

    def __init__(self, r: dict):
        self.rows, self.ids, self.labels = (np.frombuffer(r[c], t) for c, t in (("rows", np.int64), ("ids", np.int64), ("labels", "<i4")))
        self.q = np.frombuffer(r["q"], "<i4").reshape(-1, r["dim"])
        n = len(self.rows)
        self.positive = np.full((n, POSITIVES, 2), NOTHING, np.int64)  # score, vec_id
        for w in r.get("windows") or ():
            self.positive[w["place"], w["rank"] - 1] = w["score"], w["vec_id"]
        score = self.positive[:, :, 0]
        known = score > NOTHING
        safe = np.where(known, score, 0)
        self.low = np.where(known, -((-LOW * safe) // 100), 1)
        self.high = np.where(known, (HIGH * safe) // 100, 0)  # empty window where there is no positive


def _surely(scores: np.ndarray, counts: np.ndarray, usable: np.ndarray, k: int) -> np.ndarray:
    """A score that at least ``k`` rows of the usable blocks reach, from lower bounds (last axis: blocks)."""
    order = np.argsort(-np.where(usable, scores, NOTHING), axis=-1, kind="stable")
    held = np.cumsum(np.take_along_axis(np.where(usable, counts, 0), order, -1), -1) >= k
    at = np.argmax(held, -1)[..., None]
    ranked = np.take_along_axis(np.where(usable, scores, NOTHING), order, -1)
    return np.where(held.any(-1), np.take_along_axis(ranked, at, -1)[..., 0], NOTHING)


def wanted_positive(a: Anchors, least, most, labels, counts) -> np.ndarray:
    """Which blocks may hold one of the first positives of each anchor; the anchor itself is one of the rows."""
    same = a.labels[:, None] == labels
    return same & (most >= _surely(least, np.broadcast_to(counts, same.shape), same, POSITIVES + 1)[:, None])


def wanted_negative(a: Anchors, least, most, labels, counts) -> np.ndarray:
    other = a.labels[:, None] != labels
    found = np.zeros(other.shape, bool)
    for w in range(POSITIVES):
        low, high = a.low[:, w, None], a.high[:, w, None]
        open_now = other & (least <= high) & (most >= low) & (low <= high)
        inside = open_now & (least >= low) & (most <= high)
        sure = _surely(least, np.broadcast_to(counts, inside.shape), inside, NEGATIVES)
        found |= open_now & (most >= sure[:, None])
    return found


def _requests(batches: Batches, negative: bool) -> Batches:
    """Blocks that a chunk of anchors must read, from the zone maps of a group."""
    schema = pa.schema([("chunk", pa.int64()), ("block", pa.int64()), ("reach", pa.int64())])
    for batch in batches:
        for r in batch.to_pylist():
            a, zones = Anchors(r), r["zones"]
            lo, hi = (np.stack([np.frombuffer(z[c], "<i4") for z in zones]) for c in ("lo", "hi"))
            least, most = bounds(a.q, lo, hi)
            labels, counts = np.array([z["label"] for z in zones]), np.array([z["n"] for z in zones])
            want = (wanted_negative if negative else wanted_positive)(a, least, most, labels, counts)
            reach = np.where(want, most, NOTHING).max(0)
            read = np.flatnonzero(want.any(0))
            yield columns_of(schema, chunk=[r["chunk"]] * len(read), block=[zones[k]["block"] for k in read], reach=reach[read])


FOUND = "anchor_row long, anchor_id long, chunk long, place int, rank int, positive_id long, positive_score long, score long, vec_id long, row long"


class Best:
    """The best rows found so far for each slot: score, vec_id and row, best first."""

    def __init__(self, slots: int, k: int):
        self.score, self.id, self.row = (np.full((slots, k), v, np.int64) for v in (NOTHING, 0, 0))

    def merge(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        score, ids, rows = (np.concatenate([old[at], new], 1) for old, new in ((self.score, score), (self.id, ids), (self.row, rows)))
        order = np.lexsort((rows, ids, -score), axis=-1)[:, : self.score.shape[1]]
        for into, values in ((self.score, score), (self.id, ids), (self.row, rows)):
            into[at] = np.take_along_axis(values, order, 1)


def _read_block(a: Anchors, best: Best, b: dict, negative: bool) -> None:
    """Score a block against the anchors of the chunk that can still gain from it."""
    x = np.frombuffer(b["q"], "<i4").reshape(-1, b["dim"])
    ids, rows = (np.frombuffer(b[c], np.int64) for c in ("ids", "rows"))
    least, most = bounds(a.q, np.frombuffer(b["lo"], "<i4")[None], np.frombuffer(b["hi"], "<i4")[None])
    least, most = least[:, 0], most[:, 0]
    if not negative:
        at = np.flatnonzero((a.labels == b["label"]) & (most >= best.score[:, -1]))
        score = products(a.q[at], x)
        score = np.where(a.rows[at][:, None] == rows, NOTHING, score)
        first = np.argsort(-score, axis=1, kind="stable")[:, :POSITIVES]
        best.merge(at, np.take_along_axis(score, first, 1), ids[first], rows[first])
        return
    gains = (a.low <= a.high) & (least[:, None] <= a.high) & (most[:, None] >= np.maximum(a.low, best.score[:, -1].reshape(a.low.shape)))
    at = np.flatnonzero((a.labels != b["label"]) & gains.any(1))
    score = products(a.q[at], x)
    order = np.argsort(-score, axis=1, kind="stable")
    score = np.take_along_axis(score, order, 1)
    pad = ((0, 0), (0, NEGATIVES))
    score, order = np.pad(score, pad, constant_values=NOTHING), np.pad(order, pad)
    for w in range(POSITIVES):
        go = np.flatnonzero(gains[at, w])
        above = (score[go] > a.high[at[go], w, None]).sum(1)
        take = above[:, None] + np.arange(NEGATIVES)
        got, which = np.take_along_axis(score[go], take, 1), np.take_along_axis(order[go], take, 1)
        got = np.where(got >= a.low[at[go], w, None], got, NOTHING)
        best.merge(at[go] * POSITIVES + w, got, ids[which], rows[which])


def _search(batches: Batches, negative: bool) -> Batches:
    """Best rows per anchor of each pair of a chunk and a group; its blocks follow the chunk, highest reach first."""
    schema = pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.int64()) for c in FOUND.split(", ")])
    pair, a, best, chunk = None, None, None, None

    def found() -> pa.RecordBatch:
        slot, k = np.nonzero(best.score > NOTHING)
        place, rank = (slot // POSITIVES, slot % POSITIVES) if negative else (slot, np.zeros(len(slot), np.int64))
        positive = a.positive[place, rank]
        return columns_of(
            schema, anchor_row=a.rows[place], anchor_id=a.ids[place], chunk=np.full(len(slot), chunk), place=place.astype(np.int32),
            rank=(rank + 1).astype(np.int32), positive_id=positive[:, 1], positive_score=positive[:, 0], score=best.score[slot, k],
            vec_id=best.id[slot, k], row=best.row[slot, k],
        )

    for batch in batches:
        for r in batch.to_pylist():
            if r["reach"] is None:  # the chunk, ahead of its blocks
                if pair is not None:
                    yield found()
                pair, a, chunk = (r["chunk"], r["group"]), Anchors(r), r["chunk"]
                best = Best(len(a.rows) * (POSITIVES if negative else 1), NEGATIVES if negative else POSITIVES)
            else:
                _read_block(a, best, r, negative)
    if pair is not None:
        yield found()


def _passes(chunks: DataFrame, blocks: DataFrame, negative: bool) -> DataFrame:
    """``FOUND`` of every pair of a chunk and a group of blocks: bounds first, then the blocks they ask for."""
    zones = blocks.groupBy("group").agg(F.collect_list(F.struct("block", "label", "n", "lo", "hi")).alias("zones"))
    # The stated query set against all zone maps, in chunks and groups: both sides are packed rows.
    asked = arrow_map(chunks.crossJoin(zones), partial(_requests, negative=negative), "chunk long, block long, reach long")
    asked = stored(asked, "negatives-asked" if negative else "positives-asked")
    windows = F.col("windows") if negative else F.lit(None).cast("array<struct<place int, rank int, score long, vec_id long>>").alias("windows")
    none = F.lit(None).cast("binary")
    read = asked.join(blocks, "block").select(
        "chunk", "group", "reach", "label", "rows", "ids", none.alias("labels"), "q", "lo", "hi", "dim", F.lit(None).cast("array<struct<place int, rank int, score long, vec_id long>>").alias("windows"),
    )
    pairs = asked.join(blocks.select("block", "group"), "block").select("chunk", "group").distinct()
    ahead = pairs.join(chunks, "chunk").select(
        "chunk", "group", F.lit(None).cast("long").alias("reach"), F.lit(None).cast("int").alias("label"), "rows", "ids", "labels", "q",
        none.alias("lo"), none.alias("hi"), "dim", windows,
    )
    work = ahead.unionByName(read).repartition("chunk", "group").sortWithinPartitions("chunk", "group", F.col("reach").desc_nulls_first())
    return arrow_map(work, partial(_search, negative=negative), FOUND)


def hard_negatives(
    embeddings: DataFrame, block_rows: int = BLOCK_ROWS, group_blocks: int = GROUP_BLOCKS, chunk_anchors: int = CHUNK_ANCHORS
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from ``embeddings``
    (``vec_id``, ``embedding``, ``label``).

    Rows with a null in one of the three, or with a null or non-finite component, take no part; nor do
    those with a component of 2**20 or more, whose scores would not fit 64 bits. Shorter vectors
    count as ending with zeros. Rows repeated with one ``vec_id`` are rows of their own: an anchor's other rows
    are all but itself, and each repeated anchor row has its own result. Equal scores go by
    ``vec_id``. Anchors without positives or negatives in their windows give no rows; an empty table
    gives none. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    vectors = stored(arrow_map(embeddings.select("vec_id", "embedding", "label"), _clean, VECTORS), "vectors")
    ranges = arrow_map(vectors.select("q"), _ranges, "place int, lo long, hi long").groupBy("place").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    spans = ranges.where("place >= 0").orderBy("place").collect()  # one row per dimension
    lo, hi = (np.array([s[c] for s in spans] or [0], np.int64) for c in ("lo", "hi"))
    dim = len(lo)
    keyed = arrow_map(vectors, partial(_keys, lo=lo, hi=hi), VECTORS + ", key binary")
    parts = max(1, -(-vectors.count() // (block_rows * group_blocks)))
    ordered = keyed.repartitionByRange(parts, "label", "key", "vec_id", "row").sortWithinPartitions("label", "key", "vec_id", "row")
    cut = partial(_blocks, dim=dim, block_rows=block_rows, group_blocks=group_blocks)
    blocks = stored(arrow_map(ordered.drop("key"), cut, BLOCKS), "vector-blocks")
    anchors = blocks.select("label", "rows", "ids", "q", "dim")
    chunks = stored(arrow_map(anchors, partial(_chunks, most=chunk_anchors), CHUNKS), "anchors")

    def first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "row"))
        return found.withColumn("n", place).where(F.col("n") <= k)

    positives = first(_passes(chunks, blocks, False), ["anchor_row"], POSITIVES)
    windows = positives.groupBy("chunk").agg(F.collect_list(F.struct("place", F.col("n").alias("rank"), "score", "vec_id")).alias("windows"))
    aimed = stored(chunks.join(windows, "chunk"), "anchors")
    negatives = first(_passes(aimed, blocks, True), ["anchor_row", "rank"], NEGATIVES)
    return negatives.select(
        "anchor_id", "positive_id", F.col("n").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
