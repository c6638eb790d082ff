"""Prefix trie of conversations, with subtree totals by time-forward processing.

Every node is named by the hash of its path (SHA-256 of its parent's name, role and text; 128 bits),
so equal prefixes meet by one key and no text is shuffled after the first pass.

Totals go from the leaves to the root. Nodes are dealt into shards of bounded size by path order, so
that a subtree lies together but a hot prefix spreads over as many shards as it needs. Inside a
shard, nodes come in reverse level order (an external sort); each sends its total forward to the
moment when its parent is processed, through a priority queue that spills sorted runs. What is
addressed to a parent outside the shard is summed per parent: these shard roots form a small
tree of their own (a shard sends to ancestors of its first node only, as far as ``KEY_TURNS`` goes), which
is processed the same way. A last pass adds what came from outside to the nodes above it.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, arrow_map, columns_of, stored

FAMILY = 20  # conversations of a family share the opening of its first one
OPENINGS = 4  # of which they take 0 to 3 turns
KEY_TURNS = 32  # turns that decide the place of a node in the path order; below, nodes go by conversation
SHARD_ROWS = 20_000
QUEUE_MESSAGES = 200_000  # messages a queue holds in memory
ID_RANGE = 1 << 14  # conversations whose ids are joined in one piece
ROOT = bytes(16)
NO_IDS = hashlib.sha256(b"").hexdigest()

TURNS = "conv_id long, depth int, node binary, parent binary, key binary, words long, last boolean"
TURN_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("depth", pa.int32()), ("node", pa.binary()), ("parent", pa.binary()), ("key", pa.binary()),
     ("words", pa.int64()), ("last", pa.bool_())]
)


def opening_turns(conv_id: int) -> int:
    return zlib.crc32(str(conv_id).encode()) % OPENINGS


def child_name(parent: bytes, role: bytes, text: bytes) -> bytes:
    return hashlib.sha256(parent + len(role).to_bytes(8, "big") + role + text).digest()[:16]


def _paths(batches: Batches) -> Batches:
    """Rebuilt turns of each conversation as trie nodes; rows come by family, its first conversation ahead."""
    out: list[tuple] = []
    family, opening = None, []
    conv, seen, skip = None, 0, 0
    path: tuple = (ROOT, None, b"", 0, 0)  # node, parent, key, words, depth

    def step(role: bytes, text: bytes) -> None:
        nonlocal path
        node, _, key, _, depth = path
        emit(False)
        name = child_name(node, role, text)
        path = (name, node, key + name[:8] if depth < KEY_TURNS else key, len(text.split()), depth + 1)

    def emit(last: bool) -> None:
        node, parent, key, words, depth = path
        out.append((conv, depth, node, parent, key, words, last))

    def begin(family_id: int, conv_id: int) -> None:
        nonlocal family, opening, conv, seen, skip, path
        if family != family_id:
            family, opening = family_id, []
        conv, seen, skip, path = conv_id, 0, opening_turns(conv_id), (ROOT, None, b"", 0, 0)
        if conv_id != family_id:
            for role, text in opening[:skip]:
                step(role, text)
        else:
            skip = 0  # it keeps its own opening

    def flush() -> pa.RecordBatch:
        batch = columns_of(TURN_SCHEMA, **dict(zip(TURN_SCHEMA.names, map(list, zip(*out)))))
        out.clear()
        return batch

    for batch in batches:
        families, ids = batch.column("family").to_pylist(), batch.column("conv_id").to_pylist()
        roles, texts = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("role", "text"))
        for f, c, role, text in zip(families, ids, roles, texts):
            if c != conv:
                if conv is not None:
                    emit(True)
                begin(f, c)
            if c == f and len(opening) < OPENINGS - 1:
                opening.append((role, text))
            seen += 1
            if seen > skip:
                step(role, text)
            if len(out) >= 10_000:
                yield flush()
    if conv is not None:
        emit(True)
    if out:
        yield flush()


def paths(conversations: DataFrame) -> DataFrame:
    """Every prefix of every rebuilt conversation: ``TURNS``. One shuffle, by family."""
    conv = F.col("conv_id").cast("long")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        (conv - conv % FAMILY).alias("family"), conv.alias("conv_id"), F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    order = ["family", F.col("conv_id") != F.col("family"), "conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    ordered = rows.repartition("family").sortWithinPartitions(*order)
    return arrow_map(ordered.select("family", "conv_id", "role", "text"), _paths, TURNS)


def _digests(batches: Batches) -> Batches:
    """One hash per node over its pieces of ids, which come in order."""
    schema = pa.schema([("node", pa.binary()), ("ends", pa.string())])
    node, digest, done = None, None, []
    for batch in batches:
        for name, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if name == node:
                digest.update(b"," + ids.encode())
                continue
            if node is not None:
                done.append((node, digest.hexdigest()))
            node, digest = name, hashlib.sha256(ids.encode())
        if len(done) >= 10_000:
            yield columns_of(schema, node=[d[0] for d in done], ends=[d[1] for d in done])
            done = []
    if node is not None:
        done.append((node, digest.hexdigest()))
        yield columns_of(schema, node=[d[0] for d in done], ends=[d[1] for d in done])


def ends_of(turns: DataFrame) -> DataFrame:
    """``node, ends``: the digest of the ids of the conversations that end at a node.

    Ids are joined in pieces of one range of numbers each, in as many tasks as there are pieces;
    the task of a node reads whole pieces.
    """
    piece = F.shiftright("conv_id", ID_RANGE.bit_length() - 1).alias("piece")
    pieces = turns.where("last").groupBy("node", piece).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    return arrow_map(pieces.repartition("node").sortWithinPartitions("node", "piece").select("node", "ids"), _digests, "node binary, ends string")


class MessageQueue:
    """Priority queue of (place, leaves, saved); beyond ``most`` messages it writes sorted runs to temporary files.

    The files belong to one task attempt: they are anonymous and vanish with it.
    """

    def __init__(self, most: int = QUEUE_MESSAGES):
        self.most, self.heap, self.runs, self.n_runs = most, [], [], 0

    def push(self, place: tuple, leaves: int, saved: int) -> None:
        heapq.heappush(self.heap, (place, leaves, saved))
        if len(self.heap) > self.most:
            run = tempfile.TemporaryFile()
            for k in range(0, len(ordered := sorted(self.heap)), 1000):
                pickle.dump(ordered[k : k + 1000], run)
            run.seek(0)
            self.heap = []
            self.n_runs += 1
            stream = _read(run)
            heapq.heappush(self.runs, (next(stream), self.n_runs, stream))

    def first(self) -> tuple | None:
        """Place of the next message."""
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0][0]
        return self.heap[0][0] if self.heap else None

    def take(self) -> tuple[int, int]:
        """Sum of all messages of the next place, which leave the queue."""
        place, leaves, saved = self.first(), 0, 0
        while self.first() == place:
            if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
                message, k, stream = heapq.heappop(self.runs)
                if (following := next(stream, None)) is not None:
                    heapq.heappush(self.runs, (following, k, stream))
            else:
                message = heapq.heappop(self.heap)
            leaves, saved = leaves + message[1], saved + message[2]
        return leaves, saved


def _read(run) -> Iterator[tuple]:
    with run:
        while True:
            try:
                yield from pickle.load(run)
            except EOFError:
                return


NODES = (
    "shard int, kind int, node binary, parent binary, conv_id long, depth int, n_convs long, n_children long, words long, ends string,"
    " parent_conv_id long, exit binary, exit_depth int, leaves long, saved long"
)
NODE_SCHEMA = pa.schema(
    [("shard", pa.int32()), ("kind", pa.int32()), ("node", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()),
     ("depth", pa.int32()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("words", pa.int64()), ("ends", pa.string()),
     ("parent_conv_id", pa.int64()), ("exit", pa.binary()), ("exit_depth", pa.int32()), ("leaves", pa.int64()), ("saved", pa.int64())]
)
NODE, OUT, CONV = 2, 1, 0  # kinds of rows: a node, a total for a parent outside the shard, that parent's conversation
FIRST = 2**31 - 1  # depth that sorts ahead of all nodes of a shard


def _shards(batches: Batches, most: int) -> Batches:
    """First pass over a shard: what leaves it, and through which parent each node's total would leave."""
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId()
    queue, rows, outside = MessageQueue(most), [], []

    def emit_before(place: tuple | None) -> None:
        while (nxt := queue.first()) is not None and (place is None or nxt < place):
            leaves, saved = queue.take()
            outside.append({"shard": shard, "kind": OUT, "node": nxt[1], "depth": -nxt[0], "leaves": leaves, "saved": saved})

    for batch in batches:
        for r in batch.to_pylist():
            place = (-r["depth"], r["node"])
            emit_before(place)
            leaves, saved = queue.take() if queue.first() == place else (0, 0)
            leaves += r["n_children"] == 0
            saved += (r["n_convs"] - 1) * r["words"]
            if r["parent"] is not None:
                queue.push((1 - r["depth"], r["parent"]), leaves, saved)
            rows.append(r)
    emit_before(None)
    known: dict[bytes, tuple] = {}
    for r in reversed(rows):  # parents ahead of children
        above = known.get(r["parent"])
        if above is not None:
            r["parent_conv_id"], r["exit"], r["exit_depth"] = above
        elif r["parent"] is not None:
            r["parent_conv_id"], r["exit"], r["exit_depth"] = None, r["parent"], r["depth"] - 1
        known[r["node"]] = (r["conv_id"], r.get("exit"), r.get("exit_depth"))
        r["shard"], r["kind"] = shard, NODE
    for part in (rows, outside):
        for k in range(0, len(part), 10_000):
            yield pa.RecordBatch.from_pylist(part[k : k + 10_000], schema=NODE_SCHEMA)


def _roots(batches: Batches, most: int) -> Batches:
    """Totals of the shard roots: a root is a shard and the outside parent that it sends to."""
    queue, done = MessageQueue(most), []
    for batch in batches:
        for r in batch.to_pylist():
            place = (-r["depth"], r["node"], r["from_shard"])
            leaves, saved = queue.take() if queue.first() == place else (0, 0)
            leaves, saved = leaves + r["leaves"], saved + r["saved"]
            if r["exit"] is not None:
                queue.push((-r["exit_depth"], r["exit"], r["shard"]), leaves, saved)
            done.append({"shard": r["shard"], "kind": OUT, "node": r["node"], "depth": r["depth"], "leaves": leaves, "saved": saved})
            done.append({"shard": r["from_shard"], "kind": CONV, "node": r["node"], "depth": FIRST, "conv_id": r["conv_id"]})
        if len(done) >= 10_000:
            yield pa.RecordBatch.from_pylist(done, schema=NODE_SCHEMA)
            done = []
    if done:
        yield pa.RecordBatch.from_pylist(done, schema=NODE_SCHEMA)


TRIE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long,"
    " ends_sha256 string"
)
TRIE_SCHEMA = pa.schema(
    [(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string())]
)


def _totals(batches: Batches, most: int) -> Batches:
    """Last pass: totals of every node, with what came from other shards. A task may hold several shards."""
    shard, queue, convs, came, out = None, MessageQueue(most), {}, {}, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["shard"] != shard:
                shard, queue, convs, came = r["shard"], MessageQueue(most), {}, {}
            if r["kind"] == CONV:
                convs[r["node"]] = r["conv_id"]
                continue
            place = (-r["depth"], r["node"])
            if r["kind"] == OUT:  # stands right before its node
                queue.push(place, r["leaves"], r["saved"])
                continue
            while (nxt := queue.first()) is not None and nxt < place:
                queue.take()  # for a parent in another shard, which has it already
            leaves, saved = queue.take() if queue.first() == place else (0, 0)
            leaves += r["n_children"] == 0
            saved += (r["n_convs"] - 1) * r["words"]
            above = r["parent_conv_id"]
            if r["parent"] is not None:
                queue.push((1 - r["depth"], r["parent"]), leaves, saved)
                above = convs[r["parent"]] if above is None else above
            out.append(
                {"conv_id": r["conv_id"], "depth": r["depth"], "parent_conv_id": above, "n_convs": r["n_convs"],
                 "n_children": r["n_children"], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": r["ends"] or NO_IDS}
            )
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_pylist(out, schema=TRIE_SCHEMA)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=TRIE_SCHEMA)


def prefix_trie(conversations: DataFrame, shard_rows: int = SHARD_ROWS, most: int = QUEUE_MESSAGES) -> DataFrame:
    """Trie of the rebuilt ``conversations`` (``conv_id``, ``turn``, ``role``, ``text``), one row a node: ``TRIE``.

    Turns are ordered by ``turn`` (null first), equal ones by role and text; repeated rows are
    turns of their own. Null roles and texts are empty, rows without a ``conv_id`` belong to no
    conversation and are ignored, and so are other columns. Texts of any length only enter a hash
    and a word count. A conversation may have no turns after the rebuild and then ends at the root.
    An empty table has no nodes, not even a root. A family is streamed through one task in bounded memory.
    """
    turns = stored(paths(conversations), "trie-turns")
    nodes = turns.groupBy("node", "depth", "parent", "key", "words").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")
    )
    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    full = nodes.join(children, "node", "left").join(ends_of(turns), "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    shards = max(1, -(-turns.count() // shard_rows))
    dealt = (
        full.repartitionByRange(shards, "key", "conv_id", "depth")
        .sortWithinPartitions(F.desc("depth"), "node")
        .drop("key")
    )
    sharded = stored(arrow_map(dealt, partial(_shards, most=most), NODES), "trie-shards")
    is_node = F.col("kind") == NODE
    outside = sharded.where(F.col("kind") == OUT).select(F.col("shard").alias("from_shard"), "node", "leaves", "saved")
    targets = sharded.where(is_node).select("node", "shard", "conv_id", "depth", "exit", "exit_depth")
    roots = outside.join(targets, "node").repartition(1).sortWithinPartitions(F.desc("depth"), "node", "from_shard")
    passed = stored(arrow_map(roots, partial(_roots, most=most), NODES), "trie-roots")
    everything = sharded.where(is_node).unionByName(passed)
    ordered = everything.repartition("shard").sortWithinPartitions("shard", F.desc("depth"), "node", "kind")
    return arrow_map(ordered, partial(_totals, most=most), TRIE)
