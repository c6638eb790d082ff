"""Exact deduplication by Grace hashing over complete contents.

Spark's shuffle is the first partitioning. Before it, every task collapses its own copies in an
open-addressing table, so a text that fills a third of the table travels once per task. Behind it,
a task inserts the contents of its partition into such a table; if they outgrow the memory given,
they go to spill files by the next bits of their hash, and every file is treated alike one level
deeper. Two records meet only if their complete contents are equal byte for byte; the hash merely
finds the slot.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, Batches, arrow_map, arrow_schema, arrow_type, columns_of, row_numbers, stored

FANOUT_BITS = 4
DEEPEST = 16  # 64 bits of the hash; below that one table takes what is left
MAP_MEMORY = 32 << 20
REDUCE_MEMORY = 64 << 20
MEMBER_BYTES = 200


def normal_form(text: bytes | None) -> bytes:
    """The content compared: the text without ASCII white space; null counts as empty."""
    return (text or b"").translate(None, SPACES)


@dataclass
class ContentTable:
    """Open addressing with linear probing; a slot matches only if the whole content is equal."""

    slots: np.ndarray = field(default_factory=lambda: np.full(1024, -1, np.int64))
    hashes: list[bytes] = field(default_factory=list)
    contents: list[bytes] = field(default_factory=list)
    nbytes: int = 0

    def find(self, digest: bytes, content: bytes) -> tuple[int, bool]:
        """Number of the content, and whether it is new."""
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[-8:], "big") & mask
        while (k := self.slots[at]) >= 0:
            if self.hashes[k] == digest and self.contents[k] == content:
                return int(k), False
            at = (at + 1) & mask
        self.slots[at] = k = len(self.contents)
        self.hashes.append(digest)
        self.contents.append(content)
        self.nbytes += len(content) + 200
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return k, True

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, np.int64)
        mask = len(self.slots) - 1
        for k, digest in enumerate(self.hashes):
            at = int.from_bytes(digest[-8:], "big") & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


def _rank(chars: int, doc_id, row: int) -> tuple:
    """The row with the least rank stays: longest text, then smallest id (null last), then first row."""
    return (-chars, doc_id is None, 0 if doc_id is None else doc_id, row)


def _collapse(batches: Batches, id_type, row_type, memory: int) -> Batches:
    """Rows of a task, each with the number of its local representative, and the distinct contents."""
    schema = pa.schema(
        [("doc_id", id_type), ("row", pa.int64()), ("rep", pa.int64()), ("sha", pa.binary()), ("copies", pa.int64()),
         ("chars", pa.int64()), ("best_id", id_type), ("best_row", pa.int64()), ("best", row_type)]
    )

    def flush(contents: ContentTable, held: list[list]) -> pa.RecordBatch:
        n = len(held)
        ranks = [h[2] for h in held]
        return columns_of(
            schema, doc_id=[None] * n, row=[None] * n, rep=[h[0] for h in held], sha=contents.hashes,
            copies=[h[1] for h in held], chars=[-r[0] for r in ranks],
            best_id=[None if r[1] else r[2] for r in ranks], best_row=[r[3] for r in ranks], best=[h[3] for h in held],
        )

    seen, contents, held = 0, ContentTable(), []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = row_numbers(seen, batch.num_rows)
        seen += batch.num_rows
        ids = batch.column("doc_id").to_pylist()
        texts = batch.column("text")
        chars = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
        whole = None
        reps = []
        for i, text in enumerate(texts.cast(pa.binary()).to_pylist()):
            content = normal_form(text)
            k, new = contents.find(hashlib.sha256(content).digest(), content)
            rank = _rank(chars[i], ids[i], rows[i])
            if new:
                held.append([rows[i], 0, None, None])
            entry = held[k]
            entry[1] += 1
            if entry[2] is None or rank < entry[2]:
                whole = whole or batch
                entry[2], entry[3] = rank, whole.slice(i, 1).to_pylist()[0]
                if new:
                    contents.nbytes += len(text or b"")
            reps.append(entry[0])
        n = batch.num_rows
        yield columns_of(
            schema, doc_id=batch.column("doc_id"), row=list(rows), rep=reps, sha=[None] * n, copies=[None] * n,
            chars=[None] * n, best_id=[None] * n, best_row=[None] * n, best=[None] * n,
        )
        if contents.nbytes > memory:
            yield flush(contents, held)
            contents, held = ContentTable(), []
    if held:
        yield flush(contents, held)


#: of a content: digest, content, [representative, copies, rank of the best row, its columns] of each task that had it
Record = tuple[bytes, bytes, list]


def grace(records: Iterator[Record], memory: int, level: int = 0) -> Iterator[tuple[bytes, list]]:
    """Classes of equal contents: digest and the members of each.

    At most ``memory`` bytes of distinct contents, members and best rows are held; beyond that all records
    go to 16 spill files of this task, by the next four bits of their digest, and each file is a run of
    its own. The best member of a class comes first and alone keeps its columns.
    """
    contents, members, files = ContentTable(), [], None

    def join(known: list, found: list) -> None:
        for m in found:
            if m[2] < known[0][2]:
                known[0], m = m, known[0]
            known.append((*m[:3], None))

    def spill(record: Record) -> None:
        bit = FANOUT_BITS * level
        word = int.from_bytes(record[0][:8], "big") >> (64 - FANOUT_BITS - bit)
        pickle.dump(record, files[word & ((1 << FANOUT_BITS) - 1)], protocol=pickle.HIGHEST_PROTOCOL)

    for digest, content, found in records:
        if files is not None:
            spill((digest, content, found))
            continue
        k, new = contents.find(digest, content)
        if new:
            members.append(found)
            contents.nbytes += len(content) * (found[0][3] is not None)
        else:
            join(members[k], found)
        contents.nbytes += MEMBER_BYTES * len(found)
        if contents.nbytes > memory and level < DEEPEST and len(members) > 1:
            files = [tempfile.TemporaryFile() for _ in range(1 << FANOUT_BITS)]
            for k, rows in enumerate(members):
                spill((contents.hashes[k], contents.contents[k], rows))
            contents, members = ContentTable(), []
    for k, rows in enumerate(members):
        yield contents.hashes[k], rows
    for f in files or ():
        with f:
            f.seek(0)
            yield from grace(_read(f), memory, level + 1)


def _read(f) -> Iterator[Record]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def _classes(batches: Batches, schema: pa.Schema, with_rows: bool, memory: int) -> Batches:
    def records() -> Iterator[Record]:
        for batch in batches:
            for r in batch.to_pylist():
                content = normal_form((r["best"]["text"] or "").encode())
                rank = _rank(r["chars"], r["best_id"], r["best_row"])
                yield r["sha"], content, [(r["rep"], r["copies"], rank, r["best"] if with_rows else None)]

    out, held = [], 0
    for digest, found in grace(records(), memory):
        best = found[0]
        size, (_, null, keep_id, keep_row) = sum(m[1] for m in found), best[2]
        for rep, _, _, row in found:
            out.append({"rep": rep, "keep_id": None if null else keep_id, "keep_row": keep_row, "group_size": size, "sha": digest.hex()})
            if with_rows:
                out[-1]["best"] = row if rep == best[0] else None
                held += len((row or {}).get("text") or "") if rep == best[0] else 0
        if len(out) >= 2000 or held > 8 << 20:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _run(docs: DataFrame, with_rows: bool, map_memory: int, memory: int) -> tuple[DataFrame, DataFrame]:
    """Stored local collapse, and the classes per local representative."""
    id_kind = docs.schema["doc_id"].dataType
    row_kind = docs.schema
    collapsed_schema = T.StructType(
        [T.StructField("doc_id", id_kind), T.StructField("row", T.LongType()), T.StructField("rep", T.LongType()),
         T.StructField("sha", T.BinaryType()), T.StructField("copies", T.LongType()), T.StructField("chars", T.LongType()),
         T.StructField("best_id", id_kind), T.StructField("best_row", T.LongType()), T.StructField("best", row_kind)]
    )
    local = partial(_collapse, id_type=arrow_type(id_kind), row_type=arrow_type(row_kind), memory=map_memory)
    collapsed = stored(arrow_map(docs, local, collapsed_schema), "exact")
    fields = [
        T.StructField("rep", T.LongType()), T.StructField("keep_id", id_kind), T.StructField("keep_row", T.LongType()),
        T.StructField("group_size", T.LongType()), T.StructField("sha", T.StringType()),
    ] + [T.StructField("best", row_kind)] * with_rows
    schema = T.StructType(fields)
    contents = (
        collapsed.where(F.col("sha").isNotNull())
        .select("rep", "sha", "copies", "chars", "best_id", "best_row", "best")
        .repartition("sha")
    )
    return collapsed, arrow_map(contents, partial(_classes, schema=arrow_schema(schema), with_rows=with_rows, memory=memory), schema)


def exact_groups(docs: DataFrame, map_memory: int = MAP_MEMORY, memory: int = REDUCE_MEMORY) -> DataFrame:
    """Group of every row of ``docs`` (``doc_id``, ``text``): ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal if they are the same without ASCII white space. The row with the most code
    points stays, then the smallest ``doc_id``. Null texts are empty, all empty texts are one
    group. Rows repeated with one ``doc_id`` count as rows, and one of them is kept; a null
    ``doc_id`` ranks last. No rows give no rows; other columns are ignored.
    """
    collapsed, classes = _run(docs.select("doc_id", "text"), False, map_memory, memory)
    rows = collapsed.where(F.col("row").isNotNull()).select("doc_id", "row", "rep")
    return rows.join(classes, "rep").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def deduplicate(docs: DataFrame, map_memory: int = MAP_MEMORY, memory: int = REDUCE_MEMORY) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns (see ``exact_groups``).

    The best row of each content travels with it, so no join brings the columns back.
    """
    _, classes = _run(docs, True, map_memory, memory)
    kept = classes.where(F.col("best").isNotNull())
    return kept.select(*[F.col("best").getField(c).alias(c) for c in docs.columns])
