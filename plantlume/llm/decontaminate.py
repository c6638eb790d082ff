"""Benchmark decontamination.

Normalised test n-grams form a hash set that is broadcast; every document is scanned once, window
by window, and a hit in the set is verified word by word before it counts. No row is shuffled.

The set has a fixed bound. A benchmark with more windows is split into blocks within the bound;
each block scans all documents, and the blocks' hits are combined per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, Batches, arrow_map, arrow_type, stored

N = 13
BLOCK_WINDOWS = 1_000_000  # about 100 MB of set at most
_KEEP = bytes(
    LOWER[UPPER.index(b)] if b in UPPER else b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    """ASCII letters in lower case, digits and all characters beyond ASCII make words."""
    return (text or b"").translate(_KEEP).split()


@dataclass
class Windows:
    """Hash set of test windows, by window length, over a vocabulary of the test words."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    by_length: dict[int, dict[tuple[int, ...], set]] = field(default_factory=dict)

    def add(self, item_id, words: list[bytes], n: int) -> None:
        ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
        k = min(n, len(ids))
        for i in range(len(ids) - k + 1 if k else 0):
            self.by_length.setdefault(k, {}).setdefault(tuple(ids[i : i + k]), set()).add(item_id)

    def __len__(self) -> int:
        return sum(map(len, self.by_length.values()))


def _hash(ids: np.ndarray, length: int) -> np.ndarray:
    """Rolling hash of every window of ``length`` ids."""
    n = len(ids) - length + 1
    h = np.zeros(n, np.uint64)
    for k in range(length):
        h = h * _BASE + ids[k : k + n]
    return h ^ (h >> np.uint64(29))


class Scanner:
    """The windows made ready for scans: a bit table over the hashes in front of the exact set."""

    BITS = 22

    def __init__(self, windows: Windows):
        self.windows = windows
        self.tables = {}
        for length, found in windows.by_length.items():
            hashes = _hash_rows(np.array(list(found), np.uint64).reshape(len(found), length))
            bits = np.zeros(1 << self.BITS, bool)
            bits[hashes >> np.uint64(64 - self.BITS)] = True
            self.tables[length] = bits

    def scan(self, texts: list[bytes | None]) -> Iterator[tuple[int, list[tuple[int, int]], set]]:
        """For every text: number of words, hit word ranges (merged, end exclusive), items found."""
        find = self.windows.vocabulary.get
        words = [words_of(t) for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
        # ids from 1; 0: not a test word, or the gap behind a text, so no window crosses texts
        ids = np.fromiter((i for w in words for i in (*[find(x, -1) + 1 for x in w], 0)), np.uint64, int(starts[-1]))
        hits: dict[int, list[tuple[int, int, set]]] = {}
        blank = np.concatenate([[0], np.cumsum(ids == 0)])
        for length, bits in self.tables.items():
            if len(ids) < length:
                continue
            full = np.flatnonzero(blank[length:] == blank[:-length])
            if not len(full):
                continue
            h = np.zeros(len(full), np.uint64)
            for k in range(length):
                h = h * _BASE + ids[full + k]
            h ^= h >> np.uint64(29)
            known = self.windows.by_length[length]
            for at in full[bits[h >> np.uint64(64 - self.BITS)]].tolist():
                items = known.get(tuple((ids[at : at + length] - np.uint64(1)).tolist()))  # the check of the words themselves
                if items:
                    doc = int(np.searchsorted(starts, at, "right")) - 1
                    first = at - int(starts[doc])
                    hits.setdefault(doc, []).append((first, first + length, items))
        for doc, w in enumerate(words):
            spans: list[tuple[int, int]] = []
            items: set = set()
            for a, b, found in sorted(hits.get(doc, ()), key=lambda x: x[:2]):
                items |= found
                if spans and a <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
                else:
                    spans.append((a, b))
            yield len(w), spans, items


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        h = h * _BASE + (rows[:, k] + np.uint64(1))
    return h ^ (h >> np.uint64(29))


def blocks(benchmark: DataFrame, n: int, most: int) -> Iterator[Windows]:
    """Windows of the benchmark (``item_id``, ``text``) in sets of about ``most`` windows.

    Items stream through the driver one partition at a time; only one block is held.
    """
    block = Windows()
    for row in benchmark.select("item_id", "text").toLocalIterator():
        block.add(row["item_id"], words_of((row["text"] or "").encode()), n)
        if len(block) >= most:
            yield block
            block = Windows()
    yield block


def _scan(batches: Batches, shared, schema: pa.Schema) -> Batches:
    scanner = Scanner(shared.value)
    for batch in batches:
        for at in range(0, batch.num_rows, 250):
            part = batch.slice(at, 250)
            found = list(scanner.scan(part.column("text").cast(pa.binary()).to_pylist()))
            arrays = [part.column(name) for name in part.schema.names if name != "text"]
            arrays += [
                pa.array([f[0] for f in found], pa.int64()),
                pa.array([[{"first": a, "end": b} for a, b in f[1]] for f in found], schema.field("spans").type),
                pa.array([sorted(str(i) for i in f[2] if i is not None) for f in found], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = N, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Test passages in every row of ``docs`` (``doc_id``, ``text``).

    Returns ``doc_id, n_words, spans, items``: the hit word ranges (merged; ``first`` and ``end``,
    end exclusive, count words from 0) and the ids, as sorted strings, of the items with a window
    in the document. A window is ``n`` consecutive words of an item, or all words of a shorter one.
    Null and empty texts have no words; an item without words has no window, and one without an
    id hits words but is not listed. Repeated rows are judged each; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType
    span = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("spans", span), T.StructField("items", T.ArrayType(T.StringType()))]
    sets = list(_shared(docs, benchmark, n, block_windows))

    def scan(rows: DataFrame, lead: list[T.StructField], shared) -> DataFrame:
        out = T.StructType(lead + fields)
        schema = pa.schema([pa.field(f.name, arrow_type(f.dataType)) for f in out.fields])
        return arrow_map(rows, partial(_scan, shared=shared, schema=schema), out)

    lead = [T.StructField("doc_id", kind)]
    if len(sets) == 1:
        return scan(docs.select("doc_id", "text"), lead, sets[0])
    # Rows get numbers once, so that the blocks' results of a row meet.
    numbered = stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "decontaminate")
    lead = [T.StructField("row", T.LongType()), T.StructField("doc_id", kind)]
    parts = [scan(numbered, lead, s) for s in sets]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("raw"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    ).select("doc_id", "n_words", _merged(F.col("raw")).alias("spans"), "items")


def _shared(docs: DataFrame, benchmark: DataFrame, n: int, most: int) -> Iterator:
    for block in blocks(benchmark, n, most):
        yield docs.sparkSession.sparkContext.broadcast(block)


def _merged(raw):
    """Sorted ranges, overlapping and touching ones joined (there is one array per block and row)."""
    def step(done, x):
        last = F.element_at(done, -1)
        joined = F.concat(
            F.slice(done, 1, F.size(done) - 1),
            F.array(F.struct(last["first"].alias("first"), F.greatest(last["end"], x["end"]).alias("end"))),
        )
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= x["first"]), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(raw, F.slice(raw, 1, 0), step)


def hit_words(spans) -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])


def _clean(batches: Batches, shared, share: float, spans_only: bool) -> Batches:
    scanner = Scanner(shared.value)
    for batch in batches:
        for at in range(0, batch.num_rows, 250):
            part = batch.slice(at, 250)
            texts = part.column("text").to_pylist()
            found = list(scanner.scan([None if t is None else t.encode() for t in texts]))
            if spans_only:
                new = [without_words(t, f[1]) if f[1] else t for t, f in zip(texts, found)]
                k = part.schema.get_field_index("text")
                yield part.set_column(k, part.schema.field(k), pa.array(new, part.schema.field(k).type))
            else:
                bad = [bool(f[1]) and sum(b - a for a, b in f[1]) / f[0] >= share for f in found]
                yield part.filter(pa.array([not b for b in bad], pa.bool_()))


def _cut_spans(batches: Batches, schema: pa.Schema) -> Batches:
    for batch in batches:
        spans = batch.column("__spans").to_pylist()
        texts = [without_words(t, [(x["first"], x["end"]) for x in s]) if s else t for t, s in zip(batch.column("text").to_pylist(), spans)]
        yield pa.RecordBatch.from_arrays([pa.array(texts, f.type) if f.name == "text" else batch.column(f.name) for f in schema], schema=schema)


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the hit words and what stands between them."""
    raw = text.encode()
    plain = raw.translate(_KEEP)
    codes = np.frombuffer(plain, np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate([[False], codes, [False]]).astype(np.int8)))
    begins, ends = edges[::2], edges[1::2]
    out, done = [], 0
    for a, b in spans:
        out.append(raw[done : begins[a]])
        done = ends[b - 1]
    out.append(raw[done:])
    return b"".join(out).decode()


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, n: int = N, share: float = 0.05, remove: str = "documents", block_windows: int = BLOCK_WINDOWS
) -> DataFrame:
    """``docs`` with all columns, free of test passages.

    ``remove="documents"`` drops a row if at least ``share`` of its words (and one at least) are
    hit; ``remove="spans"`` keeps every row and cuts the hit words out of its text. Of a benchmark of
    several blocks the combined hits on the original text count.
    """
    spans_only = remove == "spans"
    sets = list(_shared(docs, benchmark, n, block_windows))
    if len(sets) > 1:
        numbered = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "decontaminate-rows")
        # The row number stands in for the id, so that the scan's result can be joined to the row.
        found = find_contamination(numbered.select(F.col("__row").alias("doc_id"), "text"), benchmark, n, block_windows)
        if spans_only:
            spans = found.where(F.size("spans") > 0).select(F.col("doc_id").alias("__row"), F.col("spans").alias("__spans"))
            schema = pa.schema([pa.field(f.name, arrow_type(f.dataType)) for f in docs.schema.fields])
            return arrow_map(numbered.join(spans, "__row", "left").drop("__row"), partial(_cut_spans, schema=schema), docs.schema)
        hits = hit_words(F.col("spans"))
        bad = found.where((hits > 0) & (F.try_divide(hits, F.col("n_words")) >= share)).select(F.col("doc_id").alias("__row"))
        return numbered.join(bad, "__row", "left_anti").select(*docs.columns)
    return arrow_map(docs, partial(_clean, shared=sets[0], share=share, spans_only=spans_only), docs.schema)


def items_digest(items) -> F.Column:
    return F.sha2(F.concat_ws(",", items), 256)


def sha256_of_items(items: list[str]) -> str:
    """The same in plain Python, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
