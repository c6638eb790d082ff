"""Language identification by compression.

Each language has a zstandard dictionary of raw content taken from its texts. A text is encoded
with every dictionary, and the language whose dictionary makes it smallest is chosen. If the
second smallest is nearly as small, the choice is rejected.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batches, arrow_map, arrow_type
from ..operators.ordering import top_per_group

UNKNOWN = "und"
SAMPLE_ROWS = 400  # labelled texts per language, in the order of a hash of the id
DICTIONARY_BYTES = 96 << 10
ALL_DICTIONARIES = 48 << 20  # shared by all languages, if they are more than 512
BLOCK_LANGUAGES = 256  # encoders held at once; more languages are tried block by block
BLOCK_SIZES = 1 << 20  # encoded sizes held at once
PIECE = 4 << 10  # a text is encoded in pieces, each with the dictionary at hand, and the sizes summed
LEVEL = 3
MARGIN = 0.02  # rejected if the second smallest is less than this share larger


def learn(docs: DataFrame, usable: Column, sample_rows: int = SAMPLE_ROWS, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Dictionaries by language from rows of ``docs`` that are ``usable`` and have ``lang`` and text.

    At most ``sample_rows`` texts a language that are not empty are joined into at most ``size`` bytes: an
    equal share of each from a place within it, so one long text can't fill the dictionary. Every
    language gets a dictionary; very many share ``ALL_DICTIONARIES`` bytes, 1 KB each at least. Only
    the finished dictionaries reach the driver.
    """
    place = F.xxhash64(F.col("doc_id").cast("string"), F.lit(4))
    known = docs.where(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.octet_length("text") > 0))
    languages = known.select("lang").distinct().count()
    size = max(min(size, ALL_DICTIONARIES // max(1, languages)), min(size, 1 << 10))
    chosen = top_per_group(known.select("doc_id", "lang").distinct(), ["lang"], [place, F.col("doc_id")], sample_rows)
    rows = known.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("content", T.BinaryType())])

    def build(key, frame):
        import pandas as pd

        texts = [t.encode() for t in frame.sort_values("doc_id")["text"]]
        return pd.DataFrame({"lang": [key[0]], "content": [raw_content(texts, size)]})

    # at most sample_rows texts a group
    found = rows.groupBy("lang").applyInPandas(build, schema).where(F.length("content") > 0)
    return {r["lang"]: bytes(r["content"]) for r in sorted(found.collect(), key=lambda r: r["lang"])}


def raw_content(texts: list[bytes], size: int) -> bytes:
    """Equal shares of the texts, short ones whole; the middle part of long ones."""
    lengths = np.sort([len(t) for t in texts])
    left, share = size, size
    for i, n in enumerate(lengths):
        share = left // (len(lengths) - i)
        if n > share:
            break
        left -= int(n)
    cut = [t if len(t) <= share else t[(len(t) - share) // 2 :][:share] for t in texts]
    return b"\n".join(cut)[:size]


def _encoders(dictionaries: list[bytes]) -> list[zstd.ZstdCompressor]:
    out = []
    for content in dictionaries:
        d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append(zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
    return out


def _sizes(texts: list[bytes], dictionaries: list[bytes], first: list[zstd.ZstdCompressor]) -> np.ndarray:
    """Encoded size of each text (rows) with each dictionary; ``first`` are the encoders of the first block."""
    out = np.empty((len(texts), len(dictionaries)))
    for lo in range(0, len(dictionaries), BLOCK_LANGUAGES):
        encoders = _encoders(dictionaries[lo : lo + BLOCK_LANGUAGES]) if lo else first
        for row, raw in zip(out, texts):
            pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
            row[lo : lo + len(encoders)] = [sum(len(e.compress(p)) for p in pieces) for e in encoders]
    return out


def _predict(batches: Batches, dictionaries, schema: pa.Schema, margin: float) -> Batches:
    names, contents = list(dictionaries.value), list(dictionaries.value.values())
    first = _encoders(contents[:BLOCK_LANGUAGES])
    rows = max(1, BLOCK_SIZES // max(1, len(names)))
    for batch in (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)):
        best, score, rejected = [], [], []
        texts = batch.column("text").to_pylist()
        known = [bool(t and names) and any(map(str.isalpha, t)) for t in texts]
        found = iter(_sizes([t.encode() for t, k in zip(texts, known) if k], contents, first))
        for usable in known:
            if not usable:
                best.append(UNKNOWN)
                score.append(0.0)
                rejected.append(True)
                continue
            sizes = next(found)
            k = int(sizes.argmin())
            second = np.delete(sizes, k).min() if len(sizes) > 1 else 2 * sizes[k]
            odds = np.exp2(-np.minimum(60, 400 * (sizes / sizes[k] - 1) / 8))
            best.append(names[k])
            score.append(float(1 / odds.sum()))
            rejected.append(bool(second < sizes[k] * (1 + margin)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
            schema=schema,
        )


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of every row of ``docs`` (``doc_id``, ``text``).

    The whole text is encoded with each dictionary. ``lang_pred`` is the language with the smallest
    result, ties to the first name; ``rejected`` says that the margin to the second is too narrow to
    rely on it. ``score`` falls from 1 as others come near. Texts that are null, empty or without a
    letter are ``und`` with score 0 and rejected, and so is everything if nothing was learned.
    Repeated rows are judged each; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType
    out = T.StructType(
        [T.StructField("doc_id", kind), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
         T.StructField("rejected", T.BooleanType())]
    )
    schema = pa.schema([("doc_id", arrow_type(kind)), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    return arrow_map(docs.select("doc_id", "text"), partial(_predict, dictionaries=shared, schema=schema, margin=margin), out)
