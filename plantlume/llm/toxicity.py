"""Toxicity scores: averaged subword embeddings under a linear softmax, trained jointly.

A word is the bag of its character n-grams (3 to 5 letters between boundary marks) and itself,
hashed into a table of embeddings; a text is the average of its words. Embeddings and softmax are
fitted together in numpy on a bounded sample of labelled texts. A misspelled word keeps most of
its n-grams and so most of its vector.

Averages are linear: with the model fitted, every table row has one number, its embedding times
the difference of the two softmax columns, and a text's log odds are the mean of its words' (a few neutral ones included) and the bias.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batches, arrow_map, arrow_type

BUCKETS = 1 << 17
DIM = 8
GRAMS = (3, 4, 5)
PADDING = 10  # neutral words averaged into every text, so that one odd word can't decide a short one
GAIN = 40.0  # a few words in a hundred decide: averages are scaled up before the softmax
MAX_SAMPLE = 5000  # labelled texts fitted on, half of them of either label where there are enough
CLEAN_BELOW = 0.98  # of held-back clean texts that must stay below the threshold
LEAST_STEPS = 200  # small samples are gone through more often
CACHE_WORDS = 200_000
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words_of(text: str) -> list[str]:
    return text.lower().split()


def bag(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all n-grams of the words, and where each word's begin (every word has some)."""
    bare = [w.strip(EDGE) or w for w in words]
    codes = np.frombuffer(("<" + "><".join(bare) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in bare), np.int64, len(bare))
    word = np.repeat(np.arange(len(bare)), lengths)
    ends = np.cumsum(lengths)
    left = ends[word] - np.arange(len(codes))  # characters up to the end of the word
    rows, owners = [], []
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
        for k in range(n):
            h = (h ^ codes[at + k]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        rows.append(h)
        owners.append(word[at])
    position = np.arange(len(codes)) - (ends - lengths)[word]
    mixed = (codes + np.uint64(1)) * (position.astype(np.uint64) * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15)) ** np.uint64(3)
    whole = np.add.reduceat(mixed ^ (mixed >> np.uint64(31)), ends - lengths)
    rows.append(whole * np.uint64(0xD6E8FEB86659FD93))
    owners.append(np.arange(len(bare)))
    rows, owners = np.concatenate(rows), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    rows = ((rows ^ (rows >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)
    counts = np.bincount(owners, minlength=len(bare))
    return (rows[order] % np.uint64(BUCKETS)).astype(np.int32), np.concatenate([[0], np.cumsum(counts)[:-1]])


@dataclass
class Model:
    """``weights``: log odds of each table row; ``bias`` is added to a text's mean."""

    weights: np.ndarray
    bias: float

    def words(self, words: list[str]) -> np.ndarray:
        rows, starts = bag(words)
        sums = np.add.reduceat(self.weights[rows], starts)
        return sums / np.diff(np.append(starts, len(rows)))

    def odds(self, texts: list[str]) -> np.ndarray:
        return np.array([self.bias + (self.words(w).sum() / (len(w) + PADDING) if (w := words_of(t)) else 0.0) for t in texts])


def train(
    texts: list[str], labels: np.ndarray, clean_per_toxic: float = 1.0, epochs: int = 8, rate: float = 0.25,
    decay: float = 1e-5, seed: int = 5,
) -> Model:
    """Fit embeddings and softmax jointly by Adagrad on the cross entropy.

    Without both labels the model is constant. A fifth of the texts is held back to place the
    threshold, where F1 is best but nearly all clean ones are below, at a score of one half; ``clean_per_toxic`` is the ratio of the
    labels where the model will be used, since the sample may hold another.
    """
    labels = np.asarray(labels, np.int64)
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS, np.float32), (4.0 if len(labels) and labels.max() else -4.0))
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    docs = []
    for t in texts:
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)]
        docs.append(np.unique(np.array(ids, np.int32), return_counts=True))
    words = list(vocabulary) or ["-"]
    vocabulary.clear()
    bags = [bag(words[i : i + 10_000]) for i in range(0, len(words), 10_000)]
    rows = np.concatenate([b[0] for b in bags])
    sizes = np.concatenate([np.diff(np.append(starts, len(grams))) for grams, starts in bags])
    starts = np.cumsum(sizes) - sizes
    del words, bags

    table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    softmax = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen = [np.full(BUCKETS, 1e-6, np.float32), np.full(softmax.shape, 1e-6, np.float32), np.full(2, 1e-6, np.float32)]
    order = rng.permutation(len(docs))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    share = np.bincount(labels[used], minlength=2) / max(1, len(used))
    weight = 0.5 / np.maximum(share, 1e-3)

    def gathered(batch):
        """Table rows of the batch with the share each has in its text."""
        which, share_of, row_of = [], [], []
        for i, k in enumerate(batch):
            ids, counts = docs[k]
            which.append(ids)
            share_of.append(counts / (counts.sum() + PADDING))
            row_of.append(np.full(len(ids), i))
        which, share_of, row_of = np.concatenate(which), np.concatenate(share_of), np.concatenate(row_of)
        n = sizes[which]
        at = np.repeat(starts[which] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return rows[at], np.repeat(share_of / np.maximum(1, n), n).astype(np.float32), np.repeat(row_of, n)

    def averages(grams, part, owner, n):
        picked = table[grams] * part[:, None]
        return np.stack([np.bincount(owner, picked[:, d], n) for d in range(DIM)], 1).astype(np.float32) * GAIN

    batches = max(1, len(used) // 64)
    epochs = max(epochs, -(-LEAST_STEPS // batches))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for batch in np.array_split(rng.permutation(used), batches):
            grams, part, owner = gathered(batch)
            mean = averages(grams, part, owner, len(batch))
            touched, place = np.unique(grams, return_inverse=True)
            logits = mean @ softmax + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), labels[batch]] -= 1
            p *= (weight[labels[batch]] / len(batch))[:, None].astype(np.float32)
            back = (p @ softmax.T) * GAIN
            grad = np.stack([np.bincount(place, part * back[owner, d], len(touched)) for d in range(DIM)], 1).astype(np.float32)
            grad += decay * table[touched] * (grad != 0)
            for value, g, s in ((softmax, mean.T @ p, seen[1]), (bias, p.sum(0), seen[2])):
                s += g * g
                value -= step * g / np.sqrt(s)
            seen[0][touched] += (grad * grad).mean(1)
            table[touched] -= step * grad / np.sqrt(seen[0][touched])[:, None]

    model = Model((table @ (softmax[:, 1] - softmax[:, 0]) * GAIN).astype(np.float32), float(bias[1] - bias[0]))
    odds = model.odds([texts[k] for k in held])
    hit = labels[held]
    cut = -np.inf
    if len(hit) and hit.min() != hit.max():
        by = np.argsort(odds)
        odds, hit = odds[by], hit[by]
        # cut before place i: everything from there on is called toxic
        worth = np.where(hit == 1, 1.0, clean_per_toxic * hit.sum() / (len(hit) - hit.sum()))
        right, called = (hit * worth)[::-1].cumsum()[::-1], worth[::-1].cumsum()[::-1]
        i = int(np.argmax(2 * right / (called + hit.sum())))
        cut = (odds[i] + (odds[i - 1] if i else odds[i] - 1)) / 2
    if len(hit) and hit.min() == 0:
        cut = max(cut, float(np.quantile(odds[hit == 0], CLEAN_BELOW)))
    model.bias -= float(cut) if np.isfinite(cut) else 0.0
    return model


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column, limit: int) -> tuple[DataFrame, float]:
    """At most ``limit`` labelled texts, up to half of either label, in the order of a hash of the id;
    and how many clean labels there are to a toxic one.

    The ids are chosen without their texts; only the chosen texts are read.
    """
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(usable)
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    place = F.xxhash64(F.col("doc_id").cast("string"), F.lit(5))
    parts = [known.where(F.col("toxic") == label).orderBy(place, "doc_id").limit(limit // 2) for label in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    return rows.orderBy(place, "doc_id").limit(limit), counts.get(0, 0) / max(1, counts.get(1, 0))


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, limit: int = MAX_SAMPLE) -> Model:
    """Model from ``labels.toxic`` of ``docs``: at most ``limit`` texts come to the driver to be fitted on.

    ``usable`` restricts the rows by ``doc_id``. Null texts count as empty; labels other than 0 and
    1 are left out; an id with both counts as toxic. Texts repeated in the sample count once.
    """
    sample, clean_per_toxic = training_rows(docs, labels, F.lit(True) if usable is None else usable, limit)
    texts: dict[str, int] = {}
    for row in sample.collect():
        texts[row["text"] or ""] = max(row["toxic"], texts.get(row["text"] or "", 0))
    return train(list(texts), np.array(list(texts.values()), np.int64), clean_per_toxic)


def _odds(texts: list[str | None], model: Model, cache: dict[str, float]) -> np.ndarray:
    split = [words_of(t) if t else [] for t in texts]
    new = list(set().union(*split) - cache.keys()) if split else []
    if new:
        for i in range(0, len(new), 10_000):
            cache.update(zip(new[i : i + 10_000], model.words(new[i : i + 10_000]).tolist()))
    find = cache.__getitem__
    return np.array([model.bias + (sum(map(find, w)) / (len(w) + PADDING)) for w in split])


def _score(batches: Batches, model, schema: pa.Schema, reject_at: float | None) -> Batches:
    model, cache = model.value, {}
    for batch in batches:
        odds = np.concatenate([
            _odds(batch.column("text").slice(i, 200).to_pylist(), model, cache) for i in range(0, batch.num_rows, 200)
        ] or [np.empty(0)])
        score = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        if len(cache) > CACHE_WORDS:
            cache.clear()
        if reject_at is not None:
            yield batch.filter(pa.array(score < reject_at))
        else:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], schema=schema)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row of ``docs`` (``doc_id``, ``text``), 0 to 1, higher is likelier toxic.

    The whole text counts; empty and null texts get the model's bias alone. Repeated rows are
    scored each; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType
    out = T.StructType([T.StructField("doc_id", kind), T.StructField("score", T.DoubleType())])
    schema = pa.schema([("doc_id", arrow_type(kind)), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return arrow_map(docs.select("doc_id", "text"), partial(_score, model=shared, schema=schema, reject_at=None), out)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score under ``threshold``, all their columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return arrow_map(docs, partial(_score, model=shared, schema=None, reject_at=threshold), docs.schema)
