"""Quality scores: attention-based multiple-instance learning over passages.

A text is a bag of passages (``PASSAGE_WORDS`` words each). Every passage is encoded: byte classes,
repetition of words and word pairs, word shapes and hashed byte trigrams go through one layer.
Only documents have labels; gated attention learns from them how much each passage counts, and
the weighted mean of the passages is what is scored. So one page of junk in a long text can decide,
or a licence line can be ignored.

Fitting takes a bounded sample (``MAX_SAMPLE`` texts, ``MAX_BYTES`` bytes); scoring takes whole
texts. A text of any length goes through in slabs of ``SLAB_BYTES``, whose attention sums are
combined by the running maximum of their logits.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, Batches, arrow_map, arrow_type, texts_of

PASSAGE_WORDS = 48
HASHED = 256  # counters of byte trigrams
HIDDEN = 32
GATE = 16
MAX_SAMPLE = 4000  # labelled texts fitted on, half of them of either label where there are enough
MAX_BYTES = 8 << 20  # and their bytes together
LONGEST = 128 << 10  # longer texts are scored but not fitted on
SLAB_BYTES = 1 << 20
LEAST_STEPS = 400  # small samples are gone through more often
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_classes() -> np.ndarray:
    """Class of each byte value: lower, upper, digit, blank, line end, lead, continuation, control, one per mark."""
    kind = np.full(256, 7, np.uint8)
    kind[ord("a") : ord("z") + 1], kind[ord("A") : ord("Z") + 1], kind[ord("0") : ord("9") + 1] = 0, 1, 2
    kind[list(b" \t\x0b\x0c")], kind[list(b"\r\n")] = 3, 4
    kind[0xC0:], kind[0x80:0xC0] = 5, 6
    for k, mark in enumerate(MARKS):
        kind[mark] = 8 + k
    return kind


CLASS = _byte_classes()
CLASSES = 8 + len(MARKS)
WORD_STATS = 10
FEATURES = CLASSES + WORD_STATS + HASHED


def _hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each word."""
    inside = np.repeat(np.arange(len(starts)), lengths)
    place = np.arange(len(inside)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    mixed = data[starts[inside] + place].astype(np.uint64) + np.uint64(1)
    mixed *= (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    mixed ^= mixed >> np.uint64(29)
    return np.add.reduceat(mixed * np.uint64(0xD6E8FEB86659FD93), np.cumsum(lengths) - lengths)


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, and the number of the text that each belongs to.

    A text without words is one passage of zeros. What a passage gets does not depend on the other
    texts of the call.
    """
    bare = [t.strip(SPACES) for t in texts]
    full = [k for k, t in enumerate(bare) if t]
    if not full:
        return np.zeros((len(texts), FEATURES), np.float32), np.arange(len(texts))
    data = np.frombuffer(b"\n".join([bare[k] for k in full]) + b"\n", np.uint8)
    kind = CLASS[data]
    blank = (kind == 3) | (kind == 4)
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    lengths = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]])) - starts
    begins = np.cumsum([0] + [len(bare[k]) + 1 for k in full])
    text_of = np.searchsorted(begins, starts, "right") - 1
    first_word = np.searchsorted(starts, begins[:-1])
    cut = (np.arange(len(starts)) - first_word[text_of]) % PASSAGE_WORDS == 0
    passage = np.cumsum(cut) - 1
    n = int(passage[-1]) + 1
    at = starts[cut]
    of_byte = np.repeat(np.arange(n), np.diff(np.append(at, len(data))))
    end = (starts + lengths)[np.append(np.flatnonzero(cut)[1:], len(starts)) - 1]  # blanks behind it belong to no passage
    size, inside = end - at, np.arange(len(data)) < end[of_byte]

    def per_passage(values, owners=passage) -> np.ndarray:
        return np.bincount(owners, values, n)

    counts = np.bincount((of_byte * CLASSES + kind)[inside], minlength=n * CLASSES).reshape(n, CLASSES)
    words = np.bincount(passage, minlength=n)
    code = _hashes(data, starts, lengths)
    follows = ~cut
    again = follows & np.concatenate([[False], code[1:] == code[:-1]])
    pair = code * np.uint64(3) + np.concatenate([[np.uint64(0)], code[:-1]]) * follows.astype(np.uint64)
    salt = passage.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    fresh = [np.bincount(passage[np.unique(c ^ salt, return_index=True)[1]], minlength=n) for c in (code, pair)]
    lower, upper, marks = (np.add.reduceat(m.astype(np.int64), starts) for m in (kind == 0, kind == 1, kind >= 8))
    last = starts + lengths - 1
    ends_marked = kind[last] >= 8
    twice = ends_marked & (lengths > 1) & (kind[np.maximum(last - 1, 0)] >= 8)
    stats = np.stack(
        [
            np.log1p(words) / 4, per_passage(lengths) / words / 10, per_passage(again) / words, fresh[0] / words, fresh[1] / words,
            per_passage((upper > 1) & (lower == 0)) / words, per_passage((kind[starts] == 1) & (lower > 0)) / words,
            per_passage(ends_marked) / words, per_passage(twice) / words, per_passage(marks == lengths) / words,
        ],
        axis=1,
    )
    low = np.where(kind == 1, data + 32, data).astype(np.uint32)
    tri = low[:-2] * np.uint32(0x9E3779B1) + low[1:-1] * np.uint32(0x85EBCA77) + low[2:] * np.uint32(0xC2B2AE3D)
    tri ^= tri >> np.uint32(15)
    inner = (of_byte[:-2] == of_byte[2:]) & inside[2:]
    slot = (of_byte[:-2] * HASHED + (tri * np.uint32(0x27D4EB2F) >> np.uint32(24)).astype(np.int64))[inner]
    grams = np.bincount(slot, minlength=n * HASHED).reshape(n, HASHED)
    x = np.concatenate([np.sqrt(counts / size[:, None]), stats, np.sqrt(grams / size[:, None])], axis=1).astype(np.float32)
    owner = np.array(full)[text_of[cut]]
    none = [k for k, t in enumerate(bare) if not t]
    if none:
        x = np.concatenate([x, np.zeros((len(none), FEATURES), np.float32)])
        owner = np.concatenate([owner, none])
        order = np.argsort(owner, kind="stable")
        x, owner = x[order], owner[order]
    return x, owner


def encode_all(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``encode`` in groups of about ``SLAB_BYTES``, so that only the features of all texts are held at once."""
    parts, begin, held = [], 0, 0
    for k, text in enumerate(texts):
        held += len(text)
        if held > SLAB_BYTES // 2 or k + 1 == len(texts):
            x, owner = encode(texts[begin : k + 1])
            parts.append((x, owner + begin))
            begin, held = k + 1, 0
    return np.concatenate([x for x, _ in parts]), np.concatenate([owner for _, owner in parts])


def slabs(text: bytes, most: int = SLAB_BYTES) -> list[bytes]:
    """The text in pieces of about ``most`` bytes that end with a passage; passages are those of the whole text."""
    text = text.strip(SPACES)
    if len(text) <= most:
        return [text]
    kind = CLASS[np.frombuffer(text, np.uint8)]
    blank = (kind == 3) | (kind == 4)
    at = (np.flatnonzero(~blank[1:] & blank[:-1]) + 1)[PASSAGE_WORDS - 1 :: PASSAGE_WORDS]  # where passages begin
    cuts, last = [0], 0
    for k in at.tolist():
        if k - last >= most:
            cuts.append(k)
            last = k
    return [text[a:b] for a, b in zip(cuts, cuts[1:] + [len(text)])]


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def _segments(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal owners starts, and the number of the run of each row."""
    new = np.concatenate([[True], owner[1:] != owner[:-1]])
    return np.flatnonzero(new), np.cumsum(new) - 1


@dataclass
class Model:
    """``p``: mean, scale, W, a (encoder); V, v, U, u, w (gated attention); c, b (score)."""

    p: dict[str, np.ndarray]

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        p = self.p
        scaled = np.clip((x - p["mean"]) / p["scale"], -5, 5)
        h = np.tanh(scaled @ p["W"] + p["a"])
        tanh, gate = np.tanh(h @ p["V"] + p["v"]), _sigmoid(h @ p["U"] + p["u"])
        return scaled, h, tanh, gate, (tanh * gate) @ p["w"]

    def pooled(self, x: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each run of passages with one owner: greatest logit, attention sum and weighted sum relative to it."""
        _, h, _, _, logit = self.hidden(x)
        first, run = _segments(owner)
        top = np.maximum.reduceat(logit, first)
        weight = np.exp(logit - top[run])
        return top, np.add.reduceat(weight, first), np.add.reduceat(weight[:, None] * h, first)

    def attention(self, text: bytes) -> np.ndarray:
        """The weight of each passage of a text."""
        logit = self.hidden(encode([text])[0])[4]
        weight = np.exp(logit - logit.max())
        return weight / weight.sum()

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Score of each whole text; long texts go slab by slab."""
        out, group, held = np.empty(len(texts)), [], 0

        def flush() -> None:
            nonlocal group, held
            if group:
                out[group] = self._score(self.pooled(*encode([texts[k] for k in group])))
            group, held = [], 0

        for k, text in enumerate(texts):
            if len(text) > SLAB_BYTES:
                parts = [self.pooled(*encode([piece])) for piece in slabs(text)]
                top = max(part[0][0] for part in parts)
                total = sum(part[1] * np.exp(part[0] - top) for part in parts)
                mixed = sum(part[2] * np.exp(part[0] - top)[:, None] for part in parts)
                out[k] = self._score((top, total, mixed))[0]
                continue
            group.append(k)
            held += len(text)
            if held > SLAB_BYTES:
                flush()
        flush()
        return out

    def _score(self, pooled) -> np.ndarray:
        _, total, mixed = pooled
        return _sigmoid((mixed / np.asarray(total)[:, None]) @ self.p["c"] + self.p["b"])


def gradients(model: Model, x: np.ndarray, owner: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy of the texts and its gradient by every fitted array."""
    p = model.p
    scaled, h, tanh, gate, logit = model.hidden(x)
    first, run = _segments(owner)
    alpha = np.exp(logit - np.maximum.reduceat(logit, first)[run])
    alpha /= np.add.reduceat(alpha, first)[run]
    z = np.add.reduceat(alpha[:, None] * h, first)
    prob = _sigmoid(z @ p["c"] + p["b"])
    loss = -np.mean(np.log(np.where(y == 1, prob, 1 - prob) + 1e-12))
    back = ((prob - y) / len(y)).astype(np.float32)
    dz = back[:, None] * p["c"]
    toward = np.einsum("ij,ij->i", h, dz[run])
    de = alpha * (toward - np.add.reduceat(alpha * toward, first)[run])
    dt, dg = de[:, None] * gate * p["w"] * (1 - tanh**2), de[:, None] * tanh * p["w"] * gate * (1 - gate)
    dh = (alpha[:, None] * dz[run] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h**2)
    return float(loss), {
        "W": scaled.T @ dh, "a": dh.sum(0), "V": h.T @ dt, "v": dt.sum(0), "U": h.T @ dg, "u": dg.sum(0),
        "w": (tanh * gate).T @ de, "c": z.T @ back, "b": back.sum(keepdims=True),
    }


def initial(x: np.ndarray, rng: np.random.Generator) -> Model:
    def normal(*shape):
        return rng.normal(0, shape[0] ** -0.5, shape).astype(np.float32)

    return Model(
        {
            "mean": x.mean(0), "scale": x.std(0) + 1e-2, "W": normal(FEATURES, HIDDEN), "a": np.zeros(HIDDEN, np.float32),
            "V": normal(HIDDEN, GATE), "v": np.zeros(GATE, np.float32), "U": normal(HIDDEN, GATE), "u": np.zeros(GATE, np.float32),
            "w": normal(GATE), "c": normal(HIDDEN), "b": np.zeros(1, np.float32),
        }
    )


def train(
    texts: list[bytes], labels: np.ndarray, ones_per_zero: float = 1.0, epochs: int = 8, rate: float = 3e-3,
    decay: float = 1e-4, seed: int = 11,
) -> Model | float:
    """Fit encoder, attention and score jointly by Adam; a constant where only one label is known.

    ``ones_per_zero`` is the ratio of the labels where the model will be used: the bias is shifted
    from the sample's ratio to it, so that scores are shares of label 1.
    """
    labels = np.asarray(labels, np.float32)
    if not len(labels) or labels.min() == labels.max():
        return float(labels[0]) if len(labels) else 0.5
    rng = np.random.default_rng(seed)
    x, owner = encode_all(texts)
    model = initial(x, rng)
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    fitted = [k for k in model.p if k not in ("mean", "scale")]
    m1, m2 = ({k: np.zeros_like(model.p[k]) for k in fitted} for _ in range(2))
    batches = max(1, len(texts) // 32)
    epochs = max(epochs, -(-LEAST_STEPS // batches))
    step = 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(texts)), batches):
            rows = np.concatenate([np.arange(first[k], first[k + 1]) for k in batch])
            run = np.repeat(np.arange(len(batch)), first[batch + 1] - first[batch])
            _, grads = gradients(model, x[rows], run, labels[batch])
            step += 1
            pace = rate * (1 - step / (epochs * batches + 1))
            for k, g in grads.items():
                g = g + decay * model.p[k]
                m1[k] += 0.1 * (g - m1[k])
                m2[k] += 0.001 * (g * g - m2[k])
                model.p[k] = model.p[k] - pace * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    sampled = labels.sum() / max(1.0, len(labels) - labels.sum())
    model.p["b"] = model.p["b"] + np.float32(np.log(max(ones_per_zero, 1e-3) / sampled))
    return model


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column, limit: int, most_bytes: int) -> tuple[DataFrame, float]:
    """At most ``limit`` labelled texts and ``most_bytes`` bytes, up to half of either label, in the order of a
    hash of the id; and how many labels 1 there are to a 0.

    Ids are chosen by label and length alone; only the chosen texts are read.
    """
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality")).where(usable)
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    sizes = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).where(F.col("n").between(1, LONGEST))
    sized = known.join(sizes.groupBy("doc_id").agg(F.max("n").alias("n")), "doc_id")
    place = F.xxhash64(F.col("doc_id").cast("string"), F.lit(11))
    parts = [sized.where(F.col("quality") == label).orderBy(place, "doc_id").limit(limit // 2) for label in (0, 1)]
    so_far = F.sum("n").over(Window.partitionBy("quality").orderBy(place, "doc_id"))  # at most half of limit rows each
    chosen = parts[0].unionByName(parts[1]).withColumn("so_far", so_far).where(F.col("so_far") <= most_bytes // 2)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "quality")), "doc_id")
    rows = rows.where(F.octet_length("text") <= LONGEST).orderBy(place, "doc_id").limit(limit)
    return rows, counts.get(1, 0) / max(1, counts.get(0, 0))


def fit(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None, limit: int = MAX_SAMPLE, most_bytes: int = MAX_BYTES
) -> Model | float:
    """Model from ``labels.quality`` of ``docs``: a sample within both bounds comes to the driver to be fitted on.

    ``usable`` restricts the rows by ``doc_id``. Labels other than 0 and 1 are left out, an id with
    both counts as 0, null and empty texts teach nothing, texts repeated in the sample count once.
    Without labels of both kinds the model is a constant score: that of the only label, or one half.
    """
    sample, ones_per_zero = training_rows(docs, labels, F.lit(True) if usable is None else usable, limit, most_bytes)
    texts: dict[bytes, int] = {}
    for row in sample.collect():
        text = row["text"].encode()
        texts[text] = min(row["quality"], texts.get(text, 1))
    return train(list(texts), np.array(list(texts.values())), ones_per_zero)


def _score(batches: Batches, model, schema: pa.Schema) -> Batches:
    model = model.value
    for batch in batches:
        texts = [t or b"" for t in texts_of(batch.column("text"))]
        score = model.scores(texts) if isinstance(model, Model) else np.full(len(texts), model)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], schema=schema)


def scores(docs: DataFrame, model: Model | float) -> DataFrame:
    """``doc_id, score`` of every row of ``docs`` (``doc_id``, ``text``), 0 to 1, higher is likelier label 1.

    Whole texts count, whatever their length. Empty and null texts are one passage of zeros and
    get one score. Repeated rows are scored each, an empty table gives an empty one, other columns
    are ignored.
    """
    kind = docs.schema["doc_id"].dataType
    out = T.StructType([T.StructField("doc_id", kind), T.StructField("score", T.DoubleType())])
    schema = pa.schema([("doc_id", arrow_type(kind)), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return arrow_map(docs.select("doc_id", "text"), partial(_score, model=shared, schema=schema), out)
