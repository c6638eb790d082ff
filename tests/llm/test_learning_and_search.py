"""Quality classifier, prefix trie and hard negatives against brute force, and on odd tables."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantlume.llm import hard_negatives, prefix_trie, quality, registered

WORDS = "the of and plant energy line shift output loss value rises falls with every hour under load".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, last boolean"


# --- quality ----------------------------------------------------------------------------------
def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def junk(rng, n):
    return " ".join(f"{w.upper()}!!" for w in (rng.choice(WORDS) for _ in range(n)))


def labelled(seed, n):
    rng = random.Random(seed)
    texts, labels = [], []
    for k in range(n):
        good = k % 2
        parts = [prose(rng, 60) for _ in range(rng.randint(1, 4))]
        if not good:
            parts[rng.randrange(len(parts))] = junk(rng, 70)
        texts.append("\n".join(parts).encode())
        labels.append(good)
    return texts, np.array(labels)


def test_quality_separates_held_out_texts_and_looks_at_the_junk():
    model = quality.train(*labelled(1, 120))
    texts, labels = labelled(2, 60)
    assert ((model.scores(texts) >= 0.5) == labels).mean() >= 0.95
    rng = random.Random(3)
    weights = model.attention((prose(rng, 48) + "\n" + junk(rng, 48) + "\n" + prose(rng, 48)).encode())
    assert len(weights) == 3 and weights.sum() == pytest.approx(1)


def test_quality_gradient_equals_differences():
    texts, labels = labelled(4, 6)
    x, owner = quality.encode(texts)
    model = quality.initial(x, np.random.default_rng(0))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    _, grads = quality.gradients(model, x, owner, labels)
    rng = np.random.default_rng(1)
    for name, grad in grads.items():
        flat = model.p[name].reshape(-1)
        for at in rng.choice(flat.size, min(4, flat.size), replace=False):
            old, h = flat[at], 1e-4
            flat[at] = old + h
            up, _ = quality.gradients(model, x, owner, labels)
            flat[at] = old - h
            down, _ = quality.gradients(model, x, owner, labels)
            flat[at] = old
            assert grad.reshape(-1)[at] == pytest.approx((up - down) / (2 * h), rel=1e-3, abs=1e-6)


def test_quality_forward_equals_a_loop_over_passages():
    texts, labels = labelled(5, 10)
    model = quality.train(texts, labels, epochs=1)
    p = model.p
    for text, got in zip(texts, model.scores(texts)):
        words = text.split()
        x = np.concatenate([quality.encode([text])[0]])
        assert len(x) == math.ceil(len(words) / quality.PASSAGE_WORDS)
        hidden, logits = [], []
        for row in x:
            h = np.tanh(np.clip((row - p["mean"]) / p["scale"], -5, 5) @ p["W"] + p["a"])
            logits.append(float(p["w"] @ (np.tanh(h @ p["V"] + p["v"]) / (1 + np.exp(-(h @ p["U"] + p["u"]))))))
            hidden.append(h)
        alpha = np.exp(logits) / np.exp(logits).sum()
        z = sum(a * h for a, h in zip(alpha, hidden))
        assert got == pytest.approx(float(1 / (1 + np.exp(-(z @ p["c"] + p["b"][0])))), abs=1e-4)


def test_quality_features_do_not_depend_on_neighbours(monkeypatch):
    rng = random.Random(6)
    texts = [b"", b"  \n ", b"x", prose(rng, 500).encode(), junk(rng, 130).encode(), "ñandú ß 東京 \U0001f600".encode(), b" \t lead"]
    x, owner = quality.encode(texts)
    for k, text in enumerate(texts):
        assert np.array_equal(x[owner == k], quality.encode([text])[0])
    model = quality.train(*labelled(7, 20), epochs=1)
    whole = model.scores(texts)
    monkeypatch.setattr(quality, "SLAB_BYTES", 300)
    assert np.concatenate([quality.encode([s])[0] for s in quality.slabs(texts[3], 300)]) == pytest.approx(quality.encode([texts[3]])[0])
    assert len(quality.slabs(texts[3], 300)) > 2
    assert model.scores(texts) == pytest.approx(whole, abs=1e-5)


def test_quality_of_odd_tables(spark):
    rows = [(1, None, "en", "s", 0, 0.5, True), (2, "", None, None, None, None, None), (2, "", None, None, None, None, None),
            (None, "some words here", "en", "s", 3, None, None), (4, "w " * 200_000, "en", "s", 1, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    good, bad = prose(random.Random(8), 50), junk(random.Random(8), 50)
    more = spark.createDataFrame([(k, good if k % 2 else bad, None, None, None, None, None) for k in range(10, 30)], DOCS)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(10, 30)] + [(11, 7, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(more, labels)
    got = quality.scores(docs, model).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert quality.scores(docs.limit(0), model).collect() == []
    assert quality.fit(docs, labels.limit(0)) == 0.5
    assert {r["score"] for r in quality.scores(docs, quality.fit(more, labels.where("quality = 1"))).collect()} == {1.0}


# --- prefix trie ------------------------------------------------------------------------------
def brute_trie(rows):
    convs = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            convs.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = turns.get(c - int(math.fmod(c, 20)), [])[:h] + turns[c][h:]
    members, ends = {}, {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
        ends.setdefault(tuple(seq), []).append(c)
    out = set()
    for path, who in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaves = [p for p in below if not any(q[:-1] == p for q in members if q)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode().split()) for p in below if p)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest()
        parent = min(members[path[:-1]]) if path else None
        children = sum(1 for q in members if q and q[:-1] == path)
        out.add((min(who), len(path), parent, len(who), children, len(leaves), saved, digest))
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, node string"


def random_conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        c = rng.randrange(-45, 130)
        for t in range(rng.randint(0, 6)):
            rows.append((c, rng.choice([t, t, None, 0]), rng.choice(["user", "assistant", None]), rng.choice(["a b", "a  b", "", None, "hi", "c d e"])))
    return rows + [(None, 1, "user", "nobody"), (500, 0, "user", "x " * 5000), (500, 0, "user", "x " * 5000)]


@pytest.mark.parametrize("seed, shard_rows, most", [(1, 20_000, 100_000), (2, 17, 3), (3, 40, 1), (4, 7, 2)])
def test_trie_equals_brute_force(spark, seed, shard_rows, most):
    rows = random_conversations(seed, 60)
    df = spark.createDataFrame([(*r, "extra") for r in rows], CONVERSATIONS)
    got = [tuple(r) for r in prefix_trie.prefix_trie(df, shard_rows, most).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_trie(rows)


def test_trie_of_no_conversations(spark):
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert prefix_trie.prefix_trie(empty).collect() == []
    lonely = spark.createDataFrame([(41, None, None, None, None)], CONVERSATIONS)
    assert {tuple(r) for r in prefix_trie.prefix_trie(lonely).collect()} == brute_trie([(41, None, None, None)])


def test_queue_spills_and_keeps_the_order():
    rng = random.Random(9)
    messages = [((rng.randrange(20), bytes([rng.randrange(3)])), rng.randrange(5), 1) for _ in range(500)]
    queue, got = prefix_trie.MessageQueue(most=16), {}
    for m in messages:
        queue.push(*m)
    assert queue.n_runs > 10
    places = []
    while (place := queue.first()) is not None:
        places.append(place)
        got[place] = queue.take()
    assert places == sorted(set(places))
    assert got == {p: (sum(m[1] for m in messages if m[0] == p), sum(1 for m in messages if m[0] == p)) for p in places}


# --- hard negatives ---------------------------------------------------------------------------
VECTORS = "vec_id long, embedding array<float>, label int, row long, score string"


def brute_negatives(rows):
    kept = []
    for k, (vec_id, x, label) in enumerate(rows):
        if vec_id is None or x is None or label is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        kept.append((k, vec_id, [math.floor(256 * float(np.float32(v))) for v in x], (label + 1) % 10 if vec_id % 7 == 0 else label))

    def score(a, b):
        return sum(p * q for p, q in zip(a, b))

    out = []
    for k, vec_id, x, label in kept:
        if vec_id % 50:
            continue
        same = sorted((-score(x, y), i, j) for j, i, y, m in kept if m == label and j != k)[:5]
        for s, positive, _ in same:
            other = sorted((-score(x, y), i, j) for j, i, y, m in kept if m != label)
            fitting = [(i, -t) for t, i, _ in other if 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(vec_id, positive, r + 1, i, -s, t) for r, (i, t) in enumerate(fitting)]
    return sorted(out)


def vectors(seed, n, dim=6, spread=0.2):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.4) for _ in range(dim)] for _ in range(5)]
    rows = []
    for k in range(n):
        centre = rng.choice(centres)
        rows.append((k, [c + rng.gauss(0, spread) for c in centre], rng.choice([1, 1, 1, 2, 3, 9])))
    return rows


ODD = [
    (None, [1.0] * 6, 1), (50, None, 1), (100, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (150, [float("nan")] * 6, 1), (200, [1.0] * 6, None),
    (250, [float("inf")] * 6, 2), (300, [], 2), (350, [0.5, 0.5], 2), (50, [0.3] * 6, 1), (50, [0.3] * 6, 1), (51, [0.3] * 6, 2), (400, [0.5] * 9, 1),
]


@pytest.mark.parametrize("seed, n, sizes", [(1, 300, (16, 4, 3)), (2, 160, (7, 2, 100)), (3, 260, (256, 64, 512))])
def test_negatives_equal_brute_force(spark, seed, n, sizes):
    rows = vectors(seed, n, spread=0.05 if seed == 1 else 0.3) + ODD
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], VECTORS).repartition(5)
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(df, *sizes).collect())
    want = brute_negatives(rows)
    assert len(want) > 30 and got == want


def test_negatives_of_no_vectors(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives.hard_negatives(empty).collect() == []
    alone = spark.createDataFrame([(50, [1.0], 1, 1, "s"), (3, [], 1, 1, "s")], VECTORS)
    assert hard_negatives.hard_negatives(alone).collect() == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(4)
    a = rng.integers(-50, 50, (20, 8)).astype(np.int32)
    x = rng.integers(-50, 50, (30, 8)).astype(np.int32)
    least, most = hard_negatives.bounds(a, x.min(0)[None], x.max(0)[None])
    scores = hard_negatives.products(a, x)
    assert (least[:, 0] <= scores.min(1)).all() and (most[:, 0] >= scores.max(1)).all()
    near, far = np.full((1, 8), 10, "<i4"), np.full((1, 8), -10, "<i4")
    chunk = hard_negatives.Anchors({"rows": np.zeros(1, np.int64), "ids": np.zeros(1, np.int64), "labels": np.ones(1, "<i4"), "q": near.tobytes(), "dim": 8})
    least, most = hard_negatives.bounds(chunk.q, np.concatenate([near, far]), np.concatenate([near, far]))
    assert hard_negatives.wanted_positive(chunk, least, most, np.array([1, 1]), np.array([6, 6])).tolist() == [[True, False]]


def test_hilbert_keys_walk_to_neighbours():
    for dim, bits in ((2, 3), (3, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dim), -1).reshape(-1, dim)
        keys = hard_negatives.hilbert_keys(grid, bits)
        walk = grid[sorted(range(len(grid)), key=lambda k: keys[k])]
        assert len(set(keys)) == len(grid) and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_large_products_stay_exact():
    a = np.array([[2**27 + 1, 2**27 - 3]], np.int64)
    assert hard_negatives.products(a, a)[0, 0] == (2**27 + 1) ** 2 + (2**27 - 3) ** 2


# --- registered queries -----------------------------------------------------------------------
@pytest.mark.parametrize("name", ["op11_quality_classifier", "op12_prefix_trie", "op13_hard_negatives"])
def test_registered_query(spark, sf_dir, name):
    df = registered.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert rows
    if name == "op11_quality_classifier":
        labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
        known = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["doc_id"] in labels]
        assert sum(p == y for p, y in known) >= 0.9 * len(known)
        assert df.where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string")) % 5 == 0)).isEmpty()
