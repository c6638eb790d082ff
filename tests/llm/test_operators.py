"""Every operator on small hand-made tables: nulls, empty and long texts, ties, repeats, clashing columns."""

import collections
import hashlib
import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from plantlume.llm import components, decontaminate, exact_dedup, html_text, language, licences, mixing, ngram_join, suffix_dedup, token_count, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, component_id int, spans string, score string, matches int"
LONG = " ".join(f"w{i}" for i in range(30_000))


def table(spark, texts, ids=None):
    """Documents with columns that clash with those of the operators."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", None if k % 5 == 4 else f"s{k % 2}", 1, 9, "r", 3, "x", "y", 2) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, COLUMNS)


ODD = [None, "", " \n\t", "One", "one", "two words", "two  words", "äöü ß 漢字 🙂", LONG, LONG + " x", "a b", "a b"]


@pytest.fixture(scope="module")
def odd(spark):
    # a null id, and a row that is repeated
    return table(spark, [*ODD, "null id", "again again", "again again"], [*range(len(ODD)), None, 77, 77])


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# ---- 1 --------------------------------------------------------------------------------------

PAGES = {
    "<p>a<p>b": "a\n\nb",
    "<ul><li>x<li>y<ol start=3><li>c<li>d</ol></ul>": "- x\n- y\n  3. c\n  4. d",
    "<table><tr><th>Name<th>N<tr><td>fig<td>10</table>": "Name  N\nfig   10",
    "<div>a</div><div>b</div>c": "a\nb\nc",
    "a<br>b<br><br>c": "a\nb\n\nc",
    "<p hidden>no<p style='display: none'>no<p>yes": "yes",
    "<style>.x,#y{display:none}</style><p class='a x'>no<p id=y>no<p>yes": "yes",
    "<title>t</title><script>if (a</b) x</script>&lt;b&gt; &amp; é": "<b> & é",
    "<pre>\n a\n  b</pre>": " a\n  b",
    "<span style='visibility:hidden'>no <b style='visibility:visible'>yes</b></span>": "yes",
    "<details><summary>s</summary>no</details><details open><summary>s</summary>t</details>": "s\ns\nt",
    "<table>foo<tr><td>x</table>": "foo\n\nx",
    "a < b": "a < b",
    "<!-- no --><b>a": "a",
    "": "",
}


@pytest.mark.parametrize("page", PAGES)
def test_pages(page):
    assert html_text.visible_text(page) == PAGES[page]


STYLED = {
    "<style>@media print{.nav{display:none}}</style><p class=nav>yes": "yes",
    "<style>@media (max-width: 600px){.nav{display:none}}</style><p class=nav>yes": "yes",
    "<style media=print>.nav{display:none}</style><p class=nav>yes": "yes",
    "<noscript><style>p{display:none}</style></noscript><p>yes": "yes",
    "<style>@media screen and (min-width:600px){.nav{display:none}}</style><p class=nav>no<p>yes": "yes",
    "<style>@media (prefers-reduced-motion){.nav{display:none}}</style><p class=nav>yes": "yes",
    "<style>.tab{display:none}.tab{display:block}</style><p class=tab>yes": "yes",
    "<style>.tab{display:block}.tab{display:none}</style><p class=tab>no<p>yes": "yes",
    "<style>.tab.active{display:flex}.tab{display:none}</style><p class='tab active'>yes<p class=tab>no": "yes",
    "<style>#a .tab{display:block}.tab{display:none}</style><div id=a><p class=tab>yes</div><p class=tab>no": "yes",
    "<style>.tab{display:none}.tab:nth-last-of-type(2){display:block}</style><p class=tab>yes": "yes",
    "<style>.tab:nth-last-of-type(2){display:none}</style><p class=tab>yes": "yes",
    "<style>.tab{display:none}.tab:hover{display:block}</style><p class=tab>no<p>yes": "yes",
    "<style>p::before{display:none}</style><p>yes": "yes",
    "<style>.md\\:block{display:block!important}.hide{display:none}</style><p class='hide md:block'>yes<p class=hide>no": "yes",
    "<style>.tab{display:none;&.on{display:block}}</style><p class='tab on'>yes<p class=tab>no": "yes",
    "<style>p{display:none}</style><p style='display:block'>yes<p>no": "yes",
    "<style>p{display:none!important}</style><p style='display:block'>no</p>yes": "yes",
    "<style>.x{display:block}</style><p class=x hidden>yes<p hidden>no": "yes",
    "<style>@layer u{.x{display:none}} .x{display:block} @layer u{.y{display:none}}</style><p class=x>yes<p class=y>no": "yes",
    "<style>p{content:'}.a{display:none}'}</style><p class=a>yes": "yes",
    "<math><mi>a</mi><mo>+</mo><mi>b</mi><annotation>no</annotation></math>": "a+b",
    "x <svg><title>no</title><defs/><path d=z /><text>One</text><text>Two</text><defs><text>no</text></defs></svg> y": "x One Two y",
    "<map name=m>over <area href=x>there</map>": "over there",
    "<svg><defs><p>yes": "yes",
}


@pytest.mark.parametrize("page", STYLED)
def test_styled_pages(page):
    assert html_text.visible_text(page) == STYLED[page]


def test_long_style_sheets():
    assert html_text.visible_text("<style>" + "a b c d ~ e{display:none}" * 300 + "</style>" + "<e>" * 2000 + "x") == "x"
    assert html_text.visible_text("<style>" + "a{" * 5000 + "display:none</style>x") == "x"
    assert html_text.visible_text("<style>p{" + "& &{" * 60 + "display:none</style><p>x") == "x"


def test_styles_without_limits(monkeypatch):
    """Far ancestors, long and deep selectors and many steps are judged like any others."""
    far = '<div class="a">' + "<i>" * 400 + '<b class="b">hidden</b>'
    assert html_text.visible_text("<style>.a .b{display:none}</style>" + far) == ""
    names = ",".join(f".{'x' * 50}{k}" for k in range(1000))
    assert html_text.visible_text("<style>" + names + ",p{b{display:none}}</style><p>x<b>y") == "x"
    deep = "<style>p{" + "&{" * 300 + "b{display:none}</style><p>x<b>y"
    assert html_text.visible_text(deep) == "x"
    long = "<style>" + "i " * 300 + "b{display:none}</style>"
    assert html_text.visible_text(long + "<i>" * 300 + "x<b>y") == "x"
    assert html_text.visible_text(long + "<i>" * 299 + "x<b>y") == "xy"
    many = "<style>" + "".join(f"i~i i~i>b#n{k}{{display:none}}" for k in range(500)) + "</style>"
    page = many + "<div>" + "<i></i>" * 50 + "<i>" + "<i></i>" * 50 + "<i>x" + "".join(f"<b id=n{k}>y</b>" for k in range(500))
    assert html_text.visible_text(page) == "x"
    monkeypatch.setattr(html_text, "KEPT", 100)  # found again after they were dropped
    assert html_text.visible_text(page) == "x"
    assert html_text.visible_text("<style>p{> b{display:none} :is(& u){display:none}}</style><p>x<b>y</b><i><b>z</b><u>w") == "xz"


def test_long_and_deep_pages():
    assert html_text.visible_text("<div>" * 20_000 + "x") == "x"
    assert html_text.visible_text("<b>" * 20_000 + "<p>x") == "x"
    assert html_text.visible_text('<a "' * 20_000) == ""
    assert len(html_text.visible_text("<p>" + LONG)) == len(LONG)


def test_pages_table(spark):
    pages = spark.createDataFrame(
        [(1, "u", None, "t"), (2, None, "", "t"), (None, "u", "<p>a", "t"), (3, "u", "<p>b", "t"), (3, "u", "<p>b", "t")],
        "page_id long, url string, html string, text string",
    )
    got = rows_of(html_text.extract(pages), "page_id", "text")
    assert got == sorted([(1, None), (2, ""), (None, "a"), (3, "b"), (3, "b")], key=repr)
    assert html_text.extract(pages.limit(0)).count() == 0


# ---- 2 --------------------------------------------------------------------------------------


def brute_contamination(texts, items, n=13):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: word.findall((t or "").translate(lower))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for item, it in items:
            v = words(it)
            k = min(n, len(v))
            for i in range(len(v) - k + 1 if k else 0):
                for j in range(len(w) - k + 1):
                    if w[j : j + k] == v[i : i + k]:
                        hit.update(range(j, j + k))
                        found.add(item)
        out.append((len(w), len(hit), sorted(str(f) for f in found if f is not None)))
    return out


def contamination_case():
    r = random.Random(2)
    pool = ["Aa", "bb", "cC", "d1", "é", "漢"]
    line = lambda k: r.choice([" ", ", "]).join(r.choice(pool) for _ in range(k))
    items = [(i, line(r.choice([0, 1, 3, 13, 20, 40]))) for i in range(12)] + [(50, None), (51, ""), (None, line(15)), (52, "zz yy")]
    texts = [line(r.choice([0, 2, 30, 60])) + " - " + (r.choice(items)[1] or "") + "\n" + line(5) for _ in range(40)] + ODD[:8] + ["x zz YY x"]
    return texts, items


@pytest.mark.parametrize("block", [1_000_000, 30])
def test_contamination_equals_brute_force(spark, block):
    texts, items = contamination_case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(table(spark, texts), bench, block_windows=block)
    got = {r["doc_id"]: (r["n_words"], sum(s["end"] - s["first"] for s in r["spans"]), r["items"]) for r in found.collect()}
    assert [got[i] for i in range(len(texts))] == brute_contamination(texts, items)


def test_decontaminated_tables(spark, odd, none):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen")], "item_id long, text string")
    hit = "x; One two three four five six seven eight nine ten eleven twelve Thirteen y z"
    docs = table(spark, [hit, hit + " pad" * 400, None, "clean text"])
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and rows_of(kept, "doc_id") == [(1,), (2,), (3,)]
    cut = decontaminate.decontaminate(docs, bench, remove="spans")
    assert rows_of(cut.where("doc_id in (0, 2)"), "text") == sorted([("x;  y z",), (None,)], key=repr)
    assert decontaminate.decontaminate(odd, bench).count() == odd.count()
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == 4
    assert decontaminate.find_contamination(none, bench).count() == 0
    small = decontaminate.decontaminate(docs, bench.union(bench.select(F.lit(2), F.lit("other words here"))), block_windows=1)
    assert rows_of(small, "doc_id") == [(1,), (2,), (3,)]


@pytest.mark.parametrize("block", [1_000_000, 1])
def test_spans_are_cut_from_the_original_text(spark, block):
    w = [f"w{i}" for i in range(21)]
    items = [(1, " ".join(w[:13])), (2, " ".join(w[8:])), (3, "left right")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = table(spark, ["x " + " ".join(w) + " y", "left " + " ".join(w) + " right", None, "clean"])
    cut = decontaminate.decontaminate(docs, bench, remove="spans", block_windows=block)
    assert cut.columns == docs.columns
    assert rows_of(cut, "doc_id", "text", "spans") == [(0, "x  y", "x"), (1, "left  right", "x"), (2, None, "x"), (3, "clean", "x")]


# ---- 3 --------------------------------------------------------------------------------------


def test_targets_are_filled_by_level(spark):
    rows = [("a", 10)] * 10 + [("b", 1000)] * 3 + [("c", 50)] * 4 + [(None, 7)]
    got = {r["source"]: r for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    sizes = {"a": 100, "b": 3000, "c": 200, None: 7}
    weights = {"a": 3.0, "b": 1.0, "c": 2.0, None: 3.0}
    budget, want = 1.5 * sum(sizes.values()), {}
    while True:  # share, cap, and share what is left
        rest = budget - sum(want.values())
        free = [s for s in sizes if s not in want]
        share = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        full = [s for s in free if share[s] > 2 * sizes[s]]
        if not full:
            want |= share
            break
        want |= {s: 2.0 * sizes[s] for s in full}
    assert {s: pytest.approx(got[s]["target"]) for s in sizes} == want


def test_mix_comes_near_its_targets(spark):
    r = random.Random(4)
    texts = [" ".join("w" * r.randint(1, 5) for _ in range(r.choice([0, 1, 20, 60]))) for _ in range(600)]
    docs = table(spark, texts).withColumn("source", F.when(F.col("doc_id") % 3 > 0, "hot").when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("source")))
    mixed = mixing.mix(docs)
    once, again = rows_of(mixed, "doc_id", "size", "taken"), rows_of(mixing.mix(docs), "doc_id", "size", "taken")
    assert once == again and len(once) == 600
    assert all(t in (0, s, 2 * s) for _, s, t in once)
    per = mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(p["taken"] - p["target"]) <= 60 for p in per)
    total = sum(s for _, s, _ in once)
    assert 1.5 * total - 60 <= sum(t for _, _, t in once) <= 1.5 * total


def test_mix_counts_what_finishes_late(spark):
    rows = [(i, "w", "a") for i in range(20)] + [(20, " ".join("w" * 30), "b")]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert mixed.where("source = 'b'").first()["taken"] == 30
    assert mixed.agg(F.sum("taken")).first()[0] == 70


def test_mix_of_odd_tables(spark, odd, none):
    got = rows_of(mixing.mix(odd), "doc_id", "size", "taken")
    assert len(got) == odd.count() and (0, 0, 0) in got and (1, 0, 0) in got
    assert all(t <= 2 * s for _, s, t in got)
    assert mixing.mix(none).count() == 0
    assert rows_of(mixing.mix(table(spark, ["", None])), "taken") == [(0,), (0,)]


# ---- 4 --------------------------------------------------------------------------------------


def test_language_of_held_out_texts(spark):
    r = random.Random(6)
    syllables = {"aa": "ba da ga li mo", "bb": "zu xe qi wy vo", "cc": "scht pf ein ung keit"}
    make = lambda s: " ".join("".join(r.choice(s.split()) for _ in range(r.randint(1, 4))) for _ in range(40))
    rows = [(i, make(syllables[lang]), lang) for i in range(300) for lang in [sorted(syllables)[i % 3]]]
    odd = [(900, None, "aa"), (901, "", "bb"), (902, "12 !", "cc"), (903, "bada", None), (None, "bada gali", "aa"), (904, LONG, "aa")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    known = language.learn(docs.where("doc_id < 300"), F.col("doc_id") % 4 != 2)
    assert sorted(known) == sorted(syllables)
    got = {row["doc_id"]: row for row in language.identify(docs, known).collect()}
    held = [row for row in rows if row[0] % 4 == 2]
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in held) >= 0.97 * len(held)
    assert all(got[i]["lang_pred"] == "und" and got[i]["rejected"] for i in (900, 901, 902))
    assert len(got) == 306 and all(0 <= row["score"] <= 1 for row in got.values())
    assert language.learn(docs.limit(0), F.lit(True)) == {}
    assert {row["lang_pred"] for row in language.identify(docs.limit(3), {}).collect()} == {"und"}


def test_language_equals_a_loop_over_all_dictionaries(monkeypatch):
    r = random.Random(61)
    make = lambda letters, n: " ".join("".join(r.choices(letters, k=r.randint(1, 6))) for _ in range(n))
    alphabets = ["abcde", "fghij", "abfgk", "xyzuv", "mnopq"]
    known = {f"l{k}": make(a, 400).encode() for k, a in enumerate(alphabets)}
    texts = [make(r.choice(alphabets), r.randint(1, 60)) for _ in range(40)] + [make("abcde", 3000), None, "", "7 8"]
    monkeypatch.setattr(language, "BLOCK_LANGUAGES", 2)  # more languages than a block holds
    monkeypatch.setattr(language, "BLOCK_SIZES", 60)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    found = [row for b in language._predict(iter([batch]), SimpleNamespace(value=known), schema, 0.02) for row in b.to_pylist()]
    assert [row["doc_id"] for row in found] == list(range(len(texts)))
    for row, text in zip(found, texts):
        if not text or not re.search("[a-z]", text):
            assert (row["lang_pred"], row["score"], row["rejected"]) == ("und", 0.0, True)
            continue
        sizes = {}
        for name, content in known.items():
            raw, size = text.encode(), 0
            while raw:
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                c = zstandard.ZstdCompressor(level=3, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
                size += len(c.compress(raw[:4096]))
                raw = raw[4096:]
            sizes[name] = size
        least, second = sorted(sizes.values())[:2]
        assert row["lang_pred"] == min(sizes, key=lambda n: (sizes[n], n))
        assert row["rejected"] == (second < least * 1.02)


def test_language_learns_past_null_texts(spark, monkeypatch):
    rows = [(i, None, "aa") for i in range(60)] + [(i, "bada gali moda " * 9, "aa") for i in range(60, 64)] + [(70, "zuxe qiwy vo", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = language.learn(docs, F.lit(True), sample_rows=3)
    assert sorted(known) == ["aa", "bb"] and known["aa"].count(b"bada") == 27
    monkeypatch.setattr(language, "ALL_DICTIONARIES", 64)  # shared by all; 1 KB each at least
    assert {n: len(c) for n, c in language.learn(docs, F.lit(True)).items()} == {"aa": 4 * 135 + 3, "bb": 12}


# ---- 5 --------------------------------------------------------------------------------------


def test_toxicity_of_held_out_texts(spark):
    r = random.Random(7)
    plain = ["".join(r.choice("aeioubcdfg") for _ in range(r.randint(2, 7))) for _ in range(300)]
    bad = ["stupid", "worthless", "idiot"]

    def text(toxic, words):
        w = [r.choice(plain) for _ in range(r.randint(20, 60))]
        for k in r.sample(range(len(w)), 3 if toxic else 0):
            w[k] = r.choice(words)
        return " ".join(w)

    rows = [(i, text(i % 3 == 0, bad), int(i % 3 == 0)) for i in range(500)]
    docs = table(spark, [t for _, t, _ in rows])
    labels = spark.createDataFrame([(i, x, 1) for i, _, x in rows] + [(3, None, 1), (5000, 1, 1)], "doc_id long, toxic int, text int")
    model = toxicity.fit(docs, labels, F.col("doc_id") % 5 != 0)
    got = {row["doc_id"]: row["score"] for row in toxicity.scores(docs, model).collect()}
    held = rows[::5]
    assert sum((got[i] >= 0.5) == bool(x) for i, _, x in held) >= 0.9 * len(held)
    unseen = table(spark, [text(True, ["stuppid", "idiots", "worthles"]) for _ in range(40)])
    assert sum(row["score"] >= 0.5 for row in toxicity.scores(unseen, model).collect()) >= 20
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and rows_of(kept, "doc_id") == sorted(((i,) for i in got if got[i] < 0.5), key=repr)


def test_toxicity_of_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(3, 1), (8, 0)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    assert toxicity.scores(odd, model).where("score between 0 and 1").count() == odd.count()
    assert toxicity.scores(none, model).count() == 0
    assert toxicity.drop_toxic(odd, toxicity.fit(none, labels)).count() == odd.count()


# ---- 6 --------------------------------------------------------------------------------------


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(texts, percent=75):
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def near_case(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(r.choice(words) for _ in range(r.choice([4, 8, 25, 80, 200]))) for _ in range(25)]
    common = " ".join(r.choice(words) for _ in range(12))
    texts = []
    for t in base:
        texts.append(t)
        for _ in range(r.choice([0, 1, 3, 12])):
            w = t.split()
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(words)
            texts.append(" ".join(w).upper() if r.random() < 0.2 else "  ".join(w))
    texts = [f"{t} {common}" if r.random() < 0.4 else t for t in texts] + ODD[:8]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed, chunk", [(1, 4096), (2, 16), (3, 7)])
def test_components_equal_brute_force(spark, monkeypatch, seed, chunk):
    # the workers import the module afresh, so a small chunk is made there by a small partition
    texts = near_case(seed)
    docs = table(spark, texts)
    want, sizes = brute_components(texts)
    if chunk < 4096:
        spark.conf.set("spark.sql.shuffle.partitions", str(len(texts) // chunk))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in ngram_join.near_groups(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [got[i] for i in range(len(texts))] == list(zip(want, sizes))


def test_near_duplicates_of_odd_tables(spark, odd, none):
    kept = ngram_join.deduplicate_near(odd)
    assert kept.columns == odd.columns
    # "One"/"one", "two words" twice, the long pair, "a b" twice, the repeated row
    assert kept.count() == odd.count() - 5
    assert ngram_join.near_groups(none).count() == 0 and ngram_join.deduplicate_near(none).count() == 0
    empty = ngram_join.near_groups(table(spark, [None, "", " "])).collect()
    assert all(r["n_shingles"] == 0 and r["component_id"] == r["doc_id"] for r in empty)


@pytest.mark.parametrize("seed, chunk", [(1, 4096), (2, 16)])
def test_every_link_equals_brute_force(spark, seed, chunk):
    texts = near_case(seed)
    docs, sets = table(spark, texts), [shingles(t) for t in texts]
    links = {
        (i, j) for i, a in enumerate(sets) for j, b in enumerate(sets)
        if i != j and a and b and 100 * len(a & b) >= 75 * len(a | b)
    }
    if chunk < 4096:
        spark.conf.set("spark.sql.shuffle.partitions", str(len(texts) // chunk))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        members, pairs = ngram_join.near_pairs(docs)
        members, pairs = members.collect(), pairs.collect()
        counts = {r["doc_id"]: (r["n_texts"], r["n_links"]) for r in ngram_join.link_counts(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    text_of = {r["doc_id"]: r["text_id"] for r in members}
    assert len(members) == len(texts) and all((text_of[i] is None) == (not s) for i, s in enumerate(sets))
    want = {tuple(sorted((text_of[i], text_of[j]))) for i, j in links if text_of[i] != text_of[j]}
    assert sorted((p["text_a"], p["text_b"]) for p in pairs) == sorted(want)
    of = {t: sets[i] for i, t in text_of.items()}
    assert all(p["shared"] == len(of[p["text_a"]] & of[p["text_b"]]) and p["n_a"] == len(of[p["text_a"]]) and p["n_b"] == len(of[p["text_b"]]) for p in pairs)
    linked = collections.Counter(i for i, _ in links)
    other = collections.Counter(t for pair in want for t in pair)
    assert counts == {i: (other[text_of[i]], linked[i]) for i in range(len(texts))}
    # more links than any spanning part of the groups has
    components = brute_components(texts)[0]
    groups = collections.Counter(components[i] for i in {t: i for i, t in text_of.items() if t is not None}.values())
    assert len(pairs) > sum(n - 1 for n in groups.values())


def test_links_of_odd_tables(spark, odd, none):
    assert ngram_join.link_counts(none).count() == 0
    got = rows_of(ngram_join.link_counts(odd), "doc_id", "n_texts", "n_links")
    assert len(got) == odd.count() and (0, 0, 0) in got and (8, 1, 1) in got and (10, 0, 1) in got and (77, 0, 1) in got


def test_shingles_equal_brute_force():
    r = random.Random(62)
    odd = [b"", None, b" \n", b"a", b"A b", b"a B c d e", b"x" * 200_000 + b" y z w v u t", b"\x0b".join(b"q%d" % i for i in range(40_000)),
           b"\xc3\x84 \xa0 \x1c b c d", b" lead a b c d trail \t", (b"w" * 64 + b" ") * 9 + b"w" * 65 + b" " + b"w" * 65 + b"v"]
    texts = odd + [b" ".join(r.choice((b"u", b"v", b"W")) for _ in range(r.randint(0, 40))) for _ in range(200)]
    names = {}
    for text, got in zip(texts, ngram_join.Shingler()(texts)):
        w = (text or b"").lower().split()
        want = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        assert len(got) == len(want) and (got[1:] > got[:-1]).all()
        for one in want:
            names.setdefault(one, set()).add(int(ngram_join.Shingler()([b" ".join(one)])[0][0])) if len(want) < 50 else None
        if len(want) < 50:
            assert set(got.tolist()) == {h for one in want for h in names[one]}
    assert all(len(h) == 1 for h in names.values()) and len({h for v in names.values() for h in v}) == len(names)


def test_finer_bounds_lose_no_pair():
    r = np.random.default_rng(63)
    sets = []
    for n in (5, 40, 3000, 3000, 20_000, 70_000):
        base = r.integers(0, 1 << 63, n, np.uint64)
        sets += [np.unique(np.concatenate([base[: int(n * share)], r.integers(0, 1 << 63, n // 9, np.uint64)])) for share in (1, 0.95, 0.85, 0.7, 0.3)]
    sets.append(np.zeros(1, np.uint64))
    sizes = np.array([len(s) for s in sets])
    fine = np.array([ngram_join.counts_of(s, ngram_join.FINE_GROUPS) for s in sets])
    i, j = np.tril_indices(len(sets), -1)
    kept = set(zip(*(x.tolist() for x in ngram_join.Refined(sets, sizes, fine, 75)(i, j)[:2])))
    linked = {(a, b) for a, b in zip(i.tolist(), j.tolist()) if ngram_join.similar(sets[a], sets[b])}
    assert linked and linked <= kept and len(kept) < len(i)


def test_tree_loses_no_pair():
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 2**64, n, np.uint64)) for n in (3, 20, 90) for _ in range(30)]
    sets += [np.unique(np.concatenate([s[: int(len(s) * 0.9)], r.integers(0, 2**64, len(s) // 10 + 1, np.uint64)])) for s in sets]
    points, sizes = np.array([ngram_join.counts_of(s) for s in sets]), np.array([len(s) for s in sets])
    i, j, bound = ngram_join.Tree(points, sizes).pairs(0, len(sets), 75)
    found = set(zip(i.tolist(), j.tolist()))
    for a in range(len(sets)):
        for b in range(a):
            if ngram_join.similar(sets[a], sets[b]):
                assert (a, b) in found
    assert len(found) < 0.2 * len(sets) ** 2 / 2


def test_connected(spark):
    links = [(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), (7, 6), (6, 4), (4, 9), *((i, i + 1) for i in range(100, 160))]
    got = dict(rows_of(components.connected(spark.createDataFrame(links, "a long, b long")), "id", "label"))
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 6: 4, 7: 4, 8: 4, 9: 4} | {i: 100 for i in range(100, 161)}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 7 --------------------------------------------------------------------------------------


def brute_licences(text):
    segments, found = [licences.words_of(s) for s in licences._SEGMENT.split(text)], []
    for i in range(len(segments)):
        for j in range(i, len(segments)):
            w = [x for s in segments[i : j + 1] for x in s]
            bag = collections.Counter(zip(w, w[1:]))
            best = (0, None)
            for name, texts in licences.TEMPLATES.items():
                for t in texts:
                    v = licences.words_of(t.encode())
                    other = collections.Counter(zip(v, v[1:]))
                    dice = 2 * sum((bag & other).values()) / max(1, sum(bag.values()) + sum(other.values()))
                    best = max(best, (dice, name), key=lambda b: b[0])
            if best[0] >= licences.THRESHOLD:
                found.append((best[0], i, j, best[1]))
    out, taken = [], set()
    for s, i, j, name in sorted(found, key=lambda f: (-f[0], f[1], f[2], f[3])):
        if taken.isdisjoint(range(i, j + 1)):
            taken.update(range(i, j + 1))
            out.append((i, j, name, s))
    return sorted(out)


def test_licences_equal_brute_force():
    r, known = random.Random(3), licences.Templates(licences.TEMPLATES, licences.THRESHOLD)
    every = [t for ts in licences.TEMPLATES.values() for t in ts]
    for _ in range(25):
        parts = []
        for _ in range(r.randrange(0, 5)):
            w = (r.choice(every) if r.random() < 0.6 else "the of the in the software to the. and is it").split()
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(len(w))] = r.choice(["x", "the", ""])
            if r.random() < 0.5 and len(w) > 20:
                w[len(w) // 2] += "\n"
            parts.append(" ".join(w))
        text = r.choice(["\n", ". ", " "]).join(parts).encode()
        assert known.scan(text) == brute_licences(text)


def test_licences_of_odd_tables(odd, none):
    got = licences.scan(odd).collect()
    assert len(got) == odd.count() and not any(r["matches"] for r in got)
    assert licences.scan(none).count() == 0
    assert not any(r["matches"] for r in licences.scan(odd, {}).collect())


# ---- 8 --------------------------------------------------------------------------------------


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        c = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        out.append((i, min(groups[c])[3], len(groups[c]), hashlib.sha256(c.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("memory", [64 << 20, 400])
def test_exact_groups_equal_brute_force(spark, odd, memory):
    r = random.Random(8)
    extra = [" ".join(r.choice("abc") for _ in range(r.randint(0, 4))) for _ in range(300)]
    docs = odd.unionByName(table(spark, extra, list(range(1000, 1300))))
    found = exact_dedup.exact_groups(docs, map_memory=memory, memory=memory)
    assert rows_of(found, "doc_id", "keep_id", "group_size", "text_sha256") == brute_exact([(x["doc_id"], x["text"]) for x in docs.collect()])
    kept = exact_dedup.deduplicate(docs, map_memory=memory, memory=memory)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert rows_of(kept, "doc_id") == rows_of(found.where("kept"), "doc_id")
    assert found.where("kept").count() == len({row[3] for row in brute_exact([(x["doc_id"], x["text"]) for x in docs.collect()])})


def test_exact_groups_of_no_rows(none):
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.deduplicate(none).count() == 0


@pytest.mark.parametrize("memory", [1 << 20, 2000])
def test_best_member_of_hot_content_comes_first(memory):
    r = random.Random(81)
    ids = r.sample(range(20_000), 20_000)
    records = [(hashlib.sha256(c).digest(), c, [(i, 1, (0, False, i, i), {"text": i})]) for i in ids for c in [b"hot" if i % 3 else b"%d" % (i % 50)]]
    found = list(exact_dedup.grace(iter(records), memory))
    assert sum(len(members) for _, members in found) == len(ids) and len({d for d, _ in found}) == len(found)
    for _, members in found:
        assert members[0][2] == min(m[2] for m in members) and members[0][3] == {"text": members[0][0]}
        assert all(m[3] is None for m in members[1:])


def test_table_compares_contents():
    table_ = exact_dedup.ContentTable()
    same = b"\0" * 32  # one digest for different contents
    assert [table_.find(same, c)[0] for c in (b"a", b"b", b"a", b"c", b"b")] == [0, 1, 0, 2, 1]


# ---- 9 --------------------------------------------------------------------------------------


def brute_repeats(texts, length, first_stays):
    seen = collections.defaultdict(list)
    raw = [(t or "").encode() for t in texts]
    for k, t in enumerate(raw):
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]].append((k, i))
    out = []
    for k, t in enumerate(raw):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            places = seen[t[i : i + length]]
            if len(places) > 1 and (not first_stays or places[0] != (k, i)):
                gone[i : i + length] = b"\1" * length
        out.append((len(t), sum(gone), hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


def repeats_case():
    r = random.Random(9)
    line = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    shared, copies = [line(n) for n in (60, 90, 210)], []
    for _ in range(50):
        copies.append(line(r.randrange(0, 150)) + r.choice(shared) * r.choice([0, 1, 1, 2]) + line(r.randrange(0, 60)) + r.choice(["", "ab" * 60]))
    return copies + ODD[:8] + copies[:4] + [None, LONG[:4000], LONG[:4000] + "y"]


@pytest.mark.parametrize("hot, keep", [(4096, "none"), (1, "none"), (4096, "first"), (1, "first")])
def test_repeats_equal_brute_force(spark, hot, keep):
    texts = repeats_case()
    docs = table(spark, texts).coalesce(1)
    found = suffix_dedup.repeated_passages(docs, length=50, keep=keep, hot_prints=hot)
    got = {r["doc_id"]: (r["n_bytes"], sum(x["end"] - x["first"] for x in r["removed"]), r["kept_sha256"]) for r in found.collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 50, keep == "first")


@pytest.mark.parametrize("keep", ["none", "first"])
def test_common_passage_leaves_few_windows(spark, monkeypatch, keep):
    r = random.Random(11)
    line = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, other = line(420), line(300)
    texts = [line(r.randrange(150, 300)) + (passage if k % 4 else passage[: r.randrange(180, 420)]) + line(r.randrange(150, 300)) for k in range(50)]
    texts += [line(250) + other + line(250) for _ in range(10)] + texts[:3]
    rows, stored = [], suffix_dedup.stored

    def counting(df, name):
        back = stored(df, name)
        if name == "suffix-windows" and "at" in back.columns:
            rows.append((back.count(), back.select("anchor", "print").distinct().count()))
        return back

    monkeypatch.setattr(suffix_dedup, "stored", counting)
    found = suffix_dedup.repeated_passages(table(spark, texts).coalesce(1), keep=keep, hot_prints=8)
    got = {x["doc_id"]: (x["n_bytes"], sum(y["end"] - y["first"] for y in x["removed"]), x["kept_sha256"]) for x in found.collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 200, keep == "first")
    (windows, runs), = rows
    assert 0 < windows <= 26 * runs  # the pieces at the two ends of the passage


def test_factors_equal_brute_force():
    import numpy as np

    r = random.Random(10)
    for _ in range(30):
        t = np.array([r.randint(1, 3) for _ in range(r.randint(1, 60))])
        starts = np.array(sorted(r.sample(range(len(t)), r.randint(1, len(t)))))
        previous, following = suffix_dedup.factors(t, starts, 8)
        for k, i in enumerate(starts):
            def longest(others):
                best = 0
                for j in others:
                    n = 0
                    while n < 8 and max(i, j) + n < len(t) and t[i + n] == t[j + n]:
                        n += 1
                    best = max(best, n)
                return best

            assert previous[k] == longest(starts[:k]) and following[k] == longest(starts[k + 1 :])


def test_repeats_of_odd_tables(spark, odd, none):
    cut = suffix_dedup.remove_repeats(odd, keep="none")
    assert cut.columns == odd.columns and cut.count() == odd.count()
    texts = dict(rows_of(cut.where("doc_id is not null and doc_id <> 77"), "doc_id", "text"))
    assert texts[8] == "" and texts[9] == "x"[:1] or texts[9].endswith("x")
    assert texts[0] is None and texts[3] == "One"
    assert suffix_dedup.repeated_passages(none).count() == 0


# ---- 10 -------------------------------------------------------------------------------------


def test_edits_equal_full_encoding():
    counter, r = token_count.Counter(token_count.VOCABULARY), random.Random(1)
    parts = ["a", "b c", "'", "'re", " ", "  ", "\n", "\n\n", "the", "1", "23", ".", "é", "x" * 5, "l", "'l", " 's", "🙂", "　"]
    for trial in range(400):
        now = "".join(r.choice(parts) for _ in range(r.randrange(0, 400 if trial % 3 else 12)))
        tree = token_count.TokenTree(now, counter)
        assert tree.tokens == len(counter.encode(now))
        for _ in range(3):
            a = r.randrange(0, len(now) + 1)
            b, new = min(len(now), a + r.choice([0, 0, 1, 3, 50])), "".join(r.choice(parts) for _ in range(r.choice([0, 1, 2, 5])))
            tree.edit(a, b, new)
            now = now[:a] + new + now[b:]
            assert (tree.text(), tree.chars, tree.tokens) == (now, len(now), len(counter.encode(now)))


def test_edits_touch_little():
    tree = token_count.TokenTree(LONG, token_count.Counter(token_count.VOCABULARY))
    tree.edit(90_000, 90_003, "new")
    assert tree.encoded < 4 * token_count.LEAF


def test_recount_of_odd_tables(spark, odd, none):
    counter = token_count.Counter(token_count.VOCABULARY)
    docs = odd.unionByName(table(spark, ["mail a.b@c.org or +1 (555) 555-5010 now"], [500]))
    got = token_count.recount(docs, with_text=True).collect()
    assert len(got) == docs.count()
    assert all(r["n_tokens_edited"] == len(counter.encode(r["text"])) for r in got)
    assert next(r["text"] for r in got if r["doc_id"] == 500) == "mail [EMAIL] or [NUMBER] now"
    given = docs.withColumn("edits", F.expr("array(struct(2 as start, 1000000 as end, 'Z' as new))"))
    assert next(r for r in token_count.recount(given, with_text=True).collect() if r["doc_id"] == 5)["text"] == "twZ"
    assert token_count.recount(none).count() == 0
