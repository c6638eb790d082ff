"""The pipeline on planted cases and on the driver's smallest table."""

import collections
import re

from pyspark.sql import functions as F

import __spark_entry__ as entry_point
import corpus_pipeline as P
from plantlume.llm import toxicity
from plantlume.llm.common import table

from .test_operators import brute_components, brute_contamination


def test_stages_equal_plain_python(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (5001, "", "en", "s", 0), (5002, None, "en", None, 0)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.limit(2))
    kept = {}
    for k, (name, stage) in enumerate(P.STAGES):
        before = docs
        docs = stage(spark, docs, sf_dir)
        if k == len(P.STAGES) - 1:
            break
        docs = P.stored(docs, "test")
        assert docs.columns == before.columns
        kept[name] = (before.select("doc_id", "text").collect(), docs.select("doc_id", "text").collect())

    old, new = kept["toxicity"]
    model = toxicity.fit(spark.createDataFrame(old), table(spark, sf_dir, "labels"))
    clean = [t for t in model.odds([r["text"] or "" for r in old]) if t < 0]
    assert abs(len(new) - len(clean)) <= 1

    old, new = kept["exact dedup"]
    squeezed = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = collections.defaultdict(list)
    for r in old:
        groups[squeezed(r["text"])].append((-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
    assert sorted((squeezed(r["text"]), r["doc_id"] or 0) for r in new) == sorted((c, min(g)[2]) for c, g in groups.items())

    old, new = kept["n-gram Jaccard join"]
    old = sorted(old, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    labels, _ = brute_components([r["text"] for r in old])
    assert sorted((r["doc_id"] for r in new), key=str) == sorted((old[k]["doc_id"] for k in set(labels)), key=str)

    old, new = kept["benchmark decontamination"]
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    found = brute_contamination([r["text"] for r in old], items)
    assert sorted((r["doc_id"] for r in new), key=str) == sorted(
        (r["doc_id"] for r, (n, hit, _) in zip(old, found) if not (hit and 20 * hit >= n)), key=str
    )
    assert docs.count() == len(new)


def test_run_is_registered(spark, sf_dir):
    assert entry_point.queries()["pipeline"] is P.run
    mixed = P.run(spark, sf_dir)
    per = mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect()
    assert per and all(abs(p["taken"] - p["target"]) <= p["most"] for p in per)


def test_pipeline_of_no_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
