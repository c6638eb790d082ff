"""Checked scans, published exports and canonical fingerprints."""

import datetime as dt
import hashlib
import json
import math
import os

import pytest
from pyspark.sql import functions as F

from plantlume.operators.tables import fingerprint
from plantlume.sources import readers, writers


def test_every_record_is_good_or_rejected(spark, tmp_path):
    lines = ["a,b,c", "1,x,2024-01-02", "two,x,2024-01-02", "3,,", "4,y,2024-13-45", "5,z", "6,z,2024-01-02,more", ',"",2024-01-03']
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
    good, bad = readers.read_checked(spark, str(tmp_path / "t.csv"), "a int, b string, c date")
    assert {tuple(r) for r in good.collect()} == {(1, "x", dt.date(2024, 1, 2)), (3, None, None), (None, None, dt.date(2024, 1, 3))}
    assert sorted(r[readers.REJECTED] for r in bad.collect()) == sorted([lines[2], lines[4], lines[5], lines[6]])
    # what is read later decides nothing
    assert good.select("b").count() == 3 and bad.select(readers.REJECTED).count() == 4
    assert good.select("a").count() == 3


def test_json_records_are_checked(spark, tmp_path):
    docs = [{"a": 1, "b": {"c": "x"}}, {"a": "one", "b": {"c": "x"}}, {"b": None}]
    (tmp_path / "t.json").write_text("\n".join(map(json.dumps, docs)) + "\nnot json\n")
    good, bad = readers.read_checked(spark, str(tmp_path / "t.json"), "a int, b struct<c: string>", "json")
    assert {r["a"] for r in good.collect()} == {1, None} and bad.count() == 2


def test_empty_file_has_no_records(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n")
    good, bad = readers.read_checked(spark, str(tmp_path / "t.csv"), "a int, b string")
    assert good.count() == 0 and bad.count() == 0


def rows_of(spark):
    return spark.createDataFrame([(1, "x", 0.1, "p"), (2, None, -3.5, "q"), (3, "é,\n\"", None, "p")], "k long, t string, v double, part string")


@pytest.mark.parametrize("fmt, partition_by", [("parquet", ["part"]), ("parquet", []), ("json", [])])
def test_published_rows_come_back(spark, tmp_path, fmt, partition_by):
    df, root = rows_of(spark), str(tmp_path / "out")
    entry = writers.publish(df, root, "t", "v1", partition_by, fmt)
    assert entry.filas == 3
    back = writers.read_published(spark, root, "t", "v1", df)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    # a rerun of the version writes nothing, also from other rows; a new version stands beside it
    assert writers.publish(df.limit(0), root, "t", "v1", partition_by, fmt) == entry
    assert writers.publish(df.limit(2), root, "t", "v2", partition_by, fmt).filas == 2
    assert writers.read_published(spark, root, "t", "v1", df).count() == 3
    with pytest.raises(ValueError):
        writers.read_published(spark, root, "t", "v3", df)


def test_failed_publication_leaves_nothing(spark, tmp_path, monkeypatch):
    df, root = rows_of(spark), str(tmp_path / "out")
    real = writers._read
    monkeypatch.setattr(writers, "_read", lambda *a: real(*a).limit(2))
    with pytest.raises(ValueError):
        writers.publish(df, root, "t", "v1")
    assert os.listdir(f"{root}/t") == []
    monkeypatch.setattr(writers, "_read", real)
    os.makedirs(f"{root}/t/version=v1")  # as if a run had stopped between the rename and the manifest
    assert writers.publish(df, root, "t", "v1").filas == 3


def test_ordered_export(spark, tmp_path):
    df = spark.range(100).select((F.col("id") * 37 % 101).alias("k"))
    entry = writers.publish(df, str(tmp_path), "t", "v1", fmt="csv", order=[F.desc("k")])
    parts = sorted(p for p in os.listdir(entry.path) if p.startswith("part"))
    read = [int(x) for p in parts for x in open(f"{entry.path}/{p}").read().split()[1:]]
    assert read == sorted(read, reverse=True) and len(read) == 100


def test_fingerprint_by_hand(spark):
    """The code of a row as any engine would write it."""
    rows = [
        (1, "é", 0.1, True, dt.date(1970, 1, 3), dt.datetime(1970, 1, 1, 0, 0, 1, 5), [1.5, None]),
        (None, None, None, None, None, None, None), (-7, "", float("nan"), False, dt.date(1969, 12, 31), dt.datetime(2024, 1, 1), []),
        (2, "a", float("-inf"), None, None, None, None), (2, "a", -2.75, None, None, None, None), (2, "a", -2.75, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "i int, t string, x double, b boolean, d date, s timestamp_ntz, l array<float>")

    def real(x):
        if math.isnan(x):
            return "fn"
        if math.isinf(x):
            return "f+" if x > 0 else "f-"
        fine = (x - math.floor(x)) * 2**53
        return f"f{math.floor(x)},{math.floor(fine)},{math.floor((fine - math.floor(fine)) * 2**53)}"

    def code(i, t, x, b, d, s, items):
        out = {
            "i": i is not None and f"i{i}", "t": t is not None and f"s{len(t.encode())}:{t}", "x": x is not None and real(x),
            "b": b is not None and ("b1" if b else "b0"), "d": d is not None and f"d{(d - dt.date(1970, 1, 1)).days}",
            "s": s is not None and f"t{(s - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)}",
            "l": items is not None and f"a{len(items)}:" + "".join("n" if v is None else real(v) for v in items),
        }
        return "".join(out[k] or "n" for k in sorted(out))

    lanes = [0] * 8
    for r in rows:
        h = hashlib.sha256(code(*r).encode()).hexdigest()
        lanes = [v + int(h[8 * k : 8 * k + 8], 16) for k, v in enumerate(lanes)]
    got = fingerprint(df).first()
    assert (got["fingerprint"], got["filas"]) == (hashlib.sha256(",".join(map(str, lanes)).encode()).hexdigest(), 6)
    assert fingerprint(df.repartition(3)).first() == got
    assert fingerprint(df.limit(0)).first()["filas"] == 0
    assert fingerprint(df.dropDuplicates()).first()["fingerprint"] != got["fingerprint"]
