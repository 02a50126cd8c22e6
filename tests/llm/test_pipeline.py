"""The stages in a row, over documents with known cases."""

import re

import corpus_pipeline as C
from pyspark.sql import functions as F

from .conftest import text


def test_stages(spark, frame, tmp_path):
    passage = text(500, 70)
    rows = [
        (1, text(1, 150)), (2, text(1, 150)), (3, text(1, 149) + " changed"), (4, "12 34 !!"), (5, None), (6, text(6, 100) + " " + passage), (7, text(7, 90) + " " + passage + " " + text(70, 20)),
        (8, text(8, 60) + ' token = "0123456789abcdef0123456789abcdef" ' + text(80, 30)), (9, text(9, 40)),
    ]
    docs = frame(rows).withColumn("text", F.col("text"))
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        out.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
    got = {r.doc_id: r for r in docs.collect()}
    assert sorted(got) == [1, 6, 7, 8, 9]
    assert got[1].text == rows[0][1] and got[9].text == rows[8][1] and got[6].text == rows[5][1]
    assert got[7].text == f"{text(7, 90)} {text(70, 20)}" and got[7].n_chars == len(got[7].text)
    assert re.search(r'\[SECRET\]" ', got[8].text) and "0123456789abcdef" not in got[8].text
    packed = C.STAGES[-1][1](spark, docs, "").collect()
    assert {p.doc_id for p in packed} == set(got) and len({p.sequence_id for p in packed}) >= 1


def test_names_and_order():
    assert [n for n, _ in C.STAGES] == ["language_id", "minhash_near_dedup", "substring_dedup", "secret_scan", "packing"]


def test_rows_without_an_id_and_repeated_rows(spark, frame, tmp_path):
    passage, secret = text(500, 70), ' token = "0123456789abcdef0123456789abcdef" '
    once = text(8, 60) + secret + text(80, 30)
    rows = [
        (1, once), (1, once), (1, text(11, 50)), (2, text(2, 100) + " " + passage), (3, "12 ab"), (3, "12 ab"),
        (None, text(3, 60) + secret + text(31, 20)), (None, text(4, 90) + " " + passage), (None, text(2, 100) + " " + passage), (None, text(6, 40)), (4, "\t"), (4, "\t"), (4, None), (None, None), (None, None),
    ]
    docs = frame(rows)
    left = {}
    for name, stage in C.STAGES[1:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        out.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        left[name] = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    near = [rows[i] for i in (0, 2, 3, 4, 6, 7, 9, 10, 12, 13, 14)]
    assert left["minhash_near_dedup"] == sorted(near, key=str)
    cut = [(i, text(4, 90)) if t == rows[7][1] else (i, t) for i, t in near]
    assert left["substring_dedup"] == sorted(cut, key=str)
    assert len(left["secret_scan"]) == len(cut) and not any("0123456789abcdef" in (t or "") for _, t in left["secret_scan"])
    packed = C.STAGES[-1][1](spark, docs, "").collect()
    assert sum(p.start == 0 for p in packed) == len(cut) and sum(p.start == 0 for p in packed if p.doc_id is None) == 5
