"""The pipeline against a brute-force version of its stages."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
import duckdb
import pandas as pd
from pyspark.sql import functions as F

from lodestrata.llm import langid, mixing

from .test_operators import DOCS, SCHEMA, brute_contamination, brute_similar

SF = "/root/testdata/sf0.001"


def brute(rows, model, items):
    rows = [r for r in rows if (p := model.predict(r["text"]))[0] != "und" and p[1] >= corpus_pipeline.MIN_LANGUAGE_SCORE]
    first = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]), r)
    rows = list(first.values())
    component = brute_similar([r["text"] for r in rows])[1]
    rows = [r for i, r in enumerate(rows) if component[i] == i]
    bad = {i for i, *_, hit in brute_contamination([(r["doc_id"], r["text"]) for r in rows], items) if hit}
    rows = [r for r in rows if r["doc_id"] not in bad]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]))
    taken = con.execute(f"SELECT doc_id, CASE WHEN size > 0 THEN taken // size ELSE 0 END AS n FROM ({mixing.ORACLE})").fetchall()
    return Counter({i: int(n) for i, n in taken if n})


def test_pipeline_against_brute_force(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(d.filter(~langid.held_out(F.col("doc_id"), 5, 0)).select("doc_id", "text", "lang"))
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute([r.asDict() for r in d.collect()], model, items)
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == d.columns and Counter(r["doc_id"] for r in got.collect()) == want


def test_stages_handle_odd_rows(spark):
    docs = spark.createDataFrame([(*r, None) for r in DOCS], SCHEMA + ", n_chars long").withColumn("score", F.lit("clash")).withColumn("kept", F.lit(1))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), SF).count() == 0
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert docs.count() > 0
