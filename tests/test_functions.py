"""Text functions, matcher, chunker, metrics, statistics and windows: hand-computed values and invariants."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import distill, ledger, splits, stats, windows


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text,want", [("#A-12345", ["#A-12345"]), ("on 2026-07-19.", ["2026-07-19"]), ("12.5% v2.14.3", ["12.5%", "2.14.3"]), ("3/4 of 555-0100", ["3/4", "555-0100"]), ("$84k", ["84"]), ("none", [])])
def test_facts(spark, text, want):
    assert value(spark, T.facts(F.lit(text))) == want


def test_fact_recall(spark):
    recall = lambda a, b: value(spark, T.fact_recall(F.lit(a), F.lit(b)))
    assert recall("one 11 two 22 three 33 four 44", "one 11 three 33 four 44") == 0.75
    assert recall("on 2026-07-19", "on 2026-07") == 0.0 and recall("no facts", "") == 1.0


def test_words_and_f05(spark):
    assert value(spark, T.word_tokens(F.lit("The quick, brown fox."))) == ["The", "quick", "brown", "fox", "."]
    assert value(spark, T.word_tokens(F.lit("don't re-run"))) == ["don't", "re-run"]
    f05 = lambda a, b: value(spark, T.f05(T.overlap(F.lit(a), F.lit(b)), F.size(F.lit(a)), F.size(F.lit(b))))
    assert f05(["a", "a", "b"], ["a", "a", "a"]) == pytest.approx(2 / 3)
    assert value(spark, T.f05(F.lit(0), F.lit(3), F.lit(0))) == 0.0
    with pytest.raises(Exception, match="no tokens"):
        value(spark, T.f05(F.lit(0), F.lit(0), F.lit(0)))


@pytest.mark.parametrize("level,kept", [(0.0, 20), (0.25, 16), (0.35, 12), (0.5, 10), (1.0, 1)])
def test_compression(spark, level, kept):
    words = " ".join(f"w{i}" for i in range(20))
    assert len(value(spark, T.stub_compress(F.lit(words), T.dropped_per_ten(level))).split()) == kept


def test_key_points(spark):
    points = lambda xs: value(spark, T.key_points(F.lit(xs)))
    assert points(["", "  ", "the real one"]) == ["the real one"]
    long = " ".join(f"Sentence {i} has the number {i * 7}." for i in range(30))
    assert points([long]) == [f"Sentence {i} has the number {i * 7}." for i in range(6)]
    assert value(spark, T.split_sentences(F.lit("See Title 5 of the U.S. Code. S. 2 passed. Done!"))) == ["See Title 5 of the U.S. Code.", "S. 2 passed.", "Done!"]


def test_judge(spark):
    reply = value(spark, T.judge_reply(F.lit(["brown fox", "of it", "red hen"]), F.lit("A brown quick fox")))
    assert reply == '{"scores":[1,1,0]}'
    parse = lambda s, n: value(spark, T.parse_judge(F.lit(s), F.lit(n)))
    assert parse("so: " + reply + " ok", 3) == [1, 1, 0] and parse('{"scores": [1.0]}', 1) == [1]
    assert parse(reply, 2) is None and parse('{"scores": [true]}', 1) is None and parse("none", 1) is None and parse('{"scores": [2]}', 1) is None
    assert value(spark, T.mean_score(F.lit([1, 0]))) == 0.5


def test_matcher():
    assert distill.match(["a", "a"], ["a", "b"]) == ([True, False], 1)
    assert distill.match(["a", "b"], ["a", "a"]) == ([True, False], 2)
    far = [f"w{i}" for i in range(300)]
    assert distill.match(far, ["w299"], 150) == ([False] * 300, 1)
    labels, found = distill.match(far[:200], ["w0", "w160"], 150)
    assert found == 2 and labels[0] and sum(labels) == 1


def plain_match(origin, compressed, window):
    """Sorts all untaken equal places of each word by distance, those ahead first."""
    taken, cursor = set(), 0
    for word in compressed:
        ranked = sorted((abs(i - cursor), i < cursor, i) for i, w in enumerate(origin) if w == word and i not in taken)
        if ranked and ranked[0][0] < window:
            taken.add(ranked[0][2])
            cursor = min(ranked[0][2], cursor + window // 2)
    return [i in taken for i in range(len(origin))], sum(w in origin for w in compressed)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=25), st.lists(st.sampled_from("abcde"), max_size=25), st.integers(1, 12))
def test_matcher_against_the_plain_rule(origin, compressed, window):
    assert distill.match(origin, compressed, window) == plain_match(origin, compressed, window)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é.!?\n,", max_size=120), st.integers(1, 7), st.sampled_from(["greedy", "reference"]))
def test_chunks_tile_the_text_within_the_cap(text, cap, mode):
    for count in (distill.ws_count, len):
        pieces = distill.chunk(text, cap, count, mode)
        assert "".join(text[a:b] for a, b in pieces) == text
        assert all(count(text[a:b]) <= cap and a < b for a, b in pieces)


def test_reference_mode_cuts_single_words():
    text = " ".join(["word"] * 40)
    sizes = [distill.ws_count(text[a:b]) for a, b in distill.chunk(text, 16, mode="reference")]
    assert sizes == [1] * 24 + [16]
    assert [distill.ws_count(text[a:b]) for a, b in distill.chunk(text, 16)] == [16, 16, 8]


def test_native_chunk_counts_agree(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    native = {r["doc_id"]: r["n"] for r in d.select("doc_id", distill.chunk_counts(F.col("text"), 40).alias("n")).collect()}
    streamed = {r["doc_id"]: r["count"] for r in distill.chunks(d, cap=40).groupBy("doc_id").count().collect()}
    assert sum(abs(native[k] - streamed.get(k, 0)) > 0 for k in native) == 0


def test_label_chunk_and_metrics(spark):
    d = spark.createDataFrame([("Alpha beta gamma. Delta epsilon.", "Alpha gamma Delta"), ("", "x")], "t string, c string")
    rows = distill.label_chunks(d, "t", "c").collect()
    assert [t["keep"] for t in rows[0]["tokens"]] == [1, 0, 1, 0, 1, 0, 0] and rows[0]["num_find"] == 3 and rows[1]["tokens"] == []
    assert [(t["text"], t["start"], t["end"]) for t in rows[0]["tokens"]][3:5] == [(".", 16, 17), ("Delta", 18, 23)]
    m = spark.createDataFrame([(5, 3, 2, 2), (5, 0, 0, 0), (0, 1, 0, 0)], "o int, c int, k int, f int")
    a, b, c = distill.label_metrics(m, "o", "c", "k", "f").collect()
    assert (a["variation_rate"], a["hitting_rate"], a["matching_rate"], a["alignment_gap"]) == pytest.approx((1 / 3, 0.4, 0.4, 0.0))
    assert b["variation_rate"] == 1.0 and c["hitting_rate"] is None


def test_quality_control(spark):
    d = spark.createDataFrame([(f"r{i:02d}", i / 40, i / 50) for i in range(40)], "id string, variation_rate double, alignment_gap double")
    got = {r["id"]: r["dropped_by"] for r in distill.quality_control(d, 0.05, 0.10).collect()}
    assert sum(v is None for v in got.values()) == 34 and got["r39"] == got["r38"] == "variation_rate" and got["r37"] == "alignment_gap"
    with pytest.raises(ValueError):
        distill.quality_control(d, 1.0)


def test_budget_select_skips_and_goes_on(spark):
    rows = [("a", i, n, f"e{i}") for i, n in enumerate((5, 4, 3, 1))] + [("b", 9, 1, "x")]
    got = distill.budget_select(spark.createDataFrame(rows, "load_type string, pos int, need int, id string"), {"a": 8})
    assert sorted(r["id"] for r in got.collect()) == ["e0", "e2"]


def test_percentile_and_bootstrap(spark):
    d = spark.createDataFrame([(float(x),) for x in (10, 20, 30, 40)], "x double")
    ranks = stats.percentiles(d.withColumn("g", F.lit(1)), ["g"], "x", {"p": 95})
    assert ranks.first()["p"] == pytest.approx(38.5) and stats.percentiles(d.limit(0).withColumn("g", F.lit(1)), ["g"], "x", {"p": 95}).count() == 0
    deltas = spark.createDataFrame([("g", i, x) for i, x in enumerate((-0.60, 0.0, 0.25))], "g string, id int, delta double")
    r = stats.seeded_bootstrap(deltas, "g", resamples=10_000, seed=7).first()
    assert r["mean_delta"] == pytest.approx(-0.116667, abs=1e-6) and (r["ci_low"], r["ci_high"]) == pytest.approx((-0.60, 0.25))
    b = stats.bootstrap(deltas, "g", resamples=2000).first()
    assert b["ci_low"] == pytest.approx(-0.60) and b["ci_high"] == pytest.approx(0.25) and not b["not_negative"]


def test_sizing_degenerate(spark):
    d = spark.createDataFrame([("a", 0.5), ("a", 0.5), ("b", -0.1)], "g string, delta double")
    rows = {r["g"]: r for r in stats.sizing(d, "g").filter("NOT overall").collect()}
    assert rows["a"]["cohens_d"] is None and rows["a"]["degenerate"] and rows["b"]["std_delta"] == 0.0


@pytest.mark.parametrize("n", [0, 1, 2, 7, 30, 999])
def test_half_split_gives_eval_the_larger_half(spark, n):
    fps = [f"{random.Random(n).getrandbits(160) + i:040x}" for i in range(n)]
    d = spark.createDataFrame([("s", f) for f in fps + fps[:3]], "subset string, fp string").repartition(3)
    got = {r["fp"]: r["half"] for r in splits.half_split(d).collect()}
    assert got == {f: "eval" if k < (n + 1) // 2 else "train" for k, f in enumerate(sorted(fps))}


def test_replay_needs_the_same_payload(spark):
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, payload string")
    known = spark.createDataFrame([(1, "a", "x"), (2, "c", "y"), (3, None, "z")], "id int, payload string, answer string")
    got = {r["id"]: (r["source"], r["replayed"]) for r in ledger.replay(items, known, ["id"]).collect()}
    assert got == {1: ("reused", "x"), 2: ("fresh", None), 3: ("fresh", None)}


def test_align_and_pack(spark):
    text = "the quick brown fox"
    words = [(0, 3, 1), (4, 9, 0), (10, 15, 1), (16, 19, 0)]
    assert windows.align(words, windows.pieces(text, 3)) == [(1, 0), (0, 1), (0, 1), (1, 2), (1, 2), (0, 3)]
    d = spark.createDataFrame([("r", text, words), ("e", "", [])], "id string, t string, s array<struct<start:int,end:int,keep:int>>")
    aligned = windows.align_labels(d, "t", "s", lambda t: windows.pieces(t, 3))
    got = {(r["id"], r["window"]): r["labels"] for r in windows.windows(aligned, "subwords", 5).collect()}
    assert got == {("r", 0): [1, 0, 0], ("r", 1): [1, 1, 0]}
    sizes = windows.group_sizes(F.transform("subwords", lambda s: s["owner"]))
    packed = {r["id"]: (r["p"]["windows"], r["p"]["truncated"]) for r in aligned.select("id", windows.pack(sizes, 5).alias("p")).collect()}
    assert packed == {"r": (2, 0), "e": (0, 0)}
    assert spark.range(1).select(windows.pack(F.lit([2, 9, 1]), 5).alias("p")).first()["p"].asDict() == {"windows": 3, "truncated": 6}
