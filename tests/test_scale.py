"""What large tables need: memory that does not follow the rows of a batch, work that does not follow the square of a text or stand in one task."""

from __future__ import annotations

import hashlib
import re
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import distill, evaluate, stats, windows
from lodestrata.partitions import slices
from lodestrata.plans import catalog


def test_slices_are_whole_rows_in_order():
    batch = pa.RecordBatch.from_pydict({"t": ["aaaa", None, "b" * 30, "", "cc", "d"], "l": [[1], [], None, [2, 3], [4], [5]]})
    got = list(slices([batch, batch.slice(2, 0), batch.slice(3)], "t", "l", most=6))
    assert [s.column("t").to_pylist() for s in got] == [["aaaa", None], ["b" * 30], ["", "cc"], ["d"], ["", "cc"], ["d"]]
    assert pa.Table.from_batches(got[:4]).to_pydict() == batch.to_pydict()


def test_align_labels_holds_a_slice_not_a_batch(spark):
    """the subwords of a whole batch (3 million here) stood in Python at once."""
    text = "lorem ipsum dolor " * 250
    words = F.transform(F.sequence(F.lit(0), F.lit(3999), F.lit(18)), lambda a: F.struct(a.alias("start"), (a + 5).alias("end"), F.lit(1).alias("keep")))

    def seen(t: str) -> list[tuple[int, int]]:
        with open("/proc/self/statm") as f:
            mb = int(f.read().split()[1]) * 4096 >> 20
        return [(0, mb), *windows.pieces(t, 4)]

    d = spark.range(0, 2000, 1, 1).select("id", F.lit(text).alias("t"), words.alias("s"))
    mb = windows.align_labels(d, "t", "s", seen, kept=["id"]).select("id", F.col("subwords")[0]["end"].alias("mb"), F.size("subwords").alias("n"))
    r = mb.agg((F.max("mb") - F.min("mb")).alias("grown"), F.count(F.lit(1)).alias("n"), F.min("n").alias("least")).first()
    assert r["n"] == 2000 and r["least"] == 1 + len(windows.pieces(text, 4)) and r["grown"] < 100


def test_label_chunks_holds_a_slice_not_a_batch(spark):
    d = spark.range(0, 2000, 1, 1).select("id", F.lit("lorem ipsum, dolor " * 250).alias("t"), F.lit("ipsum dolor " * 250).alias("c"))
    r = distill.label_chunks(d, "t", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("tokens")).alias("words"), F.min("n_comp").alias("short")).first()
    assert (r["n"], r["words"], r["short"]) == (2000, 750, 500)


def test_draws_are_dealt_by_number_and_meet_blocks(spark, monkeypatch):
    """the few rows that stand for all draws were dealt by a key, which AQE joins to one task, and each draw was a row of a join."""
    monkeypatch.setattr(stats, "DRAWS", 16)
    monkeypatch.setattr(stats, "DRAWN", 70)
    given = {"a": [0.25 * i for i in range(50)], "b": [1.5], "c": [None, 2.0, None, 4.0], "d": [None] * 3}
    d = spark.createDataFrame([(g, i, x) for g, xs in given.items() for i, x in enumerate(xs)], "g string, id int, delta double")
    means = stats.resample_means(d, "g", "id", "delta", 10, 3)
    plan = means._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "REPARTITION_BY_COL" not in plan
    want = {}
    for g, xs in given.items():
        for r in range(10):
            drawn = [xs[int(hashlib.md5(f"3:{r}:{i}".encode()).hexdigest()[:8], 16) % len(xs)] for i in range(len(xs))]
            want[g, r] = sum(x or 0.0 for x in drawn) / len(xs) if any(x is not None for x in drawn) else None
    assert {(x["g"], x["r"]): x["mean"] for x in means.collect()} == pytest.approx(want)


def test_overlap_counts_a_slice_at_a_time(monkeypatch):
    """all words of a batch were sorted at once, with ten arrays as long; now as many as a slice holds."""
    sides = [pa.array([[k % 7 for k in range(n)] for _ in range(400)], pa.list_(pa.int64())) for n in (900, 500)]
    made = {}
    monkeypatch.setattr(T.F, "arrow_udf", lambda kind: lambda f: made.setdefault("f", f) and (lambda *a: a[0]), raising=False)
    monkeypatch.setattr(T.F, "transform", lambda words, f: words)
    T.overlap(None, None)
    tracemalloc.start()
    got = made["f"](*sides)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert got.to_pylist() == [sum(min(sum(k % 7 == w for k in range(n)) for n in (900, 500)) for w in range(7))] * 400 and peak < 20


def test_pieces_carry_no_whole_text(spark):
    """F5, F6, F8, F9, F10: each piece was given all words of its text, so that a text cost the square of its length."""
    plan = catalog.pieces(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode" in plan and not re.search(r"slice\(\w+#", plan)


def test_match_labels_makes_no_string_of_each_word(spark):
    """case counts as little as in match(); rows of any length, none, repeated and other words."""
    rows = [(1, ["Ab", "c", "ab", "C"], ["AB", "ab", "x", "c"]), (2, [], ["x"]), (3, ["İ", "ß"], ["i̇", "SS"]), (4, ["z"] * 300, ["Z"] * 200)]
    d = spark.createDataFrame(rows, "id int, o array<string>, c array<string>").coalesce(1)
    got = {r["id"]: (r["labels"], r["num_find"], r["n_origin"], r["n_comp"], r["n_kept"]) for r in distill.match_labels(d, "o", "c", 24).collect()}
    for i, o, c in rows:
        labels, found = distill.match(o, c, 24)
        assert got[i] == (labels, found, len(o), len(c), sum(labels))


@pytest.mark.parametrize("pattern,idle", [(T.WORD, T.NO_WORD), (T.FACT, T.NO_FACT)])
def test_skipped_runs_hide_no_match(spark, pattern, idle):
    """F7 and the word steps: each character between matches was a match of its own."""
    texts = ["", "a_b  c\tcafé №5 x'y-z' 'q", "#A-1 ##b _#c_ 3/4-5.%", "٣٤.5% e9 𝟗 #\n9:", "\u00a0 -- ' 7", "9" * 50 + " _" * 50 + "#x"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    got = d.select(T.all_matches(F.col("t"), pattern, idle).alias("a"), T.all_matches(F.col("t"), pattern).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and sum(len(r["a"]) for r in got) > 10


def test_bare_metrics_write_no_words(spark):
    """the kept words and text of each level were written to be counted and searched, also where no fact is looked for."""
    d = spark.createDataFrame([(1, "a 1 b 2 c 3 d 4 e 5 f 6"), (2, "no number here at all"), (3, "7")], "id int, text string")
    items = evaluate.sweep(evaluate.prepare(d), catalog.LEVELS)
    whole, bare = evaluate.item_metrics(items), evaluate.item_metrics(items, bare=True)
    columns = [c for c in whole.columns if c != "compressed"]
    assert bare.columns == columns and sorted(bare.collect()) == sorted(whole.select(columns).collect())
    assert "_kept#" not in bare._jdf.queryExecution().optimizedPlan().toString()
