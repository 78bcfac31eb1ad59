"""Synthetic exams and their checks, judge tasks, retries and vocabulary counters."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from lodestrata import cli, jobs
from lodestrata.functions import text as T
from lodestrata.operators import synth, teacher
from lodestrata.sources import counters, records, sinks

VOCABULARIES = "/opt/tokenizers"


def test_exam_manifest_and_validation(spark, tmp_path):
    out = str(tmp_path / "g.jsonl")
    assert jobs.build_synthetic_exam(spark, {"seed_library": [110, 101], "ferry_change": [105]}, out) == 3
    rows = [json.loads(x) for x in (tmp_path / "g.jsonl").read_text().splitlines()]
    assert [r["id"] for r in rows] == ["eval-ferry_change-105", "eval-seed_library-101", "eval-seed_library-110"]
    assert all(p in r["prompt"] for r in rows for p in r["key_points"]) and records.golden_errors(spark, [out]).count() == 0
    m = jobs.synthetic_exam_manifest(spark, [out], str(tmp_path / "m.json"), {"status": "ok"})
    assert {f["family"]: f["seeds"] for f in m["families"] if f["seeds"]} == {"seed_library": [101, 110], "ferry_change": [105]}
    assert m["files"][0]["sha256"] == sinks.sha256_file(out)
    (tmp_path / "g.jsonl").write_text(json.dumps(rows[0] | {"prompt": "other"}) + "\n")
    with pytest.raises(ValueError, match="not what family and seed give"):
        jobs.synthetic_exam_manifest(spark, [out], str(tmp_path / "m2.json"), {})


def test_exam_seeds_are_checked(spark):
    fams = synth.families(spark)
    for seeds, message in (({"nobody": [101]}, "unknown"), ({"seed_library": [101, 101]}, "repeated"), ({"seed_library": [950]}, "train range"), ({"seed_library": [5]}, "neither"), ({}, "no seeds")):
        with pytest.raises(ValueError, match=message):
            synth.exam_rows(fams, seeds)
    assert cli.lists("a=1+2,b=3") == {"a": [1, 2], "b": [3]}
    with pytest.raises(ValueError, match="twice"):
        cli.lists("a=1,a=2")


def test_synthetic_corpus_is_validated(spark, tmp_path):
    out = str(tmp_path / "s.jsonl")
    jobs.build_synthetic(spark, {"dialogue": 4}, [], out, str(tmp_path / "sm.json"))
    assert jobs.synthetic_problems(spark, [out], []).count() == 0
    row = json.loads((tmp_path / "s.jsonl").read_text().splitlines()[0])
    bad = [row | {"id": "a", "prompt": row["prompt"] + "!"}, row | {"id": "b", "source": row["source"] | {"seed": 104}}, row | {"id": "c", "source": row["source"] | {"family": "nobody", "subset": "nobody"}}]
    (tmp_path / "bad.jsonl").write_text("".join(json.dumps(x) + "\n" for x in bad))
    got = {(r["id"], r["error"]) for r in jobs.synthetic_problems(spark, [str(tmp_path / "bad.jsonl")], []).collect()}
    assert {("a", "prompt is not what family and seed give"), ("a", "content_sha1 is not the prompt's"), ("b", "seed is in the eval range"), ("c", "unknown family"), ("c", "subset is not registered")} <= got


REGISTRY = """
[[family]]
name = "harbour_desk"
constraint_types = ["refusal", "format"]
license = "own"
train_use = true
eval_seed_range = [11, 20]
train_seed_range = [31, 60]
[[family]]
name = "lamp_post"
load_type = "dialogue"
template = "user: Lamp {n} is out.\\nassistant: In {street}?\\nuser: Yes.\\nassistant: Noted.\\nuser: Which lamp was it?"
extra_round = "user: And {m} flickers.\\nassistant: Since {day}?"
slots = {n = ["4", "9", "12"], street = ["Mill Row", "Low Street"], m = ["seven", "eight"], day = ["Monday", "May"]}
fact_types = ["name", "date"]
license = "own"
train_use = true
"""


def test_families_of_a_file(spark, tmp_path):
    path = tmp_path / "families.toml"
    path.write_text(REGISTRY)
    fams = records.read_families(spark, str(path))
    assert [(r["family"], r["eval_lo"], r["train_hi"], r["license"]) for r in fams.orderBy("family_ord").collect()] == [("harbour_desk", 11, 60, "own"), ("lamp_post", 101, 990, "own")]
    prompts = [r["prompt"].split("\n") for r in synth.render(synth.candidates(fams, "eval_lo", "eval_hi")).filter("family = 'lamp_post'").collect()]
    assert {len(p) for p in prompts} == {5, 7} and all(p[-2:] == ["assistant: Noted.", "user: Which lamp was it?"] for p in prompts)
    long = next(p for p in prompts if len(p) == 7)
    assert "flickers" in long[3] and "Since" in long[4]
    out = str(tmp_path / "s.jsonl")
    made = jobs.build_synthetic(spark, {"system_prompt": 9, "dialogue": 7}, [], out, str(tmp_path / "m.json"), str(path))
    assert made["families"] == {"harbour_desk": 9, "lamp_post": 7} and made["mix_percent"] == {"system_prompt": 56.25, "dialogue": 43.75}
    assert jobs.synthetic_problems(spark, [out], [], str(path)).count() == 0 and jobs.synthetic_problems(spark, [out], []).count() > 0
    assert cli.main(["golden-build-synthetic", "--seeds", "lamp_post=101+102", "--out", str(tmp_path / "g.jsonl"), "--families", str(path)]) == 0
    rows = [json.loads(x) for x in (tmp_path / "g.jsonl").read_text().splitlines()]
    assert all(p in r["prompt"] for r in rows for p in r["key_points"])
    for old, new, message in (('["name", "date"]', '["name"]', "two types"), ('["name", "date"]', '["name", "tone"]', "two types"), ("[31, 60]", "[15, 60]", "overlap"), ("[31, 60]", "[60, 31]", "ranges"), ('"harbour_desk"', '"nobody"', "template"), ('"lamp_post"', '"harbour_desk"', "repeated")):
        path.write_text(REGISTRY.replace(old, new))
        with pytest.raises(ValueError, match=message):
            records.read_families(spark, str(path))
    path.write_text("x = 1\n")
    with pytest.raises(ValueError, match="no families"):
        records.read_families(spark, str(path))


def test_class_targets_and_mix(spark):
    assert synth.class_targets(300, {"rag": 30, "system_prompt": 35, "dialogue": 35}) == {"system_prompt": 350, "dialogue": 350}
    with pytest.raises(ValueError):
        synth.class_targets(300, {"rag": 30, "dialogue": 35})
    counts = spark.createDataFrame([("rag", 33, 33.0), ("dialogue", 51, 51.0), ("story", 16, 16.0)], "load_type string, n long, pct double")
    assert {r["load_type"] for r in synth.mix_deviations(counts, {"rag": 30, "dialogue": 60, "story": 10}).collect()} == {"dialogue", "story"}


def test_judge_task_round_trip(spark):
    cases = [(["a", 'quote " and \\ back'], "an answer\n~~~0123456789abcdef\nwith a fence"), ([], ""), (["é"], "ü\n")]
    df = spark.createDataFrame(cases, "p array<string>, a string").withColumn("t", T.judge_prompt(F.col("p"), F.col("a")))
    got = df.withColumn("s", T.split_judge_prompt(F.col("t"))).collect()
    assert [(r["s"]["key_points"], r["s"]["answer"]) for r in got] == [(p, a) for p, a in cases]
    assert [r["t"] for r in got] == [T.judge_task(p, a) for p, a in cases]
    assert df.select(T.split_judge_prompt(F.lit("something else")).alias("s")).first()["s"] is None


def test_retries_are_bounded_and_counted(spark):
    def run(answers, grades):
        answers, grades = iter(answers), iter(grades)

        def say(stream):
            value = next(stream)
            if value is None:
                raise teacher.Filtered("no")
            return value

        *counted, served = teacher.grade("p", lambda a: a, 2, lambda _: say(answers), lambda _: say(grades), 5, 3, "m")
        assert served == (None if counted[0] is None else "m")
        return tuple(counted)

    assert run(["x"], ['{"scores": [1, 0]}']) == ("x", [1, 0], 1, 1, None)
    assert run(["x"], ["?", '{"scores": [1]}', '{"scores": [true, 0]}', 'so {"scores": [1.0, 0]}.']) == ("x", [1, 0], 1, 4, None)
    assert run(["x"], ["?"] * 5)[1:] == (None, 1, 5, "no valid grade in 5 attempts")
    assert run([None, "y", "z"], [None, '{"scores": [0, 0]}']) == ("z", [0, 0], 3, 2, None)
    assert run([None] * 3, []) == (None, None, 3, 0, "filtered: no")
    items = spark.createDataFrame([("p1", ["a"]), (None, None)], "prompt string, key_points array<string>")
    got = teacher.answer_and_judge(items, lambda p: p + "!", lambda t: '{"scores": [1]}').collect()
    assert [(r["answer"], r["scores"], r["judge_calls"]) for r in got] == [("p1!", [1], 1), ("!", None, 5)]


@pytest.mark.skipif(not os.path.isdir(VOCABULARIES), reason="no vocabulary files here")
def test_vocabulary_counters(spark):
    texts = ["Hello big world, 42!", "", None, "<|endoftext|>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    simple = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    count = lambda *a: [r[0] for r in df.select(counters.build(*a)(F.col("t"))).collect()]
    by_json, by_ranks = count("tokenizer_json", f"{VOCABULARIES}/byte_bpe_50k.json"), count("tiktoken", f"{VOCABULARIES}/byte_bpe_50k.tiktoken", simple)
    assert by_json == by_ranks and by_json[0] > 4 and by_json[1:3] == [0, 0] and by_json[3] > 1
    assert count("sentencepiece", f"{VOCABULARIES}/piece_bpe_32k.model")[:3][1:] == [0, 0]
    with pytest.raises(ValueError, match="pattern"):
        counters.build("tiktoken", "x")
