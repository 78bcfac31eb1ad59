"""Readers, writers, jobs, command line and stream, end to end on small files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lodestrata import cli, delivery, jobs, runs, schema
from lodestrata.operators import synth
from lodestrata.sources import clients, counters, records, sinks
from lodestrata.streaming import ledger_stream


@pytest.fixture
def project(tmp_path):
    for p in ("alpha", "beta"):
        lines = [{"input": f"Which harbour has buoy {i}{p[0]}?", "context": f"Chart {p}-{i} of the coast. Since 1970 it has marked {7 * i} shoals.", "answers": [f"harbour {i}, chart {3 * i}"], "length": 9, "extra": 1} for i in range(30)]
        (tmp_path / f"{p}.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    (tmp_path / "subsets.toml").write_text("".join(f'[[subset]]\nname = "{p}"\nfile = "{p}.jsonl"\nlicense = "MIT"\ntrain_use = {use}\n' for p, use in (("alpha", "true"), ("beta", "false"))))
    return tmp_path


def test_split_corpus_and_exam(spark, project):
    m = jobs.split_manifest(spark, str(project / "subsets.toml"), str(project), str(project / "m.json"))
    assert [(s["entries"], s["eval_half"], s["train_half"]) for s in m["subsets"]] == [(30, 15, 15)] * 2
    built = jobs.build_corpus(spark, m, str(project), str(project / "c.jsonl"), str(project / "cm.json"))
    assert built["corpus"]["entries"] == 15 and built["excluded"] == ["beta"]
    assert built["corpus"]["sha256"] == sinks.sha256_file(project / "c.jsonl")
    again = jobs.build_corpus(spark, m, str(project), str(project / "c2.jsonl"), str(project / "cm2.json"))
    assert again["corpus"]["sha256"] == built["corpus"]["sha256"]
    assert jobs.build_exam(spark, m, str(project), {"alpha": 4, "beta": 2}, 3, str(project / "g.jsonl"), low=1) == 6
    assert jobs.corpus_problems(spark, [str(project / "c.jsonl")], m, [str(project / "g.jsonl")]).count() == 0
    parts = jobs.build_valid_corpus(spark, m, str(project), str(project / "parts"), str(project / "pm.json"), [str(project / "g.jsonl")], parts=True)
    assert parts["corpus"]["entries"] == 15 and sorted(r["value"] for r in spark.read.text(str(project / "parts")).collect()) == sorted((project / "c.jsonl").read_text().splitlines())
    (project / "leak.jsonl").write_text((project / "c.jsonl").read_text())
    with pytest.raises(ValueError, match="content is exam item"):
        jobs.build_valid_corpus(spark, m, str(project), str(project / "c4.jsonl"), str(project / "cm4.json"), [str(project / "leak.jsonl")])
    row = json.loads((project / "c.jsonl").read_text().splitlines()[0])
    exam = json.loads((project / "g.jsonl").read_text().splitlines()[0])
    bad = [row | {"id": "x1", "load_type": "story"}, row | {"id": "x2", "prompt": ""}, row | {"id": "x3", "source": row["source"] | {"subset": "MeetingBank"}}, row | {"id": "x4", "source": row["source"] | {"content_sha1": exam["source"]["content_sha1"]}}]
    (project / "bad.jsonl").write_text("".join(json.dumps(x) + "\n" for x in bad))
    errors = {(r["id"], r["error"]) for r in jobs.corpus_problems(spark, [str(project / "bad.jsonl")], m, [str(project / "g.jsonl")]).collect()}
    assert {("x1", "load_type is not known"), ("x2", "prompt is empty"), ("x3", "source is excluded"), ("x3", "subset is not registered"), ("x4", "fingerprint is not in the train half"), ("x4", f"content is exam item {exam['id']}")} <= errors
    with pytest.raises(ValueError, match="too few"):
        jobs.build_exam(spark, m, str(project), {"alpha": 16}, 3, str(project / "g2.jsonl"), low=1)
    (project / "alpha.jsonl").write_text((project / "beta.jsonl").read_text())
    with pytest.raises(ValueError, match="differs"):
        jobs.build_corpus(spark, m, str(project), str(project / "c3.jsonl"), str(project / "cm3.json"))


def exam_file(path, n=6):
    rows = [{"id": f"g{i}", "load_type": "rag", "prompt": f"Passage {i} says 19{i}0 is the year of the tower and the bridge.", "key_points": ["tower", f"19{i}0"], "source": {"dataset": "d", "subset": "s", "license": "MIT", "split": "eval"}} for i in range(n)]
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return rows


def test_golden_errors_are_all_reported(spark, tmp_path):
    rows = exam_file(tmp_path / "a.jsonl", 3)
    (tmp_path / "b.jsonl").write_text("\n" + json.dumps(rows[0]) + "\n{broken\n" + json.dumps(rows[1] | {"id": "n", "key_points": []}) + "\n" + json.dumps(rows[2] | {"id": "t", "source": {"split": "train"}}) + "\n")
    paths = [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")]
    got = sorted((r["file"], r["line"], r["error"]) for r in records.golden_errors(spark, paths).collect())
    assert got == [(1, 2, "id is repeated"), (1, 3, "line is not valid JSON"), (1, 4, "key_points are empty"), (1, 5, "split is not eval")]
    with pytest.raises(ValueError, match=r"line 2 .*\+3 more"):
        records.read_golden(spark, paths)
    assert records.read_golden(spark, paths[:1]).count() == 3


def test_eval_run_and_sizing(spark, tmp_path, capsys):
    exam_file(tmp_path / "g.jsonl")
    (tmp_path / "run.toml").write_text("levels = [0.2, 0.5]\nresamples = 50\nseed = 3\n")
    config = records.read_config(str(tmp_path / "run.toml"))
    folder = runs.evaluate_run(spark, config, [str(tmp_path / "g.jsonl")], str(tmp_path / "runs"), "r1")
    metrics = json.loads((folder / "metrics.json").read_text())
    assert metrics["golden"]["item_count"] == 6 and [v["level"] for v in metrics["levels"]] == [0.2, 0.5] and spark.read.parquet(str(folder / "items")).count() == 12
    assert all(r["fresh"] == 6 and r["reused"] == 0 for r in metrics["levels"]) and metrics["calls"] == {"fresh": 18, "reused": 0}
    assert "graded by: mechanical" in (folder / "report.md").read_text()
    with pytest.raises(FileExistsError):
        runs.evaluate_run(spark, config, [str(tmp_path / "g.jsonl")], str(tmp_path / "runs"), "r1")
    with pytest.raises(ValueError, match="digest"):
        runs.evaluate_run(spark, config, [str(tmp_path / "g.jsonl")], str(tmp_path / "runs"), "r2", expect_sha256="sha256:00")
    again = json.loads((runs.evaluate_run(spark, config, [str(tmp_path / "g.jsonl")], str(tmp_path / "runs"), "r2") / "metrics.json").read_text())
    assert again["calls"] == {"fresh": 0, "reused": 18} and [v["mean_delta"] for v in again["levels"]] == [v["mean_delta"] for v in metrics["levels"]]
    text = "Passage 0 says 1900 is the year of the tower and the bridge."
    payload = " ".join(w for i, w in enumerate(text.split()) if i % 10 >= 5)
    call = {"kind": "answer", "item": "g0", "level": 0.5, "payload": payload, "answer": "tower 1900", "scores": [1, 1]}
    (tmp_path / "j.jsonl").write_text(json.dumps(call | {"scores": [0, 0]}) + "\n" + json.dumps(call) + '\n{"kind": "ans')
    folder3 = runs.evaluate_run(spark, config, [str(tmp_path / "g.jsonl")], str(tmp_path / "runs"), "r3", resume_from=str(tmp_path / "j.jsonl"), journal=str(tmp_path / "other"))
    third = json.loads((folder3 / "metrics.json").read_text())
    assert [v["reused"] for v in third["levels"]] == [0, 1] and spark.read.parquet(str(folder3 / "items")).filter("id = 'g0' AND level = 0.5").first()["score"] == 1.0
    fourth = runs.evaluate_run(spark, config, [str(tmp_path / "g.jsonl")], str(tmp_path / "runs"), None, resume_from=str(folder3), journal=str(tmp_path / "more"))
    assert json.loads((fourth / "metrics.json").read_text())["calls"] == {"fresh": 0, "reused": 18} and fourth.name.split("-")[1] == "run"
    with pytest.raises(ValueError, match="answer_model"):
        runs.evaluate_run(spark, config, [str(tmp_path / "g.jsonl")], str(tmp_path / "runs"), "r5", resume_from=str(folder3), models=runs.Models(answer=len, judge=len, answer_name="m"))
    assert cli.main(["eval-compare", "--first", str(folder), "--second", str(folder3), "--out", str(tmp_path / "cmp"), "--resamples", "50"]) == 0
    found = json.loads((tmp_path / "cmp/comparison.json").read_text())
    assert [v["n_items"] for v in found["levels"]] == [6, 6] and found["levels"][0]["mean_delta"] == 0 and "r3 against r1" in (tmp_path / "cmp/report.md").read_text()
    capsys.readouterr()
    exam_file(tmp_path / "h.jsonl", 2)
    other = runs.evaluate_run(spark, config, [str(tmp_path / "h.jsonl")], str(tmp_path / "runs"), "h")
    assert cli.main(["eval-compare", "--first", str(folder), "--second", str(other), "--out", str(tmp_path / "cmp2")]) == 1 and "different exams" in capsys.readouterr().err
    assert cli.main(["eval-sizing", "--run", str(folder), "--level", "0.5"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["n_observed"] == 6
    assert cli.main(["eval-sizing", "--run", str(folder), "--level", "0.9"]) == 1 and "error:" in capsys.readouterr().err
    (tmp_path / "bad.toml").write_text("level = 1\n")
    with pytest.raises(ValueError, match="unknown keys"):
        records.read_config(str(tmp_path / "bad.toml"))


def test_synthetic_and_distill(spark, tmp_path):
    m = jobs.build_synthetic(spark, {"system_prompt": 6, "dialogue": 5}, [], str(tmp_path / "s.jsonl"), str(tmp_path / "sm.json"))
    assert m["corpus"]["load_types"] == {"system_prompt": 6, "dialogue": 5}
    with pytest.raises(ValueError, match="cannot be reached"):
        jobs.build_synthetic(spark, {"dialogue": 10_000}, [], str(tmp_path / "s2.jsonl"), str(tmp_path / "sm2.json"))
    args = {"paths": [str(tmp_path / "s.jsonl")], "budgets": {"system_prompt": 4, "dialogue": 5}, "out": str(tmp_path / "d")}
    d = runs.distill_run(spark, **args)
    assert {c["load_type"]: c["entries"] for c in d["counts"]} == {"system_prompt": 4, "dialogue": 5}
    assert runs.distill_run(spark, **args) == d
    with pytest.raises(FileExistsError, match="drop"):
        runs.distill_run(spark, **args, drop=5)
    labelled = spark.read.parquet(str(tmp_path / "d/labeled"))
    assert records.labeled_errors(labelled.withColumn("prompt", F.col("text"))).count() == 0
    swapped = labelled.withColumn("tokens", F.reverse("tokens")).withColumn("prompt", F.col("text"))
    assert records.labeled_errors(swapped).filter("error = 'spans are out of order'").count() == labelled.count()
    assert jobs.export_windows(spark, str(tmp_path / "d/labeled"), str(tmp_path / "w"), 16) >= labelled.count()


class Counted:
    """A model that notes each call in a folder, as it runs on executors."""

    def __init__(self, folder, reply):
        self.folder, self.reply = str(folder), reply

    def __call__(self, prompt):
        import os
        import uuid

        os.makedirs(self.folder, exist_ok=True)
        open(f"{self.folder}/{uuid.uuid4()}", "w").close()
        return self.reply(prompt)

    def calls(self):
        import os

        return len(os.listdir(self.folder)) if os.path.isdir(self.folder) else 0


def test_distillation_pays_once(spark, tmp_path):
    jobs.build_synthetic(spark, {"system_prompt": 6, "dialogue": 5}, [], str(tmp_path / "s.jsonl"), str(tmp_path / "sm.json"))
    frozen = json.loads((tmp_path / "sm.json").read_text())
    model = Counted(tmp_path / "calls", lambda p: clients.Reply(" ".join(p.split()[::2]), "teacher-2"))
    args = {"paths": [str(tmp_path / "s.jsonl")], "budgets": {"system_prompt": 4, "dialogue": 5}, "model": model, "model_name": "teacher", "manifest": frozen, "journal": str(tmp_path / "journal")}
    first = runs.distill_run(spark, **args, out=str(tmp_path / "d"))
    paid = model.calls()
    assert paid == sum(c["chunks"] for c in first["counts"]) > 0
    again = runs.distill_run(spark, **args, out=str(tmp_path / "d2"))
    assert model.calls() == paid and again["counts"] == first["counts"] and again["files"][0]["rows"] == 11
    report = json.loads((tmp_path / "d2/report.json").read_text())
    assert report["calls"] == {"reused": paid} and report["served_models"] == ["teacher-2"] and set(report["thresholds"]) == {"variation_rate", "alignment_gap"}
    dropped = spark.read.parquet(str(tmp_path / "d/dropped"))
    labelled = spark.read.parquet(str(tmp_path / "d/labeled"))
    assert dropped.count() + labelled.count() == paid and dropped.count() >= 2 and "teacher: teacher (served: teacher-2)" in (tmp_path / "d/report.md").read_text()
    row = labelled.first()
    assert row["chunk"]["entry_chars"] >= len(row["text"]) and row["source"]["dataset"] == "synthetic" and row["teacher_model_served"] == "teacher-2"
    with pytest.raises(ValueError, match="frozen"):
        runs.distill_run(spark, **(args | {"manifest": {"corpus": {"sha256": "0"}}}), out=str(tmp_path / "d3"))
    lines = (tmp_path / "s.jsonl").read_text().splitlines()
    (tmp_path / "twice.jsonl").write_text("\n".join([*lines, lines[0]]))
    with pytest.raises(ValueError, match="repeated"):
        runs.distill_run(spark, [str(tmp_path / "twice.jsonl")], {"dialogue": 5}, str(tmp_path / "d4"))
    (tmp_path / "story.jsonl").write_text("\n".join([*lines[1:], json.dumps(json.loads(lines[0]) | {"load_type": "story"})]))
    with pytest.raises(ValueError, match="load_type"):
        runs.distill_run(spark, [str(tmp_path / "story.jsonl")], {"dialogue": 5}, str(tmp_path / "d5"))


def test_evaluation_pays_once_and_resumes(spark, tmp_path):
    exam_file(tmp_path / "g.jsonl", 4)
    answer = Counted(tmp_path / "answers", lambda p: clients.Reply(p, "answerer-b"))
    judge = Counted(tmp_path / "grades", lambda p: '{"scores": [1, 0]}')
    models = runs.Models(compress=lambda text, level: text.upper(), answer=answer, judge=judge, compressor_name="upper", answer_name="answerer", judge_name="grader")
    config = records.RunConfig(levels=(0.2, 0.4), resamples=20)
    args = {"config": config, "golden": [str(tmp_path / "g.jsonl")], "out": str(tmp_path / "runs"), "models": models}
    first = json.loads((runs.evaluate_run(spark, name="a", **args) / "metrics.json").read_text())
    assert answer.calls() == judge.calls() == 12 and first["served_models"] == ["answerer-b"] and not first["served_as_pinned"] and first["failures"] == 0
    assert "another model" in (tmp_path / "runs/a/report.md").read_text()
    second = json.loads((runs.evaluate_run(spark, name="b", **args) / "metrics.json").read_text())
    assert answer.calls() == 12 and second["calls"] == {"fresh": 0, "reused": 12}
    wider = args | {"config": records.RunConfig(levels=(0.2, 0.4, 0.6), resamples=20), "journal": str(tmp_path / "elsewhere"), "resume_from": str(tmp_path / "runs/b")}
    third = json.loads((runs.evaluate_run(spark, name="c", **wider) / "metrics.json").read_text())
    assert answer.calls() == 16 and third["calls"] == {"fresh": 4, "reused": 12}  # only the new level is asked for
    items = spark.read.parquet(str(tmp_path / "runs/a/items"))
    items.withColumn("original_answer", F.when(F.col("level") == 0.2, "other").otherwise(F.col("original_answer"))).write.parquet(str(tmp_path / "torn/items"))
    with pytest.raises(ValueError, match="different originals"):
        records.run_ledger(spark, str(tmp_path / "torn"))


def test_http_clients(tmp_path, monkeypatch):
    import http.server
    import threading

    seen, busy = [], [503, 429]

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers.get("Authorization"), body))
            code = busy.pop() if busy and self.path.startswith("/v1") else 400 if body.get("text") == "bad" else 200
            reply = {"choices": [{"message": {"content": "short"}}], "model": "served-1"} if self.path.startswith("/v1") else {"refined_text": "s", "original_tokens": 2, "refined_tokens": 1, "cached": False, "fallback": False, "warnings": [], "refine_model": "r1"}
            if body.get("text") == "partial":
                reply.pop("cached")
            data = json.dumps(reply).encode()
            self.send_response(code)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = clients.Endpoint(f"http://127.0.0.1:{server.server_port}", pause=0.01, interval=0.02)
        chat = clients.ChatModel(at, "wanted")
        with pytest.raises(clients.CallError, match="GATEWAY_SERVICE_KEY"):
            chat("x")
        monkeypatch.setenv("GATEWAY_SERVICE_KEY", "k")
        assert chat("long prompt") == clients.Reply("short", "served-1") and len(seen) == 3
        assert seen[0][1] == "Bearer k" and seen[0][2] == {"model": "wanted", "messages": [{"role": "user", "content": "long prompt"}], "stream": False}
        refine = clients.Compressor(at)
        assert refine("two words", 0.3) == clients.Reply("s", "r1") and seen[-1][2] == {"text": "two words", "rewrite": False, "compress": True, "aggressiveness": 0.3}
        for text, why in (("bad", "400"), ("partial", "cached")):
            with pytest.raises(clients.CallError, match=why):
                refine(text, 0.1)
    finally:
        server.shutdown()
    with pytest.raises(clients.CallError, match="reached"):
        clients.ChatModel(clients.Endpoint("http://127.0.0.1:9", pause=0.01), "m")("x")


def test_configuration_tables_and_freeze(tmp_path, capsys):
    (tmp_path / "c.toml").write_text('name = "n"\n[gateway]\nurl = "http://h"\nanswer_model = "a"\njudge_model = "j"\n[compressor]\nurl = "http://c"\n')
    config = records.read_config(str(tmp_path / "c.toml"))
    models = runs.Models.of(config)
    assert models.answer.model == "a" and models.judge.model == "j" and models.compress.endpoint.url == "http://c" and models.answer_name == "a"
    (tmp_path / "d.toml").write_text("[gateway]\nkey = 1\n")
    with pytest.raises(ValueError, match="gateway.key"):
        records.read_config(str(tmp_path / "d.toml"))
    exam_file(tmp_path / "g.jsonl", 2)
    assert cli.main(["golden-freeze", "--golden", str(tmp_path / "g.jsonl"), "--out", str(tmp_path / "f.json"), "--pins", '{"seed": 3}']) == 0
    frozen = json.loads((tmp_path / "f.json").read_text())
    assert frozen["sha256"] == frozen["files"][0]["sha256"] == sinks.sha256_file(tmp_path / "g.jsonl") and frozen["pins"] == {"seed": 3}
    assert runs.run_id("n", {"a": 1}).split("-")[1] == "n" and len(runs.run_id("n", {}).split("-")[2]) == 8


def test_seeds_are_disjoint_and_regenerate(spark):
    fams = synth.families(spark)
    assert synth.range_overlaps(fams).count() == 0
    rows = synth.render(synth.candidates(fams, "eval_lo", "eval_hi")).select("load_type", "family", "seed", "prompt")
    assert synth.regeneration_errors(rows, fams).count() == 0 and synth.seed_errors(rows, fams, "eval").count() == 0
    assert rows.filter(F.col("prompt").rlike(r"[{}]")).count() == 0


def test_journal_stream_is_idempotent(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    rows = [("answer", f"i{k % 4}", 0.2, f"p{k % 4}", "a", [1], "m") for k in range(10)]
    sinks.append_journal(spark.createDataFrame(rows, schema.JOURNAL), src)
    for _ in range(2):  # a restart finds nothing new
        ledger_stream.start(ledger_stream.deduplicated(ledger_stream.records(spark, src)), out, check).awaitTermination(60)
        assert spark.read.parquet(out).count() == 4
    sinks.append_journal(spark.createDataFrame([rows[0], ("answer", "i9", 0.2, "p9", "a", [1], "m")], schema.JOURNAL), src)
    ledger_stream.start(ledger_stream.deduplicated(ledger_stream.records(spark, src)), out, check).awaitTermination(60)
    assert spark.read.parquet(out).count() == 5


def test_counters(spark, tmp_path):
    (tmp_path / "v.txt").write_text("[UNK]\nplay\n##ing\n##ed\nplay\n.\n")
    d = spark.createDataFrame([("playing played .",), (None,), ("",)], "t string")
    for c, want in ((counters.build("whitespace"), [3, None, 0]), (counters.build("words"), [3, None, 0]), (counters.build("wordpiece", str(tmp_path / "v.txt")), [5, 0, 0])):
        got = [r["n"] for r in d.select(c(F.col("t")).alias("n")).collect()]
        assert [g if g is not None and g >= 0 else None for g in got] == want
    with pytest.raises(ValueError):
        counters.build("wordpiece")


def test_delivery(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    folder = tmp_path / "ckpt"
    folder.mkdir()
    with pytest.raises(ValueError, match="fails"):
        delivery.pack(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "t.md"))
    t = Tokenizer(models.WordLevel({"[UNK]": 0}, unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    t.save(str(folder / "tokenizer.json"))
    (folder / "config.json").write_text(json.dumps({"architectures": ["XForTokenClassification"], "num_labels": 2, "id2label": {"0": "drop", "1": "keep"}}))
    (folder / "model.safetensors").write_bytes(b"x")
    (tmp_path / "t.md").write_text("Model {{MODEL}} {{DIGEST}}")
    assert delivery.verify(str(folder))["overall"] == "pass"
    report = delivery.pack(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "t.md"))
    assert report["digest"] in (tmp_path / "out/integration.md").read_text() and len((tmp_path / "out/SHA256SUMS").read_text().splitlines()) == 3
    with pytest.raises(ValueError, match="do not match"):
        sinks.render_pack("{{OTHER}}", {"MODEL": "x"})
    assert cli.main(["delivery-verify", "--checkpoint", str(tmp_path)]) == 1
