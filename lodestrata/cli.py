"""Command line: python -m lodestrata.cli COMMAND ... (errors go to stderr as `error: ...`, exit 1)."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import functions as F

from . import delivery, jobs, runs
from .operators import stats
from .session import get_session
from .sources import clients, counters, records, sinks


def pairs(text: str) -> dict[str, int]:
    """name=number,name=number"""
    out = dict(p.split("=", 1) for p in text.split(","))
    return {k: int(v) for k, v in out.items()}


def lists(text: str) -> dict[str, list[int]]:
    """name=1+2+3,name=4; a name that is given twice is refused."""
    out: dict[str, list[int]] = {}
    for part in text.split(","):
        name, _, numbers = part.partition("=")
        if name in out:
            raise ValueError(f"{name} is given twice")
        out[name] = [int(n) for n in numbers.split("+")]
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestrata")
    p.add_argument("--master", default=None, help="Spark master; spark-submit's if not given")
    commands = p.add_subparsers(dest="command", required=True)

    def add(name: str, *flags: str, **options: tuple[str, dict]) -> None:
        c = commands.add_parser(name)
        for f in flags:
            c.add_argument(f, required=True)
        for _, (flag, how) in options.items():
            c.add_argument(flag, **how)

    many = {"nargs": "+", "required": True}
    add("eval-run", "--config", "--out", ident=("--run-id", {}), golden=("--golden", many), sha=("--expect-golden-sha", {}), resume=("--resume-from", {}), journal=("--journal", {}))
    add("golden-freeze", "--out", golden=("--golden", many), pins=("--pins", {"default": "{}"}))
    add("eval-sizing", "--run", "--level", out=("--out", {}))
    add("golden-validate", files=("files", {"nargs": "+"}))
    add("golden-manifest", "--subsets", "--data-dir", "--out")
    add("golden-build", "--manifest", "--data-dir", "--counts", "--out", seed=("--seed", {"type": int, "default": 1}), low=("--min-tokens", {"type": int, "default": 500}), high=("--max-tokens", {"type": int, "default": 4000}), counter=("--counter", {"default": "whitespace"}), vocabulary=("--vocabulary", {}), pattern=("--pattern", {}))
    fams = ("--families", {})
    add("eval-compare", "--first", "--second", "--out", resamples=("--resamples", {"type": int, "default": 10_000}))
    add("golden-build-synthetic", "--seeds", "--out", families=fams)
    add("golden-manifest-synthetic", "--review-status", "--reviewer", "--out", golden=("--golden", many), notes=("--review-notes", {"default": ""}), families=fams)
    add("corpus-validate-synthetic", files=("files", {"nargs": "+"}), golden=("--golden", {"nargs": "*", "default": []}), families=fams)
    add("corpus-build", "--manifest", "--data-dir", "--out", "--out-manifest", golden=("--check-golden", {"nargs": "*"}), parts=("--parts", {"action": "store_true"}))
    add("corpus-validate", "--manifest", files=("files", {"nargs": "+"}), golden=("--golden", {"nargs": "*", "default": []}))
    add("corpus-build-synthetic", "--targets", "--out", "--out-manifest", golden=("--golden", {"nargs": "*", "default": []}), families=fams)
    add("distill-run", "--chunk-budget", "--out", corpus=("--corpus", many), window=("--window-size", {"type": int, "default": 150}), cap=("--max-chunk-tokens", {"type": int, "default": 512}), vr=("--vr-drop-fraction", {"type": float, "default": 0.05}), ag=("--ag-drop-fraction", {"type": float, "default": 0.10}), journal=("--journal", {}), url=("--gateway-url", {}), teacher=("--teacher-model", {}), interval=("--call-interval", {"type": float, "default": 0.0}), frozen=("--corpus-manifest", {}))
    add("train-windows", "--dataset", "--out", n=("--max-seq-len", {"type": int, "default": 512}))
    add("delivery-verify", "--checkpoint", report=("--report", {}))
    add("delivery-pack", "--checkpoint", "--out", "--draft")
    return p


def run(a: argparse.Namespace) -> object:
    if a.command == "delivery-verify":
        report = delivery.verify(a.checkpoint)
        if a.report:
            sinks.write_json(a.report, report)
        if report["overall"] == delivery.VIOLATION:
            raise ValueError("checkpoint fails: " + ", ".join(c["check"] for c in report["checks"] if c["state"] == delivery.VIOLATION))
        return report
    if a.command == "golden-freeze":
        return runs.freeze(a.golden, json.loads(a.pins), a.out)
    spark = get_session(a.master)
    load = lambda path: json.loads(Path(path).read_text(encoding="utf-8"))
    if a.command == "eval-run":
        return str(runs.evaluate_run(spark, records.read_config(a.config), a.golden, a.out, a.run_id, a.expect_golden_sha, a.resume_from, a.journal))
    if a.command == "eval-compare":
        return runs.compare(spark, a.first, a.second, a.out, a.resamples)
    if a.command == "eval-sizing":
        rows = spark.read.parquet(f"{a.run}/items").filter((F.col("level") == float(a.level)) & F.col("delta").isNotNull())
        if rows.isEmpty():
            raise ValueError(f"the run has no level {a.level}")
        out = [r.asDict() for r in stats.sizing(rows, "load_type").orderBy(F.col("overall").desc(), "load_type").collect()]
        if a.out:
            sinks.write_json(a.out, out)
        return out
    if a.command in ("golden-validate", "corpus-validate", "corpus-validate-synthetic"):
        if a.command == "golden-validate":
            found = records.golden_errors(spark, a.files)
        elif a.command == "corpus-validate":
            found = jobs.corpus_problems(spark, a.files, load(a.manifest), a.golden)
        else:
            found = jobs.synthetic_problems(spark, a.files, a.golden, a.families)
        lines = [f"{r['id']}: {r['error']}" for r in found.orderBy("id", "error").collect()]
        if lines:
            raise ValueError("\n".join(lines))
        return "valid"
    if a.command == "golden-manifest":
        return jobs.split_manifest(spark, a.subsets, a.data_dir, a.out)
    if a.command == "golden-build":
        return jobs.build_exam(spark, load(a.manifest), a.data_dir, pairs(a.counts), a.seed, a.out, counters.build(a.counter, a.vocabulary, a.pattern), a.min_tokens, a.max_tokens)
    if a.command == "golden-build-synthetic":
        return jobs.build_synthetic_exam(spark, lists(a.seeds), a.out, a.families)
    if a.command == "golden-manifest-synthetic":
        return jobs.synthetic_exam_manifest(spark, a.golden, a.out, {"status": a.review_status, "reviewer": a.reviewer, "notes": a.review_notes}, a.families)
    if a.command == "corpus-build":
        where = (spark, load(a.manifest), a.data_dir, a.out, a.out_manifest)
        return jobs.build_corpus(*where, parts=a.parts) if a.check_golden is None else jobs.build_valid_corpus(*where, a.check_golden, parts=a.parts)
    if a.command == "corpus-build-synthetic":
        return jobs.build_synthetic(spark, pairs(a.targets), a.golden, a.out, a.out_manifest, a.families)
    if a.command == "distill-run":
        if bool(a.gateway_url) != bool(a.teacher_model):
            raise ValueError("--gateway-url and --teacher-model go together")
        model = clients.ChatModel(clients.Endpoint(a.gateway_url, interval=a.call_interval), a.teacher_model) if a.gateway_url else None
        frozen = load(a.corpus_manifest) if a.corpus_manifest else None
        return runs.distill_run(spark, a.corpus, pairs(a.chunk_budget), a.out, cap=a.max_chunk_tokens, window=a.window_size, vr=a.vr_drop_fraction, ag=a.ag_drop_fraction, model=model, model_name=a.teacher_model, journal=a.journal, manifest=frozen)
    if a.command == "train-windows":
        return jobs.export_windows(spark, a.dataset, a.out, a.max_seq_len)
    return delivery.pack(spark, a.checkpoint, a.out, a.draft)


def main(argv: list[str] | None = None) -> int:
    try:
        print(json.dumps(run(parser().parse_args(argv)), default=str, ensure_ascii=False))
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
