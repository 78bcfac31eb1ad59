"""Runs that may pay for calls: evaluation of a compressor, distillation from a teacher.

Calls are journalled before they are used. A run first joins what it needs to what its
journal has, by item, level and digest of the payload, asks only for what is missing, in
waves that are each appended when they end, and then reads all answers from the journal.
A second run with the same pins therefore makes no call. Pins (exam, models, rubric,
task framing, ...) name the journal's folder, so that other settings never share one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from hashlib import sha256
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as S
from .checkpoint import cut
from .functions import text as T
from .operators import corpus, distill, evaluate, ledger, splits, stats, teacher
from .sources import clients, counters, records, sinks

#: Calls that a wave makes at most, about: what a killed run may have to ask again.
WAVE = 2000


@dataclass(frozen=True)
class Models:
    """Who compresses, answers and grades. None: the word-dropping compressor, the text itself as answer, the mechanical judge."""

    compress: Callable[[str, float], object] | None = None
    answer: teacher.Model | None = None
    judge: teacher.Model | None = None
    compressor_name: str = "words"
    answer_name: str = "echo"
    judge_name: str = "mechanical"

    @staticmethod
    def of(config: records.RunConfig) -> Models:
        """The HTTP models that a configuration names."""
        compress = clients.Compressor(clients.Endpoint(config.compressor_url)) if config.compressor_url else None
        if not config.gateway_url:
            return Models(compress, compressor_name=config.compressor_url or "words")
        at = clients.Endpoint(config.gateway_url, retries=config.retries, interval=config.call_interval)
        answer, judge = (clients.ChatModel(at, m, config.key_variable) for m in (config.answer_model, config.judge_model))
        return Models(compress, answer, judge, config.compressor_url or "words", config.answer_model, config.judge_model)


def digest_of(value: object) -> str:
    return sha256(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def run_id(name: str, pins: Mapping[str, object], now: datetime | None = None) -> str:
    """<UTC time>-<name>-<first 8 digits of the pins' digest>"""
    return f"{(now or datetime.now(timezone.utc)).strftime('%Y%m%dT%H%M%SZ')}-{name}-{digest_of(dict(pins))[:8]}"


def check_pins(found: Mapping[str, object], pins: Mapping[str, object], what: str) -> None:
    """Refuses answers that were given under other pins."""
    wrong = sorted(k for k in pins if found.get(k) != pins[k])
    if wrong:
        raise ValueError(f"cannot resume from {what}: {', '.join(wrong)} changed")


def journal_folder(root: str, pins: Mapping[str, object]) -> str:
    """The folder of these pins' journal, with the pins beside it."""
    folder = f"{root}/{digest_of(dict(pins))[:16]}"
    if not Path(f"{folder}/pins.json").exists():
        sinks.write_json(f"{folder}/pins.json", dict(pins))
    return folder


def recorded(spark: SparkSession, source: str | None, pins: Mapping[str, object]) -> DataFrame | None:
    """Journal rows of a run folder, a journal folder or a journal file. Folders must have the same pins; a file has none."""
    if source is None:
        return None
    path = Path(source)
    if (path / "metrics.json").exists():
        check_pins(json.loads((path / "metrics.json").read_text(encoding="utf-8"))["pins"], pins, source)
        return records.run_ledger(spark, source)
    if (path / "pins.json").exists():
        check_pins(json.loads((path / "pins.json").read_text(encoding="utf-8")), pins, source)
        return records.read_journal_folder(spark, f"{source}/calls") if (path / "calls").exists() else None
    return records.read_journal(spark, source)


def answered(spark: SparkSession, wanted: DataFrame, ask: Callable[[DataFrame], DataFrame], root: str, known: DataFrame | None, wave: int = WAVE) -> DataFrame:
    """`wanted` (kind, item, level, payload, ...) with answer, scores, served and source. `ask` answers rows; what it gives is journalled in `root`."""
    calls = f"{root}/calls"
    own = records.read_journal_folder(spark, calls) if Path(calls).exists() else None
    have = known if own is None else own if known is None else own.unionByName(known, allowMissingColumns=True)
    missing = cut(wanted if have is None else ledger.misses(wanted, have))
    waves = -(-missing.count() // wave)
    for k in range(waves):
        part = missing.filter(F.pmod(F.xxhash64("kind", "item", "level"), F.lit(waves)) == k)
        sinks.append_journal(ask(part).select(*S.JOURNAL_COLUMNS), calls)
    after = records.read_journal_folder(spark, calls) if Path(calls).exists() else have
    if after is None:
        return wanted.withColumns({"answer": F.lit(None).cast("string"), "scores": F.lit(None).cast("array<int>"), "served": F.lit(None).cast("string"), "source": F.lit("fresh")})
    if known is not None:
        after = after.unionByName(known, allowMissingColumns=True)
    fresh = missing.select("kind", "item", "level", F.lit("fresh").alias("source"))
    return ledger.found(wanted, after).join(fresh.toDF("_k", "_i", "_l", "source"), F.expr("kind = _k AND item = _i AND level <=> _l"), "left").drop("_k", "_i", "_l").withColumn("source", F.coalesce("source", F.lit("reused")))


def compressed(items: DataFrame, models: Models) -> DataFrame:
    """Adds `compressed` to rows with prompt, level and drop."""
    if models.compress is None:
        return items.withColumn("compressed", T.stub_compress(F.col("prompt"), F.col("drop")))

    @F.pandas_udf("string")
    def run(texts: pd.Series, levels: pd.Series) -> pd.Series:
        return pd.Series([clients.content(models.compress(t, v)) for t, v in zip(texts, levels)])

    return items.withColumn("compressed", run("prompt", "level"))


def evaluate_run(
    spark: SparkSession, config: records.RunConfig, golden: Sequence[str], out: str, name: str | None = None, expect_sha256: str | None = None,
    resume_from: str | None = None, journal: str | None = None, models: Models | None = None,
) -> Path:
    """Compress the exam at each level, answer and grade both sides, measure, and write a run folder: items (Parquet), metrics.json, report.md."""
    models = models or Models.of(config)
    digest = sha256(b"".join(Path(p).read_bytes() for p in golden)).hexdigest()
    if expect_sha256 and expect_sha256.lower().removeprefix("sha256:") != digest:
        raise ValueError("the exam's digest is not the expected one")
    pins = {"golden": digest, "answer_model": models.answer_name, "judge_model": models.judge_name, "rubric": digest_of(T.JUDGE_RULE), "tasks": digest_of(T.TASKS)}
    name = name or run_id(config.name, pins)
    if (Path(out) / name).exists():
        raise FileExistsError(f"{out}/{name} exists")
    count = counters.build(config.counter, config.vocabulary)
    exam = cut(records.read_golden(spark, golden).select("id", "load_type", "prompt", "key_points"))
    items = cut(compressed(evaluate.sweep(exam, config.levels), models))  # compressed once, whoever reads it
    side = lambda df, kind, level, payload: df.select(F.lit(kind).alias("kind"), F.col("id").alias("item"), level.cast("double").alias("level"), F.col(payload).alias("payload"), "load_type", "key_points")
    wanted = side(exam, "original", F.lit(None), "prompt").unionByName(side(items, "answer", F.col("level"), "compressed"))

    def ask(rows: DataFrame) -> DataFrame:
        framed = rows.withColumn("prompt", T.task_prompt(F.col("load_type"), F.col("payload")))
        if models.answer is None:
            framed = framed.withColumn("answer", F.col("payload")).withColumn("served", F.lit(models.answer_name))
            return framed.withColumn("scores", T.parse_judge(T.judge_reply(F.col("key_points"), F.col("answer")), F.size("key_points")))
        done = teacher.answer_and_judge(framed, models.answer, models.judge, name=models.answer_name)
        return done.withColumn("scores", F.when(F.col("failure").isNull(), F.col("scores")))

    root = journal_folder(journal or f"{out}/journal", pins)
    calls = cut(answered(spark, wanted, ask, root, recorded(spark, resume_from, pins)))
    originals = calls.filter("kind = 'original'").select(F.col("item").alias("id"), F.col("answer").alias("original_answer"), F.col("scores").alias("original_scores"), F.col("source").alias("original_source"))
    replies = calls.filter("kind = 'answer'").select(F.col("item").alias("id"), "level", "answer", "scores", "served", "source")
    measured = evaluate.item_metrics(items.drop("key_points"), text="prompt", given="compressed")
    measured = measured.withColumns({"native_original": count(F.col("prompt")), "native_compressed": count(F.col("compressed"))})
    scored = evaluate.document_f05(measured, "prompt", "compressed").join(originals, "id").join(replies, ["id", "level"])
    scored = scored.withColumns({"original": T.mean_score(F.col("original_scores")), "score": T.mean_score(F.col("scores"))})
    failed = F.col("scores").isNull() | F.col("original_scores").isNull()
    scored = scored.withColumn("delta", F.when(~failed, F.round(F.col("score") - F.col("original"), 4))).drop("prompt", "drop")
    folder = sinks.new_folder(out, name)
    sinks.write_dataset(scored, str(folder / "items"))
    rows = spark.read.parquet(str(folder / "items"))
    levels = evaluate.aggregate(rows.drop("compressed", "answer"), "level").join(stats.bootstrap(rows.filter("delta IS NOT NULL"), "level", resamples=config.resamples, seed=config.seed).drop("n_items"), "level", "left")
    levels = levels.join(ledger.accounting(rows, "level"), "level")
    served = sorted(r["served"] for r in rows.select("served").filter("served IS NOT NULL").distinct().collect())
    counts = {r["source"]: r["count"] for r in calls.groupBy("source").count().collect()}
    metrics = {
        "schema_version": 4, "run_id": name, "golden": {"sha256": digest, "item_count": exam.count()}, "pins": pins, "config": vars(config), "compressor": models.compressor_name,
        "served_models": served, "served_as_pinned": served in ([], [models.answer_name]), "calls": {"fresh": counts.get("fresh", 0), "reused": counts.get("reused", 0)},
        "failures": rows.filter("delta IS NULL").count(), "levels": [r.asDict() for r in levels.orderBy("level").collect()],
    }
    sinks.write_report(folder, metrics, sinks.run_report(metrics, levels))
    return folder


def _sound_corpus(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Corpus rows in order, once no id is repeated and every row has a known load type and a prompt."""
    rows = cut(records.read_ordered(spark, paths, S.CORPUS))
    wrong = T.error_list(
        (F.col(S.CORRUPT).isNotNull(), "line is not valid JSON"), (F.col("id").isNull(), "id is missing"), (~F.coalesce(F.col("load_type").isin(*T.TASKS), F.lit(False)), "load_type is not known"),
        (F.trim(F.coalesce("prompt", F.lit(""))) == "", "prompt is empty"),
    )
    again = rows.filter("id IS NOT NULL").groupBy("id").count().filter("count > 1").select("id", F.lit("id is repeated").alias("error"))
    first = rows.select("id", F.explode(wrong).alias("error")).unionByName(again).orderBy("id", "error").first()
    if first:
        raise ValueError(f"{first['id']}: {first['error']}")
    return rows.drop(S.CORRUPT)


def distill_run(
    spark: SparkSession, paths: Sequence[str], budgets: Mapping[str, int], out: str, drop: int = 3, cap: int = distill.CAP, window: int = distill.WINDOW, vr: float = 0.05, ag: float = 0.10,
    count=distill.ws_count, model: teacher.Model | None = None, model_name: str | None = None, journal: str | None = None, manifest: Mapping | None = None,
) -> dict:
    """Chunk, select within budgets, compress, label, control, write: labeled and dropped (Parquet), report.json, report.md, then manifest.json.

    Without a model a stand-in drops `drop` words of ten. `manifest`: of the frozen corpus, whose digests the files must have.
    """
    digests = {Path(p).name: sinks.sha256_file(p) for p in paths}
    if manifest is not None and manifest["corpus"]["sha256"] not in digests.values():
        raise ValueError("the corpus is not the frozen one")
    name = model_name or (f"drop-{drop}" if model is None else "model")
    identity = {"corpus": sorted(digests.values()), "cap": cap, "window": window, "vr": vr, "ag": ag, "teacher": name, "drop": drop, "budgets": dict(budgets)}
    sinks.check_identity(f"{out}/manifest.json", identity)
    rows = _sound_corpus(spark, paths)
    present = {r[0] for r in rows.select("load_type").distinct().collect()}
    if set(budgets) - present:
        raise ValueError(f"budgets name unknown classes {sorted(set(budgets) - present)}")
    chunks = cut(distill.chunks(rows, "id", "prompt", cap, count))
    needs = rows.select("id", "load_type", "pos").join(chunks.groupBy("id").agg(F.count(F.lit(1)).alias("need")), "id", "left").withColumn("need", F.coalesce("need", F.lit(0)))
    chosen = distill.budget_select(needs, dict(budgets))
    entry = rows.select("id", "question", "task", F.col("source").alias("origin"), F.char_length("prompt").alias("entry_chars"))
    jobs = chunks.join(chosen, "id").join(entry, "id").withColumnRenamed("id", "entry_id").withColumn("id", F.concat("entry_id", F.lit("#c"), "index"))
    wanted = jobs.select(F.lit("chunk").alias("kind"), F.col("id").alias("item"), F.lit(None).cast("double").alias("level"), F.col("text").alias("payload"))

    def ask(part: DataFrame) -> DataFrame:
        if model is None:
            return part.withColumns({"answer": T.stub_compress(F.col("payload"), drop), "scores": F.array().cast("array<int>"), "served": F.lit(name)})
        return teacher.answers(part, model, "payload", name).withColumn("scores", F.array().cast("array<int>"))

    root = journal_folder(journal or f"{out}/journal", identity)
    replies = cut(answered(spark, wanted, ask, root, None))
    whole = jobs.join(replies.select(F.col("item").alias("id"), F.col("answer").alias("compressed_text"), F.col("served").alias("teacher_model_served"), F.col("source").alias("call")), "id")
    labelled = cut(distill.label_chunks(whole, "text", "compressed_text", window))
    counted = labelled.withColumn("n_origin", F.size("tokens")).withColumn("n_kept", F.size(F.filter("tokens", lambda t: t["keep"] == 1)))
    measured = distill.label_metrics(counted, "n_origin", "n_comp", "n_kept", "num_find").filter("n_origin > 0")
    controlled = cut(distill.quality_control(measured, vr, ag))
    chunk = F.struct("index", "start", "end", "entry_chars").alias("chunk")
    rates = F.struct("word_compressed_rate", "find_rate", "variation_rate", "hitting_rate", "matching_rate", "alignment_gap").alias("metrics")
    final = controlled.select("id", "entry_id", "load_type", "text", "question", "task", chunk, "compressed_text", "teacher_model_served", "tokens", rates, F.col("origin").alias("source"), "dropped_by")
    final.filter("dropped_by IS NULL").drop("dropped_by").write.mode("overwrite").partitionBy("load_type").parquet(f"{out}/labeled")
    # sorted by ranges: part files in order, none of them everything
    final.filter("dropped_by IS NOT NULL").select("id", "load_type", "dropped_by", "metrics").orderBy("id").write.mode("overwrite").parquet(f"{out}/dropped")
    metrics = ["variation_rate", "alignment_gap", "matching_rate"]
    shares = stats.distributions(controlled.withColumn("kept", F.col("dropped_by").isNull()), metrics, "kept")
    # sums of floats depend on the order of tasks in their last digits; a rerun's manifest should be the same
    summary = [r.asDict() for r in shares.withColumn("mean", F.round("mean", 9)).orderBy("kept", "metric").collect()]
    table = controlled.groupBy("load_type").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("dropped_by").isNull()).alias("kept"), F.count_distinct("entry_id").alias("entries"))
    edges = controlled.select("thresholds.*").first()
    calls = {r["call"]: r["count"] for r in labelled.groupBy("call").count().collect()}
    report = {
        "schema_version": 1, "teacher": name, "served_models": sorted(r[0] for r in labelled.select("teacher_model_served").distinct().collect() if r[0]), "distributions": summary,
        "thresholds": edges.asDict() if edges else {}, "calls": calls, "counts": [r.asDict() for r in table.orderBy("load_type").collect()], "quarantined": counted.filter("n_origin = 0").count(),
    }
    sinks.write_report(out, report, sinks.distill_report(report, table), name="report.json")
    files = [{"file": f, "sha256": h, "rows": n} for f, h, n in _per_file(rows, digests)]
    made = {"identity": identity, "files": files, **{k: report[k] for k in ("counts", "distributions", "quarantined", "thresholds")}}
    sinks.write_json(f"{out}/manifest.json", made)
    return made


def _per_file(rows: DataFrame, digests: Mapping[str, str]) -> list[tuple[str, str, int]]:
    counts = {r["file"].rsplit("/", 1)[-1]: r["count"] for r in rows.groupBy("file").count().collect()}  # a row a file
    return [(f, h, counts.get(f, 0)) for f, h in sorted(digests.items())]


def compare(spark: SparkSession, first: str, second: str, out: str, resamples: int = 10_000, seed: int = 0) -> dict:
    """The second run's deltas less the first's, item by item at the levels that both have, with their intervals. Both must be of one exam."""
    runs = [json.loads((Path(r) / "metrics.json").read_text(encoding="utf-8")) for r in (first, second)]
    if runs[0]["golden"]["sha256"] != runs[1]["golden"]["sha256"]:
        raise ValueError("the runs are of different exams")
    sides = [spark.read.parquet(f"{r}/items").filter("delta IS NOT NULL") for r in (first, second)]
    pairs = cut(evaluate.paired(sides[0], sides[1], ["level", "id"], "delta").withColumnRenamed("difference", "delta"))
    levels = stats.bootstrap(pairs, "level", resamples=resamples, seed=seed)
    found = {"schema_version": 1, "golden": runs[0]["golden"], "runs": [r["run_id"] for r in runs], "levels": [r.asDict() for r in levels.orderBy("level").collect()]}
    report = f"# {found['runs'][1]} against {found['runs'][0]}\n\n{sinks.markdown_table(levels, ['level'])}"
    sinks.write_report(out, found, report, name="comparison.json")
    return found


def freeze(paths: Sequence[str], pins: Mapping[str, object], out: str) -> dict:
    """The record of a frozen exam: its files in order, their digests, that of all bytes together, and what it was made with."""
    whole = sha256()
    for p in paths:
        whole.update(Path(p).read_bytes())
    record = {"schema_version": 1, "files": [{"file": Path(p).name, "sha256": sinks.sha256_file(p)} for p in paths], "sha256": whole.hexdigest(), "pins": dict(pins)}
    sinks.write_json(out, record)
    return record
