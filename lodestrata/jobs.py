"""End-to-end jobs: splits and manifests, corpora, exams, training windows (runs.py has what calls models).

Each takes paths, checks before it spends, and writes its manifest last.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as S
from .functions import text as T
from .operators import corpus, splits, synth, windows
from .sources import counters, records, sinks


def subset_rows(spark: SparkSession, registry: DataFrame, data_dir: str) -> DataFrame:
    """Rows of every registered subset: subset, fp, prompt, question, answers, pos."""
    out = None
    for r in registry.collect():  # one row a subset
        rows = records.read_ordered(spark, [f"{data_dir}/{r['file']}"], S.SOURCE)
        bad = rows.filter(F.col(S.CORRUPT).isNotNull() | F.col("input").isNull() | F.col("context").isNull() | F.col("answers").isNull()).orderBy("pos").limit(1).collect()
        if bad:
            raise ValueError(f"{r['file']}: input, context and answers are required ({(bad[0][S.CORRUPT] or str(bad[0]['input']))[:80]})")
        rows = rows.select(F.lit(r["name"]).alias("subset"), T.fingerprint(F.col("context"), F.col("input")).alias("fp"), F.col("context"), F.col("input").alias("question"), "answers", "pos")
        out = rows if out is None else out.unionByName(rows)
    return out


def split_manifest(spark: SparkSession, registry_path: str, data_dir: str, out: str) -> dict:
    """Per subset: file digest, sizes of the halves, boundary fingerprint, license and permission."""
    registry = records.read_registry(spark, registry_path, "subset")
    rows = subset_rows(spark, registry, data_dir)
    bounds = {r["subset"]: r for r in splits.boundary(splits.half_split(rows)).collect()}
    sizes = {r["subset"]: r["count"] for r in rows.groupBy("subset").count().collect()}
    subsets = [
        {"name": r["name"], "file": r["file"], "file_sha256": sinks.sha256_file(f"{data_dir}/{r['file']}"), "entries": sizes[r["name"]], "eval_half": bounds[r["name"]]["eval_half"],
         "train_half": bounds[r["name"]]["train_half"], "train_boundary_fingerprint": bounds[r["name"]]["boundary"], "license": r["license"], "train_use": r["train_use"]}
        for r in registry.collect()
    ]
    manifest = {"schema_version": 1, "split_method": "sha1 half-split", "subsets": subsets}
    sinks.write_json(out, manifest)
    return manifest


def verified_half(spark: SparkSession, manifest: Mapping, data_dir: str, half: str) -> DataFrame:
    """The eval or train rows of a manifest's subsets, the first of each fingerprint; a file that drifted is refused."""
    for s in manifest["subsets"]:
        if sinks.sha256_file(f"{data_dir}/{s['file']}") != s["file_sha256"]:
            raise ValueError(f"{s['file']} differs from the manifest")
    registry = spark.createDataFrame([(s["name"], s["file"]) for s in manifest["subsets"]], "name string, file string")
    rows = subset_rows(spark, registry, data_dir)
    chosen = rows.join(splits.half_split(rows).filter(F.col("half") == half).select("subset", "fp"), ["subset", "fp"])
    return splits.first_of(chosen, ["subset", "fp"], [F.col("pos")])


def build_corpus(spark: SparkSession, manifest: Mapping, data_dir: str, out: str, out_manifest: str, dataset: str = "source", kind: str = "answer", parts: bool = False) -> dict:
    """Training rows of the subsets that may be trained on, in order of subset and fingerprint: one file, or a folder of `parts`."""
    allowed = [s["name"] for s in manifest["subsets"] if s["train_use"]]
    if not allowed:
        raise ValueError("no subset may be trained on")
    rows = verified_half(spark, manifest, data_dir, splits.TRAIN).filter(F.col("subset").isin(allowed))
    rows = rows.withColumn("prompt", T.render_prompt(F.lit(kind), F.col("context"), F.col("question")))
    licenses = F.create_map(*[F.lit(x) for s in manifest["subsets"] for x in (s["name"], s["license"])])
    entries = corpus.build_entries(rows, dataset, "").withColumn("source", F.col("source").withField("license", F.element_at(licenses, F.col("source.subset"))))
    return sinks.write_corpus(entries, out, out_manifest, ["source.subset", "source.content_sha1"], parts=parts, excluded=[s["name"] for s in manifest["subsets"] if not s["train_use"]])


def build_valid_corpus(spark: SparkSession, manifest: Mapping, data_dir: str, out: str, out_manifest: str, golden: Sequence[str], **options) -> dict:
    """Builds a corpus and validates what was written against the manifest and the exams; with problems it is an error."""
    made = build_corpus(spark, manifest, data_dir, out, out_manifest, **options)
    wrong = corpus_problems(spark, [out], manifest, golden).orderBy("id", "error").limit(10).collect()
    if wrong:
        raise ValueError("\n".join(f"{r['id']}: {r['error']}" for r in wrong))
    return made


def build_exam(spark: SparkSession, manifest: Mapping, data_dir: str, counts: Mapping[str, int], seed: int, out: str, counter: counters.Counter | None = None, low: int = 500, high: int = 4000, kind: str = "answer") -> int:
    """Exam rows: a seeded sample of each subset's eval half, within the token band."""
    unknown = set(counts) - {s["name"] for s in manifest["subsets"]}
    if unknown:
        raise ValueError(f"counts name unknown subsets {sorted(unknown)}")
    count = counter or counters.whitespace()
    rows = verified_half(spark, manifest, data_dir, splits.EVAL).withColumn("prompt", T.render_prompt(F.lit(kind), F.col("context"), F.col("question")))
    fit = corpus.in_band(rows.withColumn("n", count(F.col("prompt"))), "n", low, high, "answers")
    # every row that is picked is of the eval half
    picked = reduce(DataFrame.unionByName, [splits.sample_per_subset(fit.filter(F.col("subset") == s), k, seed) for s, k in counts.items()])
    have = {r["subset"]: r["count"] for r in picked.groupBy("subset").count().collect()}
    short = [s for s, k in counts.items() if have.get(s, 0) < k]
    if short:
        raise ValueError(f"too few candidates in {short}")
    if not splits.outside(picked, rows).isEmpty():
        raise ValueError("the sample has rows that are not of the eval half")
    source = F.struct(F.lit("source").alias("dataset"), "subset", F.lit("eval").alias("split"), F.col("fp").alias("content_sha1"), F.filter("answers", lambda a: F.trim(a) != "").alias("answers"))
    exam = picked.select(F.concat_ws("-", F.lit("rag"), "subset", F.substring("fp", 1, 8)).alias("id"), F.lit("rag").alias("load_type"), "prompt", T.key_points(F.col("answers")).alias("key_points"), source.alias("source"))
    return sinks.write_lines(exam, out, ["source.subset", "source.content_sha1"])


def corpus_problems(spark: SparkSession, paths: Sequence[str], manifest: Mapping, golden: Sequence[str]) -> DataFrame:
    """(id, error): row, registry, repetition and leakage errors of corpus files."""
    registry = spark.createDataFrame([(s["name"], s["license"], s["train_use"], s["train_boundary_fingerprint"]) for s in manifest["subsets"]], "subset string, license string, train_use boolean, boundary string")
    rows = records.read_corpus(spark, list(paths))
    flat = rows.select("id", "load_type", "prompt", "question", "source.dataset", "source.subset", "source.license", "source.split", F.col("source.content_sha1").alias("fp"), S.CORRUPT)
    checked = corpus.registry_outcome(flat, registry)
    wrong = checked.select("id", F.explode(corpus.row_errors()).alias("error"))
    again = rows.groupBy("id").count().filter("count > 1").select("id", F.lit("id is repeated").alias("error"))
    same = flat.filter("fp IS NOT NULL").groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).filter("n > 1").select("id", F.lit("content is repeated").alias("error"))
    out = wrong.unionByName(again).unionByName(same)
    if golden:
        exam = records.read_numbered(spark, golden, S.GOLDEN).select(F.col("source.content_sha1").alias("fp"), F.col("id").alias("golden_id"))
        out = out.unionByName(splits.overlap(flat, exam).select("id", F.concat(F.lit("content is exam item "), "golden_id").alias("error")))
    return out


def build_synthetic(spark: SparkSession, targets: Mapping[str, int], golden: Sequence[str], out: str, out_manifest: str, families: str | None = None) -> dict:
    """Synthetic training rows by the seed plan, in order of class, family and seed. The manifest counts rows by family and gives the mix."""
    fams = records.read_families(spark, families)
    exam = synth.render(synth.candidates(fams, "eval_lo", "eval_hi")).select("fp")
    if golden:
        exam = exam.unionByName(records.read_numbered(spark, golden, S.GOLDEN).select(F.sha1("prompt").alias("fp")))
    unknown = set(targets) - {r[0] for r in fams.select("load_type").distinct().collect()}
    if unknown:
        raise ValueError(f"targets name unknown classes {sorted(unknown)}")
    plan = synth.seed_plan(synth.render(synth.candidates(fams, "train_lo", "train_hi")), dict(targets), exam)
    have = {r["load_type"]: r["count"] for r in plan.groupBy("load_type").count().collect()}
    short = [c for c, n in targets.items() if have.get(c, 0) < n]
    if short:
        raise ValueError(f"targets cannot be reached for {short}")
    source = F.struct(F.lit("synthetic").alias("dataset"), F.col("family").alias("subset"), "license", F.lit("train").alias("split"), F.col("fp").alias("content_sha1"), "family", "seed")
    entries = plan.select(F.concat_ws("-", F.lit("train"), "family", "seed").alias("id"), "load_type", "prompt", F.lit("").alias("question"), F.lit("").alias("task"), source.alias("source"), "family_ord")
    by_family = {r["family"]: r["count"] for r in plan.groupBy("family").count().collect()}
    mix = {r["load_type"]: round(r["pct"], 4) for r in corpus.mix_percent(plan.select("load_type")).collect()}
    return sinks.write_corpus(entries.drop("family_ord"), out, out_manifest, ["load_type", "source.family", "source.seed"], targets=dict(targets), families=by_family, mix_percent=mix)


def build_synthetic_exam(spark: SparkSession, seeds: Mapping[str, Sequence[int]], out: str, families: str | None = None) -> int:
    """Exam rows of {family: seeds}, in order of family and seed."""
    rows = synth.exam_rows(records.read_families(spark, families), seeds)
    source = F.struct(F.lit("synthetic").alias("dataset"), F.col("family").alias("subset"), "license", F.lit("eval").alias("split"), F.col("fp").alias("content_sha1"), "family", "seed")
    exam = rows.select(F.concat_ws("-", F.lit("eval"), "family", "seed").alias("id"), "load_type", "prompt", "key_points", source.alias("source"))
    return sinks.write_lines(exam, out, ["source.family", "source.seed"])


def synthetic_exam_manifest(spark: SparkSession, golden: Sequence[str], out: str, review: Mapping[str, str], families: str | None = None) -> dict:
    """Families with their seed ranges and the exam's seeds of each, once every row is the one that its family and seed give."""
    fams = records.read_families(spark, families)
    exam = records.read_golden(spark, golden).select("id", "load_type", "prompt", F.col("source.family").alias("family"), F.col("source.seed").alias("seed"))
    wrong = _synthetic_errors(exam, fams, "eval").orderBy("id", "error").first()
    if wrong:
        raise ValueError(f"{wrong['id']}: {wrong['error']}")
    used = {r["family"]: sorted(r["seeds"]) for r in exam.groupBy("family").agg(F.collect_list("seed").alias("seeds")).collect()}
    entries = [
        {"family": r["family"], "load_type": r["load_type"], "eval_range": [r["eval_lo"], r["eval_hi"]], "train_range": [r["train_lo"], r["train_hi"]], "seeds": used.get(r["family"], [])}
        for r in fams.orderBy("family_ord").collect()
    ]
    manifest = {"schema_version": 1, "files": [{"file": Path(p).name, "sha256": sinks.sha256_file(p)} for p in golden], "families": entries, "review": dict(review)}
    sinks.write_json(out, manifest)
    return manifest


def _synthetic_errors(rows: DataFrame, fams: DataFrame, side: str) -> DataFrame:
    """(id, error) of rows (id, load_type, prompt, family, seed) with a seed of another range or a prompt that is not their seed's."""
    seeds = synth.seed_errors(rows, fams, side).select("id", "error")
    prompts = synth.regeneration_errors(rows, fams).select("id", F.lit("prompt is not what family and seed give").alias("error"))
    return seeds.unionByName(prompts)


def synthetic_problems(spark: SparkSession, paths: Sequence[str], golden: Sequence[str], families: str | None = None) -> DataFrame:
    """(id, error) of synthetic corpus files: all that corpus_problems finds, with families as subsets, and seeds and prompts."""
    fams = records.read_families(spark, families)
    known = [{"name": r["family"], "license": r["license"], "train_use": r["train_use"], "train_boundary_fingerprint": ""} for r in fams.collect()]  # a row a family
    rows = records.read_corpus(spark, list(paths)).select("id", "load_type", "prompt", "source.family", "source.seed", F.col("source.content_sha1").alias("fp"))
    digests = rows.filter(~F.col("fp").eqNullSafe(F.sha1("prompt"))).select("id", F.lit("content_sha1 is not the prompt's").alias("error"))
    return corpus_problems(spark, paths, {"subsets": known}, golden).unionByName(_synthetic_errors(rows.drop("fp"), fams, "train")).unionByName(digests)


def export_windows(spark: SparkSession, labeled: str, out: str, max_seq_len: int = 512) -> int:
    """Training windows of a labelled dataset as Parquet (training itself is left to a trainer)."""
    rows = spark.read.parquet(labeled)
    wrong = records.labeled_errors(rows.withColumn("prompt", F.col("text"))).orderBy("id", "error").first()
    if wrong:
        raise ValueError(f"{wrong['id']}: {wrong['error']}")
    rows = rows.select("id", "text", "tokens")
    packed = windows.windows(windows.align_labels(rows, "text", "tokens", kept=["id"]), "subwords", max_seq_len)
    sinks.write_dataset(packed, out)
    return spark.read.parquet(out).count()
