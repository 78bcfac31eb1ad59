"""Readers of record files: explicit schemas, corrupt lines kept as such, digests by content.

Lines end at "\\n" only. `pos` orders rows by file (in the order given) and line;
it is there for files that one reads whole (exam sets, journals). `read_records`
has no line numbers and splits files of any size.
"""

from __future__ import annotations

import tomllib
from collections.abc import Sequence
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as T
from ..operators import corpus, ledger, splits, synth


def read_records(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    """JSON lines by schema, with the file and (for lines that do not parse) the line itself."""
    rows = spark.read.schema(f"{schema}, {S.CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", S.CORRUPT).json(paths)
    return rows.withColumn("file", F.col("_metadata.file_path"))


def read_ordered(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """The same with `pos`, which sorts by file (in the order given) and place in the file. Files of any size are split: a row's place is its split's and its number in the split."""
    rows = spark.read.schema(f"{schema}, {S.CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", S.CORRUPT).option("lineSep", "\n")
    out = None
    for k, p in enumerate(paths):
        place = F.struct(F.lit(k).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        part = rows.json(p).select("*", F.col("_metadata.file_path").alias("file"), place.alias("pos"))
        out = part if out is None else out.unionByName(part)
    return out


def read_numbered(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """The same for exam sets and other small files whose errors are told by line: with file ordinal, line number (from 1) and pos; blank lines are skipped."""
    out = None
    for k, p in enumerate(paths):
        lines = spark.read.text(p, wholetext=True).select(F.lit(k).alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
        out = lines if out is None else out.unionByName(lines)
    out = out.filter(F.trim("value") != "").withColumn("line", F.col("line") + 1)
    parsed = F.from_json("value", f"{schema}, {S.CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": S.CORRUPT})
    return out.select("file", "line", (F.col("file").cast("long") * (1 << 40) + F.col("line")).alias("pos"), parsed.alias("r")).select("file", "line", "pos", "r.*")


def golden_errors(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, line, id, error): everything that is wrong with exam files, syntax errors and repeated ids included."""
    rows = read_numbered(spark, paths, S.GOLDEN).withColumn("split", F.col("source.split"))
    broken = rows.filter(F.col(S.CORRUPT).isNotNull()).select("file", "line", "id", F.lit("line is not valid JSON").alias("error"))
    sound = rows.filter(F.col(S.CORRUPT).isNull())
    wrong = sound.select("file", "line", "id", F.explode(corpus.golden_errors()).alias("error"))
    again = corpus.duplicates(sound.filter("id IS NOT NULL"), "id", "pos").select("file", "line", "id", F.lit("id is repeated").alias("error"))
    return broken.unionByName(wrong).unionByName(again)


def read_golden(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Exam rows in the order of files and lines; raises on the first error, with the number of others. An empty set is an error."""
    found = golden_errors(spark, paths).orderBy("file", "line", "error")
    head = found.limit(1).collect()
    if head:
        r = head[0]
        raise ValueError(f"{paths[r['file']]}: line {r['line']} (id={r['id']}): {r['error']} (+{found.count() - 1} more errors)")
    rows = read_numbered(spark, paths, S.GOLDEN).drop(S.CORRUPT)
    if rows.isEmpty():
        raise ValueError("no exam rows")
    return rows


def read_corpus(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return read_records(spark, paths, S.CORPUS)


def labeled_errors(rows: DataFrame) -> DataFrame:
    """Labelled rows whose spans are out of order or out of bounds, or whose labels are not 0 or 1."""
    t = F.col("tokens")
    pairs = F.arrays_zip(F.slice(t, 1, F.greatest(F.lit(0), F.size(t) - 1)).alias("a"), F.slice(t, 2, F.greatest(F.lit(0), F.size(t) - 1)).alias("b"))
    bounds = F.forall(t, lambda x: (x["start"] >= 0) & (x["end"] > x["start"]) & (x["end"] <= F.char_length("prompt")))
    errors = T.error_list(
        (t.isNull(), "tokens are missing"),
        (~F.forall(pairs, lambda p: p["a"]["end"] <= p["b"]["start"]), "spans are out of order"),
        (~bounds, "span is out of bounds"),
        (~F.forall(t, lambda x: x["keep"].isin(0, 1)), "keep is not 0 or 1"),
    )
    return rows.select("id", F.explode(errors).alias("error"))


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """The last record of each (kind, item, level); a torn last line is dropped."""
    rows = read_numbered(spark, [path], S.JOURNAL).filter(F.col(S.CORRUPT).isNull()).drop(S.CORRUPT)
    return splits.last_of(rows, ["kind", "item", "level"], "pos")


def read_journal_folder(spark: SparkSession, path: str) -> DataFrame:
    """Distinct journal records of a folder that tasks append to; lines that do not parse are dropped. A call that a retried task made twice counts once."""
    rows = spark.read.schema(S.JOURNAL).option("mode", "DROPMALFORMED").json(path).filter("item IS NOT NULL")
    return rows.groupBy("kind", "item", "level", F.sha2("payload", 256).alias("_h")).agg(F.min(F.struct("payload", "answer", "scores", "served")).alias("r")).select("kind", "item", "level", "r.*")


def run_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """An earlier run's items as journal records. Items whose levels disagree on the original side are an error."""
    rows = spark.read.parquet(f"{folder}/items")
    torn = ledger.conflicts(rows, "id", "original_answer", "original_scores").orderBy("id").first()
    if torn:
        raise ValueError(f"{folder}: {torn['id']} has {torn['versions']} different originals")
    null = lambda kind: F.lit(None).cast(kind)
    first = rows.groupBy("id").agg(F.min(F.struct("original_answer", "original_scores")).alias("r"))
    originals = first.select(F.lit("original").alias("kind"), F.col("id").alias("item"), null("double").alias("level"), null("string").alias("payload"), F.col("r.original_answer").alias("answer"), F.col("r.original_scores").alias("scores"), null("string").alias("served"))
    answers = rows.select(F.lit("answer").alias("kind"), F.col("id").alias("item"), "level", F.col("compressed").alias("payload"), "answer", "scores", "served")
    return originals.unionByName(answers)


def file_digests(spark: SparkSession, directory: str) -> DataFrame:
    """(path, size, sha256) of all files below a directory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    relative = F.regexp_replace("path", "^[a-z]+:/*", "/")
    return files.select(relative.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def directory_digest(digests: DataFrame) -> DataFrame:
    """One row: the SHA-256 of the sorted lines `<sha>  <path>`."""
    lines = F.array_sort(F.collect_list(F.struct("path", F.concat("sha256", F.lit("  "), "path", F.lit("\n")).alias("line"))))
    return digests.agg(F.sha2(F.array_join(F.transform(lines, lambda x: x["line"]), ""), 256).alias("digest"))


def read_registry(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A TOML registry (array of tables `key`) as a small DataFrame; names must be unique."""
    entries = tomllib.loads(Path(path).read_text(encoding="utf-8")).get(key, [])
    names = [e.get("name") for e in entries]
    if not entries or None in names or len(set(names)) < len(names):
        raise ValueError(f"{path}: {key} entries need unique names")
    columns = sorted({c for e in entries for c in e})
    return spark.createDataFrame([tuple(e.get(c) for c in columns) for e in entries], columns)


def read_families(spark: SparkSession, path: str | None) -> DataFrame:
    """The scenario families of a TOML registry ([[family]] tables); the built-in ones without a path."""
    if path is None:
        return synth.families(spark)
    return synth.registered(spark, tomllib.loads(Path(path).read_text(encoding="utf-8")).get("family", []), path)


@dataclass(frozen=True)
class RunConfig:
    """Settings of an evaluation; unknown keys are refused."""

    name: str = "run"
    levels: tuple[float, ...] = (0.2,)
    counter: str = "whitespace"
    vocabulary: str | None = None
    seed: int = 0
    resamples: int = 10_000
    compressor_url: str | None = None
    gateway_url: str | None = None
    answer_model: str | None = None
    judge_model: str | None = None
    key_variable: str = "GATEWAY_SERVICE_KEY"
    call_interval: float = 0.0
    retries: int = 1

    def __post_init__(self) -> None:
        if not self.levels or any(isinstance(v, bool) or not 0 <= v <= 1 for v in self.levels) or len(set(self.levels)) < len(self.levels):
            raise ValueError("levels must be distinct numbers in [0, 1]")
        if isinstance(self.resamples, bool) or self.resamples < 1 or isinstance(self.seed, bool) or self.seed < 0:
            raise ValueError("resamples must be at least 1 and seed at least 0")
        if self.gateway_url and not (self.answer_model and self.judge_model):
            raise ValueError("a gateway needs an answer_model and a judge_model")
        if self.call_interval < 0 or isinstance(self.retries, bool) or self.retries < 0:
            raise ValueError("call_interval and retries must be at least 0")


#: Tables of a configuration file and the settings that their keys are.
TABLES = {
    "compressor": {"url": "compressor_url"},
    "gateway": {"url": "gateway_url", "answer_model": "answer_model", "judge_model": "judge_model", "key_variable": "key_variable", "call_interval": "call_interval", "retries": "retries"},
}


def read_config(path: str) -> RunConfig:
    """Settings, some of them in tables [compressor] and [gateway]. Keys themselves are never in a file: key_variable names the environment's."""
    given = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    for table, names in TABLES.items():
        inner = given.pop(table, {})
        unknown = set(inner) - set(names)
        if unknown:
            raise ValueError(f"{path}: unknown keys {sorted(f'{table}.{k}' for k in unknown)}")
        given |= {names[k]: v for k, v in inner.items()}
    unknown = set(given) - {f.name for f in fields(RunConfig)}
    if unknown:
        raise ValueError(f"{path}: unknown keys {sorted(unknown)}")
    return RunConfig(**{k: tuple(v) if k == "levels" else v for k, v in given.items()})
