"""Writers: record files with manifests, immutable run folders, journals, checksums, reports.

Manifests are written last and mark a finished output.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sha256_file(path: str | Path) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def write_json(path: str | Path, value: object) -> None:
    """Sorted keys, no timestamps; written aside and renamed, so that a reader never sees half of it."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    part.write_text(json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2) + "\n", encoding="utf-8")
    os.replace(part, path)


def write_lines(df: DataFrame, path: str, order: list[str]) -> int:
    """One JSON lines file in a given order: for exam sets and corpora that are frozen by their bytes. Rows stream to the driver a partition at a time."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    rows = df.orderBy(*order).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("v"))
    n = 0
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        for r in rows.toLocalIterator(prefetchPartitions=True):
            f.write(r["v"] + "\n")
            n += 1
    os.replace(f"{path}.part", path)
    return n


def write_dataset(df: DataFrame, path: str, *partition_by: str) -> None:
    """Parquet of any size; an existing output is an error."""
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def write_parts(df: DataFrame, folder: str, order: list[str]) -> str:
    """JSON lines in part files by ranges of the order, of any size, none of which passes the driver; the digest of the sorted part digests."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(folder)
    parts = df.sparkSession.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).filter("length > 0")
    digests = parts.select(F.regexp_extract("path", r"(part-\d+)", 1).alias("part"), F.sha2("content", 256).alias("sha256")).orderBy("part").collect()  # a row a file
    return hashlib.sha256("".join(f"{r['sha256']}\n" for r in digests).encode()).hexdigest()


def write_corpus(df: DataFrame, path: str, manifest_path: str, order: list[str], parts: bool = False, **facts: object) -> dict:
    """A corpus, as one file or as a folder of parts, and its manifest, which pins the bytes and the counts by class and subset."""
    digest = write_parts(df, path, order) if parts else None
    n = df.count() if parts else write_lines(df, path, order)
    counts = {r["load_type"]: r["count"] for r in df.groupBy("load_type").count().collect()}
    subsets = [r.asDict() for r in df.groupBy(F.col("source.subset").alias("subset")).agg(F.count(F.lit(1)).alias("entries")).orderBy("subset").collect()]
    manifest = {"corpus": {"file": os.path.basename(path), "sha256": digest or sha256_file(path), "entries": n, "load_types": counts}, "subsets": subsets, **facts}
    write_json(manifest_path, manifest)
    return manifest


def check_identity(manifest_path: str, identity: Mapping[str, object]) -> None:
    """A rerun may overwrite only an output with the same pins."""
    if os.path.exists(manifest_path):
        old = json.loads(Path(manifest_path).read_text(encoding="utf-8")).get("identity", {})
        different = sorted(k for k in {*old, *identity} if old.get(k) != identity.get(k))
        if different:
            raise FileExistsError(f"{manifest_path} belongs to another run: {', '.join(different)} differ")


def new_folder(root: str, name: str) -> Path:
    """A new run folder; an existing one is never touched."""
    folder = Path(root) / name
    folder.mkdir(parents=True, exist_ok=False)
    return folder


def write_report(folder: str | Path, values: Mapping, report: str, name: str = "metrics.json") -> None:
    """report.md, then the values, which mark the folder as finished."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    (Path(folder) / "report.md").write_text(report, encoding="utf-8")
    write_json(Path(folder) / name, values)


def run_report(metrics: Mapping, levels: DataFrame) -> str:
    """An evaluation as Markdown: provenance, then the levels."""
    facts = {"exam": metrics["golden"]["sha256"], "items": metrics["golden"]["item_count"], "compressor": metrics["compressor"], "answers by": metrics["pins"]["answer_model"], "graded by": metrics["pins"]["judge_model"],
             "served": ", ".join(metrics["served_models"]), "calls": f"{metrics['calls']['fresh']} fresh, {metrics['calls']['reused']} reused", "failures": metrics["failures"]}
    warning = "" if metrics["served_as_pinned"] else "\n**Answers were served by another model than the one pinned.**\n"
    return f"# Run {metrics['run_id']}\n\n" + "".join(f"* {k}: {v}\n" for k, v in facts.items()) + warning + f"\n{markdown_table(levels, ['level'])}"


def distill_report(report: Mapping, counts: DataFrame) -> str:
    """A distillation as Markdown: teacher, counts, thresholds, distributions."""
    lines = [f"* teacher: {report['teacher']} (served: {', '.join(report['served_models'])})", f"* calls: {report['calls']}", f"* thresholds: {report['thresholds']}", f"* without words: {report['quarantined']}"]
    shares = "".join(f"| {r['metric']} | {'kept' if r['kept'] else 'dropped'} | {r['p50']:.4f} | {r['p90']:.4f} | {r['p95']:.4f} | {r['mean']:.4f} |\n" for r in report["distributions"])
    return "# Distillation\n\n" + "\n".join(lines) + f"\n\n{markdown_table(counts, ['load_type'])}\n| metric | rows | p50 | p90 | p95 | mean |\n| --- | --- | --- | --- | --- | --- |\n{shares}"


def append_journal(df: DataFrame, path: str) -> None:
    """Records appended as JSON lines, a file a task: no lock is needed."""
    df.write.mode("append").json(path)


def sums_text(digests: DataFrame) -> str:
    """SHA256SUMS lines of a file listing (a folder's files, not a corpus's rows)."""
    return "".join(f"{r['sha256']}  {r['path']}\n" for r in digests.orderBy("path").collect())


def render_pack(template: str, values: Mapping[str, str]) -> str:
    """Fill every {{NAME}}; a template with unknown or missing names is refused, not half rendered."""
    import re

    names = set(re.findall(r"\{\{([A-Z0-9_]+)\}\}", template))
    if names != set(values):
        raise ValueError(f"placeholders {sorted(names ^ set(values))} do not match")
    return re.sub(r"\{\{([A-Z0-9_]+)\}\}", lambda m: values[m[1]], template)


def markdown_table(df: DataFrame, order: list[str]) -> str:
    """A small aggregate as a Markdown table."""
    rows = df.orderBy(*order).collect()
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows]) + "\n"
