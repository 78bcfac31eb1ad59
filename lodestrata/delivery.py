"""Checks of a model checkpoint folder and its hand-over pack. Driver-side: a folder has a few files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import SparkSession

from .sources import records, sinks

PASS, VIOLATION, UNVERIFIED = "pass", "violation", "unverified"


def _config(folder: Path) -> dict | None:
    try:
        value = json.loads((folder / "config.json").read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None
    return value if isinstance(value, dict) else None


def _offsets(folder: Path) -> tuple[str, str]:
    """Whether the tokenizer gives character offsets that spell the text."""
    path = folder / "tokenizer.json"
    if not path.exists():
        return VIOLATION, "tokenizer.json is missing"
    try:
        from tokenizers import Tokenizer
    except ImportError:
        return UNVERIFIED, "tokenizers is not installed"
    try:
        encoding = Tokenizer.from_file(str(path)).encode("Keep 42 of them.", add_special_tokens=False)
    except Exception as e:  # the library raises bare Exceptions for files that it cannot read
        return VIOLATION, f"tokenizer.json cannot be read: {e}"
    spans = [(a, b) for a, b in encoding.offsets if b > a]
    good = bool(spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    return (PASS, "offsets are ordered") if good else (VIOLATION, "offsets overlap or are empty")


def verify(folder: str) -> dict:
    """Five checks, each pass, violation or unverified, and the overall state."""
    root, config = Path(folder), _config(Path(folder))
    checks = []

    def add(name: str, ok: bool, detail: str) -> None:
        checks.append({"check": name, "state": PASS if ok else VIOLATION, "detail": detail})

    architectures = (config or {}).get("architectures") or []
    add("architecture", any(str(a).endswith("ForTokenClassification") for a in architectures), f"architectures: {architectures}")
    labels = (config or {}).get("id2label") or {}
    n = (config or {}).get("num_labels", len(labels))
    add("num_labels", n == 2, f"labels: {n}")
    add("id2label", {str(k) for k in labels} in ({"0", "1"}, set()), f"id2label: {labels}")
    add("weights", any(root.glob("*.safetensors")) or any(root.glob("pytorch_model*.bin")), "model weights")
    state, detail = _offsets(root)
    checks.append({"check": "offsets", "state": state, "detail": detail})
    states = {c["state"] for c in checks}
    return {"schema_version": 1, "checks": checks, "overall": VIOLATION if VIOLATION in states else UNVERIFIED if UNVERIFIED in states else PASS}


def identity(folder: str) -> str:
    """The model's name from its config, else its folder's."""
    return str((_config(Path(folder)) or {}).get("_name_or_path") or Path(folder).name)


def pack(spark: SparkSession, folder: str, out: str, template: str) -> dict:
    """SHA256SUMS, the filled-in template and the report in a new folder; a checkpoint with violations is refused."""
    report = verify(folder)
    if report["overall"] == VIOLATION:
        bad = [c["check"] for c in report["checks"] if c["state"] == VIOLATION]
        raise ValueError(f"checkpoint fails: {', '.join(bad)}")
    digests = records.file_digests(spark, folder)
    digest = records.directory_digest(digests).first()["digest"]
    target = Path(out)
    text = sinks.render_pack(Path(template).read_text(encoding="utf-8"), {"MODEL": identity(folder), "DIGEST": digest})
    target.mkdir(parents=True, exist_ok=False)
    (target / "SHA256SUMS").write_text(sinks.sums_text(digests), encoding="utf-8")
    (target / "integration.md").write_text(text, encoding="utf-8")
    sinks.write_json(target / "verify.json", report)
    return {"digest": digest, **report}
