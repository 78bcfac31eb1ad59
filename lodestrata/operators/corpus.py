"""Training and exam rows: building, registry joins, validation and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

LOAD_TYPES = ("rag", "system_prompt", "dialogue")


def build_entries(rows: DataFrame, dataset: str, license_: str) -> DataFrame:
    """(subset, fp, prompt) -> corpus rows; ids are train-<subset>-<first 8 digits of fp>."""
    source = F.struct(
        F.lit(dataset).alias("dataset"), F.col("subset"), F.lit(license_).alias("license"), F.lit("train").alias("split"), F.col("fp").alias("content_sha1")
    )
    return rows.select(
        F.concat_ws("-", F.lit("train"), "subset", F.substring("fp", 1, 8)).alias("id"), F.lit("rag").alias("load_type"), "prompt", F.lit("").alias("question"), F.lit("").alias("task"), source.alias("source")
    )


def registry_outcome(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Left join with a registry (subset, license, train_use, boundary): excluded, unknown or registered. Reserved fields must be empty where the registry says so (`reserved_empty`), or says nothing."""
    reserved = F.col("reserved_empty") if "reserved_empty" in registry.columns else F.lit(True)
    known = registry.select("subset", F.col("license").alias("reg_license"), "train_use", "boundary", reserved.alias("reserved_empty"))
    joined = rows.join(known, "subset", "left")
    state = F.when(F.col("train_use").isNull(), "unknown").when(~F.col("train_use"), "excluded").otherwise("registered")
    return joined.withColumn("outcome", state)


def row_errors(denied: Sequence[str] = ("meetingbank",), split: str = "train") -> Column:
    """Messages for a corpus row joined with its registry entry; unusable rows are reported, never a crash."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    return T.error_list(
        (blank("id"), "id is empty"),
        (~F.coalesce(F.col("load_type").isin(*LOAD_TYPES), F.lit(False)), "load_type is not known"),
        (blank("prompt"), "prompt is empty"),
        (T.contains_any(F.concat_ws("/", "dataset", "subset"), denied), "source is excluded"),
        (~F.coalesce(F.col("split") == split, F.lit(False)), f"split is not {split}"),
        (F.col("outcome") == "unknown", "subset is not registered"),
        (F.col("outcome") == "excluded", "subset must not be trained on"),
        (F.col("license") != F.col("reg_license"), "license differs from the registry"),
        ((F.col("outcome") == "registered") & ~F.coalesce(F.col("fp") >= F.col("boundary"), F.lit(False)), "fingerprint is not in the train half"),
        (F.coalesce(F.col("reserved_empty"), F.lit(True)) & (F.col("question") != ""), "question must be empty"),
    )


def golden_errors() -> Column:
    """Messages for an exam row."""
    return T.error_list(
        (F.coalesce(F.trim("id") == "", F.lit(True)), "id is empty"),
        (~F.coalesce(F.col("load_type").isin(*LOAD_TYPES), F.lit(False)), "load_type is not known"),
        (F.coalesce(F.trim("prompt") == "", F.lit(True)), "prompt is empty"),
        (F.coalesce(F.size("key_points") == 0, F.lit(True)) | F.exists("key_points", lambda p: F.coalesce(F.trim(p) == "", F.lit(True))), "key_points are empty"),
        (~F.coalesce(F.col("split") == "eval", F.lit(False)), "split is not eval"),
    )


def duplicates(rows: DataFrame, key: str, pos: str, salts: int = 16) -> DataFrame:
    """Rows after the first of each key, with the position of the first. A key with many rows is dealt over `salts` tasks."""
    firsts = rows.groupBy(key).agg(F.min(pos).alias("first_pos"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    spread = firsts.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("_s", F.pmod(F.xxhash64(pos), F.lit(salts)).cast("int"))
    return salted.join(spread, [key, "_s"]).filter(F.col(pos) > F.col("first_pos")).drop("_s")


def first_error(errors: DataFrame, pos: str, message: str) -> DataFrame:
    """The first message and the number of further ones: what a fail-fast reader reports."""
    return errors.agg(F.min_by(message, F.struct(pos, message)).alias("first"), (F.count(F.lit(1)) - 1).alias("more"))


def reconcile(rows: DataFrame, expected: DataFrame, key: str = "subset", n: str = "entries") -> DataFrame:
    """Full outer join of actual and expected counts; only differences."""
    actual = rows.groupBy(key).agg(F.count(F.lit(1)).alias("actual"))
    joined = actual.join(expected.select(key, F.col(n).alias("expected")), key, "full_outer")
    return joined.select(key, F.coalesce("actual", F.lit(0)).alias("actual"), F.coalesce("expected", F.lit(0)).alias("expected")).filter("actual <> expected")


def mix_percent(rows: DataFrame, key: str = "load_type") -> DataFrame:
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(key, "n", (F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy())).alias("pct"))


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts by each key apart, in one pass."""
    return rows.groupingSets([[k] for k in keys], *keys).agg(F.count(F.lit(1)).alias("n"))


def in_band(rows: DataFrame, tokens: str, low: int, high: int, answers: str) -> DataFrame:
    """Rows of low to high tokens with a non-blank answer."""
    return rows.filter(F.col(tokens).between(low, high) & F.exists(answers, lambda a: F.trim(a) != ""))
