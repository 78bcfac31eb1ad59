"""Exact deduplication by skew-safe combining, in DataFrame operations only.

1. Local: map-side partial aggregation folds equal texts inside every task.
2. Salted: (digest, salt, full text) groups merge; a text that holds a third of
   all rows is spread over `salts` reducers.
3. Global: the salt winners of a digest (at most `salts` rows a text) meet and
   are combined by full text again.

The digest only routes rows: texts are compared in full at every stage, so a
digest collision never joins different texts. Rows are mapped back to their
group by (digest, salt), which keeps the hot group spread; only for digests that
more than one text has (none, with SHA-256) the text takes part in that join.

Defined results: a null text counts as empty; a null id never wins over a
non-null one; of rows that repeat both id and text exactly one is kept; an empty
table gives an empty table; very long texts are compared whole, like others; there are
no ties but rows that repeat an id; other columns are ignored (`duplicate_groups`)
or passed through (`exact_dedup`), whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, cut, id_key, text_key, without

SALTS = 64


def normalise(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _keyed(df: DataFrame, id_col: str, text_col: str, salts: int, digest: Callable[[Column], Column]) -> DataFrame:
    return (
        df.select(F.col(id_col).alias("_id"), normalise(F.col(text_col)).alias("_t"), text_key(text_col).alias("_x"))
        .withColumn("_d", digest(F.col("_t")))
        .withColumn("_s", F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int"))
    )


def _salt_groups(keyed: DataFrame) -> DataFrame:
    """One row per (digest, salt, text) with its group's keep_id and size; the text itself only where digests collide."""
    salted = keyed.groupBy("_d", "_s", "_t").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    by_text, by_digest = Window.partitionBy("_d", "_t"), Window.partitionBy("_d")
    return (
        salted.repartition("_d")
        .withColumn("_keep", F.min("_first").over(by_text))
        .withColumn("_size", F.sum("_n").over(by_text))
        .withColumn("_clash", F.min("_t").over(by_digest) != F.max("_t").over(by_digest))
        .select("_d", "_s", "_keep", "_size", "_clash", F.when(F.col("_clash"), F.col("_t")).alias("_ct"))
    )


def _rows(df: DataFrame, id_col: str, text_col: str, salts: int, digest: Callable[[Column], Column]) -> DataFrame:
    """(_id, _x, _d, _keep, _size) and, unless the digest is SHA-256, _t of each row. Runs one job (the grouping)."""
    keyed = _keyed(df, id_col, text_col, salts, digest)
    groups = cut(_salt_groups(keyed))
    clashes = groups.filter("_clash")
    if clashes.isEmpty():
        narrow = keyed.drop("_t") if digest is sha256_digest else keyed
        return narrow.join(groups.drop("_clash", "_ct"), ["_d", "_s"])
    theirs = groups.withColumnsRenamed({"_d": "_gd", "_s": "_gs"})
    same = "_d = _gd AND _s = _gs AND (NOT _clash OR _t = _ct)"
    return keyed.join(theirs, F.expr(same)).select("_id", "_x", "_d", "_s", "_t", "_keep", "_size")


def duplicate_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256_digest,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    sha = F.lower(F.hex("_d")) if digest is sha256_digest else F.sha2("_t", 256)
    twin = Window.partitionBy("_d", "_s", "_id", "_keep").orderBy("_id")
    return _rows(df, id_col, text_col, salts, digest).withColumn("_rn", F.row_number().over(twin)).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_rn") == 1)).alias("kept"),
        sha.alias("text_sha256"),
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows that stay, with all columns of `df` unchanged.

    What goes is found by (id, hash of the text). Texts are not shuffled once more while
    that list, which is counted, can be broadcast; a longer one meets them in a join.
    Rows that keep_id shares with other raw texts of the same group: the text with the smallest hash stays.
    """
    rows = _rows(df, id_col, text_col, salts, sha256_digest).filter("_size > 1")
    own = F.col("_id").eqNullSafe(F.col("_keep"))
    # rows of one id may hold different texts that are equal after normalisation: of these, one stays
    least = rows.filter(own).groupBy("_d").agg(F.min("_x").alias("_least")).withColumnRenamed("_d", "_wd")
    keys = rows.groupBy(id_key(F.col("_id")).alias("__ls_k"), F.col("_x").alias("__ls_x"), "_d").agg(F.max(~own).alias("lost"), F.count(F.lit(1)).alias("rows"))
    other = keys.filter("NOT lost").join(least, F.col("_d") == F.col("_wd")).select("__ls_k", "__ls_x", (F.col("__ls_x") != F.col("_least")).alias("lost"), "rows")
    marked = cut(keys.filter("lost").select("__ls_k", "__ls_x", "lost", "rows").unionByName(other))
    return without(df, marked, id_key(F.col(id_col)), text_key(text_col))


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM t
"""
