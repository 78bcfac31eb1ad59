"""Evaluation of a compressor: item metrics, level sweeps, judged task quality, paired runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoint import cut
from ..functions import text as T
from . import stats

#: (words, drop per ten) -> kept words: a compressor is any function from Column to Column.
Compressor = Callable[[Column, Column], Column]


def prepare(items: DataFrame, text: str = "text") -> DataFrame:
    """Adds _words and _facts, which all levels share: work them out before a sweep multiplies the rows."""
    return items.withColumns({"_words": T.ws_tokens(F.col(text)), "_facts": T.facts(F.col(text))})


def sweep(items: DataFrame, levels: Sequence[float]) -> DataFrame:
    """Items times levels; the drop per ten is worked out once, half to even."""
    rows = F.array(*[F.struct(F.lit(float(v)).alias("level"), F.lit(T.dropped_per_ten(v)).alias("drop")) for v in levels])
    return items.withColumn("_l", F.explode(rows)).select("*", "_l.level", "_l.drop").drop("_l")


def item_metrics(items: DataFrame, text: str = "text", compress: Compressor = T.compress_words, given: str | None = None, bare: bool = False) -> DataFrame:
    """Adds compressed (unless a column with it is given, or numbers are enough: `bare`), tokens_original, tokens_compressed, kept_ratio, removed and fact_recall. `items` has a `drop` column, and is prepared here if it has not been."""
    words = items if "_words" in items.columns else prepare(items, text)
    if bare and not given:  # the kept words are counted and joined where they arise: as a column they would be copied, for each level
        joined = lambda k: F.when(F.size("_facts") > 0, T.let(F.array_join(k, " "), lambda t: T.recall_of(F.col("_facts"), t))).otherwise(F.lit(1.0))
        both = T.let(compress(F.col("_words"), F.col("drop")), lambda k: F.struct(F.size(k).cast("long").alias("n"), joined(k).alias("recall")))
        measured = words.withColumn("_m", both).withColumns({"tokens_original": F.size("_words").cast("long"), "tokens_compressed": F.col("_m.n")})
        recall = F.col("_m.recall")
    else:
        kept = words.withColumn("_kept", T.ws_tokens(F.col(given)) if given else compress(F.col("_words"), F.col("drop")))
        measured = (
            kept.withColumn("compressed", F.col(given) if given else F.array_join("_kept", " "))
            .withColumn("tokens_original", F.size("_words").cast("long"))
            .withColumn("tokens_compressed", F.size("_kept").cast("long"))
        )
        recall = T.recall_of(F.col("_facts"), F.col("compressed"))
    measured = measured.drop("_words", "_kept")
    ratio = T.kept_ratio(F.col("tokens_original"), F.col("tokens_compressed"))
    return measured.withColumn("kept_ratio", ratio).withColumn("removed", 1 - F.col("kept_ratio")).withColumn("fact_recall", recall).drop("_facts", "_m")


def document_f05(items: DataFrame, original: str, compressed: str, name: str = "token_f05", wordless: bool = True) -> DataFrame:
    """`items` with the token F0.5 of each row's texts; null where the original has no words, or without these rows. Nothing is shuffled."""
    counted = items.withColumns({"_a": T.word_tokens(F.col(original)), "_b": T.word_tokens(F.col(compressed))})
    measured = counted.withColumns({"_o": T.overlap(F.col("_a"), F.col("_b")), "_na": F.size("_a"), "_nb": F.size("_b")})
    score = F.when(F.col("_na") > 0, T.f05(F.col("_o"), F.greatest(F.col("_na"), F.lit(1)), F.col("_nb")))
    if not wordless:  # a filter would be pushed to the scan, and the words be found twice
        score = F.explode(T.unfiltered(F.when(F.col("_na") > 0, F.array(score)), "double"))
    return measured.withColumn(name, score).drop("_a", "_b", "_o", "_na", "_nb")


def aggregate(items: DataFrame, *keys: str, more: Sequence[Column] = ()) -> DataFrame:
    """Sums, the ratio of sums, means of ratios and exact percentiles, and `more` aggregates in the same pass. Reads the items' numbers, not their texts, from a written table."""
    rows = cut(items)
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("tokens_original").alias("sum_original"), F.sum("tokens_compressed").alias("sum_compressed"),
        (F.sum("tokens_compressed").cast("double") / F.sum("tokens_original")).alias("kept_micro"), F.round(F.avg("kept_ratio"), 9).alias("kept_macro"),
        F.round(F.avg("fact_recall"), 9).alias("mean_fact_recall"), *more,
    )
    return stats.with_percentiles(sums, rows, list(keys), {"kept_p95": ("kept_ratio", 95)})


def judged(items: DataFrame, points: str, answer: str, name: str) -> DataFrame:
    """Adds the mechanical judge's mean score of `answer` as `name`."""
    reply = T.judge_reply(F.col(points), F.col(answer))
    return items.withColumn("_s", T.parse_judge(reply, F.size(points))).withColumn(name, T.mean_score(F.col("_s"))).drop("_s")


def paired(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """b - a of `value` over the keys that both runs have."""
    return a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys).select(*keys, (F.col("_b") - F.col("_a")).alias("difference"))
