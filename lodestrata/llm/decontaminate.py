"""Benchmark decontamination by winnowing, in DataFrame operations only.

Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII
characters. An item's windows are its runs of `window` words; an item of fewer
words is one window. A document word inside any occurrence of a window is hit.

1. Fingerprints: of every `window - k + 1` consecutive k-gram hashes the minimum
   is kept, on both sides. A shared span of `window` words holds the same
   k-grams, so it keeps the same minimum: no such span can be missed. Items of fewer
   words take every gram of their length (winnowing with windows of one).
2. Join: the documents' fingerprints meet the benchmark's. That side is broadcast
   if it has been counted and is small; beyond the bound both sides shuffle as
   (document, fingerprint), the benchmark side replicated over salts, and what is
   found returns to its documents.
3. Extension: around each hit the windows that hold its k-gram are compared with
   the benchmark's windows as text, so hash collisions cannot count. That side too is
   broadcast if it is small, else replicated over salts.

One pass reads the documents for all lengths of items; what it finds is written to
the checkpoint folder. Texts are shuffled only past the first bound, and there only if
the documents found are too many to be broadcast.

Defined results: null and empty texts have no words; very long texts are searched
whole; benchmark rows without words have no window; rows that repeat an item_id act as
one item; a null item_id marks words but is not listed; rows that repeat a document
are each returned; there are no ties, as every hit counts; an empty benchmark hits
nothing; an empty table gives an empty table; other columns are ignored or passed through.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..partitions import spread
from .common import BROADCAST_ROWS, LOWER, UPPER, cut, id_key, maybe_broadcast, steps, text_key, without

WINDOW, GRAM, SALTS = 10, 5, 16
#: What lies between words: ASCII but letters and digits. Splitting takes time in proportion to a text, regexp_extract_all with its square.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def _phrase(words: Column, start: Column, length: int) -> Column:
    """Words start..start+length-1 (from 0), joined by spaces, A-Z lower-cased."""
    return F.translate(F.array_join(F.slice(words, start + 1, F.lit(length)), " "), UPPER, LOWER)


def _from(array: str, place: int) -> Column:
    return F.slice(array, place + 1, F.greatest(F.size(array) - place, F.lit(0)))


def _runs(df: DataFrame, values: str, out: str, n: int, join) -> DataFrame:
    """Adds `out`: `join` over each n consecutive `values`, by doubling, so that no element is looked up by place."""
    size = 1
    df = df.withColumn(out, F.col(values))
    while size < n:
        step = min(size, n - size)  # the next run may overlap this one where join allows; else it is taken from the values
        df, size = (df.withColumn(out, F.zip_with(out, _from(out, step), join)), size + step)
    return df.withColumn(out, F.slice(out, 1, F.greatest(F.size(values) - (n - 1), F.lit(0))))


class _Plan:
    """One length of windows: `length` words, k-gram size and winnowing width."""

    def __init__(self, length: int, k: int):
        self.length, self.k, self.w = length, k, length - k + 1
        self.grams, self.prints = f"_g{length}", f"_f{length}"

    def tag(self, df: DataFrame) -> DataFrame:
        """Adds the hash of each k words and the distinct minima of each w of these. `df` has _h, the words' hashes; _phrase decides later, so overlapping runs may share words in a gram's hash."""
        df = _runs(df, "_h", self.grams, self.k, lambda a, b: F.xxhash64(a, b))
        df = _runs(df, self.grams, self.prints, self.w, lambda a, b: F.least(a, b))
        return df.withColumn(self.prints, F.array_distinct(self.prints))

    def phrases(self) -> Column:
        return F.array_distinct(F.transform(steps(0, F.size("_w") - self.length), lambda i: _phrase(F.col("_w"), i, self.length)))

    def found(self) -> Column:
        return F.transform(self.prints, lambda f: F.struct(F.lit(self.length).alias("l"), f.alias("f")))

    def candidates(self) -> Column:
        """For a row with _w, the grams and one fingerprint _fp: (s, p), the windows around each place of it."""
        places = F.filter(steps(0, F.size(self.grams) - 1), lambda i: F.get(self.grams, i) == F.col("_fp.f"))
        last = F.size("_w") - self.length
        around = lambda p: steps(F.greatest(F.lit(0), p - (self.length - self.k)), F.least(p, last))
        starts = F.array_distinct(F.flatten(F.transform(places, around)))
        return F.transform(starts, lambda s: F.struct(s.alias("s"), _phrase(F.col("_w"), s, self.length).alias("p")))


def _tagged(df: DataFrame, plans: Sequence[_Plan]) -> DataFrame:
    # full lower-casing only makes more words equal here
    return reduce(lambda d, plan: plan.tag(d), plans, df.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(F.lower(w)))))


def _benchmark(items: DataFrame, window: int, gram: int) -> tuple[list[_Plan], DataFrame, DataFrame]:
    """The lengths of windows in use, their distinct fingerprints (_fp) and windows (_l, _p, _item)."""
    lengths = sorted(r[0] for r in items.select(F.least(F.size("_w"), F.lit(window)).alias("l")).filter("l > 0").distinct().collect())
    plans = [_Plan(n, min(gram, n) if n == window else n) for n in lengths]
    fps, windows = [], []
    for plan in plans:
        own = items.filter(F.size("_w") == plan.length if plan.length < window else F.size("_w") >= window)
        fps.append(_tagged(own, [plan]).select(F.explode(plan.found()).alias("_fp")))
        windows.append(own.select(F.lit(plan.length).alias("_l"), F.explode(plan.phrases()).alias("_p"), "_item"))
    return plans, *(cut(reduce(DataFrame.unionByName, x).distinct()) for x in (fps, windows))


#: Columns of a document row that stay with what is found in it.
OUT = ("_id", "_x", "_n")


def _candidates(docs: DataFrame, plans: Sequence[_Plan], fps: DataFrame) -> DataFrame:
    """(_id, _x, _n, _l, _s, _p): windows around each hit, and one row without a window for each document row."""
    tagged = _tagged(docs, plans)
    # explode() of a bare column would let the optimizer infer a filter on its size and copy the whole expression, lambdas within lambdas, below
    anchored = lambda found: F.explode(F.concat(F.array(F.lit(None).cast("struct<l:int,f:long>")), found)).alias("_fp")
    own = F.concat(*[p.found() for p in plans])
    kept = [*OUT, "_w", *[p.grams for p in plans]]
    if fps.count() <= BROADCAST_ROWS:
        rows = tagged.select(*kept, anchored(own)).join(F.broadcast(fps.select("_fp", F.lit(True).alias("_hit"))), "_fp", "left").filter("_fp IS NULL OR _hit")
    else:
        salted = fps.select("_fp", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("_salt"))
        narrow = tagged.select("_id", "_x", F.explode(F.concat(F.array().cast("array<struct<l:int,f:long>>"), own)).alias("_fp")).distinct()
        narrow = narrow.withColumn("_salt", F.pmod("_x", F.lit(SALTS)).cast("int")).join(salted, ["_fp", "_salt"])
        met = cut(narrow.groupBy(id_key(F.col("_id")).alias("_i"), F.col("_x").alias("_y")).agg(F.collect_set("_fp").alias("_m")))
        joined = tagged.join(maybe_broadcast(met, met.count()), (id_key(F.col("_id")) == F.col("_i")) & (F.col("_x") == F.col("_y")), "left")
        rows = joined.select(*kept, anchored(F.coalesce(F.col("_m"), F.array().cast("array<struct<l:int,f:long>>"))))
    windows = reduce(lambda c, p: c.when(F.col("_fp.l") == p.length, p.candidates()), plans, F.when(F.lit(False), None))
    rows = rows.select(*OUT, "_fp", windows.alias("_c")).select(*OUT, "_fp", F.explode_outer("_c").alias("_c"))
    return cut(rows.select(*OUT, F.col("_fp.l").alias("_l"), F.col("_c.s").alias("_s"), F.col("_c.p").alias("_p")))


def contamination(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
) -> DataFrame:
    """One row per document row: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Runs small jobs on the benchmark (the lengths of its items, at most `window` numbers,
    its fingerprints and windows) and one pass over the documents.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_key(text_col).alias("_x"), _words(F.col(text_col)).alias("_w")).withColumn("_n", F.size("_w").cast("long"))
    items = cut(bench.select(F.col(item_col).alias("_item"), _words(F.col(item_text_col)).alias("_w")))
    if items.filter(F.size("_w") > 0).isEmpty():
        found = rows.select(*OUT, F.lit(None).cast("int").alias("_s"), F.lit(None).cast("int").alias("_e"), F.lit(None).cast(items.schema["_item"].dataType).alias("_item"))
    else:
        plans, fps, windows = _benchmark(items, window, gram)
        candidates = _candidates(rows, plans, fps)
        inside = candidates.filter("_p IS NOT NULL")
        n = windows.count()
        if n <= BROADCAST_ROWS:
            inside = inside.join(F.broadcast(windows), ["_l", "_p"])
        else:  # a passage of a third of all documents is dealt over the salts
            salted = windows.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
            inside = inside.withColumn("_salt", F.pmod("_x", F.lit(SALTS)).cast("int")).join(salted, ["_l", "_p", "_salt"])
        inside = inside.select(*OUT, "_s", (F.col("_s") + F.col("_l")).alias("_e"), "_item")
        found = inside.unionByName(candidates.filter("_l IS NULL").select(*OUT), allowMissingColumns=True)
    merge = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(acc["to"], x["s"]))).alias("n"), F.greatest(acc["to"], x["e"]).alias("to")
    )
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    spans = F.array_sort(F.col("_spans"))
    per_doc = found.groupBy("_id", "_x").agg(
        F.max("_n").alias("_n"),
        F.count_if(F.col("_s").isNull()).alias("_rows"),
        F.collect_set(F.when(F.col("_s").isNotNull(), F.struct(F.col("_s").alias("s"), F.col("_e").alias("e")))).alias("_spans"),
        F.collect_set("_item").alias("_items"),
    )
    return (
        per_doc.withColumn("_hit", F.aggregate(spans, zero, merge, lambda acc: acc["n"]).cast("long"))
        .withColumn("_r", F.explode(F.array_repeat(F.lit(0), F.col("_rows").cast("int"))))
        .select(
            F.col("_id").alias(id_col),
            F.col("_n").alias("n_words"),
            F.col("_hit").alias("n_hit"),
            F.size("_items").cast("long").alias("n_items"),
            F.sha2(F.array_join(F.array_sort(F.transform("_items", lambda i: i.cast("string"))), ","), 256).alias("items_sha256"),
            (F.col("_hit") > 0).alias("contaminated"),
            F.col("_x").alias("text_xxhash64"),
        )
    )


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that no benchmark window occurs in, with all columns unchanged. Texts move only if those that go are too many to be broadcast."""
    bad = contamination(docs, bench, id_col=id_col, text_col=text_col, **options).filter("contaminated")
    marked = cut(bad.select(id_key(F.col(id_col)).alias("__ls_k"), F.col("text_xxhash64").alias("__ls_x"), F.lit(True).alias("lost"), F.lit(1).alias("rows")).distinct())
    return without(docs, marked, id_key(F.col(id_col)), text_key(text_col))


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(spread(docs.select("doc_id", "text")), bench).drop("text_xxhash64")


ORACLE = r"""
WITH i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT DISTINCT item_id, l, array_to_string(w[s:s + l - 1], ' ') AS p FROM
        (SELECT item_id, w, least(len(w), 10) AS l, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)),
ls AS (SELECT DISTINCT l FROM iw),
dw AS (SELECT doc_id, l, s, array_to_string(w[s:s + l - 1], ' ') AS p FROM
        (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, ls WHERE len(w) >= l)),
h AS (SELECT DISTINCT doc_id, item_id, s, dw.l FROM dw JOIN iw ON dw.p = iw.p AND dw.l = iw.l),
n AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + l)) AS x FROM h) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
