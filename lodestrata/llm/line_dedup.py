"""Line deduplication by pairwise alignment.

A line of a document is deleted if it lies in a block of consecutive lines, of at
least `min_words` words together, that a document with a smaller id has as well.
Lines are compared without the spaces around them; lines without a word are no
lines here, and each goes with the line before it (leading ones with the first).

1. Keys: from every line the shortest run of lines onwards, and the shortest run
   back, that reaches `min_words` words (for a long line both are the line itself).
   Whatever block two documents share is made of such runs, so each shared block has
   shared keys, however short its lines. A key is 128 bits of two line hashes.
2. Pairs: a key with at most `rare` holders makes its later holders overlap with its
   first one (the smallest id). Every pair's whole line sequences are aligned with
   patience diff (common head and tail, then lines unique to both in a longest
   increasing run, then again between those), and aligned blocks are deleted from the
   later document. Blocks that one alignment must leave out, as they come in another
   order or more than once, are then aligned one by one, each with its first place.
3. Frequent keys: a key that more documents hold pairs none of them. The run that it
   stands for is what would be aligned: it is deleted from all but its first holder.

No link is lost by pairing with first holders only: a pair's blocks are all deleted,
so each key is deleted from every document but the first that has it.

Line hashes, not texts, are shuffled. A key's documents are dealt over SALTS tasks. A
document is sent to at most `rare` - 1 others for each of its lines, and what it meets
(at most one partner a key) streams past its own lines.

Defined results: a null text stays null and has no lines; documents with a null id
are neither first nor changed; rows that repeat an id are never compared with each
other, and each is cleaned; so there are no ties, as ids decide what is earlier; a
document that is all copied becomes the empty text; very long texts are aligned whole;
empty tables give empty tables; other columns are passed through, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import NON_SPACES, cut, quoted
from .textarrays import mix

#: Words of a block that is deleted; holders up to which a key is rare; tasks that a key's documents are dealt over.
MIN_WORDS, RARE, SALTS = 8, 64, 16


def _unique(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """(place in a, place in b) of lines that occur once in each range, by place in a."""
    in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
    at = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
    return [(i, at[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in at]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs whose second places increase (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        back.append(piles[p - 1] if p else -1)
        if p == len(tops):
            tops.append(j)
            piles.append(k)
        else:
            tops[p], piles[p] = j, k
    run, k = [], piles[-1] if piles else -1
    while k >= 0:
        run.append(pairs[k])
        k = back[k]
    return run[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of two sequences by patience diff, in order."""
    out: list[tuple[int, int]] = []
    ranges = [(0, len(a), 0, len(b))]
    while ranges:
        a0, a1, b0, b1 = ranges.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        anchors = _increasing(_unique(a, b, a0, a1, b0, b1))
        if anchors:
            out += anchors
            for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)]):
                if i + 1 < k and j + 1 < m:
                    ranges.append((i + 1, k, j + 1, m))
    return sorted(out)


def runs(words: np.ndarray, starts: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct [a, b) of the shortest runs, from each line onwards and back, of at least `min_words` words. Texts begin at `starts`; every line has a word."""
    n = len(words)
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    text = np.searchsorted(starts, np.arange(n), side="right") - 1
    begin, end = starts[text], np.append(starts[1:], n)[text]
    onward, back = np.searchsorted(total, total[:-1] + min_words), np.searchsorted(total, total[1:] - min_words, side="right") - 1
    place = np.arange(n)
    some, more = onward <= end, back >= begin
    a, b = np.concatenate([place[some], back[more]]), np.concatenate([onward[some], place[more] + 1])
    both = np.unique(a * (n + 1) + b)
    return both // (n + 1), both % (n + 1)


def run_hashes(lines: np.ndarray, a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each run of line hashes, in step (a run has at most `min_words` lines)."""
    out = np.full(len(a), seed, np.uint64)
    for k in range(int((b - a).max()) if len(a) else 0):
        live = np.flatnonzero(a + k < b)
        out[live] = mix(out[live] * np.uint64(31) + lines[a[live] + k])
    return out


def blocks(aligned: list[tuple[int, int]], words: list[int], min_words: int) -> set[int]:
    """The second places of aligned pairs in runs, consecutive on both sides, of at least `min_words` words."""
    out: set[int] = set()
    run: list[int] = []
    last = (-2, -2)
    for i, j in [*aligned, (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words[k] for k in run) >= min_words:
                out.update(run)
            run = []
        run.append(j)
        last = (i, j)
    return out


def copied(first: list[int], later: list[int], words: list[int], min_words: int = MIN_WORDS) -> set[int]:
    """Lines of `later` in blocks that `first` has: those that patience diff aligns, then those that it had to leave out."""
    gone = blocks(patience(first, later), words, min_words)
    known = set(first)
    if all(j in gone or line not in known for j, line in enumerate(later)):
        return gone
    a, b = runs(np.array(words), np.zeros(1, int), min_words)
    left = [(i, j) for i, j in zip(a.tolist(), b.tolist()) if not gone.issuperset(range(i, j)) and known.issuperset(later[i:j])]
    for size in {j - i for i, j in left}:
        held = {tuple(first[i : i + size]) for i in range(len(first) - size + 1)}
        for i, j in left:
            if j - i == size and tuple(later[i:j]) in held:
                gone.update(range(i, j))
    return gone


def _with_blanks(gone: set[int], solid: np.ndarray, n_lines: int) -> list[int]:
    """Places among all lines of deleted lines with words, and of the lines without words that go with them."""
    owner = np.maximum(np.searchsorted(solid, np.arange(n_lines), side="right") - 1, 0)
    return np.flatnonzero(np.isin(owner, list(gone))).tolist()


def _keys(docs: DataFrame, min_words: int) -> DataFrame:
    """(d, k, l): the keys of each document row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, g, w = (batch.column(k) for k in (1, 2, 3))
            words = w.flatten().to_numpy(zero_copy_only=False)
            solid = words > 0
            row = np.repeat(np.arange(batch.num_rows), w.value_lengths().to_numpy(zero_copy_only=False))[solid]
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            a, b = runs(words[solid], starts, min_words) if len(row) else (row, row)
            k, l = (run_hashes(x.flatten().to_numpy(zero_copy_only=False).view(np.uint64)[solid], a, b, seed).view(np.int64) for x, seed in ((h, 1), (g, 2)))
            order = np.lexsort((l, k, row[a]))
            ids = row[a][order]
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(ids) != 0) | (np.diff(k[order]) != 0) | (np.diff(l[order]) != 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids[new])), pa.array(k[order][new]), pa.array(l[order][new])], names=["d", "k", "l"])

    kind = docs.schema["d"].dataType.simpleString()
    return docs.select("d", "h", "g", "w").mapInArrow(run, f"d {kind}, k long, l long")


OWN, PARTNER, FREQUENT = 0, 1, 2


def _aligner(kind: pa.DataType, min_words: int):
    """Rows sorted by (d, x, kind): the document's lines, each partner's lines, frequent keys to delete -> (d, x, deleted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out = None, []
        gone: set[int] = set()
        lines, words, solid, n_lines = [], [], np.empty(0, int), 0

        def result() -> pa.RecordBatch:
            d, x, deleted = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(d, kind), pa.array(x, pa.int64()), pa.array(deleted, pa.list_(pa.int32()))], names=["d", "x", "deleted"])

        for batch in batches:
            d, x, which = (batch.column(k).to_pylist() for k in range(3))
            for r, now in enumerate(zip(d, x)):
                if now != key:
                    if gone:
                        out.append((*key, _with_blanks(gone, solid, n_lines)))
                    key, gone = now, set()
                h = batch.column(3)[r].values.to_numpy(zero_copy_only=False)
                if which[r] == OWN:
                    w = batch.column(4)[r].values.to_numpy(zero_copy_only=False)
                    solid, n_lines = np.flatnonzero(w > 0), len(w)
                    lines, words = h[solid].tolist(), w[solid].tolist()
                elif which[r] == PARTNER:
                    gone |= copied(h.tolist(), lines, words, min_words)
                else:
                    a, b = runs(np.array(words), np.zeros(1, int), min_words)
                    hit = np.isin(run_hashes(np.array(lines, np.int64).view(np.uint64), a, b, 1).view(np.int64), h)
                    for i, j in zip(a[hit].tolist(), b[hit].tolist()):
                        gone.update(range(i, j))
            if out:
                yield result()
                out = []
        if gone:
            out.append((*key, _with_blanks(gone, solid, n_lines)))
            yield result()

    return run


def copied_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, rare: int = RARE) -> DataFrame:
    """(d, x, deleted): id, hash of the text and places (from 0) of the lines to delete, for documents that lose any."""
    line = lambda s: F.struct(F.xxhash64(F.trim(s)).alias("h"), F.xxhash64(F.lit(1), F.trim(s)).alias("g"), F.regexp_count(s, F.lit(NON_SPACES)).alias("w"))
    docs = df.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("d"), F.xxhash64(text_col).alias("x"), F.transform(F.split(text_col, "\n"), line).alias("s")
    )
    docs = cut(docs.select("d", "x", *[F.col(f"s.{c}").alias(c) for c in "hgw"]))
    has = _keys(docs, min_words)
    firsts = has.groupBy("k", "l").agg(F.min("d").alias("f"), F.max("d").alias("m"), F.count(F.lit(1)).alias("n")).filter("m > f")
    salted = firsts.select("k", "l", "f", (F.col("n") <= rare).alias("rare"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    met = cut(has.withColumn("s", F.pmod(F.xxhash64("d"), F.lit(SALTS)).cast("int")).join(salted, ["k", "l", "s"]).filter("d > f").select("d", "f", "k", "rare"))
    pairs = met.filter("rare").select("f", "d").distinct()
    shared = docs.select(F.col("d").alias("f"), F.transform(F.filter(F.arrays_zip("h", "w"), lambda z: z["w"] > 0), lambda z: z["h"]).alias("h"))
    theirs = pairs.join(shared, "f").select("d", F.lit(PARTNER).alias("kind"), "h")
    frequent = met.filter("NOT rare").groupBy("d").agg(F.collect_set("k").alias("h")).select("d", F.lit(FREQUENT).alias("kind"), "h")
    later = docs.join(met.select("d").distinct(), "d", "left_semi")
    # a row for each text of an id; a text's partners follow it
    meets = theirs.unionByName(frequent).join(later.select("d", "x").distinct(), "d").select("d", "x", "kind", "h", F.lit(None).cast("array<int>").alias("w"))
    rows = later.select("d", "x", F.lit(OWN).alias("kind"), "h", "w").unionByName(meets).repartition("d", "x").sortWithinPartitions("d", "x", "kind")
    kind = df.schema[id_col].dataType
    return rows.mapInArrow(_aligner(to_arrow_type(kind), min_words), f"d {kind.simpleString()}, x long, deleted array<int>")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, rare: int = RARE) -> DataFrame:
    """`df` with the text cleaned, and __ls_lines and __ls_deleted (numbers of lines)."""
    # a text that several rows repeat under one id is cleaned once
    gone = copied_lines(df, id_col, text_col, min_words, rare).toDF("__ls_d", "__ls_gx", "__ls_gone").dropDuplicates(["__ls_d", "__ls_gx"])
    tagged = df.withColumn("__ls_x", F.xxhash64(text_col))
    joined = tagged.join(gone, (F.col(id_col) == F.col("__ls_d")) & (F.col("__ls_x") == F.col("__ls_gx")), "left")
    left = F.filter(F.split(text_col, "\n"), lambda s, i: ~F.array_contains("__ls_gone", i))
    text = F.when(F.col("__ls_gone").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    return joined.select(
        *[text.alias(n) if n == text_col else c for n, c in zip(df.columns, quoted(df.columns))],
        F.coalesce(F.size(F.split(text_col, "\n")), F.lit(0)).cast("long").alias("__ls_lines"),
        F.coalesce(F.size("__ls_gone"), F.lit(0)).cast("long").alias("__ls_deleted"),
    )


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", F.col("__ls_lines").alias("n_lines"), F.col("__ls_deleted").alias("n_deleted"))
