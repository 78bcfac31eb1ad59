"""Training windows: subword labels by span overlap, packing of whole word groups, batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..partitions import lengths, slices
from .splits import range_rank

#: text -> (start, end) of each subword.
Tokenizer = Callable[[str], list[tuple[int, int]]]


def pieces(text: str, size: int = 4) -> list[tuple[int, int]]:
    """A stand-in subword tokenizer: runs without white space in pieces of `size` characters."""
    import re

    return [(a, min(a + size, m.end())) for m in re.finditer(r"\S+", text) for a in range(m.start(), m.end(), size)]


def align(words: list[tuple[int, int, int]], subwords: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(label, owner) of each subword: those of the word span it overlaps, else (0, -1). Both lists are sorted: one merge."""
    out, w = [], 0
    for start, end in subwords:
        while w < len(words) and words[w][1] <= start < end:
            w += 1
        hit = end > start and w < len(words) and words[w][0] < end and start < words[w][1]
        out.append((words[w][2], w) if hit else (0, -1))
    return out


def align_labels(df: DataFrame, text: str, spans: str, tokenizer: Tokenizer = pieces, kept: Sequence[str] | None = None) -> DataFrame:
    """`df` (or its columns `kept`) with subwords array<struct<start, end, label, owner>>; `spans` is an array of structs that hold start, end and keep.

    Spans and subwords cross as flat Arrow arrays with offsets, not as Python rows; of a span
    only its numbers cross. Python holds the subwords of one slice of a batch at a time.
    """
    kept = [c for c in (df.columns if kept is None else kept) if c != "subwords"]
    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema.fields], "subwords array<struct<start:int,end:int,label:int,owner:int>>"])

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches_, "_t", "_s"):
            texts, lists = batch.column("_t"), batch.column("_s")
            inner, at = lists.flatten(), np.append(0, np.cumsum(lengths(lists))).tolist()
            start, end, keep = (inner.field(n).to_numpy(zero_copy_only=False).tolist() for n in ("start", "end", "keep"))
            flat: list[tuple[int, int, int, int]] = []
            offsets = [0]
            for k, t in enumerate(texts.to_pylist()):
                a, b = at[k], at[k + 1]
                subwords = tokenizer(t or "")
                flat += [(*s, *lo) for s, lo in zip(subwords, align(list(zip(start[a:b], end[a:b], keep[a:b])), subwords))]
                offsets.append(len(flat))
            cols = list(zip(*flat)) or [()] * 4
            struct = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in cols], ["start", "end", "label", "owner"])
            out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], out], [*kept, "subwords"])

    numbers = F.transform(spans, lambda s: F.struct(*[s[n].alias(n) for n in ("start", "end", "keep")]))
    return df.select(*kept, F.col(text).alias("_t"), numbers.alias("_s")).mapInArrow(run, fields)


def group_sizes(owners: Column) -> Column:
    """Sizes of runs of one owner."""

    def step(acc: Column, o: Column) -> Column:
        same = (F.size(acc["sizes"]) > 0) & (acc["last"] == o)
        grown = F.concat(F.slice(acc["sizes"], 1, F.greatest(F.lit(0), F.size(acc["sizes"]) - 1)), F.array(F.element_at(F.concat(F.array(F.lit(0)), acc["sizes"]), -1) + 1))
        return F.struct(F.when(same, grown).otherwise(F.concat(acc["sizes"], F.array(F.lit(1)))).alias("sizes"), o.alias("last"))

    zero = F.struct(F.array().cast("array<int>").alias("sizes"), F.lit(-2).alias("last"))
    return F.aggregate(owners, zero, step, lambda acc: acc["sizes"])


def pack(sizes: Column, max_seq_len: int) -> Column:
    """struct<windows, truncated>: windows filled by whole groups within max_seq_len - 2; a larger group is a window of its own, cut."""
    if max_seq_len < 3:
        raise ValueError("max_seq_len must be at least 3")
    room = max_seq_len - 2

    def step(acc: Column, g: Column) -> Column:
        fits = acc["used"] + g <= room
        closed = (acc["used"] > 0).cast("int")
        windows = acc["windows"] + F.when(fits, F.lit(0)).otherwise(closed + (g > room).cast("int"))
        used = F.when(fits, acc["used"] + g).otherwise(F.when(g <= room, g).otherwise(F.lit(0)))
        return F.struct(windows.alias("windows"), used.alias("used"), (acc["truncated"] + F.greatest(F.lit(0), g - room)).alias("truncated"))

    zero = F.struct(F.lit(0).alias("windows"), F.lit(0).alias("used"), F.lit(0).alias("truncated"))
    return F.aggregate(sizes, zero, step, lambda acc: F.struct((acc["windows"] + (acc["used"] > 0).cast("int")).alias("windows"), acc["truncated"].alias("truncated")))


def windows(df: DataFrame, subwords: str, max_seq_len: int, id_col: str = "id") -> DataFrame:
    """(id, window, labels): the windows themselves, streamed row by row."""
    room = max_seq_len - 2
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, subs in zip(b["_id"], b["_s"]):
                groups: list[list[int]] = []
                owner = None
                for s in subs:
                    if owner is None or s["owner"] != owner:
                        groups.append([])
                    owner = s["owner"]
                    groups[-1].append(int(s["label"]))
                packed: list[list[int]] = []
                open_: list[int] = []
                for g in groups:
                    if len(open_) + len(g) > room and open_:
                        packed.append(open_)
                        open_ = []
                    if len(g) > room:
                        packed.append(g[:room])
                    else:
                        open_ = open_ + g
                rows += [(i, k, labels) for k, labels in enumerate([*packed, *([open_] if open_ else [])])]
            yield pd.DataFrame(rows, columns=["_id", "window", "labels"])

    return df.select(F.col(id_col).alias("_id"), F.col(subwords).alias("_s")).mapInPandas(run, f"_id {kind}, window int, labels array<int>").withColumnRenamed("_id", id_col)


def epoch_order(rows: DataFrame, epochs: int, seed: int, key: str) -> DataFrame:
    """(epoch, key, place): a reproducible order of each epoch by a hash of seed, epoch and key."""
    spread = rows.select(key, F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    order = F.sha2(F.concat_ws(":", (F.col("epoch") + seed).cast("string"), F.col(key).cast("string")), 256)
    return range_rank(spread.withColumn("_o", order), ["epoch"], "_o", [key]).select(key, "epoch", F.col("rank").alias("place"))


def batches(ordered: DataFrame, size: int, labels: str = "labels", cls: int = 101, sep: int = 102, pad: int = 0) -> DataFrame:
    """Rows in order -> (epoch, batch, width): each padded to its batch's largest window plus two."""
    return ordered.withColumn("batch", F.floor((F.col("place") - 1) / size).cast("int")).withColumn("width", F.max(F.size(labels)).over(Window.partitionBy("epoch", "batch")) + 2)


def padded(batched: DataFrame, labels: str = "labels", ignore: int = -100) -> DataFrame:
    """`batched` with targets and mask of its batch's width: the labels between two ignored places (the first and last token), then ignored padding; the mask is 1 up to the last token."""
    rest = F.col("width") - F.size(labels) - 2
    hidden = F.array(F.lit(ignore))
    return batched.withColumns({
        "targets": F.concat(hidden, F.col(labels).cast("array<int>"), hidden, F.array_repeat(F.lit(ignore), rest)),
        "mask": F.concat(F.array_repeat(F.lit(1), F.size(labels) + 2), F.array_repeat(F.lit(0), rest)),
    })
