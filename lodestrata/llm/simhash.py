"""SimHash near-duplicates with covering locality-sensitive hashing.

Fingerprints: the majority, bit by bit, of the XXH64 hashes (seed 42) of a text's
3-word shingles. Copies share a fingerprint, so the rest works on distinct ones.

Search: every bit position gets a non-zero vector of r + 1 bits; for each of the
2^(r+1) - 1 non-zero vectors v a mask holds the positions whose vector has an odd
product with v. Up to r differing positions span fewer than r + 1 dimensions, so
some v is orthogonal to all of them and its mask sees no difference: every pair
within the radius meets in a table, with certainty.

Buckets are compared in Arrow batches that hold distinct 64-bit values only, and
give one edge per member (to the smallest of its component in the bucket), never
all pairs. A bucket of over SMALL values is divided inside its task by masks over
the bits that vary in it; one of over `max_bucket` values is handed back and dealt
out again by a second set of masks, as often as needed (values that are all within
the radius of each other, some hundred at most, cannot be dealt apart: `max_bucket`
must not be smaller than that). Components come from
alternating large-star and small-star rounds, each written to the checkpoint
folder.

Defined results: a null or blank text has fingerprint zero, which links like any
other; a very long text is hashed whole; a bit that half of the hashes set is 0; rows that repeat an id are each returned; null ids never become a
component_id unless a component has no other (then it is null); an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..partitions import spread
from .common import cut, id_key, maybe_broadcast, quoted, text_key

RADIUS, SHINGLE, SEED, MAX_BUCKET, SMALL = 3, 3, 42, 1_000_000, 1024
#: Rows of one fingerprint beyond which its component is broadcast to them (n rows have at most n / HOT such fingerprints).
HOT = 10_000


# ---- fingerprints

def shingle_hashes(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of `shingle` words of a UTF-8 text, repeats included; of all its words if they are fewer."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), SEED)]
    elif shingle == 3:
        hashes = [digest(a + b" " + b + b" " + c, SEED) for a, b, c in zip(words, words[1:], words[2:])]
    elif shingle == 5:
        hashes = [digest(b"%b %b %b %b %b" % run, SEED) for run in zip(words, words[1:], words[2:], words[3:], words[4:])]
    else:
        hashes = [digest(b" ".join(words[i : i + shingle]), SEED) for i in range(len(words) - shingle + 1)]
    return np.array(hashes, dtype=np.uint64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text."""
    return majority(shingle_hashes(text, shingle))


def majority(hashes: np.ndarray, step: int = 255 * 256) -> int:
    """The bits that are set in over half of `hashes`. Sums eight one-byte counters at a time, 255 rows before they could overflow."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), step):
        part = hashes[at : at + step]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
        pad = -len(bits) % 255
        if pad:
            bits = np.concatenate([bits, np.zeros((pad, 8), dtype=np.uint64)])
        counts += np.ascontiguousarray(bits.reshape(-1, 255, 8).sum(axis=1)).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(_id, _x, _fp): _x is a hash of the text, _fp the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["_id", "_x", "_fp"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_id"), text_key(text_col).alias("_x"), F.col(text_col).cast("binary").alias("_t"))
    return rows.mapInArrow(run, f"_id {kind}, _x long, _fp long")


# ---- covering masks

def covering_masks(bits: list[int], radius: int = RADIUS, seed: int = 0) -> list[int]:
    """2^(radius+1) - 1 masks over the given bit positions."""
    n = (1 << (radius + 1)) - 1
    order = np.random.default_rng(seed).permutation(len(bits))
    vector = {bits[int(p)]: i % n + 1 for i, p in enumerate(order)}
    return [sum(1 << b for b, m in vector.items() if bin(m & v).count("1") % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component label (smallest index) of each of n nodes, for edges a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            break
    return label


def bucket_roots(fps: np.ndarray, radius: int = RADIUS, seed: int = 1) -> np.ndarray:
    """Component labels of distinct fingerprints that link at `radius` or fewer differing bits."""
    n = len(fps)
    if n <= SMALL:
        a, b = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius, 1))
        return _roots(n, a, b)
    varying = int(np.bitwise_or.reduce(fps ^ fps[0]))
    left, right = [], []
    for mask in covering_masks([i for i in range(64) if varying >> i & 1], radius, seed):
        key = fps & np.uint64(mask)
        order = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.diff(key[order])) + 1
        for part in np.split(order, edges):
            if 1 < len(part) < n:
                left.append(part)
                right.append(part[bucket_roots(fps[part], radius, seed + 1)])
            elif len(part) == n:  # the mask holds no varying bit: compare in blocks
                for at in range(0, n, SMALL):
                    a, b = np.nonzero(np.bitwise_count(fps[at : at + SMALL, None] ^ fps[None, :]) <= radius)
                    left.append(a + at)
                    right.append(b)
    return _roots(n, np.concatenate(left), np.concatenate(right)) if left else np.arange(n)


def _linker(radius: int, max_bucket: int):
    """Sorted (bucket, fp) rows -> (kind, u, v): kind 0 an edge from u to the smallest fingerprint v of its component; 1 a row (bucket u, fp v) of an oversized bucket."""

    def flush(parts: list[np.ndarray]) -> list[np.ndarray]:
        fps = np.unique(np.concatenate(parts))
        if len(fps) < 2:
            return []
        root = bucket_roots(fps.view(np.uint64), radius)
        rows = np.flatnonzero(root != np.arange(len(fps)))
        return [np.stack([np.zeros(len(rows), np.int64), fps[rows], fps[root[rows]]])] if len(rows) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        current, size, over = None, 0, False
        for b in batches:
            if not b.num_rows:
                continue
            bucket, fp = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1])
            ends = np.concatenate([starts[1:], [len(bucket)]])
            out: list[np.ndarray] = []
            # the first group may go on from the last batch, the last one may go on in the next; single rows between them link to nothing
            keep = ends - starts > 1
            keep[0] = keep[-1] = True
            for s, e in zip(starts[keep], ends[keep]):
                if bucket[s] != current:
                    if size > 1 and not over:
                        out += flush(held)
                    held, current, size, over = [], bucket[s], 0, False
                held.append(fp[s:e])
                size += e - s
                over |= size > max_bucket
                if over:
                    rows = np.concatenate(held)
                    out.append(np.stack([np.ones(len(rows), np.int64), np.full(len(rows), current), rows]))
                    held = []
            if out:
                cols = np.concatenate(out, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "u", "v"])
        if size > 1 and not over and (last := flush(held)):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in last[0]], names=["kind", "u", "v"])

    return run


def links(fps: DataFrame, radius: int = RADIUS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Distinct fingerprints (_fp) -> edges (u, v), u > v, that join all fingerprints within the radius of each other. Runs a job per level of masks."""
    rows, found, level = fps.select(F.lit(0).cast("long").alias("_b"), "_fp"), [], 0
    while True:
        masks = covering_masks(list(range(64)), radius, seed=level)
        keys = [F.xxhash64(F.lit(t), "_b", F.col("_fp").bitwiseAND(F.lit(_signed(m)).cast("long"))) for t, m in enumerate(masks)]
        dealt = rows.select(F.explode(F.array(*keys)).alias("_b"), "_fp").repartition("_b").sortWithinPartitions("_b", "_fp")
        out = cut(dealt.mapInArrow(_linker(radius, max_bucket), "kind long, u long, v long"))
        found.append(out.filter("kind = 0").select("u", "v"))
        rest = out.filter("kind = 1")
        if level >= 8 or rest.isEmpty():
            if level >= 8 and not rest.isEmpty():
                raise RuntimeError("a bucket stays over max_bucket after eight levels of masks: raise max_bucket")
            return reduce(DataFrame.unionByName, found).distinct()
        rows, level = rest.select(F.col("u").alias("_b"), F.col("v").alias("_fp")), level + 1


# ---- components

def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) -> (node, root): root is the smallest node of the component. Nodes without edges are left out.

    Alternating large-star and small-star: stars converge in a few rounds; minima
    are combined map-side, and joins on a star's centre can be split by AQE.
    """
    edges = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mins = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        mins = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(mins, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(mins.select("u", F.col("m").alias("v"))).distinct())


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, max_bucket: int = MAX_BUCKET
) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id, component_fp (the component's smallest fingerprint), text_xxhash64."""
    prints = cut(fingerprints(df, id_col, text_col, shingle))
    classes = prints.groupBy("_fp").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    roots = connected_components(links(classes.select("_fp"), radius, max_bucket))
    rooted = classes.join(roots, F.col("_fp") == F.col("node"), "left").select("_fp", "_first", "_rows", F.coalesce("root", "_fp").alias("_root"))
    firsts = rooted.groupBy("_root").agg(F.min("_first").alias("_component"))
    by_fp = rooted.join(firsts, "_root").select("_fp", "_root", "_component", "_rows")
    # a fingerprint of very many rows (empty texts, say) is sent to its rows, not they to it
    by_fp = cut(by_fp)
    hot = by_fp.filter(F.col("_rows") > HOT)
    hot = maybe_broadcast(hot, hot.count())
    joined = prints.join(hot, "_fp").unionByName(prints.join(hot, "_fp", "left_anti").join(by_fp.filter(F.col("_rows") <= HOT), "_fp"))
    return joined.select(
        F.col("_id").alias(id_col),
        F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"),
        F.col("_component").alias("component_id"),
        F.lpad(F.lower(F.hex("_root")), 16, "0").alias("component_fp"),
        F.col("_x").alias("text_xxhash64"),
    )


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component stays (the smallest id; of several texts under that id, one), with all columns unchanged."""
    marks = near_duplicates(df, id_col, text_col, **options).filter(F.col(id_col).eqNullSafe(F.col("component_id")))
    stay = marks.groupBy("component_id", "component_fp").agg(F.min("text_xxhash64").alias("__ls_x"))
    stay = stay.select(id_key(F.col("component_id")).alias("__ls_i"), "__ls_x").distinct()
    tagged = df.withColumns({"__ls_h": text_key(text_col), "__ls_k": id_key(F.col(id_col))})
    kept = tagged.join(stay, F.expr("__ls_k = __ls_i AND __ls_h = __ls_x"), "left_semi")
    return kept.dropDuplicates(["__ls_k", "__ls_h"]).select(*quoted(df.columns))


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))).drop("text_xxhash64")
