"""SimHash near-duplicates by similarity: covering LSH, parts for what it cannot reach, exact Jaccard.

This form of the operator links texts whose sets of `shingle`-word shingles have a
Jaccard similarity of `similarity` or more. Its steps are those of `simhash`, with a radius
for similarity: texts of similarity 0.8 differ in some 10 of 64 bits, not in 3.

Fingerprints: the 64-bit SimHash of a text's shingles, repeats included. Texts of equal
shingle sets are copies; one of each group is searched for.

Covering LSH: the 64 bits are cut into BLOCKS blocks whose radii and BLOCKS - 1 add up to
RADIUS; of two fingerprints within RADIUS one block differs in no more than its radius, and
covering masks over its bits (as in `simhash`) have a table in which the pair meets, with
certainty. A table's key holds the masked bits and a class of sizes: a set is dealt in its
own class and, if one up to 1 / s times as large falls into the next, in that one too.

Parts: pairs at the similarity may still differ in more than RADIUS bits. For these, a set's
shingles are dealt into parts by their hashes, more parts for larger sets, so that a part
holds three or four. Texts meet in a table if a part's SimHash is equal. Two texts that
differ in fewer shingles than there are parts share a whole part; a pair within the
similarity differs in at most (1 - s) / s of the smaller set, so with more parts than that it
meets with certainty. Sets of up to about 48 shingles (at 0.8) have all their parts kept; of
larger ones PARTS are kept, those that hold two shingles at least, and a pair at 0.8 meets
with a probability of 0.99, a closer one all but surely. Sizes fall into classes a factor
1 / s apart, and each text is dealt as one of its class and as one of the next. These tables
give the pairs of more than RADIUS and up to LOOSE bits (LOOSE_SMALL for sets of SMALL).

Pairs: a table's rows are sorted by size and each is compared with those up to 1 / s times
as large. Every pair within the radius is a candidate, in the first table in which it meets.
A bucket gives its pairs or, if those are more than the rows that they are of, these rows:
never more than it has. To the rows their parities are joined, which tell most pairs apart
that cannot be similar. A minimum spanning tree over the parities' distances of each `block`
of a bucket's rows, at no distance within a component found so far, gives pairs to check;
where a bucket has over `block` rows, a second tree joins one row of each component. Then all
its pairs that no component holds yet are candidates, a large bucket's in cells of two groups
of CELL rows, but for those whose parities differ in more bins than similar sets may. So no
pair goes unchecked unless its two texts are linked already or cannot be similar.

Check: a pair counts if the Jaccard similarity of its two sets, compared whole, is
`similarity` or more. Components come from those pairs.

Defined results: null and blank texts have no shingle and are similar to each other
only; texts of fewer than `shingle` words have one shingle, all their words; words are
compared with A-Z lower-cased; very long texts are hashed whole, in one row of their
own; rows that repeat an id are compared like others, of rows that repeat id and text one
stays; of a component the smallest id stays, of equal ids the text with the smallest hash;
a null id stays only where no other does; an empty table gives an empty table; other
columns are passed through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_key, maybe_broadcast, text_key, without
from .simhash import _signed, connected_components, covering_masks, majority, shingle_hashes
from .textarrays import mix

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 13, 3
PARTS, LOOSE, LOOSE_SMALL, SMALL = 12, 20, 24, 48
DENSE, BLOCK, CELL, SALTS, PARITY = 4, 4096, 16_384, 16, 512
#: Bits of a table key: the masked bits of a block, and the class of sizes.
KEY_BITS, CLASS_BITS = 22, 6
#: Rows that are compared at once, if the bucket that they end in does not go on.
ROWS = 100_000


def tables(radius: int = RADIUS, blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """(first bit of its block, mask over all 64 bits) of each table: fingerprints within the radius are equal under one mask."""
    edges, out = [64 * k // blocks for k in range(blocks + 1)], []
    for k, (low, high) in enumerate(zip(edges, edges[1:])):
        share = (radius + 1) // blocks + (k >= blocks - (radius + 1) % blocks)  # the shares of radius + 1 are the blocks' radii + 1
        if share:
            out += [(low, m) for m in covering_masks(list(range(low, high)), share - 1, seed=k)]
    return out


def size_classes(size: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """The class of each set size (a factor s^-4 wide), and that of the largest set that it can be similar to: the same or the next."""
    last = (1 << CLASS_BITS) - 1
    edges = similarity ** (-4.0 * np.arange(1, last + 1))
    return np.searchsorted(edges, size, side="right"), np.searchsorted(edges, size / similarity + 1e-6, side="right")


def part_keys(hashes: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Table keys of a set of distinct shingle hashes: a hash of (size class, part, number of shingles, SimHash of the part)."""
    if not len(hashes):
        return np.zeros(1, np.uint64)
    mixed, keys = mix(hashes), []
    own = int(np.floor(np.log(len(hashes)) / -np.log(similarity) + 1e-9))
    for size_class in (own, own + 1):
        parts = int((1 - similarity) / similarity * similarity ** -(size_class + 1.0)) + 1
        part = (mixed % np.uint64(parts)).astype(np.int64)
        some = np.flatnonzero(part < PARTS)
        some = some[np.argsort(part[some], kind="stable")]
        starts = np.flatnonzero(np.diff(part[some], prepend=-1))
        if not len(starts):
            continue
        n = np.diff(np.append(starts, len(some)))
        bits = np.unpackbits(hashes[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        prints = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
        place = np.uint64(size_class << 16) + part[some[starts]].astype(np.uint64) * np.uint64(1 << 32) + n.astype(np.uint64)
        keys.append(mix(mix(place) ^ prints)[(n > 1) | (parts <= PARTS)])
    return np.unique(np.concatenate(keys)) if keys else np.empty(0, np.uint64)


def parity(distinct: np.ndarray) -> bytes:
    """Of PARITY bins of a set's hashes, whether each holds an odd number. Two sets differ in at least as many hashes as bins."""
    return np.packbits((np.bincount((mix(distinct) >> np.uint64(40)) % np.uint64(PARITY), minlength=PARITY) & 1).astype(bool)).tobytes()


def _sketches(df: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """(n, id, x, fp, size, s1, s2, keys, classes, parity): a number for each row, the text's hash, its SimHash, its shingle set's size and digest, its table keys, size classes and parities."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, keys, parities = np.zeros(b.num_rows, np.uint64), [], []
            size, digests = np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, 2), np.int64)
            for r, t in enumerate(b.column(2)):
                hashes = shingle_hashes(t.as_py(), shingle)
                prints[r] = majority(hashes)
                distinct = np.unique(hashes)
                size[r], digests[r] = len(distinct), np.frombuffer(xxhash.xxh3_128_digest(distinct.tobytes()), np.int64)
                keys.append(part_keys(distinct, similarity).view(np.int64))
                parities.append(parity(distinct))
            own, top = size_classes(size, similarity)
            of_sizes = [list(range(c, d + 1)) if z else [] for z, c, d in zip(size.tolist(), own.tolist(), top.tolist())]
            offsets = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
            columns = [b.column(0), b.column(1), prints.view(np.int64), size, digests[:, 0], digests[:, 1], lists, pa.array(of_sizes, pa.list_(pa.int64())), pa.array(parities, pa.binary())]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["id", "x", "fp", "size", "s1", "s2", "keys", "classes", "parity"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), text_key(text_col).alias("x"), F.col(text_col).cast("binary").alias("t"))
    made = rows.mapInArrow(run, f"id {kind}, x long, fp long, size long, s1 long, s2 long, keys array<long>, classes array<long>, parity binary")
    return cut(made.select(F.monotonically_increasing_id().alias("n"), "*"))


def spanning_tree(fps: np.ndarray, root: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(child, parent, distance) of a minimum spanning tree over Hamming distances, from the first row (Prim). Rows of one root have none."""
    n = len(fps)

    def distances(j: int) -> np.ndarray:
        d = np.bitwise_count(fps ^ fps[j])
        d = d.sum(axis=1, dtype=np.int16) if fps.ndim > 1 else d.astype(np.int16)
        return d if root is None else np.where(root == root[j], np.int16(0), d)

    near, parent = distances(0), np.zeros(n, np.int64)
    near[0] = 999
    child, up, far = np.empty(n - 1, np.int64), np.empty(n - 1, np.int64), np.empty(n - 1, np.int16)
    for k in range(n - 1):
        j = int(near.argmin())
        child[k], up[k], far[k] = j, parent[j], near[j]
        near[j] = 999
        d = distances(j)
        closer = (d < near) & (near < 999)
        near[closer] = d[closer]
        parent[closer] = j
    return child, up, far


def _linker(block: int, step: str, similarity: float):
    """Rows (b, n, fp, size, root, cell, parity after the first step) sorted by (b, cell, size, fp) -> (kind, u, v, w, z): kind 0 a pair u > v; 1 a row (b, n, fp, size) of a dense bucket.

    `step`: "first" gives all pairs of a bucket, or the rows that they are of if these are
    fewer; "trees" a tree over all rows; "roots" one over one row of each root; "all" the
    pairs of different roots.
    """
    masks = np.array([m for _, m in tables()], np.uint64)

    def firsts(b: np.ndarray, size: np.ndarray, fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether this bucket is the first in which rows i and j meet; always, for parts."""
        at = b[i]
        own = size_classes(size[j], similarity)[0] == at >> KEY_BITS & (1 << CLASS_BITS) - 1
        table = at >> KEY_BITS + CLASS_BITS
        first = (((fp[i] ^ fp[j])[:, None] & masks) == 0).argmax(axis=1)
        return (at < 0) | own & (first == table)

    def batch(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "u", "v", "w", "z"])

    def pairs(n: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        none = np.zeros(len(i), np.int64)
        return batch(none, np.maximum(n[i], n[j]), np.minimum(n[i], n[j]), none, none)

    def compare(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        b, n, fp, size, root, cell, *odd = columns
        fp = fp.view(np.uint64)
        group = np.cumsum((np.diff(b, prepend=b[0]) != 0) | (np.diff(cell, prepend=cell[0]) != 0))
        least = np.where(b < 0, RADIUS + 1, 0)
        most = np.where(b >= 0, RADIUS, np.where(size <= SMALL, LOOSE_SMALL, LOOSE))

        def like(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Whether rows i and j may be similar: sets at the similarity differ in at most (1 - s) / (1 + s) of both sizes."""
            differ = np.bitwise_count(odd[0][i] ^ odd[0][j]).sum(axis=1)
            return differ <= (1 - similarity) / (1 + similarity) * (size[i] + size[j]) + 1e-6

        def trees(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Of spanning trees of the given rows, block by block, the edges of different roots that may be similar, but for those that meet elsewhere first: there they were given, or edges as short join them."""
            for part in np.split(rows, np.flatnonzero(np.diff(group[rows])) + 1):
                for at in range(0, len(part), block):
                    some = part[at : at + block]
                    if len(some) > 1:
                        child, up, _ = spanning_tree(odd[0][some], root[some])
                        i, j = some[np.minimum(child, up)], some[np.maximum(child, up)]
                        new = (root[i] != root[j]) & (size[i] >= similarity * size[j] - 1e-6) & like(i, j)
                        i, j = i[new], j[new]
                        if len(i):
                            new = (np.bitwise_count(fp[i] ^ fp[j]) > RADIUS) | (b[i] >= 0) & firsts(b, size, fp, i, j)
                            yield pairs(n, i[new], j[new])

        if step == "trees":
            yield from trees(np.arange(len(b)))
            return
        if step == "roots":
            order = np.lexsort((fp, root, group))
            order = order[(np.diff(group[order], prepend=-1) != 0) | (np.diff(root[order], prepend=root[order[0]]) != 0)]
            yield from trees(np.sort(order))
            return
        limit, seen = DENSE * np.bincount(group), np.zeros(group[-1] + 1, np.int64)
        touched, found, held = np.zeros(len(b), bool), [], 0
        i, k = np.arange(len(b) - 1), 1
        while len(i):
            i = i[: np.searchsorted(i, len(b) - k)]
            j = i + k
            i = i[(group[j] == group[i]) & (size[i] >= similarity * size[j] - 1e-6)]  # sizes ascend: what fails here fails at larger k
            d = np.bitwise_count(fp[i] ^ fp[i + k])
            near = i[(d <= most[i]) & (d >= least[i]) & (root[i] != root[i + k])]
            if len(near) and odd:
                near = near[like(near, near + k)]
            if len(near):
                near = near[firsts(b, size, fp, near, near + k)]
            if len(near) and step == "first":
                seen += np.bincount(group[near], minlength=len(seen))
                touched[near] = touched[near + k] = True
                near = near[seen[group[near]] <= limit[group[near]]]
            if len(near):
                found.append((near, near + k))
                held += len(near)
                if step == "all" and held >= ROWS:
                    yield pairs(n, *(np.concatenate(x) for x in zip(*found)))
                    found, held = [], 0
            k += 1
        if step == "first":  # a bucket gives its pairs or the rows that they are of, whichever are fewer
            limit = np.minimum(limit, np.bincount(group[touched], minlength=len(limit)))
        if found:
            x, y = (np.concatenate(z) for z in zip(*found))
            few = seen[group[x]] <= limit[group[x]]
            yield pairs(n, x[few], y[few])
        dense = np.flatnonzero(touched & (seen > limit)[group]) if step == "first" else []
        if len(dense):
            yield batch(np.ones(len(dense), np.int64), b[dense], n[dense], fp[dense].view(np.int64), size[dense])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows, enough = 0, ROWS
        for part in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in part.columns[:6]])
            for c in part.columns[6:]:
                held[-1].append(np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(part.num_rows, -1))
            rows += part.num_rows
            if rows >= enough:
                columns = [np.concatenate(c) for c in zip(*held)]
                b, cell = columns[0], columns[5]
                ends = np.flatnonzero((np.diff(b) != 0) | (np.diff(cell) != 0))  # the last bucket may go on in the next batch
                at = ends[-1] + 1 if len(ends) else 0
                if at:
                    yield from compare([c[:at] for c in columns])
                held, rows = [[c[at:] for c in columns]], rows - at
                enough = max(ROWS, 2 * rows)
        if rows:
            yield from compare([np.concatenate(c) for c in zip(*held)])

    return run


def table_rows(sketches: DataFrame) -> DataFrame:
    """(b, n, fp, size): each set in all its tables; b is not negative for those of the fingerprint, negative for parts."""
    keys = [
        F.shiftleft(F.lit(t << CLASS_BITS).cast("long") + F.col("c"), KEY_BITS) + F.shiftrightunsigned(F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")), low)
        for t, (low, m) in enumerate(tables())
    ]
    sized = sketches.select(F.explode("classes").alias("c"), "n", "fp", "size")
    prints = sized.select(F.explode(F.array(*keys)).alias("b"), "n", "fp", "size")
    parts = sketches.filter("size > 0").select(F.explode("keys").alias("b"), "n", "fp", "size")
    return prints.unionByName(parts.withColumn("b", F.col("b").bitwiseOR(F.lit(-(1 << 63)).cast("long"))))


def _linked(rows: DataFrame, block: int, step: str, similarity: float) -> DataFrame:
    parities = [] if step == "first" else ["parity"]
    kept = rows.sortWithinPartitions("b", "cell", "size", "fp").select("b", "n", "fp", "size", "root", "cell", *parities)
    return cut(kept.mapInArrow(_linker(block, step, similarity), "kind long, u long, v long, w long, z long"))


def candidate_pairs(sketches: DataFrame, similarity: float, check: Callable[[DataFrame], DataFrame], block: int = BLOCK) -> DataFrame:
    """Pairs (u, v) of row numbers that meet in a table and pass `check`; of pairs in dense buckets, as many as join all that pass. Runs jobs."""
    rows = table_rows(sketches).repartition("b").select("*", F.col("n").alias("root"), F.lit(0).cast("long").alias("cell"))
    out = _linked(rows, block, "first", similarity)
    found = [check(out.filter("kind = 0").select("u", "v").distinct())]
    rest = out.filter("kind = 1").select(F.col("u").alias("b"), F.col("v").alias("n"), F.col("w").alias("fp"), F.col("z").alias("size"))
    some = not rest.isEmpty()
    if some:
        rest = cut(rest.join(sketches.select("n", "parity"), "n"))
    for step in ("trees", "roots", "all") if some else ():
        roots = connected_components(reduce(DataFrame.unionByName, found)).toDF("n", "root")
        rows = cut(rest.join(roots, "n", "left").withColumn("root", F.coalesce("root", "n")))
        split = rows.groupBy("b").agg(F.count(F.lit(1)).alias("rows"), F.min("root").alias("low"), F.max("root").alias("high"))
        split = cut(split.filter("low <> high").select("b", F.ceil(F.col("rows") / F.lit(CELL if step == "all" else block)).alias("g")))
        if step == "roots" and split.filter("g > 1").isEmpty():
            continue
        rows = rows.join(maybe_broadcast(split, split.count()), "b").withColumn("own", F.pmod(F.xxhash64("n"), F.col("g")))
        if step == "trees":
            rows = rows.withColumn("cell", F.col("own"))
        elif step == "roots":
            rows = rows.withColumn("cell", F.lit(0).cast("long"))
        else:  # every two of a bucket's g groups meet in a cell
            rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)).alias("other"))
            rows = rows.withColumn("cell", F.least("own", "other") * F.col("g") + F.greatest("own", "other"))
        out = _linked(rows.repartition("b", "cell"), block, step, similarity)
        found.append(check(out.filter("kind = 0").select("u", "v").distinct()))
    return reduce(DataFrame.unionByName, found)


def similar_pairs(df: DataFrame, sketches: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """Pairs (u, v) of row numbers that join all similar texts: copies with one of their group, candidates whose shingle sets are similar enough."""
    same = sketches.groupBy("s1", "s2", "size").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("fp", "n")).alias("w"))
    same = cut(same.filter("rows > 1").select("s1", "s2", "size", F.col("w.n").alias("v")))
    copies = sketches.join(maybe_broadcast(same, same.count()), ["s1", "s2", "size"]).filter("n <> v").select(F.col("n").alias("u"), "v")
    copies = cut(copies)
    firsts = sketches.join(maybe_broadcast(copies.select(F.col("u").alias("n")), copies.count()), "n", "left_anti")
    texts = df.select(id_key(F.col(id_col)).alias("k"), text_key(text_col).alias("x"), F.col(text_col).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)).view(np.int64) for t in b.column(2)]
            offsets = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["k", "x", "s"])

    def check(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs)
        asked = pairs.select(F.explode(F.array("u", "v")).alias("n")).distinct()
        wanted = cut(sketches.select("n", id_key(F.col("id")).alias("k"), "x").join(asked, "n"))
        keys = wanted.select("k", "x").distinct()
        found = texts.join(maybe_broadcast(keys, wanted.count()), ["k", "x"], "left_semi")
        sets = found.mapInArrow(run, "k string, x long, s array<long>").dropDuplicates(["k", "x"]).join(wanted, ["k", "x"]).select("n", "s")
        sets = cut(sets)
        both = pairs.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v")
        common = F.size(F.array_intersect("a", "b"))
        return cut(both.filter(common >= similarity * (F.size("a") + F.size("b") - common)).select("u", "v"))

    return copies.unionByName(candidate_pairs(firsts, similarity, check))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each component of similar texts stays, with all columns unchanged.

    What goes is found by (id, hash of the text). Texts are not shuffled while that list,
    which is counted, can be broadcast; a longer one meets them in a join by that key.
    """
    sketches = _sketches(df, id_col, text_col, shingle, similarity)
    roots = connected_components(similar_pairs(df, sketches, id_col, text_col, shingle, similarity))
    members = sketches.select("n", "id", id_key(F.col("id")).alias("__ls_k"), F.col("x").alias("__ls_x")).join(roots.withColumnRenamed("node", "n"), "n")
    firsts = members.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "__ls_x", "__ls_k")).alias("w"))
    # a large component's members are dealt over SALTS tasks
    salt = F.pmod("n", F.lit(SALTS)).cast("int").alias("s")
    dealt = firsts.select("root", "w", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    marked = cut(
        members.select("*", salt).join(dealt, ["root", "s"])
        .groupBy("__ls_k", "__ls_x")
        .agg(F.max(~((F.col("w.__ls_k") == F.col("__ls_k")) & (F.col("w.__ls_x") == F.col("__ls_x")))).alias("lost"), F.count(F.lit(1)).alias("rows"))
    )
    return without(df, marked, id_key(F.col(id_col)), text_key(text_col))
