"""Cross-entropy difference scores from matched n-gram language models.

A target model (documents that the caller marks, by default those labelled good
and not toxic) and a background model (all documents) share one vocabulary (all
words of the corpus, and one unknown word for those of other texts), the same order
(bigrams interpolated with smoothed unigrams), the same smoothing and exact counts
of every word and every bigram. A document's score is its loss per token under the
target model minus that under the background model: lower is closer to the target.

Counts grow with the corpus, so they are never broadcast or collected. Texts are
read once, in parts of about PART words, which become numbers; parts are
written to the checkpoint folder. Each part sends its distinct words, then its
distinct bigrams, as packed arrays of 64-bit hashes to the pieces of a table that is
dealt by hash (a hot word is one entry a part, however often it occurs). A piece adds
up what all parts counted and answers every part with the counts of its own entries;
a part with all its answers has the exact loss of each step. The number of pieces
grows with the corpus; only the three totals of the word counts reach the driver.

Defined results: words are runs of letters and digits, lower-cased; a text without
words (or null) has n_tokens 0, losses 0 and score 0; without target documents the
target model knows only its smoothing; a document is target once, however often it
is marked; very long texts are counted whole; there are no ties, as nothing is chosen;
repeated rows are each counted and returned; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..partitions import spread
from . import textarrays as ta
from .common import cut, maybe_broadcast, quoted

BIGRAM_WEIGHT, ADD = 0.6, 0.1
#: Words that a part holds before it is written, or a little more.
PART = 1_000_000
#: Steps (words and ends of texts) of the corpus for each piece of the count table.
PIECE = 1_000_000
#: Hash of the boundary before and after a text.
EDGE = np.uint64(0x5BD1E995C2B2AE35)
WORDS, BIGRAMS = 1, 2
NAMES = ("n_tokens", "loss_target", "loss_background", "score")


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and 64-bit word hash of every word, in order."""
    lowered = [(t or "").lower() for t in texts]
    cps, starts = ta.codepoints(lowered)
    kind = ta.classes()[cps]
    inside = ta.wordlike(kind) | (kind == ta.DIGIT)
    at, hashes = ta.words(cps, inside)
    return np.searchsorted(starts, at, side="right") - 1, hashes.view(np.int64)


def bigrams(doc: np.ndarray, ids: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, context id, word id) of every step, with a boundary (id `edge`) before each text's first word and after its last."""
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    total = len(ids) + len(first)
    place = np.arange(len(ids)) + np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
    word, context, text = np.full(total, edge, np.int64), np.full(total, edge, np.int64), np.empty(total, np.int64)
    word[place] = ids
    text[place] = doc
    ends = np.append(place[first][1:] - 1, total - 1) if len(first) else np.empty(0, int)
    text[ends] = doc[first]
    context[1:] = word[:-1]
    context[place[first]] = edge
    return text, context, word


@dataclass
class Part:
    """Texts as numbers: the part's distinct word hashes (most frequent first, the boundary last), word numbers text by text, words and target mark of each text."""

    hashes: np.ndarray
    ids: np.ndarray
    lengths: np.ndarray
    marks: np.ndarray

    @staticmethod
    def of(hashes: np.ndarray, lengths: np.ndarray, marks: np.ndarray) -> Part:
        unique, ids, n = np.unique(hashes.view(np.uint64), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(unique), np.uint32)
        rank[order] = np.arange(len(unique), dtype=np.uint32)
        return Part(np.append(unique[order], EDGE), rank[ids], lengths.astype(np.int32), marks)

    def state(self) -> list[bytes]:
        """The fields as bytes; of the numbers, which are mostly small, first all low bytes, then all second ones and so on, compressed."""
        planes = zlib.compress(np.ascontiguousarray(self.ids.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)
        return [self.hashes.tobytes(), planes, self.lengths.tobytes(), self.marks.tobytes()]

    @staticmethod
    def read(hashes: bytes, ids: bytes, lengths: bytes, marks: bytes) -> Part:
        planes = np.frombuffer(zlib.decompress(ids), np.uint8).reshape(4, -1)
        return Part(np.frombuffer(hashes, np.uint64), np.ascontiguousarray(planes.T).view(np.uint32).ravel(), np.frombuffer(lengths, np.int32), np.frombuffer(marks, bool))

    def steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return bigrams(np.repeat(np.arange(len(self.lengths)), self.lengths), self.ids, len(self.hashes) - 1)

    def entries(self, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text and entry of every step; key, context id and word id of every entry): WORDS or distinct BIGRAMS."""
        text, context, word = self.steps()
        if kind == WORDS:
            return text, word, self.hashes, np.empty(0, int), np.empty(0, int)
        unique, entry = np.unique(context * len(self.hashes) + word, return_inverse=True)
        context, word = np.divmod(unique, len(self.hashes))
        keys = ta.mix(ta.mix(self.hashes[context]) + self.hashes[word] * np.uint64(0x9E3779B97F4A7C15))
        return text, entry, keys, context, word


def _dealt(keys: np.ndarray, pieces: int) -> Iterator[tuple[int, np.ndarray]]:
    """(piece, places of its keys)."""
    piece = (ta.mix(keys) >> np.uint64(1)).astype(np.int64) % pieces
    order = np.argsort(piece, kind="stable")
    starts = np.flatnonzero(np.diff(piece[order], prepend=-1))
    for places in np.split(order, starts[1:]) if len(order) else ():
        yield int(piece[places[0]]), places


def packed(counts: np.ndarray) -> bytes:
    """Counts as a byte each; those of 255 and over follow in full, in 4 bytes or, where any needs them, 8."""
    large = counts[counts >= 255]
    wide = np.uint64 if len(large) and large.max() >= 1 << 32 else np.uint32
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + large.astype(wide).tobytes()


def unpacked(data: bytes, size: int) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, size).astype(np.int64)
    large = counts == 255
    if n := int(large.sum()):
        counts[large] = np.frombuffer(data[size:], np.uint64 if len(data) - size == 8 * n else np.uint32)
    return counts


PARTS = "c long, steps long, hashes binary, ids binary, lengths binary, marks binary, kept binary"
REQUESTS = "p int, c long, keys binary, n binary, t binary"
ANSWERS = "kind int, c long, p int, n binary, t binary"


def _rows(rows: list[tuple], ddl: str) -> dict[str, pa.Array]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in ddl.split(", ")]
    return {name: pa.array([r[k] for r in rows], kinds[kind]) for k, (name, kind) in enumerate(fields)}


def _parts(marked: DataFrame, kept: list[str]) -> DataFrame:
    """Texts (`text`, `target`, then the columns to give back, by position) as numbers, part by part, written once."""

    def written(number: int, held: list[tuple]) -> pa.RecordBatch:
        part, sink = Part.of(*[np.concatenate(x) for x in list(zip(*held))[:3]]), pa.BufferOutputStream()
        if kept:
            with pa.ipc.new_stream(sink, held[0][3].schema) as writer:
                for *_, rest in held:
                    writer.write_batch(rest)
        steps = len(part.ids) + int((part.lengths > 0).sum())
        return pa.RecordBatch.from_pydict(_rows([(number, steps, *part.state(), sink.getvalue().to_pybytes())], PARTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            texts, marks = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in ta.parts(texts):
                doc, hashes = tokens(texts[a:b])
                rest = pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns[2:]], names=kept) if kept else None
                held.append((hashes, np.bincount(doc, minlength=b - a), marks[a:b], rest))
                size += len(hashes)
                if size >= PART:
                    yield written(number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield written(number, held)

    return cut(marked.toDF(*[f"__ls_{k}" for k in range(len(marked.columns))]).mapInArrow(run, PARTS))


def _requests(parts: DataFrame, kind: int, pieces: int, count: bool, ask: bool) -> DataFrame:
    """Each part's entries by piece of the table: with their counts (`count`), and with the part's number to be answered (`ask`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                part, out = Part.read(r["hashes"], r["ids"], r["lengths"], r["marks"]), []
                text, entry, keys, *_ = part.entries(kind)
                n = np.bincount(entry, minlength=len(keys)).astype(np.int64)
                t = np.bincount(entry[part.marks[text]], minlength=len(keys)).astype(np.int64)
                for p, at in _dealt(keys, pieces):
                    counts = (packed(n[at]), packed(t[at])) if count else (None, None)
                    out.append((p, r["c"] if ask else None, keys[at].tobytes(), *counts))
                if out:
                    yield pa.RecordBatch.from_pydict(_rows(out, REQUESTS))

    return parts.select("c", "hashes", "ids", "lengths", "marks").mapInArrow(run, REQUESTS)


def _answers(requests: DataFrame, kind: int) -> DataFrame:
    """The counts over all parts of the entries of each request; for words also a row without a part: their number and the sums of their counts."""

    def run(table: pa.Table) -> pa.Table:
        part, piece = table["c"].to_pylist(), table["p"][0].as_py()
        keys = [np.frombuffer(k, np.uint64) for k in table["keys"].to_pylist()]
        unique, place = np.unique(np.concatenate(keys), return_inverse=True)
        sums = []
        for name in ("n", "t"):
            counts = [unpacked(x, len(k)) if x is not None else np.zeros(len(k), np.int64) for x, k in zip(table[name].to_pylist(), keys)]
            sums.append(np.bincount(place, weights=np.concatenate(counts), minlength=len(unique)).astype(np.int64))
        n, t = sums
        out, a = [], 0
        for c, k in zip(part, keys):
            if c is not None:
                at = place[a : a + len(k)]
                out.append((kind, c, piece, packed(n[at]), packed(t[at])))
            a += len(k)
        if kind == WORDS:
            types = int(((n > 0) & (unique != EDGE)).sum())
            out.append((kind, None, types, packed(n.sum(keepdims=True)), packed(t.sum(keepdims=True))))
        return pa.Table.from_pydict(_rows(out, ANSWERS))

    return requests.groupBy("p").applyInArrow(run, ANSWERS)


@dataclass
class Model:
    """The parts of the texts that are counted."""

    parts: DataFrame


def train(marked: DataFrame) -> Model:
    """Read `marked` (text, target boolean). Its words and bigrams are counted when texts are scored."""
    return Model(_parts(marked.select("text", "target"), []))


def _scored(asked: DataFrame, counted: DataFrame, schema: StructType) -> DataFrame:
    """The rows of the parts `asked` under the models of the parts `counted`. Runs a job over the words; bigrams are counted with the result."""
    steps = (asked if asked is counted else asked.unionByName(counted)).agg(F.sum("steps")).first()[0] or 0
    pieces = max(asked.sparkSession.sparkContext.defaultParallelism, -(-steps // PIECE))

    def answers(kind: int) -> DataFrame:
        if asked is counted:
            return _answers(_requests(asked, kind, pieces, True, True), kind)
        return _answers(_requests(counted, kind, pieces, True, False).unionByName(_requests(asked, kind, pieces, False, True)), kind)

    words = cut(answers(WORDS))
    sums = [(r["p"], int(unpacked(r["n"], 1)[0]), int(unpacked(r["t"], 1)[0])) for r in words.filter("c IS NULL").select("p", "n", "t").collect()]
    types, background, target = (sum(s[k] for s in sums) for k in range(3))
    kept = [f.name for f in schema.fields]

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        state = next(r for r in rows if r["kind"] == 0)
        part = Part.read(state["hashes"], state["ids"], state["lengths"], state["marks"])
        text, entry, keys, context, word = part.entries(BIGRAMS)
        counts = {WORDS: np.zeros((2, len(part.hashes))), BIGRAMS: np.zeros((2, len(keys)))}
        for kind, own in ((WORDS, part.hashes), (BIGRAMS, keys)):
            answered = {r["p"]: r for r in rows if r["kind"] == kind}
            for p, at in _dealt(own, pieces):
                counts[kind][:, at] = unpacked(answered[p]["t"], len(at)), unpacked(answered[p]["n"], len(at))
        loss = np.zeros((2, len(part.lengths)))
        for k, total in enumerate((target, background)):
            single = (counts[WORDS][k] + ADD) / (total + ADD * (types + 2))
            seen = counts[WORDS][k][context]
            # an unseen context leaves all of its weight to the unigrams
            weight = np.where(seen > 0, BIGRAM_WEIGHT, 0.0)
            each = -np.log(weight * (counts[BIGRAMS][k] / np.maximum(seen, 1)) + (1 - weight) * single[word])
            loss[k] = np.bincount(text, weights=each[entry], minlength=len(part.lengths))
        loss /= part.lengths + 1.0
        out = pa.ipc.open_stream(state["kept"]).read_all() if kept else None
        columns = list(out.columns) if kept else []
        columns += [pa.array(x) for x in (part.lengths.astype(np.int64), loss[0], loss[1], loss[0] - loss[1])]
        return pa.Table.from_arrays(columns, names=[*kept, *NAMES])

    made = StructType([*schema.fields, StructField(NAMES[0], LongType()), *[StructField(n, DoubleType()) for n in NAMES[1:]]])
    rows = asked.withColumn("kind", F.lit(0)).unionByName(words.filter("c IS NOT NULL").unionByName(answers(BIGRAMS)), allowMissingColumns=True)
    return rows.drop("steps").groupBy("c").applyInArrow(run, made)


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`df` with n_tokens, loss_target, loss_background and score in place of columns of those names."""
    kept = [c for c in df.columns if c not in NAMES]
    parts = _parts(df.select(F.col(text_col).cast("string"), F.lit(False), *quoted(kept)), kept)
    return _scored(parts, model.parts, df.select(*quoted(kept)).schema)


def mark_targets(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, target, id): whether the document's id is in `targets` (id). Counts the targets (one job) to choose the join."""
    ids = targets.select(F.col(id_col).alias("_i"), F.lit(True).alias("_m")).filter("_i IS NOT NULL").distinct()
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(maybe_broadcast(ids, ids.count()), F.col("_id") == F.col("_i"), "left")
    return joined.select("text", F.coalesce("_m", F.lit(False)).alias("target"), F.col("_id").alias(id_col))


def op4_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1 AND toxic = 0").select("doc_id")
    parts = _parts(mark_targets(docs, good), ["doc_id"])
    return _scored(parts, parts, docs.select("doc_id").schema)
