"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its features (binned shares of capitals, symbols,
digits, repeated words, ..., and what the lines before and after it look like)
and the step from the line before decide; the length-weighted forward-backward
marginals of "good" are the document's quality.

Only documents carry labels, so training starts with every line labelled as its
document and then, for `rounds` rounds, lets each line of a bad document that the
other documents' evidence calls good be good, as long as the document keeps a bad
line (its worst). It uses at most about `sample_docs` labelled documents (those
with the smallest hash of their id); what is broadcast is a few hundred numbers.

Defined results: null and blank texts have no lines and score `EMPTY_SCORE`; blank
lines are left out; very long texts are scored whole, one at a time; with nothing to
learn from every text scores 0.5; of several
labels of a document the smallest holds (there are no other ties); repeated rows are
each returned; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..partitions import spread
from . import textarrays as ta
from .langid import held_out

SAMPLE_DOCS, ROUNDS, STEPS, TOLERANCE, THRESHOLD, EMPTY_SCORE = 3000, 2, 150, 1e-4, 0.7, 0.0
#: Upper edges of the bins of each feature.
BINS = {
    "words": (1, 2, 4, 8, 16, 40, 120),
    "upper": (0.001, 0.02, 0.08, 0.2, 0.5, 0.9),
    "symbol": (0.001, 0.01, 0.03, 0.08, 0.2, 0.4),
    "mark": (0.005, 0.02, 0.04, 0.08, 0.15, 0.3),
    "digit": (0.001, 0.02, 0.1, 0.3),
    "repeat": (0.001, 0.03, 0.1, 0.3, 0.6),
    "length": (1.5, 3, 4, 5, 6, 8, 12),
}
NAMES = tuple(BINS)
OFFSETS = np.cumsum([0] + [len(b) + 1 for b in BINS.values()])
N_OWN = int(OFFSETS[-1]) + 3  # and: capital first, full stop last, same as the line before


@dataclass
class Lines:
    """The lines with words of some texts: text number, length, own features (indices of ones), in order."""

    doc: np.ndarray
    length: np.ndarray
    own: np.ndarray


def lines(texts: list[str | None]) -> Lines:
    """Features of every line, computed over all characters at once."""
    cps, starts = ta.codepoints(texts)
    kind = ta.classes()[cps]
    newline = np.flatnonzero(cps == 10)
    begin = np.concatenate([[0], newline[:-1] + 1])
    n_lines = len(newline)
    doc = np.searchsorted(starts, begin, side="right") - 1
    size = newline - begin
    per = lambda mask: np.add.reduceat(mask.astype(np.int64), begin)
    space = kind == ta.SPACE
    letters = per(ta.wordlike(kind))
    upper, digit, mark, symbol = (per(kind == k) for k in (ta.UPPER, ta.DIGIT, ta.PUNCT, ta.SYMBOL))
    solid = np.maximum(1, size + 1 - per(space))
    at, hashes = ta.words(cps, ~space)
    line_of = np.searchsorted(begin, at, side="right") - 1
    word_doc = doc[line_of] if len(at) else np.empty(0, int)
    again = np.zeros(len(at), bool)
    for back in (1, 2, 3):
        again[back:] |= (hashes[back:] == hashes[:-back]) & (word_doc[back:] == word_doc[:-back])
    words = np.bincount(line_of, minlength=n_lines) if len(at) else np.zeros(n_lines, int)
    repeats = np.bincount(line_of, weights=again, minlength=n_lines) if len(at) else np.zeros(n_lines)
    some = np.maximum(1, words)
    values = {
        "words": words, "upper": upper / np.maximum(1, letters), "symbol": symbol / solid, "mark": mark / solid,
        "digit": digit / solid, "repeat": repeats / some, "length": solid / some,
    }
    own = np.zeros((n_lines, len(NAMES) + 3), dtype=np.int16)
    for k, name in enumerate(NAMES):
        own[:, k] = OFFSETS[k] + np.searchsorted(BINS[name], values[name], side="left")
    # flags: a feature index, or -1
    first = np.minimum(begin, len(cps) - 1)
    last = np.maximum(newline - 1, begin)
    total = np.zeros(n_lines, dtype=np.uint64)
    if len(at):
        has = words > 0
        heads = np.flatnonzero(np.diff(line_of, prepend=-1))
        total[has] = np.add.reduceat(hashes * (2 * np.arange(len(hashes), dtype=np.uint64) + 1 - 2 * np.repeat(heads, np.diff(np.append(heads, len(at)))).astype(np.uint64)), heads)
    keep = words > 0
    doc, total_ = doc[keep], total[keep]
    same = np.zeros(len(doc), bool)
    same[1:] = (total_[1:] == total_[:-1]) & (doc[1:] == doc[:-1])
    own = own[keep]
    base = int(OFFSETS[-1])
    own[:, -3] = np.where(kind[first[keep]] == ta.UPPER, base, -1)
    own[:, -2] = np.where(np.isin(cps[last[keep]], (46, 33, 63)), base + 1, -1)
    own[:, -1] = np.where(same, base + 2, -1)
    return Lines(doc, size[keep], own)


def potentials(x: Lines, unary: np.ndarray) -> np.ndarray:
    """Score of "good" of each line: its own features and those of its neighbours. unary: 3 * N_OWN weights and a bias."""
    own, n = x.own, len(x.doc)
    out = np.full(n, unary[-1])
    padded = np.zeros((3, N_OWN + 1))
    padded[:, :N_OWN] = unary[:-1].reshape(3, N_OWN)  # column -1: absent features weigh nothing
    own_sum, before, after = (padded[k][own].sum(axis=1) for k in range(3))
    out += own_sum
    joined = np.flatnonzero(x.doc[1:] == x.doc[:-1])
    out[joined + 1] += before[joined]
    out[joined] += after[joined + 1]
    return out


def _grid(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with lines by falling number of lines: their first line and that number."""
    start = np.flatnonzero(np.diff(doc, prepend=-1))
    count = np.diff(np.append(start, len(doc)))
    order = np.argsort(-count, kind="stable")
    return start[order], count[order]


def marginals(x: Lines, score: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line, the expected 2x2 steps and the summed log partition functions, all texts in step."""
    start, count = _grid(x.doc)
    n = len(score)
    fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
    emit = np.stack([np.zeros(n), score], axis=1)
    longest = int(count[0]) if len(count) else 0
    active = [int(np.searchsorted(-count, -t, side="left")) for t in range(longest + 1)]  # texts of more than t lines
    fwd[start] = emit[start]
    for t in range(1, longest):
        i = start[: active[t]] + t
        a = fwd[i - 1][:, :, None] + pair[None]
        fwd[i] = np.logaddexp(a[:, 0], a[:, 1]) + emit[i]
    for t in range(longest - 2, -1, -1):
        i = start[: active[t + 1]] + t
        b = pair[None] + (emit[i + 1] + bwd[i + 1])[:, None, :]
        bwd[i] = np.logaddexp(b[:, :, 0], b[:, :, 1])
    both = fwd + bwd
    z = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - z)
    joined = np.flatnonzero(x.doc[1:] == x.doc[:-1])
    steps = np.exp(fwd[joined][:, :, None] + pair[None] + (emit[joined + 1] + bwd[joined + 1])[:, None, :] - z[joined][:, None, None])
    return good, steps.sum(axis=0), float(z[start].sum())


@dataclass
class Model:
    unary: np.ndarray
    pair: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Quality of each text."""
        out = np.full(len(texts), EMPTY_SCORE)
        for a, b in ta.parts(texts):
            x = lines(texts[a:b])
            if not len(x.doc):
                continue
            good, _, _ = marginals(x, potentials(x, self.unary), self.pair)
            weight = np.bincount(x.doc, weights=x.length, minlength=b - a)
            total = np.bincount(x.doc, weights=x.length * good, minlength=b - a)
            out[a:b] = np.where(weight > 0, total / np.maximum(weight, 1), EMPTY_SCORE)
        return np.clip(out, 0.0, 1.0)


def _counts(x: Lines, y: np.ndarray) -> np.ndarray:
    """Feature counts weighted by y, in the layout of the unary weights."""
    out = np.zeros((3, N_OWN + 1))
    joined = np.flatnonzero(x.doc[1:] == x.doc[:-1])
    width = x.own.shape[1]
    for k, (rows, weight) in enumerate(((slice(None), y), (joined, y[joined + 1]), (joined + 1, y[joined]))):
        at = x.own[rows].astype(np.int64).ravel()
        out[k] = np.bincount(np.where(at < 0, N_OWN, at), weights=np.repeat(weight, width), minlength=N_OWN + 1)
    return np.append(out[:, :N_OWN].ravel(), y.sum())


def fit(x: Lines, quality: np.ndarray, rounds: int = ROUNDS, steps: int = STEPS, penalty: float = 2.0) -> Model:
    """Maximum likelihood with an L2 penalty (Adam on the whole sample, until the gradient is below TOLERANCE). quality: of each text number."""
    doc_good = quality[x.doc] == 1
    y = doc_good.astype(float)
    theta = np.zeros(3 * N_OWN + 1 + 4)
    n = max(1, len(y))
    joined = np.flatnonzero(x.doc[1:] == x.doc[:-1])
    for r in range(rounds + 1):
        if r:
            # how good each line looks by itself, with its neighbours' features but not their labels
            alone = potentials(x, theta[:-4])
            worst = np.full(len(quality), np.inf)
            np.minimum.at(worst, x.doc, alone)
            y = np.where(doc_good, 1.0, ((alone > 2.0) & (alone > worst[x.doc])).astype(float))
        want = _counts(x, y)
        a, b = y[joined].astype(int), y[joined + 1].astype(int)
        want_pair = np.bincount(2 * a + b, minlength=4).reshape(2, 2).astype(float)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            good, pairs, _ = marginals(x, potentials(x, theta[:-4]), theta[-4:].reshape(2, 2))
            grad = np.concatenate([_counts(x, good) - want, (pairs - want_pair).ravel()]) / n + penalty * theta / n
            if np.abs(grad).max() < TOLERANCE:
                break
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(theta[:-4], theta[-4:].reshape(2, 2))


def train(labelled: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on at most `sample_docs` documents. `labelled` holds (id, label). Runs three jobs: a count, the ids, then their texts (a bounded broadcast)."""
    ids = labelled.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_y"))
    ids = ids.withColumn("_o", F.pmod(F.xxhash64("_id"), F.lit(1 << 30)))
    share = min(1.0, 1.5 * sample_docs / max(1, ids.count()))  # few more than are taken: little meets in the task that takes the least hashes
    chosen = ids.filter(F.col("_o") < int(share * (1 << 30))).orderBy("_o", "_id").limit(sample_docs).select("_id", "_y")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(chosen), "_id")

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, rows = list(b["_t"]), []
            for start, stop in ta.parts(texts):
                x = lines(texts[start:stop])
                at = np.searchsorted(x.doc, np.arange(stop - start + 1))
                rows += [
                    (i, y, x.length[p:q].astype(np.int32).tobytes(), x.own[p:q].tobytes())
                    for i, y, p, q in zip(b["_id"][start:stop], b["_y"][start:stop], at[:-1], at[1:])
                ]
            yield pd.DataFrame(rows, columns=["i", "y", "n", "f"])

    kind = docs.schema[id_col].dataType.simpleString()
    # the sample has sample_docs ids; the limit holds where very many rows repeat one
    got = texts.mapInPandas(featurise, f"i {kind}, y int, n binary, f binary").orderBy("i", "f").limit(2 * sample_docs).collect()
    if not got:
        return Model(np.zeros(3 * N_OWN + 1), np.zeros((2, 2)))
    own = [np.frombuffer(bytes(r["f"]), np.int16).reshape(-1, len(NAMES) + 3) for r in got]
    x = Lines(np.repeat(np.arange(len(got)), [len(o) for o in own]), np.concatenate([np.frombuffer(bytes(r["n"]), np.int32) for r in got]), np.concatenate(own))
    return fit(x, np.array([r["y"] for r in got]))


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`df` with score in place of a column of that name."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def quality(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.value.scores([t if isinstance(t, str) else None for t in texts]))

    return df.withColumn("score", quality(F.col(text_col)))


def op7_quality_crf(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    out = held_out(F.col("doc_id"), 4, 2)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~out).select("doc_id", "quality")
    model = train(labels, docs.filter(~out).select("doc_id", "text"))
    scored = score(docs.select("doc_id", "text", out.alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
