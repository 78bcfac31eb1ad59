"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes one space, and n-grams of
1 to 3 characters are hashed into 2^`bits` features. Document frequencies are
counted over every training row (one pass, summed per feature before they leave
the cluster). The weights are learned by follow-the-regularised-leader with
elastic-net penalties on a sample of about `per_language` rows a language (those whose
id has a small hash, in order of that hash), and a temperature fitted on a fifth of
that sample that was kept out calibrates the probabilities.

What is broadcast is bounded by 2^bits times the number of languages (at most
`max_languages`), whatever the corpus.

Defined results: a null text, or one without a letter (combining marks are none), is
`und` with score 0; so is every text if there is nothing to learn from; very long texts
are read whole, one at a time; ties go to the language that sorts
first; a null id counts as the empty string when rows are held out; repeated rows
are each returned; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..partitions import spread
from . import textarrays as ta
from .common import quoted

BITS, PER_LANGUAGE, MAX_LANGUAGES, EPOCHS = 15, 800, 1000, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
UND = "und"


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    return (F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % modulus) == remainder


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct feature indices and their counts; None without a letter. Combining marks count in n-grams, but alone they are no text."""
    if not text:
        return None
    cps = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = ta.classes()[cps]
    letter = ta.wordlike(kind)
    if not (letter & (kind != ta.COMBINING)).any():
        return None
    a = np.where(letter, cps, np.uint32(32))
    a = a[letter | np.concatenate([[True], letter[:-1]])]  # one space for a run of others
    if a[0] != 32:
        a = np.concatenate([np.array([32], np.uint32), a])
    if a[-1] != 32:
        a = np.concatenate([a, np.array([32], np.uint32)])
    shift = np.uint32(32 - bits)
    k1, k2, k3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
    one = (a[a != 32] * k1) >> shift
    b = a[:-1] * k2 ^ (a[1:] * k1 + np.uint32(0x27D4EB2F))
    two = (b * k3) >> shift
    c = (b[:-1] * k1) ^ (a[2:] * k3 + np.uint32(0x165667B1))
    three = (c * k2) >> shift
    counts = np.bincount(np.concatenate([one, two, three]), minlength=1 << bits)
    index = np.flatnonzero(counts)
    return index, counts[index]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    bits: int = BITS

    def vector(self, found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        index, counts = found
        x = (1.0 + np.log(counts)) * self.idf[index]
        return index, x / np.sqrt((x * x).sum())

    def logits(self, index: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[index] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        found = features(text, self.bits) if self.languages else None
        if found is None:
            return UND, 0.0
        p = softmax(self.logits(*self.vector(found)) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_features: int, n_classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x classes) and bias by FTRL-proximal with elastic-net penalties (none on the bias)."""
    z, n = np.zeros((n_features, n_classes)), np.zeros((n_features, n_classes))
    zb, nb = np.zeros(n_classes), np.zeros(n_classes)

    def weight(z, n, l1, l2):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + l2))

    for epoch in range(epochs):
        for r in np.random.default_rng(epoch).permutation(len(rows)):
            index, x, y = rows[r]
            w, b = weight(z[index], n[index], L1, L2), weight(zb, nb, 0.0, 0.0)
            g = softmax(x @ w + b)
            g[y] -= 1.0
            for grad, zz, nn, ww, at in ((x[:, None] * g, z, n, w, index), (g, zb, nb, b, slice(None))):
                sq = grad * grad
                sigma = (np.sqrt(nn[at] + sq) - np.sqrt(nn[at])) / ALPHA
                zz[at] += grad - sigma * ww
                nn[at] += sq
    return weight(z, n, L1, L2), weight(zb, nb, 0.0, 0.0)


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature (0.25 to 20) with the least cross-entropy."""

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean())

    return min(np.exp(np.linspace(np.log(0.25), np.log(20), 121)), key=loss) if len(y) else 1.0


def train(
    rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
    bits: int = BITS, per_language: int = PER_LANGUAGE, max_languages: int = MAX_LANGUAGES,
) -> Model:
    """Fit on `rows`. Runs three jobs: rows per language, document frequencies over all rows, the bounded sample."""
    rows = rows.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.col(label_col).alias("_y")).filter("_t IS NOT NULL AND _y IS NOT NULL")
    sizes = {r["_y"]: r["count"] for r in rows.groupBy("_y").count().limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"over {max_languages} languages")
    languages, size = sorted(sizes), 1 << bits

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs = np.zeros(size, dtype=np.int64), 0
        for b in batches:
            for t in b.column(0):
                found = features(t.as_py(), bits)
                docs += 1
                if found is not None:
                    df[found[0]] += 1
        index = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(index, -1)), pa.array(np.append(df[index], docs))], names=["k", "n"])

    df = np.zeros(size, dtype=np.int64)
    docs = 0
    for r in rows.select("_t").mapInArrow(frequencies, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        if r["k"] < 0:
            docs = r["n"]
        else:
            df[r["k"]] = r["n"]
    model = Model(languages, np.log((1.0 + docs) / (1.0 + df)) + 1.0, np.zeros((size, len(languages))), np.zeros(len(languages)), bits=bits)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t.as_py(), bits) or (np.empty(0, int), np.empty(0, int)) for t in b.column(0)]
            index = pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32()))
            counts = pa.array([f[1].astype(np.int32) for f in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([index, counts, b.column(1), b.column(2)], names=["i", "c", "y", "o"])

    share = F.create_map(*[F.lit(v) for y, n in sizes.items() for v in (y, min(1.0, 1.1 * per_language / n))]) if sizes else F.create_map()
    order = F.xxhash64(F.coalesce(F.col("_id").cast("string"), F.lit("")))
    chance = F.pmod(order, F.lit(1 << 30)).cast("double") / float(1 << 30)
    sample = rows.withColumn("_o", order).filter(chance < F.element_at(share, F.col("_y"))) if sizes else rows.withColumn("_o", order).limit(0)
    got = sample.select("_t", "_y", "_o").mapInArrow(vectors, "i array<int>, c array<int>, y string, o long")
    # the sample's own bound is per_language; a limit beyond it holds where very many rows repeat an id
    got = got.orderBy("o", "y", "i", "c").limit(2 * per_language * max(1, len(languages)))
    place = {y: k for k, y in enumerate(languages)}
    data = got.toArrow()
    each = []
    for i, c, y, o in sorted(zip(data["i"], data["c"], data["y"].to_pylist(), data["o"].to_pylist()), key=lambda r: (r[3], r[2])):
        index = i.values.to_numpy(zero_copy_only=False) if i.values is not None else np.empty(0, int)
        if len(index):
            each.append((*model.vector((index, c.values.to_numpy(zero_copy_only=False))), place[y]))
    kept = [r for k, r in enumerate(each) if k % 5 != 4]
    model.weights, model.bias = ftrl(kept, size, len(languages))
    out = each[4::5]
    model.temperature = calibrate(np.array([model.logits(i, x) for i, x, _ in out]), np.array([y for *_, y in out])) if out else 1.0
    model.weights = model.weights.astype(np.float32)
    return model


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`df` with lang_pred and score in place of columns of those names."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.udf("struct<lang_pred:string,score:double>", useArrow=True)
    def predict(text: str | None):
        return sent.value.predict(text)

    kept = quoted([c for c in df.columns if c not in ("lang_pred", "score")])
    return df.select(*kept, predict(F.col(text_col)).alias("__ls_p")).select(*kept, "__ls_p.lang_pred", "__ls_p.score")


def op5_langid(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    out = held_out(F.col("doc_id"), 5, 0)
    model = train(docs.filter(~out).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text", out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
