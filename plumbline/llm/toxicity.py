"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios (Wang & Manning, 2012).

Features are hashed n-grams of characters inside words (with word ends). For
each, the log-count ratio r = log(P(n-gram | toxic) / P(n-gram | clean)) comes
from smoothed counts of labelled texts that have it; the features with enough
support and the largest |r| stay. A text's value for feature f is r_f times how
dense f is in the text, and logistic regression on these values is what scores.

The labelled sample is bounded: ``SAMPLE`` texts of each label, the first in a
hash order of their ids. The model (``FEATURES`` hashes and weights) is a few
hundred kB and travels in the closure; every text is scored whole in one
narrow pass.

A null or empty text has no n-gram and gets the score of the intercept alone.
Labels that are null, or whose text is missing, aren't learnt from; of several
labels of one id the larger counts, and of several texts of one id the least,
so repeated ids add nothing to the sample. With no label of one kind the score
is the share of toxic labels (0.5 without any label). Long texts are scored
whole; equal texts have equal scores. Other columns are never read. Empty
tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import bound_batches, map_texts
from plumbline.session import cut, remove_folder, shared_folder

#: Labelled texts learnt from, for each label.
SAMPLE = 6_000
#: Hash space of n-grams, n-gram lengths, and features that stay.
BITS, GRAMS, FEATURES = 20, (3, 4, 5, 6), 20_000
#: Texts that a feature needs to stay.
LEAST_TEXTS = 8


def gram_hashes(text: str | None) -> np.ndarray:
    """Hashed n-grams of the lower-cased text's characters within words, repeats included, and none across words."""
    if not text:
        return np.zeros(0, np.uint32)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes = np.concatenate(([np.uint64(32)], codes, [np.uint64(32)]))
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    codes[space] = 32
    spaces = np.cumsum(space)
    out = []
    h = codes.copy()
    for n in range(2, max(GRAMS) + 1):
        if len(codes) < n:
            break
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
        if n in GRAMS:
            inner = spaces[n - 2 : len(codes) - 1] - spaces[: len(codes) - n + 1] if n > 2 else 0
            good = inner == 0  # white space at the ends only
            mixed = h[good]
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append((mixed >> np.uint64(64 - BITS)).astype(np.uint32))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def n_words(text: str | None) -> int:
    return len(text.split()) if text else 0


@dataclass
class Model:
    ratio: np.ndarray  # over the hash space, 0 where the feature isn't kept
    number: np.ndarray  # over the hash space, -1 where not kept
    weights: np.ndarray
    intercept: float

    def __getstate__(self) -> dict:
        """What travels: the kept features alone, a few hundred kB."""
        kept = np.flatnonzero(self.number >= 0)
        return {"kept": kept, "own": self.number[kept], "r": self.ratio[kept], "weights": self.weights, "intercept": self.intercept}

    def __setstate__(self, state: dict) -> None:
        self.ratio, self.number = np.zeros(1 << BITS), np.full(1 << BITS, -1, np.int32)
        self.ratio[state["kept"]], self.number[state["kept"]] = state["r"], state["own"]
        self.weights, self.intercept = state["weights"], state["intercept"]

    def values(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(feature numbers, values) of one text: r times the count's share of words, saturating."""
        grams = gram_hashes(text)
        grams = grams[self.number[grams] >= 0]
        if not len(grams):
            return np.zeros(0, np.int64), np.zeros(0)
        kept, count = np.unique(grams, return_counts=True)
        density = np.minimum(1.0, count * (DENSE / max(n_words(text), 1)))
        return self.number[kept].astype(np.int64), self.ratio[kept] * density

    def score(self, text: str | None) -> float:
        at, values = self.values(text)
        z = self.intercept + float(values @ self.weights[at])
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


#: A feature in one of so many words has full value.
DENSE = 100.0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep, size: int) -> DataFrame:
    """(text, y): at most ``size`` labelled texts of each label for which ``keep(doc_id)`` holds, by a hash of the id.

    Each labelled id has one text, the least of its rows', so the bound holds
    whatever repeats in ``docs``.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(
        F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & keep(F.col("doc_id"))
    )
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    order = [F.xxhash64(F.lit(3), "doc_id"), F.col("doc_id")]
    chosen = [known.where(F.col("y") == y).orderBy(*order).limit(size) for y in (0, 1)]
    few = chosen[0].unionByName(chosen[1]).withColumnRenamed("doc_id", "__pl_id")  # 2 * size rows at most
    met = docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("__pl_id"))
    return met.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "y")


def fold_of(doc_id, folds: int):
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def train(sample: DataFrame) -> Model:
    """Fits on (text, y); two passes over the bounded sample, then Spark ML's logistic regression."""
    import pyarrow as pa
    from pyspark.ml.classification import LogisticRegression

    spark = sample.sparkSession
    bound_batches(spark)
    sample = cut(sample.repartition(8))  # bounded, so a fixed number of parts
    totals = dict(sample.groupBy("y").count().collect())
    number = np.full(1 << BITS, -1, np.int32)
    ratio = np.zeros(1 << BITS)
    if len(totals) < 2:
        share = totals.get(1, 0) / max(1, sum(totals.values())) if totals else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(ratio, number, np.zeros(0), float(np.log(share / (1 - share))))

    def texts_with(batches):
        have = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                have[y, np.unique(gram_hashes(text))] += 1
        f = np.flatnonzero(have.sum(axis=0))
        yield pa.RecordBatch.from_pydict({"f": f.astype(np.int32), "n0": have[0, f], "n1": have[1, f]})

    counted = sample.select("text", "y").mapInArrow(texts_with, "f int, n0 long, n1 long")
    counted = counted.groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    r = F.log(((F.col("n1") + 1) / (totals[1] + 2)) / ((F.col("n0") + 1) / (totals[0] + 2)))
    best = counted.where(F.col("n0") + F.col("n1") >= LEAST_TEXTS).withColumn("r", r)
    best = best.orderBy(F.abs("r").desc(), "f").limit(FEATURES).collect()
    for k, row in enumerate(best):
        number[row.f], ratio[row.f] = k, row.r
    model = Model(ratio, number, np.zeros(max(1, len(best))), 0.0)

    def lines(batches):
        for batch in batches:
            out = []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, values = model.values(text)
                out.append(" ".join([str(y), *(f"{k + 1}:{v!r}" for k, v in sorted(zip(at.tolist(), values.tolist(), strict=True)))]))
            yield pa.RecordBatch.from_pydict({"value": out})

    # sparse vectors of the sample, in the text format for them that Spark reads
    folder = shared_folder(spark, "features")
    sample.select("text", "y").mapInArrow(lines, "value string").write.text(folder)
    data = spark.read.format("libsvm").option("numFeatures", max(1, len(best))).load(folder)
    fitted = LogisticRegression(maxIter=60, regParam=2e-4, standardization=False).fit(data)
    model.weights, model.intercept = fitted.coefficients.toArray(), float(fitted.intercept)
    remove_folder(spark, folder)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the probability that each whole text is toxic."""

    def make():
        return lambda texts: [(model.score(t),) for t in texts]

    return map_texts(docs, "score double", make, id_col, text_col)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted); ids of fold ``held`` are not learnt from."""
    out = lambda i: F.coalesce(fold_of(i, folds) == held, F.lit(False))
    model = train(labelled_sample(docs, labels, "toxic", lambda i: ~out(i), SAMPLE))
    scored = score(docs, model)
    return scored.select(
        "doc_id", out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
