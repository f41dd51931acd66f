"""Quality by nearest-neighbour voting over labelled latent-semantic vectors.

A text's terms are its words, hashed; runs of one to three character classes
(case, digits, white space, each mark by itself), which tell how it is written
whatever its words; and marks for words and lines that are said again. Term
weights are tf-idf with a damped tf, each term's share of the text counting,
and the ``TERMS`` commonest stay; a singular value decomposition of the
labelled texts' weights gives ``DIMENSIONS`` latent directions. The labelled
vectors (at most ``SAMPLE`` rows: some 3 MB) are sent to every task; each
text's exact cosines to all of them are one blocked matrix product, and its
``NEIGHBOURS`` nearest vote with their labels, weighted by similarity.

The labelled sample is bounded by ``SAMPLE`` ids, taken in a hash order, with
one text for each, the least of its rows'; only its ``TERMS`` commonest terms
come to the driver. All texts are scored whole in one narrow pass, however
long. Neighbours that tie for the last vote are taken in the order of the
labelled rows' ids.

A null or empty text has no terms: its vector is zero, no neighbour is nearer
than another, and its score is the share of good labels. Null labels and
labels without a text aren't learnt from, of several labels of one id the
larger counts; with no label every score is 0.5. Equal texts have equal
scores, wherever they stand: products are of doubles in blocks of one shape,
so their sums have one order, and scores are rounded to ten places. Other columns are never read. Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_texts
from plumbline.llm.toxicity import fold_of
from plumbline.session import cut

#: Labelled texts learnt from, terms that stay, latent directions, voters.
SAMPLE, TERMS, DIMENSIONS, NEIGHBOURS = 6_000, 2_000, 64, 25
#: Texts in one product; a shorter block is filled up with zero rows.
BLOCK_TEXTS = 256
#: Closeness counts by this power, so near voters outweigh far ones.
SHARPNESS = 8
#: Hash space of words.
BITS = 17
_CLASSES = 32
_RUNS = _CLASSES + _CLASSES**2 + _CLASSES**3
#: Said again: words equal to the one before, words seen before, lines seen before; each in eight steps of how often.
_AGAIN = 3 * 8
_WORDS = _RUNS + _AGAIN
_MARK_CHARS = "#*$%&|<>!?.,;:-_=+/()[]{}\"'@~"


def _table() -> np.ndarray:
    """The class of each character below 0x3000: 0 lower, 1 upper, 2 digit, 3 space, 4 line end, marks from 5 on."""
    out = np.zeros(0x3000, np.uint8)
    for code in range(0x3000):
        c = chr(code)
        if c.isupper():
            out[code] = 1
        elif c.isdigit():
            out[code] = 2
        elif c == "\n":
            out[code] = 4
        elif c.isspace():
            out[code] = 3
        elif c in _MARK_CHARS:
            out[code] = 5 + _MARK_CHARS.index(c) % 26
        elif not c.isalpha():
            out[code] = 31
    return out


_CLASS_OF = _table()


def term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(terms, weights) of one text: its words, hashed; runs of one to three character classes; what is said again."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _CLASS_OF[np.minimum(codes, 0x2FFF)].astype(np.int64)
    runs = [c]
    if len(c) > 1:
        runs.append(_CLASSES + c[:-1] * _CLASSES + c[1:])
    if len(c) > 2:
        runs.append(_CLASSES + _CLASSES**2 + (c[:-2] * _CLASSES + c[1:-1]) * _CLASSES + c[2:])
    count = np.bincount(np.concatenate(runs), minlength=_RUNS)
    at = np.flatnonzero(count)
    words = text.lower().split()
    n = max(1, len(words))
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    shares = (int((ids[1:] == ids[:-1]).sum()) / n, 1 - len(number) / n, 1 - len(set(lines)) / max(1, len(lines)))
    again = [_RUNS + 8 * k + s for k, share in enumerate(shares) for s in range(8) if share > 0.08 * (s + 1)]
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) & ((1 << BITS) - 1) for w in number), np.int64, len(number))
    word, place = np.unique(hashed, return_inverse=True)
    often = np.bincount(place, weights=np.bincount(ids, minlength=len(number))) if len(ids) else np.zeros(0)
    weights = (np.log1p(100.0 * count[at] / len(c)), np.full(len(again), 1.5), np.log1p(100.0 * often / n))
    return np.concatenate((at, np.array(again, np.int64), _WORDS + word)), np.concatenate(weights)


@dataclass
class Model:
    number: np.ndarray  # of each term, -1 where not kept
    project: np.ndarray  # kept terms by latent directions, idf included
    vectors: np.ndarray  # labelled rows, unit length
    labels: np.ndarray
    prior: float

    def latent(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.project.shape[1]))
        for k, t in enumerate(texts):
            terms, weights = term_counts(t)
            at = self.number[terms]
            keep = at >= 0
            out[k] = weights[keep] @ self.project[at[keep]]
        return unit(out)

    def score(self, texts: list[str | None]) -> np.ndarray:
        n = len(self.labels)
        if not n:
            return np.full(len(texts), self.prior)
        latent = self.latent(texts)
        out = np.full(len(texts), self.prior)
        k = min(NEIGHBOURS, n)
        for a in range(0, len(texts), BLOCK_TEXTS):
            block = np.zeros((BLOCK_TEXTS, latent.shape[1]))
            rows = len(texts[a : a + BLOCK_TEXTS])
            block[:rows] = latent[a : a + BLOCK_TEXTS]
            near = (block @ self.vectors.T)[:rows]
            block = block[:rows]
            last = np.partition(near, n - k, axis=1)[:, n - k : n - k + 1]  # the k-th nearest
            votes, ties = near > last, near == last
            votes |= ties & (np.cumsum(ties, axis=1) <= k - votes.sum(axis=1, keepdims=True))  # of ties, the first rows
            row, at = np.nonzero(votes)
            closeness = np.maximum(near[row, at], 0.0) ** SHARPNESS
            total = np.bincount(row, closeness, len(block))
            vote = np.bincount(row, closeness * self.labels[at], len(block))
            some = (total > 0) & (np.abs(block).sum(axis=1) > 0)
            out[a : a + BLOCK_TEXTS][some] = (vote / np.where(total > 0, total, 1))[some]
        return np.round(np.clip(out, 0.0, 1.0), 10)


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


def labelled_terms(docs: DataFrame, labels: DataFrame, label: str, keep, size: int) -> DataFrame:
    """(doc_id, y, terms, weights) of at most ``size`` labelled ids for which ``keep(doc_id)`` holds, one row for each."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & keep(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    few = known.orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(size).withColumnRenamed("doc_id", "__pl_id")
    met = docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("__pl_id"))
    texts = met.groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # repeated ids add no rows
    texts = texts.select(F.struct("doc_id", "y").alias("k"), "text")

    def make():
        return lambda rows: [tuple(x.tolist() for x in term_counts(t)) for t in rows]

    read = map_texts(texts.select(F.to_json("k").alias("k"), "text"), "terms array<int>, weights array<float>", make, "k")
    key = F.from_json("k", "doc_id string, y int")
    return read.select(key.doc_id.alias("doc_id"), key.y.alias("y"), "terms", "weights")


def train(sample: DataFrame) -> Model:
    """Fits on the bounded sample (doc_id, y, terms, weights).

    What reaches the driver is bounded: ``TERMS`` terms with their numbers of
    texts, then of each labelled text the terms that stay.
    """
    number = np.full(_WORDS + (1 << BITS), -1, np.int32)
    sample = cut(sample)
    seen = sample.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    seen = seen.orderBy(F.desc("n"), "t").limit(TERMS).collect()
    kept = np.array(sorted(r.t for r in seen), np.int64)
    number[kept] = np.arange(len(kept))
    texts_with = {r.t: r.n for r in seen}

    def only_kept(batches):
        for batch in batches:
            terms, weights = [], []
            for t, w in zip(*(batch.column(c).to_pylist() for c in (2, 3)), strict=True):
                keep = number[np.array(t, np.int64)] >= 0
                terms.append(np.array(t, np.int32)[keep])
                weights.append(np.array(w, np.float32)[keep])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(terms), pa.array(weights)], batch.schema.names)

    rows = sample.mapInArrow(only_kept, sample.schema).collect()
    if not rows:
        return Model(number, np.zeros((1, 1)), np.zeros((0, 1)), np.zeros(0), 0.5)
    rows.sort(key=lambda r: (len(r.doc_id), r.doc_id))
    idf = np.log((1 + len(rows)) / (1 + np.array([texts_with[t] for t in kept.tolist()], float))) + 0.3
    matrix = np.zeros((len(rows), max(1, len(kept))))
    for k, r in enumerate(rows):
        at = number[np.array(r.terms, np.int64)]
        matrix[k, at] = np.array(r.weights, np.float32) * idf[at]
    matrix = unit(matrix)
    values, vectors = np.linalg.eigh(matrix.T @ matrix)  # terms by terms
    directions = vectors[:, ::-1][:, :DIMENSIONS]
    project = ((idf if len(kept) else np.ones(1))[:, None] * directions)
    labels = np.array([r.y for r in rows], np.float64)
    return Model(number, project, unit(matrix @ directions), labels, float(labels.mean()))


def quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted); ids of fold ``held`` are not learnt from."""
    out = lambda i: F.coalesce(fold_of(i, folds) == held, F.lit(False))
    model = train(labelled_terms(docs, labels, "quality", lambda i: ~out(i), SAMPLE))

    def make():
        return lambda texts: [(float(s),) for s in model.score(texts)]

    scored = map_texts(docs, "score double", make)
    return scored.select(
        "doc_id", out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
