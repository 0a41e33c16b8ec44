"""A quality classifier: ordinal cumulative-link regression on graded ratings.

A label's grade is the number of marks in its favour: 1 for good quality and 1 for not being toxic. One weight
for each hashed feature of the text gives a score s, and ordered thresholds t1 < t2 turn it into tail probabilities
P(grade >= j) = 1 / (1 + exp(t_j - s)). The expected grade is their sum; a document is kept if
P(grade >= ``least_grade``) is at least ``least_probability``.

Features are the words of the whole text, their beginnings, their shapes (letters as a, digits as 9, other signs
as they are) and repetitions, hashed, as square roots of their shares, so that a long text weighs about as much
as a short one. The classifier is fitted on the driver from at most ``most_labels`` labelled documents, chosen by
a hash of their ids; scoring covers every document.

Defined cases: a null text, or one without words, has no features; it gets the score 0 and is kept, as nothing
speaks against it; a document with several labels is trained on each; labels without a document are ignored;
without any label of both ends every document is kept with probability 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.textblocks import Words, blocks, column, starts_of

BLOCK_BYTES = 3 << 20
#: Hashed features; the last is not used by any word.
FEATURES = 1 << 18
GRADES = 3
#: Lengths of the word beginnings that are features, by which inflected forms of a stem are known.
BEGINNINGS = (5,)
PUNCTUATION = ".,;:!?\"'()"
#: Added to a text's number of words, so that single words of short texts weigh less.
PRIOR_WORDS = 50

_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")


def _feature(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name) & (FEATURES - 1)


def word_features(words: list[str]) -> list[np.ndarray]:
    """For each distinct word the features of its bare form, of its beginnings, and of its shape; -1 for none."""
    bare = [w.strip(PUNCTUATION).lower() for w in words]
    out = [np.fromiter((_feature("w " + w) for w in bare), np.int64, len(words))]
    seen: dict[str, int] = {}

    def known(name: str) -> int:
        if name not in seen:
            seen[name] = _feature(name)
        return seen[name]

    out += [np.fromiter((known(f"{n} {w[:n]}") if len(w) > n else -1 for w in bare), np.int64, len(words)) for n in BEGINNINGS]
    out.append(np.fromiter((known("s a" if w.isalpha() else "s " + _DIGITS.sub("9", _LETTERS.sub("a", w))) for w in words), np.int64, len(words)))
    return out


def _repeats(code: np.ndarray, doc: np.ndarray, back: int) -> np.ndarray:
    """A feature of the words that stand again where they stood ``back`` words before; -1 for the others."""
    out = np.full(len(code), -1, np.int64)
    out[back:][(code[back:] == code[:-back]) & (doc[back:] == doc[:-back])] = _feature(f"r {back}")
    return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: (where each text's features begin, feature, value)."""
    words = Words(texts)
    families = word_features(words.distinct.to_pylist())
    counts = words.counts
    doc = np.repeat(np.arange(len(counts)), counts)
    rows, columns, values = [], [], []
    for own in (*[f[words.code] for f in families if len(doc)], *[_repeats(words.code, doc, back) for back in (1, 2)]):
        feature, there = own, own >= 0
        kind, n = np.unique(doc[there] * FEATURES + feature[there], return_counts=True)
        row = kind // FEATURES
        rows.append(row)
        columns.append(kind % FEATURES)
        values.append(np.sqrt(n / (counts[row] + PRIOR_WORDS)))
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return np.searchsorted(row[order], np.arange(len(counts) + 1)), np.concatenate(columns)[order].astype(np.int32), np.concatenate(values)[order].astype(np.float32)


@dataclass
class Ordinal:
    """Shared weights and ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, at: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Each row's own sum, whatever rows stand beside it."""
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        return np.bincount(row, self.weights[feature].astype(np.float64) * value, len(at) - 1)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ... in columns."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def thresholds_of(first: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Ordered thresholds: the first, and logarithms of the distances to the others."""
    return np.concatenate([first, first + np.cumsum(np.exp(gaps))])


def likelihood(w: np.ndarray, first: np.ndarray, gaps: np.ndarray, row: np.ndarray, column_: np.ndarray, value: np.ndarray, grade: np.ndarray) -> tuple[float, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The mean negative logarithm of the probabilities of the grades, and its slopes by w, first and gaps."""
    t = thresholds_of(first, gaps)
    s = np.bincount(row, w[column_] * value, len(grade))
    # P(grade >= j), with 1 below and 0 above
    tail = np.hstack([np.ones((len(s), 1)), _sigmoid(s[:, None] - t[None, :]), np.zeros((len(s), 1))])
    slope = tail * (1 - tail)
    i = np.arange(len(s))
    p = np.maximum(tail[i, grade] - tail[i, grade + 1], 1e-12)
    g = -1 / (p * len(grade))  # of the mean loss, for each row's probability
    by_score = g * (slope[i, grade] - slope[i, grade + 1])
    by_t = np.zeros((len(s), GRADES + 1))
    by_t[i, grade] -= g * slope[i, grade]
    by_t[i, grade + 1] += g * slope[i, grade + 1]
    by_t = by_t[:, 1:GRADES].sum(0)
    slopes = (np.bincount(column_, by_score[row] * value, len(w)), np.array([by_t.sum()]), np.array([by_t[k + 1 :].sum() for k in range(GRADES - 2)]) * np.exp(gaps))
    return float(-np.log(p).mean()), slopes


def fit(at: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, penalty: float = 0.0022, rounds: int = 200, rate: float = 1.0, least_rows: int = 4) -> Ordinal:
    """Likelihood of the cumulative-link model with an absolute penalty on the weights, by proximal Adam.

    The penalty falls with the root of the number of rows, as the noise of the gradient does. Features in fewer
    than ``least_rows`` rows are left out.
    """
    penalty /= np.sqrt(len(grade))
    row = np.repeat(np.arange(len(grade)), np.diff(at))
    common = np.bincount(feature, minlength=FEATURES)[feature] >= least_rows
    row, feature, value = row[common], feature[common], value[common].astype(np.float64)
    used, column_ = np.unique(feature, return_inverse=True)
    w, first, gaps = np.zeros(len(used)), np.array([-1.0]), np.full(GRADES - 2, 0.5)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, first, gaps)]
    for step in range(1, rounds + 1):
        now = rate * min(1.0, 3 * (1 - step / rounds) + 0.02)
        _, slopes = likelihood(w, first, gaps, row, column_, value, grade)
        for x, d, m in zip((w, first, gaps), slopes, state, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * d
            m[1] = 0.99 * m[1] + 0.01 * d * d
            pace = now / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
            x -= pace * m[0] / (1 - 0.9**step)
            if x is w:
                np.copyto(w, np.sign(w) * np.maximum(np.abs(w) - pace * penalty, 0))
    weights = np.zeros(FEATURES, np.float32)
    weights[used] = w
    return Ordinal(weights, thresholds_of(first, gaps))


def grade_of(quality, toxic):
    """Marks in a document's favour: good quality, and not toxic. Missing marks count in its favour."""
    return (F.coalesce(quality, F.lit(1)) != 0).cast("int") + (F.coalesce(toxic, F.lit(0)) == 0).cast("int")


def train(docs: DataFrame, labels: DataFrame, most_labels: int = 8000) -> Ordinal | None:
    """The classifier fitted to at most ``most_labels`` labelled documents, a sample by a hash of the ids."""
    graded = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("label_id"), grade_of(F.col("quality"), F.col("toxic")).cast("int").alias("grade"))
    # Labels without a document take no place in the sample.
    graded = graded.join(docs.select(F.col("doc_id").cast("long").alias("label_id")), "label_id", "left_semi")
    # Ordered by hash, so the sample does not depend on partitions; top-k keeps only its rows in each task.
    chosen = graded.orderBy(F.xxhash64("label_id"), "label_id", "grade").limit(most_labels)
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, BLOCK_BYTES):
            at, feature, value = features(column(table, "text"))
            lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x)) for x in (feature, value)]
            yield pa.record_batch([column(table, "doc_id"), column(table, "grade"), *lists], ["doc_id", "grade", "feature", "value"])

    rows = held.select("doc_id", "text", "grade").mapInArrow(sparse, "doc_id long, grade int, feature array<int>, value array<float>").toArrow().sort_by([("doc_id", "ascending"), ("grade", "ascending")])
    grade = column(rows, "grade").to_numpy()
    if len(set(grade.tolist())) < 2:
        return None
    feature, value = column(rows, "feature"), column(rows, "value")
    at = starts_of(pc.list_value_length(feature).to_numpy())
    return fit(at, feature.flatten().to_numpy(), value.flatten().to_numpy(), grade)


def quality(docs: DataFrame, labels: DataFrame, least_grade: int = 2, least_probability: float = 0.5, most_labels: int = 8000, with_row: bool = False) -> DataFrame:
    """One row per document: doc_id, score, expected_grade, p_good (the tail from grade 1), p_clean (from grade 2), kept."""
    model = train(docs, labels, most_labels)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, BLOCK_BYTES):
            if model is None:
                score, tails, bare = np.zeros(table.num_rows), np.ones((table.num_rows, GRADES - 1)), True
            else:
                at, feature, value = features(column(table, "text"))
                score = model.score(at, feature, value)
                tails, bare = model.tails(score), np.diff(at) == 0
            kept = bare | (tails[:, least_grade - 1] >= least_probability)
            out = [column(table, "doc_id"), pa.array(score), pa.array(tails.sum(1)), pa.array(tails[:, 0]), pa.array(tails[:, 1]), pa.array(kept)]
            names = ["doc_id", "score", "expected_grade", "p_good", "p_clean", "kept"]
            if with_row:
                out, names = [*out, column(table, "row")], [*names, "row"]
            yield from pa.Table.from_arrays(out, names).to_batches()

    schema = "doc_id long, score double, expected_grade double, p_good double, p_clean double, kept boolean"
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text")]
    if with_row:
        columns.append(F.struct("*").alias("row"))
        schema += f", row {docs.select(F.struct('*').alias('row')).schema['row'].dataType.simpleString()}"
    return docs.select(*columns).mapInArrow(judged, schema)


def kept_documents(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents that the classifier keeps, with all their columns."""
    return quality(docs, labels, with_row=True, **how).where("kept").select("row.*")
