"""Quality score: regularised quadratic discriminant analysis over transformed document statistics.

One pass turns every whole text into `FEATURES` (logs of counts, log-odds-like logs of shares).  Class moments are plain sums
over all training rows, added up by Spark; only 2 x (1 + d + d(d+1)/2) numbers reach the driver.  Each class covariance is shrunk
towards the pooled one and towards a multiple of the identity, and its Cholesky factor is inverted once.  The score is the
logistic of the difference of the two Mahalanobis log-densities plus the log prior ratio.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.llm.common import cut_lineage, is_held_out, map_texts, read_table, text_bytes

FEATURES = (
    "bytes", "words", "word_length", "upper", "digits", "blanks", "points", "shouts", "symbols", "bars", "high", "distinct", "repeated_word", "top_word",
    "upper_words", "line_length", "repeated_lines", "symbol_words", "entropy", "word_length_spread", "alternating",
)
_CLASS = np.zeros(256, np.int64)
for _set, _at in ((range(65, 91), 1), (range(48, 58), 2), ((9, 10, 11, 12, 13, 32), 3), (b".,;:?'\"-()", 4), (b"!", 5), (b"$%&*#@^~<>{}[]\\/_=+`", 6), (b"|", 7), (range(128, 256), 8)):
    _CLASS[list(_set)] = _at


def features(text: bytes) -> list[float]:
    """The transformed statistics of one whole text; an empty one has the values of zero counts."""
    raw = np.frombuffer(text, np.uint8)
    n = max(1, len(raw))
    seen = np.bincount(raw, minlength=256)
    kinds = np.bincount(_CLASS, weights=seen, minlength=9)
    words = text.split()
    m = max(1, len(words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    again = sum(map(bytes.__eq__, words[1:], words))
    skip = sum(map(bytes.__eq__, words[2:], words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    p = seen[seen > 0] / n
    share = lambda x, of=n: math.log((x + 0.5) / (of + 1.0))
    odd = sum(1 for w in counts if w[-1:] in b"$%&*#@^~") if counts else 0
    return [
        math.log1p(len(raw)), math.log1p(len(words)), math.log1p(lengths.mean()), share(kinds[1]), share(kinds[2]), share(kinds[3]), share(kinds[4]), share(kinds[5]), share(kinds[6]),
        share(kinds[7]), share(kinds[8]), math.log((len(counts) + 1) / (m + 1) ** 0.8), share(again, m), share(max(counts.values(), default=0), m),
        share(sum(c for w, c in counts.items() if len(w) > 1 and w.isupper()), m), math.log1p(len(raw) / max(1, len(lines))), share(len(lines) - len(set(lines)), max(1, len(lines))),
        share(odd, max(1, len(counts))), float(-(p * np.log2(p)).sum()) if len(raw) else 0.0, math.log1p(lengths.std()), share(skip, m),
    ]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return map_texts(docs, lambda: lambda doc, text: (doc, features(text_bytes(text))), "doc_id long, x array<double>", id_col, text_col)


@dataclass(frozen=True)
class Discriminant:
    mean: np.ndarray  # of all training rows, and their spread: inputs are standardised with them
    spread: np.ndarray
    centre: np.ndarray  # 2 x d
    factor: np.ndarray  # 2 x d x d, inverse Cholesky factors
    constant: np.ndarray  # log prior - half log determinant

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.spread
        log = [c - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.centre, self.factor, self.constant, strict=True)]
        return 1.0 / (1.0 + np.exp(-np.clip(log[1] - log[0], -500, 500)))


def fit(measured: DataFrame, labels: DataFrame, label_col: str = "quality", pooled: float = 0.3, ridge: float = 0.05, held_out=is_held_out) -> Discriminant:
    """Learn from the measured rows whose id is labelled 0 or 1 and not held out.

    An id labelled more than once counts with its largest label; null ids and labels are left out.  A class with no rows has
    the pooled mean; without any training rows both densities agree and every score is one half.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label_col)).cast("int").alias("y"))
    rows = measured.where(~held_out(F.col("doc_id"))).join(known, "doc_id").select("y", "x")
    d = len(FEATURES)
    upper = np.triu_indices(d)

    def add_up(batches):
        total = np.zeros((2, 1 + d + len(upper[0])))
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own)[upper]])
        at, slot = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(slot, pa.int32()), pa.array(total[at, slot])], names=["y", "slot", "v"])

    total = np.zeros((2, 1 + d + len(upper[0])))
    for r in rows.mapInArrow(add_up, "y int, slot int, v double").groupBy("y", "slot").agg(F.sum("v").alias("v")).collect():
        total[r["y"], r["slot"]] = r["v"]
    n, sums, square = total[:, 0], total[:, 1 : 1 + d], np.zeros((2, d, d))
    for c in (0, 1):
        square[c][upper] = total[c, 1 + d :]
        square[c] = square[c] + np.triu(square[c], 1).T
    count = max(n.sum(), 1.0)
    mean = sums.sum(axis=0) / count
    spread = np.sqrt(np.maximum(np.diag(square.sum(axis=0)) / count - mean**2, 1e-6))
    centre, cov = np.zeros((2, d)), np.zeros((2, d, d))
    for c in (0, 1):
        m = sums[c] / n[c] if n[c] else mean
        centre[c] = (m - mean) / spread
        cov[c] = (square[c] / n[c] - np.outer(m, m)) / np.outer(spread, spread) if n[c] else np.zeros((d, d))
    common = (n[:, None, None] * cov).sum(axis=0) / count
    factor, constant = np.zeros((2, d, d)), np.zeros(2)
    for c in (0, 1):
        s = (1 - pooled) * cov[c] + pooled * common
        s = (1 - ridge) * s + ridge * max(np.trace(s) / d, 1e-3) * np.eye(d)
        low = np.linalg.cholesky(s)
        factor[c] = np.linalg.inv(low)
        constant[c] = math.log((n[c] + 1) / (count + 2)) - np.log(np.diag(low)).sum() if n.sum() else 0.0
    return Discriminant(mean, spread, centre, factor, constant)


def apply(measured: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, score, predicted of every measured row."""
    d = len(FEATURES)

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return measured.mapInArrow(run, "doc_id long, score double, predicted int")


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row, null and empty texts (scored as such) and repeated rows included."""
    measured = cut_lineage(measure(docs, id_col, text_col))
    return apply(measured, fit(measured, labels)).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    return score_quality(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))
