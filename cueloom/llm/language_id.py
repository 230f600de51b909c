"""Language identification by error-correcting output codes.

Each language gets a codeword; a binary classifier per code bit tells the languages whose bit is 1 from the rest by hashed
byte 1- to 4-grams of the lower-cased text (log-odds of smoothed n-gram frequencies, averaged over the text).  Bits are
calibrated on a second part of the training rows: a bit's weight is its information there.  A text gets the language whose
codeword has the least weighted logistic loss; a small gap to the second nearest flags ambiguity.

The fit reads at most `per_language` training documents of each language (a documented bound), chosen by the hash of their id;
every text, whole, is scored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.llm.common import is_held_out, map_texts, read_table, text_bytes

SLOTS = 1 << 16
GRAMS = (1, 2, 3, 4)
CHUNK = 1 << 16
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Every byte that is not an ASCII letter or part of a longer character counts as one blank.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint64)


def slots(text: bytes):
    """Hashed n-gram slots of one text, in chunks that overlap by the longest n-gram, so a long text needs little memory."""
    for at in range(0, max(1, len(text)), CHUNK):
        part = _FOLD[np.frombuffer(text[at : at + CHUNK + GRAMS[-1] - 1], np.uint8)]
        keep = part.size - (GRAMS[-1] - 1 if at + CHUNK < len(text) else 0)
        code, found = np.zeros(part.size, np.uint64), []
        for n in range(1, GRAMS[-1] + 1):
            if part.size < n:
                break
            code = (code[: part.size - n + 1] << np.uint64(8)) | part[n - 1 :]
            found.append((((code + np.uint64(n << 40)) * _MIX) >> np.uint64(48))[:keep].astype(np.int64))
        if found:
            yield np.concatenate(found)


def has_letter(text: bytes) -> bool:
    """Any letter of any script."""
    return text.isascii() and bytes(text).translate(_LETTERS).strip() != b"" if text.isascii() else any(map(str.isalpha, text.decode("utf-8", "replace")))


_LETTERS = bytes(c if 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))


def codebook(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of +1 / -1: all distinct splits for up to 7 languages, otherwise random dense codes of 15 log2(n) bits (no constant column)."""
    if n <= 7:
        columns = [c for c in product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns, np.float64).T.reshape(n, -1)
    rng, bits = np.random.default_rng(seed), math.ceil(15 * math.log2(n))
    best, gap = None, -1
    for _ in range(50):
        code = rng.choice((-1.0, 1.0), (n, bits))
        far = ((code[:, None, :] != code[None, :, :]).sum(axis=2) + bits * np.eye(n)).min()
        if far > gap and (np.abs(code.sum(axis=0)) < n).all():
            best, gap = code, far
    return best


@dataclass(frozen=True)
class Codes:
    languages: tuple[str, ...]
    code: np.ndarray  # languages x bits
    odds: np.ndarray  # slots x bits
    shift: np.ndarray  # bits: centre of the margins
    scale: np.ndarray  # bits: spread of the margins
    weight: np.ndarray  # bits

    def margins(self, text: bytes) -> np.ndarray:
        total, n = np.zeros(self.odds.shape[1]), 0
        for s in slots(text):
            total += self.odds[s].sum(axis=0)
            n += len(s)
        return total / max(1, n)

    def decode(self, raw: np.ndarray) -> np.ndarray:
        """Probability-like share of each language: the softmax of minus the weighted loss of its codeword."""
        f = (raw - self.shift) / self.scale
        loss = (self.weight * np.logaddexp(0.0, -self.code * f)).sum(axis=1)
        e = np.exp(loss.min() - loss)
        return e / e.sum()


def training_rows(docs: DataFrame, per_language: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """At most about `per_language` rows of each language among those not held out, the same for any order of the rows; part 0 fits, part 1 calibrates."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id")))
    size = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    place = F.xxhash64("doc_id")
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, per_language / n))) for k, n in sorted(size.items())], F.lit(0.0))
    return rows.where(F.pmod(place, F.lit(1 << 30)) < share * (1 << 30)).withColumn("part", F.when(F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(4)) == 0, 1).otherwise(0))


def fit(docs: DataFrame, per_language: int = 4000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Codes | None:
    """None if no row has a language."""
    rows = training_rows(docs, per_language, id_col, text_col, lang_col)
    languages = tuple(sorted(r["lang"] for r in rows.select("lang").distinct().collect()))
    if not languages:
        return None
    place = {k: i for i, k in enumerate(languages)}
    code = codebook(len(languages))

    def count(batches):
        total = np.zeros((len(place), SLOTS))
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for s in slots(text.as_py()):
                    total[place[lang]] += np.bincount(s, minlength=SLOTS)
        at, slot = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(slot, pa.int32()), pa.array(total[at, slot])], names=["lang", "slot", "v"])

    data = F.col("text").cast("binary").alias("text")
    total = np.zeros((len(languages), SLOTS))
    counted = rows.where("part = 0").select("lang", data).mapInArrow(count, "lang int, slot int, v double").groupBy("lang", "slot").agg(F.sum("v").alias("v")).toPandas()
    total[counted["lang"], counted["slot"]] = counted["v"]
    share = (total + 0.5) / (total + 0.5).sum(axis=1, keepdims=True)
    bits = code.shape[1]
    odds = np.zeros((SLOTS, max(1, bits)))
    for b in range(bits):
        odds[:, b] = np.log(share[code[:, b] > 0].mean(axis=0)) - np.log(share[code[:, b] < 0].mean(axis=0))
    model = Codes(languages, code if bits else np.zeros((len(languages), 1)), odds.astype(np.float32), np.zeros(max(1, bits)), np.ones(max(1, bits)), np.ones(max(1, bits)))
    if not bits:
        return model

    def calibrate(batches):
        sums = np.zeros((len(place), bits, 3))
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                f = model.margins(text.as_py())
                sums[place[lang]] += np.stack([np.ones(bits), f, f * f], axis=1)
        at, bit = np.nonzero(sums[:, :, 0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(bit, pa.int32()), *[pa.array(sums[at, bit, i]) for i in range(3)]], names=["lang", "bit", "n", "s", "q"])

    sums = np.zeros((len(languages), bits, 3))
    for r in rows.where("part = 1").select("lang", data).mapInArrow(calibrate, "lang int, bit int, n double, s double, q double").groupBy("lang", "bit").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect():
        sums[r["lang"], r["bit"]] = r["n"], r["s"], r["q"]
    n = np.maximum(sums[:, :, 0], 1e-9)
    mean, var = sums[:, :, 1] / n, np.maximum(sums[:, :, 2] / n - (sums[:, :, 1] / n) ** 2, 1e-6)
    shift, scale, weight = np.zeros(bits), np.ones(bits), np.ones(bits)
    for b in range(bits):
        up, down = code[:, b] > 0, code[:, b] < 0
        if sums[up, b, 0].sum() and sums[down, b, 0].sum():
            low, high = mean[up & (sums[:, b, 0] > 0), b].min(), mean[down & (sums[:, b, 0] > 0), b].max()
            spread = math.sqrt(np.average(var[:, b], weights=n[:, b]))
            shift[b], scale[b] = (low + high) / 2, max(spread, 1e-3)
            weight[b] = 1.0 / (1.0 + math.exp(-max(-20.0, (low - high) / max(spread, 1e-3) - 1)))
    return Codes(languages, code, model.odds, shift, scale, np.maximum(weight, 1e-3))


def predict(docs: DataFrame, model: Codes | None, gap: float = 0.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (share of the language), ambiguous (its share leads the next one's by less than `gap`)."""

    def each():
        def row(doc, text):
            text = text_bytes(text)
            if model is None or not has_letter(text):
                return doc, "und", 0.0, True
            share = model.decode(model.margins(text))
            order = np.argsort(-share, kind="stable")
            best = float(share[order[0]])
            return doc, model.languages[order[0]], best, bool(len(order) > 1 and best - share[order[1]] < gap)

        return row

    return map_texts(docs, each, "doc_id long, lang_pred string, score double, ambiguous boolean", id_col, text_col)


def identify(docs: DataFrame, per_language: int = 4000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row; `und` with score 0 where the text is null or has no letter (or nothing could be learned)."""
    found = predict(docs, fit(docs, per_language, id_col, text_col, lang_col), id_col=id_col, text_col=text_col)
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return identify(read_table(spark, folder, "documents"))
