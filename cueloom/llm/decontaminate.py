"""Benchmark decontamination: BM25 over an inverted index of test items with block-max WAND, then overlap checks.

The items are the indexed documents, every passage of every training text is a query.  Passages are two cells of as many words
as the longest item has, one cell apart, so an item that stands in a text lies whole in some passage.  Scores are divided by
the item's score against itself; `least` is the share that counts.  Every posting list has a maximum per block of items.  For all
passages of a text at once, the block maxima of each cell's distinct terms are added up; only passages that some block could lift
to the threshold walk the postings, by WAND: a pivot from list maxima, then block maxima, skipping what cannot reach the
threshold.  What is retrieved must hold the item's question (all but its last quarter of words) and its answer (the rest):
`overlap` of the word 3-grams of each, or both one behind the other with no more words changed, inserted or missing than
1 - `overlap` of each, where a few edits are always allowed (`slack`), since one edit breaks three grams and short parts have few.

The index is built per task from a shard of items of at most `shard_bytes`, which bounds the table of block maxima (distinct
words x blocks); larger benchmarks are taken shard by shard.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.llm.common import map_texts, read_table, text_bytes
from cueloom.llm.license_scan import words_of

K1, B = 1.2, 0.75
BLOCK = 4
GRAM = 3


def grams(words: list[bytes]) -> set:
    n = min(GRAM, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def question_and_answer(words: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    cut = len(words) - max(1, len(words) // 4)
    return words[:cut], words[cut:]


def slack(n: int, overlap: float) -> int:
    """Edits that a part of n words may have: 1 - overlap of its words, or up to three where that is less (one of 2 words, two of 4, three of 8)."""
    return max(int((1 - overlap) * n + 1e-9), min(3, n // 4 + 1) if n > 1 else 0)


def edits(part: np.ndarray, passage: np.ndarray) -> np.ndarray:
    """For every end in the passage the fewest edits that make `part` of a stretch that ends there."""
    steps = np.arange(len(passage) + 1)
    cost = np.zeros(len(passage) + 1, np.int64)
    for word in part:
        new = cost + 1
        new[1:] = np.minimum(new[1:], cost[:-1] + (passage != word))
        cost = np.minimum.accumulate(new - steps) + steps
    return cost


def aligned(question: np.ndarray, answer: np.ndarray, passage: np.ndarray, overlap: float) -> tuple[float, float] | None:
    """Shares of question and answer left by the fewest edits, if both stand one behind the other within their slack."""
    most = [slack(len(p), overlap) for p in (question, answer)]
    if any(len(p) - np.isin(p, passage).sum() > m for p, m in zip((question, answer), most, strict=True)):
        return None
    q, a = edits(question, passage), edits(answer[::-1], passage[::-1])[::-1]
    fits = np.flatnonzero((q <= most[0]) & (a <= most[1]))
    if not len(fits):
        return None
    at = fits[np.argmin((q + a)[fits])]
    return tuple(1 - float(c[at]) / len(p) if len(p) else 1.0 for c, p in ((q, question), (a, answer)))


class Index:
    """Postings (item numbers ascending, normalised weights) with list and block maxima."""

    def __init__(self, items: list[tuple[int, list[bytes]]], n_items: int, mean_length: float, frequency: dict[bytes, int], least: float):
        self.items, self.least = items, least
        self.longest = max((len(w) for _, w in items), default=1)
        idf = {t: math.log(1 + (n_items - f + 0.5) / (f + 0.5)) for t, f in frequency.items()}
        lists: dict[bytes, list[tuple[int, float]]] = {}
        for i, (_, words) in enumerate(items):
            bm = {t: idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_length)) for t, tf in Counter(words).items()}
            whole = sum(bm.values())
            for t, w in bm.items():
                lists.setdefault(t, []).append((i, w / whole))
        self.number = {t: k for k, t in enumerate(lists)}
        self.numbered = [[np.array([self.number[w] for w in part], np.int64) for part in question_and_answer(words)] for _, words in items]
        self.ids = [[i for i, _ in p] for p in lists.values()]
        self.weights = [[w for _, w in p] for p in lists.values()]
        self.top = [max(w) for w in self.weights]
        self.maxima = np.zeros((len(lists) + 1, math.ceil(len(items) / BLOCK)), np.float32)  # the last row is for words of no item
        for k, (ids, weights) in enumerate(zip(self.ids, self.weights, strict=True)):
            np.maximum.at(self.maxima[k], np.array(ids) // BLOCK, np.array(weights, np.float32))

    def retrieve(self, terms: list[int]) -> dict[int, float]:
        """Every item whose score with these distinct terms is at least `least`."""
        at = dict.fromkeys(terms, 0)
        found, need = {}, self.least - 1e-6
        while True:
            order = sorted((self.ids[t][p], t) for t, p in at.items() if p < len(self.ids[t]))
            bound, pivot = 0.0, -1
            for k, (_, t) in enumerate(order):
                bound += self.top[t]
                if bound >= need:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = order[pivot][0]
            while pivot + 1 < len(order) and order[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            jump = min((block + 1) * BLOCK, order[pivot + 1][0] if pivot + 1 < len(order) else len(self.items))
            if sum(self.maxima[t, block] for _, t in order[: pivot + 1]) < need:  # no item of these blocks can reach the threshold
                for _, t in order[: pivot + 1]:
                    at[t] = bisect_left(self.ids[t], max(jump, item + 1), at[t])
                continue
            score = 0.0
            for _, t in order[: pivot + 1]:
                p = at[t] = bisect_left(self.ids[t], item, at[t])
                if p < len(self.ids[t]) and self.ids[t][p] == item:
                    score += self.weights[t][p]
                    at[t] = p + 1
            if score >= need:
                found[item] = score

    def search(self, words: list[bytes], overlap: float) -> list[tuple[int, float, float, float, int]]:
        """(item id, score, question overlap, answer overlap, first word of the passage) of the verified items of one text."""
        get = self.number.get
        numbers = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        cells = max(1, math.ceil(len(words) / self.longest))
        known = np.flatnonzero(numbers >= 0)
        once = np.unique(known // self.longest * len(self.maxima) + numbers[known])
        bound = np.zeros((cells + 1, self.maxima.shape[1]), np.float32)
        if len(once):
            cell = once // len(self.maxima)
            edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            bound[cell[edge]] = np.add.reduceat(self.maxima[once % len(self.maxima)], edge)
        best: dict[int, tuple] = {}
        for c in np.flatnonzero((bound[:-1] + bound[1:]).max(axis=1) >= self.least - 1e-5).tolist():
            lo, hi = c * self.longest, (c + 2) * self.longest
            own = None
            wide = hi + 2 * slack(self.longest, overlap)  # inserted words may push the longest items over the passage's end
            for i, score in self.retrieve([t for t in np.unique(numbers[lo:hi]).tolist() if t >= 0]).items():
                own = own if own is not None else grams_of(words[lo:hi])
                item, text = self.items[i]
                q, a = (sum(g in own for g in part) / len(part) if part else 1.0 for part in map(grams, question_and_answer(text)))
                close = None if q >= overlap and a >= overlap else aligned(*self.numbered[i], numbers[lo:wide], overlap)
                if close:
                    q, a = max(q, close[0]), max(a, close[1])
                if (close or q >= overlap and a >= overlap) and (item not in best or (q + a, score) > (best[item][2] + best[item][3], best[item][1])):
                    best[item] = (item, score, q, a, lo)
        return sorted(best.values())


def grams_of(words: list[bytes]) -> set:
    """All grams up to GRAM words: an item shorter than that is held against its whole sequence."""
    return {tuple(words[i : i + n]) for n in range(1, GRAM + 1) for i in range(len(words) - n + 1)}


def index_shards(items: DataFrame, least: float, shard_bytes: int, id_col: str = "item_id", text_col: str = "text"):
    """A builder of one index per shard of items; corpus statistics are those of all items.  Items without words match nothing."""
    parsed = map_texts(items.where(F.col(id_col).isNotNull()), lambda: lambda i, t: (i, words_of(text_bytes(t))), "doc_id long, words array<binary>", id_col, text_col).where("size(words) > 0")
    facts = parsed.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"), F.sum(F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + F.length(w) + 1)).alias("bytes")).first()
    if not facts["n"]:
        return
    shards = max(1, math.ceil(facts["bytes"] / shard_bytes))
    seen = parsed.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").count()
    for s in range(shards):
        part = parsed.where(F.pmod(F.xxhash64("doc_id"), F.lit(shards)) == s)
        rows = sorted((r["doc_id"], [bytes(w) for w in r["words"]]) for r in part.collect())
        if not rows:
            continue
        mine = part.select(F.explode("words").alias("w")).distinct()
        frequency = {bytes(r["w"]): r["count"] for r in mine.join(seen, "w").collect()}
        yield lambda rows=rows, frequency=frequency: Index(rows, facts["n"], facts["mean"], frequency, least)


def contaminated(docs: DataFrame, items: DataFrame, least: float = 0.6, overlap: float = 0.8, shard_bytes: int = 256 << 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, first_word) of every item that a text holds, best passage each.

    Null and empty texts hold nothing, repeated rows give repeated rows, items with a null id or no words are left out, empty
    tables give no rows; a null doc_id is reported as null.
    """
    schema = "doc_id long, found array<struct<item_id:long,score:double,question_overlap:double,answer_overlap:double,first_word:long>>"
    names = ("item_id", "score", "question_overlap", "answer_overlap", "first_word")
    out = docs.sparkSession.createDataFrame([], schema)
    for build in index_shards(items, least, shard_bytes):

        def each(build=build):
            index = build()
            return lambda doc, text: (doc, [dict(zip(names, x, strict=True)) for x in index.search(words_of(text_bytes(text)), overlap)])

        out = out.unionByName(map_texts(docs, each, schema, id_col, text_col))
    return out.select("doc_id", F.inline("found"))


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))
