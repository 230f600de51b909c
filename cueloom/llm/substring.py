"""Substring dedup over words by level-wise doubling.

Level 0 takes windows of half the length n (one per n-word window, the least by hash, so every n-word window is represented).
Only where such a window is repeated across documents is it extended to n words, and a repeated n-word window to 2n, 4n, ...
up to `longest`: a window of twice the length is a candidate only if both its halves are repeated.  The removal rule needs
level n alone, since every longer repeat consists of repeated n-word windows; further levels tell how long repeats are.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from cueloom.llm import blocks as B
from cueloom.llm.common import read_table, text_bytes

OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, longest long, kept string"
SECOND = np.uint64(0xD6E8FEB86659FD93)
NOTHING = np.zeros(0, np.int64)


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        value = self[word] = xxh3_64_intdigest(word)
        return value


def word_values(words: list[bytes], known: WordHash) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def stretches_left(text: bytes, kept: np.ndarray) -> bytes:
    """The stretches of kept words, each with its own inner white space, one per line."""
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    on = np.flatnonzero(np.diff(np.concatenate([[False], kept, [False]]).astype(np.int8)))
    return b"\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in on.reshape(-1, 2).tolist())


class Block:
    """The windows of a block's documents, level by level, from its texts and the answers so far."""

    def __init__(self, window: int, start: int, buckets: int):
        self.window, self.start, self.buckets = window, start, buckets

    def read(self, group):
        known, self.docs, self.values, self.places = WordHash(), [], [], []
        for doc, text in B.texts_of(group):
            h = word_values(text_bytes(text).split(), known)
            if doc is None or len(h) < self.window:
                continue
            self.docs.append(doc)
            self.values.append(h)
        return self

    def halves(self):
        """(distinct hashes, index of each document's window anchors in them, held by more than one document)."""
        own, at = [], []
        for h in self.values:
            grams = B.rolling(h, self.start)
            place = B.anchors(grams, self.window - self.start + 1)
            at.append(B.keys_of(grams[place]))
            own.append(np.unique(at[-1]))
        every = np.concatenate(own) if own else np.zeros(0, np.uint64)
        keys, counts = np.unique(every, return_counts=True)
        return keys, at, counts > 1

    def windows(self, starts: list[np.ndarray], length: int):
        """Entries (hash pair, smallest document) of the given window starts, and each start's entry."""
        first, second, docs = [], [], []
        for doc, h, s in zip(self.docs, self.values, starts, strict=True):
            first.append(B.mix(B.rolling(h, length)[s]) if len(s) else np.zeros(0, np.uint64))
            second.append(B.rolling(B.mix(h + SECOND), length, SECOND)[s] >> np.uint64(32) if len(s) else np.zeros(0, np.uint64))
            docs.append(np.full(len(s), doc, np.int64))
        if not docs:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), NOTHING, [], np.zeros(0, bool)
        sizes = np.cumsum([len(x) for x in docs])[:-1]
        a, b, d = np.concatenate(first), np.concatenate(second), np.concatenate(docs)
        order = np.lexsort((d, b, a))
        a, b, d = a[order], b[order], d[order]
        new = B.firsts(a, b)
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(d))[: len(at)] - 1
        return a[at], b[at], d[at], np.split(entry, sizes), d[at] != d[last] if len(at) else np.zeros(0, bool)

    def level(self, answers, level: int, lengths: list[int]):
        """Window starts that are candidates at `level`, from the answers of the levels below."""
        keys, at, _ = self.halves()
        shared = B.bits_of(answers, 0)
        starts = [np.flatnonzero(shared[np.searchsorted(keys, x)]) for x in at]
        for i in range(1, level):
            _, _, _, entry, several = self.windows(starts, lengths[i])
            bits = self.shared_bits(answers, i) | several
            step, nearer = lengths[i + 1] - lengths[i], []
            for s, e, h in zip(starts, entry, self.values, strict=True):
                good = s[bits[e]] if len(s) else s
                good = good[np.isin(good + step, good)]
                nearer.append(good[good <= len(h) - lengths[i + 1]])
            starts = nearer
        return starts

    @staticmethod
    def shared_bits(answers, level: int) -> np.ndarray:
        parts = [np.unpackbits(np.frombuffer(r["masks"], np.uint8), count=r["n"]) for r in B.answers_in(answers, level)]
        return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def substring_dedup(docs: DataFrame, window: int = 13, start: int | None = None, longest: int | None = None, block_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove each word covered by a `window`-word string that also starts in a document with a smaller id.

    One row per input row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by blanks), longest (the longest
    level at which the row has a repeated window, 0 if none); with `texts` also kept (the text without the removed words: null
    stays null, an untouched text stays as it was, the stretches left of a cut one are joined by line feeds); `carry` adds a
    struct `rest` of the row's named columns.  Null texts have no words; rows with a null id are neither sources nor cut; rows that repeat an id do not cut each other; ties, empty tables
    and other columns need no care.
    """
    lengths = [start or (window + 1) // 2, window]
    while longest and lengths[-1] * 2 <= longest:
        lengths.append(lengths[-1] * 2)
    rows, _, buckets = B.dealt(docs, block_bytes, id_col, text_col, carry)
    grouped = rows.groupBy("block")

    def block():
        return Block(window, lengths[0], buckets)

    def emit_halves(key, group):
        own = block().read(group)
        keys, _, several = own.halves()
        return B.table([(b, key[0].as_py(), hi - lo, B.planes(keys[lo:hi]), np.packbits(several[lo:hi]).tobytes(), None, None) for b, lo, hi in B.cuts(keys, buckets)], B.ENTRIES)

    def emit_windows(level: int):
        def run(key, group, answers):
            own = block().read(group)
            a, b, d, _, _ = own.windows(own.level(answers, level, lengths), lengths[level])
            return B.table([(k, key[0].as_py(), hi - lo, B.planes(a[lo:hi]), B.planes(b[lo:hi]), B.planes(d[lo:hi].view(np.uint64)), None) for k, lo, hi in B.cuts(a, buckets)], B.ENTRIES)

        return run

    answers = B.answer_shared(grouped.applyInArrow(emit_halves, B.ENTRIES), 0)
    for level in range(1, len(lengths)):
        found = grouped.cogroup(answers.groupBy("block")).applyInArrow(emit_windows(level), B.ENTRIES)
        answers = answers.unionByName(B.answer_smaller(found, level))

    def remove(key, group, answers):
        own = block().read(group)
        starts = own.level(answers, 1, lengths)
        _, _, least, entry, several = own.windows(starts, window)
        outside = B.bits_of(answers, 1)
        repeated = own.shared_bits(answers, 1) | several
        reach = [window if len(e) and repeated[e].any() else 0 for e in entry]
        for level in range(2, len(lengths)):
            _, _, _, e2, s2 = own.windows(own.level(answers, level, lengths), lengths[level])
            bits = own.shared_bits(answers, level) | s2
            reach = [max(r, lengths[level] if len(e) and bits[e].any() else 0) for r, e in zip(reach, e2, strict=True)]
        at, out = 0, []
        for doc, text in B.texts_of(group):
            words = text_bytes(text).split()
            n = len(words)
            gone, far, left = 0, 0, text
            if doc is not None and n >= window:
                s, e = starts[at], entry[at]
                hit = s[outside[e] | (least[e] < doc)] if len(s) else s
                far, at = int(reach[at]), at + 1
                if len(hit):
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, hit, 1)
                    np.add.at(edge, hit + window, -1)
                    kept = np.cumsum(edge[:n]) == 0
                    gone = n - int(kept.sum())
                    words = [w for w, k in zip(words, kept.tolist(), strict=True) if k]
                    left = stretches_left(text, kept) if texts else None
            out.append((doc, n, gone, hashlib.sha256(b" ".join(words)).hexdigest(), far, left.decode("utf-8", "replace") if texts and left is not None else None))
        done = B.table(out, OUT)
        return done.append_column("rest", group.column("rest")) if carry else done

    schema = StructType.fromDDL(OUT)
    if carry:
        schema = schema.add(rows.schema["rest"])
    result = grouped.cogroup(answers.groupBy("block")).applyInArrow(remove, schema)
    return result if texts else result.drop("kept")


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup(read_table(spark, folder, "documents")).drop("longest")


OP9_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents),
     g AS (SELECT doc_id, s, array_to_string(l[s : s + 12], ' ') AS k FROM (SELECT doc_id, l, unnest(range(1, len(l) - 11)) AS s FROM w WHERE len(l) >= 13)),
     m AS (SELECT k, min(doc_id) AS low FROM g GROUP BY k),
     gone AS (SELECT doc_id, list_distinct(flatten(list(range(s, s + 13)))) AS r FROM g JOIN m USING (k) WHERE low < doc_id GROUP BY doc_id)
SELECT doc_id, len(l) AS n_words, coalesce(len(r), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN r IS NULL THEN l ELSE list_filter(l, lambda x, i: NOT list_contains(r, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""
