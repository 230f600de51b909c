"""Harmonic packing of token ids into sequences of one capacity C.

Lengths fall into reciprocal-capacity classes: class k holds lengths up to C // k and a bin of class k takes exactly k of
them.  Each worker fills the bins of every class on its own while it tokenizes, with one open bin per class.  Documents are cut
into full sequences; the remainder is cut at class shares wherever an uncut piece would waste more than `tolerance` tokens.
What is left in the workers' open bins (fewer than k pieces per class and worker) is numbered across workers by prefix sums of
(class, worker) counts and fills bins of the same classes; the last, incomplete bin of each class (together a constant number
of pieces, whatever the corpus) is settled by first fit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueloom.llm.common import cut_lineage, id_text, read_table, text_bytes

CLASSES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128)
#: Entries of a worker's table, some 250 bytes each, and bytes of text that are split at once.
CACHE_WORDS, PART_BYTES = 250_000, 1 << 20
#: Letters whose lower case and composed form are the same in every Unicode library; runs of them are single pre-tokens.
PLAIN = "^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[^A-Za-z0-9\u0080-\U0010ffff'\\x09-\\x0D\\x1C-\\x20<|>]*)$"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, k int, worker long, place long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """Chunk between blanks -> its ids as little-endian 32-bit bytes.

    The tokenizer drops white space and never joins across it, so a text's ids are its chunks' ids in a row.  A chunk of plain
    letters and trailing marks is its lower-case word's ids and its marks' ids, so only those have entries.  Unknown
    plain words, which the normalizer leaves as they are and the pattern in one piece, are encoded in one call.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        whole = Tokenizer.from_file(path)
        self.encode = whole.encode
        self.plain = Tokenizer(whole.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.plain.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # the last id of a word
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def __missing__(self, chunk: str) -> bytes:
        self[chunk] = value = b"".join(i.to_bytes(4, "little") for i in self.encode(chunk, add_special_tokens=False).ids)
        return value

    def learn(self, words: list[str]) -> None:
        """Enter plain lower-case words."""
        if words:
            ids = np.array(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
            ends = 4 * (np.flatnonzero(self.closes[ids]) + 1)
            if len(ends) == len(words) and ends[-1] == 4 * len(ids):  # else each goes on its own
                data, at = ids.tobytes(), ends.tolist()
                self.update(zip(words, [data[lo:hi] for lo, hi in zip([0, *at[:-1]], at, strict=True)], strict=True))

    def texts_ids(self, texts: pa.StringArray) -> list[bytes]:
        """The ids of every text: its chunks' words and marks in turn, each distinct one looked up once."""
        if len(self) > CACHE_WORDS:
            self.clear()
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        parts = pc.extract_regex(coded.dictionary, PLAIN)
        odd = pc.is_null(parts)
        word = pc.if_else(odd, coded.dictionary, pc.utf8_lower(pc.struct_field(parts, 0))).dictionary_encode()
        marks = pc.if_else(odd, "", pc.struct_field(parts, 1)).dictionary_encode()
        others = set(strings(coded.dictionary.filter(odd)))
        words = strings(word.dictionary)
        self.learn([w for w in words if w not in self and w not in others])
        values = [self[w] for w in words] + [self[m] for m in strings(marks.dictionary)]
        sizes = np.array(list(map(len, values)), np.int64) // 4
        begin = np.cumsum(sizes) - sizes
        chunk = coded.indices.to_numpy()
        at = np.stack([word.indices.to_numpy()[chunk], marks.indices.to_numpy()[chunk] + len(words)], axis=1).reshape(-1)
        edges = np.cumsum(np.append(0, sizes[at]))
        places = np.repeat(begin[at] - edges[:-1], sizes[at]) + np.arange(edges[-1])
        ids = np.frombuffer(b"".join(values), "<u4")[places]
        cuts = edges[2 * (split.offsets.to_numpy() - split.offsets[0].as_py())].tolist()
        return [ids[lo:hi].tobytes() for lo, hi in zip(cuts, cuts[1:], strict=False)]


def strings(values: pa.StringArray) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def texts_of(batch: pa.RecordBatch) -> Iterator[tuple[list, pa.StringArray]]:
    """(ids, texts) of a batch in parts of about PART_BYTES; null is empty, what is no UTF-8 becomes replacement marks."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
    part = np.cumsum(sizes, dtype=np.int64) // PART_BYTES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)] if len(part) else []
    for lo, hi in zip(edges, edges[1:], strict=False):
        rows = batch.slice(lo, hi - lo)
        try:
            texts = pc.fill_null(rows.column(1).cast(pa.string()), "")
        except pa.ArrowInvalid:
            texts = pa.array([text_bytes(t.as_py()).decode("utf-8", "replace") for t in rows.column(1)], pa.string())
        yield rows.column(0).to_pylist(), texts


def shares(capacity: int, classes=CLASSES) -> list[tuple[int, int]]:
    """(k, longest piece) per class, longest first; classes whose share would be empty fall out."""
    return [(k, capacity // k) for k in classes if capacity // k]


def cut_table(capacity: int, tolerance: int, classes=CLASSES) -> list[tuple[tuple[int, int], ...]]:
    """For each remainder below the capacity: its pieces as (length, k)."""
    share = shares(capacity, classes)
    table: list[tuple] = [()]
    for r in range(1, capacity):
        at = max(i for i, (_, s) in enumerate(share) if s >= r)
        k, s = share[at]
        if s - r > tolerance and at + 1 < len(share):
            k, s = share[at + 1]
            table.append(((s, k), *table[r - s]))
        else:
            table.append(((r, k),))
    return table


def pack_workers(docs: DataFrame, capacity: int, tolerance: int, end_id: int, path: str, id_col: str, text_col: str) -> DataFrame:
    """Pieces; those in bins that a worker could not fill carry a null sequence_id and their number `place` within (k, worker)."""
    end = end_id.to_bytes(4, "little")

    def run(batches):
        words, table = WordIds(path), cut_table(capacity, tolerance)
        worker = TaskContext.get().partitionId()
        open_bins: dict[int, list] = {}
        closed: list[tuple] = []
        made = 0

        def settle(k: int, piece: tuple) -> None:
            nonlocal made
            held = open_bins.setdefault(k, [])
            held.append(piece)
            if len(held) == k:
                at = 0
                for p in held:
                    closed.append((*p, (worker << 31) + made, at, k, worker, None))
                    at += p[2]
                made += 1
                open_bins[k] = []

        for batch in batches:
            for numbers, texts in texts_of(batch):
                for doc, ids in zip(numbers, words.texts_ids(texts), strict=True):
                    ids += end
                    n, at = len(ids) // 4, 0
                    for length, k in [*[(capacity, 1)] * (n // capacity), *table[n % capacity]]:
                        settle(k, (doc, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), n))
                        at += length
                    if len(closed) > 20_000:
                        yield to_batch(closed)
                        closed.clear()
        for k, held in open_bins.items():
            closed.extend((*p, None, None, k, worker, i) for i, p in enumerate(held))
        if closed:
            yield to_batch(closed)

    return id_text(docs, id_col, text_col).mapInArrow(run, PIECES)


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int32() if n == "k" else pa.int64()) for c, n in zip(zip(*rows), names, strict=True)], names=names)


def pack(docs: DataFrame, capacity: int = 2048, tolerance: int = 16, end_id: int = 1, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every row is in exactly one piece; a null or empty text is the end id alone.  Repeated rows are packed each, a
    null doc_id stays null, an empty table gives no rows, other columns are not read.
    """
    path = path or default_tokenizer()
    pieces = cut_lineage(pack_workers(docs, capacity, tolerance, end_id, path, id_col, text_col))
    rest = pieces.where(F.col("sequence_id").isNull())
    counts = rest.groupBy("k", "worker").count()
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("k").orderBy("worker")) - F.col("count"))
    before = before.withColumn("all", F.sum("count").over(Window.partitionBy("k"))).drop("count")
    numbered = rest.join(before, ["k", "worker"]).withColumn("n", F.col("before") + F.col("place"))
    numbered = numbered.withColumn("bin", F.floor(F.col("n") / F.col("k"))).withColumn("full", (F.col("bin") + 1) * F.col("k") <= F.col("all"))
    in_bin = Window.partitionBy("k", "bin").orderBy("n")
    shared = numbered.where("full").withColumn("offset", F.sum("length").over(in_bin) - F.col("length"))
    shared = shared.withColumn("sequence_id", F.lit(1 << 61) + F.col("k") * F.lit(1 << 40) + F.col("bin"))

    def first_fit(rows):
        rows = rows.sort_values(["length", "k", "n"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        used: list[int] = []
        for i, length in enumerate(rows["length"]):
            at = next((b for b, u in enumerate(used) if u + length <= capacity), len(used))
            if at == len(used):
                used.append(0)
            rows.loc[i, "sequence_id"], rows.loc[i, "offset"] = (1 << 62) + at, used[at]
            used[at] += length
        return rows

    tail = numbered.where("not full").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "k", "n")
    tail = tail.groupBy().applyInPandas(first_fit, tail.schema)
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pieces.where(F.col("sequence_id").isNotNull()).select(out).unionByName(shared.select(out)).unionByName(tail.select(out))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(read_table(spark, folder, "documents"))
