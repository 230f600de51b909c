"""Quality rules by tokeniser fertility: how public vocabularies cut a text, against bands of its language or script.

One pass over whole texts counts the plain statistics and, for texts that pass the plain rules, measures how two public vocabularies
(one of word pieces with byte fallback, one of bytes for many languages) cut their words: characters per token of either, the share
of byte-fallback tokens, and the entropy of the token distribution.  A text's tokens are those of its words joined by single blanks, taken
a stretch at a time.

The bands come from all measured texts.  Measures are integers (thousandths), so a group's median and median deviation are read exactly
from a histogram with few bins that Spark sums on the map side; no group is gathered.  A band is the median and `width` robust standard
deviations, at least a stated share of the median, to either side; of the byte-fallback share only the upper side counts.  Entropy has
bands per group and power of two of the token count, since it grows with the length.  A group is a language, or the script of most
characters where the language is null or that of fewer than one text in `RARE`; hence groups are bounded in number and can be broadcast.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.llm.common import cut_lineage, read_table

RARE = 1000
#: Words are cut by blanks after as many characters before they are tokenised.
LONGEST_WORD = 1024
STRETCH = 1 << 20
SYMBOLS = b"#*$%&|<>"
BLANK = re.compile(rb"[\x20\x09-\x0D]")
BLANKS_AND_TAILS = bytes([32, *range(9, 14), *range(0x80, 0xC0)])
#: First and last code point of the letters that name a script; anything else that is a letter, or lies beyond 0xFFFF, counts as "other".
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x531, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F),
    ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F), ("latin", 0x1E00, 0x1EFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7A3), ("han", 0x20000, 0x323AF),
)
NAMES = [*dict.fromkeys(s for s, _, _ in SCRIPTS), "other", "none"]
#: Measure -> (half width at least this share of the median, at least this many thousandths, only the upper side counts).
MEASURES = {"piece_chars": (0.08, 0, False), "byte_chars": (0.08, 0, False), "fallback": (0.0, 50, True), "entropy": (0.06, 0, False)}
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
SCHEMA = f"doc_id long, lang string, script string, {COUNTS}, size_class int, " + ", ".join(f"{m} int" for m in MEASURES)


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def script_table() -> np.ndarray:
    """Script number of each code point below 0x10000; 255 for what is no letter."""
    names = [*dict.fromkeys(s for s, _, _ in SCRIPTS), "other"]
    table = np.full(0x10000, 255, np.uint8)
    table[[c for c in range(0x10000) if chr(c).isalpha()]] = names.index("other")
    for name, lo, hi in SCRIPTS:
        block = table[lo : hi + 1]
        block[block != 255] = names.index(name)
    return table


class Vocabularies:
    """Counts tokens of words joined by single blanks, and their letters by script."""

    def __init__(self, piece_path: str, byte_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        with open(byte_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.fallback = np.array([self.pieces.is_byte(i) for i in range(self.pieces.vocab_size())])
        self.scripts = script_table()

    def count(self, text: bytes) -> tuple[np.ndarray, int, np.ndarray]:
        """Uses of each piece, number of byte-vocabulary tokens, letters of each script."""
        use, other, letters = np.zeros(len(self.fallback), np.int64), 0, np.zeros(256, np.int64)
        for run in word_runs(text):
            joined = b" ".join(run).decode("utf-8", "replace")
            if max(map(len, run), default=0) > LONGEST_WORD:
                joined = re.sub(f"([^ ]{{{LONGEST_WORD}}})", r"\1 ", joined)
            use += np.bincount(self.pieces.encode(joined), minlength=len(use))
            other += len(self.bytes.encode_ordinary(joined))
            points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            letters += np.bincount(self.scripts[points[points < 0x10000]], minlength=256)
            far = points[points >= 0x10000]
            han = int(((far >= 0x20000) & (far <= 0x323AF)).sum())
            letters[NAMES.index("han")] += han
            letters[NAMES.index("other")] += len(far) - han
        return use, other, letters[: len(NAMES) - 1]


def word_runs(text: bytes) -> Iterator[list[bytes]]:
    """The words in order, for a stretch of text at a time."""
    at = 0
    while at < len(text):
        cut = BLANK.search(text, at + STRETCH) if at + STRETCH < len(text) else None
        end = cut.end() if cut else len(text)
        yield text[at:end].split()
        at = end


def repeated_words(ids: np.ndarray) -> int:
    """Words that stand in a 3-word window whose word sequence occurs twice or more."""
    if len(ids) < 4:
        return 0
    _, pairs = np.unique(ids[:-1] * (ids.max() + 1) + ids[1:], return_inverse=True)
    _, windows, often = np.unique(pairs[:-1] * (ids.max() + 1) + ids[2:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(often[windows] > 1)
    covered = np.zeros(len(ids), bool)
    for i in range(3):
        covered[starts + i] = True
    return int(covered.sum())


def repeated_lines(text: bytes) -> int:
    seen, again = set(), 0
    for line in text.split(b"\n"):
        if line.strip():
            again += line in seen
            seen.add(line)
    return again


def measure(text: bytes | None, vocabularies: Vocabularies) -> tuple:
    """script, the counts, base_failed, size class and measures (null where the plain rules fail)."""
    text = text or b""
    number: dict[bytes, int] = {}
    ids = np.concatenate([np.zeros(0, np.int64), *(np.array([number.setdefault(w, len(number)) for w in run], np.int64) for run in word_runs(text))])
    n, again = len(ids), repeated_words(ids)
    failed = n < 50 or 100 * again > 50 * n
    counts = (n, len(text.translate(None, BLANKS_AND_TAILS)), len(text) - len(text.translate(None, SYMBOLS)), repeated_lines(text), again, failed)
    if failed:
        return None, *counts, None, *[None] * len(MEASURES)
    use, other, letters = vocabularies.count(text)
    total = int(use.sum())
    share = use[use > 0] / total
    values = (counts[1] / total, counts[1] / other, int(use[vocabularies.fallback].sum()) / total, float(-(share * np.log2(share)).sum()))
    return NAMES[int(letters.argmax()) if letters.any() else -1], *counts, total.bit_length(), *(round(1000 * v) for v in values)


def measured(docs: DataFrame, piece_path: str, byte_path: str, id_col: str, text_col: str, lang_col: str | None) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches):
        vocabularies = Vocabularies(piece_path, byte_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                rows = [measure(part.column(2)[i].as_py(), vocabularies) for i in range(part.num_rows)]
                columns = [part.column(0), part.column(1), *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[2:], strict=True))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), lang.alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, SCHEMA)


def bands(grouped: DataFrame, width: float) -> DataFrame:
    """Per measure, group and size class (-1 but for entropy): the least and greatest value allowed, in thousandths."""
    kinds = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("value"), (F.col("size_class") if m == "entropy" else F.lit(-1)).alias("at")) for m in MEASURES))
    bins = grouped.where("not base_failed").select("band_group", F.explode(kinds).alias("m")).groupBy("m.measure", "band_group", "m.at", "m.value").count()
    keys = ["measure", "band_group", "at"]
    middle = bins.groupBy(*keys).agg(F.percentile("value", 0.5, F.col("count")).alias("middle"))
    away = bins.join(middle, keys).groupBy(*keys, "middle").agg(F.percentile(F.abs(F.col("value") - F.col("middle")), 0.5, F.col("count")).alias("away"))

    def of(at: int) -> Column:
        return F.create_map(*(x for m, v in MEASURES.items() for x in (F.lit(m), F.lit(v[at]).cast("double"))))[F.col("measure")]

    half = F.greatest(width * 1.4826 * F.col("away"), of(0) * F.col("middle"), of(1))
    return away.select(*keys, F.when(of(2) > 0, F.lit(float("-inf"))).otherwise(F.col("middle") - half).alias("least"), (F.col("middle") + half).alias("most"))


def fertility_rules(docs: DataFrame, width: float = 6.0, vocabularies: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and band_group,
    size_class, piece_chars, byte_chars, fallback, entropy (thousandths) and outside (the measures out of their bands, joined by commas).

    Null, empty and blank texts have no words and fail the plain rules; texts that fail them are not tokenised, so their measures are
    null.  Every row counts towards the bands, repeated ones each; a group of one or two texts lies within its own band.  Null ids
    stay null, other columns are not read, an empty table gives no rows.  `lang_col=None` uses scripts alone.
    """
    rows = cut_lineage(measured(docs, *(vocabularies or default_vocabularies()), id_col, text_col, lang_col))
    passed = rows.where("not base_failed")
    total = passed.count()
    usual = passed.where("lang is not null").groupBy("lang").count().where(F.col("count") * RARE > total).select("lang", F.lit(True).alias("usual"))  # fewer than RARE rows
    grouped = rows.join(F.broadcast(usual), "lang", "left").withColumn("band_group", F.when(~F.col("base_failed"), F.when(F.col("usual"), F.concat(F.lit("lang:"), "lang")).otherwise(F.concat(F.lit("script:"), "script"))))
    limits = cut_lineage(bands(grouped, width))
    flat = limits.where("at = -1").groupBy("band_group").agg(*(F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}") for m in MEASURES if m != "entropy" for side in ("least", "most")))
    entropy = limits.where("at >= 0").select("band_group", F.col("at").alias("size_class"), F.col("least").alias("entropy_least"), F.col("most").alias("entropy_most"))
    judged = grouped.join(F.broadcast(flat), "band_group", "left").join(F.broadcast(entropy), ["band_group", "size_class"], "left")  # RARE groups and scripts, times 64 classes at most
    out = F.concat_ws(",", *(F.when(~F.col(m).between(F.col(f"{m}_least"), F.col(f"{m}_most")), F.lit(m)) for m in MEASURES))
    judged = judged.withColumn("outside", out).withColumn("kept", ~F.col("base_failed") & (F.col("outside") == ""))
    return judged.select("doc_id", *(c.split()[0] for c in COUNTS.split(", ")), "kept", "band_group", "size_class", *MEASURES, "outside")


def op11_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return fertility_rules(read_table(spark, folder, "documents"))
