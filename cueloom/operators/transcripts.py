"""Transcript work: scoring, sentence split, glossary, budgets, corrections and personas suggested by speech."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions import text as tx
from cueloom.functions.cols import count_if, safe_div
from cueloom.operators import sequence as seq
from cueloom.session import spread


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Per cue: normalised lengths, character and word error rate, edit similarity."""
    ref, hyp = tx.normalise_transcript(F.col("ref_text")), tx.normalise_transcript(F.col("hyp_text"))
    return spread(pairs, "media_id", "ord").select(
        "media_id", "ord", F.length(ref).alias("ref_chars"), F.length(hyp).alias("hyp_chars"),
        tx.cer(F.col("ref_text"), F.col("hyp_text")).alias("cer"), tx.edit_similarity(ref, hyp).alias("similarity"),
    )


def word_errors(pairs: DataFrame) -> DataFrame:
    return spread(pairs, "media_id", "ord").select("media_id", "ord", tx.wer(F.col("ref_text"), F.col("hyp_text")).alias("wer"))


def character_overlap(pairs: DataFrame) -> DataFrame:
    """Order-free character similarity and length ratio of candidate texts."""
    a, b = F.col("ref_text"), F.col("hyp_text")
    return spread(pairs, "media_id", "ord").select("media_id", "ord", tx.multiset_similarity(a, b).alias("similarity"), tx.length_ratio(a, b).alias("length_ratio"))


def token_dropout(pairs: DataFrame) -> DataFrame:
    """Target tokens missing from the read-back.

    Counts per (line, token) are aggregated before the two sides meet, so the work is linear in the tokens of a line.
    """
    key = ["media_id", "ord"]

    def counts(column: str, name: str) -> DataFrame:
        return pairs.select(*key, F.explode(tx.speech_tokens(F.col(column))).alias("t")).groupBy(*key, "t").agg(F.count(F.lit(1)).alias(name))

    both = counts("ref_text", "w").join(counts("hyp_text", "h"), [*key, "t"], "left")
    sums = both.groupBy(*key).agg(F.sum("w").alias("total"), F.sum(F.greatest(F.lit(0), F.col("w") - F.coalesce("h", F.lit(0)))).alias("missing"))
    return pairs.select(*key).join(sums, key, "left").fillna(0, ["total", "missing"])


def transcript_scores(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """One row per media: error rate of the joined transcript, median duration, short share, speakers, switch rate.

    The edit distance is defined on one document, so a media's cues are joined into one text; nothing else is collected.
    """
    def joined(column: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", column))), lambda s: s[column]), "")

    docs = spread(pairs, "media_id").groupBy("media_id").agg(joined("ref_text").alias("r"), joined("hyp_text").alias("h"))
    ref, hyp = tx.normalise_transcript(F.col("r")), tx.normalise_transcript(F.col("h"))
    distances = docs.select("media_id", ref.alias("r"), hyp.alias("h")).select(
        "media_id", F.length("r").alias("ref_chars"), F.length("h").alias("hyp_chars"), tx.document_distance(F.col("r"), F.col("h")).alias("edits"))
    distances = distances.withColumn("cer", safe_div(F.col("edits"), F.col("ref_chars"))).withColumn(
        "similarity", tx.similarity_of(F.col("edits"), F.col("ref_chars"), F.col("hyp_chars")))
    return distances.join(pace(segments), "media_id")


def pace(segments: DataFrame) -> DataFrame:
    """Segment count, median duration (integer ms), share of segments up to 1 s, speakers and switch rate per media."""
    labelled = segments.filter(F.coalesce("speaker_label", F.lit("")) != "")
    rows = seq.prefix(labelled, ["media_id"], {"_prev": ("lag", F.col("speaker_label"))}, pos="ord")
    switches = rows.groupBy("media_id").agg(
        count_if(F.col("_prev") != F.col("speaker_label")).alias("switches"), F.count(F.lit(1)).alias("labelled"),
        F.count_distinct("speaker_label").alias("speakers"))
    base = segments.groupBy("media_id").agg(
        F.count(F.lit(1)).alias("segment_count"), F.percentile("dur_ms", 0.5).alias("median_ms"),
        (count_if(F.col("dur_ms") <= 1000) / F.count(F.lit(1))).alias("short_ratio"))
    rate = F.when(F.col("labelled") > 1, F.col("switches") / (F.col("labelled") - 1)).otherwise(0.0)
    return base.join(switches, "media_id", "left").withColumn("switch_rate", rate).drop("switches", "labelled")


def split_regions(regions: DataFrame) -> DataFrame:
    """A region's sentences share its time by length; the last one ends with the region."""
    pieces = F.filter(F.transform(F.split("text", "[。！？!?]+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    total = F.aggregate(F.col("pieces"), F.lit(0), lambda acc, s: acc + F.length(s))
    rows = regions.withColumn("pieces", pieces).withColumn("total_chars", total).select(
        "media_id", "ord", "start_ms", "end_ms", "total_chars", F.size("pieces").alias("n"), F.col("pieces"),
        F.posexplode("pieces").alias("sentence_no", "sentence"))

    def cut(upto: Column) -> Column:
        chars = F.aggregate(F.slice("pieces", F.lit(1), upto), F.lit(0), lambda acc, s: acc + F.length(s))
        return F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) * chars / F.col("total_chars")).cast("long")

    last = F.col("sentence_no") == F.col("n") - 1
    return rows.select(
        "media_id", "ord", "sentence_no", "sentence", cut(F.col("sentence_no")).alias("start_ms"),
        F.when(last, F.col("end_ms")).otherwise(cut(F.col("sentence_no") + 1)).alias("end_ms"))


def apply_glossary(lines: DataFrame, entries: list[tuple[str, list[str], str]]) -> DataFrame:
    """Replace variants in entry order, longest variant first; `matches` records what was replaced.

    A glossary is a short configured list, so it becomes a literal fold over the line instead of a join.
    """
    ordered = [(e, v, target) for e, variants, target in entries for v in sorted(variants, key=len, reverse=True)]
    table = F.array(*[F.struct(F.lit(e).alias("entry"), F.lit(v).alias("variant"), F.lit(t).alias("target")) for e, v, t in ordered])
    empty = F.array().cast("array<string>")
    folded = F.aggregate(
        table, F.struct(F.col("text").alias("text"), empty.alias("matches")),
        lambda acc, g: F.when(
            F.contains(acc["text"], g["variant"]),
            F.struct(F.replace(acc["text"], g["variant"], g["target"]).alias("text"),
                     F.array_append(acc["matches"], F.concat(g["entry"], F.lit(":"), g["variant"])).alias("matches")),
        ).otherwise(acc))
    return lines.withColumn("_g", folded).withColumn("glossed", tx.normalise_spaces(F.col("_g.text"))).withColumn(
        "matches", F.col("_g.matches")).drop("_g")


def merge_glossaries(user: DataFrame, built_in: DataFrame) -> DataFrame:
    """User entries plus the built-in entries whose id and normalised variants the user has not defined.

    Rows are one per (entry_id, variant).
    """
    def norm(df: DataFrame) -> DataFrame:
        return df.withColumn("norm", F.lower(tx.squeeze(F.col("variant"))))

    mine, theirs = norm(user), norm(built_in)
    clash = theirs.join(mine.select("norm").distinct(), "norm", "left_semi").select("entry_id").distinct()
    kept = theirs.join(mine.select("entry_id").distinct(), "entry_id", "left_anti").join(clash, "entry_id", "left_anti")
    return mine.unionByName(kept).drop("norm")


def normalise_target(source: Column, target: Column, matched: Column, replacement: Column, match_count: Column) -> Column:
    """A line that is nothing but one glossary term becomes the term's target."""
    same = F.lower(tx.squeeze(source)) == F.lower(tx.squeeze(matched))
    return F.when((match_count == 1) & (tx.squeeze(source) != "") & same, tx.normalise_spaces(replacement)).otherwise(
        tx.normalise_spaces(target))


def budget_summary(lines: DataFrame, key: list[str]) -> DataFrame:
    """Summed durations and the worst fit level per unit."""
    rank = F.when(F.col("fit_level") == "risky", 2).when(F.col("fit_level") == "review", 1).otherwise(0)
    sums = lines.groupBy(*key).agg(
        F.sum("source_ms").alias("source_ms"), F.sum("estimated_ms").alias("estimated_ms"), F.max(rank).alias("_w"))
    return sums.withColumn("ratio", F.col("estimated_ms") / F.greatest(F.lit(1), F.col("source_ms"))).withColumn(
        "fit_level", F.when(F.col("_w") == 2, "risky").when(F.col("_w") == 1, "review").otherwise("fit")).drop("_w")


def judge_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("media_id").agg(
        F.avg("judge_score").alias("mean"), F.min("judge_score").alias("min"), count_if(F.col("judge_score") < 3.0).alias("failed"),
        F.count("judge_score").alias("scored"))


# fixed values
INTRODUCTIONS = ("我是", "我叫")
ADDRESS_MARKS = ("，你", "，您", "！", "？", "：")
NAME_CHARS = "一-鿿A-Za-z"


def suggest_names(segments: DataFrame, limit: int = 3) -> DataFrame:
    """Persona names per speaker: self-introductions (1.2 each) and names others address them by (0.6 each).

    "Others" are counted as all addressed names of the media minus the speaker's own, so no speaker x segment product.
    """
    intro = F.regexp_extract("text", f"(?:{'|'.join(INTRODUCTIONS)})([{NAME_CHARS}]{{1,6}})", 1)
    hint = F.lit(None).cast("string")
    for mark in reversed(ADDRESS_MARKS):
        hint = F.when(F.contains("text", F.lit(mark)), F.substring_index("text", mark, 1)).otherwise(hint)
    head = F.regexp_replace(F.trim(hint), f"[^{NAME_CHARS}]", "")
    called = F.right(head, F.lit(4))
    rows = segments.select("media_id", "speaker_label", intro.alias("intro"), called.alias("called"))
    own = rows.filter("intro <> ''").groupBy("media_id", "speaker_label", F.col("intro").alias("name")).agg(
        (F.count(F.lit(1)) * 12).alias("w"))
    spoken = rows.filter(F.length("called") > 1).groupBy("media_id", "speaker_label", F.col("called").alias("name")).agg(
        F.count(F.lit(1)).alias("said"))
    total = spoken.groupBy("media_id", "name").agg(F.sum("said").alias("total"))
    speakers = segments.select("media_id", "speaker_label").distinct()
    addressed = (
        speakers.join(total, "media_id").join(spoken, ["media_id", "speaker_label", "name"], "left")
        .select("media_id", "speaker_label", "name", ((F.col("total") - F.coalesce("said", F.lit(0))) * 6).alias("w"))
        .filter("w > 0")
    )
    scored = own.unionByName(addressed).groupBy("media_id", "speaker_label", "name").agg(F.sum("w").alias("tenths"))
    order = Window.partitionBy("media_id", "speaker_label").orderBy(F.desc("tenths"), "name")
    top = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    kept = Window.partitionBy("media_id", "speaker_label")
    share = F.col("tenths") / F.greatest(F.lit(10), F.sum("tenths").over(kept))
    return top.withColumn("confidence", F.least(F.lit(0.95), share + 0.2))
