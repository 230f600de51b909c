"""Signal quality over long sample tables (id columns, i, value): one row per sample, any length, no arrays in memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions.cols import count_if
from cueloom.operators import sequence as seq


def _db(ratio: Column, scale: float = 10.0) -> Column:
    return F.log10(ratio) * scale


def distortion(samples: DataFrame, key: list[str], cap: float = 120.0) -> DataFrame:
    """SI-SDR and SDR of `estimate` against `reference`, capped; closed form over five sums."""
    e, r = F.col("estimate"), F.col("reference")
    s = samples.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.sum(e).alias("se"), F.sum(r).alias("sr"), F.sum(e * r).alias("er"), F.sum(e * e).alias("ee"), F.sum(r * r).alias("rr"))
    n = F.col("n")
    er, ee, rr = F.col("er") - F.col("se") * F.col("sr") / n, F.col("ee") - F.col("se") * F.col("se") / n, F.col("rr") - F.col("sr") * F.col("sr") / n
    target = er * er / rr
    noise = F.greatest(F.lit(1e-12), ee - target)
    residual = F.greatest(F.lit(1e-12), F.col("ee") - F.col("er") * 2 + F.col("rr"))
    top, low = F.lit(cap), F.lit(-cap)
    return s.select(*key, F.greatest(low, F.least(top, _db(F.greatest(F.lit(1e-12), target) / noise))).alias("si_sdr"),
                    F.greatest(low, F.least(top, _db(F.greatest(F.lit(1e-12), F.col("rr")) / residual))).alias("sdr"))


def separation_quality(samples: DataFrame, key: list[str]) -> DataFrame:
    """RMS of voice and background, their ratio in dB and the share of the mix left unexplained."""
    left = F.col("mix") - F.col("voice") - F.col("background")
    s = samples.groupBy(*key).agg(
        F.sqrt(F.avg(F.col("voice") * F.col("voice"))).alias("voice_rms"), F.sqrt(F.avg(F.col("background") * F.col("background"))).alias("background_rms"),
        F.sqrt(F.avg(left * left)).alias("residual_rms"), F.sqrt(F.avg(F.col("mix") * F.col("mix"))).alias("mix_rms"))
    return s.select(*key, "voice_rms", "background_rms", _db(F.greatest(F.lit(1e-9), F.col("voice_rms")) / F.greatest(F.lit(1e-9), F.col("background_rms")), 20.0).alias("ratio_db"),
                    (F.col("residual_rms") / F.greatest(F.lit(1e-9), F.col("mix_rms"))).alias("residual_ratio"))


def psnr(pixels: DataFrame, key: list[str], top: float = 255.0) -> DataFrame:
    """Peak signal-to-noise ratio over aligned pixel rows; NULL for identical images."""
    mse = pixels.groupBy(*key).agg(F.avg((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("mse"))
    return mse.withColumn("psnr", F.when(F.col("mse") > 0, _db(F.lit(top * top) / F.col("mse"))))


def overview(samples: DataFrame, key: list[str], buckets: int = 800) -> DataFrame:
    """RMS per equal hop of a signal, scaled by the loudest bucket."""
    sizes = samples.groupBy(*key).agg((F.max("i") + 1).alias("_n"))
    hop = F.greatest(F.lit(1), F.floor(F.col("_n") / buckets))
    rms = samples.join(sizes, key).groupBy(*key, F.least(F.floor(F.col("i") / hop), F.lit(buckets - 1)).alias("bucket")).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    peak = rms.groupBy(*key).agg(F.max("rms").alias("_peak"))
    return rms.join(peak, key).select(*key, "bucket", (F.col("rms") / F.greatest(F.lit(1e-9), F.col("_peak"))).alias("level"))


def audible_scorecard(rows: DataFrame) -> DataFrame:
    """Tempo, cut tails, dead air and back-read tiers of placed lines, pooled per media."""
    tempo = F.coalesce("tempo", F.col("generated_ms") / F.col("fitted_ms"))
    r = rows.withColumn("_tempo", F.round(tempo, 6)).withColumn("_dead", F.greatest(F.lit(0), F.col("source_ms") - F.col("fitted_ms")))
    return r.groupBy("media_id").agg(
        F.count(F.lit(1)).alias("lines"), count_if(F.col("_tempo") >= 1.40).alias("over_compressed"), count_if(F.col("trimmed_tail_ms") >= 300).alias("cut_tails"),
        count_if(F.col("text_similarity") >= 0.9).alias("clear"), count_if(F.col("text_similarity") < 0.7).alias("unclear"), count_if(F.col("speaker_similarity") < 0.25).alias("wrong_voice"),
        F.sum("_dead").alias("dead_air_ms"), F.percentile("_tempo", 0.5).alias("tempo_median"), F.percentile("_tempo", 0.9).alias("tempo_p90"))


def window_rms(samples: DataFrame, windows: DataFrame, bucket_ms: int = 10_000) -> DataFrame:
    """RMS of the samples (media_id, t_ms, value) inside each window, by a bucketed range join."""
    w = windows.select("media_id", "window_id", "start_ms", "end_ms", F.explode(F.sequence(F.floor(F.col("start_ms") / bucket_ms), F.floor((F.col("end_ms") - 1) / bucket_ms))).alias("_b"))
    s = samples.withColumn("_b", F.floor(F.col("t_ms") / bucket_ms))
    inside = s.join(w, ["media_id", "_b"]).filter((F.col("t_ms") >= F.col("start_ms")) & (F.col("t_ms") < F.col("end_ms")))
    return inside.groupBy("media_id", "window_id").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.count(F.lit(1)).alias("samples"))


# ---- audible score of a dub -------------------------------------------------------------------------------------------

# fixed values of the score: tiers, limits in milliseconds and decibels, weights of the penalties
TIMBRE = (0.45, 0.25)
BACK_READ = (0.90, 0.70)
FAST, TAIL_MS, DEAD_MS, DEAD_SHARE = 1.40, 300, 400, 0.80
LEAST_DB, MOST_DB = 3.0, 60.0
PENALTIES = {"undubbed": 30, "timbre": 22, "pace": 18, "buried": 14, "back_read": 10, "dead_air": 6}
PCM = 32_768


def range_energy(samples: DataFrame, windows: DataFrame, key: list[str], slot_ms: int = 60_000) -> DataFrame:
    """key, window_id: `energy` (sum of squares) and number of `samples` (key, t_ms, value) in [start_ms, end_ms), 0 where there are none.

    Both ends of a window are laid among the samples of its key and one ordered scan carries the running sum of squares past them; a
    window's energy is the difference of its two ends, so windows may overlap or be as long as the signal and are never joined to samples.
    Values count as 16-bit samples, whose sums are exact.
    """
    level = F.round(F.col("value") * PCM).cast("long")
    lined = samples.select(*key, "t_ms", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("window_id"), F.lit(0).alias("side"), (level * level).alias("e"))
    for at, side in (("start_ms", -1), ("end_ms", 1)):
        lined = lined.unionByName(windows.select(*key, F.col(at).alias("t_ms"), F.lit(0).alias("kind"), F.col("window_id").cast("long"), F.lit(side).alias("side"), F.lit(0).cast("long").alias("e")))
    passed = seq.scan(lined, key, ["t_ms", "kind", "window_id", "side"], F.floor(F.col("t_ms") / slot_ms), {"_e": ("sum", F.col("e")), "_n": ("sum", F.col("kind").cast("long"))})
    ends = passed.filter("kind = 0")
    return ends.groupBy(*key, "window_id").agg((F.sum(F.col("_e") * F.col("side")) / float(PCM * PCM)).alias("energy"), F.sum(F.col("_n") * F.col("side")).alias("samples"))


def signal_to_residual(samples: DataFrame, windows: DataFrame) -> DataFrame:
    """media_id, window_id, snr_db: level of the `dub` stem over the `residual` (mix without the dub) in each placement window, held to +-60 dB.

    Samples carry media_id, stem, t_ms, value.  Windows that are empty or end after the residual have none.
    """
    length = samples.filter("stem = 'residual'").groupBy("media_id").agg((F.max("t_ms") + 1).alias("_length"))
    inside = windows.filter("end_ms > start_ms").join(length, "media_id").filter(F.col("end_ms") <= F.col("_length"))
    both = inside.select("media_id", "window_id", "start_ms", "end_ms", F.explode(F.array(F.lit("dub"), F.lit("residual"))).alias("stem"))
    found = range_energy(samples, both, ["media_id", "stem"])
    rms = F.when(F.col("samples") > 0, F.sqrt(F.col("energy") / F.col("samples"))).otherwise(0.0)
    level = _db(F.greatest(rms, F.lit(1e-12)), 20.0)
    sides = [F.max(F.when(F.col("stem") == stem, level)).alias(stem) for stem in ("dub", "residual")]
    snr = F.greatest(F.lit(-MOST_DB), F.least(F.lit(MOST_DB), F.col("dub") - F.col("residual")))
    return found.groupBy("media_id", "window_id").agg(*sides).select("media_id", "window_id", snr.alias("snr_db"))


def dub_score(rows: DataFrame, snr: DataFrame, translated: DataFrame, most_tempo: float = 1.45) -> DataFrame:
    """One row per media: tiers of voice and back-read, pace, buried lines, problem count and the honest score out of 100.

    `rows`: placed lines (media_id, window_id, speaker_similarity, text_similarity, generated_ms, fitted_ms, source_ms, fit_strategy, tempo,
    trimmed_tail_ms, notes); `translated`: media_id, translated.  A recorded tempo counts as it is, else it follows from the durations.
    """
    cut = F.contains(F.coalesce("notes", F.lit("")), F.lit("overflow_trimmed"))
    made, fit, src = (F.coalesce(c, F.lit(0)).cast("double") for c in ("generated_ms", "fitted_ms", "source_ms"))
    squeezed = (cut | (F.coalesce("fit_strategy", F.lit("")) == "overflow_unfitted")) & (made > 0)
    tempo = F.when(F.col("tempo").isNotNull(), F.col("tempo")).when(squeezed, most_tempo).when((made > 0) & (fit > 0), made / fit).otherwise(1.0)
    tail = F.when(F.col("tempo").isNotNull(), F.coalesce("trimmed_tail_ms", F.lit(0)).cast("double")).when(squeezed, F.greatest(F.lit(0.0), made / most_tempo - fit)).otherwise(0.0)
    dead = (F.greatest(F.lit(0.0), src - fit) >= DEAD_MS) & (F.when(src > 0, fit / src).otherwise(1.0) < DEAD_SHARE)
    voice, read = F.col("speaker_similarity"), F.col("text_similarity")
    unlike = lambda c, least: F.when(F.coalesce(c, F.lit(0.0)) == 0, 1.0).otherwise(c) < least  # noqa: E731  a missing or zero measure is no problem
    problem = unlike(voice, TIMBRE[0]) | unlike(read, BACK_READ[0]) | (F.coalesce("fit_strategy", F.lit("")) == "overflow_unfitted") | cut
    r = rows.join(snr, ["media_id", "window_id"], "left").withColumns({"_tempo": tempo, "_tail": tail, "_dead": dead, "_problem": problem})
    good, bad = (lambda c, t: c >= t[0]), (lambda c, t: c < t[1])
    out = r.groupBy("media_id").agg(
        F.count(F.lit(1)).alias("placed"), count_if(good(voice, TIMBRE)).alias("voice_good"), count_if((voice < TIMBRE[0]) & (voice >= TIMBRE[1])).alias("voice_review"), count_if(bad(voice, TIMBRE)).alias("voice_bad"),
        count_if(good(read, BACK_READ)).alias("read_good"), count_if((read < BACK_READ[0]) & (read >= BACK_READ[1])).alias("read_review"), count_if(bad(read, BACK_READ)).alias("read_bad"),
        count_if(F.col("_tempo") >= FAST).alias("fast"), count_if(F.col("_tail") >= TAIL_MS).alias("cut_off"), F.coalesce(F.sum(F.when(F.col("_tail") >= TAIL_MS, F.round("_tail", 3))), F.lit(0.0)).alias("trimmed_ms"), count_if(F.col("_dead")).alias("dead_air"),
        count_if(F.col("fit_strategy") == "direct").alias("direct"), count_if(F.col("snr_db") < LEAST_DB).alias("buried"), F.coalesce(F.percentile("snr_db", 0.5), F.lit(0.0)).alias("snr_median_db"), F.coalesce(F.min("snr_db"), F.lit(0.0)).alias("snr_min_db"),
        F.percentile("_tempo", 0.5).alias("tempo_median"), F.percentile("_tempo", 0.9).alias("tempo_p90"), count_if(F.col("_problem")).alias("_problems"))
    out = out.join(translated, "media_id", "left").fillna(0, ["translated"]).withColumn("undubbed", F.greatest(F.lit(0), F.col("translated") - F.col("placed")))
    n = F.greatest(F.lit(1), F.col("placed"))
    shares = {"undubbed": F.col("undubbed") / F.greatest(F.lit(1), F.col("translated")), "timbre": (F.col("voice_bad") + F.col("voice_review") * 0.6) / n, "pace": (F.col("cut_off") + F.col("fast") * 0.5) / n,
              "buried": F.col("buried") / n, "back_read": (F.col("read_bad") + F.col("read_review") * 0.5) / n, "dead_air": F.col("dead_air") / n}
    penalty = sum((shares[k] * w for k, w in PENALTIES.items()), F.lit(0.0))
    return out.withColumn("problems", F.col("_problems") + F.col("undubbed")).withColumn("honest_score", F.round(F.greatest(F.lit(0.0), 100.0 - penalty), 1)).drop("_problems")
