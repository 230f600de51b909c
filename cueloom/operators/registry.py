"""Speaker embeddings: prototypes, registry matching, registry upkeep, clustering and attribution audit."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.functions import vectors as vx
from cueloom.functions.cols import count_if
from cueloom.operators import sequence as seq
from cueloom.session import cut_lineage, spread

# fixed values
MATCH_THRESHOLD = 0.55
REVIEW_THRESHOLD = 0.35
MARGIN = 0.05
MAX_EXEMPLARS = 12
DEFAULT_FLOOR = 0.25
KEEP_COSINE = 0.6
SAME_SPEAKER = 0.62
SINGLE_SPEAKER_FLOOR = 0.52


def prototypes(vectors: DataFrame, key: list[str], dim: int) -> DataFrame:
    """Medoid by mean similarity, mean of the vectors within 0.6 of it, unit length; a lone vector stays as it is.

    The mean similarity of a vector to its group is its dot product with the group's mean vector, so the medoid needs no
    pairs: one mean vector per group joined back.
    """
    centre = vectors.groupBy(*key).agg(vx.mean_vector("vec", dim).alias("_mean"), F.count(F.lit(1)).alias("_n"))
    scored = vectors.join(centre, key).withColumn("_s", F.round(vx.dot(F.col("vec"), F.col("_mean")), 9))
    medoid = scored.groupBy(*key).agg(F.max_by("vec", F.struct("_s", -F.col("id"))).alias("_medoid"), F.max("_n").alias("_n"))
    kept = vectors.join(medoid, key).filter(vx.dot(F.col("vec"), F.col("_medoid")) >= KEEP_COSINE)
    out = kept.groupBy(*key).agg(F.count(F.lit(1)).alias("kept"), vx.mean_vector("vec", dim).alias("_m"), F.max("_n").alias("_n"))
    return out.select(*key, "kept", F.when(F.col("_n") == 1, F.col("_m")).otherwise(vx.unit(F.col("_m"))).alias("prototype"))


def registry_floor(registry: DataFrame, blocks: int = 4) -> DataFrame:
    """One row: highest similarity between prototypes of two speakers, 0.25 if there is none or it is negative."""
    sides = registry.select(F.col("speaker_id").alias("id"), F.col("prototype").alias("vec"))
    best = vx.best_matches(sides, sides.withColumnRenamed("id", "group_id"), 1, blocks, blocks, skip_same=True)
    top = best.agg(F.max("score").alias("m"))
    return top.select(F.when(F.col("m") >= 0, F.col("m")).otherwise(DEFAULT_FLOOR).alias("floor"))


def match_profiles(profiles: DataFrame, exemplars: DataFrame, floor: DataFrame, k: int = 3, left_blocks: int = 8,
                   right_blocks: int = 1) -> DataFrame:
    """Top-k registry speakers per profile and the decision with thresholds raised by the registry floor.

    `exemplars` holds one row per stored vector (prototype or exemplar) of an enabled speaker.
    """
    usable = profiles.filter(F.col("cloneable") & F.col("vec").isNotNull())
    top = vx.best_matches(usable.select(F.col("profile_id").alias("id"), "vec"),
                          exemplars.select(F.col("speaker_id").alias("group_id"), "vec"), max(k, 2), left_blocks, right_blocks)
    best = top.groupBy("id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("score"),
        F.max(F.when(F.col("rank") == 1, F.col("group_id"))).alias("best_speaker"),
        F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(-1.0)).alias("second"))
    # the floor is exactly one row
    ruled = best.withColumn("_one", F.lit(1)).join(F.broadcast(floor.withColumn("_one", F.lit(1))), "_one").drop("_one")
    match_at = F.greatest(F.lit(MATCH_THRESHOLD), F.col("floor") + 0.15)
    review_at = F.greatest(F.lit(REVIEW_THRESHOLD), F.col("floor") + 0.05)
    margin = F.round(F.col("score") - F.col("second"), 6)
    decided = ruled.withColumn("margin", margin).withColumn(
        "decision", F.when((F.col("score") >= match_at) & (F.col("margin") >= MARGIN), "matched").when(
            F.col("score") >= review_at, "review").otherwise("new_speaker"))
    out = profiles.select("profile_id", "cloneable").join(decided.withColumnRenamed("id", "profile_id"), "profile_id", "left")
    return out.withColumn("decision", F.when(~F.col("cloneable"), "non_cloneable").otherwise(F.coalesce("decision", F.lit("new_speaker")))).withColumn(
        "matched_speaker", F.when(F.col("decision") == "matched", F.col("best_speaker"))).drop("floor", "second", "best_speaker")


def update_registry(registry: DataFrame, profiles: DataFrame, matches: DataFrame) -> DataFrame:
    """Matched profiles append an exemplar (newest 12 stay) and refresh the prototype; new speakers are inserted."""
    decided = cut_lineage(profiles.join(matches.select("profile_id", "decision", "matched_speaker"), "profile_id"))
    newest = Window.partitionBy("matched_speaker").orderBy(F.desc("profile_id"))
    fresh = (
        decided.filter("decision = 'matched'").withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= MAX_EXEMPLARS)
        .groupBy(F.col("matched_speaker").alias("speaker_id"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("profile_id", "vec"))), lambda s: s["vec"]).alias("_new"))
    )
    joined = registry.join(fresh, "speaker_id", "left")
    every = F.concat("exemplars", F.coalesce("_new", F.array().cast(dict(registry.dtypes)["exemplars"])))
    start = F.greatest(F.lit(1), F.size("_all") - MAX_EXEMPLARS + 1)
    updated = (
        joined.withColumn("_all", every).withColumn("exemplars", F.slice("_all", start, F.lit(MAX_EXEMPLARS)))
        .withColumn("prototype", F.when(F.col("_new").isNotNull(), vx.unit(vx.array_mean(F.col("exemplars")))).otherwise(F.col("prototype")))
        .drop("_new", "_all")
    )
    top = registry.agg(F.coalesce(F.max(F.regexp_extract("speaker_id", r"^spk_(\d+)$", 1).try_cast("long")), F.lit(-1)).alias("_top"))
    inserts = seq.positions(
        decided.filter("decision = 'new_speaker' AND vec IS NOT NULL").withColumn("_all", F.lit(1)), ["_all"], ["profile_id"],
        F.floor(F.col("profile_id") / 100_000), "_n")
    numbered = inserts.join(F.broadcast(top.withColumn("_all", F.lit(1))), "_all").select(
        F.format_string("spk_%04d", F.col("_top") + F.col("_n") + 1).alias("speaker_id"),
        F.array("vec").alias("exemplars"), F.transform("vec", lambda x: x.cast("double")).alias("prototype"))
    return updated.select("speaker_id", "exemplars", "prototype").unionByName(numbered)


def clear_non_cloneable(profiles: DataFrame, listed: DataFrame) -> DataFrame:
    """Profiles listed in review lose their embedding and clips."""
    hit = profiles.join(listed.select("speaker_label").distinct().withColumn("_hit", F.lit(True)), "speaker_label", "left")
    blank = F.coalesce("_hit", F.lit(False))
    return (hit.withColumn("vec", F.when(~blank, F.col("vec"))).withColumn("clip_count", F.when(blank, 0).otherwise(F.col("clip_count")))
            .withColumn("cloneable", ~blank).drop("_hit"))


def attribution_audit(segments: DataFrame, protos: DataFrame, margin: float = 0.06) -> DataFrame:
    """Segment embedding against every prototype of its media: best speaker, confidence, suspect flag."""
    known = protos.select("media_id", F.col("speaker_id").alias("assigned")).distinct()
    rows = segments.filter(F.col("dur_ms") >= 400).join(known, ["media_id", "assigned"], "left_semi")
    sims = rows.join(protos, "media_id").withColumn("cos", F.round(vx.dot(F.col("vec"), F.col("prototype")), 6))
    per = sims.groupBy("media_id", "segment_id", "assigned").agg(
        F.max(F.when(F.col("speaker_id") == F.col("assigned"), F.col("cos"))).alias("assigned_cos"),
        F.max_by("speaker_id", F.struct("cos", "speaker_id")).alias("best"), F.max("cos").alias("best_cos"),
        F.max(F.when(F.col("speaker_id") != F.col("assigned"), F.col("cos"))).alias("_rival"))
    return per.withColumn("confidence", F.coalesce(F.round(F.col("assigned_cos") - F.col("_rival"), 6), F.lit(1.0))).withColumn(
        "suspect", (F.col("best") != F.col("assigned")) & (F.round(F.col("best_cos") - F.col("assigned_cos"), 6) > margin)).drop("_rival")


def audit_summary(audit: DataFrame) -> DataFrame:
    return audit.groupBy("media_id").agg(
        F.count(F.lit(1)).alias("checked"), count_if(F.col("suspect")).alias("suspects"),
        F.percentile("confidence", 0.5).alias("median_confidence"), F.min("confidence").alias("min_confidence"))


# ---- clustering ---------------------------------------------------------------------------------------------------


def average_merges(vecs: np.ndarray) -> list[tuple[float, int, int]]:
    """All merges of average-link cosine clustering as (height, row, row), lowest first.

    The mean cosine of two clusters of unit vectors is the product of their sums over their sizes, so clusters are kept as sums and no
    matrix of pairs exists: a chain of nearest neighbours is followed until two clusters are each other's nearest, which average link
    may merge at once whatever else is open.
    """
    sums = vecs / np.maximum(np.linalg.norm(vecs, axis=1, keepdims=True), 1e-12)
    size, name = np.ones(len(vecs)), np.arange(len(vecs))
    alive = np.ones(len(vecs), bool)
    chain: list[int] = []
    merges = []
    for _ in range(len(vecs) - 1):
        if 2 * alive.sum() < len(alive):  # close up the rows that are gone
            at = np.cumsum(alive) - 1
            chain = [int(at[c]) for c in chain]
            sums, size, name, alive = sums[alive], size[alive], name[alive], np.ones(int(alive.sum()), bool)
        while True:
            if not chain:
                chain.append(int(np.argmax(alive)))
            x = chain[-1]
            near = (sums @ sums[x]) / (size * size[x])
            near[~alive], near[x] = -np.inf, -np.inf
            y = int(np.argmax(near))
            if len(chain) > 1 and near[chain[-2]] >= near[y]:
                y = chain[-2]
                break
            chain.append(y)
        del chain[-2:]
        x, y = min(x, y), max(x, y)
        merges.append((1.0 - float(near[y if near[x] == -np.inf else x]), int(name[x]), int(name[y])))
        sums[x] += sums[y]
        size[x] += size[y]
        alive[y] = False
    return sorted(merges, key=lambda m: m[0])


def merged_labels(n: int, merges: list[tuple[float, int, int]]) -> np.ndarray:
    """Labels 0, 1, ... by smallest row after the given merges."""
    owner = np.arange(n)

    def find(x: int) -> int:
        while owner[x] != x:
            owner[x] = owner[owner[x]]
            x = owner[x]
        return x

    for _, a, b in merges:
        a, b = find(a), find(b)
        owner[max(a, b)] = min(a, b)
    return np.unique([find(i) for i in range(n)], return_inverse=True)[1]


def one_voice(vecs: np.ndarray, floor: float, block: int = 2_048) -> bool:
    """Whether the 20th percentile of all pair similarities reaches `floor`; counted block by block, never as one matrix."""
    n = len(vecs)
    below, largest_below, smallest_above = 0, -np.inf, np.inf
    for lo in range(0, n, block):
        for at in range(lo, n, block):
            sims = vecs[lo : lo + block] @ vecs[at : at + block].T
            sims = sims[np.triu_indices(len(sims), 1)] if at == lo else sims.ravel()
            under = sims < floor
            below += int(under.sum())
            largest_below = max(largest_below, sims[under].max(initial=-np.inf))
            smallest_above = min(smallest_above, sims[~under].min(initial=np.inf))
    rank = 0.2 * (n * (n - 1) // 2 - 1)
    low = int(rank)
    if below <= low:
        return True
    if below > low + 1:
        return False
    return largest_below + (smallest_above - largest_below) * (rank - low) >= floor


def speaker_clusters(vecs: np.ndarray, expected: int = 0) -> np.ndarray:
    n = len(vecs)
    if n <= 1 or expected == 1:
        return np.zeros(n, dtype=int)
    if expected <= 0 and one_voice(vecs, SINGLE_SPEAKER_FLOOR):
        return np.zeros(n, dtype=int)
    merges = average_merges(vecs)
    if expected > 0:
        return merged_labels(n, merges[: n - min(expected, n)])
    near = sum(h < 1.0 - SAME_SPEAKER for h, _, _ in merges)
    cap = n if n <= 6 else max(2, min(8, n // 6 + 1))
    return merged_labels(n, merges[: max(near, n - cap)])


def cluster_media(groups: DataFrame, expected: int = 0) -> DataFrame:
    """Cluster label per embedding group.  A media is one task and holds its groups' vectors, one per some seconds of a recording (20,000
    groups are a day and take some 20 MB); media are independent and spread over the cluster."""
    schema = T.StructType([T.StructField("media_id", groups.schema["media_id"].dataType), T.StructField("id", T.LongType()),
                           T.StructField("cluster", T.LongType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        labels = speaker_clusters(np.stack(pdf["vec"].to_numpy()).astype(np.float64), expected)
        return pd.DataFrame({"media_id": pdf["media_id"], "id": pdf["id"], "cluster": labels})

    return spread(groups, "media_id").groupBy("media_id").applyInPandas(run, schema)


def stable_relabel(rows: DataFrame, label: str, pos: str = "pos") -> DataFrame:
    """SPEAKER_00, SPEAKER_01 ... by first appearance in the media."""
    first = rows.groupBy("media_id", label).agg(F.min(pos).alias("_first"))
    order = Window.partitionBy("media_id").orderBy("_first")
    names = first.withColumn("stable_label", F.format_string("SPEAKER_%02d", F.row_number().over(order) - 1)).drop("_first")
    return rows.join(names, ["media_id", label])


def smooth_labels(rows: DataFrame, label: str = "cluster", max_ms: int = 1_500, slot_rows: int = seq.FOLD_ROWS) -> DataFrame:
    """A short row between two rows of one label takes that label; the left neighbour counts after its own smoothing.

    A row longer than `max_ms` keeps its label whatever happened before, so the fold carries a label only over short rows.
    """
    ahead = cut_lineage(seq.prefix(rows, ["media_id"], {"_next": ("lead", F.col(label))}))
    ahead = ahead.withColumns({"opens": (F.col("pos") == 0) | (F.col("dur_ms") > max_ms), "_own": F.col(label)})

    def step(s: Column, r: Column) -> Column:
        return F.struct(F.when(~r["opens"] & (s["smoothed"] == r["_next"]), s["smoothed"]).otherwise(r["_own"]).alias("smoothed"))

    folded = seq.slot_fold(ahead, ["media_id"], ["_next", "_own", "opens"], f"smoothed {rows.schema[label].dataType.simpleString()}", step, slot_rows)
    return rows.join(folded, ["media_id", "pos"])


def assign_speakers(segments: DataFrame, units: DataFrame, vectors: DataFrame, expected: int = 0) -> DataFrame:
    """Speaker label of every segment in one job: clusters of the embedding groups, groups without a vector by their nearest one (the
    earlier of two), segments by their group, short rows smoothed, labels by first appearance.

    `units`: media_id, segment_id, pos, session (the group); `vectors`: media_id, session, vec (null or absent: none).  A media without
    any vector is one speaker.
    """
    groups = units.select("media_id", "session").distinct().join(vectors.select("media_id", "session", "vec"), ["media_id", "session"], "left")
    ranked = cut_lineage(seq.positions(groups, ["media_id"], ["session"], seq.block_slot("session"), "group"))
    clusters = cluster_media(ranked.filter("vec IS NOT NULL").select("media_id", F.col("group").alias("id"), "vec"), expected)
    known = cut_lineage(ranked.select("media_id", "session", "group").join(clusters.select("media_id", F.col("id").alias("group"), "cluster"), ["media_id", "group"], "left"))
    here = F.when(F.col("cluster").isNotNull(), F.struct("group", "cluster"))
    around = seq.scan(known, ["media_id"], ["group"], seq.block_slot("group"), {"_left": ("last", here)}).drop("_slot")
    back = seq.scan(around.withColumn("_back", -F.col("group")), ["media_id"], ["_back"], F.floor(F.col("_back") / seq.BLOCK_ROWS), {"_right": ("last", here)}).drop("_slot", "_back")
    nearer = F.col("_right").isNotNull() & (F.col("_left").isNull() | (F.col("_right.group") - F.col("group") < F.col("group") - F.col("_left.group")))
    labelled = back.select("media_id", "session", F.coalesce(F.when(nearer, F.col("_right.cluster")).otherwise(F.col("_left.cluster")), F.lit(0).cast("long")).alias("cluster"))
    rows = cut_lineage(units.select("media_id", "segment_id", "pos", "session").join(segments.select("media_id", "segment_id", (F.col("end_ms") - F.col("start_ms")).alias("dur_ms")), ["media_id", "segment_id"]).join(labelled, ["media_id", "session"]))
    return stable_relabel(smooth_labels(rows, "cluster"), "smoothed").select("media_id", "segment_id", "session", "cluster", "smoothed", "stable_label")
