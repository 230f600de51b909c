"""Personas, works and decisions: lookups, fuzzy inference, upserts and relabelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions import text as tx
from cueloom.functions.cols import flags
from cueloom.operators import sequence as seq
from cueloom.session import cut_lineage, small_side

MEDIA = ["media_id"]


def norm_name(name: Column) -> Column:
    return F.lower(F.trim(F.coalesce(name, F.lit(""))))


def name_similarity(a: Column, b: Column) -> Column:
    """1 equal, 0.7 prefix or suffix, 0.5 contained, 0 otherwise (either way round)."""
    x, y = norm_name(a), norm_name(b)
    edge = F.startswith(x, y) | F.startswith(y, x) | F.endswith(x, y) | F.endswith(y, x)
    return (F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(edge, 0.7)
            .when(F.contains(x, y) | F.contains(y, x), 0.5).otherwise(0.0))


def speaker_ids(segments: DataFrame, profiles: DataFrame) -> DataFrame:
    """speaker_label -> speaker_id; Spark broadcasts the profile side when it is small."""
    return segments.join(profiles.select("media_id", "speaker_label", "speaker_id"), ["media_id", "speaker_label"], "left")


def persona_columns(rows: DataFrame, bindings: DataFrame) -> DataFrame:
    """Persona of the row's own, previous and next speaker (bindings are one row per media and label)."""
    out = rows
    for prefix, label in (("", "speaker_label"), ("previous_", "prev_label"), ("next_", "next_label")):
        side = bindings.select("media_id", F.col("speaker_label").alias(label), F.col("persona_id").alias(f"{prefix}persona_id"), F.col("name").alias(f"{prefix}persona_name"))
        out = out.join(side, ["media_id", label], "left")
    return out


def first_binding(personas: DataFrame) -> DataFrame:
    """One persona per (media, label): the lowest id wins."""
    return personas.groupBy("media_id", "speaker_label").agg(F.min(F.struct("persona_id", "name", "gender", "role")).alias("_p")).select("media_id", "speaker_label", "_p.*")


def unassigned(known: DataFrame, bindings: DataFrame) -> DataFrame:
    return known.select("media_id", "speaker_label").filter("speaker_label <> ''").distinct().join(
        bindings.select("media_id", "speaker_label").distinct(), ["media_id", "speaker_label"], "left_anti")


def bulk_create(free: DataFrame, names: list[str]) -> DataFrame:
    """Entities for unbound speakers, named from a template list; past its end the last name gets a running number."""
    table, n = F.array(*[F.lit(x) for x in names]), len(names)
    ranked = seq.positions(free, MEDIA, ["speaker_label"], F.substring("speaker_label", 1, 8))
    name = F.when(F.col("pos") < n, F.try_element_at(table, (F.col("pos") + 1).cast("int"))).otherwise(
        F.concat(F.lit(names[-1] + " "), (F.col("pos") - n + 2).cast("string")))
    return ranked.withColumn("name", name).drop("pos")


def lookup_by_name(queries: DataFrame, works: DataFrame) -> DataFrame:
    """First work whose title or alias equals the queried name, ignoring case and outer spaces."""
    names = works.select("work_id", F.explode(F.array_distinct(F.transform(F.concat(F.array("title"), "aliases"), lambda a: norm_name(a)))).alias("_n")).filter("_n <> ''")
    first = names.groupBy("_n").agg(F.min("work_id").alias("work_id"))
    return queries.withColumn("_n", norm_name(F.col("name"))).join(first, "_n", "left").drop("_n")


def name_conflicts(personas: DataFrame) -> DataFrame:
    """Personas whose name is already used by an earlier one of the same media."""
    rows = personas.withColumn("_n", norm_name(F.col("name"))).filter("_n <> ''")
    first = rows.groupBy("media_id", "_n").agg(F.min("persona_id").alias("conflict_id"))
    return rows.join(first, ["media_id", "_n"]).filter("persona_id <> conflict_id").select("media_id", "persona_id", "conflict_id")


def search_works(works: DataFrame, needle: str) -> DataFrame:
    q = F.lit(needle.lower())
    return works.filter(F.contains(F.lower("title"), q) | F.exists("aliases", lambda a: F.contains(F.lower(a), q)))


# ---- work inference -----------------------------------------------------------------------------------------------


def _spread_words(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[._\-]+", " ")))


def _substrings(text: Column, sizes: list[int]) -> Column:
    """Distinct substrings of `text` with one of the sizes."""
    n = F.length(text)

    def of(k: int) -> Column:
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substr(text, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(k) for k in sizes]))


LEAD = 6


def containment(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r): distinct texts (column `text`) of both sides where one contains the other.

    A contained text's leading six characters (or all of it when shorter) must occur in the container, so both directions
    are equi joins on that key followed by the exact test: no pair is formed without a shared key.  Containers give keys of
    the sizes that occur; where few texts are on the right, its keys are broadcast and the left side's are never shuffled.
    """
    def inside(needles: DataFrame, hays: DataFrame, n: str, h: str) -> DataFrame:
        keyed = needles.select(F.col("text").alias(n)).withColumn("_k", F.substring(n, 1, LEAD))
        sizes = sorted(r[0] for r in keyed.select(F.length("_k")).distinct().collect() if r[0])
        grams = hays.select(F.col("text").alias(h)).withColumn("_k", F.explode(_substrings(F.col(h), sizes or [LEAD])))
        keyed, grams = (small_side(keyed), grams) if n == "r" else (keyed, small_side(grams))
        return keyed.join(grams, "_k").filter(F.contains(h, n)).select("l", "r")

    left, right = left.select("text").distinct(), right.select("text").distinct()
    return inside(right, left, "r", "l").unionByName(inside(left, right, "l", "r")).distinct()


def first_ids(named: DataFrame, k: int) -> DataFrame:
    """(text, id): the `k` smallest ids of every text, so that a text that many share stays a short list."""
    rank = F.row_number().over(Window.partitionBy("text").orderBy("id"))
    return named.select("text", "id").distinct().withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r")


def near_tokens(tokens: DataFrame, titles: DataFrame) -> DataFrame:
    """(token, title, distance): distinct texts where a token is within max(1, length / 4) edits of a title and four characters of its length.

    With t edits allowed, one of t + 1 pieces of the title survives unchanged in the token, shifted by at most t places,
    and the lengths differ by at most t.  (piece, place, token length) is the join key; the bounded edit distance is the
    exact test, computed once per distinct pair of texts.
    """
    n = F.length("text")
    tol = F.greatest(F.lit(1), F.floor(n / 4)).cast("int")
    size = F.floor(n / (F.col("_t") + 1)).cast("int")
    shifts = F.sequence(-F.col("_t"), F.col("_t"))
    keyed = (
        titles.select("text").distinct().withColumn("_t", tol).withColumn("_size", size)
        .withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_t")))).withColumn("_shift", F.explode(shifts)).withColumn("_grow", F.explode(shifts))
        .select(F.col("text").alias("_title"), "_t", F.substr("text", F.col("_i") * F.col("_size") + 1, F.col("_size")).alias("_k"),
                F.when(F.col("_size") > 0, F.col("_i") * F.col("_size") + 1 + F.col("_shift")).otherwise(0).alias("_at"), (n + F.col("_grow")).alias("_len"))
        .filter("_at >= 0 AND _len > 0").distinct()
    )
    sizes = keyed.select(F.length("_k").alias("_w")).agg(F.max("_w").alias("_w"))
    words = tokens.select("text").distinct().withColumn("_one", F.lit(1)).join(F.broadcast(sizes.withColumn("_one", F.lit(1))), "_one")
    places = words.withColumn("_w", F.explode(F.sequence(F.lit(0), F.col("_w")))).withColumn("_at", F.explode(F.sequence(F.lit(0), n)))
    spread = places.filter("(_w = 0 AND _at = 0) OR (_w > 0 AND _at > 0 AND _at + _w - 1 <= length(text))").select(
        F.col("text").alias("_token"), F.substr("text", F.col("_at"), F.col("_w")).alias("_k"), "_at", n.alias("_len"))
    pairs = spread.join(small_side(keyed), ["_k", "_at", "_len"]).select("_token", "_title", "_t").distinct().filter(F.abs(F.length("_token") - F.length("_title")) <= 4)
    close = pairs.withColumn("distance", F.levenshtein("_token", "_title")).filter(F.col("distance") <= F.col("_t"))
    return close.select(F.col("_token").alias("token"), F.col("_title").alias("title"), "distance")


def infer_works(tasks: DataFrame, works: DataFrame, limit: int = 3) -> DataFrame:
    """Top works of a task by its name and the file name of its input: containment of title or alias 0.9, close token 0.6-0.7, else the title
    that a file pattern gives, with its year, 0.5.

    Takes task_id, name, path and work_id, title, aliases.  Works of one title score alike and go by id, so at most twice `limit` ids of a
    text can come to a task's list; texts are compared once, however many tasks and works carry them.
    """
    named = tasks.select("task_id", F.col("name").alias("n"), tx.base_name(F.col("path")).alias("p"))
    sources = cut_lineage(named.select("task_id", F.posexplode(F.array("n", "p")).alias("source", "raw")).filter("raw <> ''"))
    hay = sources.select("task_id", _spread_words(F.col("raw")).alias("text")).filter("text <> ''").distinct()
    hay = cut_lineage(hay)
    names = works.select(F.col("work_id").alias("id"), F.explode(F.concat(F.array("title"), "aliases")).alias("text")).select("id", norm_name(F.col("text")).alias("text")).filter("text <> ''")
    names = cut_lineage(first_ids(names, 2 * limit))
    order = Window.partitionBy("task_id").orderBy(F.desc("score"), "pass", "work_id", "source")

    def best(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_r", F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("score"), "work_id"))).filter(F.col("_r") <= 2 * limit).drop("_r")

    # these all score alike, so a text that many tasks carry and many titles hold keeps its first works before it goes back to its tasks
    held = first_ids(containment(hay, names).withColumnRenamed("r", "text").join(names, "text").select(F.col("l").alias("text"), "id"), 2 * limit)
    hits = cut_lineage(best(hay.join(held, "text").select("task_id", F.col("id").alias("work_id"), F.lit(0.9).alias("score")).distinct()))
    tokens = cut_lineage(hay.select("task_id", F.explode(F.split("text", r"\s+")).alias("text")).filter("text <> ''").distinct())
    titles = cut_lineage(first_ids(works.select(F.col("work_id").alias("id"), _spread_words(F.col("title")).alias("text")).filter("text <> ''"), 2 * limit))
    near = near_tokens(tokens, titles).join(tokens.withColumnRenamed("text", "token"), "token").groupBy("task_id", F.col("title").alias("text")).agg(F.min("distance").alias("d"))
    near = near.select("task_id", "text", F.round(F.lit(0.6) + (1 - F.col("d") / F.length("text")) * 0.1, 3).alias("score"))
    fuzzy = best(near.join(titles, "text").select("task_id", F.col("id").alias("work_id"), "score").join(hits.select("task_id", "work_id"), ["task_id", "work_id"], "left_anti"))
    found = cut_lineage(hits.withColumn("pass", F.lit(0)).unionByName(fuzzy.withColumn("pass", F.lit(1))))
    matched = cut_lineage(found.join(small_side(works.select("work_id", "title").join(found.select("work_id").distinct(), "work_id", "left_semi")), "work_id"))
    suggestion = sources.select("task_id", "source", tx.file_title(F.col("raw")).alias("title"), tx.file_year(F.col("raw")).alias("year")).filter("title IS NOT NULL").withColumn("_t", F.lower("title"))
    first = suggestion.groupBy("task_id", "_t").agg(F.min_by(F.struct("title", "year", "source"), "source").alias("s")).select("task_id", "_t", "s.*")
    known = matched.select("task_id", norm_name(F.col("title")).alias("_t")).distinct()
    fresh = first.join(known, ["task_id", "_t"], "left_anti").select("task_id", F.lit(None).cast("long").alias("work_id"), F.lit(0.5).alias("score"), F.lit(2).alias("pass"), "title", "year", "source")
    ranked = matched.withColumns({"year": F.lit(None).cast("int"), "source": F.lit(0)}).select(*fresh.columns).unionByName(fresh).withColumn("rank", F.row_number().over(order))
    labels = sources.withColumn("episode", tx.episode_label(F.col("raw"))).filter("episode IS NOT NULL").groupBy("task_id").agg(F.min_by("episode", "source").alias("episode"))
    return ranked.filter(F.col("rank") <= limit).join(labels, "task_id", "left").drop("pass", "source")


# ---- persona matching ---------------------------------------------------------------------------------------------

# fixed values: what a trait adds to the score
PERSONA_WEIGHTS = {"work": 0.45, "name": 0.8, "role": 0.6, "gender": 0.3}
ANY_WORK = "*"


def _traits(df: DataFrame) -> DataFrame:
    work = F.nullif(F.trim(F.coalesce(F.col("work_id").cast("string"), F.lit(""))), F.lit(""))
    return df.withColumns({"_w": work, "_r": F.nullif(norm_name(F.col("role")), F.lit("")), "_g": F.nullif(norm_name(F.col("gender")), F.lit(""))})


def _trait_keys(tiers: Column) -> Column:
    """Every way to leave role and gender open, within each tier of works: structs (t, r, g), open parts empty."""
    def ways(t: Column) -> Column:
        sides = [(r, g) for r in (F.col("_r"), F.lit("")) for g in (F.col("_g"), F.lit(""))]
        return F.filter(F.array(*(F.named_struct(F.lit("t"), t, F.lit("r"), r, F.lit("g"), g) for r, g in sides)), lambda k: k["r"].isNotNull() & k["g"].isNotNull())

    return F.flatten(F.transform(tiers, ways))


def match_personas(speakers: DataFrame, personas: DataFrame, k: int = 5) -> DataFrame:
    """The `k` best personas of a global library per speaker: same work 0.45, best name or alias 0.8 times its similarity, role 0.6, gender 0.3.

    Takes media_id, speaker_label, name, role, gender, work_id and persona_id, name, aliases, role, gender, work_id; ties go by persona_id; a
    persona of another work than the speaker's is out, one without a work is not.  `scored` counts the personas that were looked at.

    Personas stand in short lists, one for each choice of work, role, gender and name text that a speaker may share with them, holding the `k`
    smallest ids.  Whoever precedes a persona in its list shares at least as much and so ranks before it, hence the lists of the traits a
    speaker has are enough; name texts are found by containment, each distinct text once.  Speakers that know the same ask once, and only the
    `k` answers go back to each of them.  No speaker is compared with the library.
    """
    people = _traits(personas).withColumn("_texts", F.array_distinct(F.filter(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), norm_name), lambda t: t != "")))
    people = cut_lineage(people.select("persona_id", "_w", "_r", "_g", "_texts"))
    own = F.array(F.coalesce("_w", F.lit("")), F.lit(ANY_WORK))
    listed = people.select("persona_id", F.explode(_trait_keys(own)).alias("key"), F.explode(F.concat(F.array(F.lit("")), "_texts")).alias("text"))
    rank = F.row_number().over(Window.partitionBy("key.t", "key.r", "key.g", "text").orderBy("persona_id"))
    lists = cut_lineage(listed.withColumn("_n", rank).filter(F.col("_n") <= k).select("persona_id", "key.*", "text"))

    named = _traits(speakers).withColumn("_hint", norm_name(F.col("name")))
    named = cut_lineage(named.select("media_id", "speaker_label", "_w", "_r", "_g", "_hint", F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in ("_w", "_r", "_g", "_hint")]).alias("ask")))
    asks = cut_lineage(named.select("ask", "_w", "_r", "_g", "_hint").dropDuplicates(["ask"]))
    hints = asks.filter("_hint <> ''").select(F.col("_hint").alias("text")).distinct()
    near = containment(hints, people.select(F.explode("_texts").alias("text")).distinct()).select(F.col("l").alias("_hint"), F.col("r").alias("text"))
    tiers = F.when(F.col("_w").isNotNull(), F.array(F.col("_w"), F.lit(""))).otherwise(F.array(F.lit(ANY_WORK)))
    keyed = asks.select("ask", "_w", "_hint", F.explode(_trait_keys(tiers)).alias("key"))
    plain = keyed.filter((F.col("key.r") != "") | (F.col("key.g") != "") | (F.col("key.t") == F.col("_w"))).select("ask", "key.*", F.lit("").alias("text"))
    called = keyed.join(near, "_hint").select("ask", "key.*", "text")
    found = plain.unionByName(called).join(lists, ["t", "r", "g", "text"]).select("ask", "persona_id").distinct()

    both = found.join(asks, "ask").join(people.select("persona_id", F.col("_w").alias("p_w"), F.col("_r").alias("p_r"), F.col("_g").alias("p_g"), "_texts"), "persona_id")
    best = F.coalesce(F.array_max(F.transform("_texts", lambda t: name_similarity(F.col("_hint"), t))), F.lit(0.0))
    same = {"work": F.col("_w") == F.col("p_w"), "role": F.col("_r") == F.col("p_r"), "gender": F.col("_g") == F.col("p_g")}
    parts = {n: F.when(same[n], PERSONA_WEIGHTS[n]).otherwise(0.0) for n in same} | {"name": best * PERSONA_WEIGHTS["name"]}
    scored = both.withColumn("score", F.round(parts["work"] + parts["name"] + parts["role"] + parts["gender"], 3)).withColumn("reasons", flags((same["work"], "work"), (best > 0, "name"), (same["role"], "role"), (same["gender"], "gender")))
    ask, speaker = Window.partitionBy("ask"), Window.partitionBy("media_id", "speaker_label")
    answers = scored.withColumn("_at", F.row_number().over(ask.orderBy(F.desc("score"), "persona_id"))).withColumn("_seen", F.count(F.lit(1)).over(ask))
    given = named.filter("media_id IS NOT NULL AND speaker_label IS NOT NULL").select("media_id", "speaker_label", "ask")
    told = given.join(answers.filter(F.col("_at") <= k).select("ask", "persona_id", "score", "reasons", "_at", "_seen"), "ask")
    ranked = told.withColumn("rank", F.row_number().over(speaker.orderBy(F.desc("score"), "persona_id"))).withColumn("scored", F.sum(F.when(F.col("_at") == 1, F.col("_seen"))).over(speaker))
    return ranked.filter((F.col("rank") <= k) & (F.col("score") > 0)).select("media_id", "speaker_label", "rank", "persona_id", "score", "reasons", "scored")


# ---- upserts ------------------------------------------------------------------------------------------------------


def fingerprint() -> Column:
    return F.concat_ws("|", norm_name(F.col("name")), F.lower(F.coalesce("gender", F.lit(""))), F.lower(F.coalesce("role", F.lit(""))))


def upsert_personas(library: DataFrame, incoming: DataFrame, overwrite: bool = True) -> DataFrame:
    """Match on name | gender | role; the flag decides whose note survives, unmatched rows of both sides stay."""
    old = library.withColumn("_f", fingerprint()).groupBy("_f").agg(F.min(F.struct("persona_id", "name", "gender", "role", "note")).alias("o"))
    new = incoming.withColumn("_f", fingerprint()).groupBy("_f").agg(F.max(F.struct("persona_id", "name", "gender", "role", "note")).alias("n"))
    pair = old.join(new, "_f", "full_outer")
    first, second = ("n", "o") if overwrite else ("o", "n")
    return pair.select(F.coalesce("o.persona_id", "n.persona_id").alias("persona_id"), *[F.coalesce(f"{first}.{c}", f"{second}.{c}").alias(c) for c in ("name", "gender", "role", "note")])


def overlay_map(base: Column, patch: Column) -> Column:
    """Patch keys replace base keys, the others stay."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(patch, k)), patch)


def merge_bindings(bindings: DataFrame, merges: DataFrame) -> DataFrame:
    """Labels merged into another move to the target's persona; without a target persona they become unbound.

    A persona left without bindings disappears by having no rows.
    """
    moved = bindings.join(merges.withColumnRenamed("source_label", "speaker_label"), ["media_id", "speaker_label"], "left")
    owners = bindings.select("media_id", F.col("speaker_label").alias("target_label"), F.col("persona_id").alias("_owner"))
    out = moved.join(owners, ["media_id", "target_label"], "left")
    changed = F.col("target_label").isNotNull() & (F.col("target_label") != F.col("speaker_label"))
    return out.withColumn("persona_id", F.when(changed, F.col("_owner")).otherwise(F.col("persona_id"))).filter("persona_id IS NOT NULL").select(
        "media_id", "speaker_label", "persona_id").distinct()


def remove_works(personas: DataFrame, removed: DataFrame, cascade: bool) -> DataFrame:
    """Personas of removed works are deleted, or moved to `reassign_to` (NULL = no work)."""
    hit = removed.select("work_id", F.col("reassign_to"), F.lit(True).alias("_hit"))
    if cascade:
        return personas.join(hit.select("work_id"), "work_id", "left_anti").select(*personas.columns)
    out = personas.join(hit, "work_id", "left")
    return out.withColumn("work_id", F.when(F.col("_hit"), F.col("reassign_to")).otherwise(F.col("work_id"))).select(*personas.columns)


def move_personas(personas: DataFrame, moves: DataFrame) -> DataFrame:
    out = personas.join(moves.select("persona_id", "target_work", F.lit(True).alias("_hit")), "persona_id", "left")
    return out.withColumn("work_id", F.when(F.col("_hit"), F.nullif("target_work", F.lit(""))).otherwise(F.col("work_id"))).select(*personas.columns)


# ---- speaker decisions --------------------------------------------------------------------------------------------


def latest_decisions(decisions: DataFrame) -> DataFrame:
    rest = [c for c in decisions.columns if c not in ("media_id", "item_id")]
    return decisions.groupBy("media_id", "item_id").agg(F.max_by(F.struct(*rest), "seq").alias("_d")).select("media_id", "item_id", "_d.*")


def decision_neighbours(ids: DataFrame, placed: DataFrame) -> DataFrame:
    """Labels just before the first and just after the last segment of each decision, in the original order."""
    spans = ids.join(placed.select("media_id", "segment_id", "pos"), ["media_id", "segment_id"]).groupBy("media_id", "item_id").agg(
        (F.min("pos") - 1).alias("_before"), (F.max("pos") + 1).alias("_after"))
    before = placed.select("media_id", F.col("pos").alias("_before"), F.col("speaker_label").alias("previous_label"))
    after = placed.select("media_id", F.col("pos").alias("_after"), F.col("speaker_label").alias("next_label"))
    return spans.join(before, ["media_id", "_before"], "left").join(after, ["media_id", "_after"], "left").select("media_id", "item_id", "previous_label", "next_label")


def apply_decisions(segments: DataFrame, decisions: DataFrame) -> DataFrame:
    """Relabel segments by the latest decision per item, in log order.

    A decision names its segments (`segment_ids`) or a whole label (`source_label`).  Segment decisions are joined to their
    segments; label decisions are a reviewer's handful per media and travel as one short array.  Each segment then folds
    its own decisions in order, so a label decision sees what earlier ones made of that segment.
    """
    placed = seq.positions(segments, MEDIA, ["start_ms", "end_ms", "segment_id"], seq.time_slot())
    current = latest_decisions(decisions).filter("action <> ''")
    by_id = current.filter(F.size("segment_ids") > 0)
    ids = by_id.select("media_id", "item_id", F.explode("segment_ids").alias("segment_id"))
    around = decision_neighbours(ids, placed)
    p, n, a = F.col("previous_label"), F.col("next_label"), F.col("action")
    derived = (
        F.when(a.isin("relabel_to_previous_speaker", "merge_to_previous_speaker"), p).when(a.isin("relabel_to_next_speaker", "merge_to_next_speaker"), n)
        .when(a == "merge_to_surrounding_speaker", F.coalesce(p, n)))
    moves = a.isin("relabel", "merge_speaker") | derived.isNotNull()
    targets = by_id.join(around, ["media_id", "item_id"], "left").withColumn("_target", F.coalesce(F.nullif("target_label", F.lit("")), derived)).filter(
        (moves | F.col("target_label").isNotNull()) & ~a.isin("keep", "keep_independent", "mark_non_cloneable", "non_cloneable") & F.col("_target").isNotNull())
    own = ids.join(targets.select("media_id", "item_id", "seq", "_target"), ["media_id", "item_id"]).groupBy("media_id", "segment_id").agg(
        F.collect_list(F.struct("seq", F.lit(None).cast("string").alias("source"), F.col("_target").alias("target"))).alias("_own"))
    label_wide = current.filter((F.size("segment_ids") <= 0) & (F.coalesce("source_label", F.lit("")) != "") & (F.coalesce("target_label", F.lit("")) != "") & a.isin("relabel", "merge_speaker")).groupBy("media_id").agg(
        F.collect_list(F.struct("seq", F.col("source_label").alias("source"), F.col("target_label").alias("target"))).alias("_wide"))
    joined = placed.join(own, ["media_id", "segment_id"], "left").join(label_wide, "media_id", "left")
    empty = F.array().cast("array<struct<seq:bigint,source:string,target:string>>")
    steps = F.array_sort(F.concat(F.coalesce("_own", empty), F.coalesce("_wide", empty)))
    label = F.aggregate(steps, F.col("speaker_label"), lambda acc, d: F.when(d["source"].isNull() | (d["source"] == acc), d["target"]).otherwise(acc))
    return joined.select("media_id", "segment_id", F.col("speaker_label").alias("original_label"), label.alias("speaker_label")).withColumn(
        "changed", F.col("speaker_label") != F.col("original_label"))


def non_cloneable(decisions: DataFrame) -> DataFrame:
    """Labels the reviewer excluded from cloning."""
    label = F.coalesce(F.nullif("target_label", F.lit("")), F.nullif("source_label", F.lit("")), F.nullif(F.regexp_extract("item_id", "^speaker:(.+)$", 1), F.lit("")))
    return latest_decisions(decisions).filter(F.col("action").isin("mark_non_cloneable", "non_cloneable")).select("media_id", label.alias("speaker_label")).filter("speaker_label IS NOT NULL").distinct()
