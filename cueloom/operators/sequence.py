"""Ordered-row primitives that survive one key owning a third of all rows.

A plain `Window.partitionBy(media_id)` puts a whole media into one task.  Everything here cuts a key's rows into slots of
their leading sort column and never needs more than one slot per task:

* `scan`        ranks, lag / lead and running sum / max / min / last-known values: a window inside (key, slot), one
                summary row per slot whose own window carries the value across slots, and a join on (key, slot).  All
                outputs of one call share one shuffle, and a second scan over the kept `_slot` needs no further one.
* `islands`     gaps-and-islands id = rank of the latest break row.
* `slot_fold`   folds with a carried state: each slot folds its rows natively, and slots whose incoming state changed fold again
                until none does, which leaves exactly the state that one pass over all rows would have.
* `capped_sessions`  greedy sessions whose caps restart with each session, as such a fold.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.session import cut_lineage

BLOCK_ROWS = 65_536
FOLD_ROWS = 1_024
SLOT_MS = 3_600_000  # an hour of one media: bounded by what can be said or shown in it, and not so short that a slot's summary costs as much as its rows

Keys = Sequence[str]
_PLAIN = {"sum": F.sum, "max": F.max, "min": F.min}


def time_slot(start: str = "start_ms", width_ms: int = SLOT_MS) -> Column:
    return F.floor(F.col(start) / F.lit(width_ms)).cast("long")


def block_slot(pos: str = "pos") -> Column:
    return F.floor(F.col(pos) / BLOCK_ROWS).cast("long")


def scan(df: DataFrame, key: Keys, order: Keys, slot: Column | None, outputs: dict[str, tuple[str, Column | None]]) -> DataFrame:
    """Add ordered outputs per key; rows keep the helper column `_slot` (pass `slot=None` to scan again by it).

    Kinds: `row` (0-based rank), `lag`, `lead`, `sum`, `max`, `min`, `last` (latest non-NULL value) and, with `_before`
    appended, the running kinds without the current row.  `slot` must not decrease along `order`.
    """
    key, order = list(key), list(order)
    rows = df if slot is None else df.withColumn("_slot", slot)
    inside = Window.partitionBy(*key, "_slot").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    ahead_of = inside.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*key).orderBy("_slot").rowsBetween(1, Window.unboundedFollowing)
    at = F.struct(*order)
    local, totals, carries, merged = {}, [], [], {}
    for name, (kind, value) in outputs.items():
        here, total, carry = f"_l_{name}", f"_t_{name}", f"_c_{name}"
        base = kind.removesuffix("_before")
        frame = ahead_of if kind.endswith("_before") else upto
        if base == "row":
            local[here] = F.row_number().over(inside) - 1
            totals.append(F.count(F.lit(1)).alias(total))
            carries.append(F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias(carry))
            merged[name] = F.col(carry) + F.col(here)
        elif base in ("lag", "lead"):
            box = F.struct(value.alias("v"))
            local[here] = (F.lag if base == "lag" else F.lead)(box).over(inside)
            totals.append((F.max_by if base == "lag" else F.min_by)(box, at).alias(total))
            pick = F.last(total).over(earlier) if base == "lag" else F.first(total).over(later)
            carries.append(pick.alias(carry))
            merged[name] = F.coalesce(here, carry)["v"]
        elif base == "last":
            local[here] = F.last(value, ignorenulls=True).over(frame)
            totals.append(F.max_by(value, F.when(value.isNotNull(), at)).alias(total))
            carries.append(F.last(total, ignorenulls=True).over(earlier).alias(carry))
            merged[name] = F.coalesce(here, carry)
        else:
            local[here] = _PLAIN[base](value).over(frame)
            totals.append(_PLAIN[base](value).alias(total))
            carries.append(_PLAIN[base](total).over(earlier).alias(carry))
            if base == "sum":
                merged[name] = F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0))
            else:
                merged[name] = (F.greatest if base == "max" else F.least)(here, carry)
    summary = rows.groupBy(*key, "_slot").agg(*totals).select(*key, "_slot", *carries)
    joined = rows.withColumns(local).join(summary, [*key, "_slot"])
    kept = [c for c in rows.columns if c not in outputs]
    return joined.select(*kept, *[v.alias(n) for n, v in merged.items()])


def positions(df: DataFrame, key: Keys, order: Keys, slot: Column, out: str = "pos") -> DataFrame:
    """Dense 0-based rank of each row in its key."""
    return scan(df, key, order, slot, {out: ("row", None)}).drop("_slot")


def prefix(df: DataFrame, key: Keys, outputs: dict[str, tuple[str, Column]], pos: str = "pos") -> DataFrame:
    """`scan` along an existing dense position, in blocks of bounded row count."""
    return scan(df, key, [pos], block_slot(pos), outputs).drop("_slot")


def islands(df: DataFrame, key: Keys, breaks: Column, out: str = "island", pos: str = "pos") -> DataFrame:
    """Island id = position of the latest row where `breaks` holds (the first row of a key must break)."""
    return prefix(df, key, {out: ("last", F.when(breaks, F.col(pos)))}, pos=pos)


def label_islands(df: DataFrame, key: Keys, order: Keys, slot: Column, breaks: Column, outputs: dict[str, tuple[str, Column | None]],
                  out: str = "island") -> DataFrame:
    """One scan for `outputs` and the rank `pos`, then islands by `breaks` (which may use those outputs) on the same shuffle."""
    first = cut_lineage(scan(df, key, order, slot, {**outputs, "pos": ("row", None)}))
    # by rank, so that rows tied in `order` keep the sequence the breaks were computed in
    return scan(first, key, ["pos"], None, {out: ("last", F.when(breaks, F.col("pos")))}).drop("_slot")


def gap_islands(df: DataFrame, key: Keys, order: Keys, slot: Column, gap_ms: int, running_end: bool = True, out: str = "island") -> DataFrame:
    """Islands of intervals closer than `gap_ms`, measured to the running maximum end or to the previous row's end."""
    seen = ("max_before" if running_end else "lag", F.col("end_ms"))
    breaks = F.col("_end").isNull() | (F.col("start_ms") - F.col("_end") > gap_ms)
    return label_islands(df, key, order, slot, breaks, {"_end": seen}, out).drop("_end")


def slot_fold(rows: DataFrame, key: Keys, fields: Sequence[str], state: str, step: Callable[[Column, Column], Column], slot_rows: int = FOLD_ROWS) -> DataFrame:
    """The state after every row of a fold along `pos`: key, pos and the state's columns (`state` is their DDL).

    `step(state, row)` gives the state after a row; a row carries `pos` and `fields`.  The state before a key's first row is all nulls.
    `rows` have a dense `pos` and a boolean `opens`, true where the state before does not matter, so that a slot starting there waits for
    none.  Every other slot first assumes nulls, then folds again while the last state of the slot before differs from what it had assumed.
    A slot is right at the latest once all before it are, and most are at once, since a state is forgotten at the next row that opens.
    """
    key = list(key)
    fold_state = T.StructType.fromDDL(state)
    kind, names = fold_state.simpleString(), fold_state.fieldNames()
    nothing = F.lit(None).cast(kind)
    packed = rows.withColumn("_slot", F.floor(F.col("pos") / slot_rows).cast("long")).groupBy(*key, "_slot").agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in fields if c != "pos"]))).alias("rows"), F.min_by("opens", "pos").alias("_free"))
    slots = cut_lineage(packed)

    def leave(frame: DataFrame) -> DataFrame:
        fold = F.aggregate("rows", F.coalesce(F.col("_entry"), nothing), lambda s, r: step(s, r).cast(kind))
        return frame.select(*key, "_slot", fold.alias("_exit"))

    def enter(exits: DataFrame) -> DataFrame:
        return exits.select(*key, (F.col("_slot") + 1).alias("_slot"), F.col("_exit").alias("_entry"))

    waiting = slots.filter(~F.coalesce(F.col("_free"), F.lit(False)) & (F.col("_slot") > 0))
    entries = slots.select(*key, "_slot").limit(0).withColumn("_entry", nothing)
    if not waiting.isEmpty():
        exits = cut_lineage(leave(slots.withColumn("_entry", nothing)))
        needed = waiting.select(*key, "_slot")
        while True:
            now = enter(exits).join(needed, [*key, "_slot"], "left_semi")
            held = entries.withColumnRenamed("_entry", "_held")
            changed = now.join(held, [*key, "_slot"], "left").filter(~F.col("_entry").eqNullSafe(F.col("_held"))).drop("_held")
            entries = cut_lineage(now)
            changed = cut_lineage(changed)
            if changed.isEmpty():
                break
            again = leave(slots.join(changed, [*key, "_slot"]))
            exits = cut_lineage(exits.join(changed, [*key, "_slot"], "left_anti").unionByName(again))
    start = F.struct(F.col("_entry").alias("s"), F.slice(F.array(nothing), 1, 0).alias("out"))

    def grow(acc: Column, r: Column) -> Column:
        after = F.transform(F.array(step(acc["s"], r).cast(kind)), lambda s: F.struct(s.alias("s"), F.concat(acc["out"], F.array(s)).alias("out")))
        return after[0].cast(f"struct<s:{kind}, out:array<{kind}>>")

    ready = slots.join(entries, [*key, "_slot"], "left").withColumn("_entry", F.coalesce(F.col("_entry"), nothing))
    states = ready.select(*key, "rows", F.aggregate("rows", start.cast(f"struct<s:{kind}, out:array<{kind}>>"), grow)["out"].alias("out"))
    return states.select(*key, F.inline(F.transform("rows", lambda r, i: F.struct(r["pos"].alias("pos"), F.get(F.col("out"), i).alias("s"))))).select(*key, "pos", *[F.col(f"s.{n}").alias(n) for n in names])


def capped_sessions(
    df: DataFrame,
    key: Keys,
    breaks: Column,
    cap_ms: int,
    max_rows: int | None = None,
    gap_ms: int | None = None,
    slot_rows: int = FOLD_ROWS,
    out: str = "session",
) -> DataFrame:
    """Greedy sessions over rows with `pos, start_ms, end_ms` ascending in pos and start.

    A new session opens on a break row, when the row would end more than `cap_ms` after the session start, when it starts
    more than `gap_ms` after the session's latest end, or when the session already holds `max_rows` rows.  The session id
    is the position of its first row.
    """
    rows = cut_lineage(df.withColumn("opens", F.coalesce(breaks, F.lit(False)) | (F.col("pos") == 0)))

    def step(s: Column, r: Column) -> Column:
        fits = ~r["opens"] & (r["end_ms"] - s["start"] <= cap_ms)
        if max_rows is not None:
            fits = fits & (s["held"] < max_rows)
        if gap_ms is not None:
            fits = fits & (r["start_ms"] - s["reach"] <= gap_ms)
        joins = F.coalesce(fits, F.lit(False))
        return F.struct(F.when(joins, s[out]).otherwise(r["pos"]).alias(out), F.when(joins, s["start"]).otherwise(r["start_ms"]).alias("start"),
                        F.when(joins, F.greatest(s["reach"], r["end_ms"])).otherwise(r["end_ms"]).alias("reach"), F.when(joins, s["held"] + 1).otherwise(F.lit(1).cast("long")).alias("held"))

    folded = slot_fold(rows, key, ["start_ms", "end_ms", "opens"], f"{out} long, start long, reach long, held long", step, slot_rows)
    return rows.drop("opens").join(folded.select(*key, "pos", out), [*key, "pos"])
