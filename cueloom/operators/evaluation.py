"""Lab evaluation: run aggregates, comparison, corpus micro metrics, work lists and result re-use."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions.cols import count_if, safe_div
from cueloom.functions.quantiles import exact_quantiles

RUN_KEY = ["run_id", "scenario", "arm"]


def run_aggregates(results: DataFrame, key: list[str] | None = None, width: float = 0.01) -> DataFrame:
    """Status counts and mean / median / population std / p90 / min / max of the scored primary metric."""
    key = key or RUN_KEY
    scored = F.when(F.col("status") == "succeeded", F.col("primary_metric"))
    base = results.groupBy(*key).agg(
        F.count(F.lit(1)).alias("total"),
        *[count_if(F.col("status") == s).alias(s) for s in ("succeeded", "failed", "skipped")],
        F.count(scored).alias("scored"), F.avg(scored).alias("mean"), F.stddev_pop(scored).alias("std"),
        F.min(scored).alias("min"), F.max(scored).alias("max"),
        F.bool_or("higher_is_better").alias("higher_is_better"),
    )
    return base.join(exact_quantiles(results, key, scored, {"median": 0.5, "p90": 0.9}, width), key, "left")


def sweep_winners(aggregates: DataFrame) -> DataFrame:
    """Best arm per (run, scenario) by the scenario's direction; unscored arms never win."""
    signed = F.when(F.col("higher_is_better"), F.col("mean")).otherwise(-F.col("mean"))
    return aggregates.filter("mean IS NOT NULL").groupBy("run_id", "scenario").agg(
        F.max_by("arm", F.struct(signed, "arm")).alias("winner"), F.max(signed).alias("_s"), F.first("higher_is_better").alias("_h"),
    ).select("run_id", "scenario", "winner", F.when(F.col("_h"), F.col("_s")).otherwise(-F.col("_s")).alias("mean"))


def compare_runs(baseline: DataFrame, candidate: DataFrame, key: list[str]) -> DataFrame:
    """Outer join of two runs' aggregates; regressed depends on the metric's direction, NULL where a side is missing."""
    b = baseline.select(*key, F.col("mean").alias("baseline_mean"), F.col("higher_is_better").alias("_hb"))
    c = candidate.select(*key, F.col("mean").alias("candidate_mean"), F.col("higher_is_better").alias("_hc"))
    higher = F.coalesce("_hc", "_hb")
    delta = F.round(F.col("candidate_mean") - F.col("baseline_mean"), 4)
    return (
        b.join(c, key, "full_outer").withColumn("higher_is_better", higher).withColumn("delta", delta)
        .withColumn("regressed", F.when(F.col("higher_is_better"), F.col("delta") < 0).when(
            ~F.col("higher_is_better"), F.col("delta") > 0))
        .drop("_hb", "_hc")
    )


def micro_cer(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.sum("ref_chars").alias("ref_chars"), F.sum("edits").alias("edits")).withColumn(
        "cer_micro", safe_div(F.col("edits"), F.col("ref_chars")))


def micro_der(rows: DataFrame, key: list[str]) -> DataFrame:
    sums = rows.groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("miss", "false_alarm", "confusion", "ref_speech")])
    return sums.withColumn("der_micro", safe_div(F.col("miss") + F.col("false_alarm") + F.col("confusion"), F.col("ref_speech")))


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    precision = safe_div(tp, tp + fp, 0.0)
    recall = safe_div(tp, tp + fn, 0.0)
    return precision, recall, safe_div(2 * precision * recall, precision + recall, 0.0)


def micro_prf(rows: DataFrame, key: list[str]) -> DataFrame:
    sums = rows.groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    p, r, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return sums.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1)


def clone_corpus(rows: DataFrame, key: list[str]) -> DataFrame:
    return micro_cer(rows, key).join(rows.groupBy(*key).agg(F.avg("sim").alias("sim_mean")), key)


def rank_runs(scores: DataFrame, key: list[str]) -> DataFrame:
    """Similarity descending, CER ascending, elapsed ascending; rank 1 is the best run."""
    order = Window.partitionBy(*key).orderBy(F.desc("similarity"), "cer", "elapsed", "slug")
    return scores.withColumn("rank", F.row_number().over(order))


def work_list(samples: DataFrame, scenarios: list[str], arms: dict[str, dict[str, str]], base: dict[str, str]) -> DataFrame:
    """Sample x scenario x arm; the arm's settings overlay the base settings.

    Scenarios and arms are a handful of configured names, so they are exploded from a literal array: no cross join.
    """
    def config(arm: str) -> Column:
        merged = {**base, **arms[arm]}
        return F.create_map(*[F.lit(x) for pair in sorted(merged.items()) for x in pair])

    specs = F.array(*[
        F.struct(F.lit(s).alias("scenario"), F.lit(a).alias("arm"), config(a).alias("config")) for s in scenarios for a in arms
    ])
    return samples.select("*", F.inline(specs))


def eligibility(samples: DataFrame, required: dict[str, list[str]]) -> DataFrame:
    """(sample, scenario, missing truth kinds); a scenario runs when nothing is missing."""
    specs = F.array(*[
        F.struct(F.lit(s).alias("scenario"),
                 F.array_compact(F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in kinds])).alias("missing"))
        for s, kinds in required.items()
    ])
    return samples.select("sample_id", F.inline(specs)).withColumn("eligible", F.size("missing") == 0)


def content_key(columns: list[str], epoch: str) -> Column:
    """SHA-256 of the canonical JSON of the named columns (sorted) and the code epoch."""
    fields = [F.lit(epoch).alias("_epoch"), *[F.col(c) for c in sorted(columns)]]
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def pending(work: DataFrame, stored: DataFrame) -> DataFrame:
    """Work whose key has no stored successful result."""
    done = stored.filter(F.col("status") == "succeeded").select("work_key").distinct()
    return work.join(done, "work_key", "left_anti")


@dataclass(frozen=True)
class Scenario:
    """A named scoring: `score` turns joined inputs into per-sample rows, `corpus` pools them."""

    name: str
    score: Callable[[DataFrame], DataFrame]
    corpus: Callable[[DataFrame], DataFrame]
    higher_is_better: bool


SCENARIOS: dict[str, Scenario] = {}


def register_scenario(scenario: Scenario) -> Scenario:
    SCENARIOS[scenario.name] = scenario
    return scenario


def score_with(name: str, inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    scenario = SCENARIOS[name]
    rows = scenario.score(inputs)
    return rows, scenario.corpus(rows)
