"""Ranking, sampling, splits and set operations (W1 to W8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinderframe.functions.columns import is_truth
from cinderframe.functions.joins import join_metadata
from cinderframe.operators import cells as cell_ops
from cinderframe.operators import domains, learning, probability, profile, sampling
from cinderframe.plans.fixtures import SEEDS, Tables, with_fixtures
from cinderframe.plans.projections import RAW_CLASS, raw_classes
from cinderframe.plans.registry import query, rounded
from cinderframe.session import written
from cinderframe.sources import tables

IDS = ["run_id", "step", "r", "c"]
IDS_HASH = "md5('42|' || run_id || '|' || step || '|' || r || '|' || c)"


@query("w1_ignition_sample", with_fixtures("env winds", """
    select mode, run_id, r, c, cast(pick as int) pick from (
      select mode, run_id, r, c, k, row_number() over (partition by mode, run_id order by md5(run_id || '|' || r || '|' || c), r, c) pick
      from env cross join winds cross join (values ('strict', 10), ('lenient', 200)) m(mode, k)
      where burnable and building_presence = 1 and (mode = 'strict' or slope_raw = 12)) where pick <= k"""))
def ignition_sample(t: Tables):
    seeds = F.explode(F.array(*[F.lit(s) for s in SEEDS])).alias("run_id")
    eligible = t.env.filter(F.col("burnable") & (F.col("building_presence") == 1)).select("r", "c", "slope_raw", seeds)
    strict = written(sampling.sample_cells(eligible, "run_id", 10), "picks")
    strict = sampling.require_sample(t.winds.select("run_id"), strict, "run_id", 10).withColumn("mode", F.lit("strict"))
    lenient = sampling.sample_cells(eligible.filter("slope_raw = 12"), "run_id", 200).withColumn("mode", F.lit("lenient"))
    return strict.unionByName(lenient).select("mode", "run_id", "r", "c", "pick")


@query("w2_stratified_split", with_fixtures("training", f"""
    select run_id, step, r, c, ignited, case when rk <= round(0.2::double * n) then 'test' else 'train' end part from (
      select *, count(*) over (partition by ignited) n, row_number() over (partition by ignited order by {IDS_HASH}, run_id, step, r, c) rk
      from training)"""))
def stratified_split(t: Tables):
    return sampling.stratified_split(t.labels_table, "ignited", IDS)


@query("w3_stratified_folds", with_fixtures("training", f"""
    select run_id, step, r, c, ignited,
      cast((row_number() over (partition by ignited order by {IDS_HASH}, run_id, step, r, c) - 1) % 5 as int) fold from training"""))
def stratified_folds(t: Tables):
    return sampling.stratified_folds(t.labels_table, "ignited", IDS, k=5, tasks=t.tasks)


FEATURES = ("slope_risk", "proximity_risk", "building_presence", "material_risk", "neighbor_burning_count", "composite_flammability", "wind_weighted_score")


@query("w4_feature_ranking", with_fixtures("training", """
    select cast(row_number() over (order by round(abs(coef), 9) desc, feature) as int) rank, feature, round(coef, 6) coef, round(abs(coef), 6) abs_coef from (
    """ + " union all ".join(f"""select '{f}' feature,
      (avg({f}) filter (where ignited = 1) - avg({f}) filter (where ignited = 0)) / stddev_pop({f}) coef from training""" for f in FEATURES) + ")"))
def feature_ranking(t: Tables):
    """Features by the size of their standardised class-mean difference."""
    rows = t.training_table()
    gaps = profile.class_means(rows, FEATURES, "ignited").join(learning.standardisation(rows, FEATURES), "feature")
    coefficients = gaps.select("feature", (F.col("difference") / F.col("scale")).alias("coef"))
    ranked = learning.rank_features(coefficients.withColumn("abs_coef", F.abs("coef")))
    return rounded(ranked, "coef", "abs_coef")


@query("w5_best_trial", """
    select "day", cutoff_no best_trial, round(f1, 6) best_value, 16::bigint trials, cutoff_no < 8 converged_early from (
      select "day", i cutoff_no, f1, row_number() over (partition by "day" order by f1 desc, i) rk from (
        select "day", i, case when 2 * tp + fp + fn = 0 then 0.0::double else 2 * tp / (2 * tp + fp + fn) end f1 from (
          select extract(day from ts) "day", i, count(*) filter (where v >= cut and y) tp, count(*) filter (where v >= cut and not y) fp,
            count(*) filter (where v < cut and y) fn
          from (select ts, least(1.0::double, value / 500) v, event_type = 'purchase' y from events)
          cross join (select cast(range as int) i, 0.1::double + range * 0.05::double cut from range(0, 16)) group by 1, 2))) where rk = 1""")
def best_trial(t: Tables):
    """Best of 16 cutoffs for every day of events."""
    rows = t.table("events").selectExpr(
        "cast(dayofmonth(ts) as bigint) day", "cast(event_type = 'purchase' as int) label", "least(1.0D, value / 500) p"
    )
    sweep = probability.cutoff_counts(rows, "label", "p", ["day"]).withColumn("f1", probability.f1_of_counts())
    return rounded(probability.best_trials(sweep, ["day"], "cutoff_no", "f1"), "best_value")


@query("w6_scenario_union", with_fixtures("training", """
    select run_id, "rows", positives, round(positive_rate, 6) positive_rate from (
      select run_id, count(*) "rows", cast(sum(ignited) as bigint) positives, avg(ignited) positive_rate, max(sum(ignited)) over () most
      from training group by 1) where positives >= 0.2::double * most"""))
def scenario_union(t: Tables):
    """Union of one frame per scenario; one that hardly burned failed and left no folder."""
    rows = t.training_table(partition_by=("run_id",))
    burned = rows.groupBy("run_id").agg(F.sum("ignited").alias("positives"))
    alive = burned.filter(F.col("positives") >= 0.2 * burned.agg(F.max("positives")).scalar()).select("run_id")
    folders = written(join_metadata(rows, alive, ["run_id"], "left_semi"), "scenarios", ("run_id",))
    found = {r["run_id"] for r in folders.select("run_id").distinct().collect()}  # one row per folder
    frames = [folders.filter(F.col("run_id") == s) if s in found else None for s in SEEDS]
    combined = tables.union_scenarios(frames, folders.schema, t.spark)
    return rounded(profile.class_balance(combined, "ignited", ["run_id"]), "positive_rate")


@query("w7_mask_algebra", with_fixtures("cells", """
    select 'truth and buildings' mask, r, c from cells where truth = 1 and buildings_raw > 0
    union all select 'truth minus buildings', r, c from cells where truth = 1 and not buildings_raw > 0"""))
def mask_algebra(t: Tables):
    truth, buildings = t.cells.filter(is_truth("truth", "one")), t.cells.filter("buildings_raw > 0")
    both = domains.intersection(truth, buildings).withColumn("mask", F.lit("truth and buildings"))
    return both.unionByName(domains.difference(truth, buildings).withColumn("mask", F.lit("truth minus buildings")))


@query("w8_first_offenders", with_fixtures("cells", """
    select distinct raw_class from raw where raw_class not in (0, 1, 2, 3, 4, 5) and abs(raw_class - 3) > 1e-6 order by 1 limit 5""",
    f"raw as (select cast({RAW_CLASS} as double) raw_class from (select *, r * 120 + c i from cells))"))
def first_offenders(t: Tables):
    bad = raw_classes(t).filter(~cell_ops.valid_class("raw_class"))
    return cell_ops.first_distinct(bad, "raw_class", 5)
