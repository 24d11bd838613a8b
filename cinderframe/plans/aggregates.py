"""Aggregations and metrics (A1 to A26)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from cinderframe.functions.columns import is_reached, is_truth
from cinderframe.functions.joins import join_metadata
from cinderframe.operators import (
    digest,
    domains,
    focal,
    morphology,
    probability,
    profile,
    sampling,
    scoring,
    transitions,
)
from cinderframe.operators.scoring import Case
from cinderframe.plans.fixtures import CROPS, PIXEL, Tables, with_fixtures
from cinderframe.plans.registry import query, r6, rounded
from cinderframe.plans.scans import LAYER_COLUMNS
from cinderframe.session import written
from cinderframe.sources import wind

HORIZONS = (3, 6, 9, 20)
TRUTH_COLUMNS = {"alpha": "truth", "beta": "truth_b"}
METRICS = ("precision", "recall", "f1", "jaccard")

# SQL of the zero-safe metrics over tp, fp, fn.
P_SQL = "case when tp + fp = 0 then 0.0::double else tp / (tp + fp) end"
R_SQL = "case when tp + fn = 0 then 0.0::double else tp / (tp + fn) end"
F1_SQL = f"case when {P_SQL} + {R_SQL} = 0 then 0.0::double else 2 * ({P_SQL}) * ({R_SQL}) / ({P_SQL} + {R_SQL}) end"
J_SQL = "case when tp + fp + fn = 0 then 0.0::double else tp / (tp + fp + fn) end"
METRIC_SQL = f"round({P_SQL}, 6) as precision, round({R_SQL}, 6) recall, round({F1_SQL}, 6) f1, round({J_SQL}, 6) jaccard"
CONFUSION_SQL = """count(*) filter (where state >= 3 and truth = 1) tp, count(*) filter (where state >= 3 and truth = 0) fp,
  count(*) filter (where state < 3 and truth = 1) fn, count(*) filter (where state < 3 and truth = 0) tn"""
FINAL_COUNTS = f"counts as (select run_id, {CONFUSION_SQL} from final join cells using (r, c) group by 1)"
SCORED_COUNTS = """g as (select p, sum(label) pos, sum(1 - label) neg from scored group by 1)"""
CUTOFF_SQL = """sweep as (
  select i cutoff_no, cut cutoff, count(*) filter (where p >= cut and label = 1) tp, count(*) filter (where p >= cut and label = 0) fp,
    count(*) filter (where p < cut and label = 1) fn, count(*) filter (where p < cut and label = 0) tn
  from scored cross join (select cast(range as int) i, 0.1::double + range * 0.05::double cut from range(0, 16)) group by 1, 2)"""
SWEEP_F1 = "case when 2 * tp + fp + fn = 0 then 0.0::double else 2 * tp / (2 * tp + fp + fn) end"


def cases(*labels: str) -> list[Case]:
    """Both fires on the four domains, or on those named."""
    out = []
    for fire, truth in TRUTH_COLUMNS.items():
        r0, c0, size = CROPS[fire]
        flags = domains.domain_flags(domains.in_window(r0, c0, size, size))
        for name, mask in flags.items():
            if not labels or name in labels:
                out.append(Case({"fire": fire, "domain": name}, is_truth(truth, "one"), mask))
    return out


def final_counts(t: Tables):
    rows = t.final.join(t.cells.select("r", "c", "truth"), ["r", "c"])
    return scoring.confusion(rows, is_reached(), is_truth("truth", "one"), ["run_id"])


def horizon_scores(t: Tables, horizons=HORIZONS):
    """Scores of every run at every horizon, per fire and domain."""
    reached = transitions.as_of_snapshots(t.snapshots.filter(is_reached()), t.run_log, horizons)
    runs = transitions.as_of_steps(t.run_log, horizons)
    counts = scoring.score_runs(reached, t.env, runs, cases(), ["run_id", "requested_step"])
    return scoring.with_metrics(counts)


CASE_GRID = """(values ('alpha'), ('beta')) f(fire) cross join (values ('whole'), ('buildings'), ('crop_buildings'), ('spec')) d(domain)"""
# A domain without cells scores 0 everywhere.
HORIZON_COUNTS = f"""raw as (
  select d.fire, d.domain, s.run_id, q.requested_step, count(*) filter (where state >= 3 and burned = 1) tp,
    count(*) filter (where state >= 3 and burned = 0) fp, count(*) filter (where state < 3 and burned = 1) fn,
    count(*) filter (where state < 3 and burned = 0) tn
  from snapshots s join (values (3, 3), (6, 6), (9, 9), (20, 12)) q(requested_step, step) on q.step = s.step
  join domains d on d.r = s.r and d.c = s.c group by 1, 2, 3, 4),
counts as (
  select fire, domain, run_id, requested_step, coalesce(tp, 0) tp, coalesce(fp, 0) fp, coalesce(fn, 0) fn, coalesce(tn, 0) tn
  from (select fire, domain, run_id, requested_step from {CASE_GRID} cross join winds
    cross join (values (3), (6), (9), (20)) h(requested_step)) g left join raw using (fire, domain, run_id, requested_step))"""


@query("a1_neighbour_count", with_fixtures("focal", "select run_id, step, neighbor_burning_count, count(*) cells from focal group by 1, 2, 3"))
def neighbour_count(t: Tables):
    counts = focal.neighbour_counts(t.snapshots, t.grid, tasks=t.tasks)
    return counts.groupBy("run_id", "step", "neighbor_burning_count").agg(F.count(F.lit(1)).alias("cells"))


@query("a2_wind_weighted_score", with_fixtures("focal", """
    select run_id, step, r, c, neighbor_burning_count, round(wind_weighted_score, 8) wind_weighted_score from focal"""))
def wind_weighted_score(t: Tables):
    return t.focal.select("run_id", "step", "r", "c", "neighbor_burning_count", F.round("wind_weighted_score", 8).alias("wind_weighted_score"))


@query("a3_wind_kernel", with_fixtures("wind_hourly offsets", """
    select hour_key, dr, dc, round(weight, 6) weight, round(sum(weight) over (partition by hour_key), 6) kernel_sum from (
      select hour_key, dr, dc, greatest(1 + 0.2::double * (speed_ms * 3.6::double / 10) * (
          (-dr / sqrt(dr * dr + dc * dc)) * (-cos(radians((dir_deg + 180) % 360)))
        + (-dc / sqrt(dr * dr + dc * dc)) * sin(radians((dir_deg + 180) % 360))), 0.05::double) weight
      from wind_hourly cross join offsets where speed_ms >= 0)"""))
def wind_kernel(t: Tables):
    """Kernel of every observed hour."""
    hours = wind.usable_wind(t.wind_hourly).withColumnRenamed("dir_deg", "direction_deg")
    return rounded(focal.kernel_table(hours, ["hour_key"]), "weight", "kernel_sum")


@query("a4_state_counts", with_fixtures("snapshots", """
    select run_id, step, count(*) filter (where state = 1) non_burnable, count(*) filter (where state = 2) not_yet_burning,
      count(*) filter (where state = 3) ignited, count(*) filter (where state = 4) blazing,
      count(*) filter (where state = 5) extinguished, bool_or(state in (3, 4)) is_active from snapshots group by 1, 2"""))
def state_counts(t: Tables):
    return transitions.state_counts(t.snapshots)


@query("a5_confusion_counts", with_fixtures("final cells", "select * from counts", FINAL_COUNTS))
def confusion_counts(t: Tables):
    return final_counts(t)


@query("a6_map_metrics", with_fixtures("final cells", f"""
    select run_id, tp, fp, fn, {METRIC_SQL}, tp + fn truth, tp + fp predicted, round((tp + tn) / (tp + fp + fn + tn), 6) accuracy
    from counts""", FINAL_COUNTS))
def map_metrics(t: Tables):
    scores = scoring.with_metrics(final_counts(t)).withColumn("accuracy", scoring.accuracy())
    return rounded(scores, *METRICS, "accuracy").drop("tn")


@query("a7_multi_domain_scores", with_fixtures("snapshots domains", f"""
    select fire, domain, run_id, requested_step, tp, fp, fn, tn, {METRIC_SQL}, tp + fn truth, tp + fp predicted from counts""", HORIZON_COUNTS))
def multi_domain_scores(t: Tables):
    return rounded(horizon_scores(t), *METRICS)


@query("a8_hard_label_auc", with_fixtures("final cells", f"""
    select run_id, round(({R_SQL} + case when tn + fp = 0 then 0 else tn / (tn + fp) end) / 2, 6) auc from counts""", FINAL_COUNTS))
def hard_label_auc(t: Tables):
    return final_counts(t).select("run_id", r6(scoring.hard_auc(), "auc"))


@query("a9_roc_auc", with_fixtures("scored", """
    select cast(sum(pos) as bigint) positives, cast(sum(neg) as bigint) negatives,
      round(sum(pos::double * (neg_before + neg / 2)) / (sum(pos)::double * sum(neg)), 6) roc_auc
    from (select *, coalesce(sum(neg) over (order by p rows between unbounded preceding and 1 preceding), 0) neg_before from g)""", SCORED_COUNTS))
def roc_auc(t: Tables):
    return rounded(probability.roc_auc(t.scored, "label", "p"), "roc_auc")


@query("a10_average_precision", with_fixtures("scored", """
    select round(sum(pos * hits::double / seen) / sum(pos), 6) average_precision from (
      select pos, sum(pos) over w hits, sum(pos + neg) over w seen from g window w as (order by p desc))""", SCORED_COUNTS))
def average_precision(t: Tables):
    return rounded(probability.average_precision(t.scored, "label", "p"), "average_precision")


@query("a11_proper_losses", with_fixtures("scored", """
    select round(avg((p - label) * (p - label)), 6) brier, round(avg(-(label * ln(q) + (1 - label) * ln(1 - q))), 6) log_loss,
      round(avg(p), 6) mean_p
    from (select *, least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16) q from scored)"""))
def proper_losses(t: Tables):
    return rounded(probability.proper_losses(t.scored, "label", "p"), "brier", "log_loss", "mean_p")


@query("a12_threshold_sweep", with_fixtures("scored", f"""
    select cutoff_no, round(cutoff, 6) cutoff, tp, fp, fn, tn, round({SWEEP_F1}, 6) f1,
      round(first_value(case when {SWEEP_F1} > 0 then cutoff else 0.5 end) over (order by {SWEEP_F1} desc, cutoff_no), 6) best_cutoff
    from sweep""", CUTOFF_SQL))
def threshold_sweep(t: Tables):
    rows = probability.cutoff_counts(t.scored, "label", "p").withColumn("f1", probability.f1_of_counts())
    # A window over 16 rows: the first cutoff with the highest F1, else 0.5.
    first = F.first(F.when(F.col("f1") > 0, F.col("cutoff")).otherwise(0.5)).over(Window.partitionBy(F.lit(0)).orderBy(F.desc("f1"), "cutoff_no"))
    rows = rows.withColumn("best_cutoff", first)
    return rounded(rows, "cutoff", "f1", "best_cutoff")


@query("a13_fixed_cutoff_metrics", with_fixtures("scored", f"""
    select cutoff, tp, fp, fn, tn, {METRIC_SQL}, tp + fn truth, tp + fp predicted, {R_SQL} >= 0.8 recall_pass, {F1_SQL} >= 0.8 f1_pass from (
      select cut cutoff, count(*) filter (where p >= cut and label = 1) tp, count(*) filter (where p >= cut and label = 0) fp,
        count(*) filter (where p < cut and label = 1) fn, count(*) filter (where p < cut and label = 0) tn
      from scored cross join (values (0.01::double), (0.5::double)) q(cut) group by 1)"""))
def fixed_cutoff_metrics(t: Tables):
    counts = probability.cutoff_counts(t.scored, "label", "p", cutoffs=[0.01, 0.5]).drop("cutoff_no")
    return rounded(scoring.with_targets(scoring.with_metrics(counts)), *METRICS)


def per_seed_text(column: str):
    return F.concat_ws(" ", F.transform(column, lambda v: F.format_string("%.4f", v)))


@query("a14_across_seeds", with_fixtures("snapshots domains", f"""
    select fire, domain, requested_step, metric, count(*) runs, round(avg(value), 6) mean, round(coalesce(stddev_samp(value), 0), 6) sd,
      round(min(value), 6) min, round(max(value), 6) max, count(*) filter (where value >= 0.8) passing,
      string_agg(printf('%.4f', value), ' ' order by run_id) per_seed from (
      select *, unnest(['precision', 'recall', 'f1', 'jaccard']) metric, unnest([{P_SQL}, {R_SQL}, {F1_SQL}, {J_SQL}]) value from counts)
    group by 1, 2, 3, 4""", HORIZON_COUNTS))
def across_seeds(t: Tables):
    summary = scoring.across_seeds(horizon_scores(t), ["fire", "domain", "requested_step"], "run_id")
    return rounded(summary, "mean", "sd", "min", "max").withColumn("per_seed", per_seed_text("per_seed"))


# A fifth layer with cells that are no numbers.
RATIO = {True: "case when (r * 120 + c) % 101 = 0 then double('nan') when (r * 120 + c) % 103 = 0 then double('infinity') else proximity_raw end"}
RATIO[False] = RATIO[True].replace("double('nan')", "'nan'::double").replace("double('infinity')", "'inf'::double")


@query("a15_layer_values", with_fixtures("cells", f"""
    select layer, v as value, n cells, count(*) over (partition by layer) distinct_values,
      cast(sum(case when v = -9999 then n else 0 end) over (partition by layer) as bigint) nodata_cells,
      cast(sum(case when isnan(v) or isinf(v) then n else 0 end) over (partition by layer) as bigint) nonfinite_cells,
      min(case when v <> -9999 and isfinite(v) then v end) over (partition by layer) usable_min,
      max(case when v <> -9999 and isfinite(v) then v end) over (partition by layer) usable_max from (
      select unnest(['slope_raw', 'proximity_raw', 'buildings_raw', 'materials_raw', 'ratio_raw']) layer,
        unnest([slope_raw, proximity_raw, buildings_raw, materials_raw, {RATIO[False]}]) v, count(*) n from cells group by 1, 2)"""))
def layer_values(t: Tables):
    """Every layer's values with their counts, beside the layer's summary."""
    cells = t.cells.withColumn("ratio_raw", F.expr(RATIO[True]))
    counts = written(profile.value_counts(cells, [*LAYER_COLUMNS, "ratio_raw"], name="layer"), "layer-values")
    return join_metadata(counts, profile.layer_summary(counts), ["layer"])


@query("a16_dataset_summary", with_fixtures("training", """
    select wind_speed, count(*) "rows", cast(sum(ignited) as bigint) positives, round(avg(ignited), 6) positive_rate,
      round(count(*) / sum(count(*)) over (), 6) share_of_rows from training group by 1"""))
def dataset_summary(t: Tables):
    per_wind = profile.class_balance(t.training_rows(), "ignited", ["wind_speed"])
    total = F.sum("rows").over(Window.partitionBy(F.lit(0)))  # one row per wind speed of a run
    return rounded(per_wind.withColumn("share_of_rows", F.col("rows") / total), "positive_rate", "share_of_rows")


@query("a17_environment_summary", with_fixtures("env", """
    select count(*) filter (where burnable) burnable_cells, count(*) filter (where building_presence = 1) building_cells,
      min(slope_risk) slope_risk_min, max(slope_risk) slope_risk_max, min(proximity_risk) proximity_risk_min,
      max(proximity_risk) proximity_risk_max, min(material_risk) material_risk_min, max(material_risk) material_risk_max from env"""))
def environment_summary(t: Tables):
    return profile.environment_summary(t.env)


@query("a18_region_stats", with_fixtures("truths", """
    select fire, count(*) cells, round(count(*) * 9.0::double / 10000, 6) hectares, min(r) r_min, max(r) r_max, min(c) c_min, max(c) c_max,
      round(avg(r), 6) r_centroid, round(avg(c), 6) c_centroid from truths where burned = 1 group by 1"""))
def region_stats(t: Tables):
    stats = profile.region_stats(t.truths.filter("burned = 1"), PIXEL, ["fire"])
    return rounded(stats, "hectares", "r_centroid", "c_centroid")


@query("a19_padded_box", with_fixtures("cells dims", """
    select 'crop' mask, greatest(min(r) - 8, 0) r_start, least(max(r) + 8, (select height from dims)) r_end, greatest(min(c) - 8, 0) c_start, least(max(c) + 8, 120) c_end
    from cells where truth = 1 and r between 30 and 60 and c between 50 and 115
    union all select 'empty', 0, height, 0, 120 from dims"""))
def padded_box(t: Tables):
    """Box of the scar inside a window, and of an empty mask."""
    scar = t.cells.filter(is_truth("truth", "one") & F.col("r").between(30, 60) & F.col("c").between(50, 115))
    empty = t.cells.filter(F.col("truth") > 1)
    boxes = [profile.padded_box(m, t.grid, 8).withColumn("mask", F.lit(n)) for n, m in (("crop", scar), ("empty", empty))]
    return boxes[0].unionByName(boxes[1])


@query("a20_truth_audit", with_fixtures("cells dims", """
    select fire, i.check, i.level, i.found from (
      select fire, count(*) cells, max(r) + 1 h, max(c) + 1 w, count(*) filter (where v not in (0, 1)) other, count(*) filter (where v = 1) burned
      from (select r, c, unnest(['alpha', 'beta', 'raw', 'none', 'tiny']) fire,
        unnest([truth, truth_b, cast(proximity_raw as int), 0, case when r * 120 + c < 40 then truth else 0 end]) v from cells) group by 1)
    cross join dims
    join (values ('size', 'error'), ('cells', 'error'), ('values', 'error'), ('no burned cells', 'warning'), ('small burn', 'warning'), ('large burn', 'warning')) k(kind, lvl) on true
    cross join lateral (select kind as check, lvl as level, case kind when 'size' then h * w when 'cells' then cells when 'values' then other else burned end found) i
    where case kind when 'size' then h <> height + 1 or w <> width when 'cells' then cells <> (height + 1) * width when 'values' then other > 0
      when 'no burned cells' then burned = 0 when 'small burn' then burned > 0 and burned < 300 else burned > 30000 end"""))
def truth_audit(t: Tables):
    """Audit five truth layers against a grid that is one row taller than the data."""
    tiny = F.when(F.col("r") * 120 + F.col("c") < 40, F.col("truth")).otherwise(0)
    values = {"alpha": F.col("truth"), "beta": F.col("truth_b"), "raw": F.col("proximity_raw").cast("int"), "none": F.lit(0), "tiny": tiny}
    rows = F.array(*[F.struct(F.lit(n).alias("fire"), v.alias("burned")) for n, v in values.items()])
    truth = t.cells.select("r", "c", F.explode(rows).alias("t")).select("r", "c", "t.*")
    return profile.audit_truth(truth, replace(t.grid, height=t.grid.height + 1), keys=["fire"])


@query("a21_daily_wind", with_fixtures("wind_hourly", """
    select substr(hour_key, 1, 8) as day, round(avg(speed_ms * 3.6::double) filter (where speed_ms >= 0), 6) mean_kmh,
      max(speed_ms * 3.6::double) filter (where speed_ms >= 0 and substr(hour_key, 9, 2) = '11') fire_kmh,
      max(dir_deg) filter (where speed_ms >= 0 and substr(hour_key, 9, 2) = '11') fire_dir,
      count(*) filter (where speed_ms < 0) missing_hours from wind_hourly group by 1"""))
def daily_wind(t: Tables):
    return rounded(wind.daily_wind(t.wind_hourly, 11), "mean_kmh")


@query("a22_mask_fingerprint", with_fixtures("domains dims", """
    select fire, domain, kind, cast(any_value(n) as bigint) cells, sha256(any_value(shape) || any_value(d)) as sha256 from (
      select fire, domain, kind, sum(n) n, sha256(string_agg(o || ':' || d, ',' order by o)) d, any_value(shape) shape from (
        select fire, domain, kind, (i // 4096) // 4096 b2, (i // 4096) % 4096 o, count(*) n, sha256(string_agg(cast(i % 4096 as varchar), ',' order by i)) d, any_value(height || 'x' || width || '|bool|') shape
        from (select fire, domain, 'domain' kind, cast(r as bigint) * 120 + c i, height, width from domains cross join dims
              union all select fire, domain, 'positives', cast(r as bigint) * 120 + c, height, width from domains cross join dims where burned = 1)
        group by 1, 2, 3, 4, 5) group by 1, 2, 3, b2) group by 1, 2, 3"""))
def mask_fingerprint(t: Tables):
    """Digest of every scoring domain and of its positives."""
    masks = []
    for fire, truth in TRUTH_COLUMNS.items():
        r0, c0, size = CROPS[fire]
        for domain, inside in domains.domain_flags(domains.in_window(r0, c0, size, size)).items():
            for kind, kept in (("domain", inside), ("positives", inside & is_truth(truth, "one"))):
                masks.append(F.when(kept, F.struct(F.lit(fire).alias("fire"), F.lit(domain).alias("domain"), F.lit(kind).alias("kind"))))
    rows = t.env.select("r", "c", F.explode(F.array_compact(F.array(*masks))).alias("m")).select("r", "c", "m.*")
    return digest.mask_digest(rows, t.grid, ["fire", "domain", "kind"])


@query("a23_burn_progression", with_fixtures("snapshots", """
    select run_id, step, count(*) filter (where state >= 3) reached_cells, count(*) filter (where state in (3, 4)) active_cells,
      case when count(*) filter (where state in (3, 4)) > 0 then 'time-limited (active)' else 'inactive' end status
    from snapshots group by 1, 2"""))
def burn_progression(t: Tables):
    return transitions.progression(t.snapshots)


PERTURBED = """ball as (select cast(a.range as int) dr, cast(b.range as int) dc, abs(a.range) + abs(b.range) d
  from range(-2, 3) a cross join range(-2, 3) b where abs(a.range) + abs(b.range) <= 2),
hits as (select k.r + dr r, k.c + dc c, count(*) filter (where d <= 0) w0, count(*) filter (where d <= 1) w1, count(*) w2
  from cells k cross join ball where truth = 1 group by 1, 2),
variants as (select k.r, k.c, k.buildings_raw, coalesce(w0, 0) > 0 v0, coalesce(w1, 0) = 5 v1, coalesce(w1, 0) > 0 v2, coalesce(w2, 0) = 13 v3, coalesce(w2, 0) > 0 v4
  from cells k left join hits h on h.r = k.r and h.c = k.c),
long as (select r, c, buildings_raw, unnest(['original', 'erode_1', 'dilate_1', 'erode_2', 'dilate_2']) variant, unnest([v0, v1, v2, v3, v4]) t from variants),
counts as (select area, variant, run_id, count(*) filter (where state >= 3 and t) tp, count(*) filter (where state >= 3 and not t) fp,
  count(*) filter (where state < 3 and t) fn, count(*) filter (where state < 3 and not t) tn
  from long join final using (r, c) cross join (values ('whole'), ('buildings')) q(area) where area = 'whole' or buildings_raw > 0 group by 1, 2, 3)"""


def perturbed_scores(t: Tables, max_n: int = 2):
    """Every run against the truth, its erosions and its dilations, on two areas."""
    truth = t.cells.filter(is_truth("truth", "one"))
    flags = morphology.variant_flags(truth, max_n, t.grid)
    names = morphology.variant_names(max_n)
    cells = t.cells.select("r", "c", "buildings_raw").join(flags, ["r", "c"], "left").na.fill(False, names)
    areas = {"whole": F.lit(True), "buildings": F.col("buildings_raw") > 0}
    wanted = [Case({"area": a, "variant": v}, F.col(v), mask) for a, mask in areas.items() for v in names]
    reached = t.final.filter(is_reached()).select("run_id", "r", "c")
    counts = scoring.score_runs(reached, cells, t.winds.select("run_id"), wanted, ["run_id"])
    return scoring.with_metrics(counts)


@query("a24_sensitivity_band", with_fixtures("cells final", f"""
    select area, metric, round(min(value), 6) low, round(max(value), 6) high from (
      select area, variant, unnest(['f1', 'recall']) metric, unnest([avg({F1_SQL}), avg({R_SQL})]) value from counts group by area, variant)
    group by 1, 2""", PERTURBED))
def sensitivity_band(t: Tables):
    return rounded(scoring.sensitivity_band(perturbed_scores(t), ["area"], "variant", ["f1", "recall"]), "low", "high")


@query("a25_class_weights", with_fixtures("training", """
    select strategy, ignited, n class_rows, round(case strategy when 'balanced' then (sum(n) over (partition by strategy)) / (2 * n)
      when 'custom' then case when ignited = 1 then 7.5 else 1 end else 1 end, 6) weight
    from (select ignited, count(*) n from training group by 1) cross join (values ('balanced'), ('custom'), ('none')) s(strategy)"""))
def class_weights(t: Tables):
    return rounded(sampling.class_weights(t.training_rows(), "ignited", 7.5), "weight")


@query("a26_domain_inventory", with_fixtures("domains masked", f"""
    select *, reference_total - positives positives_outside from (
      select fire, domain, cells, positives, building_cells, invalid_cells, invalid_building_cells, positives_off_buildings,
        max(case when domain = 'whole' then positives end) over (partition by fire) reference_total from (
        select f.fire, d.domain, count(m.r) cells, cast(coalesce(sum(burned), 0) as bigint) positives,
          count(*) filter (where buildings_raw > 0) building_cells, count(*) filter (where not burnable) invalid_cells,
          count(*) filter (where buildings_raw > 0 and not burnable) invalid_building_cells,
          count(*) filter (where burned = 1 and not buildings_raw > 0) positives_off_buildings
        from {CASE_GRID} left join domains m on m.fire = f.fire and m.domain = d.domain left join masked k on k.r = m.r and k.c = m.c group by 1, 2))"""))
def domain_inventory(t: Tables):
    rows = scoring.domain_inventory(t.env, cases(), F.col("buildings_raw") > 0, F.col("burnable"))
    whole = F.max(F.when(F.col("domain") == "whole", F.col("positives"))).over(Window.partitionBy("fire"))  # four domains per fire
    return rows.withColumn("reference_total", whole).withColumn("positives_outside", F.col("reference_total") - F.col("positives"))
