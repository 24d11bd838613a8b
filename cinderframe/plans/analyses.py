"""Documented analyses (D1 to D13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinderframe.functions.columns import is_reached, is_truth, squared_distance
from cinderframe.operators import baselines, probability, profile, sampling, scoring, transitions
from cinderframe.plans.aggregates import F1_SQL, HORIZON_COUNTS, METRIC_SQL, METRICS, horizon_scores
from cinderframe.plans.fixtures import IGNITION, PIXEL, SEEDS, Tables, with_fixtures
from cinderframe.plans.ranking import FEATURES, IDS, IDS_HASH
from cinderframe.plans.registry import query, rounded
from cinderframe.session import written

R0, C0 = IGNITION
DIST2 = f"((cast(r as bigint) - {R0}) * (r - {R0}) + (cast(c as bigint) - {C0}) * (c - {C0}))"


@query("d1_under_sampling", with_fixtures("training", f"""
    select run_id, step, r, c, ignited from (
      select *, row_number() over (partition by ignited order by {IDS_HASH}, run_id, step, r, c) rk from training)
    where ignited = 1 or rk <= 10 * (select count(*) from training where ignited = 1)"""))
def under_sampling(t: Tables):
    return sampling.under_sample(t.labels_table, "ignited", IDS, ratio=10)


@query("d2_positives_per_chunk", with_fixtures("training", """
    select (n - 1) // 10000 chunk, count(*) "rows", cast(sum(ignited) as bigint) positives
    from (select ignited, row_number() over (order by run_id, step, r, c) n from training) group by 1"""))
def positives_per_chunk(t: Tables):
    return profile.positives_per_chunk(t.labels_table, "ignited", ["run_id", "step", "r"], ["c"], 10_000)


@query("d3_class_means", with_fixtures("training", "select feature, round(m0, 6) mean_0, round(m1, 6) mean_1, round(m1 - m0, 6) difference from (" + " union all ".join(
    f"select '{f}' feature, avg({f}) filter (where ignited = 0) m0, avg({f}) filter (where ignited = 1) m1 from training" for f in FEATURES) + ")"))
def class_means(t: Tables):
    return rounded(profile.class_means(t.training_rows(), FEATURES, "ignited"), "mean_0", "mean_1", "difference")


DISCRETE = ("slope_risk", "proximity_risk", "building_presence", "material_risk", "neighbor_burning_count", "composite_flammability")


@query("d4_positive_distributions", with_fixtures("training", "select feature, round(v, 6) as value, count(*) cells from (" + " union all ".join(
    f"select '{f}' feature, {f} v from training where ignited = 1" for f in DISCRETE) + ") group by 1, 2"))
def positive_distributions(t: Tables):
    positives = t.training_rows().filter("ignited = 1")
    return rounded(profile.value_counts(rounded(positives, *DISCRETE), DISCRETE), "value")


PROFILED = ("run_id", "step", "slope_risk", "proximity_risk", "building_presence", "material_risk", "wind_speed", "neighbor_burning_count", "wind_weighted_score", "ignited", "flag")


@query("d5_column_profile", with_fixtures("training", """select "column", type, count(distinct v) distinct_values, count(*) filter (where v is null) nulls from (""" + " union all ".join(
    f"""select '{c}' "column", '{'int' if c in ('run_id', 'step', 'ignited', 'flag') else 'double'}' type, cast({'round(wind_weighted_score, 8)' if c == 'wind_weighted_score' else c} as varchar) v from noted""" for c in PROFILED) + ") group by 1, 2",
    "noted as (select *, case when ignited = 1 then step end flag from training)"))
def column_profile(t: Tables):
    """Types, distinct values and nulls of the training columns and of one with gaps."""
    rows = t.training_rows().withColumn("flag", F.when(F.col("ignited") == 1, F.col("step")))
    return profile.column_profile(rows.withColumn("wind_weighted_score", F.round("wind_weighted_score", 8)), PROFILED)


@query("d6_single_feature_auc", with_fixtures("training", "select feature, round(sum(pos::double * (before + neg / 2)) / (sum(pos)::double * sum(neg)), 6) roc_auc from (select *, coalesce(sum(neg) over (partition by feature order by v rows between unbounded preceding and 1 preceding), 0) before from (select feature, v, sum(ignited) pos, sum(1 - ignited) neg from (" + " union all ".join(
    f"select '{f}' feature, round({f}, 9) v, ignited from training" for f in FEATURES) + ") group by 1, 2)) group by 1"))
def single_feature_auc(t: Tables):
    rows = t.training_table().withColumns({f: F.round(f, 9) for f in FEATURES})
    return rounded(probability.feature_auc(rows, FEATURES, "ignited"), "roc_auc")


@query("d7_paired_differences", with_fixtures("snapshots domains", f"""
    select fire, domain, count(*) pairs, round(avg(b - a), 6) mean_diff, count(*) filter (where b > a) wins from (
      select fire, domain, run_id, max({F1_SQL}) filter (where requested_step = 6) a, max({F1_SQL}) filter (where requested_step = 9) b
      from counts group by 1, 2, 3) group by 1, 2""", HORIZON_COUNTS))
def paired_differences(t: Tables):
    """F1 of two horizons, paired by seed."""
    scores = horizon_scores(t, (6, 9)).withColumn("config", F.concat(F.lit("h"), F.col("requested_step").cast("string")))
    pairs = scoring.paired_differences(scores, "config", "h6", "h9", ["fire", "domain"], "run_id", "f1")
    return rounded(pairs, "mean_diff")


@query("d8_equal_area_circle", with_fixtures("final cells", f"""
    select run_id, n_cells, max(d2) dist2, round(3 * sqrt(max(d2)), 6) radius_m, count(*) filter (where truth = 1) tp, count(*) filter (where truth = 0) fp
    from (select *, {DIST2} d2, row_number() over (order by {DIST2}, r, c) rk from cells where buildings_raw > 0)
    join (select run_id, count(*) n_cells from final join cells using (r, c) where state >= 3 and buildings_raw > 0 group by 1) n on rk <= n_cells
    group by 1, 2"""))
def equal_area_circle(t: Tables):
    """Per run, the circle of as many building cells as the run burned, and its score."""
    buildings = t.cells.filter("buildings_raw > 0").select("r", "c", "truth")
    burned = t.final.filter(is_reached()).join(buildings.select("r", "c"), ["r", "c"])
    sizes = burned.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_cells"))
    scores = baselines.equal_area_scores(written(buildings, "buildings"), F.col("truth") == 1, sizes, "run_id", R0, C0)
    return scores.withColumn("radius_m", F.round(F.lit(PIXEL) * F.sqrt("dist2"), 6))


@query("d9_scar_distance", with_fixtures("truths", f"""
    select fire, round(max(3 * sqrt({DIST2})), 6) max_m, round(quantile_cont(3 * sqrt({DIST2}), 0.95), 6) p95_m from truths where burned = 1 group by 1"""))
def scar_distance(t: Tables):
    """Largest and 95th-percentile distance of each scar from the ignition."""
    scars = t.truths.filter("burned = 1").withColumn("metres", F.lit(PIXEL) * F.sqrt(squared_distance(R0, C0)))
    p95 = profile.exact_percentile(scars, "metres", 0.95, ["fire"], {"__band": F.floor(F.col("__v") / 64)})
    far = scars.groupBy("fire").agg(F.max("metres").alias("max_m"))
    return rounded(far.join(p95.withColumnRenamed("percentile", "p95_m"), "fire"), "max_m", "p95_m")


@query("d10_burn_growth", with_fixtures("snapshots cells", """
    select run_id, fire, max(n) final_cells, min(case when n >= target then step end) passing_step from (
      select run_id, step, count(*) filter (where state >= 3) n from snapshots group by 1, 2)
    cross join (select unnest(['alpha', 'beta']) fire, unnest([sum(truth), sum(truth_b)]) target from cells) group by 1, 2"""))
def burn_growth(t: Tables):
    """Step at which each run's burn first reaches the size of each scar."""
    sizes = t.cells.agg(F.struct(F.sum("truth").alias("alpha"), F.sum("truth_b").alias("beta"))).scalar()
    growth = transitions.progression(t.snapshots).withColumn("sizes", sizes)
    fires = F.array(*[F.struct(F.lit(f).alias("fire"), F.col(f"sizes.{f}").alias("target")) for f in ("alpha", "beta")])
    long = growth.select("run_id", "step", "reached_cells", F.explode(fires).alias("f")).select("*", "f.fire", "f.target")
    return transitions.first_passing_step(long, F.col("target"), ["run_id", "fire"])


@query("d11_run_identity", with_fixtures("final cells", """
    select a.run_id pair, truth = 1 truth, count(*) filter (where a.state >= 3 and b.state >= 3) shared,
      count(*) filter (where a.state >= 3 and b.state < 3) only_a, count(*) filter (where a.state < 3 and b.state >= 3) only_b
    from final a join final b on b.run_id = a.run_id + 1 and b.r = a.r and b.c = a.c join cells k on k.r = a.r and k.c = a.c group by 1, 2"""))
def run_identity(t: Tables):
    """Burned cells that neighbouring runs share or not, by truth class."""
    reached = t.final.filter(is_reached())
    a = reached.filter(F.col("run_id") < SEEDS[-1]).select(F.col("run_id").alias("pair"), "r", "c")
    b = reached.filter(F.col("run_id") > SEEDS[0]).select((F.col("run_id") - 1).alias("pair"), "r", "c")
    truth = t.cells.select("r", "c", is_truth("truth", "one").alias("truth"))
    return scoring.changed_cells(a, b, truth, ["pair"])


@query("d12_centroid_bearing", with_fixtures("snapshots", f"""
    select run_id, step, round(rc, 6) r_centroid, round(cc, 6) c_centroid,
      round((degrees(atan2(cc - {C0}, {R0} - rc)) + 360) % 360, 6) bearing_deg from (
      select run_id, step, avg(r) rc, avg(c) cc from snapshots where state in (3, 4) group by 1, 2)"""))
def centroid_bearing(t: Tables):
    """Bearing of the active front's centroid from the ignition, by run and step."""
    front = t.snapshots.filter(F.col("state").isin(3, 4))
    return rounded(baselines.centroid_bearing(front, R0, C0, ["run_id", "step"]), "r_centroid", "c_centroid", "bearing_deg")


@query("d13_combined_datasets", with_fixtures("training", """
    select case when grouping(source) = 1 then 'all' else source end source, count(*) "rows", cast(sum(ignited) as bigint) positives, round(avg(ignited), 6) positive_rate
    from (select *, case when wind_speed > 10 then 'strong' else 'light' end source from training) group by rollup (source)"""))
def combined_datasets(t: Tables):
    """Two datasets combined, and the balance of each and of both."""
    rows = t.training_table().select(*IDS, "wind_speed", "ignited")
    strong = rows.filter("wind_speed > 10").withColumn("source", F.lit("strong"))
    light = rows.filter("wind_speed <= 10").withColumn("source", F.lit("light"))
    combined = strong.unionByName(light)
    parts = profile.class_balance(combined, "ignited", ["source"])
    whole = profile.class_balance(combined, "ignited").withColumn("source", F.lit("all"))
    return rounded(parts.unionByName(whole), "positive_rate")
