"""Cell-level projections, filters and predicates (P1 to P24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinderframe.functions.columns import (
    col_of,
    flat_index,
    is_active,
    is_reached,
    is_truth,
    outcome,
    row_of,
)
from cinderframe.operators import cells as ops
from cinderframe.operators import features, focal, geometry, learning, probability, profile, transitions
from cinderframe.plans.fixtures import WIDTH, Tables, with_fixtures
from cinderframe.plans.registry import query, r6, rounded
from cinderframe.sources import wind


@query("p1_validity_masks", with_fixtures("masked", "select r, c, nodata_any, ocean, nodata, burnable from masked"))
def validity_masks(t: Tables):
    return ops.with_masks(t.cells).select("r", "c", "nodata_any", "ocean", "nodata", "burnable")


@query("p2_layer_risks", with_fixtures("env", """
    select r, c, round(slope_risk, 6) slope_risk, round(proximity_risk, 6) proximity_risk, building_presence,
      round(material_risk, 6) material_risk from env"""))
def layer_risks(t: Tables):
    env = ops.environment(t.cells)
    return env.select("r", "c", r6("slope_risk"), r6("proximity_risk"), "building_presence", r6("material_risk"))


# The legend as SQL.
LEGEND_SQL = "(values (0, 0.0::double), (1, 0.95::double), (2, 0.80::double), (3, 0.48::double), (4, 0.30::double), (5, 0.15::double)) g(k, risk)"
CLASSED = """classed as (select r, c, cast((r * 120 + c) % 6 as int) material_class, buildings_raw from cells)"""


def classed(t: Tables):
    return t.cells.select("r", "c", ((F.col("r") * 120 + F.col("c")) % 6).cast("int").alias("material_class"), "buildings_raw")


@query("p3_material_legend", with_fixtures("cells", f"select r, c, material_class, risk from classed join {LEGEND_SQL} on k = material_class", CLASSED))
def material_legend(t: Tables):
    return classed(t).withColumn("risk", ops.legend_risk("material_class")).select("r", "c", "material_class", "risk")


RAW_CLASS = """case when i % 101 = 0 then 2.5 when i % 103 = 0 then -1 when i % 107 = 0 then 6 + i % 9
  when i % 109 = 0 then 3.0000001 else materials_raw end"""


def raw_classes(t: Tables):
    return t.cells.withColumn("i", flat_index(WIDTH)).select("r", "c", F.expr(RAW_CLASS).cast("double").alias("raw_class"))


@query("p4_class_validation", with_fixtures("cells", """
    select raw_class as value, count(*) cells from raw
    where not (abs(raw_class - round_even(raw_class, 0)) <= 1e-6 + 1e-5 * abs(round_even(raw_class, 0))
      and round_even(raw_class, 0) between 0 and 5) group by 1 order by 1 limit 10""",
    f"raw as (select cast({RAW_CLASS} as double) raw_class from (select *, r * 120 + c i from cells))"))
def class_validation(t: Tables):
    return ops.class_offenders(raw_classes(t), "raw_class", 10)


@query("p5_class_zero_override", with_fixtures("cells", f"""
    select r, c, material_class, b building_presence, case when b > 0 then risk else 0.0::double end material_risk from (
      select *, case when material_class = 0 then 0 when buildings_raw = 10 then 1 else 0 end b
      from classed join {LEGEND_SQL} on k = material_class)""", CLASSED))
def class_zero_override(t: Tables):
    rows = classed(t).withColumn("building_presence", (F.col("buildings_raw") == 10).cast("int"))
    return ops.override_class_zero(rows).select("r", "c", "material_class", "building_presence", "material_risk")


@query("p6_window_crop", with_fixtures("cells dims", """
    select r - 10 r, c - 20 c, slope_raw, truth, (c + 0.5::double) * 3 x, (height - r - 0.5::double) * 3 y
    from cells cross join dims where r between 10 and 73 and c between 20 and 83"""))
def window_crop(t: Tables):
    return ops.crop(t.cells.select("r", "c", "slope_raw", "truth"), t.grid, 10, 20, 64, 64)


@query("p7_wind_encoding", with_fixtures("wind_hourly", """
    select hour_key, speed_ms * 3.6::double as wind_speed, round(sin(radians(dir_deg)), 6) wind_sin,
      round(cos(radians(dir_deg)), 6) wind_cos from wind_hourly where speed_ms >= 0"""))
def wind_encoding(t: Tables):
    hours = wind.usable_wind(t.wind_hourly).withColumnRenamed("dir_deg", "direction_deg")
    return features.encode_wind(hours).select("hour_key", "wind_speed", r6("wind_sin"), r6("wind_cos"))


@query("p8_composite_flammability", with_fixtures("env", "select r, c, round(building_presence * material_risk, 6) composite_flammability from env"))
def composite(t: Tables):
    return t.env.select("r", "c", r6(ops.composite_flammability(), "composite_flammability"))


BASE_SQL = """least(greatest(0.12::double + 0.2::double * slope_risk + 0.1::double * building_presence
  + 0.2::double * proximity_risk + 0.35::double * material_risk, 0), 1)"""


@query("p9_base_probability", with_fixtures("env", f"select r, c, round({BASE_SQL}, 6) p_base from env"))
def base_probability(t: Tables):
    return t.env.select("r", "c", r6(ops.base_probability(), "p_base"))


@query("p10_rule_probability", with_fixtures("transitions env", f"""
    select run_id, step, r, c, round(least(greatest({BASE_SQL} * wind_weighted_score, 0), 1), 8) p
    from transitions join env using (r, c)"""))
def rule_probability(t: Tables):
    rows = t.transitions.join(t.env, ["r", "c"])
    return rows.select("run_id", "step", "r", "c", F.round(focal.rule_probability(), 8).alias("p"))


@query("p11_fire_binarisation", with_fixtures("final cells", """
    select run_id, r, c, state in (3, 4, 5) reached, state in (3, 4) active, buildings_raw > 0 truth_positive,
      buildings_raw <> 0 truth_nonzero, truth = 1 truth_one from final join cells using (r, c)"""))
def fire_binarisation(t: Tables):
    return t.final.join(t.cells, ["r", "c"]).select(
        "run_id",
        "r",
        "c",
        is_reached().alias("reached"),
        is_active().alias("active"),
        is_truth("buildings_raw", "positive").alias("truth_positive"),
        is_truth("buildings_raw", "nonzero").alias("truth_nonzero"),
        is_truth("truth", "one").alias("truth_one"),
    )


@query("p12_susceptible_cells", with_fixtures("focal snapshots", """
    select f.run_id, f.step, f.r, f.c, f.neighbor_burning_count from focal f
    join snapshots s on s.run_id = f.run_id and s.step = f.step and s.r = f.r and s.c = f.c where s.state = 2"""))
def susceptible(t: Tables):
    snapshots = t.snapshots_by_row
    rows = transitions.susceptible_cells(snapshots, focal.neighbour_counts(snapshots, t.grid, tasks=t.tasks), tasks=t.tasks)
    return rows.select("run_id", "step", "r", "c", "neighbor_burning_count")


P13_VALUES = {f: f"round(t.{f}, 6)" for f in features.SCHEMA_C} | {
    "wind_weighted_score": "case when (t.r + t.c) % 3 = 0 then 0.0::double else round(t.wind_weighted_score, 6) end"
}
P13_SCHEMAS = " union all ".join(
    f"select '{name}' schema_name, t.run_id, t.step, t.r, t.c, [" + ", ".join(P13_VALUES[f] for f in schema) + f"] feature_values, {len(schema)} n_features from training_c t where t.run_id = {42 + i}"
    for i, (name, schema) in enumerate(features.SCHEMAS.items())
)


@query("p13_feature_rows", with_fixtures("training_c", P13_SCHEMAS))
def feature_rows(t: Tables):
    """Assembled rows of the four schemas, one run each; a third of the rows come without a wind score, which then counts as 0.

    Every row passes the contract of its schema: the names in order, and as many finite values.
    """
    absent = (F.col("r") + F.col("c")) % 3 == 0
    rows = t.transitions.withColumn("wind_weighted_score", F.when(~absent, F.col("wind_weighted_score")))
    parts = []
    for i, (name, schema) in enumerate(features.SCHEMAS.items()):
        assembled = features.assemble(rows.filter(F.col("run_id") == 42 + i), t.env, t.winds, name, tasks=t.tasks)
        vectors = features.feature_vectors(assembled.drop("ignited"), name)
        values = F.transform("feature_values", lambda x: F.round(x, 6))
        parts.append(vectors.select(F.lit(name).alias("schema_name"), "run_id", "step", "r", "c", values.alias("feature_values"), F.lit(len(schema)).alias("n_features")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("p14_burnable_rows", with_fixtures("env", """
    select r, c, cast(r as bigint) * 120 + c cell_index, round(slope_risk, 6) slope_risk from env where burnable"""))
def burnable_rows(t: Tables):
    return ops.burnable_index(t.env, WIDTH).select("r", "c", "cell_index", r6("slope_risk"))


@query("p15_flat_index", with_fixtures("cells", "select cast(r as bigint) * 120 + c cell_index, r, c from cells"))
def flat_index_round_trip(t: Tables):
    index = t.cells.select(flat_index(WIDTH).alias("cell_index"))
    return index.select("cell_index", row_of("cell_index", WIDTH).alias("r"), col_of("cell_index", WIDTH).alias("c"))


@query("p16_interaction_features", with_fixtures("training", """
    select run_id, step, r, c, round(slope_risk * neighbor_burning_count, 6) slope_x_neighbors,
      round(wind_speed * neighbor_burning_count, 6) wind_x_neighbors, round(slope_risk * building_presence, 6) slope_x_building,
      round(slope_risk * wind_speed, 6) slope_x_wind, round(proximity_risk * building_presence, 6) proximity_x_building,
      round(proximity_risk * neighbor_burning_count, 6) proximity_x_neighbors,
      neighbor_burning_count * neighbor_burning_count neighbors_squared from training"""))
def interactions(t: Tables):
    names = list(features.INTERACTIONS)
    rows = features.add_interactions(t.training_rows())
    return rounded(rows.select("run_id", "step", "r", "c", *names), *names[:-1])


@query("p17_feature_projection", with_fixtures("training", """
    select run_id, step, r, c, round(slope_risk, 6) slope_risk, proximity_risk, building_presence, round(material_risk, 6) material_risk,
      wind_speed, round(wind_sin, 6) wind_sin, round(wind_cos, 6) wind_cos, neighbor_burning_count,
      round(composite_flammability, 6) composite_flammability from training"""))
def feature_projection(t: Tables):
    rows = features.project(t.training_rows(), ["wind_weighted_score", "not_a_column"])
    return rounded(rows, "slope_risk", "material_risk", "wind_sin", "wind_cos", "composite_flammability")


@query("p18_point_to_cell", with_fixtures("points dims", """
    select point_id, x, y, r, c, case when r <> floor(height - y * (1.0::double / 3)) or c <> floor(x * (1.0::double / 3)) then 'drift'
        when r between 0 and height - 1 and c between 0 and width - 1 then 'inside' else 'outside' end status,
      (c + 0.5::double) * 3 x_centre, height * 3 - (r + 0.5::double) * 3 y_centre from (
      select *, cast(floor((height * 3 - y) / 3) as int) r, cast(floor(x / 3) as int) c from points cross join dims)"""))
def point_to_cell(t: Tables):
    return geometry.locate(t.points, t.grid)


@query("p19_ignition_checks", with_fixtures("points dims masked", """
    select p.point_id, p.r, p.c, case when m.r is null then 'out of bounds' when not burnable then 'non-burnable' else 'accepted' end reason
    from (select point_id, cast(floor((height * 3 - y) / 3) as int) r, cast(floor(x / 3) as int) c from points cross join dims) p
    left join masked m on m.r = p.r and m.c = p.c"""))
def ignition_checks(t: Tables):
    located = geometry.locate(t.points, t.grid).select("point_id", "r", "c")
    return geometry.check_ignitions(located, t.env).select("point_id", "r", "c", "reason")


@query("p20_probability_gate", with_fixtures("scored", "select id, p, case when p >= 0.40 then p else 0.0::double end gated from scored"))
def probability_gate(t: Tables):
    return t.scored.select("id", "p", probability.gate(F.col("p"), 0.40).alias("gated"))


@query("p21_hard_prediction", with_fixtures("scored", "select id, label, cast(p >= 0.5 as int) pred from scored"))
def hard_prediction(t: Tables):
    return t.scored.select("id", "label", probability.hard_prediction(F.col("p"), 0.5).alias("pred"))


STATIC_FEATURES = ("slope_risk", "proximity_risk", "building_presence", "material_risk", "neighbor_burning_count", "wind_weighted_score")


@query("p22_linear_scoring", with_fixtures("training", f"""
    select run_id, step, r, c, 'mean-difference' model, round(1 / (1 + exp(-(-3.0::double + {" + ".join(f"(t.{f} - m_{f}) / s_{f} * (a_{f} - b_{f}) / s_{f}" for f in STATIC_FEATURES)}))), 6) p
    from training t cross join stats""", f"""stats as (select {", ".join(
        f"avg({f}) m_{f}, stddev_pop({f}) s_{f}, avg(case when ignited = 1 then {f} end) a_{f}, avg(case when ignited = 0 then {f} end) b_{f}" for f in STATIC_FEATURES)} from training)"""))
def linear_scoring(t: Tables):
    """Score every row with a coefficient table: standardised class-mean differences."""
    rows = t.training_table()
    scales = learning.standardisation(rows, STATIC_FEATURES)
    gaps = profile.class_means(rows, STATIC_FEATURES, "ignited")
    coefficients = scales.join(gaps, "feature").select(
        F.lit("mean-difference").alias("model"),
        "feature",
        "mean",
        "scale",
        (F.col("difference") / F.col("scale")).alias("coef"),
        F.lit(-3.0).alias("intercept"),
    )
    ids = ["run_id", "step", "r", "c"]
    return rounded(probability.linear_probability(rows.select(*ids, *STATIC_FEATURES), ids, coefficients), "p")


@query("p23_outcome_class", with_fixtures("final cells", """
    select run_id, r, c, case when state >= 3 and truth = 1 then 'TP' when state >= 3 then 'FP' when truth = 1 then 'FN' else 'TN' end outcome
    from final join cells using (r, c)"""))
def outcome_class(t: Tables):
    rows = t.final.join(t.cells, ["r", "c"])
    return rows.select("run_id", "r", "c", outcome(is_reached(), is_truth("truth", "nonzero")).alias("outcome"))


@query("p24_wind_units", with_fixtures("wind_hourly", """
    select hour_key, speed_ms, dir_deg, speed_ms * 3.6::double speed_kmh from wind_hourly where speed_ms >= 0 and dir_deg >= 0"""))
def wind_units(t: Tables):
    return wind.usable_wind(t.wind_hourly)
