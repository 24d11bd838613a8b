"""Joins (J1 to J11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinderframe.functions.columns import is_reached, is_truth
from cinderframe.operators import domains, focal, geometry, profile, scenarios, transitions
from cinderframe.plans.fixtures import CROPS, PIXEL, WIDTH, Tables, with_fixtures
from cinderframe.plans.registry import query, rounded
from cinderframe.session import scratch_path, written
from cinderframe.sources import tables, wind

REQUESTED = (3, 6, 9, 20)

# Scenario grid.
SPEEDS = (5.0, 10.0, 15.0, 20.0, 25.0)
DIRECTIONS = (0.0, 45.0, 90.0, 135.0, 180.0, 225.0, 270.0, 315.0)
RUNS_PER_WIND = 5
FIRST_SEED = 42


@query("j1_coregistration", with_fixtures("final cells", """
    select run_id, 'both' side, count(*) cells, count(*) filter (where state >= 3) predicted,
      cast(sum(truth) as bigint) truth from final join cells using (r, c) group by 1"""))
def coregistration(t: Tables):
    pairs = domains.coregister(t.final, t.cells.select("r", "c", "truth"))
    return pairs.groupBy("run_id", "side").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(is_reached()).alias("predicted"), F.sum("truth").alias("truth")
    )


@query("j2_neighbourhood_join", with_fixtures("snapshots offsets dims", """
    select s.run_id, s.step, s.r - o.dr r, s.c - o.dc c, count(*) neighbor_burning_count
    from snapshots s cross join offsets o cross join dims where state = 4
      and s.r - o.dr between 0 and height - 1 and s.c - o.dc between 0 and width - 1 group by 1, 2, 3, 4"""))
def neighbourhood(t: Tables):
    return focal.neighbour_counts(t.snapshots, t.grid, tasks=t.tasks)


@query("j3_transition_labels", with_fixtures("transitions", """
    select run_id, step, r, c, neighbor_burning_count, round(wind_weighted_score, 8) wind_weighted_score, ignited from transitions"""))
def transition_labels(t: Tables):
    return t.transitions.withColumn("wind_weighted_score", F.round("wind_weighted_score", 8))


@query("j4_domain_restriction", with_fixtures("domains final", """
    select d.domain, f.run_id, count(*) cells, count(*) filter (where state >= 3) predicted
    from final f join domains d using (r, c) where d.fire = 'alpha' group by 1, 2"""))
def domain_restriction(t: Tables):
    r0, c0, size = CROPS["alpha"]
    flags = domains.domain_flags(domains.in_window(r0, c0, size, size))
    long = domains.domain_rows(t.env, flags)
    return domains.restrict_each(t.final, long).groupBy("domain", "run_id").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(is_reached()).alias("predicted")
    )


@query("j5_as_of_snapshot", with_fixtures("snapshots", """
    select s.run_id, q.requested_step, s.step actual_step, s.r, s.c, s.state
    from (values (3), (6), (9), (20)) q(requested_step)
    join snapshots s on s.step = (select max(step) from (select distinct step from snapshots) where step <= q.requested_step)"""))
def as_of_snapshot(t: Tables):
    states = transitions.as_of_snapshots(t.snapshots, t.run_log, REQUESTED)
    return states.select("run_id", "requested_step", "actual_step", "r", "c", "state")


@query("j5_stored_as_of", with_fixtures("snapshots", """
    select q.requested_step, s.step actual_step, s.run_id, s.state, count(*) cells, cast(sum(s.r * 120 + s.c) as bigint) cell_sum
    from (values (3), (6), (9), (20)) q(requested_step)
    join snapshots s on s.step = (select max(step) from (select distinct step from snapshots) where step <= q.requested_step)
    group by 1, 2, 3, 4"""))
def stored_as_of(t: Tables):
    """States at the requested horizons, from the stored snapshot table: only the folders of four of the thirteen steps are read."""
    path = tables.write_snapshots(t.snapshots, scratch_path(t.spark, "snapshots"))
    log = written(t.run_log, "recorded-steps")
    states = transitions.as_of_snapshots(tables.read_snapshots(t.spark, path), log, REQUESTED)
    key = F.col("r").cast("bigint") * WIDTH + F.col("c")
    return states.groupBy("requested_step", "actual_step", "run_id", "state").agg(F.count(F.lit(1)).alias("cells"), F.sum(key).alias("cell_sum"))


@query("j6_circle_cells", with_fixtures("dims", """
    select s_suppkey centre_id, radius_m, g.r, h.c,
      (cast(g.r as bigint) - r0) * (g.r - r0) + (cast(h.c as bigint) - c0) * (h.c - c0) dist2
    from (select s_suppkey, cast((s_suppkey * 31) % height as int) r0, cast((s_suppkey * 17) % 120 as int) c0 from supplier cross join dims) k
    cross join (values (6.0::double), (15.0::double), (30.0::double)) q(radius_m)
    join (select cast(range as int) r from range(0, 100000)) g on g.r between r0 - 10 and r0 + 10
    join (select cast(range as int) c from range(0, 120)) h on h.c between c0 - 10 and c0 + 10
    where g.r < (select height from dims)
      and (g.r - r0) * (g.r - r0) + (h.c - c0) * (h.c - c0) <= (radius_m / 3) * (radius_m / 3)"""))
def circle_cells(t: Tables):
    """Cells of three circles around one centre per supplier."""
    centres = t.table("supplier").selectExpr(
        "s_suppkey centre_id", f"cast((s_suppkey * 31) % {t.grid.height} as int) r0", "cast((s_suppkey * 17) % 120 as int) c0"
    )
    return geometry.circle_cells(centres, "centre_id", [6.0, 15.0, 30.0], PIXEL, t.grid)


VERTICES_SQL = """vertices as (
  select poly_id, ring_id, seq, x0 + d * dx x, y0 + d * dy y from (
    select s_suppkey poly_id, cast(7 + (s_suppkey * 13) % 100 as double) * 3 x0,
      cast(3 + (s_suppkey * 29) % height as double) * 3 y0, cast(9 + s_nationkey as double) d from supplier cross join dims)
  join (values (0, 0, 0.0::double, 0.0::double), (0, 1, 2.0::double, 0.1::double), (0, 2, 1.1::double, 0.9::double),
    (0, 3, 2.1::double, 2.0::double), (0, 4, 0.1::double, 1.9::double), (1, 0, 0.4::double, 0.4::double),
    (1, 1, 0.9::double, 0.4::double), (1, 2, 0.9::double, 0.9::double), (1, 3, 0.4::double, 0.9::double))
    v(ring_id, seq, dx, dy) on ring_id = 0 or poly_id % 3 = 0),
edges as (
  select poly_id, x x1, y y1, coalesce(lead(x) over w, first_value(x) over w) x2, coalesce(lead(y) over w, first_value(y) over w) y2
  from vertices window w as (partition by poly_id, ring_id order by seq))"""


@query("j7_polygon_cells", with_fixtures("cells dims", """
    select distinct r, c from (
      select e.poly_id, k.r, k.c from (select r, c, (c + 0.5::double) * 3 xc, (height - r - 0.5::double) * 3 yc from
          (select cast(range as int) r from range(0, 100000)) rr cross join (select cast(range as int) c from range(0, 120)) cc
          cross join dims where r < height) k
      join edges e on yc >= least(y1, y2) and yc < greatest(y1, y2) and x1 + (yc - y1) * (x2 - x1) / (y2 - y1) <= xc
      group by 1, 2, 3 having count(*) % 2 = 1)""", VERTICES_SQL))
def polygon_cells(t: Tables):
    return geometry.burn_polygons(t.vertices(t.grid), t.grid)


@query("j8_scenario_grid", with_fixtures("wind_hourly", f"""
    select scenario_id, g.speed_kmh, g.direction_deg, run, {FIRST_SEED} + scenario_id seed, coalesce(observed_hours, 0) observed_hours
    from (select cast(row_number() over (order by s, d, run) - 1 as int) scenario_id, s * 5.0::double speed_kmh, d * 45.0::double direction_deg, run
      from (select cast(range as int) s from range(1, 6)) cross join (select cast(range as int) d from range(0, 8))
      cross join (select cast(range as int) run from range(0, 5))) g
    left join (select (least(floor(speed_ms * 3.6::double / 5), 4) + 1) * 5.0::double speed_kmh,
        floor(((dir_deg + 22.5::double) % 360) / 45) * 45.0::double direction_deg, count(*) observed_hours
      from wind_hourly where speed_ms >= 0 group by 1, 2) o on o.speed_kmh = g.speed_kmh and o.direction_deg = g.direction_deg"""))
def scenario_grid(t: Tables):
    """The 200 scenarios and how many observed hours have each scenario's wind."""
    grid = scenarios.scenario_grid(t.spark, SPEEDS, DIRECTIONS, RUNS_PER_WIND, FIRST_SEED)
    observed = scenarios.nearest_scenario_wind(wind.usable_wind(t.wind_hourly), SPEEDS, DIRECTIONS)
    return grid.join(observed, ["speed_kmh", "direction_deg"], "left").na.fill(0, ["observed_hours"])


@query("j9_excluded_cells", with_fixtures("masked", """
    select r, c, case when buildings_raw > 0 then 'invalid building' else 'off buildings' end reason
    from masked where truth = 1 and not (buildings_raw > 0 and burnable)"""))
def excluded_cells(t: Tables):
    positives = t.cells.filter(is_truth("truth", "one"))
    kept = t.env.filter((F.col("buildings_raw") > 0) & F.col("burnable"))
    lost = domains.excluded(positives, kept)
    reason = F.when(F.col("buildings_raw") > 0, "invalid building").otherwise("off buildings")
    return lost.select("r", "c", reason.alias("reason"))


STATIC = ("slope_risk", "proximity_risk", "material_risk", "wind_weighted_score", "neighbor_burning_count")


@query("j10_model_comparison", with_fixtures("training", """
    select feature, round(old_coef, 6) old_coef, round(new_coef, 6) new_coef, round(abs(old_coef - new_coef), 6) abs_diff,
      round(max(abs(old_coef - new_coef)) over (), 6) max_abs_diff from (
    """ + " union all ".join(f"""select '{f}' feature,
        avg({f}) filter (where ignited = 1 and run_id < 44) - avg({f}) filter (where ignited = 0 and run_id < 44) old_coef,
        avg({f}) filter (where ignited = 1 and run_id >= 44) - avg({f}) filter (where ignited = 0 and run_id >= 44) new_coef
        from training""" for f in STATIC) + ")"))
def model_comparison(t: Tables):
    """Class-mean difference models of two groups of runs, side by side."""
    rows = t.training_table()

    def fit(part):
        return profile.class_means(part, STATIC, "ignited").withColumnRenamed("difference", "coef")

    changes = domains.coefficient_changes(fit(rows.filter("run_id < 44")), fit(rows.filter("run_id >= 44")))
    # One row per feature: the maximum is over a handful of rows.
    worst = changes.agg(F.max("abs_diff")).scalar()
    return rounded(changes.withColumn("max_abs_diff", worst), "old_coef", "new_coef", "abs_diff", "max_abs_diff")


@query("j11_layer_equality", with_fixtures("cells", """
    select count(*) cells, count(*) filter (where (buildings_raw = 10) <> (materials_raw > 0)) as different,
      count(*) filter (where (buildings_raw > 0) <> (materials_raw > 0)) different_loose from cells"""))
def layer_equality(t: Tables):
    buildings = t.cells.select("r", "c", (F.col("buildings_raw") == 10).alias("exact"), (F.col("buildings_raw") > 0).alias("loose"))
    materials = t.cells.select("r", "c", (F.col("materials_raw") > 0).alias("m"))
    return domains.disagreement(buildings, materials, {"exact": "different", "loose": "different_loose"}, "m")
