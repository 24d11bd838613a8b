"""Hand-computed and brute-force checks of the cell and grid operators."""

import math
import random
import re
from dataclasses import replace

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cinderframe.functions.grid import Grid
from cinderframe.functions.joins import fits_broadcast, inline_table, join_metadata
from cinderframe.operators import baselines, cells, digest, domains, features, focal, geometry, morphology, profile, transitions
from cinderframe.plans import fixtures
from cinderframe.plans.fixtures import Tables
from cinderframe.sources import layers


def snapshot(spark, rows):
    return spark.createDataFrame(rows, "run_id int, step int, r int, c int, state int")


def winds(spark, speed, direction):
    return spark.createDataFrame([(1, speed, direction)], "run_id int, speed_kmh double, direction_deg double")


def test_north_wind_pushes_south(spark):
    blazing = snapshot(spark, [(1, 0, 1, 1, 4)])
    grid = Grid(0, 9, 3, 3, 3)
    scores = {(x.r, x.c): x.wind_score for x in focal.neighbour_scores(blazing, winds(spark, 25.0, 0.0), grid).collect()}
    half = math.sqrt(0.5) / 2
    want = {(2, 0): 1 + half, (2, 1): 1.5, (2, 2): 1 + half, (1, 0): 1.0, (1, 2): 1.0, (0, 0): 1 - half, (0, 1): 0.5, (0, 2): 1 - half}
    assert scores == pytest.approx(want)


def test_kernel_sums_to_eight_unless_clamped(spark):
    for speed, clamped in ((17.7, False), (47.4, False), (80.0, True)):
        total = focal.with_kernel(winds(spark, speed, 49.0)).first()["kernel_sum"]
        assert (total > 8.0 + 1e-9) == clamped


def test_corner_has_three_targets(spark):
    corner = snapshot(spark, [(1, 0, 0, 0, 4)])
    grid = Grid(0, 9, 3, 3, 3)
    assert focal.neighbour_counts(corner, grid).count() == 3
    assert focal.neighbour_scores(corner, winds(spark, 5.0, 90.0), grid).count() == 3
    assert focal.neighbour_counts(corner.filter("state = 5"), grid).count() == 0


def test_dense_scores_fill_zero(spark, mask_of):
    grid = Grid(0, 9, 3, 3, 3)
    scores = focal.neighbour_scores(snapshot(spark, [(1, 0, 0, 0, 4)]), winds(spark, 5.0, 90.0), grid)
    dense = focal.densify(mask_of({(r, c) for r in range(3) for c in range(3)}), scores)
    assert dense.count() == 9
    assert dense.filter("neighbor_burning_count = 0").count() == 6


def test_transition_labels_by_hand(spark):
    rows = [(1, 0, 0, 0, 4), (1, 0, 0, 1, 2), (1, 0, 0, 2, 2), (1, 0, 1, 0, 2), (1, 0, 1, 1, 1)]
    rows += [(1, 1, 0, 0, 5), (1, 1, 0, 1, 3), (1, 1, 0, 2, 2), (1, 1, 1, 0, 2), (1, 1, 1, 1, 1)]
    rows += [(1, 2, 0, 0, 5), (1, 2, 0, 1, 4), (1, 2, 0, 2, 2), (1, 2, 1, 0, 2), (1, 2, 1, 1, 1)]
    snaps = snapshot(spark, rows)
    got = {
        (x.step, x.r, x.c): (x.neighbor_burning_count, x.ignited)
        for x in transitions.label_transitions(snaps, winds(spark, 5.0, 0.0), Grid(0, 6, 3, 2, 3)).collect()
    }
    # Step 2 has no successor; (1, 1) cannot burn; (0, 2) is out of reach at step 0.
    assert got == {(0, 0, 1): (1, 1), (0, 1, 0): (1, 0)}


def test_as_of_keeps_the_last_state_of_an_early_stop(spark):
    snaps = snapshot(spark, [(1, s, 0, 0, min(3 + s, 5)) for s in range(3)] + [(2, s, 0, 0, 3) for s in range(6)])
    log = snaps.select("run_id", "step").distinct()
    got = {
        (x.run_id, x.requested_step): (x.actual_step, x.state)
        for x in transitions.as_of_snapshots(snaps, log, [1, 4, 9]).collect()
    }
    assert got == {(1, 1): (1, 4), (1, 4): (2, 5), (1, 9): (2, 5), (2, 1): (1, 3), (2, 4): (4, 3), (2, 9): (5, 3)}


def brute_dilate(mask, n, h, w):
    return {
        (r + dr, c + dc)
        for r, c in mask
        for dr in range(-n, n + 1)
        for dc in range(-n, n + 1)
        if abs(dr) + abs(dc) <= n and 0 <= r + dr < h and 0 <= c + dc < w
    }


def brute_erode(mask, n):
    ball = [(dr, dc) for dr in range(-n, n + 1) for dc in range(-n, n + 1) if abs(dr) + abs(dc) <= n]
    return {(r, c) for r, c in mask if all((r + dr, c + dc) in mask for dr, dc in ball)}


def test_morphology_by_hand(mask_of, cells_of, small_grid):
    assert len(cells_of(morphology.dilate(mask_of({(3, 3)}), 2, small_grid))) == 13
    block = {(r, c) for r in range(1, 6) for c in range(1, 6)}
    assert cells_of(morphology.erode(mask_of(block), 1, small_grid)) == {(r, c) for r in range(2, 5) for c in range(2, 5)}
    border = {(r, c) for r in range(0, 3) for c in range(0, 3)}
    assert cells_of(morphology.erode(mask_of(border), 1, small_grid)) == {(1, 1)}


def test_morphology_brute_force(mask_of, cells_of):
    rng = random.Random(3)
    grid = Grid(0, 60, 3, 20, 17)
    mask = {(r, c) for r in range(20) for c in range(17) if rng.random() < 0.85}
    flags = morphology.variant_flags(mask_of(mask), 3, grid)
    for n in (1, 2, 3):
        assert cells_of(flags.filter(f"dilate_{n}")) == brute_dilate(mask, n, 20, 17)
        assert cells_of(flags.filter(f"erode_{n}")) == brute_erode(mask, n)
    assert cells_of(flags.filter("original")) == mask


def test_large_radius_is_composed(mask_of, cells_of):
    grid = Grid(0, 120, 3, 40, 40)
    seed = {(3, 5), (20, 22)}
    big = brute_dilate(seed, 9, 40, 40)
    assert cells_of(morphology.dilate(mask_of(seed), 9, grid)) == big
    assert cells_of(morphology.erode(mask_of(big), 6, grid)) == brute_erode(big, 6)


def test_morphology_over_many_tiles_and_keys(spark, cells_of, monkeypatch):
    monkeypatch.setattr(morphology, "TILE", 8)
    grid = Grid(0.0, 3.0 * 90, 3.0, 90, 75)
    rng = random.Random(3)
    masks = {k: {(rng.randrange(90), rng.randrange(75)) for _ in range(size)} for k, size in (("a", 6), ("b", 6300))}
    df = spark.createDataFrame([(k, r, c) for k, cells in masks.items() for r, c in sorted(cells)], "fire string, r int, c int")
    for n in (1, 3, 30):
        grown, shrunk = morphology.dilate(df, n, grid, ["fire"]), morphology.erode(df, n, grid, ["fire"])
        for k, cells in masks.items():
            assert cells_of(grown.filter(f"fire = '{k}'")) == brute_dilate(cells, n, 90, 75)
            assert cells_of(shrunk.filter(f"fire = '{k}'")) == brute_erode(cells, n)
    full = {(r, c) for r in range(90) for c in range(75)}
    whole = spark.createDataFrame([(r, c) for r, c in full], "r int, c int")
    assert cells_of(morphology.erode(whole, 30, grid)) == {(r, c) for r in range(30, 60) for c in range(30, 45)}


def test_digest_ignores_partitioning_and_sees_changes(spark, mask_of):
    grid = Grid(0, 3, 3, 50, 50)
    rng = random.Random(1)
    mask = {(r, c) for r in range(50) for c in range(50) if rng.random() < 0.3}
    first = digest.mask_digest(mask_of(mask), grid, block=16).first()
    again = digest.mask_digest(mask_of(mask).repartition(7), grid, block=16).first()
    other = digest.mask_digest(mask_of(mask ^ {(0, 0)}), grid, block=16).first()
    wider = digest.mask_digest(mask_of(mask), replace(grid, width=51), block=16).first()
    assert first == again and first.cells == len(mask)
    assert len({first.sha256, other.sha256, wider.sha256}) == 3


def in_polygon(x, y, rings):
    inside = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 <= y < y2 or y2 <= y < y1) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) <= x:
                inside = not inside
    return inside


def test_rasterize_brute_force(spark, cells_of):
    grid = Grid(10.0, 100.0, 3.0, 25, 30)
    polygons = {
        1: [[(20, 40), (60, 42), (45, 60), (62, 85), (22, 80)], [(30, 50), (38, 50), (38, 58), (30, 58)]],
        2: [[(5, 20), (30, 90), (120, 30)]],
        3: [[(70, 70), (90, 70), (90, 90), (70, 90), (70, 70)]],
    }
    rows = [(p, i, s, float(x), float(y)) for p, rings in polygons.items() for i, ring in enumerate(rings) for s, (x, y) in enumerate(ring)]
    vertices = spark.createDataFrame(rows, "poly_id int, ring_id int, seq int, x double, y double")
    want = {
        (p, r, c)
        for p, rings in polygons.items()
        for r in range(25)
        for c in range(30)
        if in_polygon(10 + (c + 0.5) * 3, 100 - (r + 0.5) * 3, rings)
    }
    got = {(x.poly_id, x.r, x.c) for x in geometry.rasterize(vertices, grid).collect()}
    assert got == want
    assert cells_of(geometry.burn_polygons(vertices, grid)) == {(r, c) for _, r, c in want}


def test_known_coordinates(spark):
    grid = Grid(598558.7784, 1144374.7699, 3.0, 5489, 6896)
    points = spark.createDataFrame([(606748.78, 1141695.77), (606063.2784, 1140377.2699), (1.0, 1.0)], "x double, y double")
    got = [(x.r, x.c, x.status) for x in geometry.locate(points, grid).collect()]
    assert got[0][:2] == (892, 2730)
    assert got[1][:2] == (1332, 2501)
    assert got[2][2] == "outside"


def test_circle_brute_force(spark):
    grid = Grid(0, 90, 3, 30, 30)
    centres = spark.createDataFrame([(1, 2, 3), (2, 15, 15)], "k int, r0 int, c0 int")
    got = {(x.k, x.radius_m, x.r, x.c) for x in geometry.circle_cells(centres, "k", [10.0, 21.0], 3.0, grid).collect()}
    want = {
        (k, m, r, c)
        for k, r0, c0 in ((1, 2, 3), (2, 15, 15))
        for m in (10.0, 21.0)
        for r in range(30)
        for c in range(30)
        if (r - r0) ** 2 + (c - c0) ** 2 <= (m / 3) ** 2
    }
    assert got == want


def test_equal_area_circle_takes_whole_size(spark, mask_of):
    all_cells = mask_of({(r, c) for r in range(15) for c in range(15)})
    sizes = spark.createDataFrame([(1, 1), (2, 7), (3, 100)], "run_id int, n_cells bigint")
    scores = baselines.equal_area_scores(all_cells, (F.col("r") + F.col("c")) % 3 == 0, sizes, "run_id", 7, 7).collect()
    order = sorted(((r - 7) ** 2 + (c - 7) ** 2, r, c) for r in range(15) for c in range(15))
    for x in scores:
        inside = order[: x.n_cells]
        hits = sum((r + c) % 3 == 0 for _, r, c in inside)
        assert (x.dist2, x.tp, x.fp) == (inside[-1][0], hits, x.n_cells - hits)
    assert sorted((x.run_id, x.n_cells) for x in scores) == [(1, 1), (2, 7), (3, 100)]


def test_layers_must_align(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "r int, c int, value double")
    assert layers.stack_layers({"a": a, "b": a}).count() == 2
    short = {"a": a, "b": a.filter("c = 0")}
    with pytest.raises(PySparkException, match="layers do not all have one value"):
        layers.stack_layers(short).collect()
    with pytest.raises(PySparkException, match="layers do not all have one value"):
        layers.stack_layers({"a": a, "b": a.union(a.filter("c = 0"))}).collect()
    assert layers.stack_layers(short, strict=False).filter("layers_present = 1").count() == 1
    grid = Grid(0, 0, 3, 1, 2)
    with pytest.raises(ValueError, match="layer 'b' lies on another grid than 'a': crs"):
        layers.check_grids({"a": grid, "b": replace(grid, crs="EPSG:4326")})


def test_coregistration_is_strict(spark, mask_of):
    with pytest.raises(PySparkException, match="shape mismatch"):
        domains.coregister(mask_of({(0, 0)}), mask_of({(0, 0), (0, 1)})).collect()
    sides = domains.coregister(mask_of({(0, 0), (1, 1)}), mask_of({(0, 0), (0, 1)}), strict=False)
    assert sorted(x.side for x in sides.collect()) == ["both", "pred", "truth"]


def test_bad_classes(spark):
    values = [0.0, 5.0, 3.00000001, 2.5, -1.0, 6.0, float("nan"), float("inf")]
    rows = spark.createDataFrame([(v,) for v in values], "raw double")
    good = [x.raw for x in rows.filter(cells.valid_class("raw")).collect()]
    assert good == [0.0, 5.0, 3.00000001]
    assert cells.class_offenders(rows, "raw", 2).count() == 2
    with pytest.raises(PySparkException, match="invalid material class"):
        rows.select(cells.require_class("raw")).collect()


def test_masks_and_risks_by_hand(spark):
    rows = [(0, 0, -9999.0, 5.0, 10.0, 2.0), (0, 1, 0.0, 0.0, 0.0, 0.0), (0, 2, 12.0, 8.0, 5.0, 3.0), (0, 3, 6.0, 8.0, 10.0, 3.0)]
    env = cells.environment(spark.createDataFrame(rows, "r int, c int, slope_raw double, proximity_raw double, buildings_raw double, materials_raw double"))
    got = {x.c: x for x in env.collect()}
    assert [got[i].burnable for i in range(4)] == [False, False, True, True]
    assert got[0].building_presence == 1 and got[0].material_risk == 0.0  # presence is not masked
    assert got[2].slope_risk == 0.0 and got[2].building_presence == 0
    assert got[3].slope_risk == pytest.approx(0.6) and got[3].proximity_risk == pytest.approx(0.8)


def test_crop_shifts_the_origin_and_is_pushed_down(spark, tmp_path):
    grid = Grid(100.0, 1000.0, 3.0, 40, 40)
    table = spark.range(1600).selectExpr("cast(id div 40 as int) r", "cast(id % 40 as int) c", "cast(id as double) v")
    table.write.parquet(str(tmp_path / "cells"))
    window = cells.crop(spark.read.parquet(str(tmp_path / "cells")), grid, 10, 20, 5, 5)
    assert window.count() == 25
    corner = window.filter("r = 0 and c = 0").first()
    assert (corner.x, corner.y) == (100.0 + 20.5 * 3, 1000.0 - 10.5 * 3)
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(r,10)" in plan and "GreaterThanOrEqual(c,20)" in plan


def test_empty_mask_box_is_the_grid(mask_of, small_grid, spark):
    empty = spark.createDataFrame([], "r int, c int")
    assert tuple(profile.padded_box(empty, small_grid, 3).first()) == (0, 7, 0, 7)
    assert tuple(profile.padded_box(mask_of({(3, 4)}), small_grid, 2).first()) == (1, 5, 2, 6)


def test_metadata_join_checks_size(spark):
    rows = spark.range(50).selectExpr("cast(id % 3 as int) k")
    small = inline_table(spark, ["k", "v"], [(0, "a"), (1, "b"), (2, "c")])
    assert fits_broadcast(small, 3) and not fits_broadcast(small, 2)
    assert join_metadata(rows, small, ["k"]).count() == join_metadata(rows, small, ["k"], max_rows=2).count() == 50


def test_labels_from_masks_against_plain_cells(spark):
    """Cells on both sides of strips and of zero; ignitions one step later, and at a step that nothing follows."""
    rng = random.Random(5)
    states = {(run, step, r, c): rng.choice([1, 2, 2, 2, 3, 4, 5]) for run in (1, 2) for step in (0, 1, 2) for r in range(-2, 4) for c in (*range(-3, 3), *range(29, 36), 63, 64)}
    snapshots = spark.createDataFrame([(*k, s) for k, s in states.items()], "run_id int, step int, r int, c int, state int")
    winds = spark.createDataFrame([(1, 12.0, 90.0), (2, 0.0, 0.0)], "run_id int, speed_kmh double, direction_deg double")
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
    counts = {k: sum(states.get((*k[:2], k[2] + a, k[3] + b)) == 4 for a, b in near) for k in states}
    front = {k: n for k, n in counts.items() if n and states[k] == 2}
    rows = transitions.susceptible_cells(snapshots, focal.neighbour_counts(snapshots)).collect()
    assert sorted((r["run_id"], r["step"], r["r"], r["c"], r["neighbor_burning_count"]) for r in rows) == sorted((*k, n) for k, n in front.items())
    labelled = transitions.label_transitions(snapshots, winds).collect()
    want = [(run, step, r, c, n, int(states[run, step + 1, r, c] == 3)) for (run, step, r, c), n in front.items() if step < 2]
    assert sorted((r["run_id"], r["step"], r["r"], r["c"], r["neighbor_burning_count"], r["ignited"]) for r in labelled) == sorted(want)
    assert transitions.label_transitions(snapshots.filter("false"), winds).collect() == []


def test_masks_hold_every_cell_of_a_strip(spark):
    """6,400 cells in 100 rows of 64 are 200 full masks, and are merged below the exchange."""
    cells = spark.range(6400, numPartitions=2).selectExpr("1 run_id", "0 step", "cast(id div 64 as int) r", "cast(id % 64 as int) c", "2 state")
    table = transitions.state_masks(cells, unburnt=(2, 0))
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "partial_bit_or" in plan[plan.index("Exchange") :]
    masks = table.collect()
    assert len(masks) == 200 and {m["unburnt"] for m in masks} == {(1 << 32) - 1}


def test_snapshots_by_row_keep_a_row_in_one_task(spark, sf_dir):
    """Masks merge in the tasks only where neighbours meet: one row a strip, run and step leaves them."""
    t = Tables(spark, sf_dir)
    placed = t.snapshots_by_row.withColumn("task", F.spark_partition_id())
    assert placed.groupBy("r").agg(F.countDistinct("task").alias("n")).filter("n > 1").count() == 0
    assert t.snapshots_by_row.exceptAll(t.snapshots).count() == 0 and t.snapshots.exceptAll(t.snapshots_by_row).count() == 0


def test_tasks_follow_the_lattice(spark, sf_dir):
    t = Tables(spark, sf_dir)
    assert t.tasks == spark.sparkContext.defaultParallelism
    t.grid = Grid(0.0, 0.0, 3.0, 75_000, 120)
    few = t.tasks
    t.grid = Grid(0.0, 0.0, 3.0, 450_000, 120)
    assert few >= 100 and t.tasks >= 6 * few - 6
    tiles = focal.to_tiles(snapshot(spark, [(1, 0, 0, 0, 4)]), ["run_id", "step"], tasks=3)
    assert tiles.rdd.getNumPartitions() == 3


def test_joins_of_the_step_take_the_number_of_tasks_they_are_given(spark, sf_dir):
    """Not the session's 4 shuffle partitions, however many rows there are: scores with masks, labels with cells."""
    snaps = snapshot(spark, [(1, s, r, c, 4 if (r + s) % 3 == 0 else 2) for s in range(3) for r in range(40) for c in range(40)])
    w, few = winds(spark, 10.0, 90.0), "spark.sql.autoBroadcastJoinThreshold"
    held = spark.conf.get(few)
    spark.conf.set(few, "-1")
    try:
        env = snaps.filter("step = 0").selectExpr("r", "c", "0.5D slope_risk", "0.5D proximity_risk", "1.0D building_presence", "0.5D material_risk")
        plain = transitions.label_transitions(snaps, w, Grid(0, 120, 3, 40, 40))
        dealt = transitions.label_transitions(snaps, w, Grid(0, 120, 3, 40, 40), tasks=11)
        counts = transitions.susceptible_cells(snaps, focal.neighbour_counts(snaps, tasks=11), tasks=11)
        rows = features.assemble(dealt, env, w, tasks=11)
        assert [x.rdd.getNumPartitions() for x in (dealt, counts, rows)] == [11, 11, 11]
        assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, plain.collect())) and rows.count() == plain.count() > 0
    finally:
        spark.conf.set(few, held)


def test_training_rows_are_dealt_by_the_lattice_alone(spark, sf_dir, monkeypatch):
    """No exchange of cells on the way to the training rows takes the session's 4 shuffle partitions: what a task holds follows ``Tables.tasks``."""
    few = "spark.sql.autoBroadcastJoinThreshold"
    held = spark.conf.get(few)
    plain = sorted((r["run_id"], r["step"], r["r"], r["c"], r["ignited"]) for r in Tables(spark, sf_dir).training().collect())
    spark.conf.set(few, "-1")
    try:
        cell_runs = Tables(spark, sf_dir).grid.height * fixtures.WIDTH * len(fixtures.SEEDS)
        monkeypatch.setattr(fixtures, "CELL_RUNS_A_TASK", -(-cell_runs // 11))
        t = Tables(spark, sf_dir)
        rows = t.training()
        plan = rows._jdf.queryExecution().executedPlan().toString()
        dealt = re.findall(r"Exchange hashpartitioning\((.*), (\d+)\)", plan)
        others = [re.sub(r"#\w+", "", keys) for keys, n in dealt if n != "11"]
        assert t.tasks == 11 and len(dealt) >= 10 and others == ["run_id, step"]  # the run log: a row a run and step, whatever the tables
        assert sorted((r["run_id"], r["step"], r["r"], r["c"], r["ignited"]) for r in rows.collect()) == plain
    finally:
        spark.conf.set(few, held)


def test_histories_give_the_labels_of_snapshots(spark):
    """Random states over tiles and signs, one run in two spans of steps: the rows, scores and labels of the snapshots' way."""
    rng, last = random.Random(7), 4
    states = {(run, step, r, c): rng.choice([1, 2, 2, 2, 3, 4, 5]) for run in (1, 2) for step in range(last + 1) for r in (*range(-2, 4), 31, 32, 33) for c in (*range(-3, 3), *range(29, 36), 63, 64)}
    snapshots = spark.createDataFrame([(*k, s) for k, s in states.items()], "run_id int, step int, r int, c int, state int")
    w = spark.createDataFrame([(1, 12.0, 90.0), (2, 0.0, 0.0)], "run_id int, speed_kmh double, direction_deg double")

    def masks(run, r, c, first, steps):
        at = {s: states[run, s, r, c] for s in range(last + 1)}
        bits = lambda holds: sum(1 << (s - first) for s in steps if holds(s))
        return run, first, bits(lambda s: at[s] == 2 and s < last), bits(lambda s: at.get(s + 1) == 3), bits(lambda s: at[s] == 4)

    spans = [(1, 0, range(5)), (2, 0, range(2)), (2, 2, range(2, 5))]
    rows = [(r, c, float(r * 100 + c), [masks(run, r, c, first, steps) for run, first, steps in spans]) for r, c in sorted({k[2:] for k in states})]
    cells = spark.createDataFrame(rows, "r int, c int, risk double, runs array<struct<run_id: int, first: int, unburnt: long, ignitions: long, blazing: long>>")
    for grid in (None, Grid(0, 96, 3, 32, 64)):
        found = transitions.label_histories(cells, F.col("runs"), w, grid, carry=["risk"], tasks=5)
        got = {tuple(x)[:4]: x for x in found.collect()}
        want = transitions.label_transitions(snapshots, w, grid).collect()
        assert len(want) == len(got) == found.count() > 100
        for x in want:
            y = got[x["run_id"], x["step"], x["r"], x["c"]]
            assert (x["neighbor_burning_count"], x["ignited"], x["r"] * 100 + x["c"]) == (y["neighbor_burning_count"], y["ignited"], y["risk"])
            assert x["wind_weighted_score"] == pytest.approx(y["wind_weighted_score"], abs=1e-12)
    assert transitions.label_histories(cells.filter("false"), F.col("runs"), w).collect() == []


def test_training_rows_shuffle_cells_and_no_rows(spark, sf_dir, monkeypatch):
    """Exchanges deal orders, line items and cells; none deals a row per run and step. The rows are those of the snapshots' way."""
    few = "spark.sql.autoBroadcastJoinThreshold"
    held = spark.conf.get(few)
    near = lambda df: df.withColumn("wind_weighted_score", F.round("wind_weighted_score", 9))
    for schema in ("B", "C"):
        t = Tables(spark, sf_dir)
        rows, plain = near(t.training_rows(schema)), near(t.training(schema))
        assert rows.dtypes == plain.dtypes and rows.count() == plain.count() > 0
        assert rows.exceptAll(plain).count() == plain.exceptAll(rows).count() == 0
    spark.conf.set(few, "-1")
    try:
        cell_runs = Tables(spark, sf_dir).grid.height * fixtures.WIDTH * len(fixtures.SEEDS)
        monkeypatch.setattr(fixtures, "CELL_RUNS_A_TASK", -(-cell_runs // 11))
        rows = Tables(spark, sf_dir).training_rows()
        plan = rows._jdf.queryExecution().executedPlan().toString()
        dealt = [(re.sub(r"#\w+", "", keys), n) for keys, n in re.findall(r"Exchange hashpartitioning\((.*), (\d+)\)", plan)]
        assert sorted(dealt) == [("l_orderkey", "11"), ("l_orderkey", "11"), ("tile_r, tile_c", "11")]
    finally:
        spark.conf.set(few, held)
