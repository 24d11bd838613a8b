"""Morphology and baselines (G1 to G5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinderframe.functions.columns import is_truth
from cinderframe.operators import baselines, morphology, sampling, scoring
from cinderframe.operators.scoring import Case
from cinderframe.plans.aggregates import METRIC_SQL, METRICS, PERTURBED, perturbed_scores
from cinderframe.plans.fixtures import IGNITION, PIXEL, Tables, with_fixtures
from cinderframe.plans.registry import query, rounded

BALL = """ball as (select cast(a.range as int) dr, cast(b.range as int) dc from range(-{n}, {n} + 1) a cross join range(-{n}, {n} + 1) b
  where abs(a.range) + abs(b.range) <= {n})"""


def scar(t: Tables):
    return t.cells.filter(is_truth("truth_b", "one"))


@query("g1_dilation", with_fixtures("cells dims", """
    select distinct r + dr r, c + dc c from cells cross join ball cross join dims
    where truth_b = 1 and r + dr between 0 and height - 1 and c + dc between 0 and width - 1""", BALL.format(n=2)))
def dilation(t: Tables):
    return morphology.dilate(scar(t), 2, t.grid)


@query("g2_erosion", with_fixtures("cells", """
    select r + dr r, c + dc c from cells cross join ball where truth = 1 group by 1, 2 having count(*) = 5""", BALL.format(n=1)))
def erosion(t: Tables):
    return morphology.erode(t.cells.filter(is_truth("truth", "one")), 1, t.grid)


@query("g3_perturbed_scores", with_fixtures("cells final", f"""
    select area, variant, run_id, tp, fp, fn, tn, {METRIC_SQL}, tp + fn truth, tp + fp predicted from counts""", PERTURBED))
def perturbed(t: Tables):
    return rounded(perturbed_scores(t), *METRICS)


AREA_SQL = "cross join (values ('whole'), ('buildings')) q(area) where area = 'whole' or buildings_raw > 0"


@query("g4_random_baseline", with_fixtures("cells", f"""
    select area, tp, fp, fn, tn, {METRIC_SQL}, tp + fn truth, tp + fp predicted from (
      select area, count(*) filter (where pred and truth = 1) tp, count(*) filter (where pred and truth = 0) fp,
        count(*) filter (where not pred and truth = 1) fn, count(*) filter (where not pred and truth = 0) tn
      from (select *, cast('0x' || substr(md5('42|' || r || '|' || c), 1, 8) as bigint) / 4294967296.0::double < (select avg(truth) from cells) pred
            from cells) {AREA_SQL} group by 1)"""))
def random_baseline(t: Tables):
    drawn = sampling.random_mask(t.cells, is_truth("truth", "one"), seed=42)
    areas = {"whole": F.lit(True), "buildings": F.col("buildings_raw") > 0}
    wanted = [Case({"area": a}, is_truth("truth", "one"), mask) for a, mask in areas.items()]
    return rounded(scoring.with_metrics(scoring.score_cases(drawn, F.col("pred"), wanted, [])), *METRICS)


RADII = (12.0, 30.0, 60.0, 100.0, 150.0, 300.0)


@query("g5_circle_baselines", with_fixtures("cells", f"""
    select radius_m, area, tp, fp, fn, tn, {METRIC_SQL}, tp + fn truth, tp + fp predicted from (
      select radius_m, area, count(*) filter (where d and truth = 1) tp, count(*) filter (where d and truth = 0) fp,
        count(*) filter (where not d and truth = 1) fn, count(*) filter (where not d and truth = 0) tn
      from (select *, (r - {IGNITION[0]}) * (r - {IGNITION[0]}) + (c - {IGNITION[1]}) * (c - {IGNITION[1]}) <= (radius_m / 3) * (radius_m / 3) d
        from cells cross join (values {", ".join(f"({x}::double)" for x in RADII)}) k(radius_m)) {AREA_SQL} group by 1, 2)"""))
def circle_baselines(t: Tables):
    truth = is_truth("truth", "one")
    areas = {"whole": (truth, F.lit(True)), "buildings": (truth, F.col("buildings_raw") > 0)}
    counts = baselines.circle_scores(t.cells, *IGNITION, RADII, PIXEL, areas)
    return rounded(scoring.with_metrics(counts), *METRICS)
