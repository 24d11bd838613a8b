"""Learning jobs on the labelled table (L1 to L11)."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderframe.operators import domains, features, forest, learning, probability, sampling
from cinderframe.operators.learning import Recipe
from cinderframe.operators.trials import count_equal, count_in_folds
from cinderframe.plans.fixtures import Tables, ids_of, row_key, with_fixtures
from cinderframe.plans.ranking import IDS
from cinderframe.plans.registry import query, rounded
from cinderframe.session import scratch_path
from cinderframe.sources import tables

# Sizes of the full study.
TRIALS, FOLDS, TREES, DEPTH = 100, 5, 200, 15
TARGET = "ignited"

VARYING = tuple(features.SCHEMA_B)


@query("l1_standardise", with_fixtures("training", "select run_id, step, r, c, " + ", ".join(
    f"round(({f} - m_{f}) / s_{f}, 6) {f}" for f in VARYING) + " from training cross join stats", "stats as (select " + ", ".join(
    f"avg({f}) m_{f}, stddev_pop({f}) s_{f}" for f in VARYING) + " from training)"))
def standardise(t: Tables):
    rows = learning.standardise(t.training_table().select(*IDS, *VARYING), VARYING)
    return rounded(rows, *VARYING)


def split(t: Tables, schema: str = "B") -> tuple[DataFrame, DataFrame]:
    """Written training table, split 80/20 by class.

    The fits read it many times; a table in the shared folder survives lost
    executors and is not derived again. It is written once: ``part`` is not a column of it but follows, at every
    read, from the row's hash and the written cut of its class.
    """
    rows = sampling.stratified_split(t.training_table(schema), TARGET, IDS)
    return rows.filter("part = 'train'"), rows.filter("part = 'test'")


def union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


WEIGHTINGS = {"balanced": Recipe(), "custom": Recipe(class_weight="custom", positive_weight=7.5), "none": Recipe(class_weight="none")}
PENALTIES = {"l1": Recipe("l1", C=0.01), "elasticnet": Recipe("elasticnet", C=0.01, l1_ratio=0.5)}


def coefficients(t: Tables, models: dict[str, learning.LinearModel]) -> DataFrame:
    return union([m.table(t.spark).withColumn("model", F.lit(name)) for name, m in models.items()])


@query("l2_weighted_logistic")
def weighted_logistic(t: Tables):
    """Balanced, custom-weighted and unweighted fits: coefficients."""
    train, _ = split(t)
    return coefficients(t, learning.fit_linear(train, features.SCHEMA_B, WEIGHTINGS))


@query("l3_sparse_penalties")
def sparse_penalties(t: Tables):
    """L1 and elastic-net fits: coefficients."""
    train, _ = split(t)
    return coefficients(t, learning.fit_linear(train, features.SCHEMA_B, PENALTIES))


TRAIN = """train as (select * from (select *, count(*) over (partition by ignited) n_k,
      row_number() over (partition by ignited order by md5('42|' || run_id || '|' || step || '|' || r || '|' || c), run_id, step, r, c) rk from training)
    where rk > round(0.2::double * n_k)),
  stats as (select count(*) n, count(*) filter (where ignited = 1) n1, """ + ", ".join(f"avg({f}) m_{f}, stddev_pop({f}) s_{f}" for f in VARYING) + " from train)"


def label_moments(models: dict[str, str]) -> str:
    """Weighted means of 1 and of every standardised feature over positives, from the labels alone."""
    fields = ["1"] + [f"case when s_{f} > 0 then ({f} - m_{f}) / s_{f} else 0 end" for f in VARYING]
    parts = []
    for model, weight in models.items():
        means = ", ".join(f"round(sum(w * ignited * {z}) / sum(w), 6)" for z in fields)
        names = ", ".join(f"'{f}'" for f in ("intercept", *VARYING))
        parts.append(f"select '{model}' model, unnest([{names}]) feature, unnest([{means}]) moment from (select *, {weight} w from train cross join stats)")
    return with_fixtures("training", " union all ".join(parts), TRAIN)


BALANCED = "case when ignited = 1 then n / (2.0::double * n1) else n / (2.0::double * (n - n1)) end"


@query("l2_fit_moments", label_moments({"balanced": BALANCED, "custom": "case when ignited = 1 then 7.5::double else 1 end", "none": "1.0::double"}))
def weighted_moments(t: Tables):
    """The fits of L2 proved optimal: fitted moments and penalties balance the labels' moments."""
    train, _ = split(t)
    return rounded(learning.fitted_moments(train, learning.fit_linear(train, features.SCHEMA_B, WEIGHTINGS)), "moment")


@query("l3_fit_moments", label_moments({"l1": BALANCED, "elasticnet": BALANCED}))
def sparse_moments(t: Tables):
    """The fits of L3 proved optimal, with the subgradient of the L1 penalty."""
    train, _ = split(t)
    return rounded(learning.fitted_moments(train, learning.fit_linear(train, features.SCHEMA_B, PENALTIES)), "moment")


@query("l4_random_forest")
def random_forest(t: Tables):
    """Held-out rows with the probability of a forest of 200 trees of depth 15, classes balanced in every tree's sample."""
    train, test = split(t)
    fitted = forest.grow(train, features.SCHEMA_B, TARGET, forest.Growth(trees=TREES, depth=DEPTH))
    return forest.predict(fitted, test).select(*IDS, TARGET, "p")


def in_folds(t: Tables, train: DataFrame, names: Sequence[str]) -> DataFrame:
    """Equal training rows of a fold as one row with their number ``n_rows``: the rows of every fit."""
    return count_in_folds(train.select(*IDS, TARGET, *names), names, TARGET, row_key(), ids_of("__key"), folds=FOLDS, tasks=t.tasks)


def search(folded: DataFrame, names: Sequence[str]) -> list[dict]:
    return learning.search(folded, names, learning.random_trials(TRIALS), folds=FOLDS, count="n_rows")


RESULT_SCHEMA = "trial int, cv_f1 double, penalty string, C double, l1_ratio double, class_weight string, positive_weight double"


@query("l5_hyperparameter_search")
def hyperparameter_search(t: Tables):
    """Mean best-F1 over folds of every trial."""
    train, _ = split(t)
    results = search(in_folds(t, train, features.SCHEMA_B), features.SCHEMA_B)
    columns = [c.split()[0] for c in RESULT_SCHEMA.split(", ")]
    return t.spark.createDataFrame([tuple(r[c] for c in columns) for r in results], RESULT_SCHEMA)


def recipe_of(result: dict) -> Recipe:
    return Recipe(**{k: result[k] for k in ("penalty", "C", "l1_ratio", "class_weight", "positive_weight")})


@query("l6_final_refit")
def final_refit(t: Tables):
    """Best trial, refit on all training rows, held-out metrics and the gap to the search's score."""
    train, test = split(t)
    rows = in_folds(t, train, features.SCHEMA_B)
    best = learning.best_trial(search(rows, features.SCHEMA_B))
    model = learning.fit_linear(rows, features.SCHEMA_B, {"best": recipe_of(best)}, count="n_rows")["best"]
    held_out = count_equal(test, [*features.SCHEMA_B, TARGET])
    metrics = learning.evaluate(model.predict(held_out, [TARGET, "n_rows"]), count="n_rows")
    row = (best["trial"], best["converged_early"], best["cv_f1"], metrics["f1"], metrics["cutoff"], metrics["auc_roc"], learning.gap_class(best["cv_f1"], metrics["f1"]))
    return t.spark.createDataFrame([row], "trial int, converged_early boolean, cv_f1 double, test_f1 double, cutoff double, auc_roc double, gap string")


@query("l7_coefficient_report")
def coefficient_report(t: Tables):
    """Features ranked by the size of their coefficient."""
    train, _ = split(t)
    model = learning.fit_linear(train, features.SCHEMA_B, {"balanced": Recipe()})["balanced"]
    return learning.rank_features(model.table(t.spark))


@dataclass(frozen=True)
class Variant:
    name: str
    schema: str
    engineered: bool = False
    tuned: bool = False

    @property
    def features(self) -> list[str]:
        return [*features.SCHEMAS[self.schema], *(features.INTERACTIONS if self.engineered else ())]


VARIANTS = [
    Variant(f"{len(features.SCHEMAS[s])}{' + 7' if e else ''}-feature, {'tuned' if u else 'default'}", s, e, u)
    for s in ("9", "B")
    for e in (False, True)
    for u in (False, True)
]
STAGES = [Variant(f"stage {s}", s) for s in ("A", "B", "C")]


@query("l8_variant_matrix")
def variant_matrix(t: Tables):
    """Eight variants and three stages on one split: metrics at the best cutoff and at 0.5.

    Rows are dealt to folds and equal ones counted once for all variants: schema C holds the features
    of every schema, and interactions follow from them.
    """
    train, test = split(t, "C")
    train = features.add_interactions(in_folds(t, train, features.SCHEMA_C))
    test = features.add_interactions(count_equal(test, [*features.SCHEMA_C, TARGET]))

    def run(v: Variant) -> tuple:
        recipe, cv = Recipe(), None
        if v.tuned:
            best = learning.best_trial(search(train, v.features))
            recipe, cv = recipe_of(best), best["cv_f1"]
        model = learning.fit_linear(train, v.features, {v.name: recipe}, count="n_rows")[v.name]
        m = learning.evaluate(model.predict(test, [TARGET, "n_rows"]), also=0.5, count="n_rows")
        return v.name, len(v.features), m["cutoff"], m["f1"], m["auc_roc"], m["f1_also"], m["recall_also"], cv

    # Driver threads only submit jobs; the fits share the cluster.
    with ThreadPoolExecutor(max_workers=4) as pool:
        rows = list(pool.map(run, [*VARIANTS, *STAGES]))
    return t.spark.createDataFrame(rows, "variant string, n_features int, cutoff double, f1 double, auc_roc double, f1_at_half double, recall_at_half double, cv_f1 double")


@query("l9_refit_check", "select unnest([" + ", ".join(f"'{f}'" for f in features.SCHEMA_B) + "]) feature, 0.0::double abs_diff, true reproduced")
def refit_check(t: Tables):
    """Fit again from another partitioning and compare every coefficient with the saved ones: the bits are equal."""
    train, _ = split(t)
    recipe = {"balanced": Recipe()}
    first = learning.fit_linear(train, features.SCHEMA_B, recipe)["balanced"].table(t.spark).withColumn("model", F.lit("first"))
    path = scratch_path(t.spark, "coefficients")
    first.write.parquet(path)
    again = learning.fit_linear(train.repartition("r", "c"), features.SCHEMA_B, recipe)["balanced"].table(t.spark).withColumn("model", F.lit("second"))
    changes = domains.coefficient_changes(t.spark.read.schema(first.schema).parquet(path), again)
    return changes.select("feature", "abs_diff", (F.col("abs_diff") == 0).alias("reproduced"))


@query("l10_model_round_trip", with_fixtures("training", """
    select cast(sum(n) as bigint) "rows", 0.0::double max_abs_diff from (select round(0.2::double * count(*)) n from training group by ignited)"""))
def model_round_trip(t: Tables):
    """Save, load, check that the model yields probabilities and that they are unchanged."""
    train, test = split(t)
    model = learning.fit_logistic(train, features.SCHEMA_B)
    loaded = learning.load_model(learning.save_model(model, scratch_path(t.spark, "model")))
    before = learning.predict(model, test, [*IDS, *features.SCHEMA_B], "p_before")
    after = learning.predict(loaded, before, ["p_before"], "p_after")
    return after.agg(F.count(F.lit(1)).alias("rows"), F.max(F.abs(F.col("p_before") - F.col("p_after"))).alias("max_abs_diff"))


@query("l11_train_on_role")
def train_on_role(t: Tables):
    """Fit on the train role, probability metrics on the validation role."""
    slot = (F.col("r") * 120 + F.col("c")) % 10
    role = F.when(slot < 6, "train").when(slot < 8, "validation").otherwise("calibration")
    path = tables.write_training(t.training_rows("C").withColumn("role", role), scratch_path(t.spark, "roles"), partition_by=["role"])
    train, held_out = tables.read_role(t.spark, path, "train"), tables.read_role(t.spark, path, "validation")
    models = learning.fit_linear(train, features.SCHEMA_C, {n: Recipe(class_weight=n) for n in ("balanced", "none")})
    scored = union([m.predict(held_out, [TARGET]).withColumn("variant", F.lit(name)) for name, m in models.items()])
    keys = ["variant"]
    return (
        probability.roc_auc(scored, TARGET, "p", keys)
        .join(probability.average_precision(scored, TARGET, "p", keys), keys)
        .join(probability.proper_losses(scored, TARGET, "p", keys), keys)
    )
