"""Ranks, metrics, splits, sources and learning against brute force and golden values."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Window
from pyspark.sql import functions as F

from cinderframe.functions.ranking import hash_ordinal, ordinal, running_sums, unit_levels
from cinderframe.operators import learning, probability, profile, sampling, scoring, transitions, trials
from cinderframe.operators.learning import Recipe
from cinderframe.session import scratch_path, scratch_root, written
from cinderframe.sources import fingerprint, runlog, tables, wind


@pytest.fixture(scope="module")
def hot(spark):
    """Rows of which half share one group and a third share one value."""
    rng = random.Random(5)
    rows = [(i, 0 if i % 2 else i % 7, 0.25 if i % 3 == 0 else rng.random(), int(rng.random() < 0.2)) for i in range(3000)]
    return spark.createDataFrame(rows, "id int, g int, p double, y int").repartition(6)


def test_ordinal_equals_row_number(hot):
    ranked = ordinal(hot.withColumns(unit_levels("p")), ["g"], ["__u10", "__u20"], ["p", "id"])
    want = F.row_number().over(Window.partitionBy("g").orderBy("p", "id"))
    assert ranked.withColumn("want", want).filter("rank <> want").count() == 0
    hashed = hash_ordinal(hot.withColumn("h", F.md5(F.col("id").cast("string"))), ["g"], "h", ["id"])
    want = F.row_number().over(Window.partitionBy("g").orderBy("h", "id"))
    assert hashed.withColumn("want", want).filter("rank <> want").count() == 0


def test_running_sums_equal_a_window(hot):
    counts = hot.groupBy("g", "p").agg(F.sum("y").alias("n")).withColumns(unit_levels("p"))
    for descending in (False, True):
        got = running_sums(counts, ["g"], ["__u10", "__u20", "p"], ["n"], descending=descending)
        order = F.col("p").desc() if descending else F.col("p").asc()
        window = Window.partitionBy("g").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        want = F.coalesce(F.sum("n").over(window), F.lit(0))
        assert got.withColumn("want", want).filter("n_before <> want").count() == 0


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return np.mean([(a > neg).mean() + (a == neg).mean() / 2 for a in pos])


def brute_ap(y, p):
    total, before = 0.0, 0.0
    for s in np.unique(p)[::-1]:
        hits = ((p >= s) & (y == 1)).sum()
        recall = hits / y.sum()
        total += (recall - before) * hits / (p >= s).sum()
        before = recall
    return total


def test_ranking_metrics_brute_force(hot):
    data = hot.toPandas()
    y, p = data["y"].to_numpy(), data["p"].to_numpy()
    assert probability.roc_auc(hot, "y", "p").first().roc_auc == pytest.approx(brute_auc(y, p))
    assert probability.average_precision(hot, "y", "p").first().average_precision == pytest.approx(brute_ap(y, p))
    wide = hot.withColumn("v", F.col("p") * 1000 - 300)
    assert probability.feature_auc(wide, ["v"], "y").first().roc_auc == pytest.approx(brute_auc(y, p))
    per_group = {x.g: x.roc_auc for x in probability.roc_auc(hot, "y", "p", ["g"]).collect()}
    for g, part in data.groupby("g"):
        assert per_group[g] == pytest.approx(brute_auc(part["y"].to_numpy(), part["p"].to_numpy()))


def test_tied_scores(spark):
    df = spark.createDataFrame([(0, 0.2), (1, 0.2), (0, 0.8), (1, 0.8)], "y int, p double")
    assert probability.roc_auc(df, "y", "p").first().roc_auc == 0.5
    assert probability.average_precision(df, "y", "p").first().average_precision == 0.5
    assert probability.roc_auc(df.filter("y = 1"), "y", "p").first().roc_auc is None


def test_sweep_brute_force_and_fallback(hot):
    data = hot.toPandas()
    sweep = {x.cutoff_no: (x.tp, x.fp, x.fn, x.tn) for x in probability.cutoff_counts(hot, "y", "p").collect()}
    assert len(sweep) == 16
    for i, t in enumerate(probability.CUTOFFS):
        hit, y = data["p"] >= t, data["y"] == 1
        assert sweep[i] == ((hit & y).sum(), (hit & ~y).sum(), (~hit & y).sum(), (~hit & ~y).sum())
    none = hot.withColumn("y", F.lit(0))
    best = probability.best_cutoff(probability.cutoff_counts(none, "y", "p")).first()
    assert (best.best_cutoff, best.best_f1) == (0.5, 0.0)
    assert probability.best_cutoff(probability.cutoff_counts(none, "y", "p"), fallback=0.1).first().best_cutoff == 0.1


def test_published_confusions(spark):
    rows = [(1795, 507, 115, 0), (0, 0, 0, 5), (3077, 3103, 235, 0)]
    got = scoring.with_metrics(spark.createDataFrame(rows, "tp bigint, fp bigint, fn bigint, tn bigint")).collect()
    assert [round(got[0][m], 4) for m in scoring.METRICS] == [0.7798, 0.9398, 0.8523, 0.7427]
    assert [got[1][m] for m in scoring.METRICS] == [0.0] * 4
    assert round(got[2].f1, 3) == 0.648 and got[2].predicted == 6180


def test_one_seed_has_zero_spread(spark):
    one = spark.createDataFrame([("a", 42, 0.5, 0.9, 0.6, 0.4)], "k string, seed int, precision double, recall double, f1 double, jaccard double")
    got = {x.metric: x for x in scoring.across_seeds(one, ["k"], "seed").collect()}
    assert got["f1"].sd == 0.0 and got["recall"].passing == 1 and got["f1"].per_seed == [0.6]


def test_runs_that_reached_nothing_are_scored(spark):
    cells = spark.createDataFrame([(0, c, c % 2) for c in range(6)], "r int, c int, t int")
    reached = spark.createDataFrame([(1, 0, 1), (1, 0, 2)], "run_id int, r int, c int")
    runs = spark.createDataFrame([(1,), (2,)], "run_id int")
    case = [scoring.Case({"area": "whole"}, F.col("t") == 1, F.lit(True))]
    got = {x.run_id: (x.tp, x.fp, x.fn, x.tn) for x in scoring.score_runs(reached, cells, runs, case, ["run_id"]).collect()}
    assert got == {1: (1, 1, 2, 2), 2: (0, 0, 3, 3)}


def test_splits_do_not_depend_on_partitioning(hot):
    def parts(df, fn, column):
        return {x.id: x[column] for x in fn(df).collect()}

    split = lambda df: sampling.stratified_split(df, "y", ["id"])
    folds = lambda df: sampling.stratified_folds(df, "y", ["id"], k=5)
    assert parts(hot, split, "part") == parts(hot.repartition(3, "p"), split, "part")
    assert parts(hot, folds, "fold") == parts(hot.coalesce(1), folds, "fold")
    for x in split(hot).groupBy("y").agg(F.avg((F.col("part") == "test").cast("int")).alias("share")).collect():
        assert x.share == pytest.approx(0.2, abs=0.002)
    sizes = [x["count"] for x in folds(hot).groupBy("y", "fold").count().filter("y = 1").collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_under_sampling_keeps_all_positives(hot):
    positives = hot.filter("y = 1").count()
    kept = sampling.under_sample(hot, "y", ["id"], ratio=2)
    assert kept.filter("y = 1").count() == positives
    assert kept.filter("y = 0").count() == 2 * positives


def test_samples_strict_and_lenient(spark):
    eligible = spark.createDataFrame([(g, 0, c) for g, n in ((1, 30), (2, 3)) for c in range(n)], "run_id int, r int, c int")
    sample = sampling.sample_cells(eligible, "run_id", 5)
    assert {x.run_id: x["count"] for x in sample.groupBy("run_id").count().collect()} == {1: 5, 2: 3}
    wide = spark.range(6000).selectExpr("cast(id % 2 as int) run_id", "cast(id div 100 as int) r", "cast(id % 100 as int) c")
    many = sampling.sample_cells(wide, "run_id", 2500).collect()
    for run in (0, 1):
        cells = sorted((hashlib.md5(f"{run}|{i // 100}|{i % 100}".encode()).hexdigest(), i // 100, i % 100) for i in range(run, 6000, 2))
        got = sorted((x.pick, x.r, x.c) for x in many if x.run_id == run)
        assert got == [(k, r, c) for k, (_, r, c) in enumerate(cells[:2500], 1)]
    groups = spark.createDataFrame([(1,), (2,)], "run_id int")
    with pytest.raises(PySparkException, match="not enough eligible cells"):
        sampling.require_sample(groups, sample, "run_id", 5).collect()
    assert sampling.require_sample(groups.filter("run_id = 1"), sample, "run_id", 5).count() == 5


def test_percentile_matches_numpy(hot):
    got = profile.exact_percentile(hot, "p", 0.95, [], {"__l": F.floor(F.col("__v") * 16)}).first().percentile
    assert got == pytest.approx(np.percentile(hot.toPandas()["p"], 95))


def test_foreign_model(hot):
    class Model:
        def predict_proba(self, x):
            p = 1 / (1 + np.exp(-x[:, 0]))
            return np.column_stack([1 - p, p])

    scored = hot.withColumn("q", probability.foreign_probability(Model, ["p"]))
    assert scored.filter(F.abs(F.col("q") - 1 / (1 + F.exp(-F.col("p")))) > 1e-12).count() == 0
    with pytest.raises(PySparkException, match="predict_proba"):
        hot.withColumn("q", probability.foreign_probability(object, ["p"])).collect()


@pytest.fixture(scope="module")
def learnable(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3)) * [1.0, 5.0, 0.5] + [0, 3, 1]
    z = x @ [1.0, -0.3, 2.0] - 2.5
    y = (rng.random(300) < 1 / (1 + np.exp(-z))).astype(int)
    rows = [(*map(float, r), int(t), i % 3) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "a double, b double, d double, ignited int, fold int"), x, y


def newton(x, y, w, c):
    """Minimise C * weighted loss + |coef|^2 / 2 on standardised features."""
    z = (x - x.mean(0)) / x.std(0)
    z = np.column_stack([z, np.ones(len(z))])
    beta = np.zeros(z.shape[1])
    ridge = np.diag([1.0] * (z.shape[1] - 1) + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        gradient = c * z.T @ (w * (p - y)) + ridge @ beta
        hessian = c * (z * (w * p * (1 - p))[:, None]).T @ z + ridge
        beta -= np.linalg.solve(hessian, gradient)
    return beta[:-1]


@pytest.mark.parametrize("recipe", [Recipe(), Recipe(class_weight="none", C=0.05), Recipe(class_weight="custom", positive_weight=3.0)])
def test_logistic_matches_newton(spark, learnable, recipe):
    df, x, y = learnable
    model = learning.fit_logistic(df, ["a", "b", "d"], recipe)
    stats = learning.training_stats(df, ["a", "b", "d"])
    w0, w1 = stats.weights(recipe)
    want = newton(x, y, np.where(y == 1, w1, w0), recipe.C)
    assert model.stages[-1].coefficients.toArray() == pytest.approx(want, abs=1e-5)


def test_constant_column_stays_zero(spark):
    df = spark.createDataFrame([(1.0, 4.0), (3.0, 4.0)], "a double, b double")
    assert [tuple(x) for x in learning.standardise(df, ["a", "b"]).orderBy("a").collect()] == [(-1.0, 0.0), (1.0, 0.0)]
    assert {x.feature: x.scale for x in learning.standardisation(df, ["a", "b"]).collect()} == {"a": 1.0, "b": 1.0}


def test_search_and_forest(spark, learnable, tmp_path):
    df, _, _ = learnable
    trials = learning.random_trials(2, seed=1)
    results = learning.search(df, ["a", "b", "d"], trials, folds=3)
    assert [r["trial"] for r in results] == [0, 1] and all(0 <= r["cv_f1"] <= 1 for r in results)
    assert learning.random_trials(5, 9) == learning.random_trials(5, 9)
    tied = [{"trial": 0, "cv_f1": 0.5}, {"trial": 1, "cv_f1": 0.5}]
    assert learning.best_trial(tied)["trial"] == 0
    forest = learning.fit_forest(df, ["a", "b", "d"], trees=5, depth=4)
    assert learning.evaluate(learning.predict(forest, df, ["ignited"]))["auc_roc"] > 0.8
    report = learning.rank_features(learning.coefficient_table(forest, ["a", "b", "d"], spark))
    assert report.filter("rank = 1").first().kind == "importance"
    path = learning.save_model(forest, str(tmp_path / "forest"))
    assert learning.predict(learning.load_model(path), df, []).count() == 300


def test_gap_classes():
    assert [learning.gap_class(0.5, v) for v in (0.49, 0.44, 0.46, 0.54)] == ["minimal", "optimistic", "small", "small"]


def test_role_and_snapshot_reads_prune_folders(spark, tmp_path):
    rows = spark.range(100).selectExpr("cast(id % 4 as int) run_id", "cast(id % 5 as int) step", "cast(id as int) r", "0 c", "2 state")
    tables.write_snapshots(rows, str(tmp_path / "snaps"))
    read = tables.read_snapshots(spark, str(tmp_path / "snaps"), runs=[1], steps=[0, 3])
    assert read.count() == 10
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "run_id" in plan.split("PartitionFilters")[1]
    roles = rows.withColumn("role", F.when(F.col("r") < 50, "train").otherwise("final-test"))
    tables.write_training(roles, str(tmp_path / "roles"), partition_by=["role"])
    files = tables.read_role(spark, str(tmp_path / "roles"), "train").select(F.input_file_name().alias("f")).distinct().collect()
    assert files and all("role=train" in x.f for x in files)


def test_as_of_join_opens_only_the_folders_of_its_steps(spark, tmp_path):
    rows = spark.range(260).selectExpr("cast(id % 2 as int) run_id", "cast(id % 13 as int) step", "cast(id as int) r", "0 c", "2 state")
    path = tables.write_snapshots(rows, str(tmp_path / "snaps"))
    log = written(rows.select("run_id", "step").distinct(), "log")
    unread = [f for f in (tmp_path / "snaps").glob("run_id=*/step=*/*.parquet") if f.parent.name not in ("step=3", "step=6", "step=12")]
    for f in unread:
        f.write_bytes(b"no parquet")
        (f.parent / f".{f.name}.crc").unlink()
    states = transitions.as_of_snapshots(spark.read.schema(rows.schema).parquet(path), log, [3, 6, 40])
    got = {(x.requested_step, x.actual_step): x.n for x in states.groupBy("requested_step", "actual_step").agg(F.count("*").alias("n")).collect()}
    assert unread and got == {(3, 3): 20, (6, 6): 20, (40, 12): 20}
    assert "dynamicpruning" in states._jdf.queryExecution().executedPlan().toString()


def test_small_samples_merge_from_all_tasks(spark):
    """One hot group of repeated cells, a small one, and fewer tasks than merge groups or more."""
    rows = spark.range(4000).selectExpr("cast(id % 10 < 9 as int) g", "cast(id % 700 as int) r", "cast(id % 3 as int) c")
    groups = {}
    for x in rows.collect():
        groups.setdefault(x.g, []).append((hashlib.md5(f"{x.g}|{x.r}|{x.c}".encode()).hexdigest(), x.r, x.c))
    want = sorted((g, i, r, c) for g, v in groups.items() for i, (_, r, c) in enumerate(sorted(v)[:300], 1))
    for parts in (1, 5, 150):
        few = sampling.sample_cells(rows.repartition(parts), "g", 300).collect()
        assert sorted((x.g, x.pick, x.r, x.c) for x in few) == want


def test_training_csv_needs_its_target(spark, tmp_path):
    rows = spark.createDataFrame([(0.5, 1)], "slope_risk double, ignited int")
    tables.write_training(rows, str(tmp_path / "csv"), fmt="csv")
    assert tables.read_training_csv(spark, str(tmp_path / "csv"), rows.schema).count() == 1
    with pytest.raises(ValueError, match="target column"):
        tables.read_training_csv(spark, str(tmp_path / "csv"), rows.select("slope_risk").schema)
    with pytest.raises(ValueError, match="must contain"):
        tables.require_columns(rows, ["missing"])


def test_union_of_no_scenarios_keeps_the_schema(spark):
    schema = spark.createDataFrame([(0.5, 1)], "slope_risk double, ignited int").schema
    empty = tables.union_scenarios([None, None], schema, spark)
    assert empty.count() == 0 and empty.columns == ["slope_risk", "ignited"]


def test_run_inventory_names(spark):
    configs = spark.createDataFrame([("b",), ("c",)], "config string")
    expected = runlog.expected_runs(configs, "config", [42, 43])
    present = spark.createDataFrame([("b", 42), ("c", 43)], "config string, seed int")
    absent = runlog.missing_runs(expected, present, ["config", "seed"]).withColumn("name", runlog.run_name("config", "seed"))
    assert sorted(x.name for x in absent.collect()) == ["b_s43", "c"]


def test_wind_hours(spark):
    hours = spark.createDataFrame(
        [("2024010110", 5.0, 90.0), ("2024010111", 10.0, 45.0), ("2024010112", -1.0, 10.0), ("2024010113", None, 1.0)],
        "hour_key string, speed_ms double, dir_deg double",
    )
    day = wind.daily_wind(hours).first()
    assert (day.mean_kmh, day.fire_kmh, day.fire_dir, day.missing_hours) == (27.0, 36.0, 45.0, 2)
    assert wind.usable_wind(hours).count() == 2


def test_large_files_are_streamed(spark, tmp_path):
    for name, body in (("a.bin", b"x" * 10), ("b.bin", b"y" * 5000)):
        (tmp_path / name).write_bytes(body)
    found = fingerprint.fingerprint_files(spark, str(tmp_path), "*.bin")
    got = {x.path.rsplit("/", 1)[1]: x.sha256 for x in found.collect()}
    assert got == {"a.bin": hashlib.sha256(b"x" * 10).hexdigest(), "b.bin": hashlib.sha256(b"y" * 5000).hexdigest()}
    expected = spark.createDataFrame([("a.bin", got["a.bin"]), ("b.bin", "00"), ("c.bin", "11")], "file string, expected_sha256 string")
    status = {x.file: x.status for x in fingerprint.check_fingerprints(found, expected).collect()}
    assert status == {"a.bin": "match", "b.bin": "differs", "c.bin": "missing"}


def test_scratch_follows_the_session(spark):
    from types import SimpleNamespace

    configured = spark.conf.get("spark.checkpoint.dir", None)
    root = scratch_root(spark)
    assert root == configured if configured else root.startswith("/tmp/spark-")

    def session(folder, master):
        conf = SimpleNamespace(get=lambda key, default: folder or default)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="x"))

    assert scratch_root(session("hdfs://shared/dir/", "yarn")) == "hdfs://shared/dir"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(session(None, "yarn"))


@pytest.mark.parametrize("scale", [1e-9, 1.0])
def test_score_buckets_split_any_distribution(spark, scale):
    """Scores below 1e-7, and values with one far outlier, still spread over the buckets."""
    rows = spark.range(20_000).selectExpr(f"id * {scale} / 20000 as p", "cast(id % 7 < 3 as int) as y")
    rows = rows.union(spark.createDataFrame([(1.0, 1)], "p double, y int"))
    counts = rows.groupBy(F.col("p").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    placed, levels = probability._leveled(counts, "v", [])
    assert placed.groupBy(levels[0]).count().agg(F.max("count")).head()[0] <= 20_000 / 256 * 2
    pairs = [(x.p, x.y) for x in rows.collect()]
    pos, neg = np.array([p for p, y in pairs if y]), np.array([p for p, y in pairs if not y])
    want = (np.searchsorted(np.sort(neg), pos, "left").sum() + np.searchsorted(np.sort(neg), pos, "right").sum()) / 2 / len(pos) / len(neg)
    assert probability.roc_auc(rows, "y", "p").head().roc_auc == pytest.approx(want, abs=1e-12)


def test_requests_past_the_stop_repeat_the_last_state(spark):
    progress = spark.createDataFrame([(1, 0, 2, 2, "a"), (1, 1, 0, 3, "b")], "run_id int, step int, active_cells long, reached_cells long, status string")
    log = runlog.build_run_logs(progress, 50, later=(1, 4)).head()
    assert [(x.requested_step, x.actual_step, x.reached_cells) for x in log.snapshots] == [(0, 0, 2), (1, 1, 3), (4, 1, 3)]


def test_batched_search_equals_separate_fits(spark, learnable):
    names = ["a", "b", "d"]
    df, _, _ = learnable
    recipes = [Recipe(), Recipe("l1", C=0.01), Recipe("elasticnet", C=0.05, l1_ratio=0.4, class_weight="custom", positive_weight=6.0), Recipe(C=1e-4, class_weight="none")]
    got = [r["cv_f1"] for r in learning.search(df, names, recipes, folds=3)]
    for recipe, value in zip(recipes, got):
        scores = []
        for k in range(3):
            model = learning.fit_logistic(df.filter(F.col("fold") != k), names, recipe)
            sweep = probability.cutoff_counts(learning.predict(model, df.filter(F.col("fold") == k), ["ignited"]), "ignited", "p")
            scores.append(sweep.agg(F.max(probability.f1_of_counts())).head()[0])
        assert value == pytest.approx(np.mean(scores), abs=2e-3)


def test_block_manifest_tree_and_changes(spark, tmp_path):
    import hashlib

    folder = tmp_path / "files"
    folder.mkdir()
    contents = {"a.bin": bytes(range(256)) * 41, "b.bin": b"z", "c.bin": b"x" * 100, "d.bin": b"y" * 1000}
    for name, data in contents.items():
        (folder / name).write_bytes(data)
    block, fan = 100, 3

    def root(data):
        level = [hashlib.sha256(data[i : i + block]).hexdigest() for i in range(0, max(len(data), 1), block)]
        while len(level) > 1:
            groups = [level[i : i + fan] for i in range(0, len(level), fan)]
            level = [g[0] if len(g) == 1 else hashlib.sha256("".join(g).encode()).hexdigest() for g in groups]
        return level[0]

    manifest = fingerprint.block_manifest(spark, str(folder), "*.bin", block)
    got = {r["path"].rsplit("/", 1)[1]: r for r in fingerprint.file_roots(manifest, fan).collect()}
    assert {n: r["sha256"] for n, r in got.items()} == {n: root(d) for n, d in contents.items()}
    assert got["c.bin"]["sha256"] == hashlib.sha256(contents["c.bin"]).hexdigest() and got["a.bin"]["blocks"] == 105
    name = F.element_at(F.split("path", "/"), -1)
    recorded = spark.createDataFrame(manifest.select(name.alias("file"), "block", "sha256").toPandas())
    (folder / "a.bin").write_bytes(contents["a.bin"][:550] + b"!" + contents["a.bin"][551:] + b"more" * 20)
    (folder / "c.bin").unlink()
    (folder / "e.bin").write_bytes(b"new")
    changed = fingerprint.changed_blocks(fingerprint.block_manifest(spark, str(folder), "*.bin", block), recorded)
    assert sorted(map(tuple, changed.collect())) == [("a.bin", 5, "changed"), ("a.bin", 104, "changed"), ("a.bin", 105, "added"), ("c.bin", 0, "missing"), ("e.bin", 0, "added")]


def test_input_digests_equal_read_blob(spark, sf_dir):
    import duckdb

    from cinderframe.plans.catalog import QUERIES

    blobs = dict(duckdb.connect().execute(f"select parse_filename(filename), sha256(content) from read_blob('{sf_dir}/*.parquet')").fetchall())
    rows = {r["file"]: r for r in QUERIES["s9_input_digests"](spark, sf_dir).collect()}
    assert set(rows) == {*blobs, "removed.parquet"}
    assert {n: r["status"] for n, r in rows.items() if r["status"] != "match"} == {"nation.parquet": "differs", "removed.parquet": "missing"}
    assert all(rows[n]["sha256"] == digest for n, digest in blobs.items())


def test_feature_contract(spark):
    from cinderframe.operators import features

    good = spark.createDataFrame([(1, 1, 1, 1, *map(float, range(9)))], "run_id int, step int, r int, c int, " + ", ".join(f"{f} double" for f in features.SCHEMA_9))
    assert features.feature_vectors(good, "9").first()["feature_values"] == list(map(float, range(9)))
    with pytest.raises(ValueError):
        features.feature_vectors(good.select(*reversed(good.columns)), "9")
    with pytest.raises(Exception, match="absent or non-finite feature at 1, 1, 1, 1"):
        features.feature_vectors(good.withColumn("wind_sin", F.lit(float("nan"))), "9").collect()


def test_fits_and_metrics_of_counted_rows_equal_those_of_all_rows(spark, learnable):
    names = ["a", "b", "d"]
    df, _, _ = learnable
    rows = df.withColumns({n: F.round(n, 0) for n in names})
    rows = rows.unionByName(rows.filter("ignited = 1"))
    counted = trials.count_equal(rows, [*names, "ignited", "fold"])
    assert counted.count() < rows.count() == counted.agg(F.sum("n_rows")).head()[0]
    recipes = learning.random_trials(3, seed=2)
    assert learning.search(counted, names, recipes, folds=3, count="n_rows") == learning.search(rows, names, recipes, folds=3)
    fits = [learning.fit_linear(*x, {"l2": Recipe()}, **k)["l2"] for x, k in (((rows, names), {}), ((counted, names), {"count": "n_rows"}))]
    assert fits[0] == fits[1]
    want = learning.evaluate(fits[0].predict(rows, ["ignited"]), also=0.5)
    assert learning.evaluate(fits[1].predict(counted, ["ignited", "n_rows"]), also=0.5, count="n_rows") == pytest.approx(want, abs=1e-12)


def test_folds_shuffle_no_hash(spark):
    """Folds follow the hash order in each class; rows are shuffled with a prefix of the hash only."""
    rows = spark.range(3000, numPartitions=3).selectExpr("id", "cast(id % 7 = 0 as int) y")
    folded = sampling.stratified_folds(rows, "y", ["id"], k=5)
    order = Window.partitionBy("y").orderBy(F.md5(F.concat_ws("|", F.lit("42"), F.col("id").cast("string"))), "id")
    want = rows.withColumn("fold", ((F.row_number().over(order) - 1) % 5).cast("int"))
    assert folded.select("id", "y", "fold").exceptAll(want).count() == 0 and folded.count() == 3000
    lines = folded._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(lines) if "RepartitionByExpression" in line)
    assert "__hash" in "".join(lines[:at]) and "__hash" not in "".join(lines[at : at + 2])


def test_logistic_fits_distinct_rows(spark, learnable, monkeypatch):
    """Twice the rows are the same fit at half the strength, over the same distinct rows."""
    df, _, _ = learnable
    rows = df.withColumns({n: F.round(n, 0) for n in ("a", "b", "d")}).drop("fold")
    seen, count_equal = [], trials.count_equal
    monkeypatch.setattr(trials, "count_equal", lambda *a: seen.append(count_equal(*a)) or seen[-1])
    once = learning.fit_logistic(rows, ["a", "b", "d"], Recipe(C=1.0)).stages[-1].coefficients.toArray()
    twice = learning.fit_logistic(rows.unionByName(rows), ["a", "b", "d"], Recipe(C=0.5)).stages[-1].coefficients.toArray()
    assert once == pytest.approx(twice, abs=1e-5)
    assert [x.count() for x in seen] == [rows.select("a", "b", "d", "ignited").distinct().count()] * 2


def test_the_split_is_written_without_a_sort_by_part(spark, sf_dir):
    """A folder for each part made every task sort its whole file split; the rows are those of the training table."""
    from cinderframe.plans import learned
    from cinderframe.plans.fixtures import Tables

    t = Tables(spark, sf_dir)
    train, test = learned.split(t)
    assert train.inputFiles() and not [f for f in train.inputFiles() if "/part=" in f]
    keys = ["run_id", "step", "r", "c"]
    both = train.unionByName(test)
    assert both.count() == both.select(keys).distinct().count() == t.labels_table.count()
    for label in (0, 1):
        n, held = both.filter(f"ignited = {label}").count(), test.filter(f"ignited = {label}").count()
        assert held == math.floor(0.2 * n + 0.5)


def test_chunks_rank_only_the_rows_of_buckets_that_a_block_cuts(spark, monkeypatch):
    """Buckets of 0 to 40 rows against blocks of 1, 7, 64 and 10,000, next to the rank of every row."""
    rng = random.Random(5)
    rows = [(a, b, c, rng.choice([0, 0, 1])) for a in range(3) for b in range(9) for c in rng.sample(range(60), rng.randrange(41))]
    df = written(spark.createDataFrame(rows, "a int, b int, c int, y int"), "chunk-rows")
    joined, real = [], profile.join_metadata
    monkeypatch.setattr(profile, "join_metadata", lambda big, small, on: joined.append(small.count()) or real(big, small, on))
    for chunk in (1, 7, 64, 10_000):
        want = {}
        for i, row in enumerate(sorted(rows)):
            n, y = want.get(i // chunk, (0, 0))
            want[i // chunk] = n + 1, y + row[3]
        got = profile.positives_per_chunk(df, "y", ["a", "b"], ["c"], chunk).collect()
        assert len(got) == len(want) and {r["chunk"]: (r["rows"], r["positives"]) for r in got} == want
    assert joined[-1] == 0 and joined[-2] <= len(rows) // 64
    assert profile.positives_per_chunk(df.filter("false"), "y", ["a", "b"], ["c"], 7).collect() == []


def test_folds_are_dealt_to_the_tasks_they_are_given(spark, hot):
    """To 11 tasks and not to the session's 4 shuffle partitions, and the join with the places keeps them there; the folds are the same."""
    few = "spark.sql.autoBroadcastJoinThreshold"
    held = spark.conf.get(few)
    spark.conf.set(few, "-1")
    try:
        dealt = sampling.stratified_folds(hot, "y", ["id"], tasks=11)
        assert dealt.rdd.getNumPartitions() == 11
        assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, sampling.stratified_folds(hot, "y", ["id"]).collect()))
    finally:
        spark.conf.set(few, held)


def test_training_csv_is_written_compressed(spark, sf_dir):
    """As plain text the table took most of the query's disk; every value comes back as it was."""
    from cinderframe.plans import scans
    from cinderframe.plans.fixtures import Tables

    files = scans.training_csv(Tables(spark, sf_dir)).inputFiles()
    assert files and all(f.endswith(".csv.gz") for f in files)
    rows = spark.range(500).selectExpr("cast(id as int) r", "1 / (id + 3) x", "cast(id % 2 as int) ignited").repartition(3)
    path = tables.write_training(rows, scratch_path(spark, "csv"), fmt="csv")
    assert sorted(map(tuple, tables.read_training_csv(spark, path, rows.schema).collect())) == sorted(map(tuple, rows.collect()))


def test_the_split_writes_the_training_rows_once(spark, sf_dir):
    """A second copy with the part as its column took as much disk again."""
    from pathlib import Path

    from cinderframe.plans import learned
    from cinderframe.plans.fixtures import Tables

    root = Path(scratch_root(spark))
    before = set(root.iterdir())
    train, test = learned.split(Tables(spark, sf_dir))
    rows = train.count() + test.count()
    sizes = [spark.read.parquet(str(p)).count() for p in set(root.iterdir()) - before if p.name.startswith(("training-", "learning-"))]
    assert sizes == [rows]


def test_folds_are_dealt_without_features_where_these_repeat(spark, monkeypatch):
    """The counted rows are those of folds dealt with all features: with nulls, both zeros, few repeats, and hashes that meet."""
    rng = random.Random(3)
    rows = [(i, rng.choice([0.5, None, -0.0, 0.0]), rng.choice([None, 0.5, 2.0]), i / 7, int(rng.random() < 0.1)) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, a double, b double, d double, y int").repartition(5)
    dealt, real = [], sampling.stratified_folds
    monkeypatch.setattr(trials, "stratified_folds", lambda held, *a, **k: dealt.append(held.columns) or real(held, *a, **k))

    def check(names):
        got = trials.count_in_folds(df, names, "y", F.col("id") * 10, [F.expr("__key div 10")], folds=5, tasks=3)
        want = real(df, "y", ["id"], k=5).groupBy(*names, "y", "fold").agg(F.count(F.lit(1)).alias("n_rows"))
        assert got.columns == want.columns and got.count() == want.count()
        assert got.exceptAll(want).count() == 0 and got.agg(F.sum("n_rows")).first()[0] == 4000

    check(["a", "b"])
    check(["a", "d"])
    monkeypatch.setattr(trials.F, "xxhash64", lambda *_: F.lit(1).cast("long"))
    check(["a", "b"])
    assert dealt == [["__key", "y", "__code"], ["__key", "y", "a", "d"], ["__key", "y", "a", "b"]]


def test_the_row_key_gives_back_its_ids(spark, sf_dir):
    from cinderframe.plans import fixtures, learned

    rows = fixtures.Tables(spark, sf_dir).labels_table
    back = rows.select(*learned.IDS, fixtures.row_key().alias("k")).select(*learned.IDS, *[c.alias(f"{n}_") for n, c in zip(learned.IDS, fixtures.ids_of("k"))])
    assert back.select([f"{n}_" for n in learned.IDS]).exceptAll(back.select(*learned.IDS)).count() == 0
    assert back.filter(" or ".join(f"not {n} <=> {n}_" for n in learned.IDS)).count() == 0 < back.count()
