"""Sources and sinks (S1 to S10): written to the shared folder, read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderframe.operators.features import SCHEMA_B
from cinderframe.operators.scoring import confusion, with_metrics
from cinderframe.operators.transitions import progression
from cinderframe.functions.columns import is_reached, is_truth
from cinderframe.plans.fixtures import LAST_STEP, Tables, with_fixtures
from cinderframe.plans.registry import query, r6, rounded
from cinderframe.session import scratch_path, written
from cinderframe.sources import fingerprint, layers, runlog, tables, wind

LAYER_COLUMNS = ("slope_raw", "proximity_raw", "buildings_raw", "materials_raw")


@query("s1_layer_stack_scan", with_fixtures("cells", "select r, c, slope_raw, proximity_raw, buildings_raw, materials_raw, 4 layers_present from cells"))
def layer_stack(t: Tables):
    paths = {}
    for name in LAYER_COLUMNS:
        paths[name] = scratch_path(t.spark, name)
        t.cells.select("r", "c", F.col(name).alias("value")).write.parquet(paths[name])
    return layers.read_layers(t.spark, paths, {name: t.grid for name in paths})


TRAINING_ROWS = """select run_id, step, r, c, round(slope_risk, 6) slope_risk, proximity_risk, building_presence,
  round(material_risk, 6) material_risk, wind_speed, round(wind_sin, 6) wind_sin, round(wind_cos, 6) wind_cos,
  neighbor_burning_count, round(composite_flammability, 6) composite_flammability,
  round(wind_weighted_score, 6) wind_weighted_score, ignited from training"""


def training_rows(df):
    return rounded(df, "slope_risk", "material_risk", "wind_sin", "wind_cos", "composite_flammability", "wind_weighted_score")


def training_schema():
    keys = [T.StructField(k, T.IntegerType()) for k in ("run_id", "step", "r", "c")]
    features = [T.StructField(f, T.DoubleType()) for f in SCHEMA_B]
    return T.StructType([*keys, *features, T.StructField("ignited", T.IntegerType())])


@query("s2_training_csv_scan", with_fixtures("training", TRAINING_ROWS))
def training_csv(t: Tables):
    path = tables.write_training(t.training_rows(), scratch_path(t.spark, "training-csv"), fmt="csv")
    return training_rows(tables.read_training_csv(t.spark, path, training_schema()))


@query("s3_training_sink", with_fixtures("training", """
    select wind_speed, count(*) "rows", cast(sum(ignited) as bigint) positives, round(sum(wind_weighted_score), 6) score_sum
    from training group by 1"""))
def training_sink(t: Tables):
    path = tables.write_training(t.training_rows(), scratch_path(t.spark, "training"), partition_by=["wind_speed"])
    back = t.spark.read.parquet(path).withColumn("wind_speed", F.col("wind_speed").cast("double"))
    return back.groupBy("wind_speed").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("ignited").alias("positives"), r6(F.sum("wind_weighted_score"), "score_sum")
    )


@query("s4_role_partitions", with_fixtures("env", """
    select r, c, round(slope_risk, 6) slope_risk, 'train' as role from env where (r * 120 + c) % 10 < 6"""))
def role_partitions(t: Tables):
    slot = (F.col("r") * 120 + F.col("c")) % 10
    role = F.when(slot < 6, "train").when(slot < 8, "validation").otherwise("calibration")
    rows = t.env.select("r", "c", r6("slope_risk"), role.alias("role"))
    path = tables.write_training(rows, scratch_path(t.spark, "roles"), partition_by=["role"])
    return tables.read_role(t.spark, path, "train")


@query("s5_snapshot_table", with_fixtures("snapshots", f"select run_id, step, r, c, state from snapshots where step in (6, {LAST_STEP})"))
def snapshot_table(t: Tables):
    path = tables.write_snapshots(t.snapshots, scratch_path(t.spark, "snapshots"))
    return tables.read_snapshots(t.spark, path, steps=[6, LAST_STEP]).select("run_id", "step", "r", "c", "state")


@query("s6_run_log_read", with_fixtures("snapshots", f"""
    select run_id, {LAST_STEP} stop_step,
      case when max(case when step = {LAST_STEP} then active_cells end) over (partition by run_id) > 0
        then 'max_timesteps' else 'inactive' end stop_reason,
      100 max_timesteps, requested_step, step actual_step, active_cells, reached_cells,
      case when active_cells > 0 then 'time-limited (active)' else 'inactive' end status
    from (select *, step requested_step from progress union all
      select *, unnest([{LAST_STEP + 3}, {2 * LAST_STEP}]) from progress where step = {LAST_STEP})""", "progress as (select run_id, step, count(*) filter (where state in (3, 4)) active_cells, count(*) filter (where state in (3, 4, 5)) reached_cells from snapshots group by 1, 2)"))
def run_log(t: Tables):
    logs = runlog.build_run_logs(progression(t.snapshots), 100, later=(LAST_STEP, LAST_STEP + 3, 2 * LAST_STEP))
    path = runlog.write_run_logs(logs, scratch_path(t.spark, "run-logs"))
    return runlog.read_run_logs(t.spark, path)


@query("s7_wind_payload", with_fixtures("wind_hourly", "select hour_key, speed_ms, dir_deg from wind_hourly"))
def wind_payload(t: Tables):
    path = scratch_path(t.spark, "wind")
    wind.write_payload(t.wind_hourly).write.parquet(path)
    return wind.read_payload(t.spark.read.parquet(path))


@query("s8_result_sinks", with_fixtures("final cells", """
    select kind, run_id, tp, fp, fn, round(case when tp + fp = 0 then 0 else tp / (tp + fp) end, 6) as precision,
      round(case when tp + fn = 0 then 0 else tp / (tp + fn) end, 6) recall from (
      select run_id, count(*) filter (where state >= 3 and truth = 1) tp, count(*) filter (where state >= 3 and truth = 0) fp,
        count(*) filter (where state < 3 and truth = 1) fn
      from final join cells using (r, c) group by 1) cross join (values ('json'), ('csv')) k(kind)"""))
def result_sinks(t: Tables):
    rows = t.final.join(t.cells, ["r", "c"])
    scores = with_metrics(confusion(rows, is_reached(), is_truth("truth"), ["run_id"])).select(
        "run_id", "tp", "fp", "fn", r6("precision"), r6("recall")
    )
    as_json, as_csv = tables.write_results(scores, scratch_path(t.spark, "results"))
    read = t.spark.read.schema(scores.schema)
    return (
        read.json(as_json).withColumn("kind", F.lit("json")).unionByName(
            read.csv(as_csv, header=True).withColumn("kind", F.lit("csv"))
        )
    )


@query("s9_file_fingerprints", """
    with listed as (
      select 'part-' || p_partkey % 4 as file, p_partkey k, p_name as name from part
      union all select 'customer-' || c_custkey % 4, c_custkey, c_name from customer
      union all select 'supplier-' || s_suppkey % 4, s_suppkey, s_name from supplier),
    digests as (
      select file, sha256(string_agg(k || '|' || name || chr(10), '' order by k)) expected_sha256,
        sha256(string_agg(k || '|' || case when file = 'customer-1' then lower(name) else name end || chr(10), '' order by k)) later
      from listed group by 1)
    select file, expected_sha256, case when file = 'supplier-2' then null else later end as sha256,
      case when file = 'supplier-2' then 'missing' when later = expected_sha256 then 'match' else 'differs' end status from digests""")
def file_fingerprints(t: Tables):
    """Record digests of written files, then check a later copy in which one changed and one is gone."""
    parts = [("part", "p_partkey", "p_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name")]
    listed = [t.table(n).select(F.concat(F.lit(f"{n}-"), F.col(k) % 4).alias("file"), F.col(k).alias("k"), F.col(v).alias("name")) for n, k, v in parts]
    rows = listed[0].unionByName(listed[1]).unionByName(listed[2])

    def digests(lines, label):
        folder = scratch_path(t.spark, label)
        ordered = lines.repartition("file").sortWithinPartitions("file", "k")
        ordered.select("file", F.concat_ws("|", "k", "name").alias("value")).write.partitionBy("file").text(folder)
        return fingerprint.fingerprint_files(t.spark, folder, "*.txt")

    name = F.regexp_extract("path", "/file=([^/]+)/", 1)
    recorded = written(digests(rows, "files").select(name.alias("file"), F.col("sha256").alias("expected_sha256")), "digests")
    changed = rows.filter("file <> 'supplier-2'").withColumn("name", F.when(F.col("file") == "customer-1", F.lower("name")).otherwise(F.col("name")))
    return fingerprint.check_fingerprints(digests(changed, "files-later"), recorded, name).drop("length")


@query("s9_input_digests")
def input_digests(t: Tables):
    """Every input file digested block by block and checked against a record in which one file has changed and one is gone.

    The record holds the digests of the region table under the nation table's name, and a file that is not there.
    """
    folder = fingerprint.block_manifest(t.spark, t.sf_dir, "*.parquet")
    manifest = written(folder, "manifest")
    found = written(fingerprint.file_roots(manifest), "roots")
    root = F.regexp_extract("path", "/([^/]+[.]parquet(/.*)?)$", 1)
    recorded = found.select(root.alias("file"), F.col("sha256").alias("expected_sha256"))
    region = recorded.filter("file = 'region.parquet'").select("expected_sha256")
    stale = recorded.filter("file <> 'nation.parquet'")
    for name in ("nation.parquet", "removed.parquet"):
        stale = stale.unionByName(region.withColumn("file", F.lit(name)))
    return fingerprint.check_fingerprints(found, stale, root)


@query("s10_run_inventory", with_fixtures("present_runs", """
    select e.config, e.seed, case when e.seed = 42 then e.config else e.config || '_s' || e.seed end run_name
    from (select distinct p_brand config, s.seed from part cross join (values (42), (43), (44), (45), (46), (47), (48)) s(seed)) e
    where not exists (select 1 from present_runs p where p.config = e.config and p.seed = e.seed)"""))
def run_inventory(t: Tables):
    expected = runlog.expected_runs(t.table("part").withColumnRenamed("p_brand", "config"), "config", range(42, 49))
    absent = runlog.missing_runs(expected, t.present_runs, ["config", "seed"])
    return absent.withColumn("run_name", runlog.run_name("config", "seed"))
