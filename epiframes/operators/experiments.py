"""Scenario grids, jobs, run logs and the comparison of experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Options of the experiments in their order, and the baseline.
OPTIONS = {
    "ddpm_name": ("U200l", "U200c", "U500l", "U500c", "U800c"),
    "unet_name": ("Rx124", "Rx1224", "Cx1224", "Rx12448"),
    "dataset_name": ("100S", "70S30M", "30S70M", "100M"),
    "transform_name": ("Lins", "Sqrt", "LinsZs", "LogZs"),
    "enrich_name": ("No", "PoisPadScale", "PoisPadScaleSmall", "Pois"),
}
BASELINE = {"ddpm_name": "U500c", "unet_name": "Rx124", "dataset_name": "30S70M", "transform_name": "Sqrt", "enrich_name": "No"}
CONFIGS = ("celebahq_noTTJ5", "celebahq_try3", "celebahq")


def scenario_grid(spark: SparkSession, options: dict[str, tuple[str, ...]] = OPTIONS) -> DataFrame:
    """All combinations; the id is the mixed-radix number of the positions, so no window is needed."""
    total = 1
    for v in options.values():
        total *= len(v)
    out, step = spark.range(total).select(F.col("id").cast("int").alias("scenario_id")), total
    for name, values in options.items():
        step //= len(values)
        at = (F.floor(F.col("scenario_id") / step) % len(values)).cast("int")
        out = out.withColumn(name, F.lit(list(values))[at])
    return out


def essential_scenarios(grid: DataFrame, baseline: dict[str, str] = BASELINE) -> DataFrame:
    """The baseline and every variation of one parameter."""
    changed = sum(((F.col(c) != v).cast("int") for c, v in baseline.items()), F.lit(0))
    return grid.where(changed <= 1)


def job_grid(models: DataFrame, seasons: dict[str, tuple[str, str]], configs: tuple[str, ...] = CONFIGS, step_days: int = 14) -> DataFrame:
    """Models x seasons x dates x configs with a running job id over (scenario, date, config position)."""
    spark = models.sparkSession
    spans = spark.createDataFrame([(s, a, b) for s, (a, b) in seasons.items()], "season string, a string, b string")
    dates = spans.select("season", F.explode(F.sequence(F.col("a").cast("date"), F.col("b").cast("date"), F.expr(f"interval {step_days} days"))).alias("date"))
    named = F.explode(F.lit(list(configs)))
    grid = models.select("scenario_id", "run_id").join(F.broadcast(dates)).select("*", named.alias("config"))
    pos = F.array_position(F.lit(list(configs)), F.col("config"))
    # numbered within each scenario; one row for each scenario meets in one window
    own = Window.partitionBy("scenario_id").orderBy("date", pos)
    each = grid.groupBy("scenario_id").agg(F.count("*").alias("_n"))
    before = each.select("scenario_id", (F.sum("_n").over(Window.orderBy("scenario_id")) - F.col("_n")).alias("_before"))
    numbered = grid.withColumn("_own", F.row_number().over(own)).join(before, "scenario_id")
    return numbered.withColumn("job_id", (F.col("_own") + F.col("_before")).cast("int")).drop("_own", "_before")


def remaining_jobs(jobs: DataFrame, done: DataFrame) -> DataFrame:
    return jobs.join(done.select("scenario_id", "date", "config"), ["scenario_id", "date", "config"], "left_anti")


def failed_jobs(folders: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs of the failed folders, by their parsed names, once each."""
    from ..functions.names import parse_run_folder

    p = parse_run_folder(F.col("folder"))
    parsed = folders.select(*[c.alias(k) for k, c in p.items() if k != "model_part"])
    return jobs.join(parsed, ["scenario_id", "date", "config"], "left_semi").dropDuplicates(["scenario_id", "date", "config"])


def attach_scenario(board: DataFrame, grid: DataFrame) -> DataFrame:
    from ..functions.names import scenario_id_of_model

    return board.withColumn("scenario_id", scenario_id_of_model(F.col("model"))).join(grid, "scenario_id")


def loss_vs_score(losses: DataFrame, board: DataFrame) -> DataFrame:
    """Losses per scenario beside the scores of its models."""
    return board.join(losses, "scenario_id")


def run_summary_stats(runs: DataFrame) -> DataFrame:
    return runs.agg(
        F.count("*").alias("n_runs"), F.countDistinct("scenario_id").alias("n_scenarios"), F.countDistinct("date").alias("n_dates"), F.countDistinct("config").alias("n_configs"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.avg(F.col("completed").cast("double")).alias("completion_rate"), F.avg("mean").alias("mean"), F.avg("std").alias("std"),
    )


def scenario_config_summary(runs: DataFrame) -> DataFrame:
    return runs.groupBy("scenario_id", "config").agg(F.count("*").alias("n"), F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("mean_std"), F.avg("std").alias("std"), F.countDistinct("date").alias("n_dates"))


def ensemble_mean(runs: DataFrame) -> DataFrame:
    """Over configs: mean of means and of deviations, sample count of the first config."""
    return runs.groupBy("scenario_id", "date").agg(F.avg("mean").alias("mean"), F.avg("std").alias("std"), F.min_by("num_samples", "config").alias("num_samples")).withColumn("config", F.lit("ensemble"))


def daily_timeline(runs: DataFrame) -> DataFrame:
    return runs.groupBy("config", "date").agg(F.avg("mean").alias("mean"))


def run_heatmap(runs: DataFrame, configs: list[str]) -> DataFrame:
    return runs.groupBy("scenario_id").pivot("config", configs).agg(F.avg("mean"))


def parameter_effects(board: DataFrame, baseline: dict[str, str] = BASELINE) -> DataFrame:
    """Per parameter value, the others at the baseline: best scores, change against the baseline, number of models."""
    names = list(baseline)
    changed = sum(((F.col(c) != v).cast("int") for c, v in baseline.items()), F.lit(0))
    base = board.where(changed == 0).agg(F.min("wis").alias("base"))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("parameter"), F.col(c).alias("setting"), (changed - (F.col(c) != baseline[c]).cast("int")).alias("others")) for c in names]))
    long = board.select("model", "wis", "relative_wis", pairs.alias("p")).where("p.others = 0")
    best = long.groupBy("p.parameter", "p.setting").agg(F.min("wis").alias("best_wis"), F.min("relative_wis").alias("best_relative_wis"), F.countDistinct("model").alias("n_models"))
    return best.join(F.broadcast(base)).withColumn("improvement", F.round((F.col("base") - F.col("best_wis")) / F.col("base") * 100, 2)).drop("base")


def config_effects(board: DataFrame) -> DataFrame:
    from ..functions.names import inpaint_config_of_model

    return board.groupBy(inpaint_config_of_model(F.col("model")).alias("config")).agg(F.min("wis").alias("best_wis"), F.min("relative_wis").alias("best_relative_wis"), F.countDistinct("model").alias("n_models"))


def loss_score_correlation(df: DataFrame) -> DataFrame:
    return df.agg(*[F.corr(a, b).alias(f"{a}_{b}") for a in ("final_loss", "last_mean") for b in ("wis", "relative_wis")])


def epoch_loss(steps: DataFrame, per_epoch: int) -> DataFrame:
    return steps.groupBy("run_id", F.floor((F.col("step") - 1) / per_epoch).alias("epoch")).agg(F.avg("loss").alias("loss"))


def steps_per_run(steps: DataFrame) -> DataFrame:
    return steps.groupBy("run_id").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"), F.max("n").alias("most"))


def completed_runs(runs: DataFrame) -> DataFrame:
    return runs.where("completed = 1 AND final_loss IS NOT NULL").orderBy("scenario_id")


def last_n_mean(steps: DataFrame, n: int = 100) -> DataFrame:
    """Mean of a run's last n losses (all if fewer) and its final loss."""
    w = Window.partitionBy("run_id").orderBy(F.desc("step"))
    last = steps.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return last.groupBy("run_id").agg(F.avg("loss").alias("last_mean"), F.max_by("loss", "step").alias("final_loss"))


def failed_by_season(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("season").agg(F.count("*").alias("n"))


def latest_finished_run(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status") == "FINISHED").groupBy("scenario_id").agg(F.max_by("run_id", F.struct("start_time", "run_id")).alias("run_id")).orderBy("scenario_id")
