"""Tables of the data model as explicit schemas, and the check that operators make on entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_KINDS = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType(), "D": T.DateType(), "t": T.TimestampType(), "b": T.BooleanType()}


def _schema(spec: str) -> T.StructType:
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (x.split(":") for x in spec.split())])


OBSERVATIONS = _schema("datasetH1:s datasetH2:s fluseason:i sample:s location_code:s season_week:i week_enddate:D value:d fluseason_fraction:d")
LOCATIONS = _schema("abbreviation:s location_name:s population:l location_code:s geoid:s")
CALENDAR = _schema("season:i week:i start_date:D end_date:D saturday:D")
FRAME = _schema("frame_id:s location_code:s season_week:i value:d week_enddate:D origin:s")
SAMPLES = _schema("run_id:s reference_date:D sample_id:i week_idx:i location:s value:d")
HUB = _schema("reference_date:D target:s horizon:i target_end_date:D location:s output_type:s output_type_id:s value:d")
HUB_2022 = _schema("forecast_date:D target_end_date:D location:s type:s quantile:s value:d target:s")
TRUTH = _schema("date:D location:s value:d")
TRUTH_VINTAGE = _schema("date:D location:s value:d as_of:t")
TRAJECTORIES = _schema("origin_date:D scenario_id:s location:s target:s age_group:s horizon:i output_type:s output_type_id:d run_grouping:d stochastic_run:s value:d")
SCORES = _schema("model:s group:s season:s reference_date:D target_end_date:D location:s horizon:i wis:d dispersion:d overprediction:d underprediction:d interval_coverage_50:d interval_coverage_90:d relative_wis:d")
LEADERBOARD = _schema("season:s metric:s aggregation:s model:s score:d rank:i")
JOBS = _schema("job_id:i scenario_id:i run_id:s season:s date:D config:s")
RUNS = _schema("run_id:s scenario_id:i status:s start_time:t completed:i final_loss:d")
LOSSES = _schema("run_id:s scenario_id:i scenario_string:s step:l timestamp:t loss:d")
SCENARIOS = _schema("scenario_id:i ddpm_name:s unet_name:s dataset_name:s transform_name:s enrich_name:s")

#: The 23 quantile levels of the forecast hub.
QUANTILES = (0.01, 0.025, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 0.975, 0.99)


def require_columns(df: DataFrame, names: list[str] | T.StructType) -> DataFrame:
    names = names.fieldNames() if isinstance(names, T.StructType) else names
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df
