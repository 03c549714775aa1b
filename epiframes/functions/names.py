"""Names, labels and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_run_folder(folder: Column) -> dict[str, Column]:
    """scenario_id, model_part, config and date of ``i1::m_x::...::conf_c::2023-12-09``; null where they do not parse."""
    parts = F.split(folder, "::")
    n = F.size(parts)
    config = F.get(parts, n - 2)
    return {
        "scenario_id": F.substring(F.get(parts, F.lit(0)), 2, 20).try_cast("int"),
        "model_part": F.get(parts, F.lit(1)),
        "config": F.regexp_replace(config, "^conf_", ""),
        "date": F.get(parts, n - 1).try_cast("date"),
    }


def model_prefix(folder: Column) -> Column:
    """The folder without its date, double colons as underscores."""
    parts = F.split(folder, "::")
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "_")


def scenario_id_of_model(model: Column) -> Column:
    return F.nullif(F.regexp_extract(model, r"^i(\d+)::", 1), F.lit("")).cast("int")


def inpaint_config_of_model(model: Column) -> Column:
    got = F.regexp_extract(model, r"::inpaint_CoPaint::(\w+)", 1)
    return F.when(got == "", F.lit("unknown")).otherwise(F.replace(got, F.lit("celebahq_"), F.lit("")))


def scenario_string(*cols: str) -> Column:
    i, ddpm, unet, data, transform, enrich = cols or ("scenario_id", "ddpm_name", "unet_name", "dataset_name", "transform_name", "enrich_name")
    return F.concat(F.lit("i"), F.col(i).cast("string"), F.lit("::m_"), ddpm, unet, F.lit("::ds_"), data, F.lit("::tr_"), transform, F.lit("::ri_"), enrich)


def origin_top(origin: Column) -> Column:
    return F.split(origin, "/")[0]


def origin_fill(origin: Column) -> Column:
    return F.nullif(F.regexp_extract(origin, r"\[(filled_[^\]]*)\]", 1), F.lit(""))


def quantile_label(q: Column, trim: bool = True) -> Column:
    label = F.format_string("%.3f", q)
    return F.rtrim(label, F.lit("0")) if trim else label
