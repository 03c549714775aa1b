"""Complete season frames: replication, missing places, week padding and peak scaling.

Frames are built from keys first: replication multiplies frame keys, draws choose donors among keys, and
values are joined once, at the end.  All draws are md5 hashes of a seed and keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import hashed, uniform
from ..functions.names import origin_top
from ..schemas import require_columns

REQUIRED = ["datasetH1", "datasetH2", "fluseason", "sample", "location_code", "season_week", "value", "week_enddate"]
KEY = ["datasetH1", "datasetH2", "fluseason", "sample"]
FILLS = ("error", "zeros", "random", "skip")


def validate_mix(obs: DataFrame, config: dict[str, dict], fill: str, scaling: DataFrame | None = None) -> None:
    """ValueError unless columns, sources, fill strategy, proportions and scaling agree."""
    require_columns(obs, REQUIRED)
    check_mix({r[0] for r in obs.select("datasetH1").distinct().collect()}, config, fill, scaling is not None and bool(scaling.head(1)))


def check_mix(have: set[str], config: dict[str, dict], fill: str, scaling: bool = False) -> None:
    """The same over the names of the sources, without a job."""
    if fill not in FILLS:
        raise ValueError(f"Unknown fill strategy: {fill}; one of {FILLS}")
    for name in config:
        if name not in have:
            raise ValueError(f"Config datasets not found in the observations: {name}")
    by = [("proportion" in c, "multiplier" in c) for c in config.values()]
    if any(p for p, _ in by) and any(m for _, m in by):
        raise ValueError("Cannot mix proportions and multipliers")
    if any(p for p, _ in by):
        if not all(p for p, _ in by) or len({c.get("total") for c in config.values()}) != 1:
            raise ValueError("All proportions need the same total")
    elif not all(m for _, m in by):
        raise ValueError("Each source needs a multiplier")
    if any(c.get("to_scale") for c in config.values()) and not scaling:
        raise ValueError("A scaling distribution is needed")


def frame_keys(obs: DataFrame) -> DataFrame:
    return obs.select(*KEY).distinct()


def base_frame_counts(obs: DataFrame) -> DataFrame:
    """Distinct (H2, season, sample) per H1."""
    return obs.groupBy("datasetH1").agg(F.countDistinct("datasetH2", "fluseason", "sample").alias("base"))


def proportional_multipliers(counts: DataFrame, config: dict[str, dict]) -> DataFrame:
    """max(1, round half-even of int(total * proportion) / base)."""
    want = F.create_map(*[F.lit(x) for k, c in config.items() for x in (k, int(c["total"] * c["proportion"]))])
    m = F.bround(F.element_at(want, F.col("datasetH1")) / F.col("base")).cast("int")
    return counts.where(F.col("datasetH1").isin(*config)).select("datasetH1", F.greatest(F.lit(1), m).alias("multiplier"))


def explicit_multipliers(counts: DataFrame, config: dict[str, dict]) -> DataFrame:
    given = F.create_map(*[F.lit(x) for k, c in config.items() for x in (k, int(c["multiplier"]))])
    return counts.where(F.col("datasetH1").isin(*config)).select("datasetH1", F.element_at(given, F.col("datasetH1")).alias("multiplier"))


def replicate_frames(keys: DataFrame, multipliers: DataFrame) -> DataFrame:
    """Frame keys with copy number, frame id and origin H1/H2/season/sample[_copyN]."""
    copies = keys.join(F.broadcast(multipliers), "datasetH1").withColumn("copy_num", F.explode(F.sequence(F.lit(0), F.col("multiplier") - 1)))
    origin = F.concat(F.concat_ws("/", *KEY), F.when(F.col("copy_num") > 0, F.concat(F.lit("_copy"), F.col("copy_num").cast("string"))).otherwise(F.lit("")))
    return copies.select(*KEY, "copy_num", origin.alias("origin")).withColumn("frame_id", F.col("origin"))


def find_missing_locations(frames: DataFrame, obs: DataFrame, axis: DataFrame) -> DataFrame:
    """(frame, location) of the axis that the frame's source lacks; computed on keys."""
    grid = frames.join(F.broadcast(axis.select("location_code")))
    return grid.join(obs.select(*KEY, "location_code").distinct(), [*KEY, "location_code"], "left_anti")


def missing_report(missing: DataFrame) -> DataFrame:
    """What ``fill_error`` would name: the missing places of each frame, in order."""
    return missing.groupBy("frame_id").agg(F.array_join(F.sort_array(F.collect_set("location_code")), ",").alias("places"), F.countDistinct("location_code").alias("n_missing"))


def fill_error(missing: DataFrame) -> None:
    first = missing.select("frame_id", "location_code").orderBy("frame_id", "location_code").limit(20).collect()
    if first:
        raise ValueError("Missing required locations: " + ", ".join(f"{r.frame_id}:{r.location_code}" for r in first))


def fill_skip(frames: DataFrame, missing: DataFrame) -> DataFrame:
    return frames.join(missing.select("frame_id").distinct(), "frame_id", "left_anti")


def fill_zeros(missing: DataFrame, obs: DataFrame) -> DataFrame:
    """53 weeks of 0.0 with the frame's first date."""
    first = obs.groupBy(*KEY).agg(F.min("week_enddate").alias("week_enddate"))
    return missing.join(first, KEY).select(
        "frame_id", "location_code", F.explode(F.sequence(F.lit(1), F.lit(53))).alias("season_week"), F.lit(0.0).alias("value"), "week_enddate", F.concat("origin", F.lit("[filled_zeros]")).alias("origin")
    )


def fill_lookup(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Donor keys: per (location, H1, year) the first (H2, sample); per (location, H1, year, sample) the first H2."""
    k = obs.select("location_code", *KEY).distinct()
    by_year = k.groupBy("location_code", "datasetH1", "fluseason").agg(F.min(F.struct("datasetH2", "sample")).alias("d")).select("location_code", "datasetH1", "fluseason", "d.datasetH2", "d.sample")
    by_sample = k.groupBy("location_code", "datasetH1", "fluseason", "sample").agg(F.min("datasetH2").alias("datasetH2"))
    return by_year, by_sample


def donor_directory(obs: DataFrame) -> DataFrame:
    """Donors by rank: ``pos`` from 0 among the years of a (place, H1), and among the samples of a (place, H1, year).

    ``year`` is null in the entries that rank years; ``n`` is the length of an entry's list.
    """
    by_year, by_sample = fill_lookup(obs)
    cols = ["location_code", "h1", "year", "pos", "n", "donor"]
    donor = F.struct("datasetH1", "datasetH2", "fluseason", "sample").alias("donor")
    years, samples = Window.partitionBy("location_code", "datasetH1"), Window.partitionBy("location_code", "datasetH1", "fluseason")
    ranked = lambda rows, w, order, year: rows.select("location_code", F.col("datasetH1").alias("h1"), year.alias("year"), (F.row_number().over(w.orderBy(order)) - 1).alias("pos"), F.count("*").over(w).alias("n"), donor).select(*cols)
    return ranked(by_year, years, "fluseason", F.lit(None).cast("int")).unionByName(ranked(by_sample, samples, "sample", F.col("fluseason").cast("int")))


def fill_random_donors(missing: DataFrame, obs: DataFrame, seed: int = 0) -> DataFrame:
    """For each missing (frame, location) the donor key and the note for its origin; null where there is none.

    Tier 1: same H1, another year; tier 2: same H1 and year, another sample; tier 3: the first other H1,
    any year.  The best tier that has a candidate is drawn from evenly: a hashed position in the donor
    directory, moved on by one from the frame's own entry, which is left out.  Each copy draws anew.  Every missing
    pair stays one row, with numbers only; the directory is looked up at the drawn position.
    """
    directory = donor_directory(obs)
    years, samples = directory.where("year IS NULL"), directory.where("year IS NOT NULL")
    m = missing.select("frame_id", "location_code", F.col("datasetH1").alias("h1"), F.col("fluseason").cast("int").alias("year"), F.col("sample").alias("smp"), "origin")
    head = years.where("pos = 0").select("location_code", "h1", "n")
    own_year = years.select("location_code", "h1", F.col("donor.fluseason").cast("int").alias("year"), F.col("pos").alias("at1"))
    n_samples = samples.where("pos = 0").select("location_code", "h1", "year", F.col("n").alias("n2"))
    own_sample = samples.select("location_code", "h1", "year", F.col("donor.sample").alias("smp"), F.col("pos").alias("at2"))
    place = Window.partitionBy("location_code").orderBy("h1")
    two = head.withColumn("r", F.row_number().over(place)).where("r <= 2").groupBy("location_code").agg(*[F.max(F.when(F.col("r") == r, F.col(c))).alias(f"{c}_{r}") for r in (1, 2) for c in ("h1", "n")])
    j = m.join(head.withColumnRenamed("n", "n1"), ["location_code", "h1"], "left").join(own_year, ["location_code", "h1", "year"], "left")
    j = j.join(n_samples, ["location_code", "h1", "year"], "left").join(own_sample, ["location_code", "h1", "year", "smp"], "left").join(two, "location_code", "left")
    # candidates of each tier: the list without the frame's own entry
    left1, left2 = (F.coalesce(F.col(n), F.lit(0)) - F.col(at).isNotNull().cast("long") for n, at in (("n1", "at1"), ("n2", "at2")))
    first_is_own = F.col("h1_1") == F.col("h1")
    other, left3 = F.when(first_is_own, F.col("h1_2")).otherwise(F.col("h1_1")), F.coalesce(F.when(first_is_own, F.col("n_2")).otherwise(F.col("n_1")), F.lit(0))
    tier = F.when(left1 > 0, 1).when(left2 > 0, 2).when(left3 > 0, 3)
    j = j.select("frame_id", "location_code", "origin", "h1", "year", "at1", "at2", other.alias("other"), tier.alias("tier"), F.floor(uniform(seed, "frame_id", "location_code") * F.when(tier == 1, left1).when(tier == 2, left2).otherwise(left3)).cast("int").alias("pick"))
    at = F.when(F.col("tier") == 1, F.col("at1")).when(F.col("tier") == 2, F.col("at2"))
    drawn = j.select(
        "frame_id", "location_code", "origin", "tier", F.when(F.col("tier") == 3, F.col("other")).otherwise(F.col("h1")).alias("h1"), F.when(F.col("tier") == 2, F.col("year")).alias("year"), (F.col("pick") + F.coalesce((F.col("pick") >= at).cast("int"), F.lit(0))).alias("pos")
    )
    d, x = directory.drop("n").alias("x"), drawn.alias("d")
    got = x.join(d, (F.col("d.location_code") == F.col("x.location_code")) & (F.col("d.h1") == F.col("x.h1")) & F.col("d.year").eqNullSafe(F.col("x.year")) & (F.col("d.pos") == F.col("x.pos")), "left")
    y = F.col("donor.fluseason").cast("string")
    # fixed values: the notes' wording
    note = F.when(F.col("tier") == 1, F.concat(F.lit("filled_same_location_year_"), y, F.lit("_sample_"), F.col("donor.sample")))
    note = note.when(F.col("tier") == 2, F.concat(F.lit("filled_same_location_sample_"), F.col("donor.sample"))).when(F.col("tier") == 3, F.concat(F.lit("filled_same_location_"), F.col("donor.datasetH1"), F.lit("_year_"), y))
    return got.select("d.frame_id", "d.location_code", "d.origin", "donor.*", note.alias("note"))


def fill_random(missing: DataFrame, obs: DataFrame, seed: int = 0) -> DataFrame:
    """Rows of the donors.  A pair that has no donor stops the job that needs it."""
    donors = fill_random_donors(missing, obs, seed)
    lost = F.raise_error(F.concat(F.lit("Missing required locations: "), F.col("frame_id"), F.lit(":"), F.col("location_code")))
    sure = donors.withColumn("datasetH1", F.when(F.col("datasetH1").isNull(), lost).otherwise(F.col("datasetH1")))
    rows = sure.join(obs.select(*KEY, "location_code", "season_week", "value", "week_enddate"), [*KEY, "location_code"])
    return rows.select("frame_id", "location_code", "season_week", "value", "week_enddate", F.concat("origin", F.lit("["), "note", F.lit("]")).alias("origin"))


def pad_weeks(rows: DataFrame, axis: DataFrame, carry: str = "last", weeks: int = 53) -> DataFrame:
    """Weeks 1 to 53 for every location of the axis: 0 outside the observed span; inside it a missing week takes
    the week before it if that was observed, else 0 (``ffill`` carries on through longer gaps).

    One aggregate a frame and place: its rows in order of week are merged with the weeks 1 to 53, each row being
    followed by the weeks of the gap after it.  An observed null counts as a missing week; rows outside 1 to 53 go;
    several rows of one week all stay.
    """
    rows = rows.join(F.broadcast(axis.select("location_code")), "location_code", "left_semi").where(F.col("season_week").between(1, weeks))
    cell = F.struct(F.col("season_week").cast("int").alias("w"), F.col("week_enddate").alias("d"), F.col("origin").alias("o"), F.col("value").cast("double").alias("v"))
    x = F.col("x")
    merged = rows.groupBy("frame_id", "location_code").agg(F.sort_array(F.collect_list(cell)).alias("x"))

    def pad(w: Column, value: Column) -> Column:
        return F.struct(w.cast("int").alias("w"), x[0]["d"].alias("d"), x[0]["o"].alias("o"), value.alias("v"))

    def gap(low: Column, high: Column, value) -> Column:
        """Padding for the weeks low to high, if there are any."""
        return F.when(low <= high, F.transform(F.sequence(low, high), lambda w: pad(w, value(w)))).otherwise(F.expr("array()").cast("array<struct<w:int,d:date,o:string,v:double>>"))

    def part(r: Column, i: Column) -> Column:
        after, before = F.get(x, i + 1), F.get(x, i - 1)
        if carry == "last":
            known = F.coalesce(r["v"], F.when(before["w"] == r["w"] - 1, before["v"]), F.lit(0.0))
            carried = lambda w: F.when(w == r["w"] + 1, F.coalesce(r["v"], F.lit(0.0))).otherwise(0.0)
        else:
            seen = F.filter(F.slice(x, 1, i + 1), lambda y: y["v"].isNotNull())
            known = F.coalesce(F.get(seen, F.size(seen) - 1)["v"], F.lit(0.0))
            carried = lambda w: known
        own = F.struct(r["w"].alias("w"), F.coalesce(r["d"], x[0]["d"]).alias("d"), F.coalesce(r["o"], x[0]["o"]).alias("o"), known.alias("v"))
        return F.concat(F.array(own), F.when(after.isNotNull(), gap(r["w"] + 1, after["w"] - 1, carried)).otherwise(gap(r["w"] + 1, F.lit(weeks), lambda w: F.lit(0.0))))

    cells = F.concat(gap(F.lit(1), x[0]["w"] - 1, lambda w: F.lit(0.0)), F.flatten(F.transform(x, part)))
    out = merged.select("frame_id", "location_code", F.inline(cells))
    return out.select("frame_id", "location_code", F.col("w").alias("season_week"), F.col("v").alias("value"), F.col("d").alias("week_enddate"), F.col("o").alias("origin"))


def frame_peaks(rows: DataFrame) -> DataFrame:
    weekly = rows.groupBy("frame_id", "season_week").agg(F.sum("value").alias("v"))
    return weekly.groupBy("frame_id").agg(F.max("v").alias("peak"))


#: Distinct values that splitters are chosen from, and splitters: only how evenly the ranking is spread depends on them.
SPLIT_SAMPLE, SPLITTERS = 4096, 256


def splitters(values: DataFrame, value: str, sample: int = SPLIT_SAMPLE, most: int = SPLITTERS) -> DataFrame:
    """One row with an ascending array ``splits``: every k-th of the distinct values with the least hashes.

    The choice depends on the values alone, so it is the same wherever and however often it is made.
    """
    few = values.select(F.col(value).alias("v")).distinct().orderBy(F.xxhash64("v"), "v").limit(sample)
    return few.agg(F.sort_array(F.collect_list("v")).alias("s")).select(F.expr(f"filter(s, (v, i) -> pmod(i, cast(ceil(size(s) / {most}) AS int)) = 0)").alias("splits"))


def order_index(rows: DataFrame, value: str, sample: int = SPLIT_SAMPLE, most: int = SPLITTERS) -> DataFrame:
    """Order statistics of a number, nulls left out: (value, ``low``, ``high``), the first and last rank, from 1, of each distinct value.

    Equal values are counted first; distinct ones are dealt between the splitters, ranked there, and moved on by
    the counts of the buckets before.  No window sees more than one bucket, or one row for each bucket.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    bucket = F.size(F.filter("splits", lambda s: s <= F.col(value))).alias("_bucket")
    dealt = counts.join(F.broadcast(splitters(counts, value, sample, most))).select(value, "_n", bucket)
    totals = dealt.groupBy("_bucket").agg(F.sum("_n").alias("_all"))
    totals = totals.select("_bucket", (F.sum("_all").over(Window.orderBy("_bucket")) - F.col("_all")).alias("_before"))
    within = F.sum("_n").over(Window.partitionBy("_bucket").orderBy(value))
    placed = dealt.withColumn("_high", within).join(totals, "_bucket")
    return placed.select(value, (F.col("_before") + F.col("_high") - F.col("_n") + 1).alias("low"), (F.col("_before") + F.col("_high")).alias("high"))


def season_peak_scale(rows: DataFrame, targets: DataFrame, seed: int = 0, keep_fill_origin: bool = False) -> DataFrame:
    """Scale each frame so that its national peak meets a target drawn from the distribution.

    ``targets`` (peak; nulls left out) has an index of order statistics, and a frame draws a rank.  The note goes on the
    frame's first origin for all its rows unless fill origins are kept.  Frames without a positive peak keep their values.
    """
    ranked = order_index(targets, "peak").select(F.explode(F.sequence(F.col("low") - 1, F.col("high") - 1)).alias("pick"), F.col("peak").alias("target"))
    n = targets.agg(F.count("peak").alias("n"))
    pick = F.floor(uniform(seed, "frame_id") * F.col("n")).cast("long")
    drawn = frame_peaks(rows).join(F.broadcast(n)).select("frame_id", "peak", pick.alias("pick")).join(ranked, "pick", "left")
    drawn = drawn.select("frame_id", "target", F.when(F.col("peak") > 0, F.col("target") / F.col("peak")).otherwise(1.0).alias("factor"))
    first = rows.groupBy("frame_id").agg(F.min_by("origin", F.struct("location_code", "season_week")).alias("top"))
    out = rows.join(drawn.join(first, "frame_id"), "frame_id")
    note = F.concat(F.lit("[scaled_to_"), F.format_string("%.1f", F.bround("target", 1)), F.lit("]"))
    return out.select("frame_id", "location_code", "season_week", (F.col("value") * F.col("factor")).alias("value"), "week_enddate", F.concat(F.col("origin" if keep_fill_origin else "top"), note).alias("origin"))


def build_frames(obs: DataFrame, axis: DataFrame, config: dict[str, dict], fill: str = "error", scaling: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """From observations to complete frames: frame_id, location, week, value, date, origin."""
    validate_mix(obs, config, fill, scaling)
    obs = obs.where(F.col("datasetH1").isin(*config)) if fill != "random" else obs
    counts = base_frame_counts(obs)
    proportional = any("proportion" in c for c in config.values())
    mult = proportional_multipliers(counts, config) if proportional else explicit_multipliers(counts, config)
    frames = replicate_frames(frame_keys(obs), mult)
    missing = find_missing_locations(frames, obs, axis)
    if fill == "error":
        fill_error(missing)
    if fill == "skip":
        frames = fill_skip(frames, missing)
    own = frames.join(obs.select(*KEY, "location_code", "season_week", "value", "week_enddate"), KEY).select("frame_id", "location_code", "season_week", "value", "week_enddate", "origin")
    if fill == "zeros":
        own = own.unionByName(fill_zeros(missing, obs))
    if fill == "random":
        own = own.unionByName(fill_random(missing, obs, seed))
    # both the padding and the scaling group by frame: one exchange serves them
    padded = pad_weeks(own.repartition("frame_id"), axis)
    scaled = [k for k, c in config.items() if c.get("to_scale")]
    if not scaled:
        return padded
    source = origin_top(F.col("frame_id"))
    return season_peak_scale(padded.where(source.isin(*scaled)), scaling, seed).unionByName(padded.where(~source.isin(*scaled)))


def check_frames(rows: DataFrame, axis: DataFrame) -> DataFrame:
    """Frames whose weeks are not exactly 1 to 53 or whose places are not exactly the axis."""
    n = axis.select("location_code").distinct().count()
    on_axis = rows.join(F.broadcast(axis.select("location_code").withColumn("_on", F.lit(True))), "location_code", "left")
    agg = on_axis.groupBy("frame_id").agg(F.count("*").alias("n"), F.countDistinct("season_week", "location_code").alias("cells"), F.min("season_week").alias("lo"), F.max("season_week").alias("hi"), F.count_if(F.col("_on").isNull()).alias("off"))
    return agg.where((F.col("n") != 53 * n) | (F.col("cells") != 53 * n) | (F.col("lo") != 1) | (F.col("hi") != 53) | (F.col("off") > 0))


def main_origin(rows: DataFrame) -> DataFrame:
    """A frame's most frequent origin; of equals the smallest."""
    n = rows.groupBy("frame_id", "origin").agg(F.count("*").alias("n"))
    return n.groupBy("frame_id").agg(F.min_by("origin", F.struct(-F.col("n"), "origin")).alias("main_origin"))


def origin_segments(mains: DataFrame, order: str = "frame_id", prefix: int = 12) -> DataFrame:
    """Runs of frames from the same top source: (segment, source, first, last, n).

    Frames are numbered within the first ``prefix`` characters of their order; only one row for each prefix
    meets in one window.
    """
    tops = mains.select(F.col(order).alias("o"), F.substring(order, 1, prefix).alias("p"), origin_top(F.col("main_origin")).alias("source"))
    own = Window.partitionBy("p").orderBy("o")
    rows = tops.withColumn("pos", F.row_number().over(own) - 1).withColumn("new", F.coalesce((F.col("source") != F.lag("source").over(own)).cast("int"), F.lit(0))).withColumn("seg", F.sum("new").over(own))
    part = rows.groupBy("p").agg(F.count("*").alias("m"), F.max("seg").alias("turns"), F.min_by("source", "pos").alias("head"), F.max_by("source", "pos").alias("tail"))
    w = Window.orderBy("p")
    turned = F.coalesce((F.col("head") != F.lag("tail").over(w)).cast("int"), F.lit(0))
    part = part.withColumn("turned", turned).select("p", (F.sum("m").over(w) - F.col("m")).cast("int").alias("before"), (F.sum("turned").over(w) + F.sum("turns").over(w) - F.col("turns")).alias("segs"))
    placed = rows.join(part, "p").select((F.col("seg") + F.col("segs")).alias("segment"), "source", (F.col("pos") + F.col("before")).alias("pos"))
    return placed.groupBy("segment", "source").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n"))


def sample_trajectories(obs: DataFrame, keys: list[str], n: int, seed: str = "sample") -> DataFrame:
    """Rows of n distinct samples per key, without replacement."""
    k = obs.select(*keys, "sample").distinct()
    w = Window.partitionBy(*keys).orderBy(hashed(seed, *keys, "sample"), "sample")
    return obs.join(k.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r"), [*keys, "sample"], "left_semi")


def min_locations_filter(obs: DataFrame, keys: list[str], n: int) -> DataFrame:
    have = obs.groupBy(*keys).agg(F.countDistinct("location_code").alias("_n")).where(F.col("_n") >= n)
    return obs.join(have.select(*keys), keys, "left_semi")


def dataset_catalog(obs: DataFrame) -> DataFrame:
    """Rows, seasons, samples and frames per (H1, H2) and per H1, by grouping sets."""
    agg = obs.rollup("datasetH1", "datasetH2").agg(F.count("*").alias("n_rows"), F.countDistinct("fluseason").alias("n_seasons"), F.countDistinct("sample").alias("n_samples"), F.countDistinct("datasetH2").alias("n_h2"))
    return agg.where("datasetH1 IS NOT NULL").withColumn("n_frames", F.col("n_seasons") * F.col("n_samples"))


def national_weekly(obs: DataFrame) -> DataFrame:
    return obs.groupBy(*KEY, "season_week").agg(F.sum("value").alias("value"))


def season_peaks(obs: DataFrame) -> DataFrame:
    return national_weekly(obs).groupBy(*KEY).agg(F.max("value").alias("peak"))


def scaling_distribution(obs: DataFrame, source: str) -> DataFrame:
    return season_peaks(obs.where(F.col("datasetH1") == source)).select("peak")


def trajectory_stats(obs: DataFrame) -> DataFrame:
    per = obs.groupBy("datasetH2", "sample").agg(F.countDistinct("season_week").alias("w"))
    means = per.groupBy("datasetH2").agg(F.count("*").alias("n_trajectories"), F.avg("w").alias("mean_weeks"))
    dims = obs.groupBy("datasetH2").agg(F.countDistinct("location_code").alias("n_locations"), F.countDistinct("week_enddate").alias("n_dates"))
    return means.join(dims, "datasetH2")


