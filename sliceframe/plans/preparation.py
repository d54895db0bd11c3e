"""Stage 2: series with their geometry, candidate scores by slot, the choice with its reasons, and quality checks.

A series is one row from here on; a study has few, so what follows the one
aggregation by series is projections and a window by study and slot.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sliceframe.functions.scalar import clip, saturating
from sliceframe.functions.vector import plane_of
from sliceframe.operators.ordering import order_rows, slice_positions
from sliceframe.operators.selection import rank_candidates

GROUP = ["study_id", "series_id"]


def series_info(headers: DataFrame, attributes: DataFrame, *, epsilon: float = 1e-3, complete_tags: int = 6) -> DataFrame:
    """Headers (study_id, series_id, sop_uid, path, instance, iop, ipp, rows, columns, modality) and attributes
    (series_id, plane_csv, fluid) to a row a series.

    Normals must point the same way here, not only along the same line. Of the ``complete_tags`` tags only rows, columns and the normal can be found, so completeness stays at a half or less.
    """
    c = F.col
    placed = slice_positions(headers, GROUP, absolute=False)
    d = order_rows(placed, GROUP, c("position"), c("instance"), c("sop_uid"), stage=2)
    w = Window.partitionBy(*GROUP).orderBy("idx")
    d = d.withColumn("_gap", F.abs(c("position") - F.lag("position").over(w)))
    sizes = F.when(c("rows").isNotNull() & c("columns").isNotNull(), F.struct("rows", "columns"))
    first = lambda name: F.get(F.min_by(F.array(c(name)), c("idx")), F.lit(0))
    one = d.groupBy(*GROUP).agg(
        F.count("*").alias("n_slices"), F.first("method").alias("method"), F.min_by("normal", "idx").alias("_normal"), first("rows").alias("rows"), first("columns").alias("columns"), F.min("modality").alias("modality"),
        F.count_if(c("rows").isNull() | c("columns").isNull()).alias("n_no_size"), F.array_sort(F.collect_set(sizes)).alias("sizes"),
        F.count_if(c("_gap") < epsilon).alias("n_dup"), F.median("_gap").alias("median_gap"), F.when(F.avg("_gap") > 0, F.stddev_pop("_gap") / F.nullif(F.avg("_gap"), F.lit(0.0))).alias("gap_cv"),
    )
    spatial = c("method") == "spatial"
    normal = F.when(spatial, c("_normal"))
    present = sum((x.isNotNull().cast("int") for x in (c("rows"), c("columns"))), normal.isNotNull().cast("int"))
    done = one.withColumns({"plane": F.when(spatial, plane_of(c("_normal"))).otherwise("unknown"), "completeness": present / F.lit(complete_tags)}).drop("_normal")
    return done.join(attributes.select("series_id", "plane_csv", "fluid"), "series_id", "left")


def agrees() -> Column:
    """Whether the listed and the derived plane are the same; null if either is unknown."""
    return F.when(F.col("plane") != "unknown", F.lower("plane_csv") == F.col("plane"))


def components(*, min_slices: int = 3, max_cv: float = 0.15) -> dict[str, Column]:
    c = F.col
    apart = F.coalesce(~agrees(), F.lit(False))
    off = lambda cond, x: F.when(F.coalesce(cond, F.lit(False)), F.lit(x)).otherwise(F.lit(0.0))
    ready = (c("method") == "spatial") & (c("plane") != "unknown")
    steady = F.lit(1.0) - off(c("gap_cv") > max_cv, 0.5) - off(c("n_dup") > 0, 0.25) - off(apart, 0.25)
    consistency = F.when(ready, steady).when(apart, 0.25).otherwise(0.5)
    area = F.coalesce(c("rows"), F.lit(0)).cast("double") * F.coalesce(c("columns"), F.lit(0))
    bounded = lambda x: clip(x, F.lit(0.0), F.lit(1.0))
    parts = {"slices": saturating(F.greatest(c("n_slices") - min_slices, F.lit(0)) / F.lit(45.0)), "resolution": saturating(area / F.lit(512.0 * 512.0)), "completeness": bounded(c("completeness")), "consistency": bounded(consistency)}
    return {k: F.round(v, 6) for k, v in parts.items()}


def limits(config: Mapping) -> dict:
    """The settings that checks and components share."""
    return {"min_slices": config["min_slices_usable"], "max_cv": config["unusual_spacing_cv"]}


def preference(config: Mapping, slot: Column) -> Column:
    """Whether a slot wants fluid-sensitive series (1), others (0), or either (null)."""
    return F.try_element_at(F.create_map(*[x for p in config["planes"] for x in (F.lit(p), F.lit(config["fluid_preference"].get(p)).cast("int"))]), slot)


def scored(may: DataFrame, config: Mapping) -> DataFrame:
    """``may`` (series with a slot) with components, score and reasons."""
    weights = config["ranking_weights"]
    parts = may.withColumns({f"c_{k}": v for k, v in components(**limits(config)).items()} | {"preferred": preference(config, F.col("slot"))})
    match = F.when(F.col("preferred").isNotNull() & F.col("fluid").isNotNull(), (F.col("fluid") == F.col("preferred")).cast("double"))
    total = F.coalesce(match, F.lit(0.0)) * float(weights.get("fluid", 0.0))
    said = [F.when(match.isNotNull(), F.concat(F.lit("fluid_sensitive="), F.col("fluid").cast("string"), F.when(match == 1, F.lit(" == ")).otherwise(F.lit(" != ")), F.lit("preference "), F.col("preferred").cast("string")))]
    for k in ("slices", "resolution", "completeness", "consistency"):
        w = float(weights.get(k, 0.0))
        total = total + F.col(f"c_{k}") * w
        said.append(F.concat(F.lit(f"{k}="), F.format_string("%.3f", F.bround(f"c_{k}", 3)), F.lit(f" x w={w:g}")))
    return parts.withColumns({"score": F.round(total, 6), "reasons": F.array_compact(F.array(*said))})


def candidates(info: DataFrame, config: Mapping) -> DataFrame:
    """(study_id, slot, series_id, components, score, rnk, reasons): a row for each slot (plane of the settings) that a series may fill.

    The listed plane has the spelling of the slots and the derived one has not, so in effect the listed one decides.
    """
    may = info.withColumn("slot", F.explode(F.array(*map(F.lit, config["planes"])))).where((F.col("plane_csv") == F.col("slot")) | (F.col("plane") == F.col("slot")))
    done = scored(may, config)
    return rank_candidates(done, ["study_id", "slot"], "score", F.col("n_slices"), F.col("series_id"))


def selection_report(info: DataFrame, config: Mapping) -> DataFrame:
    """A row for each study and slot: the preference, the chosen series and its score, how many could be, and a note where none can."""
    every = info.select("study_id").distinct().withColumn("slot", F.explode(F.array(*map(F.lit, config["planes"]))))
    best = candidates(info, config).groupBy("study_id", "slot").agg(F.count("*").alias("n"), F.min_by(F.struct("series_id", "score"), "rnk").alias("best"))
    done = every.join(best, ["study_id", "slot"], "left")
    note = F.when(F.col("best").isNull(), F.concat(F.lit("no candidate series matches plane "), F.col("slot"))).otherwise("")
    return done.select("study_id", "slot", preference(config, F.col("slot")).alias("fluid_preference"), F.col("best.series_id").alias("series_id"), F.col("best.score").alias("score"), F.coalesce("n", F.lit(0)).alias("n_candidates"), note.alias("note"))


def best_candidates(info: DataFrame, config: Mapping, *kept: str) -> DataFrame:
    """A row for each study and slot: n_candidates and the first one by rank (series_id and the columns ``kept``), null where none can be.

    An aggregate, of which each task sends a row a study and slot, so that candidates are neither shuffled nor ranked among each other.
    """
    fits = (F.col("plane_csv") == F.col("slot")) | (F.col("plane") == F.col("slot"))
    every = scored(info.withColumn("slot", F.explode(F.array(*map(F.lit, config["planes"])))), config)
    key = F.when(F.coalesce(fits, F.lit(False)), F.struct((-F.col("score")).alias("score"), (-F.col("n_slices")).alias("n"), "series_id"))
    best = every.groupBy("study_id", "slot").agg(F.count(key).alias("n_candidates"), F.min_by(F.struct("series_id", *kept), key).alias("best"))
    return best.select("study_id", "slot", "n_candidates", *[F.col(f"best.{c}").alias(c) for c in ("series_id", *kept)])


class SeriesQCError(ValueError):
    """A series is not usable and the mode is strict."""


def with_unscanned(info: DataFrame, attributes: DataFrame) -> DataFrame:
    """``info`` and a row without slices for each listed series that no header names."""
    return info.unionByName(attributes.join(info.select("series_id"), "series_id", "left_anti").select("study_id", "series_id", "plane_csv", "fluid", F.lit(0).cast("long").alias("n_slices"), F.lit("unknown").alias("plane")), allowMissingColumns=True)


def issue_list(config: Mapping) -> Column:
    """The issues of a series in the order of the rules, as (severity, code, detail). One without slices has no other than that. Severities, codes and the forms of the details are fixed values."""
    c = F.col
    spatial = c("method") == "spatial"
    sizes = F.array_join(F.transform("sizes", lambda x: F.concat(F.lit("("), x["rows"].cast("string"), F.lit(", "), x["columns"].cast("string"), F.lit(")"))), ", ")
    rules = [
        ("WARNING", "unexpected_modality", c("modality").isNotNull() & (c("modality") != "MR"), F.concat(F.lit("Modality="), c("modality"))),
        ("BLOCKING", "insufficient_slices", c("n_slices") < config["min_slices_usable"], F.concat(c("n_slices").cast("string"), F.lit(f" slices < min {config['min_slices_usable']}"))),
        ("WARNING", "missing_geometry", c("method") != "spatial", F.concat(F.lit("ordering fell back to "), c("method"), F.lit("; no IPP+IOP ordering"))),
        ("WARNING", "duplicate_positions", spatial & (c("n_dup") > 0), F.concat(c("n_dup").cast("string"), F.lit(f" near-duplicate positions (eps={config['duplicate_position_epsilon_mm']} mm)"))),
        ("WARNING", "inconsistent_spacing", spatial & (c("gap_cv") > config["unusual_spacing_cv"]), F.concat(F.lit("gap CV="), F.format_string("%.3f", F.bround("gap_cv", 3)), F.lit(f" > {config['unusual_spacing_cv']}"))),
        ("WARNING", "inconsistent_dimensions", c("n_no_size") > 0, F.lit("some slices missing Rows/Columns")),
        ("BLOCKING", "inconsistent_dimensions", F.size("sizes") > 1, F.concat(F.lit("mixed matrix sizes within series: ["), sizes, F.lit("]"))),
        ("WARNING", "plane_mismatch", ~agrees(), F.concat(F.lit("CSV plane "), c("plane_csv"), F.lit(" disagrees with DICOM-derived plane "), c("plane"))),
        ("WARNING", "unusual_orientation", c("plane") == "unknown", F.lit("anatomical plane could not be derived from IOP")),
    ]
    kind = "struct<severity:string,code:string,detail:string>"
    row = lambda severity, code, detail: F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), detail.alias("detail"))
    some = F.array_compact(F.array(*[F.when(F.coalesce(hit, F.lit(False)), row(severity, code, detail)) for severity, code, hit, detail in rules]))
    none = F.array(row("BLOCKING", "empty_series", F.lit("series has no DICOM instances")))
    return F.when(F.coalesce("n_slices", F.lit(0)) == 0, none).otherwise(some).cast(f"array<{kind}>")


def checked(info: DataFrame, config: Mapping) -> DataFrame:
    """Series with their issues, the codes of those, and whether they are usable."""
    done = info.withColumn("issues", issue_list(config))
    return done.withColumns({"codes": F.col("issues.code"), "usable": ~F.exists("issues", lambda i: i["severity"] == "BLOCKING")})


def enforce(done: DataFrame, mode: str = "permissive") -> DataFrame:
    """Usable series; in strict mode one that is not raises."""
    if mode == "strict" and (bad := done.where(~F.col("usable")).select("series_id", "codes").orderBy("series_id").first()):
        raise SeriesQCError(f"series {bad[0]} failed strict checks: {', '.join(bad[1])}")
    return done.where("usable")


def pixel_issues(stats: DataFrame) -> DataFrame:
    """(path, n, n_finite, min, max) to (path, severity, code): empty or non-finite pixels block, constant ones warn."""
    bad = (F.col("n") == 0) | (F.col("n_finite") < F.col("n"))
    code = F.when(bad, "invalid_pixels").when(F.col("max") == F.col("min"), "constant_pixels")
    return stats.select("path", F.when(bad, "BLOCKING").otherwise("WARNING").alias("severity"), code.alias("code")).where("code is not null")
