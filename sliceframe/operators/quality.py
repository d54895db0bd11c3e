"""Rule sets: each rule is (code, severity, condition); codes keep the order of the rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sliceframe.functions.scalar import description_hint

#: Worst first.
SEVERITIES = ("BLOCKING", "INVALID", "CRITICAL", "WARNING", "INFO")


def apply_rules(df: DataFrame, rules: list[tuple[str, str, Column]], ok: str = "VALID") -> DataFrame:
    """Adds codes (array, in rule order) and status (the worst severity that applies, else ``ok``). One projection, no shuffle."""
    hit = [(code, sev, F.coalesce(cond, F.lit(False))) for code, sev, cond in rules]
    codes = F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, _, c in hit]))
    status = None
    for s in SEVERITIES:
        conds = [c for _, sev, c in hit if sev == s]
        if conds:
            any_ = conds[0]
            for c in conds[1:]:
                any_ = any_ | c
            status = F.when(any_, F.lit(s)) if status is None else status.when(any_, F.lit(s))
    return df.withColumn("codes", codes).withColumn("status", status.otherwise(F.lit(ok)) if status is not None else F.lit(ok))


def findings(one: DataFrame, checks: list[tuple[str, str, str, Column]]) -> DataFrame:
    """(code, severity) from a one-row table of counts; (code, severity if hit, severity else, condition)."""
    rows = [F.struct(F.lit(code).alias("code"), F.when(c, F.lit(hit)).otherwise(F.lit(other)).alias("severity")) for code, hit, other, c in checks]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def severity_tally(found: DataFrame, domain: tuple[str, ...] = ("CRITICAL", "WARNING", "INFO")) -> DataFrame:
    one = found.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in domain])
    return one.select(F.explode(F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s).alias("n")) for s in domain])).alias("r")).select("r.*")


def stage1_rules(min_slices: int = 4, max_cv: float = 0.15, max_tag: float = 0.25) -> list[tuple[str, str, Column]]:
    """Rules over a series row (see catalog.series_table) in the order of their messages."""
    c = F.col
    off = F.abs(c("median_gap") - c("spacing_tag")) / F.nullif(c("spacing_tag"), F.lit(0.0))
    return [
        ("empty_series", "INVALID", c("n_slices") == 0), ("unreadable", "INVALID", c("n_unreadable") > 0),
        ("missing_size", "WARNING", c("n_no_size") > 0), ("mixed_size", "INVALID", c("n_sizes") > 1),
        ("missing_spacing", "WARNING", c("n_no_spacing") > 0), ("mixed_spacing", "WARNING", (c("n_no_spacing") == 0) & (c("n_spacings") > 1)),
        ("missing_orientation", "WARNING", c("n_no_iop") > 0), ("mixed_orientation", "INVALID", (c("n_no_iop") == 0) & (c("iop_spread") > 1e-3)),
        ("missing_position", "WARNING", c("n_no_ipp") > 0), ("ordering_fallback", "WARNING", c("method") != "spatial"),
        ("duplicate_positions", "WARNING", c("n_dup") > 0), ("irregular_gaps", "WARNING", c("gap_cv") > max_cv), ("spacing_disagrees", "WARNING", off > max_tag),
        ("positions_unknown", "WARNING", c("n_no_position") > 0), ("few_slices", "WARNING", c("n_slices") < min_slices), ("plane_unknown", "WARNING", c("plane") == "unknown"),
        ("multi_frame", "WARNING", c("n_multiframe") > 0), ("mixed_transfer_syntax", "WARNING", c("n_syntaxes") > 1),
        ("description_disagrees", "WARNING", description_hint(c("series_description")).isNotNull() & (c("plane") != "unknown") & (description_hint(c("series_description")) != c("plane"))),
    ]



def stage1_sentences(min_slices: int = 4, max_cv: float = 0.15) -> dict[str, Column]:
    """A sentence for each code of ``stage1_rules``. Their forms are fixed values; of several values in a series all are named, in order."""
    c = F.col
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else F.coalesce(x.cast("string"), F.lit("None")) for x in parts])
    three = lambda x: F.format_string("%.3f", F.bround(x, 3))
    short = lambda x: F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", "")
    many = lambda name: F.array_join(F.transform(name, lambda x: x.cast("string")), ", ")
    return {
        "empty_series": say("empty series (no DICOM instances)"), "unreadable": say(c("n_unreadable"), " unreadable instance(s), e.g. ", c("first_error")),
        "missing_size": say("missing Rows/Columns on at least one instance"), "mixed_size": say("inconsistent dimensions rows={", many("all_rows"), "} columns={", many("all_columns"), "}"),
        "missing_spacing": say("missing PixelSpacing on at least one instance"), "mixed_spacing": say("inconsistent PixelSpacing values: {", F.array_join(F.transform("all_spacings", lambda x: F.concat(F.lit("("), F.array_join(F.transform(x, lambda y: y.cast("string")), ", "), F.lit(")"))), ", "), "}"),
        "missing_orientation": say("missing ImageOrientationPatient on at least one instance"), "mixed_orientation": say("inconsistent ImageOrientationPatient across slices"), "missing_position": say("missing ImagePositionPatient on at least one instance"),
        "ordering_fallback": say("slice order used fallback method=", c("method")), "duplicate_positions": say("duplicate or near-duplicate slice positions"), "irregular_gaps": say("unusual slice spacing variation CV=", three(c("gap_cv")), f" > {max_cv}"),
        "spacing_disagrees": say("SpacingBetweenSlices tag=", short(c("spacing_tag")), " disagrees with median position delta=", short(c("median_gap"))), "positions_unknown": say("could not compute slice positions for spacing checks"), "few_slices": say("few slices (", c("n_slices"), f" < {min_slices})"),
        "plane_unknown": say("anatomical plane unknown"), "multi_frame": say("multi-frame DICOM detected NumberOfFrames={", many("all_frames"), "} (not expanded in this milestone)"), "mixed_transfer_syntax": say("mixed transfer syntaxes in series: {", F.array_join("all_syntaxes", ", "), "}"),
        "description_disagrees": say("SeriesDescription plane hint disagrees with spatial plane"),
    }
