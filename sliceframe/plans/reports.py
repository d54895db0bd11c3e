"""Reports as one aggregate each, in nested columns that ``write_report`` writes as JSON."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sliceframe.functions.scalar import safe_ratio
from sliceframe.functions.vector import AXES, dot, slice_normal
from sliceframe.operators.ordering import average_rank

#: Patterns that hint at a report's language (fixed values); they overlap and are no identification.
MARKERS = {"spanish": r"(?iu)rodilla|hallazgos|t[e\u00e9]cnica", "german": r"(?iu)knie|links|rechts", "english": r"(?iu)knee|findings|impression"}
TOP = 8


def label_report(df: DataFrame, labels: list[str], text: str, *, markers: dict[str, str] = MARKERS, top: int = TOP) -> DataFrame:
    """One row with the whole label report, from a single pass over the rows.

    Counts of studies; by label its counts, prevalence and the values it takes; joint positives and Jaccard of every
    pair, the ``top`` pairs; how many positives labelled studies have; lengths and language markers of the texts. All
    aggregates have the size of the labels, their few values and the lengths that occur. Null and NaN are unlabelled.
    """
    y = {a: F.nanvl(F.col(f"`{a}`").cast("double"), F.lit(None).cast("double")) for a in labels}
    on = {a: F.coalesce(c > 0, F.lit(False)) for a, c in y.items()}
    some = F.coalesce(*y.values()).isNotNull()
    positives = sum((c.cast("int") for c in on.values()), F.lit(0))
    t = F.col(f"`{text}`")
    pairs = list(combinations(range(len(labels)), 2))
    one = df.agg(
        F.count("*").alias("n_studies"), F.count_if(some).alias("n_labeled"), *[F.count(c).alias(f"l{i}") for i, c in enumerate(y.values())], *[F.count_if(c).alias(f"p{i}") for i, c in enumerate(on.values())],
        *[F.count_if(c == 0).alias(f"z{i}") for i, c in enumerate(y.values())], *[F.array_sort(F.collect_set(c)).alias(f"v{i}") for i, c in enumerate(y.values())], *[F.count_if(on[labels[i]] & on[labels[j]]).alias(f"j{i}_{j}") for i, j in pairs],
        *[F.count_if(some & (positives == k)).alias(f"k{k}") for k in range(len(labels) + 1)], F.count(t).alias("n_texts"), F.min(F.char_length(t)).alias("shortest"), F.median(F.char_length(t)).alias("median"), F.max(F.char_length(t)).alias("longest"),
        *[F.count_if(t.rlike(p)).alias(f"m_{k}") for k, p in markers.items()],
    )
    c = F.col
    each = F.array(*[F.struct(F.lit(a).alias("label"), c("n_studies").alias("total"), c(f"l{i}").alias("labeled"), c(f"p{i}").alias("positive"), c(f"z{i}").alias("negative"), (c("n_studies") - c(f"l{i}")).alias("missing"), safe_ratio(c(f"p{i}"), c(f"l{i}")).alias("prevalence"), F.filter(f"v{i}", lambda x: x > 0).alias("positive_values"), c(f"v{i}").alias("values")) for i, a in enumerate(labels)])
    both = F.array(*[F.struct(F.lit(labels[i]).alias("a"), F.lit(labels[j]).alias("b"), c(f"j{i}_{j}").alias("joint"), safe_ratio(c(f"j{i}_{j}"), c(f"p{i}") + c(f"p{j}") - c(f"j{i}_{j}")).alias("jaccard"), F.lit(k).alias("place")) for k, (i, j) in enumerate(pairs)])
    by = lambda *keys: lambda x, z: _order(keys, x, z)
    first = F.slice(F.array_sort("pairs", by("jaccard", "place")), 1, top)
    rank = F.array_sort(F.transform("labels", lambda x, i: F.struct(x["prevalence"].alias("prevalence"), x["label"].alias("label"), x["positive"].alias("positive"), i.alias("place"))), by("prevalence", "place"))
    counts = F.filter(F.array(*[F.struct(F.lit(k).alias("positives"), c(f"k{k}").alias("studies")) for k in range(len(labels) + 1)]), lambda x: x["studies"] > 0)
    texts = F.struct(c("n_texts").alias("non_null"), F.struct(c("shortest").alias("min"), c("median"), c("longest").alias("max")).alias("length_chars"), F.struct(*[c(f"m_{k}").alias(k) for k in markers]).alias("language_markers"))
    done = one.withColumns({"labels": each, "pairs": both})
    return done.select(
        "n_studies", "n_labeled", (c("n_studies") - c("n_labeled")).alias("n_unlabeled"), "labels", F.filter("pairs", lambda x: x["joint"] > 0).alias("joint_positives"), first.alias("top_pairs"), counts.alias("positives_per_study"), texts.alias("texts"), rank.alias("by_prevalence"),
    )


def _order(keys: tuple[str, str], x: Column, z: Column) -> Column:
    """Largest first, null last, ties by place."""
    value, place = keys
    a, b = F.coalesce(x[value], F.lit(-1.0)), F.coalesce(z[value], F.lit(-1.0))
    return F.when(a > b, -1).when(a < b, 1).when(x[place] < z[place], -1).when(x[place] > z[place], 1).otherwise(0)


def figures(report: DataFrame) -> DataFrame:
    """The label report in long form: (part, name, place, value)."""
    c = F.col
    row = lambda part, name, value, place=None: F.struct(F.lit(part).alias("part"), name.cast("string").alias("name"), (F.lit(0) if place is None else place).cast("int").alias("place"), value.cast("double").alias("value"))
    single = [row("studies", F.lit(k), c(k)) for k in ("n_studies", "n_labeled", "n_unlabeled")]
    single += [row("texts", F.lit("non_null"), c("texts.non_null")), *[row("length", F.lit(k), c(f"texts.length_chars.{k}")) for k in ("min", "median", "max")]]
    marks = [row("markers", F.lit(f.name), c(f"texts.language_markers.{f.name}")) for f in report.schema["texts"].dataType["language_markers"].dataType.fields]
    of_label = lambda k: F.transform("labels", lambda x: row(k, x["label"], x[k]))
    many = [of_label(k) for k in ("labeled", "positive", "negative", "missing", "prevalence")]
    many.append(F.flatten(F.transform("labels", lambda x: F.transform(x["values"], lambda v, i: row("values", x["label"], v, i)))))
    many.append(F.transform("joint_positives", lambda x: row("joint", F.concat_ws(" | ", x["a"], x["b"]), x["joint"])))
    many.append(F.transform("top_pairs", lambda x, i: row("top", F.concat_ws(" | ", x["a"], x["b"]), x["jaccard"], i)))
    many.append(F.transform("positives_per_study", lambda x: row("positives", x["positives"], x["studies"])))
    many.append(F.transform("by_prevalence", lambda x, i: row("rank", x["label"], x["prevalence"], i)))
    return report.select(F.inline(F.concat(F.array(*single, *marks), *many)))


def orientation_details(headers: DataFrame, attributes: DataFrame, *, min_alignment: float = 0.8, min_separation: float = 0.2) -> DataFrame:
    """A row a series: the mean of its slices' normals, how far they stray from it, the plane it gives (null without a usable normal) and the listed one."""
    c, w = F.col, Window.partitionBy("series_id")
    parts = ["x", "y", "z"]
    d = headers.select("series_id", "path", slice_normal(c("iop")).alias("normal")).withColumns({k: F.get("normal", F.lit(i)) for i, k in enumerate(parts)})
    stray = sum(((c(k) - F.avg(k).over(w)) * (c(k) - F.avg(k).over(w)) for k in parts), F.lit(0.0))
    one = d.withColumn("stray", F.sqrt(stray)).groupBy("series_id").agg(F.count("*").alias("n_slices"), F.count("normal").alias("n_usable"), F.max("stray").alias("spread"), *[F.avg(k).alias(k) for k in parts], F.min_by("normal", "path").alias("first"))
    size = F.sqrt(sum((c(k) * c(k) for k in parts), F.lit(0.0)))
    mean = F.when(size > 1e-8, F.array(*[c(k) / size for k in parts]))
    done = one.withColumn("normal", mean).withColumn("ranked", F.sort_array(F.transform("normal", lambda x: F.abs(x)), asc=False))
    best, second = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))
    at = F.array_position(F.transform("normal", lambda x: F.abs(x)), best)
    axis = F.when(at == 1, AXES[0]).when(at == 2, AXES[1]).when(at == 3, AXES[2])
    clear = F.coalesce((best >= min_alignment) & (best - second >= min_separation), F.lit(False))
    plane = F.when(c("n_usable") > 0, F.when(clear, axis).otherwise("unknown"))
    reason = F.when(plane.isNull(), "no usable IOP").when(plane == "unknown", "oblique or ambiguous normal")
    listed = attributes.select("series_id", "plane_csv")
    return done.select("series_id", "n_slices", "n_usable", "normal", "spread", axis.alias("dominant_axis"), best.alias("alignment"), (best - second).alias("separation"), plane.alias("derived_plane"), reason.alias("reason"), F.transform("first", lambda x: F.signum(x).cast("int")).alias("signs")).join(listed, "series_id", "left")


def orientation_summary(details: DataFrame) -> DataFrame:
    """One row: agreement of listed and derived planes over all and by plane, disagreements, unknown planes, constancy of normals, signs of the first ones."""
    c = F.col
    both = c("derived_plane").isNotNull() & c("plane_csv").isNotNull()
    same = F.coalesce(both & (F.lower("plane_csv") == c("derived_plane")), F.lit(False))
    planes = [p for p in ("Sagittal", "Coronal", "Axial")]
    signs = details.where("signs is not null").groupBy("signs").agg(F.count("*").alias("n_series")).agg(F.array_sort(F.collect_list(F.struct("signs", "n_series"))).alias("signs"))
    one = details.agg(
        F.count("*").alias("n_series"), F.count("derived_plane").alias("n_derivable"), safe_ratio(F.count_if(same), F.count_if(both)).alias("agreement"),
        F.array(*[F.struct(F.lit(p).alias("plane"), F.count_if(both & (c("plane_csv") == p)).alias("n"), F.count_if(same & (c("plane_csv") == p)).alias("agree")) for p in planes]).alias("by_plane"),
        F.count_if(both & ~same).alias("n_confusions"), F.count_if(c("derived_plane") == "unknown").alias("n_unknown"), safe_ratio(F.count_if(c("spread") < 1e-6), F.count("spread")).alias("constant_rate"),
    )
    return one.join(signs, F.lit(True), "left")


def ordering_details(headers: DataFrame, *, epsilon: float = 1e-3) -> DataFrame:
    """A row a series: its instance numbers, its gaps, and the rank correlation of number and position where every slice has one along its own normal."""
    c, w = F.col, Window.partitionBy("series_id")
    d = headers.select("series_id", "path", "instance", slice_normal(c("iop")).alias("normal"), "ipp").withColumn("pos", F.when(F.size("ipp") == 3, dot(c("normal"), c("ipp"))))
    d = d.withColumns({"ref": F.first("normal", ignorenulls=True).over(w.orderBy("path").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "gap": c("pos") - F.lag("pos").over(w.orderBy("pos"))})
    d = d.withColumns({"ri": F.when(c("instance").isNotNull(), average_rank(["series_id"], c("instance")) - F.count_if(c("instance").isNull()).over(w)), "rp": average_rank(["series_id"], c("pos"))})
    n = F.count("instance")
    contiguous = F.when(n > 0, (F.min("instance") == 1) & (F.max("instance") == n) & (F.count_distinct("instance") == n))
    both = c("ri").isNotNull()
    sx, sy = F.stddev_pop(F.when(both, c("ri"))), F.stddev_pop(F.when(both, c("rp")))
    one = d.groupBy("series_id").agg(
        F.count("*").alias("n_slices"), (F.count_distinct("instance") == n).alias("unique"), F.count_if(c("instance").isNull()).alias("n_missing"), contiguous.alias("contiguous"), F.count("pos").alias("n_spatial"), F.min(dot(c("normal"), c("ref"))).alias("worst"),
        (F.max("pos") - F.min("pos")).alias("span"), F.median("gap").alias("median_gap"), F.when(F.avg("gap") > 0, F.stddev_pop("gap") / F.avg("gap")).alias("gap_cv"), F.count_if(c("gap") < epsilon).alias("n_dup"), F.when((sx > 0) & (sy > 0), F.covar_pop(F.when(both, c("ri")), F.when(both, c("rp"))) / (sx * sy)).alias("rho"))
    full = (c("n_spatial") == c("n_slices")) & (c("n_slices") >= 2)
    rho = F.round("rho", 4)
    return one.select(
        "series_id", "n_slices", "unique", "n_missing", "contiguous", "n_spatial", F.when(full, c("worst") > 0.99).alias("consistent"), *[F.when(full, F.round(k, 4)).alias(k) for k in ("span", "median_gap", "gap_cv")], F.when(full, c("n_dup")).alias("n_dup"),
        F.when(full, rho).alias("rho"), F.when(full, F.when(c("rho") > 0, "increasing").when(c("rho") <= 0, "decreasing")).alias("direction"))


def ordering_summary(details: DataFrame) -> DataFrame:
    """One row: how many series are fully spatial, rates of unique and contiguous numbers, the correlations' distribution and directions, the worst gaps."""
    c = F.col
    return details.agg(
        F.count("*").alias("n_series"), F.count_if(c("n_spatial") == c("n_slices")).alias("n_spatial"), safe_ratio(F.count_if("unique"), F.count("*")).alias("unique_rate"), F.sum("n_missing").alias("n_missing"), safe_ratio(F.count_if(F.coalesce("contiguous", F.lit(False))), F.count("*")).alias("contiguous_rate"),
        F.count("rho").alias("n_rho"), F.avg("rho").alias("mean_rho"), F.stddev_pop("rho").alias("std_rho"), F.min("rho").alias("min_rho"), F.max("rho").alias("max_rho"), safe_ratio(F.count_if(F.abs("rho") >= 0.999), F.count("rho")).alias("monotone_rate"),
        F.count_if(c("direction") == "increasing").alias("n_increasing"), F.count_if(c("direction") == "decreasing").alias("n_decreasing"), F.max("gap_cv").alias("max_gap_cv"), F.count_if(c("n_dup") > 0).alias("n_with_duplicates"))


def layout(paths: DataFrame, listed: DataFrame, path: str = "path", *, level: int = 0) -> DataFrame:
    """One row: whether the folders at ``level`` are named by series or by study, by how many of them each column of ``listed`` names; a draw is for series."""
    folder = F.get(F.split(F.replace(F.col(path), F.lit("\\"), F.lit("/")), "/"), F.lit(level))
    folders = paths.select(folder.alias("folder")).where("folder is not null").distinct()
    named = lambda k: listed.select(F.col(k).alias("folder")).where("folder is not null").distinct().withColumn(f"by_{k}", F.lit(1))
    both = reduce(lambda d, k: d.join(named(k), "folder", "left"), ("series_id", "study_id"), folders)
    one = both.agg(F.count("*").alias("n_folders"), F.count("by_series_id").alias("n_series"), F.count("by_study_id").alias("n_studies"))
    return one.withColumn("keyed_by", F.when(F.col("n_series") >= F.col("n_studies"), "series").otherwise("study"))


def counted(df: DataFrame, part: str, *columns: str, name: Callable | None = None) -> DataFrame:
    """(part, name, value): how often each combination of values occurs, nulls as such."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])
    return df.groupBy(*columns).agg(F.count("*").cast("double").alias("value")).select(F.lit(part).alias("part"), text.alias("name"), "value")


def structure_figures(headers: DataFrame, listed: DataFrame, others: DataFrame) -> DataFrame:
    """(part, name, value): the structure of a collection.

    ``headers`` are the files found, ``listed`` and ``others`` the series of two tables (study_id, series_id, plane_csv,
    fluid) that should share nothing. Distributions of series a study and slices a series, planes and flags, matrix
    sizes, missing values, duplicates, series and studies on one side only, mapping, partial studies, folder layout.
    """
    c = F.col
    per_study, per_series = listed.groupBy("study_id").agg(F.count("*").alias("k")), headers.groupBy("series_id").agg(F.count("*").alias("k"), F.min("study_id").alias("study_id"))
    figure = lambda d, part, **values: d.agg(*[v.cast("double").alias(k) for k, v in values.items()]).select(F.inline(F.array(*[F.struct(F.lit(part).alias("part"), F.lit(k).alias("name"), c(k).alias("value")) for k in values])))
    shape = {"mean": F.avg("k"), "std": F.stddev_pop("k"), "min": F.min("k"), "median": F.median("k"), "max": F.max("k")}
    kinds = lambda d, k: d.select(k).where(c(k).isNotNull()).distinct()
    only = lambda a, b, k, name: figure(kinds(a, k).join(kinds(b, k), k, "left_anti"), "one_side", **{name: F.count("*")})
    again = lambda d, name, *k: figure(d.groupBy(*k).agg(F.count("*").alias("k")), "duplicates", **{name: F.coalesce(F.sum(c("k") - 1), F.lit(0))})
    both = per_series.join(listed.select("series_id", c("study_id").alias("own")).distinct(), "series_id")
    sides = listed.groupBy("study_id").agg(F.count_distinct("series_id").alias("a")).join(headers.groupBy("study_id").agg(F.count_distinct("series_id").alias("b")), "study_id")
    place = layout(headers, listed)
    return reduce(DataFrame.unionByName, [
        figure(listed, "listed", rows=F.count("*"), series=F.count_distinct("series_id"), studies=F.count_distinct("study_id")), figure(headers, "found", files=F.count("*"), series=F.count_distinct("series_id"), studies=F.count_distinct("study_id"), without_key=F.count_if(c("series_id").isNull() | c("study_id").isNull())),
        figure(per_study, "series_per_study", **shape), counted(per_study, "series_per_study_n", "k"), figure(per_series, "slices_per_series", **shape), counted(per_series, "slices_per_series_n", "k"),
        counted(listed, "planes", "plane_csv"), counted(listed, "flags", "plane_csv", "fluid"), counted(headers.where("rows is not null and columns is not null"), "sizes", "rows", "columns"), figure(headers, "sizes", non_square=F.count_if(c("rows") != c("columns"))),
        figure(listed, "missing", **{k: F.count_if(c(k).isNull()) for k in ("study_id", "series_id", "plane_csv", "fluid")}), again(listed, "series", "series_id"), again(listed, "pairs", "study_id", "series_id"), again(headers, "sop", "sop_uid"),
        only(headers, listed, "series_id", "found_series"), only(listed, headers, "series_id", "listed_series"), only(headers, listed, "study_id", "found_studies"), only(listed, headers, "study_id", "listed_studies"),
        figure(kinds(listed, "series_id").join(kinds(others, "series_id"), "series_id"), "overlap", series=F.count("*")), figure(kinds(listed, "study_id").join(kinds(others, "study_id"), "study_id"), "overlap", studies=F.count("*")),
        figure(both, "mapping", matching=F.count_if(c("own") == c("study_id")), moved=F.count_if(c("own") != c("study_id"))), figure(sides, "partial", studies=F.count_if(c("a") != c("b"))),
        place.select(F.lit("layout").alias("part"), c("keyed_by").alias("name"), c("n_folders").cast("double").alias("value")),
    ])
