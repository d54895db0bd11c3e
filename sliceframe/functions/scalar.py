"""Scalar column functions: safe casts, hints, bounded maths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Plane names and the tokens that hint at them (fixed values).
PLANE_TOKENS = {"sagittal": ("SAG",), "coronal": ("COR",), "axial": ("AX", "TRA")}
#: Transfer syntaxes by class (fixed values).
UNCOMPRESSED = ("1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.1.99", "1.2.840.10008.1.2.2")
COMPRESSED_PREFIXES = ("1.2.840.10008.1.2.4.", "1.2.840.10008.1.2.5")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def parse_vector(c: Column, size: int | None = None, sep: str = ";") -> Column:
    """Text of numbers to array<double>; null if any part fails or the size differs."""
    v = F.transform(F.split(c, sep), lambda x: x.try_cast("double"))
    ok = F.forall(v, lambda x: x.isNotNull())
    if size is not None:
        ok = ok & (F.size(v) == size)
    return F.when(ok, v)


def saturating(x: Column) -> Column:
    return F.when(x > 0, x / (1 + x)).otherwise(F.lit(0.0))


def clip(x: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo, F.least(hi, x))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def description_hint(c: Column, tokens: dict[str, tuple[str, ...]] = PLANE_TOKENS) -> Column:
    """The one class whose token occurs in the text without blanks; null for none or several."""
    up = F.replace(F.upper(c), F.lit(" "), F.lit(""))
    hits = F.array_compact(F.array(*[F.when(sum((F.contains(up, F.lit(t)).cast("int") for t in ts), F.lit(0)) > 0, F.lit(k)) for k, ts in tokens.items()]))
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0)))


def transfer_syntax_class(c: Column) -> Column:
    out = F.when(c.isNull(), "unknown").when(c.isin(*UNCOMPRESSED), "uncompressed")
    for p in COMPRESSED_PREFIXES:
        out = out.when(F.startswith(c, F.lit(p)), "compressed")
    return out.otherwise("other")


def safe_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def general(x: Column, digits: int) -> Column:
    """A double as text of at most ``digits`` (up to 8) significant digits: plain from 0.0001 to below 10 to the power of ``digits``, else with an exponent.

    The rounded number decides which; ties are those of its shortest decimal text. Null stays null.
    """
    text = F.format_string(f"%.{digits - 1}e", x)
    mantissa = F.regexp_replace(F.substring_index(text, "e", 1), r"\.?0+$", "") if digits > 1 else F.substring_index(text, "e", 1)
    power = F.substring_index(text, "e", -1)
    plain = F.regexp_replace(text.cast(f"decimal(30, {digits + 4})").cast("string"), r"\.?0+$", "")
    shown = F.when(x == 0, mantissa).when(power.cast("int").between(-4, digits - 1), plain).otherwise(F.concat(mantissa, F.lit("e"), power))
    special = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    return F.when(x.isNotNull(), F.coalesce(special, shown))


def shown_vector(v: Column) -> Column:
    """Numbers of six digits between brackets."""
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: general(x, 6)), ", "), F.lit("]"))
