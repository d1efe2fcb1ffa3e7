"""Value expressions: dates, numbers, booleans, options, by target vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from attestary import fixed
from attestary.functions.text import strip

# What Python's float() reads, minus spellings no document holds (1_000, nan, inf).
_FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_DMY = r"^([0-9]{1,2})[./-]([0-9]{1,2})[./-]([0-9]{4})$"
_YMD = r"^([0-9]{4})[./-]([0-9]{1,2})[./-]([0-9]{1,2})$"


# --- dates ----------------------------------------------------------------------------------

def date_variants(c: Column) -> Column:
    """The four spellings of a D.M.Y or Y-M-D date; an empty array for anything else."""
    v = strip(c)
    dmy, ymd = v.rlike(_DMY), v.rlike(_YMD)
    day = F.when(dmy, F.regexp_extract(v, _DMY, 1)).when(ymd, F.regexp_extract(v, _YMD, 3))
    month = F.when(dmy, F.regexp_extract(v, _DMY, 2)).when(ymd, F.regexp_extract(v, _YMD, 2))
    year = F.when(dmy, F.regexp_extract(v, _DMY, 3)).when(ymd, F.regexp_extract(v, _YMD, 1))
    d, m = day.cast("int"), month.cast("int")
    name = F.try_element_at(F.array(*[F.lit(x) for x in fixed.MONTHS]), F.greatest(m, F.lit(1)))
    dd, mm = F.lpad(d.cast("string"), 2, "0"), F.lpad(m.cast("string"), 2, "0")
    ds, ms = d.cast("string"), m.cast("string")
    spelled = F.array(
        F.concat_ws(".", dd, mm, year), F.concat_ws(".", ds, ms, year),
        F.concat_ws(" ", ds, name, year), F.concat_ws(" ", dd, name, year))
    return F.when(m.between(1, 12) & d.between(1, 31), spelled) \
        .otherwise(F.array().cast("array<string>"))


def conv_date(c: Column) -> Column:
    """Day and month padded for day-first dates; a year-first date only gets dots."""
    v = strip(c)
    # one separator throughout, as three patterns
    day_first = r"^([0-9]{1,2})([./-])([0-9]{1,2})\2([0-9]{4})$"
    year_first = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})$"
    return F.when(v.rlike(day_first), F.concat_ws(
        ".", F.lpad(F.regexp_extract(v, day_first, 1), 2, "0"),
        F.lpad(F.regexp_extract(v, day_first, 3), 2, "0"), F.regexp_extract(v, day_first, 4))) \
        .when(v.rlike(year_first), F.regexp_replace(v, "-", ".")) \
        .otherwise(F.coalesce(v, F.lit("")))


# --- numbers --------------------------------------------------------------------------------

def _as_double(text: Column) -> Column:
    text = strip(text)
    return F.when(text.rlike(_FLOAT), text.try_cast("double"))


def _number_text(x: Column) -> Column:
    """Integral numbers without decimals, others in plain decimal notation."""
    plain = F.regexp_replace(
        x.cast("string").try_cast("decimal(38,16)").cast("string"), "0+$", "")
    return F.when(x == F.floor(x), x.try_cast("decimal(38,0)").cast("string")).otherwise(plain)


def conv_number(c: Column) -> Column:
    v = strip(c)
    whole = _as_double(F.replace(v, F.lit(","), F.lit(".")))
    digits = _as_double(F.replace(F.regexp_replace(v, r"[^0-9.,]", ""), F.lit(","), F.lit(".")))
    return F.coalesce(_number_text(whole), _number_text(digits), v, F.lit(""))


def conv_percent(c: Column) -> Column:
    v = strip(F.replace(strip(c), F.lit("%"), F.lit("")))
    x = _as_double(F.replace(v, F.lit(","), F.lit(".")))
    return F.coalesce(F.rint(x).cast("bigint").cast("string"), v, F.lit(""))


def norm_percent(c: Column) -> Column:
    found = F.regexp_extract(F.replace(c, F.lit("%"), F.lit("")), r"[0-9]+(?:[.,][0-9]+)?", 0)
    return F.when(F.length(found) > 0, F.replace(found, F.lit(","), F.lit("."))).otherwise(c)


# --- sex and options ------------------------------------------------------------------------

def norm_sex(c: Column) -> Column:
    v = F.upper(strip(c))
    return F.when(v.isin(fixed.SEX_MALE) | v.startswith("M"), "M") \
        .when(v.isin(fixed.SEX_FEMALE) | v.startswith("F"), "F") \
        .otherwise(c)


def norm_field_value(value: Column, kind: Column) -> Column:
    return F.when((F.length(value) > 0) & (kind == "sex"), norm_sex(value)) \
        .when((F.length(value) > 0) & (kind == "percent"), norm_percent(value)) \
        .otherwise(value)


def _casefold(c: Column) -> Column:
    return F.replace(F.lower(strip(c)), F.lit("ß"), F.lit("ss"))


def resolve_option(value: Column, options: Column, values: Column) -> Column:
    """Label to export value; unknown labels and unpaired arrays leave the value alone."""
    at = F.array_position(F.transform(options, lambda o: _casefold(o)), _casefold(value))
    paired = (F.size(options) > 0) & (F.size(options) == F.size(values))
    return F.when(paired & (at > 0), F.try_element_at(values, at.cast("int"))).otherwise(value)


# --- booleans, one function per target vocabulary -------------------------------------------

def _truthy(c: Column, true_words: list[str]) -> Column:
    return F.coalesce(F.lower(strip(c)).isin(true_words), F.lit(False))


def to_oui_non(c: Column) -> Column:
    return F.when(_truthy(c, fixed.TRUE_LIBRARY), "oui").otherwise("non")


def to_on_off(c: Column) -> Column:
    return F.when(_truthy(c, fixed.TRUE_LIBRARY), "On").otherwise("Off")


def to_on_off_xfa(c: Column) -> Column:
    return F.when(_truthy(c, fixed.TRUE_XFA_CHECKBOX), "On").otherwise("Off")


def to_widget_state(c: Column, on_state: Column) -> Column:
    return F.when(_truthy(c, fixed.TRUE_WIDGET), on_state).otherwise("Off")


def xfa_text(c: Column, kind: Column) -> Column:
    as_int = F.when(strip(c).rlike(r"^[+-]?[0-9]+$"),
                    strip(c).try_cast("decimal(38,0)").cast("string"))
    return F.when(c.isNull(), "") \
        .when(kind == "bool", F.when(c.isin("1", "true", "True"), "1").otherwise("0")) \
        .when(kind == "int", F.coalesce(as_int, c)) \
        .otherwise(c)


def convert(value: Column, kind: Column) -> Column:
    k = F.lower(kind)
    return F.when(value.isNull(), "") \
        .when(k.isin("bool", "boolean", "checkbox"), to_oui_non(value)) \
        .when(k == "date", conv_date(value)) \
        .when(k.isin("int", "integer", "number"), conv_number(value)) \
        .when(k == "percent", conv_percent(value)) \
        .otherwise(strip(value))


# --- evaluation, display --------------------------------------------------------------------

def eval_norm(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)), F.lit(""))


def format_duration(seconds: Column) -> Column:
    """mm:ss, or h:mm:ss from one hour on; a dash for NULL."""
    total = F.greatest(F.lit(0), F.floor(seconds + 0.5).cast("bigint"))
    h = F.floor(total / 3600).cast("bigint")
    m, s = F.floor(F.pmod(total, F.lit(3600)) / 60).cast("bigint"), F.pmod(total, F.lit(60))
    return F.when(seconds.isNull(), "—") \
        .when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)) \
        .otherwise(F.format_string("%02d:%02d", m, s))


def progress(stage: str, done: Column, total: Column) -> Column:
    base, span = {"ocr": (5, 35), "extract": (50, 40), "rerun": (40, 45)}[stage]
    return (F.lit(base) + F.floor(F.lit(span) * done / total)).cast("int")
