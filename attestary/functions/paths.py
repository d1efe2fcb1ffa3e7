"""Path expressions: file names, form paths, taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from attestary.functions.text import strip


def safe_filename(name: Column, index: Column) -> Column:
    """Base name without NUL; nothing left gives ``upload_{index}.pdf``."""
    parts = F.filter(F.split(F.regexp_replace(name, r"\x00", ""), "/", -1),
                     lambda p: ~p.isin("", "."))
    return F.coalesce(F.try_element_at(parts, F.lit(-1)),
                      F.concat(F.lit("upload_"), index.cast("string"), F.lit(".pdf")))


def section_of(field_id: Column) -> Column:
    return F.substring_index(field_id, ".", 1)


def canonical_som(name: Column) -> Column:
    """Unescaped, and without the ``#area[n]`` parts that only widgets show."""
    return F.regexp_replace(F.regexp_replace(name, r"\\(.)", "$1"), r"(?:^|\.)#\w+\[\d+\]", "")


def _segments(path: Column, separator: str = "/") -> Column:
    return F.filter(F.split(path, separator, -1), lambda p: p != "")


def path_key(path: Column) -> Column:
    """Last two non-empty segments; NULL if there are none."""
    parts = _segments(path)
    n = F.size(parts)
    return F.when(n > 0, F.array_join(
        F.slice(parts, F.greatest(n - 1, F.lit(1)), F.lit(2)), "/"))


def taxonomy_code(path: Column) -> Column:
    """``medforms.`` and the leading numbers of the segments after ``medforms``."""
    parts = _segments(strip(path), r"[\\/]+")
    at = F.array_position(parts, "medforms").cast("int")
    tail = F.slice(parts, at + 1, F.size(parts))
    numbers = F.filter(F.transform(tail, lambda p: F.substring_index(p, ".", 1)),
                       lambda p: p.rlike("^[0-9]+$"))
    code = F.concat(F.lit("medforms."), F.array_join(numbers, "."))
    return F.when((at > 0) & (F.size(numbers) > 0), code).otherwise("")


def split_segment(segment: Column) -> Column:
    """``phone[1]`` as (phone, 1); no index means 0."""
    pattern = r"^([^\[]*)\[\s*([+-]?[0-9]+)\s*\]$"
    indexed = segment.rlike(pattern)
    return F.struct(
        F.when(indexed, F.regexp_extract(segment, pattern, 1)).otherwise(segment).alias("tag"),
        F.when(indexed, F.regexp_extract(segment, pattern, 2).try_cast("int"))
        .otherwise(0).alias("index"))


def xml_path(som: Column) -> Column:
    """Form path: segments joined by ``/``, first occurrences without an index."""
    return F.replace(F.regexp_replace(som, r"\[0\]", ""), F.lit("."), F.lit("/"))


def som_section(som: Column) -> Column:
    """Second segment without its index, ``misc`` if there is none."""
    second = F.regexp_extract(som, r"^[^.]*\.([^.\[]*)", 1)
    return F.when(som.contains("."), second).otherwise("misc")
