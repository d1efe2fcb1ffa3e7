"""Form filling as merges of value rows into leaf tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from attestary import fixed
from attestary.functions.paths import split_segment
from attestary.functions.text import strip
from attestary.operators.numbering import number_rows
from attestary.session import stage
from attestary.functions.values import (convert, norm_field_value, resolve_option,
                                        to_on_off, to_on_off_xfa, xfa_text)


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def field_values(results: DataFrame, fields: DataFrame) -> DataFrame:
    """Non-empty results on the first template field of their id, normalised and option-resolved.

    ``results(job_id, form_id, field_id, value, …)``; ``fields`` as read by the sources.
    """
    template = first_by(fields, ["form_id", "field_id"], "ord")
    value = norm_field_value(F.col("value"), F.col("type"))
    return (results.where(F.length("value") > 0)
            .join(template.select("form_id", "field_id", "ord", "name", "type", "xml_path",
                                  "acroform_name", "options", "option_values"),
                  ["form_id", "field_id"])
            .withColumn("value", resolve_option(value, F.col("options"), F.col("option_values")))
            .drop("options", "option_values"))


def computed_values(fields: DataFrame) -> DataFrame:
    return (fields.where(F.length("computed") > 0)
            .select("form_id", "field_id", "ord", "name", "xml_path", "acroform_name",
                    F.col("computed").alias("value")))


def canton_recipient(results: DataFrame, fields: DataFrame, table: DataFrame) -> DataFrame:
    """Recipient fields of the first extracted canton the form knows.

    ``table(form_id, canton, name, value)``; returns ``(job_id, form_id, name, value)``.
    """
    asks = fields.where(F.col("name") == fixed.CANTON_FIELD).select("form_id", "field_id").distinct()
    canton = F.upper(strip(F.coalesce("value", F.lit(""))))
    known = table.select("form_id", "canton").distinct()
    chosen = (results.join(asks, ["form_id", "field_id"])
              .select("job_id", "form_id", "ord", canton.alias("canton"))
              .join(known, ["form_id", "canton"])
              .groupBy("job_id", "form_id")
              .agg(F.min(F.struct("ord", "canton"))["canton"].alias("canton")))
    return chosen.join(table, ["form_id", "canton"]).select("job_id", "form_id", "name", "value")


EXTRACTED, COMPUTED, CANTON = 0, 1, 2
TARGETS = ("xml_path", "acroform_name")


def resolve_targets(extracted: DataFrame, computed: DataFrame | None = None,
                    canton: DataFrame | None = None) -> DataFrame:
    """``(job_id, target, name, value, prio)``: canton over computed over extracted, later over
    earlier, for each of the two target names on its own.

    Every input has ``job_id, ord, xml_path, acroform_name, value``; a re-run passes the extracted
    values alone.
    """
    rows = None
    for prio, df in ((EXTRACTED, extracted), (COMPUTED, computed), (CANTON, canton)):
        if df is None:
            continue
        part = df.select("job_id", "ord", *TARGETS, "value", F.lit(prio).alias("prio"))
        rows = part if rows is None else rows.unionByName(part)
    both = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("name")) for t in TARGETS])
    long = (rows.select("job_id", "ord", "value", "prio", F.inline(both))
            .where(F.length("name") > 0))
    # max keeps one row per map task and target, however often a target is written
    return (long.groupBy("job_id", "target", "name")
            .agg(F.max(F.struct("prio", "ord", "value")).alias("w"))
            .select("job_id", "target", "name", "w.value", "w.prio"))


# --- leaves ---------------------------------------------------------------------------------

def checkbox_paths(leaves: DataFrame) -> DataFrame:
    """Paths whose leaf reads On or Off, numbered in first-seen order."""
    seen = (leaves.where(strip(F.col("text")).isin("On", "Off")).groupBy("form_id", "path")
            .agg(F.min("ord").alias("ord")))
    return number_rows(seen, ["form_id"], "ord", "no", ties="path")


def normalize_checkboxes(values: DataFrame, paths: DataFrame) -> DataFrame:
    boxes = paths.select("form_id", "path").distinct().withColumn("_box", F.lit(True))
    return (values.join(boxes, ["form_id", "path"], "left")
            .withColumn("value", F.when(F.col("_box"), to_on_off_xfa(F.col("value")))
                        .otherwise(F.col("value"))).drop("_box"))


def upsert_leaves(leaves: DataFrame, values: DataFrame, overwrite: bool = True) -> DataFrame:
    """Leaf table with the values written: ``values(form_id, path, value, type)``, one per path."""
    written = values.select("form_id", "path", xfa_text(
        F.col("value"), F.coalesce("type", F.lit("str"))).alias("_new"))
    free = F.lit(True) if overwrite else strip(F.coalesce("text", F.lit(""))) == ""
    return (leaves.join(written, ["form_id", "path"], "left")
            .withColumn("text", F.when(F.col("_new").isNotNull() & free, F.col("_new"))
                        .otherwise(F.col("text"))).drop("_new"))


def unknown_paths(leaves: DataFrame, values: DataFrame) -> DataFrame:
    return values.join(leaves.select("form_id", "path"), ["form_id", "path"], "left_anti")


GROUP_LIMIT = 1000  # below it Spark keeps the first rows of a group before they are shuffled


def _first_rows(rows: DataFrame, group: list[str], name: str, most: int) -> DataFrame:
    """``rows`` with ``name``, 0, 1, 2 … per group by ``ord``: those up to ``most`` at least."""
    if most >= GROUP_LIMIT:
        return number_rows(rows, group, "ord", name)
    number = F.row_number().over(W.partitionBy(*group).orderBy("ord"))
    return rows.withColumn("_n", number).where(F.col("_n") <= most + 1).withColumn(name, F.col("_n") - 1).drop("_n")


def _same(a: str, b: str) -> Column:
    """Equality that is no join key, so that a join stays where the window has put the rows."""
    return F.col(a).cast("bigint") - F.col(b).cast("bigint") == 0


def match_paths(elements: DataFrame, paths: DataFrame) -> DataFrame:
    """Element each path leads to: ``(form_id, path, node)``, unmatched paths left out.

    ``elements(form_id, node, parent, tag, ord)`` is the tree, ``ord`` document order, ``paths(form_id,
    path)``. The first segment may start anywhere in the tree (with an index: at that occurrence in
    document order), each further one steps to a child; the first match in document order wins.
    The tree is walked one level per join, and the number of levels is that of the longest path. Elements
    whose tag no path names are left out first; of the others a level moves those whose tag is asked there,
    and of the children of a node with the same tag only as many as the largest index asks for.
    """
    parts = F.transform(F.filter(F.split("path", "/", -1), lambda p: p != ""),
                        lambda p: split_segment(p))
    todo = stage(paths.select("form_id", "path").distinct().withColumn("_s", parts), "paths")
    steps = stage(todo.select(F.posexplode("_s").alias("level", "s")).groupBy("level", "s.tag")
                  .agg(F.max("s.index").alias("most")), "path-steps")
    largest = {r.level + 1: max(r.most or 0, 0) for r in steps.groupBy("level").agg(F.max("most").alias("most")).collect()}
    columns = ["form_id", "node", "parent", "tag", "ord"]
    tree = stage(elements.select(*columns).join(steps.select("tag"), "tag", "left_semi").select(*columns), "path-tree")

    def named(level: int, asked: str = "true") -> DataFrame:
        tags = steps.where((F.col("level") == level - 1) & F.expr(asked)).select("tag")
        return tree.join(tags, "tag", "left_semi")
    keys = ["form_id", "tag"]
    step = F.try_element_at("_s", F.lit(1))
    starts = todo.withColumn("tag", step["tag"]).withColumn("_i", step["index"])
    # a path of one segment without an index asks for the first of all
    alone = (F.size("_s") == 1) & (F.col("_i") == 0)
    first = named(1).groupBy(*keys).agg(F.min(F.struct("ord", "node")).alias("w")).select(*keys, "w.ord", "w.node")
    done = [starts.where(alone).join(first, keys).select("form_id", "path", "ord", "node")]
    at = (starts.where((F.size("_s") > 1) & (F.col("_i") == 0))
          .join(named(1).select(*keys, "node", "ord"), keys).select("form_id", "path", "_s", "node", "ord"))
    if largest.get(1):
        counted = _first_rows(named(1, "most > 0").select(*keys, "node", "ord"), keys, "_doc", largest[1])
        at = at.unionByName(starts.where("_i > 0").join(counted, keys).where(_same("_doc", "_i"))
                            .select("form_id", "path", "_s", "node", "ord"))
    at = stage(at, "path-level")
    done.append(at.where(F.size("_s") == 1).select("form_id", "path", "ord", "node"))
    keys = ["form_id", "parent", "tag"]
    for level in range(2, max(largest, default=0) + 1):
        step = F.try_element_at("_s", F.lit(level))
        children = _first_rows(named(level).where("form_id IS NOT NULL AND parent IS NOT NULL"), keys, "_child", largest[level])
        at = stage(at.where(F.size("_s") >= level)
                   .select("form_id", "path", "_s", F.col("node").alias("parent"), step["tag"].alias("tag"), step["index"].alias("_i"))
                   .join(children, keys).where(_same("_child", "_i"))
                   .select("form_id", "path", "_s", "node", "ord"), "path-level")
        done.append(at.where(F.size("_s") == level).select("form_id", "path", "ord", "node"))
    return (reduce(DataFrame.unionByName, done).groupBy("form_id", "path")
            .agg(F.min(F.struct("ord", "node"))["node"].alias("node")))


def form_kind(forms: DataFrame) -> DataFrame:
    """``forms(…, has_xfa, has_widgets)`` with the kind and the merge steps it calls for."""
    kind = (F.when(F.col("has_xfa") & F.col("has_widgets"), "hybrid").when(F.col("has_xfa"), "xfa")
            .when(F.col("has_widgets"), "acroform").otherwise("none"))
    steps = (F.when(F.col("kind") == "hybrid", F.array(F.lit("xfa"), F.lit("acroform")))
             .when(F.col("kind") == "none", F.array().cast("array<string>"))
             .otherwise(F.array("kind")))
    return forms.withColumn("kind", kind).withColumn("steps", steps)


def fill_radio(values: DataFrame, states: DataFrame) -> DataFrame:
    """Group values that are a state of their group; all others leave the group empty."""
    wanted = values.withColumn("state", strip(F.col("value")))
    return wanted.join(states, ["form_id", "name", "state"], "left_semi")


def batch_convert(values: DataFrame, types: DataFrame, boxes: DataFrame) -> DataFrame:
    """Library conversion of a whole table: checkboxes first, then by declared type.

    ``values(field_id, value, …)``, ``types(field_id, type)``, ``boxes(field_id)``.
    """
    flag = boxes.select("field_id").distinct().withColumn("_box", F.lit(True))
    converted = F.when(F.col("_box"), to_on_off(F.col("value"))) \
        .otherwise(convert(F.col("value"), F.coalesce("type", F.lit("str"))))
    return (values.join(types, "field_id", "left").join(flag, "field_id", "left")
            .withColumn("converted", converted).drop("_box"))
