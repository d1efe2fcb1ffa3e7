"""Template derivation: from form nodes and widgets to a numbered, worded field list.

``nodes(form_id, node, parent, ord, tag, name, ui, caption, items, readonly)`` is the form tree, with
``parent`` the nearest named ancestor (``area`` containers and unnamed ones do not count) and ``ord``
document order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from attestary import fixed, wordings
from attestary.functions.paths import canonical_som, path_key, som_section, xml_path
from attestary.functions.text import WS, strip, unescaped
from attestary.operators.fill import first_by
from attestary.operators.numbering import number_rows
from attestary.session import stage


def sibling_index(nodes: DataFrame) -> DataFrame:
    return number_rows(nodes, ["form_id", "parent", "name"], "ord", "sibling")


MAX_DEPTH = 1000  # levels of a form; deeper ones are an error


def node_paths(nodes: DataFrame) -> DataFrame:
    """Adds ``som`` and ``ancestors`` (root first) and ``xml_path`` to every node.

    Nodes are numbered once and written; then children take their parent's path in one recursive query, so
    the plan is the same for a form of any depth. Nodes that no root reaches have no path and are left out.
    """
    part = F.concat(F.col("name"), F.lit("["), F.col("sibling").cast("string"), F.lit("]"))
    numbered = stage(sibling_index(nodes), "form-nodes")
    rows = numbered.select("form_id", "node", "parent", "name", part.alias("part"))
    paths = nodes.sparkSession.sql("""
        WITH RECURSIVE reached (form_id, node, som, ancestors, name) MAX RECURSION LEVEL {depth} AS (
            SELECT form_id, node, part, CAST(array() AS ARRAY<STRING>), name FROM {rows} WHERE parent IS NULL
            UNION ALL
            SELECT n.form_id, n.node, concat(r.som, '.', n.part), concat(r.ancestors, array(r.name)), n.name
            FROM {rows} n JOIN reached r ON n.form_id = r.form_id AND n.parent = r.node)
        SELECT form_id, node, som, ancestors FROM reached LIMIT ALL""", rows=rows, depth=MAX_DEPTH)
    return numbered.join(paths, ["form_id", "node"]).withColumn("xml_path", xml_path(F.col("som")))


def struct_name(ancestor: Column) -> Column:
    """Canonical container name: known suffixes, then aliases."""
    out = F.lit(None).cast("string")
    for suffix in fixed.STRUCT_SUFFIXES:
        out = F.coalesce(out, F.when(ancestor.endswith(suffix), suffix))
    for alias, name in fixed.STRUCT_ALIASES.items():
        out = F.coalesce(out, F.when(ancestor == alias, name))
    return F.coalesce(out, ancestor)


def vocabulary(spark, entries: dict[str, str], names: tuple[str, str]) -> DataFrame:
    return spark.createDataFrame(list(entries.items()), list(names))


def standard_vocabularies(spark) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Contexts, leaves and roles of the fixed wordings, as :func:`describe` takes them."""
    contexts = [(struct, leaf, *entry) for (struct, leaf), entry in wordings.CONTEXT_QUESTIONS.items()]
    leaves = [(leaf, *entry) for leaf, entry in wordings.FIELD_QUESTIONS.items()]
    leaf = "leaf string, question string, vocab_type string"
    return (spark.createDataFrame(contexts, "struct string, " + leaf), spark.createDataFrame(leaves, leaf),
            vocabulary(spark, fixed.ROLES, ("struct", "role")))


def describe(nodes: DataFrame, contexts: DataFrame, leaves: DataFrame,
             roles: DataFrame) -> DataFrame:
    """Adds ``question`` and ``vocab_type`` from the vocabularies.

    ``contexts(struct, leaf, question, vocab_type)``, ``leaves(leaf, question, vocab_type)``,
    ``roles(struct, role)``, one row per key. The nearest ancestor wins for context and role alike; a question with
    a role placeholder and no role is left blank. Ancestors become rows with their distance and join the
    vocabularies, as large as these may be; the nearest that fits is kept.
    """
    up = nodes.select("form_id", "node", "name", F.posexplode(F.reverse("ancestors")).alias("far", "above"))
    entry = F.struct("_c.question", "_c.vocab_type")
    known = (up.join(contexts.select("struct", "leaf", F.struct("question", "vocab_type").alias("_c")),
                     (struct_name(F.col("above")) == F.col("struct")) & (F.col("name") == F.col("leaf")), "left").drop("struct", "leaf")
             .join(roles.select(F.col("struct").alias("above"), "role"), "above", "left")
             .groupBy("form_id", "node")
             .agg(F.min_by(entry, F.when(F.col("_c").isNotNull(), F.col("far"))).alias("_context"),
                  F.min_by("role", F.when(F.col("role").isNotNull(), F.col("far"))).alias("_role")))
    plain = leaves.select(F.col("leaf").alias("name"), F.struct("question", "vocab_type").alias("_leaf"))
    found = (nodes.join(known, ["form_id", "node"], "left").join(plain, "name", "left")
             .withColumn("_entry", F.coalesce("_context", "_leaf")))
    text = F.col("_entry.question")
    filled = F.replace(F.replace(text, F.lit("{role}"), F.coalesce("_role", F.lit(""))),
                       F.lit("  "), F.lit(" "))
    question = (F.when(F.col("_entry").isNull(), "")
                .when(text.contains("{role}") & F.col("_role").isNull(), "").otherwise(filled))
    return found.select(*nodes.columns, question.alias("question"), F.col("_entry.vocab_type").alias("vocab_type"))


def group_options(nodes: DataFrame) -> DataFrame:
    """Labels and export values per exclusive group, buttons lacking either skipped."""
    caption = strip(F.regexp_replace(F.coalesce("caption", F.lit("")), WS + "+", " "))
    first_item = F.try_element_at("items", F.lit(1))
    pair = F.struct("ord", caption.alias("label"), first_item.alias("value"))
    groups = nodes.where("tag = 'exclGroup'").select("form_id", F.col("node").alias("parent"))
    return (nodes.where((F.col("tag") == "field") & (caption != "") & (F.size("items") > 0))
            .join(groups, ["form_id", "parent"], "left_semi")
            .groupBy("form_id", "parent").agg(F.array_sort(F.collect_list(pair)).alias("p"))
            .select("form_id", F.col("parent").alias("node"),
                    F.transform("p", lambda x: x["label"]).alias("options"),
                    F.transform("p", lambda x: x["value"]).alias("option_values")))


def node_type(ui: Column, tag: Column, options: Column) -> Column:
    by_ui = F.lit(None).cast("string")
    for kind, name in fixed.UI_TYPES.items():
        by_ui = F.coalesce(by_ui, F.when(ui == kind, name))
    return F.when((tag == "exclGroup") & (F.size(options) > 0), "choice").otherwise(by_ui)


def named_widgets(widgets: DataFrame) -> DataFrame:
    """``form_id, canon, widget, widget_value``: one widget per canonical name; of several, the last listed."""
    return (widgets.withColumn("canon", canonical_som(F.col("widget")))
            .groupBy("form_id", "canon")
            .agg(F.max_by(F.struct("widget", "value"), "ord").alias("_w"))
            .select("form_id", "canon", "_w.widget", F.col("_w.value").alias("widget_value")))


def match_widgets(nodes: DataFrame, widgets: DataFrame) -> DataFrame:
    """Adds the widget whose canonical name is the node's."""
    return (nodes.withColumn("canon", canonical_som(F.col("som")))
            .join(named_widgets(widgets), ["form_id", "canon"], "left"))


def prior_index(prior: DataFrame) -> DataFrame:
    """Earlier worded fields by acroform name and by path key; the first entry of a key wins."""
    keyed = prior.where(F.length("question") > 0).select(
        "form_id", "ord", F.inline(F.array(
            F.struct(F.lit(0).alias("slot"), F.col("acroform_name").alias("key")),
            F.struct(F.lit(1).alias("slot"), path_key(F.col("xml_path")).alias("key")))),
        F.struct("field_id", "question", "type", "required").alias("kept"))
    return first_by(keyed.where(F.length("key") > 0), ["form_id", "key"], "ord", "slot") \
        .select("form_id", "key", "kept")


def merge_prior(nodes: DataFrame, prior: DataFrame) -> DataFrame:
    """Adds ``kept``, the earlier field of each node: by SOM name, then by path key."""
    index = prior_index(prior)
    by_name = index.select("form_id", F.col("key").alias("som"), F.col("kept").alias("_k1"))
    by_path = index.select("form_id", F.col("key").alias("_pk"), F.col("kept").alias("_k2"))
    return (nodes.withColumn("_pk", path_key(F.col("xml_path")))
            .join(by_name, ["form_id", "som"], "left").join(by_path, ["form_id", "_pk"], "left")
            .withColumn("kept", F.coalesce("_k1", "_k2")).drop("_k1", "_k2", "_pk"))


def orphans(prior: DataFrame, merged: DataFrame) -> DataFrame:
    """Earlier questions no node reuses."""
    return (prior_index(prior).select("form_id", F.col("kept.question").alias("question")).distinct()
            .join(merged.select("form_id", F.col("kept.question").alias("question")),
                  ["form_id", "question"], "left_anti"))


def number_sections(nodes: DataFrame, prior: DataFrame) -> DataFrame:
    """Adds ``section_no`` and the new ``field_id``.

    A node keeps its earlier section if that is a number; new ones get their page's section,
    pages numbered after the highest earlier section in first-seen order.
    """
    def numeric_section(field_id: Column) -> Column:
        s = F.substring_index(field_id, ".", 1)
        return F.when(s.rlike("^[0-9]+$"), s.cast("int"))
    highest = (prior_index(prior).groupBy("form_id")
               .agg(F.max(numeric_section(F.col("kept.field_id"))).alias("_max")))
    rows = (nodes.withColumn("_old", numeric_section(F.col("kept.field_id")))
            .withColumn("page", som_section(F.col("som"))))
    new_pages = (rows.where("_old IS NULL").groupBy("form_id", "page")
                 .agg(F.min("ord").alias("_first"))
                 .withColumn("_n", F.row_number().over(W.partitionBy("form_id").orderBy("_first")))
                 .drop("_first"))
    section = F.coalesce(F.col("_old"), F.coalesce("_max", F.lit(0)) + F.col("_n"))
    placed = (rows.join(highest, "form_id", "left").join(new_pages, ["form_id", "page"], "left")
            .withColumn("section_no", section.cast("bigint")).drop("_old", "_max", "_n"))
    counted = number_rows(placed, ["form_id", "section_no"], "ord", "_counter")
    return (counted.withColumn("field_id", F.concat_ws(".", F.col("section_no").cast("string"),
                                                       (F.col("_counter") + 1).cast("string")))
            .drop("_counter"))


def preset_value(widget_value: Column) -> Column:
    """A widget's own value, unless it is blank or a ``<placeholder>``."""
    v = strip(F.coalesce(widget_value, F.lit("")))
    return F.when((v != "") & ~v.rlike(r"^<[^<>]*>$"), v)


def recipient_block(fields: DataFrame, by_canton: DataFrame) -> DataFrame:
    """Recipient block composed from preset address fields: question cleared, ``computed`` set.

    ``by_canton(form_id)`` lists the forms with their own canton table, whose block stays empty.
    """
    source = F.lit(False)
    for name in fixed.RECIPIENT_SOURCES:
        source = source | F.coalesce(F.contains("xml_path", F.lit(name)), F.lit(False))

    def latest(name: str) -> Column:
        return F.max_by(strip(F.col("preset")), F.when(F.col("name") == name, F.col("ord")))
    names = fixed.RECIPIENT_LINES + ["zip", "city"]
    got = (fields.where((F.length("preset") > 0) & source).groupBy("form_id")
           .agg(*[F.when(F.count_if(F.col("name") == n) > 0, latest(n)).alias(f"_{n}")
                  for n in names]))

    def filled(name: str) -> Column:
        return F.nullif(f"_{name}", F.lit(""))
    city = F.nullif(F.concat_ws(" ", filled("zip"), filled("city")), F.lit(""))
    lines = F.filter(F.array(*[filled(n) for n in fixed.RECIPIENT_LINES], city),
                     lambda x: x.isNotNull())
    blocks = (got.select("form_id", lines.alias("_l")).where(F.size("_l") >= 2)
              .join(by_canton.select("form_id", F.lit(True).alias("_own")).distinct(),
                    "form_id", "left")
              .select("form_id", F.when(F.col("_own"), "").otherwise(F.array_join("_l", "\n"))
                      .alias("_block")))
    is_block = F.col("_block").isNotNull() & F.col("name").startswith(fixed.RECIPIENT_BLOCK)
    text = F.when(F.col("name").endswith("Left"), F.col("_block")).otherwise("")
    return (fields.join(blocks, "form_id", "left")
            .withColumn("question", F.when(~F.coalesce(is_block, F.lit(False)), F.col("question")))
            .withColumn("computed", F.when(is_block, text).otherwise(F.col("computed")))
            .drop("_block"))


def canton_table(scripts: DataFrame) -> DataFrame:
    """``(form_id, canton, name, value)`` from the switch over cantons in a form's template.

    Tags give way to blanks and references to their characters first. Cases read ``case 'XX': { … }
    break`` with ``.name.rawValue = "text"`` or ``= blockAddress``; of several cases of a canton the last
    that assigns anything counts, and the last of several assignments of a name.
    """
    case, assign, block = fixed.CANTON_CASE, fixed.CANTON_ASSIGN, fixed.CANTON_BLOCK
    scripts = scripts.select("form_id", unescaped(F.regexp_replace("script", "<[^>]+>", " ")).alias("script"))
    cases = scripts.select("form_id", F.posexplode(F.arrays_zip(
        F.regexp_extract_all("script", F.lit(case), F.lit(1)).alias("canton"),
        F.regexp_extract_all("script", F.lit(case), F.lit(2)).alias("body"))).alias("at", "c"))
    cases = first_by(cases.select("form_id", "at", "c.canton", "c.body").where(F.col("body").rlike(assign)),
                     ["form_id", "canton"], F.desc("at"))
    rows = cases.select("form_id", "canton",
                        F.regexp_extract("body", block, 1).alias("_block"),
                        F.posexplode(F.arrays_zip(
                            F.regexp_extract_all("body", F.lit(assign), F.lit(1)).alias("name"),
                            F.regexp_extract_all("body", F.lit(assign), F.lit(2)).alias("raw"),
                            F.regexp_extract_all("body", F.lit(assign), F.lit(3)).alias("text")))
                        .alias("at", "a"))
    raw = F.when(F.col("a.raw") == "blockAddress", F.col("_block")).otherwise(F.col("a.text"))
    value = strip(F.replace(F.replace(raw, F.lit("\\r"), F.lit("\n")), F.lit("\\n"), F.lit("\n")))
    return first_by(rows.select("form_id", "canton", "at", "a.name", value.alias("value")),
                    ["form_id", "canton", "name"], F.desc("at")).drop("at")


def catalog_report(fields: DataFrame) -> DataFrame:
    """Fields, written and missing questions per form, state, and a total row (NULL form)."""
    written = F.count_if(F.coalesce(F.length("question") > 0, F.lit(False)))
    n = F.count(F.lit(1))
    return (fields.where("computed IS NULL").rollup("form_id")
            .agg(n.alias("fields"), written.alias("written"), (n - written).alias("to_write"))
            .withColumn("reviewed", F.col("to_write") == 0))


def template_duplicates(fields: DataFrame) -> DataFrame:
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key"))
                     for k in ("field_id", "xml_path", "acroform_name")])
    return (fields.select("form_id", F.inline(keys)).where(F.length("key") > 0)
            .groupBy("form_id", "kind", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
