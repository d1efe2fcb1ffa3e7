"""Template derivation as one plan: from form trees and widgets to worded, numbered field lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from attestary.functions.paths import canonical_som
from attestary.functions.text import WS, strip
from attestary.operators import admission, templates
from attestary.session import stage

FIELD = ["form_id", "ord", "field_id", "name", "label", "question", "required", "xml_path", "acroform_name",
         "type", "options", "option_values", "preset", "computed"]


@dataclass
class Forms:
    """What templates are derived from; see :mod:`attestary.operators.templates` for the columns.

    ``prior`` holds the fields of earlier templates, ``scripts(form_id, script)`` the forms' scripts.
    """
    nodes: DataFrame
    widgets: DataFrame
    prior: DataFrame
    contexts: DataFrame
    leaves: DataFrame
    roles: DataFrame
    scripts: DataFrame


def _first(*values: Column | str) -> Column:
    """The first value that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def node_states(f: Forms) -> DataFrame:
    """Every node with its paths, its widget and whether it is skipped, unmatched or fillable."""
    placed = templates.node_paths(f.nodes).withColumn("canon", canonical_som(F.col("som")))
    return admission.fillable_nodes(placed, templates.named_widgets(f.widgets))


def derive_templates(f: Forms) -> tuple[DataFrame, DataFrame]:
    """(fields, recipients per canton) of every form of which enough nodes have a widget.

    Earlier wording goes before the vocabularies, and these before what the form itself says. A
    field without a caption is labelled by its name.
    """
    states = stage(node_states(f), "node-states")
    accepted = admission.coverage_gate(states).where("accepted")
    fields = states.where("state = 'fillable'").join(accepted.select("form_id"), "form_id", "left_semi")
    described = templates.describe(fields, f.contexts, f.leaves, f.roles)
    merged = stage(templates.merge_prior(described, f.prior), "worded-fields")
    numbered = templates.number_sections(merged, f.prior)
    typed = numbered.join(templates.group_options(f.nodes), ["form_id", "node"], "left")
    caption = strip(F.regexp_replace("caption", WS + "+", " "))
    by_form = templates.node_type(F.col("ui"), F.col("tag"), F.col("options"))
    whole = (typed.withColumns({
        "label": F.coalesce(_first(caption), "name"),
        "question": F.coalesce("kept.question", "question"),
        "required": F.coalesce("kept.required", F.lit(False)),
        "type": _first("kept.type", "vocab_type", by_form),
        "preset": templates.preset_value(F.col("widget_value")),
        "computed": F.lit(None).cast("string"),
    }).withColumnRenamed("widget", "acroform_name").select(*FIELD))
    cantons = templates.canton_table(f.scripts)
    return templates.recipient_block(whole, cantons), cantons
