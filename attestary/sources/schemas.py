"""Schemas of the files the sources read."""

TEMPLATE = """
_generated_from string, _reviewed boolean, _recipient_by_canton map<string, map<string, string>>,
fields array<struct<comments: string, id: string, name: string, label: string, question: string,
  required: boolean, xml_path: string, acroform_name: string, type: string,
  options: array<string>, option_values: array<string>, preset: string, computed: string>>,
_corrupt string
"""
GROUND_TRUTH = """
fields map<string, struct<expected: string, tolerance: string, category: string,
  keywords: array<string>>>, _meta struct<form_id: string>
"""
RUNS = "ts string, form_id string, documents int, seconds double"
