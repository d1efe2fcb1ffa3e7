"""From documents to targets on two small dossiers, with canned answers."""

import json
import re

import pytest

from attestary.plans import form_fill as P

FIELDS = ("form_id string, ord int, field_id string, name string, question string, type string, xml_path string, acroform_name string, "
          "options array<string>, option_values array<string>, preset string, computed string")


@pytest.fixture
def dossiers(spark):
    docs = [("j1", 1, "a.pdf", "# Patient\n\nMadame Marie Dubois, canton de NE.\n# Travail\n\nIncapacité de 50 % dès le 15 mars 2025"),
            ("j1", 2, "b.pdf", "# Autre\n\nEmployée de bureau"), ("j2", 1, "c.pdf", "# Patient\n\nJean Martin")]
    fields = [("F", 0, "1.1", "treatmentCanton", "Dans quel canton ?", None, "f/canton", "f.canton", None, None, None, None),
              ("F", 1, "2.1", "firstName", "Quel est le nom de Madame ?", None, "f/name", "f.name", None, None, None, None),
              ("F", 2, "2.2", "sex", "Quel sexe ?", "choice", "f/sex", None, ["Homme", "Femme"], ["0", "1"], None, None),
              ("F", 3, "3.1", "date", "Incapacité dès quelle date ?", "date", "f/date", "f.date", None, None, None, None),
              ("F", 4, "9.1", "zip", "NPA ?", None, "f/zip", None, None, None, "3000", None),
              ("F", 5, "9.2", "recipientBlockAddressLeft", None, None, "f/block", None, None, None, None, "Office AI"),
              ("F", 6, "9.3", "office", "", None, "f/office", None, None, None, None, None)]
    return P.Dossiers(
        spark.createDataFrame([("j1", "F"), ("j2", "F")], "job_id string, form_id string"),
        spark.createDataFrame(docs, "job_id string, doc_no int, filename string, markdown string"),
        spark.createDataFrame(fields, FIELDS),
        spark.createDataFrame([("j1", '{"patient": {"nom": "Dubois"}, "canton_traitement": "NE"}'), ("j2", None)], "job_id string, synthesis string"),
        spark.createDataFrame([("F", "NE", "office", "Office NE"), ("F", "NE", "zip", "2000")], "form_id string, canton string, name string, value string"))


KNOWN = {"1.1": ("ne", "canton de NE"), "2.1": ("Marie Dubois", "Madame Marie Dubois"), "2.2": ("femme", "inventé de toutes pièces"),
         "3.1": ("15.03.2025", "")}


def canned(known):
    def answer(prompt):
        ids = re.findall(r"• \[([0-9.]+)\]", prompt)
        if "Dubois" not in prompt:
            raise RuntimeError("no such dossier")
        return json.dumps({i: dict(zip(("value", "source_quote"), known[i])) for i in ids})
    return answer


def test_fill_and_rerun(spark, dossiers):
    chunks = P.chunk_table(dossiers.docs)
    assert chunks.where("job_id = 'j1'").count() == 5  # a heading first leaves the source line alone
    prompts = {(r.job_id, r.batch_no): r.prompt for r in P.prompt_table(dossiers, chunks, P.rank_chunks(dossiers, chunks)).collect()}
    assert len(prompts) == 6 and "Homme | Femme" in prompts[("j1", 1)]
    assert 'SYNTHÈSE MÉDICALE (source principale) :\n{"canton_traitement": "NE"' in prompts[("j1", 0)]
    assert "SYNTHÈSE" not in prompts[("j2", 0)] and "9.1" not in "".join(prompts.values())

    results, targets = P.fill_forms(dossiers, canned(KNOWN), pause=0.0)
    got = {(r.job_id, r.field_id): r for r in results.collect()}
    assert len(got) == 8
    assert {f: got[("j1", f)].grounding for f in KNOWN} == {
        "1.1": "verified", "2.1": "verified", "2.2": "unverified", "3.1": "attested"}
    assert got[("j1", "3.1")].source_match == "15 mars 2025"
    assert {got[("j2", f)].error for f in KNOWN} == {"extraction_failed"}
    paths = {r["name"]: r.value for r in targets.where("job_id = 'j1' AND target = 'xml_path'").collect()}
    assert paths == {"f/canton": "ne", "f/name": "Marie Dubois", "f/sex": "1", "f/date": "15.03.2025",
                     "f/zip": "2000", "f/block": "Office AI", "f/office": "Office NE"}

    _, again = P.fill_forms(dossiers, canned(KNOWN), chunks=chunks, pause=0.0)
    kept = {r["name"] for r in again.where("job_id = 'j1' AND target = 'xml_path'").collect()}
    assert kept == {"f/canton", "f/name", "f/sex", "f/date"}


def test_synthesis_comes_from_the_documents(spark, dossiers):
    bare = P.Dossiers(dossiers.jobs, dossiers.docs, dossiers.fields)

    def summary(prompt):
        if "Jean Martin" in prompt:
            return "no JSON at all"
        return 'Voici : {"patient": {"nom": "Dubois"}, "diagnostics": ["d1"], "dates_cles": {"debut": "15.03.2025"}} fin'
    got = {r.job_id: r.synthesis for r in P.synthesise(bare, summary, pause=0.0).collect()}
    assert got["j2"] is None
    assert json.loads(got["j1"]) == {"patient": {"nom": "Dubois"}, "diagnostics": ["d1"], "dates_cles": {"debut": "15.03.2025"}}

    results, _ = P.fill_forms(bare, canned(KNOWN), summarise=summary, pause=0.0)
    assert {r.field_id for r in results.where("job_id = 'j1' AND grounding = 'verified'").collect()} == {"1.1", "2.1"}


def test_several_summaries_keep_every_version(spark):
    from attestary.operators import context
    jobs = spark.createDataFrame([("a",), ("b",), ("c",)], "job_id string")
    rows = [("a", 1, 'x "1".pdf', '{"patient": {"nom": "A"}, "diagnostics": ["d1", {"code": "M54"}], "dates_cles": {"d": "1"}, "pronostic": null}'),
            ("a", 2, "y.pdf", '{"patient": {"nom": "B"}, "diagnostics": [], "pronostic": "bon \\"oui\\""}'), ("a", 3, "z.pdf", None),
            ("b", 1, "x.pdf", '{"pronostic": "seul"}')]
    summaries = spark.createDataFrame(rows, "job_id string, doc_no bigint, filename string, summary string")
    got = {r.job_id: r.synthesis for r in context.merged_synthesis(jobs, summaries).collect()}
    assert got["b"] == '{"pronostic": "seul"}' and got["c"] is None
    merged = json.loads(got["a"])
    assert merged == {
        "patient": [{"document_source": 'x "1".pdf', "valeur": {"nom": "A"}}, {"document_source": "y.pdf", "valeur": {"nom": "B"}}],
        "diagnostics": [{"document_source": 'x "1".pdf', "valeur": "d1"}, {"document_source": 'x "1".pdf', "valeur": {"code": "M54"}}],
        "dates_cles": [{"document_source": 'x "1".pdf', "valeur": {"d": "1"}}],
        "pronostic": [{"document_source": "y.pdf", "valeur": 'bon "oui"'}]}
