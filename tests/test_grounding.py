"""Search and verdicts against a direct reading of the rules on small dossiers."""

import random
import re

import pytest
from pyspark.sql import functions as F

from attestary.functions.text import fold
from attestary.operators import grounding as G

ASKED = "job_id string, needle string, whole boolean"
DOCS = "job_id string, doc_no int, filename string, markdown string"
RESULTS = "job_id string, field_id string, value string, source_quote string"


def holds(text, needle, whole):
    n = fold(text)
    if len(needle) < 12 or whole:
        plain = f" {needle} " in f" {n} "
    else:
        plain = needle in n
    tight = needle.replace(" ", "")
    return plain or (len(tight) >= 16 and tight in n.replace(" ", ""))


def brute(docs, job, needle, whole):
    for d in sorted((d for d in docs if d[0] == job), key=lambda d: d[1]):
        if holds(d[3], needle, whole):
            return d[1]
    return None


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = ["douleur", "du", "genou", "50", "1950", "complica", "tion", "complication", "é", "AVS", "756.1234", "15.03.2025", "le"]
    docs = []
    for job, n in (("hot", 60), ("a", 5), ("b", 1)):
        for i in range(n):
            docs.append((job, i, f"d{i}.pdf", " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 60)))))
    needles = set()
    for job in ("hot", "a", "b"):
        mine = [d[3] for d in docs if d[0] == job]
        for _ in range(120):
            t = fold(rnd.choice(mine))
            i = rnd.randint(0, len(t))
            piece = t[i:i + rnd.choice([2, 5, 11, 12, 14, 16, 17, 30, 60])].strip()
            if rnd.random() < .3:
                piece = piece.replace(" ", "", 1)
            if rnd.random() < .2:
                piece += " x"
            if piece:
                needles.add((job, piece, rnd.random() < .4))
    return docs, sorted(needles)


@pytest.mark.parametrize("seed", [0, 500_000])
def test_find_equals_brute_force(spark, seed):
    docs, needles = corpus(seed)
    index = G.source_index(spark.createDataFrame(docs, DOCS))
    found = {(r.job_id, r.needle, r.whole): r.ord.doc_no
             for r in G.find(spark.createDataFrame(needles, ASKED), index).collect()}
    want = {}
    for job, needle, whole in needles:
        at = brute(docs, job, needle, whole)
        if at is not None:
            want[(job, needle, whole or len(needle) < 12)] = at
    assert found == want and len(want) > 50


def ground(spark, docs, results, derived=None):
    index = G.source_index(spark.createDataFrame(docs, DOCS),
                           spark.createDataFrame(derived, DOCS) if derived else None)
    out = G.ground(spark.createDataFrame(results, RESULTS), index)
    return {r.field_id: r for r in out.collect()}


def test_verdicts(spark):
    text = ("## Page 1\n\nPatient né en 1950. Douleur lombaire basse.\n\n## Page 2\n\n"
            "Suite de complica tion infectieuse du genou, le 15 mars 2025. Taux 80 %")
    docs = [("j", 1, "un.pdf", text), ("j", 2, "deux.pdf", "Dr Martin, Neuchâtel"), ("k", 1, "autre.pdf", "secret 4711")]
    derived = [("j", 0, "synthèse", "canton VD et métier boulanger")]
    got = ground(spark, docs, [
        ("j", "in quote", "80", "le 15 mars 2025. Taux 80 %"), ("j", "not inside 1950", "50", "rien de cela"),
        ("j", "date", "15.03.2025", "rien de cela"), ("j", "broken word", "complication infectieuse", ""),
        ("j", "elsewhere", "Neuchâtel", "Douleur lombaire"), ("j", "free text", "mal de dos", "Douleur lombaire basse"),
        ("j", "letter quoted", "B", "Douleur lombaire basse"), ("j", "letter alone", "B", "nulle part ici"),
        ("j", "pieces", "12 rue du Lac", "Suite de complication inexistante; Douleur lombaire basse"),
        ("j", "derived", "boulanger", "métier boulanger"), ("j", "other job", "4711", "secret 4711"),
        ("j", "value in pieces only", "inexistante", "inexistante; Douleur lombaire basse")], derived)
    assert {k: v.grounding for k, v in got.items()} == {
        "in quote": "verified", "not inside 1950": "unverified", "date": "attested", "broken word": "attested",
        "elsewhere": "attested", "free text": "inferred", "letter quoted": "not_checkable",
        "letter alone": "unverified", "pieces": "inferred", "derived": "inferred", "other job": "unverified",
        "value in pieces only": "inferred"}
    assert got["in quote"].source_page == 2 and got["elsewhere"].source_page is None
    assert got["elsewhere"].source_document == "deux.pdf" and got["derived"].source_document == "synthèse"
    assert got["broken word"].source_match == "complica tion infectieuse"
    assert got["date"].source_match == "15 mars 2025"
    assert not got["letter alone"].quote_verified and got["letter alone"].source_document is None


def test_squashed_needs_sixteen_characters(spark):
    docs = [("j", 1, "a", "abcdefgh ijklmno et abcdefgh ijklmnop")]
    index = G.source_index(spark.createDataFrame(docs, DOCS))
    asked = [("j", "abcdefghijklmno", False), ("j", "abcdefghijklmnop", False)]
    got = [r.needle for r in G.find(spark.createDataFrame(asked, ASKED), index).collect()]
    assert got == ["abcdefghijklmnop"]


def test_match_is_the_needle_in_the_original(spark):
    docs, needles = corpus(5)
    rows = [(j, n, n, n) for j, n, w in needles if j == "hot"]
    for r in ground(spark, docs, rows).values():
        if r.source_match:
            assert fold(r.source_match).replace(" ", "") == r.field_id.replace(" ", "")
            assert re.sub(r"^… | …$", "", r.source_excerpt).find(r.source_match) >= 0


def test_annotate_keeps_every_value(spark):
    docs = spark.createDataFrame([("j", 1, "a.pdf", "valeur attestée ici")], DOCS)
    results = spark.createDataFrame(
        [("j", "1", "valeur attestée", "", None), ("j", "2", " ", "", None), ("j", "3", None, None, "extraction_failed")],
        RESULTS + ", error string")
    scores = spark.createDataFrame([("j", "1", 0.123456)], "job_id string, field_id string, score double")
    got = {r.field_id: r for r in G.annotate(results, scores, G.source_index(docs)).collect()}
    assert (got["1"].rerank_score, got["1"].grounding) == (0.1235, "attested")
    assert (got["2"].rerank_score, got["2"].grounding, got["2"].value) == (0.0, None, " ")
    assert (got["3"].rerank_score, got["3"].error) == (None, "extraction_failed")


def test_anchors_of_a_needle_stand_in_every_text_that_holds_it(spark):
    """Hashes and their filter are one array step a text: no plan evaluates an expression for each anchor."""
    texts = ["vu le 3 mars 2019 par le docteur dupont", "a", "l4 l5 hernie discale " * 40, "日本 語 のテキスト 12 abc"]
    needles = [("3 mars 2019", True), ("rsparledocteurdup", False), ("a", True), ("hernie discale l4 l5 hernie", False), ("日本 語", True)]
    asked = spark.createDataFrame([("j", n, w) for n, w in needles], "job_id string, needle string, whole boolean")
    terms = asked.select("job_id", "needle", "whole", F.explode(G.needle_anchors("needle", "whole")).alias("anchor"))
    index = G.source_index(spark.createDataFrame([("j", i, "f", t) for i, t in enumerate(texts)], "job_id string, doc_no int, filename string, markdown string"))
    postings = G._postings(index, terms)
    assert "lambda" not in postings._jdf.queryExecution().optimizedPlan().toString()
    held = {(r.ord.doc_no, r.anchor) for r in postings.collect()}
    of = {}
    for r in terms.collect():
        of.setdefault((r.needle, r.whole), set()).add(r.anchor)
    found = {(n, i) for (n, w), anchors in of.items() for i in range(len(texts)) if all((i, a) in held for a in anchors)}
    assert set(of) == set(needles) and found == {("3 mars 2019", 0), ("rsparledocteurdup", 0), ("a", 1), ("hernie discale l4 l5 hernie", 2), ("日本 語", 3)}


def test_candidates_are_tested_as_by_matches(spark):
    docs = spark.createDataFrame([("j", i, "f", t) for i, t in enumerate(["abc def ghi jkl mno pqr", "abcdefghijklmnopqr", "xabc def"])],
                                 "job_id string, doc_no int, filename string, markdown string")
    index = G.source_index(docs)
    needles = [("abc def", True), ("abc def", False), ("cdefghijklmnopqr", False), ("bc", True), ("bc", False)]
    asked = spark.createDataFrame([("j", n, w) for n, w in needles], "job_id string, needle string, whole boolean")
    pairs = asked.crossJoin(index.select(F.struct("derived", "doc_no").alias("ord")))
    got = {(r.needle, r.whole, r.ord.doc_no) for r in G._holders(pairs, index).collect()}
    rows = asked.crossJoin(index.select("doc_no", "markdown")).where(G.matches(F.col("markdown"), F.col("needle"), F.col("whole")))
    assert got == {(r.needle, r.whole, r.doc_no) for r in rows.collect()} and len(got) == 8
