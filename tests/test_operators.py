"""Operators on their edge rows."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestary import wordings
from attestary.operators import admission as A, chunking as C, context as B, dossiers as D, evaluation as E
from attestary.operators import fill as W, pages as G, reports as R, responses as J, retrieval as K, templates as T


def words(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))


@pytest.mark.parametrize("n,parts", [(799, 1), (800, 1), (801, 2), (1400, 2), (1401, 3), (1500, 3), (2101, 4)])
def test_windows(spark, n, parts):
    df = spark.createDataFrame([(words(n).replace(" ", "\n", 3),)], "t string")
    (got,) = df.select(C.chunk_texts(F.col("t"))).first()
    assert len(got) == parts
    seen = []
    for i, w in enumerate(got):
        seen[i * 700:] = w.split()
    assert seen == words(n).split()


def test_headings(spark):
    docs = spark.createDataFrame([("j", 1, "a.md", "# T\nx\n#### no\n\n### B\ny\n##C")],
                                 "job_id string, doc_no int, filename string, markdown string")
    got = [r.text for r in C.chunk_documents(C.with_source_header(docs)).orderBy("part").collect()]
    assert got == ["--- SOURCE: a.md ---", "# T\nx\n#### no", "### B\ny\n##C"]


def test_chunk_numbers_are_dense_over_blocks(spark):
    rows = [("j", d, p) for d in (0, 3, 1023, 1024, 5000) for p in range(d % 3 + 1)] + [("k", 2, 0)]
    chunks = spark.createDataFrame(rows, "job_id string, doc_no int, part int")
    got = C.number_chunks(chunks).orderBy("job_id", "doc_no", "part").collect()
    assert [r.chunk_no for r in got if r.job_id == "j"] == list(range(sum(r.job_id == "j" for r in got)))


def test_page_rules(spark):
    pages = [("a" * 119, False), ("a" * 120, True), ("a" * 98 + "�" * 2 + "b" * 20, True), ("a" * 117 + "�" * 3, False), ("", False)]
    df = spark.createDataFrame(pages, "t string, want boolean")
    assert all(bool(r.got) == r.want for r in df.select("want", G.page_usable(F.col("t")).alias("got")).collect())
    rows = [("j", 1, i, "x" * 120 if i < 5 else "y") for i in range(1, 6)] + [("j", 2, None, None)]
    ratios = G.text_layer_ratio(spark.createDataFrame(rows, "job_id string, doc_no int, page_no int, text string"))
    got = {r.doc_no: (r.ratio, r.mode) for r in G.route_documents(ratios).collect()}
    assert got == {1: (0.8, "text_layer"), 2: (0.0, "ocr")}
    assert {r["mode"] for r in G.route_documents(ratios, force_ocr=True).collect()} == {"ocr"}


def test_batches_of_seven_in_first_seen_order(spark):
    ids = ["2.%d" % i for i in range(1, 9)] + ["1.1", "2.9", "1.2"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(ids)], "form_id string, ord int, field_id string")
    got = {r.field_id: r.batch_no for r in B.batch_fields(df).collect()}
    assert [got[x] for x in ids] == [0] * 7 + [1, 2, 1, 2]


def test_token_limit(spark):
    head = len("--- DOCUMENT : a ---\n\n")
    docs = spark.createDataFrame([("j", 0, "a", "x" * (112_003 - head)), ("k", 0, "a", "x" * (112_004 - head)), ("l", 0, "a", " \n")],
                                 "job_id string, doc_no int, filename string, markdown string")
    got = {r.job_id: (r.tokens, r.strategy) for r in B.synthesis_plan(docs).collect()}
    assert got == {"j": (28_000, "direct"), "k": (28_001, "hierarchical")}


def test_knn_blocks_equal_one_product(spark, monkeypatch):
    monkeypatch.setattr(K, "CHUNK_BLOCK", 7)
    monkeypatch.setattr(K, "QUESTION_BLOCK", 3)
    rng = np.random.default_rng(3)
    chunks, questions = rng.standard_normal((60, 8)), rng.standard_normal((10, 8))
    chunks[31] = chunks[30]
    row = "job_id string, {} bigint, embedding array<double>"
    c = spark.createDataFrame([("j", i, v.tolist()) for i, v in enumerate(chunks)], row.format("chunk_no"))
    q = spark.createDataFrame([("j", i, v.tolist()) for i, v in enumerate(questions)], row.format("field_id"))
    got = {}
    for r in K.knn(q, c, 5).orderBy("field_id", "rank").collect():
        got.setdefault(r.field_id, []).append(r.chunk_no)
    scores = np.round(questions @ chunks.T, 9)
    assert got == {i: sorted(range(60), key=lambda j: (-scores[i, j], j))[:5] for i in range(10)}


def test_lsh_finds_most_neighbours(spark):
    from attestary.plans import retrieve
    from attestary.plans.registry import Source
    s = Source(spark, "/root/testdata/sf0.001")
    exact = K.knn(s.shape(retrieve.QUESTIONS), s.shape(retrieve.VECTORS), 5).select("job_id", "field_id", "chunk_no")
    near = K.knn_lsh(s.shape(retrieve.QUESTIONS), s.shape(retrieve.VECTORS), 64, 5).select("job_id", "field_id", "chunk_no")
    assert exact.intersect(near).count() >= 0.6 * exact.count()


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01", "sf0.1"])
def test_lsh_recall_of_the_registered_k(spark, folder):
    from attestary.plans import retrieve
    from attestary.plans.registry import Source
    s = Source(spark, f"/root/testdata/{folder}")
    exact = K.knn(s.shape(retrieve.QUESTIONS), s.shape(retrieve.VECTORS)).select("job_id", "field_id", "chunk_no")
    near = K.knn_lsh(s.shape(retrieve.QUESTIONS), s.shape(retrieve.VECTORS), retrieve.LSH_DIM).select("job_id", "field_id", "chunk_no")
    assert exact.intersect(near).count() >= 0.9 * exact.count()


def test_model_callable_embeds_unit_vectors(spark):
    df = spark.createDataFrame([("ab",), ("c",)], "t string")
    got = K.embed(df, "t", lambda texts: np.array([[len(t), 1.0] for t in texts])).collect()
    assert all(abs(np.linalg.norm(r.embedding) - 1) < 1e-12 for r in got)


def test_responses(spark):
    batches = spark.createDataFrame([("j", b, f) for b in range(4) for f in ("1.1", "1.2")],
                                    "job_id string, batch_no int, field_id string")
    raw = spark.createDataFrame([("j", 0, '{"1.1": {"value": "a", "source_quote": "q"}, "1.2": "text"}'), ("j", 1, '{"1.1": {"va'), ("j", 2, None)],
                                "job_id string, batch_no int, raw string")
    got = {(r.batch_no, r.field_id): (r.value, r.error) for r in J.explode_responses(batches, raw).collect()}
    assert got[(0, "1.1")] == ("a", None) and got[(0, "1.2")] == (None, "field_missing_in_response")
    assert all(got[(b, f)] == (None, "extraction_failed") for b in (1, 2, 3) for f in ("1.1", "1.2"))


def test_infer_retries_then_gives_up(spark):
    def answer(prompt):
        raise ValueError(prompt)
    out = J.infer(spark.createDataFrame([("p",)], "prompt string"), answer, tries=3, pause=0.0)
    assert out.first().raw is None


def test_journal_saves_what_a_dying_task_has_answered(spark, tmp_path):
    """A task that dies after half of its prompts: the next run asks the other half only, and no answer is lost."""
    calls, journal = tmp_path / "calls", str(tmp_path / "journal")
    prompts = spark.createDataFrame([(i, f"prompt {i}") for i in range(120)], "no int, prompt string")

    def answer_until(limit):
        def answer(prompt):
            with open(calls, "a+") as f:
                f.seek(0)
                if len(f.readlines()) >= limit:
                    os._exit(1)
                f.write(prompt + "\n")
            return prompt.upper()
        return answer
    with pytest.raises(Exception):
        J.infer(prompts, answer_until(60), pause=0.0, tasks=1, journal=journal).collect()
    first = calls.read_text().splitlines()
    assert len(first) == 60
    kept = {r.raw for r in J.Journal(journal).known(spark).collect()}
    assert kept == {p.upper() for p in first[:len(kept)]} and len(first) - len(kept) < J.JOURNAL_BATCH
    got = J.infer(prompts, answer_until(10 ** 6), pause=0.0, tasks=1, journal=journal)
    assert {r.no: r.raw for r in got.collect()} == {i: f"PROMPT {i}" for i in range(120)}
    assert len(calls.read_text().splitlines()) == 60 + 120 - len(kept)
    assert len(got.collect()) == 120  # read once more: nothing is asked again
    assert len(calls.read_text().splitlines()) == 60 + 120 - len(kept)


def test_journal_asks_failures_again(spark, tmp_path):
    prompts = spark.createDataFrame([("a",), ("b",), (None,)], "prompt string")

    def some(prompt):
        if prompt != "a":
            raise RuntimeError
        return "one"
    assert {r.prompt: r.raw for r in J.infer(prompts, some, tries=1, journal=str(tmp_path)).collect()} == {"a": "one", "b": None, None: None}
    assert {r.prompt: r.raw for r in J.infer(prompts, lambda p: "two", tries=1, journal=str(tmp_path)).collect()} == {"a": "one", "b": "two", None: "two"}
    assert J.infer(prompts.where("false"), some, journal=str(tmp_path)).collect() == []


@pytest.mark.parametrize("size", [1, 40, 10 ** 6])
def test_synthesis_pieces_join_to_one_object(spark, size):
    """A job of thousands of entries: no cell holds it, and the pieces in order are the object of all entries."""
    rows = [("hot", i, f"d{i}", json.dumps({"a": [f"x{i}", {"n": i}], "b\"": "y", "c": None, "l": []}, ensure_ascii=False)) for i in range(700)]
    rows += [("hot", 900, None, '{"a": [1, null], "z": {"k": [2]}}'), ("hot", 901, "d", None), ("one", 1, "d", '{"a": 1}'), ("none", 1, "d", None),
             ("two", 1, "d", "{}"), ("two", 2, "d", "{}")]
    summaries = spark.createDataFrame(rows, "job_id string, doc_no int, filename string, summary string").repartition(5)
    got = B.synthesis_pieces(summaries, size).collect()
    assert {r.job_id for r in got} == {"hot", "one"}
    pieces = {j: [r.text for r in sorted((r for r in got if r.job_id == j), key=lambda r: r.piece_no)] for j in ("hot", "one")}
    assert pieces["one"] == ['{"a": 1}']
    whole = json.loads("".join(pieces["hot"]))
    assert [e["valeur"] for e in whole["a"]] == [v for i in range(700) for v in (f"x{i}", {"n": i})] + ["1"]
    assert [e["document_source"] for e in whole["b\""]] == [f"d{i}" for i in range(700)]
    assert [e["valeur"] for e in whole["z"]] == [{"k": [2]}] and set(whole) == {"a", "b\"", "z"}
    assert size > 1000 or max(map(len, pieces["hot"])) < size + 200
    merged = {r.job_id: r.synthesis for r in B.merged_synthesis(summaries.select("job_id").distinct(), summaries).collect()}
    assert merged == {"hot": "".join(pieces["hot"]), "one": '{"a": 1}', "none": None, "two": None}
    small = {r.job_id: r.synthesis for r in B.merged_synthesis(summaries.select("job_id").distinct(), summaries, limit=10).collect()}
    assert small == {"hot": None, "one": '{"a": 1}', "none": None, "two": None}


def test_overlap_is_that_of_every_pair(spark):
    near = spark.createDataFrame([("j", "1", 0, 1), ("j", "2", 0, 2), ("j", "1", 1, 2), ("k", "2", 0, 1)], "job_id string, field_id string, chunk_no int, rank int")
    questions = spark.createDataFrame([("1", ["le", "genou"]), ("2", ["dos"]), ("3", ["x"])], "field_id string, _q array<string>")
    chunks = spark.createDataFrame([("j", 0, "Le dos, LE GENOU"), ("j", 1, "genou"), ("k", 0, None), ("k", 7, "dos")], "job_id string, chunk_no int, text string")
    got = {(r.job_id, r.field_id, r.chunk_no): (r["rank"], r.rerank_score) for r in K.overlap_candidates(near, questions, chunks).collect()}
    assert got == {("j", "1", 0): (1, 1.0), ("j", "2", 0): (2, 1.0), ("j", "1", 1): (2, 0.5), ("k", "2", 0): (1, None)}


def test_nearest_ancestor_decides_the_wording(spark):
    nodes = spark.createDataFrame([("f", 1, "code", ["form", "patientS1Address", "adiagnosisS1Struct"]), ("f", 2, "lastName", ["employerS1Address", "gpS1Address", "x"]),
                                   ("f", 3, "lastName", ["x"]), ("f", 4, "unknown", []), ("f", 5, "lastName", [])],
                                  "form_id string, node int, name string, ancestors array<string>")
    got = {r.node: (r.question, r.vocab_type) for r in T.describe(nodes, *T.standard_vocabularies(spark)).collect()}
    assert got[1][0] == wordings.CONTEXT_QUESTIONS["diagnosisS1Struct", "code"][0].replace("{role}", "du patient")
    assert got[2][0].endswith("du médecin de famille ?")
    assert got[3] == got[5] == ("", None) and got[4] == ("", None)


def test_job_limits(spark):
    forms = spark.createDataFrame([("f",)], "form_id string")
    requests = spark.createDataFrame([("a", "f", 200), ("b", "f", 201), ("c", "x", 999)], "job_id string, form_id string, n_files int")
    for active, want in ((19, [None, "too_many_files", "unknown_form"]), (20, ["saturated", "saturated", "unknown_form"])):
        jobs = spark.range(active).select(F.lit("pending").alias("status"))
        assert [r.reason for r in A.admit_jobs(requests, jobs, forms).orderBy("job_id").collect()] == want


def test_coverage_gate_at_half(spark):
    rows = [("h", "fillable")] * 1 + [("h", "unmatched")] + [("l", "fillable")] * 49 + [("l", "unmatched")] * 51 + [("n", "skipped")]
    got = {r.form_id: r.accepted for r in A.coverage_gate(spark.createDataFrame(rows, "form_id string, state string")).collect()}
    assert got == {"h": True, "l": False, "n": False}


@pytest.mark.parametrize("n", [0, 1, 20, 21])
def test_run_summary(spark, n):
    runs = spark.createDataFrame([(i, "f", 0, float(i)) for i in range(n)] + [(99, "g", 3, None)],
                                 "log_no int, form_id string, documents int, seconds double")
    got = {r.form_id: r for r in R.run_summary(runs).collect()}
    assert got["g"].runs == 0 and got["g"].average_seconds is None
    if n:
        last = list(range(n))[-20:]
        assert got["f"].runs == n and got["f"].last_seconds == n - 1
        assert got["f"].recent_average_seconds == sum(last) / len(last)
        assert got["f"].average_seconds_per_document is None
        assert got[None].average_seconds_per_document == pytest.approx(round(sum(range(n)) / 3, 1))


def test_compare_quirks(spark):
    rows = [("exact", "F", "Féminin", None, True), ("exact", "50", "50%", None, True), ("fuzzy", "x", "   ", None, True),
            ("contains", None, "abc", None, True), ("contains", None, "abc", ["B", "z"], False), ("other", "a", "a", None, False),
            ("date", "1.2.2025", "1/2/2025", None, True), ("exact", "a", None, None, False), (None, "a", " A ", None, True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "i int, tolerance string, expected string, value string, keywords array<string>, want boolean")
    got = E.compare(df.withColumn("category", F.lit("c"))).orderBy("i").collect()
    assert [r.match for r in got] == [r[4] for r in rows]
    assert got[4].keywords_found == ["B"] and got[4].reason == "Mots-clés manquants: ['z']"


def test_canton_wins_and_reruns_do_not(spark):
    row = "job_id string, ord int, xml_path string, acroform_name string, value string"
    extracted = spark.createDataFrame([("j", 1, "p", "a", "x1"), ("j", 2, "p", "b", "x2")], row)
    canton = spark.createDataFrame([("j", 0, "p", "a", "canton")], row)
    got = {(r.target, r.name): r.value for r in W.resolve_targets(extracted, None, canton).collect()}
    assert got == {("xml_path", "p"): "canton", ("acroform_name", "a"): "canton", ("acroform_name", "b"): "x2"}
    got = {(r.target, r.name): r.value for r in W.resolve_targets(extracted).collect()}
    assert got[("xml_path", "p")] == "x2"


def test_corpus_is_repeatable_and_complete(spark):
    requests = spark.createDataFrame([("j", 7, 2), ("k", 1, 0)], "job_id string, count int, noise int")
    plan = D.corpus_plan(requests, ["a", "b", "c"])
    assert [r.style for r in plan.where("job_id = 'j'").orderBy("doc_no").collect()] == ["a"] * 3 + ["b"] * 2 + ["c"] * 2 + [None] * 2
    assert plan.where("job_id = 'k'").count() == 3
    truth = spark.createDataFrame([("j", "1.1", "NE"), ("k", "1.1", None)], "job_id string, field_id string, expected string")
    templates = spark.createDataFrame([(s, s + " {1.1}!") for s in "abc"], "style string, template string")
    noise = spark.createDataFrame([(i, f"n{i}") for i in range(5)], "no int, text string")
    one, two = (sorted(map(tuple, D.make_corpus(plan, truth, templates, noise).collect()), key=repr) for _ in range(2))
    assert one == two and {r[5] for r in one if r[0] == "j" and r[2] == "patient"} == {"a NE!", "b NE!", "c NE!"}
    assert all(r[5].startswith("n") for r in one if r[2] == "noise")


def test_duplicate_siblings_get_indices(spark):
    rows = [("f", 1, None, 1, "form"), ("f", 2, 1, 2, "phone"), ("f", 3, 1, 3, "phone"), ("f", 4, 3, 4, "x")]
    nodes = spark.createDataFrame(rows, "form_id string, node int, parent int, ord int, name string")
    got = {r.node: r.xml_path for r in T.node_paths(nodes).collect()}
    assert got == {1: "form", 2: "form/phone", 3: "form/phone[1]", 4: "form/phone[1]/x"}


def test_canton_table_skips_empty_cases_and_markup(spark):
    from attestary.operators import templates
    script = ("switch (c) {<br/>case 'VD': {a.companyName.rawValue=&quot;Office &amp; VD&quot;;} break;"
              "case 'VD': {} break; case 'GE': {a.zip.rawValue = \"1200\"; a.zip.rawValue = \"1201\";} break; }")
    got = templates.canton_table(spark.createDataFrame([("F", script)], "form_id string, script string")).collect()
    assert sorted((r.canton, r["name"], r.value) for r in got) == [("GE", "zip", "1201"), ("VD", "companyName", "Office & VD")]


def test_dense_numbers_of_null_groups(spark):
    from attestary.operators.numbering import number_rows
    rows = [(None, "a", i) for i in range(3000)] + [("g", None, i) for i in range(5)]
    got = number_rows(spark.createDataFrame(rows, "g string, h string, o int"), ["g", "h"], "o", "n").collect()
    assert len(got) == 3005 and all(r.n == r.o for r in got)


def test_corpus_requests_are_counted_apart(spark, tmp_path):
    """The counts are those of the shaping SQL, null and repeated keys included, and no customer meets a supplier."""
    from attestary.operators.dossiers import corpus_plan
    from attestary.plans import scoring
    from attestary.plans.registry import Source
    spark.createDataFrame([(0,), (1,), (1,), (2,), (None,)], "n_nationkey long").write.parquet(str(tmp_path / "nation.parquet"))
    spark.createDataFrame([(1, 0), (2, 0), (2, 0), (None, 0), (3, 1), (4, None), (5, 9)], "c_custkey long, c_nationkey long") \
        .write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(7, 0), (8, 0), (8, 1), (9, None)], "s_suppkey long, s_nationkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    s = Source(spark, str(tmp_path))
    got = scoring.requests(s)
    assert sorted(map(str, got.collect())) == sorted(map(str, s.shape(scoring.REQUESTS).collect()))
    lines = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    tables = [i for i, line in enumerate(lines) if "Relation" in line]
    aggregates = [i for i, line in enumerate(lines) if line.strip(" :+-").startswith("Aggregate")]
    # each table is grouped on its own, below the joins
    assert len(tables) == 3 and all(any(a < t and not any(a < o < t for o in tables) for a in aggregates) for t in tables)
    one = spark.createDataFrame([(1, 20_000, 5_000)], "job_id long, count long, noise long")
    plan = corpus_plan(one, scoring.STYLES)
    assert [r[0] for r in plan.select("doc_no").orderBy("doc_no").collect()] == list(range(1, 25_001))
    assert plan.select(F.spark_partition_id()).distinct().count() > 1  # before, one task made them all


def test_nearest_chunks_come_from_few_blocks(spark, monkeypatch):
    """However far apart the numbers of a job's chunks are, a question is scored in as many blocks as the chunks fill."""
    rng = np.random.default_rng(5)
    chunks = spark.createDataFrame([("j", i * 1000, rng.random(4).tolist()) for i in range(40)], "job_id string, chunk_no long, embedding array<double>")
    asked = spark.createDataFrame([("j", "q", rng.random(4).tolist())], "job_id string, field_id string, embedding array<double>")
    seen, rank_top = [], K.rank_top
    monkeypatch.setattr(K, "rank_top", lambda scored, *a: seen.append(scored.count()) or rank_top(scored, *a))
    assert K.knn(asked, chunks, 5).count() == 5 and seen == [5]  # before, 40 rows from 40 blocks


def test_numbering_moves_rows_once(spark):
    from attestary.operators.numbering import number_rows
    kept = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k) for k in kept}
    try:
        for k, v in kept.items():
            spark.conf.set(k, v)
        plan = number_rows(spark.range(10).selectExpr("id % 2 AS g", "id AS o"), ["g"], "o", "n")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    # one for the rows; the blocks' counts are summed, accumulated and brought to the rows
    assert plan.count("Exchange hashpartitioning") == 4, plan


def test_queries_bound_their_batches(spark):
    from attestary.plans import registry
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    was = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in zip(keys, ("10000", "64m")):
            spark.conf.set(k, v)
        registry.query("probe")(lambda s: s.spark.range(1))
        registry.QUERIES["probe"](spark, "none")
        assert [int(spark.conf.get(k).rstrip("bm")) for k in keys] in ([2000, 8], [2000, 8 << 20])
    finally:
        registry.QUERIES.pop("probe", None)
        for k, v in was.items():
            spark.conf.set(k, v)
