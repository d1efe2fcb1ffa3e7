"""What queries leave on disk and move, and that moving less gives the same rows."""

import random

import numpy as np
import pytest

from attestary.operators import context as B, fill as W, retrieval as K
from attestary.session import stage


def shuffled(spark):
    """Names and sizes of the shuffle files that are there now."""
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {f.getName(): f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().endswith(".data")}


def test_a_staged_table_leaves_no_shuffle(spark):
    there = set(shuffled(spark))
    rows = spark.range(5000).selectExpr("id % 7 AS g", "id AS o")
    kept = stage(rows.repartition(5, "o").groupBy("g").agg({"o": "max"}), "probe")
    assert not set(shuffled(spark)) - there  # before, two shuffles stayed until the driver collected its garbage
    assert kept.count() == 7


def walked(elements, path):
    """The rule, by hand: rows in document order, null order numbers first."""
    rows = sorted(elements, key=lambda e: (e[4] is not None, e[4]))
    at = None
    for seg in [s for s in path.split("/") if s]:
        tag, _, rest = seg.partition("[")
        index = int(rest[:-1]) if rest else 0
        if at is None:
            found = [e for e in rows if e[3] == tag]
            at = found if index == 0 else found[index:index + 1] if index > 0 else []
        else:
            kids = [[e for e in rows if e[2] is not None and e[2] == a[1] and e[3] == tag] for a in at]
            at = [k[index] for k in kids if 0 <= index < len(k)]
    return min(at, key=lambda e: (e[4] is not None, e[4]))[1] if at else None


PATHS = ["a", "/a/", "a[1]", "a[2]/b", "a/b[1]", "a/b/c", "b[1]/c[1]/a", "c/a[2]", "a[-1]", "a/b[-1]", "a[99999999999]", "z", "a/z", "", "/", "c[3]/b/a[1]/c", "a/b[99999999999]"]


@pytest.mark.parametrize("limit", [1000, 1])
def test_paths_lead_where_the_rule_says(spark, monkeypatch, limit):
    monkeypatch.setattr(W, "GROUP_LIMIT", limit)  # numbers of the first rows, or of all
    draw = random.Random(4)
    elements, forms = [], [1, 2, 3, None]
    for form in forms:
        for i in range(150):
            parent = None if i == 0 else f"n{draw.randrange(i)}"
            elements.append((form, f"n{i}", parent, draw.choice("abc") if i % 20 else None, None if i == 7 else i * 10))
    elements += [e for e in elements if e[1] == "n31"]  # a row that comes twice is two occurrences
    tree = spark.createDataFrame(elements, "form_id int, node string, parent string, tag string, ord long")
    asked = spark.createDataFrame([(f, p) for f in [*forms, 9] for p in [*PATHS, None, "a"]], "form_id int, path string")
    got = sorted((r.form_id, r.path, r.node) for r in W.match_paths(tree, asked).collect())
    want = [(f, p, walked([e for e in elements if e[0] == f], p)) for f in (1, 2, 3) for p in PATHS if p.strip("/") and "999" not in p]
    assert got == sorted(w for w in want if w[2]) and len(got) > 12


def test_paths_move_few_elements(spark, monkeypatch):
    """Plans are read without broadcasts of the tree, as they are for large ones."""
    tree = spark.range(60_000).selectExpr("id % 4 AS form_id", "concat('n', id) AS node", "concat('n', id % 4) AS parent",
                                          "CASE WHEN id < 4 THEN 'top' WHEN id < 30000 THEN 'leaf' ELSE 'other' END AS tag", "id AS ord")
    asked = spark.createDataFrame([(f, p) for f in range(4) for p in ("top/leaf[1]", "leaf[2]", "leaf")], "form_id long, path string")
    plans, kept = [], {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "64k"}
    was = {k: spark.conf.get(k) for k in kept}
    monkeypatch.setattr(W, "stage", lambda df, *a: plans.append(df) or stage(df, *a))
    try:
        for k, v in kept.items():
            spark.conf.set(k, v)
        plans.append(W.match_paths(tree, asked))
        moves = [df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for df in plans]
        got = {(r.form_id, r.path): r.node for r in plans[-1].collect()}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == {(f, p): f"n{f + 4 * n}" for f in range(4) for p, n in (("top/leaf[1]", 2), ("leaf[2]", 3), ("leaf", 1))}
    assert max(moves) <= 3, moves  # before, ten to number the tree


def test_chunks_move_once_however_many_questions(spark, monkeypatch):
    monkeypatch.setattr(K, "QUESTION_BLOCK", 20)
    monkeypatch.setattr(K, "PAIRS", 1_000_000, raising=False)
    rng = np.random.default_rng(8)
    vectors, questions = rng.standard_normal((4000, 64)), rng.standard_normal((400, 64))
    chunks = spark.createDataFrame([("j", i, v) for i, v in enumerate(vectors.tolist())], "job_id string, chunk_no long, embedding array<double>")
    asked = spark.createDataFrame([("j", i, v) for i, v in enumerate(questions.tolist())], "job_id string, field_id long, embedding array<double>")
    before = set(shuffled(spark))
    near = K.knn(asked, chunks, 3)
    got = {(r.field_id, r["rank"]): r.chunk_no for r in near.collect()}
    new = sum(size for name, size in shuffled(spark).items() if name not in before)
    assert new < 3 * vectors.nbytes, new  # before, each vector was copied for every block of questions, 20 times
    scores = np.round(questions @ vectors.T, 9)
    assert got == {(i, n + 1): int(j) for i in range(400) for n, j in enumerate(np.argsort(-scores[i], kind="stable")[:3])}


def test_parts_and_blocks_leave_the_ranks(spark, monkeypatch):
    """Many ties, chunks and questions that come twice, rows without a vector or a job, jobs of one side only, fewer chunks than asked for."""
    monkeypatch.setattr(K, "CHUNK_BLOCK", 9)
    monkeypatch.setattr(K, "QUESTION_BLOCK", 4)
    monkeypatch.setattr(K, "PAIRS", 300)
    rng = np.random.default_rng(2)
    chunks = [(j, 3 * i, rng.integers(0, 3, 4).astype(float).tolist()) for j, n in (("a", 130), ("b", 4), ("c", 20)) for i in range(n)]
    asked = [(j, f, rng.integers(0, 3, 4).astype(float).tolist()) for j, n in (("a", 17), ("b", 5), ("d", 3)) for f in (*map(str, range(n)), None)]
    chunks += [chunks[5], chunks[131], ("a", None, [1.0] * 4), (None, 1, [1.0] * 4), ("a", 1, None)]
    asked += [asked[0], (None, "1", [1.0] * 4), ("b", "none", None)]
    got = K.knn(spark.createDataFrame(asked, "job_id string, field_id string, embedding array<double>").repartition(3),
                spark.createDataFrame(chunks, "job_id string, chunk_no int, embedding array<float>").repartition(5), 7).collect()
    want = []
    for j, f in dict.fromkeys((j, f) for j, f, v in asked if j and v):
        scored = sorted((-float(np.dot(q, v)), no) for jq, fq, q in asked if (jq, fq) == (j, f) for jc, no, v in chunks if jc == j and no is not None and v)
        want += [(j, f, no, -s, n) for n, (s, no) in enumerate(scored[:7], 1)]
    order = lambda r: (r[0], str(r[1]), r[4])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def test_a_chat_moves_its_contexts_once(spark):
    """What is given stays where it was made; the question meets the history."""
    requests = spark.createDataFrame([(1, "q1", None, "", "c"), (2, "q2", "s", None, None), (3, "q3", None, None, ""), (3, "q4", None, None, "d")],
                                     "conv_id int, question string, synthesis string, fields_context string, context string")
    history = spark.createDataFrame([(1, 0, "user", "h0"), (1, 1, "assistant", "h1"), (3, 0, "user", "h2")], "conv_id int, turn int, role string, text string")
    out = B.chat_messages(requests, history)
    got = sorted((r.conv_id, r.seq, r.role, r.content[-2:]) for r in out.where("seq > 0").collect())
    assert got == sorted([(1, 1, "user", "\nc"), (1, 2, "assistant", B.CHAT_READY[-2:]), (1, 3, "user", "h0"), (1, 4, "assistant", "h1"), (1, 5, "user", "q1"),
                          (2, 1, "user", "\ns"), (2, 2, "assistant", B.CHAT_READY[-2:]), (2, 3, "user", "q2"),
                          (3, 1, "user", "h2"), (3, 2, "user", "q3"), (3, 1, "user", "\nd"), (3, 2, "assistant", B.CHAT_READY[-2:]), (3, 3, "user", "h2"), (3, 4, "user", "q4")])
    given = out._jdf.queryExecution().optimizedPlan().children().apply(0).toString()
    assert "Join" not in given, given  # before, what is given was shuffled once more, to learn how long the history is
