"""Grounding plans: benchmark items are the answers, documents the sources, a source a dossier."""

from pyspark.sql import DataFrame, functions as F

from attestary.functions.text import norm
from attestary.operators import context as B, grounding as G, pages as P, reports as R
from attestary.plans.registry import Source, plain, query
from attestary.plans.texts import ASSEMBLED, DOCS, NORM, PAGES, page_rows

# Dossiers have one of two forms, both with the benchmark items as fields. The five kinds of answer: value in
# its quote, value nowhere, quote made of a real and an invented part, one-letter value, invented quote.
RESULTS = """
SELECT job_id, item_id AS field_id,
  CASE item_id % 5 WHEN 1 THEN 'zzq unbekannt' WHEN 3 THEN substr(text, 1, 1)
    WHEN 4 THEN concat_ws(' ', split_part(text, ' ', 2), split_part(text, ' ', 3))
    ELSE concat_ws(' ', split_part(text, ' ', 1), split_part(text, ' ', 2), split_part(text, ' ', 3)) END AS value,
  CASE item_id % 5 WHEN 2 THEN concat('Zzq qxw invented part; ', substr(text, 1, 60), ' xqz. Nothing of it')
    WHEN 4 THEN 'zzq completely invented quote' ELSE text END AS source_quote
FROM (SELECT DISTINCT source AS job_id, length(source) % 2 AS form_id FROM {documents}) j
JOIN (SELECT *, 0 AS form_id FROM {benchmark} UNION ALL SELECT *, 1 AS form_id FROM {benchmark}) b USING (form_id)"""

MATCH = """CASE WHEN length(replace(needle, ' ', '')) >= 16 THEN contains(replace(n, ' ', ''), replace(needle, ' ', ''))
  WHEN whole THEN contains(' ' || n || ' ', ' ' || needle || ' ') ELSE contains(n, needle) END"""


def ground_sql(derived: str) -> str:
    """Brute force: every needle against every document of its job."""
    return rf"""
d AS (SELECT source AS job_id, {derived} AS derived, doc_id, {NORM.format('text')} AS n FROM documents),
r AS (SELECT *, {NORM.format('value')} AS vn, {NORM.format('source_quote')} AS qn FROM ({plain(RESULTS)}) x),
seg AS (SELECT job_id, field_id, generate_subscripts(l, 1) AS pos, unnest(l) AS raw FROM (
  SELECT job_id, field_id, regexp_split_to_array(source_quote, '[;.][\s\p{{Z}}]+|\n+') AS l FROM r) t),
a AS (SELECT job_id, field_id, 0 AS kind, 0 AS pos, qn AS needle, length(qn) < 12 AS whole FROM r WHERE length(qn) >= 4
  UNION ALL SELECT job_id, field_id, 1, pos, needle, length(needle) < 12 FROM (SELECT *, {NORM.format('raw')} AS needle FROM seg) s WHERE length(needle) >= 4
  UNION ALL SELECT job_id, field_id, 2, 0, vn, true FROM r WHERE length(vn) >= 2),
h AS (SELECT a.job_id, needle, whole, min(struct_pack(derived := derived, doc_id := doc_id)) AS ord
  FROM (SELECT DISTINCT job_id, needle, whole FROM a) a JOIN d ON a.job_id = d.job_id AND {MATCH} GROUP BY ALL),
best AS (SELECT job_id, field_id, min(h.ord) FILTER (WHERE kind = 0) AS q,
    arg_min(h.ord, struct_pack(l := -length(needle), pos := pos)) FILTER (WHERE kind = 1) AS s,
    min(h.ord) FILTER (WHERE kind = 2) AS v FROM a JOIN h USING (job_id, needle, whole) GROUP BY ALL),
j AS (SELECT r.job_id, r.field_id, value, coalesce(q, s) AS qh, q, v, length(vn) >= 2 AS checkable,
    q IS NOT NULL AND length(vn) >= 2 AND contains(' ' || qn || ' ', ' ' || vn || ' ') AS inq
  FROM r LEFT JOIN best USING (job_id, field_id)),
g AS (SELECT job_id, field_id, value, qh IS NOT NULL AS quote_verified,
    CASE WHEN checkable AND NOT inq AND v IS NOT NULL THEN v ELSE qh END AS anchor,
    CASE WHEN NOT checkable THEN CASE WHEN qh IS NOT NULL THEN 'not_checkable' ELSE 'unverified' END
      WHEN inq THEN CASE WHEN qh.derived THEN 'inferred' ELSE 'verified' END
      WHEN v IS NOT NULL THEN CASE WHEN v.derived THEN 'inferred' ELSE 'attested' END
      WHEN qh IS NOT NULL THEN 'inferred' ELSE 'unverified' END AS grounding FROM j)"""


def _index(s: Source) -> DataFrame:
    return G.store_index(G.source_index(s.shape(DOCS)))


@query("ground_verdicts", f"""
WITH {ground_sql('false')}
SELECT job_id, field_id, grounding, quote_verified, anchor.doc_id AS doc_no FROM g""")
def ground_verdicts(s: Source) -> DataFrame:
    out = G.ground(s.shape(RESULTS), _index(s), anchors=False)
    return out.select("job_id", "field_id", "grounding", "quote_verified", F.col("ord.doc_no").alias("doc_no"))


@query("ground_derived", f"""
WITH {ground_sql("lang = 'en'")}
SELECT job_id, field_id, grounding, anchor.derived AS derived, anchor.doc_id AS doc_no FROM g""")
def ground_derived(s: Source) -> DataFrame:
    """The English documents count as derived texts: nothing found only there is proof."""
    docs = s.shape(DOCS.replace("text AS markdown", "text AS markdown, lang"))
    index = G.source_index(docs.where("lang <> 'en'"), docs.where("lang = 'en'"))
    out = G.ground(s.shape(RESULTS), index, anchors=False)
    return out.select("job_id", "field_id", "grounding", F.col("ord.derived").alias("derived"),
                      F.col("ord.doc_no").alias("doc_no"))


@query("locate_quotes", f"""
WITH {ground_sql('false')}
SELECT job_id, field_id, qh.doc_id AS doc_no, q IS NULL AS partial FROM j WHERE qh IS NOT NULL""")
def locate_quotes(s: Source) -> DataFrame:
    found = G.locate_quote(s.shape(RESULTS), _index(s))
    return found.select("job_id", "field_id", "doc_no", "partial")


NEEDLES = """
SELECT DISTINCT job_id, raw, whole FROM (
  SELECT job_id, concat_ws(' ', split_part(text, ' ', 4), split_part(text, ' ', 5)) AS raw, item_id % 2 = 0 AS whole FROM ({x}) a
  UNION ALL SELECT job_id, replace(substr(text, 1, 40), ' ', ''), false FROM ({x}) b
  UNION ALL SELECT job_id, substr(text, 5, 14), false FROM ({x}) c
  UNION ALL SELECT job_id, split_part(text, ' ', 3), true FROM ({x}) d
  UNION ALL SELECT job_id, substr(text, 3, 80), true FROM ({x}) e) n""".replace("{x}", """
  SELECT job_id, item_id, text FROM (SELECT DISTINCT source AS job_id, length(source) % 2 AS form_id FROM {documents}) j
  JOIN (SELECT *, 0 AS form_id FROM {benchmark} UNION ALL SELECT *, 1 AS form_id FROM {benchmark}) b USING (form_id)""")


@query("find_needles", rf"""
WITH d AS (SELECT source AS job_id, doc_id, {NORM.format('text')} AS n FROM documents),
a AS (SELECT DISTINCT job_id, needle, whole OR length(needle) < 12 AS whole
  FROM (SELECT job_id, {NORM.format('raw')} AS needle, whole FROM ({plain(NEEDLES)}) x) y WHERE needle <> '')
SELECT a.job_id, needle, whole, min(doc_id) AS doc_no FROM a JOIN d ON a.job_id = d.job_id AND {MATCH} GROUP BY ALL""")
def find_needles(s: Source) -> DataFrame:
    asked = s.shape(NEEDLES).select("job_id", norm(F.col("raw")).alias("needle"), "whole")
    return G.find(asked, _index(s)).select("job_id", "needle", "whole", F.col("ord.doc_no").alias("doc_no"))


# Documents of pages, each line one, with a line that holds a date in words; some answers are dates in other spellings.
MONTH = "split_part('janvier,février,mars,avril,mai,juin,juillet,août,septembre,octobre,novembre,décembre', ',', CAST({} % 12 + 1 AS INT))"
SEEN = f"concat('Vu le ', CAST({{0}} % 28 + 1 AS STRING), ' ', {MONTH.format('{0}')}, ' 2019')"
DATED = f"SELECT doc_id, source, concat(text, chr(10), {SEEN.format('doc_id')}) AS text FROM {{documents}}"
DAY, MONTH_NO = ("lpad(CAST(field_id % {} + 1 AS STRING), 2, '0')".format(n) for n in (28, 12))
DATED_RESULTS = f"""
SELECT job_id, field_id, field_id % 5 = 0 AS dated,
  CASE field_id % 10 WHEN 0 THEN concat('2019-', {MONTH_NO}, '-', {DAY}) WHEN 5 THEN concat({DAY}, '/', {MONTH_NO}, '/2019') ELSE value END AS value,
  CASE field_id % 10 WHEN 0 THEN {SEEN.format('field_id')} ELSE source_quote END AS source_quote
FROM ({RESULTS}) r"""


def annotated(s: Source) -> DataFrame:
    results = s.shape(DATED_RESULTS).withColumn("error", F.when(F.col("field_id") % 11 == 0, "extraction_failed")) \
        .withColumn("value", F.when(F.col("field_id") % 7 != 0, F.col("value")))
    scores = results.where("field_id % 3 > 0").select(
        "job_id", "field_id", (F.col("field_id") / 7).alias("score"))
    docs = P.assemble_document(page_rows(s, s.shape(DATED))).withColumn(
        "filename", F.concat(F.lit("doc"), F.col("doc_no").cast("string"), F.lit(".pdf")))
    return G.annotate(results.drop("dated"), scores, G.store_index(G.source_index(docs)))


PAGED = PAGES.replace("FROM documents", f"FROM ({plain(DATED)}) x")
# The spellings of a date after its own: with points, in words, with and without zeros.
SPELLED = f"""[ {DAY} || '.' || {MONTH_NO} || '.2019', (field_id % 28 + 1) || '.' || (field_id % 12 + 1) || '.2019',
    (field_id % 28 + 1) || ' ' || {MONTH.format('field_id')} || ' 2019', {DAY} || ' ' || {MONTH.format('field_id')} || ' 2019']"""
ANNOTATED = rf"""
pg AS ({PAGED}),
d AS (SELECT job_id, doc_no, markdown, {NORM.format('markdown')} AS n FROM ({ASSEMBLED.replace(f'({PAGES}) p', 'pg')}) x),
r AS (SELECT *, {NORM.format('value')} AS vn, {NORM.format('source_quote')} AS qn FROM (
    SELECT job_id, field_id, dated, CASE WHEN field_id % 7 <> 0 THEN value END AS value, source_quote FROM ({plain(DATED_RESULTS)}) y) x
  WHERE field_id % 11 <> 0 AND field_id % 7 <> 0),
seg AS (SELECT job_id, field_id, generate_subscripts(l, 1) AS pos, unnest(l) AS raw FROM (
  SELECT job_id, field_id, regexp_split_to_array(source_quote, '[;.][\s\p{{Z}}]+|\n+') AS l FROM r) t),
vs AS (SELECT job_id, field_id, generate_subscripts(l, 1) AS pos, unnest(l) AS raw FROM (
  SELECT job_id, field_id, {SPELLED} AS l FROM r WHERE dated) t),
a AS (SELECT job_id, field_id, 0 AS kind, 0 AS pos, qn AS needle, length(qn) < 12 AS whole FROM r WHERE length(qn) >= 4
  UNION ALL SELECT job_id, field_id, 1, pos, needle, length(needle) < 12 FROM (SELECT *, {NORM.format('raw')} AS needle FROM seg) s WHERE length(needle) >= 4
  UNION ALL SELECT job_id, field_id, 2, 0, vn, true FROM r WHERE length(vn) >= 2
  UNION ALL SELECT job_id, field_id, 2, pos, {NORM.format('raw')}, true FROM vs),
h AS (SELECT a.job_id, needle, whole, min(doc_no) AS doc_no
  FROM (SELECT DISTINCT job_id, needle, whole FROM a) a JOIN d ON a.job_id = d.job_id AND {MATCH} GROUP BY ALL),
hit AS (SELECT job_id, field_id, kind, pos, needle, struct_pack(doc_no := h.doc_no, needle := needle, whole := whole) AS spot FROM a JOIN h USING (job_id, needle, whole)),
best AS (SELECT job_id, field_id, arg_min(spot, pos) FILTER (WHERE kind = 0) AS q,
    arg_min(spot, struct_pack(l := -length(needle), pos := pos)) FILTER (WHERE kind = 1) AS s, arg_min(spot, pos) FILTER (WHERE kind = 2) AS v FROM hit GROUP BY ALL),
inq AS (SELECT job_id, field_id, bool_or(contains(' ' || qn || ' ', ' ' || needle || ' ')) AS inq FROM r JOIN a USING (job_id, field_id) WHERE kind = 2 GROUP BY ALL),
j AS (SELECT r.job_id, r.field_id, value, coalesce(q, s) AS qh, v, length(vn) >= 2 AS checkable, q IS NOT NULL AND coalesce(inq, false) AS proven
  FROM r LEFT JOIN best USING (job_id, field_id) LEFT JOIN inq USING (job_id, field_id)),
g AS (SELECT job_id, field_id, qh IS NOT NULL AS quote_verified, CASE WHEN checkable AND NOT proven AND v IS NOT NULL THEN v ELSE qh END AS anchor,
    CASE WHEN NOT checkable THEN CASE WHEN qh IS NOT NULL THEN 'not_checkable' ELSE 'unverified' END WHEN proven THEN 'verified'
      WHEN v IS NOT NULL THEN 'attested' WHEN qh IS NOT NULL THEN 'inferred' ELSE 'unverified' END AS grounding FROM j),
n AS (SELECT r.job_id, r.field_id, CASE WHEN r.field_id % 11 = 0 THEN 'extraction_failed' END AS error,
    CASE WHEN r.field_id % 7 <> 0 THEN r.value END AS value, r.source_quote,
    CASE WHEN r.field_id % 11 <> 0 THEN round_even(CASE WHEN r.field_id % 3 > 0 THEN r.field_id / 7 ELSE 0 END, 4) END AS rerank_score,
    grounding, quote_verified, 'doc' || anchor.doc_no || '.pdf' AS source_document, anchor
  FROM ({plain(DATED_RESULTS)}) r LEFT JOIN g ON r.job_id = g.job_id AND r.field_id = g.field_id)"""
# Where an anchor stands: its place in the normal form, through the offset of each normal character, to the text and page.
PLACED = rf"""{ANNOTATED},
t AS (SELECT DISTINCT job_id, anchor.doc_no AS doc_no, anchor.needle AS needle, anchor.whole AS whole FROM n WHERE anchor IS NOT NULL),
ch AS (SELECT job_id, doc_no, unnest(string_split(markdown, '')) AS ch, generate_subscripts(string_split(markdown, ''), 1) - 1 AS pos
  FROM d SEMI JOIN t ON d.job_id = t.job_id AND d.doc_no = t.doc_no),
solid AS (SELECT job_id, doc_no, pos, regexp_matches(strip_accents(lower(ch)), '[\p{{L}}\p{{N}}]') AS solid FROM ch),
ends AS (SELECT *, lag(solid) OVER (PARTITION BY job_id, doc_no ORDER BY pos) AS after, max(CASE WHEN solid THEN pos END) OVER (PARTITION BY job_id, doc_no) AS last FROM solid),
kept AS (SELECT job_id, doc_no, pos, solid, row_number() OVER (PARTITION BY job_id, doc_no ORDER BY pos) AS place_no,
    count(*) FILTER (solid) OVER (PARTITION BY job_id, doc_no ORDER BY pos) AS tight FROM ends WHERE (solid OR after) AND pos <= last),
found AS (SELECT t.*, d.markdown, CASE WHEN whole THEN strpos(' ' || n || ' ', ' ' || needle || ' ') ELSE strpos(n, needle) END AS p,
    strpos(replace(n, ' ', ''), replace(needle, ' ', '')) AS q FROM t JOIN d USING (job_id, doc_no)),
span AS (SELECT f.job_id, f.doc_no, f.needle, f.whole, f.markdown,
    min(k.pos) FILTER (CASE WHEN p > 0 THEN place_no = p ELSE solid AND tight = q END) AS a,
    max(k.pos) FILTER (CASE WHEN p > 0 THEN place_no = p + length(needle) - 1 ELSE solid AND tight = q + length(replace(needle, ' ', '')) - 1 END) + 1 AS b
  FROM found f JOIN kept k USING (job_id, doc_no) GROUP BY ALL),
heads AS (SELECT job_id, doc_no, page_no, CAST(coalesce(sum(length(text) + length('## Page ' || page_no) + 4) OVER (
    PARTITION BY job_id, doc_no ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM pg),
place AS (SELECT s.job_id, s.doc_no, s.needle, s.whole, a AS source_offset, page_no AS source_page,
    trim(regexp_replace(regexp_replace(substr(markdown, a + 1, b - a), '#{{1,6}}[\s\p{{Z}}]+', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g')) AS source_match,
    (CASE WHEN a > 140 THEN '… ' ELSE '' END) || trim(regexp_replace(regexp_replace(
      substr(markdown, greatest(0, a - 140) + 1, least(length(markdown), b + 140) - greatest(0, a - 140)), '#{{1,6}}[\s\p{{Z}}]+', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))
      || (CASE WHEN b + 140 < length(markdown) THEN ' …' ELSE '' END) AS source_excerpt
  FROM span s ASOF LEFT JOIN heads h ON s.job_id = h.job_id AND s.doc_no = h.doc_no AND s.a >= h.start),
w AS (SELECT n.*, p.source_offset, p.source_page, p.source_match, p.source_excerpt
  FROM n LEFT JOIN place p ON n.job_id = p.job_id AND n.anchor.doc_no = p.doc_no AND n.anchor.needle = p.needle AND n.anchor.whole = p.whole)"""
WHERE_FOUND = ["source_document", "source_page", "source_excerpt", "source_match", "source_offset"]
VERDICT = ["job_id", "field_id", "error", "value", "rerank_score", "grounding", "quote_verified"]


@query("annotated_results", f"WITH {PLACED} SELECT {', '.join(VERDICT + WHERE_FOUND)} FROM w")
def annotated_results(s: Source) -> DataFrame:
    return annotated(s).select(*VERDICT, *WHERE_FOUND)


@query("source_anchors", f"WITH {PLACED} SELECT job_id, field_id, {', '.join(WHERE_FOUND)} FROM w WHERE anchor IS NOT NULL")
def source_anchors(s: Source) -> DataFrame:
    """Page, excerpt, exact match and offset of every verdict that has evidence."""
    return annotated(s).where("source_document IS NOT NULL").select("job_id", "field_id", *WHERE_FOUND)


@query("grounding_distribution", f"""
WITH {ANNOTATED}, c AS (SELECT job_id, grounding, count(*) AS n FROM n WHERE value <> '' GROUP BY ALL)
SELECT job_id, grounding, n, CAST(round_even(100 * n / sum(n) OVER (PARTITION BY job_id), 0) AS BIGINT) AS percent,
  coalesce(list_position(['verified', 'attested', 'not_checkable', 'inferred', 'unverified'], grounding), 6) AS place FROM c""")
def grounding_distribution(s: Source) -> DataFrame:
    out = R.grounding_distribution(annotated(s))
    return out.select("job_id", "grounding", "n", "percent", F.col("place").cast("bigint").alias("place"))


@query("doubtful_fields", f"WITH {ANNOTATED} SELECT job_id, field_id, value FROM n WHERE value <> '' AND grounding = 'unverified'")
def doubtful_fields(s: Source) -> DataFrame:
    return R.doubtful(annotated(s)).select("job_id", "field_id", "value")


@query("verified_samples", f"""
WITH {ANNOTATED} SELECT job_id, field_id, source_document FROM n WHERE grounding = 'verified'
QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY field_id) <= 3""")
def verified_samples(s: Source) -> DataFrame:
    view = annotated(s).withColumn("ord", F.col("field_id"))
    return R.verified_samples(view).select("job_id", "field_id", "source_document")


@query("debug_view", f"""
WITH {PLACED} SELECT job_id, field_id, value, rerank_score, grounding, source_document, error, quote_verified, source_quote, source_page FROM w""")
def debug_view(s: Source) -> DataFrame:
    return R.debug_view(annotated(s))


@query("derived_docs", r"""
SELECT n_name AS job_id, 0 AS doc_no, 'synthèse médicale' AS filename, '{"r": ' || n_regionkey || '}' AS markdown
FROM nation WHERE n_regionkey > 0""")
def derived_docs(s: Source) -> DataFrame:
    text = F.concat(F.lit('{"r": '), F.col("n_regionkey").cast("string"), F.lit("}"))
    synthesis = s.table("nation").select(F.col("n_name").alias("job_id"),
                                         F.when(F.col("n_regionkey") > 0, text).alias("synthesis"))
    return B.derived_docs(synthesis)
