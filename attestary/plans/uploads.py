"""From uploaded files to documents, and from target values to the leaves of a form: the two ends of a filled form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from attestary.operators import admission as A, fill as W, pages as P, responses as J
from attestary.plans.filling import CANTON, COMPUTED, EXTRACTED, targets_sql
from attestary.plans.registry import Source, plain, query
from attestary.session import stage


def documents_of(files: DataFrame, pages: DataFrame, cache: DataFrame, recognise: Callable[[str], str],
                 **calls) -> tuple[DataFrame, DataFrame]:
    """(documents of the accepted jobs, contents read anew).

    ``files(job_id, file_no, name, size, head, content_hash)``; ``pages(content_hash, page_no, text)`` of
    those with a text layer; ``cache(content_hash, markdown)``. A job with a bad file is left out whole, and
    of files with one name in a job the first counts. A content that many jobs uploaded is read once: from
    the cache, else from its pages if enough of them are usable, else by ``recognise`` on its hash.
    Documents that could not be read have a NULL ``markdown``. ``calls`` go to :func:`responses.infer`.
    """
    accepted = A.screen_uploads(files).where("accepted").select("job_id")
    kept = (A.file_verdict(A.dedupe_files(files)).join(accepted, "job_id", "left_semi")
            .select("job_id", F.col("file_no").alias("doc_no"), F.col("safe_name").alias("filename"), "content_hash"))
    kept = stage(kept, "kept-files")
    open_ = kept.select("content_hash").distinct().join(cache, "content_hash", "left_anti")
    rows = (open_.join(pages, "content_hash", "left")
            .select(F.col("content_hash").alias("job_id"), F.lit(0).alias("doc_no"), "page_no", "text"))
    routed = stage(P.route_documents(P.text_layer_ratio(rows)).select("job_id", "mode"), "routes")
    native = rows.join(routed.where("mode = 'text_layer'").select("job_id"), "job_id", "left_semi")
    said = J.infer(routed.where("mode = 'ocr'").select(F.col("job_id").alias("prompt")), recognise, **calls)
    fresh = (P.assemble_document(native).select(F.col("job_id").alias("content_hash"), "markdown")
             .withColumn("mode", F.lit("text_layer"))
             .unionByName(said.select(F.col("prompt").alias("content_hash"), F.col("raw").alias("markdown")).withColumn("mode", F.lit("ocr"))))
    fresh = stage(fresh.where("markdown IS NOT NULL"), "read-contents")
    known = cache.select("content_hash", "markdown").unionByName(fresh.select("content_hash", "markdown"))
    return kept.join(known, "content_hash", "left").select("job_id", "doc_no", "filename", "markdown"), fresh


def written_leaves(targets: DataFrame, jobs: DataFrame, leaves: DataFrame, types: DataFrame,
                   overwrite: bool = True) -> tuple[DataFrame, DataFrame]:
    """(leaves of every job's form with its values written, values without a leaf).

    ``targets`` as :func:`fill.resolve_targets` gives them, ``jobs(job_id, form_id)``, ``leaves(form_id, path,
    ord, text)``, ``types(form_id, path, type)``. Values of checkbox leaves become On or Off first.
    """
    xml = targets.where("target = 'xml_path'").join(jobs, "job_id").select("job_id", "form_id", F.col("name").alias("path"), "value")
    typed = W.normalize_checkboxes(xml, W.checkbox_paths(leaves)).join(types, ["form_id", "path"], "left")
    # each job has its own copy of its form, so the job takes the form's place
    values = typed.select(F.col("job_id").alias("form_id"), "path", "value", "type")
    mine = jobs.join(leaves, "form_id").select(F.col("job_id").alias("form_id"), "path", "ord", "text")
    named = {"form_id": "job_id"}
    return (W.upsert_leaves(mine, values, overwrite).withColumnsRenamed(named),
            W.unknown_paths(mine, values).withColumnsRenamed(named))


# A source's documents are ten jobs; some files have one name, some are no PDF; texts are contents, their lines pages.
FILES = """
SELECT concat(source, '-', CAST(n_chars % 10 AS STRING)) AS job_id, doc_id AS file_no, n_chars AS size, text,
  CASE WHEN doc_id % 4 = 0 THEN 'rapport.pdf' ELSE concat('dossier/doc', CAST(doc_id AS STRING), '.pdf') END AS name,
  CASE WHEN doc_id % 37 = 0 THEN 'GIF8' ELSE '%PDF' END AS head FROM {documents} WHERE text IS NOT NULL"""
READ = rf"""
f AS (SELECT *, sha256(text) AS content_hash FROM ({plain(FILES)}) x),
k AS (SELECT job_id, file_no AS doc_no, CASE WHEN name = 'rapport.pdf' THEN name ELSE split_part(name, '/', 2) END AS filename, content_hash FROM f
  WHERE job_id NOT IN (SELECT job_id FROM f WHERE head <> '%PDF') QUALIFY row_number() OVER (PARTITION BY job_id, name ORDER BY file_no) = 1),
c AS (SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE lang = 'fr'),
o AS (SELECT DISTINCT f.content_hash, f.text FROM f WHERE content_hash IN (SELECT content_hash FROM k) AND content_hash NOT IN (SELECT content_hash FROM c)),
p AS (SELECT content_hash, i AS page_no, trim(regexp_replace(l[i], '[ \t]+', ' ', 'g')) AS text FROM (SELECT content_hash, string_split(text, chr(10)) AS l FROM o) d, range(1, len(l) + 1) r(i)),
n AS (SELECT content_hash, count(*) FILTER (WHERE length(text) >= 120 AND (length(text) - length(replace(text, chr(65533), ''))) / length(text) <= 0.02) / count(*) >= 0.8 AS native,
  string_agg('## Page ' || page_no || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY page_no) AS pages FROM p GROUP BY ALL),
r AS (SELECT content_hash, CASE WHEN native THEN 'text_layer' ELSE 'ocr' END AS mode, CASE WHEN native THEN pages ELSE 'lu : ' || content_hash END AS markdown FROM n)"""


def _read(s: Source) -> tuple[DataFrame, DataFrame]:
    files = s.shape(FILES).withColumn("content_hash", P.content_hash(F.col("text")))
    pages = files.select("content_hash", "text").distinct().select("content_hash", F.posexplode(F.split("text", "\n", -1)).alias("at", "text")) \
        .select("content_hash", (F.col("at") + 1).alias("page_no"), "text")
    cache = s.table("documents").where("lang = 'fr' AND text IS NOT NULL").select(P.content_hash(F.col("text")).alias("content_hash")).distinct() \
        .withColumn("markdown", F.concat(F.lit("connu : "), "content_hash"))
    return documents_of(files.drop("text"), pages, cache, lambda content: f"lu : {content}", pause=0.0)


@query("uploaded_documents", f"""
WITH {READ} SELECT job_id, doc_no, filename, md5(coalesce(r.markdown, 'connu : ' || k.content_hash)) AS digest FROM k LEFT JOIN r ON k.content_hash = r.content_hash""")
def uploaded_documents(s: Source) -> DataFrame:
    """Uploads screened, named, read from cache, text layer or recogniser, as the documents of their jobs."""
    return _read(s)[0].select("job_id", "doc_no", "filename", F.md5("markdown").alias("digest"))


@query("read_contents", f"WITH {READ} SELECT content_hash, mode, md5(markdown) AS digest FROM r")
def read_contents(s: Source) -> DataFrame:
    """What was read anew, once per content: the entries the cache gains."""
    return _read(s)[1].select("content_hash", "mode", F.md5("markdown").alias("digest"))


JOBS = "SELECT DISTINCT o_custkey AS job_id, CASE WHEN o_custkey % 3 = 0 THEN 'A' ELSE 'B' END AS form_id FROM {orders}"
LEAVES = """
SELECT f.form_id, concat('p/', o.o_orderpriority, '/', o.o_orderstatus) AS path, min(o.o_orderkey) AS ord,
  CASE WHEN o.o_orderpriority = '2-HIGH' THEN ' Off ' WHEN o.o_orderpriority = '5-LOW' THEN 'ancien' ELSE '' END AS text
FROM {orders} o JOIN (SELECT 'A' AS form_id, 'F' AS left_out UNION ALL SELECT 'B', 'P') f ON o.o_orderstatus <> f.left_out
GROUP BY f.form_id, o.o_orderpriority, o.o_orderstatus"""
TYPES = f"SELECT form_id, path, 'bool' AS type FROM ({LEAVES}) x WHERE path LIKE 'p/3%'"
_TARGETS = targets_sql(EXTRACTED, COMPUTED, CANTON).replace("\nSELECT job_id, target, name", ",\nq AS (SELECT job_id, target, name")
LEAF_VALUES = f"""{_TARGETS}),
v AS (SELECT q.job_id, j.form_id, q.name AS path, q.value FROM q JOIN ({plain(JOBS)}) j ON q.job_id = j.job_id WHERE target = 'xml_path'),
m AS (SELECT j.job_id, l.path, l.ord, l.text FROM ({plain(JOBS)}) j JOIN ({plain(LEAVES)}) l ON j.form_id = l.form_id)"""


def _leaves(s: Source, overwrite: bool) -> tuple[DataFrame, DataFrame]:
    targets = W.resolve_targets(s.shape(EXTRACTED), s.shape(COMPUTED), s.shape(CANTON))
    return written_leaves(targets, s.shape(JOBS), s.shape(LEAVES), s.shape(TYPES), overwrite)


def leaves_sql(free: str) -> str:
    new = """CASE WHEN m.text = ' Off ' THEN 'Off' WHEN m.path LIKE 'p/3%' THEN CASE WHEN v.value IN ('1', 'true', 'True') THEN '1' ELSE '0' END ELSE v.value END"""
    return f"""{LEAF_VALUES}
SELECT m.job_id, m.path, m.ord, CASE WHEN v.value IS NOT NULL AND {free} THEN {new} ELSE m.text END AS text
FROM m LEFT JOIN v ON m.job_id = v.job_id AND m.path = v.path"""


@query("filled_leaves", leaves_sql("true"))
def filled_leaves(s: Source) -> DataFrame:
    """Extracted, computed and canton values by precedence, checkboxes normalised, written into each job's form."""
    return _leaves(s, True)[0].select("job_id", "path", "ord", "text")


@query("filled_blank_leaves", leaves_sql("trim(m.text) = ''"))
def filled_blank_leaves(s: Source) -> DataFrame:
    return _leaves(s, False)[0].select("job_id", "path", "ord", "text")


@query("leafless_values", f"{LEAF_VALUES} SELECT v.job_id, v.path, v.value FROM v ANTI JOIN m ON v.job_id = m.job_id AND v.path = m.path")
def leafless_values(s: Source) -> DataFrame:
    return _leaves(s, True)[1].select("job_id", "path", "value")
