"""Text layer, chunk and scalar plans."""

from pyspark.sql import DataFrame, functions as F

from attestary.functions import paths as P, text as X, values as V
from attestary.operators import chunking as C, fill as W, pages as G
from attestary.plans.registry import Source, plain, query

WS = r"[\s\p{Z}]"
DOCS = "SELECT source AS job_id, doc_id AS doc_no, concat('doc', CAST(doc_id AS STRING), '.pdf') AS filename, text AS markdown FROM {documents}"


def page_rows(s: Source, docs: DataFrame | None = None) -> DataFrame:
    """Every line of a document is a page."""
    return (s.table("documents") if docs is None else docs).select(
        F.col("source").alias("job_id"), F.col("doc_id").alias("doc_no"),
        F.posexplode(F.split("text", "\n", -1)).alias("at", "text")) \
        .withColumn("page_no", F.col("at") + 1)


PAGES = r"""
SELECT source AS job_id, doc_id AS doc_no, i AS page_no,
       trim(regexp_replace(l[i], '[ \t]+', ' ', 'g')) AS text
FROM (SELECT source, doc_id, string_split(text, chr(10)) AS l FROM documents) d, range(1, len(l) + 1) r(i)"""
ASSEMBLED = f"""
SELECT job_id, doc_no, string_agg('## Page ' || page_no || chr(10) || chr(10) || text, chr(10) || chr(10)
  ORDER BY page_no) AS markdown FROM ({PAGES}) p GROUP BY ALL"""


@query("page_assembly", f"SELECT job_id, doc_no, md5(markdown) AS digest FROM ({ASSEMBLED}) a")
def page_assembly(s: Source) -> DataFrame:
    return G.assemble_document(page_rows(s)).select("job_id", "doc_no",
                                                    F.md5("markdown").alias("digest"))


@query("page_routes", f"""
WITH r AS (SELECT job_id, doc_no, count(*) AS pages,
             count(*) FILTER (WHERE length(text) >= 120
               AND (length(text) - length(replace(text, chr(65533), ''))) / length(text) <= 0.02) AS usable
           FROM ({PAGES}) p GROUP BY ALL)
SELECT *, usable / pages AS ratio, CASE WHEN usable / pages >= 0.8 THEN 'text_layer' ELSE 'ocr' END AS mode FROM r""")
def page_routes(s: Source) -> DataFrame:
    return G.route_documents(G.text_layer_ratio(page_rows(s)))


@query("page_of", rf"""
WITH p AS ({PAGES}),
h AS (SELECT *, CAST(coalesce(sum(length(text) + length('## Page ' || page_no) + 4) OVER (
        PARTITION BY job_id, doc_no ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        AS BIGINT) AS start FROM p),
n AS (SELECT job_id, doc_no, max(start + length('## Page ' || page_no) + 2 + length(text)) AS size FROM h GROUP BY ALL),
q AS (SELECT job_id, doc_no, k * 97 AS "offset" FROM n, range(0, size // 97 + 1) r(k))
SELECT q.job_id, q.doc_no, q."offset", h.page_no AS page
FROM q ASOF LEFT JOIN h ON q.job_id = h.job_id AND q.doc_no = h.doc_no AND q."offset" >= h.start""")
def page_of(s: Source) -> DataFrame:
    docs = G.assemble_document(page_rows(s))
    asked = docs.select("job_id", "doc_no", F.explode(F.sequence(
        F.lit(0), F.length("markdown"), F.lit(97))).alias("offset"))
    found = G.page_of(G.page_starts(docs), asked)
    return found.select("job_id", "doc_no", F.col("offset").cast("bigint").alias("offset"), F.col("page").cast("bigint").alias("page"))


@query("cache_hits", """
WITH f AS (SELECT source AS job_id, doc_id AS doc_no, sha256(text) AS content_hash FROM documents),
c AS (SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE lang = 'fr')
SELECT f.job_id, f.doc_no, f.content_hash FROM f JOIN c USING (content_hash)""")
def cache_hits(s: Source) -> DataFrame:
    hits, _ = G.cache_split(*_cached(s))
    return hits.select("job_id", "doc_no", "content_hash")


@query("cache_misses", """
WITH f AS (SELECT source AS job_id, doc_id AS doc_no, sha256(text) AS content_hash FROM documents),
c AS (SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE lang = 'fr')
SELECT content_hash, arg_min(job_id, struct_pack(a := job_id, b := doc_no)) AS job_id,
       arg_min(doc_no, struct_pack(a := job_id, b := doc_no)) AS doc_no, count(*) AS copies
FROM f WHERE content_hash NOT IN (SELECT content_hash FROM c) GROUP BY content_hash""")
def cache_misses(s: Source) -> DataFrame:
    return G.cache_split(*_cached(s))[1]


def _cached(s: Source) -> tuple[DataFrame, DataFrame]:
    files = s.table("documents").select(F.col("source").alias("job_id"),
                                        F.col("doc_id").alias("doc_no"), F.col("text").alias("content"))
    cache = (s.table("documents").where("lang = 'fr'")
             .select(G.content_hash(F.col("text")).alias("content_hash")).distinct())
    return files, cache


@query("cache_evict", """
SELECT sha256(text) AS content_hash, max(doc_id) AS cached_at FROM documents GROUP BY 1
ORDER BY cached_at DESC, content_hash LIMIT 500""")
def cache_evict(s: Source) -> DataFrame:
    cache = (s.table("documents").groupBy(G.content_hash(F.col("text")).alias("content_hash"))
             .agg(F.max("doc_id").alias("cached_at")))
    return G.cache_evict(cache)


# --- chunks ---------------------------------------------------------------------------------

# headings and paragraphs of a page as markdown lines; the same regular expressions on both sides
def page_markdown(s: Source) -> DataFrame:
    html = F.regexp_replace(F.regexp_replace("html", "<h1>", "\n# "), "<p>", "\n## ")
    html = F.regexp_replace(html, "<footer>", "\n#### ")
    return s.table("pages").select(
        F.regexp_extract("url", r"example[.]([a-z]+)", 1).alias("job_id"),
        F.col("page_id").alias("doc_no"), F.col("url").alias("filename"),
        F.regexp_replace(html, "<[^>]*>", " ").alias("markdown"))


PAGE_MD = r"""
SELECT regexp_extract(url, 'example[.]([a-z]+)', 1) AS job_id, page_id AS doc_no, url AS filename,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<h1>', chr(10) || '# ', 'g'),
    '<p>', chr(10) || '## ', 'g'), '<footer>', chr(10) || '#### ', 'g'), '<[^>]*>', ' ', 'g') AS markdown FROM pages"""
STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
SECTIONS = rf"""
SELECT job_id, doc_no, generate_subscripts(l, 1) AS section, unnest(l) AS text FROM (
  SELECT job_id, doc_no, list_filter(list_transform(string_split(regexp_replace(
    chr(10) || chr(10) || '--- SOURCE: ' || filename || ' ---' || chr(10) || chr(10) || markdown,
    '\n(#{{1,3}} )', chr(1) || chr(10) || '\1', 'g'), chr(1)),
    lambda x: {STRIP.format('x')}), lambda x: x <> '') AS l FROM ({{docs}}) d) e"""
WINDOWS = rf"""
SELECT job_id, doc_no, section, k AS win, CASE WHEN len(w) > 800 THEN array_to_string(w[k * 700 + 1 : k * 700 + 800], ' ')
  ELSE text END AS text
FROM (SELECT *, list_filter(regexp_split_to_array(text, '[\s\p{{Z}}]+'), lambda x: x <> '') AS w FROM ({SECTIONS.replace('{{docs}}', '{docs}')}) s) t,
  range(0, CASE WHEN len(w) > 800 THEN (len(w) - 1) // 700 + 1 ELSE 1 END) r(k)"""


def chunk_sql(docs: str) -> str:
    inner = WINDOWS.replace("{{1,3}}", "{1,3}").replace("{{Z}}", "{Z}").replace("{docs}", docs)
    return f"""
SELECT job_id, doc_no, row_number() OVER (PARTITION BY job_id ORDER BY doc_no, section, win) - 1 AS chunk_no,
  text FROM ({inner}) c"""


def chunks_of(docs: DataFrame) -> DataFrame:
    return C.number_chunks(C.chunk_documents(C.with_source_header(docs)))


@query("heading_chunks", f"SELECT job_id, doc_no, chunk_no, md5(text) AS digest FROM ({chunk_sql(PAGE_MD)}) c")
def heading_chunks(s: Source) -> DataFrame:
    return chunks_of(page_markdown(s)).select("job_id", "doc_no", "chunk_no", F.md5("text").alias("digest"))


@query("word_windows", f"""
SELECT job_id, doc_no, chunk_no, md5(text) AS digest, chunk_no // 64 AS embed_batch FROM ({chunk_sql(plain(DOCS))}) c""")
def word_windows(s: Source) -> DataFrame:
    chunks = C.embedding_batches(chunks_of(s.shape(DOCS)))
    return chunks.select("job_id", "doc_no", "chunk_no", F.md5("text").alias("digest"), "embed_batch")


# --- scalars --------------------------------------------------------------------------------

NORM = r"trim(regexp_replace(strip_accents(lower({})), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@query("norm", f"""
SELECT doc_id, md5({NORM.format('text')}) AS norm, md5(replace({NORM.format('text')}, ' ', '')) AS squash FROM documents""")
def norm(s: Source) -> DataFrame:
    n = X.norm(F.col("text"))
    return s.table("documents").select("doc_id", n.alias("n")).select(
        "doc_id", F.md5("n").alias("norm"), F.md5(X.squash(F.col("n"))).alias("squash"))


@query("norm_offsets", r"""
WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS pos FROM documents),
k AS (SELECT doc_id, pos, regexp_matches(strip_accents(lower(ch)), '[\p{L}\p{N}]') AS solid FROM c),
m AS (SELECT *, lag(solid) OVER (PARTITION BY doc_id ORDER BY pos) AS after, max(CASE WHEN solid THEN pos END) OVER (PARTITION BY doc_id) AS last FROM k),
o AS (SELECT doc_id, count(*) AS n, md5(string_agg(pos, ',' ORDER BY pos)) AS digest FROM m WHERE (solid OR after) AND pos <= last GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS chars, coalesce(n, 0) AS offsets, coalesce(digest, md5('')) AS digest FROM documents LEFT JOIN o USING (doc_id)""")
def norm_offsets(s: Source) -> DataFrame:
    """Every normal character has the offset it came from."""
    m = s.table("documents").select("doc_id", X.norm_map(F.coalesce("text", F.lit(""))).alias("m"))
    return m.select("doc_id", F.length("m.norm").cast("bigint").alias("chars"), F.size("m.origin").cast("bigint").alias("offsets"),
                    F.md5(F.array_join("m.origin", ",")).alias("digest"))


DATES = """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN concat_ws('.', d, m, y)
  WHEN '2-HIGH' THEN concat_ws('-', y, lpad(m, 2, '0'), lpad(d, 2, '0'))
  WHEN '3-MEDIUM' THEN concat_ws('/', d, m, y) WHEN '5-LOW' THEN concat_ws('.', d, '13', y)
  ELSE concat('le ', d) END AS raw, d, m, y, o_orderpriority
FROM (SELECT o_orderkey, o_orderpriority, CAST(extract(day FROM o_orderdate) AS STRING) AS d,
        CAST(extract(month FROM o_orderdate) AS STRING) AS m,
        CAST(extract(year FROM o_orderdate) AS STRING) AS y FROM {orders}) o"""
MONTHS = "['janvier','février','mars','avril','mai','juin','juillet','août','septembre','octobre','novembre','décembre']"


@query("date_variants", f"""
SELECT o_orderkey, raw,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN array_to_string([
    lpad(d, 2, '0') || '.' || lpad(m, 2, '0') || '.' || y, d || '.' || m || '.' || y,
    d || ' ' || {MONTHS}[CAST(m AS INT)] || ' ' || y, lpad(d, 2, '0') || ' ' || {MONTHS}[CAST(m AS INT)] || ' ' || y], '|')
    ELSE '' END AS variants,
  CASE o_orderpriority WHEN '2-HIGH' THEN replace(raw, '-', '.') WHEN '4-NOT SPECIFIED' THEN raw
    WHEN '5-LOW' THEN lpad(d, 2, '0') || '.13.' || y
    ELSE lpad(d, 2, '0') || '.' || lpad(m, 2, '0') || '.' || y END AS converted
FROM ({plain(DATES)}) x""")
def date_variants(s: Source) -> DataFrame:
    raw = F.col("raw")
    return s.shape(DATES).select("o_orderkey", "raw",
                                 F.array_join(V.date_variants(raw), "|").alias("variants"),
                                 V.conv_date(raw).alias("converted"))


RAW = """
SELECT l_orderkey, l_linenumber, l_partkey,
  CASE l_linenumber WHEN 1 THEN concat(' ', CAST(CAST(l_quantity AS INT) AS STRING), ' % ')
    WHEN 2 THEN replace(CAST(l_discount AS STRING), '.', ',')
    WHEN 3 THEN concat('CHF ', CAST(CAST(l_quantity AS INT) AS STRING), '.50')
    WHEN 4 THEN CASE l_returnflag WHEN 'A' THEN 'Oui' WHEN 'N' THEN ' ON ' ELSE 'vrai' END
    WHEN 5 THEN CASE l_returnflag WHEN 'A' THEN 'Féminin' WHEN 'N' THEN 'm (masculin)' ELSE 'x' END
    WHEN 6 THEN CASE l_returnflag WHEN 'A' THEN '1' WHEN 'N' THEN 'true' ELSE '' END
    ELSE CASE l_returnflag WHEN 'A' THEN NULL WHEN 'N' THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), ',5%') ELSE 'rien' END END AS v,
  CASE l_linestatus WHEN 'F' THEN 'bool' ELSE 'int' END AS kind
FROM {lineitem}"""
FLOAT = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"


def _num(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, {FLOAT}) THEN TRY_CAST({x} AS DOUBLE) END"


def _num_text(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


@query("typed_values", rf"""
WITH a AS (SELECT *, trim(v) AS t, lower(trim(v)) AS w FROM ({plain(RAW)}) r),
b AS (SELECT *, {_num("replace(t, ',', '.')")} AS x, {_num("replace(regexp_replace(t, '[^0-9.,]', '', 'g'), ',', '.')")} AS y,
        {_num("trim(replace(replace(t, '%', ''), ',', '.'))")} AS p,
        regexp_extract(replace(v, '%', ''), '[0-9]+(?:[.,][0-9]+)?') AS f FROM a)
SELECT l_orderkey, l_linenumber, v,
  CASE WHEN upper(t) LIKE 'M%' OR upper(t) IN ('HOMME', 'H') THEN 'M' WHEN upper(t) LIKE 'F%' THEN 'F' ELSE v END AS sex,
  CASE WHEN f <> '' THEN replace(f, ',', '.') ELSE v END AS fill_percent,
  coalesce(CAST(CAST(round_even(p, 0) AS BIGINT) AS VARCHAR), trim(replace(t, '%', '')), '') AS lib_percent,
  coalesce({_num_text('x')}, {_num_text('y')}, t, '') AS number,
  CASE WHEN coalesce(w IN ('oui','yes','true','1','on','x','checked','vrai'), false) THEN 'oui' ELSE 'non' END AS oui_non,
  CASE WHEN coalesce(w IN ('oui','yes','true','1','on','x','checked','vrai'), false) THEN 'On' ELSE 'Off' END AS on_off,
  CASE WHEN coalesce(w IN ('on','true','1','yes','y','x','checked'), false) THEN 'On' ELSE 'Off' END AS xfa_on_off,
  CASE WHEN coalesce(w IN ('on','true','1','yes','y','x','checked','oui'), false) THEN 'Yes' ELSE 'Off' END AS widget,
  CASE WHEN v IS NULL THEN '' WHEN kind = 'bool' THEN CASE WHEN v IN ('1','true','True') THEN '1' ELSE '0' END
    ELSE coalesce(CAST(TRY_CAST(CASE WHEN regexp_matches(t, '^[+-]?[0-9]+$') THEN t END AS BIGINT) AS VARCHAR), v) END AS xfa
FROM b""")
def typed_values(s: Source) -> DataFrame:
    v = F.col("v")
    return s.shape(RAW).select(
        "l_orderkey", "l_linenumber", "v", V.norm_sex(v).alias("sex"),
        V.norm_percent(v).alias("fill_percent"), V.conv_percent(v).alias("lib_percent"),
        V.conv_number(v).alias("number"), V.to_oui_non(v).alias("oui_non"),
        V.to_on_off(v).alias("on_off"), V.to_on_off_xfa(v).alias("xfa_on_off"),
        V.to_widget_state(v, F.lit("Yes")).alias("widget"), V.xfa_text(v, F.col("kind")).alias("xfa"))


VALUES = f"SELECT l_partkey AS field_id, l_orderkey, l_linenumber, v AS value FROM ({RAW}) r"
TYPES = """SELECT p_partkey AS field_id, CASE p_type WHEN 'SMALL' THEN 'bool' WHEN 'LARGE' THEN 'Date'
  WHEN 'MEDIUM' THEN 'number' WHEN 'PROMO' THEN 'percent' ELSE 'str' END AS type FROM {part} WHERE p_size < 40"""
BOXES = "SELECT p_partkey AS field_id FROM {part} WHERE p_size < 10"


@query("batch_convert", rf"""
WITH a AS (SELECT v.*, trim(value) AS t, lower(trim(value)) AS w, lower(coalesce(type, 'str')) AS k, b.field_id IS NOT NULL AS box
  FROM ({plain(VALUES)}) v LEFT JOIN ({plain(TYPES)}) y ON v.field_id = y.field_id
  LEFT JOIN ({plain(BOXES)}) b ON v.field_id = b.field_id),
b AS (SELECT *, {_num("replace(t, ',', '.')")} AS x, {_num("replace(regexp_replace(t, '[^0-9.,]', '', 'g'), ',', '.')")} AS y,
  {_num("trim(replace(replace(t, '%', ''), ',', '.'))")} AS p, coalesce(w IN ('oui','yes','true','1','on','x','checked','vrai'), false) AS yes FROM a)
SELECT l_orderkey, l_linenumber, field_id, CASE WHEN box THEN CASE WHEN yes THEN 'On' ELSE 'Off' END WHEN value IS NULL THEN ''
  WHEN k = 'bool' THEN CASE WHEN yes THEN 'oui' ELSE 'non' END WHEN k = 'number' THEN coalesce({_num_text('x')}, {_num_text('y')}, t)
  WHEN k = 'percent' THEN coalesce(CAST(CAST(round_even(p, 0) AS BIGINT) AS VARCHAR), trim(replace(t, '%', ''))) ELSE t END AS converted FROM b""")
def batch_convert(s: Source) -> DataFrame:
    out = W.batch_convert(s.shape(VALUES), s.shape(TYPES), s.shape(BOXES))
    return out.select("l_orderkey", "l_linenumber", "field_id", "converted")


@query("text_scalars", rf"""
WITH u AS (SELECT page_id, url, regexp_replace(url, '^[a-z]+://', '') AS path, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title, html FROM pages),
p AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs, regexp_replace(html, '<[^>]*>', '# ', 'g') AS md FROM u)
SELECT page_id, array_to_string(list_slice(segs, greatest(len(segs) - 1, 1), len(segs)), '/') AS path_key,
  CASE WHEN regexp_matches(url, '^[^\[]*\[\s*[+-]?[0-9]+\s*\]$') THEN 'x' ELSE url END AS tag,
  split_part(segs[1], '.', 1) AS section, length(html) // 4 AS tokens,
  md5(trim(regexp_replace(regexp_replace(md, '#{{1,6}}[\s\p{{Z}}]+', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))) AS flat,
  strpos(html, title) - 1 AS before_chars, length(html) - strpos(html, title) + 1 - length(title) AS after_chars,
  CASE WHEN page_id * 37 >= 3600 THEN printf('%d:%02d:%02d', page_id * 37 // 3600, page_id * 37 % 3600 // 60, page_id * 37 % 60)
    ELSE printf('%02d:%02d', page_id * 37 // 60, page_id * 37 % 60) END AS duration,
  CAST(floor(5 + 35 * page_id / (page_id + 1)) AS BIGINT) AS progress
FROM p""".replace("{{", "{").replace("}}", "}"))
def text_scalars(s: Source) -> DataFrame:
    page = s.table("pages").withColumn("path", F.regexp_replace("url", "^[a-z]+://", "")) \
        .withColumn("title", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1))
    cut = X.highlight(F.col("html"), F.col("title"))
    return page.select(
        "page_id", P.path_key(F.col("path")).alias("path_key"),
        P.split_segment(F.col("url"))["tag"].alias("tag"), P.section_of(F.col("path")).alias("section"),
        X.estimate_tokens(F.col("html")).cast("bigint").alias("tokens"),
        F.md5(X.flatten_text(F.regexp_replace("html", "<[^>]*>", "# "))).alias("flat"),
        F.length(cut["before"]).cast("bigint").alias("before_chars"),
        F.length(cut["after"]).cast("bigint").alias("after_chars"),
        V.format_duration((F.col("page_id") * 37).cast("double")).alias("duration"),
        V.progress("ocr", F.col("page_id"), F.col("page_id") + 1).cast("bigint").alias("progress"))


@query("excerpts", rf"""
WITH d AS (SELECT doc_id, text, length(text) // 3 AS a, length(text) // 2 AS b FROM documents)
SELECT doc_id, md5((CASE WHEN a > 140 THEN '… ' ELSE '' END) || trim(regexp_replace(regexp_replace(
    substr(text, greatest(0, a - 140) + 1, least(length(text), b + 140) - greatest(0, a - 140)),
    '#{{1,6}}[\s\p{{Z}}]+', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g')) || (CASE WHEN b + 140 < length(text) THEN ' …' ELSE '' END)) AS excerpt
FROM d""".replace("{{", "{").replace("}}", "}"))
def excerpts(s: Source) -> DataFrame:
    n = F.length("text")
    return s.table("documents").select("doc_id", F.md5(X.excerpt(
        F.col("text"), F.floor(n / 3).cast("int"), F.floor(n / 2).cast("int"))).alias("excerpt"))


SOMS = """
SELECT p_partkey, concat('form[0].', CASE WHEN p_size < 20 THEN '#area[0].' ELSE '' END, lower(p_type), '[', CAST(p_size % 3 AS STRING), '].',
  replace(p_name, ' ', '_'), '[0]') AS som, concat('C:/x/medforms/', CAST(p_size AS STRING), '.providers/', p_type, '/10.a') AS base FROM {part}"""


@query("form_paths", f"""
SELECT p_partkey, replace(som, '#area[0].', '') AS canon, replace(replace(som, '[0]', ''), '.', '/') AS xml_path,
  CASE WHEN som LIKE '%#area%' THEN '#area' ELSE regexp_extract(som, '^[^.]*[.]([^.[]*)', 1) END AS section,
  'medforms.' || regexp_extract(base, '([0-9]+)[.]providers', 1) || '.10' AS code FROM ({plain(SOMS)}) s""")
def form_paths(s: Source) -> DataFrame:
    som = F.col("som")
    return s.shape(SOMS).select("p_partkey", P.canonical_som(som).alias("canon"),
                                P.xml_path(som).alias("xml_path"), P.som_section(som).alias("section"),
                                P.taxonomy_code(F.col("base")).alias("code"))
