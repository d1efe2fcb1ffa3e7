"""The registered queries of this folder, with SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestary.llm import (alignment, centroids, fingerprints, html, linededup, mixing, packing, quality, shards, simhash, tokenfile,
                           topk, urlfilters)
from attestary.llm.encoding import Encoder
from attestary.session import bound_batches, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def query(name: str, table: str, sql: str | None = None):
    def add(fn: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[name] = lambda spark, folder: fn(spark.read.parquet(f"{folder}/{table}.parquet"))
        if sql:
            ORACLES[name] = sql
        return fn
    return add


@query("op1_simhash", "documents")
def op1(docs: DataFrame) -> DataFrame:
    groups = simhash.near_groups(docs, shingle=4, max_bits=4)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


@query("op2_simple8b", "documents")
def op2(docs: DataFrame) -> DataFrame:
    path = shared_dir(docs.sparkSession, "tokens")
    tokenfile.write_tokens(docs, path, Encoder(tokenizer_file("word_bpe_49k.json"), drops_blanks=True))
    return tokenfile.read_digests(docs.sparkSession, path)


@query("op3_interleave", "documents")
def op3(docs: DataFrame) -> DataFrame:
    return shards.assign_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op4_quality", "documents")
def op4(docs: DataFrame) -> DataFrame:
    return quality.scored(docs).select(
        F.col("doc.doc_id").alias("doc_id"), "quality.votes", "quality.posterior", "quality.score",
        (F.col("quality.score") >= 0.5).alias("keep"))


@query("op5_multiset_hash", "documents")
def op5(docs: DataFrame) -> DataFrame:
    return fingerprints.compare_with_next(docs)


@query("op6_line_dedup", "documents", r"""
    WITH lines AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
    keyed AS (
        SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
    owners AS (
        SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
    marked AS (
        SELECT k.doc_id, k.pos, k.line, coalesce(o.owner <> k.doc_id, FALSE) AS gone
        FROM keyed k LEFT JOIN owners o ON k.key = o.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id""")
def op6(docs: DataFrame) -> DataFrame:
    return linededup.with_bitmaps(docs).select(
        F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_fair_queue_mix", "documents", r"""
    WITH docs AS (
        SELECT doc_id, coalesce('0' || source, '1') AS stratum,
               len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
    drawn AS (
        SELECT *, ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || size::VARCHAR), 1, 15))::BIGINT AS draw
        FROM docs),
    sources AS (
        SELECT stratum, sum(size)::BIGINT AS source_size,
               CASE (row_number() OVER (ORDER BY stratum) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
        FROM drawn GROUP BY stratum),
    levels AS (
        SELECT *, source_size * 3.0::DOUBLE AS top, source_size * 3.0::DOUBLE / w AS full_at,
               (sum(source_size) OVER () * 1.0::DOUBLE - coalesce(sum(source_size * 3.0::DOUBLE) OVER (
                   ORDER BY source_size * 3.0::DOUBLE / w, stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / sum(w) OVER (ORDER BY source_size * 3.0::DOUBLE / w, stratum ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
        FROM sources),
    targets AS (
        SELECT stratum, source_size, least(
            (SELECT arg_min(level, (full_at, stratum)) FROM levels WHERE level <= full_at) * w, top) AS target FROM levels),
    queued AS (
        SELECT d.*, t.source_size, t.target, floor(t.target)::BIGINT AS words,
               (coalesce(sum(size) OVER (PARTITION BY d.stratum ORDER BY draw, doc_id, size
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS before
        FROM drawn d JOIN targets t ON d.stratum = t.stratum)
    SELECT doc_id, size, source_size, target,
           greatest(0, least(size, words - before)) + greatest(0, least(size, words - source_size - before))
           + greatest(0, least(size, words - 2 * source_size - before)) AS taken,
           CASE WHEN target > 0 THEN (before + size)::DOUBLE / target END AS finish
    FROM queued""")
def op7(docs: DataFrame) -> DataFrame:
    return (mixing.allotments(docs).orderBy("finish", "stratum", "draw")
            .select("doc_id", "size", "source_size", "target", "taken", "finish"))


@query("op8_pivot_topk", "embeddings", r"""
    WITH vecs AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
        FROM vecs q JOIN vecs c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
    SELECT query_id, rank, vec_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
    WHERE rank <= 5""")
def op8(vectors: DataFrame) -> DataFrame:
    rows = topk.quantised(vectors)
    return topk.top_k(rows.where("id % 50 = 0"), rows, k=5)


@query("op9_best_fit_packing", "documents")
def op9(docs: DataFrame) -> DataFrame:
    pieces = packing.pack_documents(docs, Encoder(tokenizer_file("byte_bpe_50k.json"), drops_blanks=False))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op10_html_text", "pages")
def op10(pages: DataFrame) -> DataFrame:
    return html.extract_pages(pages)


def _clustering_sql(k: int, rounds: int) -> str:
    """Every round as one query: squared distances are sums of whole numbers, exact in doubles."""
    square = ("list_inner_product(v.vec, v.vec) + list_inner_product(c.vec, c.vec) - 2.0::DOUBLE * list_inner_product(v.vec, c.vec)")
    parts = [f"""WITH v AS (
        SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS vec FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) = 64
          AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    c0 AS (SELECT * FROM (
        SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR), vec) - 1 AS c, vec FROM v WHERE vec_id IS NOT NULL)
        WHERE c < {k})"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS (
        SELECT n, vec_id, vec, c, d FROM (
            SELECT v.n, v.vec_id, v.vec, c.c, {square} AS d,
                   row_number() OVER (PARTITION BY v.n ORDER BY {square}, c.c) AS r FROM v CROSS JOIN c{i} c) WHERE r = 1)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS (
        SELECT c, list(x ORDER BY p) AS vec FROM (
            SELECT c, p, floor(sum(x) / count(*)) AS x FROM (SELECT c, unnest(vec) AS x, unnest(range(64)) AS p FROM a{i})
            GROUP BY c, p) GROUP BY c
        UNION ALL SELECT c, vec FROM c{i} WHERE c NOT IN (SELECT c FROM a{i}))""")
    return ",\n    ".join(parts) + f"""
    SELECT vec_id, a.c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
           (sum(d) OVER ())::BIGINT AS inertia,
           sha256(array_to_string(list_transform(k.vec, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256
    FROM a{rounds} a JOIN c{rounds} k ON a.c = k.c"""


@query("op11_laesa_clusters", "embeddings", _clustering_sql(40, 5))
def op11(vectors: DataFrame) -> DataFrame:
    return centroids.clusters(vectors).withColumnRenamed("id", "vec_id")


SITES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query("op12_url_filters", "pages", r"""
    WITH rests AS (
        SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
    places AS (
        SELECT row_number() OVER () AS n, page_id,
               coalesce(translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
               coalesce(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2), '') AS path FROM rests),
    rules(rhost, rpath, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                                            ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
    fits AS (
        SELECT n, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
        FROM places JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n)
    SELECT page_id, host, path, rule,
           CASE WHEN rule IS NOT NULL THEN verdict
                WHEN regexp_matches(host || path, '^([^/]*\.)?(ads-track\.|adserver\.|doubleclick\.|adult-|porn|xxx\.|casino-|free-bets\.|poker-|cheap-pills\.|viagra|spam-farm\.|phishing|malware)')
                  OR contains(host || path, '/wp-login.php')
                  OR regexp_matches(host || path, '(?s)/cgi-bin/.*\.exe([^A-Za-z0-9_.%-]|$)') THEN 'block' ELSE 'allow' END AS verdict
    FROM places LEFT JOIN fits ON places.n = fits.n""")
def op12(pages: DataFrame) -> DataFrame:
    rules = urlfilters.rule_table(pages.sparkSession, SITES, urlfilters.UNWANTED)
    judged = urlfilters.judge(pages.select("page_id", "url"), rules)
    return judged.select(F.col("doc.page_id").alias("page_id"), "host", "path", "rule", "verdict")


@query("op13_token_alignment", "documents")
def op13(docs: DataFrame) -> DataFrame:
    bound_batches(docs.sparkSession)
    pair = alignment.TokenizerPair(tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
    return alignment.aligned(docs, pair)
