"""Form filling plans: orders are results, customers jobs, suppliers and parts form leaves."""

from pyspark.sql import DataFrame, functions as F

from attestary.operators import fill as W
from attestary.plans.registry import Source, plain, query

RESULTS = """
SELECT o_custkey AS job_id, o_orderstatus AS form_id, o_orderpriority AS field_id, o_orderkey AS result_no,
  CASE o_orderkey % 5 WHEN 0 THEN 'Homme' WHEN 1 THEN ' 12,5 %' WHEN 2 THEN ' non' WHEN 3 THEN '' ELSE 'f (x)' END AS value
FROM {orders}"""
FIELDS = """
SELECT DISTINCT o_orderstatus AS form_id, o_orderpriority AS field_id, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS ord,
  substr(o_orderpriority, 3) AS name, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'sex' WHEN '2' THEN 'percent' WHEN '3' THEN 'choice' END AS type,
  concat('p/', o_orderpriority) AS xml_path, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS acroform_name FROM {orders}"""


def fields(s: Source) -> DataFrame:
    choice = F.col("type") == "choice"
    return (s.shape(FIELDS)
            .withColumn("options", F.when(choice, F.array(F.lit("Oui"), F.lit("Non "))))
            .withColumn("option_values", F.when(choice, F.array(F.lit("0"), F.lit("1")))))


@query("field_values", f"""
SELECT job_id, r.form_id, r.field_id, result_no, xml_path, acroform_name, CASE
  WHEN type = 'sex' THEN CASE WHEN value = 'Homme' THEN 'M' WHEN value LIKE 'f%' THEN 'F' ELSE value END
  WHEN type = 'percent' THEN CASE WHEN value LIKE '%12,5%' THEN '12.5' ELSE value END
  WHEN type = 'choice' AND value = ' non' THEN '1' ELSE value END AS value
FROM ({plain(RESULTS)}) r JOIN ({plain(FIELDS)}) f ON r.form_id = f.form_id AND r.field_id = f.field_id WHERE value <> ''""")
def field_values(s: Source) -> DataFrame:
    out = W.field_values(s.shape(RESULTS), fields(s))
    return out.select("job_id", "form_id", "field_id", "result_no", "xml_path", "acroform_name", "value")


EXTRACTED = """
SELECT o_custkey AS job_id, o_orderkey AS ord, concat('p/', o_orderpriority, '/', o_orderstatus) AS xml_path,
  CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS acroform_name, CAST(o_orderkey AS STRING) AS value FROM {orders}"""
COMPUTED = """
SELECT o_custkey AS job_id, o_orderkey AS ord, concat('p/', o_orderpriority, '/O') AS xml_path, o_orderpriority AS acroform_name,
  concat('c', CAST(o_orderkey AS STRING)) AS value FROM {orders} WHERE o_totalprice > 400000"""
CANTON = """
SELECT c_custkey AS job_id, c_custkey AS ord, 'p/1-URGENT/F' AS xml_path, '1-URGENT' AS acroform_name, n_name AS value
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE n_regionkey = 1"""


def targets_sql(*parts: str) -> str:
    rows = " UNION ALL ".join(f"SELECT job_id, ord, xml_path, acroform_name, value, {i} AS prio FROM ({plain(p)}) p{i}"
                              for i, p in enumerate(parts))
    return f"""
WITH u AS ({rows}),
t AS (SELECT job_id, ord, value, prio, 'xml_path' AS target, xml_path AS name FROM u
  UNION ALL SELECT job_id, ord, value, prio, 'acroform_name', acroform_name FROM u)
SELECT job_id, target, name, value, CAST(prio AS BIGINT) AS prio FROM t WHERE name <> ''
QUALIFY row_number() OVER (PARTITION BY job_id, target, name ORDER BY prio DESC, ord DESC) = 1"""


@query("resolve_targets", targets_sql(EXTRACTED, COMPUTED, CANTON))
def resolve_targets(s: Source) -> DataFrame:
    out = W.resolve_targets(s.shape(EXTRACTED), s.shape(COMPUTED), s.shape(CANTON))
    return out.withColumn("prio", F.col("prio").cast("bigint"))


@query("resolve_targets_rerun", targets_sql(EXTRACTED))
def resolve_targets_rerun(s: Source) -> DataFrame:
    return W.resolve_targets(s.shape(EXTRACTED)).withColumn("prio", F.col("prio").cast("bigint"))


TEMPLATE = """SELECT p_brand AS form_id, CAST(p_partkey AS STRING) AS field_id, p_partkey AS ord, p_name AS name, concat('x/', p_name) AS xml_path,
  p_type AS acroform_name, CASE WHEN p_size < 10 THEN concat('Bloc ', p_type) WHEN p_size < 20 THEN '' END AS computed FROM {part}"""


@query("computed_values", f"SELECT form_id, field_id, computed AS value FROM ({plain(TEMPLATE)}) t WHERE computed <> ''")
def computed_values(s: Source) -> DataFrame:
    return W.computed_values(s.shape(TEMPLATE)).select("form_id", "field_id", "value")


CANTON_RESULTS = """
SELECT c_custkey AS job_id, c_mktsegment AS form_id, '1.1' AS field_id, o_orderkey AS ord,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat(' nation_', CAST(o_orderkey % 30 AS STRING), ' ') END AS value
FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""
CANTON_FIELDS = """SELECT DISTINCT c_mktsegment AS form_id, '1.1' AS field_id, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'canton' ELSE 'treatmentCanton' END AS name FROM {customer}"""
CANTON_TABLE = """
SELECT DISTINCT c_mktsegment AS form_id, n_name AS canton, concat('line', CAST(n_regionkey AS STRING)) AS name, concat('Office ', n_name) AS value
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE n_regionkey <> 2"""


@query("canton_recipient", f"""
WITH k AS (SELECT r.job_id, r.form_id, ord, upper(trim(value)) AS canton FROM ({plain(CANTON_RESULTS)}) r
  WHERE form_id IN (SELECT form_id FROM ({plain(CANTON_FIELDS)}) f WHERE name = 'treatmentCanton')),
f AS (SELECT k.* FROM k WHERE (form_id, canton) IN (SELECT (form_id, canton) FROM ({plain(CANTON_TABLE)}) t)
  QUALIFY row_number() OVER (PARTITION BY job_id, form_id ORDER BY ord) = 1)
SELECT job_id, f.form_id, t.name, t.value FROM f JOIN ({plain(CANTON_TABLE)}) t ON f.form_id = t.form_id AND f.canton = t.canton""")
def canton_recipient(s: Source) -> DataFrame:
    return W.canton_recipient(s.shape(CANTON_RESULTS), s.shape(CANTON_FIELDS), s.shape(CANTON_TABLE))


# --- leaves ---------------------------------------------------------------------------------

LEAVES = """
SELECT l_suppkey AS form_id, concat('f/', CAST(l_partkey AS STRING)) AS path, l_orderkey * 10 + l_linenumber AS ord,
  CASE l_returnflag WHEN 'A' THEN ' On ' WHEN 'R' THEN CASE WHEN l_quantity < 10 THEN 'Off' ELSE 'x' END ELSE '' END AS text FROM {lineitem}"""
PATHS = f"""SELECT form_id, path, min(ord) AS ord FROM ({plain(LEAVES)}) l WHERE trim(text) IN ('On', 'Off') GROUP BY ALL"""


@query("checkbox_paths", f"SELECT form_id, path, ord, row_number() OVER (PARTITION BY form_id ORDER BY ord, path) - 1 AS no FROM ({PATHS}) p")
def checkbox_paths(s: Source) -> DataFrame:
    return W.checkbox_paths(s.shape(LEAVES))


BOX_VALUES = """
SELECT l_suppkey AS form_id, concat('f/', CAST(l_partkey AS STRING)) AS path, l_orderkey, l_linenumber,
  CASE l_linenumber % 4 WHEN 0 THEN 'oui' WHEN 1 THEN ' X ' WHEN 2 THEN 'On' ELSE 'texte' END AS value FROM {lineitem}"""


@query("normalize_checkboxes", f"""
SELECT v.form_id, v.path, l_orderkey, l_linenumber, CASE WHEN p.path IS NULL THEN value WHEN value IN (' X ', 'On') THEN 'On' ELSE 'Off' END AS value
FROM ({plain(BOX_VALUES)}) v LEFT JOIN ({PATHS}) p ON v.form_id = p.form_id AND v.path = p.path""")
def normalize_checkboxes(s: Source) -> DataFrame:
    return W.normalize_checkboxes(s.shape(BOX_VALUES), W.checkbox_paths(s.shape(LEAVES)))


TREE = """SELECT p_brand AS form_id, concat('x/', CAST(p_partkey AS STRING)) AS path, CASE WHEN p_size < 20 THEN ' ' ELSE p_name END AS text FROM {part}"""
WRITTEN = """
SELECT p_brand AS form_id, concat('x/', CAST(p_partkey + CASE WHEN p_type = 'PROMO' THEN 1000000 ELSE 0 END AS STRING)) AS path,
  CASE WHEN p_size < 5 THEN NULL WHEN p_size < 25 THEN 'true' ELSE '007' END AS value,
  CASE p_type WHEN 'SMALL' THEN 'bool' WHEN 'LARGE' THEN 'int' WHEN 'MEDIUM' THEN 'date' END AS type FROM {part} WHERE p_size % 2 = 0"""


def upsert_sql(free: str) -> str:
    return f"""
SELECT t.form_id, t.path, CASE WHEN w.path IS NULL OR NOT ({free}) THEN text WHEN value IS NULL THEN ''
  WHEN type = 'bool' THEN CASE WHEN value = 'true' THEN '1' ELSE '0' END WHEN type = 'int' AND value = '007' THEN '7' ELSE value END AS text
FROM ({plain(TREE)}) t LEFT JOIN ({plain(WRITTEN)}) w ON t.form_id = w.form_id AND t.path = w.path"""


@query("upsert_leaves", upsert_sql("true"))
def upsert_leaves(s: Source) -> DataFrame:
    return W.upsert_leaves(s.shape(TREE), s.shape(WRITTEN))


@query("upsert_blank_leaves", upsert_sql("trim(text) = ''"))
def upsert_blank_leaves(s: Source) -> DataFrame:
    return W.upsert_leaves(s.shape(TREE), s.shape(WRITTEN), overwrite=False)


@query("unknown_paths", f"""
SELECT form_id, path FROM ({plain(WRITTEN)}) w WHERE (form_id, path) NOT IN (SELECT (form_id, path) FROM ({plain(TREE)}) t)""")
def unknown_paths(s: Source) -> DataFrame:
    return W.unknown_paths(s.shape(TREE), s.shape(WRITTEN)).select("form_id", "path")


ELEMENTS = """
SELECT o_custkey AS form_id, 'root' AS node, CAST(NULL AS STRING) AS parent, 'form' AS tag, CAST(-1 AS BIGINT) AS ord FROM {orders} GROUP BY o_custkey
UNION ALL SELECT o_custkey, concat('o', CAST(o_orderkey AS STRING)), 'root', 'order', o_orderkey * 10 FROM {orders}
UNION ALL SELECT o_custkey, concat('l', CAST(l_orderkey * 10 + l_linenumber AS STRING)), concat('o', CAST(o_orderkey AS STRING)), l_returnflag, l_orderkey * 10 + l_linenumber
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"""
ASKED = "SELECT DISTINCT o_custkey AS form_id, p AS path FROM {orders} LATERAL VIEW explode(array('form/order[1]/A', 'order/N', '/order[2]/R[1]', 'order', 'form/none')) t AS p"


@query("match_paths", f"""
WITH e AS ({plain(ELEMENTS)}), o AS (SELECT *, row_number() OVER (PARTITION BY form_id ORDER BY ord) - 1 AS i FROM e WHERE tag = 'order'),
l AS (SELECT e.*, o.i, o.ord AS o_ord, row_number() OVER (PARTITION BY e.form_id, e.parent, e.tag ORDER BY e.ord) - 1 AS k FROM e JOIN o ON e.form_id = o.form_id AND e.parent = o.node)
SELECT form_id, 'form/order[1]/A' AS path, node FROM l WHERE i = 1 AND tag = 'A' AND k = 0
UNION ALL SELECT form_id, 'order/N', arg_min(node, ord) FROM l WHERE tag = 'N' AND k = 0 GROUP BY form_id
UNION ALL SELECT form_id, '/order[2]/R[1]', node FROM l WHERE i = 2 AND tag = 'R' AND k = 1
UNION ALL SELECT form_id, 'order', node FROM o WHERE i = 0""")
def match_paths(s: Source) -> DataFrame:
    return W.match_paths(s.shape(ELEMENTS), s.shape(ASKED))


FORMS = "SELECT p_partkey AS form_id, p_size % 2 = 0 AS has_xfa, p_type IN ('SMALL', 'LARGE', 'PROMO') AS has_widgets FROM {part}"


@query("form_kind", f"""
SELECT form_id, CASE WHEN has_xfa AND has_widgets THEN 'hybrid' WHEN has_xfa THEN 'xfa' WHEN has_widgets THEN 'acroform' ELSE 'none' END AS kind,
  CASE WHEN has_xfa AND has_widgets THEN 'xfa,acroform' WHEN has_xfa THEN 'xfa' WHEN has_widgets THEN 'acroform' ELSE '' END AS steps FROM ({plain(FORMS)}) f""")
def form_kind(s: Source) -> DataFrame:
    return W.form_kind(s.shape(FORMS)).select("form_id", "kind", F.array_join("steps", ",").alias("steps"))


RADIO = """SELECT l_orderkey, l_linenumber, l_suppkey AS form_id, l_returnflag AS name, concat(' ', CAST(l_linenumber AS STRING)) AS value FROM {lineitem}"""
STATES = """SELECT DISTINCT l_suppkey AS form_id, l_returnflag AS name, CAST(CAST(l_quantity AS INT) AS STRING) AS state FROM {lineitem} WHERE l_quantity < 4"""


@query("fill_radio", f"""
SELECT l_orderkey, l_linenumber, r.form_id, r.name, trim(value) AS state FROM ({plain(RADIO)}) r
WHERE (form_id, name, trim(value)) IN (SELECT (form_id, name, state) FROM ({plain(STATES)}) s)""")
def fill_radio(s: Source) -> DataFrame:
    return W.fill_radio(s.shape(RADIO), s.shape(STATES)).select("l_orderkey", "l_linenumber", "form_id", "name", "state")
