"""Template derivation plans: a brand is a form, its part types the pages, its parts the fields."""

from pyspark.sql import DataFrame, functions as F

from attestary import fixed, wordings
from attestary.operators import templates as D
from attestary.plans.derive import Forms, derive_templates
from attestary.plans.registry import Source, plain, query
from attestary.session import stage

PAGE = """CASE p_type WHEN 'ECONOMY' THEN 'patientS1Address' WHEN 'MEDIUM' THEN 'employerS1Address' WHEN 'PROMO' THEN 'adiagnosisS1Struct'
  WHEN 'LARGE' THEN 'anamnesis' WHEN 'SMALL' THEN 'Seite1' ELSE 'Seite2' END"""
LEAF = """CASE split_part(p_name, ' ', 2) WHEN 'widget' THEN 'lastName' WHEN 'bolt' THEN 'city' WHEN 'gear' THEN 'code'
  WHEN 'ring' THEN 'phone' ELSE split_part(p_name, ' ', 2) END"""
NODES = f"""
SELECT DISTINCT p_brand AS form_id, CAST(-1 AS BIGINT) AS node, CAST(NULL AS BIGINT) AS parent, CAST(-2 AS BIGINT) AS ord, 'subform' AS tag, 'form' AS name,
  '' AS ui, '' AS caption, CAST(NULL AS STRING) AS item FROM {{part}}
UNION ALL SELECT p_brand, -10 - min(p_partkey), -1, min(p_partkey) * 2 - 1, CASE WHEN p_type IN ('LARGE', 'SMALL') THEN 'exclGroup' ELSE 'subform' END,
  {PAGE}, '', '', NULL FROM {{part}} GROUP BY p_brand, p_type
UNION ALL SELECT p.p_brand, p_partkey, -10 - f.first, p_partkey * 2, 'field', {LEAF.replace('p_name', 'p.p_name')},
  CASE p_size % 4 WHEN 0 THEN 'checkButton' WHEN 1 THEN 'dateTimeEdit' WHEN 2 THEN 'textEdit' ELSE 'choiceList' END,
  CASE WHEN p_size > 40 THEN '  ' ELSE concat(' ', p_name, '  ', CAST(p_size AS STRING)) END, CASE WHEN p_size < 45 THEN CAST(p_partkey AS STRING) END
FROM {{part}} p JOIN (SELECT p_brand AS b, p_type AS t, min(p_partkey) AS first FROM {{part}} GROUP BY p_brand, p_type) f ON p.p_brand = f.b AND p.p_type = f.t"""


def nodes(s: Source) -> DataFrame:
    item = F.when(F.col("item").isNotNull(), F.array("item")).otherwise(F.array().cast("array<string>"))
    return s.shape(NODES).withColumn("items", item).withColumn("readonly", F.lit(False)).drop("item")


def paths(s: Source) -> DataFrame:
    return D.node_paths(nodes(s))


PATHS = f"""
n AS (SELECT *, name || '[' || (row_number() OVER (PARTITION BY form_id, parent, name ORDER BY ord) - 1) || ']' AS part FROM ({plain(NODES)}) x),
p1 AS (SELECT *, part AS som, '' AS page FROM n WHERE parent IS NULL),
p2 AS (SELECT n.*, p1.som || '.' || n.part AS som, n.name AS page FROM n JOIN p1 ON n.form_id = p1.form_id AND n.parent = p1.node),
p3 AS (SELECT n.*, p2.som || '.' || n.part AS som, p2.name AS page FROM n JOIN p2 ON n.form_id = p2.form_id AND n.parent = p2.node),
p AS (SELECT *, replace(replace(som, '[0]', ''), '.', '/') AS xml_path FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) u)"""


@query("sibling_paths", f"WITH {PATHS} SELECT form_id, node, som, xml_path FROM p")
def sibling_paths(s: Source) -> DataFrame:
    return paths(s).select("form_id", "node", "som", "xml_path")


CONTEXTS = [("diagnosisS1Struct", "code", "Code CIM du diagnostic ?", None), ("anamnesisStruct", "phone", "Numéro noté ?", "int")]
LEAVES = [("lastName", "Quel est le nom {role} ?", None), ("city", "Quelle est la localité  de l'adresse {role} ?", "date"),
          ("code", "Quel code ?", None)]


def vocabularies(s: Source) -> tuple[DataFrame, DataFrame, DataFrame]:
    leaf = "leaf string, question string, vocab_type string"
    return (s.spark.createDataFrame(CONTEXTS, "struct string, " + leaf), s.spark.createDataFrame(LEAVES, leaf),
            D.vocabulary(s.spark, fixed.ROLES, ("struct", "role")))


ROLE = "CASE page WHEN 'patientS1Address' THEN 'du patient' WHEN 'employerS1Address' THEN 'de l''employeur' END"


WORDING = """CASE WHEN page = 'adiagnosisS1Struct' AND name = 'code' THEN 'Code CIM du diagnostic ?'
    WHEN page = 'anamnesis' AND name = 'phone' THEN 'Numéro noté ?' WHEN name = 'code' THEN 'Quel code ?'
    WHEN role IS NULL THEN '' WHEN name = 'lastName' THEN 'Quel est le nom ' || role || ' ?'
    WHEN name = 'city' THEN 'Quelle est la localité de l''adresse ' || role || ' ?' ELSE '' END"""
VOCAB_TYPE = "CASE WHEN page = 'anamnesis' AND name = 'phone' THEN 'int' WHEN name = 'city' THEN 'date' END"


# The field names of the fixed wordings, one after the other over the nodes, and one that has no wording.
NAMES = [*wordings.FIELD_QUESTIONS, *dict.fromkeys(leaf for _, leaf in wordings.CONTEXT_QUESTIONS), "sansLibelle"]


def _values(rows: list[tuple]) -> str:
    def text(x):
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join(f"({', '.join(map(text, r))})" for r in rows) + ")"


@query("describe", f"""
WITH {PATHS},
q AS (SELECT form_id, node, CASE WHEN node >= 0 THEN page END AS page, CASE WHEN node >= 0 THEN ({NAMES})[node % {len(NAMES)} + 1] ELSE name END AS name FROM p),
s AS (SELECT *, CASE page WHEN 'adiagnosisS1Struct' THEN 'diagnosisS1Struct' WHEN 'anamnesis' THEN 'anamnesisStruct' ELSE page END AS struct FROM q),
e AS (SELECT s.form_id, s.node, role, c.leaf IS NOT NULL OR l.leaf IS NOT NULL AS known, CASE WHEN c.leaf IS NOT NULL THEN c.question ELSE l.question END AS text,
    CASE WHEN c.leaf IS NOT NULL THEN c.kind ELSE l.kind END AS kind
  FROM s LEFT JOIN {_values([(a, b, *e) for (a, b), e in wordings.CONTEXT_QUESTIONS.items()])} c(struct, leaf, question, kind) ON s.struct = c.struct AND s.name = c.leaf
  LEFT JOIN {_values([(k, *e) for k, e in wordings.FIELD_QUESTIONS.items()])} l(leaf, question, kind) ON s.name = l.leaf
  LEFT JOIN {_values(list(fixed.ROLES.items()))} r(struct, role) ON s.page = r.struct)
SELECT form_id, node, CASE WHEN NOT known OR (contains(text, '{{role}}') AND role IS NULL) THEN ''
  ELSE replace(replace(text, '{{role}}', coalesce(role, '')), '  ', ' ') END AS question, kind AS vocab_type FROM e""".replace("{{role}}", "{role}"))
def describe(s: Source) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("node") % len(NAMES) + 1).cast("int"))
    rows = paths(s).withColumn("name", F.when(F.col("node") >= 0, name).otherwise(F.col("name")))
    return D.describe(rows, *D.standard_vocabularies(s.spark)).select("form_id", "node", "question", "vocab_type")


OPTIONS = f"""
o AS (SELECT f.form_id, f.parent AS node, string_agg(trim(regexp_replace(f.caption, ' +', ' ', 'g')), '|' ORDER BY f.ord) AS options,
  string_agg(f.item, '|' ORDER BY f.ord) AS option_values FROM ({plain(NODES)}) f JOIN ({plain(NODES)}) g ON f.form_id = g.form_id AND f.parent = g.node
  WHERE g.tag = 'exclGroup' AND f.tag = 'field' AND trim(f.caption) <> '' AND f.item IS NOT NULL GROUP BY ALL)"""


@query("group_options", f"WITH {OPTIONS} SELECT * FROM o")
def group_options(s: Source) -> DataFrame:
    return D.group_options(nodes(s)).select("form_id", "node", F.array_join("options", "|").alias("options"),
                                            F.array_join("option_values", "|").alias("option_values"))


@query("node_types", f"""
WITH {OPTIONS} SELECT n.form_id, n.node, CASE WHEN tag = 'exclGroup' AND o.node IS NOT NULL THEN 'choice' WHEN ui = 'checkButton' THEN 'bool'
  WHEN ui = 'dateTimeEdit' THEN 'date' WHEN ui = 'choiceList' THEN 'choice' END AS type
FROM ({plain(NODES)}) n LEFT JOIN o ON n.form_id = o.form_id AND n.node = o.node""")
def node_types(s: Source) -> DataFrame:
    rows = nodes(s)
    return rows.join(D.group_options(rows), ["form_id", "node"], "left").select(
        "form_id", "node", D.node_type(F.col("ui"), F.col("tag"), F.col("options")).alias("type"))


def widgets(rows: DataFrame, which: str = "node % 3 > 0") -> DataFrame:
    w = F.regexp_replace("som", r"^form\[0\]\.", "form[0].#area[0].")
    return rows.where(which).select("form_id", "ord", w.alias("widget"), F.when(
        F.col("node") % 5 == 0, "<TT.MM.JJJJ>").when(F.col("node") % 5 == 1, " ").otherwise(F.col("name")).alias("value"))


def widgets_sql(which: str) -> str:
    return f"""
w AS (SELECT form_id, som, replace(som, 'form[0].', 'form[0].#area[0].') AS widget,
  CASE node % 5 WHEN 0 THEN '<TT.MM.JJJJ>' WHEN 1 THEN ' ' ELSE name END AS value FROM p WHERE {which})"""


WIDGETS = f"{PATHS}, {widgets_sql('node % 3 > 0')}"
PRESET = "CASE WHEN trim(value) <> '' AND value NOT LIKE '<%' THEN value END"


@query("match_widgets", f"""
WITH {WIDGETS} SELECT p.form_id, p.node, w.widget, {PRESET} AS preset
FROM p LEFT JOIN w ON p.form_id = w.form_id AND p.som = w.som""")
def match_widgets(s: Source) -> DataFrame:
    p = paths(s)
    out = D.match_widgets(p, widgets(p))
    return out.select("form_id", "node", "widget", D.preset_value(F.col("widget_value")).alias("preset"))


def prior(rows: DataFrame) -> DataFrame:
    """Earlier templates: some fields known by widget name, some by path, some gone."""
    n = F.col("node")
    return rows.where("node > 0 AND node % 2 = 0").select(
        "form_id", "ord", F.concat(F.when(n % 7 == 0, "x").otherwise((n % 7).cast("string")), F.lit("."), n.cast("string")).alias("field_id"),
        F.when(n % 10 != 0, F.concat(F.lit("Q"), n.cast("string"))).alias("question"),
        F.when(n % 4 == 0, F.col("som")).otherwise(F.concat(F.lit("gone"), n.cast("string"))).alias("acroform_name"),
        F.when(n % 3 == 0, F.concat(F.lit("other/"), F.col("xml_path"))).alias("xml_path"),
        F.when(n % 8 == 0, "percent").alias("type"), F.lit(True).alias("required"))


MERGED = f"""{PATHS},
k0 AS (SELECT *, array_to_string(list_slice(string_split(xml_path, '/'), -2, -1), '/') AS pk FROM p),
pr AS (SELECT form_id, ord, (CASE WHEN node % 7 = 0 THEN 'x' ELSE CAST(node % 7 AS VARCHAR) END) || '.' || node AS field_id, 'Q' || node AS question,
  CASE WHEN node % 4 = 0 THEN som ELSE 'gone' || node END AS a, CASE WHEN node % 3 = 0 THEN pk END AS x FROM k0 WHERE node > 0 AND node % 2 = 0 AND node % 10 <> 0),
ix AS (SELECT form_id, key, field_id, question FROM (SELECT form_id, ord, 0 AS slot, a AS key, field_id, question FROM pr
  UNION ALL SELECT form_id, ord, 1, x, field_id, question FROM pr WHERE x IS NOT NULL) y
  QUALIFY row_number() OVER (PARTITION BY form_id, key ORDER BY ord, slot) = 1),
m AS (SELECT k0.form_id, k0.node, k0.ord, k0.som, k0.page, coalesce(i1.question, i2.question) AS question, coalesce(i1.field_id, i2.field_id) AS old
  FROM k0 LEFT JOIN ix i1 ON k0.form_id = i1.form_id AND k0.som = i1.key LEFT JOIN ix i2 ON k0.form_id = i2.form_id AND k0.pk = i2.key)"""


@query("merge_prior", f"WITH {MERGED} SELECT form_id, node, question, old FROM m")
def merge_prior(s: Source) -> DataFrame:
    p = paths(s)
    return D.merge_prior(p, prior(p)).select(
        "form_id", "node", F.col("kept.question").alias("question"), F.col("kept.field_id").alias("old"))


@query("orphans", f"""
WITH {MERGED} SELECT DISTINCT form_id, question FROM ix WHERE (form_id, question) NOT IN (SELECT (form_id, question) FROM m WHERE question IS NOT NULL)""")
def orphans(s: Source) -> DataFrame:
    p = paths(s)
    return D.orphans(prior(p), D.merge_prior(p, prior(p)))


def sections_sql(rows: str) -> str:
    return f"""
h AS (SELECT form_id, max(TRY_CAST(split_part(field_id, '.', 1) AS INT)) AS top FROM ix GROUP BY form_id),
r AS (SELECT *, TRY_CAST(split_part(old, '.', 1) AS INT) AS sec, CASE WHEN som LIKE '%.%' THEN page ELSE 'misc' END AS pg FROM {rows}),
g AS (SELECT form_id, pg, row_number() OVER (PARTITION BY form_id ORDER BY min(ord)) AS k FROM r WHERE sec IS NULL GROUP BY form_id, pg),
z AS (SELECT r.*, coalesce(sec, coalesce(top, 0) + k) AS section_no FROM r LEFT JOIN h USING (form_id) LEFT JOIN g USING (form_id, pg)),
numbered AS (SELECT *, section_no || '.' || row_number() OVER (PARTITION BY form_id, section_no ORDER BY ord) AS field_id FROM z)"""


@query("number_sections", f"""
WITH {MERGED}, {sections_sql('m')} SELECT form_id, node, CAST(section_no AS BIGINT) AS section_no, field_id FROM numbered""")
def number_sections(s: Source) -> DataFrame:
    p = paths(s)
    return D.number_sections(D.merge_prior(p, prior(p)), prior(p)).select("form_id", "node", "section_no", "field_id")


WITH_WIDGETS = "node % 3 <> 0"


@query("derive_template", f"""
WITH {MERGED}, {widgets_sql(WITH_WIDGETS)}, {OPTIONS},
f AS (SELECT p.*, m.question AS kept, m.old, w.widget, w.value, {ROLE.replace('page', 'p.page')} AS role
  FROM p JOIN m ON p.form_id = m.form_id AND p.node = m.node LEFT JOIN w ON p.form_id = w.form_id AND p.som = w.som),
ok AS (SELECT form_id FROM f GROUP BY form_id HAVING count(widget) > 0 AND count(widget) * 2 >= count(*)),
e AS (SELECT * FROM f WHERE widget IS NOT NULL AND form_id IN (SELECT form_id FROM ok)), {sections_sql('e')}
SELECT n.form_id, ord, field_id, name, coalesce(nullif(trim(regexp_replace(caption, '\\s+', ' ', 'g')), ''), name) AS label,
  coalesce(kept, {WORDING}) AS question, kept IS NOT NULL AS required, xml_path, widget AS acroform_name,
  coalesce(CASE WHEN CAST(substr(kept, 2) AS BIGINT) % 8 = 0 THEN 'percent' END, {VOCAB_TYPE},
    CASE WHEN tag = 'exclGroup' AND o.node IS NOT NULL THEN 'choice' WHEN ui = 'checkButton' THEN 'bool'
      WHEN ui = 'dateTimeEdit' THEN 'date' WHEN ui = 'choiceList' THEN 'choice' END) AS type,
  o.options, o.option_values, {PRESET} AS preset, CAST(NULL AS VARCHAR) AS computed
FROM numbered n LEFT JOIN o ON n.form_id = o.form_id AND n.node = o.node""")
def derive_template(s: Source) -> DataFrame:
    p = stage(paths(s), "paths")
    scripts = s.shape(SCRIPTS).withColumn("form_id", F.col("form_id").cast("string"))
    fields, _ = derive_templates(Forms(nodes(s), widgets(p, WITH_WIDGETS), prior(p), *vocabularies(s), scripts))
    return fields.withColumns({c: F.array_join(c, "|") for c in ("options", "option_values")})


BLOCKS = """
SELECT c_custkey AS form_id, 1 AS ord, 'companyName' AS name, CASE WHEN c_acctbal > 3000 THEN c_name END AS preset, 'f/insuranceS1Address/companyName' AS xml_path, 'Q1' AS question FROM {customer}
UNION ALL SELECT c_custkey, 2, 'street', CASE WHEN c_nationkey > 5 THEN concat(' Rue ', CAST(c_nationkey AS STRING)) END, 'f/consumerS1Address/street', 'Q2' FROM {customer}
UNION ALL SELECT c_custkey, 3, 'zip', CASE WHEN c_nationkey > 10 THEN '1000' END, 'f/insuranceS1Address/zip', 'Q3' FROM {customer}
UNION ALL SELECT c_custkey, 4, 'city', CASE WHEN c_nationkey % 2 = 0 THEN 'Lausanne' END, 'f/recipientS1Address/city', 'Q4' FROM {customer}
UNION ALL SELECT c_custkey, 5, 'companyName', 'Ailleurs', 'f/patientS1Address/companyName', 'Q5' FROM {customer}
UNION ALL SELECT c_custkey, 6, 'recipientBlockAddressLeft', NULL, 'f/left', 'Q6' FROM {customer}
UNION ALL SELECT c_custkey, 7, 'recipientBlockAddressRight', NULL, 'f/right', 'Q7' FROM {customer}"""
OWN = "SELECT c_custkey AS form_id FROM {customer} WHERE c_mktsegment = 'MACHINERY'"


@query("recipient_block", f"""
WITH c AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_acctbal > 3000 THEN c_name END AS a, CASE WHEN c_nationkey > 5 THEN 'Rue ' || c_nationkey END AS b,
    nullif(concat_ws(' ', CASE WHEN c_nationkey > 10 THEN '1000' END, CASE WHEN c_nationkey % 2 = 0 THEN 'Lausanne' END), '') AS z FROM customer),
l AS (SELECT c_custkey, c_mktsegment, concat_ws(chr(10), a, b, z) AS block, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (z IS NOT NULL)::INT >= 2 AS good FROM c)
SELECT form_id, ord, CASE WHEN good AND ord >= 6 THEN NULL ELSE question END AS question,
  CASE WHEN good AND ord = 6 THEN CASE WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE block END WHEN good AND ord = 7 THEN '' END AS computed
FROM ({plain(BLOCKS)}) f JOIN l ON f.form_id = l.c_custkey""")
def recipient_block(s: Source) -> DataFrame:
    fields = s.shape(BLOCKS).withColumn("computed", F.lit(None).cast("string"))
    return D.recipient_block(fields, s.shape(OWN)).select("form_id", "ord", "question", "computed")


SCRIPTS = """
SELECT s_suppkey AS form_id, concat('switch (c) {{ case ''VD'': {{ var blockAddress = "', s_name, '%rLigne 2"; a.b.companyName.rawValue = "Office VD"; x.blk.rawValue = blockAddress; }} break; ',
  'case ''GE'' : {{  a.street.rawValue = "Rue ', CAST(s_nationkey AS STRING), '"; a.street.rawValue = " Quai ', CAST(s_nationkey AS STRING), ' "; a.zip.rawValue = "";  }} break; case ''XX'': {{ }} break; }}') AS script
FROM {supplier}"""


@query("canton_table", r"""
SELECT s_suppkey AS form_id, 'VD' AS canton, 'companyName' AS name, 'Office VD' AS value FROM supplier
UNION ALL SELECT s_suppkey, 'VD', 'blk', s_name || chr(10) || 'Ligne 2' FROM supplier
UNION ALL SELECT s_suppkey, 'GE', 'street', 'Quai ' || s_nationkey FROM supplier
UNION ALL SELECT s_suppkey, 'GE', 'zip', '' FROM supplier""")
def canton_table(s: Source) -> DataFrame:
    scripts = s.shape(SCRIPTS).withColumn("script", F.replace("script", F.lit("%r"), F.lit("\\r")))
    return D.canton_table(scripts)


CATALOG = """SELECT p_brand AS form_id, p_partkey AS ord, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name END AS question,
  CASE WHEN p_type = 'PROMO' THEN '' END AS computed, p_name AS field_id, CASE WHEN p_size > 2 THEN CAST(p_size AS STRING) END AS xml_path, '' AS acroform_name FROM {part}"""


@query("catalog_report", f"""
WITH r AS (SELECT form_id, count(*) AS fields, count(*) FILTER (WHERE question <> '') AS written FROM ({plain(CATALOG)}) f WHERE computed IS NULL GROUP BY ROLLUP (form_id))
SELECT *, fields - written AS to_write, fields = written AS reviewed FROM r""")
def catalog_report(s: Source) -> DataFrame:
    return D.catalog_report(s.shape(CATALOG))


@query("template_duplicates", f"""
WITH f AS ({plain(CATALOG)}), k AS (SELECT form_id, 'field_id' AS kind, field_id AS key FROM f UNION ALL SELECT form_id, 'xml_path', xml_path FROM f
  UNION ALL SELECT form_id, 'acroform_name', acroform_name FROM f)
SELECT form_id, kind, key, count(*) AS n FROM k WHERE key <> '' GROUP BY ALL HAVING count(*) > 1""")
def template_duplicates(s: Source) -> DataFrame:
    return D.template_duplicates(s.shape(CATALOG))
