"""Evaluation plans, and test dossiers rendered from customers and nations."""

from pyspark.sql import DataFrame, functions as F

from attestary.operators import dossiers as D, evaluation as E
from attestary.plans.registry import Source, plain, query

TRUTH = """
SELECT o_custkey AS job_id, o_orderkey AS field_id, o_orderstatus AS category, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'exact' WHEN '2' THEN 'fuzzy'
    WHEN '3' THEN 'date' WHEN '4' THEN 'étrange' ELSE 'contains' END AS tolerance,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN CASE o_orderstatus WHEN 'F' THEN 'F' WHEN 'O' THEN '50%' ELSE 'M' END WHEN '2' THEN 'Rue du Lac'
    WHEN '3' THEN '15.03.2025' END AS expected
FROM {orders}"""
EXTRACTED = """
SELECT o_custkey AS job_id, o_orderkey AS field_id, CASE substr(o_orderpriority, 1, 1)
  WHEN '1' THEN CASE o_orderkey % 4 WHEN 0 THEN 'Féminin' WHEN 1 THEN ' 50 ' WHEN 2 THEN 'masculin' ELSE '' END
  WHEN '2' THEN CASE o_orderkey % 3 WHEN 0 THEN 'rue du lac 12' WHEN 1 THEN '  ' ELSE 'Autre' END
  WHEN '3' THEN CASE o_orderkey % 3 WHEN 0 THEN '15/03/2025' WHEN 1 THEN '15-03-2025' ELSE '16.03.2025' END
  ELSE CASE o_orderkey % 3 WHEN 0 THEN 'Hernie en l4-l5' WHEN 1 THEN 'hernie' ELSE 'rien' END END AS value
FROM {orders} WHERE o_totalprice > 50000"""


def compared(s: Source) -> DataFrame:
    keywords = F.when(F.col("tolerance") == "contains", F.array(F.lit("hernie"), F.lit("L4-L5")))
    truth = s.shape(TRUTH).withColumn("keywords", keywords)
    return E.compare(E.eval_join(truth, s.shape(EXTRACTED)))


COMPARED = f"""
WITH j AS (SELECT t.*, value, coalesce(value, '') = '' AS absent, lower(trim(value)) AS x FROM ({plain(TRUTH)}) t LEFT JOIN ({plain(EXTRACTED)}) e ON t.job_id = e.job_id AND t.field_id = e.field_id),
k AS (SELECT *, CASE WHEN tolerance = 'contains' THEN list_filter(['hernie', 'L4-L5'], lambda w: NOT contains(coalesce(x, ''), lower(w))) ELSE [] END AS missing,
  CASE WHEN tolerance = 'contains' THEN list_filter(['hernie', 'L4-L5'], lambda w: contains(coalesce(x, ''), lower(w))) ELSE [] END AS found FROM j),
m AS (SELECT *, CASE WHEN absent THEN false WHEN tolerance = 'exact' THEN rtrim(lower(expected), '%') = CASE x WHEN 'féminin' THEN 'f' WHEN 'masculin' THEN 'm' ELSE x END
  WHEN tolerance = 'fuzzy' THEN contains(x, 'rue du lac') OR contains('rue du lac', x) WHEN tolerance = 'date' THEN translate(x, '/-', '..') = '15.03.2025'
  WHEN tolerance = 'contains' THEN len(missing) = 0 ELSE false END AS match FROM k),
c AS (SELECT job_id, field_id, category, tolerance, expected, value, match, array_to_string(found, ',') AS keywords_found, array_to_string(missing, ',') AS keywords_missing,
  CASE WHEN absent THEN 'Pas de valeur extraite' WHEN tolerance = 'étrange' THEN 'Tolérance inconnue: étrange' WHEN match THEN NULL
    WHEN tolerance = 'exact' THEN 'Attendu ''' || expected || ''', obtenu ''' || value || '''' WHEN tolerance = 'fuzzy' THEN 'Fuzzy fail: ''' || expected || ''' vs ''' || value || ''''
    WHEN tolerance = 'date' THEN 'Date: ''' || expected || ''' vs ''' || value || '''' ELSE 'Mots-clés manquants: [''' || array_to_string(missing, ''', ''') || ''']' END AS reason FROM m)"""


@query("eval_compare", f"{COMPARED} SELECT * FROM c")
def eval_compare(s: Source) -> DataFrame:
    return compared(s).select(
        "job_id", "field_id", "category", "tolerance", "expected", "value", "match", "reason",
        F.array_join("keywords_found", ",").alias("keywords_found"),
        F.array_join("keywords_missing", ",").alias("keywords_missing"))


@query("accuracy", f"""
{COMPARED}, a AS (SELECT category, count(*) AS fields, count(*) FILTER (WHERE match) AS correct FROM c GROUP BY ROLLUP (category))
SELECT *, round_even(correct / fields * 100, 1) AS accuracy, CASE WHEN correct = fields THEN 'OK' WHEN correct > 0 THEN 'PARTIEL' ELSE 'ÉCHEC' END AS state FROM a""")
def accuracy(s: Source) -> DataFrame:
    return E.accuracy(compared(s))


@query("eval_failures", f"{COMPARED} SELECT job_id, field_id, category, expected, value, reason, keywords_missing FROM c WHERE NOT match")
def eval_failures(s: Source) -> DataFrame:
    return E.failures(compared(s)).withColumn("keywords_missing", F.array_join("keywords_missing", ","))


@query("eval_successes", f"{COMPARED} SELECT job_id, field_id, category, substr(value, 1, 40) AS shown FROM c WHERE match")
def eval_successes(s: Source) -> DataFrame:
    return E.successes(compared(s))


FORMS = "SELECT c_custkey AS form_id FROM {customer} WHERE c_acctbal > 2000"
SCENARIOS = "SELECT o_custkey AS form_id FROM {orders} WHERE o_orderstatus = 'P'"


@query("coverage", f"""
WITH f AS ({plain(FORMS)}), s AS ({plain(SCENARIOS)})
SELECT form_id, 'covered' AS state FROM (SELECT * FROM f INTERSECT SELECT * FROM s) a
UNION ALL SELECT form_id, 'no_scenario' FROM (SELECT * FROM f EXCEPT SELECT * FROM s) b
UNION ALL SELECT form_id, 'no_form' FROM (SELECT * FROM s EXCEPT SELECT * FROM f) c""")
def coverage(s: Source) -> DataFrame:
    return E.coverage(s.shape(FORMS), s.shape(SCENARIOS))


# --- dossiers -------------------------------------------------------------------------------

CASES = """
SELECT c_custkey AS form, c_name AS nom, concat('P', CAST(c_nationkey AS STRING)) AS prenom, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sexe,
  concat(lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0'), '.03.1980') AS naissance, n_name AS ville, c_mktsegment AS profession,
  CASE WHEN c_acctbal > 5000 THEN 'ACME SA' ELSE '' END AS employeur, CAST(c_acctbal AS STRING) AS police, c_acctbal > 7000 AS has_accident,
  c_acctbal > 2000 AS has_incapacity, CASE WHEN c_custkey % 3 = 0 THEN ' stable ' ELSE '' END AS evolution
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"""


def scenarios(s: Source) -> DataFrame:
    """Scenario rows: nested columns over the flat case table."""
    t = s.shape(CASES)
    c, lit = F.col, F.lit
    patient = F.struct(c("nom"), c("prenom"), c("sexe"), c("naissance"), lit("756.1").alias("avs"), lit("Rue 1").alias("rue"),
                       lit("2000").alias("npa"), c("ville"), lit("NE").alias("canton"), lit("032").alias("tel"), lit("a@b.ch").alias("email"),
                       lit("marié").alias("etat_civil"), c("profession"), c("employeur"), lit("100 %").alias("taux_activite"))
    doctor = F.struct(*[lit(x).alias(x) for x in ("nom", "specialite", "cabinet", "rue", "npa", "ville", "tel", "email", "rcc", "gln")])
    day = F.struct(lit("01.02.2025").alias("debut"), F.when(c("form") % 2 == 0, "28.02.2025").otherwise("").alias("fin"), lit("50 %").alias("taux"))
    accident = F.struct(lit("01.01.2025").alias("date"), lit("10:00").alias("heure"), c("ville").alias("lieu"), lit(None).cast("string").alias("employeur"),
                        lit(" chute ").alias("description"), F.when(c("form") % 5 == 0, "Jean").alias("temoin"), lit(" glace ").alias("premiers_soins"))
    own = F.when(c("form") % 4 == 0, F.array(F.struct(lit("lettre").alias("nom"), lit("Lettre").alias("titre"), lit(" corps ").alias("corps"))))
    return t.select(
        "form", patient.alias("patient"), doctor.alias("medecin"), lit("SUVA").alias("assureur"), "police", lit("02.03.2025").alias("date_rapport"),
        lit("demande").alias("contexte"), lit("anamnèse").alias("anamnese"), F.array(lit("asthme"), c("profession")).alias("antecedents"),
        F.array(F.struct(lit("M54").alias("code"), lit("lombalgie").alias("libelle"), c("naissance").alias("date"))).alias("diagnostics"),
        F.when(c("form") % 2 == 0, F.array(lit("repos"))).otherwise(F.array().cast("array<string>")).alias("traitements"),
        F.array(F.struct(lit("03.02.2025").alias("date"), lit(" S: mal ").alias("note")), F.struct(lit("01.02.2025").alias("date"), lit("O: rien").alias("note"))).alias("consultations"),
        F.when(c("has_incapacity"), F.array(day)).otherwise(F.array().cast("array<struct<debut:string,fin:string,taux:string>>")).alias("incapacites"),
        F.when(c("has_accident"), accident).alias("accident"), own.alias("documents"), "evolution", lit("").alias("pronostic"))


def _l(*lines: str) -> str:
    return f"array_to_string(list_filter([{', '.join(lines)}], lambda x: x IS NOT NULL), chr(10))"


def _q(*texts: str) -> list[str]:
    return ["'" + t.replace("'", "''") + "'" for t in texts]


RENDERED = f"""
WITH c AS (SELECT *, 'Patient : ' || nom || ' ' || prenom AS who FROM ({plain(CASES)}) x),
d AS (
SELECT form, 1 AS k, 'fiche-administrative' AS name, {_l(*_q('# Fiche administrative', '', 'Établie le 02.03.2025 — document interne du cabinet.', '', '## Identité', ''), "'- Nom : ' || nom", "'- Prénom : ' || prenom", "'- Sexe : ' || sexe", "'- Date de naissance : ' || naissance", *_q('- N° AVS : 756.1', '- État civil : marié', '', '## Coordonnées', ''), "'- Adresse : Rue 1, 2000 ' || ville || ' (canton de NE)'", *_q('- Téléphone : 032', '- E-mail : a@b.ch', '', '## Situation professionnelle', ''), "'- Profession : ' || profession", "CASE WHEN employeur <> '' THEN '- Employeur : ' || employeur END", *_q("- Taux d'activité : 100 %", '', '## Couverture', '', '- Assureur concerné : SUVA'), "'- N° de police / de contrat : ' || police", *_q('', '## Médecin traitant', '', '- nom, specialite', '- cabinet, rue, npa ville', '- Téléphone : tel', '- E-mail : email', '- N° RCC : rcc', '- N° GLN : gln', '', '## Contexte de la démarche', '', 'demande', ''))} AS text FROM c
UNION ALL SELECT form, 2, 'anamnese-antecedents', {_l(*_q('# Anamnèse et antécédents', ''), "who || ', né(e) le ' || naissance", *_q('', '## Anamnèse actuelle', '', 'anamnèse', '', '## Antécédents', '', '- asthme'), "'- ' || profession", *_q('', '## Diagnostics retenus', ''), "'- lombalgie (M54) — depuis le ' || naissance", *_q('', '## Traitement en cours', ''), "CASE WHEN form % 2 = 0 THEN '- repos' END", "''")} FROM c
UNION ALL SELECT form, 3, 'consultations', {_l(*_q('# Notes de consultation', ''), "who || ', ' || naissance", *_q('Format SOAP, ordre antichronologique.', '', '## Consultation du 03.02.2025', '', 'S: mal', '', '## Consultation du 01.02.2025', '', 'O: rien', ''), *[f"CASE WHEN evolution <> '' THEN {x} END" for x in _q('## Évolution', '', 'stable', '')])} FROM c
UNION ALL SELECT form, 4, 'lettre', '# Lettre' || chr(10) || chr(10) || who || ', ' || naissance || chr(10) || chr(10) || 'corps' || chr(10) FROM c WHERE form % 4 = 0
UNION ALL SELECT form, 5, 'accident', {_l(*_q("# Déclaration d'accident", ''), "who || ', ' || naissance", *_q('', "- Date de l'accident : 01.01.2025", '- Heure : 10:00'), "'- Lieu : ' || ville", "'- Employeur au moment des faits : ' || employeur", "'- Assureur-accidents : SUVA, police ' || police", *_q('', '## Déroulement', '', 'chute', ''), *[f"CASE WHEN form % 5 = 0 THEN {x} END" for x in _q('## Témoin', '', 'Jean', '')], *_q('## Premiers soins', '', 'glace', ''))} FROM c WHERE has_accident
UNION ALL SELECT form, 6, 'incapacites-travail', {_l(*_q("# Attestations d'incapacité de travail", ''), "who || ', ' || naissance", "'Profession : ' || profession", "''", "'- Incapacité de travail de 50 % ' || CASE WHEN form % 2 = 0 THEN 'du 01.02.2025 au 28.02.2025.' ELSE 'depuis le 01.02.2025, sans terme fixé.' END", "''")} FROM c WHERE has_incapacity)
SELECT form, row_number() OVER (PARTITION BY form ORDER BY k) AS doc_no, printf('%02d_', row_number() OVER (PARTITION BY form ORDER BY k)) || name AS filename, md5(text) AS digest FROM d"""


@query("render_dossier", RENDERED)
def render_dossier(s: Source) -> DataFrame:
    out = D.render_dossier(scenarios(s))
    return out.select("form", F.col("doc_no").cast("bigint").alias("doc_no"), "filename", F.md5("markdown").alias("digest"))


REQUESTS = """
SELECT n_nationkey AS job_id, count(DISTINCT c_custkey) AS count, count(DISTINCT s_suppkey) AS noise
FROM {nation} LEFT JOIN {customer} ON c_nationkey = n_nationkey LEFT JOIN {supplier} ON s_nationkey = n_nationkey GROUP BY n_nationkey"""
STYLES = ["report", "letter", "notes"]
TEMPLATES = [("report", "Nom : {2.2}\nPrénom : {2.1}\n"), ("letter", "Je suis {2.1} {2.2} ({9.9})."), ("notes", "{2.2}")]
PLAN = f"""
WITH r AS (SELECT *, greatest(1, count // 3) AS each, greatest(0, count - greatest(1, count // 3) * 3) AS rest FROM ({plain(REQUESTS)}) x),
n AS (SELECT r.*, i AS doc_no FROM r, range(1, each * 3 + rest + noise + 1) t(i)),
p AS (SELECT *, CASE WHEN doc_no <= each + least(rest, 1) THEN 'report' WHEN doc_no <= each * 2 + least(rest, 2) THEN 'letter' WHEN doc_no <= each * 3 + rest THEN 'notes' END AS style FROM n)"""


def requests(s: Source) -> DataFrame:
    """The rows of ``REQUESTS``, with customers and suppliers counted before they meet a nation: their pairs are never rows."""
    def counted(table: str, nation: str, key: str, name: str) -> DataFrame:
        return s.table(table).groupBy(F.col(nation).alias("job_id")).agg(F.countDistinct(key).alias(name))
    nations = s.table("nation").select(F.col("n_nationkey").alias("job_id")).distinct()
    return (nations.join(counted("customer", "c_nationkey", "c_custkey", "count"), "job_id", "left")
            .join(counted("supplier", "s_nationkey", "s_suppkey", "noise"), "job_id", "left")
            .na.fill(0, ["count", "noise"]))


def corpus(s: Source) -> DataFrame:
    return D.corpus_plan(requests(s), STYLES)


@query("corpus_plan", f"""
{PLAN} SELECT job_id, doc_no, style, CASE WHEN style IS NULL THEN 'noise' ELSE 'patient' END AS kind,
  CASE WHEN style IS NULL THEN printf('noise_%03d', doc_no) ELSE printf('patient_%03d_', doc_no) || style END AS filename FROM p""")
def corpus_plan(s: Source) -> DataFrame:
    return corpus(s)


@query("corpus_manifest", f"{PLAN} SELECT job_id, count(*) AS total_docs, count(style) AS patient_docs, count(*) - count(style) AS noise_docs FROM p GROUP BY job_id")
def corpus_manifest(s: Source) -> DataFrame:
    return D.corpus_manifest(corpus(s))


def corpus_texts(s: Source) -> DataFrame:
    truth = s.table("nation").select(
        F.col("n_nationkey").alias("job_id"),
        F.inline(F.array(F.struct(F.lit("2.1").alias("field_id"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("expected")),
                         F.struct(F.lit("2.2").alias("field_id"), F.col("n_name").alias("expected")))))
    templates = s.spark.createDataFrame(TEMPLATES, "style string, template string")
    noise = s.table("benchmark").select(F.col("item_id").alias("no"), "text")
    return D.make_corpus(corpus(s), truth, templates, noise)


@query("corpus_texts", f"""
{PLAN} SELECT job_id, doc_no, CASE style WHEN 'report' THEN 'Nom : ' || n_name || chr(10) || 'Prénom : R' || n_regionkey || chr(10)
  WHEN 'letter' THEN 'Je suis R' || n_regionkey || ' ' || n_name || ' ().' ELSE n_name END AS markdown FROM p JOIN nation ON job_id = n_nationkey WHERE style IS NOT NULL""")
def corpus_patient_texts(s: Source) -> DataFrame:
    return corpus_texts(s).where("kind = 'patient'").select("job_id", "doc_no", "markdown")


@query("corpus_noise", f"""
{PLAN} SELECT job_id, doc_no, md5(text) AS digest FROM (SELECT *, CAST('0x' || substr(md5('42:' || job_id || ':' || doc_no), 1, 15) AS BIGINT)
  % (SELECT count(*) FROM benchmark) AS drawn FROM p WHERE style IS NULL) x LEFT JOIN benchmark ON item_id = drawn""")
def corpus_noise(s: Source) -> DataFrame:
    """Seeded draws of noise texts."""
    return corpus_texts(s).where("kind = 'noise'").select("job_id", "doc_no", F.md5("markdown").alias("digest"))
