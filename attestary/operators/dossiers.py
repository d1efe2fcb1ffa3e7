"""Test dossiers: scenarios rendered as numbered documents, and corpora with noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from attestary.functions.text import strip


def _lines(*parts: Column | str | None) -> Column:
    """Lines in order; a NULL line is left out, an empty one is kept."""
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.array_join(F.filter(F.array(*cols), lambda x: x.isNotNull()), "\n")


def _item(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"- {label} : "), value)


def _bullets(items: Column, line) -> Column:
    """One bullet per array entry, NULL for an empty array."""
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, line), "\n"))


def _given(c: Column) -> Column:
    return F.length(c) > 0


def _admin() -> Column:
    p, m = "patient.", "medecin."
    return _lines(
        "# Fiche administrative", "",
        F.concat(F.lit("Établie le "), F.col("date_rapport"),
                 F.lit(" — document interne du cabinet.")), "",
        "## Identité", "", _item("Nom", F.col(p + "nom")), _item("Prénom", F.col(p + "prenom")),
        _item("Sexe", F.col(p + "sexe")), _item("Date de naissance", F.col(p + "naissance")),
        _item("N° AVS", F.col(p + "avs")), _item("État civil", F.col(p + "etat_civil")), "",
        "## Coordonnées", "",
        _item("Adresse", F.concat(F.col(p + "rue"), F.lit(", "), F.col(p + "npa"), F.lit(" "),
                                  F.col(p + "ville"), F.lit(" (canton de "),
                                  F.col(p + "canton"), F.lit(")"))),
        _item("Téléphone", F.col(p + "tel")), _item("E-mail", F.col(p + "email")), "",
        "## Situation professionnelle", "", _item("Profession", F.col(p + "profession")),
        F.when(_given(F.col(p + "employeur")), _item("Employeur", F.col(p + "employeur"))),
        _item("Taux d'activité", F.col(p + "taux_activite")), "",
        "## Couverture", "", _item("Assureur concerné", F.col("assureur")),
        _item("N° de police / de contrat", F.col("police")), "",
        "## Médecin traitant", "",
        F.concat(F.lit("- "), F.col(m + "nom"), F.lit(", "), F.col(m + "specialite")),
        F.concat(F.lit("- "), F.col(m + "cabinet"), F.lit(", "), F.col(m + "rue"), F.lit(", "),
                 F.col(m + "npa"), F.lit(" "), F.col(m + "ville")),
        _item("Téléphone", F.col(m + "tel")), _item("E-mail", F.col(m + "email")),
        _item("N° RCC", F.col(m + "rcc")), _item("N° GLN", F.col(m + "gln")), "",
        "## Contexte de la démarche", "", F.col("contexte"), "")


def _who(separator: str) -> Column:
    return F.concat(F.lit("Patient : "), F.col("patient.nom"), F.lit(" "), F.col("patient.prenom"),
                    F.lit(separator), F.col("patient.naissance"))


def _history() -> Column:
    return _lines(
        "# Anamnèse et antécédents", "", _who(", né(e) le "), "",
        "## Anamnèse actuelle", "", F.col("anamnese"), "",
        "## Antécédents", "",
        _bullets(F.col("antecedents"), lambda a: F.concat(F.lit("- "), a)),
        "", "## Diagnostics retenus", "",
        _bullets(F.col("diagnostics"), lambda d: F.concat(
            F.lit("- "), d["libelle"], F.lit(" ("), d["code"], F.lit(") — depuis le "), d["date"])),
        "", "## Traitement en cours", "",
        _bullets(F.col("traitements"), lambda t: F.concat(F.lit("- "), t)), "")


def _visits() -> Column:
    def optional(title: str, c: Column) -> Column:
        return F.when(_given(c), F.concat(F.lit(f"## {title}\n\n"), strip(c), F.lit("\n")))
    return _lines(
        "# Notes de consultation", "", _who(", "), "Format SOAP, ordre antichronologique.", "",
        _bullets(F.col("consultations"), lambda c: F.concat(
            F.lit("## Consultation du "), c["date"], F.lit("\n\n"), strip(c["note"]), F.lit("\n"))),
        optional("Évolution", F.col("evolution")), optional("Pronostic", F.col("pronostic")))


def _accident() -> Column:
    a = "accident."

    def block(title: str, c: Column) -> Column:
        return F.when(_given(c), F.concat(F.lit(f"## {title}\n\n"), strip(c), F.lit("\n")))
    text = _lines(
        "# Déclaration d'accident", "", _who(", "), "",
        _item("Date de l'accident", F.col(a + "date")), _item("Heure", F.col(a + "heure")),
        _item("Lieu", F.col(a + "lieu")),
        _item("Employeur au moment des faits",
              F.coalesce(F.col(a + "employeur"), F.col("patient.employeur"))),
        F.concat(F.lit("- Assureur-accidents : "), F.col("assureur"), F.lit(", police "),
                 F.col("police")), "",
        "## Déroulement", "", strip(F.col(a + "description")), "",
        block("Témoin", F.col(a + "temoin")), block("Premiers soins", F.col(a + "premiers_soins")))
    return F.when(F.col("accident").isNotNull(), text)


def _incapacities() -> Column:
    def one(i: Column) -> Column:
        until = F.when(_given(i["fin"]), F.concat(F.lit("du "), i["debut"], F.lit(" au "), i["fin"])) \
            .otherwise(F.concat(F.lit("depuis le "), i["debut"], F.lit(", sans terme fixé")))
        return F.concat(F.lit("- Incapacité de travail de "), i["taux"], F.lit(" "), until, F.lit("."))
    text = _lines("# Attestations d'incapacité de travail", "", _who(", "),
                  F.concat(F.lit("Profession : "), F.col("patient.profession")), "",
                  _bullets(F.col("incapacites"), one), "")
    return F.when(F.size("incapacites") > 0, text)


def render_dossier(scenarios: DataFrame) -> DataFrame:
    """``(form, doc_no, filename, markdown)``: the documents of each scenario, numbers closed up.

    Scenarios without accident or incapacities have no such document; the scenario's own documents
    come fourth and following.
    """
    def doc(name: str, text: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), text.alias("text"))
    own = F.transform("documents", lambda d: F.struct(
        d["nom"].alias("name"),
        F.concat(F.lit("# "), d["titre"], F.lit("\n\n"), _who(", "), F.lit("\n\n"),
                 strip(d["corps"]), F.lit("\n")).alias("text")))
    docs = F.concat(
        F.array(doc("fiche-administrative", _admin()), doc("anamnese-antecedents", _history()),
                doc("consultations", _visits())),
        F.coalesce(own, F.array().cast("array<struct<name:string,text:string>>")),
        F.array(doc("accident", _accident()), doc("incapacites-travail", _incapacities())))
    kept = F.filter(docs, lambda d: d["text"].isNotNull())
    return (scenarios.select("form", F.posexplode(kept).alias("at", "d"))
            .select("form", (F.col("at") + 1).alias("doc_no"),
                    F.format_string("%02d_%s", F.col("at") + 1, F.col("d.name")).alias("filename"),
                    F.col("d.text").alias("markdown")))


NUMBERS = 4096  # document numbers a task makes from one row


def corpus_plan(requests: DataFrame, styles: list[str]) -> DataFrame:
    """``(job_id, doc_no, kind, style, filename)``: documents shared out over styles, then noise.

    ``requests(job_id, count, noise)``. Each style gets at least one document, the first ones one more
    each while a remainder lasts.
    """
    k = len(styles)
    each = F.greatest(F.lit(1), F.floor(F.col("count") / k))
    rest = F.greatest(F.lit(0), F.col("count") - each * k)
    patients = each * k + rest
    n = F.col("doc_no")
    style = F.lit(None).cast("string")
    for i, name in enumerate(styles, 1):
        style = F.coalesce(style, F.when(n <= each * i + F.least(rest, F.lit(i)), name))
    name = F.when(style.isNotNull(), F.concat(
        F.lit("patient_"), F.format_string("%03d", n), F.lit("_"), style)) \
        .otherwise(F.concat(F.lit("noise_"), F.format_string("%03d", n)))
    # numbers come in blocks, and the blocks go to all tasks: the documents of one job are no single row's work
    total, first = patients + F.col("noise"), F.col("_first")
    blocks = (requests.withColumn("_first", F.explode(F.sequence(F.lit(1).cast("bigint"), total, F.lit(NUMBERS).cast("bigint"))))
              .repartition(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")), "job_id", "_first"))
    return (blocks.withColumn("doc_no", F.explode(F.sequence(first, F.least(first + (NUMBERS - 1), total))))
            .select("job_id", "doc_no", style.alias("style"),
                    F.when(style.isNotNull(), "patient").otherwise("noise").alias("kind"),
                    name.alias("filename")))


def make_corpus(plan: DataFrame, truth: DataFrame, templates: DataFrame, noise: DataFrame,
                seed: int = 42) -> DataFrame:
    """Documents of a corpus plan.

    ``truth(job_id, field_id, expected)`` fills the ``{field_id}`` marks of ``templates(style, template)``;
    ``noise(no, text)``, numbered from 0, is drawn from with a seed.
    """
    values = truth.groupBy("job_id").agg(F.map_from_entries(F.collect_list(
        F.struct("field_id", F.coalesce("expected", F.lit(""))))).alias("_v"))
    mark = r"^\{([0-9.]+)\}$"
    filled = F.array_join(F.transform(F.split("template", r"(?=\{[0-9.]+\})|(?<=\})", -1), lambda x: F.when(
        x.rlike(mark), F.coalesce(F.try_element_at("_v", F.regexp_extract(x, mark, 1)), F.lit("")))
        .otherwise(x)), "")
    n = noise.agg(F.count(F.lit(1))).scalar()
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("job_id").cast("string"), F.col("doc_no").cast("string")))
    drawn = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % n
    other = noise.select(F.col("no").alias("_no"), F.col("text").alias("_noise"))
    return (plan.withColumn("_no", F.when(F.col("kind") == "noise", drawn))
            .join(templates, "style", "left").join(values, "job_id", "left")
            .join(other, "_no", "left")
            .select("job_id", "doc_no", "kind", "style", "filename",
                    F.coalesce(F.when(F.col("kind") == "patient", filled), "_noise").alias("markdown")))


def corpus_manifest(plan: DataFrame) -> DataFrame:
    return plan.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_docs"),
        F.count_if(F.col("kind") == "patient").alias("patient_docs"),
        F.count_if(F.col("kind") == "noise").alias("noise_docs"))
