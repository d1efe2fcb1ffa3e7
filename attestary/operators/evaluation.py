"""Evaluation of extracted values against expected ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from attestary import fixed
from attestary.functions.text import strip
from attestary.functions.values import eval_norm


def eval_join(truth: DataFrame, results: DataFrame) -> DataFrame:
    return truth.join(results, ["job_id", "field_id"], "left")


def match_exact(expected: Column, extracted: Column) -> Column:
    def clean(c: Column) -> Column:
        return strip(F.rtrim(eval_norm(c), F.lit("%")))
    got = clean(extracted)
    for word, code in fixed.EVAL_GENDER.items():
        got = F.when(got == word, code).otherwise(got)
    return clean(expected) == got


def match_fuzzy(expected: Column, extracted: Column) -> Column:
    e, x = eval_norm(expected), eval_norm(extracted)
    return F.contains(x, e) | F.contains(e, x)


def match_date(expected: Column, extracted: Column) -> Column:
    def dots(c: Column) -> Column:
        return F.translate(eval_norm(c), "/-", "..")
    return dots(expected) == dots(extracted)


def keywords_in(keywords: Column, extracted: Column, present: bool) -> Column:
    text = eval_norm(extracted)
    return F.filter(F.coalesce(keywords, F.array().cast("array<string>")),
                    lambda k: F.contains(text, F.lower(k)) == F.lit(present))


def compare(pairs: DataFrame) -> DataFrame:
    """Adds ``match`` and ``reason`` to ``(expected, tolerance, keywords, value)`` rows."""
    expected, value, kind = F.col("expected"), F.col("value"), F.col("tolerance")
    missing = keywords_in(F.col("keywords"), value, False)
    absent = F.coalesce(value, F.lit("")) == ""
    known = kind.isin("exact", "fuzzy", "date", "contains")
    match = (F.when(absent, False)
             .when(kind == "exact", match_exact(expected, value))
             .when(kind == "fuzzy", match_fuzzy(expected, value))
             .when(kind == "date", match_date(expected, value))
             .when(kind == "contains", F.size(missing) == 0)
             .otherwise(False))

    def quoted(head: str, between: str) -> Column:
        return F.concat(F.lit(head + "'"), F.coalesce(expected, F.lit("None")),
                        F.lit("'" + between + "'"), value, F.lit("'"))
    reason = (F.when(absent, "Pas de valeur extraite")
              .when(~known, F.concat(F.lit("Tolérance inconnue: "), kind))
              .when(F.col("match"), None)
              .when(kind == "exact", quoted("Attendu ", ", obtenu "))
              .when(kind == "fuzzy", quoted("Fuzzy fail: ", " vs "))
              .when(kind == "date", quoted("Date: ", " vs "))
              .otherwise(F.concat(F.lit("Mots-clés manquants: ['"), F.array_join(missing, "', '"),
                                  F.lit("']"))))
    return (pairs.withColumn("tolerance", F.coalesce("tolerance", F.lit("exact")))
            .withColumn("keywords_found", keywords_in(F.col("keywords"), value, True))
            .withColumn("keywords_missing", missing)
            .withColumn("match", match).withColumn("reason", reason))


def accuracy(compared: DataFrame) -> DataFrame:
    """Score per category and overall (NULL category), with the state the report shows."""
    n, ok = F.count(F.lit(1)), F.count_if("match")
    share = F.col("correct") / F.col("fields")
    state = (F.when(share == 1, "OK").when(share > 0, "PARTIEL").otherwise("ÉCHEC"))
    return (compared.withColumn("category", F.coalesce("category", F.lit("")))
            .rollup("category").agg(n.alias("fields"), ok.alias("correct"))
            .withColumn("accuracy", F.bround(share * 100, 1)).withColumn("state", state))


def failures(compared: DataFrame) -> DataFrame:
    return compared.where("NOT match").select("job_id", "field_id", "category", "expected", "value",
                                              "reason", "keywords_missing")


def successes(compared: DataFrame) -> DataFrame:
    return compared.where("match").select("job_id", "field_id", "category",
                                          F.substring("value", 1, 40).alias("shown"))


def coverage(forms: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Each form id as covered, without scenario, or scenario without form."""
    f, s = forms.select("form_id"), scenarios.select("form_id")

    def tagged(df: DataFrame, state: str) -> DataFrame:
        return df.withColumn("state", F.lit(state))
    return (tagged(f.intersect(s), "covered").unionByName(tagged(f.subtract(s), "no_scenario"))
            .unionByName(tagged(s.subtract(f), "no_form")))
