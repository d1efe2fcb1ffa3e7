"""URL filters: pattern rules indexed by their rarest literal token."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestary.llm.common import unfolded, whole
from attestary.session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = "rule string, verdict string, pattern string, level int"
SITE, GENERAL = 1, 0  # a site rule goes before any general pattern
SALTS = 32  # a token that most URLs hold is this many groups of the join
EVERYWHERE = ""  # the token of patterns that have none of their own; every URL has it

# general patterns of unwanted hosts and paths, fixed values
UNWANTED = [
    "||ads-track.", "||adserver.", "||doubleclick.", "||adult-", "||porn", "||xxx.", "||casino-", "||free-bets.", "||poker-",
    "||cheap-pills.", "||viagra", "||spam-farm.", "||phishing", "||malware", "/wp-login.php", "/cgi-bin/*.exe^",
]


def rule_table(spark: SparkSession, sites: Sequence[tuple[str, str, str]] = (), blocked: Sequence[str] = ()) -> DataFrame:
    """``rule, verdict, pattern, level`` of site rules (host, path, verdict) and of blocked patterns.

    A site rule fits its host and all subdomains where the path starts with the rule's path. In a
    pattern ``*`` is any run of characters, ``^`` a character that is no letter, digit or one of ``_.%-``
    or the end, ``||`` at the beginning stands for the start of the host or of one of its labels, and
    ``|`` at either end for that end. Everything else is literal.
    """
    rows = [(host + path, verdict, f"||{host.translate(str.maketrans(UPPER, LOWER))}{path if path else '^'}", SITE)
            for host, path, verdict in sites]
    return spark.createDataFrame(rows + [(p, "block", p, GENERAL) for p in blocked], RULES)


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: up to ``/ ? #`` in lower case, then up to ``? #``; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    parts = "^([^/?#]*)([^?#]*)"
    return (F.coalesce(lowered(F.regexp_extract(rest, parts, 1)), F.lit("")),
            F.coalesce(F.regexp_extract(rest, parts, 2), F.lit("")))


def expression(pattern: Column) -> Column:
    """The regular expression of a pattern, for the host and path of a URL in one."""
    body = F.regexp_replace(pattern, r"^\|{1,2}|\|$", "")
    literal = F.regexp_replace(body, r"([!-)+-/:-@\[-`{-~])", r"\\$1")
    inner = F.replace(F.replace(literal, F.lit(r"\^"), F.lit("(?:[^A-Za-z0-9_.%-]|\\z)")), F.lit("*"), F.lit(".*"))
    start = (F.when(pattern.startswith("||"), r"^(?:[^/]*\.)?").when(pattern.startswith("|"), "^").otherwise(""))
    end = F.when(pattern.rlike(r"[^|]\|$"), "\\z").otherwise("")
    return F.concat(F.lit("(?s)"), start, inner, end)


def literal_tokens(pattern: Column) -> Column:
    """Runs of ASCII letters and digits that every URL the pattern fits holds between two other characters."""
    return F.array_distinct(F.regexp_extract_all(lowered(pattern), F.lit("(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])"), F.lit(0)))


def url_tokens(place: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(lowered(place), F.lit("[a-z0-9]+"), F.lit(0)))


def _salt(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int").alias("salt")


def _every_salt() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))


def rule_index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """The rules with the ``token`` each is found by: of its literal tokens the one the fewest of
    ``urls(place)`` hold, ties by the token; rules without any are under ``EVERYWHERE``.

    Only tokens that rules hold are counted, in ``SALTS`` groups each and summed map-side, so a host that
    most URLs share is no group of its own.
    """
    tokens = rules.select("pattern", F.explode(literal_tokens(F.col("pattern"))).alias("token")).distinct()
    sought = tokens.select("token").distinct().withColumn("salt", _every_salt())
    held = urls.select(_salt("place"), F.explode(url_tokens(F.col("place"))).alias("token")).join(sought, ["token", "salt"], "left_semi")
    counts = held.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    chosen = (tokens.join(counts, "token", "left").groupBy("pattern")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("least")))
    return rules.distinct().join(chosen, "pattern", "left").select(
        "rule", "verdict", "pattern", "level", expression(F.col("pattern")).alias("expression"),
        F.coalesce("least.token", F.lit(EVERYWHERE)).alias("token"))


def verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url, best(rule, verdict, pattern, level)`` of the distinct non-null urls of ``urls`` that a rule fits.

    A URL's tokens fetch the rules listed under them, and only these run their expression. Of the
    rules that fit, a site rule goes before a general one, then the longer rule, then a block, then
    the rule that comes last by code point. Both tables are left to Spark's own size checks; where they
    are shuffled, a token is ``SALTS`` groups, and every rule is in each of its token's.
    """
    host, path = host_and_path(F.col("url"))
    places = stage(urls.where("url is not null").select("url").distinct()
                   .select("url", F.concat(host, path).alias("place")).where("place <> ''"), "urls")
    index = stage(rule_index(rules, places), "rule-index")
    asked = places.select("url", "place", _salt("url"),
                          F.explode(F.concat(url_tokens(F.col("place")), F.array(F.lit(EVERYWHERE)))).alias("token"))
    salted = index.withColumn("salt", _every_salt())
    fitting = asked.join(salted, ["token", "salt"]).where("place rlike expression")
    best = F.max(F.struct("level", F.length("rule").alias("size"), (F.col("verdict") == "block").alias("blocks"), "rule", "pattern",
                          "verdict"))
    return fitting.groupBy("url").agg(best.alias("best"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``doc, host, path, rule, pattern, verdict`` of every row of ``pages``; ``doc`` is the whole row.

    ``rule`` is the site rule that decides, ``pattern`` the general pattern that does where no site rule
    fits; where neither fits, the verdict is ``default``. URLs are made distinct before any work, so
    repeated URLs cost one judgement. Nulls: a url that is null or has no ``://`` has an empty host and
    path, which no rule fits. Long urls are matched whole. Repeated rows are judged alike; other
    columns, also of the same names, are in ``doc``; empty pages give no rows, no rules the default.
    """
    host, path = host_and_path(F.col("doc.url"))
    judged = pages.select(whole(pages), F.col("url").alias("_url")).join(
        verdicts(pages, rules).withColumnRenamed("url", "_url"), "_url", "left")
    return judged.select("doc", host.alias("host"), path.alias("path"), F.when(F.col("best.level") == SITE, F.col("best.rule")).alias("rule"),
                         F.when(F.col("best.level") == GENERAL, F.col("best.pattern")).alias("pattern"),
                         F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def keep_allowed(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The rows of ``pages`` whose verdict is ``allow``, with all their columns."""
    return unfolded(judge(pages, rules, default).where("verdict = 'allow'"), pages)
