r"""URL filters by pattern rules, with DataFrame functions only.

A rule is tested on a URL's host (A-Z lower-cased) with its path behind it:
the host runs from the first ``://`` to ``/``, ``?``, ``#`` or the end, the path
from there to ``?``, ``#`` or the end.  A pattern is a text to be found in that,
in which ``*`` stands for any run of characters and ``^`` for one character that
is no letter, digit or ``_.%-``, or for the end; ``|`` at either end ties it to
that end, and ``||`` in front to the start of the host or of a label of it.
``host_rules`` makes rules that fit a host, its subdomains and a path prefix.

Index: every rule is cut into the literal keys that each matching URL must
hold: tokens (runs of characters other than ASCII punctuation and controls)
that are whole, having no ``*`` or open end beside them; failing those, the
three-character pieces of its literal runs; failing those, the empty key that
every URL holds.  How many distinct URLs hold each of these keys is counted, and
a rule is filed under its rarest; one with a key that no URL holds cannot match
and is left out.  A URL's keys then fetch candidate rules, and only those run
their regular expression.  The index is a stored table, so Spark broadcasts it
only below the session's threshold and shuffles, with AQE's split of hot keys,
beyond.  Only distinct URLs are matched; a URL that many pages share is one row
until the verdicts are joined back.

Of the rules that match, the highest ``level`` wins, then the longest name, then
block before other actions, then the name that sorts last.

Defined cases: a null URL or one without ``://`` has an empty host and path; no
match gives a null rule and the ``default`` verdict; rules with a null pattern,
host, path or action take no part, and equal rules count once; null and repeated
ids are kept, one result per row; empty tables give empty results or defaults.
Extra columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotvalue.llm.common import stored

#: (host, path prefix, action) of the contract, and patterns that block by themselves
HOST_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
              ("com", "/fr/", "allow"), ("com", "/de/", "block")]
SPAM_PATTERNS = ["*cheap-pills*", "*free-bets*", "*spam-farm*", "*online-casino*", "*payday-loans*"]
DEFAULT = "allow"

_PUNCT = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_TOKEN = f"[^{_PUNCT}]+"
_WHOLE = rf"(?<![*]|[^{_PUNCT}]){_TOKEN}(?![*]|[^{_PUNCT}])"
_PIECE = r"(?s)(?=([^*^|]{3}))"
_RULE = ["rule", "regex", "action", "level"]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL column; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)\A.*?://", "")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*(/[^?#]*)?", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def literal_table(spark: SparkSession, rows: Iterable[tuple], schema: dict[str, str]) -> DataFrame:
    """A small table from values, as one expression."""
    items = [F.struct(*[F.lit(v).cast(t).alias(c) for (c, t), v in zip(schema.items(), row)]) for row in rows]
    kind = "array<struct<" + ",".join(f"{c}:{t}" for c, t in schema.items()) + ">>"
    return spark.range(1).select(F.inline((F.array(*items) if items else F.array()).cast(kind)))


def _keys(body: Column) -> Column:
    """The keys that every URL matched by a pattern body must hold."""
    def marked(mark: str, found: Column) -> Column:
        return F.transform(F.array_distinct(found), lambda x: F.concat(F.lit(mark), x))

    whole = marked("t", F.regexp_extract_all(body, F.lit(_WHOLE), 0))
    pieces = marked("p", F.regexp_extract_all(body, F.lit(_PIECE), 1))
    return F.when(F.size(whole) > 0, whole).when(F.size(pieces) > 0, pieces).otherwise(F.array(F.lit("")))


def host_rules(rules: DataFrame, level: int = 1) -> DataFrame:
    """Rules from (host, path, action): the host and its subdomains, and paths
    that start with ``path``; the name is host and path."""
    host = F.translate("host", string.ascii_uppercase, string.ascii_lowercase)
    name = F.concat(host, F.col("path"))
    plain = F.regexp_replace(name, r"([\\.\[\]{}()+?$|^*-])", r"\\$1")
    end = F.when(F.col("path") == "", F.lit("(?:/|\\z)")).otherwise(F.lit(""))
    regex = F.concat(F.lit(r"(?s)\A(?:[^/]*\.)?"), plain, end)
    # characters that mean something in patterns are literals here: they end a run, and leave its ends open
    body = F.concat(F.lit("|"), F.regexp_replace(name, r"[*^|]", "*"), F.when(F.col("path") == "", "|").otherwise("*"))
    return rules.select(name.alias("rule"), regex.alias("regex"), F.col("action"), F.lit(level).alias("level"),
                        _keys(body).alias("keys"))


def pattern_rules(rules: DataFrame, level: int = 0) -> DataFrame:
    """Rules from (pattern, action); the name is the pattern."""
    text = F.col("pattern")
    label, start, rest = text.startswith("||"), text.startswith("|"), F.regexp_replace(text, r"\A\|\|?", "")
    end, inner = rest.endswith("|"), F.regexp_replace(rest, r"\|\z", "")
    plain = F.regexp_replace(inner, r"([\\.\[\]{}()+?$|-])", r"\\$1")
    loose = F.regexp_replace(F.regexp_replace(plain, r"\*", ".*"), r"\^", r"(?:[^0-9A-Za-z_.%-]|\\z)")
    regex = F.concat(F.lit("(?s)"), F.when(label, F.lit(r"\A(?:[^/]*\.)?")).when(start, F.lit(r"\A")).otherwise(""),
                     loose, F.when(end, F.lit(r"\z")).otherwise(""))
    # a bar inside a pattern is a literal: it ends a run like other punctuation
    body = F.concat(F.when(start, "|").otherwise("*"), inner, F.when(end, "|").otherwise("*"))
    return rules.select(text.alias("rule"), regex.alias("regex"), F.col("action"), F.lit(level).alias("level"),
                        _keys(body).alias("keys"))


def _held(target: Column, pieces: bool, empty: bool) -> Column:
    """Keys that a URL holds, of the kinds that some rule has."""
    found = [F.transform(F.regexp_extract_all(target, F.lit(_TOKEN), 0), lambda x: F.concat(F.lit("t"), x))]
    if pieces:
        found.append(F.transform(F.regexp_extract_all(target, F.lit(_PIECE), 1), lambda x: F.concat(F.lit("p"), x)))
    if empty:
        found.append(F.array(F.lit("")))
    return F.array_distinct(F.concat(*found))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
          default: str = DEFAULT) -> DataFrame:
    """(id, url, host, path, rule, action, level, verdict), one row per row:
    the winning rule of every URL (null: none) and its action or the default."""
    host, path = split_url(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path")) \
        .withColumn("target", F.concat("host", "path"))
    given = rules.where("rule is not null and regex is not null and action is not null").distinct()
    given = stored(given.select(*_RULE, F.explode("keys").alias("key")), "url-rules")
    kind = given.agg(F.max(F.startswith("key", F.lit("p"))), F.max(F.col("key") == "")).first()
    urls = stored(rows.select("target").distinct(), "url-targets")
    held = urls.select("target", F.explode(_held(F.col("target"), bool(kind[0]), bool(kind[1]))).alias("key"))
    counts = held.join(given.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count("*").alias("urls"))
    rarest = given.join(counts, "key", "left").withColumn("urls", F.coalesce("urls", F.lit(0))).groupBy(*_RULE).agg(
        F.min(F.struct("urls", "key")).alias("least"))
    index = stored(rarest.where("least.urls > 0").select(*_RULE, "least.key"), "url-index")
    matched = held.join(index, "key").where("target rlike regex")
    order = F.struct("level", F.length("rule"), F.col("action") == "block", "rule", "action")
    best = matched.groupBy("target").agg(F.max(order).alias("best")).select(
        "target", "best.rule", "best.action", "best.level")
    return rows.join(best, "target", "left").select(
        "id", "url", "host", "path", "rule", "action", "level", F.coalesce("action", F.lit(default)).alias("verdict"))
