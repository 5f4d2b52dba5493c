"""URL filter: pattern rules indexed by their rarest literal token.

A rule has literal tokens, each of which a matching URL must hold as a whole
token, and a regular expression over the normalized URL. The index keeps one
token per rule: the one that fewest distinct URLs of the corpus hold. A URL's
tokens fetch candidate rules, and only those run their expressions. The rule of
the longest text wins. DataFrame functions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm.common import broadcast_if_small, lower_ascii, prepare, table, written

MAX_BROADCAST = 100_000

# (verdict, host, path): a host rule also fits the host's subdomains
HOST_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
              ("block", "net", "/es/"), ("block", "net", "/fr/")]
# the method's own patterns: (name, literal tokens, expression); all block, and
# apply where no host rule fits
PATTERNS = [
    ("casino", ["casino"], r"\bcasino\b"), ("porn", ["porn"], r"\bporn\b"), ("xxx", ["xxx"], r"\bxxx\b"),
    ("viagra", ["viagra"], r"\bviagra\b"), ("login", ["login"], r"/login([/.?]|$)"),
    ("wp-admin", ["wp", "admin"], r"/wp-admin/"), ("cgi-bin", ["cgi", "bin"], r"/cgi-bin/"),
    ("sessionid", ["sessionid"], r"[?&;]sessionid="), ("adserver", ["adserver"], r"^adserver\.|\.adserver\."),
]
TOKEN = r"[^a-z0-9]+"


def url_parts(url: Column | str) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty for null or without ``://``."""
    url = F.col(url) if isinstance(url, str) else url
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)  # empty where there is no ://
    return lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, host_rules=None, patterns=None) -> DataFrame:
    """(rule, verdict, kind, tokens, regex, weight) of the given rules.

    Host expressions see ``host`` + path, with the path's case kept; pattern
    expressions see the lower-cased URL after ``://``."""
    rows = []
    for verdict, host, path in HOST_RULES if host_rules is None else host_rules:
        rows.append((host + path, verdict, "host", sorted(set(re.findall("[a-z0-9]+", host))),
                     rf"^([^/]*\.)?{re.escape(host)}{re.escape(path)}", 1_000_000 + len(host + path)))
    for name, tokens, regex in PATTERNS if patterns is None else patterns:
        rows.append((name, "block", "pattern", tokens, regex, len(name)))
    return spark.createDataFrame(rows, "rule string, verdict string, kind string, tokens array<string>, regex string, weight int")


def url_verdicts(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, pattern.

    ``rule`` is the longest fitting host rule or null; without one, ``pattern``
    names the method's fitting pattern (the longest, then the smallest name) and
    the verdict is block, else allow. Null URLs and URLs without ``://`` have
    empty parts and are allowed. Equal URLs are judged once; repeated rows come
    back as often as they came; other columns are ignored."""
    host, path = url_parts("url")
    urls = pages.select("url").filter("url IS NOT NULL").distinct().select("url", host.alias("host"), path.alias("path"))
    rest = F.regexp_extract("url", r"(?s)^.*?://(.*)$", 1)
    urls = written(urls.withColumn("low", lower_ascii(rest)), "urls")
    tokens = urls.select("url", "host", "path", "low", F.explode(F.array_distinct(
        F.concat(F.split("low", TOKEN, -1), F.split("host", TOKEN, -1)))).alias("token")).filter("token <> ''")
    # how many distinct URLs hold each literal: decides the token a rule is filed under
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    seen = tokens.join(broadcast_if_small(wanted, MAX_BROADCAST), "token").groupBy("token").agg(F.count("*").alias("n"))
    filed = (rules.withColumn("token", F.explode("tokens")).join(written(seen, "token-counts"), "token", "left")
             .groupBy("rule", "verdict", "kind", "regex", "weight")
             .agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token")))
    index = broadcast_if_small(written(filed, "rule-index"), MAX_BROADCAST)
    target = F.when(F.col("kind") == "host", F.concat("host", "path")).otherwise(F.col("low"))
    fits = tokens.join(index, "token").filter(F.rlike(target, F.col("regex")))
    best = written(fits.groupBy("url").agg(F.max(F.struct("weight", F.struct("kind", "rule", "verdict").alias("r"))).alias("b")), "url-rules")
    best = best.select(F.col("url").alias("_u"), F.col("b.r").alias("r"))
    out = pages.select("page_id", "url").join(best, F.col("url") == F.col("_u"), "left")
    is_host = F.col("r.kind") == "host"
    return out.select("page_id", host.alias("host"), path.alias("path"), F.when(is_host, F.col("r.rule")).alias("rule"),
                      F.coalesce("r.verdict", F.lit("allow")).alias("verdict"),
                      F.when(~is_host, F.col("r.rule")).alias("pattern"))


def op3_url_filter(spark, sf_dir):
    """Verdict on every page's URL."""
    prepare(spark)
    return url_verdicts(table(spark, sf_dir, "pages"), rule_table(spark))


def _sql() -> str:
    """Every rule tried on every URL, the plain way."""
    def q(s):
        return s.replace("'", "''")
    rules = ", ".join(f"('{h + p}', '{v}', '{h}', '{p}')" for v, h, p in HOST_RULES)
    pats = ", ".join(f"('{n}', '{q(r)}')" for n, _, r in PATTERNS)
    return rf"""
WITH r(rule, verdict, h, p) AS (VALUES {rules}), m(name, rx) AS (VALUES {pats}),
a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
      translate(rest, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM a),
f AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
      FROM b JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
g AS (SELECT page_id, max(struct_pack(n := length(name), name := name)).name AS name FROM b JOIN m ON regexp_matches(low, rx) GROUP BY page_id)
SELECT b.page_id, host, path, f.rule, coalesce(f.verdict, CASE WHEN g.name IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       CASE WHEN f.rule IS NULL THEN g.name END AS pattern
FROM b LEFT JOIN f USING (page_id) LEFT JOIN g USING (page_id)"""


OP3_SQL = _sql()
