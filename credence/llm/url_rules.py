"""URL filtering with rules indexed by their rarest literal token (operator 10).

Two kinds of rule: a prefix rule (host, path) fits the host, all its
subdomains and every path that starts with its own (an empty host fits all); a pattern rule is a
regular expression over the whole URL.  Each rule is indexed under one
literal token that any URL it fits must contain, the one that the fewest
distinct URLs have.  The tokens of a URL fetch its candidate rules, and only
those are tested.  A rule without any literal token is a candidate for every
URL.  The longest fitting prefix rule decides; without one, a
fitting pattern rule blocks and any other URL is allowed.

Distinct URLs are judged once (combined map-side) and joined back, so a URL
that a third of the rows share costs one test; the join is an ordinary
skewed join.  The rule index is joined on the token; it is a table of the
rules given, and Spark broadcasts it only below its size limit.

Defined cases: a null url or one without ``://`` has empty host and path and
is judged by no prefix rule but one without host and path; such and empty urls are allowed unless a
pattern rule fits; very long urls are handled whole; of equally long prefix
rules the smaller text wins; repeated rows give repeated results; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.llm.common import ascii_lower, plain

#: verdict, host, path
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

#: regular expression over the URL, and alternatives of literal tokens: a URL
#: that fits has all tokens of one alternative at least
PATTERNS = [
    (r"[?&]sessionid=[0-9a-fA-F]+", [["sessionid"]]),
    (r"[?&]page=([1-9][0-9]{2,})(&|#|$)", [["page"]]),
    (r"^https?://([^/]*[.])?(ad|ads)[.][^/]+/", [["ad"], ["ads"]]),
    (r"^https?://m[.][^/]*[.]net/de/", [["m", "net", "de"]]),
]

#: runs of ASCII letters and digits are the tokens of a URL
TOKEN = r"[A-Za-z0-9]+"


def host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(ascii_lower(url), F.lit(f"({TOKEN})"), F.lit(1)))


def literal_tokens(host: str, path: str) -> list[str]:
    """The tokens that every URL under a prefix has: those of the host, and
    those of the path that end inside it (the last may go on in the URL)."""
    return [t.lower() for t in re.findall(TOKEN, host) + re.findall(rf"{TOKEN}(?=[^A-Za-z0-9])", path)]


def rule_table(spark, rules=None, patterns=None) -> DataFrame:
    """(rule_id, kind, verdict, host, path, pattern, alternatives): each
    alternative is a set of tokens of which a fitting URL has all; a rule
    whose tokens nothing tells has one empty alternative."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = []
    for v, h, p in RULES if rules is None else rules:
        rows.append((len(rows), "prefix", v, h.translate(fold), p, None, [literal_tokens(h, p)]))
    for rx, alternatives in PATTERNS if patterns is None else patterns:
        rows.append((len(rows), "pattern", "block", None, None, rx, alternatives if alternatives and all(alternatives) else [[]]))
    return spark.createDataFrame(rows, "rule_id int, kind string, verdict string, host string, path string, "
                                       "pattern string, alternatives array<array<string>>")


#: rules without any token are looked up under one of so many marks, dealt to the URLs by hash
MARKS = 32


def rule_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(token, rule): each alternative of a rule under its rarest token, one
    without tokens under all marks."""
    need = rules.select("*", F.posexplode("alternatives").alias("alt", "tokens"))
    every = need.filter(F.size("tokens") == 0).select("rule_id", F.explode(F.array(*[F.lit(f"#{i}") for i in range(MARKS)])).alias("token"))
    need = need.select("*", F.explode("tokens").alias("token"))
    seen = urls.select(F.explode(url_tokens(F.col("url"))).alias("token"))
    freq = seen.join(need.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("freq"))
    j = need.join(freq, "token", "left").withColumn("order", F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), F.col("token")))
    rare = j.groupBy("rule_id", "alt").agg(F.min("order")["token"].alias("token"))
    return rare.select("rule_id", "token").unionByName(every).join(rules.drop("alternatives"), "rule_id")


def judge(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, pattern."""
    p = plain(pages, "page_id", "url").select(F.col("page_id").cast("long").alias("page_id"),
                                              F.col("url").cast("string").alias("url"))
    rules = rule_table(pages.sparkSession) if rules is None else rules
    urls = p.filter("url is not null").select("url").distinct()
    index = rule_index(urls, rules)
    mark = F.array(F.concat(F.lit("#"), F.pmod(F.xxhash64("url"), F.lit(MARKS)).cast("string")))
    u = urls.select("url", F.explode(F.concat(url_tokens(F.col("url")), mark)).alias("token"))
    c = u.join(index, "token").select(F.col("url"), "kind", F.col("verdict").alias("v"), F.col("host").alias("rule_host"),
                                      F.col("path").alias("rule_path"), "pattern",
                                      host(F.col("url")).alias("h"), path(F.col("url")).alias("q"))
    inside = (F.col("rule_host") == "") | F.concat(F.lit("."), F.col("h")).endswith(F.concat(F.lit("."), "rule_host"))
    prefix = (F.col("kind") == "prefix") & inside \
        & F.startswith(F.col("q"), F.col("rule_path"))
    fits = c.filter(prefix | ((F.col("kind") == "pattern") & F.expr("url rlike pattern")))
    name = F.concat("rule_host", "rule_path")
    best = fits.groupBy("url").agg(
        F.min(F.when(F.col("kind") == "prefix", F.struct((-F.length(name)).alias("l"), name.alias("rule"), F.col("v")))).alias("best"),
        F.min(F.when(F.col("kind") == "pattern", F.col("pattern"))).alias("pattern"))
    j = p.join(best, "url", "left")
    other = F.when(F.col("pattern").isNotNull(), "block").otherwise("allow")
    return j.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"),
                    F.col("best.rule").alias("rule"), F.coalesce(F.col("best.v"), other).alias("verdict"),
                    F.when(F.col("best").isNull(), F.col("pattern")).alias("pattern"))
