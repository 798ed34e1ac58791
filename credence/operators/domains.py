"""Domain lists as a table (C1/C2): longest matching suffix wins.

A list of any size is a table (name, kind).  Each distinct host is exploded
into its suffixes at label borders (``a.b.c`` -> ``a.b.c``, ``b.c``, ``c``), a
handful of rows, which meet the table in one equi-join; the longest name that
matches decides.  Hosts are made distinct map-side first, so a host that very
many pages share is tested once, and the result is joined back by host.  No
pattern is tested against every host, whatever the table's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def host_of(domain: Column) -> Column:
    """A domain (authority) without user and port, lower case, no final dot."""
    return F.regexp_replace(F.regexp_replace(F.lower(domain), "^.*@", ""), r"\.?(:[0-9]*)?$", "")


def suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def best_names(hosts: DataFrame, names: DataFrame) -> DataFrame:
    """(host, name, kind): the longest name that a host equals or ends with
    after a dot; of equal names the smallest kind."""
    table = names.select(host_of(F.col("name")).alias("name"), "kind").where("name <> ''").groupBy("name").agg(F.min("kind").alias("kind"))
    j = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("name")).join(table, "name")
    best = j.groupBy("host").agg(F.max(F.struct(F.length("name").alias("n"), "name", "kind")).alias("b"))
    return best.select("host", F.col("b.name").alias("name"), F.col("b.kind").alias("kind"))


def classify(df: DataFrame, names: DataFrame, domain_col: str = "domain") -> DataFrame:
    """``df`` with ``domain_name`` and ``domain_kind`` (null where no name
    of the table matches)."""
    host = host_of(F.coalesce(F.col(domain_col), F.lit("")))
    best = best_names(df.select(host.alias("host")).distinct(), names)
    j = df.withColumn("_host", host).join(best.select(
        F.col("host").alias("_host"), F.col("name").alias("domain_name"), F.col("kind").alias("domain_kind")), "_host", "left")
    return j.drop("_host")


def source_flags(df: DataFrame, names: DataFrame, domain_col: str = "domain") -> DataFrame:
    """C1/C2 in suffix mode over a table: ``is_trusted_domain`` and
    ``is_unreliable_domain`` (kinds ``trusted`` and ``unreliable``)."""
    c = classify(df, names, domain_col)
    flag = lambda kind: F.when(F.col("domain_kind") == kind, 1).otherwise(0)
    return c.withColumn("is_trusted_domain", flag("trusted")).withColumn("is_unreliable_domain", flag("unreliable"))
