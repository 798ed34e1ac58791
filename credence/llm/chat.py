"""Conversations from reply trees (operator 7, DataFrame only).

A conversation is a tree of replies: each row names its parent, or the rows
form a chain by turn.  Iterative self-joins by pointer doubling (a node's
ancestor at distance 1, 2, 4, ...) give each node its depth and the summed
score of the path from its root in ``log2(depth)`` joins.  The leaves of a
conversation, each one root-to-leaf path, are ranked by that score; for the
chosen leaves the same ancestor tables list the path's nodes, again in
``log2(depth)`` joins.  Each chosen path becomes one text.

Template: ``### role`` line, the text, a line ``</turn>``.  A control string
inside a text gets one backslash in front, which :func:`unescape` removes; a
line break always stands between a text and the template's own control
strings, so a text's trailing backslashes stay its own.  Roles are
URL-encoded.  The loss mask is a list of code-point spans (start, end) that
cover the assistant texts.

Defined cases: null text and null role are empty; a null conv_id is one
conversation of its own; null turns come first; rows with equal turn are
ordered by role, then text, and rows repeated in full are turns of their own
(with a parent column, a node that repeats counts once, its smallest row);
rows whose parent is missing are roots; nodes on a cycle belong to no path;
equal scores rank the smaller leaf first; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from credence.llm.common import plain, stored

BEGIN, FINISH = "### ", "</turn>"
CONTROL = "(### |</turn>)"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, r"\\$1")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\" + CONTROL, "$1")


def reply_nodes(conv: DataFrame, parent: str | None = None, score: str | None = None) -> DataFrame:
    """(ck, conv_id, node, parent, role, text, score); ``parent`` and
    ``score`` name columns, without them rows chain by turn with score 0."""
    names = ["conv_id", "turn", "role", "text"]
    d = plain(conv, *names, *[x for x in (parent, score) if x])
    d = d.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                 F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                 F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                 (F.coalesce(F.col(f"`{score}`").cast("double"), F.lit(0.0)) if score else F.lit(0.0)).alias("score"),
                 *([F.col(f"`{parent}`").cast("long").alias("parent")] if parent else []))
    d = d.withColumn("ck", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
    if parent:
        w = W.partitionBy("ck", "turn").orderBy("role", "text", "parent", "score")
        return d.filter("turn is not null").withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(
            "ck", "conv_id", F.col("turn").alias("node"), "parent", "role", "text", "score")
    w = W.partitionBy("ck").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    d = d.withColumn("node", F.row_number().over(w).cast("long"))
    return d.select("ck", "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
                    "role", "text", "score")


def chosen_paths(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """(ck, leaf, path_rank, node, depth) for the ``keep`` best root-to-leaf
    paths of each conversation."""
    links = nodes.select("ck", "node", "parent", "score")
    there = nodes.select(F.col("ck").alias("k2"), F.col("node").alias("n2"))
    s = links.join(there, (F.col("ck") == F.col("k2")) & (F.col("parent") == F.col("n2")), "left").select(
        "ck", "node", F.col("n2").alias("up"), F.col("n2").isNotNull().cast("long").alias("depth"),
        F.col("score").alias("total"))
    s = stored(s)
    most = s.groupBy("ck").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    # nodes that have reached their root are done; only the others are joined on
    rooted, open_ = s.filter("up is null"), s.filter("up is not null")
    jumps, reach = [], 1
    while not open_.isEmpty():
        jumps.append(open_.select("ck", "node", "up"))
        if reach >= most:
            break  # what is left hangs on a cycle
        a = rooted.unionByName(open_).select(F.col("ck").alias("k2"), F.col("node").alias("n2"), F.col("up").alias("up2"),
                                             F.col("depth").alias("d2"), F.col("total").alias("t2"))
        s = stored(open_.join(a, (F.col("ck") == F.col("k2")) & (F.col("up") == F.col("n2"))).select(
            "ck", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"),
            (F.col("total") + F.col("t2")).alias("total")))
        rooted, open_ = rooted.unionByName(s.filter("up is null")), s.filter("up is not null")
        reach *= 2
    parents = links.filter("parent is not null").select(F.col("ck"), F.col("parent").alias("node")).distinct()
    leaves = rooted.join(parents, ["ck", "node"], "left_anti")
    w = W.partitionBy("ck").orderBy(F.col("total").desc(), "node")
    best = leaves.withColumn("path_rank", F.row_number().over(w)).filter(F.col("path_rank") <= keep)
    path = best.select("ck", F.col("node").alias("leaf"), "path_rank", "node")
    for j in jumps:
        up = path.join(j, ["ck", "node"]).select("ck", "leaf", "path_rank", F.col("up").alias("node"))
        path = stored(path.unionByName(up))
    return path.join(rooted.select("ck", "node", "depth"), ["ck", "node"])


def format_paths(conv: DataFrame, parent: str | None = None, score: str | None = None, keep: int = 1) -> DataFrame:
    """One row per chosen path: conv_id, path_rank, formatted, loss_spans."""
    nodes = stored(reply_nodes(conv, parent, score))
    t = chosen_paths(nodes, keep).join(nodes.select("ck", "conv_id", "node", "role", "text"), ["ck", "node"])
    t = t.withColumn("head", F.concat(F.lit(BEGIN), F.url_encode("role"), F.lit("\n"))).withColumn("body", escape(F.col("text")))
    t = t.withColumn("piece", F.concat("head", "body", F.lit(f"\n{FINISH}\n")))
    w = W.partitionBy("ck", "leaf").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(w), F.lit(0)) + F.length("head"))
    span = F.struct(F.col("start").cast("long").alias("start"), (F.col("start") + F.length("body")).cast("long").alias("end"))
    t = t.groupBy("ck", "conv_id", "leaf", "path_rank").agg(
        F.array_sort(F.collect_list(F.struct("depth", "piece"))).alias("p"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", span))).alias("loss_spans"))
    return t.select("conv_id", "path_rank", F.array_join(F.col("p.piece"), "").alias("formatted"), "loss_spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """The digest of each formatted text, from the text and its mask alone."""
    end = f"\n{FINISH}\n"
    chunks = F.split("formatted", end)  # the last one is empty
    d = formatted.select("conv_id", "formatted", "loss_spans", F.slice(chunks, 1, F.size(chunks) - 1).alias("turns"))
    role = lambda x: F.url_decode(F.substr(F.substring_index(x, "\n", 1), F.lit(len(BEGIN) + 1)))
    text = lambda x: unescape(F.substr(x, F.instr(x, "\n") + F.lit(1)))
    turns = F.transform("turns", lambda x: F.concat(role(x), F.lit("\n"), text(x), F.lit("\n")))
    d = d.withColumn("points", F.encode("formatted", "UTF-32"))
    under = F.transform("loss_spans", lambda s: unescape(F.decode(F.substring(
        F.col("points"), (s["start"] * 4 + 1).cast("int"), ((s["end"] - s["start"]) * 4).cast("int")), "UTF-32")))
    d = d.withColumn("loss", F.array_join(under, ""))
    return d.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                    F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
                    F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars"))
