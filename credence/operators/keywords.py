"""Top keywords and extractive summaries, per row.

Both are computed inside the row with JVM array functions: the document's
terms are sorted, equal neighbours are run-length counted, and the top-k of
(count desc, term asc) is kept.  This costs O(w log w) per document and needs
no explode, no shuffle and no window over the corpus, so a single huge
document stays one row of work and the corpus scales linearly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.functions import text as tx
from credence.params import DEFAULT, Params

TERM_CLEAN = r"[^\p{L}]"


def terms(ws: Column, params: Params = DEFAULT) -> Column:
    """Lower-cased letter-only tokens that are not stop words."""
    stop = list(params.stopword_list())
    cleaned = F.transform(ws, lambda w: F.regexp_replace(F.lower(w), TERM_CLEAN, ""))
    return F.filter(cleaned, lambda t: (t != "") & ~t.isin(stop))


def with_top_terms(df: DataFrame, words_col: str, out: str = "top", k: int = 10,
                   params: Params = DEFAULT) -> DataFrame:
    """Add ``out``: the ``k`` most frequent terms as struct(term, count),
    ties by term.

    Staged in three projections so that the sorted terms and the run starts
    are materialised once per row (an expression used inside a lambda would
    otherwise be re-evaluated for every element).
    """
    keep = [F.col(c) for c in df.columns]
    s1 = df.select(*keep, tx.materialize(F.sort_array(terms(F.col(words_col), params))).alias("_kw_s"))
    s, n = F.col("_kw_s"), F.size(F.col("_kw_s"))
    idx = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(idx, lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))))
    s2 = s1.select(*keep, s, tx.materialize(starts).alias("_kw_st"))
    st, m = F.col("_kw_st"), F.size(F.col("_kw_st"))
    n2 = F.size(F.col("_kw_s"))
    counts = F.transform(
        st,
        lambda x, j: F.struct(
            (x - F.when(j + 1 < m, F.element_at(st, F.least(j + 2, m))).otherwise(n2 + 1)).alias("neg"),
            F.element_at(F.col("_kw_s"), x).alias("term")))
    top = F.transform(F.slice(F.sort_array(counts), 1, k),
                      lambda x: F.struct(x["term"].alias("term"), (-x["neg"]).alias("count")))
    return s2.select(*keep, top.alias(out))


def sentences(text: Column) -> Column:
    """Sentences: split after a token that ends a sentence (rule T2)."""
    marked = F.regexp_replace(text, r"""([.!?]["')\]]*)""" + tx.WHITESPACE, "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.btrim(s, F.lit(tx.WS_CHARS))),
                    lambda s: s != "")


def with_summary(df: DataFrame, text_col: str, top_col: str, out: str = "summary", n_sentences: int = 5,
                 params: Params = DEFAULT) -> DataFrame:
    """Add ``out``, the ``n_sentences`` best sentences in text order, and
    ``<out>_sentences``, the number of sentences.

    A sentence scores the sum of the document frequencies of its top terms;
    ties go to the earlier one.  Frequencies and sentences are staged, so
    that each is built once per row, not once per token.
    """
    keep = [F.col(c) for c in df.columns]
    top = F.col(top_col)
    freq = F.map_from_arrays(F.transform(top, lambda x: x["term"]), F.transform(top, lambda x: x["count"]))
    s1 = df.select(*keep, tx.materialize(freq).alias("_freq"), tx.materialize(sentences(F.col(text_col))).alias("_sents"))
    scored = F.transform(
        F.col("_sents"),
        lambda s, i: F.struct(
            (-F.aggregate(terms(tx.words(s), params), F.lit(0),
                          lambda a, t: a + F.coalesce(F.element_at(F.col("_freq"), t), F.lit(0)))).alias("neg"),
            i.alias("pos"), s.alias("sentence")))
    best = F.slice(F.sort_array(scored), 1, n_sentences)
    ordered = F.sort_array(F.transform(best, lambda x: F.struct(x["pos"].alias("pos"), x["sentence"].alias("s"))))
    return s1.select(*keep, F.array_join(F.transform(ordered, lambda x: x["s"]), " ").alias(out),
                     F.size("_sents").alias(f"{out}_sentences"))
