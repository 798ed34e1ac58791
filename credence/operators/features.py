"""The 47 content features as one narrow projection.

``extract_features(content_df)`` adds every feature as a column.  The plan is
map-only: tokens are computed once per row in a staged ``select`` (Catalyst
keeps a non-cheap alias that is used several times instead of re-inlining it),
every feature is a JVM-side expression on that row, and nothing is shuffled,
collected or passed through Python.  Work is O(words) per row, so a corpus of
long and short documents partitions by bytes and scales linearly.

Input columns (absent or null ones take their defaults):
``text, title, domain`` (string), ``authors, images, keywords`` (array<string>),
``publish_date, meta_description, summary`` (string).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.functions import text as tx
from credence.params import COMMON_TLDS, CLICKBAIT_PATTERNS, DEFAULT, URL_PATTERN, Params

LINGUISTIC = [
    "text_length", "title_length", "word_count", "avg_word_length", "sentence_count",
    "avg_sentence_length", "exclamation_count", "question_count", "exclamation_ratio",
    "capital_ratio", "title_caps_ratio", "unique_word_ratio", "stopword_ratio",
]
SENTIMENT = [
    "text_polarity", "text_subjectivity", "title_polarity", "title_subjectivity",
    "emotional_word_count", "emotional_word_ratio",
]
READABILITY = ["flesch_reading_ease", "flesch_kincaid_grade", "avg_syllables_per_word"]
STRUCTURAL = [
    "url_count", "url_ratio", "quote_count", "proper_noun_count", "proper_noun_ratio",
    "paragraph_count", "avg_paragraph_length",
]
SOURCE = [
    "is_trusted_domain", "is_unreliable_domain", "has_common_tld", "has_author",
    "author_count", "has_publish_date", "image_count", "has_images",
]
CLICKBAIT = [
    "clickbait_keyword_count", "has_clickbait", "title_has_numbers",
    "clickbait_pattern_count", "title_trailing_punctuation",
]
METADATA = ["has_meta_description", "meta_description_length", "has_keywords", "keyword_count", "has_summary"]

GROUPS = {
    "linguistic": LINGUISTIC,
    "sentiment": SENTIMENT,
    "readability": READABILITY,
    "structural": STRUCTURAL,
    "source": SOURCE,
    "clickbait": CLICKBAIT,
    "metadata": METADATA,
}
ALL_FEATURES = [f for g in GROUPS.values() for f in g]  # 47

_STR_DEFAULTS = {"text": "", "title": "", "domain": "", "meta_description": "", "summary": ""}
_ARR_DEFAULTS = ("authors", "images", "keywords")
CONTENT_COLUMNS = ("text", "title", "domain", "authors", "publish_date", "images",
                   "meta_description", "keywords", "summary")


def normalise_content(df: DataFrame) -> DataFrame:
    """Apply the null rules: missing strings -> '', missing lists -> []."""
    cols = set(df.columns)
    out = []
    for c in df.columns:
        if c in _STR_DEFAULTS:
            out.append(F.coalesce(F.col(c), F.lit(_STR_DEFAULTS[c])).alias(c))
        elif c in _ARR_DEFAULTS:
            out.append(F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c))
        else:
            out.append(F.col(c))
    for c, v in _STR_DEFAULTS.items():
        if c not in cols:
            out.append(F.lit(v).alias(c))
    for c in _ARR_DEFAULTS:
        if c not in cols:
            out.append(F.array().cast("array<string>").alias(c))
    if "publish_date" not in cols:
        out.append(F.lit(None).cast("string").alias("publish_date"))
    return df.select(*out)


# ---------------------------------------------------------------------------
# lexicon sentiment (N1-N4), per row
# ---------------------------------------------------------------------------

def _lexicon_parts(params: Params):
    lex = params.lexicon
    sentiment_words = [w for w, p, s, _ in lex if p != 0.0 or s != 0.0]
    intensifiers = [w for w, _, _, i in lex if i != 1.0]
    pol = F.create_map(*[x for w, p, _, _ in lex if w in sentiment_words for x in (F.lit(w), F.lit(float(p)))])
    sub = F.create_map(*[x for w, _, s, _ in lex if w in sentiment_words for x in (F.lit(w), F.lit(float(s)))])
    inten = F.create_map(*[x for w, _, _, i in lex if w in intensifiers for x in (F.lit(w), F.lit(float(i)))])
    return sentiment_words, intensifiers, pol, sub, inten


def sentiment_letters(lower_spaced: Column) -> Column:
    """A lower-cased text of ``tx.spaced`` without every character but a-z,
    apostrophe and space."""
    return F.regexp_replace(lower_spaced, f"[^{tx.AZ}' ]+", "")


def sentiment_tokens(text: Column) -> Column:
    """Sentiment tokens: the whitespace-separated tokens of the lower-cased
    text after removing every character but a-z, apostrophe and whitespace
    (one regex per text; tokens made only of other characters vanish)."""
    return tx.split_spaced(sentiment_letters(F.lower(tx.spaced(text))))


def sentiment_scores(tk: Column, params: Params = DEFAULT) -> Column:
    """struct(p, s) of every lexicon hit, in token order.

    The previous token's intensity multiplies both values; a negation one or
    two tokens back multiplies the polarity by -0.5.  Membership tests are
    ``IN`` lists (hash ``InSet`` after optimisation), so the cost is O(tokens)
    and the map lookups run only for hits.
    """
    sentiment_words, intensifiers, pol, sub, inten = _lexicon_parts(params)
    negs = list(params.negations)

    def score(t, i):
        prev1 = F.element_at(tk, F.greatest(i, F.lit(1)))
        prev2 = F.element_at(tk, F.greatest(i - 1, F.lit(1)))
        mod = F.when((i > 0) & prev1.isin(intensifiers), F.element_at(inten, prev1)).otherwise(F.lit(1.0))
        neg = F.when(((i > 0) & prev1.isin(negs)) | ((i > 1) & prev2.isin(negs)), F.lit(-0.5)).otherwise(F.lit(1.0))
        return F.when(
            t.isin(sentiment_words),
            F.struct(
                (F.element_at(pol, t) * mod * neg).alias("p"),
                F.least(F.lit(1.0), F.element_at(sub, t) * mod).alias("s"),
            ),
        )

    lex_words = F.array(*[F.lit(x) for x in sentiment_words])
    hits = F.filter(F.transform(tk, score), lambda x: x.isNotNull())
    # hash-based gate: texts without any lexicon word skip the per-token lambda
    return F.when(F.arrays_overlap(tk, lex_words), hits).otherwise(F.array().cast(hits_type()))


def hits_type() -> str:
    return "array<struct<p:double,s:double>>"


def _avg_field(hits: Column, field: str, lo: float, hi: float) -> Column:
    total = F.aggregate(hits, F.lit(0.0), lambda acc, x: acc + x[field])
    n = F.size(hits)
    avg = F.when(n == 0, F.lit(0.0)).otherwise(total / n)
    return F.greatest(F.lit(lo), F.least(F.lit(hi), avg))


# ---------------------------------------------------------------------------
# the staged projection
# ---------------------------------------------------------------------------

def _domain_match(d: Column, names, mode: str) -> Column:
    if not names:
        return F.lit(0)
    arr = F.array(*[F.lit(n) for n in names])
    if mode == "suffix":
        cond = F.exists(arr, lambda t: (d == t) | d.endswith(F.concat(F.lit("."), t)))
    else:
        cond = F.exists(arr, lambda t: F.instr(d, t) > 0)
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def _flag(c: Column) -> Column:
    return F.when(c, F.lit(1)).otherwise(F.lit(0))


def _proper_nouns(caps: Column, starts: Column) -> Column:
    """U4: capitalised words of two characters and more that start no
    sentence.  Starts and words are sorted together, a start before its
    words, and one fold counts the words that differ from the last start."""
    both = F.sort_array(F.concat(
        F.transform(starts, lambda x: F.struct(x.alias("w"), F.lit(0).alias("t"))),
        F.transform(caps, lambda x: F.struct(x.alias("w"), F.lit(1).alias("t")))))
    return F.aggregate(
        both, F.struct(F.lit("").alias("start"), F.lit(0).alias("n")),
        lambda a, x: F.when(x["t"] == 0, F.struct(x["w"].alias("start"), a["n"].alias("n"))).otherwise(F.struct(
            a["start"].alias("start"), (a["n"] + F.when(x["w"] == a["start"], 0).otherwise(1)).alias("n"))),
        lambda a: a["n"])


def lexicon_sentiment(df: DataFrame, key: str, text_col: str, lexicon: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """N1/N2 over a lexicon table of any size: (key, polarity, subjectivity).

    ``lexicon`` has ``word, polarity, subjectivity, intensity``; a repeated
    word counts once (its largest row).  Tokens with the two before them are
    joined on the word, which Spark broadcasts only below its size limit; only
    hits go on to the second join and the sums.  Rows without a hit are 0.
    """
    lex = lexicon.where("word is not null").groupBy(F.lower("word").alias("word")).agg(
        F.max(F.struct("polarity", "subjectivity", "intensity")).alias("v")).select(
        "word", *[F.coalesce(F.col(f"v.{c}"), F.lit(d)).alias(c) for c, d in (("polarity", 0.0), ("subjectivity", 0.0), ("intensity", 1.0))])
    t = df.select(F.col(key), tx.materialize(sentiment_tokens(F.coalesce(F.col(text_col), F.lit("")))).alias("tk"))
    at = lambda i: F.when(F.col("i") >= i, F.get("tk", F.col("i") - i))
    t = t.select(key, "tk", F.posexplode("tk").alias("i", "word"))
    t = t.select(key, "word", at(1).alias("p1"), at(2).alias("p2"))
    j = t.join(lex.where("polarity <> 0 or subjectivity <> 0").select("word", "polarity", "subjectivity"), "word")
    j = j.join(lex.where("intensity <> 1").select(F.col("word").alias("p1"), "intensity"), "p1", "left")
    mod = F.coalesce("intensity", F.lit(1.0))
    negs = list(params.negations)
    neg = F.when(F.col("p1").isin(negs) | F.col("p2").isin(negs), -0.5).otherwise(1.0)
    clamp = lambda c, lo: F.greatest(F.lit(lo), F.least(F.lit(1.0), F.coalesce(F.avg(c), F.lit(0.0))))
    hits = j.groupBy(key).agg(clamp(F.col("polarity") * mod * neg, -1.0).alias("polarity"),
                              clamp(F.least(F.lit(1.0), F.col("subjectivity") * mod), 0.0).alias("subjectivity"))
    none = F.lit(0.0)
    return df.select(key).distinct().join(hits, key, "left").select(
        key, F.coalesce("polarity", none).alias("polarity"), F.coalesce("subjectivity", none).alias("subjectivity"))


def extract_features(df: DataFrame, params: Params = DEFAULT, groups=None, keep_content: bool = True) -> DataFrame:
    """Add the feature columns of ``groups`` (default: all 7 groups, 47 columns).

    All input columns are kept (content columns only when ``keep_content``).
    """
    groups = list(groups or GROUPS.keys())
    base = normalise_content(df)
    passthrough = [c for c in base.columns if keep_content or c not in CONTENT_COLUMNS]
    need_content = list(CONTENT_COLUMNS)

    # stage 1: texts with one space between tokens
    s1 = base.select(
        *[F.col(c) for c in dict.fromkeys(passthrough + need_content)],
        tx.spaced(F.col("text")).alias("_t"),
        tx.spaced(F.col("title")).alias("_tt"),
        F.replace(F.lower(F.col("domain")), F.lit("www."), F.lit("")).alias("_dom"),
    )
    # stages 2 and 3: per-row intermediates used by several features
    s2 = s1.select("*", tx.materialize(F.lower(F.col("_t"))).alias("_lt"), F.lower(F.col("title")).alias("_ltt"),
                   tx.materialize(F.length("text")).alias("_len"))
    s2_cols = [F.col(c) for c in s2.columns]
    s2_cols += [tx.materialize(tx.split_spaced(F.col("_lt"))).alias("_lw"),
                tx.materialize(sentiment_letters(F.col("_lt"))).alias("_letters"),
                tx.sentence_count(F.col("_t")).alias("_s")]
    if "structural" in groups:
        s2_cols.append(tx.materialize(tx.capitalised(F.col("_t"))).alias("_caps"))
        s2_cols.append(tx.materialize(tx.capitalised_starts(F.col("_t"))).alias("_starts"))
        s2_cols.append(F.size(F.filter(F.split(F.col("text"), "\n\n"),
                                       lambda p: p.rlike(tx.NOT_WS_CLASS))).alias("_paras"))
    s2 = s2.select(*s2_cols)
    s3_cols = [F.col(c) for c in s2.columns] + [F.size("_lw").alias("_n")]
    if "sentiment" in groups:
        s3_cols.append(tx.materialize(tx.split_spaced(F.col("_letters"))).alias("_tk"))
        s3_cols.append(tx.materialize(sentiment_tokens(F.col("title"))).alias("_ttk"))
    s2 = s2.select(*s3_cols)
    s3_cols = [F.col(c) for c in s2.columns]
    if "readability" in groups:
        s3_cols.append(tx.total_syllables(F.replace(F.col("_letters"), F.lit("'"), F.lit("")), F.col("_n")).alias("_syl"))
    if "sentiment" in groups:
        s3_cols.append(sentiment_scores(F.col("_tk"), params).alias("_sc"))
        s3_cols.append(sentiment_scores(F.col("_ttk"), params).alias("_tsc"))
    s2 = s2.select(*s3_cols)

    t, tt, n, s = F.col("_t"), F.col("_tt"), F.col("_n"), F.col("_s")
    text, title, dom = F.col("text"), F.col("title"), F.col("_dom")
    length = F.col("_len")
    feats: dict[str, Column] = {}

    if "linguistic" in groups:
        stop = list(params.stopword_list())
        excl = tx.char_count(text, "!")
        feats.update({
            "text_length": length,
            "title_length": F.length(title),
            "word_count": n,
            "avg_word_length": tx.ratio(F.length(t) - F.greatest(n - 1, F.lit(0)), n),
            "sentence_count": s,
            "avg_sentence_length": tx.ratio(n, s),
            "exclamation_count": excl,
            "question_count": tx.char_count(text, "?"),
            "exclamation_ratio": tx.ratio(excl, length),
            "capital_ratio": tx.ratio(F.regexp_count(text, F.lit("[A-Z]")), length),
            "title_caps_ratio": tx.ratio(tx.all_caps_count(tt), F.size(tx.split_spaced(tt))),
            "unique_word_ratio": tx.ratio(F.size(F.array_distinct(F.col("_lw"))), n),
            "stopword_ratio": tx.ratio(F.size(F.filter(F.col("_lw"), lambda x: x.isin(stop))), n),
        })
    if "sentiment" in groups:
        # _lt has other white space than the text
        one_word = not any(c in w for w in params.emotional_words for c in tx.WS_CHARS)
        emo = tx.keyword_hits(F.col("_lt") if one_word else F.lower(text), params.emotional_words)
        feats.update({
            "text_polarity": _avg_field(F.col("_sc"), "p", -1.0, 1.0),
            "text_subjectivity": _avg_field(F.col("_sc"), "s", 0.0, 1.0),
            "title_polarity": _avg_field(F.col("_tsc"), "p", -1.0, 1.0),
            "title_subjectivity": _avg_field(F.col("_tsc"), "s", 0.0, 1.0),
            "emotional_word_count": emo,
            "emotional_word_ratio": tx.ratio(emo, n),
        })
    if "readability" in groups:
        syl = F.col("_syl")
        ok = (n > 0) & (s > 0)
        wps = n.cast("double") / s
        spw = syl.cast("double") / n
        feats.update({
            "flesch_reading_ease": F.when(ok, F.lit(206.835) - F.lit(1.015) * wps - F.lit(84.6) * spw).otherwise(F.lit(0.0)),
            "flesch_kincaid_grade": F.when(ok, F.lit(0.39) * wps + F.lit(11.8) * spw - F.lit(15.59)).otherwise(F.lit(0.0)),
            "avg_syllables_per_word": F.when(ok, spw).otherwise(F.lit(0.0)),
        })
    if "structural" in groups:
        urls = F.when(text.contains("http"), F.size(F.regexp_extract_all(text, F.lit(URL_PATTERN), 0))).otherwise(0)
        quotes = tx.char_count(text, '"')
        proper = _proper_nouns(F.col("_caps"), F.col("_starts"))
        paras = F.col("_paras")
        feats.update({
            "url_count": urls,
            "url_ratio": tx.ratio(urls, n),
            "quote_count": F.floor(quotes * 3 / 2).cast("int"),
            "proper_noun_count": proper,
            "proper_noun_ratio": tx.ratio(proper, n),
            "paragraph_count": F.greatest(F.lit(1), paras),
            "avg_paragraph_length": tx.ratio(n, paras),
        })
    if "source" in groups:
        authors, images = F.col("authors"), F.col("images")
        tld_re = r"(" + "|".join(t.replace(".", r"\.") for t in COMMON_TLDS) + r")$"
        feats.update({
            "is_trusted_domain": _domain_match(dom, params.trusted_domains, params.domain_match),
            "is_unreliable_domain": _domain_match(dom, params.unreliable_domains, params.domain_match),
            "has_common_tld": _flag(dom.rlike(tld_re)),
            "has_author": _flag(F.size(authors) > 0),
            "author_count": F.size(authors),
            "has_publish_date": _flag(F.coalesce(F.col("publish_date"), F.lit("")) != ""),
            "image_count": F.size(images),
            "has_images": _flag(F.size(images) > 0),
        })
    if "clickbait" in groups:
        ltt = F.col("_ltt")
        kw = tx.keyword_hits(ltt, params.clickbait_keywords)
        pats = F.lit(0)
        for p in CLICKBAIT_PATTERNS:
            pats = pats + _flag(ltt.rlike(p))
        feats.update({
            "clickbait_keyword_count": kw,
            "has_clickbait": _flag(kw > 0),
            "title_has_numbers": _flag(title.rlike("[0-9]")),
            "clickbait_pattern_count": pats,
            "title_trailing_punctuation": _flag(title.rlike("[.!?]{2,}$|…$")),
        })
    if "metadata" in groups:
        md = F.col("meta_description")
        feats.update({
            "has_meta_description": _flag(F.length(md) > 0),
            "meta_description_length": F.length(md),
            "has_keywords": _flag(F.size(F.col("keywords")) > 0),
            "keyword_count": F.size(F.col("keywords")),
            "has_summary": _flag(F.col("summary") != ""),
        })

    ordered = [f for g in groups for f in GROUPS[g]]
    return s2.select(*[F.col(c) for c in passthrough], *[feats[f].alias(f) for f in ordered])


FEATURE_TYPES = {f: ("double" if f in {
    "avg_word_length", "avg_sentence_length", "exclamation_ratio", "capital_ratio", "title_caps_ratio",
    "unique_word_ratio", "stopword_ratio", "text_polarity", "text_subjectivity", "title_polarity",
    "title_subjectivity", "emotional_word_ratio", "flesch_reading_ease", "flesch_kincaid_grade",
    "avg_syllables_per_word", "url_ratio", "proper_noun_ratio", "avg_paragraph_length",
} else "int") for f in ALL_FEATURES}


def round_half_up(c: Column, places: int) -> Column:
    """floor(x * 10^k + 0.5) / 10^k: the same IEEE steps in every engine."""
    m = float(10 ** places)
    return F.floor(c * m + F.lit(0.5)) / m


def feature_summary(df: DataFrame) -> Column:
    """M6: the one-line human summary of a feature row.

    Values are rounded half-up on the scaled value before formatting, so the
    text does not depend on an engine's formatter rounding.
    """
    return F.concat_ws(
        " | ",
        F.format_string("Text length: %d words", F.col("word_count")),
        F.concat(F.lit("Sentiment: "), F.when(F.col("text_polarity") > 0, F.lit("Positive")).otherwise(F.lit("Negative"))),
        F.format_string("Subjectivity: %.2f", round_half_up(F.col("text_subjectivity"), 2)),
        F.format_string("Readability: %.1f", round_half_up(F.col("flesch_reading_ease"), 1)),
        F.format_string("Clickbait indicators: %d", F.col("clickbait_keyword_count")),
        F.concat(F.lit("Trusted domain: "), F.when(F.col("is_trusted_domain") == 1, F.lit("Yes")).otherwise(F.lit("No"))),
    )
