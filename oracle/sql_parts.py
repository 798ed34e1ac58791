"""DuckDB SQL building blocks for the oracle side of the correctness check.

This is the *independent* formulation of the same semantics, written as plain
SQL over the parquet views (lists + lambdas per row where SQL has them,
unnest/join/group for the lexicon and the top-k parts).  Only the fixed value
lists and the two shared regex constants are taken from the library.
"""

from __future__ import annotations

from credence.functions.text import SENTENCE_END, WS_CHARS, WS_CLASS
from credence.params import (CLICKBAIT_PATTERNS, COMMON_TLDS, DEFAULT, ERROR_INVALID_URL, ERROR_NO_TEXT,
                             ERROR_TOO_LARGE, MODEL_ENSEMBLE, MODEL_OVERRIDE_FULL, MODEL_OVERRIDE_PARTIAL,
                             URL_PATTERN, Params)

# FIXED VALUES: the named character references that the test pages use or may
# use (&amp; last, so that '&amp;lt;' becomes '&lt;', not '<')
ENTITY_CHAIN = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "©"),
    ("&reg;", "®"), ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&lsquo;", "‘"),
    ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&amp;", "&"),
)


def q(s: str) -> str:
    """SQL string literal; characters below 0x20 go through chr()."""
    parts, buf = [], ""
    for ch in s:
        if ord(ch) < 32:
            if buf:
                parts.append("'" + buf.replace("'", "''") + "'")
                buf = ""
            parts.append(f"chr({ord(ch)})")
        else:
            buf += ch
    if buf or not parts:
        parts.append("'" + buf.replace("'", "''") + "'")
    return parts[0] if len(parts) == 1 else "(" + " || ".join(parts) + ")"


def in_list(items) -> str:
    return "(" + ", ".join(q(x) for x in items) + ")"


def dbl(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


WS = q(WS_CLASS)
WSC = q(WS_CHARS)
SE = q(SENTENCE_END)


def words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, {WS} || '+'), lambda x: x <> '')"


def terms(w: str, params: Params = DEFAULT) -> str:
    """Lower-cased letter-only tokens that are no stop words."""
    return ("list_filter(list_transform(" + w + ", lambda x: regexp_replace(lower(x), '[^\\p{L}]', '', 'g')), "
            f"lambda x: x <> '' AND x NOT IN {in_list(params.stopword_list())})")


def cap(x: str) -> str:
    c = f"substr({x}, 1, 1)"
    return f"({c} = upper({c}) AND {c} <> lower({c}))"


def ratio(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) END)"


def flag(cond: str) -> str:
    return f"(CASE WHEN {cond} THEN 1 ELSE 0 END)"


def hits(expr: str, kws) -> str:
    return "(" + " + ".join(flag(f"contains({expr}, {q(k)})") for k in kws) + ")"


# ---------------------------------------------------------------------------
# content sources
# ---------------------------------------------------------------------------

def doc_content(min_len: int = DEFAULT.min_text_length, table: str = "documents", key: str = "doc_id") -> str:
    return f"""SELECT {key}, coalesce(text, '') AS text, split_part(coalesce(text, ''), chr(10), 1) AS title,
       'direct-text' AS domain, CAST([] AS VARCHAR[]) AS authors, CAST(NULL AS VARCHAR) AS publish_date,
       CAST([] AS VARCHAR[]) AS images, '' AS meta_description, CAST([] AS VARCHAR[]) AS keywords, '' AS summary
FROM {table} WHERE length(coalesce(text, '')) >= {min_len}"""



NUMERIC_REF = q(r"&#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});")


def decode_numeric(expr: str) -> str:
    cp = ("chr(CASE WHEN lower(substr(r, 1, 1)) = 'x' THEN CAST(('0x' || substr(r, 2)) AS INTEGER) "
          "ELSE CAST(r AS INTEGER) END)")
    return (f"(CASE WHEN contains({expr}, '&#') THEN array_to_string(list_transform(list_zip("
            f"regexp_split_to_array({expr}, {NUMERIC_REF}), list_concat(list_transform("
            f"regexp_extract_all({expr}, {NUMERIC_REF}, 1), lambda r: {cp}), [''])), lambda z: z[1] || z[2]), '') "
            f"ELSE {expr} END)")


def decode(expr: str) -> str:
    """Named references (all but &amp;), numeric references, then &amp;."""
    out = expr
    for a, b in ENTITY_CHAIN[:-1]:
        out = f"replace({out}, {q(a)}, {q(b)})"
    out = decode_numeric(out)
    a, b = ENTITY_CHAIN[-1]
    return f"replace({out}, {q(a)}, {q(b)})"


def strip(expr: str) -> str:
    return f"trim({expr}, {WSC})"


def clean_html(h: str) -> str:
    out = h
    for tag in ("script", "style"):
        out = f"regexp_replace({out}, {q(f'(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>')}, '', 'g')"
    out = f"regexp_replace({out}, '(?s)<!--.*?-->', '', 'g')"
    for tag in ("nav", "footer", "header"):
        out = f"regexp_replace({out}, {q(f'(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>')}, '', 'g')"
    return out


def nodes(fragment: str) -> str:
    marked = decode(f"regexp_replace({fragment}, '<[^>]*>', chr(1), 'g')")
    return f"list_transform(string_split({marked}, chr(1)), lambda nd: {strip('nd')})"


def meta_tag(h: str, attr: str, value: str) -> str:
    pat = f"""(?is)(<meta\\b[^>]*\\b{attr}\\s*=\\s*["']{value}["'][^>]*>)"""
    return f"regexp_extract({h}, {q(pat)}, 1)"


def meta_content(tag: str) -> str:
    return decode(f"""regexp_extract({tag}, {q('''(?is)\\bcontent\\s*=\\s*["']([^"']*)["']''')}, 1)""")


ARTICLE = q(r"(?is)<article\b[^>]*>(.*?)(?:</article\s*>|\z)")
PARA = q(r"(?is)<p\b[^>]*>(.*?)</p\s*>")
# text units of the article: cut at the tags of block elements, the main heading left out
BLOCK = q(r"(?i)</?(?:address|article|aside|blockquote|body|dd|details|dialog|div|dl|dt|fieldset|figcaption|figure|"
          r"form|h1|h2|h3|h4|h5|h6|hr|html|li|main|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)(?:[\s/][^>]*)?>")
H1 = q(r"(?is)<h1\b[^>]*>.*?</h1\s*>")
IMG = q(r"""(?is)<img\b[^>]*?\bsrc\s*=\s*["']([^"']*)["']""")


def page_parts(h: str = "h") -> dict:
    """SQL expressions of the page extractor over a cleaned html column."""
    raw_title = f"regexp_extract({h}, {q('(?is)<title\\b[^>]*>(.*?)</title\\s*>')}, 1)"
    h1 = f"regexp_extract({h}, {q('(?is)<h1\\b[^>]*>(.*?)</h1\\s*>')}, 1)"
    h1_text = strip(decode(f"regexp_replace({h1}, '<[^>]*>', '', 'g')"))
    title = (f"CASE WHEN regexp_matches({h}, '(?i)<title\\b') THEN "
             f"(CASE WHEN regexp_matches({raw_title}, '<[A-Za-z/!]') THEN '' ELSE {strip(decode(raw_title))} END) "
             f"ELSE {h1_text} END")
    art = f"regexp_extract({h}, {ARTICLE}, 1)"
    has_art = f"regexp_matches({h}, '(?i)<article\\b')"
    fb_art = f"array_to_string(list_filter({nodes(art)}, lambda x: x <> ''), ' ')"
    fb_par = (f"array_to_string(list_transform(regexp_extract_all({h}, {PARA}, 1), "
              f"lambda pp: array_to_string({nodes('pp')}, '')), ' ')")
    fallback = strip(f"(CASE WHEN {has_art} THEN {fb_art} ELSE {fb_par} END)")
    def units(pieces: str) -> str:
        return (f"array_to_string(list_filter(list_transform({pieces}, "
                f"lambda pp: array_to_string(list_filter({nodes('pp')}, lambda x: x <> ''), ' ')), "
                f"lambda x: x <> ''), chr(10) || chr(10))")

    blocks = units(f"regexp_split_to_array(regexp_replace({art}, {H1}, '<p>', 'g'), {BLOCK})")
    paras = units(f"regexp_extract_all({h}, {PARA}, 1)")
    primary = f"(CASE WHEN {has_art} THEN {blocks} ELSE {paras} END)"
    author_tag = meta_tag(h, "name", "author")
    d1, d2, d3 = (meta_tag(h, "property", "article:published_time"), meta_tag(h, "name", "publish_date"),
                  meta_tag(h, "name", "date"))
    date = (f"CASE WHEN {d1} <> '' THEN {meta_content(d1)} WHEN {d2} <> '' THEN {meta_content(d2)} "
            f"WHEN {d3} <> '' THEN {meta_content(d3)} ELSE NULL END")
    return {
        "title": title, "primary": primary, "fallback": fallback,
        "authors": f"CASE WHEN {author_tag} <> '' THEN [{meta_content(author_tag)}] ELSE CAST([] AS VARCHAR[]) END",
        "publish_date": date,
        "meta_description": meta_content(meta_tag(h, "name", "description")),
        "images": f"list_transform(regexp_extract_all({h}, {IMG}, 1), lambda x: {decode('x')})",
        "images_raw": f"list_transform(regexp_extract_all({h}, {IMG}, 1), lambda x: {decode('x')})[1:10]",
    }


VALID_URL_SQL = "coalesce(regexp_matches(url, '^(?i)https?://[^/?#]+'), false)"
DOMAIN_SQL = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"


def page_content(params: Params = DEFAULT) -> str:
    """pages -> content record per page (S1/S5/S8/S10) in SQL."""
    pp = page_parts("h")
    err0 = (f"CASE WHEN NOT {VALID_URL_SQL} THEN {q(ERROR_INVALID_URL)} "
            f"WHEN strlen(coalesce(html, '')) > {params.max_content_size} THEN {q(ERROR_TOO_LARGE)} END")
    return f"""SELECT page_id, url, domain,
       CASE WHEN err0 IS NULL THEN title ELSE '' END AS title,
       CASE WHEN err0 IS NULL THEN (CASE WHEN length(prim) > 0 THEN prim ELSE fb END) ELSE '' END AS text,
       authors, publish_date, meta_description,
       CASE WHEN length(prim) > 0 THEN images ELSE images[1:10] END AS images,
       CASE WHEN err0 IS NOT NULL THEN NULL WHEN length(prim) > 0 THEN 'paragraphs' ELSE 'fallback' END
         AS extraction_method,
       coalesce(err0, CASE WHEN coalesce(CASE WHEN length(prim) > 0 THEN prim ELSE fb END, '') = ''
                           THEN {q(ERROR_NO_TEXT)} END) AS error,
       CASE WHEN err0 IS NULL AND length(prim) > 0 THEN list_distinct({terms(words("prim"), params)})[1:10]
            ELSE CAST([] AS VARCHAR[]) END AS keywords,
       -- the features only ask whether there is a summary: text has at least one sentence
       CASE WHEN err0 IS NULL AND length(prim) > 0 THEN 'yes' ELSE '' END AS summary
FROM (
  SELECT page_id, url, err0, {DOMAIN_SQL} AS domain,
         {pp['title']} AS title, {pp['primary']} AS prim, {pp['fallback']} AS fb,
         {pp['authors']} AS authors, {pp['publish_date']} AS publish_date,
         {pp['meta_description']} AS meta_description, {pp['images']} AS images
  FROM (SELECT page_id, url, html, err0, CASE WHEN err0 IS NULL THEN {clean_html("coalesce(html, '')")} END AS h
        FROM (SELECT page_id, url, html, {err0} AS err0 FROM pages))
)"""


# ---------------------------------------------------------------------------
# features
# ---------------------------------------------------------------------------

def lexicon_ctes(params: Params = DEFAULT, prefix: str = "feats") -> list[str]:
    sent = [(w, p, s) for w, p, s, _ in params.lexicon if p != 0.0 or s != 0.0]
    inten = [(w, i) for w, _, _, i in params.lexicon if i != 1.0]
    rows_s = ", ".join(f"({q(w)}, {dbl(p)}, {dbl(s)})" for w, p, s in sent)
    rows_i = ", ".join(f"({q(w)}, {dbl(i)})" for w, i in inten)
    return [f"{prefix}_lex_s(word, pol, subj) AS (VALUES {rows_s})",
            f"{prefix}_lex_i(word, inten) AS (VALUES {rows_i})"]


def stoks(expr: str) -> str:
    """Sentiment tokens: words of the lower-cased text with all but a-z,
    apostrophe and whitespace removed."""
    cls = q("[^a-z'" + WS_CLASS[1:-1] + "]")
    return f"list_filter(regexp_split_to_array(regexp_replace(lower({expr}), {cls}, '', 'g'), {WS} || '+'), lambda x: x <> '')"


def feature_ctes(src: str, key: str, params: Params = DEFAULT, out: str = "feats", extra=()) -> list[str]:
    """CTEs computing the 47 features of ``src`` (content columns) into ``out``."""
    stop = in_list(params.stopword_list())
    neg = in_list(params.negations)
    syl = ("list_sum(list_transform(list_transform(w, lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g')), "
           "lambda c: CASE WHEN length(c) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(c, '[aeiouy]+')) "
           "- CASE WHEN suffix(c, 'e') THEN 1 ELSE 0 END) END))")
    starts = (f"list_filter(list_filter(w, lambda x, i: i = 1 OR regexp_matches(w[i - 1], {SE})), "
              f"lambda x: {cap('x')} AND length(x) > 1)")
    ctes = lexicon_ctes(params, out)
    extra_sel = "".join(f", {c}" for c in extra)
    ctes.append(f"""{out}_0 AS (
  SELECT *, {words('text')} AS w, {words('title')} AS tw, replace(lower(domain), 'www.', '') AS dom,
         lower(text) AS lt, lower(title) AS ltt
  FROM (SELECT {key}, coalesce(text, '') AS text, coalesce(title, '') AS title, coalesce(domain, '') AS domain,
               coalesce(authors, CAST([] AS VARCHAR[])) AS authors, publish_date,
               coalesce(images, CAST([] AS VARCHAR[])) AS images, coalesce(meta_description, '') AS meta_description,
               coalesce(keywords, CAST([] AS VARCHAR[])) AS keywords, coalesce(summary, '') AS summary{extra_sel}
        FROM {src}))""")
    ctes.append(f"""{out}_1 AS (
  SELECT *, len(w) AS n,
         CASE WHEN len(w) = 0 THEN 0 ELSE 1 + len(list_filter(w, lambda x, i: i < len(w) AND regexp_matches(x, {SE}))) END AS s,
         coalesce({syl}, 0) AS syl,
         {starts} AS starts,
         len(list_filter(string_split(text, chr(10) || chr(10)), lambda pp: {strip('pp')} <> '')) AS paras,
         {stoks('text')} AS tk,
         {stoks('title')} AS ttk
  FROM {out}_0)""")
    # lexicon sentiment, relationally: one row per token, joined with the lexicon
    ctes.append(f"""{out}_tok AS (
  SELECT {key}, 'text' AS which, tk AS arr, unnest(generate_series(1, len(tk))) AS i FROM {out}_1
  UNION ALL
  SELECT {key}, 'title' AS which, ttk AS arr, unnest(generate_series(1, len(ttk))) AS i FROM {out}_1)""")
    ctes.append(f"""{out}_sent AS (
  SELECT {key}, which, avg(p) AS pol, avg(sj) AS subj FROM (
    SELECT t.{key}, t.which,
           ls.pol * coalesce(li.inten, CAST(1.0 AS DOUBLE))
             * (CASE WHEN (t.i > 1 AND t.arr[t.i - 1] IN {neg}) OR (t.i > 2 AND t.arr[t.i - 2] IN {neg})
                     THEN CAST(-0.5 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END) AS p,
           least(CAST(1.0 AS DOUBLE), ls.subj * coalesce(li.inten, CAST(1.0 AS DOUBLE))) AS sj
    FROM {out}_tok t JOIN {out}_lex_s ls ON ls.word = t.arr[t.i]
    LEFT JOIN {out}_lex_i li ON t.i > 1 AND li.word = t.arr[t.i - 1])
  GROUP BY {key}, which)""")
    emo = hits("lt", params.emotional_words)
    kw = hits("ltt", params.clickbait_keywords)
    pats = "(" + " + ".join(flag(f"regexp_matches(ltt, {q(p)})") for p in CLICKBAIT_PATTERNS) + ")"
    tld = q("(" + "|".join(t.replace(".", "\\.") for t in COMMON_TLDS) + ")$")

    def dom_match(names):
        if not names:
            return "0"
        if params.domain_match == "suffix":
            return flag(" OR ".join(f"(dom = {q(n)} OR suffix(dom, {q('.' + n)}))" for n in names))
        return flag(" OR ".join(f"contains(dom, {q(n)})" for n in names))

    urls = f"len(regexp_extract_all(text, {q(URL_PATTERN)}))"
    quotes = "(length(text) - length(replace(text, '\"', '')))"
    proper = f"len(list_filter(w, lambda x: {cap('x')} AND length(x) > 1 AND NOT list_contains(starts, x)))"
    excl = "(length(text) - length(replace(text, '!', '')))"
    ok = "(n > 0 AND s > 0)"
    wps = "(CAST(n AS DOUBLE) / CAST(s AS DOUBLE))"
    spw = "(CAST(syl AS DOUBLE) / CAST(n AS DOUBLE))"

    def clampavg(col, lo, hi):
        return f"greatest({dbl(lo)}, least({dbl(hi)}, coalesce({col}, CAST(0.0 AS DOUBLE))))"

    feats = {
        "text_length": "length(text)",
        "title_length": "length(title)",
        "word_count": "n",
        "avg_word_length": ratio("coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)", "n"),
        "sentence_count": "s",
        "avg_sentence_length": ratio("n", "s"),
        "exclamation_count": excl,
        "question_count": "(length(text) - length(replace(text, '?', '')))",
        "exclamation_ratio": ratio(excl, "length(text)"),
        "capital_ratio": ratio("(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))", "length(text)"),
        "title_caps_ratio": ratio("len(list_filter(tw, lambda x: x = upper(x) AND x <> lower(x) AND length(x) > 1))",
                                  "len(tw)"),
        "unique_word_ratio": ratio("len(list_distinct(list_transform(w, lambda x: lower(x))))", "n"),
        "stopword_ratio": ratio(f"len(list_filter(w, lambda x: lower(x) IN {stop}))", "n"),
        "text_polarity": clampavg("st.pol", -1.0, 1.0),
        "text_subjectivity": clampavg("st.subj", 0.0, 1.0),
        "title_polarity": clampavg("stt.pol", -1.0, 1.0),
        "title_subjectivity": clampavg("stt.subj", 0.0, 1.0),
        "emotional_word_count": emo,
        "emotional_word_ratio": ratio(emo, "n"),
        "flesch_reading_ease": f"(CASE WHEN {ok} THEN {dbl(206.835)} - {dbl(1.015)} * {wps} - {dbl(84.6)} * {spw} ELSE CAST(0 AS DOUBLE) END)",
        "flesch_kincaid_grade": f"(CASE WHEN {ok} THEN {dbl(0.39)} * {wps} + {dbl(11.8)} * {spw} - {dbl(15.59)} ELSE CAST(0 AS DOUBLE) END)",
        "avg_syllables_per_word": f"(CASE WHEN {ok} THEN {spw} ELSE CAST(0 AS DOUBLE) END)",
        "url_count": urls,
        "url_ratio": ratio(urls, "n"),
        "quote_count": f"CAST(floor(3 * {quotes} / 2) AS INTEGER)",
        "proper_noun_count": proper,
        "proper_noun_ratio": ratio(proper, "n"),
        "paragraph_count": "greatest(1, paras)",
        "avg_paragraph_length": ratio("n", "paras"),
        "is_trusted_domain": dom_match(params.trusted_domains),
        "is_unreliable_domain": dom_match(params.unreliable_domains),
        "has_common_tld": flag(f"regexp_matches(dom, {tld})"),
        "has_author": flag("len(authors) > 0"),
        "author_count": "len(authors)",
        "has_publish_date": flag("coalesce(publish_date, '') <> ''"),
        "image_count": "len(images)",
        "has_images": flag("len(images) > 0"),
        "clickbait_keyword_count": kw,
        "has_clickbait": flag(f"{kw} > 0"),
        "title_has_numbers": flag("regexp_matches(title, '[0-9]')"),
        "clickbait_pattern_count": pats,
        "title_trailing_punctuation": flag(f"regexp_matches(title, {q('[.!?]{2,}$|' + chr(0x2026) + '$')})"),
        "has_meta_description": flag("length(meta_description) > 0"),
        "meta_description_length": "length(meta_description)",
        "has_keywords": flag("len(keywords) > 0"),
        "keyword_count": "len(keywords)",
        "has_summary": flag("summary <> ''"),
    }
    from credence.operators.features import ALL_FEATURES, FEATURE_TYPES
    sel = ", ".join(
        f"CAST({feats[f]} AS {'DOUBLE' if FEATURE_TYPES[f] == 'double' else 'INTEGER'}) AS {f}" for f in ALL_FEATURES)
    ctes.append(f"""{out} AS (
  SELECT f.{key}, f.text, f.title, f.domain, f.authors, f.publish_date, f.images, f.meta_description,
         f.keywords, f.summary{"".join(f", f.{c}" for c in extra)}, {sel}
  FROM {out}_1 f
  LEFT JOIN {out}_sent st ON st.{key} = f.{key} AND st.which = 'text'
  LEFT JOIN {out}_sent stt ON stt.{key} = f.{key} AND stt.which = 'title')""")
    return ctes


# ---------------------------------------------------------------------------
# scoring and explanation
# ---------------------------------------------------------------------------

def rule_points_sql() -> str:
    return """(50
 + CASE WHEN is_unreliable_domain = 1 THEN 40 ELSE 0 END
 - CASE WHEN is_trusted_domain = 1 THEN 55 ELSE 0 END
 - CASE WHEN has_author = 1 THEN 15 ELSE 0 END
 - CASE WHEN has_publish_date = 1 THEN 10 ELSE 0 END
 - CASE WHEN quote_count >= 3 THEN 10 WHEN quote_count >= 1 THEN 5 ELSE 0 END
 - CASE WHEN has_common_tld = 1 THEN 3 ELSE 0 END
 + CASE WHEN clickbait_keyword_count > 2 OR clickbait_pattern_count > 1 THEN 25
        WHEN clickbait_keyword_count > 0 OR clickbait_pattern_count > 0 THEN 10 ELSE 0 END
 + CASE WHEN emotional_word_ratio > 0.1 THEN 20 WHEN emotional_word_ratio > 0.06 THEN 10 ELSE 0 END
 + CASE WHEN title_caps_ratio > 0.5 THEN 15 ELSE 0 END
 + CASE WHEN text_subjectivity >= 0.3 AND text_subjectivity <= 0.6 THEN -5 WHEN text_subjectivity > 0.8 THEN 8 ELSE 0 END
 + CASE WHEN capital_ratio > 0.2 THEN 15 WHEN capital_ratio > 0.15 THEN 8 ELSE 0 END
 + CASE WHEN has_author <> 1 AND has_publish_date <> 1 THEN 12 ELSE 0 END
 + CASE WHEN word_count < 100 THEN 10 ELSE 0 END
 + CASE WHEN coalesce(flesch_reading_ease, 50) >= 40 AND coalesce(flesch_reading_ease, 50) <= 70 THEN -5
        WHEN coalesce(flesch_reading_ease, 50) < 20 OR coalesce(flesch_reading_ease, 50) > 90 THEN 8 ELSE 0 END
 + CASE WHEN word_count >= 300 THEN -5 WHEN word_count < 100 THEN 5 ELSE 0 END
 - CASE WHEN paragraph_count >= 5 THEN 3 ELSE 0 END
 + CASE WHEN exclamation_ratio > 0.02 THEN 8 ELSE 0 END)"""


def scored_cte(src: str, out: str = "scored", params: Params = DEFAULT, base: str | None = None) -> str:
    """Adds rule_score, blend and the verdict columns to a feature CTE."""
    b = base or dbl(params.default_base_probability)
    thr = params.confidence_threshold
    full = "(is_trusted_domain = 1 AND has_author = 1 AND has_publish_date = 1)"
    part = "(is_trusted_domain = 1 AND (has_author = 1 OR has_publish_date = 1) AND word_count > 200)"
    return f"""{out} AS (
  SELECT *,
    CASE WHEN {full} OR {part} THEN CAST(0.0 AS DOUBLE) ELSE rule_score END AS feature_score,
    CASE WHEN {full} THEN CAST(0.1 AS DOUBLE) WHEN {part} THEN CAST(0.18 AS DOUBLE) ELSE blend END AS fake_probability,
    CASE WHEN {full} THEN CAST(0.9 AS DOUBLE) WHEN {part} THEN CAST(0.82 AS DOUBLE) ELSE 1 - blend END AS real_probability,
    CASE WHEN {full} THEN CAST(0.9 AS DOUBLE) WHEN {part} THEN CAST(0.82 AS DOUBLE)
         WHEN base_p IS NULL THEN CAST(0.0 AS DOUBLE) ELSE greatest(blend, 1 - blend) END AS confidence,
    CASE WHEN {full} OR {part} THEN 'REAL' WHEN base_p IS NULL THEN 'ERROR'
         WHEN greatest(round(blend, 12), 1 - round(blend, 12)) < {thr} THEN 'UNCERTAIN'
         WHEN round(blend, 12) > 0.5 THEN 'FAKE' ELSE 'REAL' END AS prediction,
    CASE WHEN base_p IS NULL THEN 'ERROR'
         WHEN greatest(round(base_p, 12), 1 - round(base_p, 12)) < {thr} THEN 'UNCERTAIN'
         WHEN round(base_p, 12) > 0.5 THEN 'FAKE' ELSE 'REAL' END AS bert_prediction,
    CASE WHEN {full} THEN {q(MODEL_OVERRIDE_FULL)} WHEN {part} THEN {q(MODEL_OVERRIDE_PARTIAL)}
         ELSE {q(MODEL_ENSEMBLE)} END AS model_used
  FROM (SELECT *, {dbl(params.base_weight)} * base_p + {dbl(params.feature_weight)} * rule_score AS blend
        FROM (SELECT *, {b} AS base_p,
                     CAST(greatest(0, least(100, {rule_points_sql()})) AS DOUBLE) / 100.0 AS rule_score
              FROM {src})))"""


# factor definitions: (name, importance, icon, condition, description SQL)
def positive_factor_defs():
    from credence.params import DESC_AUTHOR_PREFIX, DESC_BALANCED, DESC_DATE, DESC_QUOTES, DESC_READ_GOOD, DESC_TRUSTED
    pre, post = DESC_QUOTES.split("{n}")
    fl = "coalesce(flesch_reading_ease, 50)"
    return [
        ("Trusted Domain", "high", "is_trusted_domain = 1", q(DESC_TRUSTED)),
        ("Author Present", "medium", "has_author = 1",
         f"{q(DESC_AUTHOR_PREFIX)} || (CASE WHEN len(authors) > 0 THEN array_to_string(authors[1:2], ', ') ELSE 'Unknown' END)"),
        ("Publication Date", "low", "has_publish_date = 1", q(DESC_DATE)),
        ("Citations Present", "medium", "quote_count > 2", f"{q(pre)} || CAST(quote_count AS VARCHAR) || {q(post)}"),
        ("Appropriate Readability", "low", f"{fl} >= 30 AND {fl} <= 80", q(DESC_READ_GOOD)),
        ("Objective Tone", "medium", "text_subjectivity < 0.5", q(DESC_BALANCED)),
    ]


def negative_factor_defs(params: Params = DEFAULT):
    from credence.params import (DESC_CAPS, DESC_CLICKBAIT, DESC_EMOTIONAL, DESC_EXTREME, DESC_LACKS_SOURCES,
                                 DESC_NO_AUTHOR, DESC_NO_DATE, DESC_PUNCT, DESC_READ_POOR, DESC_SUBJECTIVE,
                                 DESC_UNRELIABLE, DESC_URLS)
    fl = "coalesce(flesch_reading_ease, 50)"
    cpre, cpost = DESC_CLICKBAIT.split("{keywords}")
    found = ("array_to_string(list_filter([" + ", ".join(q(k) for k in params.clickbait_keywords)
             + "], lambda k: contains(lower(coalesce(title, '')), k))[1:3], ', ')")
    ppre, ppost = DESC_PUNCT.split("{n}")
    return [
        ("Unreliable Domain", "critical", "is_trusted_domain <> 1 AND is_unreliable_domain = 1", q(DESC_UNRELIABLE)),
        ("No Author", "medium", "has_author <> 1", q(DESC_NO_AUTHOR)),
        ("Missing Date", "low", "has_publish_date <> 1", q(DESC_NO_DATE)),
        ("Lacks Citations", "medium", "quote_count <= 2 AND word_count > 100", q(DESC_LACKS_SOURCES)),
        ("Unusual Readability", "low", f"NOT ({fl} >= 30 AND {fl} <= 80)", q(DESC_READ_POOR)),
        ("Excessive Capitalization", "medium", "capital_ratio > 0.15", q(DESC_CAPS)),
        ("Excessive URLs", "low", "url_ratio > 0.05", q(DESC_URLS)),
        ("High Subjectivity", "medium", "text_subjectivity > 0.7", q(DESC_SUBJECTIVE)),
        ("Emotional Language", "medium", "emotional_word_ratio > 0.03", q(DESC_EMOTIONAL)),
        ("Extreme Sentiment", "low", "abs(text_polarity) > 0.5", q(DESC_EXTREME)),
        ("Clickbait Language", "high", "clickbait_keyword_count > 0", f"{q(cpre)} || {found} || {q(cpost)}"),
        ("Excessive Punctuation", "medium", "exclamation_ratio > 0.01",
         f"{q(ppre)} || CAST(exclamation_count AS VARCHAR) || {q(ppost)}"),
    ]


WEIGHT = {"critical": 30, "high": 20, "medium": 10, "low": 5}
RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}


def factor_list(defs, field: str = "name") -> str:
    """A list of the present factors' names (or descriptions) in order."""
    items = []
    for name, imp, cond, desc in defs:
        val = q(name) if field == "name" else desc if field == "desc" else q(imp)
        items.append(f"CASE WHEN {cond} THEN {val} END")
    return "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"


def weight_sum(defs) -> str:
    return "(" + " + ".join(f"CASE WHEN {cond} THEN {WEIGHT[imp]} ELSE 0 END" for _, imp, cond, _ in defs) + ")"


def explained_cte(src: str, out: str = "explained", params: Params = DEFAULT) -> str:
    from credence.params import (REC_ALWAYS, REC_CITATIONS, REC_CLICKBAIT, REC_MANY, REC_NO_AUTHOR,
                                 REC_UNRELIABLE, SUMMARY_LIKELY_FAKE, SUMMARY_LIKELY_REAL,
                                 SUMMARY_POSSIBLY_REAL, SUMMARY_POTENTIALLY_FAKE, SUMMARY_UNCERTAIN)
    pos, neg = positive_factor_defs(), negative_factor_defs(params)

    def tpl(t):
        a, b = t.split("{score}")
        return f"{q(a)} || CAST(credibility_score AS VARCHAR) || {q(b)}"

    return f"""{out} AS (
  SELECT *,
    CASE WHEN prediction = 'UNCERTAIN' THEN {tpl(SUMMARY_UNCERTAIN)}
         WHEN prediction = 'FAKE' AND credibility_score < 30 THEN {tpl(SUMMARY_LIKELY_FAKE)}
         WHEN prediction = 'FAKE' THEN {tpl(SUMMARY_POTENTIALLY_FAKE)}
         WHEN credibility_score > 70 THEN {tpl(SUMMARY_LIKELY_REAL)}
         ELSE {tpl(SUMMARY_POSSIBLY_REAL)} END AS summary,
    list_filter([{q(REC_ALWAYS)},
                 CASE WHEN list_contains(neg_names, 'Unreliable Domain') THEN {q(REC_UNRELIABLE)} END,
                 CASE WHEN list_contains(neg_names, 'No Author') THEN {q(REC_NO_AUTHOR)} END,
                 CASE WHEN list_contains(neg_names, 'Clickbait Language') THEN {q(REC_CLICKBAIT)} END,
                 CASE WHEN list_contains(neg_names, 'Lacks Citations') THEN {q(REC_CITATIONS)} END,
                 CASE WHEN len(neg_names) > 3 THEN {q(REC_MANY)} END], lambda x: x IS NOT NULL) AS recommendations
  FROM (SELECT *, greatest(0, least(100, 50 + {weight_sum(pos)} - {weight_sum(neg)})) AS credibility_score,
               {factor_list(pos)} AS pos_names, {factor_list(neg)} AS neg_names,
               {factor_list(pos, 'desc')} AS pos_desc, {factor_list(neg, 'desc')} AS neg_desc,
               {factor_list(neg, 'imp')} AS neg_imp
        FROM (SELECT * EXCLUDE (summary) FROM {src})))"""
