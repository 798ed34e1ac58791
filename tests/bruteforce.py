"""Plain-Python statements of the feature semantics, for brute-force checks.

Deliberately naive (one loop per rule) and independent of the Spark code.
"""

import re

from credence.params import (CLICKBAIT_PATTERNS, COMMON_TLDS, DEFAULT, URL_PATTERN)

END = re.compile(r"""[.!?]["')\]]*$""")


def words(t):
    return t.split()


def ends(w):
    return END.search(w) is not None


def sentence_count(ws):
    return 0 if not ws else 1 + sum(1 for w in ws[:-1] if ends(w))


def starts(ws):
    return {w for i, w in enumerate(ws) if i == 0 or ends(ws[i - 1])}


def syllables(w):
    c = re.sub("[^a-z]", "", w.lower())
    if len(c) <= 3:
        return 1
    return max(1, len(re.findall("[aeiouy]+", c)) - (1 if c.endswith("e") else 0))


def cap_first(w):
    c = w[:1]
    return c == c.upper() and c != c.lower()


def sentiment(text, params=DEFAULT):
    norm = "".join(" " if ch.isspace() else ch for ch in text.lower())
    toks = re.sub(r"[^a-z' ]", "", norm).split()
    lex = {w: (p, s) for w, p, s, _ in params.lexicon if p != 0 or s != 0}
    inten = {w: i for w, _, _, i in params.lexicon if i != 1.0}
    ps, ss = [], []
    for i, t in enumerate(toks):
        if t not in lex:
            continue
        mod = inten.get(toks[i - 1], 1.0) if i > 0 else 1.0
        neg = -0.5 if ((i > 0 and toks[i - 1] in params.negations) or (i > 1 and toks[i - 2] in params.negations)) else 1.0
        ps.append(lex[t][0] * mod * neg)
        ss.append(min(1.0, lex[t][1] * mod))
    if not ps:
        return 0.0, 0.0
    return max(-1.0, min(1.0, sum(ps) / len(ps))), max(0.0, min(1.0, sum(ss) / len(ss)))


def features(text, title="", domain="", authors=(), publish_date=None, images=(), meta="", keywords=(),
             summary="", params=DEFAULT):
    ws, tw = words(text), words(title)
    n, s = len(ws), sentence_count(ws)
    L = len(text)
    r = lambda a, b: a / b if b else 0.0
    stop = set(params.stopword_list())
    f = {}
    f["text_length"], f["title_length"], f["word_count"] = L, len(title), n
    f["avg_word_length"] = r(sum(len(w) for w in ws), n)
    f["sentence_count"], f["avg_sentence_length"] = s, r(n, s)
    f["exclamation_count"], f["question_count"] = text.count("!"), text.count("?")
    f["exclamation_ratio"] = r(text.count("!"), L)
    f["capital_ratio"] = r(len(re.findall("[A-Z]", text)), L)
    f["title_caps_ratio"] = r(sum(1 for w in tw if w.isupper() and len(w) > 1), len(tw))
    f["unique_word_ratio"] = r(len({w.lower() for w in ws}), n)
    f["stopword_ratio"] = r(sum(1 for w in ws if w.lower() in stop), n)
    f["text_polarity"], f["text_subjectivity"] = sentiment(text, params)
    f["title_polarity"], f["title_subjectivity"] = sentiment(title, params)
    emo = sum(1 for k in params.emotional_words if k in text.lower())
    f["emotional_word_count"], f["emotional_word_ratio"] = emo, r(emo, n)
    syl = sum(syllables(w) for w in ws)
    ok = n > 0 and s > 0
    f["flesch_reading_ease"] = 206.835 - 1.015 * (n / s) - 84.6 * (syl / n) if ok else 0.0
    f["flesch_kincaid_grade"] = 0.39 * (n / s) + 11.8 * (syl / n) - 15.59 if ok else 0.0
    f["avg_syllables_per_word"] = syl / n if ok else 0.0
    urls = len(re.findall(URL_PATTERN, text))
    f["url_count"], f["url_ratio"] = urls, r(urls, n)
    f["quote_count"] = (text.count('"') * 3) // 2
    st = starts(ws)
    proper = sum(1 for w in ws if cap_first(w) and len(w) > 1 and w not in st)
    f["proper_noun_count"], f["proper_noun_ratio"] = proper, r(proper, n)
    paras = len([p for p in text.split("\n\n") if p.strip()])
    f["paragraph_count"], f["avg_paragraph_length"] = max(1, paras), r(n, paras)
    d = domain.lower().replace("www.", "")
    f["is_trusted_domain"] = int(any(t in d for t in params.trusted_domains))
    f["is_unreliable_domain"] = int(any(t in d for t in params.unreliable_domains))
    f["has_common_tld"] = int(any(d.endswith(t) for t in COMMON_TLDS))
    f["has_author"], f["author_count"] = int(len(authors) > 0), len(authors)
    f["has_publish_date"] = int(bool(publish_date))
    f["image_count"], f["has_images"] = len(images), int(len(images) > 0)
    tl = title.lower()
    kw = sum(1 for k in params.clickbait_keywords if k in tl)
    f["clickbait_keyword_count"], f["has_clickbait"] = kw, int(kw > 0)
    f["title_has_numbers"] = int(re.search("[0-9]", title) is not None)
    f["clickbait_pattern_count"] = sum(1 for p in CLICKBAIT_PATTERNS if re.search(p, tl))
    f["title_trailing_punctuation"] = int(re.search(r"[.!?]{2,}$|…$", title) is not None)
    f["has_meta_description"], f["meta_description_length"] = int(len(meta) > 0), len(meta)
    f["has_keywords"], f["keyword_count"] = int(len(keywords) > 0), len(keywords)
    f["has_summary"] = int(bool(summary))
    return f
