"""Shared text primitives as Spark Column expressions.

All of these are JVM-side higher-order functions over one row's token array,
so they cost O(words) per row, need no shuffle and scale linearly with the
corpus.  Each function takes and returns ``Column``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A token ends a sentence when it ends in . ! or ? followed only by closing
# quotes/brackets.  The boundary applies to every token but the last.
SENTENCE_END = r"""[.!?]["')\]]*$"""

SENTENCE_LAST = (".", "!", "?", '"', "'", ")", "]")

# The characters Python's str.split()/str.strip() treat as whitespace.  One
# explicit class keeps Spark (Java regex) and the SQL oracle (RE2) identical.
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
            "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
WS_CLASS = (r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
WS_OTHER_CLASS = WS_CLASS.replace(" ", "")
WHITESPACE = WS_CLASS + "+"
NOT_WS_CLASS = WS_CLASS.replace("[", "[^", 1)
# Java tests a class of single Latin-1 characters with one look into a bit
# set, but ranges one after another: the patterns that meet every character
# of a text list theirs singly
LATIN = "".join(rf"\x{i:02X}" for i in range(256) if chr(i) not in WS_CHARS)
# a space before more white space, or a run that starts with another one
GAP = rf" (?![{LATIN}]){WS_CLASS}+|(?![ {LATIN}]){WS_OTHER_CLASS}{WS_CLASS}*"
# the same matches as WHITESPACE
GAPS = f"(?![{LATIN}]){WHITESPACE}"
AZ = "abcdefghijklmnopqrstuvwxyz"
CONSONANT = "[bcdfghjklmnpqrstvwxz]"
# first characters that can be upper case (see is_capitalised, which decides)
UPPER_FIRST = r"[A-Z\x{80}-\x{10FFFF}&&[^\p{Ll}\p{Lo}]]"


def materialize(c: Column) -> Column:
    """Evaluate a per-row intermediate once.

    Catalyst inlines a projected expression into its consumer when the
    consumer references it once, even when that reference sits inside a
    lambda body, where it would then be recomputed for every array element.
    Guarding the producer with a (constant-true) non-deterministic condition
    keeps it a separate projection, computed once per row.
    """
    return F.when(F.spark_partition_id() >= 0, c)


def spaced(text: Column) -> Column:
    """The text's tokens with one space between them: every run of white
    space but a lone space is replaced, so most gaps are no match."""
    return F.trim(F.regexp_replace(text, GAP, " "))


def split_spaced(spaced_text: Column) -> Column:
    """The tokens of a text from :func:`spaced` (a one-character split needs no regex)."""
    return F.array_remove(F.split(spaced_text, " "), "")


def words(text: Column) -> Column:
    """Whitespace split, no empty tokens, punctuation kept."""
    return split_spaced(spaced(text))


def sentence_end_flags(ws: Column) -> Column:
    """Per token: does it close a sentence (SENTENCE_END)?"""
    # most tokens end in a letter: look at the last character before any regex
    return F.transform(ws, lambda w: F.right(w, F.lit(1)).isin(*SENTENCE_LAST) & w.rlike(SENTENCE_END))


def sentence_count_from_flags(flags: Column) -> Column:
    """T2 from per-token end flags: 0 without tokens, else 1 + boundaries
    among all tokens but the last."""
    n = F.size(flags)
    inner = F.size(F.array_remove(F.slice(flags, 1, F.greatest(n - 1, F.lit(0))), False))
    return F.when(n == 0, F.lit(0)).otherwise(inner + 1)


def sentence_starts_from_flags(ws: Column, flags: Column) -> Column:
    """T3 from per-token end flags (distinct first tokens of sentences).

    Token i starts a sentence when i = 0 or token i-1 ends one; the shifted
    flags are passed as a zip argument (evaluated once per row)."""
    prev_end = F.concat(F.array(F.lit(True)), F.slice(flags, 1, F.greatest(F.size(flags) - 1, F.lit(0))))
    firsts = F.zip_with(ws, prev_end, lambda w, p: F.when(p, w))
    return F.array_distinct(F.filter(firsts, lambda w: w.isNotNull()))


def sentence_count(spaced_text: Column) -> Column:
    """T2 from a text of :func:`spaced`: what ends a token and is followed by
    a space ends a sentence."""
    inner = F.regexp_count(spaced_text, F.lit(r"""[.!?]["')\]]*+ """))
    return F.when(spaced_text == "", F.lit(0)).otherwise(inner + 1)


def capitalised(spaced_text: Column) -> Column:
    """Capitalised tokens of two characters and more, in order."""
    found = F.regexp_extract_all(F.concat(F.lit(" "), spaced_text), F.lit(f" ({UPPER_FIRST}[^ ]+)"), 1)
    return F.filter(found, is_capitalised)


def capitalised_starts(spaced_text: Column) -> Column:
    """Those that start a sentence (T3), each once."""
    found = F.regexp_extract_all(F.concat(F.lit(" "), spaced_text),
                                 F.lit(rf"""(?:^|[.!?]["')\]]*+) (?=({UPPER_FIRST}[^ ]+))"""), 1)
    return F.array_distinct(F.filter(found, is_capitalised))


def all_caps_count(spaced_text: Column) -> Column:
    """Tokens of two characters and more in capitals; only those without a-z are looked at."""
    found = F.regexp_extract_all(F.concat(F.lit(" "), spaced_text), F.lit(f" ([^ {AZ}]{{2,}}+)(?![^ ])"), 1)
    return F.size(F.filter(found, is_all_caps))


def is_capitalised(w: Column) -> Column:
    """First character is an upper-case letter."""
    c = F.substring(w, 1, 1)
    return (c == F.upper(c)) & (c != F.lower(c))


def is_all_caps(w: Column) -> Column:
    """Has a cased character and no lower-case one (str.isupper)."""
    return (w == F.upper(w)) & (w != F.lower(w))


def syllables(word: Column) -> Column:
    """T4: vowel-group syllable estimate of one token."""
    c = F.regexp_replace(F.lower(word), "[^a-z]", "")
    groups = F.regexp_count(c, F.lit("[aeiouy]+"))
    silent_e = F.when(c.endswith("e"), F.lit(1)).otherwise(F.lit(0))
    return F.when(F.length(c) <= 3, F.lit(1)).otherwise(F.greatest(F.lit(1), groups - silent_e))


def total_syllables(letters: Column, n: Column) -> Column:
    """T4 summed over a text of ``n`` tokens, without a look at each token.
    ``letters``: the text in lower case, only a-z and the spaces kept.

    Every token has one syllable; a longer one has another for each vowel
    group after its first that is no final silent e.  Such groups follow a
    vowel and consonants; of the tokens of up to three letters only
    vowel-consonant-vowel has one, which is taken off again."""
    more = F.regexp_count(letters, F.lit(f"[aeiouy]{CONSONANT}++(?=[aeiouy]++(?:{CONSONANT}|(?<!e)))"))
    short = F.regexp_count(F.concat(F.lit(" "), letters, F.lit(" ")), F.lit(f" [aeiouy]{CONSONANT}[aiouy](?= )"))
    return n + more - short


def keyword_hits(text_lower: Column, keywords: Iterable[str]) -> Column:
    """T5: number of distinct list entries contained as a substring."""
    total = F.lit(0)
    for kw in keywords:
        total = total + F.when(text_lower.contains(kw), F.lit(1)).otherwise(F.lit(0))
    return total


def matched_keywords(text_lower: Column, keywords: Iterable[str]) -> Column:
    """The list entries (in list order) contained in the text."""
    arr = F.array(*[F.lit(k) for k in keywords])
    return F.filter(arr, lambda k: F.instr(text_lower, k) > 0)


def char_count(text: Column, ch: str) -> Column:
    """Occurrences of one literal character, without a regex."""
    return F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, 0 when the denominator is 0 (ANSI-safe)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def quote_pairs(text: Column) -> Column:
    """Pairs of quotation marks, straight and curly (U+201C, U+201D)."""
    n = char_count(text, '"') + char_count(text, "\u201c") + char_count(text, "\u201d")
    return F.floor(n / 2).cast("int")
