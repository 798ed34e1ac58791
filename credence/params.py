"""Parameters of the credibility job.

Everything a run can tune lives in one frozen dataclass, ``Params``.  Word lists
and thresholds are plain Python values: they are small and bounded, so they are
inlined into the plan as literal arrays / ``IN`` sets (Catalyst turns an ``IN``
with more than 10 literals into a hash ``InSet``), never joined or broadcast
from a table that could grow with the data.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# ---------------------------------------------------------------------------
# FIXED VALUES — these must equal the behaviour we reproduce (word lists,
# thresholds, patterns and output strings).  Stated once, in natural order.
# ---------------------------------------------------------------------------

CLICKBAIT_KEYWORDS = (
    "you won't believe", "this will blow your mind",
    "doctors hate", "one weird trick", "what happens next will",
    "must see", "gone wrong", "jaw-dropping",
)

EMOTIONAL_WORDS = (
    "outrageous", "horrifying", "terrifying",
    "disgusting", "infuriating", "devastating", "bombshell",
)

TRUSTED_DOMAINS = (
    "reuters.com", "apnews.com", "bbc.com", "bbc.co.uk", "npr.org", "pbs.org",
    "nytimes.com", "washingtonpost.com", "theguardian.com", "economist.com",
    "cnn.com", "abcnews.go.com", "cbsnews.com", "nbcnews.com", "usatoday.com",
    "time.com", "newsweek.com", "politico.com", "thehill.com", "axios.com",
)

UNRELIABLE_DOMAINS = ("beforeitsnews.com", "naturalnews.com", "infowars.com")

COMMON_TLDS = (".com", ".org", ".net", ".gov", ".edu")

# Seven title patterns, matched against the lower-cased title.
CLICKBAIT_PATTERNS = (
    r"you won't believe",
    r"what happens next",
    r"doctors hate",
    r"number [0-9]+",
    r"[0-9]+ (reasons|ways|things|facts)",
    r"will shock you",
    r"this is why",
)

# URL pattern of the url_count feature.  The class [$-_@.&+] is a *range*
# from '$' to '_' (it also covers digits, upper case, '/', ':', '?', '=').
URL_PATTERN = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"

CONFIDENCE_THRESHOLD = 0.53
MAX_SEQUENCE_LENGTH = 512
BATCH_SIZE = 8
MAX_CONTENT_SIZE = 5 * 1024 * 1024
RATE_LIMIT_PER_MINUTE = 30
CACHE_EXPIRATION_SECONDS = 3600
MIN_TEXT_LENGTH = 50
BASE_WEIGHT = 0.4
FEATURE_WEIGHT = 0.6

MODEL_OVERRIDE_FULL = "Ensemble (BERT + Features) - Trusted Source Override"
MODEL_OVERRIDE_PARTIAL = "Ensemble (BERT + Features) - Trusted Source"
MODEL_ENSEMBLE = "Ensemble (BERT + Features)"

# importance -> (weight, rank)
IMPORTANCE = (("critical", 30, 0), ("high", 20, 1), ("medium", 10, 2), ("low", 5, 3))

ICON_OK = "✓"       # check mark
ICON_WARN = "⚠"     # warning sign
ICON_STOP = "\U0001f6ab"  # no-entry sign

DESC_TRUSTED = "✓ Content is from a trusted news source"
DESC_UNRELIABLE = "⚠ Content is from a known unreliable source"
DESC_AUTHOR_PREFIX = "✓ Written by: "
DESC_NO_AUTHOR = "⚠ No author information provided"
DESC_DATE = "✓ Clear publication date provided"
DESC_NO_DATE = "⚠ Missing publication date"
DESC_CLICKBAIT = "⚠ Title contains clickbait language ('{keywords}')"
DESC_EMOTIONAL = "⚠ Excessive use of emotional language"
DESC_CAPS = "⚠ Excessive capitalization indicates sensationalism"
DESC_EXTREME = "⚠ Content shows extreme emotional bias"
DESC_SUBJECTIVE = "⚠ Content is highly subjective rather than factual"
DESC_BALANCED = "✓ Content maintains a balanced, objective tone"
DESC_LACKS_SOURCES = "⚠ Article lacks proper citations or sources"
DESC_QUOTES = "✓ Article includes {n} quoted sources"
DESC_URLS = "⚠ Contains suspicious or excessive URLs"
DESC_READ_GOOD = "✓ Writing quality is appropriate for news content"
DESC_READ_POOR = "⚠ Unusual readability level for news content"
DESC_PUNCT = "⚠ Title/text contains {n} exclamation marks"

SUMMARY_UNCERTAIN = ("⚠ UNCERTAIN - Unable to make a confident determination. "
                     "Credibility score: {score}/100. "
                     "Please verify information with multiple trusted sources.")
SUMMARY_LIKELY_FAKE = ("\U0001f6ab LIKELY FAKE - Multiple red flags detected. "
                       "Credibility score: {score}/100. "
                       "Strong evidence suggests this content is unreliable.")
SUMMARY_POTENTIALLY_FAKE = ("⚠ POTENTIALLY FAKE - Some concerns identified. "
                            "Credibility score: {score}/100. "
                            "Approach with skepticism and verify claims.")
SUMMARY_LIKELY_REAL = ("✓ LIKELY REAL - Content appears credible. "
                       "Credibility score: {score}/100. "
                       "Multiple indicators suggest this is reliable content.")
SUMMARY_POSSIBLY_REAL = ("✓ POSSIBLY REAL - Some credibility indicators present. "
                         "Credibility score: {score}/100. "
                         "Content shows signs of legitimacy but verify important claims.")

REC_ALWAYS = "Cross-reference this information with established news sources"
REC_UNRELIABLE = "This source has a history of unreliable reporting - seek alternative sources"
REC_NO_AUTHOR = "Look for articles on this topic from sources that clearly identify their authors"
REC_CLICKBAIT = "Be skeptical of sensational claims - look for evidence-based reporting"
REC_CITATIONS = "Verify key claims by finding primary sources or expert opinions"
REC_MANY = "Multiple concerns identified - exercise extra caution with this content"

ERROR_INVALID_URL = "Invalid URL format"
ERROR_TOO_LARGE = "Content too large"
ERROR_NO_TEXT = "No text found"

# ---------------------------------------------------------------------------
# Our own small sentiment lexicon (word, polarity, subjectivity, intensity):
# four grades of polarity, each with one value, set by us; no parity with any
# published lexicon.  Intensity multiplies the *next* sentiment word.
# ---------------------------------------------------------------------------

_GRADES = (
    (0.9, 0.9, """excellent best great wonderful amazing incredible"""),
    (0.4, 0.5, """good better positive happy success successful strong important clear accurate reliable safe miracle"""),
    (-0.4, 0.5, """bad worse negative wrong false fake dangerous sad angry crisis secret bombshell"""),
    (-0.9, 0.9, """worst terrible awful horrible shocking outrageous horrifying terrifying disgusting infuriating devastating"""),
    (0.0, 0.2, """official new old"""),
)
_INTENSIFIERS = ((1.25, """very really so highly quite"""), (1.5, """extremely totally absolutely"""))
DEFAULT_LEXICON = tuple(
    [(w, p, s, 1.0) for p, s, words in _GRADES for w in words.split()]
    + [(w, 0.0, 0.0, i) for i, words in _INTENSIFIERS for w in words.split()])

NEGATIONS = ("not", "no", "never", "neither", "nor", "cannot", "can't", "don't",
             "doesn't", "didn't", "isn't", "wasn't", "aren't", "weren't", "won't")


# FIXED VALUES: the English stop words of Spark ML's StopWordsRemover (181).
ENGLISH_STOPWORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself",
    "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these",
    "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do",
    "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while",
    "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during", "before",
    "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again",
    "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each",
    "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than",
    "too", "very", "s", "t", "can", "will", "just", "don", "should", "now", "i'll", "you'll", "he'll",
    "she'll", "we'll", "they'll", "i'd", "you'd", "he'd", "she'd", "we'd", "they'd", "i'm", "you're", "he's",
    "she's", "it's", "we're", "they're", "i've", "we've", "you've", "they've", "isn't", "aren't", "wasn't",
    "weren't", "haven't", "hasn't", "hadn't", "don't", "doesn't", "didn't", "won't", "wouldn't", "shan't",
    "shouldn't", "mustn't", "can't", "couldn't", "cannot", "could", "here's", "how's", "let's", "ought",
    "that's", "there's", "what's", "when's", "where's", "who's", "why's", "would",
)


def english_stopwords() -> tuple[str, ...]:
    return ENGLISH_STOPWORDS


@dataclass(frozen=True)
class Params:
    """All knobs of one run.  ``Params()`` reproduces the reference defaults."""

    clickbait_keywords: tuple[str, ...] = CLICKBAIT_KEYWORDS
    emotional_words: tuple[str, ...] = EMOTIONAL_WORDS
    trusted_domains: tuple[str, ...] = TRUSTED_DOMAINS
    unreliable_domains: tuple[str, ...] = UNRELIABLE_DOMAINS
    # 'contains' keeps parity (a trusted name anywhere in the host counts);
    # 'suffix' is the safe variant (host equals it or ends with '.' + it).
    domain_match: str = "contains"
    stopwords: tuple[str, ...] | None = None  # None -> english_stopwords()
    lexicon: tuple[tuple[str, float, float, float], ...] = DEFAULT_LEXICON
    negations: tuple[str, ...] = NEGATIONS
    confidence_threshold: float = CONFIDENCE_THRESHOLD
    base_weight: float = BASE_WEIGHT
    feature_weight: float = FEATURE_WEIGHT
    max_tokens: int = MAX_SEQUENCE_LENGTH
    max_content_size: int = MAX_CONTENT_SIZE
    min_text_length: int = MIN_TEXT_LENGTH
    default_base_probability: float = 0.5
    rate_limit: int = RATE_LIMIT_PER_MINUTE
    cache_ttl_seconds: int = CACHE_EXPIRATION_SECONDS

    def stopword_list(self) -> tuple[str, ...]:
        return self.stopwords if self.stopwords is not None else english_stopwords()

    def with_domains(self, trusted=None, unreliable=None) -> "Params":
        return replace(
            self,
            trusted_domains=tuple(trusted) if trusted is not None else self.trusted_domains,
            unreliable_domains=tuple(unreliable) if unreliable is not None else self.unreliable_domains,
        )


DEFAULT = Params()

# Profile used by the registered corpus queries: the reference lists plus the
# two host families of the crawl table, so the trust branches are reached by
# real rows (hosts under example.org count as trusted, example.net as
# unreliable).  Everything else is the default.
CORPUS = DEFAULT.with_domains(
    trusted=TRUSTED_DOMAINS + ("example.org",),
    unreliable=UNRELIABLE_DOMAINS + ("example.net",),
)
