"""Text rules as expressions: three token rules, ordered distinct, temporal tokens, anchors, heuristics."""

from __future__ import annotations

from ..plans.dialect import Spark

#: Words that never become keywords.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "need", "dare", "ought",
    "used", "to", "of", "in", "for", "on", "with", "at", "by", "from",
    "as", "into", "through", "during", "before", "after", "above",
    "below", "between", "out", "off", "over", "under", "again",
    "further", "then", "once", "here", "there", "when", "where", "why",
    "how", "all", "both", "each", "few", "more", "most", "other",
    "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "just", "because", "but", "and", "or",
    "if", "while", "about", "up", "it", "its", "i", "me", "my",
    "you", "your", "he", "she", "they", "we", "this", "that", "these",
    "those", "what", "which", "who", "whom", "says", "said", "speaker",
)
#: What counts as a year, a numeric date, a time of day.
YEAR, DATE, CLOCK = r"(?:19|20)\d{2}", r"\b\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?\b", r"\b\d{1,2}:\d{2}\b"


def tokens(d: Spark, x: str) -> str:
    """All of them, in order, as BM25 counts them."""
    return d.found(f"lower({x})", "[a-z0-9]+")


def token_set(d: Spark, x: str, longer_than: int) -> str:
    return d.uniq(d.keep(tokens(d, x), f"length(v) > {longer_than}"))


def ascii_only(d: Spark, x: str) -> str:
    """Word boundaries mean the same everywhere once other letters are gone."""
    return d.sub(x, r"[^\x00-\x7F]", " ")


def ordered_distinct(d: Spark, a: str) -> str:
    """First occurrences, for names a of array columns of normalized strings."""
    return d.keep(a, f"{d.at(a, 'v')} = @i")


def temporal_parts(d: Spark, x: str) -> str:
    return d.cat(*(d.found(f"lower({x})", p) for p in (YEAR, DATE, CLOCK)))


def squeezed(d: Spark, x: str) -> str:
    return f"trim({d.sub(f'coalesce({x}, {chr(39)}{chr(39)})', r'[ \t\n\r\x0B\f]+', ' ')})"


def estimate(d: Spark, x: str) -> str:
    """Tokens a model would see, roughly: CJK signs, and runs of word characters or single signs of the rest."""
    rest = d.sub(x, r"[\x{4E00}-\x{9FFF}]", " ")
    return f"{d.size(d.found(x, r'[\x{4E00}-\x{9FFF}]'))} + {d.size(d.found(rest, r'[A-Za-z0-9_]+|[^ \t\n\r\x0B\f]'))}"


def stop_list() -> str:
    return ", ".join(f"'{x}'" for x in STOP_WORDS)


def first_sentence(d: Spark, x: str) -> str:
    return f"coalesce(nullif(trim({d.first(x, r'^(.+?[.!?])[ \t\n\r]')}), ''), trim({d.head(x, 200)}))"


#: Months, words that end an event's name, capitalised words that name nothing.
MONTHS = (
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December",
    "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Sept", "Oct", "Nov", "Dec",
)
EVENT_HEADS = ("support group", "workshop", "conference", "meeting", "event", "race", "trip", "hike", "class", "course", "job", "promotion", "accident", "party", "program", "test", "group")
NOT_ENTITIES = ("Speaker", "Image", "Date", "Episode", "The", "This", "That")
#: Cues of elapsed time, order and relative time in a question in lower case; the first match of each counts.
TIME_CUES = (
    r"how (?:many|long)\s+(?:days?|weeks?|months?|years?|hours?)?\s*(?:ago|(?:have\s+)?passed\s*(?:since|between)?|since|between)",
    r"most recent(?:ly)?", r"first time", r"last time", r"\bearliest\b",
    r"last (?:week|weekend|month|year|day)\b", r"this (?:week|month|year)\b", r"in the (?:last|past) \w+", r"since the start of", r"a few (?:days|weeks|months) ago", r"\brecently\b",
)


def quoted(x: str) -> str:
    """A pattern inside an SQL string."""
    return x.replace("'", "\\x27")


def unique(d: Spark, source: str, keep: str, a: str, most: int, out: str = "items") -> list[tuple[str, str]]:
    """Steps to rows (keep, items): a's values without white space and signs around them, each once whatever its case, most at most."""
    bare = d.sub(d.sub("v", r"[ \t\n\r]+", " "), quoted(r"^[ .,;:!?()\[\]{}\x22\x27]+|[ .,;:!?()\[\]{}\x22\x27]+$"), "")
    return [(f"{out}_bare", f"SELECT {keep}, {d.keep(d.each(a, bare), 'v <> ' + chr(39) * 2)} AS a FROM {source}"), (f"{out}_lower", f"SELECT {keep}, a, {d.each('a', 'lower(v)')} AS l FROM {out}_bare"),
        (out, f"SELECT {keep}, {d.cut(d.keep('a', f'{d.at(chr(108), "lower(v)")} = @i'), most)} AS {out} FROM {out}_lower")]


def times(d: Spark, x: str) -> str:
    month = "(?:" + "|".join(MONTHS) + ")"
    patterns = (r"\b\d{1,2}:\d{2}\s*(?:am|pm|AM|PM)?\b", rf"(?i)\b\d{{1,2}}\s+{month},?\s+(?:19|20)\d{{2}}\b", rf"(?i)\b{month}\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+(?:19|20)\d{{2}}\b", DATE, r"\b(?:19|20)\d{2}\b")
    return d.cat(*(d.found(x, p) for p in patterns))


def entities(d: Spark, x: str) -> str:
    return d.found(x, r"\b[A-Z][a-zA-Z0-9_-]{2,}(?:\s+[A-Z][a-zA-Z0-9_-]{2,})?\b")


def events(d: Spark, x: str) -> str:
    """Up to four words before a head, without who did what in front."""
    did = "(?:attended|joined|went to|visited|started|took|had|saw|did)"
    found = d.cat(*(d.found(x, quoted(rf"(?i)\b((?:[A-Za-z0-9+'-]+\s+){{0,4}}{h})\b"), 1) for h in EVENT_HEADS))
    for p in (rf"(?i)^(?:i|we|he|she|they|you)\s+{did}\s+", rf"(?i)^{did}\s+", r"(?i)^the\s+"):
        found = d.each(found, d.sub("v", p, ""))
    return found
