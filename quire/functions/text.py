"""Text expressions of the book pipeline. All are Column expressions and stay in the JVM, but for unescape_html."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What counts as white space and as a letter in Unicode.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
NO_SPACE = r"[^\s\x1c-\x1f\x85\p{Z}]"
LETTER = r"[\p{L}\p{Nl}\p{No}]"

# Capitals that may follow a section number, marks that end a sentence, clause or list item.
CAPITAL = "[A-ZÁÉÍÓÖŐÚÜŰ]"
SENTENCE_MARKS = ".!?…"
CLAUSE_MARKS = ";:,–"
ITEM_MARKS = ",:;–—"
CLOSING_QUOTES = "\"”»)"

# Top-level domains whose addresses are read as the domain alone.
DOMAINS = "com|org|net|edu|gov|io|hu|uk"

# Bounds of the narration.
PIECE_CHARS = 350
SHORT_WORDS = 3
TITLE_CHARS = 80
LEAST_SIMILARITY = 0.85
PAUSES = {"paragraph": 0.6, "heading": 1.2, "chapter": 2.0, "part": 0.25}
SAMPLE_RATE = 24000

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_letter(text: ColumnOrName) -> Column:
    """Holds a letter or a number that is a letter; digits and underscores don't count. Null is false."""
    return F.coalesce(_col(text).rlike(LETTER), F.lit(False))


def collapse(text: ColumnOrName) -> Column:
    """Runs of white space become one space; none is left at the ends."""
    return F.regexp_replace(F.regexp_replace(_col(text), f"{SPACE}+", " "), "^ | $", "")


@F.pandas_udf(StringType())
def unescape_html(text: pd.Series) -> pd.Series:
    """HTML character references, all named ones included."""
    return text.map(html.unescape, na_action="ignore")


def unescape_common(text: ColumnOrName) -> Column:
    """The references XML knows, and a few common ones, without Python. The ampersand is last: nothing is unescaped twice."""
    out = _col(text)
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(mark))
    return out


def plain_text(markup: ColumnOrName, html5: bool = True) -> Column:
    """Tags go, white space collapses, then references are replaced: by the full HTML list, or the common ones."""
    bare = collapse(F.regexp_replace(_col(markup), "<[^>]+>", ""))
    return unescape_html(bare) if html5 else unescape_common(bare)


def word_count(text: ColumnOrName) -> Column:
    return F.coalesce(F.regexp_count(_col(text), F.lit(f"{NO_SPACE}+")), F.lit(0))


# Patterns of what isn't read aloud.
SPOKEN_BREAK, SUPERSCRIPT = r'<br n="\d+"/>', r'<sup n="\d+">.*?</sup>'
EMPTY_LINK = r'<a n="\d+">[^<\p{L}\p{Nl}\p{No}]*</a>'
SECTION_NUMBER, SECTION_NUMBER_IN_TEXT = (rf"^(?U)\d+(?:\.\d+){more}\.?{SPACE}+(?={CAPITAL})" for more in "*+")
BLANK = "_{2,}"
_PAGES = rf"\d+(?:{SPACE}*[–-]{SPACE}*\d+)?"
PAGE_REFERENCE = rf"(?U){SPACE}*\((?:pp?|o|old)\.{SPACE}*{_PAGES}\)|{SPACE}*\({_PAGES}\.{SPACE}*o(?:ld)?\.\)"
# What ends a sentence, needs spelling out, or is an ampersand that isn't a reference.
SENTENCE_END = f"[{SENTENCE_MARKS}][{CLOSING_QUOTES}]*\\n?\\z"
NUMBER = r"(?U)\d|\b(?:[IVXLCDM]{2,}|[IVX])\."
BARE_AMPERSAND = r"&(?!#\d+;|#x[0-9a-fA-F]+;|amp;|lt;|gt;|quot;|apos;)"
# How services say that a quota is used up.
QUOTA = r"usage limit|rate limit|limit reached|hit your limit|resets? at|credit balance|insufficient_quota|quota"
# Codec frames a second, seconds a character, and the fewest frames asked for.
FRAME_RATE, CHARACTER_SECONDS, LEAST_FRAMES = 25, 0.12, 400


def domain_only(text: ColumnOrName) -> Column:
    """Web addresses become their domain."""
    return F.regexp_replace(_col(text), rf"(?iU)(?:https?://)?(?:www\.)?((?:[\w-]+\.)+(?:{DOMAINS}))(?:/{NO_SPACE}*)?", "$1")


def speech_text(markup: ColumnOrName, html5: bool = True) -> Column:
    """What is read aloud: breaks are spaces, superscripts and links without letters go."""
    out = F.regexp_replace(_col(markup), SPOKEN_BREAK, " ")
    for silent in (SUPERSCRIPT, EMPTY_LINK):
        out = F.regexp_replace(out, silent, "")
    return domain_only(plain_text(out, html5))


def prepare(text: ColumnOrName, heading: ColumnOrName) -> Column:
    """Without section numbers (before a capital; in body text those of several levels), blanks to fill in, and page references."""
    own, in_text = (F.regexp_replace(_col(text), pattern, "") for pattern in (SECTION_NUMBER, SECTION_NUMBER_IN_TEXT))
    out = F.when(_col(heading), own).otherwise(in_text)
    return F.regexp_replace(F.regexp_replace(out, BLANK, ""), PAGE_REFERENCE, "")


def ends_sentence(text: ColumnOrName) -> Column:
    return _col(text).rlike(SENTENCE_END)


def needs_spelling(text: ColumnOrName) -> Column:
    """Holds a digit, or a Roman numeral followed by a full stop (a single letter only if I, V or X)."""
    return _col(text).rlike(NUMBER)


def is_short(text: ColumnOrName, heading: ColumnOrName) -> Column:
    """A label or cell that is read together with its neighbours."""
    return ~_col(heading) & (word_count(text) <= SHORT_WORDS) & ~ends_sentence(text)


def piece_key(text: ColumnOrName) -> Column:
    return F.substring(F.sha1(_col(text)), 1, 16)


def piece_seed(text: ColumnOrName, attempt: ColumnOrName | int = 0) -> Column:
    more = F.lit(attempt) if isinstance(attempt, int) else _col(attempt)
    return F.conv(F.substring(F.sha1(_col(text)), 1, 8), 16, 10).cast("long") + more


def frame_cap(longest: ColumnOrName) -> Column:
    """Most codec frames for a longest text of so many characters."""
    return F.greatest(F.lit(LEAST_FRAMES), F.floor(_col(longest) * F.lit(CHARACTER_SECONDS) * F.lit(float(FRAME_RATE))).cast("int"))


def escape_bare_ampersands(text: ColumnOrName) -> Column:
    return F.regexp_replace(_col(text), BARE_AMPERSAND, "&amp;")


def semantics(kinds: ColumnOrName, roles: ColumnOrName) -> Column:
    """Tokens of the two attributes, each also without a leading ``doc-``."""
    tokens = lambda c: F.filter(F.split(F.coalesce(_col(c), F.lit("")), f"{SPACE}+"), lambda x: x != "")
    both = F.array_union(tokens(kinds), tokens(roles))
    return F.array_union(both, F.transform(both, lambda x: F.regexp_replace(x, "^doc-", "")))


def output_name(file: ColumnOrName) -> Column:
    """A file's path without its suffix, as one name."""
    bare = F.regexp_replace(_col(file), r"(?<=[^/])\.[^./]+\z", "")
    return F.regexp_replace(bare, r"(?U)[^\w.-]+", "_")


def slug(text: ColumnOrName, fallback: str | None = None) -> Column:
    """Lower-case ASCII letters and digits with single hyphens between."""
    out = F.lower(F.regexp_replace(F.regexp_replace(_col(text), "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(fallback)) if fallback else out


def metadata_escape(text: ColumnOrName) -> Column:
    return F.regexp_replace(_col(text), r"([=;#\\\n])", r"\\$1")


def quote_path(path: ColumnOrName) -> Column:
    return F.concat(F.lit("'"), F.replace(_col(path), F.lit("'"), F.lit("'\\''")), F.lit("'"))


def provider_spec(spec: ColumnOrName) -> tuple[Column, Column]:
    """(provider, model) of a specification, split at its first colon."""
    at = F.instr(_col(spec), ":")
    provider = F.when(at > 0, F.substring_index(_col(spec), ":", 1)).otherwise(_col(spec))
    return provider, F.when(at > 0, F.substr(_col(spec), at + 1)).otherwise(F.lit(""))


def is_noise(line: ColumnOrName) -> Column:
    """Lines a speech library prints that say nothing about the work."""
    # What such lines hold.
    return _col(line).rlike(r"(?i)warn|Fetching \d+ files|kernel = np\.where")


def is_quota_error(message: ColumnOrName) -> Column:
    return F.coalesce(_col(message).rlike(f"(?i){QUOTA}"), F.lit(False))


def occurrences(text: ColumnOrName, mark: str) -> Column:
    """How often a mark occurs, without overlaps."""
    return ((F.length(_col(text)) - F.length(F.replace(_col(text), F.lit(mark), F.lit("")))) / len(mark)).cast("int")
