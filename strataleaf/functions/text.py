"""Text expressions for titles, headings and printed tables of contents.

Patterns use (?U) so that \\w, \\s and \\d follow Unicode as the semantics ask.
Every function takes and returns a Column; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Thresholds that decide results.
HEADING_MIN, HEADING_MAX = 3, 200
FUZZY_MIN, FUZZY_RATIO = 8, 0.5
SHORT_LINE = 100
PRINTED_LINE_MAX = 200
LEADER_RUN, NUMBER_GAP = 3, 4
BOLD_FLAG = 16

#: Patterns that decide results.
ROMAN = r"(?:X{0,3}(?:IX|IV|V?I{0,3}))"
SECTION_NUMBER = rf"^\s*(\d+\.|\d+\.\d+|(?:Chapter|Section|Part|Appendix)\s|C\s+H\s+A\s+P\s+T\s+E\s+R|{ROMAN}\.?\s)"
LETTERSPACED = r"^[A-Z](\s+[A-Z]){3,}"
FRONT_MATTER_TITLES = (
    "acknowledgements",
    "acknowledgments",
    "contents",
    "foreword",
    "introduction",
    "note on the use of the book",
    "preface",
    "table of contents",
)
FRONT_MATTER = (
    rf"^(?:{'|'.join(FRONT_MATTER_TITLES)})"
    r"(?:\s+(?:to the\b.*|to\s+.*\bedition\b.*|for the\b.*|of the\b.*|of volume\b.*))?$"
)
MAIN_START = r"^\s*(?:1(?:\.|\s+)|chapter\s+(?:1|i)\b|part\s+(?:1|i)\b|i\s+)"
TRAILING_NUMBER = rf"[.\s·…]{{{LEADER_RUN},}}\s*\d+\s*$|\t\d+\s*$|\s{{{NUMBER_GAP},}}\d+\s*$"
SECTION_PREFIX = r"^\s*(\d+(?:\.\d+)+)"
APPENDIX_PREFIX = r"^\s*appendix\s+\S+\s+"
SUBSET_PREFIX = r"^[A-Z]{6}\+"
LEADING_NUMBER = r"^\d+(?:\.\d+)*[\.\)]*\s*"


def _sub(text: Column, pattern: str, new: str = "", flags: str = "U") -> Column:
    return F.regexp_replace(text, F.lit(f"(?{flags}){pattern}"), F.lit(new))


def strip(text: Column) -> Column:
    return _sub(text, r"^\s+|\s+$")


def squeeze(text: Column) -> Column:
    return _sub(text, r"\s+", " ")


def normalize_snippet(text: Column) -> Column:
    """Without leading numbering and punctuation, lower-cased, blanks joined."""
    bare = _sub(_sub(text, LEADING_NUMBER), r"[^\w\s]")
    return squeeze(strip(F.lower(bare)))


def normalize_title(text: Column) -> Column:
    """As normalize_snippet, but numbering and dots stay."""
    return squeeze(_sub(F.lower(strip(text)), r"[^\w\s\.]"))


def normalize_for_restore(text: Column) -> Column:
    """Without punctuation, lower-cased, blanks joined; numbers stay."""
    return squeeze(strip(F.lower(_sub(text, r"[^\w\s]"))))


def normalize_front(text: Column) -> Column:
    return squeeze(_sub(F.lower(strip(text)), r"[^\w\s]"))


def strip_subset_prefix(font: Column) -> Column:
    return F.regexp_replace(font, F.lit(SUBSET_PREFIX), F.lit(""))


def section_prefix(title: Column) -> Column:
    """Dotted number at the start, such as 6.6; null if there is none."""
    return F.nullif(F.regexp_extract(title, "(?U)" + SECTION_PREFIX, 1), F.lit(""))


def without_appendix(title: Column) -> Column:
    return strip(_sub(title, APPENDIX_PREFIX, "", "iU"))


def is_section_number(text: Column) -> Column:
    return text.rlike("(?iU)" + SECTION_NUMBER)


def is_letterspaced(text: Column) -> Column:
    return text.rlike("(?U)" + LETTERSPACED)


def is_front_matter(clean: Column) -> Column:
    return clean.rlike("(?U)" + FRONT_MATTER)


def is_main_start(clean: Column) -> Column:
    return clean.rlike("(?iU)" + MAIN_START)


def has_trailing_number(line: Column) -> Column:
    return line.rlike("(?U)" + TRAILING_NUMBER)


def is_bold(font: Column, flags: Column) -> Column:
    by_flag = F.coalesce(flags, F.lit(0)).bitwiseAND(BOLD_FLAG) != 0
    return by_flag | F.lower(F.coalesce(font, F.lit(""))).contains("bold")


def is_heading(text: Column, size: Column, bold: Column, body_size: Column, ratio: Column | float) -> Column:
    """Size, weight or numbering make a heading candidate of a text of 3 to 200 characters."""
    t = strip(F.coalesce(text, F.lit("")))
    size, body = F.coalesce(size, F.lit(0.0)), F.coalesce(body_size, F.lit(0.0))
    ratio = F.lit(ratio) if isinstance(ratio, float) else ratio
    looks = ((body > 0) & (size >= body * ratio)) | (bold & (body > 0) & (size >= body))
    return F.length(t).between(HEADING_MIN, HEADING_MAX) & (looks | is_section_number(t) | is_letterspaced(t))


def is_toc_like(stripped: Column) -> Column:
    keep = has_trailing_number(stripped) | is_section_number(stripped) | (F.length(stripped) < SHORT_LINE)
    return (stripped != "") & keep


def toc_like_lines(text: Column) -> Column:
    """The lines of a page that may belong to a printed table of contents, joined again."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), is_toc_like)
    return F.array_join(lines, "\n")


def _contains_ratio(one: Column, other: Column) -> Column:
    """Of two normal forms: the shorter has 8 characters, lies in the longer, and is half of it."""
    short, long = F.least(F.length(one), F.length(other)), F.greatest(F.length(one), F.length(other))
    return (short >= FUZZY_MIN) & (other.contains(one) | one.contains(other)) & (short / long >= FUZZY_RATIO)


def titles_match(one: Column, other: Column) -> Column:
    """Of two normal forms: equal or, to at least half, one in the other; both 8 characters long."""
    enough = (F.length(one) >= FUZZY_MIN) & (F.length(other) >= FUZZY_MIN)
    return enough & ((one == other) | _contains_ratio(one, other))


def heading_matches(title: Column, norm: Column, norm_without: Column, cand_norm: Column, cand_title: Column) -> Column:
    """Whether a text (its normal forms cand_norm, cand_title) is the heading of a title.

    norm and norm_without are the title's normal form with and without an appendix prefix.
    """

    def found(needle: Column) -> Column:
        short, long = F.least(F.length(needle), F.length(cand_norm)), F.greatest(F.length(needle), F.length(cand_norm))
        back = (short >= FUZZY_MIN) & needle.contains(cand_norm) & (short / long >= FUZZY_RATIO)
        return (F.length(needle) >= HEADING_MIN) & (cand_norm.contains(needle) | back)

    prefix = section_prefix(title)
    return (F.length(cand_norm) >= HEADING_MIN) & (found(norm) | found(norm_without)) & (prefix.isNull() | cand_title.contains(prefix))


def round_exact(x: Column, decimals: int) -> Column:
    """Half-even rounding of the exact binary value, as Python's round() does.

    200 * x (or 20 * x) is split into two exact products; the sign of its distance to
    the halfway point decides. For magnitudes below 2**20.
    """
    scale = 10**decimals
    big = x * F.lit(134217729.0)
    high = big - (big - x)
    low = x - high
    whole = F.floor(x * F.lit(float(scale))).cast("double")
    off = (high * F.lit(2.0 * scale) - (whole * 2 + 1)) + low * F.lit(2.0 * scale)
    up = (off > 0) | ((off == 0) & (F.pmod(whole, F.lit(2.0)) == 1))
    return (whole + F.when(up, 1.0).otherwise(0.0)) / F.lit(float(scale))


def format_size(size: Column) -> Column:
    """14.0 as 14, 12.5 as 12.5."""
    tenths = F.round(round_exact(size, 1) * 10).cast("long")
    shown = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"))
    return F.when(size == F.floor(size), size.cast("long").cast("string")).otherwise(shown)


def format_y(y: Column) -> Column:
    """A rounded position without its leading zero: .12, .00, 1.00."""
    n = F.round(y * 100).cast("long")
    text = F.concat(F.floor(F.abs(n) / 100).cast("string"), F.lit("."), F.lpad(F.pmod(F.abs(n), F.lit(100)).cast("string"), 2, "0"))
    return F.when(n < 0, F.concat(F.lit("-"), text)).otherwise(F.regexp_replace(text, "^0+", ""))


def format_confidence(value: Column) -> Column:
    n = F.round(round_exact(value, 2) * 100).cast("long")
    return F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad(F.pmod(n, F.lit(100)).cast("string"), 2, "0"))


def proxy_tokens(text: Column) -> Column:
    """Stand-in for a tokenizer's count where its vocabulary is not at hand: a quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / F.lit(4.0)).cast("long")
