"""DuckDB spellings of the text expressions, for the SQL that queries are held against."""

from __future__ import annotations

from strataleaf.functions import text as t

WORDS = r"[^\p{L}\p{M}\p{N}_\s]"
WORDS_AND_DOTS = r"[^\p{L}\p{M}\p{N}_\s\.]"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sub(expr: str, pattern: str, new: str = "", flags: str = "g") -> str:
    return f"regexp_replace({expr}, {quoted(pattern)}, {quoted(new)}, {quoted(flags)})"


def strip(expr: str) -> str:
    return sub(expr, r"^\s+|\s+$")


def squeeze(expr: str) -> str:
    return sub(expr, r"\s+", " ")


def normalize_snippet(expr: str) -> str:
    bare = f"regexp_replace({expr}, {quoted(t.LEADING_NUMBER)}, '')"
    return squeeze(strip(f"lower({sub(bare, WORDS)})"))


def normalize_title(expr: str) -> str:
    return squeeze(sub(f"lower({strip(expr)})", WORDS_AND_DOTS))


def normalize_for_restore(expr: str) -> str:
    return squeeze(strip(f"lower({sub(expr, WORDS)})"))


def normalize_front(expr: str) -> str:
    return squeeze(sub(f"lower({strip(expr)})", WORDS))


def without_appendix(expr: str) -> str:
    return strip(sub(expr, t.APPENDIX_PREFIX, flags="i"))


def matches(expr: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({expr}, {quoted(pattern)}{', ' + quoted(flags) if flags else ''})"


def section_prefix(expr: str) -> str:
    return f"nullif(regexp_extract({expr}, {quoted(t.SECTION_PREFIX)}, 1), '')"


def toc_like(expr: str) -> str:
    return f"({expr} <> '' AND ({matches(expr, t.TRAILING_NUMBER)} OR {matches(expr, t.SECTION_NUMBER, 'i')} OR length({expr}) < {t.SHORT_LINE}))"


def ratio(one: str, other: str) -> str:
    return f"(least(length({one}), length({other})) / greatest(length({one}), length({other}), 1)::DOUBLE)"


def contains_ratio(one: str, other: str) -> str:
    return f"(least(length({one}), length({other})) >= {t.FUZZY_MIN} AND (contains({other}, {one}) OR contains({one}, {other})) AND {ratio(one, other)} >= {t.FUZZY_RATIO})"


def titles_match(one: str, other: str) -> str:
    return f"(length({one}) >= {t.FUZZY_MIN} AND length({other}) >= {t.FUZZY_MIN} AND ({one} = {other} OR {contains_ratio(one, other)}))"


def heading_matches(title: str, norm: str, norm_without: str, cand: str, cand_title: str) -> str:
    def found(n: str) -> str:
        back = f"(least(length({n}), length({cand})) >= {t.FUZZY_MIN} AND contains({n}, {cand}) AND {ratio(n, cand)} >= {t.FUZZY_RATIO})"
        return f"(length({n}) >= {t.HEADING_MIN} AND (contains({cand}, {n}) OR {back}))"

    p = section_prefix(title)
    return f"(length({cand}) >= {t.HEADING_MIN} AND ({found(norm)} OR {found(norm_without)}) AND ({p} IS NULL OR contains({cand_title}, {p})))"


def round_exact(expr: str, decimals: int) -> str:
    s = 10**decimals
    high = f"(({expr}) * 134217729.0::DOUBLE - (({expr}) * 134217729.0::DOUBLE - ({expr})))"
    whole = f"floor(({expr}) * {s}.0::DOUBLE)"
    off = f"(({high} * {2 * s}.0::DOUBLE - ({whole} * 2 + 1)) + (({expr}) - {high}) * {2 * s}.0::DOUBLE)"
    return f"(({whole} + CASE WHEN {off} > 0 OR ({off} = 0 AND {whole}::BIGINT % 2 = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / {s}.0::DOUBLE)"


def format_size(expr: str) -> str:
    tenths = f"round({round_exact(expr, 1)} * 10)::BIGINT"
    return f"CASE WHEN ({expr}) = floor({expr}) THEN ({expr})::BIGINT::VARCHAR ELSE concat({tenths} // 10, '.', {tenths} % 10) END"


def format_y(expr: str) -> str:
    n = f"round(({expr}) * 100)::BIGINT"
    return f"(CASE WHEN ({expr}) IS NULL THEN NULL ELSE regexp_replace(concat({n} // 100, '.', lpad(({n} % 100)::VARCHAR, 2, '0')), '^0+', '') END)"


def is_heading(text: str, size: str, bold: str, body: str, ratio: str) -> str:
    s = strip(text)
    return (
        f"(length({s}) BETWEEN {t.HEADING_MIN} AND {t.HEADING_MAX} AND (({body} > 0 AND {size} >= {body} * {ratio}) OR ({bold} AND {body} > 0 AND {size} >= {body}) "
        f"OR {matches(s, t.SECTION_NUMBER, 'i')} OR {matches(s, t.LETTERSPACED)}))"
    )
