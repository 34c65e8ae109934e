"""Pieces of SQL shared by the oracle texts."""

from __future__ import annotations

SPACE = (r"[\x{9}-\x{D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]")


def literal(value: str) -> str:
    """SQL string literal; line ends become chr(10)."""
    quoted = "'" + value.replace("'", "''") + "'"
    return "(" + quoted.replace("\n", "' || chr(10) || '") + ")" if "\n" in value else quoted


def sub(x: str, pattern: str, to: str, flags: str = "g") -> str:
    return f"regexp_replace({x}, {literal(pattern)}, {literal(to)}, '{flags}')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {literal(pattern)})"


def trim(x: str) -> str:
    return sub(sub(x, f"^{SPACE}+", "", "c"), f"{SPACE}+$", "", "c")


def squeeze(x: str) -> str:
    return f"trim({sub(x, SPACE + '+', ' ')})"


def units(x: str) -> str:
    """UTF-16 length."""
    return f"(length({x}) + length({sub(x, r'[^\x{10000}-\x{10FFFF}]', '')}))"


def strip_html(x: str) -> str:
    x = sub(x, '(?i)<img[^>]*src="([^"]*)"[^>]*alt="([^"]*)"[^>]*>', r"[图片: \2 \1]")
    x = sub(x, '(?i)<img[^>]*src="([^"]*)"[^>]*>', r"[图片: \1]")
    x = sub(x, '(?i)<video[^>]*src="([^"]*)"[^>]*>.*?</video>', r"[视频: \1]")
    return squeeze(sub(x, "<[^>]+>", " "))


def strip_markdown(x: str) -> str:
    x = sub(x, r"!\[[^\]]*\]\([^)]+\)", "")
    x = sub(x, r"\[[^\]]+\]\(([^)]+)\)", "")
    return squeeze(sub(x, "[`*_>#-]", ""))


def clean_url(x: str) -> str:
    return sub(trim(x), "[),，。！？；;]+$", "", "c")


def norm_link(x: str) -> str:
    """Allow-list form of the web addresses the tables contain (ASCII, no port, no dot segments)."""
    x = sub(clean_url(x), "#.*$", "", "c")
    x = sub(x, "^(https?://[^/?#]+)([?].*)?$", r"\1/\2", "c")
    return sub(x, "/$", "", "c")


def norm_url(x: str) -> str:
    """De-duplication key of the web addresses the tables contain."""
    base = sub(x, "#.*$", "", "c")
    path = sub(sub(base, "[?].*$", "", "c"), "^(https?://[^/]+)$", r"\1/", "c")
    pairs = f"string_split(regexp_extract({base}, '[?](.*)$', 1), '&')"
    kept = f"list_filter({pairs}, lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(utm_[^=]*|fbclid|gclid|ref|ref_src)(=|$)'))"
    query = f"CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END"
    return f"lower({sub(f'({path} || {query})', '/$', '', 'c')})"


def norm_title(x: str) -> str:
    x = sub(f"lower({x})", f"https?://[^{SPACE[1:]}+", "")
    return f"trim({sub(x, r'[^\p{L}\p{N}]+', ' ')})"


def lines(x: str) -> str:
    return f"string_split({x}, chr(10))"
