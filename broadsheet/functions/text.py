"""Whitespace, length and truncation on Unicode text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# White space and line ends as browsers and feeds know them (Java's \s is ASCII only).
# Ranges keep the regex classes short; they are tested on every character of a text.
_RANGES = ((0x09, 0x0D), (0x20, 0x20), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029),
           (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF))


def _class(ranges) -> str:
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)


SPACE_CHARS = "".join(chr(point) for a, b in _RANGES for point in range(a, b + 1))
S = f"[{_class(_RANGES)}]"
NOT_SPACE = f"[^{_class(_RANGES)}]"
S_IN_LINE = f"[{_class(((0x09, 0x09), (0x0B, 0x0D), *_RANGES[1:]))}]"
_S_NOT_BLANK = f"[{_class((_RANGES[0], *_RANGES[2:]))}]"
LINE_CHAR = r"[^\n\r\x{2028}\x{2029}]"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal(value) -> Column:
    """Columns stay as they are, plain values become literals."""
    return value if isinstance(value, Column) else F.lit(value)


def trim_all(c) -> Column:
    return F.btrim(col(c), F.lit(SPACE_CHARS))


def squeeze(c) -> Column:
    """Collapse white-space runs to one blank and trim; single blanks are not matched, so they cost nothing."""
    return trim_all(F.regexp_replace(col(c), f" {S}+|{_S_NOT_BLANK}{S}*", " "))


def filled(c) -> Column:
    """Null for the empty string, so that ``coalesce`` skips it."""
    return F.nullif(col(c), F.lit(""))


def first_filled(*cs) -> Column:
    return F.coalesce(*[filled(c) for c in cs])


def text_or_empty(c) -> Column:
    return F.coalesce(col(c), F.lit(""))


def any_word(lowered, words) -> Column:
    """True when a lower-case text contains one of the words; much cheaper than a regex alternation."""
    lowered = col(lowered)
    result = F.lit(False)
    for word in words:
        result = result | lowered.contains(word.lower())
    return result


def utf16_length(c) -> Column:
    """Length in UTF-16 units: characters outside the basic plane count twice."""
    return F.shiftright(F.octet_length(F.encode(col(c), "UTF-16BE")), 1)


def utf16_prefix(c, units: int) -> Column:
    """First ``units`` UTF-16 units; a character cut in the middle is dropped."""
    c = col(c)
    raw = F.encode(c, "UTF-16BE")
    tail = F.hex(F.substring(raw, 2 * units - 1, 1))
    keep = F.when(tail.between("D8", "DB"), 2 * units - 2).otherwise(2 * units)
    cut = F.decode(F.substring(raw, F.lit(1), keep), "UTF-16BE")
    wide = F.octet_length(raw) != F.length(c) * 2
    return F.when(F.length(c) * 2 <= units, c).when(wide, cut).otherwise(F.substring(c, 1, units))


def shorten(c, units: int) -> Column:
    """Collapse white space and cut to ``units`` UTF-16 units with an ellipsis."""
    plain = squeeze(text_or_empty(c))
    return F.when(utf16_length(plain) <= units, plain).otherwise(
        F.concat(utf16_prefix(plain, units), F.lit("...")))


def first_match(c, pattern: str, group: int = 0) -> Column:
    """The group of the first match; null when there is no match (an empty match stays empty)."""
    return F.get(F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group)), F.lit(0))


def any_match(c, patterns) -> Column:
    """True when at least one of the patterns is found."""
    c = col(c)
    result = F.lit(False)
    for pattern in patterns:
        result = result | c.rlike(pattern)
    return result


def let(value, use) -> Column:
    """``use(value)`` with ``value`` computed once; keeps nested expressions small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def replace_each(c, pattern: str, build) -> Column:
    """Replace every match of ``pattern`` by ``build(match)``; one pass over the pieces of the text."""

    def piece(p: Column) -> Column:
        found = F.regexp_extract(p, rf"\A(?:{pattern})", 0)
        return F.when(found != "", F.concat(build(found), F.substring(p, F.length(found) + 1, F.length(p)))
                      ).otherwise(p)

    return F.array_join(F.transform(F.split(col(c), f"(?={pattern})"), piece), "")


def last_three_lines(c) -> Column:
    """The last three non-empty trimmed lines; shorter texts are only trimmed."""
    c = text_or_empty(c)
    lines = F.filter(F.transform(F.split(c, r"\r?\n"), trim_all), lambda x: x != "")
    return F.when(F.size(lines) <= 3, trim_all(c)).otherwise(
        F.array_join(F.slice(lines, -3, 3), "\n"))


def unwrap_code_fence(c) -> Column:
    """Body of the first fenced block, else the trimmed text."""
    plain = trim_all(text_or_empty(c))
    body = first_match(plain, rf"(?s)```[A-Za-z0-9_]*{S}*(.*?){S}*```", 1)
    return F.coalesce(trim_all(body), plain)


def json_object_slice(c, limit: int) -> Column:
    """Text from the first ``{`` to the last ``}``; null when missing or when the text is too long."""
    c = col(c)
    first = F.instr(c, "{")
    last = F.length(c) - F.instr(F.reverse(c), "}") + 1
    usable = (c != "") & (utf16_length(c) <= limit) & (first > 0) & c.contains("}") & (last > first)
    return F.when(usable, F.substring(c, first, last - first + 1))


def replace_all(c, pairs) -> Column:
    """Plain text replacements in the given order."""
    c = col(c)
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def split_title_body(c, fallback_title) -> tuple[Column, Column]:
    """First line as title and the rest as body; unusable titles become ``fallback_title``."""
    lines = F.split(unwrap_code_fence(c), "\n")
    title = trim_all(F.regexp_replace(
        F.regexp_replace(lines[0], rf"\A#*{S}*", ""), '"', ""))
    body = trim_all(F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), "\n"))
    units = utf16_length(title)
    bad = (units > 34) | (units < 6) | title.rlike(r"\A(今天|日报)")
    return F.when(bad, fallback_title).otherwise(title), body


def strip_front_matter(c) -> Column:
    return F.regexp_replace(
        text_or_empty(c), rf"(?s)\A---{S}*\r?\n.*?\r?\n---{S}*\r?\n", "")
