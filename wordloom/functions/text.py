"""Column expressions for text: all JVM-side built-ins, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the token pattern.  A token is a run of letters, digits or
# underscores, optionally joined by inner apostrophes (straight or curly),
# matched on lower-cased text.  Runs in Java regex (Spark) and RE2 (DuckDB)
# with identical results on the fixtures.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+(?:['’][\p{L}\p{N}_]+)*"

# Character classes of the Unicode word boundary rules (UAX 29), as
# lists of ranges.  Letters are those of \p{L} and \p{Nl} in neither of the first two.
KATAKANA = [(0x3031, 0x3035), (0x309B, 0x309C), (0x30A0, 0x30FA), (0x30FC, 0x30FF), (0x31F0, 0x31FF),
            (0x32D0, 0x32FE), (0x3300, 0x3357), (0xFF66, 0xFF9D)]
# scripts without spaces: kana, ideographs, Thai, Lao, Myanmar, Khmer, Tai
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF),
            (0x3005, 0x3007), (0x3021, 0x3029), (0x3041, 0x3096), (0x309D, 0x309F), (0x3400, 0x4DBF),
            (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]
MID_LETTER = ":\u00b7\u0387\u055f\u05f4\u2027\ufe13\ufe55\uff1a"
MID_NUMBER = ",;\u037e\u0589\u060c\u060d\u066c\u07f8\u2044\ufe10\ufe14\ufe50\ufe54\uff0c\uff1b"
MID_BOTH = "'.\u2018\u2019\u2024\ufe52\uff07\uff0e"
ZERO_WIDTH_SPACE = 0x200B

# Fixed value: the extraction pattern of the word clean-up step
# (first run of lower-case ASCII letters or apostrophes).
WORD_EXTRACT_PATTERN = r"([a-z']+)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text) -> Column:
    """Array of tokens of a text column (lower-cased, punctuation dropped)."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN_PATTERN), 0)


def _escaped(ranges) -> str:
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges)


def boundary_pattern(letter: str, unspaced: str, extend: str, possessive: str = "") -> str:
    """The pattern of one word, or of a run of connectors alone.

    The classes are given as the inside of a bracket, as engines differ in how
    they subtract; ``possessive`` is "+" where loops can be kept from giving
    back (the rules never need it, and long words then take no stack)."""
    q, ext = possessive, f"[{extend}]*{possessive}"
    mid, num = (f"[{''.join(rf'\x{{{ord(c):X}}}' for c in cs)}]" for cs in (MID_LETTER + MID_BOTH, MID_NUMBER + MID_BOTH))
    words = rf"[{letter}][{letter}{extend}]*{q}"
    digits = rf"[\p{{Nd}}][\p{{Nd}}{extend}]*{q}"
    mixed = f"(?:{words}(?:{mid}{ext}{words})*{q}|{digits}(?:{num}{ext}{digits})*{q})+{q}"
    kata = _escaped(KATAKANA)
    core = f"(?:{mixed}|[{kata}][{kata}{extend}]*{q})"
    joint = rf"[\p{{Pc}}\x{{202F}}][\p{{Pc}}\x{{202F}}{extend}]*{q}"
    chain = f"{core}(?:{joint}{core})*{q}(?:{joint})?{q}"
    return f"{chain}|{joint}(?:{chain})?{q}|[{unspaced}]{ext}"


_ANY_LETTER = r"\p{L}\p{Nl}"
BOUNDARY_PATTERN = boundary_pattern(
    rf"a-z[{_ANY_LETTER}&&[^{_escaped(KATAKANA + UNSPACED)}]]",
    rf"{_ANY_LETTER}&&[{_escaped(UNSPACED)}]",
    rf"[\p{{M}}\p{{Cf}}&&[^\x{{{ZERO_WIDTH_SPACE:X}}}]]", possessive="+")
#: a run of connectors alone is no word
NOT_A_WORD = r"^[\p{Pc}\x{202F}\p{M}\p{Cf}]*$"


def boundary_tokens(text) -> Column:
    """Array of the words of a text column by the Unicode word boundary rules
    (lower-cased): inner apostrophes, full stops and colons between letters,
    decimal and group marks between digits, combining marks and connectors stay
    inside a word; a character of a script without spaces is a word of its own
    (no dictionary is used).  The rules for Hebrew quotation marks are left out."""
    found = F.regexp_extract_all(F.lower(_c(text)), F.lit(BOUNDARY_PATTERN), 0)
    return F.filter(found, lambda w: ~w.rlike(NOT_A_WORD))


def extract_word(word) -> Column:
    """First run of ``[a-z']`` in the word, null when there is none."""
    return F.nullif(F.regexp_extract(_c(word), WORD_EXTRACT_PATTERN, 1), F.lit(""))


def unite(*cols, sep: str = "_") -> Column:
    """Join columns with ``sep``; a null part is written as the text ``NA``."""
    return F.concat_ws(sep, *[F.coalesce(_c(c).cast("string"), F.lit("NA")) for c in cols])


def separate(col, i: int, sep: str = " ") -> Column:
    """Part ``i`` (1-based) of ``col`` split at ``sep``; null when missing."""
    return F.try_element_at(F.split(_c(col), sep), F.lit(i))


def url_id(url, part: int = 5) -> Column:
    """Whole-number id in the ``part``-th '/'-separated piece of a URL (query and
    fragment cut off).

    Short URLs and non-numeric pieces give null instead of failing.
    """
    plain = F.regexp_replace(_c(url), r"[?#].*$", "")
    piece = F.try_element_at(F.split(plain, "/"), F.lit(part))
    return piece.try_cast("bigint")


def recode(col, mapping: list[tuple[str, str]]) -> Column:
    """Chained literal replacements, applied in order."""
    out = _c(col)
    for src, dst in mapping:
        out = F.replace(out, F.lit(src), F.lit(dst))
    return out


def label(prefix: str, col) -> Column:
    return F.concat(F.lit(prefix), _c(col).cast("string"))


def percent_label(col, digits: int = 2) -> Column:
    """Axis label of a share: ``0.0123`` -> ``1.23%``; null stays null."""
    v = _c(col)
    return F.when(v.isNotNull(), F.format_string(f"%.{digits}f%%", v * 100))


def sign_label(value) -> Column:
    """``positive`` / ``negative`` by sign; null stays null."""
    v = _c(value)
    return (F.when(v > 0, F.lit("positive"))
            .when(v <= 0, F.lit("negative")))


def round_half_even(col, digits: int = 0) -> Column:
    """Rounding with ties to even (0.125 -> 0.12), as R's ``round``."""
    return F.bround(_c(col), digits)


def log10_axis(col) -> Column:
    """Log10 coordinate of a positive share; null otherwise."""
    v = _c(col)
    return F.when(v > 0, F.log10(v))
