"""Column functions on text. All are built-in expressions and stay in the JVM."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ideographs and Latin letters that count as readable text on a page (fixed value).
READABLE = r"[A-Za-z\x{4e00}-\x{9fff}]"
#: Lines that are a placeholder by themselves (fixed values).
PLACEHOLDERS = ["TODO", "TBD", "待补充", "略", "同上"]

_ND = [chr(c) for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
#: Decimal digits beyond ASCII and what each counts, built by rule.
_DIGITS = ("".join(_ND), "".join(str(unicodedata.decimal(c)) for c in _ND))


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def compact(c: Column) -> Column:
    """Lower case without any white space; the form in which text is searched."""
    return F.regexp_replace(F.lower(c), r"(?U)\s+", "")


def readable_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(READABLE))


#: An HTML comment; one that isn't closed goes to the end of the text.
COMMENT = r"(?s)<!--.*?(?:-->|\z)"


def without_comments(c: Column) -> Column:
    """HTML comments removed; one that isn't closed goes to the end of the text."""
    return F.regexp_replace(c, COMMENT, "")


def blanked_comments(c: Column) -> Column:
    """Comments as spaces, sign by sign; line feeds stay, so that every place keeps its line and offset."""
    hidden = F.transform(F.regexp_extract_all(c, F.lit(COMMENT), F.lit(0)), lambda m: F.regexp_replace(m, r"[^\n]", " "))
    return F.array_join(F.zip_with(F.split(c, COMMENT), hidden, lambda t, h: F.concat(t, F.coalesce(h, F.lit("")))), "")


def section(c: Column, title: str) -> Column:
    """What stands under the heading '## title' of a text, up to the next '## '; of several the last counts."""
    found = F.regexp_extract_all(c, F.lit(rf"(?dmU)^## [^\S\n]*{title}\s*$([\s\S]*?)(?=^## [^\n]|\z)"), F.lit(1))
    return F.try_element_at(found, F.lit(-1))


def shingles(c: Column, n: int) -> Column:
    """Runs of n characters; none of a shorter text."""
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def tokens(c: Column) -> Column:
    """Search tokens of a text: words, runs of two or more ideographs, and runs of four characters
    of the compact form. Null gives an empty array."""
    t = compact(F.coalesce(c, F.lit("")))
    words = F.regexp_extract_all(t, F.lit(r"[a-z0-9_]+|[\x{4e00}-\x{9fff}]{2,}"), F.lit(0))
    return F.array_distinct(F.concat(words, shingles(t, 4)))


def substantive(c: Column) -> Column:
    """Number of characters of a Markdown text that carry content: no headings, comments, bullets,
    markup signs or template variables."""
    lines = F.split(blanked_comments(F.coalesce(c, F.lit(""))), "\n")
    kept = F.filter(lines, lambda l: ~l.rlike(r"^#{1,6}[ \t]+[^\n]"))

    def clean(l: Column) -> Column:
        l = F.regexp_replace(l, r"^\s*(?:[-*+]\s+|\d+[.)、]\s*)", "")
        l = F.regexp_replace(l, r"[`*_>#|]", "")
        return strip(F.regexp_replace(l, r"\$\{[^{}\n]+\}", ""))

    return F.aggregate(kept, F.lit(0), lambda a, l: a + F.length(clean(l)))


def placeholder_line(l: Column) -> Column:
    """The line's bare text in lower case, after quote, heading, bullet, check box, end mark and wrappers."""
    v = strip(l)
    # What may stand before and around a placeholder.
    for pattern in (r"^(?:>\s*)+", r"^#{1,6}\s+", r"^(?:[-*+]|\d+[.)、])\s+", r"^\[[ xX]\]\s+"):
        v = F.regexp_replace(v, pattern, "")
    v = strip(F.regexp_replace(v, r"[。；;]+$", ""))
    for mark in (r"\*\*", "__", "`"):
        v = strip(F.regexp_replace(v, f"^{mark}(.+){mark}$", "$1"))
    return F.lower(v)


def is_absolute_locator(c: Column) -> Column:
    """file: URIs, POSIX, drive and UNC paths."""
    return c.rlike(r"^(?i:file:)|^/|^[A-Za-z]:[\\/]|^\\\\")


def escapes_root(c: Column) -> Column:
    """A component '..' before a fragment."""
    path = F.translate(F.element_at(F.split(c, "#"), 1), "\\", "/")
    return F.array_contains(F.split(path, "/"), "..")


def embeds_host_path(c: Column) -> Column:
    """A file URI, drive, UNC or POSIX path anywhere in a value that is meant for a log."""
    return c.rlike(r"(?i:file:)[\\/]|(?<![A-Za-z0-9])[A-Za-z]:[\\/]|(?<![\\/:])(?:\\\\|//)[^\\/\s]|(?<![A-Za-z0-9_\x{3400}-\x{9fff}/:.-])/(?!/)[^\s'\">)\]]")


def field_values(text: Column, aliases: list[str]) -> Column:
    """Values of the lines 'alias: value' of a text, with or without bullet and bold marks; where nothing stands
    behind the colon, the next line that is not blank is the value."""
    names = "|".join(a.replace(".", r"\.") for a in aliases)
    return F.regexp_extract_all(text, F.lit(rf"(?mdU)^\s*(?:[-*+]\s*)?(?:\*\*)?(?:{names})(?:\*\*)?\s*[：:]\s*(\S.*)$"), F.lit(1))


def heading_name(title: Column) -> Column:
    """A heading's title without marks of emphasis and its outer brackets."""
    return strip(F.regexp_replace(strip(F.regexp_replace(title, "[*_`]+", "")), "^【|】$", ""))


def digits(c: Column) -> Column:
    """Decimal digits of every script as ASCII."""
    return F.translate(c, *_DIGITS)


def fenced_json(c: Column) -> Column:
    """The one JSON object in a ```json fence of a text; null where there is none, or more than one."""
    found = F.regexp_extract_all(c, F.lit(r"(?sU)```json\s*(\{.*?\})\s*```"), F.lit(1))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def zoned_time(c: Column) -> Column:
    """An ISO date and time that names its zone, as a timestamp; null for any other text."""
    v = F.regexp_replace(strip(c), " ", "T")
    form = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,6})?)?(?:Z|[+-]\d{2}(?::?\d{2})?)$"
    v = F.when(v.rlike(form), F.regexp_replace(F.regexp_replace(v, ",", "."), r"([+-]\d{2})(\d{2})?$", "$1:$2"))
    whole = F.regexp_replace(F.regexp_replace(v, r"T(\d{2}:\d{2})(?=Z|[+-])", "T$1:00"), r":$", ":00")
    return F.try_to_timestamp(whole)


def suffix(c: Column) -> Column:
    """Lower-case file suffix with its dot, or an empty string."""
    return F.lower(F.regexp_extract(c, r"[^/\\.](\.[^./\\]+)$", 1))


def normal_identifier(c: Column) -> Column:
    """The trimmed identifier, or null where it is blank or holds control or format characters."""
    v = strip(c)
    return F.when((v != "") & ~c.rlike(r"\p{C}"), v)


def last_number(name: Column) -> Column:
    """The last run of digits of a name as a number; null where there is none. Names sort by it, then by themselves."""
    return F.regexp_extract(name, r"^.*?(\d+)\D*$", 1).try_cast("bigint")


def json_safe(c: Column) -> Column:
    """Whether a text is JSON with finite numbers whose keys and values name no path of a host; null stays null."""
    strings = F.regexp_extract_all(c, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))
    plain = lambda v: F.regexp_replace(F.regexp_replace(v, r"\\/", "/"), r"\\\\", r"\\")
    return F.when(c.isNotNull(), F.try_parse_json(c).isNotNull() & ~F.exists(strings, lambda v: embeds_host_path(plain(v))))
