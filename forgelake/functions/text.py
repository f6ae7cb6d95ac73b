"""Text helpers for scraped values."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

_REFERENCE = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"


def trimmed(text: str | Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def parse_stars(text: str | Column) -> Column:
    """Whole number with optional thousands commas and outer blanks; anything else gives 0."""
    digits = trimmed(F.replace(text, F.lit(","), F.lit("")))
    return F.coalesce(F.when(digits.rlike(r"^[+-]?\d+$"), digits.try_cast("bigint")), F.lit(0).cast("bigint"))


def unescape(text: str | Column) -> Column:
    """Text with its character references decoded, each once: numbers, and the names of HTML 4.

    References that are unknown or do not end with a semicolon stay as they are.
    """
    given = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(given, F.lit(_REFERENCE), F.lit(0))

    def with_character(between: Column, i: Column) -> Column:
        reference = F.get(found, i)
        return F.concat(between, F.coalesce(_character(reference), reference, F.lit("")))

    # Each where it stands, so that what one leaves behind is not taken for another.
    decoded = F.array_join(F.transform(F.split(given, _REFERENCE), with_character), "")
    return F.when(F.contains(given, F.lit("&")), decoded).otherwise(given)


def _character(reference: Column) -> Column:
    """The character a reference stands for, NULL when there is none."""
    name = F.substring(reference, F.lit(2), F.length(reference) - 2)
    digits = F.regexp_extract(name, "^#(?:[xX]([0-9a-fA-F]{1,6})|[0-9]{1,7})$", 1)
    hexadecimal = F.when(digits != "", digits).otherwise(F.hex(F.regexp_extract(name, "^#([0-9]{1,7})$", 1).try_cast("int")))
    code = F.conv(hexadecimal, 16, 10).try_cast("bigint")
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    number = F.decode(F.unhex(F.lpad(hexadecimal, 8, "0")), "UTF-32")
    named = F.create_map(*(F.lit(x) for n, c in sorted(name2codepoint.items()) for x in (n, chr(c))))
    return F.when(name.startswith("#"), F.when(valid, number)).otherwise(F.try_element_at(named, name))


def element_text(markup: str | Column) -> Column:
    """Text of an element: tags dropped, references replaced, outer white space cut."""
    plain = unescape(F.regexp_replace(markup, r"<[^>]*>", ""))
    return trimmed(plain)


def path_parts(path: str | Column) -> Column:
    return F.split(path, "/")


def without_leading_slash(path: str | Column) -> Column:
    return F.regexp_replace(path, r"^/", "")
