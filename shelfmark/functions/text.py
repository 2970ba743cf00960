"""Plain text out of rich formats, as a column expression."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .analysis import let

# What is dropped from a page, in this order.
SCRIPT_OR_STYLE = r"(?is)<(script|style)\b.*?</(script|style)>"
COMMENT = r"(?s)<!--.*?-->"
TAG = r"<[^>]*>"
REFERENCE = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);"

# The public named set, as the standard library has it; references end in a semicolon here. By
# first letter, as a map is searched from its start.
NAMED: dict[str, dict[str, str]] = {}
for _name, _text in html5.items():
    if _name.endswith(";"):
        NAMED.setdefault(_name[0], {})[_name[:-1]] = _text


def _literal_map(values: dict[str, str | Column]) -> Column:
    return F.create_map(*[v if isinstance(v, Column) else F.lit(v)
                          for pair in values.items() for v in pair])


def _character(code: Column) -> Column:
    """The character of a code point; none for what is not one."""
    valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(
        F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("")


def decode_references(text: Column) -> Column:
    """Character references as their letters: named ones, decimal and hexadecimal ones. An
    unknown name stays as it is."""
    names = _literal_map({first: _literal_map(some) for first, some in NAMED.items()})

    def letter(name: Column) -> Column:
        decimal = F.conv(F.substring(name, 2, 9), 10, 10).cast("bigint")
        hexadecimal = F.conv(F.substring(name, 3, 9), 16, 10).cast("bigint")
        return (F.when(name.rlike("^#[xX]"), _character(hexadecimal))
                .when(name.startswith("#"), _character(decimal))
                .otherwise(F.coalesce(
                    F.element_at(F.element_at(names, F.left(name, F.lit(1))), name),
                    F.concat(F.lit("&"), name, F.lit(";")))))

    def joined(parts: Column) -> Column:
        return F.array_join(F.transform(parts["between"], lambda part, i: F.concat(
            part, F.coalesce(let(F.get(parts["found"], i), letter), F.lit("")))), "")

    def decoded(text: Column) -> Column:
        parts = F.struct(F.split(text, REFERENCE, -1).alias("between"),
                         F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1)).alias("found"))
        return F.when(F.contains(text, F.lit("&")), let(parts, joined)).otherwise(text)

    return let(text, decoded)


def extract_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags become blanks, then character
    references become their letters."""
    for pattern in (SCRIPT_OR_STYLE, COMMENT, TAG):
        html = F.regexp_replace(html, pattern, " ")
    return decode_references(html)


def decode_text(content: Column) -> Column:
    """UTF-8 bytes as text; bytes that are not UTF-8 give null, that is no tokens."""
    return F.try_validate_utf8(content.cast("string"))
