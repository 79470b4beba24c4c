"""String and term functions. Null is "unbound" or an error, and stays null."""

from __future__ import annotations

import re
from urllib.parse import urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Regex flags of XPath and their Java letters; ``q`` takes the pattern as plain text.
REGEX_FLAGS = {"i": "i", "s": "s", "m": "m", "x": "x", "q": ""}


def _pattern(pattern: str, flags: str) -> str:
    if not set(flags) <= set(REGEX_FLAGS):
        raise ValueError(f"unknown flags {flags!r}")
    if "q" in flags:
        pattern = re.escape(pattern)
    known = "".join(REGEX_FLAGS[f] for f in flags if f in "ism" or (f == "x" and "q" not in flags))
    return f"(?{known}){pattern}" if known else pattern


def regex(text: Column, pattern: str, flags: str = "") -> Column:
    return text.rlike(_pattern(pattern, flags))


def replace(text: Column, pattern: str, with_: str, flags: str = "") -> Column:
    return F.regexp_replace(text, _pattern(pattern, flags), with_)


def substr(text: Column, start: int, length: int | None = None) -> Column:
    """1-based; a start under 1 shortens the result, as in XPath."""
    end = None if length is None else start + length
    start = max(start, 1)
    size = F.lit(2**31 - 1) if end is None else F.lit(max(end - start, 0))
    return F.substring(text, F.lit(start), size)


def strbefore(text: Column, part: str) -> Column:
    """What precedes the first occurrence; empty if there is none."""
    at = F.locate(part, text)
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).when(text.isNotNull(), F.lit(""))


def strafter(text: Column, part: str) -> Column:
    at = F.locate(part, text)
    return F.when(at > 0, F.substring(text, at + len(part), F.length(text))).when(text.isNotNull(), F.lit(""))


def encode_for_uri(text: Column) -> Column:
    """Percent-encoding that leaves letters, digits and ``- . _ ~``."""
    out = F.url_encode(text)
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def langmatches(tag: Column, wanted: str) -> Column:
    """Basic filtering of RFC 4647; ``*`` matches any tag that is not empty."""
    if wanted == "*":
        return tag != ""
    low = F.lower(tag)
    return (low == wanted.lower()) | low.startswith(wanted.lower() + "-")


def is_iri(text: Column) -> Column:
    """The heuristic for columns that hold IRIs and other strings."""
    return text.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*://\S+|urn:\S+|mailto:\S+)$")


def is_blank(text: Column) -> Column:
    return text.startswith("_:")


def is_literal(value: Column, spark_type: str = "string") -> Column:
    """Whether a bound value is a literal: neither an IRI nor a blank node by its form."""
    if spark_type != "string":
        return F.when(value.isNotNull(), F.lit(True))
    return ~is_iri(value) & ~is_blank(value)


def is_numeric(value: Column, spark_type: str) -> Column:
    """Whether a bound value is a number: of a numeric type, and text never."""
    numeric = spark_type.startswith("decimal") or spark_type in ("tinyint", "smallint", "int", "bigint", "float", "double")
    return F.when(value.isNotNull(), F.lit(numeric))


def lang(literal: Column, tag: Column | None = None) -> Column:
    """The language tag: the column that holds it, or empty where literals carry none."""
    return F.when(literal.isNotNull(), F.lit("") if tag is None else F.coalesce(tag, F.lit("")))


def strdt(lexical: Column, datatype_iri: str) -> Column:
    """A typed literal as ``struct<value, datatype>``; the lexical form is kept as it is."""
    typed = F.struct(lexical.cast("string").alias("value"), F.lit(datatype_iri).alias("datatype"))
    return F.when(lexical.isNotNull(), typed)


def strlang(lexical: Column, tag: str) -> Column:
    """A tagged literal as ``struct<value, lang>``."""
    return F.when(lexical.isNotNull(), F.struct(lexical.cast("string").alias("value"), F.lit(tag).alias("lang")))


def iri(text: Column | str, base: str = "") -> Column:
    """An IRI of a string. A constant is resolved against the base; in a column
    absolute IRIs stay and others are put behind the base's last ``/``."""
    if isinstance(text, str):
        return F.lit(urljoin(base, text))
    folder = base[: base.rfind("/") + 1]
    return F.when(text.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), text).otherwise(F.concat(F.lit(folder), text)) if base else text.cast("string")


def bnode(label: Column | None = None) -> Column:
    """A blank node that depends on the label alone; without one a new one for each row."""
    if label is None:
        return F.concat(F.lit("_:u"), F.replace(F.uuid(), F.lit("-"), F.lit("")))
    return F.concat(F.lit("_:b"), F.md5(label.cast("binary")))


#: XSD type of a Spark type.
DATATYPES = {
    "boolean": "boolean", "tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer",
    "float": "float", "double": "double", "date": "date", "timestamp": "dateTime", "timestamp_ntz": "dateTime", "string": "string",
    "binary": "base64Binary",
}
XSD = "http://www.w3.org/2001/XMLSchema#"


def datatype(value: Column, spark_type: str) -> Column:
    """The datatype IRI of a literal column of a known Spark type."""
    name = "decimal" if spark_type.startswith("decimal") else DATATYPES.get(spark_type)
    if name is None:  # arrays, maps and structs are no literals
        return F.lit(None).cast("string")
    return F.when(value.isNotNull(), F.lit(XSD + name))


def to_str(value: Column, spark_type: str) -> Column:
    """Lexical form; timestamps in ISO 8601."""
    if spark_type.startswith("timestamp"):
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    return value.cast("string")


def same_term(a: Column, b: Column) -> Column:
    """Equal values of one type; null if either is unbound."""
    return F.when(a.isNotNull() & b.isNotNull(), a.eqNullSafe(b))


def if_(condition: Column, yes: Column, no: Column) -> Column:
    """Null if the condition is."""
    return F.when(condition, yes).when(~condition, no)
