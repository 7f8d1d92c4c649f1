"""Column functions on identifiers, attributes and escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that an attribute value can't hold, and their escapes, '%' first.
GFF_ESCAPES = (("%", "%25"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D"), (";", "%3B"), ("=", "%3D"), ("&", "%26"), (",", "%2C"))
GML_ESCAPES = (("\\", "\\\\"), ('"', '\\"'))
HTML_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def _replaced(text: Column, pairs) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def gff_escape(text: Column) -> Column:
    return _replaced(text, GFF_ESCAPES)


def gml_escape(text: Column) -> Column:
    return _replaced(text, GML_ESCAPES)


def gml_unescape(text: Column) -> Column:
    """A backslash before a quote or another backslash goes; others stay."""
    return F.regexp_replace(text, r'\\([\\"])', "$1")


def html_escape(text: Column) -> Column:
    return _replaced(text, HTML_ESCAPES)


def file_safe(name: Column) -> Column:
    """Path separators and colons become underscores."""
    return F.translate(name, "/\\:", "___")


def file_stem(path: Column) -> Column:
    """The last part of a path without its last extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def attributes(text: Column) -> Column:
    """k=v;... to a map: the first '=' splits, the last key wins, a pair without '=' goes."""
    pairs = F.filter(F.split(text, ";"), lambda p: F.instr(p, "=") > 0)
    entries = F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"), F.substring(p, F.instr(p, "=") + 1, F.length(p)).alias("value")))
    last = F.aggregate(entries, F.array().cast("array<struct<key:string,value:string>>"), lambda acc, e: F.concat(F.filter(acc, lambda x: x["key"] != e["key"]), F.array(e)))
    return F.map_from_entries(last)


def pair_low(a: Column, b: Column) -> Column:
    return F.least(a, b)


def pair_high(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def ani_fraction(percent: Column) -> Column:
    return percent / 100


def path_similarity(distance: Column) -> Column:
    return 1 / (1 + distance)
