"""Column expressions on version strings. Three orders coexist: full, strict three-part, plain dotted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL = "^v?([0-9]+(?:\\.[0-9]+)*)(?:-([^+]*))?(?:\\+.*)?$"


def whole_number(digits: Column) -> Column:
    """Sortable struct of a run of digits of any length: its length without leading zeros, then the digits."""
    bare = F.regexp_replace(digits, "^0+", "")
    return F.struct(F.length(bare).alias("length"), bare.alias("digits"))


def _segments(core: Column) -> Column:
    """Sortable array of all segments; last zeros are cut off, so that a missing segment counts as 0."""
    return F.transform(F.split(F.regexp_replace(core, "(?:\\.0+)+$", ""), "\\."), whole_number)


def version_key(version: Column) -> Column:
    """Sortable struct of the full order.

    An optional v and build metadata are ignored; missing segments are 0; a prerelease is below its release and is
    compared part by part, numbers below texts; labels that are no numbers are lowest; ties by the raw text.
    """
    core, pre = F.regexp_extract(version, FULL, 1), F.regexp_extract(version, FULL, 2)
    number = lambda x: x.rlike("^[0-9]+$")
    part = lambda x: F.struct((~number(x)).alias("is_text"), whole_number(F.when(number(x), x).otherwise("")).alias("num"), F.when(number(x), "").otherwise(x).alias("txt"))
    return F.struct((core != "").alias("numeric"), F.when(core != "", _segments(core)).alias("nums"), ((core != "") & (pre == "")).alias("is_release"), F.when(pre != "", F.transform(F.split(pre, "\\."), part)).alias("pre"), version.alias("raw"))


def dotted_key(version: Column) -> Column:
    """Sortable array of a plain dotted version's segments; null where a part is no number."""
    return F.when(version.rlike("^[0-9]+(\\.[0-9]+)*$"), _segments(version))


def dotted_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by the first segment in which a and b differ, missing ones as 0; null if one of the two is no number there."""
    first = F.filter(F.zip_with(F.split(a, "\\."), F.split(b, "\\."), lambda x, y: _differ(F.coalesce(x, F.lit("0")), F.coalesce(y, F.lit("0")))), lambda d: d != 0)
    found = F.get(first, F.lit(0))
    return F.when(a.isNull() | b.isNull() | (found == 2), F.lit(None).cast("int")).otherwise(F.coalesce(found, F.lit(0)))


def _differ(x: Column, y: Column) -> Column:
    """-1, 0, 1, or 2 where a segment is no number; an empty one is 0."""
    n, m = whole_number(x), whole_number(y)
    return F.when(~x.rlike("^[0-9]*$") | ~y.rlike("^[0-9]*$"), 2).when(n < m, -1).when(n > m, 1).otherwise(0)


def dotted_below(a: Column, b: Column) -> Column:
    """a < b in the plain order; false where no number decides."""
    return F.coalesce(dotted_compare(a, b) < 0, F.lit(False))


def dotted_reaches(a: Column, b: Column) -> Column:
    """a >= b in the plain order; false where no number decides."""
    return F.coalesce(dotted_compare(a, b) >= 0, F.lit(False))


def is_prerelease(version: Column) -> Column:
    """A dash or plus, or a letter after a leading x.y.z is taken away."""
    return version.rlike("[-+]") | F.regexp_replace(version, "^[0-9]+\\.[0-9]+\\.[0-9]+", "").rlike("[a-zA-Z]")


def minor_of(version: Column) -> Column:
    return F.concat_ws(".", F.slice(F.split(version, "\\."), 1, 2))


def label_of_ref(ref: Column) -> Column:
    """latest without a ref, else the ref without one leading v."""
    return F.coalesce(F.regexp_replace(ref, "^v", ""), F.lit("latest"))


def from_template(template: Column, version: Column) -> Column:
    return F.replace(template, F.lit("{version}"), version)


def strict_key(version: Column) -> Column:
    """Sortable array of a strict x.y.z release, else null."""
    return F.when(version.rlike("^[0-9]+\\.[0-9]+\\.[0-9]+$"), F.transform(F.split(version, "\\."), whole_number))


def is_tagged_prerelease(version: Column) -> Column:
    """x.y.z with something after a dash; other shapes don't count."""
    return version.rlike("^[0-9]+\\.[0-9]+\\.[0-9]+-.+$")


def tag_parts(tag: Column) -> Column:
    """(package, version) of ``@scope/pkg@v`` or ``pkg@v``, split at the first @ that is not the scope's; else a plain
    version tag, without one leading v."""
    rule = "^(@[^@]+/[^@]+|[^@]+)@(.+)$"
    named = tag.rlike(rule)
    return F.struct(F.when(named, F.regexp_extract(tag, rule, 1)).alias("package"), F.when(named, F.regexp_extract(tag, rule, 2)).otherwise(F.regexp_replace(tag, "^v", "")).alias("version"))


def version_in_tag(tag: Column, pattern: Column) -> Column:
    """The x.y.z that stands for {version} in a tag pattern, else null."""
    at = F.instr(pattern, "{version}")
    head, tail = F.substring(pattern, F.lit(1), at - 1), F.substring(pattern, at + 9, F.length(pattern))
    fits = tag.startswith(head) & tag.endswith(tail) & (F.length(tag) > F.length(head) + F.length(tail))
    middle = F.when(fits, F.substring(tag, F.length(head) + 1, F.length(tag) - F.length(head) - F.length(tail)))
    return F.when((at > 0) & middle.rlike("^[0-9]+\\.[0-9]+\\.[0-9]+$"), middle)
