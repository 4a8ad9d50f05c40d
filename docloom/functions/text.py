"""Column expressions on text: lengths in UTF-16 units, trimming, token estimates, clean-up and contents tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space that trimming removes (all Unicode spaces and the byte order mark), markdown links, component
# tags without attributes, closed fences, titles of contents lists, extensions.
BLANK = "[\\s\\x{0B}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
LINK = "\\[([^\\]]*)\\]\\([^)]+\\)"
COMPONENT, FENCE = "</?[A-Z][a-zA-Z]*\\s*/?>", "(?s)```.*?```"
CONTENTS_TITLES = ["toc", "contents", "index"]
LEAST_TOKENS = 5


def units(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def token_estimate(text: Column) -> Column:
    """One token for each four units begun."""
    return F.ceil(units(text) / 4).cast("int")


def has_code(text: Column) -> Column:
    """A closed fence of back quotes."""
    return text.rlike(FENCE)


def without_components(text: Column) -> Column:
    """Component tags without attributes removed, blank runs closed up, ends trimmed."""
    return trimmed(F.regexp_replace(F.regexp_replace(text, COMPONENT, ""), "\n{3,}", "\n\n"))


def is_contents_list(title: Column, text: Column) -> Column:
    """A title that names a table of contents, or link markup in more than half of the text."""
    low = F.lower(title)
    linked = F.aggregate(F.regexp_extract_all(text, F.lit(LINK), F.lit(0)), F.lit(0), lambda a, x: a + units(x))
    return low.contains("table of contents") | low.isin(*CONTENTS_TITLES) | F.coalesce(linked / F.nullif(units(text), F.lit(0)) > 0.5, F.lit(False))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def document_title(front_title: Column, path: Column) -> Column:
    """The front matter's title, else the file name without a documentation extension, else Untitled."""
    stem = F.regexp_replace(file_name(path), "\\.(md|mdx|mdoc|qmd|rmd|adoc|rst)$", "")
    return F.coalesce(F.nullif(front_title, F.lit("")), F.nullif(stem, F.lit("")), F.lit("Untitled"))
