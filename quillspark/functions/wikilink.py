"""Wikilinks ``[[name|display]]`` as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import doi as D

#: Blanks of any kind at either end.
OUTER_BLANKS = r"^[\s\p{Z}​﻿]+|[\s\p{Z}​﻿]+$"
#: All code points read as a hyphen when two note names are compared.
DASH_CLASS = "­‐‑‒–—―⁃−﹘﹣－"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, OUTER_BLANKS, "")


def dash_key(name: Column) -> Column:
    return F.translate(name, DASH_CLASS, "-" * len(DASH_CLASS))


def split(link: Column) -> Column:
    """``struct(name, display)`` split at the first pipe; null unless both brackets and a pipe are there."""
    def parts(s: Column) -> Column:
        inner = F.regexp_extract(s, r"(?s)^\[\[(.*)\]\]$", 1)
        name, display = F.substring_index(inner, "|", 1), F.regexp_replace(inner, r"(?s)^[^|]*\|", "")
        return F.when(s.rlike(r"(?s)^\[\[.*\|.*\]\]$"), F.struct(strip(name).alias("name"), strip(display).alias("display")))

    return D.bound(strip(link), parts)


def page(link: Column) -> Column:
    """The page a link names: before any ``|`` or ``#``, without outer blanks, folder and ending ``.md``;
    null for a value without ``[[``."""
    inner = strip(F.regexp_extract(link, r"\[\[([^|#\]]*)", 1))
    leaf = strip(F.regexp_replace(inner, r"^.*/", ""))
    return F.when(F.contains(link, F.lit("[[")), strip(F.regexp_replace(leaf, r"\.md$", "")))


def make(doi: Column) -> Column:
    """Link to a DOI, the name not sanitised, trailing ``.,;:`` dropped."""
    d = F.rtrim(doi, F.lit(".,;:"))
    return F.concat(F.lit("[["), F.replace(d, F.lit("/"), F.lit(D.SLASH_STAND_IN)), F.lit("|"), d, F.lit("]]"))


def make_canonical(raw: Column) -> Column:
    return make(D.canonical(raw)["doi"])


def make_safe(raw: Column) -> Column:
    c = D.canonical(raw)
    return F.concat(F.lit("[["), c["safe"], F.lit("|"), c["doi"], F.lit("]]"))
