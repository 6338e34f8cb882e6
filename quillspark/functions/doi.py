"""DOI functions as Column expressions; nothing here leaves the JVM.

Semantics that must equal the reference's are listed as fixed values below; everything else is built from them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------------------------
#: A DOI inside running text.
DOI_PATTERN = r"10\.\d{4,9}/[-A-Za-z0-9._;()/:]+"
#: The full-width yen sign stands for the slash in file names.
SLASH_STAND_IN = "￥"
#: Characters deleted before a DOI is looked for: zero-width, soft hyphen, direction marks and separators.
INVISIBLE = "​‌‍﻿­‎‏  "
#: A blank after DOI punctuation and before a DOI character.
SPLICE = r"(?<=[/\-._;():])\s(?=[-A-Za-z0-9._;()/:])"
#: A blank after a DOI's dot or slash, before a part with a dot in it; and one before a part with a digit in it.
GAP_BEFORE_PART = r"(?i)(10\.\d{4,9}/[-A-Za-z0-9._;()/:]+)([./])\s+([-A-Za-z0-9]{2,}\.[-A-Za-z0-9._;()/:]+)"
GAP_BEFORE_DIGIT = r"(?i)(10\.\d{4,9}/[-A-Za-z0-9._;()/:]*?)[ \t]+(?=[-A-Za-z0-9._;()/:]*\d)([-A-Za-z0-9._;()/:]+)"
#: What ends a DOI without belonging to it.
IDENTIFIER_TAIL = r"(?i)\.?\(?(?:PMID|PMCID):?\s*\d+\)?\.?$"
YEAR_OR_DOTS_TAIL = r"\(\d{4}\)\.?$|\.+$"
TRAILING = "。,， \t\n;：:"
#: Characters a file name must not hold.
UNSAFE = '\\:*?"<>|'
#: Dashes written as a hyphen; with the horizontal bar, in citations.
DASHES = "‐‑–—"
CITATION_DASHES = "‐‑–—―"
# ----------------------------------------------------------------------------------------------------------------


def doi_all(text: Column) -> Column:
    """All DOIs of ``text`` in order, repeats kept (null for null)."""
    return F.regexp_extract_all(text, F.lit(DOI_PATTERN), F.lit(0))


def doi_first(text: Column) -> Column:
    """The first DOI of ``text``; null if there is none."""
    return F.nullif(F.regexp_extract(text, DOI_PATTERN, 0), F.lit(""))


def is_plausible(doi: Column) -> Column:
    """False for a DOI whose suffix consists of letters only."""
    return ~doi.rlike(r"^10\.\d{4,9}/[A-Za-z]+$")


def plausible_dois(text: Column) -> Column:
    return F.filter(doi_all(text), is_plausible)


def is_safe_name(name: Column) -> Column:
    """True for a file name that is the safe form of a DOI; its complement is a "special" name."""
    return name.rlike(rf"(?i)^10\.\d{{4,9}}{SLASH_STAND_IN}[-A-Za-z0-9._;()/:]+")


def normalize_dashes(text: Column) -> Column:
    return F.translate(text, DASHES, "-" * len(DASHES))


def citation_dashes(text: Column) -> Column:
    return F.translate(text, CITATION_DASHES, "-" * len(CITATION_DASHES))


def smart_quotes(text: Column) -> Column:
    """Typographic quotes and the two long dashes become plain ones, the ellipsis three dots."""
    return F.replace(F.translate(text, "“”‘’–—", "\"\"''--"), F.lit("…"), F.lit("..."))


def _closed(text: Column) -> Column:
    text = F.regexp_replace(text, GAP_BEFORE_PART, "$1$2$3")
    return F.regexp_replace(text, GAP_BEFORE_DIGIT, "$1$2")


def repair_text(text: Column) -> Column:
    """Rejoin DOIs that blanks or invisible characters have split, until nothing is left to close.

    A round closes a gap of every DOI, so there are at most as many rounds as blanks; once a round has changed nothing, the
    others are not worked out. Text without a DOI takes no round at all.
    """
    start = F.regexp_replace(F.translate(text, INVISIBLE, ""), SPLICE, "")

    def one(acc: Column, _: Column) -> Column:
        again = F.struct(_closed(acc["text"]).alias("text"), (_closed(acc["text"]) == acc["text"]).alias("done"))
        return F.when(acc["done"], acc).otherwise(again)

    def run(s: Column) -> Column:
        rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.regexp_count(s, F.lit(r"\s"))))
        return F.aggregate(rounds, F.struct(s.alias("text"), F.lit(False).alias("done")), one)["text"]

    return bound(start, lambda s: F.when(s.rlike(r"10\.\d{4,9}/\S*\s"), run(s)).otherwise(s))


def bound(value: Column, make) -> Column:
    """``make(value)`` with the value worked out once, however often ``make`` uses it."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def strip_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def canonical(raw: Column) -> Column:
    """``struct(doi, safe)``: the DOI without appended URL, identifier, year and punctuation, and its file name."""
    s = F.regexp_replace(strip_blanks(raw), r"(?s)https?://.*$", "")
    s = F.regexp_replace(F.regexp_replace(s, IDENTIFIER_TAIL, ""), YEAR_OR_DOTS_TAIL, "")
    s = F.rtrim(strip_blanks(s), F.lit(TRAILING))
    s = bound(s, lambda x: F.when(x.rlike("[（(]"), x).otherwise(F.regexp_replace(x, r"(?d)[)）].*", "")))
    return bound(s, lambda x: F.struct(x.alias("doi"), _safe_name(x).alias("safe")))


def _safe_name(doi: Column) -> Column:
    safe = F.translate(F.replace(doi, F.lit("/"), F.lit(SLASH_STAND_IN)), UNSAFE, "")
    safe = F.regexp_replace(safe, rf"(?U)[{SLASH_STAND_IN}_\s]+", SLASH_STAND_IN)
    safe = F.substring(F.btrim(safe, F.lit(f"{SLASH_STAND_IN}-_ ")), 1, 200)
    # an empty safe form gets a name that is the same in every run
    return F.when(safe == "", F.concat(F.lit("doi-"), F.lower(F.hex(F.crc32(doi.cast("binary")))))).otherwise(safe)


def key_of_entry(raw: Column) -> Column:
    """Join key of the DOI a list entry carries: first DOI, stand-in slash read as slash, without the punctuation
    that follows it, in lower case; null if the entry carries none."""
    # no part is named twice: within a list nothing would keep it from being worked out twice
    found = F.get(F.regexp_extract_all(F.translate(raw, SLASH_STAND_IN, "/"), F.lit(DOI_PATTERN), F.lit(0)), F.lit(0))
    return F.lower(F.regexp_replace(found, r"^([^(]*?)[.;:/)]+$|[.;:/]+$", "$1"))


def doi_from_doi_line(text: Column) -> Column:
    """Canonical DOI of the first line that begins with ``doi:`` and holds one."""
    lines = F.filter(F.split(text, "\r?\n"), lambda x: x.rlike(r"(?i)^\s*doi:") & x.rlike(DOI_PATTERN))
    return canonical(doi_first(F.get(lines, F.lit(0))))["doi"]
