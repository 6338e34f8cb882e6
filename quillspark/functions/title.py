"""Titles and file names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.doi import strip_blanks

# --- fixed values -----------------------------------------------------------------------------------------------
JUNK_TITLES = [
    "untitled", "microsoft word", "powerpoint", "slide", "slides",
    "pdf", "document", "no title", "title", "noname",
    "lippincott williams and wilkins", "lippincott williams & wilkins",
    "wolters kluwer", "springer", "elsevier",
]
STATUS_MARKERS = [
    "publish ahead of print", "advance online publication", "online ahead of print", "epub ahead of print",
    "e-pub ahead of print", "accepted manuscript", "article in press", "ahead of print", "online first",
    "early online", "just accepted", "in press",
]
DOI_IN_TITLE = r"(?i)DOI[:;\s]*10\.\d{4,9}/?[-A-Za-z0-9._;()/:]*"
AUTHOR_WITH_DEGREE = r"\s+(?:[A-Z][a-zà-ü]+(?:[-\s][A-Z][a-zà-ü]+){0,2})\s+(?:M\.?D\.?|Ph\.?D\.?|M\.?S\.?|B\.?S\.?|Sc\.?D\.?|D\.?O\.?|D\.?V\.?M\.?)(?:\s|,|$)"
MANUSCRIPT_ID = r"(?i)(?:^[A-Z]{3,}-\w-\d{2,4}-\d+|_pap\s|\.\.\d+|^Manuscript\s+ID|^MS\s*\d+)"
SOURCE_FILE = r"(?i)\.(?:qxd|indd|docx?|pptx?|ai|cdr|psd|pub|idml)\b"
ILLEGAL_IN_NAMES = '<>:"/\\|?*'
# ----------------------------------------------------------------------------------------------------------------


def _all_capitals(s: Column) -> Column:
    return (F.upper(s) == s) & (F.lower(s) != s)


def is_junk(title: Column) -> Column:
    """True for what cannot be a title: too short, a program's or publisher's name, initials, control characters."""
    low = F.lower(title)
    words = F.filter(F.split(title, r"\s+"), lambda w: w != "")
    n = F.size(words)
    single = (n == 1) & title.rlike(r"^\p{Lu}")
    initials = _all_capitals(title) & (((n <= 6) & F.forall(words, lambda w: F.length(w) <= 4)) | ((F.size(F.filter(words, lambda w: F.length(w) == 1)) >= 3) & (F.length(title) < 40)))
    bad = F.length(F.regexp_replace(title, "[^\\x00-\\x1f�]", "")) / F.length(title) > 0.3
    begins = F.lit(False)
    for j in JUNK_TITLES:
        if len(j) >= 5:
            begins = begins | low.startswith(j)
    return title.isNull() | (F.length(title) < 5) | low.isin(JUNK_TITLES) | single | initials | bad | begins


def clean(raw: Column) -> Column:
    """A title without DOI, what comes before a publication status, ``et al`` and an author with a degree."""
    s = F.regexp_replace(strip_blanks(raw), DOI_IN_TITLE, " ")
    low = F.lower(s)
    # the first marker of the list that is there decides, wherever it stands
    cut = F.coalesce(*(F.when(F.contains(low, F.lit(m)), F.instr(low, m) + len(m)) for m in STATUS_MARKERS), F.lit(1))
    s = strip_blanks(F.substring(s, cut, F.length(s)))
    s = F.regexp_replace(s, r"(?i),?\s+et\s+al\.?\s*$", "")
    s = F.regexp_replace(s, f"(?s){AUTHOR_WITH_DEGREE}.*$", "")
    return F.btrim(F.regexp_replace(s, r"\s+", " "), F.lit(" ,-"))


def from_metadata(raw: Column) -> Column:
    """The title of a document's metadata, or null if it is none."""
    s = strip_blanks(raw)
    bad = (s == "") | is_junk(s) | s.rlike(MANUSCRIPT_ID) | s.rlike(SOURCE_FILE) | (_all_capitals(s) & (F.length(s) > 20))
    c = clean(s)
    return F.when(s.isNull() | bad | (c == "") | is_junk(c), None).otherwise(c)


def file_name(title: Column, most: int = 250) -> Column:
    """The title as a file name: illegal characters dropped, at most ``most`` characters, cut at a blank if one comes
    late enough."""
    s = F.translate(F.replace(F.translate(title, "“”‘’–—", "\"\"''--"), F.lit("…"), F.lit("...")), ILLEGAL_IN_NAMES, "")
    s = strip_blanks(F.regexp_replace(s, r"(?U)\s+", " "))
    word = F.regexp_extract(F.substring(s, 1, most + 1), r"^(.*) [^ ]*$", 1)
    return F.when(F.length(s) <= most, s).when(F.length(word) > 100, word).otherwise(F.substring(s, 1, most))
