"""Markdown and extracted page text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------------------------
#: A line that ends in one of these ends its sentence.
SENTENCE_END = ".。!！?？:：;；)）]】-—"
NUMBERED_HEADING = r"^[\d.]+\s+\w"
SECTION_HEADING = r"(?i)^(Abstract|Introduction|Methods?|Results?|Discussion|Conclusion|References?|Acknowledgments?|Supplementary|Appendix)"
#: Headings that are no title.
NO_TITLE = r"(?i)^(authors?|abstract|introduction|methods?|results?|discussions?|conclusions?|references?|background|keywords?|acknowledg?ments?|summary|materials?|supplementary|appendix)[\s:：]"
REFERENCE_ENTRY = r"(?m)^\s*(?:\[\d+\]|\d+\.)\s+(.*)$"
IMAGE = r"!\[[^\]]*\]\(([^)]+)\)"
#: Images whose address does not begin so lose their text; an image within a link; tags that converters leave behind.
KEPT_IMAGES = ["images/", "https://", "C:/"]
CLICKABLE_IMAGE = r"(?i)\[\s*((?:!\[[^\]]*\]\([^)]+\)|!\([^)]+\))[^\]]*?)\]\s*\(([^)]+)\)"
ARTIFACT_TAGS = r"(?i)</?(?:lcel|nl)>"
#: An image of a vault that is copied with a note: what stands before its address, and its name.
COPIED_IMAGE = r"(?i)(!\[[^\]]*\])\((?:[A-Z]:[\\/].*?images|\.\.[\\/]images)[\\/]([a-f0-9]+\.(?:jpg|png|jpeg|gif))\)"
URL = r"https?://[^\s<>\"')\]]+"
# ----------------------------------------------------------------------------------------------------------------


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def merged_paragraphs(text: Column) -> Column:
    """Lines put together to paragraphs.

    A line goes on in the next one if it does not end a sentence, ends in a hyphen (which is dropped), or the next one
    begins with a small letter. That depends on two neighbouring lines only, so every line can be given what follows it
    at once, without a loop.
    """
    rows = F.transform(lines(text), lambda x, i: F.when(i == 0, F.rtrim(x)).otherwise(F.trim(x)))

    def with_end(x: Column, i: Column) -> Column:
        following = F.get(rows, i + 1)
        ends = F.contains(F.lit(SENTENCE_END), F.right(x, F.lit(1)))
        goes_on = (x != "") & (following != "") & (~ends | following.rlike(r"^\p{Ll}") | x.endswith("-"))
        return F.when(following.isNull(), x).when(goes_on & x.endswith("-"), F.left(x, F.length(x) - 1)).when(goes_on, F.concat(x, F.lit(" "))).otherwise(F.concat(x, F.lit("\n")))

    return F.array_join(F.transform(rows, with_end), "")


def is_heading(line: Column) -> Column:
    letters = F.length(F.regexp_replace(line, r"\P{L}", ""))
    capitals = (F.upper(line) == line) & (F.lower(line) != line)
    return line.rlike(NUMBERED_HEADING) | ((F.length(line) < 80) & capitals & (letters > 3)) | line.rlike(SECTION_HEADING)


def promoted_headings(text: Column) -> Column:
    """Heading lines without a ``#`` get two."""

    def promoted(x: Column) -> Column:
        s = F.trim(x)
        return F.when(is_heading(s) & ~s.startswith("#"), F.concat(F.lit("## "), s)).otherwise(x)

    return F.array_join(F.transform(lines(text), promoted), "\n")


def table_markdown(rows: Column) -> Column:
    """An array of rows of cells as a Markdown table: padded, trimmed, with a rule after the first row; empty if no cell
    has content."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    cell = lambda c: F.coalesce(F.trim(F.replace(c, F.lit("\n"), F.lit(" "))), F.lit(""))
    padded = lambda r: F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), (width - F.size(r)).cast("int")))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    out = F.transform(rows, lambda r: line(padded(r)))
    rule = line(F.array_repeat(F.lit("---"), width))
    some = F.exists(F.flatten(rows), lambda c: cell(c) != "")
    whole = F.concat(F.slice(out, 1, 1), F.array(rule), F.slice(out, F.lit(2), F.greatest(F.size(out) - 1, F.lit(0))))
    return F.when(some, F.concat(F.array_join(whole, "\n"), F.lit("\n"))).otherwise("")


def first_title(text: Column, fallback: Column) -> Column:
    """First level-one heading that is no section's, else the first one, else ``fallback``."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^#[ \t]+(.+)$"), F.lit(1)), lambda x: F.trim(x))
    return F.coalesce(F.get(F.filter(found, lambda x: ~x.rlike(NO_TITLE)), F.lit(0)), F.get(found, F.lit(0)), fallback)


def urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({URL})"), F.lit(1))


def local_images(text: Column) -> Column:
    """Names of the images of the vault that a text shows."""
    links = F.transform(F.regexp_extract_all(text, F.lit(IMAGE), F.lit(1)), lambda x: F.replace(x, F.lit("\\"), F.lit("/")))
    own = F.filter(links, lambda x: ~x.rlike("^https?://") & (F.contains(x, F.lit("Vault/IMAGE")) | F.contains(x, F.lit("/images/")) | x.startswith("images/")))
    return F.array_distinct(F.transform(own, lambda x: F.substring_index(x, "/", -1)))


def fixed_images(text: Column) -> Column:
    """Image links in their one form: addresses without blanks around and with a protocol; only some keep their text."""
    s = F.regexp_replace(text, r"!\[([^\]]*)\]\(\s*([^)]*?)\s*\)", "![$1]($2)")
    s = F.regexp_replace(s, r"!\[([^\]]*)\]\(//([^)]*)\)", "![$1](https://$2)")
    kept = "|".join(KEPT_IMAGES)
    return F.regexp_replace(s, rf"!\[[^\]]*\]\((?!{kept})([^)]*)\)", "!($1)")


def without_artifacts(text: Column) -> Column:
    """Without converters' tags, images in their one form, none within a link (what stands behind it in the link is kept)."""
    return F.regexp_replace(fixed_images(F.regexp_replace(text, ARTIFACT_TAGS, "")), CLICKABLE_IMAGE, "$1($2)")


def copied_images(text: Column) -> Column:
    """Names of the images that are copied with a note."""
    return F.regexp_extract_all(text, F.lit(COPIED_IMAGE), F.lit(2))


def readdressed_images(text: Column, to: str) -> Column:
    return F.regexp_replace(text, COPIED_IMAGE, f"$1({to}$2)")


def moved_images(text: Column, to: str) -> Column:
    return F.replace(text, F.lit("](images/"), F.lit(f"]({to}"))


def reference_section(text: Column) -> Column:
    """The text from the heading of the references on (the Chinese heading first), or null."""
    low = F.lower(text)
    zh, en = F.instr(low, "# 参考文献"), F.instr(low, "# reference")
    at = F.when(zh > 0, zh).when(en > 0, en)
    return F.substring(text, at, F.length(text))


def reference_entries(text: Column) -> Column:
    """Numbered entries of the reference section, without trailing dots and blanks."""
    return F.transform(F.regexp_extract_all(reference_section(text), F.lit(REFERENCE_ENTRY), F.lit(1)), lambda x: F.rtrim(x, F.lit(". \t")))


def reference_list(items: Column) -> Column:
    """The section made of a list of entries; empty ones use up a number but are left out."""
    numbered = F.filter(F.transform(items, lambda x, i: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x))), lambda x: x.isNotNull())
    return F.concat(F.lit("## 参考文献\n\n"), F.array_join(numbered, "\n"))


def without_lines(text: Column, word: Column) -> Column:
    """``struct(body, removed)``: the text without the lines that hold ``word``."""
    rows = lines(text)
    kept = F.filter(rows, lambda x: ~F.contains(x, word))
    return F.struct(F.array_join(kept, "\n").alias("body"), (F.size(rows) - F.size(kept)).alias("removed"))
