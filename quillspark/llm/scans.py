"""Noise in text from scanned pages.

Noisy-channel correction: what the words of a line were before the scanner misread them is decoded by Viterbi search over
candidate words, with probabilities of confusions that are learned from the corpus and the corpus' word bigrams (see
``channel``); Han characters are decoded alike over their look-alikes, under the corpus' characters.
Broken words are told from hyphenated ones by what stands unbroken elsewhere in the corpus. Page numbers and running
headers are lines at the edge of a page that are no sentence: numbers in their usual dress, an author line, a journal line,
capitals, or what is repeated on other pages of the note.

Words of one letter are never read otherwise, and a word in small letters is only ever read as one that the corpus has.

Defined results
    null content, tables and images: no case, left out of the text; an empty block: no case; null kinds are read as text;
    blocks delivered twice count once; blocks of one page with equal order: by identifier; blocks without a page: after the
    note's pages; very long blocks are processed whole; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import channel
from quillspark.llm.channel import WORD, Candidate, Model
from quillspark.tables import cut, once, parallel, table

#: Characters by which wrapped lines differ in length.
RAGGED = 12
_ROMAN = r"(?=[ivxlcdm])m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
PAGE_NUMBER = re.compile(rf"(?ix)^\s* (?: [-–—\[(<|·~]* \s* (?:(?:p|pp|page|pag|seite|стр|s)\.?\s*)? (?:\d{{1,5}}|{_ROMAN}) \s*(?:(?:/|of|von|de)\s*\d{{1,5}})? \s* [-–—\])>|·~]* | 第\s*\d+\s*页(?:\s*[,，/]?\s*共\s*\d+\s*页)? ) \s*$")
AUTHORS = re.compile(r"^\s*(?:\d{1,5}\s+)?\S+(?: (?:and|&|und|et) \S+)? et al[.,]?(?:\s+\S{1,5})?\s*$")
JOURNAL = re.compile(r"^\s*(?:\d{1,5}\s+)?[^\W\d][^.;:!?]{2,60}? \d\w{0,3} \([\d\w]{4}\)(?:\s+\S{1,6})?\s*$")
#: Words that a sentence has and a running title has not.
SENTENCE_WORD = re.compile(r"(?i)\b(?:the|a|an|was|were|is|are|be|been|that|which|this|these|we|our|it|its|der|die|das|wurde|wurden|le|la|les|el|los|una|fue)\b")
_CJK = re.compile("[⺀-鿿]")
_CJK_SENTENCE = re.compile("[⺀-鿿]{12}|[，。；、]")
HYPHEN_AT_END = re.compile(r"[-‐‑¬­](?:\n|$)")
BROKEN = re.compile(r"(?<![^\W\d_])([^\W\d_]++)([-‐‑¬­])(\n|$)[ \t]*([^\W\d_]*)")
STOPS = tuple(".!?。！？…:：;；\"”»)）]")


def page_furniture(line: str, edge: bool, alone: bool) -> str | None:
    """Kind of a line that belongs to the page, not to the text."""
    if PAGE_NUMBER.match(line):
        return "page number"
    if not edge:
        return None
    s = line.strip()
    if len(s) > 80:
        return None
    if AUTHORS.match(s) or JOURNAL.match(s):
        return "header"
    if s.isupper() and not s.endswith(STOPS):
        letters = [c for c in s if c.isalpha()]
        if len(letters) > 5 and all(c.isupper() for c in letters):
            return "header"
    return None


def set_apart(lines: list[str], top: bool) -> bool:
    """Whether the first (else the last) line was not made by wrapping text: what comes next had room beside it."""
    if len(lines) < 2:
        return False
    line, near = (lines[0], lines[1]) if top else (lines[-1], lines[-2])
    width = max(len(x.rstrip()) for x in (lines[1:] if top else lines[:-1]))
    upper, lower = (line.rstrip(), near.strip()) if top else (near.rstrip(), line.strip())
    if not upper or not lower:
        return False
    # Han text wraps after any character
    word = 2 if _CJK.match(lower) else 1 + len(lower.split()[0])
    room = len(upper) + word <= width
    # text wraps at a ragged edge, and a line that it breaks off in at a block's end is full, like those above it
    return (room or not top and upper.endswith(STOPS)) and len(upper if top else lower) + RAGGED <= width


def line_key(line: str) -> str:
    """A line without its numbers, to tell repeated ones."""
    return re.sub(r"[\d\W_]+", " ", line).strip().lower()


class Scanner:
    """Finds and repairs noise with what is known of the corpus."""

    def __init__(self, model: Model):
        self.model = model
        self.memo: dict[str, list[tuple[int, int, str]]] = {}

    def misread(self, line: str, more: dict[str, list[Candidate]] | None = None) -> list[tuple[int, int, str]]:
        """(start, end, what was meant) of the words of a line that were misread."""
        suspects = self.model.suspects
        words = WORD.findall(line)
        if suspects.keys().isdisjoint(words) and (not more or more.keys().isdisjoint(words)):
            return []
        found = self.model.decode(words, more)
        if not found:
            return []
        return [(*m.span(), found[i]) for i, m in enumerate(WORD.finditer(line)) if i in found]

    def mended(self, line: str, more: dict[str, list[Candidate]] | None = None) -> str:
        for start, end, meant in reversed(self.misread(line, more)):
            line = line[:start] + meant + line[end:]
        return line

    def is_broken(self, left: str, hyphen: str, right: str) -> bool:
        """A word broken in two, rather than one that holds or ends in a hyphen."""
        if hyphen in "¬­":
            return True
        known = self.model.known
        if right and known(f"{left}-{right}"):
            return False
        if right and known(left + right):
            return True
        # a part of a compound stands alone: "pre- and post-"
        return not known(f"{left}-")

    def units(self, text: str, title: bool, headers: frozenset[str] | set[str] = frozenset()) -> list[tuple[str, str | None]]:
        """The block's lines, each with its kind of page furniture; ``headers`` are keys of lines known as running headers,
        which count at the block's edges only."""
        lines = text.split("\n")
        kinds: list[str | None] = [None] * len(lines)
        if title:
            return list(zip(lines, kinds))
        lo, hi = 0, len(lines)
        known = lambda i: "header" if headers and self.head_key(lines[i]) in headers else None
        formed = lambda i, top: "header" if self.looks_like_header(lines[i]) and set_apart(lines[lo:hi], top) else None
        while lo < hi and (k := page_furniture(lines[lo], True, hi - lo == 1) or known(lo) or formed(lo, True)):
            kinds[lo] = k
            lo += 1
        # at the end, what the line before does not lead up to
        ended = lambda i: i == lo or lines[i - 1].rstrip().endswith((*STOPS, "-", "¬"))
        while hi > lo and (k := page_furniture(lines[hi - 1], ended(hi - 1), hi - lo == 1) or known(hi - 1) or formed(hi - 1, False)):
            kinds[hi - 1] = k
            hi -= 1
        return list(zip(lines, kinds))

    def head_key(self, line: str) -> str:
        """The key of a line as it was meant: a misread head is the same head."""
        return line_key(self.mended(line))

    def is_heading(self, line: str) -> bool:
        return line_key(line) in self.model.headings

    def looks_like_header(self, line: str) -> bool:
        """A short line, alone in its block or set apart from it, that is neither a sentence nor a heading."""
        s = line.strip()
        short = bool(s) and len(s) <= 70 and len(s.split()) <= 8 and not s.endswith((*STOPS, "-", "¬", "，", ",", "、"))
        return short and not s[0].islower() and any(c.isalpha() for c in s) and not SENTENCE_WORD.search(s) and not _CJK.search(s) and not self.is_heading(s)

    def joined(self, body: str) -> str:
        """Lines with the words that are broken between them in one piece."""
        return body if not HYPHEN_AT_END.search(body) else BROKEN.sub(lambda m: m.group(1) + m.group(4) if self.is_broken(m.group(1), m.group(2), m.group(4)) else m.group(1) + "-" + m.group(4), body)

    def noise(self, text: str, kind: str | None, more: dict[str, list[Candidate]] | None = None, units: list[tuple[str, str | None]] | None = None) -> set[str]:
        """Kinds of noise in a block."""
        title = kind == "title"
        units = units or self.units(text, title)
        found = {k for _, k in units if k}
        body = "\n".join(u for u, k in units if not k)
        if not title and not found and len(units) == 1 and self.looks_like_header(text):
            found.add("header")
        for m in BROKEN.finditer(body) if HYPHEN_AT_END.search(body) else ():
            if self.is_broken(m.group(1), m.group(2), m.group(4)) and (m.group(3) or m.end() == len(body)):
                found.add("broken word")
                break
        whole = "\n".join(u for u, k in units if k != "page number") if "page number" in found else text
        if self.misread(self.joined(whole), more) or self.model.misread_han(whole):
            found.add("misread")
        return found

    def edge_lines(self, text: str, kind: str | None, units: list[tuple[str, str | None]] | None = None) -> list[tuple[str, str, bool, bool]]:
        """(key, side, apart, prose): lines at the block's edges that may be a header if they stand on other pages, too.

        ``side`` is t(op), b(ottom) or, of a block of one line, o(nly); ``prose`` tells words of a sentence.
        """
        if kind == "title":
            return []
        # a head told by its form counts as one of the pages it stands on
        lines = [u for u, k in units or self.units(text, False) if k != "page number"]
        out = []
        for i, side in [(0, "o")] if len(lines) == 1 else [(0, "t"), (-1, "b")] if lines else []:
            x = lines[i]
            if 3 < len(x.strip()) <= 70 and not x.rstrip().endswith((*STOPS, "-", "¬")) and not self.is_heading(x) and (key := self.head_key(x)):
                out.append((key, side, side == "o" or set_apart(lines, side == "t"), bool(SENTENCE_WORD.search(x) or _CJK_SENTENCE.search(x))))
        return out

    def repaired(self, text: str, kind: str | None, headers: set[str], more: dict[str, list[Candidate]] | None = None) -> str:
        """The block's text as one paragraph, without page furniture, words mended."""
        units = [u for u, k in self.units(text, kind == "title", headers) if not k]
        if kind != "title" and len(units) == 1 and self.looks_like_header(units[0]):
            return ""
        known = self.model.known
        body = BROKEN.sub(
            lambda m: (m.group(1) + m.group(4) if m.group(3) else m.group(0)) if self.is_broken(m.group(1), m.group(2), m.group(4)) else m.group(1) + m.group(2) + (" " if m.group(4) and not known(f"{m.group(1)}-{m.group(4)}") else "") + m.group(4),
            "\n".join(units),
        )
        chars = list(body)
        for i, c in self.model.misread_han(body):
            chars[i] = c
        body = "".join(chars)
        body = re.sub(r"(?<=[⺀-鿿，。；：、（）])\n(?=[⺀-鿿，。；：、（）])", "", body)
        return self.mended(re.sub(r"\s*\n\s*", " ", body).strip(), more)


def _blocks(content: DataFrame) -> DataFrame:
    rows = content.filter(F.col("block_id").isNotNull() & F.col("content").isNotNull() & (F.coalesce("kind", F.lit("text")).isin("text", "title")))
    return once(parallel(rows.select("block_id", "note_id", "page", "ord", "kind", "content")), "block_id")


def _heading_key(text: str) -> str:
    return line_key(text)


def _learned(blocks: DataFrame):
    return channel.learned(blocks.select("content", F.coalesce(F.col("kind") == "title", F.lit(False)).alias("is_title")), _heading_key)


def _with_rare(blocks: DataFrame, rest: DataFrame | None) -> DataFrame:
    """``blocks`` with ``rare``: of the words with candidates that are too rare to be sent out, those that stand in each."""
    if rest is None:
        return blocks.withColumn("rare", F.lit(None).cast("array<struct<w: string, own: double, c: array<struct<r: string, n_r: double, log_p: double>>>>"))
    bits = channel.marked(rest)
    shared = blocks.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(b, w) for b, t in zip(batch["block_id"], batch["content"]) for w in channel.words_of(t) if channel.is_marked(shared.value, w)]
            yield pd.DataFrame(rows, columns=["block_id", "w"])

    stand = blocks.select("block_id", "content").mapInPandas(run, "block_id long, w string")
    # rare words have no hot key; a block has no more of them than words
    rare = stand.join(rest, "w").groupBy("block_id").agg(F.collect_list(F.struct("w", "own", "c")).alias("rare"))
    return blocks.join(rare, "block_id", "left")


def _more(rare) -> dict[str, list[Candidate]] | None:
    return None if rare is None else {r["w"]: channel.candidates(r["w"], r["own"], [(x["r"], x["n_r"], x["log_p"]) for x in r["c"]]) for r in rare}


#: (block_id, note_id, page, line, side, apart, prose): a line at the edge of a block, see ``Scanner.edge_lines``.
EDGES = "block_id long, note_id long, page int, line string, side string, apart boolean, prose boolean"


def _repeated(edges: DataFrame, content: DataFrame) -> DataFrame:
    """Of ``edges`` those whose line is a running header: it stands on three pages of the note or more, or on two and is set
    apart from its block. Lines with words of a sentence count where they are set apart at the edge of a page."""
    shown = content.filter(F.col("block_id").isNotNull() & F.col("content").rlike(r"\S") & ~((F.length("content") <= 12) & F.col("content").rlike(r"\d")))
    place = F.struct("ord", "block_id")
    ends = shown.groupBy("note_id", "page").agg(F.min(place).alias("t"), F.max(place).alias("b")).select(F.explode(F.array(F.struct(F.col("t.block_id").alias("block_id"), F.lit("t").alias("side")), F.struct(F.col("b.block_id").alias("block_id"), F.lit("b").alias("side")))).alias("e")).select("e.*")
    ends = ends.unionByName(ends.select("block_id", F.lit("o").alias("side"))).distinct()
    plain, prose = edges.filter(~F.col("prose")), edges.filter(F.col("prose") & F.col("apart")).join(ends, ["block_id", "side"], "left_semi")
    both = plain.unionByName(prose.select(*plain.columns))
    repeated = both.groupBy("note_id", "line").agg(F.countDistinct("page").alias("pages"), F.countDistinct(F.when(F.col("apart"), F.col("page"))).alias("apart_on")).filter((F.col("pages") > 2) | (F.col("apart_on") > 1)).select("note_id", "line")
    return both.join(repeated, ["note_id", "line"], "left_semi")


def noisy(content: DataFrame) -> DataFrame:
    """(block_id, noise): blocks with traces of page layout and misreading, and the kinds of noise."""
    blocks = _blocks(content)
    shared, rest = _learned(blocks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(shared.value)
        for batch in batches:
            rows = []
            for block, note, page, kind, text, rare in zip(batch["block_id"], batch["note_id"], batch["page"], batch["kind"], batch["content"], batch["rare"]):
                units = scanner.units(text, kind == "title")
                for n in scanner.noise(text, kind, _more(rare), units):
                    rows.append((block, note, page, None, None, None, None, n))
                rows += [(block, note, page, *edge, None) for edge in scanner.edge_lines(text, kind, units)]
            yield pd.DataFrame(rows, columns=["block_id", "note_id", "page", "line", "side", "apart", "prose", "noise"])

    # read twice below: written once, a few columns of few rows
    found = cut(_with_rare(blocks, rest).select("block_id", "note_id", "page", "kind", "content", "rare").mapInPandas(run, f"{EDGES}, noise string"))
    headers = _repeated(found.filter(F.col("line").isNotNull()), content).select("block_id", F.lit("header").alias("noise"))
    return found.filter(F.col("noise").isNotNull()).select("block_id", "noise").unionByName(headers).dropDuplicates(["block_id", "noise"])


def p5_found(spark, sf_dir: str) -> DataFrame:
    return noisy(table(spark, sf_dir, "content_list_v2")).select("block_id").distinct()


#: Pages that are sorted together in one task.
SPAN = 32


def paragraphs(content: DataFrame) -> DataFrame:
    """(note_id, page, ord, block_id, paragraph): the repaired text of each note, in order, one row per paragraph.

    A paragraph that goes on in the next block is one row, at its first block, over however many pages it goes. Blocks are
    told apart and numbered within spans of pages, so that no task sorts a whole note; what a span begins with and ends in is
    one row per span, from which its numbers are shifted and open ends carried on. Blocks without a page stand after the
    note's pages, by their order, as on a page of their own that goes on from none.
    """
    blocks = _blocks(content)
    shared, rest = _learned(blocks)

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(shared.value)
        for batch in batches:
            rows = [(b, n, p, *edge) for b, n, p, t, k in zip(batch["block_id"], batch["note_id"], batch["page"], batch["content"], batch["kind"]) for edge in scanner.edge_lines(t, k)]
            yield pd.DataFrame(rows, columns=["block_id", "note_id", "page", "line", "side", "apart", "prose"])

    # read twice to tell what is repeated: written once
    found = cut(blocks.select("block_id", "note_id", "page", "kind", "content").mapInPandas(edges, EDGES))
    headers = _repeated(found, content).groupBy("block_id").agg(F.collect_set("line").alias("headers"))
    marked = _with_rare(blocks, rest).join(headers, "block_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(shared.value)
        for batch in batches:
            batch["text"] = [scanner.repaired(t, k, set() if h is None else set(h), _more(x)) for t, k, h, x in zip(batch["content"], batch["kind"], batch["headers"], batch["rare"])]
            yield batch[["block_id", "note_id", "page", "ord", "kind", "text"]]

    # read twice below: written once
    mended = cut(marked.select("block_id", "note_id", "page", "ord", "kind", "content", "headers", "rare").mapInPandas(run, "block_id long, note_id long, page int, ord int, kind string, text string").filter(F.col("text") != ""))
    no_page = F.col("page").isNull()
    rows = mended.withColumn("span", F.struct(no_page.alias("no_page"), F.coalesce(F.floor(F.col("page") / SPAN), F.lit(0)).alias("k")))
    rows = rows.withColumn("place", F.struct(no_page.alias("no_page"), "page", "ord", "block_id"))
    w = Window.partitionBy("note_id", "span").orderBy("place")
    runs_on = F.coalesce("kind", F.lit("text")) != "title"
    open_end = runs_on & ~F.col("text").rlike(r"[.!?。！？…:：;；\"”»)）\]]\s*$")
    # a span's first block is judged below
    local = rows.withColumn("runs_on", runs_on).withColumn("open_end", open_end).withColumn("start", (~(F.lag("open_end", 1, True).over(w) & (F.col("runs_on") | (F.row_number().over(w) == 1)))).cast("long"))
    spans = local.groupBy("note_id", "span").agg(F.sum("start").alias("inner"), F.min_by("runs_on", "place").alias("runs_on"), F.max_by("open_end", "place").alias("open_end"))
    by_span = Window.partitionBy("note_id").orderBy("span")
    carried = F.lag("open_end", 1, False).over(by_span) & F.col("runs_on") & ~F.col("span.no_page")
    shift = F.sum(F.col("inner") + F.col("first")).over(by_span) - F.col("inner")
    spans = spans.withColumn("first", (~carried).cast("long")).select(F.col("note_id").alias("s_note"), F.col("span").alias("s_span"), shift.alias("shift"))
    numbered = local.withColumn("local", F.sum("start").over(w)).join(spans, F.col("note_id").eqNullSafe(F.col("s_note")) & (F.col("span") == F.col("s_span")))
    parts = numbered.withColumn("part", F.col("local") + F.col("shift")).groupBy("note_id", "part").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("b"))
    joined = F.aggregate(
        F.transform("b", lambda x: x["text"]), F.lit(""),
        lambda a, x: F.when(a == "", x)
        .when(a.rlike(r"\p{L}[-‐‑¬­]$"), F.concat(F.regexp_replace(a, r".$", ""), x))
        .when(a.rlike(r"[⺀-鿿，、]$"), F.concat(a, x))
        .otherwise(F.concat(a, F.lit(" "), x)),
    )
    first = F.get("b", F.lit(0))["place"]
    return parts.select("note_id", first["page"].alias("page"), first["ord"].alias("ord"), first["block_id"].alias("block_id"), joined.alias("paragraph"))


def p5_paragraphs(spark, sf_dir: str) -> DataFrame:
    return paragraphs(table(spark, sf_dir, "content_list_v2")).select("note_id", "page", "ord", "block_id", "paragraph")
