"""Visually identical text with different characters.

Each letter resolves to the scripts in which it can be spelled alike. Intersecting these sets over a word tells a word of
one script from a mixed one, and gives the script in which all of it can be written; where several remain (the whole word
has a look-alike in another script) the scripts of the text's other words decide. The word is then spelled in that
script. Compatibility forms, invisible characters, blanks and detached accents are brought to their ordinary form.

Defined results
    null and empty values: no case, their form is null and empty; a value that only consists of invisible characters: a
    case, its form is empty; records delivered twice: one row; texts without letters: only invisible characters, blanks
    and compatibility forms count; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import mojibake
from quillspark.tables import spread, table

# --- fixed values: letters that look like Latin ones, by script -----------------------------------------------------
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеорсухѕіјһԁԛԝӀ", "ABESIJKMHOPCTYXaeopcyxsijhdqwI"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ", "ABEZHIKMNOPTYXovcj"))
ARMENIAN = dict(zip("ՕԼՍօսհոցզ", "OLUouhngq"))
#: Greek letters that stand for themselves beside Latin ones (as symbols) unless they lie within a word in small letters.
GREEK_SYMBOLS = dict(zip("αικρυχωγη", "aikpuxwyn"))
DASHES = "‐‑‒–—―⁃−﹘﹣－ー"
SLASHES = "⁄∕⧸／╱"
DOTS = "․．。﹒"
#: Single characters that are another one by definition, or look like ASCII punctuation.
SINGLES = {"K": "K", "Å": "Å", "Ω": "Ω", ";": ";", "·": "·", "․": ".", "∕": "/", "⁄": "/", "∶": ":", "꞉": ":", "ǃ": "!"}
# ---------------------------------------------------------------------------------------------------------------------
LOOKS = {**{c: ("CYRILLIC", x) for c, x in CYRILLIC.items()}, **{c: ("GREEK", x) for c, x in GREEK.items()}, **{c: ("ARMENIAN", x) for c, x in ARMENIAN.items()}}
TO_SCRIPT = {"CYRILLIC": {x: c for c, x in reversed(CYRILLIC.items())}, "GREEK": {x: c for c, x in reversed(GREEK.items())}, "ARMENIAN": {x: c for c, x in reversed(ARMENIAN.items())}}

#: Letters and their marks, outside the scripts that are written without gaps.
WORD = re.compile(r"(?:(?![⺀-鿿豈-﫿ぁ-ヿ가-힣])[^\W\d_][̀-ͯ]*)+")
_CJK = re.compile("[㐀-鿿ぁ-ヿ]")
#: Blocks whose characters are forms of others: ligatures, full-width forms, styled letters, radicals, compatibility ideographs.
_FORMS = re.compile("[ﬀ-ﬆ！-～\U0001d400-\U0001d7ff⼀-⿟⺀-⻳豈-﫿ℊ-ℓℛ-ℝℯ-ℴ]")
_FULL_STOPS = re.compile("[！-／：-＠［-｀｛-～]")

#: Most titles: letters of Latin, Han and small Greek ones, ASCII, typographic signs; and what may make a Greek one a case.
_ORDINARY = re.compile("[\\x20-\\x7e¡-¬®-ɏ‐-―‘-”…€™《》「」、。αβγδεζηθικλμξπρστυφχψω一-鿿]*")
_GREEK_WITHIN = re.compile("[a-zß-ɏ][" + "".join(GREEK_SYMBOLS) + "][a-zß-ɏ]")

_scripts: dict[str, str] = {}


def script(c: str) -> str:
    """Script of a letter, from its Unicode name; COMMON for what has none."""
    got = _scripts.get(c)
    if got is None:
        name = unicodedata.name(c, "").split(" ", 1)[0] if c.isalpha() else ""
        got = _scripts[c] = name if name and name not in ("MODIFIER", "FEMININE", "MASCULINE", "MICRO", "MATHEMATICAL", "FULLWIDTH") else "COMMON"
    return got


def invisible(s: str, i: int) -> bool:
    """Format characters, except where a script or an emoji needs them."""
    c = s[i]
    if unicodedata.category(c) != "Cf" and c not in "͏ᅟᅠ឴឵ㅤﾠ" and not "︀" <= c <= "️":
        return False
    if c in "‌‍️︎" and 0 < i < len(s) - (c in "‌‍"):
        before = s[i - 1]
        needs = unicodedata.category(before) in ("So", "Sk", "Mn") or script(before) in ("ARABIC", "DEVANAGARI", "BENGALI", "MALAYALAM", "TAMIL", "TELUGU", "SINHALA")
        return not needs
    return True


def resolved(c: str) -> frozenset[str]:
    """Scripts in which a letter can be spelled alike."""
    own = script(c)
    if c in LOOKS:
        return frozenset((own, "LATIN"))
    if own == "LATIN":
        return frozenset(["LATIN", *(s for s, t in TO_SCRIPT.items() if c in t)])
    return frozenset([own])


def spelled(c: str, to: str) -> str:
    """The letter as it is written in script ``to``, if it has a look-alike there."""
    if script(c) == to or script(c) == "COMMON":
        return c
    latin = LOOKS[c][1] if c in LOOKS else c
    if to == "LATIN":
        return latin
    return TO_SCRIPT.get(to, {}).get(latin, c)


def _symbols(word: str) -> set[int]:
    """Positions of Greek letters that are symbols beside Latin ones."""
    out = set()
    for i, c in enumerate(word):
        if script(c) == "GREEK" and c not in GREEK:
            small = lambda k: 0 <= k < len(word) and word[k].islower() and script(word[k]) == "LATIN"
            if not (c in GREEK_SYMBOLS and small(i - 1) and small(i + 1)):
                out.add(i)
    return out


def consistent(word: str, others: Counter, symbols: bool = True) -> str:
    """The word in one script. ``others`` counts the scripts of the words around it that have only one; ``symbols``: Greek
    letters may stand for themselves."""
    letters = [(i, c) for i, c in enumerate(word) if script(c) != "COMMON"]
    own = {script(c) for _, c in letters}
    if symbols and len(own) > 1 and own <= {"LATIN", "GREEK"}:
        keep = _symbols(word)
        letters = [(i, c) for i, c in letters if i not in keep]
        own = {script(c) for _, c in letters}
    if not letters:
        return word
    can = frozenset.intersection(*(resolved(c) for _, c in letters))
    if len(own) == 1:
        (mine,) = own
        context = others.most_common(1)
        if mine not in ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN") or not context or context[0][0] == mine or others[mine]:
            return word
        to = context[0][0]
        # all of it has look-alikes in the script that the rest is written in; capitals in a row are an abbreviation,
        # a single Greek letter a symbol
        if to not in can or mine == "LATIN" and not word.islower() or symbols and mine == "GREEK" and len(letters) == 1:
            return word
    else:
        known = [s for s, _ in others.most_common() if s in can]
        most = Counter(script(c) for _, c in letters).most_common()
        to = known[0] if known else next((s for s in ("LATIN", *(s for s, _ in most)) if s in can), most[0][0])
    chars = list(word)
    for i, c in letters:
        x = spelled(c, to)
        if x == c and script(c) != to and c in GREEK_SYMBOLS and to == "LATIN":
            x = GREEK_SYMBOLS[c]
        chars[i] = x
    return "".join(chars)


def title_form(s: str) -> str:
    """The one consistent form of a title."""
    if _ORDINARY.fullmatch(s) and not _GREEK_WITHIN.search(s):
        return s
    cjk = _CJK.search(s) is not None
    out = []
    for i, c in enumerate(s):
        if invisible(s, i):
            continue
        if c.isspace() and c != " ":
            out.append(" ")
        elif _FORMS.match(c) and not (cjk and _FULL_STOPS.match(c)):
            out.append(unicodedata.normalize("NFKC", c))
        else:
            out.append(SINGLES.get(c, c))
    s = unicodedata.normalize("NFC", "".join(out))
    words = WORD.findall(s)
    kinds = [{script(c) for c in w if script(c) != "COMMON"} for w in words]
    # the text's script is that of the words which are certainly of one: some letter has no look-alike
    sure = Counter(next(iter(k)) for w, k in zip(words, kinds) if len(k) == 1 and len(frozenset.intersection(*(resolved(c) for c in w if script(c) != "COMMON"))) == 1)
    return WORD.sub(lambda m: consistent(m.group(), sure), s)


#: DOIs are spelled in Latin letters.
_LATIN = Counter({"LATIN": 1})


def doi_form(s: str) -> str:
    """The one form of a DOI: words that can be spelled in Latin letters are (by the scripts that all their letters resolve
    to), dashes, slashes and dots are ASCII, no blanks, small letters."""
    if not s.isascii():
        s = "".join(c for i, c in enumerate(s) if not invisible(s, i))
        s = "".join("-" if c in DASHES else "/" if c in SLASHES else "." if c in DOTS else c for c in s)
        s = unicodedata.normalize("NFKC", s)
        s = "".join(SINGLES.get(c, c) for c in s)
        s = WORD.sub(lambda m: consistent(m.group(), _LATIN, symbols=False), s)
    return "".join(s.split()).lower()


def doi_is_case(s: str) -> bool:
    if s.isascii():
        return any(c.isspace() and c != " " for c in s)
    return doi_form(s) != "".join(s.split(" ")).lower()


def title_is_case(s: str) -> bool:
    return title_form(s) != s


FIELDS = ("doi", "title")


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for ident, field, value in zip(batch["ident"], batch["field"], batch["value"]):
            if field == "title":
                form = title_form(value)
                case = form != value
            else:
                form, case = doi_form(value), doi_is_case(value)
            rows.append((ident, field, value, form, case))
        yield pd.DataFrame(rows, columns=["ident", "field", "value", "form", "is_case"])


def _values(frontmatter: DataFrame) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS))).alias("v")
    rows = frontmatter.filter(F.col("note_id").isNotNull()).select(F.col("note_id").alias("ident"), "doi", "title")
    rows = spread(rows, "ident").dropDuplicates(["ident"])
    return rows.select("ident", each).select("ident", "v.field", "v.value").filter(F.col("value").isNotNull())


def checked(values: DataFrame) -> DataFrame:
    """(ident, field, value, form, is_case) of the values that hold anything but printable ASCII."""
    kind = values.schema["ident"].dataType.simpleString()
    odd = values.filter(F.col("value").rlike(r"[^\x20-\x7E]"))
    return odd.mapInPandas(_forms, f"ident {kind}, field string, value string, form string, is_case boolean")


def cases(frontmatter: DataFrame) -> DataFrame:
    """(ident, field, value, form) of the cases; titles that were decoded wrongly are none."""
    flagged = checked(_values(frontmatter)).filter("is_case").drop("is_case")
    titles = frontmatter.select(F.col("note_id").alias("ident"), F.col("title").alias("text"))
    lm = frontmatter.sparkSession.sparkContext.broadcast(mojibake.counted(titles.select("text").filter(F.col("text").isNotNull()), mojibake.clean))

    def sound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = mojibake.Decoder(lm.value)
        for batch in batches:
            good = [f != "title" or not decoder.damaged(v) for f, v in zip(batch["field"], batch["value"])]
            yield batch[good]

    return flagged.mapInPandas(sound, flagged.schema)


def p4_found(spark, sf_dir: str) -> DataFrame:
    return cases(table(spark, sf_dir, "frontmatter")).select(F.col("ident").alias("note_id"), "field")


def p4_forms(spark, sf_dir: str) -> DataFrame:
    """Every DOI and title in its one consistent form. DOIs come in small letters; wrongly decoded titles stay as they
    are."""
    frontmatter = table(spark, sf_dir, "frontmatter")
    values = _values(frontmatter)
    changed = cases(frontmatter).select("ident", "field", "form")
    plain = F.when(F.col("field") == "doi", F.lower("value")).otherwise(F.col("value"))
    return values.join(changed, ["ident", "field"], "left").select(F.col("ident").alias("note_id"), "field", F.coalesce("form", plain).alias("form"))
