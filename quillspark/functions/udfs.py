"""Functions that built-in expressions cannot express, batched by Arrow. They stand at the edges of plans, on few rows or
after a filter that runs in the JVM."""

from __future__ import annotations

import difflib
import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.doi import DOI_PATTERN

# --- fixed values -----------------------------------------------------------------------------------------------
#: Links to logins, articles, journals and authors, and to places within the page, are no references.
TRACKING = re.compile(r"(?:login|article|md5=|journal|author)", re.I)
LINK = re.compile(r"(\s*)(?<!!)\[(?!!)([^\]]*)\]\(([^)]+)\)(\s*)")
BRACKETS = re.compile(r"\[\[([^\]]+)\]\]")
# ----------------------------------------------------------------------------------------------------------------
_DOI = re.compile(DOI_PATTERN, re.I)


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two strings, without regard to case; null if either is null."""
    def one(x, y):
        if x is None or y is None:
            return None
        m = difflib.SequenceMatcher(None, x.lower(), y.lower())
        return round(m.ratio(), 6)

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="object").astype(float)


#: Below this bound on the similarity, the bound itself is taken.
SCREEN = 0.7


@F.pandas_udf(T.DoubleType())
def screened_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """As :func:`similarity` where the bound by common characters reaches ``SCREEN``, else that bound."""
    def one(x, y):
        if x is None or y is None:
            return None
        m = difflib.SequenceMatcher(None, x.lower(), y.lower())
        bound = m.quick_ratio()
        return round(m.ratio() if bound >= SCREEN else bound, 6)

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="object").astype(float)


@F.pandas_udf(T.StringType())
def front_matter_json(block: pd.Series) -> pd.Series:
    """A YAML block as JSON; what is broken or no mapping becomes an empty one."""
    try:
        import yaml
    except ImportError:
        yaml = None

    def plain(text: str) -> dict:
        """Key and value by line, for where no YAML library is installed."""
        return {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in text.splitlines()) if v.strip()}

    def one(text):
        if text is None:
            return None
        if yaml is None:
            value = plain(text)
        else:
            try:
                value = yaml.load(text, getattr(yaml, "CSafeLoader", yaml.SafeLoader))
            except yaml.YAMLError:
                value = {}
        return json.dumps(value if isinstance(value, dict) else {}, ensure_ascii=False, sort_keys=True, default=str)

    return block.map(one)


def _unlinked(m: re.Match) -> str:
    before, text, url, after = m.groups()
    escaped = m.string[: m.start(2) - 1].endswith("\\")
    found = None if not escaped and (TRACKING.search(url) or url.startswith("#")) else _DOI.search(text) or _DOI.search(url)
    if found is None:
        # an empty text keeps its brackets
        return f"{before}({text})({url}){after}" if text or not escaped and (TRACKING.search(url) or url.startswith("#")) else m.group()
    # the blanks around go with the link
    return f" {text if found.string is text else found.group()} "


@F.pandas_udf(T.StringType())
def plain_links(body: pd.Series) -> pd.Series:
    """Links as text: a DOI in text or address stands alone with one blank on either side, other links lose their brackets."""
    return body.map(lambda s: None if s is None else BRACKETS.sub(r"[\1]", LINK.sub(_unlinked, s)))


@F.pandas_udf(T.StringType())
def linked_urls(body: pd.Series, urls: pd.Series) -> pd.Series:
    """Each of the row's addresses as a Markdown link, the longest first, unless it is the target of one already."""
    def one(text, found):
        if text is None or found is None or not len(found):
            return text
        any_url = "|".join(re.escape(u) for u in sorted(set(found), key=lambda u: (-len(u), u)))
        return re.sub(rf"(?<!\]\()(?:{any_url})", lambda m: f"[{m.group()}]({m.group()})", text)

    return pd.Series([one(t, u) for t, u in zip(body, urls)])


def string_leaves(text: str | None) -> list[str]:
    """All strings in a JSON value, however deep, in order; none for broken JSON."""
    try:
        stack = [json.loads(text)] if text else []
    except ValueError:
        return []
    out = []
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, dict):
            stack.extend(reversed(list(x.values())))
        elif isinstance(x, list):
            stack.extend(reversed(x))
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_leaves(text: pd.Series) -> pd.Series:
    return text.map(string_leaves)
