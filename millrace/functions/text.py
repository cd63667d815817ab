"""Cleaning of raw text."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tags that show that a text is markup.
TAGS = ("p", "br", "li", "ul", "ol", "div", "span", "strong", "em", "b", "i", "h[1-6]", "table", "tr", "td", "th", "a", "hr", "blockquote")
HAS_TAG = rf"(?i)<\s*/?\s*(?:{'|'.join(TAGS)})\b[^>]*>"
MOST_PASSES = 3
#: All characters that count as blank.
BLANK = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def decode(text: str | None) -> str | None:
    """NFKC, then HTML entities until nothing changes, three times at most."""
    if text is None:
        return None
    text = unicodedata.normalize("NFKC", text)
    for _ in range(MOST_PASSES):
        plain = html.unescape(text)
        if plain == text:
            break
        text = plain
    return text


def _decoded(s: pd.Series) -> pd.Series:
    return s.map(decode, na_action="ignore")


decoded = F.pandas_udf(_decoded, T.StringType())


def once(c: Column) -> Column:
    """``c``, in a form that counts as not deterministic though it is.

    So the optimiser neither repeats it in each expression that reads its column nor moves filters on it below its
    projection, where they would work it out again.
    """
    return F.when(F.monotonically_increasing_id() >= 0, c)


def once_streamed(c: Column) -> Column:
    """The same for a stream, in which rows have no numbers."""
    return F.when(F.rand(0) >= 0, c)


def let(value: Column, use) -> Column:  # noqa: ANN001
    """``use(value)`` with the value worked out once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def tidy(c: Column) -> Column:
    """All of cleaning but the decoding: tags (only if a known one occurs), line ends, trailing and surplus blanks.

    Trailing blanks are trimmed from each line rather than searched, so long runs of blanks cost what other text costs.
    """
    untagged = let(c, lambda x: F.when(x.contains("<") & x.rlike(HAS_TAG), F.regexp_replace(x, "<[^>]+>", " ")).otherwise(x))
    lines = F.split(F.replace(F.replace(untagged, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n")
    joined = F.array_join(F.transform(lines, lambda x: F.rtrim(x, F.lit(BLANK))), "\n")
    return let(joined, lambda x: F.trim(F.when(x.contains("\n\n\n"), F.regexp_replace(x, r"\n{3,}", "\n\n")).otherwise(x), F.lit(BLANK)))


def clean(c: Column, guard=once) -> Column:  # noqa: ANN001
    """Cleans a text. Only texts that could change by decoding visit Python. ``guard`` keeps it from being worked out twice; a stream needs another one than a table."""
    # Latin letters with accents are as NFKC leaves them; the function gets nulls for the texts that need no decoding
    plain = ~(c.contains("&") | c.rlike(r"[^\x{00}-\x{7f}\x{c0}-\x{ff}]"))
    return guard(tidy(F.coalesce(decoded(F.when(~plain, c)), c)))


def date_shaped(c: Column) -> Column:
    return c.rlike(r"^\d{4}-\d{2}-\d{2}\n?\z")
