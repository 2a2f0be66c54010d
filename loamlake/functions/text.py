"""Cleaning, script share, deduplication key and shingles of texts.

Everything but the HTML entity decoding is a JVM expression.
"""

from __future__ import annotations

import html
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The white space of Python's str.isspace, as a Java class. ``\s``
# needs (?U) to leave ASCII and then lacks the four information separators only.
SPACE = r"[\s\x1C-\x1F]"
LINE_SPACE = r"[\s\x1C-\x1F&&[^\n]]"
# Fixed value: a Python word character (letters, numbers, underscore; no marks).
WORD = r"\p{L}\p{N}_"
# Fixed value: the Thai block.
THAI = ("\u0e00", "\u0e7f")


@F.pandas_udf(T.StringType())
def _decode_entities(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def _decode_closed_entities(texts: pd.Series) -> pd.Series:
    entity = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z0-9]+);")

    def one(found: re.Match) -> str:
        return html.unescape(found[0]) if found[0][1] == "#" or found[0][1:] in html5 else found[0]

    return texts.map(lambda t: entity.sub(one, t), na_action="ignore")


def decode_entities(text: Column, *, open_ended: bool = True) -> Column:
    """HTML entity decoding; only texts holding an ampersand travel to Python.

    Old names such as ``&amp`` count without their semicolon, as in browsers, unless ``open_ended`` is off.
    """
    decode = _decode_entities if open_ended else _decode_closed_entities
    return F.coalesce(decode(F.when(F.contains(text, F.lit("&")), text)), text)


def strip(text: Column) -> Column:
    """Remove white space of any script at both ends."""
    # The class comes before its look-behind, so solid text fails on one test per character.
    return F.regexp_replace(text, rf"(?U)^{SPACE}++|{SPACE}(?<!{SPACE}{SPACE}){SPACE}*+\z", "")


def clean_text(
    text: Column, *, strip_html: bool = True, strip_urls: bool = False, strip_emails: bool = False, open_entities: bool = True
) -> Column:
    """Normalise one text: markup, then links, then white space, in that order.

    Blank-line runs are shortened before lines are stripped, so lines holding
    only blanks can leave more than two newlines in a row.
    """
    out = F.coalesce(text, F.lit(""))
    if strip_html:
        out = F.regexp_replace(decode_entities(out, open_ended=open_entities), r"<[^>]+>", " ")
    if strip_urls:
        out = F.regexp_replace(out, r"(?iU)https?://[^\s\x1C-\x1F]+|www\.[^\s\x1C-\x1F]+", " ")
    if strip_emails:
        out = F.regexp_replace(out, rf"[{WORD}.+-]+@[{WORD}-]+\.[{WORD}.-]+", " ")
    # Single blanks stay as they are, so only other runs are rewritten.
    out = F.regexp_replace(out, r"[ \t\r\f\x0B](?:(?<=[^ ])[ \t\r\f\x0B]*+|[ \t\r\f\x0B]++)", " ")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    after_line = rf"(?<=\n{LINE_SPACE}){LINE_SPACE}*+"
    before_line = rf"(?<!{LINE_SPACE}{LINE_SPACE}){LINE_SPACE}*+(?=\n)"
    out = F.regexp_replace(out, f"(?U){LINE_SPACE}(?:{after_line}|{before_line})", "")
    return strip(out)


def script_share(text: Column, first: str = THAI[0], last: str = THAI[1]) -> Column:
    """Share of the non-blank characters that lie in ``first``..``last``; 0 for an empty text."""
    inside = F.length(F.regexp_replace(text, f"[^{first}-{last}]+", ""))
    solid = F.length(F.regexp_replace(text, f"(?U){SPACE}+", ""))
    return F.coalesce(F.try_divide(inside, solid), F.lit(0.0))


def squeeze(text: Column) -> Column:
    """Lower case with every white space run as one blank: the form duplicates are compared in."""
    # A single blank is left alone; any other run is rewritten.
    run = rf"(?U){SPACE}(?:(?<=[^ ]){SPACE}*+|{SPACE}++)"
    return F.lower(F.trim(F.regexp_replace(text, run, " ")))


def dedup_key(text: Column) -> Column:
    """Equal for texts that differ only in letter case and white space."""
    return F.md5(squeeze(text))


def shingles(text: Column, n: int = 5) -> Column:
    """The distinct ``n``-character grams of the squeezed text; a shorter text is its own gram."""
    s = squeeze(text)
    # One pass over the text: an overlapping look-ahead, kept off the second
    # half of a surrogate pair so that a gram always starts at a character.
    grams = F.regexp_extract_all(s, F.lit(rf"(?s)(?=(.{{{n}}}))(?![\uDC00-\uDFFF])"), 1)
    return (
        F.when(F.length(s) >= n, F.array_distinct(grams))
        .when(F.length(s) > 0, F.array(s))
        .otherwise(F.array().cast("array<string>"))
    )


def redact_credentials(target: Column) -> Column:
    """Mask the ``user:password@`` part of a connection target."""
    return F.regexp_replace(target, r'://[^/@" ]*@', "://<redacted>@")
