"""Normalisation: all offsets of the engine refer to its result. The order of the steps is semantics."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import sql as S
from ..functions.sql import Expr

INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad\ue000\ue001"
#: The elements that are markup. Anything else between angle brackets is text: judges
#: write quotations as <<…>>.
ELEMENTS = "a b i u s em strong sup sub span font p div br hr li ul ol table thead tbody tr td th h1 h2 h3 h4 h5 h6 blockquote code pre img small big mark del ins".split()
_BLANK = r"[ \t]"


def _emphasis(mark: str, inner: str, edge: str = "") -> str:
    """A run between two equal marks, which may not stand inside it."""
    return (f"(?<!{edge})" if edge else "") + f"({mark})({inner}+?)" + r"\1" + (f"(?!{edge})" if edge else "")


#: The native steps in their order: (name, pattern, replacement). The order is semantics.
STEPS = [
    ("pipe for l", r"(?<=\p{L})\|(?=\p{L})", "l"),
    ("wrapped word", rf"(?md)^(?!{_BLANK}*[-–])(.*\p{{L}})-\n(?=\p{{Ll}})", "$1"),  # a line that opens with a dash marks a role
    ("front matter", r"(?sd)\A(---|\+\+\+)\n.*?\n\1\n", ""),
    ("comment", r"(?s)<!--.*?-->", ""),
    ("element", rf"(?<!<)</?(?i:{'|'.join(ELEMENTS)})(?:\s[^<>\n]*)?/?>", ""),
    ("image", r"!\[([^\]]*)\]\([^)]*\)", "$1"),
    ("link", r"\[([^\]]+)\]\([^)]*\)", "$1"),
    ("emphasis", _emphasis(r"\*\*|\*|`", "[^*`]"), "$2"),
    ("underscores", _emphasis("__|_", "[^_]", r"[\p{L}\p{N}]"), "$2"),
    ("heading", rf"(?md)^{_BLANK}*#{{1,6}}{_BLANK}+", ""),
    ("quoted line", rf"(?md)^{_BLANK}*>{_BLANK}?", ""),
]


@F.pandas_udf(StringType())
def compatible(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode NFKC and HTML entities, which Spark has no function for."""
    for s in texts:
        yield s.map(lambda x: html.unescape(unicodedata.normalize("NFKC", x)), na_action="ignore")


def fold_quotes(text: Column) -> Column:
    return F.translate(text, "‘’‚‛“”„‟", "''''" + '""""')


def strip_markup(text: Column) -> Column:
    """The native steps, after ``compatible``."""
    return reduce(lambda t, s: F.regexp_replace(t, s[1], s[2]), STEPS, F.translate(text, INVISIBLE, ""))


def normalized(docs: DataFrame, text_col: str = "text", sanitize: bool = True) -> DataFrame:
    """docs with the text normalised; a null text is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    if sanitize:
        docs = docs.withColumn(text_col, compatible(text))
        return docs.withColumn(text_col, fold_quotes(strip_markup(F.col(text_col))))
    return docs.withColumn(text_col, F.translate(fold_quotes(text), "\ue000\ue001", ""))


def place_key(name: Expr) -> Expr:
    """Lower case without Italian accents, single blanks, no final apostrophe."""
    flat = S.translate(S.lower(name), "àáâäèéêëìíîïòóôöùúûü", "aaaaeeeeiiiioooouuuu")
    return S.regexp_replace(S.trim(S.regexp_replace(flat, r"\s+", " ")), "['’]$", "")


def initials_key(text: Expr) -> Expr:
    """'a. b.' and 'A.B.' alike as 'A.B.'."""
    letters = S.regexp_extract_all(S.upper(text), r"(\p{L})", 1)
    return S.concat(S.array_join(letters, "."), ".")
