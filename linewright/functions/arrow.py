"""The few scalar functions that no built-in expresses, over Arrow batches."""

from __future__ import annotations

import html
from urllib.parse import urljoin as _join

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_CHARSETS = ("utf-8", "cp932", "euc-jp", "shift_jis")


def _text_udf(function):
    """A text function over batches; the optimiser neither repeats nor moves it."""
    return F.pandas_udf(function, StringType()).asNondeterministic()


@_text_udf
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else html.unescape(t))


def unescape_html(text: Column | str) -> Column:
    """Character references decoded; texts without an ampersand do not go through Python."""
    text = F.col(text) if isinstance(text, str) else text
    has = text.contains("&")
    return F.coalesce(_unescape(F.when(has, text)), text)


@_text_udf
def url_join(base: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else _join(a, b) for a, b in zip(base, link)])


@_text_udf
def decode_bytes(raw: pd.Series) -> pd.Series:
    """Bytes as text by the first charset that fits; else UTF-8 with marks for what is broken."""

    def decode(data: bytes | None) -> str | None:
        if data is None:
            return None
        for charset in _CHARSETS:
            try:
                return data.decode(charset)
            except UnicodeDecodeError:
                continue
        return data.decode("utf-8", "replace")

    return raw.map(decode)
