"""Pages fetched over HTTP, spread by host."""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from http.client import HTTPException
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.functions import arrow

# What a request says of itself, and how long it waits.
HEADERS = {"User-Agent": "Mozilla/5.0 (compatible; linewright)", "Accept-Encoding": "gzip"}
TIMEOUT = 20
_SCHEMA = "url string, raw binary, status int, error string"


def get(url: str, timeout: float) -> tuple[bytes | None, int | None, str | None]:
    """The bytes of a page, its status, and what went wrong."""
    if not url.lower().startswith(("http://", "https://")):
        return None, None, "not a web address"
    status = None
    try:
        with urlopen(Request(url, headers=HEADERS), timeout=timeout) as answer:
            status, raw = answer.status, answer.read()
            return gzip.decompress(raw) if answer.headers.get("Content-Encoding") == "gzip" else raw, status, None
    except HTTPError as failed:
        return None, failed.code, failed.reason or "refused"
    except TimeoutError:
        return None, status, "timed out"
    except (OSError, EOFError, HTTPException, ValueError) as failed:  # no such host, cut off, broken gzip, no url
        reason = getattr(failed, "reason", failed)
        return None, status, "timed out" if isinstance(reason, TimeoutError) else str(reason) or type(failed).__name__


def fetch(urls: DataFrame, timeout: float = TIMEOUT, lanes: int = 2) -> DataFrame:
    """(url, html, status, error) of each distinct url; html is null where error is not.

    At most ``lanes`` tasks ask one host at a time, each for one page after the other, however
    many urls the host has. A page is decoded by the first charset that fits. A null url gives
    no row. A task that runs again fetches its pages again: write the result before it is
    used twice (``PageCache.read_through`` does).
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["url", "raw", "status", "error"]
        for batch in batches:
            for url in batch.column(0).to_pylist():
                columns = zip((pa.string(), pa.binary(), pa.int32(), pa.string()), (url, *get(url, timeout)))
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for k, v in columns], names)

    host = F.lower(F.regexp_extract("url", "^[^:/?#]+://([^/?#]*)", 1))
    rows = urls.filter("url IS NOT NULL").select("url").distinct()
    spread = rows.repartition(host, F.pmod(F.xxhash64("url"), F.lit(lanes)))
    return spread.mapInArrow(each, _SCHEMA).select("url", arrow.decode_bytes("raw").alias("html"), "status", "error")
