"""Fetching pages and files as a table of outcomes: url, status, http_status, attempts, reason, body."""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

Answer = tuple[int, str, bytes]  # HTTP status, content type, body

FAILED = {429: "HTTP 429 (rate limited)", 401: "blocked/permission (HTTP 401)", 403: "blocked/permission (HTTP 403)"}


def over_http(url: str, timeout: float = 15) -> Answer:
    """One GET with the standard library."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url), timeout=timeout) as r:
            return r.status, r.headers.get_content_type(), r.read()
    except HTTPError as e:
        return e.code, "", b""


def one(url: str, get: Callable[[str], Answer], attempts: int, pause: float, accepts: str | None) -> tuple:
    """(status, http status, attempts, reason, body): a rate limit, a server error or a broken connection is tried again."""
    code, reason = None, "network error"
    for n in range(1, attempts + 1):
        try:
            code, kind, body = get(url)
        except OSError as e:
            code, reason = None, f"network error: {type(e).__name__}"
        else:
            if 200 <= code < 300:
                return ("completed", code, n, None, body) if not accepts or kind.startswith(accepts) else ("failed", code, n, f"unexpected content ({kind})", None)
            reason = FAILED.get(code, f"HTTP {code}")
            if code != 429 and code < 500:
                return "failed", code, n, reason, None
        if n < attempts:
            time.sleep(pause * 2 ** (n - 1))
    return "failed", code, attempts, reason, None


def fetch(urls: DataFrame, get: Callable[[str], Answer] = over_http, attempts: int = 3, pause: float = 0.4, accepts: str | None = None) -> DataFrame:
    """The outcome of each address in column `url`. `get` runs on the executors; requests of a task go out one after the other, at least `pause` seconds apart after a failure."""
    names = ["url", "status", "http_status", "attempts", "reason", "body"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.binary()]

    def run(batches):
        for batch in batches:
            for url in batch.column(0).to_pylist():  # a body can be large: one row at a time
                row = (url, *one(url, get, attempts, pause, accepts))
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    return urls.select("url").mapInArrow(run, "url string, status string, http_status int, attempts int, reason string, body binary")
