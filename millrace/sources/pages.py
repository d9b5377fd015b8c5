"""Pages behind links: bounded reads of HTML over the network, and the image that a page names for itself."""

from __future__ import annotations

import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.html import HEAD_BYTES, page_image
from millrace.functions.url import resolve_url

#: Takes an address and the most bytes to read; gives (status, content type, bytes, final address).
Get = Callable[[str, int], tuple[int, str, bytes, str]]
TIMEOUT_S = 8


def http_get(url: str, most: int) -> tuple[int, str, bytes, str]:
    with urllib.request.urlopen(urllib.request.Request(url), timeout=TIMEOUT_S) as r:
        return r.status, r.headers.get("content-type", ""), r.read(most), r.geturl()


def read_pages(rows: DataFrame, key: str, url: str, get: Get = http_get, most: int = HEAD_BYTES, parallel: int | None = None) -> DataFrame:
    """(key, address, html): the first *most* bytes of each page; no row where the answer isn't a success, isn't HTML or
    there is none. Other schemes than http and https aren't asked."""

    def one(address: str | None) -> tuple[str, str] | None:
        if not (address or "").lower().startswith(("http://", "https://")):
            return None
        try:
            status, kind, body, final = get(address, most)
        except Exception:  # whatever went wrong, there is no page
            return None
        return (final or address, body[:most].decode("utf-8", "replace")) if 200 <= status < 300 and "html" in kind.lower() and body else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(k, *page) for k, u in zip(b[key], b[url]) if (page := one(u))]
            yield pd.DataFrame(got, columns=[key, "address", "html"])

    asked = rows.select(key, url)
    asked = asked.repartition(parallel) if parallel else asked
    return asked.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, address string, html string")


def with_page_images(rows: DataFrame, key: str, link: str, image: str, get: Get = http_get) -> DataFrame:
    """*rows* whose empty *image* is filled with the one that their page names; only those pages are read."""
    lacking = rows.where(F.coalesce(F.col(image), F.lit("")) == "")
    found = read_pages(lacking, key, link, get).select(key, resolve_url(page_image(F.col("html")), F.col("address")).alias("_image"))
    both = rows.join(found, key, "left").withColumn(image, F.coalesce(F.nullif(F.col(image), F.lit("")), F.col("_image")))
    return both.drop("_image")
