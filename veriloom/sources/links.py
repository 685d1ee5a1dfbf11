"""Links of web pages to PDF files."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Links(HTMLParser):
    """The first citation_pdf_url and the targets of all anchors, in page order."""

    def __init__(self):
        super().__init__()
        self.meta, self.anchors = None, []

    def handle_starttag(self, tag, attrs):
        held = dict(attrs)
        if tag == "meta" and held.get("name") == "citation_pdf_url" and self.meta is None:
            self.meta = held.get("content") or ""
        elif tag == "a" and "href" in held:
            self.anchors.append(held["href"] or "")


def absolute(base: str, link: str) -> str | None:
    """The link as an http(s) address with a host, else None."""
    try:
        url = urljoin(base, link)
        parts = urlparse(url)
    except ValueError:
        return None
    return url if parts.scheme in ("http", "https") and parts.netloc else None


def pdf_links(page: str | None, base: str | None, limit: int = 4) -> list[str]:
    """The page's citation_pdf_url, then its anchors whose path ends in .pdf, each once; at most ``limit``."""
    found = Links()
    found.feed(page or "")
    found.close()
    urls = [absolute(base or "", found.meta)] if found.meta else []
    urls += [u for u in (absolute(base or "", x) for x in found.anchors) if u and u.lower().split("?")[0].split("#")[0].endswith(".pdf")]
    return list(dict.fromkeys(u for u in urls if u))[:limit]


def extract_pdf_links(pages: DataFrame) -> DataFrame:
    """page_id, pos, link of the PDF links of each page (page_id, url, html)."""

    def work(batches):
        for batch in batches:
            rows = [(k.as_py(), pos, link) for k, url, page in zip(*batch.columns) for pos, link in enumerate(pdf_links(page.as_py(), url.as_py()))]
            columns = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.string()))], names=["page_id", "pos", "link"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(work, "page_id long, pos long, link string")
