"""Reading sources: plain texts with a downloader's preamble, web pages, PDF files, TEI documents, tables, BibTeX."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ElementTree
from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from . import bibliography

# What a page's chrome is, where its text may be, and how much of a block may be links.
CHROME_TAGS = frozenset("script style nav footer header aside form button input figure figcaption noscript iframe".split())
CHROME_NAMES = re.compile(r"(?i)\b(related|share|social|newsletter|subscribe|cookie|breadcrumb|sidebar|comment|promo|recommend|trending|popular|pagination|widget|masthead|site-nav|menu)\b")
CONTAINERS = ("main", "article", "div[role=main]", "#main", ".main", "#content", ".content", "body")
LINKED, LEAST_BLOCK, LEAST_TEXT = 0.7, 120, 200
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PREAMBLE = r"(?s)\ASource URL:.*?\n\s*---\s*\n+"
RUN = 4


def strip_preamble(text: Column) -> Column:
    """Without the block that a downloader puts before a page's text; ``saved_page`` tells whether there was one."""
    return F.regexp_replace(text, PREAMBLE, "")


def saved_page(text: Column) -> Column:
    return text.rlike(PREAMBLE)


def drop_boilerplate(text: Column) -> Column:
    """Lines of web chrome go, and so do runs of four or more headlines; blank lines at the end as well."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~t.boilerplate_line(x))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("run"))
    flushed = lambda s: F.when(F.size(s["run"]) < RUN, F.concat(s["out"], s["run"])).otherwise(s["out"])
    none = F.array().cast("array<string>")

    def step(s: Column, x: Column) -> Column:
        head = t.headline_shaped(x)
        return F.struct(F.when(head, s["out"]).otherwise(F.concat(flushed(s), F.array(x))).alias("out"), F.when(head, F.concat(s["run"], F.array(x))).otherwise(none).alias("run"))

    return F.regexp_replace(F.array_join(F.aggregate(lines, start, step, flushed), "\n"), r"\s+\z", "")


def clean_source(text: Column) -> Column:
    """The text of a source file: a saved page without preamble and chrome, any other text as it is."""
    return F.when(saved_page(text), drop_boilerplate(strip_preamble(text))).otherwise(text)


class Element:
    __slots__ = ("tag", "attributes", "parts", "gone")

    def __init__(self, tag: str, attributes: dict):
        self.tag, self.attributes, self.parts, self.gone = tag, attributes, [], False

    def walk(self):
        """The element and all below it, in page order, without what was taken out."""
        todo = [self]
        while todo:
            e = todo.pop()
            if not e.gone:
                yield e
                todo.extend(p for p in reversed(e.parts) if isinstance(p, Element))

    def texts(self):
        """Its pieces of text, stripped and not empty."""
        todo = [self]
        while todo:
            e = todo.pop()
            if isinstance(e, str):
                if s := e.strip():
                    yield s
            elif not e.gone:
                todo.extend(reversed(e.parts))

    def is_a(self, selector: str) -> bool:
        if selector[0] == "#":
            return self.attributes.get("id") == selector[1:]
        if selector[0] == ".":
            return selector[1:] in (self.attributes.get("class") or "").split()
        if "[" in selector:
            return self.tag == "div" and self.attributes.get("role") == "main"
        return self.tag == selector


class Tree(HTMLParser):
    """A page as elements; an end tag closes the last open element of its name, if there is one."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open, self.count = [self.root], {}

    def handle_starttag(self, tag, attrs):
        e = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].parts.append(e)
        if tag not in VOID:
            self.open.append(e)
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.open[-1].parts.append(Element(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        if self.count.get(tag):
            while True:
                last = self.open.pop()
                self.count[last.tag] -= 1
                if last.tag == tag:
                    return

    def handle_data(self, data):
        self.open[-1].parts.append(data)


def page_text(page: str | None) -> str:
    """A web page's text by its usual containers: chrome by tag, class or id goes, blocks of links go, short lines go."""
    tree = Tree()
    tree.feed(page or "")
    tree.close()
    for e in tree.root.walk():
        e.gone = e.tag in CHROME_TAGS or any(CHROME_NAMES.search(e.attributes.get(k, "")) for k in ("class", "id"))
    text = ""
    for selector in CONTAINERS:
        area = next((e for e in tree.root.walk() if e.is_a(selector)), None)
        if area is None:
            continue
        for e in list(area.walk()):
            if e is not area and e.tag in ("div", "ul", "ol", "section", "table") and not e.gone:
                size = len(" ".join(e.texts()))
                if size >= LEAST_BLOCK:
                    e.gone = len(" ".join(" ".join(a.texts()) for a in e.walk() if a.tag == "a")) >= LINKED * size
        text = "\n\n".join(area.texts())
        if len(text) > LEAST_TEXT:
            break
    lines = (x.strip() for x in (text or "\n\n".join(tree.root.texts())).splitlines())
    return re.sub(r"\s{2,}", " ", "\n".join(x for x in lines if len(x.split()) > 2)).strip()


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, text of each page (page_id, html), without lines of web chrome."""

    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([page_text(x.as_py()) for x in batch.column(1)], pa.string())], names=["page_id", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(work, "page_id long, text string").withColumn("text", drop_boilerplate(F.col("text")))


def read_pdfs(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]], fallback: Callable[[bytes], list[str] | None] | None = None, garbled: Callable[[str], float] | None = None) -> DataFrame:
    """path, page, text of every PDF under ``path``.

    ``extract`` gives a file's pages; where ``garbled`` scores their text above 0, ``fallback`` may give better ones,
    which are taken if they score less. A file that cannot be read has no rows.
    """

    def pages_of(raw: bytes) -> list[str]:
        try:
            pages = extract(raw)
        except Exception:  # noqa: BLE001 - a file that its extractor rejects
            return []
        score = garbled("\n".join(pages)) if garbled else 0
        if score > 0 and fallback and (other := fallback(raw)) and garbled("\n".join(other)) < score:
            return other
        return pages

    def work(batches):
        for batch in batches:
            rows = [(p, k, x) for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, x in enumerate(pages_of(raw), 1)]
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string()), strict=True)], names=["path", "page", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, "path string, page int, text string")


TEI = "{http://www.tei-c.org/ns/1.0}"


def tei_paragraphs(xml: str) -> list[str]:
    """Body paragraphs with each bibliographic reference as ⟦id|its visible text⟧."""
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return []

    def flat(e: ElementTree.Element) -> str:
        if e.tag == f"{TEI}ref" and e.get("type") == "bibr" and e.get("target"):
            return f"⟦{e.get('target').lstrip('#')}|{''.join(e.itertext()).strip().replace('⟧', '')}⟧"
        return (e.text or "") + "".join(flat(c) + (c.tail or "") for c in e)

    found = [" ".join(flat(p).split()) for body in root.iter(f"{TEI}body") for p in body.iter(f"{TEI}p")]
    return [p for p in found if p]


@F.pandas_udf(T.ArrayType(T.StringType()))
def read_tei(documents):
    return documents.map(lambda x: tei_paragraphs(x) if x else [])


def resolve_tei(text: Column, keys: Column) -> Column:
    """Placeholders whose id is in the map ``keys`` become [[key]], others their visible text."""
    parts = F.split(F.regexp_replace(text, "⟦([^|⟧]*)\\|([^⟧]*)⟧", f"{t.MARK}$1|$2{t.MARK}"), t.MARK)
    shown = F.transform(parts, lambda p, i: F.when(i % 2 == 0, p).otherwise(F.coalesce(F.concat(F.lit("[["), F.try_element_at(keys, F.substring_index(p, "|", 1)), F.lit("]]")), F.substring_index(p, "|", -1))))
    return F.array_join(shown, "")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV or JSON Lines file by its extension; rows that do not fit the schema keep nulls."""
    if path.endswith(".csv"):
        return spark.read.schema(schema).option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    return spark.read.schema(schema).json(path)


#: Bibliography loaders by extension.
LOADERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    ".bib": bibliography.read_bibtex,
    ".csv": lambda spark, path: read_table(spark, path, "key string, title string, author string, year string, url string, doi string"),
    ".jsonl": lambda spark, path: read_table(spark, path, "key string, title string, author string, year string, url string, doi string"),
}


def load_bibliography(spark: SparkSession, path: str) -> DataFrame:
    """key, title, author, year, url, doi by the loader of the file's extension."""
    for extension, load in LOADERS.items():
        if path.lower().endswith(extension):
            return load(spark, path).select("key", "title", "author", "year", "url", "doi")
    raise ValueError(f"no loader for {path}; known are {', '.join(LOADERS)}")
