"""Reading bibliographies, reference maps, front matter and marked-up citations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELD = re.compile(r"\s*([A-Za-z][\w-]*)\s*=\s*")
SKIPPED = ("comment", "preamble", "string")


def _value(text: str, at: int) -> tuple[str, int]:
    """A braced (nested), quoted or bare value from ``at``, and where it ends."""
    if at < len(text) and text[at] == "{":
        depth, k = 0, at
        while k < len(text):
            depth += (text[k] == "{") - (text[k] == "}")
            k += 1
            if not depth:
                break
        return text[at + 1 : k - 1], k
    if at < len(text) and text[at] == '"':
        k = at + 1
        while k < len(text) and (text[k] != '"' or text[k - 1] == "\\"):
            k += 1
        return text[at + 1 : k], k + 1
    m = re.compile(r"[^,}\s]*").match(text, at)
    return m[0], m.end()


def parse_bibtex(text: str) -> Iterator[dict[str, str]]:
    """Entries with their fields in lower case; url falls back on note, doi on url and note."""
    for m in re.finditer(r"@\s*(\w+)\s*\{", text):
        if m[1].lower() in SKIPPED:
            continue
        body, _ = _value(text, m.end() - 1)
        key, _, rest = body.partition(",")
        entry, at = {"type": m[1].lower(), "key": key.strip()}, 0
        while f := FIELD.match(rest, at):
            value, at = _value(rest, f.end())
            entry[f[1].lower()] = " ".join(re.sub(r"[{}]", "", value).split())
            at = rest.find(",", at) + 1 or len(rest)
        entry.setdefault("url", next(iter(re.findall(r"https?://\S+", entry.get("note", ""))), ""))
        doi = re.search(r"10\.\d{4,9}/[^\s\"<>,;]+", " ".join(entry.get(k, "") for k in ("doi", "url", "note")))
        entry["doi"] = doi[0].rstrip(".") if doi else ""
        yield entry


BIB = "path string, type string, key string, title string, author string, year string, url string, doi string"


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry of every file under ``path``, read by Spark so that any store will do."""

    def work(batches):
        names = [part.split()[0] for part in BIB.split(", ")]
        for batch in batches:
            rows = [{"path": p} | e for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for e in parse_bibtex(raw.decode("utf-8", "replace"))]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n, "") for r in rows], pa.string()) for n in names], names=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, BIB)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and whole text of every file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def front_matter(text: Column) -> tuple[Column, Column]:
    """Title and body of a text that may open with a block of settings; a byte-order mark is tolerated."""
    bare = F.regexp_replace(text, "^﻿", "")
    block = F.regexp_extract(bare, r"(?s)\A---\s*\n(.*?)\n---\s*(?:\n|\z)", 1)
    title = F.regexp_replace(F.regexp_extract(block, r"(?m)^title:\s*(.*?)\s*$", 1), "^[\"']|[\"']$", "")
    return F.nullif(title, F.lit("")), F.regexp_replace(bare, r"(?s)\A---\s*\n.*?\n---\s*(?:\n|\z)", "")


def reference_map(texts: DataFrame, key: str) -> DataFrame:
    """(key, name, filename) from lines ``name = filename``: comments and blanks skipped, the last line of a name wins."""
    lines = texts.select(key, F.posexplode(F.split("refs", "\n")).alias("n", "line")).where(~F.trim("line").startswith("#") & F.contains("line", F.lit("=")))
    at = F.instr("line", "=")
    pairs = lines.select(key, "n", F.trim(F.expr("substring(line, 1, instr(line, '=') - 1)")).alias("name"), F.trim(F.substring("line", at + 1, F.length("line"))).alias("filename"))
    return pairs.where("name <> '' and filename <> ''").groupBy(key, "name").agg(F.max_by("filename", "n").alias("filename"))


def numeric_citations(text: Column) -> Column:
    """Numbers of all bracketed groups such as [3,5-7]; a reversed or too long range rejects its group."""
    groups = F.regexp_extract_all(text, F.lit(r"\[(\d{1,3}(?:\s*[,;-]\s*\d{1,3})*)\]"), F.lit(1))

    def numbers(group: Column) -> Column:
        return F.transform(F.split(group, r"\s*[,;]\s*"), lambda p: F.struct(F.split_part(p, F.lit("-"), F.lit(1)).try_cast("int").alias("lo"), F.coalesce(F.nullif(F.split_part(p, F.lit("-"), F.lit(2)), F.lit("")).try_cast("int"), F.split_part(p, F.lit("-"), F.lit(1)).try_cast("int")).alias("hi")))

    sound = F.filter(F.transform(groups, numbers), lambda g: F.forall(g, lambda r: (r["lo"] <= r["hi"]) & (r["hi"] - r["lo"] <= 50)))
    return F.flatten(F.transform(F.flatten(sound), lambda r: F.sequence(r["lo"], r["hi"])))


def pandoc_keys(text: Column) -> Column:
    """Keys of citations such as [@key; @other, p. 3], in order, without repeats."""
    groups = F.regexp_extract_all(text, F.lit(r"\[([^\[\]]*@[^\[\]]*)\]"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"@([A-Za-z0-9][\w:.-]*\w|\w)"), F.lit(1)))))


def reflow(text: Column) -> Column:
    """Hyphenated line ends joined, single line breaks unwrapped."""
    return F.regexp_replace(F.regexp_replace(text, r"([A-Za-z])-\n([a-z])", "$1$2"), r"([^\n])\n([^\n])", "$1 $2")
