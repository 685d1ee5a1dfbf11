"""What a caller plugs in: model calls with retries, embedders, prompts, fetchers of citation graphs, ordered maps."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Throttled(Exception):
    """A call that may succeed later."""


class KeyRejected(Exception):
    """A call whose key is not accepted; it is tried again without one."""


def with_retries(call: Callable, attempts: int = 3, wait: float = 65.0, growth: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call`` tried up to ``attempts`` times while it is throttled, with growing waits; None if it fails all the same.

    The budget is the call's own: a paid call is not run again by the engine's task retries unless its task is lost.
    """

    def tried(*args, **named):
        for k in range(attempts):
            try:
                return call(*args, **named)
            except KeyRejected:
                if not named.get("key"):
                    return None
                named = {**named, "key": None}
            except Throttled:
                if k + 1 < attempts:
                    sleep(wait * growth**k)
            except Exception:  # noqa: BLE001 - any failure of a provider is an unanswered call
                return None
        return None

    return tried


def by_model(routes: dict[str, Callable], model: str) -> Callable:
    """The provider whose prefix begins the model's name; the longest one wins, "" is the fallback."""
    return routes[max((p for p in routes if model.startswith(p)), key=len)]


def embed(texts: DataFrame, cache: DataFrame, embedder: Callable[[list[str]], list[list[float]]], model: str) -> DataFrame:
    """cache_key, vector of every distinct text: from the cache, else from the embedder, a batch at a time.

    Keys are hashes of model and text, so new rows can be appended to the cache as they are.
    """
    keyed = texts.select(F.substring(F.sha1(F.concat_ws("\u001f", F.lit(model), "text")), 1, 16).alias("cache_key"), "text").dropDuplicates(["cache_key"])

    def work(batches):
        for batch in batches:
            vectors = embedder(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("cache_key"), pa.array(vectors, pa.list_(pa.float64()))], names=["cache_key", "vector"])

    missing = keyed.join(cache.select("cache_key"), "cache_key", "left_anti")
    known = cache.join(keyed.select("cache_key"), "cache_key", "left_semi").select("cache_key", "vector")
    return known.unionByName(missing.mapInArrow(work, "cache_key string, vector array<double>"))


def hashed_embedder(size: int = 16) -> Callable[[list[str]], list[list[float]]]:
    """An offline embedder: words counted at hashed places."""
    import zlib

    def vectors(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * size
            for word in (text or "").split():
                v[zlib.crc32(word.encode()) % size] += 1.0
            out.append(v)
        return out

    return vectors


def prompt_for(name: Column, backend: Column, prompts: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with ``template``: the override for the backend, else the prompt of that name for all of them.

    ``prompts`` has (name, backend, template), backend null for the general one.
    """
    general = prompts.where("backend is null").select(F.col("name").alias("__n"), F.col("template").alias("__general"))
    special = prompts.where("backend is not null").select(F.col("name").alias("__sn"), F.col("backend").alias("__sb"), F.col("template").alias("__special"))
    both = rows.join(general, name == F.col("__n"), "left").join(special, (name == F.col("__sn")) & (backend == F.col("__sb")), "left")
    return both.withColumn("template", F.coalesce("__special", "__general")).drop("__n", "__general", "__sn", "__sb", "__special")


def parallel_map(spark: SparkSession, items: list[str], call: Callable[[str], str | None], tasks: int = 4) -> list[str | None]:
    """``call`` over a bounded list, in tasks, with the answers in the list's order."""

    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([call(x) for x in batch.column(1).to_pylist()], pa.string())], names=["n", "out"])

    rows = spark.createDataFrame(list(enumerate(items)), "n long, item string").repartition(max(1, min(tasks, len(items))))
    return [r["out"] for r in sorted(rows.mapInArrow(work, "n long, out string").collect(), key=lambda r: r["n"])]


def counted(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The same rows, and a count of them and of failed ones that is there when an action has run."""
    seen = Observation(name)
    failed = F.count_if(F.col("raw").isNull()) if "raw" in rows.columns else F.count_if(F.lit(False))
    return rows.observe(seen, F.count(F.lit(1)).alias("done"), failed.alias("failed")), seen


EDGES = "paper string, direction string, neighbour string, title string, year int, ok boolean"


def citation_edges(papers: DataFrame, fetch: Callable, most: int = 1000, page: int = 500) -> DataFrame:
    """paper, direction, neighbour, title, year, ok: the neighbours of each (paper, direction), page by page.

    ``fetch(paper, direction, offset, limit)`` gives (rows, next offset or None), or None if the call failed; rows are
    (neighbour, title, year), those without a neighbour are skipped. What was read before a failure is kept; a failure
    at the first page is one row with ``ok`` false, an empty answer one row without a neighbour.
    """

    def neighbours(paper: str, direction: str) -> Iterator[tuple]:
        n, offset = 0, 0
        while offset is not None and n < most:
            got = fetch(paper, direction, offset, min(page, most - n))
            if got is None:
                if not n:
                    yield (paper, direction, None, None, None, False)
                    return
                break
            rows, offset = got
            for neighbour, title, year in rows:
                if neighbour and n < most:
                    n += 1
                    yield (paper, direction, neighbour, title, year, True)
            if not rows:
                break
        if not n:
            yield (paper, direction, None, None, None, True)

    def work(batches):
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_()]
        for batch in batches:
            rows = [r for p, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in neighbours(p, d)]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in EDGES.split(", ")])

    return papers.select("paper", "direction").mapInArrow(work, EDGES)


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first connector's neighbours, and the second's for papers where the first failed or gave none."""
    held = first.where("neighbour is not null")
    open_ones = first.select("paper", "direction").distinct().join(held.select("paper", "direction").distinct(), ["paper", "direction"], "left_anti")
    return held.withColumn("via", F.lit("first")).unionByName(second.where("neighbour is not null").join(open_ones, ["paper", "direction"], "left_semi").withColumn("via", F.lit("second")))


def fetch_all(rows: DataFrame, fetchers: dict[str, Callable[[str], str | None]]) -> DataFrame:
    """paper, via, outcome, filename of each (paper, via): what the fetcher of that name saved, or why it did not.

    A fetcher gives a file's name or None; one that fails sinks only its own row.
    """

    def one(paper: str, via: str) -> tuple[str, str | None]:
        if via not in fetchers:
            return "no_fetcher", None
        try:
            name = fetchers[via](paper)
        except Exception as e:  # noqa: BLE001 - any failure of a fetcher is its row's outcome
            return f"error: {e}", None
        return ("saved", name) if name else ("not_found", None)

    def work(batches):
        for batch in batches:
            got = [one(p, v) for p, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=["paper", "via", "outcome", "filename"])

    return rows.select("paper", "via").mapInArrow(work, "paper string, via string, outcome string, filename string")
