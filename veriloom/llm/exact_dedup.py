"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 hashes every text and marks, in a blocked Bloom filter kept as rows of 4 KB bitmap pages, the slots that
two or more rows have set. Pass 2 probes each row: a row with a slot that nobody else has set is unique for
certain and passes straight through; only the others shuffle and are grouped by their digest.

Defined cases: null text counts as empty, empty texts are equal to each other; repeated rows (same doc_id and
text) keep exactly one of them; a null doc_id comes after all others; an empty table gives an empty result;
other columns, whatever their names, pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import build, filter_pages, probe
from .common import join_groups, materialize, text_or_empty

def text_digest(text: Column) -> Column:
    """SHA-256 in hex of the text without ASCII white space."""
    return F.sha2(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""), 256)


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points stays, then the smallest doc_id.
    """
    text = text_or_empty()
    digests = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.unhex(text_digest(text)).alias("digest"),
            F.length(text).alias("points"),
            F.monotonically_increasing_id().alias("row"),
        ).withColumn("h", F.xxhash64("digest")),
        "digests",
    )
    total = digests.count()
    pages = filter_pages(total)
    probed = probe(digests, "h", pages, build(digests, "h", pages, 2), "hit")
    order = F.struct("points", F.bitwise_not("doc_id").alias("low"), F.bitwise_not("row").alias("first"))
    groups = (
        probed.where("hit").groupBy("digest").agg(F.max(order).alias("best"), F.count("*").alias("size")).where("size > 1")
        .select("digest", F.bitwise_not("best.low").alias("keep_id"), F.bitwise_not("best.first").alias("keep_row"), "size")
    )
    maybe = join_groups(probed.where("hit").select("doc_id", "digest", "row"), groups, "digest", "size", total)
    alone = probed.where("not hit").select("doc_id", "digest", "row").withColumns(
        {"keep_id": F.col("doc_id"), "keep_row": F.col("row"), "size": F.lit(1).cast("long")}
    )
    return maybe.unionByName(alone).select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.coalesce("keep_row", "row") == F.col("row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stay after exact deduplication.

    Whole rows shuffle only where the filter says that their text may repeat; there the best row of each
    digest is found by an aggregate with partial results, so a hot group costs one row a task.
    """
    whole = docs.select(F.struct("*").alias("row"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    hashed = whole.withColumns({"digest": F.unhex(text_digest(text)), "points": F.length(text)}).withColumn("h", F.xxhash64("digest"))
    total = docs.count()
    pages = filter_pages(total)
    bitmaps = materialize(build(hashed, "h", pages, 2), "bloom")
    probed = probe(hashed, "h", pages, bitmaps, "hit")
    order = F.struct("points", F.bitwise_not(F.col("row.doc_id").cast("long")), F.xxhash64(F.to_json("row")))
    best = probed.where("hit").groupBy("digest").agg(F.max_by("row", order).alias("row"))
    return probed.where("not hit").select("row").unionByName(best.select("row")).select("row.*")
