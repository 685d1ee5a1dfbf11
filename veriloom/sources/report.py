"""A self-contained page of a run: claims in document order, then what the text omits."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Omitted claims that are open at first, and that are in the page at all.
SHOWN, EMBEDDED = 15, 200
HEAD = "<!DOCTYPE html><html><head><meta charset='utf-8'><title>{title}</title></head><body><h1>{title}</h1>"


def escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def cards(claims: DataFrame) -> DataFrame:
    """ord, card of every claim (ord, text, verdict, reason)."""
    card = F.concat(F.lit("<div class='card "), escape(F.col("verdict")), F.lit("'><p>"), escape(F.col("text")), F.lit("</p><p class='why'>"), escape(F.coalesce("reason", F.lit(""))), F.lit("</p></div>"))
    return claims.select("ord", card.alias("card"))


def omitted_cards(omitted: DataFrame) -> DataFrame:
    """ord, card, open: the most relevant omitted claims (relevance, text, id), in a number that a page can hold."""
    best = omitted.orderBy(F.col("relevance").desc_nulls_last(), "id").limit(EMBEDDED)
    ranked = best.withColumn("ord", F.row_number().over(_all().orderBy(F.col("relevance").desc_nulls_last(), "id")) - 1)
    return ranked.select("ord", F.concat(F.lit("<div class='omitted'>"), escape(F.col("text")), F.lit("</div>")).alias("card"), (F.col("ord") < SHOWN).alias("open"))


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))  # at most EMBEDDED rows


def write_page(claims: DataFrame, omitted: DataFrame, path: str, title: str) -> None:
    """Write the page card by card as they come, and say how many omitted claims it leaves out."""
    total = omitted.count()
    with open(path, "w", encoding="utf-8") as out:
        out.write(HEAD.format(title=html.escape(title)))
        for row in cards(claims).orderBy("ord").toLocalIterator():
            out.write(row["card"] + "\n")
        rows = omitted_cards(omitted).orderBy("ord").collect()
        out.writelines(r["card"] + "\n" for r in rows if r["open"])
        out.write("<details>\n")
        out.writelines(r["card"] + "\n" for r in rows if not r["open"])
        out.write(f"</details><p>{max(0, total - EMBEDDED)} more are not shown.</p></body></html>")
