"""Queries on small tables made so that a subset of the job would show."""

import pytest
from compare import assert_same
from pyspark.sql import functions as F

from veriloom.functions import text as t
from veriloom.plans import catalog
from veriloom.plans.text_queries import garble_scores
from veriloom.sources import links


@pytest.fixture(scope="module")
def many_items(sf_dir, tmp_path_factory):
    """sf0.001 with every benchmark item a second time, 40 ids further."""
    import duckdb

    folder = tmp_path_factory.mktemp("many_items")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{sf_dir}/documents.parquet'")
    con.execute(f"CREATE TABLE benchmark AS SELECT * FROM '{sf_dir}/benchmark.parquet' UNION ALL SELECT * REPLACE (item_id + 40 AS item_id) FROM '{sf_dir}/benchmark.parquet'")
    for name in ("documents", "benchmark"):
        con.execute(f"COPY {name} TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder), con


@pytest.mark.parametrize("name", ["r07_j02_lexical_idf", "r08_r09_r10_w04_hybrid_topk", "r13_map_to_sentence"])
def test_every_item_meets_its_source(spark, many_items, name):
    folder, con = many_items
    got = catalog.queries()[name](spark, folder)
    items = {r["item_id"] for r in got.select("item_id").distinct().collect()}
    assert items == {k + 40 for k in items if k < 40} | {k for k in items if k < 40}
    assert items == set(range(80)) or name.startswith("r13")
    assert_same(got, con, catalog.oracle_sql()[name])


def test_pdf_links_come_before_the_limit():
    menu = "".join(f'<a href="/menu{k}">x</a>' for k in range(6))
    page = menu + "<a class=k href='/a.PDF?x=1'>a</a><a href=b.pdf>b</a><a href=\"/a.PDF?x=1\">again</a><a href=ftp://h/c.pdf>c</a><meta content=/m.pdf name=citation_pdf_url><a href=/m.pdf>m</a>"
    assert links.pdf_links(page, "https://h.org/x/y") == ["https://h.org/m.pdf", "https://h.org/a.PDF?x=1", "https://h.org/x/b.pdf"]
    many = "".join(f"<a href=/{k}.pdf>x</a>" for k in range(9))
    assert links.pdf_links(many, "https://h.org") == [f"https://h.org/{k}.pdf" for k in range(4)]
    assert links.pdf_links(None, None) == [] == links.pdf_links(menu, "https://h.org") == links.pdf_links("<a href='http://[x/a.pdf'>", "https://h.org")


def test_author_rescues_a_venue_title(spark):
    title, text = "Proceedings of the National Academy of Sciences", "Eggs and hearts, by Drouin-Chartier and Lee."
    rows = spark.createDataFrame([(title, text, a) for a in ("Drouin-Chartier and others", "Smith and others", None)] + [("Short title", text, "Drouin")], "title string, text string, author string")
    assert [r[0] for r in rows.select(t.title_check(F.col("title"), F.col("text"), F.col("author"))).collect()] == ["ok", "mismatch", "mismatch", "unknown"]


def test_each_garble_score_reads_its_own_range(spark):
    plain = "some plain words of text " * 160  # 4,000 characters
    rows = {
        "plain": plain * 6, "collapsed": plain[:3000] + "severalwordsgluedtogether " * 192, "split": plain * 2 + "p articipants r esults " * 200,
        "late": plain * 5 + "p articipants " * 400, "few": "1" * 3990 + " " + plain + "p articipants " * 60, "spaced late": plain + "a b c d " * 500,
    }
    got = {r["k"]: r for r in garble_scores(spark.createDataFrame(list(rows.items()), "k string, text string")).collect()}
    assert {k for k, r in got.items() if r["space_collapsed"]} == {"collapsed"}
    assert {k for k, r in got.items() if r["line_split"]} == {"split", "few", "spaced late"}
    assert not any(r["letter_spaced"] for r in got.values())


def test_merge_meets_all_known_entries(spark, sf_dir):
    got = catalog.queries()["j10_p18_bibliography_merge"](spark, sf_dir).collect()
    n = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    assert len(got) == n and len({r["same_as"] for r in got}) > n / 2


@pytest.mark.parametrize("name", ["d07_roles", "d08_crux_distance", "d20_snowball", "d22_origin_trace"])
def test_graphs_have_the_tables_own_keys(spark, sf_dir, name):
    got = catalog.queries()[name](spark, sf_dir).collect()
    keys = {k for r in got for k in (r["found_via"].split(">") if name == "d20_snowball" else [r["claim"], r["origin"]] if name.startswith("d22") else [r["node"]])}
    assert max(int(k) for k in keys) >= 400
    if name == "d07_roles":
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
        assert keys == {r[c] for r in orders.collect() for c in ("o_orderkey", "o_custkey")}


def test_abbreviations_merge_as_in_sql(spark, tmp_path):
    import duckdb

    texts = ["Mit der Üst. lower here. End.", "An aſt. gap, fıg. two, figſ. three.", "Lee et al. found it. Smith ſt. too.", "élal. not glued. No. one", "See Fig. 3. al. 5", "", None]
    folder, con = str(tmp_path), duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    con.execute(f"COPY documents TO '{folder}/documents.parquet' (FORMAT parquet)")
    name = "g05_abbreviation_merge"
    assert_same(catalog.queries()[name](spark, folder), con, catalog.oracle_sql()[name])
    assert [r["text"] for r in catalog.queries()[name](spark, folder).where("doc_id = 0").orderBy("j").collect()] == ["Mit der Üst. lower here.", "End."]
