"""Names, citations, sources, connectors and maps on literals; sequential operators against plain scans."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from veriloom.functions import entities
from veriloom.functions import text as t
from veriloom.operators import chain, evidence, maps, providers, sequential
from veriloom.sources import citations, report, scans


def test_names():
    assert entities.specifics("He saw the United Nations of Oslo. In May it fell 4%.") == ["United Nations of Oslo", "May", "4%"]
    assert entities.specifics("It is from Oslo the") == ["Oslo"] and entities.specifics(None) == [] == entities.specifics("")
    assert entities.specifics('At "Hot Mum", Alex Massie said so in 1850 and 1850 and 1599') == ["Hot Mum", "Alex Massie", "1850"]
    assert entities.subject("University of Oklahoma staff") == ["university", "oklahoma"]
    assert entities.subject("The van Gogh house") == [] and entities.subject("Americans like it") == [] and entities.subject("") == []
    assert entities.subject("Marilyn Castonguay acts") == ["marilyn", "castonguay"]
    assert [e["display"] for e in entities.entities("Finland beat Costa Rica and Bonn. Costa Rica won 3%")] == ["finland", "Costa Rica"]


def test_citations():
    text = 'One (see Lee, 2020, 2021). "Two" (since 2020) by Roy and Poe (1999a) holds.'
    assert [(text[a:b], s, y) for a, b, s, y in citations.mentions(text)] == [("(see Lee, 2020, 2021)", "Lee", "2020"), ("(see Lee, 2020, 2021)", "Lee", "2021"), ("(1999a)", "Roy", "1999")]
    assert citations.mentions(None) == []
    body = 'He said "yes (a)." Dr. B. Lee et al. disagree (b), as in 3.5 and Fig. 2. Done'
    a, b = body.index("(a)"), body.index("(b)")
    assert citations.reinsert(body, [(a, a + 3, ["x", "x"]), (b, b + 3, ["y"])]) == 'He said "yes." [[x]] Dr. B. Lee et al. disagree, as in 3.5 and Fig. 2. [[y]] Done'
    assert citations.reinsert("plain", []) == "plain" and citations.reinsert("end (a)", [(4, 7, ["k"])]) == "end [[k]]"


def test_one_unresolved_mention_leaves_its_span(spark):
    index = spark.createDataFrame([("Lee", "2020", "k1", True), ("Roy", "2020", "k2", False), ("Poe", "2020", "k3", True), ("Poe", "2020", "k4", True)], "surname string, year string, key string, first boolean")
    texts = spark.createDataFrame([(1, "A (Lee 2020; Roy 2020)."), (2, "A (Lee 2020; Poe 2020)."), (3, None), (4, "A (LÉE 2020).")], "id long, text string")
    assert {r["id"]: r["text"] for r in citations.convert(texts, index, "id", "text").collect()} == {1: "A. [[k1]] [[k2]]", 2: "A (Lee 2020; Poe 2020).", 3: None, 4: "A. [[k1]]"}


def test_pages_and_files(spark, tmp_path):
    assert scans.page_text(None) == "" == scans.page_text("<p>two words</p>")
    assert scans.page_text("<div class='x menu'>one two three</div><p>and these three words</p></p></div>") == "and these three words"
    assert len(scans.page_text("<div>" * 5000 + "some words of text")) > 10
    (tmp_path / "a.pdf").write_bytes(b"one|two")
    (tmp_path / "b.pdf").write_bytes(b"bad")

    def extract(raw):
        if raw == b"bad":
            raise ValueError
        return raw.decode().split("|")

    got = scans.read_pdfs(spark, f"file://{tmp_path}/*.pdf", extract)
    assert [(r["page"], r["text"]) for r in got.orderBy("page").collect()] == [(1, "one"), (2, "two")]
    better = scans.read_pdfs(spark, f"file://{tmp_path}/*.pdf", extract, lambda raw: ["clean"], lambda text: 1.0 if "one" in text else 0.0)
    assert [r["text"] for r in better.collect()] == ["clean"]
    worse = scans.read_pdfs(spark, f"file://{tmp_path}/*.pdf", extract, lambda raw: ["one worse"], lambda text: float(len(text)))
    assert worse.count() == 2
    assert scans.tei_paragraphs("<broken") == []
    try:
        scans.load_bibliography(spark, "x.docx")
        raise AssertionError
    except ValueError as e:
        assert ".bib" in str(e)


def test_headline_runs_and_preamble(spark):
    run = "\n".join(f"Oslo Grows Again In Year{k}" for k in range(4))
    rows = spark.createDataFrame([(f"Source URL: x\n---\nA line that ends.\n{run}\nB line that ends.\n\n",), (run,), ("",), (None,)], "c string")
    got = [r[0] for r in rows.select(scans.clean_source(F.col("c"))).collect()]
    assert got == ["A line that ends.\nB line that ends.", run, "", None]


def test_retries():
    calls, waits = [], []

    def call(x, key="k"):
        calls.append(key)
        if key:
            raise providers.KeyRejected
        if len(calls) < 3:
            raise providers.Throttled
        return x

    assert providers.with_retries(call, 4, 5.0, 2.0, waits.append)(7, key="k") == 7 and calls == ["k", None, None] and waits == [10.0]
    assert providers.with_retries(lambda: 1 / 0)() is None
    assert providers.with_retries(call, 1, 0.0)(7, key="k") is None or len(calls) > 3
    assert providers.by_model({"": 1, "a": 2, "ab": 3}, "abc") == 3


def test_edges_of_one_paper(spark):
    pages = {0: ([("a", "t", 1), (None, "t", 1)], 2), 2: ([("b", "t", 1)], 4)}
    papers = spark.createDataFrame([("p", "citations")], "paper string, direction string")
    got = providers.citation_edges(papers, lambda paper, direction, offset, limit: pages.get(offset), page=2).collect()
    assert [(r["neighbour"], r["ok"]) for r in got] == [("a", True), ("b", True)]
    failed = providers.citation_edges(papers, lambda *a: None).collect()
    assert [(r["neighbour"], r["ok"]) for r in failed] == [(None, False)]
    capped = providers.citation_edges(papers, lambda paper, direction, offset, limit: ([(f"{offset}-{k}", "t", 1) for k in range(limit)], offset + limit), most=5, page=2)
    assert capped.count() == 5


def test_embedding_cache(spark):
    texts = spark.createDataFrame([("a b",), ("a b",), ("c",), (None,)], "text string")
    none = spark.createDataFrame([], "cache_key string, vector array<double>")
    first = providers.embed(texts, none, providers.hashed_embedder(4), "m").collect()
    assert len(first) == 3 and sorted(sum(r["vector"]) for r in first) == [0.0, 1.0, 2.0]

    def never(some):
        raise AssertionError(some)

    again = providers.embed(texts, spark.createDataFrame(first, "cache_key string, vector array<double>"), never, "m")
    assert {r["cache_key"] for r in again.collect()} == {r["cache_key"] for r in first}


def test_page_of_a_run(spark, tmp_path):
    claims = spark.createDataFrame([(2, "b<", "own", None), (1, "a", "supported", "why & how")], "ord int, text string, verdict string, reason string")
    omitted = spark.createDataFrame([(k, f"om{k}", k / 1000) for k in range(230)], "id int, text string, relevance double")
    report.write_page(claims, omitted, str(tmp_path / "x.html"), "T & t")
    page = (tmp_path / "x.html").read_text()
    assert page.index(">a<") < page.index("b&lt;") and "why &amp; how" in page and "30 more are not shown" in page and page.count("class='omitted'") == 200
    assert page.index("om229") < page.index("om215") < page.index("<details>") < page.index("om214")


def test_variants_against_all_pairs(spark):
    rng, words = random.Random(3), "costs rose sharply in the north while output did not fall anywhere else".split()
    claims = []
    for m in (1, 2):
        for k in range(25):
            w = list(words)
            for _ in range(rng.randrange(7)):
                w[rng.randrange(len(w))] = rng.choice(["prices", "never", "grew", "more"])
            claims.append((m, k, " ".join(w)))
    want = set()
    for m, a, x in claims:
        for n, b, y in claims:
            if m == n and a < b:
                lex = SequenceMatcher(None, x, y).ratio()
                negated = [any(w in ("not", "never") for w in s.split()) for s in (x, y)]
                if lex >= 0.75:
                    want.add((m, a, b, "strong" if lex >= 0.9 and negated[0] == negated[1] else "weak"))
    rows = spark.createDataFrame([(*c, None) for c in claims], "map long, ord int, text string, vector array<double>")
    got = maps.variant_pairs(rows, "map")
    assert {(r["map"], r["a"], r["b"], r["strength"]) for r in got.collect()} == want
    groups = {(r["map"], r["member"]): r["canonical"] for r in maps.variant_groups(got, "map").collect()}
    assert all(groups[m, a] == groups[m, b] for m, a, b, s in want if s == "strong") and all(c <= k for (_, k), c in groups.items())


def test_variants_in_tiles(spark, monkeypatch):
    """Blocks of a map meet each other, null and zero vectors and null texts included; two texts are compared once, however often they occur."""
    import numpy as np
    import pyarrow as pa

    rng, texts = random.Random(5), ["costs rose in the north", "costs rose in the south", "costs never rose in the north", "a", "", None]
    claims = [(m, k, rng.choice(texts), rng.choice([None, [0.0, 0.0], [1.0, rng.random()], [rng.random(), 1.0]])) for m in (1, 2) for k in range(40)]
    want = {}
    for m, a, x, v in claims:
        for n, b, y, w in claims:
            if m == n and a < b:
                lex = SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None
                cos = None if v is None or w is None else 0.0 if not any(v) or not any(w) else float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w))
                strong = lex is not None and lex >= 0.9 and ("never" in x) == ("never" in y)
                if strong or (lex or 0) >= 0.75 or (cos or 0) >= 0.93:
                    want[m, a, b] = ("strong" if strong else "weak", lex and round(lex, 3), cos and round(cos, 3))
    monkeypatch.setattr(maps, "TILE", 8)
    got = maps.variant_pairs(spark.createDataFrame(claims, "map long, ord int, text string, vector array<double>"), "map").collect()
    assert {(r["map"], r["a"], r["b"]): (r["strength"], r["lex"], r["cos"]) for r in got} == want and len(got) == len(want)

    calls = []
    monkeypatch.setattr(maps, "SequenceMatcher", lambda *a: calls.append(a) or SequenceMatcher(*a))
    n = 600
    table = pa.table({"map": [1] * n, "low": [0] * n, "high": [0] * n, "block": [0] * n, "ord": list(range(n)), "text": [f"text {k % 6}" for k in range(n)], "negated": [False] * n, "vector": pa.array([None] * n, pa.list_(pa.float64()))})
    assert maps._variant_tile("map")(table).num_rows == n * (n - 1) // 2 and len(calls) == 30


def test_variants_of_many_copies(spark, monkeypatch):
    """Copies of a text are paired by blocks, whatever their vectors; texts of other letters are not compared, and answers may be a column."""
    import numpy as np
    import pyarrow as pa

    rng, texts = random.Random(9), ["costs rose", "Costs  rose", "costs never rose", "zzz", None]
    vectors = [None, [], [0.0, 0.0], [1.0, None], [1.0, float("nan")], [1.0], [1.0, 0.1], [0.1, 1.0], [1.0, 0.3]]
    claims = [(m, k, rng.choice(texts), rng.choice(vectors)) for m in (1, 2, 3) for k in range(50 if m < 3 else 5)] + [(1, None, "zzz", None), (None, 1, "zzz", None)]
    norm = lambda v: 0.0 if None in v else float(np.linalg.norm(v))
    want = {}
    for m, a, x, v in claims:
        for n, b, y, w in claims:
            if m is not None and m == n and None not in (a, b) and a < b:
                lex = SequenceMatcher(None, *(" ".join(c.lower().split()) for c in (x, y))).ratio() if x is not None and y is not None else None
                cos = None if v is None or w is None or norm(v) != norm(v) or norm(w) != norm(w) else 0.0 if not norm(v) or not norm(w) else None if len(v) != len(w) else float(np.dot(v, w)) / norm(v) / norm(w)
                strong = lex is not None and lex >= 0.9 and ("never" in x) == ("never" in y)
                if strong or (lex or 0) >= 0.75 or (cos or 0) >= 0.93:
                    want[m, a, b] = ("strong" if strong else "weak", lex and round(lex, 3), cos and round(cos, 3))
    rows = spark.createDataFrame(claims, "map long, ord int, text string, vector array<float>")
    for size in (4, 1024):
        monkeypatch.setattr(maps, "TILE", size)
        pairs = maps.variant_pairs(rows, "map")
        got = pairs.collect()
        assert {(r["map"], r["a"], r["b"]): (r["strength"], r["lex"], r["cos"]) for r in got} == want and len(got) == len(want)

    s = (F.col("a") + F.col("b")) % 4
    relation = F.when(s == 0, "different_claim").when(s == 1, "restatement").when(s == 2, "nonsense")
    by_rows, by_column = (maps.confirm_variants(pairs, answers, "map").select("map", "a", "b", "strength", "relation").collect() for answers in (pairs.select("map", "a", "b", relation.alias("relation")), relation))
    assert sorted(map(str, by_rows)) == sorted(map(str, by_column)) and 0 < len(by_column) < len(got)

    calls, n = [], 600
    monkeypatch.setattr(maps, "SequenceMatcher", lambda *a: calls.append(a) or SequenceMatcher(*a))
    table = pa.table({"map": [1] * n, "low": [0] * n, "high": [1] * n, "block": [k % 2 for k in range(n)], "ord": list(range(n)), "text": ["abcdef"[k // 2 % 6] * 9 for k in range(n)], "negated": [False] * n, "vector": pa.array([None] * n, pa.list_(pa.float32()))})
    assert maps._variant_tile("map")(table).num_rows == 6 * 50 * 50 and not calls
    for low, high in ((0, 1), (1, 2)):  # the other block is empty
        assert maps._variant_tile("map")(table.slice(0, 1).set_column(1, "low", pa.array([low])).set_column(2, "high", pa.array([high])).set_column(3, "block", pa.array([1]))).num_rows == 0


def test_passage_of_short_extractions(spark):
    rows = [("c", "p", 0, 0, 0, "USA 74", 1, 0.9, 0.1, True), ("c", "p", 0, 0, 1, "A whole sentence of the text.", 4, 0.8, 0.9, True), ("c", "p", 0, 1, 0, "a whole sentence of the text.", 4, 0.8, 0.9, True), ("c", "p", 0, 1, 1, "dropped by the gate", 5, 1.0, 1.0, False), ("d", "p", 1, 0, 0, "An unmapped one of it.", -1, 0.0, 0.0, True)]
    extracted = spark.createDataFrame(rows, "claim string, pid string, attempt int, chunk int, pos int, text string, j int, cos double, lex double, keep boolean")
    sents = spark.createDataFrame([("p", 1, "Table: USA 74 Next.")], "pid string, j int, win string")
    got = {r["claim"]: (r["j"], r["passage"]) for r in chain.extraction_passages(extracted, sents).collect()}
    assert got["c"][1] in ("A whole sentence of the text. Table: USA 74 Next.", "Table: USA 74 Next. A whole sentence of the text.") and got["d"] == (-1, "An unmapped one of it.")


def test_snowball_equals_the_search(spark):
    rng = random.Random(8)
    relevance = {k: round(rng.random(), 6) for k in range(60)}
    cites = {(rng.randrange(60), rng.randrange(60)) for _ in range(400)}
    got = evidence.snowball(spark.createDataFrame(list(relevance.items()), "paper long, relevance double"), spark.createDataFrame(sorted(cites), "src long, dst long"), spark.createDataFrame([(0,), (1,)], "paper long"), 2, 3)
    seen, frontier = {0: 0, 1: 0}, [0, 1]
    for level in (1, 2):
        found = set()
        for p in frontier:
            near = sorted((d for s, d in cites if s == p and d not in seen), key=lambda d: (-relevance[d], d))
            found.update(near[:3])
        seen |= dict.fromkeys(found, level)
        frontier = sorted(found)
    assert {r["paper"]: r["level"] for r in got.collect()} == seen


def test_rematch_equals_the_scan(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(6))
    left, right = [(1, k, text(), "m") for k in range(12)], [(1, 100 + k, text(), rng.choice("mn")) for k in range(12)]
    free, want = {r[1]: r for r in right}, []
    for _, new, a, m in left:
        scored = [(SequenceMatcher(None, a, b).ratio() + 0.05 * (m == n), old) for old, (_, _, b, n) in sorted(free.items())]
        best = max(scored, key=lambda s: (s[0], -s[1]), default=None)
        if best and best[0] >= 0.6:
            want.append((new, best[1]))
            del free[best[1]]
    schema = "block long, {0} long, text string, markers string"
    got = sequential.fuzzy_rematch(spark.createDataFrame(left, schema.format("new_id")), spark.createDataFrame(right, schema.format("old_id")), "block")
    assert sorted((r["new_id"], r["old_id"]) for r in got.collect()) == want


def test_paragraphs_lose_white_space_only(spark):
    rows = spark.createDataFrame([("  0 one 0 \n\n1 two 1\n \n  ",)], "c string")
    assert rows.select(t.paragraphs(F.col("c"))).first()[0] == ["0 one 0", "1 two 1"]
