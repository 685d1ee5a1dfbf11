"""Operators on literals: the edge cases that decide their meaning."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from veriloom.functions import text as t
from veriloom.operators import graph, judge, retrieve, sequential, windows
from veriloom.plans.text_queries import split_claims
from veriloom.sources import bibliography


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "c string").select(column(F.col("c"))).first()[0]


def test_marker_groups(spark):
    body = "First claim [[a]] [[a]]; second ([[b]]; [[c]]). Tail here.\n\n[[lost]]\n\nNext [[d]] ... [[e]]"
    got = split_claims(spark.createDataFrame([(1, body), (2, ""), (3, None)], "doc_id long, body string")).orderBy("claim").collect()
    assert [(r["text"], r["markers"]) for r in got] == [("First claim", ["a"]), ("second (", ["b", "c"]), ("Tail here.", []), ("Next", ["d", "e"])]


def test_sentences_and_predicates(spark):
    assert one(spark, "One. Two!  Three? ", t.sentences) == ["One.", "Two!", "Three?"]
    assert one(spark, " \n ", t.sentences) == []
    assert one(spark, "Review of Economic Studies.", t.reference_fragment) and not one(spark, "Eggs are cheap.", t.reference_fragment)
    assert one(spark, "Heart 2018;104:1756", t.citation_header) and one(spark, ".", t.degenerate) and not one(spark, "EU, 4.8% 4.", t.degenerate)
    assert one(spark, "They didn't, ever", t.has_negation) and one(spark, "the second of 5.8", t.key_tokens) == ["5.8", "second"]
    assert one(spark, "100,000 and 100 000 of 5.8 words", t.lexical_tokens) == ["100000", "100000", "5.8", "words"]
    assert one(spark, "It grew by 10 percent", t.inject_error) == "It grew by 37 percent" and one(spark, "Sales grew", t.inject_error) == "Sales shrank"
    assert one(spark, "nothing here", t.inject_error) is None


def test_floor_comes_after_the_cut(spark):
    rows = spark.createDataFrame([("c", k, x) for k, x in enumerate([0.5, 0.9, 0.5, 0.56])], "claim string, j int, cos double")
    assert {r["j"] for r in retrieve.top_with_floor(rows, ["claim"], "cos", "j").collect()} == {1, 3}
    one_row = retrieve.fuse(spark.createDataFrame([("c", 0, 0.1, 0.2)], "claim string, j int, cos double, lex double"), ["claim"], "j").first()
    assert abs(one_row["rrf"] - 0.4) < 1e-9


def test_evidence_link_has_one_fallback(spark):
    rows = spark.createDataFrame([("a", 0, 0.1), ("a", 1, 0.3), ("b", 0, 0.8), ("b", 1, 0.9), ("b", 2, 0.76), ("b", 3, 0.77)], "claim string, j int, cos double")
    got = sorted((r["claim"], r["j"]) for r in retrieve.link_evidence(rows, ["claim"], "cos", "j").collect())
    assert got == [("a", 1), ("b", 0), ("b", 1), ("b", 3)]


def test_votes(spark):
    rows = [(c, k + 1, v, f"r{k}") for c, votes in {"a": "TT", "b": "TFT", "c": "FTF", "d": "TTF", "e": "F"}.items() for k, v in enumerate(x == "T" for x in votes)]
    got = {r["claim"]: (r["supported"], r["tally"], r["reason"]) for r in judge.majority(spark.createDataFrame(rows, "claim string, vote_no int, supported boolean, reason string"), "claim").collect()}
    assert got == {"a": (True, "2-0", "r0"), "b": (True, "2-1", "r0"), "c": (False, "2-1", "r0"), "d": (True, "2-0", "r0"), "e": (False, "1-0", "r0")}


def test_proof_state(spark):
    rows = spark.createDataFrame([(True, ["a"], ["a"]), (True, ["a", "b"], ["a"]), (False, [], [])], "h boolean, u array<string>, c array<string>")
    assert [r[0] for r in rows.select(judge.proof_state(F.col("h"), F.col("u"), F.col("c"))).collect()] == ["full", "partial", None]


def test_truncated_answers(spark):
    raw = 'xx {"sentences": ["A whole sentence here.", "Another \\"quoted\\" one is here.", "cut of'
    assert one(spark, raw, judge.parse_sentences) == ["A whole sentence here.", 'Another "quoted" one is here.']
    assert one(spark, "```json\n[1, 2]\n```", judge.tolerant_json) == "[1, 2]"
    picks = spark.createDataFrame([("5",), ("[5]",), ("x",), ("99",)], "p string").select(judge.pick(F.col("p"), 9)).collect()
    assert [r[0] for r in picks] == [5, 5, None, None]


def test_enrichment_replays(spark):
    prompts = spark.createDataFrame([("m", "s1", 1, "p1"), ("m", "s2", 1, "p2")], "model string, prompt_sha string, vote_no int, prompt string")
    stored = spark.createDataFrame([("m", "s1", 1, "old")], "model string, prompt_sha string, vote_no int, raw string")
    got = {r["prompt_sha"]: r["raw"] for r in judge.enrich(prompts, stored, lambda ps: (p.upper() for p in ps)).collect()}
    assert got == {"s1": "old", "s2": "P2"}
    assert {r["prompt_sha"]: r["raw"] for r in judge.enrich(prompts, stored).collect()} == {"s1": "old", "s2": None}


def test_cycle_has_a_fallback_thesis(spark):
    nodes = spark.createDataFrame([(k,) for k in range(4)], "node long")
    roles = graph.roles(nodes, spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "src long, dst long"))
    assert {r["node"]: r["role"] for r in roles.collect()} == {0: "sub", 1: "sub", 2: "premise", 3: "aside"}
    assert [r["node"] for r in graph.theses(roles).collect()] == [1]
    none = graph.roles(nodes, spark.createDataFrame([], "src long, dst long"))
    assert graph.theses(none).count() == 0


def test_greedy_pairs_equal_the_scan(spark):
    rng = random.Random(4)
    pairs = list({(a, b): (a, b, round(rng.random(), 6)) for a, b in ((rng.randrange(40), rng.randrange(40, 80)) for _ in range(300))}.values())
    used, want = {}, set()
    for a, b, cos in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if used.get(a, 0) < 3 and used.get(b, 0) < 3:
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
            want.add((a, b))
    got = sequential.greedy_pairs(spark.createDataFrame(pairs, "a long, b long, cos double"), 3)
    assert {(r["a"], r["b"]) for r in got.collect()} == want


def test_ratio_and_blocks(spark):
    rows = [("abcd", "bcde"), ("bcde", "abcd"), (None, "x"), ("", "x")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(sequential.sequence_ratio("a", "b")).collect()]
    assert got[0] == SequenceMatcher(None, "abcd", "bcde").ratio() and got[2] is None
    block = [r[0] for r in spark.createDataFrame([("the cat sat", "the cat sat down"), ("the cat sat", "the cat lay"), ("", "x")], "a string, b string").select(sequential.longest_block("a", "b")).collect()]
    assert block[0] == 1.0 and abs(block[1] - 8 / 11) < 1e-9 and block[2] == 0.0


def test_fragments_and_blobs():
    assert sequential.merge_fragments(["USA, 74.5% 2.", "China, 14.1% 3.", "A long sentence with many words in it."]) == ["USA, 74.5% 2. China, 14.1% 3.", "A long sentence with many words in it."]
    assert sequential.merge_fragments(["One.", "A long sentence with many words in it."]) == ["One.", "A long sentence with many words in it."]
    assert all(len(x) <= 600 for x in sequential.wrap_long("word " * 500, [""])) and sequential.wrap_long("x" * 700, [])[0] == "x" * 300


def test_bibtex():
    text = '@comment{x}\n@article{smith2020, title = {A {Nested} Title}, author = "Smith, J. and Lee", year = 2020, note = {see https://doi.org/10.1234/ab.c.}}\n@book{k2, title={Other}}'
    got = list(bibliography.parse_bibtex(text))
    assert [g["key"] for g in got] == ["smith2020", "k2"] and got[0]["title"] == "A Nested Title" and got[0]["doi"] == "10.1234/ab.c" and got[0]["year"] == "2020"


def test_read_bibtex(spark, tmp_path):
    (tmp_path / "a.bib").write_text("@misc{k, title={T}, url={http://x}}")
    assert [r["key"] for r in bibliography.read_bibtex(spark, f"file://{tmp_path}").collect()] == ["k"]


def test_numeric_groups(spark):
    assert one(spark, "a [3,5-7] b [9-2] c [1-99] d [4]", bibliography.numeric_citations) == [3, 5, 6, 7, 4]
    assert one(spark, "[@a; @b2, p. 3] and [@a]", bibliography.pandoc_keys) == ["a", "b2"]


def test_spans_and_samples(spark):
    rows = spark.createDataFrame([(1, j) for j in (0, 3, 20, 21, 40)], "d int, j int")
    assert sorted((r["lo"], r["hi"]) for r in windows.spans(rows, ["d"], "j").collect()) == [(0, 3), (20, 21), (40, 40)]
