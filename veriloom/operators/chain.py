"""The chain that grounds claims in their cited sources, as stages over tables of judged rows.

Every call of a model is a row that ``judge.enrich`` answers; here the answers meet: extractions become passages,
judgements a verdict, parts of a claim rescue or flag it, picks of proofs are numbered, checked and audited. A stage
takes only the claims that the ones before it left open, so each is an anti-join and not a branch per claim.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from . import evidence, retrieve, sequential, windows

# How many rows, parts and probes each stage allows, and how a prompt asks for its answer.
POOL, PARTS, ROWS, ESCALATED, REPROBED, FRESH, ENTITIES = 8, 4, 12, 3, 2, 2, 2
ANSWER = "Return ONLY a JSON object"


def keep_extraction(text: Column, j: Column, claim: Column, source: Column) -> Column:
    """Is an extracted text a quote of its source? Decided in order: unusable, mapped, echo, verbatim, fragment.

    ``j`` is the sentence that it maps to, or -1. A text that nothing decides is an honest condensation and stays.
    """
    a, b = t.norm(text), t.norm(claim)
    echo = F.contains(b, a) | (sequential.sequence_ratio(a, b) >= 0.85)
    verbatim = F.contains(t.loose(source), t.loose(text)) | F.contains(t.charstream(source), t.charstream(text))
    return (
        F.when(t.unusable(text), False).when(j != -1, True).when(echo, False).when(verbatim, True)
        .when(evidence.unsourced_fragment(text, claim, source), False).otherwise(True)
    )


def extraction_passages(extracted: DataFrame, sentences: DataFrame) -> DataFrame:
    """claim, pid, j, sentence, passage of what a model extracted from the whole text of each cited source.

    ``extracted`` has (claim, pid, attempt, chunk, pos, text, j, cos, lex, keep). The second attempt counts where all
    chunks of the first gave nothing. Texts that the gate keeps are taken once (by sentence, else by wording), ranked
    by fused cosine and lexical weight, cut to the pool; the passage joins them bare, and with their neighbours only
    those of fewer than four words. ``sentences`` has (pid, j, win), the text around each sentence.
    """
    by = ["claim", "pid"]
    rows = extracted.withColumn("first", F.min("attempt").over(Window.partitionBy(*by))).where("attempt = first and keep")
    key = F.when(F.col("j") >= 0, F.col("j").cast("string")).otherwise(t.norm(F.col("text")))
    once = windows.first_of(rows.withColumn("key", key), [*by, "key"], F.col("chunk"), F.col("pos"))
    once = once.withColumn("ord", retrieve.rank(by, F.col("chunk"), F.col("pos")))
    for score in ("cos", "lex"):
        once = once.withColumn(score, F.when(F.col("j") >= 0, F.col(score)).otherwise(-1.0))
    best = retrieve.fuse(once, by, "ord").withColumn("n", retrieve.rank(by, F.round("rrf", 12).desc(), F.col("ord"))).where(F.col("n") < POOL)
    shown = best.join(sentences.select("pid", "j", "win"), ["pid", "j"], "left")
    part = F.when((F.col("j") >= 0) & (F.size(t.words(F.col("text"))) < 4), F.coalesce("win", "text")).otherwise(F.col("text"))
    made = shown.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("n", "j", "text", part.alias("part")))).alias("p"))
    return made.select(*by, F.get("p.j", 0).alias("j"), F.get("p.text", 0).alias("sentence"), F.array_join(F.array_distinct(F.col("p.part")), " ").alias("passage"))


def escalated_context(head: DataFrame, sentences: DataFrame, claims: DataFrame, by: list[str]) -> DataFrame:
    """The second round's passage of a source: its first two usable sentences of four, the six best, four of its claims.

    ``head`` has (by, j, text); ``sentences`` and ``claims`` (by, j, text, score), ranked for the claim. A sentence that
    the head already shows is left out.
    """
    opening = head.where(F.col("j") < 4).where(~t.degenerate(F.col("text"))).withColumn("n", retrieve.rank(by, F.col("j"))).where("n < 2")
    opening = opening.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(F.struct("j", "text")))["text"], " ").alias("head"))
    best = sentences.withColumn("n", retrieve.rank(by, F.col("score").desc(), F.col("j"))).where("n < 6").join(opening, by, "left")
    best = best.where(~t.degenerate(F.col("text")) & ~F.contains(F.coalesce("head", F.lit("")), F.col("text")))
    best = best.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(F.struct("n", "text")))["text"], " ").alias("best"))
    made = claims.withColumn("n", retrieve.rank(by, F.col("score").desc(), F.col("j"))).where("n < 4 and trim(text) <> ''")
    made = made.groupBy(*by).agg(F.concat(F.lit("Claims this source makes: "), F.array_join(F.array_sort(F.collect_list(F.struct("n", "text")))["text"], " ")).alias("made"))
    return opening.join(best, by, "full").join(made, by, "full").select(*by, F.concat_ws(" ", F.nullif("head", F.lit("")), "best", "made").alias("context"))


def evaluate(claims: DataFrame, judged: DataFrame, read: DataFrame, named: DataFrame, combined: DataFrame) -> DataFrame:
    """claim, verdict, method, reason, blocked: the first stage that decides a claim.

    ``judged`` (claim, pid, ord, supported, reason): the candidate sentences' verdicts; a claim without any has no
    sentences to judge. ``read`` (claim, pid, ord, supported, has_sentence, reason): the same after reading whole texts.
    ``named`` (claim, entity, pid, held): does the source's text name the entity; a source that misses one cannot prove
    the claim by itself. ``combined`` (claim, supported, reason): the sources' passages judged together, which counts
    where two sources have a sentence and together name every entity. ``blocked``: an entity that no source names.
    """
    direct = judged.groupBy("claim").agg(F.min_by("reason", F.when(F.col("supported"), F.col("ord"))).alias("direct"), F.bool_or("supported").alias("any"))
    sound = named.groupBy("claim", "pid").agg(F.bool_and("held").alias("sound"))
    rows = read.join(sound, ["claim", "pid"], "left").withColumn("sound", F.coalesce("sound", F.lit(True)))
    proved = F.col("supported") & F.col("sound")
    full = rows.groupBy("claim").agg(
        F.min_by("reason", F.when(proved, F.col("ord"))).alias("proof"), F.bool_or(proved).alias("proved"),
        F.bool_or(F.col("supported") & ~F.col("sound")).alias("dropped"), F.count_if("has_sentence").alias("n"),
        F.coalesce(F.min_by("reason", F.when(F.col("has_sentence"), F.col("ord"))), F.min_by("reason", "ord")).alias("why"),
    )
    whole = named.groupBy("claim", "entity").agg(F.bool_or("held").alias("held")).groupBy("claim").agg((~F.bool_and("held")).alias("blocked"))
    union = named.join(read.where("has_sentence").select("claim", "pid"), ["claim", "pid"]).groupBy("claim", "entity").agg(F.bool_or("held").alias("held"))
    union = union.groupBy("claim").agg(F.bool_and("held").alias("together"))
    absent = named.where("not held").groupBy("claim").agg(F.array_join(F.array_sort(F.collect_set("entity")), "; ").alias("names"))
    both = combined.select("claim", F.col("supported").alias("ok"), F.col("reason").alias("both"))
    all_of = claims.select("claim").join(direct, "claim", "left")
    for more in (full, whole, union, absent, both):
        all_of = all_of.join(more, "claim", "left")
    together = (F.col("n") >= 2) & F.coalesce("together", F.lit(True))
    guarded = F.col("dropped") | (F.col("n") >= 2)
    never = F.concat(F.lit("'"), F.coalesce("names", F.lit("")), F.lit("' is never mentioned in the cited source's text"))
    method = F.when(F.col("any").isNull(), "none").when(F.col("any"), "llm").when(F.col("proved"), "llm_fulltext").when(together, "combined_fulltext").otherwise("llm_fulltext")
    verdict = F.when(F.col("any") | (F.col("any").isNotNull() & F.col("proved")) | (F.col("any").isNotNull() & together & F.coalesce("ok", F.lit(False))), "supported").otherwise("unsupported")
    reason = (
        F.when(F.col("any").isNull(), "no_source_sentences").when(F.col("any"), F.col("direct")).when(F.col("proved"), F.col("proof"))
        .when(together, F.col("both")).when(guarded, never).otherwise(F.coalesce("why", F.lit("no supporting sentence found in any cited source")))
    )
    return all_of.select("claim", verdict.alias("verdict"), method.alias("method"), reason.alias("reason"), F.coalesce("blocked", F.lit(False)).alias("blocked"))


def component_rescue(open_claims: DataFrame, parts: DataFrame, probes: DataFrame, votes: DataFrame) -> DataFrame:
    """claim, found, missing, flip of claims judged unsupported after whole texts were read.

    ``parts`` (claim, k, part): at most four count. ``probes`` (claim, k, pid, ord, supported): each part sought alone in
    each source. Only where every part is found is the claim judged again on the union, ``votes`` (claim, vote_no,
    supported), and only a unanimous yes of three turns it. A claim of which no part is found has no row.
    """
    few = parts.where(F.col("k") < PARTS).join(open_claims.select("claim"), "claim", "left_semi")
    hits = probes.where("supported").groupBy("claim", "k").agg(F.min("ord").alias("hit"))
    rows = few.join(hits, ["claim", "k"], "left")
    list_of = lambda want: F.transform(F.array_sort(F.collect_list(F.when(want, F.struct("k", "part")))), lambda s: s["part"])
    sums = rows.groupBy("claim").agg(list_of(F.col("hit").isNotNull()).alias("found"), list_of(F.col("hit").isNull()).alias("missing")).where(F.size("found") > 0)
    yes = votes.groupBy("claim").agg((F.bool_and("supported") & (F.count("*") >= 3)).alias("yes"))
    return sums.join(yes, "claim", "left").select("claim", "found", "missing", ((F.size("missing") == 0) & F.coalesce("yes", F.lit(False))).alias("flip"))


def partial_support(claims: DataFrame, first: DataFrame, second: DataFrame, probes: DataFrame) -> DataFrame:
    """claim, escalated, votes, parts of supported claims whose sources do not carry all of it.

    ``first`` (claim, supported) judges openings and windows together; where it says no, ``second`` (claim, vote_no,
    supported, reason) has all votes on the escalated context, and only a unanimous no flags the claim. The parts that
    its reason names are then sought one by one: ``probes`` (claim, part, pid, supported); a flag all of whose parts
    are found after all is dropped. Without a second round the first one's no is the flag.
    """
    doubted = claims.select("claim").join(first.where("not supported"), "claim", "left_semi")
    tally = second.groupBy("claim").agg(F.count_if("supported").alias("yes"), F.count("*").alias("n"), F.min_by("reason", F.when(~F.col("supported"), F.col("vote_no"))).alias("reason"))
    rows = doubted.join(tally, "claim", "left").where("n is null or yes = 0")
    rows = rows.withColumn("named", F.when(F.col("n").isNotNull(), evidence.missing_parts(F.col("reason"))).otherwise(F.array().cast("array<string>")))
    found = probes.where("supported").groupBy("claim").agg(F.collect_set("part").alias("found"))
    rows = rows.join(found, "claim", "left").withColumn("parts", F.array_except("named", F.coalesce("found", F.array().cast("array<string>"))))
    rows = rows.where((F.size("named") == 0) | (F.size("parts") > 0))
    return rows.select("claim", F.col("n").isNotNull().alias("escalated"), F.coalesce(F.concat("n", F.lit("-"), "yes"), F.lit("")).alias("votes"), "parts")


def covering_set(parts: DataFrame, candidates: DataFrame, probes: DataFrame) -> DataFrame:
    """claim, part, ord, pid, sentence: each part of a claim with the sentences that prove it, null where none does.

    ``parts`` (claim, k, part, picks): numbers of candidates as a model writes them; ``candidates`` (claim, number, pid,
    sentence); ``probes`` (claim, part, pid, sentence): what seeking a part alone found. Picks that are no number of a
    candidate are dropped, twelve rows a claim are kept, and the first three parts without a pick may be found by probe.
    """
    sizes = candidates.groupBy("claim").agg(F.max("number").alias("most"))
    clean = F.filter(F.transform("picks", lambda p: F.regexp_replace(p, r"[\[\]\s]", "").try_cast("int")), lambda p: p.between(1, F.col("most")))
    rows = parts.where(F.trim("part") != "").join(sizes, "claim").withColumn("picks", F.coalesce(clean, F.array().cast("array<int>")))
    picked = rows.select("claim", "k", "part", F.posexplode("picks").alias("at", "number"))
    picked = picked.withColumn("ord", retrieve.rank(["claim"], F.col("k"), F.col("at"))).where(F.col("ord") < ROWS).join(candidates, ["claim", "number"])
    bare = rows.where(F.size("picks") == 0).select("claim", "k", "part").withColumn("n", retrieve.rank(["claim"], F.col("k")))
    first = probes.groupBy("claim", "part").agg(F.min_by(F.struct("pid", "sentence"), "pid").alias("p"))
    bare = bare.join(first, ["claim", "part"], "left").withColumn("p", F.when(F.col("n") < ESCALATED, F.col("p")))
    return picked.select("claim", "part", "ord", "pid", "sentence").unionByName(bare.select("claim", "part", (ROWS + F.col("n")).alias("ord"), "p.pid", "p.sentence"))


def specific_norm(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"['’]s\b", ""), "[-–'’]", " ")


def audit_picks(covered: DataFrame, uncovered: DataFrame, votes: DataFrame, proposed: DataFrame, specifics: DataFrame, probes: DataFrame) -> DataFrame:
    """claim, part, pick, state after one review of all picks of a claim: kept, found again, or uncovered.

    ``covered`` (claim, k, part, pick, sentence, specific), ``uncovered`` (claim, k, part). ``votes`` (claim, vote_no,
    part, keep) has the picks that each vote keeps of a part it reviewed; a part that names something specific needs two
    of three votes to keep a pick, others go by the first. A missing vote or an unreviewed part keeps its picks, a claim
    without a first vote keeps all. Of the parts that lost every pick two are sought again; then two ``proposed`` (claim,
    k, part) parts and two ``specifics`` (claim, k, part) of the claim that nothing shown holds, none of them nearly
    the wording of a known part. ``probes`` (claim, part) are the parts that a search finds.
    """
    known = votes.where("vote_no = 1").select("claim").distinct().withColumn("read", F.lit(True))
    rows = covered.join(known, "claim", "left")
    mine = votes.select("claim", "part", "vote_no", "keep")
    judged = rows.join(mine, ["claim", "part"], "left").groupBy("claim", "k", "part", "pick", "sentence", "specific", "read").agg(
        F.count_if(F.array_contains("keep", F.col("pick")) | F.col("vote_no").isNull()).alias("yes"), F.count("vote_no").alias("seen"),
        F.max(F.when(F.col("vote_no") == 1, F.array_contains("keep", F.col("pick")))).alias("first"),
    )
    by_votes = F.when(F.col("seen") == 0, 3).otherwise(F.col("yes") + 3 - F.col("seen")) >= 2
    stays = F.when(F.col("read").isNull(), True).when(F.col("specific"), by_votes).otherwise(F.coalesce("first", F.lit(True)))
    judged = judged.withColumn("stays", stays)
    kept = judged.where("stays")
    lost = judged.groupBy("claim", "k", "part").agg(F.bool_or("stays").alias("any")).where("not any")
    found = probes.select("claim", "part").distinct().withColumn("found", F.lit(True))

    def seek(some: DataFrame, most: int) -> DataFrame:
        some = some.withColumn("n", retrieve.rank(["claim"], F.col("k"), F.col("part"))).join(found, ["claim", "part"], "left")
        return some.select("claim", "part", F.lit(None).cast("int").alias("pick"), F.when((F.col("n") < most) & F.col("found"), "found").otherwise("uncovered").alias("state"), "n")

    def new_ones(some: DataFrame, parts: DataFrame, most: int) -> DataFrame:
        tokens = lambda c: F.array_distinct(t.words(F.lower(c)))
        pairs = some.join(parts.groupBy("claim").agg(F.collect_set("part").alias("parts")), "claim", "left").join(known, "claim", "left_semi")
        mine, least = tokens(F.col("part")), lambda p: F.size(F.array_intersect(tokens(F.col("part")), tokens(p))) / F.least(F.size(tokens(F.col("part"))), F.size(tokens(p)))
        fresh = pairs.where((F.size(mine) > 0) & ~F.exists(F.coalesce("parts", F.array().cast("array<string>")), lambda p: (F.size(tokens(p)) > 0) & (least(p) >= 0.6)))
        return seek(fresh.select("claim", "k", "part"), most).where(F.col("n") < most)

    again = seek(lost, REPROBED)
    parts = covered.select("claim", "part").unionByName(uncovered.select("claim", "part")).distinct()
    added = new_ones(proposed, parts, FRESH)
    shown = kept.select("claim", F.col("sentence").alias("x")).unionByName(parts.select("claim", F.col("part").alias("x"))).unionByName(added.where("state = 'uncovered'").select("claim", F.col("part").alias("x")))
    shown = shown.groupBy("claim").agg(specific_norm(F.array_join(F.collect_list("x"), " ")).alias("have"))
    silent = specifics.join(shown, "claim", "left").where(~F.contains(F.coalesce("have", F.lit("")), specific_norm(F.col("part")))).select("claim", "k", "part")
    state = lambda df, s: df.select("claim", "part", "pick", F.lit(s).alias("state"))
    still = uncovered.select("claim", "part", F.lit(None).cast("int").alias("pick"), F.lit("uncovered").alias("state"))
    out = state(kept, "kept").unionByName(still).unionByName(again.drop("n")).unionByName(added.drop("n"))
    return out.unionByName(new_ones(silent, parts, ENTITIES).drop("n")).distinct()


def rescue_by_arbiter(findings: DataFrame, sentences: DataFrame, guarded: DataFrame, votes: DataFrame) -> DataFrame:
    """claim, pid, passage, flip of unsupported claims for which an arbiter located quotes.

    ``findings`` (claim, pid, j): the located sentences; sources that do not name the claim's subject, ``guarded``
    (claim, pid), are skipped. The passage has two sentences on either side of each; ``votes`` as for a rescue.
    """
    live = findings.join(guarded, ["claim", "pid"], "left_anti")
    near = live.select("claim", "pid", F.explode(F.sequence(F.col("j") - 2, F.col("j") + 2)).alias("j")).distinct().join(sentences.select("pid", "j", "text"), ["pid", "j"])
    passages = near.groupBy("claim", "pid").agg(F.array_join(F.array_sort(F.collect_list(F.struct("j", "text")))["text"], " ").alias("passage"))
    yes = votes.groupBy("claim").agg((F.bool_and("supported") & (F.count("*") >= 3)).alias("yes"))
    return passages.join(yes, "claim", "left").select("claim", "pid", "passage", F.coalesce("yes", F.lit(False)).alias("flip"))


DATE_RULE = "Relative times in the passage resolve against the article's date, and the byline names its author."


def inject_date_rule(prompt: Column, passage: Column, rule: str = DATE_RULE) -> Column:
    """The rule goes before the demand for an answer, where the passage has a dated or bylined header; else nothing changes."""
    dated = F.contains(passage, F.lit("(article dated ")) | F.contains(passage, F.lit("(byline: ")) | F.contains(passage, F.lit("; article dated "))
    at = F.instr(prompt, ANSWER)
    inside = F.concat(F.substring(prompt, F.lit(1), at - 1), F.lit(rule + "\n\n"), F.substring(prompt, at, F.length(prompt)))
    return F.when(~dated, prompt).when(at > 0, inside).otherwise(F.concat(prompt, F.lit("\n\n" + rule)))


def rewrite_claims(claims: DataFrame, extracted: DataFrame, rewrites: DataFrame, votes: DataFrame) -> DataFrame:
    """claim, text, changed: a claim is replaced by a rewrite from its extractions that most of three votes support.

    ``extracted`` (claim, text): a claim without any stays as it is; ``rewrites`` (claim, rewrite); ``votes`` (claim,
    vote_no, supported).
    """
    held = extracted.select("claim").distinct()
    won = votes.groupBy("claim").agg((2 * F.count_if("supported") > F.count("*")).alias("won"))
    rows = claims.join(rewrites.join(held, "claim", "left_semi"), "claim", "left").join(won, "claim", "left")
    new = F.coalesce("won", F.lit(False)) & (F.coalesce(F.trim("rewrite"), F.lit("")) != "")
    return rows.select("claim", F.when(new, F.col("rewrite")).otherwise(F.col("text")).alias("text"), new.alias("changed"))
