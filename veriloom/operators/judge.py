"""Decisions over judged rows: votes, verdicts, display states, triggers, scoring buckets.

A judgement is a row (claim, vote_no, supported, reason); a response that is null counts as a failed call, never as
agreement. ``supported`` as the JSON string "false" is read as false.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

MISSING = "source_file_missing"


def majority(votes: DataFrame, key: str, most: int = 3) -> DataFrame:
    """key, supported, tally, reason: up to three votes; the third only counts where the first two differ."""
    n_true = F.sum(F.when(F.col("supported"), 1).otherwise(0))
    early = votes.where("vote_no <= 2").groupBy(key).agg((F.min("supported") == F.max("supported")).alias("agreed"), F.count("*").alias("two"))
    used = votes.where(F.col("vote_no") <= most).join(early, key).where((F.col("vote_no") <= 2) | ~F.col("agreed") | (F.col("two") < 2))
    sums = used.groupBy(key).agg(n_true.alias("t"), F.count("*").alias("n"), F.min_by("reason", F.when(F.col("supported"), F.col("vote_no"))).alias("yes"), F.min_by("reason", F.when(~F.col("supported"), F.col("vote_no"))).alias("no"))
    won = F.col("t") * 2 > F.col("n")
    return sums.select(key, won.alias("supported"), F.concat(F.greatest("t", F.col("n") - F.col("t")), F.lit("-"), F.least("t", F.col("n") - F.col("t"))).alias("tally"), F.when(won, F.col("yes")).otherwise(F.col("no")).alias("reason"))


def unanimous(tally: Column, wanted: int = 3) -> Column:
    return tally == F.lit(f"{wanted}-0")


def proof_state(has_covering: Column, uncovered: Column, common: Column) -> Column:
    """partial, full, or null where no covering set was read."""
    return F.when(has_covering, F.when(F.size(F.array_except(uncovered, common)) > 0, "partial").otherwise("full"))


def confidence(verdict: Column, reason: Column, agrees: Column, partial: Column, proof: Column, split: Column, method: Column, cosine: Column, has_sentence: Column) -> Column:
    """high, medium, low, or null where a label would mean nothing."""
    supported = verdict == "supported"
    return (
        F.when(~verdict.isin("supported", "unsupported"), None)
        .when(~supported & F.coalesce(reason.startswith(MISSING), F.lit(False)), None)
        .when(F.coalesce(~agrees, F.lit(False)) | partial | (supported & (F.coalesce(proof, F.lit("")) == "partial")) | split, "low")
        .when(method.isin("combined", "combined_fulltext", "tail_rescue", "component_rescue"), "medium")
        .when(~supported & ~has_sentence, "medium")
        .when(supported & (method == "llm_fulltext") & (F.coalesce(cosine, F.lit(0.0)) < 0.75), "medium")
        .otherwise("high")
    )


def display_class(verdict: Column, scope: Column, proof: Column) -> Column:
    scoped = (verdict == "unsupported") & F.coalesce(scope.isin("methods", "concept", "related"), F.lit(False))
    return F.when(verdict == "own", "own").when(scoped, "scopedcite").when(verdict == "unsupported", "unsupported").when(F.coalesce(proof, F.lit("")) == "partial", "amber").otherwise("supported")


def arbiter_trigger(verdict: Column, reason: Column, ruled: Column, partial: Column, uncovered: Column, conflict: Column) -> Column:
    """Why a claim goes to the arbiter; null if it does not."""
    closed = ~verdict.isin("supported", "unsupported") | F.coalesce(reason.startswith(MISSING), F.lit(False)) | ruled
    return F.when(closed, None).when(verdict == "unsupported", "unsupported").when(partial, "partial_support").when(uncovered, "uncovered_components").when(conflict, "conflict_candidate")


def eligible_for_scope(verdict: Column, n_markers: Column, reason: Column, ruled: Column) -> Column:
    return (verdict == "unsupported") & (n_markers > 0) & ~F.coalesce(reason.startswith(MISSING), F.lit(False)) & ~ruled


def checkable(verdict: Column, reason: Column, ruled: Column, has_sentence: Column) -> Column:
    return verdict.isin("supported", "unsupported") & ~F.coalesce(reason.startswith(MISSING), F.lit(False)) & ~ruled & has_sentence


def bucket(verdict: Column, partial: Column) -> Column:
    return F.when(verdict != "supported", "not_supported").when(partial, "partially_supported").otherwise("supported")


def adjudicated(verdict: Column, partial: Column, action: Column, proofs: Column) -> Column:
    """The bucket with the arbiter's finding folded in; a null action changes nothing."""
    base, red = bucket(verdict, partial), verdict == "unsupported"
    return (
        F.when(action.isNull(), base)
        .when(action == "supported", "supported")
        .when((action == "wrong_or_insufficient_evidence") & proofs, "supported")
        .when((action == "add_citation_or_rewrite") & (~red | proofs), "partially_supported")
        .otherwise(base)
    )


def first_supported(judged: DataFrame, key: list[str]) -> DataFrame:
    """The first supported row in the judging order, else the first row with its reason."""
    order = F.struct((~F.col("supported")).alias("no"), "ord")
    return judged.groupBy(*key).agg(F.min_by(F.struct("ord", "supported", "reason"), order).alias("m")).select(*key, "m.*")


def primary_evidence(evidence: DataFrame, key: str) -> DataFrame:
    """Supported rows first, then the largest cosine, where null and 0 count as -1; then the order."""
    cos = F.coalesce(F.nullif(F.col("cosine"), F.lit(0.0)), F.lit(-1.0))
    order = F.struct(F.col("supported").cast("int").alias("s"), F.when(F.col("supported"), F.lit(0.0)).otherwise(cos).alias("c"), (-F.col("ord")).alias("o"))
    return evidence.groupBy(key).agg(F.max_by(F.struct("ord", "supported", "cosine"), order).alias("m")).select(key, "m.*")


def verdict(reused: Column, missing: Column, n_markers: Column, n_sentences: Column, supported: Column) -> Column:
    return F.when(reused.isNotNull(), reused).when((n_markers > 0) & missing, "unsupported").when(n_markers == 0, "own").when(n_sentences == 0, "unsupported").when(supported, "supported").otherwise("unsupported")


def lexical_judge(claim: Column, passage: Column) -> Column:
    """The offline judge: supported if every content token of the claim occurs in the passage."""
    tokens = F.array_distinct(t.lexical_tokens(claim))
    return F.size(F.array_except(tokens, t.lexical_tokens(passage))) == 0


def enrich(prompts: DataFrame, responses: DataFrame, provider: Callable[[Iterator[str]], Iterator[str | None]] | None = None) -> DataFrame:
    """prompt_sha, model, vote_no, raw: stored answers, and a provider's for the prompts that have none.

    Answers are keyed by (model, prompt_sha, vote_no); failed calls, and without a provider prompts that nothing
    answers, are null and must not be stored.
    """
    key = ["model", "prompt_sha", "vote_no"]
    if provider is None:
        return prompts.select(*key).join(responses, key, "left").select(*key, "raw")
    known = prompts.join(responses, key).select(*key, "raw")

    def call(batches):
        for batch in batches:
            raw = list(provider(iter(batch.column("prompt").to_pylist())))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in key], pa.array(raw, pa.string())], names=[*key, "raw"])

    missing = prompts.join(responses.select(*key), key, "left_anti").select(*key, "prompt")
    return known.unionByName(missing.mapInArrow(call, "model string, prompt_sha string, vote_no int, raw string"))


# Reading answers


def tolerant_json(raw: Column) -> Column:
    """The JSON in an answer: a fenced block, the whole, from the first [ to the last ], or from { to }; else null."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    square = F.regexp_extract(raw, r"(?s)(\[.*\])", 1)
    curly = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    tries = F.array(*[F.when(F.try_parse_json(c).isNotNull() & (F.trim(c) != ""), c) for c in (fenced, raw, square, curly)])
    return F.get(F.array_compact(tries), 0)


def parse_support(raw: Column) -> tuple[Column, Column]:
    """supported and reason of a judge's answer, also of one that is cut off."""
    body = tolerant_json(raw)
    flag = F.coalesce(F.get_json_object(body, "$.supported"), F.nullif(F.lower(F.regexp_extract(raw, r'(?i)"supported"\s*:\s*(true|false)', 1)), F.lit("")))
    reason = F.coalesce(F.get_json_object(body, "$.reason"), F.nullif(F.regexp_extract(raw, r'"reason"\s*:\s*"([^"]*)', 1), F.lit("")))
    supported = F.coalesce(F.lower(flag) == "true", F.lit(False))
    why = F.when(raw.isNull() | (raw == ""), "no response: treated as unsupported").when(flag.isNull(), "unparseable: treated as unsupported").otherwise(F.coalesce(reason, F.lit("judgment")))
    return supported, why


def parse_sentences(raw: Column) -> Column:
    """The quoted sentences of an answer; of one that is cut off, the complete ones."""
    whole = F.from_json(F.get_json_object(tolerant_json(raw), "$.sentences"), "array<string>")
    body = F.regexp_replace(raw, r'(?s)^.*"sentences"\s*:\s*\[', "")
    salvaged = F.transform(t.extract_all(body, r'"((?:[^"\\]|\\.)*)"', 1), lambda s: F.replace(s, F.lit('\\"'), F.lit('"')))
    kept = lambda c: F.filter(F.transform(c, lambda s: F.trim(s)), lambda s: ~t.degenerate(s))
    return F.when(F.size(kept(whole)) > 0, kept(whole)).otherwise(kept(salvaged))


def pick(value: Column, most: int) -> Column:
    """A pick given as 5, "5" or "[5]", or null if it is no number in range."""
    n = F.regexp_replace(value, r"[\[\]\s]", "").try_cast("int")
    return F.when(n.between(1, most), n)
