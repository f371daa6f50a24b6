"""Evidence that a prompt gives for a card: phrases, lexical support, signals, penalties.

All functions work on ``pairs``: a row per prompt and card that share a token (or a signal), with
``query_text`` (normalised) and ``query_tokens`` (distinct).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.scoring import noisy_or, rounded

#: Scores of an exact phrase, a partly covered phrase and a single word by field (fixed values).
EXACT = {"title": 38.0, "triggers": 48.0, "aliases": 46.0, "topics": 22.0}
PARTIAL = {"title": 32.0, "triggers": 52.0, "aliases": 48.0, "topics": 18.0}
SINGLE = {"title": 22.0, "triggers": 24.0, "aliases": 24.0, "topics": 12.0}
CAP, SUPPORT = 62.0, 0.22
POLICY = {"must": 4, "should": 2, "summary": 1, "off": 0}
RISK = {"high": 2, "medium": 1, "low": 0}
CONFIDENCE = {"high": 1, "medium": 0, "low": -1}


def field_evidence(field: str, phrases: Column, query_text: Column, query_tokens: Column) -> Column:
    """Struct of ``value``, ``strong`` and ``phrases`` (the first three with their ``weight`` and ``kind``): the best phrase
    and a part of the next two.

    ``phrases`` come from ``phrase_tokens`` of the card's field.  A phrase counts in full if it stands
    in the query, by its coverage if at least half of its tokens do, and a little if one of two does.
    """

    def judge(p: Column) -> Column:
        n = F.size(p["tokens"])
        multi = _many(p)

        def score(seen: Column) -> Column:
            hits, exact = seen["hits"], seen["exact"]
            coverage = hits / F.greatest(n, F.lit(1))
            short = exact & ~multi & (F.size(query_tokens) <= 2)
            value = (
                F.when(n == 0, 0.0)
                .when(exact & multi, EXACT[field] + F.least(F.lit(10.0), 2.0 * n))
                .when(short, max(SINGLE[field], 30.0 if field == "topics" else 44.0))
                .when(exact, SINGLE[field])
                .when((hits >= 2) & (coverage >= 0.5), PARTIAL[field] * coverage)
                .when((hits == 1) & (n == 2), PARTIAL[field] * 0.28)
                .otherwise(0.0)
            )
            near = (hits >= 2) & (coverage >= 0.58) if field in ("triggers", "aliases") else F.lit(False)
            kind = F.when(exact, "phrase-exact").otherwise("phrase-overlap")
            return F.struct(value.alias("value"), ((exact & multi) | short | near).alias("strong"), p["phrase"].alias("phrase"), kind.alias("kind"))

        seen = F.struct(F.size(F.array_intersect(p["tokens"], query_tokens)).alias("hits"), T.contains_phrase(query_text, query_tokens, p).alias("exact"))
        return F.get(F.transform(F.array(seen), score), 0)

    found = F.filter(F.transform(phrases, judge), lambda x: x["value"] > 0)
    # a stable order: equal values keep the order of their phrases
    ranked = F.array_sort(F.transform(found, lambda x, i: F.struct((-x["value"]).alias("v"), i.alias("i"), x["strong"].alias("strong"), x["phrase"].alias("phrase"), x["kind"].alias("kind"))))

    def total(r: Column) -> Column:
        support = F.aggregate(F.slice(r, 2, 2), F.lit(0.0), lambda acc, x: acc - x["v"] * SUPPORT)
        value = F.when(F.size(r) > 0, rounded(F.least(F.lit(CAP), support - F.get(r, 0)["v"]))).otherwise(0.0)
        best = F.transform(F.slice(r, 1, 3), lambda x: F.struct(x["phrase"].alias("term"), rounded(-x["v"]).alias("weight"), x["kind"].alias("kind")))
        return F.struct(value.alias("value"), F.coalesce(F.get(r, 0)["strong"], F.lit(False)).alias("strong"), best.alias("phrases"))

    return F.get(F.transform(F.array(ranked), total), 0)


def _many(p: Column) -> Column:
    """Whether a phrase has several terms."""
    return (F.size(p["tokens"]) >= 2) | (p["han"] >= 3)


def most_exact(field: str, p: Column) -> Column:
    """What a phrase gives at most where it stands in a prompt."""
    many = EXACT[field] + F.least(F.lit(10.0), 2.0 * F.size(p["tokens"]))
    return F.when(_many(p), many).otherwise(max(SINGLE[field], 30.0 if field == "topics" else 44.0))


def odd(p: Column) -> Column:
    """Phrases that may stand in a text whose tokens hold only some of theirs: Han runs, compounds, single letters."""
    return p["phrase"].rlike(f"[{T.HAN}._/-]") | F.exists(p["tokens"], lambda t: F.length(t) < 2)


def token_reach(field: str, p: Column) -> Column:
    """The most that one shared token of a phrase adds to the field's evidence, however many are shared."""
    n = F.size(p["tokens"])
    exact, some = most_exact(field, p), F.greatest(n, F.lit(1))
    per_token = F.greatest(exact / some, F.when(n >= 2, PARTIAL[field] / some).otherwise(0.0), F.when(n == 2, PARTIAL[field] * 0.28).otherwise(0.0))
    return F.when(odd(p), exact).otherwise(per_token)


def phrase_reach(partial: Column, hits: Column, n: Column, odd_: Column, exact: Column) -> Column:
    """The most that a phrase gives if ``hits`` of its ``n`` tokens are shared: it counts as exact as soon as it may be."""
    whole = F.when((hits == n) | (odd_ & (hits > 0)), exact).otherwise(0.0)
    part = F.when((hits >= 2) & (2 * hits >= n), partial * hits / n).when((hits == 1) & (n == 2), partial * 0.28).otherwise(0.0)
    return F.when(n == 0, 0.0).otherwise(F.greatest(whole, part))


def lexical_support(anchor_tokens: Column, query_tokens: Column) -> Column:
    """Two or more shared anchor tokens; never strong."""
    hits = F.size(F.array_intersect(anchor_tokens, query_tokens))
    return F.when(hits >= 2, F.least(F.lit(18.0), 6 + 2.5 * hits)).otherwise(0.0)


def signal_evidence(required: Column, positives: Column) -> Column:
    """``positives``: map of signal id to weight.  Any required signal that was seen is a strong anchor."""
    weights = F.transform(F.filter(required, lambda s: F.map_contains_key(positives, s)), lambda s: F.abs(F.element_at(positives, s)))
    return F.when(F.size(weights) > 0, F.least(F.lit(58.0), 40.0 + F.array_max(weights))).otherwise(0.0)


def exact_negatives(negatives: Column, said: Column) -> Column:
    """Negative triggers (``text``, normalised, with its number of tokens ``n``) that stand as terms in any of the prompt's
    texts (``text``, normalised, with its ``tokens``)."""
    inside = lambda n: F.exists(said, lambda m: T.contains_term(m["text"], m["tokens"], n["text"], n["n"]))
    return F.transform(F.filter(negatives, inside), lambda n: n["text"])


def fuzzy_penalty(negative_phrases: Column, query_tokens: Column) -> Column:
    """Negative phrases (arrays of their tokens of two characters or more) that the query covers by 72 % or more."""

    def near(own: Column) -> Column:
        hits = F.size(F.array_intersect(own, query_tokens))
        return (F.size(own) >= 2) & (hits >= 2) & (hits >= 0.72 * F.size(own))

    n = F.size(F.filter(negative_phrases, near))
    return F.when(n > 0, F.least(F.lit(45.0), 24.0 + 8.0 * (n - 1))).otherwise(0.0)


def evidence_score(values: Column, penalty: Column) -> Column:
    """Bounded score of all families; it doesn't depend on other cards."""
    return rounded(F.least(F.lit(100.0), F.greatest(F.lit(0.0), noisy_or(values) - penalty)))


def priority(policy: Column, risk: Column, confidence: Column) -> Column:
    lookup = lambda table, c: F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[c], F.lit(0))
    return lookup(POLICY, policy) + lookup(RISK, risk) + lookup(CONFIDENCE, confidence)
