"""From scored candidates to a few selected cards, or deliberately none: windows over ``prompt_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scoring import reciprocal_rank_fusion, rounded
from tessera.tables import discard, materialize

LIMIT, THRESHOLD, GAP = 4, 40.0, 18.0
COLLAPSE = 64.0


def admission_reason(score: Column, strong: Column, families: Column, threshold: Column) -> Column:
    """Why a candidate is not admitted; null if it is."""
    low = F.concat(F.lit("below-threshold:"), score.cast("string"), F.lit("<"), threshold.cast("string"))
    return F.when(score < threshold, low).when(~strong & (families < 2), F.lit("insufficient-independent-evidence"))


def fuse(admitted: DataFrame, by: list[str], identity: str) -> DataFrame:
    """``rank_score`` from the ranks by ``raw_score`` and by ``score``."""
    rank = lambda c: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(c), identity))
    return admitted.withColumn("rank_score", reciprocal_rank_fusion(rank("raw_score"), rank("score")))


def comparator(identity: str, library: str | None = None) -> list[Column]:
    extra = [F.desc(library)] if library else []
    return [F.desc("rank_score"), F.desc("score"), F.desc("raw_score"), F.desc("priority_score"), *extra, F.asc(identity)]


def diversify(candidates: DataFrame, by: list[str], topic: str, order: list[Column]) -> DataFrame:
    """Lower the rank score of the n-th repeat of a topic by 12 % each, to 72 % at most."""
    repeat = F.row_number().over(Window.partitionBy(*by, topic).orderBy(*order)) - 1
    kept = F.greatest(F.lit(0.72), 1 - 0.12 * F.col("repeat"))
    return candidates.withColumn("repeat", repeat).withColumn("rank_score", F.when(F.col("repeat") > 0, rounded(F.col("rank_score") * kept)).otherwise(F.col("rank_score")))


def select_dynamic(candidates: DataFrame, by: list[str], order: list[Column], limit: int = LIMIT, threshold: float = THRESHOLD) -> DataFrame:
    """``selected`` and ``reason``: the first, strong anchors, and scores within GAP of the first, up to the limit.

    Needs ``score`` (at or above the threshold), ``strong_anchor`` and ``repeat``.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    top = F.first("score").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    fits = (F.row_number().over(w) == 1) | F.col("strong_anchor") | (F.col("score") >= F.greatest(F.lit(threshold), top - GAP))
    rows = candidates.withColumn("fits", fits)
    before = F.coalesce(F.sum(F.col("fits").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    suffix = F.when(F.col("repeat") > 0, "-after-diversity").otherwise("")
    reason = F.when(F.col("before") >= limit, F.concat(F.lit("post-selection:limit"), suffix)).when(~F.col("fits"), F.concat(F.lit("post-selection:confidence-gap"), suffix))
    return rows.withColumn("before", before).withColumn("reason", reason).withColumn("selected", F.col("reason").isNull()).drop("before", "fits")


NEAR_SCORE, PROJECT, ANY_LIBRARY = 8.0, 2, 1


def library_priority(scope: Column) -> Column:
    """A project's library comes before all others."""
    return F.when(scope == "project", PROJECT).otherwise(ANY_LIBRARY)


def _earlier_pairs(rows: DataFrame, similar: DataFrame, by: list[str]) -> DataFrame:
    """``prompt_id``, ``v`` and ``w``: places of candidates and of earlier ones of their prompt with the same id or alike."""
    both = similar.select("a", "b", *by).unionByName(similar.select(F.col("b").alias("a"), F.col("a").alias("b"), *by))
    later = rows.select("prompt_id", F.col("place").alias("v"), F.col("card_id").alias("a"), *by)
    earlier = rows.select("prompt_id", F.col("place").alias("w"), "card_id", *by)
    alike = later.join(both, ["a", *by]).join(earlier.withColumnRenamed("card_id", "b").hint("merge"), ["prompt_id", "b", *by])
    same = later.withColumnRenamed("a", "card_id").join(earlier.drop(*by).hint("merge"), ["prompt_id", "card_id"])
    return alike.select("prompt_id", "v", "w").unionByName(same.select("prompt_id", "v", "w")).where("w < v").distinct()


def collapse(candidates: DataFrame, similar: DataFrame, order: list[str], by: list[str] | None = None, rounds: list[int] | None = None) -> DataFrame:
    """Greedy collapse of near-duplicate cards per prompt: ``leader`` is the ``card_key`` that represents each.

    ``candidates``: prompt_id, card_key, card_id, score, library_priority and the columns of ``order`` (sorted
    ascending).  A card joins the first leader with its id or alike it; a card
    of a preferred library replaces the leader if it has the same id or a score near the leader's.  ``similar``: unordered
    pairs a, b of card ids of one card set, or of the sets that the columns ``by`` name, which candidates
    then have too.

    The greedy order is kept without walking through it: in each round, all candidates are decided whose earlier like ones are decided
    and whose possible leaders no undecided candidate in between may still replace.  Rounds are joins over the pairs of
    like candidates and grow with the longest chain of such pairs in ascending order, not with the candidates.
    ``rounds``, if given, collects how many were decided in each.
    """
    by = by or []
    place = F.row_number().over(Window.partitionBy("prompt_id").orderBy(*order, "card_key"))
    rows = candidates.select("prompt_id", "card_key", "card_id", "score", "library_priority", *by, place.alias("place"))
    pairs = materialize(_earlier_pairs(rows, similar, by), "collapse-pairs")
    if pairs.isEmpty():
        discard(pairs)
        return rows.select("prompt_id", "card_key", F.col("card_key").alias("leader"))
    ends = pairs.select("prompt_id", F.col("v").alias("place")).unionByName(pairs.select("prompt_id", F.col("w").alias("place"))).distinct()
    own = rows.join(ends.hint("merge"), ["prompt_id", "place"]).select("prompt_id", "place", "card_id", "score", "library_priority")
    null = lambda kind: F.lit(None).cast(kind)
    # leads: whether it is or was a leader; slot: the place of the first leader of its line; gone: the place of what replaced it
    state = materialize(own.withColumns({"leads": null("boolean"), "slot": null("int"), "gone": null("int"), "leader": null("int")}), "collapse-state")
    while True:
        open_ = state.where("leads is null")
        if open_.isEmpty():
            break
        v, w = open_.select("prompt_id", F.col("place").alias("v"), F.col("library_priority").alias("rank")), state.select("prompt_id", F.col("place").alias("w"), F.struct("slot", "place", "library_priority", "score", "card_id").alias("at"), "leads", "gone")
        met = pairs.join(v.hint("merge"), ["prompt_id", "v"]).join(w.hint("merge"), ["prompt_id", "w"])
        pending = met.where(F.col("rank") > F.col("at.library_priority")).groupBy("prompt_id", "w").agg(F.min("v").alias("next"))
        met = met.join(pending.hint("merge"), ["prompt_id", "w"], "left")
        waits = F.col("leads").isNull() | (F.col("leads") & F.coalesce(F.col("next") < F.col("v"), F.lit(False)))
        leads = F.coalesce(F.col("leads"), F.lit(False)) & F.coalesce(F.col("gone") > F.col("v"), F.lit(True))
        told = met.groupBy("prompt_id", F.col("v").alias("place")).agg(F.max(waits).alias("waits"), F.min(F.when(leads, F.col("at"))).alias("best"))
        ready = open_.drop("leads", "slot", "gone", "leader").join(told.hint("merge"), ["prompt_id", "place"], "left").where(~F.coalesce("waits", F.lit(False)))
        near = (F.col("card_id") == F.col("best.card_id")) | (F.col("score") >= F.col("best.score") - NEAR_SCORE)
        takes = F.coalesce((F.col("library_priority") > F.col("best.library_priority")) & near, F.lit(False))
        heads = F.col("best").isNull() | takes
        decided = ready.select("prompt_id", "place", heads.alias("heads"), F.when(takes, F.col("best.slot")).otherwise(F.col("place")).alias("new_slot"), F.when(heads, F.col("place")).otherwise(F.col("best.place")).alias("new_leader"), F.when(takes, F.col("best.place")).alias("over"))
        decided = materialize(decided, "collapse-decided")
        if rounds is not None:
            rounds.append(decided.count())
        out = decided.where("over is not null").select("prompt_id", F.col("over").alias("place"), F.col("new_leader").alias("by"))
        turned = state.join(decided.drop("over").hint("merge"), ["prompt_id", "place"], "left").join(out.hint("merge"), ["prompt_id", "place"], "left")
        columns = {"leads": F.coalesce("leads", "heads"), "slot": F.coalesce("slot", "new_slot"), "gone": F.coalesce("gone", "by"), "leader": F.coalesce("by", "leader", "new_leader")}
        following = materialize(turned.withColumns(columns).select(*state.columns), "collapse-state")
        discard(state)
        discard(decided)
        state = following
    heads = rows.select("prompt_id", F.col("place").alias("leader"), F.col("card_key").alias("leader_key"))
    named = state.select("prompt_id", "place", "leader").join(heads.hint("merge"), ["prompt_id", "leader"])
    discard(pairs)
    return rows.join(named.select("prompt_id", "place", "leader_key").hint("merge"), ["prompt_id", "place"], "left").select("prompt_id", "card_key", F.coalesce("leader_key", "card_key").alias("leader"))


NEGATIVE_REASONS, POSITIVE_REASONS = 8, 12


def compact_reasons(reasons: Column) -> Column:
    """The first of each (field, term, kind), then the NEGATIVE_REASONS most negative and the POSITIVE_REASONS most
    positive; equal weights keep their order.

    Reasons are sorted by what names them, so that repeats stand side by side.  Each step is bound by a lambda, which evaluates it once
    for a row: a column that is used twice would be found twice."""
    once = lambda value, use: F.get(F.transform(F.array(value), use), 0)
    named = lambda r: (r["field"], r["term"], r["kind"])
    # the hash decides nearly all comparisons; what it leaves open, the names do
    numbered = F.transform(reasons, lambda r, i: F.struct(F.xxhash64(*named(r)).alias("h"), F.struct(*named(r)).alias("k"), i.alias("i"), r.alias("r")))
    repeats = lambda x, before: (x["h"] == before["h"]) & (x["k"] == before["k"])
    first = lambda own: F.filter(own, lambda x, j: (j == 0) | ~repeats(x, F.get(own, j - 1)))

    def part(kept: Column, negative: bool, sign: int, n: int) -> Column:
        mine = F.filter(kept, lambda x: (x["r"]["weight"] < 0) if negative else (x["r"]["weight"] >= 0))
        ranked = F.sort_array(F.transform(mine, lambda x: F.struct((sign * x["r"]["weight"]).alias("w"), x["i"].alias("i"), x["r"].alias("r"))))
        return F.transform(F.slice(ranked, 1, n), lambda x: x["r"])

    both = lambda kept: F.concat(part(kept, True, 1, NEGATIVE_REASONS), part(kept, False, -1, POSITIVE_REASONS))
    return once(F.sort_array(numbered), lambda own: once(first(own), both))


def budget_prefix(rows: DataFrame, by: list[str], order: list[Column], text: str, budget: int) -> DataFrame:
    """The longest prefix of blocks that fits a budget of characters with two line breaks between blocks.

    Each block but the first takes two characters at least, so only the first rows of a group, which Spark cuts
    before the shuffle, can belong to it."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    rows = rows.withColumn("__place", place).where(F.col("__place") <= budget // 2 + 1).drop("__place")
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.length(text)).over(w) + 2 * (F.count("*").over(w) - 1)
    return rows.withColumn("used_chars", used).where(F.col("used_chars") <= budget)


