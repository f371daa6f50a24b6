"""Card similarity: set pairs by a token join, and the weighted similarity of two cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.scoring import jaccard, overlap, rounded

HINT, COLLAPSE, LESSON_TOKENS = 52.0, 64.0, 120


def set_pairs(rows: DataFrame, key: str, tokens: str, least: float = 0.0) -> DataFrame:
    """Pairs a < b of rows that share a token, with ``shared``, ``jaccard`` and ``overlap``; with ``least``, pairs of that
    Jaccard or more only.

    Shared tokens are counted by an equi-join on the token, so disjoint rows never meet.  A pair of Jaccard ``least``
    shares one of the first n - ceil(least * n) + 1 tokens of each, rarest first, so with ``least`` only those prefixes are
    joined and common tokens bring few pairs together; whole sets are compared after that.
    """
    sets = rows.select(F.col(key).alias("k"), F.array_distinct(tokens).alias("s"))
    held = sets.select("k", F.explode("s").alias("token"))
    if least <= 0:
        sizes = sets.select("k", F.size("s").alias("size"))
        shared = held.alias("x").join(held.alias("y"), "token").where("x.k < y.k").groupBy(F.col("x.k").alias("a"), F.col("y.k").alias("b")).agg(F.count("*").alias("shared"))
        both = shared.join(sizes.select(F.col("k").alias("a"), F.col("size").alias("na")), "a").join(sizes.select(F.col("k").alias("b"), F.col("size").alias("nb")), "b")
    else:
        ranked = held.join(held.groupBy("token").agg(F.count("*").alias("df")), "token").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
        n = F.size("t")
        prefix = F.slice("t", F.lit(1), (n - F.ceil(F.lit(least) * n - 1e-9) + 1).cast("int"))
        short = ranked.select("k", n.alias("n"), F.explode(prefix).alias("x")).select("k", "n", "x.token")
        near = short.alias("x").join(short.alias("y"), "token").where((F.col("x.k") < F.col("y.k")) & (F.least("x.n", "y.n") >= least * F.greatest("x.n", "y.n") - 1e-9))
        pairs = near.select(F.col("x.k").alias("a"), F.col("y.k").alias("b")).distinct()
        both = pairs.join(sets.select(F.col("k").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("k").alias("b"), F.col("s").alias("sb")), "b")
        both = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("shared"), F.size("sa").alias("na"), F.size("sb").alias("nb"))
    found = both.select("a", "b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"), (F.col("shared") / F.least("na", "nb")).alias("overlap"))
    return found.where(F.col("jaccard") >= least) if least > 0 else found


#: Components of a card's similarity and their weights (fixed values); the first three count by Jaccard, the next two by overlap.
WEIGHTS = {"title": 0.30, "routing": 0.34, "lesson": 0.14, "triggers": 0.22, "topics": 0.10, "category": 0.08}
_BY_JACCARD, _BY_OVERLAP = ("title", "routing", "lesson"), ("triggers", "topics")


def _features(cards: DataFrame) -> DataFrame:
    """A row for each member of each component of a card: ``part``, ``token`` and ``tail``, its class in the order of features."""
    one = lambda n, tail: lambda v: F.struct(F.lit(n).alias("part"), v.alias("token"), tail(v).alias("tail"))
    plain, last = (lambda v: F.lit(0)), (lambda v: F.lit(1))
    routing = lambda v: F.when(F.array_contains(T.tokens(F.col("card.category")), v), 2).otherwise(0)
    tails = {"routing": routing, "lesson": last}
    members = [F.transform(F.col(f"card.{c}"), one(n, tails.get(c, plain))) for n, c in enumerate((*_BY_JACCARD, *_BY_OVERLAP))]
    category = F.when(F.col("card.category") != "", F.array(one(5, lambda v: F.lit(2))(F.col("card.category")))).otherwise(F.array())
    # one id may stand for several cards (of several libraries), which are told apart by what they hold
    own = cards.dropDuplicates(["k", "place", "card"]).withColumn("uid", F.struct("k", F.xxhash64("card").alias("hash")))
    return own.select("uid", "place", F.inline(F.concat(*members, category)))


def candidate_pairs(cards: DataFrame, least: float) -> DataFrame:
    """Pairs ``a`` < ``b`` of cards (``k``, ``place``, ``card`` as ``profile`` gives it) of one place that may be alike by ``least``.

    Features stand in one order: titles, routes and phrases from the rarest on, then lessons, then what comes from
    categories.  A card's prefix ends where all features behind it together can't reach ``least``, and a pair that does
    reach it shares its first common feature in both prefixes.  So only prefixes are joined, and of those only places
    behind which both cards still hold enough.  Cards that have nothing but a category in common never meet.
    """
    need = (least - 0.005) / 100 - 1e-9  # scores are rounded to hundredths
    held = _features(cards)
    order = held.groupBy("place", "part", "token").agg(F.count("*").alias("df"), F.max("tail").alias("class"))
    ranked = held.drop("tail").join(order, ["place", "part", "token"])
    own = Window.partitionBy("place", "uid")
    rest = own.orderBy("class", "df", "part", "token").rowsBetween(0, Window.unboundedFollowing)
    names = list(WEIGHTS)
    counts = {f"r{n}": F.sum((F.col("part") == n).cast("int")).over(rest) for n in range(6)}
    counts |= {f"n{n}": F.sum((F.col("part") == n).cast("int")).over(own) for n in range(6)}
    placed = ranked.withColumns(counts)

    def reach(shared, sizes) -> Column:
        """The most that ``shared`` common members of each component give."""
        total = F.lit(0.0)
        for n, name in enumerate(names):
            s = shared(n)
            if name == "category":
                total = total + F.when(s > 0, WEIGHTS[name]).otherwise(0.0)
            else:
                total = total + F.when(s > 0, WEIGHTS[name] * sizes(n, s)).otherwise(0.0)
        return total

    alone = reach(lambda n: F.col(f"r{n}"), lambda n, s: s / F.col(f"n{n}") if n < 3 else F.lit(1.0))
    short = placed.where(alone >= need).drop("df", "class")
    x, y = short.alias("x"), short.alias("y")
    both = reach(lambda n: F.least(f"x.r{n}", f"y.r{n}"), lambda n, s: s / (F.col(f"x.n{n}") + F.col(f"y.n{n}") - s) if n < 3 else s / F.least(f"x.n{n}", f"y.n{n}"))
    met = x.join(y, ["place", "part", "token"]).where((F.col("x.uid.k") < F.col("y.uid.k")) & (both >= need))
    return met.select(F.col("x.uid.k").alias("a"), F.col("y.uid.k").alias("b")).distinct()


def similar_pairs(cards: DataFrame, least: float) -> DataFrame:
    """``a`` < ``b`` and ``score`` of all pairs of cards (``k``, ``place``, ``card``) of one place that are alike by ``least`` (above 0) or more."""
    pairs = candidate_pairs(cards, least)
    for end, name in (("a", "x"), ("b", "y")):
        pairs = pairs.join(cards.select(F.col("k").alias(end), F.col("card").alias(name)), end)
    return pairs.select("a", "b", profile_similarity(F.col("x"), F.col("y")).alias("score")).where(F.col("score") >= least)


def find_similar(cards: DataFrame, k: int = 3, threshold: float = HINT) -> DataFrame:
    """The ``k`` most similar other cards of each card, from ``threshold`` on: ``a``, ``b``, ``score`` and ``rank``."""
    fields = ("title", "category", "triggers", "topics", "summary", "rule", "body")
    profiles = cards.select(F.col("card_id").alias("k"), F.lit("").alias("place"), profile({c: F.col(c) for c in fields}).alias("card"))
    scored = similar_pairs(profiles, threshold)
    both = scored.unionByName(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))).where(F.col("rank") <= k)


def _lowered(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.lower(F.trim(v))), lambda v: v != ""))


def profile(c: dict[str, Column]) -> Column:
    """What a card is compared by: tokens and lower-case phrases, made once for each card."""
    none = F.array().cast("array<string>")
    lists = F.flatten(F.transform(F.concat(F.coalesce(c["triggers"], none), F.coalesce(c["topics"], none)), T.tokens))
    lesson = F.slice(F.array_distinct(F.concat(T.tokens(c["summary"]), T.tokens(c["rule"]), T.tokens(c["body"]))), 1, LESSON_TOKENS)
    return F.struct(
        T.tokens(c["title"]).alias("title"),
        F.array_distinct(F.concat(lists, T.tokens(c["category"]))).alias("routing"),
        lesson.alias("lesson"),
        _lowered(c["triggers"]).alias("triggers"),
        _lowered(c["topics"]).alias("topics"),
        F.lower(F.trim(F.coalesce(c["category"], F.lit("")))).alias("category"),
    )


def profile_similarity(a: Column, b: Column) -> Column:
    """0..100 from two cards' profiles."""
    total = F.lit(0.0)
    for name in _BY_JACCARD:
        total = total + WEIGHTS[name] * jaccard(a[name], b[name])
    for name in _BY_OVERLAP:
        total = total + WEIGHTS[name] * overlap(a[name], b[name])
    total = total + F.when((a["category"] != "") & (a["category"] == b["category"]), WEIGHTS["category"]).otherwise(0.0)
    return rounded(F.least(F.lit(1.0), total) * 100)


def card_similarity(left: dict[str, Column], right: dict[str, Column]) -> Column:
    """0..100 from title, category, triggers, topics, summary, rule and body of two cards."""
    return profile_similarity(profile(left), profile(right))
