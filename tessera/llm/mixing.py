"""Mixing sources to target weights by Pareto order sampling.

Source targets fill up by weight under a cap of ``MAX_COPIES`` times the source's words (water
filling).  Within a source the expected copies of a document follow its propensity (the binary
digits of its size, so longer documents are somewhat likelier) up to the cap.  The whole part of the
expectation is allocated for certain; the fraction is its inclusion probability in a sample whose
size in words is what the certain copies leave of the target.  Documents are ranked by random odds
divided by inclusion odds, and taken in that order while their middle lies within the sample.

The cut of a source is found without sorting the source in one task: words are summed by
``BUCKETS`` buckets of the rank, a window over bucket sums finds the bucket where the sample ends,
and only that bucket's rows are ranked.

Defined cases: null texts have size 0; a null source is a source of its own and comes last; rows
with equal id and size share rank and fate; a null id ranks like an id named ``null``; an empty
table gives an empty result; without words all targets are 0; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table

QUERY = "op6_mixing"

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_COPIES = 2
SEED = "mix"
BUCKETS = 16384
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _fill(rows: DataFrame, by: list[str], budget: Column, amount: Column, weight: Column, order: list[Column]) -> DataFrame:
    """Water filling within ``by``: ``level`` so that amount * min(MAX_COPIES, ...) sums up to the budget.
    ``amount`` is a row's words, ``weight`` its part of the level; ``order`` sorts by when rows meet the cap."""
    w = Window.partitionBy(*by)
    before = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    capped_before = F.coalesce(F.sum(amount).over(before), F.lit(0)) * MAX_COPIES
    rest = F.sum(weight).over(w) - F.coalesce(F.sum(weight).over(before), F.lit(0))
    return rows.withColumn("level", F.when(rest > 0, (budget - capped_before) / rest))


def _numbered(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """``skey``, ``source_size`` and ``weight`` of each source; weights repeat along the sources' order.

    Sources are dealt to ranges by name, and a range's numbers begin behind those of the ranges before it."""
    sources = sizes.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    ranges = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(sources.repartitionByRange(ranges, F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()), "mixing-ranges")
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = counts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    number = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1 + F.col("offset")
    weight = F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int")).cast("long")
    return ranged.join(offsets, "part").select("skey", "source_size", weight.alias("weight"))


def _level(sources: DataFrame, share: float) -> tuple[float | None, float | None]:
    """The level that fills the sources to ``share`` of all words, and the words for each weight at which sources
    stop meeting their cap; nothing where all do.

    Sources are summed by classes of words for each weight (256 for each power of two), a window over the classes finds
    the one where caps end, and another over that class's distinct values finds the place."""
    per = F.col("source_size") / F.col("weight")
    octave = F.when(per > 0, F.floor(F.log2(per) * 256)).otherwise(F.lit(-(1 << 40)))
    known = sources.select("source_size", "weight", per.alias("per"), octave.alias("class"))

    def summed(rows: DataFrame, by: str, words: Column, weight: Column, budget: Column) -> DataFrame:
        """Level and whether the cap is met at the smallest value of each group, given the words and weight of earlier rows."""
        sums = rows.groupBy(by).agg(F.sum("source_size").alias("words"), F.sum("weight").alias("parts"), F.min(F.struct("per", "weight", "source_size")).alias("first"))
        earlier = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumns({"used": words + F.coalesce(F.sum("words").over(earlier), F.lit(0)), "left": weight - F.coalesce(F.sum("parts").over(earlier), F.lit(0))})
        level = (budget - F.col("used") * MAX_COPIES) / F.col("left")
        return sums.withColumn("level", level).withColumn("capped", F.col("first.weight") * level >= MAX_COPIES * F.col("first.source_size"))

    whole = known.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("parts")).first()
    if not whole["parts"]:
        return None, None
    budget = F.lit(share) * F.lit(whole["words"])
    classes = summed(known, "class", F.lit(0), F.lit(whole["parts"]), budget)
    classes = materialize(classes, "mixing-levels")
    edge = classes.where("capped").orderBy(F.desc("class")).first()
    open_ = classes.where("not capped").orderBy("class").first()
    if edge is not None:
        inside = summed(known.where(F.col("class") == edge["class"]), "per", F.lit(edge["used"]), F.lit(edge["left"]), budget)
        open_ = inside.where("not capped").orderBy("per").first() or open_
    return (open_["level"], open_["first"]["per"]) if open_ else (None, None)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """``skey``, ``source_size`` and ``target`` of each source."""
    sources = materialize(_numbered(sizes, weights), "mixing-sources")
    level, caps_end = _level(sources, share)
    full = MAX_COPIES * F.col("source_size").cast("double")
    target = full if level is None else F.when(F.col("source_size") / F.col("weight") < caps_end, full).otherwise(F.col("weight") * F.lit(level))
    return sources.select("skey", "source_size", target.alias("target"))


def _with_expectation(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source and propensity: certain copies ``whole``, inclusion probability ``pi`` and the
    words ``room`` that are left for the sample of the source."""
    classes = sizes.groupBy("skey", "propensity").agg(F.sum("size").alias("words")).join(sources, "skey")
    filled = _fill(classes, ["skey"], F.col("target"), F.col("words"), F.col("words") * F.col("propensity"), [F.desc("propensity")])
    w = Window.partitionBy("skey")
    capped = (F.col("level") * F.col("propensity") >= MAX_COPIES) | (F.col("target") >= MAX_COPIES * F.col("source_size"))
    level = F.min(F.when(~capped, F.struct(-F.col("propensity"), "level"))).over(w)["level"]
    expected = F.when(F.coalesce(capped, F.lit(False)), F.lit(float(MAX_COPIES))).otherwise(F.coalesce(F.least(F.lit(float(MAX_COPIES)), level * F.col("propensity")), F.lit(0.0)))
    named = filled.withColumn("expected", expected).withColumn("whole", F.floor("expected")).withColumn("pi", F.col("expected") - F.col("whole"))
    return named.withColumn("room", F.col("target") - F.sum(F.col("whole") * F.col("words")).over(w)).select("skey", "propensity", "source_size", "target", "whole", "pi", "room")


def _rank(df: DataFrame) -> DataFrame:
    """Random odds divided by inclusion odds, and the bucket of that rank."""
    digits = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{SEED}"))), 1, 13), 16, 10).cast("long")
    u = (digits + 0.5) / F.lit(float(1 << 52))
    df = df.withColumn("__u", u).withColumn("rank", F.when(F.col("pi") > 0, (F.col("__u") / (1 - F.col("__u"))) * ((1 - F.col("pi")) / F.col("pi")))).drop("__u")
    return df.withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * BUCKETS))


def _marked(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", size_of(F.col("text"))).withColumn("skey", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).withColumn("propensity", F.length(F.bin("size")))


def _plan(sizes: DataFrame, weights: tuple[int, ...], share: float) -> DataFrame:
    """One small row per source and propensity with all that decides a document's copies."""
    classes = materialize(_with_expectation(sizes, source_targets(sizes, weights, share)), "mixing-classes")
    ranked = _rank(sizes.join(classes, ["skey", "propensity"])).where("pi > 0")
    sums = ranked.groupBy("skey", "bucket", "room").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("skey").orderBy("bucket"))
    edge = sums.withColumn("upto", upto).where("upto > room").groupBy("skey").agg(F.min(F.struct("bucket", F.col("upto") - F.col("words"), "room")).alias("e"))
    edge = materialize(edge.select("skey", F.col("e.bucket").alias("edge"), (F.col("e.room") - F.col("e.col2")).alias("left_words")), "mixing-edges")
    last = ranked.join(edge, "skey").where("bucket = edge")
    last = last.withColumn("upto", F.sum("size").over(Window.partitionBy("skey").orderBy("rank", "doc_id", "size"))).where("2 * upto - size <= 2 * left_words")
    cut = last.groupBy("skey").agg(F.max(F.struct("rank", "doc_id", "size")).alias("cut"))
    return materialize(classes.join(edge.join(cut, "skey", "left"), "skey", "left"), "mixing-plan")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """All rows with ``mix_copies``, ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_taken``.

    Sizes are written once; the decisions come back as a small table of one row per source and
    size class, so documents are not shuffled (Spark broadcasts that table or splits a hot source).
    """
    new = ["mix_copies", "mix_size", "mix_source_size", "mix_target", "mix_taken"]
    names = [c for c in docs.columns if c not in new]
    sizes = materialize(_marked(docs.select("doc_id", "source", "text")).drop("text"), "mixing-sizes")
    return _decided(docs.select(F.struct(*names).alias("row"), "doc_id", "source", "text"), _plan(sizes, weights, share)).select("row.*", *new)


def _decided(docs: DataFrame, plan: DataFrame) -> DataFrame:
    marked = docs if "size" in docs.columns else _marked(docs)
    ranked = _rank(marked.join(plan, ["skey", "propensity"]))
    here = F.struct("rank", "doc_id", "size")
    picked = (F.col("pi") > 0) & (F.col("edge").isNull() | (F.col("bucket") < F.col("edge")) | ((F.col("bucket") == F.col("edge")) & F.coalesce(here <= F.col("cut"), F.lit(False))))
    copies = F.col("whole") + picked.cast("long")
    return ranked.withColumn("mix_copies", copies).withColumns(
        {"mix_size": F.col("size"), "mix_source_size": F.col("source_size"), "mix_target": F.col("target"), "mix_taken": copies * F.col("size")}
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = materialize(_marked(docs.select("doc_id", "source", "text")).drop("text"), "mixing-sizes")
    mixed = _decided(sizes, _plan(sizes, WEIGHTS, SHARE))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it, with its own columns, whatever they are called."""
    sizes = materialize(_marked(docs.select("doc_id", "source", "text")).drop("text"), "mixing-sizes")
    row = F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("row")
    mixed = _decided(docs.select(row, "doc_id", "source", "text"), _plan(sizes, WEIGHTS, SHARE))
    return mixed.select("row", F.explode(F.array_repeat(F.lit(0), F.col("mix_copies").cast("int")))).select("row.*").toDF(*docs.columns)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), p AS (
  SELECT *, length(bin(size)) AS g, (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM d
), s0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS ss FROM p GROUP BY source
), s1 AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS n FROM s0
), s2 AS (
  SELECT *, CASE n % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s1
), s3 AS (
  SELECT *, ss::DOUBLE / w AS o,
    (1.5::DOUBLE * sum(ss) OVER () - 2 * coalesce(sum(ss) OVER (ORDER BY ss::DOUBLE / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ss::DOUBLE / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS lvl FROM s2
), s4 AS (
  SELECT *, w * lvl >= 2 * ss AS capped FROM s3
), s5 AS (
  SELECT arg_min(lvl, struct_pack(o := o, n := n)) AS lvl FROM s4 WHERE NOT capped
), s AS (
  SELECT s4.source, ss, CASE WHEN capped OR s5.lvl IS NULL THEN 2.0::DOUBLE * ss ELSE w * s5.lvl END AS target FROM s4 LEFT JOIN s5 ON TRUE
), c0 AS (
  SELECT p.source, g, CAST(sum(size) AS BIGINT) AS a FROM p GROUP BY p.source, g
), c1 AS (
  SELECT c0.*, s.ss, s.target,
    sum(a * g) OVER (PARTITION BY c0.source) - coalesce(sum(a * g) OVER (PARTITION BY c0.source ORDER BY g DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    target - 2 * coalesce(sum(a) OVER (PARTITION BY c0.source ORDER BY g DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS lft
  FROM c0 JOIN s ON c0.source IS NOT DISTINCT FROM s.source
), c2 AS (
  SELECT *, CASE WHEN rest > 0 THEN lft / rest::DOUBLE END AS lvl FROM c1
), c3 AS (
  SELECT *, (lvl * g >= 2 OR target >= 2 * ss) AS capped FROM c2
), c4 AS (
  SELECT source, arg_max(lvl, g) AS lvl FROM c3 WHERE NOT capped GROUP BY source
), c5 AS (
  SELECT c3.source, c3.g, c3.a, c3.ss, c3.target, CASE WHEN coalesce(c3.capped, FALSE) THEN 2.0::DOUBLE ELSE coalesce(least(2.0::DOUBLE, c4.lvl * c3.g), 0.0::DOUBLE) END AS e
  FROM c3 LEFT JOIN c4 ON c3.source IS NOT DISTINCT FROM c4.source
), c AS (
  SELECT *, CAST(floor(e) AS BIGINT) AS whole, e - floor(e) AS pi, target - sum(CAST(floor(e) AS BIGINT) * a) OVER (PARTITION BY source)::DOUBLE AS room FROM c5
), r AS (
  SELECT p.doc_id, p.size, p.source, c.ss, c.target, c.whole, c.pi, c.room, CASE WHEN c.pi > 0 THEN (u / (1 - u)) * ((1 - c.pi) / c.pi) END AS rnk
  FROM p JOIN c ON p.source IS NOT DISTINCT FROM c.source AND p.g = c.g
), t AS (
  SELECT *, sum(CASE WHEN pi > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rnk ASC NULLS LAST, doc_id ASC NULLS FIRST, size) AS upto FROM r
)
SELECT doc_id, size, ss AS source_size, target, CAST((whole + CASE WHEN pi > 0 AND 2 * upto - size <= 2 * room THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM t
"""
