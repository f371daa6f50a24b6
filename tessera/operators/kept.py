"""A kept scoring corpus: postings and statistics of a library that follow its changes.

A corpus is a folder of generations.  Each holds what one batch of changes brought: postings and field lengths of the
cards that were written (in buckets by card), which cards it wrote or removed, and by how much each token's document
frequency and each field's count and length changed.  Old postings are read only in the buckets of changed cards; nothing is rewritten.  A
card's rows count in the last generation that names it, and statistics are sums of changes, so reading needs no
rebuild.  A generation counts once its last table is whole: a batch that failed or runs again writes its own
folder anew and changes nothing else.  ``compact`` folds all generations into one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import corpus
from tessera.tables import discard, exists, listed, materialize, remove

BUCKETS = 64
#: Tables of a generation, in the order they are written.
TABLES = ("postings", "lengths", "live", "tokens", "fields")


def generations(spark: SparkSession, path: str) -> list[str]:
    """Folders of the generations that count, in order: the last base that is whole, and whole ones after it."""
    whole = [n for n in listed(spark, path) if n[:2] in ("b=", "g=") and exists(spark, f"{path}/{n}/{TABLES[-1]}/_SUCCESS")]
    base = max((n for n in whole if n.startswith("b=")), default=None)
    after = [n for n in whole if n.startswith("g=") and (base is None or _number(n) > _number(base))]
    return [*([] if base is None else [base]), *after]


def _number(name: str) -> int:
    return int(name[2:])


def _read(spark: SparkSession, path: str, name: str, folders: list[str]) -> DataFrame:
    parts = [spark.read.parquet(f"{path}/{g}/{name}").withColumn("gen", F.lit(_number(g))) for g in folders]
    return reduce(DataFrame.unionByName, parts)


def _write(rows: DataFrame, keys: list[str], at: str) -> None:
    """By buckets of cards, whose bounds in the files' statistics let a reader pass over the others."""
    rows.repartition("bucket").sortWithinPartitions("bucket", *keys).write.mode("overwrite").parquet(at)


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("bucket")


def _keys(scope: list[str] | None, key: str) -> list[str]:
    return [*(scope or []), key]


def _live(spark: SparkSession, path: str, name: str, folders: list[str], keys: list[str], changed: DataFrame | None = None) -> DataFrame:
    """Rows of a table in the last generation that names their card; of the ``changed`` cards only, if given."""
    rows, named = _read(spark, path, name, folders), _read(spark, path, "live", folders)
    if changed is not None:
        buckets = [r["bucket"] for r in changed.select("bucket").distinct().collect()]  # BUCKETS numbers at most
        rows = rows.where(F.col("bucket").isin(buckets)).join(changed.select(*keys), keys, "left_semi")
        named = named.join(changed.select(*keys), keys, "left_semi")
    last = named.groupBy(*keys).agg(F.max(F.struct("gen", "alive")).alias("last")).where("last.alive").select(*keys, F.col("last.gen").alias("gen"))
    return rows.join(last, [*keys, "gen"]).drop("gen")


def apply(spark: SparkSession, path: str, upserts: DataFrame | None, removed: DataFrame | None = None, key: str = "card_key", scope: list[str] | None = None, number: int | None = None) -> int:
    """Write one batch of changes as a generation and give its number.

    ``upserts`` are rows as from ``corpus.field_rows``, all fields of each card that is new or changed; ``removed`` has the keys of
    cards that go.  A key in both is written.  ``number`` names the batch (that of a stream); one that is whole
    already is left as it is.
    """
    keys, scope = _keys(scope, key), scope or []
    have = generations(spark, path)
    last = max(map(_number, have), default=-1)
    number = last + 1 if number is None else number
    if number <= last:
        return number
    at = f"{path}/g={number:08d}"
    remove(spark, at)
    gone = [] if removed is None else [removed.select(*keys).withColumn("alive", F.lit(False))]
    come = [] if upserts is None else [upserts.select(*keys).withColumn("alive", F.lit(True))]
    if not gone + come:
        raise ValueError("nothing to change")
    changed = reduce(DataFrame.unionByName, gone + come).groupBy(*keys).agg(F.max("alive").alias("alive")).withColumn("bucket", _bucket(keys))
    changed = materialize(changed, "kept-changed")
    if upserts is None:
        like = removed.select(*keys).limit(0)
        upserts = like.withColumns({"field": F.lit(""), "text": F.lit("")})
    posted = corpus.postings(upserts, keys)
    total = upserts.select(*keys, "field").distinct().join(posted.groupBy(*keys, "field").agg(F.sum("tf").alias("length")), [*keys, "field"], "left").na.fill(0, ["length"])
    new = {"postings": corpus.with_lengths(posted, keys), "lengths": total}
    for name, rows in new.items():
        _write(rows.withColumn("bucket", _bucket(keys)), keys, f"{at}/{name}")
    changed.select(*keys, "alive").write.mode("overwrite").parquet(f"{at}/live")
    sides = {name: [(spark.read.parquet(f"{at}/{name}").drop("bucket"), 1)] for name in new}
    if have:
        for name in new:
            sides[name].append((_live(spark, path, name, have, keys, changed).drop("bucket"), -1))
    signed = {name: reduce(DataFrame.unionByName, [rows.withColumn("sign", F.lit(sign)) for rows, sign in both]) for name, both in sides.items()}
    df = signed["postings"].select(*keys, "token", "sign").distinct().groupBy(*scope, "token").agg(F.sum("sign").alias("df")).where("df <> 0")
    df.write.mode("overwrite").parquet(f"{at}/tokens")
    fields = signed["lengths"].groupBy(*scope, "field").agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("length")).alias("total"))
    fields.write.mode("overwrite").parquet(f"{at}/fields")
    discard(changed)
    return number


def document_frequency(spark: SparkSession, path: str, scope: list[str] | None = None) -> DataFrame:
    """Cards that hold a token, by the sum of all changes."""
    return _read(spark, path, "tokens", generations(spark, path)).groupBy(*(scope or []), "token").agg(F.sum("df").alias("df")).where("df > 0")


def field_lengths(spark: SparkSession, path: str, scope: list[str] | None = None) -> DataFrame:
    """``field``, ``n`` cards, ``total`` tokens and their ``average``, by the sum of all changes."""
    summed = _read(spark, path, "fields", generations(spark, path)).groupBy(*(scope or []), "field").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0")
    return summed.withColumn("average", F.greatest(F.col("total") / F.col("n"), F.lit(1.0)))


def postings(spark: SparkSession, path: str, key: str = "card_key", scope: list[str] | None = None) -> DataFrame:
    """Postings of the cards that are there now."""
    return _live(spark, path, "postings", generations(spark, path), _keys(scope, key)).drop("bucket")


def token_weights(spark: SparkSession, path: str, key: str = "card_key", weights: dict[str, float] | None = None, scope: list[str] | None = None) -> DataFrame:
    """What ``corpus.bm25f`` takes as ``kept``."""
    average = field_lengths(spark, path, scope).drop("total")
    return corpus.token_weights(postings(spark, path, key, scope), average, document_frequency(spark, path, scope), key, weights, scope)


def compact(spark: SparkSession, path: str, key: str = "card_key", scope: list[str] | None = None) -> None:
    """Fold all generations into a base and remove them.  Readers that began before may still need them, so compact when none does."""
    keys, have = _keys(scope, key), generations(spark, path)
    at = f"{path}/b={_number(have[-1]):08d}"
    if have == [at.rsplit("/", 1)[1]]:
        return
    remove(spark, at)
    for name in ("postings", "lengths"):
        _write(_live(spark, path, name, have, keys), keys, f"{at}/{name}")
    spark.read.parquet(f"{at}/lengths").select(*keys).distinct().withColumn("alive", F.lit(True)).write.mode("overwrite").parquet(f"{at}/live")
    document_frequency(spark, path, scope).write.mode("overwrite").parquet(f"{at}/tokens")
    field_lengths(spark, path, scope).drop("average").write.mode("overwrite").parquet(f"{at}/fields")
    for old in have:
        remove(spark, f"{path}/{old}")
