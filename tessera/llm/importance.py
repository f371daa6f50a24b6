"""Target-distribution importance resampling with overlap chunking for skewed long texts.

Features are runs of 1 to ``orders`` consecutive words, hashed to ``buckets``.  A bucket's gain is the log ratio of its
smoothed shares in the target and in the corpus; a document's weight is the sum of gains over its
features, and documents are drawn without replacement by weight plus Gumbel noise that its id fixes.

A text above ``CHUNK`` bytes is split at word boundaries.  Each chunk owns the starting positions of its words and
carries the next ``orders - 1`` words along, so every run is counted once, in the chunk that owns its first word.
Short texts are counted where they are read; chunks of long ones are written, dealt to all tasks and
counted there, and counts and weights are summed by document.  Only the counts of buckets (``buckets`` numbers)
pass through the driver.  Ranks come from ranges, not from one sorted task.

Defined cases: null and empty texts have no words and weight 0; each row is a document, so rows that repeat an
id are ranked one after the other, by number of features and weight; a null id counts as an empty one for
the noise and comes after all others; an empty table gives no rows, an empty target only smoothed shares; other columns, whatever they are
called, are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize, numbered, small_batches, table
from tessera.llm.merkle import SQL_CRC_STEPS, sql_crc32

QUERY = "op11_importance"

ORDERS, BUCKETS = 1, 10_000
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
#: Bytes of a chunk, to the next end of a word.
CHUNK = 1 << 16
#: Lower-cases A-Z and makes a space of every byte that is no letter, digit or part of another character.
FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())
_COUNTED = "words long, features long, buckets array<int>, counts array<int>"


def folded(text: str | None) -> bytes:
    return text.encode("utf-8", "replace").translate(FOLD) if text else b""


def chunks(data: bytes, orders: int = ORDERS, size: int = CHUNK) -> Iterator[tuple[bytes, int]]:
    """Parts of a folded text: words that a chunk owns, followed by ``orders - 1`` more, and the length of the owned part."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + size) if at + size < len(data) else -1
        end = len(data) if end < 0 else end
        carried = end
        for _ in range(orders - 1):
            while carried < len(data) and data[carried] == 32:
                carried += 1
            word_end = data.find(b" ", carried)
            carried = len(data) if word_end < 0 else word_end
        yield data[at:carried], end - at
        at = end


def count(part: bytes, owned: int, orders: int = ORDERS, buckets: int = BUCKETS) -> tuple[int, int, list[int], list[int]]:
    """Owned words, features that start at them, and features by bucket."""
    words = part.split()
    own = len(words) if owned == len(part) else len(part[:owned].split())
    runs = Counter(words[:own])
    for n in range(2, orders + 1):
        runs.update(b" ".join(words[i : i + n]) for i in range(min(own, len(words) - n + 1)))
    held: Counter = Counter()
    for run, times in runs.items():
        held[zlib.crc32(run) % buckets] += times
    return own, sum(runs.values()), list(held), list(held.values())


def _columns(found: list[tuple]) -> list[pa.Array]:
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    return [pa.array([None if x is None else x[k] for x in found], kind) for k, kind in enumerate(kinds)]


def features(texts: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Counts of every row of ``texts`` (``doc_id``, ``text``): of short texts, one row each, and of long ones, a row for each chunk.

    ``row`` tells documents apart, whatever their ids."""
    small_batches(texts.sparkSession)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts, owned, places, found = [], [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                data = folded(text)
                if len(data) <= size:
                    made = [(None, None, count(data, len(data), orders, buckets))]
                else:
                    made = [(part, n, None) for part, n in chunks(data, orders, size)]
                for place, (part, n, counted) in enumerate(made):
                    rows.append(row)
                    places.append(place)
                    parts.append(part)
                    owned.append(n)
                    found.append(counted)
            own = [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("row", "doc_id")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(parts, pa.binary()), pa.array(owned, pa.int64()), pa.array(places, pa.int32()), *_columns(found)], names=["row", "doc_id", "part", "owned", "place", "words", "features", "buckets", "counts"])

    def count_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [count(part, owned, orders, buckets) for part, owned in zip(batch.column("part").to_pylist(), batch.column("owned").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *_columns(found)], names=columns)

    columns = ["row", "doc_id", "words", "features", "buckets", "counts"]
    keyed = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    made = materialize(keyed.mapInArrow(cut, f"row long, doc_id {kind}, part binary, owned long, place int, {_COUNTED}"), "importance-features")
    dealt = made.where("part is not null").select("row", "doc_id", "part", "owned", "place").repartition("row", "place")
    return made.where("part is null").select(*columns), materialize(dealt.mapInArrow(count_chunks, f"row long, doc_id {kind}, {_COUNTED}"), "importance-chunks")


def bucket_counts(*tables: DataFrame) -> DataFrame:
    """Features of all documents by ``bucket``."""
    held = [t.select(F.inline(F.arrays_zip("buckets", "counts"))) for t in tables]
    rows = held[0]
    for more in held[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy(F.col("buckets").alias("bucket")).agg(F.sum("counts").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, by bucket (``buckets`` numbers, whatever the input)."""
    sides = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    found = sides.unionByName(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).toPandas()
    s, t = found["s"].to_numpy(np.float64), found["t"].to_numpy(np.float64)
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = [math.floor(1000 * math.log(x)) for x in ratio.tolist()]
    return out


def _weighed(counted: DataFrame, gain: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("buckets")
            value = gain[held.flatten().to_numpy()] * batch.column("counts").flatten().to_numpy()
            ends = np.concatenate(([0], np.cumsum(value)))[np.asarray(held.offsets) - held.offsets[0].as_py()]
            own = [batch.column(c) for c in ("row", "doc_id", "words", "features")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(ends), pa.int64())], names=["row", "doc_id", "words", "features", "weight"])

    kind = counted.schema["doc_id"].dataType.simpleString()
    return counted.mapInArrow(run, f"row long, doc_id {kind}, words long, features long, weight long")


def resample(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, size: int = CHUNK) -> DataFrame:
    """Every row of ``docs`` (``doc_id``, ``text``) as ``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank``.

    The ``percent`` of documents of ``least_words`` or more with the highest scores are drawn; the others' rank is null.  ``target`` has ``text``.
    """
    short, long = features(docs.select("doc_id", "text"), orders, buckets, size)
    aim = features(target.select(F.lit(0).alias("doc_id"), "text"), orders, buckets, size)
    gain = gains(bucket_counts(short, long), bucket_counts(*aim), buckets)
    summed = _weighed(long, gain).groupBy("row").agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("words", "features", "weight")])
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0)))
    scored = _weighed(short, gain).unionByName(summed)
    scored = materialize(scored.select("doc_id", F.col("features").alias("n_features"), "weight", (F.col("weight") + noise).alias("score"), F.lit("").alias("grp"), (F.col("words") >= least_words).alias("fit")), "importance-scores")
    fit = scored.where("fit")
    most = percent * fit.count() // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_features"), F.col("weight")]
    placed = numbered(fit.select("doc_id", "n_features", "weight", "score", "grp"), "grp", order, "importance-ranks")
    rank = F.explode(F.sequence(F.col("at") + 1, F.col("at") + F.col("copies")))
    ranked = placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank")).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    for done in (short, long, *aim):
        discard(done)
    return scored.where("not fit").select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")).unionByName(ranked)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "benchmark").select("text"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
WITH {SQL_CRC_STEPS},
docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce({_WORDS}, []) AS words FROM documents),
own AS (SELECT k, word, count(*) AS n FROM (SELECT k, unnest(words) AS word FROM docs) GROUP BY ALL),
aim AS (SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS}) AS word FROM benchmark) GROUP BY ALL),
hashed AS (SELECT word, {sql_crc32("word")} % {BUCKETS} AS bucket FROM (SELECT word FROM own UNION SELECT word FROM aim), crc_steps),
s AS (SELECT bucket, sum(n) AS n FROM own JOIN hashed USING (word) GROUP BY ALL),
t AS (SELECT bucket, sum(n) AS n FROM aim JOIN hashed USING (word) GROUP BY ALL),
gain AS (
  SELECT h.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * ((SELECT sum(n) FROM s)::DOUBLE + {BUCKETS}) / ((coalesce(s.n, 0)::DOUBLE + 1) * (coalesce((SELECT sum(n) FROM t), 0)::DOUBLE + {BUCKETS})))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM hashed) h LEFT JOIN s ON h.bucket = s.bucket LEFT JOIN t ON h.bucket = t.bucket
), weighed AS (
  SELECT k, CAST(sum(n * gain) AS BIGINT) AS weight FROM own JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY k
), scored AS (
  SELECT k, doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM docs LEFT JOIN weighed USING (k)
), ranked AS (
  SELECT k, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST_WORDS}
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (k)
"""
