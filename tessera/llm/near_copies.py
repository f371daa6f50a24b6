"""SimHash near-dedup by shingle similarity: documents whose sets of five-word shingles have a Jaccard of 0.8 or more.

Such pairs differ in about ten of 64 SimHash bits, so blocks of equal bits can't bring them together.  Candidates
share one of ``BANDS`` fingerprints of ``ROWS`` minima instead: a pair at the least similarity shares none
with a probability of 3e-6, a closer pair with less.  Candidates form blocks (connected components); a
block's SimHashes make a BK-tree, of which a search follows only the edges within ``RADIUS`` bits, and each
pair found is compared by its whole sets, so no pair links that is less alike.  A pair at the least
similarity lies beyond the radius with a probability of 1e-6 (sets below ``SMALL`` shingles, whose bits vary more,
search without a radius).  A block above ``SHARD`` documents or ``SHARD_BYTES`` is dealt to pairs of chunks,
each of which meets in one task.  Links lead to the smallest of each local component, never all pairs.

Defined cases: equal sets count as one document from the start; null, empty and wordless texts have equal
(empty) sets; of each component the row with the smallest id stays (a null id is larger than all others), among
rows that repeat that id the one whose text has the smallest hash; rows that repeat an id but resemble
nothing stay; other columns, whatever they are called, pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import discard, materialize, private, small_batches
from tessera.llm.graph import components
from tessera.llm.simhash import BKTree, fingerprint_of, shingle_hashes

SHINGLE = 5
#: The least similarity of near copies, as a fraction.
SIMILAR = (4, 5)
#: Fingerprints of a set, and minima that one is made of.
BANDS, ROWS = 32, 5
#: Bits that SimHashes of a pair may differ in, and shingles of a set below which they may differ in any.
RADIUS, SMALL = 24, 32
#: The most documents, and bytes of text, of a block that are not dealt to chunks.
SHARD, SHARD_BYTES = 256, 8 << 20
#: Shingle hashes that meet all multipliers at a time.
CHUNK = 2048
_rng = np.random.default_rng(42)
#: Odd multipliers of the minima and of their sums.
MULTIPLIERS = _rng.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = _rng.integers(1 << 63, size=(BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    return np.unique(np.array(shingle_hashes(text, SHINGLE), np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """Fingerprints of a set; an empty one has none."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        np.minimum(least, np.multiply.outer(MULTIPLIERS, hashes[at : at + CHUNK]).min(axis=1), out=least)
    return (least.reshape(BANDS, ROWS) * MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def _mark(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch[text].to_pylist()]
            keys = pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets], pa.string())
            marks = pa.array([bands(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, keys, marks], names=[*batch.schema.names, "key", "bands"])

    return run


def block_links(nodes: list[int], texts: list[str]) -> list[tuple[int, int]]:
    """Links from each node to the smallest of its component, where nodes at least ``SIMILAR`` are joined."""
    sets = [shingle_set(t) for t in texts]
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    p, q = SIMILAR
    tree, holders = BKTree(), {}
    for i, own in enumerate(sets):
        value = fingerprint_of(own) & (1 << 64) - 1
        near = tree.search(value, RADIUS if len(own) >= SMALL else 64)
        for j in (j for v in near for j in holders[v]):
            a, b = len(own), len(sets[j])
            if q * min(a, b) < p * max(a, b) or find(i) == find(j):
                continue  # the sizes alone forbid it, or others have linked them
            common = len(np.intersect1d(own, sets[j], assume_unique=True))
            if (p + q) * common >= p * (a + b):
                x, y = sorted((find(i), find(j)), key=nodes.__getitem__)
                parent[y] = x
        if value not in holders:
            tree.add(value)
        holders.setdefault(value, []).append(i)
    return [(nodes[k], nodes[find(k)]) for k in range(len(nodes)) if find(k) != k]


def _link_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards arrive sorted by key; one may go on in the next batch."""
    shard, nodes, texts = None, [], []

    def emit() -> pa.RecordBatch:
        links = block_links(nodes, texts) if len(nodes) > 1 else []
        return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    for batch in batches:
        for key, node, text in zip(*(batch[c].to_pylist() for c in ("shard", "node", "text")), strict=True):
            if key != shard:
                yield emit()
                shard, nodes, texts = key, [], []
            nodes.append(node)
            texts.append(text)
    yield emit()


def one_of_each(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row of each component of near copies among ``docs`` (``doc_id``, ``text`` and any others), whole."""
    small_batches(docs.sparkSession)
    own, text = private(docs)
    doc_id = f"c{docs.columns.index('doc_id')}"
    schema = T.StructType([*own.schema, T.StructField("key", T.StringType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    marked = own.mapInArrow(_mark(text), schema).withColumn("node", F.monotonically_increasing_id())
    marked = materialize(marked, "shingle-sets")
    order = F.struct(F.col(doc_id).isNull().alias("unknown"), F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("hash"), "node")
    # one row of each set of shingles stands for all its copies
    firsts = materialize(marked.groupBy("key").agg(F.min(order).alias("first")).select("first", F.col("first.node").alias("node")), "distinct-sets")
    keyed = marked.select("node", F.explode("bands").alias("band")).join(firsts.select("node"), "node")
    least = keyed.groupBy("band").agg(F.min("node").alias("to"), F.count("*").alias("n")).where("n > 1").select("band", "to")
    met = keyed.join(least, "band").where("node <> to").select("node", "to")
    blocks = components(met).select("node", F.col("component").alias("block"))
    held = materialize(blocks.join(marked.select("node", F.col(text).alias("text")), "node"), "blocks")
    sizes = held.groupBy("block").agg(F.ceil(F.greatest(F.count("*") / shard, F.sum(F.length("text")) / SHARD_BYTES)).cast("int").alias("many"))
    hot = materialize(sizes.where("many > 1"), "hot-blocks")
    whole = held.join(hot, "block", "left_anti").select("node", "text", F.xxhash64("block").alias("shard"))
    place = F.pmod(F.xxhash64("node"), F.col("many")).cast("int")
    dealt = held.join(hot, "block").withColumn("own", place).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    dealt = dealt.select("node", "text", F.xxhash64("block", F.least("own", "other"), F.greatest("own", "other")).alias("shard"))
    links = whole.unionByName(dealt).repartition("shard").sortWithinPartitions("shard").mapInArrow(_link_blocks, "a long, b long")
    linked = components(links).join(firsts, "node")
    named = linked.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.node").alias("node"))
    alone = firsts.join(linked.select("node"), "node", "left_anti").select("node")
    kept = materialize(marked.join(named.unionByName(alone), "node", "left_semi").select(*own.columns), "one-of-each")
    for done in (held, hot, firsts, marked):
        discard(done)
    return kept.toDF(*docs.columns)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component of near copies, with its own columns."""
    return one_of_each(docs)
