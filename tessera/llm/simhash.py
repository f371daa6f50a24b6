"""SimHash near-duplicates by BK-trees.

Fingerprints that differ in at most ``RADIUS`` of 64 bits agree wholly in some two of five blocks
of bits, so every linked pair meets in one of ten shards keyed by a pair of blocks (about 25 bits).  Each
shard of distinct fingerprints becomes a BK-tree, whose children are keyed by their Hamming distance
to the parent; a search follows only edges within the radius of the distance to the node.  A shard
above ``SHARD`` fingerprints is dealt to pairs of chunks, each of which meets in one task, so no
tree grows without bound and no link is lost.  A shard returns links to the smallest fingerprint
of each local component, never all pairs; distributed contraction joins them.

Defined cases: null, empty and wordless texts have fingerprint zero and link like any other; equal
texts, repeated rows and ties share a component; a null id is kept but never names a component
unless all its members' ids are null; other columns pass through (``with_components`` replaces columns named ``sim_fp`` and ``sim_component``).  The pipeline's stage is in ``near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import add_columns, discard, materialize, table
from tessera.llm.graph import components

QUERY = "op4_simhash"

SHINGLE = 3
SEED = 42
RADIUS = 3
#: First bits of the blocks of a fingerprint; with RADIUS + 2 blocks, two are free of differences.
CUTS = (0, 13, 26, 39, 52, 64)
#: The most distinct fingerprints of a shard that one tree takes.
SHARD = 2048
#: Shingle hashes whose bits are counted at a time.
CHUNK = 1 << 16


def shingle_hashes(text: str | None, n: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of all n-word shingles of the A-Z lower-cased text, repeats included."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= n:
        return [xxhash.xxh64_intdigest(joined, seed)]
    stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    start = np.concatenate(([0], stop[:-1]))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(start[: len(words) - n + 1].tolist(), (stop[n - 1 :] - 1).tolist(), strict=True)]


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """64-bit SimHash of the text's shingles as a signed integer."""
    return fingerprint_of(np.array(shingle_hashes(text, n), np.uint64))


def fingerprint_of(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


class BKTree:
    """Integers under Hamming distance; a node is [value, {distance: child}]."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while True:
            d = (value ^ node[0]).bit_count()
            child = node[1].get(d)
            if child is None:
                node[1][d] = [value, {}]
                return
            node = child

    def search(self, value: int, radius: int) -> list[int]:
        """Values within the radius: only edges within the radius of a node's distance can lead to them."""
        found, stack = [], [self.root] if self.root else []
        while stack:
            at, children = stack.pop()
            d = (value ^ at).bit_count()
            if d <= radius:
                found.append(at)
            if children:
                stack.extend(child for k, child in children.items() if d - radius <= k <= d + radius)
        return found


def shard_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links from each value to the smallest of its component within the shard."""
    mask = (1 << 64) - 1
    tree, parent = BKTree(), {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for v in values:
        if v in parent:
            continue
        parent[v] = v
        for near in tree.search(v & mask, radius):
            near = near - (1 << 64) if near >> 63 else near
            a, b = find(v), find(near)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(v & mask)
    return [(v, find(v)) for v in parent if find(v) != v]


def _link_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards arrive sorted by key; one that ends a batch may go on in the next."""
    held_key, held = np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = None

    def emit(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(keys)]))
        links = [x for a, b in zip(starts, ends, strict=True) if b - a > 1 for x in shard_links(values[a:b].tolist())]
        return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    for batch in batches:
        if not batch.num_rows:
            continue
        held_key = np.concatenate((held_key, batch["shard"].to_numpy()))
        held = np.concatenate((held, batch["fp"].to_numpy()))
        last = np.searchsorted(held_key, held_key[-1])
        if last:
            yield emit(held_key[:last], held[:last])
            held_key, held = held_key[last:], held[last:]
    if len(held_key):
        yield emit(held_key, held)


def _keys() -> list:
    """Shard keys of a fingerprint: number of the pair of blocks, then the bits of both."""

    def block(i: int):
        return F.shiftrightunsigned("fp", CUTS[i]).bitwiseAND(F.lit((1 << (CUTS[i + 1] - CUTS[i])) - 1))

    pairs = combinations(range(len(CUTS) - 1), len(CUTS) - 1 - RADIUS)
    return [F.shiftleft(F.shiftleft(F.lit(n).cast("long"), 13).bitwiseOR(block(i)), 13).bitwiseOR(block(j)) for n, (i, j) in enumerate(pairs)]


def links(fingerprints: DataFrame, shard: int = SHARD, held: list | None = None) -> DataFrame:
    """Edges ``a``, ``b`` that connect all distinct ``fp`` within the radius, possibly through others; ``held`` collects the table to discard after use."""
    keyed = fingerprints.select("fp", F.explode(F.array(*_keys())).alias("shard"))
    sizes = materialize(keyed.groupBy("shard").count().where(F.col("count") > shard), "hot-shards")
    if held is not None:
        held.append(sizes)
    if not sizes.isEmpty():
        many = F.ceil(F.col("count") / shard).cast("int")
        own = F.pmod(F.xxhash64("fp"), many).cast("int")
        hot = keyed.join(sizes, "shard").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), many - 1)))
        dealt = hot.select("fp", F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("shard"))
        keyed = keyed.join(sizes, "shard", "left_anti").select("fp", "shard").unionByName(dealt)
    return keyed.repartition("shard").sortWithinPartitions("shard").mapInArrow(_link_shards, "a long, b long")


def with_components(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Add ``sim_fp`` (signed 64-bit fingerprint) and ``sim_component`` (smallest id that links reach)."""
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("sim_fp", "sim_component")]
    marked = add_columns(docs, {"sim_fp": "long"}, lambda texts: [[fingerprint(t) for t in texts]], carry)
    marked = materialize(marked, "fingerprints")
    firsts = materialize(marked.groupBy(F.col("sim_fp").alias("fp")).agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    held: list[DataFrame] = []
    linked = components(links(firsts.select("fp"), held=held)).withColumnRenamed("node", "fp").join(firsts, "fp")
    for done in held:
        discard(done)
    smallest = linked.groupBy("component").agg(F.min("first").alias("sim_component"))
    named = linked.join(smallest, "component").select("fp", "sim_component")
    classes = firsts.join(named, "fp", "left").select(F.col("fp").alias("sim_fp"), F.coalesce("sim_component", "first").alias("sim_component"))
    return marked.join(classes, "sim_fp").select(*carry, "sim_fp", "sim_component")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_components(docs, ["doc_id"]).select("doc_id", F.lpad(F.lower(F.hex("sim_fp")), 16, "0").alias("fingerprint"), F.col("sim_component").alias("component_id"))

