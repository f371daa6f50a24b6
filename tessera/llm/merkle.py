"""Merkle dataset manifest by traversal scheduling.

Every row of a table is a leaf; each group (a language) is a tree whose runs of eight consecutive nodes become
their parent, and the roots of all groups form one more tree in the same way.  Leaves are numbered within
their group by ranges and cut into aligned blocks of ``FAN ** LEVELS``.  Block by block, a treehash
stack gives the block's root; roots are the leaves of the next, smaller tree, until each group has one.  On the way
back every block walks through its leaves: of each level it holds only the run around the leaf, and one
treehash stack a level makes the next run ahead of time, one leaf a step, so the memory of a walk grows with the
number of levels.  Upper parts of a path are the same for all leaves of a block and are appended from one row a
block, so whole paths are never shuffled.

Defined cases: a null value hashes as ``-``; a null group is a group of its own and comes first; null ids come first within
their group, equal ids ascend by leaf; equal rows are leaves of their own, side by side, and are returned as often
as they occur; a lone leaf is its group's root; an empty table has no rows and no root.  ``docs`` may have other
columns of any name; only the carried ones are returned.  Carried columns must be orderable.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialize, numbered, small_batches, table

QUERY = "op12_merkle"

FAN = 8
#: Levels of a block; a block has FAN ** LEVELS leaves at most.
LEVELS = 3
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_of(values: list[Column]) -> Column:
    """Digest of a row: each value by its length in bytes and its text, or ``-``."""
    said = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in said]), 256)


def _digest(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


class TreeHash:
    """Folds digests that come one by one into nodes ``height`` levels up; holds at most a run for each level."""

    def __init__(self, height: int):
        self.runs: list[list[str]] = [[] for _ in range(height)]
        self.nodes: list[str] = []

    def push(self, digest: str) -> None:
        for run in self.runs:
            run.append(digest)
            if len(run) < FAN:
                return
            digest = _digest(run)
            run.clear()
        self.nodes.append(digest)

    def close(self) -> list[str]:
        """All nodes, the last of which may come from runs that are not full."""
        for level, run in enumerate(self.runs):
            if run:
                digest = _digest(run)
                run.clear()
                above = self.runs[level + 1] if level + 1 < len(self.runs) else self.nodes
                above.append(digest)
        return self.nodes


def height_of(n: int) -> int:
    """Levels above ``n`` nodes of one tree within a block."""
    height = 0
    while FAN**height < n and height < LEVELS:
        height += 1
    return height


def root_of(leaves: list[str], height: int) -> str:
    tree = TreeHash(height)
    for leaf in leaves:
        tree.push(leaf)
    return tree.close()[0]


def walk(leaves: list[str], height: int) -> Iterator[tuple[list[str], list[int], list[int]]]:
    """For each leaf of a block: other nodes of its runs from the lowest level up, the runs' sizes, and its places."""
    n, spans = len(leaves), [FAN ** (level + 1) for level in range(height)]

    def nodes_of(level: int, first: int) -> list[str]:
        tree = TreeHash(level)
        for leaf in leaves[first : first + spans[level]]:
            tree.push(leaf)
        return tree.close()

    runs = [nodes_of(level, 0) for level in range(height)]
    ahead = [TreeHash(level) for level in range(height)]
    for i in range(n):
        places = [i // FAN**level % FAN for level in range(height)]
        yield [x for run, k in zip(runs, places, strict=True) for x in (*run[:k], *run[k + 1 :])], [len(run) for run in runs], places
        for level, span in enumerate(spans):
            if i + span < n:
                ahead[level].push(leaves[i + span])
            if (i + 1) % span == 0:
                runs[level], ahead[level] = ahead[level].close(), TreeHash(level)


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.StructArray, np.ndarray, list[str], int]]:
    """Of each block: its row number, its entries, how often each occurs, all its leaves, and its height."""
    entries = batch.column("entries")
    for k in range(batch.num_rows):
        own = entries[k].values
        copies = own.field("n").to_numpy()
        index = np.repeat(np.arange(len(own)), copies)
        leaves = own.field("digest").take(pa.array(index)).to_pylist()
        yield k, own, index, leaves, height_of(batch.column("total")[k].as_py())


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roots = [root_of(leaves, height) for _, _, _, leaves, height in _opened(batch)]
        blocks = [-(-n // BLOCK) for n in batch.column("total").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("block"), pa.array(blocks, pa.int64()), pa.array(roots, pa.string())], names=["grp", "at", "total", "digest"])


_PATH = "siblings array<string>, sizes array<int>, places array<int>"
_SHARED = ("siblings", "sizes", "places", "subroot", "root")


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        upper = [batch.column(c).to_pylist() for c in _SHARED]
        for k, own, index, leaves, height in _opened(batch):
            siblings, sizes, places, subroot, root = (u[k] for u in upper)
            found = [(a + siblings, b + sizes, c + places) for a, b, c in walk(leaves, height)]
            count = len(index)
            first = own.field("start").to_numpy()[index]
            within = np.arange(count) - np.searchsorted(index, index)  # which of its copies
            columns = [
                pa.array([batch.column("grp")[k].as_py()] * count, pa.string()),
                pa.array(first + within),
                own.field("row").take(pa.array(index)),
                pa.array(leaves, pa.string()),
                pa.array([x for x, _, _ in found], pa.list_(pa.string())),
                pa.array([x for _, x, _ in found], pa.list_(pa.int32())),
                pa.array([x for _, _, x in found], pa.list_(pa.int32())),
                pa.array([subroot] * count, pa.string()),
                pa.array([root] * count, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["grp", "at", "row", "leaf", *_SHARED])


def _blocks(nodes: DataFrame) -> DataFrame:
    """One row per aligned block: its group, the group's ``total`` nodes, and its ``entries`` in order."""
    last = F.col("at") + F.col("copies") - 1
    dealt = nodes.withColumn("block", F.explode(F.sequence(F.expr(f"at div {BLOCK}"), F.floor(last / BLOCK))))
    start = F.greatest("at", F.col("block") * BLOCK)
    n = F.least(last + 1, (F.col("block") + 1) * BLOCK) - start
    entry = F.struct(start.alias("start"), n.alias("n"), "digest", "row")
    return dealt.groupBy("grp", "block").agg(F.max("total").alias("total"), F.sort_array(F.collect_list(entry)).alias("entries"))


def _up(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of each round from the leaves up, and the root of each group (``grp``, ``digest``)."""
    rounds = []
    while True:
        rounds.append(materialize(_blocks(nodes), "merkle-blocks"))
        roots = materialize(rounds[-1].mapInArrow(_roots, "grp string, at long, total long, digest string"), "merkle-roots")
        if roots.where("total > 1").isEmpty():
            return rounds, roots.select("grp", "digest")
        nodes = roots.select("grp", "at", "total", "digest", F.lit(1).cast("long").alias("copies"), F.struct(F.lit(0).alias("_")).alias("row"))


def _down(rounds: list[DataFrame], shared: DataFrame) -> DataFrame:
    """Paths of all leaves; ``shared`` has what the roots of the groups add to them (``grp`` and the path's columns)."""
    upper = shared.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        row = blocks.schema["entries"].dataType.elementType["row"].dataType.simpleString()
        made = blocks.join(upper.select("grp", "block", *_SHARED), ["grp", "block"]).mapInArrow(_paths, f"grp string, at long, row {row}, leaf string, {_PATH}, subroot string, root string")
        upper = made.withColumnRenamed("at", "block")
    return made


def manifest(rows: DataFrame, group: str, order: str, leaf: str, carry: list[str]) -> DataFrame:
    """``carry``, ``leaf`` and its proof for every row: ``siblings`` (digests from the lowest level up, left to right),
    ``sizes`` and ``places`` (of the leaf's run at each level, and its place there), ``subroot`` and ``root``."""
    small_batches(rows.sparkSession)
    # a null group is the empty string; the others begin with a sign, so order stays as it is
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    keyed = rows.select(key.alias("grp"), F.col(order).alias("ord"), F.col(leaf).alias("digest"), F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)]).alias("row"))
    rounds, subroots = _up(numbered(keyed, "grp", [F.asc_nulls_first("ord")], "merkle-leaves").drop("ord"))
    tops, roots = _up(numbered(subroots.select(F.lit("").alias("grp"), F.struct("grp").alias("row"), "digest"), "grp", [F.col("row")], "merkle-groups"))
    empty = [F.array().cast(kind).alias(c) for c, kind in zip(_SHARED, ("array<string>", "array<int>", "array<int>"), strict=False)]
    top = _down(tops, roots.select("grp", *empty, F.lit("").alias("subroot"), F.col("digest").alias("root")))
    shared = top.select(F.col("row.grp").alias("grp"), "siblings", "sizes", "places", F.col("leaf").alias("subroot"), "root")
    return _down(rounds, shared).select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(carry)], "leaf", *_SHARED)


def folded(leaf: Column) -> Column:
    """Root that a leaf and the columns of a proof give."""

    def step(so_far: Column, run: Column) -> Column:
        others = F.slice("siblings", so_far["used"] + 1, run["sizes"] - 1)
        left, right = F.slice(others, F.lit(1), run["places"]), F.slice(others, run["places"] + 1, run["sizes"])
        digest = F.sha2(F.concat(F.array_join(left, ""), so_far["digest"], F.array_join(right, "")), 256)
        return F.struct((so_far["used"] + run["sizes"] - 1).alias("used"), digest.alias("digest"))

    return F.aggregate(F.arrays_zip("sizes", "places"), F.struct(F.lit(0).alias("used"), leaf.alias("digest")), step)["digest"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    changed = F.translate("text", UPPER, LOWER)
    altered = F.when((F.crc32(F.col("doc_id").cast("string")) % 3 == 0) & (changed != F.col("text")), leaf_of([*map(F.col, FIELDS[:-1]), changed]))
    marked = docs.select("doc_id", "lang", leaf_of([*map(F.col, FIELDS)]).alias("leaf"), altered.alias("altered"))
    proofs = manifest(marked, "lang", "doc_id", "leaf", ["doc_id", "altered"])
    shown = proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"), folded(F.coalesce("altered", "leaf")).alias("folded_root"))
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels that the SQL unrolls: groups of up to FAN ** SQL_LEVELS leaves.
SQL_LEVELS = 9


def _sql_tree(name: str, leaves: str, part: str) -> str:
    """CTEs of a tree: ``name``_0 holds the leaves, the last one the roots; a run's nodes stand in ``run``."""
    out = [f"{name}_0 AS (SELECT *, count(*) OVER (PARTITION BY {part}) AS n FROM ({leaves}))"]
    for k in range(SQL_LEVELS):
        out.append(f"{name}_run_{k} AS (SELECT {part}, pos // {FAN} AS up, list(h ORDER BY pos) AS run, any_value(n) AS n FROM {name}_{k} GROUP BY ALL)")
        out.append(f"{name}_{k + 1} AS (SELECT {part}, up AS pos, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS h, count(*) OVER (PARTITION BY {part}) AS n FROM {name}_run_{k})")
    return ",\n".join(out)


def _sql_climb(name: str, tree: str, start: str, part: str, place: str) -> str:
    """CTEs that carry the columns ``sib`` and ``fold`` of ``start`` up through a tree."""
    out, last = [], start
    for k in range(SQL_LEVELS):
        own = f"(x.{place} // {FAN**k}) % {FAN}"
        left, right = f"array_to_string(r.run[1:{own}], '')", f"array_to_string(r.run[{own} + 2:], '')"
        out.append(
            f"{name}_{k} AS (SELECT x.* EXCLUDE (sib, fold), CASE WHEN r.n = 1 THEN sib ELSE sib || {left} || {right} END AS sib, "
            f"CASE WHEN r.n = 1 THEN fold ELSE sha256({left} || fold || {right}) END AS fold "
            f"FROM {last} x JOIN {tree}_run_{k} r ON x.{part} = r.{part} AND x.{place} // {FAN ** (k + 1)} = r.up)"
        )
        last = f"{name}_{k}"
    return ",\n".join(out)


def _sql_leaf(text: str) -> str:
    said = [*[f"CAST({c} AS VARCHAR)" for c in FIELDS[:-1]], text]
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({v}) AS VARCHAR) || ':' || {v}, '-')" for v in said) + ")"


#: crc32 of a list of byte values, by its rule; ``crc_steps`` holds the 256 steps.
SQL_CRC_STEPS = "crc_steps AS (SELECT list(c ORDER BY i) AS steps FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS c FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))))"


def sql_crc32(word: str) -> str:
    """crc32 of a text's bytes; needs ``crc_steps`` in the FROM clause."""
    codes = f"list_transform(range(CAST(octet_length(encode({word})) AS BIGINT)), lambda i: CAST(('0x' || substr(hex(encode({word})), 2 * i + 1, 2)) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c // 256, steps[xor(c, b) % 256 + 1])))"


ORACLE_SQL = f"""
WITH {SQL_CRC_STEPS},
marked AS (
  SELECT doc_id, coalesce('=' || lang, '') AS grp, {_sql_leaf("text")} AS h,
    CASE WHEN coalesce({sql_crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0, false) THEN {_sql_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS altered
  FROM documents, crc_steps
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM marked
), {_sql_tree("leaf", "SELECT grp, pos, h FROM placed", "grp")},
{_sql_tree("top", f"SELECT 1 AS one, row_number() OVER (ORDER BY grp) - 1 AS pos, grp, h FROM leaf_{SQL_LEVELS}", "one")},
begun AS (SELECT *, '' AS sib, coalesce(altered, h) AS fold FROM placed),
{_sql_climb("low", "leaf", "begun", "grp", "pos")},
joined AS (SELECT low.*, 1 AS one, t.pos AS top_pos, t.h AS subroot FROM low_{SQL_LEVELS - 1} low JOIN top_0 t ON low.grp = t.grp),
{_sql_climb("high", "top", "joined", "one", "top_pos")}
SELECT doc_id, high.h AS leaf, subroot, r.h AS root, sha256(sib) AS proof_sha256, fold AS folded_root, fold = r.h AS verified
FROM high_{SQL_LEVELS - 1} high, top_{SQL_LEVELS} r
"""
