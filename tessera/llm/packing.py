"""Best-fit packing of token sequences by hierarchical residual packing.

Each partition tokenizes its documents, cuts those longer than a sequence into pieces (the first
takes the remainder, so the others fill sequences alone) and packs pieces best-fit decreasing.  Nearly full
sequences are emitted; underfull ones go on as items, are merged into fewer partitions and packed
again, until one partition is left.  A merging task hands on its ``PER_TASK`` emptiest sequences at most and sets the
others aside, so tasks stay bounded however many sequences no other piece fits.  What is still underfull
after that, set aside or not, meets in one last round by classes of equal fill: the counts of at most
``CAPACITY`` classes are packed best-fit, and the sequences of each class are numbered by ranges and dealt to the
places of that plan, so no task takes them all.  Only lengths, ids and checksums
move between rounds.  Every round is written to the shared folder, so a lost executor cannot
make two rounds disagree.

Token ids are those of the byte-level BPE vocabulary file, computed by a rank-based encoder made
from the same file (it gives the ids of ``tokenizers`` about five times faster; tests compare them).

Defined cases: a null or empty text is the single end id 0; repeated rows are packed as often as
they occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import materialize, numbered, small_batches, table

QUERY = "op7_packing"

CAPACITY = 2048
END_ID = 0
#: Free tokens up to which a sequence counts as nearly full before the last round.
SLACK = 16
#: Pieces that one task packs at a time, and underfull sequences that a task of a later round hands on at most (the
#: first of these rounds gives as many to a task, the others FAN_IN times as many); the others meet in the last round.
BLOCK = 100_000
PER_TASK = 10_000
#: Partitions that a round merges into one.
FAN_IN = 8
#: Pattern that splits text before merges (fixed value of the vocabulary's byte-level scheme).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """Rank-based encoder of a byte-level BPE file whose ids follow its merge order."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(to_byte[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(text: str | None, path: str) -> np.ndarray:
    """The text's ids and the end id, as little-endian unsigned 32-bit numbers."""
    ids = encoder(path).encode_to_numpy(text, allowed_special="all") if text else np.zeros(0, np.uint32)
    return np.append(ids, np.uint32(END_ID)).astype("<u4")


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids; only the first may be shorter."""
    first = n % capacity or capacity
    return [(0, min(first, n))] + [(at, capacity) for at in range(first, n, capacity)]


def best_fit(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Best-fit decreasing: item numbers of each bin.

    Bins are kept by free space; the bits of one integer tell which spaces occur, so the tightest
    space that fits is found without a search over bins.
    """
    bins: list[list[int]] = []
    by_free: dict[int, list[int]] = {}
    spaces = 0
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        size = sizes[k]
        fitting = spaces >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                spaces &= ~(1 << free)
            bins[b].append(k)
        else:
            free, b = capacity, len(bins)
            bins.append([k])
        left = free - size
        if left:
            by_free.setdefault(left, []).append(b)
            spaces |= 1 << left
    return bins


def best_fit_classes(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing of ``counts`` items of each size, all equal items at once: the sizes in a bin, and how many such bins."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            free = min((f for f in bins if f >= size and bins[f]), default=capacity)
            held, n = bins[free].pop() if bins.get(free) else ((), left)
            each = min(free // size, left)
            used = min(n, left // each)
            if used < n and held:
                bins[free].append((held, n - used))
            bins.setdefault(free - size * each, []).append((held + (size,) * each, used))
            left -= used * each
    return [x for group in bins.values() for x in group]


SCHEMA = "sequence_id bigint, fill int, done boolean, aside boolean, members array<struct<doc_id: {id}, piece: int, start: bigint, length: bigint, crc: bigint, offset: bigint>>"
_MEMBER = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64()), ("offset", pa.int64())]


class _Packer:
    """Collects items (a size and its members' columns), packs a block of them and gives record batches."""

    def __init__(self, round_no: int, id_type: pa.DataType, slack: int, most: int | None = None):
        self.member = pa.struct([("doc_id", id_type), *_MEMBER])
        self.base = (round_no << 56) | (TaskContext.get().partitionId() << 32)
        self.slack, self.most, self.made = slack, most, 0
        self.sizes: list[int] = []
        self.items: list[list[tuple]] = []

    def add(self, size: int, members: list[tuple]) -> None:
        self.sizes.append(size)
        self.items.append(members)

    def flush(self) -> Iterator[pa.RecordBatch]:
        bins = best_fit(self.sizes)
        bins.sort(key=lambda members: sum(self.sizes[k] for k in members))  # the emptiest first
        for at in range(0, len(bins), 4096):
            part = bins[at : at + 4096]
            fills, columns, ends = [], [[] for _ in range(6)], [0]
            for members in part:
                offset = 0
                for k in members:
                    for m in self.items[k]:
                        for column, value in zip(columns, (*m, offset), strict=True):
                            column.append(value)
                        offset += m[3]
                fills.append(offset)
                ends.append(len(columns[0]))
            ids = [self.base + self.made + k for k in range(len(part))]
            done = [x >= CAPACITY - self.slack for x in fills]
            aside = [not full and self.most is not None and at + k >= self.most for k, full in enumerate(done)]
            self.made += len(part)
            struct = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.member, strict=True)], fields=list(self.member))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(fills, pa.int32()), pa.array(done, pa.bool_()), pa.array(aside, pa.bool_()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)],
                names=["sequence_id", "fill", "done", "aside", "members"],
            )
        self.sizes, self.items = [], []


def _first_round(docs: DataFrame, path: str) -> DataFrame:
    kind = docs.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(0, id_type, SLACK)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = token_ids(text, path)
                for piece, (start, length) in enumerate(cut(len(ids))):
                    packer.add(length, [(doc_id, piece, start, length, zlib.crc32(ids[start : start + length].tobytes()))])
            if len(packer.sizes) >= BLOCK:
                yield from packer.flush()
        yield from packer.flush()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA.format(id=kind.simpleString()))


def _next_round(bins: DataFrame, round_no: int, most: int) -> DataFrame:
    kind = bins.schema["members"].dataType.elementType["doc_id"].dataType
    id_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(round_no, id_type, SLACK, most)
        for batch in batches:
            for fill, members in zip(batch["fill"].to_pylist(), batch["members"].to_pylist(), strict=True):
                packer.add(fill, [(m["doc_id"], m["piece"], m["start"], m["length"], m["crc"]) for m in members])
            if len(packer.sizes) >= BLOCK:
                yield from packer.flush()
        yield from packer.flush()

    return bins.select("fill", "members").mapInArrow(run, SCHEMA.format(id=kind.simpleString()))


def _by_classes(underfull: DataFrame) -> DataFrame | None:
    """Where sequences of equal fill go in the last round: ``sequence_id``, ``into`` (the sequence that takes it) and ``shift``; null if
    no two fit together.  Only the counts of at most CAPACITY classes reach the driver."""
    spark = underfull.sparkSession
    counts = {r["fill"]: r["n"] for r in underfull.groupBy("fill").agg(F.count("*").alias("n")).collect()}
    plan = [(sizes, n) for sizes, n in best_fit_classes(counts) if len(sizes) > 1]
    if not plan:
        return None
    places, base, taken = [], 0, dict.fromkeys(counts, 0)
    for sizes, n in plan:
        shift = 0
        for size in sizes:
            places.append((str(size), taken[size], taken[size] + n, base, shift))
            taken[size] += n
            shift += size
        base += n
    dealt = spark.createDataFrame(places, "class string, first long, stop long, base long, shift long")
    ranked = numbered(underfull.select(F.col("fill").cast("string").alias("class"), "sequence_id"), "class", [F.col("sequence_id")], "packing-classes")
    met = ranked.join(dealt, "class").where((F.col("at") >= F.col("first")) & (F.col("at") < F.col("stop")))
    return met.select("sequence_id", (F.col("base") + F.col("at") - F.col("first") + F.lit(CLASS_BASE)).alias("into"), "shift")


#: Ids of sequences that the last round makes begin here; rounds before it count from their number times 2**56.
CLASS_BASE = 127 << 56


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``."""
    small_batches(docs.sparkSession)
    rounds = [materialize(_first_round(docs, tokenizer or default_tokenizer()), "packing-0")]
    kept, aside = [], []
    underfull = rounds[0].where("not done")
    parts = -(-underfull.count() // PER_TASK)
    while parts:
        made = materialize(_next_round(underfull.repartition(parts, "sequence_id"), len(rounds), PER_TASK), f"packing-{len(rounds)}")
        kept.append(rounds[-1].where("done"))
        rounds.append(made)
        aside.append(made.where("aside"))
        underfull = made.where("not done and not aside")
        parts = -(-parts // FAN_IN) if parts > 1 else 0
    kept.append(rounds[-1].where("done"))
    left = functools.reduce(DataFrame.unionByName, [underfull, *aside])
    whole = functools.reduce(DataFrame.unionByName, [*kept, left])
    rows = whole.select("sequence_id", "done", F.explode("members").alias("m"))
    moved = _by_classes(left.select("fill", "sequence_id"))
    if moved is None:
        return rows.select("m.doc_id", "m.piece", "m.start", "m.length", F.col("m.crc").alias("ids_crc32"), "sequence_id", "m.offset")
    rows = rows.join(moved, "sequence_id", "left")
    offset = F.col("m.offset") + F.coalesce("shift", F.lit(0))
    return rows.select("m.doc_id", "m.piece", "m.start", "m.length", F.col("m.crc").alias("ids_crc32"), F.coalesce("into", "sequence_id").alias("sequence_id"), offset.alias("offset"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the pipeline: the packed pieces."""
    return pack(docs)
