"""Document fingerprints: one-permutation MinHash in DataFrame functions only.

Hashes of five-word shingles are binned once by their high bits; a bin keeps its smallest hash.  Empty
bins are filled by optimal densification: each probes the bins in an order of its own, drawn by
hashing its number, and copies the first that holds a value.  The fingerprint packs the low-order
bits of all bins; the likeness of two fingerprints corrects the share of equal bins for chance
agreement of those bits.

The neighbour of a document in id order is found without a sort in one task: ids are dealt to ranges of
about equal numbers of rows, some for each shuffle partition, each range is a window of its own, and the first
row of each range is copied into the range before it.  Texts are shuffled once, and fingerprints are made
behind that shuffle, once for each row (and again for the one copy a range gets).

Defined cases: a null text counts as empty; texts of fewer than five words are one shingle, and a
wordless text is the empty shingle; equal texts have equal fingerprints; equal ids are ordered by
the hash of their text and then the text, null ids come last; in a table of one row the row follows itself; other columns are ignored.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table

QUERY = "op10_minhash"

SHINGLE = 5
#: Bins (a power of two) and low-order bits of each that are stored (a multiple of 4).
BIN_BITS = 7
BINS = 1 << BIN_BITS
LOW_BITS = 8
#: Rounds of densification before it is asked whether a text needs more.
FIRST_ROUNDS = 6
#: Ranges of ids for each shuffle partition.
RANGES_PER_TASK = 4
#: White space between words.
SPACE = r"[ \t-\r]+"


def shingle_hashes(text: Column) -> Column:
    """Hashes of all shingles of a text; at least one."""
    words = F.split(F.regexp_replace(F.lower(text), f"^{SPACE}|{SPACE}$", ""), SPACE)

    def hashes(w: Column) -> Column:
        at = lambda i, k: F.get(w, i + k)
        return F.when(
            F.size(w) >= SHINGLE,
            F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[at(i, k) for k in range(SHINGLE)])),
        ).otherwise(F.array(F.xxhash64(F.array_join(w, " "))))

    return _bound(words, hashes)


def _bin(h: Column) -> Column:
    """Bins are numbered in the signed order of their hashes."""
    return (F.shiftright(h, 64 - BIN_BITS) + BINS // 2).cast("int")


def bin_minima(text: Column) -> Column:
    """The smallest hash of each bin that has one, in order of the bins.

    Signed order keeps bins together (each bin is a range), so the first hash of a run is its minimum.
    """
    starts = lambda s: lambda h, i: (i == 0) | (F.shiftrightunsigned(h.bitwiseXOR(F.get(s, i - 1)), 64 - BIN_BITS) != 0)
    return _bound(F.sort_array(shingle_hashes(text)), lambda s: F.filter(s, starts(s)))


def _probe_orders() -> tuple[Column, Column]:
    """First probe and odd step of each bin, drawn by hashing its number: (first + t * step) mod BINS visits every bin once."""
    drawn = [zlib.crc32(f"bin {b}".encode()) for b in range(BINS)]
    return F.array(*[F.lit(x % BINS) for x in drawn]), F.array(*[F.lit(x // BINS % BINS | 1) for x in drawn])


def densified(minima: Column) -> Column:
    """Low-order bits of all bins, in order; an empty bin takes the value of the first full bin that its probes meet.

    Round t lets every empty bin look at its t-th probe.  A few rounds fill the bins of most texts; the rest of
    the rounds are for those with an empty bin left.
    """
    low = lambda h: h.bitwiseAND(F.lit((1 << LOW_BITS) - 1)).cast("int")
    first, step = _probe_orders()
    empty = F.lit(-1)

    def fill(given: Column) -> Column:
        probe = lambda b, t: (F.get(first, b) + F.get(step, b) * t).bitwiseAND(F.lit(BINS - 1))
        look = lambda v, t: F.transform(v, lambda x, b: F.when(x == empty, F.get(given, probe(b, t))).otherwise(x))
        more = lambda v, t: F.when(F.array_contains(v, empty), look(v, t)).otherwise(v)
        rounds = lambda a, b, v: F.aggregate(F.sequence(F.lit(a), F.lit(b - 1)), v, more)
        rest = lambda v: F.when(F.array_contains(v, empty), rounds(FIRST_ROUNDS, BINS, v)).otherwise(v)
        return _bound(rounds(0, FIRST_ROUNDS, given), rest)

    def spread(m: Column) -> Column:
        one, none, ones = (F.lit(x).cast("long") for x in (1, 0, -1))

        def half(upper: bool) -> Column:
            """Bits of the full bins of one half of the bins."""
            mine = lambda h: (_bin(h) >= BINS // 2) if upper else (_bin(h) < BINS // 2)
            return F.aggregate(m, none, lambda bits, h: F.when(mine(h), bits.bitwiseOR(F.call_function("shiftleft", one, _bin(h)))).otherwise(bits))

        def placed(halves: Column) -> Column:
            def value(b: Column) -> Column:
                lower, bit = b < BINS // 2, F.call_function("shiftleft", one, b)  # shifts count modulo 64
                bits = F.when(lower, halves["low"]).otherwise(halves["high"])
                below = F.bitwise_not(F.call_function("shiftleft", ones, b))
                before = F.bit_count(bits.bitwiseAND(below)) + F.when(lower, 0).otherwise(F.bit_count(halves["low"]))
                return F.when(bits.bitwiseAND(bit) != 0, low(F.get(m, before))).otherwise(empty)

            return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), value)

        halves = F.struct(half(False).alias("low"), half(True).alias("high"))
        return F.when(F.size(m) == BINS, F.transform(m, low)).otherwise(_bound(_bound(halves, placed), fill))

    return _bound(minima, spread)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def packed(bins: Column) -> Column:
    """Fingerprint string: LOW_BITS of each bin as hex digits."""
    return F.lower(F.array_join(F.transform(bins, lambda v: F.lpad(F.hex(v), LOW_BITS // 4, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two arrays of low-order bits, corrected for chance agreement."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(BINS))
    chance = 1.0 / (1 << LOW_BITS)
    return F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fp") -> DataFrame:
    """Add the array ``into`` of low-order bits of the column ``text`` (null: empty)."""
    return docs.withColumn(into, densified(bin_minima(F.coalesce(F.col(text), F.lit("")))))


def _below(bounds: list[int], key: Column, inclusive: bool) -> Column:
    """How many of the sorted bounds lie below the key (or at it), by binary search."""
    table, n = F.array(*map(F.lit, bounds)), len(bounds)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])

    def step(at: Column, width: Column) -> Column:
        bound = F.get(table, at + width - 1)
        return F.when((at + width <= n) & ((bound <= key) if inclusive else (bound < key)), at + width).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and ``fp`` of all rows, with ``next_text`` and ``next_fp`` of the next row by
    descending id; the last is followed by the first.

    The plan holds one bound for each of ``ranges`` ranges, whose number follows the shuffle partitions and not
    the rows; an id that many rows share spreads over as many ranges as it fills, by the hash of its texts.
    """
    ranges = ranges or RANGES_PER_TASK * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ids in reverse order, null last
    key = F.bitwise_not(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))))
    marks = [k / ranges for k in range(1, ranges)] or [0.5]
    bounds = docs.select(key.alias("key")).agg(F.percentile_approx("key", marks, 10 * ranges)).first()[0] or []
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"key": key, "hash": F.xxhash64("text")})
    part = F.lit(0)
    if bounds:
        low, high = _below(bounds, F.col("key"), False), _below(bounds, F.col("key"), True)
        part = low + F.when(high > low, F.floor((F.col("hash") / 2.0**64 + 0.5) * (high - low + 1)).cast("int")).otherwise(0)
    ranged = docs.withColumn("part", F.least(part, F.lit(ranges)).cast("int"))
    # the first row of a range follows the last of the range before it; there is one row for each range
    heads = ranged.groupBy("part").agg(F.min(F.struct("key", "hash")).alias("head"))
    before = F.coalesce(F.lag("part").over(Window.orderBy("part")), F.max("part").over(Window.partitionBy()))
    heads = heads.select("head.key", "head.hash", before.alias("before"))
    copies = ranged.join(F.broadcast(heads), ["key", "hash"])
    first = F.row_number().over(Window.partitionBy("before").orderBy("text"))
    copies = copies.withColumn("n", first).where("n = 1").withColumn("part", F.col("before")).select(*ranged.columns)
    rows = ranged.withColumn("copy", F.lit(0)).unionByName(copies.withColumn("copy", F.lit(1))).repartition("part")
    order = Window.partitionBy("part").orderBy("copy", "key", "hash", "text")
    found = fingerprints(rows).withColumns({"next_text": F.lead("text").over(order), "next_fp": F.lead("fp").over(order)})
    return found.where("copy = 0").select("doc_id", "text", "fp", "next_text", "next_fp")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(table(spark, sf_dir, "documents"))
    n = F.length("text")
    k = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("next_text"), F.lit(1), k)))
    rows = fingerprints(rows, "edited", "edited_fp")
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("fp")).alias("fingerprint"),
        packed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
