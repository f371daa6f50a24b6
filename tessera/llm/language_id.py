"""Language ID by language-bitmask n-gram filters.

One Bloom filter per language, stored bit-sliced: position ``i`` of the table holds a mask with a
bit for each language whose filter has bit ``i``.  The AND of an n-gram's positions returns all
languages that contain it; beyond 64 languages a mask is several words.  A filter holds every n-gram of its
language's sample, and the filters' size follows the largest of them.  Per-language popcounts over
a text, corrected for the filters' false positives, decide.

Defined cases: null texts and texts without a letter are ``und`` with score 0; texts with letters
but no known n-gram get the most frequent learned language with score 0; ties (very short texts whose n-grams
several languages hold) go to the language of more learnable rows, then to the one that sorts first; of several texts of one id in
a language the smallest is learned from; without learnable rows everything is ``und``.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import add_columns, held_out, learnable, private, small_batches, table

QUERY = "op8_language_id"

#: Documents of each language that the filters learn from, chosen by a hash of their id.
SAMPLE_PER_LANGUAGE = 2000
#: Bytes of an n-gram, bits of a filter for each n-gram, and hash functions.
GRAM = 4
BITS_PER_GRAM = 12
HASHES = 3
#: The pipeline rejects documents whose language is unknown or holds less than this part of their
#: n-grams; how many languages there are, and how many share an n-gram, plays no part.
MIN_SCORE = 0.2
#: ASCII letters in lower case; all other ASCII bytes count as a space.
FOLD = bytes((c | 32 if 65 <= c <= 90 else c) if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Odd multipliers of the hash functions (fixed values).
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


@dataclass
class LanguageFilters:
    languages: list[str] = field(default_factory=list)
    order: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # language numbers, the likeliest first
    slices: np.ndarray = field(default_factory=lambda: np.zeros(1, np.uint64))
    false_positive: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def lookup(self, grams: np.ndarray) -> np.ndarray:
        """Masks of all languages that contain each n-gram."""
        out = None
        for at in _positions(grams, len(self.slices)):
            out = self.slices[at] if out is None else out & self.slices[at]
        return out


def _bit(masks: np.ndarray, k: int) -> np.ndarray:
    """Nonzero where a mask has language ``k``."""
    return masks & masks.dtype.type(1 << k) if masks.ndim == 1 else masks[:, k // 64] & np.uint64(1 << k % 64)


def _positions(grams: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Positions of the n-grams under each hash function; ``size`` is a power of two."""
    shift = np.uint64(64 - size.bit_length() + 1)
    for k in range(HASHES):
        yield (grams * np.uint64(MULTIPLIERS[k]) >> shift).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def grams_of(text: str) -> np.ndarray:
    """All byte n-grams of the lower-cased text, one space before and after."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(FOLD) + b" " * (GRAM - 1), np.uint8).astype(np.uint64)
    n = len(raw) - GRAM + 1
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out |= raw[k : k + n] << np.uint64(8 * k)
    return out


def sample_ids(known: DataFrame, sizes: dict[str, int], per_language: int) -> DataFrame:
    """``lang`` and ``doc_id`` of the first ``per_language`` ids of each language by the hash of the id.

    ``sizes`` counts distinct ids.  Only hashes in the lowest part can be among them: twice the expected number, and some, meet in a window."""
    parts = [(lang, -(2.0**63) + 2.0**64 * min(1.0, (2 * per_language + 1000) / n)) for lang, n in sizes.items()]
    bounds = known.sparkSession.createDataFrame(parts, "lang string, bound double")
    low = known.select("doc_id", "lang").join(F.broadcast(bounds), "lang").where(F.xxhash64("doc_id").cast("double") <= F.col("bound")).select("lang", "doc_id").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    return low.withColumn("place", place).where(F.col("place") <= per_language).drop("place")


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageFilters:
    """Filters of all n-grams of at most ``per_language`` documents of each language.  Executors find each
    language's distinct n-grams; the driver gets eight bytes for each and sets their bits."""
    small_batches(docs.sparkSession)
    known = docs.where(learnable(F.col("doc_id")) & F.col("lang").isNotNull())
    held = known.select("lang", "doc_id").groupBy("lang", "doc_id").agg(F.count("*").alias("n")).groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("ids")).collect()
    sizes, ids = {r["lang"]: r["n"] for r in held}, {r["lang"]: r["ids"] for r in held}
    if not sizes:
        return LanguageFilters()
    languages = sorted(sizes)
    number = {lang: k for k, lang in enumerate(languages)}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: dict[int, list[np.ndarray]] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if has_letter(text):
                    texts.setdefault(number[lang], []).append(grams_of(text))
            for k, parts in texts.items():
                grams = np.unique(np.concatenate(parts))
                yield pa.RecordBatch.from_pydict({"number": np.full(len(grams), k, np.int32), "gram": grams.astype(np.int64)})

    chosen = sample_ids(known, ids, per_language)
    sample = known.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    rows = sample.select("lang", "text").mapInArrow(found, "number int, gram long").distinct().toArrow()
    numbers, grams = rows["number"].to_numpy(), rows["gram"].to_numpy().astype(np.uint64)
    by_frequency = sorted(range(len(languages)), key=lambda k: (-sizes[languages[k]], k))
    return build(languages, {lang: grams[numbers == k] for lang, k in number.items()}, by_frequency)


def build(languages: list[str], grams: dict[str, np.ndarray], order: list[int] | None = None) -> LanguageFilters:
    """Bit-sliced filters; masks use the narrowest unsigned type that has a bit for each language, or
    as many 64-bit words as needed."""
    largest = max([1, *map(len, grams.values())])
    size = 1 << max(10, (BITS_PER_GRAM * largest - 1).bit_length())
    width = next((t for bits, t in ((8, np.uint8), (16, np.uint16), (32, np.uint32)) if len(languages) <= bits), np.uint64)
    slices = np.zeros(size if len(languages) <= 64 else (size, -(-len(languages) // 64)), width)
    fill = np.zeros(len(languages))
    for k, lang in enumerate(languages):
        for at in _positions(grams.get(lang, np.zeros(0, np.uint64)), size):
            if slices.ndim == 1:
                slices[at] |= width(1 << k)
            else:
                slices[at, k // 64] |= width(1 << k % 64)
        fill[k] = np.count_nonzero(_bit(slices, k)) / size
    return LanguageFilters(languages, np.array(range(len(languages)) if order is None else order, np.int64), slices, fill**HASHES)


def judge(text: str | None, model: LanguageFilters) -> tuple[str, float, float]:
    """Language of a text, its share of the corrected counts of all languages, and the part of the
    text's n-grams that it holds."""
    if not model.languages or not has_letter(text):
        return "und", 0.0, 0.0
    masks = model.lookup(grams_of(text))
    hits = np.array([np.count_nonzero(_bit(masks, k)) for k in range(len(model.languages))], float)
    fp = model.false_positive
    true = np.round(np.maximum(0.0, (hits - len(masks) * fp) / np.maximum(1 - fp, 1e-9)), 6)
    best = int(model.order[true[model.order].argmax()])
    if not true.any():
        return model.languages[best], 0.0, 0.0
    return model.languages[best], float(true[best] / true.sum()), float(true[best] / len(masks))


def decide(text: str | None, model: LanguageFilters) -> tuple[str, float]:
    """Language of a text and its share."""
    return judge(text, model)[:2]


def predict(docs: DataFrame, model: LanguageFilters, carry: list[str] | None = None, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``lang_score`` (share) and ``lang_rate`` (part of the n-grams) to all rows."""

    def run(texts: list[str | None]) -> list:
        found = [judge(t, model) for t in texts]
        return [[x[k] for x in found] for k in range(3)]

    return add_columns(docs, {"lang_pred": "string", "lang_score": "double", "lang_rate": "double"}, run, carry, text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs.select("doc_id", "text"), fit(docs), carry=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language is known, with their own columns, whatever they are called."""
    model = fit(docs)
    own, text = private(docs)
    found = predict(own, model, text=text)
    return found.where((F.col("lang_pred") != "und") & (F.col("lang_rate") >= MIN_SCORE)).select(*own.columns).toDF(*docs.columns)
