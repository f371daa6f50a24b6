"""Toxicity: a linear-chain conditional random field tags toxic spans.

``fit`` labels tokens of a bounded sample of labelled documents (a token is toxic where its
document is and its word, or a stem of it, is far more frequent among toxic documents), trains the
field by gradient ascent on forward-backward marginals and calibrates document scores.  Emissions
sum the weights of a word and of its prefixes, so inflected forms of a toxic stem count too.  ``score`` runs
forward-backward over every token of every text and returns a score and the offending offsets.

Features are those of the tokens that carry a toxic feature (all other weights would stay at
zero), however many there are.  All tokens without a feature emit the same, so training takes a run of
them as a power of one 2 x 2 matrix: whole documents are sequences, and the driver holds only the
marked tokens of the sample.

Defined cases: null and empty texts have no tokens and get the calibrated score of a text without
toxic tokens; repeated rows get equal scores; rows of ``labels`` with a null id or label are not
learned from, and several labels of one id count as toxic if any is; of several texts of one id the smallest
is learned from; without labelled rows of both kinds, or without a toxic feature, the score is the labelled
share of toxic rows (0 without any) and the stage rejects nothing.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import add_columns, discard, held_out, learnable, materialize, private, small_batches, table

QUERY = "op3_toxicity"
WORD = re.compile(r"[^\W_]+")

#: Labelled documents of each class that the field learns from, chosen by a hash of their id.
SAMPLE_PER_CLASS = 4000
#: Tasks that the sample is dealt to.
SAMPLE_TASKS = 12
#: Lengths of the prefixes whose weights the field learns besides those of words.
PREFIXES = (4, 5, 6)
#: Words whose emission a task keeps at a time.
CACHE = 200_000
#: A word or prefix marks toxic tokens from this many toxic documents, this log ratio of document
#: rates and this likelihood ratio statistic (chance alone rarely passes) on.
MIN_TOXIC_DOCS = 3
MIN_LOG_RATIO = 2.5
MIN_EVIDENCE = 18.0
#: Blocks of the blocked forward-backward scan, over tokens and over the fewer segments of training.
BLOCK = 128
SEGMENT_BLOCK = 16
THRESHOLD = 0.3
CLIP = 30.0


@dataclass
class ToxicityModel:
    """Feature weights and bias (log odds of tag 1), transition weights and calibration."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: float = 0.0
    calibration: np.ndarray | None = None
    prior: float = 0.0


# ---------------------------------------------------------------- forward-backward


def _ratio_scan(maps: np.ndarray, lens: np.ndarray, first: float, block: int = BLOCK) -> np.ndarray:
    """f[t] = (p f[t-1] + q) / (r f[t-1] + s) along each sequence from ``first`` on; ``maps`` has rows p, q, r, s.

    The steps are fractional linear maps, so sequences are cut into blocks of equal length, the map
    of each whole block is composed, entry values are chained from block to block, and all blocks
    are then filled in at once.  Exact, and the number of steps does not follow the longest text.
    """
    n_blocks = -(-lens // block)
    total = int(n_blocks.sum())
    if total == 0:
        return np.zeros(0)
    seq_first = np.cumsum(n_blocks) - n_blocks
    tok_first = np.cumsum(lens) - lens
    seq_of = np.repeat(np.arange(len(lens)), lens)
    pos = np.arange(maps.shape[1]) - tok_first[seq_of]
    row, col = pos % block, seq_first[seq_of] + pos // block
    cells = np.zeros((4, block, total))
    cells[0] = cells[3] = 1.0
    cells[:, row, col] = maps
    ca, cb, cc, cd = cells
    ma, mb, mc, md = np.ones(total), np.zeros(total), np.zeros(total), np.ones(total)
    for t in range(block):
        ma, mb, mc, md = ca[t] * ma + cb[t] * mc, ca[t] * mb + cb[t] * md, cc[t] * ma + cd[t] * mc, cc[t] * mb + cd[t] * md
        if t % 4 == 3:
            top = ma + mb + mc + md
            ma, mb, mc, md = ma / top, mb / top, mc / top, md / top
    entry = np.zeros(total)
    order = np.argsort(-n_blocks, kind="stable")
    sizes = n_blocks[order]
    value = np.full(len(lens), first)
    for k in range(int(sizes[0])):
        live = order[: np.searchsorted(-sizes, -k, side="left")]
        at = seq_first[live] + k
        entry[at] = value[live]
        value[live] = (ma[at] * value[live] + mb[at]) / (mc[at] * value[live] + md[at])
    out, f = np.empty((block, total)), entry
    for t in range(block):
        f = (ca[t] * f + cb[t]) / (cc[t] * f + cd[t])
        out[t] = f
    return out[row, col]


def _reverse(lens: np.ndarray) -> np.ndarray:
    """Index that reverses each of the concatenated sequences."""
    ends = np.cumsum(lens)
    return np.repeat(ends - 1 + (ends - lens), lens) - np.arange(int(lens.sum()))


def _token_maps(w: np.ndarray, lens: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Maps of the ratios w[t] (a01 + a11 f) / (a00 + a10 f); the first of a sequence is w[t] f."""
    maps = np.empty((4, len(w)))
    maps[0], maps[1], maps[2], maps[3] = w * a[1, 1], w * a[0, 1], a[1, 0], a[0, 0]
    begin = (np.cumsum(lens) - lens)[lens > 0]
    maps[0, begin], maps[1:3, begin], maps[3, begin] = w[begin], 0.0, 1.0
    return maps


def forward_backward(e: np.ndarray, lens: np.ndarray, model: ToxicityModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: forward ratio, backward ratio and the marginal probability of tag 1."""
    w, a = np.exp(np.clip(e, -CLIP, CLIP)), np.exp(model.trans)
    f = _ratio_scan(_token_maps(w, lens, a), lens, float(np.exp(model.start)))
    back = _reverse(lens)
    b = (_ratio_scan(_token_maps(w[back], lens, a.T), lens, 1.0) / w[back])[back]
    odds = f * b
    return f, b, odds / (1 + odds)


# ---------------------------------------------------------------- training


def features(word: str) -> list[str]:
    """The word and its prefixes."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)]


class Emissions(dict):
    """Word to emission; at most ``CACHE`` words are kept."""

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.model = model
        self.tables = (np.zeros(0), np.zeros(0))
        self.plain: dict[int, tuple[float, float]] = {}

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        get = self.model.weights.get
        value = self[word] = self.model.bias + sum(get(x, 0.0) for x in features(word))
        return value

    def of_plain(self, n: int) -> tuple[float, float]:
        """Largest marginal and mass of ``n`` tokens without a feature: their forward ratios depend only on
        the place from the start, their backward ratios only on the place from the end."""
        if n not in self.plain:
            if n > len(self.tables[0]):
                size = 2 * n
                f, b, _ = forward_backward(np.full(size, self.model.bias), np.array([size]), self.model)
                self.tables = f, b[::-1]
            odds = self.tables[0][:n] * self.tables[1][:n][::-1]
            p = odds / (1 + odds)
            self.plain[n] = float(p.max()), float(p[p >= 0.1].sum())
        return self.plain[n]


@dataclass
class Marked:
    """Marked tokens of documents, one document after another: how many each document has, the unmarked
    tokens before each and at the documents' ends, feature numbers (padded) and tags."""

    counts: np.ndarray
    before: np.ndarray
    ends: np.ndarray
    found: np.ndarray
    tags: np.ndarray


def _powers(m: np.ndarray, grads: np.ndarray, exponents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``m`` to each exponent and the powers' derivatives along ``grads``, both up to one factor for each exponent."""
    p = np.broadcast_to(np.eye(2), (len(exponents), 2, 2)).copy()
    d = np.zeros((len(grads), len(exponents), 2, 2))
    for bit in range(int(exponents.max(initial=0)).bit_length()):
        on = exponents >> bit & 1 == 1
        d[:, on] = grads[:, None] @ p[on] + m @ d[:, on]
        p[on] = m @ p[on]
        scale = p[on].sum((1, 2), keepdims=True)
        p[on] /= scale
        d[:, on] /= scale
        grads, m = grads @ m + m @ grads, m @ m
        grads, m = grads / m.sum(), m / m.sum()
    return p, d


def gradient(data: Marked, e: np.ndarray, bias: float, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the marked tokens (with emissions ``e``) and expected numbers of the transitions
    over all tokens.  A document begins as if behind a token of tag 0."""
    a, w, free = np.exp(trans), np.exp(np.clip(e, -CLIP, CLIP)), float(np.exp(np.clip(bias, -CLIP, CLIP)))
    step = np.array([[a[0, 0], a[1, 0]], [free * a[0, 1], free * a[1, 1]]])
    grads = np.zeros((4, 2, 2))  # by transition 00, 01, 10, 11
    grads[0, 0, 0], grads[1, 1, 0], grads[2, 0, 1], grads[3, 1, 1] = step[0, 0], step[1, 0], step[0, 1], step[1, 1]
    lens = 2 * data.counts + 1
    last = np.cumsum(lens) - 1
    run = np.zeros(int(lens.sum()), bool)
    run[last] = True
    first = last - lens + 1
    inside = np.arange(len(run)) - np.repeat(first, lens)
    run |= inside % 2 == 0
    length = np.empty(len(run), np.int64)
    length[last] = data.ends
    is_end = np.zeros(len(run), bool)
    is_end[last] = True
    length[run & ~is_end] = data.before
    known, which = np.unique(length[run], return_inverse=True)
    powers, slopes = _powers(step, grads, known)
    m = np.empty((len(run), 2, 2))
    m[run] = powers[which]
    m[~run, 0, 0], m[~run, 0, 1], m[~run, 1, 0], m[~run, 1, 1] = a[0, 0], a[1, 0], w * a[0, 1], w * a[1, 1]
    maps = np.stack([m[:, 1, 1], m[:, 1, 0], m[:, 0, 1], m[:, 0, 0]])
    f = _ratio_scan(maps, lens, 0.0, SEGMENT_BLOCK)
    back = _reverse(lens)
    b = _ratio_scan(np.stack([m[:, 1, 1], m[:, 0, 1], m[:, 1, 0], m[:, 0, 0]])[:, back], lens, 1.0, SEGMENT_BLOCK)[back]
    entry, leave = np.append(0.0, f[:-1]), np.append(b[1:], 1.0)
    entry[first], leave[last] = 0.0, 1.0
    x, y = entry[~run], leave[~run]
    pair = np.stack([np.full(len(x), a[0, 0]), a[0, 1] * w * y, a[1, 0] * x, a[1, 1] * x * w * y])
    pair /= pair.sum(0)
    x, y = entry[run], leave[run]
    spread = lambda q: q[..., 0, 0] + q[..., 0, 1] * x + y * (q[..., 1, 0] + q[..., 1, 1] * x)
    runs = spread(slopes[:, which]) / spread(powers[which])
    return pair[1] + pair[3], (pair.sum(1) + runs.sum(1)).reshape(2, 2)


def _seen(data: Marked) -> np.ndarray:
    """Numbers of the transitions that the tags show, unmarked tokens having tag 0."""
    y = data.tags.astype(bool)
    last = np.cumsum(data.counts) - 1
    begins = np.zeros(len(y), bool)
    begins[(last - data.counts + 1)[data.counts > 0]] = True
    joined = ~begins & (data.before == 0)
    previous = np.append(False, y[:-1])[: len(y)] & joined
    followed = np.append(data.before[1:] > 0, False)[: len(y)]
    followed[last[data.counts > 0]] = data.ends[data.counts > 0] > 0
    n11, n01 = (y & previous).sum(), (y & ~previous).sum()
    n10 = (~y & previous).sum() + (y & followed).sum()
    total = len(y) + data.before.sum() + data.ends.sum()
    return np.array([[total - n11 - n01 - n10, n01], [n10, n11]], float)


def train_field(data: Marked, names: list[str], steps: int = 80, rate: float = 0.5, l2: float = 2.0) -> ToxicityModel:
    """Maximum likelihood with Adagrad."""
    pad, y = len(names), data.tags.astype(float)
    trans, theta, bias = np.array([[0.0, -1.0], [-1.0, 0.0]]), np.zeros(pad + 1), -2.0
    seen = _seen(data)
    squares = [np.full(pad + 1, 1e-6), np.full((2, 2), 1e-6), 1e-6]
    shrink = l2 / np.sqrt(1 + np.bincount(data.found.ravel(), minlength=pad + 1))
    for _ in range(steps):
        p, expected = gradient(data, theta[data.found].sum(1) + bias, bias, trans)
        g_theta = -shrink * theta
        for k in range(data.found.shape[1]):
            g_theta += np.bincount(data.found[:, k], weights=y - p, minlength=pad + 1)
        g_theta[pad] = 0
        g_trans = seen - expected - l2 * trans
        g_bias = (seen - expected)[:, 1].sum() - l2 * bias
        for k, g in enumerate((g_theta, g_trans, g_bias)):
            squares[k] = squares[k] + g * g
        theta += rate * g_theta / np.sqrt(squares[0])
        trans = trans + rate * g_trans / np.sqrt(squares[1])
        bias += rate * g_bias / np.sqrt(squares[2])
    weights = {x: float(theta[k]) for k, x in enumerate(names) if abs(theta[k]) > 1e-3}
    return ToxicityModel(weights, float(bias), trans, float(trans[0, 1] - trans[0, 0]))


def _words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame | None, dict[int, int]]:
    """Distinct texts and classes of at most ``per_class`` labelled ids of each class, and the classes' numbers of ids."""
    known = materialize(
        labels.where(learnable(F.col("doc_id")) & F.col("toxic").isNotNull())
        .groupBy("doc_id")
        .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
        .join(docs.select("doc_id").distinct(), "doc_id", "left_semi"),
        "labelled",
    )
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    sample = None
    if len(sizes) == 2:
        parts = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
        rows = docs.select("doc_id", "text").join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")
        rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
        sample = materialize(rows.select("text", "toxic").distinct().repartition(SAMPLE_TASKS), "labelled-sample")  # copies say nothing new
    discard(known)
    return sample, sizes


def _feature_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = (Counter(), Counter())
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            seen[toxic].update({x for w in set(_words(text)) for x in features(w)})
        words = list(seen[1])  # a feature without a toxic document marks nothing
        clean = list(seen[0])
        yield pa.RecordBatch.from_pydict({"feature": pa.array(words + clean, pa.string()), "clean_docs": [0] * len(words) + list(seen[0].values()), "toxic_docs": list(seen[1].values()) + [0] * len(clean)})


def _evidence(a: Column, n_a: int, b: Column, n_b: int) -> Column:
    """Likelihood ratio statistic of the rates a / n_a and b / n_b against one common rate."""
    whole = (a + b) / F.lit(float(n_a + n_b))
    parts = [(k, n, q) for x, n in ((a, n_a), (b, n_b)) for k, q in ((x, whole), (F.lit(n) - x, 1 - whole))]
    return 2 * sum((F.when(k > 0, k * F.log(k / (q * n))).otherwise(0.0) for k, n, q in parts), F.lit(0.0))


def _toxic_features(sample: DataFrame, n: dict[int, int]) -> set[str]:
    """Features of much toxic evidence, of whatever frequency."""
    toxic, clean = F.col("toxic_docs"), F.col("clean_docs")
    counts = sample.mapInArrow(_feature_documents, "feature string, clean_docs long, toxic_docs long").groupBy("feature").agg(F.sum("clean_docs").alias("clean_docs"), F.sum("toxic_docs").alias("toxic_docs"))
    ratio = F.log((toxic + 0.5) / (n[1] + 1)) - F.log((clean + 0.5) / (n[0] + 1))
    rows = counts.where((toxic >= MIN_TOXIC_DOCS) & (ratio >= MIN_LOG_RATIO) & (_evidence(toxic, n[1], clean, n[0]) >= MIN_EVIDENCE))
    candidates = materialize(rows, "toxic-candidates")
    # near copies of one toxic document repeat its words in the same places, so their number is no evidence
    contexts = _contexts(sample, {r["feature"] for r in candidates.select("feature").collect()})
    told = F.least(toxic, F.col("contexts"))
    marks = candidates.join(contexts, "feature").where((told >= MIN_TOXIC_DOCS) & (_evidence(told, n[1], clean, n[0]) >= MIN_EVIDENCE))
    found = {r["feature"] for r in marks.select("feature").collect()}
    discard(candidates)
    return found


def _contexts(sample: DataFrame, candidates: set[str]) -> DataFrame:
    """``feature`` and ``contexts``: distinct preceding words of each candidate in toxic documents."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for text in batch["text"].to_pylist():
                last = ""
                for w in _words(text):
                    found.update((x, last) for x in features(w) if x in candidates)
                    last = w
            yield pa.RecordBatch.from_pydict({"feature": pa.array([x for x, _ in found], pa.string()), "before": pa.array([y for _, y in found], pa.string())})

    return sample.where("toxic = 1").mapInArrow(pairs, "feature string, before string").distinct().groupBy("feature").agg(F.count("*").alias("contexts"))


def _marked_tokens(sample: DataFrame, toxic_features: set[str]) -> tuple[Marked, list[str]]:
    """All documents of the sample as marked tokens and the runs between them, and the features' names."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for batch in batches:
            words, before, ends = [], [], []
            for text in batch["text"].to_pylist():
                kept, runs, run = [], [], 0
                for w in _words(text):
                    hit = known.get(w)
                    if hit is None:
                        hit = known[w] = not toxic_features.isdisjoint(features(w))
                    if hit:
                        kept.append(w)
                        runs.append(run)
                        run = 0
                    else:
                        run += 1
                words.append(kept)
                before.append(runs)
                ends.append(run)
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(words, pa.list_(pa.string())), pa.array(before, pa.list_(pa.int64())), pa.array(ends, pa.int64())], names=["toxic", "words", "before", "rest"])

    rows = sample.mapInArrow(mark, "toxic int, words array<string>, before array<long>, rest long").toArrow()
    counts = rows["words"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    coded = rows["words"].combine_chunks().flatten().dictionary_encode()
    of_words = [features(w) for w in coded.dictionary.to_pylist()]
    names = sorted({x for xs in of_words for x in xs})
    number = {x: k for k, x in enumerate(names)}
    width = 1 + len(PREFIXES)
    by_word = np.array([([number[x] for x in xs] + [len(names)] * width)[:width] for xs in of_words], np.int32).reshape(-1, width)
    before = rows["before"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    tags = np.repeat(rows["toxic"].to_numpy(), counts).astype(np.int8)
    return Marked(counts, before, rows["rest"].to_numpy(), by_word[coded.indices.to_numpy(zero_copy_only=False)], tags), names


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> ToxicityModel:
    """Learn from at most ``per_class`` documents of each class.  The sample is written once; evidence is weighed
    by Spark, and the driver gets the toxic features and the sample's marked tokens."""
    small_batches(docs.sparkSession)
    sample, sizes = _sample(docs, labels, per_class)
    total = sum(sizes.values())
    prior = sizes.get(1, 0) / total if total else 0.0
    if sample is None:
        return ToxicityModel(prior=prior)
    model = _fit_sample(sample, sizes)
    model.prior = prior
    discard(sample)
    return model


def _fit_sample(sample: DataFrame, sizes: dict[int, int]) -> ToxicityModel:
    n = {y: 0 for y in (0, 1)} | {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic_features = _toxic_features(sample, n) if n[1] and n[0] else set()
    if not toxic_features:
        return ToxicityModel()
    model = train_field(*_marked_tokens(sample, toxic_features))
    rows = sample.mapInArrow(lambda batches: _features(batches, model), "toxic int, top double, mass double").toArrow()
    x = np.stack([np.ones(rows.num_rows), rows["top"].to_numpy(), rows["mass"].to_numpy()], 1)
    y = rows["toxic"].to_numpy().astype(float)
    # classes count by their share of all labelled ids
    weight = np.where(y == 1, sizes[1] / n[1], sizes[0] / n[0]) / sum(sizes.values()) * len(y)
    model.calibration = _logistic(x, y, weight)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton's method; the intercept is not shrunk."""
    beta = np.zeros(x.shape[1])
    shrink = np.diag([1e-6] + [l2] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -CLIP, CLIP)))
        grad = x.T @ (weight * (y - p)) - shrink @ beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + shrink
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


# ---------------------------------------------------------------- scoring


def _marginals(texts: list[str | None], model: ToxicityModel, emissions: Emissions) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of all tokens of the texts, one after another, the texts' token counts, and per text the
    largest marginal's log odds and the log of the expected count of likely toxic tokens.

    A text whose tokens all lack features and stay unlikely is not counted among the tokens."""
    best, mass, kept = np.full(len(texts), np.nan), np.zeros(len(texts)), []
    lens = np.zeros(len(texts), int)
    for k, text in enumerate(texts):
        e = np.array([emissions[w] for w in _words(text)])
        if not len(e):
            continue
        if (e == model.bias).all():
            best[k], mass[k] = emissions.of_plain(len(e))
            if not mass[k]:
                continue
        kept.append(e)
        lens[k] = len(e)
    p = forward_backward(np.concatenate(kept) if kept else np.zeros(0), lens, model)[2]
    full = lens > 0
    if full.any():
        at = (np.cumsum(lens) - lens)[full]
        best[full] = np.maximum.reduceat(p, at)
        mass[full] = np.add.reduceat(np.where(p >= 0.1, p, 0.0), at)
    best = np.clip(best, 1e-13, 1 - 1e-13)
    top = np.where(np.isnan(best), -CLIP, np.log(best / (1 - best)))
    return p, lens, np.clip(top, -10, 10) / 10, np.log1p(mass)


def _features(batches: Iterator[pa.RecordBatch], model: ToxicityModel) -> Iterator[pa.RecordBatch]:
    emissions = Emissions(model)
    for batch in batches:
        if batch.num_rows:
            _, _, top, mass = _marginals(batch["text"].to_pylist(), model, emissions)
            yield pa.RecordBatch.from_pydict({"toxic": batch["toxic"], "top": top, "mass": mass})


def _spans(text: str, p: np.ndarray) -> str:
    """Runs of tokens with a marginal of one half or more, as start-end code point offsets."""
    runs: list[list[int]] = []
    last = -2
    for k, m in enumerate(WORD.finditer(text.lower())):
        if p[k] >= 0.5:
            if last == k - 1:
                runs[-1][1] = m.end()
            else:
                runs.append([m.start(), m.end()])
            last = k
    return ",".join(f"{a}-{b}" for a, b in runs)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, carry: list[str] | None = None, text: str = "text") -> DataFrame:
    """Add ``tox_score``, ``tox_predicted`` and ``tox_spans`` (offsets into the lower-cased text) to all rows."""

    emissions = Emissions(model)

    def run(texts: list[str | None]) -> list:
        spans = [""] * len(texts)
        if model.calibration is None:
            value = np.full(len(texts), model.prior)
        else:
            p, lens, top, mass = _marginals(texts, model, emissions)
            z = np.stack([np.ones(len(top)), top, mass], 1) @ model.calibration
            value = 1 / (1 + np.exp(-np.clip(z, -CLIP, CLIP)))
            first = np.cumsum(lens) - lens
            for k in np.flatnonzero(mass > 0):
                spans[k] = _spans(texts[k], p[first[k] : first[k] + lens[k]])
        return [value, (value >= threshold).astype("int32"), spans]

    return add_columns(docs, {"tox_score": "double", "tox_predicted": "integer", "tox_spans": "string"}, run, carry, text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")), carry=["doc_id"])
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("tox_score").alias("score"),
        F.col("tox_predicted").alias("predicted"),
        F.col("tox_spans").alias("spans"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the field does not reject, with their own columns, whatever they are called."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    if model.calibration is None:
        return docs
    own, text = private(docs)
    return score(own, model, text=text).where(F.col("tox_predicted") == 0).select(*own.columns).toDF(*docs.columns)
