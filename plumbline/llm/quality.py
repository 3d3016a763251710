"""Weak-label quality model: overlapping heuristic labellers, expectation-maximisation, a hashed linear scorer.

Eight labellers look at statistics of the whole text (plain words, marks, case, symbols, word length, repetition) and vote good, bad or abstain. How often each combination of votes
occurs is counted over all documents (3^8 combinations at most, so the driver's table is bounded), and EM estimates each
labeller's rates of votes among good and bad, and the posterior of `bad` for each combination. A logistic scorer over hashed byte 4-grams and hashed
classes of the statistics (4-grams alone do not show repetition) is then fitted to the posteriors of a bounded sample (`SAMPLE` documents) and scores all documents.

Defined cases: a null or empty text has no features; it is bad (score 0) and is not kept. Equal texts score alike; repeated
rows and null ids are kept as rows; if no labeller ever votes, everything scores alike and is kept; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import keep_rows
from plumbline.llm.textvec import Words, chunks, mix, ngrams, range_hashes, segment_sum, text_buffer

LABELLERS = ("plain words", "marks", "upper case", "symbols", "word length", "distinct words", "distinct 5-grams", "distinct lines")
#: Documents of which the scorer is fitted at most, about, and bytes of their features; drawn by hash over all documents.
SAMPLE, SAMPLE_BYTES = 4000, 64 << 20
FEATURE_BITS = 16
#: Value of a hashed statistic in the linear scorer, where the 4-grams of a document share the value 1.
STATISTIC = 0.25
MAX_WEIGHT = 3.0
#: Words in a block in which distinct words are counted, so that the share does not fall with the length of a text.
BLOCK = 256
#: Marks beyond the tolerated share that say nothing yet: a sentence of three words has its marks, too.
SPARE_MARKS = 5
STEPS = 120
#: Kept from this probability of `good` on.
KEEP = 0.5

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = _LETTER[128:] = True
_HEAD = np.zeros(256, bool)  # first bytes of characters
_HEAD[:128] = _HEAD[192:] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+=<>@^_`{}~[]\\/"]] = True


def _distinct(hashes: np.ndarray, first: np.ndarray, block: int | None = None) -> np.ndarray:
    """Share of different values among those of each document, or of each block of it; 1 for none."""
    size = np.diff(first)
    own = hashes ^ mix(np.repeat(np.arange(len(size), dtype=np.uint64), size) + np.uint64(1))
    if block:
        own = own ^ mix(((np.arange(len(hashes)) - np.repeat(first[:-1], size)) // block).astype(np.uint64) + np.uint64(1 << 32))
    _, at = np.unique(own, return_index=True)
    return np.where(size > 0, np.bincount(np.searchsorted(first, at, "right") - 1, minlength=len(size)) / np.maximum(size, 1), 1.0)


def statistics(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Per document: words (white-space separated), and shares of what the labellers look at."""
    count = lambda mask: segment_sum(mask.astype(np.int64), offs)
    space = (data == 32) | (data == 10) | (data == 9) | (data == 13)
    after = np.ones(len(data), bool)
    after[1:] = space[:-1]
    after[offs[offs < len(data)]] = True
    letter = _LETTER[data]
    starts = np.flatnonzero(after & ~space)
    first = np.searchsorted(starts, offs)
    stops = np.flatnonzero(np.append(space, True))
    ends = np.minimum(stops[np.searchsorted(stops, starts)], offs[np.searchsorted(offs, starts, "right")]) if len(starts) else starts
    other = np.concatenate([[0], np.cumsum(~letter)])
    odd = other[ends] - other[starts]
    last = data[ends - 1] if len(starts) else data[:0]
    plain = (odd == 0) | ((odd == 1) & ((last == 44) | (last == 46)))
    found = Words(data, offs)
    lines = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([offs[:-1][np.diff(offs) > 0], lines + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data))
    line_first = np.searchsorted(line_starts, offs)
    chars, words, n = count(_HEAD[data]), np.diff(first), np.maximum(np.diff(first), 1)
    one = np.maximum(chars, 1)
    grams, gram_first = ngrams(found, 5)
    return {
        "words": words, "chars": chars, "plain": segment_sum(plain.astype(np.int64), first) / n, "marks": count(~letter & ~space & ~((data >= 48) & (data <= 57))) / one,
        "upper": count(_UPPER[data]) / np.maximum(count(letter & _HEAD[data]), 1), "symbols": count(_SYMBOL[data]) / one, "word_length": count(~space & _HEAD[data]) / n,
        "distinct_words": _distinct(found.hashes, found.first, BLOCK), "distinct_grams": _distinct(grams, gram_first), "distinct_lines": _distinct(range_hashes(data, line_starts, line_ends), line_first),
    }


def votes(s: dict[str, np.ndarray]) -> np.ndarray:
    """(documents, labellers) from `statistics`: 0 good, 1 bad, 2 abstains."""
    bad = lambda mask: np.where(mask, 1, 2)
    v = [
        np.where(s["plain"] < 0.7, 1, np.where(s["plain"] > 0.93, 0, 2)), bad((s["marks"] - 0.08) * s["chars"] > SPARE_MARKS), bad(s["upper"] > 0.4), bad(s["symbols"] > 0.04), bad((s["word_length"] > 18) | (s["word_length"] < 2)),
        bad(s["distinct_words"] < 0.4), np.where(s["distinct_grams"] < 0.7, 1, np.where(s["distinct_grams"] > 0.95, 0, 2)), bad(s["distinct_lines"] < 0.7),
    ]
    return np.stack(v, 1).astype(np.int64)


_PLACE = 3 ** np.arange(len(LABELLERS))


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Posterior of `bad` for each combination of votes: each labeller has rates of its three votes among good and bad.

    Rates differ by class, since a labeller of one defect is rarely wrong when it votes bad and blind to other defects.
    Starts at one bad document in five and a bad vote much likelier on those. A vote never argues against its own side,
    abstaining says nothing, and a single vote weighs e^3 at most, so no labeller decides alone against others.
    """
    is_vote = patterns[:, :, None] == np.arange(3)
    first = np.array([[0.6, 0.05, 0.35], [0.2, 0.4, 0.4]])
    rates, prior = np.repeat(first[:, None], patterns.shape[1], 1), 0.2
    low, high = np.array([-MAX_WEIGHT, 0.0, 0.0]), np.array([0.0, MAX_WEIGHT, 0.0])
    bad = np.zeros(len(patterns))
    for _ in range(rounds):
        weight = np.clip(np.log(rates[1] / rates[0]), low, high)
        odds = (is_vote * weight).sum((1, 2)) + np.log(prior / (1 - prior))
        new = 1 / (1 + np.exp(-odds))
        if np.abs(new - bad).max(initial=0) < 1e-9:
            break
        bad = new
        for k, share in enumerate((1 - bad, bad)):
            seen = ((counts * share)[:, None, None] * is_vote).sum(0) + 10 * first[k]
            rates[k] = seen / seen.sum(1, keepdims=True)
        prior = min(max(float((counts * bad).sum() / max(counts.sum(), 1)), 0.01), 0.5)
    return bad


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed feature of every byte 4-gram, offsets of documents)."""
    b = np.zeros(len(data) + 3, np.uint32)
    b[: len(data)] = data
    gram = b[:-3] | (b[1:-2] << np.uint32(8)) | (b[2:-1] << np.uint32(16)) | (b[3:] << np.uint32(24))
    gram = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - FEATURE_BITS)
    return gram, offs


def classes(s: dict[str, np.ndarray]) -> np.ndarray:
    """(documents, statistics): hashed feature of each statistic's class."""
    shares = ("plain", "marks", "upper", "symbols", "distinct_words", "distinct_grams", "distinct_lines")
    level = np.stack([np.minimum(np.sqrt(s[k]) * 16, 16) for k in shares] + [np.minimum(s["word_length"], 31)], 1).astype(np.uint64)
    return (mix(level + np.arange(level.shape[1], dtype=np.uint64) * np.uint64(64) + np.uint64(1)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], bad: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by Adagrad on (features, values); returns (weights, bias) of the log odds of `good`."""
    index = np.concatenate([i for i, _ in rows]) if rows else np.zeros(0, np.int64)
    value = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)
    of = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    w, bias = np.zeros(1 << FEATURE_BITS), 0.0
    past, past_bias = np.full(len(w), 1e-8), 1e-8
    for _ in range(STEPS if rows else 0):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(of, w[index] * value, len(rows)) + bias, -50, 50)))
        error = (p - (1 - bad)) / len(rows)
        g = np.bincount(index, error[of] * value, len(w)) + 1e-7 * w
        past += g * g
        past_bias += error.sum() ** 2
        w -= 2.0 * g / np.sqrt(past)
        bias -= 0.2 * error.sum() / np.sqrt(past_bias)
    return w, bias


class Scorer:
    def __init__(self, patterns: np.ndarray, bad: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(patterns)
        self.patterns, self.bad, self.weights, self.bias = patterns[order], bad[order], weights, bias

    def posterior(self, stats: dict[str, np.ndarray]) -> np.ndarray:
        """Posterior of `good` from the votes alone."""
        code = votes(stats) @ _PLACE
        return 1 - self.bad[np.searchsorted(self.patterns, code)]

    def score(self, data: np.ndarray, offs: np.ndarray, stats: dict[str, np.ndarray]) -> np.ndarray:
        """Probability of `good` by the linear scorer; 0 for an empty text."""
        if not len(data):
            return np.zeros(len(offs) - 1)
        gram, first = features(data, offs)
        size = np.diff(offs)
        odds = segment_sum(self.weights[gram], first) / np.maximum(size, 1) + STATISTIC * self.weights[classes(stats)].sum(1) + self.bias
        return np.where(size > 0, 1 / (1 + np.exp(-np.clip(odds, -50, 50))), 0.0)


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        data, offs = text_buffer(batch.column("text"))
        code, back, n = np.unique(votes(statistics(data, offs)) @ _PLACE, return_inverse=True, return_counts=True)
        most = np.bincount(back, np.minimum(np.diff(offs), 1 << FEATURE_BITS), len(code)).astype(np.int64)
        yield pa.record_batch([pa.array(code), pa.array(n), pa.array(most)], ["pattern", "n", "most"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        data, offs = text_buffer(batch.column("text"))
        stats = statistics(data, offs)
        code, extra = votes(stats) @ _PLACE, classes(stats)
        gram, _ = features(data, offs)
        index, value = [], []
        for a, b, more in zip(offs[:-1], offs[1:], extra, strict=True):
            i, v = np.unique(gram[a:b], return_counts=True)
            index.append(np.concatenate([i, more]).astype(np.uint16).tobytes())
            value.append(np.concatenate([v / max(b - a, 1), np.full(len(more), STATISTIC)]).astype(np.float32).tobytes())
        yield pa.record_batch([pa.array(code), pa.array(index), pa.array(value)], ["pattern", "index", "value"])


def train(docs: DataFrame, sample: int = SAMPLE) -> Scorer:
    counted = docs.select("text").mapInArrow(_patterns, "pattern long, n long, most long").groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("most").alias("most")).toPandas()
    code, n = counted["pattern"].to_numpy(np.int64), counted["n"].to_numpy(np.float64)
    bad = fit_votes(code[:, None] // _PLACE % 3, n)
    order = np.argsort(code)
    size = 6 * max(int(counted["most"].sum()), 1)  # a feature takes 6 bytes; a text has no more features than bytes, nor than there are
    share = int(min(1.0, sample / max(n.sum(), 1), SAMPLE_BYTES / size) * (1 << 30))
    draw = F.pmod(F.xxhash64(F.col("text"), F.col("doc_id").cast("string")), F.lit(1 << 30)) < share
    drawn = docs.where(draw & F.col("text").isNotNull()).select("text").mapInArrow(_sampled, "pattern long, index binary, value binary").toArrow()
    rows = [(np.frombuffer(i, np.uint16).astype(np.int64), np.frombuffer(v, np.float32).astype(np.float64)) for i, v in zip(drawn["index"].to_pylist(), drawn["value"].to_pylist(), strict=True)]
    target = bad[order][np.searchsorted(code[order], np.array(drawn["pattern"].to_pylist(), np.int64))] if rows else np.zeros(0)
    weights, bias = fit_scorer(rows, target)
    return Scorer(code, bad, weights, bias)


def classify(docs: DataFrame, model: Scorer | None = None) -> DataFrame:
    """doc_id, n_votes, posterior (of good, from the votes), score (of good, by the scorer), kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            data, offs = text_buffer(batch.column("text"))
            stats = statistics(data, offs)
            n = (votes(stats) < 2).sum(1)
            score = shared.value.score(data, offs, stats)
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int32()), pa.array(shared.value.posterior(stats)), pa.array(score), pa.array(score >= KEEP)], ["doc_id", "n_votes", "posterior", "score", "kept"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_votes int, posterior double, score double, kept boolean")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))

    def keep(batch: pa.RecordBatch) -> np.ndarray:
        data, offs = text_buffer(batch.column("text"))
        return shared.value.score(data, offs, statistics(data, offs)) >= KEEP

    return keep_rows(docs, lambda: keep)
