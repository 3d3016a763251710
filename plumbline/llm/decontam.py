"""Benchmark decontamination: rare words of a test item find passages, Smith-Waterman alignment of words scores them.

The score is the local alignment's, over that of the item with itself; a pair is reported if it reaches `THRESHOLD`
and the alignment is worth more than two words (`LEAST`), or all of an item of one or two words. The seeds are n-grams of n = 1: longer
ones miss copies in which every second or third word was changed, which still reach 0.5. Such an alignment matches at least `need / MATCH` words of the item,
so of any `size - need / MATCH + k` words it matches k or more. The item's rarest words by count over the corpus, so many of
them that k is `HITS`, are its seeds: a document without k hits on near diagonals cannot align. Nothing is left out by
frequency, and words that are in no document only fill their places. Windows around hits are dropped if too few of the item's
words are in them; the others are aligned, many at a time.

An item of `LONG` words or more is searched for in parts of half as many words or a little more (side by side, and once more
shifted by half a part); its score is the best of its parts. If the whole item reaches 0.5 then so does a part, and any `LONG / 2`
successive words of an item are found, however long it is.

The test items are searched for in blocks of at most `BLOCK_BYTES` of text: one block's index is what tasks get, however
large the benchmark is, and each block goes against all documents.

Defined cases: null texts are empty; an item of fewer than `SHORT` words is reported where it stands word for word, but does not
make `keep_clean` drop a document; an item or a document without words matches nothing; ties of score go to the first window; repeated rows and null ids are kept; with an empty benchmark nothing is
contaminated; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import keep_rows
from plumbline.llm.textvec import Words, chunks, ragged, text_buffer

MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
#: An alignment below this is never reported: two words in a row reach 2 * MATCH.
LEAST = 2 * MATCH + 1
#: Items of fewer words say too little to drop a document.
SHORT = 3
#: Words from which on an item is searched for in parts.
LONG = 100
BLOCK_BYTES = 32 << 20
#: Seed hits that a window must have (fewer for items that can be found by fewer words).
HITS = 4
#: Seed hits that are followed up at a time (those of one document stay together).
_AT_ONCE = 1 << 18
_ALIGN = 512


def parts(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, first word, words) of what is searched for: whole items, or the parts of long ones."""
    size = np.diff(first)
    item, start, length = [np.flatnonzero(size < LONG)], [first[:-1][size < LONG]], [size[size < LONG]]
    for i in np.flatnonzero(size >= LONG).tolist():
        n = int(size[i]) // (LONG // 2)
        cuts = np.arange(2 * n + 1) * int(size[i]) // (2 * n)
        item.append(np.full(2 * n - 1, i))
        start.append(first[i] + cuts[:-2])
        length.append(cuts[2:] - cuts[:-2])
    return np.concatenate(item), np.concatenate(start), np.concatenate(length)


class Index:
    """Words of a block of test items; seeds are added when the corpus has been counted."""

    def __init__(self, ids: list[int | None], texts: list[str | None], threshold: float = THRESHOLD, shortest: int = 1):
        self.ids = ids
        words = Words(*text_buffer(pa.array(texts, pa.large_string())))
        self.vocabulary, code = np.unique(words.hashes, return_inverse=True)
        self.code = code.astype(np.int32)
        item, first, size = parts(words.first)
        need = np.maximum(np.ceil(threshold * MATCH * size - 1e-9), np.minimum(LEAST, MATCH * size)).astype(np.int64)
        able = size >= max(shortest, 1)
        self.item, self.first, self.size, self.need = item[able], first[able], size[able], need[able]
        self.least = -(-self.need // MATCH)
        self.gaps = MATCH * self.size - self.need
        self.hits = np.minimum(HITS, self.least)

    def choose(self, frequency: np.ndarray) -> None:
        """frequency: how often the corpus has each word of the vocabulary."""
        count = self.size - self.least + self.hits
        place, item = ragged(self.first, self.size), np.repeat(np.arange(len(self.size)), self.size)
        rank = ragged(np.zeros(len(self.size), np.int64), self.size)
        place = place[np.lexsort((frequency[self.code[place]], item))]
        chosen = rank < count[item]
        place, item = place[chosen], item[chosen]
        order = np.argsort(self.code[place], kind="stable")
        place, self.seed_item = place[order], item[order]
        self.seed_at = place - self.first[self.seed_item]
        self.seed_count = np.bincount(self.code[place], minlength=len(self.vocabulary))
        self.seed_first = np.cumsum(self.seed_count) - self.seed_count

    def codes(self, words: Words) -> np.ndarray:
        """The place of each word in the vocabulary, or -1."""
        if not len(self.vocabulary):
            return np.full(len(words.hashes), -1, np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, words.hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words.hashes, at, -1).astype(np.int32)

    def find(self, data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        """Arrays document, item, score, first word, end word, seeds: the best window of each pair that aligns."""
        words = Words(data, offs)
        code, first = self.codes(words), words.first
        count = np.zeros(len(code), np.int64)
        known = np.flatnonzero(code >= 0)
        count[known] = self.seed_count[code[known]]
        before = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])[first]
        found, at = [], 0
        while at < len(first) - 1:
            to = max(at + 1, int(np.searchsorted(before, before[at] + _AT_ONCE, "right")) - 1)
            if before[to] > before[at]:
                found.append(self._aligned(code, first, *self._windows(code, first, count, int(first[at]), int(first[to]))))
            at = to
        if not found:
            return [np.zeros(0, np.int64)] * 6
        doc, item, score, start, end, n = (np.concatenate(x) for x in zip(*found, strict=True))
        best = np.lexsort((start, -score, item, doc))
        doc, item, score, start, end, n = doc[best], item[best], score[best], start[best], end[best], n[best]
        one = np.ones(len(doc), bool)
        one[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
        return [x[one] for x in (doc, item, score, start, end, n)]

    def _windows(self, code: np.ndarray, first: np.ndarray, count: np.ndarray, low: int, high: int) -> list[np.ndarray]:
        """Document, item, start, stop, seeds of the windows in words low to high that can hold an alignment.

        Its gaps are `gaps` at most, so all of it lies that near to the diagonal of its first hit.
        """
        places = np.flatnonzero(count[low:high]) + low
        entry = ragged(self.seed_first[code[places]], count[places])
        hit = np.repeat(places, count[places])
        doc, item = np.searchsorted(first, hit, "right") - 1, self.seed_item[entry]
        diagonal = hit - first[doc] - self.seed_at[entry]
        order = np.lexsort((diagonal, item, doc))
        doc, item, diagonal = doc[order], item[order], diagonal[order]
        last = np.arange(len(doc)) + self.hits[item] - 1
        some = np.flatnonzero(last < len(doc))
        last = last[some]
        some = some[(doc[last] == doc[some]) & (item[last] == item[some]) & (diagonal[last] - diagonal[some] <= self.gaps[item[some]])]
        cell = diagonal[some] // self.size[item[some]]
        new = np.ones(len(some), bool)
        new[1:] = (doc[some[1:]] != doc[some[:-1]]) | (item[some[1:]] != item[some[:-1]]) | (cell[1:] != cell[:-1])
        head = np.flatnonzero(new)
        a, b = some[head], some[np.append(head, len(some))[1:] - 1]
        doc, item = doc[a], item[a]
        start = np.maximum(diagonal[a] - self.gaps[item], 0)
        stop = np.minimum(diagonal[b] + self.gaps[item] + self.size[item], np.diff(first)[doc])
        return [doc, item, start, stop, b - a + self.hits[item]]

    def _aligned(self, code: np.ndarray, first: np.ndarray, doc: np.ndarray, item: np.ndarray, start: np.ndarray, stop: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        """Those windows that align, as document, item of the block, score, first word, end word, seeds."""
        out = [[np.zeros(0, np.int64)] * 6]
        by_size = np.lexsort((stop - start, self.size[item]))
        for k in range(0, len(doc), _ALIGN):
            part = by_size[k : k + _ALIGN]
            a, b = self._matrices(code, first[doc[part]] + start[part], first[doc[part]] + stop[part], item[part])
            here = np.zeros(a.shape, bool)
            for i in range(a.shape[1]):
                here[:, i] = (b == a[:, i, None]).any(1)
            able = here.sum(1) >= self.least[item[part]]
            part = part[able]
            points, end = _align(a[able], b[able])
            good = points >= self.need[item[part]]
            part, points, end = part[good], points[good], start[part[good]] + end[good]
            if len(part):
                back = _align(*self._matrices(code, first[doc[part]] + start[part], first[doc[part]] + end, item[part], -1))[1]
                out.append([doc[part], self.item[item[part]], points / (MATCH * self.size[item[part]]), end - back, end, n[part]])
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    def _matrices(self, code: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Codes of items and of words low to high, one in each row; filled up with -2 and -1, which match nothing; -1: backwards."""
        out = []
        for source, a, n, empty in ((self.code, self.first[item], self.size[item], -2), (code, low, high - low, -1)):
            k = np.arange(int(n.max(initial=0)))
            at = a[:, None] + (k if step > 0 else n[:, None] - 1 - k)
            out.append(np.where(k < n[:, None], source[np.clip(at, 0, len(source) - 1)], np.int32(empty)))
        return out[0], out[1]


def _align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local score and where it ends in b, for many (item, window) pairs at once.

    A row of the matrix needs the cell to its left; with a linear gap that is a running maximum of value + gap * place.
    """
    ramp = -GAP * np.arange(b.shape[1] + 1, dtype=np.int32)
    last = np.zeros((len(b), b.shape[1] + 1), np.int32)
    best, end, rows = np.zeros(len(b), np.int32), np.zeros(len(b), np.int64), np.arange(len(b))
    for i in range(a.shape[1]):
        row = np.zeros_like(last)
        gain = np.where(a[:, i, None] == b, np.int32(MATCH), np.int32(MISMATCH))
        row[:, 1:] = np.maximum(last[:, :-1] + gain, last[:, 1:] + np.int32(GAP))
        row = np.maximum(np.maximum.accumulate(np.maximum(row, 0) + ramp, axis=1) - ramp, 0)
        at = row.argmax(1)
        top = row[rows, at]
        end[top > best] = at[top > best]
        best = np.maximum(best, top)
        last = row
    return best.astype(np.int64), end


def _frequencies(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        total = np.zeros(len(index.vocabulary), np.int64)
        for batch in chunks(batches, "text"):
            code = index.codes(Words(*text_buffer(batch.column("text"))))
            total += np.bincount(code[code >= 0], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["word", "n"])

    return run


def indexes(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, threshold: float = THRESHOLD, shortest: int = 1) -> Iterator:
    """A broadcast index with seeds for every block of the benchmark."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), "text")
    blocks = int((items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0] or 0) // block_bytes) + 1
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow().sort_by("item_id")
        index = Index(part["item_id"].to_pylist(), part["text"].to_pylist(), threshold, shortest)
        shared = spark.sparkContext.broadcast(index)
        counted = docs.select("text").mapInArrow(_frequencies(shared), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
        total = np.zeros(len(index.vocabulary), np.int64)
        total[counted["word"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
        index.choose(total)
        yield spark.sparkContext.broadcast(index)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document and test item that align: doc_id, item_id, score, first_word, end_word, n_seeds."""
    result = None
    for shared in indexes(docs, benchmark, threshold=threshold):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids = np.array(shared.value.ids, object)
            for batch in chunks(batches, "text"):
                doc, item, score, start, end, n = shared.value.find(*text_buffer(batch.column("text")))
                own = batch.column("doc_id").take(pa.array(doc, pa.int64()))
                yield pa.record_batch([own, pa.array(ids[item].tolist(), pa.int64()), pa.array(score, pa.float64()), *(pa.array(x, pa.int64()) for x in (start, end, n))], ["doc_id", "item_id", "score", "first_word", "end_word", "n_seeds"])

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long, score double, first_word long, end_word long, n_seeds long")
        result = found if result is None else result.unionByName(found)
    return result


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents in which no test item of `SHORT` words or more aligns, with all their columns; each row is judged by its own text."""
    for shared in indexes(docs, benchmark, threshold=threshold, shortest=SHORT):

        def judge(batch: pa.RecordBatch, shared=shared) -> np.ndarray:
            doc, *_ = shared.value.find(*text_buffer(batch.column("text")))
            clean = np.ones(batch.num_rows, bool)
            clean[doc] = False
            return clean

        docs = keep_rows(docs, lambda judge=judge: judge)
    return docs
