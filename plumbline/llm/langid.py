"""Language identification with interpolated Kneser-Ney character models, one for each language of the training rows.

Text is lower-cased and read as symbols of 16 bits: 0 for anything that is no letter, else the character itself (the rare letters beyond
that range share 8192 places that no letter has). Contexts stop at the last non-letter, so a model sees words and their ends. Four
symbols make a 64-bit code. Codes are counted over all training rows, and a model keeps all of them, 24 bytes each at most on the driver and in
every worker, so what is gathered grows with the corpus. Only who passes `most` to `train` gets smaller models, without the rarest codes.
Codes lie in sorted arrays that are searched by bisection. The lowest cross-entropy per symbol wins.

Rejection is calibrated on an eighth of the training rows that the models do not learn from (all of it): mean and
spread of their cross-entropy for each language, and how many standard errors the worst of them are off. A row is accepted unless its
cross-entropy is `MARGIN` times as far above the mean.

Defined cases: a null text, or one without a letter, is `und` with score 0 and is not accepted; without training rows every
prediction is `und`, and every row is accepted; ties go to the first language in alphabetical order; repeated rows and null
ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import keep_rows, materialize
from plumbline.llm.textvec import chunks, segment_sum

ORDER, BITS = 4, 16
UNKNOWN = "und"
#: One in so many training rows is set aside, and rejection is calibrated on these.
SET_ASIDE = 8
#: The share of those that may lie beyond the limit, what the limit is multiplied by, and its least value in standard errors.
REJECT, MARGIN, LEAST_Z = 1e-4, 1.5, 4.0
#: Spread between documents, as a share of the mean, for languages with too few documents set aside.
SPREAD, FEW = 0.15, 8
#: Symbols after which the score's confidence no longer grows.
SCORE_SYMBOLS = 32

#: Bytes of text at a time: a symbol takes some 100 bytes while it is scored.
CHUNK = 1 << 18

#: First place of letters beyond 16 bits (surrogates and private use, which hold no letters).
_BEYOND = 0xD800
_TABLE: list[np.ndarray] = []


def _symbol_table() -> np.ndarray:
    letters = np.fromiter((chr(cp).isalpha() for cp in range(1 << 16)), bool, 1 << 16)
    return np.where(letters, np.arange(1 << 16), 0).astype(np.uint64)


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, offsets) of all texts; each text is preceded by one 0 that belongs to it."""
    if not _TABLE:
        _TABLE.append(_symbol_table())
    low = ["\n" + (t or "").lower() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in low])]).astype(np.int64)
    cps = np.frombuffer("".join(low).encode("utf-32-le", "replace"), np.uint32)
    out = _TABLE[0][np.minimum(cps, 0xFFFF)]
    for i in np.flatnonzero(cps > 0xFFFF):
        out[i] = _BEYOND + int(cps[i]) % 0x2000 if chr(cps[i]).isalpha() else 0
    return out, offs


def codes(sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, places) of every symbol that is a letter or the end of a word: the symbol after its three predecessors."""
    s = [np.zeros(len(sym), np.uint64) for _ in range(ORDER)]
    s[0] = sym.astype(np.uint64)
    for k in range(1, ORDER):
        s[k][k:] = s[0][:-k] if len(sym) > k else 0
        if k > 1:
            s[k][s[k - 1] == 0] = 0
    at = np.flatnonzero((s[0] > 0) | (s[1] > 0))
    code = s[0][at]
    for k in range(1, ORDER):
        code |= s[k][at] << np.uint64(BITS * k)
    return code, at


def _last(code: np.ndarray, k: int) -> np.ndarray:
    """The last k symbols of each code."""
    return code if k == ORDER else code & np.uint64((1 << (BITS * k)) - 1)


class KneserNey:
    """One language: for each order sorted codes with discounted probabilities, and contexts with the mass left over."""

    def __init__(self, code: np.ndarray, count: np.ndarray):
        order = np.argsort(code)
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.contexts: list[tuple[np.ndarray, np.ndarray]] = []
        levels = [(code[order].astype(np.uint64), count[order].astype(np.float64))]
        for k in range(ORDER - 1, 0, -1):  # below the top, a gram counts the different symbols before it
            c, n = np.unique(_last(levels[0][0], k), return_counts=True)
            levels.insert(0, (c, n.astype(np.float64)))
        for c, n in levels:
            once, twice = float((n == 1).sum()), float((n == 2).sum())
            discount = once / (once + 2 * twice) if once and twice else 0.5
            ctx, first, kinds = np.unique(c >> np.uint64(BITS), return_index=True, return_counts=True)
            total = np.add.reduceat(n, first)
            self.grams.append((c, ((n - discount) / np.repeat(total, kinds)).astype(np.float32)))
            self.contexts.append((ctx, (discount * kinds / total).astype(np.float32)))
        cost = -self.log_probability(levels[-1][0])
        self.mean = float(np.average(cost, weights=levels[-1][1]))
        self.variance = float(np.average((cost - self.mean) ** 2, weights=levels[-1][1]))
        self.spread = SPREAD

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], wanted: np.ndarray, missing: float) -> np.ndarray:
        keys, values = table
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], missing).astype(np.float64)

    def log_probability(self, code: np.ndarray) -> np.ndarray:
        p = np.full(len(code), 1.0 / (1 << BITS))
        for k in range(ORDER):
            part = _last(code, k + 1)
            p = self._find(self.grams[k], part, 0.0) + self._find(self.contexts[k], part >> np.uint64(BITS), 1.0) * p
        return np.log(p)

    def excess(self, cost: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Standard errors above the mean, of texts of n symbols."""
        return (cost - self.mean) / np.sqrt(self.variance / np.maximum(n, 1) + (self.spread * self.mean) ** 2)


class Model:
    def __init__(self, counts: pd.DataFrame):
        """counts: lang, code, n."""
        self.languages = sorted(counts["lang"].unique())
        self.limit = LEAST_Z * MARGIN
        self.models = []
        for lang in self.languages:
            own = counts[counts["lang"] == lang]
            self.models.append(KneserNey(own["code"].to_numpy(np.int64).view(np.uint64), own["n"].to_numpy(np.float64)))

    def measure(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cross-entropy by language and text, symbols, whether there is a letter). A chunk's different codes are looked up once."""
        sym, offs = symbols(texts)
        code, at = codes(sym)
        first = np.searchsorted(at, offs)
        n = np.diff(first)
        letters = segment_sum((sym > 0).astype(np.int64), offs) > 0
        kinds, back = np.unique(code, return_inverse=True)
        cost = np.empty((len(self.languages), len(texts)))
        for k, model in enumerate(self.models):
            cost[k] = -segment_sum(model.log_probability(kinds)[back], first) / np.maximum(n, 1)
        return cost, n, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, accepted) of every text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cost, n, letters = self.measure(texts)
        best = cost.argmin(0)
        low = cost[best, np.arange(len(texts))]
        gap = np.exp(-np.minimum(n, SCORE_SYMBOLS) * np.maximum(cost - low, 0))
        score = np.where(letters, 1 / gap.sum(0), 0.0)
        accepted = letters.copy()
        for k, model in enumerate(self.models):
            own = best == k
            accepted[own] &= model.excess(low[own], n[own]) <= self.limit
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
        return names, score, accepted

    def calibrate(self, lang: np.ndarray, n: np.ndarray, cost: np.ndarray) -> None:
        """By texts that were not learnt from: index of the language, symbols, and cross-entropy in it."""
        worst = []
        for k, model in enumerate(self.models):
            own = (lang == k) & (n > 0)
            if own.sum() >= FEW:
                model.mean = float(np.average(cost[own], weights=n[own]))
                between = np.average((cost[own] - model.mean) ** 2 - model.variance / n[own], weights=n[own])
                model.spread = float(np.sqrt(max(between, (0.02 * model.mean) ** 2))) / model.mean
            worst.append(model.excess(cost[own], n[own]))
        every = np.concatenate(worst) if worst else np.zeros(0)
        if len(every):
            self.limit = MARGIN * max(LEAST_Z, float(np.quantile(every, 1 - REJECT)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of one task, summed before they are shuffled."""
    total: dict[str, np.ndarray] = {}
    for batch in chunks(batches, "text", CHUNK):
        langs = np.array(batch.column("lang").to_pylist(), object)
        texts = np.array(batch.column("text").to_pylist(), object)
        for lang in sorted(set(langs)):
            code, _ = codes(symbols(texts[langs == lang].tolist())[0])
            kinds, n = np.unique(code, return_counts=True)
            if lang in total:
                both = np.concatenate([total[lang][0], kinds])
                kinds, back = np.unique(both, return_inverse=True)
                n = np.bincount(back, np.concatenate([total[lang][1], n])).astype(np.int64)
            total[lang] = (kinds, n)
    for lang, (kinds, n) in total.items():
        yield pa.record_batch([pa.array([lang] * len(kinds)), pa.array(kinds.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "code", "n"])


def is_held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def _bounded(counts: DataFrame, most: int) -> DataFrame:
    """counts (lang, code, n) with at most about `most` codes: all, or those of the highest counts of each language."""
    if counts.count() <= most:
        return counts
    sizes = counts.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("codes")).toPandas().sort_values(["lang", "n"], ascending=[True, False])  # a row for each different count
    share = most // sizes["lang"].nunique()
    sizes["over"] = sizes.groupby("lang")["codes"].cumsum() > share
    least = sizes.groupby("lang").apply(lambda g: int(g.loc[~g["over"], "n"].min()) if (~g["over"]).any() else int(g["n"].max()), include_groups=False)
    kept = F.lit(False)
    for lang, n in least.items():
        kept = kept | ((F.col("lang") == lang) & (F.col("n") >= n))
    return counts.where(kept)


def train(docs: DataFrame, most: int | None = None) -> Model:
    """Fit and calibrate on all rows with a language that are not held out."""
    key = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out()).select("lang", "text", (F.floor(key / 3) % SET_ASIDE == 0).alias("aside"))
    counted = rows.where(~F.col("aside")).select("lang", "text").mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    model = Model((counted if most is None else _bounded(materialize(counted), most)).toPandas())
    aside = rows.where("aside").select("lang", "text")
    if not model.languages:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK):
            cost, n, letters = shared.value.measure(batch.column("text").to_pylist())
            where = {lang: k for k, lang in enumerate(shared.value.languages)}
            own = np.array([where.get(x, -1) for x in batch.column("lang").to_pylist()])
            some = np.flatnonzero(letters & (own >= 0) & (cost.argmin(0) == own))
            yield pa.record_batch([pa.array(own[some]), pa.array(n[some]), pa.array(cost[own[some], some])], ["lang", "n", "cost"])

    seen = aside.mapInArrow(measure, "lang long, n long, cost double").toPandas()  # 24 bytes a document set aside
    model.calibrate(*(seen[c].to_numpy() for c in ("lang", "n", "cost")))
    return model


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK):
            names, score, accepted = shared.value.predict(batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(names), pa.array(score), pa.array(accepted)], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    rows = docs.select(F.col("doc_id").cast("long"), is_held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is accepted, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))
    return keep_rows(docs, lambda: lambda batch: shared.value.predict(batch.column("text").to_pylist())[2], CHUNK)
