"""N-gram Jaccard join with Bayesian candidate pruning (BayesLSH), exact verification and classes of near-duplicates.

1. Each text becomes the set of its word 5-grams (a shorter text: one gram of all its words), `HASHES` MinHash values of
   16 bits, and a 128-bit key of its word sequence. Texts with the same key are one node, however many copies there are.
2. Nodes meet in LSH bands. Only buckets with two nodes or more go on. In a bucket, MinHash values are compared a batch at a
   time, and a pair is dropped as soon as the posterior probability of a similarity of `THRESHOLD` or more falls under
   `TOLERANCE`. What survives gives groups; only a spanning forest of them is written, never all pairs of a bucket.
3. The texts of a group are brought together, in blocks where a group is large, and every pair is verified exactly on the
   5-gram sets. Each node gets the number of links, and a spanning forest of verified links gives the final classes.

A band has `ROWS` values, so a pair at exactly 0.8 misses all bands with probability (1 - 0.8^4)^24 = 3e-6.

Defined cases: null texts are empty; a text without words is a class of its own without links; copies (also repeated rows)
are links of each other; class_id is the least doc_id of the class (null only if all are null); an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from plumbline.llm.components import connected_components
from plumbline.llm.shared import materialize
from plumbline.llm.textvec import Words, chunks, mix, ngrams, text_buffer

N, THRESHOLD = 5, 0.8
HASHES, ROWS, STEP = 96, 4, 16
TOLERANCE = 1e-6
#: Nodes of a group that a task verifies with another such block at once.
BLOCK = 2048
#: Nodes of a bucket that a task compares with another such block; a bucket has at most `BUCKET_BLOCKS` blocks, which grow beyond that.
BUCKET_BLOCK, BUCKET_BLOCKS = 512, 16
#: Bits of the filter that tells a worker which texts a group needs, as a power of two of 16 bits a node: 8 to 64 MB. Beyond that it only passes more.
FILTER_BITS, MOST_FILTER_BITS = 1 << 26, 1 << 29

#: Rows of a block's matrix that are worked on at a time.
_ROWS = 256

_rng = np.random.Generator(np.random.PCG64(20240229))
_MUL = _rng.integers(1, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """After 16, 32, ... values: fewer matches than this and P(similarity >= threshold) < tolerance.

    With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1), and its mass from t on is that of at
    most m successes in n + 1 draws of probability t.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        below, m = 0.0, 0
        while m <= n:
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct 5-gram hashes of each document, offsets, [two keys of each document])."""
    grams, first = ngrams(words, N)
    size = np.diff(words.first)
    total, n = len(words.hashes), len(size)
    keys = np.zeros((2, n), np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    back = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    for k in range(2):
        h = mix(words.hashes + np.uint64(k + 1)) if k else words.hashes
        step, undo = np.full(max(total, 1), base, np.uint64), np.full(total + 1, back, np.uint64)
        step[0] = undo[0] = 1
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * np.cumprod(step)[:total])])
        keys[k] = mix((prefix[words.first[1:]] - prefix[words.first[:-1]]) * np.cumprod(undo)[words.first[:-1]] + size.astype(np.uint64))
    doc = np.repeat(np.arange(n), np.diff(first))
    short = np.flatnonzero((size > 0) & (size < N))
    grams, doc = np.concatenate([grams, keys[0][short]]), np.concatenate([doc, short])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(n + 1)), keys


def signatures(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash values (documents, HASHES) as 16-bit numbers."""
    low = (grams ^ (grams >> np.uint64(32))).astype(np.uint32)
    some = np.flatnonzero(np.diff(first) > 0)
    out = np.zeros((len(first) - 1, HASHES), np.uint16)
    if len(some):
        heads = first[some]
        for k in range(HASHES):
            value = low * _MUL[k] + _ADD[k]
            value ^= value >> np.uint32(15)
            value *= np.uint32(0x2C1B3C6D)
            least = np.minimum.reduceat(value, heads)
            out[some, k] = (least ^ (least >> np.uint32(16))).astype(np.uint16)
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        grams, first, keys = shingles(Words(*text_buffer(batch.column("text"))))
        sig = signatures(grams, first)
        size = np.diff(first)
        yield pa.record_batch([batch.column("doc_id"), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), pa.array(size, pa.int64()), pa.array([s.tobytes() if n else None for s, n in zip(sig, size.tolist(), strict=True)], pa.binary())], ["doc_id", "k1", "k2", "size", "sig"])


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal keys (input sorted by them)."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        same = np.logical_and.reduce([c == c[-1] for c in columns])
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield pa.Table.from_batches([*rest[:-1], batch.slice(0, cut)]).combine_chunks()
            rest = [batch.slice(cut)] if cut < batch.num_rows else []
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def _heads(columns: list[np.ndarray]) -> np.ndarray:
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), len(new))


def similar(one: np.ndarray, many: np.ndarray, least: list[int]) -> np.ndarray:
    """Rows of `many` that are not pruned against `one` (a signature, or one for each row)."""
    alive, got = np.arange(len(many)), np.zeros(len(many), np.int64)
    for k, need in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        left = one[part] if one.ndim == 1 else one[alive, part]
        got[alive] += (many[alive, part] == left).sum(1)
        alive = alive[got[alive] >= need]
        if not len(alive):
            break
    return alive


def _forest(n: int, reach, open_: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest: `reach(i, others)` gives those of `others` that are linked to i.

    A node that has been reached looks only at nodes not reached yet, so one large group costs about one look at each node.
    """
    left = np.arange(n) if open_ is None else open_
    edges: list[tuple[int, int]] = []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            got = reach(i, left)
            if len(got):
                found = left[got]
                edges += [(i, int(j)) for j in found]
                queue += found.tolist()
                left = np.delete(left, got)
    return edges


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    least = least_matches()
    for table in runs(batches, ["bucket", "pair"]):
        bucket, pair = table["bucket"].to_numpy(), table["pair"].to_numpy()
        k1, k2 = table["k1"].to_numpy(), table["k2"].to_numpy()
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(-1, HASHES)
        head = _heads([bucket, pair])
        size = np.diff(head)
        two = head[:-1][size == 2]
        good = two[similar(sig[two], sig[two + 1], least)]
        a, b = [good], [good + 1]
        for h, n in zip(head[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            own = sig[h : h + n]
            edges = _forest(n, lambda i, others, own=own: similar(own[i], own[others], least))
            if edges:
                e = np.array(edges)
                a.append(h + e[:, 0])
                b.append(h + e[:, 1])
        a, b = np.concatenate(a), np.concatenate(b)
        yield pa.record_batch([pa.array(x) for x in (k1[a], k2[a], k1[b], k2[b])], ["a1", "a2", "b1", "b2"])


def _needed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in chunks(batches, "text"):
            words = Words(*text_buffer(batch.column("text")))
            grams, first, keys = shingles(words)
            at = (keys[0] % np.uint64(8 * len(bits))).astype(np.int64)
            some = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            sets = [grams[first[i] : first[i + 1]].tobytes() for i in some.tolist()]
            yield pa.record_batch([pa.array(keys[0][some].view(np.int64)), pa.array(keys[1][some].view(np.int64)), pa.array(sets, pa.binary())], ["k1", "k2", "grams"])

    return run


def exact_links(sets: list[np.ndarray], threshold: float = THRESHOLD) -> np.ndarray:
    """Boolean matrix of the pairs whose exact Jaccard similarity reaches the threshold."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), size)
    common = np.bincount(code, minlength=len(values))
    inter = np.full((n, n), int((common == n).sum()), np.float32)  # grams that all have
    mid = (common > 1) & (common < n)
    number = np.cumsum(mid) - 1
    use = mid[code]
    row, col = row[use], number[code[use]]
    width = max(1, (1 << 22) // n)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for at in range(0, int(mid.sum()), width):
        a, b = np.searchsorted(col, [at, at + width])
        part = np.zeros((n, width), np.float32)
        part[row[a:b], col[a:b] - at] = 1
        inter += part @ part.T
    link = np.zeros((n, n), bool)
    for at in range(0, n, _ROWS):  # a few rows at a time: a matrix of the whole block is held in single precision only once
        own = inter[at : at + _ROWS]
        link[at : at + _ROWS] = own >= threshold * (size[at : at + _ROWS, None] + size[None, :] - own) - 1e-6
    np.fill_diagonal(link, False)
    return link


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in runs(batches, ["g1", "g2", "i", "j"]):
        columns = {c: table[c].to_numpy() for c in ("g1", "g2", "i", "j", "k1", "k2", "copies", "block")}
        head = _heads([columns[c] for c in ("g1", "g2", "i", "j")])
        raw = table["grams"].to_pylist()
        out: list[list[np.ndarray]] = []
        for h, t in zip(head[:-1].tolist(), head[1:].tolist(), strict=True):
            if t - h < 2:
                continue
            own = {c: x[h:t] for c, x in columns.items()}
            link = exact_links([np.frombuffer(x, np.uint64) for x in raw[h:t]])
            if own["i"][0] != own["j"][0]:  # two blocks of one group: pairs inside a block belong to other tasks
                link &= own["block"][:, None] != own["block"][None, :]
            links = np.concatenate([np.where(link[at : at + _ROWS], own["copies"], 0).sum(1) for at in range(0, t - h, _ROWS)])
            some = np.flatnonzero(links)
            out.append([own["k1"][some], own["k2"][some], np.zeros(len(some), np.int64), np.zeros(len(some), np.int64), links[some]])
            e = _forest(t - h, lambda i, others, link=link: np.flatnonzero(link[i, others]))
            if e:
                e = np.array(e)
                out.append([own["k1"][e[:, 0]], own["k2"][e[:, 0]], own["k1"][e[:, 1]], own["k2"][e[:, 1]], np.zeros(len(e), np.int64)])
        if out:
            yield pa.record_batch([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], ["a1", "a2", "b1", "b2", "links"])


def _filter_bits(nodes: DataFrame) -> np.ndarray:
    """A bitmap with the keys of all nodes (built by Spark; its size is bounded)."""
    size = min(max(FILTER_BITS, 1 << (16 * nodes.count()).bit_length()), MOST_FILTER_BITS)
    # the unsigned 64-bit remainder by a power of two is the signed one, taken as non-negative
    place = F.pmod(F.col("k1"), F.lit(size)).alias("p")
    words = nodes.select(place).groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b")).toPandas()
    bits = np.zeros(size // 64, np.uint64)
    bits[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)
    return bits.view(np.uint8)


def _blocks(df: DataFrame, key: list[str], nodes_per_block: int, most: int | None = None) -> DataFrame:
    """Split the groups of `key` (column `n`: nodes) into blocks (`most` of them: they grow), and give every row to each pair of blocks it is in."""
    blocks = F.ceil(F.col("n") / nodes_per_block).cast("int")
    blocks = F.least(blocks, F.lit(most)) if most else blocks
    own = df.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("k1", "k2"), F.col("blocks")).cast("int"))
    paired = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return paired.select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).drop("other", "blocks")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links: one row for each document."""
    return _classes(docs).select("doc_id", "class_id", "n_links")


def _classes(docs: DataFrame) -> DataFrame:
    """Those columns with the key of the row's words and the key that stands for its class (null without words)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    sketches = materialize(rows.mapInArrow(_sketch, "doc_id long, k1 long, k2 long, size long, sig binary"))
    with_words = sketches.where("size > 0")
    nodes = materialize(with_words.groupBy("k1", "k2").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.min("sig").alias("sig")))

    bands = F.explode(F.transform(F.sequence(F.lit(0), F.lit(HASHES // ROWS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * 2 * ROWS + 1, F.lit(2 * ROWS))))).alias("bucket")
    placed = nodes.select("k1", "k2", bands)
    shared_buckets = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    meeting = placed.join(shared_buckets, "bucket").join(nodes.select("k1", "k2", "sig"), ["k1", "k2"])
    blocked = _blocks(meeting, ["bucket"], BUCKET_BLOCK, BUCKET_BLOCKS).withColumn("pair", F.col("i") * (1 << 20) + F.col("j")).select("bucket", "pair", "k1", "k2", "sig")
    dealt = blocked.repartition("bucket", "pair").sortWithinPartitions("bucket", "pair", "k1", "k2")
    node = lambda a, b: F.struct(F.col(a).alias("k1"), F.col(b).alias("k2"))
    maybe = dealt.mapInArrow(_prune, "a1 long, a2 long, b1 long, b2 long").select(node("a1", "a2").alias("u"), node("b1", "b2").alias("v"))
    groups = connected_components(maybe)
    members = materialize(groups.select(F.col("component.k1").alias("g1"), F.col("component.k2").alias("g2"), F.col("node.k1").alias("k1"), F.col("node.k2").alias("k2")).join(nodes.select("k1", "k2", "first_id", "copies"), ["k1", "k2"]))

    bits = spark.sparkContext.broadcast(_filter_bits(members))
    sets = rows.mapInArrow(_needed(bits), "k1 long, k2 long, grams binary").dropDuplicates(["k1", "k2"])
    sized = members.join(members.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n")), ["g1", "g2"]).join(sets, ["k1", "k2"])
    checked = _blocks(sized, ["g1", "g2"], BLOCK).select("g1", "g2", "i", "j", "block", "k1", "k2", "copies", "grams")
    dealt = checked.repartition("g1", "g2", "i", "j").sortWithinPartitions("g1", "g2", "i", "j", "k1", "k2")
    found = materialize(dealt.mapInArrow(_verify, "a1 long, a2 long, b1 long, b2 long, links long"))
    links = found.where("links > 0").groupBy(F.col("a1").alias("k1"), F.col("a2").alias("k2")).agg(F.sum("links").alias("links"))
    classes = connected_components(found.where("links = 0").select(node("a1", "a2").alias("u"), node("b1", "b2").alias("v")))
    labels = classes.select(F.col("node.k1").alias("k1"), F.col("node.k2").alias("k2"), F.col("component").alias("class"))
    labels = labels.join(members.select("k1", "k2", "first_id"), ["k1", "k2"])
    least = labels.groupBy("class").agg(F.min("first_id").alias("class_first"))
    linked = labels.join(least, "class").join(links, ["k1", "k2"], "left").select("k1", "k2", "class", "class_first", "links")
    known = nodes.select("k1", "k2", "first_id", "copies").join(linked, ["k1", "k2"], "left")
    # written out, so that the join below shuffles both sides and AQE can split the partition of a text with very many copies
    known = materialize(known.select("k1", "k2", F.coalesce("class", F.struct("k1", "k2")).alias("class"), F.coalesce("class_first", "first_id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    found_words = with_words.select("doc_id", "k1", "k2").join(known, ["k1", "k2"], "left")
    none = sketches.where("size = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return found_words.select("doc_id", "class_id", "n_links", "k1", "k2", "class").unionByName(none, allowMissingColumns=True)


def _with_keys(docs: DataFrame) -> DataFrame:
    """Each row of docs as `row`, with its id and text and the key of its word sequence (k1, k2; null for a text without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            _, first, keys = shingles(Words(*text_buffer(batch.column("text"))))
            none = np.diff(first) == 0
            yield pa.record_batch([*batch.columns, *(pa.array(k.view(np.int64), mask=none) for k in keys)], [*batch.schema.names, "k1", "k2"])

    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), "text")
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("k1", LongType()), StructField("k2", LongType())]))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, with all columns: that with the least doc_id, then with the least key of its words; of equal ones any.

    Null ids come first. Repeated ids: rows are told apart by their words. Texts without words are classes of their own; of those only
    exact repeats (doc_id and text) go. Columns may have any names.
    """
    rows = materialize(_classes(docs).select("doc_id", "class_id", "k1", "k2", "class"))
    first = rows.where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    best = first.where("k1 is not null").groupBy("class").agg(F.min(F.struct("k1", "k2")).alias("k"), F.min("doc_id").alias("doc_id"))
    chosen = best.select("doc_id", "k.k1", "k.k2").unionByName(first.where("k1 is null").select("doc_id", "k1", "k2").distinct())
    kept_id, kept_k1, kept_k2 = (F.col(c) for c in ("kept_id", "kept_k1", "kept_k2"))
    chosen = chosen.select(F.col("doc_id").alias("kept_id"), F.col("k1").alias("kept_k1"), F.col("k2").alias("kept_k2"))
    if not rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        wrapped = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"))
        return wrapped.join(chosen.select("kept_id"), F.col("own_id").eqNullSafe(kept_id), "left_semi").select("row.*")
    keyed = _with_keys(docs)
    same = F.col("own_id").eqNullSafe(kept_id) & F.col("k1").eqNullSafe(kept_k1) & F.col("k2").eqNullSafe(kept_k2)
    kept = keyed.join(chosen, same, "left_semi").withColumn("text", F.when(F.col("k1").isNull(), F.col("text")))
    return kept.dropDuplicates(["own_id", "k1", "k2", "text"]).select("row.*")
