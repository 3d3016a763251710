"""Edit-aware token counts: a tree of pre-token runs per document, of which an edit re-encodes only the touched part.

A leaf is a run of pre-tokens of about `LEAF` bytes that begins at white space (the first leaf: at the text's start). The
tokenizer never joins text across white space, so a document's count is the sum over its leaves; inner nodes hold
subtree sums. An edit replaces the leaves it touches, and the one before where the touched leaf's leading white space is
itself affected (the boundary context), and then updates the sums above the touched slots. Edits of all documents of a chunk are applied in
step, so that the regions they touch are encoded together.

Defined cases: a null text is empty and a null list has no edits; positions and lengths beyond the text are cut to it; an
empty text has one empty leaf and 0 tokens; repeated rows are counted row by row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.textvec import chunks, text_buffer
from plumbline.llm.wordbpe import WordBpe

LEAF = 512
EDITS = "array<struct<pos:long,n_delete:long,insert:string>>"


def cut_leaves(text: bytes, size: int = LEAF) -> list[bytes]:
    """Runs of at least `size` bytes, each but the first beginning with a space or a line feed."""
    out, at = [], 0
    while len(text) - at > size:
        space, line = text.find(b" ", at + size), text.find(b"\n", at + size)
        to = min((x for x in (space, line) if x > 0), default=-1)
        if to < 0:
            break
        out.append(text[at:to])
        at = to
    return [*out, text[at:]]


class CountTree:
    """Leaves of one document in slots, and sums of characters and tokens above the slots: node i has children 2i and 2i + 1.

    A slot begins with one leaf. An edit puts the leaves that take the place of others into the first slot it touches and empties
    the others, so it changes the sums above those slots only, however long the document is.
    """

    __slots__ = ("chars", "size", "slots", "tokens")

    def __init__(self, leaves: list[bytes], counts: list[int], chars: list[int]):
        self.slots: list[list[tuple[bytes, int, int]]] = [[leaf] for leaf in zip(leaves, counts, chars, strict=True)]
        size = 1 << max(0, len(counts) - 1).bit_length()
        pad = [0] * (size - len(counts))
        self.size, self.tokens, self.chars = size, [0] * size + counts + pad, [0] * size + chars + pad
        for sums in (self.tokens, self.chars):
            for i in range(size - 1, 0, -1):
                sums[i] = sums[2 * i] + sums[2 * i + 1]

    @property
    def leaves(self) -> list[bytes]:
        return [leaf for slot in self.slots for leaf, _, _ in slot]

    def find(self, pos: int) -> tuple[int, int, int]:
        """Slot, leaf in the slot, and place in the leaf of character `pos`; beyond the end: the last leaf's end."""
        node = 1
        while node < self.size:
            node *= 2
            if pos >= self.chars[node] and (self.chars[node + 1] or not self.chars[node]):
                pos -= self.chars[node]
                node += 1
        slot = min(node - self.size, len(self.slots) - 1)
        while not self.slots[slot] and slot:
            slot -= 1
        leaf = 0
        while leaf + 1 < len(self.slots[slot]) and pos >= self.slots[slot][leaf][2]:
            pos -= self.slots[slot][leaf][2]
            leaf += 1
        return slot, leaf, pos

    def before(self, slot: int, leaf: int) -> tuple[int, int] | None:
        """The leaf before one, or None."""
        if leaf:
            return slot, leaf - 1
        while slot:
            slot -= 1
            if self.slots[slot]:
                return slot, len(self.slots[slot]) - 1
        return None

    def region(self, pos: int, n_delete: int, insert: str) -> tuple[tuple[int, int], tuple[int, int], list[bytes]]:
        """(first leaf, last leaf, leaves that take their place) of an edit at a character position; a leaf is (slot, leaf in it)."""
        total = self.chars[1]
        pos = min(max(pos, 0), total)
        n_delete = min(max(n_delete, 0), total - pos)
        slot, leaf, at = self.find(pos)
        stop_slot, stop_leaf, _ = self.find(pos + max(n_delete - 1, 0))
        first, last = (slot, leaf), (stop_slot, stop_leaf)
        if at == 0 and (ahead := self.before(slot, leaf)):
            first = ahead
            at += self.slots[first[0]][first[1]][2]
        old = b"".join(x for x, _, _ in self._between(first, last)).decode()
        return first, last, cut_leaves((old[:at] + insert + old[at + n_delete :]).encode())

    def _between(self, first: tuple[int, int], last: tuple[int, int]) -> list[tuple[bytes, int, int]]:
        if first[0] == last[0]:
            return self.slots[first[0]][first[1] : last[1] + 1]
        middle = [leaf for k in range(first[0] + 1, last[0]) for leaf in self.slots[k]]
        return [*self.slots[first[0]][first[1] :], *middle, *self.slots[last[0]][: last[1] + 1]]

    def replace(self, first: tuple[int, int], last: tuple[int, int], leaves: list[bytes], counts: list[int], chars: list[int]) -> None:
        rest = self.slots[last[0]][last[1] + 1 :]
        self.slots[first[0]][first[1] :] = [*zip(leaves, counts, chars, strict=True), *rest]
        for k in range(first[0] + 1, last[0] + 1):
            self.slots[k] = []
        for k in range(first[0], last[0] + 1):
            self._update(k)

    def _update(self, slot: int) -> None:
        node = self.size + slot
        more = sum(c for _, c, _ in self.slots[slot]) - self.tokens[node]
        wide = sum(w for _, _, w in self.slots[slot]) - self.chars[node]
        while node and (more or wide):
            self.tokens[node] += more
            self.chars[node] += wide
            node //= 2

    @property
    def total(self) -> int:
        return self.tokens[1]


def measure(leaves: list[bytes], bpe: WordBpe) -> tuple[list[int], list[int]]:
    """Tokens and characters of each leaf."""
    offs = np.concatenate([[0], np.cumsum([len(x) for x in leaves])])
    data = np.frombuffer(b"".join(leaves), np.uint8)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return bpe.counts(data, offs).tolist(), np.diff(heads[offs]).tolist()


def build(texts: list[bytes], bpe: WordBpe) -> list[CountTree]:
    cut = [cut_leaves(t) for t in texts]
    counts, chars = measure([x for leaves in cut for x in leaves], bpe)
    out, at = [], 0
    for leaves in cut:
        out.append(CountTree(leaves, counts[at : at + len(leaves)], chars[at : at + len(leaves)]))
        at += len(leaves)
    return out


def apply_edits(trees: list[CountTree], edits: list[list[dict]], bpe: WordBpe) -> list[int]:
    """Apply each document's edits in order; returns the bytes encoded anew for each document."""
    spent = [0] * len(trees)
    for step in range(max((len(e) for e in edits), default=0)):
        todo = []
        for i, e in enumerate(edits):
            if step < len(e):
                todo.append((i, *trees[i].region(e[step]["pos"] or 0, e[step]["n_delete"] or 0, e[step]["insert"] or "")))
        counts, chars = measure([x for *_, leaves in todo for x in leaves], bpe)
        at = 0
        for i, a, b, leaves in todo:
            to = at + len(leaves)
            trees[i].replace(a, b, leaves, counts[at:to], chars[at:to])
            spent[i] += sum(map(len, leaves))
            at = to
    return spent


def _run(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe.load(path)
        for batch in chunks(batches, "text"):
            data, offs = text_buffer(batch.column("text"))
            raw = data.tobytes()
            trees = build([raw[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], bpe)
            before, leaves = [t.total for t in trees], [len(t.slots) for t in trees]
            spent = apply_edits(trees, [[e for e in x or [] if e] for x in batch.column("edits").to_pylist()], bpe)
            yield pa.record_batch([batch.column("doc_id"), pa.array(before, pa.int64()), pa.array([t.total for t in trees], pa.int64()), pa.array(leaves, pa.int64()), pa.array(spent, pa.int64())], ["doc_id", "n_tokens", "n_tokens_edited", "n_leaves", "reencoded_bytes"])

    return run


def count_tokens(docs: DataFrame, edits: Column | None = None, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_tokens_edited, n_leaves, reencoded_bytes. `edits`: a column of type `EDITS`, applied in order."""
    column = (F.lit(None) if edits is None else edits).cast(EDITS).alias("edits")
    out = "doc_id long, n_tokens long, n_tokens_edited long, n_leaves long, reencoded_bytes long"
    return docs.select(F.col("doc_id").cast("long"), "text", column).mapInArrow(_run(tokenizer), out)


def attach_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs with a column `edits` from a table (doc_id, seq, pos, n_delete, insert), in the order of seq (equal: of the other fields).

    All columns of docs stay (one named `edits` is an error). Null ids match null ids, every row of a repeated id gets the
    edits of its id, and a document without edits gets null. The edits of one document are one value, as `count_tokens` needs them.
    """
    if "edits" in {c.lower() for c in docs.columns}:
        raise ValueError("the column edits is added by attach_edits")
    listed = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "pos", "n_delete", "insert"))).alias("edits"))
    only = F.transform("edits", lambda e: F.struct(e["pos"].alias("pos"), e["n_delete"].alias("n_delete"), e["insert"].alias("insert")))
    one = listed.select(F.struct("doc_id").alias("_edited"), only.alias("edits"))
    rows = docs.withColumn("_own", F.struct("doc_id"))
    return rows.join(one, F.col("_own").eqNullSafe(F.col("_edited")), "left").drop("_own", "_edited")
