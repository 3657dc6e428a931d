"""Edit-aware token counts.

A document is cut into leaves at places where the tokenizer's pre-tokens must
end (before a single space between two other characters), so the counts of
leaves add up to the count of the text. Over the leaves stands a segment tree
of sums. An edit re-encodes only the leaves that it touches, plus neighbours
as long as an outer boundary isn't a pre-token boundary any more, and updates
the sums from those leaves to the root.

Trees are rows of a table next to their text, so building and editing are
narrow: no shuffle, and memory is a slice of rows or one document.

Defined cases: a null text is empty and has 0 tokens in one empty leaf; edits
are (start, end, replacement) in characters of the text they apply to, in
ascending order, not overlapping; places beyond the end mean the end; rows
that repeat a doc_id are counted one by one; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.kernels import text_slices
from loomery.llm.pieces import SLICE_BYTES, encode_texts, tokenizer
from loomery.llm.shared import scratch_path, text_of

TOKENIZER = "byte_bpe_50k.json"
LEAF = 512
#: A region that edits have made longer than this many times LEAF a leaf makes its tree be built anew.
GROWN = 8


def count_tokens(texts: list[str], path: str) -> list[int]:
    return [len(e) for e in tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


_SAFE = re.compile(r"(?<=\S)(?= \S)")


def is_boundary(text: str, at: int) -> bool:
    """Whether every pre-token of ``text`` ends at or before ``at`` or begins there."""
    return at <= 0 or at >= len(text) or (text[at] == " " and not text[at - 1].isspace() and at + 1 < len(text) and not text[at + 1].isspace())


def cut_leaves(text: str) -> list[int]:
    """Lengths of the leaves: each ends at the first boundary after LEAF characters."""
    lengths, a = [], 0
    while a < len(text):
        m = _SAFE.search(text, a + LEAF)
        b = m.start() if m else len(text)
        lengths.append(b - a)
        a = b
    return lengths or [0]


def build_tree(counts: list[int]) -> list[int]:
    """Sums as a heap: node k over 2k and 2k + 1, leaves in the last half, root at 1."""
    width = 1 << (len(counts) - 1).bit_length()
    tree = [0] * width + counts + [0] * (width - len(counts))
    for k in range(width - 1, 0, -1):
        tree[k] = tree[2 * k] + tree[2 * k + 1]
    return tree


class Region:
    """Leaves ``first`` to ``last`` of a text, the edits in them, and what they read after those."""

    def __init__(self, first: int, last: int, edits: list[tuple[int, int, str]]):
        self.first, self.last, self.edits, self.text = first, last, edits, ""


class CountedText:
    """A text, its leaves' lengths and its tree of token counts."""

    def __init__(self, text: str, lengths: list[int], tree: list[int], path: str):
        self.text, self.lengths, self.tree, self.path, self.encoded = text, lengths, tree, path, 0

    @property
    def n_tokens(self) -> int:
        return self.tree[1]

    def edit(self, start: int, end: int, replacement: str) -> None:
        regions = self.regions([(start, end, replacement)])
        self.update(regions, count_tokens([r.text for r in regions], self.path))

    def regions(self, edits: list[tuple[int, int, str]]) -> list[Region]:
        """The runs of leaves that the edits touch, with neighbours as long as an
        outer end isn't a pre-token boundary; no two of them are neighbours."""
        self.ends = list(accumulate(self.lengths))
        n, size = len(self.lengths), len(self.text)
        found: list[Region] = []
        for start, end, new in edits:
            start = min(start, size)
            end = min(max(start, end), size)
            first = min(bisect_left(self.ends, start), n - 1)
            found.append(Region(first, min(max(bisect_left(self.ends, end), first), n - 1), [(start, end, new)]))
        while True:
            merged: list[Region] = []
            for r in found:
                if merged and r.first <= merged[-1].last + 1:
                    merged[-1].last = max(merged[-1].last, r.last)
                    merged[-1].edits += r.edits
                else:
                    merged.append(r)
            wider = False
            for r in merged:
                a, b = self._span(r)
                r.text = edited(self.text, a, b, r.edits)
                after = self.text[b : b + 2]
                if r.first > 0 and not is_boundary(self.text[a - 1] + (r.text[:2] + after)[:2], 1):
                    r.first, wider = r.first - 1, True
                before = (self.text[a - 1 : a] if a else "") + r.text[-1:]
                if r.last < n - 1 and before and not is_boundary(before[-1] + after, 1):
                    r.last, wider = r.last + 1, True
            if not wider:
                return merged
            found = merged

    def _span(self, r: Region) -> tuple[int, int]:
        return (self.ends[r.first - 1] if r.first else 0), self.ends[r.last]

    def update(self, regions: list[Region], counts: list[int]) -> None:
        """Put the regions' texts and counts in. A region is its first leaf and the
        others become empty, so the tree keeps its shape; only a region that has
        grown far beyond its leaves is cut anew, and the tree built from all counts."""
        parts, at, grown = [], 0, []
        for r, count in zip(regions, counts, strict=True):
            a, b = self._span(r)
            parts += [self.text[at:a], r.text]
            at = b
            self.encoded += len(r.text)
            if len(r.text) > GROWN * LEAF * (r.last - r.first + 1):
                grown.append(r)
            for k in range(r.first, r.last + 1):
                self.lengths[k] = len(r.text) if k == r.first else 0
                self._set(k, count if k == r.first else 0)
        self.text = "".join([*parts, self.text[at:]])
        width = len(self.tree) // 2
        leaves = self.tree[width : width + len(self.lengths)]
        for r in reversed(grown):
            fresh = cut_leaves(r.text)
            ends = list(accumulate(fresh))
            counts = count_tokens([r.text[e - n : e] for e, n in zip(ends, fresh, strict=True)], self.path)
            self.lengths[r.first : r.last + 1], leaves[r.first : r.last + 1] = fresh, counts
        if grown:
            self.tree = build_tree(leaves)

    def _set(self, leaf: int, count: int) -> None:
        k = len(self.tree) // 2 + leaf
        change = count - self.tree[k]
        while k and change:
            self.tree[k] += change
            k //= 2


def edited(text: str, a: int, b: int, edits: list[tuple[int, int, str]]) -> str:
    """What text[a:b] reads after the edits in it."""
    parts = []
    for start, end, new in edits:
        parts += [text[a:start], new]
        a = end
    return "".join([*parts, text[a:b]])


def _build(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, SLICE_BYTES):
            texts = batch.column("text").to_pylist()
            lengths = [cut_leaves(t) for t in texts]
            leaves: list[str] = []
            for t, n in zip(texts, lengths, strict=True):
                x = 0
                for k in n:
                    leaves.append(t[x : x + k])
                    x += k
            counts = iter(encode_texts(pa.array(leaves, pa.large_string()), path)[0].tolist())
            trees = [build_tree([next(counts) for _ in n]) for n in lengths]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(lengths, pa.list_(pa.int32())), pa.array(trees, pa.list_(pa.int32()))], ["doc_id", "text", "leaves", "tree"])

    return run


def build_trees(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, text, leaves (lengths), tree (token sums) of each row of ``docs``."""
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(_build(path), "doc_id long, text string, leaves array<int>, tree array<int>")


def _apply(edits_of: Callable[[str], list[tuple[int, int, str]]], path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            docs = [CountedText(*row, path) for row in zip(*(batch.column(c).to_pylist() for c in ("text", "leaves", "tree")), strict=True)]
            before, edits = [d.n_tokens for d in docs], [edits_of(d.text) for d in docs]
            touched = [d.regions(e) for d, e in zip(docs, edits, strict=True)]
            counts = iter(count_tokens([r.text for x in touched for r in x], path))
            rows = []
            for i, d, n, e, x in zip(batch.column("doc_id").to_pylist(), docs, before, edits, touched, strict=True):
                d.update(x, [next(counts) for _ in x])
                rows.append((i, n, len(e), d.n_tokens, len(d.text), d.encoded, len(d.lengths)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(7)], ["doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_chars_after", "n_chars_encoded", "n_leaves"])

    return run


def apply_edits(trees: DataFrame, edits_of: Callable[[str], list[tuple[int, int, str]]], path: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_after, n_chars_after, n_chars_encoded (by the edits), n_leaves."""
    return trees.mapInArrow(_apply(edits_of, path), "doc_id long, n_tokens long, n_edits long, n_tokens_after long, n_chars_after long, n_chars_encoded long, n_leaves long")


_MAIL = re.compile(r"[A-Za-z0-9._]+@[A-Za-z0-9.]*[A-Za-z0-9]")


def redactions(text: str) -> list[tuple[int, int, str]]:
    """Edits of the registered query: e-mail addresses become [mail], and a note goes in the middle."""
    middle = len(text) // 2
    found = [(m.start(), m.end(), "[mail]") for m in _MAIL.finditer(text)]
    inside = any(a < middle < b for a, b, _ in found)
    return sorted([*found, *([] if inside else [(middle, middle, " (revised) ")])])


def count_with_edits(docs: DataFrame, edits_of: Callable[[str], list[tuple[int, int, str]]] = redactions, path: str = TOKENIZER) -> DataFrame:
    """Count every document, keep the trees as a table, and count again after edits."""
    spark, at = docs.sparkSession, scratch_path(docs.sparkSession, "trees")
    trees = build_trees(docs, path)
    trees.write.option("compression", "zstd").parquet(at)
    return apply_edits(spark.read.schema(trees.schema).parquet(at), edits_of, path)
