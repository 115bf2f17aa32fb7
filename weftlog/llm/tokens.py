"""Edit-aware token counts.

A document is kept as a segment tree whose leaves are runs of whole pre-tokens, with the sums of characters and tokens of
each subtree. An edit finds the leaves that it touches, adds a neighbour where the edit meets its boundary, encodes that
region again and updates the sums above it; all other counts stand.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlog.llm.common import boxed, unboxed, with_fields

#: Characters of a leaf, at least, where the text has a boundary; a leaf of four times as many is cut again.
LEAF = 512


class Counter:
    """Counts tokens of a byte-level BPE whose pre-tokens never hold white space after other characters.

    So a text can be cut before white space that follows another character, and counts add up.
    """

    cut = re.compile(r"(?<=\S)[ \n]")

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def leaves(self, text: str, least: int = LEAF) -> list[str]:
        out, low = [], 0
        while len(text) - low > least and (m := self.cut.search(text, low + least)):
            out.append(text[low : m.start()])
            low = m.start()
        return [*out, text[low:]]


@cache
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


class SegmentTree:
    """Sums of characters and tokens over the leaves of one text; ``encoded`` counts characters encoded after the start."""

    def __init__(self, leaves: list[str], tokens: list[int], count: Counter, least: int = LEAF) -> None:
        self.count, self.least, self.encoded = count, least, 0
        self._build(leaves, tokens)

    @classmethod
    def of(cls, text: str, count: Counter, least: int = LEAF) -> SegmentTree:
        leaves = count.leaves(text, least)
        return cls(leaves, [count(x) for x in leaves], count, least)

    def _build(self, leaves: list[str], tokens: list[int]) -> None:
        self.leaves = leaves
        self.width = 1 << max(0, len(leaves) - 1).bit_length()
        self.sums = np.zeros((2, 2 * self.width), np.int64)
        self.sums[0, self.width : self.width + len(leaves)] = [len(x) for x in leaves]
        self.sums[1, self.width : self.width + len(leaves)] = tokens
        for k in range(self.width - 1, 0, -1):
            self.sums[:, k] = self.sums[:, 2 * k] + self.sums[:, 2 * k + 1]

    @property
    def chars(self) -> int:
        return int(self.sums[0, 1])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last for the end of the text) and where in it."""
        k = 1
        while k < self.width:
            k *= 2
            if at >= self.sums[0, k] and self.sums[0, k + 1]:
                at -= int(self.sums[0, k])
                k += 1
        return k - self.width, at

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters start to end (exclusive) by ``new``; places beyond the text mean its end."""
        start = min(max(start, 0), self.chars)
        end = min(max(end, start), self.chars)
        (i, a), (j, b) = self._find(start), self._find(end)
        region = self.leaves[i][:a] + new + self.leaves[j][b:]
        low, high = i, j
        # The cut before the region holds if the region still begins with white space and what precedes it does not end
        # with any; likewise the one after it.
        while low > 0 and not (region[:1] in (" ", "\n") and region and self._ends_solid(low - 1)):
            low -= 1
            region = self.leaves[low] + region
        while high + 1 < len(self.leaves) and not (region and not region[-1].isspace() and self._begins_cut(high + 1)):
            high += 1
            region += self.leaves[high]
        self.encoded += len(region)
        new_leaves = self.count.leaves(region, self.least)
        if len(new_leaves) <= high - low + 1 and len(region) <= 4 * self.least * (high - low + 1):
            new_leaves += [""] * (high - low + 1 - len(new_leaves))
            for k, leaf in enumerate(new_leaves, low):
                self._set(k, leaf, self.count(leaf))
        elif len(region) <= 4 * self.least:
            for k in range(low, high + 1):
                self._set(k, region if k == low else "", self.count(region) if k == low else 0)
        else:  # more leaves than there is room for: the tree is laid out anew, with the counts it has
            had = self.sums[1, self.width : self.width + len(self.leaves)].tolist()
            self._build(
                self.leaves[:low] + new_leaves + self.leaves[high + 1 :], had[:low] + [self.count(x) for x in new_leaves] + had[high + 1 :]
            )

    def _ends_solid(self, k: int) -> bool:
        return bool(self.leaves[k]) and not self.leaves[k][-1].isspace()

    def _begins_cut(self, k: int) -> bool:
        return self.leaves[k][:1] in (" ", "\n") and bool(self.leaves[k])

    def _set(self, k: int, leaf: str, tokens: int) -> None:
        self.leaves[k] = leaf
        at = k + self.width
        self.sums[:, at] = len(leaf), tokens
        while at > 1:
            at //= 2
            self.sums[:, at] = self.sums[:, 2 * at] + self.sums[:, 2 * at + 1]


_TREE = "struct<chars:array<int>,tokens:array<int>>"
EDITS = "array<struct<start:bigint,end:bigint,new:string>>"


def trees(docs: DataFrame, path: str, pattern: str, text_col: str = "text", name: str = "tree") -> DataFrame:
    """``docs`` with a column ``name``: characters and tokens of each leaf of the text's tree (null texts: of '').

    Very long texts are encoded whole, leaf by leaf; repeated rows and all other columns stay, one called ``name`` is replaced;
    an empty table gives no rows.
    """
    sent = docs.select(boxed(docs, (name,)), F.col(text_col).alias("_text"))
    schema = with_fields(sent.select("_row").schema, f"_tree {_TREE}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, pattern)
        for b in batches:
            found = [SegmentTree.of(t.as_py() or "", count) for t in b.column(1)]
            rows = [{"chars": [len(x) for x in t.leaves], "tokens": t.sums[1, t.width : t.width + len(t.leaves)].tolist()} for t in found]
            kind = pa.struct([("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], schema.names)

    return unboxed(sent.mapInArrow(run, schema), F.col("_tree").alias(name))


def recount(docs: DataFrame, edits: Column, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", tree_col: str | None = None) -> DataFrame:
    """(id, text, n_chars, n_tokens, leaves int, before long, encoded long, tree) after ``edits`` are applied in turn.

    ``edits``: an array of (start, end, new) for each row, positions in code points of the text as it is when the edit
    comes; null edits do nothing, a null ``new`` deletes. ``tree_col``, from :func:`trees`, gives the counts before, and the
    text is not encoded but where edits touch it; without it the tree is built first. ``before`` is the count before and
    ``encoded`` the characters encoded by edits. Null texts are edited like empty ones, very long ones leaf by leaf; null ids and
    repeated rows stay; other columns are not read; an empty table gives no rows.
    """
    sent = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), edits.cast(EDITS).alias("edits"), (F.col(tree_col) if tree_col else F.lit(None).cast(_TREE)).alias("tree"))
    added = f"n_chars long, n_tokens long, leaves int, before long, encoded long, tree {_TREE}"
    schema = with_fields(sent.select("id", "text").schema, added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, pattern)
        for b in batches:
            out = []
            for text, todo, kept in zip(b.column(1), b.column(2), b.column(3)):
                text, kept = text.as_py() or "", kept.as_py()
                if kept:
                    ends = np.cumsum(kept["chars"]).tolist()
                    tree = SegmentTree([text[a:c] for a, c in zip([0, *ends], ends)], kept["tokens"], count)
                else:
                    tree = SegmentTree.of(text, count)
                before = tree.tokens
                for e in todo.as_py() or []:
                    if e is not None:
                        tree.edit(e["start"] or 0, e["end"] if e["end"] is not None else e["start"] or 0, e["new"] or "")
                tokens = tree.sums[1, tree.width : tree.width + len(tree.leaves)].tolist()
                out.append((tree.text, tree.chars, tree.tokens, len(tree.leaves), before, tree.encoded, {"chars": [len(x) for x in tree.leaves], "tokens": tokens}))
            cols = list(zip(*out)) or [[]] * 7
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.struct([("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], schema.names)

    return sent.mapInArrow(run, schema)
