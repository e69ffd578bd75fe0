"""Benchmark decontamination (operator 1): pigeonhole pieces, exact hits, Myers bit-parallel verification.

Texts are normalised: lower case, runs of anything but letters and digits become one blank. A test item of n characters
may differ by floor(n * budget) edits from some part of a document; it is split into one piece more than that, of which
at least one must then stand in the document unchanged. An automaton finds the pieces, and Myers' bit-parallel
algorithm finds the least edit distance of the item to any part of the text around each hit.

The automaton is built for a block of items of BLOCK_CHARS characters at most, whatever the table holds; more items
mean more passes over the documents.

Defined results: a null or empty document matches nothing; an item without letters or digits is skipped, equal items
each report; rows with a null id are ignored; repeated documents each report; empty tables give an empty result; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import held, lean, tune

BUDGET = 0.05
BLOCK_CHARS = 4_000_000
#: Characters of text whose distances a task remembers.
KNOWN_CHARS = 20_000_000
_OTHER = regex.compile(r"[^\p{L}\p{N}]+")


def normal(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def pieces(item: str, budget: float = BUDGET) -> list[tuple[int, str]]:
    """(start, piece): one piece more than edits are allowed."""
    n = int(len(item) * budget) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def least_distance(pattern: str, text: str, most: int) -> int | None:
    """The least edit distance of pattern to any part of text, if it is at most `most`: Myers' algorithm, a column in one integer."""
    m = len(pattern)
    ones, top = (1 << m) - 1, 1 << (m - 1)
    eq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | 1 << i
    plus, minus, score, best = ones, 0, m, m
    for c in text:
        x = eq.get(c, 0) | minus
        d = (((x & plus) + plus) ^ plus) | x
        down, up = plus & d, minus | (~(plus | d) & ones)
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            best = min(best, score)
        up = (up << 1) & ones
        plus = ((down << 1) & ones) | (~(up | d) & ones)
        minus = up & d
    return best if best <= most else None


def matches(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", budget: float = BUDGET) -> DataFrame:
    """(doc_id, item_id, distance, budget): items of which some part of the document is within the budget."""
    spark = docs.sparkSession
    tune(spark)
    rows = docs.where(F.col(doc_id).isNotNull() & (F.length(text) > 0)).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    shape = "doc_id long, item_id long, distance int, budget int"
    found = [rows.mapInArrow(lean(_matches(block, budget)), shape) for block in blocks(items, item_id, item_text)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], shape)


def blocks(items: DataFrame, item_id: str, item_text: str) -> Iterator[list[tuple[int, str]]]:
    """The test items, normalised, in lists of BLOCK_CHARS characters or one item more."""
    block, size = [], 0
    tests = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long"), F.col(item_text).cast("string"))
    for item, raw in tests.toLocalIterator():
        t = normal(raw)
        if t and size and size + len(t) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        if t:
            block.append((item, t))
            size += len(t)
    if block:
        yield block


class Search:
    """An automaton over the pieces of a block of items, and distances that were found before, KNOWN_CHARS characters at most."""

    def __init__(self, block: list[tuple[int, str]], budget: float) -> None:
        import ahocorasick

        at: dict[str, list[tuple[int, int]]] = {}
        for k, (_, item) in enumerate(block):
            for start, piece in pieces(item, budget):
                at.setdefault(piece, []).append((k, start))
        self.tree = ahocorasick.Automaton()
        for piece, where in at.items():
            self.tree.add_word(piece, (len(piece), where))
        self.tree.make_automaton()
        self.block, self.budget = block, budget
        self.known: dict[tuple[int, str], int | None] = {}
        self.size = 0

    def distance(self, k: int, near: str, most: int) -> int | None:
        if (k, near) not in self.known:
            if self.size + len(near) > KNOWN_CHARS:
                self.known.clear()
                self.size = 0
            item = self.block[k][1]
            self.known[k, near] = 0 if item in near else least_distance(item, near, most)
            self.size += len(near)
        return self.known[k, near]

    def found(self, raw: str | None) -> Iterator[tuple[int, int, int]]:
        """(item_id, distance, edits allowed) of the items that a text holds."""
        t = normal(raw)
        spots: dict[int, set[int]] = {}
        for end, (n, where) in self.tree.iter(t):
            for k, start in where:
                spots.setdefault(k, set()).add(end + 1 - n - start)
        for k, begins in spots.items():
            item_id, item = self.block[k]
            most, best = int(len(item) * self.budget), None
            reach = -1
            for b in sorted(begins):  # places that one stretch of text covers are verified together
                if b <= reach:
                    continue
                reach = b + most
                got = self.distance(k, t[max(0, b - most) : reach + len(item) + most], most)
                best = got if best is None else best if got is None else min(best, got)
            if best is not None:
                yield item_id, best, most


def _matches(block: list[tuple[int, str]], budget: float):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(block, budget)
        for batch in batches:
            out = [(d, *x) for d, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in search.found(raw)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "item_id", "distance", "budget"])

    return over


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", budget: float = BUDGET) -> DataFrame:
    """The rows whose text holds no test item, with all their columns; each row is judged by its own text, whatever its id."""
    tune(docs.sparkSession)
    rows = held(docs, text=F.col(text).cast("string"))
    for block in blocks(items, item_id, item_text):
        rows = rows.mapInArrow(lean(_clean(block, budget)), rows.schema)
    return rows.select("row.*")


def _clean(block: list[tuple[int, str]], budget: float):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(block, budget)
        for batch in batches:
            yield batch.filter(pa.array([next(search.found(t), None) is None for t in batch.column("text").to_pylist()], pa.bool_()))

    return over
