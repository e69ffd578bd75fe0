"""Line dedup (operator 6): winnowing over line hashes, joined positions, matches extended both ways, later runs deleted.

A line's key is the 128-bit hash of its text without blanks at its ends; blank lines have none. A match counts where two
places agree in `run` consecutive keyed lines, or in fewer lines that hold `long` words; a document of fewer keyed lines
than `run` is also compared as a whole with others of that kind.

1. Winnowing: of every such window of a document the least key, the rightmost of equals, is a fingerprint. Equal windows
   have equal minima at equal places, so no match is without a fingerprint. There is one row for each place picked.
2. Positions are joined on the fingerprint: those whose key stands nowhere else are gone.
3. Each position left is extended line by line to both sides, over the windows that it is the least of, and each such
   window is given the first position in (doc_id, line) order that agrees with it all the way. Windows that lie further
   off have fingerprints of their own, so a match of any length is followed from one fingerprint to the next; no two
   positions are paired, and a very frequent line costs as many rows as it has positions.
4. Where a window came before, its lines belong to a later run; what overlaps makes one maximal run, which is deleted.

Defined results: a null or blank text has no lines with a key and stays as it is; of equal documents the first stays
whole; a document of which all lines go keeps an empty text; a null doc_id comes after all others; repeated doc_ids are
told apart by text hash and share deletions only if their texts are equal, so a row that comes twice stays twice; ties
go to the earlier place; an empty table gives an empty result; extra columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from weftline.llm.common import held, lean, stage, tune, unused

#: Lines, or words in fewer lines, that make a repeated run.
RUN, LONG = 3, 50
#: Fingerprints that a task hands over at a time.
FLUSH = 5_000
BLANKS = " \t\n\x0b\x0c\r"


def keyed(text: str) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(numbers, word counts, keys) of the lines of text that aren't blank."""
    from xxhash import xxh3_128_digest

    rows = [(i, b) for i, x in enumerate(text.split("\n")) if (b := x.strip(BLANKS).encode("utf-8", "surrogatepass"))]
    return np.array([i for i, _ in rows], dtype=np.int32), np.array([len(b.split()) for _, b in rows], dtype=np.int64), [xxh3_128_digest(b) for _, b in rows]


def windows(words: np.ndarray, run: int, long: int) -> Iterator[tuple[int, np.ndarray]]:
    """(lines, starts) of the windows of a document: all of `run` lines, shorter ones of `long` words, or the whole of a short document."""
    n, before = len(words), np.concatenate([[0], np.cumsum(words)])
    for size in range(1, min(run, n) + 1):
        starts = np.arange(n - size + 1)
        yield size, starts if size == min(run, n) else starts[before[size:] - before[:-size] >= long]


def winnow(words: np.ndarray, keys: list[bytes], run: int, long: int) -> dict[int, list[tuple[int, int]]]:
    """Fingerprints: the places that are the least of a window, each with the windows (start, lines) to which it extends."""
    out: dict[int, list[tuple[int, int]]] = {}
    if keys:
        marks = np.frombuffer(b"".join(keys), dtype="<u8")[::2]
        for size, starts in windows(words, run, long):
            if len(starts):
                around = marks[starts[:, None] + np.arange(size - 1, -1, -1)]
                for place, start in zip((starts + size - 1 - around.argmin(axis=1)).tolist(), starts.tolist(), strict=True):
                    out.setdefault(place, []).append((start, size))
    return out


_REACH = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("run", pa.binary())]))


def _fingerprints(run: int, long: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        cols: dict[str, list] = {k: [] for k in ("mark", "id", "copy", "place", "reach")}

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), _REACH)
            signed = np.frombuffer(b"".join(cols["mark"]), dtype="<i8")
            out = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip((signed, *list(cols.values())[1:]), kinds, strict=True)], names=list(cols))
            for v in cols.values():
                v.clear()
            return out

        for batch in batches:
            for d, c, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                _, words, keys = keyed(text)
                for p, mine in winnow(words, keys, run, long).items():
                    found = [{"start": s, "n": n, "run": xxh3_128_digest(b"".join(keys[s : s + n]))} for s, n in mine]
                    for k, v in zip(cols, (keys[p][:8], d, c, p, found), strict=True):
                        cols[k].append(v)
                    if len(cols["mark"]) >= FLUSH:
                        yield flush()
            if cols["mark"]:
                yield flush()

    return over


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deletes the later runs: (row, kept, removed)."""
    for batch in batches:
        kept, removed = [], []
        for text, later in zip(batch.column("text").to_pylist(), batch.column("later").to_pylist(), strict=True):
            if not later:
                kept.append(text)
                removed.append(0)
                continue
            at = keyed(text)[0]
            gone = {int(at[i]) for x in later for i in range(x["start"], x["start"] + x["n"])}
            kept.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone))
            removed.append(len(gone))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.string()), pa.array(removed, pa.int64())], names=["row", "kept", "removed"])


def later_runs(rows: DataFrame, run: int = RUN, long: int = LONG) -> DataFrame:
    """rows(id, copy, text) -> (id, copy, later): the windows (start, n), counted in keyed lines, that came before."""
    marks = rows.where(F.length("text") > 0).select("id", "copy", "text").mapInArrow(lean(_fingerprints(run, long)), "mark long, id long, copy long, place int, reach array<struct<start: int, n: int, run: binary>>")
    marks = stage(marks, "fingerprints")
    # Written before they are joined: both sides are then plain shuffles, so that a hot key's side can be split.
    twice = stage(marks.groupBy("mark").agg(F.count("*").alias("times")).where("times > 1").select("mark"), "twice")
    extended = stage(marks.join(twice.hint("shuffle_hash"), "mark").select("id", "copy", F.inline("reach")), "extended")
    first = extended.groupBy("run").agg(F.count("*").alias("times"), F.min(F.struct("id", "copy", "start")).alias("first"))
    first = stage(first.where("times > 1").select("run", "first"), "first")
    later = extended.join(first.hint("shuffle_hash"), "run").where(F.struct("id", "copy", "start") != F.col("first"))
    return later.groupBy("id", "copy").agg(F.collect_set(F.struct("start", "n")).alias("later"))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", run: int = RUN, long: int = LONG) -> DataFrame:
    """docs with the text that is left, and the number of lines deleted in `_removed` (a name that docs hasn't got)."""
    tune(docs.sparkSession)
    last = F.lit((1 << 63) - 1)
    rows = held(docs, id=F.coalesce(F.col(doc_id).cast("long"), last), copy=F.xxhash64(F.col(text).cast("string")), text=F.col(text).cast("string"))
    later = stage(later_runs(rows, run, long), "later")
    cleaned = rows.join(later.hint("shuffle_hash"), ["id", "copy"], "left").select("row", "text", "later")
    done = cleaned.mapInArrow(lean(_without), StructType([rows.schema["row"], StructField("kept", StringType()), StructField("removed", LongType())]))
    return done.select(*(F.col("kept").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns), F.col("removed").alias(unused("_removed", docs.columns)))
