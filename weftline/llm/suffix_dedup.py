"""Suffix-array dedup (operator 8): bytes covered by a 200-byte string that also starts anywhere else are removed.

1. Winnowing picks in every LENGTH-byte window the GRAM-byte string of least hash. Equal windows pick equal strings, so a
   window whose string is unique in the corpus is unique too; only windows around repeated strings go on.
2. Each repeated string goes on as a segment, the windows that picked it. Equal segments are counted, not copied.
   Segments of a string share a shard, so equal windows do too, except where a string has so many segments that its
   shard is split.
3. A shard sorts its suffixes by Larsson-Sadakane refinement to a depth of LENGTH bytes exactly: windows that are equal
   get one rank, so no common prefixes are measured; those of a rank that comes twice, or in a segment counted twice, repeat.
4. Windows that a split shard leaves alone, and one of each kind that it knows, are merged across its parts: sorted
   window fingerprints of 128 bits, looked up in the other parts by binary search.

Defined results: a null text is an empty one; a text of fewer than LENGTH bytes stays whole; equal rows remove each
other's windows; repeated or null doc_ids are told apart by their texts; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import encoded, prefix_hash, range_hash, sliced, stage, tune

LENGTH, GRAM = 200, 50
#: Bytes of segments in a shard, and segments of one string beyond which its shard is split.
SHARD_BYTES, SPLIT = 1_000_000, 3000
_PLACE = np.uint64((1 << 26) - 1)


def anchors(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(text index, hashes of the strings picked, first window start of each, last one) of each text of LENGTH bytes or more."""
    span = LENGTH - GRAM + 1
    for a, b in sliced(texts):
        joined = b"".join(texts[a:b])
        if len(joined) < LENGTH:
            continue
        prefix = prefix_hash(np.frombuffer(joined, dtype=np.uint8))
        at = np.arange(len(joined) - GRAM + 1)
        grams = range_hash(prefix, at, at + GRAM)
        low = (grams & ~_PLACE) | (_PLACE - (at.astype(np.uint64) & _PLACE))  # of equals the rightmost is the least
        n = 1
        while 2 * n <= span:
            low = np.minimum(low[:-n], low[n:])
            n *= 2
        if span > n:
            low = np.minimum(low[: len(low) - (span - n)], low[span - n :])
        offset = 0
        for i in range(a, b):
            size = len(texts[i])
            if size >= LENGTH:
                mine = low[offset : offset + size - LENGTH + 1]
                first = np.concatenate([[0], np.flatnonzero(mine[1:] != mine[:-1]) + 1])
                last = np.concatenate([first[1:] - 1, [size - LENGTH]])
                place = (_PLACE - (mine[first] & _PLACE)).astype(np.int64)
                # the place is modulo 2**26; the window start tells which multiple
                place += (first + offset - place + int(_PLACE)) // (1 << 26) * (1 << 26)
                yield i, grams[place], first, last
            offset += size


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in the order of their first `depth` bytes, ranks), by Larsson-Sadakane refinement: suffixes of `depth` bytes
    or more have equal ranks where these bytes are equal. The last round adds only what is missing to `depth`, 8 at least."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : n + j]
    order = np.argsort(key)
    same = np.concatenate([[False], key[order][1:] == key[order][:-1]])
    rank = np.empty(n, dtype=np.int64)

    def number(slots: np.ndarray, same: np.ndarray) -> None:
        """The rank of a suffix is the slot where its group begins."""
        heads = np.where(same, 0, slots)
        rank[order[slots]] = np.maximum.accumulate(heads)

    slots = np.arange(n)
    number(slots, same)
    h = 8
    while h < depth:
        more = min(h, depth - h)
        r = rank[order]
        again = np.concatenate([[False], r[1:] == r[:-1]])
        open_ = np.flatnonzero(again | np.concatenate([again[1:], [False]]))
        if len(open_):
            s = order[open_]
            next_ = s + more
            follow = np.where(next_ < n, rank[np.minimum(next_, n - 1)] + 1, 0)
            both = (rank[s].astype(np.uint64) << np.uint64(32)) | follow.astype(np.uint64)
            turn = np.argsort(both)
            order[open_] = s[turn]
            both = both[turn]
            number(open_, np.concatenate([[False], both[1:] == both[:-1]]))
        h += more
    return order, rank


def repeated_windows(segments: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of all segments, in order: (segment, start in it, whether it repeats, number of its kind)."""
    data = np.frombuffer(b"".join(segments), dtype=np.uint8)
    lengths = np.array([len(s) for s in segments])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    windows = lengths - LENGTH + 1
    _, rank = suffix_array(data, LENGTH)
    segment = np.repeat(np.arange(len(segments)), windows)
    place = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    kind = rank[starts[segment] + place]  # equal windows stand together in suffix order and have one rank
    times = np.bincount(kind, counts[segment], minlength=len(data))
    return segment, place, times[kind] >= 2, kind


def _runs(flags: np.ndarray) -> list[int]:
    """Start and length of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return np.stack([edge[::2], edge[1::2] - edge[::2]], 1).ravel().tolist()


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, mark, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), encoded(batch.column(2).to_pylist())
        found = list(anchors(texts))
        if found:
            sizes = [len(h) for _, h, _, _ in found]
            who = np.repeat([i for i, *_ in found], sizes)
            yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(mark[who]), pa.array(np.concatenate([h for _, h, _, _ in found]).view(np.int64))], names=["doc_id", "mark", "anchor"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, mark, texts, wanted = batch.column(0).to_numpy(), batch.column(1).to_numpy(), encoded(batch.column(2).to_pylist()), batch.column(3).to_pylist()
        cols: dict[str, list] = {k: [] for k in ("anchor", "segment", "doc_id", "mark", "place", "bytes")}

        def flush(cols=cols) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            out = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols.values(), kinds, strict=True)], names=list(cols))
            for v in cols.values():
                v.clear()
            return out

        for i, h, first, last in anchors(texts):
            signed = h.view(np.int64)
            for j in np.flatnonzero(np.isin(signed, wanted[i])):
                piece = texts[i][first[j] : last[j] + LENGTH]
                for k, v in zip(cols, (int(signed[j]), hashlib.blake2b(piece, digest_size=16).digest(), ids[i], mark[i], int(first[j]), piece), strict=True):
                    cols[k].append(v)
            if len(cols["bytes"]) > 20_000:
                yield flush()
        if cols["bytes"]:
            yield flush()


def _shard(key: tuple, table: pa.Table) -> pa.Table:
    """The repeated runs of each segment, and of split strings the windows to be merged."""
    pieces, counts = table.column("bytes").to_pylist(), table.column("n").to_numpy().astype(np.float64)
    names, parts, anchor = table.column("segment").to_pylist(), table.column("parts").to_numpy(), table.column("anchor").to_numpy()
    segment, place, twice, kind = repeated_windows(pieces, counts)
    bounds = np.searchsorted(segment, np.arange(len(pieces) + 1))
    rows: dict[str, list] = {k: [] for k in ("segment", "runs", "anchor", "part", "places", "w1", "w2", "known")}
    seen = np.zeros(kind.max() + 1, dtype=bool) if len(kind) else np.zeros(0, dtype=bool)
    for i, piece in enumerate(pieces):
        a, b = bounds[i], bounds[i + 1]
        ask: list = [None] * 4
        if parts[i] > 1:
            data = np.frombuffer(piece, dtype=np.uint8)
            new = ~seen[kind[a:b]]
            seen[kind[a:b]] = True
            at = place[a:b][new]
            ask = [at.astype(np.int32), *(range_hash(prefix_hash(d), at, at + LENGTH).view(np.int64) for d in (data, data ^ np.uint8(0x5A))), twice[a:b][new]]
        for k, v in zip(rows, (names[i], _runs(twice[a:b]), int(anchor[i]), int(key[1].as_py()), *ask), strict=True):
            rows[k].append(v)
    kinds = (pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()))
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(rows.items(), kinds, strict=True)})


def _merge(key: tuple, table: pa.Table) -> pa.Table:
    """Windows of one part that a binary search finds in another part."""
    t = table.sort_by([("w1", "ascending"), ("w2", "ascending")])
    part = t.column("part").to_numpy()
    w = np.empty(len(part), dtype=[("a", "i8"), ("b", "i8")])
    w["a"], w["b"] = t.column("w1").to_numpy(), t.column("w2").to_numpy()
    hit = np.zeros(len(part), dtype=bool)
    own = {p: w[part == p] for p in np.unique(part)}
    for p, mine in own.items():
        found = np.zeros(len(mine), dtype=bool)
        for q, theirs in own.items():
            if q != p:
                at = np.minimum(np.searchsorted(theirs["a"], mine["a"]), len(theirs) - 1)
                found |= theirs[at] == mine
        hit[part == p] = found
    return t.filter(pa.array(hit)).select(["anchor", "w1", "w2"])


def _result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept")}
        for d, text, spans in zip(batch.column(0).to_pylist(), encoded(batch.column(1).to_pylist()), batch.column(2).to_pylist(), strict=True):
            gone, merged = 0, []
            for a, b in sorted((x["a"], x["b"]) for x in spans or ()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            kept, at = [], 0
            for a, b in merged:
                kept.append(text[at:a])
                at, gone = b, gone + b - a
            for k, v in zip(rows, (d, len(text), gone, len(merged), b"".join([*kept, text[at:]])), strict=True):
                rows[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "kept" else pa.int64()) for k, v in rows.items()], names=list(rows))


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept holds the bytes that are left."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).cast("string").alias("text"))
    marked = stage(rows.select("doc_id", "mark", "text").mapInArrow(_marks, "doc_id long, mark long, anchor long"), "marked")
    # Written before they are joined: both sides are then plain shuffles, so that a very frequent string's side can be split.
    twice = stage(marked.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "twice")
    wanted = marked.join(twice.hint("shuffle_hash"), "anchor").groupBy("doc_id", "mark").agg(F.collect_set("anchor").alias("anchors"))
    wanted = stage(wanted, "wanted")
    found = rows.select("doc_id", "mark", "text").join(wanted.hint("shuffle_hash"), ["doc_id", "mark"]).select("doc_id", "mark", "text", "anchors")
    found = stage(found.mapInArrow(_segments, "anchor long, segment binary, doc_id long, mark long, place int, bytes binary"), "segments")

    kinds = found.groupBy("segment").agg(F.count("*").alias("n"), F.first("anchor").alias("anchor"), F.first("bytes").alias("bytes"))
    kinds = stage(kinds, "kinds")
    split = kinds.groupBy("anchor").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("parts"), F.sum(F.length("bytes")).alias("size"))
    split = stage(split, "strings")
    shards = max(1, -(-(split.agg(F.sum("size")).first()[0] or 0) // SHARD_BYTES))
    split = split.select("anchor", "parts")
    sharded = kinds.join(split, "anchor").select(
        "*", F.when(F.col("parts") > 1, F.col("anchor")).otherwise(F.pmod("anchor", F.lit(shards))).alias("shard"), F.pmod(F.xxhash64("segment"), F.col("parts")).cast("int").alias("part")
    )
    solved = stage(
        sharded.groupBy("shard", "part").applyInArrow(_shard, "segment binary, runs array<int>, anchor long, part int, places array<int>, w1 array<long>, w2 array<long>, known array<boolean>"), "solved"
    )
    open_ = solved.where("places is not null").select("segment", "anchor", "part", F.explode(F.arrays_zip("places", "w1", "w2", "known")).alias("x")).select("segment", "anchor", "part", "x.*")
    met = open_.withColumn("slice", F.pmod("w1", F.lit(256))).groupBy("anchor", "slice").applyInArrow(_merge, "anchor long, w1 long, w2 long").distinct()
    # A window that another part knows repeats wherever its own part has it: all its segments are asked again by fingerprint.
    every = kinds.join(split.where("parts > 1"), "anchor").select("segment", "anchor", "bytes").mapInArrow(_windows, "segment binary, anchor long, place int, w1 long, w2 long")
    late = every.join(met, ["anchor", "w1", "w2"]).groupBy("segment").agg(F.flatten(F.collect_list(F.array("place", F.lit(1)))).alias("runs"))
    runs = solved.select("segment", "runs").where("size(runs) > 0").unionByName(late.select("segment", F.col("runs").cast("array<int>")))
    # Written before it is joined, as above: the rows of a very frequent segment can then be split.
    runs = stage(runs.groupBy("segment").agg(F.flatten(F.collect_list("runs")).alias("runs")), "runs")

    spans = found.select("segment", "doc_id", "mark", "place").join(runs.hint("shuffle_hash"), "segment").select(
        "doc_id", "mark", F.explode(F.transform(F.sequence(F.lit(0), (F.size("runs") / 2 - 1).cast("int")), lambda i: F.struct(
            (F.col("place") + F.get("runs", (2 * i).cast("int"))).alias("a"), (F.col("place") + F.get("runs", (2 * i).cast("int")) + F.get("runs", (2 * i + 1).cast("int")) + LENGTH - 1).alias("b")
        ))).alias("span"),
    )
    gone = stage(spans.groupBy("doc_id", "mark").agg(F.collect_set("span").alias("spans")), "spans")
    joined = rows.join(gone.hint("shuffle_hash"), ["doc_id", "mark"], "left").select("id", "text", "spans")
    return joined.mapInArrow(_result, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, anchor, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = np.frombuffer(piece, dtype=np.uint8)
            at = np.arange(len(data) - LENGTH + 1)
            w = [range_hash(prefix_hash(d), at, at + LENGTH).view(np.int64) for d in (data, data ^ np.uint8(0x5A))]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.binary()), pa.array(np.full(len(at), anchor)), pa.array(at.astype(np.int32)), *(pa.array(x) for x in w)], names=["segment", "anchor", "place", "w1", "w2"])
