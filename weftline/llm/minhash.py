"""MinHash near-dedup (operator 2): circulant signatures, banding, exact Jaccard verification, connected components.

One permutation scatters a document's shingles over a circle of 2**32 places, a second one, shifted by one place for
each coordinate, ranks them; the lowest rank of each shift is a signature coordinate. Bands of four coordinates make
candidate buckets. Every bucket's documents are compared with its smallest one (a star, not all pairs); documents
that this leaves outside the bucket's component are compared, in blocks, with all the bucket's documents of other
components. Each comparison is on the full shingle sets.

Defined results: a document with null or blank text has no shingles and stays alone; one of fewer than k words has its
whole word sequence as its only shingle; equal texts share a component; ties go to the smaller doc_id; rows with a
null doc_id are ignored, repeated doc_ids count as one document with the union of their shingles' links; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import encoded, held, lean, shingle_sets, sliced, stage, tune

ROWS, BANDS = 4, 28
#: Documents of a block in which sets are compared.
BLOCK = 256


def _rank(x: np.ndarray, t: np.ndarray) -> None:
    """The second permutation: a bijection on uint32, in place; t is scratch."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B), (16, None)):
        np.right_shift(x, np.uint32(shift), out=t)
        np.bitwise_xor(x, t, out=x)
        if factor:
            np.multiply(x, np.uint32(factor), out=x)


def signatures(sets: list[np.ndarray], coordinates: int = ROWS * BANDS) -> np.ndarray:
    """A row of uint32 coordinates for each set, none of them empty."""
    out = np.empty((len(sets), coordinates), dtype=np.uint32)
    start = 0
    while start < len(sets):
        end, size = start, 0
        while end < len(sets) and (end == start or size + len(sets[end]) <= 1 << 15):
            size += len(sets[end])
            end += 1
        flat = np.concatenate(sets[start:end])
        places = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)  # the first permutation: shingle hashes are mixed already
        firsts = np.cumsum([0, *(len(s) for s in sets[start : end - 1])])
        x, t = np.empty_like(places), np.empty_like(places)
        for k in range(coordinates):
            np.add(places, np.uint32(k), out=x)
            _rank(x, t)
            out[start:end, k] = np.minimum.reduceat(x, firsts)
        start = end
    return out


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    n, k = signature.shape
    parts = signature.reshape(n, k // rows, rows).astype(np.uint64)
    out = np.broadcast_to(np.arange(k // rows, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (n, k // rows)).copy()
    for j in range(rows):
        out = (out ^ parts[:, :, j]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def _signed(k: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), encoded(batch.column(1).to_pylist())
            for a, b in sliced(texts, 1 << 22):
                sets = list(shingle_sets(texts[a:b], k))
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = np.zeros((len(sets), BANDS), dtype=np.uint64)
                if full:
                    keys[full] = band_keys(signatures([sets[i] for i in full]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[a:b], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "class", "bands"],
                )

    return over


def _sets(k: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), encoded(batch.column(1).to_pylist())
            for a, b in sliced(texts, 1 << 22):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), pa.array([s.tobytes() for s in shingle_sets(texts[a:b], k)], pa.binary())], names=["rep", "shingles"])

    return over


def _linked(percent: int):
    """Compares, in each group, the sets of side 0 with those of side 1 and gives the pairs that link.

    A pair of which both carry bands is compared only in the first band that they share."""

    def over(key: tuple, table: pa.Table) -> pa.Table:
        rep, side = table.column("rep").to_numpy(), table.column("side").to_numpy()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("shingles").to_pylist()]
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found: list[tuple[int, int]] = []
        if len(a) and len(b):
            universe = np.unique(np.concatenate([sets[i] for i in a]))
            lengths = np.array([len(sets[i]) for i in b])
            flat = np.concatenate([sets[i] for i in b])
            place = np.searchsorted(universe, flat)
            place[place == len(universe)] = 0
            place[universe[place] != flat] = len(universe)
            firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            comp = table.column("comp").to_numpy()
            bands = np.array(table.column("bands").to_pylist(), dtype=np.int64) if "bands" in table.column_names else None
            mine = int(key[1]) if bands is not None else 0
            for i in a:
                these = comp[b] != comp[i]
                if bands is not None and these.any():
                    these &= (bands[b] == bands[i]).argmax(axis=1) == mine
                n = len(sets[i])
                these &= (100 * np.minimum(n, lengths) >= percent * np.maximum(n, lengths)) & (rep[b] != rep[i])
                if not these.any():
                    continue
                mark = np.zeros(len(universe) + 1, dtype=np.int32)
                mark[np.searchsorted(universe, sets[i])] = 1
                both = np.add.reduceat(mark[place], firsts)
                these &= 100 * both >= percent * (n + lengths - both)
                found += [(int(rep[i]), int(rep[j])) for j in b[these]]
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return over


def components(nodes: DataFrame, links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """nodes(rep), links(a, b) -> (rep, comp), comp being the smallest rep reachable.

    Each round takes the least label among the neighbours and then the label of that label; the number of rounds grows
    with the logarithm of the longest chain. Links and labels stay distributed; only a count of changes is collected."""
    both = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    linked = both.groupBy(F.col("a").alias("rep")).agg(F.least(F.col("rep"), F.min("b")).alias("comp"))
    labels = stage(linked, "labels")
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.min("comp").alias("near"))
        low = labels.join(near, "rep").select("rep", F.least("comp", "near").alias("low"), "comp")
        jump = labels.select(F.col("rep").alias("low"), F.col("comp").alias("next"))
        after = stage(low.join(jump, "low", "left").select("rep", F.least("low", F.coalesce("next", "low")).alias("comp"), F.col("comp").alias("was")), "labels")
        labels = after.select("rep", "comp")
        if not after.where("comp <> was").limit(1).count():
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return nodes.join(labels, "rep", "left").select("rep", F.coalesce("comp", "rep").alias("comp"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 5, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents with 100 * intersection >= percent * union of their k-word shingle sets are linked.

    Recall of the candidate search at similarity 0.85: a link is missed with probability (1 - 0.85**4)**28 < 2e-9; at 0.8 < 5e-7."""
    spark = docs.sparkSession
    tune(spark)
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = stage(rows.mapInArrow(lean(_signed(k)), "doc_id long, n_shingles long, class binary, bands array<long>"), "signed")
    classes = signed.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"))
    classes = stage(classes, "classes")

    # Buckets of two classes or more, and in each the smallest class as the centre of a star.
    bucketed = classes.select("rep", F.posexplode("bands").alias("band", "bucket"))
    centred = bucketed.groupBy("bucket", "band").agg(F.min("rep").alias("centre"), F.count("*").alias("n")).where("n > 1")
    member = stage(bucketed.join(centred, ["bucket", "band"]), "buckets")
    pairs = stage(member.where("rep <> centre").select("rep", "centre").distinct(), "pairs")

    # The sets of the classes that any pair names, once.
    named = member.select(F.col("rep").alias("doc_id")).distinct()
    sets = stage(rows.join(named.hint("shuffle_hash"), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text").mapInArrow(lean(_sets(k)), "rep long, shingles binary"), "sets")

    sized = pairs.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("salts"))
    spread = pairs.join(sized, "centre").select("rep", "centre", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int").alias("salt"))
    hub = sized.select(F.col("centre").alias("rep"), "centre", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    sides = spread.select("rep", "centre", "salt", F.lit(1).alias("side")).unionByName(hub.select("rep", "centre", "salt", F.lit(0).alias("side")))
    tested = sides.join(sets, "rep").withColumn("comp", F.col("rep")).groupBy("centre", "salt").applyInArrow(_linked(percent), "a long, b long")
    star = stage(tested, "star")
    nodes = classes.select("rep")
    labels = stage(components(nodes, star), "stars")

    # What the stars left apart: each such class against all classes of its buckets, in blocks.
    placed = member.join(labels, "rep").join(labels.select(F.col("rep").alias("centre"), F.col("comp").alias("of")), "centre")
    apart = placed.where("comp <> of")
    lone = apart.groupBy("bucket", "band").agg(F.count("*").alias("apart")).where("apart > 0")
    open_ = placed.join(lone, ["bucket", "band"]).where("n > 2")
    blocks = open_.select(
        "bucket", "band", "rep", "comp", (F.col("comp") != F.col("of")).alias("out"),
        F.ceil(F.col("apart") / BLOCK).cast("int").alias("rows"), F.ceil(F.col("n") / BLOCK).cast("int").alias("cols"),
    )
    row = F.pmod(F.xxhash64("rep"), F.col("rows")).cast("int")
    col = F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("cols")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = blocks.where("out").select("bucket", "band", "rep", "comp", row.alias("r"), every("cols").alias("c"), F.lit(0).alias("side"))
    asked = blocks.select("bucket", "band", "rep", "comp", every("rows").alias("r"), col.alias("c"), F.lit(1).alias("side"))
    more = stage(
        asking.unionByName(asked).join(sets, "rep").join(classes.select("rep", "bands"), "rep")
        .groupBy("bucket", "band", "r", "c").applyInArrow(_linked(percent), "a long, b long"),
        "more",
    )
    if more.limit(1).count():
        labels = stage(components(nodes, star.unionByName(more)), "components")

    known = classes.join(labels, "rep").select("class", F.col("comp").alias("least"))
    return signed.join(known, "class", "left").groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("least").alias("least")).select(
        "doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), (F.coalesce("least", "doc_id") == F.col("doc_id")).alias("kept")
    )


def keep_first(docs: DataFrame, percent: int = 85, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that are the first of their near-duplicate component, with all their columns.

    A document is a doc_id with a text: rows that share a doc_id but not the text are compared and kept apart, equal rows
    stay or go together. The first is the one of least doc_id; documents with a null, negative or very large doc_id
    (2**42 or more) come after all others, in the order of a hash."""
    i, t = F.col(doc_id).cast("long"), F.col(text).cast("string")
    low = (1 << 20) - 1
    packed = F.shiftleft(i, 20) + F.xxhash64(t).bitwiseAND(F.lit(low))
    beyond = F.lit(1 << 62) + F.xxhash64(i, t).bitwiseAND(F.lit((1 << 62) - 1))
    rows = held(docs, key=F.when(i.between(0, (1 << 42) - 1), packed).otherwise(beyond), text=t)
    kept = near_duplicates(rows.select(F.col("key").alias("doc_id"), "text"), percent=percent).where("kept").select(F.col("doc_id").alias("key"))
    return rows.join(kept.hint("shuffle_hash"), "key", "left_semi").select("row.*")
