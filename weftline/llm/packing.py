"""Mixture-controlled packing (operator 7): deficit round-robin over source queues fills windows of `width` tokens.

Documents are tokenised once and staged as 16-bit ids. Each source, however many there are, is a queue in the order in
which tasks read its documents; a document's place in it comes from two-level prefix sums. A queue of t of all T tokens
has served (t * x + phase) div T of them where x tokens of the mixture are due; its phase, below T, comes from the hash
of its source, so that small sources don't all serve in the same block. Queues are cut by that form into blocks of about
`windows` windows. Where a block begins in the packed stream is the sum of what all queues have served before; nothing
of it passes through the driver. Inside a block a deficit round-robin credits every source with its share of each
window, and the deficits at the end of a block are those with which the next one begins, so the proportions hold in
every window, also in one that two blocks share. All queues end together and only the very last window is padded. No
queue is ever gathered in one task.

Defined results: a null text is an empty document, which is its end token alone; a null source is a queue of its own;
repeated rows are packed as often as they come; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import lean, stage, tune

WIDTH, END = 2048, 1
#: Windows of a block.
WINDOWS = 256
#: Blocks whose starts one row is exploded into.
RANGE = 10_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: White space on which regular expression engines differ, and control characters: such texts go to the tokenizers library.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text to ids as the tokenizers library gives them.

    A byte-level BPE vocabulary whose ids are its merge ranks is read into tiktoken, which gives the same ids several
    times faster; texts that hold a special token or odd white space, and other kinds of vocabulary, are left to tokenizers."""
    import tiktoken
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    spec = json.loads(plain.to_str())
    if plain.get_vocab_size() > 1 << 16:
        raise ValueError("ids of this vocabulary need more than 16 bits")
    slow = lambda t: np.array(plain.encode(t, add_special_tokens=False).ids, dtype="<u2")
    pre = spec.get("pre_tokenizer") or {}
    special = [x["content"] for x in spec.get("added_tokens", [])]
    if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
        return slow
    # Byte-level vocabularies write each byte as a printable character: printable ones as themselves, others from U+0100 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(sorted(set(range(256)) - set(shown)))}
    ranks = {bytes(byte[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
    merged = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
    if any(ranks.get(bytes(byte[c] for c in m.replace(" ", "", 1))) != 256 + i for i, m in enumerate(merged)):
        return slow
    # Fixed value: the word pattern of byte-level pre-tokenisation.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(t: str) -> np.ndarray:
        if _ODD.search(t) or any(x in t for x in special):
            return slow(t)
        return fast.encode_to_numpy(t, disallowed_special=()).astype("<u2")

    return encode


def tokenised(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", source: str = "source", end: int = END) -> DataFrame:
    """(doc_id, queue, part, within, n, ids): the ids, with the end token, as little-endian 16-bit numbers; within is the
    number of tokens that the same queue has before in the same part, a part being what one task reads."""
    tune(docs.sparkSession)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path), TaskContext.get().partitionId()
        so_far: dict[int, int] = {}
        last = np.array([end], dtype="<u2").tobytes()
        for batch in batches:
            found = [encode(x).tobytes() + last if x else last for x in batch.column(2).to_pylist()]
            n, within = [len(x) // 2 for x in found], []
            for q, k in zip(batch.column(1).to_pylist(), n, strict=True):
                within.append(so_far.get(q, 0))
                so_far[q] = within[-1] + k
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([part] * len(n), pa.int64()), pa.array(within, pa.int64()), pa.array(n, pa.int64()), pa.array(found, pa.binary())],
                names=["doc_id", "queue", "part", "within", "n", "ids"],
            )

    queue = F.xxhash64(F.col(source).cast("string"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), queue.alias("queue"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lean(over), "doc_id long, queue long, part long, within long, n long, ids binary")


def granted(order: np.ndarray, most: np.ndarray, need: int) -> np.ndarray:
    """need tokens, given in this order, to each at most so many."""
    out, most = np.zeros(len(order), dtype=np.int64), most[order]
    out[order] = np.clip(need - (np.cumsum(most) - most), 0, most)
    return out


def quotas(take: np.ndarray, width: int, first: int | None = None, share: np.ndarray | None = None, deficit: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Deficit round-robin: in each window every queue is credited with its quantum and served whole tokens of it; what
    the window still lacks goes to the largest deficits, which fall below zero and are carried on. `first` is the room of
    the first window, `share` the queues' part of the mixture, `deficit` what was carried so far."""
    left, deficit = take.copy(), np.zeros(len(take)) if deficit is None else deficit.copy()
    share, room = take / max(1, take.sum()) if share is None else share, first or width
    while left.sum():
        room = min(room, int(left.sum()))
        deficit += share * room
        serve = np.minimum(np.maximum(np.floor(deficit), 0).astype(np.int64), left)
        lack = room - int(serve.sum())
        if lack < 0:
            serve -= granted(np.argsort(deficit - serve, kind="stable"), serve, -lack)
        elif lack:
            serve += granted(np.argsort(-(deficit - serve), kind="stable"), np.minimum(left - serve, 1), lack)
            serve += granted(np.argsort(-left, kind="stable"), left - serve, room - int(serve.sum()))
        deficit -= serve
        left -= serve
        room = width
        yield serve


def starts(totals: DataFrame, whole: int, block: int) -> DataFrame:
    """(block, first): where each block begins in the packed stream, from totals(queue, total)."""
    count = -(-whole // block)
    ranges = totals.select("queue", "total", F.explode(F.sequence(F.lit(0), F.lit((count - 1) // RANGE))).alias("r")).repartition("queue", "r")
    each = F.explode(F.sequence(F.col("r").cast("long") * RANGE, F.least((F.col("r").cast("long") + 1) * RANGE, F.lit(count)) - 1))
    # Products of two token counts need more than 64 bits.
    due = F.expr(f"(cast(total AS decimal(18, 0)) * cast(block * {block} AS decimal(18, 0)) + cast(pmod(queue, {whole}L) AS decimal(18, 0))) div cast({whole} AS decimal(18, 0))")
    return ranges.select("queue", "total", each.alias("block")).groupBy("block").agg(F.sum(due).alias("first"))


def pack(docs: DataFrame, path: str | None = None, width: int = WIDTH, windows: int = WINDOWS) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (16-bit), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    tokens = stage(tokenised(docs, path or tokenizer_path()), "tokens")
    sums = stage(tokens.groupBy("queue", "part").agg(F.sum("n").alias("tokens")), "sums")
    block, whole = width * windows, sums.agg(F.sum("tokens")).first()[0] or 0

    # The start of each part in its queue, then of each document.
    queue = Window.partitionBy("queue")
    before = sums.select("queue", "part", (F.sum("tokens").over(queue.orderBy("part")) - F.col("tokens")).alias("before"), F.sum("tokens").over(queue).alias("total"))
    placed = tokens.join(before, ["queue", "part"]).select("doc_id", "queue", "total", "n", "ids", (F.col("before") + F.col("within")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cuts each document where a block ends in its queue."""
        names = ("block", "doc_id", "queue", "total", "at", "start", "n", "doc_tokens", "ids")
        for batch in batches:
            rows = {k: [] for k in names}
            for d, q, t, n, ids, a in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "queue", "total", "n", "ids", "at")), strict=True):
                phase, start = q % whole, 0
                while start < n:
                    b = max(0, -(((a + start + 1) * whole - phase) // -(t * block)) - 1)  # the first one that serves this token
                    end = min(n, (t * min(whole, (b + 1) * block) + phase) // whole - a)
                    for k, v in zip(names, (b, d, q, t, a + start, start, end - start, n, ids[2 * start : 2 * end]), strict=True):
                        rows[k].append(v)
                    start = end
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in rows.items()], names=list(names))

    def fill(key: tuple, table: pa.Table, begins: pa.Table) -> pa.Table:
        out = {k: [] for k in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
        b, at = int(key[0].as_py()), begins.column("first").to_pylist()[0]
        table = table.sort_by([("queue", "ascending"), ("at", "ascending")])
        t = {c: table.column(c).to_pylist() for c in ("doc_id", "start", "n", "ids", "doc_tokens")}
        lengths, total, served = (table.column(c).to_numpy() for c in ("n", "total", "at"))
        _, nexts = np.unique(table.column("queue").to_numpy(), return_index=True)
        take = np.add.reduceat(lengths, nexts) if len(nexts) else np.zeros(0, dtype=np.int64)
        share = total[nexts] / whole
        # What each queue was due before this block, less what it has served.
        carried = np.array([(int(x) * b * block - int(y) * whole) / whole for x, y in zip(total[nexts], served[nexts], strict=True)])
        inside = np.zeros(len(take), dtype=np.int64)
        for serve in quotas(take, width, width - at % width, share, carried):
            for q in np.flatnonzero(serve):
                need = int(serve[q])
                while need:
                    i, s = int(nexts[q]), int(inside[q])
                    n = min(need, t["n"][i] - s)
                    for k, v in zip(out, (t["doc_id"][i], t["start"][i] + s, n, t["ids"][i][2 * s : 2 * (s + n)], t["doc_tokens"][i], at // width, at % width), strict=True):
                        out[k].append(v)
                    at, need = at + n, need - n
                    inside[q] += n
                    if inside[q] == t["n"][i]:
                        inside[q], nexts[q] = 0, i + 1
        return pa.table({k: pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()})

    shape = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    if not whole:
        return spark.createDataFrame([], shape)
    pieces = placed.mapInArrow(lean(cut), "block long, doc_id long, queue long, total long, at long, start long, n long, doc_tokens long, ids binary")
    begins = starts(sums.groupBy("queue").agg(F.sum("tokens").alias("total")), whole, block)
    return pieces.groupBy("block").cogroup(begins.groupBy("block")).applyInArrow(fill, shape)


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with ids_crc32, of the ids as little-endian unsigned 32-bit numbers, in place of ids."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            ends = np.frombuffer(ids.buffers()[1], dtype=np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
            wide = memoryview(np.frombuffer(ids.buffers()[2], dtype="<u2", count=(ends[-1] - ends[0]) // 2, offset=int(ends[0])).astype("<u4").tobytes()) if ends[-1] > ends[0] else memoryview(b"")
            at = (2 * (ends - ends[0])).tolist()
            crc = [zlib.crc32(wide[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "length")), pa.array(crc, pa.int64()), *(batch.column(c) for c in ("doc_tokens", "sequence_id", "offset"))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return pieces.mapInArrow(lean(over), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
