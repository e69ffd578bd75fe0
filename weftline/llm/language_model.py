"""LM scoring by masked pseudo-likelihood (operator 5): a bidirectional window network in numpy.

Tokens are words, and every word of the corpus is predicted. The network's vocabulary is the corpus's VOCABULARY most
frequent words, counted over every document, and OTHER hashed classes of all other words by their endings. The RADIUS
tokens on either side of the masked place each add a vector of theirs, one for each side and distance, to a hidden
layer, which predicts the token through a two-level softmax (class, then word in the class), so each token costs a few
thousand operations; a word outside the vocabulary has the chance of its hashed class times its share of that class's
words, from the table of all words.

Texts are read once, in chunks of about CHUNK words, each a row: its documents as numbers in the list of its distinct
words. The lists are cut into shards of all words by hash; a shard counts its words over all chunks and answers each
chunk with the counts of the words that it listed, so no row stands for a word. Chunks are then rewritten as network
tokens. Every chunk trains a copy of the network on all of its documents (Adagrad), and the copies are averaged by
tokens seen, ROUNDS times; what is gathered, words and copies, grows with the corpus.

Defined results: a null, empty or blank text has no tokens, log-likelihood 0 and null mean; repeated rows, and rows with
a null doc_id, each get a result; an empty table gives an empty result; extra columns are not read. Chunks follow the
order in which files are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import stage, tune

VOCABULARY, OTHER = 4032, 64
CLASSES = 64  # of CLASSES tokens each: VOCABULARY + OTHER = CLASSES ** 2
#: A word of the vocabulary is one of so many words of the corpus at least.
RADIUS, HIDDEN = 2, 32
ROUNDS = 1
#: Places that one step learns from, or that are scored at a time.
STEP = 1 << 14
RATE = 0.15
#: Rows from which on a group is summed by itself.
MANY = 32
#: Words of a chunk, about.
CHUNK = 1 << 20
#: Characters of text for each shard of the words.
SHARD_CHARS = 50_000_000
#: Steps in which counts are told apart, for each power of two.
LEVELS = 16
PAD = VOCABULARY + OTHER
SIDES = tuple(j for j in range(-RADIUS, RADIUS + 1) if j)
_PARTS = (("table", (PAD + 1, len(SIDES) * HIDDEN)), ("hidden0", (HIDDEN,)), ("head", (HIDDEN, CLASSES)), ("head0", (CLASSES,)), ("tail", (CLASSES, HIDDEN, CLASSES)), ("tail0", (CLASSES, CLASSES)))
_ONES = np.ones(CLASSES, dtype=np.float32)


def words(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def start(counts: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Small random weights, and biases that give the unigram distribution."""
    rng = np.random.default_rng(seed)
    net = {k: (rng.standard_normal(shape) * 0.1).astype(np.float32) for k, shape in _PARTS}
    p = (counts + 1.0) / (counts + 1.0).sum()
    by = p.reshape(CLASSES, CLASSES)
    net["hidden0"][:] = 0
    net["head0"] = np.log(by.sum(1)).astype(np.float32)
    net["tail0"] = np.log(by / by.sum(1, keepdims=True)).astype(np.float32)
    return net


def stream(docs: list[np.ndarray]) -> np.ndarray:
    """All tokens in a row, with RADIUS gaps before, between and after the documents."""
    gap = np.full(RADIUS, PAD, dtype=np.uint16)
    return np.concatenate([gap, *(x for d in docs for x in (d.astype(np.uint16), gap))])


def steps(flat: np.ndarray, most: int = STEP) -> list[np.ndarray]:
    """A stream in parts of `most` places, each with the RADIUS tokens on either side of it."""
    return [flat[max(0, i - RADIUS) : i + most + RADIUS] for i in range(RADIUS, len(flat) - RADIUS, most)]


def _chances(h: np.ndarray, w: np.ndarray, w0: np.ndarray, of: np.ndarray, all_: bool) -> tuple[np.ndarray, np.ndarray]:
    """(softmax of h w + w0, if all is asked for, log of the chance of `of` in each row)."""
    z = h @ w
    z += w0
    np.minimum(z, 60, out=z)
    np.exp(z, out=z)
    whole = z @ _ONES
    out = np.log(np.maximum(z[np.arange(len(of)), of] / whole, 1e-30))
    if all_:
        z /= whole[:, None]
    return z, out


def _descend(net: dict, name: str, at, slope: np.ndarray, rate: float) -> None:
    """One step down `slope` in net[name][at], shorter where slopes were steep before (Adagrad; the table has one memory a row)."""
    if "steep " + name not in net:
        net["steep " + name] = np.full((*net[name].shape[:1], 1) if name == "table" else net[name].shape, 1e-8, dtype=np.float32)
    steep = net["steep " + name]
    steep[at] += np.einsum("ij,ij->i", slope, slope)[:, None] / slope.shape[1] if name == "table" else slope * slope
    slope *= rate / np.sqrt(steep[at])
    net[name][at] -= slope


def _group_sums(rows: np.ndarray, by: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """np.add.reduceat(rows[by], firsts), several times faster: groups of over MANY rows one by one, of all others the first
    rows at once, then the second ones, and so on."""
    n = np.append(firsts[1:], len(by)) - firsts
    rank = np.argsort(-n, kind="stable")
    first, n = firsts[rank], n[rank]
    large = int(np.searchsorted(-n, -MANY))
    out = np.empty((len(firsts), rows.shape[1]), dtype=rows.dtype)
    for i in range(large):
        out[rank[i]] = np.take(rows, by[first[i] : first[i] + n[i]], axis=0).sum(0)
    first, n = first[large:], n[large:]
    total = np.take(rows, by[first], axis=0)
    for j in range(1, int(n[0]) if len(n) else 0):
        k = int(np.searchsorted(-n, -j))  # groups of more than j rows
        total[:k] += np.take(rows, by[first[:k] + j], axis=0)
    out[rank[large:]] = total
    return out


def log_chances(net: dict, part: np.ndarray, rate: float = 0.0) -> np.ndarray:
    """log P(token | both sides) at each place of a part of a stream, without its first and last RADIUS tokens and its gaps;
    with a rate, one step of gradient descent too. Places are taken class by class.

    A token adds a vector of the table to the hidden layer of each place that it stands beside, one for each side and distance."""
    inner = part[RADIUS : len(part) - RADIUS]
    at = np.flatnonzero(inner != PAD)
    n = len(at)
    if not n:
        return np.zeros(0, dtype=np.float32)
    at = at[np.argsort((inner[at] // CLASSES).astype(np.uint8), kind="stable")]
    group, member = (inner[at] // CLASSES).astype(np.int64), (inner[at] % CLASSES).astype(np.int64)
    beside = np.take(net["table"], part, axis=0)
    cut = lambda k: slice(RADIUS + SIDES[k], RADIUS + SIDES[k] + len(inner))
    col = lambda k: slice(k * HIDDEN, (k + 1) * HIDDEN)
    h = beside[cut(0), col(0)] + net["hidden0"]
    for k in range(1, len(SIDES)):
        h += beside[cut(k), col(k)]
    h = np.tanh(np.take(h, at, axis=0))
    head, out = _chances(h, net["head"], net["head0"], group, rate > 0)
    bounds = np.searchsorted(group, np.arange(CLASSES + 1)).tolist()
    dh = None
    if rate:
        head[np.arange(n), group] -= 1
        dh = head @ net["head"].T
    for c in range(CLASSES):
        a, b = bounds[c], bounds[c + 1]
        if a == b:
            continue
        hidden, mine = h[a:b], member[a:b]
        tail, log_p = _chances(hidden, net["tail"][c], net["tail0"][c], mine, rate > 0)
        out[a:b] += log_p
        if rate:
            tail[np.arange(b - a), mine] -= 1
            dh[a:b] += tail @ net["tail"][c].T
            _descend(net, "tail", c, hidden.T @ tail, rate)
            _descend(net, "tail0", c, tail.sum(0), rate)
    if rate:
        _descend(net, "head", ..., h.T @ head, rate)
        _descend(net, "head0", ..., head.sum(0), rate)
        dh *= 1 - h * h
        _descend(net, "hidden0", ..., dh.sum(0), rate)
        back = np.zeros((len(inner), HIDDEN), dtype=np.float32)
        back[at] = dh
        beside[: 2 * RADIUS], beside[-2 * RADIUS :] = 0, 0
        for k in range(len(SIDES)):
            beside[cut(k), col(k)] = back
        by = np.argsort(part, kind="stable")
        sorted_ = part[by]
        firsts = np.concatenate([[0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1])
        _descend(net, "table", sorted_[firsts], _group_sums(beside, by, firsts), rate)
    places = np.empty(len(inner), dtype=np.float32)
    places[at] = out
    return places[inner != PAD]


_CHUNK = "chunk long, shard int, first int, words binary, others binary, n binary, doc_ids array<long>, sizes binary, ids binary"
_CHUNK_TYPES = (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 3, pa.list_(pa.int64()), *[pa.binary()] * 2)


def _rows(rows: list[tuple], names: list[str], types: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _names(shape: str) -> list[str]:
    return [x.split()[0] for x in shape.split(", ")]


def _read(shards: int):
    """A row of each chunk: words and others of its list, doc_ids, sizes and ids of its documents; and a row of each shard of the list, from its place `first` on."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        chunk = TaskContext.get().partitionId() << 32
        places: dict[str, int] = defaultdict(count().__next__)  # numbered as they come
        ids, docs, size = [], [], 0

        def done(places: dict[str, int]) -> pa.RecordBatch:
            word = np.array([xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in places], dtype="<u8")
            other = np.array([_other(w) - VOCABULARY for w in places], dtype="u1")
            flat = np.concatenate(docs) if size else np.zeros(0, dtype="<u4")
            n = np.bincount(flat, minlength=len(places)).astype("<u4")
            shard = (word >> np.uint64(32)) % np.uint64(shards)
            order = np.argsort(shard, kind="stable")
            place = np.empty(len(order), dtype="<u4")
            place[order] = np.arange(len(order))
            word, other, n, shard = word[order], other[order], n[order], shard[order]
            rows = [(chunk, None, None, word.tobytes(), other.tobytes(), None, ids, np.array([len(d) for d in docs], dtype="<u4").tobytes(), _squeezed(place[flat]))]
            edge = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1), len(shard)] if len(shard) else [0]
            rows += [(chunk, int(shard[x]), int(x), word[x:y].tobytes(), other[x:y].tobytes(), n[x:y].tobytes(), None, None, None) for x, y in zip(edge[:-1], edge[1:], strict=True)]
            return _rows(rows, _names(_CHUNK), _CHUNK_TYPES)

        for batch in batches:
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(d)
                docs.append(np.fromiter(map(places.__getitem__, words(text)), dtype="<u4"))
                size += len(docs[-1])
                if size >= CHUNK:
                    yield done(places)
                    chunk, size = chunk + 1, 0
                    places = defaultdict(count().__next__)
                    ids, docs = [], []
        if ids:
            yield done(places)

    return over


def _squeezed(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(x.tobytes(), 1)


def _loose(x: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(x), dtype=kind)


_COUNTED = "chunk long, first int, logs binary, words binary, others binary, n binary"


def _counted(key: tuple, table: pa.Table) -> pa.Table:
    """The logarithms of the counts of each chunk's words in this shard, and a row of all the shard's words with others and counts."""
    lists = [np.frombuffer(x, dtype="<u8") for x in table.column("words").to_pylist()]
    flat = np.concatenate(lists)
    kinds, first, which = np.unique(flat, return_index=True, return_inverse=True)
    n = np.bincount(which, np.frombuffer(b"".join(table.column("n").to_pylist()), dtype="<u4"), minlength=len(kinds)).astype("<i8")
    other = np.frombuffer(b"".join(table.column("others").to_pylist()), dtype="u1")[first]
    ends = np.cumsum([len(x) for x in lists])
    logs = np.log(n).astype("<f4")[which]
    rows = [(c, f, logs[e - len(x) : e].tobytes(), None, None, None) for c, f, x, e in zip(table.column("chunk").to_pylist(), table.column("first").to_pylist(), lists, ends, strict=True)]
    rows.append((None, None, None, kinds.tobytes(), other.tobytes(), n.tobytes()))
    return pa.Table.from_batches([_rows(rows, _names(_COUNTED), (pa.int64(), pa.int32(), *[pa.binary()] * 4))])


def _level(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(n) * LEVELS).astype(np.int32)


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind 0, level, words of that level) and (kind 1, class, tokens of that class)."""
    for batch in batches:
        for other, n in zip(batch.column("others").to_pylist(), batch.column("n").to_pylist(), strict=True):
            n = np.frombuffer(n, dtype="<i8")
            level, words_ = np.unique(_level(n), return_counts=True)
            tokens = np.bincount(np.frombuffer(other, dtype="u1"), n, minlength=OTHER)
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(level) + [1] * OTHER, pa.int32()), pa.array([*level.tolist(), *range(OTHER)], pa.int32()), pa.array([*words_.tolist(), *tokens.astype(np.int64).tolist()], pa.int64())], names=["kind", "of", "n"])


def _common(least: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, other, n in zip(*(batch.column(c).to_pylist() for c in ("words", "others", "n")), strict=True):
                n = np.frombuffer(n, dtype="<i8")
                at = np.flatnonzero(_level(n) >= least)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(word, dtype="<i8")[at]), pa.array(np.frombuffer(other, dtype="u1")[at].astype(np.int32)), pa.array(n[at])], names=["word", "other", "n"])

    return over


def _packed(net: dict) -> bytes:
    return b"".join(net[k].astype("<f4").tobytes() for k, _ in _PARTS)


def _unpacked(data: bytes | np.ndarray) -> dict[str, np.ndarray]:
    flat, at, net = np.frombuffer(data, dtype="<f4") if isinstance(data, bytes) else data, 0, {}
    for k, shape in _PARTS:
        n = int(np.prod(shape))
        net[k] = flat[at : at + n].reshape(shape).astype(np.float32)
        at += n
    return net


def _other(word: str) -> int:
    from xxhash import xxh32_intdigest

    return VOCABULARY + xxh32_intdigest(word[-2:].encode("utf-8", "surrogatepass")) % OTHER


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[list, list[np.ndarray], np.ndarray]]:
    """(doc_ids, tokens of each, rare) of each chunk."""
    for ids, sizes, tokens, rare in zip(*(batch.column(c).to_pylist() for c in ("doc_ids", "sizes", "tokens", "rare")), strict=True):
        yield ids, np.split(np.frombuffer(tokens, dtype="<u2"), np.cumsum(np.frombuffer(sizes, dtype="<u4"))[:-1]), np.frombuffer(rare, dtype="<f8")


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood)."""
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    read = stage(rows.mapInArrow(_read(1 + chars // SHARD_CHARS), _CHUNK), "read")
    counted = stage(read.where("shard is not null").groupBy("shard").applyInArrow(_counted, _COUNTED), "words")
    kinds = counted.where("chunk is null")
    shares = kinds.mapInArrow(_shares, "kind int, of int, n long").groupBy("kind", "of").agg(F.sum("n").alias("n")).collect()  # a row of each level and class
    of_class = np.zeros(OTHER)  # how many tokens each class has outside the vocabulary
    for r in shares:
        if r["kind"]:
            of_class[r["of"]] = r["n"]
    least, so_far = 0, 0
    for r in sorted((r for r in shares if not r["kind"]), key=lambda r: -r["of"]):
        least, so_far = r["of"], so_far + r["n"]
        if so_far >= VOCABULARY:  # no word below this level can be in the vocabulary
            break
    top = kinds.mapInArrow(_common(least), "word long, other int, n long").orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()
    frequency = np.zeros(PAD)
    frequency[: len(top)] = [r["n"] for r in top]
    for r in top:
        of_class[r["other"]] -= r["n"]
    frequency[VOCABULARY:] = of_class
    by_word = sorted((r["word"], i) for i, r in enumerate(top))
    # VOCABULARY words at most, and one that ends the search and is never taken for a word
    vocabulary = np.array([*(w for w, _ in by_word), 0], dtype=np.int64), np.array([*(i for _, i in by_word), 0], dtype=np.uint16)

    def coded(texts: pa.Table, answers: pa.Table) -> pa.Table:
        """A chunk's documents as network tokens, and the log shares of their other words in their classes."""
        out = []
        for word, other, ids, sizes, places in zip(*(texts.column(c).to_pylist() for c in ("words", "others", "doc_ids", "sizes", "ids")), strict=True):
            word, other = np.frombuffer(word, dtype="<i8"), np.frombuffer(other, dtype="u1")
            logs = np.frombuffer(b"".join(answers.sort_by("first").column("logs").to_pylist()), dtype="<f4")
            at = np.searchsorted(vocabulary[0][:-1], word)
            known = (vocabulary[0][at] == word) & (at < len(vocabulary[0]) - 1)
            token = np.where(known, vocabulary[1][at], VOCABULARY + other.astype(np.uint16)).astype("<u2")
            share = np.where(known, 0.0, logs - np.log(np.maximum(of_class, 1))[other])
            flat, sizes_ = _loose(places, "<u4"), np.frombuffer(sizes, dtype="<u4")
            rare = np.bincount(np.repeat(np.arange(len(sizes_)), sizes_), share[flat], minlength=len(sizes_))
            out.append((ids, sizes, token[flat].tobytes(), rare.astype("<f8").tobytes()))
        return pa.Table.from_batches([_rows(out, ["doc_ids", "sizes", "tokens", "rare"], (pa.list_(pa.int64()), *[pa.binary()] * 3))])

    texts = read.where("shard is null").select("chunk", "words", "others", "doc_ids", "sizes", "ids")
    answers = counted.where("chunk is not null").select(F.col("chunk").alias("of"), "first", "logs")
    chunks = stage(texts.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(coded, "doc_ids array<long>, sizes binary, tokens binary, rare binary"), "coded")

    def learner(shared):
        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, texts, _ in _documents(batch):
                    mine, n = _unpacked(shared.value), sum(map(len, texts))
                    parts = steps(stream(texts))
                    for i in np.random.default_rng(1).permutation(len(parts)):
                        log_chances(mine, parts[i], RATE)
                    if n:
                        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([_packed(mine)], pa.binary())], names=["n", "net"])

        return learn

    net = start(frequency)
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(_packed(net))  # of fixed size
        net = _averaged(chunks.mapInArrow(learner(shared), "n long, net binary"), net)
    shared = spark.sparkContext.broadcast(_packed(net))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = _unpacked(shared.value)
        for batch in batches:
            for ids, texts, sums in _documents(batch):
                n = np.array([len(t) for t in texts])
                if n.sum():
                    found = np.concatenate([log_chances(mine, part) for part in steps(stream(texts))])
                    sums = sums + np.bincount(np.repeat(np.arange(len(texts)), n), found.astype(np.float64), minlength=len(texts))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(sums), pa.array([s / k if k else None for s, k in zip(sums, n, strict=True)], pa.float64())], names=["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"])

    return chunks.mapInArrow(over, "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double")


def _averaged(copies: DataFrame, net: dict) -> dict:
    """The copies' mean, weighed by tokens seen: summed a row at a time in each task, then over the tasks' sums."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            for k, data in zip(batch.column("n").to_pylist(), batch.column("net").to_pylist(), strict=True):
                x = np.frombuffer(data, dtype="<f4") * np.float64(k)
                n, total = n + k, x if total is None else total + x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([(total / n).astype("<f4").tobytes()], pa.binary())], names=["n", "net"])

    level = stage(copies.select("n", "net").mapInArrow(summed, "n long, net binary"), "copies")
    while (parts := level.count()) > 8:
        level = stage(level.repartition(-(-parts // 8)).mapInArrow(summed, "n long, net binary"), "copies")
    rows = sorted((r["n"], bytes(r["net"])) for r in level.collect())
    total = sum(n for n, _ in rows)
    if not total:
        return net
    return _unpacked(sum(np.frombuffer(data, dtype="<f4") * np.float64(n) for n, data in rows) / total)
