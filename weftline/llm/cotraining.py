"""Quality classifier by co-training (operator 3).

Two views of a document that share no input: its text's content (character classes, word shapes and hashed word
frequencies) and its page's metadata (source, language and stated size, columns of the table; nothing is read from the
text). A logistic model of each view is fitted on labelled documents (a hash-chosen sample of TRAIN_ROWS at most). In
each round both are calibrated on labelled rows that no fit sees (Platt); either picks, among all documents without
label, the ones it is surest of, in proportion to the labels and with a calibrated probability of CONFIDENT at least,
and hands them to the other. A view that can't tell the classes apart so hands over nothing. At the end the mean of the
views' log-odds, weighed by their held-out log loss, scores every document.

Defined results: null or empty text has zero features and is scored by its prior and metadata; null metadata is a value
of its own; documents of one class only, or none, score that class's smoothed share; of several labels of a document the
lowest counts; repeated rows are each scored, and a document without doc_id is scored but never handed over; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import encoded, sliced, stage, tune, word_hashes

TRAIN_ROWS, ROUNDS, EXCHANGE, CONFIDENT = 20_000, 3, 400, 0.95
HASHED, SOURCES, LANGS = 256, 64, 16
META = SOURCES + LANGS + 2
_SHAPE = 16


def content(texts: list[bytes]) -> np.ndarray:
    """A row of content features for each text, in [0, 1] or logarithms."""
    out = np.zeros((len(texts), _SHAPE + HASHED), dtype=np.float32)
    for a, b in sliced(texts):
        words, first = word_hashes(texts[a:b])
        for r, (t, i, j) in enumerate(zip(texts[a:b], first[:-1], first[1:], strict=True), a):
            n, size = int(j - i), len(t)
            if not n:
                continue
            x = np.bincount(np.frombuffer(t, dtype=np.uint8), minlength=256)
            w = words[i:j]
            kinds, counts = np.unique(w, return_counts=True)
            classes = [x[65:91].sum(), x[97:123].sum(), x[48:58].sum(), x[128:].sum(), x[[33, 63]].sum(), x[[44, 46, 59, 58]].sum(), x[[35, 36, 37, 38, 42, 60, 62, 124]].sum(), x[10], x[32]]
            out[r, :9] = np.array(classes) / size
            out[r, 9:_SHAPE] = [len(kinds) / n, counts.max() / n, (w[1:] == w[:-1]).mean() if n > 1 else 0, np.log1p(n) / 10, min(1, size / n / 20), (counts == 1).sum() / n, np.square(counts / n).sum()]
            out[r, _SHAPE:] = np.bincount((w % np.uint64(HASHED)).astype(np.int64), minlength=HASHED) / n
    return out


def metadata(rows: Iterable[tuple]) -> np.ndarray:
    """Source and language hashed to places, the logarithm of the stated size and whether one is stated."""
    from xxhash import xxh32_intdigest

    rows = list(rows)
    out = np.zeros((len(rows), META), dtype=np.float32)
    for r, (source, lang, size) in enumerate(rows):
        out[r, xxh32_intdigest(f"s{source}") % SOURCES] = 1
        out[r, SOURCES + xxh32_intdigest(f"l{lang}") % LANGS] = 1
        out[r, -2:] = np.log1p(max(0, size or 0)) / 12, size is not None
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, raw, *record = (c.to_pylist() for c in batch.columns)
        views = content(encoded(raw)), metadata(zip(*record, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([x.tobytes() for x in v.astype("<f4")], pa.binary()) for v in views)], names=["doc_id", "content", "meta"])


class Logistic:
    """Ridge logistic regression by Newton's method, with classes weighed evenly, and Platt calibration."""

    def __init__(self, ridge: float = 1e-2) -> None:
        self.ridge, self.w, self.mean, self.scale, self.platt, self.loss = ridge, None, 0.0, 1.0, (1.0, 0.0), 1.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        x = x.astype(np.float64)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        weigh = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
        self.w = np.zeros(z.shape[1])
        for _ in range(15):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            h = (z * (weigh * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + self.ridge * np.eye(len(self.w))
            self.w -= np.linalg.solve(h, z.T @ (weigh * (p - y)) + self.ridge * self.w)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1], -30, 30)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        a, b, s = 1.0, 0.0, self.raw(x)
        z = np.stack([s, np.ones_like(s)], 1)
        target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        v = np.array([a, b])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
            v -= np.linalg.solve((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + 1e-6 * np.eye(2), z.T @ (p - target))
        self.platt = (float(v[0]), float(v[1]))
        p = self.chance(x)
        self.loss = float(-np.mean(target * np.log(p) + (1 - target) * np.log(1 - p)))

    def chance(self, x: np.ndarray) -> np.ndarray:
        return np.clip(1 / (1 + np.exp(-np.clip(self.platt[0] * self.raw(x) + self.platt[1], -30, 30))), 1e-9, 1 - 1e-9)


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f4").reshape(-1, width)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS, rounds: int = ROUNDS, exchange: int = EXCHANGE) -> DataFrame:
    """(doc_id, p_content, p_meta, score, predicted) of every document."""
    spark = docs.sparkSession
    tune(spark)
    shape = "doc_id long, content binary, meta binary"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"))
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("y"))
    all_ = stage(rows.mapInArrow(_features, shape).join(known.hint("shuffle_hash"), "doc_id", "left"), "features")
    n_known = all_.where("y is not null").count()
    sample = all_.where(F.col("y").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n_known))) < train_rows)).toArrow()
    ids, y = sample.column("doc_id").to_numpy(), sample.column("y").to_numpy().astype(np.float64)
    views = {"content": _matrix(sample.column("content"), _SHAPE + HASHED), "meta": _matrix(sample.column("meta"), META)}
    if len(set(y)) < 2:
        share = float((y.sum() + 1) / (len(y) + 2))
        return all_.select("doc_id", *(F.lit(share).alias(c) for c in ("p_content", "p_meta", "score")), F.lit(int(share >= 0.5)).alias("predicted"))
    order = np.argsort(ids, kind="stable")
    y, views = y[order], {k: v[order] for k, v in views.items()}
    held = np.arange(len(y)) % 5 == 0
    train = {k: (v[~held], y[~held]) for k, v in views.items()}
    models = {k: _fitted(*train[k], v[held], y[held]) for k, v in views.items()}
    taken: set[int] = set()
    for _ in range(rounds):
        sure = stage(_surest(all_.where("y is null and doc_id is not null"), models, exchange, float(y.mean()), taken), "surest")
        given: dict[str, dict[int, tuple[bytes, float]]] = {k: {} for k in views}
        for to, value, n in _lists(exchange, float(y.mean())):
            mine = sure.where((F.col("to") == to) & (F.col("value") == value))
            given[to] |= {r["doc_id"]: (r["x"], value) for r in mine.orderBy(F.col("doubt"), "doc_id").limit(n).collect()}
        for k, new in given.items():
            if new:
                x = _matrix(pa.array([b for b, _ in new.values()], pa.binary()), views[k].shape[1])
                train[k] = np.vstack([train[k][0], x]), np.concatenate([train[k][1], [v for _, v in new.values()]])
            taken |= set(new)
        models = {k: _fitted(*train[k], v[held], y[held]) for k, v in views.items()}
    return _scored(all_, models).select("doc_id", "p_content", "p_meta", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _fitted(x: np.ndarray, y: np.ndarray, held_x: np.ndarray, held_y: np.ndarray) -> Logistic:
    model = Logistic().fit(x, y)
    model.calibrate(held_x, held_y)
    return model


def _lists(exchange: int, share: float) -> list[tuple[str, float, int]]:
    """(view that is taught, label, rows at most) of the four lists of a round."""
    n_good = max(1, round(exchange * share))
    return [(to, value, n) for to in ("content", "meta") for value, n in ((1.0, n_good), (0.0, max(1, exchange - n_good)))]


def _surest(rows: DataFrame, models: dict[str, Logistic], exchange: int, share: float, taken: set[int]) -> DataFrame:
    """Of each task's rows those that may be among the surest of all, for all four lists in one pass: (to, value, doubt, doc_id, x)."""
    out_of = np.array(sorted(taken), dtype=np.int64)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[str, float], list[tuple[float, int, bytes]]] = {}
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            free = ~np.isin(ids, out_of)
            x = {k: batch.column(k).to_pylist() for k in models}
            p = {k: np.round(m.chance(_matrix(batch.column(k), len(m.scale))), 6) for k, m in models.items()}
            for to, value, n in _lists(exchange, share):
                doubt = np.abs(value - p["meta" if to == "content" else "content"])
                at = np.flatnonzero(free & (doubt <= 1 - CONFIDENT + 1e-9))
                at = at[np.lexsort((ids[at], doubt[at]))][:n]
                have = best.get((to, value), []) + [(float(doubt[i]), int(ids[i]), x[to][i]) for i in at]
                best[to, value] = sorted(have)[:n]
        for (to, value), mine in best.items():
            yield pa.RecordBatch.from_pydict({"to": [to] * len(mine), "value": [value] * len(mine), "doubt": [d for d, _, _ in mine], "doc_id": pa.array([i for _, i, _ in mine], pa.int64()), "x": pa.array([b for *_, b in mine], pa.binary())},
                schema=pa.schema([("to", pa.string()), ("value", pa.float64()), ("doubt", pa.float64()), ("doc_id", pa.int64()), ("x", pa.binary())]))

    return rows.select("doc_id", "content", "meta").mapInArrow(over, "to string, value double, doubt double, doc_id long, x binary")


def _scored(features: DataFrame, models: dict[str, Logistic]) -> DataFrame:
    a, b = models["content"], models["meta"]
    weigh = np.array([1 / max(a.loss, 1e-3), 1 / max(b.loss, 1e-3)])
    weigh /= weigh.sum()

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = (m.chance(_matrix(batch.column(k), len(m.scale))) for k, m in models.items())
            score = 1 / (1 + np.exp(-(weigh[0] * np.log(p / (1 - p)) + weigh[1] * np.log(q / (1 - q)))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.round(v, 6), pa.float64()) for v in (p, q, score))], names=["doc_id", "p_content", "p_meta", "score"])

    return features.select("doc_id", "content", "meta").mapInArrow(over, "doc_id long, p_content double, p_meta double, score double")
