"""Language ID by word-first backoff (operator 4).

A word that the model knows scores its log frequency in each language; any other falls back to its character n-grams of
the longest order that the model knows, down to single characters. A document's score sums its words' scores.

The model is fitted on a bounded sample of labelled documents (SAMPLE_ROWS for each language, chosen by a hash of
doc_id), so its size has a bound; prediction reads the whole text and nothing but the text.

Defined results: a null text or one without letters is `und` with score 0; ties go to the first language by name; rows
with null lang are never learned from; without any labelled row everything is `und`; an empty table gives an empty
result; repeated rows each get a result; extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftline.llm.common import held, lean, tune

#: Documents of each language that a model is fitted on, at most about this many.
SAMPLE_ROWS = 3000
#: A word is known from this count on.
KNOWN = 3
ORDERS = (4, 3, 2, 1)
_WORDS = re.compile(r"[^\W\d_]+")


def words(text: str) -> Counter:
    """The text's runs of letters, lower-cased, and how often each stands there. The pattern takes numerals that are no decimal digits too; they part words."""
    found = Counter(_WORDS.findall(text.lower()))
    for w in [w for w in found if not w.isascii() and not w.isalpha()]:
        n = found.pop(w)
        for part in "".join(c if c.isalpha() else " " for c in w).split():
            found[part] += n
    return found


#: Words whose scores a worker remembers.
REMEMBERED = 400_000


@dataclass
class Model:
    languages: list[str]
    places: dict[str, int]  # "w:" + word and "<order>:" + n-gram -> row of table
    table: np.ndarray  # log frequency in each language
    floor: float = log(1e-9)
    cache: dict[str, int] = field(default_factory=dict, repr=False)
    scores: np.ndarray | None = field(default=None, repr=False)

    def word(self, w: str) -> np.ndarray | float:
        if (known := self.places.get("w:" + w)) is not None:
            return self.table[known]
        marked, get = f"<{w}>", self.places.get
        for n in ORDERS:
            found = [x for i in range(len(marked) - n + 1) if (x := get(f"{n}:{marked[i : i + n]}")) is not None]
            if found:
                return self.table[found].sum(0) / len(found)
        return self.floor

    def _add(self, w: str) -> int:
        if self.scores is None:
            self.scores = np.empty((REMEMBERED, len(self.languages)), dtype=np.float32)
        i = self.cache[w] = len(self.cache)
        self.scores[i] = self.word(w)
        return i

    def score(self, text: str | None) -> tuple[str, float]:
        found = words(text) if text else None
        if not found or not self.languages:
            return "und", 0.0
        total = np.zeros(len(self.languages))
        kinds, counts = list(found), np.fromiter(found.values(), dtype=np.float64, count=len(found))
        for a in range(0, len(kinds), REMEMBERED):  # a text of more kinds of words is scored in parts
            part = kinds[a : a + REMEMBERED]
            if len(self.cache) + len(part) > REMEMBERED:
                self.cache.clear()
            get, add = self.cache.get, self._add
            at = [add(w) if (i := get(w)) is None else i for w in part]
            total += counts[a : a + REMEMBERED] @ self.scores[at]
        best = int(total.argmax())
        return self.languages[best], float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum())


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for w, n in words(text).items():
                seen[lang, "w:" + w] += n
                marked = f"<{w}>"
                for k in ORDERS:
                    for i in range(len(marked) - k + 1):
                        seen[lang, f"{k}:{marked[i : i + k]}"] += n
    if seen:
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in keys]), pa.array([b for _, b in keys]), pa.array(list(seen.values()), pa.int64())], names=["lang", "item", "n"])


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", rows: int = SAMPLE_ROWS) -> Model:
    spark = docs.sparkSession
    tune(spark)
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(doc_id))
    sizes = {r[0]: r[1] for r in usable.groupBy(lang).agg(F.count("*")).collect()}
    part = F.lit(False)
    for name, n in sizes.items():
        part = part | ((F.col(lang) == name) & (F.pmod(F.xxhash64(doc_id), F.lit(n)) < rows))
    tally = usable.where(part).select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(lean(_tally), "lang string, item string, n long")
    known = tally.groupBy("item", "lang").agg(F.sum("n").alias("n")).groupBy("item").agg(F.collect_list(F.struct("lang", "n")).alias("by"), F.sum("n").alias("n")).where(f"n >= {KNOWN}")
    languages = sorted(sizes)
    place = {x: i for i, x in enumerate(languages)}
    counts = {}
    for r in known.toLocalIterator():
        row = counts[r["item"]] = np.zeros(len(languages), dtype=np.float64)
        for x in r["by"]:
            row[place[x["lang"]]] = x["n"]
    totals: dict[str, np.ndarray] = {}
    for item, row in counts.items():
        totals[item[:2]] = totals.get(item[:2], 0) + row
    items = sorted(counts)
    table = np.array([np.log((counts[x] + 0.5) / (totals[x[:2]] + 0.5 * len(counts))) for x in items], dtype=np.float32).reshape(len(items), len(languages))
    return Model(languages, {x: i for i, x in enumerate(items)}, table)


def predict(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score)."""
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample that it was fitted on

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(lean(over), "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float, text: str = "text") -> DataFrame:
    """The rows whose text has a language with a score of `least` or more, with all their columns; each row is judged by its own text."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample that it was fitted on

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.score(t) for t in batch.column("text").to_pylist()]
            yield batch.select(["row"]).filter(pa.array([g != "und" and p >= least for g, p in found], pa.bool_()))

    rows = held(docs, text=F.col(text).cast("string"))
    return rows.mapInArrow(lean(over), StructType([rows.schema["row"]])).select("row.*")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    found = predict(docs, fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
