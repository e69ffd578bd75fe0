"""Sinks: profile and detection text, CSV with JSON cells, JSON lines, YAML, Markdown, automata."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from pathlib import Path
from typing import TextIO

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from weftline.operators.automata import Automaton


def profile_lines(profiles: DataFrame) -> DataFrame:
    """direction;split;six bounds; as text lines."""
    cols = ["split", *(f"{c}_{e}" for c in ("total", "range1", "range2") for e in ("lo", "hi"))]
    return profiles.select(F.concat(F.concat_ws(";", "direction", *(F.col(c).cast("string") for c in cols)), F.lit(";")).alias("value"))


def write_csv(df: DataFrame, path: str, json_cells: bool = True) -> None:
    cell = lambda c, t: F.get_json_object(F.to_json(F.struct(F.col(c).alias("v"))), "$.v") if t != "string" else F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r'^\{"v":(.*)\}$', 1)
    out = df.select(*(cell(c, t).alias(c) for c, t in df.dtypes)) if json_cells else df
    out.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _camel(name: str) -> str:
    return name[:1].lower() + name[1:]


def yaml(df: DataFrame) -> Iterator[str]:
    """List items with camel-case keys, a row at a time."""
    for row in df.toLocalIterator():
        for i, (k, v) in enumerate(row.asDict(True).items()):
            yield f"{'- ' if not i else '  '}{_camel(k)}: {json.dumps(v, default=str, ensure_ascii=False)}"


def markdown(df: DataFrame) -> Iterator[str]:
    yield "| " + " | ".join(df.columns) + " |"
    yield "|" + " --- |" * len(df.columns)
    for row in df.toLocalIterator():
        yield "| " + " | ".join(str(v) for v in row) + " |"


WRITERS = {"csv": write_csv, "json": write_json, "yaml": yaml, "markdown": markdown}


def write_iec_dump(df: DataFrame, path: str) -> str:
    """Windowed flows beside their input, at <path>.dump.csv: arrays of numbers as [a,b], of tags as a,b."""
    def cell(name: str, kind: str):
        text = F.array_join(F.transform(name, lambda x: x.cast("string")), ",", "")
        return text if kind == "array<string>" else F.concat(F.lit("["), text, F.lit("]")) if kind.startswith("array") else F.col(name)

    out = f"{path}.dump.csv"
    df.select(*(cell(c, t).alias(c) for c, t in df.dtypes)).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(out)
    return out


class RowWriter:
    """Begin, append any number of tables, end; a header is written once. For reports that one reader takes in, such as the batches of a watched stream."""

    def __init__(self, out: TextIO, kind: str) -> None:
        if kind not in WRITERS:
            raise NotImplementedError(f"no writer for {kind}")
        self.out, self.kind, self.columns = out, kind, None

    def begin(self, columns: list[str]) -> None:
        if self.columns is not None:
            raise ValueError("the writer has begun")
        self.columns = columns
        if self.kind == "csv":
            self._line(columns)
        elif self.kind == "markdown":
            self.out.write("| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns) + "\n")

    def append(self, df: DataFrame) -> None:
        if self.columns is None:
            self.begin(df.columns)
        for row in df.select(*self.columns).toLocalIterator():
            self._row(row)

    def end(self) -> None:
        self.out.flush()
        self.columns = None

    def _line(self, cells: list) -> None:
        text = io.StringIO()
        csv.writer(text, lineterminator="\n").writerow(cells)
        self.out.write(text.getvalue())

    def _row(self, row: Row) -> None:
        cells = row.asDict(True)
        if self.kind == "csv":
            self._line([v if isinstance(v, str) else json.dumps(v, default=str) for v in cells.values()])
        elif self.kind == "json":
            self.out.write(json.dumps(cells, default=str, ensure_ascii=False) + "\n")
        elif self.kind == "yaml":
            self.out.writelines(f"{'  ' if i else '- '}{_camel(k)}: {json.dumps(v, default=str, ensure_ascii=False)}\n" for i, (k, v) in enumerate(cells.items()))
        else:
            self.out.write("| " + " | ".join(str(v) for v in cells.values()) + " |\n")


def automaton_text(a: Automaton) -> str:
    """The start state, an edge a line, a final weight a line."""
    edges, ends = a.table()
    return "\n".join(["0", *(f'{q} {to} "{s}" {p:g}' for q, s, to, p in edges), *(f"{q} {p:g}" for q, p in enumerate(ends) if p)]) + "\n"


def automaton_dot(a: Automaton, most: int = 25, each: bool = False) -> str:
    """A graph with one edge for each pair of states, labelled with its symbols, or one for each transition."""
    edges, ends = a.table()
    by: dict[tuple, list[str]] = {}
    for q, s, to, p in edges:
        by.setdefault((q, to, s) if each else (q, to), []).append(f"{s}: {p:.3g}".replace('"', '\\"'))
    body = [f'  {q} [shape={"doublecircle" if p else "circle"}, label="{q}: {p:.2g}"];' for q, p in enumerate(ends)]
    body += [f'  {q} -> {to} [label="{chr(92) + "n"}"];'.replace('"\\n"', '"' + "\\n".join(x[:most] + ["..."] * (len(x) > most)) + '"') for (q, to, *_), x in by.items()]
    return "digraph {\n  rankdir=LR;\n" + "\n".join(body) + "\n}\n"


def automaton_name(stem: str, alpha: float | None = None, t0: int | None = None, kind: str = "fa") -> str:
    return f"{stem}-pta.{kind}" if alpha is None else f"{stem}a{alpha}t{t0}.{kind}"


def store_automaton(a: Automaton, stem: str, alpha: float | None = None, t0: int | None = None) -> list[str]:
    """Writes the text and the graph of a model beside each other; the names written."""
    names = [automaton_name(stem, alpha, t0, kind) for kind in ("fa", "dot")]
    for name, text in zip(names, (automaton_text(a), automaton_dot(a)), strict=True):
        Path(name).write_text(text)
    return names


def report(distances: DataFrame, last: int) -> Iterator[str]:
    """window;value lines of each pair, without the window of the given number."""
    pair = None
    for r in distances.orderBy("model", "win").toLocalIterator():
        if r["model"] != pair:
            pair = r["model"]
            yield str(pair)
        if r["win"] != last:
            yield f"{r['win']};{r['distance']}"


def detection_report(profiles: DataFrame, directions: DataFrame, outliers: DataFrame) -> DataFrame:
    """(direction, status, windows by series): status `no profile`, `insufficient` or `ok`."""
    found = outliers.groupBy("direction").pivot("series", ["total", "range1", "range2"]).agg(F.array_sort(F.collect_set("n")))
    known = directions.select("direction").distinct().join(profiles.select("direction", "status"), "direction", "left")
    return known.withColumn("status", F.coalesce("status", F.lit("no profile"))).join(found, "direction", "left")
