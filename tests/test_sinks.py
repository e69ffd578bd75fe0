"""Writers, inputs, options and the pace of replays."""

import io
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from weftline import options, streaming
from weftline.operators import automata as A
from weftline.operators import scoring
from weftline.operators import statistical as S
from weftline.sources import files, sinks


def test_header_is_written_once(spark):
    a, b = spark.createDataFrame([(1, 'x"y')], "N int, Text string"), spark.createDataFrame([(2, None)], "N int, Text string")
    want = {
        "csv": 'N,Text\n1,"x""y"\n2,null\n',
        "json": '{"N": 1, "Text": "x\\"y"}\n{"N": 2, "Text": null}\n',
        "yaml": '- n: 1\n  text: "x\\"y"\n- n: 2\n  text: null\n',
        "markdown": '| N | Text |\n| --- | --- |\n| 1 | x"y |\n| 2 | None |\n',
    }
    for kind, text in want.items():
        out = io.StringIO()
        w = sinks.RowWriter(out, kind)
        w.append(a)
        w.append(b)
        with pytest.raises(ValueError):
            w.begin(["N"])
        w.end()
        assert out.getvalue() == text
    with pytest.raises(NotImplementedError):
        sinks.RowWriter(io.StringIO(), "xml")


def test_dump(spark, tmp_path):
    df = spark.createDataFrame([("k", [1.5, 2.0], ["a", "b"], None), ("l", [], None, 3)], "key string, v array<double>, tags array<string>, n int")
    out = sinks.write_iec_dump(df.coalesce(1), str(tmp_path / "in.csv"))
    assert out.endswith("in.csv.dump.csv")
    got = sorted(map(tuple, spark.read.option("header", True).csv(out).collect()))
    assert got == [("k", "[1.5,2.0]", "a,b", None), ("l", "[]", None, "3")]


def test_automaton_files(tmp_path):
    a, _ = A.Automaton.tree([("a", "b"), ("a", "c"), ("a", "b")])
    names = sinks.store_automaton(a, str(tmp_path / "m"), 0.05, 3)
    assert [n.rsplit("/", 1)[1] for n in names] == ["ma0.05t3.fa", "ma0.05t3.dot"]
    assert open(names[0]).read() == sinks.automaton_text(a)


def test_graph_of_transitions():
    a, _ = A.Automaton.tree([("a", "b"), ("c", "b")])
    a.edges[0]["x"] = a.edges[0]["a"]  # a second symbol between the same states
    assert sinks.automaton_dot(a).count(" -> ") == 4 and sinks.automaton_dot(a, each=True).count(" -> ") == 5


def test_choice_of_input():
    assert files.choose_input("x.pcap", 2.0, "eth0", 1) == ("replay", "x.pcap")
    assert files.choose_input("x.pcap", 0.0, "eth0") == ("read", "x.pcap")
    assert files.choose_input(None, 3.0, "eth0", 1) == ("device", "eth0")
    assert files.choose_input(index=0) == ("device", 0) and files.choose_input() == ("none", None)


def test_flatten(spark):
    df = spark.createDataFrame([([(1, "a"), (2, "b")],), ([],), (None,)], "r array<struct<n: int, _record: string>>")
    assert sorted(map(tuple, files.flatten(df, "r").collect())) == [(1, "a"), (2, "b")]


def test_options():
    said = []
    assert options.number(" -7 ", 1) == -7 and options.number("x", 1, said.append) == 1 and options.number(None, 4, said.append) == 4
    assert options.choice("csv", ["Csv", "Json"], "Json") == "Csv" and options.choice("xml", ["Csv"], "Csv", said.append) == "Csv"
    zero = timedelta()
    assert options.span("1.02:03:04.5", zero) == timedelta(days=1, hours=2, minutes=3, seconds=4.5) and options.span("00:05", zero) == timedelta(minutes=5)
    assert options.span("-2", zero) == timedelta(days=-2) and options.span("25:00", timedelta(1), said.append) == timedelta(1)
    assert len(said) == 3


def test_describe(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)] + [("b", None)], "g string, x double")
    got = {r["g"]: tuple(r)[1:] for r in S.describe(df, "x", "g").collect()}
    assert got["a"] == (4, 2.5, pytest.approx(1.290994, abs=1e-6), 1.0, 1.75, 2.5, 3.25, 4.0) and got["b"][:2] == (0, None)


def test_evaluation_of_clusters(spark):
    df = spark.createDataFrame([([0.0, 0.0], "x"), ([0.0, 2.0], "x"), ([9.0, 0.0], "y"), ([9.0, 2.0], "y")], "features array<double>, label string")
    centres = [[0.0, 1.0], [9.0, 1.0]]
    e = scoring.evaluate(scoring.distances(df, centres), centres, "label")
    assert (e.average_distance, e.mutual_information) == (1.0, pytest.approx(1.0)) and e.davies_bouldin == pytest.approx(2 / 9)
    assert scoring.evaluate(scoring.distances(df.limit(0), centres), centres).average_distance == 0.0


def test_replay_keeps_pace(spark, tmp_path):
    waits = []
    df = spark.createDataFrame([(0,), (400_000,), (5_200_000,), (60_000_000,)], "us long")
    assert streaming.paced(df, str(tmp_path / "in"), 2.0, wait=waits.append) == 3
    assert len(waits) == 2 and 1.5 < waits[0] <= 2.5 and 20 < waits[1] <= 30
    assert sorted(r["us"] for r in spark.read.parquet(str(tmp_path / "in")).collect()) == [0, 400_000, 5_200_000, 60_000_000]
    assert streaming.paced(df.limit(0), str(tmp_path / "none"), 1.0) == 0
    with pytest.raises(ValueError):
        streaming.paced(df, str(tmp_path / "x"), 0)


def test_watching_stops(spark, tmp_path):
    rates = spark.readStream.format("rate").option("rowsPerSecond", 5).load().select(F.col("value").alias("n"), F.lit("k").alias("key"))
    profile = scoring.Profile("direct", [10.0], [], [], [scoring.Clusters([[0.5]], [0.1])], ["n"])
    q = streaming.watch(rates, profile, ["n"], lambda batch, number: batch.count(), str(tmp_path / "c"), timeout=3)
    assert not q.isActive
