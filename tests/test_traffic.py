"""Small hand-made inputs, files of each format, properties of automata, stream against batch."""

import math
import random
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline import functions as X
from weftline.operators import automata as A
from weftline.operators import flow, iec, scoring
from weftline.operators import statistical as S
from weftline.sources import files, pcap, sinks


def values(df):
    return sorted(map(tuple, df.collect()))


def test_information_frames(spark):
    df = spark.createDataFrame([("0x00000000",), ("0x00000001",), ("",), (None,), ("0",)], "fmt string")
    assert [r[0] for r in df.select(X.is_information_frame("fmt")).collect()] == [True, False, False, False, True]


def test_parsers(spark):
    df = spark.createDataFrame([("<100.6>,<1.20>,x<3.4>,<5.n>, <1.1>",)], "d string")
    assert df.select(X.parse_conversation("d")).first()[0] == ["100.6", "1.20", "5.n"]
    df = spark.createDataFrame([("1,2,30..33",)], "d string")
    assert df.select(X.parse_ranges("d")).first()[0] == [1, 2, 30, 31, 32, 33]
    df = spark.createDataFrame([("b-a-2-1",), ("a:1-b:2",)], "d string")
    assert {r[0] for r in df.select(X.parse_pair("d")).collect()} == {"a:1|b:2"}
    with pytest.raises(Exception, match="bad pair key"):
        spark.createDataFrame([("a-b-c",)], "d string").select(X.parse_pair("d")).collect()


def test_scores(spark):
    df = spark.createDataFrame([([0.8867, 0.8076, 0.9659],), ([0.0, 0.0, 0.0],)], "s array<double>")
    a, b = df.select(*(c.alias(k) for k, c in X.score_summary(F.col("s")).items())).collect()
    assert (a["max_score"], a["min_score"], a["best_model"]) == (0.9659, 0.8076, 2) and a["average_score"] == pytest.approx(0.886733, abs=1e-5)
    assert b["best_model"] == 0
    one = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (3.0, 0.25)], "d double, v double")
    assert [r[0] for r in one.select(X.anomaly_score(F.col("d"), F.col("v"))).collect()] == [1.0, 0.0, 0.0]


def test_message_window_sums_by_tag(spark):
    m = spark.createDataFrame([(1, "k", "0.20", 26, 4, 112), (2, "k", "0.20", 34, 4, 476), (3, "k", "0.20", 42, 4, 520)], "seq long, key string, tag string, iec_len int, items int, octets int")
    m = m.withColumns({"label": F.col("seq"), "packets": F.lit(1), "us": F.col("seq")})
    r = iec.window_aggregate(iec.indexed(m, iec.tags(m)), 2, ["key"]).first()
    assert (r["bytes"], r["packets"], r["length_vector"], r["items_vector"]) == (1108, 3, [0.0, 102.0], [0.0, 12.0])


def test_window_counter_against_a_loop(spark):
    rng, rows, want = random.Random(1), [], {}
    for d in range(30):
        t, trace = 0.0, []
        for _ in range(rng.randrange(1, 40)):
            t += rng.choice([0.1, 1, 3, 30])
            trace.append(t)
        at, n, out = 10.0, 1, []
        for x in trace:
            if x >= at:
                n, at = n + 1, at + 10.0
            out.append(n)
        want[f"d{d}"] = out
        rows += [(f"d{d}", i + 1, x) for i, x in enumerate(trace)]
    df = spark.createDataFrame(rows, "direction string, rank long, t double")
    got = {}
    for r in S.windows(df, 10.0).orderBy("direction", "rank").collect():
        got.setdefault(r["direction"], []).append(r["n"])
    assert got == want


def test_conversations(spark):
    kinds = A.split_conversations([(100, 6), (100, 7), (1, 20), (1, 20), (100, 10), (100, 7), (1, 20), (100, 7), (122, 13), (123, 13), (1, 5), (1, 44)])
    assert kinds == [(0, "GENERAL_ACT")] * 5 + [(1, "GENERAL")] * 2 + [(2, "GENERAL")] * 5
    rng = random.Random(3)
    rows = [(i, "p", rng.choice([100, 122, 123, 30]), rng.choice([3, 6, 7, 10, 20]), str(i)) for i in range(300)]
    got = A.conversations(spark.createDataFrame(rows, "seq long, pair string, asdu int, cot int, symbol string")).collect()
    assert sorted(int(s) for r in got for s in r["word"]) == list(range(300))
    assert all(len(r["word"]) == 1 for r in got if r["kind"] == "SPONTANEOUS")


def language_rows(seed, n):
    rng = random.Random(seed)
    return [["a"] * rng.randrange(1, 4) + (["b"] if rng.random() < 0.5 else []) for _ in range(n)]


def test_conversations_across_slices(spark):
    """Slices of any size give the same conversations as a whole pair does."""
    rng = random.Random(9)
    rows = [(i, rng.choice(["a|b", "a|c"]), rng.choice([100, 122, 123, 124, 125]), rng.choice([3, 5, 6, 6, 7, 7, 10, 13, 20, 44])) for i in range(600)]
    df = spark.createDataFrame([(*r, f"{r[2]}.{r[3]}") for r in rows], "seq long, pair string, asdu int, cot int, symbol string").repartition(3)
    want = {}
    for pair in ("a|b", "a|c"):
        mine = [r for r in rows if r[1] == pair and r[3] != 3]
        firsts = {}
        for (n, kind), r in zip(A.split_conversations([(r[2], r[3]) for r in mine]), mine, strict=True):
            want.setdefault((pair, firsts.setdefault(n, r[0]), kind), []).append(f"{r[2]}.{r[3]}")
    for size in (1, 7, 1_000_000):
        got = A.conversations(df, slice_rows=size).where("kind <> 'SPONTANEOUS'").collect()
        assert {(r["pair"], r["first_seq"], r["kind"]): r["word"] for r in got} == want and len(got) == len(want)


def test_tree_telescopes():
    words = language_rows(1, 200)
    tree, _ = A.Automaton.tree(words)
    counts = Counter(map(tuple, words))
    for w, n in counts.items():
        assert A.word_log_probability(tree, w) == pytest.approx(math.log(n / 200))
    assert A.word_log_probability(tree, ["z"]) is None


def test_merged_automata():
    a, b = A.alergia(language_rows(1, 400)), A.alergia(language_rows(2, 400))
    for m in (a, b):
        edges, ends = m.table()
        out = np.array(ends)
        for q, _, _, p in edges:
            out[q] += p
        assert np.allclose(out, 1)
        assert len(ends) < 8
    assert A.automaton_distance(a, a) == pytest.approx(0, abs=1e-6)
    assert A.automaton_distance(a, b) == pytest.approx(A.automaton_distance(b, a)) and 0 <= A.automaton_distance(a, b) <= 1
    empty, _ = A.Automaton.tree([[]])
    assert A.automaton_distance(empty, empty) == 0 and A.automaton_distance(empty, a) == 1
    assert A.reduce_models([a, a, b, empty], 0) == [0, 2, 3]
    assert sinks.automaton_text(a).startswith("0\n0 ") and sinks.automaton_dot(a).startswith("digraph {")


def test_distance_against_plain(spark):
    def p(words):
        return {w: n / len(words) for w, n in Counter(map(tuple, words)).items()}

    x, y = language_rows(5, 50), [*language_rows(6, 70), ["c"]]
    frame = lambda words: spark.createDataFrame([("m", 0, w) for w in words], "model string, win long, word array<string>")
    got = A.distances(frame(x), frame(y)).first()["distance"]
    a, b = p(x), p(y)
    assert got == pytest.approx(math.sqrt(sum((a.get(w, 0) - b.get(w, 0)) ** 2 for w in {*a, *b})))


def test_profiles(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(c, 0.05, 4)).tolist()) for i, c in enumerate([0.0, 1.0, 3.0, 7.0] * 30)]
    df = spark.createDataFrame(rows, "id long, features array<double>")
    for method in ("direct", "pca", "average"):
        p = scoring.build_profile(df, method, ks=(3, 4, 200), top=2)
        assert len(p.models) == 2
        p.save(spark, str(tmp_path / method))
        again = scoring.Profile.load(spark, str(tmp_path / method))
        assert values(p.score(df).select("id", "average_score")) == values(again.score(df).select("id", "average_score"))
    if p.method == "pca":
        v = np.array(p.loadings)
        assert np.allclose(v @ v.T, np.eye(len(v)))
    far = spark.createDataFrame([(1, [90.0, -50.0, 20.0, 7.0])], "id long, features array<double>")
    assert scoring.detected(p.score(far)).count() == 1


def test_files(spark, tmp_path):
    m = tmp_path / "m.csv"
    m.write_text("TimeStamp;Relative Time;srcIP;dstIP;srcPort;dstPort;ipLen;len;fmt;uType;asduType;numix;cot;oa;addr;ioa\n15:03:10.31;0.000000;1.1.1.1;2.2.2.2;55000;2404;58;17;0x00000000;;122;1;13;0;6;64\n15:03:10.31;0.5;2.2.2.2;1.1.1.1;2404;55000;x;19;0x00000000;;120;1;13;0;6;64\n")
    assert values(files.read_messages_positional(spark, str(m))) == [(1, 0.0, "1.1.1.1", "2.2.2.2"), (2, 0.5, "2.2.2.2", "1.1.1.1")]
    assert files.read_messages(spark, str(m)).select("asduType").first()[0] == "122"
    iec_ = files.read_iec(spark, str(m), "2024-01-01 00:00:00").orderBy("label").collect()
    assert (iec_[1]["octets"], iec_[1]["iec_len"], str(iec_[1]["start"])) == (0, 19, "2024-01-01 00:00:00.500000")
    with pytest.raises(ValueError, match="origin"):
        files.read_iec(spark, str(m))
    c = tmp_path / "c.csv"
    c.write_text("Timestamp;Relative Time;Duration;Length;Data\nKey;a-b-1-2;;;\n1;0.1;0.2;2;<100.6>,<1.20>\n2;0.3;0.1;0;\nKey;c:1-d:2;;;\n3;1;1;1;<7.n>\n")
    assert [(r["pair"], r["word"]) for r in files.read_conversations(spark, str(c)).orderBy("row").collect()] == [("a:1|b:2", ["100.6", "1.20"]), ("c:1|d:2", ["7.n"])]
    p = tmp_path / "p.csv"
    p.write_text("a:b;0.5;1;2;3;4;5;6;\n")
    assert files.read_profiles(spark, str(p)).first()["range2_hi"] == 6.0
    labels = tmp_path / "l.csv"
    labels.write_text("5;1\n6;0\n7;x\n")
    assert values(files.read_packet_labels(spark, str(labels))) == [(0, 1), (1, 0), (2, 0)]
    assert files.sniff("srcIP;x,y,z") == ("dissector", ",")
    with pytest.raises(ValueError, match="header"):
        files.sniff("nothing")
    with pytest.raises(NotImplementedError):
        files.source("goose")


def test_slices_give_what_whole_pairs_give(spark):
    """A busy pair, ordered in slices of a few packets, against a loop over all of them."""
    rng = random.Random(5)
    rows, t = [], 0.0
    for i in range(400):
        t += rng.choice([0.1, 1.0, 3.0, 30.0])
        src, dst = rng.choice([("a", "b"), ("b", "a"), ("a", "b"), ("c", "a")])
        rows.append((7 * i + 3, t, src, dst))
    df = spark.createDataFrame(rows, "seq long, t double, src string, dst string").repartition(3)
    last, ranks, first, clock, want = {}, {}, {}, {}, {}
    for seq, t, src, dst in rows:
        pair, way = tuple(sorted((src, dst))), f"{src}:{dst}"
        ranks[way] = ranks.get(way, 0) + 1
        first.setdefault(pair, src)
        n, end = clock.get(way, (1, 10.0))
        clock[way] = (n + 1, end + 10.0) if t >= end else (n, end)
        want[seq] = (first[pair] == src, round(t - last.get(pair, 0.0), 6), ranks[way], clock[way][0])
        last[pair] = t
    for size in (20, 1_000_000):
        got = S.windows(S.inter_arrivals(S.pairs(df), size), 10.0, slice_rows=max(1, size // 7)).collect()
        assert {r["seq"]: (r["canonical"], round(r["delta"], 6), r["rank"], r["n"]) for r in got} == want


def test_lines_of_split_files(spark, tmp_path):
    """Row numbers and keys of files that are read in many splits, with both line ends."""
    rng, want, words = random.Random(6), {}, []
    for name, end in (("a.csv", "\n"), ("b.csv", "\r\n")):
        body = [("" if i % 50 == 7 else f"Key;p{i}-q{i}-1-2;;;" if i % 90 == 0 else f"{i};0.1;0.2;2;<{i}.{rng.randrange(9)}>") for i in range(700)]
        (tmp_path / name).write_bytes((end.join(body) + end).encode())
        want[name] = [(i, x) for i, x in enumerate(body) if x]
        key = None
        for i, x in enumerate(body):
            key = x.split(";")[1] if x.startswith("Key") else key
            if x and not x.startswith("Key"):
                a, b, c, d = key.split("-")
                words.append((i, f"{a}:{c}|{b}:{d}"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        read = files.lines(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() > 3
        got = {}
        for r in read.orderBy("file", "row").collect():
            got.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["row"], r["value"]))
        assert got == want
        conversations = files.read_conversations(spark, str(tmp_path), slice_rows=13).collect()
        assert sorted((r["row"], r["pair"]) for r in conversations) == sorted(words)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_json_cells_round(spark, tmp_path):
    df = spark.createDataFrame([("0003", "k", 59.5)], "WindowLabel string, FlowKey string, ForwardMetricsDuration double")
    for c in files.FLOW_TEXT + files.FLOW_NUMBERS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x") if c in files.FLOW_TEXT else F.lit(1.0))
    df = df.select(files.FLOW_TEXT + files.FLOW_NUMBERS)
    sinks.write_csv(df, str(tmp_path / "f"))
    back = files.read_flows(spark, str(tmp_path / "f")).first()
    assert (back["WindowLabel"], back["ForwardMetricsDuration"], back["DataUnitId"]) == ("0003", 59.5, 1.0)
    assert next(iter(sinks.markdown(df))).startswith("| WindowLabel")
    assert next(iter(sinks.yaml(df))) == '- windowLabel: "0003"'


def test_capture(spark, tmp_path):
    ip = bytes([0x45, 0, 0, 44, 0, 0, 0, 0, 64, 6, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8])
    tcp = struct.pack("!HHIIBBHHH", 50000, 502, 0, 0, 0x50, 0, 0, 0, 0) + b"abcd"
    frames = [bytes(12) + b"\x08\x00" + ip + tcp, b"short"]
    data = struct.pack("<IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack("<IIII", 10, 7, len(f), len(f)) + f for f in frames)
    (tmp_path / "x.pcap").write_bytes(data)
    a, b = pcap.read_pcap(spark, str(tmp_path / "x.pcap")).orderBy("seq").collect()
    assert (a["us"], a["proto"], a["src_ip"], a["src_port"], a["dst_port"], bytes(a["payload"])) == (10_000_007, "TCP", "1.2.3.4", 50000, 502, b"abcd")
    assert b["src_ip"] is None


def test_numbers_and_windows(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 + 3).alias("o")).repartition(5)
    got = flow.numbered(df, "o").orderBy("o").collect()
    assert [r["rn"] for r in got] == list(range(1, 1001))
    assert flow.windows_within(10, 3) == 4 and flow.windows_within(1e30, 1) == 2**31 - 1


def test_numbers_of_many_small_ranges(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 3, 500, 501, 9000)], "o long")
    assert [r["rn"] for r in flow.numbered(df, "o", 2, 1).orderBy("o").collect()] == [1, 2, 3, 4, 5, 6]


def test_watch_scores_a_stream(spark, tmp_path):
    from weftline import streaming
    from weftline.sources import adapters

    p = adapters.packets(spark, "/root/testdata/sf0.001").select("seq", F.timestamp_micros("us").alias("ts"), "us", "up", "octets", "proto", "src_ip", "dst_ip", "src_port", "dst_port")
    p.write.parquet(str(tmp_path / "in"))
    columns = ["fwd_packets", "fwd_octets", "rev_packets", "rev_octets"]
    batch = flow.flows(flow.windowed(p, adapters.DAY_US), X.multiflow_key())
    profile = scoring.build_profile(scoring.assemble(batch, columns), ks=(3,))
    seen = []
    flows = streaming.windowed_flows(streaming.replay(spark, str(tmp_path / "in"), p.schema), X.multiflow_key(), "1 day")
    q = streaming.watch(flows, profile, columns, lambda df, n: seen.extend(df.select("window_start", "average_score").collect()), str(tmp_path / "c"), once=True)
    q.awaitTermination()
    want = Counter(map(tuple, profile.score(scoring.assemble(batch, columns)).select("window_start", "average_score").collect()))
    assert seen and not Counter(map(tuple, seen)) - want


def test_candidate_statistics_do_not_hang_on_a_mean_s_last_bit(spark):
    """A candidate that comes out a little different each time it is computed still meets its windows."""
    deltas = spark.createDataFrame([("a", float(t), float(t % 3), t + 1) for t in range(60)], "direction string, t double, delta double, rank long")
    noisy = F.udf(lambda x: x + random.random() * 1e-9, "double").asNondeterministic()
    cands = deltas.groupBy("direction").agg(F.lit(0.0).alias("q25"), F.lit(1.0).alias("q50"), noisy(F.avg("delta") + 0.5).alias("mean"), F.lit(0.0).alias("q75"))
    spark.conf.set("spark.sql.exchange.reuse", "false")  # as where a plan is too large to find what it could share
    try:
        got = {r["ord"]: r for r in S.candidate_stats(deltas, cands, 10.0).collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    below = [Counter(t // 10 + 1 for t in range(60) if t % 3 < c) for c in (1, 1.5)]
    for i, b in zip((1, 2), below, strict=True):
        x = [b[n] for n in range(1, 6)]
        assert got[i]["mean_range1"] == np.mean(x) and got[i]["std_range1"] == pytest.approx(np.std(x, ddof=1), abs=1e-12)
        assert got[i]["mean_range2"] == 10 - np.mean(x) and got[i]["std_range2"] == pytest.approx(np.std(x, ddof=1), abs=1e-12)


def test_counts_on_the_edge_of_a_band_are_inside_in_any_order(spark):
    """1, 1, 1, 2, 3, 3, 3 has mean 2 and deviation 1: the band of one deviation is 1 to 3, whatever order the windows come in."""
    rng = random.Random(5)
    rows = []
    for d in range(60):
        x = [1, 1, 1, 2, 3, 3, 3]
        rng.shuffle(x)
        rows += [(f"d{d}", n + 1, c, 7 * c, c) for n, c in enumerate(x)]
    rng.shuffle(rows)
    counts = spark.createDataFrame(rows, "direction string, n long, total long, range1 long, range2 long").repartition(9)
    p = S.profile(counts, sigma=1.0)
    assert {(r["total_lo"], r["total_hi"], r["range1_lo"], r["range1_hi"]) for r in p.collect()} == {(1.0, 3.0, 7.0, 21.0)}
    assert S.outliers(counts, p).count() == 0
