"""The command line end to end on small files, and the function blocks that the queries don't cover."""

import random

from pyspark.sql import functions as F

from weftline.__main__ import main
from weftline.operators import plc
from weftline.sources import files, sinks


def messages(path, seed, n=400):
    rng, t, rows = random.Random(seed), 0.0, ["TimeStamp;Relative Time;srcIP;dstIP;srcPort;dstPort;ipLen;len;fmt;uType;asduType;numix;cot;oa;addr;ioa"]
    for i in range(n):
        t += rng.choice([0.1, 1, 5])
        a, b = (("1.1.1.1", 55000), ("2.2.2.2", 2404))[:: 1 if i % 2 else -1]
        rows.append(f"15:03:10.31;{t:.3f};{a[0]};{b[0]};{a[1]};{b[1]};58;17;0x00000000;;{rng.choice([100, 122])};1;{rng.choice([3, 6, 10])};0;6;64")
    path.write_text("\n".join(rows) + "\n")
    return str(path)


def test_rates_and_conversations(spark, tmp_path, capsys):
    a, b = messages(tmp_path / "a", 1), messages(tmp_path / "b", 2)
    main(["rate-profile", a, "-t", "20"])
    text = capsys.readouterr().out
    assert text.count("\n") == 2 and all(x.endswith(";") for x in text.splitlines())
    (tmp_path / "p").write_text(text)
    main(["rate-detect", b, str(tmp_path / "p"), "-t", "20"])
    assert "| ok |" in capsys.readouterr().out
    for more in (["--atype", "pta"], ["--atype", "pa"], ["--alg", "member"]):
        main(["check", a, b, "-t", "100", *more])
        assert capsys.readouterr().out.startswith("| model |")
    main(["learn", a])
    assert "100.10" in capsys.readouterr().out


def test_flows(spark, tmp_path, capsys):
    cols = [F.lit("x").alias(c) if c in files.FLOW_TEXT else (F.col("id") % (3 + i)).cast("double").alias(c) for i, c in enumerate(files.FLOW_TEXT + files.FLOW_NUMBERS)]
    sinks.write_csv(spark.range(60).select(*cols), str(tmp_path / "f"))
    main(["export-flows", str(tmp_path / "f"), str(tmp_path / "again")])
    main(["build-profile", str(tmp_path / "again"), str(tmp_path / "p"), "-m", "pca"])
    main(["test-flows", str(tmp_path / "again"), str(tmp_path / "p"), str(tmp_path / "o")])
    assert spark.read.json(str(tmp_path / "o/all")).count() == 60
    main(["show-profile", str(tmp_path / "p")])
    assert '"method": "pca"' in capsys.readouterr().out


def test_blocks(spark):
    df = spark.createDataFrame([(1, i, float(i), v) for i, v in enumerate([True, False, False, True, True, False])], "k int, o int, t double, v boolean")
    assert [r["counter"] for r in plc.down_counter(df, F.col("v"), F.col("o") == 2, "k", "o", 2).orderBy("o").collect()] == [1, 1, 2, 1, 0, 0]
    assert [r["held"] for r in plc.off_delay(df, F.col("v"), "k", "o", "t", 1.5).orderBy("o").collect()] == [True, True, False, True, True, True]
    out = [r["output"] for r in plc.pid(df.withColumn("x", F.lit(1.0)), "k", "o", "t", "x", 2.0, 1.0, 0.5, 0.1, -2.0, 2.0).orderBy("o").collect()]
    assert out == [1.0, 1.5, 2.0, 2.0, 2.0, 2.0]
