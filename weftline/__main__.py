"""python -m weftline COMMAND: build and apply profiles from files."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import functions as X
from weftline.operators import automata, scoring, statistical
from weftline.sources import files, sinks


def _deltas(spark: SparkSession, path: str) -> DataFrame:
    return statistical.inter_arrivals(statistical.pairs(files.read_messages_positional(spark, path)))


def rate_profile(spark: SparkSession, path: str, width: float) -> DataFrame:
    """direction, split and bands of a message file."""
    d = _deltas(spark, path)
    split = statistical.split_points(statistical.candidate_stats(d, statistical.candidates(d), width))
    counts = statistical.counts(statistical.windows(d, width).join(split, "direction"), F.col("split"))
    return statistical.profile(counts).join(split, "direction")


def rate_detect(spark: SparkSession, path: str, profiles: DataFrame, width: float) -> DataFrame:
    """Status of each direction, and the windows that begin an outlier."""
    d = _deltas(spark, path)
    counts = statistical.counts(statistical.windows(d, width).join(profiles.select("direction", "split"), "direction"), F.col("split"))
    if "status" not in profiles.columns:
        profiles = profiles.withColumn("status", F.when(F.col("total_lo").isNull() | F.isnan("total_lo"), "insufficient").otherwise("ok"))
    return sinks.detection_report(profiles, d.select("direction"), statistical.outliers(counts, profiles))


def conversations(spark: SparkSession, path: str, presplit: bool, width: float) -> DataFrame:
    """(model, win, ord, word) of a message file or of one whose conversations are split already."""
    if presplit:
        return files.read_conversations(spark, path).select(F.col("pair").alias("model"), F.lit(0).cast("long").alias("win"), F.col("row").cast("long").alias("ord"), "word")
    f = F.split("value", ";")
    at = {c: F.get(f, F.lit(i)) for i, c in enumerate(files.MESSAGE_COLUMNS)}
    m = files.lines(spark, path).where(~at["TimeStamp"].isin("TimeStamp", "")).where(X.is_information_frame(at["fmt"]))
    ends = [F.concat_ws(":", at[f"{s}IP"], at[f"{s}Port"]) for s in ("src", "dst")]
    win = automata.dense_windows(F.coalesce(at["Relative Time"].try_cast("double"), F.lit(0.0)), width)
    rows = m.select(F.col("row").cast("long").alias("seq"), X.pair_key(*ends).alias("model"), win.alias("win"), X.int_or_zero(at["asduType"]).alias("asdu"), X.int_or_zero(at["cot"]).alias("cot"), F.concat_ws(".", at["asduType"], at["cot"]).alias("symbol"))
    return automata.conversations(rows, ("model", "win")).select("model", "win", F.col("first_seq").alias("ord"), "word")


def check(valid: DataFrame, inspected: DataFrame, alg: str, merged: bool) -> DataFrame:
    """Distances of windows, or the words that a pair's model doesn't know."""
    if alg == "member":
        return automata.anomalies(inspected, valid)
    return automata.learned_distances(inspected, valid) if merged else automata.distances(inspected, valid)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="weftline")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *paths: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for x in paths:
            c.add_argument(x)
        return c

    for name, paths in (("rate-profile", ["file"]), ("rate-detect", ["file", "profile"])):
        command(name, *paths).add_argument("-t", "--width", type=float, default=300.0)
    for name, paths in (("check", ["valid", "inspected"]), ("learn", ["valid"])):
        c = command(name, *paths)
        c.add_argument("--atype", choices=["pa", "pta"], default="pa")
        c.add_argument("--alg", choices=["distr", "member"], default="distr")
        c.add_argument("--format", choices=["messages", "conversations"], default="messages")
        c.add_argument("-t", "--width", type=float, default=300.0)
    for name, paths in (("export-flows", ["file", "out"]), ("build-profile", ["file", "profile"]), ("test-flows", ["file", "profile", "out"])):
        c = command(name, *paths)
        c.add_argument("-p", "--protocol", default="modbus")
        c.add_argument("-m", "--method", choices=["direct", "pca", "average"], default="direct")
        c.add_argument("-f", "--features", default=",".join(files.FLOW_NUMBERS))
        c.add_argument("--threshold", type=float, default=0.1)
    command("show-profile", "profile")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("weftline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "rate-profile":
        for r in sinks.profile_lines(rate_profile(spark, a.file, a.width)).toLocalIterator():
            print(r[0])
    elif a.command == "rate-detect":
        print(*sinks.markdown(rate_detect(spark, a.file, files.read_profiles(spark, a.profile), a.width)), sep="\n")
    elif a.command in ("check", "learn"):
        presplit = a.format == "conversations"
        valid = conversations(spark, a.valid, presplit, a.width)
        if a.command == "learn":
            out = automata.learn(valid) if a.atype == "pa" else automata.transitions(valid)
        else:
            out = check(valid, conversations(spark, a.inspected, presplit, a.width), a.alg, a.atype == "pa")
        print(*sinks.markdown(out), sep="\n")
    elif a.command == "show-profile":
        print(scoring.Profile.load(spark, a.profile).to_json())
    else:
        df = files.source(a.protocol)(spark, a.file)
        names = a.features.split(",")
        if a.command == "export-flows":
            sinks.write_csv(df, a.out)
        elif a.command == "build-profile":
            scoring.build_profile(scoring.assemble(df, names), a.method, names=names).save(spark, a.profile)
        else:
            profile = scoring.Profile.load(spark, a.profile)
            scored = profile.score(scoring.assemble(df, profile.features))
            sinks.write_json(scored, f"{a.out}/all")
            sinks.write_json(scoring.detected(scored, a.threshold), f"{a.out}/detected")


if __name__ == "__main__":
    main()
