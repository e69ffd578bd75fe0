"""name -> (spark, sf_dir) -> DataFrame: each operator over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import functions as X
from weftline import streaming
from weftline.operators import automata as A
from weftline.operators import flow, iec, plc, scoring
from weftline.operators import statistical as S
from weftline.sources import adapters as D

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SIX_HOURS = 21_600_000_000


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _key(df: DataFrame) -> DataFrame:
    parts = [f"flow_key.{f.name}" for f in df.schema["flow_key"].dataType]
    return df.select(*parts, *(c for c in df.columns if c != "flow_key"))


@query
def fl_biflow_key(spark, d):
    return D.packets(spark, d).select("seq", X.biflow_key().alias("k")).select("seq", "k.*")


@query
def fl_multiflow_key(spark, d):
    return D.packets(spark, d).select("seq", X.multiflow_key().alias("k")).select("seq", "k.*")


@query
def fl_multiflow_window(spark, d):
    return _key(flow.flows(flow.windowed(D.packets(spark, d), SIX_HOURS), X.multiflow_key()))


@query
def fl_biflow_then_rollup(spark, d):
    p = flow.windowed(D.packets(spark, d), SIX_HOURS)
    return _key(flow.rollup(flow.flows(p, X.biflow_key(), [F.min_by("iec_len", "seq").alias("label")])))


@query
def fl_flow_duration(spark, d):
    f = flow.flows(flow.windowed(D.packets(spark, d), D.DAY_US), X.multiflow_key())
    return _key(f.select("window_start", "flow_key", F.round(flow.duration_s("fwd_first", "fwd_last"), 6).alias("fwd_duration"), F.round(flow.duration_s("rev_first", "rev_last"), 6).alias("rev_duration")))


@query
def fl_flat_row(spark, d):
    return _key(flow.flat(flow.flows(flow.windowed(D.packets(spark, d), D.DAY_US), X.multiflow_key())))


@query
def fl_anchored_windows(spark, d):
    w = flow.first_windows(flow.windowed(D.packets(spark, d), D.DAY_US, None), 20)
    return w.groupBy(X.window_label(F.col("window_index")).alias("label"), "window_start").agg(F.count("*").alias("packets"))


@query
def fl_modbus_counters(spark, d):
    p = flow.windowed(D.packets(spark, d), D.DAY_US)
    return p.groupBy("server", "window_start").agg(*flow.counters(F.col("up"), F.col("error")))


@query
def fl_modbus_compact(spark, d):
    p = flow.windowed(D.packets(spark, d), D.DAY_US)
    return p.groupBy("server", "window_start").agg(*flow.counters(F.col("up"), F.col("error"))).select("server", "window_start", *flow.compact())


@query
def fl_packet_label_zip(spark, d):
    labels = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("row"), "toxic")
    return flow.zip_labels(D.packets(spark, d).select("seq", "octets"), labels).select("rn", "seq", "octets", "toxic")


@query
def fl_port_filter(spark, d):
    return D.packets(spark, d).where((F.col("src_port") == 502) | (F.col("dst_port") == 502)).select("seq", "src_port", "dst_port")


@query
def iec_tags(spark, d):
    return iec.tags(D.iec_messages(spark, d))


@query
def iec_unknown_tag(spark, d):
    m = D.iec_messages(spark, d)
    known = iec.tags(m.where("train and k < 50"))
    return iec.indexed(m.where("not train"), known).groupBy("idx").agg(F.count("*").alias("n"))


@query
def iec_tag_vector(spark, d):
    m, n = D.iec_messages(spark, d), 17
    v = iec.indexed(m, iec.tags(m)).select("seq", iec.vector(F.col("idx"), n, F.col("iec_len")).alias("v"))
    return v.select("seq", F.array_join(F.transform("v", lambda x: x.cast("long").cast("string")), ",").alias("v"))


@query
def iec_window_aggregate(spark, d):
    m = D.iec_messages(spark, d)
    t = iec.tags(m)
    g = iec.window_aggregate(iec.indexed(m, t), 17, ["key", "window_start"])
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("long").cast("string")), ",").alias(c)
    return g.select("key", "window_start", "label", "n_flows", "bytes", "packets", "length", "items", "start_us", text("length_vector"), text("items_vector"))


@query
def goose_tag_pivot(spark, d):
    m = D.packets(spark, d).withColumns({"state": F.col("k") % 7, "tag": F.substring(F.md5(F.concat_ws("|", "event_type", F.col("cot").cast("string"))), 1, 8)})
    g = iec.tag_pivot(m, ["client", "server"])
    return g.select("client", "server", F.aggregate(F.map_values("bytes_by_tag"), F.lit(0).cast("long"), lambda a, x: a + x).alias("bytes"), "n_states", F.size("bytes_by_tag").cast("long").alias("n_tags"))


@query
def sp_pairs(spark, d):
    return S.pairs(D.messages(spark, d)).select("seq", "pair", "canonical")


def _deltas(spark, d, train=None):
    m = D.messages(spark, d)
    return S.inter_arrivals(S.pairs(m if train is None else m.where(F.col("train") == train)))


def _micros(c):
    """Quartiles of whole microseconds end in quarters; a tenth more keeps both engines off the ties of rounding."""
    return F.round(F.col(c) + 1e-7, 6).alias(c)


@query
def sp_interarrival(spark, d):
    return _deltas(spark, d).select("seq", "direction", "rank", F.round("delta", 6).alias("delta"))


@query
def sp_describe(spark, d):
    t = S.describe(_deltas(spark, d), "delta", "direction")
    return t.select("direction", "count", *(_micros(c) for c in t.columns if c not in ("direction", "count")))


@query
def sp_candidates(spark, d):
    return S.candidates(_deltas(spark, d)).select("direction", *(_micros(c) for c in ("q25", "q50", "mean", "q75")))


@query
def sp_window_counts(spark, d):
    return S.counts(S.windows(_deltas(spark, d), 86400.0), F.lit(3600.0))


@query
def sp_window_counts_event_time(spark, d):
    return S.counts(S.windows(_deltas(spark, d), 86400.0, "event_time"), F.lit(3600.0))


def _stats(spark, d):
    t = _deltas(spark, d)
    return S.candidate_stats(t, S.candidates(t), 86400.0)


@query
def sp_candidate_stats(spark, d):
    return _stats(spark, d).select("direction", "ord", _micros("candidate"), *(F.round(c, 6).alias(c) for c in ("mean_range1", "std_range1", "mean_range2", "std_range2")))


@query
def sp_split_point(spark, d):
    return S.split_points(_stats(spark, d)).select("direction", _micros("split"))


@query
def sp_profile(spark, d):
    p = S.profile(S.counts(S.windows(_deltas(spark, d, True), 86400.0), F.lit(3600.0)))
    return p.select("direction", *(F.round(c, 6).alias(c) for c in p.columns if c not in ("direction", "status")), "status")


def _outliers(spark, d):
    p = S.profile(S.counts(S.windows(_deltas(spark, d, True), 86400.0), F.lit(3600.0)), sigma=1.0)
    return S.outliers(S.counts(S.windows(_deltas(spark, d), 86400.0), F.lit(3600.0)), p)


@query
def sp_outliers(spark, d):
    return _outliers(spark, d)


@query
def sp_unprofiled(spark, d):
    t = _deltas(spark, d, True).where("src like 'c%' and length(src) <= 2")
    return S.unprofiled(_deltas(spark, d), t.select("direction").distinct())


@query
def at_iframes(spark, d):
    return D.packets(spark, d).where(X.is_information_frame("fmt")).select("seq", "fmt")


@query
def at_pairs(spark, d):
    ends = [F.concat_ws(":", F.col(f"{s}_ip"), F.col(f"{s}_port").cast("string")) for s in ("src", "dst")]
    return D.packets(spark, d).groupBy(X.pair_key(*ends).alias("pair")).agg(F.count("*").alias("n"), F.min("seq").alias("first"))


@query
def at_dense_windows(spark, d):
    p = D.packets(spark, d).select(F.col("model").alias("pair"), A.dense_windows(F.col("rel_time"), 7200.0).alias("win"))
    return A.window_spine(p).join(p.groupBy("pair", "win").agg(F.count("*").alias("n")), ["pair", "win"], "left").select("pair", "win", F.coalesce("n", F.lit(0)).alias("n"))


@query
def at_smoothing_windows(spark, d):
    return A.smoothing_windows(D.packets(spark, d), F.col("rel_time"), (86400.0, 172800.0)).groupBy("model", F.col("width").cast("long").alias("width"), "win").agg(F.count("*").alias("n"))


@query
def at_presplit_parse(spark, d):
    text = F.concat(F.lit("<"), F.col("k").cast("string"), F.lit("."), F.col("cot").cast("string"), F.lit(">,x<1.2>,<7.n>"))
    return D.packets(spark, d).select("seq", F.array_join(X.parse_conversation(text), " ").alias("word"))


def _iec(spark, d):
    m = D.packets(spark, d).where(X.is_information_frame("fmt"))
    return m.select("seq", F.col("model").alias("pair"), (F.lit(100) + F.col("k") % 30).alias("asdu"), F.get(F.array(*map(F.lit, (3, 6, 7, 10, 13, 20, 44, 5))), F.col("cot")).alias("cot"), F.concat_ws(".", (F.lit(100) + F.col("k") % 30).cast("string"), F.col("cot").cast("string")).alias("symbol"))


@query
def at_conversations(spark, d):
    return A.conversations(_iec(spark, d)).select("pair", "conv", "first_seq", "kind", F.array_join("word", ",").alias("word"))


@query
def at_message_classes(spark, d):
    m = _iec(spark, d).withColumn("kind", X.initial_type("asdu", "cot"))
    return m.groupBy("kind", X.is_spontaneous("cot").alias("spontaneous"), X.is_final("kind", "cot").alias("final"), X.is_complete("asdu", "cot").alias("complete")).agg(F.count("*").alias("n"))


def _train(spark, d):
    return D.words(spark, d).where("train")


def _test(spark, d):
    return D.words(spark, d).where("not train")


_text = lambda c: F.array_join(c, ",").alias(c)


@query
def at_pta_prefix_counts(spark, d):
    return A.prefixes(_train(spark, d)).select("model", _text("prefix"), F.size("prefix").alias("depth"), "n")


@query
def at_pta_transitions(spark, d):
    return A.transitions(_train(spark, d)).select("model", _text("src"), "symbol", _text("dst"), "n", F.round("p", 6).alias("p"))


@query
def at_pta_finals(spark, d):
    return A.finals(_train(spark, d)).select("model", _text("state"), "n", F.round("p", 6).alias("p"))


@query
def at_word_logprob(spark, d):
    return A.log_probabilities(_test(spark, d), _train(spark, d)).select("model", _text("word"), F.round("log_p", 6).alias("log_p"))


@query
def at_member_anomalies(spark, d):
    return A.anomalies(_test(spark, d), _train(spark, d)).select("model", "win", "ord", _text("word"))


@query
def at_bad_conversations(spark, d):
    return A.anomalies(_test(spark, d), _train(spark, d)).select("model", _text("word")).distinct()


@query
def at_train_accuracy(spark, d):
    return A.accuracy(D.words(spark, d)).select("model", "n_test", "n_miss", F.round("accuracy", 6).alias("accuracy"))


@query
def at_distr_distance(spark, d):
    return A.distances(_test(spark, d), _train(spark, d)).select("model", "win", F.round("distance", 6).alias("distance"))


@query
def at_suppress_last_window(spark, d):
    return A.drop_last(A.distances(_test(spark, d), _train(spark, d))).select("model", "win", F.round("distance", 6).alias("distance"))


def _many_models(spark, d):
    """Each pair's words against the models of even and odd users of the pair."""
    half = F.when(F.col("ord") % 2 == 0, "a").otherwise("b")
    train = _train(spark, d).withColumn("half", half)
    test = _test(spark, d).withColumn("half", F.explode(F.array(F.lit("a"), F.lit("b"))))
    key = F.struct("model", "half").alias("m")
    return A.distances(test.select(key, "win", "word"), train.select(key, "word"), model="m").select("m.*", "win", F.round("distance", 9).alias("distance"))


@query
def at_distr_min_model(spark, d):
    return A.best_model(_many_models(spark, d), ["model", "win"], "half").select("model", "win", F.round("distance", 6).alias("distance"), "half")


@query
def at_distr_early_stop(spark, d):
    return A.until_near(_many_models(spark, d), ["model", "win"], "half", 0.3).select("model", "win", F.round("distance", 6).alias("distance"), "half")


@query
def at_alergia_explained(spark, d):
    return A.explained(_test(spark, d), _train(spark, d), 0.2).select("model", "win", F.round("distance", 6).alias("distance"), _text("word"), F.round("p", 6).alias("p"))


@query
def at_missing_word(spark, d):
    return A.missing_words(_test(spark, d), _train(spark, d)).select("model", "win", _text("word"), F.round("p", 6).alias("p"))


@query
def at_subsequence(spark, d):
    w = D.words(spark, d)
    return w.select("ord", X.is_subsequence(F.array(F.lit("view"), F.lit("click")), F.col("word")).alias("sub"))


@query
def at_alergia_states(spark, d):
    return A.learn(_train(spark, d)).select("model", "src", "symbol", "dst", F.round("p", 6).alias("p"))


@query
def at_alergia_distance(spark, d):
    return A.learned_distances(_test(spark, d), _train(spark, d)).select("model", "win", F.round("distance", 6).alias("distance"))


@query
def at_reduce_models(spark, d):
    return A.reduce_windows(_train(spark, d), 0.5)


@query
def ml_maxabs(spark, d):
    v = scoring.maxabs(D.vectors(spark, d))
    return v.select("vec_id", *(F.round(F.get("features", F.lit(i)), 5).alias(f"f{i}") for i in range(8)))


@query
def ml_avg_features(spark, d):
    v = scoring.averages(D.vectors(spark, d))
    return v.select("vec_id", *(F.round(F.get("features", F.lit(i)), 5).alias(c) for i, c in enumerate(("min", "max", "mean", "std"))))


def _fixed(spark, d):
    v = D.vectors(spark, d)
    centres = list(scoring.centroids(v).values())
    return scoring.distances(v, centres), centres


@query
def ml_assign_fixed_centroids(spark, d):
    return _fixed(spark, d)[0].select("vec_id", "cluster", F.round("distance", 5).alias("distance"))


@query
def ml_cluster_variance(spark, d):
    a, centres = _fixed(spark, d)
    return spark.createDataFrame([(i + 1, round(v, 5)) for i, v in enumerate(scoring.variances(a, len(centres)))], "cluster int, variance double")


@query
def ml_davies_bouldin(spark, d):
    a, centres = _fixed(spark, d)
    return spark.createDataFrame([(round(scoring.davies_bouldin(a, centres), 5),)], "db double")


@query
def ml_evaluation(spark, d):
    a, centres = _fixed(spark, d)
    e = scoring.evaluate(a, centres, "label")
    return spark.createDataFrame([(round(e.average_distance, 5), round(e.davies_bouldin, 5), round(e.mutual_information, 5))], "average_distance double, db double, nmi double")


def _ensemble(spark, d):
    v = D.vectors(spark, d)
    models = []
    for k in (10, 5, 2):
        c = list(scoring.centroids(v.withColumn("g", F.col("label") % k), "g").values())
        models.append(scoring.Clusters(c, scoring.variances(scoring.distances(v, c), len(c))))
    return scoring.Profile("direct", [1.0] * 8, [], [], models, []).score(v)


@query
def ml_scores(spark, d):
    return _ensemble(spark, d).select("vec_id", *(F.round(F.get("scores", F.lit(i)), 5).alias(f"s{i}") for i in range(3)))


@query
def ml_ensemble(spark, d):
    return _ensemble(spark, d).select("vec_id", *(F.round(c, 5).alias(c) for c in ("max_score", "min_score", "average_score")), "best_model")


@query
def ml_detected(spark, d):
    return scoring.detected(_ensemble(spark, d), 0.6).select("vec_id", F.round("average_score", 5).alias("average_score"))


@query
def ml_pca3(spark, d):
    p = scoring.build_profile(D.vectors(spark, d), "pca", ks=())
    return p.transform(D.vectors(spark, d)).select("vec_id", *(F.round(F.get("features", F.lit(i)), 5).alias(f"pc{i}") for i in range(3)))


@query
def ml_kmeans_profile(spark, d):
    v = D.vectors(spark, d)
    return scoring.build_profile(v).score(v).select("vec_id", F.round("average_score", 5).alias("average_score"), "best_model")


def _judged(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars")
    return spark.read.parquet(f"{d}/labels.parquet").join(docs, "doc_id").select("quality", (F.col("n_chars") > 1000).cast("int").alias("predicted"), F.least(F.col("n_chars") / F.lit(5000.0), F.lit(1.0)).alias("score"))


@query
def ml_confusion(spark, d):
    c = scoring.confusion(_judged(spark, d), "quality", "predicted")
    return c.select("tp", "tn", "fp", "fn", *(F.round(x, 6).alias(x) for x in ("tpr", "spc", "fpr")))


@query
def ml_roc(spark, d):
    r = scoring.roc(_judged(spark, d), "quality", "score", [i / 10 for i in range(11)])
    return r.select("threshold", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@query
def plc_edges(spark, d):
    return plc.edges(D.packets(spark, d), F.col("value") > 50, "user_id", "seq").where("rising or falling").select("seq", "rising", "falling")


@query
def plc_up_counter(spark, d):
    return plc.up_counter(D.packets(spark, d), F.col("event_type") == "click", F.col("event_type") == "error", "user_id", "seq", 3).select("seq", "counter", "done")


@query
def plc_on_delay(spark, d):
    return plc.on_delay(D.packets(spark, d), F.col("event_type") != "error", "user_id", "seq", "rel_time", 172800.0).select("seq", "delayed")


@query
def plc_moving_stats(spark, d):
    m = plc.moving_stats(D.packets(spark, d), "octets", "user_id", "seq")
    return m.select("seq", F.round("avg_n", 6).alias("avg_n"), F.col("min_n").cast("double").alias("min_n"), F.col("max_n").cast("double").alias("max_n"))


def _watched(spark, d):
    """(events as a file stream of flows, the folder of the stream): windows close behind the watermark, the last ones behind a row that stands after all."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    top = f"{shared.rstrip('/')}/weftline/stream-{uuid.uuid4().hex}"
    p = D.packets(spark, d).select("seq", F.timestamp_micros("us").alias("ts"), "us", "up", "octets", "proto", "src_ip", "dst_ip", "src_port", "dst_port")
    p.write.parquet(f"{top}/in/part=0")
    end = p.agg(F.max("us").alias("us")).select(F.lit(-1).cast("long").alias("seq"), F.timestamp_micros(F.col("us") + 3 * D.DAY_US).alias("ts"), (F.col("us") + 3 * D.DAY_US).alias("us"), F.lit(True).alias("up"), F.lit(0).cast("long").alias("octets"), F.lit("-").alias("proto"), *(F.lit("-").alias(c) for c in ("src_ip", "dst_ip")), *(F.lit(0).alias(c) for c in ("src_port", "dst_port")))
    end.write.parquet(f"{top}/in/part=1")
    stream = streaming.replay(spark, f"{top}/in/part=*", p.schema, 1000)
    return streaming.windowed_flows(stream, X.multiflow_key(), "1 day"), top


@query
def st_watch_flows(spark, d):
    flows, top = _watched(spark, d)
    q = flows.writeStream.outputMode("append").option("checkpointLocation", f"{top}/state").format("parquet").option("path", f"{top}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return _key(spark.read.schema(flows.schema).parquet(f"{top}/out").where("flow_key.proto <> '-'"))


#: Two fixed models of a flow's packets and octets to both sides.
WATCHED = scoring.Profile("direct", [10.0, 1e4, 10.0, 1e4], [], [], [scoring.Clusters([[0.1] * 4, [0.5] * 4], [0.05, 0.2]), scoring.Clusters([[0.2] * 4], [0.1])], ["fwd_packets", "fwd_octets", "rev_packets", "rev_octets"])


@query
def st_watch_scores(spark, d):
    """Each closed window scored as it closes; a batch that runs again overwrites what it wrote."""
    flows, top = _watched(spark, d)
    out = []

    def sink(batch: DataFrame, number: int) -> None:
        out.append(batch.schema)
        batch.write.mode("overwrite").parquet(f"{top}/scores/batch={number}")

    streaming.watch(flows, WATCHED, WATCHED.features, sink, f"{top}/state", once=True).awaitTermination()
    scored = spark.read.schema(out[0]).option("basePath", f"{top}/scores").parquet(f"{top}/scores/batch=*").where("flow_key.proto <> '-'")
    return _key(scored.select("flow_key", "window_start", *(F.round(F.get("scores", F.lit(i)), 6).alias(f"s{i}") for i in range(2)), F.round("average_score", 6).alias("average_score")))
