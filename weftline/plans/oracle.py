"""The queries' results as DuckDB SQL over the driver's tables."""

from __future__ import annotations

_P = """base AS (SELECT event_id AS seq, epoch_us(ts) AS us, CAST(json_extract_string(props, '$.k') AS INT) AS k, user_id, event_type, value,
 CAST(round(value * 10) AS BIGINT) AS octets, CAST(floor(value) AS INT) AS iec_len, event_id % 2 = 0 AS up, 'c' || user_id AS client, 's' || (user_id % 5) AS server,
 CAST(40000 + user_id AS INT) AS client_port FROM events),
p AS (SELECT *, CASE WHEN up THEN client ELSE server END AS src_ip, CASE WHEN up THEN server ELSE client END AS dst_ip,
 CASE WHEN up THEN client_port ELSE 502 END AS src_port, CASE WHEN up THEN 502 ELSE client_port END AS dst_port,
 (us - 1704067200000000) / 1e6 AS rel_time, k % 8 AS cot, CASE WHEN k % 10 = 9 THEN '0x00000001' ELSE '0x00000000' END AS fmt,
 ([1,2,3,4,5,6,7,8,15,16,20,21,22,23,24,43,99])[k % 17 + 1] AS fc, event_type = 'error' AS error, 'p' || (user_id % 10) AS model, us < 1705363200000000 AS train FROM base)"""


def _p(sql: str) -> str:
    return f"WITH {_P}{sql}"


def _window(width: int) -> str:
    return f"(us // {width}) * {width}"


_METRICS = ", ".join(
    f"count(*) FILTER (WHERE {c}) AS {s}_packets, CAST(coalesce(sum(octets) FILTER (WHERE {c}), 0) AS BIGINT) AS {s}_octets, min(us) FILTER (WHERE {c}) AS {s}_first, max(us) FILTER (WHERE {c}) AS {s}_last"
    for s, c in (("fwd", "up"), ("rev", "NOT up"))
)
_DAY, _SIX = 86_400_000_000, 21_600_000_000
_FLOW = f"SELECT 'TCP' AS proto, client, server, 502 AS server_port, {_window(_DAY)} AS window_start, {_METRICS} FROM p GROUP BY client, server, window_start"
_FUNCTIONS = {"read_coils": 1, "read_discrete": 2, "read_holding": 3, "read_input": 4, "read_file": 20, "read_fifo": 24, "write_coil": 5, "write_register": 6, "write_coils": 15, "write_registers": 16, "write_file": 21, "mask_write": 22, "read_write": 23, "diagnostic": 8}
_ANSWERS = """count(*) FILTER (WHERE up AND fc IN (7, 11, 12, 17, 43)) AS other_requests, count(*) FILTER (WHERE up AND fc = 99) AS undefined_requests,
 count(*) FILTER (WHERE NOT up AND NOT error) AS responses_success, count(*) FILTER (WHERE NOT up AND error) AS responses_error, CAST(0 AS BIGINT) AS malformed_requests, CAST(0 AS BIGINT) AS malformed_responses"""

_TAGS = """, m AS (SELECT *, fmt || '.' || cot AS tag, k % 5 AS items, src_ip || ':' || src_port || '-' || dst_ip || ':' || dst_port AS key FROM p),
t AS (SELECT tag, row_number() OVER (ORDER BY min(seq)) AS idx FROM m GROUP BY tag)"""

_DELTAS = """, d AS (SELECT seq, rel_time AS t, train, src_ip AS src, dst_ip AS dst, least(src_ip, dst_ip) || '|' || greatest(src_ip, dst_ip) AS pair, src_ip || ':' || dst_ip AS direction FROM p {where}),
i AS (SELECT *, t - coalesce(lag(t) OVER (PARTITION BY pair ORDER BY seq), 0e0) AS delta, row_number() OVER (PARTITION BY direction ORDER BY seq) AS rank FROM d)"""


def _deltas(where: str = "", name: str = "") -> str:
    out = _DELTAS.format(where=where)
    return out.replace(" d AS", f" d{name} AS").replace("i AS", f"i{name} AS").replace("FROM d)", f"FROM d{name})") if name else out


def _placed(name: str = "", event_time: bool = False) -> str:
    n = "CAST(floor(t / 86400e0) AS BIGINT) + 1" if event_time else "rank + least(1, min(CAST(floor(t / 86400e0) AS BIGINT) + 1 - rank) OVER (PARTITION BY direction ORDER BY rank ROWS UNBOUNDED PRECEDING))"
    return f", w{name} AS (SELECT *, {n} AS n FROM i{name})"


def _counts(name: str = "") -> str:
    return f""", g{name} AS (SELECT direction, n, count(*) AS total, count(*) FILTER (WHERE delta < 3600e0) AS range1, count(*) FILTER (WHERE delta >= 3600e0) AS range2 FROM w{name} GROUP BY ALL),
s{name} AS (SELECT direction, unnest(range(1, max(n))) AS n FROM g{name} GROUP BY direction HAVING max(n) > 1),
c{name} AS (SELECT direction, n, coalesce(total, 0) AS total, coalesce(range1, 0) AS range1, coalesce(range2, 0) AS range2 FROM s{name} LEFT JOIN g{name} USING (direction, n))"""


_CANDIDATES = ", q AS (SELECT direction, quantile_cont(delta, 0.25) AS q25, quantile_cont(delta, 0.5) AS q50, avg(delta) AS mean, quantile_cont(delta, 0.75) AS q75 FROM i WHERE rank > 1 GROUP BY direction)"
_STATS = """, e AS (SELECT direction, u.ord, u.candidate FROM (SELECT direction, unnest([{'ord': 0, 'candidate': q25}, {'ord': 1, 'candidate': q50}, {'ord': 2, 'candidate': mean}, {'ord': 3, 'candidate': q75}]) AS u FROM q) WHERE u.candidate > 0),
g AS (SELECT direction, ord, candidate, n, count(*) FILTER (WHERE delta < candidate) AS r1, count(*) FILTER (WHERE delta >= candidate) AS r2 FROM w JOIN e USING (direction) GROUP BY ALL),
s AS (SELECT direction, ord, candidate, unnest(range(1, max(n))) AS n FROM g GROUP BY direction, ord, candidate HAVING max(n) > 1),
z AS (SELECT direction, ord, candidate, avg(coalesce(r1, 0)) AS mean_range1, stddev_samp(coalesce(r1, 0)) AS std_range1, avg(coalesce(r2, 0)) AS mean_range2, stddev_samp(coalesce(r2, 0)) AS std_range2 FROM s LEFT JOIN g USING (direction, ord, candidate, n) GROUP BY ALL)"""


def _profile(name: str, sigma: str) -> str:
    bands = ", ".join(f"greatest(m_{c}, 0.34e0) {sign} {sigma} * s_{c} AS {c}_{e}" for c in ("total", "range1", "range2") for sign, e in (("-", "lo"), ("+", "hi")))
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in ("total", "range1", "range2"))
    return f""", b AS (SELECT direction, avg(total) AS m, stddev_samp(total) AS sd FROM c{name} GROUP BY direction),
f AS (SELECT direction, {stats} FROM c{name} JOIN b USING (direction) WHERE m <= 0.34 OR sd IS NULL OR total BETWEEN m - {sigma} * sd AND m + {sigma} * sd GROUP BY direction),
r AS (SELECT direction, {bands}, CASE WHEN s_total IS NULL THEN 'insufficient' ELSE 'ok' END AS status FROM f)"""


_BANDS = ", ".join(f"round({c}_{e}, 6) AS {c}_{e}" for c in ("total", "range1", "range2") for e in ("lo", "hi"))

_WORDS = """, x AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1) // 3 AS chunk FROM p),
words AS (SELECT model, min(seq) AS ord, string_agg(event_type, ',' ORDER BY seq) AS word, count(*) AS len, list(event_type ORDER BY seq) AS l, (min(us) - 1704067200000000) // 86400000000 AS win, min(us) < 1705363200000000 AS train FROM x GROUP BY model, user_id, chunk),
tr AS (SELECT * FROM words WHERE train), te AS (SELECT * FROM words WHERE NOT train)"""
_TREE = """, cut AS (SELECT model, l, unnest(range(0, len + 1)) AS i FROM tr), pre AS (SELECT model, array_to_string(l[1:i], ',') AS prefix, i AS depth, CASE WHEN i > 0 THEN array_to_string(l[1:i-1], ',') END AS src, CASE WHEN i > 0 THEN l[i] END AS symbol, count(*) AS n FROM cut GROUP BY ALL)"""
_DIST = """, golden AS (SELECT model, word, count(*) / CAST(sum(count(*)) OVER (PARTITION BY model) AS DOUBLE) AS p2 FROM tr GROUP BY model, word)"""
_DISTANCE = """, mine AS (SELECT model, win, word, count(*) / CAST(sum(count(*)) OVER (PARTITION BY model, win) AS DOUBLE) AS p1 FROM te GROUP BY model, win, word),
k2 AS (SELECT DISTINCT model, win FROM mine), uni AS (SELECT model, win, word FROM mine UNION SELECT k2.model, win, word FROM k2 JOIN golden USING (model)),
heard AS (SELECT model, win, CASE WHEN model IN (SELECT model FROM golden) THEN least(1e0, sqrt(sum((coalesce(p1, 0) - coalesce(p2, 0)) ** 2))) ELSE 1e0 END AS distance FROM uni LEFT JOIN mine USING (model, win, word) LEFT JOIN golden USING (model, word) GROUP BY model, win),
span AS (SELECT model, unnest(range((SELECT min(win) FROM te), max(win) + 1)) AS win FROM te GROUP BY model),
dist AS (SELECT model, win, coalesce(distance, CASE WHEN model IN (SELECT model FROM golden WHERE word <> '') THEN 1e0 ELSE 0e0 END) AS distance FROM span LEFT JOIN heard USING (model, win))"""



def _near(centre: float) -> str:
    """Squared distance of a flow, scaled as the watched profile is, to a centre that is the same on every axis."""
    return " + ".join(f"({c} / {s}e0 - {centre}e0) ** 2" for c, s in (("fwd_packets", 10), ("fwd_octets", 10000), ("rev_packets", 10), ("rev_octets", 10000)))


_V = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}" for i in range(8))
_VEC = f"WITH v AS (SELECT vec_id, label, {_V} FROM embeddings)"


def _clusters(k: int, n: str) -> str:
    """Centres of label % k, distances to the nearest, and variances."""
    centre = ", ".join(f"avg(f{i}) AS g{i}" for i in range(8))
    d = " + ".join(f"(f{i} - g{i}) ** 2" for i in range(8))
    return f""", ce{n} AS (SELECT row_number() OVER (ORDER BY label % {k}) AS cluster, {centre} FROM v GROUP BY label % {k}),
al{n} AS (SELECT vec_id, cluster, {d} AS distance, row_number() OVER (PARTITION BY vec_id ORDER BY {d}, cluster) AS r FROM v, ce{n}),
a{n} AS (SELECT vec_id, cluster, distance FROM al{n} WHERE r = 1),
va{n} AS (SELECT cluster, CASE WHEN count(distance) < 2 THEN 1.401298464324817e-45 ELSE greatest(avg(distance * distance), 1.401298464324817e-45) END AS variance FROM ce{n} LEFT JOIN a{n} USING (cluster) GROUP BY cluster)"""


_ENSEMBLE = _VEC + "".join(_clusters(k, str(i)) for i, k in enumerate((10, 5, 2))) + "".join(f", sc{i} AS (SELECT vec_id, 1 - least(distance / (6 * sqrt(variance)), 1e0) AS s{i} FROM a{i} JOIN va{i} USING (cluster))" for i in range(3)) + ", sc AS (SELECT * FROM sc0 JOIN sc1 USING (vec_id) JOIN sc2 USING (vec_id))"
_DB = ", s AS (SELECT cluster, avg(sqrt(distance)) AS s FROM a0 GROUP BY cluster), q AS (SELECT x.cluster, max((x.s + y.s) / sqrt(" + " + ".join(f"(c.g{i} - e.g{i}) ** 2" for i in range(8)) + ")) AS w FROM s x JOIN s y ON x.cluster <> y.cluster JOIN ce0 c ON c.cluster = x.cluster JOIN ce0 e ON e.cluster = y.cluster GROUP BY x.cluster)"
_JUDGED = "WITH j AS (SELECT quality = 1 AS t, n_chars > 1000 AS p, least(n_chars / 5000e0, 1e0) AS score FROM labels JOIN documents USING (doc_id))"

ORACLES: dict[str, str] = {
    "fl_biflow_key": _p(" SELECT seq, 'TCP' AS proto, client, client_port, server, 502 AS server_port FROM p"),
    "fl_multiflow_key": _p(" SELECT seq, 'TCP' AS proto, client, server, 502 AS server_port FROM p"),
    "fl_multiflow_window": _p(" " + _FLOW.replace(str(_DAY), str(_SIX))),
    "fl_biflow_then_rollup": _p(f", b AS (SELECT client, server, client_port, {_window(_SIX)} AS window_start, {_METRICS}, arg_min(iec_len, seq) AS label FROM p GROUP BY ALL) SELECT 'TCP' AS proto, client, server, 502 AS server_port, window_start, "
        + ", ".join(f"CAST({'sum' if k in ('packets', 'octets') else 'min' if k == 'first' else 'max'}({s}_{k}) AS BIGINT) AS {s}_{k}" for s in ("fwd", "rev") for k in ("packets", "octets", "first", "last")) + ", CAST(sum(label) AS BIGINT) AS label FROM b GROUP BY client, server, window_start"),
    "fl_flow_duration": _p(f", f AS ({_FLOW}) SELECT proto, client, server, server_port, window_start, round(coalesce((fwd_last - fwd_first) / 1e6, 0), 6) AS fwd_duration, round(coalesce((rev_last - rev_first) / 1e6, 0), 6) AS rev_duration FROM f"),
    "fl_flat_row": _p(f', f AS ({_FLOW}) SELECT proto, client, server, server_port, window_start, CAST(fwd_packets AS DOUBLE) AS "ForwardMetricsPackets", CAST(fwd_octets AS DOUBLE) AS "ForwardMetricsOctets", CAST(rev_packets AS DOUBLE) AS "ReverseMetricsPackets", CAST(rev_octets AS DOUBLE) AS "ReverseMetricsOctets", coalesce((fwd_last - fwd_first) / 1e6, 0e0) AS "ForwardMetricsDuration", coalesce((rev_last - rev_first) / 1e6, 0e0) AS "ReverseMetricsDuration" FROM f'),
    "fl_anchored_windows": _p(f", a AS (SELECT min(us) AS o FROM p), x AS (SELECT (us - o) // {_DAY} AS i, o FROM p, a) SELECT lpad(CAST(i AS VARCHAR), 4, '0') AS label, o + i * {_DAY} AS window_start, count(*) AS packets FROM x WHERE i < 20 GROUP BY ALL"),
    "fl_modbus_counters": _p(f" SELECT server, {_window(_DAY)} AS window_start, " + ", ".join(f"count(*) FILTER (WHERE up AND fc = {c}) AS {k}_requests" for k, c in _FUNCTIONS.items()) + f", {_ANSWERS} FROM p GROUP BY server, window_start"),
    "fl_modbus_compact": _p(f" SELECT server, {_window(_DAY)} AS window_start, count(*) FILTER (WHERE up AND fc IN (1, 2, 3, 4, 20, 24)) AS read_requests, count(*) FILTER (WHERE up AND fc IN (5, 6, 15, 16, 21, 22, 23)) AS write_requests, count(*) FILTER (WHERE up AND fc = 8) AS diagnostic_requests, {_ANSWERS} FROM p GROUP BY server, window_start"),
    "fl_packet_label_zip": _p(", a AS (SELECT row_number() OVER (ORDER BY seq) AS rn, seq, octets FROM p), b AS (SELECT row_number() OVER (ORDER BY doc_id) AS rn, toxic FROM labels) SELECT rn, seq, octets, toxic FROM a JOIN b USING (rn)"),
    "fl_port_filter": _p(" SELECT seq, src_port, dst_port FROM p WHERE 502 IN (src_port, dst_port)"),
    "iec_tags": _p(_TAGS + " SELECT tag, CAST(idx AS INT) AS idx FROM t UNION ALL SELECT '*', 0"),
    "iec_unknown_tag": _p(_TAGS + ", u AS (SELECT tag, row_number() OVER (ORDER BY min(seq)) AS i FROM m WHERE train AND k < 50 GROUP BY tag) SELECT CAST(coalesce(i, 0) AS INT) AS idx, count(*) AS n FROM m LEFT JOIN u USING (tag) WHERE NOT train GROUP BY 1"),
    "iec_tag_vector": _p(_TAGS + " SELECT seq, array_to_string(list_transform(range(17), lambda j: CASE WHEN j = idx THEN iec_len ELSE 0 END), ',') AS v FROM m JOIN t USING (tag)"),
    "iec_window_aggregate": _p(_TAGS + f", z AS (SELECT *, {_window(_DAY)} AS window_start FROM m JOIN t USING (tag)) SELECT key, window_start, min(seq) AS label, count(*) AS n_flows, CAST(sum(octets) AS BIGINT) AS bytes, count(*) AS packets, CAST(sum(iec_len) AS BIGINT) AS length, CAST(sum(items) AS BIGINT) AS items, min(us) AS start_us, "
        + ", ".join("array_to_string([" + ", ".join(f"CAST(coalesce(sum({c}) FILTER (WHERE idx = {i}), 0) AS BIGINT)" for i in range(17)) + f"], ',') AS {n}" for c, n in (("iec_len", "length_vector"), ("items", "items_vector"))) + " FROM z GROUP BY key, window_start"),
    "goose_tag_pivot": _p(" SELECT client, server, CAST(sum(octets) AS BIGINT) AS bytes, count(DISTINCT k % 7) AS n_states, count(DISTINCT substr(md5(event_type || '|' || cot), 1, 8)) AS n_tags FROM p GROUP BY client, server"),
    "sp_pairs": _p(_deltas() + " SELECT seq, pair, src = first_value(src) OVER (PARTITION BY pair ORDER BY seq) AS canonical FROM d"),
    "sp_interarrival": _p(_deltas() + " SELECT seq, direction, rank, round(delta, 6) AS delta FROM i"),
    "sp_describe": _p(_deltas() + " SELECT direction, count(*) AS count, " + ", ".join(f"round({e} + 1e-7, 6) AS {n}" for n, e in (("mean", "avg(delta)"), ("std", "stddev_samp(delta)"), ("min", "min(delta)"), ("q25", "quantile_cont(delta, 0.25)"), ("q50", "quantile_cont(delta, 0.5)"), ("q75", "quantile_cont(delta, 0.75)"), ("max", "max(delta)"))) + " FROM i GROUP BY direction"),
    "sp_candidates": _p(_deltas() + _CANDIDATES + " SELECT direction, round(q25 + 1e-7, 6) AS q25, round(q50 + 1e-7, 6) AS q50, round(mean + 1e-7, 6) AS mean, round(q75 + 1e-7, 6) AS q75 FROM q"),
    "sp_window_counts": _p(_deltas() + _placed() + _counts() + " SELECT * FROM c"),
    "sp_window_counts_event_time": _p(_deltas() + _placed(event_time=True) + _counts() + " SELECT * FROM c"),
    "sp_candidate_stats": _p(_deltas() + _CANDIDATES + _placed() + _STATS + " SELECT direction, ord, round(candidate + 1e-7, 6) AS candidate, round(mean_range1, 6) AS mean_range1, round(std_range1, 6) AS std_range1, round(mean_range2, 6) AS mean_range2, round(std_range2, 6) AS std_range2 FROM z"),
    "sp_split_point": _p(_deltas() + _CANDIDATES + _placed() + _STATS + ", y AS (SELECT direction, ord, candidate, 0 AS r, mean_range1 AS m, std_range1 AS sd FROM z UNION ALL SELECT direction, ord, candidate, 1, mean_range2, std_range2 FROM z), o AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY sd, ord, r) AS rn FROM y WHERE m - 3 * sd > 0) SELECT direction, round(coalesce(candidate, 0e0) + 1e-7, 6) AS split FROM (SELECT DISTINCT direction FROM z) LEFT JOIN (SELECT * FROM o WHERE rn = 1) USING (direction)"),
    "sp_profile": _p(_deltas("WHERE train") + _placed() + _counts() + _profile("", "3") + f" SELECT direction, {_BANDS}, status FROM r"),
    "sp_outliers": _p(_deltas("WHERE train", "1") + _placed("1") + _counts("1") + _profile("1", "1") + _deltas() + _placed() + _counts() + ", l AS ("
        + " UNION ALL ".join(f"SELECT direction, '{c}' AS series, n, CAST({c} NOT BETWEEN {c}_lo AND {c}_hi AS INT) AS o FROM c JOIN r USING (direction)" for c in ("total", "range1", "range2")) + "), h AS (SELECT *, lead(o, 1) OVER x AS a, lead(o, 2) OVER x AS b2 FROM l WINDOW x AS (PARTITION BY direction, series ORDER BY n)) SELECT direction, series, n FROM h WHERE b2 IS NOT NULL AND o + a + b2 >= 2"),
    "sp_unprofiled": _p(_deltas() + " SELECT DISTINCT direction FROM d WHERE direction NOT IN (SELECT direction FROM d WHERE train AND src LIKE 'c%' AND length(src) <= 2)"),
    "at_iframes": _p(" SELECT seq, fmt FROM p WHERE k % 10 <> 9"),
    "at_pairs": _p(" SELECT array_to_string(list_sort([src_ip || ':' || src_port, dst_ip || ':' || dst_port]), '|') AS pair, count(*) AS n, min(seq) AS first FROM p GROUP BY 1"),
    "at_dense_windows": _p(", a AS (SELECT model AS pair, CAST(floor(rel_time / 7200) AS BIGINT) AS win FROM p), b AS (SELECT pair, unnest(range(0, max(win) + 1)) AS win FROM a GROUP BY pair), c AS (SELECT pair, win, count(*) AS n FROM a GROUP BY ALL) SELECT pair, win, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (pair, win)"),
    "at_smoothing_windows": _p(" SELECT model, width, CAST(floor(rel_time / width) AS BIGINT) AS win, count(*) AS n FROM p, (VALUES (CAST(86400 AS BIGINT)), (172800)) w(width) GROUP BY ALL"),
    "at_presplit_parse": _p(" SELECT seq, k || '.' || cot || ' 7.n' AS word FROM p"),
    "at_conversations": f"""WITH RECURSIVE {_P}, m AS (SELECT seq, model AS pair, 100 + k % 30 AS asdu, (100 + k % 30) || '.' || cot AS symbol, ([3, 6, 7, 10, 13, 20, 44, 5])[cot + 1] AS c FROM p WHERE k % 10 <> 9),
o AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY seq) AS r FROM m WHERE c <> 3),
walk AS (SELECT pair, r, seq, symbol, c, seq AS first_seq, CASE WHEN asdu = 122 THEN 'FILETRANSFER' WHEN c = 6 THEN 'GENERAL_ACT' WHEN c = 7 THEN 'GENERAL' ELSE 'UNKNOWN' END AS kind,
  false AS passed, asdu = 122 OR c NOT IN (10, 44, 45, 46, 47) AS open FROM o WHERE r = 1
 UNION ALL SELECT pair, r, seq, symbol, c, CASE WHEN stays THEN first_seq ELSE seq END, kind, stays AND passed, kind = 'FILETRANSFER' OR c NOT IN (10, 44, 45, 46, 47) FROM
  (SELECT * EXCLUDE (kind), CASE WHEN stays THEN kind WHEN asdu = 122 THEN 'FILETRANSFER' WHEN c = 6 THEN 'GENERAL_ACT' WHEN c = 7 THEN 'GENERAL' ELSE 'UNKNOWN' END AS kind FROM
   (SELECT * REPLACE (passed OR middle AS passed), open AND (middle OR NOT (passed OR middle)) AS stays FROM
    (SELECT o.pair, o.r, o.seq, o.symbol, o.asdu, o.c, w.first_seq, w.kind, w.passed, w.open,
      w.open AND ((w.kind = 'FILETRANSFER' AND o.asdu BETWEEN 123 AND 127) OR (w.kind = 'GENERAL' AND o.c NOT IN (6, 7)) OR (w.kind = 'GENERAL_ACT' AND o.c <> 6)) AS middle
     FROM walk w JOIN o ON o.pair = w.pair AND o.r = w.r + 1)))),
word AS (SELECT pair, first_seq, kind, string_agg(symbol, ',' ORDER BY seq) AS word FROM walk GROUP BY ALL)
SELECT pair, 'c' || first_seq AS conv, first_seq, kind, word FROM word UNION ALL SELECT pair, 's' || seq, seq, 'SPONTANEOUS', symbol FROM m WHERE c = 3""",
    "at_message_classes": _p(", a AS (SELECT 100 + k % 30 AS asdu, ([3, 6, 7, 10, 13, 20, 44, 5])[cot + 1] AS c FROM p WHERE k % 10 <> 9), b AS (SELECT *, CASE WHEN asdu = 122 THEN 'FILETRANSFER' WHEN c = 6 THEN 'GENERAL_ACT' WHEN c = 3 THEN 'SPONTANEOUS' WHEN c = 7 THEN 'GENERAL' ELSE 'UNKNOWN' END AS kind FROM a) SELECT kind, c = 3 AS spontaneous, kind IN ('GENERAL', 'GENERAL_ACT', 'UNKNOWN') AND c IN (10, 44, 45, 46, 47) AS final, asdu IN (123, 124, 70, 36) OR c IN (3, 10, 44, 45, 46, 47) AS complete, count(*) AS n FROM b GROUP BY ALL"),
    "at_pta_prefix_counts": _p(_WORDS + _TREE + " SELECT model, prefix, CAST(depth AS INT) AS depth, n FROM pre"),
    "at_pta_transitions": _p(_WORDS + _TREE + " SELECT a.model, a.src, a.symbol, a.prefix AS dst, a.n, round(a.n / CAST(b.n AS DOUBLE), 6) AS p FROM pre a JOIN pre b ON a.model = b.model AND a.src = b.prefix AND a.depth = b.depth + 1"),
    "at_pta_finals": _p(_WORDS + _TREE + ", f AS (SELECT model, word, count(*) AS ends FROM tr GROUP BY ALL) SELECT f.model, word AS state, ends AS n, round(ends / CAST(n AS DOUBLE), 6) AS p FROM f JOIN pre ON f.model = pre.model AND word = prefix"),
    "at_word_logprob": _p(_WORDS + _DIST + " SELECT model, word, round(ln(p2), 6) AS log_p FROM (SELECT DISTINCT model, word FROM te) LEFT JOIN golden USING (model, word)"),
    "at_member_anomalies": _p(_WORDS + " SELECT model, win, ord, word FROM te WHERE (model, word) NOT IN (SELECT (model, word) FROM tr)"),
    "at_bad_conversations": _p(_WORDS + " SELECT DISTINCT model, word FROM te WHERE (model, word) NOT IN (SELECT (model, word) FROM tr)"),
    "at_train_accuracy": _p(_WORDS + ", o AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ord) AS rn, count(*) OVER (PARTITION BY model) AS c FROM words), f AS (SELECT *, rn <= floor(c * 0.33e0) AS first FROM o), h AS (SELECT DISTINCT model, word, 1 AS hit FROM f WHERE first) SELECT model, count(*) AS n_test, count(*) FILTER (WHERE hit IS NULL) AS n_miss, round(avg(CAST(hit IS NOT NULL AS INT)), 6) AS accuracy FROM f LEFT JOIN h USING (model, word) WHERE NOT first GROUP BY model"),
    "at_distr_distance": _p(_WORDS + _DIST + _DISTANCE + " SELECT model, win, round(distance, 6) AS distance FROM dist"),
    "at_suppress_last_window": _p(_WORDS + _DIST + _DISTANCE + " SELECT model, win, round(distance, 6) AS distance FROM dist WHERE win < (SELECT max(win) FROM dist)"),
    "at_distr_min_model": _p(_WORDS.replace("tr AS (SELECT * FROM words", "tr AS (SELECT * REPLACE (model || CASE WHEN ord % 2 = 0 THEN 'a' ELSE 'b' END AS model) FROM words").replace("te AS (SELECT * FROM words WHERE", "te AS (SELECT words.* REPLACE (model || h AS model) FROM words, (VALUES ('a'), ('b')) hh(h) WHERE") + _DIST + _DISTANCE
        + ", y AS (SELECT substr(model, 1, 2) AS m, substr(model, 3) AS half, win, round(distance, 9) AS d FROM dist) SELECT m AS model, win, round(min(d), 6) AS distance, arg_min(half, {'d': d, 'h': half}) AS half FROM y GROUP BY m, win"),
    "at_distr_early_stop": _p(_WORDS.replace("tr AS (SELECT * FROM words", "tr AS (SELECT * REPLACE (model || CASE WHEN ord % 2 = 0 THEN 'a' ELSE 'b' END AS model) FROM words").replace("te AS (SELECT * FROM words WHERE", "te AS (SELECT words.* REPLACE (model || h AS model) FROM words, (VALUES ('a'), ('b')) hh(h) WHERE") + _DIST + _DISTANCE
        + ", y AS (SELECT substr(model, 1, 2) AS m, substr(model, 3) AS half, win, round(distance, 9) AS d FROM dist), z AS (SELECT *, min(d) OVER (PARTITION BY m, win ORDER BY half ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM y) SELECT m AS model, win, round(d, 6) AS distance, half FROM z WHERE l IS NULL OR l > 0.3"),
    "at_missing_word": _p(_WORDS + _DIST + ", l AS (SELECT model, win, word, p2 FROM (SELECT DISTINCT model, win FROM te) JOIN golden USING (model) ANTI JOIN te USING (model, win, word)), o AS (SELECT *, row_number() OVER (PARTITION BY model, win ORDER BY p2 DESC, word) AS rn FROM l) SELECT model, win, word, round(p2, 6) AS p FROM o WHERE rn = 1"),
    "at_subsequence": _p(_WORDS + " SELECT ord, ',' || word || ',' LIKE '%,view,%click,%' AS sub FROM words"),
    "ml_maxabs": f"{_VEC} SELECT vec_id, " + ", ".join(f"round(f{i} / max(abs(f{i})) OVER (), 5) AS f{i}" for i in range(8)) + " FROM v",
    "ml_avg_features": "WITH v AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) SELECT vec_id, round(list_min(e), 5) AS min, round(list_max(e), 5) AS max, round(list_avg(e), 5) AS mean, round(list_stddev_pop(e), 5) AS std FROM v",
    "ml_assign_fixed_centroids": _VEC + _clusters(10, "0") + " SELECT vec_id, CAST(cluster AS INT) AS cluster, round(distance, 5) AS distance FROM a0",
    "ml_cluster_variance": _VEC + _clusters(10, "0") + " SELECT CAST(cluster AS INT) AS cluster, round(variance, 5) AS variance FROM va0",
    "ml_davies_bouldin": _VEC + _clusters(10, "0") + _DB + " SELECT round(avg(w), 5) AS db FROM q",
    "ml_evaluation": _VEC + _clusters(10, "0") + _DB + ", k AS (SELECT cluster, label, count(*) AS n FROM a0 JOIN v USING (vec_id) GROUP BY ALL), t AS (SELECT *, CAST(sum(n) OVER () AS DOUBLE) AS w, sum(n) OVER (PARTITION BY cluster) AS c, sum(n) OVER (PARTITION BY label) AS l FROM k) SELECT (SELECT round(avg(distance), 5) FROM a0) AS average_distance, (SELECT round(avg(w), 5) FROM q) AS db, round(2 * sum(n / w * ln(n * w / (c * l))) / -sum(n / w * (ln(c / w) + ln(l / w))), 5) AS nmi FROM t",
    "ml_scores": _ENSEMBLE + " SELECT vec_id, round(s0, 5) AS s0, round(s1, 5) AS s1, round(s2, 5) AS s2 FROM sc",
    "ml_ensemble": _ENSEMBLE + " SELECT vec_id, round(greatest(s0, s1, s2), 5) AS max_score, round(least(s0, s1, s2), 5) AS min_score, round((s0 + s1 + s2) / 3, 5) AS average_score, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS best_model FROM sc",
    "ml_detected": _ENSEMBLE + " SELECT vec_id, round((s0 + s1 + s2) / 3, 5) AS average_score FROM sc WHERE (s0 + s1 + s2) / 3 >= 0 AND (s0 + s1 + s2) / 3 < 0.6",
    "ml_confusion": _JUDGED + ", n AS (SELECT count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND NOT p) AS tn, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn FROM j) SELECT *, round(tp / CAST(tp + fn AS DOUBLE), 6) AS tpr, round(tn / CAST(tn + fp AS DOUBLE), 6) AS spc, round(fp / CAST(fp + tn AS DOUBLE), 6) AS fpr FROM n",
    "ml_roc": _JUDGED + " SELECT i / 10e0 AS threshold, round(count(*) FILTER (WHERE t AND score >= i / 10e0) / CAST(count(*) FILTER (WHERE t) AS DOUBLE), 6) AS tpr, round(count(*) FILTER (WHERE NOT t AND score >= i / 10e0) / CAST(count(*) FILTER (WHERE NOT t) AS DOUBLE), 6) AS fpr FROM j, range(11) r(i) GROUP BY i",
    "plc_edges": _p(", a AS (SELECT seq, value > 50 AS v, coalesce(lag(value > 50) OVER (PARTITION BY user_id ORDER BY seq), true) AS b FROM p) SELECT seq, v AND NOT b AS rising, NOT v AND b AS falling FROM a WHERE v <> b"),
    "plc_up_counter": _p(", a AS (SELECT *, sum(CAST(event_type = 'error' AS INT)) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS r FROM p), c AS (SELECT seq, CAST(sum(CAST(event_type = 'click' AS INT)) OVER (PARTITION BY user_id, r ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS counter FROM a) SELECT seq, counter, counter >= 3 AS done FROM c"),
    "plc_on_delay": _p(", a AS (SELECT *, event_type <> 'error' AS v, sum(CAST(event_type = 'error' AS INT)) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS r FROM p) SELECT seq, v AND coalesce(rel_time - min(CASE WHEN v THEN rel_time END) OVER (PARTITION BY user_id, r ORDER BY seq ROWS UNBOUNDED PRECEDING) >= 172800, false) AS delayed FROM a"),
    "plc_moving_stats": _p(", a AS (SELECT seq, sum(octets) OVER w AS s, min(octets) OVER w AS lo, max(octets) OVER w AS hi, count(*) OVER w AS c FROM p WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS 49 PRECEDING)) SELECT seq, round(s / 50e0, 6) AS avg_n, CAST(CASE WHEN c < 50 THEN least(lo, 0) ELSE lo END AS DOUBLE) AS min_n, CAST(CASE WHEN c < 50 THEN greatest(hi, 0) ELSE hi END AS DOUBLE) AS max_n FROM a"),
    "st_watch_flows": _p(" " + _FLOW),
    "st_watch_scores": _p(f", f AS ({_FLOW}), d AS (SELECT proto, client, server, server_port, window_start, {_near(0.1)} AS a, {_near(0.5)} AS b, {_near(0.2)} AS c FROM f), s AS (SELECT *, 1 - least(least(a, b) / (6 * sqrt(CASE WHEN a <= b THEN 0.05e0 ELSE 0.2e0 END)), 1e0) AS s0, 1 - least(c / (6 * sqrt(0.1e0)), 1e0) AS s1 FROM d) SELECT proto, client, server, server_port, window_start, round(s0, 6) AS s0, round(s1, 6) AS s1, round((s0 + s1) / 2, 6) AS average_score FROM s"),
}
