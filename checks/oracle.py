"""DuckDB building blocks: the same tables as ``tables.py``, as common table expressions."""

from __future__ import annotations

import re

PARTS: dict[str, str] = {}


def part(name: str, body: str) -> None:
    PARTS[name] = body


def rnd(expr: str, name: str | None = None) -> str:
    """Round like the Spark side: decimal ties are nudged the same way first.

    Sums differ in their last bits with the order of addition, so values from 1000
    up, where six decimals would show those bits, keep three.
    """
    x = f"({expr}) * 1.000000000001"
    return f"CASE WHEN abs({expr}) >= 1000 THEN round({x}, 3) ELSE round({x}, 6) END AS {name or expr}"


def query(select: str) -> str:
    """Prefix ``select`` with every part it mentions, in order."""
    needed: list[str] = []

    def visit(text: str, inside: str = "") -> None:
        for name in PARTS:
            if name not in needed and name != inside and re.search(rf"\b{name}\b", text):
                visit(PARTS[name], name)
                needed.append(name)

    visit(select)
    if not needed:
        return select
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {PARTS[n]}" for n in needed) + "\n" + select


part("t_pay", """MATERIALIZED (
  SELECT CAST(event_id AS VARCHAR) AS event_id, 'payments' AS domain,
    'merch_' || CAST(user_id % 10 AS VARCHAR) AS entity_key, event_id AS seq, ts AS ts_event,
    event_id % 97 = 0 AS corrupted, CASE WHEN event_id % 500 < 25 THEN 'fraud_pattern' END AS scenario_label,
    'txn_' || CAST(event_id AS VARCHAR) AS txn_id, 'acct_' || CAST(user_id AS VARCHAR) AS account, value AS amount,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'declined' ELSE 'approved' END AS status,
    ['card_present', 'card_not_present', 'wire', 'ach'][event_id % 4 + 1] AS channel,
    CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS latency, event_type
  FROM events)""")

part("t_tick", """MATERIALIZED (
  SELECT 'market' AS domain, 'SYM-' || CAST(l_suppkey % 5 AS VARCHAR) AS entity_key, l_shipdate AS ts_event,
    l_orderkey * 8 + l_linenumber AS seq, l_returnflag = 'R' AND l_linenumber = 7 AS corrupted,
    l_extendedprice / l_quantity AS price, l_quantity AS size,
    CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS side,
    (l_extendedprice / l_quantity) * (1 - l_discount / 100) AS bid,
    (l_extendedprice / l_quantity) * (1 + l_tax / 100) AS ask,
    1.0::DOUBLE + (l_partkey % 100) / 10.0::DOUBLE AS latency,
    l_partkey, l_suppkey, l_quantity, l_extendedprice
  FROM lineitem)""")

_ORDER = "ts_event, seq, l_partkey, l_suppkey, l_quantity, l_extendedprice"


def _start(ts: str, seconds: int) -> str:
    return f"make_timestamp(CAST(floor(epoch_us({ts}) / {seconds}000000.0) AS BIGINT) * {seconds}000000)"


def _rank(values: str, p: str) -> str:
    return f"list_sort(list({values}))[CAST(floor((count(*) - 1) * {p}::DOUBLE + 0.5) AS INTEGER) + 1]"


part("t_return", f"""MATERIALIZED (
  SELECT *, CASE WHEN price > 0 AND before > 0 THEN ln(price / before) END AS ret, {_start('ts_event', 604800)} AS window_start
  FROM (SELECT *, lag(price) OVER (PARTITION BY entity_key ORDER BY {_ORDER}) AS before FROM t_tick))""")

part("t_windows", f"""MATERIALIZED (
  SELECT domain, entity_key, window_start, window_start + INTERVAL 7 DAY AS window_end, 604800.0::DOUBLE AS window_size_s,
    count(*) AS "count", count(*) / 604800.0::DOUBLE AS throughput_eps,
    {_rank('latency', '0.5')} AS latency_p50_ms, {_rank('latency', '0.99')} AS latency_p99_ms,
    avg(CAST(corrupted AS DOUBLE)) AS error_rate, sum(price * size) / sum(size) AS vwap,
    avg((ask - bid) / price * 1e4) AS spread_bps,
    sqrt(coalesce(sum(ret * ret), 0) * (31536000.0::DOUBLE / 604800.0::DOUBLE)) AS realized_vol,
    sum(CASE WHEN side = 'buy' THEN size ELSE -size END) / sum(size) AS order_imbalance,
    CAST(NULL AS DOUBLE) AS mean_amount, CAST(NULL AS DOUBLE) AS sum_amount, CAST(NULL AS DOUBLE) AS decline_rate,
    CAST(NULL AS BIGINT) AS distinct_accounts,
    sqrt(coalesce(sum(ret * ret), 0) * (31536000.0::DOUBLE / 604800.0::DOUBLE)) AS primary_metric
  FROM t_return GROUP BY domain, entity_key, window_start
  UNION ALL
  SELECT domain, entity_key, window_start, window_start + INTERVAL 6 HOUR, 21600.0::DOUBLE,
    count(*), count(*) / 21600.0::DOUBLE, {_rank('latency', '0.5')}, {_rank('latency', '0.99')},
    avg(CASE WHEN status IN ('declined', 'error') OR corrupted THEN 1.0::DOUBLE ELSE 0 END), NULL, NULL, NULL, NULL,
    sum(amount) / count(*), sum(amount), avg(CASE WHEN status = 'declined' THEN 1.0::DOUBLE ELSE 0 END),
    count(DISTINCT account), sum(amount) / count(*)
  FROM (SELECT *, {_start('ts_event', 21600)} AS window_start FROM t_pay) GROUP BY domain, entity_key, window_start)""")

part("t_seq", """MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY domain, entity_key ORDER BY window_end) AS window_no,
    CAST(sum("count") OVER (PARTITION BY domain, entity_key ORDER BY window_end
      ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS DOUBLE) AS velocity_count
  FROM t_windows)""")

part("t_loop", """(
  SELECT domain, entity_key, window_no, primary_metric AS mean_post, 0.0::DOUBLE AS var_post,
    primary_metric AS ewma_mean, 0.0::DOUBLE AS ewma_var, 0.0::DOUBLE AS zscore, 0.0::DOUBLE AS s_pos, 0.0::DOUBLE AS s_neg
  FROM t_seq WHERE window_no = 1
  UNION ALL
  SELECT domain, entity_key, window_no, mean_post + 0.1::DOUBLE * delta,
    (1.0::DOUBLE - 0.1::DOUBLE) * (var_post + 0.1::DOUBLE * delta * delta), mean_post,
    greatest(var_post, 1e-9::DOUBLE), z, greatest(0, s_pos + z - 0.5::DOUBLE), least(0, s_neg + z + 0.5::DOUBLE)
  FROM (
    SELECT s.domain, s.entity_key, s.window_no, e.mean_post, e.var_post, e.s_pos, e.s_neg,
      s.primary_metric - e.mean_post AS delta,
      (s.primary_metric - e.mean_post) / sqrt(greatest(e.var_post, 1e-9::DOUBLE)) AS z
    FROM t_loop e JOIN t_seq s
      ON s.domain = e.domain AND s.entity_key = e.entity_key AND s.window_no = e.window_no + 1))""")

part("t_features", """MATERIALIZED (
  SELECT s.*, e.ewma_mean, e.ewma_var, e.zscore, e.s_pos, e.s_neg
  FROM t_seq s JOIN t_loop e USING (domain, entity_key, window_no))""")

part("t_stat", """MATERIALIZED (
  SELECT *, 1.0::DOUBLE - exp(-abs(zscore) / 4.0::DOUBLE) AS zscore_score,
    CASE WHEN abs(zscore) > 3 THEN 1.0::DOUBLE
      WHEN n3 = 3 AND greatest(up3, dn3) >= 2 THEN 0.8::DOUBLE
      WHEN n5 = 5 AND greatest(up5, dn5) >= 4 THEN 0.6::DOUBLE
      ELSE (1.0::DOUBLE - exp(-abs(zscore) / 6.0::DOUBLE)) * 0.5::DOUBLE END AS ewma_score,
    least(greatest(s_pos, -s_neg) / 5.0::DOUBLE, 1.0::DOUBLE) AS cusum_score,
    CASE WHEN domain = 'market' THEN
      [zscore, realized_vol, spread_bps, order_imbalance, throughput_eps, latency_p99_ms, error_rate, velocity_count]
    ELSE
      [zscore, ln(1 + greatest(mean_amount, 0)), decline_rate, CAST(distinct_accounts AS DOUBLE), throughput_eps,
       latency_p99_ms, error_rate, velocity_count] END AS vector,
    CASE WHEN domain = 'market' THEN
      ['zscore', 'realized_vol', 'spread_bps', 'order_imbalance', 'throughput_eps', 'latency_p99_ms', 'error_rate', 'velocity_count']
    ELSE
      ['zscore', 'log_mean_amount', 'decline_rate', 'distinct_accounts', 'throughput_eps', 'latency_p99_ms', 'error_rate', 'velocity_count']
    END AS names
  FROM (SELECT *, count(*) OVER w3 AS n3, count(*) OVER w5 AS n5,
      count(CASE WHEN zscore > 2 THEN 1 END) OVER w3 AS up3, count(CASE WHEN zscore < -2 THEN 1 END) OVER w3 AS dn3,
      count(CASE WHEN zscore > 1 THEN 1 END) OVER w5 AS up5, count(CASE WHEN zscore < -1 THEN 1 END) OVER w5 AS dn5
    FROM t_features
    WINDOW w3 AS (PARTITION BY domain, entity_key ORDER BY window_end ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
      w5 AS (PARTITION BY domain, entity_key ORDER BY window_end ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)))""")

part("t_score", """MATERIALIZED (
  SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE,
    zscore_score * 0.15::DOUBLE + ewma_score * 0.2::DOUBLE + cusum_score * 0.2::DOUBLE)) AS anomaly_score FROM t_stat)""")

part("t_ranked", """MATERIALIZED (
  SELECT domain, entity_key, window_end, feature, value, abs(value) AS contribution,
    row_number() OVER (PARTITION BY domain, entity_key, window_end ORDER BY abs(value) DESC, i) AS place
  FROM (SELECT domain, entity_key, window_end, unnest(names) AS feature, unnest(vector) AS value,
      unnest(range(8)) AS i FROM t_score))""")

part("t_cause", """MATERIALIZED (
  SELECT s.*, r.feature AS top,
    CASE
      WHEN domain = 'payments' AND decline_rate > 0.15 AND coalesce(nullif(distinct_accounts, 0), 999) <= 5
        AND mean_amount > 0 THEN 'fraud_pattern'
      WHEN r.feature = 'latency_p99_ms' THEN 'latency_incident'
      WHEN r.feature IN ('throughput_eps', 'velocity_count') THEN 'volume_spike'
      WHEN r.feature = 'error_rate' THEN 'data_corruption'
      WHEN cusum_score > 0.5 AND cusum_score > zscore_score THEN 'regime_change'
      WHEN domain = 'payments' AND r.feature IN ('log_mean_amount', 'decline_rate', 'zscore') THEN 'fraud_pattern'
      WHEN domain <> 'payments' AND r.feature IN ('realized_vol', 'zscore', 'spread_bps', 'order_imbalance')
        THEN 'volatility_spike'
      ELSE 'unknown' END AS probable_cause,
    CASE WHEN domain = 'payments' THEN
      CASE WHEN anomaly_score >= 0.4675::DOUBLE THEN 'critical' WHEN anomaly_score >= 0.385::DOUBLE THEN 'alert' WHEN anomaly_score >= 0.275::DOUBLE THEN 'watch' END
    ELSE
      CASE WHEN anomaly_score >= 0.495::DOUBLE THEN 'critical' WHEN anomaly_score >= 0.4125::DOUBLE THEN 'alert' WHEN anomaly_score >= 0.3025::DOUBLE THEN 'watch' END
    END AS severity
  FROM t_score s JOIN t_ranked r USING (domain, entity_key, window_end) WHERE r.place = 1)""")

# The id is a name-based UUID over the frozen text form of the window.
part("t_alerts", """MATERIALIZED (
  SELECT *, CASE WHEN severity = 'critical' AND domain = 'payments' THEN 'block'
      WHEN severity IN ('critical', 'alert') THEN 'alert' ELSE 'watch' END AS action,
    substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
      substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS alert_id,
    window_end + to_microseconds(("count" % 7) * 250000) AS ts,
    greatest(0, (epoch_us(window_end) + ("count" % 7) * 250000 - epoch_us(window_start)) / 1000.0::DOUBLE) AS latency_ingest_to_alert_ms
  FROM (SELECT *, sha1(unhex('7c6f1a9e2b3d4f5c8a1e9d6b4c2f0e7a') ||
      encode(domain || '|' || entity_key || '|' || strftime(window_end, '%Y-%m-%dT%H:%M:%S') || '+00:00')) AS h
    FROM t_cause WHERE severity IS NOT NULL))""")

part("t_marked", """MATERIALIZED (
  SELECT w.domain, w.entity_key, w.window_start, w.window_end,
    (SELECT arg_min(p.scenario_label, p.seq) FROM t_pay p WHERE p.entity_key = w.entity_key
      AND p.ts_event >= w.window_start AND p.ts_event < w.window_end AND p.scenario_label IS NOT NULL) AS scenario_label,
    EXISTS (SELECT 1 FROM t_alerts a WHERE a.entity_key = w.entity_key AND a.window_end = w.window_end) AS alerted
  FROM t_windows w WHERE w.domain = 'payments')""")

part("t_episodes", """MATERIALIZED (
  SELECT entity_key, min(domain) AS domain, min(scenario_label) AS scenario_label, min(window_start) AS "start",
    max(window_end) AS "end", min(CASE WHEN alerted THEN window_end END) AS detected_at
  FROM (SELECT *, sum(opened) OVER (PARTITION BY entity_key ORDER BY window_start) AS island
    FROM (SELECT *, CASE WHEN scenario_label IS NOT NULL AND NOT coalesce(
        lag(scenario_label) OVER w = scenario_label AND window_start <= lag(window_end) OVER w, FALSE) THEN 1 ELSE 0 END AS opened
      FROM t_marked WINDOW w AS (PARTITION BY entity_key ORDER BY window_start)))
  WHERE scenario_label IS NOT NULL GROUP BY entity_key, island)""")

part("t_metrics", """MATERIALIZED (
  SELECT domain, date_trunc('day', window_end) AS ts, 'ensemble-' || domain AS model_id,
    avg(zscore_score) > 0.3 AS drift_detected, count(*) AS events_scored, count(*) / 86400.0::DOUBLE AS throughput_eps,
    min(latency_p50_ms) AS p50_inference_ms, max(latency_p99_ms) AS p99_inference_ms
  FROM t_score GROUP BY 1, 2)""")

part("t_long", """MATERIALIZED (
  SELECT domain, first_no, last_no, unnest(names) AS feature, unnest(vector) AS value
  FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY window_end, entity_key) AS first_no,
      row_number() OVER (PARTITION BY domain ORDER BY window_end DESC, entity_key DESC) AS last_no FROM t_stat))""")

part("t_ks", """MATERIALIZED (
  SELECT domain, feature, max(abs(ub / nb - ul / nl)) AS ks_stat, max(nb) AS nb, max(nl) AS nl
  FROM (SELECT domain, feature, sum(b) OVER w AS ub, sum(l) OVER w AS ul,
      sum(b) OVER (PARTITION BY domain, feature) AS nb, sum(l) OVER (PARTITION BY domain, feature) AS nl
    FROM (SELECT domain, feature, value, CAST(sum(CASE WHEN first_no <= 60 THEN 1 ELSE 0 END) AS DOUBLE) AS b,
        CAST(sum(CASE WHEN last_no <= 500 THEN 1 ELSE 0 END) AS DOUBLE) AS l
      FROM t_long WHERE first_no <= 60 OR last_no <= 500 GROUP BY domain, feature, value)
    WINDOW w AS (PARTITION BY domain, feature ORDER BY value))
  GROUP BY domain, feature)""")

part("t_ksp", """MATERIALIZED (
  SELECT *, CASE WHEN x <= 0 THEN 1.0::DOUBLE
      WHEN x < 1 THEN 1 - sqrt(2 * pi()) / x * list_sum([exp(-pow(2 * k - 1, 2) * pi() * pi() / (8 * x * x)) for k in range(1, 30)])
      ELSE greatest(0, least(1, 2 * list_sum([pow(-1, k - 1) * exp(-2 * k * k * x * x) for k in range(1, 30)]))) END AS ks_pvalue
  FROM (SELECT *, sqrt(nb * nl / (nb + nl)) * ks_stat AS x FROM t_ks))""")

part("t_edges", """MATERIALIZED (
  SELECT domain, feature, list_sort(list_distinct(
    quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges
  FROM t_long WHERE first_no <= 60 GROUP BY domain, feature)""")

part("t_bins", """MATERIALIZED (
  SELECT domain, feature, bin, sum(b) AS b, sum(l) AS l
  FROM (SELECT l.domain, l.feature, CASE WHEN first_no <= 60 THEN 1 ELSE 0 END AS b,
      CASE WHEN last_no <= 500 THEN 1 ELSE 0 END AS l,
      CASE WHEN value = edges[-1] THEN len(edges) - 1 WHEN value < edges[1] OR value > edges[-1] THEN 0
        ELSE len([e for e in edges if e <= value]) END AS bin
    FROM t_long l JOIN t_edges e USING (domain, feature))
  WHERE bin > 0 GROUP BY domain, feature, bin)""")

part("t_psi", """MATERIALIZED (
  SELECT e.domain, e.feature, CASE WHEN len(edges) < 3 THEN 0.0::DOUBLE ELSE (
    SELECT sum((lp - bp) * ln(lp / bp)) FROM (
      SELECT b / greatest(sum(b) OVER (), 1)::DOUBLE + 1e-6::DOUBLE AS bp, l / greatest(sum(l) OVER (), 1)::DOUBLE + 1e-6::DOUBLE AS lp
      FROM t_bins t WHERE t.domain = e.domain AND t.feature = e.feature)) END AS psi
  FROM t_edges e)""")

# Exact p-value: count the lattice paths that stay inside the observed gap.
part("t_paths", """(
  SELECT domain, feature, ks_stat, CAST(nb AS BIGINT) AS nb, CAST(nl AS BIGINT) AS nl, 0 AS i,
    [CASE WHEN j / nb > q THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END for j in range(0, CAST(nb AS BIGINT) + 1)] AS u, q
  FROM (SELECT *, (0.5 + floor(ks_stat * nb * nl - 1e-7)) / (nb * nl) AS q FROM t_ks)
  UNION ALL
  SELECT domain, feature, ks_stat, nb, nl, i + 1,
    list_transform(range(0, nb + 1), lambda j: CASE WHEN abs((i + 1) / nl - j / nb) > q THEN 0.0::DOUBLE ELSE
      list_sum(list_transform(range(0, j + 1), lambda t: CASE WHEN abs((i + 1) / nl - t / nb) > q THEN 0.0::DOUBLE
        ELSE (i + 1)::DOUBLE / (i + 1 + nb) * u[t + 1] END)) END), q
  FROM t_paths WHERE i < nl)""")

part("t_ksx", """MATERIALIZED (
  SELECT domain, feature, ks_stat, greatest(0, least(1, 1 - u[-1])) AS ks_pvalue FROM t_paths WHERE i = nl)""")

# The market half of labels and evaluation; payments keep their own parts.
part("t_label_market", """MATERIALIZED (
  SELECT entity_key, ts_event, CASE (date_diff('day', DATE '1970-01-01', CAST(ts_event AS DATE))
      + 53 * CAST(substr(entity_key, 5, 1) AS INTEGER)) % 97
    WHEN 0 THEN 'volatility_spike' WHEN 1 THEN 'volume_spike' WHEN 2 THEN 'regime_change' END AS scenario_label
  FROM t_tick)""")

part("t_marked_market", """MATERIALIZED (
  SELECT w.domain, w.entity_key, w.window_start, w.window_end,
    (SELECT arg_min(p.scenario_label, p.ts_event) FROM t_label_market p WHERE p.entity_key = w.entity_key
      AND p.ts_event >= w.window_start AND p.ts_event < w.window_end AND p.scenario_label IS NOT NULL) AS scenario_label,
    EXISTS (SELECT 1 FROM t_alerts a WHERE a.entity_key = w.entity_key AND a.window_end = w.window_end) AS alerted
  FROM t_windows w WHERE w.domain = 'market')""")

part("t_episodes_market", PARTS["t_episodes"].replace("t_marked", "t_marked_market"))

part("t_labelled", """MATERIALIZED (
  SELECT domain, entity_key, window_end, CAST(scenario_label IS NOT NULL AS INTEGER) AS label FROM t_marked
  UNION ALL SELECT domain, entity_key, window_end, CAST(scenario_label IS NOT NULL AS INTEGER) FROM t_marked_market)""")
