"""DuckDB texts. Shared parts are chained CTEs; each query adds its final SELECT."""

REC = """
rec AS (SELECT event_id, ts, user_id AS entity_id, event_type, value FROM events WHERE event_type <> 'signup'),
pd AS (SELECT entity_id, CAST(ts AS DATE) AS day, count(*) AS load,
              count(*) FILTER (WHERE event_type = 'error') AS errors, sum(value) AS value_sum
       FROM rec GROUP BY ALL),
roster AS (SELECT DISTINCT entity_id, c_nationkey AS group_id FROM pd JOIN customer ON c_custkey = entity_id),
cal AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM pd),
spine AS (SELECT r.entity_id, r.group_id, c.day, CAST(c.day - DATE '1970-01-01' AS INTEGER) AS day_no,
                 pd.load, pd.errors, pd.value_sum
          FROM roster r CROSS JOIN cal c LEFT JOIN pd ON pd.entity_id = r.entity_id AND pd.day = c.day)"""


def stats(m, far=14, near=1):
    f = f"OVER (PARTITION BY entity_id ORDER BY day_no RANGE BETWEEN {far} PRECEDING AND {near} PRECEDING)"
    x = f"CAST({m} AS DOUBLE)"
    n, s, q = f"count({m}) {f}", f"sum({x}) {f}", f"sum({x}*{x}) {f}"
    mean = f"CASE WHEN {n} >= 5 THEN ({s}) / ({n}) END"
    sd = f"CASE WHEN {n} >= 5 THEN sqrt(greatest(({n})*({q}) - ({s})*({s}), 0.0) / (({n})*(({n})-1))) END"
    return n, mean, sd


_n, _mean, _sd = stats("load")
_en, _emean, _esd = stats("errors")
_, _lmean, _ = stats("load", 21, 8)
_E = "PARTITION BY entity_id ORDER BY day_no"
_W = f"OVER ({_E} RANGE BETWEEN 6 PRECEDING AND CURRENT ROW)"
_N, _SX, _SY = f"count(load) {_W}", f"sum(CASE WHEN load IS NOT NULL THEN CAST(day_no AS DOUBLE) END) {_W}", f"sum(CAST(load AS DOUBLE)) {_W}"
_SXY, _SXX = f"sum(CAST(day_no AS DOUBLE)*load) {_W}", f"sum(CASE WHEN load IS NOT NULL THEN CAST(day_no AS DOUBLE)*day_no END) {_W}"

FEAT = REC + f""",
own AS (SELECT *, {_n} AS load_n, {_mean} AS load_mean, {_sd} AS load_sd,
        {_en} AS errors_n, {_emean} AS errors_mean, {_esd} AS errors_sd, {_lmean} AS load_lagged_mean,
        last_value(load IGNORE NULLS) OVER ({_E} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS load_prev,
        CAST(sum(load) {_W} AS BIGINT) AS load_sum7,
        CASE WHEN {_N} > 1 THEN round((({_N})*({_SXY}) - ({_SX})*({_SY})) / (({_N})*({_SXX}) - ({_SX})*({_SX})), 6) END AS load_slope7,
        CASE WHEN load IS NOT NULL THEN day_no - last_value(CASE WHEN load IS NOT NULL THEN day_no END IGNORE NULLS)
             OVER ({_E} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS rest_gap,
        count(load) OVER ({_E} RANGE BETWEEN 4 PRECEDING AND CURRENT ROW) = 5 AS busy
        FROM spine),
gday AS (SELECT group_id, day, day_no, sum(CAST(load AS DOUBLE)) AS tot, count(load) AS mem FROM spine GROUP BY ALL),
grp AS (SELECT group_id, day, CASE WHEN mem <> 0 THEN tot / mem END AS load_group_today,
               CASE WHEN sum(mem) OVER g >= 5 THEN (sum(tot) OVER g) / CAST(sum(mem) OVER g AS BIGINT) END AS load_group_mean
        FROM gday WINDOW g AS (PARTITION BY group_id ORDER BY day_no RANGE BETWEEN 14 PRECEDING AND 1 PRECEDING)),
dev AS (SELECT own.*, load_group_today, load_group_mean, round(load - load_mean, 6) AS load_dev,
               round((load - load_mean) - (load_group_today - load_group_mean), 6) AS load_excess,
               CASE WHEN load_sd > 0 THEN round((load - load_mean) / load_sd, 6) END AS load_z,
               CASE WHEN errors_sd > 0 THEN round((errors - errors_mean) / errors_sd, 6) END AS errors_z
        FROM own LEFT JOIN grp USING (group_id, day)),
feat AS (SELECT *,
         CASE WHEN load IS NOT NULL AND load_mean IS NOT NULL THEN
           coalesce(CAST(load_z >= 1.5 AS INTEGER), 0) + coalesce(CAST(errors_z >= 1.5 AS INTEGER), 0) + CAST(busy AS INTEGER) END AS rule_score,
         CASE WHEN load IS NOT NULL AND load_mean IS NOT NULL THEN
           CAST(CAST(coalesce(load_z,0) AS DECIMAL(18,6))*CAST(0.5 AS DECIMAL(4,3)) + CAST(coalesce(errors_z,0) AS DECIMAL(18,6))*CAST(0.3 AS DECIMAL(4,3))
                + CAST(coalesce(load_slope7,0) AS DECIMAL(18,6))*CAST(0.2 AS DECIMAL(4,3)) AS DOUBLE) END AS temporal_score,
         CASE WHEN load_sd > 0 THEN load_z >= 1.0 WHEN load_sd = 0 THEN TRUE END AND load_dev >= 1.0 AND load_excess > 0 AS material
         FROM dev)"""

EPI = FEAT + """,
scored AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY day_no) AS sq,
           NOT material AND NOT lag(material) OVER (PARTITION BY entity_id ORDER BY day_no) AS calm
           FROM feat WHERE material IS NOT NULL),
calmed AS (SELECT *, min(CASE WHEN calm THEN day END) OVER (PARTITION BY entity_id ORDER BY day_no
                  ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS calm_from FROM scored),
isl AS (SELECT *, sq - row_number() OVER (PARTITION BY entity_id ORDER BY day_no) AS island FROM calmed WHERE material),
nth AS (SELECT *, row_number() OVER (PARTITION BY entity_id, island ORDER BY day_no) AS pos FROM isl),
epi AS (SELECT entity_id, group_id, min(day) AS start_day, max(day) AS end_day, count(*) AS length,
        max(CASE WHEN pos = 2 THEN day END) AS case_day, max(calm_from) AS recovered_day,
        max(CASE WHEN pos = 2 THEN load_z END) AS load_z, max(CASE WHEN pos = 2 THEN load_dev END) AS load_dev,
        max(CASE WHEN pos = 2 THEN load_excess END) AS load_excess,
        max(CASE WHEN pos = 2 THEN rule_score END) AS rule_score,
        max(CASE WHEN pos = 2 THEN temporal_score END) AS temporal_score
        FROM nth GROUP BY entity_id, group_id, island HAVING count(*) >= 2),
cand AS (SELECT *, sha256(concat_ws('#', entity_id, case_day, 'v1')) AS case_id,
         CASE WHEN load_z >= 3 THEN 'high' WHEN load_z >= 2 THEN 'moderate' ELSE 'low' END AS level,
         rule_score + temporal_score AS score, 'v1' AS policy_version,
         coalesce(recovered_day <= case_day + 2, FALSE) AS gone FROM epi)"""

ADMIT = EPI + """,
live AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY case_day) AS k FROM cand WHERE NOT gone),
fold AS (SELECT entity_id, k, case_day, case_day AS last_kept, FALSE AS repeat FROM live WHERE k = 1
         UNION ALL
         SELECT l.entity_id, l.k, l.case_day,
                CASE WHEN l.case_day - f.last_kept > 7 THEN l.case_day ELSE f.last_kept END,
                l.case_day - f.last_kept <= 7
         FROM fold f JOIN live l ON l.entity_id = f.entity_id AND l.k = f.k + 1),
marked AS (SELECT l.*, f.repeat FROM live l JOIN fold f ON f.entity_id = l.entity_id AND f.k = l.k),
ranked AS (SELECT *, row_number() OVER (PARTITION BY case_day ORDER BY score DESC, case_id) AS rank FROM marked WHERE NOT repeat),
cases AS (SELECT * FROM ranked WHERE rank <= 2),
ledger AS (SELECT case_id, entity_id, group_id, case_day, score, 'recovered' AS reason FROM cand WHERE gone
           UNION ALL SELECT case_id, entity_id, group_id, case_day, score, 'cooldown' FROM marked WHERE repeat
           UNION ALL SELECT case_id, entity_id, group_id, case_day, score, 'capacity' FROM ranked WHERE rank > 2)"""


def q(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()}\n{select.strip()}"


CASE_COLS = ("case_id, entity_id, group_id, case_day, start_day, end_day, length, recovered_day, load_z, load_dev, "
             "load_excess, rule_score, temporal_score, level, score, policy_version")

_X = {c: f"coalesce(CAST({c} AS DOUBLE), 0)" for c in ("load_z", "errors_z", "load_slope7", "rest_gap")}
_X["intercept"] = "1.0"
FIT = " UNION ALL ".join(f"SELECT '{c}' AS coefficient, round(sum(label * {x}), 4) AS label_sum, TRUE AS settled FROM sc WHERE split = 'train'" for c, x in _X.items())
_LIN = "-0.5 + 0.4 * {load_z} + 0.15 * {errors_z} + 0.3 * {load_slope7} - 0.2 * {rest_gap}".format(**_X)
STORED = f"""
t AS (SELECT label, CAST(rule_score AS DOUBLE) AS rule_score, CAST(temporal_score AS DOUBLE) AS temporal_score, CAST(load AS DOUBLE) AS load,
      round(1 / (1 + exp(-({_LIN}))), 6) AS model_score FROM sc WHERE split = 'test'),
u AS (SELECT 'rule_score' AS strategy, rule_score AS score, label FROM t UNION ALL SELECT 'temporal_score', temporal_score, label FROM t
      UNION ALL SELECT 'load', load, label FROM t UNION ALL SELECT 'model_score', model_score, label FROM t),
r AS (SELECT strategy, label, rank() OVER (PARTITION BY strategy ORDER BY score) + (count(*) OVER (PARTITION BY strategy, score) - 1) / 2 AS rk FROM u)"""


ORACLE = {
    "s1_records": q(REC, "SELECT * FROM rec"),
    "s2_entity_days": q(REC, "SELECT entity_id, day, load, errors, round(value_sum, 4) AS value_sum FROM pd"),
    "q6_spine": q(REC, "SELECT entity_id, group_id, day, load, errors, round(value_sum, 4) AS value_sum FROM spine"),
    "b1_personal_baseline": q(FEAT, """SELECT entity_id, day, load, load_n, round(load_mean, 6) AS load_mean, round(load_sd, 6) AS load_sd,
        CASE WHEN load_n >= 5 THEN quantile_cont(load, 0.5) OVER (PARTITION BY entity_id ORDER BY day_no RANGE BETWEEN 14 PRECEDING AND 1 PRECEDING) END AS load_median FROM own"""),
    "b2_lagged_baseline": q(FEAT, "SELECT entity_id, day, round(load_lagged_mean, 6) AS load_lagged_mean FROM own"),
    "b3_group_baseline": q(FEAT, "SELECT group_id, day, round(load_group_today, 6) AS load_group_today, round(load_group_mean, 6) AS load_group_mean FROM grp"),
    "b4_deviation": q(FEAT, "SELECT entity_id, group_id, day, load_dev, load_excess, load_z FROM dev"),
    "b5_temporal_features": q(FEAT, "SELECT entity_id, day, load_prev, load_sum7, load_slope7, rest_gap, busy FROM own"),
    "b6_rest_gap": q(REC, """SELECT entity_id, event_id, round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY entity_id ORDER BY ts, event_id))) / 3.6e9, 6) AS gap_hours FROM rec"""),
    "b7_entity_trend": q(FEAT, """SELECT entity_id, day, z_now, z_then,
        CASE WHEN z_now IS NULL OR z_then IS NULL THEN 'unknown' WHEN z_now - z_then >= 0.5 THEN 'rising' WHEN z_now - z_then <= -0.5 THEN 'falling' ELSE 'steady' END AS trend
        FROM (SELECT entity_id, day, load_z AS z_now, lag(load_z, 7) OVER (PARTITION BY entity_id ORDER BY day_no) AS z_then FROM dev)"""),
    "a1_rule_score": q(FEAT, "SELECT entity_id, day, rule_score FROM feat"),
    "a2_temporal_score": q(FEAT, "SELECT entity_id, day, temporal_score FROM feat"),
    "a4_concern_level": q(EPI, "SELECT case_id, load_z, level FROM cand"),
    "a5_material": q(FEAT, "SELECT entity_id, day, load_z, load_excess, material FROM feat"),
    "a6_persistent": q(EPI, "SELECT entity_id, group_id, start_day, end_day, length, case_day FROM epi"),
    "a7_recovery": q(EPI, "SELECT entity_id, start_day, end_day, recovered_day FROM epi"),
    "a8_dedupe": q(ADMIT, "SELECT case_id, entity_id, case_day, repeat FROM marked"),
    "a9_budget": q(ADMIT, f"SELECT {CASE_COLS}, CAST(rank AS INTEGER) AS rank FROM cases"),
    "a10_suppressed": q(ADMIT, "SELECT * FROM ledger"),
    "a11_burden": q(FEAT, "SELECT count(material) AS judged, count(*) FILTER (WHERE material) AS flagged, round(avg(CAST(material AS DOUBLE)), 6) AS share FROM feat"),
    "a12_funnel": q(ADMIT, """SELECT 'entity_days' AS stage, count(*) AS n FROM feat UNION ALL SELECT 'observed', count(load) FROM feat
        UNION ALL SELECT 'judged', count(material) FROM feat UNION ALL SELECT 'material', count(*) FILTER (WHERE material) FROM feat
        UNION ALL SELECT 'persistent', count(*) FROM epi UNION ALL SELECT 'dropped_' || reason, count(*) FROM ledger GROUP BY reason
        UNION ALL SELECT 'admitted', count(*) FROM cases"""),
    "a13_case_id": q(EPI, "SELECT entity_id, case_day, case_id FROM cand"),
    "a14_no_report_effect": q(ADMIT, "SELECT count(*) AS cases, CAST(0 AS BIGINT) AS changed FROM cases"),
}

# ---- accounts, action log, audit chain, labels -------------------------------------------------------

ACC = """
roster_all AS (SELECT c_custkey AS entity_id, c_nationkey AS group_id FROM customer),
reg AS (SELECT n_regionkey AS r, list_sort(list(n_nationkey)) AS groups FROM nation GROUP BY 1),
everywhere AS (SELECT list_sort(list(n_nationkey)) AS groups FROM nation),
acc AS (SELECT 'reviewer-' || r AS account_id, 'reviewer' AS role, ['support'] AS purposes, groups FROM reg
        UNION ALL SELECT 'lead-' || r, 'lead', CASE WHEN r = 4 THEN ['aggregate', 'support'] ELSE ['aggregate'] END, groups FROM reg
        UNION ALL SELECT 'reviewer-all', 'reviewer', ['support'], groups FROM everywhere
        UNION ALL SELECT 'auditor-all', 'auditor', ['audit'], groups FROM everywhere)"""


def scope(account, purpose="support"):
    roles = {"support": "reviewer", "aggregate": "lead"}
    return f"SELECT unnest(groups) FROM acc WHERE account_id = '{account}' AND list_contains(purposes, '{purpose}') AND role = '{roles[purpose]}'"


_EDGE = """CASE a.action
  WHEN 'acknowledge' THEN CASE {s} WHEN 'open' THEN 'acknowledged' WHEN 'reopened' THEN 'acknowledged' END
  WHEN 'start_review' THEN CASE {s} WHEN 'acknowledged' THEN 'in_review' END
  WHEN 'progress_support' THEN CASE {s} WHEN 'in_review' THEN 'support_planned' WHEN 'support_planned' THEN 'support_completed' END
  WHEN 'close' THEN CASE {s} WHEN 'support_completed' THEN 'closed' WHEN 'in_review' THEN 'closed' END
  WHEN 'reopen' THEN CASE {s} WHEN 'closed' THEN 'reopened' END END"""


def _step(state):
    return (f"CASE WHEN a.reasoned AND (a.expected_state IS NULL OR a.expected_state = {state}) "
            f"THEN coalesce({_EDGE.format(s=state)}, {state}) ELSE {state} END")


LOG = f"""
numbered AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS kk FROM events),
act AS (SELECT user_id AS case_id, ts, event_id AS seq,
        CASE event_type WHEN 'view' THEN 'acknowledge' WHEN 'click' THEN 'start_review' WHEN 'purchase' THEN 'progress_support'
             WHEN 'error' THEN 'close' WHEN 'signup' THEN 'reopen' END AS action,
        CASE WHEN kk % 4 = 0 THEN ['open','acknowledged','in_review','support_planned','support_completed','closed','reopened'][kk % 7 + 1] END AS expected_state,
        'R' || (kk % 12) AS reason_code, kk % 12 < 10 AS reasoned,
        ['reviewer','lead','auditor'][kk % 3 + 1] AS role, ['support','aggregate','audit'][(kk // 2) % 3 + 1] AS purpose,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM numbered),
rep AS (SELECT case_id, n, seq, 'open' AS from_state, {_step("'open'")} AS to_state FROM act a WHERE n = 1
        UNION ALL SELECT a.case_id, a.n, a.seq, r.to_state, {_step("r.to_state")} FROM rep r JOIN act a ON a.case_id = r.case_id AND a.n = r.n + 1),
log AS (SELECT a.*, r.from_state, r.to_state, r.from_state <> r.to_state AS accepted,
        CASE WHEN r.from_state <> r.to_state THEN NULL WHEN NOT reasoned THEN 'missing_reason'
             WHEN expected_state <> r.from_state THEN 'conflict' ELSE 'invalid_transition' END AS refusal
        FROM act a JOIN rep r USING (case_id, n)),
states AS (SELECT case_id, arg_max(to_state, n) AS state, count(*) FILTER (WHERE accepted) AS accepted_actions FROM log GROUP BY 1)"""

_P8 = {
    "search": "(contains(case_id, '1') OR contains(CAST(entity_id AS VARCHAR), '1'))", "groups": "group_id BETWEEN 0 AND 11", "levels": "level = 'moderate'",
    "states": "state IN ('open', 'acknowledged', 'reopened')", "changes": "load_z >= 2.5", "first": "case_day >= DATE '2024-01-18'", "last": "case_day <= DATE '2024-01-22'",
}
_P8["all"] = " AND ".join({**_P8, "levels": "level IN ('moderate', 'high')"}.values())
P8 = " UNION ALL ".join(f"SELECT case_id, '{name}' AS filter FROM qcases WHERE {rule}" for name, rule in _P8.items())
OPEN = ADMIT + "," + LOG + """,
qcases AS (SELECT c.*, coalesce(s.state, 'open') AS state FROM cases c LEFT JOIN states s ON s.case_id = c.entity_id)"""

FACT = ADMIT + """,
atcase AS (SELECT c.case_id, c.case_day, c.policy_version, c.load_z, f.load, f.load_mean, f.errors, f.errors_mean, f.errors_z,
           f.rest_gap, f.busy, f.load_lagged_mean FROM cases c JOIN feat f ON f.entity_id = c.entity_id AND f.day = c.case_day),
fct AS (SELECT case_id, 'load' AS metric, CAST(load AS DOUBLE) AS value, round(load_mean, 6) AS reference, case_day - 14 AS window_start,
          case_day - 1 AS window_end, 'load_above_own_normal' AS rule, policy_version FROM atcase WHERE load_z >= 1.5
        UNION ALL SELECT case_id, 'errors', CAST(errors AS DOUBLE), round(errors_mean, 6), case_day - 14, case_day - 1, 'errors_above_own_normal', policy_version FROM atcase WHERE errors_z >= 1.5
        UNION ALL SELECT case_id, 'rest', CAST(rest_gap AS DOUBLE), 5.0, case_day - 4, case_day, 'no_free_day', policy_version FROM atcase WHERE busy
        UNION ALL SELECT case_id, 'drift', round(load_mean, 6), round(load_lagged_mean, 6), case_day - 21, case_day - 8, 'normal_has_drifted_up', policy_version
          FROM atcase WHERE load_mean >= 1.25 * load_lagged_mean),
strong AS (SELECT *, round(abs(value - reference) / greatest(abs(reference), 1.0), 6) AS s FROM fct),
opt AS (SELECT case_id, list_sort(list(DISTINCT CASE rule WHEN 'errors_above_own_normal' THEN 'offer_practice_time' WHEN 'no_free_day' THEN 'schedule_free_day' ELSE 'review_workload' END)) AS options FROM fct GROUP BY 1)"""

FU = """
fu AS (SELECT o_orderkey AS followup_id, o_custkey AS entity_id,
       CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) + 30 END AS due,
       CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 7 + 26 AS INTEGER) END AS done FROM orders),
fus AS (SELECT *, CASE WHEN done > due THEN 'done_late' WHEN done IS NOT NULL THEN 'done' WHEN due IS NULL THEN 'unscheduled'
        WHEN due < (SELECT CAST(max(o_orderdate) AS DATE) FROM orders) THEN 'overdue'
        WHEN due = (SELECT CAST(max(o_orderdate) AS DATE) FROM orders) THEN 'due' ELSE 'upcoming' END AS status FROM fu)"""

DUTY = """
duty AS (SELECT user_id AS entity_id, ts AS s, ts + to_seconds(CAST(round(value * 60) AS INTEGER)) AS e FROM events WHERE event_type IN ('click', 'purchase')),
busyday AS (SELECT DISTINCT entity_id, CAST(unnest(generate_series(date_trunc('day', s), date_trunc('day', e - INTERVAL 1 MICROSECOND), INTERVAL 1 DAY)) AS DATE) AS day FROM duty WHERE e > s),
slot AS (SELECT c.case_id, c.entity_id, o.n, b.day IS NOT NULL AS taken FROM cases c CROSS JOIN (SELECT unnest([1,2,3]) AS n) o
         LEFT JOIN busyday b ON b.entity_id = c.entity_id AND b.day = c.case_day + CAST(o.n AS INTEGER)),
feas AS (SELECT case_id, entity_id, count(*) FILTER (WHERE taken) AS busy_days, min(CASE WHEN NOT taken THEN n END) AS first_free,
         CASE WHEN min(CASE WHEN NOT taken THEN n END) = 1 THEN 'now' WHEN min(CASE WHEN NOT taken THEN n END) IS NOT NULL THEN 'with_adjustment' ELSE 'constrained' END AS feasibility
         FROM slot GROUP BY ALL)"""

_BS = "chr(92)"


def esc(column):
    return f"coalesce(replace(replace(CAST({column} AS VARCHAR), {_BS}, {_BS} || {_BS}), '#', {_BS} || '#'), {_BS} || 'N')"


def sums(digest):
    return " || '#' || ".join(f"CAST(coalesce(sum(('0x' || substr({digest}, {1 + 15 * i}, 15))::HUGEINT), 0) AS VARCHAR)" for i in range(4))


LEAVES = f"""lv AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS position,
    sha256('leaf#' || sha256({esc('role')} || '#' || {esc('text')})) AS leaf FROM conversations),
num AS (SELECT count(*) AS n FROM conversations)"""

AUD = f"""
ev AS (SELECT conv_id, turn, role, text, turn // 4 AS segment, sha256({esc('role')} || '#' || {esc('text')}) AS dg FROM conversations),
ch AS (SELECT conv_id, turn, segment, sha256('start#' || conv_id || '#0') AS prev_hash, sha256(sha256('start#' || conv_id || '#0') || '#' || dg) AS hash FROM ev WHERE turn = 0
       UNION ALL
       SELECT e.conv_id, e.turn, e.segment,
              CASE WHEN e.turn % 4 = 0 THEN sha256('start#' || e.conv_id || '#' || e.segment) ELSE c.hash END,
              sha256(CASE WHEN e.turn % 4 = 0 THEN sha256('start#' || e.conv_id || '#' || e.segment) ELSE c.hash END || '#' || e.dg)
       FROM ch c JOIN ev e ON e.conv_id = c.conv_id AND e.turn = c.turn + 1),
heads AS (SELECT conv_id, segment, count(*) AS events, arg_max(hash, turn) AS head FROM ch GROUP BY ALL),
bad AS (SELECT e.*, c.prev_hash, c.hash, CASE WHEN conv_id % 10 = 3 AND turn = 1 THEN text || ' x' ELSE text END AS t2
        FROM ev e JOIN ch c USING (conv_id, turn, segment) WHERE NOT (conv_id % 10 = 5 AND turn = 1) AND NOT (conv_id % 10 = 7 AND turn >= 2)),
sent AS (SELECT * FROM bad UNION ALL SELECT * FROM bad WHERE conv_id % 10 = 8 AND turn = 0),
ver0 AS (SELECT b.conv_id, b.turn, CASE WHEN b.conv_id % 10 = 8 AND b.turn = 0 THEN 'duplicate' WHEN b.turn > 0 AND p.turn IS NULL THEN 'gap'
         WHEN b.prev_hash <> CASE WHEN b.turn % 4 = 0 THEN sha256('start#' || b.conv_id || '#' || b.segment) ELSE p.hash END THEN 'link'
         WHEN b.hash <> sha256(b.prev_hash || '#' || sha256({esc('b.role')} || '#' || {esc('b.t2')})) THEN 'payload' END AS reason
         FROM bad b LEFT JOIN bad p ON p.conv_id = b.conv_id AND p.turn = b.turn - 1),
left_heads AS (SELECT conv_id, segment, count(*) AS n, max(turn) AS last, arg_max(hash, turn) AS head FROM sent GROUP BY ALL),
ver AS (SELECT conv_id, turn, reason IS NULL AS ok, reason FROM ver0 UNION ALL
        SELECT h.conv_id, CAST(coalesce(l.last + 1, h.segment * 4) AS BIGINT), FALSE, 'tail' FROM heads h LEFT JOIN left_heads l USING (conv_id, segment)
        WHERE l.last IS NULL OR l.last < h.segment * 4 + h.events - 1
        UNION ALL SELECT h.conv_id, l.last, FALSE, 'count' FROM heads h JOIN left_heads l USING (conv_id, segment)
        WHERE l.last >= h.segment * 4 + h.events - 1 AND l.n <> h.events)"""

LAB = FEAT + """,
rp AS (SELECT user_id AS entity_id, CAST(ts AS DATE) AS day, count(*) AS reports FROM events WHERE event_type = 'signup' GROUP BY ALL),
ahead AS (SELECT s.entity_id, s.day, sum(reports) OVER (PARTITION BY s.entity_id ORDER BY s.day_no RANGE BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS a,
          s.day + 7 <= (SELECT max(day) FROM spine) AS full_horizon FROM spine s LEFT JOIN rp ON rp.entity_id = s.entity_id AND rp.day = s.day),
lab AS (SELECT entity_id, day, CASE WHEN a > 0 THEN CAST(a >= 4 AS INTEGER) END AS label, full_horizon FROM ahead),
sc0 AS (SELECT f.*, l.label, f.entity_id * 100000 + f.day_no AS row_id FROM feat f JOIN lab l USING (entity_id, day)
        WHERE full_horizon AND label IS NOT NULL AND rule_score IS NOT NULL),
perday AS (SELECT day, sum(count(*)) OVER (ORDER BY day) * 100 AS share, sum(count(*)) OVER () AS total FROM sc0 GROUP BY day),
sc AS (SELECT sc0.*, CASE WHEN share <= 60 * total THEN 'train' WHEN share <= 80 * total THEN 'validation' ELSE 'test' END AS split FROM sc0 JOIN perday USING (day)),
rk AS (SELECT row_id, label, split, strategy, score FROM (
       SELECT row_id, label, split, 'rule_score' AS strategy, CAST(rule_score AS DOUBLE) AS score FROM sc
       UNION ALL SELECT row_id, label, split, 'temporal_score', temporal_score FROM sc
       UNION ALL SELECT row_id, label, split, 'load', CAST(load AS DOUBLE) FROM sc) WHERE TRUE /*split*/),
sg AS (SELECT strategy, score AS threshold, CAST(sum(label) AS BIGINT) AS positives, count(*) AS rows FROM rk GROUP BY ALL),
cu AS (SELECT *, CAST(sum(positives) OVER w AS BIGINT) AS hits, CAST(sum(rows) OVER w AS BIGINT) AS flagged,
       CAST(sum(positives) OVER (PARTITION BY strategy) AS BIGINT) AS all_positives, CAST(sum(rows) OVER (PARTITION BY strategy) AS BIGINT) AS all_rows
       FROM sg WINDOW w AS (PARTITION BY strategy ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
sw AS (SELECT *, round(hits / flagged, 6) AS precision, round(hits / all_positives, 6) AS recall, round(2 * hits / (flagged + all_positives), 6) AS f1,
       round(flagged / all_rows, 6) AS flag_rate FROM cu),
rr AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY score DESC, row_id) AS rank, count(*) OVER (PARTITION BY strategy) AS n FROM rk),
top AS (SELECT strategy, percent, CAST(max((percent * n + 99) // 100) AS BIGINT) AS k,
        CAST(sum(CASE WHEN rank <= (percent * n + 99) // 100 THEN label ELSE 0 END) AS BIGINT) AS hits
        FROM rr CROSS JOIN (SELECT unnest([1, 2, 5, 10]) AS percent) GROUP BY ALL)"""

LINE = """
findings AS (SELECT 'range_l_quantity' AS rule, count(*) FILTER (WHERE l_quantity NOT BETWEEN 1 AND 45) AS n FROM lineitem
   UNION ALL SELECT 'range_l_discount', count(*) FILTER (WHERE l_discount NOT BETWEEN 0.0::DOUBLE AND 0.08::DOUBLE) FROM lineitem
   UNION ALL SELECT 'range_l_extendedprice', count(*) FILTER (WHERE l_extendedprice NOT BETWEEN 0 AND 90000) FROM lineitem
   UNION ALL SELECT 'returned_is_finished', count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'O') FROM lineitem
   UNION ALL SELECT 'discount_below_price', count(*) FILTER (WHERE NOT l_discount * l_extendedprice < l_extendedprice) FROM lineitem
   UNION ALL SELECT 'duplicate_key', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
   UNION ALL SELECT 'orphan_l_orderkey', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)),
rules AS (SELECT * FROM (VALUES ('range_l_quantity', 'warning'), ('range_l_discount', 'warning'), ('range_l_extendedprice', 'warning'),
   ('returned_is_finished', 'warning'), ('discount_below_price', 'error'), ('duplicate_key', 'error'), ('orphan_l_orderkey', 'error'), ('orphan_l_partkey', 'notice')) v(rule, severity))"""

_RED = "text"
_YEAR, _MONTH, _DAY, _HELD = "((?:19|20)[0-9]{2})", "(0[1-9]|1[0-2])", "(0[1-9]|[12][0-9]|3[01])", "\ue000"
for _p, _r in [
    (rf"\b{_YEAR}-{_MONTH}-{_DAY}\b", rf"\1{_HELD}\2{_HELD}\3"),
    (rf"\b{_DAY}-{_MONTH}-{_YEAR}\b", rf"\1{_HELD}\2{_HELD}\3"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]"),
    (r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "[ip]"),
    (r"(?i)\bauthorization\s*:\s*(basic|bearer)\s+[A-Za-z0-9._~+/=-]+", "[secret]"),
    (r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]{16,}", "[secret]"),
    (r"(?i)\b(token|secret|password|passwd|pwd|(api|access|secret)[-_ ]?key)\b[\"'']?\s*[=:]\s*[\"'']?[^\s\"'',;]+[\"'']?", "[secret]"),
    (r"\b(AKIA|ASIA)[A-Z0-9]{16}\b", "[secret]"),
    (r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*", "[secret]"),
    (r"\b(gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,})", "[secret]"),
    (r"\+?[0-9][0-9 ()-]{7,}[0-9]", "[number]"),
    (f"{_YEAR}{_HELD}{_MONTH}{_HELD}{_DAY}", r"\1-\2-\3"),
    (f"{_DAY}{_HELD}{_MONTH}{_HELD}{_YEAR}", r"\1-\2-\3"),
]:
    _RED = f"regexp_replace({_RED}, '{_p}', '{_r}', 'g')"

ORACLE.update({
    "s3_allowed_columns": "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer",
    "s3_lineage_of_files": "SELECT c AS \"column\", c IN ('harmless', 'widest') AS refused, count(*) AS rows FROM events, (SELECT unnest(['event_id', 'harmless', 'widest', 'n', 'shifted']) AS c) GROUP BY ALL",
    "s4_publish": q(ADMIT, f"SELECT {CASE_COLS} FROM cases"),
    "s6_verify_manifest": q(ADMIT, "SELECT * FROM (VALUES ('cases', 'ok', 'stored'), ('ledger', 'ok', 'stored'), ('cases', 'extra', 'altered'), ('ledger', 'changed', 'altered'), "
                               "('lost', 'missing', 'altered')) v(dataset, status, against) WHERE (SELECT count(*) FROM cases) > 0 AND (SELECT count(*) FROM ledger) > 0"),
    "s7_same_content": q(REC, "SELECT count(*) AS rows_a, count(*) AS rows_b, CAST(0 AS BIGINT) AS only_a, CAST(0 AS BIGINT) AS only_b, TRUE AS same FROM pd"),
    "s7_row_differences": q(REC, """SELECT entity_id, day, 'only_a' AS status FROM pd WHERE (day(day) = 5 AND entity_id % 10 = 7) OR (day(day) = 1 AND entity_id % 10 = 2)
        UNION ALL SELECT entity_id, CAST(day + INTERVAL 400 DAY AS DATE), 'only_b' FROM pd WHERE day(day) = 1 AND entity_id % 10 = 2
        UNION ALL SELECT entity_id, day, 'changed' FROM pd WHERE day(day) = 9 AND entity_id % 10 = 3"""),
    "s8_fingerprint": f"WITH d AS (SELECT sha256({esc('conv_id')} || '#' || {esc('turn')} || '#' || {esc('role')} || '#' || {esc('text')}) AS dg FROM conversations) "
                      f"SELECT count(*) AS rows, sha256(CAST(count(*) AS VARCHAR) || '#' || {sums('dg')}) AS digest FROM d",
    "s9_nonfinite": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE isnan({c}) OR isinf({c})) AS nonfinite FROM lineitem"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
    "s10_ambiguous": "SELECT count(*) AS rows, 2 AS ambiguous FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "s11_currency": q(ADMIT, "SELECT max(case_day) AS latest_case_day, (SELECT max(day) FROM pd) AS as_of FROM cases"),
    "s12_append_actions": q(LOG, "SELECT CAST(ts AS DATE) AS day, action, count(*) AS n FROM act GROUP BY ALL"),
    "q5_kept_summaries": """SELECT l_returnflag, count(*) AS rows, count(l_discount) AS present_l_discount, min(l_discount) AS least_l_discount, max(l_discount) AS greatest_l_discount,
        count(*) FILTER (WHERE l_quantity > 45) AS broken_small, count(*) FILTER (WHERE l_tax <= 0) AS broken_taxed, l_returnflag = 'R' AS read
        FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 10) GROUP BY l_returnflag""",
    "q1_completeness": q(REC, " UNION ALL ".join(
        f"SELECT count(*) AS rows, '{c}' AS \"column\", count({c}) AS present, count(*) - count({c}) AS missing FROM spine" for c in ("load", "errors", "value_sum"))),
    "q2_range_check": q(LINE, "SELECT rule, n FROM findings WHERE rule LIKE 'range%'"),
    "q3_plausibility": q(LINE, "SELECT rule, n FROM findings WHERE rule IN ('returned_is_finished', 'discount_below_price')"),
    "q4_consistency": q(LINE, "SELECT rule, n FROM findings WHERE rule IN ('duplicate_key', 'orphan_l_orderkey')"),
    "q5_quality_summary": q(LINE, "SELECT severity, count(*) AS rules, count(*) FILTER (WHERE n > 0) AS failing, CAST(sum(coalesce(n, 0)) AS BIGINT) AS findings FROM rules LEFT JOIN findings USING (rule) GROUP BY 1"),
    "q7_gate": """SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM
        (SELECT *, count(*) OVER k AS n, count(*) FILTER (WHERE l_discount > 0.08::DOUBLE) OVER k AS e FROM lineitem
         WHERE l_orderkey % 50 <> 0 WINDOW k AS (PARTITION BY l_orderkey, l_linenumber)) WHERE n = 1 AND e = 0""",
    "p1_pseudonymise": q(ACC, "SELECT sha256('demo-key#' || sha256('demo-key#' || entity_id)) AS pseudonym, group_id FROM roster_all"),
    "p2_reidentify": q(ACC, f"SELECT sha256('demo-key#' || sha256('demo-key#' || entity_id)) AS pseudonym, entity_id, group_id FROM roster_all WHERE group_id IN ({scope('reviewer-1')})"),
    "p3_strip_ids": "SELECT c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "p4_authorised": q(ACC, f"SELECT entity_id, group_id, 'reviewer-1' AS account_id, 'support' AS purpose FROM roster_all WHERE group_id IN ({scope('reviewer-1')}) "
                            f"UNION ALL SELECT entity_id, group_id, 'lead-4', 'aggregate' FROM roster_all WHERE group_id IN ({scope('lead-4', 'aggregate')})"),
    "p5_effective_purpose": q(ACC, """SELECT account_id, declared, CASE WHEN list_contains(purposes, declared) THEN declared END AS effective,
        CASE WHEN list_contains(purposes, declared) THEN 'granted' ELSE 'refused' END AS outcome
        FROM acc CROSS JOIN (SELECT unnest(['support', 'aggregate', 'audit', 'infrastructure']) AS declared)"""),
    "p6_lookup": q(ACC, f"""SELECT entity_id, CASE WHEN group_id IN ({scope('reviewer-2')}) THEN 'found' ELSE 'not_found' END AS answer FROM roster_all
        UNION ALL SELECT -entity_id - 1, 'not_found' FROM roster_all"""),
    "p7_redact": f"SELECT doc_id, {_RED} AS text FROM documents",
    "p8_filter_queue": q(OPEN, P8),
    "p9_directory": q(ACC, f"SELECT entity_id, group_id FROM roster_all WHERE group_id IN ({scope('reviewer-3')})"),
    "p10_invalid_accounts": q(ACC, """SELECT account_id, role, purpose FROM (SELECT account_id, role, unnest(purposes) AS purpose FROM acc)
        WHERE (role, purpose) NOT IN (('reviewer', 'support'), ('lead', 'aggregate'), ('auditor', 'audit'), ('operator', 'infrastructure'))"""),
    "p11_aggregate_only": "SELECT count(*) AS rows, 'support' AS purpose FROM customer UNION ALL SELECT CAST(0 AS BIGINT), 'aggregate'",
    "p12_search_groups": "SELECT n_nationkey AS group_id, n_name AS group_name FROM nation WHERE contains(n_name, 'NATION_1')",
    "p13_scope_counts": q(ACC, "SELECT account_id, count(entity_id) AS visible FROM (SELECT account_id, unnest(groups) AS group_id FROM acc) LEFT JOIN roster_all USING (group_id) GROUP BY 1"),
    "e1_factors": q(FACT, "SELECT * FROM fct"),
    "e2_explain": q(FACT, "SELECT c.case_id, CAST(row_number() OVER (PARTITION BY c.case_id ORDER BY s DESC, metric) - 1 AS INTEGER) AS place, metric, value, reference, "
                     "window_start, window_end, rule, s.policy_version FROM cases c JOIN strong s USING (case_id) "
                     "UNION ALL SELECT case_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM cases WHERE case_id NOT IN (SELECT case_id FROM strong)"),
    "e3_explain_or_absent": q(FACT, "SELECT case_id, CASE WHEN case_id IN (SELECT case_id FROM fct) THEN 'recorded' ELSE 'not_recorded' END AS explanation_status FROM cases"),
    "e4_factor_count": q(FACT, "SELECT c.case_id, count(f.case_id) AS factors FROM cases c LEFT JOIN fct f USING (case_id) GROUP BY 1"),
    "e5_policy_at": q(ADMIT, "SELECT case_id, case_day, CASE WHEN case_day < DATE '2024-01-01' THEN NULL WHEN case_day < DATE '2024-01-16' THEN 'v1' ELSE 'v2' END AS valid_version FROM cases"),
    "e6_untraceable": q(FACT, "SELECT count(*) AS factors, count(*) FILTER (WHERE metric IS NULL OR value IS NULL OR reference IS NULL OR window_start IS NULL OR window_end IS NULL OR rule IS NULL OR policy_version IS NULL) AS untraceable FROM fct"),
    "r1_queue": q(ADMIT, "SELECT case_day, level, case_id FROM cases"),
    "r2_queue_for": q(ADMIT, "SELECT case_day, level, case_id FROM cases ORDER BY case_day DESC, CASE level WHEN 'high' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END DESC, case_id LIMIT 10"),
    "r3_staleness": q(ADMIT, """SELECT case_id, CAST(d AS INTEGER) AS age_days, d > 7 AS stale, CASE WHEN d > 7 THEN 'older data: ' || d || ' days' END AS chip
        FROM (SELECT case_id, (SELECT max(day) FROM spine) - case_day AS d FROM cases)"""),
    "r4_queue_header": q(OPEN + "," + FU + "," + LINE, """SELECT count(*) FILTER (WHERE state <> 'closed') AS open, count(*) FILTER (WHERE state = 'in_review') AS in_review,
        (SELECT count(*) FROM fus WHERE status IN ('due', 'overdue')) AS followups_due,
        (SELECT CAST(sum(n) AS BIGINT) FROM findings JOIN rules USING (rule) WHERE severity = 'warning') AS warnings FROM qcases"""),
    "r5_surfacing_reason": q(FACT, """SELECT c.case_id, coalesce(t.w, 'no new change; open until a person closes it') AS surfaced FROM cases c LEFT JOIN
        (SELECT case_id, metric || ': ' || rule AS w, row_number() OVER (PARTITION BY case_id ORDER BY s DESC, metric) AS i FROM strong) t ON t.case_id = c.case_id AND i = 1"""),
    "r6_signal_drift": q(ADMIT, """SELECT case_id, case_day, signal_day, signal, coalesce(signal_day <> case_day, FALSE) AS differs FROM cases
        LEFT JOIN (SELECT entity_id, max(day) AS signal_day, arg_max(material, day) AS signal FROM feat WHERE material IS NOT NULL GROUP BY 1) USING (entity_id)"""),
    "w1_current_state": q(LOG, "SELECT * FROM states"),
    "w2_invalid_actions": q(LOG, "SELECT case_id, seq, action, from_state, to_state, refusal FROM log WHERE NOT accepted"),
    "w3_missing_reason": q(LOG, "SELECT case_id, seq, action, reason_code FROM act WHERE NOT reasoned"),
    "w4_conflicts": q(LOG, "SELECT case_id, seq, action, expected_state, from_state AS actual_state FROM log WHERE refusal = 'conflict'"),
    "w5_history": q(LOG, "SELECT case_id, seq, action, from_state, to_state, row_number() OVER (PARTITION BY case_id ORDER BY n) AS step FROM log WHERE accepted"),
    "w6_reopens": q(LOG, "SELECT case_id, count(*) FILTER (WHERE accepted AND to_state = 'closed') AS closed_times, count(*) FILTER (WHERE accepted AND to_state = 'reopened') AS reopened_times FROM log GROUP BY 1"),
    "w7_open_cases": q(EPI + "," + LOG, """SELECT entity_id, state, recovered_day FROM
        (SELECT entity_id, arg_max_null(recovered_day, start_day) AS recovered_day FROM epi GROUP BY 1) JOIN states ON states.case_id = entity_id WHERE recovered_day IS NOT NULL AND state <> 'closed'"""),
    "w8_feedback": q(LOG, "SELECT case_id, nullif(reason_code, 'R11') AS idempotency_key, seq, action FROM act QUALIFY reason_code = 'R11' OR row_number() OVER (PARTITION BY case_id, reason_code ORDER BY ts, seq) = 1"),
    "w9_graph_drift": q(LOG, """,seen AS (SELECT DISTINCT action, from_state, to_state FROM log WHERE accepted),
        declared AS (SELECT * FROM (VALUES ('acknowledge','open','acknowledged'),('acknowledge','reopened','acknowledged'),('start_review','acknowledged','in_review'),
          ('progress_support','in_review','support_planned'),('progress_support','support_planned','support_completed'),('close','support_completed','closed'),
          ('reopen','closed','reopened'),('close','open','closed')) v(action, from_state, to_state))
        SELECT *, 'first' AS only_in FROM (SELECT * FROM seen EXCEPT SELECT * FROM declared) UNION ALL SELECT *, 'second' FROM (SELECT * FROM declared EXCEPT SELECT * FROM seen)"""),
    "f1_support_options": q(FACT, "SELECT case_id, 'm1' AS mapping_version, array_to_string(options, ',') AS options FROM opt"),
    "f2_feasibility": q(ADMIT + "," + DUTY, "SELECT case_id, busy_days, first_free, feasibility FROM feas"),
    "f2_busy_time": q(ADMIT + "," + DUTY, """SELECT case_id, count(s) AS duties, CAST(floor(coalesce(sum(date_diff('microsecond', greatest(s, w0), least(e, w0 + INTERVAL 72 HOUR))) FILTER (WHERE s IS NOT NULL), 0) / 1000000.0) AS BIGINT) AS seconds
        FROM (SELECT case_id, entity_id, CAST(case_day + 1 AS TIMESTAMP) AS w0 FROM cases) c LEFT JOIN duty d ON d.entity_id = c.entity_id AND e > s AND s < w0 + INTERVAL 72 HOUR AND e > w0 GROUP BY case_id"""),
    "f3_followup_status": q(FU, "SELECT * FROM fus"),
    "f4_requeue": q(ADMIT + "," + FU, """SELECT entity_id, min(source) AS source, count(*) AS items FROM
        (SELECT entity_id, 'case' AS source FROM cases UNION ALL SELECT entity_id, 'followup' FROM fus WHERE status IN ('due', 'overdue')) GROUP BY 1"""),
    "f5_follow_through": q(FU, """SELECT c_nationkey AS group_id, count(*) AS offered, count(due) AS schedulable, count(done) AS delivered, count(*) FILTER (WHERE done <= due) AS in_time
        FROM fu JOIN customer ON c_custkey = entity_id GROUP BY 1"""),
    "f6_next_step": q(FACT + "," + LOG + "," + DUTY, """SELECT c.case_id, coalesce(s.state, 'open') AS state, feasibility,
        CASE WHEN s.state = 'closed' THEN 'none' WHEN coalesce(s.state, 'open') IN ('open', 'reopened') THEN 'acknowledge' WHEN options IS NULL THEN 'talk_first'
             WHEN feasibility = 'now' THEN 'schedule_support' WHEN feasibility = 'with_adjustment' THEN 'arrange_support_day' ELSE 'escalate_scheduling' END AS next_step
        FROM cases c LEFT JOIN states s ON s.case_id = c.entity_id LEFT JOIN opt o ON o.case_id = c.case_id LEFT JOIN feas f ON f.case_id = c.case_id"""),
    "g1_group_summary": q(ADMIT + "," + DUTY, """SELECT c_nationkey AS group_id, count(*) AS members,
        (SELECT count(DISTINCT entity_id) FROM cases WHERE group_id = c_nationkey) AS attention,
        (SELECT count(*) FROM cases JOIN feas USING (case_id) WHERE group_id = c_nationkey AND feasibility = 'constrained') AS constrained FROM customer GROUP BY 1"""),
    "g2_group_trend": q(REC, """SELECT *, round(avg(load) OVER (PARTITION BY group_id ORDER BY period ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 6) AS load_before FROM
        (SELECT group_id, CAST(date_trunc('week', day) AS DATE) AS period, CAST(coalesce(sum(load), 0) AS BIGINT) AS load, CAST(coalesce(sum(errors), 0) AS BIGINT) AS errors,
                count(load) AS observed_days FROM spine GROUP BY ALL)"""),
    "g3_concentration": q(ADMIT, "SELECT group_id, count(*) AS n, round(count(*) / (SELECT count(*) FROM cases), 6) AS share FROM cases GROUP BY 1"),
    "g4_dashboard": q(ADMIT, """SELECT r_name AS region_name, n_name AS group_name, count(case_id) AS cases, count(*) FILTER (WHERE level = 'high') AS high
        FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN cases ON group_id = n_nationkey GROUP BY ROLLUP (r_name, n_name)"""),
    "g5_timeline": q(ADMIT, "SELECT f.entity_id, f.day, f.load, f.load_z, f.material, c.case_id, c.level FROM feat f LEFT JOIN cases c ON c.entity_id = f.entity_id AND c.case_day = f.day"),
    "r6_asof_error": """WITH m AS (SELECT *, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER w AS error_id,
        last_value(CASE WHEN event_type = 'error' THEN ts END IGNORE NULLS) OVER w AS error_ts FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type <> 'error', event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT event_id, user_id, error_id, CAST(floor(date_diff('microsecond', error_ts, ts) / 60000000.0) AS BIGINT) AS minutes FROM m WHERE event_type = 'purchase'""",
    "h1_chain": q(AUD, "SELECT conv_id, turn, segment, prev_hash, hash FROM ch"),
    "h1_heads_seal": q(AUD, f""", hd AS (SELECT sha256(conv_id || '#' || segment || '#' || events || '#' || head) AS dg FROM heads)
        SELECT count(*) AS segments, sha256(CAST(count(*) AS VARCHAR) || '#' || {sums('dg')}) AS seal FROM hd"""),
    "h1_log_seal": f"""WITH RECURSIVE {LEAVES},
        s AS (SELECT unnest([greatest(1, n // 2), n]) AS size FROM num),
        t(size, level, idx, h) AS (SELECT size, 0, position, leaf FROM s JOIN lv ON position < size UNION ALL
            SELECT a.size, a.level + 1, a.idx // 2, CASE WHEN b.h IS NULL THEN a.h ELSE sha256('node#' || a.h || b.h) END
            FROM t a LEFT JOIN t b ON b.size = a.size AND b.idx = a.idx + 1 WHERE a.idx % 2 = 0 AND a.size > (1::BIGINT << a.level))
        SELECT size AS events, arg_max(h, level) AS root, TRUE AS only_grew FROM t GROUP BY size""",
    "h2_inclusion": f"""WITH {LEAVES} SELECT conv_id, turn, position, (SELECT count(*) FROM range(62) k(k) WHERE (1::BIGINT << k) < n
            AND xor(position >> CAST(k AS INTEGER), 1) < (n + (1::BIGINT << k) - 1) // (1::BIGINT << k)) AS siblings, NOT (conv_id % 10 = 3 AND turn = 1) AS ok FROM lv, num""",
    "h3_altered_events": f"WITH {LEAVES} SELECT position, conv_id, turn FROM lv WHERE conv_id % 10 = 3 AND turn = 1",
    "h2_verify_chain": q(AUD, "SELECT * FROM ver"),
    "h3_first_break": q(AUD, "SELECT conv_id, turn AS first_broken, reason FROM ver WHERE NOT ok QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, reason) = 1"),
    "h4_health": q(AUD, "SELECT events, broken, healthy AND files <> 'bad' AS healthy, log, files FROM (SELECT count(*) AS events, CAST(0 AS BIGINT) AS broken, TRUE AS healthy, 'intact' AS log FROM ch "
                    "UNION ALL SELECT count(*), count(*) FILTER (WHERE NOT ok), bool_and(ok), 'tampered' FROM ver) CROSS JOIN (SELECT unnest(['none', 'good', 'bad']) AS files)"),
    "h5_action_trail": q(LOG, "SELECT ts, role, action, purpose, accepted FROM log"),
    "h6_purpose_summary": q(LOG, "SELECT purpose, role, CASE WHEN accepted THEN 'done' ELSE 'refused' END AS outcome, count(*) AS n FROM log GROUP BY ALL"),
    "l1_forward_label": q(LAB, "SELECT * FROM lab"),
    "l2_label_coverage": q(LAB, "SELECT count(*) AS entity_days, count(label) AS usable, count(*) - count(label) AS excluded, count(*) FILTER (WHERE label = 1) AS positive FROM lab"),
    "l3_time_split": q(LAB, "SELECT entity_id, day, label, split FROM sc"),
    "m3_roc_auc": q(LAB, "SELECT strategy, round(sum((rows - positives) * (2 * hits - positives)) / (2.0 * max(all_positives) * (max(all_rows) - max(all_positives))), 6) AS auc FROM cu GROUP BY 1"),
    "m4_average_precision": q(LAB, "SELECT strategy, round(sum(positives / all_positives * (hits / flagged)), 6) AS average_precision FROM cu GROUP BY 1"),
    "m5_precision_at": q(LAB, "SELECT strategy, percent, k, hits, round(hits / k, 6) AS precision FROM top"),
    "m6_f1_at": q(LAB, """SELECT strategy, threshold, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM
        (SELECT strategy, threshold, count(*) FILTER (WHERE score >= threshold AND label = 1) AS tp, count(*) FILTER (WHERE score >= threshold AND label = 0) AS fp,
                count(*) FILTER (WHERE score < threshold AND label = 1) AS fn
         FROM rk JOIN (SELECT * FROM (VALUES ('rule_score', 1.0::DOUBLE), ('temporal_score', 0.5::DOUBLE), ('load', 4.0::DOUBLE)) v(strategy, threshold)) USING (strategy) GROUP BY ALL)"""),
    "m7_sweep": q(LAB, "SELECT * FROM sw"),
    "m8_select_threshold": q(LAB.replace("/*split*/", "AND split = 'validation'"), """SELECT strategy, threshold, precision, recall, flag_rate, precision >= 0.4 AS meets_floor,
        coalesce(precision >= 0.4 AND row_number() OVER (PARTITION BY strategy, precision >= 0.4 ORDER BY recall DESC, threshold DESC) = 1, FALSE) AS chosen FROM sw"""),
    "m9_compare": q(LAB, "SELECT strategy, " + ", ".join(f"max(CASE WHEN percent = {p} THEN round(hits / k, 6) END) AS top_{p}" for p in (1, 2, 5, 10)) + " FROM top GROUP BY 1"),
    "m1_logreg": q(LAB, FIT),
    "m2_logreg_l2": q(LAB, FIT),
    "a3_model_score": q(LAB + "," + STORED, "SELECT strategy, round((sum(rk) FILTER (WHERE label = 1) - p * (p + 1) / 2.0) / (p * n), 6) AS auc FROM r "
                        "JOIN (SELECT strategy, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM r GROUP BY 1) USING (strategy) GROUP BY strategy, p, n"),
    "s5_manifest": f"WITH d AS (SELECT sha256({esc('conv_id')} || '#' || {esc('turn')} || '#' || {esc('role')} || '#' || {esc('text')}) AS dg FROM conversations) "
                   f"SELECT 'talk' AS dataset, TRUE AS listed, count(*) AS rows, sha256(CAST(count(*) AS VARCHAR) || '#' || {sums('dg')}) AS digest FROM d",
    "m10_no_peek": q(REC, "SELECT count(*) AS compared, CAST(0 AS BIGINT) AS changed FROM spine WHERE day <= DATE '2024-01-20'"),
})
