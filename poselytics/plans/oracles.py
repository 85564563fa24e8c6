"""DuckDB SQL giving the same results as the registered queries, written independently.

Session folds are recursive queries that walk a session frame by frame.
"""

from __future__ import annotations

EPOCH_US = 1704067200000000

FRAMES = f"""
frames AS (
  SELECT 'sess-' || user_id AS session_uuid,
         'f-' || event_id AS frame_track_uuid,
         event_id, user_id, event_type,
         {EPOCH_US} + frame_us AS ts_us,
         ({EPOCH_US} + frame_us) // 1000 AS ts_ms,
         user_id % 2 AS level,
         20 + 1.5 * CAST(json_extract_string(props, '$.k') AS DOUBLE) AS elbow,
         value % 60 AS shoulder,
         value * 0.25 AS offset_angle,
         frame_us / 1e6 AS current_time_s,
         CAST(50 + user_id % 40 AS DOUBLE) AS video_duration,
         coalesce(frame_us / 1e6 >= CAST(50 + user_id % 40 AS DOUBLE) - 0.1, false) AS is_complete
  FROM (SELECT *, (epoch_us(ts) - {EPOCH_US}) // 36000 AS frame_us FROM events
        WHERE ts IS NOT NULL AND user_id IS NOT NULL AND value IS NOT NULL)
)"""

STATES = """
states AS (
  SELECT f.*, abs(offset_angle) > 45.0 AS bad,
         CASE WHEN abs(offset_angle) > 45.0 THEN NULL
              WHEN elbow > 110 THEN 's1'
              WHEN elbow <= 110 AND elbow > CASE WHEN level = 0 THEN 70 ELSE 60 END THEN 's2'
              WHEN elbow <= CASE WHEN level = 0 THEN 70 ELSE 60 END THEN 's3' END AS state
  FROM frames f
)"""

RULES = """
rules(level, seq, angle, lo, hi, feedback_id, critical) AS (
  VALUES (0, 1, 'elbow', 50.0, NULL, 'lower_wrist', false),
         (0, 2, 'elbow', NULL, 60.0, 'raise_wrist', false),
         (0, 3, 'shoulder', 12.0, 35.0, 'keep_hand_near', false),
         (0, 4, 'shoulder', NULL, 40.0, 'hand_too_far', true),
         (1, 1, 'elbow', 50.0, NULL, 'lower_wrist', false),
         (1, 2, 'elbow', NULL, 60.0, 'raise_wrist', false),
         (1, 3, 'shoulder', 12.0, 20.0, 'keep_hand_near', false),
         (1, 4, 'shoulder', NULL, 25.0, 'hand_too_far', true)
)"""

VIOLATIONS = """
all_violations AS (
  SELECT s.session_uuid, s.frame_track_uuid, s.event_id, r.seq, r.feedback_id, r.critical
  FROM states s JOIN rules r ON r.level = s.level
   AND (CASE WHEN r.angle = 'elbow' THEN s.elbow ELSE s.shoulder END < r.lo
     OR CASE WHEN r.angle = 'elbow' THEN s.elbow ELSE s.shoulder END > r.hi)
  WHERE NOT s.bad AND s.state IS DISTINCT FROM 's1'
),
violations AS (
  SELECT * FROM (
    SELECT *, min(CASE WHEN critical THEN seq END) OVER (PARTITION BY event_id) AS stop FROM all_violations)
  WHERE seq <= coalesce(stop, seq)
),
classified AS (
  SELECT s.*, coalesce(v.critical, false) AS critical, v.ids
  FROM states s LEFT JOIN (
    SELECT event_id, bool_or(critical) AS critical, string_agg(feedback_id, ',' ORDER BY seq) AS ids
    FROM violations GROUP BY event_id) v USING (event_id)
)"""


def _life(timeout_s: float = 300.0, grace_s: float = 10.0, ttl_s: float = 1e9) -> str:
    timeout, grace, ttl = (round(x * 1_000_000) for x in (timeout_s, grace_s, ttl_s))
    return f"""
numbered AS (
  SELECT *, row_number() OVER w AS rn, lag(ts_us) OVER w AS prev_us FROM frames
  WINDOW w AS (PARTITION BY session_uuid ORDER BY ts_ms, frame_track_uuid, ts_us)
),
life AS (
  SELECT session_uuid, rn, 0 AS session_instance, 0 AS state_epoch, ts_us AS last_us,
         CASE WHEN is_complete THEN ts_us END AS done_us
  FROM numbered WHERE rn = 1
  UNION ALL
  SELECT session_uuid, rn, session_instance + CASE WHEN split THEN 1 ELSE 0 END,
         state_epoch + CASE WHEN ts_us - last_us > {ttl} THEN 1 ELSE 0 END, ts_us,
         CASE WHEN split OR done_us IS NULL THEN CASE WHEN is_complete THEN ts_us END ELSE done_us END
  FROM (SELECT l.session_uuid, n.rn, l.session_instance, l.state_epoch, l.last_us, l.done_us,
               n.ts_us, n.is_complete,
               (n.ts_us - l.last_us > {timeout}
                OR coalesce(n.ts_us > l.done_us + {grace}, false)) AS split
        FROM life l JOIN numbered n ON n.session_uuid = l.session_uuid AND n.rn = l.rn + 1)
),
tracked AS (
  SELECT n.*, l.session_instance, l.state_epoch
  FROM numbered n JOIN life l USING (session_uuid, rn)
)"""


def _fold(inactive_s: float | None = None, window_s: float = 2.5) -> str:
    limit = "CASE WHEN c.level = 0 THEN 25000000 ELSE 15000000 END" if inactive_s is None else str(round(inactive_s * 1_000_000))
    window = round(window_s * 1_000_000)
    return f"""
ordered AS (
  SELECT c.*, t.session_instance, t.state_epoch, {limit} AS lim,
         row_number() OVER (PARTITION BY c.session_uuid, t.session_instance, t.state_epoch ORDER BY t.rn) AS pos
  FROM classified c JOIN tracked t USING (event_id)
),
fold AS (
  SELECT DISTINCT session_uuid, session_instance, state_epoch, CAST(0 AS BIGINT) AS pos,
         CAST('s1' AS VARCHAR) AS curr, CAST(NULL AS VARCHAR) AS prev, CAST('' AS VARCHAR) AS seq,
         CAST(0 AS BIGINT) AS correct, CAST(0 AS BIGINT) AS incorrect,
         CAST(0 AS BIGINT) AS idle, CAST(0 AS BIGINT) AS front,
         false AS posture, false AS error, CAST(NULL AS BIGINT) AS last_us, CAST(NULL AS BIGINT) AS win,
         CAST(NULL AS VARCHAR) AS rep, false AS reset, CAST(NULL AS BIGINT) AS closed,
         CAST(NULL AS BIGINT) AS event_id
  FROM ordered
  UNION ALL
  SELECT session_uuid, session_instance, state_epoch, pos,
         CASE WHEN bad THEN curr ELSE state END,
         CASE WHEN bad THEN prev ELSE curr END,
         CASE WHEN full_seq THEN '' ELSE seq1 END,
         CASE WHEN reset THEN 0 WHEN full_seq AND NOT (posture OR error) THEN correct + 1 ELSE correct END,
         CASE WHEN reset THEN 0 WHEN full_seq AND (posture OR error) THEN incorrect + 1 ELSE incorrect END,
         CASE WHEN reset AND NOT bad THEN 0 ELSE idle1 END,
         CASE WHEN reset AND bad THEN 0 ELSE front1 END,
         CASE WHEN bad THEN true WHEN full_seq THEN false ELSE posture END,
         CASE WHEN bad THEN error WHEN full_seq THEN critical ELSE error OR critical END,
         ts_us,
         CASE WHEN bad THEN win WHEN win IS NULL OR ts_us - win >= {window} THEN ts_us ELSE win END,
         CASE WHEN full_seq THEN CASE WHEN posture OR error THEN 'incorrect' ELSE 'correct' END END,
         reset,
         CASE WHEN NOT bad AND ts_us - win >= {window} THEN win END,
         event_id
  FROM (
    SELECT *, CASE WHEN bad THEN front1 >= lim ELSE same AND idle1 >= lim END AS reset,
           NOT bad AND coalesce(state = 's1', false) AND length(seq1) = 8 AS full_seq
    FROM (
      SELECT *,
             CASE WHEN bad THEN idle WHEN same THEN idle + el ELSE 0 END AS idle1,
             CASE WHEN bad THEN front + el ELSE front END AS front1,
             CASE WHEN NOT bad AND coalesce(state IN ('s1', 's2', 's3'), false)
                       AND (seq = '' OR right(seq, 2) <> state)
                  THEN right(seq || state, 8) ELSE seq END AS seq1
      FROM (
        SELECT f.session_uuid, f.session_instance, f.state_epoch, o.pos, f.curr, f.prev, f.seq,
               f.correct, f.incorrect, f.idle, f.front, f.posture, f.error, f.last_us, f.win,
               o.event_id, o.bad, o.state, o.critical, o.ts_us, o.lim,
               coalesce(o.ts_us - f.last_us, 0) AS el,
               o.state IS NOT DISTINCT FROM f.curr AS same
        FROM fold f JOIN ordered o
          ON o.session_uuid = f.session_uuid AND o.session_instance = f.session_instance
         AND o.state_epoch = f.state_epoch AND o.pos = f.pos + 1)))
),
trace AS (
  SELECT f.*, o.frame_track_uuid, o.ts_us, o.ts_ms, o.bad, o.ids, o.is_complete
  FROM fold f JOIN ordered o USING (event_id)
),
final AS (
  SELECT session_uuid, session_instance,
         max(state_epoch) AS state_epoch,
         arg_max(correct, k) AS correct, arg_max(incorrect, k) AS incorrect,
         arg_max(curr, k) AS curr_state,
         arg_max(coalesce(prev, '-'), k) AS prev_state,
         arg_max(seq, k) AS seq, arg_max(idle, k) AS idle, arg_max(front, k) AS front,
         arg_max(posture, k) AS posture, arg_max(error, k) AS error,
         arg_max(ts_us, k) AS last_us, bool_or(is_complete) AS done, count(*) AS n_frames
  FROM (SELECT *, row_number() OVER (PARTITION BY session_uuid, session_instance
                                     ORDER BY ts_ms, frame_track_uuid, ts_us) AS k FROM trace)
  GROUP BY ALL
)"""


def _windows(min_ratio: float = 0.6, flush_open: bool = False) -> str:
    closed = "" if flush_open else "WHERE (session_uuid, session_instance, state_epoch, start_us) IN (SELECT (session_uuid, session_instance, state_epoch, closed) FROM trace WHERE closed IS NOT NULL)"
    return f"""
occurrences AS (
  SELECT t.session_uuid, t.session_instance, t.state_epoch, t.win AS start_us, v.feedback_id,
         t.ts_ms, t.frame_track_uuid, v.seq
  FROM trace t JOIN violations v USING (event_id)
  WHERE NOT t.bad AND t.closed IS NULL
),
per_id AS (
  SELECT session_uuid, session_instance, state_epoch, start_us, feedback_id, count(*) AS n,
         min((ts_ms, frame_track_uuid, seq)) AS first_seen
  FROM occurrences {closed}
  GROUP BY session_uuid, session_instance, state_epoch, start_us, feedback_id
),
counted AS (
  SELECT *, sum(n) OVER (PARTITION BY session_uuid, session_instance, state_epoch, start_us) AS total FROM per_id
),
windows AS (SELECT DISTINCT session_uuid, session_instance, state_epoch, start_us, start_us + 2500000 AS end_us FROM counted),
kept AS (SELECT *, n / total AS frame_ratio FROM counted WHERE n / total >= {min_ratio}),
totals AS (
  SELECT session_uuid, session_instance, state_epoch, count(*) AS total_windows,
         (max(end_us) - min(start_us)) / 1e6 AS duration
  FROM windows GROUP BY ALL
),
issues AS (
  SELECT k.session_uuid, k.session_instance, k.state_epoch, k.feedback_id, count(*) AS windows_count,
         CAST(sum(k.n) AS BIGINT) AS total_occurrences, count(*) / any_value(t.total_windows) AS window_ratio,
         min((k.start_us, k.first_seen)) AS first_seen
  FROM kept k JOIN totals t USING (session_uuid, session_instance, state_epoch) GROUP BY ALL
),
summary AS (
  SELECT f.*, coalesce(t.total_windows, 0) AS total_windows, t.duration AS exercise_duration
  FROM final f LEFT JOIN totals t USING (session_uuid, session_instance, state_epoch)
)"""


TEXTS = r"""
paragraphs AS (
  SELECT session_uuid, session_instance, state_epoch, start_us,
         'Time ' || printf('%.1f', start_us / 1e6) || '-' || printf('%.1f', (start_us + 2500000) / 1e6) || 's:' || chr(10)
         || string_agg('- ' || feedback_id || ' (persistence: ' || printf('%.2f', frame_ratio) || ')', chr(10) ORDER BY first_seen) AS p
  FROM kept GROUP BY session_uuid, session_instance, state_epoch, start_us
),
timelines AS (
  SELECT session_uuid, session_instance, state_epoch, string_agg(p, chr(10) || chr(10) ORDER BY start_us) AS timeline
  FROM paragraphs GROUP BY ALL
),
issue_lines AS (
  SELECT session_uuid, session_instance, state_epoch,
         string_agg('- ' || feedback_id || ': occurred in ' || printf('%.1f', window_ratio * 100.0) || '% of exercise time',
                    chr(10) ORDER BY first_seen) AS lines
  FROM issues GROUP BY ALL
),
texts AS (
  SELECT s.*, coalesce(t.timeline, '') AS timeline, coalesce(i.lines, '') AS summary_text
  FROM summary s
  LEFT JOIN timelines t USING (session_uuid, session_instance, state_epoch)
  LEFT JOIN issue_lines i USING (session_uuid, session_instance, state_epoch)
),
prompts AS (
  SELECT *, 'You are a professional trainer. Review this dumbbell-arm session for safety and efficiency.'
    || chr(10) || chr(10) || 'Duration: ' || CAST(exercise_duration AS VARCHAR) || ' seconds'
    || chr(10) || 'Correct repetitions: ' || correct
    || chr(10) || 'Incorrect repetitions: ' || incorrect
    || chr(10) || chr(10) || 'Timeline of issues:' || chr(10) || timeline
    || chr(10) || chr(10) || 'Feedback summary:' || chr(10) || summary_text
    || chr(10) || chr(10) || 'Consider dangerous combinations of issues, the risk of injury, crucial corrections, progress during the session, advice for later sessions and overall quality.'
    || chr(10) || 'Reply with one JSON object holding: safety_analysis (status: safe, warning or dangerous; risk_level: 1-10; critical_corrections: list), performance_analysis (quality_score: 1-10; main_issues: list of issue, severity, description; progress_evaluation), recommendations (critical_corrections, improvement_suggestions, future_session_tips: lists) and reasoning.' AS prompt
  FROM texts
)"""


def _sql(select: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(c.strip() for c in ctes) + "\n" + select.strip()


def _trace(select: str, *more: str, inactive_s: float | None = None, **life: float) -> str:
    return _sql(select, FRAMES, STATES, RULES, VIOLATIONS, _life(**life), _fold(inactive_s), *more)


_MESSAGES = r"""
messages AS (
  SELECT event_id % 20 AS kind, event_id, user_id, ts, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
    '{"frame_track_uuid":"f-' || event_id || '","timestamp":"'
    || CASE WHEN event_id % 20 = 3 THEN 'yesterday' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END
    || '","exercise":' || CASE WHEN event_id % 20 = 2 THEN 'null' ELSE '"dumbbell-arm"' END || ','
    || CASE WHEN event_id % 20 = 1 THEN '' ELSE '"session_uuid":"sess-' || user_id || '",' END
    || '"video_duration":60,"landmarks":'
    || CASE event_id % 20 WHEN 7 THEN '[{"x":1}]' WHEN 8 THEN 'null' ELSE '[{"x":1,"y":2}]' END
    || ',"metrics":{"angles":[{"name":"elbow_angle","value":'
    || CASE WHEN event_id % 20 = 9 THEN 'null' ELSE json_extract_string(props, '$.k') END
    || ',"point1":{"x":1,"y":2},"point2":{"x":1,"y":2},"ref_point":{"x":1,"y":2}}],"dominant_side":'
    || CASE WHEN event_id % 20 = 10 THEN '{"side":"left"}' ELSE '{"side":"left","probability":null}' END || '}'
    || CASE event_id % 20 WHEN 4 THEN '' WHEN 5 THEN ',"current_time":null' WHEN 6 THEN ',"current_time":"soon"'
       ELSE ',"current_time":' || json_extract_string(props, '$.k') END
    || CASE WHEN event_id % 20 = 0 THEN '' ELSE '}' END AS raw
  FROM events
),
checked AS (
  SELECT *, CASE WHEN NOT json_valid(raw) THEN 'bad_json'
        WHEN NOT list_contains(json_keys(raw), 'session_uuid') THEN 'missing_session_uuid'
    WHEN NOT list_contains(json_keys(raw), 'current_time') THEN 'missing_current_time'
    WHEN json_type(raw, '$.exercise') = 'NULL' THEN 'invalid_exercise'
    WHEN json_type(raw, '$.landmarks') = 'NULL' THEN 'invalid_landmarks'
    WHEN TRY_CAST(json_extract_string(raw, '$.timestamp') AS TIMESTAMP) IS NULL THEN 'invalid_timestamp'
    WHEN json_type(raw, '$.current_time') = 'VARCHAR' THEN 'invalid_current_time'
    WHEN json_extract_string(raw, '$.landmarks[0].y') IS NULL THEN 'invalid_landmarks'
    WHEN json_extract_string(raw, '$.metrics.angles[0].value') IS NULL
      OR NOT list_contains(json_keys(raw, '$.metrics.dominant_side'), 'probability') THEN 'invalid_metrics'
    END AS reject_reason
  FROM messages
)"""

_CURSORS = f"""
cursors AS (
  SELECT DISTINCT 'sess-' || user_id AS session_uuid, {EPOCH_US // 1000} + 20000 + (user_id % 5) * 1000 AS last_ms
  FROM events WHERE user_id % 3 <> 0
),
buffered AS (
  SELECT f.session_uuid, f.frame_track_uuid, f.ts_ms, coalesce(c.last_ms, 0) AS last_ms
  FROM frames f LEFT JOIN cursors c USING (session_uuid)
)"""

_UNTIL = EPOCH_US // 1000 + 40_000
_DUE = f"ts_ms BETWEEN last_ms + 1 AND {_UNTIL}"

_FINAL_COLUMNS = """session_uuid, session_instance, correct, incorrect, curr_state,
  CASE WHEN prev_state <> '-' THEN prev_state END AS prev_state"""


def oracle_sql() -> dict[str, str]:
    sql = {
        "frame_parse_rejects": _sql(
            "SELECT raw, reject_reason FROM checked WHERE reject_reason IS NOT NULL", _MESSAGES
        ),
        "frames_parsed": _sql(
            """SELECT 'f-' || event_id AS frame_track_uuid, epoch_us(ts) AS ts_us, 'sess-' || user_id AS session_uuid,
                 CAST(60 AS DOUBLE) AS video_duration, CASE WHEN kind <> 5 THEN k END AS current_time,
                 k AS elbow_angle, CAST(1 AS INTEGER) AS n_landmarks
               FROM checked WHERE reject_reason IS NULL""",
            _MESSAGES,
        ),
        "frames_dedup": _sql(
            """SELECT DISTINCT session_uuid, frame_track_uuid, ts_us, current_time_s AS current_time
               FROM (SELECT * FROM frames UNION ALL SELECT * FROM frames)""",
            FRAMES,
        ),
        "buffer_retention": _sql(
            """SELECT session_uuid, frame_track_uuid, ts_ms, arrival_seq,
                 coalesce(max(ts_ms) OVER (PARTITION BY session_uuid ORDER BY arrival_seq
                   ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - ts_ms >= 30000, false) AS is_evicted
               FROM (SELECT *, (event_id % 7) * 1000000000000 + event_id AS arrival_seq FROM frames)""",
            FRAMES,
        ),
        "frames_range": _sql(
            f"""SELECT session_uuid, frame_track_uuid, ts_ms FROM frames
                WHERE ts_us BETWEEN {EPOCH_US + 10_000_000} AND {EPOCH_US + 20_000_000}""",
            FRAMES,
        ),
        "incremental_consume": _sql(
            f"SELECT session_uuid, frame_track_uuid, ts_ms FROM buffered WHERE {_DUE}", FRAMES, _CURSORS
        ),
        "buffer_remaining": _sql(
            f"SELECT session_uuid, frame_track_uuid, ts_ms FROM buffered WHERE NOT ({_DUE})", FRAMES, _CURSORS
        ),
        "consume_cursors": _sql(
            f"""SELECT session_uuid, max(last_ms) AS last_ms FROM (
                  SELECT * FROM cursors UNION ALL SELECT session_uuid, {_UNTIL} FROM buffered WHERE {_DUE})
                GROUP BY ALL""",
            FRAMES,
            _CURSORS,
        ),
        "late_frames": _sql(
            "SELECT session_uuid, frame_track_uuid, ts_ms FROM buffered WHERE ts_ms <= last_ms", FRAMES, _CURSORS
        ),
        "active_sessions": _sql("SELECT DISTINCT session_uuid FROM frames", FRAMES),
        "latest_frame": _sql(
            """SELECT session_uuid, ts_ms, frame_track_uuid, ts_us, elbow AS elbow_angle FROM frames
               QUALIFY row_number() OVER (PARTITION BY session_uuid
                 ORDER BY ts_ms DESC, frame_track_uuid DESC, ts_us DESC) = 1""",
            FRAMES,
        ),
        "clean_old_frames": _sql(
            f"SELECT session_uuid, frame_track_uuid, ts_ms FROM frames WHERE ts_ms > {EPOCH_US // 1000 + 20_000}",
            FRAMES,
        ),
        "idle_gaps": _sql(
            """SELECT * FROM (
                 SELECT session_uuid, frame_track_uuid, lag(ts_us) OVER w AS prev_us, ts_us,
                        ts_us - lag(ts_us) OVER w AS gap_us
                 FROM frames WINDOW w AS (PARTITION BY session_uuid ORDER BY ts_ms, frame_track_uuid, ts_us))
               WHERE gap_us > 2000000""",
            FRAMES,
        ),
        "frame_angles": _sql(
            """SELECT session_uuid, frame_track_uuid, angle, value FROM (
                 SELECT *, row_number() OVER (PARTITION BY frame_track_uuid, angle ORDER BY place DESC) AS r FROM (
                   SELECT session_uuid, frame_track_uuid, 1 AS place, 'elbow_angle' AS angle, elbow AS value FROM frames
                   UNION ALL SELECT session_uuid, frame_track_uuid, 2, 'shoulder_angle', shoulder FROM frames
                   UNION ALL SELECT session_uuid, frame_track_uuid, 3, 'offset_angle', offset_angle FROM frames
                   UNION ALL SELECT session_uuid, frame_track_uuid, 4, 'elbow_angle', elbow * 2 FROM frames))
               WHERE r = 1""",
            FRAMES,
        ),
        "posture_flags": _sql(
            "SELECT session_uuid, frame_track_uuid, bad AS bad_posture FROM states", FRAMES, STATES
        ),
        "frame_states": _sql(
            "SELECT session_uuid, frame_track_uuid, CAST(level AS INTEGER) AS level, state FROM states",
            FRAMES.replace("frames AS", "one_level AS", 1),
            "frames AS (SELECT o.* REPLACE (l.level AS level) FROM one_level o, (VALUES (0), (1)) l(level))",
            STATES,
        ),
        "session_exercise": _sql(
            """SELECT session_uuid, event_type AS session_exercise FROM frames
               QUALIFY row_number() OVER (PARTITION BY session_uuid ORDER BY ts_ms, frame_track_uuid, ts_us) = 1""",
            FRAMES,
        ),
        "unknown_exercise": _sql(
            "SELECT session_uuid, frame_track_uuid, event_type AS exercise FROM frames WHERE event_type <> 'click'",
            FRAMES,
        ),
        "frame_rule_rejects": _sql(
            """SELECT session_uuid, frame_track_uuid, exercise, reject_reason FROM (
                 SELECT *, CASE WHEN event_type IN ('click', 'view') THEN 'dumbbell-arm' ELSE event_type END AS exercise,
                   CASE WHEN event_type NOT IN ('click', 'view') THEN 'unknown_exercise'
                        WHEN event_id % 4 = 2 THEN 'missing_angle'
                        WHEN event_id % 4 = 1 AND abs(offset_angle) <= 45.0 THEN 'missing_angle' END AS reject_reason
                 FROM frames)
               WHERE reject_reason IS NOT NULL""",
            FRAMES,
        ),
        "frame_violations": _sql(
            """SELECT session_uuid, frame_track_uuid, feedback_id,
                 CAST(row_number() OVER (PARTITION BY event_id ORDER BY seq) - 1 AS INTEGER) AS seq
               FROM all_violations""",
            FRAMES,
            STATES,
            RULES,
            VIOLATIONS,
        ),
        "frame_feedback_catalog": _sql(
            """SELECT session_uuid, frame_track_uuid, exercise, bad AS bad_posture, state,
                 coalesce(string_agg(feedback_id, ',' ORDER BY j) FILTER (broken AND j <= coalesce(stop, j)), '') AS feedback_ids,
                 bool_or(broken AND critical) AS critical
               FROM (SELECT *, min(CASE WHEN broken AND critical THEN j END) OVER (PARTITION BY event_id) AS stop
                     FROM (SELECT v.*, t.j, 'rule-' || t.j AS feedback_id, k % 4 = 0 OR j = 2 AS critical,
                             NOT bad AND state IS DISTINCT FROM 's1' AND shoulder > 45 - 2 * j + k % 5
                               AND (k % 4 = 0 OR j < 3) AS broken
                           FROM variants v, range(20) AS t(j)))
               GROUP BY event_id, session_uuid, frame_track_uuid, exercise, bad, state""",
            FRAMES,
            """kinds(event_type, i) AS (VALUES ('click', 0), ('error', 1), ('purchase', 2), ('signup', 3), ('view', 4)),
            numbered AS (
              SELECT f.*, 16 * i + user_id % 16 AS k, f.event_type || '-' || user_id % 16 AS exercise
              FROM frames f JOIN kinds USING (event_type)),
            limits AS (
              SELECT *, CASE WHEN level = 0 THEN 60 ELSE 65 END + k % 7 AS low, 100 + k % 13 AS high,
                     abs(offset_angle) > 40.0 + k % 6 AS bad
              FROM numbered),
            variants AS (
              SELECT *, CASE WHEN bad THEN NULL
                             WHEN elbow > high THEN 's1'
                             WHEN low < elbow AND elbow <= high AND NOT elbow % 10 < k % 3 THEN 's2'
                             WHEN elbow <= low OR (elbow + shoulder) / 2 > 70 THEN 's3' END AS state
              FROM limits)""",
        ),
        "frame_feedback": _sql(
            """SELECT session_uuid, frame_track_uuid, ts_us, coalesce(ids, '') AS feedback_ids
               FROM classified WHERE NOT bad""",
            FRAMES,
            STATES,
            RULES,
            VIOLATIONS,
        ),
        "feedback_messages": _sql(
            """SELECT session_uuid, frame_track_uuid,
                 CAST(row_number() OVER (PARTITION BY event_id ORDER BY seq) - 1 AS INTEGER) AS seq,
                 feedback_id, m.message, m.severity
               FROM violations LEFT JOIN (VALUES
                 ('lower_wrist', 'LOWER YOUR WRIST', 'warning'),
                 ('raise_wrist', 'HIGHER YOUR WRIST', 'warning'),
                 ('keep_hand_near', 'KEEP YOUR HAND NEAR THE BODY', 'warning'),
                 ('hand_too_far', 'HAND TOO FAR FROM BODY', 'critical')) m(feedback_id, message, severity)
               USING (feedback_id)""",
            FRAMES,
            STATES,
            RULES,
            VIOLATIONS,
        ),
        "rep_counts": _trace("SELECT session_uuid, session_instance, correct, incorrect FROM final"),
        "rep_correctness": _trace(
            "SELECT session_uuid, session_instance, ts_us, frame_track_uuid, rep FROM trace WHERE rep IS NOT NULL"
        ),
        "inactivity_resets": _trace(
            "SELECT session_uuid, session_instance, ts_us, frame_track_uuid FROM trace WHERE reset AND NOT bad",
            inactive_s=1.5,
        ),
        "posture_resets": _trace(
            "SELECT session_uuid, session_instance, ts_us, frame_track_uuid FROM trace WHERE reset AND bad",
            inactive_s=1.5,
        ),
        "session_state": _trace(
            f"""SELECT {_FINAL_COLUMNS},
                  CASE WHEN length(seq) > 2 THEN array_to_string(regexp_extract_all(seq, 's.'), ',') ELSE seq END AS state_seq,
                  idle AS inactive_us, front AS inactive_front_us, posture AS incorrect_posture,
                  error AS critical_error, last_us, done AS is_completing
                FROM final""",
            inactive_s=1.5,
            timeout_s=5.0,
        ),
        "session_state_ttl": _trace(
            """SELECT session_uuid, session_instance, state_epoch, correct, incorrect,
                 array_to_string(regexp_extract_all(seq, 's.'), ',') AS state_seq FROM final""",
            ttl_s=3.0,
        ),
        "feedback_windows": _trace(
            """SELECT w.session_uuid, w.session_instance, w.start_us, w.end_us, k.feedback_id, k.n AS count, k.frame_ratio
               FROM windows w LEFT JOIN kept k USING (session_uuid, session_instance, state_epoch, start_us)""",
            _windows(),
        ),
        "feedback_windows_low_share": _trace(
            """SELECT w.session_uuid, w.session_instance, w.start_us,
                 coalesce(string_agg(k.feedback_id || ':' || k.n, ',' ORDER BY k.first_seen), '') AS feedback
               FROM windows w LEFT JOIN kept k USING (session_uuid, session_instance, state_epoch, start_us)
               GROUP BY ALL""",
            _windows(0.2, True),
        ),
        "feedback_summary": _trace(
            """SELECT session_uuid, session_instance, feedback_id, windows_count, total_occurrences, window_ratio
               FROM issues""",
            _windows(),
        ),
        "issue_tiers": _trace(
            """SELECT session_uuid, session_instance, feedback_id, window_ratio,
                 CASE WHEN window_ratio >= 0.7 THEN 'main' ELSE 'occasional' END AS tier
               FROM issues WHERE window_ratio >= 0.3""",
            _windows(),
        ),
        "exercise_summary": _trace(
            """SELECT s.session_uuid, s.session_instance, s.total_windows, s.exercise_duration, s.correct, s.incorrect,
                 CAST(coalesce((SELECT count(DISTINCT start_us) FROM kept k WHERE k.session_uuid = s.session_uuid
                   AND k.session_instance = s.session_instance), 0) AS INTEGER) AS windows_with_feedback,
                 coalesce((SELECT string_agg(feedback_id, ',' ORDER BY first_seen) FROM issues i
                   WHERE i.session_uuid = s.session_uuid AND i.session_instance = s.session_instance), '') AS issues
               FROM summary s""",
            _windows(),
        ),
        "session_lifecycle": _sql(
            """SELECT session_uuid, session_instance, count(*) AS n_frames, min(ts_us) AS first_us,
                 max(ts_us) AS last_active_us, bool_or(is_complete) AS is_completing,
                 'dumbbell-arm' AS last_exercise,
                 CASE WHEN bool_or(is_complete) THEN 'completed' ELSE 'timeout' END AS status
               FROM tracked GROUP BY session_uuid, session_instance""",
            FRAMES,
            _life(timeout_s=5.0),
        ),
        "analysis_rejects": _sql(
            """SELECT session_uuid, session_instance, frame_track_uuid, opened AS session_exercise,
                 'unknown_exercise' AS reject_reason
               FROM (SELECT *, first_value(event_type) OVER (
                       PARTITION BY session_uuid, session_instance ORDER BY rn) AS opened FROM tracked)
               WHERE opened NOT IN ('click', 'view')""",
            FRAMES,
            _life(timeout_s=5.0),
        ),
        "reopened_exercise": _sql(
            """SELECT session_uuid, session_instance, arg_min(event_type, rn) AS session_exercise
               FROM tracked GROUP BY session_uuid, session_instance""",
            FRAMES,
            _life(timeout_s=5.0),
        ),
        "session_reports": _trace(
            """SELECT session_uuid, session_instance,
                 CASE WHEN done THEN 'completed' ELSE 'timeout' END AS status,
                 CASE WHEN done THEN 'dumbbell-arm' END AS exercise,
                 CASE WHEN done THEN last_us END AS last_us, correct, incorrect, curr_state, seq AS state_seq,
                 idle / 1e6 AS inactive_time, error AS critical_error, total_windows, exercise_duration
               FROM summary""",
            _windows(),
        ),
        "running_sessions": _trace(
            f"""SELECT session_uuid, session_instance, CASE WHEN done THEN 'completed' ELSE 'timeout' END AS status
               FROM (SELECT *, max(session_instance) OVER (PARTITION BY session_uuid) AS newest FROM summary)
               WHERE done OR session_instance < newest OR {EPOCH_US + 72_000_000} - last_us > 1000000""",
            _windows(),
            timeout_s=5.0,
        ),
        "report_messages": _trace(
            """SELECT session_uuid, CAST(session_instance AS INTEGER) AS session_instance,
                 CASE WHEN done THEN 'completed' ELSE 'timeout' END AS status,
                 CASE WHEN done THEN strftime(make_timestamp(last_us), '%Y-%m-%dT%H:%M:%S.%fZ') END AS timestamp,
                 correct, total_windows FROM summary""",
            _windows(),
        ),
        "share_text": """
            SELECT event_id, printf('%.2f', share) AS share, printf('%.1f', share * 100.0) AS percent
            FROM (SELECT event_id, (CAST(json_extract_string(props, '$.k') AS DOUBLE) * 2 + 1) / 200.0 AS share FROM events)""",
        "timeline_text": _trace(
            "SELECT session_uuid, session_instance, timeline FROM texts", _windows(), TEXTS
        ),
        "summary_text": _trace(
            "SELECT session_uuid, session_instance, summary_text FROM texts", _windows(), TEXTS
        ),
        "prompt": _trace("SELECT session_uuid, session_instance, prompt FROM prompts", _windows(), TEXTS),
        "analysis_parsed": _trace(
            """SELECT session_uuid, session_instance,
                 CASE WHEN n % 5 <> 0 THEN 'safe' END AS status,
                 CASE WHEN n % 5 <> 0 THEN CAST(n % 10 + 1 AS INTEGER) END AS risk_level,
                 CASE WHEN n % 5 <> 0 THEN CAST(n % 7 + 1 AS INTEGER) END AS quality_score,
                 CASE WHEN n % 5 <> 0 THEN 'ru ' || n END AS reasoning
               FROM (SELECT *, length(prompt) AS n FROM prompts)""",
            _windows(),
            TEXTS,
        ),
        "run_metrics": _sql(
            """SELECT ts_ms // 1000 AS second, count(*) AS frames_processed,
                 count(*) FILTER (bad) AS bad_posture_frames, count(DISTINCT session_uuid) AS active_sessions
               FROM states GROUP BY ALL""",
            FRAMES,
            STATES,
        ),
    }
    # the streaming engine gives what the batch engine gives
    sql["stream_reps"] = sql["rep_correctness"]
    sql["stream_windows"] = sql["feedback_windows"]
    sql["stream_reports"] = _trace(
        """SELECT session_uuid, session_instance, CASE WHEN done THEN 'completed' ELSE 'timeout' END AS status,
             CASE WHEN done THEN 'dumbbell-arm' END AS exercise, CASE WHEN done THEN last_us END AS last_us,
             correct, incorrect, total_windows, exercise_duration,
             coalesce((SELECT string_agg(feedback_id, ',' ORDER BY first_seen) FROM issues i
               WHERE i.session_uuid = s.session_uuid AND i.session_instance = s.session_instance), '') AS issues
           FROM summary s""",
        _windows(),
    )
    sql["stream_report_messages"] = sql["report_messages"]
    sql["stream_rejects"] = sql["frame_rule_rejects"]
    sql["stream_metrics"] = _sql(
        """SELECT count(*) + 1 AS frames_processed, count(reject_reason) + 1 AS frames_rejected, CAST(0 AS BIGINT) AS rows_too_late
           FROM (SELECT CASE WHEN event_type NOT IN ('click', 'view') THEN 'unknown_exercise'
                             WHEN event_id % 4 = 2 THEN 'missing_angle'
                             WHEN event_id % 4 = 1 AND abs(offset_angle) <= 45.0 THEN 'missing_angle' END AS reject_reason
                 FROM frames)""",
        FRAMES,
    )
    sql["stream_reopened"] = _sql(
        """SELECT session_uuid, session_instance, count(*) AS n_frames,
             CASE WHEN bool_or(is_complete) THEN 'completed' ELSE 'timeout' END AS status
           FROM tracked GROUP BY session_uuid, session_instance""",
        FRAMES,
        _life(timeout_s=5.0),
    )
    # two versions of one threshold, each valid for its time
    changed = STATES.replace("110", f"(CASE WHEN ts_us >= {EPOCH_US + 30_000_000} THEN 100 ELSE 110 END)")
    sql["stream_catalog_change"] = _sql(
        "SELECT session_uuid, session_instance, ts_us, frame_track_uuid, rep FROM trace WHERE rep IS NOT NULL",
        FRAMES,
        changed,
        RULES,
        VIOLATIONS,
        _life(),
        _fold(),
    )
    sql["catalog_rules"] = _sql(
        """SELECT event_type AS exercise, count(*) AS n_frames,
             CASE WHEN event_type = 'click' THEN CAST(6 AS BIGINT) END AS n_states,
             CASE WHEN event_type = 'click' THEN CAST(8 AS BIGINT) END AS n_rules,
             CASE event_type WHEN 'error' THEN 'beginner: unsupported value in condition: ''elbow_angle.value > 1'''
               WHEN 'purchase' THEN 'pro: INACTIVE_THRESH is missing'
               WHEN 'signup' THEN 'beginner: a rule of elbow_angle has no feedback' END AS reason
           FROM frames GROUP BY event_type""",
        FRAMES,
    )
    return sql
