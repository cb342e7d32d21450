"""The registered queries as plain SQL over the same tables, written independently of Spark."""

from __future__ import annotations

from voxframe import dims
from voxframe.functions.text import CJK_WIDE_CLASS, IDEOGRAPH_CLASS, NEAR_DUPLICATE_RATIO, WHITESPACE_CHARS
from voxframe.plans.inputs import HEADER_COLUMNS, JOB_COLUMNS, LINE_FLAG, LINE_LOUD, LINE_STREAM, RESET_EVENT
from voxframe.plans.queries import SCRIPT_SOURCE, SCRIPT_TARGET, SESSION_GAP_S


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


SPACE = _quoted(WHITESPACE_CHARS)
SPACE_RUN = _quoted("[" + WHITESPACE_CHARS + "]+")


def _strip(x: str) -> str:
    return f"trim({x}, {SPACE})"


def _few_distinct(items: str) -> str:
    return f"coalesce(len({items}) >= 4 AND len(list_distinct({items})) / len({items}) < 0.3, false)"


def _words(x: str) -> str:
    return f"[word for word in regexp_split_to_array(lower({x}), {SPACE_RUN}) if word <> '']"


def _same(a: str, b: str) -> str:
    return f"({_strip(a)} <> '' AND {_strip(b)} <> '' AND lower({_strip(a)}) = lower({_strip(b)}))"


def _near(a: str, b: str) -> str:
    """Near duplicates, with the table ``near_pairs`` of folded pairs that reach the ratio."""
    return f"({_same(a, b)} OR (lower({_strip(a)}), lower({_strip(b)})) IN (SELECT a, b FROM near_pairs))"


def _similar(pairs: str) -> str:
    """CTEs up to ``near_pairs``: the folded (a, b) of ``pairs`` whose matching blocks reach the ratio.

    Longest common block first, then left and right of it, each in its part of both texts. Characters that a long second text is full
    of start no block, but blocks grow over them. Pairs without enough characters in common are left out before.
    """
    fold = "lower(trim({x}, " + SPACE + "))"
    return f"""
cand AS (
  SELECT DISTINCT {fold.format(x="p")} AS a, {fold.format(x="q")} AS b FROM ({pairs})
),
kept AS (
  SELECT row_number() OVER () AS id, a, b, string_split(a, '') AS x, string_split(b, '') AS y, length(a) AS la, length(b) AS lb
  FROM cand
  WHERE a <> '' AND b <> '' AND a <> b AND 2.0 * least(length(a), length(b)) / (length(a) + length(b)) >= {NEAR_DUPLICATE_RATIO}
    AND 2.0 * list_sum([least(length(a) - length(replace(a, c, '')), length(b) - length(replace(b, c, '')))
                        for c in list_distinct(string_split(a, ''))]) / (length(a) + length(b)) >= {NEAR_DUPLICATE_RATIO}
),
left_at AS (SELECT id, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM kept),
right_at AS (SELECT id, lb, unnest(y) AS c, generate_subscripts(y, 1) AS j FROM kept),
rare AS (
  SELECT id, c, j FROM (SELECT *, count(*) OVER (PARTITION BY id, c) AS n FROM right_at) WHERE lb < 200 OR n <= lb // 100 + 1
),
cells AS (
  SELECT id, i, j, row_number() OVER (PARTITION BY id, i - j, g ORDER BY i) AS k
  FROM (
    SELECT l.id, i, j, i - row_number() OVER (PARTITION BY l.id, i - j ORDER BY i) AS g
    FROM left_at l JOIN rare r ON r.id = l.id AND r.c = l.c
  )
),
blocks AS (
  SELECT id, CAST(1 AS BIGINT) AS ia, CAST(la AS BIGINT) AS ib, CAST(1 AS BIGINT) AS ja, CAST(lb AS BIGINT) AS jb, CAST(NULL AS BIGINT) AS n FROM kept
  UNION ALL
  SELECT id, part.ia, part.ib, part.ja, part.jb, part.n
  FROM (
    SELECT id, unnest([
      {{'ia': ia, 'ib': ib, 'ja': ja, 'jb': jb, 'n': size}},
      {{'ia': ia, 'ib': i - 1, 'ja': ja, 'jb': j - 1, 'n': NULL}},
      {{'ia': i + size, 'ib': ib, 'ja': j + size, 'jb': jb, 'n': NULL}}]) AS part
    FROM (
      -- The block, grown to both sides over equal characters.
      SELECT id, ia, ib, ja, jb, i - back AS i, j - back AS j, size + back + ahead AS size
      FROM (
        SELECT *,
          CASE WHEN size = 0 THEN 0 ELSE coalesce(list_position(
            [x[i - t] <> y[j - t] for t in range(1, least(i - ia, j - ja) + 1)], true) - 1, least(i - ia, j - ja)) END AS back,
          coalesce(list_position([x[i + size + t] <> y[j + size + t] for t in range(0, least(ib - i - size, jb - j - size) + 1)], true) - 1,
            least(ib - i - size, jb - j - size) + 1) AS ahead
        FROM (
          SELECT id, ia, ib, ja, jb, coalesce(-best.minus, 0) AS size, coalesce(best.i + best.minus + 1, ia) AS i,
                 coalesce(best.j + best.minus + 1, ja) AS j
          FROM (
            SELECT r.id, r.ia, r.ib, r.ja, r.jb,
              min({{'minus': -least(k, c.i - r.ia + 1, c.j - r.ja + 1), 'i': c.i, 'j': c.j}}) AS best
            FROM blocks r LEFT JOIN cells c ON c.id = r.id AND c.i BETWEEN r.ia AND r.ib AND c.j BETWEEN r.ja AND r.jb
            WHERE r.n IS NULL
            GROUP BY r.id, r.ia, r.ib, r.ja, r.jb
          )
        ) JOIN (SELECT id AS kid, x, y FROM kept) ON kid = id
      )
    ) WHERE size > 0
  )
  WHERE part.n IS NOT NULL OR (part.ia <= part.ib AND part.ja <= part.jb)
),
near_pairs AS (
  SELECT a, b FROM kept JOIN (SELECT id, sum(n) AS m FROM blocks WHERE n IS NOT NULL GROUP BY id) USING (id)
  WHERE 2.0 * m / (la + lb) >= {NEAR_DUPLICATE_RATIO}
)"""


def _fmt(ms: str) -> str:
    return (f"printf('%02d:%02d:%02d.%03d', {ms} // 3600000, {ms} % 3600000 // 60000, "
            f"{ms} % 60000 // 1000, {ms} % 1000)")


def _ms(x: str) -> str:
    return f"CAST(round_even({x} * 1000, 0) AS BIGINT)"


WINDOWS = """
w AS (
  SELECT user_id AS stream_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS window_idx,
         value / 100 AS speech_prob, value / 100 > 0.4 AS is_speech
  FROM events
)"""


LINE_WINDOWS = f"""
w AS (
  SELECT CAST({LINE_STREAM} AS BIGINT) AS stream_id,
         row_number() OVER (PARTITION BY {LINE_STREAM} ORDER BY l_orderkey, l_linenumber) - 1 AS window_idx, {LINE_FLAG} AS is_speech
  FROM lineitem
)"""


CONTROLS = f"""
w AS (
  SELECT user_id AS stream_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS window_idx,
         value / 100 > 0.4 AS is_speech, event_type = {_quoted(RESET_EVENT)} AS is_reset
  FROM events
)"""


def _machine(lowest: int, soft: int, hard: int, silence: int, back: int, windows: str = WINDOWS, resets: bool = False) -> str:
    """The state machine window by window; all lengths in windows."""
    joined = "step q JOIN w ON w.stream_id = q.stream_id AND w.window_idx = q.idx + 1"
    if resets:
        # A reset clears the state that comes in.
        joined = f"""(
          SELECT q.stream_id, q.idx, w.is_speech, q.act AND NOT is_reset AS act, CASE WHEN is_reset THEN 0 ELSE q.s END AS s,
            CASE WHEN is_reset THEN 0 ELSE q.z END AS z, CASE WHEN is_reset THEN 0 ELSE q.back END AS back, q.start
          FROM {joined}) q"""
    return f"""
RECURSIVE {windows.strip()},
step AS (
  SELECT DISTINCT stream_id, CAST(-1 AS BIGINT) AS idx, false AS act, 0 AS s, 0 AS z, 0 AS back,
         CAST(0 AS BIGINT) AS start, false AS emits, CAST(0 AS BIGINT) AS e_start, 0 AS e_len, '' AS e_why,
         false AS idle_silent
  FROM w
  UNION ALL
  SELECT stream_id, idx, act AND NOT emits,
         CASE WHEN emits THEN 0 ELSE s END, CASE WHEN emits THEN 0 ELSE z END, back, start, emits,
         start, s + z, why, idle_silent
  FROM (
    SELECT *,
      act AND (s + z >= {hard} OR (z > 0 AND z >= eff)) AS emits,
      CASE WHEN s + z >= {hard} THEN 'hard_limit' ELSE 'silence' END AS why
    FROM (
      SELECT q.stream_id, q.idx + 1 AS idx, q.act OR is_speech AS act,
        CASE WHEN NOT q.act AND NOT is_speech THEN 0
             WHEN NOT q.act THEN q.back + 1
             WHEN is_speech OR q.s + q.z < {lowest} THEN q.s + q.z + 1 ELSE q.s END AS s,
        CASE WHEN q.act AND NOT is_speech AND q.s + q.z >= {lowest} THEN q.z + 1 ELSE 0 END AS z,
        CASE WHEN q.act OR is_speech THEN 0 ELSE least({back}, q.back + 1) END AS back,
        CASE WHEN NOT q.act AND is_speech THEN q.idx + 1 - q.back ELSE q.start END AS start,
        CASE WHEN q.s + q.z > {soft} THEN 1 ELSE {silence} END AS eff,
        NOT q.act AND NOT is_speech AS idle_silent
      FROM {joined}
    )
  )
),
closed AS (
  SELECT stream_id, e_start AS start, e_len AS n, e_why AS end_reason FROM step WHERE emits
  UNION ALL
  SELECT stream_id, start, s + z, 'flush'
  FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY idx DESC) AS r FROM step) WHERE r = 1 AND act
),
segments AS (
  SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY start) - 1 AS segment_idx,
         start * 512 AS start_sample, CAST(n AS BIGINT) * 512 AS n_samples, start * 512 / 16000 AS start_s,
         n * 512 / 16000 AS duration_s, end_reason
  FROM closed
)"""


MACHINE = _machine(3, 10, 16, 2, 2)
# Defaults: 3 s = 93.75 windows, 60 s, an hour, 2 s = 62.5 windows, 0.5 s = 15 windows.
MACHINE_DEFAULT = _machine(94, 1875, 112500, 63, 15)
MACHINE_RESETS = _machine(3, 10, 16, 2, 2, CONTROLS, resets=True)
MACHINE_LINES = _machine(3, 40, 100, 4, 2, LINE_WINDOWS)

SAMPLES = """
samples AS (
  SELECT vec_id // 8 AS stream_id, vec_id % 8 * 64 + i - 1 AS sample_idx, embedding[i] AS v
  FROM embeddings, range(1, 65) t(i)
)"""
FRAMES = SAMPLES + """,
frames AS (
  SELECT stream_id, sample_idx // 48 AS window_idx, count(*) AS n,
         sqrt(avg(CAST(v AS DOUBLE) * CAST(v AS DOUBLE))) AS rms
  FROM samples GROUP BY ALL HAVING count(*) = 48
)"""
FRAME_SEGMENTS = FRAMES + """,
talk AS (SELECT stream_id, window_idx FROM frames WHERE rms > 0.125),
runs AS (
  SELECT stream_id, min(window_idx) AS segment_idx, min(window_idx) * 48 AS start_sample,
         (max(window_idx) - min(window_idx) + 1) * 48 AS n_samples
  FROM (
    SELECT *, sum(CASE WHEN gap > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY window_idx) AS run
    FROM (SELECT *, window_idx - lag(window_idx) OVER (PARTITION BY stream_id ORDER BY window_idx) AS gap FROM talk)
  ) GROUP BY stream_id, run
)"""

JOBS = "jobs AS (SELECT " + ", ".join(JOB_COLUMNS) + " FROM documents)"
_REGISTRY = ", ".join(
    f"('{lang}', '{scoped}', {arch}, {i})" for i, (lang, scoped, arch) in enumerate(dims.SMALL_MODELS)
)
MODELS = f"""{JOBS},
registry(lang, scoped, arch, pos) AS (VALUES {_REGISTRY}),
choices AS (SELECT lang, string_agg(scoped, ', ' ORDER BY pos) AS listed, arg_min(scoped, pos) AS first_one
            FROM registry GROUP BY lang),
asked AS (
  SELECT j.*, lower(j.language) AS lang, listed,
         lower(coalesce(j.model, CASE WHEN lower(j.language) = 'en' THEN 'small-streaming' ELSE first_one END)) AS wanted
  FROM jobs j LEFT JOIN choices c ON j.backend = 'moonshine' AND c.lang = lower(j.language)
),
resolved AS (
  SELECT job_id, backend, sub_timestamps,
    CASE WHEN backend = 'moonshine' THEN r.scoped || '-' || r.lang
         WHEN backend = 'whisper' THEN CASE WHEN model LIKE '%/%' THEN model
              ELSE 'openai/whisper-' || coalesce(model, 'large-v3-turbo') END
         WHEN model IS NOT NULL THEN model
         WHEN backend = 'qwen-asr-mlx' THEN 'mlx-community/Qwen3-ASR-0.6B-bf16'
         WHEN backend = 'glm-asr' THEN 'zai-org/GLM-ASR-Nano-2512'
         WHEN backend = 'glm-asr-mlx' THEN 'mlx-community/GLM-ASR-Nano-2512-8bit' END AS resolved_model,
    r.arch, r.arch >= 2 AS streaming,
    {_quoted(dims.MODEL_HOST + "/")} || r.scoped || '-' || r.lang || '/quantized'
      || CASE WHEN r.arch >= 2 THEN '' ELSE '/' || r.scoped || '-' || r.lang END AS url,
    CASE WHEN backend <> 'moonshine' THEN NULL
         WHEN listed IS NULL THEN 'Unknown language: ' || coalesce(a.lang, '') || '. Available: en, zh, es'
         WHEN r.scoped IS NULL THEN 'Unknown model for language ' || a.lang || ': ' || wanted || '. Available: ' || listed
    END AS model_error
  FROM asked a LEFT JOIN registry r ON backend = 'moonshine' AND r.lang = a.lang AND r.scoped = wanted
)"""

LINES = """
lines AS (
  SELECT doc_id AS stream_id, generate_subscripts(l, 1) - 1 AS segment_idx, unnest(l) AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
)"""
CHUNKS = LINES + """,
chunks AS (
  SELECT stream_id, segment_idx, i AS chunk_idx, text, i * 2.0::DOUBLE AS t0,
         CASE WHEN i < n - 1 THEN (i + 1) * 2.0::DOUBLE END AS t1
  FROM (
    SELECT stream_id, segment_idx, len(s) AS n, generate_subscripts(s, 1) - 1 AS i, unnest(s) AS text
    FROM (SELECT stream_id, segment_idx, string_split(text, '. ') AS s FROM lines)
  )
)"""
_BY_STREAM = "OVER (PARTITION BY stream_id ORDER BY segment_idx)"
STATES = CHUNKS + f""",
joined AS (
  SELECT stream_id, segment_idx, string_agg(text, ' ' ORDER BY chunk_idx) AS line,
         {_strip("arg_max(text, chunk_idx)")} AS last_chunk
  FROM chunks GROUP BY ALL
),
state AS (
  SELECT *, coalesce(lag({_strip("line")}) {_BY_STREAM}, '') AS prior_line,
         coalesce(lag(last_chunk) {_BY_STREAM}, '') AS prior_last_chunk
  FROM joined
)"""


def _prompted(near) -> str:
    return f"""prompted AS (
  SELECT *, coalesce(lag(ctx) {_BY_STREAM}, '') AS prompt
  FROM (
    SELECT *, CASE WHEN {_few_distinct(_words("line"))} OR {near("line", "prior_line")} THEN ''
              ELSE {_strip("line")} END AS ctx
    FROM state
  )
)"""


def _planned(near) -> str:
    return f"""plans AS (
  SELECT stream_id, segment_idx, min(chunk_idx) AS repeat_idx, min(t0) AS trim_start_s,
         CAST(floor(min(t0) * 16000) AS BIGINT) AS trim_start_samples
  FROM (
    SELECT c.*, prompt,
      coalesce(lag(c.text) OVER (PARTITION BY c.stream_id, c.segment_idx ORDER BY chunk_idx), prior_last_chunk) AS before
    FROM chunks c JOIN prompted p ON c.stream_id = p.stream_id AND c.segment_idx = p.segment_idx
  )
  WHERE {near("text", "before")}
  GROUP BY stream_id, segment_idx, prompt
  HAVING min(chunk_idx) >= 1 OR prompt <> ''
)"""


STATE = STATES + ",\n" + _prompted(_same)
PLANS = STATE + ",\n" + _planned(_same)
_LINE_PAIRS = "SELECT line AS p, prior_line AS q FROM state"
_CHUNK_PAIRS = """SELECT c.text AS p, coalesce(lag(c.text) OVER (PARTITION BY c.stream_id, c.segment_idx ORDER BY chunk_idx), prior_last_chunk) AS q
  FROM chunks c JOIN state s ON c.stream_id = s.stream_id AND c.segment_idx = s.segment_idx"""
STATE_NEAR = STATES + "," + _similar(_LINE_PAIRS) + ",\n" + _prompted(_near)
PLANS_NEAR = STATES + "," + _similar(f"{_LINE_PAIRS} UNION ALL {_CHUNK_PAIRS}") + ",\n" + _prompted(_near) + ",\n" + _planned(_near)
SPLICED = PLANS + """,
spliced AS (
  SELECT c.stream_id, c.segment_idx, c.chunk_idx,
    CASE WHEN chunk_idx >= repeat_idx THEN 'again ' || text ELSE text END AS text,
    CASE WHEN chunk_idx >= repeat_idx THEN chunk_idx - repeat_idx + trim_start_s ELSE t0 END AS t0,
    CASE WHEN chunk_idx >= repeat_idx AND t1 IS NOT NULL THEN chunk_idx - repeat_idx + 1 + trim_start_s ELSE t1 END AS t1,
    coalesce(chunk_idx >= repeat_idx, false) AS prompt_retry
  FROM chunks c LEFT JOIN plans p ON c.stream_id = p.stream_id AND c.segment_idx = p.segment_idx
)"""

# Every period at once: a run is a stretch without a mismatch that is at least 9 periods long.
CLIP = """
marks AS (
  SELECT doc_id, p, i FROM (
    SELECT doc_id, p, len(c) AS n, c, unnest(range(p + 1, len(c) + 2)) AS i
    FROM (SELECT doc_id, string_split(text, '') AS c FROM documents WHERE length(text) >= 100), range(2, 31) t(p)
    WHERE len(c) >= 10 * p
  ) WHERE i > n OR c[i] <> c[i - p]
),
hits AS (
  SELECT doc_id, arg_min(p, (p, beg)) AS p, arg_min(beg, (p, beg)) AS beg, arg_min(stop, (p, beg)) AS stop
  FROM (
    SELECT doc_id, p, coalesce(lag(i) OVER (PARTITION BY doc_id, p ORDER BY i), p) - p + 1 AS beg, i AS stop
    FROM marks
  ) WHERE stop - beg - p >= 9 * p
  GROUP BY doc_id
)"""

_CLIPPED_LINES = LINES + """,
long_lines AS (SELECT stream_id, segment_idx, string_split(text, '') AS c FROM lines WHERE length(text) >= 100),
marks AS (
  SELECT stream_id, segment_idx, p, i FROM (
    SELECT stream_id, segment_idx, p, len(c) AS n, c, unnest(range(p + 1, len(c) + 2)) AS i
    FROM long_lines, range(2, 31) t(p) WHERE len(c) >= 10 * p
  ) WHERE i > n OR c[i] <> c[i - p]
),
hits AS (
  SELECT stream_id, segment_idx, arg_min(p, (p, beg)) AS p, arg_min(beg, (p, beg)) AS beg, arg_min(stop, (p, beg)) AS stop
  FROM (
    SELECT *, coalesce(lag(i) OVER (PARTITION BY stream_id, segment_idx, p ORDER BY i), p) - p + 1 AS beg, i AS stop
    FROM marks
  ) WHERE stop - beg - p >= 9 * p
  GROUP BY stream_id, segment_idx
),
clipped AS (
  SELECT l.stream_id, l.segment_idx,
    CASE WHEN p IS NULL THEN text
         ELSE substring(text, 1, beg + p - 1) || '(indistinguishable speech)' || substring(text, stop, length(text)) END AS text,
    CASE WHEN p IS NOT NULL THEN substring(text, beg, p) END AS pattern,
    l.stream_id % 2 = 1 AND l.segment_idx % 2 = 0 AS prompt_retry
  FROM lines l LEFT JOIN hits h ON l.stream_id = h.stream_id AND l.segment_idx = h.segment_idx
)"""

def _resample(source: int, target: int) -> str:
    return f"""WITH {SAMPLES},
out AS (
  SELECT stream_id, j, j * {source} // {target} AS k, (j * {source} % {target})::DOUBLE / {target} AS part
  FROM (SELECT stream_id, unnest(range(0, count(*) * {target} // {source})) AS j FROM samples GROUP BY stream_id)
)
SELECT o.stream_id, o.j AS sample_idx,
  round(CAST(CAST(a.v AS DOUBLE) + (coalesce(CAST(b.v AS DOUBLE), CAST(a.v AS DOUBLE)) - CAST(a.v AS DOUBLE)) * part AS FLOAT)::DOUBLE, 5) AS value
FROM out o JOIN samples a ON a.stream_id = o.stream_id AND a.sample_idx = k
LEFT JOIN samples b ON b.stream_id = o.stream_id AND b.sample_idx = k + 1"""


_BOUNDS = f"""
bounds AS (
  SELECT stream_id, segment_idx, 'segment_start' AS type, 0 AS kind, start_s AS sec FROM segments
  UNION ALL SELECT stream_id, segment_idx, 'segment_end', 2, start_s + duration_s FROM segments
),
log AS (
  SELECT stream_id, type, {_ms("sec")} AS timestamp_ms, {_fmt(_ms("sec"))} AS timestamp_formatted,
         1 AS phase, segment_idx, kind, 0 AS chunk_idx FROM bounds
  UNION ALL
  SELECT stream_id, type, NULL, NULL, phase, 0, 0, 0
  FROM (SELECT DISTINCT user_id AS stream_id FROM events),
       (VALUES ('stream_start', 0), ('stream_end', 2)) m(type, phase)
)"""
_LOG_COLUMNS = "stream_id, type, timestamp_ms, timestamp_formatted, phase, segment_idx, kind, chunk_idx"
_NAMES = "'segment_' || printf('%04d', segment_idx) || '_' || CAST(floor(start_s * 1000) AS BIGINT) || 'ms_' " \
         "|| CAST(floor((start_s + duration_s) * 1000) AS BIGINT) || 'ms.wav'"
_LANGUAGE_ROWS = ", ".join(f"('{code}', '{name}')" for code, name in dims.LANGUAGES)
_LANGUAGE_LIST = ", ".join(code for code, _ in dims.LANGUAGES)
_FILES = FRAME_SEGMENTS + f""",
files AS (
  SELECT stream_id, segment_idx, start_sample, n_samples, {_NAMES} AS name
  FROM (SELECT *, start_sample / 16000 AS start_s, n_samples / 16000 AS duration_s FROM runs)
)"""
_Q15 = "CAST(trunc(greatest(-1::FLOAT, least(1::FLOAT, {x})) * 32767::FLOAT) AS INTEGER)"
_WIDE_PAIR = f"({CJK_WIDE_CLASS})[{WHITESPACE_CHARS}]+({CJK_WIDE_CLASS})"
_SECONDS = "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / 7 AS s FROM lineitem"

# Jobs with limits as data; lengths in samples of 500 a second, windows of 32: 3 s are 1500 samples, 2 s of silence
# 1000, a window is beyond the shortened 32 ms, 0.5 s are 7 windows. A limit may fall inside a window.
JOB_LOG = MODELS + f""",
names(code, name) AS (VALUES {_LANGUAGE_ROWS}),
accepted AS (
  SELECT j.job_id AS stream_id, 's' || (1 + j.job_id % (SELECT count(*) FROM supplier)) AS source, j.backend,
    CASE WHEN j.backend = 'whisper' AND NOT j.sub_timestamps OR j.backend = 'nvidia-whisper' THEN 30
         WHEN j.backend = 'moonshine' AND r.streaming IS NOT TRUE THEN 9 ELSE 60 END * 500 AS hard,
    CASE WHEN j.backend IN ('whisper', 'nvidia-whisper', 'moonshine') THEN 3000 ELSE 15000 END AS soft,
    j.backend IN ('whisper', 'qwen-asr-rs', 'qwen-asr-mlx') AND coalesce(j.condition, true) AS conditioned
  FROM jobs j JOIN resolved r ON r.job_id = j.job_id LEFT JOIN names ON code = j.language
  WHERE file_exists AND duration_s IS NOT NULL AND j.backend NOT LIKE 'src%'
    AND NOT (j.backend = 'moonshine' AND (j.language IS NULL OR j.device IS NOT NULL))
    AND NOT (coalesce(j.condition, false) AND j.backend IN ('moonshine', 'glm-asr', 'glm-asr-mlx', 'nvidia-whisper'))
    AND r.model_error IS NULL
    AND NOT (j.backend IN ('qwen-asr-rs', 'qwen-asr-mlx', 'glm-asr') AND j.language IS NOT NULL AND name IS NULL)
),
w AS (
  SELECT 's' || l_suppkey AS source, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS window_idx,
         {LINE_LOUD} AS loud
  FROM lineitem
),
step AS (
  SELECT stream_id, source, hard, soft, CAST(-1 AS BIGINT) AS idx, false AS act, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS z,
         CAST(0 AS BIGINT) AS back, CAST(0 AS BIGINT) AS short, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS shift,
         false AS emits, CAST(0 AS BIGINT) AS e_start, CAST(0 AS BIGINT) AS e_len, CAST(0 AS BIGINT) AS e_shift
  FROM accepted
  UNION ALL
  SELECT stream_id, source, hard, soft, idx,
    CASE WHEN grows THEN NOT cut OR total > hard WHEN waits THEN NOT closes ELSE false END,
    CASE WHEN grows AND cut THEN total - hard WHEN grows THEN total WHEN waits AND NOT closes THEN s ELSE 0 END,
    CASE WHEN waits AND NOT closes THEN z + take ELSE 0 END,
    CASE WHEN grows THEN 0 WHEN waits THEN CAST(closes AND take < 32 AS BIGINT) ELSE least(7, back + 1) END,
    CASE WHEN waits AND closes AND take < 32 THEN take WHEN grows OR waits OR back = 7 THEN 0 ELSE short END,
    CASE WHEN grows AND cut THEN begin + hard WHEN grows THEN begin ELSE start END,
    CASE WHEN grows AND cut AND (begin + hard) % 32 = 0 THEN 0 WHEN grows THEN early ELSE shift END,
    (grows AND cut) OR (waits AND closes), CASE WHEN grows THEN begin ELSE start END,
    CASE WHEN grows THEN hard ELSE s + z + take END, CASE WHEN grows THEN early ELSE shift END
  FROM (
    SELECT *, total >= hard AS cut, s + z + take >= hard OR z + take >= CASE WHEN s + z > soft THEN 16 ELSE 1000 END AS closes
    FROM (
      SELECT q.stream_id, q.source, hard, soft, q.idx + 1 AS idx, s, z, back, short, start, shift,
        loud OR (act AND s + z < 1500) AS grows, act AND NOT loud AND s + z >= 1500 AS waits, least(32, hard - s - z) AS take,
        CASE WHEN act THEN s + z ELSE back * 32 - short END + 32 AS total,
        CASE WHEN act THEN start ELSE (q.idx + 1 - back) * 32 + short END AS begin, CASE WHEN act THEN shift ELSE short END AS early
      FROM step q JOIN w ON w.source = q.source AND w.window_idx = q.idx + 1
    )
  )
),
closed AS (
  SELECT stream_id, e_start AS start, e_len AS n, e_shift AS shift FROM step WHERE emits
  UNION ALL
  SELECT stream_id, start, s + z, shift
  FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY idx DESC) AS r FROM step) WHERE r = 1 AND act
),
segments AS (
  SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY start) - 1 AS segment_idx, n,
         greatest(start - shift, 0) / 500 AS start_s, n / 500 AS duration_s,
         repeat(chr(CAST(97 + n % 5 AS INT)), 5) AS letter, repeat(chr(CAST(48 + n % 3 AS INT)), 5) AS digit
  FROM closed
),
talk AS (
  SELECT stream_id, conditioned, CAST(-1 AS BIGINT) AS segment_idx, '' AS prior, '' AS prompt, '' AS text, false AS retried FROM accepted
  UNION ALL
  SELECT stream_id, conditioned, segment_idx, said, CASE WHEN said = prior OR NOT conditioned THEN '' ELSE said END, said, again
  FROM (
    SELECT t.stream_id, conditioned, g.segment_idx, prior, prompt <> '' AND letter = prior AS again,
           CASE WHEN prompt = '' OR letter = prior THEN digit ELSE letter END AS said
    FROM talk t JOIN segments g ON g.stream_id = t.stream_id AND g.segment_idx = t.segment_idx + 1
  )
),
log AS (
  SELECT stream_id, 'transcript' AS type, {_ms("start_s")} AS start_ms, {_fmt(_ms("start_s"))} AS start_formatted, text,
    {_ms("(start_s + duration_s)")} AS end_ms, {_fmt(_ms("(start_s + duration_s)"))} AS end_formatted, retried AS prompt_retry,
    NULL AS timestamp_ms, NULL AS timestamp_formatted, 1 AS phase, segment_idx, 1 AS kind, 0 AS chunk_idx
  FROM segments JOIN talk USING (stream_id, segment_idx)
  UNION ALL
  SELECT stream_id, type, NULL, NULL, NULL, NULL, NULL, NULL, {_ms("sec")}, {_fmt(_ms("sec"))}, 1, segment_idx, kind, 0
  FROM (SELECT stream_id, segment_idx, 'segment_start' AS type, 0 AS kind, start_s AS sec FROM segments
        UNION ALL SELECT stream_id, segment_idx, 'segment_end', 2, start_s + duration_s FROM segments)
  UNION ALL
  SELECT stream_id, type, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, phase, 0, 0, 0
  FROM accepted, (VALUES ('stream_start', 0), ('stream_end', 2)) m(type, phase)
)"""


ORACLES: dict[str, str] = {
    "activity_segments": f"WITH {MACHINE} SELECT * FROM segments",
    "activity_segments_default": f"WITH {MACHINE_DEFAULT} SELECT * FROM segments",
    "activity_segments_unpaused": f"WITH {MACHINE_LINES} SELECT * FROM segments",
    "activity_segments_resets": f"WITH {MACHINE_RESETS} SELECT * FROM segments",
    "activity_sessions": f"""
        WITH marks AS (SELECT user_id AS stream_id, ts, epoch_us(ts) AS us FROM events WHERE value / 100 > 0.4),
        runs AS (
          SELECT *, sum(CASE WHEN gap > {SESSION_GAP_S * 1000000} THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY us) AS run
          FROM (SELECT *, us - lag(us) OVER (PARTITION BY stream_id ORDER BY us) AS gap FROM marks))
        SELECT stream_id, min(us) AS first_us, max(us) AS last_us, count(*) AS marks, round((max(us) - min(us)) / 1000000, 6) AS duration_s
        FROM runs GROUP BY stream_id, run""",
    "live_state": f"""WITH {MACHINE}
        SELECT stream_id, idx AS window_idx, act AS in_speech,
               round(CASE WHEN act THEN s + z ELSE 0 END * 512 / 16000, 6) AS segment_seconds,
               CASE WHEN idle_silent THEN 0.032::DOUBLE END AS pending_window_s
        FROM step WHERE idx >= 0""",
    "activity_runs": f"""WITH {WINDOWS},
        talk AS (SELECT *, window_idx - lag(window_idx) OVER (PARTITION BY stream_id ORDER BY window_idx) AS gap
                 FROM w WHERE is_speech),
        marked AS (SELECT *, sum(CASE WHEN gap > 3 THEN 1 ELSE 0 END)
                   OVER (PARTITION BY stream_id ORDER BY window_idx) AS run FROM talk)
        SELECT stream_id, min(window_idx) AS first_window, max(window_idx) AS last_window,
               min(window_idx) * 512 AS start_sample, (max(window_idx) - min(window_idx) + 1) * 512 AS n_samples,
               min(window_idx) * 512 / 16000 AS start_s,
               (max(window_idx) - min(window_idx) + 1) * 512 / 16000 AS duration_s
        FROM marked GROUP BY stream_id, run""",
    "segment_gaps": f"""WITH {MACHINE}
        SELECT *, gap_samples / 16000 AS gap_s FROM (
          SELECT stream_id, segment_idx, start_sample, n_samples,
            start_sample - coalesce(lag(start_sample + n_samples) OVER (PARTITION BY stream_id ORDER BY segment_idx), 0)
            AS gap_samples FROM segments)""",
    "segment_counts": f"""WITH {MACHINE}
        SELECT stream_id, count(*) AS segments, round(sum(n_samples) / 16000, 6) AS speech_s
        FROM segments GROUP BY stream_id""",
    "window_flags": f"WITH {WINDOWS} SELECT * FROM w",
    "read_samples": f"WITH {SAMPLES} SELECT stream_id, sample_idx, CAST(v AS DOUBLE) AS value FROM samples",
    "read_values": """SELECT user_id AS stream_id, i // 16 AS chunk_seq, i // 16 * 16 AS start_sample, i % 16 AS pos,
        CAST(CAST(value AS FLOAT) AS DOUBLE) AS value
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)""",
    "chunk_offsets": """SELECT stream_id, chunk_seq,
        coalesce(sum(n) OVER (PARTITION BY stream_id ORDER BY chunk_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        AS start_sample, n
        FROM (SELECT vec_id // 8 AS stream_id, vec_id % 8 AS chunk_seq, vec_id % 8 + 40 AS n FROM embeddings)""",
    "frames": f"""WITH {FRAMES}
        SELECT s.stream_id, s.sample_idx // 48 AS window_idx, s.sample_idx // 48 * 48 AS start_sample,
               s.sample_idx // 48 * 48 / 16000 AS ts, s.sample_idx % 48 AS pos, CAST(v AS DOUBLE) AS value
        FROM samples s JOIN frames f ON f.stream_id = s.stream_id AND f.window_idx = s.sample_idx // 48""",
    "frame_rms": f"WITH {FRAMES} SELECT stream_id, window_idx, round(rms, 6) AS speech_prob FROM frames",
    "frame_scores_vectorized": f"WITH {FRAMES} SELECT stream_id, window_idx, round(rms, 6) AS speech_prob FROM frames",
    "dropped_samples": "SELECT vec_id // 8 AS stream_id, count(*) * 64 % 48 AS dropped_samples FROM embeddings GROUP BY ALL",
    "progress": """SELECT vec_id // 8 AS stream_id, vec_id % 8 + 1 AS chunks_read,
        (vec_id % 8 + 1) * 64 // 48 * 48 / 16000 AS clock_s FROM embeddings WHERE (vec_id % 8 + 1) % 3 = 0""",
    "downmix": """SELECT vec_id, i AS pos,
        round(CAST(CAST((CAST(embedding[2 * i + 1] AS DOUBLE) + CAST(embedding[2 * i + 2] AS DOUBLE)) / 2 AS FLOAT) AS DOUBLE), 6)
        AS value FROM embeddings, range(0, 32) t(i)""",
    "resample_down": _resample(44100, 16000),
    "resample_up": _resample(8000, 11025),
    "quantize_pcm16": f"""SELECT vec_id, i - 1 AS pos, {_Q15.format(x="embedding[i] * 3::FLOAT")} AS value
        FROM embeddings, range(1, 65) t(i)""",
    "window_sizes": f"""WITH {JOBS} SELECT rate, CASE WHEN rate = 16000 THEN 512 ELSE 256 END AS window_size,
        count(*) AS jobs FROM jobs GROUP BY ALL""",
    "cut_segments": f"""WITH {FRAME_SEGMENTS}
        SELECT r.stream_id, segment_idx, start_sample, sample_idx - start_sample AS pos, CAST(v AS DOUBLE) AS value
        FROM runs r JOIN samples s ON s.stream_id = r.stream_id
         AND sample_idx >= start_sample AND sample_idx < start_sample + n_samples""",
    "cut_segments_at_rate": f"""WITH {FRAME_SEGMENTS},
        moved AS (
          SELECT stream_id, segment_idx, CAST(floor(start_sample / 16000 * 22050) AS BIGINT) AS low,
                 CAST(floor((start_sample / 16000 + n_samples / 16000) * 22050) AS BIGINT) AS high
          FROM runs)
        SELECT m.stream_id, segment_idx, low AS start_sample, sample_idx - low AS pos, CAST(v AS DOUBLE) AS value
        FROM moved m JOIN samples s ON s.stream_id = m.stream_id AND sample_idx >= low AND sample_idx < high""",
    "validate_jobs": f"""WITH {JOBS},
        tested AS (SELECT job_id, regexp_matches(source, '^(http|https|rtmp|rtsp)://') AS is_url, [e FOR e IN [
          CASE WHEN NOT regexp_matches(source, '^(http|https|rtmp|rtsp)://') AND NOT file_exists
               THEN 'File does not exist: ' || source END,
          CASE WHEN duration_s IS NULL THEN 'Cannot determine audio duration. Live streams are not supported. '
               || 'Please provide a file or URL with fixed duration.' END,
          CASE WHEN backend LIKE 'src%' THEN 'Unsupported backend: ' || backend END,
          CASE WHEN backend = 'moonshine' AND language IS NULL THEN '--language is required for the moonshine backend' END,
          CASE WHEN condition AND backend IN ('moonshine', 'glm-asr', 'glm-asr-mlx', 'nvidia-whisper')
               THEN 'condition=True is not supported by the ' || backend || ' backend' END,
          CASE WHEN backend = 'moonshine' AND device IS NOT NULL
               THEN '--device is not supported by the moonshine backend' END] IF e IS NOT NULL] AS errors FROM jobs)
        SELECT job_id, is_url, len(errors) = 0 AS accepted, coalesce(array_to_string(errors, ' | '), '') AS reasons
        FROM tested""",
    "wav_properties": f"""WITH h AS (SELECT {", ".join(HEADER_COLUMNS)} FROM documents)
        SELECT path, sample_rate, channels,
          CASE WHEN sample_rate > 0 AND channels > 0 AND data_size > 0
               THEN round(data_size / (sample_rate * channels * bits_per_sample / 8), 6) END AS duration_s,
          CASE WHEN sample_rate IS NULL OR channels = 0 THEN 'No audio stream found in source'
               WHEN coalesce(data_size, 0) = 0 THEN 'Cannot determine audio duration' END AS error
        FROM h""",
    "resolve_models": f"""WITH {MODELS}
        SELECT job_id, backend, resolved_model, arch, streaming, url, model_error FROM resolved""",
    "limits_join": f"""WITH {MODELS}
        SELECT job_id, backend,
          CASE WHEN backend = 'whisper' THEN CASE WHEN sub_timestamps THEN 'sub_timestamps' ELSE 'no_sub_timestamps' END
               WHEN backend = 'moonshine' THEN CASE WHEN streaming THEN 'streaming' ELSE 'non_streaming' END
               ELSE 'any' END AS mode,
          CASE WHEN backend = 'whisper' AND NOT sub_timestamps THEN 30 WHEN backend = 'nvidia-whisper' THEN 30
               WHEN backend = 'moonshine' AND streaming IS NOT TRUE THEN 9
               WHEN backend NOT LIKE 'src%' THEN 60 END AS hard_s,
          CASE WHEN backend IN ('whisper', 'nvidia-whisper', 'moonshine') THEN 6.0::DOUBLE
               WHEN backend NOT LIKE 'src%' THEN 30.0::DOUBLE END AS soft_s,
          CASE WHEN backend LIKE 'src%' THEN 'Unsupported backend: ' || backend END AS limit_error
        FROM resolved""",
    "map_languages": f"""WITH {JOBS}, names(code, name) AS (VALUES {_LANGUAGE_ROWS})
        SELECT job_id, backend, language,
          CASE WHEN backend IN ('qwen-asr-rs', 'qwen-asr-mlx', 'glm-asr') THEN name
               WHEN backend = 'whisper' THEN CASE WHEN language = 'yue' AND model LIKE 'alvanlii/%' THEN 'zh' ELSE language END
               WHEN backend = 'nvidia-whisper' THEN coalesce(language, 'multi')
               WHEN backend = 'moonshine' THEN lower(language) END AS language_param,
          CASE WHEN backend = 'glm-asr' THEN 'Transcribe the input speech in ' || name || '.' END AS prompt,
          coalesce(backend = 'glm-asr-mlx' AND language NOT IN ('zh', 'en', 'yue'), false) AS language_warning,
          CASE WHEN backend IN ('qwen-asr-rs', 'qwen-asr-mlx', 'glm-asr') AND language IS NOT NULL AND name IS NULL
               THEN 'Unrecognized language code ''' || language || '''. Available: {_LANGUAGE_LIST}' END AS language_error
        FROM jobs LEFT JOIN names ON code = language""",
    "detokenize": """WITH tokens AS (SELECT l_orderkey, l_linenumber, l_partkey - 5 AS id, l_partkey FROM lineitem),
        words AS (
          SELECT l_orderkey, string_agg(' ' || p_name, '' ORDER BY l_linenumber, l_partkey) AS t
          FROM tokens JOIN part ON p_partkey = id WHERE p_partkey % 50 <> 0 GROUP BY l_orderkey)
        SELECT DISTINCT k.l_orderkey AS stream_id, coalesce(trim(t), '') AS text
        FROM tokens k LEFT JOIN words w ON w.l_orderkey = k.l_orderkey""",
    "segment_line": f"WITH {STATE} SELECT stream_id, segment_idx, line, last_chunk FROM joined",
    "prior_state": f"""WITH {STATE}
        SELECT stream_id, segment_idx, line, last_chunk, prior_line, prior_last_chunk FROM state""",
    "prior_state_with_silent_segments": f"""WITH {CHUNKS},
        joined AS (
          SELECT stream_id, segment_idx, string_agg(text, ' ' ORDER BY chunk_idx) AS line,
                 {_strip("arg_max(text, chunk_idx)")} AS last_chunk
          FROM chunks WHERE length(text) > 40 GROUP BY ALL)
        SELECT l.stream_id, l.segment_idx, line, last_chunk,
          coalesce(last_value({_strip("line")} IGNORE NULLS) OVER before, '') AS prior_line,
          coalesce(last_value(last_chunk IGNORE NULLS) OVER before, '') AS prior_last_chunk
        FROM lines l LEFT JOIN joined j ON j.stream_id = l.stream_id AND j.segment_idx = l.segment_idx
        WINDOW before AS (PARTITION BY l.stream_id ORDER BY l.segment_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "conditioning_prompts": f"WITH RECURSIVE {STATE_NEAR} SELECT stream_id, segment_idx, prior_line, prompt FROM prompted",
    "retry_plan_single": f"""WITH RECURSIVE {STATE_NEAR} SELECT stream_id, segment_idx, line, prior_line, prompt
        FROM prompted WHERE prompt <> '' AND {_near("line", "prior_line")}""",
    "retry_plan_chunks": f"WITH RECURSIVE {PLANS_NEAR} SELECT * FROM plans",
    "near_dup_lines": f"""WITH RECURSIVE {LINES}, p AS (
          SELECT stream_id, segment_idx, text AS line,
                 coalesce(lag({_strip("text")}) {_BY_STREAM}, '') AS prior_line FROM lines),
        {_similar("SELECT line AS p, prior_line AS q FROM p")}
        SELECT * FROM p WHERE {_near("line", "prior_line")}""",
    "conditioning_prompts_equal": f"WITH {STATE} SELECT stream_id, segment_idx, prior_line, prompt FROM prompted",
    "retry_plan_single_equal": f"""WITH {STATE} SELECT stream_id, segment_idx, line, prior_line, prompt
        FROM prompted WHERE prompt <> '' AND {_same("line", "prior_line")}""",
    "retry_plan_chunks_equal": f"WITH {PLANS} SELECT * FROM plans",
    "splice_retries": f"WITH {SPLICED} SELECT * FROM spliced",
    "absolute_times": f"""WITH {SPLICED}
        SELECT stream_id, segment_idx, chunk_idx, text, segment_idx * 30.0::DOUBLE + t0 AS start_s,
               segment_idx * 30.0::DOUBLE + coalesce(t1, 30.0::DOUBLE) AS end_s, prompt_retry, CAST(NULL AS VARCHAR) AS error
        FROM spliced""",
    "whole_segment_times": f"""WITH {STATE}
        SELECT stream_id, segment_idx, 0 AS chunk_idx, line AS text, segment_idx * 30.0::DOUBLE AS start_s,
               segment_idx * 30.0::DOUBLE + 30 AS end_s FROM joined""",
    "retried_flags": f"WITH {SPLICED} SELECT stream_id, segment_idx, chunk_idx, prompt_retry FROM spliced",
    "concat_results": f"""SELECT conv_id AS stream_id, CAST(0 AS BIGINT) AS segment_idx,
        coalesce({_strip("string_agg(text, '' ORDER BY turn) FILTER (role <> 'system')")}, '') AS text
        FROM conversations GROUP BY conv_id""",
    "token_budget": """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
            CAST(floor(l_extendedprice * 8) AS BIGINT) AS n_samples,
            CASE l_returnflag WHEN 'A' THEN 'streaming' WHEN 'N' THEN 'non_streaming' ELSE 'fixed' END AS family
          FROM lineitem)
        SELECT *, CASE family WHEN 'fixed' THEN 500
          WHEN 'streaming' THEN least(448, greatest(2, CAST(floor(n_samples * (6.5::DOUBLE / 16000)) AS INTEGER)))
          ELSE greatest(2, CAST(floor(n_samples * (13::DOUBLE / 16000)) AS INTEGER)) END AS max_tokens FROM s""",
    "recovery_audit": f"""WITH {_CLIPPED_LINES}
        SELECT stream_id, pattern, count(*) AS rows, count(*) FILTER (prompt_retry) AS retried,
               count(pattern) AS clipped, CAST(grouping(stream_id, pattern) AS INTEGER) AS level
        FROM clipped GROUP BY ROLLUP (stream_id, pattern)""",
    "recovery_audit_retries": f"""WITH {LINES},
        r AS (SELECT stream_id, CAST(NULL AS VARCHAR) AS pattern, stream_id % 2 = 1 AND segment_idx % 2 = 0 AS retry FROM lines)
        SELECT stream_id, pattern, count(*) AS rows, count(*) FILTER (retry) AS retried, count(pattern) AS clipped,
               CAST(grouping(stream_id, pattern) AS INTEGER) AS level
        FROM r GROUP BY ROLLUP (stream_id, pattern)""",
    "repetitive_docs": f"""SELECT doc_id, {_few_distinct(_words("text"))} AS by_words,
        {_few_distinct("regexp_extract_all(text, " + _quoted(IDEOGRAPH_CLASS) + ")")} AS by_ideographs FROM documents""",
    "repetitive_ideographs": f"""WITH {LINES}, m AS (
          SELECT stream_id, segment_idx,
            regexp_extract_all(translate(text, '{SCRIPT_SOURCE}', '{SCRIPT_TARGET}'), '[{SCRIPT_TARGET}]') AS c FROM lines)
        SELECT stream_id, segment_idx, {_few_distinct("c")} AS repetitive FROM m""",
    "near_dup_lines_equal": f"""WITH {LINES}, p AS (
          SELECT stream_id, segment_idx, text AS line,
                 coalesce(lag({_strip("text")}) {_BY_STREAM}, '') AS prior_line FROM lines)
        SELECT * FROM p WHERE {_same("line", "prior_line")}""",
    "clip_docs": f"""WITH {CLIP}
        SELECT d.doc_id,
          CASE WHEN p IS NULL THEN text
               ELSE substring(text, 1, beg + p - 1) || '(indistinguishable speech)' || substring(text, stop, length(text)) END AS text,
          CASE WHEN p IS NULL THEN '' ELSE substring(text, beg, p) END AS pattern
        FROM documents d LEFT JOIN hits h ON h.doc_id = d.doc_id""",
    "convert_script": f"SELECT doc_id, translate(text, '{SCRIPT_SOURCE}', '{SCRIPT_TARGET}') AS text FROM documents",
    "strip_cjk_spaces": f"""SELECT doc_id, regexp_replace(regexp_replace(
          translate(text, '{SCRIPT_SOURCE}', '{SCRIPT_TARGET}'),
          {_quoted(_WIDE_PAIR)}, '\\1\\2', 'g'), {_quoted(_WIDE_PAIR)}, '\\1\\2', 'g') AS text FROM documents""",
    "fmt_ts": f"SELECT *, {_fmt(_ms('s'))} AS formatted FROM ({_SECONDS})",
    "fmt_ts_seconds": f"""SELECT * EXCLUDE (r), printf('%02d:%02d:%02d', r // 3600, r % 3600 // 60, r % 60) AS formatted
        FROM (SELECT *, CAST(round_even(s, 0) AS BIGINT) AS r FROM ({_SECONDS}))""",
    "fmt_ts_trunc": f"""SELECT *, printf('%02d:%02d:%02d.%03d', CAST(floor(s / 3600) AS BIGINT),
          CAST(floor(s % 3600 / 60) AS BIGINT), CAST(floor(s % 60) AS BIGINT), CAST(trunc(s % 1 * 1000) AS BIGINT)) AS formatted
        FROM ({_SECONDS})""",
    "event_ids": """SELECT count(*) AS rows, count(*) AS ids, count(*) AS version_7, count(*) AS variant_ok,
        count(*) AS time_ok FROM events""",
    "transcript_events": f"""WITH {LINES}, t AS (
          SELECT *, CAST(segment_idx * 30.0 AS DOUBLE) AS a, CAST(segment_idx * 30.0 + 29.9995 AS DOUBLE) AS b FROM lines)
        SELECT stream_id, segment_idx, 'transcript' AS type, {_ms("a")} AS start_ms, {_fmt(_ms("a"))} AS start_formatted,
               text, {_ms("b")} AS end_ms, {_fmt(_ms("b"))} AS end_formatted,
               stream_id % 2 = 1 AND segment_idx % 2 = 0 AS prompt_retry, 0 AS clipped FROM t""",
    "marker_events": """SELECT stream_id, type, phase, CAST(0 AS BIGINT) AS segment_idx, 0 AS kind, 0 AS chunk_idx
        FROM (SELECT DISTINCT user_id AS stream_id FROM events),
             (VALUES ('stream_start', 0), ('stream_end', 2)) m(type, phase)""",
    "boundary_events": f"WITH {MACHINE}, {_BOUNDS} SELECT {_LOG_COLUMNS} FROM log WHERE phase = 1",
    "event_log": f"WITH {MACHINE}, {_BOUNDS} SELECT {_LOG_COLUMNS} FROM log",
    "jsonl_records": f"""WITH {MACHINE}, {_BOUNDS}
        SELECT stream_id, phase, segment_idx, kind, chunk_idx,
          CASE WHEN timestamp_ms IS NULL THEN '{{"type":"' || type || '"}}'
               ELSE '{{"type":"' || type || '","timestamp_ms":' || timestamp_ms || ',"timestamp_formatted":"'
                    || timestamp_formatted || '"}}' END AS value
        FROM log""",
    "transcribe_jobs": f"WITH RECURSIVE {JOB_LOG} SELECT * FROM log",
    "transcript_log": f"""WITH {_CLIPPED_LINES},
        t AS (SELECT *, CAST(segment_idx * 30.0 AS DOUBLE) AS a, CAST(segment_idx * 30.0 + 29.9995 AS DOUBLE) AS b,
                     CAST(segment_idx * 30.0 + 30 AS DOUBLE) AS c FROM clipped),
        log(stream_id, type, start_ms, start_formatted, text, end_ms, end_formatted, prompt_retry,
            repetition_patterns_clipped, timestamp_ms, timestamp_formatted, phase, segment_idx, kind, chunk_idx) AS (
          SELECT stream_id, 'transcript', {_ms("a")}, {_fmt(_ms("a"))}, text, {_ms("b")}, {_fmt(_ms("b"))}, prompt_retry,
                 coalesce(pattern, ''), NULL, NULL, 1, segment_idx, 1, 0 FROM t
          UNION ALL SELECT stream_id, 'segment_start', NULL, NULL, NULL, NULL, NULL, NULL, NULL,
                 {_ms("a")}, {_fmt(_ms("a"))}, 1, segment_idx, 0, 0 FROM t
          UNION ALL SELECT stream_id, 'segment_end', NULL, NULL, NULL, NULL, NULL, NULL, NULL,
                 {_ms("c")}, {_fmt(_ms("c"))}, 1, segment_idx, 2, 0 FROM t
          UNION ALL SELECT stream_id, kind, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, phase, 0, 0, 0
          FROM (SELECT DISTINCT stream_id FROM t), (VALUES ('stream_start', 0), ('stream_end', 2)) m(kind, phase))
        SELECT * FROM log""",
    "segment_names": f"WITH {MACHINE} SELECT stream_id, segment_idx, {_NAMES} AS name FROM segments",
    "base_names": f"""WITH {JOBS}, n AS (SELECT job_id, regexp_extract(source, '[^/]*$') AS f FROM jobs)
        SELECT job_id, CASE WHEN f LIKE '_%.%' THEN regexp_replace(f, '\\.[^.]*$', '') ELSE f END AS folder FROM n""",
    "export_segments": f"""WITH {_FILES}
        SELECT stream_id, segment_idx, name, CAST(44 + 2 * n_samples AS INTEGER) AS n_bytes, '52494646' AS magic FROM files""",
    "wav_corpus_profile": f"""WITH {_FILES},
        h AS (SELECT *, stream_id % 7 = 0 AS broken FROM files)
        SELECT CASE WHEN NOT broken THEN 1 END AS audio_format, CASE WHEN NOT broken THEN 16 END AS bits_per_sample,
          CASE WHEN broken THEN 'file ends inside a chunk header' END AS error, count(*) AS files,
          CASE WHEN NOT broken THEN round(sum(n_samples) / 16000 / 3600, 9) END AS hours
        FROM h GROUP BY broken""",
    "wav_round_trip": f"""WITH {_FILES}
        SELECT f.stream_id, name, sample_idx - start_sample AS sample_idx,
          {_Q15.format(x="v")} / 32768 AS value
        FROM files f JOIN samples s ON s.stream_id = f.stream_id
         AND sample_idx >= start_sample AND sample_idx < start_sample + n_samples""",
}
