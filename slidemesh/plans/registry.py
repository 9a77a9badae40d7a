"""Where queries register: name -> Spark plan, and the equal DuckDB statement where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Views of plans/views.py as common table expressions for the oracle side.
VIEWS = {
    "components": """components AS (
  SELECT slide_id, pos, concat(cast(slide_id AS VARCHAR), '/c', cast(pos AS VARCHAR)) AS node_id, label, score, iter_idx, z_index,
         x0, y0, x0 + w AS x1, y0 + h AS y1, w * h AS area, is_text_only
  FROM (SELECT l_orderkey AS slide_id,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos,
               concat(l_returnflag, l_linestatus) AS label, (l_partkey * 7919 + l_linenumber) % 10007 AS score, l_linenumber % 3 AS iter_idx,
               (l_suppkey + l_linenumber) % 5 AS z_index, (l_partkey * 37) % 400 AS x0, (l_partkey * 17) % 250 AS y0,
               60 + (l_suppkey * 53 + l_linenumber * 29) % 500 AS w, 40 + (l_linenumber * 61 + l_partkey) % 260 AS h,
               l_linenumber % 2 = 0 AS is_text_only FROM lineitem) t)""",
    "native_objects": """native_objects AS (
  SELECT slide_id, pos, x0 + (pos * 4) % 13 AS x0, y0, x1 + (pos * 4) % 13 AS x1, y1, concat('shape', cast(pos % 4 AS VARCHAR)) AS shape_type
  FROM components WHERE pos % 2 = 0)""",
    "gt": """gt AS (SELECT slide_id AS image_id, pos AS gt_id, label, x0, y0, x1, y1, pos = 3 AS iscrowd FROM components)""",
    "dt": """dt AS (SELECT slide_id AS image_id, pos AS dt_id, label, score, x0 + (score % 5) * 9 AS x0, y0 + (score % 3) * 7 AS y0,
  x1 + (score % 5) * 9 AS x1, y1 + (score % 3) * 7 AS y1 FROM components WHERE (slide_id + pos) % 5 <> 0)""",
    "track_frames": """track_frames AS (
  SELECT user_id AS video_id, event_type AS track, frame_idx, (frame_idx * 3 + length(event_type) * 40) % 300 AS x0, length(event_type) * 11 AS y0,
         (frame_idx * 3 + length(event_type) * 40) % 300 + 50 AS x1, length(event_type) * 11 + 40 AS y1, event_id % 4 <> 0 AS matched
  FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx FROM events) t)""",
    "usage_log": """usage_log AS (
  SELECT event_id AS line_no, ts, CASE event_type WHEN 'signup' THEN 'slide_start' WHEN 'error' THEN 'slide_end' END AS marker,
         CASE WHEN event_type IN ('signup', 'error') THEN concat('img', cast(user_id AS VARCHAR)) END AS image,
         CASE WHEN event_type NOT IN ('signup', 'error') THEN concat('agent_', event_type) END AS agent,
         CASE WHEN event_type NOT IN ('signup', 'error') AND event_id % 11 <> 0 THEN 'vlm' END AS backend,
         event_id % 977 AS input_tokens, event_id % 131 AS output_tokens, (event_id * 13) % 5000 AS latency_ms FROM events)""",
    "text_runs": """text_runs AS (
  SELECT p_partkey AS run_id, p_size AS page, (p_partkey * 73) % 256 AS fg_r, (p_partkey * 151) % 256 AS fg_g, (p_partkey * 199) % 256 AS fg_b,
         (p_partkey * 11) % 256 AS bg_r, (p_partkey * 29) % 256 AS bg_g, (p_partkey * 83) % 256 AS bg_b FROM part)""",
    "page_words": """page_words AS (
  SELECT page, word, side FROM (SELECT doc_id AS page, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents) d,
       (VALUES ('orig'), ('render')) s(side)
  WHERE length(word) >= 2 AND (side = 'orig' OR length(word) % 7 <> 0))""",
}
# Overlap of two boxes a and b: proper overlap test and area, textual pieces for the statements.
HIT = "a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"
INTER = "(least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))"
A_AREA, B_AREA = "(a.x1 - a.x0) * (a.y1 - a.y0)", "(b.x1 - b.x0) * (b.y1 - b.y0)"
IOU = f"CAST({INTER} AS DOUBLE) / ({A_AREA} + {B_AREA} - {INTER})"


def sql(body: str, *views: str, extra: str = "", recursive: bool = False) -> str:
    """`body` behind the named views (in dependency order) and extra CTEs."""
    parts = [VIEWS[v] for v in views] + ([extra] if extra else [])
    head = f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" if parts else ""
    return head + body


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add
