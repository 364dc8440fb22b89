"""The register of queries, and the collection in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.moments import COCO_NAMES, VERIFY_GATE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` with SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


NAMES = "[" + ", ".join(f"'{n}'" for n in COCO_NAMES) + "]"

#: The collection that ``sources.moments.points`` derives, as a common table expression.
POINTS = f"""
anchors AS (SELECT label, arg_min(embedding, vec_id) AS anchor FROM embeddings GROUP BY label),
base AS (
  SELECT e.vec_id AS id, e.vec_id - e.vec_id % 5 AS moment_id, CASE e.vec_id % 5 WHEN 0 THEN 'frame' WHEN 4 THEN 'ocr' ELSE 'region' END AS type,
    p.user_id AS episode_id, epoch_us(p.ts) // 1000 AS timestamp_ms, e.embedding::DOUBLE[] AS clip, {NAMES}[e.label + 1] AS class_name, e.label AS class_id,
    CASE WHEN e.vec_id % 5 IN (1, 2, 3) THEN round(least(1.0, v.value / 500.0), 4) ELSE 0.0 END AS yolo_conf,
    CASE WHEN e.vec_id % 5 IN (1, 2, 3) THEN round(list_dot_product(e.embedding::DOUBLE[], a.anchor::DOUBLE[]), 6) ELSE 0.0 END AS verify_cos
  FROM embeddings e JOIN events v ON v.event_id = e.vec_id JOIN events p ON p.event_id = e.vec_id - e.vec_id % 5 JOIN anchors a ON a.label = e.label
),
points AS (
  SELECT *, timestamp_ms AS t_end_ms, CASE WHEN type = 'region' AND verify_cos >= {VERIFY_GATE} THEN class_name ELSE '' END AS label,
    CASE WHEN type = 'region' THEN printf('%.3f,%.3f,%.3f,%.3f', (id % 10) / 20.0, (id % 7) / 14.0, (id % 10) / 20.0 + 0.3, (id % 7) / 14.0 + 0.25) ELSE '' END AS bbox,
    CASE WHEN type <> 'ocr' THEN '/thumbs/moment_' || moment_id || '.jpg' ELSE '' END AS thumb_path,
    CASE id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS synced, id % 4 = 0 AS curated
  FROM base
)
"""


def with_points(sql: str) -> str:
    return f"WITH {POINTS} {sql}"
