"""Registered queries of batches of files, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batches, reporting
from . import bindings as b
from .catalog import BAD, JUDGED, VERDICT, judged, registered, verdict

# a part's file: folders by its size, files of several tests
_PATH = "concat('src/', CASE WHEN p_size % 5 < 3 THEN 'a' ELSE concat('b', p_size % 5) END, '/t', p_size % 7, '/f', p_partkey % 97, '.test.ts')"
MOST = 12
_TESTS = f"SELECT p_partkey AS case_id, {_PATH} AS path FROM part JOIN ({VERDICT[3]}) v ON v.case_id = p_partkey WHERE verdict IN {BAD}"
_FOUND = f"SELECT t.path, j.dimension, count(*) AS bad FROM ({_TESTS}) t JOIN ({JUDGED[3]}) j ON j.case_id = t.case_id WHERE j.status = 'judged' AND j.level IN {BAD} GROUP BY 1, 2"


def tests(spark, sf_dir):
    part = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("case_id"), F.expr(_PATH).alias("path"))
    return part.join(verdict(spark, sf_dir).where(f"verdict IN {BAD}").select("case_id"), "case_id")


def found(spark, sf_dir):
    bad = judged(spark, sf_dir).where(f"status = 'judged' AND level IN {BAD}").select("case_id", "dimension")
    return tests(spark, sf_dir).join(bad, "case_id").groupBy("path", "dimension").agg(F.count("*").alias("bad"))


def _worst(keys: str, rows: str) -> str:
    return f"""SELECT {keys}, string_agg(dimension || '=' || bad, ',' ORDER BY r) AS worst FROM (
      SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY bad DESC, dimension) AS r FROM (SELECT {keys}, dimension, sum(bad)::BIGINT AS bad FROM ({rows}) x GROUP BY ALL) s) q WHERE r <= 3 GROUP BY ALL"""


@registered(f"SELECT t.path AS key, tests, coalesce(worst, '') AS worst FROM (SELECT path, count(*) AS tests FROM ({_TESTS}) t GROUP BY path) t LEFT JOIN ({_worst('path', _FOUND)}) w ON w.path = t.path")
def file_batches(spark, sf_dir):
    return batches.file_batches(tests(spark, sf_dir), found(spark, sf_dir))


@registered(f"""WITH RECURSIVE sized AS MATERIALIZED (
  SELECT path, array_to_string(string_split(path, '/')[:2], '/') AS g1, array_to_string(string_split(path, '/')[:3], '/') AS g2, count(*) AS n FROM ({_TESTS}) t GROUP BY ALL
), summed AS (SELECT *, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY g1) AS n1, sum(n) OVER (PARTITION BY g2) AS n2 FROM sized
), placed AS (SELECT *, CASE WHEN n1 < 3 THEN '.' WHEN n1 * 12 >= t AND n2 >= 3 THEN g2 ELSE g1 END AS folder, max(CASE WHEN n1 * 12 >= t AND n2 >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY g1) AS opened FROM summed
), files AS MATERIALIZED (SELECT path, folder, (folder = g1 AND opened > 0) OR folder = '.' AS remainder, n, row_number() OVER (PARTITION BY folder ORDER BY n DESC, path) AS k FROM placed
), walked AS (
  SELECT folder, path, k, 0::BIGINT AS chunk, n AS total FROM files WHERE k = 1
  UNION ALL SELECT f.folder, f.path, f.k, CASE WHEN total + n > {MOST} THEN chunk + 1 ELSE chunk END, CASE WHEN total + n > {MOST} THEN n ELSE total + n END FROM walked w JOIN files f ON f.folder = w.folder AND f.k = w.k + 1
), cut AS MATERIALIZED (SELECT w.folder, w.path, chunk, n, remainder, max(chunk) OVER (PARTITION BY w.folder) AS last FROM walked w JOIN files f ON f.path = w.path)
SELECT c.folder || CASE WHEN remainder THEN ' (other files)' ELSE '' END || CASE WHEN last > 0 THEN ' (part ' || (c.chunk + 1) || ')' ELSE '' END AS key, c.folder, remainder, files, tests, coalesce(worst, '') AS worst
FROM (SELECT folder, chunk, max(last) AS last, bool_or(remainder) AS remainder, count(*) AS files, sum(n)::BIGINT AS tests FROM cut GROUP BY ALL) c
LEFT JOIN ({_worst('folder, chunk', f'SELECT c.folder, c.chunk, f.dimension, f.bad FROM cut c JOIN ({_FOUND}) f ON f.path = c.path')}) w ON w.folder = c.folder AND w.chunk = c.chunk""")
def folder_batches(spark, sf_dir):
    rows = tests(spark, sf_dir)
    counts = rows.groupBy("path").agg(F.count("*").alias("n"))
    return batches.folder_batches(rows, reporting.drilled_folders(counts), found(spark, sf_dir), MOST)
