"""Registered queries of evidence selection, the benchmark store and persisted reports, with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import selection, store
from ..operators.stored import shared_dir
from ..sources import reports
from . import bindings as b
from .catalog import registered

# evidence: a part is a test, its line items are fragments; their texts are lines of a length by their numbers
FRAGMENT, BUNDLE = 120, 700
_TEXT = "concat(repeat(concat('row {0} é', {1}, chr(10)), CAST({2} AS INT)), CASE WHEN {3} % 3 = 0 THEN repeat('é', CAST({3} AS INT)) ELSE 'end' END)"
_BODY = _TEXT.format("body", "p_partkey", "p_size % 9", "p_size")
_LINE = _TEXT.format("of", "l_suppkey", "l_linenumber % 4 * (l_partkey % 3)", "l_quantity % 90")
_HOP = "CASE WHEN l_quantity < 8 THEN 1 WHEN l_quantity < 30 THEN 2 ELSE 3 END"
CANDIDATES = f"""SELECT p_partkey AS case_id, 0 AS hop, 'test.ts' AS path, 0::BIGINT AS start, 9::BIGINT AS stop, {_BODY} AS text FROM part
  UNION ALL SELECT l_partkey, {_HOP}, CASE WHEN {_HOP} = 1 THEN 'test.ts' ELSE 'src/f' || (l_suppkey % 5) || '.ts' END, l_orderkey, l_orderkey + l_linenumber, {_LINE} FROM lineitem"""
_BYTES = "strlen({})"
_PREFIX = "list_filter(list_transform(generate_series(1, len(string_split({0}, chr(10))) - 1), lambda i: strlen(array_to_string(string_split({0}, chr(10))[1:i], chr(10))) + 1), lambda n: n <= {1})"
_CHARS = "list_max(list_filter(generate_series(0, length({0})), lambda i: strlen(substr({0}, 1, i)) <= {1}))"


@registered(f"""WITH RECURSIVE one AS MATERIALIZED (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY case_id, least(hop, 2), path, start, stop ORDER BY hop, text) AS r FROM ({CANDIDATES}) c) x WHERE r = 1
), sized AS MATERIALIZED (
  SELECT *, CASE WHEN {_BYTES.format('text')} <= {FRAGMENT} THEN text WHEN len(lines) > 0 THEN substr(text, 1, list_max(list_filter(generate_series(1, length(text)), lambda i: strlen(substr(text, 1, i)) <= list_max(lines)))) ELSE substr(text, 1, {_CHARS.format('text', FRAGMENT)}) END AS content
  FROM (SELECT *, {_PREFIX.format('text', FRAGMENT)} AS lines FROM one) y
), ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY hop, CASE WHEN hop >= 2 THEN path ELSE '' END, start, stop, path) AS k FROM sized
), filled AS (
  SELECT case_id, 0::BIGINT AS k, 0::BIGINT AS total, false AS stopped, 0 AS hop, '' AS path, 0::BIGINT AS start, 0::BIGINT AS stop, '' AS action, 0::BIGINT AS bytes, false AS truncated, '' AS content FROM (SELECT DISTINCT case_id FROM one) d
  UNION ALL SELECT r.case_id, r.k, f.total + CASE WHEN f.stopped THEN 0 WHEN strlen(r.content) <= {BUNDLE} - f.total THEN strlen(r.content) ELSE 0 END, f.stopped OR strlen(r.content) > {BUNDLE} - f.total, r.hop, r.path, r.start, r.stop,
    CASE WHEN f.stopped THEN 'omit' WHEN strlen(r.content) <= {BUNDLE} - f.total THEN 'keep' WHEN len({_PREFIX.format('r.content', f'{BUNDLE} - f.total')}) > 0 THEN 'cut' ELSE 'omit' END,
    CASE WHEN f.stopped THEN 0 WHEN strlen(r.content) <= {BUNDLE} - f.total THEN strlen(r.content) ELSE coalesce(list_max({_PREFIX.format('r.content', f'{BUNDLE} - f.total')}), 0) END, strlen(r.text) > strlen(r.content), r.content
  FROM filled f JOIN ranked r ON r.case_id = f.case_id AND r.k = f.k + 1
) SELECT case_id, hop, path, start, stop, ['test-body', 'hook-in-scope', 'hop-1', 'hop-2'][hop + 1] AS reason, action, bytes, CASE action WHEN 'omit' THEN false WHEN 'cut' THEN true ELSE truncated END AS truncated,
  md5(CASE action WHEN 'keep' THEN content WHEN 'cut' THEN substr(content, 1, list_max(list_filter(generate_series(1, length(content)), lambda i: strlen(substr(content, 1, i)) <= bytes))) END) AS content FROM filled WHERE k > 0""")
def evidence_selection(spark, sf_dir):
    bodies = b.table(spark, sf_dir, "part").selectExpr("p_partkey AS case_id", "0 AS hop", "'test.ts' AS path", "CAST(0 AS BIGINT) AS start", "CAST(9 AS BIGINT) AS stop", f"{_BODY} AS text")
    lines = b.table(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey AS case_id", f"{_HOP} AS hop", f"CASE WHEN {_HOP} = 1 THEN 'test.ts' ELSE concat('src/f', l_suppkey % 5, '.ts') END AS path", "l_orderkey AS start", "l_orderkey + l_linenumber AS stop", f"{_LINE} AS text",
    )
    rows = selection.selected_evidence(bodies.unionByName(lines), FRAGMENT, BUNDLE)
    return rows.withColumn("content", F.md5(F.col("content").cast("binary")))


# the benchmark store: a customer is a case of the run of its nation, orders are observations, every third has a sample, some fail
_RUN = "c_nationkey AS run, c_custkey AS case_id"
_CASES = f"{_RUN}, concat('op', c_custkey % 8) AS operator, CASE WHEN c_custkey % 5 = 0 THEN 'unproven' ELSE 'proven' END AS proof_status, CASE WHEN c_custkey % 5 = 0 AND c_custkey % 2 = 0 THEN 'why' WHEN c_custkey % 7 = 0 THEN 'not kept' END AS proof_reason"
_SEEN = "c_nationkey AS run, c_custkey AS case_id, o_orderkey AS id, o_orderpriority AS label, CASE o_orderkey % 5 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' WHEN 2 THEN 'timed-out' WHEN 3 THEN 'runner-error' ELSE 'odd' END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN concat('d', o_orderkey) END AS detail, md5(CAST(o_orderkey AS {0})) AS content_hash"
_SAMPLES = f"{_RUN}, 'judged' AS status, c_custkey * 3 AS input_tokens, CASE WHEN c_custkey % 4 = 0 THEN c_custkey END AS latency_ms"
_FAILURES = f"{_RUN}, 'timeout' AS kind, concat('m', c_custkey) AS message"
_DETAIL = "CASE kind WHEN 'failed' THEN detail WHEN 'runner-error' THEN coalesce(detail, '') END"
_HASH = "sha256(coalesce(string_agg('path:' || path || chr(0) || contents || chr(0), '' ORDER BY path), ''))"
_RECORDED = f"SELECT c.run, c.case_id, operator, proof_status, CASE WHEN proof_status = 'unproven' THEN coalesce(proof_reason, '') END AS proof_reason, h.hash AS fixture_hash FROM (SELECT {_CASES} FROM customer) c JOIN (SELECT c_custkey AS case_id, {_HASH} AS hash FROM (SELECT c_custkey, 'f' || o_orderkey AS path, o_orderpriority AS contents FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderkey % 3 = 0) f GROUP BY 1) h ON h.case_id = c.case_id"


def benchmark_tables(spark, sf_dir):
    customer, orders = b.table(spark, sf_dir, "customer"), b.table(spark, sf_dir, "orders")
    mine = customer.join(orders, F.col("o_custkey") == F.col("c_custkey"))
    pick = lambda df, columns: df.selectExpr(*_split(columns))
    files = mine.where("o_orderkey % 3 = 0").selectExpr("c_nationkey AS run", "c_custkey AS case_id", "concat('f', o_orderkey) AS path", "o_orderpriority AS contents")
    cases = store.recorded_cases(pick(customer, _CASES), files)
    return cases, pick(mine, _SEEN.format("STRING")), pick(customer.where("c_custkey % 3 = 0"), _SAMPLES), pick(customer.where("c_custkey % 3 = 1 AND c_custkey % 4 = 1"), _FAILURES)


def _split(columns: str) -> list[str]:
    """The expressions of a list, cut at the commas outside of brackets."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


@registered(f"""SELECT r.*, coalesce(o.observations, '') AS observations, CASE WHEN c_custkey % 3 = 0 THEN 'judged ' || (c_custkey * 3) || CASE WHEN c_custkey % 4 = 0 THEN ' ' || c_custkey ELSE '' END END AS sample, CASE WHEN c_custkey % 3 = 1 AND c_custkey % 4 = 1 THEN 'timeout m' || c_custkey END AS failure
FROM ({_RECORDED}) r JOIN customer ON c_custkey = r.case_id LEFT JOIN (SELECT case_id, string_agg(concat_ws(' ', label, CASE WHEN kind = 'odd' THEN '?odd' ELSE kind END, {_DETAIL}), ',' ORDER BY id) AS observations FROM (SELECT {_SEEN.format('VARCHAR')} FROM customer JOIN orders ON o_custkey = c_custkey) s GROUP BY 1) o ON o.case_id = r.case_id""")
def benchmark_store(spark, sf_dir):
    rows = store.nested_cases(*benchmark_tables(spark, sf_dir))
    shown = F.transform("observations", lambda o: F.concat_ws(" ", o["label"], F.coalesce(o["kind"], F.concat(F.lit("?"), o["unknown_kind"])), o["detail"]))
    return rows.withColumns({"observations": F.array_join(shown, ","), "sample": F.when(F.col("sample").isNotNull(), F.concat_ws(" ", "sample.status", F.col("sample.input_tokens").cast("string"), F.col("sample.latency_ms").cast("string"))), "failure": F.when(F.col("failure").isNotNull(), F.concat_ws(" ", "failure.kind", "failure.message"))})


@registered(f"""SELECT 'case' AS part, run, case_id, 0::BIGINT AS id, concat_ws(' ', operator, proof_status, proof_reason, fixture_hash) AS what FROM ({_RECORDED}) r
UNION ALL SELECT 'observation', run, case_id, id, concat_ws(' ', label, kind, {_DETAIL}, content_hash) FROM (SELECT {_SEEN.format('VARCHAR')} FROM customer JOIN orders ON o_custkey = c_custkey) s
UNION ALL SELECT 'sample', run, case_id, 0, concat_ws(' ', status, input_tokens, latency_ms) FROM (SELECT {_SAMPLES} FROM customer WHERE c_custkey % 3 = 0) s
UNION ALL SELECT 'failure', run, case_id, 0, concat_ws(' ', kind, message) FROM (SELECT {_FAILURES} FROM customer WHERE c_custkey % 3 = 1 AND c_custkey % 4 = 1) f""")
def benchmark_round_trip(spark, sf_dir):
    tables = store.flat_tables(store.nested_cases(*benchmark_tables(spark, sf_dir)))
    shown = {"cases": ("operator", "proof_status", "proof_reason", "fixture_hash"), "observations": ("label", "kind", "detail", "content_hash"), "samples": ("status", "input_tokens", "latency_ms"), "failures": ("kind", "message")}
    out = None
    for name, columns in shown.items():
        own = F.col("id") if name == "observations" else F.lit(0).cast("long")
        rows = tables[name].select(F.lit(name[:-1]).alias("part"), "run", "case_id", own.alias("id"), F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]).alias("what"))
        out = rows if out is None else out.unionByName(rows)
    return out


# reports: a month of orders is a run; some reports have a broken line or no head
_MONTH = "{}(o_orderdate, '{}')"
_STATUS = "CASE o_custkey % 5 WHEN 0 THEN 'weak' WHEN 1 THEN 'misleading' WHEN 2 THEN 'needs-review' ELSE 'healthy' END"


@registered(f"""SELECT run, CASE WHEN problem IS NULL THEN n END AS n, CASE WHEN problem IS NULL THEN bad END AS needs_change, CASE WHEN problem IS NULL THEN bad / n::DOUBLE END AS share, problem FROM (
  SELECT strftime(o_orderdate, '%Y-%m') AS run, count(*) AS n, count(*) FILTER ({_STATUS} IN ('weak', 'misleading')) AS bad, CASE WHEN strftime(o_orderdate, '%Y-%m') LIKE '%-04' THEN 'not JSON' WHEN strftime(o_orderdate, '%Y-%m') LIKE '%-09' THEN 'without testCases' END AS problem FROM orders GROUP BY ALL) r""")
def report_listing(spark, sf_dir):
    orders = b.table(spark, sf_dir, "orders").selectExpr("date_format(o_orderdate, 'yyyy-MM') AS run", "concat('o', o_orderkey) AS id", "concat('src/c', o_custkey, '.test.ts') AS path", f"{_STATUS} AS status")
    head = orders.groupBy("run").agg(F.count("*").alias("n"))
    lines = reports.report_lines(head.where("run NOT LIKE '%-09'"), orders)
    broken = head.where("run LIKE '%-04'").select("run", F.lit('{"id": "cut off').alias("line"))
    folder = f"{shared_dir(spark)}/persisted-{uuid.uuid4().hex}"
    reports.write_reports(lines.unionByName(broken), folder)
    return reports.run_listing(reports.read_reports(spark, folder)).drop("recorded_at")
