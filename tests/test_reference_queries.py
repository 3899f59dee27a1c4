"""Every registered query of the reference's operators against its SQL in DuckDB, and literal boundary rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.operators import benchmark, evidence, judgment, reporting, review, workitems
from quillspark.plans import catalog
from quillspark.sources import repository

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    import glob
    import os

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple("null" if r[i] is None else repr(float(r[i])) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    want = duck.execute(catalog.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(cols)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), cols)


def one(spark, policy, a, p, score, confidence=0.9):
    df = spark.createDataFrame([(a, *p, score, confidence)], "applicability double, p0 double, p1 double, p2 double, p3 double, score double, confidence double")
    r = judgment.judge(df, policy).first()
    return r.status, r.level, r.reason


def test_boundaries(spark):
    v1, v2, v3 = judgment.V1, judgment.V2, judgment.V3
    assert one(spark, v2, 0.9, (0.3, 0.35, 0.2, 0.15), 1.0) == ("judged", "weak", None)
    assert one(spark, v2, 0.9, (0.3, 0.34, 0.2, 0.16), 1.0) == ("needs-review", None, "boundary-straddle")
    assert one(spark, v2, 0.9, (0.5, 0.2, 0.2, 0.1), 1.0)[1] == "misleading" and one(spark, v2, 0.9, (0.49, 0.21, 0.2, 0.1), 1.0)[1] == "weak"
    assert one(spark, v3, 0.9, (0.2, 0.225, 0.3, 0.275), 2.0) == ("judged", "acceptable", None)
    assert one(spark, v3, 0.9, (0.3, 0.28, 0.2, 0.22), 1.0)[2] == "boundary-straddle"
    assert one(spark, v2, 0.9, (0.3, 0.3, 0.3, 0.12), 1.0)[2] == "boundary-straddle" and one(spark, v2, 0.9, (0.3, 0.3, 0.3, 0.13), 1.0)[2] == "missing-answer"
    assert one(spark, v2, None, (0.3, 0.3, 0.3, 0.1), 1.0)[2] == "missing-answer" and one(spark, v2, 0.49, (0.3, 0.3, 0.3, 0.1), 1.0)[0] == "not-applicable"
    assert one(spark, v2, 0.9, (-0.1, 0.4, 0.4, 0.3), 1.0)[2] == "missing-answer"
    assert one(spark, v1, 0.9, (0.0, 0.0, 0.0, 1.0), 3.0)[1] == "strong" and one(spark, v1, 0.9, (0.0, 0.0, 0.0, 1.0), 2.9, 0.59)[2] == "low-confidence"


def test_verdicts(spark):
    judged = spark.createDataFrame([(1, "judged", "misleading", True), (1, "judged", "strong", True), (2, "judged", "strong", True), (3, "not-applicable", None, False), (4, "judged", "strong", True)], "case_id long, status string, level string, applicable boolean")
    cases = spark.createDataFrame([(1, True), (2, False), (3, True), (4, True)], "case_id long, pinned boolean")
    assert {r.case_id: r.verdict for r in judgment.verdicts(judged, cases).collect()} == {1: "misleading", 2: "needs-review", 3: "needs-review", 4: "healthy"}
    assert tuple(judgment.headline(judgment.verdicts(judged, cases).limit(0)).first()) == (0, 0.0, 0.0)


def test_throttle(spark):
    rows = [("a", i, s) for i, s in enumerate(["throttled", *["clean"] * 5])] + [("b", 0, "throttled")]
    got = {r.key: (r.limit, r.streak) for r in workitems.throttle_limits(spark.createDataFrame(rows, "key string, ord int, signal string"), 4).collect()}
    assert got == {"a": (3, 0), "b": (2, 0)}


def test_evidence(spark):
    c = lambda f, *x: spark.createDataFrame([(v,) for v in x], "p string").select(f(F.col("p")).alias("r")).collect()
    assert [r.r for r in c(evidence.specifier_class, "@scope/x", "@/x", "~/x", "#x", "lodash", "./a", None)] == ["bare", "alias", "alias", "alias", "bare", "relative", "dynamic"]
    assert [r.r for r in c(evidence.denied_by, "src/.env", "src/a.ts", "x/node_modules/y/z.js")] == ["deny-list:.env*", None, "deny-list:**/node_modules/**"]
    assert [r.r for r in c(evidence.normal_path, "a//b/./c/../d", "../x", "/x", "a\\b")] == ["a/b/d", None, None, "a/b"]
    assert [r.r for r in c(lambda p: evidence.matches_glob(p, "**/foo/**"), "foo", "a/foo", "foo/x", "a/foo/x/y")] == [False, False, True, True]
    assert [r.r for r in c(lambda p: evidence.matches_glob(p, "foo/**"), "foo", "foo/x", "a/foo/x")] == [True, True, False]
    assert [r.r for r in c(evidence.helper_role, "src/a.test.ts", "tests/x.ts", "src/dbHelper.ts", "src/a.ts", "tests.ts")] == [True, True, True, False, False]
    f = spark.createDataFrame([("x", 1, "abcdef"), ("x", 2, "a\nb\nc d"), ("x", 3, "a"), ("y", 1, "abcdef"), ("y", 2, "abcdef"), ("z", 5, None)], "bundle string, ord long, text string")
    for block in (1, 2, 1024):
        got = {(r.bundle, r.ord): (r.action, r.bytes) for r in evidence.budget_fill(f.where("text IS NOT NULL"), 10, block).collect()}
        assert got == {("x", 1): ("keep", 6), ("x", 2): ("cut", 4), ("x", 3): ("omit", 0), ("y", 1): ("keep", 6), ("y", 2): ("omit", 0)}
    assert [r.r for r in c(lambda p: evidence.cut_text(p, 5), "abc", "ab\ncd\nef", "ab\ncdefg", "abcdééé", None)] == ["abc", "ab\n", "ab\n", "abcd", None]


def test_repository(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.test.ts").write_text("import { it } from 'vitest'\nexport * from \"./b\"\nrequire('c'); import('d')")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.test.js").write_text("x")
    files = repository.repository(spark, f"file://{tmp_path}")
    assert {r.path: r.reason for r in repository.discovered(files).collect()} == {"src/a.test.ts": None, "node_modules/x.test.js": "default-exclude"}
    assert files.where("path LIKE 'src%'").select(repository.specifiers(F.col("source")).alias("s")).first().s == ["vitest", "./b", "c", "d"]
    assert {r.path: r.framework for r in repository.frameworks(files, ["jest", "vitest"]).collect()} == {"src/a.test.ts": "vitest", "node_modules/x.test.js": "unknown"}


def test_review(spark):
    with pytest.raises(ValueError):
        review.blind_payload(spark.range(1).withColumn("level", F.lit("weak")), ["id", "level"])
    runs = lambda rows: tuple(review.version_identity(spark.createDataFrame(rows, "policy string, rubric string, model string")).first())
    assert runs([]) == ("none", None) and runs([("v3", "r2", "a")] * 2) == ("v3/r2", "a") and runs([("v3", "r2", "a"), ("v2", "r2", "b")]) == ("mixed", "mixed")
    rows = spark.createDataFrame([(i, i, d, True) for i, d in enumerate("aab")], "ord long, case_id long, dimension string, correct boolean")
    assert [r.case_id for r in review.review_selection(rows, "stratified", ("a", "b")).collect()] == [0, 2, 1]
    assert [r.case_id for r in review.review_selection(rows, "stratified", ("a", "b"), limit=2).collect()] == [0, 2]


def test_drilled_folders(spark):
    counts = spark.createDataFrame([("src/a/x.ts", 50), ("src/b/y.ts", 40), ("lib/z.ts", 10), ("top.ts", 1)], "path string, n long")
    got = {r.path: (r.folder, r.remainder) for r in reporting.drilled_folders(counts).collect()}
    assert got == {"src/a/x.ts": ("src/a", False), "src/b/y.ts": ("src/b", False), "lib/z.ts": (".", True), "top.ts": (".", True)}


def test_chunks_and_batches(spark):
    files = spark.createDataFrame([("f", "a", 30), ("f", "b", 20), ("f", "c", 90), ("f", "d", 1)], "folder string, file string, n long")
    assert [(r.file, r.chunk) for r in evidence.chunks(files, 40).orderBy("file").collect()] == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert catalog.queries()["batches"](spark, SF).count() > 0


def test_votes_and_compare(spark):
    s = spark.createDataFrame([("d", 1, True, "judged", "weak")] * 3 + [("d", 1, True, "judged", "strong")] * 2 + [("d", 2, False, "judged", "weak"), ("d", 2, False, "judged", "strong")], "dimension string, case_id long, prescriptive boolean, status string, level string")
    assert {r.case_id: r.deficient for r in benchmark.votes(s).collect()} == {1: True, 2: None}
    schema = "case_id long, verdict string, prescriptive boolean, proven boolean"
    x = spark.createDataFrame([(1, "healthy", True, True), (2, "weak", True, True), (3, None, True, True), (4, "weak", True, True)], schema)
    y = spark.createDataFrame([(1, "weak", True, True), (2, "weak", True, True), (3, "weak", True, True), (5, "weak", True, True)], schema)
    assert {r.case_id: r.outcome for r in benchmark.compare(x, y).collect()} == {1: "regression", 2: "agreement", 3: "not-sampled-in-baseline", 4: "missing-in-candidate", 5: "missing-in-baseline"}


def test_diff(spark):
    x, y = (spark.createDataFrame(r, "case_id long, verdict string") for r in ([(1, "weak"), (2, "healthy"), (3, "weak")], [(1, "healthy"), (2, "misleading"), (4, "weak")]))
    assert {r.case_id: r.change for r in reporting.status_diff(x, y).collect()} == {1: "improved", 2: "regressed", 3: "removed", 4: "added"}


def test_log(spark, tmp_path):
    log = spark.createDataFrame([("r1", 1, "a", "pending"), ("r1", 2, "a", "completed")], "run_id string, id long, identity string, state string")
    workitems.append_log(log, f"{tmp_path}/log")
    workitems.append_log(log.limit(1), f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 3


def test_functions(spark):
    from quillspark import functions as fn

    c = lambda f, *x: [r.r for r in spark.createDataFrame([(v,) for v in x], "p string").select(f(F.col("p")).alias("r")).collect()]
    assert c(fn.html_escaped, "<a b='c'>&") == ["&lt;a b=&#39;c&#39;&gt;&amp;"]
    assert c(lambda p: fn.redacted(p, "k1"), "a k1 b k1") == ["a [redacted] b [redacted]"]
    assert c(lambda p: fn.occurrences(p, "aa"), "aaaa b", "x") == [2, 0]
    assert c(lambda p: fn.capped_list(F.split(p, ","), 2), "a,b,c,d", "a") == [["a", "b", "2 more"], ["a"]]
    assert c(lambda p: F.get_json_object(fn.without_json_comments(p), "$.a"), '{"a": "x // y", /* z */ "b": [1,], // t\n}') == ["x // y"]
    assert [r.p for r in spark.createDataFrame([("b",), ("A",), ("a",)], "p string").orderBy(fn.in_language_order(F.col("p"))).collect()] == ["a", "A", "b"]


def test_streams(spark, tmp_path):
    from quillspark.streaming import throttle

    rows = [("a", 0, "throttled"), *[("a", i, "clean") for i in range(1, 7)], ("b", 0, "neutral")]
    spark.createDataFrame(rows, "key string, ord long, signal string").write.parquet(f"{tmp_path}/in")
    stream = throttle.throttle_stream(spark.readStream.schema("key string, ord long, signal string").parquet(f"{tmp_path}/in"))
    query = stream.writeStream.outputMode("update").format("memory").queryName("limits").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.key: (r.limit, r.streak) for r in spark.table("limits").collect()} == {"a": (5, 1), "b": (8, 0)}
    batch = workitems.throttle_limits(spark.createDataFrame(rows, "key string, ord int, signal string"))
    assert {r.key: (r.limit, r.streak) for r in batch.collect()} == {"a": (5, 1), "b": (8, 0)}
