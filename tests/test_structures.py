"""Nested suites, bindings, JSON trees, alias configuration, batches, selection, store and reports: literal and random rows."""

import json
import os
import random
import re

from pyspark.sql import functions as F

from quillspark.functions import script_number, utf16_length
from quillspark.operators import aliases, audit, batches, declarations, evidence, requests, resume, selection, store, suites, values, workitems
from quillspark.sources import corpus, reports, repository

R = random.Random(7)
SPANS = "file string, start long, stop long, kind string, name string"


def random_file(name, size, nest):
    """Spans of one file, in order; a list of (start, stop, kind, name) and what encloses each."""
    out, at, open_ = [], 0, []
    for _ in range(size):
        at += R.randint(1, 3)
        while open_ and R.random() < 0.4:
            out[open_.pop()][2] = at
            at += 1
        kind = R.choice(["suite", "test", "test", "beforeEach", "afterAll"])
        if kind == "suite" and len(open_) < nest:
            open_.append(len(out))
            out.append([name, at, None, "suite", R.choice("ab")])
        else:
            out.append([name, at, at + 1, "test" if kind == "suite" else kind, R.choice("ab")])
    while open_:
        at += 1
        out[open_.pop()][2] = at
    return [tuple(x) for x in out]


def brute_scopes(rows):
    return {(f, a): max([x for g, x, y, k, _ in rows if g == f and k == "suite" and x < a and y >= b], default=None) for f, a, b, _, _ in rows}


def test_scopes_and_hooks(spark):
    rows = random_file("one", 300, 6) + random_file("two", 60, 3) + [("empty", 5, 9, "test", "alone")]
    df = spark.createDataFrame(rows, SPANS)
    want = brute_scopes(rows)

    def around(f, a):
        out = []
        while want[f, a] is not None:
            a = want[f, a]
            out.append(a)
        return out

    for block in (7, 64, 32_768):
        got = {(r.file, r.start): (r.scope, r.level) for r in suites.scopes(df, block).collect()}
        assert got == {k: (v, len(around(*k))) for k, v in want.items()}
    hooks = {}
    for r in suites.inherited_hooks(df, 50).orderBy("file", "test", "rank").collect():
        hooks.setdefault((r.file, r.test), []).append((r.hook, r.hook_start))
    for f, a, _, k, _ in rows:
        if k == "test":
            scopes = [*reversed(around(f, a)), None][-1:] + [*reversed(around(f, a))]
            mine = [(x[3], x[1]) for s in scopes for x in sorted(rows) if x[0] == f and x[3] not in ("suite", "test") and want[f, x[1]] == s]
            assert hooks.get((f, a), []) == mine
    assert suites.inherited_hooks(df.limit(0)).count() == 0
    names = {(r.file, r.test): (r.depth, r.ancestry) for r in suites.ancestries(df, 50).collect()}
    assert names["empty", 5] == (0, "test:alone#0") and all(len(around(*k)) == d for k, (d, _) in names.items())


def test_ancestries_look_up_anchors_only(spark, monkeypatch):
    rows = random_file("one", 300, 6) + random_file("two", 200, 4) + [("empty", 5, 9, "test", "alone")]
    want, kept = brute_scopes(rows), sorted(x for x in rows if x[3] in ("suite", "test"))
    ordinals, segments = {}, {}
    for f, a, _, k, n in kept:
        at = ordinals[f, want[f, a], k, n] = ordinals.get((f, want[f, a], k, n), -1) + 1
        segments[f, a] = f"{k}:{n}#{at}"

    def path(f, a):
        return [] if a is None else [*path(f, want[f, a]), segments[f, a]]

    looked, scopes = [], suites.scopes
    monkeypatch.setattr(suites, "scopes", lambda df, block: looked.append(df.count()) or scopes(df, block))
    for block in (7, 64, 32_768):
        got = {(r.file, r.test): (r.depth, r.ancestry) for r in suites.ancestries(spark.createDataFrame(rows, SPANS), block).collect()}
        assert got == {(f, a): (len(path(f, a)) - 1, "/".join(path(f, a))) for f, a, _, k, _ in kept if k == "test"}, block
    # in one block only the spans at the top of a file are left
    assert looked[-1] == sum(want[f, a] is None for f, a, *_ in kept) < len(kept)


def test_a_large_file_is_many_blocks(spark):
    n = 200_000
    ids = spark.range(n)
    # suites of 100 spans, each with a hook first
    df = ids.select(F.lit("big").alias("file"), (F.col("id") * 10).alias("start"), F.when(F.col("id") % 100 == 0, F.col("id") * 10 + 995).otherwise(F.col("id") * 10 + 5).alias("stop"), F.when(F.col("id") % 100 == 0, "suite").when(F.col("id") % 100 == 1, "beforeEach").otherwise("test").alias("kind"), F.lit("x").alias("name"))
    got = suites.inherited_hooks(df, 4096)
    assert got.count() == n // 100 * 98 and got.where("hook_start <> floor(test / 1000) * 1000 + 10 OR rank <> 1 OR hook_level <> 1").count() == 0


def test_hooks_of_a_block_are_told_there(spark, monkeypatch):
    """only spans that no suite ending in their block holds are looked up, whatever is in them, and names aren't carried."""
    rows = random_file("one", 300, 6) + random_file("two", 200, 4) + [("empty", 5, 9, "test", "alone"), ("late", 1, 500, "suite", "s"), ("late", 3, 4, "test", "t"), ("late", 490, 491, "afterEach", "h"), ("late", 600, 601, "afterAll", "h")]
    df = spark.createDataFrame(rows, SPANS)
    want, looked, scopes = brute_scopes(rows), [], suites.scopes
    monkeypatch.setattr(suites, "scopes", lambda df, block: looked.append((df.count(), df.columns)) or scopes(df, block))
    level = lambda f, a: 0 if want[f, a] is None else 1 + level(f, want[f, a])
    expect = set()
    for f, a, _, k, _ in rows:
        if k == "test":
            chain, s = [], want[f, a]
            while True:
                chain = [(x[3], x[1], level(f, x[1])) for x in sorted(rows) if x[0] == f and x[3] not in ("suite", "test") and want[f, x[1]] == s] + chain
                if s is None:
                    break
                s = want[f, s]
            expect |= {(f, a, i + 1, *h) for i, h in enumerate(chain)}
    for block in (7, 64, 32_768):
        got = [tuple(r) for r in suites.inherited_hooks(df, block).select("file", "test", "rank", "hook", "hook_start", "hook_level").collect()]
        assert len(got) == len(expect) and set(got) == expect
    assert "name" not in looked[-1][1] and looked[-1][0] < 0.7 * len(rows)


def test_parameter_cases(spark):
    rows = [(1, [[["a"], ["b"]], [["1", "x"], ["2", "y"], ["3", "z"]]]), (2, []), (3, [[["a"]], []]), (4, [[[str(i)] for i in range(150)], [[str(i)] for i in range(100)]])]
    df = spark.createDataFrame(rows, "test int, tables array<array<array<string>>>")
    got = {}
    for r in suites.parameter_cases(df, cases=1000).orderBy("test", "ordinal").collect():
        got.setdefault(r.test, []).append((r.ordinal, r.digits, r["values"]))
    assert got[1] == [(i * 3 + j, [i, j], ["ab"[i], "123"[j], "xyz"[j]]) for i in range(2) for j in range(3)]
    assert got[2] == [(None, [], [])] and 3 not in got
    assert got[4] == [(i * 100 + j, [i, j], [str(i), str(j)]) for i in range(150) for j in range(100)]
    cells = spark.createDataFrame([([("a", None), (None, ["b", "c"])],)], "rows array<struct<value: string, items: array<string>>>")
    assert cells.select(suites.table_rows(F.col("rows")).alias("x"), suites.table_rows(F.col("rows"), "for").alias("y")).first() == ([["a"], ["b", "c"]], [["a"], [None]])


def test_chains_and_cycles_of_exports(spark):
    rows = [(f"f{i}", 1, "from", "v", "v", f"f{i + 1}") for i in range(1000)] + [("f1000", 1, "modified", "v", None, None)]
    rows += [(f"c{i}", 1, "from", "v", "v", f"c{(i + 1) % 7}") for i in range(7)] + [("into", 1, "from", "w", "v", "c3")]
    rows += [(f"s{i}", 1, "star", None, None, f"s{i + 1}") for i in range(40)] + [("s40", 1, "list", "v", "inner", None), ("s40", 4, "plain", "inner", "inner", None), ("s40", 5, "default", None, None, None)]
    rows += [("r0", 1, "star", None, None, "r1"), ("r1", 1, "star", None, None, "r0"), ("d", 2, "default", None, "made", None), ("x", 1, "from", "v", "v", None)]
    # a star hides the re-export behind it, a declaration isn't hidden
    rows += [("h", 1, "star", None, None, "s38"), ("h", 2, "from", "v", "v", "f999"), ("h", 3, "modified", "u", None, None)]
    exports = spark.createDataFrame(rows, "file string, position int, form string, name string, local string, target string")
    asked = [("f0", "v"), ("f500", "v"), ("c0", "v"), ("into", "w"), ("s0", "v"), ("s0", "default"), ("s40", "default"), ("r0", "v"), ("d", "default"), ("x", "v"), ("h", "v"), ("h", "u"), ("none", "v"), ("f0", "w")]
    wanted = spark.createDataFrame(asked, "file string, exported string")
    got = {(r.file, r.exported): tuple(r)[2:] for r in declarations.followed_declarations(wanted, exports).collect()}
    none = (None, None, None, None)
    assert got == {
        ("f0", "v"): ("declaration", "f1000", "v", 1, 1000), ("f500", "v"): ("declaration", "f1000", "v", 1, 500), ("c0", "v"): ("cycle", *none), ("into", "w"): ("cycle", *none), ("s0", "v"): ("declaration", "s40", "inner", 4, 40),
        ("s0", "default"): ("missing", *none), ("s40", "default"): ("declaration", "s40", "default", 5, 0), ("r0", "v"): ("missing", *none), ("d", "default"): ("declaration", "d", "made", 2, 0), ("x", "v"): ("missing", *none),
        ("h", "v"): ("declaration", "s40", "inner", 4, 3), ("h", "u"): ("declaration", "h", "u", 3, 0), ("none", "v"): ("missing", *none), ("f0", "w"): ("missing", *none),
    }
    one = {(r.file, r.exported): tuple(r)[2:] for r in declarations.exported_declarations(wanted, exports).collect()}
    assert one["f0", "v"] == ("re-export", "v", 1) and one["h", "v"] == ("re-export", "v", 1) and one["s40", "default"] == ("declaration", "default", 5) and one["s0", "default"] == (None, None, None)


def test_references(spark):
    bindings = spark.createDataFrame([("t", "d", None, "./d", "default"), ("t", "n", "name", "./n", "named"), ("t", "m", None, "./n", "named"), ("t", "ns", None, "./s", "namespace")], "file string, local string, imported string, specifier string, kind string")
    uses = spark.createDataFrame([(1, "t", "d", None), (1, "t", "n", "x"), (1, "t", "n", None), (1, "t", "m", None), (1, "t", "ns", "a"), (1, "t", "ns", None), (1, "t", "zz", None), (2, "u", "d", None)], "snippet int, file string, name string, member string")
    assert sorted(tuple(r) for r in declarations.references(uses, bindings).collect()) == [(1, "t", "./d", "default"), (1, "t", "./n", "m"), (1, "t", "./n", "name"), (1, "t", "./s", "a")]


def encode(x):
    """Plain version of the canonical encoding of Python values; -0.0 stands for -0."""
    if x is None:
        return "null;"
    if isinstance(x, bool):
        return f"boolean:{int(x)};"
    if isinstance(x, str):
        return f"string:{len(x.encode('utf-16-be')) // 2}:{x};"
    if isinstance(x, (int, float)):
        text = "-0" if x == 0 and str(x).startswith("-") else repr(x).removesuffix(".0")
        return f"number:{text};"
    if isinstance(x, list):
        return f"array:{len(x)}[{''.join(map(encode, x))}]"
    keys = sorted((k for k in x if k.isdigit() and (k == "0" or k[0] != "0")), key=int) + [k for k in x if not (k.isdigit() and (k == "0" or k[0] != "0"))]
    return "object:" + "".join(f"key:{len(k.encode('utf-16-be')) // 2}:{k}:{encode(x[k])}" for k in keys) + ";"


def random_value(depth):
    kind = R.randrange(8 if depth else 5)
    if kind >= 5:
        inner = [random_value(depth - 1) for _ in range(R.randint(0, 4))]
        return inner if kind == 5 else {R.choice(["a", "b", "10", "9", "é", "", "01", "x y", "😀", '"']): v for v in inner}
    return R.choice([None, True, False, R.choice(["", "-0", "a\nb", "😀", '\\"-0', "ß"]), R.choice([0, -0.0, 1, -5, 1.5, -0.25, 123456.75])])


def test_canonical_values(spark):
    data = [random_value(4) for _ in range(300)] + ["x", 3, -0.0, [], {}, None]
    # a zero of no text keeps its sign; in JSON it is an integer
    texts = [re.sub(r"-0\.0(?!\d)", "-0", json.dumps(v, ensure_ascii=False)) for v in data]
    bad = ["not json", "", "1,2", None, '{"a":', '{"a":1,"a":2}']
    df = spark.createDataFrame(list(enumerate(texts + bad)), "id int, json string")
    got = {r.id: r.encoding for r in values.canonical_values(df).collect()}
    assert [got[i] for i in range(len(data))] == [encode(v) for v in data]
    assert all(got[len(data) + i] is None for i in range(len(bad)))
    n = spark.createDataFrame([(x,) for x in (1e20, 1e21, 1.5e-7, 1e-6, -2.5, 0.0, 1.7976931348623157e308, 123456789012345680000.0)], "x double")
    assert [r[0] for r in n.select(script_number(F.col("x"))).collect()] == ["100000000000000000000", "1e+21", "1.5e-7", "0.000001", "-2.5", "0", "1.7976931348623157e+308", "123456789012345680000"]
    assert spark.createDataFrame([("a😀",)], "x string").select(utf16_length(F.col("x"))).first()[0] == 3
    rows = spark.createDataFrame([([["number:1;", "string:1:a;"], ["null;"]],)], "x array<array<string>>")
    assert rows.select(values.canonical_segments(F.col("x"))).first()[0] == encode([[1, "a"], [None]])


def test_canonical_values_are_encoded_in_one_pass(spark):
    texts = ['{"b":1,"10":[],"4294967295":2,"9":{"a":{"a":1,"a":2}}}', '{"b":1,"10":[1e21,0.1,2E-7],"4294967295":2,"9":{}}', "[NaN]", "[1e23]", '"\\ud800"', "[" * 800 + "]" * 800, "{'a':1}", " [ ] "]
    made = values.canonical_values(spark.createDataFrame(list(enumerate(texts)), "id int, json string"))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r.encoding for r in made.collect()}
    object_ = "object:key:1:9:object:;key:2:10:array:3[number:1e+21;number:0.1;number:2e-7;]key:1:b:number:1;key:10:4294967295:number:2;;"
    assert got == {0: None, 1: object_, 2: None, 3: "array:1[number:1e+23;]", 4: "string:1:\ufffd;", 5: "array:1[" * 799 + "array:0[" + "]" * 800, 6: None, 7: "array:0[]"}


def test_schema_violations(spark):
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer"}, "b": {"type": ["array", "null"], "items": {"enum": [1, "x", None]}}, "c.d": {"type": "boolean"}}}
    texts = ['{"a": 1, "b": [1, "x", null], "c.d": true}', '{"b": null}', '{"a": 1.5, "z": {}, "b": [2, [], 1]}', "[]", "nope", None, '{"a": 1.0, "b": "no", "c.d": 0}', "null"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, json string")
    got = sorted(tuple(r) for r in values.schema_violations(df, schema).collect())
    assert got == sorted(
        [
            (1, "$.a", "required property is missing"), (2, "$.a", "expected type integer, got number"), (2, "$.z", "unexpected property (additionalProperties is false)"), (2, "$.b[0]", 'value 2 is not one of [1,"x",null]'), (2, "$.b[1]", 'value [] is not one of [1,"x",null]'),
            (3, "$", "expected type object, got array"), (4, "$", "not JSON"), (5, "$", "not JSON"), (6, "$.b", "expected type array | null, got string"), (6, "$.c.d", "expected type boolean, got number"), (7, "$", "expected type object, got null"),
        ]
    )


def test_alias_configuration(spark):
    files = {
        "a/b/tsconfig.json": '{"extends": ["../one", "../two.json"], "compilerOptions": {"paths": {"@/*": ["./src/*", "../../../out"], "n": []}}}', "a/one.json": '{"compilerOptions": {"baseUrl": "base"}}', "a/two.json": '{"extends": "./one.json", /* c */ "compilerOptions": {"paths": {"two": "x"}},}',
        "a/jsconfig.json": '{"compilerOptions": {"baseUrl": "."}}', "a/tsconfig.json": '{"extends": "./loop"}', "a/loop.json": '{"extends": ["./tsconfig.json", "pkg/base", "/abs", "../../x", "./node_modules/y", "./gone"], "compilerOptions": {"baseUrl": "../.."}}', "tsconfig.json": "{",
    }
    configs = spark.createDataFrame(list(files.items()), "path string, text string")
    asked = spark.createDataFrame([(p,) for p in ("a/b/c/d.ts", "a/x.ts", "top.ts", "z/y.ts")], "path string")
    assert {r.path: r.config for r in aliases.nearest(asked, configs).collect()} == {"a/b/c/d.ts": "a/b/tsconfig.json", "a/x.ts": "a/tsconfig.json", "top.ts": "tsconfig.json", "z/y.ts": "tsconfig.json"}
    roots = spark.createDataFrame([("a/b/tsconfig.json",), ("a/tsconfig.json",), ("tsconfig.json",)], "root string")
    entries, refused = aliases.path_entries(roots, configs)
    # baseUrl comes from what the last extends leads to, and paths are seen from there
    assert sorted(tuple(r) for r in entries.collect()) == [("a/b/tsconfig.json", "baseUrl", "*", ["a/base/*"], "a/one.json"), ("a/b/tsconfig.json", "paths", "@/*", ["a/base/src/*"], "a/b/tsconfig.json")]
    assert sorted((r.root, r.reason, r.detail) for r in refused.collect()) == sorted(
        [("a/b/tsconfig.json", "target-outside-root", "../../../out"), ("tsconfig.json", "config-malformed", ""), ("a/tsconfig.json", "target-outside-root", "*"), ("a/tsconfig.json", "extends-cycle", "./tsconfig.json"), ("a/tsconfig.json", "extends-node-modules", "pkg/base")]
        + [("a/tsconfig.json", "extends-outside-root", "/abs"), ("a/tsconfig.json", "extends-outside-root", "../../x"), ("a/tsconfig.json", "extends-node-modules", "./node_modules/y"), ("a/tsconfig.json", "extends-missing", "./gone")]
    )


def fold(sizes, most):
    out, chunk, total = [], 0, 0
    for n in sizes:
        if total and total + n > most:
            chunk, total = chunk + 1, 0
        total += n
        out.append(chunk)
    return out


def test_chunks_are_those_of_a_fold(spark):
    rows, want = [], {}
    for f in range(6):
        sizes = [R.choice([1, 2, 3, 9, 30, 41]) for _ in range(R.choice([1, 5, 400]))]
        for i, (n, c) in enumerate(zip(sizes, fold(sizes, 40))):
            rows.append((f"d{f}", f"{i:04d}", n))
            want[f"d{f}", f"{i:04d}"] = c
    df = spark.createDataFrame(rows, "folder string, file string, n long")
    assert {(r.folder, r.file): r.chunk for r in batches.chunks(df, 40).collect()} == want
    assert batches.chunks(df.limit(0), 40).count() == 0


def test_evidence_selection(spark):
    rows = [(1, 0, "t", 0, 1, "body\n"), (1, 1, "t", 9, 10, "b hook\n"), (1, 1, "t", 5, 6, "a hook\n"), (1, 3, "a", 1, 2, "again"), (1, 2, "b", 1, 2, "one\ntwo\nthree"), (1, 2, "a", 1, 2, "again"), (1, 3, "z", 0, 1, "late"), (2, 0, "t", 0, 1, "ééééééé"), (3, 0, "t", 0, 1, "x" * 9), (3, 2, "a", 0, 1, ""), (3, 2, "b", 0, 1, "y" * 9)]
    df = spark.createDataFrame(rows, "case_id int, hop int, path string, start long, stop long, text string")
    got = {}
    for r in selection.selected_evidence(df, 9, 28).orderBy("case_id", "hop", "path", "start").collect():
        got.setdefault(r.case_id, []).append((r.reason, r.path, r.action, r.bytes, r.truncated, r.content))
    assert got[1] == [("test-body", "t", "keep", 5, False, "body\n"), ("hook-in-scope", "t", "keep", 7, False, "a hook\n"), ("hook-in-scope", "t", "keep", 7, False, "b hook\n"), ("hop-1", "a", "keep", 5, False, "again"), ("hop-1", "b", "cut", 4, True, "one\n"), ("hop-2", "z", "omit", 0, False, None)]
    assert got[2] == [("test-body", "t", "keep", 8, True, "éééé")]
    assert [x[2] for x in got[3]] == ["keep", "keep", "keep"]


def test_benchmark_store(spark):
    cases = spark.createDataFrame([(1, 1, "unproven", None), (1, 2, "proven", "gone")], "run int, case_id int, proof_status string, proof_reason string")
    files = spark.createDataFrame([(1, 1, "b", "2"), (1, 1, "a", "1")], "run int, case_id int, path string, contents string")
    seen = spark.createDataFrame([(1, 1, 2, "x", "failed", None, "h"), (1, 1, 1, "y", "runner-error", None, "h"), (1, 1, 3, "z", "odd", "d", "h")], "run int, case_id int, id int, label string, kind string, detail string, content_hash string")
    sample = spark.createDataFrame([(1, 2, 5)], "run int, case_id int, tokens int")
    failed = spark.createDataFrame([(1, 1, "timeout", "m")], "run int, case_id int, kind string, message string")
    import hashlib

    known = store.recorded_cases(cases, files)
    got = {r.case_id: r for r in store.nested_cases(known, seen, sample, failed).collect()}
    assert got[1].fixture_hash == hashlib.sha256(b"path:a\x001\x00path:b\x002\x00").hexdigest() and got[2].fixture_hash == hashlib.sha256(b"").hexdigest()
    assert (got[1].proof_reason, got[2].proof_reason) == ("", None)
    assert [(o.id, o.kind, o.detail, o.unknown_kind) for o in got[1].observations] == [(1, "runner-error", "", None), (2, "failed", None, None), (3, None, None, "odd")] and got[2].observations == []
    assert got[1].sample is None and got[2].sample.tokens == 5 and got[1].failure.message == "m" and got[2].failure is None
    back = store.flat_tables(store.nested_cases(known, seen, sample, failed))
    assert {k: v.count() for k, v in back.items()} == {"cases": 2, "observations": 3, "samples": 1, "failures": 1}
    assert sorted(r.kind for r in back["observations"].collect()) == ["failed", "odd", "runner-error"]


def test_reports_in_a_folder(spark, tmp_path):
    tests = spark.createDataFrame([("r1", "a", "p", "weak"), ("r1", "b", "p", "healthy"), ("r2", "c", "p", "misleading"), ("r3", "d", "p", "weak")], "run string, id string, path string, status string")
    head = spark.createDataFrame([("r1", 2), ("r2", 1), ("r4", 0)], "run string, n long")
    folder = f"file://{tmp_path}"
    reports.write_reports(reports.report_lines(head, tests).unionByName(spark.createDataFrame([("r5", "{oops")], "run string, line string")), folder)
    for i, run in enumerate(("r2", "r4", "r1")):  # r1 is the newest
        for name in os.listdir(tmp_path / "reports" / f"run={run}"):
            os.utime(tmp_path / "reports" / f"run={run}" / name, (1_700_000_000 + i, 1_700_000_000 + i))
    lines = reports.read_reports(spark, folder)
    listing = reports.run_listing(lines)
    assert {r.run: (r.n, r.needs_change, r.share, r.problem) for r in listing.collect()} == {"r1": (2, 1, 0.5, None), "r2": (1, 1, 1.0, None), "r3": (None, None, None, "without testCases"), "r4": (0, 0, 0.0, None), "r5": (None, None, None, "not JSON")}
    page = reports.newest(listing, 2).collect()
    assert [r.run for r in page] == ["r1", "r4"] and {r.skipped for r in page} == {2}
    assert [r.run for r in reports.newest(listing, 5, 2).collect()] == ["r2"]
    assert {r.id for r in reports.report_of(lines, "r2").collect()} == {None, "c"}
    for bad in ("../reports/run=r1", "..", "", "r9", "a\\b"):
        assert reports.report_of(lines, bad).count() == 0
    assert {r.run for r in reports.report_of(lines.where("run IN ('r1', 'r2', 'r4')")).collect()} == {"r1"}


def test_module_references(spark):
    long = "x" * 60_000
    source = f"""// import 'no'
/* require("no") */ import a, {{ b as c }} from "one"; import 'two'
const s = 'it\\'s from "no"', t = `import "no" {long}`, u = "{long}";
export * from './three'; export {{ d }} from "./four"
import type {{ T }} from './five';
const l = await import( /* why */ "./six"), r = require('seven'); o.require('no'); o.import("no"); require(name); from('no')
"""
    df = spark.createDataFrame([("a", source), ("b", ""), ("c", None), ("d", "/* never closed import 'no'")], "path string, source string")
    got = [(r.path, r.ordinal, r.specifier, r.kind) for r in repository.module_references(df).orderBy("path", "ordinal").collect()]
    kinds = [("one", "import"), ("two", "import"), ("./three", "export"), ("./four", "export"), ("./five", "import"), ("./six", "dynamic"), ("seven", "require")]
    assert got == [("a", i, s, k) for i, (s, k) in enumerate(kinds)]


def test_requests(spark):
    cases = spark.createDataFrame([(1, "n", [("suite", "s")], "jest", "p", ["skip", "only"]), (2, 'q"', [], "jest", "p", [])], "case_id int, name string, ancestry array<struct<kind: string, name: string>>, framework string, path string, modifiers array<string>")
    fragments = spark.createDataFrame([(1, "helper", "a", None, "hop-1", False, "é\n"), (1, "test", "z", "s", "test-body", True, "b"), (1, "helper", "a", None, "hop-1", False, "A")], "case_id int, kind string, path string, symbol string, reason string, truncated boolean, content string")
    none = spark.createDataFrame([], "case_id int, path string, rule string, specifier string, reason string, symbol string")
    asked = requests.questions(("x",), {"x.quality": "How?"})
    got = {r.case_id: r.request for r in requests.built_requests(cases, fragments, none, none, none, asked, "m").collect()}
    state = {"testCaseId": "1", "name": "n", "structuralAncestry": [{"kind": "suite", "name": "s"}], "framework": "jest", "repositoryRelativePath": "p", "modifiers": ["only", "skip"]}
    told = [{"kind": k, "path": p} | ({"symbol": s} if s else {}) | {"selectionReason": r, "truncated": t, "content": c} for k, p, s, r, t, c in (("test", "z", "s", "test-body", True, "b"), ("helper", "a", None, "hop-1", False, "A"), ("helper", "a", None, "hop-1", False, "é\n"))]
    want = {"state": state | {"fragments": told, "denied": [], "unresolved": [], "omitted": []}, "model": "m", "questions": asked}
    assert got[1] == json.dumps(want, separators=(",", ":"), ensure_ascii=False) and list(asked) == ["x.applicable", "x.quality"] and json.loads(got[2])["state"]["name"] == 'q"'
    sources = spark.createDataFrame([(1, "a\r\nb"), (2, "a\nb")], "case_id int, text string")
    keys = {r.case_id: r.key for r in requests.request_keys(requests.built_requests(cases, fragments, none, none, none, asked, "m"), sources, "v1").collect()}
    assert len(set(keys.values())) == 2 and all(len(k) == 64 for k in keys.values())


def test_selected_cases_are_all_there(spark):
    import pytest

    corpus_ = spark.createDataFrame([(1, "a"), (2, "b")], "case_id int, name string")
    assert {r.name for r in resume.selected_cases(spark.createDataFrame([(2,)], "case_id int"), corpus_).collect()} == {"b"}
    with pytest.raises(Exception, match="not in the corpus: 3"):
        resume.selected_cases(spark.createDataFrame([(2,), (3,)], "case_id int"), corpus_).collect()


def test_framework_hints(spark):
    repo = {"package.json": '{"jest": {}}', "a/package.json": '{"scripts": {"test": "vitest"}, "jest": {}}', "b/package.json": "{}", "b/jest.config.ts": "", "c/package.json": '{"devDependencies": {"@vitest/x": "1"}}', "c/jest.config.js": "", "d/package.json": "{"}
    files = spark.createDataFrame([(x,) for x in ("t.ts", "a/x/t.ts", "b/t.ts", "c/t.ts", "d/t.ts", "e/t.ts")], "path string")
    got = {r.path: r.hint for r in resume.framework_hints(files, spark.createDataFrame(list(repo.items()), "path string, text string")).collect()}
    assert got == {"t.ts": "jest", "a/x/t.ts": None, "b/t.ts": "jest", "c/t.ts": None, "d/t.ts": None, "e/t.ts": "jest"}


def test_windows_round_to_milliseconds(spark):
    import datetime

    at = lambda us: datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(microseconds=us)
    old = lambda us: datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(microseconds=us)
    # 1 and 2 share millisecond 3, 3 is 999 ms later; 4 and 5 share -2; 6 and 7 have no time
    times = [at(2825), at(3100), at(1_002_400), old(-1500), old(-2400), None, None]
    log = spark.createDataFrame([(i + 1, "a", 10 ** i, t) for i, t in enumerate(times)], "id long, identity string, tokens long, ts timestamp")
    assert {r.id: r.n for r in workitems.requests_within(log, 1).collect()} == {1: 2, 2: 2, 3: 3, 4: 2, 5: 2, 6: 2, 7: 2}
    assert {r.id: r.tokens for r in audit.tokens_within(log, 1000).collect()} == {1: 11, 2: 11, 3: 111, 4: 11000, 5: 11000, 6: 1100000, 7: 1100000}


def test_token_windows_are_running_sums(spark):
    import datetime
    import random

    # a frame with a lower bound would be summed anew for each request of a busy hour
    r = random.Random(4)
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    data = [(i, r.choice([None, 0, 1, 5, -3, 10**12]), r.choice([None, *range(0, 9000, 100), *range(-50, 50)])) for i in range(600)]
    log = spark.createDataFrame([(i, n, None if t is None else start + datetime.timedelta(milliseconds=t)) for i, n, t in data], "id long, tokens long, ts timestamp")
    for ms in (1, 10, 100, 1000, 6400):
        df = audit.tokens_within(log, ms)
        want = {}
        for i, _, t in data:
            window = [n for _, n, x in data if n is not None and (x is None if t is None else x is not None and t - ms < x <= t)]
            want[i] = sum(window) if window else None
        assert {x.id: x.tokens for x in df.collect()} == want
    assert f"RangeFrame, -{ms - 1}" not in df._jdf.queryExecution().toString()


def test_probed_without_broadcast(spark):
    files = ["a.js", "a.ts", "b.tsx", "b.mts", "c/index.cjs", "c.tsx", ".ts", "d.jsx/index.ts", "d.tsx", "e", "e.ts", None]
    asked = ["a.js", "a.js", "a", "b.js", "b.mjs", "b", "c", "", "d.jsx", "e", "x", None]
    df = evidence.probed(spark.createDataFrame([(x,) for x in asked], "base string"), spark.createDataFrame([(x,) for x in files], "path string"))
    assert {r.base: r.path for r in df.collect()} == {"a.js": "a.js", "a": "a.ts", "b.js": "b.tsx", "b.mjs": "b.mts", "b": "b.tsx", "c": "c.tsx", "": ".ts", "d.jsx": "d.tsx", "e": "e"}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_spans_are_ordered_once(spark):
    """Hooks are ranked for a scope and not for each test in it, and the suites around are sought for suites alone."""
    rows = [("f", 10, 900, "suite", "s"), ("f", 15, 16, "beforeEach", "h"), ("f", 3, 4, "afterAll", "h"), *(("f", 20 + 2 * i, 21 + 2 * i, "test", "t") for i in range(300))]
    df = spark.createDataFrame(rows, SPANS)
    hooks = suites.inherited_hooks(df, 64)
    assert hooks.count() == 600 and {(r.rank, r.hook, r.hook_start, r.hook_level) for r in hooks.collect()} == {(1, "afterAll", 3, 0), (2, "beforeEach", 15, 1)}
    assert suites.enclosing(suites.scopes(df, 64).where("kind = 'suite'")).count() == 0
    # the one window behind the last write ranks hooks of scopes, so no test's key is sorted by it
    plan = hooks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "windowspecdefinition(file" in plan and "test#" not in plan[plan.index("windowspecdefinition(file"):].split("\n")[0]
    assert {r.ancestry for r in suites.ancestries(df, 64).where("test < 24").collect()} == {"suite:s#0/test:t#0", "suite:s#0/test:t#1"}


def test_two_hops_group_numbers(spark, monkeypatch):
    """The least importer of a pair by number, lists of targets in parts, none in the specifier; a pair's texts aren't sorted."""
    monkeypatch.setattr(evidence, "LISTED", 2)
    rows = [("src/a.ts", f"tests/{h}.ts", "./h") for h in "cb"] + [(f"tests/{h}.ts", f"src/t{i}.ts", None if i == 2 else s) for h in "bc" for i in range(5) for s in ("./z", "./y")]
    rows += [("src/a.ts", "src/t0.ts", "./one"), ("tests/b.ts", "src/a.ts", "./self"), ("tests/b.ts", "tests/b.ts", "./own"), ("src/t1.ts", "src/u.ts", "./no")]
    df = evidence.two_hops(spark.createDataFrame(rows, "a string, b string, specifier string"))
    got = {r.target: (r.hop, r.importer, r.specifier) for r in df.where("start = 'src/a.ts'").collect()}
    assert got == {"tests/b.ts": (1, "src/a.ts", "./h"), "tests/c.ts": (1, "src/a.ts", "./h"), "src/t0.ts": (1, "src/a.ts", "./one"), **{f"src/t{i}.ts": (2, "tests/b.ts", None if i == 2 else "./y") for i in range(1, 5)}}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_nearest_spreads_high_folders(spark):
    """Files of many folders below one configuration at the root: no task gets them all."""
    files = spark.createDataFrame([(f"a/b{i % 50}/f{i}.ts",) for i in range(500)] + [("top.ts",), ("a/b1/c/d/x.ts",), ("z/y.ts",), ("z/y.ts",)], "path string")
    configs = spark.createDataFrame([("jsconfig.json",), ("tsconfig.json",), ("a/b7/jsconfig.json",), ("a/b1/c/tsconfig.json",), ("z/other.json",)], "path string")
    df = aliases.nearest(files, configs)
    got = {r.path: r.config for r in df.collect()}
    assert df.count() == len(got) == 503 and got["top.ts"] == got["z/y.ts"] == got["a/b3/f3.ts"] == "tsconfig.json" and got["a/b7/f57.ts"] == "a/b7/jsconfig.json" and got["a/b1/c/d/x.ts"] == "a/b1/c/tsconfig.json"
    assert "part" in df._jdf.queryExecution().optimizedPlan().toString()


def test_chains_send_nothing_through_the_driver(spark):
    configs = spark.createDataFrame([("a/tsconfig.json", '{"extends": ["../base.json", "./none"]}'), ("base.json", "{}")], "path string, text string")
    found, refused = aliases.chains(spark.createDataFrame([("a/tsconfig.json",)], "root string"), configs)
    assert {(r.path, tuple(r.place)) for r in found.collect()} == {("a/tsconfig.json", ()), ("base.json", (0,))}
    assert [(r.reason, r.detail) for r in refused.collect()] == [("extends-missing", "./none")]
    assert "Broadcast" not in refused._jdf.queryExecution().executedPlan().toString()


def test_schema_checks_are_one_pass(spark, monkeypatch):
    """values are parsed once and written nowhere; members of members, lists of lists, nulls that are there and odd keys are found."""
    monkeypatch.setattr(values, "stored", None)
    odd = "a'b\"c"
    schema = {"type": "object", "required": ["o", "r"], "properties": {"o": {"type": "object", "properties": {"n": {"type": "null"}, odd: {"type": "string"}}}, "l": {"type": "array", "items": {"type": "array", "items": {"enum": [1, None]}}}}}
    rows = [(1, json.dumps({"o": {"n": None, odd: None}, "r": None, "l": [[1, None, 2], 3]})), (2, json.dumps({"o": {"n": 1}, "l": None})), (3, "{"), (4, None)]
    got = sorted(tuple(r) for r in values.schema_violations(spark.createDataFrame(rows, "id int, json string"), schema).collect())
    assert got == [
        (1, "$.l[0][2]", "value 2 is not one of [1,null]"), (1, "$.l[1]", "expected type array, got number"), (1, f"$.o.{odd}", "expected type string, got null"),
        (2, "$.l", "expected type array, got null"), (2, "$.o.n", "expected type null, got number"), (2, "$.r", "required property is missing"), (3, "$", "not JSON"), (4, "$", "not JSON"),
    ]


def test_manifests_are_parsed_once(spark):
    """cases are joined from what was written; no join, rule or filter parses a manifest again."""
    sound = {"id": "a", "operators": ["remove-assertion"], "operatorRole": "prescriptive", "oracleKind": "assertion-mutation", "testEffect": "t", "productionEffect": "p", "expectedOutcome": "expected-to-fail", "testFile": "t.ts", "productionFiles": ["p.ts"]}
    files = [("x/case.json", json.dumps(sound)), ("x/t.ts", ""), ("x/p.ts", ""), ("y/case.json", json.dumps(sound | {"testFile": "p.ts"})), ("case.json", json.dumps(sound | {"oracleKind": 1})), ("y/p.ts", "")]
    df = corpus.corpus_cases(spark.createDataFrame(files, "path string, source string"))
    assert "variant" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sorted(tuple(r) for r in df.collect()) == [("", "a", "remove-assertion", 0, "oracleKind"), ("x", "a", "remove-assertion", 2, None), ("y", "a", "remove-assertion", 1, "repeated-id")]


def test_alias_matches_deal_what_many_specifiers_begin_with(spark):
    made = [f"@/a{i}.css" for i in range(40)] + ["@/exact", "b", "", None]
    patterns = [("*", 2, 0), ("@/*", 1, 1), ("@/*.css", 1, 2), ("@/a1*.css", 1, 3), ("@/exact", 1, 4), ("@/*/*", 0, 5), ("long/pattern/*", 0, 6)]
    asked = spark.createDataFrame([(x,) for x in made], "specifier string")
    found = evidence.alias_matches(asked, spark.createDataFrame(patterns, "pattern string, source int, ord int"))
    want = {x: "@/a1*.css" if x.startswith("@/a1") else "@/*" if x.startswith("@/a") else {"@/exact": "@/exact"}.get(x, "*") for x in made if x is not None}
    assert {r.specifier: r.pattern for r in found.collect()} == want
    # nothing is sorted by a beginning that all specifiers have
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin [prefix" in plan and "SortMergeJoin" not in plan
    assert not evidence.alias_matches(asked, spark.createDataFrame([], "pattern string, source int, ord int")).count()


def test_conditional_targets_deeper_than_a_round(spark):
    deep = '"./deep"'
    for i in range(2 * aliases.LEVELS + 3):
        deep = f'{{"{("node", "import", "default")[i % 3]}": {deep}}}'
    made = {"s": '"./s"', "o": '{"node": "./n", "default": {"browser": "./b", "import": [1]}}', "f": '{"import": "./i", "default": {"node": {"x": 1}, "import": null}}', "n": "null", "u": '{"browser": "./b"}', "7": "7", "e": "{}", "d": deep}
    rows = spark.createDataFrame([(k, 1, v) for k, v in made.items()], "id string, more int, json string")
    found = aliases.conditional_targets(rows.select("id", "more", F.parse_json("json").alias("v")))
    want = {"s": ("target", "./s"), "o": ("target", "./n"), "f": ("blocked", None), "n": ("blocked", None), "u": ("unsupported", None), "7": ("unsupported", None), "e": ("unsupported", None), "d": ("target", "./deep")}
    assert {r.id: (r.kind, r.target) for r in found.collect()} == want and found.columns == ["id", "more", "kind", "target"]
    # values aren't grouped or joined
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    # a folder is matched by any pattern, and by none where there are none
    for patterns, names in (('["a/*", "b"]', {"@a", "@a/*", "@b", "@b/*"}), ("[]", set()), ("7", set())):
        configs = spark.createDataFrame([("package.json", f'{{"workspaces": {patterns}}}'), ("a/x/package.json", '{"name": "@a"}'), ("b/package.json", '{"name": "@b"}'), ("c/package.json", '{"name": "@c"}')], "path string, text string")
        assert {r.pattern for r in aliases.workspace_entries(configs)[0].collect()} == names


def test_corpus_paths_are_not_sent_through_the_driver(spark):
    """however small what paths come from looks, they may be many."""
    sound = {"id": "a", "operators": ["remove-assertion"], "operatorRole": "prescriptive", "oracleKind": "assertion-mutation", "testEffect": "t", "productionEffect": "p", "expectedOutcome": "expected-to-fail", "testFile": "t.ts", "productionFiles": ["p.ts", "q.ts"]}
    df = corpus.corpus_cases(spark.createDataFrame([("x/case.json", json.dumps(sound)), ("x/t.ts", ""), ("x/p.ts", ""), ("y/case.json", "{")], "path string, source string"))
    assert sorted(tuple(r) for r in df.collect()) == [("x", "a", "remove-assertion", 3, "missing:q.ts"), ("y", None, None, 0, "not-json")]
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
