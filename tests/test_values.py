"""Values that results have to share with the original: tables of inputs and what its source says of them."""

from pyspark.sql import functions as F

from codestrata.functions import ids, paths, text, vectors
from codestrata.operators import extract, findings, records
from codestrata.sources import files


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["r"] for r in rows.select("i", f(F.col("v")).alias("r")).orderBy("i").collect()]


def test_project_scan(spark):
    taken = ["a.dart", "b.kt", "b.kts", "c.swift", "d.ts", "d.tsx", "e.js", "e.jsx", "F.java", "x.yaml", "x.yml", "x.json", "x.arb", "x.xml", "x.plist", "x.toml", "x.gradle", "x.properties", "lib/node_modules/a.js", "target/a.ts", "dist/a.ts"]
    left = ["a.rs", "a.py", "a.md", "a.g.dart", "a.freezed.dart", "a.gr.dart", "my_flutter_app_icons.dart", "a.DART", "README", ".json", "lib/build/a.dart", ".fvm/a.dart", ".ide/a.ts", "ios/Pods/a.swift", ".gradle/a.java", ".git/a.json", "x/.dart_tool/a.json"]
    got = files.scan_project(spark.createDataFrame([(p,) for p in taken + left], "path string"))
    assert sorted(r["path"] for r in got.collect()) == sorted(taken)


def test_import_probes(spark):
    lines = ["import x", "  from a import b", "include y", "#include <a.h>", "using A;", "use a::b;", "require('x')", "x import y", "export a", "package a", "we use it", "important"]
    assert column(spark, lines, extract.import_like) == [True] * 8 + [False] * 4
    texts = ["import x", "use a", "\nuse a", "a from b", "from b", "x = require('a')", "require('a')", "a include b", "a using b", "we use prose", "#include"]
    assert column(spark, texts, extract.contains_import_like) == [True, False, True, True, False, True, False, True, True, False, True]


def test_false_claims_of_unused_imports(spark):
    full = "import 'a.dart' as ext;\n// c\nvoid one() {\n  two();\n  ext.go();\n}\n"
    for snippet, want in (("1 | import 'a.dart' as ext;\n2 | // c", True), ("import 'b.dart' as gone;", False), ("2 | // c", False)):
        assert column(spark, [snippet], lambda c: extract.unused_import_is_false(c, F.lit(full))) == [want]


def test_confidence(spark):
    bodies = ["plain", "```x```", "a::b", "f()", "one `tick`", "é" * 151, "x" * 300]
    assert [round(x, 6) for x in column(spark, bodies, lambda c: vectors.confidence(c, F.lit(0), F.lit(False)))] == [0.6, 0.75, 0.75, 0.75, 0.6, 0.65, 0.6]
    assert round(column(spark, ["plain"], lambda c: vectors.confidence(c, F.lit(20001), F.lit(False)))[0], 6) == 0.55


def test_routes_of_models(spark):
    rows = [("symbol", None, 1, 0, "slow"), ("symbol", None, 1, 40, "fast"), ("range", 79, 1, 0, "fast"), ("range", 80, 1, 0, "slow"), ("line", None, 2501, 0, "slow"), ("line", None, 2500, 0, "fast"), ("file", None, 9999, 0, "fast"), ("global", None, 9999, 0, "fast")]
    df = spark.createDataFrame(rows, "kind string, span int, tokens int, used int, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", vectors.initial_route(F.col("tokens"), F.col("kind"), F.col("span"), F.col("used"))).collect())
    high = vectors.Policy(severity="High")
    got = df.withColumn("got", vectors.initial_route(F.col("tokens"), F.col("kind"), F.col("span"), F.col("used"), high)).collect()
    assert [r["got"] for r in got] == ["slow", "fast", "fast", "slow", "fast", "fast", "fast", "fast"]
    up = spark.createDataFrame([("High", 0.6, 1, True), ("Medium", 0.7, 1, False), ("Medium", 0.7, 2501, True), ("Low", 0.1, 9999, False)], "s string, c double, t int, want boolean")
    assert all(r["got"] == r["want"] for r in up.withColumn("got", vectors.should_escalate(F.lit("fast"), F.col("s"), F.col("c"), F.col("t"))).collect())


def test_heuristic_of_drafts(spark):
    rows = [("High", "x" * 100, 1, 5, 6000 + 10 - 12), ("Low", "é" * 100, 7, 7, 2000 + 20), ("Medium", "```diff", None, None, 4000 + 500 - 600), ("Low", "x" * 9000, 1, 900, 2000 + 600 - 600)]
    df = spark.createDataFrame(rows, "s string, b string, a int, e int, want int")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", findings.heuristic(F.col("s"), F.col("b"), F.col("a"), F.col("e"))).collect())


def test_outlines(spark):
    code = "void dispose() { if (x) return; Return 1 + 2; }\n  return a\nundisposed closes free Drop cancelled()"
    assert column(spark, [code], text.returns_outline) == [["return", "return 1 + 2", "return a"]]
    assert column(spark, [code], text.cleanup_like) == [["dispose", "Drop", "free"]]
    writes = spark.createDataFrame([(1, "a = 1\nb += a\na == 2\nc.d -= 3; b = 4")], "k int, t string")
    assert [(r["name"], r["n"]) for r in extract.writes_in_scope(writes, "k", "t").orderBy("rank").collect()] == [("a", 2), ("b", 2), ("d", 1)]


def test_routes_in_code(spark):
    code = "context.go('/b'); GoRouter.of(context).go( \"/a\" ); x.push('/p'); y.go(path); z.go('/b'); w.go('/" + "l" * 200 + "')"
    assert column(spark, [code], extract.go_routes) == [["/a", "/b"]]


def test_origins_and_targets(spark):
    uris = ["dart:core", "package:a/b.dart", "file:///repo/lib/a.dart", "/repo/lib/a.dart", "./a.dart", "https://x/flutter/bin/cache/y", "file:///home/u/flutter/packages/flutter/lib/x.dart", "file:///opt/other.dart"]
    assert column(spark, uris, paths.origin) == ["sdk", "package", "local", "unknown", "unknown", "unknown", "local", "local"]
    got = column(spark, uris, lambda c: paths.target_path(c, F.lit("/repo")))
    assert got[0] == "dart:core" and got[2].endswith("lib/a.dart") and "file:" not in got[2]
    assert got[6] == "flutter_sdk/packages/flutter/lib/x.dart" and got[7] == "file:///opt/other.dart"


def test_markdown_keys_tags_and_hashes(spark):
    md = spark.range(1).select(findings.to_markdown(F.lit(" T "), F.lit("b\n"), F.lit("-a\n+b\n")).alias("x"), findings.to_markdown(F.lit("T"), F.lit("b"), F.lit(None).cast("string")).alias("y")).first()
    assert md["x"] == "**T**\n\nb\n\n```diff\n-a\n+b\n```\n" and md["y"] == "**T**\n\nb\n"
    keys = spark.createDataFrame([("a", 3, "line"), ("a", None, "file"), (None, None, "global")], "p string, l int, k string")
    assert [r[0] for r in keys.select(ids.idempotency_key(F.col("p"), F.col("l"), F.col("k"), F.lit("h"))).collect()] == ["a:3|line#h", "a:-|file#h", ":-|global#h"]
    kinds = ["Class", "Function", "Method", "Variable", "Field", "Import", "Export", "File", "Enum"]
    assert column(spark, kinds, lambda c: records.tags(c, F.lit("a/test/widget.dart"))) == [[*([t] if t else []), "test", "widget"] for t in ("class", "function", "function", "variable", None, "import", "export", "file", None)]
    assert len({ids.simhash_of([str(i), "b", "c", str(i)]) for i in range(60)}) == 60 and any(ids.simhash_of([str(i), "b", "c"]) < 0 for i in range(20))


def test_upsert_takes_the_last_and_survives_a_crash(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = lambda *r: spark.createDataFrame(list(r), "id string, v int")
    files.upsert(rows(("a", 1), ("b", 1), ("a", 2), (None, 5)), path, order=F.col("v"))
    files.upsert(rows(("a", 3), (None, 6), ("c", 1)), path, order=F.col("v"))
    assert sorted((str(r["id"]), r["v"]) for r in spark.read.parquet(path).collect()) == [("None", 6), ("a", 3), ("b", 1), ("c", 1)]
    (tmp_path / "t").rename(tmp_path / "t.old")  # a run that stopped between its two renames
    files.upsert(rows(("c", 2)), path)
    assert sorted((str(r["id"]), r["v"]) for r in spark.read.parquet(path).collect()) == [("None", 6), ("a", 3), ("b", 1), ("c", 2)]


def test_symbol_trees_of_any_depth(spark):
    tree = '{"name": "n0"}'
    for i in range(1, 30):
        tree = f'{{"name": "n{i}", "children": [{tree}]}}'
    got = extract.flatten_symbols(spark.createDataFrame([(1, f"[{tree}]"), (2, "[]"), (3, "x")], "k int, j string"), "k", "j").collect()
    assert sorted((r["depth"], r["name"]) for r in got) == [(29 - i, f"n{i}") for i in reversed(range(30))]


def test_bodies_of_short_texts_and_of_long_ones(spark):
    """A text without lines has an empty body; each line of a long text is looked at once."""
    long = "import a;\n// c\n" + "int x = 1;\n" * 3000 + "import late;\nuse(a)\n"
    rows = spark.createDataFrame([(0, ""), (1, "\n"), (2, "import a;"), (3, "import a;\nint a;\nint b;\nimport c;\nd(a)\n"), (4, long)], "k int, t string")
    body = {r["k"]: r["b"] for r in rows.select("k", extract.body_without_imports(F.col("t")).alias("b")).collect()}
    assert body == {0: "", 1: "", 2: "", 3: "d(a)", 4: "int x = 1;\n" * 2998 + "use(a)"}


def test_symbols_shuffle_texts_not_lines(spark):
    rows = spark.createDataFrame([("a.dart", "class A {\n\n  int f(int x) {\n    // {\n    return x; }\n  }\n}\nvoid g() {\n}\n")], "path string, text string")
    out = extract.symbols(rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")  # what stands below comes later
    assert [(r["kind"], r["name"], r["line"], r["owner"]) for r in out.orderBy("line").collect()] == [("class", "A", 1, None), ("method", "f", 3, "A"), ("function", "g", 8, None)]


def test_diff_lines_are_sorted_once(spark):
    from codestrata.operators import diff

    rows = spark.createDataFrame([("a", "prelude\n@@ -5,2 +7,3 @@ f\n x\n+y\n\\ No newline\n-z\n@@ -20 +30 @@\n+p\n q"), ("b", None)], "k string, t string")
    out = diff.parse_lines(rows, "k", "t")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.index("Generate") < plan.index("Exchange")
    assert sorted((r["hunk"], r["op"], r["old_line"], r["new_line"], r["content"]) for r in out.collect() if r["op"] == "context") == [(1, "context", 5, 7, "x"), (2, "context", 20, 31, "q")]
    assert {(r["op"], r["old_line"], r["new_line"]) for r in out.collect() if r["op"] != "context"} == {("added", None, 8), ("removed", 6, None), ("added", None, 30)}
