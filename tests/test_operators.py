"""Operators against small Python versions, and the properties that they have to keep."""

import random

import pytest
from pyspark.sql import functions as F

from codestrata.functions import ids
from codestrata.functions.vectors import SEVERITY_RANK
from codestrata.operators import chunking, diff, extract, findings, graph, intervals, records, retrieval
from codestrata.sources import files as sources
from codestrata.streaming import jsonl


def test_micro_chunks_of_the_reference_values(spark):
    df = spark.createDataFrame([("a\nb\nc\nd\n",)], "t string")
    r = chunking.micro_chunks(df, "t", F.lit("p"), F.lit(100), F.lit(10), 2, 1).orderBy("ord").collect()
    assert [(x["start_row"], x["end_row"]) for x in r] == [(10, 12), (11, 13), (12, 14)] and r[0]["end_col"] == 1 and r[0]["start_byte"] == 100 < r[0]["end_byte"]
    df = spark.createDataFrame([("if (x) {\n  do();\n}\n",)], "t string")
    role = lambda c: F.when(c.startswith("if"), "if_arm")
    r = chunking.micro_chunks(df, "t", F.lit("p"), F.lit(0), F.lit(0), 3, 0, role).collect()
    assert len(r) == 1 and r[0]["role"] == "if_arm"


@pytest.mark.parametrize(("most", "overlap"), [(3, 1), (5, 0), (4, 3)])
def test_windows_cover_all_lines(spark, most, overlap):
    rows = [(n, "\n".join(f"l{i}" for i in range(n))) for n in range(1, 30)]
    out = chunking.split_chunks(spark.createDataFrame(rows, "n int, t string"), "t", most, overlap, 4000).collect()
    for n in range(1, 30):
        own = sorted((r["chunk_index"], r["chunk_text"]) for r in out if r["n"] == n)
        assert {x for _, c in own for x in c.split("\n")} == {f"l{i}" for i in range(n)} and own[-1][1].endswith(f"l{n - 1}")
        assert [i for i, _ in own] == list(range(1, len(own) + 1))


def test_brace_body(spark):
    t = "x\nvoid f() {\n  if (a) {\n  }\n}\nrest"
    r = chunking.brace_body(spark.createDataFrame([(1, t)], "k int, t string"), "k", "t", F.lit(2)).first()
    assert (r["body_start"], r["body_end"]) == (2, 5)


def test_merged_blocks_are_disjoint(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(5), s := rng.randrange(200), s + rng.randrange(9), rng.random()) for i in range(200)]
    out = intervals.merge_intervals(spark.createDataFrame(rows, "id int, file int, start int, end int, score double"), ["file"]).collect()
    for f in range(5):
        own = sorted((r["start"], r["end"]) for r in out if r["file"] == f)
        assert all(b[0] > a[1] + 1 for a, b in zip(own, own[1:]))
        assert {x for _, g, s, e, _ in rows if g == f for x in range(s, e + 1)} == {x for s, e in own for x in range(s, e + 1)}
    assert sum(r["n"] for r in out) == 200


def test_mmr_is_within_the_pool_and_by_score(spark):
    rng = random.Random(2)
    hits = [{"id": i, "score": rng.random(), "embedding": [rng.gauss(0, 1) for _ in range(4)]} for i in range(40)]
    for mode in ("min", "max"):
        got = retrieval.mmr_select(hits, [1.0, 0, 0, 0], 6, div_mode=mode)
        pool = {h["id"] for h in sorted(hits, key=lambda h: (-h["score"], h["id"]))[:18]}
        assert len(got) == 6 and {h["id"] for h in got} <= pool and [h["score"] for h in got] == sorted((h["score"] for h in got), reverse=True)


def test_query_parsing():
    p = retrieval.parse_query("Dart 'a b' key: \"v w\" x")
    assert p.language == "dart" and p.quoted == ["a b", "v w"] and p.pairs == [("key", "v w")] and "dart" in p.tokens
    assert retrieval.search_tokens("ab abc a.b/c") == ["abc", "a.b/c"] and retrieval.term_filter("a b", F.lit(1)) is None
    assert retrieval.payload_filter([("a", 1.5)]) is None


def drafts_in_python(rows):
    """The greedy choice written out: clusters in order, themes, near copies, then the heuristic."""
    from codestrata.functions.ids import simhash_of

    theme = lambda b: next((n for n, ws in (("cleanup", ("dispose", "cancel(", "leak")), ("rebuild", ("rebuild", "setstate", "performance")), ("routing", ("route", "navigation"))) if any(w in b.lower() for w in ws)), "other")
    toks = lambda s: [t for t in __import__("re").split(r"[^\w]+|_", "".join(c.lower() if c.isascii() else c for c in s)) if len(t.encode()) >= 3]
    out = []
    for path in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == path), key=lambda r: (r[2] is None, r[2] or 0, r[0]))
        clusters, last = [], None
        for r in own:
            close = last is not None and (r[2] is None or last[2] is None or (r[2] <= last[3] and last[2] <= r[3]) or max(r[2] - last[3], last[2] - r[3]) <= 10)
            clusters.append([]) if not close else None
            clusters[-1].append(r)
            last = r
        for c in clusters:
            for th in {theme(r[5]) for r in c}:
                kept = []
                for r in sorted(r for r in c if theme(r[5]) == th):
                    if all(bin(simhash_of(toks(r[5])) ^ simhash_of(toks(k[5]))).count("1") > 5 for k in kept):
                        kept.append(r)
                value = lambda r: SEVERITY_RANK[r[4]] * 2000 + (500 if "```diff" in r[5] else 0) + min(len(r[5].encode()) // 10, 600) - min(3 * (r[3] - r[2] if r[2] is not None else 9999), 600)
                out.append(max(kept, key=lambda r: (value(r), -r[0]))[0])
    return sorted(out)


def test_drafts_against_python(spark):
    rng = random.Random(3)
    words = "please dispose the controller route is wrong rebuild happens often use const here maybe leak".split()
    rows = []
    for i in range(120):
        s = rng.choice([None, rng.randrange(200)])
        body = " ".join(rng.choice(words) for _ in range(rng.randint(1, 25))) + rng.choice(["", " ```diff\n-a\n```"])
        rows.append((i, f"p{i % 5}", s, None if s is None else s + rng.randrange(5), rng.choice(["Low", "High", "Medium"]), rows[-1][5] if rows and rng.random() < 0.2 else body))
    df = spark.createDataFrame(rows, "id int, path string, start int, end int, severity string, body string")
    assert sorted(r["id"] for r in findings.dedup_drafts(df).collect()) == drafts_in_python(rows)


def test_near_copies_of_large_groups_go_as_in_small_ones(spark, monkeypatch):
    """Chains and families of near hashes, equal ones and null groups: rounds over pieces keep what the greedy pass keeps."""
    rng = random.Random(8)
    rows = []
    for g, n in ((None, 150), ("a", 300), ("b", 3)):
        family = [rng.getrandbits(64) for _ in range(6)]
        for _ in range(n):
            h = rng.choice(family)
            for _ in range(rng.randrange(5)):
                h ^= 1 << rng.randrange(64)
            if rng.random() < 0.3:
                family.append(h)
            rows.append((len(rows), g, h - (1 << 64) if h >> 63 else h))
    rng.shuffle(rows)
    want = []
    for g in (None, "a", "b"):
        kept = []
        for i, _, h in sorted(r for r in rows if r[1] == g):
            if all(bin((h ^ k) & (1 << 64) - 1).count("1") > 5 for k in kept):
                kept.append(h)
                want.append(i)
    df = spark.createDataFrame(rows, "id int, path string, simhash long")
    monkeypatch.setattr(findings, "LOWEST", 8)
    for group in (4096, 20):
        assert sorted(r["id"] for r in findings.drop_near(df, ["path"], group=group).collect()) == sorted(want)
    assert not findings.drop_near(df.limit(0), ["path"]).collect()


def test_patches(spark):
    df = spark.createDataFrame([("-b \n-c\n+x", "a\nb\nc  \nd"), ("+only", "a"), ("-b\n-d", "a\nb\nc\nd"), ("-b", None)], "p string, t string")
    r = df.select(diff.patch_applies(F.col("p"), F.col("t")).alias("ok"), diff.reanchor(F.col("p"), F.col("t")).alias("at")).collect()
    assert [x["ok"] for x in r] == [True, True, False, True] and r[0]["at"] == 2 and r[2]["at"] is None
    f = spark.createDataFrame([(1, "int a;\nlong longName() {}\nfoo bar\n")], "k int, t string")
    got = diff.signature_line(f, "k", "t", F.array(F.lit("longName"), F.lit("foo"), F.lit("bar")), F.expr("array(named_struct('start', 3, 'end', 9))")).first()
    assert got["line"] == 3


def test_imports_by_language(spark):
    cols = "id string, kind string, name string, file string, resolved_target string, language string, signature string, doc string, fqn string"
    n = lambda i, k, name, file, lang: (i, k, name, file, None, lang, None, None, name)
    nodes = spark.createDataFrame([n("a", "file", "a", "src/a.ts", "typescript"), n("b", "file", "b", "src/b/index.ts", "typescript"), n("i", "import", "./b", "src/a.ts", "typescript"), n("c", "file", "c", "m/c.py", "python"), n("d", "file", "d", "m/d.py", "python"), n("j", "import", ".d", "m/c.py", "python"), n("e", "file", "e", "x/e.go", "go"), n("f", "file", "f", "y/f.go", "go"), n("k", "import", "lib/f.go", "x/e.go", "go")], cols)
    edges = {(r["src"], r["dst"], r["label"]) for r in graph.language_aware_graph(nodes).collect()}
    assert {("a", "b", "imports"), ("c", "d", "imports"), ("e", "f", "imports")} <= edges


DART = """import 'dart:async';
import 'src/a.dart' as a;
export 'src/b.dart';
part 'c.dart';

/// A page.
/// Of two lines.
abstract class Page extends StatelessWidget {
  final int _count = 1;
  static String title(int x) {
    return go('/home');
  }
  int get size => _count;
}

mixin Walks on Page {}
mixin class Both {}
enum Kind { one, two }
extension Shout on String {}
extension on int {}
extension type Id(int v) {}

void main() {
  runApp(Page());
}
"""


def test_extraction(spark):
    f = spark.createDataFrame([("lib/page.dart", DART)], "path string, text string")
    docs = extract.docs_above(f, extract.symbols(f).filter("name = 'Page'").select("path", "line")).first()
    assert docs["doc"] == "A page.\nOf two lines."
    nodes = extract.ast_nodes(f)
    assert nodes.filter("kind = 'file'").count() == 1 and nodes.select("symbol_id").distinct().count() == nodes.count()
    one = f.select(F.concat(extract.go_routes(F.lit("x.go('/a'); path: '/b'")), extract.config_routes(F.lit("x.go('/a'); path: '/b'"))).alias("r"), extract.is_widget(F.col("text")).alias("w"), extract.unused_import_is_false(F.lit("import {a} from 'x'"), F.lit("import {a} from 'x'\nx\ny\nuse(a)")).alias("u")).first()
    assert one["r"] == ["/a", "/b"] and one["w"] and one["u"]
    tree = '[{"name": "A", "detail": "d1\\nd2", "range": {"start": {"line": 1}, "end": {"line": 9}}, "children": [{"name": "b", "range": {"start": {"line": 2}, "end": {"line": 3}}}]}]'
    flat = extract.flatten_symbols(spark.createDataFrame([(1, tree)], "k int, j string"), "k", "j").collect()
    assert sorted((r["name"], r["depth"], r["detail"]) for r in flat) == [("A", 0, "d1"), ("b", 1, None)]


def test_sources_and_sinks(spark, tmp_path):
    repo = tmp_path / "repo"
    for p, t in {"lib/a.dart": "class A {}\n", "lib/b.g.dart": "x", "node_modules/c.js": "x", "big.py": "x" * 3000, "docs/r.md": "words"}.items():
        (repo / p).parent.mkdir(parents=True, exist_ok=True)
        (repo / p).write_text(t)
    found = {r["path"].split("/repo/")[1]: r for r in sources.scan_repo(spark, str(repo), ignore=["**/docs/**"], max_bytes=2000).collect()}
    assert set(found) == {"lib/a.dart", "lib/b.g.dart"} and found["lib/b.g.dart"]["is_generated"] and found["lib/a.dart"]["language"] == "dart"
    names = spark.createDataFrame([(p,) for p in ("lib/a.dart", "lib/a.g.dart", "build/x.dart", "a.exe", "pubspec.yaml")], "path string")
    assert {r["path"] for r in sources.scan_project(names).collect()} == {"lib/a.dart", "pubspec.yaml"}
    strict, loose = tmp_path / "s.jsonl", tmp_path / "l.jsonl"
    strict.write_text('{"id": "1", "text": "t"}\n\n{"id": "2", "text": "u", "embedding": [1, 2]}\n')
    loose.write_text('{"uuid": "1", "code": "t", "file": "f", "vector": [1, "x"]}\noops\n{"kind": "Import", "name": "n"}\n{"kind": "Class", "fqn": "a::B"}\n')
    assert sources.read_strict_or_fallback(spark, str(strict)).count() == 2
    got = sorted((r["id"][:4], r["text"], r["source"], r["embedding"]) for r in sources.read_strict_or_fallback(spark, str(loose)).collect())
    assert got == [("1", "t", "f", [1.0]), ("rec_", "Class a::B", None, None)]
    bad = tmp_path / "b.jsonl"
    bad.write_text('{"id": "1"}\n')
    with pytest.raises(Exception, match="without text"):
        sources.read_strict(spark, str(bad)).collect()
    for d in ("20240101_000000", "20250101_000000"):
        (tmp_path / "dumps" / d).mkdir(parents=True)
    assert sources.latest_dump(spark, str(tmp_path / "dumps")).endswith("20250101_000000")
    nodes = spark.createDataFrame([("n1", "a", "x<y", "file"), ("n2", "b", "z", "class")], "id string, file string, name string, kind string")
    edges = spark.createDataFrame([("n1", "n2", "declares")], "src string, dst string, label string")
    sources.write_graph_jsonl(nodes, edges, str(tmp_path / "g"))
    e = spark.read.json(str(tmp_path / "g/edges")).first()
    assert (e["from"], e["to"]) == (0, 1)
    numbered = spark.read.json(str(tmp_path / "g/nodes")).withColumn("language", F.lit("dart")).withColumn("fqn", F.col("name"))
    sources.write_graphml(numbered, spark.read.json(str(tmp_path / "g/edges")), str(tmp_path / "x"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "x")).collect()]
    assert lines[0].startswith("<?xml") and lines[-1] == "</graphml>" and any("x&lt;y" in x for x in lines)
    t = str(tmp_path / "t")
    sources.upsert(spark.createDataFrame([("1", "a"), ("2", "b")], "id string, text string"), t)
    sources.upsert(spark.createDataFrame([("2", "c"), ("3", "d")], "id string, text string"), t)
    assert sorted(map(tuple, spark.read.parquet(t).collect())) == [("1", "a"), ("2", "c"), ("3", "d")]


def test_stream_upserts_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"id": "1", "body": "x"}\nbroken\n')
    table, check = str(tmp_path / "t"), str(tmp_path / "c")
    jsonl.upsert_stream(jsonl.record_stream(spark, str(folder)), table, check).awaitTermination()
    (folder / "b.jsonl").write_text('{"id": "1", "body": "y"}\n{"id": "2", "body": "z"}\n')
    for _ in range(2):
        jsonl.upsert_stream(jsonl.record_stream(spark, str(folder)), table, check).awaitTermination()
    assert sorted((r["id"], r["text"]) for r in spark.read.parquet(table).collect()) == [("1", "y"), ("2", "z")]


def test_embedding_provider(spark):
    rows = spark.createDataFrame([("a b a", None), ("c", [1.0, 2.0])], "text string, embedding array<float>")
    got = {r["text"]: r["embedding"] for r in records.embed_missing(rows, records.hashing_embedder(8)).collect()}
    assert sum(got["a b a"]) == 3 and got["c"] == [1.0, 2.0]
    always = records.embed_missing(rows, records.hashing_embedder(8), "provider_only").filter("text = 'c'").first()
    assert sum(always["embedding"]) == 1 and ids.SIMHASH_BITS == 64


def test_plans_push_down_and_do_not_shuffle(spark, sf_dir):
    plan = retrieval.vector_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), [1.0] * 64, 5, id_col="vec_id", where=F.col("label") == 3).select("vec_id", "score")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan and "EqualTo(label,3)" in plan


def test_context(spark):
    from codestrata.operators import context as K

    text = "import 'a';\nvoid f() {\n  g(); g(); h();\n  return 1;\n  x.dispose();\n}\n" + "\n".join(f"l{i}" for i in range(60))
    files = spark.createDataFrame([("a.dart", text)], "path string, text string")
    targets = spark.createDataFrame([(1, "a.dart", 3, 3, 3), (2, "a.dart", 50, 51, 50)], "target_id int, path string, start int, end int, line int")
    spans = spark.createDataFrame([(7, "a.dart", 2, 6)], "span_id int, path string, start int, end int")
    p = {r["target_id"]: r for r in K.primary_context(targets, files, 5).collect()}
    assert p[1]["full_text"] == text and p[2]["full_text"] is None and p[2]["window"].split("\n")[0] == "    45 | l38" and p[1]["allowed"][0]["start"] == 1
    f = {r["target_id"]: r for r in K.code_facts(targets.select("target_id", "path", "line"), files, spans).collect()}
    assert f[1]["calls"][0] == "g" and f[1]["returns"] == ["return 1"] and f[1]["cleanup"] == ["dispose"] and f[2]["scope_end"] == 130
    b = {r["target_id"]: (r["start"], r["end"]) for r in K.enclosing_body(targets.select("target_id", "path", "line"), files, spans).collect()}
    assert b == {1: (2, 6), 2: (None, None)}
    msg = '{"params": {"uri": "file:///w/r/a.dart", "diagnostics": [{"severity": 1, "range": {"start": {"line": 4}}}, {"severity": 2}]}}'
    out = '{"params": {"uri": "file:///other/b.dart", "diagnostics": [{"severity": 1}]}}'
    d = K.decode_diagnostics(spark.createDataFrame([(msg,), (out,), ("{",)], "j string"), "j", "/w/r")
    assert sorted(map(tuple, d.collect()), key=str) == [("a.dart", 1, 4), ("a.dart", 2, None)]
    chunks = spark.createDataFrame([(1, "a.dart", "class", "A", 1, 9), (2, "z.dart", "class", "Z", 1, 2)], "chunk_id int, file string, kind string, symbol_path string, start int, end int")
    e = {r["chunk_id"]: r for r in K.enrich_chunks(chunks, spark.createDataFrame([(5, "a.dart", 2, 4)], "symbol_id int, file string, start int, end int"), d, spark.createDataFrame([(5, "```\nint x\n```")], "symbol_id int, text string"), spark.createDataFrame([(5, "b", i) for i in range(40)], "symbol_id int, file string, line int")).collect()}
    assert (e[1]["symbol_id"], e[1]["errors"], e[1]["warnings"], e[1]["hover"], e[1]["n_references"], len(e[1]["references"])) == (5, 1, 1, "int x", 40, 32) and e[2]["n_references"] == 0 and e[1]["fqn"] == "a.dart::A"
    rows = spark.createDataFrame([("1", "a/b.dart", "class", "B", "class B", "Doc.\nMore", "class B { go('/x'); }", ["z", "a"], [], ["kw"])], "id string, file string, kind string, symbol_path string, signature string, doc string, snippet string, imports array<string>, routes array<string>, keywords array<string>")
    r = K.index_rows(rows).first()
    assert r["embed_text"].startswith("dart | class | a/b.dart\nSignature: class B\nDoc: Doc.\nImports: a, z\nRoutes: /x") and "kw" in r["search_terms"] and r["search_blob"].startswith("a/b.dart\nB\n")
    h = spark.createDataFrame([('```json\n{"queries": ["q"]}\n```',), ("no",)], "a string").select(K.context_hints(F.col("a")).alias("h")).collect()
    assert h[0]["h"]["queries"] == ["q"] and h[1]["h"]["need_paths_like"] == []
    rep = K.review_report(targets, spark.createDataFrame([(1, True), (None, False)], "start int, escalated boolean")).first()
    assert (rep["targets"], rep["drafts"], rep["escalated"], rep["without_anchor"]) == (2, 2, 1, 1)


def test_interval_joins_against_brute_force(spark):
    """Repeated places, empty spans, negative lines and null files; results are those of all pairs."""
    import random

    rng = random.Random(3)
    spans = [(i, rng.choice([None, 0, 0, 1]), s := rng.randint(-70, 200), s + rng.choice([-1, 0, 0, 3, 40, 130])) for i in range(300)]
    spans += [(1000 + i, 0, 10, 20) for i in range(20)]
    points = [(i, rng.choice([None, 0, 1]), rng.randint(-80, 330)) for i in range(200)]
    s = spark.createDataFrame(spans, "span_id int, file int, start int, end int")
    p = spark.createDataFrame(points, "p int, file int, line int")
    inside = lambda f, n: [x for x in spans if f is not None and x[1] == f and x[2] <= n <= x[3]]
    got = {r["p"]: r["span_id"] for r in intervals.smallest_enclosing(p, s, "file", "line", "p").collect()}
    assert got == {i: min(((x[3] - x[2], x[2], x[0]) for x in inside(f, n)), default=(None,))[-1] for i, f, n in points}
    got = {r["range_id"]: r["line"] for r in intervals.first_in_range(p, s.withColumnRenamed("span_id", "range_id"), "file").collect()}
    assert got == {x[0]: min((n for _, f, n in points if f is not None and f == x[1] and x[2] <= n <= x[3]), default=None) for x in spans}
    by_path = s.withColumnRenamed("file", "path")
    got = sorted((r["target_id"], r["ord"], r["span_id"]) for r in intervals.siblings(by_path, by_path).collect())
    held = lambda t: sorted((x[2], x[0]) for x in spans if t[1] is not None and x[1] == t[1] and t[2] <= x[2] and x[3] <= t[3] and x[0] != t[0] and t[2] <= t[3])[:12]
    assert got == sorted((t[0], i + 1, x[1]) for t in spans if t[2] <= t[3] for i, x in enumerate(held(t)))


def test_interval_joins_meet_each_place_once(spark):
    """Many rows in few places of one file: what the joins put out is bounded by the places, not by pairs of rows."""
    from pyspark.sql import functions as F

    s = spark.range(20_000).select(F.col("id").alias("span_id"), F.lit(0).alias("file"), (F.col("id") % 5).cast("int").alias("start"), (F.col("id") % 5 + 3).cast("int").alias("end"))
    p = spark.range(100_000).select(F.col("id").alias("p"), F.lit(0).alias("file"), (F.col("id") % 9).cast("int").alias("line"))
    got = intervals.smallest_enclosing(p, s, "file", "line", "p").groupBy("line", "span_id").count().collect()
    assert {r["line"]: r["span_id"] for r in got} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 2, 6: 3, 7: 4, 8: None}
    by_path = s.withColumnRenamed("file", "path")
    got = intervals.siblings(by_path, by_path).filter("target_id = 7").orderBy("ord").collect()
    assert [r["span_id"] for r in got] == [2, *range(12, 67, 5)]
    got = intervals.first_in_range(p, s.withColumnRenamed("span_id", "range_id"), "file").groupBy("line").count().collect()
    assert {r["line"]: r["count"] for r in got} == {i: 4000 for i in range(5)}
    chunks = spark.range(5_000).select(F.col("id").alias("chunk_id"), F.lit(0).alias("file"), (F.col("id") % 2 * 20).cast("int").alias("start"), (F.col("id") % 2 * 20 + 2).cast("int").alias("end"))
    got = intervals.best_overlap(chunks, s.withColumnRenamed("span_id", "symbol_id"), "file").groupBy("symbol_id", "overlap", "gap").count().collect()
    assert {tuple(r) for r in got} == {(0, 2, 0, 2500), (4, 0, 13, 2500)}


def test_expanded_neighbours_are_those_of_all_pairs_without_rows_for_pairs(spark):
    """Copies, null and zero vectors, null sources and several lengths: results of all pairs, by a plan that joins nothing."""
    import random

    rng = random.Random(4)
    vectors = [[round(rng.gauss(0, 1), 1) for _ in range(3)] for _ in range(30)] + [[0.0] * 3, None, [1.0, 2.0], []]
    rows = [(i, rng.choice(["a", "b", None]), f"f{i % 40}", f"t{i % 50}", rng.choice(vectors)) for i in range(300)]
    index = spark.createDataFrame(rows, "id long, source string, fqn string, text string, embedding array<float>")
    selected = index.filter("id % 7 = 0").selectExpr("*", "0.5D as score")
    got = retrieval.expand_neighbors(selected, index, 4, 0.0, 60)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()

    def cosine(a, b):
        n = min(len(a or []), len(b or []))
        x, y = (a or [])[:n], (b or [])[:n]
        size = sum(v * v for v in x) ** 0.5 * (sum(v * v for v in y) ** 0.5)
        return round(sum(v * w for v, w in zip(x, y, strict=True)) / size, 6) if size > 0 else 0.0

    held = [tuple(r) for r in index.collect()]
    every = [(0.5, i, s, f, t) for i, s, f, t, _ in held if i % 7 == 0]
    for i, s, *_, v in held:
        if i % 7 == 0 and s is not None:
            every += sorted(((cosine(v, w), j, s, f, t) for j, o, f, t, w in held if o == s and j != i), key=lambda x: (-x[0], x[1]))[:4]
    once = {}
    for e in sorted(every, key=lambda x: (-x[0], x[1])):
        once.setdefault(e[2:], e)
    want = sorted(once.values(), key=lambda x: (-x[0], x[1]))[:120]
    assert [(r["id"], r["score"]) for r in got.collect()] == [(e[1], e[0]) for e in want]


def test_a_neighbourhood_walk_moves_pairs_of_ids(spark):
    """One window, over the scored rows; steps are distinct pairs, and a node that two ways lead to counts once, where it is met first."""
    nodes = spark.createDataFrame([("f1", "file", "a", "a::"), ("f2", "file", "b", "b::"), ("m1", "method", "a", "a::m1"), ("m2", "method", "a", "a::m2"), ("m3", "method", "b", "b::m3")], "id string, kind string, file string, fqn string")
    edges = spark.createDataFrame([("f1", "m1", "declares"), ("f1", "m2", "declares"), ("f2", "m3", "declares"), ("f1", "f2", "imports"), ("f1", "f2", "exports"), ("f1", "f2", "imports")], "src string, dst string, label string")
    records = nodes.selectExpr("id", "id as node", "file", "kind", "file || '::' as owner")
    out = graph.neighbours(records, nodes, edges)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1
    assert "_allowed" not in plan
    got = {(r["rec"], r["nbr"]): (r["label"], r["hop"], r["rank"]) for r in out.collect()}
    assert {n: v for (rec, n), v in got.items() if rec == "f1"} == {"m1": ("declares", 0, 1), "m2": ("declares", 0, 2), "m3": ("declares", 1, 3), "f2": ("exports", 0, 4)}
    assert {n: v[1] for (rec, n), v in got.items() if rec == "m1"} == {"f1": 0, "m2": 1}


def test_pairs_of_neighbours_move_once(spark):
    """Scores are made with the pairs and no pair is held against all others; hops through classes that declare and through nodes that are missing count."""
    from codestrata.operators import graph

    files = {"f": "a", "c": "a", "m": "a", "n": "a", "g": "b", "h": "b", "x": "b"}
    nodes = spark.createDataFrame([(i, f, f"{f}::{i}") for i, f in files.items()], "id string, file string, fqn string")
    declares = [("f", "c"), ("c", "m"), ("c", "n"), ("g", "h"), ("g", "gone"), ("gone", "x")]
    edges = spark.createDataFrame([*((a, b, "declares") for a, b in declares), ("f", "g", "imports"), ("g", "f", "imports"), ("f", "f", "calls")], "src string, dst string, label string")
    records = spark.createDataFrame([("f", "f", "a", "file", "a::"), ("m", "m", "a", "method", "a::")], "id string, node string, file string, kind string, owner string")
    out = graph.neighbours(records, nodes, edges)
    assert "LeftAnti" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["rec"], r["nbr"]): (r["label"], r["hop"], r["score"], r["rank"]) for r in out.collect()}
    assert {k[1]: v[1] for k, v in got.items() if k[0] == "f"} == {"c": 0, "g": 0, "m": 1, "n": 1, "h": 1, "x": 2}
    assert {k[1]: v[1] for k, v in got.items() if k[0] == "m"} == {"c": 0, "n": 1, "f": 1}
    assert got["f", "c"][0] == "declares" and got["f", "g"][0] == "imports" and got["f", "x"][0] == "declares" and got["f", "c"][3] == 1
    assert {len(graph.neighbours(records, nodes, edges, hops=h).collect()) for h in (0, 1)} == {3, 8}
