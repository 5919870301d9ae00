"""Bucketed tables, the review host's source, the cache of change sets, packages, locations, rules and searches for many vectors."""

import json
import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.operators import assembly as A
from codestrata.operators import locations as L
from codestrata.operators import packages as K
from codestrata.operators import rules as U
from codestrata.operators import search_many as M
from codestrata.sources import review_host as H
from codestrata.sources.bucketed import BucketedTable, WriteConflict, points_upsert


def _bytes(table):
    m = table.manifest()
    return {b: {p.name: p.read_bytes() for p in Path(table.path, f).iterdir()} for b, f in m["folders"].items()}


@pytest.fixture
def table(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path / "t"))
    t.upsert(spark.createDataFrame([(f"k{i}", i) for i in range(200)] + [(None, -1)], "id string, v int"), buckets=8)
    return t


def test_an_upsert_rewrites_the_touched_buckets_only(spark, table):
    before = _bytes(table)
    assert len(before) == 8
    assert table.upsert(spark.createDataFrame([("k3", 1000), ("k3", 999), ("new", 5), (None, 7)], "id string, v int"), order=F.col("v")) == 2
    got = {r["id"]: r["v"] for r in table.read().collect()}
    assert len(got) == 202 and got["k3"] == 1000 and got["new"] == 5 and got[None] == 7 and got["k4"] == 4
    after = _bytes(table)
    changed = {b for b in after if after[b] != before[b]}
    assert 1 <= len(changed) <= 3  # three keys
    assert {r["v"] for r in table.read(1).filter("id = 'k3'").collect()} == {3}  # an older version stays readable
    assert [r["v"] for r in table.lookup(["k3"]).collect()] == [1000] and table.lookup([None]).count() == 1


def test_what_is_written_but_not_published_is_never_read(spark, table, monkeypatch):
    before = _bytes(table)

    def crash(manifest):
        raise OSError("lost")

    monkeypatch.setattr(table, "_publish", crash)
    with pytest.raises(OSError):
        table.upsert(spark.createDataFrame([("k1", 0)], "id string, v int"))
    monkeypatch.undo()
    assert _bytes(table) == before and {r["v"] for r in table.lookup(["k1"]).collect()} == {1}
    assert table.vacuum() == 1 and _bytes(table) == before  # the folder of the lost write


def test_two_writers_of_one_version(spark, table):
    stale = table.manifest()
    table.upsert(spark.createDataFrame([("k1", 11)], "id string, v int"))
    with pytest.raises(WriteConflict):
        table._publish(stale | {"version": stale["version"] + 1})
    assert {r["v"] for r in table.lookup(["k1"]).collect()} == {11}


def test_batches_columns_and_versions(spark, table):
    rows = spark.createDataFrame([("k1", 5, "x")], "id string, v int, w string")
    assert table.upsert(rows, batch_id="b1") == 2 and table.upsert(rows.withColumn("v", F.lit(6)), batch_id="b1") is None
    assert table.upsert(rows.limit(0)) is None
    got = {r["id"]: r for r in table.read().collect()}
    assert got["k1"]["w"] == "x" and got["k1"]["v"] == 5 and got["k2"]["w"] is None
    table.upsert(rows.withColumn("v", F.lit(8)))
    assert table.vacuum(keep=1) >= 1 and table.read().count() == 201
    with pytest.raises(ValueError, match="vector length 2 is not 3"):
        points_upsert(table, spark.createDataFrame([("a", [1.0, 2.0])], "id string, vector array<double>"), 3)


def test_streams_go_into_buckets(spark, tmp_path):
    from codestrata.streaming.jsonl import record_stream, upsert_bucketed_stream

    for name, rows in (("a", [{"id": "1", "snippet": "x"}, {"id": "2", "snippet": "y"}]), ("b", [{"id": "2", "snippet": "z"}])):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n{bad\n")
        upsert_bucketed_stream(record_stream(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    got = BucketedTable(spark, str(tmp_path / "t"))
    assert {r["id"]: r["text"] for r in got.read().collect()} == {"1": "x", "2": "z"} and len(got.manifest()["batches"]) == 2


def _answer(folder, project, kind, *answers):
    at = folder / f"project={project}" / f"kind={kind}"
    at.mkdir(parents=True, exist_ok=True)
    with (at / f"{len(list(at.iterdir()))}.jsonl").open("w") as f:
        f.writelines(json.dumps(a) + "\n" for a in answers)


def test_review_host(spark, tmp_path):
    _answer(tmp_path, "g%2Fp", "diffs", {"iid": 1, "page": 1, "body": [{"old_path": "a", "new_path": "b", "new_file": True, "diff": "@@ -1 +1 @@\n+x", "generated_file": True}, {"old_path": "c", "new_path": "c", "diff": None}]}, {"iid": 2, "page": 1, "status": 500})
    _answer(tmp_path, "g%2Fp", "diffs", {"iid": 1, "page": 2, "body": [{"old_path": "d", "new_path": "d", "deleted_file": True, "diff": "Binary files a and b differ"}]})
    _answer(tmp_path, "q", "meta", {"iid": 7, "body": {"title": "t", "author": {"username": "u"}, "diff_refs": {"head_sha": "h"}}})
    _answer(tmp_path, "q", "raw", {"iid": 7, "ref": "h", "path": "x", "body": "eA=="}, {"iid": 7, "ref": "h", "path": "y", "status": 404})
    root = tmp_path.as_uri()
    c = H.changes(H.read_host(spark, root, "diffs")).orderBy("page", "ord").collect()
    assert [(r["project"], r["new_path"], r["is_new"], r["is_deleted"], r["is_binary"], r["is_truncated"]) for r in c] == [("g/p", "b", True, False, False, True), ("g/p", "c", False, False, True, False), ("g/p", "d", False, True, True, False)]
    assert H.read_host(spark, root, "diffs").rdd.getNumPartitions() == 2 and H.read_host(spark, root, "diffs", iid=2).count() == 0 and H.read_host(spark, root, "diffs", project="q").count() == 0
    m = H.read_host(spark, root, "meta").first()
    assert (m["project"], m["iid"], m["title"], m["author"], m["head_sha"], m["description"]) == ("q", 7, "t", "u", "h", None)
    wanted = spark.createDataFrame([("q", "h", "x"), ("q", "h", "y"), ("q", "h", "z")], "project string, ref string, path string")
    assert {r["path"]: r["content"] and bytes(r["content"]) for r in H.files_at(wanted, H.read_host(spark, root, "raw")).collect()} == {"x": b"x", "y": None, "z": None}


def test_a_second_call_reads_no_diff(spark, tmp_path):
    cache, calls = BucketedTable(spark, str(tmp_path / "cache"), "key"), []
    diffs = spark.createDataFrame([("p", i, 0, j, "d" * 10, i == 3) for i in (1, 2, 3) for j in range(1 + 3 * (i == 2))], "project string, iid long, page int, ord int, raw_unidiff string, is_truncated boolean")

    def fetch(missing):
        calls.append(sorted(r["iid"] for r in missing.collect()))
        return diffs.join(missing.select("iid"), "iid", "left_semi")

    ask = lambda *pairs: H.cached_bundles(cache, spark.createDataFrame([("p", i, s) for i, s in pairs], "project string, iid long, head_sha string"), fetch, most_files=3)
    first = {r["iid"]: r for r in ask((1, "a"), (2, "a"), (3, "a")).collect()}
    assert not any(r["from_cache"] for r in first.values()) and len(first[2]["files"]) == 4
    again = ask((2, "a"), (3, "a"))
    assert {r["iid"]: r["from_cache"] for r in again.collect()} == {2: True, 3: True} and calls == [[1, 2, 3]]  # large, and cut short
    plan = again._jdf.queryExecution().toString()
    assert "fetched" not in plan and "ExistingRDD" not in plan.split("== Physical Plan ==")[-1].replace("Scan ExistingRDD[project", "")
    assert {r["iid"]: r["from_cache"] for r in ask((1, "a"), (2, "b")).collect()} == {1: False, 2: False} and calls[-1] == [1, 2]  # too small; another head


def test_packages(spark, tmp_path):
    files = spark.createDataFrame([
        ("pubspec.yaml", "name: app\n\ndependencies:\n  flutter:\n    sdk: flutter\n  core:\n    path: packages/core\n  'lib_x': { path: \"/abs/x\", version: 1 }\n"),
        ("packages/core/pubspec.yaml", "name: core  # note\ndev_dependencies:\n    util:\n        path: ../util\n        url: x\n    app:\n        path: ../..\n"),
        ("packages/bad/pubspec.yaml", ": : :\n\t\n"), ("packages/none/pubspec.yaml", None), ("other.yaml", "name: no\n"),
    ], "path string, text string")
    specs = K.specifications(files)
    got = {r["dir"]: (r["name"], [tuple(x) for x in r["deps"]]) for r in specs.collect()}
    assert got[""] == ("app", [("core", "packages/core"), ("lib_x", "/abs/x")]) and got["packages/core"] == ("core", [("util", "../util"), ("app", "../..")])
    packages = K.registry(specs)
    assert {r["name"]: r["dir"] for r in packages.collect()} == {"app": "", "core": "packages/core", "lib_x": "/abs/x", "util": "packages/util"}
    pairs = K.reachable(specs, str(tmp_path))
    assert {tuple(r) for r in pairs.collect()} == {("app", "core"), ("app", "lib_x"), ("app", "util"), ("app", "app"), ("core", "util"), ("core", "app"), ("core", "core"), ("core", "lib_x")}
    uses = spark.createDataFrame([("packages/core/lib/a.dart", "package:util/src/u.dart"), ("lib/m.dart", "package:app/x.dart"), ("packages/util/lib/u.dart", "package:core/c.dart"), ("lib/m.dart", "package:gone/x.dart"), ("lib/m.dart", "n.dart"), ("lib/m.dart", "dart:io")], "path string, uri string")
    out = {(r["path"], r["uri"]): (r["target"], r["declared"]) for r in K.resolve(uses, packages, pairs).collect()}
    assert out["packages/core/lib/a.dart", "package:util/src/u.dart"] == ("packages/util/lib/src/u.dart", True) and out["lib/m.dart", "package:app/x.dart"] == ("lib/x.dart", True)
    assert out["packages/util/lib/u.dart", "package:core/c.dart"] == ("packages/core/lib/c.dart", False) and out["lib/m.dart", "package:gone/x.dart"] == (None, False)
    assert out["lib/m.dart", "n.dart"] == ("lib/n.dart", None) and out["lib/m.dart", "dart:io"] == (None, None)


def test_locations(spark):
    at = lambda a, b, c, d: {"start": {"line": a, "character": b}, "end": {"line": c, "character": d}}
    answers = [(1, json.dumps([{"uri": "file:///r/app/a.dart", "range": at(1, 3, 1, 99)}, {"targetUri": "dart:core", "targetRange": at(0, 0, 0, 1)}])), (2, json.dumps({"targetUri": "file:///x/flutter/packages/f.dart", "targetRange": {"start": {"line": 1}}})), (3, "not json"), (4, "[]"), (5, None), (6, json.dumps([{"x": 1}] + [{"uri": "package:p/q.dart"}] * 40))]
    found = L.parse(spark.createDataFrame(answers, "k int, j string"), "k", "j", F.lit("/r/app"))
    files = spark.createDataFrame([("app/a.dart", "é\n😀xyz\nlast")], "path string, text string")
    rows = L.with_bytes(found, files)
    chunks = spark.createDataFrame([("app/a.dart", "outer", 0, 9), ("app/a.dart", "inner", 1, 1)], "path string, chunk_id string, start_row int, end_row int")
    d = {r["k"]: r for r in L.definitions(rows, "k", chunks).collect()}
    assert (d[1]["target"], d[1]["start_byte"], d[1]["end_byte"], d[1]["chunk_id"]) == ("app/a.dart", 3 + 5, 3 + 7, "inner")
    assert (d[2]["target"], d[2]["origin"], d[2]["start_row"], d[2]["chunk_id"]) == ("flutter_sdk/packages/f.dart", "local", None, None) and set(d) == {1, 2, 6}
    refs = {r["k"]: (r["references_count"], len(r["references_sample"])) for r in L.references(rows, "k").collect()}
    assert refs == {1: (2, 2), 2: (1, 1), 6: (40, 32)}


def test_rules(spark, tmp_path):
    for name, text in {"global/b.md": "B", "global/a b.md": "A", "global/skip.txt": "no", "dart/x.md": "X", "rust/empty.md": " \n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    paths = spark.createDataFrame([("lib/x.DART",), ("a.rs",), ("",), (None,), ("dart",)], "path string")
    rules = U.read_rules(spark, str(tmp_path))
    everywhere = "## Global rules\n\n### a b.md\n\nA\n\n### b.md\n\nB\n\n"
    got = {r["path"]: r["rules"] for r in U.compose(paths, rules).collect()}
    assert got["lib/x.DART"] == everywhere + "\n\n---\n\n## Language rules (dart)\n\n### x.md\n\nX\n\n" and got[""] == got[None] == got["dart"] == everywhere
    assert "rust" not in got["a.rs"] or got["a.rs"].startswith(everywhere)
    assert {r["rules"] for r in U.compose(paths, rules, len(everywhere)).collect()} == {everywhere} and {r["rules"] for r in U.compose(paths, rules, 5).collect()} == {""}


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclid"])
def test_search_many_against_brute_force(spark, metric):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 8)), 2)
    x[100:200] = x[0]  # copies
    index = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)] + [("null", None), ("short", [1.0])], "id string, embedding array<double>")
    q = spark.createDataFrame([(f"q{i}", x[i].tolist()) for i in range(0, 300, 7)], "query_id string, embedding array<double>")
    got = {}
    for r in M.search_many(index, q, 5, metric, group=10, block=40).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    for i in range(0, 300, 7):
        if metric == "euclid":
            s = {str(j): math.dist(x[i], v) for j, v in enumerate(x)}
        else:
            norm = (lambda a, b: np.linalg.norm(a) * np.linalg.norm(b)) if metric == "cosine" else (lambda a, b: 1.0)
            s = {str(j): -float(x[i] @ v) / norm(x[i], v) for j, v in enumerate(x)}
        want = sorted((round(v, 6), j) for j, v in s.items())[:5]
        assert [j for j, _ in got[f"q{i}"]] == [j for _, j in want]
    assert M.search_many(index, q.limit(0), 5).count() == 0 and M.search_many(index.limit(0), q, 5).count() == 0


def test_symbol_facts_take_the_nearest_on_both_sides(spark):
    symbols = [("a", "m" if i % 3 else f"n{i}", "class", i // 2 * 2) for i in range(60)] + [("b", "x", "class", 1)]
    targets = [(f"t{i}", "a", i) for i in (-5, 0, 7, 8, 31, 58, 90)] + [("tb", "b", 9), ("tc", "c", 1)]
    s = spark.createDataFrame(symbols, "path string, name string, kind string, start int")
    t = spark.createDataFrame(targets, "target_id string, path string, line int")
    got = {r["target_id"]: r["text"] for r in A.symbol_facts(t, s, 5).collect()}
    for key, path, line in targets:
        near = sorted((abs(at - line), at, name) for p, name, _, at in symbols if p == path)[:5]
        assert got.get(key) == ("\n".join(f"class {n} @{at}" for _, at, n in near) or None)
