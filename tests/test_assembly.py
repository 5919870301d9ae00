"""Whole paths: retrieval against a Python version, spans, configuration, points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.functions import spans
from codestrata.operators import assembly as A
from codestrata.plans import assembly_queries as Q
from codestrata.plans import registry
from codestrata.sources import files


def greedy(scored, vectors, query, n, weight):
    """Relevance against the least similarity to what is chosen, written out in numpy; the later of equal gains wins."""
    cos = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
    pool, chosen = [i for i, _ in scored[: 3 * n]], []
    score = dict(scored)
    while pool and len(chosen) < n:
        gains = [weight * cos(query, vectors[i]) + (1 - weight) * (1 - (min(cos(vectors[i], vectors[c]) for c in chosen) if chosen else 0)) + 0.001 * score[i] for i in pool]
        best = max(range(len(pool)), key=lambda j: (gains[j], j))
        chosen.append(pool.pop(best))
    return chosen


def test_retrieval_with_context(spark, sf_dir):
    points = Q._points(spark, sf_dir)
    probe = Q._probe(spark, sf_dir)
    rows = {r["id"]: r for r in A.payload_to_hit(points).collect()}
    vectors = {i: np.array(r["vector"], dtype=np.float64) for i, r in rows.items()}
    q = np.array(probe)
    scored = sorted(((i, round(float(v @ q / np.linalg.norm(v) / np.linalg.norm(q)), 6)) for i, v in vectors.items()), key=lambda x: (-x[1], x[0]))
    plain = A.retrieve(points, probe, A.RetrievalConfig(top_k=40, context_k=8, expand_neighbors=False)).collect()
    by_point = sorted(((r["point_id"], r["score"], r["id"]) for r in A.rag_context(points, probe, 40).collect()), key=lambda x: (-x[1], x[2]))
    want = greedy([(i, s) for _, s, i in by_point], vectors, q, 8, 0.7)
    assert {r["id"] for r in plain} == set(want) and [r["score"] for r in plain] == sorted((r["score"] for r in plain), reverse=True)
    assert {(r["id"], r["score"]) for r in plain} <= set(scored[:40])
    more = registry.queries()["retrieve_context"](spark, sf_dir).collect()
    assert len(more) <= 16 and all(rows[r["id"]]["source"] == r["source"] for r in more)
    sources = {rows[i]["source"] for i in want}
    assert {r["source"] for r in more} <= sources
    assert A.retrieve(points.limit(0), probe).count() == 0


def test_spans(spark):
    text = "aé\nbb\nccc\ndd\n"
    df = spark.createDataFrame([(text, 1, 3), (text, 4, 6), (text, 0, 99), (text, 9, 2), (text, 50, 60)], "t string, a long, b long")
    s = spans.span(F.lit(0).cast("long"), F.lit(0).cast("long"), F.col("a"), F.col("b"))
    got = [tuple(r) for r in df.select(spans.slice_text(F.col("t"), s), spans.slice_with_context(F.col("t"), s, 0), spans.slice_with_context(F.col("t"), s, 1)).collect()]
    assert [g[0] for g in got] == ["é", "bb", text, "", ""] and all(g[0] == g[1] for g in got)
    assert got[0][2] == "aé\nbb" and got[1][2] == "aé\nbb\nccc" and got[2][2] == text
    assert [r[0] for r in spark.createDataFrame([("TypeAlias",), ("Class",), ("IO",)], "k string").select(spans.snake(F.col("k"))).collect()] == ["type_alias", "class", "io"]


def test_configuration():
    c = A.RetrievalConfig.from_env({"INITIAL_TOP_K": "30", "MMR_LAMBDA": "0.5", "EXPAND_NEIGHBORS": "false", "CONTEXT_K": "many"})
    assert (c.top_k, c.mmr_lambda, c.expand_neighbors, c.context_k) == (30, 0.5, False, 6)
    with pytest.raises(ValueError):
        A.RetrievalConfig.from_env({"MMR_LAMBDA": "2"})


def test_points(spark):
    kind = "id string, text string, source string, embedding array<float>, extra string"
    rows = spark.createDataFrame([("a", "t", None, None, '{"path": "p", "code": "x\\n", "tags": ["u", "v"], "metrics": {"loc": 3}, "kind": 7}'), ("b", "tt", "s", [1.0, 2.0], None), ("c", "t", "s", [3.0, 4.0], "no json")], kind)
    provider = lambda t: F.array(F.char_length(t).cast("float"), F.lit(0.0).cast("float"))
    got = {r["payload"]["eid"]: r for r in A.build_points(rows, 2, provider).collect()}
    p = got["a"]["payload"]
    assert (p["source"], p["tags"], p["metrics"], p["kind"], p["neighbors"]) == ("p", ["u", "v"], '{"loc":3}', None, None) and got["a"]["vector"] == [1.0, 0.0] and got["b"]["vector"] == [1.0, 2.0]
    assert [r["vector"] for r in A.build_points(rows, 2, provider, "provider_only").orderBy("payload.eid").collect()] == [[1.0, 0.0], [2.0, 0.0], [1.0, 0.0]]
    assert got["a"]["point_id"] == __import__("uuid").uuid5(__import__("uuid").NAMESPACE_URL, "a").__str__()
    with pytest.raises(Exception, match="vector of length 3"):
        A.build_points(rows, 3, provider).collect()


def test_related_queries_blocks_and_prompts(spark):
    t = spark.createDataFrame([("short", "a.dart"), ("a preview of more than 24 bytes", "a.dart"), ("x", None), (None, "b")], "p string, f string")
    assert [r[0] for r in t.select(A.related_query(F.col("p"), F.col("f"))).collect()] == ["context for a.dart", "a preview of more than 24 bytes", None, "context for b"]
    hits = spark.createDataFrame([("s", "x", 0.5), (None, None, 0.9)], "source string, snippet string, score double")
    assert [r["block"] for r in A.prompt_blocks(hits, [F.desc("score")]).orderBy("n").collect()] == ["[1] <unknown>\n", "[2] s\nx"]


def test_dumps(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x")], "id string, text string")
    paths = files.persist_all({"nodes": rows, "edges": rows.limit(0)}, str(tmp_path), "2026")
    assert spark.read.json(paths["nodes"]).count() == 1 and files.latest_dump(spark, str(tmp_path)).endswith("2026")
    assert sorted((r["name"], r["n_records"]) for r in files.read_summary(spark, f"{tmp_path}/2026/summary").collect()) == [("edges", 0), ("nodes", 1)]
    assert spark.read.json(files.dump_rows(rows, str(tmp_path), "prompts", "t1")).count() == 1 and files.ingest_latest(spark, f"{tmp_path}/none", "x") is None
