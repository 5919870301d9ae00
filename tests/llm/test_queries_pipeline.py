import random

import duckdb
import pytest

import corpus_pipeline
from codestrata.llm import decontaminate as D
from codestrata.llm import near_dedup as N
from codestrata.llm import queries
from codestrata.llm.words import PLAIN, WordHashes


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    o = c.sql(queries.oracle_sql()[name])
    assert sorted(o.columns) == sorted(df.columns)
    assert sorted(tuple(r[x] for x in sorted(df.columns)) for r in df.collect()) == sorted(tuple(r[o.columns.index(x)] for x in sorted(o.columns)) for r in o.fetchall())


def test_pipeline_stage_by_stage(spark, sf_dir):
    """Each stage against what it says, on its own input; the rows between stages have the columns of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        docs = corpus_pipeline.store(stage(spark, docs, sf_dir), f"test-{name}")
        kept[name] = (before, [r.asDict() for r in docs.collect()])
        assert name == "shard" or docs.columns == columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    before, after = kept["quality"]
    ids = {r["doc_id"] for r in after}
    assert sum((r["doc_id"] in ids) == labels[r["doc_id"]] for r in before if r["doc_id"] in labels) >= 0.95 * sum(r["doc_id"] in labels for r in before)
    before, after = kept["near_dedup"]
    h = WordHashes()
    sets = {r["doc_id"]: set(N.shingles(r["text"], h)[0].tolist()) for r in before}
    label = {i: i for i in sets}
    text = {r["doc_id"]: r["text"] for r in before}
    order = sorted(sets)
    find = lambda x: x if label[x] == x else find(label[x])
    for i in order:
        for j in order:
            if j < i and (text[i] == text[j] or sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    assert sorted(r["doc_id"] for r in after) == sorted({find(i) for i in order})
    before, after = kept["decontaminate"]
    items = [PLAIN.findall(r["text"].lower()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    joined = [" " + " ".join(w) + " " for w in items]
    clean = {r["doc_id"] for r in before if not any(j in " " + " ".join(PLAIN.findall(r["text"].lower())) + " " for j in joined)}
    ids = {r["doc_id"] for r in after}
    assert ids <= clean and len(clean - ids) <= 2
    before, after = kept["mix"]
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before} and len(after) > 0
    assert max(sum(1 for r in after if r["doc_id"] == i) for i in {r["doc_id"] for r in after}) <= 2
    before, after = kept["shard"]
    assert len(before) == len(after) and {r["shard"] for r in after} <= set(range(16))
    assert D.allowed(20) == 4


def odd_documents(spark, n=60):
    """Null and repeated ids, null, empty and very long texts, whole repeats, a null source, and names that stages use."""
    rng = random.Random(21)
    words = [f"word{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 80))), "en", "s%d" % (i % 3), i) for i in range(n)]
    rows += [(None, rows[0][1] + " tail", "en", "s0", 1), (None, "only here " * 9, None, None, 2), (None, None, "en", "s1", 3), (3, "", "en", "s1", 4), (5, "", "en", "s1", 5)]
    rows += [(7, "another text of the same id " * 3, "en", "s2", 6), rows[1], rows[1], (900, " ".join(rng.choice(words) for _ in range(120_000)), "en", "s2", 7)]
    clash = "1 as score, 2 as _text, 3 as _id, 4 as matches, 5 as `row`, 6 as `key`, 7 as copy, 8 as predicted, 9 as `a.b`"
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *clash.split(", "))


def test_every_stage_takes_odd_rows_and_clashing_names(shipped, sf_dir):
    docs = odd_documents(shipped)
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.store(stage(shipped, docs, sf_dir), f"odd-{name}")
        rows = out.collect()
        if name == "shard":
            assert len(rows) == docs.count()
            continue
        assert out.columns == docs.columns
        given = {(r["doc_id"], r["text"], r["source"], r["n_chars"]) for r in docs.collect()}
        assert {(r["doc_id"], r["text"], r["source"], r["n_chars"]) for r in rows} <= given and all(r["score"] == 1 and r["a.b"] == 9 for r in rows)
        if name == "near_dedup":  # one of each text class: the null and empty texts are copies, whole repeats are one
            assert sum((r["text"] or "") == "" for r in rows) == 1 and sum(r["doc_id"] == 1 for r in rows) == 1 and sum(r["doc_id"] == 7 for r in rows) == 2
            assert sum(r["doc_id"] is None for r in rows) >= 1
        if name == "decontaminate":
            assert len(rows) == docs.count()
        if name == "mix":
            assert any(r["doc_id"] is None for r in rows) and any(r["doc_id"] == 900 for r in rows)


def test_every_stage_takes_an_empty_table(shipped, sf_dir):
    docs = odd_documents(shipped).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(shipped, docs, sf_dir)
        assert out.count() == 0 and (name == "shard" or out.columns == docs.columns)
