import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codestrata.llm import token_store as T

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")
ODD = [None, "", "   \n\t", "word", "Ünï cödé ✓ 😀", "I'm IT'S don't <|endoftext|>x <|ENDOFTEXT|> a<b", "x́  y\x1cz ǅ İI ΑΣ"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aBé'.,! \n\t<|sΣİ1٣日 ́ x"), max_size=40), min_size=1, max_size=5))
def test_encoder_equals_the_library(texts):
    import pyarrow as pa

    enc = T.encoder(open(PATH, encoding="utf-8").read())
    ids, edges = enc(pa.array(texts), 1)
    for t, a, z in zip(texts, edges[:-1], edges[1:]):
        assert ids[a:z].tolist() == [*enc.tokenizer.encode(t, add_special_tokens=False).ids, 1]


def test_chunks_are_found_again_behind_other_ids():
    rng = np.random.default_rng(1)
    body = rng.integers(0, 49000, 6000).astype("<u2")
    other = np.concatenate([rng.integers(0, 49000, 777).astype("<u2"), body])
    pieces = lambda x: {x[a:z].tobytes() for a, z in zip([0, *T.cut(x)[:-1]], T.cut(x))}
    assert T.cut(body)[-1] == len(body) and len(pieces(body) & pieces(other)) > 0.7 * len(pieces(body))
    assert all(0 < z - a <= T.MOST for a, z in zip([0, *T.cut(body)[:-1]], T.cut(body)))
    same = np.zeros(5000, "<u2")
    assert T.cut(same)[-1] == 5000


def test_round_trip(docs_of, spark, tokenizer, tmp_path):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    shared = " ".join(rng.choice(words) for _ in range(1500))
    texts = [shared, *ODD, shared + " tail", "head " + shared, *[" ".join(rng.choice(words) for _ in range(rng.randint(1, 300))) for _ in range(60)], shared]
    ids = [len(texts) - i for i in range(len(texts))]
    ids[3] = None
    ids[4] = ids[5]
    path = str(tmp_path / "store")
    T.write(docs_of(texts, ids=ids), path, PATH)
    rows = T.verified(spark, path).collect()
    assert len(rows) == len(texts)
    want = {}
    for i, t in zip(ids, texts):
        want.setdefault(i, []).append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(bytes(r["ids"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"])
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda x: (x is not None, x))
    assert T.damaged_pages(spark, path).count() == 0 and len(T.root(spark, path)) == 64
    stored = spark.read.parquet(f"{path}/rows").selectExpr("sum(length(payload)) as b", "sum(n_tokens) * 2 as n").first()
    assert stored["b"] < 0.75 * stored["n"]  # the shared passage is stored once


def test_damage_is_seen(docs_of, spark, tmp_path):
    path = str(tmp_path / "store")
    T.write(docs_of([" ".join(str(i) for i in range(900)), "b"]), path, PATH)
    rows = spark.read.parquet(f"{path}/rows").cache()
    rows.count()
    from pyspark.sql import functions as F

    hurt = str(tmp_path / "hurt")
    rows.withColumn("payload", F.concat(F.lit(b"\x01\x02"), F.expr("substring(payload, 3)"))).write.parquet(f"{hurt}/rows")
    with pytest.raises(Exception, match="damaged"):
        T.read(spark, hurt).collect()


def test_empty_table(docs_of, spark, tmp_path):
    path = str(tmp_path / "store")
    T.write(docs_of([]), path, PATH)
    assert T.verified(spark, path).count() == 0
    assert zlib.crc32(b"") == 0


def test_an_altered_recipe_and_a_missing_part_are_seen(docs_of, spark, tmp_path):
    import shutil

    from pyspark.sql import functions as F

    path = str(tmp_path / "store")
    T.write(docs_of([" ".join(str(i) for i in range(900)), "b", "c"]), path, PATH)
    assert T.verified(spark, path).count() == 3
    rows = spark.read.parquet(f"{path}/rows")
    moved = str(tmp_path / "moved")
    shutil.copytree(path, moved)
    keys = F.expr("transform(sequence(1, size(keys)), i -> element_at(keys, -i))")
    lists = {"keys": keys, "lengths": F.reverse("lengths"), "owned": F.transform("owned", lambda x: F.lit(True)), "payload": F.col("payload")}
    order = rows.filter("size(keys) > 1").first()
    ends = [sum(order["lengths"][:i]) * order["width"] for i in range(len(order["lengths"]) + 1)]
    turned = b"".join(bytes(order["payload"])[a:z] for a, z in reversed(list(zip(ends, ends[1:]))))
    long = F.size("keys") > 1
    lists["payload"] = F.lit(turned)
    rows.select(*[F.when(long, lists[c]).otherwise(F.col(c)).alias(c) if c in lists else c for c in rows.columns]).write.mode("overwrite").parquet(f"{moved}/rows")
    with pytest.raises(Exception, match="recipe is damaged"):
        T.verified(spark, moved).collect()
    lost = str(tmp_path / "lost")
    shutil.copytree(path, lost)
    rows.filter("doc_id <> 1").write.mode("overwrite").parquet(f"{lost}/rows")
    with pytest.raises(ValueError, match="not as in the manifest"):
        T.verified(spark, lost)


def test_rows_of_one_id_store_their_chunks_once(docs_of, spark, tmp_path):
    text = " ".join(str(i) for i in range(2000))
    sizes = {}
    for name, ids in (("one", [1]), ("repeated", [1, 1, 1]), ("null", [None, None]), ("both", [None, 4, 4])):
        path = str(tmp_path / name)
        T.write(docs_of([text] * len(ids), ids=ids), path, PATH)
        sizes[name] = spark.read.parquet(f"{path}/rows").selectExpr("sum(length(payload)) as b").first()["b"]
        rows = T.verified(spark, path).collect()
        assert len({bytes(r["ids"]) for r in rows}) == 1 and len(rows) == len(ids)
    assert len(set(sizes.values())) == 1
