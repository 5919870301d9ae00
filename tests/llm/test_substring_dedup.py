import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest

from codestrata.llm import common
from codestrata.llm import substring_dedup as S

ODD = [None, "", "   \n\t", "word", "Ünï cödé ✓ 😀"]


def brute(texts, length):
    bodies = [(t or "").encode() for t in texts]
    n = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if n[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts_with_repeats(seed, n=40, scale=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 9)))
    passage = [" ".join(word() for _ in range(int(60 * scale))) for _ in range(4)]
    texts = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 50)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passage)
            a = rng.randint(0, int(150 * scale))
            parts += [p[a : a + rng.randint(int(150 * scale), int(420 * scale))], " ".join(word() for _ in range(rng.randint(0, 20)))]
        texts.append("".join(parts))
    return [*texts, *ODD, texts[0], texts[0], "ab" * 400, "xyz " * 200 + "end", "q" * 199, "q" * 200, "q" * 201]


@pytest.mark.parametrize(("seed", "most", "batch", "length", "hot"), [(1, 1024, 1 << 18, 200, 1 << 14), (2, 3, 1 << 18, 200, 30), (3, 3, 1, 200, 1 << 14), (4, 1024, 500, 200, 1 << 14), (5, 1024, 1 << 18, 64, 40), (6, 2, 1 << 18, 500, 1 << 14)])
def test_against_brute_force(docs_of, monkeypatch, seed, most, batch, length, hot):
    monkeypatch.setattr(S, "MOST", most)
    monkeypatch.setattr(S, "BATCH", batch)
    monkeypatch.setattr(common, "HOT", hot)
    texts = texts_with_repeats(seed, scale=length / 200)
    rows = S.remove_repeats(docs_of(texts).selectExpr("*", "1 as h", "2 as c", "3 as lo", "4 as spans", "5 as body"), length).orderBy("doc_id").collect()
    got = [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows]
    assert got == brute(texts, length)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in rows)


def test_groups_have_all_occurrences():
    rng = random.Random(7)
    p = bytes(rng.choice(b"abcdef") for _ in range(260))
    texts = [b"x" + p[:220] + b"1", b"y" + p[:240] + b"2", b"z" + p[:260] + b"33", bytes(rng.choice(b"ghij") for _ in range(250))]
    found = S.repeat_groups(texts, [max(0, len(t) - 199) for t in texts])
    sizes = {g[0]: sorted(found.occurrences(g)) for g in found.groups}
    assert sizes[220] == [(0, 1), (1, 1), (2, 1)] and sizes[240] == [(1, 1), (2, 1)]
    widest = {(t, p): w for t, p, w in zip(found.text.tolist(), found.place.tolist(), found.widest.tolist())}
    assert widest[0, 1] == 220 and widest[1, 1] == widest[2, 1] == 240


def test_a_thousand_near_contexts_of_one_anchor_give_a_span_each():
    """Nested intervals: what is written out grows with the places and not with their square."""
    rng = random.Random(11)
    p = bytes(rng.choice(b"abcdef") for _ in range(360))
    texts = sorted({p[:cut] + b"%04d" % k for k, cut in enumerate(rng.randint(210, 350) for _ in range(1000))})
    found = S.repeat_groups(texts, [len(t) - 199 for t in texts])
    assert len(found.groups) <= len(found.text) and len(found.text) == sum(len(t) - 199 for t in texts)
    rows = [{"h": 1, "c": k, "n": 1, "different": 1000, "doc_id": k, "text_key": k, "first": 0, "windows": len(t) - 199, "bytes": t, "alone": True} for k, t in enumerate(texts)]
    out = list(S._arrays(200)([pa.RecordBatch.from_pylist(rows)]))
    spans = [r for b in out for r in b.to_pylist()]
    assert len(spans) == 1000
    want = {k: max(_common(t, texts[k - 1]) if k else 0, _common(t, texts[k + 1]) if k < 999 else 0) for k, t in enumerate(texts)}
    assert all(r["lo"] == 0 and r["hi"] == want[r["doc_id"]] for r in spans)


def _common(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_a_very_long_text_and_a_length_too_short(docs_of):
    rng = random.Random(12)
    once = "".join(rng.choice("abcdefgh") for _ in range(400_000))
    rows = {r["doc_id"]: r["n_removed"] for r in S.remove_repeats(docs_of([once + once[1000:1300], "x" + once[5000:5400] + "y"])).collect()}
    assert rows == {0: 300 + 300 + 400, 1: 400}
    with pytest.raises(ValueError):
        S.remove_repeats(docs_of(["a"]), 39)


def test_the_query_over_its_table(shipped, sf_dir):
    rows = sorted(S.op5_substring_dedup(shipped, sf_dir).collect())
    docs = sorted((r["doc_id"], r["text"]) for r in shipped.read.parquet(f"{sf_dir}/documents.parquet").collect())
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows] == brute([t for _, t in docs], 200)


def test_repeated_ids_and_empty_table(docs_of):
    long = "abcdefghij" * 30
    rows = S.remove_repeats(docs_of([long + "1", "other", long + "1"], ids=[5, 5, None])).collect()
    assert sorted(r["n_removed"] for r in rows) == [0, 301, 301]
    assert S.remove_repeats(docs_of([])).count() == 0
