import math
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from codestrata.llm import language_model as L
from codestrata.llm.elias_fano import Bits, EliasFano, Trie

ODD = [None, "", "   \n\t", "word", "Ünï cödé ✓ 😀"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 20), max_size=200), st.lists(st.integers(0, 1 << 20), max_size=50), st.integers(0, 16))
def test_elias_fano_finds_what_it_holds(values, others, low):
    v = np.array(sorted(set(values)), dtype=np.uint64)
    mask = np.uint64((1 << low) - 1)
    e = EliasFano.of(v >> np.uint64(low), v & mask, low)
    q = np.array(sorted(set(values) | set(others)), dtype=np.uint64)
    at = e.find(q >> np.uint64(low), q & mask)
    for x, i in zip(q.tolist(), at.tolist()):
        assert (i >= 0) == (x in set(values)) and (i < 0 or v[i] == x)
    assert e.access(np.arange(len(v))).tolist() == v.tolist() and e.highs().tolist() == (v >> np.uint64(low)).tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=700))
def test_select_on_packed_bits(bits):
    b = Bits(np.packbits(np.array(bits, dtype=np.uint8)))
    for want, got in ((np.flatnonzero(bits), b.ones), (np.flatnonzero(~np.array(bits)), b.zeros)):
        assert got(np.arange(len(want))).tolist() == want.tolist()


def test_trie_round_trip_through_a_mapped_file():
    rng = np.random.default_rng(0)
    words = np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64))
    owner = np.sort(rng.integers(0, len(words), 2000))
    pairs = sorted({(int(o), int(s)) for o, s in zip(owner, rng.integers(0, 1 << 40, 2000))})
    owner, succ = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], dtype=np.uint64)
    value = rng.uniform(0.01, 50, len(pairs))
    t = Trie.mapped(Trie.build(words, np.arange(len(words)) + 1, np.ones(len(words), int), owner, succ, value).to_bytes())
    assert (t.context(words) == np.arange(len(words))).all() and (t.words() == words).all()
    assert t.context(np.array([words[0] + np.uint64(1)]))[0] == -1
    one = np.ones(len(owner), dtype=np.int64)
    got = t.values(owner, one, succ)
    assert np.abs(np.log10(got) - np.log10(value)).max() < 0.01
    each = np.bincount(owner, minlength=len(words))
    assert (t.values(np.arange(len(words)), each, succ) == got).all()
    assert (t.values(owner, one, succ ^ np.uint64(1 << 39)) == 0).mean() > 0.99
    # A successor is looked for in its context only.
    other = (owner + 1) % len(words)
    held = set(zip(owner.tolist(), succ.tolist()))
    assert all((v > 0) == ((int(o), int(s)) in held) for o, s, v in zip(other, succ, t.values(other, one, succ)))
    assert (t.values(np.full(3, -1), np.ones(3, int), succ[:3]) == 0).all() and len(t.stored()) == len(pairs)
    assert len(t.to_bytes()) < 500 * 16 + len(pairs) * 7 + 4000


def brute(train, texts):
    """The model written out: absolute discounting by one over add-one unigrams."""
    toks = lambda t: (t or "").encode().lower().split()
    c, bi, succ = Counter(), Counter(), Counter()
    for t in train:
        s = toks(t)
        c.update([*s, "END"])
        bi.update(zip(["START", *s], [*s, "END"]))
    for a, _ in bi:
        succ[a] += 1
    n, v = sum(c.values()), len(c)
    ctx = Counter(c)
    ctx["START"] = len(train)
    p = lambda w: (c[w] + 1) / (n + v + 1)
    out = []
    for t in texts:
        s = [*toks(t), "END"]
        sc = sum(math.log10(max(0, bi[a, b] - 1) / ctx[a] + succ[a] / ctx[a] * p(b)) if ctx[a] else math.log10(p(b)) for a, b in zip(["START", *s[:-1]], s))
        out.append((len(s), sum(c[w] > 0 for w in s), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in s), sc))
    return out


def test_scores_match_the_model_written_out(docs_of, monkeypatch):
    monkeypatch.setattr(L, "CHUNK", 60)
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(list("abcdefgh"), rng.integers(1, 30))).replace("a b", "A\tb\x0b") for _ in range(80)] + ODD + ["a b c"] * 3
    train = texts[::2]
    model = L.train(docs_of(train), shards=3)
    got = sorted(L.score(docs_of(texts), model).collect())
    for r, (n, known, total, base, sc) in zip(got, brute(train, texts)):
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert abs(r["base_score"] - base) < 1e-9 and abs(r["score"] - sc) < 0.02 * n


def test_the_query_against_the_model_written_out(shipped, sf_dir):
    import zlib

    docs = sorted((r["doc_id"], r["text"]) for r in shipped.read.parquet(f"{sf_dir}/documents.parquet").collect())
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs]
    rows = sorted(L.op2_language_model(shipped, sf_dir).collect())
    want = brute([t for (_, t), h in zip(docs, held) if not h], [t for _, t in docs])
    for r, h, (n, known, total, base, sc) in zip(rows, held, want, strict=True):
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, n, known, total)
        assert abs(r["base_score"] - base) < 1e-6 and abs(r["score"] - sc) < 0.02 * n


def test_model_of_nothing(docs_of):
    got = L.score(docs_of(["a b", None]), L.train(docs_of([]), shards=2)).orderBy("doc_id").collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got] == [(3, 0, 0), (1, 0, 0)]
    assert L.score(docs_of([]), L.train(docs_of(["a"]))).count() == 0


def test_the_model_beats_its_base_on_text_like_its_own(docs_of):
    rng = np.random.default_rng(2)
    line = lambda: " ".join(f"w{(i * 7 + int(rng.integers(0, 2))) % 50}" for i in range(40))
    model = L.train(docs_of([line() for _ in range(60)]), shards=2)
    r = L.score(docs_of([line() for _ in range(5)]), model).collect()
    assert all(x["score"] > x["base_score"] for x in r)


def test_every_word_of_a_large_vocabulary_has_its_own_unigram(docs_of):
    """More words than any fixed head: each is scored from its own count, alone and after another word."""
    words = [f"w{i}" for i in range(270_000)]
    train = [" ".join(words[i : i + 27_000]) for i in range(0, len(words), 27_000)] * 2 + ["rare", "x often"] + ["x often often"] * 40 + ["x seldom"] * 2
    n, v, d = 2 * len(words) + 1 + 2 + 120 + 4 + len(train), len(words) + 5, len(train)
    p = lambda c: (c + 1) / (n + v + 1)
    r = {x["doc_id"]: x for x in L.score(docs_of(["rare", "unknown", "x seldom"]), L.train(docs_of(train), shards=3)).collect()}
    assert all(x["train_tokens"] == n for x in r.values())
    kinds = 10 + 2  # words that texts start with
    want = {
        0: math.log10(kinds / d * p(1)) + math.log10(p(d)),
        1: math.log10(kinds / d * p(0)) + math.log10(p(d)),
    }
    # "rare" ends its one text: c = 1, one successor, a pair found once.
    for i, w in want.items():
        assert abs(r[i]["score"] - w) < 1e-9
    x_pair = 42 / d + kinds / d * p(43)
    seldom = 1 / 43 + 2 / 43 * p(2)
    end = 1 / 2 + 1 / 2 * p(d)
    assert abs(r[2]["score"] - math.log10(x_pair * seldom * end)) < 0.02 * 3
