"""The Merkle manifest, vector codes and exact search, against versions written out in Python, on odd rows and hot groups."""

import math
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.llm import exact_search as E
from codestrata.llm import integer_vectors as I
from codestrata.llm import merkle as M
from codestrata.llm import vector_codes as C

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def _h(s):
    return sha256(s.encode()).hexdigest()


def _leaf(row):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _up(level):
    return [_h("".join(level[i : i + 8])) for i in range(0, len(level), 8)]


def _proof(leaves, i):
    """Siblings and root of a leaf."""
    out, level = [], leaves
    while len(level) > 1:
        lo = i // 8 * 8
        out.append(("".join(level[lo:i]), "".join(level[i + 1 : lo + 8])))
        level, i = _up(level), i // 8
    return out, level[0]


def _expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    leaves = {x: [(r, _leaf(r)) for r in by[x]] for x in langs}
    for x in langs:
        leaves[x].sort(key=lambda p: (p[0][0] is not None, p[0][0] or 0, p[1]))
    subs = [_proof([d for _, d in leaves[x]], 0)[1] for x in langs]
    out = []
    for at, x in enumerate(langs):
        digests = [d for _, d in leaves[x]]
        above, root = _proof(subs, at)
        for i, (r, d) in enumerate(leaves[x]):
            path = _proof(digests, i)[0] + above
            folded, hit = d, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            if hit and r[4] is not None:
                folded = _leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for a, b in path:
                folded = _h(a + folded + b)
            out.append((r[0], d, subs[at], root, _h("".join(a + b for a, b in path)), folded, folded == root))
    return out


def _key(r):
    return tuple((v is not None, v) if not isinstance(v, bool) else (True, str(v)) for v in r)


def _op11(spark, rows):
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as tree", "2 as idx", "3 as key", "4 as digest")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    return [tuple(r) for r in M.verified(M.build(df, tampered={"text": M.ascii_lower(F.col("text"))}, where=hit)).collect()]


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 64, 65, 700, 5000])
def test_one_tree_of_any_size(shipped, n):
    rows = [((i * 7919) % 100_003, "s", "en", 3, f"Text {i}") for i in range(n)]
    assert sorted(_op11(shipped, rows), key=_key) == sorted(_expected(rows), key=_key)


def test_odd_rows_repeated_rows_and_many_trees(shipped):
    rows = [(i, None if i % 5 == 0 else f"s{i % 3}", None if i % 7 == 0 else f"l{i % 90}", i if i % 2 else None, [None, "", "ÄÖ Big TEXT 😀", "x" * 50_000][i % 4]) for i in range(400)]
    rows += [(None, None, None, None, None)] * 9 + [(5, "a", "en", 1, "Same")] * 70 + [(5, "a", "en", 1, "Other")] * 3 + [(-4, "", "", 0, "EMPTY lang")]
    got, want = sorted(_op11(shipped, rows), key=_key), sorted(_expected(rows), key=_key)
    assert got == want and not all(r[6] for r in got)


def test_every_row_its_own_tree_and_none(shipped):
    rows = [(i, "s", f"lang{i:04}", 1, "t") for i in range(600)]
    assert sorted(_op11(shipped, rows), key=_key) == sorted(_expected(rows), key=_key)
    assert _op11(shipped, []) == []


def test_proofs_fold_to_the_root_and_the_store_is_kept(shipped, tmp_path):
    rows = [(i, "s", "en" if i % 3 else "de", 1, f"t{i}") for i in range(900)]
    m = M.build(shipped.createDataFrame(rows, DOCS), path=f"file://{tmp_path}/m")
    got = M.proofs(m).collect()
    assert len(got) == 900 and all(M.fold(r["digest"], M.steps(r["path"])) == m.root for r in got)
    level2 = shipped.read.parquet(f"file://{tmp_path}/m/trees/level=2")
    assert 1 <= level2.filter("tree = '1en' and whole").count() <= 600 // 64 and level2.filter("tree = '1en'").selectExpr("sum(n)").first()[0] == 75


def _vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").selectExpr("*", "1 as values", "2 as code", "3 as error", "4 as row", "5 as q")


def _floor(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def _usable(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


def _codes(rows, parts=16, entries=64):
    kept = [(i, _floor(v), label) for i, v, label in _usable(rows)]
    width = len(kept[0][1]) // parts
    cut = lambda v: [v[width * p : width * (p + 1)] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in sorted(kept, key=lambda r: (r[0], r[1]))[:entries]] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))
    for _ in range(2):
        took = [[[] for _ in b] for b in books]
        for _, v, _ in kept:
            for p, x in enumerate(cut(v)):
                took[p][near(p, x)[1]].append(x)
        books = [[[sum(c) // len(t) for c in zip(*t)] if t else e for e, t in zip(b, ts)] for b, ts in zip(books, took)]
    found = [(i, [near(p, x) for p, x in enumerate(cut(v))], label) for i, v, label in kept]
    by = {}
    for _, n, label in found:
        by[label] = by.get(label, 0) + sum(d for d, _ in n)
    digest = sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in n), sum(d for d, _ in n), by[label], digest) for i, n, label in found]


ODD_VECTORS = [(1000, None, 1), (1001, [float("nan")] * 32, 1), (1002, [float("inf")] + [0.0] * 31, 2), (1003, [None] + [1.0] * 31, 3)]


@pytest.fixture(scope="module")
def some():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(260, 32)).astype(np.float32)
    x[60:170] = x[3]  # copies
    x[170:175] = 0
    return [(int(i * 3 - 40), [float(c) for c in v], None if i % 4 == 0 else int(i % 3)) for i, v in enumerate(x)] + ODD_VECTORS


def test_codes_of_a_table(shipped, some):
    got = sorted(tuple(r) for r in C.compress(_vectors(shipped, some)).collect())
    assert got == sorted(_codes(some))


def test_codes_of_few_long_short_and_extreme_vectors(shipped):
    few = [(5, [0.5, -0.25, 1.0, 2.0] * 8, 1), (2, [1.0, 1.0, 1.0, 1.0] * 8, None)]
    assert sorted(tuple(r) for r in C.compress(_vectors(shipped, few)).collect()) == sorted(_codes(few))
    odd = [*few, (7, [1.0], 1), (8, [1e30] * 32, 1), (None, [0.1] * 32, 2), (9, [], 2)]
    got = {r["vec_id"]: (r["code"], r["error"]) for r in C.compress(_vectors(shipped, odd)).collect()}
    assert set(got) == {5, 2, 7, 8, None, 9} and got[7] == got[8] == got[9] == (None, None) and len(got[None][0]) == 32
    assert C.compress(_vectors(shipped, [])).count() == 0 and C.compress(_vectors(shipped, ODD_VECTORS)).count() == 0
    ten = [(i, [i / 10 + j for j in range(10)], 0) for i in range(20)]  # parts of one component, behind zeros
    assert all(len(r["code"]) == 32 for r in C.compress(_vectors(shipped, ten)).collect())


def test_nearest_takes_the_first_of_equal_entries():
    books = np.array([[[0, 0], [2, 0], [0, 0], [1, 1]]])
    code, d = C.nearest(np.array([[[0, 0], [1, 0], [5, 5]]]), books)
    assert code.tolist() == [[0, 0, 3]] and d.tolist() == [[0, 1, 32]]


def _top(rows, k, step):
    kept = [(i, _floor(v)) for i, v, _ in _usable(rows) if i is not None]
    out = []
    for i, q in kept:
        if i % step == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in kept if j != i)[:k]
            out += [(i, r, j, -n) for r, (n, j) in enumerate(s, 1)]
    return sorted(out)


@pytest.mark.parametrize("group,held,cells", [(16_384, 64, 64), (7, 3, 8)])
def test_exact_search_against_brute_force(shipped, some, monkeypatch, group, held, cells):
    """Small groups, short lists and coarse cells send queries on to further reading and to all exact vectors."""
    monkeypatch.setattr(E, "GROUP", group)
    monkeypatch.setattr(E, "HELD", held)
    monkeypatch.setattr(E, "SLICE", 5)
    got = sorted(tuple(r) for r in E.search(_vectors(shipped, some), F.col("vec_id") % 2 == 0, 5, cells=cells).collect())
    assert got == _top(some, 5, 2)


def test_exact_search_of_few_and_odd_rows(shipped):
    few = [(0, [1.0, 2.0], 0), (1, [3.0, -1.0], 0), (2, [0.0, 0.0], 0), (4, [1.0, 2.0], 0)]
    got = sorted(tuple(r) for r in E.search(_vectors(shipped, [*few, (None, [1.0, 1.0], 0), (6, [1.0], 0), (8, [1e30, 0.0], 0), *few]), F.col("vec_id") % 2 == 0, 5).collect())
    assert got == _top(few, 5, 2)
    assert E.search(_vectors(shipped, []), F.col("vec_id") % 2 == 0).count() == 0 and E.search(_vectors(shipped, [(3, [1.0], 0)]), F.col("vec_id") % 2 == 0).count() == 0
    twice = [(2, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, [1.0, 1.0], 0)]
    assert sorted((r["vec_id"], r["rank"], r["score"]) for r in E.search(_vectors(shipped, twice), F.col("vec_id") == 2).collect()) == [(2, 2, 0), (2, 2, 0), (3, 1, 65536), (3, 1, 65536)]


def test_integers_of_double_vectors(shipped):
    rows = shipped.createDataFrame([(1, [0.1, -0.1]), (2, [0.999999999, 2.0])], "vec_id int, embedding array<double>")
    table, dim = I.as_integers(rows, "vec_id", "embedding", {}, "t")
    assert dim == 2 and {r["vec_id"]: r["values"] for r in table.collect()} == {1: [25, -26], 2: [255, 512]}
    assert I.limit(64) == 2**27


def test_bounds_of_a_batch_are_compared_before_they_are_ordered(monkeypatch):
    """Rows that are no query's best so far take no part in the ordering of bounds; candidates are those of all bounds."""
    import numpy as np

    from codestrata.llm import exact_search as E

    rng, seen, plain = np.random.default_rng(2), [], E._best
    monkeypatch.setattr(E, "_best", lambda held, new, k: seen.append(new.shape[1]) or plain(held, new, k))
    q, x = rng.integers(-300, 300, (20, 8)), rng.integers(-300, 300, (8000, 8))
    lo, hi = x - rng.integers(0, 4, x.shape), x + rng.integers(0, 4, x.shape)
    group, k = E._Group(np.arange(20), q, 3), 3
    for s in range(0, 8000, 500):
        group.meet(np.arange(s, s + 500), lo[s : s + 500].astype(float), hi[s : s + 500].astype(float))
    low, high = (np.maximum(q, 0) @ a.T + np.minimum(q, 0) @ b.T for a, b in ((lo, hi), (hi, lo)))
    for i in range(20):
        least = np.sort(low[i])[-k]
        assert set(group.row[group.who == i].tolist()) == set(np.flatnonzero(high[i] >= least).tolist())
    assert sum(seen) < 4000


def test_lower_bounds_are_taken_of_pairs_that_count(monkeypatch):
    """Bounds in single precision lose no candidate, large components too, and the best are not put in order for every batch."""
    import numpy as np

    from codestrata.llm import exact_search as E

    rng, sorts, plain = np.random.default_rng(3), [], np.lexsort
    for most in (200, 2**27):
        q, x = rng.integers(-most, most, (30, 64)), rng.integers(-most, most, (6000, 64))
        x[1000:1040] = x[0]
        group, k = E._Group(np.arange(30), q, 4), 4
        monkeypatch.setattr(E.np, "lexsort", lambda keys: (len(keys) == 3 and sorts.append(1)) or plain(keys))
        for s in range(0, 6000, 300):
            group.meet(np.arange(s, s + 300), x[s : s + 300] - 1.0, x[s : s + 300] + 1.0)
        assert not sorts
        group.result()
        score = q @ x.T
        for i in range(30):
            need = set(np.flatnonzero(score[i] >= np.sort(score[i])[-k]).tolist())
            assert need <= set(group.row[group.who == i].tolist()) and group.lower[i, 0] <= np.sort(score[i])[-k]
        monkeypatch.undo()
        sorts.clear()
