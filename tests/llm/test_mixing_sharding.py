import math
import random
import zlib

import numpy as np

from codestrata.llm import mixing, sharding

ODD = [None, "", "   \n\t", "word", "Ünï cödé ✓ 😀"]


def water_fill(sizes, weights, ratio, cap):
    """Targets by resharing the excess until none is above."""
    total, out, open_ = ratio * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        level = (total - sum(out[i] for i in range(len(sizes)) if i not in open_)) / sum(weights[i] for i in open_)
        over = [i for i in open_ if level * weights[i] > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = level * weights[i]
            break
        for i in over:
            out[i] = cap * sizes[i]
            open_.discard(i)
    return out


def test_targets_and_taken(docs_of):
    rng = random.Random(1)
    texts = [" ".join("w" for _ in range(rng.randint(1, 60))) for _ in range(400)] + ODD + [texts_ := "a b c"] * 3
    sources = [rng.choice(["a", "b", "b", "b", "c", None]) for _ in texts]
    docs = docs_of(texts, sources=sources)
    m = mixing.mix(docs)
    rows = m.documents.collect()
    assert len(rows) == len(texts)
    by_id = {r["doc_id"]: r for r in rows}
    count = lambda t: len([x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")])
    sizes = {s: sum(count(t) for t, x in zip(texts, sources) if x == s) for s in set(sources)}
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    want = dict(zip(order, water_fill([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5, 2)))
    taken = dict.fromkeys(order, 0)
    for i, t in enumerate(texts):
        r = by_id[i]
        assert r["size"] == count(t) and r["source_size"] == sizes[sources[i]]
        assert abs(r["target"] - want[sources[i]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[sources[i]] += r["taken"]
    for s in order:
        assert abs(taken[s] - want[s]) <= max(4 * m.block, 0.01 * want[s])
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).documents.collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}
    # The schedule never strays: after any number of slots each source has its share to a few slots.
    slots = sorted((r["slot"], r["source_id"]) for r in m.schedule.collect())
    assert [s for s, _ in slots] == list(range(m.slots))
    share = {r["source_id"]: r["hi"] - r["lo"] for r in m.sources.collect()}
    seen = dict.fromkeys(share, 0)
    for n, (_, s) in enumerate(slots, 1):
        seen[s] += 1
        assert all(abs(seen[k] - n * share[k]) < 3 + math.log2(n + 1) for k in share)
    assert m.pieces.count() > 0


def test_mixing_odd_tables(docs_of):
    assert mixing.mix(docs_of([])).documents.count() == 0
    assert [r["taken"] for r in mixing.mix(docs_of([None, "", " "])).documents.collect()] == [0, 0, 0]
    assert mixing.mixed_rows(docs_of(["a b", "a b", None], ids=[1, 1, None])).count() >= 2
    clash = docs_of(["a b c"] * 4).selectExpr("*", "1 as size", "2 as slot", "3 as bucket", "4 as key")
    assert sum(r["taken"] for r in mixing.mix(clash).documents.collect()) > 0


def test_sharding_balance_and_places(docs_of):
    rng = random.Random(2)
    texts = ["x" * rng.randint(0, 400) for _ in range(3000)] + ODD + ["same"] * 5
    ids = list(range(len(texts) - 2)) + [7, None]
    got = sharding.shard(docs_of(texts, ids=ids))
    rows = got.records.collect()
    assert len(rows) == len(texts)
    bytes_, places = {}, {}
    for r in rows:
        bytes_[r["shard"]] = bytes_.get(r["shard"], 0) + r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and r["virtual_slot"] < sharding.SLOTS
    assert sorted(bytes_) == list(range(16))
    assert max(bytes_.values()) - min(bytes_.values()) <= 401
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == want
    assert sharding.shard(docs_of([])).records.count() == 0


def test_slot_map_versions():
    sizes = np.random.default_rng(3).integers(0, 1000, 256).astype(float)
    first = sharding.SlotMap.first(4, 256)
    now = first.rebalanced(sizes)
    load = np.bincount(now.shards, weights=sizes, minlength=4)
    assert load.max() - load.min() < 20
    moved = {e[1] for e in now.edits}
    assert all(now.shards[s] == first.shards[s] for s in range(256) if s not in moved)
    grown = now.rebalanced(sizes, 5)
    assert grown.version == 2 and abs(np.bincount(grown.shards, weights=sizes)[4] - sizes.sum() / 5) < 50
    # A new shard takes about its share; few slots move otherwise.
    assert (grown.shards != now.shards).sum() < 256 * 0.3


def test_the_stored_map_is_edited(docs_of, shipped, tmp_path):
    rng = random.Random(4)
    texts = ["x" * rng.randint(0, 900) for _ in range(6000)]
    path = f"file://{tmp_path}/map"
    one = sharding.shard(docs_of(texts), n_shards=4, slots=512, map_path=path)
    two = sharding.shard(docs_of(texts + ["y" * 400] * 2000), n_shards=5, map_path=path)
    assert (one.map.version, two.map.version) == (1, 2) and (two.first.shards == one.map.shards).all()
    assert (sharding.SlotMap.load(shipped, path, 1).shards == one.map.shards).all() and sharding.SlotMap.load(shipped, path).n_shards == 5
    assert sharding.SlotMap.load(shipped, path, 9) is None
    shards = {r["virtual_slot"]: r["shard"] for r in two.records.collect()}
    assert all(two.map.shards[s] == h for s, h in shards.items()) and set(shards.values()) == set(range(5))
    # Few slots but those of the new shard change places.
    assert sum(a != b for a, b in zip(one.map.shards, two.map.shards)) < 512 * 0.4


def test_rows_alike_have_places_of_their_own(docs_of):
    docs = docs_of(["same"] * 500 + ["other", None], ids=[7] * 500 + [8, None]).selectExpr("*", "1 as size", "2 as n", "3 as virtual_slot", "4 as shard")
    rows = sharding.shard(docs).records.collect()
    assert len(rows) == 502 and sorted(r["slot"] for r in rows if r["doc_id"] == 7) == list(range(min(r["slot"] for r in rows if r["doc_id"] == 7), 500 + min(r["slot"] for r in rows if r["doc_id"] == 7)))


def test_places_of_very_many_rows_alike_in_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(sharding, "PLACES", 60)
    rows = sharding.shard(docs_of(["same"] * 500 + ["x"] * 130, ids=[7] * 500 + list(range(100, 230)))).records.collect()
    places = {}
    for r in rows:
        places.setdefault(r["shard"], []).append(r["slot"])
    assert len(rows) == 630 and all(sorted(p) == list(range(len(p))) for p in places.values())


def test_the_query_covers_its_table(shipped, sf_dir):
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in shipped.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = sharding.op6_sharding(shipped, sf_dir).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted((i, len(b) + 1, zlib.crc32(b)) for i, b in docs)
    load, places = [0] * 16, [[] for _ in range(16)]
    for r in rows:
        load[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert max(load) - min(load) <= max(len(b) + 1 for _, b in docs) and all(sorted(p) == list(range(len(p))) for p in places)


def test_mixed_rows_keep_null_and_repeated_ids_apart(docs_of):
    texts = [f"a b c d{i}" for i in range(40)]
    docs = docs_of(texts, ids=[None] * 20 + [7] * 20)
    taken = sorted((r["doc_id"] is None, -(-r["taken"] // r["size"])) for r in mixing.mix(docs.select("doc_id", "text", "source")).documents.collect())
    got = {}
    for r in mixing.mixed_rows(docs).collect():
        got[r["text"]] = got.get(r["text"], 0) + 1
        assert (r["doc_id"] is None) == (texts.index(r["text"]) < 20)
    assert sorted((texts.index(t) < 20, n) for t, n in got.items()) == [x for x in taken if x[1]]
    assert sum(texts.index(t) < 20 for t in got) > 0
