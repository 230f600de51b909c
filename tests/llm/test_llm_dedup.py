"""Dedup operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueloom.llm.embedding_dedup import embedding_dedup
from cueloom.llm.graph import components
from cueloom.llm.simhash import BITS, allocate, fingerprint, group_bits, simhash_groups
from cueloom.llm.substring import substring_dedup
from cueloom.llm.suffix_dedup import Shard, merge, suffix_dedup

CLASHING = {"block": "'x'", "fp": "1", "key": "'k'", "bucket": "2", "rest": "null", "n": "3", "level": "'l'", "class": "4"}


def table(spark, rows, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({k: F.expr(v) for k, v in CLASHING.items()})


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    word = lambda: rng.choice(["alpha", "be", "gämma", "d", "Epsilon,", "zeta", "eta.", "θ"]) + rng.choice(["", "", str(rng.randrange(50))])
    passages = [[word() for _ in range(rng.choice([13, 14, 30, 70]))] for _ in range(6)]
    rows = []
    for i in range(60):
        words = [word() for _ in range(rng.randrange(0, 60))]
        if i % 2:
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages)
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "one"), (104, rows[3][1]), (104, rows[3][1]), (3, rows[3][1]), (None, rows[5][1]), (None, None), (200, " ".join(f"w{i % 700}" for i in range(60_000)))]
    rng.shuffle(rows)
    return rows


def removed(items, n, doc, first):
    gone = [False] * len(items)
    for s in range(len(items) - n + 1):
        if first.get(tuple(items[s : s + n]), doc) < doc:
            gone[s : s + n] = [True] * n
    return gone


def smallest(rows, n):
    first = {}
    for doc, items in rows:
        if doc is not None:
            for s in range(len(items) - n + 1):
                g = tuple(items[s : s + n])
                first[g] = min(doc, first.get(g, doc))
    return first


@pytest.mark.parametrize("size", [2_000, 1 << 20])
def test_substring_dedup(spark, texts, size):
    words = [(d, (t or "").encode().split()) for d, t in texts]
    first = smallest(words, 13)
    want = []
    for d, w in words:
        gone = removed(w, 13, d, first) if d is not None else [False] * len(w)
        want.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    got = [tuple(r) for r in substring_dedup(table(spark, texts), block_bytes=size).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_substring_levels_double_and_carry(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (2, "x " + long + "\ny"), (3, " ".join(long.split()[:13])), (4, "q"), (5, None)]
    got = {r["doc_id"]: r for r in substring_dedup(table(spark, rows), longest=104, texts=True, carry=("block", "n")).collect()}
    assert [got[i]["longest"] for i in (1, 2, 3, 4, 5)] == [52, 52, 13, 0, 0]
    assert [got[i]["kept"] for i in (1, 2, 3, 4, 5)] == [long, "x\ny", "", "q", None]
    assert got[2]["rest"]["block"] == "x" and got[2]["rest"]["n"] == 3


@pytest.mark.parametrize("size", [2_000, 1 << 20])
def test_suffix_dedup(spark, texts, size):
    raw = [(d, (t or "").encode()) for d, t in texts]
    first = smallest(raw, 50)
    want = []
    for d, b in raw:
        gone = removed(b, 50, d, first) if d is not None else [False] * len(b)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        want.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    got = [tuple(r) for r in suffix_dedup(table(spark, texts), block_bytes=size).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_transforms_merge_to_sorted_prefixes():
    rng = random.Random(1)
    strings = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randrange(3, 12))) for _ in range(40)})
    parts = [sorted(strings[i::3]) for i in range(3)]
    shards = [Shard(p) for p in parts]
    slots, common = merge(shards, 5)
    held = [(p[i], o) for p, s in zip(parts, shards) for i, o in zip(s.string[s.order], s.offset)]
    seen = [(held[i][0] + b"\0" * 12)[held[i][1] :][:5] if held[i][1] < len(held[i][0]) else None for i in slots]
    plain = [x for x in seen if x is not None and b"\0" not in x]
    assert plain == sorted(plain)
    for i in range(1, len(seen)):
        if seen[i] and seen[i - 1] and b"\0" not in seen[i] + seen[i - 1]:
            alike = next((k for k in range(5) if seen[i][k] != seen[i - 1][k]), 5)
            assert common[i] == (alike if alike in (0, 5) else (alike - 1) // 2 * 2 + 1)


@pytest.mark.parametrize("group", [1, 64])
def test_simhash_groups(spark, texts, group, monkeypatch):
    rng = random.Random(2)
    base = texts[0][1] or "some words that stay the same all along " * 5
    rows = [*texts, *((300 + i, base + f" tail{i % 3}") for i in range(12)), *((400 + i, " ".join(rng.sample("a b c d e f".split(), 2))) for i in range(20))]
    import cueloom.llm.simhash as S

    plain = S.links
    monkeypatch.setattr(S, "links", lambda prints, distance: plain(prints, distance, group))
    prints = [(d, fingerprint((t or "").encode())) for d, t in rows]
    mask = (1 << 64) - 1
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin((prints[i][1] ^ prints[j][1]) & mask).count("1") <= 2 and find(i) != find(j):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    want = [(d, format(f & mask, "016x"), least.get(find(i))) for i, (d, f) in enumerate(prints)]
    got = [tuple(r) for r in simhash_groups(table(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_fingerprint_rule():
    from xxhash import xxh64_intdigest

    words = "The QUICK brown fox jumps".lower().split()
    hashes = [xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(3)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 3)
    assert fingerprint("The QUICK\tbrown\u000bfox jumps ".encode()) % (1 << 64) == want
    assert fingerprint(b"") == fingerprint(b" \n") == 0


def test_thresholds_follow_costs():
    assert allocate([[0, 9, 20, 40], [0, 1, 2, 3], [0, 9, 20, 40]], 2) == (3.0, (-1, 2, -1))
    assert allocate([[0, 1, 9, 9], [0, 1, 9, 9], [0, 1, 9, 9]], 2)[1] == (0, 0, 0)
    groups = group_bits(10, np.eye(BITS) * 5, 3)
    assert sorted(sum(groups, [])) == list(range(BITS)) and {len(g) for g in groups} == {21, 22}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2050)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embedding_dedup(spark, kind):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + rng.standard_normal(16) * (0.12 if i % 3 else 1)], i % 2 if i % 17 else None) for i in range(400)]
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(5)] + [(1010, [2.0 * x for x in rows[5][1]], rows[5][2]), (1004, rows[5][1], rows[5][2])]
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 16, 0), (2003, [None, *[1.0] * 15], 0), (2004, [float("nan"), *[1.0] * 15], 0), (2005, [float("inf"), *[1.0] * 15], 0), (2006, [1.0] * 8, 0), (2007, [1.0] * 8, 0)]
    good = [(d, np.array(v, float) / np.linalg.norm(v), label) for d, v, label in rows if v and label is not None and None not in v and np.isfinite(v).all() and any(v)]
    links, parent = {}, {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, (d, v, label) in enumerate(good):
        links.setdefault(i, 0)
        for j in range(i):
            e, w, other = good[j]
            if label == other and len(v) == len(w) and v @ w >= 0.98:
                links[i] += 1
                links[j] += 1
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    want = [(d, links[i], find(d), find(d) == d) for i, (d, _, _) in enumerate(good)]
    held = {id(r) for r in ()}
    want += [(d, 0, d, True) for d, v, label in rows if not (v and label is not None and None not in v and np.isfinite(v).all() and any(v))]
    del held
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumns({"vector": F.lit("x"), "class": F.lit(1), "n": F.lit(2), "fine": F.lit("no")})
    got = [tuple(r) for r in embedding_dedup(df).select("vec_id", "n_links", "component_id", "kept").collect()]
    assert sorted(got) == sorted(want)


def test_empty_tables(spark):
    docs = table(spark, [])
    for f in (substring_dedup, suffix_dedup, simhash_groups):
        assert f(docs).count() == 0
    assert embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
