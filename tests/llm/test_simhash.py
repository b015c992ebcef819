import random
from collections import Counter, defaultdict

import numpy as np
import xxhash

from loomline.llm import simhash as S


def brute_fingerprint(text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in (text or "")).split(" ") if w]
    words = ["".join(c.lower() if c.isascii() else c for c in w) for w in words]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64))


def brute_components(fps):
    """{fp: smallest fp reachable}"""
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fl = list(fps)
    for i, a in enumerate(fl):
        for b in fl[:i]:
            if bin(a ^ b).count("1") <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {f: find(f) for f in fl}


def test_fingerprint_equals_the_definition():
    for t in ["", None, " \n ", "One", "a B", "É é A z\x1cq", "the cat sat on the mat " * 9, "x\x0by\x0cz\tw"]:
        assert S.fingerprint(t or "") == brute_fingerprint(t)


def clouds(n, seed):
    r = random.Random(seed)
    out = set()
    while len(out) < n:
        c = r.getrandbits(64)
        out.add(c)
        for _ in range(r.choice([0, 0, 0, 3, 40])):
            out.add(c ^ sum({1 << r.randrange(64) for _ in range(r.randint(1, 5))}))
    return sorted(out)


def test_links_join_what_brute_force_joins():
    points = clouds(1500, 1)
    a, b = S.links(np.array(points, np.uint64), 3, leaf=16)
    parent = {p: p for p in points}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        i, j = find(x), find(y)
        parent[max(i, j)] = min(i, j)
    assert {p: find(p) for p in points} == brute_components(points)


def test_shards_meet_every_close_pair():
    points = np.array(clouds(800, 2), np.uint64)
    tree = S.TopTree(points[::7], 7, 40, 3, least=4)
    idx, shard = tree.route(points)
    seen = defaultdict(set)
    for i, s in zip(idx.tolist(), shard.tolist(), strict=True):
        seen[i].add(s)
    assert len(set(shard.tolist())) > 8
    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 3).tolist():
            assert seen[i] & seen[j]


def test_components_of_documents(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [[r.choice(words) for _ in range(120)] for _ in range(40)]
    texts = []
    for b in base:
        texts += [" ".join(b), " ".join(b).upper(), " ".join(b[:60] + ["zz"] + b[61:])]
    texts += [None, "", " ", "one", "One"]
    rows = [(i * 3 + 1, t, "x", 7) for i, t in enumerate(texts)] + [(1, texts[0], "x", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    got = S.simhash_components(df, per_shard=20).collect()
    assert len(got) == len(rows)
    fps = {i: brute_fingerprint(t) for i, t, *_ in rows}
    comp = brute_components(set(fps.values()))
    low = {}
    for i, f in fps.items():
        low[comp[f]] = min(i, low.get(comp[f], i))
    for g in got:
        assert g.fp % 2**64 == fps[g.doc_id]
        assert g.component_id == low[comp[fps[g.doc_id]]]
    assert S.simhash_components(df.limit(0)).count() == 0


def test_shards_above_the_limit_are_split_again(spark):
    """A small sample leaves shards too big; a ball of points within two bits of one another can't be parted by distance."""
    r = random.Random(4)
    centre = r.getrandbits(64)
    ball = [centre] + [centre ^ 1 << i for i in range(64)] + [centre ^ 1 << i ^ 1 << j for i in range(64) for j in range(i)]
    points = sorted({*clouds(2500, 5), *ball})
    df = spark.createDataFrame([(p - (p >> 63 << 64),) for p in points], "fp long")
    found = S.near_links(df, 3, per_shard=300, sample=64)
    parent = {p: p for p in points}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in found.collect():
        i, j = find(x.a % 2**64), find(x.b % 2**64)
        parent[max(i, j)] = min(i, j)
    assert {p: find(p) for p in points} == brute_components(points)


def test_no_shard_or_block_above_its_limit(spark):
    from pyspark.sql import functions as F

    from loomline.llm.partition import in_blocks, split_until_small

    # rows of shard 1 go to 2 and 3 by their lowest bit and so on; those of key 0 modulo 8 end in a dense shard
    import pandas as pd

    def route(pdf, tree):
        level = int(tree)
        return np.arange(len(pdf)), pdf["shard"].to_numpy() * 2 + (pdf["k"].to_numpy() >> level & 1)

    def fit(pdf, share):
        level = int(pdf["shard"].iloc[0]).bit_length() - 1
        return str(level).encode() if pdf["k"].map(lambda k: k >> level & 1).nunique() > 1 else None

    rows = [(1, i if i % 3 else 8 * i) for i in range(1, 3000)] + [(1, 2**40 + i * 2**20) for i in range(700)]
    df = spark.createDataFrame(rows, "shard long, k long")
    got = split_until_small(df, "k", 200, fit, route, sample=100, salted=150)
    table = got.toPandas()
    assert sorted(table["k"]) == sorted(k for _, k in rows)
    sizes = table.groupby("shard")["k"].count()
    dense = table[table["blocks"] > 1].groupby("shard")["blocks"].first()
    assert all(n <= 200 or -(-n // 200) == dense[s] for s, n in sizes.items())
    pairs = in_blocks(got, "k").toPandas()
    assert isinstance(pairs, pd.DataFrame)
    meet = defaultdict(set)
    for (shard, _, _), part in pairs.groupby(["shard", "low", "high"]):
        assert len(part) <= 2 * 1.5 * 200
        for k in part["k"]:
            meet[shard, k].add(tuple(sorted(part["k"])))
    for shard, part in table.groupby("shard"):
        ks = part["k"].tolist()
        for a in ks[:5]:
            assert {k for group in meet[shard, a] for k in group} == set(ks)
    assert got.where(F.col("blocks") > 1).count() == 0 or len(dense)


def test_null_ids_and_empty_texts(spark):
    rows = [(None, "a b c d", "x"), (None, None, "y"), (5, "", "z"), (5, "", "z"), (7, "a b c d", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, root string")
    got = Counter((x.doc_id, x.component_id) for x in S.simhash_components(df).collect())
    assert got == Counter([(None, 7), (7, 7), (None, 5), (5, 5), (5, 5)])
