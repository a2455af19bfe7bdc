import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import links, minhash
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def shingle_set(text):
    low = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """Exact components by counting shared shingles."""
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sets = [(d, shingle_set(t)) for d, t in rows]
    index = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for g in s:
            index[g].append(i)
    for i, (d, s) in enumerate(sets):
        shared = defaultdict(int)
        for g in s:
            for j in index[g]:
                if j < i:
                    shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j][1]) - n):
                a, b = find(d), find(sets[j][0])
                parent[max(a, b)] = min(a, b)
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets)


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op8_minhash_dedup"](spark, f"/root/testdata/{sf}")) == brute(rows)


def test_groups_of_edits(spark):
    rng = random.Random(4)
    rows, doc = [], 0
    for size in (2, 3, 40, 200):
        base = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for _ in range(size):
            words = base[:]
            for _ in range(rng.randrange(0, 5)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((doc * 7 % 997, " ".join(words)))
            doc += 1
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one two"), (2004, "ONE two"), (2005, "a b c d e"), (2006, "A b\tc d e"), (2007, "É a b c d"), (2008, "é a b c d"), (2009, "z " * 30000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("component_id", F.lit("clash"))
    assert got(minhash.near_duplicates(df)) == brute(rows)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_repeated_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a), (5, a), (5, b), (3, b), (9, a), (11, "lone words here now ok")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(minhash.near_duplicates(df)) == brute(rows)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    out = {r.node: r.component for r in links.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert out == {n: find(n) for e in edges for n in e if e[0] != e[1]}


def test_whole_regions(spark, monkeypatch):
    """Families of different texts over one template, larger than any window: pairs inside them are all found."""
    rng = random.Random(6)
    fresh = lambda n: [f"y{rng.randrange(10**7)}" for _ in range(n)]
    base, rows = [f"t{i}" for i in range(99)], []
    # any two texts are at 0.69, the two of a pair at 0.77
    for pair in range(150):
        more = fresh(6)
        for _ in range(2):
            rows.append((len(rows) * 7919 % 10007, " ".join(base + more + fresh(15))))
    monkeypatch.setattr(minhash, "WINDOW", 1)
    monkeypatch.setattr(minhash, "WIDE", 1)
    monkeypatch.setattr(minhash, "NEAR", 1)
    monkeypatch.setattr(minhash, "BLOCK", 40, raising=False)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute(rows)
    assert sum(not r[3] for r in want) > 100
    assert got(minhash.near_duplicates(df)) == want
