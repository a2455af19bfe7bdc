import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import embedding
from tessera.llm.queries import QUERIES


def brute(rows, t=0.9):
    ok = [i for i, (_, v) in enumerate(rows) if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    x = embedding.unit(np.array([rows[i][1] for i in ok])) if ok else np.zeros((0, 1))
    s = x @ x.T >= t
    n, parent = [0] * len(rows), {d: d for d, _ in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for p, i in enumerate(ok):
        for q in np.flatnonzero(s[p]):
            if q != p:
                n[i] += 1
                a, b = find(rows[i][0]), find(rows[ok[q]][0])
                parent[max(a, b)] = min(a, b)
    return sorted((d, n[i], find(d), find(d) == d) for i, (d, _) in enumerate(rows))


def got(df):
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect())


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert got(QUERIES["op5_embedding_dedup"](spark, f"/root/testdata/{sf}")) == brute(rows)


def test_recall_on_noisy_groups(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 64))
    x = np.concatenate([b + rng.normal(0, 0.33, (rng.integers(1, 40), 64)) for b in base])
    x = np.concatenate((x, x[:50]))
    rows = [(int(i), [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    out = got(embedding.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")))
    want = brute(rows)
    found, true = sum(r[1] for r in out), sum(r[1] for r in want)
    print("recall", found / true)
    assert 0.99 <= found / true <= 1 and all(a[1] <= b[1] for a, b in zip(out, want))


def test_cases(spark):
    v = [1.0] + [0.0] * 7
    w = [0.0, 1.0] + [0.0] * 6
    rows = [(1, v), (1, v), (4, [2.0] + [0.0] * 7), (2, None), (3, [0.0] * 8), (5, [None] + v[1:]), (6, [float("nan")] + v[1:]), (7, [float("inf")] + v[1:]), (8, w), (9, w), (9, [-1.0] + [0.0] * 7), (0, [-2.0] + [0.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("kept", F.lit("clash"))
    assert got(embedding.near_duplicates(df)) == brute(rows)
    assert embedding.near_duplicates(df.limit(0)).count() == 0
    assert got(embedding.near_duplicates(df.where("vec_id = 2"))) == [(2, 0, 2, True)]


def test_copies_do_not_hide_small_groups(spark):
    rng = np.random.default_rng(5)
    hot = rng.normal(size=64)
    x = np.concatenate([np.tile(hot, (1500, 1)), *(b + rng.normal(0, 0.32, (10, 64)) for b in rng.normal(size=(20, 64))), rng.normal(size=(600, 64))])
    rows = [(int(i), [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    out = {r[0]: r[1] for r in got(embedding.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")))}
    u = embedding.unit(np.array([v for _, v in rows[1500:]]))
    want = (u @ u.T >= 0.9).sum(1) - 1
    assert want.sum() > 300 and out[0] == 1499
    found = sum(out[1500 + i] for i in range(len(u)))
    print("recall", found / want.sum())
    assert found >= 0.995 * want.sum()


def test_lengths_are_compared_each_for_itself(spark):
    rng = np.random.default_rng(9)
    rows = []
    for dim in (1, 3, 4, 5, 64, 65, 100):
        base = rng.normal(size=(12, dim))
        for v in np.concatenate((base, base + rng.normal(0, 0.2, base.shape), base[:3])):
            rows.append((len(rows), [float(np.float32(c)) for c in v]))
    # the same numbers at other lengths, with zeros behind, are no copies
    rows += [(len(rows) + k, rows[70][1] + [0.0] * k) for k in range(3)] + [(900, []), (901, [1e300, -1e300]), (902, [1e-300, -1e-300])]
    lengths = {len(v) for _, v in rows}
    want = {r[0]: r for n in lengths for r in brute([x for x in rows if len(x[1]) == n])}
    out = got(embedding.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")))
    assert out == sorted(want.values())


def test_links_are_symmetric_and_recall_holds_without_sampled_pairs(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(3000, 64))
    near = base[:200] + rng.normal(0, 0.36, (200, 64))
    x = np.concatenate((base, near))
    rows = [(int(i), [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    monkeypatch.setattr(embedding, "PROBES", 20)
    out = {r[0]: r for r in got(embedding.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")))}
    u = embedding.unit(np.array([v for _, v in rows]))
    s = u @ u.T >= 0.9
    np.fill_diagonal(s, False)
    pairs = [(int(a), int(b)) for a, b in zip(*np.nonzero(s)) if a < b]
    assert len(pairs) > 100
    # whoever has one partner shares its link with it
    assert all(out[a][1] == out[b][1] for a, b in pairs if s[a].sum() == s[b].sum() == 1)
    found = sum(r[1] for r in out.values()) / 2
    print("recall", found / len(pairs))
    assert found >= 0.99 * len(pairs)
