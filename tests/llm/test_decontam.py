import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import decontam as D
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute(docs, items):
    """Coverage of every item in every whole document, without an index."""
    out = []
    items = [(i, D.words_of(t.lower()), D.split_item(t)) for i, t in items if t and D.words_of(t.lower())]
    for d, text in docs:
        w = D.words_of((text or "").lower())
        grams = {n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for n in range(1, 6)}
        for i, words, ask in items:
            n = min(5, len(words))
            mask = np.zeros(len(words), bool)
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in grams[n]:
                    mask[k : k + n] = True
            if mask.mean() >= D.OVERLAP or (mask[:ask].mean() >= D.QUESTION and ask < len(mask) and mask[ask:].any()):
                out.append((d, i))
    return sorted(out, key=str)


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    out = [(r.doc_id, r.item_id) for r in QUERIES["op9_decontamination"](spark, SF).collect()]
    print(len(out), "leaks")
    assert sorted(out, key=str) == brute(docs, items) and out


def test_retrieval_is_exact():
    rng = random.Random(2)
    vocab = [f"w{int(rng.paretovariate(0.6)) % 900}" for _ in range(4000)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(3, 150)))) for i in range(400)]
    df, n, total = D.Counter(), 0, 0
    for _, t in items:
        for part in D.segments(D.words_of(t)):
            df.update(set(part))
            n, total = n + 1, total + len(part)
    index = D.Index(items, df, n, total / n)
    passages = [[rng.choice(vocab) for _ in range(60)] + (D.words_of(items[p][1])[:50] if p % 3 == 0 else []) for p in range(60)]
    keys = sorted({(p, index.vocab[w]) for p, words in enumerate(passages) for w in words if w in index.vocab})
    got = {(p, s): round(x, 9) for p, s, x in index.retrieve(np.array([k[0] for k in keys]), np.array([k[1] for k in keys]))}
    want = {}
    for p, t in keys:
        for k in np.flatnonzero(index.term == t):
            want[p, int(index.seg[k])] = want.get((p, int(index.seg[k])), 0) + index.impact[k]
    assert got == {k: round(v, 9) for k, v in want.items() if v >= D.THRESHOLD} and got


def test_cases(spark):
    rng = random.Random(5)
    item = lambda n: " ".join(f"q{rng.randrange(3000)}" for _ in range(n))
    items = [(1, item(30) + ". " + item(10)), (2, item(200)), (3, None), (4, "--"), (5, "tiny item"), (None, item(20))]
    docs = [(0, None), (1, ""), (2, "x y z " * 40 + items[0][1].upper().replace(" ", "!! ")), (2, items[0][1]), (3, "u " * 100 + items[1][1] + " v" * 5000), (4, "a tiny item b"),
            (5, " ".join(items[0][1].split()[:18])), (6, items[5][1] + " " + items[1][1][:900]), (7, item(500))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("overlap", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    out = [(r.doc_id, r.item_id) for r in D.contaminated(df, bench).collect()]
    assert sorted(out, key=str) == brute(docs, items)
    assert sorted(r.doc_id for r in D.clean(df, bench).collect()) == [0, 1, 5, 7]
    assert D.contaminated(df, bench.limit(0)).count() == 0 and D.clean(df, bench.limit(0)).count() == len(docs)
    assert D.contaminated(df.limit(0), bench).count() == 0


def test_short_question_and_start_of_a_long_answer(spark):
    rng = random.Random(8)
    item = lambda n, c: " ".join(f"{c}{rng.randrange(9000)}" for _ in range(n))
    fill = lambda n: " ".join(f"f{rng.randrange(50)}" for _ in range(n))
    items = [(i, item(9, "q") + ". " + item(55, "a")) for i in range(20)] + [(20, item(60, "s"))]
    docs = [(i, f"{fill(70)} {' '.join(t.split()[:11])} {fill(70)}") for i, t in items[:20]]
    pieces = items[20][1].split()
    docs.append((20, " ".join(f"{' '.join(pieces[k : k + 10])} {fill(200)}" for k in range(0, 50, 10))))
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(docs, items)
    assert len(want) == 21
    assert sorted([(r.doc_id, r.item_id) for r in D.contaminated(df, bench).collect()], key=str) == want
    assert D.clean(df, bench).count() == 0


def test_many_shards_and_slices(spark, monkeypatch):
    """The same leaks whether the benchmark is one shard or many, each document and item once."""
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet").limit(400), spark.read.parquet(f"{SF}/benchmark.parquet")
    bench = bench.union(bench.where("item_id % 7 = 0"))
    rows = lambda df: sorted(((r.doc_id, r.item_id, round(r.score, 6), r.overlap) for r in df.collect()), key=str)
    want, kept = rows(D.contaminated(docs, bench)), D.clean(docs, bench).count()
    monkeypatch.setattr(D, "BYTES", 900)
    parts = D.shards(bench)
    assert len(parts) > 5
    assert rows(D.contaminated(docs, bench)) == want and want
    assert D.clean(docs, bench).count() == kept


def made(rng, n_items, n_docs, most):
    """Items of words that repeat, and documents with pieces of them, just around what makes a leak."""
    vocab = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(3000)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = []
    for i in range(n_items):
        w = words(rng.choice((1, 3, 5, 6, 9, 20, 63, 64, 65, 90, rng.randrange(1, most))))
        at = rng.choice((0, 1, 3, 34, len(w) // 2, len(w) - 1))
        items.append((i, " ".join(w[:at]) + ". " * (0 < at < len(w)) + " ".join(w[at:])))
    docs = []
    for d in range(n_docs):
        text = words(rng.randrange(20))
        for _, t in rng.sample(items, 2):
            w = D.words_of(t)
            share, at = rng.choice((0.55, 0.6, 0.65, 0.9)), 0
            while at < len(w):
                piece = rng.randrange(5, 16)
                # pieces in any order, with others' words between them
                text = (text, w[at : at + piece])[:: rng.choice((1, -1))]
                text = [*text[0], *words(rng.randrange(1, 4)), *text[1]]
                at += piece + round(piece * (1 / share - 1) * rng.random() * 2)
            if rng.random() < 0.3:
                text += words(200) + w[: D.split_item(t) + rng.randrange(3)]
        docs.append((d, " ".join(text)))
    return docs, items


def index_of(items):
    parts = [part for _, t in items for part in D.segments(D.words_of(t))]
    return D.Index(items, D.Counter(w for part in parts for w in set(part)), len(parts), sum(map(len, parts)) / len(parts))


def test_retrieval_names_every_item_that_is_judged(monkeypatch):
    """What is not retrieved is not judged, and nothing that a document holds is missed by retrieval."""
    docs, items = made(random.Random(4), 60, 250, 300)
    index, texts = index_of(items), [t for _, t in docs]
    want = brute(docs, items)
    assert len(want) > 100
    assert sorted([(d, h[0]) for d, found in enumerate(D.scan(texts, index)) for h in found], key=str) == want
    retrieve, odd = index.retrieve, {s for s in range(len(index.owner)) if index.owner[s] % 2}
    monkeypatch.setattr(index, "retrieve", lambda p, t: [r for r in retrieve(p, t) if r[1] in odd])
    assert sorted([(d, h[0]) for d, found in enumerate(D.scan(texts, index)) for h in found], key=str) == [x for x in want if x[1] % 2]
    monkeypatch.setattr(index, "retrieve", lambda p, t: [])
    assert not any(D.scan(texts, index))


def test_least_scores_against_all_coverings():
    """No choice of shingles that makes a leak costs less than the least score of the item."""
    rng = random.Random(6)
    items = [(i, " ".join(rng.choice("abcdefghijklmn") for _ in range(rng.randrange(1, 15)))) for i in range(40)]
    index = index_of(items)
    for k, (_, words, ask) in enumerate(index.items):
        g, best = min(5, len(words)), np.inf
        mine = {w: float(index.impact[(index.seg == k) & (index.term == index.vocab[w])].sum()) for w in words}
        for some in range(1, 2 ** (len(words) - g + 1)):
            mask = np.zeros(len(words), bool)
            for p in range(len(words) - g + 1):
                if some >> p & 1:
                    mask[p : p + g] = True
            if D.holds(mask, ask):
                best = min(best, sum(mine[w] for w in {words[p] for p in np.flatnonzero(mask)}))
        assert best >= D.THRESHOLD
