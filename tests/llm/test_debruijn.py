import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import debruijn
from tessera.llm.queries import QUERIES


def brute(rows):
    """Every window of every document in a dictionary of first places."""
    docs = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in docs:
        for s in range(len(w) - 19):
            key, here = tuple(w[s : s + 20]), (-1 if d is None else d, s)
            first[key] = min(first.get(key, here), here)
    out = []
    for d, w in docs:
        keep = [True] * len(w)
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] < (-1 if d is None else d, s):
                keep[s : s + 20] = [False] * 20
        kept = " ".join(x for x, k in zip(w, keep) if k)
        out.append((d, len(w), len(w) - sum(keep), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = got(QUERIES["op2_substring_dedup"](spark, f"/root/testdata/{sf}"))
    assert out == brute(rows) and any(r[2] for r in out)


def test_cases(spark):
    rng = random.Random(9)
    words = lambda n, v=10**6: [f"w{rng.randrange(v)}" for _ in range(n)]
    p, q = words(60), words(25)
    texts = [None, "", "a b", words(19), words(20), p, words(7) + p + words(5) + p[:30] + words(3) + q, q + p[10:40], p[:19] + words(9), ["x"] * 70, ["x"] * 19, ["x", "y"] * 40, words(3) + q[:20], q[1:21] + ["é"]]
    rows = [(i, t if t is None or isinstance(t, str) else rng.choice([" ", "\n", "\t "]).join(t)) for i, t in enumerate(texts)]
    rows += [(30 + i, " ".join(words(120, 3))) for i in range(12)] + [(5, rows[5][1]), (5, rows[7][1]), (None, rows[6][1]), (50, " ".join(words(3) * 9000))]
    for i in range(60):
        a = rng.randrange(40)
        rows.append((100 + i * 37 % 61, " ".join(words(rng.randrange(12)) + p[a : a + rng.randrange(60)] + words(rng.randrange(12)))))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("kept", F.lit("clash"))
    assert got(debruijn.dedup(df)) == brute(rows)
    assert debruijn.dedup(df.limit(0)).count() == 0


def test_a_text_that_many_copy_from(spark, monkeypatch):
    """One source is asked for many different ranges: they come in several lists."""
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    source = words(600)
    rows = [(0, " ".join(source))]
    for i in range(1, 400):
        a = rng.randrange(570)
        piece = source[a : a + rng.randrange(20, 60)]
        rows.append((i, " ".join(words(3) + piece + words(2) + (piece if i % 9 == 0 else []))))
    monkeypatch.setattr(debruijn, "PLACES", 20)
    assert got(debruijn.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"))) == brute(rows)
