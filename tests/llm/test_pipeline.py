import duckdb
import pytest

import corpus_pipeline as P
from tessera.llm.queries import ORACLES
from tests.llm.test_decontam import brute as leaks
from tests.llm.test_minhash import brute as groups
from tests.llm.test_secretscan import brute as secrets
from tests.oracle import compare

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.01"


def plain(rows, items):
    """Every stage in plain Python, over rows (doc_id, text, lang, source, n_chars)."""
    stages = [[r for r in rows if r[1] and any(ch.isalpha() for ch in r[1])]]
    comp = {d: c for d, _, c, _ in groups([(r[0], r[1]) for r in stages[-1]])}
    stages.append(list({(r[0], r[1]): r for r in stages[-1] if comp[r[0]] == r[0]}.values()))
    bad = {d for d, _ in leaks([(r[0], r[1]) for r in stages[-1]], items)}
    stages.append([r for r in stages[-1] if r[0] not in bad])
    out = []
    for r in stages[-1]:
        text, at = "", 0
        for a, b, _ in secrets(r[1]):
            text += r[1][at:a] + "[SECRET]" if a >= at else ""
            at = max(at, b)
        text += r[1][at:]
        out.append((r[0], text, r[2], r[3], len(text) if text != r[1] else r[4]))
    return [*stages, out]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_stages_against_plain_version(spark, sf):
    sf = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = plain([tuple(r) for r in docs.collect()], items)
    for (name, stage), rows in zip(P.STAGES, want):
        docs = P.staged(stage(spark, docs, sf))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted(map(tuple, docs.collect())) == sorted(rows), name
        print(name, len(rows))
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", want[-1])
    mix = con.execute(ORACLES["op6_mixing"]).fetchall()
    got = [(r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in P.run(spark, sf).collect()]
    assert sorted(got) == sorted((a, b, c, round(d, 6), e) for a, b, c, d, e in mix)


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "12 !", "en", "a", 4), (4, "one two", "en", None, 7), (4, "one two", "en", None, 7), (None, "le chat", "fr", "b", 7), (5, "ein " * 30000, "de", "b", 1), (6, "ONE two", None, "c", 7)]
    docs = spark.createDataFrame(rows, DOCS)
    for _, stage in P.STAGES[:4]:
        docs = P.staged(stage(spark, docs, SF))
    assert sorted((r.doc_id or 0) for r in docs.collect()) == [0, 4, 5]
    assert P.mix_sources(spark, docs, SF).count() == 3
    empty = spark.createDataFrame([], DOCS)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_run_against_sql(spark, sf):
    assert compare(spark, P.run, P.ORACLE_SQL, f"/root/testdata/{sf}") > 0


def test_an_unlabelled_corpus_keeps_its_texts(spark):
    docs = spark.createDataFrame([(1, "some text", None, "a", 9), (2, "12 !", None, "a", 4), (3, None, None, "b", None)], DOCS)
    assert [r.doc_id for r in P.language_id(spark, docs, SF).collect()] == [1]
