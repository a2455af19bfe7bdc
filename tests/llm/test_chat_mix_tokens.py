import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, mixing, tokens
from tessera.llm.queries import ORACLES, QUERIES
from tests.oracle import compare

SF = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, name):
    assert compare(spark, QUERIES[name], ORACLES[name], SF) > 0


def test_chat_round_trip(spark):
    odd = ["", "</turn>", "<\\/turn>", "\\", "<turn>x<says/>y<next/>", "\\\\<says/>", "é😀\n<", None]
    rows = [(1, i, ["user", "assistant", "assistant", None, "<turn>\n"][i % 5], t) for i, t in enumerate(odd)] + [(2, None, "assistant", "a"), (2, None, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit("clash"))
    out = {r.conv_id: r for r in chat.format_chats(df).withColumn("back", chat.read_back(F.col("formatted"))).collect()}
    back = [(b.role, t) for b in out[1].back for t in b.texts]
    assert back == [(r[2] or "", r[3] or "") for r in rows[:8]]
    unescape = lambda s: __import__("re").sub(r"\\(.)", r"\1", s, flags=16)
    loss = [unescape(out[1].formatted[s.start : s.end]) for s in out[1].loss_spans]
    assert loss == [t or "" for _, _, r, t in rows[:8] if r == "assistant"]
    assert len(out[2].back) == 1 and len(out[2].back[0].texts) == 2
    assert chat.digest(chat.format_chats(df.limit(0))).count() == 0


def test_long_conversations_take_linear_time(spark):
    import time

    def seconds(n):
        turn = [F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role")]
        df = spark.range(n).select(*turn, F.repeat(F.lit("ab é<"), 20).alias("text"))
        began = time.time()
        (row,) = chat.digest(chat.format_chats(df)).collect()
        assert row.n_turns == n and row.loss_chars == n // 2 * 100
        return time.time() - began

    seconds(100)
    assert seconds(16_000) < 6
    assert seconds(64_000) < 12


def test_masks_agree_in_code_points_and_bytes(spark):
    docs = spark.read.parquet(f"{SF}/conversations.parquet").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" é😀</turn>")))
    for r in chat.format_chats(docs).collect():
        raw = r.formatted.encode()
        assert all(raw[s["from"] : s["to"]].decode() == r.formatted[s.start : s.end] for s in r.loss_spans)
        assert all(a.end < b.start for a, b in zip(r.loss_spans, r.loss_spans[1:]))


def test_golden_points_do_not_overflow(spark):
    ids = [0, 1, 5, 2**31 + 7, 3_500_000_000, 2**40 + 12345]
    rows = spark.createDataFrame([(i,) for i in ids], "i bigint").select("i", mixing.golden(F.col("i")).alias("u")).collect()
    assert all(r.u == (r.i * mixing.STEP % 2**32) / 2**32 for r in rows)


def test_mix_of_many_sources(spark, tmp_path):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 1500}" if i % 3 else "hot") for i in range(4000)] + [(-1, "a b", None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = __import__("duckdb").connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(ORACLES["op6_mixing"]).fetchall())
    got = sorted(tuple(r) for r in QUERIES["op6_mixing"](spark, str(tmp_path)).collect())
    assert all(a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-6 and a[4] == b[4] for a, b in zip(want, got)) and len(want) == len(got)


def test_mix_cases(spark):
    rows = [(1, "a b c", "en", "x", 1), (1, "a b c", "en", "x", 1), (2, None, None, None, None), (3, "", None, None, 0), (None, "q " * 50, None, "y", 1), (5, "z", "", "tiny", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("target", F.lit(1))
    out = mixing.taken(df).collect()
    assert len(out) == 6
    assert all(r.taken <= 3 * r.size for r in out)
    got = sum(r.taken for r in out)
    assert 50 <= got <= 57
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.taken(df).collect()), key=str)
    assert mixing.taken(df.limit(0)).count() == 0


def test_mix_schedule_is_even(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, pieces = mixing.mix(docs)
    goals = {r.sid: r.target for r in rows.select("sid", "target").distinct().collect()}
    slots = pieces.select("slot", "sid").distinct().collect()
    n, total = len(slots), sum(goals.values())
    half = [r for r in slots if r.slot < n // 2]
    for sid, goal in goals.items():
        assert abs(sum(r.sid == sid for r in half) - len(half) * goal / total) < 20


def test_token_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = ["", None, " ", "don't STOP", "a<|endoftext|>b <|startoftext|>", "x\u2003y\x1cz", "e\u0301 \u0301a", "12 345 …!? ΣΑΣ ΑΣ\tİ", "ab" * 20000, "\ufeff \u00a0q"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)] + [(0, "dup dup dup")], "doc_id bigint, text string").withColumn("n_tokens", F.lit("clash"))
    out = tokens.count_tokens(df, path, 3, prefixes=True).collect()
    count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    assert sorted((r.doc_id, r.n_tokens, r.n_bytes) for r in out) == sorted((i, count(x or ""), len((x or "").encode())) for i, x in [*enumerate(texts), (0, "dup dup dup")])
    for r in out:
        raw = (texts[r.doc_id] or "").encode() if r.n_bytes != 11 else b"dup dup dup"
        assert len(raw) == r.n_bytes and count(raw[: r.cut_bytes].decode()) <= 3
        own = tokens.counts(tokens.unpack(r.prefix_table, r.n_bytes))
        assert len(own) == r.n_bytes and (not len(own) or own[-1] == r.n_tokens)
    plain = {(r.doc_id, r.n_bytes): r.cut_bytes for r in tokens.count_tokens(df, path, 3).collect()}
    assert plain == {(r.doc_id, r.n_bytes): r.cut_bytes for r in out}
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    whole = [len(e.ids) for e in t.encode_batch(docs, add_special_tokens=False)]
    assert tokens.check_splits(path, docs)
    got = {r.doc_id: r.n_tokens for r in QUERIES["op10_token_counts"](spark, SF).collect()}
    ids = [r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    assert [got[i] for i in ids] == whole
    assert tokens.count_tokens(df.limit(0), path).count() == 0


def test_every_prefix_has_the_library_count():
    """Texts of many kinds, prefix by prefix; prefixes that part a letter from its marks are defined to end before it."""
    import random
    import unicodedata

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, counter, rng = Tokenizer.from_file(path), tokens.ChunkCounter(path, cache=20_000), random.Random(2)
    alphabet = "abcdefghijklmnopqrstuvwxyz'!.<|>0123ABCéßñяжΣİẞ日本한글\ue000😀 \t\n\u2003\u00a0\x1c"
    texts = ["they'reX 'r'll''s !'s", "a<|endoftext|>b!!<|startoftext|><|endoftext|>!", "<|endoftex<|endoftext|>", "ΣΑΣ", "zz" * 300, "-" * 500, "日本語のテキスト" * 20]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    texts += ["".join(rng.choice(["the", "ing", "ation", "un", "s", "'s", "xx", "!!", "==", "1", " ", "ß", "ção"]) for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    for text in texts:
        raw = text.encode()
        got = tokens.counts(tokens.prefix_steps(raw, counter))
        ends = np.cumsum([len(c.encode()) for c in text]) - 1
        assert got[ends].tolist() == [len(t.encode(text[: i + 1], add_special_tokens=False).ids) for i in range(len(text))], text
        for limit in (0, 1, 5):
            fits = [i for i in range(len(text) + 1) if len(t.encode(text[:i], add_special_tokens=False).ids) <= limit]
            assert tokens.cut(raw, counter, limit) == len(text[: fits[-1]].encode().rstrip())
    text = "e\u0301a\u0327\u0301b \u1100\u1161\u11a8x"
    got = tokens.counts(tokens.prefix_steps(text.encode(), counter))
    whole = [i for i in range(1, len(text) + 1) if unicodedata.normalize("NFC", text).startswith(unicodedata.normalize("NFC", text[:i])) and (i == len(text) or not unicodedata.combining(text[i])) and text[i : i + 1] not in "\u1161\u11a8"[: 2 * (i < len(text))]]
    for i in whole:
        assert got[len(text[:i].encode()) - 1] == len(t.encode(text[:i], add_special_tokens=False).ids)
