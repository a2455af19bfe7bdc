from pyspark.sql import functions as F

from tessera.llm import langid
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    out = QUERIES["op3_language_id"](spark, SF).collect()
    assert len(out) == len(truth)
    held = [r for r in out if r.held_out]
    right = sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held)
    print("held-out accuracy", right, "least score", min(r.score for r in out))
    assert right > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_cases(spark):
    rows = [(i, t, lang) for i in range(9) for t, lang in [("the cat and the dog", "en"), ("der hund und die katze", "de")]]
    rows += [(50, None, "en"), (51, "123 !?", "de"), (52, "", None), (None, "the dog", None), (53, "und der " * 20000, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit(1))
    out = langid.identify(df).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r.lang_pred for r in out}
    assert [by[k] for k in (50, 51, 52, None, 53)] == ["und", "und", "und", "en", "de"]
    assert langid.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_bundling_is_the_sum_of_bound_trigrams():
    import numpy as np

    codes = langid.Codes.get()
    text = "Aé b1a"
    want = np.zeros(langid.DIM)
    letters = " aé b a "
    for i in range(len(letters) - 2):
        a, b, c = (langid.Codes.draw(ord(ch)).astype(int) for ch in letters[i : i + 3])
        want += np.roll(a, 2) * np.roll(b, 1) * c
    assert (codes.bundle([[codes.trigrams(text)]])[0] == want).all()


def test_every_letter_has_its_own_vector():
    import numpy as np

    text = "".join(map(chr, range(0x4E00, 0x4E00 + 3000))) + " слово"
    codes, late = langid.Codes(), langid.Codes()
    got = codes.bundle([[codes.trigrams(text)]])[0]
    late.trigrams("слово" + "".join(map(chr, range(0xAC00, 0xAC00 + 2000))))
    letters = f" {text} "
    a, b, c = (np.stack([langid.Codes.draw(ord(ch)).astype("i4") for ch in letters[i : len(letters) - 2 + i]]) for i in range(3))
    assert (got == (np.roll(a, 2, 1) * np.roll(b, 1, 1) * c).sum(0)).all()
    assert (late.bundle([[late.trigrams(text)]])[0] == got).all()


def test_order_and_partitions_do_not_matter(spark):
    import random

    draw = random.Random(4)
    letters = [*map(chr, range(0x4E00, 0x4E00 + 4000)), *map(chr, range(0xAC00, 0xAC00 + 1500))]
    draw.shuffle(letters)
    texts = ["".join(letters[at : at + 25]) for at in range(0, 5500, 25)]
    rows = [(i, t * 2, "han" if t[0] < "鿿" else "kor") for i, t in enumerate(texts)] + [(900 + i, texts[i][:12], None) for i in range(0, 220, 7)]

    def result(rows, parts):
        df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(parts)
        langs, protos = langid.train(df)
        return langs, protos.tobytes(), sorted((r.doc_id, r.lang_pred, round(r.score, 12)) for r in langid.identify(df).collect())

    want = result(rows, 1)
    draw.shuffle(rows)
    assert result(rows, 5) == want


def test_long_texts_are_summed_exactly():
    codes = langid.Codes.get()
    grams, counts = codes.trigrams("ab")
    big = [(grams, counts * (2**24 + 1))]
    want = codes.bundle([[(grams, counts)]])[0] * (2**24 + 1)
    assert (codes.bundle([big])[0] == want).all()
