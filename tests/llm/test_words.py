import random

import numpy as np

from tessera.llm import words


def test_one_hash_for_each_word():
    rng = random.Random(1)
    parts = [bytes(rng.choice(b"ab\0\xc3\x1c\x85") for _ in range(rng.randrange(0, 5))) for _ in range(3000)]
    raw = b"".join(p + rng.choice([b" ", b"\n", b"\t ", b"\r\x0b\x0c"]) for p in parts)
    plain = raw.split()
    h = words.word_hashes(raw)
    assert len(h) == len(plain)
    seen = {}
    for w, x in zip(plain, h.tolist()):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_chunks_do_not_matter(monkeypatch):
    raw = b" ".join(b"w%d" % (i * i % 97) for i in range(4000)) + b"x" * 500
    whole = words.word_hashes(raw)
    monkeypatch.setattr(words, "CHUNK", 64)
    assert (words.word_hashes(raw) == whole).all()
    assert [len(words.word_hashes(t)) for t in (None, b"", b" \n", b"a")] == [0, 0, 0, 1]
    assert np.unique(words.word_hashes(b"a b " * 100)).size == 2
