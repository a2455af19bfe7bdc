"""Token counts by prefix dynamic programming.

For every prefix of a text the exact number of tokens is known that the tokenizer gives for that prefix alone; counts,
truncation and budget questions are answered without encoding again.

A text is cut at ASCII white space into chunks, and a chunk into the tokenizer's words; neither is joined by a merge, so a
prefix costs what the whole words before its last one cost, and the last one's beginning. Inside a word, byte pair
encoding has this recurrence: the encoding of the first i symbols ends with the one token t whose neighbour, the last token
of the first i - |t| symbols, stands next to it when the two are encoded as a pair; its count is one more than theirs. A
word's last symbol carries the word-end mark. So a word's row holds count and last token of each prefix, taken as the inside
of a longer word, and a prefix taken as a word is one step of the recurrence from the row. Whether two tokens stand next
to each other is read off the merges that build them, along their common border. Rows are kept by prefix, as words share
them, and counts by word and by chunk; a text's table is their running sum, in which a limit is looked up by bisection,
and then in the rows of the one chunk that crosses it. `table` writes the counts out for every byte of a text.

The library itself counts every distinct chunk with letters beyond ASCII too. Where it disagrees (letters that its
Unicode tables and Python's class differently), its count holds, and inside that chunk a prefix has the tokens that end in it.

Defined cases: a prefix that ends inside a code point, or parts a letter from marks that compose with it, counts as the
prefix before that letter; null text is empty; special strings inside texts are handled as the library does by
default; rows are independent, so ties, repeated rows and empty tables need nothing; other columns are ignored. Use only
with a tokenizer of the kind of word_bpe_49k.json; `check_splits` tests it.

Memory is bounded: a slice of texts with their tables, and the memories named below, per worker.
"""

from __future__ import annotations

import contextlib
import functools
import json
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.lean import arrow

#: Bytes that a worker's chunks take, about, with so many beside each one's text; and entries of the memories of words, prefixes and pairs.
CACHE, BESIDE, ENTRIES = 160_000_000, 140, 600_000
#: Prefixes of at most so many symbols are remembered by themselves.
SHARED = 24
_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the rest from 256 up, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


LETTERS = byte_letters()


def byte_word(w: str) -> str:
    return w if w.isascii() and w.isprintable() else "".join([LETTERS[b] for b in w.encode("utf-8", "surrogatepass")])


class PrefixCounts:
    """Counts of every prefix of a word, and of a chunk of words, for one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.mark = model["end_of_word_suffix"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_at = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        # the library's white space is Unicode's, which leaves out four control characters that Python counts in
        self.split = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        ids = {t: i for t, i in model["vocab"].items() if t not in self.special}
        # each merge makes one token; rank and parts of the merge that makes it, none for single symbols
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(model["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            self.rank[ids[left], ids[right]] = r
            self.made[ids[left + right]] = r, ids[left], ids[right]
        #: token without the mark: its ids inside a word and at a word's end, -1: none
        self.vocab: dict[str, tuple[int, int]] = {}
        for t, i in ids.items():
            name, ends = (t[: -len(self.mark)], True) if t.endswith(self.mark) else (t, False)
            inside, ending = self.vocab.get(name, (-1, -1))
            self.vocab[name] = (inside, i) if ends else (i, ending)
        self.longest = max(map(len, self.vocab))
        self.edges: tuple[dict, dict] = {}, {}
        self.sound: dict[int, bool] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.shared: dict[str, tuple[int, int, int]] = {}
        self.words: dict[str, int] = {}

    def edge(self, token: int, side: int) -> tuple[tuple[int, float], ...]:
        """The symbols at a token's right (0) or left (1) end while it is built, each with the rank that ends its time."""
        known = self.edges[side].get(token)
        if known is None:
            out, until, at = [], float("inf"), token
            while True:
                out.append((at, until))
                if at not in self.made:
                    break
                until, left, right = self.made[at]
                at = left if side else right
            known = self.edges[side][token] = tuple(reversed(out))
        return known

    def joint(self, left: int, right: int) -> tuple[int, int] | None:
        """The first pair of symbols that encoding joins across the border of two tokens; None if it joins none."""
        a, b = self.edge(left, 0), self.edge(right, 1)
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = a[i], b[j]
            r = self.rank.get((x, y))
            # of equal ranks the leftmost is joined first
            if r is not None and r < x_until and r <= y_until:
                return x, y
            if x_until <= y_until:
                i += 1
                if i == len(a):
                    return None
            else:
                j += 1

    def is_whole(self, token: int) -> bool:
        """Whether the letters of a token, encoded alone, give that token."""
        known = self.sound.get(token)
        if known is None:
            known = True
            if token in self.made:
                _, left, right = self.made[token]
                known = self.is_whole(left) and self.is_whole(right) and self.joint(left, right) == (left, right)
            self.sound[token] = known
        return known

    def stands(self, before: int, token: int) -> bool:
        """Whether `token` stays a token of its own behind the token `before` (-1: at the start)."""
        known = self.pairs.get((before, token))
        if known is None:
            if len(self.pairs) >= ENTRIES:
                self.pairs.clear()
            known = self.pairs[before, token] = self.is_whole(token) and (before < 0 or self.joint(before, token) is None)
        return known

    def row(self, m: str) -> tuple[list[int], list[int], list[int]]:
        """For each number of first symbols of a word in byte letters, taken as the inside of a longer word: tokens, last token, its start."""
        count, last, start = [0], [-1], [0]
        shared, pairs, vocab, stands = self.shared, self.pairs, self.vocab, self.stands
        for i in range(1, len(m) + 1):
            known = shared.get(m[:i]) if i <= SHARED else None
            if known is None:
                # but one place fits, so the likeliest are looked at first: the last token grown by a symbol, then shorter ones
                s = start[-1]
                for at in (s, *range(i - 1, s, -1), *range(s - 1, max(0, i - self.longest) - 1, -1)):
                    ids = vocab.get(m[at:i])
                    if ids is not None and ids[0] >= 0:
                        fits = pairs.get((last[at], ids[0]))
                        if stands(last[at], ids[0]) if fits is None else fits:
                            known = count[at] + 1, ids[0], at
                            break
                else:
                    raise ValueError(f"no token ends {m[:i]!r}")
                if i <= SHARED:
                    if len(shared) >= ENTRIES:
                        shared.clear()
                    shared[m[:i]] = known
            count.append(known[0])
            last.append(known[1])
            start.append(known[2])
        return count, last, start

    def whole(self, m: str, i: int, count: list[int], last: list[int], start: list[int]) -> int:
        """Tokens of the first i symbols, taken as a word of its own: one step from the row of the symbols before."""
        pairs, s = self.pairs, start[i - 1]
        for at in (*range(s, i), *range(s - 1, max(0, i - self.longest) - 1, -1)):
            ids = self.vocab.get(m[at:i])
            if ids is not None and ids[1] >= 0:
                fits = pairs.get((last[at], ids[1]))
                if self.stands(last[at], ids[1]) if fits is None else fits:
                    return count[at] + 1
        raise ValueError(f"no word ends {m[:i]!r}")

    def total(self, w: str) -> int:
        """Tokens of a word; remembered."""
        known = self.words.get(w)
        if known is None:
            m = byte_word(w)
            known = self.whole(m, len(m), *self.row(m[:-1]))
            if len(w) <= 64:
                if len(self.words) >= ENTRIES:
                    self.words.clear()
                self.words[w] = known
        return known

    def word(self, w: str) -> list[int]:
        """Tokens of each prefix of a word, by code points."""
        m = byte_word(w)
        row = self.row(m[:-1])
        ends = range(1, len(w) + 1) if w.isascii() else accumulate(len(c.encode("utf-8", "surrogatepass")) for c in w)
        counts = [self.whole(m, i, *row) for i in ends]
        if len(w) > 2 and w[0] == "'" and w[1].isalpha():  # a contraction's beginning is two words
            counts[1] = counts[0] + self.total(w[1])
        return counts

    def plain(self, text: str) -> list[int]:
        """Tokens of each prefix of normalized text; letters outside the tokenizer's words, such as wide spaces, add none."""
        out: list[int] = []
        before = 0
        for m in self.split.finditer(text):
            if len(out) < m.start():
                out += [before] * (m.start() - len(out))
            out += [before + n for n in self.word(m[0])]
            before = out[-1]
        return out + [before] * (len(text) - len(out))

    def part(self, text: str) -> tuple[list[int], list[int]]:
        """(counts, bytes): prefixes of text without special strings, one for each letter with its marks."""
        pieces = list(text) if unicodedata.is_normalized("NFC", text) else composed(text)
        lower = [lowered(p) for p in pieces]
        counts = self.plain("".join(lower))
        if len(counts) > len(pieces):
            counts = [counts[e - 1] for e in accumulate(map(len, lower))]
        return counts, [len(p.encode()) for p in pieces]

    def chunk_total(self, text: str) -> int:
        """Tokens of a chunk."""
        if "<" not in text or not self.special_at.search(text):
            low = text.lower() if text.isascii() else "".join(map(lowered, text)) if unicodedata.is_normalized("NFC", text) else None
            if low is not None:
                known = self.words.get
                return sum([known(w) or self.total(w) for w in self.split.findall(low)])
        return sum(self.chunk(text))

    def chunk(self, text: str) -> list[int]:
        """For each byte of a chunk, the tokens that the prefix ending with it has more than the one before."""
        counts, sizes, at, first = [], [], 0, 0
        for m in [*self.special_at.finditer(text), None]:
            # up to the special string's last letter it is text like any other
            end = m.end() if m else len(text)
            own, own_sizes = self.part(text[at:end])
            if m and len(own):
                own[-1] = (self.part(text[at : m.start()])[0] or [0])[-1] + 1
            counts += [first + n for n in own]
            sizes += own_sizes
            at, first = end, counts[-1] if counts else 0
        # bytes inside a letter belong to the prefix before it
        return [step for size, b, n in zip(sizes, (0, *counts), counts) for step in (*[0] * (size - 1), n - b)]


@functools.lru_cache(65536)
def lowered(piece: str) -> str:
    """NFC, then each code point's lower case by itself."""
    return "".join(c.lower() for c in unicodedata.normalize("NFC", piece))


def composed(text: str) -> list[str]:
    """Pieces that normalization does not join: a letter with what composes with it."""
    out: list[str] = []
    for c in text:
        if out and (unicodedata.combining(c) or unicodedata.normalize("NFC", out[-1] + c) != unicodedata.normalize("NFC", out[-1]) + unicodedata.normalize("NFC", c)):
            out[-1] += c
        else:
            out.append(c)
    return out


_counters: dict[str, ChunkCounter] = {}


class ChunkCounter:
    """Token counts of white-space-free chunks, remembered up to a bound of bytes, and the tables of texts made of them."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encoder.no_truncation()
        self.encoder.no_padding()
        self.prefixes = PrefixCounts(path)
        self.known: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}
        self.cache, self.held = cache, 0

    @classmethod
    def of(cls, path: str) -> ChunkCounter:
        if path not in _counters:
            _counters[path] = cls(path)
        return _counters[path]

    def learn(self, chunks: set[bytes]) -> None:
        """Two generations: what a full cache still uses moves on, the rest is dropped."""
        if self.held > self.cache // 2:
            self.known, self.older, self.held = {}, self.known, 0
        new = chunks - self.known.keys()
        for chunk in new & self.older.keys():
            self.known[chunk] = self.older[chunk]
        self.held += sum(map(len, new)) + BESIDE * len(new)
        odd = []
        for chunk in new - self.older.keys():
            try:
                self.known[chunk] = self.prefixes.chunk_total(chunk.decode())
                if not chunk.isascii():
                    odd.append(chunk)
            except ValueError:  # letters that the tokenizer lacks
                odd.append(chunk)
        for at in range(0, len(odd), 20_000):
            part = odd[at : at + 20_000]
            self.known.update(zip(part, map(len, self.ask([c.decode() for c in part]))))

    def ask(self, chunks: list[str]) -> list[list[int]]:
        """The library's tokens of each chunk, by their ends, from one call: a token belongs to the chunk that it starts in."""
        starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, chunks), "i8", len(chunks)) + 1)))
        offsets = self.encoder.encode(" ".join(chunks), add_special_tokens=False).offsets
        first = np.fromiter((a for a, _ in offsets), "i8", len(offsets))
        bounds = np.searchsorted(first, starts).tolist()
        return [[e - s for _, e in offsets[a:b]] for s, a, b in zip(starts.tolist(), bounds, bounds[1:])]

    def steps(self, chunk: bytes) -> list[int]:
        """For each byte of a chunk, the tokens that the prefix ending with it has more than the one before."""
        text = chunk.decode()
        with contextlib.suppress(ValueError):
            out = self.prefixes.chunk(text)
            if sum(out) == self.known[chunk]:
                return out
        ends = sorted(self.ask([text])[0])
        by_letter = [bisect_right(ends, i) for i in range(1, len(text) + 1)]
        by_letter[-1] = len(ends)
        return [step for c, b, n in zip(text, (0, *by_letter), by_letter) for step in (*[0] * (len(c.encode()) - 1), n - b)]

    def totals(self, chunks: list[bytes]) -> np.ndarray:
        """Tokens of the prefixes that end with each chunk; call learn() first."""
        return np.cumsum(np.fromiter(map(self.known.__getitem__, chunks), "i8", len(chunks)))

    def table(self, text: bytes, chunks: list[bytes]) -> np.ndarray:
        """Steps of the prefix counts of a whole text, one for each byte; call learn() first."""
        own = {c: self.steps(c) for c in set(chunks)}
        out = np.zeros(len(text), "i4")
        out[~_space[np.frombuffer(text, "u1")]] = np.fromiter(chain.from_iterable(map(own.__getitem__, chunks)), "i4")
        narrow = out.astype("i1")
        return narrow if (narrow == out).all() else out

    def cut(self, text: bytes, chunks: list[bytes], totals: np.ndarray, limit: int) -> int:
        """Bytes of the longest prefix of whole code points with at most `limit` tokens, white space behind it left out."""
        if not len(totals) or totals[-1] <= limit:
            return len(text.rstrip())
        # the first chunk whose end is beyond the limit; its beginning may still be within
        k = int(np.searchsorted(totals, limit, "right"))
        before = len(text) - len(text.split(None, k)[-1])
        tokens = np.cumsum(self.steps(chunks[k])) + (totals[k - 1] if k else 0)
        good = np.flatnonzero(tokens <= limit)
        raw = np.frombuffer(chunks[k] + b" ", "u1")
        good = good[(raw[good + 1] & 0xC0) != 0x80]
        return before + int(good[-1]) + 1 if len(good) else len(text[:before].rstrip())


def prefix_steps(text: bytes, counter: ChunkCounter) -> np.ndarray:
    """The table of one text."""
    chunks = text.split()
    counter.learn(set(chunks))
    return counter.table(text, chunks)


def counts(steps: np.ndarray) -> np.ndarray:
    """Tokens of the prefix that ends with each byte."""
    return np.cumsum(steps, dtype="i8")


def unpack(table: bytes, n_bytes: int) -> np.ndarray:
    """Steps from a stored table: one byte each, or four where a step needs them."""
    return np.frombuffer(table, "i1" if len(table) == n_bytes else "<i4")


def cut(text: bytes, counter: ChunkCounter, limit: int) -> int:
    """Bytes of the longest prefix within the limit."""
    chunks = text.split()
    counter.learn(set(chunks))
    return counter.cut(text, chunks, counter.totals(chunks), limit)


def count_tokens(df: DataFrame, path: str, limit: int = 2048, prefixes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, cut_bytes (longest prefix within limit)[, prefix_table], all from the prefix table."""
    key = df.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, n_bytes bigint, n_tokens bigint, over_limit boolean, cut_bytes bigint" + ", prefix_table binary" * prefixes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = ChunkCounter.of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                chunks = [t.split() for t in texts]
                counter.learn(set(chain.from_iterable(chunks)))
                totals = [counter.totals(c) for c in chunks]
                n = [int(t[-1]) if len(t) else 0 for t in totals]
                cuts = [counter.cut(*x, limit) for x in zip(texts, chunks, totals)]
                out = [part.column("doc_id"), pa.array(map(len, texts), "i8"), pa.array(n, "i8"), pa.array([x > limit for x in n], pa.bool_()), pa.array(cuts, "i8")]
                names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_bytes"]
                if prefixes:
                    out.append(pa.array([counter.table(t, c).tobytes() for t, c in zip(texts, chunks)], pa.binary()))
                    names.append("prefix_table")
                yield pa.RecordBatch.from_arrays(out, names)

    return df.select("doc_id", F.col("text").cast("string").alias("text")).transform(arrow, run, schema)


def check_splits(path: str, texts: list[str]) -> bool:
    """Whether the last counts of the prefix tables are the library's counts of whole texts."""
    counter = ChunkCounter(path)
    whole = [len(e.ids) for e in counter.encoder.encode_batch(texts, add_special_tokens=False)]
    return [int(prefix_steps(x.encode(), counter).sum(dtype="i8")) for x in texts] == whole
