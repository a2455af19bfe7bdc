"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max WAND.

Items are cut into segments of at most SEGMENT words, which are the index's documents. A whole document is one query of
its distinct words; of these, only words in a run of five indexed words count, since no other can be part of an item.
Impacts are BM25's, divided by the least score that the segment can have in a document that holds its item (`Index.least`):
such a document scores THRESHOLD or more in a segment at least, wherever the item's parts are. All segments that
reach THRESHOLD are retrieved, exactly:

* a document whose terms' largest impacts add up to less is left at once;
* the longest lists come before the pivot: their largest impacts together stay below half the threshold, so they cannot
  bring in a segment, and only blocks of BLOCK segments that the other lists reach are looked at;
* a block is read only if the block maxima there, with what the lists before the pivot can add, reach the threshold.

Retrieved items, and no others, are judged on their words: a word counts if a shingle of five words around it is in the
document, wherever that is. Question and answer are the item before and after its last sentence break (or two thirds of
its words). A document holds an item if OVERLAP of the item's words are covered, or QUESTION of its question's and any of
its answer's. The score is the largest share of a retrieved segment's own BM25 score that the document has.

Spark counts the words of all items and builds the index in shards of about BYTES of text, on executors. The driver passes
them on one at a time, as broadcasts of that bounded size. The documents are scanned once: a worker holds SLICE bytes of
them and one shard at a time. Words are runs of letters, digits and underscores, lower-cased.

Defined cases: null or wordless documents hold nothing; null or wordless items match nothing; items with fewer than
five words must occur as a whole; repeated rows are judged one by one; empty tables give no rows; other columns are
ignored (by `contaminated`) or kept (by `clean`).
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.lean import arrow
from tessera.llm.words import mix64
from tessera.sources.tables import release, staged

SEGMENT = 64
BLOCK = 2
THRESHOLD = 1.0
EASY, PORTION = 0.25, 2_000_000
OVERLAP, QUESTION = 0.6, 0.8
SHINGLE = 5
BYTES, SLICE = 8_000_000, 4_000_000
K1, B = 1.2, 0.75

words_of = re.compile(r"\w+").findall


def split_item(text: str) -> int:
    """Words of the question: up to the last sentence break, or two thirds."""
    n = len(words_of(text))
    breaks = [m.end() for m in re.finditer(r"[.?!:\n]\s", text.strip())]
    ask = len(words_of(text[: breaks[-1]])) if breaks else 0
    return ask if 0 < ask < n else max(1, round(n * 2 / 3))


class Level:
    """Segments whose least scores are alike: block maxima of their postings by (term, block), lists before the pivot."""

    def __init__(self, n_terms: int, block: np.ndarray, term: np.ndarray, impact: np.ndarray, at: int):
        """Postings sorted by block; `at` is where they begin among the index's."""
        self.n_blocks = int(block[-1]) + 1
        self.block_at = at + np.searchsorted(block, np.arange(self.n_blocks + 1))
        key = term * self.n_blocks + block
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        self.block_max = np.maximum.reduceat(impact[order], first)
        self.block = key[order][first] % self.n_blocks
        self.term_at = np.searchsorted(key[order][first], np.arange(n_terms + 1) * self.n_blocks)
        self.top = np.zeros(n_terms)
        np.maximum.at(self.top, term, impact)
        # the longest lists for what they can add come before the pivot, as many as cannot reach half the threshold together
        by_length = np.argsort(self.top / np.maximum(np.diff(self.term_at), 1), kind="stable")
        by_length = by_length[self.top[by_length] > 0]
        self.before = np.zeros(n_terms, bool)
        self.before[by_length[np.cumsum(self.top[by_length]) < THRESHOLD / 2]] = True

    def reach(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block) of all that can hold a segment at or above THRESHOLD, from sorted distinct (passage, term) pairs."""
        keep = np.bincount(passage, self.top[term])[passage] >= THRESHOLD - 1e-9
        passage, term = passage[keep], term[keep]
        # what the lists before the pivot can add at most, and the blocks that the others reach
        before = self.before[term]
        rest = np.bincount(passage, np.where(before, self.top[term], 0.0))
        rows, entry = expand(self.term_at[term[~before]], self.term_at[term[~before] + 1])
        cand, sums = accumulate(passage[~before][rows] * self.n_blocks + self.block[entry], self.block_max[entry])
        keep = sums + rest[cand // self.n_blocks] >= THRESHOLD - 1e-9
        cand, sums = cand[keep], sums[keep]
        # their bounds by block maxima of those lists too
        early, early_term = passage[before], term[before]
        rows, pair = expand(np.searchsorted(early, cand // self.n_blocks), np.searchsorted(early, cand // self.n_blocks, "right"))
        if len(rows):
            key = np.repeat(np.arange(len(self.top)), np.diff(self.term_at)) * self.n_blocks + self.block
            want = early_term[pair] * self.n_blocks + (cand % self.n_blocks)[rows]
            where = np.minimum(np.searchsorted(key, want), len(key) - 1)
            sums += np.bincount(rows, np.where(key[where] == want, self.block_max[where], 0.0), len(cand))
        cand = cand[sums >= THRESHOLD - 1e-9]
        return cand // self.n_blocks, cand % self.n_blocks


class Index:
    """One block of items: postings sorted by level and block of segments, and their block maxima."""

    def __init__(self, items: list[tuple[int, str]], df: Counter, n_segments: int, mean: float):
        self.items = [(i, words_of(t.lower()), split_item(t)) for i, t in items]
        self.owner, self.vocab = [], {}
        term, seg, impact, costs, rules = [], [], [], [], []
        for at, (_, w, ask) in enumerate(self.items):
            for part, least in zip(segments(w), goals(len(w), ask)):
                s, counts = len(self.owner), Counter(part)
                self.owner.append(at)
                own = {t: np.log(1 + (n_segments - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(part) / mean)) for t, n in counts.items()}
                total = sum(own.values())
                for t, x in own.items():
                    term.append(self.vocab.setdefault(t, len(self.vocab)))
                    seg.append(s)
                    impact.append(x / total)
                # each place of a word has an equal part of its impact
                costs.append([own[t] / total / counts[t] for t in part])
                rules += [(s, *rule) for rule in least]
        self.owner = np.array(self.owner, "i8")
        self.least = least_scores(costs, rules)
        self.hash_shingles()
        # a few segments with a low least score would raise all terms' bounds, so they are a level of their own
        level, block = np.zeros(len(self.owner), "i8"), np.zeros(len(self.owner), "i8")
        for at, some in enumerate((self.least >= EASY, self.least < EASY)):
            level[some], block[some] = at, np.arange(some.sum()) // BLOCK
        self.term, self.seg, impact = np.array(term, "i8"), np.array(seg, "i8"), np.array(impact)
        order = np.lexsort((self.term, self.seg, block[self.seg], level[self.seg]))
        self.term, self.seg = self.term[order], self.seg[order]
        self.impact = impact[order] / (self.least[self.seg] * (1 - 1e-9))
        ends = np.searchsorted(level[self.seg], [0, 1, 2])
        self.levels = [Level(len(self.vocab), block[self.seg[i:j]], self.term[i:j], self.impact[i:j], i) for i, j in zip(ends, ends[1:]) if i < j]

    def hash_shingles(self) -> None:
        """Hashes of the shingles of every item, by item and first word; an item of fewer words is one shingle."""
        self.size = np.array([len(w) for _, w, _ in self.items], "i8")
        self.ask = np.array([min(a, len(w)) for _, w, a in self.items], "i8")
        self.gram = np.minimum(self.size, SHINGLE)
        self.shortest = int(self.gram[self.gram > 0].min(initial=SHINGLE))
        found = [shingle_hashes(np.array([self.vocab[x] for x in w], "i8"), min(SHINGLE, len(w))) for _, w, _ in self.items if w]
        self.shingle = np.concatenate([*found, np.zeros(0, "u8")])
        self.shingle_at = np.concatenate(([0], np.cumsum(np.where(self.size > 0, self.size - self.gram + 1, 0))))

    def retrieve(self, passage: np.ndarray, term: np.ndarray) -> list[tuple[int, int, float]]:
        """(passage, segment, score) of all at or above THRESHOLD, from sorted distinct (passage, term) pairs."""
        out = []
        for level in self.levels:
            # whole passages, as many as have PORTION entries of blocks, one at least
            size = (level.term_at[term + 1] - level.term_at[term]).cumsum()
            last = np.flatnonzero(np.diff(passage, append=-1))
            for part in np.split(np.arange(len(passage)), last[np.flatnonzero(np.diff(size[last] // PORTION))] + 1):
                p, t = passage[part], term[part]
                distinct, local = np.unique(p, return_inverse=True)
                there = np.zeros((len(distinct), len(self.vocab)), bool)
                there[local, t] = True
                cand, block = level.reach(local, t)
                # and the postings of the blocks that are left
                for at in range(0, len(cand), PORTION // 64):
                    c, k = cand[at : at + PORTION // 64], block[at : at + PORTION // 64]
                    rows, posting = expand(level.block_at[k], level.block_at[k + 1])
                    hit = there[c[rows], self.term[posting]]
                    rows, posting = rows[hit], posting[hit]
                    pairs, score = accumulate(distinct[c[rows]] * len(self.owner) + self.seg[posting], self.impact[posting])
                    out += [(int(k // len(self.owner)), int(k % len(self.owner)), float(s)) for k, s in zip(pairs, score) if s >= THRESHOLD]
        return out


def segments(words: list[str]) -> list[list[str]]:
    n = -(-len(words) // SEGMENT)
    return [words[len(words) * i // n : len(words) * (i + 1) // n] for i in range(n)]


def goals(n: int, ask: int) -> list[list[tuple[int, int, int, bool, bool]]]:
    """For each segment of an item of n words: (words that count, of these covered, words, cut before, cut behind).

    If a document holds the item, a segment has one of its goals met. OVERLAP of all words is OVERLAP of some segment's; the
    same goes for the question, whose short rest in a segment of the answer is left out and the goal of the others lowered.
    """
    sizes = [len(part) for part in segments(range(n))]
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    asked = [min(max(ask - start, 0), size) for start, size in zip(starts, sizes)]
    rest = sum(a for a, size in zip(asked, sizes) if a < size)
    rest = rest if 4 * rest <= ask else 0
    out = []
    for start, size, a in zip(starts, sizes, asked):
        cut = start > 0, start + size < n
        out.append([(size, at_least(OVERLAP * size), size, *cut)])
        if ask < n and a and not (rest and a < size):
            out[-1].append((a, at_least((QUESTION * ask - rest) / (ask - rest) * a), size, *cut))
    return out


def at_least(x: float) -> int:
    return max(1, int(np.ceil(x - 1e-9)))


def least_scores(costs: list[list[float]], rules: list[tuple]) -> np.ndarray:
    """For each segment the least cost of covered words that meet a goal.

    Covered words are runs of SHINGLE or more, or fewer where the segment is cut. By run length (SHINGLE: enough) and covered
    words that count, the least cost so far goes along the segment.
    """
    out = np.full(len(costs), np.inf)
    for at in range(0, len(rules), 256):
        seg, counted, want, size, before, behind = (np.array(x) for x in zip(*rules[at : at + 256]))
        n = int(size.max())
        cost = np.full((len(seg), n), np.inf)
        for i, s in enumerate(seg):
            cost[i, : size[i]] = costs[s]
        now = np.full((len(seg), SHINGLE + 1, n + 1), np.inf)
        now[:, 0, 0] = 0
        now[before, SHINGLE, 0] = 0
        for i in range(n):
            with_it = now + cost[:, i, None, None]
            c = i < counted
            with_it[c, :, 1:] = with_it[c, :, :-1]
            with_it[c, :, 0] = np.inf
            now = np.concatenate((np.minimum(now[:, :1], now[:, -1:]), with_it[:, :-1]), axis=1)
            now[:, -1] = np.minimum(now[:, -1], with_it[:, -1])
            end = behind & (size == i + 1)
            now[end, -1] = now[end].min(axis=1)
        ends = np.minimum(now[:, 0], now[:, -1])
        ends[np.arange(n + 1) < want[:, None]] = np.inf
        # an item shorter than a shingle occurs as a whole
        np.minimum.at(out, seg, np.where(size < SHINGLE, 1.0, ends.min(axis=1)))
    return out


def expand(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges, with the number of the range of each."""
    n = end - start
    rows = np.repeat(np.arange(len(n)), n)
    return rows, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)


def accumulate(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their weights."""
    if len(keys) and keys.max() - keys.min() < 4 * len(keys) + 1_000_000:
        low = keys.min()
        sums = np.bincount(keys - low, weights)
        there = np.flatnonzero(sums)
        return there + low, sums[there]
    distinct, inverse = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(inverse, weights, len(distinct))


def shingle_hashes(term: np.ndarray, g: int) -> np.ndarray:
    """One hash for each run of g words."""
    n = max(len(term) - g + 1, 0)
    h = np.zeros(n, "u8")
    for i in range(g):
        h = mix64(h + term[i : i + n].astype("u8") + np.uint64(1))
    return h


def covered(item: list[str], passage: list[str]) -> np.ndarray:
    """Which of the item's words lie in a shingle of the passage."""
    n = min(SHINGLE, len(item))
    there = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
    out = np.zeros(len(item), bool)
    for i in range(len(item) - n + 1):
        if tuple(item[i : i + n]) in there:
            out[i : i + n] = True
    return out


def scan(texts: list[str | None], index: Index) -> list[list[tuple[int, float, float, float, float]]]:
    """For each text: (item_id, score, overlap, question overlap, answer overlap) of the items that it holds."""
    out: list[list] = [[] for _ in texts]
    docs = [words_of(t.lower()) if t else [] for t in texts]
    sizes = np.array([len(d) for d in docs], "i8")
    if not sizes.sum() or not len(index.owner):
        return out
    term = np.fromiter(map(index.vocab.get, chain.from_iterable(docs), repeat(-1)), "i8", int(sizes.sum()))
    doc = np.repeat(np.arange(len(docs)), sizes)
    # words in runs of indexed words, as long as the shortest shingle
    first = runs(term, doc, index.shortest)
    inside = np.zeros(len(term), bool)
    for o in range(index.shortest):
        inside[first + o] = True
    v = len(index.vocab)
    keys = np.unique(doc[inside] * v + term[inside])
    scores: dict[tuple[int, int], float] = {}
    for d, seg, score in index.retrieve(keys // v, keys % v):
        pair = d, int(index.owner[seg])
        scores[pair] = max(scores.get(pair, 0.0), min(score * float(index.least[seg]), 1.0))
    if not scores:
        return out
    d, item = np.array(sorted(scores), "i8").T
    for i, k in zip(*likely(index, term, doc, d, item)):
        item_id, words, ask = index.items[k]
        # hashes found it; its words decide
        if held := holds(covered(words, docs[i]), ask):
            out[i].append((item_id, scores[i, k], *held))
    return out


def runs(term: np.ndarray, doc: np.ndarray, g: int) -> np.ndarray:
    """Where g indexed words of one document begin."""
    if len(term) < g:
        return np.zeros(0, "i8")
    return np.flatnonzero((np.convolve(term >= 0, np.ones(g, "i8"), "valid") == g) & (doc[: len(term) - g + 1] == doc[g - 1 :]))


def likely(index: Index, term: np.ndarray, doc: np.ndarray, d: np.ndarray, item: np.ndarray) -> tuple[list[int], list[int]]:
    """Those of the pairs (document, item) that make a leak by the hashes of their shingles."""
    there = []
    for g in np.unique(index.gram[item]):
        first = runs(term, doc, g)
        first = first[np.isin(doc[first], d)]
        h = np.zeros(len(first), "u8")
        for i in range(g):
            h = mix64(h + term[first + i].astype("u8") + np.uint64(1))
        there.append(mix64(h + doc[first].astype("u8")))
    there = np.unique(np.concatenate(there))
    if not len(there):
        return [], []
    whole, asked = np.zeros(len(d), "i8"), np.zeros(len(d), "i8")
    # pairs of about a million words at a time
    for part in np.split(np.arange(len(d)), np.flatnonzero(np.diff(np.cumsum(index.size[item]) // 1_000_000)) + 1):
        k = item[part]
        rows, entry = expand(index.shingle_at[k], index.shingle_at[k + 1])
        h = mix64(index.shingle[entry] + d[part][rows].astype("u8"))
        hit = there[np.minimum(np.searchsorted(there, h), len(there) - 1)] == h
        base = np.cumsum(index.size[k]) - index.size[k]
        at = (base[rows] + entry - index.shingle_at[k][rows])[hit]
        n = int(index.size[k].sum())
        mask = np.cumsum(np.bincount(at, minlength=n + 1) - np.bincount(at + index.gram[k][rows][hit], minlength=n + 1))[:n] > 0
        whole[part] = np.add.reduceat(mask, base, dtype="i8")
        rows, word = expand(base, base + index.ask[k])
        asked[part] = np.bincount(rows, mask[word], len(part))
    held = (whole / index.size[item] >= OVERLAP) | ((asked / index.ask[item] >= QUESTION) & (whole > asked))
    return d[held].tolist(), item[held].tolist()


def holds(mask: np.ndarray, ask: int) -> tuple[float, float, float] | None:
    """Overlap of item, question and answer, if they make a leak."""
    whole, question, answer = float(mask.mean()), float(mask[:ask].mean()), float(mask[ask:].mean()) if ask < len(mask) else 0.0
    return (whole, question, answer) if whole >= OVERLAP or (question >= QUESTION and answer > 0) else None


def segment_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, shard, n, words): a row for each word of each segment (n 1), and one for each segment with its length (word null)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows = []
            for shard, text in zip(part.column(0).to_pylist(), part.column(2).to_pylist()):
                for seg in segments(words_of(text.lower())):
                    rows += [(w, shard, 0) for w in set(seg)] + [(None, shard, len(seg))]
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], "i8"), pa.array(cols[2], "i8")], ["word", "shard", "words"])


def shards(benchmark: DataFrame) -> list[tuple[str, Broadcast]]:
    """The index of the benchmark in shards of about BYTES of text, each named, pickled and broadcast by itself.

    Spark counts the words and builds the shards; the driver passes them on one at a time.
    """
    spark = benchmark.sparkSession
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    rows = rows.select(F.pmod(F.xxhash64("item_id", "text"), F.lit(-(-size // BYTES) or 1)).alias("shard"), "item_id", "text")
    words = rows.transform(arrow, segment_words, "word string, shard bigint, words bigint")
    words = staged(words.groupBy("word", "shard").agg(F.count("*").alias("n"), F.sum("words").alias("words")), "benchmark-words")
    n, total = words.where("word is null").agg(F.sum("n"), F.sum("words")).first()
    if not n:
        return []
    counts = words.where("word is not null").groupBy("word").agg(F.sum("n").alias("df"))
    known = words.where("word is not null").select("word", "shard").join(counts, "word")
    item = rows.schema["item_id"]
    both = known.select("shard", "word", "df", F.lit(None).cast(item.dataType).alias("item_id"), F.lit(None).cast("string").alias("text"))
    both = both.unionByName(rows.select("shard", F.lit(None).cast("string").alias("word"), F.lit(None).cast("bigint").alias("df"), "item_id", "text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, df, items = None, Counter(), []

        def done():
            index = Index(items, df, n, total / n)
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(index, pickle.HIGHEST_PROTOCOL)], pa.binary())], ["index"])

        for batch in batches:
            for shard, word, count, item_id, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if shard != now:
                    if items:
                        yield done()
                    now, df, items = shard, Counter(), []
                if word is not None:
                    df[word] = count
                elif words_of(text.lower()):
                    items.append((item_id, text))
        if items:
            yield done()

    # words first, then items in a fixed order
    built = both.repartition("shard").sortWithinPartitions("shard", F.col("word").isNull(), "item_id", "text").transform(arrow, build, "index binary")
    built = staged(built, "benchmark-index")
    out = [(uuid.uuid4().hex, spark.sparkContext.broadcast(bytes(r["index"]))) for r in built.toLocalIterator()]
    release(words, built)
    return out


class Shards:
    """A worker's view of the shards: one at a time in memory, the last one kept."""

    held: tuple = None, None

    @classmethod
    def index(cls, name: str, shard: Broadcast) -> Index:
        if cls.held[0] != name:
            cls.held = None, None
            cls.held = name, pickle.loads(shard.value)
            # the pickled form is on the worker's disk, and need not stay in memory
            shard.__dict__.pop("_value", None)
        return cls.held[1]


def slices(batch: pa.RecordBatch, at_text: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about SLICE bytes of text, of one row at least."""
    column = batch.column(at_text)
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype("i8")
    at = 0
    for part in np.split(np.arange(len(size)), np.flatnonzero(np.diff(np.cumsum(size) // SLICE)) + 1):
        if len(part):
            yield batch.slice(at, len(part))
        at += len(part)


def held_items(texts: list[str | None], parts: list[tuple[str, Broadcast]]) -> list[list]:
    """What `scan` finds in each text, in all shards."""
    out: list[list] = [[] for _ in texts]
    for part in parts:
        index = Shards.index(*part)
        for at in range(0, len(texts), 128):
            for found, hits in zip(out[at : at + 128], scan(texts[at : at + 128], index)):
                found += hits
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, overlap, question_overlap, answer_overlap: a row for each item that a document holds."""
    key, item = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType
    schema = f"doc_id {key}, item_id {item.simpleString()}, score double, overlap double, question_overlap double, answer_overlap double"
    parts = shards(benchmark)
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                rows = [(i, *h) for i, found in enumerate(held_items(part.column(1).to_pylist(), parts)) for h in found]
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(cols[0])), *(pa.array(c) for c in cols[1:])], ["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"]
                    )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).transform(arrow, run, schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that hold no item."""
    parts, at_text = shards(benchmark), docs.columns.index("text")
    if not parts:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at_text):
                yield part.filter(pa.array([not h for h in held_items(part.column(at_text).to_pylist(), parts)], pa.bool_()))

    return docs.transform(arrow, run, docs.schema)
