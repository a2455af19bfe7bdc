"""Substring dedup by compaction of a sparse de Bruijn graph of token k-mers.

A window is WINDOW consecutive words. Each window names one of its k-mers (the least hash, the first of equals) as its
anchor; neighbouring windows with one anchor form an edge of the graph: the anchor with as much context as those windows
span. Equal windows have equal anchors, so only edges whose anchor occurs elsewhere matter, and a document has an edge
for about eight words instead of one for each.

1. Windows that a text repeats itself are found within the text; of the rest, a text names each edge once, at its first
   place. Anchors are counted; those of one text only go. (Sums and extremes are combined before the shuffle.)
2. All edges of the other anchors are joined with the first place of the same edge, by (doc_id, start). An edge that has
   an earlier place repeats it as a whole. Where an anchor has but one edge the path does not branch, and nothing
   else is needed; consecutive repeated edges with a common source are compacted into one long span.
3. Where an anchor branches (edges with other context share it), the first place of each distinct edge gives its single
   windows, and these are joined with the first place of the same window.
4. Spans are verified at their source coordinates: 128-bit digests of the words here and there must agree.

Places are ordered by (doc_id, start), and windows judged on the input. Hot anchors, edges and windows meet only in
combining aggregates and in joins whose heavy side Spark can split. What is asked of a text travels to it in lists of about
PLACES places, however many there are; only what is removed from a text, which its own length bounds, meets in one
row. Texts travel compressed, once for step 3 and once for the result. Hashes of words are 64 bits wide, those of edges and windows 96.

Defined cases: null text has no words; texts with fewer than WINDOW words keep all; rows that share a doc_id are
separate documents whose places compare as equal (so none removes a word of the other at the same start); a null doc_id
sorts first; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.lean import arrow
from tessera.llm.words import mix64, word_hashes
from tessera.sources.tables import release, staged

WINDOW, KMER = 20, 6
SPREAD = WINDOW - KMER + 1
#: Places of a text that are read together, about.
PLACES = 4096
NONE = -(2**63)

_rng = np.random.default_rng(8)
_place = _rng.integers(1, 2**63, KMER, dtype="u8") * np.uint64(2) + np.uint64(1)
_base = [int(b) * 2 + 1 for b in _rng.integers(2**60, 2**62, 2)]
_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """Powers of both bases and of their inverses modulo 2**64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(4096, 2 * n)
        _powers.clear()
        for b in (*_base, *(pow(b, -1, 2**64) for b in _base)):
            steps = np.full(size, b, "u8")
            steps[0] = 1
            _powers.append(np.cumprod(steps))
    return _powers


class Words:
    """A text's words, with hashes of any range of them."""

    def __init__(self, raw: bytes | None):
        self.raw = raw or b""
        self.h = word_hashes(self.raw)

    def __len__(self) -> int:
        return len(self.h)

    def text(self, keep: np.ndarray) -> bytes:
        """The kept words, joined by one space."""
        words = self.raw.split()
        return b" ".join(words if keep.all() else [w for w, k in zip(words, keep.tolist()) if k])

    def ranges(self, start: np.ndarray, end: np.ndarray, both: bool = True) -> list[np.ndarray]:
        """One or two independent 64-bit hashes of the words [start, end)."""
        p, out = powers(len(self) + 1), []
        for k in range(1 + both):
            sums = np.concatenate((np.zeros(1, "u8"), np.cumsum(self.h * p[k][: len(self)])))
            out.append(mix64((sums[end] - sums[start]) * p[2 + k][start] + (end - start).astype("u8")))
        return out

    def repeats(self) -> np.ndarray:
        """Starts of the windows that begin earlier in this text too."""
        at = np.arange(max(len(self) - WINDOW + 1, 0))
        (h,) = self.ranges(at, at + WINDOW, both=False)
        order = np.argsort(h, kind="stable")
        return order[1:][h[order[1:]] == h[order[:-1]]]

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, tag, start, number of windows) of the first place of each edge, by anchor and tag."""
        n = len(self) - WINDOW + 1
        if n < 1:
            none = np.zeros(0, "i8")
            return none, none.astype("i4"), none, none
        m = len(self) - KMER + 1
        k = self.h[:m] * _place[0]
        for i in range(1, KMER):
            k = k + (self.h[i : m + i] ^ (self.h[i : m + i] >> np.uint64(29))) * _place[i]
        k = mix64(k)
        at = np.arange(n) + np.lib.stride_tricks.sliding_window_view(k, SPREAD).argmin(1)
        start = np.flatnonzero(np.diff(at, prepend=-1))
        count = np.diff(np.append(start, n))
        anchor = at[start]
        (content,) = self.ranges(start, start + count + WINDOW - 1, both=False)
        tag = mix64(content + (anchor - start).astype("u8") * np.uint64(0x9E3779B97F4A7C15)).view("i8").astype("i4")
        anchor = k[anchor].view("i8")
        order = np.lexsort((tag, anchor))
        a, t = anchor[order], tag[order]
        order = order[np.concatenate(([True], (a[1:] != a[:-1]) | (t[1:] != t[:-1])))]
        return anchor[order], tag[order], start[order], count[order]


def slices(batch: pa.RecordBatch, rows: int = 512):
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield part.column(0).to_numpy(zero_copy_only=False), part.column(1).cast(pa.binary()).to_pylist()


def count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least and greatest tag of each anchor, and in how many of the batch's texts it occurs."""
    for batch in batches:
        for _, texts in slices(batch):
            found = [Words(t).edges()[:2] for t in texts]
            anchor, tag = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            if not len(anchor):
                continue
            new = np.concatenate([np.diff(f[0], prepend=~f[0][:1]) != 0 for f in found])
            order = np.argsort(anchor, kind="stable")
            anchor, tag, new = anchor[order], tag[order], new[order]
            first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[first]), pa.array(np.minimum.reduceat(tag, first)), pa.array(np.maximum.reduceat(tag, first)), pa.array(np.add.reduceat(new, first, dtype="i4"))],
                ["anchor", "low", "high", "n"],
            )


def list_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, texts in slices(batch):
            found = [Words(t).edges() for t in texts]
            cols = [np.concatenate([f[i] for f in found]) for i in range(4)]
            doc = np.repeat(ids, [len(f[0]) for f in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0]), pa.array(cols[1]), pa.array(doc), pa.array(cols[2].astype("i4")), pa.array(cols[3].astype("i4"))], ["anchor", "tag", "doc", "start", "n"]
            )


def packed(docs: DataFrame) -> DataFrame:
    """doc, z (compressed text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(3)
        for batch in batches:
            for ids, texts in slices(batch):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([None if t is None else zip_.compress(t) for t in texts], pa.binary())], ["doc", "z"])

    return docs.transform(arrow, run, "doc bigint, z binary")


def read_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes at the listed places of each text: kind 0 gives its windows, 1 (a span) and 2 (a source) the whole range."""
    unzip = zstandard.ZstdDecompressor()
    for batch in batches:
        out: list[list[np.ndarray]] = []
        for i in range(batch.num_rows):
            doc, z = batch.column(0)[i].as_py(), batch.column(1)[i].as_buffer()
            words = Words(unzip.decompress(z))
            places = np.array([list(p.values()) for p in batch.column(2)[i].as_py()], "i8").reshape(-1, 5)
            places = places[places[:, 1] + places[:, 2] <= len(words)]
            kind, start, size, src, src_start = places.T
            one = kind == 0
            n = size[one] - WINDOW + 1
            each = np.repeat(start[one] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            a = np.concatenate((each, start[~one]))
            b = np.concatenate((each + WINDOW, (start + size)[~one]))
            h = words.ranges(a, b)
            fill = lambda v, x=len(each): np.concatenate((np.zeros(x, "i8"), v[~one]))  # noqa: E731, B023
            out.append([fill(kind), np.full(len(a), doc), a, b - a, fill(src), fill(src_start), h[0].view("i8"), h[1].view("i8")])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["kind", "doc", "start", "size", "src", "src_start", "h1", "h2"])


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop the words of each removed range whose hashes are those of this very text, and of windows it repeats itself."""
    unzip = zstandard.ZstdDecompressor()
    for batch in batches:
        cols: list[list] = [[], [], [], [], []]
        for i in range(batch.num_rows):
            z = batch.column(1)[i]
            words = Words(unzip.decompress(z.as_buffer()) if z.is_valid else None)
            drop = np.zeros(len(words) + 1, "i8")
            if batch.column(2)[i].is_valid:
                r = np.array([list(p.values()) for p in batch.column(2)[i].as_py()], "i8").reshape(-1, 4)
                r = r[r[:, 0] + r[:, 1] <= len(words)]
                h = words.ranges(r[:, 0], r[:, 0] + r[:, 1])
                r = r[(h[0].view("i8") == r[:, 2]) & (h[1].view("i8") == r[:, 3])]
                np.add.at(drop, r[:, 0], 1)
                np.add.at(drop, r[:, 0] + r[:, 1], -1)
            own = words.repeats()
            np.add.at(drop, own, 1)
            np.add.at(drop, own + WINDOW, -1)
            keep = np.cumsum(drop)[:-1] == 0
            kept = words.text(keep)
            for c, v in zip(cols, (batch.column(0)[i].as_py(), len(words), len(words) - int(keep.sum()), hashlib.sha256(kept).hexdigest(), kept)):
                c.append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], "i8"), pa.array(cols[1], "i8"), pa.array(cols[2], "i8"), pa.array(cols[3]), pa.array(cols[4], pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
        )


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the remaining words, joined by one space)."""
    d = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NONE)).alias("doc"), F.col("text").cast("string").alias("text"))

    anchors = d.transform(arrow, count_anchors, "anchor bigint, low int, high int, n int").groupBy("anchor")
    anchors = anchors.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).where("n > 1")
    anchors = staged(anchors.select("anchor", (F.col("low") != F.col("high")).alias("branches")), "anchors")

    edges = d.transform(arrow, list_edges, "anchor bigint, tag int, doc bigint, start int, n int").join(anchors, "anchor")
    edges = staged(edges, "edges")
    release(anchors)
    first = staged(edges.groupBy("anchor", "tag").agg(F.min(F.struct("doc", "start")).alias("f")), "first")
    placed = staged(edges.join(first, ["anchor", "tag"]).select("doc", "start", "n", "branches", F.col("f.doc").alias("src"), F.col("f.start").alias("src_start")), "placed")
    release(edges, first)

    is_first = (F.col("doc") == F.col("src")) & (F.col("start") == F.col("src_start"))
    later = placed.where(~is_first).distinct()
    # consecutive repeated edges with a common source are one span
    by = W.partitionBy("doc", "src", F.col("start") - F.col("src_start")).orderBy("start")
    runs = later.withColumn("new", (F.coalesce(F.lag(F.col("start") + F.col("n")).over(by), F.lit(-1)) != F.col("start")).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    spans = runs.groupBy("doc", "src", (F.col("start") - F.col("src_start")).alias("shift"), "run").agg(F.min("start").alias("start"), F.sum("n").alias("n"))
    spans = spans.select("doc", "start", (F.col("n") + WINDOW - 1).alias("size"), "src", (F.col("start") - F.col("shift")).alias("src_start"))
    spans = staged(spans, "spans")

    zero = F.lit(0).cast("bigint")
    place = lambda df, kind, *c: df.select(c[0], F.struct(F.lit(kind).alias("kind"), *[F.col(x).cast("bigint").alias(y) if isinstance(x, str) else x.alias(y) for x, y in zip(c[1:], ("start", "size", "src", "src_start"))]).alias("p"))
    singles = placed.where(is_first & F.col("branches")).select("doc", "start", (F.col("n") + WINDOW - 1).alias("size")).distinct()
    wanted = spans.select(F.col("src").alias("doc"), F.col("src_start").alias("start"), "size").distinct()
    places = place(singles, 0, "doc", "start", "size", zero, zero).unionByName(place(spans, 1, "doc", "start", "size", "src", "src_start")).unionByName(place(wanted, 2, "doc", "start", "size", zero, zero))
    # a text that very many others copy from is asked for many places: they come in several lists
    many = spans.groupBy("src").count().where(F.col("count") > PLACES).select("src", F.ceil(F.col("count") / PLACES).alias("lists"))
    places = places.join(many, F.col("doc") == F.col("src"), "left")
    places = places.groupBy("doc", F.pmod(F.xxhash64("p"), F.coalesce("lists", F.lit(1).cast("bigint"))).alias("list")).agg(F.collect_list("p").alias("places"))
    read = packed(d).where("z is not null").join(places, "doc").select("doc", "z", "places")
    read = staged(read.transform(arrow, read_places, "kind bigint, doc bigint, start bigint, size bigint, src bigint, src_start bigint, h1 bigint, h2 bigint"), "places")
    release(placed, spans)

    there = read.where("kind = 2").select(F.col("doc").alias("src"), F.col("start").alias("src_start"), "size", "h1", "h2").distinct()
    verified = read.where("kind = 1").join(there, ["src", "src_start", "size", "h1", "h2"]).select("doc", "start", "size", "h1", "h2")
    windows = read.where("kind = 0").select("doc", "start", "size", "h1", "h2").distinct()
    least = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc", "start")).alias("f"), F.count("*").alias("n")).where("n > 1")
    least = staged(least, "least")
    again = windows.join(least, ["h1", "h2"]).where(F.struct("doc", "start") > F.col("f")).select("doc", "start", "size", "h1", "h2")
    ranges = verified.unionByName(again).groupBy("doc").agg(F.collect_set(F.struct("start", "size", "h1", "h2")).alias("ranges"))
    ranges = staged(ranges, "ranges")
    release(read, least)
    out = packed(d).join(ranges, "doc", "left").select("doc", "z", "ranges")
    out = out.transform(arrow, cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NONE, F.col("doc_id")))
