"""Embedding near-duplicates by an inverted multi-index.

Unit vectors are cut in halves; each half has its own k-means codebook, and the pairs of codewords form a grid of
cells. A vector is indexed in the cell of its two nearest codewords. To search, the multi-sequence walk visits cells in
order of the summed squared distance of their codewords to the query's halves, over the whole grid; it stops after twice
the number of cells in which RECALL of PROBES sampled queries have all their true neighbours, found by brute force among
all vectors. Fewer than FEW queries with a neighbour do not show that number; the stop then also lets RECALL_MADE of made
pairs be found, which are the hardest there can be: just at the threshold, in random directions. Cosines are computed in
double precision, and only pairs at or above the threshold are links. A pair is found if either of its vectors visits the
other's cell, and then counts for both.

Equal vectors are one entry with a count, so exact copies cost nothing and do not weigh in the stop. Codebooks are fitted on
at most SAMPLE entries and SAMPLE_BYTES (the first by hash); the grid grows with the number of vectors as far as the sample
can fit it; every row is indexed and every row is a query. Neighbouring cells of a row of the grid make a bucket, to which
a query goes once with the cells that it visits there; a bucket of more than BLOCK entries is cut into blocks, met by the
same queries, so a dense one is spread over tasks. A block compares each cell's queries and entries as one matrix; per
vector it returns a count, and per connected piece links to its least id, not all pairs.

Vectors of different lengths are never neighbours. Lengths between two powers of two share one index, in which shorter
vectors are filled up with zeros, so there are at most some thirty indexes, however many lengths there are.

Defined cases: vectors that are null, zero or with a null or non-finite component link with nothing; rows that share a
vec_id are one node in components and separate entries otherwise; ties need nothing, as all pairs at the threshold count;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.lean import arrow
from tessera.llm.links import components
from tessera.sources.tables import release, staged

SAMPLE, SAMPLE_BYTES = 80_000, 64 << 20
RECALL, RECALL_MADE = 0.999, 0.99
BLOCK = 2048
#: Most buckets of several blocks that are broadcast (two numbers each); beyond it Spark chooses the join by size.
BROADCAST = 100_000
#: A cell of the grid is to hold about so many vectors; vectors of the sample for each codeword.
CELL, PER_WORD = 16, 20
LEAST_VISITS = 8
PROBES, FEW = 2000, 1000


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors. Scaled first, so that no square overflows or vanishes."""
    x = x.astype("f8")
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def filled(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a list column, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dim))
    out[np.arange(dim) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def codebook(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([distances(x[at : at + 4096], c).argmin(1) for at in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)[:, None]
        c = np.where(n > 0, sums / np.maximum(n, 1), x[rng.integers(0, len(x), k)])
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)


class MultiIndex:
    def __init__(self, x: np.ndarray, rows: int):
        """x: distinct unit vectors of the sample; rows: vectors in all, for a grid whose cells hold a like number at any size."""
        self.half = x.shape[1] // 2
        k = 2 ** int(np.log2(max(rows / CELL, 1)) / 2)
        self.k = int(min(k, max(len(x) // PER_WORD, 1)))
        self.books = codebook(x[:, : self.half], self.k), codebook(x[:, self.half :], self.k, seed=1)
        self.visits = LEAST_VISITS

    def grid(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(x[:, : self.half], self.books[0]), distances(x[:, self.half :], self.books[1])

    def stop(self, probe: np.ndarray, far: dict[int, float], threshold: float) -> None:
        """Set visits. far: for each probe with neighbours, the summed distance of the last cell that holds one."""
        da, db = self.grid(probe)
        rank = lambda i, d: int((da[i][:, None] + db[i] <= d + 1e-9).sum())
        ranks = [rank(i, d) for i, d in far.items()]
        need, least = int(np.quantile(ranks, RECALL, method="higher")) if ranks else 1, LEAST_VISITS
        if len(ranks) < FEW:
            g = np.random.default_rng(2).normal(size=probe.shape)
            g -= (g * probe).sum(1, keepdims=True) * probe
            g /= np.maximum(np.linalg.norm(g, axis=1, keepdims=True), 1e-9)
            made = threshold * probe + np.sqrt(max(1 - threshold**2, 0)) * g
            here, there, (ma, mb) = self.cells(probe), self.cells(made), self.grid(made)
            back = lambda i, c: int((ma[i][:, None] + mb[i] <= ma[i, c // self.k] + mb[i, c % self.k] + 1e-9).sum())
            either = [min(rank(i, da[i, c // self.k] + db[i, c % self.k]), back(i, h)) for i, (h, c) in enumerate(zip(here, there))]
            least = max(least, int(np.quantile(either, RECALL_MADE, method="higher")))
        self.visits = min(max(2 * need, least), self.k**2)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = distances(x[:, : self.half], self.books[0]).argmin(1), distances(x[:, self.half :], self.books[1]).argmin(1)
        return a * self.k + b

    def walk(self, x: np.ndarray) -> np.ndarray:
        """The first `visits` cells of each query by the multi-sequence order over each half's nearest codewords."""
        visits = min(self.visits, self.k**2)
        out = np.empty((len(x), visits), "i8")
        # the cell at ranks i, j of the halves has (i + 1) * (j + 1) - 1 cells before it at least
        at_i, at_j = np.nonzero(np.arange(1, self.k + 1)[:, None] * np.arange(1, self.k + 1) <= visits)
        step = max(1, min(512, 4_000_000 // len(at_i)))
        for at in range(0, len(x), step):
            d = self.grid(x[at : at + step])
            near = [np.argsort(v, 1, kind="stable") for v in d]
            da, db = (np.take_along_axis(v, n, 1) for v, n in zip(d, near))
            order = np.argsort(da[:, at_i] + db[:, at_j], 1, kind="stable")[:, :visits]
            i, j = at_i[order], at_j[order]
            out[at : at + step] = np.take_along_axis(near[0], i, 1) * self.k + np.take_along_axis(near[1], j, 1)
        return out


def joined(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes is connected with, by the links i - j."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        # a label's own label is as good and saves rounds
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare(entries: tuple, queries: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One block: (ids, links that each gains, counted with copies) and edges (a, b) that connect what the links connect.

    Both are (id, vector, size, count, own cell, visited cells); entries are sorted by cell, with all the cells that they
    visit themselves, and queries have those of this bucket. A query gains its links here; an entry gains those of queries
    whose cell it does not visit, as no block of that cell counts them.
    """
    (e_id, e_x, e_size, e_n, e_cell, e_walk), (q_id, q_x, q_size, q_n, q_home, q_walk) = entries, queries
    asks = np.repeat(np.arange(len(q_id)), [len(w) for w in q_walk])
    cells = np.concatenate(q_walk)
    order = np.argsort(cells, kind="stable")
    asks, cells = asks[order], cells[order]
    hits = []
    for cell in np.unique(e_cell):
        q = asks[slice(*np.searchsorted(cells, (cell, cell + 1)))]
        low, high = np.searchsorted(e_cell, (cell, cell + 1))
        for at in range(0, len(q), 1024):
            part = q[at : at + 1024]
            i, j = np.nonzero((q_x[part] @ e_x[low:high].T >= threshold) & (q_id[part, None] != e_id[low:high]) & (q_size[part, None] == e_size[low:high]))
            hits.append(np.stack((part[i], low + j)))
    i, j = np.concatenate(hits, axis=1) if hits else np.zeros((2, 0), "i8")
    ids, gain = np.concatenate((q_id, e_id)), np.zeros(len(q_id) + len(e_id), "i8")
    np.add.at(gain, i, e_n[j])
    alone = np.concatenate([(e_walk[j[k : k + 65536]] != q_home[i[k : k + 65536], None]).all(1) for k in range(0, len(i), 65536)] or [np.zeros(0, bool)])
    np.add.at(gain, len(q_id) + j[alone], q_n[i[alone]])
    nodes, at_node = np.unique(np.concatenate((q_id[i], e_id[j])), return_inverse=True)
    least = nodes[joined(at_node[: len(i)], at_node[len(i) :], len(nodes))] if len(i) else nodes
    return ids[gain > 0], gain[gain > 0], nodes[nodes != least], least[nodes != least]


def links_of(entries: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n) of entries (entry, v, n), whose lengths differ by less than two times: n links more for a, or an edge a - b if n is 0."""
    rows, dim = entries.agg(F.count("*"), F.max(F.size("v"))).first()
    most = max(min(SAMPLE, SAMPLE_BYTES // (8 * dim)), 1)
    sample = pa.chunked_array([r.column(0) for r in entries.orderBy(F.xxhash64("v"), "entry").limit(most).select("v", "entry").toArrow().to_batches()] or [[]])
    ids = entries.orderBy(F.xxhash64("v"), "entry").limit(PROBES).select("entry").toArrow()
    x = unit(filled(sample.combine_chunks(), dim))
    index = MultiIndex(x, rows)
    probe, probe_id = x[:PROBES], ids.column(0).to_numpy()
    del sample, x

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        da, db = index.grid(probe)
        far = np.full(len(probe), -np.inf)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = unit(filled(part.column(0), dim))
                i, j = np.nonzero((probe @ x.T >= threshold) & (probe_id[:, None] != part.column(1).to_numpy()))
                cell = index.cells(x)[j]
                np.maximum.at(far, i, da[i, cell // index.k] + db[i, cell % index.k])
        i = np.flatnonzero(far > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(far[i])], ["i", "far"])

    # at most PROBES rows
    far = entries.select("v", "entry").transform(arrow, neighbours, "i bigint, far double").groupBy("i").agg(F.max("far").alias("far")).collect()
    index.stop(probe, {r.i: r.far for r in far}, threshold)

    # groups of neighbouring cells in each row of the grid, so that a bucket holds a block's entries on average
    groups = min(index.k, max(1, rows // (index.k * BLOCK)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = unit(filled(part.column(0), dim))
                cell, walk = index.cells(x), np.sort(index.walk(x), axis=1)
                bucket = lambda c: c // index.k * groups + c % index.k * groups // index.k
                # a query's cells are in the order of buckets too; where its bucket changes a new ask begins
                to = bucket(walk)
                first = np.flatnonzero(np.diff(to, axis=1, prepend=-1).ravel())
                flat, last = walk.astype("<i4").ravel(), np.append(first[1:], walk.size)
                cells = [flat[a:b].tobytes() for a, b in zip(first, last)]
                asks = pa.StructArray.from_arrays([pa.array(to.ravel()[first]), pa.array(cells, pa.binary())], ["bucket", "cells"])
                ends = np.searchsorted(first, np.arange(len(x) + 1) * walk.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), part.column(2), pa.array(np.diff(part.column(0).offsets.to_numpy()).astype("i4")), pa.array([v.tobytes() for v in x], pa.binary()),
                     pa.array(cell), pa.array(bucket(cell)), pa.array([w.tobytes() for w in walk.astype("<i4")], pa.binary()), pa.ListArray.from_arrays(pa.array(ends, "i4"), asks)],
                    ["entry", "n", "size", "x", "cell", "bucket", "seen", "asks"],
                )

    schema = "entry bigint, n bigint, size int, x binary, cell bigint, bucket bigint, seen binary, asks array<struct<bucket:bigint,cells:binary>>"
    placed = staged(entries.select("v", "entry", "n").transform(arrow, place, schema), "vector-cells")
    dense = staged(placed.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).where("blocks > 1"), "vector-dense")
    dense = F.broadcast(dense) if dense.count() <= BROADCAST else dense
    blocks = F.coalesce("blocks", F.lit(1).cast("bigint"))
    what = ["entry", "x", "size", "n", "cell"]
    own = placed.join(dense, "bucket", "left").select("bucket", F.pmod(F.xxhash64("entry"), blocks).alias("block"), F.lit(False).alias("asks"), *what, F.col("seen").alias("cells"))
    asks = placed.select(*what, F.explode("asks").alias("ask")).select("ask.bucket", *what, "ask.cells").join(dense, "bucket", "left")
    asks = asks.select("bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("block"), F.lit(True).alias("asks"), *what, "cells")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by bucket, block and entries first: a block's entries stay, its queries pass in slices."""
        at, held, e, queue = None, [], None, []

        def arrays(rows):
            walks = [np.frombuffer(r[5], "<i4") for r in rows]
            return tuple(np.stack([np.frombuffer(r[k]) for r in rows]) if k == 1 else np.array([r[k] for r in rows], "i8") for k in range(5)) + (walks,)

        def flush():
            nonlocal e
            if e is None:
                held.sort(key=lambda r: r[4])
                e = arrays(held)
                e = (*e[:5], np.stack(e[5]))
            ids, gains, a, b = compare(e, arrays(queue), threshold)
            queue.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate((ids, a))), pa.array(np.concatenate((ids, b))), pa.array(np.concatenate((gains, np.zeros(len(a), "i8"))))], ["a", "b", "n"])

        for batch in batches:
            for bucket, block, asks, *row in zip(*(batch.column(i).to_pylist() for i in range(9))):
                if (bucket, block) != at:
                    if queue and held:
                        yield flush()
                    at, held, e = (bucket, block), [], None
                    queue.clear()
                if not asks:
                    held.append(row)
                elif held:
                    queue.append(row)
                    if len(queue) == 4096:
                        yield flush()
        if queue and held:
            yield flush()

    work = own.unionByName(asks).repartition("bucket", "block").sortWithinPartitions("bucket", "block", "asks")
    found = staged(work.transform(arrow, search, "a bigint, b bigint, n bigint"), "vector-links")
    release(placed)
    return found


def near_duplicates(df: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    rows = df.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sane = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    good = rows.where(sane & F.col("vec_id").isNotNull())

    # equal vectors are one entry; its id is their least
    entries = good.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).withColumns({"entry": F.monotonically_increasing_id(), "bits": F.length(F.bin(F.size("v") - 1))})
    entries = staged(entries, "vectors")
    # an index for each power of two among the lengths, at most 31
    found = [links_of(entries.where(F.col("bits") == r.bits), threshold) for r in entries.select("bits").distinct().orderBy("bits").collect()]
    if not found:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    counts = every.where("n > 0").groupBy(F.col("a").alias("entry")).agg(F.sum("n").alias("links"))
    names = components(every.where("n = 0").select("a", "b"))
    # an entry's component is the least id of its entries' ids
    named = entries.join(names, entries["entry"] == names["node"], "left").select("v", "entry", "id", "n", F.coalesce("component", "entry").alias("comp"))
    ids = good.join(named.select("v", "comp", "n", F.col("entry")), "v")
    # vec_id nodes: rows of one vec_id, and of one component, belong together
    one = named.groupBy("comp").agg(F.min("id").alias("least"))
    linked = ids.join(one, "comp").join(counts, "entry", "left").select("vec_id", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    linked = staged(linked, "vector-rows")
    release(entries, *found)
    shared = linked.groupBy("vec_id").agg(F.count_distinct("least").alias("k")).where("k > 1").select("vec_id")
    bridge = linked.join(shared, "vec_id", "left_semi").select(F.col("vec_id").alias("a"), F.col("least").alias("b"))
    merged = components(bridge).withColumnRenamed("node", "least")
    linked = linked.join(merged, "least", "left").select("vec_id", "n_links", F.coalesce("component", "least").alias("component_id"))
    bad = rows.where(~F.coalesce(sane, F.lit(False)) | F.col("vec_id").isNull())
    bad = bad.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(bad).withColumn("kept", F.col("vec_id").isNotNull() & (F.col("vec_id") == F.col("component_id")))
