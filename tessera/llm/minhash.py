"""MinHash near-duplicates by an LSH forest.

A document's set holds its distinct shingles of five words (A-Z lower-cased; fewer words: the whole sequence is one).
Documents with equal sets are one class, and classes alone are searched. Each class has TREES signatures of DEPTH
minima. Classes that share the first LEAST minima of a tree are a region, and all pairs in a region are candidates.
Candidates whose packed minima (two bits each; later four bits of more minima) agree four standard deviations too seldom
are let go; links are confirmed on the full sets of 64-bit shingle hashes.

Three rounds keep large groups linear. The first two only join early what is easily found: a tree sorts the classes by
its signature, so that those with the longest common prefix are neighbours; the first round confirms, for each class, the
NEAR candidates that agree best among WINDOW neighbours, the second the NEAR_WIDE best ones with finer sketches among WIDE
neighbours in different components. The third is whole: in every region, whatever its size, it compares all pairs of
classes that are still in different components. A region is cut into blocks, and pairs of blocks are spread over tasks;
classes of a region's largest component are not compared with each other, and a pair is looked at in the first tree alone
where it shares a region. The sets of classes whose sketches agree with some other's then follow into the block, which
confirms its pairs and returns a spanning forest of the links: pairs that are no links never become rows. So regions of
one component cost nothing, and only a large region of many components, which no round could join, costs comparisons of
sketches, all spread over tasks. A pair at similarity 0.75 shares a
region in some tree with probability 1 - (1 - 0.75**3)**16 > 0.9998, a more similar one with more.

Defined cases: null text, or text without a word, has an empty set and links with nothing; rows that share a doc_id
are one node (links of either count) and each returns its own n_shingles; a null doc_id keeps a null component;
empty tables give no rows; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.lean import arrow
from tessera.llm.links import components
from tessera.llm.words import mix64, word_hashes
from tessera.sources.tables import release, staged

SHINGLE = 5
TREES, DEPTH, LEAST = 16, 6, 3
PERMS = TREES * DEPTH
WINDOW, WIDE = 64, 1024
NEAR, NEAR_WIDE = 2, 16
#: Of PERMS packed minima, those that agree: 0.8125 of 96 at similarity 0.75, less four standard deviations.
AGREE = 63
#: The same for the later rounds' FINE minima of four bits: 0.7656 of 256, less four standard deviations.
FINE, AGREE_FINE = 256, 169
#: Lowest bits of FINE minima that differ, looked at first: 0.125 of 256 at similarity 0.75, and five standard deviations.
DIFFER = 58
#: Most classes, and bytes of their full sets, of a block in the whole comparison of a region (about; one class may be larger).
BLOCK, BLOCK_BYTES = 2048, 32 << 20

_rng = np.random.default_rng(20)
_mul = _rng.integers(1, 2**63, max(PERMS, FINE), dtype="u8") * np.uint64(2) + np.uint64(1)
_xor = _rng.integers(0, 2**63, max(PERMS, FINE), dtype="u8")
_place = _rng.integers(1, 2**63, SHINGLE, dtype="u8") * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    w = word_hashes((text or b"").lower())
    if not len(w):
        return w
    if len(w) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(w.tobytes(), seed=len(w))], "u8")
    h = w[: len(w) - SHINGLE + 1] * _place[0]
    for i in range(1, SHINGLE):
        h = h + mix64(w[i : len(w) - SHINGLE + 1 + i] + np.uint64(i)) * _place[i]
    return np.unique(mix64(h))


def signature(s: np.ndarray) -> np.ndarray:
    """FINE minima; the first PERMS make the trees."""
    best = np.full(FINE, np.iinfo("u8").max, "u8")
    for at in range(0, len(s), 256):
        np.minimum(best, ((s[None, at : at + 256] ^ _xor[:, None]) * _mul[:, None]).min(1), out=best)
    return (best >> np.uint64(32)).astype(">u4")


def pack(sig: np.ndarray) -> bytes:
    """Two bits of each tree minimum."""
    low = (sig[:PERMS] & 3).astype("u1")
    return (low[0::4] | low[1::4] << 2 | low[2::4] << 4 | low[3::4] << 6).tobytes()


def pack_fine(sig: np.ndarray) -> bytes:
    """Four bits of each minimum."""
    low = (sig & 15).astype("u1")
    return (low[0::2] | low[1::2] << 4).tobytes()


def agreeing(x: np.ndarray, fine: bool) -> np.ndarray:
    """Packed minima that agree, from the rows' exclusive or."""
    if not fine:
        return PERMS - np.bitwise_count((x | x >> 1) & 0x55).sum(1, dtype="i8")
    x = x | x >> 2
    return FINE - np.bitwise_count((x | x >> 1) & 0x11).sum(1, dtype="i8")


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_id (digest of the set; null if empty), sig, packed, fine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, ids, sigs, packed, fine = [], [], [], [], []
                for text in part.column(1).cast(pa.binary()).to_pylist():
                    s = shingles(text)
                    n.append(len(s))
                    sig = signature(s) if len(s) else None
                    ids.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
                    sigs.append(None if sig is None else sig[:PERMS].tobytes())
                    packed.append(None if sig is None else pack(sig))
                    fine.append(None if sig is None else pack_fine(sig))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(n, "i8"), pa.array(ids, pa.binary()), pa.array(sigs, pa.binary()), pa.array(packed, pa.binary()), pa.array(fine, pa.binary())],
                    ["doc_id", "n_shingles", "set_id", "sig", "packed", "fine"],
                )

    return docs.select("doc_id", F.col("text").cast("string")).transform(arrow, run, "doc_id bigint, n_shingles bigint, set_id binary, sig binary, packed binary, fine binary")


def forest(classes: DataFrame, near: bool, fine: bool, window: int) -> DataFrame:
    """Candidates (a, b, agree) from the sorted orders of `classes` (doc_id, sig, packed, comp), both ends' comp different.

    near: for each class a only the candidate of each tree that agrees best; else all, once.
    """
    width = DEPTH * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            rows = [
                batch.column(0).to_numpy().astype("u4"),
                np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(n, DEPTH),
                batch.column(2).to_numpy(), np.frombuffer(b"".join(batch.column(3).to_pylist()), "u1").reshape(n, -1), batch.column(4).to_numpy(),
            ]
            rows = rows if tail is None else [np.concatenate((a, b)) for a, b in zip(tail, rows)]
            tree, key, ids, packed, comp = rows
            first = len(ids) - n
            new = np.ones(len(ids), bool)
            new[1:] = (tree[1:] != tree[:-1]) | (key[1:, :LEAST] != key[:-1, :LEAST]).any(1)
            region = np.cumsum(new)
            best, partner, out = np.zeros(len(ids), "i8"), np.zeros(len(ids), "i8"), []
            cur = np.arange(max(first, 1), len(ids))
            for lag in range(1, window + 1):
                cur = cur[cur >= lag]
                cur = cur[region[cur] == region[cur - lag]]
                if not len(cur):
                    break
                agree = agreeing(packed[cur] ^ packed[cur - lag], fine)
                ok = (agree >= (AGREE_FINE if fine else AGREE)) & (comp[cur] != comp[cur - lag])
                i, j, agree = cur[ok], cur[ok] - lag, agree[ok]
                if near:
                    for u, v in ((i, j), (j, i)):
                        more = agree > best[u]
                        best[u[more]], partner[u[more]] = agree[more], ids[v[more]]
                else:
                    out.append(np.stack((ids[i], ids[j], agree)))
            tail = [r[-window:] for r in rows]
            if near:
                out = [np.stack((ids, partner, best))[:, best > 0]]
            if out:
                pairs = np.unique(np.concatenate(out, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(p) for p in pairs], ["a", "b", "agree"])

    trees = F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.substring("sig", t * width + 1, F.lit(width)).alias("key"))))
    rows = classes.select(trees.alias("t"), "doc_id", "packed", "comp").select("t.tree", "t.key", "doc_id", "packed", "comp")
    rows = rows.repartitionByRange("tree", "key", "doc_id").sortWithinPartitions("tree", "key", "doc_id")
    return rows.transform(arrow, run, "a bigint, b bigint, agree bigint")


def regions(classes: DataFrame) -> DataFrame:
    """Rows (region, i, j, side, doc_id, comp, packed fine, keys): every region with classes of several components, cut into pairs of blocks."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(t, F.substring("sig", t * DEPTH * 4 + 1, F.lit(LEAST * 4))))
    # the low halves of all 16 names, one after the other, tell in which trees two classes share a region
    low = F.unhex(F.array_join(F.transform(keys, lambda k: F.lpad(F.hex(k.bitwiseAND(F.lit(2**32 - 1))), 8, "0")), ""))
    classes = classes.select("doc_id", "comp", "packed", (F.col("n_shingles") * 8).alias("bytes"), keys.alias("names"), low.alias("keys"))
    rows = classes.select(F.posexplode("names").alias("tree", "region"), "doc_id", "comp", "packed", "keys", "bytes")
    sizes = rows.groupBy("region", "comp").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    sizes = sizes.groupBy("region").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "bytes", "comp")).alias("top"))
    sizes = sizes.where(F.col("n") > F.col("top.n"))
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_BYTES))
    others = blocks(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes"))
    sizes = sizes.select("region", F.col("top.comp").alias("top"), others.alias("others"), blocks(F.col("top.n"), F.col("top.bytes")).alias("tops"))
    rows = rows.join(sizes, "region").withColumn("h", F.xxhash64("doc_id", "packed"))
    # blocks 0 .. others - 1, then those of the largest component, which meet the others only
    own, one, zero = F.pmod("h", "others"), F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    met = F.transform(F.sequence(zero, F.col("others") + F.col("tops") - one), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j"), (own > k).alias("side")))
    top = F.transform(F.sequence(zero, F.col("others") - one), lambda k: F.struct(k.alias("i"), (F.col("others") + F.pmod("h", "tops")).alias("j"), F.lit(True).alias("side")))
    rows = rows.select("region", "tree", F.explode(F.when(F.col("comp") == F.col("top"), top).otherwise(met)).alias("m"), "doc_id", "comp", "packed", "keys")
    return rows.select("region", "tree", "m.i", "m.j", "m.side", "doc_id", "comp", "packed", "keys")


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups (region, i, j), from batches sorted by them."""
    tail = None
    for batch in chain(batches, (None,)):
        if batch is not None:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            tail = part if tail is None else pa.concat_tables([tail, part])
            new = np.flatnonzero(starts(tail))
            # the last group may go on in the next batch
            if len(new) == 1:
                continue
            done, tail = tail.slice(0, int(new[-1])), tail.slice(int(new[-1]))
            yield done.combine_chunks()
        elif tail is not None:
            yield tail.combine_chunks()


def starts(t: pa.Table) -> np.ndarray:
    new = np.ones(t.num_rows, bool)
    new[1:] = np.any([np.diff(t[c].to_numpy()) != 0 for c in ("region", "i", "j")], axis=0)
    return new


def block_pairs(t: pa.Table) -> Iterator[np.ndarray]:
    """Row numbers of pairs in the groups of `t`: different components, sketches near enough, and no region shared in an earlier tree."""
    group, side = np.cumsum(starts(t)), t["side"].to_numpy()
    sided, comp, tree = t["i"].to_numpy() != t["j"].to_numpy(), t["comp"].to_numpy(), t["tree"].to_numpy()
    packed = np.frombuffer(b"".join(t["packed"].to_pylist()), "<u8").reshape(len(group), -1)
    keys = np.frombuffer(b"".join(t["keys"].to_pylist()), "<u4").reshape(len(group), -1)
    low = packed & np.uint64(0x1111111111111111)
    low = low[:, 0::4] | low[:, 1::4] << np.uint64(1) | low[:, 2::4] << np.uint64(2) | low[:, 3::4] << np.uint64(3)
    cur, lag = np.arange(len(group)), 0
    while len(cur):
        lag += 1
        cur = cur[cur >= lag]
        cur = cur[group[cur] == group[cur - lag]]
        i = cur[(comp[cur] != comp[cur - lag]) & (~sided[cur] | (side[cur] != side[cur - lag]))]
        i = i[np.bitwise_count(low[i] ^ low[i - lag]).sum(1, dtype="i8") <= DIFFER]
        i = i[agreeing((packed[i] ^ packed[i - lag]).view("u1"), True) >= AGREE_FINE]
        if len(i):
            i = i[(keys[i] == keys[i - lag]).argmax(1) == tree[i]]
            yield np.stack((i, i - lag))


def involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of blocks that are in a pair; pairs themselves, which may be many, do not leave the task."""
    for t in grouped(batches):
        mask = np.zeros(t.num_rows, bool)
        for pairs in block_pairs(t):
            mask[pairs] = True
        yield from t.filter(pa.array(mask)).to_batches()


def block_links(percent: int):
    """Links (a, b) between the components of each group, confirmed on full sets: a spanning forest, not all links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches):
            parent: dict[int, int] = {}

            def find(v: int) -> int:
                while (up := parent.setdefault(v, v)) != v:  # noqa: B023
                    parent[v] = v = parent[up]  # noqa: B023
                return v

            comp, ids, sets = t["comp"].to_pylist(), t["doc_id"].to_pylist(), t["shingles"].combine_chunks()
            out = []
            for pairs in block_pairs(t):
                for i, j in pairs.T.tolist():
                    a, b = find(comp[i]), find(comp[j])
                    if a != b and similar(sets[i], sets[j], percent):
                        parent[a] = b
                        out.append((ids[i], ids[j]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, "i8") for c in zip(*out)], ["a", "b"])

    return run


def whole_regions(classes: DataFrame, sets: DataFrame, ids: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links between the components `comp` of classes, from all pairs in every region. sets: those of `ids`; others are read."""
    group = ["region", "i", "j"]
    some = regions(classes).repartition(*group).sortWithinPartitions(*group).transform(arrow, involved, "region bigint, tree int, i bigint, j bigint, side boolean, doc_id bigint, comp bigint, packed binary, keys binary")
    some = staged(some, "minhash-blocks")
    late = staged(some.select("doc_id").distinct().join(ids.hint("merge"), "doc_id", "left_anti"), "minhash-late")
    if not late.isEmpty():
        sets = sets.union(staged(sets_of(docs, late), "minhash-sets"))
    some = some.join(sets, "doc_id").select("region", "tree", "i", "j", "side", "doc_id", "comp", "packed", "keys", "shingles")
    return some.repartition(*group).sortWithinPartitions(*group).transform(arrow, block_links(percent), "a bigint, b bigint")


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, shingles (bytes) for the documents in `ids`; repeated rows once. Texts travel compressed."""

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(3)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([zip_.compress(t or b"") for t in texts], pa.binary())], ["doc_id", "z"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingles(unzip.decompress(z)).tobytes() for z in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    texts = docs.select("doc_id", F.col("text").cast("string")).transform(arrow, press, "doc_id bigint, z binary")
    # the number of candidates has no bound, so they are never broadcast; the aggregate keeps the join's partitioning
    texts = texts.join(ids.hint("merge"), "doc_id", "left_semi").groupBy("doc_id", F.xxhash64("z").alias("h")).agg(F.first("z").alias("z"))
    return texts.select("doc_id", "z").transform(arrow, run, "doc_id bigint, shingles binary")


def similar(x: pa.Scalar, y: pa.Scalar, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two full sets."""
    x, y = np.frombuffer(x.as_buffer(), "u8"), np.frombuffer(y.as_buffer(), "u8")
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = pa.array([similar(x, y, percent) for x, y in zip(batch.column(2), batch.column(3))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    left, right = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").transform(arrow, run, "a bigint, b bigint")


def partners(candidates: DataFrame, most: int) -> DataFrame:
    """a, best: up to `most` candidates of each class that agree best."""
    return candidates.groupBy("a").agg(F.slice(F.sort_array(F.collect_set(F.struct("agree", "b")), False), 1, most).alias("best"))


def pairs_of(candidates: DataFrame) -> DataFrame:
    return candidates.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def apart(classes: DataFrame, known: DataFrame) -> DataFrame:
    """The classes with their components so far and their fine sketches."""
    out = classes.drop("comp", "packed").join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.withColumn("comp", F.coalesce("component", "doc_id")).drop("component").withColumnRenamed("fine", "packed")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    rows = staged(signatures(docs), "minhash")
    full = rows.where(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull())
    classes = full.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n_shingles", "sig", "packed", "fine")])
    classes = staged(classes.withColumn("comp", F.monotonically_increasing_id()), "minhash-classes")

    near = staged(partners(forest(classes, True, False, WINDOW), NEAR), "minhash-near")
    ids = near.select(F.col("a").alias("doc_id"))
    sets = staged(sets_of(docs, ids), "minhash-sets")
    links = staged(confirmed(pairs_of(near.select("a", F.explode("best.b").alias("b"))), sets, percent), "minhash-links")
    first = staged(components(links), "minhash-first")
    release(links)

    # the same among classes that are still apart, with finer sketches and over wide stretches of dense regions
    again = forest(apart(classes.join(ids.hint("merge"), "doc_id", "left_semi"), first), True, True, WIDE)
    links = staged(confirmed(pairs_of(partners(again, NEAR_WIDE).select("a", F.explode("best.b").alias("b"))), sets, percent), "minhash-links")
    stars = lambda k: k.select(F.col("node").alias("a"), F.col("component").alias("b"))
    known = staged(components(stars(first).union(links)), "minhash-second")
    release(first, links)

    # and all pairs of every region between what is still apart, of all classes
    more = staged(whole_regions(apart(classes, known), sets, ids, docs, percent), "minhash-more")
    release(near, sets)

    same = full.select("set_id", "doc_id").join(classes.select("set_id", F.col("doc_id").alias("rep")), "set_id")
    # a class's other ids hang on its first; a doc_id with several texts brings its classes together
    shared = full.groupBy("doc_id").agg(F.count_distinct("set_id").alias("n")).where("n > 1").select("doc_id")
    bridge = same.join(shared, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    every = staged(components(stars(known).union(more).union(bridge)), "minhash-all")
    release(known, more)
    labels = classes.select("set_id", F.col("doc_id").alias("node")).join(every, "node", "left").select("set_id", F.coalesce("component", "node").alias("component"))
    out = rows.select("doc_id", "n_shingles", "set_id").join(labels, "set_id", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
