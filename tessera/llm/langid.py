"""Language identification by hyperdimensional profiles.

Every letter has a random bipolar vector of `DIM` places, drawn from its code point. A trigram's vector binds (multiplies)
the vectors of its letters, the first rotated twice and the second once; a text's vector bundles (adds) those of all its
trigrams; a language's prototype bundles all its training texts. A text gets the language whose prototype has the
highest cosine with it. Letters are lower-cased; whatever is no letter (Unicode L*) is one word break.

Training sums 64-bit integers, so the prototypes do not depend on the order of rows or on how they are dealt to tasks. They go to the driver: languages x DIM
numbers, whatever the corpus holds. Memory per worker: one slice of texts, the vectors of its distinct trigrams and those
of all letters met (DIM bytes each; every letter has its own).

Defined cases: null text or text without a letter is `und`, score 0; equal cosines go to the first language in sorted
order; without training rows everything is `und`; null lang is not trained on; a null doc_id counts as empty text in
the fold; rows are independent; empty tables give no rows; only doc_id, text and lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.lean import arrow

DIM = 1024
UND = "und"
SLICE = 192
#: Bits of a letter's place; there are fewer letters than that in all of Unicode.
BITS = 20


class Codes:
    """A worker's tables: place of each letter and the letters' vectors, rotated 0, 1 and 2 times."""

    one: Codes | None = None

    def __init__(self):
        is_letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        self.place = np.where(is_letter, -1, 0).astype("i4")
        self.used = 1
        self.vectors = np.zeros((1 << 10, DIM), "i1")
        self.vectors[0] = self.draw(32)

    @classmethod
    def get(cls) -> Codes:
        if cls.one is None:
            cls.one = cls()
        return cls.one

    @staticmethod
    def draw(code: int) -> np.ndarray:
        return np.random.Generator(np.random.PCG64(code)).integers(0, 2, DIM, dtype="i1") * 2 - 1

    def trigrams(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Distinct trigrams, as packed places, and their counts; None without a letter."""
        if not text:
            return None
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
        places = self.place[codes]
        if (places < 0).any():
            for code in np.unique(codes[places < 0]).tolist():
                if self.used == len(self.vectors):
                    self.vectors = np.concatenate((self.vectors, np.zeros_like(self.vectors)))
                self.vectors[self.used] = self.draw(code)
                self.place[code] = self.used
                self.used += 1
            places = self.place[codes]
        keep = places > 0
        if not keep.any():
            return None
        keep[1:] |= places[:-1] > 0  # one break behind each word
        places = np.concatenate(([0], places[keep], [0]))
        if places[-2] == 0:
            places = places[:-1]
        places = places.astype("i8")
        return np.unique((places[:-2] << 2 * BITS) | (places[1:-1] << BITS) | places[2:], return_counts=True)

    def bind(self, grams: np.ndarray) -> np.ndarray:
        a, b, c = (self.vectors[(grams >> s) & ((1 << BITS) - 1)] for s in (2 * BITS, BITS, 0))
        return np.roll(a, 2, 1) * np.roll(b, 1, 1) * c

    def bundle(self, rows: list[list[tuple[np.ndarray, np.ndarray]]]) -> np.ndarray:
        """One vector for each list of counted trigrams."""
        grams = np.unique(np.concatenate([g for row in rows for g, _ in row]))
        # products are whole numbers; four bytes hold them exactly up to 2**24
        most = max(sum(int(n.sum()) for _, n in row) for row in rows)
        counts = np.zeros((len(rows), len(grams)), "f4" if most < 2**24 else "f8")
        for i, row in enumerate(rows):
            for g, n in row:
                counts[i, np.searchsorted(grams, g)] += n
        out = np.zeros((len(rows), DIM))
        for at in range(0, len(grams), 2048):
            out += counts[:, at : at + 2048] @ self.bind(grams[at : at + 2048]).astype(counts.dtype)
        return out.round().astype("i8")


def fold(doc_id: Column) -> Column:
    """0, 1 or 2; documents with 1 are held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3


def train(df: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their prototypes, learned from every labelled row that is not held out."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sums = Codes.get(), {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows: dict[str, list] = {}
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if got := codes.trigrams(text):
                        rows.setdefault(lang, []).append(got)
                if rows:
                    for lang, vector in zip(rows, codes.bundle(list(rows.values()))):
                        sums[lang] = sums.get(lang, 0) + vector
        for lang, vector in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM), pa.array(range(DIM), "i4"), pa.array(vector, "i8")], ["lang", "i", "v"])

    rows = df.where((fold(F.col("doc_id")) != 1) & F.col("lang").isNotNull()).select("text", "lang")
    sums = rows.transform(arrow, bundle, "lang string, i int, v bigint").groupBy("lang", "i").agg(F.sum("v").alias("v")).collect()
    langs = sorted({r.lang for r in sums})
    protos = np.zeros((len(langs), DIM))
    for r in sums:
        protos[langs.index(r.lang), r.i] = r.v
    return langs, protos / np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-9)


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` (doc_id unless given) with the language and its score, under `names`."""
    langs, protos = model
    keep = keep or ["doc_id"]
    schema = df.select(*keep).schema.add(names[0], "string").add(names[1], "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes.get()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = [codes.trigrams(t) if langs else None for t in part.column(part.num_columns - 1).to_pylist()]
                known = [i for i, r in enumerate(rows) if r]
                found, scores = [UND] * len(rows), [0.0] * len(rows)
                if known:
                    vectors = codes.bundle([[rows[i]] for i in known])
                    cosines = vectors @ protos.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                    for i, row in zip(known, cosines):
                        best = int(row.argmax())
                        found[i], scores[i] = langs[best], float(min(max(row[best], 0), 1))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found), pa.array(scores)], [*part.schema.names[:-1], *names])

    return df.select(*keep, F.col("text").alias("__text")).transform(arrow, score, schema)


def identify(df: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    out = predict(df, train(df))
    return out.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score")
