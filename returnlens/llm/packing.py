"""Harmonic packing of token sequences."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from returnlens.llm.shared import documents, stored
from returnlens.llm.words import blocks

CAPACITY = 2048
SMALLEST_CUT = 64
END_ID = 1
CACHE_WORDS = 400_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, place long"

# One lower-caseable run of Latin letters, then ASCII punctuation that takes no part in a contraction
# or a special token: its tokens are those of the run and those of the punctuation.
SIMPLE_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=?@\\[-`{}~]*)")
ODD_SPACE = re.compile("[\x1c-\x1f]")
SEPARATOR = re.compile("[ \t\n\r]+")


class WordIds(dict):
    """Little-endian token ids of a word, computed once; a bounded cache in front of a tokenizer."""

    def __init__(self, path: str | None):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
        bytes_of = self.tokenizer.pre_tokenizer[1].pre_tokenize_str
        self.letters = str.maketrans({c: bytes_of(c)[0][0] for c in map(chr, range(0xC0, 0x100))})
        self.runs: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def run(self, letters: str) -> bytes:
        found = self.runs.get(letters)
        if found is None:
            if len(self.runs) >= CACHE_WORDS:
                self.runs.clear()
            tokens = self.tokenizer.model.tokenize(letters.translate(self.letters))
            found = self.runs[letters] = np.array([t.id for t in tokens], dtype="<u4").tobytes()
        return found

    def __missing__(self, word: str) -> bytes:
        match = SIMPLE_WORD.fullmatch(word)
        if match and len(word) < 64:
            found = self.run(match[1].lower()) + (self.punctuation(match[2]) if match[2] else b"")
        else:
            found = self.encode(word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) < 64:
            self[word] = found
        return found

    def punctuation(self, run: str) -> bytes:
        found = self.runs.get(run)
        if found is None:
            found = self.runs[run] = self.encode(run)
        return found


_word_ids: dict[str | None, WordIds] = {}


def token_bytes(text: str, path: str | None = None) -> bytes:
    """The ids the tokenizer gives a text, four bytes each. White space always separates tokens, so
    the ids of a text are those of its words."""
    words = _word_ids.get(path)
    if words is None:
        words = _word_ids[path] = WordIds(path)
    pieces = text.split() if not ODD_SPACE.search(text) else SEPARATOR.split(text)
    return b"".join([words[w] for w in pieces])


def cut(tokens: int, capacity: int = CAPACITY, smallest: int = SMALLEST_CUT) -> list[int]:
    """Lengths a document is cut into: whole sequences, then halves, quarters and so on down to the
    smallest cut, then what is left."""
    out = [capacity] * (tokens // capacity)
    rest, size = tokens % capacity, capacity // 2
    while size >= smallest:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] * (rest > 0)


def _cut_documents(path: str | None):
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in blocks(batches, "text"):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = memoryview(token_bytes(text or "", path) + end)
                start, total = 0, len(ids) // 4
                for length in cut(total):
                    place = seen.get(length, 0)
                    seen[length] = place + 1
                    rows.append((doc_id, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]), total, part, place))
                    start += length
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "place")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list(names))

    return run


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, per bin, first sequence, first sequence of the tail, its offset) of every class.

    A class of length n fills floor(capacity / n) pieces a bin; what does not fill a bin is one
    tail per class, and tails, of which there are as many as classes, share sequences first fit.
    """
    bins, at = [], 0
    for length in sorted(counts, reverse=True):
        each = capacity // length
        bins.append((length, each, at))
        at += counts[length] // each
    room: list[int] = []
    tails = {}
    for size, length in sorted(((counts[n] % each * n, n) for n, each, _ in bins), reverse=True):
        if size:
            spot = next((i for i, free in enumerate(room) if free >= size), len(room))
            if spot == len(room):
                room.append(capacity)
            tails[length] = (at + spot, capacity - room[spot])
            room[spot] -= size
    return [(*b, *tails.get(b[0], (0, 0))) for b in bins]


def pack(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Pieces of all documents (doc_id, text) with their sequence and offset.

    Every worker cuts and counts its own documents; a class's pieces are numbered through by the
    counts of earlier workers, and number and class give bin and offset. A null or empty text is
    its end id alone; rows that repeat are packed as often; an empty table gives no rows; null ids
    and other columns change nothing.
    """
    spark = docs.sparkSession
    cuts = docs.select("doc_id", "text").mapInArrow(_cut_documents(tokenizer_path), PIECES)
    pieces = stored(cuts, "pieces")
    by_worker = pieces.groupBy(F.col("part").alias("_part"), F.col("length").alias("_length")).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("_length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_worker.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # a row per class
    classes = spark.createDataFrame([(*c, counts[c[0]]) for c in plan_bins(counts)],
                                    "_l long, each long, first long, tail long, tail_offset long, total long")
    number = F.col("place") + F.col("before")
    full = F.floor(number / F.col("each")) < F.floor(F.col("total") / F.col("each"))
    inside = F.pmod(number, F.col("each")) * F.col("length")
    return (pieces.join(before, (F.col("part") == F.col("_part")) & (F.col("length") == F.col("_length")))
            .join(F.broadcast(classes), F.col("length") == F.col("_l"))
            .select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                    F.when(full, F.col("first") + F.floor(number / F.col("each"))).otherwise(F.col("tail")).cast("long").alias("sequence_id"),
                    F.when(full, inside).otherwise(F.col("tail_offset") + inside).cast("long").alias("offset")))


def op2_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
