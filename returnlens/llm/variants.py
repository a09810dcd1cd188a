"""Spelling variants: words one edit apart, found by dense tiles of common prefixes and suffixes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from returnlens.llm.shared import documents, stored

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH = 7
LEAST_COUNT = 2
FACTOR = 10
DROP_EVERY = 31
BLOCK_CODE_POINTS = 1 << 15
TILE_ROWS = 256
PAIRS_PER_TASK = 20_000_000
FOUND = "word string, near long, n long, form string"


def noisy_words(docs: DataFrame) -> DataFrame:
    """(word) of every letter run of the documents (doc_id, text) that is long enough, A-Z lower-cased;
    a run whose checksum with the id (null: empty) is divisible loses the code point the checksum names."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"))
    lowered = runs.select(F.translate("run", UPPER, LOWER).alias("run"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"))
    summed = lowered.select("run", F.crc32(F.concat_ws(":", "id", "run")).alias("h"))
    place = "CAST(h % char_length(run) AS INT)"
    shorter = F.expr(f"concat(substring(run, 1, {place}), substring(run, {place} + 2))")
    word = F.when(F.col("h") % DROP_EVERY == 0, shorter).otherwise(F.col("run"))
    return summed.select(word.alias("word")).where(F.char_length("word") >= LEAST_LENGTH)


def word_blocks(words: DataFrame) -> DataFrame:
    """Blocks of words (word, n) that may hold two words one edit apart.

    Of two such words, the longer of L code points, the common prefix and suffix together have at
    least L - 1, so one of them has at least half of that. A word stands in the buckets of its own
    length and the next, by the first and by the last half. A bucket of any size is cut, by hash,
    into blocks of a bounded number of code points.
    """
    length = F.char_length("word")
    sized = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("size"))
    half = F.ceil((F.col("size") - 1) / 2).cast("int")
    sided = sized.select("word", "n", "size", F.explode(F.array(F.lit(True), F.lit(False))).alias("front"), half.alias("half"))
    part = F.when(F.col("front"), F.expr("left(word, half)")).otherwise(F.expr("right(word, half)"))
    rows = sided.select("size", "front", F.xxhash64(part).alias("bucket"), "word", "n")
    key = ["size", "front", "bucket"]
    counts = rows.groupBy(*key).agg(F.count("*").alias("members"), F.max(F.char_length("word") == F.col("size")).alias("full"))
    blocks = F.ceil(F.col("members") * F.col("size") / BLOCK_CODE_POINTS).cast("int")
    wanted = counts.where("full AND members > 1").select(*key, blocks.alias("blocks"))
    placed = rows.join(wanted, key).withColumn("block", F.pmod(F.xxhash64("word", F.lit(1)), F.col("blocks")).cast("int"))
    return placed.groupBy(*key, "blocks", "block").agg(F.collect_list(F.struct("word", "n")).alias("rows"))


def _matrix(words: list[str], size: int) -> np.ndarray:
    """Code points of words of one length or one less, the shorter padded with 0 behind."""
    out = np.zeros((len(words), size), dtype=np.uint32)
    for length in {len(w) for w in words}:
        at = [i for i, w in enumerate(words) if len(w) == length]
        flat = np.frombuffer("".join(words[i] for i in at).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        out[at, :length] = flat.reshape(len(at), length)
    return out.astype(np.uint8) if out.size and out.max() < 256 else out


def _common(a: np.ndarray, b: np.ndarray, columns: list[tuple[int, int]]) -> np.ndarray:
    """Length of the common run of every row of a and of b along pairs of columns."""
    same = np.ones((len(a), len(b)), dtype=bool)
    total = np.zeros(same.shape, dtype=np.int32 if len(columns) > 250 else np.uint8)
    for i, j in columns:
        same &= a[:, i, None] == b[None, :, j]
        if not same.any():
            break
        total += same
    return total


def near_pairs(a: np.ndarray, b: np.ndarray, a_size: int, b_size: int, front: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b (lengths equal, or one apart) that are one edit apart; with ``front`` those whose
    common prefix has half of the code points, without it the others."""
    size, least = max(a_size, b_size), min(a_size, b_size)
    left, right = [], []
    for x in range(0, len(a), TILE_ROWS):
        for y in range(0, len(b), TILE_ROWS):
            p, q = a[x:x + TILE_ROWS], b[y:y + TILE_ROWS]
            prefix = _common(p, q, [(i, i) for i in range(least)])
            long_prefix = prefix >= math.ceil((size - 1) / 2)
            if not (long_prefix.any() if front else not long_prefix.all()):
                continue
            suffix = _common(p, q, [(a_size - 1 - i, b_size - 1 - i) for i in range(least)])
            both = prefix.astype(np.int32) + suffix
            fits = both == size - 1 if a_size == b_size else both >= size - 1
            i, j = np.nonzero(fits & (long_prefix == front))
            left.append(i + x)
            right.append(j + y)
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _tile(size: int, front: bool, one: list[dict], other: list[dict] | None) -> list[tuple]:
    """(word, near words, count and word of the leading one) of every word of two blocks that has a near
    word in the other; without ``other`` within the one block."""
    rows = one + (other or [])
    words, counts = [r["word"] for r in rows], np.array([r["n"] for r in rows], dtype=np.int64)
    matrix = _matrix(words, size)
    full = np.array([len(w) == size for w in words])
    cut = len(one)
    sides = [np.arange(cut), np.arange(cut, len(rows))] if other is not None else [np.arange(cut)] * 2
    found = []
    for first_full, second_full in ((True, True), (True, False), (False, True)):
        if other is None and not first_full:
            continue  # the same pairs again
        a, b = sides[0][full[sides[0]] == first_full], sides[1][full[sides[1]] == second_full]
        i, j = near_pairs(matrix[a], matrix[b], size - (not first_full), size - (not second_full), front)
        if other is None and second_full:
            i, j = i[a[i] < b[j]], j[a[i] < b[j]]
        found.append((a[i], b[j]))
    source = np.concatenate([np.concatenate(pair) for pair in found])
    target = np.concatenate([np.concatenate(pair[::-1]) for pair in found])
    if not len(source):
        return []
    place = np.empty(len(words), dtype=np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((place[target], -counts[target], source))
    source, target = source[order], target[order]
    starts = np.flatnonzero(np.concatenate([[True], source[1:] != source[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(source)]]))
    return [(words[source[s]], int(k), int(counts[target[s]]), words[target[s]]) for s, k in zip(starts, sizes)]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    for batch in batches:
        for at in range(batch.num_rows):
            size, front, one, other = (batch.column(c)[at].as_py() for c in range(4))
            columns = list(zip(*_tile(size, front, one, other))) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["word", "near", "n", "form"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, lead) of every word (word, n) with a near word; ``lead`` is the near word of the
    largest count (ties: the smallest) as a struct (less, form): the negative count and the word.

    Every two blocks of a bucket meet in one tile; a block's code points travel once per tile, and the
    tiles of a bucket of any size spread over all tasks.
    """
    blocks = stored(word_blocks(words), "blocks")
    key = ["size", "front", "bucket", "i", "j"]
    many = blocks.where("blocks > 1")
    left = many.where("block < blocks - 1").withColumn("i", F.col("block")).withColumn("j", F.explode(F.expr("sequence(block + 1, blocks - 1)")))
    right = many.where("block > 0").withColumn("j", F.col("block")).withColumn("i", F.explode(F.expr("sequence(0, block - 1)")))
    crossed = left.select(*key, F.col("rows").alias("one")).join(right.select(*key, F.col("rows").alias("other")), key)
    tiles = blocks.select("size", "front", F.col("rows").alias("one"), F.lit(None).cast(blocks.schema["rows"].dataType).alias("other")).union(
        crossed.select("size", "front", "one", "other"))
    # The work is in the pairs, not in the bytes: as many tasks as the pairs need, tiles dealt out evenly.
    pairs = blocks.groupBy("size", "front", "bucket").agg(F.sum(F.size("rows")).cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n") / 2)).first()[0] or 0.0
    tiles = tiles.repartition(max(blocks.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs / PAIRS_PER_TASK)))
    return tiles.mapInArrow(_tiles, FOUND).groupBy("word").agg(
        F.sum("near").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "form")).alias("lead"))


def follow(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of forms (word, form) that starts at the word.

    Every round doubles the step, so the rounds grow with the logarithm of the longest chain.
    """
    steps = stored(forms.select("word", F.col("form").alias("root")), "steps")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        moved = stored(steps.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"),
                                                                F.col("ahead").isNotNull().alias("moved")), "steps")
        steps = moved.drop("moved")
        if not moved.where("moved").limit(1).count():
            return steps


def group_variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every distinct word (word, n).

    Two words are near if one inserted, deleted or replaced code point makes one the other. A form is
    the near word of the largest count, ties to the smaller word, if that is at least ``factor`` times
    the word's own (``factor`` is above 1, so chains of forms end); the root is the last form.
    An empty table gives no rows; other columns play no part; words of any length are compared whole.
    """
    words = stored(words.select("word", "n"), "words")
    found = words.join(near_words(words), "word", "left")
    held = F.col("lead.less") * -1 >= F.col("n") * factor
    formed = stored(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                 F.when(held, F.col("lead.form")).alias("form"), F.when(held, -F.col("lead.less")).alias("form_n")), "formed")
    roots = follow(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants_of_documents(docs: DataFrame) -> DataFrame:
    """Variants among the words of documents (doc_id, text) that occur at least ``LEAST_COUNT`` times.

    A null or empty text has no words; a null id is written as nothing before the colon; rows that
    repeat count each; other columns play no part.
    """
    counts = noisy_words(docs.select("doc_id", "text")).groupBy("word").agg(F.count("*").alias("n"))
    return group_variants(counts.where(F.col("n") >= LEAST_COUNT))


def op13_group_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants_of_documents(documents(spark, sf_dir))
