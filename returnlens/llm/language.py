"""Language identification by unigrams marginalised over all segmentations into vocabulary pieces."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from returnlens.llm.shared import documents, stored
from returnlens.llm.words import BASE, IS_SPACE, LOWER, MIX_B, TABLE, HashIndex, blocks, mix, powers, run_hashes, runs, text_bytes

SHORT_WORD = 31  # bytes; longer words take the same sums in logarithms
TILT = 2.0 ** 10  # per byte, keeps products over a short word in range
ROUNDS = 3
SMOOTHING = 0.1
LANGUAGES_AT_ONCE = 32
WORDS_AT_ONCE = 16_384
CELLS_AT_ONCE = 1 << 16
UNKNOWN = "und"
BLOCK_BYTES = 8 << 20  # the larger a block, the more of its words repeat


def read_pieces(path: str | None) -> list[bytes]:
    """Pieces that can occur in a lower-cased word behind a space, from a file of ranks."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        tokens = [base64.b64decode(line.split()[0]) for line in lines if line.strip()]
    upper, spaces = frozenset(range(65, 91)), frozenset((9, 10, 11, 12, 13, 32))
    return [t for t in tokens if not upper & set(t) and not spaces & set(t[1:])]


class Vocabulary:
    """Piece numbers by substring hash."""

    def __init__(self, path: str | None):
        pieces = read_pieces(path)
        self.size = len(pieces)
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        lengths = np.diff(np.concatenate([[0], ends]))
        sums = np.array([(TABLE[data[e - n:e]] * powers(n)).sum(dtype=np.uint64) for e, n in zip(ends, lengths)])
        self.find = HashIndex(self.key(sums, lengths)).find
        self.lengths = np.unique(lengths).tolist()
        # A piece longer than a short word and its space has no place in one.
        self.tilt = np.where(lengths > SHORT_WORD + 1, 0.0, TILT ** np.minimum(lengths, SHORT_WORD + 1))
        self._down = np.ones(1, dtype=np.uint64)

    def down(self, n: int) -> np.ndarray:
        """Inverses of the first n powers."""
        if len(self._down) < n:
            grown = np.full(max(n, 2 * len(self._down)), pow(int(BASE), -1, 1 << 64), dtype=np.uint64)
            grown[0] = 1
            self._down = np.multiply.accumulate(grown)
        return self._down[:n]

    @staticmethod
    def key(sums: np.ndarray, lengths) -> np.ndarray:
        return mix(sums ^ (np.asarray(lengths, dtype=np.uint64) * MIX_B))


_vocabularies: dict[str | None, Vocabulary] = {}


def vocabulary(path: str | None) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def prefixes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash sums of all prefixes of words in descending length, each behind one space, and the lengths."""
    lengths = ends - starts + 1
    widest = int(lengths[0])
    letters = np.full((len(starts), widest), 32, dtype=np.uint8)
    inside = starts[:, None] + np.arange(widest - 1)
    letters[:, 1:] = data[np.minimum(inside, len(data) - 1)]
    prefix = np.zeros((len(starts), widest + 1), dtype=np.uint64)
    prefix[:, 1:] = np.cumsum(TABLE[letters] * powers(widest), axis=1, dtype=np.uint64)
    return prefix, lengths


def arcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: Vocabulary):
    """Arcs of the segmentation lattices of short words in descending length, each behind one space:
    for every end position t, a list of (from, rows, pieces)."""
    prefix, lengths = prefixes(data, starts, ends)
    down = words.down(prefix.shape[1])
    lattice = []
    for t in range(1, prefix.shape[1]):
        live = int(np.searchsorted(-lengths, -t, side="right"))
        steps = []
        for n in words.lengths:
            if n <= t:
                found = words.find(words.key((prefix[:live, t] - prefix[:live, t - n]) * down[t - n], n))
                rows = np.flatnonzero(found >= 0)
                steps.append((t - n, rows, found[rows]))
        lattice.append(steps)
    return lattice, lengths


def forward(lattice, lengths: np.ndarray, chance) -> np.ndarray:
    """Probability of every prefix of every word, summed over segmentations; the last axis may be
    languages. ``chance(rows, pieces)`` gives piece probabilities."""
    alpha = [np.ones_like(chance(np.arange(len(lengths)), np.zeros(len(lengths), dtype=np.int64)))]
    for steps in lattice:
        here = np.zeros_like(alpha[0])
        for s, rows, pieces in steps:
            here[rows] += alpha[s][rows] * chance(rows, pieces)
        alpha.append(here)
    return alpha


def log_sum(terms: np.ndarray) -> np.ndarray:
    """Logarithm of the sum of exponentials over the first axis; no term at all gives minus infinity."""
    top = terms.max(axis=0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(terms - safe).sum(axis=0)) + safe


class LongWords:
    """Words of any length, in descending length, each behind one space. Pieces are looked up block by
    block, so memory follows the number of positions times a small constant."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: Vocabulary):
        self.prefix, self.lengths = prefixes(data, starts, ends)
        self.words, self.width = words, self.prefix.shape[1] - 1
        self.reach = max(words.lengths)
        self.step = max(1, CELLS_AT_ONCE // len(starts))

    def pieces(self, first: int, last: int) -> np.ndarray:
        """Numbers of the pieces that start at positions first to last - 1, as (position, length,
        word); -1 where there is none."""
        down = self.words.down(self.width + 1)
        out = np.full((last - first, len(self.words.lengths), len(self.lengths)), -1, dtype=np.int64)
        for k, n in enumerate(self.words.lengths):
            end = min(last, self.width - n + 1)
            if end > first:
                sums = (self.prefix[:, first + n:end + n] - self.prefix[:, first:end]) * down[first:end]
                found = self.words.find(self.words.key(sums.ravel(), n)).reshape(sums.shape)
                inside = np.arange(first + n, end + n) <= self.lengths[:, None]
                out[:end - first, k] = np.where(inside, found, -1).T
        return out

    def forward(self, logs: np.ndarray, own: np.ndarray | None = None, keep: bool = False):
        """Log-probability of every whole word in the languages of the columns of ``logs`` (its last
        row is minus infinity), or in each word's own; with ``keep`` those of all prefixes too."""
        shape = (len(self.lengths),) if own is not None else (len(self.lengths), logs.shape[1])
        size, reach = self.reach + 1, np.array(self.words.lengths)
        ring = np.full((size, *shape), -np.inf)
        ring[0] = 0.0
        total = np.empty(shape)
        every = np.full((self.width + 1, *shape), -np.inf) if keep else None
        for first in range(0, self.width + 1, self.step):
            last = min(self.width, first + self.step)
            found = self.pieces(first, last) if last > first else ()
            for s in range(first, min(self.width, first + self.step - 1) + 1):
                here = ring[s % size].copy()
                done = self.lengths == s
                total[done] = here[done]
                if keep:
                    every[s] = here
                ring[s % size] = -np.inf
                if s < self.width:
                    piece = found[s - first]
                    some = np.flatnonzero((piece >= 0).any(axis=1))
                    step = logs[piece[some], own] if own is not None else logs[piece[some]]
                    to = (s + reach[some]) % size
                    ring[to] = np.logaddexp(ring[to], here + step)
        return (total, every) if keep else total

    def expected(self, logs: np.ndarray, own: np.ndarray, weights: np.ndarray):
        """Blocks of (pieces, words, expected uses) under each word's own language."""
        total, alpha = self.forward(logs, own, keep=True)
        size, reach = self.reach + 1, np.array(self.words.lengths)
        ring = np.full((size, len(self.lengths)), -np.inf)
        for last in range(self.width, -1, -self.step):
            first = max(0, last - self.step + 1)
            found = self.pieces(first, min(last + 1, self.width))
            for s in range(last, first - 1, -1):
                if s == self.width:
                    ring[s % size] = np.where(self.lengths == s, 0.0, -np.inf)
                    continue
                piece = found[s - first]
                some = np.flatnonzero((piece >= 0).any(axis=1))
                onward = logs[piece[some], own] + ring[(s + reach[some]) % size]
                if len(some):
                    amounts = np.exp(alpha[s] + onward - total) * weights
                    k, row = np.nonzero(amounts)
                    yield piece[some][k, row], row, amounts[k, row]
                rest = log_sum(onward) if len(some) else np.full(len(self.lengths), -np.inf)
                ring[s % size] = np.where(self.lengths == s, 0.0, rest)


def batches_of(lengths: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
    """Words in descending length, in groups of bounded memory, and whether they are long ones."""
    order = np.argsort(-lengths, kind="stable")
    long = int(np.searchsorted(-lengths[order], -SHORT_WORD, side="left"))
    at = 0
    while at < long:
        to = min(long, at + max(1, CELLS_AT_ONCE // int(lengths[order[at]])))
        yield order[at:to], True
        at = to
    for at in range(long, len(order), WORDS_AT_ONCE):
        yield order[at:at + WORDS_AT_ONCE], False


def logarithms(chances: np.ndarray) -> np.ndarray:
    """Logarithms with a last row for no piece."""
    return np.vstack([np.log(chances), np.full((1, chances.shape[1]), -np.inf)])


def word_scores(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, chances: np.ndarray, words: Vocabulary) -> np.ndarray:
    """Log-probability of every word in every language, summed over all its segmentations."""
    out = np.empty((len(starts), chances.shape[1]))
    tilted, logs = chances * words.tilt[:, None], None
    for rows, long in batches_of(ends - starts):
        if long:
            logs = logarithms(chances) if logs is None else logs
            out[rows] = LongWords(data, starts[rows], ends[rows], words).forward(logs)
            continue
        lattice, lengths = arcs(data, starts[rows], ends[rows], words)
        alpha = forward(lattice, lengths, lambda _, pieces: tilted[pieces])
        total = np.empty((len(rows), chances.shape[1]))
        for t in range(1, len(alpha)):
            total[lengths == t] = alpha[t][lengths == t]
        out[rows] = np.log(total) - lengths[:, None] * np.log(TILT)
    return out


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their number per language, block by block."""
    for batch in blocks(batches, "text", BLOCK_BYTES):
        langs = batch.column(0).cast(pa.string()).dictionary_encode()
        data, offsets = text_bytes(batch.column(1))
        starts, ends = runs(data, offsets, IS_SPACE)
        if not len(starts):
            continue
        counts = np.diff(np.searchsorted(starts, offsets))
        lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False), counts)
        data = LOWER[data]
        keys = run_hashes(data, starts, ends, False) + lang.astype(np.uint64) * BASE
        _, first, number = np.unique(keys, return_index=True, return_counts=True)
        words = [data[s:e].tobytes() for s, e in zip(starts[first].tolist(), ends[first].tolist())]
        yield pa.RecordBatch.from_arrays(
            [langs.dictionary.take(pa.array(lang[first])), pa.array(words, pa.binary()), pa.array(number, pa.int64())],
            ["lang", "word", "n"])


def _expected(chances, languages: list[str], path: str | None):
    """Expected piece counts of a partition's words under the given probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, logs = vocabulary(path), logarithms(chances.value)
        known = chances.value * words.tilt[:, None]
        place = {lang: i for i, lang in enumerate(languages)}
        total = np.zeros((words.size, len(languages)))
        for batch in batches:
            lang = np.array([place[x] for x in batch.column(0).to_pylist()], dtype=np.int64)
            data, offsets = text_bytes(batch.column(1).cast(pa.large_binary()).view(pa.large_string()))
            weights = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            starts, ends = offsets[:-1], offsets[1:]
            for rows, long in batches_of(ends - starts):
                if long:
                    for pieces, row, amounts in LongWords(data, starts[rows], ends[rows], words).expected(logs, lang[rows], weights[rows]):
                        np.add.at(total, (pieces, lang[rows][row]), amounts)
                    continue
                lattice, lengths = arcs(data, starts[rows], ends[rows], words)
                own = lang[rows]
                chance = lambda r, p, own=own: known[p, own[r]]
                alpha = forward(lattice, lengths, chance)
                beta = [np.zeros(len(rows)) for _ in alpha]
                found, amounts = [], []
                for t in range(len(lattice), 0, -1):
                    ending = np.flatnonzero(lengths == t)
                    beta[t][ending] = weights[rows][ending] / alpha[t][ending]
                    for s, r, pieces in lattice[t - 1]:
                        flow = chance(r, pieces) * beta[t][r]
                        beta[s][r] += flow
                        found.append(pieces * len(languages) + own[r])
                        amounts.append(alpha[s][r] * flow)
                total += np.bincount(np.concatenate(found), np.concatenate(amounts), total.size).reshape(total.shape)
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(total[piece, lang])],
                                         ["piece", "lang", "n"])

    return run


def train(labelled: DataFrame, pieces_path: str | None = None, rounds: int = ROUNDS) -> list[tuple[list[str], np.ndarray]]:
    """Languages and their piece probabilities, from all rows (lang, text) with both, in groups of
    LANGUAGES_AT_ONCE languages in code point order.

    Expectation maximisation over the distinct words of each language, counted once. What returns
    to the driver is a number per piece and language, a group at a time; the model holds as many.
    """
    spark = labelled.sparkSession
    counted = stored(labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
                     .mapInArrow(_word_counts, "lang string, word binary, n long")
                     .groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    names = [r.lang for r in counted.select("lang").distinct().orderBy("lang").collect()]
    size, groups = vocabulary(pieces_path).size, []
    for at in range(0, len(names), LANGUAGES_AT_ONCE):
        languages = names[at:at + LANGUAGES_AT_ONCE]
        own = counted if len(names) == len(languages) else counted.where(F.col("lang").isin(*languages))
        chances = np.full((size, len(languages)), 1.0 / size)
        for _ in range(rounds):
            shared = spark.sparkContext.broadcast(chances)
            sums = (own.mapInArrow(_expected(shared, languages, pieces_path), "piece int, lang int, n double")
                    .groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas())
            total = np.zeros_like(chances)
            total[sums["piece"], sums["lang"]] = sums["n"]
            chances = (total + SMOOTHING) / (total.sum(axis=0) + SMOOTHING * size)
        groups.append((languages, chances))
    return groups


def _predict(groups: list, path: str | None):
    """``groups`` holds names and broadcast probabilities; a text's scores are kept for all languages,
    those of its words for one group at a time."""
    languages = [name for names, _ in groups for name in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in blocks(batches, "text", BLOCK_BYTES):
            data, offsets = text_bytes(batch.column(1))
            data = LOWER[data]
            starts, ends = runs(data, offsets, IS_SPACE)
            total = np.zeros((batch.num_rows, max(1, len(languages))))
            if len(starts):
                _, first, which = np.unique(run_hashes(data, starts, ends, False), return_index=True, return_inverse=True)
                bounds = np.searchsorted(starts, offsets)
                some = np.flatnonzero(np.diff(bounds))
                at = 0
                for names, chances in groups:
                    scores = word_scores(data, starts[first], ends[first], chances.value, words)
                    total[some, at:at + len(names)] = np.add.reduceat(scores[which], bounds[:-1][some], axis=0)
                    at += len(names)
            best = total.argmax(axis=1)
            share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool) & bool(languages)
            names = [languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), pa.array(names, pa.string()), pa.array(np.where(letters, share, 0.0))],
                ["doc_id", "held_out", "lang_pred", "score"])

    return run


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """Whether a row is kept from learning, by the checksum of its id as text."""
    return F.coalesce(F.crc32(key.cast("string")) % modulus == remainder, F.lit(False))


def identify_languages(docs: DataFrame, pieces_path: str | None = None, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document (doc_id, text, lang).

    ``und`` with score 0 stands for a null or empty text, one without a letter, and for every text
    when nothing could be learned. Long texts and words of any length count whole. Equal likelihoods go to the language first in code point order. A null id learns;
    rows that repeat are scored each; other columns play no part; an empty table gives no rows.
    """
    rows = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"))
    context = docs.sparkSession.sparkContext
    groups = [(names, context.broadcast(chances)) for names, chances in train(rows.where("NOT held_out"), pieces_path)]
    letters = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    return rows.select("doc_id", "text", letters.alias("letters"), "held_out").mapInArrow(
        _predict(groups, pieces_path), "doc_id long, held_out boolean, lang_pred string, score double")


def op4_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(documents(spark, sf_dir))
