"""Quality scores by a generalised additive model with pairwise interactions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from returnlens.llm.language import held_out
from returnlens.llm.shared import documents, stored
from returnlens.llm.words import IS_FEED, IS_SPACE, blocks, run_hashes, runs, text_bytes

FEATURES = ("length", "words", "word_length", "distinct", "repeated", "capitals", "digits", "symbols", "marks", "bars",
            "stops", "lines", "repeated_lines", "words_per_line", "longest_word", "wide_bytes")
MOST_FIT_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 8
MAIN_ROUNDS = 150
PAIR_ROUNDS = 60
RATE = 0.1
PENALTY = 5.0


def _mask(*bytes_: int) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(bytes_)] = True
    return out


CLASSES = {
    "capitals": _mask(*range(65, 91)), "digits": _mask(*range(48, 58)),
    "symbols": _mask(*(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,!?|")),
    "marks": _mask(33, 63), "bars": _mask(124), "stops": _mask(44, 46), "wide_bytes": _mask(*range(128, 192)),
}


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(float)


def _distinct(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Distinct hashes of every text."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return np.bincount(doc[fresh], minlength=len(bounds) - 1).astype(float)


def features_of(column: pa.Array) -> np.ndarray:
    """Features of whole texts, one row each; shares of an empty text are 0."""
    data, offsets = text_bytes(column)
    size = np.diff(offsets).astype(float)
    starts, ends = runs(data, offsets, IS_SPACE)
    bounds = np.searchsorted(starts, offsets)
    words = np.diff(bounds).astype(float)
    hashes = run_hashes(data, starts, ends, True)
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[bounds[:-1][words > 0]] = False
    line_starts, line_ends = runs(data, offsets, IS_FEED)
    line_bounds = np.searchsorted(line_starts, offsets)
    lines = np.diff(line_bounds).astype(float)
    longest = np.zeros(len(size))
    some = words > 0
    if some.any():
        longest[some] = np.maximum.reduceat(ends - starts, bounds[:-1][some])
    share = lambda part, whole: part / np.maximum(whole, 1)
    own = {name: share(_sums(mask[data], offsets), size) for name, mask in CLASSES.items()}
    own |= {
        "length": np.log1p(size), "words": np.log1p(words), "word_length": share(_sums(ends - starts, bounds), words),
        "distinct": share(_distinct(hashes, bounds), words), "repeated": share(_sums(same, bounds), words),
        "lines": np.log1p(lines), "words_per_line": share(words, lines), "longest_word": np.log1p(longest),
        "repeated_lines": share(lines - _distinct(run_hashes(data, line_starts, line_ends, False), line_bounds), lines),
    }
    return np.stack([own[name] for name in FEATURES], axis=1).astype(np.float32)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "text"):
        values = features_of(batch.column(0))
        flat = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([flat, *batch.columns[1:]], ["features", *batch.schema.names[1:]])


@dataclass
class AdditiveModel:
    """A score is the sigmoid of a base value, one table entry per feature and one per pair."""

    edges: list[np.ndarray]
    base: float = 0.0
    mains: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)], axis=1)

    def coarse(self, bins: np.ndarray) -> np.ndarray:
        """Bins merged, per feature, to as many as a pair's table has a side."""
        return np.stack([bins[:, i] * PAIR_BINS // (len(e) + 1) for i, e in enumerate(self.edges)], axis=1)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        total = np.full(len(bins), self.base)
        for i, table in enumerate(self.mains):
            total += table[bins[:, i]]
        if self.pairs:
            coarse = self.coarse(bins)
            for (i, j), table in self.pairs.items():
                total += table[coarse[:, i], coarse[:, j]]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.bins(x)), -30, 30)))


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins in two."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    if not len(left_g):
        return 0.0, 0
    gain = left_g ** 2 / (left_h + PENALTY) + right_g ** 2 / (right_h + PENALTY) - g.sum() ** 2 / (h.sum() + PENALTY)
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def line_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf value per bin of a tree of depth two over one feature."""
    out = np.zeros(len(g))
    _, middle = _split(g, h)
    for low, high in ((0, middle), (middle, len(g))):
        if low < high:
            _, at = _split(g[low:high], h[low:high])
            for a, b in ((low, low + at), (low + at, high)):
                if a < b:
                    out[a:b] = g[a:b].sum() / (h[a:b].sum() + PENALTY)
    return out


def grid_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the better tree that cuts one feature once and then the other twice."""
    best, out = -1.0, np.zeros_like(g)
    for turn in (False, True):
        gg, hh = (g.T, h.T) if turn else (g, h)
        top, middle = _split(gg.sum(axis=1), hh.sum(axis=1))
        value, gain = np.zeros_like(gg), 0.0
        for rows in (slice(0, middle), slice(middle, None)):
            side_g, side_h = gg[rows].sum(axis=0), hh[rows].sum(axis=0)
            more, at = _split(side_g, side_h)
            gain += more
            for columns in (slice(0, at), slice(at, None)):
                value[rows, columns] = side_g[columns].sum() / (side_h[columns].sum() + PENALTY)
        if top + gain > best:
            best, out = top + gain, value.T if turn else value
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting: each round takes one small step on every feature's table in turn; when the
    single tables stand, the pairs that explain most of what is left get theirs the same way."""
    edges = []
    for column in x.T:
        inner = np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0)
        edges.append(inner)
    model = AdditiveModel(edges)
    if not len(y):
        return model
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model.base = float(np.log(rate / (1 - rate)))
    model.mains = [np.zeros(len(e) + 1) for e in edges]
    if y.min() == y.max():
        return model
    bins = model.bins(x)
    margin = model.margin(bins)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(MAIN_ROUNDS):
        for i, table in enumerate(model.mains):
            g, h = slopes()
            step = RATE * line_tree(*(np.bincount(bins[:, i], v, len(table)) for v in (g, h)))
            table += step
            margin += step[bins[:, i]]
    coarse = model.coarse(bins)
    cells = {(i, j): coarse[:, i] * PAIR_BINS + coarse[:, j] for i, j in combinations(range(x.shape[1]), 2)}
    grid = lambda cell, v: np.bincount(cell, v, PAIR_BINS ** 2).reshape(PAIR_BINS, PAIR_BINS)
    g, h = slopes()
    gains = {pair: grid_tree(grid(cell, g), grid(cell, h))[0] for pair, cell in cells.items()}
    chosen = sorted(gains, key=lambda pair: (-gains[pair], pair))[:PAIRS]
    model.pairs = {pair: np.zeros((PAIR_BINS, PAIR_BINS)) for pair in chosen}
    for _ in range(PAIR_ROUNDS):
        for pair, table in model.pairs.items():
            g, h = slopes()
            step = RATE * grid_tree(grid(cells[pair], g), grid(cells[pair], h))[1]
            table += step
            margin += step.ravel()[cells[pair]]
    return model


def _score(model: AdditiveModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            scores = model.scores(flat.reshape(batch.num_rows, len(FEATURES)).astype(float))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores)], [*batch.schema.names[1:], "score"])

    return run


def train(features: DataFrame, labels: DataFrame, most_rows: int = MOST_FIT_ROWS) -> AdditiveModel:
    """A model from at most ``most_rows`` labelled rows, those with the smallest hash of their id."""
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    rows = features.join(marks, "doc_id").select("features", "quality", "doc_id")
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(most_rows).toPandas()
    x = np.array(sample["features"].tolist(), dtype=float).reshape(len(sample), len(FEATURES))
    return fit(x, (sample["quality"].to_numpy() >= 0.5).astype(float))


def score_quality(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1,
                  most_rows: int = MOST_FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document (doc_id, text).

    Learns from labelled documents that are not held out. Null and empty texts are scored as texts
    without words; several labels of one document count by their mean; without any label all
    scores are 0.5. Rows that repeat are scored each, a null id is scored and never learned from,
    other columns play no part, an empty table gives no rows.
    """
    columns = docs.select("text", "doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"))
    features = stored(columns.mapInArrow(_features, "features array<float>, doc_id long, held_out boolean"), "features")
    model = train(features.where("NOT held_out"), labels, most_rows)
    scored = features.select("features", "doc_id", "held_out").mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_FIT_ROWS) -> DataFrame:
    """The documents the classifier accepts, with all their columns.

    It learns from the documents of at most ``most_rows`` labelled ids, those with the smallest hash;
    that bounds what is broadcast to find their texts. The score of a row depends on its text
    alone, so texts are scored once more on the way through.
    """
    learned = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 3, 1))
    chosen = learned.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    columns = docs.select("text", "doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"))
    features = stored(columns.join(F.broadcast(chosen), "doc_id", "left_semi").select("text", "doc_id", "held_out")
                      .mapInArrow(_features, "features array<float>, doc_id long, held_out boolean"), "features")
    model = train(features, labels, most_rows)
    names, schema = docs.columns, docs.schema
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in blocks([batch], "text"):
                yield piece.filter(pa.array(model.scores(features_of(piece.column(at)).astype(float)) >= 0.5))

    return docs.mapInArrow(run, schema)


def op3_score_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
