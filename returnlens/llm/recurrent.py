"""Language-model scores by a gated recurrent network with class-factored output."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from returnlens.llm.language import held_out
from returnlens.llm.shared import documents, stored
from returnlens.llm.words import IS_SPACE, HashIndex, blocks, run_hashes, runs, text_bytes

HIDDEN = 24
WINDOW = 16
LANES = 64
FULL_STEP_TOKENS = 512
SCORE_WINDOW = 64
SCORE_LANES = 1008
MODEL_WORDS = 1024
WORD_CLASSES = 16
SHAPES = 51
RATE = 0.01
STEP_VALUES = 1 << 15
SCALED_STEPS = 64
FAR = 60
OUTPUT_ROWS = 2048
KNOWN_WORDS = 1 << 18
TOKENS_AT_ONCE = 2_500_000
TEXT_BYTES = 1 << 18
END = np.uint64(0x6A09E667F3BCC909)


def shapes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Shape of a word: low bits of its largest UTF-8 continuation byte, if any, and its last byte's kind."""
    if not len(starts):
        return np.zeros(0, dtype=np.int32)
    inner = np.maximum.reduceat(np.where((data >= 0x80) & (data < 0xC0), data, 0).astype(np.uint8), starts)
    last = data[ends - 1]
    stop = (last == 44) | (last == 46)
    letter = (last >= 0x80) | ((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 48) & (last <= 57)
    return np.where(inner > 0, (inner & 15) + 1, 0).astype(np.int32) * 3 + np.where(stop, 1, np.where(letter, 0, 2)).astype(np.int32)


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts, each text's words and then one end; the tokens' shapes; n + 1 bounds."""
    data, offsets = text_bytes(column)
    starts, ends = runs(data, offsets, IS_SPACE)
    bounds = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    hashes = np.full(len(starts) + len(bounds) - 1, END)
    shapes = np.zeros(len(hashes), dtype=np.int32)
    place = np.arange(len(starts)) + doc
    hashes[place] = run_hashes(data, starts, ends, True)
    shapes[place] = shapes_of(data, starts, ends)
    return hashes, shapes, bounds + np.arange(len(bounds))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "text"):
        hashes, shapes, _ = tokens_of(batch.column(0))
        keys, first, number = np.unique(hashes, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(shapes[first], pa.int32()),
                                          pa.array(number, pa.int64())], ["h", "shape", "n"])


class Network:
    """Layout of the vocabulary and the parameters.

    Output classes are, in this order: frequency bands of the most frequent words, each with a
    softmax of its own over its words; the end; one class per shape for all other words, within
    which a word's share is its smoothed count.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, end_count: int, shape_counts: np.ndarray, shape_words: np.ndarray):
        mass = np.cumsum(np.sqrt(counts)) if len(counts) else np.zeros(0)
        band = np.minimum((mass / max(mass[-1], 1) * WORD_CLASSES).astype(int), WORD_CLASSES - 1) if len(counts) else np.zeros(0, int)
        self.words, self.index = words, None
        self.edges = np.searchsorted(band, np.arange(WORD_CLASSES + 1))
        self.numbers, self.widths = np.arange(WORD_CLASSES + 1), np.diff(self.edges)
        self.band = band.astype(np.int32)
        self.end_input = len(words)
        self.log_share = -np.log(shape_counts + 0.5 * (shape_words + 1))
        self.classes = WORD_CLASSES + 1 + SHAPES
        inputs = len(words) + 1 + SHAPES
        sizes = {"E": (inputs, 3 * HIDDEN), "U": (HIDDEN, 3 * HIDDEN), "Wc": (HIDDEN, self.classes), "bc": (self.classes,),
                 "Wo": (HIDDEN, len(words)), "bo": (len(words),)}
        random = np.random.default_rng(9)
        self.p = {k: (random.standard_normal(v) * (0.1 if k in "EU" else 0.01)).astype(np.float32) for k, v in sizes.items()}
        totals = np.concatenate([np.bincount(band, counts, WORD_CLASSES) if len(counts) else np.zeros(WORD_CLASSES), [end_count], shape_counts])
        self.p["bc"][:] = np.log((totals + 0.5) / (totals.sum() + 0.5 * len(totals)))
        self.p["bo"][:] = np.log(counts + 0.5)

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def views(self, values: np.ndarray, names: Iterable[str] | None = None) -> dict[str, np.ndarray]:
        """The parts of one vector, or of several in rows, by parameter."""
        parts = {k: self.p[k] for k in names or self.p}
        ends = np.cumsum([v.size for v in parts.values()])
        return {k: values[..., end - v.size:end].reshape(*values.shape[:-1], *v.shape) for (k, v), end in zip(parts.items(), ends)}

    def load(self, values: np.ndarray) -> None:
        self.p = self.views(np.array(values, dtype=np.float32))

    def number(self, hashes: np.ndarray, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Input row and output class of every token; the inputs of words are their output columns."""
        if self.index is None:
            self.index = HashIndex(self.words)
        word = self.index.find(hashes)
        other = np.where(hashes == END, self.end_input, self.end_input + 1 + shapes)
        inputs = np.where(word >= 0, word, other).astype(np.min_scalar_type(self.end_input + SHAPES))
        classes = np.where(word >= 0, self.band[word] if len(self.band) else 0, other - self.end_input + WORD_CLASSES)
        return inputs, classes.astype(np.min_scalar_type(self.classes))

    def table(self) -> np.ndarray:
        """What every input adds to the gates and the candidate, a column per input, the gates' part negated."""
        out = _wide(3 * HIDDEN, len(self.p["E"]), self.p["E"].dtype)
        np.negative(self.p["E"][:, :2 * HIDDEN].T, out=out[:2 * HIDDEN])
        out[2 * HIDDEN:] = self.p["E"][:, 2 * HIDDEN:].T
        return out.base

    def columns(self, inputs: np.ndarray) -> np.ndarray:
        """The inputs' columns of the table, which is made where there are more inputs than half its columns."""
        if 2 * len(inputs) > len(self.p["E"]):
            return self.table().take(np.concatenate([inputs, inputs[:16]]), axis=1)[:, :len(inputs)]
        x = np.ascontiguousarray(self.p["E"][inputs].T)
        np.negative(x[:2 * HIDDEN], out=x[:2 * HIDDEN])
        return x

    def step(self, inputs: np.ndarray, h: np.ndarray, keep: list | None = None, x: np.ndarray | None = None) -> np.ndarray:
        """States after the inputs, of which ``x`` has the columns if they are at hand. A unit's values over
        all texts lie side by side, so every part of the gates is one run of memory."""
        x, h = self.columns(inputs) if x is None else x, h.T
        a = self.p["U"].T @ h
        gates = np.subtract(x[:2 * HIDDEN], a[:2 * HIDDEN])
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        inner = a[2 * HIDDEN:]
        n = gates[HIDDEN:] * inner
        n += x[2 * HIDDEN:]
        np.tanh(n, out=n)
        if keep is not None:
            keep.append((inputs, h, gates, n, inner))
        new = h - n
        new *= gates[:HIDDEN]
        new += n
        return new.T

    def outputs(self, h: np.ndarray, targets: np.ndarray, classes: np.ndarray, grads: dict | None = None) -> np.ndarray:
        """Log-probability of every target given its state, a column of ``h``; with ``grads``, zeros that are
        filled, the slope by the states instead."""
        order = np.argsort(classes, kind="stable")
        classes, targets, at = classes[order], targets[order], np.arange(len(order))
        wc, wo = (np.concatenate([self.p[k], self.p[b][None]]) for k, b in (("Wc", "bc"), ("Wo", "bo")))
        states = _wide(HIDDEN + 1, len(order), np.result_type(h, wc))
        states[:-1], states[-1] = h.take(order, axis=1), 1
        chances = np.matmul(wc.T, states, out=_wide(self.classes, len(order), states.dtype))
        # The bands' tables, words by tokens, lie in one vector.
        cuts = np.searchsorted(classes, self.numbers)
        sizes, words = cuts[1:] - cuts[:-1], cuts[-1]
        ends = np.cumsum(sizes * self.widths)
        inner = np.empty(ends[-1], states.dtype)
        begins, own = ends - sizes * self.widths, classes[:words]
        bands = [(self.edges[c], self.edges[c + 1], cuts[c], cuts[c + 1], inner[begins[c]:ends[c]].reshape(-1, sizes[c]))
                 for c in np.flatnonzero(sizes)]
        for lo, hi, a, b, table in bands:
            np.matmul(wo[:, lo:hi].T, states[:, a:b], out=table)
        mine = (begins - cuts[:-1] - self.edges[:-1] * sizes)[own] + targets[:words] * sizes[own] + at[:words]
        if grads is None:
            out = chances[classes, at].astype(float)
            out[:words] += inner[mine]
        total, off = _exponentials([chances], chances)
        sums, more = _exponentials([band[-1] for band in bands], inner)
        if grads is None:
            out -= off + np.log(total)
            out[:words] -= more + np.log(sums)
            logs = np.empty_like(out)
            logs[order] = out
            return logs
        # Times the sums, a slope by a logit is its exponential, less the sum for the target's own.
        chances[classes, at] -= total
        inner[mine] -= sums
        np.matmul(states / total, chances.T, out=grads["c"])
        slope = self.p["Wc"] @ chances
        slope /= total
        slopes, states = _wide(HIDDEN, words, states.dtype), states[:, :words] / sums
        for lo, hi, a, b, table in bands:
            np.matmul(states[:, a:b], table.T, out=grads["o"][:, lo:hi])
            np.matmul(wo[:-1, lo:hi], table, out=slopes[:, a:b])
        slopes /= sums
        slope[:, :words] += slopes
        out = _wide(HIDDEN, len(order), states.dtype)
        out[:, order] = slope
        return out


def _wide(*shape) -> np.ndarray:
    """An empty array, of the shape and type given, whose rows do not lie a power of two apart, as these
    would share few places of the cache."""
    *shape, kind = shape
    return np.empty((*shape[:-1], shape[-1] + 16), kind)[..., :shape[-1]]


def _exponentials(tables: list[np.ndarray], values: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
    """Turns the tables, all parts of ``values``, into exponentials; the sums of their columns and what was
    taken off the logarithms before, the columns' maxima, if any value is far from 0."""
    off: np.ndarray | float = 0.0
    if values.size and not (values.max() < FAR and values.min() > -FAR):
        off = np.concatenate([table.max(axis=0) for table in tables])
        for table in tables:
            table -= table.max(axis=0)
    np.exp(values, out=values)
    ones = np.ones(max([0, *map(len, tables)]), values.dtype)
    return np.concatenate([ones[:len(table)] @ table for table in tables] or [ones]), off


def windows(starts: np.ndarray, lengths: np.ndarray, lanes: int, width: int):
    """Groups of texts of like length side by side, window after window: (first, texts, begin, live),
    with ``live[j]`` the texts that reach place ``begin + j``, the longest standing first."""
    order = np.argsort(-lengths, kind="stable")
    for at in range(0, len(order), lanes):
        group = order[at:at + lanes]
        size = lengths[group]
        for begin in range(0, int(size[0]), width):
            steps = np.arange(begin, min(begin + width, int(size[0])))
            yield begin == 0, group, begin, np.searchsorted(-size, -steps, side="left")


def train_on(net: Network, inputs: np.ndarray, classes: np.ndarray, bounds: np.ndarray, memory: dict) -> None:
    """One pass of truncated backpropagation: every window of every text gives a gradient, and state runs
    on from window to window."""
    for fresh, group, begin, live in windows(bounds[:-1], np.diff(bounds), LANES, WINDOW):
        if fresh:
            h = np.zeros((len(group), HIDDEN), dtype=np.float32)
        before, targets, _ = _places(net, inputs, bounds, group, begin, live)
        x, at = net.columns(before), 0
        keep: list = []
        states = []
        for n in live:
            h = net.step(before[at:at + n], h[:n], keep, x[:, at:at + n])
            states.append(h)
            at += n
        _learn(net, keep, states, targets, inputs, classes, memory)


def _places(net, inputs, bounds, group, begin, live) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, places and texts of a window's tokens, step after step."""
    every = np.arange(live[0])
    lane = np.concatenate([every[:n] for n in live])
    texts = group[lane]
    place = bounds[texts] + np.repeat(np.arange(begin, begin + len(live)), live)
    before = inputs[place - 1]
    if not begin:
        before[:live[0]] = net.end_input
    return before, place, texts


def _learn(net, keep, states, targets, inputs, classes, memory) -> None:
    if not memory:
        values, table = net.flat(), net.p["E"]
        net.p = net.views(values)
        dense, values = [k for k in net.p if k != "E"], values[table.size:]
        slopes, kept = np.zeros_like(values), np.zeros((3, len(values)), values.dtype)
        # A layer's biases follow its weights, as one more row.
        parts, layers = net.views(slopes, dense), np.split(slopes, [net.p["U"].size, net.p["U"].size + (HIDDEN + 1) * net.classes])
        grads = {"U": parts["U"], "c": layers[1].reshape(HIDDEN + 1, -1), "o": layers[2].reshape(HIDDEN + 1, -1)}
        memory.update(values=values, slopes=slopes, kept=kept, grads=grads, t=0,
                      E=np.zeros((3, *table.shape), table.dtype), **net.views(kept, dense))
    grads = memory["grads"]
    memory["slopes"][:] = 0
    h, gates, n, inner = (np.concatenate([step[k] for step in keep], axis=1) for k in range(1, 5))
    slope = net.outputs(np.concatenate([s.T for s in states], axis=1), inputs[targets], classes[targets], grads)
    # What a slope by a state is times the slopes by gates, by the candidate's inner part and by the state before.
    z, r = gates[:HIDDEN], gates[HIDDEN:]
    rest = 1 - z
    through = _wide(4, *n.shape, n.dtype)
    np.subtract(h, n, out=through[0])
    through[0] *= z
    through[0] *= rest
    candidate = n * n
    np.subtract(1, candidate, out=candidate)
    candidate *= rest
    np.multiply(candidate, r, out=through[2])
    np.subtract(1, r, out=through[1])
    through[1] *= through[2]
    through[1] *= inner
    through[3] = z
    back = np.concatenate([net.p["U"], np.eye(HIDDEN, dtype=n.dtype)], axis=1)
    flow = through.base.reshape(4 * HIDDEN, -1)[:, :n.shape[1]]
    at, carried = n.shape[1], None
    for state in reversed(states):
        to, at = at, at - len(state)
        own = slope[:, at:to]
        if carried is not None:
            own[:, :carried.shape[1]] += carried
        through[:, :, at:to] *= own
        carried = back @ flow[:, at:to]
    np.matmul(h, flow[:3 * HIDDEN].T, out=grads["U"])
    candidate *= slope
    rows = np.concatenate([step[0] for step in keep])
    seen = np.zeros(len(net.p["E"]), dtype=bool)
    seen[rows] = True
    used, place = np.flatnonzero(seen), (np.cumsum(seen) - 1)[rows]
    slopes, sums = np.empty((len(rows), 3 * HIDDEN), n.dtype), np.zeros((len(used), 3 * HIDDEN), n.dtype)
    slopes[:, :2 * HIDDEN], slopes[:, 2 * HIDDEN:] = flow[:2 * HIDDEN].T, candidate.T
    np.add.at(sums.reshape(-1), (place[:, None] * (3 * HIDDEN) + np.arange(3 * HIDDEN)).reshape(-1), slopes.reshape(-1))
    scale = max(len(targets), FULL_STEP_TOKENS)  # a window of few texts is a small step
    memory["slopes"] /= scale
    memory["t"] += 1
    _descend_rows(net.p["E"], used, sums / scale, memory["E"], memory["t"])
    _descend(memory["values"], memory["slopes"], memory["kept"], memory["t"])


def _descend_rows(value: np.ndarray, used: np.ndarray, g: np.ndarray, kept: np.ndarray, t: int) -> None:
    """One step of Adam for a table of which only the rows ``used`` have slopes. All rows move, as in the
    plain formula; but the means, kept up to powers of their decay, and the root change in these rows alone."""
    m, v, root = kept
    since = (t - 1) % SCALED_STEPS
    if t > 1 and not since:
        m *= 0.9 ** SCALED_STEPS
        v *= 0.99 ** SCALED_STEPS
        root *= 0.99 ** (SCALED_STEPS / 2)
    m[used] += g * (0.1 / 0.9 ** since)
    v[used] += g * g * (0.01 / 0.99 ** since)
    root[used] = np.sqrt(v[used])
    size = 0.99 ** (since / 2) / (1 - 0.99 ** t) ** 0.5
    rate = RATE * 0.9 ** since / (1 - 0.9 ** t) / size
    value, m, root = value.reshape(-1), m.reshape(-1), root.reshape(-1)
    for at in range(0, len(value), STEP_VALUES):
        d = root[at:at + STEP_VALUES] + 1e-6 / size
        np.divide(m[at:at + STEP_VALUES], d, out=d)
        d *= rate
        value[at:at + STEP_VALUES] -= d


def _descend(value: np.ndarray, g: np.ndarray, kept: np.ndarray, t: int) -> None:
    """One step of Adam, in place and in pieces that stay in the cache; ``g`` is used up."""
    for at in range(0, len(value), STEP_VALUES):
        x, d, (m, v, s) = value[at:at + STEP_VALUES], g[at:at + STEP_VALUES], kept[:, at:at + STEP_VALUES]
        np.subtract(d, m, out=s)
        s *= 0.1
        m += s
        d *= d
        d -= v
        d *= 0.01
        v += d
        np.divide(v, 1 - 0.99 ** t, out=d)
        np.sqrt(d, out=d)
        d += 1e-6
        np.divide(m, 1 - 0.9 ** t, out=s)
        s *= RATE
        s /= d
        x -= s


def score_tokens(net: Network, inputs: np.ndarray, classes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Natural log-probability of every text under the network, words of shape classes up to their
    smoothed share; state is carried from a text's first token to its last."""
    total, table = np.zeros(len(bounds) - 1), net.table()
    for fresh, group, begin, live in windows(bounds[:-1], np.diff(bounds), SCORE_LANES, SCORE_WINDOW):
        if fresh:
            h = np.zeros((len(group), HIDDEN), dtype=np.float32)
        before, at, texts = _places(net, inputs, bounds, group, begin, live)
        states, done = [], 0
        for n in live:
            now = before[done:done + n]
            h = net.step(now, h[:n], None, table.take(now, axis=1))
            states.append(h.T)
            done += n
        state = np.concatenate(states, axis=1)
        # In pieces that stay in the cache.
        logs = np.concatenate([net.outputs(state[:, k:k + OUTPUT_ROWS], inputs[at[k:k + OUTPUT_ROWS]], classes[at[k:k + OUTPUT_ROWS]])
                               for k in range(0, len(at), OUTPUT_ROWS)])
        total += np.bincount(texts, logs, len(total))
    return total


def _token_groups(batches: Iterator[pa.RecordBatch], column: int):
    """Tokens of many rows at a time: (their other columns, hashes, shapes, bounds)."""
    held, parts, size = [], [], 0
    for batch in blocks(batches, "text", TEXT_BYTES):
        held.append(batch.drop_columns(["text"]))
        parts.append(tokens_of(batch.column(column)))
        size += len(parts[-1][0])
        if size >= TOKENS_AT_ONCE:
            yield _joined(held, parts)
            held, parts, size = [], [], 0
    if held:
        yield _joined(held, parts)


def _joined(held, parts):
    lengths = np.concatenate([np.diff(p[2]) for p in parts])
    return held, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([[0], np.cumsum(lengths)])


def _train_partition(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, memory, seen = shared.value, {}, 0
        net.load(net.flat().copy())
        for _, hashes, shapes, bounds in _token_groups(batches, 0):
            train_on(net, *net.number(hashes, shapes), bounds, memory)
            seen += len(hashes)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([float(seen)]), pa.array([net.flat()], pa.list_(pa.float32()))], ["seen", "values"])

    return run


def _score_partition(shared, total: int, distinct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, known, counts = shared.value
        index, part, row = HashIndex(known), TaskContext.get().partitionId(), 0
        base_share = np.log(total + 0.5 * (distinct + 1))
        for held, hashes, shapes, bounds in _token_groups(batches, 1):
            lengths = np.diff(bounds)
            text = np.repeat(np.arange(len(lengths)), lengths)
            inputs, classes = net.number(hashes, shapes)
            place = index.find(hashes)
            tail = place < 0
            amount = np.log(np.where(tail, 1.0, (counts[place] if len(counts) else 0) + 0.5))
            free = classes > WORD_CLASSES
            score = score_tokens(net, inputs, classes, bounds)
            score += np.bincount(text[free], amount[free] + net.log_share[classes[free] - WORD_CLASSES - 1], len(lengths))
            base = np.bincount(text, amount - base_share, len(lengths))
            tails = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(text[tail], minlength=len(lengths)))]), pa.int32()),
                                             pa.array(hashes[tail].view(np.int64)))
            ids = pa.array((part << 40) + row + np.arange(len(lengths)))
            row += len(lengths)
            docs = pa.Table.from_batches(held).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [ids, docs["doc_id"].combine_chunks(), docs["held_out"].combine_chunks(), pa.array(lengths, pa.int64()),
                 pa.array(lengths - np.bincount(text[tail], minlength=len(lengths)), pa.int64()), pa.array(base), pa.array(score), tails],
                ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "tail"])

    return run


SCORED = ("row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<long>")


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The ``most`` words of the largest counts (ties: the smaller hash). A histogram of bounded length
    finds the band of counts in which the limit lies; only that band is put in order."""
    step = F.floor(F.log2("c") * 8).cast("int")
    rows = sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.step)
    total = 0
    for r in rows:
        if total + r.n > most:
            band = counts.where(step == r.step).orderBy(F.col("c").desc(), "h").limit(most - total)
            return counts.where(step > r.step).union(band)
        total += r.n
    return counts


def train(training: DataFrame, counts: DataFrame) -> tuple[Network, int, int]:
    """A network from all training texts, the number of their tokens and of distinct tokens.

    Every partition of the texts trains a copy of one start; the copies' mean, weighted by tokens,
    is the model. The mean is an aggregation with one row per parameter and partition.
    """
    whole = counts.groupBy("shape").agg(F.sum("c").alias("c"), F.count("*").alias("v"),
                                        F.sum(F.when(F.col("h") == int(END.view(np.int64)), F.col("c"))).alias("ends")).collect()
    total, distinct = sum(r.c for r in whole), sum(r.v for r in whole)
    ends = sum(r.ends or 0 for r in whole)
    words = (most_frequent(counts, MODEL_WORDS + 1).where(F.col("h") != int(END.view(np.int64)))
             .orderBy(F.col("c").desc(), "h").limit(MODEL_WORDS).toPandas())
    rest, kinds = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in whole:
        rest[r["shape"]], kinds[r["shape"]] = r.c, r.v
    rest -= np.bincount(words["shape"].astype(int), words["c"].astype(float), SHAPES)
    kinds -= np.bincount(words["shape"].astype(int), minlength=SHAPES)
    rest[0] -= ends
    kinds[0] -= ends > 0
    net = Network(words["h"].to_numpy(dtype=np.int64).view(np.uint64), words["c"].to_numpy(dtype=float), ends, rest, kinds)
    shared = training.sparkSession.sparkContext.broadcast(net)
    copies = stored(training.mapInArrow(_train_partition(shared), "seen double, values array<float>"), "networks")
    mean = (copies.select("seen", F.posexplode("values").alias("at", "value")).groupBy("at")
            .agg((F.sum(F.col("seen") * F.col("value")) / F.sum("seen")).alias("value")).toPandas())
    if len(mean):
        values = np.zeros(len(mean))
        values[mean["at"]] = mean["value"]
        net.load(values)
    return net, total, distinct


def score_documents(docs: DataFrame, modulus: int = 5, remainder: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Counts cover all training texts. Up to ``KNOWN_WORDS`` of the most frequent words carry their
    counts to the texts; the tokens of all others, none of which is frequent, go to the counts in a
    shuffle. Tokens are told apart by 64-bit hashes. A null or empty text is one end token; rows
    that repeat are counted and scored each; a null id learns; other columns play no part; with
    nothing to learn from, every token has probability 1 in the base; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select("text", "doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"))
    training = rows.where("NOT held_out").select("text")
    counts = stored(training.mapInArrow(_counts, "h long, shape int, n long")
                    .groupBy("h").agg(F.sum("n").alias("c"), F.min("shape").alias("shape")), "counts")
    net, total, distinct = train(training, counts)
    frequent = most_frequent(counts, KNOWN_WORDS).select("h", "c").toPandas()
    shared = spark.sparkContext.broadcast((net, frequent["h"].to_numpy(dtype=np.int64).view(np.uint64), frequent["c"].to_numpy(dtype=float)))
    scored = stored(rows.select("doc_id", "text", "held_out").mapInArrow(_score_partition(shared, total, distinct), SCORED), "scored")
    tail = (scored.select("row", F.explode("tail").alias("h")).join(counts.select("h", "c"), "h", "left")
            .groupBy("row").agg(F.sum(F.log(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.count("c").alias("found")))
    tens = F.log(F.lit(10.0))
    more = F.coalesce("more", F.lit(0.0))
    return scored.drop("tail").join(tail, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), ((F.col("base") + more) / tens).alias("base_score"),
        ((F.col("score") + more) / tens).alias("score"))


def op9_score_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
