"""Spelling variants against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from returnlens.llm import variants
from tests.llm.test_operators import CLASH


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)):] == b[at + 1:]


def brute(counts: dict[str, int], factor: int = 10) -> set[tuple]:
    forms, near = {}, {}
    for word, n in counts.items():
        others = [w for w in counts if one_edit(word, w)]
        near[word] = len(others)
        lead = min(others, key=lambda w: (-counts[w], w), default=None)
        forms[word] = lead if lead is not None and counts[lead] >= factor * n else None
    rows = set()
    for word, n in counts.items():
        root = word
        while forms[root] is not None:
            root = forms[root]
        rows.add((word, forms[word], root, n, near[word], None if forms[word] is None else counts[forms[word]]))
    return rows


def brute_words(docs) -> Counter:
    counts: Counter = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= 7:
                counts[run] += 1
    return Counter({w: n for w, n in counts.items() if n >= 2})


def rows_of(df) -> set[tuple]:
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def misspelt(pick: random.Random, word: str) -> str:
    at = pick.randrange(len(word))
    return pick.choice((word[:at] + word[at + 1:], word[:at] + pick.choice("abé") + word[at:], word[:at] + pick.choice("abé") + word[at + 1:]))


@pytest.fixture(scope="module")
def counted():
    pick = random.Random(13)
    words = {"".join(pick.choice("abé") for _ in range(pick.randint(7, 9))): pick.choice((2, 20, 200, 200, 3000)) for _ in range(150)}
    for word in list(words) * 2:
        words.setdefault(misspelt(pick, word), pick.choice((2, 2, 20, 250)))
    return words | {"x" * 3000: 2, "x" * 3001: 50, "ab": 3, "a": 40, "": 2, "日本語": 2, "日本": 20, "😀😀": 200}


@pytest.mark.parametrize("block", [1 << 15, 64])
def test_groups_like_all_pairs(spark, counted, monkeypatch, block):
    monkeypatch.setattr(variants, "BLOCK_CODE_POINTS", block)
    monkeypatch.setattr(variants, "TILE_ROWS", 16 if block == 64 else 256)
    df = spark.createDataFrame(list(counted.items()), "word string, n long").selectExpr("*", "'x' AS form", "1 AS size", "'b' AS bucket")
    assert rows_of(variants.group_variants(df)) == brute(counted)


def test_words_of_documents(spark):
    pick = random.Random(4)
    base = ["".join(pick.choice("abcdeé×") for _ in range(pick.randint(5, 11))) for _ in range(60)]
    docs = [(i, " ".join(pick.choice((w, w, w.upper(), misspelt(pick, w))) for w in pick.choices(base, k=200)) + "1x,Ünïcode") for i in range(40)]
    docs += [(7, docs[7][1]), (None, docs[0][1]), (50, None), (51, ""), (52, " \n9"), (53, "Zusammenhang " * 5000 + "y" * 4000)] * 2
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", *CLASH, "'w' AS word", "'r' AS run")
    want = brute_words(docs)
    assert {r.word: r.n for r in variants.noisy_words(df).groupBy("word").agg(F.count("*").alias("n")).collect() if r.n > 1} == want
    assert rows_of(variants.variants_of_documents(df)) == brute(want)
    assert variants.variants_of_documents(df.where("false")).count() == 0


def test_chain_of_forms(spark):
    words = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "aaabbbb": 20000, "aabbbbb": 200000}
    got = rows_of(variants.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert {(r[0], r[2]) for r in got} == {(w, "aabbbbb") for w in words} and got == brute(words)


def test_descent_in_pieces_is_the_plain_formula():
    import numpy as np

    from returnlens.llm.recurrent import RATE, STEP_VALUES, _descend

    random = np.random.default_rng(1)
    value, kept = random.standard_normal(STEP_VALUES + 7).astype(np.float32), np.zeros((3, STEP_VALUES + 7), np.float32)
    plain, m, v = value.copy(), np.zeros_like(value), np.zeros_like(value)
    for t in range(1, 4):
        g = random.standard_normal(len(value)).astype(np.float32)
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        plain -= RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-6)
        _descend(value, g.copy(), kept, t)
    assert np.array_equal(value, plain)


def test_descent_by_rows_is_the_plain_formula():
    import numpy as np

    from returnlens.llm.recurrent import RATE, SCALED_STEPS, _descend_rows

    random = np.random.default_rng(2)
    value, kept = random.standard_normal((50, 6)), np.zeros((3, 50, 6))
    plain, m, v = value.copy(), np.zeros_like(value), np.zeros_like(value)
    for t in range(1, 2 * SCALED_STEPS + 9):
        used = np.flatnonzero(random.random(50) < (0.1 if t % 7 else 0.9))
        used = used[used != 3]  # a row without any slope stays as it is
        g = np.zeros_like(value)
        g[used] = random.standard_normal((len(used), 6))
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        plain -= RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-6)
        _descend_rows(value, used, g[used], kept, t)
        assert np.allclose(value, plain, rtol=1e-9, atol=1e-12), t


def test_outputs_near_and_far_from_zero():
    import numpy as np

    from returnlens.llm import recurrent

    random = np.random.default_rng(4)
    words = np.sort(random.integers(1, 1 << 62, 90, dtype=np.uint64))
    net = recurrent.Network(words, np.sort(random.integers(2, 90, 90))[::-1].astype(float), 9, np.full(51, 3.0), np.full(51, 2.0))
    start = net.p
    hashes = np.concatenate([random.choice(words, 60), [recurrent.END], random.integers(0, 9, 5, dtype=np.uint64)])
    inputs, classes = net.number(hashes, random.integers(0, 51, len(hashes)))
    for factor in (1, 3000):
        net.p = {k: random.standard_normal(v.shape) * (0.3 if factor == 1 or k[0] != "W" else factor) for k, v in start.items()}
        h = np.tanh(random.standard_normal((recurrent.HIDDEN, len(inputs))))
        logits, inner = h.T @ net.p["Wc"] + net.p["bc"], h.T @ net.p["Wo"] + net.p["bo"]
        want = np.empty(len(inputs))
        for i, (word, c) in enumerate(zip(inputs.tolist(), classes.tolist())):
            want[i] = logits[i, c] - np.logaddexp.reduce(logits[i])
            if c < recurrent.WORD_CLASSES:
                band = inner[i, net.edges[c]:net.edges[c + 1]]
                want[i] += band[word - net.edges[c]] - np.logaddexp.reduce(band)
        assert np.allclose(net.outputs(h, inputs, classes), want, rtol=1e-9)
        near = np.abs(inner).max() < recurrent.FAR
        assert near == (factor == 1)
        grads = {"c": np.zeros((recurrent.HIDDEN + 1, net.classes)), "o": np.zeros((recurrent.HIDDEN + 1, len(words)))}
        slope = net.outputs(h, inputs, classes, grads)
        assert np.isfinite(slope).all() and all(np.isfinite(g).all() for g in grads.values())
        if near:
            for unit in range(3):
                moved = h.copy()
                moved[unit] += 1e-6
                assert np.allclose((want - net.outputs(moved, inputs, classes)) / 1e-6, slope[unit], atol=1e-4)


def test_hashes_of_runs_longer_than_a_piece():
    import numpy as np
    import pyarrow as pa

    from returnlens.llm import words

    random = np.random.default_rng(6)
    assert words.PIECE_BYTES <= 1 << 17  # a piece's numbers, eight bytes a byte of text, have to stay in the cache
    texts = ["".join(map(chr, random.integers(97, 123, n))) for n in (1, 5, 700, words.PIECE_BYTES, words.PIECE_BYTES + 1, 3 * words.PIECE_BYTES)]
    got, bounds = words.word_hashes(pa.array([" ".join(texts * 2), None, *texts]))
    assert got[:6].tolist() == got[6:12].tolist() == got[12:].tolist() and bounds.tolist() == [0, 12, 12, *range(13, 19)]
    for text, h in zip(texts, got):
        data = np.frombuffer(text.encode(), np.uint8)
        total = (words.TABLE[data] * words.powers(len(data))).sum(dtype=np.uint64)
        assert h == words.mix(total[None] ^ (np.array([len(data)], np.uint64) * words.MIX_B))[0]
