"""Each operator on small inputs with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from returnlens.llm import chat, fingerprints, language, lines, mixing, neighbours, packing, quality, recurrent, shared, words
from tests.llm.test_pipeline import lines_left

LONG = "uma palavra longa " * 3000
TEXTS = [(1, "The cat sat on the mat.\nIt was warm."), (2, None), (3, ""), (4, " \n\t"), (5, LONG), (6, "x" * 5000), (7, "um"), (7, "um"),
         (None, "no id"), (8, "É tarde\x0bdemais, não?")]
# Names the operators use inside, in other types.
CLASH = ("'a' AS rank", "1 AS n", "'k' AS key", "'p' AS place", "2 AS source_size", "'t' AS target", "'s' AS score", "'c' AS component",
         "'f' AS fingerprint", "3 AS length", "'r' AS row", "'h' AS held_out", "'b' AS block", "'x' AS check")


@pytest.fixture
def docs(spark):
    base = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return base.selectExpr("*", "IF(doc_id % 2 = 0, 'en', NULL) AS lang", "IF(doc_id > 4, NULL, 's1') AS source", *CLASH)


@pytest.fixture
def empty(docs):
    return docs.where("false")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_words_and_hashes():
    texts = ["Ab  cd\nab", None, "", "é x" * 3, "z" * (3 * words.CHUNK_BYTES), "ab"]
    hashes, bounds = words.word_hashes(pa.array(texts))
    assert np.diff(bounds).tolist() == [3, 0, 0, 4, 1, 1]
    assert hashes[0] == hashes[2] == hashes[-1] and len(set(hashes.tolist())) == 6
    index = words.HashIndex(np.unique(hashes))
    assert (index.keys[index.find(hashes)] == hashes).all() and index.find(np.array([1], dtype=np.uint64))[0] == -1


def test_ranks_over_partitions(spark):
    df = spark.range(1000).selectExpr("id % 3 AS g", "id", "'x' AS name").repartition(7)
    got = shared.ranked(df, ["g"], [F.col("g"), F.col("id").desc()]).orderBy("g", "rank").collect()
    want = [(g, i) for g in range(3) for i in sorted(range(g, 1000, 3), reverse=True)]
    assert [(r.g, r.id) for r in got] == want and [r["rank"] for r in got if r.g == 0] == list(range(1, 335))


def test_components(spark):
    pick = random.Random(1)
    edges = [(pick.randrange(300), pick.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 440)]
    parent = list(range(500))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_fingerprints(spark, docs, empty):
    assert fingerprints.fingerprint_edits(empty).collect() == []
    rows = fingerprints.fingerprint_edits(docs).collect()
    assert len(rows) == len(TEXTS)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].n_chars == 36 and by_id[2].fingerprint == by_id[3].fingerprint
    assert by_id[5].near_edited > 0.3 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    two = spark.createDataFrame([("a b\nc d\ne f", "a b\nc x\ne f")], "a string, b string")
    two = fingerprints.with_fingerprint(fingerprints.with_fingerprint(two, "a", "fa"), "b", "fb")
    found = two.select(fingerprints.changed_paragraphs(F.col("fa"), F.col("fb")).alias("c"), fingerprints.root(F.col("fa")).alias("ra"),
                       fingerprints.likeness(F.col("fa"), F.col("fa")).alias("same")).first()
    assert found.c == [1] and len(found.ra) == 64 and found.same == 1.0


def test_packing(docs, empty):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    assert packing.pack(empty).collect() == []
    tokenizer = Tokenizer.from_file(path("word_bpe_49k.json"))
    rows = packing.pack(docs).collect()
    pieces: dict = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for doc_id, text in dict(TEXTS).items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        times = 2 if doc_id == 7 else 1
        assert sum(p.length for p in pieces[doc_id]) == times * len(ids)
        for p in pieces[doc_id]:
            assert p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes()) and p.doc_tokens == len(ids)
    filled: dict = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048


def test_tokens_of_odd_words():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("word_bpe_49k.json"))
    for text in ("It's THE <|endoftext|> end", "a\x1cb c\xa0d　e", "Straße ÀÉ!! ×÷ ﬁ é İ Σας", "x1y2 a.b,c ''ll 've", "日本 語 🙂🙂", "ÿŸ Ǆ ǅ"):
        assert packing.token_bytes(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), text


def test_bins_hold_every_class():
    counts = {2048: 3, 1024: 5, 64: 77, 63: 100, 1: 5000, 7: 3}
    taken: dict = {}
    for length, each, first, tail, offset in packing.plan_bins(counts):
        for i in range(counts[length]):
            full = i // each < counts[length] // each
            at = (first + i // each, i % each * length) if full else (tail, offset + i % each * length)
            for token in range(at[1], at[1] + length):
                assert taken.setdefault((at[0], token), 1) == 1 and token < 2048
                taken[(at[0], token)] = 2
    assert len(taken) == sum(n * c for n, c in counts.items())


def test_quality(spark, docs, empty):
    none = labels(spark, [])
    assert quality.score_quality(empty, none).collect() == []
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert quality.keep_good(docs, none).count() == len(TEXTS)
    rows = [(i, f"good words in a plain row {i} and more of them, here." if i % 3 else f"BAD!! {i} BAD!! BAD!! BAD!!") for i in range(600)]
    many = spark.createDataFrame(rows, "doc_id long, text string")
    marks = labels(spark, [(i, 1 if i % 3 else 0, 0) for i in range(600)])
    scored = quality.score_quality(many, marks).collect()
    held = [r for r in scored if r.held_out]
    assert 0 < len(held) < 600 and all(r.predicted == (1 if r.doc_id % 3 else 0) for r in held)
    assert {r.doc_id % 3 for r in quality.keep_good(many.selectExpr("*", *CLASH), marks).collect()} == {1, 2}


def test_pairs_learn_what_single_features_cannot():
    random_ = np.random.default_rng(1)
    x = random_.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert (0, 3) in model.pairs and ((model.scores(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_languages(spark, docs, empty):
    assert language.identify_languages(empty).collect() == []
    got = {r.doc_id: r for r in language.identify_languages(docs).collect()}
    assert got[2].lang_pred == got[3].lang_pred == got[4].lang_pred == "und" and got[2].score == 0
    unlearned = language.identify_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlearned} == {"und"}


def test_forward_sums_all_segmentations():
    vocabulary = language.vocabulary(None)
    pieces = language.read_pieces(None)
    chance = np.random.default_rng(2).random((len(pieces), 2)) * 0.1
    known = {p: chance[i] for i, p in enumerate(pieces)}

    def every(text: bytes) -> np.ndarray:
        if not text:
            return np.ones(2)
        return sum((known[text[:n]] * every(text[n:]) for n in range(1, len(text) + 1) if text[:n] in known), np.zeros(2))

    def logarithm(text: bytes) -> np.ndarray:
        prefixes = [np.zeros(2)]
        for t in range(1, len(text) + 1):
            prefixes.append(np.logaddexp.reduce([prefixes[s] + np.log(known[text[s:t]]) for s in range(max(0, t - 200), t) if text[s:t] in known]))
        return prefixes[-1]

    short = ["the", "antition", "é", "coração"]
    long = ["=" * 31, "=" * 32, "-" * 150, "não" * 40, "这是没有空格的很长的一段文字" * 9, "ab-" * 700, "x" * 33 + "é" * 60]
    data, offsets = words.text_bytes(pa.array(short + long))
    starts, ends = words.runs(data, offsets, words.IS_SPACE)
    got = language.word_scores(data, starts, ends, chance, vocabulary)
    assert np.allclose(got[:4], [np.log(every(b" " + s.encode())) for s in short])
    assert np.allclose(got, [logarithm(b" " + s.encode()) for s in short + long], rtol=1e-12)
    whole = language.LongWords(data, starts[[9]], ends[[9]], vocabulary)
    for step in (1, 7, 1 << 16):
        whole.step = step
        assert np.allclose(whole.forward(language.logarithms(chance)), got[9], rtol=1e-12)


def test_expected_counts(spark):
    """Two rounds of training against every segmentation written out; a long word against the same
    word without the limit; a word's expected pieces cover it."""
    pieces = language.read_pieces(None)
    number = {p: i for i, p in enumerate(pieces)}
    texts = {"aa": ["the cat the hat", "Then cat"], "bb": ["o gato é", "não"]}

    def ways(text: bytes):
        if not text:
            yield ()
        for n in range(1, len(text) + 1):
            if text[:n] in number:
                for rest in ways(text[n:]):
                    yield number[text[:n]], *rest

    rows = [(lang, text) for lang, some in texts.items() for text in some] + [(None, "lost"), ("aa", None), ("aa", "")]
    (names, got), = language.train(spark.createDataFrame(rows, "lang string, text string"), rounds=2)
    assert names == ["aa", "bb"]
    for column, name in enumerate(names):
        chance = np.full(len(pieces), 1.0 / len(pieces))
        for _ in range(2):
            counts = np.zeros(len(pieces))
            for word in (w.lower() for text in texts[name] for w in text.split()):
                some = list(ways(b" " + word.encode()))
                odds = np.array([np.prod(chance[list(way)]) for way in some])
                for way, weight in zip(some, odds / odds.sum()):
                    np.add.at(counts, list(way), weight)
            chance = (counts + language.SMOOTHING) / (counts.sum() + language.SMOOTHING * len(pieces))
        assert np.allclose(got[:, column], chance, rtol=1e-9)

    vocabulary, logs = language.vocabulary(None), language.logarithms(got)
    data, offsets = words.text_bytes(pa.array(["antition", "的文字" * 50, "the" * 20]))
    starts, ends = words.runs(data, offsets, words.IS_SPACE)
    order = np.argsort(starts - ends)
    for step in (5, 1000):
        many = language.LongWords(data, starts[order], ends[order], vocabulary)
        many.step = step
        covered = np.zeros(3)
        for piece, row, amounts in many.expected(logs, np.array([0, 1, 1]), np.array([1.0, 3.0, 1.0])):
            np.add.at(covered, row, amounts * np.array([len(pieces[p]) for p in piece]))
        assert np.allclose(covered, (many.lengths) * np.array([1.0, 3.0, 1.0]))


def test_many_languages_and_unspaced_words(spark):
    rows = [(i, f"{'abcdefghijklmnopqrst'[i % 20]}{'uvwxyz0123456789!?+-'[i // 20]} " * 30, f"l{i:03d}") for i in range(400)]
    rows += [(1000, "wort" * 20_000, "l000"), (1001, "qz" * 3, None)]
    got = {r.doc_id: r.lang_pred for r in language.identify_languages(
        spark.createDataFrame(rows, "doc_id long, text string, lang string"), modulus=1000, remainder=-1).collect()}
    assert len(got) == 402 and sum(got[i] == f"l{i:03d}" for i in range(400)) >= 380 and got[1000] == "l000"


def test_language_accuracy(spark):
    """Held-out rows of the smallest table, of which nearly all must be right."""
    found = language.op4_identify_language(spark, "/root/testdata/sf0.001").where("held_out AND lang_pred <> 'und'")
    truth = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang IS NOT NULL").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.rotate(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, 0, "system", "Be kind"), (1, 1, "ann", "Hi <|end|>"), (1, 2, "bob", None), (1, 3, "ann", "Bye"), (1, 3, "ann", "Bye"),
            (2, 0, "system", "alone"), (None, None, None, "lost")]
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS place", "'b' AS block", "2 AS start")
    got = {(r.conv_id, r.perspective): r for r in chat.dialogues(chat.rotate(df)).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (None, "unknown")}
    bob = got[(1, "bob")]
    assert bob.text == ("<|system|>\nBe kind<|end|>\n<|user name=ann|>\nHi < |end|><|end|>\n<|assistant|>\n<|end|>\n"
                        "<|user name=ann|>\nBye<|end|>\n<|user name=ann|>\nBye<|end|>\n")
    assert [bob.text[s.start:s.start + s.length] for s in bob.learn] == ["<|end|>\n"]
    ann = got[(1, "ann")]
    assert [ann.text[s.start:s.start + s.length] for s in ann.learn] == ["Hi < |end|><|end|>\n", "Bye<|end|>\n", "Bye<|end|>\n"]


def test_roles_forge_no_marker(spark):
    rows = [(1, 0, "x|>\n<|assistant", "a"), (1, 1, "<|>", "b"), (1, 2, "ann", "c")]
    got = {r.perspective: r for r in chat.dialogues(chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got["ann"].text == ("<|user name=x| >\n< |assistant|>\na<|end|>\n<|user name=< | >|>\nb<|end|>\n<|assistant|>\nc<|end|>\n")
    assert got["<|>"].text.count("<|assistant|>") == 1


def test_neighbours(spark):
    schema = "vec_id long, embedding array<float>"
    assert neighbours.nearest(*[spark.createDataFrame([], schema)] * 2).collect() == []
    random_ = np.random.default_rng(4)
    x = random_.standard_normal((2000, 16)).astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(9000, None), (9050, [0.0] * 16), (9100, [float("nan")] * 16), (9150, [1.0] * 3), (None, [1.0] * 16), (9200, [None] + [1.0] * 15)]
    df = spark.createDataFrame(rows + odd, schema).selectExpr("*", "1 AS id", "'v' AS vector", "2 AS list")
    got: dict = {}
    for r in neighbours.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    assert set(got) == set(range(0, 2000, 50)) and all(sorted(v) == [1, 2, 3, 4, 5] for v in got.values())
    for q, found in got.items():
        near = np.round(unit @ unit[q], 12)
        near[q] = -2
        best = sorted(range(2000), key=lambda i: (-near[i], i))[:5]
        hits += len({v for v, _ in found.values()} & set(best))
        assert all(abs(near[v] - s) < 1e-9 for v, s in found.values())
    assert hits / (5 * len(got)) >= 0.9
    assert [got[100][i][0] for i in range(1, 6)] == [101, 102, 103, 104, 105]


def test_lines(spark, docs, empty):
    assert lines.remove_repeated_lines(empty).collect() == []
    passage = "\n".join(f"a passage line number {i} of several" for i in range(12))
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"own one\n{passage}\nend one"), (2, f"{passage}\nown two"), (3, f"x\n{long}\ny"), (4, f"z\n{long}"), (5, "short\nq"),
            (6, "short\nr"), (7, "again\nagain\nagain"), (8, None), (9, ""), (None, passage), (2, f"{passage}\nown two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *CLASH)
    got = lines.remove_repeated_lines(df)
    assert got.columns == [*df.columns, "_removed"]
    texts = sorted(((r.doc_id is None, r.doc_id, r.text) for r in got.collect()), key=lambda t: (t[0], t[1] or 0))
    assert [t[2] for t in texts] == [rows[0][1], "own two", "own two", rows[2][1], "z", "short\nq", "short\nr", rows[6][1], None, "", passage]


def test_clean_texts_keep_short_lines(spark):
    """Blank lines, brackets and short answers repeat everywhere and say nothing."""
    code = [f"def f{i}(x):\n    return x + {i}\n}}\n\n}}\n}}\n\n\n" for i in range(4)]
    talk = [f"Question number {i}?\n\nYes.\n\nAnd then {i * i}?\n\nYes." for i in range(4)]
    rows = list(enumerate(code + talk + ["a\n\n\n\nb", "c\n\n\n\nd"]))
    got = lines.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == dict(rows) and not any(r["_removed"] for r in got)


def test_passages_in_any_surroundings(spark):
    """A passage between lines of its own is found whatever near copies share around its other places."""
    pick = random.Random(40)
    line = lambda n: " ".join(f"w{pick.randrange(9000)}" for _ in range(n))
    rows, want, at = [], {}, 0
    for _ in range(40):
        before, after = [line(9) for _ in range(6)], [line(9) for _ in range(6)]
        passage = [line(18) for _ in range(3)]
        copy = [*before, *passage, *after]
        rows += [(at, "\n".join(copy)), (at + 1, "\n".join([line(5), *copy[1:]])), (at + 2, "\n".join([line(5), line(6), *passage, line(5), line(7)]))]
        want[at + 2] = "\n".join(s for s in rows[-1][1].split("\n") if s not in passage)
        at += 3
    got = {r.doc_id: r.text for r in lines.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[d] == t for d, t in want.items()) == 40
    assert got == lines_left(dict(rows))


def test_lines_like_brute_force(spark):
    pick = random.Random(7)
    stock = [" ".join(f"v{pick.randrange(50)}" for _ in range(pick.choice([0, 1, 3, 12, 55]))) for _ in range(60)]
    rows = []
    for i in range(150):
        text = []
        while len(text) < pick.randint(0, 40):
            start = pick.randrange(60)
            text += stock[start:start + pick.randint(1, 12)]
        rows.append((i, "\n".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'7' AS _h", "77 AS _place", "1 AS _removed", "2 AS _cuts", "'r' AS _row", "3 AS start")
    out = lines.remove_repeated_lines(df)
    assert out.columns == [*df.columns, "__removed"]
    got = out.collect()
    want = lines_left(dict(rows))
    assert {r.doc_id: r.text for r in got} == {d: want.get(d, "") for d, _ in rows}
    assert {(r["_h"], r["_place"], r["_removed"], r["_cuts"], r["_row"], r["start"]) for r in got} == {("7", 77, 1, 2, "r", 3)}


def test_mixing(spark, docs, empty):
    assert mixing.mix_documents(empty).collect() == []
    odd = mixing.mix_documents(docs).collect()
    assert len(odd) == len(TEXTS) and all(r.taken <= 2 * r["size"] for r in odd)
    rows = [(i, "w " * (5 + i * 7 % 90), f"s{i % 4}" if i % 9 else None) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, target, size = Counter(), {}, Counter()
    got = mixing.mix_documents(df).collect()
    for r in got:
        taken[r.source] += r.taken
        size[r.source] += r["size"]
        target[r.source] = r.target
        assert r.taken in (0, r["size"], 2 * r["size"])
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    assert all(target[s] <= 2 * size[s] and abs(taken[s] - target[s]) < 0.02 * target[s] for s in size)
    assert sorted(map(tuple, mixing.mix_documents(df.repartition(5)).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert mixing.mixed_rows(df).count() == sum(r.copies for r in got)


def test_mixed_rows_with_ids_that_repeat(spark):
    """Copies follow the row, not its id."""
    rows = [(None if i % 2 else i % 5, "w " * 10 + str(i % 3), "a" if i < 1000 else "b") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "77 AS _i", "5 AS _k", "'x' AS key", "9 AS copies", "1 AS row")
    got = mixing.mixed_rows(df).collect()
    copies = Counter(r.source for r in got)
    assert copies["a"] == 2000 and abs(copies["b"] - 1000) <= 1  # weights 3 and 1; a stops at twice its size
    assert mixing.mixed_rows(df).columns == df.columns and {(r["_i"], r["_k"], r["key"], r["copies"], r["row"]) for r in got} == {(77, 5, "x", 9, 1)}


def test_frequent_words_of_equal_counts(spark):
    counts = spark.range(5000).selectExpr("id AS h", "IF(id < 10, 9L, 3L) AS c")
    got = [r.h for r in recurrent.most_frequent(counts, 2048).collect()]
    assert sorted(got) == list(range(2048)) and recurrent.most_frequent(counts, 9000).count() == 5000
    assert sorted(r.h for r in recurrent.most_frequent(counts, 10).collect()) == list(range(10))
    assert recurrent.most_frequent(counts.where("false"), 5).count() == 0


def test_recurrent(spark, docs, empty):
    assert recurrent.score_documents(empty).collect() == []
    rows = recurrent.score_documents(docs).collect()
    known = Counter()
    texts = {d: ([w for w in (t or "").replace("\n", " ").replace("\t", " ").replace("\x0b", " ").split(" ") if w], d) for d, t in TEXTS}
    lower = lambda w: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
    for d, t in TEXTS:
        if d is None or zlib.crc32(str(d).encode()) % 5 != 1:
            known.update([*map(lower, texts[d][0]), "\0"])
    total = sum(known.values())
    for r in rows:
        own = [*map(lower, texts[r.doc_id][0]), "\0"]
        base = sum(math.log10((known[w] + 0.5) / (total + 0.5 * (len(known) + 1))) for w in own)
        assert abs(base - r.base_score) < 1e-6 * max(1, abs(base)) and (r.n_tokens, r.train_tokens) == (len(own), total)
        assert r.n_known == sum(w in known for w in own) and r.score < 0


def test_gradients_are_the_slopes_of_the_score():
    random_ = np.random.default_rng(3)
    words_ = np.unique(random_.integers(0, 1 << 62, 40, dtype=np.uint64))
    net = recurrent.Network(words_, np.sort(random_.integers(2, 90, 40))[::-1].astype(float), 9, np.full(51, 3.0), np.full(51, 2.0))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    hashes = np.concatenate([random_.choice(words_, 30), [recurrent.END], random_.integers(0, 9, 5, dtype=np.uint64)])
    inputs, classes = net.number(hashes, np.zeros(len(hashes), dtype=np.int32))
    keep, states, h = [], [], np.zeros((1, recurrent.HIDDEN))
    for i in range(len(inputs)):
        h = net.step(inputs[i - 1:i] if i else np.array([net.end_input]), h, keep)
        states.append(h)
    seen: dict = {}
    before = {k: v.copy() for k, v in net.p.items()}
    bounds = np.array([0, len(inputs)])
    recurrent._learn(net, keep, states, np.arange(len(inputs)), inputs, classes, seen)
    net.p = before
    for name in net.p:
        slope = seen[name][0] * 10 * recurrent.FULL_STEP_TOKENS
        at = np.unravel_index(int(np.abs(slope).argmax()), slope.shape)
        sides = []
        for sign in (1, -1):
            net.p[name][at] += sign * 1e-4
            sides.append(-recurrent.score_tokens(net, inputs, classes, bounds)[0])
            net.p[name][at] -= sign * 1e-4
        assert abs((sides[0] - sides[1]) / 2e-4 - slope[at]) < 1e-2 * max(1, abs(slope[at])), name


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
def test_queries_and_sql(spark):
    from returnlens.llm.queries import ORACLE_SQL, QUERIES
    from tests.compare import differences, duck

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    for name in ORACLE_SQL:
        assert differences(spark, duck(SF), name, QUERIES[name], ORACLE_SQL[name], SF) == "", name
