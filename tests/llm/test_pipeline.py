"""The pipeline, stage by stage, against plain Python over all of a small corpus."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from returnlens.llm import quality
from tests.llm.test_near import brute_force

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus() -> list[tuple]:
    pick = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in "lnrst"]
    line = lambda n: " ".join(pick.choice(words) for _ in range(n)).capitalize() + "."
    passage = [line(9) for _ in range(8)]
    long_line = line(70)
    texts = []
    for i in range(60):
        texts.append("\n".join(line(pick.randint(6, 14)) for _ in range(pick.randint(2, 6))))
        if i % 6 == 0:
            texts.append("\n".join([line(8), *passage, line(7)]))
        if i % 12 == 0:
            texts += [f"{line(5)}\n{long_line}", long_line, "\n".join(passage)]
        if i % 15 == 0:
            base = line(100).split(" ")
            texts += [" ".join(w if pick.random() > 0.01 else pick.choice(words) for w in base) for _ in range(5)]
        texts.append("$$ 0000 #### " * pick.randint(3, 20))
    texts += [None, "", " \n"]
    pick.shuffle(texts)
    return [(i, t, "en", pick.choice(["a", "a", "a", "b", "c", None]), None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    rows = corpus()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    good = [(d, int(bool(t and "$" not in t and t.strip()))) for d, t, *_ in rows]
    spark.createDataFrame(good, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path


def lines_left(rows: dict[int, str | None]) -> dict[int, str | None]:
    """A line is repeated if it and a neighbour, or it alone with over 50 words, stand in an earlier text;
    repeated lines in a row go if they are two with 20 words or more, or a long one."""
    pairs, longs, out = set(), set(), {}
    for doc_id in sorted(rows):
        if rows[doc_id] is None:
            out[doc_id] = None
            continue
        lines = rows[doc_id].split("\n")
        own = list(zip(lines, lines[1:]))
        known = {i for i, p in enumerate(own) if p in pairs}
        alone = {i for i, s in enumerate(lines) if s in longs}
        pairs |= set(own)
        longs |= {s for s in lines if len(s.split()) > 50}
        gone, at = set(), 0
        while at < len(lines):
            stop = at + 1 if at in alone or at in known else at
            while stop < len(lines) and stop > at and (stop - 1 in known or stop in known or stop in alone):
                stop += 1
            size = sum(len(s.split()) for s in lines[at:stop])
            if size > 50 or (stop - at > 1 and size >= 20):
                gone |= set(range(at, stop))
            at = max(stop, at + 1)
        left = "\n".join(s for i, s in enumerate(lines) if i not in gone)
        if not gone or left.strip():
            out[doc_id] = left
    return out


def targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full = set()
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[o] for o in order if o not in full) for s in order if s not in full}
        above = {s for s, t in share.items() if t > 2 * sizes[s]}
        if not above:
            return share | {s: 2 * sizes[s] for s in full}
        full |= above


def test_stages(spark, folder):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "lines", "near duplicates", "mix", "pack"]
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))

    good = stages["quality"](spark, docs, folder)
    scored = {r.doc_id for r in quality.score_quality(docs, labels).collect() if r.predicted}
    texts = {r.doc_id: r.text for r in good.collect()}
    assert good.columns == docs.columns and set(texts) == scored
    marks = {r.doc_id: r.quality for r in labels.collect()}
    assert np.mean([(d in texts) == bool(q) for d, q in marks.items()]) > 0.95

    cleaned = stages["lines"](spark, good, folder)
    rows = cleaned.collect()
    assert {r.doc_id: r.text for r in rows} == lines_left(texts) and cleaned.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)

    single = stages["near duplicates"](spark, cleaned, folder)
    rows = single.collect()
    kept = {d for d, _, _, keep in brute_force([(r.doc_id, r.text) for r in cleaned.collect()], 5, 80) if keep}
    assert {r.doc_id for r in rows} == kept and single.columns == docs.columns and len(kept) < cleaned.count()

    mixed = stages["mix"](spark, single, folder)
    words, sizes, taken = {}, Counter(), Counter()
    for r in rows:
        words[r.doc_id] = len((r.text or "").split())
        sizes[r.source] += words[r.doc_id]
    copies = Counter(r.doc_id for r in mixed.collect())
    for r in rows:
        taken[r.source] += copies[r.doc_id] * words[r.doc_id]
    assert mixed.columns == docs.columns and max(copies.values()) <= 2
    for source, target in targets(sizes).items():
        assert abs(taken[source] - target) <= max(words[r.doc_id] for r in rows if r.source == source)

    tokenizer = Tokenizer.from_file(path("word_bpe_49k.json"))
    ids = {r.doc_id: np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], dtype="<u4") for r in rows}
    for packed in (stages["pack"](spark, mixed, folder), corpus_pipeline.run(spark, folder)):
        covered: dict = defaultdict(Counter)
        filled: Counter = Counter()
        for p in sorted(packed.collect(), key=lambda p: (p.sequence_id, p.offset)):
            assert p.offset == filled[p.sequence_id]
            filled[p.sequence_id] += p.length
            assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start:p.start + p.length].tobytes())
            covered[p.doc_id].update(range(p.start, p.start + p.length))
        assert max(filled.values()) <= 2048
        assert {d: (len(c), *set(c.values())) for d, c in covered.items()} == {d: (len(ids[d]), n) for d, n in copies.items()}
