"""Near-duplicates against brute force over all pairs."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from returnlens.llm.near import bands_per_side, kept_rows, near_duplicates, remaining_pairs


def shingles(text: str | None, words: int) -> set:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    tokens = [t for t in lowered.split(" ") if t]
    if len(tokens) < words:
        return {tuple(tokens)} if tokens else set()
    return {tuple(tokens[i:i + words]) for i in range(len(tokens) - words + 1)}


def brute_rows(rows, words, percent):
    """(doc_id, shingles, component, kept) of every row, a document of its own whatever its id."""
    sets = [shingles(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                parent[find(i)] = find(j)
    members: dict[int, list[int]] = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(i)
    out = []
    for group in members.values():
        ids = sorted(rows[i][0] for i in group if rows[i][0] is not None)
        least, left = (ids[0] if ids else None), True
        for i in sorted(group):
            keep = left and rows[i][0] == least
            left = left and not keep
            out.append((rows[i][0], len(sets[i]), least, keep))
    return out


def brute_force(rows, words, percent):
    return set(brute_rows(rows, words, percent))


def corpus(seed: int, groups: int = 12, members: int = 12):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, at = [], 100
    for _ in range(groups):
        base = [pick.choice(vocabulary) for _ in range(pick.randint(20, 120))]
        for _ in range(members):
            text = [w if pick.random() > 0.02 else pick.choice(vocabulary) for w in base]
            rows.append((at, " ".join(text).upper() if pick.random() < 0.2 else "\n".join(text)))
            at += 1
    passage = " ".join(pick.choice(vocabulary) for _ in range(40))
    rows += [(at + i, passage + " " + " ".join(pick.choice(vocabulary) for _ in range(30))) for i in range(30)]
    rows += [(1, None), (2, ""), (3, " \t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "two one"), (8, "é É"), (9, "é É")]
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_same_as_all_pairs(spark, words, percent):
    rows = corpus(words)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS rep", "'x' AS component")
    got = {tuple(r) for r in near_duplicates(df, words, percent).collect()}
    assert got == brute_force(rows, words, percent)


def some(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((v is None, v) for v in r))


def test_repeated_and_null_ids(spark):
    pick = random.Random(5)
    rows = [(pick.choice([None, None, d, d % 7]), t) for d, t in corpus(4, 6, 8)]
    rows += [(7, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, "x"), (None, "x"), (None, "y y y y y y"), (None, None), (None, None), (3, None), (3, "")]
    rows += [(None, " ".join(f"n{i}" for i in range(40)))] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS row", "'x' AS check")
    assert some(near_duplicates(df, 5, 80).collect()) == some(brute_rows(rows, 5, 80))
    kept = kept_rows(df)
    want = Counter(r[2] for r in brute_rows(rows, 5, 80) if r[3])
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).collect() == [] and kept_rows(empty).collect() == []


def test_remaining_pairs_miss_no_link(spark):
    pick = random.Random(3)
    rows = []
    for rep in range(60):
        base = set(range(rep % 6 * 100, rep % 6 * 100 + 40))
        rows.append((rep, rep, sorted((base - set(pick.sample(sorted(base), 3))) | {10_000 + rep})))
    df = spark.createDataFrame(rows, "rep long, component long, shingles array<long>")
    got = {tuple(r) for r in remaining_pairs(df, 85).collect()}
    want = {(a, b) for a, _, x in rows for b, _, y in rows
            if a < b and 100 * len(set(x) & set(y)) >= 85 * len(set(x) | set(y))}
    assert want and want <= got


def test_number_of_bands():
    assert bands_per_side(85) == 11 and bands_per_side(80) == 14
