"""Near-duplicate classes against plain set comparison: hostile words, hot groups, chains and shared names."""

import itertools

import numpy as np
import pytest

from plexloom.llm import near_dedup


def shingles(text):
    words = text.translate({c: c + 32 for c in range(65, 91)}).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def classes(rows):
    """doc_id -> (n_shingles, component_id), by an inverted index over whole shingles."""
    sets = {i: shingles(t or "") for i, t in rows}
    holders, root = {}, {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        shared = {}
        for x in s:
            for j in holders[x]:
                if j > i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}


def found(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}


def test_words_of_one_pattern(spark):
    """Words that differ only in the order of two letters, in the pattern that collides modulo 2**64."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    swapped = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, swapped), (3, f"{word} " * 9), (4, f"{swapped} " * 9), (5, word)]
    assert found(spark, rows) == {1: (1, 1), 2: (1, 2), 3: (1, 3), 4: (1, 4), 5: (1, 1)}


def test_hot_group(spark):
    """A group of 1300 near copies, one of 700 exact copies and a chain, among other texts."""
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(10**9)}"
    base = [word() for _ in range(90)]
    rows = []
    for _ in range(1300):
        own = list(base)
        for k in rng.choice(90, rng.integers(1, 3), replace=False):
            own[k] = word()
        rows.append(" ".join(own))
    rows += [" ".join(f"copy{i}" for i in range(30))] * 700
    chain = [word() for _ in range(400)]
    rows += [" ".join(chain[4 * i : 4 * i + 100]) for i in range(60)]
    rows += [" ".join(word() for _ in range(rng.integers(1, 80))) for _ in range(300)] + ["", "one", "one two", "ONE two", None]
    ids = rng.permutation(len(rows)).tolist()
    rows = list(zip(ids, rows, strict=True))
    want, got = classes(rows), found(spark, rows, 7)
    links = sum(c != i for i, (_, c) in want.items())
    assert got == want and links > 2000


@pytest.mark.parametrize("seed", [1, 2])
def test_random_edits(spark, seed):
    """Copies with growing numbers of edits, at and around the threshold."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(25):
        base = [f"g{g}_{rng.integers(40)}" for _ in range(rng.integers(3, 120))]
        for _ in range(6):
            own = list(base)
            for k in range(rng.integers(0, 5)):
                own[rng.integers(len(own))] = f"x{k}"
            rows.append(" ".join(own))
    rows = list(enumerate(rows))
    assert found(spark, rows) == classes(rows)


def test_names_that_share_a_half(spark):
    """Sets whose names agree in 64 of 128 bits stay apart."""
    rows = list(itertools.product([7], range(4)))
    own = spark.createDataFrame([(d, h, x, 3, b"", [1]) for d, (h, x) in enumerate([*rows, (8, 0), (7, 0)])], "doc_id long, h1 long, h2 long, n long, regs binary, bands array<long>")
    got = [(r.h1, r.h2, r.vid) for r in near_dedup.classes(own).collect()]
    assert len(got) == 5 and len({v for *_, v in got}) == 5 and {v for a, b, v in got if (a, b) in ((7, 0), (8, 0))} == {7, 8}
