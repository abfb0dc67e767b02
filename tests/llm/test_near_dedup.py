"""Near duplicates against brute force: bridges without an id, hot groups, sets too large to be held whole."""

import random

import numpy as np
import pytest

from tessella.llm import near_dedup
from tessella.llm.near_dedup import Cell
from tessella.llm.shared import components
from tessella.llm.words import U64


def brute(texts, percent, size=5):
    """(set sizes, component by smallest place) of texts."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


def variants(rng, n, words, edits, name):
    base = [f"{name}{i}" for i in range(words)]
    out = []
    for k in range(n):
        w = list(base)
        for at in rng.sample(range(words), rng.randint(0, edits)):
            w[at] = f"{name}x{k}y{at}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_components_are_those_of_all_pairs(spark, monkeypatch, percent):
    monkeypatch.setattr(near_dedup, "BLOCK", 1 << 14)  # lists in several blocks
    rng = random.Random(percent)
    texts = variants(rng, 60, 100, 6, "a") + variants(rng, 40, 400, 18, "b") + variants(rng, 30, 900, 40, "c") + variants(rng, 20, 12, 2, "d") + ["one two", "one two", "", None, "One  TWO"]
    rng.shuffle(texts)
    sizes, component = brute(texts, percent)
    assert 20 < len(set(component)) < 120
    got = {r.doc_id: r for r in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), percent).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == component


def test_a_row_without_id_links_its_neighbours(spark):
    words = [f"w{i}" for i in range(300)]
    one, two, three = (" ".join(words[a : a + 270]) for a in (0, 15, 30))
    assert brute([one, two, three], 85)[1] == [0, 0, 0] and brute([one, three], 85)[1] == [0, 1]
    got = near_dedup.near_duplicates(spark.createDataFrame([(1, one), (None, two), (2, three), (None, two)], "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {1}
    assert sorted((r.doc_id or 0, r.kept) for r in got) == [(0, True), (0, True), (1, True), (2, False)]


def test_a_cell_sends_on_fewer_links_than_it_has_members():
    rng = np.random.default_rng(5)
    base = rng.integers(1, 1 << 62, 400, dtype=np.int64).astype(U64)
    for gone, wide in ((10, None), (90, None), (10, 256), (90, 256), (50, 256)):  # all link, none does
        sets = [np.unique(np.concatenate([rng.choice(base, 400 - gone, replace=False), rng.integers(1, 1 << 62, gone, dtype=np.int64).astype(U64)])) for _ in range(500)]
        n = np.array([len(s) for s in sets])
        held = [s[:wide] for s in sets]
        length = np.array([len(s) for s in held])
        cell = Cell(np.arange(500), np.arange(500), n, np.zeros(500, int), np.concatenate(held), np.cumsum(length) - length, length)
        cell.compare(85, wide, near_dedup.least_shared(256, 85, near_dedup.WIDE_MISS))
        assert len(cell.links) == (499 if gone == 10 and wide is None else 0)
        assert cell.open.sum() == (500 if gone == 10 and wide else 0) or gone == 50


def test_rows_between_the_steps_follow_the_members(spark, monkeypatch):
    made = []
    first = near_dedup.cut
    monkeypatch.setattr(near_dedup, "cut", lambda df, **few: made.append(first(df, **few)) or made[-1])
    rng = random.Random(3)
    most = []
    for n in (300, 900):
        made.clear()
        base = [f"w{i}" for i in range(400)]
        texts = [" ".join(f"x{k}y{i}" if i in gone else w for i, w in enumerate(base)) for k in range(n) for gone in [set(rng.sample(range(400), 10))]]  # nearly none links
        assert near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).filter("kept").count() > 0.9 * n
        most.append(max(df.count() for df in made))
    assert most[1] < 4 * most[0]


@pytest.mark.parametrize("most", [200_000, 40])
def test_components_of_any_shape(spark, most):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 300)] + [(1000, i) for i in range(1001, 1200)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(180)] + [(5, 5), (7, 9), (9, 7)]
    rng.shuffle(edges)
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), most=most).collect()}
    assert got == {x: find(x) for x in root if find(x) != x} | {x: c for x, c in got.items() if x == c}
    assert components(spark.createDataFrame([], "a long, b long"), most=most).count() == 0
