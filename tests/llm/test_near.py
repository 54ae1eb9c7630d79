import random
import re

import numpy as np
import pytest

from raggedly.llm import near
from raggedly.llm.near import near_duplicates
from raggedly.llm.stars import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k=5, percent=80):
    ids = [d if d is not None else 1 << 62 for d, _ in rows]
    sets = [shingles(t, k) for _, t in rows]
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(ids[i]), find(ids[j])))
                root[y] = x
    return sorted((d, len(s), find(d), d == find(d)) for d, s in zip(ids, sets))


def texts(seed, n=160):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and r.random() < 0.7:
            w = r.choice(rows)[1].split()
            for _ in range(r.randrange(1 + len(w) // 12)):
                w[r.randrange(len(w))] = r.choice(["Other", "word", f"n{i}"])
        else:
            w = [f"W{r.randrange(300)}" for _ in range(r.choice([1, 2, 4, 30, 200]))]
        rows.append((r.randrange(10**6) * 1000 + i, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed, k", [(1, 5), (2, 2), (3, 2)])
def test_against_brute_force(make, monkeypatch, seed, k):
    if seed == 3:
        monkeypatch.setattr(near, "BLOCK", 4)
        monkeypatch.setattr(near, "STEP_COLUMNS", 16)
    rows = texts(seed) + [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "é É"), (7, "É É")]
    rows += [(8, "long " + " ".join(f"x{i % 6000}" for i in range(9000)))] * 2
    got = sorted(tuple(r) for r in near_duplicates(make(rows), k=k).collect())
    assert got == brute(rows, k)


def test_one_large_group(make):
    r = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(700):
        w = list(base)
        for _ in range(r.randrange(14)):
            w[r.randrange(len(w))] = f"c{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = sorted(tuple(r) for r in near_duplicates(make(rows), k=2).collect())
    assert got == brute(rows, 2)


def test_null_id_is_the_largest(make):
    t = "a b c d e f g"
    out = {r.doc_id: r for r in near_duplicates(make([(None, t), (3, t + " ")])).collect()}
    assert (out[None].component_id, out[None].kept, out[3].kept) == (3, False, True)
    assert [tuple(r) for r in near_duplicates(make([(None, t)])).collect()] == [(None, 3, None, True)]


def test_empty(make):
    assert near_duplicates(make([])).collect() == []


@pytest.mark.parametrize("n, m", [(300, 250), (300, 600), (200, 0)])
def test_components(spark, n, m):
    rng = np.random.default_rng(n + m)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2))] + [(i + 1000, i + 1001) for i in range(40)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in root)
