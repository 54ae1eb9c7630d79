import hashlib
import random
import re

import numpy as np
import pytest

from raggedly.llm.substrings import choices, drop_repeated_passages, open_windows, recompress
from raggedly.llm.tables import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, w=20):
    docs = [(d if d is not None else 1 << 62, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, x in docs:
        for i in range(len(x) - w + 1):
            k = tuple(x[i : i + w])
            first[k] = min(first.get(k, (d, i)), (d, i))
    out = []
    for d, x in docs:
        gone = set()
        for i in range(len(x) - w + 1):
            if first[tuple(x[i : i + w])] < (d, i):
                gone.update(range(i, i + w))
        kept = " ".join(y for i, y in enumerate(x) if i not in gone)
        out.append((d, len(x), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out)


def texts(seed):
    r = random.Random(seed)
    word = lambda n: [f"w{r.randrange(n)}" for _ in range(r.randrange(5, 120))]
    passages = [word(500)[: r.randrange(15, 60)] for _ in range(8)] + [["x"] * 30, ["a", "b"] * 25]
    rows = []
    for i in range(120):
        parts = [word(r.choice([3, 50, 5000]))]
        for _ in range(r.randrange(3)):
            parts += [list(r.choice(passages)), word(5000)]
        if i % 5 == 0 and rows:  # a near copy
            parts = [r.choice(rows)[1].split()]
            parts[0][r.randrange(len(parts[0]))] = "changed"
        rows.append((r.randrange(10**6) * 1000 + i, r.choice([" ", "\n", " \t "]).join(sum(parts, []))))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(make, seed):
    rows = texts(seed)
    rows += [(5, rows[3][1]), (10**12, rows[4][1]), (7, None), (8, ""), (9, "x " * 50), (11, "é " * 19)]
    rows += [(12, "q " * 20), (12, "q " * 20), (13, " ".join(f"long{i % 7000}" for i in range(9000)))]
    got = sorted(tuple(r) for r in drop_repeated_passages(make(rows)).collect())
    assert got == brute(rows)


def test_symbols_are_decided_by_their_span():
    rng = np.random.default_rng(0)
    for _ in range(60):
        inner = rng.integers(0, rng.choice([2, 4, 1000]), 60).astype(np.uint64)
        whole, names = [], []
        for _ in range(2):
            before, after = rng.integers(0, 4, rng.integers(0, 9)), rng.integers(0, 4, rng.integers(0, 9))
            x = mix(np.concatenate([before.astype(np.uint64), inner, after.astype(np.uint64)]))
            s = recompress(x, np.zeros(len(x), np.int64))
            n = len(before)
            inside = (s.low >= n) & (s.high <= n + 60)
            names.append({(a - n, int(b)) for a, b in zip(s.first[inside].tolist(), s.name[inside].tolist())})
        assert names[0] == names[1]


def test_open_windows_end_with_their_text():
    s = recompress(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    none, counts = np.zeros(0, np.int64), np.array([3, 0, 5])
    # A window without a chosen name stays open.
    assert open_windows(choices(s, none, counts, 3), none > 0, counts, 3).tolist() == [0, 3, 4, 5]


def test_a_window_chooses_its_longest_symbol():
    rng = np.random.default_rng(5)
    for _ in range(40):
        counts = rng.integers(0, 40, 4)
        words = mix(rng.integers(0, rng.choice([2, 6, 500]), counts.sum()).astype(np.uint64))
        text = np.repeat(np.arange(4), counts)
        s = recompress(words, text)
        row = text[s.first]
        long = np.diff(np.append(s.first, len(words))).tolist()
        symbol, start = choices(s, row, counts, 9)
        got = set(zip(start.tolist(), symbol.tolist()))
        want = set()
        for at in range(len(words)):
            if (text[at : at + 9] == text[at]).all() and at + 9 <= len(words):
                inside = [i for i in range(len(row)) if s.low[i] >= at and s.high[i] <= at + 9]
                keys = {i: (-long[i], int(s.name[i]) >> 6) for i in inside}
                want |= {(at, i) for i in inside if keys[i] == min(keys.values())}
        assert got == want
        alone = rng.random(len(row)) < 0.5
        closed = {a for a, i in want if alone[i]}
        fits = [a for a in range(len(words)) if a + 9 <= len(words) and text[a + 8] == text[a]]
        assert open_windows((symbol, start), alone, counts, 9).tolist() == [a for a in fits if a not in closed]


def test_null_id_is_the_largest(make):
    t = " ".join(map(str, range(25)))
    out = drop_repeated_passages(make([(None, t + " y"), (1, t)])).collect()
    assert {r.doc_id: r.n_removed for r in out} == {None: 25, 1: 0}


@pytest.mark.parametrize("seed", [4, 5])
def test_repeated_and_null_ids_of_different_texts(make, seed):
    r = random.Random(seed)
    head = [f"h{i}" for i in range(25)]
    rows = [(1 if i < 3 else i, t) for i, (_, t) in enumerate(texts(seed))]
    rows = [(None if i % 3 == 0 and d != 1 else d // 4 * 4, t) for i, (d, t) in enumerate(rows)]
    for d in (None, None, 3, 2, 2, None, 7):  # the same start, and different lengths
        rows.append((d, " ".join(head + [f"v{r.random()}" for _ in range(r.randrange(90))])))
    rows += [(None, rows[9][1]), (None, rows[9][1]), (None, "short"), (None, None)]
    r.shuffle(rows)
    # Of two texts of one id, only the one that repeats a window loses it.
    rows += [(10**9, "z " * 40), (10**9, " ".join(f"u{i}" for i in range(22)))]
    big = 1 << 62
    got = sorted((big if x[0] is None else x[0], *x[1:]) for x in map(tuple, drop_repeated_passages(make(rows)).collect()))
    assert got == brute(rows)


def test_empty(make):
    assert drop_repeated_passages(make([])).collect() == []
