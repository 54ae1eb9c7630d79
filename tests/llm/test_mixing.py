import math

import pytest

from raggedly.llm.mixing import mix, word_count


def targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; what is above a limit is shared again, one round after another."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in fixed]
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return {**fixed, **share}
        for s in over:
            fixed[s] = most * sizes[s]
            left -= fixed[s]


def run(make, rows):
    docs = make(rows)
    return mix(docs, word_count(docs["text"])).collect()


def test_targets_and_budgets(make):
    rows = [(i, "w " * (i % 50), ["a", "b", "ü", "c", None, "d"][min(i % 13, 5)]) for i in range(9000)]
    rows += [(99999, None, "empty"), (99998, "", "empty"), (4, "a b c", "a"), (4, "a b c", "a")]
    out = run(make, rows)
    assert len(out) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)
    for s in sizes:
        mine = [r for r in out if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]}
        assert mine[0].target == pytest.approx(want[s])
        assert sum(r.taken for r in mine) == math.floor(mine[0].target)
        assert all(0 <= r.taken <= 3 * r.size for r in mine)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, run(make, rows)), key=str)


def test_excess_goes_round(make):
    rows = [(1, "w " * 4, "a"), (2, "w " * 100, "b"), (3, "w " * 10, "c")]
    got = {r.source: r.target for r in run(make, rows)}
    assert got == pytest.approx(targets({"a": 4, "b": 100, "c": 10}))
    assert got["a"] == 12 and sum(got.values()) == pytest.approx(114)


def test_nothing(make):
    assert run(make, []) == []
    assert [(r.doc_id, r.taken) for r in run(make, [(None, None, None)])] == [(None, 0)]
