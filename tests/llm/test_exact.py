import hashlib
import re

import pytest

from raggedly.llm.exact import exact_duplicates, rounds


def brute(rows):
    groups = {}
    bare = [(d, t or "", re.sub(r"[\x20\x09-\x0D]", "", t or "")) for d, t in rows]
    for d, t, b in bare:
        groups.setdefault(b, []).append((-len(t), d))
    return sorted(
        (d, min(groups[b])[1], len(groups[b]), d == min(groups[b])[1],
         hashlib.sha256(b.encode()).hexdigest())
        for d, t, b in bare
    )


@pytest.mark.parametrize("fan", [2, 8])
def test_against_brute_force(make, fan):
    rows = [(i, ["a b", "ab", " a\tb\x0b", "ü x", "üx", "", None, "long " * 3000][i % 8]) for i in range(90)]
    rows += [(500, "a b"), (501, "ab"), (501, "ab")]
    out = exact_duplicates(make(rows), fan=fan)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(tuple(r) for r in out.collect()) == brute(rows)


def test_null_id_is_the_largest(make):
    out = exact_duplicates(make([(None, "x y"), (7, "xy "), (8, None)])).collect()
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in out}
    assert got == {None: (7, 2, False), 7: (7, 2, True), 8: (8, 1, True)}


def test_empty(make):
    assert exact_duplicates(make([])).collect() == []


def test_rounds():
    assert [rounds(n, 8) for n in (1, 8, 9, 64, 65)] == [1, 1, 2, 2, 3]
