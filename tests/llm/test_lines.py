from raggedly.llm.lines import drop_repeated_lines


def brute(rows, w=3):
    first = {}
    docs = [(d, (t or "").split("\n")) for d, t in rows]
    for d, lines in docs:
        for i in range(len(lines) - w + 1):
            k = tuple(lines[i : i + w])
            first[k] = min(first.get(k, (d, i)), (d, i))
    out = []
    for d, lines in docs:
        gone = {
            j
            for i in range(len(lines) - w + 1)
            if first[tuple(lines[i : i + w])] < (d, i)
            for j in range(i, i + w)
        }
        out.append((d, len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return sorted(out)


def test_against_brute_force(make):
    shared = "p\nq\nr\ns"
    rows = [(i, f"{shared}\n{i}\n{i % 3}\nend") for i in range(30)]
    rows += [(40, "a\na\na\na\na"), (41, None), (42, ""), (43, "p\nq"), (44, "\n\n\n\n")]
    rows += [(45, "x\n" * 5000), (46, shared), (46, shared)]
    got = sorted(tuple(r)[:4] for r in drop_repeated_lines(make(rows)).collect())
    assert got == brute(rows)


def test_repeated_and_null_ids_of_different_texts(make):
    top = "p\nq\nr\ns\n"
    rows = [(1, "a\nb\nc"), (7, top + "t\nu\nv"), (7, "x\ny\nz"), (7, "1\n2\n3\n4\n" + top + "5")]
    big = [top + f"{i}\n" * (i % 7 + 1) + "a\nb\nc" for i in range(20)]
    big += ["1\n2\n3\n4", "e\nf\ng\nh\ni", "a\nb\nc\nk", "k", None, big[0]]
    full = rows + [(10**9, t) for t in big]
    none = [(d if d < 10**9 else None, t) for d, t in full]
    got = [(10**9 if r[0] is None else r[0], *r[1:4]) for r in map(tuple, drop_repeated_lines(make(none)).collect())]
    assert sorted(got) == brute(full)
    assert sorted(tuple(r)[:4] for r in drop_repeated_lines(make(full)).collect()) == brute(full)


def test_empty(make):
    assert drop_repeated_lines(make([])).collect() == []


def test_null_id(make):
    out = drop_repeated_lines(make([(None, "a\nb\nc"), (1, "a\nb\nc")])).collect()
    assert {r.doc_id: r.kept for r in out} == {None: "", 1: "a\nb\nc"}
