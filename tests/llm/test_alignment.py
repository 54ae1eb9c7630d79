import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from raggedly.llm import alignment
from raggedly.llm.alignment import align_tokens

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")


def byte_map():
    plain = [b for b in range(256) if chr(b).isprintable() and chr(b) != " " and b != 0xAD]
    out, more = {}, 256
    for b in range(256):
        if b in plain:
            out[chr(b)] = b
        else:
            out[chr(more)] = b
            more += 1
    return out


def brute(rows):
    """Whole texts, token by token."""
    a_tok = Tokenizer.from_file(A)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=B)
    byte = byte_map()
    found, links = [], []
    for _, text in rows:
        groups, pairs = [], []
        if text:
            raw = (" " + text).encode()
            a = a_tok.encode(" " + text, add_special_tokens=False).ids
            b = b_tok.encode(text)
            of_a = [bytes(byte[c] for c in a_tok.id_to_token(i)) for i in a]
            of_b = [
                bytes([int(p[3:-1], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode()
                for i, p in ((i, b_tok.id_to_piece(i)) for i in b)
            ]
            if b"".join(of_a) == raw == b"".join(of_b):
                def ends(tokens):
                    at, out = 0, []
                    for t in tokens:
                        at += len(t)
                        out.append(at)
                    return out

                ends_a, ends_b = ends(of_a), ends(of_b)
                start = 0
                for cut in sorted(set(ends_a) & set(ends_b)):
                    ga = [i for i, e in zip(a, ends_a) if start < e <= cut]
                    gb = [i for i, e in zip(b, ends_b) if start < e <= cut]
                    groups.append((ga, gb))
                    pairs += [(x, y) for x in ga for y in gb]
                    start = cut
        found.append(groups)
        links.append(pairs)
    counts = Counter(p for pairs in links for p in set(pairs))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for (doc_id, _), groups, pairs in zip(rows, found, links):
        spelled = ";".join(
            "|".join(",".join(map(str, ids)) for ids in group) for group in groups
        )
        out.append((
            doc_id,
            sum(len(g[0]) for g in groups),
            sum(len(g[1]) for g in groups),
            len(groups),
            len(pairs),
            sum(counts[p] == best[p[0]] for p in pairs),
            sum(counts[p] for p in pairs),
            hashlib.sha256(spelled.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=repr)


TEXTS = [
    "The quick brown fox.", "the the the cat", "", None, "a", " ", "  ", "a ", " a", "a  b", "x\ty\n z\n\n w",
    "<|endoftext|> and <s> </s> <unk> <0x41>", "weiß Öl für naïve façade", "日本語のテキスト と 漢字", "▁odd",
    "nul\x00in side", "é nb sp  wide \u0085next", "a" * 3000, "don't U.S.A. 3.14159 $%^&*()", "🙂🙃 zwj👩‍🚀",
    "word " * 500, "thblerean oniontion queeauch", "'s 't 're\n\n", "\r\n\x0b\x0c ", " x 　y",
]


def result(df):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert df.columns == columns
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("large", [0, 7, alignment.LARGE_GROUP])
def test_groups_of_any_size(large, monkeypatch):
    """Links of whole texts, counted group by group or one by one."""
    monkeypatch.setattr(alignment, "LARGE_GROUP", large)
    monkeypatch.setattr(alignment, "BUNCH", 3)
    aligner = alignment.Aligner(A, B)
    texts = [" " + t for t in TEXTS if t]
    got = aligner.aligned(texts)
    want = brute([(0, t) for t in TEXTS if t])
    assert sorted(map(tuple, got.numbers.tolist())) == sorted(r[1:5] for r in want)
    sums = np.add.reduceat(np.append(got.times, 0), np.cumsum(got.rows) - got.rows)
    assert [int(s) for s, r in zip(sums, got.rows) if r] == [int(n) for n in got.numbers[:, 3] if n]


@pytest.mark.parametrize("most", [alignment.MAX_BROADCAST_PAIRS, 0])
def test_against_whole_texts(make, most):
    rows = [(i, t) for i, t in enumerate(TEXTS * 2)] + [(3, "the cat sat"), (3, "the cat sat"), (None, "a"), (None, None)]
    assert result(align_tokens(make(rows), A, B, max_broadcast=most)) == brute(rows)


def test_words_many_at_a_time():
    """Words of the tables, encoded one after another and alone."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    words = sorted({f" {w}" for t in texts for w in (t or "").split(" ") if w})[::7]
    aligner = alignment.Aligner(A, B)
    assert aligner.words.fast
    together = aligner.encoded(words)
    aligner.words.fast = None
    for x, y in zip(together, aligner.encoded(words)):
        assert all((p == q).all() for p, q in zip(x, y))


@pytest.mark.parametrize("size", [100, 1 << 61])
@pytest.mark.parametrize("most", [1, 5])
def test_sums_of_pairs(size, most):
    rng = np.random.default_rng(size % 97 + most)
    of = np.sort(rng.integers(0, 5, 300))
    pair, number = rng.integers(0, 40, 300), rng.integers(1, most + 1, 300)
    want = Counter()
    for o, p, n in zip(of.tolist(), pair.tolist(), number.tolist()):
        want[o, p] += n
    pairs, numbers, texts = alignment._summed(pair, number, of, size)
    assert list(zip(zip(texts.tolist(), pairs.tolist()), numbers.tolist())) == sorted(want.items())
    assert [len(x) for x in alignment._summed(*[np.zeros(0, np.int64)] * 3, size)] == [0, 0, 0]


def test_held_pairs_go_to_the_shuffle(make, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(alignment, "HELD_PAIRS", 4)
    same = np.array([0, -1, 1])
    batches = [pa.RecordBatch.from_pydict({"_keys": pa.array(k, pa.list_(pa.int32()))}) for k in
               ([[0, 1, 2, 5, 8], [0, 1]], [[1, 2, 3, 4, 6], []], [[7]])]
    got = Counter()
    for b in alignment._count(same, 3)(batches):
        for r in b.to_pylist():
            got[r["key"], r["regular"]] += r["n"]
    assert got == Counter({(0, True): 2, (1, False): 3, (2, False): 2, (5, False): 1, (8, False): 1,
                           (3, False): 1, (4, False): 1, (6, False): 1, (7, True): 1})


def test_empty_tables(make):
    assert align_tokens(make([]), A, B).collect() == []
    assert result(align_tokens(make([(1, None), (2, "")]), A, B)) == [
        (1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")
    ]
