import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from raggedly.llm import codes
from raggedly.llm.packing import fullest, pack_documents, plan_bins
from raggedly.llm.tokens import Encoder
from raggedly.session import fresh_folder

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a \n b", "a\n\nb c", "a\n b\t c", "It's they'll 's 'x ",
    "x\x00y z", "nb sp ace  x", "x 　y", "é é ́x ΑΣ ΣΑ İ ǅ ﬁ", "<|endoftext|> a <|endoftext|>",
    "a<|endoftext|>", "x<|startoftext|>y  <|ENDOFTEXT|> <|endoftext|>z w", " <|startoftext|> ", "<|endoftext",
    "A1b2 C33 4d --==-- ... !!", "The the THE\n\tthe\x0bthe\x0cthe\rthe\x1cthe\x85the", "long word " * 4000, "y" * 9000, "日本 語 テキスト",
]


def reference(path, end, plain=False):
    t = Tokenizer.from_file(path)
    if plain:
        t.encode_special_tokens = True
    return [[*e.ids, end] for e in t.encode_batch(TEXTS, add_special_tokens=False)]


@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize("path, cut", [(BYTES, "space"), (WORDS, "words")])
def test_pieces_give_the_ids_of_whole_texts(path, cut, plain):
    enc = Encoder(path, cut, plain)
    for _ in range(2):  # the second time from memory
        ids, counts = enc.encode(pa.array(TEXTS), 2)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == reference(path, 2, plain)
    ids, counts = enc.encode(pa.array([], pa.string()), 2)
    assert len(ids) == len(counts) == 0


@pytest.mark.parametrize("top", [1, 2, 255, 256, 70_000, 2**32])
def test_codes_round_trip_and_random_access(top):
    rng = np.random.default_rng(top)
    for n in (0, 1, 7, 511, 512, 513, 5000):
        ids = rng.integers(0, top, n).astype(np.uint32)
        levels = codes.encode(ids)
        assert (codes.between(levels, 0, n) == ids).all()
        where = rng.integers(0, n, 200) if n else np.zeros(0, int)
        assert (codes.at(levels, where) == ids[where]).all()
        for a, b in ((n // 3, n // 2), (n // 2, n)):
            assert (codes.between(levels, a, b) == ids[a:b]).all()


def test_file_round_trip(spark, make):
    want = reference(BYTES, 2)
    rows = [(1000 - 7 * i, t) for i, t in enumerate(TEXTS)] + [(None, None), (3, "a"), (3, "a"), (3, "b c")]
    path = fresh_folder(spark, "codes")
    codes.write_codes(make(rows), path, BYTES, 2)
    got = codes.read_documents(spark, path).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(rows) and len(by_id[3]) == 3
    whole = []
    for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id, r.start)):
        assert r.start == len(whole)
        if r.doc_id is not None and r.doc_id != 3:
            ids = want[(1000 - r.doc_id) // 7]
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            whole += ids
        else:
            whole += [None] * r.n_tokens
    asked = [i for i in range(0, len(whole), 97) if whole[i] is not None]
    frame = spark.createDataFrame([(i,) for i in [*asked, len(whole) + 5]], "position long")
    tokens = {r.position: r.id for r in codes.read_tokens(spark, path, frame).collect()}
    assert tokens == {i: whole[i] for i in asked}


def test_empty_corpus(spark, make):
    path = fresh_folder(spark, "codes")
    codes.write_codes(make([]), path, BYTES, 2)
    assert codes.read_documents(spark, path).collect() == []
    assert pack_documents(make([]), WORDS, 0).collect() == []


def test_fullest_against_all_subsets():
    rng = np.random.default_rng(5)
    for _ in range(200):
        lengths = rng.integers(1, 30, rng.integers(0, 9)).tolist()
        counts = {n: lengths.count(n) for n in lengths}
        room = int(rng.integers(0, 60))
        sums = {0}
        for n in lengths:
            sums |= {s + n for s in sums if s + n <= room}
        taken = fullest(counts, room)
        assert all(c <= counts[n] for n, c in taken.items())
        assert sum(n * c for n, c in taken.items()) == max(sums)


def test_plan_uses_every_piece_and_is_close_to_the_bound():
    counts = {int(n): int(c) for n, c in zip(range(1, 2049), 5000 * np.exp(-np.arange(2048) / 400))}
    counts[2048] = 3000
    plan = plan_bins(counts)
    used = dict.fromkeys(counts, 0)
    for times, bin_ in plan:
        assert 0 < sum(n * c for n, c in bin_.items()) <= 2048
        for n, c in bin_.items():
            used[n] += times * c
    assert used == counts and len(plan) < 4 * 2048
    bound = -(-sum(n * c for n, c in counts.items()) // 2048)
    assert sum(t for t, _ in plan) <= bound * 1.001 + 1


def test_pack_documents(make):
    want = reference(WORDS, 0)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(99, None), (5, "a"), (5, "a"), (None, "b")]
    rows += [(1000 + i, "w " * (i % 40)) for i in range(600)]
    out = pack_documents(make(rows), WORDS, 0, with_ids=True).collect()
    bins, docs = {}, {}
    for r in out:
        assert 1 <= r.length <= 2048 and r.length == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append(r)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    for i in range(len(TEXTS)):
        if i != 5:
            mine = sorted(docs[i], key=lambda r: r.piece)
            assert [r.start for r in mine] == [2048 * k for k in range(len(mine))]
            assert sum((r.ids for r in mine), []) == want[i]
            assert all(r.length == 2048 for r in mine[:-1])
    assert len(docs[5]) == 3 and [r.length for r in docs[99]] == [1] and len(docs[None]) == 1
    assert len(bins) == -(-sum(r.length for r in out) // 2048)
