"""Token ids of whole texts; every distinct piece of text is encoded once.

A text is cut where the tokenizer's own pre-tokenizer always cuts, so the ids of the
pieces, one after another, are the ids of the text.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .tables import split_words, starts_of

#: Pieces whose ids a worker remembers. A bound of memory; the ids don't depend on it.
REMEMBERED = 500_000
#: Text of one slice; the larger, the fewer pieces are looked up again.
SLICE_BYTES = 8 << 20
#: A space before more white space: there a byte-level text isn't cut, so it is encoded whole.
UNSAFE = r" [\s\x0b\x{85}\p{Z}]|\x00"

_encoders: dict[tuple[str, str, bool], Encoder] = {}


class Encoder:
    """``cut``: ``space`` (before a space and a character that is not white space; byte-level
    pieces keep the space) or ``words`` (at ASCII white space, which the tokenizer drops).

    A special token's string in a text is that token, as the library has it by default; with
    ``plain`` it is ordinary text. Texts with such a string are encoded whole."""

    def __init__(self, path: str, cut: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.cut, self.known = cut, {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, each text's followed by ``end``, and their numbers."""
        whole = self._with_special(texts)
        if self.cut == "words":
            pieces, counts = self._words(texts, whole)
        else:
            pieces, counts = self._spaced(texts, whole)
        coded = pieces.dictionary_encode()
        table, lengths = self._table(coded.dictionary.to_pylist())
        # The end of a text is one more piece, with one id of its own.
        stops = np.cumsum(counts + 1)
        at = np.full(int(stops[-1]) if len(stops) else 0, len(lengths), np.int32)
        inner = np.ones(len(at), bool)
        inner[stops - 1] = False
        at[inner] = coded.indices.to_numpy(zero_copy_only=False)
        table, lengths = np.append(table, np.uint32(end)), np.append(lengths, 1)
        sizes = lengths[at]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        # The table and a slice of texts are small, so places need 32 bits.
        places = np.repeat((starts_of(lengths)[at] - bounds[:-1]).astype(np.int32), sizes)
        places += np.arange(bounds[-1], dtype=np.int32)
        return table[places], np.diff(bounds[stops], prepend=0)

    def _with_special(self, texts: pa.Array) -> np.ndarray:
        """Texts with the string of a special token; most have not even what all of them share."""
        none = np.zeros(len(texts), bool)
        if not self.special:
            return none
        rough = pc.match_substring(texts, os.path.commonprefix(self.special))
        near = texts.filter(rough)
        found = np.zeros(len(near), bool)
        for content in self.special:
            found |= pc.match_substring(near, content).to_numpy(zero_copy_only=False)
        none[np.flatnonzero(rough.to_numpy(zero_copy_only=False))[found]] = True
        return none

    def _words(self, texts: pa.Array, whole: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        if not whole.any():
            return split_words(texts)
        rest = pc.if_else(pa.array(whole), pa.scalar("", texts.type), texts)
        pieces, counts = split_words(rest)
        places = np.insert(
            np.arange(len(pieces)), starts_of(counts)[whole], len(pieces) + np.arange(whole.sum())
        )
        counts[whole] = 1
        return pa.concat_arrays([pieces, texts.filter(pa.array(whole))]).take(pa.array(places)), counts

    def _spaced(self, texts: pa.Array, whole: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        unsafe = pc.or_(pc.match_substring_regex(texts, UNSAFE), pa.array(whole))
        marked = pc.replace_substring(texts, " ", "\x00 ")
        # Letters or digits end before a sign in any case; so words meet again without it.
        marked = pc.replace_substring_regex(marked, r"([\p{L}\p{N}])([.,])", "\\1\x00\\2")
        lists = pc.split_pattern(pc.if_else(unsafe, pa.scalar("", texts.type), marked), "\x00")
        pieces = lists.flatten()
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        if pc.any(unsafe).as_py():  # a text of one piece, in the place of its empty one
            mask = np.zeros(len(pieces), bool)
            mask[starts_of(counts)[unsafe.to_numpy(zero_copy_only=False)]] = True
            pieces = pc.replace_with_mask(pieces, pa.array(mask), texts.filter(unsafe))
        return pieces, counts

    def _table(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        known = self.known
        found = [known.get(p) for p in pieces]
        new = [i for i, ids in enumerate(found) if ids is None]
        encoded = self.tokenizer.encode_batch_fast(
            [pieces[i] for i in new], add_special_tokens=False
        )
        for i, e in zip(new, encoded):
            found[i] = ids = array("I", e.ids).tobytes()
            if len(known) < REMEMBERED and len(pieces[i]) < 64:
                known[pieces[i]] = ids
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), np.uint32), lengths


def encoder(path: str, cut: str, plain: bool = False) -> Encoder:
    """One encoder for each worker process."""
    key = path, cut, plain
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]
