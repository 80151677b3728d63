"""Exact token ids of whole texts at the price of their distinct words.

Byte-pair encoders work word by word: after a text is cut where the pretokenizer must cut, the ids
of the text are those of its pieces in order. ``Encoder`` cuts Arrow text buffers with numpy, looks
every piece up by its 64-bit hash in a bounded store of pieces that the tokenizers library has
encoded before, and encodes only new ones. Cuts are made only where they can't change the result:

* word vocabularies drop white space, so pieces are cut at ASCII white space; letters that have one
  lower case in any context (ASCII, Latin-1) are lowered before the look-up;
* byte-level vocabularies attach one space to the next word, so of a run of white space before a
  word all but the last character form a piece, and the last joins the word if it's a space;
* both part Latin-1 letters from ASCII digits and punctuation, but for an apostrophe before letters.

Texts that hold the string of a special token, and for byte-level vocabularies those with Unicode
white space beyond ASCII, go to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from . import kernels as K

#: Distinct pieces that a store keeps; at more it starts anew with those of the present batch.
STORE = 1_500_000
#: Letters whose lower case and class need no context: ASCII and the two-byte letters U+00C0-U+00FF.
_ASCII_L = np.zeros(256, bool)
_ASCII_L[65:91] = _ASCII_L[97:123] = True
_SPLIT = np.zeros(256, bool)
_SPLIT[33:127] = True
_SPLIT &= ~_ASCII_L
#: Unicode white space beyond ASCII: U+0085 U+00A0 U+1680 U+2000-200A U+2028 U+2029 U+202F U+205F U+3000.
_WIDE_WS = re.compile("[\u0085   -     　]")


def _byte_map() -> dict[int, str]:
    """Byte-level vocabularies write byte b as this character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_MAP = _byte_map()


class Encoder:
    """encode(column) -> (ids of all rows one after the other, n + 1 offsets)."""

    _made: dict[str, Encoder] = {}

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.byte_level = self.tokenizer.normalizer is None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._fresh()
        self.table = str.maketrans({chr(b): c for b, c in _MAP.items() if b != 10})

    def _fresh(self) -> None:
        self.key = np.zeros(0, K.U64)
        self.at = np.zeros(0, np.int64)
        self.len = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encode_new(self, raw: bytes, start: np.ndarray, end: np.ndarray, plain: np.ndarray) -> list[list[int]]:
        """Ids of new pieces. plain: those of letters only, with a space before them at most."""
        cut = [raw[s:e] for s, e in zip(start.tolist(), end.tolist())]
        letters = np.flatnonzero(plain).tolist()
        out: list[list[int]] = [[]] * len(cut)
        tokenize = self.tokenizer.model.tokenize
        mapped = b"\n".join([cut[i] for i in letters]).decode("latin-1").translate(self.table).split("\n")
        for i, piece in zip(letters, mapped):
            out[i] = [t.id for t in tokenize(piece)]
        for i in np.flatnonzero(~plain).tolist():
            out[i] = self.whole(cut[i].decode())
        return out

    def _spans(self, b: np.ndarray, o: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(b):
            z = np.zeros(0, np.int64)
            return z, z
        row_start = np.zeros(len(b) + 1, bool)
        row_start[o] = True
        solid = ~K.WS[b]
        split = _SPLIT[b]
        # A cut before byte i within a word: a letter meets ASCII digits or punctuation.
        cut = (letter[:-1] & split[1:]) | (split[:-1] & (b[:-1] != 0x27) & letter[1:])
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1] | row_start[1:-1] | cut
        last[:-1] &= ~solid[1:] | row_start[1:-1] | cut
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not self.byte_level:
            return start, end
        joins = (start > 0) & ~row_start[start] & (b[np.maximum(start - 1, 0)] == 0x20)
        ws = ~solid
        first, last = ws.copy(), ws.copy()
        first[1:] &= solid[:-1] | row_start[1:-1]
        last[:-1] &= solid[1:] | row_start[1:-1]
        gs, ge = np.flatnonzero(first), np.flatnonzero(last) + 1
        followed = ~row_start[ge]
        tail = ge - 1
        own_tail = followed & (b[tail] != 0x20)  # the last character before a word stands alone
        body_end = np.where(followed, tail, ge)
        keep = body_end > gs
        s = np.concatenate([start - joins, gs[keep], tail[own_tail]])
        e = np.concatenate([end, body_end[keep], ge[own_tail]])
        order = np.argsort(s, kind="stable")
        return s[order], e[order]

    def _letters(self, b: np.ndarray) -> np.ndarray:
        """Bytes of ASCII letters and of whole two-byte letters led by 0xC3 (not U+00D7, U+00F7)."""
        letter = _ASCII_L[b]
        lead = np.flatnonzero(b[:-1] == 0xC3) if len(b) else np.zeros(0, np.int64)
        lead = lead[(b[lead + 1] != 0x97) & (b[lead + 1] != 0xB7)]
        letter[lead] = letter[lead + 1] = True
        return letter

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, at = K.texts(column)
        ids, counts = [], []
        for lo, hi in K.slices(at):
            i, c = self._run(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            ids.append(i)
            counts.append(c)
        out = np.zeros(len(at), np.int64)
        if counts:
            np.cumsum(np.concatenate(counts), out=out[1:])
        return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)), out

    def _run(self, b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        odd = self._odd_rows(b.tobytes(), o)
        letter = self._letters(b)
        source = b
        if not self.byte_level:
            b = K.LOWER[b]
            upper = np.flatnonzero(letter & (b >= 0x80) & (b < 0x9F))
            b[upper] += 0x20
        raw = b.tobytes()
        start, end = self._spans(b, o, letter)
        total = np.zeros(len(b) + 1, np.int64)
        np.cumsum(letter, out=total[1:])
        h = K.RangeHash(b).of(start, end) ^ (end - start).astype(K.U64)
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        s, e = start[first], end[first]
        plain = total[e] - total[s] + (b[s] == 0x20) == e - s
        where = self._lookup(distinct, s, e, raw, plain & (total[e] > total[s]))
        at, n = self.at[where][inverse], self.len[where][inverse]
        ids = self.pool[K.ragged(at, n)]
        row = np.searchsorted(o, start, "right") - 1
        counts = np.bincount(row, weights=n, minlength=len(o) - 1).astype(np.int64)
        if odd:
            cut = np.concatenate([[0], np.cumsum(counts)])
            rows = [ids[cut[i] : cut[i + 1]] for i in range(len(o) - 1)]
            for i in odd:
                rows[i] = np.array(self.whole(source[o[i] : o[i + 1]].tobytes().decode()), np.uint32)
                counts[i] = len(rows[i])
            ids = np.concatenate(rows)
        return ids, counts

    def _is_odd(self, text: str) -> bool:
        return any(x in text for x in self.special) or self.byte_level and _WIDE_WS.search(text) is not None

    def _odd_rows(self, raw: bytes, o: np.ndarray) -> list[int]:
        if not self._is_odd(raw.decode()):
            return []
        return [i for i in range(len(o) - 1) if self._is_odd(raw[o[i] : o[i + 1]].decode())]

    def _lookup(self, h: np.ndarray, start: np.ndarray, end: np.ndarray, raw: bytes, plain: np.ndarray) -> np.ndarray:
        """Places in the store of sorted distinct hashes; new pieces are encoded and stored."""
        if len(self.key) + len(h) > STORE and len(self.key):
            self._fresh()
        i = np.minimum(np.searchsorted(self.key, h), max(0, len(self.key) - 1))
        known = self.key[i] == h if len(self.key) else np.zeros(len(h), bool)
        new = np.flatnonzero(~known)
        if len(new):
            made = self._encode_new(raw, start[new], end[new], plain[new])
            n = np.fromiter(map(len, made), np.int64, len(made))
            at = np.concatenate([[0], np.cumsum(n)[:-1]]) + len(self.pool)
            self.pool = np.concatenate([self.pool, np.fromiter((x for m in made for x in m), np.uint32, int(n.sum()))])
            key = np.concatenate([self.key, h[new]])
            order = np.argsort(key, kind="stable")
            self.key, self.at, self.len = key[order], np.concatenate([self.at, at])[order], np.concatenate([self.len, n])[order]
            i = np.searchsorted(self.key, h)
        return i
