"""Token ids of whole texts by the ``tokenizers`` library, with a memo of pieces.

A byte-level BPE tokenizer first cuts a text by a fixed pattern in which white
space only begins a cut. So a text can be cut before each space or newline that
stands alone (no white space beside it, not the text's last character) and is the
concatenation of pieces that can be encoded on their own. Pieces repeat much more
than texts: a chunk's pieces are dictionary-encoded in Arrow without a copy, each
distinct one is looked up once in the worker's memo, only new ones go to the
library, and the chunk's ids are gathered by numpy offsets. A text with the string
of an added token, and every text of a tokenizer of another form, goes to the
library whole. The ids equal those of ``encode(text, add_special_tokens=False)``
of the library as loaded.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa

from tessella.llm import bytesops as B

MEMO = 500_000  # pieces
STORE = 1 << 23  # ids of pieces
CHUNK = 4 << 20  # bytes of text encoded together
STEP = 1 << 14  # new pieces that the library's model takes together, as its tokens are objects
_WORKER: dict[str, Encoder] = {}
_HEAD = B.table(b" \n")
_MARK = B.table(b",.")
_ASCII_LETTER = B.table(bytes([*range(65, 91), *range(97, 123)]))
#: ASCII letters and the bytes of the two-byte letters from U+00C0 to U+023F.
_LETTERS = _ASCII_LETTER | B.table(bytes([*range(0x80, 0xC0), *range(0xC3, 0xC9)]))
_WHITE = B.table(bytes([*range(9, 14), *range(28, 33)]))
#: Last bytes of the white-space characters outside ASCII, and the bytes before them.
_LAST = B.table(bytes([*range(0x80, 0x8B), 0x85, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]))
_BEFORE_LAST = B.table(bytes([0xC2, 0x9A, 0x80, 0x81]))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _white_after(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a white-space character starts at each position."""
    a = data[at]
    out = _WHITE[a]
    some = np.flatnonzero((a == 0xC2) | (a == 0xE1) | (a == 0xE2) | (a == 0xE3))
    if len(some):
        last = len(data) - 1
        a, b, c = a[some], data[np.minimum(at[some] + 1, last)], data[np.minimum(at[some] + 2, last)]
        out[some] = (
            ((a == 0xC2) & ((b == 0x85) | (b == 0xA0)))
            | ((a == 0xE1) & (b == 0x9A) & (c == 0x80))
            | ((a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)))
            | ((a == 0xE2) & (b == 0x81) & (c == 0x9F))
            | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
        )
    return out


def piece_starts(data: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Where pieces start: texts that are not empty, lone spaces and newlines, a comma or full stop that ends a word."""
    at = np.flatnonzero(_HEAD[data])
    first = np.zeros(len(data) + 1, bool)
    first[o] = True
    at = at[~first[at] & ~first[at + 1]]
    before = data[at - 1]
    white = _WHITE[before]
    some = np.flatnonzero(_LAST[before])  # a needless merge of pieces changes no id
    white[some] |= _BEFORE_LAST[data[np.maximum(at[some] - 2, 0)]]
    at = at[~white]
    first[at[~_white_after(data, at + 1)]] = True
    # Letters end before a mark, whatever follows; only frequent forms are worth a cut.
    at = np.flatnonzero(_MARK[data])
    at = at[(at > 0) & (at + 1 < len(data))]
    at = at[_ASCII_LETTER[data[at - 1]] & _HEAD[data[at + 1]]]
    first[at[~first[at]]] = True
    return np.flatnonzero(first[:-1])


def _direct(data: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Which pieces are letters alone but for a space before, of blocks whose letters are the same in all versions of Unicode in use."""
    fine = _LETTERS[data]
    sign = np.flatnonzero(((data == 0x97) | (data == 0xB7)))  # two signs among the Latin-1 letters
    fine[sign[data[np.maximum(sign - 1, 0)] == 0xC3]] = False
    space = data[cut[:-1]] == 32
    fine[cut[:-1]] |= space
    return np.logical_and.reduceat(fine, cut[:-1]) & (np.diff(cut) > space)


def _grown(x: np.ndarray, used: int, more: int) -> np.ndarray:
    """Room for at least ``more`` behind the first ``used``; what is not yet written takes no memory."""
    out = np.empty(len(x) + max(len(x), more), x.dtype)
    out[:used] = x[:used]
    return out


class Encoder:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        form = json.loads(self.library.to_str())
        cut = form["pre_tokenizer"] or {}
        self.by_pieces = (
            (cut.get("type"), cut.get("use_regex"), cut.get("add_prefix_space")) == ("ByteLevel", True, False)
            and form["normalizer"] is form["post_processor"] is form["truncation"] is form["padding"] is None
            and form["model"].get("type") == "BPE"
            and not form["model"].get("ignore_merges")
            and not form["model"].get("dropout")
        )
        size = self.library.get_vocab_size()
        #: Tokens whose text starts with a space or a newline, in the byte alphabet.
        self.heads = np.array([(self.library.id_to_token(i) or "")[:1] in ("Ġ", "Ċ") for i in range(size)])
        # The byte alphabet: printable Latin-1 characters stand for themselves, the others follow 255.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        letters = [chr(b if b in plain else 256 + rest.index(b)).encode().rjust(2, b"\0") for b in range(256)]
        self.letters = np.frombuffer(b"".join(letters), np.uint8).reshape(256, 2)
        self._clear()

    def _clear(self) -> None:
        #: Piece -> slot; a slot's ids are store[start : start + size].
        self.memo: dict[bytes, int] = {}
        self.start, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.store, self.used = np.zeros(1 << 14, np.uint32), 0

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _in_letters(self, data: np.ndarray, cut: np.ndarray) -> list[str]:
        """Pieces in the byte alphabet."""
        two = self.letters[data]
        size = 1 + (two[:, 0] > 0)
        at = np.append(0, np.cumsum(size))[cut].astype(np.int32)
        flat = two.reshape(-1)
        return pa.Array.from_buffers(pa.string(), len(cut) - 1, [None, pa.py_buffer(at), pa.py_buffer(flat[flat > 0])]).to_pylist()

    def _learn(self, column: pa.Array, pieces: list[bytes]) -> None:
        """Ids of new pieces into the store.

        Letters alone, with or without a space before, are one cut, which the
        library's model takes directly. Other pieces go to the library joined, and are told apart again
        by tokens that start with a space or a newline.
        """
        data, cut = B.buffers(column)
        data, cut = data[cut[0] : cut[-1]], cut - cut[0]
        direct = _direct(data, cut)
        size, parts = np.zeros(len(pieces), np.int64), []
        first = np.flatnonzero(direct)
        if len(first):
            length = np.diff(cut)
            own, at = data[np.repeat(direct, length)], np.append(0, np.cumsum(length[direct]))
            for a in range(0, len(first), STEP):
                some = first[a : a + STEP]
                x, y = at[a], at[a + len(some)]
                got = list(map(self.library.model.tokenize, self._in_letters(own[x:y], at[a : a + len(some) + 1] - x)))
                size[some] = list(map(len, got))
                parts.append(np.array([t.id for x in got for t in x], np.uint32))
        joint, alone = [], []
        for i in np.flatnonzero(~direct).tolist():
            p = pieces[i]
            # White space inside a piece would be taken for the start of another.
            (joint if p[0] in (10, 32) and len(p) > 1 and not (b" " in p[1:] or b"\n" in p[1:]) else alone).append(i)
        order = first.tolist()
        for a in range(0, len(joint), 2000):
            some = joint[a : a + 2000]
            ids = self._whole(b"".join([pieces[i] for i in some]).decode())
            at = np.append(np.flatnonzero(self.heads[ids]), len(ids))
            if len(at) - 1 == len(some):
                size[some] = np.diff(at)
                parts.append(ids)
                order += some
            else:  # a token inside a piece has a head's form, or pieces side by side make an added token
                alone += some
        for i in alone:
            parts.append(self._whole(pieces[i].decode()))
            size[i] = len(parts[-1])
        self._keep(pieces, np.array(order + alone, np.int64), size, np.concatenate(parts))

    def _keep(self, pieces: list[bytes], order: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        """``flat`` has the pieces' ids one after the other in ``order``."""
        n, k = len(self.memo), len(pieces)
        if n + k > len(self.start):
            self.start, self.size = (_grown(x, n, k) for x in (self.start, self.size))
        if self.used + len(flat) > len(self.store):
            self.store = _grown(self.store, self.used, len(flat))
        self.start[n + order] = self.used + np.cumsum(size[order]) - size[order]
        self.size[n : n + k] = size
        self.store[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.memo.update(zip(pieces, range(n, n + k)))

    def _gather(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the slots one after the other, how many each has)."""
        size = self.size[slot]
        at = np.repeat(self.start[slot] - np.cumsum(size) + size, size)
        at += np.arange(len(at))
        return self.store[at], size

    def _by_pieces(self, data: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = piece_starts(data, o)
        cut = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cut), pa.py_buffer(data)]).dictionary_encode()
        column = pieces.dictionary
        words = column.to_pylist()
        slots = np.fromiter(map(self.memo.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(slots < 0)
        if len(new) and (len(self.memo) + len(new) > MEMO or self.used > STORE):
            known = np.flatnonzero(slots >= 0)  # what this chunk has again is worth keeping
            ids, size = self._gather(slots[known])
            self._clear()
            self._keep([words[i] for i in known.tolist()], np.arange(len(known)), size, ids)
            slots[known] = np.arange(len(known))
        if len(new):
            slots[new] = len(self.memo) + np.arange(len(new))
            self._learn(column.take(pa.array(new)), [words[i] for i in new.tolist()])
        ids, size = self._gather(slots[pieces.indices.to_numpy()])
        return ids, np.append(0, np.cumsum(size))[np.searchsorted(starts, o)]

    def ids(self, data: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets from 0) of texts given by their bytes and offsets from 0."""
        n = len(o) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        raw = data.tobytes()
        whole = np.zeros(n, bool) if self.by_pieces else np.ones(n, bool)
        for mark in self.added if self.by_pieces else ():
            at = raw.find(mark)
            while at >= 0:
                whole[np.searchsorted(o, at, "right") - 1] = True
                at = raw.find(mark, at + 1)
        if not whole.any():
            return self._by_pieces(data, o)
        parts, a = [], 0
        while a < n:  # runs of texts of one kind
            b = a + 1 if whole[a] else a + int(np.argmax(np.append(whole[a:], True)))
            part = raw[o[a] : o[b]]
            if whole[a]:
                x = self._whole(part.decode())
                parts.append((x, np.array([0, len(x)])))
            else:
                parts.append(self.ids(np.frombuffer(part, np.uint8), o[a : b + 1] - o[a]))
            a = b
        sizes = np.concatenate([np.diff(x) for _, x in parts])
        return np.concatenate([x for x, _ in parts]), np.append(0, np.cumsum(sizes))

    def column(self, column: pa.Array, end: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, offsets from 0) of chunks of whole texts; ``end`` follows each text; null is empty."""
        for a, b, data, o in B.chunks(column, CHUNK):
            ids, at = self.ids(data, o)
            if end is not None:
                ids = np.insert(ids, at[1:], np.uint32(end))
                at = at + np.arange(len(at))
            yield a, b, ids, at

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null is empty."""
        out = []
        for _, _, ids, at in self.column(pa.array(texts, pa.string())):
            raw = ids.astype("<u4").tobytes()
            out += [raw[4 * x : 4 * y] for x, y in zip(at.tolist(), at[1:].tolist())]
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder, made once a process."""
    if path not in _WORKER:
        _WORKER[path] = Encoder(path)
    return _WORKER[path]
