"""Byte-level BPE ids of whole Arrow text columns, with the tokenizers library.

A single space between two other characters always begins a new pre-token, so
texts can be cut there without changing their ids. Only distinct chunks are
given to the library, joined to long strings; their ids are put back by byte
lengths. A bounded store of chunks lives as long as the Python worker.
Chunks are told apart by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .common import span_hashes, text_buffer, vocabulary

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
STORE_CHUNKS = 600_000
PIECE_BYTES = 32_768
_TOKENIZERS: dict[tuple[str, bool], "BpeIds"] = {}


def tokenizer(path: str, plain: bool = False) -> "BpeIds":
    """The one of this process. plain: special tokens' strings are ordinary text."""
    if (path, plain) not in _TOKENIZERS:
        _TOKENIZERS[path, plain] = BpeIds(path, plain)
    return _TOKENIZERS[path, plain]


class BpeIds:
    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(vocabulary(path))
        self.tok.encode_special_tokens = plain
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        # in byte-level vocabularies a character stands for a byte
        self.bytes_of = np.zeros(self.size, np.int64)
        for piece, i in vocab.items():
            self.bytes_of[i] = len(piece)
        self._empty()

    def _empty(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin = self.count = np.zeros(0, np.int64)
        self.pool = [np.zeros(0, np.int32)]
        self.pooled = 0

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows after each other, and the number of ids of each row."""
        data, offs = text_buffer(col)
        n_rows = len(offs) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n_rows, np.int64)
        starts, regular = chunk_starts(data, offs)
        ends = np.append(starts[1:], len(data))
        # rows are contiguous, so a chunk ends where the next one begins
        keys, first, which = np.unique(span_hashes(data, starts, ends) ^ regular.astype(np.uint64), return_index=True, return_inverse=True)
        begin, count, pool = self._look_up(data, starts[first], ends[first], regular[first], keys)
        n = count[which]
        total = int(n.sum())
        ids = pool[np.repeat(begin[which] - (np.cumsum(n) - n), n) + np.arange(total)]
        at = np.concatenate([[0], np.cumsum(n)])
        of_row = np.searchsorted(starts, offs)
        return ids, np.diff(at[of_row])

    def _look_up(self, data, starts, ends, regular, keys):  # noqa: ANN001, ANN202
        if len(self.keys) > STORE_CHUNKS:
            self._empty()
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        new = np.flatnonzero(~known)
        if len(new):
            ids, count = self._encode_chunks(data, starts[new], ends[new], regular[new])
            begin = self.pooled + np.cumsum(count) - count
            self.pool = [np.concatenate([*self.pool, ids])]
            self.pooled += len(ids)
            spot = np.searchsorted(self.keys, keys[new])
            self.keys, self.begin, self.count = (np.insert(a, spot, b) for a, b in ((self.keys, keys[new]), (self.begin, begin), (self.count, count)))
            at = np.searchsorted(self.keys, keys)
        return self.begin[at], self.count[at], self.pool[0]

    def _encode_chunks(self, data, starts, ends, regular):  # noqa: ANN001, ANN202
        """Ids of the chunks after each other, and each one's number of ids."""
        size = ends - starts
        count = np.zeros(len(starts), np.int64)
        got: list[tuple[np.ndarray, np.ndarray]] = []
        joined = np.flatnonzero(regular)
        if len(joined):
            n = size[joined]
            flat = data[np.repeat(starts[joined] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            edge = np.cumsum(n)
            cuts = np.unique(np.append(np.searchsorted(edge, np.arange(PIECE_BYTES, edge[-1], PIECE_BYTES)), len(joined) - 1))
            stops = edge[cuts]
            pieces = [flat[a:b].tobytes().decode() for a, b in zip(np.append(0, stops[:-1]), stops, strict=True)]
            ids = np.concatenate([np.array(e.ids, np.int32) for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)])
            at = np.searchsorted(np.cumsum(self.bytes_of[ids]), edge, "left") + 1
            count[joined] = np.diff(at, prepend=0)
            got.append((joined, ids))
        alone = np.flatnonzero(~regular)
        if len(alone):
            enc = self.tok.encode_batch_fast([data[starts[i] : ends[i]].tobytes().decode() for i in alone], add_special_tokens=False)
            count[alone] = [len(e.ids) for e in enc]
            got.append((alone, np.concatenate([np.array(e.ids, np.int32) for e in enc])))
        out = np.empty(count.sum(), np.int32)
        begin = np.cumsum(count) - count
        for own, ids in got:
            n = count[own]
            out[np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = ids
        return out, count


def chunk_starts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks begin: at each row's start and at single spaces between other characters. regular: the chunk begins
    with such a space and ends before another, or in a visible ASCII character, so it can be joined to others of the kind."""
    pad = np.concatenate([np.zeros(3, np.uint8), data, np.zeros(1, np.uint8)])
    lead = (pad == 0xC2) | ((pad >= 0xE1) & (pad <= 0xE3))  # of the characters beyond ASCII that can be white space
    solid = pad > 0x20
    before = solid[2:-2] & ~((pad[2:-2] >= 0x80) & (lead[1:-3] | lead[:-4]))
    cut = (data == 0x20) & before & solid[4:] & ~lead[4:]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    cut &= ~(edge[:-1] | edge[1:])  # neither a row's first nor its last byte
    rows = offs[:-1][np.diff(offs) > 0]
    begins = cut.copy()
    begins[rows] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(data))
    last = data[ends - 1]
    closed = np.append(cut[starts[1:]], False) | ((last > 0x20) & (last < 0x7F))
    return starts, cut[starts] & closed
