"""SentencePiece encoding and decoding with an Aho-Corasick automaton.

The automaton over all pieces reads a chunk once; at each position its output
links name the pieces that end there, longest first, and each relaxes the best
segmentation of the text up to that position.

What is best depends on the model. A unigram model adds piece scores (Viterbi).
In a BPE model scores are merge priorities, whose sums don't give the merges'
result; there a piece may end a segmentation only if it stays beside the piece
before it, that is if the merges of the two together give just these two. One
piece at each position does, so the pass gives the same ids as merging, in
linear time. Characters without a piece become bytes.

No piece goes on over a space after another character, so texts are cut before
spaces, and only distinct chunks are encoded. Chunks are told apart by 64-bit
hashes; a bounded store of them lives as long as the Python worker. Models with
the identity normaliser and a dummy prefix are supported.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_ids import BpeIds
from .common import arrow_batches, columns_only, slices, span_hashes, text_buffer, vocabulary, word_spans

SPACE = "▁"
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[0x20] = False
STORE_PAIRS = 1_000_000
_MODELS: dict[tuple[str, str], "PieceIds"] = {}


def model(path: str, kind: str = "bpe") -> "PieceIds":
    """The one of this process."""
    if (path, kind) not in _MODELS:
        _MODELS[path, kind] = PieceIds(path, kind)
    return _MODELS[path, kind]


class PieceIds(BpeIds):
    def __init__(self, path: str, kind: str = "bpe"):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        if kind not in ("bpe", "unigram"):
            raise ValueError(kind)
        sp = SentencePieceProcessor(model_file=vocabulary(path))  # read for its pieces and scores only
        self.kind, self.size = kind, sp.get_piece_size()
        self.unk = sp.unk_id()
        self.piece_ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.byte_ids = [self.unk] * 256
        self.raw: list[bytes] = []
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            self.scores.append(sp.get_score(i))
            if sp.is_byte(i):
                b = int(piece[3:5], 16)
                self.byte_ids[b] = i
                self.raw.append(bytes([b]))
            elif sp.is_control(i):
                self.raw.append(b"")
            elif sp.is_unknown(i):
                self.raw.append(" ⁇ ".encode())
            else:
                self.raw.append(piece.replace(SPACE, " ").encode())
                if not sp.is_unused(i):
                    self.piece_ids[piece] = i
        inner = [p for p in self.piece_ids if SPACE in p[1:] and p.strip(SPACE)]
        if inner:
            raise ValueError("pieces that go on over a space aren't supported")
        self.low = min(self.scores) - 10
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.piece_ids.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.text_of = {i: p for p, i in self.piece_ids.items()}
        self.beside: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.spines: dict[int, tuple | None] = {}
        sizes = np.array([len(r) for r in self.raw], np.int64)
        self.raw_begin, self.raw_size = np.cumsum(sizes) - sizes, sizes
        self.raw_pool = np.frombuffer(b"".join(self.raw), np.uint8)
        self.runs: dict[int, list[int]] = {}
        self._empty()

    # ------------------------------------------------------------ segmentation

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: the adjacent pair with the best score is merged, of equal ones the leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = self.piece_ids.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.scores[piece] > best):
                    best, at = self.scores[piece], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _spines(self, i: int) -> tuple[list[tuple[float, str]], list[tuple[float, str]]] | None:
        """How a piece grows: the strings at its right end and at its left end, each with the rank of the merge that makes it.
        None if merges don't come in the order of their ranks."""
        if i in self.spines:
            return self.spines[i]
        parts = [(c, -1e30, [(-1e30, c)], [(-1e30, c)]) for c in self.text_of[i]]
        ordered = True
        while len(parts) > 1:
            ranks = [(-self.scores[p], k) for k in range(len(parts) - 1) if (p := self.piece_ids.get(parts[k][0] + parts[k + 1][0])) is not None]
            if not ranks:
                break
            rank, k = min(ranks)
            (a, ra, _, left), (b, rb, right, _) = parts[k], parts[k + 1]
            ordered &= rank > max(ra, rb)
            parts[k : k + 2] = [(a + b, rank, [*right, (rank, a + b)], [*left, (rank, a + b)])]
        got = self.spines[i] = (parts[0][2], parts[0][3]) if ordered and len(parts) == 1 else None
        return got

    def _stays(self, left: int, right: int) -> bool:
        """Whether the merges of two pieces' characters give the two pieces again."""
        key = left * self.size + right
        got = self.beside.get(key)
        if got is None:
            if len(self.beside) >= STORE_PAIRS:
                self.beside.clear()
            one, two = self._spines(left), self._spines(right)
            if one is None or two is None:
                a, b = self.text_of[left], self.text_of[right]
                got = self.merged(a + b) == [a, b]
            else:
                got = self._apart(one[0], two[1])
            self.beside[key] = got
        return got

    def _apart(self, a: list[tuple[float, str]], b: list[tuple[float, str]]) -> bool:
        """Both sides grow in the order of ranks; a merge over the border must never be the next one."""
        i = j = 0
        while True:
            piece = self.piece_ids.get(a[i][1] + b[j][1])
            over = float("inf") if piece is None else -self.scores[piece]
            next_a = a[i + 1][0] if i + 1 < len(a) else float("inf")
            next_b = b[j + 1][0] if j + 1 < len(b) else float("inf")
            if over < next_a and over <= next_b:  # of equal ranks the leftmost is first
                return False
            if next_a == next_b == float("inf"):
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def _stands(self, i: int) -> bool:
        got = self.alone.get(i)
        if got is None:
            got = self.alone[i] = self._spines(i) is not None or self.merged(self.text_of[i]) == [self.text_of[i]]
        return got

    def segment(self, chunk: str) -> list[int]:
        """Ids of a chunk in which a space, if any, is the first character."""
        n = len(chunk)
        last = [-1] * (n + 1)  # the piece that ends the best segmentation up to here; -1: bytes
        back = list(range(-1, n))
        score = [0.0] + [-1e30] * n
        unigram = self.kind == "unigram"
        done = 0

        def close(upto: int) -> None:  # positions where no piece ends take a character as bytes
            nonlocal done
            for e in range(done + 1, upto + 1):
                if unigram and score[e] <= -1e30:
                    score[e], back[e], last[e] = score[e - 1] + self.low, e - 1, -1
            done = max(done, upto)

        for end, (size, i) in self.automaton.iter(chunk):
            e, s = end + 1, end + 1 - size
            if unigram:
                close(end)
                if score[s] + self.scores[i] > score[e]:
                    score[e], back[e], last[e] = score[s] + self.scores[i], s, i
            elif last[e] < 0 and (self._stays(last[s], i) if last[s] >= 0 else self._stands(i)):
                last[e], back[e] = i, s
        close(n)
        out: list[int] = []
        e = n
        while e:
            s = back[e]
            out.extend([last[e]] if last[e] >= 0 else [self.byte_ids[b] for b in reversed(chunk[s:e].encode())])
            e = s
        return out[::-1]

    def space_run(self, n: int) -> list[int]:
        """Ids of n spaces that no other character joins."""
        got = self.runs.get(n)
        if got is None:
            longest = max((len(p) for p in self.piece_ids if not p.strip(SPACE)), default=1)
            over = max(0, n - 4 * longest) // longest
            parts = self.merged(SPACE * (n - over * longest))
            got = self.runs[n] = [self.piece_ids[SPACE * longest]] * over + [self.piece_ids[p] for p in parts]
        return got

    def chunk(self, spaces: int, word: str) -> list[int]:
        """Ids of some spaces and the characters up to the next space."""
        if not word:
            return self.space_run(spaces)
        ids = self.segment(SPACE + word) if spaces else self.segment(word)
        if spaces < 2:
            return ids
        if self.kind == "bpe" and ids[0] == self.piece_ids.get(SPACE):
            return self.space_run(spaces) + ids[1:]
        return self.space_run(spaces - 1) + ids

    def text(self, text: str) -> list[int]:
        """Ids of a text, chunk by chunk."""
        if not text:
            return []
        out: list[int] = []
        spaces, word = 1, []
        for c in text:
            if c in (" ", SPACE):
                if word:
                    out += self.chunk(spaces, "".join(word))
                    spaces, word = 0, []
                spaces += 1
            else:
                word.append(c)
        return out + self.chunk(spaces, "".join(word))

    # ------------------------------------------------------------ columns

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows after each other, and the number of ids of each row."""
        data, offs = text_buffer(col)
        rows = len(offs) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(rows, np.int64)
        # the space's own mark in a text is a space
        mark = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81) if len(data) > 2 else np.zeros(0, bool)
        if mark.any():
            return super_plain(self, col, rows)
        starts, ends, first = word_spans(data, offs, NOT_SPACE)
        of_row = np.searchsorted(offs, starts, "right") - 1
        before = np.concatenate([[0], ends[:-1]])
        heads = np.zeros(len(starts), bool)
        heads[first[:-1][np.diff(first) > 0]] = True
        gap = np.where(heads, starts - offs[of_row] + 1, starts - before)
        # spaces at the end of a row, and rows of nothing else
        full = np.diff(offs) > 0
        some = np.diff(first) > 0
        tail = np.where(some, offs[1:] - np.concatenate([ends, [0]])[np.maximum(first[1:] - 1, 0)], np.where(full, np.diff(offs) + 1, 0))
        rows_t = np.flatnonzero(tail)
        place = np.insert(of_row, first[rows_t + 1], rows_t)
        starts, ends = np.insert(starts, first[rows_t + 1], 0), np.insert(ends, first[rows_t + 1], 0)
        gap = np.insert(gap, first[rows_t + 1], tail[rows_t])
        hashes = span_hashes(data, starts, ends) ^ (gap.astype(np.uint64) - np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        keys, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        begin, count, pool = self._look_up(data, starts[at], ends[at], gap[at], keys)
        n = count[which]
        ids = pool[np.repeat(begin[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return ids, np.bincount(place, n, rows).astype(np.int64)

    def _encode_chunks(self, data, starts, ends, gap):  # noqa: ANN001, ANN202
        got = [self.chunk(g, data[a:b].tobytes().decode()) for a, b, g in zip(starts.tolist(), ends.tolist(), gap.tolist(), strict=True)]
        return np.array([i for x in got for i in x], np.int32), np.array([len(x) for x in got], np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all rows after each other, and the number of bytes of each: pieces joined, without the dummy prefix.
        Byte pieces are put back as they are."""
        n = self.raw_size[ids]
        out = self.raw_pool[np.repeat(self.raw_begin[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        end = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])]
        full = np.flatnonzero(np.diff(end) > 0)
        heads = full[out[end[full]] == 0x20]
        size = np.diff(end)
        size[heads] -= 1
        return np.delete(out, end[heads]), size


def super_plain(pieces: PieceIds, col: pa.Array, rows: int) -> tuple[np.ndarray, np.ndarray]:
    got = [pieces.text(t or "") for t in col.to_pylist()]
    return np.array([i for x in got for i in x], np.int32), np.array([len(x) for x in got], np.int64)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", kind: str = "bpe", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: the id, the columns in keep, and ids (array of piece ids of the whole text).

    Defined results: null and empty texts have no ids; a null id is kept; repeated rows are rows of their own; an empty table
    gives an empty result; further columns are ignored.
    """
    return _mapped(docs, model_path, id_col, text_col, kind, keep, False)


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", kind: str = "bpe") -> DataFrame:
    """encode(), and decode() of the result: doc_id, n_ids, ids_crc32 (of little-endian 32-bit ids), n_bytes and
    decoded_crc32 (of the decoded text in UTF-8), exact (it is the text again)."""
    return _mapped(docs, model_path, id_col, text_col, kind, (), True)


def _mapped(docs: DataFrame, model_path: str, id_col: str, text_col: str, kind: str, keep: tuple[str, ...], digest: bool) -> DataFrame:
    arrow_batches(docs.sparkSession)
    src = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([id_col, text_col, *keep])))
    out = [f for f in src.schema.fields if f.name == id_col or f.name in keep]
    more = "n_ids bigint, ids_crc32 bigint, n_bytes bigint, decoded_crc32 bigint, exact boolean" if digest else "ids array<int>"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out), more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(model_path, kind)
        for b in slices(batches, text_col):
            ids, n = pieces.encode(b.column(text_col))
            at = np.concatenate([[0], np.cumsum(n)])
            cols = [b.column(f.name) for f in out]
            if digest:
                text, size = pieces.decode(ids, n)
                end = np.concatenate([[0], np.cumsum(size)])
                data, offs = text_buffer(b.column(text_col))
                raw, back, orig = memoryview(np.ascontiguousarray(ids, "<u4")), memoryview(text), memoryview(np.ascontiguousarray(data))
                same = [back[i:j] == orig[k:m] for i, j, k, m in zip(end[:-1], end[1:], offs[:-1], offs[1:], strict=True)]
                crc = lambda view, ends: pa.array([zlib.crc32(view[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.int64())
                cols += [pa.array(n), crc(raw, at), pa.array(size), crc(back, end), pa.array(same)]
                names = ["n_ids", "ids_crc32", "n_bytes", "decoded_crc32", "exact"]
            else:
                cols.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids)))
                names = ["ids"]
            yield pa.RecordBatch.from_arrays(cols, [*(f.name for f in out), *names])

    return src.mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids", kind: str = "bpe") -> DataFrame:
    """One row for each row of encoded: the id and the text that its ids stand for (broken UTF-8 becomes U+FFFD)."""
    arrow_batches(encoded.sparkSession)
    src = columns_only(encoded, **{id_col: "bigint", ids_col: "array<int>"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(model_path, kind)
        for b in batches:
            lists = [np.asarray(x.values if x.is_valid else [], np.int64) for x in b.column(ids_col)]
            text, size = pieces.decode(np.concatenate(lists) if lists else np.zeros(0, np.int64), np.array([len(x) for x in lists], np.int64))
            end = np.concatenate([[0], np.cumsum(size)])
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array([text[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(end[:-1], end[1:], strict=True)], pa.string())], [id_col, "text"])

    return src.mapInArrow(run, f"`{id_col}` bigint, text string")
