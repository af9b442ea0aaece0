"""op8's blocks: decoding from any checkpoint, damage, large vocabularies, order and repeats."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from test_contracts import A, frame

from maskwright.llm import queries as llm
from maskwright.llm.rans_store import EVERY, Block, Frequencies, encode_block, read_files, write_files


def block_of(ids: np.ndarray) -> tuple[bytes, Frequencies]:
    table = Frequencies.of(ids)
    return encode_block(np.array([7]), np.array([len(ids)]), ids, table), table


@pytest.mark.parametrize("n", [1, 2, 127, 128, 5000, 300_000])
def test_parts_decode_in_any_order(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 50_000).astype(np.int64)
    raw, table = block_of(ids)
    block = Block(raw, Frequencies.unpacked(table.packed()))
    order = list(range(len(block.places)))
    random.Random(1).shuffle(order)
    parts = {i: block.part(i) for i in order}
    assert np.array_equal(np.concatenate([parts[i] for i in range(len(parts))]), ids)
    step = EVERY * block.lanes
    assert all(np.array_equal(parts[i], ids[i * step : (i + 1) * step]) for i in parts)
    assert len(raw) < 4 * n + 200 + 8 * block.lanes * len(order) + 50


def test_damage_is_found():
    raw, table = block_of(np.arange(3000) % 77)
    for at in (0, 4, 9, 60, len(raw) // 2, len(raw) - 1):
        bad = bytearray(raw)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            Block(bytes(bad), table).ids()
    wrong = Frequencies.of(np.arange(3000) % 78)  # a table that isn't the file's
    with pytest.raises((ValueError, IndexError)):
        Block(raw, wrong).ids()


def test_more_ids_than_the_usual_scale_holds():
    ids = np.random.default_rng(0).permutation(600_000)
    raw, table = block_of(ids)
    assert table.scale == 21 and np.array_equal(Block(raw, Frequencies.unpacked(table.packed())).ids(), ids)
    far = np.array([5, 1 << 27, 5, 1 << 22])
    raw, table = block_of(far)
    assert np.array_equal(Block(raw, Frequencies.unpacked(table.packed())).ids(), far)


def test_order_nulls_and_repeats_by_value(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(llm.BYTE_BPE)
    rows = [(9, "b"), (None, A), (3, None), (9, "a"), (9, "b"), (-4, ""), (10**12, "x " * 3000)]
    files = write_files(frame(spark, [(i, t, None, None, None, "", 0) for i, t in rows]), llm.BYTE_BPE, parts=3)
    got = sorted(read_files(files, with_ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, -4, 3, 9, 9, 9, 10**12]
    ids = {t: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for _, t in rows}
    assert [list(r["ids"]) for r in got if r["doc_id"] != 9] == [ids[A], ids[""], ids[None], ids["x " * 3000]]
    assert sorted(list(r["ids"]) for r in got if r["doc_id"] == 9) == sorted([ids["a"], ids["b"], ids["b"]])
    at = 0
    for r in got:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes()))
        at += r["n_tokens"]
