"""Token counts and pieces against the tokenizers' own libraries."""

from __future__ import annotations

import zlib

import numpy as np
from test_contracts import frame, texts

from maskwright.llm import queries as llm
from maskwright.llm.sp_codec import round_trip
from maskwright.llm.token_counts import token_counts


def test_token_counts_are_those_of_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(llm.BYTE_BPE)
    want = {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(texts())}  # and the end id
    for block_bytes in (1 << 20, 64):
        got = {r["doc_id"]: r["n_tokens"] for r in token_counts(frame(spark), llm.BYTE_BPE, block_bytes=block_bytes).collect()}
        assert got == want


def test_pieces_are_those_of_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=llm.PIECES)
    got = {r["doc_id"]: r for r in round_trip(frame(spark), llm.PIECES).collect()}
    assert len(got) == len(texts())
    for i, t in enumerate(texts()):
        ids = sp.encode(t or "")
        assert (got[i]["n_ids"], got[i]["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
