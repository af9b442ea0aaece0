"""op7's relaxing Viterbi for unigram models: best segmentations by brute force, and by the library."""

from __future__ import annotations

import random

import pytest

from maskwright.llm import queries as llm
from maskwright.llm.sp_codec import SPACE, PieceIds


@pytest.fixture(scope="module")
def model_path(tmp_path_factory) -> str:  # noqa: ANN001
    """The pieces and scores of the installed model, declared to be a unigram model: its type is one number in the file."""
    raw = open(llm.PIECES, "rb").read()
    out, at, done = b"", 0, False

    def varint(b: bytes, i: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            n |= (b[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if b[i - 1] < 128:
                return n, i

    while at < len(raw):
        key, i = varint(raw, at)
        if key & 7 != 2:
            raise AssertionError("a message has length-delimited fields only")
        size, body = varint(raw, i)
        if key >> 3 == 2:  # trainer's settings
            spec, j = bytearray(raw[body : body + size]), 0
            while j < len(spec):
                k, v = varint(bytes(spec), j)
                if k & 7 == 2:
                    n, v = varint(bytes(spec), v)
                    j = v + n
                elif k & 7 == 0:
                    if k >> 3 == 3:
                        assert spec[v] == 2  # BPE
                        spec[v], done = 1, True
                    _, j = varint(bytes(spec), v)
                else:
                    j = v + (4 if k & 7 == 5 else 8)
            out += raw[at:body] + bytes(spec)
        else:
            out += raw[at : body + size]
        at = body + size
    assert done
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(out)
    return str(path)


def best(pieces: PieceIds, chunk: str) -> float:
    """The best total score of any segmentation; a character without a piece costs as much as an unknown one."""
    score = [0.0] + [float("-inf")] * len(chunk)
    for end in range(1, len(chunk) + 1):
        for start in range(end):
            i = pieces.piece_ids.get(chunk[start:end])
            if i is not None:
                score[end] = max(score[end], score[start] + pieces.scores[i])
        if score[end] == float("-inf"):
            score[end] = score[end - 1] + pieces.low
    return score[-1]


def chunks() -> list[str]:
    rnd = random.Random(5)
    words = ["internationalization", "thequickbrownfox", "Straße", "aaaaaaaaaa", "x", "über", "don't", "3.14159", "naïve", "zzzqx", "hello", "\U0001f600a", "漢字かな"]
    words += ["".join(rnd.choices("abcdehilnorstuw", k=rnd.randint(1, 14))) for _ in range(300)]
    return [rnd.choice(["", SPACE]) + w for w in words]


def test_segmentations_have_the_best_score(model_path):
    pieces = PieceIds(model_path, "unigram")
    for chunk in chunks():
        ids = pieces.segment(chunk)
        known = [i for i in ids if i in pieces.text_of]
        raw = b"".join(pieces.raw[i] for i in ids).decode()
        assert raw == chunk.replace(SPACE, " ")
        if len(known) == len(ids):
            assert sum(pieces.scores[i] for i in ids) == pytest.approx(best(pieces, chunk)), chunk


def test_segmentations_are_the_librarys(model_path):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = PieceIds(model_path, "unigram")
    told = lambda ids: sum(pieces.scores[i] for i in ids)
    same = 0
    said = [c.replace(SPACE, "") for c in chunks()] + ["the cat sat on the mat", "two words"]
    for text in said:
        own, want = pieces.text(text), sp.encode(text)
        same += own == want
        assert told(own) >= told(want) - 1e-6, text  # of segmentations with equal scores either is right
    assert same >= 0.99 * len(said)
