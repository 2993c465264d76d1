"""Unigram search against a plain dynamic program, and exact round trips."""

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import sentencepiece as S

PATH = public_tokenizers.path("piece_bpe_32k.model")
PIECES = S.Pieces.get(PATH)
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)
SCORES = {MODEL.id_to_piece(i).replace("▁", " "): (MODEL.get_score(i), i) for i in range(MODEL.get_piece_size()) if not (MODEL.is_byte(i) or MODEL.is_control(i) or MODEL.is_unknown(i))}


def plain(text):
    """Best sum over the whole text, with its ids; the earliest start wins."""
    if not text:
        return []
    text = " " + text
    text = text.replace("▁", "")  # no piece has it; the marker in a text is written as bytes
    best = [(0.0, [])]
    for end in range(1, len(text) + 1):
        top = None
        for start in range(max(0, end - 16), end):
            piece = text[start:end]
            if piece in SCORES:
                new = (best[start][0] + SCORES[piece][0], best[start][1], [SCORES[piece][1]])
            elif end - start == 1:
                raw = piece.replace("", "▁").encode()
                new = (best[start][0] + PIECES.missing, best[start][1], [MODEL.piece_to_id(f"<0x{b:02X}>") for b in raw])
            else:
                continue
            if top is None or new[0] > top[0]:
                top = new
        best.append((top[0], top[1] + top[2]))
    return best[-1][1]


def ids(text):
    return np.frombuffer(PIECES.encode([text])[0], PIECES.kind).tolist()


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abcde theingon ▁\n\t.é漢😀0"), max_size=40))
def test_equals_the_plain_program(text):
    assert ids(text) == plain(text)
    assert PIECES.decode(np.array(ids(text), np.int64)) == text


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    text = text.encode("utf-8", "replace").decode()
    assert PIECES.decode(np.array(ids(text), np.int64)) == text


def test_long_words_and_lockstep_agree():
    words = [" " + "the" * 40, " " + "é漢😀x" * 30, "  " + "z" * 500]
    assert [PIECES._one(w.encode()) for w in words] == [np.array(plain(w[1:]), PIECES.kind).tobytes() for w in words]
    short = [b" theing", " é漢😀".encode(), b"   ", b" q"]
    assert PIECES._together(short) == [PIECES._one(w) for w in short]


def test_double_array_holds_all_pieces():
    trie = S.DoubleArray({b"a": 0, b"ab": 1, b"b\xff": 2, b" the": 3})

    def find(key):
        s = 0
        for c in key:
            t = int(trie.base[s]) + c
            if trie.check[t] != s:
                return None
            s = t
        return int(trie.piece[s])

    assert [find(k) for k in (b"a", b"ab", b"b\xff", b" the", b"b", b"x", b"abc")] == [0, 1, 2, 3, -1, None, None]


def test_frames(spark):
    rows = [(1, "Hello  wörld", "k"), (2, None, "k"), (None, "", "k"), (2, "x", None), (2, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _text string")
    coded = S.encode(df, PATH)
    assert coded.columns == ["doc_id", "_text", "ids"]
    back = S.decode(coded, PATH)
    assert sorted(((r.doc_id, r.text, r._text) for r in back.collect()), key=str) == sorted(rows, key=str)
    assert S.encode(df.limit(0), PATH).count() == 0
    assert sorted((str(r.same) for r in S.encode(df, PATH, same="same").collect())) == ["None", "True", "True", "True", "True"]
    odd = spark.createDataFrame([([-1, 40000, None, 1, 413],)], "ids array<int>")
    assert S.decode(odd, PATH).first().text == MODEL.id_to_piece(413).replace("▁", " ").lstrip(" ")


def test_a_model_with_markers_inside_is_refused(monkeypatch):
    class Odd:
        def __init__(self, model_file): ...
        unk_id = lambda self: 0
        get_piece_size = lambda self: 1
        get_score = lambda self, i: 0.0
        id_to_piece = lambda self, i: "a▁b"
        is_byte = is_control = is_unknown = is_unused = lambda self, i: False

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Odd)
    with pytest.raises(ValueError):
        S.Pieces("x")
