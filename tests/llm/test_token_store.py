"""The token store against direct encoding, and its Elias-Fano coding against plain numbers."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracewell.llm import token_store as T

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=400))
def test_elias_fano_select(values):
    values = sorted(values)
    coded = T.EliasFano.of(np.array(values, np.uint64))
    back, end = T.EliasFano.load(memoryview(coded.dump()), 0)
    assert end == len(coded.dump()) and back.all().tolist() == values and [back[i] for i in range(len(values))] == values
    with pytest.raises(IndexError):
        back[len(values)]


def test_coding_is_small():
    values = np.cumsum(np.random.default_rng(0).integers(1, 2000, 100_000))
    assert T.EliasFano.of(values).nbytes * 8 / len(values) < 2 + np.log2(values[-1] / len(values)) + 1.5


def signed(text):
    """Spark's XXH64 of a text; that of a null is its seed."""
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def expected(rows, tokenizer):
    out, at = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1]))):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def stored(spark, df, path, **more):
    T.write_tokens(df, path, PATH, **more)
    return sorted(map(tuple, T.read_tokens(spark, path).collect()), key=lambda r: r[1])


def test_odd_rows(spark, tmp_path):
    odd = ["", None, " \n\n ", "a's 't 'LL don't", "Ünïcode É é ①  ﬁ İ Σας", "x" * 5000, "word, word. (word) ###!!,.", "tab\tand nbsp\x1cy", "日本 🙂🙂", "' ''", "a·b · c", "a,'s ,'s a!'t"]
    rows = [(i, t) for i, t in enumerate(odd)] + [(3, "again"), (3, "again"), (None, "no id"), (-5, "negative")]
    df = spark.createDataFrame([(a, b, "clash", 7) for a, b in rows], "doc_id long, text string, part string, start int").repartition(3)
    got = stored(spark, df, f"{tmp_path}/s", block_tokens=40)
    assert got == expected(rows, LIBRARY)


def test_added_tokens_in_both_spellings(spark, tmp_path):
    texts = ["end <|endoftext|> next", "<|ENDOFTEXT|>Y", "a<|startoftext|>B\n<|StartOfText|>.", "plain words", "<|endoftext", "x<|endoftext|><|ENDOFTEXT|>"]
    rows = list(enumerate(texts))
    got = stored(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(2), f"{tmp_path}/s")
    assert got == expected(rows, LIBRARY)
    cache = T.WordCache.get(PATH, 2)
    assert np.frombuffer(cache.encode(pa.array(texts[:1]))[0], "<u2").tolist() == [806, 49407, 1131]
    assert 49407 not in np.frombuffer(cache.encode(pa.array(texts[1:2]))[0], "<u2")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aZsdtmé\u0301ΣSİ'.,!-7 0²\n\t\u00a0\u0338日🙂#<|>")), max_size=40), min_size=1, max_size=8))
def test_any_text_as_the_library_encodes_it(texts):
    tokenizer = LIBRARY
    got = T.WordCache.get(PATH, 2).encode(pa.array(["before", *texts]).slice(1))
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


def test_words_are_forgotten_by_age(monkeypatch):
    monkeypatch.setattr(T, "CACHE_WORDS", 3)
    cache, tokenizer = T.WordCache(PATH, 2), LIBRARY
    for text in ["one two three four", "five one six", "seven eight nine ten", "one", "", "one two 7 a7b"]:
        assert np.frombuffer(cache.encode(pa.array([text]))[0], "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(cache.words) + len(cache.older) < 12


def test_another_form_of_tokenizer_gets_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    cache, tokenizer = T.WordCache(path, 2), Tokenizer.from_file(path)
    texts = ["Two  Words, and\n a 7 <|endoftext|>.", "", " x"]
    assert not cache.parts and [np.frombuffer(x, "<u2").tolist() for x in cache.encode(pa.array(texts))] == [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


def test_very_long_text(spark, tmp_path):
    rows = [(1, "Long word, " * 600_000), (2, "x")]
    assert stored(spark, spark.createDataFrame(rows, "doc_id long, text string"), f"{tmp_path}/s") == expected(rows, LIBRARY)


def test_real_rows_over_several_files(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = stored(spark, docs.repartition(5), f"{tmp_path}/s", block_tokens=5000)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got == expected(rows, LIBRARY)
    files = [T.TokenFile(p.read_bytes()) for p in (tmp_path / "s").glob("part-*")]
    assert len(files) > 5 and sum(f.n_docs for f in files) == len(rows)
    first = next(f for f in files if f.part == 0 and f.block == 0)
    assert first.document(1).tolist() == [*LIBRARY.encode(rows[1][1], add_special_tokens=False).ids, 1]


def test_empty_table(spark, tmp_path):
    assert stored(spark, spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/s") == []
