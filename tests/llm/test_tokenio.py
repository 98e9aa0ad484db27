import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import documents, empty
from tokenizers import Tokenizer

from slotvalue.llm import tokenio

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
ENCODE = tokenio.Encoder(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=3000))
def test_pack_round_trip(ids):
    arr = np.array(ids, np.uint64)
    words, firsts, escaped = tokenio.pack(arr)
    assert tokenio.unpack(words, firsts, len(arr), escaped).tolist() == ids
    assert len(escaped) == sum(i >= 2**60 for i in ids)


@pytest.mark.parametrize("ids", [[], [0] * 5000, [1] * 61, [2**60 - 1, 2**60, 2**64 - 1], list(range(4000))])
def test_pack_edges(ids):
    words, firsts, escaped = tokenio.pack(np.array(ids, np.uint64))
    assert tokenio.unpack(words, firsts, len(ids), escaped).tolist() == ids
    assert len(words) <= max(1, len(ids))


TEXTS = ["", " ", "  a", "a  b", "a \n b", "x  ", "<|endoftext|> a<|endoftext|>b  <|endoftext|>", "\n<|endoftext|>\n", "a\x1c b", "\n  x",
         " lead", "don't we'll 've", "it 's\n's", "　 x 　y", "\xe9 \xe0\n\xf1  漢字 ok", "a​ b", "a\nb c\nd", "a\x85\nb",
         "\na", "a\n", "x　\ny", "a.\nB, c!! d?", " \na", "a\rb\r\nc", "a\t\nb", "one... two,three ; four", "na\xefve \xd7 \xf7", "1a a1 ² aª"]


@pytest.mark.parametrize("text", TEXTS)
def test_words_encode_as_the_whole_text(text):
    got = ENCODE(pa.array(["lead", text, "a b", text], pa.large_string()))
    want = PLAIN.encode(text, add_special_tokens=False).ids
    assert [np.frombuffer(x, "<u4").tolist() for x in got][1::2] == [want, want]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r.,'sS!1aé  漢<|>"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_any_text_encodes_as_the_whole_text(text):
    got = ENCODE(pa.array(["lead", text, "a b", text], pa.large_string()))
    want = PLAIN.encode(text, add_special_tokens=False).ids
    assert [np.frombuffer(x, "<u4").tolist() for x in got][1::2] == [want, want]


def test_odd_documents_round_trip(spark, tmp_path):
    docs = documents(spark)
    tokenio.write_tokens(docs, str(tmp_path / "t"), PATH)
    got = sorted(tokenio.read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([r.doc_id for r in docs.collect()], key=lambda i: (i is not None, i))
    at, seen = 0, []
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert r.start == at and r.n_tokens == len(ids) and ids[-1] == 2
        at += len(ids)
        seen.append((r.doc_id, ids))
    want = [(r.doc_id, PLAIN.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in docs.collect()]
    assert sorted(map(str, seen)) == sorted(map(str, want))


def test_empty_table(spark, tmp_path):
    tokenio.write_tokens(empty(spark), str(tmp_path / "t"), PATH)
    assert tokenio.read_tokens(spark, str(tmp_path / "t")).count() == 0


def test_many_records_and_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenio, "RECORD_IDS", 500)
    monkeypatch.setattr(tokenio, "RECORDS", 3)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(150)
    rows = {r.doc_id: PLAIN.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
    tokenio.write_tokens(docs, str(tmp_path / "t"), PATH)
    at = 0
    for r in tokenio.read_tokens(spark, str(tmp_path / "t")).orderBy("doc_id").collect():
        assert (r.start, zlib.crc32(bytes(r.ids))) == (at, zlib.crc32(np.array(rows[r.doc_id], "<u4").tobytes()))
        at += r.n_tokens
    assert len(list((tmp_path / "t").glob("part-*"))) > 10
