"""Token counts against the library's own over whole texts."""

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.texts import frame, rows
from textquarry.llm.tokens import Pieces, count_tokens, counter, query

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a ", " a", "a  b", "▁", "a▁b", "▁▁a ▁", "<s>x</s><unk>", "<0x0A>\n<0x0A>", "a\x00b\n\n\tc", "\U0001f600\U0001f600 \U0001f600", "日本語 テキスト", "ééß x", "﻿�", "aaaa" * 999, "x1" * 500 + " " * 77 + "y", "  　 ."]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_windows(library):
    texts = ODD + pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    want = [len(x) for x in library.encode(texts)]
    assert Pieces(MODEL).separable
    for step in (64, 1 << 12, 1 << 22):
        some = texts if step > 64 else texts[: len(ODD) + 3]
        assert Pieces(MODEL).count(pa.array(some, pa.large_string()), step).tolist() == want[: len(some)]
        sliced = pa.array(["zz", *some], pa.large_string()).slice(1)
        assert Pieces(MODEL).count(sliced, step).tolist() == want[: len(some)]
    plain = Pieces(MODEL)
    plain.separable = False
    assert plain.count(pa.array(texts, pa.large_string()), 4096).tolist() == want


def test_query(spark, library):
    data = [*rows(), *((5000 + i, t) for i, t in enumerate(ODD)), (6000, "long words, " * 60_000), (6001, "z" * 70_000), (6002, "é z" * 4096)]
    got = sorted(map(tuple, query(frame(spark, data).repartition(3)).collect()), key=repr)
    count = [(i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in data]
    assert got == sorted([(*c, c[2] > 4096) for c in count], key=repr) and any(r[3] for r in got)
    assert query(frame(spark, [])).collect() == []


def test_limit(spark):
    some = frame(spark, [(1, "a b c")])
    n = query(some).first().n_tokens
    assert not query(some, n).first().over_limit and query(some, n - 1).first().over_limit


def test_other_files(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    data = rows(n=6)
    tool = Tokenizer.from_file(path)
    want = [(i, len(tool.encode(t or "", add_special_tokens=False).ids)) for i, t in data]
    got = [(r.doc_id, r.n_tokens) for r in count_tokens(frame(spark, data), path).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    with pytest.raises(ValueError):
        counter("words.txt")
