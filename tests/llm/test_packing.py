"""Pieces against the library's ids, sequences against the rules, and the curve."""

import random
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.texts import frame, rows
from textquarry.llm import packing
from textquarry.llm._bpe import Encoder

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


def test_words_as_the_library_does():
    encoder, library = Encoder(PATH), tokenizers.Tokenizer.from_file(PATH)
    rnd = random.Random(1)
    texts = ["", " \n", "It's aaa aaaa 12a3 <|endoftext|>b <|ENDOFTEXT|> Σ ΑΣ ﬁ İx ß é ́x \x1dq x²½ ª 'S 日本語 \U0001f600 \x00 a\x00b　c\x85d"]
    texts += ["".join(chr(rnd.choice([rnd.randrange(1, 0x180), rnd.randrange(97, 123), 32, rnd.randrange(1, 0x3000)])) for _ in range(40)) for _ in range(500)]
    texts += ["".join(rnd.choice("aaabcé<|>' ") for _ in range(40)) for _ in range(500)] + [t or "" for _, t in rows()]
    ids, n = encoder(pa.array(texts))
    for t, a, b in zip(texts, np.cumsum(n) - n, np.cumsum(n)):
        assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids


def test_hilbert_steps():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        x = np.array(list(product(range(1 << bits), repeat=dims)))
        place = packing.hilbert(x, bits)
        assert sorted(place) == list(range(len(x)))
        assert (np.abs(np.diff(x[np.argsort(place)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("length", [2048, 64])
def test_pieces(spark, length):
    data = rows()
    found = packing.pack(frame(spark, data).repartition(3), PATH, length, with_ids=True).collect()
    library = tokenizers.Tokenizer.from_file(PATH)
    want = sorted(tuple([*library.encode(t or "", add_special_tokens=False).ids, 1]) for _, t in data)
    for r in found:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length and r.length > 0
    by_doc = defaultdict(list)
    for r in found:
        by_doc[r.doc_id, r.doc_tokens].append(r)
    got = []
    for (_, n), rs in by_doc.items():
        starts = sum(r.start == 0 for r in rs)
        assert sum(r.length for r in rs) == starts * n
        if starts == 1:
            got.append(tuple(np.frombuffer(b"".join(r.ids for r in sorted(rs, key=lambda r: r.start)), "<u4").tolist()))
    assert not set(got) - set(want) and len(got) >= len(want) - 4
    seqs = defaultdict(list)
    for r in found:
        seqs[r.sequence_id].append((r.offset, r.length))
    sizes = []
    for rs in seqs.values():
        at = 0
        for offset, n in sorted(rs):
            assert offset == at
            at += n
        sizes.append(at)
        assert at == length or at < length and at & (at - 1) == 0
    assert sorted(seqs) == list(range(len(seqs))) and sum(sizes) == sum(map(len, want))
    assert packing.pack(frame(spark, []), PATH, length).collect() == []


def test_very_long_text(spark):
    rnd = random.Random(12)
    text = " ".join("".join(rnd.choice("aeiounstré") for _ in range(rnd.randint(1, 9))) for _ in range(200_000))
    found = packing.pack(frame(spark, [(1, text), (2, "short"), (3, None)]), PATH, 2048, with_ids=True).collect()
    own = sorted((r for r in found if r.doc_id == 1), key=lambda r: r.start)
    ids = np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist()
    assert ids == [*tokenizers.Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, 1]
    assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and {r.doc_id for r in found} == {1, 2, 3}
