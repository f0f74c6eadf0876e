import pyarrow as pa

from tests.llm.texts import rows
from textquarry.llm._words import split_words


def test_split():
    texts = ["", "a  b", " x\x0by\x0c z\r\n\tq ", "\n", " é　b\x1cc\x85", " A ÉÀ", None] + [t for _, t in rows()]
    for array in (pa.array(texts), pa.array([None if t is None else t.encode() for t in texts], pa.binary()), pa.chunked_array([texts[:3], texts[3:]])):
        index, count, distinct = split_words(array, "ascii")
        want = [(t or "").encode().lower().split() for t in texts]
        assert [distinct[i] for i in index] == [w for ws in want for w in ws] and count.tolist() == [len(w) for w in want]
    assert split_words(pa.array(["ÉA É"]), "utf8")[2] == ["éa".encode(), "é".encode()] and len(split_words(pa.array([], pa.string()))[0]) == 0
