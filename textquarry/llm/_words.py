"""Words of many texts at once, without an object for each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def split_words(texts: pa.Array, lower: str = "") -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(number of each word, words of each text, the different words): words are what ASCII white space parts.

    lower: ``ascii`` for A-Z alone, ``utf8`` for all letters. Null texts have no words.
    """
    a = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    a = a.fill_null(b"" if pa.types.is_binary(a.type) else "")
    if not (pa.types.is_string(a.type) or pa.types.is_large_string(a.type)):
        a = a.cast(pa.string(), safe=False)
    if lower:
        a = pc.ascii_lower(a) if lower == "ascii" else pc.utf8_lower(a)
    a = pc.ascii_trim_whitespace(a)
    lists = pc.ascii_split_whitespace(a)
    flat, count = lists.flatten(), np.asarray(lists.value_lengths()).astype(np.int64)
    empty = np.asarray(pc.equal(pc.binary_length(a), 0))
    if empty.any():  # an empty text is split into one empty word
        keep = np.ones(len(flat), bool)
        keep[(np.cumsum(count) - count)[empty]] = False
        flat, count[empty] = flat.filter(pa.array(keep)), 0
    coded = flat.dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), count, coded.dictionary.cast(pa.binary()).to_pylist()
