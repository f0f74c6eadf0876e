"""Text identity, variants and hashes. Offsets and lengths are Unicode code points throughout."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

#: White space as Unicode has it, in the syntax of RE2.
WHITE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


#: Bytes of text that are normalised at once: a batch of long texts would need many times its size in Python.
STEP = 1 << 20
#: What normalisation changes in ASCII; a text without it stays as it is.
ODD_ASCII = r"[\x00-\x1F\x7F]|^ | $|  "


def _normalized(a: pa.Array) -> pa.Array:
    plain = pc.fill_null(pc.string_is_ascii(a), True).to_pylist()
    if not all(plain):
        a = pa.array((t if p else unicodedata.normalize("NFKC", t) for t, p in zip(a.to_pylist(), plain)), pa.string())
        a = pc.replace_substring_regex(a, r"\p{Cf}", "")
    elif not pc.any(pc.match_substring_regex(a, ODD_ASCII)).as_py():
        return a
    a = pc.replace_substring_regex(a, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return pc.utf8_trim(pc.replace_substring_regex(a, WHITE, " "), " ")


def _folded(a: pa.Array) -> pa.Array:
    a = _normalized(a)
    if pc.all(pc.string_is_ascii(a)).as_py() is not False:  # null: no text at all
        return pc.ascii_lower(a)
    return pa.array((None if t is None else t.casefold() for t in a.to_pylist()), pa.string())


def in_steps(texts: pa.Array, make: Callable[[pa.Array], pa.Array], step: int = STEP) -> pa.Array:
    """``make`` over runs of texts of about ``step`` bytes, one after another; a longer text is a run of its own."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // step, prepend=-1)).tolist()
    parts = [make(texts.slice(lo, hi - lo)) for lo, hi in zip(cuts, [*cuts[1:], len(texts)])]
    return pa.concat_arrays(parts) if parts else make(texts)


def given_back(batches: Iterator[pa.Array], make: Callable[[pa.Array], pa.Array]) -> Iterator[pa.Array]:
    """Workers live on for other stages, so a task gives its memory back at the end."""
    try:
        for texts in batches:
            yield in_steps(texts.cast(pa.string()), make)
    finally:
        pa.default_memory_pool().release_unused()


@arrow_udf(StringType())
def normalize(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """NFKC without format and control characters, runs of white space as one space, trimmed."""
    yield from given_back(batches, _normalized)


@arrow_udf(StringType())
def text_key(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The identity of a text: normalised and case-folded."""
    yield from given_back(batches, _folded)


def sha256(x: Column) -> Column:
    return F.sha2(x, 256)


def git_blob_sha1(x: Column) -> Column:
    """SHA-1 as version control names a blob; x: bytes."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(x).cast("string")), "UTF-8"), F.unhex(F.lit("00")), x))


def seeded_order(seed: int | str, key: Column) -> Column:
    """A reproducible random order: the same for any partitioning and on any engine."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)


def full_width(text: Column) -> Column:
    """Typography variant; each mark is replaced by one code point, so offsets stay."""
    return F.translate(text, ",:;()", "，：；（）")


def punctuated(text: Column, every: int = 6) -> Column:
    """A full-width comma after each ``every`` characters but the last. One pass: substrings would begin at the text's start each time."""
    return F.regexp_replace(text, f"(?s)(.{{{every}}})(?=.)", "$1，")


def truncated(text: Column, share: float = 0.7) -> Column:
    """The first ``share`` of the characters, one at least."""
    return F.substring(text, F.lit(1), F.greatest(F.lit(1), F.floor(F.length(text) * share).cast("int")))


def thinned(text: Column, seed: int | str, key: Column, share: float = 0.05) -> Column:
    """Without about ``share`` of the characters (half to even, one at least, not all); texts under 3 stay.

    Which ones go is decided by the hash of (seed, key, position).
    """
    n = F.length(text)
    k = F.least(n - 1, F.greatest(F.lit(1), F.bround(n * share).cast("int")))
    places = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.xxhash64(F.lit(str(seed)), key, i).alias("h"), i.alias("i")))
    gone = F.transform(F.slice(F.array_sort(places), F.lit(1), k), lambda p: p["i"])
    kept, characters = F.array_except(F.sequence(F.lit(0), n - 1), gone), F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    return F.when(n < 3, text).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at(characters, i + 1)), ""))


def perturbed(text: Column, mode: str, seed: int | str = 2027, key: Column | None = None) -> Column:
    """One of the stress modes: clean_subset, punctuation, char_delete_5pct, tail_truncate_30pct."""
    modes = {"clean_subset": lambda: text, "punctuation": lambda: punctuated(text), "char_delete_5pct": lambda: thinned(text, seed, text if key is None else key), "tail_truncate_30pct": lambda: truncated(text)}
    if mode not in modes:
        raise ValueError(f"unknown mode {mode!r}; there are {sorted(modes)}")
    return modes[mode]()


def matches_terms(text: Column, query: str) -> Column:
    """Whether a text holds every white-space separated term of a query, whatever the case. Terms are literal."""
    terms = query.split()
    if not terms or len(query) > 200:
        raise ValueError("a search needs 1 to 200 characters")
    found = F.lit(True)
    for term in terms:
        found = found & F.contains(F.lower(text), F.lower(F.lit(term)))
    return found


def cjk_share_ok(text: Column) -> Column:
    """Language gate: at least 3 Chinese characters and 15 % of the length."""
    return F.regexp_count(text, F.lit("[\\u4e00-\\u9fff]")) >= F.greatest(F.lit(3.0), F.length(text) * F.lit(0.15))


def safe_name(name: Column) -> Column:
    return name.rlike("^[A-Za-z0-9_-]+$")
