"""Token counts of whole texts by a public tokenizer; ids never leave the Arrow function, only their numbers do.

Texts are read in windows of some megabytes, whatever the documents' lengths, so one very long text costs no
more memory than many short ones. For a BPE vocabulary of sentencepiece a boundary between two characters is safe
where no piece holds the two side by side: no merge can cross it, so the tokens of the parts are those of the whole.
The parts between safe boundaries are about words; of a window each different one is encoded once by the library,
in one batch call. Vocabularies without that property (other models, other normalisers, symbols of a user's own,
the files of ``tokenizers``) encode whole texts, in batches of bounded bytes.

Contract: null texts count as empty and have no token. No begin, end or added special tokens; strings that look like
special tokens are what the library's default takes them for. Repeated rows and null doc_ids are counted row by row;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm._shared import by_bytes, pick, tidy

#: Bytes of text in a batch, and counts of different parts that a task remembers.
STEP, CACHE_PARTS = 4 << 20, 1 << 18
#: Fixed value: the character that sentencepiece writes for a space.
SPACE = "▁"


class Pieces:
    """A sentencepiece model: its processor, and the safe boundaries if it has any."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.model, kinds = model, sentencepiece_model_pb2.ModelProto.SentencePiece
        spec, bpe = model.normalizer_spec, sentencepiece_model_pb2.TrainerSpec.BPE
        self.whole = SentencePieceProcessor(model_proto=model.SerializeToString())
        self.separable = (
            model.trainer_spec.model_type == bpe and model.trainer_spec.byte_fallback and not model.trainer_spec.treat_whitespace_as_suffix
            and not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.escape_whitespaces
            and all(p.type in (kinds.NORMAL, kinds.BYTE, kinds.UNKNOWN, kinds.CONTROL) for p in model.pieces)
        )
        self.prefix = " " if spec.add_dummy_prefix else ""
        self.normal = [p.piece for p in model.pieces if p.type == kinds.NORMAL]
        spec.add_dummy_prefix = False
        self.part = SentencePieceProcessor(model_proto=model.SerializeToString())  # of texts that have their prefix already
        self.known: dict[str, int] = {}

    @cached_property
    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """(class of each code point, whether a piece holds characters of two classes side by side); class 0: in no pair."""
        pairs = {(a, b) for p in self.normal for a, b in zip(p.replace(SPACE, " "), p.replace(SPACE, " ")[1:])}
        number = {c: i for i, c in enumerate(sorted({c for pair in pairs for c in pair}), 1)}
        of = np.zeros(0x110000, np.uint16)
        joined = np.zeros((len(number) + 1, len(number) + 1), bool)
        for c, i in number.items():
            of[ord(c)] = i
        for a, b in pairs:
            joined[number[a], number[b]] = True
        return of, joined

    def starts(self, text: str) -> np.ndarray:
        """The characters of a text before which a part begins, the first one included."""
        of, joined = self.neighbours
        kind = of[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        return np.concatenate([[0], np.flatnonzero(~joined[kind[:-1], kind[1:]]) + 1])

    def lengths(self, parts: list[str]) -> np.ndarray:
        """Tokens of each part."""
        new = [p for p in parts if p not in self.known]
        if len(self.known) + len(new) > CACHE_PARTS:
            self.known, new = {}, parts
        found = self.known if len(new) <= CACHE_PARTS else {}
        found.update(zip(new, map(len, self.part.encode(new, num_threads=1))))
        return np.array([found[p] for p in parts], np.int64)

    def count(self, texts: pa.Array, step: int = STEP) -> np.ndarray:
        """Tokens of each text of a large_string array without nulls."""
        if not self.separable:
            return _in_batches(texts, step, lambda some: map(len, self.whole.encode(some, num_threads=1)))
        texts = pc.replace_substring(texts, SPACE, " ")
        if self.prefix:
            large = lambda x: pa.scalar(x, pa.large_string())
            texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), large(""), pc.binary_join_element_wise(large(self.prefix), texts, large("")))
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        at, end, size, tokens = int(offsets[0]), int(offsets[-1]), step, np.zeros(len(texts), np.int64)
        while at < end:
            to = min(at + size, end)
            while to < end and data[to] & 0xC0 == 0x80:
                to += 1
            window = data[at:to]
            first = np.flatnonzero((window & 0xC0) != 0x80)  # the byte each character begins at
            cuts = first[self.starts(window.tobytes().decode("utf-8", "surrogatepass"))] + at
            inside = offsets[(offsets > at) & (offsets < to)]
            cuts = np.union1d(cuts, inside)
            if to < end and to not in offsets:  # the last part may go on
                if len(cuts) == 1:
                    size *= 2
                    continue
                to, cuts = int(cuts[-1]), cuts[:-1]
            bounds = np.concatenate([cuts, [to]]).astype(np.int64)
            parts = pa.Array.from_buffers(pa.large_string(), len(cuts), [None, pa.py_buffer(bounds), texts.buffers()[2]]).dictionary_encode()
            found = self.lengths(parts.dictionary.to_pylist())[np.asarray(parts.indices)]
            doc = np.searchsorted(offsets, cuts, side="right") - 1
            tokens += np.bincount(doc, found, len(texts)).astype(np.int64)
            at, size = to, step
        return tokens


class Vocabulary:
    """A file of ``tokenizers``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def count(self, texts: pa.Array, step: int = STEP) -> np.ndarray:
        return _in_batches(texts, step, lambda some: (len(e.ids) for e in self.tokenizer.encode_batch(some, add_special_tokens=False)))


def _in_batches(texts: pa.Array, step: int, lengths: Callable[[list[str]], Iterator[int]]) -> np.ndarray:
    """Tokens of whole texts, some bytes of them at a time."""
    found = [n for lo, hi in by_bytes(texts, step) for n in lengths(texts.slice(lo, hi - lo).to_pylist())]
    return np.array(found, np.int64)


def counter(path: str) -> Pieces | Vocabulary:
    """What counts tokens by a file: sentencepiece for .model, tokenizers for .json."""
    if path.endswith(".model"):
        return Pieces(path)
    if path.endswith(".json"):
        return Vocabulary(path)
    raise ValueError(f"no tokenizer for {path!r}: a .model or a .json is needed")


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row of docs (doc_id, text). path: a file that all executors have."""
    docs = pick(docs, "doc_id", "text")
    docs = docs.select(docs.doc_id.cast("long").alias("doc_id"), F.coalesce(docs.text.cast("string"), F.lit("")).alias("text"))

    @tidy
    def run(batches):
        tool = counter(path)
        for batch in batches:
            for lo, hi in by_bytes(batch.column(1), 4 * STEP):
                texts = batch.column(1).slice(lo, hi - lo).cast(pa.large_string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pc.binary_length(texts).cast(pa.int64()), pa.array(tool.count(texts))], ["doc_id", "n_bytes", "n_tokens"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def query(docs: DataFrame, limit: int = 4096) -> DataFrame:
    """Counts by the public 32k model, and whether they go beyond ``limit``."""
    import public_tokenizers

    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumn("over_limit", F.col("n_tokens") > limit)
