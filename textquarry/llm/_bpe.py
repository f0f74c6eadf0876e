"""Many words through a byte-pair vocabulary at once.

``tokenizers`` spends microseconds on each word; a corpus has millions of different ones in each task. For
words of plain Latin letters, digits and punctuation the merges are applied to all words together in numpy;
every other word goes through the library. Both give the same ids, which the tests check.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from textquarry.llm._words import split_words

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
NONE = np.int64(1 << 40)
#: Code points up to here can be handled here; those beyond go through the library.
LAST = 0x180


def _byte_characters() -> list[str]:
    """The printable characters that byte-level vocabularies write bytes as."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@lru_cache
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


class Vocabulary:
    """A lower-casing byte-level vocabulary whose words end in a suffix, as ``tokenizers`` reads it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        chars = _byte_characters()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + suffix] for c in chars], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        a, b, self.merged = (np.array(x, np.int64) for x in zip(*((vocab[x], vocab[y], vocab[x + y]) for x, y in pairs)))
        self.size = max(vocab.values()) + 1
        key = (a << 20) | b
        order = np.argsort(key)
        self.keys, self.rank = key[order], order.astype(np.int64)
        self._hashed()
        self.type = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        points = [chr(c) for c in range(LAST)]
        self.kind = np.array([1 if c.isalpha() else 2 if c.isnumeric() else 3 for c in points] + [3], np.uint8)
        self.kind[10] = 0
        self.safe = np.array([c.isprintable() and c not in " 'İ" for c in points] + [False])
        self.safe[10] = True
        self.lower = np.array([ord(c.lower()) if len(c.lower()) == 1 else 0 for c in points] + [0], np.uint32)

    def _hashed(self) -> None:
        """Pairs by two tables: the second takes those that the first has no room for."""
        bits = 21
        rng, self.shift = np.random.default_rng(1), np.uint64(64 - bits)
        for _ in range(100):
            self.mult = rng.integers(1 << 62, 1 << 63, 2, np.uint64) * np.uint64(2) + np.uint64(1)
            self.slot = np.full((2, 1 << bits), -1, np.int64)
            self.slot_rank = np.full((2, 1 << bits), NONE, np.int64)
            with np.errstate(over="ignore"):
                at = self._at(self.keys)
                self.slot[0, at], self.slot_rank[0, at] = self.keys, self.rank
                rest = self.slot[0, at] != self.keys
                key, rank = self.keys[rest], self.rank[rest]
                at = self._at(key, 1)
            if len(np.unique(at)) == len(at):
                self.slot[1, at], self.slot_rank[1, at] = key, rank
                return
        raise ValueError("the merges can't be hashed")

    def _at(self, key: np.ndarray, table: int = 0) -> np.ndarray:
        return ((key.view(np.uint64) * self.mult[table]) >> self.shift).astype(np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 20) | b
        with np.errstate(over="ignore"):
            at = self._at(key)
            out = np.where(self.slot[0, at] == key, self.slot_rank[0, at], NONE)
            other = np.flatnonzero((self.slot[0, at] != key) & (self.slot[0, at] >= 0))
            at = self._at(key[other], 1)
            out[other] = np.where(self.slot[1, at] == key[other], self.slot_rank[1, at], NONE)
        return out

    def _merge(self, sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the pairs of each piece, lowest rank first. first: where the pieces begin → (ids, ids of each piece)."""
        piece = np.zeros(len(sym), np.int64)
        piece[first[1:]] = 1
        piece = np.cumsum(piece)
        done_sym, done_piece = [], []
        while len(sym):
            rank = np.full(len(sym), NONE)
            same = np.flatnonzero(piece[:-1] == piece[1:])
            rank[same] = self._ranks(sym[same], sym[same + 1])
            start = np.flatnonzero(np.diff(piece, prepend=-1))
            best = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.append(start, len(sym))))
            over = best == NONE
            done_sym.append(sym[over])
            done_piece.append(piece[over])
            hit = (rank == best) & ~over
            at = np.flatnonzero(hit)
            if len(at):  # of overlapping ones every other, from the left
                run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            sym[at] = self.merged[rank[at]]
            over[at + 1] = True
            sym, piece = sym[~over], piece[~over]
        ids, piece = np.concatenate(done_sym), np.concatenate(done_piece)
        order = np.argsort(piece, kind="stable")
        return ids[order], np.bincount(piece, minlength=len(first))

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points = self.lower[np.frombuffer(("\n".join(words) + "\n").encode("utf-32-le"), np.uint32)]
        kind = self.kind[points]
        new = (np.diff(kind, prepend=0) != 0) | (kind == 2)
        word = np.cumsum(kind == 0) - (kind == 0)
        raw = np.frombuffer(points.tobytes().decode("utf-32-le").encode(), np.uint8)
        at = np.repeat(np.arange(len(points)), 1 + (points >= 0x80))
        lead = np.diff(at, prepend=-1) != 0
        keep = kind[at] != 0
        first = np.flatnonzero((new[at] & lead)[keep])
        sym = self.inner[raw[keep]]
        last = np.append(first[1:], len(sym)) - 1
        sym[last] = self.final[raw[keep][last]]
        ids, count = self._merge(sym, first)
        return ids, np.bincount(word[at[keep]][first], count, len(words)).astype(np.int64)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and how many each has. Words hold no ASCII white space and aren't empty."""
        points = np.frombuffer(("\n".join(words) + "\n").encode("utf-32-le", "replace"), np.uint32)
        bad = ~self.safe[np.minimum(points, LAST)]
        odd = np.zeros(len(words), bool)
        odd[(np.cumsum(points == 10))[bad]] = True
        for i in np.flatnonzero(~odd).tolist() if any("<|" in w for w in words) else ():
            odd[i] = "<|" in words[i]
        count = np.zeros(len(words), np.int64)
        good = np.flatnonzero(~odd)
        ids = np.zeros(0, np.int64)
        if len(good):
            ids, count[good] = self._plain([words[i] for i in good.tolist()] if len(good) < len(words) else words)
        if not odd.any():
            return ids, count
        others = np.flatnonzero(odd)
        found = [e.ids for e in self.library.encode_batch_fast([words[i] for i in others.tolist()], add_special_tokens=False)]
        count[others] = [len(f) for f in found]
        word = np.concatenate([np.repeat(good, count[good]), np.repeat(others, count[others])])
        return np.concatenate([ids, np.array([i for f in found for i in f], np.int64)])[np.argsort(word, kind="stable")], count


class Encoder:
    """Texts to ids, word by word with a memory of words."""

    MOST = 1 << 19

    def __init__(self, path: str):
        self.vocab = load(path)
        self._clear()

    def _clear(self) -> None:
        self.words, self.flat, self.count, self.begin = {}, np.zeros(0, self.vocab.type), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has. No id spans white space in such a vocabulary."""
        special = pc.any(pc.match_substring(texts, "<|")).as_py()  # whose case counts
        index, n, distinct = split_words(texts, "" if special else "ascii")
        if len(self.words) > self.MOST:
            self._clear()
        new = [w for w in distinct if w not in self.words]
        if new:
            ids, count = self.vocab.encode([w.decode("utf-8", "replace") for w in new])
            self.words.update(zip(new, range(len(self.words), len(self.words) + len(new))))
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.flat = np.concatenate([self.flat, ids.astype(self.vocab.type)])
        word = np.fromiter(map(self.words.__getitem__, distinct), np.int64, len(distinct))[index]
        size = self.count[word]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.begin[word] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        total = np.concatenate([[0], ends])
        return ids, np.diff(total[np.concatenate([[0], np.cumsum(n)])])
