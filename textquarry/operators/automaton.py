"""A multi-pattern automaton (Aho and Corasick, 1975) as numpy arrays, run over many places of many texts at once.

It reads bytes of UTF-8, so an alphabet of thousands of characters needs no wide rows. The transitions, one for each
byte of the terms at most, lie in one open-addressed hash table; where a state has none for a byte, its fallback state is
asked. Texts are laid end to end with a byte between them that UTF-8 hasn't, and cut into lanes that advance together;
each lane begins the longest term's length early, so what crosses a cut is found once.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a step, and of a lane. BETWEEN lies between texts.
STEP, LANE, BETWEEN = 1 << 20, 256, b"\xff"
#: Matches in a batch that leaves a worker.
MATCHES = 1 << 16


def _hash(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class Automaton:
    """Finds all occurrences of terms, given as (term, type) pairs that are different and not empty."""

    def __init__(self, pairs: list[tuple[str, str | None]]):
        by_term: dict[bytes, list] = {}
        for term, kind in pairs:
            by_term.setdefault(term.encode(), []).append(kind)
        terms = sorted(by_term)
        self.longest = max(map(len, terms))
        self.bytes = np.array([len(t) for t in terms], np.int64)
        self.chars = np.array([len(t.decode()) for t in terms], np.int64)
        self.kinds = np.array([len(by_term[t]) for t in terms], np.int64)  # types of each term
        self.first_kind = np.cumsum(self.kinds) - self.kinds
        self.kind = pa.array([k for t in terms for k in by_term[t]], pa.string())
        self._build(terms)

    def _build(self, terms: list[bytes]) -> None:
        children: list[dict[int, int]] = [{}]
        ends = {}
        for n, term in enumerate(terms):
            at = 0
            for b in term:
                at = children[at].setdefault(b, len(children))
                if at == len(children):
                    children.append({})
            ends[at] = n
        #: The term that ends in each state (-1: none), and the next state along the fallbacks in which one ends (0: none).
        self.term, self.link = np.full(len(children), -1, np.int64), np.zeros(len(children), np.int64)
        self.term[list(ends)] = list(ends.values())
        self.root = np.zeros(256, np.int64)
        self.root[list(children[0])] = list(children[0].values())
        #: The state of the longest proper suffix that begins a term.
        self.fallback = np.zeros(len(children), np.int64)
        queue = deque(children[0].values())
        while queue:
            s = queue.popleft()
            f = int(self.fallback[s])
            self.link[s] = f if self.term[f] >= 0 else self.link[f]
            for b, t in children[s].items():
                back = f
                while back and b not in children[back]:
                    back = int(self.fallback[back])
                self.fallback[t] = children[back].get(b, 0)
                queue.append(t)
        self.ends = (self.term >= 0) | (self.link > 0)
        edges = np.array([(s << 8 | b, t) for s, row in enumerate(children) if s for b, t in row.items()], np.int64).reshape(-1, 2)
        self._table(edges[:, 0], edges[:, 1])

    def _table(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        slot = _hash(keys, self.bits)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def step(self, states: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The states after one byte each."""
        out = self.root[data]
        lane = np.flatnonzero(states)
        state = states[lane]
        key = state << 8 | data[lane]
        slot = _hash(key, self.bits)
        while len(lane):
            held = self.keys[slot]
            hit = held == key
            out[lane[hit]] = self.values[slot[hit]]
            slot = (slot + 1) & ((1 << self.bits) - 1)
            missed = held < 0
            state = np.where(missed, self.fallback[state], state)
            on = ~hit & (state > 0)
            lane, state, slot, missed = lane[on], state[on], slot[on], missed[on]
            key = state << 8 | data[lane]
            slot = np.where(missed, _hash(key, self.bits), slot)
        return out

    def matches(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first byte, number of the term) of all occurrences in some bytes."""
        early, width = self.longest - 1, max(LANE, 4 * self.longest)
        lanes = -(-len(data) // width)
        padded = np.full(early + lanes * width, BETWEEN[0], np.uint8)
        padded[early : early + len(data)] = data
        states, last, found = np.zeros(lanes, np.int64), [], []
        for j in range(early + width):
            states = self.step(states, padded[j : j + (lanes - 1) * width + 1 : width].astype(np.int64))
            if j >= early:
                hit = np.flatnonzero(self.ends[states])
                if len(hit):
                    last.append(hit * width + j - early)
                    found.append(states[hit])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, s = np.concatenate(last), np.concatenate(found)
        first, terms = [], []
        while len(s):
            real = self.term[s] >= 0
            t = self.term[s[real]]
            first.append(at[real] - self.bytes[t] + 1)
            terms.append(t)
            s = self.link[s]
            at, s = at[s > 0], s[s > 0]
        return np.concatenate(first), np.concatenate(terms)

    def over(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, text without nulls) → (doc_id, start, end, type), offsets in characters, by row and start.

        A worker holds the matches of about ``STEP`` bytes of text, or of one longer text, and gives memory back after each batch.
        """
        for batch in batches:
            size = np.asarray(pc.binary_length(batch.column(1))).astype(np.int64)
            block = np.cumsum(size) // STEP
            cuts = np.flatnonzero(np.diff(block, prepend=-1)).tolist()
            for lo, hi in zip(cuts, [*cuts[1:], len(size)]):
                yield from self._found(batch.slice(lo, hi - lo), size[lo:hi])
            pa.default_memory_pool().release_unused()

    def _found(self, batch: pa.RecordBatch, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        body = BETWEEN.join(batch.column(1).cast(pa.large_binary()).to_pylist())
        data = np.frombuffer(body, np.uint8)
        opened = np.cumsum(size + 1) - size - 1  # the byte at which each text begins
        first, term = self.matches(data)
        order = np.lexsort((self.chars[term], first))
        first, term = first[order], term[order]
        del order
        inner = np.flatnonzero((data & 0xC0) == 0x80)  # bytes that begin no character
        for lo in range(0, len(first), MATCHES):
            yield self._rows(batch.column(0), opened, inner, first[lo : lo + MATCHES], term[lo : lo + MATCHES])

    def _rows(self, ids: pa.Array, opened: np.ndarray, inner: np.ndarray, first: np.ndarray, term: np.ndarray) -> pa.RecordBatch:
        row = np.searchsorted(opened, first, side="right") - 1
        begun = opened[row]
        start = first - np.searchsorted(inner, first) - (begun - np.searchsorted(inner, begun))
        n = self.kinds[term]
        each = np.repeat(np.arange(len(term)), n)
        kind = np.repeat(self.first_kind[term], n) + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        end = start + self.chars[term]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(row[each])), pa.array(start[each].astype(np.int32)), pa.array(end[each].astype(np.int32)), self.kind.take(pa.array(kind))], ["doc_id", "start", "end", "type"])
