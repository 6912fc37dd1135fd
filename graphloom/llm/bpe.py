"""Byte-level BPE by padded numpy matrices, grouped by length."""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from graphloom.llm.common import pieces

#: Rows of more bytes than this merge all places of their minimum-rank pair in one round, since each round scans the row.
WIDEST = 192
#: Different pre-tokens that a worker remembers before it starts anew.
REMEMBERED = 400_000
EMPTY = np.int64(-1)


class PairTable:
    """Open-addressing hash table from a pair of ids to the id of the merged token, probed for whole arrays at once."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        size = 1 << max(4, (4 * len(pairs) - 1).bit_length())
        self.mask, self.shift = size - 1, 64 - size.bit_length() + 1
        self.keys, self.values = np.full(size, EMPTY), np.zeros(size, np.int32)
        key = np.array([a << 32 | b for a, b in pairs], np.int64)
        value = np.fromiter(pairs.values(), np.int32, len(pairs))
        slot, todo = self._slot(key), np.arange(len(key))
        self.probes = 1
        while len(todo):
            at = slot[todo]
            free = self.keys[at] == EMPTY
            self.keys[at[free]] = key[todo[free]]  # of several that want one slot the last gets it
            won = self.keys[at] == key[todo]
            self.values[at[won]] = value[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & self.mask
            self.probes += bool(len(todo))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray, absent: int) -> np.ndarray:
        key = (a.astype(np.int64) << 32) | b
        slot = self._slot(key)
        out = np.full(key.shape, absent, np.int32)
        open_ = np.ones(key.shape, bool)
        for _ in range(self.probes):
            have = self.keys[slot]
            hit = open_ & (have == key)
            out[hit] = self.values[slot[hit]]
            open_ &= ~hit & (have != EMPTY)
            if not open_.any():
                break
            slot = (slot + 1) & self.mask
        return out


class Codec:
    """Encoder and decoder for a rank file: ids are ranks, and lower ranks merge first."""

    def __init__(self, path: str, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.split = regex.compile(pattern).findall
        self.absent = 1 << 30
        self.byte = np.zeros(256, np.int32)
        for i in range(256):
            self.byte[i] = ranks[bytes([i])]
        pairs = {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.table = PairTable(pairs)
        self.inverted = any(r < max(a, b) for (a, b), r in pairs.items())
        tokens = sorted((r, t) for t, r in ranks.items())
        top = tokens[-1][0] + 1
        self.length, self.offset = np.zeros(top, np.int64), np.zeros(top, np.int64)
        for r, t in tokens:
            self.length[r] = len(t)
        self.offset[1:] = np.cumsum(self.length)[:-1]
        self.flat = np.frombuffer(b"".join(t for _, t in tokens), np.uint8)
        self.known: dict[str, tuple[int, ...]] = {}
        self.texts: dict[str, str] = {}

    def merge(self, parts: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each part; parts of like length share a matrix."""
        out: list[tuple[int, ...]] = [()] * len(parts)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(parts):
            if len(p) > WIDEST:
                out[i] = self._wide(p)
            elif p:
                buckets.setdefault(max(4, 1 << (len(p) - 1).bit_length()), []).append(i)
        for width, which in buckets.items():
            for k in range(0, len(which), rows := max(64, (1 << 19) // width)):
                own = which[k : k + rows]
                for i, ids in zip(own, self._matrix([parts[i] for i in own], width)):
                    out[i] = ids
        return out

    def _matrix(self, parts: list[bytes], width: int) -> list[tuple[int, ...]]:
        n = len(parts)
        size = np.fromiter(map(len, parts), np.int64, n)
        inside = np.arange(width) < size[:, None]
        ids = np.full((n, width), -1, np.int32)
        ids[inside] = self.byte[np.frombuffer(b"".join(parts), np.uint8)]
        ranks = np.full((n, width), self.absent, np.int32)
        both = inside[:, 1:]
        ranks[:, :-1][both] = self.table.get(ids[:, :-1][both], ids[:, 1:][both], self.absent)
        done_ids, done_size = np.full((n, width), -1, np.int32), size.copy()
        left, columns = np.arange(n), np.arange(width)
        while len(left):
            at = ranks.argmin(1)
            line = np.arange(len(left))
            best = ranks[line, at]
            ends = best == self.absent
            if ends.any():  # compaction: rows without a pair leave the matrix
                done_ids[left[ends], : ids.shape[1]], done_size[left[ends]] = ids[ends], size[ends]
                stay = ~ends
                left, ids, ranks, size, at, best = left[stay], ids[stay], ranks[stay], size[stay], at[stay], best[stay]
                if not len(left):
                    break
                line = np.arange(len(left))
            size -= 1
            most = int(size.max())
            take = columns[:most] + (columns[:most] > at[:, None])  # what follows the pair moves one place left
            ids, ranks = np.take_along_axis(ids, take, 1), np.take_along_axis(ranks, take, 1)
            ids[line, at] = best
            ids[columns[:most] >= size[:, None]] = -1
            for near in (at - 1, at):
                ok = (near >= 0) & (near + 1 < size)
                ranks[line[near >= 0], near[near >= 0]] = self.absent
                ranks[line[ok], near[ok]] = self.table.get(ids[line[ok], near[ok]], ids[line[ok], near[ok] + 1], self.absent)
            ranks[columns[:most] >= size[:, None] - 1] = self.absent
        return [tuple(r[:s]) for r, s in zip(done_ids.tolist(), done_size.tolist())]

    def _wide(self, part: bytes) -> tuple[int, ...]:
        """The same merges for one row too wide to scan once for each merge: all places of its minimum-rank pair in one round.

        They are merged from the left, where two overlap the first of them. That is what one at a time comes to, unless a
        merge makes a pair of lower rank; then the round merges the leftmost alone.
        """
        ids = self.byte[np.frombuffer(part, np.uint8)].astype(np.int64)
        get = lambda a, b: self.table.get(a, b, self.absent)
        ranks = get(ids[:-1], ids[1:])
        while len(ranks) and (best := int(ranks.min())) != self.absent:
            at = np.flatnonzero(ranks == best)
            run = np.flatnonzero(np.append(True, np.diff(at) != 1))
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            if len(at) > 1 and self.inverted:
                after = at[at + 2 < len(ids)]
                if (get(np.full(len(after), best), ids[after + 2]) < best).any() or (get(ids[at[at > 0] - 1], np.full((at > 0).sum(), best)) < best).any() or (get(np.array([best]), np.array([best])) < best).any():
                    at = at[:1]
            ids[at] = best
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids = ids[stay]
            new = at - np.arange(len(at))  # places after compaction
            ranks = ranks[stay[: len(ranks)]][: len(ids) - 1]
            for near in (new - 1, new):
                near = near[(near >= 0) & (near + 1 < len(ids))]
                ranks[near] = get(ids[near], ids[near + 1])
        return tuple(ids.tolist())

    def learn(self, parts: set[str]) -> None:
        fresh = [p for p in parts if p not in self.known]
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
            self.texts.clear()
            fresh = list(parts)
        for p, ids in zip(fresh, self.merge([p.encode() for p in fresh])):
            self.known[p] = ids
            self.texts[p] = ",".join(map(str, ids))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """Ids of each text, as numbers and as text joined by commas."""
        cut = [self.split(t) for t in texts]
        self.learn(set(chain.from_iterable(cut)))
        known, written = self.known, self.texts
        return [(np.fromiter(chain.from_iterable(map(known.__getitem__, c)), np.int32), ",".join(map(written.__getitem__, c))) for c in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids, gathered in one step."""
        size = self.length[ids]
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.offset[ids] - ends + size, size)
        return self.flat[at].tobytes()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _round_trip(batches, path, pattern, with_ids):
    c = codec(path, pattern)
    for batch in batches:
        texts = batch.column("text")
        for a, b, _, _ in pieces(texts):
            coded = c.encode([t or "" for t in texts.slice(a, b - a).to_pylist()])
            out = [batch.column("doc_id").slice(a, b - a), pa.array([len(ids) for ids, _ in coded], pa.int64())]
            if with_ids:
                out += [pa.array([ids for ids, _ in coded], pa.list_(pa.int32())), pa.array([c.decode(ids) for ids, _ in coded], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids", "decoded"])
            else:
                out += [pa.array([hashlib.sha256(s.encode()).hexdigest() for _, s in coded]), pa.array([hashlib.sha256(c.decode(ids)).hexdigest() for ids, _ in coded])]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text")


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids and the bytes that the ids decode to, for every whole text, one narrow pass.

    Null text counts as empty and has no ids; null doc_ids are carried; repeated rows stand each for itself;
    other columns are ignored; an empty table gives no rows. A run of bytes without a split may be of any length.
    """
    return _plain(docs).mapInArrow(lambda it: _round_trip(it, path, pattern, True), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>, decoded binary")


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """As encode(), with digests in place of ids and bytes."""
    return _plain(docs).mapInArrow(lambda it: _round_trip(it, path, pattern, False), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
