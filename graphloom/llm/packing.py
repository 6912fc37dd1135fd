"""Packing of tokenized documents into sequences by best-two-fit."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import pieces
from graphloom.session import materialize

SEQUENCE = 2048
END_OF_TEXT = "<|endoftext|>"
#: Pieces that one packing task is given on average; a task wastes a sequence or two at its end, whatever it gets.
PER_TASK = 40_000

_encoders: dict[tuple, object] = {}


def encoder(rank_path: str, pattern: str):
    """The byte-level vocabulary of the tokenizer file as ranks; its one special token is found in texts, as that file's own library does."""
    import tiktoken

    key = (rank_path, pattern)
    if key not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(rank_path, "rb"))}
        _encoders[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})
    return _encoders[key]


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """Start and length of each piece of n ids: whole pieces of size, the first one shorter where n isn't a multiple."""
    head = n % size or min(n, size)
    return [(0, head), *((s, size) for s in range(head, n, size))]


def _tokenized(batches, rank_path, pattern, size, end_id):
    e = encoder(rank_path, pattern)
    for batch in batches:
        ids_col, texts = batch.column("doc_id"), batch.column("text")
        for a, b, _, _ in pieces(texts):
            out = []
            for doc, text in zip(ids_col.slice(a, b - a).to_pylist(), texts.slice(a, b - a).to_pylist()):
                ids = e.encode(text or "", allowed_special="all") if text and END_OF_TEXT in text else e.encode_ordinary(text or "")
                raw = np.array([*ids, end_id], "<u4")
                out += [(doc, k, s, n, zlib.crc32(raw[s : s + n])) for k, (s, n) in enumerate(cut(len(raw), size))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (ids_col.type, *[pa.int64()] * 4))], ["doc_id", "piece", "start", "length", "ids_crc32"])


def best_two_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. Items of one length are alike, so unpacked items are counted by length.

    A bin is filled greedily with the longest item that fits. Then, while a gap is left, its shortest item goes
    back if two unpacked items fill the expanded gap more tightly.
    """
    stock = np.bincount(lengths, minlength=size + 1)
    order = np.argsort(lengths, kind="stable")
    next_of = np.cumsum(stock) - stock
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    upto = np.where(stock > 0, np.arange(size + 1), 0)
    upto = np.maximum.accumulate(upto)  # the longest length in stock of at most x

    def take(x: int) -> None:
        stock[x] -= 1
        if not stock[x]:
            below, end = upto[x - 1], np.searchsorted(upto, x, "right")
            upto[x:end] = below

    def give(x: int) -> None:
        stock[x] += 1
        if stock[x] == 1:
            end = x + int(np.searchsorted(upto[x:], x, "right"))
            upto[x:end] = np.maximum(upto[x:end], x)

    left, number = len(lengths), 0
    while left:
        own, gap = [], size
        while gap and (x := int(upto[gap])):
            own.append(x)
            gap -= x
            take(x)
        while gap and len(own) < left + len(own) and own:
            small = min(own)
            if small == size or small < 2:
                break
            room = gap + small
            first = np.flatnonzero(stock[: room] > 0)
            first = first[first > 0]
            if not len(first):
                break
            second = upto[np.minimum(room - first, first)].copy()
            for i in np.flatnonzero((second == first) & (stock[first] < 2)):
                second[i] = upto[first[i] - 1]
            both = np.where(second > 0, first + second, 0)
            k = int(both.argmax())
            if both[k] <= small:
                break
            own.remove(small)
            give(small)
            for x in (int(first[k]), int(second[k])):
                own.append(x)
                take(x)
            gap = room - int(both[k])
        at = 0
        for x in own:
            item = order[next_of[x]]
            next_of[x] += 1
            bins[item], offsets[item] = number, at
            at += x
        left -= len(own)
        number += 1
    return bins, offsets


def _packed(batches, size):
    from pyspark import TaskContext

    got = [b for b in batches if b.num_rows]
    if got:
        whole = pa.Table.from_batches(got)
        whole = whole.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = best_two_fit(whole.column("length").to_numpy(), size)
        first = TaskContext.get().partitionId() << 36
        whole = whole.append_column("sequence_id", pa.array(bins + first)).append_column("offset", pa.array(offsets))
        yield from whole.to_batches()


def pack(docs: DataFrame, rank_path: str, pattern: str, size: int = SEQUENCE, end_id: int = 0) -> DataFrame:
    """Pieces of all docs with their place in sequences of at most size ids.

    Tokenization is a narrow pass; only the small rows of the pieces are dealt out by a hash, some 40,000 to a
    task, and each task packs its own. A null text counts as empty and is its end id alone; null doc_ids and
    repeated rows are packed like others; an empty table gives no rows; a text of any length is cut, not dropped.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    cuts = materialize(
        docs.select("doc_id", "text").mapInArrow(lambda it: _tokenized(it, rank_path, pattern, size, end_id), f"doc_id {kind}, piece long, start long, length long, ids_crc32 long"), "pieces"
    )
    tasks = max(1, -(-cuts.count() // PER_TASK))
    dealt = cuts.repartition(tasks, F.xxhash64("doc_id", "piece"))
    return dealt.mapInArrow(lambda it: _packed(it, size), f"doc_id {kind}, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long")
