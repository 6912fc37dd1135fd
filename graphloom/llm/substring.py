"""Substring dedup on words, anchored by fixed blocks."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm import routing
from graphloom.llm.common import BASE, BYTE, U, WORD_BASE, pieces, prefix, span, words

#: Words of a window, of a block, and of the run from a block's start that is its key.
WINDOW, BLOCK, KEY = 50, 4, 24
#: Blocks in a row of which every window has as many, each with its key, wherever the window starts.
ROW = (WINDOW - KEY - (BLOCK - 1)) // BLOCK + 1
PLACE = 24


def hashed(data: np.ndarray, offs: np.ndarray):
    """Row of each word, first word of each row, and prefix sums of word hashes."""
    start, end, row = words(data, offs)
    sums = prefix(span(prefix(BYTE[data], BASE), start, end, BASE), WORD_BASE)
    return row, np.searchsorted(row, np.arange(len(offs))), sums


def segments(batch, hot):
    """Windows by anchor. Texts are cut into blocks of BLOCK words that don't overlap; these are the index.

    Every window holds ROW blocks in a row with their keys. Of those, the leftmost whose hash is least is the
    window's anchor in the index. A probing text doesn't know where the other's blocks start, so it rolls over
    every word: rows of ROW steps of BLOCK words from each word, and of each row the place with the least hash.
    So each window has the index's anchor among its own, and places that are least in no row needn't probe.
    """
    for a, b, data, offs in pieces(batch.column("text")):
        row, first, sums = hashed(data, offs)
        n = len(row)
        keys = batch.column("key").slice(a, b - a).to_numpy(zero_copy_only=False)
        reach = (ROW - 1) * BLOCK
        at = np.arange(max(0, n - reach - KEY + 1))
        at_row = row[at]
        at = at[(at + reach + KEY <= first[at_row + 1]) & (first[at_row + 1] - first[at_row] >= WINDOW)]
        if not len(at):
            continue
        places = np.arange(n - BLOCK + 1)
        order = (span(sums, places, places + BLOCK, WORD_BASE) & ~U((1 << PLACE) - 1)) | places.astype(U)
        least = order[at]
        for k in range(1, ROW):
            least = np.minimum(least, order[at + k * BLOCK])
        anchor = (least & U((1 << PLACE) - 1)).astype(np.int64)
        by = np.lexsort((at, anchor))
        anchor, at = anchor[by], at[by]
        head = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        tail = np.append(head[1:], len(anchor)) - 1
        anchor, lowest, highest = anchor[head], at[head], at[tail]
        own = row[anchor]
        start = np.maximum(lowest - (BLOCK - 1), first[own])
        stop = np.minimum(highest, first[own + 1] - WINDOW)
        some = stop >= start
        anchor, start, stop, own = anchor[some], start[some], stop[some], own[some]
        count = stop - start + 1
        index = (anchor - first[own]) % BLOCK == 0
        h = span(sums, anchor, anchor + KEY, WORD_BASE)
        # equal segments must have equal anchors in them, so the anchor's place is part of what is hashed
        s = span(sums, start, stop + WINDOW, WORD_BASE) ^ h ^ ((anchor - start).astype(U) << U(56))
        rows = {"h": (h >> U(32)).astype(np.int64), "s": s, "key": keys[own], "start": start - first[own], "n": count | (index.astype(np.int64) << 7)}
        yield routing.spread(rows, hot, lambda of, step: span(sums, start[of] + step, start[of] + step + WINDOW, WORD_BASE), index=1)


def content(text: bytes, start: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Hashes of the asked windows, from the words of the whole text."""
    _, _, sums = hashed(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    n = n & 127
    first = np.cumsum(n) - n
    at = np.arange(int(n.sum())) + np.repeat(start - first, n)
    got = span(sums, at, at + WINDOW, WORD_BASE)
    return [got[a : a + k].tobytes() for a, k in zip(first.tolist(), n.tolist())]


def compare(rows, blobs):
    """Hits extended: windows with a common anchor that are equal over all their words, against the smallest text."""
    n = rows["n"]
    window = np.frombuffer(b"".join(blobs), U)
    key = np.repeat(rows["key"], n)
    start = np.arange(len(window)) + np.repeat(rows["start"] - np.cumsum(n) + n, n)
    order = np.argsort(window)
    w = window[order]
    head = np.append(True, w[1:] != w[:-1])
    least = np.minimum.reduceat(key[order], np.flatnonzero(head))
    later = order[key[order] > least[np.cumsum(head) - 1]]
    yield key[later], start[later], np.ones(len(later), np.int64)


def covered_words(total: int, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    gone = np.zeros(total + 1, np.int64)
    np.add.at(gone, start, 1)
    np.add.at(gone, start + n + WINDOW - 1, -1)
    return np.cumsum(gone[:-1]) > 0


def _kept(text: bytes, runs) -> tuple[int, int, bytes]:
    parts = text.split()
    gone = covered_words(len(parts), *runs)
    if not gone.any():
        return len(parts), 0, b" ".join(parts)
    return len(parts), int(gone.sum()), b" ".join(p for p, g in zip(parts, gone.tolist()) if not g)


def _digested(batches):
    for b in batches:
        got = [_kept(t, routing.runs_of(r)) for t, r in zip(routing.unzipped(b.column("z")), b.column("runs"))]
        out = [pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in got], pa.string())]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *out], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_words(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with keys, and the runs of word windows that a smaller doc_id has too, by key."""
    own = routing.keyed(docs)
    return own, routing.repeats(own, segments, content, compare, by_text=True)


def dedup_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 after removing words of 50-word windows that a smaller doc_id has.

    Null texts have no words; texts under 50 words lose nothing. Rows with one doc_id and different texts are
    different documents, ordered by a hash; equal rows are one document and get its result each, so that they
    don't remove each other; null doc_ids come last. Other columns are ignored; an empty table gives no rows.
    """
    own, marks = repeated_words(docs.select("doc_id", "text"))
    return routing.with_marks(own, marks).select("doc_id", "z", "runs").mapInArrow(_digested, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame) -> DataFrame:
    """docs without the repeated words of text, kept words joined by one space; other columns as they were."""
    plain, names = routing.renamed(docs)
    own, marks = repeated_words(plain)
    return routing.with_all(docs, own, names, marks, lambda text, runs: _kept(text, runs)[2].decode("utf-8", "ignore"))
