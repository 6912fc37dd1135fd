"""SimHash near-dedup by the generalised pigeonhole principle."""

from __future__ import annotations

from hashlib import sha256
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import BASE, BYTE, U, WORD_BASE, mix, pieces, prefix, span, utf8, words
from graphloom.llm.routing import keyed, renamed
from graphloom.operators.components import components
from graphloom.session import discard, materialize, scratch

BITS = 64
#: Numbers of partitions that are weighed against each other, up to radius + 1.
PARTITIONS = range(1, 14)
#: What a signature that is written, dealt out and sorted costs, in comparisons of two fingerprints.
SIGNATURE = 2000.0
#: Fingerprints with one signature beyond which the bucket is split again by bits that its signature leaves free.
CROWDED = 4096
LEVELS = 3
SEED = 42


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of every shingle of size words, repeats included; fewer words are one shingle, none has none."""
    flat = b" ".join(text.lower().split())  # bytes.lower() and split() know ASCII alone
    if not flat:
        return np.zeros(0, U)
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    start, end = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(flat)]
    if len(start) <= size:
        return np.array([xxhash.xxh64_intdigest(flat, SEED)], U)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(flat[a:b], SEED) for a, b in zip(start, end[size - 1 :])), U, len(start) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    total = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes)).view(">u8")[0])


def _fingerprints(batches, size):
    for batch in batches:
        flat, offs = utf8(batch.column("text"))
        whole = memoryview(flat)
        got = np.array([fingerprint(shingle_hashes(bytes(whole[a:b]), size)) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())], U)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, fp) of every whole text, fp as a signed long; null and empty texts have 0."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _fingerprints(it, size), "doc_id long, fp long")


def _moments(batches):
    total, n = np.zeros((BITS, BITS)), 0
    for b in batches:
        fp = b.column("fp").to_numpy(zero_copy_only=False).view(U)
        for k in range(0, len(fp), 1 << 16):
            x = ((fp[k : k + (1 << 16), None] >> np.arange(BITS, dtype=U)) & U(1)).astype(np.float32) * 2 - 1
            total += (x.T @ x).astype(np.float64)
            total[np.diag_indices(BITS)] += x.sum(0) - len(x)  # the diagonal holds the sums of the bits themselves
            n += len(x)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(total.ravel(), n))], ["i", "x"])


def moments(nodes: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of fingerprints, mean of each bit as -1 or 1, and mean product of each two, over all of them."""
    rows = nodes.select("fp").mapInArrow(_moments, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()  # 4097 rows
    flat = np.zeros(BITS * BITS + 1)
    for r in rows:
        flat[r["i"]] = r["x"]
    n = max(1.0, flat[-1])
    product = flat[:-1].reshape(BITS, BITS) / n
    mean = np.diag(product).copy()
    product[np.diag_indices(BITS)] = 1.0
    return int(flat[-1]), mean, product


def grouped_bits(mean: np.ndarray, product: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of like width; each takes the free bit that is most correlated with those it has."""
    cov = np.abs(product - np.outer(mean, mean))
    np.fill_diagonal(cov, 0)
    free, out = set(range(BITS)), []
    for p in range(parts):
        width = len(free) // (parts - p)
        own = [max(sorted(free), key=lambda b: cov[b, sorted(free)].sum())]
        free.remove(own[0])
        while len(own) < width:
            best = max(sorted(free), key=lambda b: cov[b, own].sum())
            own.append(best)
            free.remove(best)
        out.append(own)
    return out


def agreement(mean: np.ndarray, product: np.ndarray, bits: list[int]) -> float:
    """Estimated share of pairs that agree in all bits: a chain over the bits, each given the one before."""
    one = lambda b: (1 + mean[b] ** 2) / 2
    both = lambda b, c: max((1 + mean[b] ** 2 + mean[c] ** 2 + product[b, c] ** 2) / 4, 1e-9)
    share = one(bits[0])
    for b, c in zip(bits, bits[1:]):
        share *= min(1.0, both(b, c) / one(b))
    return share


def allocate(n: int, mean: np.ndarray, product: np.ndarray, radius: int) -> list[tuple[list[int], int]]:
    """Partitions of the bits and a threshold for each, unequal where that makes fewer candidates.

    Fingerprints within radius agree up to threshold t in at least one of m partitions if the thresholds sum to
    radius - m + 1; t = -1 leaves a partition out. For each m, dynamic programming over partitions and the sum so
    far finds the thresholds with the least estimated cost: signatures written plus pairs compared.
    """
    best: tuple[float, list] = (np.inf, [])
    n = max(n, 1000)  # few fingerprints would make any number of signatures look cheap
    for m in PARTITIONS:
        if m > radius + 1:
            break
        parts, goal = grouped_bits(mean, product, m), radius - m + 1
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for own in parts:
            share, grown = agreement(mean, product, own), {}
            for done, (cost, chosen) in table.items():
                for t in range(-1, min(len(own) // 2, radius) + 1):  # half of the bits stay, so that no bucket holds all
                    ways = comb(len(own), t) if t >= 0 else 0
                    more = cost + ways * (SIGNATURE * n + n * n / 2 * share ** ((len(own) - t) / len(own)))
                    if more < grown.get(done + t, (np.inf,))[0]:
                        grown[done + t] = (more, [*chosen, t])
            table = grown
        if goal in table and table[goal][0] < best[0]:
            best = (table[goal][0], list(zip(parts, table[goal][1])))
    return best[1]


def masks(plan: list[tuple[list[int], int]]) -> list[int]:
    """The bits of each signature: a partition without every choice of as many bits as its threshold."""
    out = []
    for bits, t in plan:
        if t >= 0:
            out += [sum(1 << b for b in bits if b not in gone) for gone in map(set, combinations(bits, t))]
    return out


def _signed(batches, wanted):
    for b in batches:
        fp = b.column("fp").to_numpy(zero_copy_only=False).view(U)
        band = b.column("band").to_numpy(zero_copy_only=False).astype(np.int64).view(U)
        for i, mask in enumerate(wanted):
            sig = mix((fp & U(mask)) ^ mix(np.full(len(fp), i + 1, U)) ^ mix(band + U(77)))
            yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(np.full(len(fp), mask, U).view(np.int64)), b.column("fp"), b.column("rep"), b.column("weight")], ["sig", "used", "fp", "rep", "weight"])


def _split(batches, radius):
    """A crowded bucket dealt out again: of radius + 1 parts of its free bits, two fingerprints within radius share one."""
    for b in batches:
        sig, used, fp = (b.column(c).to_numpy(zero_copy_only=False).view(U) for c in ("sig", "used", "fp"))
        for mask in np.unique(used):
            own = np.flatnonzero(used == mask)
            free = [i for i in range(BITS) if not int(mask) >> i & 1]
            for k in range(radius + 1):
                part = sum(1 << i for i in free[k :: radius + 1])
                new = mix(sig[own] ^ mix((fp[own] & U(part)) + U(k)))
                rows = b.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64)), pa.array(np.full(len(own), int(mask) | part, U).view(np.int64)), rows.column("fp"), rows.column("rep"), rows.column("weight")], ["sig", "used", "fp", "rep", "weight"])


def by_signature(batches, columns):
    """Whole buckets, several at a time, of batches that come sorted by signature."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
        if rest is not None:
            now = {c: np.concatenate([rest[c], now[c]]) for c in columns}
        cut = int(np.searchsorted(now["sig"], now["sig"][-1], "left"))
        if cut:
            yield {c: v[:cut] for c, v in now.items()}
        rest = {c: v[cut:] for c, v in now.items()}
    if rest is not None and len(rest["sig"]):
        yield rest


def _forest(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is within radius in one bucket: a search from each, over those not yet reached."""
    free, a, b = np.arange(len(fp)), [], []
    while len(free) > 1:
        todo, free = [int(free[0])], free[1:]
        while todo and len(free):
            i = todo.pop()
            near = np.bitwise_count(fp[free] ^ fp[i]) <= radius
            found = free[near]
            if len(found):
                a.append(np.full(len(found), i))
                b.append(found)
                todo += found.tolist()
                free = free[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def near_in_buckets(got: dict[str, np.ndarray], radius: int, small: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Links within radius in each bucket, fewer than it has rows wherever many are near each other."""
    sig, fp = got["sig"], got["fp"].view(U)
    head = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
    size = np.diff(np.append(head, len(sig)))
    left, right = [], []
    for h, s in zip(head[size > small].tolist(), size[size > small].tolist()):
        a, b = _forest(fp[h : h + s], radius)
        left.append(a + h)
        right.append(b + h)
    rows = np.flatnonzero(np.repeat((size > 1) & (size <= small), size))
    end = np.repeat(head + size, size)
    step = 1
    while len(rows := rows[rows + step < end[rows]]):
        near = rows[np.bitwise_count(fp[rows] ^ fp[rows + step]) <= radius]
        left.append(near)
        right.append(near + step)
        step += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _stars(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links a-b made into stars around the first of each connected set."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        was = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == was).all():
            break
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def _linked(batches, radius):
    for got in by_signature(batches, ("sig", "fp", "rep")):
        node, root = _stars(len(got["sig"]), *near_in_buckets(got, radius))
        if len(node):
            yield pa.RecordBatch.from_arrays([pa.array(got["rep"][node]), pa.array(got["rep"][root])], ["a", "b"])


def buckets(nodes: DataFrame, radius: int) -> DataFrame:
    """(sig, used, fp, rep, weight): nodes (fp, rep, weight, band) under each of their signatures, crowded ones split.

    Two nodes of one band whose fingerprints are within radius share a signature. Written as a table.
    """
    wanted = masks(allocate(*moments(nodes), radius))
    shape = "sig long, used long, fp long, rep long, weight long"
    rows = materialize(nodes.mapInArrow(lambda it: _signed(it, wanted), shape), "signatures")
    for _ in range(LEVELS):
        crowded = rows.groupBy("sig").count().where(F.col("count") > CROWDED).select("sig")
        if crowded.isEmpty():
            break
        again = rows.join(crowded, "sig", "left_semi").mapInArrow(lambda it: _split(it, radius), shape)
        rows = materialize(rows.join(crowded, "sig", "left_anti").unionByName(again), "signatures")
    return rows


def near_groups(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, component_id) of (doc_id, fp): the smallest doc_id that links of at most radius bits reach from a fingerprint.

    Only different fingerprints are compared, each with its smallest doc_id. Rows whose doc_id is null link
    nothing. Repeated rows are linked as equal fingerprints are.
    """
    nodes = materialize(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")).select("fp", "rep", F.lit(0).cast("long").alias("weight"), F.lit(0).cast("long").alias("band")), "nodes")
    rows = buckets(nodes, radius)
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = rows.select("sig", "fp", "rep").repartition(parts, "sig").sortWithinPartitions("sig").mapInArrow(lambda it: _linked(it, radius), "a long, b long")
    found = components(links)
    return nodes.join(found, nodes["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))


def near_dedup(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs.

    Null and empty texts have the fingerprint zero, linked like any other; a text of fewer words than size is one
    shingle; other columns are ignored; an empty table gives no rows.
    """
    with scratch(docs.sparkSession) as scope:
        prints = materialize(fingerprints(docs, size), "fingerprints")
        roots = scope.keep(materialize(near_groups(prints, radius), "roots"), prints)
    groups = prints.join(roots, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies by similarity: fingerprints propose most links, prefixes of shingle sets the rest, and the sets decide.

#: Nearest partners of smaller doc_id that a text proposes in each bucket of fingerprints; partners of any doc_id that it
#: proposes first under a shared shingle of many texts, and how many times as many in each round after.
FEW = 2
MORE = 8
#: Bytes of a text's parities at most that are dealt out with each shingle of many texts.
SKETCH = 512
#: Texts, about, whose shingles are counted to tell common ones, and how often a common one occurs there at least.
SAMPLE, COMMON = 50_000, 2
#: Common shingles at most that are sent to all tasks.
MOST_COMMON = 1 << 20
#: Texts with one shingle in their prefixes up to which all pairs are candidates at once. Of more, neighbours by size
#: are compared first, and the rest when those have joined groups.
CHAIN = 64
#: Texts with one shingle in their prefixes beyond which these are dealt out again by a second shingle.
HOT = 2048
#: Different texts are compared where their counts of shingles are within a factor of 4, or close to it.
BAND = 4.0
#: Candidate pairs that are held at once, and rows of bits.
HELD = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def all_shingles(data: np.ndarray, offs: np.ndarray, *sizes: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size the hash and the row of every shingle, repeats included, rows ascending; fewer words are one shingle."""
    low = LOWER[data]
    start, end, row = words(low, offs)
    sums = prefix(span(prefix(BYTE[low], BASE), start, end, BASE), WORD_BASE)
    first = np.searchsorted(row, np.arange(len(offs)))
    last, at, out = first[row + 1], np.arange(len(row)), []
    for size in sizes:
        head = at[(at + size <= last) | (at == first[row])]
        out.append((span(sums, head, np.minimum(head + size, last[head]), WORD_BASE), row[head]))
    return out


def as_sets(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's different hashes in ascending order, one row after another, and the offsets of the n rows."""
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1]))[: len(row)]
    return hashes[new], np.searchsorted(row[new], np.arange(n + 1))


def all_fingerprints(hashes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Fingerprint of each of n rows from the hashes of its shingles."""
    total, count = np.zeros((n, BITS), np.int64), np.bincount(row, minlength=n)
    for k in range(0, len(row), 1 << 16):
        r = row[k : k + (1 << 16)]
        heads = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        bits = np.unpackbits(hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total[r[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    return np.packbits(2 * total > count[:, None], axis=1).view(">u8").ravel().astype(U)


def _profile(batches, size, print_size):
    for batch in batches:
        for a, b, data, offs in pieces(batch.column("text")):
            (own, row), (small, small_row) = all_shingles(data, offs, size, print_size)
            sets, ends = as_sets(own, row, b - a)
            flat, at = memoryview(sets.view(np.uint8)), ends.tolist()
            alike = [sha256(flat[8 * x : 8 * y]).digest()[:16] for x, y in zip(at, at[1:])]
            fp = all_fingerprints(small, small_row, b - a).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(alike, pa.binary()), pa.array(fp), pa.array(np.diff(ends))], ["doc_id", "alike", "fp", "weight"])


def _proposed(batches, radius, similarity):
    """(a, b, gap): of each row in each bucket, the FEW nearest rows of smaller rep within radius, of sizes that allow the similarity."""
    for got in by_signature(batches, ("sig", "fp", "rep", "weight")):
        fp, rep, weight = got["fp"].view(U), got["rep"], got["weight"]
        order = np.lexsort((rep, got["sig"]))
        sig = got["sig"][order]
        head = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        size = np.diff(np.append(head, len(sig)))
        fp, rep, weight = fp[order], rep[order], weight[order]
        out = []
        # small buckets side by side, one distance in their order at a time
        rows, end, step = np.flatnonzero(np.repeat((size > 1) & (size <= 64), size)), np.repeat(head + size, size), 1
        while len(rows := rows[rows + step < end[rows]]):
            out.append((rows + step, rows))
            step += 1
        if out:
            yield _nearest(*(np.concatenate(x) for x in zip(*out)), fp, rep, weight, radius, similarity)
        for h, s in zip(head[size > 64].tolist(), size[size > 64].tolist()):
            for k in range(h, h + s, step := max(1, HELD // s)):
                i, j = np.meshgrid(np.arange(k, min(k + step, h + s)), np.arange(h, min(k + step, h + s)), indexing="ij")
                yield _nearest(i[j < i], j[j < i], fp, rep, weight, radius, similarity)


def _nearest(i, j, fp, rep, weight, radius, similarity):
    gap = np.bitwise_count(fp[i] ^ fp[j]).astype(np.int64)
    ok = (gap <= radius) & (np.minimum(weight[i], weight[j]) >= similarity * np.maximum(weight[i], weight[j])) & (rep[i] != rep[j])
    i, j, gap = i[ok], j[ok], gap[ok]
    order = np.lexsort((rep[j], gap, i))
    i, j, gap = i[order], j[order], gap[order]
    head = np.flatnonzero(np.append(True, i[1:] != i[:-1]))[: len(i)]
    near = np.arange(len(i)) - np.repeat(head, np.diff(np.append(head, len(i)))) < FEW
    return pa.RecordBatch.from_arrays([pa.array(x[near]) for x in (rep[i], rep[j], gap)], ["a", "b", "gap"])


def _sets(batches, size):
    for b in batches:
        for x, y, data, offs in pieces(b.column("text")):
            ((own, row),) = all_shingles(data, offs, size)
            sets, ends = as_sets(own, row, y - x)
            flat, ends = memoryview(sets.view(np.uint8)), ends.tolist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(x, y - x), pa.array([bytes(flat[8 * p : 8 * q]) for p, q in zip(ends, ends[1:])], pa.binary())], ["doc_id", "shingles"])


def _counted(batches, size):
    for b in batches:
        for x, y, data, offs in pieces(b.column("text")):
            ((own, row),) = all_shingles(data, offs, size)
            token, n = np.unique(as_sets(own, row, y - x)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], ["sig", "n"])


def common_shingles(docs: DataFrame, rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts of a sample have, in ascending order, and their counts there.

    They only set the order of the prefixes: any order finds the same pairs, this one in smaller buckets.
    """
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, rows // SAMPLE))) == 0)
    counts = some.mapInArrow(lambda it: _counted(it, size), "sig long, n long").groupBy("sig").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    got = counts.orderBy(F.desc("n"), "sig").limit(MOST_COMMON).toArrow()
    sig, n = got.column("sig").to_numpy().view(U), got.column("n").to_numpy()
    order = np.argsort(sig)
    return sig[order], n[order]


def prefix_length(n, similarity: float):
    """Shingles of n, from the front of an order that all sets share, of which similar sets have one in common."""
    return n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1


def parities(own: np.ndarray) -> bytes:
    """A bit for each value of the low bits of a set's hashes: whether an odd number has it; four bits or more a hash.

    Two sets' bits differ in no more places than the sets do in members, also after folding() to fewer bits.
    """
    size = 1 << max(8, (4 * len(own) - 1).bit_length())
    return np.packbits((np.bincount((own & U(size - 1)).astype(np.int64), minlength=size) & 1).astype(bool)).tobytes()


def folding(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _possible(batches, similarity):
    """(a, b): pairs whose sets may be similar, by their sizes and the places where their parities differ."""
    for b in batches:
        keep = []
        for x, y, n, m in zip(b.column("pa"), b.column("pb"), b.column("wa").to_pylist(), b.column("wb").to_pylist()):
            u, v = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
            size = min(len(u), len(v))
            apart = int(np.bitwise_count(folding(u, size) ^ folding(v, size)).sum())
            keep.append((n + m - apart) / 2 >= similarity / (1 + similarity) * (n + m) - 1e-9)
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _prefixes(batches, size, similarity, token, count):
    """(rep, label, weight, parity, sigs): of each text's set the front and one shingle more, rare ones first, then by hash."""
    for b in batches:
        for x, y, data, offs in pieces(b.column("text")):
            ((own, row),) = all_shingles(data, offs, size)
            own, ends = as_sets(own, row, y - x)
            weight = np.diff(ends)
            parity = pa.array([parities(own[p:q]) for p, q in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())
            row = np.repeat(np.arange(y - x), weight)
            often = np.zeros(len(own), np.int64)
            if len(token):
                at = np.minimum(np.searchsorted(token, own), len(token) - 1)
                often = np.where(token[at] == own, count[at], 0)
            own = own[np.lexsort((own, often, row))]
            some = np.arange(len(own)) - ends[row] <= prefix_length(weight, similarity)[row]
            bounds = np.searchsorted(row[some], np.arange(y - x + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(own[some].view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(x, y - x), b.column("label").slice(x, y - x), pa.array(weight), parity, lists], ["rep", "label", "weight", "parity", "sigs"])


def _twice(batches):
    """(sig, rep, label, weight, place, sketch): each text under pairs of a hot shingle and any other of its prefix."""
    for b in batches:
        out = []
        for rep, label, weight, sketch, sigs, hot in zip(*(b.column(c).to_pylist() for c in ("rep", "label", "weight", "sketch", "sigs", "hot"))):
            sigs = np.array(sigs, np.int64)
            for x in np.flatnonzero(np.isin(sigs, hot)).tolist():
                other = np.flatnonzero(np.arange(len(sigs)) != x)
                low, high = np.minimum(sigs[other], sigs[x]).view(U), np.maximum(sigs[other], sigs[x]).view(U)
                sig = mix(low ^ mix(high + U(BASE)))
                out.append((sig.view(np.int64), *(np.full(len(other), v, np.int64) for v in (rep, label, weight)), np.minimum(other, x), [sketch] * len(other)))
        if out:
            *flat, sketches = zip(*out)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in flat), pa.array([x for c in sketches for x in c], pa.binary())], ["sig", "rep", "label", "weight", "place", "sketch"])


def _sketches(batches):
    for b in batches:
        bits = (folding(np.frombuffer(x.as_buffer(), np.uint8), SKETCH).tobytes() for x in b.column("parity"))
        yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(list(bits), pa.binary())], ["rep", "sketch"])


class Sketches:
    """Parities of rows, folded to each length that one of them has, to tell how far sets are apart at least."""

    def __init__(self, rows: np.ndarray):
        self.size, self.folded = np.fromiter(map(len, rows), np.int64, len(rows)), {}
        sizes = np.unique(self.size).tolist()
        for least in sizes:
            x = np.zeros((len(rows), least), np.uint8)
            for n in (n for n in sizes if n >= least):
                own = np.flatnonzero(self.size == n)
                x[own] = np.bitwise_xor.reduce(np.frombuffer(b"".join(rows[own]), np.uint8).reshape(len(own), -1, least), axis=1)
            self.folded[least] = x.view(U)

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Places where the parities of rows i and j differ: their sets differ in as many members or more."""
        out = np.zeros(len(i), np.int64)
        least = np.minimum(self.size[i], self.size[j])
        for size, x in self.folded.items():
            own = np.flatnonzero(least == size)
            for k in range(0, len(own), 1 << 14):
                at = own[k : k + (1 << 14)]
                out[at] = np.bitwise_count(x[i[at]] ^ x[j[at]]).sum(1)
        return out


def _closest(bucket, rep, a, b, gap, few):
    """Of different pairs of rows a and b of one bucket each, which are among the `few` of the least gap of either text there."""
    end, other, pair = np.concatenate([a, b]), np.concatenate([b, a]), np.tile(np.arange(len(a)), 2)
    order = np.lexsort((rep[other], gap[pair], rep[end], bucket[end]))
    end, pair = end[order], pair[order]
    head = np.flatnonzero(np.append(True, (rep[end][1:] != rep[end][:-1]) | (bucket[end][1:] != bucket[end][:-1])))[: len(end)]
    near = np.arange(len(end)) - np.repeat(head, np.diff(np.append(head, len(end)))) < few
    return np.isin(np.arange(len(a)), pair[near])


MET = "a long, b long, weight long, place long"


def _sharing(batches, similarity, most, chain, few=None):
    """(a, b, weight, place): pairs of different labels that may be similar, of prefixes sorted by shingle and size of set.

    The first common shingle of two sets, in the shared order, leaves them no more in common than either has from there
    on; so a pair whose overlap would need more is left to its first common shingle, where it passes if it is similar.
    Pairs have a place of -1. A shingle of more than `most` texts of different labels isn't paired, or with chain only
    by neighbours; each of its texts comes as (rep, shingle, weight, place).

    With few, batches have a sketch of each text, and pairs whose sketches tell that they can't be similar are none. Each
    text then has its `few` closest partners under a shingle, so that pairs are no more than `few` times the rows; texts
    of pairs that are held back come as (rep, shingle, weight, -2 - place), to be met again.
    """

    def pairs(rep, left, right):
        a, b = (np.concatenate(x) for x in (left, right))
        both = np.unique(np.stack([np.maximum(rep[a], rep[b]), np.minimum(rep[a], rep[b])], 1), axis=0)
        return pa.RecordBatch.from_arrays([*(pa.array(both[:, k].copy()) for k in range(2)), *(pa.array(np.full(len(both), x)) for x in (0, -1))], ["a", "b", "weight", "place"])

    def closest(left, right, back):
        """Pairs without repeats that are kept now; rows of the others are marked in back."""
        a, b = (np.concatenate(x) for x in (left, right))
        a, b = np.where(rep[a] > rep[b], a, b), np.where(rep[a] > rep[b], b, a)
        _, first = np.unique(np.stack([bucket[a], rep[a], rep[b]], 1), axis=0, return_index=True)
        a, b = a[first], b[first]
        kept = _closest(bucket, rep, a, b, sketches.apart(a, b), few)
        back[a[~kept]] = back[b[~kept]] = True
        return [a[kept]], [b[kept]]

    for got in by_signature(batches, ("sig", "rep", "label", "weight", "place", *["sketch"] * (few is not None))):
        sig, rep, label, weight = (got[c] for c in ("sig", "rep", "label", "weight"))
        rest = weight - got["place"]
        head = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        size = np.diff(np.append(head, len(sig)))
        mixed = np.minimum.reduceat(label, head) != np.maximum.reduceat(label, head)
        hot = np.repeat(mixed & (size > most), size)
        if hot.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[hot]) for x in (rep, sig, weight, got["place"])], ["a", "b", "weight", "place"])
        bucket, back = np.repeat(np.arange(len(head)), size), np.zeros(len(sig), bool)
        sketches = None if few is None else Sketches(got["sketch"])
        rows, end, step = np.flatnonzero(np.repeat(mixed, size) & (chain | ~hot)), np.repeat(head + size, size), 1
        left, right, held = [], [], 0
        while len(rows := rows[rows + step < end[rows]]):
            rows = rows[weight[rows] >= similarity * weight[rows + step] - 1e-9]  # partners further on are larger still
            other = rows + step
            need = np.ceil(similarity / (1 + similarity) * (weight[rows] + weight[other]) - 1e-9)
            ok = (label[rows] != label[other]) & (np.minimum(rest[rows], rest[other]) >= need)
            if few is not None:
                some = np.flatnonzero(ok)
                i, j = rows[some], other[some]
                ok[some] = (weight[i] + weight[j] - sketches.apart(i, j)) / 2 >= similarity / (1 + similarity) * (weight[i] + weight[j]) - 1e-9
            left.append(rows[ok])
            right.append(other[ok])
            held += len(left[-1])
            if held > HELD and few is not None:
                left, right = closest(left, right, back)
                held = 2 * len(left[0])
            if held > HELD:
                yield pairs(rep, left, right)
                left, right, held = [], [], 0
            if step == 1:
                rows = rows[~hot[rows]]
            step += 1
        if held and few is not None:
            left, right = closest(left, right, back)
        if held:
            yield pairs(rep, left, right)
        if back.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[back]) for x in (rep, sig, weight, -2 - got["place"])], ["a", "b", "weight", "place"])


def _similar(batches, similarity):
    for b in batches:
        keep = []
        for x, y in zip(b.column("sa"), b.column("sb")):
            u, v = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
            both = len(np.intersect1d(u, v, True))
            keep.append(both >= similarity * (len(u) + len(v) - both) - 1e-9)
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def sharing_pairs(fronts: DataFrame, similarity: float, verified, links: DataFrame) -> DataFrame:
    """links, and those between all pairs of different groups whose prefixes meet and whose sizes and places allow the similarity.

    verified(pairs) are the similar ones of (a, b). First come all pairs of a shingle in the prefixes of at most CHAIN
    texts, and of other shingles the neighbours by size. Then, under these, each text proposes its FEW closest partners of
    other groups, by sketches that say of which pairs the sets can't be similar; the texts of pairs that were held back meet
    again after the groups have grown, with MORE times as many partners, until no pair is held back. So rows grow with
    the texts' prefixes, not with the square of a group, unless very many pairs are close to the similarity but not over it.

    A shingle of more than HOT such texts is joined with a second one of each text's prefix, one place longer: similar sets
    of two shingles or more have two in common there. So no task compares all texts of a hot shingle; and sets of one
    shingle are only similar if equal, which makes them one text here.
    """
    parts = int(fronts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def met(rows, most, chain=False, few=None):
        found = rows.repartition(parts, "sig").sortWithinPartitions("sig", "weight").mapInArrow(lambda it: _sharing(it, similarity, most, chain, few), MET)
        found = materialize(found, "met")
        back = found.select(F.col("a").alias("rep"), F.col("b").alias("sig"), "weight", "place")
        return found.where("place = -1").select("a", "b").distinct(), back.where("place >= 0"), back.where("place < -1").withColumn("place", -2 - F.col("place"))

    front = F.col("weight") - F.ceil(F.col("weight") * F.lit(similarity) - 1e-9) + 1
    own = fronts.select("rep", "label", "weight", F.posexplode(F.slice("sigs", F.lit(1), front.cast("int"))).alias("place", "sig"))
    pairs, left, _ = met(own.select("sig", "rep", "label", "weight", F.col("place").cast("long").alias("place")), CHAIN, True)
    links = links.unionByName(verified(pairs))
    if left.isEmpty():
        return links
    sketches = fronts.join(left.select("rep").distinct(), "rep", "left_semi").select("rep", "parity").mapInArrow(_sketches, "rep long, sketch binary")
    sketches = materialize(sketches, "sketches")

    def labelled(rows, labels):
        rows = rows.join(labels, F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("component", "rep")).drop("node", "component")
        return rows.join(sketches, "rep")

    shape = ["sig", "rep", "label", "weight", "place", "sketch"]
    few, every = FEW, 1 << 62
    labels = materialize(components(links), "labels")
    pairs, hot, left = met(labelled(left, labels).select(shape), HOT, few=few)
    hot = materialize(hot.groupBy("rep").agg(F.collect_list("sig").alias("hot")), "hot")  # a text's prefix at most
    if not hot.isEmpty():
        again = labelled(fronts.select("rep", "weight", "sigs").join(hot, "rep"), labels)
        more, _, late = met(again.mapInArrow(_twice, "sig long, rep long, label long, weight long, place long, sketch binary"), every, few=few)
        pairs, left = pairs.unionByName(more).distinct(), left.unionByName(late)
    links = links.unionByName(verified(pairs))
    while not left.isEmpty():
        few *= MORE
        labels = materialize(components(links), "labels")
        pairs, _, left = met(labelled(left, labels).select(shape), every, few=few)
        links = links.unionByName(verified(pairs))
    return links


def near_copies(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, first): for each row the smallest doc_id of its group of near copies; see grouped() for groups and arguments.

    Rows with a null doc_id have a null first and no part in any group. Rows of one doc_id and different texts are
    different documents, ordered by a hash; equal rows are copies. Other columns are ignored; an empty table gives no rows.
    """
    own = keyed(docs.where("doc_id is not null").select("doc_id", "text"))
    found = grouped(own.select(F.col("key").alias("doc_id"), "text"), repeated_ids=own.odd, **how)
    if own.odd:
        names = own.select("key", F.col("doc_id").alias("name")).distinct()
        found = found.join(names, found["doc_id"] == names["key"]).select(F.col("name").alias("doc_id"), "first")
        names = names.select(F.col("key").alias("key2"), F.col("name").alias("name2"))
        found = found.join(names, found["first"] == names["key2"]).select("doc_id", F.col("name2").alias("first"))
    return found.unionByName(docs.where("doc_id is null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("first")))


def grouped(docs: DataFrame, size: int = 5, similarity: float = 0.8, print_size: int = 3, radius: int = 7, repeated_ids: bool = True) -> DataFrame:
    """(doc_id, first) of docs (doc_id, text), an id never null and of one text: the smallest id of each row's group.

    Links join texts whose sets of shingles of size words have a Jaccard similarity of at least `similarity`; sets are
    those of the whole texts, as 64-bit hashes, and texts with equal sets are one from the start. Pairs within radius of
    the fingerprints over print_size words are proposed by generalised pigeonhole, of each text the nearest ones in each
    bucket, and their sets decide: that makes most links. Then all pairs of different groups that may be similar are
    compared: sets put in one shared order have a shingle of their prefixes in common if they are similar, so none is
    missed, whatever its fingerprints; pairs that differ in too many members, by a lower bound, aren't. Null and empty texts are copies of each other alone. repeated_ids: whether an id
    may stand in several rows, of one text.
    """
    with scratch(docs.sparkSession) as scope:
        return scope.keep(materialize(_grouped(docs, size, similarity, print_size, radius, repeated_ids), "firsts"))


def _grouped(docs: DataFrame, size: int, similarity: float, print_size: int, radius: int, repeated_ids: bool) -> DataFrame:
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prints = materialize(docs.mapInArrow(lambda it: _profile(it, size, print_size), "doc_id long, alike binary, fp long, weight long"), "profiles")
    level = lambda x: F.floor(F.log(BAND, x)).cast("long")
    nodes = prints.groupBy("alike").agg(F.min(F.struct("doc_id", "fp", "weight")).alias("x"))
    nodes = materialize(nodes.select("alike", F.col("x.doc_id").alias("rep"), "x.fp", "x.weight"), "texts")
    single = nodes.where("weight > 0").select("rep", "fp", "weight")
    banded = single.withColumn("band", F.explode(F.array_distinct(F.array(level(F.col("weight")), level(F.col("weight") / similarity)))))
    texts = docs.dropDuplicates(["doc_id"]) if repeated_ids else docs

    def similar(pairs):
        ends = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ends")  # of known size, so that Spark may choose the join
        sets = materialize(texts.join(ends, "doc_id", "left_semi").mapInArrow(lambda it: _sets(it, size), "doc_id long, shingles binary"), "shingles")
        both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
        found = materialize(both.select("a", "b", "sa", "sb").mapInArrow(lambda it: _similar(it, similarity), "a long, b long"), "similar")
        discard(sets)
        return found

    rows = buckets(banded, radius)
    told = rows.select("sig", "fp", "rep", "weight").repartition(parts, "sig").sortWithinPartitions("sig").mapInArrow(lambda it: _proposed(it, radius, similarity), "a long, b long, gap long")
    order = Window.partitionBy("a").orderBy("gap", "b")
    near = told.groupBy("a", "b").agg(F.min("gap").alias("gap")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= FEW).select("a", "b")
    near = materialize(near, "near")
    discard(rows)
    links = similar(near)
    labels = materialize(components(links), "labels")

    token, count = common_shingles(docs, prints.count(), size)
    known = single.join(labels, F.col("rep") == labels["node"], "left").select(F.col("rep").alias("doc_id"), F.coalesce("component", "rep").alias("label"))
    known = materialize(known, "known")
    fronts = texts.join(known, "doc_id").mapInArrow(lambda it: _prefixes(it, size, similarity, token, count), "rep long, label long, weight long, parity binary, sigs array<long>")
    fronts = materialize(fronts, "fronts")
    bits = fronts.select("rep", "parity", "weight")

    def verified(pairs):
        for side, p, w in (("a", "pa", "wa"), ("b", "pb", "wb")):
            pairs = pairs.join(bits.select(F.col("rep").alias(side), F.col("parity").alias(p), F.col("weight").alias(w)), side)
        return similar(materialize(pairs.select("a", "b", "pa", "pb", "wa", "wb").mapInArrow(lambda it: _possible(it, similarity), "a long, b long"), "shared"))

    labels = materialize(components(sharing_pairs(fronts, similarity, verified, links)), "labels")
    firsts = nodes.join(labels, nodes["rep"] == labels["node"], "left").select("alike", F.coalesce("component", "rep").alias("first"))
    return prints.join(firsts, "alike", "left").select("doc_id", "first")


def drop_near_copies(docs: DataFrame, **how) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id; rows with a null doc_id stay. Columns stay, whatever their names.

    Of equal (doc_id, text) in several rows, that of the least hash over all columns stays.
    """
    plain, names = renamed(docs)
    own = keyed(plain.where("doc_id is not null"))
    found = grouped(own.select(F.col("key").alias("doc_id"), "text"), repeated_ids=own.odd, **how)
    out = own.join(found.where("doc_id = first").select(F.col("doc_id").alias("id")), F.col("key") == F.col("id"), "left_semi")
    if own.odd:
        plainly = [c for c, kind in plain.dtypes if c in names and "map<" not in kind and "variant" not in kind]
        out = out.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64(*plainly)))).where("place = 1")
    return out.select(names).unionByName(plain.where("doc_id is null").select(names)).toDF(*docs.columns)
