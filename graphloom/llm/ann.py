"""Approximate nearest neighbours by balanced posting lists, for the largest inner product."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.session import materialize, scratch

#: Vectors of a list on average, while that makes no more than MOST lists.
LIST, FEWEST, MOST = 200, 4, 8192
#: Rows that centroids are fitted on, at most: so many, or so many for each list. Every row is indexed.
SAMPLE, PER_LIST = 20_000, 16
#: Queries whose exact neighbours in the whole table calibrate the pruning, and the share of these to be found.
TRIALS, RECALL = 400, 0.93
#: A vector is copied to lists whose squared distance is at most so many times the nearest one's, up to COPIES lists.
BOUNDARY, COPIES = 1.02, 2
#: Rows of a list that one task scores; longer lists are dealt over several.
BLOCK = 8192
NEIGHBOURS = 24
#: Numbers in a matrix of distances or scores that is held at once.
CELLS = 1 << 22


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b, by one product."""
    return np.maximum(np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * a @ b.T, 0.0)


class Lists:
    """Centroids of at most MOST lists, the graph that is walked to find near ones, and the calibrated pruning ratio.

    At most MOST rows of each kind, so it may be broadcast.
    """

    def __init__(self, sample: np.ndarray, largest: float, n: int, seed: int = 1):
        self.largest = largest
        x = self.lifted(sample)
        k = max(1, min(int(np.clip(n // LIST, FEWEST, MOST)), len(x) // 2))
        self.centroids, self.price = self._balanced(x, k, np.random.default_rng(seed))
        near = np.empty((k, min(NEIGHBOURS, k - 1)), np.int64)
        for a in range(0, k, step := max(1, CELLS // k)):
            gap = squared(self.centroids[a : a + step], self.centroids)
            gap[np.arange(len(gap)), np.arange(a, a + len(gap))] = np.inf
            near[a : a + step] = np.argpartition(gap, near.shape[1] - 1, axis=1)[:, : near.shape[1]] if near.shape[1] else near[a : a + step]
        # far links let a walk leave its region; they're a chain over all centroids, so that the graph is connected
        chain = np.stack([np.roll(np.arange(k), 1), np.roll(np.arange(k), -1)], 1)
        self.graph = np.concatenate([near, chain], 1)
        self.entries = np.linspace(0, k - 1, max(1, int(k**0.5))).astype(int)
        self.ratio, self.floor = 1.0, 0.0
        self.sizes = np.zeros(k, np.int64)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """One more component makes all norms equal, so that the nearest has the largest inner product."""
        rest = np.maximum(self.largest - np.einsum("ij,ij->i", x, x), 0.0)
        return np.concatenate([x, np.sqrt(rest)[:, None]], 1)

    def asked(self, q: np.ndarray) -> np.ndarray:
        norm = np.sqrt(np.einsum("ij,ij->i", q, q))[:, None]
        return np.concatenate([q * (self.largest**0.5 / norm), np.zeros((len(q), 1))], 1)

    @staticmethod
    def _balanced(x: np.ndarray, k: int, rng) -> tuple[np.ndarray, np.ndarray]:
        """Centroids by Lloyd's steps, and the price that each list asks: one over the mean size gets dearer to join."""
        c = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
        price = np.zeros(k)
        for _ in range(12):
            near, least = np.empty(len(x), np.int64), 0.0
            for a in range(0, len(x), step := max(1, CELLS // k)):
                d = squared(x[a : a + step], c)
                near[a : a + step] = (d + price).argmin(1)
                least += d[np.arange(len(d)), near[a : a + step]].sum()
            size = np.bincount(near, minlength=k)
            price += 0.05 * least / len(x) * np.clip(size * (k / len(x)) - 1, -1, 2)
            total = np.zeros_like(c)
            np.add.at(total, near, x)
            full = size > 0
            c[full] = total[full] / size[full, None]
        return c, price - price.min()

    def near(self, v: np.ndarray, ratio: float, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (row of v, centroid, squared distance) with distances within ratio of the row's least, by walks of the graph.

        A row whose least distance is below floor is treated as if it were floor.

        A walk opens every centroid it has seen that is within ratio of the best one so far, until none is left. The
        walks of all rows go side by side, a step of all at a time.
        """
        out = []
        for a in range(0, len(v), step := max(1, CELLS // len(self.centroids))):
            out.append(self._walks(v[a : a + step], ratio, floor, a))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def _walks(self, v: np.ndarray, ratio: float, floor: float, first: int):
        c, v, n = self.centroids.astype(np.float32), v.astype(np.float32), len(self.centroids)
        own, norm = np.einsum("ij,ij->i", c, c), np.einsum("ij,ij->i", v, v)
        seen = np.zeros(len(v) * n, bool)
        row, at = np.repeat(np.arange(len(v)), len(self.entries)), np.tile(self.entries, len(v))
        best, found = np.full(len(v), np.inf, np.float32), []
        while len(row):
            seen[row * n + at] = True
            d = np.empty(len(row), np.float32)
            for k in range(0, len(row), 1 << 15):
                r, s = row[k : k + (1 << 15)], at[k : k + (1 << 15)]
                d[k : k + (1 << 15)] = norm[r] + own[s] - 2 * np.einsum("ij,ij->i", v[r], c[s])
            np.maximum(d, 0.0, out=d)
            np.minimum.at(best, row, d)
            near = d <= np.maximum(best[row], floor) * ratio + 1e-12  # what is too far now stays so, since the best only gets nearer
            found.append((row[near], at[near], d[near]))
            key = (row[near, None] * n + self.graph[at[near]]).ravel()
            key = np.unique(key[~seen[key]])
            row, at = key // n, key % n
        row, at, d = (np.concatenate(x) for x in zip(*found))
        near = d <= np.maximum(best[row], floor) * ratio + 1e-12
        return row[near] + first, at[near], d[near]

    def homes(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of v, list) for vectors to index: the cheapest list, and others that the vector lies on the boundary of."""
        row, at, d = self.near(v, BOUNDARY * 1.04)
        cost = d + self.price[at]
        order = np.lexsort((at, cost, row))
        row, at, cost = row[order], at[order], cost[order]
        head = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
        rank = np.arange(len(row)) - np.repeat(head, np.diff(np.append(head, len(row))))
        stays = (rank < COPIES) & (cost <= BOUNDARY * np.repeat(cost[head], np.diff(np.append(head, len(row)))) + 1e-12)
        return row[stays], at[stays]

    def probed(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of q, list): the lists within the ratio, and more for queries whose lists hold too few vectors for k."""
        todo, ratio, out = np.arange(len(q)), self.ratio, []
        while len(todo):
            row, at, _ = self.near(q[todo], ratio, self.floor)
            held = np.bincount(row, self.sizes[at], minlength=len(todo))
            lists = np.bincount(row, minlength=len(todo))
            done = (held >= COPIES * (k + 1)) | (lists == len(self.centroids))
            keep = done[row]
            out.append((todo[row[keep]], at[keep]))
            todo, ratio = todo[~done], ratio * 1.25 if ratio < 1e6 else np.inf
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def least(self, q: np.ndarray) -> np.ndarray:
        """Squared distance of each query to its nearest centroid."""
        asked = self.asked(q)
        return np.concatenate([squared(asked[a : a + 256], self.centroids).min(1) for a in range(0, len(q), 256)])

    def needed(self, q: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """For each row, the least ratio at which the query q finds the vector."""
        row, at = self.homes(self.lifted(vectors))
        gap = self.asked(q)[row] - self.centroids[at]
        d = np.full(len(vectors), np.inf)
        np.minimum.at(d, row, np.einsum("ij,ij->i", gap, gap))
        return (d + 1e-12) / (np.maximum(self.least(q), self.floor) + 1e-12)


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length, without nulls, as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def best_of(query: np.ndarray, other: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best (query, other, score) of each query, ties to the smaller other; a pair that comes twice counts once."""
    order = np.lexsort((other, -score, query))
    query, other, score = query[order], other[order], score[order]
    new = np.append(True, (query[1:] != query[:-1]) | (other[1:] != other[:-1])) if len(query) else np.zeros(0, bool)
    query, other, score = query[new], other[new], score[new]
    head = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(head, np.diff(np.append(head, len(query))))
    return query[rank < k], other[rank < k], score[rank < k]


def above(score: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) that may be among the k + 1 best of their row and reach its floor, which rises to the row's own."""
    if score.shape[1] > k:
        np.maximum(floor, np.partition(score, score.shape[1] - k - 1, axis=1)[:, score.shape[1] - k - 1], out=floor)
    return np.nonzero(score >= (floor - 1e-9 * np.maximum(1.0, np.abs(floor)))[:, None])


def _posted(batches, lists):
    for b in batches:
        if b.num_rows:
            row, home = lists.homes(lists.lifted(matrix(b.column("embedding"))))
            rows = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), rows.column("vec_id"), rows.column("embedding")], ["list", "vec_id", "embedding"])


def _probes(batches, lists, k):
    for b in batches:
        if b.num_rows:
            row, at = lists.probed(lists.asked(matrix(b.column("embedding"))), k)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(row)), pa.array(at.astype(np.int32))], ["vec_id", "list"])


def _trials(batches, lists, own, queries, k):
    """The k nearest of each trial query among a task's rows: (query, other, score, needed ratio)."""
    some = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    kept, floor = {}, np.full(len(own), -np.inf)
    for b in batches:
        v, names = matrix(b.column("embedding")), ids(b.column("vec_id"))
        for a in range(0, len(v), 8192):
            part, name = v[a : a + 8192], names[a : a + 8192]
            score = queries @ part.T
            score[own[:, None] == name[None, :]] = -np.inf
            q, at = above(score, floor, k)
            ok = score[q, at] > -np.inf
            some = list(best_of(*(np.concatenate(x) for x in zip(some, (q[ok], name[at[ok]], score[q, at][ok]))), k))
            kept |= {int(name[i]): part[i] for i in np.unique(at[ok])}
            left = set(some[1].tolist())
            kept = {i: x for i, x in kept.items() if i in left}
    q, other, score = some
    if len(q):
        need = lists.needed(queries[q], np.stack([kept[int(i)] for i in other]))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q, other, score, need)], ["query", "other", "score", "need"])


def _scored(batches, k):
    """Rows sorted by task, then vectors before queries: each query is scored on its lists of the task, a list at a time."""

    def found(rows):
        table = pa.Table.from_batches(rows).combine_chunks()
        kind, lists, own = (ids(table.column(c)) for c in ("query", "list", "vec_id"))
        v = matrix(table.column("embedding").combine_chunks())
        stored, asking = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        if not len(stored) or not len(asking):
            return
        stored = stored[np.argsort(lists[stored], kind="stable")]
        asking = asking[np.argsort(lists[asking], kind="stable")]
        name, number = np.unique(own[asking], return_inverse=True)
        floor = np.full(len(name), -np.inf)
        some = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        wanted, held = [], 0
        for at in np.unique(lists[asking]).tolist():
            s = stored[np.searchsorted(lists[stored], at) : np.searchsorted(lists[stored], at, "right")]
            a, z = np.searchsorted(lists[asking], at), np.searchsorted(lists[asking], at, "right")
            for x in range(a, z if len(s) else a, step := max(1, CELLS // max(1, len(s)))):
                q = asking[x : min(z, x + step)]
                of = number[x : min(z, x + step)]
                score = v[q] @ v[s].T
                least = floor[of]
                i, j = above(score, least, k)
                floor[of] = least
                wanted.append((of[i], own[s[j]], q[i], s[j], score[i, j]))
                held += len(i)
                if held > 1 << 20:
                    some, wanted, held = _exact(some, wanted, v, name, floor, k), [], 0
        some = _exact(some, wanted, v, name, floor, k)
        yield pa.RecordBatch.from_arrays([pa.array(name[some[0]]), pa.array(some[1]), pa.array(some[2])], ["query_id", "vec_id", "score"])

    rows, part = [], None
    for b in batches:
        parts = ids(b.column("part"))
        cuts = np.append(np.flatnonzero(np.append(True, parts[1:] != parts[:-1])), len(parts)) if len(parts) else []
        for x, y in zip(cuts[:-1], cuts[1:]):
            if rows and parts[x] != part:
                yield from found(rows)
                rows = []
            part = parts[x]
            rows.append(b.slice(x, y - x))
    if rows:
        yield from found(rows)


def _exact(some, wanted, v, name, floor, k):
    """some and wanted together, the k best of each query by sums in one fixed order."""
    if not wanted:
        return some
    of, other, q, s, score = (np.concatenate(x) for x in zip(*wanted))
    ok = (score >= floor[of] - 1e-9 * np.maximum(1.0, np.abs(floor[of]))) & (other != name[of])
    of, other, q, s = of[ok], other[ok], q[ok], s[ok]
    score = np.concatenate([(v[s[a : a + 65536]] * v[q[a : a + 65536]]).sum(1) for a in range(0, len(s), 65536)] or [np.zeros(0)])
    return list(best_of(*(np.concatenate(x) for x in zip(some, (of, other, score))), k))


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part, one for each id: the least vector where an id has several.

    Left out are null ids, vectors that are null, empty or zero, that hold null or non-finite components, or
    whose length isn't the commonest one (the smaller of equally common ones).
    """
    kind = embeddings.schema["embedding"].dataType.simpleString()
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind if kind == "array<float>" else "array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    e = e.where("vec_id is not null and embedding is not null and size(embedding) > 0").where(~bad & F.exists("embedding", lambda x: x != 0))
    sizes = e.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return e
    return e.where(F.size("embedding") == sizes["d"]).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def parts_of(order: np.ndarray, sizes: np.ndarray, tasks: int) -> list[tuple[int, int, int]]:
    """(list, blocks, first part): lists dealt to tasks in runs of near ones with about equal vectors, long ones over several."""
    goal, out, part, filled = max(1.0, sizes.sum() / tasks), [], 0, 0.0
    for i in order.tolist():
        blocks = max(1, -(-int(sizes[i]) // BLOCK))
        if filled and (filled + sizes[i] / 2 > goal or blocks > 1):
            part, filled = part + 1, 0.0
        out.append((i, blocks, part))
        if blocks > 1:
            part, filled = part + blocks, 0.0
        else:
            filled += sizes[i]
    return out


def side_by_side(c: np.ndarray) -> np.ndarray:
    """An order of centroids in which near ones stand together: halves by the widest direction, again and again."""

    def halves(own):
        if len(own) <= 2:
            return [own]
        x = c[own] - c[own].mean(0)
        far = x[np.einsum("ij,ij->i", x, x).argmax()]
        own = own[np.argsort(x @ far, kind="stable")]
        return halves(own[: len(own) // 2]) + halves(own[len(own) // 2 :])

    return np.concatenate(halves(np.arange(len(c))))


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by every.

    Lists are fitted on a bounded sample, every row is indexed, and the ratio within which a query's lists are
    scored comes from the exact neighbours, in the whole table, of TRIALS rows. Fewer than k others give all of
    them. Of equal vectors only the k + 1 smallest ids can be among k nearest, so the index holds no more; each
    list is scored in blocks. Repeated rows count once; see usable() for what takes no part; an empty table gives
    no rows; other columns are ignored.
    """
    spark = embeddings.sparkSession
    with scratch(spark) as scope:
        return scope.keep(materialize(_nearest(embeddings, every, k), "nearest"))


def _nearest(embeddings: DataFrame, every: int, k: int) -> DataFrame:
    spark = embeddings.sparkSession
    rows = materialize(usable(embeddings), "vectors")
    shape = "query_id long, rank int, vec_id long, score double"
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(squares).alias("largest")).first()
    if not size["n"]:
        return spark.createDataFrame([], shape)
    limit = min(size["n"], max(SAMPLE, PER_LIST * min(MOST, size["n"] // LIST)))
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(limit).toArrow()  # at most max(SAMPLE, PER_LIST * MOST) rows
    sample, names = matrix(got.column("embedding").combine_chunks()), ids(got.column("vec_id"))
    lists = Lists(sample, size["largest"], size["n"])
    own, queries = names[-TRIALS:], sample[-TRIALS:]
    # copies of one vector make a list of no width; a ratio to its distance would say nothing
    lists.floor = float(np.median(lists.least(queries)))
    carried = spark.sparkContext.broadcast(lists)  # at most MOST centroids, here and below
    kind = dict(rows.dtypes)["embedding"]
    tried = rows.mapInArrow(lambda it: _trials(it, carried.value, own, queries, k), "query long, other long, score double, need double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "other")
    need = [r["need"] for r in tried.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("need").collect()]  # TRIALS * k rows at most
    lists.ratio = float(np.quantile(need, RECALL)) * (1 + 1e-9) if need else 1.0

    few = rows.withColumn("r", F.row_number().over(Window.partitionBy(F.xxhash64("embedding"), "embedding").orderBy("vec_id"))).where(F.col("r") <= k + 1).select("vec_id", "embedding")
    posted = materialize(few.mapInArrow(lambda it: _posted(it, carried.value), f"list int, vec_id long, embedding {kind}"), "postings")
    for r in posted.groupBy("list").count().collect():  # at most MOST rows
        lists.sizes[r["list"]] = r["count"]
    sized = spark.sparkContext.broadcast(lists)
    tasks = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(lists.sizes.sum()) // BLOCK))
    plan = parts_of(side_by_side(lists.centroids), lists.sizes, tasks)
    where = spark.createDataFrame(plan, "list int, blocks int, first int")  # at most MOST rows
    tasks = max(f + b for _, b, f in plan)
    stored = posted.join(F.broadcast(where), "list").select((F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).cast("int").alias("part"), F.lit(0).alias("query"), "list", "vec_id", "embedding")
    asked = rows.where(F.col("vec_id") % every == 0).mapInArrow(lambda it: _probes(it, sized.value, k), "vec_id long, list int")
    by_list = asked.join(F.broadcast(where), "list").select("vec_id", "list", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1)).alias("part"))
    probes = by_list.join(rows, "vec_id").select("part", F.lit(1).alias("query"), "list", "vec_id", "embedding")
    both = stored.unionByName(probes).repartitionById(tasks, "part").sortWithinPartitions("part", "query")
    found = both.mapInArrow(lambda it: _scored(it, k), "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
