"""Top-k recommendation and similarity over factor tables (id, vec, optional bias)."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.work import written

METRICS = ("dot", "cosine", "l2")


def _block_scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        length = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None] + 1e-8
        return q @ x.T / length
    if metric == "l2":
        return -np.maximum(0.0, (q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * (q @ x.T))
    return q @ x.T


def _exact(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Scores of pairs of rows, summed from the first dimension to the last: equal vectors have equal scores wherever they stand."""

    def dot(a, b):
        total = np.zeros(len(a))
        for k in range(a.shape[1]):
            total = total + a[:, k] * b[:, k]
        return total

    if metric == "l2":
        return -dot(q - x, q - x)
    return dot(q, x) / (np.sqrt(dot(q, q)) * np.sqrt(dot(x, x)) + 1e-8) if metric == "cosine" else dot(q, x)


def _margin(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """More than a block's scores can differ from the exact ones, for each query."""
    a, b = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1).max(initial=0.0))
    size = {"dot": a * b, "cosine": a * b / (a * np.sqrt((x * x).sum(1).min(initial=np.inf)) + 1e-8) if len(x) else a, "l2": (a + b) ** 2}[metric]
    return 1e-13 * q.shape[1] * size


_KINDS = {"int": pa.int32(), "string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
_schema = lambda ddl: pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in ddl.split(", ")])
PACKED = "block long, ids binary, vec binary, bias binary, norm double, top double"
ROUTED = "task int, kind string, item long, block long, ids binary, vec binary, bias binary, least binary"
_PACKED, _ROUTED, _FOUND = _schema(PACKED), _schema(ROUTED), _schema("q long, id long, score double")
#: Query blocks that meet an item block in one task, and the most tasks of a search.
TOGETHER, TASKS = 16, 20_000
#: Bytes of item vectors that a task holds at once where every query meets every item, and tasks for each core.
BUNDLE, A_CORE = 64 << 20, 4
#: Bytes of vectors that are put in order together; scores that a task holds at once.
HELD, SCORES = 32 << 20, 2_000_000
#: Pairs left out of a query up to which equal items behind those that it could need are dropped.
LIGHT = 900


def _packed(t: DataFrame, rows: int | None, by_norm: bool) -> DataFrame:
    """Vectors (id, vec, bias) in blocks of one row each, as they stand in partitions, by falling norm or not.

    norm and top: the largest norm and bias of a block. Of a partition ``HELD`` bytes of vectors at a time are put in order.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
                if n * 8 * len(b.column("vec")[0]) >= HELD:
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for t in runs(batches):
            ids, bias, d = t["id"].to_numpy(), t["bias"].to_numpy(), len(t["vec"][0])
            vec = t["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            norm, size = np.sqrt(np.einsum("nd,nd->n", vec, vec)), rows or max(256, min((64 << 20) // (8 * max(1, d)), 5792))
            order = np.lexsort((ids, -norm)) if by_norm else np.arange(len(ids))
            for k in range(0, len(ids), size):
                at = order[k : k + size]
                at = at[np.argsort(ids[at], kind="stable")]
                row = number, ids[at].tobytes(), vec[at].tobytes(), bias[at].tobytes(), norm[at].max(), bias[at].max()
                number += 1
                yield pa.RecordBatch.from_pylist([dict(zip(_PACKED.names, row, strict=True))], _PACKED)

    return t.mapInArrow(pack, PACKED)


class Side:
    """A block in a task; least: what a query's scores must reach, from blocks that it has met."""

    def __init__(self, row: dict, prefix: str = ""):
        self.ids, self.bias, self.least = (np.frombuffer(row.get(prefix + c) or b"", kind) for c, kind in (("ids", np.int64), ("bias", np.float64), ("least", np.float64)))
        self.vec = np.frombuffer(row[f"{prefix}vec"] or b"").reshape(len(self.ids), -1)

    def cut(self, size: int) -> "Iterator[Side]":
        """Blocks of at most ``size`` rows."""
        for k in range(0, len(self.ids), size):
            part = slice(k, k + size)
            yield Side({"ids": self.ids[part].tobytes(), "vec": self.vec[part].tobytes(), "bias": self.bias[part].tobytes(), "least": self.least[part].tobytes()})


def best(q: Side, x: Side, k: int, metric: str, skip_self: bool, seen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q, rows of x and exact scores of what can be among the k best of a query, by query and rank; seen: (q, id) left out."""
    size, found = max(1, SCORES // max(1, len(x.ids))), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for at, part in enumerate(q.cut(size)):
        row, col, score = _best(part, x, k, metric, skip_self, seen)
        found.append((row + at * size, col, score))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _best(q: Side, x: Side, k: int, metric: str, skip_self: bool, seen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bias = q.bias[:, None] + x.bias[None]
    s = _block_scores(q.vec, x.vec, metric) + bias
    if skip_self:
        at = np.minimum(np.searchsorted(x.ids, q.ids), len(x.ids) - 1)
        there = np.flatnonzero(x.ids[at] == q.ids)
        s[there, at[there]] = -np.inf
    if seen is not None:
        order = np.argsort(q.ids, kind="stable")
        row, col = (np.minimum(np.searchsorted(ids, ask), len(ids) - 1) for ids, ask in ((q.ids[order], seen[0]), (x.ids, seen[1])))
        row = order[row]
        there = (q.ids[row] == seen[0]) & (x.ids[col] == seen[1])
        s[row[there], col[there]] = -np.inf
    m = min(k, len(x.ids))
    margin = _margin(q.vec, x.vec, metric) + 1e-13 * np.abs(bias).max()
    least = q.least - margin if len(q.least) else np.full(len(q.ids), -np.inf)
    many = np.flatnonzero((s >= least[:, None]).sum(1) > m)  # only these need their k-th best here
    if len(many):
        least[many] = np.maximum(least[many], -np.partition(-s[many], m - 1, axis=1)[:, m - 1] - margin[many])
    row, col = np.nonzero((s >= least[:, None]) & np.isfinite(s))
    score = np.concatenate([np.zeros(0), *(_exact(q.vec[row[n : n + 1_000_000]], x.vec[col[n : n + 1_000_000]], metric) for n in range(0, len(row), 1_000_000))]) + bias[row, col]
    order = np.lexsort((x.ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < m
    return row[kept], col[kept], score[kept]


def _routed(task: int, kind: str, item: int | None, block: int, *arrays: np.ndarray) -> pa.RecordBatch:
    """A row on its way: results (T), pairs left out (A), an item block (I) or queries (Q)."""
    return pa.RecordBatch.from_pylist([dict(zip(_ROUTED.names, (task, kind, item, block, *(x.tobytes() for x in arrays)), strict=False))], _ROUTED)


def _pairs(a: bytes | None, b: bytes | None) -> np.ndarray | None:
    return None if a is None else np.stack([np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)])


def _left_out(seen: DataFrame, queries: DataFrame, items: DataFrame) -> DataFrame:
    """block (of queries), item, s_ids, s_vec: pairs left out, packed where both sides are."""

    def places(name: str) -> Callable:
        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    ids = np.frombuffer(row["ids"], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), row["block"]))], [name, f"{name}_block"])

        return unpack

    def pack(keys: tuple, t: pa.Table) -> pa.Table:
        row = keys[0].as_py(), keys[1].as_py(), t["q"].to_numpy().tobytes(), t["id"].to_numpy().tobytes()
        return pa.Table.from_pylist([dict(zip(("block", "item", "s_ids", "s_vec"), row, strict=True))])

    asked, held = (side.select("block", "ids").mapInArrow(places(name), f"{name} long, {name}_block long") for side, name in ((queries, "q"), (items, "id")))
    rows = seen.select(F.col("q").cast("long"), F.col("id").cast("long")).join(held, "id").join(asked, "q")
    return rows.groupBy("q_block", "id_block").applyInArrow(pack, "block long, item long, s_ids binary, s_vec binary")


def _copies(t: DataFrame) -> DataFrame:
    """``t`` (id, vec, bias) with 128 bits of vector and bias: equal in rows that have equal scores."""
    return t.withColumns({"h": F.xxhash64("vec", "bias"), "h2": F.xxhash64(F.lit(1), "bias", "vec")})


def _least(items: DataFrame, depth: int) -> DataFrame:
    """Of equal items those of the ``depth`` smallest ids: others are never among the best of a query."""
    at = F.row_number().over(Window.partitionBy("h", "h2").orderBy("id"))
    return _copies(items).withColumn("_at", at).where(F.col("_at") <= depth).select("id", "vec", "bias")


def top_k(queries: DataFrame, items: DataFrame, k: int = 10, metric: str = "dot", skip_self: bool = False, pool: DataFrame | None = None, seen: DataFrame | None = None, rows: int | None = None, scored=None) -> DataFrame:
    """q, rank (from 1), id, score: the k best items of each query, ties to the smaller id.

    queries: id, vec, optional bias; items: the same; pool: id; seen: q, id pairs left out; scored: an accumulator that
    counts the pairs of queries and items whose score was computed.

    Equal vectors have equal scores, so of equal items only those of the smallest ids are searched, as many as a query could
    need, and equal queries are searched once, unless they leave out pairs of their own (queries that leave out more than
    ``LIGHT`` search all items). Scores are ranked as they are, not rounded. l2 ranks by squared distance and returns the distance.
    """
    if metric not in METRICS or k < 1:
        raise ValueError(f"metric {metric!r}, k {k}")
    if pool is not None:
        items = items.join(pool.select("id").distinct(), "id", "left_semi")
    sides = [t.select(F.col("id").cast("long"), F.col("vec").cast("array<double>"), (F.col("bias") if "bias" in t.columns else F.lit(0.0)).cast("double").alias("bias")) for t in (queries, items)]
    q, depth = written(sides[0], "asked")[0], k + skip_self
    if seen is not None:
        seen = written(seen.select(F.col("q").cast("long"), F.col("id").cast("long")), "left-out")[0]
        n_seen = seen.groupBy("q").agg(F.count("*").alias("n"))
        most = n_seen.agg(F.max("n")).first()[0] or 0
        if most <= LIGHT:
            return _search(q, _least(sides[1], depth + most), k, metric, skip_self, seen, rows, scored)
        x = written(sides[1], "items")[0]
        heavy = written(n_seen.where(F.col("n") > LIGHT).select("q"), "heavy")[0]
        of = lambda how: (q.join(heavy.withColumnRenamed("q", "id"), "id", how), seen.join(heavy, "q", how))
        (few, more), (many, less) = of("left_semi"), of("left_anti")
        return _search(many, _least(x, depth + LIGHT), k, metric, skip_self, less, rows, scored).unionByName(_search(few, x, k, metric, skip_self, more, rows, scored))
    kinds = written(_copies(q).groupBy("h", "h2").agg(F.min(F.struct("id", "vec", "bias")).alias("one")), "kinds")[0]
    if kinds.count() == q.count():
        return _search(q, _least(sides[1], depth), k, metric, skip_self, None, rows, scored)
    found = _search(kinds.select("one.*"), _least(sides[1], depth), depth, metric, False, None, rows, scored)
    lists = found.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("found"))  # depth rows at most
    lists = kinds.select("h", "h2", F.col("one.id").alias("q")).join(lists, "q").drop("q")
    each = _copies(q).select(F.col("id").alias("q"), "h", "h2").join(lists, ["h", "h2"])
    own = F.filter("found", lambda x: x["id"] != F.col("q")) if skip_self else F.col("found")
    return each.select("q", F.posexplode(F.slice(own, 1, k)).alias("at", "x")).select("q", (F.col("at") + 1).alias("rank"), "x.id", "x.score")


def tiles(n_x: int, n_bytes: int, n_q: int, cores: int) -> tuple[int, int]:
    """Where all queries meet all items: item blocks in a bundle, and groups of query blocks.

    A task has a bundle and a group. Vectors are sent as often as the other side is cut, so both are cut alike, into tasks as many
    as cores need, and items further if a bundle were larger than ``BUNDLE``.
    """
    tasks = A_CORE * cores
    bundles = max(1, min(n_x, max(-(-n_bytes // BUNDLE), round(tasks**0.5))))
    per = max(1, n_x // bundles)
    return per, max(1, min(n_q, -(-tasks // max(1, -(-n_x // per)))))


def _search(queries: DataFrame, items: DataFrame, k: int, metric: str, skip_self: bool, seen: DataFrame | None, rows: int | None, scored) -> DataFrame:
    """``top_k`` of each row of queries and items (id, vec, bias).

    Both sides are packed into blocks of ``rows`` vectors, items by falling norm. For dot products queries meet the block of
    the longest items first; what their k-th best reaches there is more than the product of norms allows in most other blocks
    if norms differ, and only queries for which it isn't go on to a block. For cosine and l2 blocks are searched in bundles (``tiles``), of which a query gives k rows. A task multiplies blocks, scores once more in a fixed
    order what could be among the k best of a query, and keeps these, so no side is broadcast and shuffles carry blocks, then k
    rows for each block at most. The driver gets number, norm and bias of each block.
    """
    spark = queries.sparkSession
    q, x = (written(_packed(t, rows, by_norm), "packed")[0] for t, by_norm in ((queries, False), (items, True)))
    facts = sorted((r.norm, r.top, r.block) for r in x.select("norm", "top", "block").collect())[::-1]  # a row for each block of items
    norms, tops, blocks = (np.array([f[i] for f in facts], kind) for i, kind in enumerate((float, float, np.int64)))
    n_q, n_x, parts = q.count(), len(facts), int(spark.conf.get("spark.sql.shuffle.partitions"))
    rounds = metric == "dot" and n_x > 1
    per, groups = 1, max(1, min(n_q, max(-(-n_q // TOGETHER), -(-2 * parts // max(1, n_x)))))
    if not rounds:
        per, groups = tiles(n_x, x.agg(F.coalesce(F.sum(F.length("vec")), F.lit(0))).first()[0], n_q, spark.sparkContext.defaultParallelism)
    n_b = -(-n_x // per)
    n_tasks, number = min(TASKS, max(1, n_b * groups)), {int(b): at // per for at, b in enumerate(blocks)}  # the bundle of each item block

    def task(bundle: int, block: int) -> int:
        return (bundle * groups + ((block & 0xFFFFFFFF) + (block >> 32)) % groups) % n_tasks

    def count(side: Side, held: Side) -> None:
        if scored is not None:
            scored.add(len(side.ids) * len(held.ids))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What queries find in the first block, and for each other bundle those that it can matter to."""
        for batch in batches:
            for row in batch.to_pylist():
                side = Side(row)
                least = np.full(len(side.ids), -np.inf)
                if rounds:
                    held = Side(row, "x_")
                    at, col, score = best(side, held, k, metric, skip_self, _pairs(row["s_ids"], row["s_vec"]))
                    count(side, held)
                    full = np.bincount(at, minlength=len(least)) >= k
                    least[full] = score[np.searchsorted(at, np.flatnonzero(full), "right") - 1]
                    yield _routed(row["block"] % n_tasks, "T", None, row["block"], side.ids[at], held.ids[col], score)
                length = np.sqrt((side.vec * side.vec).sum(1))
                for at in range(int(rounds), n_b):
                    bound = length * norms[at] + side.bias + tops[at] if rounds else np.full(len(least), np.inf)
                    some = np.flatnonzero(bound + 1e-9 * (np.abs(bound) + 1) >= least)
                    if len(some):
                        yield _routed(task(at, row["block"]), "Q", at, row["block"], side.ids[some], side.vec[some], side.bias[some], least[some])

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """An item block for each task that its queries go to."""
        for batch in batches:
            for row in batch.to_pylist():
                held, bundle = Side(row), number[row["block"]]
                for to in sorted({(bundle * groups + g) % n_tasks for g in range(groups)}):
                    yield _routed(to, "I", bundle, row["block"], held.ids, held.vec, held.bias)

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bundle = number[row["item"]]
                yield _routed(task(bundle, row["block"]), "A", bundle, row["block"], *_pairs(row["s_ids"], row["s_vec"]), np.array([row["item"]]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each bundle in turn pairs left out, the items, then queries; results of the first block pass."""
        item, held, out = None, [], {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == "T":
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row[c], t)) for c, t in (("ids", np.int64), ("vec", np.int64), ("bias", np.float64))], schema=_FOUND)
                    continue
                if row["item"] != item:
                    item, held, out = row["item"], [], {}
                if row["kind"] == "A":
                    out[int(np.frombuffer(row["bias"], np.int64)[0]), row["block"]] = _pairs(row["ids"], row["vec"])
                elif row["kind"] == "I":
                    held.append((row["block"], Side(row)))
                else:
                    at, ids, score = bundled(Side(row), held, row["block"], out)
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["ids"], np.int64)[at]), pa.array(ids), pa.array(score)], schema=_FOUND)

    def bundled(side: Side, held: list, block: int, out: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of queries, ids and scores of their k best in a bundle; what a block must reach are the k best before it."""
        all_ = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for number_of, x in held:
            at, col, score = best(side, x, k, metric, skip_self, out.get((number_of, block)))
            count(side, x)
            if len(all_[0]):
                at, ids, score = (np.concatenate(c) for c in zip(all_, (at, x.ids[col], score), strict=True))
                order = np.lexsort((ids, -score, at))
                at, ids, score = at[order], ids[order], score[order]
                kept = np.arange(len(at)) - np.searchsorted(at, at) < k
                all_ = at[kept], ids[kept], score[kept]
            else:
                all_ = at, x.ids[col], score
            if len(held) > 1:
                full = np.flatnonzero(np.bincount(all_[0], minlength=len(side.ids)) >= k)
                least = np.full(len(side.ids), -np.inf)
                least[full] = all_[2][np.searchsorted(all_[0], full, "right") - 1]
                side.least = np.maximum(least, side.least) if len(side.least) else least
        return all_

    out, asked = written(_left_out(seen, q, x), "seen")[0] if seen is not None else None, q
    if rounds:
        first = int(blocks[0])
        asked = asked.crossJoin(F.broadcast(x.where(F.col("block") == first).select(*[F.col(c).alias(f"x_{c}") for c in ("ids", "vec", "bias")])))  # one row of at most 64 MB
        none = [F.lit(None).cast("binary").alias(c) for c in ("s_ids", "s_vec")]
        asked = asked.join(out.where(F.col("item") == first).drop("item"), "block", "left") if out is not None else asked.select("*", *none)
    moving = asked.mapInArrow(ask, ROUTED).unionByName(x.mapInArrow(copy, ROUTED))
    if out is not None:
        moving = moving.unionByName(out.mapInArrow(leave, ROUTED))
    found = moving.repartitionById(n_tasks, "task").sortWithinPartitions("item", "kind").mapInArrow(search, "q long, id long, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    score = -F.col("score") if metric == "l2" else F.col("score")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("q", "rank", "id", F.sqrt(F.greatest(score, F.lit(0.0))).alias("score") if metric == "l2" else score.alias("score"))


def most_similar(items: DataFrame, queries: DataFrame | None = None, k: int = 10, metric: str = "cosine", pool: DataFrame | None = None) -> DataFrame:
    """Neighbours of items (of the given ids, or all) without themselves."""
    picked = items if queries is None else items.join(queries.select("id"), "id", "left_semi")
    return top_k(picked, items, k, metric, True, pool)


def weighted_feature(items: DataFrame, weights: DataFrame) -> DataFrame:
    """vec: the mean of weight * vector over ``weights`` (id, weight), then normalised."""
    d = F.posexplode("vec").alias("pos", "x")
    at = items.join(weights, "id").select("weight", d)
    mean = at.groupBy("pos").agg(F.avg(F.col("x").cast("double") * F.col("weight")).alias("m"))
    vec = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("vec"))  # one value for each dimension
    n = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v) + 1e-8)
    return vec.select(F.transform("vec", lambda v: v / n).alias("vec"))
