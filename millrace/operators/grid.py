"""Sequential updates of two factor tables by a rotating grid of blocks.

Both tables are dealt to ``n`` blocks, and samples to the ``n * n`` strata of a block of each. In stage s, task b holds block b of
the first table and block b + s of the second, so no vector is in two tasks; afterwards the second table's blocks move one task
on. A task works through its stratum in random order, one sample after the other. Samples that share no vector don't disturb each
other, so NumPy runs them together: ``levels`` gives the places in that order, and the result is that of the plain loop.

A block travels as one row of bytes. There are as many blocks as shuffle partitions, or fewer, so that a stage moves fewer vectors
than it has samples and a stratum has about ``STRATUM`` samples, which take as long as starting a stage; and more if a block were
larger than ``BLOCK_BYTES``.
"""

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES, STRATUM, CHAIN = 256 << 20, 100_000, 8
STATE = "key int, kind string, ids binary, vec binary, bias binary, w binary"
FIRST, SECOND, SAMPLES, LOSS = "P", "Q", "S", "L"


def blocks(n_samples: int, n_first: int, n_second: int, d: int, partitions: int) -> int:
    """How many blocks a table has."""
    vectors = max(1, n_first + n_second)
    wanted = min(partitions, n_samples // vectors, int((n_samples / STRATUM) ** 0.5), min(n_first, n_second) // 32)
    return max(1, wanted, ceil(vectors * d * 8 / BLOCK_BYTES))


def dealt(ident: str, n: int, *salt: int):
    return F.pmod(F.xxhash64(F.col(ident).cast("long"), *[F.lit(x) for x in salt]), F.lit(n)).cast("int")


class Block:
    """Rows of a factor table in order of ids: vec, bias and w, a whole number."""

    def __init__(self, ids: np.ndarray, vec: np.ndarray, bias: np.ndarray, w: np.ndarray):
        self.ids, self.vec, self.bias, self.w = ids, vec, bias, w

    def row(self, key: int, kind: str) -> tuple:
        return key, kind, self.ids.tobytes(), self.vec.tobytes(), self.bias.tobytes(), self.w.tobytes()


def _opened(row: dict, d: int) -> Block:
    read = lambda name, kind: np.frombuffer(row[name] or b"", kind).copy()
    return Block(read("ids", np.int64), read("vec", np.float64).reshape(-1, d), read("bias", np.float64), read("w", np.int64))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.string(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in STATE.split(", ")])


def packed(factors: DataFrame, kind: str, n: int, d: int, *salt: int) -> DataFrame:
    """STATE rows, one a block, of id, vec and, where the table has them, bias and w."""
    more = [(F.col(c) if c in factors.columns else F.lit(0)).cast(t).alias(c) for c, t in (("bias", "double"), ("w", "long"))]
    rows = factors.select(F.col("id").cast("long"), F.col("vec").cast("array<double>"), *more, dealt("id", n, *salt).alias("key"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if found := [b for b in batches if b.num_rows]:
            t = pa.Table.from_batches(found).sort_by("id")
            vec = t["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            yield _batch([Block(t["id"].to_numpy(), vec, t["bias"].to_numpy(), t["w"].to_numpy()).row(t["key"][0].as_py(), kind)])

    return rows.repartitionById(n, "key").mapInArrow(pack, STATE)


def unpacked(state: DataFrame, kind: str, d: int) -> DataFrame:
    """id, vec, bias of a table in STATE rows."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = _opened(row, d)
                for at in range(0, len(x.ids), 65_536):
                    vec = x.vec[at : at + 65_536]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vec) + 1) * d, pa.int32()), pa.array(vec.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(x.ids[at : at + 65_536]), lists, pa.array(x.bias[at : at + 65_536])], ["id", "vec", "bias"])

    return state.where(F.col("kind") == kind).mapInArrow(unpack, "id long, vec array<double>, bias double")


def strata(samples: DataFrame, first: str, second: str, n: int, salts: tuple[tuple, tuple] = ((), ())) -> DataFrame:
    """STATE rows of samples with their stage: ids of the first table in ``ids``, of the second in ``vec``; one row a stratum."""
    key, other = dealt(first, n, *salts[0]), dealt(second, n, *salts[1])
    rows = samples.select(key.alias("key"), F.pmod(other - key, F.lit(n)).alias("stage"), F.col(first).cast("long").alias("a"), F.col(second).cast("long").alias("b"))

    def pack(keys: tuple, t: pa.Table) -> pa.Table:
        order = np.lexsort((t["b"].to_numpy(), t["a"].to_numpy()))
        row = keys[0].as_py(), SAMPLES, t["a"].to_numpy()[order].tobytes(), t["b"].to_numpy()[order].tobytes(), b"", b""
        return pa.Table.from_batches([_batch([row])]).append_column("stage", pa.array([keys[1].as_py()], pa.int32()))

    return rows.groupBy("key", "stage").applyInArrow(pack, f"{STATE}, stage int")


CHUNKS = "key int, stage int, ids binary, vec binary"


def chunked(a: np.ndarray, b: np.ndarray, key: np.ndarray, other: np.ndarray, n: int) -> pa.RecordBatch:
    """CHUNKS rows of samples with ids a and b and their blocks, one for each stratum."""
    stratum = key * n + (other - key) % n
    order = np.argsort(stratum, kind="stable")
    a, b, stratum = a[order], b[order], stratum[order]
    heads = np.flatnonzero(np.concatenate(([True], stratum[1:] != stratum[:-1])))[: len(a)]
    cut = [*heads.tolist(), len(a)]
    blobs = [pa.array([x[p:q].tobytes() for p, q in zip(cut, cut[1:], strict=False)], pa.binary()) for x in (a, b)]
    return pa.RecordBatch.from_arrays([pa.array((stratum[heads] // n).astype(np.int32)), pa.array((stratum[heads] % n).astype(np.int32)), *blobs], [c.split()[0] for c in CHUNKS.split(", ")])


def gathered(chunks: DataFrame) -> DataFrame:
    """``strata`` of samples in CHUNKS rows."""

    def pack(keys: tuple, t: pa.Table) -> pa.Table:
        a, b = (np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in t[c]]) for c in ("ids", "vec"))
        order = np.lexsort((b, a))
        row = keys[0].as_py(), SAMPLES, a[order].tobytes(), b[order].tobytes(), b"", b""
        return pa.Table.from_batches([_batch([row])]).append_column("stage", pa.array([keys[1].as_py()], pa.int32()))

    return chunks.groupBy("key", "stage").applyInArrow(pack, f"{STATE}, stage int")


def rotated(state: DataFrame, samples: DataFrame, n: int, d: int, run: Callable, kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """STATE after ``n`` stages. ``run(stage, task, first, second, a, b)`` changes both blocks by the stratum's samples, given as
    places in them, and returns the sum of their losses and their number; these add up in rows of kind LOSS.

    ``kept`` writes what ``CHAIN`` stages give, which are one job.
    """

    def stage(s: int) -> Callable:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = {row["kind"]: row for batch in batches for row in batch.to_pylist()}
            if not held:
                return
            b = next(row["key"] for row in held.values())
            loss = np.frombuffer(held[LOSS]["vec"]).copy() if LOSS in held else np.zeros(2)
            first, second = (_opened(held[kind], d) if kind in held else None for kind in (FIRST, SECOND))
            if SAMPLES in held and first and second:
                x, y = (np.frombuffer(held[SAMPLES][name], np.int64) for name in ("ids", "vec"))
                loss += run(s, b, first, second, np.searchsorted(first.ids, x), np.searchsorted(second.ids, y))
            out = [first.row(b, FIRST)] if first else []
            out += [second.row((b - 1) % n, SECOND)] if second else []
            for row in [*out, (b, LOSS, b"", loss.tobytes(), b"", b"")]:
                yield _batch([row])

        return task

    for s in range(n):
        both = state.unionByName(samples.where(F.col("stage") == s).drop("stage"))
        state = both.repartitionById(n, "key").mapInArrow(stage(s), STATE)
        if s % CHAIN == CHAIN - 1 and s < n - 1:
            state = kept(state)
    return kept(state)


def losses(state: DataFrame) -> tuple[float, int]:
    """The sum of losses and the number of samples: a row for each block."""
    total = sum((np.frombuffer(r.vec) for r in state.where(F.col("kind") == LOSS).select("vec").collect()), np.zeros(2))
    return float(total[0]), int(total[1])


def levels(a: np.ndarray, others: list[np.ndarray], n_a: int, n_b: int) -> np.ndarray:
    """The level of each sample: above that of all earlier ones with which it shares a place in a or, in any column, in ``others``."""
    free_a, free_b, out = [0] * n_a, [0] * n_b, [0] * len(a)
    if len(others) == 2:
        for t, (u, i, j) in enumerate(zip(a.tolist(), others[0].tolist(), others[1].tolist(), strict=True)):
            level = max(free_a[u], free_b[i], free_b[j])
            out[t] = level
            free_a[u] = free_b[i] = free_b[j] = level + 1
    else:
        for t, (u, held) in enumerate(zip(a.tolist(), np.stack(others, 1).tolist(), strict=True)):
            level = free_a[u]
            for j in held:
                if free_b[j] > level:
                    level = free_b[j]
            out[t] = level
            free_a[u] = level = level + 1
            for j in held:
                free_b[j] = level
    return np.array(out, np.int64)


def by_level(level: np.ndarray) -> Iterator[np.ndarray]:
    """Samples that run together, in order of levels."""
    order = np.argsort(level, kind="stable")
    ends = np.cumsum(np.bincount(level)) if len(level) else np.zeros(0, np.int64)
    for start, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        yield order[start:end]


def others(than: np.ndarray, w: np.ndarray, times: int, rng: np.random.Generator) -> np.ndarray | None:
    """``times`` places by weight for each of ``than``, never that one itself; None where a place has all the weight."""
    high = np.cumsum(w)
    left = high[-1] - w[than]
    if not len(than) or left.min() <= 0:
        return None
    r = rng.integers(0, left[:, None], (len(than), times))
    return np.searchsorted(high, r + np.where(r >= (high - w)[than][:, None], w[than][:, None], 0), "right")


def unseen(a: np.ndarray, b: np.ndarray, w: np.ndarray, times: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """For each pair (distinct, sorted) ``times`` draws by weight of a place that its ``a`` has no pair with: places of pairs, draws.

    A number below the weight that is left becomes a place on the line of all by adding what the own ones before it weigh. Pairs
    to which nothing is left draw nothing.
    """
    high = np.cumsum(w)
    total, own = int(high[-1]) if len(w) else 0, np.concatenate(([0], np.cumsum(w[b])))
    first = np.searchsorted(a, a, "left")
    before = own[:-1] - own[first]
    free = total - (own[np.searchsorted(a, a, "right")] - own[first])
    who = np.repeat(np.flatnonzero(free > 0), times)
    r = rng.integers(0, free[who]) if len(who) else np.zeros(0, np.int64)
    local = np.cumsum(np.concatenate(([0], a[1:] != a[:-1]))) if len(a) else a  # each a's number: places on all lines in one array
    at = local * (total + 1) + (high[b] - w[b] - before)
    found = np.searchsorted(at, local[who] * (total + 1) + r, "right")
    return who, np.searchsorted(high, r + own[found] - own[first[who]], "right")


def meetings(n_pairs: int, n_first: int, n_second: int, d: int, partitions: int) -> int:
    """Blocks of a table for ``met``: enough for all tasks, and for a million pairs or so in each."""
    return max(blocks(n_pairs, n_first, n_second, d, partitions), ceil((2 * partitions) ** 0.5), ceil((n_pairs / 1e6) ** 0.5))


def met(pairs: DataFrame, a: str, b: str, first: DataFrame, second: DataFrame, n: int, d: int, make: Callable, schema: str) -> DataFrame:
    """What ``make()``'s ``rows`` and ``end`` give where pairs of ids meet both their vectors.

    Pairs are dealt to n * n tasks by the blocks of their two ids, and each block is sent to the n tasks that need it, so no vector
    travels with a pair. A task holds two blocks and a batch of pairs, however many pairs one id has. ``rows(t, first, second, a,
    b)`` gets a batch and its places in the blocks; ``end(first, second)`` comes after all of a task; both give a table or None.
    """
    names, every = pairs.columns, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    task = lambda x, y: (x * n + y).cast("int").alias("_task")
    none = lambda columns, kinds: [F.lit(None).cast(kinds[c].dataType).alias(c) for c in columns]
    binary = ["ids", "vec", "bias"]
    rows = pairs.select(task(dealt(a, n), dealt(b, n)), F.lit(2).alias("_kind"), *names, *[F.lit(None).cast("binary").alias(f"_{c}") for c in binary])
    for kind, table in enumerate((first, second)):
        held = packed(table, "", n, d).select("key", every.alias("other"), *binary)
        x, y = (F.col("key"), F.col("other")) if kind == 0 else (F.col("other"), F.col("key"))
        rows = rows.unionByName(held.select(task(x, y), F.lit(kind).alias("_kind"), *none(names, pairs.schema), *[F.col(c).alias(f"_{c}") for c in binary]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, maker = None, [None, None], None

        def given(t: pa.Table | None) -> Iterator[pa.RecordBatch]:
            if t is not None:
                yield from t.to_batches()

        for batch in batches:
            t = pa.Table.from_batches([batch])
            where = t["_task"].to_numpy() * 3 + t["_kind"].to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1], [True]))) if len(where) else [0]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                number, kind = divmod(int(where[low]), 3)
                if number != now:
                    if maker:
                        yield from given(maker.end(*held))
                    now, held, maker = number, [None, None], make()
                part = t.slice(low, high - low)
                if kind < 2:
                    row = {c: part[f"_{c}"][0].as_py() for c in binary}
                    held[kind] = _opened(row | {"w": b""}, d)
                elif held[0] and held[1]:
                    x, y = (part[c].to_numpy() for c in (a, b))
                    part = part.select(names)
                    at = [np.minimum(np.searchsorted(h.ids, k), len(h.ids) - 1) for h, k in zip(held, (x, y), strict=True)]
                    there = (held[0].ids[at[0]] == x) & (held[1].ids[at[1]] == y)
                    if there.any():
                        yield from given(maker.rows(part.filter(pa.array(there)), *held, at[0][there], at[1][there]))
        if maker:
            yield from given(maker.end(*held))

    return rows.repartitionById(n * n, "_task").sortWithinPartitions("_task", "_kind").mapInArrow(run, schema)


class Scores:
    """Adds ``s``, the score of each pair: the dot product and the second's bias, or the squared distance below zero."""

    def __init__(self, l2: bool):
        self.l2 = l2

    def rows(self, t: pa.Table, first: Block, second: Block, a: np.ndarray, b: np.ndarray) -> pa.Table:
        x, y = first.vec[a], second.vec[b]
        s = -np.einsum("nd,nd->n", x - y, x - y) if self.l2 else np.einsum("nd,nd->n", x, y) + second.bias[b]
        return t.append_column("s", pa.array(s))

    def end(self, first: Block, second: Block) -> None:
        """Nothing is held back."""


class Pulls:
    """Sums of what pairs with weight w add to both sides: w y to the first and w x to the second, or 2 w y and w (x - y) for l2.

    A pair has w, one (whether it counts for the first), move (whether it moves the second), and the weights rf and rs of
    regularisation. Out come name (P or Q), id, g, gb (sum of w), n and r of what a task's pairs touch.
    """

    SCHEMA = "name string, id long, g array<double>, gb double, n long, r double"

    def __init__(self, l2: bool):
        self.l2, self.sums = l2, None

    def rows(self, t: pa.Table, first: Block, second: Block, a: np.ndarray, b: np.ndarray) -> None:
        if self.sums is None:
            self.sums = [(np.zeros_like(h.vec), np.zeros((len(h.ids), 3))) for h in (first, second)]
        w, one, move, rf, rs = (t[c].to_numpy() for c in ("w", "one", "move", "rf", "rs"))
        x, y, d = first.vec[a], second.vec[b], first.vec.shape[1]
        to_first, to_second = (2 if self.l2 else 1) * w[:, None] * y, (w * move)[:, None] * (x - y if self.l2 else x)
        for (g, facts), at, add, values in zip(self.sums, (a, b), (to_first, to_second), ((0 * w, one, rf * one), (w * move, move, rs * move)), strict=True):
            np.add.at(g.reshape(-1), (at[:, None] * d + np.arange(d)).ravel(), add.ravel())
            for k, v in enumerate(values):
                facts[:, k] += np.bincount(at, v, len(facts))

    def end(self, first: Block, second: Block) -> pa.Table | None:
        if self.sums is None:
            return None
        out = []
        for name, held, (g, facts) in zip((FIRST, SECOND), (first, second), self.sums, strict=True):
            at = np.flatnonzero((facts[:, 1] > 0) | g.any(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * g.shape[1], pa.int32()), pa.array(g[at].ravel()))
            out.append(pa.table([pa.array([name] * len(at), pa.string()), pa.array(held.ids[at]), lists, pa.array(facts[at, 0]), pa.array(facts[at, 1].astype(np.int64)), pa.array(facts[at, 2])], [c.split()[0] for c in self.SCHEMA.split(", ")]))
        return pa.concat_tables(out)
