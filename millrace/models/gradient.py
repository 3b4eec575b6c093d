"""Models trained by gradients: BPRMF, WARP and skip-gram item embeddings.

Plain stochastic descent (BPRMF with sgd, W2V) updates vectors sample by sample in the rotating blocks of ``operators.grid``.
Adam and Adagrad are synchronous: pairs are scored and their gradients summed where blocks of both vectors meet, then one optimizer
step moves all vectors. No vector travels with a sample, and no factor table is collected or broadcast. Samples come from hashes of (row, epoch, try) or from seeds of
(epoch, stage, task), so recomputed parts agree.
"""

from collections.abc import Callable
from functools import cached_property, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.vectors import dot, sigmoid_minus, softplus_minus
from millrace.models.base import Model, initial
from millrace.operators import grid, words
from millrace.operators.matrix import running


def _uniform(*parts) -> Column:
    return (F.pmod(F.xxhash64(*parts), F.lit(2**40)) + 0.5) / float(2**40)


def _scaled(v, s) -> Column:
    return F.transform(v, lambda x: x * s)


MASS = 1 << 40


class Gradient(Model):
    def _start(self, tables: dict[str, DataFrame], absolute: bool, scale: float) -> None:
        """Factor tables with the state of the optimizer: m and s (moments)."""
        d = self.opt["d"]
        for k, (name, ids) in enumerate(tables.items()):
            zero = F.array_repeat(F.lit(0.0), d)
            table = initial(ids, d, scale, self.opt["random_seed"] + k, absolute).withColumn("bias", F.lit(0.0))
            self.factors[name] = table if self.sequential else self.keep(table.withColumns({"m": zero, "s": zero}), name)
        self.epoch, self._state, self._view = 0, None, None

    @property
    def sequential(self) -> bool:
        """Whether samples move vectors one after the other."""
        return self.opt.get("optimizer", "sgd") == "sgd"

    def _rotate(self, first: str, second: str, weights: DataFrame | None, dealt: Callable, n: int, run: Callable) -> float:
        """One epoch over the samples in n blocks; ``weights``: id, w of the second table, 1 by default. The mean loss.

        ``dealt(salts)`` gives the strata of samples.

        The second table and so the strata are dealt anew for each epoch; the first stays where it is.
        """
        d, salts = self.opt["d"], ((self.opt["random_seed"],), (self.opt["random_seed"], self.epoch + 1))
        moved = self._state.where(F.col("kind") == grid.FIRST) if self._view is self.factors[first] else grid.packed(self.factors[first], grid.FIRST, n, d, *salts[0])
        drawn = self.factors[second].select("id", "vec", "bias")
        drawn = drawn.join(weights, "id", "left").withColumn("w", F.coalesce("w", F.lit(0))) if weights is not None else drawn.withColumn("w", F.lit(1))
        state = moved.unionByName(grid.packed(drawn, grid.SECOND, n, d, *salts[1]))
        strata = self.keep(dealt(salts), "strata", by="stage")
        self._state = grid.rotated(state, strata, n, d, run, lambda df: self.keep(df, "state"))
        self.factors |= {name: grid.unpacked(self._state, kind, d) for name, kind in ((first, grid.FIRST), (second, grid.SECOND))}
        self._view = self.factors[first]
        loss, n_samples = grid.losses(self._state)
        self.epoch += 1
        return loss / max(1, n_samples)

    def _rates(self, n: int) -> list[float]:
        """Of each stage of an epoch: falls linearly to ``min_lr``."""
        return [max(self.opt["min_lr"], self.opt["lr"] * (1 - (self.epoch + s / n) / max(1, self.opt["num_iters"]))) for s in range(n)]

    def _place(self, items: DataFrame) -> None:
        """Lays items (id, w: whole numbers above 0) on a line, each as long as its weight, and cuts the line in a cell for each item.

        A cell holds few items and an item few cells, on the average of draws as of cells, whatever the weights are.
        """
        line = running(items, "id", "w", "high").select(F.col("id").alias("j"), "w", (F.col("high") - F.col("w")).alias("low"), "high")
        self.line = self.keep(line)
        facts = self.line.agg(F.coalesce(F.max("high"), F.lit(0)).alias("mass"), F.count("*").alias("n")).first()
        self.mass, self.n_items = facts.mass, facts.n
        self.cell = max(1, -(-self.mass // max(1, self.n_items)))
        self.cells = self.keep(self.line.select("j", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / self.cell), F.floor((F.col("high") - 1) / self.cell))).alias("cell")))

    def _at(self, draws: DataFrame) -> DataFrame:
        """``draws`` with place y on the line, and the item j there."""
        found = draws.withColumn("cell", F.floor(F.col("y") / self.cell)).join(self.cells, "cell").where("y >= low AND y < high")
        return found.drop("cell", "low", "high", "y")

    def _random(self, bound, salt: int = 0) -> Column:
        """A whole number under ``bound`` by row, t, epoch and seed."""
        return F.pmod(F.xxhash64("row", "t", F.lit(self.epoch), F.lit(self.opt["random_seed"] + salt)), bound)

    def _unseen(self, rows: DataFrame, first: int, n: int, columns: tuple[str, ...] = ("i",)) -> DataFrame:
        """row, u, ``columns`` of rows, t, j: draws ``first`` to ``first + n`` by weight for each row (row, u, free), each an item that the user has not.

        A number below ``free``, the weight that the user's own items leave, becomes a place on the line by adding the weights of
        own items up to there: a running sum over own items and draws. Users that have every item draw nothing.
        """
        drawn = rows.where("free > 0").select("row", "u", *columns, "free", F.explode(F.sequence(F.lit(first), F.lit(first + n - 1))).alias("t"))
        drawn = drawn.select("u", self._random(F.col("free")).alias("at"), F.lit(1).alias("kind"), "row", *columns, "t", F.lit(0).cast("long").alias("w"))
        own = self.own.select("u", "at", F.lit(0).alias("kind"), *[F.lit(None).cast(drawn.schema[c].dataType).alias(c) for c in ("row", *columns, "t")], "w")
        before = F.sum("w").over(Window.partitionBy("u").orderBy("at", "kind").rangeBetween(Window.unboundedPreceding, Window.currentRow))
        both = drawn.unionByName(own).withColumn("y", F.col("at") + before).where("kind = 1")
        return self._at(both.select("row", "u", *columns, "t", "y"))

    def _interactions(self, rows: DataFrame, items: DataFrame | None, power: float) -> None:
        """Distinct pairs (row, u, i), the items and their weights by popularity ** power (whole numbers above 0)."""
        self.pairs = self.keep(rows.select(F.col("u").cast("long"), F.col("i").cast("long")).distinct().withColumn("row", F.xxhash64("u", "i")))
        self.item_ids = self.pairs.select(F.col("i").alias("id")).distinct() if items is None else self.keep(items.select(F.col("id").cast("long")).distinct())
        if power == 0:
            self.weights = self.item_ids.withColumn("w", F.lit(1).cast("long"))
        else:
            n = self.pairs.groupBy(F.col("i").alias("id")).agg(F.pow(F.count("*"), F.lit(power)).alias("p"))
            share = F.col("p") / n.agg(F.sum("p")).first()[0]
            self.weights = self.keep(self.item_ids.join(n, "id").select("id", F.greatest(F.lit(1), F.round(share * MASS)).cast("long").alias("w")))
        facts = self.pairs.agg(F.count("*").alias("n"), F.countDistinct("u").alias("users"), F.countDistinct("i").alias("items")).first()
        self.n_rows, self.n_users, self.n_held = facts.n, facts.users, facts["items"] if items is None else self.item_ids.count()

    @cached_property
    def rows(self) -> DataFrame:
        """row, u, i, free, width of each pair: the weight that the user's own items leave, and their number. Lays the items' line."""
        self._place(self.weights)
        own = self.pairs.select("u", F.col("i").alias("j")).join(self.line, "j")
        earlier = F.sum("w").over(Window.partitionBy("u").orderBy("low").rowsBetween(Window.unboundedPreceding, -1))
        self.own = self.keep(own.select("u", (F.col("low") - F.coalesce(earlier, F.lit(0))).alias("at"), "w"))
        held = self.own.groupBy("u").agg(F.sum("w").alias("held"), F.count("*").alias("width"))
        return self.keep(self.pairs.join(held, "u", "left").select("row", "u", "i", (self.mass - F.coalesce("held", F.lit(0))).alias("free"), F.coalesce("width", F.lit(0)).alias("width")))

    def _meetings(self, pairs: int) -> int:
        partitions = int(self.pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return grid.meetings(pairs, self.n_users, self.n_held, self.opt["d"], partitions)

    def _scored(self, pairs: DataFrame, item: str, n_pairs: int, l2: bool = False) -> DataFrame:
        """``pairs`` (u, the item, further columns) with their score s by the factors as they are."""
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema) + ", s double"
        return grid.met(pairs, "u", item, self.factors["P"], self.factors["Q"], self._meetings(n_pairs), self.opt["d"], lambda: grid.Scores(l2), schema)

    def _pulled(self, samples: DataFrame, n_samples: int, reg: tuple[float, float, float], l2: bool = False) -> DataFrame:
        """Gradients (name, id, g, gb, n, r) of samples (u, i, j, w), summed: u is drawn to i by w and from j.

        reg: the weights of regularisation that a sample adds for u, i and j. Only block sums are shuffled.
        """
        opt, number = self.opt, lambda x: F.lit(float(x))
        two = [
            F.struct(F.col(x).alias("x"), (sign * F.col("w")).alias("w"), number(one).alias("one"), number(opt[f"update_{x}"]).alias("move"), number(reg[0]).alias("rf"), number(r).alias("rs"))
            for x, sign, one, r in (("i", 1, 1, reg[1]), ("j", -1, 0, reg[2]))
        ]
        pairs = samples.select("u", F.explode(F.array(*two)).alias("e")).select("u", "e.*")
        parts = grid.met(pairs, "u", "x", self.factors["P"], self.factors["Q"], self._meetings(2 * n_samples), opt["d"], lambda: grid.Pulls(l2), grid.Pulls.SCHEMA)
        sums = parts.groupBy("name", "id").agg(F.array(*[F.sum(F.col("g")[k]) for k in range(opt["d"])]).alias("g"), F.sum("gb").alias("gb"), F.sum("n").alias("n"), F.sum("r").alias("r"))
        return self.keep(sums.where("n > 0"), "gradients")

    def _apply(self, name: str, gradients: DataFrame, rate: float, reg: float, unit_ball: bool = False) -> None:
        """One step from summed gradients (id, g, gb, n, r) in direction of ascent; ``reg`` adds to what samples regularise."""
        opt = self.opt
        t = self.factors[name].join(gradients.where(F.col("name") == name).drop("name"), "id", "left")
        moved = F.col("g").isNotNull()
        kind = opt["optimizer"]
        g = F.zip_with("g", "vec", lambda a, v: a - (2 * reg + F.col("r")) * v)
        if opt.get("per_coordinate_normalize"):
            g = _scaled(g, 1 / F.col("n"))
        m, s = F.col("m"), F.col("s")
        if kind == "adam":
            b1, b2, at = opt["beta1"], opt["beta2"], self.epoch + 1
            m = F.zip_with("m", g, lambda a, x: b1 * a + (1 - b1) * x)
            s = F.zip_with("s", g, lambda a, x: b2 * a + (1 - b2) * x * x)
            t = t.withColumns({"_m": m, "_s": s})
            step = F.zip_with("_m", "_s", lambda a, b: (a / (1 - b1**at)) / (F.sqrt(b / (1 - b2**at)) + opt["eps"]))
        elif kind == "adagrad":
            t = t.withColumns({"_g": g, "_m": m, "_s": F.zip_with("s", g, lambda a, x: a + x * x)})
            step = F.zip_with("_g", "_s", lambda x, b: x / (F.sqrt(b) + opt["eps"]))
        else:
            t = t.withColumns({"_m": m, "_s": s})
            step = g
        new = F.zip_with("vec", step, lambda v, x: v + rate * x)
        t = t.withColumn("_new", F.when(moved, new).otherwise(F.col("vec")))
        vec = F.col("_new")
        if unit_ball:
            vec = _scaled("_new", 1 / F.greatest(F.lit(1.0), F.sqrt(dot("_new", "_new"))))
        bias = F.col("bias") + F.when(moved, rate * (F.col("gb") / F.sqrt("n") - opt["reg_b"] * F.col("bias"))).otherwise(0.0) if opt.get("use_bias") else F.col("bias")
        pick = lambda c: F.when(moved, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
        self.factors[name] = self.keep(t.select("id", vec.alias("vec"), bias.alias("bias"), pick("m"), pick("s")), name)

    def _pair_loss(self) -> Column:
        """Of a sample with the scores si and sj."""
        return softplus_minus(F.col("si") - F.col("sj"))

    def _both_scored(self, samples: DataFrame, n: int, l2: bool = False) -> DataFrame:
        """``samples`` (u, i, j, further columns) with the scores si and sj."""
        one = self._scored(samples, "i", n, l2).withColumnRenamed("s", "si")
        return self._scored(one, "j", n, l2).withColumnRenamed("s", "sj")

    def sampled_loss(self) -> float | None:
        """The mean loss of ``loss_samples``, which are drawn once; asked for by ``compute_loss_on_training``."""
        if not hasattr(self, "_watched"):
            self._watched = self.keep(self.loss_samples())
        return self._both_scored(self._watched, self.n_users, self.opt.get("score_func", "").lower() == "l2").agg(F.avg(self._pair_loss())).first()[0] or 0.0

    def loss_samples(self, n: int | None = None) -> DataFrame:
        """u, i, j: a positive and an unseen item of the root of the number of users (or ``n``), for watching the loss."""
        one = self.rows.groupBy("u").agg(F.min_by(F.struct("row", "u", "i", "free"), F.xxhash64("row", F.lit(self.opt["random_seed"]))).alias("x")).select("x.*")
        n = int(one.count() ** 0.5) if n is None else n
        some = one.orderBy(F.xxhash64("u", F.lit(self.opt["random_seed"] + 1)), "u").limit(n)  # as many users as are asked for
        return self._unseen(some, 0, 1).select("u", "i", "j")


def bpr_updates(p: grid.Block, q: grid.Block, a: np.ndarray, i: np.ndarray, j: np.ndarray, rate: float, opt: dict) -> float:
    """Moves user a towards item i and away from j for one sample after the other; the sum of log(1 + e**-x) before each."""
    total = 0.0
    for some in grid.by_level(grid.levels(a, [i, j], len(p.ids), len(q.ids))):
        u, good, bad = a[some], i[some], j[some]
        own, apart = p.vec[u], q.vec[good] - q.vec[bad]
        x = np.einsum("nd,nd->n", own, apart)
        if opt["use_bias"]:
            x += q.bias[good] - q.bias[bad]
        w = np.where(x > 6, 0.0, np.where(x < -6, 1.0, 1 / (1 + np.exp(np.clip(x, -30, 30)))))
        total += np.logaddexp(0.0, -x).sum()
        p.vec[u] = own + rate * (w[:, None] * apart - opt["reg_u"] * own)
        for name, at, to in (("i", good, w), ("j", bad, -w)):
            if opt[f"update_{name}"]:
                q.vec[at] += rate * (to[:, None] * own - opt[f"reg_{name}"] * q.vec[at])
                if opt["use_bias"]:
                    q.bias[at] += rate * (to - opt["reg_b"] * q.bias[at])
    return float(total)


def bpr_samples(q: grid.Block, a: np.ndarray, b: np.ndarray, seed: tuple, opt: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Users, items and others of a stratum in random order: the others are of the same block of items."""
    rng, n = np.random.default_rng(seed), opt["num_negative_samples"]
    if opt["verify_neg"]:
        who, j = grid.unseen(a, b, q.w, n, rng)
    elif q.w.sum():
        who = np.repeat(np.arange(len(a)), n)
        j = np.searchsorted(np.cumsum(q.w), rng.integers(0, q.w.sum(), len(who)), "right")
    else:
        who = j = np.zeros(0, np.int64)
    order = rng.permutation(len(who))
    return a[who[order]], b[who[order]], j[order]


class BPRMF(Gradient):
    """With sgd, an epoch draws a positive's others from the block of items that it is in; blocks are dealt anew each epoch.

    A user that has all items of a block draws nothing there until the next dealing.
    """

    _n_blocks: int | None = None

    #: Options with their defaults, but for ``compute_loss_on_training``: the epoch's own mean loss costs nothing.
    DEFAULTS = {
        "compute_loss_on_training": False, "num_iters": 100, "lr": 0.002, "min_lr": 0.0001, "update_i": True, "update_j": True, "reg_u": 0.025, "reg_i": 0.025, "reg_j": 0.025, "reg_b": 0.025, "use_bias": True, "optimizer": "sgd",
        "num_negative_samples": 1, "sampling_power": 0.0, "verify_neg": True, "beta1": 0.9, "beta2": 0.999, "per_coordinate_normalize": False,
    }

    def initialize(self, rows: DataFrame, items: DataFrame | None = None) -> "BPRMF":
        self._interactions(rows, items, self.opt["sampling_power"])
        self._start({"P": self.pairs.select(F.col("u").alias("id")).distinct(), "Q": self.item_ids}, True, 1 / self.opt["d"])
        return self

    def negatives(self) -> DataFrame:
        """u, i, j of an epoch: ``num_negative_samples`` for each positive."""
        n = self.opt["num_negative_samples"]
        if self.opt["verify_neg"]:
            return self._unseen(self.rows, 0, n).select("u", "i", "j")
        drawn = self.rows.select("row", "u", "i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("t"))
        return self._at(drawn.withColumn("y", self._random(F.lit(self.mass)))).select("u", "i", "j")

    @property
    def n_blocks(self) -> int:
        partitions = int(self.pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return self._n_blocks or grid.blocks(self.n_rows, self.n_users, self.n_held, self.opt["d"], partitions)

    def step(self) -> float:
        """One pass over all positives; mean log(1 + e**-x) before the step."""
        if self.sequential:
            opt, rates, seed = dict(self.opt), self._rates(self.n_blocks), (self.opt["random_seed"], self.epoch)

            def run(stage: int, task: int, p: grid.Block, q: grid.Block, a: np.ndarray, b: np.ndarray) -> tuple[float, int]:
                a, i, j = bpr_samples(q, a, b, (*seed, stage, task), opt)
                return bpr_updates(p, q, a, i, j, rates[stage], opt), len(a)

            dealt = lambda salts: grid.strata(self.pairs, "u", "i", self.n_blocks, salts)
            return self._rotate("P", "Q", self.weights if opt["sampling_power"] else None, dealt, self.n_blocks, run)
        opt, n = self.opt, self.n_rows * self.opt["num_negative_samples"]
        at = self.keep(self._both_scored(self.negatives(), n).withColumn("x", F.col("si") - F.col("sj")), "samples")
        loss = at.agg(F.avg(softplus_minus("x"))).first()[0] or 0.0
        sums = self._pulled(at.select("u", "i", "j", sigmoid_minus("x").alias("w")), n, (0.0, 0.0, 0.0))
        self._apply("P", sums, opt["lr"], opt["reg_u"])
        self._apply("Q", sums, opt["lr"], opt["reg_i"])
        self.epoch += 1
        return loss


#: Names of scores: dot products, and squared distances below zero.
SCORES = ("dot", "l2")


class WARP(Gradient):
    #: Options with their defaults, but for ``compute_loss_on_training``; ``trials_at_once`` is the size of the first round of trials.
    DEFAULTS = {
        "compute_loss_on_training": False, "d": 64, "num_iters": 40, "lr": 0.05, "min_lr": 0.0001, "optimizer": "adagrad", "threshold": 1.0, "max_trials": 500, "score_func": "dot", "update_i": True, "update_j": True,
        "reg_u": 0.0, "reg_i": 0.0, "reg_j": 0.0, "beta1": 0.9, "beta2": 0.999, "per_coordinate_normalize": False, "trials_at_once": 16,
    }

    def initialize(self, rows: DataFrame, items: DataFrame | None = None) -> "WARP":
        if self.opt["optimizer"] not in ("adagrad", "adam") or self.opt["score_func"].lower() not in SCORES:
            raise ValueError(f"WARP takes adagrad or adam, and a score of {', '.join(SCORES)}")
        self._interactions(rows, items, 0.0)
        self._start({"P": self.pairs.select(F.col("u").alias("id")).distinct(), "Q": self.item_ids}, False, 1 / self.opt["d"])
        return self

    @property
    def l2(self) -> bool:
        return self.opt["score_func"].lower() == "l2"

    def violations(self) -> DataFrame:
        """row, u, i, j, t, width: for each positive the first unseen item within ``threshold`` of it, if ``max_trials`` draws find one.

        Rounds of draws, each twice as large as the one before, go on for the rows that are still open: an open row has its own
        score with it. Draws go to the blocks of their vectors. Of the first round one draw goes ahead, since early in training
        it mostly is a violation, and the others would be shuffled for nothing.
        """
        done, upto, first, left, found = 0, 1, self.opt["trials_at_once"], self.n_rows, []
        open_ = self.keep(self._scored(self.rows, "i", left, self.l2).withColumnRenamed("s", "own"), "open")
        while done < self.opt["max_trials"] and left:
            upto = min(upto, self.opt["max_trials"])
            draws = self._unseen(open_, done, upto - done, ("own",))  # a join by row would shuffle every draw once more
            near = self._scored(draws.select("row", "u", "j", "t", "own"), "j", left * (upto - done), self.l2).where(F.col("own") - F.col("s") < self.opt["threshold"])
            hits = near.groupBy("row").agg(F.min_by(F.struct("j", "t"), "t").alias("f"))
            hits = self.keep(open_.join(hits, "row").select("row", "u", "i", "f.j", "f.t", "width"), "violations", 16)
            found.append(hits)
            done, upto = upto, first if upto < first else 2 * upto + first
            if done < self.opt["max_trials"]:
                open_ = self.keep(open_.join(hits.select("row"), "row", "left_anti"), "open")
                left = open_.count()
        return reduce(DataFrame.unionByName, found)

    def step(self) -> float:
        """One pass over all positives; the share of those with a violation."""
        opt, hits = self.opt, self.violations()
        rank = F.log(F.greatest(F.lit(1), F.floor((self.n_items - F.col("width") - 1) / (F.col("t") + 1)))).cast("double")
        n = hits.count()
        sums = self._pulled(hits.select("u", "i", "j", rank.alias("w")), n, (opt["reg_u"], opt["reg_i"], opt["reg_j"]), self.l2)
        self._apply("P", sums, opt["lr"], 0.0, True)
        self._apply("Q", sums, opt["lr"], 0.0, True)
        self.epoch += 1
        return n / max(1, self.n_rows)

    def _pair_loss(self) -> Column:
        return (F.col("si") - F.col("sj") < self.opt["threshold"]).cast("double")

    def most_similar(self, items, k=10, group="Q", metric=None, pool=None):
        return super().most_similar(items, k, group, metric or ("l2" if self.opt["score_func"].lower() == "l2" else "cosine"), pool)


#: Pairs that read vectors together.
BATCH = 128


def skipgram_updates(inner: grid.Block, outer: grid.Block, context: np.ndarray, centre: np.ndarray, others: np.ndarray | None, rate: float) -> float:
    """Moves contexts' inner vectors towards their centres' outer ones and away from the others'; the sum of losses.

    Frequent words are in nearly all samples, so plain order would leave nothing to run together: ``BATCH`` pairs at a time move
    what they share by the sum of their steps.
    """
    d, total = inner.vec.shape[1], 0.0
    places, labels = np.arange(d), np.zeros(1 if others is None else 1 + others.shape[1])
    labels[0] = 1.0
    words = centre[:, None] if others is None else np.concatenate([centre[:, None], others], 1)
    flat, moved = outer.vec.reshape(-1), inner.vec.reshape(-1)
    for at in range(0, len(context), BATCH):
        who, what = context[at : at + BATCH], words[at : at + BATCH]
        own, there = inner.vec[who], outer.vec[what]
        x = np.einsum("nd,nkd->nk", own, there)
        total += np.logaddexp(0.0, np.where(labels > 0, -x, x)).sum()
        g = rate * (labels - np.where(x > 6, 1.0, np.where(x < -6, 0.0, 1 / (1 + np.exp(-np.clip(x, -30, 30))))))
        np.add.at(flat, (what[:, :, None] * d + places).ravel(), (g[:, :, None] * own[:, None]).ravel())
        np.add.at(moved, (who[:, None] * d + places).ravel(), np.einsum("nk,nkd->nd", g, there).ravel())
    return float(total)


class W2V(Gradient):
    """Skip-gram with negative sampling over a stream (u, pos, token): ``Q`` inner vectors of words, ``L1`` outer ones.

    Others are drawn by count ** 0.75 from the block of words that the centre is in; blocks are dealt anew each epoch.
    """

    #: Options with their defaults.
    DEFAULTS = {"num_iters": 3, "window": 5, "min_count": 5, "sample": 1e-3, "num_negative_samples": 5, "lr": 0.025, "min_lr": 0.0001}

    def initialize(self, stream: DataFrame) -> "W2V":
        vocab = words.numbered(words.vocabulary(stream, self.opt["min_count"], self.opt["sample"]))
        self.ids["vocab"] = self.keep(vocab.select("token", "n", "keep", F.col("vid").cast("long").alias("id")))
        self.stream = self.keep(stream.join(self.ids["vocab"], "token").select("u", "pos", "id", "keep"))
        self._start({"Q": self.ids["vocab"].select("id"), "L1": self.ids["vocab"].select("id")}, True, 1 / self.opt["d"] ** 2)
        self.factors["L1"] = self.keep(self.factors["L1"].withColumn("vec", F.array_repeat(F.lit(0.0), self.opt["d"])), "L1")
        facts = self.ids["vocab"].agg(F.coalesce(F.sum(F.pow("n", F.lit(0.75))), F.lit(0.0)).alias("mass"), F.count("*").alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
        self.weights = self.keep(self.ids["vocab"].select("id", F.greatest(F.lit(1), F.round(F.pow("n", F.lit(0.75)) * (MASS / max(facts.mass, 1.0)))).cast("long").alias("w")))
        partitions = int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.n_blocks = grid.blocks(facts.tokens * self.opt["window"], facts.words, facts.words, self.opt["d"], partitions)
        return self

    def sampled_loss(self) -> None:
        """The epoch's own mean loss is all there is."""

    def index(self, tokens: DataFrame) -> DataFrame:
        """token, id; id null for words out of the vocabulary."""
        return tokens.join(self.ids["vocab"].select("token", "id"), "token", "left")

    def _kept_words(self) -> DataFrame:
        """The stream's words that subsampling keeps in an epoch, with the reach that is drawn for each."""
        w, seed = self.opt["window"], self.opt["random_seed"]
        kept = self.stream.where(_uniform("u", "pos", F.lit(self.epoch), F.lit(seed)) < F.col("keep"))
        return kept.withColumn("reach", w - F.floor(_uniform("u", "pos", F.lit(self.epoch), F.lit(seed + 1)) * w))

    def _strata(self, salts: tuple[tuple, tuple]) -> DataFrame:
        """The strata of ``window_pairs``, which are made and dealt in arrays: no pair is a row."""
        n = self.n_blocks
        kept = self._kept_words().withColumns({"key": grid.dealt("id", n, *salts[0]), "other": grid.dealt("id", n, *salts[1])})
        return grid.gathered(words.reached(kept, self.opt["window"], lambda context, centre: grid.chunked(context[0], centre[0], context[1], centre[2], n), grid.CHUNKS))

    def window_pairs(self) -> DataFrame:
        """u (a context), i (its centre) of an epoch: words that subsampling keeps, within a reach that is drawn for each centre."""
        near = words.following(self._kept_words(), self.opt["window"], ("id", "reach"))
        ways = [F.when(F.col("far") <= F.col(f"{centre}.reach"), F.struct(F.col(f"{context}.id").alias("u"), F.col(f"{centre}.id").alias("i"))) for centre, context in ("ab", "ba")]
        return near.select(F.explode(F.array_compact(F.array(*ways))).alias("x")).select("x.*")

    def step(self) -> float:
        """One pass over the stream; the mean loss of pairs before they move vectors."""
        rates, seed, times = self._rates(self.n_blocks), (self.opt["random_seed"], self.epoch), self.opt["num_negative_samples"]

        def run(stage: int, task: int, inner: grid.Block, outer: grid.Block, a: np.ndarray, b: np.ndarray) -> tuple[float, int]:
            rng = np.random.default_rng((*seed, stage, task))
            order = rng.permutation(len(a))
            a, b = a[order], b[order]
            return skipgram_updates(inner, outer, a, b, grid.others(b, outer.w, times, rng), rates[stage]), len(a)

        return self._rotate("Q", "L1", self.weights, self._strata, self.n_blocks, run)

    def topk_recommendation(self, users, k=10, pool=None, seen=None):
        raise NotImplementedError("item embeddings have no users")
