from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.models import alternating
from millrace.models.alternating import ALS, CFR, EALS, SOLVERS, solve
from millrace.models.base import EarlyStopping, options
from millrace.models.gradient import BPRMF, W2V, WARP, _uniform, bpr_samples
from millrace.models.plsi import PLSI
from millrace.operators import blocks, grid, words


@pytest.fixture(scope="module")
def planted(spark):
    """Users like items of their third."""
    cells = spark.range(120 * 30).select((F.col("id") % 120).alias("u"), F.floor(F.col("id") / 120).alias("i"))
    return cells.where("u % 3 = i % 3 AND pmod(xxhash64(u, i), 3) <> 0").withColumn("v", F.lit(1.0)).cache()


def precision(spark, model):
    top = model.topk_recommendation(spark.range(30).toDF("id"), 3)
    return top.agg(F.avg((F.col("q") % 3 == F.col("id") % 3).cast("double"))).first()[0]


def test_options():
    assert options({"reg": 0.1}, {"reg": 0.5})["reg"] == 0.5
    for wrong in ({"reg": "x"}, {"accelerator": True}, {"reg": 0.1, "no_such": 1}):
        with pytest.raises(RuntimeError):
            options({"reg": 0.1}, wrong)
    with pytest.raises(RuntimeError):
        ALS({"reg_j": 0.1})
    for refused in ("accelerator", "inherit_opt", "random_positive"):
        with pytest.raises(RuntimeError):
            BPRMF({refused: {"model_path": "x"}})
    assert options({"reg": 0.1}, {"num_workers": 4, "accelerator": False, "inherit_opt": None})["reg"] == 0.1
    assert W2V().opt["lr"] == 0.025 and ALS({"d": 128, "optimizer": "llt"}).opt["optimizer"] == "llt"
    assert BPRMF({"reg_j": 9.9, "reg_b": 0.0, "update_i": False}).opt["reg_j"] == 9.9 and BPRMF().opt["lr"] == 0.002
    assert WARP({"reg_u": 0.1, "min_lr": 0.0, "eps": 1e-8}).opt["max_trials"] == 500


def test_early_stopping():
    stop = EarlyStopping(5)
    assert [stop(x) for x in range(1, 7)] == [False] * 5 + [True]


@pytest.mark.parametrize("name", SOLVERS)
def test_solvers_agree(name):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4, 9, 6))
    a, b = np.einsum("nki,nkj->nij", x, x) + np.eye(6), rng.normal(size=(4, 6))
    got = np.zeros((4, 6))
    for _ in range(60):
        got = solve(a, b, got, {"optimizer": name, "num_cg_max_iters": 6, "cg_tolerance": 1e-20, "block_size": 2})
    assert np.allclose(got, np.linalg.solve(a, b[..., None])[..., 0], atol=1e-4)


def test_als(spark, planted, tmp_path):
    model = ALS({"d": 6, "num_iters": 3, "optimizer": "llt"}).initialize(planted)
    p = {r.id: np.array(r.vec) for r in model.factors["Q"].collect()}
    calls = []
    losses = [model.step() for _ in range(2)]
    assert losses[1] < losses[0] and precision(spark, model) > 0.9
    model.opt["num_iters"] = 2
    out = model.train(lambda k, m: calls.append(k), lambda: {"x": 1.0})
    assert calls == [0, 1] and out["val_x"] == 1.0
    # one half epoch against NumPy
    q = {r.id: np.array(r.vec) for r in model.factors["Q"].collect()}
    model.half("u")
    got = {r.id: np.array(r.vec) for r in model.factors["P"].collect()}
    y = np.stack(list(q.values()))
    for u in (0, 7):
        x = np.stack([q[r.i] for r in planted.where(f"u = {u}").collect()])
        want = np.linalg.solve(y.T @ y + 8 * x.T @ x + 0.1 * np.eye(6), 9 * x.sum(0))
        assert np.allclose(got[u], want)
    assert len(p) == 30
    model.save(str(tmp_path / "m"))
    part = ALS.load(spark, str(tmp_path / "m"), ["Q"])
    assert set(part.factors) == {"Q"} and part.most_similar(spark.range(2).toDF("id"), 3).count() == 6


def arrays(model, name):
    return {r.id: np.array(r.vec) for r in model.factors[name].collect()}


def entries(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.u, []).append((r.i, r.v))
    return out


@pytest.mark.parametrize("wide", [20_000, 3])
@pytest.mark.parametrize("d", [5, 30])
def test_epochs_against_numpy(spark, planted, monkeypatch, wide, d):
    """Half epochs of ALS and EALS, with rows whole and in parts, from the factors they start with."""
    monkeypatch.setattr(blocks, "WIDE", wide)
    rows = planted.withColumn("v", (F.col("u") % 3 + 1).cast("double"))
    by_user, alpha = entries(rows), 8.0
    model = ALS({"d": d, "optimizer": "llt"}).initialize(rows)
    q = arrays(model, "Q")
    y = np.stack(list(q.values()))
    assert model.blocks["u"].split == (wide == 3)
    model.half("u")
    got = arrays(model, "P")
    for u, held in by_user.items():
        x, v = np.stack([q[i] for i, _ in held]), np.array([v for _, v in held])
        assert np.allclose(got[u], np.linalg.solve(y.T @ y + alpha * (x * v[:, None]).T @ x + 0.1 * np.eye(d), ((1 + alpha * v)[:, None] * x).sum(0)))
    model = EALS({"d": d, "c0": 10.0}).initialize(rows)
    p, q, c = arrays(model, "P"), arrays(model, "Q"), {r.id: r.e for r in model.weights.collect()}
    loss, want = model.half("u"), 0.0
    g = sum(c[i] * np.outer(x, x) for i, x in q.items())
    got = arrays(model, "P")
    for u, held in by_user.items():
        x, v, w = np.stack([q[i] for i, _ in held]), np.array([v for _, v in held]), np.array([c[i] for i, _ in held])
        own, a = p[u].copy(), 1 + alpha * v
        hat = x @ own
        want += (a * (v - hat) ** 2 - w * hat**2).sum() + own @ g @ own
        for k in range(d):
            rest = x @ own - own[k] * x[:, k]
            own[k] = (((a * v - (a - w) * rest) * x[:, k]).sum() - (g[k] @ own - g[k, k] * own[k])) / (((a - w) * x[:, k] ** 2).sum() + g[k, k] + 0.1)
        want += 0.1 * own @ own
        assert np.allclose(got[u], own)
    assert np.isclose(loss, want)
    before = arrays(model, "Q")
    model.half("i")
    p, got = got, arrays(model, "Q")
    g = sum(np.outer(x, x) for x in p.values())
    by_item = entries(rows.select(F.col("i").alias("u"), F.col("u").alias("i"), "v"))
    for i, held in by_item.items():
        x, v, own = np.stack([p[u] for u, _ in held]), np.array([v for _, v in held]), before[i].copy()
        m = x.T @ (x * (1 + alpha * v - c[i])[:, None]) + c[i] * g
        b = ((1 + alpha * v) * v) @ x
        for k in range(d):
            own[k] = (b[k] - m[k] @ own + m[k, k] * own[k]) / (m[k, k] + 0.1)
        assert np.allclose(got[i], own)


def test_blocks_of_dimensions_are_the_full_systems(spark, planted, monkeypatch):
    """Sweeps by predictions against the same sweeps over whole systems, which rows in parts take."""
    rows, found = planted.withColumn("v", (F.col("u") % 2 + 1).cast("double")), []
    for wide in (20_000, 3):
        monkeypatch.setattr(blocks, "WIDE", wide)
        model = ALS({"d": 7, "optimizer": "ialspp", "block_size": 3, "num_iters": 2, "adaptive_reg": True}).initialize(rows)
        losses = [model.step(), model.step()]
        found.append((losses, arrays(model, "P"), arrays(model, "Q")))
    assert np.allclose(found[0][0], found[1][0]) and losses[1] < losses[0]
    for k in (1, 2):
        assert all(np.allclose(x, found[1][k][i]) for i, x in found[0][k].items())


def test_plsi_epoch_against_numpy(spark, planted):
    model = PLSI({"d": 4}).initialize(planted)
    p, q = arrays(model, "P"), arrays(model, "Q")
    counts, loss, n = {}, 0.0, 0
    for r in planted.collect():
        j = np.maximum(p[r.u] * q[r.i], 1e-10)
        loss, n = loss - np.log(j.sum()), n + 1
        for key in (("u", r.u), ("i", r.i)):
            counts[key] = counts.get(key, 0) + j / j.sum()
    assert np.isclose(model.step(), loss / n)
    for u, x in arrays(model, "P").items():
        y = counts["u", u] + 1 / 4
        assert np.allclose(x, y / y.sum())
    total = sum(counts["i", i] + 1 / len(q) for i in q)
    for i, x in arrays(model, "Q").items():
        assert np.allclose(x, (counts["i", i] + 1 / len(q)) / total)


def replayed(model, first, second, weights, samples, n, loop):
    """An epoch over blocks by plain loops: ``loop(stage, task, first, second, a, b)`` over the samples of each stratum in turn."""
    seed, spark = model.opt["random_seed"], samples.sparkSession
    tables, blocks = {}, {}
    for name, salt in ((first, (seed,)), (second, (seed, model.epoch + 1))):
        tables[name] = {r.id: (np.array(r.vec), r.bias) for r in model.factors[name].collect()}
        ids = spark.createDataFrame([(i,) for i in tables[name]], "id long")
        blocks[name] = {r.id: r.b for r in ids.select("id", grid.dealt("id", n, *salt).alias("b")).collect()}
    w = {r.id: r.w for r in weights.collect()}
    make = lambda name, b: [i for i in sorted(tables[name]) if blocks[name][i] == b]
    held = {(name, b): grid.Block(np.array(ids, np.int64), np.array([tables[name][i][0] for i in ids]), np.array([tables[name][i][1] for i in ids]), np.array([w.get(i, 0) for i in ids])) for name in (first, second) for b in range(n) if (ids := make(name, b))}
    rows = sorted((r.u, r.i) for r in samples.select("u", "i").collect())
    for stage in range(n):
        for task in range(n):
            other = (task + stage) % n
            some = [(u, i) for u, i in rows if blocks[first][u] == task and blocks[second][i] == other]
            if some:
                p, q = held[first, task], held[second, other]
                a, b = (np.searchsorted(t.ids, np.array(x)) for t, x in zip((p, q), zip(*some, strict=True), strict=True))
                loop(stage, task, p, q, a, b)
    return [{int(i): t.vec[k] for (name, _), t in held.items() if name == want for k, i in enumerate(t.ids)} for want in (first, second)]


@pytest.mark.parametrize("n", [1, 4])
def test_bpr_epoch_against_numpy(spark, planted, n):
    """Two epochs of plain descent, sample after sample, in rotating blocks."""
    model = BPRMF({"d": 4, "lr": 0.1, "reg_j": 0.5, "num_iters": 10, "num_negative_samples": 2}).initialize(planted)
    model._n_blocks, own = n, {(r.u, r.i) for r in planted.collect()}
    opt, seen = model.opt, []

    def loop(stage, task, p, q, a, b):
        rate = max(opt["min_lr"], opt["lr"] * (1 - (model.epoch + stage / n) / 10))
        for u, i, j in zip(*bpr_samples(q, a, b, (0, model.epoch, stage, task), opt), strict=True):
            assert (p.ids[u], q.ids[j]) not in own and (p.ids[u], q.ids[i]) in own
            x = p.vec[u] @ (q.vec[i] - q.vec[j]) + q.bias[i] - q.bias[j]
            seen.append(np.log1p(np.exp(-x)))
            w = 0.0 if x > 6 else 1.0 if x < -6 else 1 / (1 + np.exp(x))
            user, apart = p.vec[u].copy(), q.vec[i] - q.vec[j]
            p.vec[u] += rate * (w * apart - opt["reg_u"] * user)
            q.vec[i] += rate * (w * user - opt["reg_i"] * q.vec[i])
            q.vec[j] += rate * (-w * user - opt["reg_j"] * q.vec[j])
            q.bias[i] += rate * (w - opt["reg_b"] * q.bias[i])
            q.bias[j] += rate * (-w - opt["reg_b"] * q.bias[j])

    for _ in range(2):
        seen.clear()
        p, q = replayed(model, "P", "Q", model.weights, model.pairs, n, loop)
        assert np.isclose(model.step(), np.mean(seen)) and len(seen) == 2 * len(own)
        for name, want in (("P", p), ("Q", q)):
            got = arrays(model, name)
            assert got.keys() == want.keys() and all(np.allclose(x, want[k]) for k, x in got.items())


@pytest.mark.parametrize("n", [1, 3])
def test_skipgram_epoch_against_numpy(spark, n):
    stream = spark.range(3000).select(F.floor(F.col("id") / 60).alias("u"), (F.col("id") % 60).alias("pos"), F.concat(F.lit("w"), F.pmod(F.xxhash64("id"), F.lit(40))).alias("token"))
    model = W2V({"d": 5, "window": 3, "min_count": 1, "sample": 0.02, "lr": 0.1, "num_negative_samples": 3}).initialize(stream)
    model.n_blocks, losses = n, []

    def loop(stage, task, inner, outer, a, b):
        rate, rng = max(0.0001, 0.1 * (1 - (model.epoch + stage / n) / 3)), np.random.default_rng((0, model.epoch, stage, task))
        order = rng.permutation(len(a))
        others = grid.others(b[order], outer.w, 3, rng)
        assert not (others == b[order][:, None]).any()
        pairs = list(zip(a[order], b[order], others, strict=True))
        for first in range(0, len(pairs), 128):
            inner_before, outer_before = inner.vec.copy(), outer.vec.copy()
            for c, i, js in pairs[first : first + 128]:
                losses.append(0.0)
                for k, j in enumerate([i, *js]):
                    x = inner_before[c] @ outer_before[j]
                    losses[-1] += np.log1p(np.exp(x if k else -x))
                    g = rate * ((k == 0) - 1 / (1 + np.exp(-x)))
                    inner.vec[c] += g * outer_before[j]
                    outer.vec[j] += g * inner_before[c]

    for _ in range(2):
        losses.clear()
        p, q = replayed(model, "Q", "L1", model.weights, model.window_pairs(), n, loop)
        assert np.isclose(model.step(), np.mean(losses)) and len(losses) > 3000
        for name, want in (("Q", p), ("L1", q)):
            assert all(np.allclose(x, want[k]) for k, x in arrays(model, name).items())


def test_window_pairs_follow_the_reach(spark):
    """Contexts within the centre's drawn reach over the words that are left, hot user cut in pieces of 20."""
    stream = spark.range(400).select((F.col("id") % 7 == 0).cast("long").alias("u"), F.col("id").alias("pos"), F.concat(F.lit("w"), F.pmod(F.xxhash64("id"), F.lit(30))).alias("token"))
    model = W2V({"d": 2, "window": 4, "min_count": 1, "sample": 0.05}).initialize(stream)
    whole = model.window_pairs().groupBy("u", "i").count()
    words.PIECE, before = 20, words.PIECE
    try:
        cut = model.window_pairs().groupBy("u", "i").count()
        assert cut.exceptAll(whole).count() == 0 and whole.exceptAll(cut).count() == 0
    finally:
        words.PIECE = before
    kept = model.stream.where(_uniform("u", "pos", F.lit(0), F.lit(0)) < F.col("keep")).withColumn("reach", 4 - F.floor(_uniform("u", "pos", F.lit(0), F.lit(1)) * 4))
    want, held = Counter(), {}
    for r in kept.orderBy("pos").collect():
        held.setdefault(r.u, []).append((r.id, r.reach))
    for at in held.values():
        for k, (centre, reach) in enumerate(at):
            want.update((at[c][0], centre) for c in range(max(0, k - reach), min(len(at), k + reach + 1)) if c != k)
    assert {(r.u, r.i): r["count"] for r in whole.collect()} == dict(want)


def test_draws_of_a_block():
    rng = np.random.default_rng(1)
    pairs = np.array(sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 5, 60), rng.integers(0, 12, 60), strict=True)} | {(7, b) for b in range(12)} | {(8, b) for b in range(12) if b not in (3, 6)}))
    a, b = pairs.T
    w = np.array([1, 5, 2, 0, 9, 1, 1, 3, 2, 4, 1, 7])
    who, j = grid.unseen(a, b, w, 4000, rng)
    held = {(x, y) for x, y in pairs.tolist()}
    assert not [1 for x, y in zip(a[who].tolist(), j.tolist(), strict=True) if (x, y) in held or w[y] == 0]
    assert 7 not in a[who] and set(j[a[who] == 8].tolist()) == {6}
    free = [k for k in range(12) if (0, k) not in held and w[k]]
    n = np.bincount(j[a[who] == 0], minlength=12) / (a[who] == 0).sum()
    assert all(abs(n[k] - w[k] / w[free].sum()) < 0.02 for k in free)
    got = grid.others(np.full(20_000, 4), w, 1, rng)
    assert not (got == 4).any() and abs((got == 11).mean() - 7 / 27) < 0.02
    assert grid.others(np.array([0, 1]), np.array([0, 3]), 1, rng) is None


def test_levels_are_the_plain_order():
    rng = np.random.default_rng(2)
    a, i, j, k = (rng.integers(0, n, 500) for n in (20, 30, 30, 30))
    for others in ([i, j], [i, j, k]):
        level = grid.levels(a, others, 20, 30)
        for t in range(500):
            touched = lambda x: {("a", a[x]), *(("b", o[x]) for o in others)}
            assert level[t] == max([level[s] + 1 for s in range(t) if touched(s) & touched(t)], default=0)
        assert [x for part in grid.by_level(level) for x in part.tolist()] == sorted(range(500), key=lambda t: (level[t], t))


@pytest.mark.parametrize("power", [0.0, 0.75])
def test_every_positive_finds_an_unseen_item(spark, power):
    """Users that hold nearly all items, or all of them; 41 positives of which earlier versions trained 8."""
    rows = [(0, i) for i in range(38)] + [(1, i) for i in range(40)] + [(2, 0), (2, 39), (3, 5)]
    df = spark.createDataFrame(rows, "u long, i long")
    model = BPRMF({"d": 3, "num_negative_samples": 3, "sampling_power": power}).initialize(df, spark.range(40))
    own, popular = set(rows), {i for _, i in rows}
    drawn = [(r.u, r.i, r.j) for r in model.negatives().collect()]
    assert len(drawn) == 3 * (38 + 2 + 1) and not [x for x in drawn if (x[0], x[2]) in own or x[0] == 1]
    assert {x[2] for x in drawn if x[0] == 0} == {38, 39} and (power == 0 or {x[2] for x in drawn} <= popular)
    assert model.step() > 0
    assert model.loss_samples(3).count() == 2 + (1 - (1 in {r.u for r in model.rows.where("free = 0").collect()})) or model.loss_samples().count() <= 2


def test_draws_follow_weights(spark):
    rows = [(u, i) for u in range(400) for i in range(8) if u % (i + 1) == 0]
    model = BPRMF({"d": 2, "num_negative_samples": 20, "sampling_power": 1.0, "verify_neg": False}).initialize(spark.createDataFrame(rows, "u long, i long"))
    drawn = {r.j: r.n for r in model.negatives().groupBy("j").agg(F.count("*").alias("n")).collect()}
    n, total = {i: sum(1 for _, k in rows if k == i) for i in range(8)}, sum(drawn.values())
    for i in range(8):
        assert abs(drawn[i] / total - n[i] / len(rows)) < 0.02


def test_warp_goes_on_until_max_trials(spark):
    """Only one of 300 items violates: 16 draws seldom find it, 500 mostly do, and the first hit counts."""
    df = spark.createDataFrame([(u, 0) for u in range(40)], "u long, i long")
    found = {}
    for most in (16, 500):
        model = WARP({"d": 2, "max_trials": most, "threshold": 0.5}).initialize(df, spark.range(300))
        model.factors["P"] = model.factors["P"].withColumn("vec", F.array(F.lit(1.0), F.lit(0.0)))
        model.factors["Q"] = model.factors["Q"].withColumn("vec", F.array(F.when(F.col("id").isin(0, 7), 1.0).otherwise(0.0), F.lit(0.0)))
        rows = model.violations().collect()
        assert all(r.j == 7 and r.t < most for r in rows)
        drawn = model._unseen(model.rows, 0, most).where("j = 7").groupBy("u").agg(F.min("t").alias("t"))
        assert {(r.u, r.t) for r in rows} == {(r.u, r.t) for r in drawn.collect()}
        found[most] = len(rows)
        assert model.step() == found[most] / 40
    assert found[16] < 10 < 25 < found[500]


@pytest.mark.parametrize("score", ["dot", "l2"])
@pytest.mark.parametrize("update_i", [True, False])
def test_warp_step_against_numpy(spark, planted, score, update_i):
    """One Adagrad step from the violations that the epoch draws, and these against the draws in their order."""
    model = WARP({"d": 4, "lr": 0.3, "score_func": score, "threshold": 0.05, "max_trials": 20, "trials_at_once": 4, "reg_u": 0.01, "reg_i": 0.02, "reg_j": 0.03, "update_i": update_i}).initialize(planted)
    for name in "PQ":  # longer vectors, so that not every draw is a hit
        model.factors[name] = model.keep(model.factors[name].withColumn("vec", F.transform("vec", lambda x: 2 * x)), name)
    p, q = arrays(model, "P"), arrays(model, "Q")
    s = lambda u, i: p[u] @ q[i] if score == "dot" else -((p[u] - q[i]) ** 2).sum()
    hits = {r.row: r for r in model.violations().collect()}
    draws = {}
    for r in model._unseen(model.rows, 0, 20).collect():
        draws.setdefault((r.row, r.u, r.i), {})[r.t] = r.j
    for (row, u, i), js in draws.items():
        first = next((t for t in range(20) if s(u, i) - s(u, js[t]) < 0.05), None)
        assert (hits[row].t, hits[row].j) == (first, js[first]) if first is not None else row not in hits
    assert 0 < len(hits) < len(draws)
    held = {}
    for r in hits.values():
        w = np.log(max(1, (model.n_items - r.width - 1) // (r.t + 1)))
        u, i, j = p[r.u], q[r.i], q[r.j]
        gs = (w * (i - j), w * u, -w * u) if score == "dot" else (2 * w * (i - j), w * (u - i), -w * (u - j))
        for key, g, reg in ((("P", r.u), gs[0], 0.01), (("Q", r.i), gs[1], 0.02), (("Q", r.j), gs[2], 0.03)):
            if update_i or key != ("Q", r.i) or reg == 0.03:
                held.setdefault(key, []).append((g, reg))
    assert model.step() == len(hits) / len(draws)
    for name, old in (("P", p), ("Q", q)):
        for k, x in arrays(model, name).items():
            want = old[k]
            if gs := held.get((name, k)):
                g = sum(g for g, _ in gs) - sum(r for _, r in gs) * old[k]
                want = old[k] + 0.3 * g / (np.sqrt(g * g) + 1e-10)
            assert np.allclose(x, want / max(1.0, np.linalg.norm(want)), atol=1e-7), (name, k)


@pytest.mark.parametrize("kind, opt", [(EALS, {"c0": 10.0}), (PLSI, {"num_iters": 8, "d": 4})])
def test_alternating(spark, planted, kind, opt):
    model = kind({"d": 6, "num_iters": 3} | opt).initialize(planted)
    losses = [model.step() for _ in range(model.opt["num_iters"])]
    assert losses[-1] < losses[0] and precision(spark, model) > 0.9


@pytest.mark.parametrize("kind, opt", [(BPRMF, {"optimizer": "adam", "lr": 0.1, "num_iters": 6, "per_coordinate_normalize": True}), (WARP, {"lr": 0.2, "num_iters": 3})])
def test_ranking(spark, planted, kind, opt):
    model = kind({"d": 6} | opt).initialize(planted)
    model.train()
    assert precision(spark, model) > 0.8
    if kind is WARP:
        assert model.factors["P"].where(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x) > 1.0001).count() == 0


@pytest.mark.parametrize("wide", [20_000, 4])
def test_cfr_epoch_against_numpy(spark, planted, monkeypatch, wide):
    """Users, items (by both kinds of equations), contexts and both biases, with rows whole and in parts."""
    monkeypatch.setattr(blocks, "WIDE", wide)
    stream = planted.select("u", F.row_number().over(Window.partitionBy("u").orderBy(F.xxhash64("u", "i"))).alias("pos"), "i")
    d, l, alpha = 4, 0.7, 8.0
    model = CFR({"d": d, "l": l, "k": 1, "optimizer": "llt", "window": 2}).initialize(stream)
    for _ in range(2):  # biases are zero before the first
        p, q, c = (arrays(model, name) for name in "PQC")
        qb, cb = ({r.id: r.bias for r in model.factors[name].collect()} for name in "QC")
        model.step()
    by_user, by_item, by_w, by_c = {}, {}, {}, {}
    for r in planted.collect():
        by_user.setdefault(r.u, []).append(r.i)
        by_item.setdefault(r.i, []).append(r.u)
    for r in model.pairs.collect():
        by_w.setdefault(r.w, []).append((r.c, r.v))
        by_c.setdefault(r.c, []).append((r.w, r.v))
    assert by_w and model.contexts["w"].split == (wide == 4)
    eye, gram = np.eye(d), lambda t: sum(np.outer(x, x) for x in t.values())
    g = gram(q)
    p = {u: np.linalg.solve(l * g + 0.1 * eye + l * alpha * sum(np.outer(q[i], q[i]) for i in held), l * (1 + alpha) * sum(q[i] for i in held)) for u, held in by_user.items()}
    g, new = gram(p), {}
    for i, held in by_item.items():
        a = l * g + 0.1 * eye + l * alpha * sum(np.outer(p[u], p[u]) for u in held)
        b = l * (1 + alpha) * sum(p[u] for u in held)
        for k, v in by_w.get(i, ()):
            a, b = a + np.outer(c[k], c[k]), b + (v - qb[i] - cb[k]) * c[k]
        new[i] = np.linalg.solve(a, b)
    q, qb = new, {i: sum(v - cb[k] - new[i] @ c[k] for k, v in by_w.get(i, ())) / max(1, len(by_w.get(i, ()))) for i in new}
    new = {k: np.linalg.solve(0.1 * eye + sum(np.outer(q[w], q[w]) for w, _ in held), sum((v - cb[k] - qb[w]) * q[w] for w, v in held)) for k, held in by_c.items()}
    c = c | new
    cb = {k: sum(v - qb[w] - q[w] @ c[k] for w, v in by_c.get(k, ())) / max(1, len(by_c.get(k, ()))) for k in c}
    for name, want, bias in (("P", p, None), ("Q", q, qb), ("C", c, cb)):
        assert all(np.allclose(x, want[i], atol=1e-7) for i, x in arrays(model, name).items()), name
        assert bias is None or all(np.isclose(r.bias, bias[r.id], atol=1e-7) for r in model.factors[name].collect()), name


def test_stream_models(spark, planted):
    stream = planted.select("u", F.row_number().over(Window.partitionBy("u").orderBy(F.xxhash64("u", "i"))).alias("pos"), "i")
    model = CFR({"d": 6, "num_iters": 1, "k": 1}).initialize(stream)
    model.train()
    assert precision(spark, model) > 0.9
    words = W2V({"d": 6, "num_iters": 2, "lr": 0.2, "sample": 0.0, "min_count": 2}).initialize(stream.select("u", "pos", F.col("i").cast("string").alias("token")))
    losses = [words.step() for _ in range(3)]
    assert losses[-1] < losses[0]
    assert words.index(spark.createDataFrame([("nope",)], "token string")).first().id is None
    with pytest.raises(NotImplementedError):
        words.topk_recommendation(spark.range(1))


@pytest.mark.parametrize("kind, opt", [(BPRMF, {"lr": 0.1}), (BPRMF, {"optimizer": "adam", "lr": 0.1}), (ALS, {"optimizer": "llt"})])
def test_resumed_training_is_unbroken_training(spark, planted, tmp_path, kind, opt):
    opt = {"d": 4, "num_iters": 4, "save_period": 1, "early_stopping_rounds": 3} | opt
    whole = kind(opt).initialize(planted)
    whole.train()

    def lost(k, metrics):
        if k == 2:
            raise KeyboardInterrupt  # the driver goes in the third epoch, after its step

    broken, folder = kind(opt).initialize(planted), f"file://{tmp_path}/epochs"
    with pytest.raises(KeyboardInterrupt):
        broken.train(lost, lambda: {"x": 0.0}, folder)
    again = kind(opt).initialize(planted).resume(folder)
    steps = []
    again.train(lambda k, m: steps.append(k), lambda: {"x": 0.0}, folder)
    assert steps == [2, 3]
    for name in ("P", "Q"):
        got, want = arrays(again, name), arrays(whole, name)
        assert got.keys() == want.keys() and all(np.allclose(x, want[k], rtol=1e-9) for k, x in got.items())
    with pytest.raises(ValueError):
        kind(opt | {"d": 5}).initialize(planted).resume(folder)
    with pytest.raises(ValueError):
        kind(opt).initialize(planted).resume(f"file://{tmp_path}/nothing")


def test_options_have_effect(spark, planted):
    """validation, compute_loss_on_training, save_period with save_best, and the refusal of normalized vectors."""
    model = ALS({"d": 4, "num_iters": 2, "optimizer": "llt", "validation": {"topk": 3, "samples": 9}, "compute_loss_on_training": False, "save_best": True}).initialize(planted)
    seen = []
    assert set(model.validation_data(planted.where("u < 20")).train(lambda k, m: seen.append(k))) == {"val_ndcg", "val_map", "val_accuracy", "val_auc", "val_rmse", "val_error"}
    assert seen == [0, 1]
    silent = ALS({"d": 4, "num_iters": 1, "validation": {"topk": 3}, "evaluation_on_learning": False}).initialize(planted).validation_data(planted)
    assert set(silent.train()) == {"train_loss"}
    model.normalize("Q")
    with pytest.raises(RuntimeError):
        model.topk_recommendation(spark.range(2).toDF("id"))
    bpr = BPRMF({"d": 4, "num_iters": 3, "lr": 0.3, "compute_loss_on_training": True}).initialize(planted)
    losses = []
    bpr.train(lambda k, m: losses.append(m["train_loss"]), dict)
    p, q = arrays(bpr, "P"), arrays(bpr, "Q")
    b = {r.id: r.bias for r in bpr.factors["Q"].collect()}
    watched = bpr._watched.collect()
    want = np.mean([np.log1p(np.exp(-(p[r.u] @ (q[r.i] - q[r.j]) + b[r.i] - b[r.j]))) for r in watched])
    assert np.isclose(losses[-1], want) and losses[-1] < losses[0] and len(watched) == 10


def test_warm_start(spark, planted):
    a, b = (PLSI({"d": 3, "random_seed": s}).initialize(planted) for s in (1, 2))
    names = planted.select(F.col("u").alias("id")).distinct().withColumn("key", F.col("id").cast("string"))
    items = planted.select(F.col("i").alias("id")).distinct().withColumn("key", F.col("id").cast("string"))
    b.inherit(names, items, a, names.where("id < 10"), items)
    both = a.factors["P"].withColumnRenamed("vec", "old").join(b.factors["P"], "id")
    assert both.where("old = vec").count() == 10 and a.factors["Q"].exceptAll(b.factors["Q"]).count() == 0


def test_serving_by_key(spark, planted):
    model = ALS({"d": 4, "num_iters": 1, "optimizer": "llt"}).initialize(planted)
    users = planted.select(F.col("u").cast("int").alias("idx")).distinct().withColumn("key", F.concat(F.lit("u"), "idx"))
    items = planted.select(F.col("i").cast("int").alias("idx")).distinct().withColumn("key", F.concat(F.lit("i"), "idx"))
    with pytest.raises(ValueError):
        model.recommend(["u1"])
    model.named(users, items).train()
    got = model.recommend(["u1", "nobody"], 3, pool=["i1", "i2", "i5", "nothing"]).orderBy("rank").collect()
    assert {r.user for r in got} == {"u1"} and {r["item"] for r in got} == {"i1", "i2", "i5"}
    by_index = model.recommend(["u1"], 3, pool=np.array([1, 2, 5])).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in by_index]
    assert {r.near for r in model.similar(["i0"], 2, pool=["i3", "i6", "i0"]).collect()} == {"i3", "i6"}
    assert len(model.feature("u3", "user")) == 4 and model.feature("nobody", "user") is None
    for pool in (["nothing"], np.array([], int)):
        with pytest.raises(ValueError):
            model.recommend(["u1"], pool=pool)
    with pytest.raises(ValueError):
        model.recommend("u1")
    vali = planted.where("u < 20 AND i < 9")
    seen = []
    out = model.train(lambda k, m: seen.append(m), model.validated(vali, samples=5))
    assert set(out) == {"train_loss", "val_ndcg", "val_map", "val_accuracy", "val_auc", "val_rmse", "val_error"} and len(seen) == 1


def test_associations_are_shifted_pmi_of_pairs(spark, monkeypatch):
    """Without a table of pairs; words beside themselves, gaps between places and cut streams included."""
    rng = np.random.default_rng(4)
    rows = [(u, 3 * p, int(i)) for u, n in enumerate((1, 7, 60, 200)) for p, i in enumerate(rng.integers(0, 12, n))]
    stream = spark.createDataFrame(rows, "u long, pos int, i long")
    want = {(r.w, r.c): r.v for r in words.shifted_pmi(words.cooccurrence(stream, 3), 1).collect()}
    monkeypatch.setattr(words, "shifted_pmi", None)
    for piece in (None, 40):
        got = {(r.w, r.c): r.v for r in words.associations(stream, 3, 1, piece).collect()}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want) and any(w == c for w, c in want)


def test_draws_carry_columns_of_their_rows(spark):
    """So that a positive's score needs no join with its draws."""
    pairs = spark.createDataFrame([(u, i, 1) for u in range(6) for i in range(10) if (u + i) % 3], "u long, i long, v long")
    model = WARP({"d": 2, "num_iters": 1, "random_seed": 1}).initialize(pairs)
    drawn = model._unseen(model.rows.withColumn("own", 100 * F.col("u") + F.col("i")), 0, 4, ("own",)).collect()
    own = {r.row: 100 * r.u + r.i for r in model.rows.collect()}
    assert len(drawn) == 4 * model.n_rows and all(r.own == own[r.row] for r in drawn)
    plain = {(r.row, r.t): r.j for r in model._unseen(model.rows, 0, 4).collect()}
    assert plain == {(r.row, r.t): r.j for r in drawn}
    hits = model.violations()
    assert hits.columns == ["row", "u", "i", "j", "t", "width"] and hits.count() > 0


def test_blocks_are_few_and_links_are_lists(spark):
    """Blocks follow the cores, not the shuffle partitions, and a row or column has one row of links: each block asks for vectors anew."""
    from millrace.operators.blocks import Blocks

    def places(t):
        import pyarrow as pa

        columns = t.ids[t.row], t.far_ids[t.at], t.own[t.row, 0], t.far[t.at, 1], t.own_e[t.row], t.far_e[t.at]
        return pa.table(dict(zip(("u", "i", "p", "q", "e", "f"), columns, strict=True)))

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        blocks = Blocks(spark.range(600).selectExpr("id % 30 AS u", "id % 41 AS i", "1.0 AS v"), "u", "i")
        assert blocks.n == 2 * spark.sparkContext.defaultParallelism < 64
        assert blocks.mine.count() == 30 and blocks.other.count() == 41
        own, far = (spark.range(n).selectExpr("id", "array(id + 0.5D, -id * 1D) AS vec", "id * 2D AS e") for n in (30, 41))
        seen = blocks.each(own, far, 2, places, "u long, i long, p double, q double, e double, f double").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(tuple, seen)) == sorted((k % 30, k % 41, k % 30 + 0.5, -float(k % 41), k % 30 * 2.0, k % 41 * 2.0) for k in range(600))


def test_batch_gradients_join_users_last(spark):
    """Rows go to their user with one difference, not with three vectors: the outermost join is by user."""
    from millrace.operators.steps import bpr_gradients

    factors = spark.range(9).selectExpr("id", "array(id * 0.1D, 1D) AS vec")
    plan = bpr_gradients(spark.range(9).selectExpr("id AS u", "8 - id AS i", "(id + 1) % 9 AS j"), factors, factors, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "(u#" in next(line for line in plan.splitlines() if "Join" in line)


def test_cfr_reads_pairs_once_an_equation(spark, planted, monkeypatch):
    """Biases come from sums of the equations, pairs are written once for both ways, and no join carries a vector for each pair."""
    made = []
    monkeypatch.setattr(alternating, "Blocks", lambda *a, **b: made.append(blocks.Blocks(*a, **b)) or made[-1])
    stream = planted.select("u", F.row_number().over(Window.partitionBy("u").orderBy(F.xxhash64("u", "i"))).alias("pos"), "i")
    model = CFR({"d": 3, "num_iters": 1, "k": 1}).initialize(stream)
    assert len(made) == 3 and model.contexts["w"] is model.contexts["c"] and not hasattr(model, "_biased")
    model.step()
    assert all(model.factors[name].columns == ["id", "vec", "bias"] and model.factors[name].where("bias <> 0").count() > 0 for name in "QC")


def test_blocks_fit_their_memory():
    """More vectors of the other side ask for smaller blocks, never for more than a block's entries."""
    assert blocks.needed(216_000_000, 7_200_000, 8) > 1.5 * blocks.needed(216_000_000, 1_000_000, 8)
    for entries, far, d in ((216_000_000, 7_200_000, 8), (360_000_000, 1_200_000, 8), (10**9, 10**9, 64), (5, 5, 8)):
        one = entries / blocks.needed(entries, far, d)
        assert one * blocks.ENTRY_BYTES + min(one, far) * 2 * (d + 2) * 8 <= blocks.BLOCK_BYTES * 1.01


def test_a_block_takes_vectors_once_more():
    """Half a million vectors of 32 MB and two million entries: 64 MB of vectors and 32 bytes an entry at most beside what came."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(0)
    far, vec = rng.permutation(500_000), rng.normal(size=(500_000, 8))
    parts = [(side, ids, x) for side, ids, x in ((True, np.arange(100), np.zeros((100, 8))), *((False, far[k : k + 50_000], vec[k : k + 50_000]) for k in range(0, 500_000, 50_000)))]
    factors = pa.table({"mine": [p[0] for p in parts], "ids": [p[1].tobytes() for p in parts], "vecs": [p[2].tobytes() for p in parts], "es": [np.zeros(len(p[1])).tobytes() for p in parts]})
    ids = np.repeat(np.arange(100), 20_000)
    entries = pa.Table.from_batches(pa.table({"id": ids, "far": np.tile(np.arange(0, 500_000, 25), 100), "v": np.ones(len(ids))}).to_batches(10_000))
    tracemalloc.start()
    t = blocks.Held(entries, factors, 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20
    assert len(t.row) == len(ids) and np.array_equal(t.far[t.at[:20_000]], vec[np.argsort(far)][::25]) and not t.split.any()


def test_window_pairs_are_dealt_in_arrays(spark, monkeypatch):
    """Strata of a stream's pairs are those of its rows of pairs, with streams whole and cut, batches and chunks of few places; no pair is exploded."""
    stream = spark.range(900).select((F.col("id") % 7).cast("string").alias("u"), F.floor(F.col("id") / 7).alias("pos"), F.concat(F.lit("w"), F.pmod(F.xxhash64("id"), F.lit(30))).alias("token"))
    model = W2V({"d": 4, "window": 3, "min_count": 1, "sample": 0.02}).initialize(stream)
    model.n_blocks, salts = 3, ((0,), (0, 1))
    want = grid.strata(model.window_pairs(), "u", "i", 3, salts)
    assert "Generate" not in model._strata(salts)._jdf.queryExecution().optimizedPlan().toString()
    rows = lambda t: sorted((r.key, r.stage, r.kind, bytes(r.ids), bytes(r.vec)) for r in t.collect())
    want = rows(want)
    monkeypatch.setattr(words, "TOGETHER", 100)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for piece, batch in ((100_000, before), (100_000, 2), (20, 7)):
            monkeypatch.setattr(words, "PIECE", piece)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            assert rows(model._strata(salts)) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_warp_draws_only_for_open_rows(spark, planted, monkeypatch):
    """Where the first draw always violates, no positive draws again; where none does, each draws ``max_trials`` times, in rounds that double."""
    model = WARP({"d": 2, "max_trials": 60, "trials_at_once": 4, "threshold": 1e9}).initialize(planted)
    asked, unseen = [], model._unseen
    monkeypatch.setattr(model, "_unseen", lambda rows, first, n, columns: asked.append((rows.count(), first, n)) or unseen(rows, first, n, columns))
    assert model.violations().where("t = 0").count() == model.n_rows and asked == [(model.n_rows, 0, 1)]
    asked.clear()
    model.opt["threshold"] = -1e9
    assert model.violations().count() == 0
    assert asked == [(model.n_rows, *x) for x in ((0, 1), (1, 3), (4, 8), (12, 16), (28, 32))]


def test_plsi_counts_are_not_copied(spark, planted, monkeypatch):
    """A task's counts are as large as its vectors: they go out where they were summed."""
    import pyarrow as pa

    from millrace.models import plsi

    class Seen(Exception):
        pass

    def each(own, far, d, run, schema):
        raise Seen(run)

    model, held = PLSI({"d": 3}).initialize(planted), []
    monkeypatch.setattr(model.blocks, "each", each)
    with pytest.raises(Seen) as seen:
        model.step()
    run = seen.value.args[0]
    monkeypatch.setattr(plsi.np, "concatenate", lambda x, *a, f=np.concatenate, **b: held.append(sum(len(p) for p in x)) or f(x, *a, **b))

    class Block:
        ids, far_ids, row, at, v = np.arange(2), np.arange(500), np.zeros(500, np.int64), np.arange(500), np.ones(500)
        own, far = np.ones((2, 3)), np.ones((500, 3))

    out = run(Block)
    assert isinstance(out, pa.Table) and out.num_rows == 503 and max(held, default=0) <= 501
    assert np.isclose(sum(out["e"].combine_chunks().flatten().to_numpy()), 1000) and out["side"].to_pylist().count("i") == 500
