"""Risk models: covariances, regimes, and the allocation that they feed.

What is relational (windows, pair sums, shrinkage) stays in DataFrames. Dense algebra runs
in one grouped task for each formation date, on that date's window only: its state is
assets x window, whatever the length of the history.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.sources.sinks import written

HORIZON = 21


# DataFrame operators


#: Assets of a block of the Gram matrix, and days that one task adds up.
BLOCK, DAYS = 256, 2_048


def gram(x: DataFrame, block: int = BLOCK, days: int = DAYS) -> DataFrame:
    """i, j, s, s4, n of complete rows (date, asset, x): sums over dates of x_i x_j and of its square, for all pairs.

    Assets are numbered and dealt into blocks; a day of a block is one vector. Each pair of blocks meets on
    its days, some of them to a task, which adds up outer products day by day and sends one matrix; these are summed by pair
    of blocks. So pairs are shuffled once for each ``days`` of the history, not once a date, and a task holds one
    block x block matrix. ``n`` is the number of dates.
    """
    spark = x.sparkSession
    numbered = x.select("asset").distinct().select("asset", (F.row_number().over(Window.orderBy("asset")) - 1).alias("_no"))  # a row for each asset
    dates = x.select("date").distinct().select("date", F.floor((F.row_number().over(Window.orderBy("date")) - 1) / days).cast("int").alias("part"))  # a row for each date
    placed = x.join(numbered, "asset").join(dates, "date").select("date", "part", (F.col("_no") / block).cast("int").alias("b"), F.struct("_no", "x").alias("e"))
    vectors = placed.groupBy("date", "part", "b").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["x"]).alias("v"))
    blocks = numbered.agg((F.floor(F.max("_no") / block) + 1).cast("int")).scalar()
    # the pairs (a, b) that a block takes part in; a pair of a block with itself has one side
    pairs = vectors.select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("o")).select("date", "part", F.least("b", "o").alias("a"), F.greatest("b", "o").alias("c"), "b", "v")
    ordered = pairs.repartition("a", "c", "part").sortWithinPartitions("a", "c", "part", "date", "b")

    def add(batches):
        now, sums, before = None, None, None

        def matrix():
            (a, c, part), (s, s4, n) = now, sums
            return pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([c], pa.int32()), pa.array([len(s)], pa.int32()), pa.array([n], pa.int64()), pa.array([s.ravel()], pa.list_(pa.float64())), pa.array([s4.ravel()], pa.list_(pa.float64()))], names=["a", "c", "rows", "n", "s", "s4"])

        for batch in batches:
            column = batch.column("v")
            flat, at = column.values.to_numpy(), column.offsets.to_numpy()
            for k, (date, part, a, c, b) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("date", "part", "a", "c", "b")))):
                v = flat[at[k] : at[k + 1]].copy()
                if a != c and b == a:
                    before = (date, v)
                    continue
                left = v if a == c else before[1]
                if now != (a, c, part):
                    if sums:
                        yield matrix()
                    now, sums = (a, c, part), [np.zeros((len(left), len(v))), np.zeros((len(left), len(v))), 0]
                outer = np.outer(left, v)
                sums[0] += outer
                sums[1] += outer * outer
                sums[2] += 1
        if sums:
            yield matrix()

    schema = "a int, c int, rows int, n long, s array<double>, s4 array<double>"

    def total(batches):
        now, sums = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                a, c, rows, n = (batch.column(x)[k].as_py() for x in ("a", "c", "rows", "n"))
                s, s4 = (batch.column(x)[k].values.to_numpy() for x in ("s", "s4"))
                if now != (a, c):
                    if sums:
                        yield from cells(now, sums)
                    now, sums = (a, c), [rows, 0, np.zeros(len(s)), np.zeros(len(s))]
                sums[1] += n
                sums[2] += s
                sums[3] += s4
        if sums:
            yield from cells(now, sums)

    def cells(pair, sums):
        (a, c), (rows, n, s, s4) = pair, sums
        wide = len(s) // rows
        i, j = np.divmod(np.arange(len(s), dtype=np.int64), wide)
        sides = [(i + a * block, j + c * block)] + ([] if a == c else [(j + c * block, i + a * block)])
        for left, right in sides:
            yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(s), pa.array(s4), pa.array(np.full(len(s), n))], names=["i", "j", "s", "s4", "n"])

    parts = ordered.mapInArrow(add, schema).repartition("a", "c").sortWithinPartitions("a", "c")
    sums = parts.mapInArrow(total, "i long, j long, s double, s4 double, n long")
    names = [numbered.select(F.col("_no").cast("long").alias(k), F.col("asset").alias(f"asset_{k}")) for k in ("i", "j")]
    return sums.join(names[0], "i").join(names[1], "j").select(F.col("asset_i").alias("i"), F.col("asset_j").alias("j"), "s", "s4", "n")


def ledoit_wolf(returns: DataFrame, block: int = BLOCK, days: int = DAYS) -> DataFrame:
    """i, j, cov, shrinkage: shrunk covariance of complete returns (date, asset, ret), from block Gram matrices. (O-126)

    S = population covariance, mu = tr(S) / p, d2 = |S - mu I|^2 / p, and b2 the mean
    squared distance of the rows' outer products from S; the shrinkage is min(b2, d2) / d2.
    Pairs of assets are the result's own size.
    """
    assets = returns.agg(F.count_distinct("asset")).scalar()
    dates = returns.groupBy("date").agg(F.count("ret").alias("k")).filter(F.col("k") == assets).select("date")
    rows = returns.join(dates, "date").select("date", "asset", "ret")
    x = rows.select("date", "asset", (F.col("ret") - F.avg("ret").over(Window.partitionBy("asset"))).alias("x"))
    s = written(gram(x, block, days).select("i", "j", (F.col("s") / F.col("n")).alias("s"), (F.col("s4") / F.col("n")).alias("s4"), "n"))
    own = F.col("i") == F.col("j")
    mu = s.filter(own).agg(F.avg("s")).scalar()
    eye = F.when(own, mu).otherwise(0.0)
    d2 = F.sum(F.pow(F.col("s") - eye, F.lit(2.0)))
    b2 = F.sum((F.col("s4") - F.col("s") * F.col("s")) / F.col("n"))
    shrink = s.agg(F.when(d2 > 0, F.least(b2, d2) / d2).otherwise(0.0)).scalar()
    told = s.select("i", "j", "s", eye.alias("eye"), shrink.alias("shrinkage"))
    return told.select("i", "j", ((1 - F.col("shrinkage")) * F.col("s") + F.col("shrinkage") * F.col("eye")).alias("cov"), "shrinkage")


def weighted_covariance(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """i, j, cov, n_effective with reliability weights (date, w): unbiased, W - sum(w^2) / W below. (O-127)"""
    r = returns.join(weights, "date").filter("ret IS NOT NULL")
    mean = r.groupBy("asset").agg((F.sum(F.col("w") * F.col("ret")) / F.sum("w")).alias("m"))
    x = r.join(mean, "asset").select("date", "asset", "w", (F.col("ret") - F.col("m")).alias("x"))
    pairs = x.select("date", "w", F.col("asset").alias("i"), F.col("x").alias("a")).join(x.select("date", F.col("asset").alias("j"), F.col("x").alias("b")), "date").filter("i <= j")
    total = F.sum("w")
    squares = F.sum(F.col("w") * F.col("w"))
    return pairs.groupBy("i", "j").agg((F.sum(F.col("w") * F.col("a") * F.col("b")) / (total - squares / total)).alias("cov"), (total * total / squares).alias("n_effective"))


def forecast_stress(p: Column, stay_calm: Column, stay_stress: Column, horizon: int = HORIZON) -> Column:
    """Mean probability of stress over the next ``horizon`` steps of a two-state chain. (O-130)"""
    step = lambda acc, _: F.struct((acc["p"] * stay_stress + (1 - acc["p"]) * (1 - stay_calm)).alias("p"), (acc["s"] + acc["p"] * stay_stress + (1 - acc["p"]) * (1 - stay_calm)).alias("s"))
    start = F.struct(p.cast("double").alias("p"), F.lit(0.0).alias("s"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step, lambda acc: acc["s"] / horizon)


def filtered_stress(market: DataFrame, calm: Column, stress: Column, stay_calm: float, stay_stress: float) -> DataFrame:
    """date, stress: the probability of stress given the market up to and with each date, by a two-state chain. (O-129)

    Returns (date, market) are normal around 0 with spread ``calm`` or ``stress``; the chain starts even. A filter is a
    chain of steps, so it folds over the series in order: one row for each date, in one array.
    """
    series = market.filter("market IS NOT NULL").agg(F.array_sort(F.collect_list(F.struct("date", "market"))).alias("series"))
    rows = series.select("series", calm.cast("double").alias("calm"), stress.cast("double").alias("hot"))
    like = lambda x, s: F.exp(-x * x / (2 * s * s)) / s

    def step(acc, day):
        ahead = acc["p"] * stay_stress + (1 - acc["p"]) * (1 - stay_calm)
        hot, cold = ahead * like(day["market"], F.col("hot")), (1 - ahead) * like(day["market"], F.col("calm"))
        p = hot / (hot + cold)
        return F.struct(p.alias("p"), F.concat(acc["out"], F.array(F.struct(day["date"].alias("date"), p.alias("stress")))).alias("out"))

    start = F.struct(F.lit(0.5).alias("p"), F.array().cast("array<struct<date: date, stress: double>>").alias("out"))
    return rows.select(F.explode(F.aggregate("series", start, step, lambda acc: acc["out"])).alias("x")).select("x.date", "x.stress")


def regime_variance(returns: DataFrame, filtered: DataFrame, ahead: DataFrame, n: int) -> DataFrame:
    """date, asset, regime_variance: of the n rows before, each state's variance by its filtered weights, mixed by the chance of the states ahead. (O-131)

    ``filtered``: date, stress (both one row for each date); ``ahead``: date, stress_probability, as known before the date.
    """
    w = Window.partitionBy("asset").orderBy("date").rowsBetween(-n, -1)
    r, p = F.col("ret"), F.col("stress")
    rows = returns.join(F.broadcast(filtered), "date", "left").join(F.broadcast(ahead), "date", "left")

    def own(weight):
        total = F.sum(F.when(r.isNotNull(), weight)).over(w)
        mean = F.sum(weight * r).over(w) / total
        return F.greatest(F.sum(weight * r * r).over(w) / total - mean * mean, F.lit(0.0))

    full = F.count(F.when(r.isNotNull(), p)).over(w) == n
    mixed = F.col("stress_probability") * own(p) + (1 - F.col("stress_probability")) * own(1 - p)
    return rows.select("date", "asset", F.when(full, mixed).alias("regime_variance"))


def capped_weights(raw: Column, cap: float, steps: int = 60) -> Column:
    """The projection of an array of weights on the simplex with entries of ``cap`` at most. (O-136)

    Bisection for the shift t with sum(clip(raw - t, 0, cap)) = 1; null where cap * n < 1.
    """
    total = lambda t: F.aggregate(F.transform(raw, lambda x: F.least(F.greatest(x - t, F.lit(0.0)), F.lit(cap))), F.lit(0.0), lambda a, x: a + x)
    start = F.struct((F.array_min(raw) - 1.0).alias("lo"), F.array_max(raw).alias("hi"))

    def halve(acc, _):
        mid = (acc["lo"] + acc["hi"]) / 2
        over = total(mid) > 1
        return F.struct(F.when(over, mid).otherwise(acc["lo"]).alias("lo"), F.when(over, acc["hi"]).otherwise(mid).alias("hi"))

    shift = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda acc: (acc["lo"] + acc["hi"]) / 2)
    return F.when(F.size(raw) * cap >= 1 - 1e-12, F.transform(raw, lambda x: F.least(F.greatest(x - shift, F.lit(0.0)), F.lit(cap))))


# Dense algebra of one formation date


def psd_floor(cov: np.ndarray) -> np.ndarray:
    """Eigenvalues raised to 1e-8 of the median variance at least. (O-132)"""
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    floor = 1e-8 * max(float(np.median(np.diag(cov))), 1e-12)
    return (vectors * np.maximum(values, floor)) @ vectors.T


def project(w: np.ndarray, cap: float) -> np.ndarray:
    """The nearest point of the capped simplex, by the sorted break points of the shift."""
    if cap * len(w) < 1 - 1e-12:
        raise ValueError("the cap leaves no feasible weights")  # O-137
    points = np.sort(np.concatenate([w, w - cap]))
    sums = np.clip(w[None, :] - points[:, None], 0, cap).sum(1)
    k = int(np.searchsorted(-sums, -1.0, side="right")) - 1
    if k + 1 >= len(points) or sums[k] == 1:
        return np.clip(w - points[k], 0, cap)
    t = points[k] + (sums[k] - 1) / (sums[k] - sums[k + 1]) * (points[k + 1] - points[k])
    return np.clip(w - t, 0, cap)


def minimum_variance(cov: np.ndarray, cap: float, tolerance: float = 1e-10, rounds: int = 20_000) -> np.ndarray:
    """Long-only minimum-variance weights with a cap: accelerated projected gradient. (O-135)

    The problem is strictly convex, so its one optimum is found from any start; the
    iteration ends when a projected step moves nothing.
    """
    c = cov / max(float(np.median(np.diag(cov))), 1e-300)
    step = 1 / max(float(np.linalg.eigvalsh(c)[-1]), 1e-300)
    w = np.full(len(c), 1 / len(c))
    w = project(w, cap)
    y, momentum = w, 1.0
    for _ in range(rounds):
        new = project(y - step * (c @ y), cap)
        if np.abs(new - project(new - step * (c @ new), cap)).max() < tolerance:
            return new
        following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        y = new + (momentum - 1) / following * (new - w)
        if (y - new) @ (c @ new) > 0:  # uphill: begin anew
            y, following = new, 1.0
        w, momentum = new, following
    raise ArithmeticError("minimum variance did not converge")  # O-137


def _log_gauss(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    low = np.linalg.cholesky(cov)
    z = np.linalg.solve(low, (x - mean).T)
    return -0.5 * (z * z).sum(0) - np.log(np.diag(low)).sum() - 0.5 * len(mean) * np.log(2 * np.pi)


def fit_regimes(x: np.ndarray, states: int = 2, restarts: int = 5, rounds: int = 500, tolerance: float = 1e-4, ridge: float = 1e-6, seed: int = 5):
    """(log-likelihood, responsibilities, transition matrix) of a Gaussian hidden Markov model. (O-128)

    Baum-Welch on standardised rows, from seeded restarts; the best converged one counts.
    """
    sd = x.std(0)
    z = (x - x.mean(0)) / np.where(sd > 0, sd, 1)
    n, d = z.shape
    best = None
    for k in range(restarts):
        rng = np.random.default_rng(seed + k)
        # spread starting centres: each next one likely far from those before
        centres = [z[rng.integers(n)]]
        while len(centres) < states:
            far = np.min([((z - c) ** 2).sum(1) for c in centres], axis=0)
            centres.append(z[rng.choice(n, p=far / far.sum())] if far.sum() > 0 else z[rng.integers(n)])
        mean = np.array(centres)
        cov = np.stack([np.cov(z.T).reshape(d, d) + ridge * np.eye(d)] * states)
        start, move = np.full(states, 1 / states), np.full((states, states), 0.1 / max(states - 1, 1)) + (0.9 - 0.1 / max(states - 1, 1)) * np.eye(states)
        last, converged = -np.inf, False
        for _ in range(rounds):
            seen = np.stack([_log_gauss(z, m, c) for m, c in zip(mean, cov)], 1)
            peak = seen.max(1, keepdims=True)
            like = np.exp(seen - peak)
            ahead, scale = np.empty((n, states)), np.empty(n)
            for t in range(n):
                ahead[t] = (start if not t else ahead[t - 1] @ move) * like[t]
                scale[t] = ahead[t].sum()
                ahead[t] /= scale[t]
            back = np.ones((n, states))
            for t in range(n - 2, -1, -1):
                back[t] = move @ (like[t + 1] * back[t + 1]) / scale[t + 1]
            total = float(np.log(scale).sum() + peak.sum())
            post = ahead * back
            post /= post.sum(1, keepdims=True)
            if abs(total - last) < tolerance:
                converged = True
                break
            last = total
            pairs = np.einsum("ti,ij,tj->ij", ahead[:-1], move, like[1:] * back[1:] / scale[1:, None])
            pairs *= 1.0
            start = post[0]
            move = pairs / pairs.sum(1, keepdims=True)
            weight = post.sum(0)
            mean = (post.T @ z) / weight[:, None]
            cov = np.stack([((post[:, s, None] * (z - mean[s])).T @ (z - mean[s])) / weight[s] + ridge * np.eye(d) for s in range(states)])
        if converged and (best is None or total > best[0]):
            best = (total, post, move)
    if best is None:
        raise ArithmeticError("no restart converged")
    return best


def stress_state(post: np.ndarray, volatility: np.ndarray) -> int:
    """The state with the higher responsibility-weighted volatility. (O-129)"""
    return int(np.argmax(post.T @ volatility / post.sum(0)))


def shrunk(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Ledoit-Wolf covariance of rows, and its shrinkage. (O-126)"""
    n, p = x.shape
    c = x - x.mean(0)
    s = c.T @ c / n
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum()
    b2 = min(float(((c**2).T @ (c**2) / n - s**2).sum() / n), d2)
    k = b2 / d2 if d2 > 0 else 0.0
    return (1 - k) * s + k * mu * np.eye(p), k


def pooled_covariance(x: np.ndarray, post: np.ndarray, chance: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Sum over states of chance x (a x own covariance + (1 - a) x shrunk); a grows with the state's evidence. (O-131)"""
    base, _ = shrunk(x)
    out = np.zeros_like(base)
    for s, p in enumerate(chance):
        w = post[:, s]
        total, squares = w.sum(), (w * w).sum()
        if total <= 0 or total - squares / total <= 1e-12:
            out += p * base
            continue
        c = x - (w @ x) / total
        own = (c * w[:, None]).T @ c / (total - squares / total)
        effective = total * total / squares
        a = effective / (effective + x.shape[1] * strength)
        out += p * (a * own + (1 - a) * base)
    return psd_floor(out)


WEIGHTS = "date date, asset int, strategy string, weight double, shrinkage double, condition double, stress double"


def allocate(panel: DataFrame, cap: float, with_regimes: bool = True) -> DataFrame:
    """Weights of each formation date from its own window of returns and market features. (O-125 to O-137)

    ``panel``: date (formation), at (a day of its window), asset, ret, market, volatility,
    penalty; complete days only. Dates are independent tasks.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.pivot(index="at", columns="asset", values="ret").sort_index().sort_index(axis=1)
        market = pdf.drop_duplicates("at").set_index("at").sort_index()
        r = x.to_numpy()
        base, k = shrunk(r)
        covs, stress = {"minimum": base}, None
        if with_regimes:
            features = market[["market", "volatility"]].to_numpy()
            _, post, move = fit_regimes(features)  # a failed fit ends the run: there is no silent change of the experiment
            hot = stress_state(post, features[:, 1])
            p, mean = post[-1], np.zeros(post.shape[1])
            for _ in range(HORIZON):
                p = p @ move
                mean += p / HORIZON
            stress = float(mean[hot])
            covs["regime"] = pooled_covariance(r, post, mean / mean.sum())
        penalty = pdf.drop_duplicates("asset").set_index("asset")["penalty"].reindex(x.columns).fillna(0.0).to_numpy()
        covs["penalised"] = base + np.median(np.diag(base)) * np.diag(penalty)
        out = []
        for name, cov in covs.items():
            w = minimum_variance(psd_floor(cov), cap)
            out.append(pd.DataFrame({"date": pdf["date"].iloc[0], "asset": x.columns.astype("int32"), "strategy": name, "weight": w, "shrinkage": k, "condition": float(np.linalg.cond(cov)), "stress": stress}))
        return pd.concat(out).astype({"stress": "float64"})

    return panel.groupBy("date").applyInPandas(one, WEIGHTS)
