"""Logistic fits with a Gaussian prior and linear inequality constraints.

Gradient and curvature are summed on the executors, one small row set per
iteration; the Newton step with its constraints is solved on the driver over
the few coefficients.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Fit:
    names: list[str]
    coefficients: np.ndarray
    iterations: int
    residual: float
    slack: float

    def as_dict(self) -> dict[str, float]:
        return dict(zip(self.names, self.coefficients.tolist(), strict=True))


def derivatives(rows: DataFrame, features: list[str], label: str, weight: str | None, offset: str | None, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted log-loss, its gradient and its Hessian at theta (intercept first)."""
    k = len(features) + 1
    names = [*features, label, *([weight] if weight else []), *([offset] if offset else [])]

    def sums(batches):
        total = np.zeros(1 + k + k * k)
        for b in batches:
            columns = [b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(b.num_columns)]
            x = np.column_stack([np.ones(b.num_rows), *columns[: k - 1]])
            y = columns[k - 1]
            w = columns[k] if weight else np.ones(len(y))
            z = x @ theta + (columns[-1] if offset else 0.0)
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            total[0] += float(w @ (np.logaddexp(0, z) - y * z))
            total[1 : 1 + k] += x.T @ (w * (p - y))
            total[1 + k :] += ((x * (w * p * (1 - p))[:, None]).T @ x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["i", "v"])

    summed = rows.select(*[F.col(c).cast("double") for c in names]).na.drop().mapInArrow(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(1 + k + k * k)
    for r in summed:
        out[r["i"]] = r["v"]
    return out[0], out[1 : 1 + k], out[1 + k :].reshape(k, k)


def constrained_step(h: np.ndarray, g: np.ndarray, a: np.ndarray, b: np.ndarray, rounds: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """The d that minimises d'hd/2 + g'd with a d >= b, and the multipliers (Hildreth's method)."""
    inverse = np.linalg.inv(h)
    lam = np.zeros(len(b))
    if len(b):
        m = a @ inverse @ a.T
        c = b + a @ inverse @ g
        for _ in range(rounds):
            before = lam.copy()
            for i in range(len(b)):
                if m[i, i] > 1e-14:
                    lam[i] = max(0.0, lam[i] + (c[i] - m[i] @ lam) / m[i, i])
            if np.abs(lam - before).max(initial=0) < 1e-12:
                break
    return inverse @ (a.T @ lam - g if len(b) else -g), lam


def fit_logistic(
    rows: DataFrame,
    features: list[str],
    label: str = "y",
    weight: str | None = None,
    offset: str | None = None,
    prior_mean: np.ndarray | None = None,
    prior_precision: np.ndarray | float = 1.0,
    constraints: np.ndarray | None = None,
    tolerance: float = 1e-8,
    most: int = 50,
    bounds: np.ndarray | None = None,
    intercept: bool = True,
) -> Fit:
    """MAP coefficients (intercept free, first; held at 0 without one) with constraints @ coefficients >= bounds, 0 if none are given."""
    k = len(features) + 1
    mean = np.zeros(k) if prior_mean is None else np.asarray(prior_mean, float)
    precision = np.broadcast_to(np.asarray(prior_precision, float), (k,)).copy()
    precision[0] = 1e-10 if intercept else 1e12
    a = np.zeros((0, k)) if constraints is None else np.asarray(constraints, float)
    least = np.zeros(len(a)) if bounds is None else np.asarray(bounds, float)
    theta = mean.copy()
    if len(a) and (a @ theta < least).any():
        theta = theta + constrained_step(np.eye(k), np.zeros(k), a, least - a @ theta)[0]

    def at(t: np.ndarray):
        loss, g, h = derivatives(rows, features, label, weight, offset, t)
        return loss + 0.5 * precision @ (t - mean) ** 2, g + precision * (t - mean), h + np.diag(precision)

    value, g, h = at(theta)
    lam = np.zeros(len(a))
    done = 0
    for done in range(1, most + 1):
        step, lam = constrained_step(h, g, a, least - a @ theta)
        size = 1.0
        while True:
            trial = theta + size * step
            new, g2, h2 = at(trial)
            if new <= value + 1e-12 or size < 1e-6:
                break
            size /= 2
        moved = np.abs(trial - theta).max()
        theta, value, g, h = trial, new, g2, h2
        if moved < tolerance:
            break
    residual = float(np.abs(g - (a.T @ lam if len(a) else 0)).max())
    return Fit(["intercept", *features], theta, done, residual, float((a @ theta - least).min(initial=0.0)))


#: Design terms that need an axis to be observed.
NEEDS = {"x2_whole": "x2_whole", "x2_figure": "x2_whole", "x4": "x4"}


def block_terms(pattern: str) -> list[str]:
    """A pattern's terms, intercept first: those of names, and those of the axes that it has observed."""
    from emberloom.operators import risk

    axes = pattern.split("+")
    return ["intercept", *[t for t in risk.TERMS if t not in NEEDS or NEEDS[t] in axes]]


def vertex(x1: float, x2: float, x3: float, distinct: bool, figure: bool, image: float, goods: float) -> dict[str, float]:
    """Design terms of a corner of the unit box."""
    plain = 0.0 if distinct else 1.0
    return {
        "intercept": 1.0, "x1_d": x1, "x2_text_d": x2, "x3_d": x3, "any_no_distinctive": plain, "x1_text": 0.0 if figure else x1, "x1_no_distinctive": x1 * plain,
        "x2_whole": image, "x2_figure": image if figure else 0.0, "x4": goods,
    }


def coupling_matrix(patterns: list[str], image_floor: float, goods_floor: float) -> tuple[list[str], np.ndarray]:
    """(names, G): rows whose product with the stacked coefficients is the change of the logit when one more axis is
    observed at its floor, or at the same value where both blocks have the other axis at an end."""
    names = [f"{p}:{t}" for p in patterns for t in block_terms(p)]
    place = {n: k for k, n in enumerate(names)}
    rows = []
    steps = [("base", "x2_whole", (0, 0), (image_floor, 0)), ("base", "x4", (0, 0), (0, goods_floor))]
    for v in (0.0, 1.0):
        steps += [("x2_whole", "x2_whole+x4", (v, 0), (v, goods_floor)), ("x4", "x2_whole+x4", (0, v), (image_floor, v))]
    for low, high, before, after in steps:
        if low not in patterns or high not in patterns:
            continue
        for corner in range(32):
            own = [float(corner >> k & 1) for k in range(3)] + [bool(corner >> 3 & 1), bool(corner >> 4 & 1)]
            row = np.zeros(len(names))
            for pattern, ends, sign in ((high, after, 1.0), (low, before, -1.0)):
                terms = vertex(*own, *ends)
                for t in block_terms(pattern):
                    row[place[f"{pattern}:{t}"]] += sign * terms[t]
            rows.append(row)
    return names, np.array(rows).reshape(-1, len(names))


def joint_fit(rows: DataFrame, patterns: list[str], image_floor: float, goods_floor: float, label: str = "y", weight: str | None = None, precision: float = 1.0, fixed: dict[str, dict[str, float]] | None = None) -> dict[str, dict[str, float]]:
    """Blocks of coefficients for all patterns at once, under the coupling constraints.

    rows are risk inputs with a label. A block learns from every row that has
    observed its axes, so fully observed rows train all blocks. fixed blocks
    keep their coefficients: they take part in the constraints only.
    """
    from emberloom.operators import risk

    names, g = coupling_matrix(patterns, image_floor, goods_floor)
    fixed = fixed or {}
    held = np.array([fixed.get(n.split(":")[0], {}).get(n.split(":")[1], 0.0) for n in names])
    free = [k for k, n in enumerate(names) if n.split(":")[0] not in fixed]
    own = risk.design(rows)
    parts = []
    for p in patterns:
        if p in fixed:
            continue
        seen = F.lit(True)
        for axis in [a for a in p.split("+") if a != "base"]:
            seen = seen & risk.observed(axis)
        parts.append(F.when(seen, F.lit(p)))
    long = own.withColumn("_p", F.explode(F.array_compact(F.array(*parts))))
    columns = []
    for k in free:
        p, t = names[k].split(":")
        columns.append(F.when(F.col("_p") == p, F.lit(1.0) if t == "intercept" else F.col(f"t_{t}")).otherwise(0.0).alias(f"f{k}"))
    # the constraints' share of the fixed blocks is a constant
    fitted = fit_logistic(
        long.select(*columns, label, *([weight] if weight else [])), [f"f{k}" for k in free], label, weight, prior_precision=precision, constraints=np.column_stack([np.zeros(len(g)), g[:, free]]), bounds=-(g @ held),
        intercept=False,
    )
    value = held.copy()
    value[free] = fitted.coefficients[1:]
    return {p: {t: float(value[names.index(f"{p}:{t}")]) for t in block_terms(p)} for p in patterns}


def model_card(blocks: dict[str, dict[str, float]], cuts: dict[str, list[float | None]], meta: dict) -> str:
    """A fitted model as JSON, coefficients and cuts to four digits, meta as it is."""
    import json

    rounded = {p: {t: round(v, 4) for t, v in b.items()} for p, b in blocks.items()}
    return json.dumps({"patterns": rounded, "thresholds": {p: [None if c is None else round(c, 4) for c in own] for p, own in cuts.items()}, "meta": meta}, ensure_ascii=False, sort_keys=True)


def read_card(text: str, image_floor: float, goods_floor: float, tolerance: float = 1e-3) -> dict:
    """The model of a card; missing terms, cuts that don't increase and coefficients that break the coupling are refused."""
    import json

    card = json.loads(text)
    for p, block in card["patterns"].items():
        if p.removeprefix("noname:") == p and sorted(block) != sorted(block_terms(p)):
            raise ValueError(f"block {p} has other terms")
    for p, own in card["thresholds"].items():
        known = [c for c in own if c is not None]
        if known != sorted(set(known)):
            raise ValueError(f"cuts of {p} don't increase")
    names, g = coupling_matrix([p for p in card["patterns"] if not p.startswith("noname:")], image_floor, goods_floor)
    value = np.array([card["patterns"][n.split(":")[0]][n.split(":")[1]] for n in names])
    if len(g) and (g @ value).min() < -tolerance:
        raise ValueError("observing one more axis at its floor lowers the logit")
    return card
