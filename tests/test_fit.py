import numpy as np
import pytest

from emberloom.operators import fit


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    p = 1 / (1 + np.exp(-(0.5 + x @ np.array([1.5, -0.8, 0.3]))))
    y = (rng.random(400) < p).astype(int)
    w = rng.random(400) + 0.5
    data = [(*map(float, r), int(a), float(b)) for r, a, b in zip(x, y, w)] + [(None, 0.0, 0.0, 1, 1.0)]
    return spark.createDataFrame(data, "a double, b double, c double, y int, w double").repartition(3), x, y, w


def gradient(t, x, y, w):
    z = np.column_stack([np.ones(len(x)), x]) @ t
    return np.column_stack([np.ones(len(x)), x]).T @ (w * (1 / (1 + np.exp(-z)) - y)) + np.array([0, *t[1:]])


def test_free_fit_is_stationary(rows):
    df, x, y, w = rows
    found = fit.fit_logistic(df, ["a", "b", "c"], weight="w")
    assert np.abs(gradient(found.coefficients, x, y, w)).max() < 1e-5 and found.as_dict()["a"] > 1 and found.as_dict()["b"] < 0


def test_constraints_hold_and_kkt(rows):
    df, x, y, w = rows
    g = np.array([[0, 0, 1, 0], [0, 0, 0, 1], [0, -1, 0, 4]], float)  # b >= 0, c >= 0, 4 c >= a
    found = fit.fit_logistic(df, ["a", "b", "c"], weight="w", constraints=g)
    slack = g @ found.coefficients
    assert slack.min() >= -1e-6 and found.residual <= 1e-4 and abs(found.coefficients[2]) < 1e-6
    # the gradient is a non-negative mix of the active constraints
    active = g[slack < 1e-6]
    lam, *_ = np.linalg.lstsq(active.T, gradient(found.coefficients, x, y, w), rcond=None)
    assert (lam >= -1e-4).all() and np.abs(active.T @ lam - gradient(found.coefficients, x, y, w)).max() < 1e-3


def joint_rows(spark, n=600):
    rng = np.random.default_rng(7)
    rows = []
    for _ in range(n):
        x1, x2, x3 = rng.random(3).tolist()
        image, goods = (float(rng.random()) if rng.random() < 0.7 else None), (float(rng.random()) if rng.random() < 0.6 else None)
        z = -3 + 3 * x1 + 1.5 * x2 + 1.2 * (image or 0) + 1.0 * (goods or 0)
        rows.append((x1, x2, x3, True, image, goods, True, bool(rng.random() < 0.8), str(rng.choice(["text", "figure"])), int(rng.random() < 1 / (1 + np.exp(-z)))))
    return spark.createDataFrame(rows, "x1_d double, x2_text_d double, x3_d double, has_meaning_both boolean, x2_whole double, x4 double, has_distinctive_a boolean, has_distinctive_b boolean, mark_type string, y int")


def test_joint_fit_keeps_the_coupling_and_fixed_blocks(spark):
    from emberloom.operators import fit, risk

    patterns = ["base", "x2_whole", "x4", "x2_whole+x4"]
    rows = joint_rows(spark).cache()
    blocks = fit.joint_fit(rows, patterns, risk.IMAGE_FLOOR, risk.GOODS_FLOOR)
    names, g = fit.coupling_matrix(patterns, risk.IMAGE_FLOOR, risk.GOODS_FLOOR)
    value = np.array([blocks[n.split(":")[0]][n.split(":")[1]] for n in names])
    assert len(g) == 32 * 6 and (g @ value).min() > -1e-6 and blocks["base"]["x1_d"] + blocks["base"]["x1_text"] > 1
    again = fit.joint_fit(rows, patterns, risk.IMAGE_FLOOR, risk.GOODS_FLOOR, fixed={"base": blocks["base"]})
    assert again["base"] == blocks["base"] and np.allclose([again["x4"][t] for t in again["x4"]], [blocks["x4"][t] for t in blocks["x4"]], atol=2e-2)
    card = fit.model_card(blocks, {"named": [0.1, 0.2, 0.6]}, {"rows": 600})
    assert fit.read_card(card, risk.IMAGE_FLOOR, risk.GOODS_FLOOR)["meta"] == {"rows": 600}
    broken = {p: dict(b) for p, b in blocks.items()}
    broken["x4"]["intercept"] -= 5
    with pytest.raises(ValueError, match="lowers"):
        fit.read_card(fit.model_card(broken, {}, {}), risk.IMAGE_FLOOR, risk.GOODS_FLOOR)
    with pytest.raises(ValueError, match="increase"):
        fit.read_card(fit.model_card(blocks, {"named": [0.5, 0.2, 0.6]}, {}), risk.IMAGE_FLOOR, risk.GOODS_FLOOR)


def test_the_shipped_blocks_pass_their_card(spark):
    from emberloom.operators import fit, risk

    blocks = {p: dict(zip(["intercept", *risk.TERMS], [c, *w])) for p, (c, w) in risk.BLOCKS.items() if not p.startswith("noname:")}
    blocks = {p: {t: b[t] for t in fit.block_terms(p)} for p, b in blocks.items()}
    assert fit.read_card(fit.model_card(blocks, {"named": list(risk.CUTS["named"])}, {}), risk.IMAGE_FLOOR, risk.GOODS_FLOOR)
