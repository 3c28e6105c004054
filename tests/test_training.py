"""Epoch training against plain gradients, a plain solver run, and itself when cut short."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from encoscope.operators import heads, training
from encoscope.operators.training import Net, Solver


@pytest.mark.parametrize("name", ["linear", "mlp"])
def test_gradients(name):
    rng = np.random.default_rng(2)
    net = Net.fresh(name, 5, 3, 7)
    net.theta = rng.normal(size=len(net.theta))
    x, y = rng.normal(size=(40, 5)), rng.integers(0, 3, 40)
    loss, slope = net.gradient(x, y)
    for k in range(0, len(slope), 3):
        moved = np.zeros(len(slope))
        moved[k] = 1e-6
        up, down = (Net(net.sizes, net.bias, net.theta + m).gradient(x, y)[0] for m in (moved, -moved))
        assert slope[k] == pytest.approx((up - down) / 2e-6, abs=1e-4)


def test_solver_reaches_the_least_loss():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(30, 30))
    a, b = a @ a.T + np.eye(30), rng.normal(size=30)
    solver = Solver(np.zeros(30))
    for _ in range(150):
        x = solver.proposal()
        solver.tell(float(x @ a @ x / 2 - b @ x), a @ x - b, 0.01)
    assert np.allclose(solver.point, np.linalg.solve(a, b), atol=1e-5)


def two_parts(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    x = rng.normal(size=(n, 4)) + np.eye(3, 4)[y] * 2
    rows = [([float(v) for v in f], int(c), bool(k % 4 == 0)) for k, (f, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "features array<double>, label_id int, dev boolean").repartition(5), x, y


@pytest.mark.parametrize("name", ["linear", "mlp"])
def test_an_epoch_is_one_pass(spark, monkeypatch, name):
    rows, x, y = two_parts(spark)
    dev = np.arange(len(x)) % 4 == 0
    calls = []
    whole = training.one_pass
    monkeypatch.setattr(training, "one_pass", lambda *given: calls.append(1) or whole(*given))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def counted(flag):
        seen.add(1)
        return flag

    net, log = training.train_net(rows.withColumn("dev", counted("dev")), Net.fresh(name, 4, 3, 5), epochs=6, patience=9)
    assert len(calls) == 7 and seen.value == 7 * len(x) and [e for e, *_ in log] == [1, 2, 3, 4, 5, 6]

    # the same epochs in one process
    solver, plain = Solver(Net.fresh(name, 4, 3, 5).theta), []
    for _ in range(7):
        here = Net(net.sizes, net.bias, solver.proposal())
        loss, slope = here.gradient(x[~dev], y[~dev])
        solver.tell(loss / (~dev).sum(), slope / (~dev).sum(), 2 * (~dev).sum() / (x[~dev] ** 2).sum())
        plain.append(training.softmax_loss(here.outputs(x[dev])[-1], y[dev])[0].mean())
    assert [loss for _, loss, _ in log] == pytest.approx(plain[1:], rel=1e-9)
    assert min(plain) < 0.9 * plain[0]


@pytest.mark.parametrize("name", ["linear", "mlp"])
def test_a_training_cut_short_goes_on(spark, tmp_path, name):
    rows, *_ = two_parts(spark)
    fresh = Net.fresh(name, 4, 3, 5)
    whole, log = training.train_net(rows, fresh, epochs=8, patience=20)
    path = f"{tmp_path}/state"
    training.train_net(rows, fresh, epochs=3, patience=20, path=path)
    resumed, again = training.train_net(rows, fresh, epochs=8, patience=20, path=path)
    assert [e for e, *_ in again] == [e for e, *_ in log]
    assert [loss for _, loss, _ in again] == pytest.approx([loss for _, loss, _ in log], rel=1e-6)
    assert np.allclose(resumed.theta, whole.theta, atol=1e-4)
    assert training.train_net(rows, fresh, epochs=8, patience=20, path=path)[1] == again


def test_nets_are_saved_with_their_logits(spark, tmp_path):
    rows, x, _ = two_parts(spark, 30)
    net = Net.fresh("mlp", 4, 3, 1)
    heads.save_head(net, f"{tmp_path}/head")
    back = heads.load_head("mlp", f"{tmp_path}/head")
    assert back.sizes == net.sizes and (back.theta == net.theta).all()
    odd = rows.select("features").unionByName(spark.createDataFrame([(None,)], "features array<double>"))
    got = {None if r[0] is None else tuple(r[0]): r[1] for r in training.with_logits(odd, back).collect()}
    assert got[None] is None
    for row, want in zip(x, net.outputs(x)[-1]):
        assert got[tuple(row)] == pytest.approx(want.tolist())


def test_odd_rows_are_errors(spark):
    rows, *_ = two_parts(spark, 20)
    net = Net.fresh("linear", 4, 3, 1)
    with pytest.raises(ValueError, match="both parts"):
        training.train_net(rows.where("not dev"), net)
    with pytest.raises(Exception, match="one length"):
        training.train_net(rows.withColumn("features", F.expr("slice(features, 1, 3)")), net)
    with pytest.raises(ValueError, match="unknown classifier"):
        Net.fresh("tree", 4, 3, 1)
