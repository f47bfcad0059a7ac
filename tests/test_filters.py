import math

import numpy as np
import pandas as pd
import pytest

from quern.functions import linalg as la
from quern.operators import filters as fl
from quern.streaming import filters as sf


def plant(a, b, steps, noise, seed=42, start=None, h=None):
    g = np.random.default_rng(seed)
    h = np.eye(len(a)) if h is None else h
    x, true, seen, inputs = np.zeros(len(a)) if start is None else np.array(start, float), [], [], []
    for _ in range(steps):
        u = g.normal(size=b.shape[1])
        true.append(x.copy())
        seen.append(h @ x + noise * g.normal(size=len(h)))
        inputs.append(u)
        x = a @ x + b @ u
    return np.array(true), np.array(seen), np.array(inputs)


def stable(n, seed):
    m = np.random.default_rng(seed).normal(size=(n, n))
    return 0.9 * m / np.abs(np.linalg.eigvals(m)).max()


def run(k, seen, inputs):
    return np.array(k.run(np.column_stack((seen, inputs)).tolist())[1])


def test_kalman_bounds():
    a, b = stable(3, 1), np.random.default_rng(2).normal(size=(3, 2))
    true, seen, u = plant(a, b, 500, 0)
    out = run(fl.Kalman(a, b, np.eye(3), 1e-6 * np.eye(3), 1e-6 * np.eye(3)), seen, u)
    assert np.abs(out - true)[-100:].mean() < 1e-3
    a, b = stable(4, 3), np.random.default_rng(4).normal(size=(4, 1))
    true, seen, u = plant(a, b, 1000, 0.5)
    out = run(fl.Kalman(a, b, np.eye(4), 1e-3 * np.eye(4), 0.25 * np.eye(4)), seen, u)
    assert ((out - true) ** 2).mean() < ((seen - true) ** 2).mean()
    h = np.eye(4)[:2]
    true, seen, u = plant(a, b, 1000, 0.1, h=h)
    assert np.abs(run(fl.Kalman(a, b, h, 1e-3 * np.eye(4), 1e-2 * np.eye(2)), seen, u) - true)[-200:].mean() < 1.0
    a, b = np.diag([0.8, 0.7, 0.6]), np.zeros((3, 1))
    true, seen, u = plant(a, b, 500, 0.1, start=(5, 3, -2))
    out = run(fl.Kalman(a, b, np.eye(3), 1e-4 * np.eye(3), 1e-2 * np.eye(3)), seen, u)
    assert np.abs(true[-1]).max() < 1e-3 and np.abs(out[-1]).max() < 1e-1
    assert np.abs(fl.Kalman(a, b, np.eye(3), np.eye(3), 1e-10 * np.eye(3)).k - np.eye(3)).max() < 1e-3
    assert np.abs(fl.Kalman(a, b, np.eye(3), 1e-3 * np.eye(3), 1e6 * np.eye(3)).k).max() < 1e-3


def test_riccati_residual():
    for n in range(2, 7):
        g = np.random.default_rng(n)
        a, b, q, r = g.normal(size=(n, n)), g.normal(size=(n, 2)), np.eye(n), np.eye(2)
        x = la.riccati(a, b, q, r)
        rest = a.T @ x @ a - a.T @ x @ b @ np.linalg.solve(r + b.T @ x @ b, b.T @ x @ a) + q - x
        assert np.abs(rest).max() < 1e-8 * np.abs(x).max()
        assert np.abs(la.poles(a, b, la.regulator(a, b, q, r))).max() < 1


def test_biquad():
    w0 = 0.5
    for kind, gains in {"low_pass": (1, 0), "high_pass": (0, 1), "band_pass": (0, 0), "band_stop": (1, 1)}.items():
        f = fl.Biquad.design(kind, w0)
        w, h = f.response(257)
        assert np.allclose(np.abs(h[[0, -1]]), gains, atol=1e-9)
        t = np.arange(4000)
        _, out = f.run([[math.cos(w[40] * k)] for k in t])
        assert abs(np.max(np.abs(np.array(out)[-1000:])) - abs(h[40])) < 2e-2


def test_madgwick_levels():
    k = fl.Madgwick(0.5)
    state, out = k.run([[0.0, math.sin(0.3), math.cos(0.3), 0.0, 0.0, 0.0, 0.02]] * 2000)
    assert abs(out[-1][0] - 0.3) < 2e-2 and abs(out[-1][1]) < 2e-2
    assert abs(np.linalg.norm(state) - 1) < 1e-9
    assert np.isfinite(k.run([[0.0, 0.0, 0.0, 0.1, 0.0, 0.0, 0.02]])[1]).all()


A, B = la.discretised(np.array([[0.0, 1.0], [0.0, -0.5]]), np.array([[0.0], [1.0]]), 0.1)


@pytest.mark.parametrize("make", [
    lambda: fl.Lqr(A, B, np.diag([10.0, 1.0]), np.eye(1), 5.0),
    lambda: fl.LqrIncrement(A, B, np.diag([10.0, 1.0]), np.eye(1), 0.0, 5.0),
    lambda: fl.Mpc(A, B, np.diag([10.0, 1.0]), np.eye(1), 20, 5, 5.0),
    lambda: fl.MpcGradient(A, B, np.diag([10.0, 1.0]), np.eye(1), 20, 5, 5.0, iterations=60),
])
def test_state_feedback_reaches_its_goal(make):
    k, x, state = make(), np.zeros((2, 1)), None
    state = k.start()
    for _ in range(400):
        state, u = k.step(state, [1.0, 0.0, *x[:, 0]])
        assert abs(u[0]) <= 5.0 + 1e-9
        x = A @ x + B * u[0]
    assert abs(x[0, 0] - 1) < 2e-2


def test_integral_and_disturbance_controllers():
    push = 0.5
    for k, need in ((fl.LqrIntegral(A, B, np.diag([1.0, 0.0]), np.eye(1), q_scale=0.1, u_max=20.0), 5e-2), (fl.LqrDisturbance(A, B, np.diag([10.0, 1.0]), np.eye(1), np.eye(3), 0.1 * np.eye(2)), 5e-2)):
        x, state = np.zeros((2, 1)), k.start()
        for _ in range(1500):
            state, u = k.step(state, [1.0, 0.0, *x[:, 0]])
            x = A @ x + B * (u[0] + push)
        assert abs(x[0, 0] - 1) < need
    c = np.array([[1.0, 0.0]])
    k = fl.Lqg(A, B, c, np.diag([1.0, 1.0]), np.eye(1), 0.1 * np.eye(2), np.eye(1))
    x, state = np.zeros((2, 1)), k.start()
    for _ in range(1500):
        state, u = k.step(state, [1.0, float((c @ x)[0, 0])])
        x = A @ x + B * u[0]
    assert abs(x[0, 0] - 1) < 5e-2
    k, u, x, state = fl.Adrc(1.0, 2.0, 8.0, 0.01), 0.0, np.zeros(2), [0.0, 0.0, 0.0]
    for _ in range(3000):
        state, (u,) = k.step(state, [1.0, x[0], u])
        x = x + 0.01 * np.array([x[1], u + push])
    assert abs(x[0] - 1) < 2e-2


def test_mpc_gradient_nears_the_closed_form():
    q, r = np.diag([10.0, 1.0]), np.eye(1)
    a, b = fl.Mpc(A, B, q, r), fl.MpcGradient(A, B, q, r, iterations=2000)
    assert np.allclose(a.step([], [1.0, 0.0, 0.2, 0.1])[1], b.step([], [1.0, 0.0, 0.2, 0.1])[1], atol=1e-4)


def test_pid_forms_agree():
    rows = [(1.0, math.sin(i / 5)) for i in range(50)]
    _, text = fl.PidTextbook(0.7, 0.05, 0.2).run(rows)
    k, state, last, out = fl.Pid(0.7, 0.05, 0.2), [0.0, 0.0], 0.0, []
    for row in rows:
        state, (last,) = k.step(state, [*row, last])
        out.append(last)
    assert np.allclose(out, np.array(text)[:, 0])


def test_chi2_and_alarm():
    assert abs(la.chi2_quantile(0.95, 1) - 3.8414588) < 1e-6 and abs(la.chi2_quantile(0.99, 5) - 15.0862725) < 1e-6
    a, b = np.array([[1.0]]), np.array([[0.0]])
    true, seen, u = plant(a, b, 300, 0.1)
    seen[200:] += 30 * np.sign(np.sin(np.arange(100)))[:, None]
    out = run(fl.KalmanAlarm(a, b, np.eye(1), 1e-4 * np.eye(1), 0.01 * np.eye(1)), seen, u)
    assert out[-1, -1] > 0.3 > out[199, -1]


def test_simulation(spark):
    df = spark.createDataFrame([(k, i, 1.0) for k in range(2) for i in range(100)], "key long, seq long, u0 double")
    out = fl.simulated(df, "key", [[-1.0]], [[1.0]], ["u0"], ["seq"], dt=0.05).where("seq = 99").collect()
    assert all(abs(r["x0"] - (1 - math.exp(-5))) < 1e-5 for r in out)


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sf.STORE)
    g = np.random.default_rng(0)
    rows = pd.DataFrame({"key": g.integers(0, 5, 300), "i": np.arange(300), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(300), "s"), "x": g.normal(size=300)})
    late = pd.DataFrame({"key": [0], "i": [10_000], "ts": [pd.Timestamp("2024-01-02")], "x": [0.0]})
    schema = "key long, i long, ts timestamp, x double"
    for n, part in enumerate((rows.sample(frac=1, random_state=1), late, late.assign(ts=pd.Timestamp("2024-01-03"), i=10_001))):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    kernel = fl.Biquad.design("low_pass", 0.3)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sf.filtered(stream, kernel, "key", "ts", "i", ["x"]).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).where("i < 10000").orderBy("i").toPandas()
    want = fl.filtered(spark.createDataFrame(rows, schema), kernel, "key", ["ts", "i"], ["x"]).orderBy("i").toPandas()
    assert len(got) == 300 and np.abs(got["y"] - want["y"]).max() == 0
