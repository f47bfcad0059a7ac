"""Per-sample recursive filters and controllers: one kernel for batch groups and for streaming state.

A kernel is an object with ``start()``, the first state as a flat list of numbers, and ``step(state, row)``, which gives the new
state and the outputs as lists; ``outputs`` names them. ``filtered`` runs it along every key of a table, the module
``streaming`` runs it on arriving rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import linalg as la

WIDE = 1e10


def column(values: Sequence[float]) -> np.ndarray:
    return np.asarray(values, float).reshape(-1, 1)


def flat(*parts: np.ndarray) -> list[float]:
    return [float(v) for p in parts for v in np.asarray(p).reshape(-1)]


class Kernel:
    inputs: tuple[str, ...] = ("x",)
    outputs: tuple[str, ...] = ("y",)

    def start(self) -> list[float]:
        return []

    def step(self, state: list[float], row: list[float]) -> tuple[list[float], list[float]]:
        raise NotImplementedError

    def run(self, rows, state: list[float] | None = None) -> tuple[list[float], list[list[float]]]:
        state, out = self.start() if state is None else state, []
        for row in rows:
            state, y = self.step(state, list(row))
            out.append(y)
        return state, out


class Ema(Kernel):
    def __init__(self, alpha: float) -> None:
        self.alpha = alpha

    def step(self, state, row):
        y = row[0] if not state else self.alpha * row[0] + (1 - self.alpha) * state[0]
        return [y], [y]


class Biquad(Kernel):
    """Second-order section in transposed direct form II; coefficients normalised by a0."""

    def __init__(self, b0: float, b1: float, b2: float, a1: float, a2: float) -> None:
        self.b, self.a = (b0, b1, b2), (a1, a2)

    @classmethod
    def design(cls, kind: str, w0: float, q: float | None = None) -> Biquad:
        """low_pass, high_pass (q: 1/sqrt 2), band_pass, band_stop (q: 1) at ``w0`` radians a sample."""
        q = q if q is not None else math.sqrt(0.5) if kind in ("low_pass", "high_pass") else 1.0
        c, alpha = math.cos(w0), math.sin(w0) / (2 * q)
        b = {"low_pass": ((1 - c) / 2, 1 - c, (1 - c) / 2), "high_pass": ((1 + c) / 2, -1 - c, (1 + c) / 2), "band_pass": (alpha, 0.0, -alpha), "band_stop": (1.0, -2 * c, 1.0)}[kind]
        return cls(*(v / (1 + alpha) for v in (*b, -2 * c, 1 - alpha)))

    def start(self):
        return [0.0, 0.0]

    def step(self, state, row):
        x = row[0]
        y = self.b[0] * x + state[0]
        return [self.b[1] * x - self.a[0] * y + state[1], self.b[2] * x - self.a[1] * y], [y]

    def response(self, points: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """(frequency, complex gain) at even frequencies from 0 to pi."""
        w = np.linspace(0, math.pi, points)
        z = np.exp(-1j * w)
        return w, np.polyval(self.b[::-1], z) / np.polyval((self.a[1], self.a[0], 1.0), z)


class Kalman(Kernel):
    """Steady-state filter of x' = A x + B u, y = H x; rows are the observations, then the inputs. Outputs: filtered states."""

    def __init__(self, a, b, h, q, r, gain=None) -> None:
        self.a, self.b, self.h = (np.asarray(m, float) for m in (a, b, h))
        self.k = la.observer(self.a, self.h, np.asarray(q, float), np.asarray(r, float)) if gain is None else np.asarray(gain, float)
        self.inputs = (*(f"y{i}" for i in range(len(self.h))), *(f"u{i}" for i in range(self.b.shape[1])))
        self.outputs = tuple(f"x{i}" for i in range(len(self.a)))

    def start(self):
        return [0.0] * len(self.a)

    def step(self, state, row):
        x, y, u = column(state), column(row[: len(self.h)]), column(row[len(self.h) :])
        x = x + self.k @ (y - self.h @ x)
        return flat(self.a @ x + self.b @ u), flat(x)

    def forecast(self, state, inputs) -> np.ndarray:
        """Observations after the state, which already stands one step ahead of the last row."""
        x, out = column(state), []
        for u in inputs:
            x = self.a @ x + self.b @ column(u)
            out.append((self.h @ x).reshape(-1))
        return np.array(out)


class KalmanAlarm(Kalman):
    """Predictor-form filter with a running rate of residuals beyond a chi-square bound. Outputs: states, distance, rate."""

    def __init__(self, a, b, h, q, r, confidence: float = 0.99, memory: float = 0.99) -> None:
        super().__init__(a, b, h, q, r)
        self.weigh, self.memory = np.linalg.inv(np.asarray(r, float)), memory
        self.bound = la.chi2_quantile(confidence, len(self.h))
        self.outputs = (*self.outputs, "distance", "alarm")

    def start(self):
        return [0.0] * (len(self.a) + 1)

    def step(self, state, row):
        x, y, u = column(state[:-1]), column(row[: len(self.h)]), column(row[len(self.h) :])
        x = self.a @ x + self.b @ u + self.k @ (y - self.h @ x)
        rest = y - self.h @ x
        distance = float((rest.T @ self.weigh @ rest)[0, 0])
        alarm = self.memory * state[-1] + (1 - self.memory) * (distance > self.bound)
        return flat(x, [alarm]), flat(x, [distance, alarm])


class Madgwick(Kernel):
    """Orientation from acceleration and rotation rates; a zero acceleration leaves the gyroscope alone to turn. Outputs: roll, pitch, yaw."""

    inputs, outputs = ("ax", "ay", "az", "gx", "gy", "gz", "dt"), ("roll", "pitch", "yaw")

    def __init__(self, beta: float = 0.1) -> None:
        self.beta = beta

    def start(self):
        return [1.0, 0.0, 0.0, 0.0]

    def step(self, state, row):
        # plain numbers in a fixed order: near a level the slope's direction hangs on last bits, and sums of arrays round them by machine
        (w, x, y, z), (ax, ay, az, gx, gy, gz, dt) = state, row
        sw = sx = sy = sz = 0.0
        force = math.sqrt(ax * ax + ay * ay + az * az)
        if force > 0:
            # gravity in the body frame against what is measured, and the slope of half its square
            fx, fy, fz = 2 * (x * z - w * y) - ax / force, 2 * (w * x + y * z) - ay / force, 1 - 2 * (x * x + y * y) - az / force
            sw, sx, sy, sz = 2 * (x * fy - y * fx), 2 * (z * fx + w * fy - 2 * x * fz), 2 * (z * fy - w * fx - 2 * y * fz), 2 * (x * fx + y * fy)
        size = math.sqrt(sw * sw + sx * sx + sy * sy + sz * sz)
        if not size > 0:
            sw, sx, sy, sz, size = 0.0, 0.0, 0.0, 0.0, 1.0
        vw = w + dt * (0.5 * (-x * gx - y * gy - z * gz) - self.beta * sw / size)
        vx = x + dt * (0.5 * (w * gx + y * gz - z * gy) - self.beta * sx / size)
        vy = y + dt * (0.5 * (w * gy - x * gz + z * gx) - self.beta * sy / size)
        vz = z + dt * (0.5 * (w * gz + x * gy - y * gx) - self.beta * sz / size)
        length = math.sqrt(vw * vw + vx * vx + vy * vy + vz * vz) or math.nan
        w, x, y, z = q = [vw / length, vx / length, vy / length, vz / length]
        return q, [math.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)), math.asin(max(-1.0, min(1.0, 2 * (w * y - z * x)))), math.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))]


class PidTextbook(Kernel):
    inputs, outputs = ("xr", "x"), ("u",)

    def __init__(self, kp: float, ki: float, kd: float) -> None:
        self.gains = (kp, ki, kd)

    def start(self):
        return [0.0, 0.0]

    def step(self, state, row):
        e = row[0] - row[1]
        total = state[0] + e
        return [total, e], [self.gains[0] * e + self.gains[1] * total + self.gains[2] * (e - state[1])]


class Pid(Kernel):
    """Incremental form: rows are reference, measurement and the input that was applied before; ``du_max`` bounds a step."""

    inputs, outputs = ("xr", "x", "u_prev"), ("u",)

    def __init__(self, kp: float, ki: float, kd: float, u_max: float = WIDE, du_max: float = WIDE) -> None:
        self.k, self.u_max, self.du_max = (kp + ki + kd, -kp - 2 * kd, kd), u_max, du_max

    def start(self):
        return [0.0, 0.0]

    def step(self, state, row):
        e = row[0] - row[1]
        du = self.k[0] * e + self.k[1] * state[0] + self.k[2] * state[1]
        u = row[2] + min(self.du_max, max(-self.du_max, du))
        return [e, state[0]], [min(self.u_max, max(-self.u_max, u))]


class _StateFeedback(Kernel):
    """Rows are the reference, then the measured state."""

    def __init__(self, n: int, m: int) -> None:
        self.n, self.m = n, m
        self.inputs = (*(f"xr{i}" for i in range(n)), *(f"x{i}" for i in range(n)))
        self.outputs = tuple(f"u{i}" for i in range(m))

    def parts(self, row):
        return column(row[: self.n]), column(row[self.n :])


class Lqr(_StateFeedback):
    def __init__(self, a, b, q, r, u_max: float = WIDE) -> None:
        super().__init__(len(a), b.shape[1])
        self.k, self.u_max = la.regulator(a, b, q, r), u_max

    def step(self, state, row):
        xr, x = self.parts(row)
        return [], flat(np.clip(self.k @ (xr - x), -self.u_max, self.u_max))


class LqrIntegral(_StateFeedback):
    """Integral action in the input; what saturation cuts off is taken back from the integral."""

    def __init__(self, a, b, q, r, *, q_scale: float = 1.0, u_max: float = WIDE) -> None:
        n = len(a)
        super().__init__(n, b.shape[1])
        big, inputs = la.with_integrator(a, b, n)
        k = la.regulator(big, inputs, np.block([[q, np.zeros((n, n))], [np.zeros((n, n)), q_scale * q]]), r)
        k[np.abs(k) < 1e-10] = 0
        self.kx, self.ki, self.u_max = k[:, :n], k[:, n:], u_max

    def start(self):
        return [0.0] * self.m

    def step(self, state, row):
        xr, x = self.parts(row)
        z = column(state) + self.ki @ (xr - x)
        u = z - self.kx @ x
        cut = np.clip(u, -self.u_max, self.u_max)
        return flat(z - (u - cut)), flat(cut)


class LqrIncrement(_StateFeedback):
    """Regulates the change of the input; the input is the state."""

    def __init__(self, a, b, q, r, s: float = 0.0, u_max: float = WIDE) -> None:
        n, m = len(a), b.shape[1]
        super().__init__(n, m)
        big = np.block([[a, b], [np.zeros((m, n)), np.eye(m)]])
        k = la.regulator(big, np.vstack((np.zeros((n, m)), np.eye(m))), np.block([[q, np.zeros((n, m))], [np.zeros((m, n)), s * np.eye(m)]]), r)
        self.kx, self.ku, self.u_max = k[:, :n], k[:, n:], u_max

    def start(self):
        return [0.0] * self.m

    def step(self, state, row):
        xr, x = self.parts(row)
        u = column(state)
        u = np.clip(u + self.kx @ (xr - x) - self.ku @ u, -self.u_max, self.u_max)
        return flat(u), flat(u)


class Lqg(Kernel):
    """Output feedback: an observer's state and running sums of the output error, both weighed by one regulator.

    The regulator is that of the plant with integrators behind its outputs, with weight on the integrators alone: (C Q) summed by
    row. Rows are required and measured outputs. What saturation cuts off the input is taken back from the sums.
    """

    #: Fixed value: gains below it are zero.
    LEAST_GAIN = 1e-10

    def __init__(self, a, b, c, q, r, noise_q, noise_r, u_max: float = WIDE, di_max: float = WIDE) -> None:
        self.plant, self.limits = (a, b, c), (u_max, di_max)
        states, outputs = len(a), len(c)
        both = la.regulator(*la.with_integrator(a, b, outputs), np.diag([*[0.0] * states, *(c @ q).sum(1)]), r)
        both = np.where(np.abs(both) < self.LEAST_GAIN, 0.0, both)
        self.by_state, self.by_error = np.hsplit(both, [states])
        self.correct = la.observer(a, c, noise_q, noise_r)
        self.inputs = tuple(f"{n}{i}" for n in ("yr", "y") for i in range(outputs))
        self.outputs = tuple(f"u{i}" for i in range(b.shape[1]))

    def start(self):
        return [0.0] * (len(self.outputs) + len(self.plant[0]))

    def step(self, state, row):
        (a, b, c), (most, most_step) = self.plant, self.limits
        required, measured = np.split(column(row), 2)
        sums, x = np.split(column(state), [len(self.outputs)])
        sums = sums + (self.by_error @ (required - measured)).clip(-most_step, most_step)
        free = sums - self.by_state @ x
        u = free.clip(-most, most)
        return flat(sums + u - free, a @ x + b @ u + self.correct @ (measured - c @ x)), flat(u)


class LqrDisturbance(_StateFeedback):
    """Regulator beside an observer of a constant disturbance at the input, which is taken off."""

    def __init__(self, a, b, q, r, observer_q, observer_r) -> None:
        n, m = len(a), b.shape[1]
        super().__init__(n, m)
        self.k = la.regulator(a, b, q, r)
        self.big, self.inp, self.see = np.block([[a, b], [np.zeros((m, n)), np.eye(m)]]), np.vstack((b, np.zeros((m, m)))), np.hstack((np.eye(n), np.zeros((n, m))))
        self.l = la.observer(self.big, self.see, observer_q, observer_r)

    def start(self):
        return [0.0] * (self.n + 2 * self.m)

    def step(self, state, row):
        xr, x = self.parts(row)
        guess = self.big @ column(state[: self.n + self.m]) + self.inp @ column(state[self.n + self.m :])
        guess = guess + self.l @ (x - self.see @ guess)
        u = self.k @ (xr - x) - guess[self.n :]
        return flat(guess, u), flat(u)


class Adrc(Kernel):
    """Second-order active disturbance rejection; rows are reference, measurement and the current input."""

    inputs, outputs = ("xr", "x", "u_now"), ("u",)

    def __init__(self, b0: float, wc: float, wo: float, dt: float) -> None:
        self.b0, self.wc, self.wo, self.dt = b0, wc, wo, dt

    def start(self):
        return [0.0, 0.0, 0.0]

    def step(self, state, row):
        z, gap = np.array(state), row[1] - state[0]
        z = z + self.dt * (np.array([z[1], z[2] + self.b0 * row[2], 0.0]) + gap * np.array([3 * self.wo, 3 * self.wo**2, self.wo**3]))
        return flat(z), [float((self.wc**2 * (row[0] - z[0]) - 2 * self.wc * z[1] - z[2]) / self.b0)]


class Mpc(_StateFeedback):
    """Condensed predictive control without constraints inside the horizon; the first input, clipped. A constant reference is held."""

    def __init__(self, a, b, q, r, predict: int = 16, control: int = 4, u_max: float = WIDE) -> None:
        super().__init__(len(a), b.shape[1])
        self.free, self.forced = la.horizon(a, b, predict, control)
        weight = np.kron(np.eye(predict), q)
        self.hessian, self.pull = self.forced.T @ weight @ self.forced + np.kron(np.eye(control), r), self.forced.T @ weight
        self.gain, self.predict, self.u_max = np.linalg.solve(self.hessian, self.pull)[: self.m], predict, u_max

    def plan(self, wanted: np.ndarray, x: np.ndarray) -> np.ndarray:
        """First input for a stacked reference trajectory."""
        return np.clip(self.gain @ (wanted - self.free @ x), -self.u_max, self.u_max)

    def step(self, state, row):
        xr, x = self.parts(row)
        return [], flat(self.plan(np.tile(xr, (self.predict, 1)), x))


class MpcGradient(Mpc):
    """The same with bounded inputs over the whole horizon: accelerated projected gradient, a fixed number of steps."""

    def __init__(self, *args, iterations: int = 8, **named) -> None:
        super().__init__(*args, **named)
        self.iterations, self.pace = iterations, 0.5 / np.linalg.eigvalsh(self.hessian)[-1]

    def plan(self, wanted, x):
        aim = self.pull @ (wanted - self.free @ x)
        u = ahead = np.zeros_like(aim)
        t = 1.0
        for _ in range(self.iterations):
            last, u = u, np.clip(ahead - self.pace * 2 * (self.hessian @ ahead - aim), -self.u_max, self.u_max)
            t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
            ahead = u + (before - 1) / t * (u - last)
        return u[: self.m]


class KoopmanLqr(Kernel):
    """u = -K z on the last ``depth`` measured values, newest first."""

    outputs = ("u",)

    def __init__(self, gain: Sequence[float]) -> None:
        self.gain = [float(g) for g in gain]

    def start(self):
        return [0.0] * len(self.gain)

    def step(self, state, row):
        z = [row[0], *state[:-1]]
        return z, [-sum(g * v for g, v in zip(self.gain, z, strict=True))]


class ClosedLoop(Kernel):
    """A discrete plant x' = A x + B u under a controller that sees reference and state; rows are references. Outputs: the state before the step, the input."""

    def __init__(self, a, b, controller: Kernel, start: Sequence[float] = ()) -> None:
        self.a, self.b, self.controller = np.asarray(a, float), np.asarray(b, float), controller
        self.first = list(start) or [0.0] * len(self.a)
        self.inputs = tuple(f"xr{i}" for i in range(len(self.a)))
        self.outputs = (*(f"x{i}" for i in range(len(self.a))), *(f"u{i}" for i in range(self.b.shape[1])))

    def start(self):
        return [*self.first, *self.controller.start()]

    def step(self, state, row):
        n = len(self.a)
        x = state[:n]
        inner, u = self.controller.step(state[n:], [*row, *x])
        return [*flat(self.a @ column(x) + self.b @ column(u)), *inner], [*x, *u]


def _runs(batch: pa.RecordBatch, width: int):
    """(key, first, end) of each run of equal keys in a batch, and its inputs as rows."""
    keys = batch.column(0).to_pylist()
    edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
    columns = [batch.column(batch.num_columns - width + i).to_numpy(zero_copy_only=False) for i in range(width)]
    rows = np.column_stack(columns).tolist() if width else [[] for _ in keys]
    return [(keys[a], rows[a:b]) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def _laid(df: DataFrame, key: str, by: Sequence[str], inputs: Sequence[str]) -> DataFrame:
    """Rows of a key side by side in one task, in order; the sort may spill."""
    slim = df.select(key, *by, *(F.col(c).cast("double").alias(f"in_{i}") for i, c in enumerate(inputs)))
    return slim.repartition(F.col(key)).sortWithinPartitions(key, *by)


def filtered(df: DataFrame, kernel: Kernel, key: str, by: Sequence[str], inputs: Sequence[str]) -> DataFrame:
    """``key``, ``by`` and the kernel's outputs, one row for each row of ``df``.

    A key's rows pass one state in order, so a key is the unit of work; keys are independent. Rows come by Arrow batches and the
    state goes on from batch to batch: memory does not grow with a key. Null inputs are NaN, null ``by`` values come first.
    """
    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in (key, *by)), *(f"{o} double" for o in kernel.outputs)])
    held, width, names = len(by) + 1, len(inputs), [key, *by, *kernel.outputs]

    def run(batches):
        state, last = None, None
        for batch in batches:
            out = []
            for k, rows in _runs(batch, width):
                if (k,) != last:
                    state, last = None, (k,)
                state, found = kernel.run(rows, state)
                out += found
            if out:
                yield pa.RecordBatch.from_arrays([*batch.columns[:held], *(pa.array([r[i] for r in out], pa.float64()) for i in range(len(kernel.outputs)))], names)

    return _laid(df, key, by, inputs).mapInArrow(run, schema)


def forecasted(df: DataFrame, kernel: Kalman, key: str, by: Sequence[str], inputs: Sequence[str], future: Sequence[Sequence[float]]) -> DataFrame:
    """(key, step, y0, ...): what the kernel expects after the last row of each key, under the inputs of ``future``."""
    schema = ", ".join([f"`{key}` {dict(df.dtypes)[key]}", "step int", *(f"y{i} double" for i in range(len(kernel.h)))])
    width = len(inputs)

    def run(batches):
        state, last = None, None

        def ahead():
            y = kernel.forecast(state, future)
            return pa.RecordBatch.from_pydict({key: pa.array([last[0]] * len(y), kind), "step": pa.array(range(1, len(y) + 1), pa.int32())} | {f"y{i}": y[:, i] for i in range(len(kernel.h))})

        for batch in batches:
            kind = batch.schema.field(0).type
            for k, rows in _runs(batch, width):
                if (k,) != last:
                    if last:
                        yield ahead()
                    state, last = None, (k,)
                state, _ = kernel.run(rows, state)
        if last:
            yield ahead()

    return _laid(df, key, by, inputs).mapInArrow(run, schema)


def simulated(df: DataFrame, key: str, a, b, inputs: Sequence[str], by: Sequence[str], dt: float | None = None, start: Sequence[float] | None = None) -> DataFrame:
    """States of x' = A x + B u along each key: discrete, or with ``dt`` continuous by the classical fourth-order rule."""
    a, b = np.asarray(a, float), np.asarray(b, float)

    class Plant(Kernel):
        outputs = tuple(f"x{i}" for i in range(len(a)))

        def start(self):
            return list(start or [0.0] * len(a))

        def step(self, state, row):
            x, u = column(state), column(row)
            if dt is None:
                x = a @ x + b @ u
            else:
                f = lambda v: a @ v + b @ u
                k1 = f(x)
                k2 = f(x + dt / 2 * k1)
                k3 = f(x + dt / 2 * k2)
                x = x + dt / 6 * (k1 + 2 * k2 + 2 * k3 + f(x + dt * k3))
            return flat(x), flat(x)

    return filtered(df, Plant(), key, by, inputs)
