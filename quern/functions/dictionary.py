"""Feature dictionaries: graphs of nodes that compile to lists of Catalyst columns.

A node applied to input columns gives output columns; nothing runs until Spark does. A node may have an ``upstream``: nothing
(it sees the raw inputs), a node (series), or a list of nodes (their outputs side by side, each on the raw inputs). A branch
that several nodes share is compiled once. Any callable from a list of columns to a list of columns is a node, too.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keeps the rational nodes finite at 0.
EPSILON = 1e-7


class Dictionary:
    def __init__(self, upstream: Dictionary | Sequence[Dictionary] | None = None) -> None:
        if not (upstream is None or isinstance(upstream, Dictionary) or (isinstance(upstream, list | tuple) and all(callable(u) for u in upstream))):
            raise TypeError("upstream is None, a node or a list of nodes")
        self.upstream = upstream

    def __call__(self, columns: list[Column], _known: dict | None = None) -> list[Column]:
        known = {} if _known is None else _known
        if id(self) not in known:
            if self.upstream is None:
                inner = list(columns)
            elif isinstance(self.upstream, Dictionary):
                inner = self.upstream(columns, known)
            else:
                inner = [c for u in self.upstream for c in (u(columns, known) if isinstance(u, Dictionary) else u(columns))]
            known[id(self)] = self.expand(inner)
        return known[id(self)]

    def expand(self, x: list[Column]) -> list[Column]:
        raise NotImplementedError

    def __repr__(self) -> str:
        own = ", ".join(f"{k}={v!r}" for k, v in vars(self).items() if k != "upstream")
        return f"{type(self).__name__}({own})" + (f" <- {self.upstream!r}" if self.upstream is not None else "")


class Identity(Dictionary):
    def expand(self, x):
        return x


class Concatenate(Dictionary):
    """Outputs of several nodes side by side."""

    def __init__(self, nodes: Sequence[Callable]) -> None:
        if not isinstance(nodes, list | tuple):
            raise TypeError("a list of nodes is needed")
        super().__init__(list(nodes))

    def expand(self, x):
        return x


class Constant(Dictionary):
    def expand(self, x):
        return [F.lit(1.0)]


class Polynomial(Dictionary):
    """All squares, then all cubes, and so on up to ``degree``."""

    def __init__(self, upstream=None, degree: int = 3) -> None:
        if degree < 2:
            raise ValueError("degree is 2 or more")
        super().__init__(upstream)
        self.degree = degree

    def expand(self, x):
        out, last = [], x
        for _ in range(2, self.degree + 1):
            last = [a * b for a, b in zip(last, x, strict=True)]
            out += last
        return out


class Rational(Dictionary):
    """sign(x) / (|x| + 1e-7); 0 at 0."""

    def expand(self, x):
        return [F.signum(c) / (F.abs(c) + EPSILON) for c in x]


class RationalQuadratic(Dictionary):
    def expand(self, x):
        return [1.0 / (c * c + EPSILON) for c in x]


class CrossTerms(Dictionary):
    """Products of pairs i <= j, or i < j without ``squares``."""

    def __init__(self, upstream=None, squares: bool = True) -> None:
        super().__init__(upstream)
        self.squares = squares

    def expand(self, x):
        return [a * b for i, a in enumerate(x) for b in x[i + (not self.squares) :]]


class Wave(Dictionary):
    """For each harmonic k the sines of all k x, then the cosines."""

    def __init__(self, upstream=None, n_harmonics: int = 1) -> None:
        super().__init__(upstream)
        self.n_harmonics = n_harmonics

    def expand(self, x):
        return [f(c * float(k)) for k in range(1, self.n_harmonics + 1) for f in (F.sin, F.cos) for c in x]


class NonLinear(Dictionary):
    """sign, |x|, max(x, 0), min(x, 0), tanh, x squared, |x| x; each over all inputs."""

    def expand(self, x):
        zero = F.lit(0.0)
        forms = (F.signum, F.abs, lambda c: F.greatest(c, zero), lambda c: F.least(c, zero), F.tanh, lambda c: c * c, lambda c: F.abs(c) * c)
        return [f(c) for f in forms for c in x]


class SinCosCross(Dictionary):
    """For each input a and every other b: a sin b, a cos b."""

    def expand(self, x):
        return [a * f(b) for i, a in enumerate(x) for j, b in enumerate(x) if i != j for f in (F.sin, F.cos)]


def apply(df: DataFrame, node: Callable, inputs: Sequence[str], keep: Sequence[str] = (), prefix: str = "z") -> DataFrame:
    """``keep`` and the node's outputs as z0, z1, ..."""
    out = node([F.col(c).cast("double") for c in inputs])
    return df.select(*keep, *(c.alias(f"{prefix}{i}") for i, c in enumerate(out)))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def one_hot(c: Column, classes: int) -> list[Column]:
    return [(c == k).cast("double") for k in range(classes)]


def standardised(df: DataFrame, columns: Sequence[str], epsilon: float = 1e-12, fit: DataFrame | None = None) -> DataFrame:
    """(x - mean) / (population deviation + epsilon), with the statistics of ``fit`` (default: of ``df``) from one pass."""
    s = (df if fit is None else fit).agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return df.withColumns({c: (F.col(c) - F.lit(s[f"m_{c}"])) / F.lit((s[f"s_{c}"] or 0.0) + epsilon) for c in columns})


def projected(columns: Sequence[Column], matrix: Sequence[Sequence[float]]) -> list[Column]:
    """x P for a fixed matrix; zero entries cost nothing."""
    out = []
    for j in range(len(matrix[0])):
        terms = [c * float(row[j]) for c, row in zip(columns, matrix, strict=True) if row[j]]
        out.append(sum(terms[1:], terms[0]) if terms else F.lit(0.0))
    return out


def softmax(logits: Column) -> Column:
    """Of an array, shifted by its maximum."""
    raised = F.transform(logits, lambda v: F.exp(v - F.array_max(logits)))
    total = F.aggregate(raised, F.lit(0.0), lambda a, v: a + v)
    return F.transform(raised, lambda v: v / total)


def entropy(p: Column, epsilon: float = 1e-15) -> Column:
    return -F.aggregate(p, F.lit(0.0), lambda a, v: a + v * F.ln(v + F.lit(epsilon)))


def quaternion_angles(w: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """Roll, pitch, yaw."""
    return [F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)), F.asin(clip(2 * (w * y - z * x), -1.0, 1.0)), F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))]


def homography(kind: str, *p: float) -> list[list[float]]:
    """3 x 3 matrix of a translation, rotation, scaling, shear or perspective."""
    import math

    one = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    if kind == "translation":
        one[0][2], one[1][2] = p
    elif kind == "rotation":
        c, s = math.cos(p[0]), math.sin(p[0])
        one[0][:2], one[1][:2] = [c, -s], [s, c]
    elif kind == "scaling":
        one[0][0], one[1][1] = p
    elif kind == "shear":
        one[0][1], one[1][0] = p
    elif kind == "perspective":
        one[2][0], one[2][1] = p
    else:
        raise ValueError(kind)
    return one


def warped(x: Column, y: Column, h: Sequence[Sequence[float]]) -> tuple[Column, Column]:
    """A point under a homography."""
    u, v, w = (x * float(r[0]) + y * float(r[1]) + float(r[2]) for r in h)
    return u / w, v / w


def camera_point(x: Column, y: Column, z: Column, focal: tuple[float, float], centre: tuple[float, float]) -> tuple[Column, Column]:
    """Image point of a camera-frame point; null behind the camera."""
    front = F.when(z > 0, z)
    return x / front * focal[0] + centre[0], y / front * focal[1] + centre[1]
