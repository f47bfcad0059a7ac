"""Sources and generators: numeric CSV, images, annotated objects, dynamical systems."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns of text whose every value is a number; one aggregation over all of them. Nulls and empty texts are not."""
    r = df.agg(F.count("*").alias("n"), *(F.count(F.expr(f"try_cast(`{c}` as double)")).alias(f"c{i}") for i, c in enumerate(df.columns))).first()
    return [c for i, c in enumerate(df.columns) if r["n"] and r[f"c{i}"] == r["n"]]


def numeric_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, cut to its fully numeric columns, as floats."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    return raw.select(*(F.col(f"`{c}`").cast("float").alias(c) for c in numeric_columns(raw)))


def time_series(df: DataFrame, time: str, value: str, form: str | None = None) -> DataFrame:
    """(ts, value) in order of time."""
    at = F.to_timestamp(time, form) if form else F.to_timestamp(time)
    return df.select(at.alias("ts"), F.col(value).cast("double").alias("value")).orderBy("ts")


def images(spark: SparkSession, root: str, contains: str = "") -> DataFrame:
    """(index, path, content) of the .jpg and .png files under ``root``, in order of path; hidden files are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    found = found.where(name.rlike(r"\.(jpg|JPG|png|PNG)$") & ~name.startswith(".") & F.col("path").contains(contains))
    paths = found.select("path")
    from pyspark.sql import Window

    # numbered by folder: one window partition for each, folders' offsets joined back
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    sizes = paths.groupBy(folder.alias("folder")).count().orderBy("folder").collect()
    offset, at = {}, 0
    for r in sizes:
        offset[r["folder"]] = at
        at += r["count"]
    pairs = spark.createDataFrame(list(offset.items()), "folder string, offset long")
    numbered = found.withColumn("folder", folder).withColumn("_k", F.row_number().over(Window.partitionBy("folder").orderBy("path")) - 1)
    return numbered.join(pairs, "folder").select((F.col("offset") + F.col("_k")).alias("index"), "path", "content")


def paired(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Frames and annotations side by side, by their number."""
    return images.withColumnRenamed("content", "image").join(masks.select("index", F.col("content").alias("mask"), F.col("path").alias("mask_path")), "index")


def colour_mask(pixels: DataFrame, colours: Sequence[tuple[int, int, int]]) -> DataFrame:
    """``mask`` 1 where the pixel (r, g, b) is one of the colours."""
    hit = F.lit(False)
    for r, g, b in colours:
        hit = hit | ((F.col("r") == r) & (F.col("g") == g) & (F.col("b") == b))
    return pixels.withColumn("mask", hit.cast("int"))


def annotations(spark: SparkSession, root: str) -> DataFrame:
    """(path, title, x, y, data) of the objects in annotation files; data is base64 of zlib-compressed bytes, left as it is."""
    schema = "objects array<struct<classTitle:string,bitmap:struct<origin:array<int>,data:string>>>"
    raw = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").json(root).select(F.col("_metadata.file_path").alias("path"), F.explode("objects").alias("o"))
    return raw.select("path", F.col("o.classTitle").alias("title"), F.get("o.bitmap.origin", F.lit(0)).alias("x"), F.get("o.bitmap.origin", F.lit(1)).alias("y"), F.col("o.bitmap.data").alias("data"))


def trajectories(spark: SparkSession, n: int, starts: Sequence[Sequence[float]], derivative: Callable[[np.ndarray], np.ndarray], dt: float, rule: str = "euler") -> DataFrame:
    """(key, seq, x array, dx array): ``n`` steps from each start, a task for each; ``rule`` is euler or rk4."""
    table = spark.createDataFrame([(k, [float(v) for v in s]) for k, s in enumerate(starts)], "key long, start array<double>")

    def run(frames):
        import pandas as pd

        for frame in frames:
            for key, start in zip(frame["key"], frame["start"], strict=True):
                x, rows = np.asarray(start, float), []
                for seq in range(n):
                    d = derivative(x)
                    rows.append((key, seq, x.tolist(), d.tolist()))
                    if rule == "rk4":
                        k2 = derivative(x + dt / 2 * d)
                        k3 = derivative(x + dt / 2 * k2)
                        x = x + dt / 6 * (d + 2 * k2 + 2 * k3 + derivative(x + dt * k3))
                    else:
                        x = x + dt * d
                yield pd.DataFrame(rows, columns=["key", "seq", "x", "dx"])

    return table.repartition(max(1, len(starts)), "key").mapInPandas(run, "key long, seq long, x array<double>, dx array<double>")


def lorenz(sigma: float = 10.0, rho: float = 28.0, beta: float = 8 / 3) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: np.array([sigma * (x[1] - x[0]), x[0] * (rho - x[2]) - x[1], x[0] * x[1] - beta * x[2]])


def linear(a: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: np.asarray(a) @ x


def append_lines(df: DataFrame, path: str) -> None:
    """Add the rows of ``df`` to a log of JSON lines, one object a row; earlier rows stay."""
    df.write.mode("append").json(path)
