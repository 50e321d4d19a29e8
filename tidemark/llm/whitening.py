"""Whitening of embeddings with distributed block matrices of Spark MLlib.

Rows are numbered, centred and dealt into dense blocks of ELEMENTS / dims rows. The scatter is the product of the tall block
matrix's transpose with it: its blocks meet pairwise along the rows, and what is added up is dims x dims. Its eigenvectors
are found on the driver, which holds dims x dims numbers and no row. The rows are projected by a block matrix product with
the whitening matrix. For this product the same blocks are laid out as a grid of about as many columns as rows, and the
whitening matrix stands once for each of its columns, on the diagonal: a matrix of a single block column would be dealt to
only the square root of the partitions. The blocks stand in the shared folder, so that both products read the same rows.

The products are MLlib's; PySpark has no argument for the number of splits along the rows, so the multiplication is called
through the matrix's own wrapper. How well the result is white is measured on the projected rows themselves.

Defined cases: vectors that are null or hold null or non-finite entries take no part, nor do those whose scaled entries are
LARGEST and more, or whose length isn't the most common one (of equally common ones the longer), as they have no place in
the matrix; repeated rows and null ids count as rows. A component without variance has whitened 0.0 and identity_error is
then 1.0, as nothing can make it white; with no variance at all explained is 0.0. deviation is null where it exceeds a long.
An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, new_dir

ELEMENTS = 1 << 18  # of a block: 2 MB
GROUP = 16 << 20  # bytes of blocks that a task reads at once
SPLIT = 8  # blocks that meet in one task of the scatter
LARGEST = 1 << 40


def whole_vectors(vectors: DataFrame, scale: int, shift: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): every component floor(scale * component) + shift."""
    v = F.col(vector).cast("array<double>")
    fits = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) * scale < LARGEST)
    return vectors.where((F.size(vector) > 0) & F.forall(v, fits)).select(F.col(id_col).alias("vec_id"), F.transform(v, lambda e: F.floor(e * scale) + shift).alias("x"))


def _numbered(vectors: DataFrame) -> tuple[DataFrame, int, int]:
    """vectors with `row`, numbers from 0 without gaps; how many they are and their length."""
    sizes = vectors.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = sizes["dims"] if sizes else 0
    stored = materialise(vectors.where(F.size("x") == dims).withColumn("at", F.monotonically_increasing_id()), "vectors")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = sorted(stored.groupBy(part.alias("part")).count().collect())  # a row for each task that wrote
    starts = np.cumsum([0, *(r["count"] for r in counts)]).tolist()
    begun = vectors.sparkSession.createDataFrame([(r["part"], s) for r, s in zip(counts, starts)], "part long, begun long")
    rows = stored.withColumn("part", part).join(F.broadcast(begun), "part").select("vec_id", "x", (F.col("begun") + place).alias("row"))
    return rows, starts[-1], dims


def _sums(dims: int):
    def run(batches):
        import pyarrow as pa

        total = np.zeros(dims, np.int64)
        for b in batches:
            total += b.column("x").flatten().to_numpy().reshape(-1, dims).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["sums"])

    return run


def _totals(parts: DataFrame, column: str, kind: str) -> list:
    """The sums of arrays of one length, place by place."""
    each = parts.select(F.posexplode(column).alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast(kind)).alias("v"))
    return [r["v"] for r in sorted(each.collect())]


def _blocks(rows: DataFrame, mean: np.ndarray, size: int) -> DataFrame:
    """(number, block): the matrices of size centred rows each, in order; what the last one lacks are zeros."""
    dims = len(mean)

    def pack(table):
        import pyarrow as pa

        number = table.column("number")[0].as_py()
        full = np.zeros((size, dims))
        x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, dims)
        full[table.column("row").to_numpy() - number * size] = x - mean
        return pa.table({"number": pa.array([number]), "values": pa.array([full.ravel()], pa.list_(pa.float64()))})

    none = F.lit(None).cast("array<int>")
    numbered = rows.select(F.expr(f"row div {size}").alias("number"), "row", "x")
    packed = numbered.groupBy("number").applyInArrow(pack, "number long, values array<double>")
    matrix = F.struct(  # how MLlib lays out a dense matrix, here row by row
        F.lit(1).cast("byte").alias("type"), F.lit(size).alias("numRows"), F.lit(dims).alias("numCols"), none.alias("colPtrs"), none.alias("rowIndices"),
        "values", F.lit(True).alias("isTransposed"),
    )
    path = new_dir(rows.sparkSession, "blocks")
    packed.select("number", matrix.alias("block")).write.option("parquet.block.size", GROUP).parquet(path)
    typed = T.StructType([T.StructField("number", T.LongType()), T.StructField("block", MatrixUDT())])
    return rows.sparkSession.read.schema(typed).parquet(path)


def _matrix(blocks: DataFrame, i: Column, j: Column, size: int, dims: int, high: int, wide: int) -> BlockMatrix:
    """The block matrix of high x wide blocks, each at (i, j)."""
    placed = blocks.select(F.struct(i.cast("long").alias("i"), j.cast("long").alias("j")).alias("at"), "block")
    return BlockMatrix(callMLlibFunc("createBlockMatrix", placed, size, dims, high * size, wide * dims), size, dims)


def _product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    model = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(model, left.rowsPerBlock, right.colsPerBlock)


def _projected(product: BlockMatrix, size: int, wide: int, n: int) -> DataFrame:
    """(row, y) of a product whose blocks lie in a grid of so many columns."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at, m in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                high, k = m["numRows"].as_py(), m["numCols"].as_py()
                values = m["values"].values.to_numpy()
                y = values.reshape(high, k) if m["isTransposed"].as_py() else values.reshape(k, high).T
                first = (at["_1"] * wide + at["_2"]) * size
                y = np.ascontiguousarray(y[: max(0, n - first)])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * k), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(first + np.arange(len(y))), lists], names=["row", "y"])

    return callMLlibFunc("getMatrixBlocks", product._java_matrix_wrapper._java_model).mapInArrow(run, "row long, y array<double>")


def _scatter(mean: np.ndarray):
    """A task's sum of the products of centred rows; of the rows themselves if mean is empty."""

    def run(batches):
        import pyarrow as pa

        total = None
        for b in batches:
            y = b.column("y").flatten().to_numpy().reshape(len(b.column("y")), -1)
            part = (y - mean).T @ (y - mean) if len(mean) else y.sum(0)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["sums"])

    return run


def _impurity(projected: DataFrame, n: int, k: int) -> float:
    """The largest absolute entry of the covariance of y minus the identity."""
    total = lambda mean: np.array(_totals(projected.select("y").mapInArrow(_scatter(mean), "sums array<double>"), "sums", "double"))
    return float(np.abs(total(total(np.zeros(0)) / n).reshape(k, k) / n - np.eye(k)).max())


def _deviations(n: int, sums: list[int]):
    """Rows (vec_id, row, deviation): the sum over the dimensions of (n * x - sum)^2, in whole numbers."""

    def run(batches):
        import pyarrow as pa

        s, dims = np.array(sums, object), len(sums)
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(-1, dims)
            most = max((abs(n * int(e) - t) for e, t in [*zip(x.max(0), sums), *zip(x.min(0), sums)]), default=0) if len(x) else 0
            if dims * most * most < 1 << 63 and n * max(1, abs(x).max(initial=1)) < 1 << 62:
                found = np.square(n * x - np.array(sums, np.int64)).sum(1).tolist()
            else:
                found = [int(t) if t < 1 << 63 else None for t in ((n * x.astype(object) - s) ** 2).sum(1)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("row"), pa.array(found, pa.int64())], names=["vec_id", "row", "deviation"])

    return run


def whiten(vectors: DataFrame, components: int, elements: int = ELEMENTS) -> DataFrame:
    """vectors (vec_id, x) by component, the strongest first, up to so many: component, n, deviation, whitened, explained and
    identity_error. elements: of a block."""
    spark, kind = vectors.sparkSession, vectors.schema["vec_id"].dataType.simpleString()
    rows, n, dims = _numbered(vectors)
    if not n:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    sums = _totals(rows.select("x").mapInArrow(_sums(dims), "sums array<long>"), "sums", "decimal(38,0)")
    sums = [int(s) for s in sums]
    size = max(1, elements // dims)
    blocks = _blocks(rows, np.array([s / n for s in sums]), size)
    count = -(-n // size)
    wide = math.isqrt(count - 1) + 1
    tall = _matrix(blocks, F.col("number"), F.lit(0), size, dims, count, 1)
    covariance = _product(tall.transpose(), tall, -(-count // SPLIT)).toLocalMatrix().toArray() / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    k = min(components, dims)
    values, axes = values[::-1], axes[:, ::-1]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(dims)] < 0, -1, 1)  # a sign of one's own, whatever the solver gives
    some = values[:k] > max(values[0], 0) * dims * np.finfo(float).eps
    white = np.where(some, axes[:, :k] / np.sqrt(np.where(some, values[:k], 1)), 0)
    share = np.maximum(values[:k], 0) / max(values.sum(), np.finfo(float).tiny)
    diagonal = [((j, j), Matrices.dense(dims, k, white.ravel("F"))) for j in range(wide)]
    whitening = BlockMatrix(spark.sparkContext.parallelize(diagonal), dims, k, wide * dims, wide * k)
    grid = _matrix(blocks, F.expr(f"number div {wide}"), F.col("number") % wide, size, dims, -(-count // wide), wide)
    projected = materialise(_projected(_product(grid, whitening, 1), size, wide, n), "projected")
    impurity = _impurity(projected, n, k)
    known = rows.mapInArrow(_deviations(n, sums), f"vec_id {kind}, row long, deviation long")
    each = known.join(projected, "row").select("vec_id", "deviation", F.posexplode("y").alias("at", "whitened"))
    explained = F.element_at(F.array(*[F.lit(float(e)) for e in share]), F.col("at") + 1)
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(impurity).alias("identity_error")
    )
