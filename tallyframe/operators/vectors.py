"""Nearest vectors by cosine similarity, exactly or through an index of random hyperplanes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import BROADCAST_LIMIT, estimated_bytes, small


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, summed in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(df: DataFrame, vector: str) -> DataFrame:
    """Scale a vector column to length one; null for null, empty or zero vectors."""
    n = F.sqrt(dot(F.col(vector), F.col(vector)))
    return df.withColumn(vector, F.when(n > 0, F.transform(vector, lambda x: x.cast("double") / n)))


def similar(
    rows: DataFrame, queries: DataFrame, row_id: str, query_id: str, vector: str, top: int, least: float = -1.0, bucket: Column | None = None
) -> DataFrame:
    """query_id, row_id and similarity of the `top` rows most similar to each query, those above `least` (ties: the lower id).

    `queries` is a stated set, broadcast if small, else joined in blocks by the optimizer's choice. Rows or queries without a
    direction match nothing. Each partition keeps only its own best `top` of a query before anything is shuffled.
    """
    r = unit(rows.select(F.col(row_id).alias("row_id"), F.col(vector).alias("v")), "v").where("v is not null")
    q = unit(queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("w")), "w").where("w is not null")
    met = r.join(small(q)) if bucket is None else r.join(q, bucket)
    met = met.select("query_id", "row_id", dot(F.col("v"), F.col("w")).alias("similarity")).where(F.col("similarity") > least)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("row_id"))
    return met.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= top).drop("__rn")


def similar_to_few(rows: DataFrame, queries: DataFrame, row_id: str, query_id: str, vector: str, top: int, least: float = -1.0) -> DataFrame:
    """Like `similar`, with the queries sent along with the code; those too large for that are left to `similar`.

    numpy over whole batches, in the same order of sums, so the similarities are the same to the last bit: the expressions there take each place of each pair apart.
    """
    if estimated_bytes(queries) > BROADCAST_LIMIT:
        return similar(rows, queries, row_id, query_id, vector, top, least)
    asked = [(r[0], r[1]) for r in queries.select(query_id, vector).collect() if r[1] and None not in r[1]]  # within the limit of a broadcast
    query, row = queries.schema[query_id].dataType, rows.schema[row_id].dataType
    query_type = to_arrow_type(query)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Sums of products of the last places, in their order."""
            out = 0.0
            for i in range(a.shape[-1]):
                out = out + a[..., i] * b[..., i]
            return out

        def scaled(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            n = np.sqrt(product(v, v))
            return v[n > 0] / n[n > 0, None], np.flatnonzero(n > 0)

        by_size: dict[int, list] = {}
        for q, v in asked:
            by_size.setdefault(len(v), []).append((q, v))
        sets = {d: (qs, *scaled(np.array([v for _, v in qs], dtype=np.float64))) for d, qs in by_size.items()}
        for b in batches:
            ids, vectors = b.column(0), b.column(1)
            sizes = np.array(vectors.value_lengths().fill_null(0))
            found: tuple[list, list, list] = ([], [], [])
            for d, (qs, w, asking) in sets.items():
                at = np.flatnonzero(sizes == d)
                if not len(at):
                    continue
                flat = vectors.take(pa.array(at)).flatten()
                held = np.array(flat.is_valid()).reshape(-1, d).all(axis=1)
                v, sound = scaled(flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, d)[held])
                at = at[held][sound]
                for k, x in zip(asking, w):
                    s = product(v, x)
                    near = np.flatnonzero(s > least)
                    if len(near) > top:  # with all that tie with the last of them
                        near = near[s[near] >= np.partition(s[near], len(near) - top)[len(near) - top]]
                    found[0].extend([qs[k][0]] * len(near))
                    found[1].extend(ids.take(pa.array(at[near])).to_pylist())
                    found[2].extend(s[near].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(found[0], query_type), pa.array(found[1], ids.type), pa.array(found[2], pa.float64())], ["query_id", "row_id", "similarity"])

    schema = f"query_id {query.simpleString()}, row_id {row.simpleString()}, similarity double"
    met = rows.select(F.col(row_id).alias("row_id"), F.col(vector).alias("v")).mapInArrow(best, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("row_id"))
    return met.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= top).drop("__rn")


def planes(dimension: int, count: int, seed: int) -> list[list[float]]:
    """Random hyperplanes through the origin."""
    import numpy as np

    return np.random.default_rng(seed).normal(size=(count, dimension)).tolist()


def signatures(df: DataFrame, vector: str, dimension: int, tables: int, bits: int, seed: int = 11, probes: int = 0) -> DataFrame:
    """One row per hash table with `table` and `signature`: on which side of the table's planes the vector lies.

    `probes` adds the signatures beyond each of the table's that many nearest planes, where close vectors are most likely cut off.
    """
    sides = [
        F.struct(F.lit(t).alias("table"), F.array(*[dot(F.col(vector), F.array(*[F.lit(float(x)) for x in p])) for p in planes(dimension, bits, seed + t)]).alias("far"))
        for t in range(tables)
    ]
    code = sum((F.when(F.col("__s.far")[b] > 0, 1 << b).otherwise(0) for b in range(bits)), F.lit(0))
    nearest = F.slice(F.array_sort(F.transform("__s.far", lambda x, b: F.struct(F.abs(x).alias("far"), F.pow(F.lit(2), b).cast("int").alias("bit")))), 1, probes)
    kept = F.array_prepend(F.transform(nearest, lambda n: F.col("__code").bitwiseXOR(n["bit"])), F.col("__code")) if probes else F.array("__code")
    own = df.withColumn("__s", F.explode(F.array(*sides))).withColumn("__code", code)
    return own.select(*df.columns, "__s.table", F.explode(kept).alias("signature"))


def similar_indexed(
    rows: DataFrame, queries: DataFrame, row_id: str, query_id: str, vector: str, top: int, dimension: int, tables: int = 12, bits: int = 4, probes: int = 1
) -> DataFrame:
    """Like `similar`, over the rows whose signature in some table is the query's or lies beyond one of its `probes` nearest planes there.

    Approximate; every row is indexed, and only queries are probed.
    """
    r = signatures(rows.select(F.col(row_id).alias("row_id"), F.col(vector).alias("v")), "v", dimension, tables, bits)
    q = signatures(queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("w")), "w", dimension, tables, bits, probes=probes)
    pairs = r.join(q, ["table", "signature"]).select("query_id", "row_id").distinct()
    rv = unit(rows.select(F.col(row_id).alias("row_id"), F.col(vector).alias("v")), "v").where("v is not null")
    qv = unit(queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("w")), "w").where("w is not null")
    met = pairs.join(rv, "row_id").join(small(qv), "query_id").select("query_id", "row_id", dot(F.col("v"), F.col("w")).alias("similarity"))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("row_id"))
    return met.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= top).drop("__rn")
