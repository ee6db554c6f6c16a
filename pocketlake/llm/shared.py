"""Small helpers of the operators in this folder."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the public tokenizer files; every machine has it, the files are never copied.
TOKENIZER_FOLDER = os.environ.get("TOKENIZER_FOLDER", "/opt/tokenizers")
BYTE_BPE = f"{TOKENIZER_FOLDER}/byte_bpe_50k.json"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str) -> Column:
    """The UTF-8 bytes of a text column; null becomes empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def held_out(key: str) -> Column:
    """True where crc32 of the key as text leaves 0 on division by 5. A null key counts as empty text, thus as held out."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def field(df: DataFrame, name: str, alias: str | None = None) -> T.StructField:
    """The field of a column, nullable, for the schema of a Python step that passes it on."""
    return T.StructField(alias or name, df.schema[name].dataType, True)


def low_hash(key: str, size: int, total: int) -> Column:
    """True for rows whose key hashes so low that about four times ``size`` of ``total`` are left.

    A sample of the ``size`` lowest hashes then sorts a bounded number of rows, whatever the number of tasks.
    """
    share = min(1.0, 4.0 * size / max(1, total))
    return F.xxhash64(key) <= F.lit(min((1 << 63) - 1, -(1 << 63) + int(share * (1 << 64))))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name in taken:
        name = f"_{name}"
    return name


def each_body(bodies: pa.Array) -> Iterator[bytes | None]:
    """The values of an Arrow array, of which only a slice is held as Python objects at a time."""
    for at in range(0, len(bodies), 500):
        yield from bodies.slice(at, 500).to_pylist()


def map_rows(
    df: DataFrame, keys: list[str], body: str, extra: list[T.StructField], make: Callable[[], Callable[[bytes], tuple]]
) -> DataFrame:
    """One output row per input row: the key columns, then the values that ``make()`` 's function gives for the bytes of ``body``.

    ``make`` runs once per task, so that models and caches are set up in the worker. Null bodies arrive as ``None``.
    """
    schema = T.StructType([field(df, k) for k in keys] + extra)
    arrow = [to_arrow(f) for f in extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                rows = [function(x) for x in part.column(len(keys)).to_pylist()]
                columns = list(zip(*rows, strict=True)) or [()] * len(extra)
                made = [pa.array(list(c), a.type) for c, a in zip(columns, arrow, strict=True)]
                names = [*keys, *(f.name for f in extra)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keys))] + made, names=names)

    return df.select(*keys, F.col(body).cast("binary").alias("_body")).mapInArrow(run, schema)


def to_arrow(f: T.StructField) -> pa.Field:
    simple = {
        T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.StringType: pa.string(),
        T.BooleanType: pa.bool_(), T.BinaryType: pa.binary(),
    }
    kind = f.dataType
    if isinstance(kind, T.ArrayType):
        return pa.field(f.name, pa.list_(simple[type(kind.elementType)]))
    return pa.field(f.name, simple[type(kind)])
