"""Helpers that the operators of this subpackage share: text units, Arrow
batches in bounded slices, and tables written to the cluster's shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word of the plain kind: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Characters of text that a Python task works on at a time. A longer text is
#: a slice of its own; it is never cut.
SLICE_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> list[str]:
    """Columns of df whose names differ from all names, whatever their case."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def place_of(df: DataFrame, name: str) -> int:
    """Where df has the column of that name; of names that differ in case only, the one that is equal."""
    if name in df.columns:
        return df.columns.index(name)
    return [c.lower() for c in df.columns].index(name.lower())


def chosen(df: DataFrame, carry: Sequence[str] = (), **wanted: str) -> DataFrame:
    """The wanted columns (new name: name in df), and, where some are to be carried,
    those as one struct column named row. Nothing else of df's names is left, so none
    can clash with a column that an operator makes; restored gives them back."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    row = [F.struct(*[F.col(f"c{place_of(df, c)}").alias(f"c{i}") for i, c in enumerate(carry)]).alias("row")] if carry else []
    return plain.select(*row, *[F.col(f"c{place_of(df, c)}").alias(n) for n, c in wanted.items()])


def restored(df: DataFrame, carry: Sequence[str], *made: str | Column) -> DataFrame:
    """The carried columns under their names, and made."""
    return df.select(*[F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(carry)], *made)


def word_count(text) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch with their texts (null: empty), each of about limit characters or one row."""
    at = batch.schema.get_field_index(column)
    lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    start, n = 0, batch.num_rows
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        part = batch.slice(start, stop - start)
        yield part, [t or "" for t in part.column(at).to_pylist()]
        start = stop


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each window of width word hashes."""
    out = h[: max(0, len(h) - width + 1)].copy()
    for j in range(1, width):
        out ^= out >> np.uint64(31)
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[j : j + len(out)]
    return out


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    return window_hashes(word_hashes(words), width)


def squeezed(values: np.ndarray) -> bytes:
    """Numbers, compressed byte plane by byte plane: small ones cost little."""
    planes = values.reshape(-1, 1).view(np.uint8).T.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(planes)


def spread(data: bytes, kind: str) -> np.ndarray:
    """What squeezed has compressed."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def map_texts(df: DataFrame, work: Callable[[pa.RecordBatch, list[str]], Sequence], fields: Sequence[tuple[str, str]], carry: Sequence[str], text: str = "text") -> DataFrame:
    """df's columns carry, and fields as work makes them from each slice of
    rows: one sequence a field. Fields replace columns of the same names."""
    carry = [c for c in carry if c.lower() not in {n.lower() for n, _ in fields}]
    source = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)], F.col(f"`{text}`").cast("string").alias("text"))
    made = StructType.fromDDL(", ".join(f"f{i} {kind}" for i, (_, kind) in enumerate(fields)))
    schema = StructType([*source.schema.fields[: len(carry)], *made.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list = []
        for batch in batches:
            for part, texts in slices(batch):
                kinds = kinds or [arrow_type(k) for _, k in fields]
                out = work(part, texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(carry))] + [pa.array(v, kind) for v, kind in zip(out, kinds, strict=True)],
                    names=[f"c{i}" for i in range(len(carry))] + [f"f{i}" for i in range(len(fields))],
                )

    names = [*carry, *[n for n, _ in fields]]
    return source.mapInArrow(run, schema).toDF(*names)


#: Arrow's types for the SQL types that map_texts makes.
ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "float": pa.float32(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
}


def arrow_type(kind: str) -> pa.DataType:
    if kind.startswith("array<"):
        return pa.list_(arrow_type(kind[6:-1]))
    if kind.startswith("struct<"):
        return pa.struct([(n, arrow_type(k)) for n, k in (x.split(":") for x in kind[7:-1].split(","))])
    return ARROW[kind]


#: Spark deletes the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables in the folder that all executors share. They cut the lineage, so
    that a lost executor costs a read and not the work before it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = "file:///tmp/checkpoints"
        self.root = f"{root.rstrip('/')}/millrace-{uuid.uuid4().hex}"
        self.made = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """df, written once and read back. What was shuffled for it is deleted then."""
        self.made += 1
        path = f"{self.root}/{self.made}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_buckets(self, df: DataFrame, column: str, buckets: int) -> DataFrame:
        """The same, bucketed by a column: groups and joins by it need no shuffle of
        this side where spark.sql.shuffle.partitions is the number of buckets."""
        self.made += 1
        name = f"millrace_{uuid.uuid4().hex}"
        df.write.format("parquet").bucketBy(buckets, column).option("path", f"{self.root}/{self.made}").saveAsTable(name)
        kept = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # the name only: the files are the table's own folder
        return kept

    def drop(self, number: int) -> None:
        """Deletes the table that was made as number, counted from 1."""
        self.delete(f"{self.root}/{number}")

    def clear(self) -> None:
        """Deletes all of its tables: nothing that is still to be read may depend on them."""
        self.delete(self.root)

    def delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def packed_texts(df: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Columns carry of df with its texts compressed, as column packed: a third
    less to shuffle than Spark's own compression of rows leaves."""

    def work(_: pa.RecordBatch, texts: list[str]) -> list:
        packer = zstandard.ZstdCompressor(level=3)
        return [[packer.compress(t.encode("utf-8")) for t in texts]]

    return map_texts(df, work, [("packed", "binary")], carry)


def unpacked_text(packed: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(packed).decode("utf-8")
