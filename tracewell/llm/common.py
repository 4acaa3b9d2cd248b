"""What the operators of this package share: tables, shared-folder checkpoints, ranks without hot groups."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Java pattern of the white space that separates words in most contracts.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)  # for Python workers that start elsewhere
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; one of our own only where that is unset and driver and executors are one process."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tracewell-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def stored(df: DataFrame, compression: str = "snappy", conf: dict[str, str] | None = None) -> DataFrame:
    """The frame, written as Parquet to the shared folder and read again: this cuts lineage and survives lost executors.

    Shuffle files of the write go when it ends, so that they do not add to what later jobs need.
    `conf` holds for this write alone.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracewell-{uuid.uuid4().hex}"
    during = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | (conf or {})
    before = {k: spark.conf.get(k, None) for k in during}
    for k, v in during.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path, compression=compression)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._tracewell_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes what stored() wrote; nothing may read it later."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._tracewell_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, *without: str) -> tuple[DataFrame, dict[str, str]]:
    """df without some columns, under names c0, c1 and so on that meet none of an operator's own, and these names by the old ones."""
    names = [c for c in df.columns if c not in without]
    to = {c: f"c{k}" for k, c in enumerate(names)}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in to.items()]), to


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else; the fast path is for texts of ASCII only."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column, between: str = SPACE) -> Column:
    """Non-empty pieces of the text between matches of the Java pattern; null has none."""
    pieces = F.split(F.coalesce(text, F.lit("")), between)
    return F.filter(pieces, lambda w: w != "")


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; null has a key of its own."""
    return F.coalesce(F.md5(text), F.lit("null"))


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str = "rank", rows_a_bucket: int = 20_000) -> DataFrame:
    """Adds the 0-based rank of each row in its group, ordered by a hash and then by `order`, without one task for a group.

    Rows go to buckets by the leading bits of the hash (`order[0]`, a long that is spread evenly); the counts of the
    buckets, of which there are at most 4,096 a group, give each bucket's first rank, and only a bucket is sorted as a whole.
    df must give the same rows each time it is computed (read it from stored()).
    """
    total = df.count()
    n = min(4096, max(256, total // rows_a_bucket))
    keyed = df.withColumn("_h", order[0].cast("long")).withColumn("_b", F.floor((F.shiftright("_h", 1) / F.lit(2.0**62) + 1) / 2 * n).cast("int"))
    keys = [F.col(c) for c in group]
    sums = keyed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    first = sums.withColumn("_first", F.sum("_n").over(Window.partitionBy(*keys or [F.lit(0)]).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
    first = first.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("_b").alias("_bb"), F.coalesce("_first", F.lit(0)).alias("_first"))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group], F.col("_b") == F.col("_bb"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_h", *order[1:])) - 1
    out = keyed.withColumn("_in", inside).join(first, on)
    return out.withColumn(name, (F.col("_first") + F.col("_in")).cast("long")).select(*df.columns, name)


def empty_like(df: DataFrame, schema: str | T.StructType) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def appended(df: DataFrame, fields: str, work, column: str = "text", raw: bool = False, arrow: bool = False, rows: int | None = None, keep: bool = True) -> DataFrame:
    """df with further columns that work() gives for a batch of texts: lists or Arrow arrays in the order of `fields`, a DDL string.

    work runs in Arrow batches on the executors, over whole texts (None for null; raw: as UTF-8 bytes; arrow: an Arrow array of strings instead of a list); columns of df with the new names are
    replaced. A batch is as large as spark.sql.execution.arrow.maxRecordsPerBatch and maxBytesPerBatch let it be;
    with `rows`, work gets so many texts of it at a time, which bounds what a worker holds as Python objects.
    keep=False leaves the texts out of the result, so that they needn't travel back.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    new = T.StructType.fromDDL(fields)
    df = df.drop(*new.names)
    types = [to_arrow_type(f.dataType) for f in new]
    old = [f for f in df.schema.fields if keep or f.name != column]
    names = [f.name for f in old]

    def run(batches):
        for b in (whole.slice(k, rows) for whole in batches for k in range(0, whole.num_rows, rows)) if rows else batches:
            texts = b.column(b.schema.get_field_index(column))
            given = work(texts.cast(pa.string()) if arrow else (texts.cast(pa.binary()) if raw else texts).to_pylist())
            arrays = [x.cast(t) if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(given, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), *arrays], names=[*names, *new.names])

    return df.mapInArrow(run, T.StructType([*old, *new.fields]))


def spans_digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: (s["kind"] == kind) & s["base"])).cast("long")


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,value:string>>"
