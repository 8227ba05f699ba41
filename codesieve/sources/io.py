"""Sources and sinks: Parquet, delimited text, JSON, boundaries and features, by Spark's readers and writers."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codesieve.operators.bitmask import Features
from codesieve.operators.quantile import Codes


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, hint: str = "") -> DataFrame:
    """A Parquet table, with only some columns if given; a missing one is an error that says how to build it."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"{path} isn't there{': ' + hint if hint else ''}") from error
    return df.select(*columns) if columns else df


def exists(spark: SparkSession, path: str) -> bool:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).exists(own)


def view(spark: SparkSession, path: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table as a temporary view that each query scans again."""
    df = read_table(spark, path, columns)
    df.createOrReplaceTempView(name)
    return df


def materialised(df: DataFrame, view: str) -> DataFrame:
    """The table in memory under a name, read once to fill it."""
    out = df.cache()
    out.count()
    out.createOrReplaceTempView(view)
    return out


def drop_view(spark: SparkSession, view: str) -> None:
    spark.catalog.dropTempView(view)


def read_titles(spark: SparkSession, path: str, column: str = "primaryTitle", name: str = "title") -> DataFrame:
    """One column of a tab-separated file with a header, plain or gzip; lines that can't be read and nulls are left out."""
    df = spark.read.option("sep", "\t").option("header", True).option("mode", "DROPMALFORMED").option("quote", "").option("nullValue", "\\N").csv(path)
    return df.select(F.col(column).alias(name)).where(F.col(name).isNotNull())


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None, infer: bool = False) -> DataFrame:
    """Comma-separated files with a header, as strings unless a schema is given or types are inferred, which reads them twice."""
    reader = spark.read.option("header", True).option("inferSchema", infer)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_runs(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """All timing files of a glob, with prefix_bits, suffix_bits and combo from names like ..._p8_s12.csv."""
    df = read_csv(spark, pattern, schema).withColumn("file", F.input_file_name())
    bits = [F.regexp_extract("file", r"_p(\d+)_s(\d+)\.csv", i).cast("int") for i in (1, 2)]
    return df.select("*", bits[0].alias("prefix_bits"), bits[1].alias("suffix_bits")).withColumn("combo", F.format_string("p%d_s%d", "prefix_bits", "suffix_bits")).drop("file")


def write_clustered(df: DataFrame, path: str, code: str | None = None, partitions: int | None = None, rows: int | None = None, compression: str = "snappy", block_bytes: int | None = None, spread: Column | None = None, group_rows: int | None = None) -> None:
    """Parquet sorted by a code in ranges, so that row groups have narrow code ranges and are skipped by their statistics.

    rows: most rows of a file; group_rows, block_bytes: rows and size of a row group, at most. spread: splits a code that many rows share.
    """
    if code:
        by = [F.col(code)] if spread is None else [F.col(code), spread]
        df = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
        df = df.sortWithinPartitions(code)
    writer = df.write.mode("overwrite").option("compression", compression)
    writer = writer.option("maxRecordsPerFile", rows) if rows else writer
    writer = writer.option("parquet.block.row.count.limit", group_rows) if group_rows else writer
    (writer.option("parquet.block.size", block_bytes) if block_bytes else writer).parquet(path)


def write_csv(df: DataFrame, path: str, add: bool = False) -> None:
    """With a header; `add` keeps what is there, as a table that grows by each run's rows."""
    df.write.mode("append" if add else "overwrite").option("header", True).csv(path)


def footers(df: DataFrame) -> DataFrame:
    """file, rows and bytes of each file of a table, from Spark's own file metadata."""
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"), F.max("_metadata.file_size").alias("bytes"))


def row_groups(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """file, group, rows and bytes of each row group of a Parquet table, from the files' footers, read one after the other; with a column, its low and high as text."""
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for file in sorted(spark.read.parquet(path).inputFiles()):
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(file), conf))
        try:
            for i, block in enumerate(reader.getFooter().getBlocks()):
                held = [c.getStatistics() for c in block.getColumns() if c.getPath().toDotString() == column]
                ends = [held[0].minAsString(), held[0].maxAsString()] if held and held[0].hasNonNullValue() else [None, None]
                out.append((file, i, block.getRowCount(), block.getTotalByteSize(), *ends))
        finally:
            reader.close()
    return spark.createDataFrame(out, "file string, group int, rows long, bytes long, low string, high string")


def groups(df: DataFrame, rows: int, keep: Column | None = None) -> DataFrame:
    """file, group, rows and kept (rows that meet `keep`) of each run of `rows` rows of a file, as its row groups are if they have so many."""
    group = F.floor(F.col("_metadata.row_index") / rows).alias("group")
    return df.groupBy(F.col("_metadata.file_path").alias("file"), group).agg(F.count("*").alias("rows"), F.count_if(F.lit(True) if keep is None else keep).alias("kept"))


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the checkpoint folder. Only a local session that names none, as in tests, gets a temporary one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        own = spark.conf.get("spark.checkpoint.dir", None)
        if not own:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            own = tempfile.mkdtemp(prefix="codesieve")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(own)
    return context.getCheckpointDir()


def clean(spark: SparkSession, *patterns: str) -> list[str]:
    """Delete what matches the glob patterns, on any file system that Spark reads; the paths that went."""
    gone, conf = [], spark._jsc.hadoopConfiguration()
    for pattern in patterns:
        path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        files = path.getFileSystem(conf)
        for found in files.globStatus(path) or []:
            files.delete(found.getPath(), True)
            gone.append(found.getPath().toString())
    return gone


def session_settings(spark: SparkSession, **settings: str) -> dict[str, str | None]:
    """Set session options (dots as two underscores in their names) and return what they were; None restores the default."""
    before = {}
    for name, value in settings.items():
        option = name.replace("__", ".")
        before[name] = spark.conf.get(option, None)
        if value is None:
            spark.conf.unset(option)
        else:
            spark.conf.set(option, value)
    return before


def save_boundaries(spark: SparkSession, codes: Codes, path: str) -> None:
    spark.createDataFrame([(codes.column, codes.bits, codes.suffix, list(codes.boundaries))], "column string, bits int, suffix boolean, boundaries array<string>").coalesce(1).write.mode("overwrite").parquet(path)


def radix_boundaries(column: str, bits: int, suffix: bool = False) -> Codes:
    """Boundaries at equal steps of the keys' leading bits: codes without a look at the rows."""
    return Codes(column, bits, suffix, tuple(f"{i << (64 - bits):016X}" for i in range(1 << bits)))


def load_boundaries(spark: SparkSession, path: str, fallback: Codes | None = None) -> Codes:
    """Boundaries as saved. If there are none, the fallback (see radix_boundaries); without one that is an error."""
    if fallback and not exists(spark, path):
        return fallback
    row = read_table(spark, path, hint="build the code column first").first()
    return Codes(row["column"], row["bits"], row["suffix"], tuple(row["boundaries"]))


def save_features(spark: SparkSession, features: Features, path: str) -> None:
    spark.createDataFrame([(features.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_features(spark: SparkSession, path: str) -> Features:
    return Features.from_json("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))  # one small file
