"""Readers and writers: parquet with projections and blocks, CSV with text kept as it is, JSON, whole texts, reports, stores."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DECISION_SCHEMA = "id string, source string, court string, esas_no string, karar_no string, karar_tarihi string, year int, text string, text_len int"
CHUNK_SCHEMA = (
    "decision_id string, source string, court string, esas_no string, karar_no string, karar_tarihi string, year int, chunk_index int, n_chunks int, header string, "
    "bolum string, text string, tokens int"
)
TEST_SCHEMA = "test_id string, kaynak string, karar_id string, kunye string, sorgu_tipi string, sorgu string, kanit string, ek_dogru_kararlar string"


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """A parquet table; only the columns asked for are read."""
    reader = spark.read.schema(schema) if schema else spark.read
    rows = reader.parquet(path)
    return rows.select(*columns) if columns else rows


def read_blocks(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Rows with dosya and blok, the file and the block of it that they come from."""
    rows = spark.read.parquet(path)
    meta = [F.col("_metadata.file_path").alias("dosya"), F.col("_metadata.file_block_start").alias("blok")]
    return rows.select(*(columns or rows.columns), *meta)


def block_statistics(spark: SparkSession, path: str, column: str) -> DataFrame:
    """dosya, blok, satir, en_buyuk: rows and greatest value of a column per block as the scan deals them out, an empty string
    where it has none. The values are read; row_groups() reads footers only."""
    return read_blocks(spark, path, [column]).groupBy("dosya", "blok").agg(F.count("*").alias("satir"), F.coalesce(F.max(column).cast("string"), F.lit("")).alias("en_buyuk"))


def row_groups(spark: SparkSession, path: str, column: str) -> DataFrame:
    """dosya, grup, satir, en_buyuk: rows and greatest value of a text column per row group, an empty string where the footer has none.

    Only footers are read, a file in a task; a file system that pyarrow doesn't know raises its error.
    """
    files = spark.createDataFrame([(f,) for f in sorted(spark.read.parquet(path).inputFiles())], "dosya string").repartition("dosya")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                meta = _parquet_file(name).metadata
                at = meta.schema.names.index(column)
                groups = [meta.row_group(g) for g in range(meta.num_row_groups)]
                stats = [g.column(at).statistics for g in groups]
                most = [str(s.max) if s is not None and s.has_min_max else "" for s in stats]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(groups)), pa.array(range(len(groups)), pa.int32()), pa.array([g.num_rows for g in groups], pa.int64()), pa.array(most)], ["dosya", "grup", "satir", "en_buyuk"])

    return files.mapInArrow(run, "dosya string, grup int, satir long, en_buyuk string")


def read_row_groups(groups: DataFrame, columns: list[str], schema: str) -> DataFrame:
    """Rows of chosen row groups (dosya, grup), only the columns asked for; each group in a task of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, group in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from _parquet_file(name).read_row_group(group, columns=columns).select(columns).to_batches()

    return groups.select("dosya", "grup").repartition("dosya", "grup").mapInArrow(run, schema)


def _parquet_file(name: str) -> pq.ParquetFile:
    system, inner = fs.FileSystem.from_uri(name)
    return pq.ParquetFile(inner, filesystem=system)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header, a byte order mark allowed, line breaks and doubled quotes inside fields; empty fields are empty
    strings, never null. Without a schema every column is text."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8")
    raw = reader.option("inferSchema", False).csv(path)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    if schema:
        kinds = {f.name: f.dataType for f in T._parse_datatype_string(schema).fields}
        raw = raw.select(*[F.col(f"`{c}`").cast(kinds.get(c, T.StringType())).alias(c) for c in raw.columns])
    return raw.na.fill("")


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a byte order mark and a header in each file; quotes are doubled, nulls are empty."""
    marked = rows.toDF("\ufeff" + rows.columns[0], *rows.columns[1:])
    marked.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON files that hold one object each."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files that hold an object per line."""
    return spark.read.schema(schema).json(path)


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object per line; letters stay as they are."""
    rows.write.mode("overwrite").json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """ad, metin: the name without its ending and the stripped text of each file."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), "^(.*?)(\\.[^.]*)?$", 1).alias("ad"), F.regexp_replace("value", "(?U)^\\s+|\\s+$", "").alias("metin"))


def write_texts(rows: DataFrame, path: str) -> None:
    """A text file for each row of (ad, metin) below the path, named by ad with .txt: for small sets, as of queries."""
    system = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(rows.sparkSession._jsc.hadoopConfiguration())
    for r in rows.select("ad", "metin").collect():
        out = system.create(rows.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/{r.ad}.txt"), True)
        out.write((r.metin or "").encode())
        out.close()


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A relation written out in code."""
    return spark.createDataFrame(rows, schema)


def write_table(rows: DataFrame, path: str, partition: str | None = None) -> None:
    """A parquet table in place of any earlier one."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class VectorStore:
    """Chunks with their vectors as one parquet table; replaced as a whole, counted, and read by the exact search."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def replace(self, rows: DataFrame) -> int:
        write_table(rows, self.path)
        return self.read().count()

    def read(self) -> DataFrame:
        if not exists(self.spark, self.path):
            raise FileNotFoundError(f"no collection at {self.path}; build the index first")
        return self.spark.read.parquet(self.path)


def before_after_report(pairs: DataFrame, summary: str, limit: int = 11) -> str:
    """Markdown of a few decisions before and after cleaning; pairs: id, year, once, sonra, yuzde, in the order wanted."""
    lines = ["# Temizleme: önce / sonra", "", "```", summary, "```", ""]
    for r in pairs.limit(limit).collect():
        lines += [f"## {r.id} ({r.year}) — %{r.yuzde:.1f} atıldı", "", "### Önce", "", "```text", r.once or "", "```", "", "### Sonra", "", "```text", r.sonra or "", "```", ""]
    return "\n".join(lines)


def info_json(info: DataFrame) -> str:
    """The one row of an index info as readable JSON."""
    return json.dumps(info.first().asDict(), ensure_ascii=False, indent=2, default=str)
