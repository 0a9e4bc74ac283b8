"""Readers with explicit schemas, and a file inventory. Paths may be on any Hadoop file system."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources import checksums as CS

# File suffixes; those of Hadoop's codecs.
SUFFIXES = {".jsonl": "jsonl", ".json": "json", ".csv": "csv", ".parquet": "parquet", ".pq": "parquet"}
PACKED = r"\.(gz|bz2|deflate|snappy|lz4|zst|zstd|lzo|lzo_deflate|xz|br|z)$"
BAD_RECORD = "_corrupt_record"


def detect_format(spark: SparkSession, path: str) -> str:
    """Format from the files of a folder or the suffix of a file; 'hub' when nothing is there."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return "hub"
    if fs.getFileStatus(p).isDirectory():
        for suffix, name in ((".jsonl", "jsonl"), (".json", "json"), (".parquet", "parquet"), (".csv", "csv")):
            if fs.globStatus(jvm.org.apache.hadoop.fs.Path(p, f"*{suffix}")):
                return name
    last = path.rstrip("/").rsplit("/", 1)[-1].lower()
    return next((v for k, v in SUFFIXES.items() if last.endswith(k)), "json")


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, keep_bad: bool = False, drop_bad: bool = False) -> DataFrame:
    """One object per line; blank lines are skipped. A broken line stops the read, or is kept as text, or dropped."""
    r = spark.read.option("mode", "PERMISSIVE" if keep_bad else "DROPMALFORMED" if drop_bad else "FAILFAST")
    if keep_bad:
        s = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        schema = T.StructType([*s.fields, T.StructField(BAD_RECORD, T.StringType())])
        r = r.option("columnNameOfCorruptRecord", BAD_RECORD)
    return r.schema(schema).json(path)


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Whole-file JSON: a list of objects, or an object of columns turned into rows."""
    s = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    columns = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in s.fields])
    text = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", T.ArrayType(s))
    cols = F.from_json("value", columns)
    zipped = F.arrays_zip(*[cols[f.name].alias(f.name) for f in s.fields]).cast(T.ArrayType(s))
    rows = F.when(F.ltrim("value").startswith("["), listed).otherwise(zipped)
    return text.select(F.inline(rows))


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=False)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stream_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, fmt: str = "jsonl", max_files: int = 100) -> DataFrame:
    if fmt != "jsonl":
        raise ValueError(f"Streaming not supported for format: {fmt}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)


def read_split(spark: SparkSession, path: str, split: str, fmt: str = "parquet", schema: str | None = None, streaming: bool = False) -> DataFrame:
    """One named split of a folder partitioned by `split`; other partitions are not listed for reading."""
    r = spark.readStream if streaming else spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.format(fmt).load(path).where(F.col("split") == split)


def load(spark: SparkSession, path: str, schema: str | T.StructType | None = None, fmt: str = "auto") -> DataFrame:
    fmt = detect_format(spark, path) if fmt == "auto" else fmt
    if fmt == "parquet":
        return read_parquet(spark, path)
    if fmt == "hub":
        raise FileNotFoundError(f"{path}: no such path, and hub downloads are not supported")
    if schema is None:
        raise ValueError(f"a schema is needed to read {fmt}")
    if fmt == "jsonl":  # loading by format goes on past broken lines; read_jsonl itself stops
        return read_jsonl(spark, path, schema, drop_bad=True)
    return {"json": read_json, "csv": read_csv}[fmt](spark, path, schema)


def object_inventory(spark: SparkSession, path: str, prefix: str = "", max_results: int | None = None, checksum: bool = True) -> DataFrame:
    """Name, size, modification time and md5 of the files below a path; side-car metadata is left out.
    Without a checksum the contents are not read. With it, files beyond `HASH_PART` are hashed in parts (those whose suffix
    names a codec excepted: Spark's splittable reader would unpack them)."""
    base = f"{path.rstrip('/')}/{prefix}".rstrip("/")
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    cols = [F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at")]
    r = r.where(~F.col("path").endswith(".meta.json"))
    if not checksum:
        out = r.select(*cols)
    else:
        # file metadata, unlike columns, keeps files from being read
        size, file = F.col("_metadata.file_size"), F.col("_metadata.file_path")
        large = (size > CS.HASH_PART) & ~F.lower(file).rlike(PACKED) & ~file.endswith(".meta.json")
        files = r.where(large).select(file.alias("file"), "length")
        longest, count = files.agg(F.max("length"), F.count(F.lit(1))).first()
        if not count or CS.openssl() is None:
            out = r.select(*cols, F.md5("content").alias("md5"))
        else:
            text = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(base).where(large)
            lines = text.select(file.alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("content"))
            sums = CS.large_md5(lines, files, longest, count)
            out = r.where(~large).select(*cols, F.md5("content").alias("md5"))
            out = out.unionByName(r.where(large).select(*cols, file.alias("file")).join(sums, "file").drop("file"))
    return out if max_results is None else out.orderBy("path").limit(max_results)
