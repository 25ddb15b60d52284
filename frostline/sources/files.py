"""Files as they come: row numbers that do not depend on how a file is split, manifests of files of any size, JSON artifacts with checked headers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from frostline.operators.blocks import fresh

#: Bytes of a file that are held at once while it is hashed.
CHUNK = 1 << 20
#: The fields of an artifact's header.
HEADER = ("schema_version", "config_hash", "input_hashes", "created_at_utc")


def with_row_numbers(scan: DataFrame, name: str = "row_index", source: str = "source_file") -> DataFrame:
    """A file scan with each row's number in its file, from 0, and the file's path: the same however files are split between tasks.

    scan must come straight from spark.read. Parquet files know their rows' numbers. Text files are gone through twice: a count for each split, and each row's place in
    its split plus the rows of the splits before it; a header line is no row. Splits are rows of a small table, one for about 128 MB of input.
    """
    path, start, place = fresh(scan, "path", "start", "place")
    meta = scan.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.file_block_start").alias(start))
    if _is_parquet(scan):
        return scan.select("*", F.col("_metadata.row_index").alias(name), F.col("_metadata.file_path").alias(source))
    rows = meta.withColumn(place, F.monotonically_increasing_id())
    splits = meta.withColumn(place, F.monotonically_increasing_id()).groupBy(path, start).agg(F.count("*").alias("n"), F.min(place).alias("first"))
    over = Window.partitionBy(path).orderBy(start)
    splits = splits.select(F.col(path).alias("p"), F.col(start).alias("s"), (F.sum("n").over(over) - F.col("n") - F.col("first")).alias("shift"))
    out = rows.join(F.broadcast(splits) if splits.limit(SPLITS + 1).count() <= SPLITS else splits, (rows[path] == splits["p"]) & (rows[start] == splits["s"]))
    return out.select(*[rows[f"`{c}`"] for c in scan.columns], (rows[place] + splits["shift"]).alias(name), rows[path].alias(source))


#: Splits of files that are broadcast.
SPLITS = 1 << 18


def _is_parquet(scan: DataFrame) -> bool:
    names = [f.name for f in scan.select("_metadata").schema["_metadata"].dataType.fields]
    return "row_index" in names


def local_file(path: str) -> BinaryIO:
    """Opens paths of the stores that pyarrow reaches: local and mounted folders, and those of its file systems."""
    from pyarrow import fs

    if path.startswith("file:") or path.startswith("/"):
        return fs.LocalFileSystem().open_input_stream("/" + path.removeprefix("file:").lstrip("/"))
    store, at = fs.FileSystem.from_uri(quote(path, safe="/:@"))
    return store.open_input_stream(unquote(at))


def input_manifest(spark: SparkSession, path: str, opener: Callable[[str], BinaryIO] = local_file, chunk: int = CHUNK) -> DataFrame:
    """(path, size, modified, sha256) of each file under path, in folders within it too.

    Spark lists the files without reading them; each is then opened by ``opener`` in a task and hashed chunk by chunk, so a file of any size takes one chunk of memory. Files are dealt
    out singly. Spark lists no files without bytes, so these have no row. A file that goes away meanwhile is an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name in batch["path"].to_pylist():
                digest = hashlib.sha256()
                with opener(name) as f:
                    while part := f.read(chunk):
                        digest.update(part)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "sha256"])

    shape = T.StructType([*files.schema.fields, T.StructField("sha256", T.StringType())])
    return files.repartition(F.col("path")).mapInArrow(run, shape)


def read_artifacts(spark: SparkSession, path: str, payload: T.StructType | str, schema_version: str | None = None, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sound, rejected) of JSON artifacts {"header": ..., "payload": ...}: whole files, or a line each.

    sound: (source_file, schema_version, config_hash, input_hashes, created_at_utc, payload). rejected: (source_file, reason, record). Reasons, the first that holds:
    not_json, missing_header, missing_<field> of the header, wrong_schema_version, missing_payload. Fields that the payload's schema lacks are left out; those it
    has and the text lacks are null. A text whose values do not fit the schema is not_json. Blank texts are no artifacts; an empty folder gives two empty tables.
    """
    header = T.StructType([T.StructField(c, T.MapType(T.StringType(), T.StringType()) if c == "input_hashes" else T.StringType()) for c in HEADER])
    shape = T.StructType([T.StructField("header", header), T.StructField("payload", T.StructType.fromDDL(payload) if isinstance(payload, str) else payload), T.StructField("_corrupt", T.StringType())])
    texts = spark.read.text(path, wholetext=not lines).select("value", F.col("_metadata.file_path").alias("source_file")).where(F.col("value").rlike(r"\S"))
    rows = texts.select("source_file", "value", F.from_json("value", shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("a"))
    checks = [F.when(F.col("a._corrupt").isNotNull(), "not_json"), F.when(F.col("a.header").isNull(), "missing_header")]
    checks += [F.when(F.col(f"a.header.{c}").isNull(), f"missing_{c}") for c in HEADER]
    if schema_version is not None:
        checks.append(F.when(F.col("a.header.schema_version") != schema_version, "wrong_schema_version"))
    checks.append(F.when(F.col("a.payload").isNull(), "missing_payload"))
    rows = rows.withColumn("reason", F.coalesce(*checks))
    return rows.where("reason IS NULL").select("source_file", "a.header.*", "a.payload"), rows.where("reason IS NOT NULL").select("source_file", "reason", F.col("value").alias("record"))


def read_optional(spark: SparkSession, path: str, schema: T.StructType | str, kind: str = "parquet") -> DataFrame:
    """The table at path, or an empty one with the schema where there is none. Any other failure is an error."""
    try:
        return spark.read.schema(schema).format(kind).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
