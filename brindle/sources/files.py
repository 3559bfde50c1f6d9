"""Files as documents, and documents as files."""

from __future__ import annotations

import os
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import file_extension
from brindle.schema import DOCUMENT

# Texts that stand for a content that cannot be read.
PDF_PLACEHOLDER = "[Error extracting PDF content: {}]"
WORD_PLACEHOLDER = "[Word documents (.doc/.docx) are not yet supported. Please convert to .txt or .pdf]"
OTHER_PLACEHOLDER = "[Unable to read file content]"


def _pdf_text(extract: Callable[[bytes], list[str]] | None) -> Column:
    """Pages of a PDF joined by line ends, by a given extractor or pypdf if there is one."""

    @F.pandas_udf("string")
    def run(contents: pd.Series) -> pd.Series:
        def one(data: bytes) -> str:
            try:
                if extract is not None:
                    return "\n".join(extract(data))
                import io

                from pypdf import PdfReader

                return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages)
            except Exception as e:
                return PDF_PLACEHOLDER.format(e)

        return contents.map(one)

    return run(F.col("content"))


def read_files(spark: SparkSession, path: str, pdf_extractor: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """One document per file under ``path``: text and Markdown as they are, PDF by an extractor, others as text or a placeholder.

    The id is a hash of the path, the date the file's time, the title the name without its ending.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    files = raw.withColumn("file_name", F.url_decode(F.regexp_replace(name, r"\+", "%2B"))).withColumn("_ext", file_extension(F.col("file_name")))
    text = F.col("content").cast("string")
    plain = files.where(~F.col("_ext").isin("pdf", "doc", "docx")).withColumn("_text", F.when(F.is_valid_utf8(text), text).otherwise(OTHER_PLACEHOLDER))
    word = files.where(F.col("_ext").isin("doc", "docx")).withColumn("_text", F.lit(WORD_PLACEHOLDER))
    pdf = files.where(F.col("_ext") == "pdf").withColumn("_text", _pdf_text(pdf_extractor))
    both = plain.unionByName(word).unionByName(pdf)
    stem = F.regexp_replace("file_name", r"(?<=.)\.[^.]*$", "")
    return both.select(
        F.xxhash64("path").alias("doc_id"), stem.alias("title"), F.col("_text").alias("content"), F.col("modificationTime").alias("date_added"),
        F.lit(False).alias("is_indexed"), "file_name", F.col("path").alias("file_path"), F.col("length").alias("file_size"),
    )


def from_contents(rows: DataFrame) -> DataFrame:
    """Documents from (doc_id, title, content, date_added [, file_name]): a blank title becomes the file name's stem; rows without content and file are refused."""
    if "file_name" not in rows.columns:
        rows = rows.withColumn("file_name", F.lit(None).cast("string"))
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.regexp_replace("file_name", r"(?<=.)\.[^.]*$", ""), F.lit(""))
    kept = rows.where((F.trim(F.coalesce("content", F.lit(""))) != "") | F.col("file_name").isNotNull())
    return kept.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), title.alias("title"), F.coalesce("content", F.lit("")).alias("content"), "date_added", F.lit(False).alias("is_indexed"),
        "file_name", F.lit(None).cast("string").alias("file_path"), F.octet_length(F.coalesce("content", F.lit(""))).cast("bigint").alias("file_size"),
    )


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """The document table from JSON with the schema of a document; names are matched whatever their case."""
    return spark.read.schema(DOCUMENT).option("multiLine", "true").json(path)


def write_json(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path)


def write_table(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_texts(docs: DataFrame, folder: str) -> DataFrame:
    """Contents as files ``{doc_id}{ext}`` in a folder that all executors see, the extension being that of the file name; (doc_id, file_path, file_size).

    The tasks write their own documents, each under a temporary name first, so that a task that runs again leaves whole files. The files are
    written when the result is evaluated.
    """

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            ids, paths, sizes = [], [], []
            for doc_id, name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path = os.path.join(folder, f"{doc_id}{os.path.splitext(os.path.basename(name or ''))[1]}")
                data = (content or "").encode()
                part = f"{path}.{os.getpid()}.part"
                with open(part, "wb") as out:
                    out.write(data)
                os.replace(part, path)
                ids.append(doc_id)
                paths.append(path)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["doc_id", "file_path", "file_size"])

    return docs.select("doc_id", "file_name", "content").mapInArrow(run, "doc_id bigint, file_path string, file_size bigint")


def file_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, by the file system of the path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place))


def delete_file(spark: SparkSession, path: str) -> None:
    """Delete a file if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, False)
