"""Helpers of the operators: reading rows, cutting lineage, files in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens.session import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): rows with an id, NULL texts as empty ones."""
    key, text = df[f"`{id_col}`"], df[f"`{text_col}`"]
    return df.where(key.isNotNull()).select(
        key.cast("bigint").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")
    )


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder, as a URI."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: evaluated once, columns still prunable."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def filesystem(uri: str):
    """The file system of a folder in the shared folder, and the path there, for use in tasks."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put_file(folder: str, name: str, data: bytes) -> str:
    """Write a file whole: under a name of this attempt, then renamed, so a rerun task replaces it."""
    system, path = filesystem(folder)
    system.create_dir(path, recursive=True)
    attempt = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(attempt, compression=None) as out:
        out.write(data)
    system.move(attempt, f"{path}/{name}")
    return f"{folder}/{name}"
