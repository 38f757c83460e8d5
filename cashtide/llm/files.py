"""Files of own formats in the shared folder, written and range-read by tasks."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


@contextmanager
def new_file(uri: str):
    """A stream whose file appears under its name only when complete.

    Every attempt of a task writes under a name of its own, so a repeated task replaces a
    file by an equal one and a failed one leaves nothing under the final name.
    """
    system, path = _place(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    attempt = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
    with system.open_output_stream(attempt) as stream:
        yield stream
    system.move(attempt, path)


@contextmanager
def open_range(uri: str):
    """A file for reads at any offset; nothing else of it is fetched."""
    system, path = _place(uri)
    with system.open_input_file(path) as file:
        yield file


def mapped(uri: str) -> pa.Buffer:
    """The bytes of a file: mapped where the folder is part of the file system, else read."""
    system, path = _place(uri)
    if isinstance(system, fs.LocalFileSystem):
        with pa.memory_map(path) as file:
            return file.read_buffer()
    with system.open_input_file(path) as file:
        return file.read_buffer()


def listed(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """``path`` and ``length`` of the files of a folder; their content is not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return found.select(F.col("path"), F.col("length"))
