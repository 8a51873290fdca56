"""Names that only one writer can take: small JSON entries created where none exists yet."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def claim(spark: SparkSession, path: str, entry: dict) -> bool:
    """Create the file ``path`` with ``entry`` as one JSON line; False, and nothing written, when somebody else has.

    On a local file system a finished draft is linked to the name, which fails if the name is taken; elsewhere the
    Hadoop file system creates the file without the right to overwrite, which its name node or store decides.
    """
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    line = bytearray(json.dumps(entry).encode() + b"\n")
    fs.mkdirs(target.getParent())
    if fs.getUri().getScheme() == "file":
        files, place = jvm.java.nio.file.Files, jvm.java.io.File(target.toUri().getPath()).toPath()
        draft = place.resolveSibling(f".{uuid.uuid4().hex}.draft")
        files.write(draft, line, spark.sparkContext._gateway.new_array(jvm.java.nio.file.OpenOption, 0))
        try:
            files.createLink(place, draft)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception):
                return False
            raise
        finally:
            files.deleteIfExists(draft)
        return True
    try:
        out = fs.create(target, False)
    except Py4JJavaError as error:
        if "AlreadyExists" in str(error.java_exception):
            return False
        raise
    out.write(line)
    out.close()
    return True


def entries(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All entries claimed in ``folder``; none when the folder does not exist."""
    try:
        return spark.read.schema(schema).json(folder)
    except Exception as error:  # nothing claimed yet
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise
