"""File listings through the Hadoop file system, so any store Spark can read works."""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Callable
from urllib.parse import quote

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.sql import SparkSession

# Characters of a path that its URI form escapes.
_ESCAPED = re.compile(r'[\s"<>#%?\[\]\\^`{|}]')


def _statuses(spark: SparkSession, pattern: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.globStatus(path) or []


def glob_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths matching ``pattern``, sorted as text."""
    return sorted(s.getPath().toString() for s in _statuses(spark, pattern))


def uri_of(path: str) -> str:
    """A path as ``_metadata.file_path`` spells it: blanks and the like are escaped."""
    return _ESCAPED.sub(lambda m: quote(m.group()), path)


def subdirectories(spark: SparkSession, root: str) -> list[str]:
    """Names of the directories directly below ``root``, sorted; bookkeeping folders are left out."""
    names = [s.getPath().getName() for s in _statuses(spark, f"{root}/*") if s.isDirectory()]
    return sorted(n for n in names if not n.startswith(("_", ".")))


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified path and the path in it, for tasks and for many small files."""
    return fs.FileSystem.from_uri(path[5:] if path.startswith("file:/") and "://" not in path else path)


def put_whole(store: fs.FileSystem, path: str, data: pa.Buffer) -> None:
    """Create a file that is there with its whole content or not at all; one of that name is replaced.

    On the local file system it gets the check file that Hadoop keeps beside it (CRC-32 of every 512 bytes),
    so that Spark's readers notice damage.
    """
    folder, name = path.rsplit("/", 1)
    if store.type_name == "local":
        sums = [zlib.crc32(memoryview(data)[at : at + 512]) for at in range(0, data.size, 512)]
        with store.open_output_stream(f"{folder}/.{name}.crc") as out:
            out.write(b"crc\0" + struct.pack(f">i{len(sums)}I", 512, *sums))
    draft = f"{folder}/.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(data)
    store.move(draft, path)


def move_into(spark: SparkSession, staging: str, target: str, moved: Callable[[str], None] | None = None) -> list[str]:
    """Move the data files of a finished run into ``target`` and drop its folder; returns their names, sorted.

    Names must be unique. ``moved`` is told every name as soon as its file is in place. The driver does
    nothing but a rename a file (and its check file, on the local file system).
    """
    store, source = store_of(qualified(spark, staging))
    to = store_of(qualified(spark, target))[1]
    store.create_dir(to, recursive=True)
    found = {i.base_name for i in store.get_file_info(fs.FileSelector(source))}
    names = sorted(n for n in found if not n.startswith(("_", ".")))
    for name in names:
        if (check := f".{name}.crc") in found:
            store.move(f"{source}/{check}", f"{to}/{check}")
        store.move(f"{source}/{name}", f"{to}/{name}")
        if moved:
            moved(name)
    store.delete_dir(source)
    return names


def rename_file(spark: SparkSession, source: str, target: str) -> None:
    """Give a file another name, in a folder that may not exist yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    to = hadoop(target)
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(to.getParent())
    if not fs.rename(hadoop(source), to):
        raise OSError(f"cannot rename {source} to {target}")


def create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file with its whole content, or leave the one that is there; says whether it did.

    The content is written under another name first and then linked (local files) or renamed without
    overwriting, so nobody sees half a file. The file system must refuse to rename onto a file, as HDFS does.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    target = fs.makeQualified(target)
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    put_bytes(spark, draft.toString(), text.encode())
    try:
        if target.toUri().getScheme() == "file":
            at = jvm.java.nio.file.Paths.get
            jvm.java.nio.file.Files.createLink(at(target.toUri()), at(draft.toUri()))
        else:
            refuse = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            refuse[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(draft, target, refuse)
        return True
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        return False
    finally:
        fs.delete(draft, False)


def get_text(spark: SparkSession, path: str) -> str:
    """The content of a small file."""
    jvm = spark.sparkContext._jvm
    source = jvm.org.apache.hadoop.fs.Path(path)
    stream = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(source)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as listings spell it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(target, True)
    try:
        out.write(data)
    finally:
        out.close()
