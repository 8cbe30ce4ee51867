"""Writing and reading tables with codecs, by argument, by file name or by the first bytes.

Codecs that Spark has are options of its writers. Any other registered codec (lzma and xz here)
goes through a Python data source that writes JSON lines through the codec's file object. On
reading, the first bytes of each file tell the codec, whatever the name says.
"""

from __future__ import annotations

import bz2
import gzip
import io
import json
import lzma
import os
import sys
import uuid
import warnings
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Names by which the zlib codecs know their levels.
_LEVELS = ("NO_COMPRESSION", "BEST_SPEED", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "BEST_COMPRESSION")
NOT_COMPRESSED, COMPATIBLE = "not-compressed", "compat"
DEFAULT_LEVEL = 3


@dataclass(frozen=True)
class Codec:
    """``prefix`` begins its files, ``extension`` ends their names; ``opens`` wraps a binary file; ``spark`` is Spark's option, if any."""

    name: str
    prefix: bytes
    extension: str
    opens: Callable[..., object]
    spark: str | None = None


class _Zlib(io.RawIOBase):
    """zlib streams as a file object."""

    def __init__(self, file, mode: str, level: int = DEFAULT_LEVEL):
        self._file, self._writing = file, "w" in mode
        self._codec = zlib.compressobj(level) if self._writing else zlib.decompressobj()

    def readable(self):
        return not self._writing

    def writable(self):
        return self._writing

    def readinto(self, buffer):
        data = b""
        while not data:
            raw = self._codec.unconsumed_tail or self._file.read(1 << 16)
            data = self._codec.decompress(raw, len(buffer)) if raw else self._codec.flush()
            if not raw:
                break
        buffer[: len(data)] = data
        return len(data)

    def write(self, data):
        self._file.write(self._codec.compress(bytes(data)))
        return len(data)

    def close(self):
        if not self.closed and self._writing:
            self._file.write(self._codec.flush())
        super().close()


def _lzma(kind: int):
    return lambda f, mode, level=DEFAULT_LEVEL: lzma.LZMAFile(f, mode, format=kind, preset=level) if "w" in mode else lzma.LZMAFile(f, mode)


_CODECS: dict[str, Codec] = {
    c.name: c
    for c in (
        Codec("zlib", b"\x78", ".z", _Zlib, "deflate"),
        Codec("gzip", b"\x1f\x8b", ".gz", lambda f, mode, level=DEFAULT_LEVEL: gzip.GzipFile(fileobj=f, mode=mode, compresslevel=level), "gzip"),
        Codec("bz2", b"BZ", ".bz2", lambda f, mode, level=DEFAULT_LEVEL: bz2.BZ2File(f, mode, compresslevel=max(1, level)), "bzip2"),
        Codec("lzma", b"\x5d\x00", ".lzma", _lzma(lzma.FORMAT_ALONE)),
        Codec("xz", b"\xfd7zXZ", ".xz", _lzma(lzma.FORMAT_XZ)),
        Codec("lz4", b"\x04\x22\x4d\x18", ".lz4", None, "lz4"),
    )
}


def register_codec(name: str, codec: Codec, force: bool = False) -> None:
    if not isinstance(name, str):
        raise ValueError(f"a codec's name must be text, not {name!r}")
    if not isinstance(codec, Codec):
        raise ValueError(f"a codec must be a {Codec.__name__}, not {codec!r}")
    if name in _CODECS and not force:
        raise ValueError(f"there is a codec {name!r}; replace it with force=True")
    _CODECS[name] = codec


def parse_compress(compress: bool | int | str | tuple = 0, path: str | None = None) -> tuple[str | None, int]:
    """(codec or None, level) from an argument; a file name's extension decides where the argument names no codec."""
    if isinstance(compress, tuple):
        if len(compress) != 2:
            raise ValueError(f"compress must be (codec, level), not {compress!r}")
        name, level = compress
    elif isinstance(compress, str):
        name, level = compress, DEFAULT_LEVEL
    else:
        name, level = None, DEFAULT_LEVEL if compress is True else int(compress)
    if isinstance(level, bool) or not isinstance(level, int) or not 0 <= level <= 9:
        raise ValueError(f"a level is 0 to 9, not {level!r}")
    if name is None:
        by_name = next((c.name for c in _CODECS.values() if path and path.endswith(c.extension)), None)
        name = by_name or ("zlib" if level else None)
        if by_name and not level:
            level = DEFAULT_LEVEL
    elif name not in _CODECS:
        raise ValueError(f"no codec {name!r}; there are {sorted(_CODECS)}")
    return name, level


def codec_col(path: Column) -> Column:
    """Codec by a path's extension; null without."""
    out = F.lit(None).cast("string")
    for c in _CODECS.values():
        out = F.when(F.endswith(path, F.lit(c.extension)), c.name).otherwise(out)
    return out


def sniffed(head: Column) -> Column:
    """Codec by the first bytes, given as binary."""
    digits = F.hex(head)
    out = F.when(F.startswith(digits, F.lit("5A46")), COMPATIBLE)
    for c in _CODECS.values():
        out = out.when(F.startswith(digits, F.lit(c.prefix.hex().upper())), c.name)
    return out.otherwise(NOT_COMPRESSED)


#: The longest prefix that tells a codec.
HEAD_BYTES = 6


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(URI, length) of the data files below ``path``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, it = [], at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
    while it.hasNext():
        f = it.next()
        if not f.getPath().getName().startswith(("_", ".")):
            found.append((f.getPath().toString(), f.getLen()))
    return found


def detect_codec(spark: SparkSession, path: str) -> DataFrame:
    """path, codec and length of every data file below ``path``; only their first bytes are read."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            out = []
            for name in batch["path"].to_pylist():
                files, at = fs.FileSystem.from_uri(name if "://" in name else name.replace("file:/", "file:///", 1))
                with files.open_input_file(at) as f:
                    out.append(f.read(HEAD_BYTES))
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(out, pa.binary()), batch["length"]], ["path", "head", "length"])

    found = _files(spark, path)
    tasks = max(1, min(len(found), 4 * spark.sparkContext.defaultParallelism))
    files = spark.createDataFrame(found, "path string, length long").repartition(tasks)
    return files.mapInArrow(heads, "path string, head binary, length long").select("path", sniffed(F.col("head")).alias("codec"), "length")


def native_order(data: Column, width: int, byte_order: str) -> Column:
    """Bytes of numbers of ``width`` bytes in this machine's order; ``byte_order`` is "little" or "big", what they are in."""
    if byte_order == sys.byteorder or width == 1:
        return data
    digits = F.hex(data)
    numbers = F.sequence(F.lit(0), (F.octet_length(data) / width).cast("int") - 1)
    turned = F.transform(numbers, lambda k: F.concat(*(F.substr(digits, k * (2 * width) + (2 * j + 1), F.lit(2)) for j in reversed(range(width)))))
    return F.when(F.octet_length(data) > 0, F.unhex(F.array_join(turned, ""))).otherwise(data)


def dump(df: DataFrame, path: str, compress: bool | int | str | tuple = 0, mode: str = "error") -> list[str]:
    """Writes a table below ``path``; Parquet without a codec, JSON lines with one. Returns [path]."""
    if isinstance(df, str) or not isinstance(path, str):
        raise ValueError("dump takes the table first, then the path")
    name, level = parse_compress(compress, path)
    if name is None:
        df.write.mode(mode).parquet(path)
    elif _CODECS[name].spark:
        writer = df.write.mode(mode).option("compression", _CODECS[name].spark).option("ignoreNullFields", "false")
        # options of a writer reach the codecs' own configuration
        writer.option("zlib.compress.level", _LEVELS[level]).option("bzip2.compress.blocksize", max(1, level)).json(path)
    else:
        df.sparkSession.dataSource.register(CodecSource)
        df.write.format(CodecSource.name()).mode("append" if mode in ("error", "append") else mode).option("codec", name).option("level", level).option("path", path).save()
    return [path]


def load(spark: SparkSession, path: str, schema: str | T.StructType | None = None, cached: bool = False, mmap_mode: str | None = None, ensure_native_byte_order: bool | str = "auto") -> DataFrame:
    """A table written by ``dump``. The files' first bytes say how; JSON lines need a schema or are inferred.

    A torn or damaged file is an error, never null rows. Columns are always in this machine's byte
    order; tables aren't mapped into memory, so ``mmap_mode`` only warns.
    """
    if mmap_mode is not None and ensure_native_byte_order is True:
        raise ValueError("a mapped file can't be turned into this machine's byte order; ask for one of the two")
    if mmap_mode is not None:
        warnings.warn("tables aren't mapped into memory; they are read", stacklevel=2)
    kinds = [r.codec for r in detect_codec(spark, path).select("codec").distinct().limit(len(_CODECS) + 2).collect()]
    if not kinds:
        raise FileNotFoundError(f"no files below {path}")
    if len(kinds) > 1:
        raise ValueError(f"files of several codecs below {path}: {sorted(kinds)}")
    kind = kinds[0]
    if kind == COMPATIBLE:
        raise ValueError("files of this old format aren't read")
    if kind == NOT_COMPRESSED:
        df = spark.read.parquet(path)
    elif _CODECS[kind].spark:
        reader = spark.read.option("mode", "FAILFAST")
        df = (reader.schema(schema) if schema is not None else reader).json(path)
    else:
        if schema is None:
            raise ValueError(f"a schema is needed to read {kind}")
        spark.dataSource.register(CodecSource)
        df = spark.read.format(CodecSource.name()).schema(schema).option("codec", kind).option("path", path).load()
    return df.persist() if cached else df


class CodecSource(DataSource):
    """JSON lines through any registered codec, a file a task; options path, codec, level."""

    @classmethod
    def name(cls) -> str:
        return "loomspan_codec"

    def schema(self) -> str:
        raise ValueError("give a schema")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], _CODECS[self.options["codec"]], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], _CODECS[self.options["codec"]], int(self.options.get("level", DEFAULT_LEVEL)), schema, overwrite)


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))


class _Reader(DataSourceReader):
    def __init__(self, path: str, codec: Codec, schema: T.StructType):
        self.path, self.codec, self.kinds = path, codec, schema

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, root = _fs(self.path)
        return [InputPartition(f.path) for f in files.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and not f.base_name.startswith(("_", "."))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        files, _ = _fs(self.path)
        with files.open_input_file(partition.value) as raw, self.codec.opens(raw, "rb") as plain:
            for line in plain:
                row = json.loads(line)
                yield tuple(_typed(row.get(f.name), f.dataType) for f in self.kinds.fields)


def _typed(x: object, kind: T.DataType) -> object:
    from datetime import date, datetime
    from decimal import Decimal

    if x is None:
        return None
    if isinstance(kind, T.BinaryType):
        return bytes.fromhex(x)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return datetime.fromisoformat(x)
    if isinstance(kind, T.DateType):
        return date.fromisoformat(x)
    if isinstance(kind, T.DecimalType):
        return Decimal(x)
    if isinstance(kind, T.ArrayType):
        return [_typed(v, kind.elementType) for v in x]
    if isinstance(kind, T.StructType):
        return tuple(_typed(x.get(f.name), f.dataType) for f in kind.fields)
    return float(x) if isinstance(kind, (T.DoubleType, T.FloatType)) else x


class _Writer(DataSourceWriter):
    """Each task's file has a name of its own; only a committed job's files lose their leading underscore."""

    def __init__(self, path: str, codec: Codec, level: int, schema: T.StructType, overwrite: bool):
        self.path, self.codec, self.level, self.names, self.overwrite = path, codec, level, schema.names, overwrite

    def write(self, rows: Iterator) -> WriterCommitMessage:
        files, root = _fs(self.path)
        files.create_dir(root, recursive=True)
        own = f"{root}/_{uuid.uuid4().hex}{self.codec.extension}"

        def plain(x: object) -> object:
            if isinstance(x, bytes | bytearray):
                return bytes(x).hex()
            return x.asDict(True) if hasattr(x, "asDict") else x.isoformat() if hasattr(x, "isoformat") else str(x)

        with files.open_output_stream(own) as raw, self.codec.opens(raw, "wb", self.level) as out:
            for row in rows:
                out.write((json.dumps({k: row[k] for k in self.names}, default=plain) + "\n").encode())
        message = WriterCommitMessage()
        message.path = own
        return message

    def commit(self, messages) -> None:
        files, root = _fs(self.path)
        if self.overwrite:
            from pyarrow import fs

            for f in files.get_file_info(fs.FileSelector(root)):
                if f.is_file and not f.base_name.startswith("_"):
                    files.delete_file(f.path)
        for m in messages:
            if m is not None:
                head, _, name = m.path.rpartition("/")
                files.move(m.path, f"{head}/{name[1:]}")

    def abort(self, messages) -> None:
        files, _ = _fs(self.path)
        for m in messages:
            if m is not None:
                files.delete_file(m.path)
