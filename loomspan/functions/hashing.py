"""Content hashes: keys for look-ups, and digests that equal those of a pickled Python value.

``content_key`` is a deterministic key over columns: the digest of a text that tells all values of
a type apart, whatever the session's time zone, and doesn't depend on the order of a map. The ``exact_*`` expressions build, in
Catalyst, the byte stream that Python's pickle protocol 3 writes for a value and hash it, so a
digest made by Spark equals one made in Python for the same string, bytes, integer, boolean or
null. For floats and vectors an Arrow function lays out their bytes, a batch at a time; the digest is
Catalyst's too. Other containers are hashed in Python by ``value_digest``.
"""

from __future__ import annotations

import hashlib
import struct
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALGORITHMS = ("md5", "sha1")


def _digest(data: Column, algorithm: str) -> Column:
    if algorithm not in ALGORITHMS:
        raise ValueError(f"hash algorithm must be one of {ALGORITHMS}, not {algorithm!r}")
    return F.md5(data) if algorithm == "md5" else F.sha1(data)


def canonical(value: Column, kind: T.DataType) -> Column:
    """Text that two values of a type share only if they are equal; every part says where it ends.

    Instants count in microseconds since 1970, doubles by their shortest digits (so 0.0 and -0.0
    differ, NaN equals NaN), maps by their sorted entries. TypeError for types without such a text.
    """
    none = F.lit("N;")
    if isinstance(kind, T.NullType):
        return none
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        out = F.concat(F.lit("S"), F.octet_length(value).cast("string"), F.lit(":"), value)
    elif isinstance(kind, T.BinaryType):
        out = F.concat(F.lit("B"), F.hex(value), F.lit(";"))
    elif isinstance(kind, T.ArrayType):
        each = F.transform(value, lambda x: canonical(x, kind.elementType))
        out = F.concat(F.lit("["), F.array_join(each, ""), F.lit("]"))
    elif isinstance(kind, T.MapType):
        each = F.transform(F.map_entries(value), lambda x: F.concat(canonical(x["key"], kind.keyType), canonical(x["value"], kind.valueType)))
        out = F.concat(F.lit("{"), F.array_join(F.array_sort(each), ""), F.lit("}"))
    elif isinstance(kind, T.StructType):
        out = F.concat(F.lit("("), *(canonical(value[f.name] if "." not in f.name else value.getField(f"`{f.name}`"), f.dataType) for f in kind.fields), F.lit(")"))
    elif isinstance(kind, T.TimestampType):
        out = F.concat(F.lit("U"), F.unix_micros(value).cast("string"), F.lit(";"))
    elif isinstance(kind, T.DateType):
        out = F.concat(F.lit("A"), F.unix_date(value).cast("string"), F.lit(";"))
    elif isinstance(kind, (T.NumericType, T.BooleanType, T.TimestampNTZType, T.DayTimeIntervalType, T.YearMonthIntervalType)):
        sign = "W" if isinstance(kind, T.TimestampNTZType) else "D" if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else "I"
        out = F.concat(F.lit(sign), value.cast("string"), F.lit(";"))
    else:
        raise TypeError(f"no key for values of type {kind.simpleString()}")
    return F.coalesce(out, none)


def content_key(schema: T.StructType, *names: str, ignore: tuple[str, ...] = (), algorithm: str = "md5") -> Column:
    """Key over named columns of a table; nulls count, so (a, null, b) differs from (a, b)."""
    kinds = {f.name: f.dataType for f in schema.fields}
    return _digest(F.concat(F.lit(""), *(canonical(F.col(f"`{c}`"), kinds[c]) for c in names if c not in ignore)).cast("binary"), algorithm)


def _hex(text: str) -> Column:
    return F.unhex(F.lit(text))


def _little_endian(value: Column, n: int) -> Column:
    """The low ``n`` bytes of a long, least first."""
    digits = F.lpad(F.hex(value.cast("long")), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, 15 - 2 * k, 2) for k in range(n))))


def _stream(payload: Column) -> Column:
    return F.concat(_hex("8003"), payload, _hex("2E"))


def exact_str(col: Column, algorithm: str = "md5") -> Column:
    data = F.encode(col, "UTF-8")
    return _digest(_stream(F.concat(_hex("58"), _little_endian(F.octet_length(col), 4), data)), algorithm)


def exact_bytes(col: Column, algorithm: str = "md5") -> Column:
    n = F.octet_length(col)
    head = F.when(n < 256, F.concat(_hex("43"), _little_endian(n, 1))).otherwise(F.concat(_hex("42"), _little_endian(n, 4)))
    return _digest(_stream(F.concat(head, col)), algorithm)


def exact_int(col: Column, algorithm: str = "md5") -> Column:
    """Any long: one or two unsigned bytes, a signed 32-bit number, or the fewest bytes that hold it."""
    v = col.cast("long")
    payload = (
        F.when(v.between(0, 255), F.concat(_hex("4B"), _little_endian(v, 1)))
        .when(v.between(256, 65535), F.concat(_hex("4D"), _little_endian(v, 2)))
        .when(v.between(-(2**31), 2**31 - 1), F.concat(_hex("4A"), _little_endian(v, 4)))
    )
    for n in (5, 6, 7):
        payload = payload.when(v.between(-(2 ** (8 * n - 1)), 2 ** (8 * n - 1) - 1), F.concat(_hex(f"8A{n:02X}"), _little_endian(v, n)))
    return _digest(_stream(payload.otherwise(F.concat(_hex("8A08"), _little_endian(v, 8)))), algorithm)


def exact_bool(col: Column, algorithm: str = "md5") -> Column:
    return _digest(_stream(F.when(col.isNull(), _hex("4E")).when(col, _hex("88")).otherwise(_hex("89"))), algorithm)


class _Writer:
    """The protocol-3 stream of a value: strings and bytes never refer back, dictionaries are sorted, sets are too."""

    def __init__(self) -> None:
        self.out: list[bytes] = []
        self.memo = 0

    def _remember(self) -> None:
        self.out.append(b"q" + bytes([self.memo]) if self.memo < 256 else b"r" + struct.pack("<I", self.memo))
        self.memo += 1

    def put(self, x: object) -> None:
        if x is None:
            self.out.append(b"N")
        elif isinstance(x, (bool, np.bool_)):
            self.out.append(b"\x88" if x else b"\x89")
        elif isinstance(x, (int, np.integer)):
            self._int(int(x))
        elif isinstance(x, (float, np.floating)):
            self.out.append(b"G" + struct.pack(">d", x))
        elif isinstance(x, str):
            raw = x.encode("utf-8", "surrogatepass")
            self.out.append(b"X" + struct.pack("<I", len(raw)) + raw)
        elif isinstance(x, (bytes, bytearray)):
            self.out.append((b"C" + bytes([len(x)]) if len(x) < 256 else b"B" + struct.pack("<I", len(x))) + bytes(x))
        elif isinstance(x, tuple):
            self._tuple(x)
        elif isinstance(x, dict):
            self.out.append(b"}")
            self._remember()
            self._grouped(_ordered(x.items()), b"s", b"u")
        elif isinstance(x, (set, frozenset)):
            # not the stream of a set, whose order isn't defined: a tag and its sorted members
            self.out.append(b"\x8f")
            self.put(list(_ordered(x)))
        elif isinstance(x, np.ndarray):
            self.out.append(b"\x93")
            self.put((str(x.dtype), list(x.shape), "C" if x.flags.c_contiguous else "F", x.tobytes("A")))
        elif isinstance(x, Decimal):
            self.out.append(b"\x94")
            self.put(str(x))
        elif isinstance(x, list):
            self.out.append(b"]")
            self._remember()
            self._grouped([(i,) for i in x], b"a", b"e")
        else:
            raise TypeError(f"no stream for a value of type {type(x).__name__}")

    def _grouped(self, items: list[tuple], one: bytes, many: bytes) -> None:
        for at in range(0, len(items), 1000):
            some = items[at : at + 1000]
            if len(some) > 1:
                self.out.append(b"(")
            for item in some:
                for part in item:
                    self.put(part)
            self.out.append(many if len(some) > 1 else one)

    def _tuple(self, x: tuple) -> None:
        if not x:
            self.out.append(b")")
            return
        if len(x) > 3:
            self.out.append(b"(")
        for part in x:
            self.put(part)
        self.out.append((b"", b"\x85", b"\x86", b"\x87")[len(x)] if len(x) <= 3 else b"t")
        self._remember()

    def _int(self, x: int) -> None:
        if 0 <= x < 256:
            self.out.append(b"K" + bytes([x]))
        elif 0 <= x < 65536:
            self.out.append(b"M" + struct.pack("<H", x))
        elif -(2**31) <= x < 2**31:
            self.out.append(b"J" + struct.pack("<i", x))
        else:
            n = (x if x >= 0 else ~x).bit_length() // 8 + 1
            self.out.append((b"\x8a" + bytes([n]) if n < 256 else b"\x8b" + struct.pack("<i", n)) + x.to_bytes(n, "little", signed=True))


def _ordered(items) -> list:
    """Sorted; members that can't be compared go by their digests."""
    items = list(items)
    try:
        return sorted(items)
    except Exception:  # noqa: BLE001 - any failure to compare, NaN decimals included
        return sorted(items, key=value_digest)


def value_digest(value: object, algorithm: str = "md5") -> str:
    """Digest of a Python value; raises TypeError for what has no stream."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"hash algorithm must be one of {ALGORITHMS}, not {algorithm!r}")
    w = _Writer()
    w.put(value)
    return hashlib.new(algorithm, b"\x80\x03" + b"".join(w.out) + b".").hexdigest()


@F.arrow_udf(T.BinaryType())
def _float_stream(values: pa.Array) -> pa.Array:
    """The pickled stream of each double: marks, eight bytes, greatest first, and the end."""
    raw = np.empty((len(values), 12), np.uint8)
    raw[:, :3], raw[:, 11] = (0x80, 0x03, 0x47), 0x2E
    raw[:, 3:11] = np.frombuffer(values.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False).astype(">f8").tobytes(), np.uint8).reshape(-1, 8)
    flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(12), len(values), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())
    return pc.if_else(values.is_valid(), flat, pa.scalar(None, pa.binary()))


def exact_float(col: Column | str, algorithm: str = "md5") -> Column:
    return _digest(_float_stream(col), algorithm)


@F.arrow_udf(T.BinaryType())
def _vector_stream(values: pa.Array) -> pa.Array:
    """The stream of each array of numbers as a numpy array; null where a component is."""
    kind = values.type.value_type.to_pandas_dtype()
    name, width = str(np.dtype(kind)), np.dtype(kind).itemsize
    out: list[bytes | None] = []
    flat = values.values.fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
    holes, raw = np.cumsum(np.append(0, values.values.is_null().to_numpy(zero_copy_only=False))), memoryview(flat.tobytes())
    bounds = values.offsets.to_numpy().tolist()
    heads: dict[int, bytes] = {}
    for i, there in enumerate(values.is_valid().to_pylist()):
        a, b = bounds[i], bounds[i + 1]
        if not there or holes[b] > holes[a]:
            out.append(None)
            continue
        if b - a not in heads:
            w = _Writer()
            for part in (name, [b - a], "C"):
                w.put(part)
            n = width * (b - a)
            heads[b - a] = b"\x80\x03\x93(" + b"".join(w.out) + (b"C" + bytes([n]) if n < 256 else b"B" + struct.pack("<I", n))
        out.append(heads[b - a] + raw[width * a : width * b] + b"tq\x01.")
    return pa.array(out, pa.binary())


def exact_vector(col: Column | str, algorithm: str = "md5") -> Column:
    """Digest of an array column as a numpy array: type, shape, order and buffer; null if a component is null."""
    return _digest(_vector_stream(col), algorithm)


def set_key(items: Column, kind: T.DataType, algorithm: str = "md5") -> Column:
    """Key of an array's distinct members, of type ``kind``, whatever their order."""
    return _digest(F.array_join(F.array_sort(F.array_distinct(F.transform(items, lambda x: canonical(x, kind)))), "").cast("binary"), algorithm)


def map_key(entries: Column, kind: T.MapType, algorithm: str = "md5") -> Column:
    """Key of a map, whatever the order of its entries; null for a null map."""
    return F.when(entries.isNotNull(), _digest(canonical(entries, kind).cast("binary"), algorithm))
