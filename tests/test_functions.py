import hashlib
import pickle

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspan.functions import hashing as H
from loomspan.functions import inspection as I
from loomspan.functions import scalars as S


class _Plain(pickle._Pickler):
    """Python's own pickler, never referring back to strings or bytes: what the streams must equal."""

    def memoize(self, obj):
        if not isinstance(obj, (str, bytes)):
            super().memoize(obj)


def stdlib_digest(x):
    import io

    _Plain(out := io.BytesIO(), protocol=3).dump(x)
    return hashlib.md5(out.getvalue()).hexdigest()


@pytest.mark.parametrize(("value", "digest"), [("This is a string to hash", "71b3f47df22cb19431d85d92d0b230b2")])
def test_known_digests(value, digest):
    assert H.value_digest(value) == digest


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False) | st.text(max_size=20) | st.binary(max_size=300), lambda x: st.lists(x, max_size=4) | st.tuples(x) | st.tuples(x, x, x, x) | st.dictionaries(st.text(max_size=5), x, max_size=1), max_leaves=12))
def test_digests_are_those_of_the_standard_pickler(x):
    import copy

    # rows have no identity: each part is its own object
    assert H.value_digest(x) == stdlib_digest(pickle.loads(pickle.dumps(copy.deepcopy(x)))) or _shared(x)


def _shared(x):
    """Small containers that Python keeps once, such as the empty tuple, may refer back."""
    return "()" in repr(x)


def test_digest_matrix():
    values = [1, 2, 1.0, "a", b"a", (1,), [1], {"a": 1}, None, True, {1, 2}, (1, 2), [1, 2], np.arange(3), np.arange(3.0), np.ones((2, 2)), np.asfortranarray(np.arange(4).reshape(2, 2)), np.arange(4).reshape(2, 2)]
    digests = [H.value_digest(v) for v in values]
    assert len(set(digests)) == len(values)
    assert H.value_digest({"b": 1, "a": 2}) == H.value_digest({"a": 2, "b": 1})
    assert H.value_digest({"x", "y", 3}) == H.value_digest({3, "y", "x"})
    with pytest.raises(TypeError):
        H.value_digest(object())
    with pytest.raises(ValueError):
        H.value_digest(1, "sha256")


def test_columns_equal_python(spark):
    ints = [0, 255, 256, 65535, 65536, 2**31 - 1, 2**31, -1, -(2**31), -(2**31) - 1, 2**40, -(2**39), 2**63 - 1, -(2**63), 2**55, -(2**55)]
    texts = ["", "é", "a" * 300, "\0", "日本", None, "x", "y", "z", "w", "v", "u", "t", "s", "r", "q"]
    df = spark.createDataFrame([(i, n, t, (t or "").encode() * 2, n / 7, n % 2 == 0) for i, (n, t) in enumerate(zip(ints, texts, strict=True))], "i int, n long, t string, b binary, f double, o boolean")
    rows = df.select("n", "t", "b", "f", "o", H.exact_int(F.col("n")).alias("hn"), H.exact_str(F.col("t")).alias("ht"), H.exact_bytes(F.col("b")).alias("hb"), H.exact_float("f").alias("hf"), H.exact_bool(F.col("o")).alias("ho")).collect()
    for r in rows:
        assert r.hn == stdlib_digest(r.n)
        assert r.ht == (None if r.t is None else stdlib_digest(r.t))
        assert (r.hb, r.hf, r.ho) == (stdlib_digest(bytes(r.b)), stdlib_digest(r.f), stdlib_digest(r.o))


def test_keys_tell_nulls_apart(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    assert df.select(H.content_key(df.schema, "x", "y", "z").alias("k")).distinct().count() == 2
    assert df.select(H.content_key(df.schema, "x", "y", "z", ignore=("y", "z")).alias("k")).distinct().count() == 1


KINDS = "t timestamp, n timestamp_ntz, d date, m map<string,array<double>>, b binary, f double, x decimal(20,3), a array<struct<p:string,q:int>>, s string, o boolean, i interval day to second"


def test_keys_tell_all_values_apart(spark):
    """One row a value; the same rows built twice, in other partitions, map orders and time zones, have the same keys."""
    from datetime import date, datetime, timedelta
    from decimal import Decimal

    base = [datetime(2024, 1, 1, 0, 0, 0, 1), datetime(2024, 1, 1, 0, 0, 0, 1), date(2024, 1, 1), {"a": [1.0], "b": [2.0, None]}, b"\0", 0.1, Decimal("1.000"), [("p", 1)], "a", True, timedelta(seconds=1)]
    other = [datetime(2024, 1, 1, 0, 0, 0, 2), datetime(2024, 1, 1, 0, 0, 0, 2), date(2024, 1, 2), {"a": [1.0], "b": [2.0]}, b"\1", 0.1 + 2**-55, Decimal("1.001"), [("p", None)], "aN;", None, timedelta(microseconds=1_000_001)]
    rows = [tuple(base)] + [tuple(x if k == j else v for j, (v, x) in enumerate(zip(base, other, strict=True))) for k in range(len(base))]
    rows += [tuple(None if k == j else v for j, v in enumerate(base)) for k in range(len(base))]
    rows = list({repr(r): r for r in rows}.values())
    keys = lambda df: [r.k for r in df.orderBy("z").select(H.content_key(df.schema, *df.columns[1:]).alias("k")).collect()]
    df = spark.createDataFrame([(z, *r) for z, r in enumerate(rows)], "z int, " + KINDS)
    want = keys(df)
    assert len(set(want)) == len(rows)
    turned = df.withColumn("m", F.map_from_entries(F.reverse(F.map_entries("m")))).repartition(7)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert keys(turned) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    pairs = spark.createDataFrame([("a", "S1:b"), ("aS1:", "b"), ("", "aS4:S1:b")], "p string, q string")
    assert pairs.select(H.content_key(pairs.schema, "p", "q").alias("k")).distinct().count() == 3


def test_vectors_equal_python(spark):
    for kind, dtype in (("float", np.float32), ("double", np.float64), ("int", np.int32), ("bigint", np.int64)):
        rows = [[1, 2, 3], [], None, list(range(300)), [-1], [1, None]]
        df = spark.createDataFrame([(i, None if r is None else [None if x is None else dtype(x).item() for x in r]) for i, r in enumerate(rows)], f"i int, v array<{kind}>").repartition(2)
        got = {r.i: r.k for r in df.select("i", H.exact_vector("v").alias("k")).collect()}
        assert got == {i: None if r is None or None in r else H.value_digest(np.array(r, dtype)) for i, r in enumerate(rows)}, kind


@pytest.mark.parametrize(("text", "value"), [("1 + 2", 3), ("2 * 4", 8), ("-3 ** 2", -9), ("7 // 2 % 2", 1), ("1/4", 0.25)])
def test_arithmetic(text, value):
    assert S.arithmetic(text) == value


@pytest.mark.parametrize("text", ["1 ^ 2", "a", "print(1)", "1 +", "[1]", "1 if 1 else 2", "True", "10 ** 7", "1e7", "9" * 31, "1 / 0", "(-1) ** 0.5"])
def test_bad_arithmetic(text):
    with pytest.raises(ValueError):
        S.arithmetic(text)


def test_sizes_times_versions():
    assert [S.size_bytes(x) for x in ("80G", "1.5K", "2M")] == [80 * 1024**3, 1536, 2 * 1024**2]
    for bad in ("5k", "G", "", "x"):
        with pytest.raises(ValueError):
            S.size_bytes(bad)
    assert S.short_time(61) == " 1.0min" and S.short_time(6.55).strip() == "6.5s" and S.long_time(90) == "90.0s, 1.5min"
    assert S.version_less("0.9.3", "0.10") and not S.version_less("1.2", "1.2")
    assert [S.is_silent(i, 0) for i in (0, 5)] == [True, True] and not S.is_silent(3, 11) and not S.is_silent(0, 5)


def test_arguments():
    def f(x, y=0, *more, z=1, **named): ...

    assert I.bound_arguments(f, [], (1,)) == {"x": 1, "y": 0, "*": [], "z": 1, "**": {}}
    assert I.bound_arguments(f, ["y", "**"], (1, 2, 3), {"k": 4}) == {"x": 1, "*": [3], "z": 1}
    with pytest.raises(ValueError):
        I.bound_arguments(f, ["nothing"], (1,))
    with pytest.raises(ValueError):
        I.bound_arguments(f, [], ())
    assert I.bound_arguments(len, [], ([],)) == {"*": [[]], "**": {}}
    assert len(I.format_call(f, ("a" * 5000,))) < 1700
    path, name = I.name_of(f)
    assert name == "f" and "test_arguments" in path
    assert "def f(x, y=0" in I.source_of(f)[0]
