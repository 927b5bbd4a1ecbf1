"""Arrays against numpy, and files there and back."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe import errors, sources
from loomframe.operators import ndarray as nd
from loomframe.operators.frame import Frame
from loomframe.operators.ndarray import NDArray
from loomframe.streaming import resample_stream


@pytest.fixture(scope="module")
def m(spark):
    return NDArray.of(spark, [[0.0, 1.0, 2.0], [3.0, 4.0, 5.0]])


def same(a, b):
    np.testing.assert_allclose(np.array(a.tolist() if isinstance(a, NDArray) else a, dtype=float), np.array(b, dtype=float))


M = np.arange(6.0).reshape(2, 3)


def test_making(spark):
    same(NDArray.arange(spark, 0, 10, 2), np.arange(0, 10, 2))
    same(NDArray.linspace(spark, 0, 1, 5), np.linspace(0, 1, 5))
    same(NDArray.logspace(spark, 0, 2, 3), np.logspace(0, 2, 3))
    same(NDArray.eye(spark, 3), np.eye(3))
    same(NDArray.of(spark, [1.0, 2.0]).diag(), np.diag([1, 2]))
    assert NDArray.rand(spark, (2, 3), 1).shape == (2, 3) and NDArray.zeros(spark, (2, 2)).tolist() == [[0.0, 0.0], [0.0, 0.0]]
    assert all(2 <= v < 5 for v in NDArray.randint(spark, 2, 5, (20,)).flat())
    with pytest.raises(errors.ShapeMismatch):
        NDArray.of(spark, [[1], [1, 2]])


def test_shapes(spark, m):
    same(m.T, M.T)
    same(m.reshape(3, -1), M.reshape(3, -1))
    same(m.expand_dims(1).squeeze(), M)
    same(nd.concatenate([m, m], 1), np.concatenate([M, M], 1))
    same(nd.stack([m, m], 1), np.stack([M, M], 1))
    same(nd.vstack([NDArray.of(spark, [1, 2]), NDArray.of(spark, [3, 4])]), [[1, 2], [3, 4]])
    same(nd.hstack([NDArray.of(spark, [1, 2]), NDArray.of(spark, [3, 4])]), [1, 2, 3, 4])
    same(NDArray.of(spark, list(range(24))).reshape(2, 3, 4).transpose(2, 0, 1), np.arange(24).reshape(2, 3, 4).transpose(2, 0, 1))
    with pytest.raises(errors.ShapeMismatch):
        m.reshape(4, 2)


def test_selecting(spark, m):
    assert m.item(1, -1) == 5.0
    same(m.slice(slice(None), slice(1, 3)), M[:, 1:3])
    same(m.slice(1), M[1])
    same(m.slice(slice(None), slice(None, None, 2)), M[:, ::2])
    same(m.take([1, -1, 0], axis=1), M[:, [1, -1, 0]])
    same(m.mask(m.gt(2.0)), M[M > 2])
    same(nd.where(m.gt(2.0), m, 0.0), np.where(M > 2, M, 0))
    assert m.set((0, 0), 9.0).item(0, 0) == 9.0
    with pytest.raises(errors.OutOfBounds):
        m.take([3], axis=1)


def test_arithmetic(spark, m):
    row, column = NDArray.of(spark, [10.0, 20.0, 30.0]), NDArray.of(spark, [[1.0], [2.0]])
    same(m + row, M + [10, 20, 30])
    same(m * column, M * [[1], [2]])
    same(m + 1.0, M + 1)
    same(column + row, np.array([[1.0], [2.0]]) + [10, 20, 30])
    with np.errstate(all="ignore"):
        same(m / m, M / M)
    ints = NDArray.of(spark, [1, 2, 3])
    assert (ints + ints).dtype == "int64" and (ints / 2).dtype == "float64" and (ints + 0.5).dtype == "float64"
    assert (NDArray.of(spark, [True, False]) + 1).tolist() == [2, 1]
    assert nd.broadcast_shape((5, 1), (6,)) == (5, 6)
    with pytest.raises(errors.BroadcastMismatch):
        m + NDArray.of(spark, [1.0, 2.0])
    with pytest.raises(errors.InvalidDType):
        NDArray.of(spark, ["a"]) + NDArray.of(spark, ["b"])


def test_functions(spark):
    x = np.array([-1.5, 0.5, 2.5, np.nan, np.inf])
    a = NDArray.of(spark, x.tolist())
    with np.errstate(all="ignore"):
        for name in ("abs", "sqrt", "exp", "log", "log2", "log10", "floor", "ceil", "isnan", "isinf", "isfinite"):
            same(a.ufunc(name), getattr(np, name)(x))
    same(a.ufunc("round"), np.round(x))
    same(a.ufunc("clip", 0, 2), np.clip(x, 0, 2))
    same(a.maximum(0.0), np.maximum(x, 0))
    same(a.minimum(0.0), np.minimum(x, 0))
    assert a.eq(a).tolist() == (x == x).tolist() and a.ne(0.5).tolist() == (x != 0.5).tolist()
    assert NDArray.of(spark, [-1, 2]).ufunc("abs").tolist() == [1, 2] and all(v != v for v in NDArray.of(spark, ["a"]).ufunc("sqrt").tolist())


def test_reductions(spark, m):
    for how in ("sum", "mean", "min", "max", "std", "var"):
        assert m.reduce(how) == pytest.approx(getattr(M, how)())
        for axis in (0, 1):
            same(m.reduce(how, axis), getattr(M, how)(axis=axis))
    same(m.reduce("var", 1, ddof=1), M.var(axis=1, ddof=1))
    assert m.reduce("var", ddof=6) != m.reduce("var", ddof=6)
    odd = NDArray.of(spark, [1.0, float("nan"), 3.0])
    assert odd.reduce("sum") != odd.reduce("sum") and odd.reduce("min") != odd.reduce("min")
    assert m.arg("max") == 5 and m.arg("min", 1).tolist() == [0, 0] and m.arg("max", 0).tolist() == [1, 1, 1]
    nan = float("nan")
    assert NDArray.of(spark, [nan, 1.0, 2.0]).arg("max") == 0 and NDArray.of(spark, [1.0, nan, 2.0, 0.5]).arg("max") == 2
    lines = NDArray.of(spark, [[nan, 1.0, 2.0], [3.0, nan, 1.0], [nan, nan, nan]])
    assert lines.arg("max", 1).tolist() == [0, 0, 0] and lines.arg("min", 1).tolist() == [0, 2, 0] and lines.arg("max", 0).tolist() == [0, 0, 0]
    assert m.gt(4.0).any() and not m.gt(4.0).all() and m.gt(1.0).count_true() == 4


def test_order(spark):
    x = np.array([3.0, 1.0, np.nan, 2.0, 1.0])
    a = NDArray.of(spark, x.tolist())
    same(a.sort(), np.sort(x))
    assert a.argsort().tolist() == np.argsort(x, kind="stable").tolist()
    same(NDArray.of(spark, [[3, 1, 2], [0, 5, 4]]).sort(), [[1, 2, 3], [0, 4, 5]])
    same(NDArray.of(spark, [3, 1, 3]).unique(), [1, 3])
    grid = NDArray.of(spark, [1.0, 2.0, 2.0, 5.0])
    for side in ("left", "right"):
        q = [0.0, 2.0, 3.0, 9.0]
        assert grid.searchsorted(NDArray.of(spark, q), side).tolist() == np.searchsorted([1, 2, 2, 5], q, side).tolist()
    assert a.isin([1.0, float("nan")]).tolist() == np.isin(x, [1.0]).tolist()


def test_products(spark, m):
    v = NDArray.of(spark, [1.0, 2.0, 3.0])
    assert v.dot(v) == 14.0
    same(m.dot(v), M @ [1, 2, 3])
    same(m.matmul(m.T), M @ M.T)
    assert m.matmul(m.T).trace() == pytest.approx(np.trace(M @ M.T))
    with pytest.raises(errors.ShapeMismatch):
        m.dot(m)
    assert m.astype("int").dtype == "int64" and m.astype("string").dtype == "string"


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('name;age;ok;d;x\nana;3;true;2024-01-02;1.5\nbob;NA;False;2024-02-03;2\n"q;u";7;true;;\nshort;1\n')
    f = sources.read_csv(spark, str(p), sep=";", parse_dates=["d"])
    assert f.dtypes == {"name": "string", "age": "int64", "ok": "bool", "d": "datetime64", "x": "float64"}
    assert f.rows()[2][:3] == ("q;u", 7, True) and f.rows()[3] == ("short", 1, None, None, None)
    assert sources.read_csv(spark, str(p), sep=";", usecols=["ok", "age"], nrows=2).columns == ["age", "ok"]
    assert sources.read_csv(spark, str(p), sep=";", header=False, infer=False).columns[0] == "column_0"
    assert sources.read_csv(spark, str(p), sep=";", na_values=["bob"], infer=False).rows()[1][:2] == (None, "NA")
    with pytest.raises(errors.ColumnNotFound):
        sources.read_csv(spark, str(p), sep=";", usecols=["zz"])
    back = str(tmp_path / "out")
    sources.write_csv(f, back, single=True)
    assert sources.read_csv(spark, back, parse_dates=["d"]).rows() == f.rows()
    mixed = tmp_path / "b.csv"
    mixed.write_text("a,b\n1,x\ntrue,\n")
    assert sources.read_csv(spark, str(mixed)).dtypes == {"a": "string", "b": "string"}


def test_json(spark, tmp_path):
    f = Frame.from_rows(spark, [(1, "x", 1.5), (2, None, None)], "a long, b string, c double")
    for orient in ("records", "split", "columns", "values"):
        path = str(tmp_path / orient)
        sources.write_json(f, path, orient, indent=2)
        got = sources.read_json(spark, path, orient)
        assert got.rows() == f.rows(), orient
        assert got.columns == (["column_0", "column_1", "column_2"] if orient == "values" else ["a", "b", "c"])
    with pytest.raises(errors.NotSupported):
        sources.read_json(spark, "x", "table")
    lines = tmp_path / "l.ndjson"
    lines.write_text('{"b": 1.0, "a": "x"}\n\n{"b": 2.0}\n')
    assert sources.read_ndjson(spark, str(lines)).rows() == [("x", 1), (None, 2)]
    sources.write_ndjson(f, str(tmp_path / "nd"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "nd").glob("part-*")))
    assert [json.loads(x) for x in text.splitlines()] == [{"a": 1, "b": "x", "c": 1.5}, {"a": 2, "b": None, "c": None}]
    bad = tmp_path / "bad.ndjson"
    bad.write_text('{"a": 1}\n{oops\n')
    with pytest.raises(Exception):  # noqa: B017
        sources.read_ndjson(spark, str(bad)).rows()


def test_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    out = resample_stream(stream, "ts", "D", "1 hour", {"n": F.count(F.lit(1))})
    q = out.writeStream.format("memory").queryName("days").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from days").first()[0] == events.count()


def test_vectors_are_cut_by_cells_not_by_vectors(spark, monkeypatch):
    from loomframe.plans import order

    monkeypatch.setattr(order, "BLOCK", 40)
    df = spark.createDataFrame([(i, [float(i), float(i * i % 7), 0.5, -float(i)]) for i in range(39)], "id long, e array<float>")
    a = NDArray.from_vectors(df, "id", "e", 4)
    assert "SinglePartition" not in a.gt(0.0).logical_and(a.lt(3.0)).df._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    want = np.array([r.e for r in df.orderBy("id").collect()])
    same(a, want)
    same(a.sub(a.reduce("mean", axis=0)), want - want.mean(axis=0))
    same(nd.where(a.gt(0.0), a, 0.5), np.where(want > 0, want, 0.5))
    same(a.T.matmul(a), want.T @ want)
