"""Behaviour of frames and series on small inputs, with pandas as the yardstick where both agree."""

import datetime as dt

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from loomframe import errors
from loomframe.expr import col, len_, lit, where
from loomframe.expr.ast import Custom
from loomframe.expr.parser import parse
from loomframe.functions import categorical, dtypes
from loomframe.operators import frame
from loomframe.operators import index as labels
from loomframe.operators import merge as joins
from loomframe.operators import window
from loomframe.operators.concat import concat
from loomframe.operators.frame import Frame, Key
from loomframe.operators.groupby import group_count, group_size
from loomframe.operators.merge import join, merge
from loomframe.operators.resample import resample
from loomframe.operators.reshape import melt, pivot, pivot_table, stack, unstack
from loomframe.operators.series import Series
from loomframe.plans import order


@pytest.fixture(scope="module")
def people(spark):
    rows = [("AR", "Ana", 22, 800.0, "it"), ("AR", "Bob", 35, 1500.0, "hr"), ("UY", "Cid", 40, 2000.0, "it"), ("UY", "Dee", 28, 1200.0, "hr"), ("AR", "Eve", 31, 1100.0, "it")]
    return Frame.from_rows(spark, rows, ["country", "name", "age", "salary", "dept"])


@pytest.fixture(scope="module")
def gaps(spark):
    return Frame.from_rows(spark, [(1, "x", 1.5), (None, "y", 2.5), (3, "z", 3.5), (None, None, None)], "a long, b string, c double")


def test_rows_keep_their_order(people):
    assert people.head(2).rows()[1][1] == "Bob"
    assert [r[1] for r in people.tail(2).rows()] == ["Dee", "Eve"]
    assert [r[0] for r in people.sort_values("salary", False).select("name").rows()] == ["Cid", "Bob", "Dee", "Eve", "Ana"]
    assert [r[0] for r in people.sort_values("salary").head(3).tail(1).select("name").rows()] == ["Dee"]
    assert people.iloc_rows(-1, slice(0, 4, 2)).select("name").rows() == [("Eve",), ("Ana",), ("Cid",)]
    assert people.take([1, -1, 1]).select("name").rows() == [("Bob",), (None,), ("Bob",)]
    assert people.slice(1, 3).select("age").rows() == [(35,), (40,)]
    with pytest.raises(errors.OutOfBounds):
        people.slice(1, 9)
    with pytest.raises(errors.OutOfBounds):
        people.iloc_rows(7)
    with pytest.raises(errors.NotSupported):
        people.iloc_rows(slice(3, 0, -1))


def test_dropping_a_sort_key_keeps_the_order(people):
    assert people.sort_values("age").drop("age").select("name").rows() == [("Ana",), ("Dee",), ("Eve",), ("Bob",), ("Cid",)]
    f = Frame.of(people.df.select("name", "age"), "age").assign_value("age", 0)
    assert [r[0] for r in f.rows()] == ["Ana", "Dee", "Eve", "Bob", "Cid"]


def test_missing_values_sort_last_both_ways(gaps):
    assert [r[0] for r in gaps.sort_values("a").rows()] == [1, 3, None, None]
    assert [r[0] for r in gaps.sort_values("a", False).rows()] == [3, 1, None, None]
    assert [r[1] for r in gaps.sort_values("a", False).tail(2).rows()] == ["y", None]


def test_columns(people):
    assert people.columns == ["country", "name", "age", "salary", "dept"]
    assert people.dtypes["age"] == "int64" and people.dtypes["salary"] == "float64"
    assert people.drop("age").rename({"name": "n", "nothing": "x"}).columns == ["country", "n", "salary", "dept"]
    assert people.select_dtypes(include=["number"]).columns == ["age", "salary"]
    assert people.select_dtypes(exclude=["string"]).columns == ["age", "salary"]
    for bad in (lambda: people.col("nothing"), lambda: people.drop("nothing"), lambda: people.select("nothing")):
        with pytest.raises(errors.ColumnNotFound):
            bad()
    for bad in (lambda: people.rename({"age": "name"}), lambda: people.select("age", "age"), lambda: people.select_dtypes()):
        with pytest.raises(errors.InvalidOperation):
            bad()


def test_assigning(people):
    f = people.assign_expr("bonus", col("salary") * 0.1).assign_expr("old", col("age") > 30).assign_func("tag", lambda r: r["name"][0], "string")
    assert f.select("bonus", "old", "tag").rows()[1] == (150.0, True, "B")
    other = Frame.from_rows(people.df.sparkSession, [(i,) for i in range(5)], ["v"])
    assert people.assign("v", other.col("v")).select("v").rows() == [(i,) for i in range(5)]
    with pytest.raises(errors.LengthMismatch):
        people.assign("v", other.head(2).col("v"))


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("age > 30 and salary >= 1500", ["Bob", "Cid"]),
        ("dept in ['it'] or not (age < 30)", ["Ana", "Bob", "Cid", "Eve"]),
        ("age + salary * 2 > 3000", ["Bob", "Cid"]),
        ("(age + 1) * 2 = 46", ["Ana"]),
        ("country not in ('UY') and name.str.startswith('E')", ["Eve"]),
        ("-age < -35", ["Cid"]),
        ("age % 2 == 0 AND dept != 'hr'", ["Ana", "Cid"]),
        ("name == null", []),
        ("not name == null", ["Ana", "Bob", "Cid", "Dee", "Eve"]),
    ],
)
def test_queries(people, text, names):
    assert [r[0] for r in people.query(text).select("name").rows()] == names


@pytest.mark.parametrize("text", ["", "age >", "age + 1", "age > 1 > 2", "foo(age)", "age in 3", "age ** 2 > 1", "'a'", "age > 1 or", "name.str.upper('x')", "(age", "age > @x", "`age` > 1"])
def test_bad_queries_are_refused(people, text):
    with pytest.raises((errors.ParseError, errors.TypeMismatch)):
        people.query(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab ()[]=<>!+-*/%'\".,0123456789\\nornotandi", max_size=25))
def test_the_parser_refuses_or_reads(text):
    try:
        parse(text)
    except errors.ParseError:
        pass


def test_conditions_on_missing_values(gaps):
    assert len(gaps.query("a > 0")) == 2 and len(gaps.query("not a > 0")) == 0 and len(gaps.query("a != 1")) == 1
    assert gaps.assign_expr("p", col("a") > 0).select("p").rows() == [(True,), (False,), (True,), (False,)]
    assert len(gaps.where(col("a").isin([1, None]))) == 1 and len(gaps.where(~col("a").isin([1]))) == 1
    assert gaps.assign_expr("w", where(col("a") > 1, "big", "small")).select("w").rows() == [("small",), ("small",), ("big",), ("small",)]
    assert gaps.col("a").ne(1).values() == [False, False, True, False]
    with pytest.raises(errors.TypeMismatch):
        gaps.where(col("b") > 1)
    assert gaps.where(col("b") == 1).rows() == []


def test_expressions(people):
    f = people.assign_expr("x", len_(col("name")) + 1).assign_expr("y", (col("age") / 0).abs()).assign_expr("z", col("name") + "!").assign_expr("l", (col("age") * 0).log())
    assert f.select("x", "y", "z", "l").rows()[0] == (4, float("inf"), "Ana!", float("-inf"))
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    assert people.assign_expr("c", Custom(lambda s: F.lit(len(s)), T.LongType()) + lit(1)).select("c").rows()[0] == (6,)
    assert people.plan("age > 1") == "columnar" and people.plan("age > 'x'").startswith("error")
    assert "Scan" in people.plan()


def test_missing_value_operators(gaps):
    assert len(gaps.dropna()) == 2 and len(gaps.dropna("all")) == 3 and len(gaps.dropna(thresh=2)) == 3 and len(gaps.dropna(subset=["a"])) == 2
    assert gaps.dropna(axis=1, thresh=3).columns == ["b", "c"]
    assert gaps.fillna({"a": 0, "b": "?"}).rows()[3] == (0, "?", None)
    assert gaps.isna().rows()[3] == (True, True, True) and gaps.notna().rows()[0] == (True, True, True)
    assert gaps.hasna() and not gaps.dropna().hasna()
    with pytest.raises(errors.TypeMismatch):
        gaps.fillna({"a": "x"})


def test_duplicates(spark):
    f = Frame.from_rows(spark, [(1, "x"), (1, "x"), (2, None), (2, None), (1, "x")], ["a", "b"])
    assert sorted(f.duplicated().frame.select("__dup").rows()) == [(False,), (False,), (True,), (True,), (True,)]
    assert f.drop_duplicates().rows() == [(1, "x"), (2, None)]


def test_the_flat_names(people):
    from loomframe import api

    assert api.merge(people, people, on="name").columns == people.merge(people, on="name").columns
    assert people.iloc([0, -1], [1]).rows() == [("Ana",), ("Eve",)]
    assert people.select("age", "salary").rolling(2).sum().rows()[1] == (57.0, 2300.0)


def test_duplicates_under_a_descending_order(people):
    f = people.sort_values("age", False).drop_duplicates(["country"])
    assert f.select("name").rows() == [("Cid",), ("Bob",)]


def test_labels(people):
    f = people.set_index("age").select("name")
    assert f.loc_rows("40", "22").rows() == [("Cid",), ("Ana",)]
    assert f.loc_range("35", "28").rows() == [("Bob",), ("Cid",), ("Dee",)]
    with pytest.raises(errors.InvalidIndex):
        f.loc_rows("99")
    assert f.reindex(["40", "1"]).rows() == [("Cid",), (None,)]
    assert f.reset_index().columns == ["age", "name"] and f.reset_index().dtypes["age"] == "string"
    assert people.reset_index().columns[0] == "index"
    two = people.set_index("country", "dept")
    assert two.loc_tuple("AR", "it").select("name").rows() == [("Ana",), ("Eve",)]
    assert len(two.loc_tuple("UY")) == 2 and two.xs("hr", "dept").index == ("country",)
    assert two.swap_level().index == ("dept", "country") and two.drop_level(0).index == ("dept",)
    assert labels.levels(two) == [["AR", "UY"], ["hr", "it"]]
    assert labels.codes(two).rows()[1] == (0, 0)
    assert labels.positions(people.set_index("dept"), "hr") == [1, 3]
    with pytest.raises(errors.InvalidIndex):
        two.loc_tuple("ZZ", "it")


def test_monotonic_labels(spark):
    times = [dt.datetime(2024, 1, d) for d in (1, 2, 2, 5)]
    f = Frame.from_rows(spark, [(t, i) for i, t in enumerate(times)], ["t", "v"]).set_index("t")
    assert labels.is_monotonic_increasing(f) and labels.ends(f) == (times[0], times[-1])
    assert not labels.is_monotonic_increasing(f.sort_index(False))
    assert f.loc_range("2024-01-02", "2024-01-05").rows() == [(1,), (2,), (3,)]


def test_reductions(spark, gaps):
    s = Series.of(spark, [3.0, 1.0, 4.0, None, 5.0])
    p = pd.Series([3.0, 1.0, 4.0, None, 5.0])
    for how in ("sum", "mean", "median", "std", "var", "min", "max", "count", "nunique"):
        assert getattr(s, how)() == pytest.approx(getattr(p, how)()), how
    assert s.quantile(0.25) == p.quantile(0.25) and s.sum(skipna=False) is None
    assert Series.of(spark, [None, None], dtype="float64").sum() == 0.0
    with pytest.raises(errors.InvalidOperation):
        s.quantile(2)
    with pytest.raises(errors.TypeMismatch):
        gaps.col("b").sum()
    assert gaps.describe("c").rows()[0] == (3.0,)
    assert s.unique().rows() == [(3.0,), (1.0,), (4.0,), (None,), (5.0,)]
    assert Series.of(spark, ["b", "a", "b", None]).value_counts(dropna=False).rows() == [("b", 2), ("a", 1), ("<NA>", 1)]


def test_correlations(spark):
    rows = [(1.0, 2.0, 1.0), (2.0, None, 1.0), (3.0, 1.0, 1.0), (4.0, 7.0, 1.0)]
    f = Frame.from_rows(spark, rows, "a double, b double, c double")
    want = pd.DataFrame(rows, columns=["a", "b", "c"])
    for mine, theirs in ((f.corr(), want.corr()), (f.cov(), want.cov())):
        for got, w in zip(mine.rows(), theirs.values.tolist(), strict=True):
            assert [None if x != x else pytest.approx(x) for x in w] == list(got)


def test_series_windows(spark):
    values = [3.0, 1.0, None, 4.0, 1.0, 5.0, -2.0]
    s, p = Series.of(spark, values), pd.Series(values)
    clean = lambda x: [None if v != v else pytest.approx(v) for v in x.tolist()]
    for n in (2, -1):
        assert s.shift(n).values() == clean(p.shift(n))
    assert s.diff().values() == clean(p.diff())
    for how in ("cumsum", "cumprod", "cummin", "cummax"):
        assert getattr(s, how)().values() == clean(getattr(p, how)())
    for method in ("average", "min", "max", "first", "dense"):
        assert s.rank(method).values() == clean(p.rank(method=method)), method
        assert s.rank(method, ascending=False).values() == clean(p.rank(method=method, ascending=False)), method
    for how in ("sum", "mean", "min", "max", "std", "var", "median", "count"):
        assert s.rolling(3, min_periods=2).agg(how).col("value").values() == clean(getattr(p.rolling(3, min_periods=2), how)()), how
        assert s.expanding().agg(how).col("value").values() == clean(getattr(p.expanding(), how)()), how
    assert s.rolling(3, center=True).mean().col("value").values() == clean(p.rolling(3, center=True).mean())
    with pytest.raises(errors.InvalidOperation):
        s.rolling(0)
    with pytest.raises(errors.InvalidOperation):
        s.diff(0)


def test_windows_in_many_blocks(spark, monkeypatch):
    from loomframe.plans import order

    for f in (order.with_position, order.in_frames, order.running):
        monkeypatch.setattr(f, "__defaults__", tuple(16 if d == order.BLOCK else d for d in f.__defaults__))
    values = [float((i * 7919) % 101) for i in range(300)]
    s, p = Series.of(spark, values), pd.Series(values)
    clean = lambda x: [None if v != v else pytest.approx(v) for v in x.tolist()]
    assert s.cumsum().values() == clean(p.cumsum())
    assert s.shift(20).values() == clean(p.shift(20)) and s.shift(-3).values() == clean(p.shift(-3))
    assert s.rolling(9).mean().col("value").values() == clean(p.rolling(9).mean())
    assert s.rolling(8, center=True, min_periods=1).max().col("value").values() == [pytest.approx(max(values[max(0, i - 3) : i + 5])) for i in range(300)]
    assert s.rank("average").values() == clean(p.rank())
    f = Frame.of(spark.range(300).selectExpr("id * 37 % 300 as k", "if(id % 9 = 0, null, id) as v"), "k").sort_values("v", False)
    got = f.positioned().orderBy("__pos").select("__pos", "v").collect()
    assert [r[0] for r in got] == list(range(300))
    there = [r[1] for r in got if r[1] is not None]
    assert there == sorted(there, reverse=True) and got[len(there)][1] is None


def test_text_and_time_accessors(spark):
    s = Series.of(spark, ["  Ab ", "éxl", None, ""])
    assert s.str.strip().values() == ["Ab", "éxl", None, ""]
    assert s.str.len().values() == [6, 4, None, 0]
    assert s.str.get(1).values() == [" ", "x", None, None] and s.str.get(-1).values() == [" ", "l", None, None]
    assert s.str.slice(1, 3).values() == [" A", "xl", None, ""] and s.str.slice(-2).values() == ["b ", "xl", None, ""]
    assert s.str.replace("l", "L").str.upper().values() == ["  AB ", "ÉXL", None, ""]
    assert s.str.match("é").values() == [False, True, None, False] and s.str.split("b").values()[0] == ["  A", " "]
    with pytest.raises(errors.ParseError):
        s.str.match("(")
    t = Series.of(spark, [dt.datetime(2024, 12, 31, 5, 6, 7), dt.datetime(2024, 1, 1), None])
    assert t.dt.weekday().values() == [1, 0, None] and t.dt.is_year_end().values() == [True, False, None]
    assert t.dt.time().values()[0] == "05:06:07" and t.dt.is_month_start().values() == [False, True, None]


def test_casts(spark):
    s = Series.of(spark, ["1", " 2", None])
    assert s.astype("int").values() == [1, 2, None]
    assert Series.of(spark, ["yes", "F", None]).astype("bool").values() == [True, False, None]
    assert Series.of(spark, [2.9, -2.9]).astype("int").values() == [2, -2]
    with pytest.raises(Exception, match="can't cast"):
        Series.of(spark, ["2.5"]).astype("int").values()
    assert Series.of(spark, [2.5, 3.5, -0.5, 8.345]).round().values() == [2.0, 4.0, -0.0, 8.0]
    with pytest.raises(errors.InvalidDType):
        s.astype("nothing")
    assert dtypes.strftime("%Y-%m-%d") == "yyyy-MM-dd"
    for bad in ("%Q", "%", "%f"):
        with pytest.raises(errors.ParseError):
            dtypes.strftime(bad)


def test_groups(people, gaps, spark):
    g = people.groupby("country")
    assert g.size().rows() == [("AR", 3), ("UY", 2)]
    assert g.agg_list({"salary": ["mean", "max"], "age": ["sum"]}).columns == ["country", "age_sum", "salary_mean", "salary_max"]
    assert g.first("name").rows() == [("AR", "Ana"), ("UY", "Cid")] and g.last("name").rows() == [("AR", "Eve"), ("UY", "Dee")]
    assert people.groupby("dept", sort=False).size().rows() == [("it", 3), ("hr", 2)]
    assert gaps.groupby("b", dropna=False).sum("c").rows() == [("x", 1.5), ("y", 2.5), ("z", 3.5), (None, 0.0)]
    assert g.transform("salary", "max").values() == [1500.0, 1500.0, 2000.0, 2000.0, 1500.0]
    assert people.groupby("country").filter(group_size() > 2).select("name").rows() == [("Ana",), ("Bob",), ("Eve",)]
    assert len(people.groupby("country").filter(group_count("age") < 3)) == 2
    assert g.apply(lambda d: d.nlargest(1, "salary")[["name"]], "name string").rows() == [("Bob",), ("Cid",)]
    for bad, error in ((lambda: g.agg({"name": "mean"}), errors.TypeMismatch), (lambda: g.agg({"age": "mode"}), errors.InvalidOperation), (lambda: g.agg({"x": "sum"}), errors.ColumnNotFound)):
        with pytest.raises(error):
            bad()
    assert people.groupby("country", "dept", as_index=True).mean("salary").index == ("country", "dept")


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None, "c"]), st.one_of(st.none(), st.integers(-50, 50))), min_size=1, max_size=25))
def test_groups_and_joins_like_pandas(spark, rows):
    f = Frame.from_rows(spark, rows, "k string, v long")
    p = pd.DataFrame(rows, columns=["k", "v"]).astype({"v": "Int64"})
    want = [(k, float(s)) for k, s in p.groupby("k")["v"].sum().items()]
    assert f.groupby("k").sum("v").rows() == want
    right = Frame.from_rows(spark, [("a", 1), ("b", 2), ("b", 3), (None, 4)], "k string, w long")
    got = merge(f, right, on="k", how="left").rows()
    want_rows = [(k, v, w) for k, v in rows for w in ([x for kk, x in (("a", 1), ("b", 2), ("b", 3)) if kk == k] or [None])]
    assert got == want_rows


def test_merge_order_and_names(spark):
    a = Frame.from_rows(spark, [(1, "x"), (2, "y"), (3, "z")], ["id", "v"])
    b = Frame.from_rows(spark, [(4, "p"), (2, "q"), (1, "r")], ["id", "v"])
    assert merge(a, b, on="id", how="outer").columns == ["id", "v_x", "v_y"]
    assert merge(a, b, on="id", how="outer", indicator=True).rows() == [(1, "x", "r", "both"), (2, "y", "q", "both"), (3, "z", None, "left_only"), (4, None, "p", "right_only")]
    assert merge(a, b, on="id", how="right").rows() == [(4, None, "p"), (2, "y", "q"), (1, "x", "r")]
    assert len(merge(a, b, how="cross")) == 9
    floats = Frame.from_rows(spark, [(1.0, "f")], ["key", "w"])
    assert merge(a, floats, left_on="id", right_on="key").rows() == [(1, "x", "f")]
    twice = Frame.from_rows(spark, [(1, "x"), (1, "y")], ["id", "w"])
    with pytest.raises(errors.InvalidJoin):
        merge(a, twice, on="id", validate="one_to_one")
    with pytest.raises(errors.TypeMismatch):
        merge(a, b.rename({"v": "t"}), left_on="v", right_on="id")
    with pytest.raises(errors.InvalidJoin):
        join(a, b)
    assert join(a, b, lsuffix="_l", rsuffix="_r").rows()[0] == (1, "x", 4, "p")


def test_concat(spark):
    a = Frame.from_rows(spark, [(1, "a")], ["x", "y"])
    b = Frame.from_rows(spark, [(2.5, True)], ["x", "z"])
    assert concat([a, None, b]).rows() == [(1.0, "a", None), (2.5, None, True)]
    assert concat([a, b], join="inner").columns == ["x"]
    assert concat([a, a], axis=1).columns == ["x", "y", "x_1", "y_1"]
    with pytest.raises(errors.LengthMismatch):
        concat([a, concat([a, a])], axis=1)
    with pytest.raises(errors.InvalidOperation):
        concat([])


def test_reshaping(spark):
    f = Frame.from_rows(spark, [("ana", 8.0, 9.0), ("bob", 7.0, None)], ["name", "math", "bio"])
    long = melt(f, ["name"], var_name="s", value_name="g")
    assert long.rows() == [("ana", "math", 8.0), ("bob", "math", 7.0), ("ana", "bio", 9.0), ("bob", "bio", None)]
    assert pivot(long, "name", "s", "g").rows() == [(9.0, 8.0), (None, 7.0)]
    with pytest.raises(errors.InvalidOperation):
        pivot(concat([long, long]), "name", "s", "g")
    tall = stack(f.select("math", "bio"))
    assert tall.rows() == [(8.0,), (9.0,), (7.0,), (None,)] and unstack(tall).columns == ["math", "bio"]
    sales = Frame.from_rows(spark, [("AR", "jan", 1.0), ("AR", "jan", 3.0), ("UY", "feb", 5.0)], ["c", "m", "v"])
    t = pivot_table(sales, ["c"], ["m"], ["v"], ["sum", "mean"], fill=0.0)
    assert t.columns == ["sum_feb", "sum_jan", "mean_feb", "mean_jan"] and t.rows() == [(0.0, 4.0, 0.0, 2.0), (5.0, 0.0, 5.0, 0.0)]


def test_resampling(spark):
    rows = [(dt.datetime(2024, 1, 2, 5), 1.0, "a"), (dt.datetime(2024, 1, 1, 9), None, "b"), (None, 9.0, "c"), (dt.datetime(2024, 1, 2, 1), 3.0, "d")]
    f = Frame.from_rows(spark, rows, "date timestamp_ntz, v double, tag string").set_index("date")
    assert resample(f, "D").sum().rows() == [(0.0,), (4.0,)] and resample(f, "D").mean().rows() == [(None,), (2.0,)]
    assert resample(f, "D").first().rows() == [(None, "b"), (1.0, "a")]
    assert resample(f, "ME").count().reset_index().rows() == [(dt.datetime(2024, 1, 31), 2, 3)]
    with pytest.raises(errors.InvalidOperation):
        resample(f, "Q")
    with pytest.raises(errors.InvalidIndex):
        resample(f.reset_index(), "D")


def test_categories(spark):
    f = categorical.make(Frame.from_rows(spark, [("m", 1.0), ("s", 2.0), (None, 3.0), ("l", 4.0)], "size string, v double"), "size", ["s", "m", "l"], ordered=True)
    assert f.dtypes["size"] == "category" and f.col("size").cat.codes().values() == [1, 0, -1, 2]
    assert f.sort_values("size", False).select("v").rows() == [(4.0,), (1.0,), (2.0,), (3.0,)]
    assert f.where(col("size") >= "m").select("v").rows() == [(1.0,), (4.0,)]
    assert f.col("size").cat.compare("<", "l").values() == [True, True, False, False]
    assert f.groupby("size").sum("v").rows() == [("s", 2.0), ("m", 1.0), ("l", 4.0)]
    assert f.col("size").cat.remove(["l"]).values() == ["m", "s", None, None]
    assert f.col("size").cat.rename({"s": "S"}).cat.categories == ["S", "m", "l"]
    assert f.col("size").value_counts().rows() == [("s", 1), ("m", 1), ("l", 1)]
    with pytest.raises(errors.InvalidOperation):
        categorical.make(f, "size", ["s", "s"])
    with pytest.raises(errors.InvalidDType):
        _ = f.col("v").cat
    with pytest.raises(Exception, match="no category"):
        categorical.make(Frame.from_rows(spark, [("q",)], ["c"]), "c", ["a"]).rows()


def test_user_functions(people):
    assert people.col("age").apply(lambda v: v * 2, "long").values()[0] == 44
    assert people.select("age", "salary").apply(sum, axis=0, returns="double") == {"age": 156.0, "salary": 6600.0}
    assert people.pipe(lambda f: f.head(1)).rows()[0][1] == "Ana"
    assert people.copy().shape == (5, 5) and "5 rows" in people.info() and "Ana" in people.render()
    assert len(people.sample(3, 7)) == 3 and people.sample(3, 7).rows() == people.sample(3, 7).rows()


def test_frames_from_objects(spark):
    import dataclasses

    @dataclasses.dataclass
    class P:
        name: str
        age: int = dataclasses.field(metadata={"name": "years"})
        secret: str = dataclasses.field(default="", metadata={"name": "-"})

    assert Frame.from_objects(spark, [P("a", 1), P("b", 2)]).records() == [{"name": "a", "years": 1}, {"name": "b", "years": 2}]
    assert Frame.from_map(spark, {"b": [1, 2], "a": [1.5, float("nan")]}).rows() == [(1.5, 1), (None, 2)]
    assert Frame.from_records(spark, [{"x": 1}, {"y": "a"}]).rows() == [(1, None), (None, "a")]
    assert Frame(spark.range(2).toDF("v"), [Key("v")]).rows() == [(0,), (1,)]


def test_time_layouts(spark):
    """Day first, then month first; clocks with and without a fraction or a zone; forms that no layout has are refused."""
    from loomframe.errors import ParseError
    from loomframe.functions import datetimes, dtypes

    t = dt.datetime
    cases = {
        "25/12/2023": t(2023, 12, 25), "12/25/2023": t(2023, 12, 25), "05/06/2023": t(2023, 6, 5), "2023/02/01": t(2023, 2, 1), "2023-02-01": t(2023, 2, 1),
        "2023-01-02T03:04:05Z": t(2023, 1, 2, 3, 4, 5), "2023-01-02T03:04:05+02:30": t(2023, 1, 2, 0, 34, 5), "2023-01-02T03:04:05-01:00": t(2023, 1, 2, 4, 4, 5),
        "2023-01-02T03:04:05.123456789Z": t(2023, 1, 2, 3, 4, 5, 123456), "2023-01-02 03:04:05.5": t(2023, 1, 2, 3, 4, 5, 500000), "2023-01-02T03:04:05": t(2023, 1, 2, 3, 4, 5),
        "25-12-2023": None, "2023-01-02 03:04": None, "30/02/2023": None, "2023-02-30": None, "": None, " 2023-02-01": None, "2023-02-01\n": None, "2023-01-02 25:00:00": None, "2023-01-02 03:04:05Z": None,
    }
    df = spark.createDataFrame([(s,) for s in cases], "s string")
    got = {r.s: r.d for r in df.select("s", datetimes.to_datetime(F.col("s"), df.schema["s"].dataType, errors="coerce").alias("d")).collect()}
    assert got == cases
    for s, want in cases.items():
        if want is None:
            with pytest.raises(ParseError):
                dtypes.time_of(s, dtypes.PARSE_LAYOUTS)
        else:
            assert dtypes.time_of(s, dtypes.PARSE_LAYOUTS) == want
    month_first = {r.s: r.d for r in df.select("s", dtypes.parse_time(F.col("s"), dtypes.CAST_LAYOUTS).alias("d")).collect()}
    assert month_first["05/06/2023"] == t(2023, 5, 6) and month_first["25/12/2023"] is None and month_first["2023-01-02T03:04:05"] is None


def test_blocks_are_cut_on_all_order_keys(spark):
    df = spark.range(0, 2000).select(F.lit("same").alias("a"), F.when(F.col("id") % 7 > 0, F.col("id") % 5).alias("b"), F.col("id").alias("c"))
    for keys in ((Key("a"), Key("b", False), Key("c")), (Key("b"), Key("c", False)), (Key("a"), Key("c"))):
        got = {r["c"]: r["__pos"] for r in order.with_position(df, keys, block=100).collect()}
        by = lambda r: [(r[k.name] is None, 0 if r[k.name] is None else r[k.name] if k.name == "a" or k.ascending else -r[k.name]) for k in keys]
        assert got == {r["c"]: i for i, r in enumerate(sorted(df.collect(), key=by))}
        blocks = order._block(df, keys, order._bounds(df, keys, 20))
        assert max(r["count"] for r in df.groupBy(blocks).count().collect()) <= 200


def test_bounds_of_no_rows_and_of_equal_rows(spark):
    same = spark.range(50).select(F.lit(1).alias("k"), F.lit(None).cast("string").alias("t"))
    keys = (Key("k"), Key("t"))
    assert sorted(r["__pos"] for r in order.with_position(same, keys, block=10).collect()) == list(range(50))
    assert order._bounds(same.limit(0), keys, 3) == []


def test_long_selections_go_by_position(spark, monkeypatch):
    f = Frame.of(spark.range(0, 300).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")), order_by="k")
    short = [f.head(40), f.tail(40), f.slice(5, 45), f.sample(40, seed=3), f.iloc_rows(3, slice(10, 60, 7), -1, slice(0, 200, 2))]
    want = [x.rows() for x in short]
    monkeypatch.setattr(frame, "BLOCK", 10)
    monkeypatch.setattr(frame, "LISTED", 20)
    long = [f.head(40), f.tail(40), f.slice(5, 45), f.sample(40, seed=3), f.iloc_rows(3, slice(10, 60, 7), -1, slice(0, 200, 2))]
    assert [x.rows() for x in long] == want
    assert f.iloc_rows(slice(0, 200)).rows() == f.slice(0, 200).rows()


def test_labels_are_found_in_one_scan(spark, monkeypatch):
    f = Frame.from_rows(spark, [("b", 1), ("a", 2), ("b", 3), (None, 4)], ["k", "v"]).set_index("k")
    want = [(2,), (1,), (3,), (2,)]
    assert [r[-1:] for r in f.loc_rows("a", "b", "a").rows()] == want
    monkeypatch.setattr(frame, "PUSHED", 0)
    assert [r[-1:] for r in f.loc_rows("a", "b", "a").rows()] == want
    with pytest.raises(errors.InvalidIndex):
        f.loc_rows("a", "x")


def test_quantiles_by_rank_equal_the_others(spark, monkeypatch):
    values = [None, 3.5, -1.0, 3.5, 8.25, 0.0, 2.0, 2.0, None, 11.0]
    f = Frame.from_rows(spark, [(v, i) for i, v in enumerate(values)], "x double, n long")
    want = [f.quantile(0.3).rows(), f.median().rows(), f.describe().rows()]
    monkeypatch.setattr(frame, "BLOCK", 3)
    got = [f.quantile(0.3).rows(), f.median().rows(), f.describe().rows()]
    for a, b in zip(want, got, strict=True):
        assert [[pytest.approx(v) for v in r] for r in a] == [list(r) for r in b]
    assert order.quantiles(f.df.filter("x is null"), F.col("x"), [0.5]) == [None]
    assert order.quantiles(f.df, F.col("x"), [0.5], block=2) == [pytest.approx(2.75)]


def test_level_codes_and_equality_stay_distributed(spark):
    f = Frame.from_rows(spark, [("b", 1), (None, 2), ("a", 1)], ["k", "m"]).set_index("k", "m")
    assert labels.codes(f).rows() == [(1, 0), (-1, 1), (0, 0)]
    g = Frame.from_rows(spark, [("b", 1), (None, 2)], ["k", "m"]).set_index("k", "m")
    assert labels.equal(f, f) and not labels.equal(f, g) and not labels.equal(g, f)


def test_division_by_negative_zero_has_its_sign(spark):
    f = Frame.from_rows(spark, [(1.0, 0.0), (1.0, -0.0), (-2.0, -0.0), (-2.0, 0.0), (None, -0.0), (1.0, 4.0)], "a double, b double")
    inf = float("inf")
    assert f.assign_expr("r", col("a") / col("b")).select("r").rows() == [(inf,), (-inf,), (inf,), (-inf,), (None,), (0.25,)]
    assert f.col("a").div(f.col("b")).values() == [inf, -inf, inf, -inf, None, 0.25]


def test_change_from_zero_to_zero_is_nan_and_not_missing(spark):
    s = Series.of(spark, [0.0, 0.0, 2.0, 3.0, None, 0.0, 1.0], dtype="float64")
    assert list(map(str, s.pct_change().values())) == ["None", "nan", "inf", "0.5", "None", "None", "inf"]


@pytest.mark.parametrize("how", ["inner", "left", "right"])
def test_many_pairs_of_few_keys_are_made_by_many_tasks(spark, monkeypatch, how):
    monkeypatch.setattr(joins, "PAIRS", 500)
    spark.createDataFrame([(i, i % 3 if i % 10 else None, float(i)) for i in range(300)], "i long, k int, v double").createOrReplaceTempView("dealt_a")
    spark.createDataFrame([(i, i % 4, float(i)) for i in range(120)], "i long, k int, v double").createOrReplaceTempView("dealt_b")
    a, b = (Frame.of(spark.table(f"dealt_{t}"), "i").select("k", "v") for t in "ab")
    got = merge(a, b, on="k", how=how)
    p, r = pd.DataFrame(a.records(), dtype=object), pd.DataFrame(b.records(), dtype=object)
    want = p.dropna(subset=["k"]).merge(r, on="k", how=how)
    if how == "left":
        want = pd.concat([want, p[p["k"].isna()].rename(columns={"v": "v_x"})])
    clean = lambda rows: sorted(repr(tuple(None if pd.isna(v) else float(v) for v in x)) for x in rows)
    assert clean(got.rows()) == clean(want[["k", "v_x", "v_y"]].to_numpy())
    # in a shuffle by key one task makes all pairs of a key
    sizes = [r.n for r in got.df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) < sum(sizes) / 4


def test_joins_of_keys_that_do_not_repeat_are_left_alone(spark, monkeypatch):
    monkeypatch.setattr(joins, "PAIRS", 10)
    f = Frame.of(spark.range(300).select("id", F.col("id").alias("k")), "id").select("k")
    assert "Repartition" not in merge(f, f, on="k").df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("kind", ["mixed", "rising", "falling", "equal", "late"])
def test_running_medians_in_blocks(spark, kind):
    import random
    import statistics

    rnd = random.Random(3)
    make = {"mixed": lambda i: rnd.choice([None, 1.0, rnd.random()]), "rising": float, "falling": lambda i: -float(i), "equal": lambda i: 2.0, "late": lambda i: None if i < 70 else float(i % 7)}[kind]
    values = [make(i) for i in range(200)]
    df = spark.createDataFrame([(i, v, float(i % 9)) for i, v in enumerate(values)], f"{order.POS} long, x double, y double")
    for block in (16, 60):
        out = window.running_medians(df, {"mx": F.col("x"), "my": F.col("y")}, 2, block)
        got = {r[order.POS]: r for r in out.collect()}
        for i in range(200):
            for name, have in (("mx", values[: i + 1]), ("my", [float(j % 9) for j in range(i + 1)])):
                there = [v for v in have if v is not None]
                assert got[i][name] == (statistics.median(there) if len(there) >= 2 else None), (block, i)


def test_running_medians_gather_no_window(spark):
    f = Frame.of(spark.range(50).select("id", (F.col("id") % 7).cast("double").alias("x")), "id")
    plan = f.select("x").col("x").expanding().median().df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_series_of_a_frame_before_columns_were_added_need_no_join(spark):
    f = Frame.of(spark.range(5).select("id", (F.col("id") * 2).alias("a")), "id")
    g = f.assign("s", f.col("a").add(1)).assign("d", f.col("a").mul(f.col("id")))
    g = g.assign("e", g.col("s").sub(f.col("a"))).assign("t", f.col("a").add(g.col("s")))
    assert "Join" not in g.df._jdf.queryExecution().optimizedPlan().toString()
    assert g.select("s", "d", "e", "t").rows() == [(2 * i + 1, 2 * i * i, 1, 4 * i + 1) for i in range(5)]
    assert g.filter(f.col("a").gt(4)).select("a").rows() == [(6,), (8,)]
    # a column that changed since is matched by position, as before
    h = f.assign("a", f.col("a").mul(10)).assign("old", f.col("a"))
    assert h.select("a", "old").rows() == [(20 * i, 2 * i) for i in range(5)]
    h = f.assign("A", f.col("a").mul(10)).assign("old", f.col("a"))
    assert h.select("old").rows() == [(2 * i,) for i in range(5)]
