"""The expression language: syntax, nulls, functions."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.functions import columns as C
from weftline.functions.expression import Binary, Call, ExpressionError, Field, If, In, Literal, Unary, fields, parse
from weftline.operators.prepare import filter_rows, formula


def test_precedence_and_forms():
    assert parse("1 + 2 * 3") == Binary("+", Literal(1), Binary("*", Literal(2), Literal(3)))
    assert parse("not [a] = 1 and [b] or [c]") == Binary("or", Binary("and", Unary("not", Binary("=", Field("a"), Literal(1))), Field("b")), Field("c"))
    assert parse("-[x] - -2") == Binary("-", Unary("-", Field("x")), Unary("-", Literal(2)))
    assert parse("[Customer Number] IN ('a', \"b\")") == In(Field("Customer Number"), (Literal("a"), Literal("b")))
    assert parse("[Row-12:A b] + [Row+1:c]") == Binary("+", Field("A b", -12), Field("c", 1))
    assert parse("iF TRUE theN 1 ELSEIF False THEN 2 else NULL() endif") == If(((Literal(True), Literal(1)), (Literal(False), Literal(2))), Call("null", ()))
    assert parse("!a(1) && 1 == 2 || 2.50 <> 3") == Binary("or", Binary("and", Unary("not", Call("a", (Literal(1),))), Binary("=", Literal(1), Literal(2))), Binary("<>", Literal(2.5), Literal(3)))
    assert fields(parse("[a] + Trim([b]) + [a] + IIF([c], 1, [d])")) == ["a", "b", "c", "d"]


@pytest.mark.parametrize("text", ["", " ", "[a", "1 +", "(1", "1 2", "IF 1 THEN 2 ENDIF", "f(1,", "a", "'x", "1 = 2 = 3", "#"])
def test_what_is_none(text):
    with pytest.raises(ExpressionError):
        parse(text)


@settings(max_examples=100, deadline=None)
@given(st.recursive(st.integers(0, 9).map(str), lambda x: st.tuples(x, st.sampled_from(["+", "-", "*"]), x).map(lambda t: f"({t[0]} {t[1]} {t[2]})"), max_leaves=8))
def test_arithmetic_like_python(text):
    def value(n):
        match n:
            case Literal(v):
                return v
            case Binary(op, a, b):
                return {"+": int.__add__, "-": int.__sub__, "*": int.__mul__}[op](value(a), value(b))

    assert value(parse(text)) == eval(text)  # noqa: S307


def results(spark, data, schema, *texts):
    df = formula(spark.createDataFrame(data, schema), [(f"r{i}", t) for i, t in enumerate(texts)])
    return [tuple(r[f"r{i}"] for i in range(len(texts))) for r in df.collect()]


def test_nulls_in_logic(spark):
    data = [("active", 150.0), ("active", None), (None, 500.0), ("x", 50.0)]
    got = results(spark, data, "status string, v double", "[status] = 'active' AND [v] > 100", "[status] <> 'active'", "NOT ([v] > 100)", "[v] IN (50, 150)", "IF [status] = \"active\" THEN 'Yes' ELSE 'No' ENDIF", "[v] * 2 + 1", "[status] = NULL()", "[status] <> NULL()", "IsNull([v])", "Coalesce([v], 0)", "IsEmpty([status])")
    assert [g[0] for g in got] == [True, False, False, False]
    assert [g[1] for g in got] == [False, False, True, True]
    assert [g[2] for g in got] == [False, True, False, True]
    assert [g[3] for g in got] == [True, False, False, True]
    assert [g[4] for g in got] == ["Yes", "Yes", "No", "No"]
    assert [g[5] for g in got] == [301.0, None, 1001.0, 101.0]
    assert {g[6] for g in got} == {False} and {g[7] for g in got} == {True}
    assert [g[8] for g in got] == [False, True, False, False] and [g[9] for g in got] == [150.0, 0.0, 500.0, 50.0]
    assert [g[10] for g in got] == [False] * 4


def test_functions_on_texts(spark):
    data = [(" \tit's a2b ", "abcdef"), (None, None), ("", "")]
    got = results(spark, data, "s string, t string", "Trim([s])", "TitleCase(Trim([s]))", "Substring([t], 2, 3)", "Mid([t], 3)", "Left([t], -2)", "Right([t], 2)", "Right([t], 0)", "FindString([t], 'cd')", "FindString([t], 'x')", "Contains([t], 'b.d')", "StartsWith([t], 'ab')", "Replace([t], 'b', 'BB')", "[t] + '!'", "ToNumber('1.5x')", "ToNumber('1.5')", "ToInteger('7')", "ToInteger('7.5')", "ToString(5)", "TrimLeft([s])", "Length([t])")
    assert got[0] == ("it's a2b", "It'S A2B", "bcd", "cdef", "abcd", "ef", "abcdef", 2, -1, True, True, "aBBcdef", "abcdef!", None, 1.5, 7, None, "5", "it's a2b ", 6)
    assert got[1][:2] == (None, None) and got[1][9:11] == (False, False) and got[1][12] is None
    assert got[2][0] == "" and got[2][9] is False


def test_numbers(spark):
    got = results(spark, [(7.0, 3.0), (-7.0, 3.0), (7.0, -3.0), (1.0, 0.0), (None, 1.0)], "a double, b double", "[a] % [b]", "[a] / [b]", "Round([a] / 2)", "Round(2.345, 2)", "Min([a], [b])", "Max([a], [b])", "Sqrt([a])", "Log([b])", "Ceil([a] / 2)", "Pow([b], 2)", "Abs([a])")
    assert [g[0] for g in got] == [1.0, 2.0, -2.0, None, None]
    assert [g[1] for g in got][3:] == [None, None]
    assert [g[2] for g in got][:2] == [4.0, -4.0]
    assert [g[4] for g in got] == [3.0, -7.0, -3.0, 0.0, None] and got[0][5] == 7.0
    assert got[1][6] is None and got[2][7] is None and got[3][7] is None and got[0][8] == 4.0


def test_dates(spark):
    day = dt.datetime(2024, 1, 31, 12)
    got = results(spark, [(day, "2024-01-30"), (None, "bad")], "d timestamp_ntz, s string", "DateTimeDiff([d], [s], 'days')", "DateTimeDiff([s], [d], 'days')", "DateTimeDiff([d], [s], 'hours')", "DateTimeAdd([d], 1, 'months')", "DateTimeAdd([d], -2, 'days')", "DateTimeFormat([d], '%d/%m/%Y %H:%M')", "[d] > '2024-01-31'")
    assert got[0] == (1.0, -2.0, 36.0, dt.datetime(2024, 2, 29, 12), dt.datetime(2024, 1, 29, 12), "31/01/2024 12:00", True)
    assert got[1] == (None, None, None, None, None, None, False)


def test_formula_sequence_and_errors(spark):
    say = []
    df = formula(spark.createDataFrame([(1, "x")], "a int, `odd ``name` string"), [("b", "[a] + 1"), ("a", "[b] * 10"), ("c", "[a] + [b]"), ("bad", "[a] +"), ("", "1"), ("gone", "[nope]"), ("f", "Nope(1)"), ("q", "[odd `name] + '!'")], diagnostics=say)
    assert [df.first()[c] for c in ("a", "b", "c", "bad", "gone", "f", "q")] == [20, 2, 22, None, None, None, "x!"]
    assert [c for c, _ in say] == ["expression_error", "incomplete_formula", "unresolved_field", "unsupported_function"]


def test_filter_parts_are_complements_and_push_down(spark, tmp_path):
    df = spark.createDataFrame([(i if i % 3 else None, "a" if i % 2 else None) for i in range(50)], "n int, s string")
    df.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for text in ("[n] > 10", "[n] <> 5", "NOT [s] = 'a'", "[n] > 10 AND [s] = 'a'", "[n] IN (1, 2) OR IsNull([s])", "IF [n] > 3 THEN TRUE ELSE [s] = 'a' ENDIF"):
        out = filter_rows(df, text)
        assert out["True"].count() + out["False"].count() == 50
        assert out["True"].intersectAll(out["False"]).count() == 0 or "IsNull" in text
    plan = filter_rows(df, "[n] > 10 AND [s] = 'a'")["True"]._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(n,10)" in plan and "EqualTo(s,a)" in plan
    say = []
    assert filter_rows(df, None, diagnostics=say)["True"].count() == 50 and filter_rows(df, "[n] >", diagnostics=say)["False"].count() == 0
    assert [c for c, _ in say] == ["missing_configuration", "expression_error"]


def test_date_patterns():
    assert C.java_pattern("%Y-%m-%d %H:%M:%S") == "yyyy-MM-dd HH:mm:ss" and C.java_pattern("%d of %B") == "dd 'of' MMMM" and C.java_pattern("yyyy") == "yyyy"
