"""Generate Rows in documents."""

import pytest
from test_documents import document, node

from weftline.plans.compiler import compile_workflow
from weftline.plans.document import load


def config(init, cond, loop):
    escaped = cond.replace("<", "&lt;").replace(">", "&gt;")
    return f"<CreateField_Name>i</CreateField_Name><Expression_Init>{init}</Expression_Init><Expression_Cond>{escaped}</Expression_Cond><Expression_Loop>{loop}</Expression_Loop>"


def compiled(spark, text, df=None):
    nodes, links = [node(2, "GenerateRows", text)], []
    if df is not None:
        nodes, links = [node(1, "DbFileInput", "<File>x.csv</File>"), *nodes], [(1, "Output", 2, "Input")]
    return compile_workflow(load(document(nodes, links)), spark, inputs={1: df} if df is not None else None)


@pytest.mark.parametrize(
    ("init", "cond", "loop", "want"),
    [
        ("1", "[i] <= [n]", "[i] + 1", [(3, "a", 1), (3, "a", 2), (3, "a", 3), (12, "b", 1)]),
        ("[n]", "[i] > 0", "[i] - 2", [(3, "a", 1), (3, "a", 3), (12, "b", 2)]),
        ("0", "[n] / 2 > [i]", "1 + [i]", [(3, "a", 0), (3, "a", 1), (12, "b", 0)]),
        ("0.5", "[i] < 2", "[i] + 0.5", [(3, "a", 0.5), (3, "a", 1.0), (3, "a", 1.5), (12, "b", 0.5)]),
    ],
)
def test_rows_of_every_row(spark, init, cond, loop, want):
    df = spark.createDataFrame([(3, "a"), (12, "b"), (None, "c")], "n int, s string")
    got = [tuple(r) for r in compiled(spark, config(init, cond, loop), df).frame(2).collect()]
    assert set(want) <= set(got) and sorted(r for r in got if r[0] == 3) == [r for r in want if r[0] == 3]


def test_without_input_and_unreadable(spark):
    of = lambda *text: [r[0] for r in compiled(spark, config(*text)).frame(2).orderBy("i").collect()]
    assert of("1", "[i] < 4", "[i] + 1") == [1, 2, 3] and of("5", "[i] >= 1", "[i] - 2") == [1, 3, 5] and of("1", "[i] <= 2 * 2", "[i] + 1") == [1, 2, 3, 4]
    assert compiled(spark, "").frame(2).count() == 10
    for text in (("1", "IsNull([i])", "[i] + 1"), ("1", "[i] < 9", "[i] * 2"), ("1", "[i] > 0", "[i] + 1"), ("1", "[i] <= [gone]", "[i] + 1")):
        done = compiled(spark, config(*text))
        assert 2 in done.blocked and any(x.category == "build_error" for x in done.diagnostics), text
