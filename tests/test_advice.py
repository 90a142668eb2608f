"""Whole jobs: what the review of round 1 found missing."""

from weftline.operators import joins
from weftline.plans.compiler import compile_workflow
from weftline.plans.document import load

from test_documents import document, node


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_fuzzy_match_has_all_rows(spark):
    df = spark.createDataFrame([(1, "john smith"), (2, "John Smith "), (3, "jon smith"), (4, "twin"), (5, "twin"), (6, "alone"), (7, None)], "id int, n string")
    assert rows(joins.fuzzy_pairs(df, "id", "n")) == [(1, 2, 1.0), (1, 3, 0.9), (2, 3, 0.9), (4, 5, 1.0)]
    assert rows(joins.fuzzy_members(df, "id", "n")) == [(1, 1, 2, 1), (2, 1, 2, 1), (3, 3, 1, 1), (4, 4, 2, 0), (5, 4, 2, 0), (6, 6, 1, 0)]
    flow = load(document([node(1, "DbFileInput", "<File>x.csv</File>"), node(2, "FuzzyMatch", "<KeyField>id</KeyField><MatchField>n</MatchField>")], [(1, "Output", 2, "Input")]))
    done = compile_workflow(flow, spark, inputs={1: df})
    assert rows(done.frame(2).select("id_left", "id_right")) == [(1, 2), (1, 3), (2, 3), (4, 5)] and done.frame(2, "Members").count() == 6


def test_cross_tab_has_values_that_the_document_does_not_know(spark):
    df = spark.createDataFrame([(1, "b", 1.0), (1, "New York", 2.0), (1, "new", 4.0), (2, "a", 8.0)], "id int, h string, v double")
    config = '<GroupFields><Field field="id"/></GroupFields><HeaderField>h</HeaderField><DataField>v</DataField><Method>Sum</Method>'
    seen = "".join(f'<Field name="{n}" type="Double"/>' for n in ("id", "gone", "New_York", "b", "a"))
    extra = f'<MetaInfo connection="Output"><RecordInfo>{seen}</RecordInfo></MetaInfo>'
    flow = load(document([node(1, "DbFileInput", "<File>x.csv</File>"), node(2, "CrossTab", config, extra)], [(1, "Output", 2, "Input")]))
    done = compile_workflow(flow, spark, inputs={1: df})
    made = done.frame(2)
    assert made.columns == ["id", "gone", "New York", "b", "a", "new"]
    assert rows(made) == [(1, None, 2.0, 1.0, None, 4.0), (2, None, None, None, 8.0, None)]
    assert len([x for x in done.diagnostics if x.category == "header_values"]) == 2
