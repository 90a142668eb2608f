"""Documents: parsing, safety, compiling, running."""

import io
import zipfile

import pytest

from weftline.plans import registry
from weftline.plans.compiler import compile_workflow
from weftline.plans.document import DocumentError, load
from weftline.plans.graph import CyclicWorkflow, Graph


def node(tool_id, kind, config="", extra="", plugin=None):
    plugin = plugin or f"MakerBaseGui.{kind}.{kind}"
    return f'<Node ToolID="{tool_id}"><GuiSettings Plugin="{plugin}"><Position x="1" y="2"/></GuiSettings><Properties><Configuration>{config}</Configuration>{extra}</Properties></Node>'


def document(nodes, links=()):
    wires = "".join(f'<Connection><Origin ToolID="{a}" Connection="{x}"/><Destination ToolID="{b}" Connection="{y}"/></Connection>' for a, x, b, y in links)
    return f'<?xml version="1.0"?><Doc yxmdVer="2024.1"><Nodes>{"".join(nodes)}</Nodes><Connections>{wires}</Connections></Doc>'.encode()


def rows(df):
    return [tuple(r) for r in df.collect()]


PUMPS = [("north", 7.5, None), ("south", None, "dry"), ("east", 41.0, "ok"), (None, 12.25, "OK"), ("west", 12.0, "ok")]
PUMP = "site string, flow double, state string"


def test_catalogue():
    assert len(registry.TOOLS) == 100
    counts = {s: sum(t.support == s for t in registry.TOOLS) for s in (registry.FULL, registry.PARTIAL, registry.EXTERNAL, registry.DOCUMENTATION, registry.PASS)}
    assert list(counts.values()) == [40, 24, 21, 11, 4]
    assert registry.lookup("MakerBaseGui.MakerSelect.MakerSelect").name == "Select"
    assert registry.lookup("Cleanse.yxmc").name == "Data Cleansing"
    assert registry.lookup("LockInFilter").name == "Filter In-DB"
    assert registry.lookup("Some.FancyFilter") is registry.UNKNOWN
    assert registry.type_of("box_input_v1.0.3") == "box_input_v1.0.3"


def test_every_full_tool_is_built():
    from weftline.plans.compiler import BUILDERS

    assert not [t.name for t in registry.TOOLS if t.support in (registry.FULL, registry.PASS) and t.name not in BUILDERS]


def test_filter_and_sink(spark, tmp_path):
    """Both outputs make up the whole, nulls in them; one is written by way of a sort."""
    flow = load(
        document(
            [node(5, "DbFileInput", "<File>pumps.csv</File>"), node(6, "Filter", "<Expression>[flow] &gt; 8 AND Uppercase([state]) = 'OK'</Expression>"), node(7, "Sort", '<SortInfo><Field field="flow" order="Descending"/></SortInfo>'), node(8, "DbFileOutput", "<File>made/good.csv</File>")],
            [(5, "Output", 6, ""), (6, "True", 7, ""), (7, "", 8, "")],
        )
    )
    spark.createDataFrame(PUMPS, PUMP).coalesce(1).write.option("header", True).csv(str(tmp_path / "pumps.csv"))
    done = compile_workflow(flow, spark, base=str(tmp_path))
    assert [r[0] for r in rows(done.frame(7))] == ["east", None, "west"]
    assert {r[0] for r in rows(done.frame(6, "F"))} == {"north", "south"}
    done.write(str(tmp_path))
    assert {r[0] for r in rows(spark.read.option("header", True).csv(str(tmp_path / "made/good.csv")))} == {"east", None, "west"}
    assert rows(done.lineage_frame().where("target_field = 'state'"))[0][:2] == ("pumps.csv", "state")


def test_branches_meet_again(spark):
    """A join of the two outputs of a filter; what has no partner on either side."""
    flow = load(
        document(
            [node(1, "TextInput"), node(2, "Filter", "<Expression>[part] % 2 = 0</Expression>"), node(3, "Formula", '<FormulaFields><FormulaField field="crate" expression="[crate] + 1"/></FormulaFields>'), node(4, "Join", '<JoinInfo connection="Left"><Field field="crate"/></JoinInfo><JoinInfo connection="Right"><Field field="crate"/></JoinInfo>'), node(5, "BrowseV2")],
            [(1, "", 2, ""), (2, "True", 4, "Left"), (2, "False", 3, ""), (3, "", 4, "Right"), (4, "J", 5, "")],
        )
    )
    done = compile_workflow(flow, spark, inputs={1: spark.createDataFrame([(2, 30), (4, 31), (6, None), (7, 29), (9, 30), (11, 90)], "part int, crate int")})
    assert sorted((r["part"], r["crate"]) for r in done.frame(4, "J").collect()) == [(2, 30), (4, 31)]
    assert rows(done.frame(4, "L")) == [(6, None)] and rows(done.frame(4, "R").select("part", "crate")) == [(11, 91)]


def test_first_and_concat_follow_the_sort(spark):
    flow = load(
        document(
            [node(1, "TextInput"), node(2, "Sort", '<SortInfo><Field field="flow" order="Descending"/></SortInfo>'), node(3, "Summarize", '<SummarizeFields><SummarizeField field="site" action="First"/><SummarizeField field="site" action="Last"/><SummarizeField field="site" action="Concat" rename="all"/></SummarizeFields>')],
            [(1, "", 2, ""), (2, "", 3, "")],
        )
    )
    done = compile_workflow(flow, spark, inputs={1: spark.createDataFrame(PUMPS, PUMP).repartition(4)})
    # the row without a flow comes last, the one without a site is left out
    assert rows(done.frame(3)) == [("east", "south", "east,west,north,south")]


def test_words_across_and_back(spark):
    flow = load(
        document(
            [
                node(11, "TextInput", '<Fields><Field name="route"/><Field name="left"/><Field name="stops"/></Fields><Data><r><c>R9</c><c>07.03.2023</c><c>quay;mill;hill</c></r><r><c>R2</c><c>soon</c><c>mill</c></r></Data>'),
                node(12, "DateTime", "<InputFieldName>left</InputFieldName><InputFormat>%d.%m.%Y</InputFormat><OutputFieldName>at</OutputFieldName>"),
                node(13, "TextToColumns", "<Field>stops</Field><Delimeters>;</Delimeters><NumFields>2</NumFields>"),
                node(14, "Transpose", '<KeyFields><Field field="route"/></KeyFields><DataFields><Field field="stops_0"/><Field field="stops_1"/></DataFields>'),
                node(15, "CrossTab", '<GroupFields><Field field="Value"/></GroupFields><HeaderField>route</HeaderField><DataField>Name</DataField><Method>First</Method>'),
            ],
            [(i, "Output", i + 1, "Input") for i in range(11, 15)],
        )
    )
    done = compile_workflow(flow, spark)
    assert [str(r[0]) for r in rows(done.frame(12).select("at"))] == ["2023-03-07 00:00:00", "None"]
    assert [(r["stops_0"], r["stops_1"]) for r in done.frame(13).collect()] == [("quay", "mill;hill"), ("mill", None)]
    assert sorted(map(tuple, done.frame(15).select("Value", "R2", "R9").collect())) == [("mill", "stops_0", None), ("mill;hill", None, "stops_1"), ("quay", None, "stops_0")]


def test_unknown_tool_blocks_only_its_branch(spark):
    flow = load(document([node(1, "TextInput", '<Fields><Field name="a"/></Fields><Data><r><c>x</c></r></Data>'), node(2, "Mystery", "<ApiKey>hush</ApiKey><Conn>host=h;password=hush</Conn>"), node(3, "BrowseV2"), node(4, "BrowseV2")], [(1, "Output", 2, "Input"), (2, "Output", 3, "Input"), (1, "Output", 4, "Input")]))
    done = compile_workflow(flow, spark)
    assert done.blocked == {2, 3} and rows(done.frame(4)) == [("x",)]
    assert [d.category for d in done.diagnostics] == ["unsupported_tool"]
    assert "hush" not in str(flow.as_dict()) and "[REDACTED]" in str(flow.as_dict())


def test_containers_disable_their_tools():
    inner = node(3, "Filter")
    box = f'<Node ToolID="2"><GuiSettings Plugin="X.ToolContainer.ToolContainer"/><Properties><Configuration><Caption>Box</Caption><Disabled value="True"/></Configuration></Properties><ChildNodes>{inner}</ChildNodes></Node>'
    flow = load(document([node(1, "TextInput"), box]))
    assert set(flow.tools) == {1} and flow.containers[2].disabled
    flow = load(document([node(1, "TextInput"), box.replace('value="True"', 'value="False"')]))
    assert flow.tools[3].container_id == 2 and flow.containers[2].children == [3]


def test_cycles_and_order():
    flow = load(document([node(i, "Filter") for i in (1, 2, 3)], [(1, "", 2, ""), (2, "", 1, "")]))
    with pytest.raises(CyclicWorkflow):
        Graph(flow).order()
    graph = Graph(load(document([node(i, "Filter") for i in (3, 1, 2, 4)], [(3, "", 1, ""), (2, "", 1, ""), (1, "", 9, "")])))
    assert graph.order() == [2, 3, 1, 4] and graph.isolated() == [4] and graph.ancestors(1) == {2, 3}


def test_packages(tmp_path):
    def package(names):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for n, data in names.items():
                z.writestr(n, data)
        return buffer.getvalue()

    good = document([node(1, "Filter")])
    assert set(load(package({"readme.txt": b"x", "flow.yxmd": good})).tools) == {1}
    for bad in ({"../flow.yxmd": good}, {"/abs.yxmd": good}, {"a.txt": b""}, {f"{i}.txt": b"" for i in range(101)}):
        with pytest.raises(DocumentError):
            load(package(bad))
    for bad in (b"", b"plain", b"<a>", b"PK\x03\x04broken", b'<!DOCTYPE a [<!ENTITY x "y">]><a/>'):
        with pytest.raises(DocumentError):
            load(bad)


def test_missing_file_is_reported(spark):
    done = compile_workflow(load(document([node(1, "DbFileInput", "<File>nowhere.csv</File>")])), spark)
    assert done.blocked == {1} and {d.category for d in done.diagnostics} >= {"external_dependency"}
    assert rows(done.dependencies_frame())[0][1:] == ("nowhere.csv", "csv", False)


def test_duplicates_are_reported_with_the_rest(spark):
    """First deliveries are numbered, later ones counted, and both reports united."""
    flow = load(
        document(
            [
                node(2, "DbFileInput"), node(4, "", '<TrimWhitespace value="True"/><Fields><Field field="box"/></Fields>', plugin="Cleanse.yxmc"), node(6, "Sort", '<SortInfo><Field field="came" order="Ascending"/></SortInfo>'), node(8, "Unique", '<UniqueFields><Field field="box"/></UniqueFields>'),
                node(10, "RecordID", "<FieldName>no</FieldName><StartValue>100</StartValue>"), node(12, "Summarize", '<SummarizeFields><SummarizeField field="box" action="GroupBy"/><SummarizeField field="came" action="Count" rename="again"/></SummarizeFields>'), node(14, "Union", "<Mode>ByName</Mode>"),
            ],
            [(2, "", 4, ""), (4, "", 6, ""), (6, "", 8, ""), (8, "Unique", 10, ""), (8, "Duplicates", 12, ""), (10, "", 14, "#1"), (12, "", 14, "#2")],
        )
    )
    boxes = spark.createDataFrame([("b2 ", 5), ("b1", 3), (" b2", 1), ("b1", 4), ("b1", 9), (None, 2)], "box string, came int").repartition(3)
    done = compile_workflow(flow, spark, inputs={2: boxes})
    assert not done.blocked
    found = {(r["no"], r["box"], r["came"], r["again"]) for r in done.frame(14).collect()}
    assert found == {(100, "b2", 1, None), (101, None, 2, None), (102, "b1", 3, None), (None, "b2", None, 1), (None, "b1", None, 2)}


def test_first_rule_of_any_block_counts(spark):
    flow = load(document([node(1, "DbFileInput"), node(2, "DbFileInput"), node(3, "DynamicReplace"), node(4, "BrowseV2")], [(1, "", 3, "Values"), (2, "", 3, "Expressions"), (3, "", 4, "")]))
    rules = [("v", f"[v] = {i}", str(i + 1)) for i in range(450)] + [("v", "[v] = 3", "99"), ("w", "[v] >= 0", "w"), ("v", "[v] +", "0"), ("gone", "TRUE", "0")]
    done = compile_workflow(flow, spark, inputs={1: spark.createDataFrame([(3, "a"), (449, "b"), (600, None), (None, "c")], "v int, w string"), 2: spark.createDataFrame(rules, "f string, c string, x string")})
    assert sorted(map(tuple, done.frame(3).collect()), key=str) == sorted([(4, "w"), (450, "w"), (600, "w"), (None, "c")], key=str)
    assert done.frame(3, "Errors").count() == 2


def test_detours_meet(spark):
    for right, want in (("True", {("x", None, "seen")}), ("False", {("x", "kept", None)})):
        made = [node(1, "TextInput", '<Fields><Field name="a"/></Fields><Data><r><c>x</c></r></Data>'), node(2, "Detour", f'<DetourRight value="{right}"/>')]
        made += [node(i, "Formula", f'<FormulaFields><FormulaField field="{f}" expression="\'{f}\'" type="String"/></FormulaFields>') for i, f in ((3, "kept"), (4, "seen"))] + [node(5, "DetourEnd")]
        done = compile_workflow(load(document(made, [(1, "", 2, ""), (2, "Left", 3, ""), (2, "Right", 4, ""), (3, "", 5, "Left"), (4, "", 5, "Right")])), spark)
        assert set(map(tuple, done.frame(5).select("a", "kept", "seen").collect())) == want


def test_paths_are_all_made_or_counted():
    """A ladder of 18 rungs has 2 ** 18 paths; none is left out, and the number is known without making them."""
    links = [(i, "", j, "") for k in range(18) for i in (3 * k + 1,) for j in (i + 1, i + 2)] + [(j, "", 3 * k + 4, "") for k in range(18) for j in (3 * k + 2, 3 * k + 3)]
    graph = Graph(load(document([node(i, "Filter") for i in range(1, 56)], links)))
    assert graph.path_counts()[1] == 2**18 == sum(1 for _ in graph.paths())
    assert next(iter(graph.paths())) == tuple(x for k in range(18) for x in (3 * k + 1, 3 * k + 2)) + (55,)


def test_secrets_in_assignments():
    from weftline.plans.document import without_secrets

    assert without_secrets("host=h;PASSWORD = hush ;port=1") == "host=h;PASSWORD =[REDACTED] ;port=1"
    assert without_secrets("api_key='a b' token=t&x=1 plain=2") == "api_key=[REDACTED] token=[REDACTED]&x=1 plain=2"
    assert without_secrets("a = b, c == d; pwd=") == "a = b, c == d; pwd="


def test_offline_analysis(spark):
    flow = load(
        document(
            [
                node(1, "DbFileInput", "<File>gone.csv</File>", '<MetaInfo connection="Output"><RecordInfo><Field name="ID" type="Int32"/><Field name="A" type="V_String"/></RecordInfo></MetaInfo>'), node(2, "DbFileInput", "<File>gone2.csv</File>"),
                node(3, "Filter", "<Expression>[score] &gt; 1</Expression>"), node(4, "Join", '<JoinInfo connection="Left"><Field left="ID" right="key"/></JoinInfo>'), node(5, "BrowseV2"), node(6, "DbFileInput", "<File>gone3.csv</File>"), node(7, "BrowseV2"),
            ],
            [(1, "Output", 4, "Left"), (2, "Output", 3, ""), (3, "True", 4, "Right"), (4, "J", 5, ""), (6, "", 7, "")],
        )
    )
    done = compile_workflow(flow, spark, offline=True)
    assert done.frame(1).dtypes == [("ID", "int"), ("A", "string")] and done.frame(2).columns == ["score", "key"] and done.frame(6).columns == ["Record_Data"]
    assert not done.blocked and done.frame(4, "Join").columns == ["ID", "A", "score", "key"]
    assert {d.category for d in done.diagnostics if d.level == "INFO"} == {"external_dependency"}


def test_hooks_extensions_and_views(spark):
    from weftline.plans import compiler

    compiler.register("Shout", lambda t: {"Output": t.one.df.selectExpr("upper(a) as a")}, aliases=("Loud",))
    flow = load(document([node(1, "TextInput", '<Fields><Field name="a"/></Fields><Data><r><c>x</c></r></Data>'), node(2, "Loud"), node(3, "Python", "<Code>evil()</Code>")], [(1, "Output", 2, ""), (2, "", 3, "1")]))
    done = compile_workflow(flow, spark, hooks={3: lambda frames: {"1": frames[0].selectExpr("concat(a, '!') as a")}})
    assert rows(done.frame(3, "1")) == [("X!",)] and "Project" in done.describe(2)
    assert "tool_3_1" in done.register_views() and rows(spark.sql("select a from tool_3_1")) == [("X!",)]
    assert compile_workflow(flow, spark).blocked == {3}
    compiler.register("Whisper", lambda t: {"Output": t.one.df.selectExpr("lower(a) as a")}, prefix="Acme.Quiet.")
    compiler.register("Hush", lambda t: {"Output": t.one.df.limit(0)}, prefix="Acme.Quiet.Very")
    flow = load(document([node(1, "TextInput", '<Fields><Field name="a"/></Fields><Data><r><c>X</c></r></Data>'), node(2, "", plugin="Acme.Quiet.Tool9"), node(3, "", plugin="Acme.Quiet.VeryQuiet.Tool"), node(4, "", plugin="Acme.Quiet.Filter"), node(5, "", plugin="Other.Tool")], [(1, "", i, "") for i in (2, 3, 4, 5)]))
    done = compile_workflow(flow, spark)
    assert rows(done.frame(2)) == [("x",)] and rows(done.frame(3)) == [] and flow.tools[4].definition.name == "Filter" and 5 in done.blocked


def test_command(spark, tmp_path, capsys):
    import json

    from weftline.__main__ import main

    (tmp_path / "f.yxmd").write_bytes(document([node(1, "TextInput", '<Fields><Field name="a"/></Fields><Data><r><c>x</c></r></Data>'), node(2, "DbFileOutput", "<File>o.csv</File>")], [(1, "Output", 2, "")]))
    assert main([str(tmp_path / "f.yxmd"), "--run", str(tmp_path)]) == 0
    said = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert said["order"] == [1, 2] and said["schemas"] == {"1.Output": {"a": "string"}} and list((tmp_path / "o.csv").glob("*.csv"))
