import pytest
from pyspark.sql import functions as F

import tabletools as tt


@pytest.fixture
def texts(spark):
    def build(*values):
        return spark.createDataFrame(list(enumerate(values)), "id bigint, text string")
    return build


def test_tagged_json(texts):
    df = texts('a\nCHARTS: [{"chart_type":"bar","x_axis":"x","y_axis":""},3,{"chart_type":"odd"}]\n',
               'charts: [{"chart_type":"line"}]\n  Charts: [{"chart_type":" PIE ","title":"T"}]  ',
               "CHARTS: [broken", 'CHARTS: {"chart_type":"bar"}', "no tag", "", "CHARTS:",
               'CHARTS: ["{\\"chart_type\\":\\"bar\\"}"]')
    rows = [tuple(r) for r in tt.extract_tagged_json(df).orderBy("id", "pos").collect()]
    assert rows == [(0, 0, "bar", "x", None, "Chart"), (1, 0, "pie", None, None, "T")]


def test_strip_tagged_line(texts):
    df = texts("a\n\n b\n \nCHARTS: []\nafter", "kept\n\n", "charts:x", "\n\nCHARTS:", "a\r\nb\r\nCHARTS: 1", None)
    assert [r.text for r in tt.strip_tagged_line(df).orderBy("id").collect()] == ["a\n\n b", "kept\n\n", "", "", "a\nb", None]


def test_slides(texts):
    df = texts('x [{"title":"A","bullets":["b","",null,2]}, 7, {"bullets":" l1 \\n\\nl2"}, {"title":"C","bullets":{"k":1}}, {}] y',
               "nothing", "[1, 2", '{"title":"A"}', 'a ["x"] b [{"title":"q"}]')
    rows = [tuple(r) for r in tt.extract_slides(df).orderBy("id", "pos").collect()]
    assert rows == [(0, 0, "A", ["b", "2"]), (0, 2, "Slide", ["l1", "l2"]), (0, 3, "C", []), (0, 4, "Slide", [])]
    last = tt.section_map(tt.extract_slides(texts('[{"title":"A","bullets":["1"]},{"title":"A","bullets":["2"]}]')))
    assert [tuple(r) for r in last.collect()] == [(0, "A", ["2"])]


def test_blocks(texts):
    df = texts("# A\n## # B #\n### C\n\n- x\n* y\n**z**\n**\n```py```\n    code\n#nospace\n  end　")
    rows = [(r.kind, r.content) for r in tt.markdown_blocks(df).orderBy("pos").collect()]
    assert rows == [("h1", "A"), ("h1", "# B #"), ("h2", "C"), ("blank", ""), ("bullet", "x"), ("bullet", "y"),
                    ("bold", "z"), ("bold", ""), ("code", "py```"), ("body", "code"), ("body", "#nospace"), ("body", "end")]


def test_sections(texts):
    many = "\n".join(f"- b{i}" for i in range(9))
    df = texts(f"before\n# One\n{many}\n## Two\n{'w' * 200}\n### sub\n#tag\n  * s  \n\n# Three", "plain", "")
    rows = [tuple(r) for r in tt.markdown_sections(df).orderBy("id", "pos").collect()]
    assert rows == [(0, 0, "One", [f"b{i}" for i in range(9)]), (0, 1, "Two", ["w" * 200, "s"]), (0, 2, "Three", [])]
    cut = [tuple(r) for r in tt.markdown_sections(df, max_bullets=6, max_chars=120).orderBy("id", "pos").collect()]
    assert cut == [(0, 0, "One", [f"b{i}" for i in range(6)]), (0, 1, "Two", ["w" * 120, "s"]), (0, 2, "Three", [])]


def test_section_lines_drop_repeats_of_the_last_kept_line(texts):
    df = texts("## Plan\nfirst\nfirst\nfirst\nnew first\nfirst\n- first\nfirst\n12345\n7\n\nplan\nend\n# Other\nlost",
               "### PLAN ###\nno match", "Plan\n" + "\n".join(f"{i} line" for i in range(12)), "# Other\nx")
    rows = {r.id: r.lines for r in tt.section_lines(df, "plan").collect()}
    assert rows == {0: ["first", "first", "new first", "- first", "12345", "7", "end"], 1: [], 3: [],
                    2: [f"{i} line" for i in range(12)]}
    cut = {r.id: r.lines for r in tt.section_lines(df, "plan", max_lines=3).collect()}
    assert cut == {0: ["first", "first", "new first"], 1: [], 3: [], 2: ["0 line", "1 line", "2 line"]}


def test_recommendations(texts):
    reports = texts("# Recommendations\nr\n# Actionable business recommendations\na", "## Recommendations\nr", "none",
                    "# Recommendations\n# Next", "none")
    slides = tt.extract_slides(texts("-", "-", '[{"title":" recommendations ","bullets":["s"]},{"title":"Recommendations","bullets":["t"]}]',
                                     '[{"title":"Recommendations","bullets":["u"]}]', "-"))
    rows = {r.id: (r.source, r.bullets) for r in tt.recommendations(reports, slides).collect()}
    assert rows == {0: ("Actionable Business Recommendations", ["a"]), 1: ("Recommendations", ["r"]),
                    2: ("slides", ["s"]), 3: ("slides", ["u"])}


@pytest.mark.parametrize("mode,limit,expected", [
    ("content", None, ["a", "1) b", "c", "2. d", "3. e", "4. f"]), ("content", 8, ["a", "1) b", "c"]),
    ("chart", 7, ["a", "1) b", "c"]), ("recommendations", 6, ["a", "b", "", "c", "d", "e"]),
    ("recommendations", None, ["a", "b", "", "c", "d", "e", "f"])])
def test_bullets(spark, mode, limit, expected):
    raw = ["- a", " ", "1) b", "-*", "• › c", "", " ", "", "2. d", "3. e", "4. f"]
    df = spark.createDataFrame([(raw,)], "b array<string>")
    assert df.select(tt.clean_bullets(F.col("b"), mode, limit)).first()[0] == expected


def test_json_is_read_as_a_whole(texts):
    tagged = texts('CHARTS: [{"chart_type":"bar"}] done', 'CHARTS: [{"chart_type":"bar"}]]', 'CHARTS: [{"chart_type":"bar"}], "b": 1',
                   'CHARTS: [{"chart_type":"bar","chart_type":"pie"}]', 'CHARTS: [{"chart_type":"bar"}] \t',
                   'CHARTS: [{"chart_type":"bar","x_axis":0,"y_axis":false}]', 'CHARTS: [{"chart_type":"bar","x_axis":"0","y_axis":"false"}]',
                   "CHARTS: [{'chart_type':'bar'}]", "CHARTS: [{\"chart_type\":\"bar\"},]")
    rows = [(r.id, r.chart_type, r.x_axis, r.y_axis) for r in tt.extract_tagged_json(tagged).orderBy("id").collect()]
    assert rows == [(3, "pie", None, None), (4, "bar", None, None), (5, "bar", None, None), (6, "bar", "0", "false")]
    slides = texts('[{"title":"a"}] then [b]', '[{"title":"a","title":"b","bullets":["0","false",0,false,0.0,"",[],{},null,true,7,"x"]}]')
    rows = [(r.id, r.title, r.bullets) for r in tt.extract_slides(slides).collect()]
    assert rows == [(1, "b", ["0", "false", "true", "7", "x"])]


def test_recommendations_do_not_repeat_the_texts(texts):
    plan = tt.recommendations(texts("# Recommendations\na"), tt.extract_slides(texts("-")))._jdf.queryExecution().toString()
    assert "posexplode(array(" not in plan.lower()


def test_texts_stay_in_their_rows(texts):
    for df in (tt.markdown_sections(texts("# a")), tt.section_lines(texts("# a"), "a"), tt.extract_slides(texts("[]"))):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
