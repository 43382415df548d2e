import pytest

from loomlake.sources import readers
from loomlake.operators import graph


def test_rules(spark, tmp_path):
    path = tmp_path / "query.xml"
    path.write_text('<query><rule class="cc" name="//src/a:x"><rule-input name="//src/b:y"/><rule-input name="//src/c:z"/></rule><rule class="cc" name="//src/b:y"></rule></query>')
    rows = {r.name: r.inputs for r in readers.rules(spark, str(path)).collect()}
    assert rows == {"//src/a:x": ["//src/b:y", "//src/c:z"], "//src/b:y": []}
    nodes, edges = graph.adjacency(readers.rules(spark, str(path)), ["//src"])
    assert nodes.count() == 3 and edges.count() == 2


def test_actions(spark, tmp_path):
    path = tmp_path / "actions.json"
    path.write_text('{"actions": [{"arguments": ["cc", "-c", "a.cc"]},\n {"other": 1}]}')
    assert [(r.ordinal, r.arguments) for r in readers.actions(spark, str(path)).collect()] == [(0, ["cc", "-c", "a.cc"]), (1, [])]


def test_key_values(spark, tmp_path):
    first, second = tmp_path / "a.txt", tmp_path / "b.txt"
    first.write_text("A 1\nB two words\n\nA 3\n")
    second.write_text("B over\r\n")
    assert {r.key: r.value for r in readers.key_values(spark, str(first), str(second)).collect()} == {"A": "3", "B": "over"}
    second.write_text("lonely\n")
    with pytest.raises(Exception, match="KEY VALUE"):
        readers.key_values(spark, str(second)).collect()


def test_whole_texts_and_writers(spark, tmp_path):
    (tmp_path / "in.txt").write_text("x\ny")
    rows = readers.whole_texts(spark, str(tmp_path / "in.txt"))
    assert rows.first().text == "x\ny"
    readers.write_json(rows.selectExpr("text", "cast(null as string) as n"), str(tmp_path / "json"))
    assert '"n":null' in "".join(p.read_text() for p in (tmp_path / "json").glob("part*"))
    readers.write_lines(rows.selectExpr("'one' as line"), "line", str(tmp_path / "lines"))
    assert "".join(p.read_text() for p in (tmp_path / "lines").glob("part*")) == "one\n"
