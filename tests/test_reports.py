from arbordoc.__main__ import main
from arbordoc.operators import reports
from arbordoc.sources.parser import parse, write
from tests.test_schema import ORCHARD, SLOPE, schema


def test_refactors_keep_the_model():
    s = schema(ORCHARD)
    d = parse(SLOPE)
    plot = list(d.root.children())[2]
    out = reports.expand_last_atom(d, plot, s)
    assert "plot p2\n  keeper joe\n" in write(out) and reports.same_model(write(d), write(out), s)
    back = reports.inline_first_child(out, list(out.root.children())[2], s)
    assert write(back) == write(d)
    assert reports.inline_first_child(d, plot, s) is None


def test_completions():
    s = schema(ORCHARD)
    assert reports.completions(s, []) == ["title", "plot", "note", "apples", "pears"] and reports.completions(s, ["plot"], "t") == ["tree"] and reports.completions(s, ["nope"]) == []


def test_positions():
    s = schema(ORCHARD)
    ranges, keywords, highlights, completions, description, definition = reports.position(SLOPE, SLOPE.index("1998"), s)
    assert keywords == ["plot", "tree", "planted"] and ranges == [SLOPE.index("plot p1"), SLOPE.index("tree oak"), SLOPE.index("planted")]
    assert highlights == [SLOPE.index("planted")] and completions == ["label", "planted", "grafted"] and description is None and definition is None
    assert reports.position("", 0, s)[:2] == ([], [])


def test_command_line(tmp_path, capsys):
    (tmp_path / "s").write_text(ORCHARD)
    (tmp_path / "d").write_text(SLOPE + "zzz\n")
    (tmp_path / "lib").mkdir()
    assert main(["validate", str(tmp_path / "s"), str(tmp_path / "d")]) == 1 and "E306" in capsys.readouterr().out
    assert main(["add", str(tmp_path / "lib"), str(tmp_path / "s")]) == 0 and main(["list", str(tmp_path / "lib")]) == 0
    name, letters = capsys.readouterr().out.split()
    assert name == "orchard" and len(letters) == 33
    assert main(["signature", str(tmp_path / "s")]) == 0 and capsys.readouterr().out.strip() == letters
