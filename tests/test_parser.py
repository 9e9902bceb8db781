"""The parser, code by code, on hand-written documents."""

import pytest

from arbordoc.sources.parser import decode_bytes, parse, parse_stream, write


def codes(text):
    return [e.code for e in parse(text).errors]


def keywords(c):
    return [(x.keyword, keywords(x)) for x in c.children()]


def test_tree():
    d = parse("tel 1.0\n\na x\n  b  two words  three\n    c\n  d\ne\n")
    assert keywords(d.root) == [("a", [("b", [("c", [])]), ("d", [])]), ("e", [])]
    a = next(d.root.children())
    b = next(a.children())
    assert [(x.text, x.spaces) for x in a.atoms] == [("x", 1)]
    assert [(x.text, x.spaces) for x in b.atoms] == [("two words", 2), ("three", 2)]
    assert not d.errors


@pytest.mark.parametrize(
    "text, want",
    [
        ("﻿a\n", ["E101"]),
        ("a\ntel 1.0\n", ["E102"]),
        ("#!" + "x" * 5000 + "\ntel 1.0\na\n", ["E103"]),
        ("tel\n", ["E104"]),
        ("tel 1\n", ["E104"]),
        ("tel -1.0\n", ["E104"]),
        ("tel 1.0 (\n", ["E105"]),
        ("tel 1.0 a\n", ["E105"]),
        ("  a\nb\n", ["E106"]),
        ("a\n   b\n", ["E107"]),
        ("a \n", ["E108"]),
        ("a\n# c\nb\n", ["E109"]),
        ("a\n\n# c\nb\n", []),
        ("a\n  # c\n  b\n", []),
        ("a\n          b\n", ["E111"]),
        ("# c\n  b\n", ["E112"]),
        ("# A  # B\nr    x\n  child\n", ["E112"]),
        ("a\n      END\nx\n      END\n    source\n", ["E113"]),
        ("a\n      END\nx\n      END\n      FIN\ny\n      FIN\n", ["E114"]),
        ("a\n      END\nx\n", ["E115"]),
        ("# A  # B\n  r  x\n", ["E116"]),
        ("# A  # B\nr      x\n", ["E117"]),
        ("# A  # B  # C\nr    longer  x\n", ["E118", "E117"]),
        ("# A  # b # c  # d\n", ["E119"]),
        ("#A  # B\n", ["E119"]),
        ("a\nb\r\n", ["E120"]),
        ("a\r\nb\n", ["E120"]),
        ("tel 1.0 what %\n", ["E121"]),
        ("tel 1.0 +a x.org/b\n", ["E122"]),
        ("tel 1.0 x.org/b:1.2.3 +a +b %\n", []),
    ],
)
def test_errors(text, want):
    assert sorted(codes(text)) == sorted(want)


def test_recovery():
    """What the specification leaves open, as it is handled here."""
    found = lambda t: [(e.code, e.start, e.end) for e in parse(t).errors]
    # one error for a pragma line, however many of its phrases are at fault
    assert found("tel 1.0 who what why\nx\n") == [("E121", 0, 20)] and found("tel 1.0 +b a.org/c d.org/e\n") == [("E122", 0, 26)]
    # a second literal atom that nothing closes is its opening line alone
    d = parse("a\n      X\none\n      X\n      Y\nb\n")
    assert [(e.code, e.start, e.end) for e in d.errors] == [("E114", 22, 29)] and keywords(d.root) == [("a", []), ("b", [])]
    # trailing spaces of a row are a gap that ends at no column, too
    assert found("# A  # B\nr    x   \n") == [("E108", 15, 18), ("E117", 15, 18)]
    # E106 spans the leading spaces, which is what the specification asks for, not the characters that the margin cuts off
    assert found("   a\n b\n") == [("E106", 5, 6)] and found("   a\nb\n") == [("E106", 5, 5)]
    # E119 spans from the marker to the next one or to the end of the line
    assert found("#A  # B\n") == [("E119", 0, 4)] and found("# A  # b # c  # d\n") == [("E119", 5, 14)]


def test_spans():
    assert [(e.code, e.start, e.end) for e in parse("a\n  b  \n").errors] == [("E108", 5, 7)]
    assert [(e.code, e.start, e.end) for e in parse("a\n   b\n").errors] == [("E107", 2, 5)]


def test_source_atom():
    d = parse("a\n    one  \n\n      two\n\nb\n")
    a, b = d.root.children()
    assert a.atoms[0].form == "source" and a.atoms[0].text == "one\n\n  two" and b.keyword == "b"


def test_literal_atom():
    d = parse("a\n      END\n  raw \n##\n\nEND\n      END\n  child\n")
    a = next(d.root.children())
    assert a.atoms[0].text == "  raw \n##\n\nEND" and a.atoms[0].delimiter == "END"
    assert keywords(a) == [("child", [])]
    assert next(parse("a\n      E\n      E\n").root.children()).atoms[0].text == ""


def test_literal_keeps_carriage_returns():
    d = parse("a\r\n      E\r\nx\ry\r\n      E\r\n")
    assert next(d.root.children()).atoms[0].text == "x\ry\r" and not d.errors


def test_remarks():
    c = next(parse("a x  # note  here\n").root.children())
    assert c.remark == "note  here" and [a.text for a in c.atoms] == ["x"]
    assert next(parse("a  b # c\n").root.children()).atoms[0].text == "b # c"
    assert next(parse("a #\n").root.children()).remark is None


def test_streams():
    docs = list(parse_stream("tel 1.0 %\n\na\n##\nb\n%%\nc\n##\n##\nd\n##\n\n"))
    assert [keywords(d.root) for d in docs] == [[("a", []), ("##", []), ("b", [])], [("c", [])], [], [("d", [])]]
    bad = list(parse_stream("a\n          b\n##\nc\n"))
    assert [[e.code for e in d.errors] for d in bad] == [["E111"], []]


def test_bytes():
    text, errors = decode_bytes(b"a \xff\xfe b\xe2\x82\n")
    assert text == "a �� b�\n" and [(e.code, e.start) for e in errors] == [("E123", 2), ("E123", 3), ("E123", 6)]


def test_schema_aware_recovery():
    admits = lambda path, keyword: (tuple(path), keyword) in {((), "a"), (("a",), "b"), (("a", "b"), "c")}
    assert keywords(parse("a\n  b\n   c\n", admits).root) == [("a", [("b", [("c", [])])])]
    assert keywords(parse("a\n  b\n   c\n").root) == [("a", [("b", []), ("c", [])])]


@pytest.mark.parametrize("text", ["tel 1.0\n\n# c\na x  # r\n  b\n\n  c\n    src\n      more\nd\n      E\nlit\n      E\n", "# A   # B\nr1    x\nr2    y z\n\nq\n", "#!/bin/x\na\n"])
def test_presentation_round_trip(text):
    def clean(c):
        c.start = 0
        for x in c.children():
            clean(x)
        return c

    first = parse(text)
    assert not first.errors
    assert clean(parse(write(first)).root) == clean(first.root)
