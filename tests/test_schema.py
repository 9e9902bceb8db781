"""Schemas, layers, patterns, hashes, the binary form, paths, edits and resolution."""

import pytest

from arbordoc.functions import hashes, letters, varints
from arbordoc.functions.registry import DECIMAL_VARINT, HEX_BYTES, Codecs
from arbordoc.operators import edits
from arbordoc.operators.assign import assign
from arbordoc.operators.binary import BinaryError, CannotEncode, decode_document, encode_document, encode_root, encode_self_contained, signature, value_hash
from arbordoc.operators.canonical import atom_form, canonical_text
from arbordoc.operators.edits import Edit, Editor, Refused, merge
from arbordoc.plans.compose import compose, in_declaration_order, is_subtype
from arbordoc.plans.paths import PathError, compile_path, resolve, same_path
from arbordoc.plans.patterns import contained, is_pattern, matches_whole
from arbordoc.plans.resolve import Identifier, Resolver, Unresolved
from arbordoc.plans.schema import META, check, construct, incoherent
from arbordoc.sources.parser import parse, write

ORCHARD = """tel 1.0

name orchard

scalar Year
  pattern [0-9]{4}

record Tree
  field label String key
  field planted Year optional
  field grafted Flag optional

record Plot
  field code Identifier key
  field keeper String optional
  field tree Tree optional repeatable

record Crate
  field code Identifier key
  field weight String

select Goods
  variant apples Crate
  variant pears Crate

document
  field title String
  field plot Plot repeatable
  field note String optional repeatable
  select Goods optional repeatable
"""
SLOPE = """tel 1.0

title  North slope
plot p1
  keeper ann
  tree oak
    planted 1998
  tree  old pear
    grafted
plot p2 joe
note wet
note dry

apples c1 12
pears c2 7
apples c3 9
"""
HEAD = "tel 1.0\n\nname s\n\n"


def root_of(text):
    d = parse(text)
    root, errors = assign(d, META)
    assert not d.errors and not errors, (d.errors, errors)
    return root


def schema(text):
    s, faults = compose(construct(root_of(text)))
    assert not faults, faults
    return s


def codes(s, text, **more):
    return [e.code for e in assign(parse(text), s, **more)[1]]


def test_schema_of_schemas_is_valid():
    assert not check(META) and not incoherent(META)


def test_pinned_hash_of_the_schema_of_schemas():
    """The schema of schemas, written as a document from its model, has the published size and hash."""
    lines = ["name tels"]

    def member(m):
        words = ["field", m.keyword, m.type] if m.kind == "field" else ["select", m.type]
        words += [x for x, on in (("optional", m.required == "loose"), ("required", m.required == "tight"), ("repeatable", m.repeatable == "loose"), ("irrepeatable", m.repeatable == "tight")) if on]
        return "  " + " ".join(words)

    for r in META.records:
        lines += [f"record {r.name}", "  description", f"      {r.description}", *map(member, r.members)]
    for s in META.selects:
        lines += [f"select {s.name}", "  description", f"      {s.description}", *(f"  variant {v.keyword} {v.type}" for v in s.variants)]
    lines += ["document", *map(member, META.document.members)]
    root = root_of("\n".join(lines) + "\n")
    assert construct(root) == META
    assert len(encode_root(root, META)) == 1741
    assert value_hash(root, META).hex() == "d440b01e327c62c41ac641047f2c4d8df3cbe94abb24db33f189226b7b8b7ad3"


@pytest.mark.parametrize(
    "text, code",
    [
        ("document\n  field a String\n  field a String\n", "E201"),
        ("document\n  field a String optional\n    default x\n", "E203"),
        ("document\n  field a String\nlayer\n  name one\nlayer\n  name one\n", "E204"),
        ("select P\n  variant a Flag\ndocument\n  field a String\nlayer\n  name one\n  overlay\n    select P optional\n", "E205"),
        ("document\n  field a String\nlayer\n  name one\n  overlay\n    field a Identifier\n", "E206"),
        ("document\n  field tel String\n", "E208"),
        ("document\n  field a Nowhere\n", "E209"),
        ("record R\n  field a String\nrecord R\n  field b String\ndocument\n  field a R\n", "E210"),
        ("select P\n  variant a Flag\ndocument\n  select P optional\nlayer\n  name one\n  select P\n    exclude z\n", "E211"),
        ("select P\n  variant a Flag\ndocument\n  select P\nlayer\n  name one\n  select P\n    exclude a\n", "E212"),
        ("select P\n  variant a Flag\ndocument\n  select P optional\nlayer\n  name one\n  select P\n    variant b Flag\n", "E213"),
        ("document\n  field a String\nlayer\n  name one\n  overlay\n    field a String optional\n", "E214"),
        ("document\n  field a String\nlayer\n  name one\n  overlay\n    field a String repeatable\n", "E215"),
        ("select P\n  variant a Flag\n  exclude a\ndocument\n  select P optional\n", "E216"),
        ("select P\n  variant a Flag\ndocument\n  field p P\n", "E217"),
        ("scalar C\n  validate string\n  encoding a\ndocument\n  field c C\nlayer\n  name one\n  scalar C\n    encoding b\n", "E218"),
        ("record R\n  field a String\ndocument\n  field r R key\n", "E219"),
        ("document\n  field a String optional key\n", "E220"),
        ("document\n  field a String key\n  field b String key\n", "E221"),
        ("scalar C\n  pattern (?=a)\ndocument\n  field c C\n", "E222"),
        ("scalar C\n  pattern [a-c]+\ndocument\n  field c C\nlayer\n  name one\n  scalar C\n    pattern [a-d]+\n", "E223"),
        ("scalar C\n  encoding a\ndocument\n  field c C\n", "E224"),
    ],
)
def test_schema_faults(text, code):
    d = parse(HEAD + text)
    s = construct(assign(d, META)[0])
    found = {f.code for f in (*check(s), *compose(s)[1])}
    assert code in found


def test_layers():
    s = construct(root_of(HEAD + "scalar C\n  pattern [A-Z]{2}-[0-9]{4}\nselect St\n  variant on Flag\n  variant off Flag\ndocument\n  field c C optional\n  select St optional\nlayer\n  name one\n  scalar C\n    pattern (EU|UK)-[0-9]{4}\n  overlay\n    field c C required\nlayer\n  name two\n  select St\n    exclude off\n  overlay\n    field extra String optional\n"))
    c, faults = compose(s)
    assert not faults and c.scalars[0].patterns == ("(EU|UK)-[0-9]{4}",) and [v.keyword for v in c.selects[0].variants] == ["on"]
    assert c.document.members[0].required == "tight" and c.document.members[-1].keyword == "extra"
    base, _ = compose(s, [])
    assert is_subtype(c, base) and not is_subtype(base, c)
    assert in_declaration_order(s, ["one", "two"]) and not in_declaration_order(s, ["two", "one"])


def test_patterns():
    assert contained(["(EU|UK)-[0-9]{4}"], "[A-Z]{2}-[0-9]{4}") and not contained(["[A-Z]+"], "[A-Z]{2}")
    assert contained(["a.*", ".*b"], "a.*b") and not contained(["a.*"], "a.*b")
    assert not any(map(is_pattern, [r"(a)\1", "(?<=a)b", "a{2000}", "(", "[b-a]", r"\8"]))
    assert matches_whole(r"(?i)ab\d+", "AB12") and not matches_whole("a", "ab") and not matches_whole(r"\d", "٣")
    assert matches_whole(r"\p{Lu}\pL*", "Éa") and matches_whole(r"[[:alpha:]-]+", "a-b")


TYPED = HEAD + "scalar Code\n  pattern [A-Z]{2}-[0-9]{4}\nselect St\n  variant active Flag\n  variant inactive Flag\nrecord R\n  field name Identifier\n  field bold Flag optional\n  field n String\ndocument\n  field r R optional repeatable\n  field code Code optional\n  field flag Flag optional\n  field word String optional\n  select St optional\n"


@pytest.mark.parametrize(
    "text, want",
    [
        ("r a x\n", []),
        ("r a bold x\n", []),
        ("word x\n  y\n", ["E301"]),
        ("r a bold x y\n", ["E302"]),
        ("word  a b  c d\n", ["E302"]),
        ("zzz\n", ["E306"]),
        ("r a\n", ["E307"]),
        ("word a\nword b\n", ["E308"]),
        ("r a x\nword y\nr b x\n", ["E309"]),
        ("r A x\n", ["E310"]),
        ("flag x\n", ["E311"]),
        ("code EU-12345\n", ["E315"]),
        ("code EU-1234\n", []),
        ("active\ninactive\n", ["E308"]),
    ],
)
def test_validation(text, want):
    assert codes(schema(TYPED), text) == want


def test_atom_phase():
    s = schema(HEAD + "select St\n  variant up Flag\n  variant down Flag\nrecord In\n  field x String\nrecord A\n  field a Flag\n  field b Flag optional\n  field in In optional\n  field c String\nrecord B\n  select St\nrecord C\n  field in In\n  field y String\ndocument\n  field p A optional\n  field q B optional\n  field r C optional\n")
    root, errors = assign(parse("p a xyz\n"), s)
    assert not errors and [(c.keyword, c.text) for c in root.children[0].children] == [("a", None), ("c", "xyz")]
    assert codes(s, "p nope xyz\n")[0] == "E305" and "E304" in codes(s, "q sideways\n") and "E303" in codes(s, "r v\n")


def test_keys_and_defaults():
    s = schema(ORCHARD)
    assert not codes(s, SLOPE)
    assert codes(s, SLOPE + "pears c1 3\n") == ["E314"] and codes(s, SLOPE.replace("plot p2", "plot p1")) == ["E314"]
    assert not codes(s, SLOPE.replace("title  North slope", "title p1"))
    d = schema(HEAD + "document\n  field name String\n    default none\n")
    root, errors = assign(parse(""), d)
    assert not errors and root.children[0].text == "none" and root.children[0].origin == "default"


def test_codecs_and_struct_validators():
    s = schema(HEAD + "scalar D\n  validate string\n  encoding hex-bytes\nrecord E\n  field from String\n  field to String\n  validate ordered\ndocument\n  field d D optional\n  field e E optional repeatable\n")
    bound = Codecs({"hex-bytes": HEX_BYTES})
    rules = {"string": lambda v: None, "ordered": lambda v: None if v.scalar("from") <= v.scalar("to") else {"to": "too early"}}
    assert codes(s, "d ab\n", codecs=bound) == [] and codes(s, "d xy\n", codecs=bound) == ["E312"] and codes(s, "d ab\n", codecs=Codecs({})) == ["E313"]
    assert codes(s, "e a b\ne c b\n", validators=rules) == ["E310"] and codes(s, "e c b\n", validators=None) == []
    for answer, n in (({"from": "a", "to": "b"}, 2), ({"gone": "x"}, 1), ({}, 1), (7, 1), ({"e": {"from": "x", "to": "y"}}, 1)):
        assert codes(s, "e a b\n", validators=rules | {"ordered": lambda v, answer=answer: answer}) == ["E310"] * n
    root, _ = assign(parse("d abcd\n"), s)
    assert encode_root(root, s, bound).hex() == "010002abcd"
    with pytest.raises(CannotEncode):
        encode_root(root, s)
    for codec, text in ((HEX_BYTES, "00ff"), (DECIMAL_VARINT, "300")):
        assert codec.decode(codec.encode(text)) == text and codec.encode("x!") is None
    assert DECIMAL_VARINT.decode(b"\x80\x00") is None


def test_binary():
    greeting = HEAD + "document\n  field text String\n  field bold Flag optional\n"
    s, sr = schema(greeting), root_of(greeting)
    root, _ = assign(parse("bold\ntext  hello, world\n"), s)
    assert encode_root(root, s) == bytes.fromhex("02000c") + b"hello, world" + b"\x01"
    other, _ = assign(parse("text\n      E\nhello, world\n      E\n\n# c\nbold\n"), s)
    assert value_hash(root, s) == value_hash(other, s)
    data = encode_document(root, s, signature(sr))
    assert encode_root(decode_document(data, s)[0], s) == encode_root(root, s)
    whole = encode_self_contained(root, sr)
    assert canonical_text(decode_document(whole, None)[0]) == canonical_text(root)
    tail = data[38:]

    def code(x, schema=s):
        with pytest.raises(BinaryError) as e:
            decode_document(x, schema)
        return e.value.code

    assert code(b"\0" + data) == "B01" and code(data[:4] + b"\x22" + data[5:]) == "B03" and code(data[:20]) == "B09" and code(data + b"\0") == "B08"
    assert code(data[:38] + b"\x01\x09") == "B05" and code(data[:38] + b"\x01\x00\x63a") == "B06" and code(data[:38] + b"\x01\x00\x01\xff") == "B07"
    assert code(data[:38] + b"\x80" * 12) == "B02" and len(tail) == 16
    broken = bytearray(whole)
    broken[6] ^= 1
    broken[37] ^= 1
    assert code(bytes(broken), None) == "B11" and code(whole[:38] + b"\x01\x63" + whole[40:], None) == "B12"


def test_canonical_text_is_a_fixed_point():
    s = schema(ORCHARD)
    root, _ = assign(parse(SLOPE), s)
    text = canonical_text(root)
    again, errors = assign(parse(text), s)
    assert not errors and canonical_text(again) == text and encode_root(again, s) == encode_root(root, s)
    note = schema(HEAD + "document\n  field t String\n")
    for value in ("", "a", "a b", "a  b", " a", "a\nb", "a\n\nb", "a \nb", "\n", "# x", "      ---\n---", "a\n      ---\n      ----"):
        from arbordoc.operators.assign import Element

        e = Element("", None, None, "struct", "", children=[Element("t", 0, 0, "scalar", "String", value)])
        back, errors = assign(parse(canonical_text(e)), note)
        assert not errors and back.children[0].text == value, (value, atom_form(value))


def test_blake3():
    assert hashes.blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    data = bytes(i % 251 for i in range(5000))
    # published vectors for inputs of repeating bytes 0 to 250
    assert hashes.blake3(data[:1024]).hex().startswith("42214739f095a406f3fc83deb889744a")
    assert hashes.blake3(data[:1025]).hex().startswith("d00278ae47eb27b34faecf67b4fe263f")
    assert hashes.blake3(data[:3072]).hex().startswith("b98cb0ff3623be03326b373de6b90952")
    assert hashes.blake3_many([data[:1], data[:4096], b""]) == [hashes.blake3(data[:1]), hashes.blake3(data[:4096]), hashes.blake3(b"")]


def test_stacks():
    hs = [hashes.blake3(bytes([i])) for i in range(6)]
    library = hashes.HashLibrary(hs)
    for n in range(1, 6):
        s = hashes.stack_hashes(hs[:n])
        assert len(s) == (33 if n == 1 else 37 + 2 * (n - 2)) and hashes.unstack(s, library) == hs[:n] and hashes.parameters(s) == (4, 2, 32, n)
    assert hashes.unstack(hashes.stack_hashes(hs[:2]), hashes.HashLibrary(hs[:1])) is None and hashes.cadence_byte(4, 2, 32) == 0x79
    with pytest.raises(ValueError):
        hashes.stack_hashes([])


def test_codes():
    assert letters.from_letters(letters.to_letters(bytes(range(256)))) == bytes(range(256))
    assert letters.from_letters_strict("aé!") == (None, [1, 2])
    for n, text in ((0, "00"), (127, "7f"), (128, "8001"), (255, "ff01"), (16383, "ff7f"), (16384, "808001")):
        assert varints.encode_varint(n).hex() == text and varints.decode_varint(bytes.fromhex(text)) == (n, len(text) // 2)


@pytest.mark.parametrize(
    "path, status, text",
    [
        ("/", "element", None),
        ("/title", "element", "North slope"),
        ("/plot", "occurrences", None),
        ("/plot/p1/keeper", "element", "ann"),
        ("/plot/1/keeper", "element", "joe"),
        ("/plot/p1/tree/0/planted", "element", "1998"),
        ("/plot/p1/tree/old pear/label", "element", "old pear"),
        ("/note/1", "element", "dry"),
        ("/apples/c3/weight", "element", "9"),
        ("/apples/1/weight", "element", "9"),
        ("/pears/0/weight", "element", "7"),
        ("/goods", "unknown keyword", None),
        (":plot:p2:code", "element", "p2"),
        ("/plot/004", "index out of range", None),
        ("/plot/p2/tree/0", "index out of range", None),
        ("/plot/zed", "key not found", None),
        ("/plot/p1/tree/oak/grafted", "absent member", None),
        ("/title/x", "non-struct descent", None),
        ("/plot//x", "syntax", None),
        ("-a", "syntax", None),
    ],
)
def test_paths(path, status, text):
    s = schema(ORCHARD)
    o = resolve(path, s, assign(parse(SLOPE), s)[0])
    assert o.status == status
    if text:
        assert o.elements[0].text == text


def test_path_identity():
    assert same_path(".a.b", "/a/b") and not same_path("/a", "/a/b")
    with pytest.raises(PathError):
        compile_path("/note/x", schema(ORCHARD))


def test_edits():
    s = schema(ORCHARD)
    d = parse(SLOPE)
    e = Editor(d, s)
    e.apply(Edit("update-value", ((0, 1), (0, 0)), "two words"))
    e.apply(Edit("attach-remark", ((0, 0),), "hi"))
    e.apply(Edit("insert", (), compound="note late"))
    e.apply(Edit("reorder-within-group", ((0, 1),), index=1))
    e.apply(Edit("replace", ((1, 0),), compound="pears c9 4"))
    e.apply(Edit("insert-after", ((1, 0),), compound="apples c8 1"))
    e.apply(Edit("delete", ((1, 3),)))
    assert write(d) == "tel 1.0\n\ntitle  North slope  # hi\nplot p2 joe\nplot p1\n  keeper  two words\n  tree oak\n    planted 1998\n  tree  old pear\n    grafted\nnote wet\nnote dry\nnote late\n\npears c9 4\napples c8 1\npears c2 7\n"
    before = write(d)
    for bad, code in ((Edit("delete", ((0, 0),)), "E307"), (Edit("insert", (), compound="plot p1"), "E314"), (Edit("insert", (), compound="zzz"), "E306"), (Edit("update-value", ((0, 1),), "Not Ok"), "E310"), (Edit("delete", ((9, 9),)), "unresolved"), (Edit("delete", ((0, -1),)), "unresolved")):
        with pytest.raises(Refused) as r:
            e.apply(bad)
        assert r.value.code == code and write(d) == before


def test_flags_groups_and_tables():
    s = schema(HEAD + "record R\n  field name String\n  field bold Flag optional\ndocument\n  field r R optional repeatable\n  field w String optional repeatable\n")
    d = parse("r x\n\nw 1\n")
    e = Editor(d, s)
    e.apply(Edit("set-flag", ((0, 0),), keyword="bold"))
    assert write(d) == "r x bold\n\nw 1\n"
    e.apply(Edit("unset-flag", ((0, 0),), keyword="bold"))
    e.apply(Edit("reorder-groups", (), keyword="w", other="r", index=0))
    assert write(d).startswith("w 1\n")
    t = parse("# ID  # Name\na     xy\nb     zzzz\n\n")
    t.root.blocks[0].compounds[0].keyword = "longer-key"
    edits.resize(t.root.blocks[0], 0)
    assert not parse(write(t)).errors and edits.minimal_offsets(0, [10, 4], [2, 4]) == [0, 12]


def test_update_escalates():
    d = parse("a x\nb\n    s\n")
    e = Editor(d, None)
    for value, form in (("y z", "inline"), ("l1\nl2", "source"), ("q", "source"), ("a\n\nb", "literal"), ("q", "literal")):
        e.apply(Edit("update-value", ((0, 0),), value))
        atom = next(d.root.children()).atoms[0]
        assert (atom.form, atom.text) == (form, value)
        assert next(parse(write(d)).root.children()).atoms[0].text == value


def test_merge_converges():
    s = schema(ORCHARD)
    ops = [Edit("update-value", ((0, 3),), "x1", timestamp=1, agent="a"), Edit("delete", ((0, 1),), timestamp=2, agent="b"), Edit("attach-remark", ((0, 1), (0, 0)), "r", timestamp=3, agent="a"), Edit("update-value", ((0, 3),), "x2", timestamp=4, agent="a")]
    one, two = parse(SLOPE), parse(SLOPE)
    assert [e.timestamp for e in merge(one, ops, s)] == [3]
    merge(two, ops[::-1], s)
    assert write(one) == write(two) and "note x2" in write(one) and "Merge conflict (agent a, ts=3)" in write(one)


def test_construct():
    s = schema(ORCHARD)
    root, _ = assign(parse(SLOPE), s)
    from arbordoc.sources.parser import Block, Document

    d = Document()
    d.root.blocks = [Block(compounds=[edits.construct(c, s) for c in root.children])]
    again, errors = assign(parse(write(d)), s)
    assert not errors and encode_root(again, s) == encode_root(root, s)


def test_resolution():
    r = Resolver(fetch={"x.org/orchard:1.0.0": ORCHARD}.get, built_in=("x.org/own:1.0.0",))
    assert r.resolve(Identifier("x.org/own:1.0.0")) == META
    with pytest.raises(Unresolved, match="not-found"):
        r.resolve(Identifier("x.org/orchard"))
    assert r.resolve(Identifier("x.org/orchard:1.0.0")).name == "orchard"
    layered = HEAD.replace("name s", "name layered") + "document\n  field a String\nlayer\n  name one\n  overlay\n    field b String optional\nlayer\n  name two\n  overlay\n    field c String optional\n"
    k = r.add(layered)
    _, sign, ordered = r.selected(k, ["one", "two"])
    other = Resolver()
    other.add(layered)
    assert len(sign) == 39 and ordered and [m.keyword for m in other.resolve(Identifier(signature=sign)).document.members] == ["a", "b", "c"]
    for wanted, kind in ((Identifier("x.org/layered", ("none",)), "unknown-layer"), (Identifier("x.org/layered", ("two",), sign), "mismatch"), (Identifier("x.org/gone:1.0.0"), "fetch-failed"), (Identifier(signature="Ḁ" * 33), "undecodable")):
        with pytest.raises(Unresolved, match=kind):
            other.resolve(wanted)


def test_edits_by_json():
    assert Edit.from_json('{"op": "delete", "path": [[0, 1]]}', 3, "a") == Edit("delete", ((0, 1),), timestamp=3, agent="a")
    for bad in ("", "[]", '{"op": "delete", "path": [[0]]}', '{"op": "explode"}', '{"op": "delete", "what": 1}', "{"):
        with pytest.raises(ValueError):
            Edit.from_json(bad)


def test_deep_documents():
    """Nesting has no limit of its own: each walk over a document is without recursion, or bound by memory alone."""
    s = schema(HEAD + "record Node\n  field n Node optional\n  field v String optional\ndocument\n  field n Node optional\n")
    text = "".join("  " * i + "n\n" for i in range(1500)) + "  " * 1500 + "v x\n"
    root, errors = assign(parse(text), s)
    assert not errors and canonical_text(root) == "tel 1.0\n" + text
    data = encode_root(root, s)
    assert len(data) == 1 + 2 * 1499 + 2 + 3 and encode_root(decode_document(encode_document(root, s, signature(root_of(ORCHARD))), s)[0], s) == data
