"""Work that must not be repeated for each row, and tables that must be dealt to all cores."""

import pytest

from arbordoc import queries, queries_schemas
from arbordoc.operators import binary
from arbordoc.plans import patterns
from arbordoc.sources import schemas as S
from arbordoc.sources.parser import parse


class Inline:
    """Runs a mapInArrow function of a DataFrame's place here, on rows."""

    def __init__(self, *rows):
        self.rows, self.isStreaming = rows, False

    def per_row(self, df, columns, ddl, rows):
        return [r for values in self.rows for r in rows(*values)]


def test_a_pair_of_patterns_is_explored_once(monkeypatch):
    n = []
    explored = patterns._explored
    monkeypatch.setattr(patterns, "_explored", lambda *a: n.append(a) or explored(*a))
    assert [patterns.contained(["growth[0-4]"], r"growth\d") for _ in range(5)] == [True] * 5
    assert not patterns.contained([r"growth\d"], "growth[0-4]") and len(n) == 2
    for _ in range(2):
        with pytest.raises(patterns.NotProven):
            patterns.contained([r"growth\b."], "x")
    assert len(n) == 3


def counted(monkeypatch, module, name):
    n, f = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: n.append(a) or f(*a, **k))
    return n


def test_a_schema_inside_documents_is_read_once(monkeypatch):
    text = queries_schemas.PART_SCHEMA.replace("name part", "name growth")
    rows = Inline(*((str(i), f"name x{i}\n") for i in range(20)))
    monkeypatch.setattr(S, "per_row", rows.per_row)
    composed = counted(monkeypatch, binary, "compose")
    made = S.binary_documents(None, text, self_contained=True)
    back = [binary.decode_document(data, None)[0].children[0].text for _, _, data, _ in made]
    assert back == [f"x{i}" for i in range(20)] and len(composed) <= 2
    with pytest.raises(binary.BinaryError, match="B11"):  # a signature that is not the schema's, whatever was read before
        binary.decode_document(made[0][2][:4] + binary.encode_varint(33) + binary.stack_hashes([binary.blake3(b"x")]) + made[0][2][38:], None)


def test_a_task_resolves_an_identifier_once(monkeypatch):
    resolver = queries_schemas.library()
    monkeypatch.setattr(S, "per_row", Inline(*((str(i), f"tel 1.0 x.example/{'trade +more' if i % 2 else 'other'}\n\nname a\n") for i in range(20))).per_row)
    asked = counted(monkeypatch, resolver, "resolve")
    assert {(r[-2], r[-1]) for r in S.typed_documents(None, resolver)} == {("trade", "resolved"), (None, "not-found")}
    assert len(asked) == 2


def test_a_pair_of_schemas_is_compared_once(monkeypatch):
    head = "tel 1.0\n\nname growth\n\ndocument\n  field a String"
    monkeypatch.setattr(S, "per_row", Inline(*((str(i), head + "\n", head + (" optional\n" if i % 2 else "\n  field b String\n")) for i in range(20))).per_row)
    read = counted(monkeypatch, S, "read_schema")
    assert {(int(k) % 2, v) for k, v in S.subtypes(None)} == {(0, False), (1, True)}
    assert len(read) == 3


def test_a_schema_source_is_checked_once(monkeypatch):
    text = "tel 1.0\n\nname growth\n\ndocument\n  field a Nowhere\n  field a String\n"
    monkeypatch.setattr(S, "per_row", Inline(*((str(i), text) for i in range(20)), ("n", None)).per_row)
    read = counted(monkeypatch, S, "read_schema")
    found = S.schema_faults(None)
    assert {(k, c) for k, c, _ in found} >= {(str(i), c) for i in range(20) for c in ("E201", "E209")} and len(read) == 2


def test_one_row_group_is_dealt_to_all_cores(spark, tmp_path):
    path = str(tmp_path / "part.parquet")
    names = "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"
    spark.range(50_000).selectExpr("id AS p_partkey", "repeat(sha1(cast(id AS string)), 2) AS p_name", "'Brand#11' AS p_brand", "'x' AS p_type", "cast(id % 50 AS int) AS p_size", "1.5d AS p_retailprice").coalesce(1).write.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    docs = queries.part_documents(spark, str(tmp_path))
    for df in (queries.D.wide(docs, queries.PART), queries.D.elements(docs, queries.PART), queries.D.encode_documents(docs, queries.PART), S.binary_documents(docs, queries_schemas.PART_SCHEMA), queries.D.decode_documents(queries.D.encode_documents(docs, queries.PART), queries.PART)):
        assert df.rdd.getNumPartitions() >= 2 * cores
    assert queries.roundtrip_part(spark, str(tmp_path)).select(*names).exceptAll(spark.read.parquet(path).select(*names)).count() == 0


def test_an_edit_costs_one_pass_over_its_document(monkeypatch):
    from arbordoc.operators import edits
    from arbordoc.queries_texts import MARKED, STEPS

    passes = counted(monkeypatch, edits.Assigner, "assign")
    doc = parse("tel 1.0\n\nr Ann\n\nw 1\nw 2\nw 3  # old\n")
    assert edits.merge(doc, [edits.Edit.from_json(x, i, "a") for i, x in enumerate(STEPS)], MARKED) == []
    assert len(passes) <= 1 + len(STEPS) + 2  # set-flag tries two forms
    assert edits.write(doc).startswith("tel 1.0\n\nw 9\nw 5\nw 3\nw 1\nw end\nr Ann bold\nr last\n")


@pytest.mark.parametrize("agents", ["aa", "ab"])
def test_an_edit_of_nothing_changes_nothing(agents):
    from arbordoc.operators import edits

    doc = parse("w 1\nw 2\n")
    ops = ['{"op": "delete", "path": [[0, 7]]}', '{"op": "update-value", "path": [[0, 1]], "value": "3"}']
    assert len(edits.merge(doc, [edits.Edit.from_json(x, i, a) for i, (x, a) in enumerate(zip(ops, agents, strict=True))], None)) == 1
    assert edits.write(doc).endswith("w 1\nw 3\n")


def test_edits_are_folded_without_a_frame_for_each_document(spark):
    from arbordoc.operators import edits

    docs = spark.createDataFrame([("1", "w a\n"), ("2", None), ("2", "w c\n"), (None, "w d\n")], "source_id string, text string")
    ops = spark.createDataFrame([("1", 2, "a", '{"op": "update-value", "path": [[0, 0]], "value": "z"}'), ("1", 1, "b", '{"op": "update-value", "path": [[0, 0]], "value": "y"}'), ("1", 3, None, "x"), ("3", 1, "a", '{"op": "delete", "path": []}')], "source_id string, timestamp int, agent string, edit string")
    made = edits.merge_sources(docs, ops, None)
    assert "Pandas" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, made.collect()), key=str) == sorted([("1", "w z\n", 2, 0, 1, "merged"), ("2", None, 0, 0, 0, "repeated source"), ("2", "w c\n", 0, 0, 0, "repeated source"), ("3", None, 0, 1, 0, "no document"), (None, "w d\n", 0, 0, 0, "merged")], key=str)


def test_a_refactor_reads_few_texts(monkeypatch):
    from arbordoc.operators import reports
    from arbordoc.query_base import body

    s = body("c", "field contact Contact optional", *(f"field other{i} String optional" for i in range(30)), before="\nrecord Contact\n  field name String\n  field segment String\n")
    read = counted(monkeypatch, reports, "parse")
    doc = parse("tel 1.0\n\ncontact Ann BUILDING\n")
    target = doc.root.blocks[0].compounds[0]
    made = reports.expand_last_atom(doc, target, s)
    assert reports.write(made).endswith("contact Ann\n  segment BUILDING\n") and len(read) <= 3
    assert reports.inline_first_child(made, made.root.blocks[0].compounds[0], s) is not None


def test_views_of_structs_need_no_exchange(spark):
    from arbordoc.operators import checks

    texts = ["line 2 1\nline 1 2\n", "line 2\n  shipped 1\nzz\nline\n", "", "line 1 2\n  ordered 3\n"]
    docs = spark.createDataFrame([(str(i), x) for i, x in enumerate(texts)], "source_id string, text string")
    views = queries.D.struct_views(docs, queries.SHIPPED, "Line")
    assert "Exchange" not in views._jdf.queryExecution().executedPlan().toString()
    plain = lambda df: sorted((r["source_id"], r["elem_id"], tuple(sorted(r["fields"].items()))) for r in df.collect())
    elements = queries.D.elements(docs, queries.SHIPPED)
    assert plain(views) == plain(checks.struct_views(elements, "Line")) and len(plain(views)) == 4
    holds = lambda f: f["ordered"] <= f["shipped"]
    bad = checks.misfit_views(views, "line", holds)
    assert sorted(map(tuple, bad.collect())) == sorted(map(tuple, checks.misfit_structs(elements, "Line", "line", holds).collect())) and bad.count() == 2


def test_keys_are_compared_among_structs_alone(spark):
    from arbordoc.operators import checks

    docs = spark.createDataFrame([("a", "line l1 3\nline l1 4\nline l2 3\nline l1 3\n")], "source_id string, text string")
    some, every = queries.D.elements(docs, queries.ORDER, kinds=("struct",)), queries.D.elements(docs, queries.ORDER)
    assert some.count() == 5 and every.count() == 13
    found = [sorted(map(tuple, checks.duplicate_keys(e, queries.ORDER).collect())) for e in (some, every)]
    assert found[0] == found[1] and len(found[0]) == 2


def test_hashes_are_made_in_small_parts_where_documents_are_encoded(spark, monkeypatch):
    import pyarrow as pa

    from arbordoc.functions import hashes
    from arbordoc.query_base import body

    s = body("note", "field text String")
    docs = spark.createDataFrame([(str(i), "note\n" if i == 3 else f"text  a {'x' * i}\n") for i in range(50)], "source_id string, text string")
    h = queries.D.hash_documents(docs, s)
    assert h._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    old = queries.D.encode_documents(docs, s).select("source_id", "doc_ord", hashes.blake3_column("data").alias("hash"), "failure")
    assert sorted(map(str, h.collect())) == sorted(map(str, old.collect()))
    batch = pa.record_batch([pa.array(["x" * 100_000] * 100), pa.array(range(100))], ["a", "b"])
    made = list(queries.D.parts(batch))
    assert max(p.num_rows for p in made) <= 20 and pa.Table.from_batches(made).equals(pa.Table.from_batches([batch]))
