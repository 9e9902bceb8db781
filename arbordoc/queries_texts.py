"""Queries about texts: syntax with its errors and spans, atoms, validators, edits, refactors, tools and file sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import varints
from .operators import canonical, checks, edits, reports
from .plans.schema import META
from .queries import CUSTOMER, customer_documents
from .query_base import as_documents, body, field, key_of, load, query, schema_of
from .queries_schemas import case, nth
from .sources import documents as D
from .sources import schemas as S
from .sources.parser import PRAGMA
from .sources.storage import new_path, saved
from .streaming import documents as stream


def raw(df: DataFrame, key: str, *parts: Column) -> DataFrame:
    """(source_id, text) of parts put together as they are."""
    return df.select(F.col(key).cast("string").alias("source_id"), F.concat(*parts).alias("text"))


def spans(errors: DataFrame, key: str) -> DataFrame:
    return errors.select(key_of(key), "code", "span_start", "span_end")


@query("SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '      ---' ELSE '' END AS text, CASE WHEN doc_id % 3 = 0 THEN '----' ELSE '---' END AS delimiter, 'literal' AS form FROM documents")
def literal_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as literal atoms; a text with a line that looks like the delimiter gets a longer one."""
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, "\n      ---").otherwise(""))
    mark = F.concat(F.lit("      "), canonical.delimiter_of(text, F.lit(6)))
    docs = as_documents(load(spark, sf_dir, "documents"), "doc_id", F.concat_ws("\n", F.lit("note"), mark, F.when(text != "", text), mark))
    atom = F.get(F.col("atoms"), 0)
    return D.compounds(docs).select(key_of("doc_id"), atom["text"].alias("text"), atom["delimiter"].alias("delimiter"), atom["form"].alias("form"))


_ROW = "(SELECT n_nationkey, n_name, n_regionkey, CAST(len(n_name) AS INTEGER) AS n, 33 AS start_at, n_nationkey % 5 AS k FROM nation)"


@query(f"""WITH r AS {_ROW}
    SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, code, CAST(span_start AS INTEGER) AS span_start, CAST(span_end AS INTEGER) AS span_end FROM (
    SELECT n_nationkey, 'E118' AS code, start_at + 7 AS span_start, start_at + 7 + n AS span_end FROM r WHERE n > 6 AND k <> 2
    UNION ALL SELECT n_nationkey, 'E117', start_at + 7 + n, start_at + 9 + n FROM r WHERE n > 6 AND k <> 2
    UNION ALL SELECT n_nationkey, 'E108', start_at + greatest(15, 9 + n) + 2, start_at + greatest(15, 9 + n) + 5 FROM r WHERE k = 1
    UNION ALL SELECT n_nationkey, 'E117', start_at + greatest(15, 9 + n) + 2, start_at + greatest(15, 9 + n) + 5 FROM r WHERE k = 1
    UNION ALL SELECT n_nationkey, 'E116', start_at, start_at + 2 FROM r WHERE k = 2
    UNION ALL SELECT n_nationkey, 'E119', 9, 16 FROM r WHERE k = 3)""")
def tabulated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows against their columns: values too wide, gaps off the columns, trailing spaces, a wrong indent, a bad heading."""
    n, k = load(spark, sf_dir, "nation"), F.col("n_nationkey") % 5
    head = F.when(k == 3, "#Key   # Name  # Region\n").otherwise("# Key  # Name  # Region\n")
    name = F.when(F.char_length("n_name") <= 6, F.rpad("n_name", 8, " ")).otherwise(F.concat("n_name", F.lit("  ")))
    row = F.concat(F.when(k == 2, "  ").otherwise(""), F.rpad(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")), 7, " "), name, F.lit("r"), F.col("n_regionkey").cast("string"), F.when(k == 1, "   ").otherwise(""))
    return spans(D.parse_errors(raw(n, "n_nationkey", F.lit(f"{PRAGMA} 1.0\n\n"), head, row, F.lit("\n"))), "n_nationkey")


@query("""WITH c AS (SELECT c_custkey, CAST(len(c_name) AS INTEGER) AS n, c_custkey % 6 AS k FROM customer)
    SELECT c_custkey, code, span_start, span_end FROM (
    SELECT c_custkey, 'E123' AS code, 13 + n AS span_start, 14 + n AS span_end FROM c WHERE k IN (0, 4)
    UNION ALL SELECT c_custkey, 'E101', 0, 3 FROM c WHERE k = 1
    UNION ALL SELECT c_custkey, 'E120', 14 + n, 15 + n FROM c WHERE k = 2
    UNION ALL SELECT c_custkey, 'E120', 13 + n, 14 + n FROM c WHERE k = 3)""")
def byte_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as bytes: ill-formed and truncated UTF-8, a byte order mark, line ends that change, a lone carriage return."""
    k = F.col("c_custkey") % 6
    head = F.when(k == 1, F.lit(b"\xef\xbb\xbftel 1.0\n")).when(k == 2, F.lit(b"tel 1.0\r\n")).otherwise(F.lit(b"tel 1.0\n"))
    tail = F.when(k == 0, F.lit(b"\xff\n")).when(k == 3, F.lit(b"\rx\n")).when(k == 4, F.lit(b"\xe2\x82\n")).otherwise(F.lit(b"\n"))
    docs = raw(load(spark, sf_dir, "customer"), "c_custkey", head, F.encode(F.concat(F.lit("name "), F.col("c_name")), "UTF-8"), tail)
    return spans(D.parse_errors(docs), "c_custkey")


PRAGMAS = {"tel": ("E104", 0, 3), "tel 1": ("E104", 4, 5), "tel 1.0 (": ("E105", 0, 9), "tel 1.0 what %": ("E121", 0, 14), "tel 1.0 +a x.org/b": ("E122", 0, 18), "a\ntel 1.0": ("E102", 2, 5), "tel 1.0 one two three": ("E121", 0, 21), "tel 1.0 x.org/b:1.2.3 +a +b %": None}


@query(f"""SELECT c_custkey, code, CAST(span_start AS INTEGER) AS span_start, CAST(span_end AS INTEGER) AS span_end FROM customer JOIN (VALUES {", ".join(f"({i}, '{x[0]}', {x[1]}, {x[2]})" for i, x in enumerate(PRAGMAS.values()) if x)}) p(k, code, span_start, span_end) ON c_custkey % 9 = k
    UNION ALL SELECT c_custkey, 'E103', 5000 + CAST(len(c_name) AS INTEGER), 5007 + CAST(len(c_name) AS INTEGER) FROM customer WHERE c_custkey % 9 = 8""")
def pragma_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines with each fault a pragma may have, one error a line whatever phrases it is made of."""
    k = F.col("c_custkey") % 9
    first = F.when(k == 8, F.concat(F.lit("#!"), F.repeat(F.lit("x"), 4997), F.col("c_name"), F.lit("\ntel 1.0"))).otherwise(nth(list(PRAGMAS), k))
    return spans(D.parse_errors(raw(load(spark, sf_dir, "customer"), "c_custkey", first, F.lit("\n\nname "), F.col("c_name"), F.lit("\n"))), "c_custkey")


@query("""SELECT c_custkey, keyword, remark, 'E106' AS code, 29 + CAST(len(c_name) + len(c_mktsegment) AS INTEGER) AS span_start FROM customer, (VALUES ('name'), ('segment')) t(keyword), LATERAL (SELECT CASE keyword WHEN 'name' THEN c_mktsegment || ' # twice' END AS remark)""")
def margins_and_remarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An indented document with a remark, and a line that leaves its margin; the line is read at the margin."""
    docs = raw(load(spark, sf_dir, "customer"), "c_custkey", F.lit("tel 1.0\n\n  name "), F.col("c_name"), F.lit("  # "), F.col("c_mktsegment"), F.lit(" # twice\nsegment x\n"))
    c = D.compounds(docs).join(D.parse_errors(docs).select("source_id", "code", "span_start"), "source_id")
    return c.select(key_of("c_custkey"), "keyword", "remark", "code", "span_start")


PHASES = schema_of(f"{PRAGMA} 1.0\n\nname s\n\nselect St\n  variant up Flag\n  variant down Flag\nrecord In\n  field x String\nrecord A\n  field a Flag\n  field b Flag optional\n  field in In optional\n  field c String\nrecord B\n  select St\nrecord C\n  field in In\n  field y String\ndocument\n  field p A optional\n  field q B optional\n  field r C optional\n")


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'E305' WHEN 1 THEN 'E304' WHEN 2 THEN 'E303' END AS code FROM customer WHERE c_custkey % 4 < 3")
def atom_phase_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms that their members cannot take: no such flag, no such variant, a struct that takes none."""
    line = nth(["p nope ", "q sideways", "r v", "p a "], F.col("c_custkey") % 4)
    docs = raw(load(spark, sf_dir, "customer"), "c_custkey", F.lit("tel 1.0\n\n"), line, F.when(F.col("c_custkey") % 4 != 1, F.col("c_name")).otherwise(""), F.lit("\n"))
    return D.errors(docs, PHASES).where("code IN ('E303', 'E304', 'E305')").select(key_of("c_custkey"), "code")


@query("""SELECT p_partkey, CAST(CASE WHEN regexp_full_match(replace(p_brand, CASE WHEN p_partkey % 2 = 0 THEN '#' ELSE '' END, ''), '[A-Z][A-Za-z0-9]*') THEN 0 ELSE 1 END + CASE WHEN p_partkey % 3 = 2 THEN 1 ELSE 0 END AS BIGINT) AS n FROM part
    WHERE NOT regexp_full_match(replace(p_brand, CASE WHEN p_partkey % 2 = 0 THEN '#' ELSE '' END, ''), '[A-Z][A-Za-z0-9]*') OR p_partkey % 3 = 2""")
def built_in_validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type names and sigils."""
    s = body("named", "field brand TypeName", "field mark Sigil")
    brand = F.when(F.col("p_partkey") % 2 == 0, F.replace("p_brand", F.lit("#"), F.lit(""))).otherwise(F.col("p_brand"))
    docs = as_documents(load(spark, sf_dir, "part"), "p_partkey", field("brand", brand), field("mark", nth(["#", "~", "x"], F.col("p_partkey") % 3)))
    return D.errors(docs, s).where("code = 'E310'").groupBy("source_id").agg(F.count("*").alias("n")).select(key_of("p_partkey"), "n")


@query("""WITH c AS (SELECT c_custkey, CAST(len(c_name) AS INTEGER) AS n, c_custkey % 3 AS k FROM customer)
    SELECT c_custkey, 'E310' AS code, span_start, span_end FROM (
    SELECT c_custkey, 16 AS span_start, 20 AS span_end FROM c WHERE k < 2
    UNION ALL SELECT c_custkey, 24 + n, 31 + n FROM c WHERE k = 1
    UNION ALL SELECT c_custkey, 9, 13 FROM c WHERE k = 2)""")
def flattened_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A struct validator's answer, spread over the children it names; an answer about no child counts against the struct."""
    s = body("log", "field item Item", before="\nrecord Item\n  field name String\n  field segment String\n  validate picky\n")
    answers = [{"name": "bad"}, {"name": "bad", "segment": "bad"}, {"gone": "bad"}]
    rule = {"string": lambda v: None, "picky": lambda v: answers[int(v.scalar("segment"))]}
    docs = raw(load(spark, sf_dir, "customer"), "c_custkey", F.lit("tel 1.0\n\nitem\n  name "), F.col("c_name"), F.lit("\n  segment "), (F.col("c_custkey") % 3).cast("string"), F.lit("\n"))
    return spans(D.errors(docs, s, rule), "c_custkey")


@query("""SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, '{"keyword":"nation","atoms":[{"form":"inline","text":"' || n_name || '","preceding_spaces":' || CASE WHEN contains(n_name, ' ') THEN 2 ELSE 1 END || '}],"remark":"r' || n_regionkey || '","depth":0}' AS json FROM nation""")
def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation")
    docs = raw(n, "n_nationkey", field("nation", F.col("n_name")), F.lit("  # r"), F.col("n_regionkey").cast("string"), F.lit("\n"))
    return reports.snapshot(D.compounds(docs)).select(key_of("n_nationkey"), "json")


MARKED = body("marked", "field r R optional repeatable", "field w String optional repeatable", before="\nrecord R\n  field name String\n  field bold Flag optional\n")
STEPS = [
    '{"op": "set-flag", "path": [[0, 0]], "keyword": "bold"}',
    '{"op": "remove-remark", "path": [[1, 2]]}',
    '{"op": "reorder-within-group", "path": [[1, 0]], "index": 2}',
    '{"op": "replace", "path": [[1, 0]], "compound": "w 9"}',
    '{"op": "insert-after", "path": [[1, 0]], "compound": "w 5"}',
    '{"op": "reorder-groups", "path": [], "keyword": "w", "other": "r", "index": 0}',
    '{"op": "insert", "path": [], "compound": "r last bold"}',
    '{"op": "unset-flag", "path": [[1, 1]], "keyword": "bold"}',
    '{"op": "insert-into-block", "path": [], "block": 0, "compound": "w end"}',
]


@query("""SELECT CAST(c_custkey AS VARCHAR) AS source_id, 'tel 1.0' || chr(10) || chr(10) || 'w 9' || chr(10) || 'w 5' || chr(10) || 'w 3' || chr(10) || 'w 1' || chr(10) || 'w end' || chr(10) || 'r ' || c_name || ' bold' || chr(10) || 'r last' || chr(10) || chr(10) AS text, 9 AS applied, 0 AS demoted, 0 AS malformed, 'merged' AS status FROM customer""")
def edit_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags set and unset, a remark removed, members and groups reordered, a compound replaced, others put in."""
    docs = as_documents(load(spark, sf_dir, "customer"), "c_custkey", F.lit(""), F.concat(F.lit("r "), F.col("c_name")), F.lit("\nw 1\nw 2\nw 3  # old"))
    e = docs.select("source_id", F.posexplode(F.array(*map(F.lit, STEPS))).alias("timestamp", "edit")).withColumn("agent", F.lit("a"))
    return edits.merge_sources(docs, e, MARKED)


@query("""SELECT CAST(c_custkey AS VARCHAR) AS source_id, CASE c_custkey % 5 WHEN 1 THEN NULL WHEN 2 THEN 'tag ' || c_name || chr(10) ELSE 'tag new' || chr(10) END AS text, CASE WHEN c_custkey % 5 IN (1, 2) THEN 0 ELSE 1 END AS applied, CASE WHEN c_custkey % 5 IN (1, 2) THEN 1 ELSE 0 END AS demoted,
    CASE WHEN c_custkey % 5 > 2 THEN 1 ELSE 0 END AS malformed, CASE c_custkey % 5 WHEN 1 THEN 'no document' WHEN 2 THEN 'repeated source' ELSE 'merged' END AS status FROM customer, range(2) t(i) WHERE i = 0 OR c_custkey % 5 = 2""")
def edit_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits whose document is absent or repeated, edits that are no JSON, edits without a time: a status each, and no lost row."""
    c, k = load(spark, sf_dir, "customer"), F.col("c_custkey") % 5
    docs = raw(c, "c_custkey", F.lit("tag "), F.col("c_name"), F.lit("\n"))
    of = F.col("source_id").cast("long") % 5
    docs = docs.where(of != 1).unionByName(docs.where(of == 2))
    good = F.struct(F.lit(1).cast("long").alias("timestamp"), F.lit("a").alias("agent"), F.lit('{"op": "update-value", "path": [[0, 0]], "value": "new"}').alias("edit"))
    bad = F.struct(F.when(k == 4, F.lit(2)).cast("long").alias("timestamp"), F.lit("a").alias("agent"), F.when(k == 4, F.lit('{"op": "upd')).otherwise(F.lit('{"op": "delete", "path": [[0, 0]]}')).alias("edit"))
    e = c.select(F.col("c_custkey").cast("string").alias("source_id"), F.explode(F.when(k > 2, F.array(good, bad)).otherwise(F.array(good))).alias("e")).select("source_id", "e.*")
    return edits.merge_sources(docs, e, body("tags", "field tag String"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS source_id, 'tel 1.0' || chr(10) || chr(10) || '# Merge conflict (agent b, ts=2): update-value — target was removed' || chr(10) || 'status ' || CASE WHEN c_custkey % 2 = 0 THEN 'closed' ELSE 'open' END || chr(10) || 'tag ' || c_name || chr(10) AS text, 4 AS applied, 1 AS demoted, 0 AS malformed, 'merged' AS status FROM customer""")
def merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three agents: one deletes what another one changes; two write the same field, and the later write stays whoever made it."""
    s = body("customer", "field status String", "field tag String optional repeatable")
    docs = as_documents(load(spark, sf_dir, "customer"), "c_custkey", F.lit(""), F.lit("status new\ntag old"), field("tag", F.col("c_name")))
    even = F.col("source_id").cast("long") % 2 == 0
    row = lambda ts, agent, op, path, value: F.struct(ts.cast("long").alias("timestamp"), F.lit(agent).alias("agent"), F.lit(f'{{"op": "{op}", "path": {path}, "value": "{value}"}}').alias("edit"))
    ops = F.array(row(F.lit(1), "a", "delete", "[[0, 1]]", ""), row(F.lit(2), "b", "update-value", "[[0, 1]]", "changed"), row(F.when(even, 3).otherwise(5), "b", "update-value", "[[0, 0]]", "open"), row(F.lit(4), "c", "update-value", "[[0, 0]]", "closed"), row(F.lit(6), "c", "update-value", "[[0, 0]]", "closed"))
    ops = F.when(even, ops).otherwise(F.concat(F.slice(ops, 1, 4), F.array(row(F.lit(6), "c", "remove-remark", "[[0, 0]]", ""))))
    e = docs.select("source_id", F.explode(ops).alias("e")).select("source_id", "e.*")
    return edits.merge_sources(docs, e, s)


@query("""WITH o AS (SELECT o_custkey, string_agg('order o' || o_orderkey || ' ' || o_orderstatus || CASE WHEN o_orderstatus = 'F' THEN '' WHEN contains(o_orderpriority, ' ') THEN '  ' || o_orderpriority ELSE ' ' || o_orderpriority END, chr(10) ORDER BY o_orderkey) || chr(10) AS t FROM orders GROUP BY 1)
    SELECT c_custkey, 'tel 1.0' || chr(10) || chr(10) || 'name ' || c_name || chr(10) || 'segment ' || c_mktsegment || chr(10) || CASE WHEN c_custkey % 2 = 0 THEN 'tier gold' || chr(10) ELSE '' END || 'nation' || CASE WHEN contains(n_name, ' ') THEN '  ' ELSE ' ' END || n_name || chr(10) || coalesce(t, '') || CASE WHEN c_custkey % 3 = 0 THEN 'comment  seen before' || chr(10) ELSE '' END AS text
    FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN o ON o_custkey = c_custkey""")
def constructed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents made anew from their elements: what was written as children stands inline where the form can carry it."""
    return D.rewritten(customer_documents(spark, sf_dir), CUSTOMER, "construct").select(key_of("c_custkey"), "text")


@query("""SELECT c_custkey, 'tel 1.0' || chr(10) || chr(10) || 'contact' || chr(10) || '  name ' || c_name || chr(10) || '  segment ' || c_mktsegment || chr(10) AS expanded, 'tel 1.0' || chr(10) || chr(10) || 'contact ' || c_name || ' ' || c_mktsegment || chr(10) AS inlined, 2 AS changes FROM customer""")
def verified_refactors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms written out as children and drawn in again, each step only if the model stays the same."""
    s = body("c", "field contact Contact optional", before="\nrecord Contact\n  field name String\n  field segment String\n")
    docs = as_documents(load(spark, sf_dir, "customer"), "c_custkey", F.lit(""), F.concat(F.lit("contact "), F.col("c_name"), F.lit(" "), F.col("c_mktsegment")))
    out = saved(D.rewritten(docs, s, "expand"))
    back = D.rewritten(out, s, "inline").select("source_id", F.col("text").alias("inlined"))
    return out.join(back, "source_id").select(key_of("c_custkey"), F.col("text").alias("expanded"), "inlined", "changes")


@query("""SELECT c_custkey, n, line FROM (
    SELECT c_custkey, 0 AS n, c_custkey || '#0 [9,13) E308' AS line FROM customer WHERE false
    UNION ALL SELECT c_custkey, 0, c_custkey || '#0 [' || 14 + len(c_name) || ',' || 16 + len(c_name) || ') E108 trailing spaces' FROM customer
    UNION ALL SELECT c_custkey, 1, c_custkey || '#0 [' || 17 + len(c_name) || ',' || 20 + len(c_name) || ') E306' FROM customer)""")
def validated_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syntax and validation problems of a document in one report, in order of their spans."""
    docs = raw(load(spark, sf_dir, "customer"), "c_custkey", F.lit("tel 1.0\n\nname "), F.col("c_name"), F.lit("  \nzzz x\n"))
    return reports.report(D.errors(docs, body("c", "field name String"))).select(key_of("c_custkey"), "n", "line")


@query("""WITH c AS (SELECT c_custkey, CAST(len(c_name) AS INTEGER) AS n FROM customer)
    SELECT c_custkey, [9, 17] AS ranges, ['owner', 'email'] AS keywords, [17, 34 + n] AS highlights, ['name', 'email'] AS completions, CAST(NULL AS INTEGER) AS definition, 'where mail goes' AS description FROM c""")
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a tool shows at an offset: ranges, highlights, completions, a description."""
    s = schema_of(f"{PRAGMA} 1.0\n\nname s\n\nrecord Contact\n  field name String optional\n  field email String\n    description  where mail goes\n\ndocument\n  field owner Contact\n  field contact Contact optional\n")
    docs = raw(load(spark, sf_dir, "customer"), "c_custkey", F.lit("tel 1.0\n\nowner\n  email "), F.col("c_name"), F.lit("\ncontact\n  email x\n"))
    return S.positions(docs.withColumn("offset", F.lit(20)), s).select(key_of("c_custkey"), "ranges", "keywords", "highlights", "completions", "definition", "description")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, 17 AS definition, ['document', 'field'] AS keywords FROM nation")
def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In a schema document, where the type under an offset is declared."""
    n = load(spark, sf_dir, "nation")
    name = F.concat(F.lit("R"), F.col("n_nationkey").cast("string"))
    docs = raw(n, "n_nationkey", F.lit("tel 1.0\n\nname s\n\n"), F.lit("record "), name, F.lit("\n  field a String\n\ndocument\n  field b "), name, F.lit("\n"))
    at = docs.withColumn("offset", F.char_length("text") - 2)
    return S.positions(at, META).select(key_of("n_nationkey"), "definition", "keywords")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, 'tel 1.0' || chr(10) || 'name' || CASE WHEN contains(n_name, ' ') THEN '  ' ELSE ' ' END || n_name || chr(10) || 'region r' || n_regionkey || chr(10) AS text, 1 AS files FROM nation")
def file_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below a folder as sources, written back in canonical order; the same files as a stream."""
    path, n = new_path(spark, "files"), load(spark, sf_dir, "nation")
    lines = F.concat_ws("\n", F.lit(f"{PRAGMA} 1.0"), F.concat(F.lit("region r"), F.col("n_regionkey").cast("string")), field("name", F.col("n_name")))
    n.select(F.col("n_nationkey").alias("k"), lines.alias("value")).repartition("k").write.partitionBy("k").option("lineSep", "\n").text(path)
    s = body("nation", "field name String", "field region Identifier")
    key = F.regexp_extract("source_id", "k=([0-9]+)", 1).cast("long").alias("n_nationkey")
    texts = D.canonical_sources(D.read_sources(spark, path, "*.txt"), s).select(key, "text")
    out = new_path(spark, "files")
    q = stream.write_stream(D.documents(stream.stream_files(spark, f"{path}/*")), f"{out}/table", f"{out}/checkpoint")
    q.awaitTermination()
    files = spark.read.parquet(f"{out}/table").select(key).groupBy("n_nationkey").agg(F.count("*").cast("int").alias("files"))
    return texts.join(files, "n_nationkey")


@query("SELECT 'E306' AS code, count(*) AS n FROM events WHERE event_type = 'error'")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a stream, counted batch by batch into a table whose sums are the counts."""
    base = new_path(spark, "counts")
    as_documents(load(spark, sf_dir, "events"), "event_id", F.concat(F.col("event_type"), F.lit(" x"))).repartition(4).write.parquet(f"{base}/in")
    s = body("events", *(f"field {t} String optional" for t in ("click", "purchase", "signup", "view")))
    found = D.errors(stream.stream_table(spark, f"{base}/in", "source_id string, text string"), s)
    stream.for_each_batch(found, lambda batch, n: stream.count_errors(batch).write.mode("overwrite").parquet(f"{base}/out/batch={n}"), f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("code").agg(F.sum("n").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey * l_partkey * l_linenumber * 100003 AS value FROM lineitem")
def varint_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers of up to eight groups to bytes and back."""
    li = load(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", varints.unvarint(varints.varint(F.col("l_orderkey") * F.col("l_partkey") * F.col("l_linenumber") * 100003)).alias("value"))


@query(f"""SELECT c_custkey, {case(['E301', 'E302', 'E307', 'E308', 'E309', 'fine'], 'c_custkey % 6')} AS code, n FROM customer, (SELECT 1 AS n) WHERE c_custkey % 6 < 5""")
def member_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children below a scalar, an atom too many, a member missing, one too often, one in two places."""
    s = body("r", "field r R optional repeatable", "field word String optional", before="\nrecord R\n  field name String\n  field n String\n")
    lines = ["word x\n  y", "r a x y", "r a", "word a\nword b", "r a x\nword y\nr b x", "r a x"]
    docs = raw(load(spark, sf_dir, "customer"), "c_custkey", F.lit("tel 1.0\n\n"), nth(lines, F.col("c_custkey") % 6), F.lit("\n"))
    return D.errors(docs, s).groupBy("source_id", "code").agg(F.count("*").cast("int").alias("n")).select(key_of("c_custkey"), "code", "n")


@query("SELECT 'E306' AS code, count(*) AS n FROM customer")
def error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = raw(load(spark, sf_dir, "customer"), "c_custkey", F.lit("zzz "), F.col("c_name"), F.lit("\n"))
    return checks.summary(D.errors(docs, body("c", "field name String optional")))
