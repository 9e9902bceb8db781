"""Registered queries over the driver's tables, each with the same result in DuckDB SQL where SQL can say it.

Tables are rendered to tree documents by column expressions, then parsed, typed, checked, addressed, encoded or edited.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hashes, letters, varints
from .functions.registry import DECIMAL_VARINT
from .operators import canonical, checks, edits, reports
from .plans.compose import compose
from .plans.paths import member_column, select_path
from .plans.resolve import Resolver, resolve_documents
from .plans.schema import Layer, Member, Scalar, Schema, Select, Struct, Variant, catalog
from .query_base import as_documents, body, day, field, grouped, key_of, load, query
from .sources import documents as D
from .sources import schemas as S
from .sources.parser import PRAGMA
from .sources.storage import new_path, saved
from .streaming.documents import stream_table, write_stream

PART = body("part", "field name String", "field brand String", "field type String", "field size String", "field price String")


def part_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_documents(load(spark, sf_dir, "part"), "p_partkey", field("name", F.col("p_name")), field("brand", F.col("p_brand")), field("type", F.col("p_type")), field("size", F.col("p_size")), field("price", F.col("p_retailprice")))


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def roundtrip_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical lines out, parsed and typed back in: the table."""
    w = D.wide(part_documents(spark, sf_dir), PART)
    return w.select(key_of("p_partkey"), F.col("name").alias("p_name"), F.col("brand").alias("p_brand"), F.col("type").alias("p_type"), F.col("size").cast("int").alias("p_size"), F.col("price").cast("double").alias("p_retailprice"))


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def roundtrip_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts through source and literal atoms."""
    s = body("note", "field text String")
    w = D.wide(as_documents(load(spark, sf_dir, "documents"), "doc_id", field("text", F.coalesce("text", F.lit("")))), s)
    return w.select(key_of("doc_id"), "text")


@query("""SELECT c_custkey // 10 AS source, CAST(row_number() OVER (PARTITION BY c_custkey // 10 ORDER BY c_custkey) - 1 AS INTEGER) AS doc_ord, c_custkey, c_name FROM customer""")
def stream_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents a source, between separator lines."""
    c = load(spark, sf_dir, "customer").withColumn("source", F.floor(F.col("c_custkey") / 10))
    one = F.concat_ws("\n", F.lit(f"{PRAGMA} 1.0"), field("key", F.col("c_custkey")), field("name", F.col("c_name")))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", one.alias("t")))), lambda x: x["t"])
    packed = c.groupBy("source").agg(F.array_join(texts, "\n##\n").alias("text"))
    w = D.wide(D.sources(packed, key="source"), body("customer", "field key String", "field name String"))
    return w.select(key_of("source"), "doc_ord", F.col("key").cast("long").alias("c_custkey"), F.col("name").alias("c_name"))


ORDER = body("order", "field line Line optional repeatable", before="\nrecord Line\n  field number Identifier key\n  field quantity String optional\n")


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    line = F.concat(F.lit("line l"), F.col("l_linenumber").cast("string"), F.lit(" "), F.col("l_quantity").cast("string"))
    return grouped(li, "l_orderkey", line, "l_linenumber", "l_quantity")


@query("SELECT l_orderkey, count(*) - count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1 HAVING n > 0")
def key_uniqueness_e314(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checks.duplicate_keys(D.elements(order_documents(spark, sf_dir), ORDER, kinds=("struct",)), ORDER)  # keys are those of structs
    return found.groupBy("source_id").agg(F.count("*").alias("n")).select(key_of("l_orderkey"), "n")


@query("SELECT 'E314' AS code, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS n FROM lineitem")
def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same violations, counted by the per-document walk."""
    return checks.summary(D.errors(order_documents(spark, sf_dir), ORDER))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def repeat_e308(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = body("customer", "field order String optional", "field count String optional")
    o = load(spark, sf_dir, "orders")
    e = saved(D.elements(grouped(o, "o_custkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), "o_orderkey"), s))
    bad = checks.repeated_members(e, s)
    n = checks.known(e).groupBy("source_id").agg(F.count("*").alias("n"))
    return bad.join(n, "source_id").select(key_of("o_custkey"), "n")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def required_e307(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = body("order", "field line String repeatable")
    o, li = load(spark, sf_dir, "orders").select("o_orderkey"), load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    lines = li.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("l_linenumber")), lambda n: F.concat(F.lit("line "), n.cast("string"))), "\n").alias("t"))
    docs = as_documents(o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left"), "o_orderkey", F.col("t"))
    return checks.missing_required(saved(D.elements(docs, s)), s).select(key_of("o_orderkey"))


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
EVENTS = body("events", *(f"field {t} String optional repeatable" for t in EVENT_TYPES))


def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return grouped(e, "user_id", F.concat(F.col("event_type"), F.lit(" e"), F.col("event_id").cast("string")), "ts", "event_id")


@query(
    """WITH e AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
    r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS run FROM e WHERE before IS NULL OR before <> event_type)
    SELECT user_id, count(*) AS n FROM r WHERE run > 1 GROUP BY 1"""
)
def contiguity_e309(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checks.broken_runs(D.elements(event_documents(spark, sf_dir), EVENTS))
    return found.groupBy("source_id").agg(F.count("*").alias("n")).select(key_of("user_id"), "n")


@query("SELECT event_type AS keyword, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view', 'purchase') GROUP BY 1")
def unknown_keyword_e306(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = body("events", *(f"field {t} String optional repeatable" for t in ("click", "view", "purchase")))
    return checks.unknown_keywords(D.elements(event_documents(spark, sf_dir), s), s).groupBy("keyword").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) FILTER (event_type <> 'error') AS accepted, count(*) FILTER (event_type = 'error') AS excluded FROM events GROUP BY 1")
def select_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layer excludes one variant of a select; documents are typed under the composition."""
    base = Schema("log", Struct("", (Member("select", "Entry", required="loose", repeatable="loose"),)), selects=(Select("Entry", tuple(Variant(t, "String") for t in EVENT_TYPES)),))
    s, faults = compose(replace(base, layers=(Layer("quiet", selects=(Select("Entry", excludes=("error",)),)),)))
    if faults:
        raise ValueError(faults)
    e = D.elements(event_documents(spark, sf_dir), s).where("elem_id > 0")
    return e.groupBy("source_id").agg(F.count_if(F.col("kind") == "scalar").alias("accepted"), F.count_if(F.col("kind") == "unknown").alias("excluded")).select(key_of("user_id"), "accepted", "excluded")


CODED = body("coded", "field code Code", before="\nscalar Code\n  pattern  Brand#[0-9]{2}\n")


@query("SELECT p_partkey FROM part WHERE NOT regexp_full_match(p_brand, 'Brand#[0-9]{2}')")
def pattern_e315(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = as_documents(load(spark, sf_dir, "part"), "p_partkey", field("code", F.col("p_brand")))
    return checks.misfit_patterns(D.elements(docs, CODED), CODED).select(key_of("p_partkey"))


@query("SELECT p_partkey FROM part WHERE NOT regexp_full_match(CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE replace(p_name, ' ', '-') END, '''*[a-z](-?[a-z0-9])*')")
def identifier_e310(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = body("named", "field name Identifier")
    name = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.replace(F.col("p_name"), F.lit(" "), F.lit("-")))
    docs = as_documents(load(spark, sf_dir, "part"), "p_partkey", field("name", name))
    return checks.misfit_values(D.elements(docs, s), s).select(key_of("p_partkey"))


SHIPPED = body("shipment", "field line Line optional repeatable", before="\nrecord Line\n  field ordered String\n  field shipped String\n  validate ordered-first\n")


@query("SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate GROUP BY 1")
def struct_validator_e310(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cross-field rule as a column over the fields of each struct."""
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate").join(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    docs = grouped(li, "o_orderkey", F.concat_ws(" ", F.lit("line"), day("o_orderdate"), day("l_shipdate")), "l_shipdate")
    bad = checks.misfit_views(D.struct_views(docs, SHIPPED, "Line"), "line", lambda f: f["ordered"] <= f["shipped"])
    return bad.groupBy("source_id").agg(F.count("*").alias("n")).select(key_of("o_orderkey"), "n")


@query("SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate GROUP BY 1")
def struct_validator_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rule as a named validator of the per-document walk."""
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate").join(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    docs = grouped(li, "o_orderkey", F.concat_ws(" ", F.lit("line"), day("o_orderdate"), day("l_shipdate")), "l_shipdate")
    rule = {"string": lambda v: None, "ordered-first": lambda v: None if v.scalar("ordered") <= v.scalar("shipped") else "shipped before it was ordered"}
    bad = D.errors(docs, SHIPPED, rule).where("code = 'E310'")
    return bad.groupBy("source_id").agg(F.count("*").alias("n")).select(key_of("o_orderkey"), "n")


DEFAULTED = Schema("part", Struct("", (Member("field", "String", "name"), Member("field", "String", "size", default="unknown"))))


def elided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_documents(load(spark, sf_dir, "part"), "p_partkey", field("name", F.col("p_name")), F.when(F.col("p_size") <= 25, field("size", F.col("p_size"))))


@query("SELECT p_partkey, CASE WHEN p_size <= 25 THEN CAST(p_size AS VARCHAR) ELSE 'unknown' END AS size FROM part")
def default_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.wide(elided(spark, sf_dir), DEFAULTED).select(key_of("p_partkey"), "size")


@query("SELECT p_partkey, 'size' AS keyword, 'unknown' AS text FROM part WHERE p_size > 25")
def default_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relational form: members with a default, less those that are written."""
    found = checks.with_defaults(D.elements(elided(spark, sf_dir), DEFAULTED), DEFAULTED)
    return found.select(key_of("p_partkey"), "keyword", "text")


@query("SELECT r_name AS type_name, n_name AS keyword, CAST(row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1 AS INTEGER) AS keyword_ix FROM region JOIN nation ON n_regionkey = r_regionkey")
def keyword_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n = load(spark, sf_dir, "region"), load(spark, sf_dir, "nation")
    m = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit("s").alias("schema_id"), F.col("r_name").alias("type_name"), F.col("n_nationkey").alias("member_ix"), F.col("n_name").alias("keyword"), F.lit("String").alias("member_type"))
    none = spark.createDataFrame([], "schema_id string, type_name string, variant string, variant_ix int")
    return checks.keyword_order(m, none).select("type_name", "keyword", "keyword_ix")


CUSTOMER = body(
    "customer",
    "field name String",
    "field segment String",
    "field tier String\n    default  basic",
    "field nation Nation repeatable",
    "field order Order optional repeatable",
    "field comment String optional",
    before="\nrecord Nation\n  field name String\n\nrecord Order\n  field key Identifier key\n  field status String\n  field priority String optional\n",
)


def customer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per customer: the orders by key; a comment in every third, a tier in every second."""
    c, n = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), load(spark, sf_dir, "nation")
    o = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    lines = F.concat_ws("\n", F.concat(F.lit("order o"), F.col("o_orderkey").cast("string")), field("status", F.col("o_orderstatus"), 1), field("priority", F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")), 1))
    orders = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", lines.alias("t")))), lambda x: x["t"]), "\n").alias("orders"))
    k = F.col("c_custkey")
    joined = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(orders, k == F.col("o_custkey"), "left")
    nation = F.concat(F.lit("nation\n"), field("name", F.col("n_name"), 1))
    return as_documents(joined, "c_custkey", field("name", F.col("c_name")), field("segment", F.col("c_mktsegment")), F.when(k % 2 == 0, F.lit("tier gold")), nation, F.col("orders"), F.when(k % 3 == 0, F.lit("comment  seen before")))


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)
    SELECT o_custkey, o_orderstatus AS status FROM o WHERE i = 2""")
def path_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.paths(customer_documents(spark, sf_dir), CUSTOMER, {"third": "/order/2/status"})
    return found.where("status = 'element'").select(key_of("o_custkey"), F.col("text").alias("status"))


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)
    SELECT c_custkey, CASE WHEN o_custkey IS NULL THEN 'index out of range' ELSE 'element' END AS status, o_orderstatus AS text FROM customer LEFT JOIN o ON o_custkey = c_custkey AND i = 2""")
def path_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same path as equi-joins by parent over elements that are written once."""
    e = saved(D.elements(customer_documents(spark, sf_dir), CUSTOMER), "elements")
    return select_path(e, "/order/2/status", CUSTOMER).select(key_of("c_custkey"), "status", "text")


@query("""SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1 AS INTEGER) AS occurrence, 'l' || l_linenumber AS key FROM lineitem""")
def path_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All occurrences of a repeatable member, with their keys."""
    found = D.paths(order_documents(spark, sf_dir), ORDER, {"lines": ":line"}).where("status = 'occurrences'")
    return found.select(key_of("l_orderkey"), "occurrence", F.col("key_value").alias("key"))


@query("SELECT o_custkey, o_orderstatus AS status FROM orders WHERE o_orderkey IN (7, 42)")
def path_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed access compiled to columns over typed rows: the orders of those keys, whichever customer has them."""
    w = D.wide(customer_documents(spark, sf_dir), CUSTOMER)
    own = F.array_compact(F.array(*(member_column(F.struct(*w.columns[2:]), f"/order/o{k}/status", CUSTOMER) for k in (7, 42))))
    return w.select(key_of("o_custkey"), F.explode(own).alias("status"))


@query("""SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey = 7) THEN 'element' ELSE 'key not found' END AS by_key,
    CASE WHEN (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) > 5 THEN 'element' ELSE 'index out of range' END AS by_index, 'unknown keyword' AS unknown, 'non-struct descent' AS below, 'syntax' AS syntax, 'type not keyed' AS unkeyed,
    CASE WHEN c_custkey % 3 = 0 THEN 'element' ELSE 'absent member' END AS absent FROM customer""")
def path_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = {"by_key": "/order/o7", "by_index": "/order/5", "unknown": "/orders", "below": "/name/x", "syntax": "/order//x", "unkeyed": "/nation/n7", "absent": "/comment"}
    found = D.paths(customer_documents(spark, sf_dir), CUSTOMER, paths)
    return found.groupBy("source_id").pivot("name", sorted(paths)).agg(F.max("status")).select(key_of("c_custkey"), *paths)


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'gold' ELSE 'basic' END AS tier FROM customer")
def path_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A member that is not written is found with its default."""
    found = D.paths(customer_documents(spark, sf_dir), CUSTOMER, {"tier": "/tier"})
    return found.select(key_of("c_custkey"), F.col("text").alias("tier"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN v < 128 THEN printf('%02X', v) WHEN v < 16384 THEN printf('%02X%02X', v % 128 + 128, v // 128)
    WHEN v < 2097152 THEN printf('%02X%02X%02X', v % 128 + 128, v // 128 % 128 + 128, v // 16384) ELSE printf('%02X%02X%02X%02X', v % 128 + 128, v // 128 % 128 + 128, v // 16384 % 128 + 128, v // 2097152) END AS hex
    FROM (SELECT *, l_partkey * l_linenumber * 97 AS v FROM lineitem)""")
def varint_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.hex(varints.varint(F.col("l_partkey") * F.col("l_linenumber") * 97)).alias("hex"))


@query(f"""SELECT c_custkey, array_to_string(list_transform(range(1, len(c_name) + 1), lambda i: substr('{letters.ALPHABET}', ascii(substr(c_name, i, 1)) + 1, 1)), '') AS letters,
    CASE WHEN c_custkey % 4 > 0 THEN c_name END AS back, CASE WHEN c_custkey % 4 > 0 THEN CAST([] AS INTEGER[]) ELSE [CAST(len(c_name) AS INTEGER), CAST(len(c_name) AS INTEGER) + 2] END AS bad, c_name || CASE WHEN c_custkey % 4 > 0 THEN '' ELSE '-x-' END AS permissive FROM customer""")
def letters_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes as letters and back; in every fourth row two characters that are no letters."""
    c = load(spark, sf_dir, "customer").withColumn("letters", letters.letters(F.encode("c_name", "UTF-8")))
    text = F.when(F.col("c_custkey") % 4 == 0, F.concat("letters", F.lit("-x-"))).otherwise(F.col("letters"))
    strict = letters.unletters_strict(text)
    return c.select("c_custkey", "letters", F.decode(strict["bytes"], "UTF-8").alias("back"), strict["bad"].alias("bad"), F.decode(letters.unletters(text), "UTF-8").alias("permissive"))


_FORM = """CASE WHEN NOT (contains(text, chr(10)) OR contains(text, '  ') OR starts_with(text, ' ') OR ends_with(text, ' ') OR starts_with(text, '# ')) THEN 'inline'
    WHEN len(text) > 0 AND NOT (starts_with(text, ' ') OR starts_with(text, chr(10)) OR ends_with(text, chr(10)) OR contains(text, chr(10) || chr(10)) OR regexp_matches(text, '[\\t\\r \\x{85}\\x{a0}](\\n|\\z)')) THEN 'source' ELSE 'literal' END"""


@query(f"""WITH t AS (SELECT doc_id AS id, 'documents' AS source, coalesce(text, '') AS text FROM documents UNION ALL SELECT conv_id * 1000 + turn, 'conversations', coalesce(text, '') FROM conversations UNION ALL SELECT page_id, 'pages', coalesce(html, '') FROM pages)
    SELECT id, source, {_FORM} AS form FROM t""")
def atom_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("documents").alias("source"), "text")
    t = t.unionByName(load(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("conversations").alias("source"), "text"))
    t = t.unionByName(load(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("pages").alias("source"), F.col("html").alias("text")))
    return t.select("id", "source", canonical.form_of(F.coalesce("text", F.lit(""))).alias("form"))


@query("""WITH w AS (SELECT p_type, c, max(len(v)) AS width, max(h) AS heading FROM (
      SELECT p_type, 0 AS c, CAST(p_partkey AS VARCHAR) AS v, 2 AS h FROM part UNION ALL SELECT p_type, 1, p_name, 4 FROM part UNION ALL SELECT p_type, 2, p_brand, 5 FROM part UNION ALL SELECT p_type, 3, CAST(p_size AS VARCHAR), 12 FROM part) GROUP BY 1, 2)
    SELECT p_type, c AS column, CAST(coalesce(sum(greatest(width, heading + 2) + 2) OVER (PARTITION BY p_type ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM w""")
def minimal_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column offsets of a table per part type, from the widest values and the headings."""
    p = load(spark, sf_dir, "part")
    cols = [("p_partkey", 2), ("p_name", 4), ("p_brand", 5), ("p_size", 12)]
    long = p.select("p_type", F.explode(F.array(*[F.struct(F.lit(i).alias("column"), F.char_length(F.col(c).cast("string")).alias("width"), F.lit(h).alias("heading")) for i, (c, h) in enumerate(cols)])).alias("x")).select("p_type", "x.*")
    widths = long.groupBy("p_type", "column").agg(F.max("width").alias("width"), F.max("heading").alias("heading"))
    return edits.offsets_of(widths, ["p_type"]).select("p_type", "column", F.col("offset").cast("long").alias("offset"))


@query("SELECT CAST(user_id AS VARCHAR) AS source_id, arg_max(event_type, (ts, event_id)) AS value FROM events GROUP BY 1")
def merge_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("source_id"), F.col("ts").alias("timestamp"), F.col("event_id").alias("agent"), F.col("event_type").alias("value"))
    return edits.last_writes(e)


@query("""SELECT CAST(user_id AS VARCHAR) AS source_id, 'status ' || arg_max(event_type, event_id) || chr(10) AS text, CAST(count(*) AS INTEGER) AS applied, 0 AS demoted, 0 AS malformed, 'merged' AS status FROM events GROUP BY 1""")
def merge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full fold over documents: every event is an edit by one of three agents."""
    s = body("status", "field status String")
    e = load(spark, sf_dir, "events")
    docs = e.select(F.col("user_id").cast("string").alias("source_id")).distinct().withColumn("text", F.lit("status new\n"))
    ops = e.select(F.col("user_id").cast("string").alias("source_id"), F.col("event_id").alias("timestamp"), F.concat(F.lit("agent-"), (F.col("event_id") % 3).cast("string")).alias("agent"), F.concat(F.lit('{"op": "update-value", "path": [[0, 0]], "value": "'), F.col("event_type"), F.lit('"}')).alias("edit"))
    return edits.merge_sources(docs, ops, s)


@query("SELECT count(*) AS documents, count(DISTINCT coalesce(text, '')) AS models FROM documents")
def value_hash_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal models have equal hashes: binary roots by Arrow batches, BLAKE3 over them."""
    s = body("note", "field text String")
    docs = as_documents(load(spark, sf_dir, "documents"), "doc_id", field("text", F.coalesce("text", F.lit(""))))
    h = D.hash_documents(docs, s).select(F.col("hash").alias("h"))
    return h.agg(F.count("*").alias("documents"), F.count_distinct("h").alias("models"))


@query()
def value_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashes themselves; tests hold BLAKE3 against its published vectors."""
    h = D.hash_documents(part_documents(spark, sf_dir), PART)
    return h.select(key_of("p_partkey"), F.lower(F.hex("hash")).alias("hash"))


@query("""WITH o AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, sha256(CAST(o_orderkey AS VARCHAR)) AS h FROM orders),
    b AS (SELECT o_custkey, CASE WHEN i = 0 THEN 0 ELSE 4 + (i - 1) * 2 END + j AS place, CAST('0x' || substr(h, CAST(2 * j + 1 AS INTEGER), 2) AS INTEGER) AS v FROM o, range(32) t(j)),
    x AS (SELECT o_custkey, place, bit_xor(v) AS v FROM b GROUP BY 1, 2)
    SELECT o_custkey, string_agg(printf('%02X', v), '' ORDER BY place) || printf('%02X', xor(bit_xor(v), 121)) AS stack FROM x GROUP BY 1""")
def stacked_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash sequences stacked by built-in functions, byte for byte."""
    o = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.unhex(F.sha2(F.col("o_orderkey").cast("string"), 256)).alias("h"))
    seq = o.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "h"))), lambda x: x["h"]).alias("hs"))
    return seq.select("o_custkey", F.hex(hashes.stack_column(F.col("hs"))).alias("stack"))


@query("""SELECT o_custkey, coalesce(min(o_orderkey) FILTER (o_orderstatus = 'O') < max(o_orderkey) FILTER (o_orderstatus = 'F'), false) AS compatible FROM orders GROUP BY 1""")
def signature_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a consumer's components O, F are a subsequence of each document's components."""
    o = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda x: F.encode(x["o_orderstatus"], "UTF-8")).alias("doc"))
    want = F.array(F.encode(F.lit("O"), "UTF-8"), F.encode(F.lit("F"), "UTF-8"))
    return o.select("o_custkey", hashes.is_compatible(want, F.col("doc")).alias("compatible"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], o_orderpriority) AS p, lag(list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], o_orderpriority)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders)
    SELECT o_custkey, bool_and(before IS NULL OR before < p) AS in_order FROM o GROUP BY 1""")
def layer_order_e124(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer selections by their place in the declaration: strictly increasing or not."""
    declared = Schema("orders", layers=tuple(map(Layer, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))))
    o = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("source_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]).alias("layers"))
    return S.layers_in_order(o, declared).select(key_of("o_custkey"), "in_order")


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'E108' WHEN 1 THEN 'E107' WHEN 2 THEN 'E109' WHEN 3 THEN 'E111' WHEN 4 THEN 'E115' END AS code FROM orders WHERE o_orderkey % 6 < 5""")
def parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One planted syntax error a document, and none in every sixth."""
    k = F.col("o_orderkey") % 6
    body_lines = F.when(k == 0, F.lit("order x \n  status F")).when(k == 1, F.lit("order x\n   status F")).when(k == 2, F.lit("order x\n# late comment\nother y")).when(k == 3, F.lit("order x\n          deep")).when(k == 4, F.lit("order x\n      END\nnever closed")).otherwise(F.lit("order x\n  status F"))
    found = D.parse_errors(as_documents(load(spark, sf_dir, "orders"), "o_orderkey", F.lit(""), body_lines))
    return found.select(key_of("o_orderkey"), "code")


@query("""SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, 1 AS ver_major, CAST(n_regionkey AS INTEGER) AS ver_minor, 'nation' || n_nationkey || '.example/trade' AS reference, CASE WHEN n_nationkey % 2 = 0 THEN ['layer-a', 'layer-b'] ELSE [] END AS layers, CASE WHEN n_nationkey % 3 = 0 THEN '%' ELSE '#' END AS sigil FROM nation""")
def pragma_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers alone: no compound is emitted."""
    n = load(spark, sf_dir, "nation")
    text = F.concat_ws(" ", F.lit(PRAGMA), F.concat(F.lit("1."), F.col("n_regionkey").cast("string")), F.concat(F.lit("nation"), F.col("n_nationkey").cast("string"), F.lit(".example/trade")), F.when(F.col("n_nationkey") % 2 == 0, "+layer-a +layer-b"), F.when(F.col("n_nationkey") % 3 == 0, "%"))
    d = D.documents(n.select(F.col("n_nationkey").cast("string").alias("source_id"), text.alias("text")), single=True)
    return d.select(key_of("n_nationkey"), "ver_major", "ver_minor", "reference", "layers", "sigil")


@query("""SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE WHEN n_nationkey % 4 = 3 THEN 'untyped' WHEN n_nationkey % 4 = 2 THEN 'not-found' WHEN n_nationkey % 4 = 1 THEN 'unknown-layer' ELSE 'resolved' END AS resolution FROM nation""")
def schema_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct identifiers resolved once, in tasks, against a library of one schema."""
    n = load(spark, sf_dir, "nation")
    k = F.col("n_nationkey") % 4
    ref = F.when(k == 0, "x.example/trade").when(k == 1, "x.example/trade +none").when(k == 2, "x.example/other")
    docs = D.documents(n.select(F.col("n_nationkey").cast("string").alias("source_id"), F.concat_ws(" ", F.lit(f"{PRAGMA} 1.0"), ref).alias("text")))
    r = Resolver()
    r.add(f"{PRAGMA} 1.0\n\nname trade\n\ndocument\n  field name String\n")
    return resolve_documents(docs, r).select(key_of("n_nationkey"), "resolution")


@query("SELECT 'tel 1.0' || chr(10) || 'name' || CASE WHEN contains(p_name, ' ') THEN '  ' ELSE ' ' END || p_name || chr(10) || 'brand ' || p_brand || chr(10) || 'type ' || p_type || chr(10) || 'size ' || p_size || chr(10) AS text, p_partkey FROM part")
def canonical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members written out of order come back in canonical order, by native lines over the elements table."""
    s = body("part", "field name String", "field brand String", "field type String", "field size String")
    docs = as_documents(load(spark, sf_dir, "part"), "p_partkey", field("size", F.col("p_size")), F.lit("\n# note\n"), field("type", F.col("p_type")), field("brand", F.col("p_brand")), field("name", F.col("p_name")))
    return canonical.canonical_documents(D.elements(docs, s)).select("text", key_of("p_partkey"))


CODED_PART = Schema("part", Struct("", (Member("field", "String", "name"), Member("field", "Size", "size"))), scalars=(Scalar("Size", ("string",), (), "decimal-varint"),))


@query("SELECT p_partkey, p_name AS name, CAST(p_size AS VARCHAR) AS size FROM part")
def binary_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole binary documents with an encoded scalar, decoded again."""
    codecs = {"decimal-varint": DECIMAL_VARINT}
    docs = as_documents(load(spark, sf_dir, "part"), "p_partkey", field("name", F.col("p_name")), field("size", F.col("p_size")))
    head = bytes.fromhex("b2c4b5bb21") + hashes.stack_hashes([hashes.blake3(b"part")])
    data = D.encode_documents(docs, CODED_PART, codecs).select("source_id", F.concat(F.lit(head), F.col("data")).alias("data"))
    e = D.decode_documents(data, CODED_PART, codecs)
    return e.where("elem_id > 0").groupBy("source_id").agg(F.max(F.when(F.col("keyword") == "name", F.col("text"))).alias("name"), F.max(F.when(F.col("keyword") == "size", F.col("text"))).alias("size")).select(key_of("p_partkey"), "name", "size")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'B01' WHEN 1 THEN 'B03' WHEN 2 THEN 'B09' ELSE 'B08' END AS failure FROM part")
def binary_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = bytes.fromhex("b2c4b5bb21") + hashes.stack_hashes([hashes.blake3(b"part")])
    data = D.encode_documents(part_documents(spark, sf_dir), PART).select("source_id", F.concat(F.lit(head), F.col("data")).alias("d"))
    k = F.col("source_id").cast("long") % 4
    bad = F.when(k == 0, F.concat(F.lit(b"\0"), F.col("d"))).when(k == 1, F.concat(F.lit(bytes.fromhex("b2c4b5bb22")), F.substring("d", 6, 1 << 20))).when(k == 2, F.substring("d", 1, 38)).otherwise(F.concat(F.col("d"), F.lit(b"\0")))
    e = D.decode_documents(data.select("source_id", bad.alias("data")), PART)
    return e.where("kind = 'failure'").select(key_of("p_partkey"), F.col("keyword").alias("failure"))


@query("SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1")
def udtf_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parser as a SQL table function."""
    D.register_udtfs(spark)
    order_documents(spark, sf_dir).createOrReplaceTempView("order_documents")
    return spark.sql("SELECT CAST(source_id AS BIGINT) AS l_orderkey, count(*) AS lines FROM order_documents, LATERAL parse_compounds(text) WHERE keyword = 'line' GROUP BY 1")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, [0, 6 + CAST(len(n_name) AS INTEGER)] AS offsets, ['Key', 'Name'] AS headings, ['about ' || n_name] AS comments FROM nation")
def tabulated_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables inside documents: marker offsets and headings of each block."""
    gap = F.repeat(F.lit(" "), F.char_length("n_name") + 1)
    n = load(spark, sf_dir, "nation")
    docs = as_documents(n, "n_nationkey", F.lit(""), F.concat(F.lit("# about "), F.col("n_name")), F.concat(F.lit("# Key"), gap, F.lit("# Name")), F.concat(F.lit("key"), F.repeat(F.lit(" "), F.char_length("n_name") + 3), F.col("n_name")))
    b = D.blocks(docs)
    return b.where("tabulation IS NOT NULL").select(key_of("n_nationkey"), "tabulation.offsets", "tabulation.headings", "comments")


@query("""SELECT 'E209' AS code, count(*) AS n FROM nation WHERE n_nationkey % 4 = 1 UNION ALL SELECT 'E203', count(*) FROM nation WHERE n_nationkey % 4 = 2 UNION ALL SELECT 'E210', count(DISTINCT n_regionkey) FROM nation WHERE n_nationkey % 4 = 3""")
def catalog_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema validity as relational checks over a catalog: a schema per nation, with a fault planted by the nation's key."""
    rows = load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").collect()
    schemas = {}
    for r in rows:
        k = r["n_nationkey"]
        schemas[str(k)] = Schema(f"s{k}", Struct("", (Member("field", "Nowhere" if k % 4 == 1 else "String", "a"), Member("field", "String", "b", required="loose", default="x" if k % 4 == 2 else None))))
    c = catalog(spark, schemas)
    twice = load(spark, sf_dir, "nation").where("n_nationkey % 4 = 3").select(F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("schema_id"), F.lit("Twice").alias("type_name"), F.explode(F.array(F.lit("struct"), F.lit("scalar"))).alias("kind"))
    types = c["types"].unionByName(twice)
    found = checks.duplicate_definitions(types).select("schema_id", F.lit("E210").alias("code"))
    found = found.unionByName(checks.unresolved_types(c["members"], types).select("schema_id", F.lit("E209").alias("code")))
    found = found.unionByName(c["members"].where("default_text IS NOT NULL AND NOT required").select("schema_id", F.lit("E203").alias("code")))
    return checks.summary(found.distinct())


@query("""SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_type, ts, event_id) - 1 AS INTEGER) AS sib_ord FROM events""")
def semantic_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children in member order (here the types by name), source order within a member, by a window."""
    e = checks.semantic_order(D.elements(event_documents(spark, sf_dir), EVENTS)).where("elem_id > 0")
    return e.select(key_of("user_id"), F.substring("text", 2, 20).cast("long").alias("event_id"), "sib_ord")


@query("SELECT code, n FROM (SELECT 'E306' AS code, count(*) AS n FROM events WHERE event_type = 'error' UNION ALL SELECT 'E310', count(*) FROM events WHERE event_type = 'signup')")
def streamed_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same validation over a stream of Parquet files, one micro-batch at a time, into a table."""
    base = new_path(spark, "stream")
    e = load(spark, sf_dir, "events")
    word = F.when(F.col("event_type") == "signup", F.lit("Not an identifier")).otherwise(F.lit("fine"))
    as_documents(e, "event_id", F.concat(F.col("event_type"), F.when(word.contains(" "), "  ").otherwise(" "), word)).repartition(4).write.parquet(f"{base}/in")
    s = body("events", *(f"field {t} Identifier optional repeatable" for t in EVENT_TYPES if t != "error"))
    found = D.errors(stream_table(spark, f"{base}/in", "source_id string, text string"), s)
    q = write_stream(found, f"{base}/out", f"{base}/checkpoint")
    q.awaitTermination()
    return checks.summary(spark.read.schema(found.schema).parquet(f"{base}/out"))


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1")
def first_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword search: the first child of a keyword below each document's root."""
    found = reports.first_by_keyword(D.compounds(event_documents(spark, sf_dir)), "click").where("parent_id = 0")
    return found.select(key_of("user_id"), F.substring(F.get(F.col("atoms"), 0)["text"], 2, 20).cast("long").alias("event_id"))


FLAGGED = body("part", "field name String", "field small Flag optional")


@query("SELECT p_partkey, 'E311' AS walked, 'E311' AS relational FROM part WHERE p_size > 25")
def flag_content_e311(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags with content, by the walk and by a join of flags with their compounds."""
    docs = as_documents(load(spark, sf_dir, "part"), "p_partkey", field("name", F.col("p_name")), F.when(F.col("p_size") > 25, "small very").otherwise("small"))
    walked = D.errors(docs, FLAGGED).select("source_id", F.col("code").alias("walked"))
    relational = checks.filled_flags(D.elements(docs, FLAGGED), D.compounds(docs)).select("source_id", F.col("code").alias("relational"))
    return walked.join(relational, "source_id", "full").select(key_of("p_partkey"), "walked", "relational")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'E312' ELSE 'E313' END AS code FROM part WHERE p_partkey % 3 < 2")
def codec_e312(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that a bound codec rejects, and codecs nobody bound."""
    s = Schema("part", Struct("", (Member("field", "Size", "size", required="loose"), Member("field", "Other", "other", required="loose"))), scalars=(Scalar("Size", ("string",), (), "decimal-varint"), Scalar("Other", ("string",), (), "unbound")))
    k = F.col("p_partkey") % 3
    line = F.when(k == 0, F.concat(F.lit("size x"), F.col("p_size").cast("string"))).when(k == 1, F.concat(F.lit("other "), F.col("p_size").cast("string"))).otherwise(F.concat(F.lit("size "), F.col("p_size").cast("string")))
    return D.errors(as_documents(load(spark, sf_dir, "part"), "p_partkey", line), s, codecs={"decimal-varint": DECIMAL_VARINT}).select(key_of("p_partkey"), "code")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def unstacked_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacked sequences of status and priority hashes found again in a library of eight."""
    names = ["O", "F", "P", "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    by_name = {n: hashes.blake3(n.encode()) for n in names}
    table = F.create_map(*[F.lit(x) for n, h in by_name.items() for x in (n, h)])
    o = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: table[x["o_orderpriority"]]).alias("hs"))
    stacked = o.select("o_custkey", "hs", hashes.stack_column(F.col("hs")).alias("s"))
    found = hashes.with_unstacked(stacked, "s", "back", hashes.HashLibrary(by_name.values()))
    return found.where(F.col("hs") == F.col("back")).select("o_custkey", F.size("back").cast("long").alias("n"))


@query("""SELECT o_orderkey, 0 AS n, o_orderkey || '#0 [' || (15 + len(CAST(o_orderkey AS VARCHAR))) || ',' || (17 + len(CAST(o_orderkey AS VARCHAR))) || ') E108 trailing spaces' AS line FROM orders WHERE o_orderkey % 2 = 0""")
def problem_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("order x"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "  ").otherwise(""))
    docs = as_documents(load(spark, sf_dir, "orders"), "o_orderkey", line)
    r = reports.report(D.parse_errors(docs))
    return r.select(key_of("o_orderkey"), "n", "line")


@query("SELECT o_custkey, 'order o' || o_orderkey AS label, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS BIGINT) AS children FROM orders")
def document_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an outline shows of the customers' documents: orders with their numbers of children."""
    c = saved(D.compounds(customer_documents(spark, sf_dir)), "compounds")
    o = reports.outline(c).where("depth = 0 AND label LIKE 'order%'")
    n = c.groupBy("source_id", "doc_ord", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("children"))
    return o.join(n, ["source_id", "doc_ord", "node_id"]).select(key_of("o_custkey"), "label", "children")


@query("SELECT CAST(c_custkey AS VARCHAR) AS source_id, 'tel 1.0' || chr(10) || chr(10) || '# Merge conflict (agent a, ts=4): insert — target was removed' || chr(10) || 'name ' || c_name || '  # checked' || chr(10) || 'tag new' || chr(10) || 'tag vip' || chr(10) AS text, 4 AS applied, 1 AS demoted, 0 AS malformed, 'merged' AS status FROM customer")
def edit_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts, a remark, a delete and one refused edit on each document."""
    s = body("customer", "field name String", "field tag String optional repeatable")
    docs = as_documents(load(spark, sf_dir, "customer"), "c_custkey", F.lit(""), field("name", F.col("c_name")), F.lit("tag old"))
    ops = ['{"op": "attach-remark", "path": [[0, 0]], "value": "checked"}', '{"op": "insert", "path": [], "compound": "tag vip"}', '{"op": "insert-before", "path": [[0, 2]], "compound": "tag new"}', '{"op": "delete", "path": [[0, 1]]}', '{"op": "insert", "path": [], "compound": "nope x"}']
    e = docs.select("source_id", F.posexplode(F.array(*map(F.lit, ops))).alias("timestamp", "edit")).withColumn("agent", F.lit("a"))
    return edits.merge_sources(docs, e, s)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' documents with nested orders, parsed, typed and addressed by a path in each, in one pass."""
    found = D.paths(customer_documents(spark, sf_dir), CUSTOMER, {"first": "/order/0/status"})
    return found.select(key_of("c_custkey"), "status", "text")
