"""Queries about schemas: layers, faults, relations, hashes, the registry, and binary documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.hashes import stack_hashes
from .operators import binary
from .plans import paths as P
from .plans.resolve import Resolver, resolve_documents
from .query_base import as_documents, field, key_of, load, query
from .sources import documents as D
from .sources import schemas as S
from .sources.parser import PRAGMA
from .sources.storage import new_path

HEAD = f"{PRAGMA} 1.0\n\nname s\n\n"

#: A schema fault and the lines that cause it.
FAULTY = {
    "E201": "document\n  field a String\n  field a String\n",
    "E202": "select P\n  validate v\ndocument\n  select P optional\n",
    "E203": "document\n  field a String optional\n    default x\n",
    "E204": "document\n  field a String\nlayer\n  name one\nlayer\n  name one\n",
    "E205": "select P\n  variant a Flag\ndocument\n  field a String\nlayer\n  name one\n  overlay\n    select P optional\n",
    "E206": "document\n  field a String\nlayer\n  name one\n  overlay\n    field a Identifier\n",
    "E208": "document\n  field tel String\n",
    "E209": "document\n  field a Nowhere\n",
    "E210": "record R\n  field a String\nrecord R\n  field b String\ndocument\n  field a R\n",
    "E211": "select P\n  variant a Flag\ndocument\n  select P optional\nlayer\n  name one\n  select P\n    exclude z\n",
    "E212": "select P\n  variant a Flag\ndocument\n  select P\nlayer\n  name one\n  select P\n    exclude a\n",
    "E213": "select P\n  variant a Flag\ndocument\n  select P optional\nlayer\n  name one\n  select P\n    variant b Flag\n",
    "E214": "document\n  field a String\nlayer\n  name one\n  overlay\n    field a String optional\n",
    "E215": "document\n  field a String\nlayer\n  name one\n  overlay\n    field a String repeatable\n",
    "E216": "select P\n  variant a Flag\n  exclude a\ndocument\n  select P optional\n",
    "E217": "select P\n  variant a Flag\ndocument\n  field p P\n",
    "E218": "scalar C\n  validate string\n  encoding a\ndocument\n  field c C\nlayer\n  name one\n  scalar C\n    encoding b\n",
    "E219": "record R\n  field a String\ndocument\n  field r R key\n",
    "E220": "document\n  field a String optional key\n",
    "E221": "document\n  field a String key\n  field b String key\n",
    "E222": "scalar C\n  pattern (?=a)\ndocument\n  field c C\n",
    "E223": "scalar C\n  pattern [a-c]+\ndocument\n  field c C\nlayer\n  name one\n  scalar C\n    pattern [a-d]+\n",
    "E224": "scalar C\n  encoding a\ndocument\n  field c C\n",
    "fine": "document\n  field a String\n",
}


def nth(values: list[str], n: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), n.cast("int"))


def case(values: list[str], n: str) -> str:
    """The same in SQL."""
    return f"CASE {n} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


@query(f"SELECT c_custkey, code FROM (SELECT c_custkey, {case(list(FAULTY), f'c_custkey % {len(FAULTY)}')} AS code FROM customer) WHERE code <> 'fine'")
def schema_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema source per customer, with one fault each that its declarations or the merge of its layers must show."""
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("source_id"), F.concat(F.lit(HEAD), nth(list(FAULTY.values()), F.col("c_custkey") % len(FAULTY))).alias("text"))
    return S.schema_faults(c).select(key_of("c_custkey"), "code")


def layered(n: Column, tight: Column, pattern: Column) -> Column:
    """A schema with two layers: one tightens a field, adds one, refines a scalar; the other excludes a variant and adds a validator."""
    lines = ["name s", "scalar Code", "  pattern [A-Z]+", "select State", "  variant open Flag", "  variant closed Flag", "record Item", "  field label String", "document", "  field code Code optional", "  field item Item optional repeatable", "  select State optional"]
    one = [F.lit("layer\n  name one\n  scalar Code"), F.concat(F.lit("    pattern  "), pattern), F.lit("  record Item"), F.concat(F.lit("    field label"), n, F.lit(" String optional")), F.lit("  overlay"), F.concat(F.lit("    field code Code "), tight)]
    two = F.lit("layer\n  name two\n  select State\n    exclude closed\n  record Item\n    validate checked\n    field label String\n  overlay\n    field extra Flag optional")
    return F.concat(F.concat_ws("\n", F.lit(f"{PRAGMA} 1.0"), *map(F.lit, lines), *one, two), F.lit("\n"))


_MEMBERS = """SELECT n_nationkey, '' AS type_name, 0 AS member_ix, 'code' AS keyword, n_nationkey % 2 = 0 AND n_nationkey % 3 <> 2 AS required FROM nation
    UNION ALL SELECT n_nationkey, '', 1, 'item', false FROM nation UNION ALL SELECT n_nationkey, '', 2, 'State', false FROM nation
    UNION ALL SELECT n_nationkey, '', 3, 'extra', false FROM nation WHERE n_nationkey % 3 <> 1
    UNION ALL SELECT n_nationkey, 'Item', 0, 'label', true FROM nation UNION ALL SELECT n_nationkey, 'Item', 1, 'label' || n_nationkey, false FROM nation WHERE n_nationkey % 3 <> 2"""


def nation_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layered schemas, with the layers that each row selects: both, the first or the second."""
    n, k = load(spark, sf_dir, "nation"), F.col("n_nationkey")
    text = layered(k.cast("string"), F.when(k % 2 == 0, "required").otherwise("optional"), F.when(k % 2 == 0, F.lit("[A-F]+")).otherwise(F.lit("[A-Z]{2}")))
    picked = F.when(k % 3 == 0, F.array(F.lit("one"), F.lit("two"))).when(k % 3 == 1, F.array(F.lit("one"))).otherwise(F.array(F.lit("two")))
    return n.select(k.cast("string").alias("source_id"), text.alias("text"), picked.alias("layers"))


@query(f"SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, type_name, member_ix, keyword, required FROM ({_MEMBERS})")
def layered_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members after the selected layers: tightened, added, with records merged member by member."""
    m = S.composed_members(nation_schemas(spark, sf_dir), "layers")
    return m.select(key_of("n_nationkey"), "type_name", "member_ix", F.coalesce("keyword", "member_type").alias("keyword"), "required")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, 'Code' AS name, CASE WHEN n_nationkey % 3 = 2 THEN ['[A-Z]+'] WHEN n_nationkey % 2 = 0 THEN ['[A-F]+'] ELSE ['[A-Z]{2}'] END AS patterns FROM nation")
def layered_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layer's pattern takes the place of the base's where it is proven narrower."""
    return S.composed_scalars(nation_schemas(spark, sf_dir), "layers").select(key_of("n_nationkey"), "name", "patterns")


@query("""SELECT c_custkey, c_custkey % 4 = 0 AS is_subtype FROM customer""")
def subtype_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A narrower schema against a wider one: by a field more, by a looser field, by a pattern, and the other way round."""
    wide = HEAD + "scalar C\n  pattern [A-Z]{2}\ndocument\n  field a C\n  field b String optional\n"
    more = ["document\n  field a C\n  field b String optional\n  field c String optional\n", "document\n  field a C optional\n  field b String optional\n", "document\n  field a C\n", "document\n  field a String\n  field b String optional\n"]
    narrow = [HEAD + "scalar C\n  pattern (EU|UK)\n" + x for x in more]
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("source_id"), nth(narrow, F.col("c_custkey") % 4).alias("sub"), F.lit(wide).alias("sup"))
    return S.subtypes(c).select(key_of("c_custkey"), "is_subtype")


@query("""SELECT p_partkey, regexp_full_match(p_brand, CASE p_partkey % 3 WHEN 0 THEN 'Brand#[0-9]{2}' WHEN 1 THEN 'Brand#[1-3]\\d|x{2,5}' ELSE '(?i)brand#[^0-2]+' END) AS literal, p_partkey % 3 = 0 AS ranged FROM part""")
def pattern_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A literal is contained in a pattern exactly if the pattern matches it; a range of brands in one of the three."""
    wide = nth([r"Brand#[0-9]{2}", r"Brand#[1-3]\d|x{2,5}", r"(?i)brand#[^0-2]+"], F.col("p_partkey") % 3)
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("source_id"), F.col("p_brand").alias("literal"), F.lit("Brand#[1-5][1-5]").alias("ranged"), wide.alias("wide"))
    one = S.patterns_contained(p, "literal").withColumnRenamed("is_contained", "literal")
    return one.join(S.patterns_contained(p, "ranged").withColumnRenamed("is_contained", "ranged"), "source_id").select(key_of("p_partkey"), "literal", "ranged")


@query("""SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, o AS ord, CASE o WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS layer, CASE WHEN o = 1 THEN 1 WHEN o = 0 THEN 25 ELSE 25 END AS same, 39 AS letters
    FROM nation, range(3) t(o)""")
def component_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of a schema's base and layers: the first layer differs by nation, base and second layer are the same for all; comments count for nothing."""
    n = nation_schemas(spark, sf_dir)
    commented = n.select("source_id", F.when(F.col("source_id").cast("int") % 2 == 0, F.replace("text", F.lit("name s\n"), F.lit("\n# a remark\n\nname s\n"))).otherwise(F.col("text")).alias("text"))
    h = S.schema_hashes(commented)
    same = h.groupBy("ord", "hash").agg(F.count("*").alias("same"))
    return h.join(same, ["ord", "hash"]).select(key_of("n_nationkey"), F.col("ord").cast("long").alias("ord"), "layer", F.col("same").cast("int").alias("same"), F.char_length("signature").alias("letters"))


@query("SELECT 's' || n_nationkey AS name, 1 AS copies, true AS resolves FROM nation")
def schema_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry written twice with the same sources holds each once; a resolver loaded from it knows them all."""
    path, n = new_path(spark, "registry"), load(spark, sf_dir, "nation")
    texts = n.select(F.concat(F.lit(f"{PRAGMA} 1.0\n\nname s"), F.col("n_nationkey").cast("string"), F.lit("\n\ndocument\n  field name String\n")).alias("text"))
    S.add_schemas(texts.where("length(text) % 2 = 0"), path)
    S.add_schemas(texts.unionByName(texts), path)
    schemas = S.load_schemas(spark, path)
    resolver = S.resolver_of(schemas)
    docs = D.documents(n.select(F.col("n_nationkey").cast("string").alias("source_id"), F.concat(F.lit(f"{PRAGMA} 1.0 x.example/s"), F.col("n_nationkey").cast("string"), F.lit("\n")).alias("text")))
    found = resolve_documents(docs, resolver).select(F.concat(F.lit("s"), F.col("source_id")).alias("name"), (F.col("resolution") == "resolved").alias("resolves"))
    return schemas.groupBy("name").agg(F.count("*").alias("copies")).join(found, "name").select("name", F.col("copies").cast("int").alias("copies"), "resolves")


def library() -> Resolver:
    r = Resolver(fetch={"x.example/remote:1.0.0": f"{PRAGMA} 1.0\n\nname remote\n\ndocument\n  field name String\n"}.get, built_in=("x.example/own:1.0.0",))
    r.add(f"{PRAGMA} 1.0\n\nname trade\n\ndocument\n  field name String\nlayer\n  name more\n  overlay\n    field key String optional\nlayer\n  name tight\n  overlay\n    field key String required\n")
    return r


WANTED = ["", "x.example/trade", "x.example/trade +more", "x.example/trade +more +tight", "x.example/trade +none", "x.example/other", "x.example/remote:1.0.0", "x.example/gone:1.0.0", "x.example/own:1.0.0", "Ḁ" * 33]
FOUND = ["untyped", "resolved", "resolved", "resolved", "unknown-layer", "not-found", "resolved", "fetch-failed", "resolved", "undecodable"]


@query(f"SELECT c_custkey, {case(FOUND, f'c_custkey % {len(WANTED)}')} AS resolution, CASE c_custkey % {len(WANTED)} WHEN 1 THEN 33 WHEN 2 THEN 37 WHEN 3 THEN 39 WHEN 6 THEN 33 WHEN 8 THEN 19 END AS identity FROM customer")
def layered_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every way to an answer: library, layers, selector and fetcher, built-in name, and each way to fail."""
    phrase = nth(WANTED, F.col("c_custkey") % len(WANTED))
    docs = D.documents(load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("source_id"), F.concat(F.lit(f"{PRAGMA} 1.0 "), phrase, F.lit("\n")).alias("text")))
    return resolve_documents(docs, library()).select(key_of("c_custkey"), "resolution", F.char_length("schema_id").alias("identity"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'trade' WHEN 1 THEN 'remote' END AS schema_name, CASE WHEN c_custkey % 3 < 2 THEN c_name END AS name, CASE c_custkey % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'resolved' ELSE 'not-found' END AS resolution FROM customer""")
def typed_by_pragma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one table typed by different schemas, each by its own pragma."""
    phrase = nth(["x.example/trade +more", "x.example/remote:1.0.0", "x.example/other"], F.col("c_custkey") % 3)
    docs = load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("source_id"), F.concat(F.lit(f"{PRAGMA} 1.0 "), phrase, F.lit("\n\n"), field("name", F.col("c_name")), F.lit("\n")).alias("text"))
    e = S.typed_documents(docs, library())
    return e.where("keyword = 'name' OR kind = 'untyped'").select(key_of("c_custkey"), "schema_name", F.col("text").alias("name"), "resolution")


PART_SCHEMA = f"{PRAGMA} 1.0\n\nname part\n\ndocument\n  field name String\n  field small Flag optional\n  field size String optional repeatable\n"


def part_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("p_size") < 10, F.lit("small"))
    return as_documents(load(spark, sf_dir, "part"), "p_partkey", field("name", F.col("p_name")), size, field("size", F.col("p_size")), F.when(F.col("p_size") > 40, F.lit("size  very large")))


_SIGN = stack_hashes(binary.component_hashes(S.read_schema(PART_SCHEMA)[0])).hex().upper()
#: The root's bytes in SQL: children by member, each an index and a length before its bytes.
_ROOT = """printf('%02X', 2 + CASE WHEN p_size < 10 THEN 1 ELSE 0 END + CASE WHEN p_size > 40 THEN 1 ELSE 0 END) || '00' || printf('%02X', len(p_name)) || hex(p_name)
    || CASE WHEN p_size < 10 THEN '01' ELSE '' END || '02' || printf('%02X', len(CAST(p_size AS VARCHAR))) || hex(CAST(p_size AS VARCHAR)) || CASE WHEN p_size > 40 THEN '020A' || hex('very large') ELSE '' END"""


@query(f"SELECT p_partkey, 'B2C4B5BB' || '21' || '{_SIGN}' || {_ROOT} AS data, CAST(NULL AS VARCHAR) AS failure FROM part")
def binary_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole binary documents, byte for byte: magic, signature, children in member order."""
    b = S.binary_documents(part_sources(spark, sf_dir), PART_SCHEMA)
    return b.select(key_of("p_partkey"), F.hex("data").alias("data"), "failure")


_META = binary.encode_root(S.read_schema(PART_SCHEMA)[0], S.META)


@query(f"SELECT p_partkey, 'B2C4B5BC' || '21' || '{_SIGN}' || '{(binary.encode_varint(len(_META)) + _META).hex().upper()}' || {_ROOT} AS data, p_name AS name, p_size < 10 AS small, CAST(p_size AS VARCHAR) AS size FROM part")
def binary_self_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the schema inside, decoded without any other knowledge."""
    b = S.binary_documents(part_sources(spark, sf_dir), PART_SCHEMA, self_contained=True)
    e = D.decode_documents(b, None)
    of = lambda k: F.min_by("text", F.when(F.col("keyword") == k, F.col("sib_ord")))
    back = e.where("elem_id > 0").groupBy("source_id").agg(of("name").alias("name"), F.bool_or(F.col("keyword") == "small").alias("small"), of("size").alias("size"))
    return b.join(back, "source_id").select(key_of("p_partkey"), F.hex("data").alias("data"), "name", "small", "size")


@query("SELECT count(*) AS n, 0 AS lost FROM part")
def binary_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The binary sink, read back and decoded."""
    path = new_path(spark, "binary")
    S.save_binary(S.binary_documents(part_sources(spark, sf_dir), PART_SCHEMA), path)
    e = D.decode_documents(spark.read.parquet(path), S._composed(PART_SCHEMA, None))
    return e.agg(F.count_if(F.col("elem_id") == 0).alias("n"), F.count_if(F.col("kind") == "failure").cast("int").alias("lost"))


@query("""SELECT a.n_nationkey AS a, b.n_nationkey AS b, a.n_regionkey = b.n_regionkey AND a.n_nationkey % 2 = b.n_nationkey % 2 AS same FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey + 5) % 25""")
def path_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths are equal by their components, whatever delimits them."""
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    path = lambda k, r, d: F.concat(F.lit(d), F.lit("region"), F.lit(d), F.col(r).cast("string"), F.lit(d), F.when(F.col(k) % 2 == 0, "name").otherwise("key"))
    other = n.select(((F.col("n_nationkey") + 20) % 25).alias("n"), F.col("n_nationkey").alias("b"), F.col("n_regionkey").alias("r"))
    both = n.join(other, F.col("n_nationkey") == F.col("n"))
    return both.select(F.col("n_nationkey").alias("a"), "b", P.same_path_column(path("n_nationkey", "n_regionkey", "/"), path("b", "r", ":")).alias("same"))
