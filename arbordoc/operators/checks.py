"""Constraint checks as relational operators over the elements table.

Each returns (source_id, doc_ord, code, elem_id, keyword). The schema's catalog is small and bounded by the schema, so it is
broadcast; what is counted or ranked is grouped by parent element, so one parent's children meet and nothing else does.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.registry import Validator
from ..plans.patterns import is_pattern, portable
from ..plans.schema import IDENTIFIER, TYPE_NAME, Schema, catalog
from ..sources.parser import SIGILS
from ..sources.storage import pieces

DOC = ["source_id", "doc_ord"]
PARENT = [*DOC, "parent_id"]
#: Predicates of the built-in validators.
NATIVE = {
    "string": lambda c: F.lit(True),
    "identifier": lambda c: c.rlike(rf"\A{IDENTIFIER}\z"),
    "type-name": lambda c: c.rlike(rf"\A{TYPE_NAME}\z"),
    "sigil": lambda c: (F.char_length(c) == 1) & F.lit(SIGILS).contains(c),
}


def _report(df: DataFrame, code: str, elem: str = "elem_id", keyword: str = "keyword") -> DataFrame:
    return df.select(*DOC, F.lit(code).alias("code"), F.col(elem).cast("int").alias("elem_id"), F.col(keyword).alias("keyword"))


def _tables(elements: DataFrame, schema: Schema) -> dict:
    return catalog(elements.sparkSession, {schema.name: schema})


def known(elements: DataFrame) -> DataFrame:
    return elements.where("kind <> 'unknown' AND elem_id > 0")


def unknown_keywords(elements: DataFrame, schema: Schema) -> DataFrame:
    """E306: children whose keyword their parent's type lacks; an anti join with the keywords of all types."""
    k = F.broadcast(_tables(elements, schema)["keywords"].select(F.col("type_name").alias("parent_type"), "keyword"))
    return _report(elements.where("elem_id > 0 AND origin = 'compound'").join(k, ["parent_type", "keyword"], "left_anti"), "E306")


def missing_required(elements: DataFrame, schema: Schema) -> DataFrame:
    """E307: struct elements by required members without default, less those that are filled. elem_id is the parent's."""
    m = F.broadcast(_tables(elements, schema)["members"].where("required AND default_text IS NULL").select("type_name", "member_ix", "keyword", "member_type"))
    wanted = elements.where("kind = 'struct'").select(*DOC, "elem_id", "type_name").join(m, "type_name")
    have = known(elements).select(*DOC, F.col("parent_id").alias("elem_id"), "member_ix").distinct()
    return _report(wanted.join(have, [*DOC, "elem_id", "member_ix"], "left_anti").withColumn("keyword", F.coalesce("keyword", "member_type")), "E307")


def repeated_members(elements: DataFrame, schema: Schema) -> DataFrame:
    """E308: members filled more than once though not repeatable; elem_id is the parent's."""
    m = F.broadcast(_tables(elements, schema)["members"].where("NOT repeatable").select(F.col("type_name").alias("parent_type"), "member_ix"))
    fills = known(elements).join(m, ["parent_type", "member_ix"]).groupBy(*PARENT, "member_ix").agg(F.count("*").alias("n"), F.min("keyword").alias("keyword"))
    return _report(fills.where("n > 1"), "E308", "parent_id")


def broken_runs(elements: DataFrame) -> DataFrame:
    """E309: each re-entry of a member whose run of children had ended; unknown keywords end no run."""
    order = Window.partitionBy(*PARENT).orderBy("source_ord")
    starts = known(elements).where("origin = 'compound'").withColumn("before", F.lag("member_ix").over(order)).where("before IS NULL OR before <> member_ix")
    runs = starts.withColumn("run", F.row_number().over(Window.partitionBy(*PARENT, "member_ix").orderBy("source_ord")))
    return _report(runs.where("run > 1"), "E309")


def duplicate_keys(elements: DataFrame, schema: Schema) -> DataFrame:
    """E314: keyed children of repeatable members, less the first of each key value within a parent."""
    m = F.broadcast(_tables(elements, schema)["members"].where("repeatable").select(F.col("type_name").alias("parent_type"), "member_ix"))
    keyed = known(elements).where("key_value IS NOT NULL").join(m, ["parent_type", "member_ix"], "left_semi").repartition(pieces(elements), *PARENT, "key_value")
    ranked = keyed.withColumn("n", F.row_number().over(Window.partitionBy(*PARENT, "key_value").orderBy("source_ord")))
    return _report(ranked.where("n > 1"), "E314")


def misfit_patterns(elements: DataFrame, schema: Schema) -> DataFrame:
    """E315: one row per scalar element and pattern it does not match as a whole; patterns are compiled once per plan."""
    rows = known(elements).where("kind = 'scalar'")
    per_type = {s.name: s.patterns for s in schema.scalars if s.patterns}
    bad = F.array()
    for name, patterns in per_type.items():
        fails = F.array(*[F.when(~(F.col("text").rlike(portable(p)) if is_pattern(p) else F.lit(False)), F.lit(p)) for p in patterns])
        bad = F.when(F.col("type_name") == name, fails).otherwise(bad.cast("array<string>"))
    return _report(rows.withColumn("bad", F.explode(F.filter(bad.cast("array<string>"), lambda p: p.isNotNull()))), "E315")


def misfit_values(elements: DataFrame, schema: Schema, validators: Mapping[str, Validator] | None = None) -> DataFrame:
    """E310: one row per scalar element and validator that rejects it; built-in validators are column predicates, named others UDFs."""
    rows = known(elements).where("kind = 'scalar'")
    bad: Column = F.array().cast("array<string>")
    for name in dict.fromkeys(e.type for s in schema.structs() for e in schema.entries(s.name) if e.kind == "scalar"):
        fails = [F.when(~_accepts(v, validators), F.lit(v)) for v in schema.scalar(name).validators]
        if fails:
            bad = F.when(F.col("type_name") == name, F.array(*fails)).otherwise(bad)
    return _report(rows.withColumn("bad", F.explode(F.filter(bad, lambda v: v.isNotNull()))), "E310")


def _accepts(name: str, validators: Mapping[str, Validator] | None) -> Column:
    if name in NATIVE:
        return NATIVE[name](F.col("text"))
    if not validators or name not in validators:
        return F.lit(False)
    check = validators[name]
    import pandas as pd
    from pyspark.sql.types import BooleanType

    def accept(values: pd.Series) -> pd.Series:
        return values.map(lambda v: check(v) is None)

    return F.pandas_udf(accept, BooleanType())(F.col("text"))


def filled_flags(elements: DataFrame, compounds: DataFrame) -> DataFrame:
    """E311, from compounds joined to their flag elements: flags with atoms. compounds: as of the same sources."""
    flags = elements.where("kind = 'flag' AND origin = 'compound'").select(*DOC, "elem_id", "keyword")
    with_atoms = compounds.where(F.size("atoms") > 0).select(*DOC, "keyword", "node_id")
    return _report(flags.join(with_atoms, [*DOC, "keyword"]).dropDuplicates([*DOC, "elem_id"]), "E311")


def struct_views(elements: DataFrame, type_name: str) -> DataFrame:
    """(source_id, doc_ord, elem_id, fields map<keyword, text>): the scalar and flag children of each element of a type."""
    children = known(elements).where((F.col("parent_type") == type_name) & F.col("kind").isin("scalar", "flag"))
    # one exchange, by element, in pieces that stay as large as they are while the input grows: both groupings sort in memory
    children = children.select(*PARENT, "keyword", "text", "sib_ord").repartition(pieces(elements), *PARENT)
    first = children.groupBy(*PARENT, "keyword").agg(F.min_by(F.coalesce("text", F.lit("")), "sib_ord").alias("text"))
    return first.groupBy(*PARENT).agg(F.map_from_entries(F.collect_list(F.struct("keyword", "text"))).alias("fields")).withColumnRenamed("parent_id", "elem_id")


def misfit_structs(elements: DataFrame, type_name: str, keyword: str, holds) -> DataFrame:
    """E310 of a cross-field rule: holds(fields) is a column over struct_views, true where the rule holds; null counts as holding."""
    return misfit_views(struct_views(elements, type_name), keyword, holds)


def misfit_views(views: DataFrame, keyword: str, holds) -> DataFrame:
    """The same over views, which documents.struct_views gives without an exchange."""
    return _report(views.where(~F.coalesce(holds(F.col("fields")), F.lit(True))).withColumn("keyword", F.lit(keyword)), "E310")


def with_defaults(elements: DataFrame, schema: Schema) -> DataFrame:
    """(source_id, doc_ord, elem_id, keyword, text): default values of members no element fills; elem_id is the parent's.

    For elements that came without defaults (origin default left out): required members with a default, less filled ones.
    """
    m = F.broadcast(_tables(elements, schema)["members"].where("required AND default_text IS NOT NULL").select("type_name", "member_ix", "keyword", F.col("default_text").alias("text")))
    written = known(elements).where("origin <> 'default'").select(*DOC, F.col("parent_id").alias("elem_id"), "member_ix").distinct()
    return elements.where("kind = 'struct'").select(*DOC, "elem_id", "type_name").join(m, "type_name").join(written, [*DOC, "elem_id", "member_ix"], "left_anti").select(*DOC, "elem_id", "keyword", "text")


def semantic_order(elements: DataFrame) -> DataFrame:
    """elements with sib_ord made anew from member order, atoms before compounds before defaults, then source order."""
    rank = F.when(F.col("origin") == "atom", 0).when(F.col("origin") == "compound", 1).otherwise(2)
    order = Window.partitionBy(*PARENT).orderBy(F.col("member_ix").asc_nulls_last(), rank, "source_ord")
    return elements.withColumn("sib_ord", (F.row_number().over(order) - 1).cast("int"))


def keyword_order(members: DataFrame, variants: DataFrame) -> DataFrame:
    """(schema_id, type_name, keyword, keyword_ix) of catalog rows: fields give one keyword, selects one per variant, numbered in member and variant order."""
    flat = members.join(variants.withColumnRenamed("type_name", "member_type"), ["schema_id", "member_type"], "left")
    flat = flat.select("schema_id", "type_name", "member_ix", F.coalesce("variant_ix", F.lit(0)).alias("variant_ix"), F.coalesce("variant", "keyword").alias("keyword"))
    order = Window.partitionBy("schema_id", "type_name").orderBy("member_ix", "variant_ix")
    return flat.select("schema_id", "type_name", "keyword", (F.row_number().over(order) - 1).alias("keyword_ix"))


def summary(errors: DataFrame) -> DataFrame:
    return errors.groupBy("code").agg(F.count("*").alias("n"))


def duplicate_definitions(types: DataFrame) -> DataFrame:
    """E210 over a catalog of declared types."""
    return types.groupBy("schema_id", "type_name").agg(F.count("*").alias("n")).where("n > 1")


def unresolved_types(members: DataFrame, types: DataFrame) -> DataFrame:
    """E209 over a catalog: member types that nothing defines."""
    return members.select("schema_id", F.col("member_type").alias("type_name")).distinct().join(types.select("schema_id", "type_name"), ["schema_id", "type_name"], "left_anti")
