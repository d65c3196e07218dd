"""Rule packs, code lists and expected schemas from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: what a rule row may hold besides its names: texts, lists of texts, numbers
TEXTS = ("operator", "target_field", "field", "field2", "field3", "condition_field", "condition_value", "type_field", "business_rule", "format_type", "ref_template", "ref_field", "category_field", "contains", "key_field", "value_field")
LISTS = ("key_fields", "structured_fields", "categories", "tables")
NUMBERS = ("range_min", "range_max", "tolerance")
GATE = "array<struct<field:string,operator:string,value:string,values:array<string>>>"
TERMS = "array<struct<sign:int,field:string>>"
RULES = (
    "struct<rule_id:string,rule_level:string,rule_type:string,template:string,field_code:string,field_label:string,severity:string,message:string,explanation:string,dpm_reference:string,"
    "codelist:string,codelist_name:string,codelist_values:array<string>,de_only:boolean,enabled:boolean,"
    + ",".join([*(f"{k}:string" for k in TEXTS), *(f"{k}:array<string>" for k in LISTS), *(f"{k}:double" for k in NUMBERS)])
    + f",terms:{TERMS},condition:{GATE}>"
)
PACK = f"metadata struct<version:string>, rules array<{RULES}>, codelists map<string,array<string>>, field_codelist_map map<string,string>"
FIELD = "struct<field_code:string,code:string,column:string,label:string,data_type:string,type:string,constraint:string,mandatory:boolean,required:boolean>"


def read_pack(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PACK).option("multiLine", True).json(path)


def rules_of(pack: DataFrame) -> DataFrame:
    """One row a rule, with defaults; what a rule's kind alone needs is null in the others."""
    r = pack.select(F.explode("rules").alias("r")).select("r.*")
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("rule_id", "rule_level", "rule_type", "template", "field_code", "field_label", "message", "explanation", "dpm_reference")]
    return r.select(
        *text,
        F.coalesce("severity", F.lit("ERROR")).alias("severity"),
        F.col("severity").isNotNull().alias("severity_given"),
        F.coalesce("codelist", "codelist_name").alias("codelist"),
        "codelist_values",
        F.coalesce("de_only", F.lit(False)).alias("de_only"),
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
        *TEXTS, *LISTS, *NUMBERS, "terms", "condition",
    )


def codelists_of(pack: DataFrame) -> DataFrame:
    """(codelist, value)."""
    return pack.select(F.explode("codelists").alias("codelist", "vs")).select("codelist", F.explode("vs").alias("value"))


def field_lists_of(pack: DataFrame) -> DataFrame:
    """(table, field_code, codelist) from the ``table;field`` map."""
    pairs = pack.select(F.explode("field_codelist_map").alias("k", "codelist"))
    return pairs.select(F.split_part("k", F.lit(";"), F.lit(1)).alias("table"), F.split_part("k", F.lit(";"), F.lit(2)).alias("field_code"), "codelist")


def expected_schema(spark: SparkSession, path: str) -> DataFrame:
    """(table, field_code, label, data_type, constraint, mandatory); both spellings of a key are read."""
    raw = spark.read.schema(f"templates map<string,array<{FIELD}>>").option("multiLine", True).json(path)
    f = raw.select(F.explode("templates").alias("table", "fs")).select("table", F.explode("fs").alias("f"))
    return f.select("table", F.coalesce("f.field_code", "f.code").alias("field_code"), "f.label", F.coalesce("f.data_type", "f.type").alias("data_type"), "f.constraint", F.coalesce("f.mandatory", "f.required", F.lit(False)).alias("mandatory"))


def overlaid(rules: DataFrame, codelists: DataFrame, country: bool, lists: tuple[str, ...], prefix: str = "DE_") -> tuple[DataFrame, DataFrame]:
    """Rules and code lists of a country profile.

    Without it, rules marked for it are dropped.  With it, each named list is
    replaced by its prefixed form where that exists.
    """
    if not country:
        return rules.where("NOT de_only"), codelists
    own = codelists.where(F.col("codelist").isin(*[prefix + n for n in lists])).select(F.expr(f"substring(codelist, {len(prefix) + 1})").alias("codelist"), "value")
    return rules, codelists.join(own.select("codelist").distinct(), "codelist", "left_anti").unionByName(own)


def resolved_codelist(rules: DataFrame, codelists: DataFrame, field_lists: DataFrame) -> DataFrame:
    """(rule_id, value) of each rule's list: its own values, else the list it names, else the one of its table and field; none is no rows."""
    inline = rules.where(F.size(F.coalesce("codelist_values", F.array().cast("array<string>"))) > 0).select("rule_id", F.explode("codelist_values").alias("value")) if "codelist_values" in rules.columns else None
    others = rules if inline is None else rules.where(F.size(F.coalesce("codelist_values", F.array().cast("array<string>"))) == 0)
    named = others.join(codelists.select("codelist").distinct().withColumn("_has", F.lit(True)), "codelist", "left")
    mapped = field_lists.select(F.col("table").alias("template"), "field_code", F.col("codelist").alias("_mapped"))
    chosen = named.join(mapped, ["template", "field_code"], "left").select("rule_id", F.coalesce(F.when(F.col("_has"), F.col("codelist")), F.col("_mapped")).alias("codelist"))
    out = chosen.join(codelists, "codelist").select("rule_id", "value")
    return out if inline is None else inline.unionByName(out)
