"""Text sources and sinks: facts bundles, manifests, CSV tables, C headers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FACTS = "pack_id string, label string, address bigint, function_name string, verdict string, confidence double, facts map<string,string>"
MANIFEST = "binary_path string, dataset string, sample_id string, gt_stem string, output_stem string, eval_scope string, notes string"
# Sizes in bytes of the field types in device headers.
FIELD_SIZES = {"uint8_t": 1, "int8_t": 1, "uint16_t": 2, "int16_t": 2, "uint32_t": 4, "int32_t": 4}


def parsed(df: DataFrame, column: str, schema: str) -> DataFrame:
    """``df`` with the fields of ``schema`` read from a column of JSON objects, ``_extra``, a map of all other fields as
    text, and ``_refused``, true where the text is no JSON object; such rows stay, their fields null."""
    known = [c.strip().split()[0].strip("`") for c in re.split(r",(?![^<(]*[>)])", schema)]
    rows = df.withColumn("_all", F.from_json(column, "map<string,string>")).withColumn("_own", F.from_json(column, schema))
    extra = F.map_filter("_all", lambda k, _: ~k.isin(known))
    return rows.select(*[F.col(c) for c in df.columns if c not in known], *[F.col(f"_own.{k}").alias(k) for k in known], extra.alias("_extra"), F.col("_all").isNull().alias("_refused"))


def read_facts(spark: SparkSession, folder: str) -> DataFrame:
    """A facts bundle: one JSON object per line. Fields beyond the schema are in ``_extra``; lines that are no object stay
    as rows marked ``_refused``, with their text in ``_line``."""
    rows = parsed(spark.read.text(f"{folder}/facts").withColumn("_line", F.col("value")), "value", FACTS)
    return rows.drop("value").withColumn("_line", F.when(F.col("_refused"), F.col("_line")))


def write_facts(df: DataFrame, folder: str) -> None:
    """Write a facts bundle and beside it its index: counts by label and verdict."""
    df.write.mode("overwrite").json(f"{folder}/facts")
    df.groupBy("label", "verdict").agg(F.count("*").alias("n"), F.countDistinct("function_name").alias("functions")).write.mode("overwrite").json(f"{folder}/index")


def select_facts(df: DataFrame, labels: list[str] | None = None, address: int | None = None, function: str | None = None, verdict: str | None = None) -> DataFrame:
    """Facts by any of label, address, part of the function name and verdict; the filters reach the scan."""
    if labels:
        df = df.filter(F.col("label").isin(labels))
    if address is not None:
        df = df.filter(F.col("address") == address)
    if function:
        df = df.filter(F.col("function_name").contains(function))
    if verdict:
        df = df.filter(F.col("verdict") == verdict)
    return df


def with_source_hints(sinks: DataFrame, sources: DataFrame) -> DataFrame:
    """Sinks with the labels of all sources in the same function, in order."""
    hints = sources.groupBy("function_name").agg(F.array_sort(F.collect_set("label")).alias("source_hints"))
    return sinks.join(hints, "function_name", "left").withColumn("source_hints", F.coalesce("source_hints", F.array().cast("array<string>")))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest, either a JSON list or an object with ``samples``; missing stems are filled from the file name."""
    rows = spark.read.schema(f"{MANIFEST}, samples array<struct<{MANIFEST.replace(' string', ': string')}>>").option("multiLine", "true").json(path)
    own = F.struct(*[F.col(c.split()[0]) for c in MANIFEST.split(", ")])
    rows = rows.select(F.explode(F.coalesce("samples", F.array(own))).alias("s")).select("s.*").filter("binary_path IS NOT NULL")
    stem = F.regexp_extract("binary_path", r"([^/]+?)(\.[^./]*)?$", 1)
    return rows.withColumn("sample_id", F.coalesce("sample_id", stem)).withColumn("gt_stem", F.coalesce("gt_stem", "sample_id")).withColumn("output_stem", F.coalesce("output_stem", stem)).withColumn("eval_scope", F.coalesce("eval_scope", F.lit("auto")))


# The columns of the two layouts of register tables.
REGISTER_TEST = ["Base address", "Reg address", "Reg name", "Reg cat", "Model Cat", "Read", "Write", "Correct cat", "Comments GT"]
REGISTER_LIST = ["adress", "name", "category", "Comments", "peripheral"]


def read_registers(spark: SparkSession, path: str) -> DataFrame:
    """A register table in CSV of either layout: base_addr, reg_addr, reg_name, category, read, write, peripheral. A layout
    without access flags says that both happen. Rows whose addresses aren't hexadecimal stay, marked ``_refused`` and with
    their text in ``_line``; lines of column names are no rows."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("value")).filter(F.trim("value") != "")
    cells = F.from_csv("value", ", ".join(f"c{i} string" for i in range(len(REGISTER_TEST))))
    rows = lines.select("value", cells.alias("c")).select("value", "c.*").filter(~F.lower(F.trim("c0")).isin("address", "base_addr", *[x[0].lower() for x in (REGISTER_TEST, REGISTER_LIST)]))
    number = lambda c: F.conv(F.nullif(F.regexp_extract(c, r"^\s*(?:0[xX])?([0-9a-fA-F]{1,8})\s*$", 1), F.lit("")), 16, 10).cast("bigint")
    long = F.col("c6").isNotNull()
    text = lambda a, b: F.coalesce(F.trim(F.when(long, a).otherwise(b)), F.lit(""))
    base, address = number(F.col("c0")), F.when(long, number(F.col("c1"))).otherwise(number(F.col("c0")))
    refused = base.isNull() | address.isNull()
    flag = lambda c: F.when(long, F.trim(c) == "1").otherwise(F.lit(True))
    return rows.select(base.alias("base_addr"), address.alias("reg_addr"), text(F.col("c2"), F.col("c1")).alias("reg_name"), text(F.col("c3"), F.col("c2")).alias("category"), flag("c5").alias("read"), flag("c6").alias("write"), text(F.lit(""), F.col("c4")).alias("peripheral"), refused.alias("_refused"), F.when(refused, F.col("value")).alias("_line"))


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    df.select(*fields).write.mode("overwrite").option("header", "true").csv(path)


def struct_offsets(headers: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, struct_name, field, offset) of the structs in C headers.

    An offset in the field's comment counts; without one it is the sum of the sizes of the fields before.
    """
    structs = headers.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?s)typedef struct\s*\{.*?\}\s*\w+\s*;"), 0)).alias("s"))
    body = structs.select(key, F.regexp_extract("s", r"\}\s*(\w+)\s*;$", 1).alias("struct_name"), F.posexplode(F.regexp_extract_all("s", F.lit(r"(?m)^[^\n;{}]*\b\w+\s+\w+(?:\[\d+\])?\s*;[^\n]*"), 0)).alias("no", "line"))
    part = lambda i: F.regexp_extract("line", r"\b(\w+)\s+(\w+)(?:\[(\d+)\])?\s*;", i)
    size = F.coalesce(*[F.when(part(1) == t, F.lit(n)) for t, n in FIELD_SIZES.items()], F.lit(4)) * F.coalesce(F.nullif(part(3), F.lit("")).cast("int"), F.lit(1))
    said = F.regexp_extract("line", r"(?i)offset:?\s*0x([0-9a-fA-F]+)", 1)
    before = Window.partitionBy(key, "struct_name").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.when(said != "", F.conv(said, 16, 10).cast("bigint")), F.sum(size).over(before), F.lit(0))
    return body.select(key, "struct_name", part(2).alias("field"), offset.alias("offset"))


def base_addresses(headers: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, name, address, type): ``#define`` constants, plain, as another constant plus an offset (one step), or as a
    typed pointer to either, ``#define X ((T *)0x…)`` and ``#define X ((T *)X_BASE)``, which have a type."""
    word = r"0[xX]([0-9a-fA-F]+)[uUlL]*"
    lines = headers.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?m)^[ \t]*#[ \t]*define[ \t]+\w+[ \t]+[^\n]+"), 0)).alias("line"))
    name: Column = F.regexp_extract("line", r"define\s+(\w+)", 1)
    value = F.trim(F.regexp_replace(F.regexp_extract("line", r"define\s+\w+\s+(.*)$", 1), r"/\*.*|//.*", ""))
    bare = F.regexp_replace(value, r"\(\s*u?int32_t\s*\)\s*", "")
    typed = r"^\(*\s*\(\s*(?:volatile\s+)?(\w+)\s*\*\s*\)\s*(\(?.*?\)?)\s*\)*$"
    kind = F.regexp_extract(bare, typed, 1)
    inner = F.when(kind != "", F.regexp_extract(bare, typed, 2)).otherwise(bare)
    rows = lines.select(key, name.alias("name"), F.nullif(kind, F.lit("")).alias("type"), F.regexp_replace(inner, "[()\\s]", "").alias("v"))
    number = lambda p: F.conv(F.regexp_extract("v", p, 1), 16, 10).cast("bigint")
    of = F.regexp_extract("v", rf"^([A-Za-z_]\w*)(?:\+{word})?$", 1)
    plus = F.coalesce(F.conv(F.nullif(F.regexp_extract("v", rf"^[A-Za-z_]\w*\+{word}$", 1), F.lit("")), 16, 10).cast("bigint"), F.lit(0))
    direct = rows.filter(F.col("v").rlike(f"^{word}$")).select(key, "name", number(f"^{word}$").alias("address"), "type")
    known = direct.select(key, F.col("name").alias("_of"), F.col("address").alias("_base"))
    sums = rows.withColumn("_of", of).withColumn("_plus", plus).filter("_of <> ''").join(known, [key, "_of"])
    one = sums.select(key, "name", (F.col("_base") + F.col("_plus")).alias("address"), "type", "v")
    # A typed pointer may stand on a sum: one step more.
    second = one.filter("type IS NULL").select(key, F.col("name").alias("_of"), F.col("address").alias("_base"))
    two = rows.withColumn("_of", of).withColumn("_plus", plus).filter("_of <> ''").join(second, [key, "_of"]).select(key, "name", (F.col("_base") + F.col("_plus")).alias("address"), "type")
    return direct.unionByName(one.drop("v")).unionByName(two).distinct()
