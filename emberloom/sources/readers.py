"""Sources: delimited text, JSON documents, CSV, XML records, and their normal forms."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberloom.functions import strings

#: The registry's record, as all sources give it.
MARK = T.StructType(
    [
        T.StructField("application_no", T.StringType()),
        T.StructField("registration_no", T.StringType()),
        T.StructField("application_date", T.DateType()),
        T.StructField("registration_date", T.DateType()),
        T.StructField("name_ko", T.StringType()),
        T.StructField("name_en", T.StringType()),
        T.StructField("mark_kind", T.StringType()),
        T.StructField("applicant", T.StringType()),
        T.StructField("right_holder", T.StringType()),
        T.StructField("vienna_codes", T.ArrayType(T.StringType())),
        T.StructField("nice_classes", T.ArrayType(T.IntegerType())),
        T.StructField("similarity_codes", T.ArrayType(T.StringType())),
        T.StructField("image_key", T.StringType()),
    ]
)


def delimited(spark: SparkSession, path: str, separator: str, columns: list[str]) -> DataFrame:
    """Text with a separator of any length and one header line per file: rows are padded or
    cut to the header, blank fields are null. The schema is given, not inferred."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    header = F.lit(separator.join(columns))
    fields = F.split("value", re.escape(separator), -1)
    body = lines.where(F.regexp_replace("value", r"\s", "") != F.regexp_replace(header, r"\s", ""))
    return body.select(*[strings.blank_to_null(F.try_element_at(fields, F.lit(k + 1))).alias(c) for k, c in enumerate(columns)])


def json_records(spark: SparkSession, path: str, records: str, element: T.StructType) -> DataFrame:
    """One JSON document with an array of records; gzip by its ending."""
    schema = T.StructType([T.StructField(records, T.ArrayType(element))])
    return spark.read.schema(schema).json(path, multiLine=True).select(F.inline(records))


def json_array(spark: SparkSession, path: str, element: T.StructType) -> DataFrame:
    """A JSON array of records, plain or gzip."""
    return spark.read.schema(element).json(path, multiLine=True)


def csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a header; every column a string, '' null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')
    return rows.select(*[strings.blank_to_null(F.col(c)).alias(c) for c in columns])


def xml_items(spark: SparkSession, path: str, row_tag: str, columns: list[str], multi: tuple[str, ...] = ()) -> DataFrame:
    """Flat XML items; columns in multi are '|' separated and become arrays."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    return rows.select(*[split_multi(F.col(c)).alias(c) if c in multi else strings.blank_to_null(F.col(c)).alias(c) for c in columns])


def split_multi(c: Column) -> Column:
    return F.coalesce(F.filter(F.transform(F.split(c, r"\|"), lambda x: F.trim(x)), lambda x: x != ""), F.array())


def checked_status(rows: DataFrame, status: str, good: str = "00") -> DataFrame:
    """Fails when a response's status is not the good one."""
    bad = F.raise_error(F.concat(F.lit("response status "), F.col(status)))
    return rows.withColumn(status, F.when(F.coalesce(F.col(status), F.lit(good)) == good, F.col(status)).otherwise(bad))


def total_count(xml: Column, path: str = "//totalCount") -> Column:
    """A response's total, null if absent; a value that is no number fails."""
    text = F.xpath_string(xml, F.lit(path))
    return F.when(F.trim(text) == "", None).when(text.rlike(r"^\s*\d+\s*$"), F.trim(text).cast("bigint")).otherwise(F.raise_error(F.concat(F.lit("no total: "), text)))


def detail(rows: DataFrame) -> DataFrame:
    """Nested registry detail (application_no, codes, goods[code, nice], vienna) in the record's form."""
    own = F.array_sort(F.array_distinct(F.coalesce("codes", F.array().cast("array<string>"))))
    sub = F.array_sort(F.array_distinct(F.flatten(F.transform(F.coalesce("goods", F.array().cast("array<struct<code:string,nice:int>>")), lambda g: F.array(g["code"])))))
    classes = F.array_sort(F.array_distinct(F.filter(F.transform("goods", lambda g: g["nice"]), lambda x: x.isNotNull())))
    return rows.select("application_no", F.when(F.size(own) > 0, own).otherwise(sub).alias("similarity_codes"), classes.alias("nice_classes"), "vienna")


def harmonised(rows: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Columns of any of the given spellings under one name; the first with a value counts."""
    return rows.select(*[F.coalesce(*[strings.blank_to_null(F.col(c).cast("string")) for c in spelt if c in rows.columns] or [F.lit(None).cast("string")]).alias(name) for name, spelt in names.items()])


def jdbc_by_keys(spark: SparkSession, url: str, table: str, key: str, keys: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a database table by key; up to 1000 keys are pushed down, more are joined."""
    rows = spark.read.format("jdbc").options(url=url, dbtable=table).load().select(*columns)
    few = [r[0] for r in keys.select(key).distinct().limit(1001).collect()]
    return rows.where(F.col(key).isin(few)) if len(few) <= 1000 else rows.join(keys.select(key).distinct(), key, "left_semi")


def denormalised(main: DataFrame, applicants: DataFrame, holders: DataFrame, vienna: DataFrame, goods: DataFrame, kinds: list[str]) -> DataFrame:
    """One record per application: representative applicant (least seq), first holder of the
    registration, ordered distinct Vienna codes, distinct classes and codes; of the given kinds."""
    first = applicants.groupBy("application_no").agg(F.min_by("applicant", "seq").alias("applicant"))
    holder = holders.groupBy("registration_no").agg(F.min_by("right_holder", "pos").alias("right_holder"))
    ordered = F.transform(F.array_sort(F.collect_set(F.struct("pos", "code"))), lambda s: s["code"])
    codes = vienna.groupBy("application_no").agg(F.array_distinct(ordered).alias("vienna_codes"))
    classes = goods.groupBy("application_no").agg(F.array_sort(F.collect_set("nice_class")).alias("nice_classes"), F.array_sort(F.collect_set("similarity_code")).alias("similarity_codes"))
    wanted = main.where(F.col("mark_kind").isin(*kinds))
    return wanted.join(first, "application_no", "left").join(holder, "registration_no", "left").join(codes, "application_no", "left").join(classes, "application_no", "left")
