"""Scans and sinks of nested JSON, CSV and embedded binaries, all by Spark's own readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE64 = r"^[A-Za-z0-9+/]*={0,2}$"
MIMES = {"image/jpeg": ".jpg", "image/png": ".png", "image/webp": ".webp"}


def overlay_parents(spark: SparkSession, path: str, fields: list[str], nullable: list[str]) -> DataFrame:
    """SRC2: curated parents of ``booths`` arrays. Unnamed ones are skipped; of the listed fields those with a value are kept,
    and a null that is written out is kept for the nullable ones, which a map of variants tells from an absent key."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "booths array<map<string,variant>>")["booths"].alias("b"))
    rows = raw.select(F.explode("b").alias("m")).withColumn("name", F.trim(F.try_variant_get(F.try_element_at("m", F.lit("name")), "$", "string"))).filter("name <> ''")
    keep = lambda k, v: (k.isin(fields) & F.coalesce(~F.is_variant_null(v), F.lit(False))) | k.isin(nullable)
    text = F.transform_values(F.map_filter("m", keep), lambda k, v: F.try_variant_get(v, "$", "string"))
    return rows.select("name", text.alias("payload"))


def overlay_children(spark: SparkSession, path: str, categories: list[str]) -> tuple[DataFrame, DataFrame]:
    """SRC3: (rows, rejects) of ``menu_items`` arrays. A row needs its own and its parent's name; rename_to is split off; an
    unknown category is rejected."""
    kind = "menu_items array<struct<booth_name:string,name:string,rename_to:string,category:string,price_usd:double,description:string>>"
    rows = spark.read.text(path, wholetext=True).select(F.inline(F.from_json("value", kind)["menu_items"]))
    rows = rows.withColumn("name", F.trim("name")).withColumn("booth_name", F.trim("booth_name")).filter("name <> '' and booth_name <> ''")
    known = F.col("category").isNull() | F.col("category").isin(categories)
    return rows.filter(known), rows.filter(~known)


def folders(spark: SparkSession, root: str, file: str, schema: str) -> DataFrame:
    """SRC4: one folder a key, of those that hold ``file``; the key is the folder's name."""
    rows = spark.read.schema(schema).option("multiLine", True).json(f"{root}/*/{file}")
    return rows.withColumn("key", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


CHANGESET = "version int, generated_at string, festival string, menu_items array<struct<name:string,booth_name:string,category:string,price_usd:double,rename_to:string,new:boolean,deleted:boolean,photo:struct<id:string,mime:string,data_base64:string>>>"


def changeset(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """SRC7, PRJ6: changes of version 1; the schema is the list of keys that are let in, other versions fail. One changeset a file,
    or with ``lines`` one a line."""
    raw = spark.read.schema(CHANGESET).option("multiLine", not lines).json(path)
    ok = F.when(F.col("version") == 1, F.col("menu_items")).otherwise(F.raise_error(F.lit("changeset is not of version 1")))
    return raw.select("festival", F.inline(ok))


def photo_name(id: Column, mime: Column) -> Column:
    """SRC8: a safe file name: plain ids stay, others become the hash of themselves."""
    stem = F.when(id.rlike(r"^[A-Za-z0-9][A-Za-z0-9_-]{0,63}$"), id).otherwise(F.concat(F.lit("photo-"), F.substring(F.sha2(id, 256), 1, 32)))
    ext = F.create_map(*(F.lit(x) for kv in MIMES.items() for x in kv))[mime]
    return F.concat(stem, F.coalesce(ext, F.lit(".jpg")))


def photos(rows: DataFrame) -> DataFrame:
    """SRC8: (file, bytes) of (id, mime, data_base64); what is no base64 is dropped."""
    return rows.filter(F.col("data_base64").rlike(BASE64)).select(photo_name(F.col("id"), F.col("mime")).alias("file"), F.try_to_binary("data_base64", F.lit("base64")).alias("bytes")).filter("bytes is not null")


def write_feed(rows: DataFrame, key: str, folder: str) -> DataFrame:
    """SNK3: one folder of JSON lines a key, and an index row each. Keys are dealt to writers by value, so a key is in few files."""
    rows.repartition(key).write.mode("overwrite").partitionBy(key).json(f"{folder}/feed")
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def write_manifest(rows: DataFrame, folder: str) -> None:
    """SNK4"""
    rows.write.mode("overwrite").json(f"{folder}/manifest-json")
    rows.write.mode("overwrite").option("header", True).csv(f"{folder}/manifest-csv")


def append_history(snapshot: DataFrame, folder: str) -> DataFrame:
    """SNK6: appends a metrics row to a history table and returns the history."""
    snapshot.write.mode("append").parquet(folder)
    return snapshot.sparkSession.read.schema(snapshot.schema).parquet(folder)
