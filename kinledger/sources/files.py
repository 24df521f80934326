"""File sinks and scans: labelled pairs as CSV, the corpus with its format version, snapshots, models and their registry."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinledger.functions.text import name_core, normalize_name_folded
from kinledger.functions.urls import normalize_hostname

FORMAT_VERSION = 1
DECIMALS = 6


def write_pairs(df: DataFrame, path: str, features: list[str]) -> None:
    """CSV with a header, quoted where needed, features with six decimals; one file per task."""
    fixed = [F.format_string(f"%.{DECIMALS}f", F.col(c)).alias(c) if c in features else F.col(c) for c in df.columns]
    df.select(*fixed).write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def read_pairs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The pairs of :func:`write_pairs`; a header other than ``schema`` names is an error, not a shifted column."""
    wanted = spark.createDataFrame([], schema).columns
    found = spark.read.option("header", True).option("escape", '"').csv(path).columns
    if found != wanted:
        raise ValueError(f"columns {found} instead of {wanted}")
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("enforceSchema", True).csv(path)


def write_index(entities: DataFrame, path: str, version: int = FORMAT_VERSION) -> None:
    """The corpus as Parquet by source, each row with the format version it was written in."""
    entities.withColumn("format_version", F.lit(version)).write.partitionBy("source").mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str, version: int = FORMAT_VERSION) -> DataFrame:
    """The corpus written by :func:`write_index`; another format version is refused before any row is used."""
    df = spark.read.parquet(path)
    other = df.where(F.col("format_version") != version).limit(1).collect()
    if other:
        raise ValueError(f"index of format {other[0].format_version}, this code reads {version}: build it again")
    return df.drop("format_version")


def decode_page(raw: Column) -> Column:
    """Text of a page's bytes: UTF-8 where they are that throughout, Latin-1 otherwise."""
    as_text = F.decode(F.when(F.is_valid_utf8(raw.cast("string")), raw), "UTF-8")
    return F.coalesce(as_text, F.decode(raw, "ISO-8859-1"))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON snapshot {fetchedAt, banks: [...]}: position becomes the row number, the day of fetching the date.

    A file without a list of banks is an error.
    """
    bank = "struct<id:string,name:string,nameNormalized:string,nameCore:string,category:string,categories:array<string>,websites:array<string>,hostnames:array<string>,address:string,sourceHeadings:array<string>>"
    whole = spark.read.schema(f"fetchedAt string, banks array<{bank}>").option("multiLine", True).json(path)
    if whole.where("banks is null").limit(1).collect():
        raise ValueError(f"{path} is not a bank snapshot")
    each = whole.select(F.to_date(F.substring("fetchedAt", 1, 10)).alias("dataset_as_of"), F.posexplode("banks").alias("i", "b"))
    normalized = F.coalesce("b.nameNormalized", normalize_name_folded(F.col("b.name")))
    return each.select(
        (F.col("i") + 1).alias("source_row_number"), "dataset_as_of", F.col("b.id").alias("slug"), F.col("b.name").alias("name"), normalized.alias("name_normalized"),
        F.coalesce("b.nameCore", name_core(normalized)).alias("name_core"), F.col("b.category").alias("category"), F.col("b.categories").alias("categories"), F.col("b.websites").alias("websites"),
        F.filter(F.transform(F.coalesce("b.hostnames", F.array().cast("array<string>")), normalize_hostname), lambda h: h.isNotNull()).alias("hostnames"), F.col("b.address").alias("address"), F.col("b.sourceHeadings").alias("source_headings"),
    )


def write_metrics(df: DataFrame, path: str) -> None:
    """Metrics as JSON lines."""
    df.write.mode("overwrite").json(path)


def export_forest(model, features: list[str]) -> dict:
    """A fitted MLlib forest as plain trees {feature, threshold, left, right} or {value}, for :func:`model.forest_score`.

    A leaf's value is its share of class 1; boosted trees carry their prediction and weight instead.
    """

    def node(n) -> dict:
        if n.getClass().getSimpleName() == "LeafNode":
            stats = list(n.impurityStats().stats()) if n.impurityStats() is not None else []
            return {"value": stats[1] / sum(stats) if len(stats) == 2 and sum(stats) else n.prediction()}
        return {"feature": features[n.split().featureIndex()], "threshold": n.split().threshold(), "left": node(n.leftChild()), "right": node(n.rightChild())}

    trees = [node(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t.rootNode()) for t in model.trees]
    return {"features": features, "trees": trees, "weights": list(model.treeWeights)}


def publish_model(registry: DataFrame, name: str, version: str, body: dict) -> DataFrame:
    """The registry (name, version, active, body) with this version active and every other of the name stood down.

    Publishing a version again replaces its row.
    """
    spark = registry.sparkSession
    others = registry.where(~((F.col("name") == name) & (F.col("version") == version)))
    stood_down = others.withColumn("active", F.when(F.col("name") == name, False).otherwise(F.col("active")))
    return stood_down.unionByName(spark.createDataFrame([(name, version, True, json.dumps(body, sort_keys=True))], "name string, version string, active boolean, body string"))
