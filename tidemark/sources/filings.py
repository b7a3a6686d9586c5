"""Company documents in JSON, one an entity: reported facts and submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Units in order of preference (fixed values): a tag's first one counts.
UNITS = ["USD", "USD/shares", "shares", "pure"]

FACT = "struct<start: string, end: string, val: double, fy: int, fp: string, form: string, filed: string>"
FACTS = f"cik bigint, entityName string, facts struct<`us-gaap`: map<string, struct<units: map<string, array<{FACT}>>>>>"
SUBMISSIONS = "cik string, name string, sic string, sicDescription string, tickers array<string>"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """A row `value` for each JSON file under path."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)


def facts(df: DataFrame, tags: dict[str, list[str]] | None = None, json: str = "value") -> DataFrame:
    """Rows cik, name, tag, unit, start, end, value, filed, form of every fact with a value and a filing date.

    Of a tag's units the first of UNITS is taken. tags (metric: its tags) keeps these tags and adds `metric`; every tag
    of a metric contributes. Documents that aren't JSON, or hold no facts, give no rows.
    """
    read = df.select(F.from_json(json, FACTS).alias("d")).select("d.cik", F.col("d.entityName").alias("name"), F.explode(F.col("d.facts.`us-gaap`")).alias("tag", "of"))
    unit = F.coalesce(*[F.when(F.map_contains_key("of.units", u), F.lit(u)) for u in UNITS])
    read = read.withColumn("unit", unit).where("unit is not null")
    if tags is not None:
        pairs = [(t, m) for m, ts in tags.items() for t in ts]
        metric = F.create_map(*[F.lit(x) for p in pairs for x in p])
        read = read.withColumn("metric", metric[F.col("tag")]).where("metric is not null")
    rows = read.select("cik", "name", "tag", *(["metric"] if tags is not None else []), "unit", F.explode(F.col("of.units")[F.col("unit")]).alias("f"))
    day = {c: F.col(f"f.{c}").try_cast("date") for c in ("start", "end", "filed")}
    return rows.select(*[c for c in rows.columns if c != "f"], day["start"].alias("start"), day["end"].alias("end"), F.col("f.val").alias("value"), day["filed"].alias("filed"), F.col("f.form").alias("form")).where("value is not null and filed is not null")


def submissions(df: DataFrame, json: str = "value") -> DataFrame:
    """Rows cik (number), name, sic, industry and ticker, the first listed or null."""
    d = df.select(F.from_json(json, SUBMISSIONS).alias("d")).select("d.*").where("cik is not null")
    return d.select(F.col("cik").try_cast("bigint").alias("cik"), "name", F.col("sic").try_cast("int").alias("sic"), F.col("sicDescription").alias("industry"), F.try_element_at("tickers", F.lit(1)).alias("ticker"))
