"""Message files, the route map and the role registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ROUTE


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """(source_uri, raw_sha256, json): json is null for bytes that are not UTF-8 or JSON, and for
    repeated keys."""
    return parse_envelopes(spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(path))


def parse_envelopes(files: DataFrame) -> DataFrame:
    text = F.try_validate_utf8(F.col("content").cast("string"))
    good = F.try_parse_json(text).isNotNull()
    return files.select(F.col("path").alias("source_uri"), F.sha2("content", 256).alias("raw_sha256"), F.when(good, text).alias("json"))


def read_routes(spark: SparkSession, path: str, key_prefix: str, lane_prefix: str, domains: int = 9) -> DataFrame:
    """The route map (domain, cloud_conversation_key, local_lane) of a JSON file. Raises unless it has
    exactly the domains 00 to `domains` - 1, each once, with key and lane made from the prefixes."""
    doc = spark.read.schema(f"channels array<struct<{', '.join(f'{x.split()[0]}: string' for x in ROUTE.split(', '))}>>").json(path, multiLine=True)
    routes = doc.select(F.explode("channels").alias("c")).select("c.*")
    rows = routes.limit(domains + 1).collect()  # nine rows
    want = {f"{i:02d}": (f"{key_prefix}{i:02d}", f"{lane_prefix}{i:02d}") for i in range(domains)}
    if len(rows) != domains or {r[0]: (r[1], r[2]) for r in rows} != want:
        raise ValueError("the route map does not hold each domain once with its own key and lane")
    return routes


def read_roles(spark: SparkSession, path: str, defaults: list[str]) -> DataFrame:
    """First back-ticked cells of a Markdown file's table rows, with the default roles."""
    cells = spark.read.text(path).select(F.regexp_extract("value", r"^\|\s*`([^`]+)`\s*\|", 1).alias("role")).filter("role <> ''")
    return cells.unionByName(spark.createDataFrame([(r,) for r in defaults], "role string")).distinct()
