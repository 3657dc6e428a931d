"""Evidence: recorded answers of outside services as tables, keyed deterministically.

A namespace (registry, search, page, verdict) is a table of key, fetched_at
and payload. Nothing here calls a network: a miss is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.functions import text as tx

SCHEMA = "key string, fetched_at date, payload string"


class Evidence:
    """Namespaces by name; ``lookup`` is a left join on the key."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = tables

    @classmethod
    def read(cls, spark: SparkSession, root: str, namespaces: list[str]) -> Evidence:
        return cls({n: spark.read.schema(SCHEMA).json(f"{root}/{n}") for n in namespaces})

    def lookup(self, rows: DataFrame, namespace: str, key: Column, schema: str) -> DataFrame:
        """``rows`` with a struct column named like the namespace, null on a miss; the first answer of a key counts."""
        e = self.tables[namespace].groupBy(F.col("key").alias("_key")).agg(F.min(F.struct("fetched_at", "payload"))["payload"].alias("_payload"))
        out = rows.withColumn("_at", key).join(e, F.col("_at") == F.col("_key"), "left")
        return out.withColumn(namespace, F.from_json("_payload", schema)).drop("_at", "_key", "_payload")


def new_answers(store: DataFrame, fetched: DataFrame) -> DataFrame:
    """Answers whose key the store hasn't: evidence is written once and never changed."""
    return fetched.join(store.select("key"), "key", "left_anti").dropDuplicates(["key"])


def registry_key(name: Column, country: Column) -> Column:
    return F.concat_ws("|", tx.fold_key(name), F.upper(F.trim(F.coalesce(country, F.lit("")))))


def search_key(query: Column, country: Column) -> Column:
    quoted = F.when(F.contains(query, F.lit('"')), "q").otherwise("")
    return F.concat_ws("|", tx.fold_key(query), quoted, F.upper(F.coalesce(country, F.lit(""))))


def http_key(url: Column, params: Column) -> Column:
    """URL and a map of parameters in order of their names."""
    pairs = F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat(url, F.lit("?"), F.array_join(pairs, "&"))


def request_key(*parts: Column) -> Column:
    """Hash of a model request's parts, which are joined by a unit separator."""
    return F.sha2(F.concat_ws("␟", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def reversed_lists(df: DataFrame, columns: list[str]) -> DataFrame:
    """Every list the other way round: results must not depend on the order of evidence."""
    return df.withColumns({c: F.reverse(c) for c in columns})


def claims(payload: Column) -> Column:
    """Claims of a knowledge-base entity as property to list of values, whatever their type."""
    schema = "struct<claims:map<string,array<struct<mainsnak:struct<datavalue:struct<value:string>>>>>>"
    parsed = F.from_json(payload, schema)["claims"]
    return F.transform_values(parsed, lambda k, v: F.transform(v, lambda x: x["mainsnak"]["datavalue"]["value"]))


def claim_date(value: Column) -> Column:
    """Date of a time claim at its precision: 9 year, 10 month, 11 day."""
    t = F.from_json(value, "time string, precision int")
    length = F.when(t["precision"] >= 11, 10).when(t["precision"] == 10, 7).when(t["precision"] == 9, 4)
    return F.substring(F.regexp_replace(t["time"], r"^\+", ""), F.lit(1), length)
