"""Runs, share tokens and preferences as immutable tables: every change gives a new DataFrame.

Expiry compares timestamps; "now" is a parameter, so that results do not depend on the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY = "id string, filename string, style string, total_refs int, cited_refs int, avg_conf double, result_path string, output_name string, created_at timestamp, expires_at timestamp"
SHARED = "token string, history_id string, created_at timestamp, expires_at timestamp, downloads int"
PREFERENCES = "session_id string, theme string, default_style string, updated_at timestamp"
DEFAULTS = {"theme": "dark", "default_style": "apa"}


def create(spark: SparkSession) -> dict[str, DataFrame]:
    """The three tables, empty."""
    return {n: spark.createDataFrame([], s) for n, s in (("history", HISTORY), ("shared_results", SHARED), ("preferences", PREFERENCES))}


def expiry(created: Column, hours: int = 24) -> Column:
    return created + F.make_interval(hours=F.lit(hours))


def saved(runs: DataFrame, now: Column, hours: int = 24, key: Column | None = None) -> DataFrame:
    """History rows for finished runs; ids are random unless given."""
    return runs.select((F.uuid() if key is None else key).alias("id"), "filename", "style", "total_refs", "cited_refs", F.round("avg_conf", 1).alias("avg_conf"), "result_path", "output_name", now.alias("created_at"), expiry(now, hours).alias("expires_at"))


def recent(history: DataFrame, limit: int = 50) -> DataFrame:
    return history.orderBy(F.desc("created_at"), "id").limit(limit)


def deleted(history: DataFrame, shared: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the rows of the ids (column id), nor the tokens of these rows."""
    return history.join(ids, "id", "left_anti"), shared.join(ids, shared["history_id"] == ids["id"], "left_anti")


def shared_tokens(history: DataFrame, now: Column, hours: int = 24, token: Column | None = None) -> DataFrame:
    made = F.substring(F.md5(F.uuid()), 1, 11) if token is None else token
    return history.select(made.alias("token"), F.col("id").alias("history_id"), now.alias("created_at"), expiry(now, hours).alias("expires_at"), F.lit(0).alias("downloads"))


def resolved(shared: DataFrame, history: DataFrame, now: Column) -> DataFrame:
    """History rows that unexpired tokens lead to."""
    live = shared.where(F.col("expires_at") > now).select("token", "history_id", F.col("expires_at").alias("token_expires"), "downloads")
    return live.join(history, live["history_id"] == history["id"]).drop("history_id")


def counted(shared: DataFrame, read: DataFrame) -> DataFrame:
    """Downloads raised by the reads (column token)."""
    n = read.groupBy("token").agg(F.count("*").cast("int").alias("n"))
    return shared.join(n, "token", "left").withColumn("downloads", F.col("downloads") + F.coalesce("n", F.lit(0))).drop("n").select(shared.columns)


def ensured(preferences: DataFrame, sessions: DataFrame, now: Column) -> DataFrame:
    """Preferences with a default row for every session (column session_id) that has none."""
    new = sessions.select("session_id").distinct().join(preferences, "session_id", "left_anti")
    return preferences.unionByName(new.select("session_id", *[F.lit(v).alias(k) for k, v in DEFAULTS.items()], now.alias("updated_at")))


def updated(preferences: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Rows with changes (session_id, map of settings); only known settings count, unknown sessions are passed over."""
    known = changes.select("session_id", F.map_filter("settings", lambda k, _: k.isin(*DEFAULTS)).alias("settings"))
    out = preferences.join(known, "session_id", "left")
    change = F.size(F.coalesce("settings", F.create_map().cast("map<string,string>"))) > 0
    return out.select("session_id", *[F.coalesce(F.col("settings")[k], F.col(k)).alias(k) for k in DEFAULTS], F.when(change, now).otherwise(F.col("updated_at")).alias("updated_at"))


def cleaned(table: DataFrame, now: Column) -> DataFrame:
    """Without what has expired."""
    return table.where(F.col("expires_at").isNull() | (F.col("expires_at") >= now))
