"""History queries over rows derived from events, at a fixed moment, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history as H
from ..sources.tables import table

def now():
    return F.lit("2024-01-15 00:00:00").cast("timestamp")



def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    runs = e.select(F.concat(F.lit("f"), "user_id", F.lit(".docx")).alias("filename"), F.lower("event_type").alias("style"), F.get_json_object("props", "$.k").cast("int").alias("total_refs"), (F.get_json_object("props", "$.k").cast("int") / 2).cast("int").alias("cited_refs"), F.col("value").alias("avg_conf"), F.lit(None).cast("string").alias("result_path"), F.lit("out").alias("output_name"), "ts", "event_id")
    return H.saved(runs, F.col("ts"), key=F.col("event_id").cast("string"))


def _shared(history: DataFrame) -> DataFrame:
    return H.shared_tokens(history.where(F.col("id").cast("long") % 3 == 0), F.col("created_at"), hours=48, token=F.concat(F.lit("t"), "id"))


def history_recent(spark, sf_dir):
    """K-1, IO-20, D-2, SF-14."""
    return H.recent(_history(spark, sf_dir)).select("id", "filename", "style", "total_refs", "cited_refs", F.round("avg_conf", 6).alias("avg_conf"))


def history_live(spark, sf_dir):
    """D-9, U-6."""
    return H.cleaned(_history(spark, sf_dir), now()).groupBy("style").agg(F.count("*").alias("n"), F.sum("total_refs").alias("refs"))


def history_deleted(spark, sf_dir):
    """D-3, D-4: what is left of both tables when one user's rows go."""
    h = _history(spark, sf_dir)
    left, tokens = H.deleted(h, _shared(h), h.where("filename = 'f8.docx'").select("id"))
    return left.agg(F.count("*").alias("n")).select(F.lit("history").alias("kept"), "n").unionAll(tokens.agg(F.count("*").alias("n")).select(F.lit("tokens").alias("kept"), "n"))


def share_resolved(spark, sf_dir):
    """J-1, D-5."""
    h = _history(spark, sf_dir)
    return H.resolved(_shared(h), h, now()).select("token", "id", "filename", "downloads")


def share_downloads(spark, sf_dir):
    """D-6."""
    h = _history(spark, sf_dir)
    s = _shared(h)
    return H.counted(s, s.where(F.col("history_id").cast("long") % 2 == 0).select("token")).select("token", "downloads")


def preferences_changed(spark, sf_dir):
    """D-7, D-8, SF-29."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"))
    p = H.ensured(H.create(spark)["preferences"], e, now())
    changes = p.where(F.col("session_id").cast("long") % 4 == 0).select("session_id", F.create_map(F.lit("theme"), F.lit("light"), F.lit("colour"), F.lit("red")).alias("settings"))
    return H.updated(p, changes, now()).select("session_id", "theme", "default_style")


ROWS = """h as (select event_id::varchar as id, 'f' || user_id || '.docx' as filename, lower(event_type) as style, (props->>'$.k')::int as total_refs, ((props->>'$.k')::int // 2)::int as cited_refs,
 round(value, 1) as avg_conf, ts as created_at, ts + interval 24 hour as expires_at from events),
 s as (select 't' || id as token, id as history_id, created_at + interval 48 hour as expires_at from h where id::bigint % 3 = 0)"""
NOW_SQL = "timestamp '2024-01-15'"
QUERIES = {f.__name__: f for f in (history_recent, history_live, history_deleted, share_resolved, share_downloads, preferences_changed)}
ORACLE_SQL = {
    "history_recent": f"with {ROWS} select id, filename, style, total_refs, cited_refs, round(avg_conf, 6) as avg_conf from h order by created_at desc, id limit 50",
    "history_live": f"with {ROWS} select style, count(*) as n, sum(total_refs)::bigint as refs from h where expires_at >= {NOW_SQL} group by 1",
    "history_deleted": f"with {ROWS}, gone as (select id from h where filename = 'f8.docx') select 'history' as kept, count(*) as n from h where id not in (select id from gone) union all select 'tokens', count(*) from s where history_id not in (select id from gone)",
    "share_resolved": f"with {ROWS} select token, id, filename, 0::int as downloads from s join h on s.history_id = h.id where s.expires_at > {NOW_SQL}",
    "share_downloads": f"with {ROWS} select token, (case when history_id::bigint % 2 = 0 then 1 else 0 end)::int as downloads from s",
    "preferences_changed": "select distinct user_id::varchar as session_id, case when user_id % 4 = 0 then 'light' else 'dark' end as theme, 'apa' as default_style from events",
}
