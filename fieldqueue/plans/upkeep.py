"""Queries of incremental maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldqueue.operators import state
from fieldqueue.plans.views import IDENTS, POOL, idents, pool
from fieldqueue.sources.tables import table

CUT = "timestamp'1997-06-01'"


def old(s, d):
    return pool(s, d).where("id % 4 <> 0")


def new(s, d):
    return pool(s, d).where("id % 3 = 0").withColumn("status", F.lit("N")).withColumn("extra", F.col("id") * 2)


def gone(s, d):
    return pool(s, d).where("id % 10 = 1")


def now():
    return F.lit("1998-01-01").cast("timestamp")


def log(s, d):
    i = idents(s, d).where("id % 4 = 1")
    return i.select("id", F.col("created_at").alias("left"), F.col("seq").alias("reason"))


def interval_runs(s, d):
    runs = table(s, d, "orders").where("o_orderkey % 500 = 0").select(F.col("o_orderdate").alias("run")).distinct()
    events = idents(s, d).select("id", "seq", F.col("created_at").alias("ts"))
    return state.interval_runs(events, runs).select("id", "seq", "run", "previous")


def projects(s, d):
    """(members still in the pool, or newly listed) less those removed, by project."""
    i = idents(s, d)
    member = i.where("seq <= 2").select(F.col("answer").alias("project"), "id").distinct()
    fresh = i.where("seq = 3").select(F.col("answer").alias("project"), "id").distinct()
    kept = member.join(old(s, d).select("id"), "id", "left_semi").select("project", "id")
    out = kept.union(fresh).distinct().join(gone(s, d).select("id"), "id", "left_anti")
    return out.groupBy("project").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


QUERIES = {
    "upsert": lambda s, d: state.upsert(old(s, d), new(s, d)).select("id", "status", "extra"),
    "apply_changes": lambda s, d: state.apply_changes(old(s, d), new(s, d), gone(s, d)).select("id", "status", "extra"),
    "delete_closed": lambda s, d: state.drop_closed(pool(s, d), pool(s, d).where("id % 2 = 0"), pool(s, d).where("status = 'O'")).select("id", "status"),
    "reconcile": lambda s, d: state.reconcile(old(s, d), new(s, d)),
    "watermark_max": lambda s, d: pool(s, d).agg(F.max("created_at").alias("last"), F.count("*").alias("n")),
    "win_dedup_last": lambda s, d: state.last_wins(idents(s, d), ["id", "answer"], [F.col("created_at"), F.col("seq")]).select("id", "answer", "seq"),
    "src_pull": lambda s, d: state.first_wins(idents(s, d), ["id"], [F.col("created_at"), F.col("seq")]).select("id", "seq", "created_at"),
    "join_anti": lambda s, d: state.leavers(pool(s, d), new(s, d), now(), F.when(F.col("status") == "F", 1).otherwise(2)).select("id", "left", "reason"),
    "ttl_log": lambda s, d: state.tidy_log(log(s, d), pool(s, d).where("id % 3 = 0"), now(), 600).select("id", "left", "reason"),
    "join_outer_diff": lambda s, d: state.differences(old(s, d).select("id", "status"), pool(s, d).where("id % 5 <> 0").select("id", "status")),
    "src_coverage": lambda s, d: state.coverage(pool(s, d), "grp", 50),
    "join_interval_runs": interval_runs,
    "src_by_ids": lambda s, d: pool(s, d).join(new(s, d).select("id"), "id", "left_semi").select("id", "grp"),
    "src_still_open": lambda s, d: pool(s, d).join(old(s, d).select("id"), "id", "left_semi").where("status = 'O' and score is not null").select("id"),
    "projects_update": projects,
}

NEWER = "n as (select id, 'N' status, id * 2 extra from pool where id % 3 = 0), old as (select * from pool where id % 4 <> 0)"
ORACLE = {
    "upsert": f"with {POOL}, {NEWER} select id, status, null::BIGINT extra from old where id not in (select id from n) union all select * from n",
    "apply_changes": f"with {POOL}, {NEWER} select id, status, null::BIGINT extra from old where id % 10 <> 1 and id not in (select id from n) union all select * from n",
    "delete_closed": f"with {POOL} select id, status from pool where not (id % 2 = 0 and status <> 'O')",
    "reconcile": f"with {POOL}, {NEWER} select id, 'gone' side from old where id not in (select id from n) union all select id, 'missing' from n where id not in (select id from old)",
    "watermark_max": "select max(o_orderdate) \"last\", count(*) n from orders",
    "win_dedup_last": f"with {IDENTS} select id, answer, seq from idents qualify row_number() over (partition by id, answer order by created_at desc, seq desc) = 1",
    "src_pull": f"with {IDENTS} select id, seq, created_at from idents qualify row_number() over (partition by id order by created_at, seq) = 1",
    "join_anti": f"with {POOL}, {NEWER} select id, timestamp '1998-01-01' \"left\", case when status = 'F' then 1 else 2 end reason from pool where id not in (select id from n)",
    "ttl_log": f"with {IDENTS} select id, created_at \"left\", seq reason from (select * from idents where id % 4 = 1 qualify row_number() over (partition by id order by created_at desc, seq desc) = 1) where created_at >= timestamp '1998-01-01' - interval 600 days and id not in (select o_orderkey from orders where o_orderkey % 3 = 0)",
    "join_outer_diff": f"with {POOL}, a as (select id, status from pool where id % 4 <> 0), b as (select id, status from pool where id % 5 <> 0) select *, 'expected' side from (select * from a except all select * from b) union all select *, 'rebuilt' from (select * from b except all select * from a)",
    "src_coverage": f"with {POOL} select (select count(*) from pool where grp is not null) parts, count(*) \"whole\", abs((select count(*) from pool where grp is not null) - count(*)) <= 50 covered from pool",
    "join_interval_runs": f"with {IDENTS}, r as (select distinct o_orderdate run from orders where o_orderkey % 500 = 0), s as (select run, lag(run) over (order by run) previous from r) select id, seq, run, previous from idents left join s on created_at <= run and (previous is null or created_at > previous)",
    "src_by_ids": f"with {POOL} select id, grp from pool where id % 3 = 0",
    "src_still_open": f"with {POOL} select id from pool where id % 4 <> 0 and status = 'O' and score is not null",
    "projects_update": f"with {IDENTS}, m as (select distinct answer project, id from idents where seq <= 2 and id in (select o_orderkey from orders where o_orderkey % 4 <> 0)), f as (select distinct answer project, id from idents where seq = 3), u as (select * from m union select * from f) select project, count(*) n, sum(id)::BIGINT ids from u where not (id % 10 = 1 and id in (select o_orderkey from orders)) group by 1",
}
