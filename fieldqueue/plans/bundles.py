"""Queries of gated assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldqueue.operators import assembly
from fieldqueue.plans.similarity import rows
from fieldqueue.plans.views import POOL, pool


def parts(s, d):
    """The pool, base vectors of most of its records and two deltas, which rename each other's records; the records between the newest ones lack one."""
    p = pool(s, d).select("id", "grp", "created_at")
    n = rows(s, d).count()
    v = rows(s, d).select(F.col("id").alias("k"), "v")
    all_ = p.withColumn("k", F.col("id") % n).join(v, "k").select("grp", "id", "v")
    base = all_.where("id % 3 <> 0")
    first, second = (all_.where(c).select(F.lit(name).alias("name"), "id", F.transform("v", lambda x: -x).alias("v")) for name, c in (("delta-1", "id % 6 = 0"), ("delta-2", "id % 4 = 0")))
    return p, base, first.unionByName(second)


def assembled(s, d):
    p, base, deltas = parts(s, d)
    b = assembly.assemble(p, base, deltas, most_uncovered=0.2, grace_hours=24 * 365)
    return b.vectors.select("grp", "id", "origin")


def uncovered(s, d):
    p, base, deltas = parts(s, d)
    b = assembly.assemble(p, base, deltas, most_uncovered=0.2, grace_hours=24 * 365, open_pool=p.where("id % 2 = 1"))
    return b.groups


QUERIES = {"assemble": assembled, "assemble_groups": uncovered}
COVERED = f"{POOL}, x as (select grp, id, created_at, case when id % 4 = 0 then 'delta-2' when id % 6 = 0 then 'delta-1' when id % 3 <> 0 then 'base' end origin from pool)"
ORACLE = {
    "assemble": f"with {COVERED} select grp, id, origin from x where origin is not null",
    "assemble_groups": f"""with {COVERED}, e as (select max(created_at) m, max(created_at) filter (id % 2 = 1) h from pool)
        select grp, count(*) n, count(*) filter (origin is null) uncovered, count(*) filter (origin is null and created_at < m - interval 365 day and (id % 2 = 1 or created_at > h)) late from x, e group by 1""",
}
