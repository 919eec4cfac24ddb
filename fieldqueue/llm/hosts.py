"""URL filters: rules by host and path, and the reputation of hosts from labelled pages where no rule speaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldqueue.llm.shared import kept

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules of the query: verdict, host, path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
# fixed values: public suffixes of two labels; all others are the last label
SUFFIXES = ("ac.jp", "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "edu.au", "go.jp", "gov.au", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
#: Share of good pages that a host must reach by its posterior's lower bound, and the bound's distance from the mean in standard deviations.
LEAST, BELOW = 0.75, 1.645
#: Weight of a prior, counted in pages, if groups differ beyond measure, and if they don't differ measurably.
FEWEST, MOST = 1.0, 1000.0
#: Hosts whose rows are broadcast at most; more are joined.
HOSTS = 1 << 16


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first `://` up to `/`, `?`, `#` or the end with A-Z lower-cased, and from there up to `?`, `#` or the end. Null or no `://`: both empty."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def owners(hosts: DataFrame) -> DataFrame:
    """Adds the registered domain and the suffix of each host: a suffix of two labels if it is one of SUFFIXES, else the last label; the domain has one label more.

    User names, ports and dots at the end don't count. An address of numbers, in brackets or of one label is its own domain and suffix.
    """
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace("host", r"(?s)^.*@", ""), r":[0-9]*\z", ""), r"\.+\z", "")
    label = F.split("_name", r"\.")
    alone = (F.size(label) < 2) | F.col("_name").rlike(r"^[0-9.]+\z|^\[")
    last = lambda k: F.when(alone, F.col("_name")).otherwise(F.concat_ws(".", F.slice(label, -F.least(F.lit(k), F.size(label)), k)))
    double = last(2).isin(*SUFFIXES)
    return hosts.withColumn("_name", name).withColumn("suffix", F.when(double, last(2)).otherwise(last(1))).withColumn("domain", F.when(double, last(3)).otherwise(last(2))).drop("_name")


def weight(groups: DataFrame, parent: str | None) -> float:
    """The prior's weight in pages, from how far groups (n, good, parent) differ within their parents: 1 / rho - 1 of the intraclass correlation rho, by moments."""
    key = [parent] if parent else []
    of = groups.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), F.sum(F.col("good").cast("double") * F.col("good") / F.col("n")).alias("gg"), F.count("*").alias("k"))
    good = F.col("good").cast("double")
    between, inside, even = F.col("gg") - good * good / F.col("n"), good - F.col("gg"), F.col("n") - F.col("nn") / F.col("n")
    r = of.agg(F.sum(between).alias("b"), F.sum(inside).alias("w"), F.sum(even).alias("e"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("p")).first()
    if r["n"] is None or r["k"] <= r["p"] or r["n"] <= r["k"]:
        return MOST
    b, w, size = r["b"] / (r["k"] - r["p"]), r["w"] / (r["n"] - r["k"]), r["e"] / (r["k"] - r["p"])
    if b <= w:
        return MOST
    return min(MOST, max(FEWEST, (b + (size - 1) * w) / (b - w) - 1))


def reputation(hosts: DataFrame) -> DataFrame:
    """Of one row a host (host, n, good: labelled pages, and good ones among them) the posterior: host, n_outcomes, reputation, bound.

    Beta-binomial shrinkage from the whole to suffixes, from a suffix to its registered domains, from a domain to its
    hosts: each group's share is drawn towards its parent's by the parent's weight, which the spread of groups about
    their parents sets (empirical Bayes). `bound` lies BELOW standard deviations under the posterior mean. A host
    without labelled pages has its domain's share; without any labelled page in the table all have one half.
    """
    g = kept(owners(hosts))
    levels = {"host": g}
    for parent, below, more in (("domain", "host", ["suffix"]), ("suffix", "domain", [])):
        levels[parent] = levels[below].groupBy(parent, *more).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    seen = {k: v.where("n > 0") for k, v in levels.items()}
    whole = g.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    mean = (whole["good"] + 1) / (whole["n"] + 2) if whole["n"] else 0.5
    strength = {"suffix": weight(seen["suffix"], None), "domain": weight(seen["domain"], "suffix"), "host": weight(seen["host"], "domain")}
    posterior = lambda level, above: (F.col("good") + strength[level] * above) / (F.col("n") + strength[level])
    top = levels["suffix"].select("suffix", posterior("suffix", F.lit(mean)).alias("_suffix"))
    mid = levels["domain"].join(top, "suffix").select("domain", "suffix", posterior("domain", F.col("_suffix")).alias("_domain"))
    found = g.join(mid, ["domain", "suffix"]).withColumn("m", posterior("host", F.col("_domain")))
    spread = F.sqrt(F.col("m") * (1 - F.col("m")) / (F.col("n") + strength["host"] + 1))
    return found.select("host", F.col("n").alias("n_outcomes"), F.round("m", 6).alias("reputation"), F.round(F.col("m") - BELOW * spread, 6).alias("bound"))


def fitting(host: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The rules (verdict, rule, path) of a host, the longest first; equal ones in the order given."""
    order = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    each = [F.when((host == F.lit(h)) | F.endswith(host, F.lit("." + h)), F.struct(F.lit(v).alias("verdict"), F.lit(h + p).alias("rule"), F.lit(p).alias("path"))) for v, h, p in order]
    return F.array_compact(F.array(*each)) if each else F.array().cast("array<struct<verdict:string,rule:string,path:string>>")


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, least: float = LEAST) -> DataFrame:
    """page_id, host, path, rule, verdict, n_outcomes, reputation, bound of every page (page_id, url).

    `outcomes` has labelled pages (url, n, good): n of them, `good` good ones. A rule fits its host and all subdomains if the
    page's path starts with the rule's; the longest decides. Where none fits, the page goes if its host's posterior
    bound (see reputation) lies below `least`. Rules and reputations are found once a host; a page only
    picks the first of its host's rules that its path starts with.

    Null urls and urls without `://` have the empty host, which no rule fits and whose reputation is a host's like any
    other. Rows are kept as they are, repeated ones too. Null labels don't count. Empty table: no rows. Other columns are
    ignored.
    """
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    labelled = outcomes.where("n is not null and good is not null").select(parts(F.col("url"))[0].alias("host"), F.col("n").cast("long").alias("n"), F.col("good").cast("long").alias("good"))
    none = F.lit(0).cast("long")
    hosts = rows.select("host", none.alias("n"), none.alias("good")).unionByName(labelled).groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    known = kept(reputation(hosts).withColumn("_rules", fitting(F.col("host"), rules)))
    if known.count() <= HOSTS:
        known = F.broadcast(known)
    out = rows.join(known, "host").withColumn("_rule", F.try_element_at(F.filter("_rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(1)))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("bound") < least, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "n_outcomes", "reputation", "bound")


#: The number in a page's url is the id of the document that it shows.
NUMBER = r"^/[^/]*/([0-9]{1,18})([^0-9]|\z)"


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled pages (url, n, good): a page's outcome is the quality label of the document that its url names. Equal urls are counted before the join; of a document's labels the least counts."""
    number = F.regexp_extract(parts(F.col("url"))[1], NUMBER, 1)
    urls = pages.where("url is not null").groupBy("url").agg(F.count("*").alias("n")).withColumn("_number", F.when(number != "", number.cast("long")))
    quality = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_number")).agg(F.min("quality").cast("long").alias("quality"))
    return urls.join(quality, "_number").select("url", "n", (F.col("n") * F.col("quality")).alias("good"))


def op13_host_reputation(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Every page judged by RULES, else by its host's reputation."""
    return judge(pages, page_outcomes(pages, labels))


def oracle() -> str:
    two = ", ".join(f"'{s}'" for s in SUFFIXES)
    order = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(p.host = '{h}' or ends_with(p.host, '.{h}')) and starts_with(path, '{p}')"
    rule = " ".join(f"when {fits(h, p)} then '{h}{p}'" for _, h, p in order)
    verdict = " ".join(f"when {fits(h, p)} then '{v}'" for v, h, p in order)

    def strength(groups: str, parent: str) -> str:
        of = f"select sum(n)::DOUBLE n, sum(good)::DOUBLE good, sum(n::DOUBLE * n) nn, sum(good::DOUBLE * good / n) gg, count(*) k from {groups} where n > 0 group by {parent}"
        return f"""(select case when coalesce(sum(k), 0) <= count(*) or sum(n) <= sum(k) then {MOST}::DOUBLE
             when sum(gg - good * good / n) / (sum(k) - count(*)) <= sum(good - gg) / (sum(n) - sum(k)) then {MOST}::DOUBLE
             else least({MOST}::DOUBLE, greatest({FEWEST}::DOUBLE, (sum(gg - good * good / n) / (sum(k) - count(*)) + (sum(n - nn / n) / (sum(k) - count(*)) - 1) * (sum(good - gg) / (sum(n) - sum(k))))
                  / (sum(gg - good * good / n) / (sum(k) - count(*)) - sum(good - gg) / (sum(n) - sum(k))) - 1)) end from ({of}))"""

    return rf"""
with u as (select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
p as (select page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from u),
q as (select doc_id, min(quality) quality from labels where quality is not null group by 1),
o as (select host, count(*) n, sum(quality)::BIGINT good from p join q on try_cast(nullif(regexp_extract(path, '^/[^/]*/([0-9]{{1,18}})([^0-9]|\z)', 1), '') as BIGINT) = q.doc_id group by 1),
h as (select a.host, coalesce(n, 0) n, coalesce(good, 0) good from (select distinct host from p) a left join o on a.host = o.host),
k as (select *, regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*\z', ''), '\.+\z', '') nm from h),
l as (select *, string_split(nm, '.') lab from k),
w as (select *, case when array_to_string(lab[-2:], '.') in ({two}) then 2 else 1 end s, len(lab) < 2 or regexp_matches(nm, '^[0-9.]+\z|^\[') alone from l),
g as (select host, n, good, case when alone then nm when s = 2 then array_to_string(lab[-2:], '.') else lab[-1] end suffix,
             case when alone then nm when s = 2 then array_to_string(lab[-3:], '.') else array_to_string(lab[-2:], '.') end dom from w),
d as (select dom, suffix, sum(n)::BIGINT n, sum(good)::BIGINT good from g group by 1, 2),
s as (select suffix, sum(n)::BIGINT n, sum(good)::BIGINT good from d group by 1),
c as (select (select case when sum(n) > 0 then (sum(good) + 1)::DOUBLE / (sum(n) + 2) else 0.5::DOUBLE end from g) mean,
             {strength("s", "1 = 1")} ks, {strength("d", "suffix")} kd, {strength("g", "dom")} kh),
sp as (select suffix, (good + ks * mean) / (n + ks) m from s, c),
dp as (select d.dom, d.suffix, (d.good + kd * sp.m) / (d.n + kd) m from d join sp on d.suffix = sp.suffix, c),
hp as (select g.host, g.n, kh, (g.good + kh * dp.m) / (g.n + kh) m from g join dp on g.dom = dp.dom and g.suffix = dp.suffix, c),
r as (select host, n n_outcomes, round(m, 6) reputation, round(m - {BELOW}::DOUBLE * sqrt(m * (1 - m) / (n + kh + 1)), 6) bound from hp)
select page_id, p.host, path, case {rule} end "rule", case {verdict} when bound < {LEAST} then 'block' else 'allow' end verdict, n_outcomes, reputation, bound
from p join r on p.host = r.host"""


ORACLE = oracle()
