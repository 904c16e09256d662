"""URL filtering by rules and by link-graph propagation, with DataFrame operations only.

Hosts are the nodes. Edges are the links of the pages (relative links stay on their host) and the membership of a host in its
parent domain, both ways. Trust is personalised PageRank from hosts with allowed pages along the edges; distrust is the same
from hosts with blocked pages along the reversed edges. A host is blocked where distrust holds more than `limit` of both.

Defined results: a null url or one without `://` has an empty host and path, no rule and the verdict allow; null html has no
links; without seeds of a kind its score is 0 everywhere; repeated pages are judged alike; hosts with as much trust as distrust are
allowed; an empty table gives no rows; only page_id, url and html are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, materialise

#: (verdict, host and path). A rule fits its host and all subdomains if the path starts with the rule's path; the longest wins.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING, ITERATIONS, LIMIT = 0.85, 20, 0.5
#: Iterations between two written tables.
CUT_EVERY = 5


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        h, slash, p = r.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(slash + p)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def split_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return p.withColumns({"rule": rule, "rule_verdict": verdict})


def link_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight: links between hosts, counted; the pages' host and html."""
    own = F.col("host")
    # Only links that may leave the host are taken apart; the others are one number per page.
    links = F.regexp_extract_all(F.col("html"), F.lit(r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]*)"), F.lit(1))
    away = F.filter(F.col("links"), lambda u: u.contains("://") | u.startswith("//"))
    p = pages.where(own != "").select("host", links.alias("links"))
    stay = p.groupBy(own.alias("src")).agg(F.sum(F.size("links") - F.size(away)).cast("double").alias("weight")).select("src", F.col("src").alias("dst"), "weight")
    target = ascii_lower(F.regexp_extract(F.col("url"), r"^(?:[^/?#]*:)?//([^/?#]*)", 1))
    out = p.select(own.alias("src"), F.explode(away).alias("url")).withColumn("dst", target).where("dst != ''")
    return stay.where("weight > 0").unionByName(out.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")))


def domain_edges(hosts: DataFrame) -> DataFrame:
    """Edges between every host and its parent domains of two labels or more, both ways, weighing the pages below; host, pages."""
    labels = F.split("host", r"\.")
    chain = F.when(F.size("labels") >= 3, F.transform(F.sequence(F.lit(1), F.size("labels") - 2), lambda i: F.struct(F.concat_ws(".", F.slice("labels", i, F.size("labels"))).alias("src"), F.concat_ws(".", F.slice("labels", i + 1, F.size("labels"))).alias("dst"))))
    up = hosts.withColumn("labels", labels).select("pages", F.explode(chain).alias("e")).groupBy("e.src", "e.dst").agg(F.sum("pages").cast("double").alias("weight"))
    return up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """node, trust, distrust. edges: src, dst, weight. seeds: node, trust, distrust (counts, normalised here).

    A node without outgoing edges keeps its rank (a loop is added), so each kind of rank adds up to 1.
    """
    both = edges.select(F.lit(0).alias("kind"), "src", "dst", "weight").unionByName(edges.select(F.lit(1).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    both = both.groupBy("kind", "src", "dst").agg(F.sum("weight").alias("weight"))
    given = seeds.select(F.lit(0).alias("kind"), "node", F.col("trust").cast("double").alias("t")).unionByName(seeds.select(F.lit(1).alias("kind"), "node", F.col("distrust").cast("double").alias("t")))
    ends = both.select("kind", F.col("src").alias("node"), F.lit(0.0).alias("t")).unionByName(both.select("kind", F.col("dst").alias("node"), F.lit(0.0).alias("t")))
    nodes = given.unionByName(ends).groupBy("kind", "node").agg(F.sum("t").alias("t"))
    total = nodes.groupBy("kind").agg(F.sum("t").alias("total"))
    nodes = materialise(nodes.join(total, "kind").select("kind", "node", F.when(F.col("total") > 0, F.col("t") / F.col("total")).otherwise(0.0).alias("t")), "url-nodes")
    degree = both.groupBy("kind", F.col("src").alias("node")).agg(F.sum("weight").alias("degree"))
    loops = nodes.join(degree, ["kind", "node"], "left_anti").select("kind", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("p"))
    steps = both.join(degree.withColumnRenamed("node", "src"), ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("degree")).alias("p"))
    steps = materialise(steps.unionByName(loops), "url-steps")
    rank = nodes.select("kind", "node", F.col("t").alias("r"))
    for i in range(1, iterations + 1):
        flow = steps.join(rank.withColumnRenamed("node", "src"), ["kind", "src"]).groupBy("kind", F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("r")).alias("flow"))
        rank = nodes.join(flow, ["kind", "node"], "left").select("kind", "node", ((1 - damping) * F.col("t") + damping * F.coalesce("flow", F.lit(0.0))).alias("r"))
        if i % CUT_EVERY == 0 or i == iterations:
            rank = materialise(rank, "url-rank")
    return rank.groupBy("node").agg(*[F.sum(F.when(F.col("kind") == k, F.col("r")).otherwise(0.0)).alias(n) for k, n in enumerate(("trust", "distrust"))])


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, limit: float = LIMIT, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every page (page_id, url, html)."""
    split = split_urls(pages, rules)
    hosts = split.where("host != ''").groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("rule_verdict") == "allow").alias("trust"), F.count_if(F.col("rule_verdict") == "block").alias("distrust"))
    hosts = materialise(hosts, "url-hosts")
    edges = link_edges(split).unionByName(domain_edges(hosts.select("host", "pages")))
    scores = propagate(edges, hosts.select(F.col("host").alias("node"), "trust", "distrust"), damping, iterations)
    out = split.drop("html").join(scores.withColumnRenamed("node", "host"), "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    # Unrounded, as ranks shrink with the number of hosts; a share within rounding errors of the limit is allowed.
    bad = distrust > limit * (1 + 1e-9) * (trust + distrust)
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"), F.round(trust, 6).alias("trust"), F.round(distrust, 6).alias("distrust"))


def oracle(iterations: int = ITERATIONS) -> str:
    """DuckDB SQL for judge() with the default rules, the iterations written out one by one."""
    rest = "case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = []
    for v, r in sorted(RULES, key=lambda x: -len(x[1])):
        h, _, p = r.partition("/")
        fits.append((f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '/{p}')", r, v))
    case = lambda k: "case " + " ".join(f"when {f[0]} then '{f[k]}'" for f in fits) + " end"
    ctes = [
        f"u as (select page_id, html, coalesce({rest}, '') as rest from pages)",
        f"s0 as (select page_id, html, {lower.format(chr(34) + 'h' + chr(34))} as host, path from (select page_id, html, regexp_extract(rest, '^[^/?#]*') as h, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u))",
        f"s as (select *, {case(1)} as rule, {case(2)} as rule_verdict from s0)",
        "h as materialized (select host, count(*) as pages, count(*) filter (rule_verdict = 'allow') as trust, count(*) filter (rule_verdict = 'block') as distrust from s where host <> '' group by host)",
        r"l as (select host as src, unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*[\"'']?([^\"''\s>]*)', 1)) as url from s where host <> '')",
        "e0 as (select src, case when contains(url, '://') or starts_with(url, '//') then " + lower.format("regexp_extract(url, '^(?:[^/?#]*:)?//([^/?#]*)', 1)") + " else src end as dst from l)",
        "up as (select array_to_string(list_slice(p, i, len(p)), '.') as src, array_to_string(list_slice(p, i + 1, len(p)), '.') as dst, sum(pages)::double as weight from (select pages, string_split(host, '.') as p, unnest(range(1, len(string_split(host, '.')) - 1)) as i from h) group by 1, 2)",
        "e1 as materialized (select src, dst, sum(weight) as weight from (select src, dst, count(*)::double as weight from e0 where dst <> '' group by 1, 2 union all select src, dst, weight from up union all select dst, src, weight from up) group by 1, 2)",
        "e as materialized (select 0 as kind, src, dst, weight from e1 union all select 1, dst, src, weight from e1)",
        "n0 as (select kind, node, sum(t) as t from (select 0 as kind, host as node, trust::double as t from h union all select 1, host, distrust::double from h union all select kind, src, 0.0 from e union all select kind, dst, 0.0 from e) group by 1, 2)",
        "n as materialized (select kind, node, case when sum(t) over (partition by kind) > 0 then t / sum(t) over (partition by kind) else 0.0 end as t from n0)",
        "g as (select kind, src as node, sum(weight) as degree from e group by 1, 2)",
        "p as materialized (select e.kind, src, dst, weight / degree as p from e join g on e.kind = g.kind and e.src = g.node union all select kind, node, node, 1.0 from n where not exists (select 1 from g where g.kind = n.kind and g.node = n.node))",
        "r0 as materialized (select kind, node, t as r from n)",
    ]
    for i in range(1, iterations + 1):
        ctes.append(f"r{i} as materialized (select n.kind, n.node, {1 - DAMPING!r} * n.t + {DAMPING!r} * coalesce(f.flow, 0.0) as r from n left join (select p.kind, dst as node, sum(p.p * r.r) as flow from p join r{i - 1} r on p.kind = r.kind and p.src = r.node group by 1, 2) f on n.kind = f.kind and n.node = f.node)")
    ctes.append(f"x as (select node, sum(case when kind = 0 then r else 0.0 end) as trust, sum(case when kind = 1 then r else 0.0 end) as distrust from r{iterations} group by node)")
    return "with " + ",\n".join(ctes) + f"\nselect page_id, host, path, rule, coalesce(rule_verdict, case when coalesce(distrust, 0.0) > {LIMIT * (1 + 1e-9)!r} * (coalesce(trust, 0.0) + coalesce(distrust, 0.0)) then 'block' else 'allow' end) as verdict, round(coalesce(trust, 0.0), 6) as trust, round(coalesce(distrust, 0.0), 6) as distrust from s left join x on s.host = x.node"
