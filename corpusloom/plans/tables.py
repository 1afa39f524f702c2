"""Queries over keyed tables: co-occurrence, queues, policies, batches, spans and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import audit, graph, records

from .registry import query


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


SHARED_SQL = "select x.l_suppkey as a, y.l_suppkey as b, count(*) as shared from (select distinct l_partkey, l_suppkey from lineitem) x join (select distinct l_partkey, l_suppkey from lineitem) y on x.l_partkey = y.l_partkey and x.l_suppkey <> y.l_suppkey group by 1, 2"


@query(f"select a, b, shared, rank from (select *, row_number() over (partition by a order by shared desc, b) as rank from ({SHARED_SQL})) where rank <= 6")
def entity_related_topk(spark: SparkSession, sf: str) -> DataFrame:
    return graph.related_top(_table(spark, sf, "lineitem"), "l_partkey", "l_suppkey")


@query("select l_partkey, array_to_string(list_sort(list(distinct l_suppkey)), ',') as owners from lineitem group by 1 having count(distinct l_suppkey) > 1")
def entity_map(spark: SparkSession, sf: str) -> DataFrame:
    return graph.entity_map(_table(spark, sf, "lineitem"), "l_partkey", "l_suppkey").select("l_partkey", F.array_join("owners", ",").alias("owners"))


@query("select o_orderkey, o_orderpriority, (row_number() over (partition by o_orderpriority order by o_orderkey) - 1) // 15 as batch from orders")
def batches(spark: SparkSession, sf: str) -> DataFrame:
    return records.batches(_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], "o_orderkey", 15)


@query(
    """with p as (select o_orderkey as k, o_totalprice as bytes, 'done' as status, 2 as attempts from orders where o_orderkey % 3 <> 0), s as (select o_orderkey as k, o_totalprice + 1 as bytes, 'new' as status, 0 as attempts from orders where o_orderkey % 5 <> 0)
 select coalesce(p.k, s.k) as k, case when s.k is not null then s.bytes else p.bytes end as bytes, coalesce(p.status, s.status) as status, coalesce(p.attempts, s.attempts) as attempts from p full join s on p.k = s.k"""
)
def queue_upsert(spark: SparkSession, sf: str) -> DataFrame:
    o = _table(spark, sf, "orders")
    previous = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("bytes"), F.lit("done").alias("status"), F.lit(2).alias("attempts"))
    scanned = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") + 1).alias("bytes"), F.lit("new").alias("status"), F.lit(0).alias("attempts"))
    return records.upsert(previous, scanned, "k", ["status", "attempts"])


DECISIONS_SQL = "select c_name as name, case c_custkey % 4 when 0 then 'on' when 1 then 'off' when 2 then 'name-only' end as selected, c_custkey % 7 <> 0 as approved, c_custkey % 11 <> 0 as controllable from customer"
CURRENT_SQL = "select c_name as name, case when c_custkey % 2 = 0 then 'off' else 'name-only' end as value from customer where c_custkey % 3 <> 0"
CHANGES_SQL = f"""select d.name, c.value as before, case when selected <> 'on' then selected end as after, case when selected = 'on' then 'remove' when c.value is null then 'set' else 'change' end as op from ({DECISIONS_SQL}) d left join ({CURRENT_SQL}) c using (name)
 where approved and controllable and selected is not null and c.value is distinct from case when selected <> 'on' then selected end"""


def _policies(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = _table(spark, sf, "customer")
    k = F.col("c_custkey")
    decisions = c.select(F.col("c_name").alias("name"), F.when(k % 4 == 0, "on").when(k % 4 == 1, "off").when(k % 4 == 2, "name-only").alias("selected"), (k % 7 != 0).alias("approved"), (k % 11 != 0).alias("controllable"))
    return decisions, c.where(k % 3 != 0).select(F.col("c_name").alias("name"), F.when(k % 2 == 0, "off").otherwise("name-only").alias("value"))


@query(CHANGES_SQL)
def policy_diff(spark: SparkSession, sf: str) -> DataFrame:
    return records.policy_changes(*_policies(spark, sf))


@query(f"select coalesce(c.name, x.name) as name, case when x.name is not null then x.after else c.value end as value from ({CURRENT_SQL}) c full join ({CHANGES_SQL}) x on c.name = x.name where case when x.name is not null then x.after else c.value end is not null")
def policy_patch(spark: SparkSession, sf: str) -> DataFrame:
    decisions, current = _policies(spark, sf)
    return records.patched(current, records.policy_changes(decisions, current))


@query(CURRENT_SQL)
def policy_restore(spark: SparkSession, sf: str) -> DataFrame:
    """Applying the reverted changes gives the settings before."""
    decisions, current = _policies(spark, sf)
    changes = records.policy_changes(decisions, current)
    return records.patched(records.patched(current, changes), records.reverted(changes))


@query("select o_orderkey, 'unqueued' as state from orders where o_orderkey % 4 = 0 union all select o_orderkey, 'pending' from orders where o_orderkey % 4 <> 0 and o_orderkey % 3 <> 0")
def reconcile(spark: SparkSession, sf: str) -> DataFrame:
    o = _table(spark, sf, "orders").select("o_orderkey")
    return records.reconcile(o, o.where("o_orderkey % 4 <> 0"), o.where("o_orderkey % 3 = 0"), "o_orderkey")


@query("with a as (select p_partkey as k from part where p_size > 5), b as (select distinct l_partkey as k from lineitem where l_quantity > 49 and l_discount > 0.05) select k, 'left' as side from a where k not in (select k from b) union all select k, 'right' from b where k not in (select k from a)")
def missing_and_dangling(spark: SparkSession, sf: str) -> DataFrame:
    used = _table(spark, sf, "lineitem").where("l_quantity > 49 and l_discount > 0.05").select(F.col("l_partkey").alias("k"))
    return records.only_in_either(_table(spark, sf, "part").where("p_size > 5").select(F.col("p_partkey").alias("k")), used, "k")


@query("select conv_id, turn, role, count(*) filter (new) over (partition by conv_id order by turn rows unbounded preceding) as run from (select *, role is distinct from lag(role) over (partition by conv_id order by turn) or turn = 0 as new from conversations)")
def group_consecutive(spark: SparkSession, sf: str) -> DataFrame:
    return records.consecutive(_table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", "role")


@query("select conv_id, role, min(turn) as first, array_to_string(list(length(text) order by turn), ',') as sizes from conversations group by 1, 2")
def ordered_groups(spark: SparkSession, sf: str) -> DataFrame:
    got = records.ordered_groups(_table(spark, sf, "conversations"), ["conv_id", "role"], "turn", F.length("text").cast("string"), "sizes")
    return got.withColumn("sizes", F.array_join("sizes", ","))


@query(
    """select conv_id, turn, coalesce(last_value(case when role = 'user' then concat('Thing ', turn) end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding), 'Overview') as object from conversations"""
)
def carried_object(spark: SparkSession, sf: str) -> DataFrame:
    """An assistant's turn is a section of the object that the user's turn opened."""
    c = _table(spark, sf, "conversations").withColumn("title", F.when(F.col("role") == "user", F.concat(F.lit("Thing "), F.col("turn").cast("string"))).otherwise("Examples"))
    return records.carried_object(c, "turn", "title", ["properties", "remarks"], ["conv_id"]).select("conv_id", "turn", "object")


@query("select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by 1")
def newest_record(spark: SparkSession, sf: str) -> DataFrame:
    """The last row of each key."""
    e = _table(spark, sf, "events").select("user_id", "event_id", "event_type").withColumn("ord", F.col("event_id"))
    return records.last_by_key(e, "user_id", "ord").select("user_id", "event_id", "event_type")


@query("with r as (select c_custkey as k, c_name as name, 0 as root from customer where c_custkey % 2 = 0 union all select p_partkey, p_name, 1 from part union all select s_suppkey, s_name, 2 from supplier) select k, arg_min(name, root) as name, min(root) as root from r group by 1")
def discovery_precedence(spark: SparkSession, sf: str) -> DataFrame:
    roots = [_table(spark, sf, "customer").where("c_custkey % 2 = 0").selectExpr("c_custkey k", "c_name name"), _table(spark, sf, "part").selectExpr("p_partkey k", "p_name name"), _table(spark, sf, "supplier").selectExpr("s_suppkey k", "s_name name")]
    return records.by_precedence(roots, "k").withColumn("root", F.col("root").cast("int")).select("k", "name", "root")


@query("select l_suppkey, l_partkey from lineitem where l_quantity > 25 except all select l_suppkey, l_partkey from lineitem where l_discount > 0.05")
def multiset_difference(spark: SparkSession, sf: str) -> DataFrame:
    l = _table(spark, sf, "lineitem")
    return l.where("l_quantity > 25").select("l_suppkey", "l_partkey").exceptAll(l.where("l_discount > 0.05").select("l_suppkey", "l_partkey"))


@query(
    """with o as (select concat('chapter ', n_nationkey) as title, (n_nationkey * 3)::bigint as start from nation), s as (select *, lead(start) over (order by start) as stop from (select distinct start from o))
 select title, page_id as page, length(html) as chars from o join s using (start) join pages on page_id >= start and (stop is null or page_id < stop)"""
)
def page_spans(spark: SparkSession, sf: str) -> DataFrame:
    outline = _table(spark, sf, "nation").select(F.concat(F.lit("chapter "), F.col("n_nationkey").cast("string")).alias("title"), (F.col("n_nationkey") * 3).cast("bigint").alias("start"))
    pages = _table(spark, sf, "pages").select(F.col("page_id").alias("page"), F.col("html").alias("text"))
    return records.page_spans(outline, pages).select("title", "page", F.length("text").cast("bigint").alias("chars"))


ISSUES_SQL = "select n_regionkey as package, n_name as file, 'unlisted' as issue from nation where n_nationkey % 3 = 0 union all select r_regionkey, concat(r_name, '.md'), 'dangling' from region"


def _issues(spark: SparkSession, sf: str) -> DataFrame:
    n = _table(spark, sf, "nation").select(F.col("n_regionkey").alias("package"), F.col("n_name").alias("file"), "n_nationkey")
    listed = n.where("n_nationkey % 3 <> 0").select("package", "file").unionByName(_table(spark, sf, "region").select(F.col("r_regionkey").alias("package"), F.concat("r_name", F.lit(".md")).alias("file")))
    return audit.listing_issues(n.drop("n_nationkey"), listed)


@query(ISSUES_SQL)
def listing_issues(spark: SparkSession, sf: str) -> DataFrame:
    return _issues(spark, sf)


@query(f"select issue, count(*) as n, array_to_string(list_slice(list_sort(list(file)), 1, 4), ',') as shown from ({ISSUES_SQL}) group by 1")
def lint_totals(spark: SparkSession, sf: str) -> DataFrame:
    return audit.issue_totals(_issues(spark, sf), shown=4).select("issue", "n", F.array_join("shown", ",").alias("shown"))


PACKAGES_SQL = "select lower(p_brand) as package, case when p_partkey % 3 = 0 then p_brand else lower(p_brand) end as name, case when p_partkey % 4 = 0 then '' else concat('Use for ', p_type) end as description, p_size % 3 as n_files, p_size % 2 as n_topics, p_partkey % 5 = 0 as is_router, p_size % 4 as children from part"


@query(
    f"""with p as ({PACKAGES_SQL}) select package, 'name is not in kebab case' as message from p where not regexp_matches(name, '^[a-z0-9]+(-[a-z0-9]+)*$')
 union all select package, 'name differs from the folder' from p where name <> package union all select package, 'description is missing' from p where description = ''
 union all select package, 'no reference files' from p where n_files = 0 union all select package, 'no topics are listed' from p where not is_router and n_topics = 0
 union all select package, 'a router without packages' from p where is_router and children = 0 union all select package, 'packages inside a leaf' from p where not is_router and children > 0"""
)
def package_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Every broken rule of every package."""
    rows = _table(spark, sf, "part").selectExpr(
        "lower(p_brand) package", "case when p_partkey % 3 = 0 then p_brand else lower(p_brand) end name", "case when p_partkey % 4 = 0 then '' else concat('Use for ', p_type) end description",
        "p_size % 3 n_files", "p_size % 2 n_topics", "p_partkey % 5 = 0 is_router", "p_size % 4 children",
    )
    return audit.package_errors(rows)


@query("select l_partkey as term, array_to_string(list_sort(list(distinct s_name)), ',') as files from (select distinct l_partkey, l_suppkey from lineitem) join supplier on s_suppkey = l_suppkey group by 1")
def source_remap(spark: SparkSession, sf: str) -> DataFrame:
    """Terms mapped to the files of their sources."""
    terms = _table(spark, sf, "lineitem").selectExpr("l_partkey term", "l_suppkey source").distinct()
    files = _table(spark, sf, "supplier").selectExpr("s_suppkey source", "s_name file")
    return graph.remap(terms, files).select("term", F.array_join("reference_files", ",").alias("files"))


@query("select o_orderkey, coalesce(hints, '') as hints from orders left join (select l_orderkey, array_to_string(list_sort(list(distinct l_returnflag)), ',') as hints from lineitem where l_quantity > 40 group by 1) on o_orderkey = l_orderkey")
def hints_inherited(spark: SparkSession, sf: str) -> DataFrame:
    known = _table(spark, sf, "lineitem").where("l_quantity > 40").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_set("l_returnflag")).alias("hints"))
    return records.inherited(_table(spark, sf, "orders").select("o_orderkey"), known, "o_orderkey", "hints").withColumn("hints", F.array_join("hints", ","))


@query("select o_orderstatus, count(*) as source, count(*) filter (o_orderkey % 2 = 0) as queued, count(*) filter (o_orderkey % 6 = 0) as done from orders group by 1")
def lifecycle_counts(spark: SparkSession, sf: str) -> DataFrame:
    o = _table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return records.lifecycle(o, o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 6 = 0"), "o_orderkey", "o_orderstatus")


@query(
    "with p as (select p_brand as package, case when p_partkey % 3 = 0 then concat(p_brand, '-', p_size % 4) end as parent, p_partkey from part), f as (select p_brand as package, bool_or(p_size = 7) as side from part group by 1), "
    "c as (select parent as package, count(*) as n from p where parent is not null group by 1), k as (select distinct package from p union select parent from p where parent is not null) "
    "select package, case when n > 0 then concat('router(', n, ')') else 'flat' end as layout, coalesce(side, false) as side_effects, case when package = 'Brand#12' then 'on' else 'user-invocable-only' end as recommended, case when package = 'Brand#12' then 'high' else 'medium' end as confidence from k left join c using (package) left join f using (package)"
)
def package_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Brands as packages, with child packages and scripts by size."""
    p = _table(spark, sf, "part")
    parent = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_brand", F.lit("-"), (F.col("p_size") % 4).cast("string")))
    packages = p.select(F.col("p_brand").alias("package"), parent.alias("parent"))
    packages = packages.unionByName(packages.where("parent is not null").select(F.col("parent").alias("package"), F.lit(None).cast("string").alias("parent")))
    files = p.select(F.col("p_brand").alias("package"), F.when(F.col("p_size") == 7, "scripts/run.sh").otherwise("a/scripts.md").alias("file"))
    return audit.package_classes(packages, files, ["Brand#12"])


@query(
    "with r as (select c_mktsegment as scope, c_name as name, length(c_name)::bigint as chars, 0 as root from customer where c_custkey % 2 = 0 union all select c_mktsegment, c_name, c_custkey, 1 from customer), f as (select scope, name, arg_min(chars, root) as chars from r group by 1, 2) "
    "select scope, count(*) as n, sum(chars)::bigint as chars, round_even(sum(chars) / 4, 0)::bigint as tokens, concat('| Name | Chars | Tokens |', chr(10), '| --- | --- | --- |', chr(10), string_agg(concat('| ', name, ' | ', chars, ' | ', round_even(chars / 4, 0)::bigint, ' |'), chr(10) order by name)) as listing from f group by 1"
)
def audit_report(spark: SparkSession, sf: str) -> DataFrame:
    """Packages under two roots, reported once each."""
    c = _table(spark, sf, "customer").select(F.col("c_mktsegment").alias("scope"), F.col("c_name").alias("name"), F.col("c_custkey").cast("bigint").alias("chars"))
    return audit.audit_report(audit.inventory([c.where("chars % 2 = 0").withColumn("chars", F.length("name").cast("bigint")), c]))


@query("select p_partkey, p_brand, p_type, count(*) over (partition by p_brand, p_type) as same from part")
def title_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """A13."""
    return audit.collisions(_table(spark, sf, "part").select("p_partkey", "p_brand", "p_type"), ["p_brand"], "p_type")


@query("select p_brand, array_to_string(list_slice(list(t order by o), 1, 18), '; ') as covers from (select p_brand, concat(p_type, ' ', p_size) as t, min(p_partkey) as o from part group by 1, 2) group by 1")
def covers(spark: SparkSession, sf: str) -> DataFrame:
    """A14."""
    p = _table(spark, sf, "part").select("p_brand", F.concat_ws(" ", "p_type", F.col("p_size").cast("string")).alias("t"), "p_partkey")
    return audit.covers(p, ["p_brand"], "p_partkey", "t")


@query("select o_orderkey, o_totalprice from orders where o_totalprice > 400000 order by o_totalprice desc, o_orderkey")
def largest(spark: SparkSession, sf: str) -> DataFrame:
    """O3: what is over a size, the largest first."""
    return audit.largest(_table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 400_000, "o_orderkey")


@query("select conv_id, concat('> ', upper(role[1]), role[2:], ' ', conv_id, ' reference. Original prose; identifiers preserved verbatim.') as marker, case when turn % 2 = 0 then concat('t', turn, '/x') else '' end as inside from conversations where turn = 0 or turn = 1")
def package_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Titles, markers and inner folders of packages, named by the first turns of conversations."""
    from corpusloom.functions import text as T

    c = _table(spark, sf, "conversations").where("turn = 0 or turn = 1")
    i, t = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    slug, path = F.concat_ws("-", "role", i), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("pkg/t"), t, F.lit("/x/references/a.md"))).otherwise(F.lit("pkg/references/a.md"))
    return c.select("conv_id", T.marker_line(T.package_title(slug)).alias("marker"), T.package_inner(path).alias("inside"))


@query(
    "with f as (select p_brand as package, p_name as file, p_size as bytes from part where p_partkey % 4 <> 0), l as (select p_brand as package, p_name as file from part where p_partkey % 5 <> 0), "
    "i as (select coalesce(f.package, l.package) as package, coalesce(f.file, l.file) as file, f.file is null as dangling from (select distinct package, file from f) f full join (select distinct package, file from l) l on f.package = l.package and f.file = l.file where f.file is null or l.file is null), "
    "j as (select package, array_to_string(list_sort(coalesce(list(file) filter (not dangling), [])), ',') as unlisted, array_to_string(list_sort(coalesce(list(file) filter (dangling), [])), ',') as dangling from i group by 1), "
    "s as (select package, count(*) as files, array_to_string(coalesce(list(file order by bytes desc, file) filter (bytes > 45), []), ',') as oversize from f group by 1) "
    "select package, coalesce(files, 0) as files, coalesce(oversize, '') as oversize, coalesce(unlisted, '') as unlisted, coalesce(dangling, '') as dangling from s full join j using (package)"
)
def package_report(spark: SparkSession, sf: str) -> DataFrame:
    """Brands as packages, parts as files."""
    p = _table(spark, sf, "part")
    files = p.where("p_partkey % 4 <> 0").select(F.col("p_brand").alias("package"), F.col("p_name").alias("file"), F.col("p_size").alias("bytes"))
    listed = p.where("p_partkey % 5 <> 0").select(F.col("p_brand").alias("package"), F.col("p_name").alias("file"))
    got = audit.package_report(files, listed, 45)
    return got.select("package", "files", *[F.array_join(c, ",").alias(c) for c in ("oversize", "unlisted", "dangling")])
