"""Rule, interval and probability queries."""

from pyspark.sql import functions as F

from lumenquarry.operators import rules as L
from lumenquarry.plans.base import query


def geo_facts(t):
    s = lambda c: F.col(c).cast("string")
    a = t.nation.select(F.lit("in_region").alias("predicate"), F.array(s("n_nationkey"), s("n_regionkey")).alias("args"))
    b = t.customer.select(F.lit("lives"), F.array(s("c_custkey"), s("c_nationkey")))
    c = t.orders.select(F.lit("ordered"), F.array(s("o_custkey"), s("o_orderkey")))
    return a.unionAll(b).unionAll(c)


@query("rules_join", """
select c_custkey::varchar as c, n_regionkey::varchar as r from customer join nation on c_nationkey = n_nationkey""")
def rules_join(t):
    rules = [L.Rule.parse("resident(C, R) :- lives(C, N), in_region(N, R)")]
    return L.prove(geo_facts(t), rules, L.Atom.parse("resident(X, Y)")).select(F.col("X").alias("c"), F.col("Y").alias("r"))


@query("rules_constant", """
select distinct c_custkey::varchar as c from customer join nation on c_nationkey = n_nationkey join orders on o_custkey = c_custkey where n_regionkey = 2""")
def rules_constant(t):
    rules = [L.Rule.parse("resident(C, R) :- lives(C, N), in_region(N, R)"), L.Rule.parse("buyer(C) :- resident(C, 2), ordered(C, O)")]
    return L.prove(geo_facts(t), rules, L.Atom.parse("buyer(X)")).select(F.col("X").alias("c"))


@query("rules_fixpoint", """
with recursive e as (select o_orderkey as a, o_orderkey // 8 as b from orders where o_orderkey > 7), p as (select a, b from e union select p.a, e.b from p join e on p.b = e.a)
select a::varchar as a, b::varchar as b from p""")
def rules_fixpoint(t):
    rows = t.orders.where("o_orderkey > 7").select(F.col("o_orderkey").cast("string").alias("a"), F.floor(F.col("o_orderkey") / 8).cast("string").alias("b"))
    facts = rows.select(F.lit("edge").alias("predicate"), F.array("a", "b").alias("args"))
    rules = [L.Rule.parse("path(X, Y) :- edge(X, Y)"), L.Rule.parse("path(X, Z) :- path(X, Y), edge(Y, Z)")]
    return L.forward_chain(facts, rules).where("predicate = 'path'").select(F.get("args", 0).alias("a"), F.get("args", 1).alias("b"))


@query("rules_goal_bound", """
with recursive r as (select 500::bigint as id union select id // 2 from r where id > 1) select id::varchar as ancestor from r where id < 500""")
def rules_goal_bound(t):
    rows = t.orders.where("o_orderkey > 1").select(F.lit("parent").alias("predicate"), F.array(F.col("o_orderkey").cast("string"), F.floor(F.col("o_orderkey") / 2).cast("string")).alias("args"))
    rules = [L.Rule.parse("anc(500, Y) :- parent(500, Y)"), L.Rule.parse("anc(500, Z) :- anc(500, Y), parent(Y, Z)")]
    return L.prove(rows, rules, L.Atom.parse("anc(500, A)")).select(F.col("A").alias("ancestor"))


@query("rules_contradictions", """
with f as (select distinct c_mktsegment as k, c_nationkey::varchar as v from customer) select 'home' as predicate, x.k || ',' || x.v as a, x.k || ',' || y.v as b from f x join f y on x.k = y.k and x.v < y.v""")
def rules_contradictions(t):
    facts = t.customer.select(F.lit("home").alias("predicate"), F.array("c_mktsegment", F.col("c_nationkey").cast("string")).alias("args"))
    return L.contradictions(facts, ["home"])


@query("rules_retract", """
with recursive d as (select o_orderkey as fact, o_orderkey // 3 as support from orders where o_orderkey > 2), r as (select 2::bigint as fact union select d.fact from r join d on d.support = r.fact) select fact from r""")
def rules_retract(t):
    d = t.orders.where("o_orderkey > 2").select(F.col("o_orderkey").alias("fact"), F.floor(F.col("o_orderkey") / 3).alias("support"))
    return L.retract(d, t.orders.where("o_orderkey = 2").select(F.col("o_orderkey").alias("fact")))


INTERVALS = "i as (select o_orderkey, o_custkey, o_orderdate::date as s, max(l_shipdate)::date as e from orders join lineitem on l_orderkey = o_orderkey group by 1, 2, 3)"


def intervals(t):
    ship = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").cast("date").alias("e"))
    return t.orders.join(ship, "o_orderkey").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("s"), "e")


@query("interval_relations", f"""with {INTERVALS}, p as (select a.o_orderkey as a, b.o_orderkey as b, a.s as s1, a.e as e1, b.s as s2, b.e as e2 from i a join i b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey)
select a, b, case when s1=s2 and e1=e2 then 'equals' when e1=s2 then 'meets' when e2=s1 then 'met_by' when e1<s2 then 'before' when e2<s1 then 'after' when s1=s2 then case when e1<e2 then 'starts' else 'started_by' end
 when e1=e2 then case when s1>s2 then 'finishes' else 'finished_by' end when s1>s2 and e1<e2 then 'during' when s1<s2 and e1>e2 then 'contains' when s1<s2 then 'overlaps' else 'overlapped_by' end as relation from p""")
def interval_relations(t):
    i = intervals(t)
    a, b = (i.select(F.col("o_orderkey").alias(k), "o_custkey", F.col("s").alias(f"s_{k}"), F.col("e").alias(f"e_{k}")) for k in "ab")
    return a.join(b, "o_custkey").where("a < b").select("a", "b", L.allen(F.col("s_a"), F.col("e_a"), F.col("s_b"), F.col("e_b")).alias("relation"))


@query("interval_valid_at", f"with {INTERVALS} select o_orderkey from i where s <= date '1995-03-15' and e >= date '1995-03-15'")
def interval_valid_at(t):
    return L.valid_at(intervals(t), F.lit("1995-03-15").cast("date"), "s", "e").select("o_orderkey")


@query("interval_timeline", f"with {INTERVALS} select o_orderkey, 'start' as event, s as at from i union all select o_orderkey, 'end', e from i".replace(" as at ", ' as "at" '))
def interval_timeline(t):
    return L.timeline(intervals(t), "o_orderkey", "s", "e")


@query("contradiction_resolution", """
select a.p_partkey as a, b.p_partkey as b, case when abs(a.p_retailprice / 1000 - b.p_retailprice / 1000) > 0.01 then case when a.p_retailprice > b.p_retailprice then 'a' else 'b' end
 when abs(a.p_size - b.p_size) > 0.01 then case when a.p_size > b.p_size then 'a' else 'b' end when a.p_partkey > b.p_partkey then 'a' when a.p_partkey < b.p_partkey then 'b' end as winner
from part a join part b on a.p_brand = b.p_brand and a.p_type = b.p_type and a.p_partkey < b.p_partkey""")
def contradiction_resolution(t):
    p = t.part.select("p_brand", "p_type", "p_partkey", F.struct((F.col("p_retailprice") / 1000).alias("confidence"), F.col("p_size").alias("credibility"), F.col("p_partkey").alias("date")).alias("x"))
    a, b = (p.select("p_brand", "p_type", F.col("p_partkey").alias(k), F.col("x").alias(f"x_{k}")) for k in "ab")
    return a.join(b, ["p_brand", "p_type"]).where("a < b").select("a", "b", L.resolve("x_a", "x_b").alias("winner"))


@query("rule_probability", """
with d as (select l_suppkey as atom, avg(1 - l_discount) as direct from lineitem where l_quantity < 26 group by 1), r as (select l_suppkey as atom, l_returnflag as rule, product(l_discount / 100 + 0.99) as p from lineitem where l_quantity >= 26 group by 1, 2),
n as (select atom, 1 - product(1 - p) as by_rules from r group by 1) select atom, round(coalesce(direct, by_rules, 0.5), 6) as p from d full outer join n using (atom)""")
def rule_probability(t):
    facts = t.lineitem.where("l_quantity < 26").select(F.col("l_suppkey").alias("atom"), (1 - F.col("l_discount")).alias("p"))
    hits = t.lineitem.where("l_quantity >= 26").select(F.col("l_suppkey").alias("atom"), F.col("l_returnflag").alias("rule"), (F.col("l_discount") / 100 + 0.99).alias("p"))
    return L.probability(facts, hits).select("atom", F.round("p", 6).alias("p"))


@query("graph_to_facts", """
select 'part' as predicate, p_partkey::varchar as args from part union all select 'brand', p_partkey || ',' || p_brand from part union select distinct 'supplies', l_suppkey || ',' || l_partkey from lineitem""")
def graph_to_facts(t):
    nodes = t.part.select(F.col("p_partkey").alias("id"), F.lit("Part").alias("type"), F.create_map(F.lit("brand"), "p_brand").alias("properties"))
    edges = t.lineitem.select(F.col("l_suppkey").alias("src"), F.lit("Supplies").alias("type"), F.col("l_partkey").alias("dst"))
    return L.graph_facts(nodes, edges).select("predicate", F.concat_ws(",", "args").alias("args"))
