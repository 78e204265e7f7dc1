"""A Datalog-style rule engine on DataFrames: rules compile to joins, evaluation is semi-naive to a fixpoint.

Facts are rows (predicate, args array<string>). A rule is text such as `path(X, Z) :- edge(X, Y), path(Y, Z)`;
upper-case terms are variables, others constants. Terms are flat; nested function terms are rejected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenquarry.operators.graph import cut

_ATOM = re.compile(r"\s*([A-Za-z_]\w*)\s*\(([^()]*)\)\s*")


@dataclass(frozen=True)
class Atom:
    predicate: str
    terms: tuple[str, ...]

    @staticmethod
    def parse(text: str) -> Atom:
        m = _ATOM.fullmatch(text)
        if not m:
            raise ValueError(f"not a flat atom: {text!r}")
        terms = tuple(x.strip() for x in m[2].split(",")) if m[2].strip() else ()
        return Atom(m[1], terms)

    @property
    def variables(self) -> list[str]:
        return list(dict.fromkeys(x for x in self.terms if is_variable(x)))


def is_variable(term: str) -> bool:
    return term[:1].isupper() or term[:1] == "_"


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple[Atom, ...]

    @staticmethod
    def parse(text: str) -> Rule:
        head, _, body = text.partition(":-")
        atoms = tuple(Atom.parse(x) for x in re.split(r",(?![^()]*\))|∧", body) if x.strip())
        rule = Rule(Atom.parse(head), atoms)
        unbound = set(rule.head.variables) - {v for a in atoms for v in a.variables}
        if unbound or not atoms:
            raise ValueError(f"head variables without a premise: {sorted(unbound)}" if atoms else "a rule needs premises")
        return rule


def validate(rule: Rule, ontology: dict[str, int]) -> list[str]:
    """What the ontology (predicate -> arity) doesn't know about a rule."""
    return [f"{a.predicate}/{len(a.terms)}" for a in (rule.head, *rule.body) if ontology.get(a.predicate) != len(a.terms)]


def _bindings(facts: DataFrame, atom: Atom) -> DataFrame:
    """Rows of variable bindings: constants filter, a repeated variable must agree with itself."""
    rows = facts.where((F.col("predicate") == atom.predicate) & (F.size("args") == len(atom.terms)))
    first: dict[str, int] = {}
    for i, term in enumerate(atom.terms):
        arg = F.get("args", i)
        if not is_variable(term):
            rows = rows.where(arg == term)
        elif term in first:
            rows = rows.where(arg == F.get("args", first[term]))
        else:
            first[term] = i
    return rows.select(*[F.get("args", i).alias(v) for v, i in first.items()]) if first else rows.select(F.lit(1).alias("__one")).distinct()


def _fire(rule: Rule, all_facts: DataFrame, delta: DataFrame, at: int) -> DataFrame:
    """Conclusions with premise `at` from the delta and the others from all facts."""
    joined = None
    for i, atom in enumerate(rule.body):
        b = _bindings(delta if i == at else all_facts, atom)
        if joined is None:
            joined = b
        else:
            keys = [c for c in b.columns if c in joined.columns]
            joined = joined.join(b, keys) if keys else joined.join(b)
    args = [F.col(x) if is_variable(x) else F.lit(x) for x in rule.head.terms]
    return joined.select(F.lit(rule.head.predicate).alias("predicate"), F.array(*args).cast("array<string>").alias("args"))


def forward_chain(facts: DataFrame, rules: list[Rule], rounds: int = 50) -> DataFrame:
    """All facts that follow, with the round they came in (0: given). Set semantics; ends when a round adds nothing."""
    known = cut(facts.select("predicate", "args").distinct().withColumn("round", F.lit(0)))
    delta = known
    for r in range(1, rounds + 1):
        made = [_fire(rule, known, delta, i) for rule in rules for i in range(len(rule.body))]
        new = reduce(DataFrame.unionAll, made).distinct().join(known, ["predicate", "args"], "left_anti")
        delta = cut(new.withColumn("round", F.lit(r)))
        if delta.isEmpty():
            return known
        known = cut(known.unionByName(delta))
    raise RuntimeError(f"no fixpoint after {rounds} rounds")


def prove(facts: DataFrame, rules: list[Rule], goal: Atom, rounds: int = 50) -> DataFrame:
    """Bindings of the goal: only rules that can lead to it are run (relevance), bottom-up."""
    wanted, relevant = {goal.predicate}, []
    grew = True
    while grew:
        grew = False
        for rule in rules:
            if rule.head.predicate in wanted and rule not in relevant:
                relevant.append(rule)
                wanted |= {a.predicate for a in rule.body}
                grew = True
    base = facts.where(F.col("predicate").isin(*wanted))
    derived = forward_chain(base, relevant, rounds) if relevant else base
    return _bindings(derived, goal).distinct()


def contradictions(facts: DataFrame, functional: list[str]) -> DataFrame:
    """Pairs of facts that can't both hold: a functional predicate with two last arguments for the same others, or not_p beside p."""
    f = facts.select("predicate", "args").distinct()
    key, last = F.slice("args", 1, F.size("args") - 1), F.element_at("args", -1)
    fn = f.where(F.col("predicate").isin(*functional)).select("predicate", key.alias("key"), last.alias("last"))
    pairs = fn.alias("a").join(fn.alias("b"), ["predicate", "key"]).where("a.last < b.last")
    pairs = pairs.select("predicate", F.concat_ws(",", F.concat("key", F.array("a.last"))).alias("a"), F.concat_ws(",", F.concat("key", F.array("b.last"))).alias("b"))
    neg = f.where(F.startswith("predicate", F.lit("not_"))).select(F.expr("substring(predicate, 5)").alias("predicate"), "args")
    both = f.join(neg, ["predicate", "args"]).select("predicate", F.concat_ws(",", "args").alias("a"), F.concat_ws(",", "args").alias("b"))
    return pairs.unionAll(both)


def retract(dependencies: DataFrame, retracted: DataFrame, rounds: int = 50) -> DataFrame:
    """Ids (fact) that fall with the retracted ones: everything supported by them, directly or not."""
    from lumenquarry.operators.graph import bfs

    edges = dependencies.select(F.col("support").alias("src"), F.col("fact").alias("dst"))
    return bfs(edges, retracted.select(F.col("fact").alias("id")), rounds).select(F.col("id").alias("fact"))


def allen(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """One of Allen's thirteen relations of two closed intervals; equality of ends is tested before order."""
    return (
        F.when((s1 == s2) & (e1 == e2), "equals").when(e1 == s2, "meets").when(e2 == s1, "met_by")
        .when(e1 < s2, "before").when(e2 < s1, "after").when(s1 == s2, F.when(e1 < e2, "starts").otherwise("started_by"))
        .when(e1 == e2, F.when(s1 > s2, "finishes").otherwise("finished_by"))
        .when((s1 > s2) & (e1 < e2), "during").when((s1 < s2) & (e1 > e2), "contains").when(s1 < s2, "overlaps").otherwise("overlapped_by")
    )


def valid_at(facts: DataFrame, at: Column, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Facts valid at a time; a null bound is open."""
    return facts.where(F.coalesce(F.col(start) <= at, F.lit(True)) & F.coalesce(F.col(end) >= at, F.lit(True)))


def timeline(facts: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Start and end events of each fact that have a time."""
    ends = F.explode(F.array(F.struct(F.lit("start").alias("event"), F.col(start).alias("at")), F.struct(F.lit("end").alias("event"), F.col(end).alias("at"))))
    return facts.select(key, ends.alias("x")).select(key, "x.event", "x.at").where("at is not null")


def resolve(a: str, b: str) -> Column:
    """Winner of a contradiction of structs a and b (confidence, credibility, date): "a", "b" or null."""
    c = lambda f: F.col(f"{a}.{f}") - F.col(f"{b}.{f}")
    return (
        F.when(F.abs(c("confidence")) > 0.01, F.when(c("confidence") > 0, "a").otherwise("b"))
        .when(F.abs(c("credibility")) > 0.01, F.when(c("credibility") > 0, "a").otherwise("b"))
        .when(F.col(f"{a}.date") > F.col(f"{b}.date"), "a").when(F.col(f"{a}.date") < F.col(f"{b}.date"), "b")
    )


def probability(facts: DataFrame, rule_hits: DataFrame) -> DataFrame:
    """Probability of each atom: mean of direct evidence, else noisy-or over rules (product of premises), else 0.5.

    facts (atom, p) direct evidence; rule_hits (atom, rule, p) one row per premise of a grounded rule; either may lack an atom.
    """
    direct = facts.groupBy("atom").agg(F.avg("p").alias("direct"))
    per_rule = rule_hits.groupBy("atom", "rule").agg(F.product("p").alias("p"))
    by_rules = per_rule.groupBy("atom").agg((1 - F.product(1 - F.col("p"))).alias("by_rules"))
    return direct.join(by_rules, "atom", "full_outer").select("atom", F.coalesce("direct", "by_rules", F.lit(0.5)).alias("p"))


def graph_facts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Facts of a property graph: type(id), key(id, value) of properties, relation(src, dst); keyed by all three parts.

    nodes (id, type, properties map), edges (src, type, dst). Names are normalised to identifiers.
    """
    name = lambda c: F.when(F.col(c).isNull() | (F.trim(c) == ""), "unknown").otherwise(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "_"))
    s = lambda c: F.col(c).cast("string")
    types = nodes.select(name("type").alias("predicate"), F.array(s("id")).alias("args"))
    props = nodes.select("id", F.explode("properties").alias("k", "v")).select(name("k").alias("predicate"), F.array(s("id"), s("v")).alias("args"))
    rel = edges.select(name("type").alias("predicate"), F.array(s("src"), s("dst")).alias("args"))
    return types.unionAll(props).unionAll(rel).distinct()


def _text(atom: Atom) -> Column:
    args = [F.col(x) if is_variable(x) else F.lit(x) for x in atom.terms]
    return F.concat(F.lit(f"{atom.predicate}("), F.concat_ws(", ", *args), F.lit(")"))


def derivations(facts: DataFrame, rules: list[Rule], rounds: int = 50) -> DataFrame:
    """Rows (predicate, args, round, rule, premises) of every derived fact: how it first came about.

    rule is the number of the rule; of several derivations in that round the smallest (rule, premises) is kept.
    """
    known = cut(facts.select("predicate", "args").distinct())
    delta, out = known, None
    for r in range(1, rounds + 1):
        made = []
        for k, rule in enumerate(rules):
            for at in range(len(rule.body)):
                joined = None
                for i, atom in enumerate(rule.body):
                    b = _bindings(delta if i == at else known, atom)
                    keys = [c for c in b.columns if joined is not None and c in joined.columns]
                    joined = b if joined is None else (joined.join(b, keys) if keys else joined.join(b))
                args = [F.col(x) if is_variable(x) else F.lit(x) for x in rule.head.terms]
                made.append(joined.select(
                    F.lit(rule.head.predicate).alias("predicate"), F.array(*args).cast("array<string>").alias("args"),
                    F.struct(F.lit(k).alias("rule"), F.array(*map(_text, rule.body)).alias("premises")).alias("why"),
                ))
        new = reduce(DataFrame.unionAll, made).groupBy("predicate", "args").agg(F.min("why").alias("why")).join(known, ["predicate", "args"], "left_anti")
        new = cut(new.select("predicate", "args", F.lit(r).alias("round"), "why.rule", "why.premises"))
        if new.isEmpty():
            return out if out is not None else new
        out = new if out is None else out.unionByName(new)
        delta = new.select("predicate", "args")
        known = cut(known.unionByName(delta))
    raise RuntimeError(f"no fixpoint after {rounds} rounds")


def explained(derived: DataFrame, goals: DataFrame, depth: int = 50) -> DataFrame:
    """Rows (goal, step, line): the proof of each goal (predicate, args) as text, from the goal to the given facts."""
    name = F.concat("predicate", F.lit("("), F.concat_ws(", ", "args"), F.lit(")"))
    how = cut(derived.select(name.alias("fact"), "rule", "premises"))
    front = cut(goals.select(name.alias("goal")).distinct().withColumn("fact", F.col("goal")))
    out, seen = None, front
    for step in range(depth):
        used = cut(front.join(how, "fact"))
        if used.isEmpty():
            break
        line = F.concat("fact", F.lit(" by rule "), F.col("rule").cast("string"), F.lit(" from "), F.concat_ws(" and ", "premises"))
        lines = used.select("goal", F.lit(step).alias("step"), line.alias("line"))
        out = lines if out is None else out.unionByName(lines)
        front = cut(used.select("goal", F.explode("premises").alias("fact")).distinct().join(seen, ["goal", "fact"], "left_anti"))
        seen = cut(seen.unionByName(front))
    return out if out is not None else front.select("goal", F.lit(0).alias("step"), F.lit("").alias("line")).limit(0)


Term = str | tuple  # a variable or constant, or (name, argument, ...)


def parse_term(text: str) -> Term:
    """A term such as f(X, g(a)): nested tuples of a name and its arguments."""
    pos = 0
    pieces = re.findall(r"[A-Za-z0-9_]+|[(),]", text)

    def term() -> Term:
        nonlocal pos
        if pos >= len(pieces) or pieces[pos] in "(),":
            raise ValueError(f"not a term: {text!r}")
        name = pieces[pos]
        pos += 1
        if pos < len(pieces) and pieces[pos] == "(":
            args = []
            while pieces[pos] != ")":
                pos += 1
                args.append(term())
                if pos >= len(pieces) or pieces[pos] not in ",)":
                    raise ValueError(f"not a term: {text!r}")
            pos += 1
            return (name, *args)
        return name

    out = term()
    if pos != len(pieces):
        raise ValueError(f"not a term: {text!r}")
    return out


def unify(a: Term, b: Term) -> dict[str, Term] | None:
    """The most general substitution that makes two terms equal, function terms included; None if there is none."""
    bound: dict[str, Term] = {}

    def of(t: Term) -> Term:
        while isinstance(t, str) and t in bound:
            t = bound[t]
        return t

    def holds(var: str, t: Term) -> bool:
        t = of(t)
        return t == var if isinstance(t, str) else any(holds(var, x) for x in t[1:])

    def full(t: Term) -> Term:
        t = of(t)
        return t if isinstance(t, str) else (t[0], *map(full, t[1:]))

    todo = [(a, b)]
    while todo:
        x, y = map(of, todo.pop())
        if x == y:
            continue
        if not (isinstance(x, str) and is_variable(x)):
            x, y = y, x
        if isinstance(x, str) and is_variable(x):
            if holds(x, y):
                return None
            bound[x] = y
        elif isinstance(x, tuple) and isinstance(y, tuple) and x[0] == y[0] and len(x) == len(y):
            todo += zip(x[1:], y[1:], strict=True)
        else:
            return None
    return {v: full(v) for v in bound}
