"""Rules as data: a small intermediate form, compiled to Column predicates or SQL text, checked and evaluated.

A rule is {"id": ..., "logic": "and"|"or", "where": [[attribute, operator, value], ...]}.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The operators of a constraint.
OPERATORS = ("==", "!=", ">", ">=", "<", "<=", "in", "not_in", "contains", "matches")


def errors(rule: dict, attributes: Iterable[str]) -> list[str]:
    """What is wrong with a rule: unknown attributes, operators, logic, or values of the wrong kind."""
    known, out = set(attributes), []
    if rule.get("logic", "and") not in ("and", "or"):
        out.append(f"logic {rule.get('logic')}")
    for attribute, op, value in rule.get("where", []):
        if attribute not in known:
            out.append(f"attribute {attribute}")
        if op not in OPERATORS:
            out.append(f"operator {op}")
        elif (op in ("in", "not_in")) != isinstance(value, list):
            out.append(f"value of {attribute} {op}")
    return out


def _constraint(attribute: str, op: str, value: object) -> Column:
    c = F.col(attribute)
    return {
        "==": lambda: c == F.lit(value), "!=": lambda: c != F.lit(value), ">": lambda: c > F.lit(value), ">=": lambda: c >= F.lit(value), "<": lambda: c < F.lit(value), "<=": lambda: c <= F.lit(value),
        "in": lambda: c.isin(value), "not_in": lambda: ~c.isin(value), "contains": lambda: F.lower(c).contains(str(value).lower()), "matches": lambda: c.rlike(f"(?i){value}"),
    }[op]()


def predicate(rule: dict) -> Column:
    """The rule as a predicate; a comparison with null is false; a rule without constraints holds."""
    parts = [F.coalesce(_constraint(*w), F.lit(False)) for w in rule.get("where", [])]
    if not parts:
        return F.lit(True)
    return reduce((lambda a, b: a | b) if rule.get("logic") == "or" else (lambda a, b: a & b), parts)


def sql_text(rule: dict, source: str) -> str:
    """The rule as query text."""

    def quoted(v: object) -> str:
        return "'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v)

    def part(a: str, op: str, v: object) -> str:
        if op in ("in", "not_in"):
            return f"{a} {'NOT ' * (op == 'not_in')}IN ({', '.join(map(quoted, v))})"
        if op == "contains":
            return f"lower({a}) LIKE {quoted('%' + str(v).lower() + '%')}"
        if op == "matches":
            return f"{a} RLIKE {quoted('(?i)' + str(v))}"
        return f"{a} {'=' if op == '==' else op} {quoted(v)}"

    joined = f" {rule.get('logic', 'and').upper()} ".join(part(*w) for w in rule.get("where", []))
    return f"SELECT * FROM {source}" + (f" WHERE {joined}" if joined else "")


def is_well_formed(query: str) -> bool:
    """Starts with SELECT after comments, has FROM, balanced brackets and quotes."""
    text = re.sub(r"(?m)^\s*(?://|--).*$", "", query).strip()
    bare = re.sub(r"'(?:[^']|'')*'", "", text)
    return bool(re.match(r"(?i)select\b", text)) and bool(re.search(r"(?i)\bfrom\b", text)) and bare.count("(") == bare.count(")") and "'" not in bare


def contradicts(rule: dict) -> bool:
    """Whether an and-rule can never hold: an empty range, or an attribute equal to two values or to one it excludes."""
    if rule.get("logic", "and") != "and":
        return False
    low: dict[str, tuple[float, bool]] = {}
    high: dict[str, tuple[float, bool]] = {}
    equal: dict[str, set] = {}
    for a, op, v in rule.get("where", []):
        if op in (">", ">="):
            low[a] = max(low.get(a, (float("-inf"), False)), (v, op == ">"))
        elif op in ("<", "<="):
            high[a] = min(high.get(a, (float("inf"), True)), (v, op == "<="))
        elif op in ("==", "in"):
            own = {json.dumps(x) for x in (v if op == "in" else [v])}
            equal[a] = equal.get(a, own) & own
    for a, op, v in rule.get("where", []):
        if op in ("!=", "not_in") and a in equal:
            equal[a] = equal[a] - {json.dumps(x) for x in (v if op == "not_in" else [v])}
    empty_range = any(a in high and (low[a][0] > high[a][0] or (low[a][0] == high[a][0] and (low[a][1] or not high[a][1]))) for a in low)
    return empty_range or any(not v for v in equal.values())


def evaluate(df: DataFrame, rules: list[dict]) -> DataFrame:
    """One row per event and rule that holds, all rules in one pass over the events."""
    hits = F.array_compact(F.array(*[F.when(predicate(r), F.lit(r["id"])) for r in rules])) if rules else F.array().cast("array<string>")
    return df.withColumn("rule_id", F.explode(hits))


def rank_templates(templates: DataFrame, roles: list[str], kinds: list[str], k: int = 5) -> DataFrame:
    """The k templates most like the wanted roles and kinds, cheap ones first among equals.

    Score: 0.4 Jaccard of roles, 0.4 of kinds, 0.2 (1 - cost / largest cost); ties go by template order.
    """

    def jaccard(c: str, wanted: list[str]) -> Column:
        w = F.array(*map(F.lit, wanted)).cast("array<string>")
        union = F.size(F.array_union(c, w))
        return F.when(union > 0, F.size(F.array_intersect(c, w)) / union).otherwise(0.0)

    most = float(templates.agg(F.max("cost")).first()[0] or 1.0)  # one number
    s = templates.withColumn("score", 0.4 * jaccard("roles", roles) + 0.4 * jaccard("kinds", kinds) + 0.2 * (1 - F.col("cost") / F.lit(most)))
    return s.orderBy(F.col("score").desc(), "template_no").limit(k).select("template_no", F.round("score", 6).alias("score"))


def fold_grammar(tokens: Column, transitions: dict[tuple[str, str], str], start: str) -> Column:
    """The state after reading an array of tokens; 'fail' once a token has no transition."""
    table = F.create_map(*[F.lit(x) for (s, t), n in transitions.items() for x in (f"{s}|{t}", n)])
    return F.aggregate(tokens, F.lit(start), lambda s, t: F.coalesce(F.try_element_at(table, F.concat(s, F.lit("|"), t)), F.lit("fail")))


def fitting_templates(templates: DataFrame, actions: list[str]) -> DataFrame:
    """Templates that share an action with the wanted ones; all of them if none is wanted."""
    wanted = F.array(*map(F.lit, actions)).cast("array<string>")
    return templates.filter(F.arrays_overlap("actions", wanted)) if actions else templates


def rule_counts(df: DataFrame, rules: list[dict]) -> DataFrame:
    """rule_id, hits, misses of every rule over the rows, in one aggregation."""
    total = df.agg(F.count(F.lit(1)).alias("_all"), *[F.count_if(predicate(r)).alias(f"h{i}") for i, r in enumerate(rules)])
    cases = F.array(*[F.struct(F.lit(r["id"]).alias("rule_id"), F.col(f"h{i}").alias("hits"), (F.col("_all") - F.col(f"h{i}")).alias("misses")) for i, r in enumerate(rules)])
    return total.select(F.explode(cases).alias("c")).select("c.*")


def pushed(rules: DataFrame, agents: DataFrame) -> DataFrame:
    """rule_id, agent_id of every rule for the agents of its role; a rule without a role goes to none."""
    return rules.filter("role IS NOT NULL").join(agents, "role").select("rule_id", "agent_id")


def template_conflicts(templates: DataFrame, budget: float) -> DataFrame:
    """a_no, b_no, reason: pairs of templates of one category with a common action that can't both be pushed.

    severity: the same alert with different severities; memory: together more than twice the budget. An equi-
    join on category and action; the action 'any' is common to all of its category. Each pair and reason once.
    """
    every = templates.select("category", F.explode("actions").alias("own")).distinct()
    meets = templates.select("*", F.explode("actions").alias("own"))
    wild = templates.filter(F.array_contains("actions", "any")).select("category", "template_no", "alert", "severity", "mem").join(every, "category")
    parts = meets.select("category", "own", "template_no", "alert", "severity", "mem").unionByName(wild.select("category", "own", "template_no", "alert", "severity", "mem")).distinct()
    other = parts.select("category", "own", F.col("template_no").alias("b_no"), F.col("alert").alias("b_alert"), F.col("severity").alias("b_severity"), F.col("mem").alias("b_mem"))
    pairs = parts.join(other, ["category", "own"]).filter("template_no < b_no")
    reasons = F.array_compact(F.array(F.when((F.col("alert") == F.col("b_alert")) & (F.col("severity") != F.col("b_severity")), "severity"), F.when(F.col("mem") + F.col("b_mem") > 2 * budget, "memory")))
    return pairs.select(F.col("template_no").alias("a_no"), "b_no", F.explode(reasons).alias("reason")).distinct()


def verified(templates: DataFrame, actions: list[str], level: str, budget: float) -> DataFrame:
    """Templates within the budget that share an action (or take any) and reach the level; an unset level reaches all."""
    wanted = F.array(*map(F.lit, [*actions, "any"]))
    return templates.filter((F.col("mem") <= budget) & F.arrays_overlap("actions", wanted) & F.coalesce(F.col("least_level") >= level, F.lit(True)))


def synthesize(templates: DataFrame, roles: list[str], kinds: list[str], actions: list[str], level: str, budget: float) -> int | None:
    """The number of the best ranked template that passes verification; None means the generic rule."""
    passed = verified(fitting_templates(templates, [*actions, "any"]), actions, level, budget)
    best = rank_templates(passed, roles, kinds, 1).first()
    return best[0] if best else None


def response_of(query: Column) -> Column:
    """block if the query asks for the highest level, else alert."""
    return F.when(query.rlike(r"sensitivity\s*>?=\s*4"), "block").otherwise("alert")


def corrected(tokens: list[str], transitions: dict[tuple[str, str], str], start: str, final: set[str], changes: int = 2) -> list[str] | None:
    """The tokens with as few (at most `changes`) replaced or left out as it takes to end in a final state, else None."""
    best = {start: (0, [])}
    for t in tokens:
        nxt: dict[str, tuple[int, list[str]]] = {}
        for s, (cost, path) in best.items():
            moves = [(n, cost + (own != t), [*path, own]) for (a, own), n in transitions.items() if a == s] + [(s, cost + 1, path)]
            for n, c, p in moves:
                if c <= changes and (n not in nxt or (c, p) < nxt[n]):
                    nxt[n] = (c, p)
        best = nxt
    ends = [v for s, v in best.items() if s in final]
    return min(ends)[1] if ends else None
