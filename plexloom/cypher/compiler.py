"""Cypher AST to DataFrame.

Bindings are a DataFrame with a struct column for each node or edge alias and a plain column for each value.  A chain of
patterns is compiled to equi-joins of its own, then joined with the bindings on the aliases they share.

Semantics that differ from SQL: predicates are two-valued (null in a comparison gives false); text and numbers compare
by the number in the text; ascending order puts nulls before texts and after anything else; SUM of nothing is 0; a
variable-length segment uses an edge once, and gives a row for each trail.

JSON properties have the type that each row gives them (functions/dynamic.py) and come out as VARIANT.  COLLECT gives
its values in ascending order, as bindings have none.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import VariantVal

from plexloom.cypher.parser import Chain, Clause, CypherError, Match, Query, parse_query
from plexloom.functions.dynamic import FLOATS, NUM, NUMERIC, Value, compare_dynamic, dynamic, is_dynamic, json_value, rest, sort_keys, to_variants, total
from plexloom.functions.scalars import SCALARS
from plexloom.graph import GraphView

NODE_ALIASES = {"node_id": "id", "project_id": "project", "qn": "qualified_name", "file": "file_path"}
EDGE_ALIASES = {"source_id": "source", "target_id": "target", "type": "kind"}
MAX_ROWS = 10_000


def _family(t: T.DataType) -> str:
    if is_dynamic(t):
        return "dynamic"
    return "num" if isinstance(t, NUMERIC) else "str" if isinstance(t, T.StringType) else "bool" if isinstance(t, T.BooleanType) else "null" if isinstance(t, T.NullType) else "other"


def _exact_bound(v: Value) -> bool:
    """Whether v is a literal number that a double holds exactly."""
    return v.kind == "literal" and abs(v.number) <= 2**53


def compare(op: str, left: Value, right: Value) -> Column:
    """A two-valued comparison of values of any types."""
    l, r, a, b = left.col, right.col, _family(left.type), _family(right.type)
    if "null" in (a, b):
        return F.lit(False)
    if op in ("=~", "contains", "starts", "ends"):
        l, r = (c["s"] if f == "dynamic" else c for c, f in ((l, a), (r, b)))
        if not {a, b} <= {"str", "dynamic"}:
            return F.lit(False)
        out = {"=~": lambda: F.regexp(l, r), "contains": lambda: F.contains(l, r), "starts": lambda: F.startswith(l, r), "ends": lambda: F.endswith(l, r)}[op]()
        return F.coalesce(out, F.lit(False))
    calc = {"=": lambda x, y: x == y, "<>": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    if a == b and a not in ("other", "dynamic"):
        mixed = a == "num" and isinstance(left.type, FLOATS) != isinstance(right.type, FLOATS) and not _exact_bound(left) and not _exact_bound(right)
        if mixed:  # an integer and a double that may not hold it
            pair = lambda v: F.struct(v.col.cast("double").alias("d"), (F.lit(0).cast("long") if isinstance(v.type, FLOATS) else rest(v.col.cast("decimal(38,0)"), v.col.cast("double"))).alias("r"))
            return F.coalesce(F.when(l.isNotNull() & r.isNotNull(), calc(pair(left), pair(right))), F.lit(False))
        return F.coalesce(calc(l, r), F.lit(False))
    return compare_dynamic(calc, dynamic(left), dynamic(right))


@dataclass
class Bindings:
    df: DataFrame
    kinds: dict[str, str]  # alias -> node, edge or value
    maybe: frozenset[str] = frozenset()  # aliases that OPTIONAL MATCH may have left null


#: Column of bindings that says how many equal ones a row stands for.
TIMES = "__times"
#: Aggregates that can be had of bindings with such a column: all by how many there are, or whatever their number.
COUNTED = {"count", "min", "max"}


def _aliases(x: object) -> set[str]:
    """Aliases that an expression, a pattern, or any list of these refers to."""
    if isinstance(x, Chain):
        return {p.alias for p in (*x.nodes, *x.edges)}
    if isinstance(x, tuple) and len(x) == 2 and x[0] == "ref" and isinstance(x[1], list):
        return {x[1][0]}
    return set().union(*map(_aliases, x)) if isinstance(x, list | tuple) else set()


def _orderable(t: T.DataType) -> bool:
    """Whether rows can be grouped by a value of type t."""
    if isinstance(t, T.StructType):
        return all(_orderable(f.dataType) for f in t.fields)
    return _orderable(t.elementType) if isinstance(t, T.ArrayType) else not isinstance(t, T.MapType | T.VariantType)


class Compiler:
    def __init__(self, view: GraphView, text: str) -> None:
        degree = re.search(r"\b(in_degree|out_degree|degree)\b", text)
        self.nodes = view.nodes_with_degrees() if degree else view.nodes
        self.edges, self.flags = view.edges, 0
        self.used: Counter[str] | None = None

    # -- patterns
    def _nodes(self, p) -> DataFrame:
        df = self.nodes.filter(F.col("label").isin(p.labels)) if p.labels else self.nodes
        for k, v in p.props.items():
            df = df.filter(compare("=", self._field(lambda c: F.col(c), df.schema, k, NODE_ALIASES), literal(v)) if v is not None else self._field(lambda c: F.col(c), df.schema, k, NODE_ALIASES).col.isNull())
        return df.select(F.struct(*df.columns).alias(p.alias))

    def _edges(self, p) -> DataFrame:
        df = self.edges.filter(F.col("kind").isin(p.kinds)) if p.kinds else self.edges
        whole = F.struct(*df.columns).alias(p.alias)
        out = df.select(whole, F.col("source").alias("__f"), F.col("target").alias("__t"))
        back = df.select(whole, F.col("target").alias("__f"), F.col("source").alias("__t"))
        return {"out": out, "in": back, "both": out.unionByName(back.filter("__f <> __t"))}[p.direction]

    def chain(self, chain: Chain) -> tuple[DataFrame, dict[str, str]]:
        kinds: dict[str, str] = {}
        first = chain.nodes[0]
        df, here = self._nodes(first), first.alias
        kinds[here] = "node"
        for edge, node in zip(chain.edges, chain.nodes[1:], strict=True):
            if edge.alias in kinds:
                raise CypherError(f"{edge.alias} is bound twice in one pattern")
            step = self._edges(edge)
            kinds[edge.alias] = "edge"
            if edge.hops is None:
                df = df.join(step, F.col(f"{here}.id") == F.col("__f")).drop("__f")
            else:
                df = self._trails(df, here, edge, step)
            again = node.alias in kinds
            right = self._nodes(node).withColumnRenamed(node.alias, "__n")
            df = df.join(right, F.col("__t") == F.col("__n.id")).drop("__t")
            df = df.filter(F.col(f"{node.alias}.id") == F.col("__n.id")).drop("__n") if again else df.withColumnRenamed("__n", node.alias)
            kinds[node.alias], here = "node", node.alias
        return df, kinds

    def _trails(self, df: DataFrame, here: str, edge, step: DataFrame) -> DataFrame:
        """Rows for each trail of low to high edges, by one join a hop."""
        low, high = edge.hops
        key = F.concat_ws("\u0001", F.col("__e.source"), F.col("__e.target"), F.col("__e.kind"), F.col("__e.discriminator"))
        step = step.select(F.col(edge.alias).alias("__e"), F.col("__f"), F.col("__t").alias("__to"))
        kept = df.columns
        level = df.withColumn("__t", F.col(f"{here}.id")).withColumn(edge.alias, F.lit(None).cast(step.schema["__e"].dataType)).withColumn("__path", F.expr("cast(array() as array<string>)"))
        out = level if low == 0 else None
        for k in range(1, high + 1):
            level = level.drop(edge.alias).join(step, F.col("__t") == F.col("__f")).filter(~F.array_contains("__path", key))
            level = level.select(*kept, F.col("__to").alias("__t"), F.col("__e").alias(edge.alias), F.concat("__path", F.array(key)).alias("__path"))
            if k >= low:
                out = level if out is None else out.unionByName(level)
        return out.drop("__path")

    def clause(self, chains: list[Chain]) -> Bindings:
        out = None
        for c in chains:
            own = self.folded(Bindings(*self.chain(c)))
            out = own if out is None else self.join(out, own, "inner")
        return out

    def folded(self, b: Bindings) -> Bindings:
        """Bindings of one pattern, in which those that differ only in aliases that nothing else refers to are one row and
        their number; so patterns that share an alias with many bindings don't give all pairs of these to be counted."""
        if self.used is None:
            return b
        kept = [a for a in b.kinds if self.used[a] > 1]
        if len(kept) == len(b.kinds) or not all(_orderable(b.df.schema[a].dataType) for a in kept):
            return b
        df = b.df.groupBy(*[F.col(f"`{a}`") for a in kept]).agg(F.count(F.lit(1)).alias(TIMES))
        return Bindings(df if kept else df.filter(F.col(TIMES) > 0), {a: b.kinds[a] for a in kept}, b.maybe & frozenset(kept))

    def _foldable(self, query: Query) -> Counter[str] | None:
        """How many patterns and other expressions use each alias, if the query joins patterns only to aggregate them in a
        way that bindings with their numbers allow; else None."""
        clause = query.with_ or query.return_
        aggs = [p.expr for p in clause.items or [] if p.expr[0] == "agg"]
        chains = [c for m in query.matches for c in m.chains]
        if len(chains) < 2 or not aggs or not all(e[1] in COUNTED for e in aggs) or query.unwind or any(m.optional for m in query.matches):
            return None
        others = [*[m.where for m in query.matches], [p.expr for p in clause.items], [e for e, _ in clause.order]]
        return Counter(a for x in (*chains, *others) for a in _aliases(x))

    def join(self, left: Bindings, right: Bindings, how: str) -> Bindings:
        """Join on shared aliases.  One that is null on the left, for want of an optional match, is bound anew."""
        open_ = [a for a in right.kinds if a in left.maybe and a in left.kinds]
        if open_ and how in ("inner", "left"):
            alias, kinds = open_[0], left.kinds
            held = self.join(Bindings(left.df.filter(F.col(alias).isNotNull()), kinds, left.maybe - {alias}), right, how)
            free = self.join(Bindings(left.df.filter(F.col(alias).isNull()).drop(alias), {a: k for a, k in kinds.items() if a != alias}, left.maybe - {alias}), right, how)
            return Bindings(held.df.unionByName(free.df, allowMissingColumns=True), held.kinds, held.maybe | free.maybe)
        shared = [a for a in right.kinds if a in left.kinds]
        df, cond = right.df, []
        counted = TIMES in df.columns
        if counted:
            df = df.withColumnRenamed(TIMES, "__more")
        for a in shared:
            if left.kinds[a] != right.kinds[a]:
                raise CypherError(f"{a} is both {left.kinds[a]} and {right.kinds[a]}")
            df = df.withColumnRenamed(a, f"__s_{a}")
            for f in ["id"] if left.kinds[a] == "node" else ["source", "target", "kind", "discriminator"]:
                cond.append(F.col(f"{a}.{f}") == F.col(f"__s_{a}.{f}"))
        if not cond and how == "inner":
            out = left.df.crossJoin(df)
        else:
            out = left.df.join(df, cond or F.lit(True), how)
        if counted:
            out = out.withColumn(TIMES, F.col(TIMES) * F.col("__more") if TIMES in out.columns else F.col("__more")).drop("__more")
        kinds = left.kinds | (right.kinds if how in ("inner", "left") else {})
        maybe = left.maybe | right.maybe | (frozenset(right.kinds) - frozenset(left.kinds) if how == "left" else frozenset())
        return Bindings(out.drop(*[f"__s_{a}" for a in shared]), kinds, maybe)

    def matches(self, query: Query) -> Bindings:
        out = None
        if query.unwind:
            expr, alias = query.unwind
            one = Bindings(self.nodes.sparkSession.range(1), {})
            list_ = self.value(one, expr)
            if not isinstance(list_.type, T.ArrayType | T.NullType):
                raise CypherError("UNWIND needs a list")
            array = F.expr("cast(array() as array<string>)") if isinstance(list_.type, T.NullType) else list_.col
            out = Bindings(one.df.select(F.explode(array).alias(alias)), {alias: "value"})
        for m in query.matches:
            out = self.match(out, m)
        return out

    def match(self, out: Bindings | None, m: Match) -> Bindings:
        own = self.clause(m.chains)
        out = own if out is None else self.join(out, own, "left" if m.optional else "inner")
        return self.where(out, m.where) if m.where else out

    # -- predicates
    def where(self, b: Bindings, expr: tuple) -> Bindings:
        if expr[0] == "and":
            return self.where(self.where(b, expr[1]), expr[2])
        if expr[0] == "exists":
            df, kinds = self.chain(expr[1])
            return self.join(b, Bindings(df, kinds), "left_anti" if expr[2] else "left_semi")
        before = b.df.columns
        b, cond = self.predicate(b, expr)
        return Bindings(b.df.filter(cond).select(*before), b.kinds, b.maybe)

    def predicate(self, b: Bindings, expr: tuple) -> tuple[Bindings, Column]:
        kind = expr[0]
        if kind in ("and", "or", "xor"):
            b, x = self.predicate(b, expr[1])
            b, y = self.predicate(b, expr[2])
            return b, x & y if kind == "and" else x | y if kind == "or" else x != y
        if kind == "not":
            b, x = self.predicate(b, expr[1])
            return b, ~x
        if kind == "exists":
            df, kinds = self.chain(expr[1])
            shared = [a for a in kinds if a in b.kinds]
            self.flags += 1
            flag = f"__flag{self.flags}"
            keys = [F.col(f"{a}.id").alias(f"{flag}_{a}") for a in shared]
            found = df.select(*keys).distinct().withColumn(flag, F.lit(True)) if shared else df.limit(1).select(F.lit(True).alias(flag))
            joined = b.df.join(found, [F.col(f"{a}.id") == F.col(f"{flag}_{a}") for a in shared] or F.lit(True), "left").drop(*[f"{flag}_{a}" for a in shared])
            cond = F.col(flag).isNull() if expr[2] else F.col(flag).isNotNull()
            return Bindings(joined, b.kinds, b.maybe), cond
        if kind == "label":
            ref = self.value(b, expr[1])
            is_node = expr[1][1][0] in b.kinds and b.kinds[expr[1][1][0]] == "node"
            return b, F.coalesce(ref.col["label"].isin(expr[2]), F.lit(False)) if is_node else F.lit(False)
        left = self.value(b, expr[2] if kind == "cmp" else expr[1])
        if kind == "null":
            return b, left.col.isNotNull() if expr[2] else left.col.isNull()
        if kind == "in":
            any_ = F.lit(False)
            for item in expr[2]:
                any_ = any_ | compare("=", left, self.value(b, item))
            return b, left.col.isNotNull() & ~any_ if expr[3] else any_
        right = self.value(b, expr[3])
        if expr[1] == "=~" and expr[3][0] == "lit":
            check_regex(self.nodes.sparkSession, expr[3][1])
        return b, compare(expr[1], left, right)

    # -- values
    def _field(self, get, schema: T.StructType, name: str, aliases: dict[str, str]) -> Value:
        name = aliases.get(name, name)
        found = {f.name: f.dataType for f in schema.fields}
        if name in found:
            return Value(get(name), found[name])
        return json_value(get("properties"), [name])

    def value(self, b: Bindings, expr: tuple) -> Value:
        kind = expr[0]
        if kind == "lit":
            return literal(expr[1])
        if kind == "list":
            items = [self.value(b, i) for i in expr[1]]
            if not items:
                return Value(F.expr("cast(array() as array<string>)"), T.ArrayType(T.StringType()))
            types = {type(v.type) for v in items} - {T.NullType}
            return typed(b.df, F.array(*[dynamic(v) if len(types) > 1 or T.StructType in types else v.col for v in items]))
        if kind == "case":
            return self._case(b, expr)
        if kind == "fn":
            fn = SCALARS.get(expr[1].lower())
            if fn is None:
                raise CypherError(f"unknown function {expr[1]}")
            return typed(b.df, fn(*[self.value(b, a) for a in expr[2]]))
        if kind == "agg":
            raise CypherError("an aggregate is not allowed here")
        alias, *path = expr[1]
        if alias not in b.kinds:
            raise CypherError(f"{alias} is not bound")
        schema = b.df.schema[alias].dataType
        if not path:
            return Value(F.col(f"`{alias}`"), schema, b.kinds[alias])
        if not isinstance(schema, T.StructType):
            raise CypherError(f"{alias} has no properties")
        if len(path) > 1 and path[0] == "properties":
            return json_value(F.col(f"`{alias}`.properties"), path[1:])
        return self._field(lambda c: F.col(f"`{alias}`.`{c}`"), schema, ".".join(path), NODE_ALIASES if b.kinds[alias] == "node" else EDGE_ALIASES)

    def _case(self, b: Bindings, expr: tuple) -> Value:
        subject = self.value(b, expr[1]) if expr[1] else None
        values = [self.value(b, v) for _, v in expr[2]] + [self.value(b, expr[3])]
        families = {_family(v.type) for v in values} - {"null"}
        put = dynamic if len(families) > 1 or "dynamic" in families else (lambda v: v.col)
        out = None
        for (cond, _), v in zip(expr[2], values, strict=False):
            if subject is None:
                test = self.predicate(b, cond)[1]
            else:
                c = self.value(b, cond)
                test = (subject.col.isNull() & c.col.isNull()) | compare("=", subject, c)
            out = F.when(test, put(v)) if out is None else out.when(test, put(v))
        return typed(b.df, out.otherwise(put(values[-1])))

    # -- projections
    def _aggregate(self, b: Bindings, expr: tuple) -> Column:
        _, name, distinct, target = expr
        counted = TIMES in b.df.columns
        times = lambda held: F.coalesce(F.sum(F.when(held, F.col(TIMES))), F.lit(0).cast("long"))
        if target is None:
            return times(F.lit(True)) if counted else F.count(F.lit(1))
        v = self.value(b, target)
        c = v.col["id"] if v.kind == "node" else F.struct(*[v.col[x] for x in ("source", "target", "kind", "discriminator")]) if v.kind == "edge" else v.col
        c = F.when(v.col.isNotNull(), c) if v.kind != "value" else c
        if name == "count":
            return F.count_distinct(c) if distinct else times(c.isNotNull()) if counted else F.count(c)
        if name == "collect":
            return F.array_sort(F.collect_set(c) if distinct else F.collect_list(c))
        if name in ("min", "max"):
            return F.min(c) if name == "min" else F.max(c)
        if is_dynamic(v.type):
            if name == "sum":
                if distinct:
                    raise CypherError("SUM(DISTINCT) needs a typed property; use toInteger or toFloat in a WITH before it")
                return total(c)
            c = F.when(c["rank"] == NUM, c["d"])
        c = c if _family(v.type) == "num" else c.cast("double")
        if name == "avg":
            c = c.cast("double")
            return F.sum_distinct(c) / F.nullif(F.count_distinct(c), F.lit(0)) if distinct else F.avg(c)
        return F.coalesce(F.sum_distinct(c) if distinct else F.sum(c), F.lit(0).cast("long") if not isinstance(v.type, T.DoubleType) else F.lit(0.0))

    def project(self, b: Bindings, clause: Clause) -> tuple[Bindings, list[tuple[str, bool, str]]]:
        """Projected bindings, with hidden columns for the order; and these columns (name, descending, family)."""
        items = clause.items if clause.items is not None else star(b)
        names = [p.name for p in items]
        if len(set(names)) < len(names):
            raise CypherError("two columns have one name")
        order = []
        hidden: list[tuple[str, tuple]] = []
        for k, (ref, desc) in enumerate(clause.order):
            plain = ".".join(ref[1]) if ref[0] == "ref" else None
            at = next((p.name for p in items if p.name == plain or p.expr == ref), None)
            if at is None:
                hidden.append((f"__o{k}", ref))
            order.append((at or f"__o{k}", desc))
        if any(p.expr[0] == "agg" for p in items):
            keys = [p for p in items if p.expr[0] != "agg"]
            aggs = [self._aggregate(b, p.expr).alias(p.name) for p in items if p.expr[0] == "agg"] + [F.first(self.value(b, e).col).alias(n) for n, e in hidden]
            values = [self.value(b, p.expr) for p in keys]
            by = [v.col.alias(p.name) for v, p in zip(values, keys, strict=True)]
            df = (b.df.groupBy(*by) if by else b.df).agg(*aggs)
        else:
            df = b.df.select(*[self.value(b, p.expr).col.alias(p.name) for p in items], *[self.value(b, e).col.alias(n) for n, e in hidden])
        df = df.select(*[F.col(f"`{n}`") for n in names], *[n for n, _ in hidden])
        kinds = {}
        for p in items:
            v = self.value(b, p.expr) if p.expr[0] == "ref" and len(p.expr[1]) == 1 else None
            kinds[p.name] = v.kind if v is not None else "value"
        return Bindings(df, kinds, frozenset(p.name for p in items if kinds[p.name] != "value")), [(n, d, _family(df.schema[n].dataType)) for n, d in order]

    def finish(self, b: Bindings, order, clause: Clause, where: bool, stable: bool = True) -> Bindings:
        names = [c for c in b.df.columns if not c.startswith("__o")]
        if clause.distinct:
            # of equal rows the one that comes first by the order stays
            hidden = [c for c in b.df.columns if c not in names]
            if hidden:
                first = b.df.groupBy(*[F.col(f"`{n}`") for n in names]).agg(*[(F.max if next(d for n, d, _ in order if n == h) else F.min)(F.col(h)).alias(h) for h in hidden])
                b = Bindings(first.select(*[F.col(f"`{n}`") for n in b.df.columns]), b.kinds, b.maybe)
            else:
                b = Bindings(b.df.dropDuplicates(names), b.kinds, b.maybe)
        if where and clause.where:
            b = self.where(b, clause.where)
        df, limited = b.df, clause.skip is not None or clause.limit is not None
        keys = []
        for name, desc, family in order:
            c = F.col(f"`{name}`")
            if family == "dynamic":
                keys += sort_keys(c, desc)
                continue
            nulls_first = (family == "str") != desc
            keys.append((c.desc_nulls_first() if nulls_first else c.desc_nulls_last()) if desc else (c.asc_nulls_first() if nulls_first else c.asc_nulls_last()))
        if limited and (stable or order or clause.skip):
            keys.append(F.to_json(F.struct(*[F.col(f"`{n}`") for n in names])))
        if keys:
            df = df.orderBy(*keys)
        if clause.skip:
            df = df.offset(clause.skip)
        if clause.limit is not None:
            df = df.limit(clause.limit)
        return Bindings(df.select(*[F.col(f"`{n}`") for n in names]), b.kinds, b.maybe)

    def query(self, query: Query, stable: bool = True) -> DataFrame:
        self.used = self._foldable(query)
        b = self.matches(query)
        if query.with_:
            b = self.finish(*self.project(b, query.with_), query.with_, True)
        return self.finish(*self.project(b, query.return_), query.return_, False, stable).df


def star(b: Bindings):
    from plexloom.cypher.parser import Projection

    out = []
    for alias, kind in b.kinds.items():
        if kind == "node" and not alias.startswith("__anon"):
            out += [Projection(("ref", [alias, p]), f"{alias}.{p}") for p in ("name", "qualified_name", "label", "file_path")]
        elif kind == "value":
            out.append(Projection(("ref", [alias]), alias))
    return out


@dataclass
class Literal(Value):
    number: float = float("inf")


def literal(v: object) -> Value:
    if v is None:
        return Value(F.lit(None), T.NullType())
    if isinstance(v, bool):
        return Value(F.lit(v), T.BooleanType())
    if isinstance(v, int):
        fits = -(2**63) <= v < 2**63
        return Literal(F.lit(v).cast("long") if fits else F.lit(str(v)).cast("decimal(38,0)"), T.LongType() if fits else T.DecimalType(38, 0), "literal", v)
    if isinstance(v, float):
        return Literal(F.lit(v), T.DoubleType(), "literal", v)
    return Value(F.lit(v), T.StringType())


def typed(df: DataFrame, c: Column) -> Value:
    return Value(c, df.select(c.alias("x")).schema["x"].dataType)


def check_regex(spark: SparkSession, pattern: object) -> None:
    """Patterns are those of linear-time matching; they run in the JVM, so they are compiled there."""
    if not isinstance(pattern, str):
        return
    if re.search(r"\(\?[=!<]|\\[1-9]", pattern):
        raise CypherError("look-around and back-references are not supported in =~")
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as e:
        raise CypherError(f"bad pattern: {pattern}") from e


def compile_query(view: GraphView, text: str, stable: bool = True) -> DataFrame:
    """The DataFrame of a query; branches of UNION must have the same columns in the same order.

    A LIMIT without ORDER BY takes the first rows by their JSON, so that it gives the same ones each time; if stable is
    false, it takes any, and reads no more than it needs."""
    branches, alls = parse_query(text)
    compiler = Compiler(view, text)
    out = compiler.query(branches[0], stable)
    for branch, all_ in zip(branches[1:], alls, strict=True):
        df = compiler.query(branch, stable)
        if df.columns != out.columns:
            raise CypherError("UNION needs the same columns in every branch")
        out, df = _alike(out, df)
        out = out.unionByName(df) if all_ else out.unionByName(df).distinct()
    return to_variants(out)


def _alike(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with dynamic columns where their types are of several families."""
    for c in a.columns:
        x, y = a.schema[c].dataType, b.schema[c].dataType
        if _family(x) != _family(y) and "null" not in (_family(x), _family(y)):
            a, b = (df.withColumn(c, dynamic(Value(F.col(f"`{c}`"), t))) for df, t in ((a, x), (b, y)))
    return a, b


@dataclass
class QueryResult:
    columns: list[str]
    rows: list[Row]
    total: int
    truncated: bool
    warnings: list[str]


def query_graph(view: GraphView, text: str, max_rows: int = 200) -> QueryResult:
    """At most max_rows rows, the number of all after SKIP and before LIMIT, and whether some are missing."""
    if not 0 < max_rows <= MAX_ROWS:
        raise CypherError(f"max_rows must be from 1 to {MAX_ROWS}")
    branches, _ = parse_query(text)
    limits = [b.return_.limit for b in branches]
    limit = limits[0] if len(branches) == 1 else None
    df = compile_query(view, text)
    if limit is None and not any(b.return_.order for b in branches):
        df = df.orderBy(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    rows = df.limit(max_rows + 1).collect()
    total = len(rows)
    if limit is not None or total > max_rows:  # else all rows are here
        branches[0].return_.limit = None
        whole = Compiler(view, text).query(branches[0]) if len(branches) == 1 else df
        total = whole.count()
    cap = max_rows if limit is None else min(max_rows, limit)
    rows = [Row(*[_plain_value(v) for v in r]) for r in rows[:max_rows]]
    return QueryResult(df.columns, rows, total, total > cap, [w for b in branches for w in b.warnings])


def _plain_value(v: object) -> object:
    """Python values for VARIANT ones."""
    if isinstance(v, VariantVal):
        return v.toPython()
    return [_plain_value(x) for x in v] if isinstance(v, list) else v
