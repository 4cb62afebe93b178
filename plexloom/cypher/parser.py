"""Lexer and recursive-descent parser: text to a small AST of dataclasses and tuples.

Expressions are tuples: ("lit", value), ("list", items), ("ref", parts), ("fn", name, args), ("agg", name, distinct,
target), ("case", subject, whens, default), ("not", x), ("and" | "or" | "xor", x, y), ("cmp", op, x, y), ("in", x, items,
negated), ("null", x, negated), ("label", alias, labels), ("exists", chain, negated).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MAX_BYTES, MAX_TOKENS, MAX_BRANCHES, MAX_PATTERNS, MAX_PROJECTIONS, MAX_HOPS = 1 << 20, 16_384, 32, 64, 256, 10
# Words that would change data.
MUTATIONS = {"create", "merge", "delete", "detach", "set", "remove", "drop", "call", "load", "foreach", "insert", "update", "alter"}
AGGREGATES = {"count", "sum", "avg", "min", "max", "collect"}


class CypherError(ValueError):
    pass


@dataclass
class Token:
    kind: str  # word, quoted, string, int, float, sym
    text: str
    value: object = None


_TOKEN = re.compile(
    r"""\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|`(?P<quoted>[^`]+)`|(?P<float>\d+\.\d+)|(?P<int>\d+)|(?P<word>[^\W\d]\w*)|(?P<sym><>|!=|<=|>=|=~|\.\.|->|<-|[-()\[\]{}<>=,.:|*]))""",
    re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def lex(text: str) -> list[Token]:
    if len(text.encode()) > MAX_BYTES:
        raise CypherError("the query is too long")
    out, at, end = [], 0, len(text.rstrip())
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            raise CypherError(f"unexpected character at {at}: {text[at : at + 10].strip()!r}")
        at, kind, raw = m.end(), m.lastgroup, m[m.lastgroup]
        value = raw
        if kind == "string":
            value = re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), raw[1:-1], flags=re.S)
        elif kind == "int":
            value = int(raw)
        elif kind == "float":
            value = float(raw)
        out.append(Token(kind, raw, value))
        if len(out) > MAX_TOKENS:
            raise CypherError("the query has too many tokens")
    for t in out:
        if t.kind == "word" and t.text.lower() in MUTATIONS:
            raise CypherError(f"{t.text} is not allowed: queries only read")
    return out


@dataclass
class NodePattern:
    alias: str
    labels: list[str]
    props: dict[str, object]
    named: bool


@dataclass
class EdgePattern:
    alias: str
    kinds: list[str]
    direction: str  # out, in, both
    hops: tuple[int, int] | None
    named: bool


@dataclass
class Chain:
    nodes: list[NodePattern]
    edges: list[EdgePattern]


@dataclass
class Match:
    chains: list[Chain]
    optional: bool
    where: tuple | None


@dataclass
class Projection:
    expr: tuple
    name: str


@dataclass
class Clause:
    """WITH or RETURN."""

    items: list[Projection] | None  # None: *
    distinct: bool = False
    where: tuple | None = None
    order: list[tuple[tuple, bool]] = field(default_factory=list)  # (ref, descending)
    skip: int | None = None
    limit: int | None = None


@dataclass
class Query:
    unwind: tuple[tuple, str] | None
    matches: list[Match]
    with_: Clause | None
    return_: Clause
    warnings: list[str]


class Parser:
    def __init__(self, tokens: list[Token]) -> None:
        self.tokens, self.at, self.anon, self.warnings = tokens, 0, 0, []

    # -- tokens
    def peek(self, *words: str) -> bool:
        """The next tokens are these keywords (any case) or symbols."""
        for k, w in enumerate(words):
            t = self.tokens[self.at + k] if self.at + k < len(self.tokens) else None
            if t is None or t.kind not in ("word", "sym") or t.text.lower() != w.lower():
                return False
        return True

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += len(words)
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            got = self.tokens[self.at].text if self.at < len(self.tokens) else "the end"
            raise CypherError(f"expected {word}, found {got}")

    def name(self) -> str:
        t = self.tokens[self.at] if self.at < len(self.tokens) else None
        if t is None or t.kind not in ("word", "quoted"):
            raise CypherError(f"expected a name, found {t.text if t else 'the end'}")
        self.at += 1
        return t.value

    # -- clauses
    def query(self) -> Query:
        unwind = None
        if self.take("unwind"):
            value = self.operand()
            self.need("as")
            unwind = value, self.name()
        matches = []
        while self.peek("match") or self.peek("optional", "match"):
            optional = self.take("optional")
            if optional and not matches and unwind is None:
                raise CypherError("a query starts with MATCH")
            self.need("match")
            chains = [self.chain()]
            while self.take(","):
                chains.append(self.chain())
            matches.append(Match(chains, optional, self.expression() if self.take("where") else None))
        if not matches:
            raise CypherError("a query starts with MATCH")
        if sum(len(m.chains) for m in matches) > MAX_PATTERNS:
            raise CypherError("too many patterns")
        with_ = self.clause(True) if self.take("with") else None
        self.need("return")
        return_ = self.clause(False)
        if self.at < len(self.tokens):
            raise CypherError(f"unexpected {self.tokens[self.at].text}")
        return Query(unwind, matches, with_, return_, self.warnings)

    def clause(self, is_with: bool) -> Clause:
        out = Clause(None, self.take("distinct"))
        if not self.take("*"):
            out.items = [self.projection()]
            while self.take(","):
                out.items.append(self.projection())
            if len(out.items) > MAX_PROJECTIONS:
                raise CypherError("too many projections")
        elif is_with:
            raise CypherError("WITH * is not supported")
        while True:
            if is_with and self.take("where"):
                out.where = self.expression()
            elif self.take("order", "by"):
                out.order = [self.order_item()]
                while self.take(","):
                    out.order.append(self.order_item())
            elif self.peek("skip") or self.peek("limit"):
                word = self.name().lower()
                if getattr(out, word) is not None:
                    raise CypherError(f"{word} is given twice")
                t = self.tokens[self.at] if self.at < len(self.tokens) else None
                if t is None or t.kind != "int":
                    raise CypherError(f"{word} needs a whole number")
                self.at += 1
                setattr(out, word, t.value)
            else:
                return out

    def order_item(self) -> tuple[tuple, bool]:
        ref = self.type_ref() or self.reference()
        if self.take("desc") or self.take("descending"):
            return ref, True
        _ = self.take("asc") or self.take("ascending")
        return ref, False

    def projection(self) -> Projection:
        start = self.at
        expr = self.case() if self.peek("case") else self.operand(True)
        if expr[0] in ("lit", "list"):
            raise CypherError("a literal can't be projected")
        name = self.name() if self.take("as") else default_name(expr)
        if start == self.at:
            raise CypherError("empty projection")
        return Projection(expr, name)

    def case(self) -> tuple:
        self.need("case")
        subject = None if self.peek("when") else self.operand()
        whens, default = [], ("lit", None)
        while self.take("when"):
            cond = self.operand() if subject else self.expression()
            self.need("then")
            whens.append((cond, self.operand()))
        if self.take("else"):
            default = self.operand()
        self.need("end")
        return "case", subject, whens, default

    # -- patterns
    def chain(self) -> Chain:
        nodes, edges = [self.node()], []
        while self.peek("-") or self.peek("<-"):
            edges.append(self.edge())
            nodes.append(self.node())
        return Chain(nodes, edges)

    def _alias(self, what: str) -> tuple[str, bool]:
        t = self.tokens[self.at] if self.at < len(self.tokens) else None
        if t is not None and t.kind in ("word", "quoted"):
            return self.name(), True
        self.anon += 1
        return f"__anon_{what}_{self.anon}", False

    def _names(self) -> list[str]:
        out = []
        if self.take(":"):
            out = [self.name()]
            while self.take("|"):
                self.take(":")
                out.append(self.name())
        return out

    def node(self) -> NodePattern:
        self.need("(")
        alias, named = self._alias("node")
        labels, props = self._names(), {}
        if self.take("{"):
            while not self.take("}"):
                key = self.name()
                self.need(":")
                value = self.operand()
                if value[0] != "lit":
                    raise CypherError("inline properties are literals")
                props[key] = value[1]
                if not self.peek("}"):
                    self.need(",")
        self.need(")")
        return NodePattern(alias, labels, props, named)

    def edge(self) -> EdgePattern:
        inbound = self.take("<-")
        if not inbound:
            self.need("-")
        self.need("[")
        alias, named = self._alias("edge")
        kinds, hops = self._names(), None
        if self.take("*"):
            hops = self._hops()
        self.need("]")
        if self.take("->"):
            if inbound:
                raise CypherError("an edge points one way")
            direction = "out"
        else:
            self.need("-")
            direction = "in" if inbound else "both"
        return EdgePattern(alias, kinds, direction, hops, named)

    def _int(self) -> int | None:
        t = self.tokens[self.at] if self.at < len(self.tokens) else None
        if t is not None and t.kind == "int":
            self.at += 1
            return t.value
        return None

    def _hops(self) -> tuple[int, int]:
        low = self._int()
        if self.take(".."):
            high, low = self._int(), 1 if low is None else low
        else:
            high, low = low, 1 if low is None else low
        high = MAX_HOPS if high is None else high
        if low > MAX_HOPS or high > MAX_HOPS:
            self.warnings.append(f"hop bounds were clamped to {MAX_HOPS}")
            low, high = min(low, MAX_HOPS), min(high, MAX_HOPS)
        if high < low:
            raise CypherError("the upper hop bound is below the lower one")
        return low, high

    # -- expressions
    def expression(self) -> tuple:
        return self._binary("or", lambda: self._binary("xor", lambda: self._binary("and", self._not)))

    def _binary(self, word, below) -> tuple:
        left = below()
        while self.take(word):
            left = (word, left, below())
        return left

    def _not(self) -> tuple:
        if self.peek("not", "exists"):
            self.at += 1
            return "exists", self._exists(), True
        if self.take("not"):
            return "not", self._not()
        return self.predicate()

    def _exists(self) -> Chain:
        self.need("exists")
        self.need("{")
        chain = self.chain()
        self.need("}")
        return chain

    def predicate(self) -> tuple:
        if self.peek("exists"):
            return "exists", self._exists(), False
        if self.take("("):
            inner = self.expression()
            self.need(")")
            return inner
        left = self.operand()
        if left[0] == "ref" and self.peek(":"):
            return "label", left, self._names()
        if self.take("is"):
            negated = self.take("not")
            self.need("null")
            return "null", left, negated
        negated = self.take("not")
        if self.take("in"):
            items = self.operand()
            if items[0] != "list":
                raise CypherError("IN needs a list literal")
            return "in", left, items[1], negated
        if negated:
            raise CypherError("expected IN after NOT")
        for words, op in ((("starts", "with"), "starts"), (("ends", "with"), "ends"), (("contains",), "contains")):
            if self.take(*words):
                return "cmp", op, left, self.operand()
        for op in ("=~", "<>", "!=", "<=", ">=", "=", "<", ">"):
            if self.take(op):
                return "cmp", "<>" if op == "!=" else op, left, self.operand()
        raise CypherError("expected a comparison")

    def type_ref(self) -> tuple | None:
        if self.peek("type", "("):
            self.at += 2
            ref = self.reference()
            self.need(")")
            return "fn", "type", [ref]
        return None

    def reference(self) -> tuple:
        parts = [self.name()]
        while self.take("."):
            parts.append(self.name())
        return "ref", parts

    def operand(self, aggregates: bool = False) -> tuple:
        t = self.tokens[self.at] if self.at < len(self.tokens) else None
        if t is None:
            raise CypherError("expected a value, found the end")
        if t.kind in ("string", "int", "float"):
            self.at += 1
            return "lit", t.value
        if self.take("-"):
            kind, value = self.operand()[:2]
            if kind != "lit" or isinstance(value, bool) or not isinstance(value, int | float):
                raise CypherError("minus needs a number")
            return "lit", -value
        if self.take("["):
            items = []
            while not self.take("]"):
                items.append(self.operand())
                if not self.peek("]"):
                    self.need(",")
            return "list", items
        if t.kind == "word" and t.text.lower() in ("true", "false", "null"):
            self.at += 1
            return "lit", {"true": True, "false": False, "null": None}[t.text.lower()]
        nxt = self.tokens[self.at + 1] if self.at + 1 < len(self.tokens) else None
        if t.kind == "word" and nxt is not None and nxt.text == "(" and nxt.kind == "sym":
            self.at += 2
            fn = t.text.lower()
            if fn in AGGREGATES:
                if not aggregates:
                    raise CypherError(f"{t.text} is not allowed here")
                distinct = self.take("distinct")
                if self.take("*"):
                    if fn != "count":
                        raise CypherError("only count takes *")
                    target = None
                else:
                    target = self.type_ref() or self.reference()
                self.need(")")
                return "agg", fn, distinct, target
            args = []
            while not self.take(")"):
                args.append(self.operand())
                if not self.peek(")"):
                    self.need(",")
            return "fn", t.text, args
        return self.reference()


def default_name(expr: tuple) -> str:
    kind = expr[0]
    if kind == "ref":
        return ".".join(expr[1])
    if kind == "fn":
        return f"{expr[1]}({', '.join(map(default_name, expr[2]))})"
    if kind == "agg":
        return f"{expr[1]}({'DISTINCT ' * expr[2]}{default_name(expr[3]) if expr[3] else '*'})"
    if kind == "lit":
        return str(expr[1])
    return "case" if kind == "case" else kind


def _is_union(tokens: list[Token], i: int) -> bool:
    """Whether token i is the keyword: a clause follows it, and it is no name after a point, colon, bar or AS."""
    t, after = tokens[i], tokens[i + 1] if i + 1 < len(tokens) else None
    if t.kind != "word" or t.text.lower() != "union" or after is None or after.kind != "word" or after.text.lower() not in ("all", "match", "unwind", "optional"):
        return False
    return i > 0 and not (tokens[i - 1].kind == "sym" and tokens[i - 1].text in ".:|") and tokens[i - 1].text.lower() != "as"


def parse_query(text: str) -> tuple[list[Query], list[bool]]:
    """The branches, and for each UNION between them whether it is UNION ALL."""
    tokens, branches, alls, start = lex(text), [], [], 0
    for i, t in enumerate([*tokens, None]):
        if t is None or _is_union(tokens, i):
            own = tokens[start:i]
            if branches and own and own[0].kind == "word" and own[0].text.lower() == "all":
                own, alls[-1] = own[1:], True
            branches.append(Parser(own).query())
            alls.append(False)
            start = i + 1
    if len(branches) > MAX_BRANCHES:
        raise CypherError("too many UNION branches")
    return branches, alls[:-1]
