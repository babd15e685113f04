"""A subset of Cypher, compiled to DataFrames.

MATCH, OPTIONAL MATCH, WHERE, WITH, UNWIND, RETURN, ORDER BY, SKIP, LIMIT;
chains of labelled nodes and typed, directed, undirected or variable-length
relationships; EXISTS and NOT EXISTS of patterns as conjuncts; aggregates with
implicit groups; the scalar functions below. A variable is a column: nodes and
relationships are structs of their rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.patterns import walks
from ..sources.folders import shared_root

_TOKEN = re.compile(r"""\s+|//[^\n]*|(?P<num>\d+\.\d+|\d+(?!\.\d))|(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<param>\$\w+)|(?P<name>[A-Za-z_]\w*|`[^`]+`)|(?P<op><>|<=|>=|=~|\.\.|<-|->|[-+*/%=<>(){}\[\],.:|^])""")
_AGGREGATES = {"count", "sum", "avg", "min", "max", "collect"}


class CypherError(ValueError):
    pass


@dataclass
class Node:
    var: str
    labels: tuple = ()
    props: dict = field(default_factory=dict)


@dataclass
class Rel:
    var: str
    types: tuple
    direction: str
    hops: tuple | None = None


class Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise CypherError(f"can't read {text[at : at + 20]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m.group().strip("`")))
            at = m.end()
        self.i, self.fresh = 0, 0

    def peek(self, k: int = 0) -> str:
        return self.tokens[self.i + k][1] if self.i + k < len(self.tokens) else ""

    def word(self, *words) -> bool:
        """Takes the words if they follow."""
        if all(self.peek(k).upper() == w for k, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def op(self, x: str) -> bool:
        if self.peek() == x:
            self.i += 1
            return True
        return False

    def need(self, x: str):
        if not self.op(x):
            raise CypherError(f"{x!r} is missing before {self.peek()!r}")

    def name(self) -> str:
        kind, x = self.tokens[self.i] if self.i < len(self.tokens) else ("", "")
        if kind != "name":
            raise CypherError(f"a name is missing before {x!r}")
        self.i += 1
        return x

    def hidden(self) -> str:
        self.fresh += 1
        return f"__{self.fresh}"

    # ---- patterns
    def node(self) -> Node:
        self.need("(")
        n = Node(self.name() if self.tokens[self.i][0] == "name" else self.hidden())
        if self.op(":"):
            n.labels = tuple(self.alternatives())
        if self.peek() == "{":
            n.props = self.map()
        self.need(")")
        return n

    def alternatives(self) -> list[str]:
        out = [self.name()]
        while self.op("|") or self.op(":"):
            self.op(":")
            out.append(self.name())
        return out

    def map(self) -> dict:
        self.need("{")
        out = {}
        while not self.op("}"):
            k = self.name()
            self.need(":")
            out[k] = self.expression()
            self.op(",")
        return out

    def rel(self) -> Rel:
        left = self.op("<-")
        if not left:
            self.need("-")
        r = Rel(self.hidden(), (), "out")
        if self.op("["):
            if self.tokens[self.i][0] == "name":
                r.var = self.name()
            if self.op(":"):
                r.types = tuple(self.alternatives())
            if self.op("*"):
                low = int(self.name_or_number()) if self.tokens[self.i][0] == "num" else 1
                high = low if self.tokens[self.i - 1][0] == "num" else None
                if self.op(".."):
                    high = int(self.name_or_number()) if self.tokens[self.i][0] == "num" else None  # goes on until no walk is new
                r.hops = (low, high)
            self.need("]")
        right = self.op("->")
        if not right:
            self.need("-")
        r.direction = "in" if left else "out" if right else "any"
        return r

    def name_or_number(self) -> str:
        self.i += 1
        return self.tokens[self.i - 1][1]

    def chain(self) -> list:
        out = [self.node()]
        while self.peek() in ("-", "<-"):
            out += [self.rel(), self.node()]
        return out

    def is_pattern(self) -> bool:
        """Whether a pattern with a relationship begins here."""
        i = self.i
        try:
            return len(self.chain()) > 1
        except (CypherError, IndexError):
            return False
        finally:
            self.i = i

    # ---- expressions, as tuples
    def expression(self):
        x = self.conjunction()
        while self.word("OR"):
            x = ("or", x, self.conjunction())
        return x

    def conjunction(self):
        x = self.negation()
        while self.word("AND"):
            x = ("and", x, self.negation())
        return x

    def negation(self):
        return ("not", self.negation()) if self.word("NOT") else self.comparison()

    def comparison(self):
        x = self.sum()
        while True:
            if self.peek() in ("=", "<>", "<", ">", "<=", ">=", "=~"):
                self.i += 1
                x = (self.tokens[self.i - 1][1], x, self.sum())
            elif self.word("CONTAINS"):
                x = ("contains", x, self.sum())
            elif self.word("STARTS", "WITH"):
                x = ("starts", x, self.sum())
            elif self.word("ENDS", "WITH"):
                x = ("ends", x, self.sum())
            elif self.word("IN"):
                x = ("in", x, self.sum())
            elif self.word("IS", "NOT", "NULL"):
                x = ("not", ("null", x))
            elif self.word("IS", "NULL"):
                x = ("null", x)
            else:
                return x

    def sum(self):
        x = self.product()
        while self.peek() in ("+", "-"):
            self.i += 1
            x = (self.tokens[self.i - 1][1], x, self.product())
        return x

    def product(self):
        x = self.unary()
        while self.peek() in ("*", "/", "%"):
            self.i += 1
            x = (self.tokens[self.i - 1][1], x, self.unary())
        return x

    def unary(self):
        return ("neg", self.unary()) if self.op("-") else self.postfix()

    def postfix(self):
        x = self.primary()
        while True:
            if self.op("."):
                x = ("get", x, self.name())
            elif self.peek() == "[":
                self.i += 1
                low = None if self.peek() == ".." else self.expression()
                if self.op(".."):
                    high = None if self.peek() == "]" else self.expression()
                    x = ("slice", x, low, high)
                else:
                    x = ("index", x, low)
                self.need("]")
            elif self.peek() == ":" and x[0] == "var":
                self.i += 1
                x = ("is", x, self.alternatives())
            else:
                return x

    def primary(self):
        kind, t = self.tokens[self.i] if self.i < len(self.tokens) else ("", "")
        up = t.upper()
        if kind == "num":
            self.i += 1
            return ("lit", float(t) if "." in t else int(t))
        if kind == "str":
            self.i += 1
            return ("lit", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), t[1:-1]))
        if kind == "param":
            self.i += 1
            return ("param", t[1:])
        if t == "(" and self.is_pattern():
            return ("pattern", self.chain())
        if self.op("("):
            x = self.expression()
            self.need(")")
            return x
        if self.op("["):
            out = []
            while not self.op("]"):
                out.append(self.expression())
                self.op(",")
            return ("list", out)
        if t == "{":
            return ("map", self.map())
        if up in ("TRUE", "FALSE", "NULL"):
            self.i += 1
            return ("lit", {"TRUE": True, "FALSE": False, "NULL": None}[up])
        if up == "CASE":
            return self.case()
        if kind == "name" and self.peek(1) == "(":
            return self.call()
        return ("var", self.name())

    def case(self):
        self.i += 1
        base = None if self.peek().upper() == "WHEN" else self.expression()
        whens, other = [], None
        while self.word("WHEN"):
            c = self.expression()
            if not self.word("THEN"):
                raise CypherError("THEN is missing")
            whens.append((c if base is None else ("=", base, c), self.expression()))
        if self.word("ELSE"):
            other = self.expression()
        if not self.word("END"):
            raise CypherError("END is missing")
        return ("case", whens, other)

    def call(self):
        f = self.name().lower()
        self.need("(")
        if f in ("exists", "size") and self.is_pattern():
            x = ("pattern", self.chain()) if f == "exists" else ("size_of", self.chain())
            self.need(")")
            return x
        if f in ("any", "all", "none"):
            v = self.name()
            self.word("IN")
            xs = self.expression()
            self.word("WHERE")
            x = (f, v, xs, self.expression())
            self.need(")")
            return x
        if f == "reduce":
            acc = self.name()
            self.need("=")
            zero = self.expression()
            self.need(",")
            v = self.name()
            self.word("IN")
            xs = self.expression()
            self.need("|")
            x = ("reduce", acc, zero, v, xs, self.expression())
            self.need(")")
            return x
        if self.op("*"):
            self.need(")")
            return ("call", f, False, ["*"])
        distinct, args = self.word("DISTINCT"), []
        while not self.op(")"):
            args.append(self.expression())
            self.op(",")
        return ("call", f, distinct, args)


def _has_aggregate(x) -> bool:
    if isinstance(x, tuple):
        return x[:1] == ("call",) and x[1] in _AGGREGATES or any(map(_has_aggregate, x))
    return isinstance(x, (list, dict)) and any(map(_has_aggregate, x.values() if isinstance(x, dict) else x))


def _text(x) -> str:
    """A column's name where none is given."""
    if not isinstance(x, tuple):
        return str(x)
    if x[0] == "get":
        return f"{_text(x[1])}.{x[2]}"
    if x[0] in ("var", "lit"):
        return str(x[1])
    if x[0] == "call":
        return f"{x[1]}({'DISTINCT ' if x[2] else ''}{', '.join(map(_text, x[3]))})"
    return "expr"


class Compiler:
    def __init__(self, g, params: dict):
        self.g, self.params = g, params
        # maps can't be compared or grouped
        self.plain = lambda df: df.withColumn("props", F.to_json("props")) if "props" in df.columns else df
        self.node_columns, self.edge_columns = g.columns()
        self.kinds: dict[str, str] = {}  # variables that are nodes, relationships or paths

    # ---- expressions
    def col(self, x, local: dict | None = None) -> Column:
        local = local or {}
        c = lambda y: self.col(y, local)
        op = x[0]
        if op == "lit":
            return F.lit(x[1])
        if op == "param":
            if x[1] not in self.params:
                raise CypherError(f"parameter {x[1]} is missing")
            return F.lit(self.params[x[1]])
        if op == "var":
            return local[x[1]] if x[1] in local else F.col(f"`{x[1]}`")
        if op == "get":
            return self.property(x, local)
        if op == "is":
            return c(x[1])["label"].isin(*x[2])
        if op in ("or", "and"):
            return c(x[1]) | c(x[2]) if op == "or" else c(x[1]) & c(x[2])
        if op == "not":
            return ~c(x[1])
        if op == "null":
            v = c(x[1])
            return v["id"].isNull() if x[1][0] == "var" and self.kinds.get(x[1][1]) in ("node", "rel") else v.isNull()
        if op == "neg":
            return -c(x[1])
        if op in ("=", "<>"):
            a, b = (self.identity(y, local) for y in x[1:3])
            return a == b if op == "=" else a != b
        binary = {
            "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "contains": F.contains, "starts": F.startswith, "ends": F.endswith,
            "=~": lambda a, b: F.rlike(a, F.concat(F.lit("^(?:"), b, F.lit(")$"))), "-": lambda a, b: a - b, "*": lambda a, b: a * b, "%": lambda a, b: a % b, "/": F.try_divide,
        }
        if op == "+":
            text = any(isinstance(y, tuple) and y[0] == "lit" and isinstance(y[1], str) for y in self.leaves(x))
            return F.concat(c(x[1]), c(x[2])) if text else c(x[1]) + c(x[2])
        if op in binary:
            return binary[op](c(x[1]), c(x[2]))
        if op == "in":
            return c(x[1]).isin(*[c(y) for y in x[2][1]]) if x[2][0] == "list" else F.array_contains(c(x[2]), c(x[1]))
        if op == "list":
            return F.array(*map(c, x[1]))
        if op == "map":
            return F.struct(*[c(v).alias(k) for k, v in x[1].items()])
        if op == "index":
            return F.get(c(x[1]), c(x[2])) if not (x[2][0] == "neg") else F.element_at(c(x[1]), c(x[2]))
        if op == "slice":
            xs = c(x[1])
            low = c(x[2]) if x[2] else F.lit(0)
            high = F.size(xs) if x[3] is None else F.size(xs) + c(x[3]) if x[3][0] == "neg" else c(x[3])
            return F.slice(xs, (low + 1).cast("int"), F.greatest(F.lit(0), F.least(high, F.size(xs)) - low).cast("int"))
        if op == "case":
            out = None
            for cond, v in x[1]:
                out = F.when(c(cond), c(v)) if out is None else out.when(c(cond), c(v))
            return out.otherwise(c(x[2])) if x[2] is not None else out
        if op in ("any", "all", "none"):
            f = lambda e: self.col(x[3], local | {x[1]: e})
            return F.exists(c(x[2]), f) if op == "any" else F.forall(c(x[2]), f) if op == "all" else ~F.exists(c(x[2]), f)
        if op == "reduce":
            return F.aggregate(c(x[4]), c(x[2]), lambda a, e: self.col(x[5], local | {x[1]: a, x[3]: e}))
        if op == "call":
            return self.function(x, local)
        raise CypherError(f"{op} isn't supported here")

    def leaves(self, x):
        yield x
        if x[0] == "+":
            yield from self.leaves(x[1])
            yield from self.leaves(x[2])

    def identity(self, x, local):
        v = self.col(x, local)
        return v["id"] if x[0] == "var" and self.kinds.get(x[1]) == "node" else v

    def property(self, x, local) -> Column:
        owner, name = self.col(x[1], local), x[2]
        kind = self.kinds.get(x[1][1]) if x[1][0] == "var" else None
        if kind is None:
            return owner[name]
        columns = self.node_columns if kind == "node" else self.edge_columns
        if kind == "node" and name == "path" and "path" not in columns:
            return owner["file_path"]
        return owner[name] if name in columns else F.get_json_object(owner["props"], f"$.{name}")

    def function(self, x, local) -> Column:
        _, f, distinct, args = x
        if f == "count":
            if args == ["*"]:
                return F.count(F.lit(1))
            v = self.col(args[0], local)
            v = v["id"] if args[0][0] == "var" and self.kinds.get(args[0][1]) in ("node",) else v
            return F.count_distinct(v) if distinct else F.count(v)
        a = [self.col(y, local) for y in args]
        if f == "collect":
            return F.array_sort(F.collect_set(a[0]) if distinct else F.collect_list(a[0]))
        simple = {
            "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "coalesce": F.coalesce, "tolower": F.lower, "lower": F.lower, "toupper": F.upper, "upper": F.upper, "trim": F.trim, "abs": F.abs,
            "replace": F.replace, "split": lambda s, d: F.split(s, d), "substring": lambda s, i, n=None: F.substr(s, i + 1, n) if n is not None else F.substr(s, i + 1), "reverse": F.reverse,
            "tostring": lambda v: v.cast("string"), "tointeger": lambda v: v.try_cast("bigint"), "tofloat": lambda v: v.try_cast("double"), "floor": F.floor, "ceil": F.ceil, "datetime": F.current_timestamp,
        }
        if f in simple:
            if distinct and f in ("sum", "avg"):
                return (F.sum_distinct if f == "sum" else lambda v: F.expr("avg(distinct x)"))(a[0])
            return simple[f](*a)
        if f == "round":
            return F.round(a[0].cast("double"), args[1][1] if len(args) > 1 else 0)
        if f in ("size", "length"):
            return F.size(a[0]) if self.is_list(args[0]) else F.length(a[0])
        if f == "labels":
            return F.array(a[0]["label"])
        if f in ("label", "type", "id"):
            return a[0][f]
        if f == "exists":
            return a[0].isNotNull()
        if f == "nodes":
            return a[0]
        if f == "duration":
            days = re.fullmatch(r"P(\d+)D", args[0][1])
            if not days:
                raise CypherError("durations are in days")
            return F.make_dt_interval(F.lit(int(days[1])))
        raise CypherError(f"function {f} isn't supported")

    def is_list(self, x) -> bool:
        return x[0] in ("list", "slice") or x[0] == "call" and x[1] in ("collect", "split", "labels", "nodes") or x[0] == "var" and self.kinds.get(x[1]) in ("list", "path") or x[0] == "get" and x[2] == "decorators"

    # ---- patterns
    def node_frame(self, n: Node) -> DataFrame:
        df = self.plain(self.g.scan(*n.labels))
        for k, v in n.props.items():
            name = "file_path" if k == "path" and "path" not in self.node_columns else k
            df = df.where(F.col(name) == self.col(v) if name in self.node_columns else F.get_json_object("props", f"$.{k}") == self.col(v))
        self.kinds[n.var] = "node"
        return df.select(F.struct(*self.node_columns).alias(n.var))

    def pattern(self, chain: list, path: str | None = None) -> DataFrame:
        df = self.node_frame(chain[0])
        here, seen = chain[0].var, {chain[0].var}
        for r, n in zip(chain[1::2], chain[2::2]):
            e = self.plain(self.g.edges_of(*r.types))
            ends = {"src_id": "dst_id", "dst_id": "src_id", "src_label": "dst_label", "dst_label": "src_label"}
            turned = e.select(*[F.col(ends.get(c, c)).alias(c) for c in e.columns])
            e = {"out": lambda: e, "in": lambda: turned, "any": lambda: e.unionByName(turned)}[r.direction]()
            if r.hops:
                if r.hops[1] is None:
                    shared_root(e.sparkSession)
                e = walks(e.select("src_id", "dst_id").distinct(), *r.hops)
                self.kinds[r.var] = "path"
                e = e.select(F.col("src_id").alias("_s"), F.col("dst_id").alias("_d"), F.col("path").alias(r.var))
            else:
                self.kinds[r.var] = "rel"
                e = e.select(F.col("src_id").alias("_s"), F.col("dst_id").alias("_d"), F.struct(*e.columns).alias(r.var))
            df = df.join(e, F.col(here)["id"] == F.col("_s")).drop("_s")
            if n.var in seen:
                df = df.where(F.col(n.var)["id"] == F.col("_d")).drop("_d")
            else:
                df = df.join(self.node_frame(n), F.col("_d") == F.col(n.var)["id"]).drop("_d")
            here = n.var
            seen.add(n.var)
        if path:
            rels = [r for r in chain[1::2]]
            ids = F.array(F.col(chain[0].var)["id"])
            for r, n in zip(rels, chain[2::2]):
                ids = F.concat(ids, F.slice(F.col(r.var), F.lit(2), F.size(r.var) - 1) if r.hops else F.array(F.col(n.var)["id"]))
            df = df.withColumn(path, ids)
            self.kinds[path] = "path"
        return df

    def shared(self, df: DataFrame | None, pat: DataFrame) -> list[str]:
        return [c for c in pat.columns if df is not None and c in df.columns]

    def combine(self, df, pat, how="inner", where=None):
        """pat joined to df by the variables that they share; none: every pair, as the query says."""
        both = self.shared(df, pat)
        if df is None:
            return pat if where is None else pat.where(self.col(where))
        pat = pat.select(*[F.col(c).alias(f"_p_{c}") if c in both else F.col(c) for c in pat.columns])
        cond = reduce(lambda a, b: a & b, [F.col(c)["id"] == F.col(f"_p_{c}")["id"] for c in both], F.lit(True))
        if where is not None:
            cond = cond & self.col(where)
        out = df.join(pat, cond, how) if both or where is not None or how == "left" else df.crossJoin(pat)
        return out.drop(*[f"_p_{c}" for c in both])

    def where(self, df: DataFrame, x) -> DataFrame:
        """Conjuncts one by one: patterns as semi and anti joins, sizes of patterns as counts, the rest as filters."""
        if x[0] == "and":
            return self.where(self.where(df, x[1]), x[2])
        negated, y = (True, x[1]) if x[0] == "not" else (False, x)
        if y[0] == "pattern":
            pat = self.pattern(y[1])
            both = self.shared(df, pat)
            pat = pat.select(*[F.col(c)["id"].alias(f"_p_{c}") for c in both]).distinct()
            cond = reduce(lambda a, b: a & b, [F.col(c)["id"] == F.col(f"_p_{c}") for c in both], F.lit(True))
            return df.join(pat, cond, "left_anti" if negated else "left_semi")
        return df.where(self.col(x))

    def sizes(self, df: DataFrame, x) -> tuple[DataFrame, object]:
        """size() of patterns inside an expression, as columns counted beforehand."""
        if isinstance(x, tuple):
            if x[0] == "size_of":
                pat = self.pattern(x[1])
                key = self.shared(df, pat)[0]
                name = f"_n{len(df.columns)}"
                n = pat.groupBy(F.col(key)["id"].alias("_k")).agg(F.count(F.lit(1)).alias(name))
                return df.join(n, F.col(key)["id"] == F.col("_k"), "left").drop("_k").fillna(0, [name]), ("var", name)
            out = []
            for y in x:
                df, y = self.sizes(df, y)
                out.append(y)
            return df, tuple(out)
        return df, x

    def project(self, df: DataFrame | None, items: list, distinct: bool) -> DataFrame:
        if df is None:
            df = self.g.spark.range(1).select()
        if items == ["*"]:
            out = df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("_")])
            return out.distinct() if distinct else out
        made = []
        for x, name in items:
            df, x = self.sizes(df, x)
            made.append((x, name))
        kinds = {name: self.kinds.get(x[1]) if x[0] == "var" else "list" if self.is_list(x) else None for x, name in made}
        if any(_has_aggregate(x) for x, _ in made):
            keys = [self.col(x).alias(n) for x, n in made if not _has_aggregate(x)]
            aggs = [self.col(x).alias(n) for x, n in made if _has_aggregate(x)]
            df = df.groupBy(*keys).agg(*aggs).select(*[F.col(f"`{n}`") for _, n in made])
        else:
            df = df.select(*[self.col(x).alias(n) for x, n in made])
        self.kinds = {k: v for k, v in kinds.items() if v}
        return df.distinct() if distinct else df


def run(g, query: str, params: dict | None = None) -> DataFrame:
    p = Parser(query.strip().rstrip(";"))
    c = Compiler(g, params or {})
    df: DataFrame | None = None
    while p.i < len(p.tokens):
        optional = p.word("OPTIONAL")
        if p.word("MATCH"):
            pats = []
            while True:
                path = None
                if p.peek(1) == "=" and p.tokens[p.i][0] == "name":
                    path = p.name()
                    p.need("=")
                pats.append(c.pattern(p.chain(), path))
                if not p.op(","):
                    break
            where = p.expression() if p.word("WHERE") else None
            if optional:
                pat = reduce(c.combine, pats)
                df = c.combine(df, pat, "left", where) if df is not None else pat
            else:
                for pat in pats:
                    df = c.combine(df, pat)
                if where is not None:
                    df = c.where(df, where)
        elif p.word("UNWIND"):
            x = p.expression()
            p.word("AS")
            name = p.name()
            df = (df if df is not None else g.spark.range(1)).withColumn(name, F.explode(c.col(x)))
        elif p.word("WITH") or p.word("RETURN"):
            distinct = p.word("DISTINCT")
            items: list = []
            if p.op("*"):
                items = ["*"]
            else:
                while True:
                    x = p.expression()
                    items.append((x, p.name() if p.word("AS") else _text(x)))
                    if not p.op(","):
                        break
            df = c.project(df, items, distinct)
            if p.word("ORDER", "BY"):
                order = []
                while True:
                    x = p.expression()
                    down = p.word("DESC") or p.word("DESCENDING")
                    if not down:
                        p.word("ASC") or p.word("ASCENDING")
                    same = next((n for y, n in items if y == x), None) if items != ["*"] else None
                    order.append((F.col(f"`{same}`") if same else c.col(x), down))
                    if not p.op(","):
                        break
                df = df.orderBy(*[k.desc() if down else k.asc() for k, down in order])
            if p.word("SKIP"):
                df = df.offset(int(p.name_or_number()))
            if p.word("LIMIT"):
                df = df.limit(int(p.name_or_number()))
            if p.word("WHERE"):
                df = c.where(df, p.expression())
        else:
            raise CypherError(f"a clause is missing before {p.peek()!r}")
    if df is None:
        raise CypherError("the query is empty")
    return df
