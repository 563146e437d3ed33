"""The engine's SQL dialect, rewritten into Spark SQL.

What differs from Spark: `^` is power; `||` and concat skip NULLs; a fractional
number is a double; NULLs sort as the largest values; UNION, INTERSECT and
EXCEPT keep repeats; IF gives NULL on a NULL test; first and last skip NULLs;
array_agg keeps them; average and product are known; map and named_struct take
all keys, then all values; CASE k WHEN takes lists and comparisons; a window may
refine a named one; the column list of a CTE may be short; ORDER BY may use
aggregates and window functions that aren't selected; U&'...' literals, quoted
names and the type names of tessera.types are understood; product and array_agg
serve over windows; registered functions can be called; set operations want
equal column names. What depends on types is settled where the block's tables
are known: / of two integers is the quotient in the wider type, length counts
elements too, CAST of a string to BOOLEAN knows yes, no, on, off and the like,
numbers serve as conditions of CASE, and a product of integers is in their type, or
in a wider one to which it is cast right away. Where a type can't be told (in a correlated
subquery), these mean what they mean in Spark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import DialectError, SchemaMismatch
from tessera.functions.aggregates import WIDE, product_type
from tessera.functions.scalar import FALSE_STRINGS, TRUE_STRINGS
from tessera.functions.typed import Typed
from tessera.plans.tokens import Token, closing, opening, split, text_of, tokens, top_level
from tessera.types import parse_type

WORDS = frozenset(
    "and or not when then else end case select distinct from where on by in is as having limit union intersect except all order group join inner left right full outer cross "
    "over partition rows range between window with asc desc nulls like rlike cast".split()
)
SETS = frozenset({"union", "intersect", "except"})
COMPARISONS = frozenset({"=", "<>", "!=", "<", ">", "<=", ">=", "<=>", "=="})
CLAUSES = frozenset({"where", "group", "having", "window", "order", "limit"}) | SETS
AGGREGATES = frozenset("count max min sum avg average product first first_value last last_value bool_and bool_or array_agg".split())


def word(text: str) -> Token:
    return Token("word", text)


def op(text: str) -> Token:
    return Token("op", text)


def call(name: str, *args: list[Token]) -> list[Token]:
    out = [word(name), op("(")]
    for i, a in enumerate(args):
        out += [op(",")] * bool(i) + a
    return [*out, op(")")]


# Expressions


def _literals(ts: list[Token]) -> list[Token]:
    plain = lambda t: t.kind == "number" and "." in t.text and not t.text[-1].isalpha() and "e" not in t.text.lower()
    return [Token("number", t.text + "D") if plain(t) else t for t in ts]


def _bags(ts: list[Token]) -> list[Token]:
    out = []
    for i, t in enumerate(ts):
        out.append(t)
        if t.low in SETS and (i + 1 == len(ts) or ts[i + 1].low not in ("all", "distinct")):
            out.append(word("ALL"))
    return out


def _function(name: str, args: list[list[Token]], over: list[Token]) -> list[Token] | None:
    """The rewritten call with its window, or None to keep it. Names that start with __ wait for the types of their arguments."""
    distinct = bool(args) and bool(args[0]) and args[0][0].low == "distinct"
    if name == "length" and len(args) == 1:
        return call("__length", args[0])
    if name == "average":
        return call("avg", *args) + over
    if name in ("first", "first_value", "last", "last_value") and len(args) == 1:
        return call(name.removesuffix("_value"), args[0], [word("true")]) + over
    if name == "concat":
        return call("concat_ws", [Token("string", "''")], *args)
    if name == "array_agg" and not distinct:
        kept = call("collect_list", call("named_struct", [Token("string", "'v'")], args[0])) + over
        return call("transform", kept, [word("s"), op("->"), word("s"), op("."), word("v")])
    if name == "product" and len(args) == 1:
        return call("__product", args[0], [word("null")], *([over] if over else []))
    if name == "if" and len(args) == 3:
        test = [op("("), *args[0], op(")")]
        return [op("("), word("CASE"), word("WHEN"), *test, word("IS"), word("NULL"), word("THEN"), word("NULL"), word("WHEN"), *test, word("THEN"), *args[1], word("ELSE"), *args[2], word("END"), op(")")]
    if name in ("map", "named_struct") and len(args) % 2 == 0 and args:
        half = len(args) // 2
        if name == "map":
            return call("map_from_arrays", call("array", *args[:half]), call("array", *args[half:]))
        return call(name, *[a for pair in zip(args[:half], args[half:], strict=True) for a in pair])
    return None


def _registered(build: Callable, args: list[list[Token]]) -> list[Token]:
    made = build(*[F.expr(text_of(a)) for a in args])
    if isinstance(made, Typed) or not isinstance(made, Column):
        raise DialectError("a registered function that depends on types can't be called in SQL")
    ts = tokens(made._jc.node().sql())
    # Spark shows an operator as a function of that name: +(a, b).
    first = lambda i: i == 0 or ts[i - 1].low in ("(", ",")
    prefix = lambda i, t: first(i) and i + 1 < len(ts) and ts[i + 1].low == "(" and (t.kind == "op" and t.text not in "()," or t.low in ("and", "or", "not"))
    return [op("("), *[Token("quoted", f"`{t.text}`") if prefix(i, t) else t for i, t in enumerate(ts)], op(")")]


def _over(ts: list[Token], at: int) -> int:
    """Where an OVER clause that starts at `at` stops; `at` if there is none."""
    if at >= len(ts) or ts[at].low != "over":
        return at
    return closing(ts, at + 1) + 1 if ts[at + 1].low == "(" else at + 2


def _product_for(ts: list[Token], kind: T.DataType) -> list[Token]:
    """A value to be cast to `kind`: if it is a product, it learns the type in which it is wanted."""
    inner = ts
    while inner and inner[0].low == "(" and closing(inner, 0) == len(inner) - 1:
        inner = inner[1:-1]
    if len(inner) < 2 or inner[0].low != "__product" or closing(inner, 1) != len(inner) - 1 or not isinstance(kind, WIDE):
        return ts
    x, _, *over = split(inner[2:-1])
    return call("__product", x, [word(kind.simpleString())], *over)


def _calls(ts: list[Token], added: dict[str, Callable]) -> list[Token]:
    out, i = [], 0
    while i < len(ts):
        if ts[i].kind == "word" and i + 1 < len(ts) and ts[i + 1].low == "(" and ts[i].low not in WORDS - {"cast"}:
            end = closing(ts, i + 1)
            inner = ts[i + 2 : end]
            if ts[i].low == "cast":
                at = next((k for k, t in top_level(inner) if t.low == "as"), None)
                if at is None:
                    raise DialectError("CAST without AS")
                kind, value = parse_type(text_of(inner[at + 1 :])), _calls(inner[:at], added)
                out += call("__bool", value) if isinstance(kind, T.BooleanType) else [*ts[i : i + 2], *_product_for(value, kind), word("AS"), word(kind.simpleString()), op(")")]
            else:
                args = [_calls(a, added) for a in split(inner)]
                if ts[i].low in added:
                    out += _registered(added[ts[i].low], args)
                else:
                    stop = _over(ts, end + 1)
                    made = _function(ts[i].low, args, _calls(ts[end + 1 : stop], added))
                    if made and ts[i].low in ("product", "array_agg", "average", "first", "first_value", "last", "last_value"):
                        end = stop - 1
                    out += made or [ts[i], op("("), *[t for k, a in enumerate(args) for t in [op(",")] * bool(k) + a], op(")")]
            i = end + 1
        else:
            out.append(ts[i])
            i += 1
    return out


def _cases(ts: list[Token]) -> list[Token]:
    out, i = [], 0
    while i < len(ts):
        if ts[i].low != "case":
            out.append(ts[i])
            i += 1
            continue
        depth, end = 0, i
        while True:
            depth += (ts[end].low == "case") - (ts[end].low == "end")
            if not depth:
                break
            end += 1
            if end == len(ts):
                raise DialectError("CASE without END")
        inner = _cases(ts[i + 1 : end])
        marks = [(k, t.low) for k, t in top_level(inner) if t.low in ("when", "then", "else")]
        key = inner[: marks[0][0]] if marks else inner
        out.append(ts[i])
        for (k, kind), (stop, _) in zip(marks, [*marks[1:], (len(inner), "")], strict=True):
            part = inner[k + 1 : stop]
            if kind == "when" and key:
                tests = [[op("("), *key, *([] if v[0].low in COMPARISONS else [op("=")]), *v, op(")")] for v in split(part)]
                part = [t for n, test in enumerate(tests) for t in [word("OR")] * bool(n) + test]
            elif kind == "when" and len(part) == 1 and part[0].kind == "number":  # a number as a condition
                part = [*call("CAST", [*part, word("AS"), word("BOOLEAN")])]
            out += [inner[k], *part]
        out.append(ts[end])
        i = end + 1
    return out


def _starts(ts: list[Token], last: int) -> int:
    """Where the primary expression that ends at `last` starts, its sign included."""
    at = last
    if ts[at].low == ")":
        at = opening(ts, at)
        if at and ts[at - 1].kind == "word" and ts[at - 1].low not in WORDS - {"cast"}:
            at -= 1
    while at >= 2 and ts[at - 1].low == ".":
        at -= 2
    while at and ts[at - 1].low in ("-", "+") and (at == 1 or ts[at - 2].kind == "op" and ts[at - 2].low != ")" or ts[at - 2].low in WORDS):
        at -= 1
    return at


def _stops(ts: list[Token], first: int) -> int:
    """Where the primary expression that starts at `first`, perhaps with a sign, stops (the place after)."""
    at = first
    while ts[at].low in ("-", "+"):
        at += 1
    if ts[at].low == "(":
        return closing(ts, at) + 1
    while at + 2 < len(ts) and ts[at + 1].low == ".":
        at += 2
    if at + 1 < len(ts) and ts[at].kind == "word" and ts[at + 1].low == "(":
        return closing(ts, at + 1) + 1
    return at + 1


def _powers(ts: list[Token]) -> list[Token]:
    while (at := next((i for i, t in enumerate(ts) if t.low == "^"), None)) is not None:
        start, stop = _starts(ts, at - 1), _stops(ts, at + 1)
        ts = [*ts[:start], *call("power", ts[start:at], ts[at + 1 : stop]), *ts[stop:]]
    return ts


def _divisions(ts: list[Token]) -> list[Token]:
    """a / b as __div(a, b), from the left; a is all that multiplies and divides before."""

    def start_of(last: int) -> int:
        if ts[last].low == "end":
            depth, at = 1, last
            while depth and at:
                at -= 1
                depth += (ts[at].low == "end") - (ts[at].low == "case")
            return at
        at = _starts(ts, last)
        if at and ts[at - 1].low == "over":
            at = _starts(ts, at - 2)
        return at

    done = 0
    while (at := next((i for i, t in enumerate(ts) if i >= done and t.low == "/"), None)) is not None:
        start = start_of(at - 1)
        while start > 1 and ts[start - 1].low in ("*", "%"):
            start = start_of(start - 2)
        stop = _stops(ts, at + 1)
        stop = _over(ts, stop)
        if ts[at + 1].low == "case":
            done = at + 1
            continue
        ts = [*ts[:start], *call("__div", ts[start:at], ts[at + 1 : stop]), *ts[stop:]]
        done = start
    return ts


def _joined_strings(ts: list[Token]) -> list[Token]:
    ends = COMPARISONS | {",", "||"} | (WORDS - {"end", "case"})

    def reach(at: int, step: int) -> int:
        """The last place of the operand next to `at`."""
        at += step
        while 0 <= at < len(ts):
            low = ts[at].low
            if low in ("(", "case") and step < 0 or low in (")", "end") and step > 0 or low in ends:
                return at - step
            if low == (")" if step < 0 else "("):
                at = opening(ts, at) if step < 0 else closing(ts, at)
            elif low == ("end" if step < 0 else "case"):
                depth = 1
                while depth:
                    at += step
                    depth += step * ((ts[at].low == "case") - (ts[at].low == "end"))
            at += step
        return at - step

    while (at := next((i for i, t in enumerate(ts) if t.low == "||"), None)) is not None:
        start, parts = reach(at, -1), []
        stop = at - 1
        parts.append(ts[start : stop + 1])
        while stop + 1 < len(ts) and ts[stop + 1].low == "||":
            begin = stop + 2
            stop = reach(stop + 1, 1)
            parts.append(ts[begin : stop + 1])
        ts = [*ts[:start], *call("concat_ws", [Token("string", "''")], *parts), *ts[stop + 1 :]]
    return ts


def _null_order(ts: list[Token]) -> list[Token]:
    out, i = [], 0
    while i < len(ts):
        if not (ts[i].low == "order" and i + 1 < len(ts) and ts[i + 1].low == "by"):
            out.append(ts[i])
            i += 1
            continue
        stop, depth = i + 2, 0
        while stop < len(ts) and not (depth == 0 and (ts[stop].low == ")" or ts[stop].low in CLAUSES | {"rows", "range"})):
            depth += (ts[stop].low in ("(", "case")) - (ts[stop].low in (")", "end"))
            stop += 1
        out += ts[i : i + 2]
        for n, item in enumerate(split(ts[i + 2 : stop])):
            item = _null_order(item)
            if item[-1].low not in ("first", "last") or len(item) < 2 or item[-2].low != "nulls":
                item = [*item, word("NULLS"), word("FIRST" if item[-1].low == "desc" else "LAST")]
            out += [op(",")] * bool(n) + item
        i = stop
    return out


def expressions(ts: list[Token], added: dict[str, Callable] | None = None) -> list[Token]:
    return _null_order(_joined_strings(_divisions(_powers(_calls(_cases(_bags(_literals(ts))), added or {})))))


# Queries


def _windows(ts: list[Token]) -> list[Token]:
    """Inlines references to named windows that add something to them."""
    at = next((i for i, t in top_level(ts) if t.low == "window"), None)
    known: dict[str, list[Token]] = {}
    framed = lambda body: any(t.low in ("rows", "range") for _, t in top_level(body))

    def full(body: list[Token]) -> list[Token]:
        base = known.get(body[0].text.lower()) if body else None
        if base is None:
            return body
        if len(body) > 1 and framed(base):
            raise DialectError(f"window {body[0].text} has a frame already")
        return [*base, *body[1:]]

    head, tail = ts, []
    if at is not None:
        stop = next((i for i, t in top_level(ts, at + 1) if t.low in ("order", "limit")), len(ts))
        definitions = []
        for item in split(ts[at + 1 : stop]):
            if len(item) < 3 or item[1].low != "as":
                raise DialectError("WINDOW name AS (...) is expected")
            body = item[3:-1] if item[2].low == "(" else [item[2]]
            known[item[0].text.lower()] = full(body)
            definitions.append([*item[:2], op("("), *known[item[0].text.lower()], op(")")])
        head, tail = ts[:at], ts[stop:]
        head = [*head, word("WINDOW"), *[t for n, d in enumerate(definitions) for t in [op(",")] * bool(n) + d]]
    out, rest = [], [*head, *tail]
    i = 0
    while i < len(rest):
        if rest[i].low == "over" and i + 1 < len(rest) and rest[i + 1].low == "(":
            end = closing(rest, i + 1)
            out += [rest[i], op("("), *full(rest[i + 2 : end]), op(")")]
            i = end + 1
        else:
            out.append(rest[i])
            i += 1
    return out


#: Integral types from narrow to wide.
INTEGERS = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]


def _settled(name: str, args: list[list[Token]], kinds: list[T.DataType | None]) -> list[Token]:
    """A call that waited for the types of its arguments (None where one can't be told)."""
    if name == "__div":
        if all(k in INTEGERS for k in kinds):
            wide = INTEGERS[max(INTEGERS.index(k) for k in kinds)]
            return call("CAST", [op("("), *args[0], op(")"), word("DIV"), op("("), *args[1], op(")"), word("AS"), word(wide.simpleString())])
        return [op("("), op("("), *args[0], op(")"), op("/"), op("("), *args[1], op(")"), op(")")]
    if name == "__length":
        return call("size" if isinstance(kinds[0], (T.ArrayType, T.MapType)) else "length", args[0])
    if name == "__bool":
        if not isinstance(kinds[0], T.StringType):
            return call("CAST", [*args[0], word("AS"), word("BOOLEAN")])
        listed = lambda xs: [word("IN"), op("("), *[t for n, x in enumerate(xs) for t in [op(",")] * bool(n) + [Token("string", f"'{x}'")]], op(")")]
        lower = call("lower", args[0])
        return [op("("), word("CASE"), word("WHEN"), *lower, *listed(TRUE_STRINGS), word("THEN"), word("TRUE"), word("WHEN"), *lower, *listed(FALSE_STRINGS), word("THEN"), word("FALSE"), word("END"), op(")")]
    # product: of integers only factors other than -1, 0 and 1 are gathered, as tessera.functions.product does.
    x, into, over = args[0], args[1], args[2] if len(args) > 2 else []
    text, window = text_of(x), f" {text_of(over)}" if over else ""
    if kinds[0] in INTEGERS:
        kind = product_type(kinds[0], None if into[0].low == "null" else parse_type(text_of(into))).simpleString()
        zero = f"bool_or(({text}) = 0){window}"
        start = f"CAST(CASE WHEN {zero} THEN 0 WHEN count(CASE WHEN ({text}) = -1 THEN 1 END){window} % 2 = 1 THEN -1 ELSE 1 END AS {kind})"
        factors = f"CASE WHEN {zero} THEN array() ELSE collect_list(CASE WHEN ({text}) NOT IN (-1, 0, 1) THEN ({text}) END){window} END"
        return tokens(f"(CASE WHEN count({text}){window} > 0 THEN aggregate({factors}, {start}, (a, v) -> CAST(a * v AS {kind})) END)")
    return tokens(f"aggregate(collect_list({text}){window}, if(false, max({text}){window}, NULL), (a, v) -> coalesce(a * v, a, v))")


def _typed(spark: SparkSession, scope: list[Token], ts: list[Token]) -> list[Token]:
    """A SELECT block with the calls settled that depend on types."""
    waiting = ("__div", "__length", "__bool", "__product")
    if not any(t.low in waiting for t in ts):
        return ts
    clause = lambda name, stops: next((ts[i : next((j for j, u in top_level(ts, i + 1) if u.low in stops), len(ts))] for i, t in top_level(ts) if t.low == name), [])
    source, windows, groups = clause("from", CLAUSES), clause("window", {"order", "limit"}), clause("group", CLAUSES - {"group"})

    def kind(x: list[Token]) -> T.DataType | None:
        """The type of an expression of this block's tables; the condition of a join that waits itself is left out."""
        plain = source if not any(t.low in waiting for t in source) else None
        for extra in ([], groups):
            try:
                return spark.sql(text_of([*scope, word("SELECT"), *x, *(plain or []), *(extra if not any(t.low in waiting for t in extra) else []), *windows])).schema[0].dataType
            except AnalysisException:
                continue
        return None

    while (at := max((i for i, t in enumerate(ts) if t.low in waiting), default=None)) is not None:  # the last one holds no other
        end = closing(ts, at + 1)
        args = split(ts[at + 2 : end])
        name = ts[at].low
        ts = [*ts[:at], *_settled(name, args, [kind(a) for a in (args[:1] if name == "__product" else args)]), *ts[end + 1 :]]
        source, windows, groups = clause("from", CLAUSES), clause("window", {"order", "limit"}), clause("group", CLAUSES - {"group"})
    return ts


def _has_aggregate(ts: list[Token]) -> bool:
    rewritten = {"collect_list"} | AGGREGATES
    return any(t.low == "over" or t.low in rewritten and i + 1 < len(ts) and ts[i + 1].low == "(" for i, t in enumerate(ts))


def _hidden_order(spark: SparkSession, scope: list[Token], ts: list[Token]) -> list[Token]:
    """Moves sort keys with aggregates or window functions into an inner select list."""
    at = next((i for i, t in top_level(ts) if t.low == "order"), None)
    if at is None or not _has_aggregate(ts[at:]) or len(ts) < 2 or ts[1].low == "distinct":
        return ts
    stop = next((i for i, t in top_level(ts, at + 1) if t.low == "limit"), len(ts))
    source = next((i for i, t in top_level(ts) if t.low == "from"), None)
    if source is None:
        return ts
    names = spark.sql(text_of([*scope, *ts[:at]])).columns
    hidden, sorts = [], []
    for n, item in enumerate(split(ts[at + 2 : stop])):
        cut = len(item) - 2
        cut -= item[cut - 1].low in ("asc", "desc")
        hidden += [op(","), *item[:cut], word("AS"), word(f"__s{n}")]
        sorts += [op(",")] * bool(n) + [word(f"__s{n}"), *item[cut:]]
    quoted = [t for n, name in enumerate(names) for t in [op(",")] * bool(n) + [Token("quoted", f"`{name}`")]]
    inner = [*ts[:source], *hidden, *ts[source:at]]
    return [word("SELECT"), *quoted, word("FROM"), op("("), *inner, op(")"), word("ORDER"), word("BY"), *sorts, *ts[stop:]]


def _derived(spark: SparkSession, scope: list[Token], ts: list[Token]) -> list[Token]:
    out, i = [], 0
    while i < len(ts):
        if ts[i].low == "(" and i + 1 < len(ts):
            end = closing(ts, i)
            inner = ts[i + 1 : end]
            done = query(spark, inner, scope) if inner and inner[0].low in ("select", "with") else _derived(spark, scope, inner)
            out += [op("("), *done, op(")")]
            i = end + 1
        else:
            out.append(ts[i])
            i += 1
    return out


def query(spark: SparkSession, ts: list[Token], scope: list[Token] | None = None) -> list[Token]:
    """A query with its structure rewritten. scope: the WITH clause around it."""
    scope = scope or []
    if ts and ts[0].low == "with":
        done: list[Token] = []
        at = 1
        while True:
            name = ts[at]
            at += 1
            listed: list[list[Token]] = []
            if ts[at].low == "(":
                end = closing(ts, at)
                listed = split(ts[at + 1 : end])
                at = end + 1
            if ts[at].low != "as" or ts[at + 1].low != "(":
                raise DialectError("WITH name AS (...) is expected")
            end = closing(ts, at + 1)
            around = done or scope
            body = query(spark, ts[at + 2 : end], around)
            columns: list[Token] = []
            if listed:
                names = spark.sql(text_of([*around, word("SELECT"), op("*"), word("FROM"), op("("), *body, op(")")])).columns
                if len(listed) > len(names):
                    raise DialectError(f"{len(listed)} names for {len(names)} columns of {name.text}")
                every = [*listed, *[[Token("quoted", f"`{n}`")] for n in names[len(listed) :]]]
                columns = [op("("), *[t for n, c in enumerate(every) for t in [op(",")] * bool(n) + c], op(")")]
            done = [*(done or [*scope, op(",")] if done or scope else [word("WITH")]), *([op(",")] if done else []), name, *columns, word("AS"), op("("), *body, op(")")]
            at = end + 1
            if at < len(ts) and ts[at].low == ",":
                at += 1
                continue
            own = done[len(scope) + 1 :] if scope else done[1:]
            return [word("WITH"), *own, *query(spark, ts[at:], done)]
    ts = _derived(spark, scope, ts)
    places = [i for i, t in top_level(ts) if t.low in SETS]
    out: list[Token] = []
    names: list[str] | None = None
    for a, b in zip([0, *[p + 2 for p in places]], [*places, len(ts)], strict=True):
        block = ts[a:b]
        if block and block[0].low == "select":
            block = _typed(spark, scope, _windows(block))
            if not places:
                block = _hidden_order(spark, scope, block)
        if places and block and block[0].low in ("select", "("):
            tail = next((i for i, t in top_level(block) if t.low in ("order", "limit")), len(block))
            found = [c.lower() for c in spark.sql(text_of([*scope, *block[:tail]])).columns]
            if names not in (None, found):
                raise SchemaMismatch(f"columns {names} and {found}")
            names = found
        out += [*block, *ts[b : b + 2]]
    return out


def translate(spark: SparkSession, sql: str, added: dict[str, Callable] | None = None) -> str:
    """The dialect's text as Spark SQL."""
    ts = tokens(sql)
    while ts and ts[-1].low == ";":
        ts.pop()
    return text_of(query(spark, expressions(ts, added)))


def run_sql(spark: SparkSession, sql: str, added: dict[str, Callable] | None = None) -> DataFrame:
    return spark.sql(translate(spark, sql, added))
