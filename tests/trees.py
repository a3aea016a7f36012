"""A small language for syntax trees: nested tuples (kind, op, name, children), children as (role, tree)."""

from __future__ import annotations

from tessera.operators import names as N

SCHEMA = "app string, source_id long, node_id long, parent_id long, role string, ord int, kind string, op string, name string, pos long, len int, line int"


def node(kind, *children, op=None, name=None, line=0):
    return kind, op, name, line, children


def name(x, line=0):
    return node("Name", name=x, line=line)


def get(base, prty, line=0):
    return node("PropertyGet", ("left", base), ("right", name(prty, line)), line=line)


def this():
    return node("KeywordLiteral", op="this")


def number(x="1"):
    return node("NumberLiteral", name=x)


def assign(left, right, op="="):
    return node("Assignment", ("left", left), ("right", right), op=op)


def infix(op, left, right):
    return node("InfixExpression", ("left", left), ("right", right), op=op)


def stmt(expression):
    return node("ExpressionStatement", ("expression", expression))


def obj(*entries, op="init"):
    return node("ObjectLiteral", *[("element", node("ObjectProperty", ("left", k if isinstance(k, tuple) else name(k)), ("right", v), op=op)) for k, v in entries])


def fun(params, *body, called=""):
    return node("FunctionNode", *[("param", name(p)) for p in params], ("body", node("Block", *[("statement", s) for s in body])), name=called)


def call(target, *args, new=False):
    return node("NewExpression" if new else "FunctionCall", ("target", target), *[("arg", a) for a in args])


def paren(x):
    return node("ParenthesizedExpression", ("expression", x))


def var(x, value=None):
    return node("VariableDeclaration", ("variable", node("VariableInitializer", ("target", name(x)), *([("initializer", value)] if value else []))))


def ret(x):
    return node("ReturnStatement", ("value", x))


def program(spark, *statements, source=1, app="a"):
    """ast and declarations of the functions' parameters and variables."""
    rows, decls = [], []

    def walk(tree, parent, role, order, scope):
        kind, op, text, line, children = tree
        me = len(rows)
        rows.append((app, source, me, parent, role, order, kind, op, text, me, 1, line))
        if kind == "FunctionNode":
            scope = me
        if scope is not None and kind == "Name" and role in ("param", "target") and (role == "param" or rows[parent][6] == "VariableInitializer"):
            decls.append((app, source, scope, text))
        seen = {}
        for r, child in children:
            seen[r] = seen.get(r, -1) + 1
            walk(child, me, r, seen[r], scope)

    for i, s in enumerate(statements):
        walk(s, None, "statement", i, None)
    def above(i):
        return [] if rows[i][3] is None else [*above(rows[i][3]), tuple(rows[rows[i][3]][k] for k in (2, 6, 4, 7))]

    full = [(*r, len(above(i)), above(i)) for i, r in enumerate(rows)]
    ast = spark.createDataFrame(full, f"{SCHEMA}, depth int, ancestors {N.ANCESTORS}")
    return ast, spark.createDataFrame(decls, "app string, source_id long, scope_id long, name string")
