"""Per-pixel expression languages, compiled to SQL expression text.

``compile_infix`` reads the infix language: ``|| && comparisons + - * / % ^``,
unary ``~ ! -``, numbers, ``pi``, ``e``, ``r g b``, image references ``Ik`` and
``Ik.c``, and function calls. ``compile_script`` reads the smaller language of
batch scripts, with ``$name$`` variables. Both give text for
``pyspark.sql.functions.expr`` (and DuckDB): the optimizer folds constants,
shares subexpressions and generates code; nothing is interpreted per pixel.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from .spec import num


class ExpressionError(ValueError):
    """Raised for text that is not an expression of the language."""


TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_]\w*(?:\.[A-Za-z]\w*)?)|(\|\||&&|>=|<=|==|!=|[-+*/%^~!<>(),]))")


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected {text[at:at + 10]!r}")
        kind = "number" if m[1] else "name" if m[2] else "sign"
        out.append((kind, m[m.lastindex]))
        at = m.end()
    return out


def truth(condition: str) -> str:
    return f"(CASE WHEN {condition} THEN 1.0E0 ELSE 0.0E0 END)"


def _mtf(m: str, x: str) -> str:
    den = f"((2.0E0 * {m} - 1.0E0) * {x} - {m})"
    return f"(CASE WHEN abs({den}) < 1.0E-15 THEN {x} ELSE ({m} - 1.0E0) * {x} / {den} END)"


def _floor_log(name: str) -> Callable[[str], str]:
    return lambda x: f"{name}(greatest(1.0E-300, {x}))"


#: (name, number of arguments) -> text. Guards: logarithms of at least 1e-300, roots of at least 0.
FUNCTIONS: dict[tuple[str, int], Callable[..., str]] = {
    **{(n, 1): (lambda n: lambda x: f"{n}({x})")(n) for n in ("abs", "exp", "sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh")},
    **{(n, 1): (lambda n: lambda x: f"CAST({n}({x}) AS DOUBLE)")(n) for n in ("floor", "sign")},
    ("ceil", 1): lambda x: f"CAST(ceil({x}) AS DOUBLE)",
    ("trunc", 1): lambda x: f"(CAST(sign({x}) AS DOUBLE) * floor(abs({x})))",
    ("sqrt", 1): lambda x: f"sqrt(greatest(0.0E0, {x}))",
    ("log", 1): _floor_log("log10"), ("log10", 1): _floor_log("log10"), ("ln", 1): _floor_log("ln"), ("log2", 1): _floor_log("log2"),
    ("atan2", 2): lambda a, b: f"atan2({a}, {b})",
    ("min", 2): lambda a, b: f"least({a}, {b})", ("max", 2): lambda a, b: f"greatest({a}, {b})",
    ("pow", 2): lambda a, b: f"pow({a}, {b})",
    ("mtf", 2): _mtf,
    ("gamma", 2): lambda x, g: f"pow(greatest(0.0E0, {x}), {g})",
    ("clamp", 3): lambda x, lo, hi: f"least({hi}, greatest({lo}, {x}))",
    ("iif", 3): lambda c, a, b: f"(CASE WHEN {c} > 0 THEN {a} ELSE {b} END)",
    ("iff", 3): lambda c, a, b: f"(CASE WHEN {c} > 0 THEN {a} ELSE {b} END)",
}
COMPARE = {">": ">", ">=": ">=", "<": "<", "<=": "<=", "==": "=", "!=": "<>"}


class _Parser:
    """Precedence climbing over tokens; ``name`` turns identifiers into column text."""

    def __init__(self, text: str, name: Callable[[str], str]):
        self.tokens, self.at, self.name = tokenize(text), 0, name

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise ExpressionError("unexpected end")
        self.at += 1
        return self.tokens[self.at - 1]

    def expect(self, sign: str) -> None:
        if self.take()[1] != sign:
            raise ExpressionError(f"expected {sign!r}")

    def whole(self) -> str:
        out = self.either()
        if self.at != len(self.tokens):
            raise ExpressionError(f"unexpected {self.peek()!r}")
        return out

    def chain(self, below: Callable[[], str], make: dict[str, Callable[[str, str], str]]) -> str:
        left = below()
        while self.peek() in make:
            left = make[self.take()[1]](left, below())
        return left

    def either(self) -> str:
        return self.chain(self.both, {"||": lambda a, b: truth(f"{a} <> 0 OR {b} <> 0")})

    def both(self) -> str:
        return self.chain(self.compare, {"&&": lambda a, b: truth(f"{a} <> 0 AND {b} <> 0")})

    def compare(self) -> str:
        return self.chain(self.sum, {k: (lambda s: lambda a, b: truth(f"{a} {s} {b}"))(s) for k, s in COMPARE.items()})

    def sum(self) -> str:
        return self.chain(self.product, {"+": lambda a, b: f"({a} + {b})", "-": lambda a, b: f"({a} - {b})"})

    def product(self) -> str:
        return self.chain(self.power, {
            "*": lambda a, b: f"({a} * {b})",
            "/": lambda a, b: f"(CASE WHEN {b} = 0 THEN 1.0E0 ELSE {a} / nullif({b}, 0.0E0) END)",
            "%": lambda a, b: f"(CASE WHEN {b} = 0 THEN 0.0E0 ELSE {a} % nullif({b}, 0.0E0) END)",
        })

    def power(self) -> str:
        base = self.unary()
        if self.peek() == "^":  # takes one factor and does not chain
            self.take()
            return f"pow({base}, {self.unary()})"
        return base

    def unary(self) -> str:
        sign = self.peek()
        if sign in ("~", "!", "-") and self.tokens[self.at][0] == "sign":
            self.take()
            x = self.unary()
            return {"~": f"(1.0E0 - {x})", "!": truth(f"{x} = 0"), "-": f"(-{x})"}[sign]
        return self.atom()

    def atom(self) -> str:
        kind, text = self.take()
        if kind == "number":
            return num(float(text))
        if text == "(":
            inner = self.either()
            self.expect(")")
            return f"({inner})"
        if kind != "name":
            raise ExpressionError(f"unexpected {text!r}")
        lower = text.lower()
        if self.peek() != "(":
            if lower == "pi":
                return num(3.141592653589793)
            if lower == "e":
                return num(2.718281828459045)
            return self.name(lower)
        self.take()
        args = []
        if self.peek() != ")":
            args.append(self.either())
            while self.peek() == ",":
                self.take()
                args.append(self.either())
        self.expect(")")
        if (lower, len(args)) not in FUNCTIONS:
            raise ExpressionError(f"no function {lower} of {len(args)} arguments")
        return FUNCTIONS[lower, len(args)](*args)


def _image(channel: str, images: int):
    def name(text: str) -> str:
        if text in ("r", "g", "b"):
            return text
        m = re.fullmatch(r"i(\d+)(?:\.([rgb]))?", text)
        if not m or not 1 <= int(m[1]) <= images:
            raise ExpressionError(f"unknown name {text!r}")
        return f"coalesce(i{m[1]}_{m[2] or channel}, 0.0E0)"

    return name


def compile_infix(text: str, images: int = 10) -> dict[str, str]:
    """Text of each assigned channel (r, g, b).

    ``R=...; G=...`` assigns the named channels; any other text is one expression
    for all. An unqualified image reference reads the channel that is assigned.
    """
    parts = [p.strip() for p in text.split(";") if p.strip()]
    found = {}
    heads = [re.match(r"([rgbRGB])\s*=(?!=)(.*)", p, re.S) for p in parts]
    if parts and all(heads):
        for m in heads:
            found[m[1].lower()] = _Parser(m[2], _image(m[1].lower(), images)).whole()
        return found
    if len(parts) != 1:
        raise ExpressionError("expected one expression or assignments")
    return {c: _Parser(parts[0], _image(c, images)).whole() for c in "rgb"}


# ---- the script language ----

SCRIPT_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*|\.\d+)|\$([^$]+)\$|([A-Za-z_]\w*)|([-+*/~(),]))")
PRECEDENCE = {"~": 4, "*": 3, "/": 3, "+": 2, "-": 2}


def script_variables(text: str) -> list[str]:
    return list(dict.fromkeys(m[1] for m in re.finditer(r"\$([^$]+)\$", text)))


def _script_mtf(m: str, x: str) -> str:
    return f"(CASE WHEN {x} <= 0 THEN 0.0E0 WHEN {x} >= 1 THEN 1.0E0 WHEN {m} <= 0 OR {m} >= 1 THEN {x} ELSE {_mtf(m, x)} END)"


def to_rpn(text: str) -> list[tuple[str, str]]:
    """Shunting-yard: numbers, variables, operators and calls in postfix order."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []
    at = 0
    text = text.rstrip()
    while at < len(text):
        m = SCRIPT_TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected {text[at:at + 10]!r}")
        at = m.end()
        if m[1]:
            out.append(("number", m[1]))
        elif m[2]:
            out.append(("variable", m[2]))
        elif m[3]:
            stack.append(("call", m[3].lower()))
        elif m[4] == "(":
            stack.append(("sign", "("))
        elif m[4] in "),":
            while stack and stack[-1] != ("sign", "("):
                out.append(stack.pop())
            if not stack:
                raise ExpressionError("unbalanced parentheses")
            if m[4] == ")":
                stack.pop()
                if stack and stack[-1][0] == "call":
                    out.append(stack.pop())
        else:
            rank = PRECEDENCE[m[4]]
            while stack and stack[-1][0] == "sign" and stack[-1][1] != "(" and (PRECEDENCE[stack[-1][1]] >= rank and m[4] != "~"):
                out.append(stack.pop())
            stack.append(("sign", m[4]))
    while stack:
        if stack[-1][1] == "(":
            raise ExpressionError("unbalanced parentheses")
        out.append(stack.pop())
    return out


def compile_script(text: str, column: Callable[[str], str]) -> str:
    """Text of a script expression; ``column`` gives the column of a variable. x / 0 is 0."""
    make = {
        "+": lambda a, b: f"({a} + {b})", "-": lambda a, b: f"({a} - {b})", "*": lambda a, b: f"({a} * {b})",
        "/": lambda a, b: f"(CASE WHEN {b} = 0 THEN 0.0E0 ELSE {a} / nullif({b}, 0.0E0) END)",
        "min": lambda a, b: f"least({a}, {b})", "max": lambda a, b: f"greatest({a}, {b})", "mtf": _script_mtf,
    }
    stack: list[str] = []
    for kind, value in to_rpn(text):
        if kind == "number":
            stack.append(num(float(value)))
        elif kind == "variable":
            stack.append(column(value))
        elif value == "~":
            if not stack:
                raise ExpressionError("missing operand")
            stack.append(f"(1.0E0 - {stack.pop()})")
        elif value in make:
            if len(stack) < 2:
                raise ExpressionError("missing operand")
            b, a = stack.pop(), stack.pop()
            stack.append(make[value](a, b))
        else:
            raise ExpressionError(f"no function {value}")
    if len(stack) != 1:
        raise ExpressionError("not one value")
    return stack[0]
