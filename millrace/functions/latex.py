"""One spelling of LaTeX answers, and their equality as values.

An answer is read into tokens (commands, numbers, words, single signs) and groups in braces; one walk over them writes
the normal form. Values are compared by evaluating both expressions at fixed points, so that forms
of one polynomial or root agree without a computer algebra system.
"""

from __future__ import annotations

import cmath
import math
import re

TOKEN = re.compile(r"\\+[A-Za-z]+|\\.|\d+(?:\.\d+)?|\.\d+|[^\W\d_]+|\s+|.", re.S)

# What a final answer is freed of.
UNITS = frozenset(
    "square ways integers dollars mph inches hours km units sue points feet minutes digits cents degrees cm gm pounds meters meals edges students childrentickets multiples".split()
)
DROPPED_COMMANDS = frozenset(("\\ldots", "\\dots", "\\;", "\\!", "\\ ", "\\$", "\\left", "\\right", "\\%"))
DROPPED_TEXTS = frozenset(("s", ".", "\ns", "", "\n", "m"))
UNWRAPPED = frozenset(("\\text", "\\mbox", "\\textbf", "\\overline", "\\boxed"))
SAME = {"\\dfrac": "\\frac", "\\tfrac": "\\frac", "\\mbox": "\\text"}


class _Reader:
    """Tokens of a text, with a look at the next one and groups taken whole."""

    def __init__(self, text: str):
        self.tokens = [("\\" + t.lstrip("\\")) if t[0] == "\\" and t[-1].isalpha() else t for t in TOKEN.findall(text)]
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self) -> str:
        t = self.peek()
        self.at += 1
        return t

    def blanks(self) -> None:
        while self.peek().isspace():
            self.at += 1

    def group(self) -> str | None:
        """The inside of the group that starts here; None without one. An open group goes to the end."""
        if self.peek() != "{":
            return None
        depth, start = 0, self.at + 1
        while self.at < len(self.tokens):
            depth += {"{": 1, "}": -1}.get(self.take(), 0)
            if not depth:
                return "".join(self.tokens[start : self.at - 1])
        return "".join(self.tokens[start:])

    def argument(self) -> str:
        """A group, a command, or one character of what follows."""
        self.blanks()
        inner = self.group()
        if inner is not None:
            return inner
        t = self.peek()
        if len(t) > 1 and t[0] != "\\":
            self.tokens[self.at] = t[1:]
            return t[0]
        return self.take()


def _degree(r: _Reader) -> bool:
    """Takes the sign of degrees, if it stands here."""
    if r.peek() != "^":
        return False
    start = r.at
    r.take()
    if (r.group() if r.peek() == "{" else r.take()) in ("\\circ", "\\circ "):
        return True
    r.at = start
    return False


def _number(t: str) -> str:
    return "0" + t if t[0] == "." else t


def _with_arguments(command: str, r: _Reader, write) -> str:
    """\\frac and \\sqrt with all arguments in braces, each in normal form."""
    if command == "\\sqrt":
        root = ""
        r.blanks()
        if r.peek() == "[":
            while r.peek() and (t := r.take()) != "]":
                root += t
            root += "]"
        return f"\\sqrt{root}{{{write(r.argument())}}}"
    return "\\frac" + "".join("{" + write(r.argument()) + "}" for _ in range(2))


def _plain(text: str) -> str:
    r, out = _Reader(text), []
    while r.peek():
        if _degree(r):
            continue
        t = r.take()
        t = SAME.get(t, t)
        if t.isspace() or t in DROPPED_COMMANDS or t == "%":
            continue
        if t == "\\text":
            inner = r.group()
            if inner is not None and inner[:1] == " ":
                break  # a unit, and what follows it
            out.append(f"\\text{{{_plain(inner or '')}}}")
        elif t in ("\\frac", "\\sqrt"):
            out.append(_with_arguments(t, r, _plain))
        elif t == "{":
            r.at -= 1
            out.append("{" + _plain(r.group() or "") + "}")
        else:
            out.append(_number(t) if t[0] == "." and len(t) > 1 else t)
    return "".join(out)


def plain(text: str) -> str:
    """No blanks, signs of money, percent or degrees, sizes of brackets or units in text; arguments in braces; a/b of two integers and 0.5 as fractions; "x =" left off."""
    s = _plain(text)
    left, eq, right = s.partition("=")
    if eq and "=" not in right and len(left) <= 2:
        s = right
    if s == "0.5":
        return "\\frac{1}{2}"
    m = re.fullmatch(r"(-?)(0|[1-9]\d*)/(-?)(0|[1-9]\d*)", s)
    return f"\\frac{{{m[1]}{m[2]}}}{{{m[3]}{m[4]}}}" if m else s


def final(text: str) -> str:
    """The part after the last equals sign without articles, units, quotes, text commands and thousands separators; of a part between dollar signs only that."""
    r, out = _Reader(text.split("=")[-1]), []
    while r.peek():
        if _degree(r):
            continue
        t = r.take()
        t = SAME.get(t, t)
        if t in ("a", "an") and r.peek().isspace() or t.isspace() or t in UNITS or t in DROPPED_COMMANDS or t == '"':
            continue
        if t == "." and r.peek() == "$":
            continue
        if t in UNWRAPPED:
            inner = r.group() or ""
            if inner == "and":
                out += [] if out and out[-1] == "," else [","]
            elif t == "\\text" and inner in DROPPED_TEXTS:
                if inner == "" and r.peek() == "^" and r.tokens[r.at + 1 : r.at + 2] in (["2"], ["3"]):
                    r.at += 2
            else:
                out.append(final(inner))
        elif t == "\\mathrm" and r.peek() == "{":
            inner = r.group()
            out += [] if inner == "th" else [f"\\mathrm{{{inner}}}"]
        elif t in ("\\frac", "\\sqrt"):
            out.append(_with_arguments(t, r, final))
        elif t == "{":
            r.at -= 1
            inner = r.group() or ""
            out += [] if inner == "," else ["{" + final(inner) + "}"]
        else:
            out.append(t)
    s = "".join(out)
    parts = s.split("$")
    s = parts[1] if len(parts) > 2 else s.replace("$", "")
    digits = s.replace(",", "")
    return digits if digits.isdigit() else s


# values ---------------------------------------------------------------------------------------------------------------

#: Functions and constants of expressions (fixed values).
FUNCTIONS = {"\\sin": cmath.sin, "\\cos": cmath.cos, "\\tan": cmath.tan, "\\ln": cmath.log, "\\log": cmath.log, "\\exp": cmath.exp, "\\arctan": cmath.atan, "\\arcsin": cmath.asin, "\\arccos": cmath.acos}
CONSTANTS = {"\\pi": math.pi, "π": math.pi, "\\infty": math.inf, "∞": math.inf, "i": 1j, "e": math.e}
TIMES, OVER = ("*", "\\cdot", "\\times", "·", "×"), ("/", "\\div", "÷")
#: Where variables are evaluated: irrational steps, so that no two variables are rationally dependent.
POINTS = (0.7390851, 1.9021605, -0.5671433)


class _Expression:
    """Value of an expression by descent; a ValueError where it isn't one."""

    def __init__(self, text: str, point: int):
        self.r, self.point = _Reader(text), point
        self.r.tokens = [t for t in self.r.tokens if not t.isspace()]

    def value(self) -> complex:
        v = self.sum()
        if self.r.peek():
            raise ValueError(self.r.peek())
        return v

    def sum(self) -> complex:
        v = self.product()
        while self.r.peek() in ("+", "-", "−"):
            v = v + self.product() if self.r.take() == "+" else v - self.product()
        return v

    def product(self) -> complex:
        v = self.signed()
        while (t := self.r.peek()) and t not in ("+", "-", "−", ")", "]", "}", ",", "=", "|"):
            if t in TIMES:
                self.r.take()
                v *= self.signed()
            elif t in OVER:
                self.r.take()
                v /= self.signed()
            else:
                v *= self.power()
        return v

    def signed(self) -> complex:
        if self.r.peek() in ("-", "−", "+"):
            return self.signed() if self.r.take() == "+" else -self.signed()
        return self.power()

    def power(self) -> complex:
        v = self.atom()
        while self.r.peek() == "^":
            self.r.take()
            inner = self.r.group()
            v **= _Expression(inner, self.point).value() if inner is not None else self.signed()
        return v

    def inside(self) -> complex:
        return _Expression(self.r.argument(), self.point).value()

    def atom(self) -> complex:
        t = self.r.take()
        if not t:
            raise ValueError("end")
        if t[0].isdigit() or t[0] == "." and len(t) > 1:
            while self.r.peek() == "," and re.fullmatch(r"\d{3}", (self.r.tokens[self.r.at + 1 : self.r.at + 2] or [""])[0]):
                self.r.take()
                t += self.r.take()
            return complex(float(t))
        if t in ("(", "["):
            v = self.sum()
            if self.r.take() not in (")", "]"):
                raise ValueError("bracket")
            return v
        if t == "{":
            self.r.at -= 1
            return _Expression(self.r.group() or "", self.point).value()
        if t == "|":
            v = self.sum()
            if self.r.take() != "|":
                raise ValueError("bar")
            return complex(abs(v))
        if t == "\\frac":
            return self.inside() / self.inside()
        if t == "\\sqrt":
            n = 2.0
            if self.r.peek() == "[":
                self.r.take()
                n = self.sum().real
                self.r.take()
            return self.inside() ** (1 / n)
        if t in FUNCTIONS:
            n = 1
            if self.r.peek() == "^":
                self.r.take()
                n = self.inside()
            return FUNCTIONS[t](self.power()) ** n
        if t in CONSTANTS:
            return complex(CONSTANTS[t])
        if t[0] == "\\" and t[1:].isalpha() and t[1:] not in ("text", "begin", "end", "cup", "in") or t.isalpha():
            if t.isalpha() and len(t) > 1:  # letters side by side are factors
                self.r.at -= 1
                self.r.tokens[self.r.at : self.r.at + 1] = list(t)
                return self.power()
            seed = sum(ord(c) * (k + 1) for k, c in enumerate(t))
            return complex(POINTS[self.point] * (1 + seed % 97 / 31) + seed % 11)
        raise ValueError(t)


def evaluate(text: str, point: int = 0) -> complex | None:
    """The value with variables at fixed points; None for what is no expression."""
    try:
        return _Expression(text, point).value()
    except (ValueError, ZeroDivisionError, OverflowError, RecursionError, TypeError):
        return None


def _parts(s: str) -> tuple[str, list[str]] | None:
    """Kind and parts of an interval or tuple, a set, a union, a matrix or a list."""
    m = re.fullmatch(r"\\begin\{([pbvBV]?matrix)\}(.*)\\end\{\1\}", s, re.S)
    if m:
        return "matrix", [c for row in re.split(r"\\\\|\\cr", m[2].strip("\\")) for c in ["\n", *row.split("&")]]
    for sep, kind in (("\\cup", "union"), (",", "list")):
        depth, cut, out = 0, 0, []
        for t in re.finditer(r"\\cup|\\.|.", s, re.S):
            depth += {"(": 1, "[": 1, "{": 1, "\\{": 1, ")": -1, "]": -1, "}": -1, "\\}": -1}.get(t[0], 0)
            if t[0] == sep and not depth:
                out.append(s[cut : t.start()])
                cut = t.end()
        if out:
            return kind, [*out, s[cut:]]
    for a, b in (("(", ")"), ("[", "]"), ("(", "]"), ("[", ")"), ("\\{", "\\}")):
        if s.startswith(a) and s.endswith(b) and len(s) > len(a) + len(b):
            inner = _parts(s[len(a) : -len(b)])
            if inner and inner[0] == "list":
                return a + b, inner[1]
    return None


def equal(a: str, b: str, tolerance: float = 1e-4) -> bool:
    """Equal as spelled, as values (a percentage may stand for its share), or part by part; parts of sets and unions in any order."""
    a, b = plain(a), plain(b)
    if a == b:
        return True
    p, q = _parts(a), _parts(b)
    if p and q and p[0] == q[0] and not re.fullmatch(r"\d{1,3}(?:,\d{3})+", a) and not re.fullmatch(r"\d{1,3}(?:,\d{3})+", b):
        if len(p[1]) != len(q[1]):
            return False
        if p[0] in ("\\{\\}", "union", "list"):
            left = list(q[1])
            for x in p[1]:
                hit = next((y for y in left if equal(x, y, tolerance)), None)
                if hit is None:
                    return False
                left.remove(hit)
            return True
        return all(equal(x, y, tolerance) for x, y in zip(p[1], q[1]))
    values = [(evaluate(a, k), evaluate(b, k)) for k in range(len(POINTS))]
    if any(x is None or y is None for x, y in values):
        return False
    near = lambda x, y: x == y or cmath.isclose(x, y, rel_tol=tolerance, abs_tol=1e-12)
    plain_number = all(x == values[0][0] and y == values[0][1] for x, y in values)
    if plain_number:
        x, y = values[0]
        return any(near(x, z) for z in (y, y / 100, y * 100))
    return all(cmath.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in values)
