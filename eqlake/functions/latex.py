"""LaTeX as expression trees, read twice.

``grammar`` is a lexer and a grammar driven by a table of commands; a command that isn't in it is an error.
``rewritten`` shares nothing with it but the table: it folds the innermost
brackets of the text again and again, writes each fold as infix by patterns, and leaves precedence to the
infix reader. ``read`` gives the grammar's tree only if both can read the text and
their values agree at seeded points; otherwise the text has no reading.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import types as T
from pyspark.sql.column import Column

#: The commands that are understood.
GREEK = frozenset("alpha beta gamma delta epsilon varepsilon zeta eta theta vartheta kappa lambda mu nu xi rho sigma tau phi varphi chi psi omega pi".split())
NAMED = {f: f for f in "sin cos tan cot sec csc sinh cosh tanh exp log ln asin acos atan asinh acosh atanh".split()}
NAMED |= {f"arc{f}": f"a{f}" for f in "sin cos tan sinh cosh tanh".split()} | {f"ar{f}": f"a{f}" for f in "sinh cosh tanh".split()} | {"abs": "Abs", "sqrt": "sqrt"}
FRACTIONS = frozenset("frac dfrac tfrac cfrac".split())
STYLED = frozenset("operatorname mathrm text textrm mathit mathbf mathsf rm boxed".split())
SKIPPED = frozenset("displaystyle textstyle limits nolimits quad qquad left right big Big bigg Bigg bigl bigr Bigl Bigr biggl biggr Biggl Biggr middle thinspace enspace".split())
PRODUCT, QUOTIENT = frozenset("cdot times ast".split()), frozenset(["div"])
RELATIONS = {"<": "<", ">": ">", "\\lt": "<", "\\gt": ">", "\\le": "<=", "\\leq": "<=", "\\leqslant": "<=", "\\ge": ">=", "\\geq": ">=", "\\geqslant": ">="}
BARS = {"|": "|", "\\vert": "\\vert", "\\lvert": "\\rvert"}

#: Letters that name a function when a variable stands in brackets after them, so that no value is known.
UNKNOWNS = frozenset("u f g K y".split())

TOKEN = re.compile(r"\\[A-Za-z]+|\\\\|\\[,;:!>{} ]|\d+\.?\d*|\.\d+|[A-Za-z]|[-+*/^_{}()\[\]|<>=&,]|\S")
SIDES = (re.compile(r"\\left\s*(?:\||\\vert)"), re.compile(r"\\right\s*(?:\||\\vert)"))
GLYPHS = {"·": "\\cdot ", "×": "\\times ", "−": "-", "π": "\\pi ", "λ": "\\lambda ", "∫": "\\int ", "≤": "\\le ", "≥": "\\ge ", "√": "\\sqrt "}


class _Grammar:
    def __init__(self, text: str):
        for glyph, command in GLYPHS.items():
            text = text.replace(glyph, command)
        text = SIDES[1].sub(r"\\rvert ", SIDES[0].sub(r"\\lvert ", text))
        found = TOKEN.findall(text)
        self.tokens = [t for k, t in enumerate(found) if not (re.fullmatch(r"\\[,;:!> ]", t) or t[1:] in SKIPPED and t[0] == "\\")]
        # \left. and \right. stand for no bracket
        if re.search(r"\\(?:left|right)\s*\.", text):
            raise ValueError("empty bracket")
        self.tokens = [{"\\{": "(", "\\}": ")"}.get(t, t) for t in self.tokens]
        self.at, self.integrals = 0, 0

    def peek(self, ahead: int = 0):
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else None

    def take(self, wanted: str | None = None) -> str:
        token = self.peek()
        if token is None or wanted is not None and token != wanted:
            raise ValueError(f"unexpected {token}")
        self.at += 1
        return token

    def total(self):
        left = self.product()
        while self.peek() in ("+", "-"):
            left = (self.take(), left, self.product())
        return left

    def differential(self) -> bool:
        """Whether dt or so is next, which ends an integrand."""
        if not self.integrals:
            return False
        if self.peek() == "d":
            return bool(self.peek(1) and re.fullmatch(r"[A-Za-z]|\\[a-z]+", self.peek(1)) and self.peek(1)[1:] not in NAMED)
        return self.peek() == "\\mathrm" and self.tokens[self.at + 1 : self.at + 4] == ["{", "d", "}"]

    def product(self):
        left = self.signed()
        while (token := self.peek()) is not None:
            if token == "*" or token[1:] in PRODUCT and token[0] == "\\":
                self.take()
                left = ("*", left, self.signed())
            elif token == "/" or token[1:] in QUOTIENT and token[0] == "\\":
                self.take()
                left = ("/", left, self.signed())
            elif self.begins(token) and not self.differential():
                left = ("*", left, self.power())
            else:
                break
        return left

    def begins(self, token: str) -> bool:
        """Whether a token can begin a factor that stands beside another; a bar only ends what a bar began."""
        return bool(re.fullmatch(r"\d.*|\.\d+|[A-Za-z({\[]", token)) and token != "[" or token[0] == "\\" and token not in ("\\\\", "\\end", "\\rvert") and token not in RELATIONS and token[1:] not in PRODUCT

    def signed(self):
        if self.peek() in ("-", "+"):
            return ("neg", self.signed()) if self.take() == "-" else self.signed()
        return self.power()

    def power(self):
        base = self.atom()
        while self.peek() == "^":
            self.take()
            base = ("call", "exp", self.script()) if base in (("sym", "e"),) else ("**", base, self.script())
        return base

    def script(self):
        """An exponent: a group, or one number, letter or command, with a sign."""
        if self.peek() == "{":
            return self.bracket("{", "}")
        if self.peek() == "-":
            self.take()
            return ("neg", self.script())
        return self.atom(scripts=False)

    def bracket(self, start: str, end: str):
        self.take(start)
        inner, self.integrals = self.integrals, 0
        out = self.total()
        self.integrals = inner
        self.take(end)
        return out

    def word(self) -> str:
        """The letters of a group as they stand."""
        self.take("{")
        out = ""
        while self.peek() != "}":
            out += self.take()
        self.take()
        return out

    def name(self, letter: str):
        """A symbol with its subscript; e is the number."""
        if self.peek() == "_":
            self.take()
            part = self.word() if self.peek() == "{" else self.take()
            if not re.fullmatch(r"\w+", part):
                raise ValueError("subscript")
            return ("sym", f"{letter}_{part}")
        if letter in UNKNOWNS and self.peek() == "(" and self.peek(1) in ("x", "t", "s") and self.peek(2) in (")", ","):
            raise ValueError("a function without a value")
        return ("sym", letter)

    def atom(self, scripts: bool = True):
        token = self.take()
        if re.fullmatch(r"\d+\.?\d*|\.\d+", token):
            return ("num", float(token))
        if token == "{":
            self.at -= 1
            return self.bracket("{", "}")
        if token in ("(", "["):
            self.at -= 1
            return self.bracket(token, ")" if token == "(" else "]")
        if token in BARS:
            inner = self.total()
            self.take(BARS[token])
            return ("call", "Abs", inner)
        if re.fullmatch("[A-Za-z]", token):
            return self.name(token) if scripts else ("sym", token)
        command = token[1:] if token[0] == "\\" else None
        if command in GREEK:
            return self.name(command) if scripts else ("sym", command)
        if command in FRACTIONS:
            top, bottom = self.argument(), self.argument()
            if ("sym", "d") in (top, *top[1:]):  # a derivative
                raise ValueError("d")
            return ("/", top, bottom)
        if command == "sqrt":
            if self.peek() == "[":
                order = self.bracket("[", "]")
                return ("**", self.argument(), ("/", ("num", 1.0), order))
            return ("call", "sqrt", self.argument())
        if command in NAMED:
            return self.function(NAMED[command])
        if command == "boxed":
            return self.bracket("{", "}")
        if command in STYLED:
            word = self.word().strip()
            if word in NAMED:
                return self.function(NAMED[word])
            if re.fullmatch("[A-Za-z]", word) and word != "d":
                return self.name(word)
            raise ValueError(word)
        if command == "int":
            return self.integral()
        if command == "begin" and self.word() == "cases":
            return self.cases()
        raise ValueError(token)

    def argument(self):
        """What a command takes: a group, or one digit or letter."""
        if self.peek() == "{":
            return self.bracket("{", "}")
        token = self.peek()
        if token and re.fullmatch(r"\d+", token):  # \frac12 is a half
            self.tokens[self.at : self.at + 1] = list(token)
        return self.atom(scripts=False)

    def function(self, name: str):
        raised, base = None, None
        while self.peek() in ("^", "_"):
            if self.take() == "^":
                raised = self.script()
            else:
                base = self.bracket("{", "}") if self.peek() == "{" else self.argument()
        if base is not None and name != "log":
            raise ValueError("subscript")
        if self.peek() in ("(", "{", "["):
            inner = self.bracket(self.peek(), {"(": ")", "{": "}", "[": "]"}[self.peek()])
        else:
            inner = self.power()
            while self.peek() and not self.differential() and (re.fullmatch(r"\d+\.?\d*|[A-Za-z]", self.peek()) or self.peek()[1:] in GREEK and self.peek()[0] == "\\"):
                inner = ("*", inner, self.power())
        if raised in (("neg", ("num", 1.0)), ("num", -1.0)) and f"a{name}" in NAMED:
            return ("call", f"a{name}", inner)
        out = ("call", name, inner)
        out = out if base is None else ("/", out, ("call", "log", base))
        return out if raised is None else ("**", out, raised)

    def integral(self):
        bounds = {}
        for _ in range(2):
            if self.peek() in ("_", "^"):
                mark = self.take()
                bounds[mark] = self.script()
        self.integrals += 1
        body = ("num", 1.0) if self.differential() else self.total()
        if not self.differential():
            raise ValueError("integral without dt")
        self.integrals -= 1
        if self.take() != "d":
            self.at += 3
        variable = self.take()
        if set(bounds) != {"_", "^"}:
            raise ValueError("integral without bounds")
        out = ("int", variable.lstrip("\\"), bounds["_"], bounds["^"], body)
        return ("*", out, self.product()) if self.peek() and self.begins(self.peek()) and not self.differential() else out

    def cases(self):
        rows = []
        while True:
            value = self.total()
            self.peek() == "," and self.take()
            condition = None
            if self.peek() == "&":
                self.take()
                condition = self.condition()
            rows.append((value, condition))
            self.peek() in (",", ".") and self.take()
            if self.peek() != "\\\\":
                break
            self.take()
            if self.peek() == "\\end":
                break
        self.take("\\end")
        if self.word() != "cases":
            raise ValueError("cases")
        out = ("sym", "nan")
        for value, condition in reversed(rows):
            out = value if condition is None else ("if", condition, value, out)
        return out

    def condition(self):
        while self.peek() in ("\\text", "\\mathrm", "\\textrm"):
            self.take()
            if self.word() in ("otherwise", "otherwise,", "else"):
                return None
        left = self.total()
        out = None
        while self.peek() in RELATIONS:
            sign = RELATIONS[self.take()]
            right = self.total()
            one = (sign, left, right)
            out, left = one if out is None else ("&", out, one), right
        if out is None:
            raise ValueError("condition")
        return out


def grammar(text: str):
    """The tree of a LaTeX text by the grammar; None if it isn't one."""
    try:
        reader = _Grammar(text)
        out = reader.total()
        return out if reader.peek() is None else None
    except (ValueError, IndexError, RecursionError):
        return None


# the second reading

_FOLD = re.compile(r"\{([^{}()\[\]\x02\x03]*)\}|\(([^{}()\[\]\x02\x03]*)\)|\[([^{}()\[\]\x02\x03]*)\]|\x02([^{}()\[\]\x02\x03]*)\x03")
_HELD = "\u27e6(\\d+)\u27e7"
_PART = rf"(?:{_HELD}|\\(?:{'|'.join(sorted(GREEK))})(?![A-Za-z])|\d+\.?\d*|[A-Za-z])"


class _Folds:
    """Contents of brackets taken out of a text so far: as they stood, and as infix."""

    def __init__(self):
        self.raw: list[str] = []
        self.infix: list[str | None] = []
        self.kinds: list[str] = []

    def hold(self, raw: str, kind: str, infix: str | None = None) -> str:
        self.raw.append(raw)
        self.kinds.append(kind)
        self.infix.append(infix)
        return f"\u27e6{len(self.raw) - 1}\u27e7"

    def plain(self, part: str) -> str:
        """One part (a fold, command, number or letter) as infix in brackets."""
        held = re.fullmatch(_HELD, part)
        return f"({self.content(int(held[1]))})" if held else part.lstrip("\\")

    def content(self, k: int) -> str:
        if self.infix[k] is None:
            inner = self.flat(self.raw[k])
            self.infix[k] = f"Abs({inner})" if self.kinds[k] == "\x02" else inner
        return self.infix[k]

    def stood(self, part: str) -> str:
        held = re.fullmatch(_HELD, part)
        return self.raw[int(held[1])] if held else part

    def done(self, infix: str) -> str:
        return self.hold("", "(", infix)

    def flat(self, s: str) -> str:
        """A text without brackets as infix: each pattern turns what it knows into one fold."""
        s = re.sub(r"\\(?:begin)⟦(\d+)⟧(.*?)\\end⟦\d+⟧", lambda m: self.done(self.piecewise(m[2])), s, flags=re.S)
        s = re.sub(rf"\\(?:{'|'.join(STYLED - {'boxed'})})({_HELD})", lambda m: self.styled(m[1]), s)
        s = re.sub(rf"\\boxed({_HELD})", r"\1", s)
        sub = re.compile(rf"((?<![A-Za-z\\])[A-Za-z]|\\(?:{'|'.join(sorted(GREEK))}))_({_HELD}|\w)(?!\w*⟧)")
        s = sub.sub(lambda m: self.done(f"{m[1].lstrip(chr(92))}_{self.stood(m[2])}"), s)
        while (m := re.search(rf"\\int\s*_\s*(-?{_PART})\s*\^\s*(-?{_PART})((?:(?!\\int).)*?)(?<!\\)d\s*([a-z])(?![a-z])", s, flags=re.S)) is not None:
            low, high = (("-" if p.startswith("-") else "") + self.plain(p.lstrip("-")) for p in (m[1], m[3]))
            body = self.flat(m[5]) if m[5].strip() else "1"
            s = s[: m.start()] + self.done(f"Integral({body}, ({m[6]}, {low}, {high}))") + s[m.end() :]
        digit = rf"(?:{_HELD}|\d|[A-Za-z])"
        s = re.sub(rf"\\(?:{'|'.join(FRACTIONS)})\s*({digit})\s*({digit})", lambda m: self.done(f"{self.plain(m[1])}/{self.plain(m[3])}"), s)
        s = re.sub(rf"\\sqrt\s*({_HELD})\s*({digit})", lambda m: self.done(f"{self.plain(m[3])}**(1/{self.plain(m[1])})") if self.kinds[int(m[2])] == "[" else m[0], s)
        s = re.sub(rf"\\sqrt\s*({digit})", lambda m: self.done(f"sqrt({self.plain(m[1])})"), s)
        s = re.sub(r"(?:\||\\vert(?![A-Za-z]))([^|]+?)(?:\||\\vert(?![A-Za-z]))", lambda m: self.done(f"Abs({self.flat(m[1])})"), s)
        functions = "|".join(sorted((f for f in NAMED if f != "sqrt"), key=len, reverse=True))
        powered = rf"{_PART}(?:\s*\^\s*-?{_PART})?"
        # the last function first, so that one can be the argument of another
        pattern = re.compile(rf"^(.*)\\({functions})(?![A-Za-z])\s*(?:_\s*({_PART}))?\s*(?:\^\s*(-?{_PART}))?\s*(.*)$", re.S)
        while (m := pattern.match(s)) is not None:
            before, name, base, power, rest = m[1], NAMED[m[2]], m[3], m[5], m[7]
            arg = re.match(rf"({_HELD})(?!\s*\^)", rest) or re.match(rf"({_HELD})", rest) or re.match(rf"({powered}(?:\s*(?!{_HELD}){powered})*)", rest)
            if arg is None:
                raise ValueError(name)
            inner = self.flat(arg[1])
            if power is not None and self.stood(power).replace(" ", "") == "-1" and f"a{name}" in NAMED:
                name, power = f"a{name}", None
            out = f"{name}({inner})"
            if base is not None:
                out = f"({out}/log({self.plain(base)}))"
            if power is not None:
                out = f"({out})**({'-' if power.startswith('-') else ''}{self.plain(power.lstrip('-'))})"
            after = rest[arg.end() :]
            s = before + self.done(out) + after
        s = re.sub(rf"(?<![A-Za-z\\])e\s*\^\s*(-?)({_PART})", lambda m: self.done(f"exp({m[1]}{self.plain(m[2])})"), s)
        s = re.sub(rf"\^\s*(-?)({_PART})", lambda m: "**" + self.done(f"{m[1]}{self.plain(m[2])}"), s)
        s = re.sub(rf"\\(?:{'|'.join(PRODUCT)})(?![A-Za-z])", "*", s)
        s = re.sub(rf"\\(?:{'|'.join(QUOTIENT)})(?![A-Za-z])", "/", s)
        s = re.sub(rf"\\({'|'.join(sorted(GREEK, key=len, reverse=True))})(?![A-Za-z])", lambda m: self.done(m[1]), s)
        if "\\" in s or re.search(r"[&=,^_|\x01]", s):
            raise ValueError(s)
        if re.search(rf"[ufgKy]\s*⟦\d+⟧", s):
            for m in re.finditer(rf"[ufgKy]\s*({_HELD})", s):
                if re.fullmatch(r"\s*[xts]\s*(?:,\s*\w\s*)?", self.raw[int(m[2])]):
                    raise ValueError("a function without a value")
        s = re.sub(rf"(?<![A-Za-z])([A-Za-z])(?=[A-Za-z])", r"\1*", s)
        while re.search(r"[A-Za-z][A-Za-z]", s):
            s = re.sub(r"([A-Za-z])(?=[A-Za-z])", r"\1*", s)
        s = re.sub(r"([A-Za-z\d.])\s+(?=[A-Za-z\d.])", r"\1*", s)
        s = re.sub(r"(\d)(?=[A-Za-z])|([A-Za-z])(?=\d)", lambda m: (m[1] or m[2]) + "*", s)
        s = re.sub(r"([A-Za-z\d.⟧])\s*(?=⟦)|(⟧)\s*(?=[A-Za-z\d.])", lambda m: (m[1] or m[2]) + "*", s)
        return re.sub(_HELD, lambda m: f"({self.content(int(m[1]))})", s)

    def styled(self, part: str) -> str:
        word = self.stood(part).strip()
        if word in NAMED:
            return f"\\{word} "
        if re.fullmatch("[A-Za-z]", word):
            return f" {word} "
        raise ValueError(word)

    def piecewise(self, s: str) -> str:
        pieces, other = [], None
        for row in filter(str.strip, s.split("\1")):
            value, _, condition = row.partition("&")
            value, condition = value.strip().rstrip(","), condition.strip().rstrip(".,")
            condition = re.sub(rf"\\(?:text|mathrm|textrm)({_HELD})", lambda m: " " if self.stood(m[1]).strip() not in ("otherwise", "otherwise,", "else") else "\0", condition)
            if not condition or "\0" in condition:
                pieces.append(f"({self.flat(value)}, True)")
                other = True
                continue
            parts = re.split(r"(\\(?:leqslant|leq|le|lt|geqslant|geq|ge|gt)(?![A-Za-z])|[<>])", condition)
            if len(parts) < 3:
                raise ValueError(condition)
            sides = [self.flat(p) for p in parts[::2]]
            tests = [f"({a} {RELATIONS[r]} {b})" for a, r, b in zip(sides, parts[1::2], sides[1:], strict=False)]
            pieces.append(f"({self.flat(value)}, {' & '.join(tests)})")
        if not pieces or other and "True" not in pieces[-1]:
            raise ValueError("cases")
        return f"Piecewise({', '.join(pieces)})"


def rewritten(text: str):
    """The tree of a LaTeX text by folding and rewriting; None if a command or a mark is left that no pattern knows."""
    from .expressions import parse

    for glyph, command in GLYPHS.items():
        text = text.replace(glyph, command)
    if re.search(r"\\(?:left|right)\s*\.", text) or "\u27e6" in text:
        return None
    text = re.sub(r"\\rvert(?![A-Za-z])", "\x03", re.sub(r"\\lvert(?![A-Za-z])", "\x02", SIDES[1].sub("\x03", SIDES[0].sub("\x02", text))))
    text = text.replace("\\\\", "\1")  # the end of a row of cases
    s = re.sub(rf"\\(?:{'|'.join(sorted(SKIPPED, key=len, reverse=True))})(?![A-Za-z])|\\[,;:!>]|\\ ", " ", text)
    s = s.replace("\\{", "(").replace("\\}", ")").replace("\\mathrm{d}", "d").replace("\\mathrm d", "d")
    folds = _Folds()
    try:
        while (m := _FOLD.search(s)) is not None:
            kind = m[0][0]
            s = s[: m.start()] + folds.hold(m[0][1:-1], kind) + s[m.end() :]
        return parse(folds.flat(s))
    except (ValueError, IndexError, RecursionError, KeyError):
        return None


AGREED, DIFFERENT, GRAMMAR_ONLY, REWRITTEN_ONLY, NEITHER = "agreed", "different", "grammar_only", "rewritten_only", "neither"


@lru_cache(1 << 14)
def reading(text: str) -> tuple[str, tuple | None]:
    """How the two readings of a text relate, and its tree if they agree."""
    from .canonical import sampled

    one, two = grammar(text), rewritten(text)
    if one is None or two is None:
        return NEITHER if one is two else GRAMMAR_ONLY if two is None else REWRITTEN_ONLY, None
    try:
        return (DIFFERENT, None) if any(sampled(one, two)) else (AGREED, one)
    except (ArithmeticError, ValueError, KeyError, TypeError):
        return DIFFERENT, None


def read(text: str):
    """The tree of a LaTeX text on which both readings agree; None without one."""
    return reading(text)[1]


def state(text: str) -> str:
    return reading(text)[0]


def states(*texts: Column) -> list[Column]:
    """Columns of how the two readings of each text relate; null for a null text."""
    from .expressions import _column

    how = _column(T.StringType(), state)
    return [how(c) for c in texts]
