"""Patterns of a linear-time, Unicode-aware dialect, parsed into a tree and printed for the JVM and for Python.

The dialect has no look-around, back-references, atomic groups or possessive quantifiers; its classes
and case rules are Unicode's; ``$`` without the m flag is the very end of the text. Classes may be nested, named
(``[[:digit:]]``, ASCII only), and combined by ``&&``, ``--`` and ``~~``; flags i, m, s, U, x and R hold to the end of their group.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from ..plans.model import InvalidRegex

ANY = (0, 0x10FFFF)
#: ASCII classes by name, as ranges.
_NAMED = {
    "alnum": "09AZaz", "alpha": "AZaz", "ascii": "\0\x7f", "blank": "\t\t  ", "cntrl": "\0\x1f\x7f\x7f", "digit": "09", "graph": "!~", "lower": "az",
    "print": " ~", "punct": "!/:@[`{~", "space": "\t\r  ", "upper": "AZ", "word": "09AZ__az", "xdigit": "09AFaf",
}
#: Long names of general categories.
_CATEGORIES = {
    "letter": "L", "casedletter": "LC", "uppercaseletter": "Lu", "lowercaseletter": "Ll", "titlecaseletter": "Lt", "modifierletter": "Lm", "otherletter": "Lo",
    "mark": "M", "nonspacingmark": "Mn", "spacingmark": "Mc", "enclosingmark": "Me", "number": "N", "decimalnumber": "Nd", "digit": "Nd", "letternumber": "Nl", "othernumber": "No",
    "punctuation": "P", "punct": "P", "connectorpunctuation": "Pc", "dashpunctuation": "Pd", "openpunctuation": "Ps", "closepunctuation": "Pe", "initialpunctuation": "Pi", "finalpunctuation": "Pf", "otherpunctuation": "Po",
    "symbol": "S", "mathsymbol": "Sm", "currencysymbol": "Sc", "modifiersymbol": "Sk", "othersymbol": "So", "separator": "Z", "spaceseparator": "Zs", "lineseparator": "Zl", "paragraphseparator": "Zp",
    "other": "C", "control": "Cc", "cntrl": "Cc", "format": "Cf", "surrogate": "Cs", "privateuse": "Co", "unassigned": "Cn",
}
#: Properties of one value.
_PROPERTIES = {"alphabetic": "Alphabetic", "alpha": "Alphabetic", "ideographic": "Ideographic", "lowercase": "Lowercase", "uppercase": "Uppercase", "whitespace": "White_Space", "space": "White_Space", "hexdigit": "Hex_Digit", "joincontrol": "Join_Control", "noncharactercodepoint": "Noncharacter_Code_Point", "emoji": "Emoji"}
_SHORT = {v.lower(): v for v in _CATEGORIES.values()}
#: For each class escape: the JVM's and Python's inside of a set.
_PERL = {"d": (r"\p{Nd}",) * 2, "s": (r"\p{IsWhite_Space}", r"\p{White_Space}"), "w": (r"\p{IsAlphabetic}\p{M}\p{Nd}\p{Pc}\p{IsJoin_Control}", r"\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\p{Join_Control}")}
_CONTROL = {"t": 9, "n": 10, "v": 11, "f": 12, "r": 13, "a": 7}


@dataclass(frozen=True)
class Pattern:
    source: str
    java: str
    groups: int
    may_be_empty: bool
    #: Whether group 1 takes part in every match.
    first_group_sure: bool


@dataclass(frozen=True)
class _Flags:
    i: bool = False
    m: bool = False
    s: bool = False
    U: bool = False
    x: bool = False
    R: bool = False
    u: bool = True


@dataclass(frozen=True)
class _Set:
    """A set of characters: ranges (pairs of code points), named parts (JVM, Python), sets, or one operation on two sets."""

    items: tuple = ()
    negated: bool = False
    op: str = ""

    def show(self, python: bool) -> str:
        """As a bracketed set."""
        return ("[^" if self.negated else "[") + self._inside(python) + "]"

    def _inside(self, python: bool) -> str:
        if self.op:
            a, b = (x.show(python) for x in self.items)
            if python:
                return a + self.op + b
            less = lambda x, y: f"[{x}&&[^{y}]]"
            return {"&&": f"{a}&&{b}", "--": less(a, b)[1:-1], "~~": less(a, b) + less(b, a)}[self.op]
        return "".join(_char(a, python) + (f"-{_char(b, python)}" if a != b else "") if isinstance(a, int) else (a, b)[python] for a, b in map(lambda x: (x.show(False), x.show(True)) if isinstance(x, _Set) else x, self.items)) or ("" if self.negated else "&&" if python else "a&&[^a]")


def _char(c: int, python: bool) -> str:
    if c < 128 and chr(c).isalnum():
        return chr(c)
    return (f"\\U{c:08x}" if python else f"\\x{{{c:x}}}")


class _Parser:
    """Nodes: ("set", _Set, flags), ("at", kind), ("repeat", node, least, most, lazy), ("all", nodes), ("any", nodes), ("group", node, number or 0)."""

    def __init__(self, source: str, rule: str, flags: _Flags):
        self.source, self.rule, self.i, self.flags, self.groups = source, rule, 0, flags, 0

    def fail(self, what: str):
        raise InvalidRegex(f"{self.rule}: {what}")

    def peek(self, n: int = 1) -> str:
        return self.source[self.i : self.i + n]

    def take(self, text: str) -> bool:
        if self.source.startswith(text, self.i):
            self.i += len(text)
            return True
        return False

    def blank(self) -> None:
        while self.flags.x and self.i < len(self.source) and (self.peek().isspace() or self.peek() == "#"):
            if self.take("#"):
                while self.i < len(self.source) and self.peek() != "\n":
                    self.i += 1
            else:
                self.i += 1

    def parse(self):
        node = self.either()
        if self.i < len(self.source):
            self.fail("a parenthesis is closed that is not open")
        return node

    def either(self):
        outer, ways = self.flags, [[]]
        while True:
            self.blank()
            c = self.peek()
            if not c or c == ")":
                break
            if self.take("|"):
                ways.append([])
            elif c in "*+?" or (c == "{" and not ways[-1]):
                if not ways[-1] or ways[-1][-1][0] == "flags":
                    self.fail("a repetition of nothing")
                ways[-1].append(self.repeated(ways[-1].pop()))
            elif c == "{":
                ways[-1].append(self.repeated(ways[-1].pop()))
            else:
                node = self.atom()
                if node is not None:
                    ways[-1].append(node)
        self.flags = outer
        nodes = [("all", w) for w in ways]
        return nodes[0] if len(nodes) == 1 else ("any", nodes)

    def repeated(self, node):
        c = self.peek()
        self.i += 1
        if c == "{":
            m = re.compile(r"\s*(\d+)\s*(?:(,)\s*(\d*)\s*)?\}").match(self.source, self.i)
            if not m:
                self.fail("a counted repetition that cannot be read")
            self.i = m.end()
            least = int(m[1])
            most = None if m[2] and not m[3] else int(m[3]) if m[2] else least
            if most is not None and most < least or least > 1000 or (most or 0) > 1000:
                self.fail("a counted repetition out of range")
        else:
            least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
        lazy = self.take("?")
        if self.peek() == "+":
            self.fail("possessive quantifiers are not supported")
        return ("repeat", node, least, most, lazy != self.flags.U)

    def atom(self):
        c = self.peek()
        self.i += 1
        if c == "(":
            return self.group()
        if c == "[":
            return ("set", self.set_(), self.flags)
        if c == ".":
            return ("set", _Set((ANY,)) if self.flags.s else _Set(((10, 10), *([(13, 13)] if self.flags.R else [])), True), replace(self.flags, i=False))
        if c in "^$":
            return ("at", ("line " if self.flags.m else "") + ("start" if c == "^" else "end"))
        if c == "\\":
            c = self.peek()
            if c in ("A", "z", "b", "B"):
                self.i += 1
                if c == "b" and self.peek() == "{":
                    self.fail("half word boundaries are not supported")
                return ("at", {"A": "start", "z": "end"}.get(c, c))
            if c in ("<", ">"):
                self.fail("half word boundaries are not supported")
            found = self.escape()
            return ("set", found if isinstance(found, _Set) else _Set(((found, found),)), self.flags)
        return ("set", _Set(((ord(c), ord(c)),)), self.flags)

    def group(self):
        number, outer = 0, self.flags
        if self.take("?"):
            m = re.compile(r"P?<([A-Za-z_][A-Za-z0-9_.\[\]]*)>").match(self.source, self.i)
            if m:
                self.i = m.end()
                self.groups += 1
                number = self.groups
            else:
                m = re.compile(r"([imsUuxR]*)(?:-([imsUuxR]+))?([:)])").match(self.source, self.i)
                if not m or (m[3] == ")" and not m[1] and not m[2]):
                    self.fail("look-around and atomic groups are not supported")
                self.i = m.end()
                self.flags = replace(self.flags, **dict.fromkeys(m[1], True), **dict.fromkeys(m[2] or "", False))
                if not self.flags.u:
                    self.fail("patterns of bytes are not supported")
                if m[3] == ")":
                    return None  # holds to the end of the group around
        else:
            self.groups += 1
            number = self.groups
        node = self.either()
        if not self.take(")"):
            self.fail("a parenthesis is not closed")
        self.flags = outer
        return ("group", node, number)

    def escape(self):
        """A code point, or a set."""
        c = self.peek()
        if not c:
            self.fail("ends with a backslash")
        self.i += 1
        if c in _CONTROL:
            return _CONTROL[c]
        if c in "xuU":
            m = re.compile(r"\{([0-9A-Fa-f]{1,8})\}|([0-9A-Fa-f]{%d})" % {"x": 2, "u": 4, "U": 8}[c]).match(self.source, self.i)
            if not m or int(m[1] or m[2], 16) > ANY[1]:
                self.fail(f"\\{c} without a character's number")
            self.i = m.end()
            return int(m[1] or m[2], 16)
        if c.lower() in _PERL:
            return _Set((_PERL[c.lower()],), c.isupper())
        if c in "pP":
            m = re.compile(r"\{(\^?)([^{}]+)\}|()([A-Za-z])").match(self.source, self.i)
            if not m:
                self.fail(f"\\{c} without a name")
            self.i = m.end()
            return _Set((self.property(m[2] or m[4]),), (c == "P") != bool(m[1]))
        if c in "123456789k":
            self.fail("back-references are not supported")
        if c.isalnum() or ord(c) > 127:
            self.fail(f"unknown escape \\{c}")
        return ord(c)

    def property(self, name: str):
        """The JVM's and Python's form of a property."""
        import regex

        kind, _, value = name.replace("!=", "=").replace(":", "=").rpartition("=")
        plain = re.sub(r"[\s_-]", "", value).lower()
        if kind.strip().lower() in ("", "gc", "general_category", "generalcategory"):
            if plain == "any":
                return (r"\x{0}-\x{10ffff}", r"\x00-\U0010ffff")
            if plain == "ascii":
                return (r"\x{0}-\x{7f}", r"\x00-\x7f")
            if plain == "assigned":
                return (r"\P{Cn}",) * 2
            short = _SHORT.get(plain) or _CATEGORIES.get(plain)
            if short:
                return (rf"\p{{{short}}}", r"\p{Lu}\p{Ll}\p{Lt}" if short == "LC" else rf"\p{{{short}}}")
            if plain in _PROPERTIES:
                return (rf"\p{{Is{_PROPERTIES[plain]}}}", rf"\p{{{_PROPERTIES[plain]}}}")
        elif kind.strip().lower() not in ("sc", "script", "scx", "script_extensions", "scriptextensions"):
            self.fail(f"unknown property {name!r}")
        script = value.strip().replace(" ", "_").replace("-", "_")
        try:
            regex.compile(rf"\p{{Script={script}}}")
        except regex.error:
            self.fail(f"unknown property {name!r}")
        return (rf"\p{{script={script}}}", rf"\p{{Script={script}}}")

    def set_(self) -> _Set:
        """Behind the opening bracket, through the closing one."""
        negated, items, left, op = self.take("^"), [], None, ""
        first = True
        while True:
            self.blank()
            c = self.peek()
            if not c:
                self.fail("a class is not closed")
            if c == "]" and not first:
                self.i += 1
                break
            first = False
            if self.peek(2) in ("&&", "--", "~~"):
                right = _Set(tuple(items))
                left = right if left is None else _Set((left, right), op=op)
                op, items = self.peek(2), []
                self.i += 2
                continue
            m = re.compile(r"\[:(\^?)(\w+):\]").match(self.source, self.i)
            if m and m[2] in _NAMED:
                self.i = m.end()
                named = _NAMED[m[2]]
                items.append(_Set(tuple((ord(a), ord(b)) for a, b in zip(named[::2], named[1::2])), bool(m[1])))
                continue
            self.i += 1
            if c == "[":
                items.append(self.set_())
                continue
            low = self.escape() if c == "\\" else ord(c)
            if isinstance(low, _Set):
                items.append(low)
                continue
            if self.peek() == "-" and self.peek(2) not in ("-]", "--") and len(self.peek(2)) == 2:
                self.i += 1
                c = self.peek()
                self.i += 1
                high = self.escape() if c == "\\" else ord(c)
                if isinstance(high, _Set) or high < low:
                    self.fail("a range that ends before it starts")
                items.append((low, high))
            else:
                items.append((low, low))
        right = _Set(tuple(items))
        if left is None:
            return replace(right, negated=negated)
        return _Set((left, right), negated, op)


_AT = {"start": (r"\A",) * 2, "end": (r"\z", r"\Z"), "line start": (r"(?<![^\x{a}])", r"(?<![^\n])"), "line end": (r"(?![^\x{a}])", r"(?![^\n])"), "b": (r"\b",) * 2, "B": (r"\B",) * 2}


def _show(node, python: bool) -> str:
    kind = node[0]
    if kind == "set":
        one = node[1]
        lone = not one.negated and not one.op and len(one.items) == 1 and isinstance(one.items[0], tuple) and isinstance(one.items[0][0], int) and one.items[0][0] == one.items[0][1]
        text = _char(one.items[0][0], python) if lone else one.show(python)
        if one.negated and one.op:
            text = f"(?:(?!{replace(one, negated=False).show(python)})(?s:.))"
        return f"(?i:{text})" if node[2].i else text
    if kind == "at":
        return _AT[node[1]][python]
    if kind == "repeat":
        _, inner, least, most, lazy = node
        count = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((least, most)) or (f"{{{least}}}" if least == most else f"{{{least},{'' if most is None else most}}}")
        text = _show(inner, python)
        return (text if inner[0] == "group" else f"(?:{text})") + count + ("?" if lazy else "")
    if kind == "all":
        return "".join(_show(x, python) for x in node[1])
    if kind == "any":
        return "|".join(_show(x, python) for x in node[1])
    return ("(" if node[2] else "(?:") + _show(node[1], python) + ")"


def _least(node) -> int:
    """The fewest characters that the node matches."""
    kind = node[0]
    if kind == "set":
        return 1
    if kind == "at":
        return 0
    if kind == "repeat":
        return node[2] * _least(node[1])
    if kind in ("all", "any"):
        return (sum if kind == "all" else min)(_least(x) for x in node[1]) if node[1] else 0
    return _least(node[1])


def _sure(node) -> bool:
    """Whether group 1 takes part in every match of the node."""
    kind = node[0]
    if kind == "repeat":
        return node[2] > 0 and _sure(node[1])
    if kind == "all":
        return any(map(_sure, node[1]))
    if kind == "any":
        return all(map(_sure, node[1])) and bool(node[1])
    return kind == "group" and (node[2] == 1 or _sure(node[1]))


def _tree(source: str, rule: str, ignore_case: bool):
    p = _Parser(source, rule, _Flags(i=ignore_case))
    return p.parse(), p.groups


def translate(source: str, rule: str = "pattern", ignore_case: bool = False) -> Pattern:
    tree, groups = _tree(source, rule, ignore_case)
    return Pattern(source, "(?Uu)" + _show(tree, False), groups, not _least(tree), groups == 0 or _sure(tree))


def python_pattern(source: str, ignore_case: bool = False):
    """The same matches in Python."""
    import regex

    return regex.compile(_show(_tree(source, "pattern", ignore_case)[0], True), regex.V1)


def literal(text: str, ignore_case: bool = False) -> Pattern:
    """A pattern for exactly this text."""
    escaped = "".join(_char(ord(c), False) if ord(c) < 128 else c for c in text)
    return Pattern(re.escape(text), ("(?iu)" if ignore_case else "") + escaped, 0, not text, True)


def as_replacement(text: str) -> str:
    """A replacement in which nothing is special."""
    return text.replace("\\", "\\\\").replace("$", "\\$")
