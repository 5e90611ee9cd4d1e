"""A light front end for C++ text: one row per declaration found at namespace or class level.

It reads tokens, not types: comments, strings, raw strings, character literals and preprocessor lines are told apart,
scopes are followed by braces, and bodies of functions are skipped but for the macros defined in them. Lines end at CR LF, LF or CR. It never fails:
what it can't read is skipped.
"""

from __future__ import annotations

import ast
import bisect
import operator
import re
from typing import NamedTuple

#: Fixed value: declarations nested deeper than this are passed over.
DEEPEST = 30

_TOKEN = re.compile(
    r"""(?P<comment>//(?:\\\n|[^\n])*|/\*.*?(?:\*/|\Z))|(?P<pre>^[ \t\f]*\#(?:\\\n|//.*?$|/\*.*?\*/|[^\n])*)"""
    r"""|(?P<raw>(?:u8|[uUL])?R"(?P<d>[^()\\\s]{0,16})\(.*?\)(?P=d)")|(?P<str>"(?:\\.|[^"\\\n])*"?)|(?P<chr>(?<![0-9A-Fa-f])'(?:\\.|[^'\\\n])*'?)"""
    r"""|(?P<word>[^\W\d]\w*)|(?P<num>\d[\w.']*)|(?P<op>::|->|\[\[|\]\]|[^\s\w])""",
    re.S | re.M | re.X,
)


#: Skips a body: only what can hide a bracket is told apart.
_BRACKET = re.compile(r"""[{}]|(?P<pre>^[ \t\f]*\#(?:\\\n|//(?:\\\n|[^\n])*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|[^\n])*)|//(?:\\\n|[^\n])*|/\*.*?(?:\*/|\Z)|(?:u8|[uUL])?R"(?P<d>[^()\\\s]{0,16})\(.*?\)(?P=d)"|"(?:\\.|[^"\\\n])*"?|(?<![0-9A-Fa-f])'(?:\\.|[^'\\\n])*'?""", re.S | re.M)
_DIRECTIVE = re.compile(r"\s*#\s*(\w*)\s*(.*)", re.S)
_DEFINE = re.compile(r"\s*#\s*define\s+(\w+)(\(?)(.*)", re.S)


def passed_over(depth: int, directive: str) -> int:
    """How many conditions are open from an `#if 0` on, after a preprocessor line; 0 where the text counts."""
    word = _DIRECTIVE.match(directive)
    if not depth:
        return int(word[1] == "if" and re.match(r"(0|false)\b", word[2]) is not None)
    depth += word[1].startswith("if") - (word[1] == "endif")
    return 0 if depth == 1 and word[1] in ("else", "elif") else depth


class Declaration(NamedTuple):
    """`kind`: function, class, enum, macro or typedef; `comment`: the one directly before; `inline`: those at line ends."""

    kind: str
    qualified_name: str
    line: int
    end_line: int
    signature: str
    is_definition: bool
    comment: str
    inline: str
    bases: str
    detail: str


class _Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int


def clean_lines(text: str) -> str:
    """The text without a byte order mark, with LF at each line end."""
    return text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")


def _spaced(tokens: list[_Token]) -> str:
    if len(tokens) == 1:
        return tokens[0].text
    out = " ".join(t.text for t in tokens)
    out = re.sub(r"\s*(::|->|[()<>\[\],;&*~])\s*", r"\1", out)
    return re.sub(r"(?<=[,>&*])(?=\w)", " ", out).strip()


#: Words with which what `_bare` leaves out begins.
_DRESSED = frozenset(("template", "[[", "alignas", "__attribute__", "__declspec", "requires"))


def _bare(tokens: list[_Token]) -> list[_Token]:
    """The tokens without template heads, attributes and alignment."""
    if not any(t.text in _DRESSED for t in tokens):
        return tokens.copy()
    out, i = [], 0
    while i < len(tokens):
        t = tokens[i].text
        nxt = tokens[i + 1].text if i + 1 < len(tokens) else ""
        pair = ("<", ">") if t == "template" and nxt == "<" else ("(", ")") if t in ("alignas", "__attribute__", "__declspec", "requires") and nxt == "(" else None
        if t == "[[":
            while i < len(tokens) and tokens[i].text != "]]":
                i += 1
        elif pair:
            depth, inner, i = 0, 0, i + 1
            while i < len(tokens):
                inner += (tokens[i].text in "([") - (tokens[i].text in ")]") if pair[0] == "<" else 0
                depth += (tokens[i].text == pair[0]) - (tokens[i].text == pair[1]) if not inner else 0
                if not depth:
                    break
                i += 1
        else:
            out.append(tokens[i])
        i += 1
    return out


def _function(tokens: list[_Token]) -> tuple[list[_Token], int, int] | None:
    """The name's tokens, its place, and the place of the opening bracket of the parameters."""
    depth = 0
    for i, t in enumerate(tokens):
        if t.text == "operator":
            j = i + 1
            while j < len(tokens) and (tokens[j].text != "(" or (j == i + 1 and tokens[j + 1 : j + 2] and tokens[j + 1].text == ")")):
                j += 2 if tokens[j].text == "(" else 1
            first = i
        elif t.text == "<" and i and tokens[i - 1].kind == "word":
            depth += 1
            continue
        elif t.text == ">" and depth:
            depth -= 1
            continue
        elif t.text == "=" and not depth:
            return None
        elif t.text == "(" and not depth:
            j, first = i, i - 1
            if first < 0 or tokens[first].kind != "word":
                return None
            if first and tokens[first - 1].text == "~":
                first -= 1
        else:
            continue
        while first >= 2 and tokens[first - 1].text == "::":
            back = first - 2
            if tokens[back].text == ">":
                level = 0
                while back >= 0:
                    level += (tokens[back].text == ">") - (tokens[back].text == "<")
                    if not level:
                        break
                    back -= 1
                back -= 1
            if back < 0 or tokens[back].kind != "word":
                break
            first = back
        return (tokens[first:j], first, j) if j < len(tokens) else None
    return None


#: What the values of enumerations may be computed with.
_UNARY = {ast.UAdd: operator.pos, ast.USub: operator.neg, ast.Invert: operator.invert, ast.Not: lambda x: int(not x)}
_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.LShift: operator.lshift, ast.RShift: operator.rshift, ast.BitOr: operator.or_, ast.BitAnd: operator.and_, ast.BitXor: operator.xor}
_BINARY |= {ast.FloorDiv: lambda a, b: abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1), ast.Mod: lambda a, b: abs(a) % abs(b) * (-1 if a < 0 else 1)}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}


def _number(token: str) -> int | None:
    """The value of an integer or character literal."""
    if token[0] == "'" and token[-1] == "'":
        inner = token[1:-1]
        if inner[:1] == "\\":
            return int(inner[2:], 16) if inner[1:2] == "x" else int(inner[1:], 8) if inner[1:].isdigit() else ord(_ESCAPES.get(inner[1:], inner[1:2]))
        return ord(inner) if len(inner) == 1 else None
    plain = re.sub(r"(?i)[ul]+$", "", token.replace("'", ""))
    if re.fullmatch(r"0[xX][0-9a-fA-F]+|0[bB][01]+|[1-9]\d*|0", plain):
        return int(plain, 0)
    return int(plain, 8) if re.fullmatch(r"0[0-7]+", plain) else None


def constant(tokens: list[str], known: dict[str, int]) -> int | None:
    """The value of an integer expression over literals and known members; None if it can't be told from the text."""
    out, k = [], 0
    while k < len(tokens):
        t = tokens[k]
        if t[0].isdigit() or t[0] == "'":
            value = _number(t)
        elif t[0].isalpha() or t[0] == "_":
            while tokens[k + 1 : k + 2] == ["::"] and k + 2 < len(tokens):
                k += 2
            value = known.get(tokens[k], {"true": 1, "false": 0}.get(tokens[k]))
        else:
            out.append({"/": "//", "!": "not "}.get(t, t))
            k += 1
            continue
        if value is None:
            return None
        out.append(f"({value})")
        k += 1

    def of(node: ast.AST) -> int:
        if isinstance(node, ast.Expression):
            return of(node.body)
        if isinstance(node, ast.Constant) and isinstance(node.value, int):
            return node.value
        if isinstance(node, ast.UnaryOp):
            return _UNARY[type(node.op)](of(node.operand))
        if isinstance(node, ast.BinOp):
            return _BINARY[type(node.op)](of(node.left), of(node.right))
        raise ValueError(node)

    try:
        text = "".join(out).replace("< <", "<<").replace("> >", ">>")
        return of(ast.parse(text, mode="eval"))
    except (SyntaxError, ValueError, KeyError, ZeroDivisionError, OverflowError, RecursionError):
        return None


def enum_members(inner: str, first_line: int) -> list[tuple[str, int, str]]:
    """(name, line, value) of each member of an enumeration's text between its braces, which begins on `first_line`.

    A member without a value is one more than the one before; a value that can't be computed stays as written.
    """
    out: list[tuple[str, int, str]] = []
    known: dict[str, int] = {}
    part: list[tuple[str, int]] = []
    depth, before, base = 0, -1, ""

    def add() -> None:
        nonlocal before, base
        words = [w for w, _ in part]
        while words[:1] == ["[["]:  # attributes
            words = words[words.index("]]") + 1 :] if "]]" in words else []
        name = next(((w, line) for w, line in part if words and w == words[0]), None)
        if name is None or not re.match(r"[A-Za-z_]", name[0]):
            return
        if "=" in words:
            given = words[words.index("=") + 1 :]
            value = constant(given, known)
            base, before = ("", value) if value is not None else ("".join(given), 0)
        else:
            before += 1
        text = str(before) if not base else base if not before else f"{base} + {before}"
        if not base:
            known[name[0]] = before
        out.append((name[0], name[1], text))

    for m in _TOKEN.finditer(inner):
        if m.lastgroup in ("comment", "pre"):
            continue
        w = m.group()
        depth += (w in ("(", "{", "[")) - (w in (")", "}", "]"))
        if w == "," and depth <= 0:
            add()
            part.clear()
        else:
            part.append((w, first_line + inner.count("\n", 0, m.start())))
    add()
    return out


def declarations(text: str | None, linkage_blocks: bool = True) -> list[Declaration]:
    """All declarations of one file, in their order; without those in `extern "C" { }` if linkage_blocks is off."""
    if not text:
        return []
    text = clean_lines(text)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line = lambda at: bisect.bisect_right(starts, at)
    tokens: list[_Token] = []
    source, skipping = _TOKEN.finditer(text), 0

    def have(i: int) -> bool:
        """Reads on until there is a token i; whether there is one."""
        nonlocal skipping
        while len(tokens) <= i:
            m = next(source, None)
            if m is None:
                return False
            kind = m.lastgroup
            if kind == "d":
                kind = "raw"
            elif kind == "pre":
                was = skipping
                skipping = passed_over(skipping, m.group())
                if was:
                    continue
            elif skipping:
                continue
            tokens.append(_Token(kind, m.group(), m.start(), m.end()))
        return True

    out: list[Declaration] = []
    scopes: list[tuple[str, str]] = []
    head: list[_Token] = []
    before: list[_Token] = []  # comments directly before the head
    inside: list[_Token] = []  # comments within it
    within: list[Declaration] = []  # macros of the body just skipped
    last_line, i = 0, 0

    def qualified(name: str) -> str:
        return "::".join([s for k, s in scopes if s] + [name])

    def comment_before() -> str:
        """The last block of comments that stand on lines of their own, one under the other."""
        block: list[str] = []
        at = None
        for t in reversed(before):
            if at is not None and (line(t.end - 1) < at - 1 or not t.text.startswith("//") or not block[0].startswith("//")):
                break
            block.insert(0, t.text)
            at = line(t.start)
        return "\n".join(block)

    def skip(opened: _Token, i: int) -> int:
        """Makes the bracket that closes `opened` token i, and reads on behind it."""
        nonlocal source, skipping
        depth, end, skipping = 0, len(text), 0  # what was read ahead is read again
        for m in _BRACKET.finditer(text, opened.start):
            c = m.group()
            if m.lastgroup == "pre":
                if not skipping and (d := _DEFINE.match(c)):
                    within.append(macro(d, m.start(), m.end(), ""))
                skipping = passed_over(skipping, c)
            elif c in "{}" and not skipping:
                depth += 1 if c == "{" else -1
                if not depth:
                    end = m.end()
                    break
        del tokens[i:]
        tokens.append(_Token("op", "}", max(opened.end, end - 1), end))
        source = _TOKEN.finditer(text, end)
        return i

    def macro(m: re.Match[str], at: int, end: int, comment: str) -> Declaration:
        return Declaration("macro", m[1], line(at), line(end), "", True, comment, "", "", ("(" if m[2] else "") + re.sub(r"//.*|/\*.*?\*/", "", m[3], flags=re.S).strip())

    def add(kind: str, name: str, at: int, end: int, signature: str, definition: bool, bases: str = "", detail: str = "") -> None:
        if len(scopes) > DEEPEST or (not linkage_blocks and ("extern", "") in scopes):
            return
        ends = "\n".join(t.text for t in inside if text[t.end : t.end + 1] in ("\n", "") or t.text.startswith("//"))
        out.append(Declaration(kind, name, line(at), line(end), signature, definition, comment_before(), ends, bases, detail))

    def trailing(i: int) -> int:
        """Takes the comments in the rest of the line of token i as part of the head; gives the place before the next token."""
        while have(i + 1) and tokens[i + 1].kind == "comment" and line(tokens[i + 1].start) == line(tokens[i].end - 1):
            i += 1
            inside.append(tokens[i])
        return i

    def reset(at: int) -> None:
        nonlocal last_line
        head.clear(), before.clear(), inside.clear()
        out.extend(within), within.clear()
        last_line = line(at)

    while i < len(tokens) or have(i):
        t = tokens[i]
        if t.kind == "word":
            head.append(t)
        elif t.kind == "comment":
            if head:
                inside.append(t)
            elif line(t.start) != last_line:
                before.append(t)
        elif t.kind == "pre":
            if m := _DEFINE.match(t.text):
                out.append(macro(m, t.start, t.end, "" if head else comment_before()))
            if not head:
                reset(t.end - 1)
        elif t.text == "}" and t.kind == "op":
            if scopes:
                scopes.pop()
            reset(t.end - 1)
        elif t.text == ":" and len(head) == 1 and head[0].text in ("public", "private", "protected", "signals", "slots"):
            reset(t.end - 1)
        elif t.text == ";" and t.kind == "op":
            i = trailing(i)
            bare = _bare(head)
            if bare and bare[0].text in ("typedef", "using"):
                words = [w for w in bare if w.kind == "word"]
                if bare[0].text == "using" and len(bare) > 3 and bare[2].text == "=":
                    add("typedef", qualified(bare[1].text), bare[1].start, t.end, "", True, "", _spaced(bare[3:]))
                elif bare[0].text == "typedef" and len(words) > 2:
                    add("typedef", qualified(words[-1].text), words[-1].start, t.end, "", True, "", _spaced(bare[1 : bare.index(words[-1])]))
            elif bare and bare[0].text not in ("friend", "return", "enum") and (f := _function(bare)) and (f[1] or scopes):
                add("function", qualified(_spaced(f[0])), f[0][-1].start if f[0][0].text != "operator" else f[0][0].start, t.end, _spaced(bare), False)
            reset(t.end - 1)
        elif t.text == "{" and t.kind == "op":
            bare = _bare(head)
            words = [w.text for w in bare]
            f = None
            if "namespace" in words and "(" not in words:
                name = "".join(w for w in words[words.index("namespace") + 1 :] if w != "inline")
                scopes.append(("namespace", name))
                reset(t.end - 1)
            elif words[:1] == ["extern"] and len(words) == 2:
                scopes.append(("extern", ""))
                reset(t.end - 1)
            elif "enum" in words[:2]:
                close = skip(t, i + 1)
                names = [w for w in words[words.index("enum") + 1 :] if w not in ("class", "struct")]
                inner = text[t.end : tokens[close].start]
                if names and names[0] != ":":
                    add("enum", qualified(names[0]), next(w.start for w in bare if w.text == names[0]), tokens[close].start, "", True, "", inner)
                i = close
                reset(tokens[i].end - 1)
            elif f := _function(bare):
                opened = words.index("(", f[2])
                tail, colon, depth = words[opened:], -1, 0
                for k, w in enumerate(tail):
                    depth += (w == "(") - (w == ")")
                    if w == ":" and not depth:
                        colon = k
                        break
                if colon >= 0 and tokens[i - 1].kind in ("word",) or colon >= 0 and tokens[i - 1].text == ">":
                    i = skip(t, i + 1)  # a member initialised in braces
                    head.extend(tokens[i - 1 : i + 1])
                    i += 1
                    continue
                i = trailing(i)
                close = skip(t, i + 1)
                sign = bare[: opened + colon] if colon >= 0 else bare
                name_at = f[0][0] if f[0][0].text == "operator" or "operator" in [x.text for x in f[0]] else f[0][-1]
                add("function", qualified(_spaced(f[0])), name_at.start, tokens[close].end - 1, _spaced(sign), True, "", text[t.start : tokens[close].end])
                i = close
                reset(tokens[i].end - 1)
            elif any(w in ("class", "struct", "union") for w in words) and "=" not in words:
                k = next(k for k, w in enumerate(words) if w in ("class", "struct", "union"))
                rest = [w for w in words[k + 1 :] if w != "final"]
                cut = rest.index(":") if ":" in rest else len(rest)
                name = "".join(rest[:cut]) or ""
                bases = " ".join(w for w in rest[cut + 1 :] if w not in ("public", "private", "protected", "virtual"))
                add("class", qualified(name), t.start, t.end, "", True, re.sub(r"\s*(::|<|>)\s*", r"\1", bases))
                scopes.append(("class", name.split("<")[0]))
                reset(t.end - 1)
            else:  # an initialiser or something unknown
                i = skip(t, i + 1)
                head.append(tokens[i])
        else:
            head.append(t)
        i += 1
    return out + within
