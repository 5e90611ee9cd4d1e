"""Control-flow graphs of function bodies.

Each file's definitions come from the light C++ front end; files are spread over tasks and every function is built on its
own. A statement yields a flow: where it is entered, which nodes are still open to whatever follows (with the label of
that way), and which return, break or continue. Errors of one function become a row, not a failure.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgrain.sources.cpp import Declaration, _TOKEN, clean_lines, declarations

NODE_SCHEMA = "file string, ord int, line int, qualified_name string, error string, nodes array<struct<node_id:string,node_seq:int,node_type:string,raw_code:string,start_line:int,end_line:int>>, edges array<struct<edge_ord:int,source:string,target:string,label:string>>"
_CONTROL = ("if", "for", "while", "do", "switch", "return", "break", "continue", "try")


@dataclass
class Flow:
    entry: str | None = None
    open: list[tuple[str, str | None]] = field(default_factory=list)
    returns: list[str] = field(default_factory=list)
    breaks: list[str] = field(default_factory=list)
    continues: list[str] = field(default_factory=list)


def segments(sizes: list[int], most: int, most_lines: int) -> list[int]:
    """The segment of each statement, from its number of lines: a new one begins when the current is full."""
    out, number, count, height = [], 0, 0, 0
    for size in sizes:
        if count and (count >= most or height + size > most_lines):
            number, count, height = number + 1, 0, 0
        out.append(number)
        count, height = count + 1, height + size
    return out


class Graph:
    """The graph of one body, read from its text; lines count from `line`."""

    def __init__(self, text: str, line: int, most: int = 5, most_lines: int = 10, whole_cases: bool = False):
        self.text, self.most, self.most_lines, self.whole_cases = text, most, most_lines, whole_cases
        self.tokens = [m for m in _TOKEN.finditer(text) if m.lastgroup not in ("comment", "pre")]
        self.words = [m.group() for m in self.tokens]
        self.line_of = [line + text.count("\n", 0, m.start()) for m in self.tokens]
        self.nodes: list[tuple] = []
        self.edges: list[tuple] = []

    def node(self, kind: str, code: str, first: int, last: int) -> str:
        name = f"N{len(self.nodes) + 1}"
        self.nodes.append((name, len(self.nodes) + 1, kind, code.strip(), first, last))
        return name

    def edge(self, source: str, target: str, label: str | None = None) -> None:
        self.edges.append((len(self.edges), source, target, label))

    def join(self, ways: list[tuple[str, str | None]], target: str) -> None:
        for source, label in ways:
            self.edge(source, target, label)

    def close(self, i: int) -> int:
        """The place of the bracket that closes the one at i."""
        pairs, depth = {"(": ")", "{": "}", "[": "]"}, 0
        for k in range(i, len(self.words)):
            w = self.words[k]
            if self.tokens[k].lastgroup == "op":
                depth += (w in pairs) - (w in pairs.values())
            if not depth:
                return k
        return len(self.words) - 1

    def code(self, i: int, j: int) -> str:
        """The source of tokens i to j."""
        lines = self.text[self.tokens[i].start() : self.tokens[j].end()].split("\n") if i <= j < len(self.tokens) else [""]
        return "\n".join(x.rstrip() for x in lines)

    def end(self, i: int) -> int:
        """The last token of the statement that begins at i."""
        w = self.words[i]
        if w == "{":
            return self.close(i)
        if w in ("if", "for", "while", "switch"):
            j = self.end(self.close(self.head(i)) + 1)
            return self.end(j + 2) if w == "if" and self.words[j + 1 : j + 2] == ["else"] else j
        if w == "do":
            j = self.end(i + 1)
            return min(self.close(j + 2) + 1, len(self.words) - 1) if self.words[j + 1 : j + 2] == ["while"] else j
        if w == "try":
            j = self.end(i + 1)
            while self.words[j + 1 : j + 2] == ["catch"]:
                j = self.end(self.close(j + 2) + 1)
            return j
        k = i
        while k < len(self.words) - 1 and self.words[k] != ";":
            if self.words[k] == "}":
                return max(i, k - 1)
            k = self.close(k) + 1 if self.words[k] in "({[" else k + 1
        return min(k, len(self.words) - 1)

    def head(self, i: int) -> int:
        """The opening bracket of a condition."""
        while i < len(self.words) - 1 and self.words[i] != "(":
            i += 1
        return i

    def block(self, i: int, stop: int) -> Flow:
        """Statements from token i up to, not including, stop."""
        flow, plain = Flow(), []

        def flush() -> None:
            sizes = [self.line_of[b] - self.line_of[a] + 1 for a, b in plain]
            groups: dict[int, list[tuple[int, int]]] = {}
            for span, g in zip(plain, segments(sizes, self.most, self.most_lines)):
                groups.setdefault(g, []).append(span)
            for spans in groups.values():
                name = self.node("ACTION", "\n".join(self.code(a, b) for a, b in spans), self.line_of[spans[0][0]], self.line_of[spans[-1][1]])
                self.join(flow.open, name)
                flow.entry, flow.open = flow.entry or name, [(name, None)]
            plain.clear()

        while i < stop:
            j = self.end(i)
            if self.words[i] == ";":
                pass
            elif self.words[i] in _CONTROL:
                flush()
                part = self.statement(i, j)
                if part.entry:
                    self.join(flow.open, part.entry)
                    flow.entry = flow.entry or part.entry
                flow.open = part.open
                flow.returns += part.returns
                flow.breaks += part.breaks
                flow.continues += part.continues
            else:
                plain.append((i, j))
            i = j + 1
        flush()
        return flow

    def statement(self, i: int, j: int) -> Flow:
        """One statement of tokens i to j."""
        w = self.words[i]
        if w == "{":
            return self.block(i + 1, j)
        if w == "if":
            return self.decision(i)
        if w in ("for", "while"):
            a = self.head(i)
            b = self.close(a)
            code = self.code(i, b) if w == "for" else self.code(a + 1, b - 1)
            loop = self.node("LOOP_HEAD", code, self.line_of[i], self.line_of[i] if w == "for" else self.line_of[b])
            return self.loop(loop, self.statement(b + 1, j), loop)
        if w == "do":
            k = self.end(i + 1)
            body = self.statement(i + 1, k)
            a = self.head(k)
            b = self.close(a)
            loop = self.node("LOOP_HEAD", f"do-while: {self.code(a + 1, b - 1)}", self.line_of[a], self.line_of[b])
            return self.loop(loop, body, body.entry)
        if w == "switch":
            return self.switch(i, j)
        if w == "try":
            return self.attempt(i, j)
        code = w if w in ("break", "continue") else self.code(i, j - 1 if self.words[j] == ";" and w == "return" else j)
        name = self.node(w.upper() if w in _CONTROL else "ACTION", code, self.line_of[i], self.line_of[j])
        return Flow(name, [] if w in _CONTROL else [(name, None)], [name] * (w == "return"), [name] * (w == "break"), [name] * (w == "continue"))

    def decision(self, i: int) -> Flow:
        a = self.head(i)
        b = self.close(a)
        name = self.node("DECISION", self.code(a + 1, b - 1), self.line_of[a], self.line_of[b])
        k = self.end(b + 1)
        yes = self.statement(b + 1, k)
        if yes.entry:
            self.edge(name, yes.entry, "Yes")
        if self.words[k + 1 : k + 2] != ["else"]:
            return Flow(name, [(name, "No"), *yes.open], yes.returns, yes.breaks, yes.continues)
        no = self.statement(k + 2, self.end(k + 2))
        if no.entry:
            self.edge(name, no.entry, "No")
        return Flow(name, yes.open + no.open, yes.returns + no.returns, yes.breaks + no.breaks, yes.continues + no.continues)

    def loop(self, head: str, body: Flow, entry: str | None) -> Flow:
        """What follows a loop; a body that was read before its head leads on to it."""
        before = entry != head
        if body.entry and not before:
            self.edge(head, body.entry, "Yes")
        self.join([*body.open, *((n, None) for n in body.continues)], head)
        if body.entry and before:
            self.edge(head, body.entry, "Yes")
        return Flow(entry, [(head, "No"), *((n, None) for n in body.breaks)], body.returns)

    def switch(self, i: int, j: int) -> Flow:
        a = self.head(i)
        b = self.close(a)
        name = self.node("SWITCH_HEAD", self.code(a + 1, b - 1), self.line_of[a], self.line_of[b])
        out, falling = Flow(name), []
        k = b + 2
        while k < j:
            if self.words[k] not in ("case", "default"):
                k = self.end(k) + 1
                continue
            colon = k
            while self.words[colon] != ":":
                colon += 1
            value = self.code(k + 1, colon - 1) if self.words[k] == "case" else "default"
            one = self.node("CASE" if self.words[k] == "case" else "DEFAULT_CASE", value, self.line_of[k], self.line_of[k])
            self.edge(name, one, f"case {value}" if self.words[k] == "case" else "default")
            self.join(falling, one)
            last = colon + 1
            while last < j and self.words[last] not in ("case", "default"):
                last = self.end(last) + 1
                if not self.whole_cases:
                    break
            nested = not self.whole_cases and self.words[colon + 1] in ("case", "default")
            part = Flow() if nested else self.block(colon + 1, min(last, j))
            if part.entry:
                self.edge(one, part.entry)
            falling = [] if nested else part.open if part.entry else [(one, None)]
            if nested:  # the inner label belongs to this one, and nothing of it is kept
                while self.words[last] in ("case", "default"):
                    while self.words[last] != ":":
                        last += 1
                    last += 1
                last = self.end(last) + 1
            out.returns += part.returns
            out.open += [(n, None) for n in part.breaks]
            k = last
        out.open += falling
        out.open = out.open or [(name, None)]
        return out

    def attempt(self, i: int, j: int) -> Flow:
        name = self.node("TRY_HEAD", "try", self.line_of[i], self.line_of[i])
        k = self.end(i + 1)
        body = self.statement(i + 1, k)
        if body.entry:
            self.edge(name, body.entry)
        out = Flow(name, list(body.open), list(body.returns), body.breaks, body.continues)
        while k < j and self.words[k + 1 : k + 2] == ["catch"]:
            b = self.close(k + 2)
            last = self.end(b + 1)
            caught = re.sub(r"\s*\b(?!const\b)[A-Za-z_]\w*$", "", self.code(k + 3, b - 1)) or self.code(k + 3, b - 1)
            one = self.node("CATCH", f"catch ({caught})", self.line_of[k + 1], self.line_of[last])
            self.edge(name, one, "exception")
            part = self.block(b + 2, last)
            if part.entry:
                self.edge(one, part.entry)
            out.open += part.open
            out.returns += part.returns
            k = last
        return out


def build(d: Declaration, most: int = 5, most_lines: int = 10, whole_cases: bool = False) -> Graph:
    """The graph of one definition, from N1 (START) to N2 (END)."""
    params = re.search(r"\((.*)\)", d.signature, re.S)
    g = Graph(d.detail, d.end_line - d.detail.count("\n"), most, most_lines, whole_cases)
    start = g.node("START", f"{d.qualified_name}({params[1] if params else ''})", d.line, d.line)
    stop = g.node("END", "End", d.end_line, d.end_line)
    body = g.block(1, len(g.words) - 1)
    g.edge(start, body.entry or stop)
    g.join(body.open, stop)
    g.join([(n, None) for n in body.returns], stop)
    return g


def graphs(files: DataFrame, most: int = 5, most_lines: int = 10, whole_cases: bool = False) -> DataFrame:
    """One row per definition in `files` (file, source_text; each file once): its nodes and edges, or the error that kept it from having any.

    file and ord, the place of the declaration in it, are a key.

    whole_cases: statements after the first one of a case belong to it; if not, they are passed over, as is a case
    that stands directly in another.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, text in zip(b["file"], b["source_text"]):
                try:
                    found = declarations(clean_lines(text))
                except (IndexError, RecursionError, ValueError) as e:
                    rows.append((file, 0, 0, "", f"{type(e).__name__}: {e}", [], []))
                    continue
                for n, d in enumerate(found):
                    if d.kind != "function" or not d.is_definition:
                        continue
                    try:
                        g = build(d, most, most_lines, whole_cases)
                        rows.append((file, n, d.line, d.qualified_name, None, [dict(zip(("node_id", "node_seq", "node_type", "raw_code", "start_line", "end_line"), n_)) for n_ in g.nodes], [dict(zip(("edge_ord", "source", "target", "label"), e)) for e in g.edges]))
                    except (IndexError, RecursionError, ValueError) as e:
                        rows.append((file, n, d.line, d.qualified_name, f"{type(e).__name__}: {e}", [], []))
            yield pd.DataFrame(rows, columns=["file", "ord", "line", "qualified_name", "error", "nodes", "edges"])

    return files.where("source_text is not null").select("file", "source_text").mapInPandas(run, NODE_SCHEMA)


def graph_nodes(built: DataFrame) -> DataFrame:
    return built.select("file", "line", "qualified_name", F.explode("nodes").alias("n")).select("file", "line", "qualified_name", "n.*")


def graph_edges(built: DataFrame) -> DataFrame:
    return built.select("file", "line", "qualified_name", F.explode("edges").alias("e")).select("file", "line", "qualified_name", "e.*")
