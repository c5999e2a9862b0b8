"""Syntax trees of method bodies and declared symbols, from C# texts.

A small recursive descent over tokens: statements exactly, expressions as far as the
metrics look at them (logical operators, conditionals, lambdas, switch expressions,
calls, names and literals). What it can't read becomes one plain expression.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.schema import CONTRACTS, conform
from factgraph.sources.csharp import _CLASS, _KEYWORDS, _METHOD, _MODIFIER, _TYPE, _WORD, closing, masked, split_list, spread

_TOKEN = re.compile(
    r"\s+|(?P<name>@?[A-Za-z_]\w*)|(?P<number>\d[\w.]*)|(?P<string>\x02+|\x01+)|(?P<op>=>|\?\?=|\?\?|\?\.|&&|\|\||==|!=|<=|>=|\+\+|--|[-+*/%&|^]=|::|.)", re.S
)
_PREDEFINED = frozenset("bool byte sbyte short ushort int uint long ulong char float double decimal string object void".split())
_LITERAL_WORDS = {"true": "TrueLiteralExpression", "false": "FalseLiteralExpression", "null": "NullLiteralExpression", "default": "DefaultLiteralExpression"}
_SIMPLE = {"return": "ReturnStatement", "throw": "ThrowStatement", "break": "BreakStatement", "continue": "ContinueStatement", "goto": "GotoStatement", "yield": "YieldReturnStatement"}
_HEADED = {"while": "WhileStatement", "lock": "LockStatement", "using": "UsingStatement", "fixed": "FixedStatement"}
_BINARY = {"||": (2, "LogicalOrExpression"), "&&": (3, "LogicalAndExpression")}
_NAMESPACE = re.compile(r"\bnamespace\s+([\w.]+)")
_ACCESS = ("public", "private", "protected", "internal")


class Node:
    __slots__ = ("kind", "text", "at", "children")

    def __init__(self, kind: str, at: int, children=(), text: str = ""):
        self.kind, self.at, self.text, self.children = kind, at, text, [c for c in children if c is not None]


class Parser:
    """Statements of masked code between two places."""

    def __init__(self, code: str, start: int, stop: int):
        self.tokens = [(m.lastgroup, m[0], m.start()) for m in _TOKEN.finditer(code, start, stop) if m.lastgroup]
        self.i = 0

    def peek(self, ahead: int = 0) -> str:
        j = self.i + ahead
        return self.tokens[j][1] if j < len(self.tokens) else ""

    def kind(self, ahead: int = 0) -> str:
        j = self.i + ahead
        return self.tokens[j][0] if j < len(self.tokens) else ""

    def at(self) -> int:
        j = min(self.i, len(self.tokens) - 1)
        return self.tokens[j][2] if self.tokens else 0

    def take(self, text: str) -> bool:
        if self.peek() == text:
            self.i += 1
            return True
        return False

    def block(self) -> Node:
        node = Node("Block", self.at())
        self.take("{")
        while self.i < len(self.tokens) and self.peek() != "}":
            before = self.i
            node.children.append(self.statement())
            if self.i == before:
                self.i += 1
        self.take("}")
        return node

    def bracketed(self) -> list[Node]:
        """Expressions in parentheses, parts between ; and , apart."""
        out = []
        if not self.take("("):
            return out
        while self.i < len(self.tokens) and self.peek() != ")":
            before = self.i
            if self.peek() in (";", ","):
                self.i += 1
                continue
            out.append(self.expression())
            if self.i == before:
                self.i += 1
        self.take(")")
        return out

    def header(self) -> list[Node]:
        """The parts of a `for` or a `using`: what it declares, its condition, its steps."""
        out, self.i = [], self.i + (self.peek() == "(")
        while self.i < len(self.tokens) and self.peek() != ")":
            before = self.i
            if self.peek() in (";", ","):
                out += [Node("SemicolonToken", self.at())] if self.peek() == ";" else []
                self.i += 1
                continue
            if out and out[-1].kind in ("IdentifierName", "PredefinedType", "VariableDeclarator") and self.kind() == "name":
                name, where = self.peek(), self.at()
                self.i += 1
                out.append(Node("VariableDeclarator", where, [self.expression()] if self.take("=") else [], name))
                continue
            out.append(self.expression())
            if self.i == before:
                self.i += 1
        self.take(")")
        return out

    def arguments(self) -> list[Node]:
        """Arguments of a call, ref and out kept as their text; out may declare a variable."""
        out = []
        self.take("(")
        while self.i < len(self.tokens) and self.peek() != ")":
            before, at, way = self.i, self.at(), self.peek() if self.peek() in ("ref", "out") else ""
            if self.take(","):
                continue
            if way == "out" and self.kind(1) == self.kind(2) == "name":
                out.append(Node("Argument", at, [Node("VariableDeclarator", at, (), self.peek(2))], way))
                self.i += 3
                continue
            out.append(Node("Argument", at, [self.expression()], way))
            if self.i == before:
                self.i += 1
        self.take(")")
        return out

    def statement(self) -> Node:
        at, word = self.at(), self.peek()
        if word == "{":
            return self.block()
        if word == ";":
            self.i += 1
            return Node("EmptyStatement", at)
        if word == "if":
            self.i += 1
            condition, body = self.bracketed(), self.statement()
            other = None
            if self.peek() == "else":
                where = self.at()
                self.i += 1
                other = Node("ElseClause", where, [self.statement()])
            return Node("IfStatement", at, [*condition, body, other])
        if word in _HEADED and self.peek(1) == "(":
            self.i += 1
            return Node(_HEADED[word], at, [*(self.header() if word in ("using", "fixed") else self.bracketed()), self.statement()])
        if word in ("for", "foreach"):
            self.i += 1
            if word == "for":
                return Node("ForStatement", at, [*self.header(), self.statement()])
            # the name before `in` is what it declares
            name = next((self.tokens[j - 1][1] for j in range(self.i + 1, len(self.tokens)) if self.tokens[j][1] == "in"), "")
            return Node("ForEachStatement", at, [*self.bracketed(), self.statement()], name)
        if word == "await" and self.peek(1) in ("foreach", "using"):
            self.i += 1
            return self.statement()
        if word == "do":
            self.i += 1
            body = self.statement()
            self.take("while")
            condition = self.bracketed()
            self.take(";")
            return Node("DoStatement", at, [body, *condition])
        if word == "try":
            self.i += 1
            node = Node("TryStatement", at, [self.block()])
            while self.peek() in ("catch", "finally"):
                where, is_catch = self.at(), self.peek() == "catch"
                self.i += 1
                if is_catch:
                    head = [Node("CatchDeclaration", where, self.bracketed())] if self.peek() == "(" else []
                    if self.take("when"):
                        head.append(Node("CatchFilterClause", where, self.bracketed()))
                    node.children.append(Node("CatchClause", where, [*head, self.block()]))
                else:
                    node.children.append(Node("FinallyClause", where, [self.block()]))
            return node
        if word == "switch" and self.peek(1) == "(":
            return self.switch()
        if word in ("checked", "unsafe") and self.peek(1) == "{":
            self.i += 1
            return self.block()
        if word in _SIMPLE:
            self.i += 1
            value = self.until(";")
            return Node(_SIMPLE[word], at, value)
        parts = self.until(";")
        kind = "LocalDeclarationStatement" if len(parts) == 2 and parts[1].kind == "VariableDeclarator" else "ExpressionStatement"
        return Node(kind, at, parts)

    def until(self, end: str) -> list[Node]:
        out = []
        while self.i < len(self.tokens) and self.peek() not in (end, "}"):
            before = self.i
            if self.peek() == "{":  # the body of a local function
                out.append(self.block())
                return out
            if out and self.kind() == "name" and out[-1].kind in ("IdentifierName", "PredefinedType", "SimpleMemberAccessExpression") and self.peek() not in ("is", "as", "when"):
                name, where = self.peek(), self.at()
                self.i += 1
                value = [self.expression()] if self.take("=") else []
                out.append(Node("VariableDeclarator", where, value, name))
                continue
            out.append(self.expression())
            if self.peek() in (",", "=", "=>"):
                self.i += 1
            elif self.i == before:
                self.i += 1
        self.take(end)
        return out

    def switch(self) -> Node:
        at = self.at()
        self.i += 1
        node = Node("SwitchStatement", at, self.bracketed())
        self.take("{")
        section = None
        while self.i < len(self.tokens) and self.peek() != "}":
            where, word = self.at(), self.peek()
            if word in ("case", "default") and not (word == "default" and self.peek(1) != ":"):
                if section is None or section.children[-1].kind[-5:] != "Label":
                    section = Node("SwitchSection", where)
                    node.children.append(section)
                self.i += 1
                if word == "default":
                    section.children.append(Node("DefaultSwitchLabel", where))
                else:
                    mark = self.i
                    value = self.expression(no_colon=True)
                    # more than one plain value is a pattern
                    pattern = self.peek() != ":" or any(t[1] in ("when", "is", "and", "or", "not", "{", "<", ">") for t in self.tokens[mark : self.i])
                    while self.i < len(self.tokens) and self.peek() not in (":", "}"):
                        self.i += 1
                    section.children.append(Node("CasePatternSwitchLabel" if pattern else "CaseSwitchLabel", where, [value]))
                self.take(":")
                continue
            before = self.i
            body = self.statement()
            if section is None:
                section = Node("SwitchSection", where)
                node.children.append(section)
            section.children.append(body)
            if self.i == before:
                self.i += 1
        self.take("}")
        return node

    # expressions: assignment and lambda, conditional, coalescing, logical, the rest
    def expression(self, no_colon: bool = False) -> Node:
        at = self.at()
        left = self.coalesced()
        if self.peek() == "?" and not no_colon:
            self.i += 1
            yes = self.expression()
            self.take(":")
            return Node("ConditionalExpression", at, [left, yes, self.expression()])
        if self.peek() == "switch" and self.peek(1) == "{":
            return self.switch_expression(left, at)
        if self.kind() == "op" and self.peek() in ("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "??="):
            self.i += 1
            word = self.tokens[self.i - 1][1]
            return Node("SimpleAssignmentExpression", at, [left, self.expression()], "" if word == "=" else word)
        return left

    def switch_expression(self, left: Node, at: int) -> Node:
        self.i += 2
        node = Node("SwitchExpression", at, [left])
        while self.i < len(self.tokens) and self.peek() != "}":
            where, depth = self.at(), 0
            while self.i < len(self.tokens) and not (depth == 0 and self.peek() in ("=>", "}")):
                depth += (self.peek() in "({[") - (self.peek() in ")}]")
                self.i += 1
            if not self.take("=>"):
                break
            node.children.append(Node("SwitchExpressionArm", where, [self.expression()]))
            self.take(",")
        self.take("}")
        return node

    def coalesced(self) -> Node:
        at, left = self.at(), self.logical(2)
        if self.take("??"):
            return Node("CoalesceExpression", at, [left, self.coalesced()])
        return left

    def logical(self, least: int) -> Node:
        at, left = self.at(), self.operand()
        while self.peek() in _BINARY and _BINARY[self.peek()][0] >= least:
            rank, kind = _BINARY[self.peek()]
            self.i += 1
            left = Node(kind, at, [left, self.logical(rank + 1)])
        return left

    def operand(self) -> Node:
        at, left = self.at(), self.primary()
        while self.kind() == "op" and self.peek() in ("+", "-", "*", "/", "%", "&", "|", "^", "==", "!=", "<", ">", "<=", ">=") or self.peek() in ("is", "as"):
            word = self.peek()
            self.i += 1
            if word == "is":
                while self.peek() in ("not", "and", "or"):
                    self.i += 1
            left = Node("BinaryExpression", at, [left, self.primary()])
            if word == "is" and self.kind() == "name" and self.peek() not in ("and", "or", "switch", "when"):
                left.text = self.peek()  # the variable of a pattern
                self.i += 1
            while word == "is" and self.peek() in ("and", "or", "not"):
                self.i += 1
                left.children.append(self.primary())
        return left

    def lambda_after(self, at: int, kind: str, head: list[Node]) -> Node:
        self.take("=>")
        return Node(kind, at, [*head, self.block() if self.peek() == "{" else self.expression()])

    def primary(self) -> Node:
        at, word, kind = self.at(), self.peek(), self.kind()
        if word in ("!", "-", "+", "~", "++", "--", "&", "*", "await", "throw", "ref", "out", "in", "params", "static", "async", "var", "not"):
            if word == "var" and self.tokens[self.i + 1 : self.i + 2] and self.tokens[self.i + 1][0] == "name":
                self.i += 1
                return Node("IdentifierName", at, text="var")
            self.i += 1
            node = self.primary() if self.i < len(self.tokens) and self.peek() not in (";", ")", "}", ",") else Node("IdentifierName", at, text=word)
            return Node("PreIncrementExpression", at, [node]) if word in ("++", "--") else node
        if kind == "name" and self.peek(1) == "=>":
            self.i += 1
            return self.lambda_after(at, "SimpleLambdaExpression", [Node("Parameter", at, text=word)])
        if word == "(":
            depth, j = 0, self.i
            while j < len(self.tokens):
                depth += (self.tokens[j][1] == "(") - (self.tokens[j][1] == ")")
                j += 1
                if not depth:
                    break
            if j < len(self.tokens) and self.tokens[j][1] == "=>":
                self.i = j
                return self.lambda_after(at, "ParenthesizedLambdaExpression", [Node("ParameterList", at)])
            return self.postfix(Node("ParenthesizedExpression", at, self.bracketed()), at)
        if word == "delegate":
            self.i += 1
            head = self.bracketed()
            return Node("AnonymousMethodExpression", at, [*head, self.block()])
        if word == "new":
            self.i += 1
            begin = self.i
            while self.kind() == "name" or self.peek() in (".", "<", ">", ",", "?", "::") and self.peek() not in ("(", "{"):
                self.i += 1
            made = "".join(t[1] for t in self.tokens[begin : self.i])
            parts = self.bracketed() if self.peek() == "(" else []
            while self.peek() == "[":
                parts += self.indexer()
            if self.peek() == "{":
                parts += self.initializer()
            return self.postfix(Node("ObjectCreationExpression", at, parts, made), at)
        if kind == "string":
            self.i += 1
            return self.postfix(Node("InterpolatedStringExpression" if word[0] == "\x01" else "StringLiteralExpression", at), at)
        if kind == "number":
            self.i += 1
            return self.postfix(Node("NumericLiteralExpression", at, text=word), at)
        if word in _LITERAL_WORDS:
            self.i += 1
            return self.postfix(Node(_LITERAL_WORDS[word], at), at)
        if kind == "name":
            self.i += 1
            return self.postfix(Node("PredefinedType" if word in _PREDEFINED else "IdentifierName", at, text=word), at)
        if word == "[":
            return Node("CollectionExpression", at, self.indexer())
        if word == "{":
            return Node("InitializerExpression", at, self.initializer())
        return Node("IdentifierName", at, text=word)

    def indexer(self) -> list[Node]:
        out = []
        self.take("[")
        while self.i < len(self.tokens) and self.peek() != "]":
            before = self.i
            out.append(self.expression())
            if not self.take(",") and self.i == before:
                self.i += 1
        self.take("]")
        return out

    def initializer(self) -> list[Node]:
        out = []
        self.take("{")
        while self.i < len(self.tokens) and self.peek() != "}":
            before = self.i
            out.append(self.expression())
            if not self.take(",") and self.i == before:
                self.i += 1
        self.take("}")
        return out

    def generic(self) -> None:
        """Passes over type arguments, if that is what stands here."""
        depth, j = 0, self.i
        while j < len(self.tokens):
            word = self.tokens[j][1]
            depth += (word == "<") - (word == ">")
            if self.tokens[j][0] != "name" and word not in ("<", ">", ",", ".", "?", "[", "]", "::"):
                return
            j += 1
            if not depth:
                break
        if j >= len(self.tokens) or self.tokens[j][1] in ("(", ".", ")", ";", ",", "{", "]", "?.") or self.tokens[j][0] == "name":
            self.i = j

    def postfix(self, node: Node, at: int) -> Node:
        while self.i < len(self.tokens):
            word = self.peek()
            if word in (".", "?.", "::"):
                self.i += 1
                name = Node("IdentifierName", self.at(), text=self.peek())
                self.i += 1
                node = Node("SimpleMemberAccessExpression" if word != "?." else "ConditionalAccessExpression", at, [node, name])
            elif word == "(":
                node = Node("InvocationExpression", at, [node, Node("ArgumentList", self.at(), self.arguments())])
            elif word == "[":
                node = Node("ElementAccessExpression", at, [node, *self.indexer()])
            elif word == "<" and node.kind in ("IdentifierName", "SimpleMemberAccessExpression"):
                before = self.i
                self.generic()
                if self.i == before:
                    return node
            elif word in ("++", "--"):
                self.i += 1
                node = Node("PostIncrementExpression", at, [node])
            elif word == "!" and self.peek(1) in (".", ")", ";", ",", "["):
                self.i += 1
            else:
                return node
        return node


_NO_TYPE = _KEYWORDS | frozenset(
    "public private protected internal static async override virtual abstract sealed partial extern unsafe readonly const required volatile"
    " class struct interface record enum namespace delegate event using operator where get set init ref out params this".split()
)
_MEMBER = re.compile(rf"(?<![\w.])((?:{_MODIFIER}\s+)*)({_TYPE})\s+({_WORD})\s*(?:<[^<>()]*>)?\s*\(")
_VALUE = re.compile(rf"(?<![\w.])((?:(?:{_MODIFIER}|const|required|volatile)\s+)*)({_TYPE})\s+({_WORD})\s*(;|=(?![=>])|,|\{{|=>|$)")


def blanked(code: str, pair: str) -> str:
    """The code with what stands inside outermost brackets as spaces; places stay."""
    out, depth, last = [], 0, 0
    for m in re.finditer("[" + re.escape(pair) + "]", code):
        if m[0] == pair[0]:
            if not depth:
                out.append(code[last : m.start() + 1])
                last = m.end()
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                out.append(re.sub(r"[^\n]", " ", code[last : m.start()]))
                last = m.start()
    rest = code[last:]
    return "".join([*out, re.sub(r"[^\n]", " ", rest) if depth else rest])


def type_bodies(code: str) -> list[tuple[re.Match, int, int]]:
    """(declaration, begin, end) of each class-like type; begin and end of its members, equal if it has no braces."""
    out = []
    for m in _CLASS.finditer(code):
        brace = m.end() if code[m.end() : m.end() + 1] == "{" else code.find("{", m.end())
        semicolon = code.find(";", m.end())
        if brace < 0 or 0 <= semicolon < brace:
            out.append((m, m.end(), m.end()))
        else:
            out.append((m, brace + 1, closing(code, brace, "{}")))
    return out


def declarations(code: str) -> Iterator[tuple[re.Match, int, str, str]]:
    """(match of a method's head, where the text that it was found in begins, its type, that one's kind) in the order of places.

    Members are looked for in types' bodies with what stands in inner braces blank, so with or without
    modifiers; methods outside any type need one.
    """
    found, outside, last = [], [], 0
    for m, begin, end in type_bodies(code):
        found += [(x, begin, m[2], m[1]) for x in _MEMBER.finditer(blanked(code[begin:end], "{}")) if re.match(_WORD, x[2])[0] not in _NO_TYPE and x[3] not in _NO_TYPE]
        if m.start() >= last:
            outside.append(code[last : m.start()] + " " * (max(end, m.start()) - m.start()))
            last = max(end, m.start())
    rest = "".join([*outside, code[last:]])
    found += [(x, 0, "", "") for x in _METHOD.finditer(rest)]
    return iter(sorted(found, key=lambda x: x[0].start() + x[1]))


def methods(text: str | None, bodies: bool = True) -> Iterator[tuple[str, dict, Node | None, str]]:
    """(display, facts, body, body's text) of each method of a file; without bodies these are not parsed."""
    code, _ = masked(text or "")
    starts = [m.end() for m in re.finditer("\n", code)]
    space = _NAMESPACE.search(code)
    for m, base, holder, shape in declarations(code):
        display = ".".join(x for x in (space[1] if space else "", holder, m[3]) if x)
        opened = base + m.end() - 1
        end = closing(code, opened)
        brace = re.compile(r"\s*(?:where[^{;]*)?(\{|=>)").match(code, end + 1) if bodies else None
        body, said = None, ""
        if brace and brace[1] == "{":
            stop = closing(code, brace.start(1), "{}")
            body, said = Parser(code, brace.start(1), stop + 1).block(), (text or "")[brace.start(1) : stop + 1]
        elif brace:
            stop = code.find(";", brace.end())
            stop = len(code) if stop < 0 else stop
            body, said = Node("ArrowExpressionClause", brace.start(1), [Parser(code, brace.end(), stop).expression()]), (text or "")[brace.start(1) : stop]
        words = m[1].split()
        yield display, {
            "name": m[3], "container_name": holder, "container": display.rpartition(".")[0], "namespace": space[1] if space else "", "line": bisect_right(starts, base + m.start(3)) + 1,
            "accessibility": next((w for w in _ACCESS if w in words), "public" if shape == "interface" else "private").capitalize(), "return_type": re.sub(r"\s+", "", m[2]), "is_override": "override" in words,
            "params": split_list(code[opened + 1 : end]),
        }, body, said


def values(text: str | None) -> Iterator[tuple[str, dict]]:
    """(display, facts) of each field and property of a file, those of a record's head too. Of several names after one type the first is given."""
    code, _ = masked(text or "")
    starts = [m.end() for m in re.finditer("\n", code)]
    space = _NAMESPACE.search(code)
    for m, begin, end in type_bodies(code):
        rows = []
        if m[1].startswith("record") and m[3]:
            at = m.start(3)
            rows = [("Property", *reversed(named_type(p)[:2]), ["public"], at) for p in split_list(m[3][1:-1])]
        for x in _VALUE.finditer(blanked(blanked(code[begin:end], "{}"), "()")):
            if re.match(_WORD, x[2])[0] not in _NO_TYPE and x[3] not in _NO_TYPE:
                rows.append(("Property" if x[4] in ("{", "=>") else "Field", x[2], x[3], x[1].split(), begin + x.start(3)))
        for kind, written, name, words, at in rows:
            display = ".".join(p for p in (space[1] if space else "", m[2], name) if p)
            yield display, {
                "name": name, "kind": kind, "container_name": m[2], "container": display.rpartition(".")[0], "namespace": space[1] if space else "", "line": bisect_right(starts, at) + 1,
                "accessibility": next((w for w in _ACCESS if w in words), "public" if m[1] == "interface" else "private").capitalize(), "return_type": re.sub(r"\s+", "", written), "is_override": "override" in words,
            }


def named_type(parameter: str) -> tuple[str, str, str | None]:
    """(name, type, default) of a parameter as it is written."""
    head, _, default = re.sub(r"^\s*\[[^\]]*\]", "", parameter).partition("=")
    words = re.sub(r"\b(?:this|ref|out|in|params|scoped|readonly)\s+", "", head).strip()
    written, _, name = words.rpartition(" ")
    return name.strip(), re.sub(r"\s+", "", written), default.strip() or None


def tree_rows(text: str | None) -> list[tuple]:
    """(node_id, parent_id, pre, post, depth, kind, text, line, owner) of all method bodies of a file."""
    starts = [m.end() for m in re.finditer("\n", text or "")]
    out: list[list] = []
    for display, _, body, _ in methods(text):
        if body is None:
            continue
        todo: list[tuple] = [(body, -1, 0, False, -1)]
        while todo:
            node, parent, depth, closed, own = todo.pop()
            if closed:
                out[own][3] = len(out) - 1
                continue
            own = len(out)
            out.append([own, parent, own, own, depth, node.kind, node.text, bisect_right(starts, node.at) + 1, display])
            todo.append((node, parent, depth, True, own))
            todo += [(c, own, depth + 1, False, -1) for c in reversed(node.children)]
    return [tuple(r) for r in out]


def syntax_nodes(documents: DataFrame) -> DataFrame:
    """The syntax_nodes of all documents (doc_id, text). A null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "node_id", "parent_id", "pre", "post", "depth", "kind", "text", "line", "owner_symbol"]
        kinds = [pa.int64()] + [pa.int32()] * 5 + [pa.string(), pa.string(), pa.int32(), pa.string()]
        for batch in batches:
            rows = [(d, *r) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in tree_rows(t)]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return spread(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, CONTRACTS["syntax_nodes"])


def method_texts(documents: DataFrame) -> DataFrame:
    """(owner_symbol, text) of method bodies, for line counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(display, said) for t in batch.column(0).to_pylist() for display, _, body, said in methods(t) if body is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["owner_symbol", "text"])

    return spread(documents).select("text").mapInArrow(run, "owner_symbol string, text string")


def declared_symbols(documents: DataFrame) -> DataFrame:
    """The symbols (types, methods, fields and properties) that documents (doc_id, project, file_path, text, doc_ord) declare."""
    kind = "project string, file string, doc_ord long, at int, display string, name string, kind string, type_kind string, method_kind string, is_record boolean, accessibility string, container string, container_name string, namespace string, return_type string, is_override boolean, line int"
    param = "name string, type string, has_default boolean, default_value string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in kind.split(", ")]
        types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
        schema = pa.schema([(f.split()[0], types[f.split()[1]]) for f in kind.split(", ")] + [("params", pa.list_(pa.struct([(f.split()[0], types[f.split()[1]]) for f in param.split(", ")])))])
        for batch in batches:
            rows = []
            for d in batch.to_pylist():
                code, _ = masked(d["text"] or "")
                starts = [m.end() for m in re.finditer("\n", code)]
                space = _NAMESPACE.search(code)
                own = {"project": d["project"], "file": d["file_path"], "doc_ord": d["doc_ord"]}
                for m in _CLASS.finditer(code):
                    head = code[max(0, code.rfind("\n", 0, m.start()), code.rfind(";", 0, m.start()), code.rfind("}", 0, m.start())) : m.start()].split()
                    shape = "struct" if "struct" in m[1] else "class" if m[1] == "record" else m[1]
                    rows.append(own | {
                        "at": m.start(), "display": ".".join(x for x in (space[1] if space else "", m[2]) if x), "name": m[2], "kind": "Type", "type_kind": shape, "is_record": m[1].startswith("record"),
                        "accessibility": next((w for w in _ACCESS if w in head), "internal").capitalize(), "namespace": space[1] if space else "", "line": bisect_right(starts, m.start(2)) + 1, "is_override": False,
                    })
                for display, facts, _, _ in methods(d["text"], bodies=False):
                    given = [dict(zip(("name", "type", "has_default", "default_value"), (n, w, v is not None, v))) for n, w, v in map(named_type, facts["params"])]
                    rows.append(own | {k: v for k, v in facts.items() if k in names} | {"at": starts[facts["line"] - 2] if facts["line"] > 1 else 0, "display": display, "kind": "Method", "method_kind": "Ordinary", "is_record": False, "params": given})
                for display, facts in values(d["text"]):
                    rows.append(own | facts | {"at": starts[facts["line"] - 2] if facts["line"] > 1 else 0, "display": display, "is_record": False})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    found = spread(documents).select("project", "file_path", "text", F.coalesce(F.col("doc_ord"), F.lit(0)).cast("long").alias("doc_ord")).mapInArrow(run, f"{kind}, params array<struct<{param.replace(' ', ': ').replace(',:', ',')}>>")
    return conform(found.withColumn("sym_ord", F.col("doc_ord") * 10_000_000 + F.col("at")), "symbols")


_ATTRIBUTE = re.compile(r"\b([A-Za-z_][\w.]*)\s*\(")


def class_rows(text: str | None) -> Iterator[tuple[str, list[tuple[str, str]], list[tuple[str, str, str, int]]]]:
    """(display, bases as (type text, rel), attributes as (name, kind of argument, its text, place)) of each class-like declaration."""
    code, _ = masked(text or "")
    space = _NAMESPACE.search(code)
    for m in _CLASS.finditer(code):
        bases = []
        for b in split_list(m[4] or ""):
            name = re.sub(r"\s*\(.*$", "", b, flags=re.S)  # a record's base may have arguments
            interface = m[1] == "interface" or re.match(r"(?:[\w.]*\.)?I[A-Z]", name) is not None
            bases.append((name, "interface" if interface else "base"))
        before = code[max(code.rfind(c, 0, m.start()) for c in ";{}") + 1 : m.start()]
        found, at = [], 0
        while (a := _ATTRIBUTE.search(before, at)) is not None:
            at = closing(before, a.end() - 1)
            for arg in split_list(before[a.end() : at]):
                of = re.fullmatch(r"typeof\s*\((.*)\)", arg, re.S)
                found.append((a[1], "TypeOfExpression" if of else "Expression", of[1].strip() if of else arg, len(found)))
        yield ".".join(x for x in (space[1] if space else "", m[2]) if x), bases, found


def inherits(documents: DataFrame) -> DataFrame:
    """The inherits facts of documents (text): parents are as they are written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(child, name, rel, i) for t in batch.column(0).to_pylist() for child, bases, _ in class_rows(t) for i, (name, rel) in enumerate(bases)]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["child", "parent", "rel", "ord"])

    return spread(documents).select("text").mapInArrow(run, CONTRACTS["inherits"])


def attributes(documents: DataFrame) -> DataFrame:
    """The attributes facts of the classes of documents (text), a row an argument."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(owner, *x) for t in batch.column(0).to_pylist() for owner, _, found in class_rows(t) for x in found]
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["owner", "name", "arg_kind", "arg_text", "pos"])

    return spread(documents).select("text").mapInArrow(run, CONTRACTS["attributes"])


def name_uses(nodes: DataFrame) -> DataFrame:
    """Names in bodies with the nodes above them: doc_id, owner_symbol, name, line, parent_kind, grandparent_kind, is_call.

    Two joins by (doc_id, node_id); a document's nodes lie together in both.
    """
    own = nodes.filter("kind = 'IdentifierName' AND text != ''").select("doc_id", "owner_symbol", F.col("text").alias("name"), "line", "pre", "parent_id")
    above = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("kind").alias("parent_kind"), F.col("parent_id").alias("g_id"), F.col("pre").alias("p_pre"), F.col("post").alias("p_post"))
    top = nodes.select("doc_id", F.col("node_id").alias("g_id"), F.col("kind").alias("grandparent_kind"), F.col("pre").alias("g_pre"))
    found = own.join(above, ["doc_id", "parent_id"], "left").join(top, ["doc_id", "g_id"], "left")
    member = F.col("parent_kind").isin("SimpleMemberAccessExpression", "ConditionalAccessExpression")
    # the first child of a call is what is called; the last child of an access is its name
    direct = (F.col("parent_kind") == "InvocationExpression") & (F.col("pre") == F.col("p_pre") + 1)
    through = member & (F.col("pre") == F.col("p_post")) & (F.col("grandparent_kind") == "InvocationExpression") & (F.col("p_pre") == F.col("g_pre") + 1)
    return found.select(
        "doc_id", "owner_symbol", "name", "line", F.when(member, "MemberAccessExpression").otherwise(F.col("parent_kind")).alias("parent_kind"), "grandparent_kind",
        F.coalesce(direct | through, F.lit(False)).alias("is_call"), "pre", F.coalesce(member & (F.col("pre") == F.col("p_pre") + 1), F.lit(False)).alias("is_receiver"),
    )


def usings(documents: DataFrame) -> DataFrame:
    """(doc_id, namespace): the namespaces that each document uses, by lines that say so."""
    found = F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:global\s+)?using\s+([\w.]+)\s*;"), F.lit(1))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(found).alias("namespace")).distinct()


def facts_from_texts(documents: DataFrame):
    """A FactSet from source texts alone: documents, symbols, syntax_nodes, pragmas, refs, calls, inherits, attributes, modules, type_refs, overrides, member_impl, flow, flow_edges.

    Names are bound by scopes (operators.binding). A name that no scope knows, such as a member of
    what a foreign method returns, counts for a symbol if it is the only one of that name in the
    solution. Types count as referred to where members, parameters and bases name them.
    """
    from factgraph.functions.text import context_line
    from factgraph.operators import binding
    from factgraph.operators.graph import module_facts
    from factgraph.schema import FactSet
    from factgraph.sources import csharp_flow
    from factgraph.sources.csharp import pragmas
    from factgraph.sources.scratch import checkpointed

    docs = conform(documents, "documents")
    where = docs.select("doc_id", F.col("file_path").alias("file"), "text", "doc_ord")
    seen = F.struct("file", "line", "parent_kind", "grandparent_kind", context_line(F.col("text"), F.col("line")).alias("context"))

    # each is made when it is first asked for, and stored, so texts are parsed once a table
    symbols, nodes = cache(lambda: checkpointed(declared_symbols(docs))), cache(lambda: checkpointed(syntax_nodes(docs)))
    used, written, marks = cache(lambda: checkpointed(usings(docs))), cache(lambda: checkpointed(inherits(docs))), cache(lambda: checkpointed(attributes(docs)))
    bases = cache(lambda: checkpointed(binding.bind_inherits(symbols(), written(), used(), docs)))
    tied = cache(lambda: checkpointed(binding.type_refs(symbols(), bases(), used(), docs)))
    meant = cache(lambda: checkpointed(binding.bind_nodes(nodes(), symbols(), bases(), used(), docs).filter("symbol IS NOT NULL").select("doc_id", F.col("node_id").alias("pre"), "symbol", F.col("kind").alias("bound"))))

    @cache
    def uses() -> DataFrame:
        own = symbols().groupBy("name").agg(F.min("display").alias("only"), F.min(F.lower("kind")).alias("kind"), F.countDistinct("display").alias("n")).filter("n = 1").drop("n")
        rows = name_uses(nodes()).join(meant(), ["doc_id", "pre"], "left").join(own, "name", "left")
        foreign = F.col("symbol").isNull() & (F.col("parent_kind") == "MemberAccessExpression") & ~F.col("is_receiver")
        rows = rows.withColumns({"display": F.when(foreign, F.col("only")).otherwise(F.col("symbol")), "what": F.when(foreign, F.col("kind")).otherwise(F.col("bound"))})
        return checkpointed(rows.filter("display IS NOT NULL"))

    def refs() -> DataFrame:
        none = F.lit(None).cast("string")
        named = uses().withColumn("symbol", F.col("display"))
        made = nodes().filter("kind = 'ObjectCreationExpression'").select("doc_id", F.col("node_id").alias("pre"), "line").join(meant(), ["doc_id", "pre"])
        made = made.withColumns({"parent_kind": F.lit("ObjectCreationExpression"), "grandparent_kind": none})
        columns = "doc_id", "symbol", "line", "parent_kind", "grandparent_kind"
        in_bodies = named.select(*columns).unionByName(made.select(*columns)).join(where, "doc_id").select("symbol", seen.alias("at")).select("symbol", "at.*")
        first = symbols().groupBy(F.col("display").alias("src")).agg(F.min_by(F.struct("file", "line"), "sym_ord").alias("at"))
        declared = tied().filter("src != dst").join(first, "src")
        return in_bodies.unionByName(declared.select(F.col("dst").alias("symbol"), "at.file", "at.line", F.lit("TypeSyntax").alias("parent_kind"), none.alias("grandparent_kind"), F.col("via").alias("context")))

    def calls() -> DataFrame:
        return uses().filter("is_call AND what = 'method'").select(F.col("owner_symbol").alias("caller"), F.col("display").alias("callee"), F.col("pre").cast("long").alias("ord"))

    found = {"documents": docs, "symbols": symbols, "syntax_nodes": nodes, "pragmas": lambda: pragmas(docs), "refs": refs, "calls": calls}
    found |= {"inherits": bases, "attributes": marks, "modules": lambda: module_facts(symbols(), written(), marks()), "type_refs": tied}
    found |= {"overrides": lambda: binding.overrides(symbols(), bases()), "member_impl": lambda: binding.member_impl(symbols(), bases())}
    found |= {"flow": lambda: csharp_flow.data_flow_facts(docs), "flow_edges": lambda: csharp_flow.control_flow_facts(docs)}
    return FactSet(docs.sparkSession, found)
