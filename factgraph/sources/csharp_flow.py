"""Data and control flow of method bodies, from their syntax trees.

One walk over a body's statements in their order follows which are reachable, what is
certainly assigned, and where jumps go. Names are bound by spelling within the method:
its parameters, and what it declares. Loops are left by their conditions unless those are
the literal true; a `try` may end in each of its parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from factgraph.schema import CONTRACTS
from factgraph.sources.csharp import spread
from factgraph.sources.csharp_tree import Node, methods

LOOPS = ("WhileStatement", "DoStatement", "ForStatement", "ForEachStatement")
LAMBDAS = ("SimpleLambdaExpression", "ParenthesizedLambdaExpression", "AnonymousMethodExpression")
#: Where edges out of a method lead.
OUT = -1


def parameters(declared: list[str]) -> dict[str, str]:
    """name -> ref, out or nothing, of a parameter list."""
    found = {}
    for p in declared:
        words = p.split("=")[0].split()
        if len(words) > 1:
            found[words[-1].lstrip("@")] = next((w for w in words[:-1] if w in ("ref", "out")), "")
    return found


class Flow:
    """What a method's body declares, reads, writes and captures, and the edges between its statements.

    State: (pending, assigned): the statements that lead here, and the variables that are
    certainly assigned by then; without any of the former nothing leads here.
    """

    def __init__(self, params: dict[str, str], body: Node):
        self.params, self.known = params, set(params) | set(self.declarations(body))
        self.declared: list[str] = list(dict.fromkeys(self.declarations(body)))
        self.read, self.written, self.captured, self.flows_in = ([] for _ in range(4))
        self.edges: list[tuple[int, int, str]] = []
        self.blocks, self.jumps = 0, []  # of loops and switches: states of their breaks and continues
        self.owners: list[set[str]] = []  # names that belong to the lambdas around
        self.exits: list[set[str]] = []  # what is assigned where the method returns
        start: set[str] = set()  # what the body itself assigns
        if body.kind == "ArrowExpressionClause":
            me, assigned = self.enter(({OUT}, start))
            for child in body.children:
                assigned = self.expression(child, assigned)
            pending, assigned = self.leave(me, assigned, "return")
        else:
            pending, assigned = {OUT}, start
            for child in body.children:
                pending, assigned = self.statement(child, (pending, assigned))
            if pending == {OUT}:  # no statement: the body is one empty block
                pending = {self.enter((pending, assigned))[0]}
        self.edges += [(p, OUT, "end") for p in sorted(pending)]
        ends = [*self.exits, *([assigned] if pending else [])]
        self.always = [n for n in dict.fromkeys([*params, *self.declared]) if ends and all(n in a for a in ends)]

    @staticmethod
    def declarations(node: Node) -> Iterator[str]:
        todo = [node]
        while todo:
            n = todo.pop()
            if n.text and n.kind in ("VariableDeclarator", "ForEachStatement", "Parameter", "BinaryExpression"):
                yield n.text
            if n.kind == "CatchDeclaration" and len(n.children) > 1:
                yield n.children[1].text
            todo += reversed(n.children)

    def enter(self, state) -> tuple[int, set[str]]:
        me = self.blocks
        self.blocks += 1
        self.edges += [(p, me, "goto") for p in sorted(state[0]) if p != OUT]
        return me, set(state[1])

    def leave(self, me: int, assigned: set[str], kind: str):
        """A jump out of the method."""
        self.edges.append((me, OUT, kind))
        if kind == "return":
            self.exits.append(assigned)
        return set(), assigned

    @staticmethod
    def join(*states):
        live = [s for s in states if s[0]]
        if not live:
            return set(), set.intersection(*(s[1] for s in states)) if states else set()
        return set.union(*(s[0] for s in live)), set.intersection(*(s[1] for s in live))

    # expressions: in the order of evaluation; what is assigned afterwards
    def expression(self, node: Node, assigned: set[str]) -> set[str]:
        kind = node.kind
        if kind == "IdentifierName":
            self.use(node.text, assigned)
            return assigned
        if kind == "SimpleAssignmentExpression":
            target, value = node.children[0], node.children[1]
            if target.kind == "IdentifierName":
                if node.text:
                    self.use(target.text, assigned)
                assigned = self.expression(value, assigned)
                return self.write(target.text, assigned)
            return self.expression(value, self.expression(target, assigned))
        if kind in ("PreIncrementExpression", "PostIncrementExpression") and node.children[0].kind == "IdentifierName":
            self.use(node.children[0].text, assigned)
            return self.write(node.children[0].text, assigned)
        if kind == "Argument" and node.text and node.children:
            inner = node.children[0]
            if inner.kind in ("IdentifierName", "VariableDeclarator"):
                if node.text == "ref":
                    self.use(inner.text, assigned)
                return self.write(inner.text, assigned)
        if kind == "VariableDeclarator":
            for child in node.children:
                assigned = self.expression(child, assigned)
            return self.write(node.text, assigned) if node.children else assigned
        if kind in LAMBDAS:
            own = set(self.declarations(node))
            self.owners.append(own)
            jumps, self.jumps, edges, self.edges, blocks, exits = self.jumps, [], self.edges, [], self.blocks, list(self.exits)
            for child in node.children:  # it runs later, if at all: nothing that it does is certain
                if child.kind == "Block" or child.kind.endswith("Statement"):
                    self.statement(child, ({OUT}, set(assigned) | own))
                else:
                    self.expression(child, set(assigned) | own)
            self.jumps, self.edges, self.blocks, self.exits = jumps, edges, blocks, exits
            self.owners.pop()
            return assigned
        if kind in ("LogicalAndExpression", "LogicalOrExpression", "CoalesceExpression"):
            assigned = self.expression(node.children[0], assigned)
            for child in node.children[1:]:
                self.expression(child, set(assigned))
            return assigned
        if kind == "ConditionalExpression":
            assigned = self.expression(node.children[0], assigned)
            return set.intersection(*(self.expression(c, set(assigned)) for c in node.children[1:]))
        if kind == "SwitchExpression":
            assigned = self.expression(node.children[0], assigned)
            arms = [self.expression(c, set(assigned)) for c in node.children[1:]]
            return set.intersection(*arms) if arms else assigned
        if kind in ("SimpleMemberAccessExpression", "ConditionalAccessExpression"):
            return self.expression(node.children[0], assigned)  # a member's name is no variable
        for child in node.children:
            assigned = self.expression(child, assigned)
        if kind == "BinaryExpression" and node.text:
            self.write(node.text, assigned)  # the variable of a pattern, if it matches
        return assigned

    def use(self, name: str, assigned: set[str]) -> None:
        if name in self.known:
            self.read.append(name)
            self.capture(name)
            if name in self.params and self.params[name] != "out" and name not in assigned:
                self.flows_in.append(name)

    def write(self, name: str, assigned: set[str]) -> set[str]:
        if name not in self.known:
            return assigned
        self.written.append(name)
        self.capture(name)
        return assigned | {name}

    def capture(self, name: str) -> None:
        if self.owners and name not in self.owners[-1]:
            self.captured.append(name)

    # statements
    def statement(self, node: Node, state):
        kind = node.kind
        if kind == "Block":
            for child in node.children:
                state = self.statement(child, state)
            return state
        me, assigned = self.enter(state)
        live = bool(state[0])
        here = lambda a: ({me} if live else set(), a)
        parts = node.children
        if kind == "IfStatement":
            other = parts[-1] if parts[-1].kind == "ElseClause" else None
            body = parts[-2] if other is not None else parts[-1]
            for c in parts[: -2 if other is not None else -1]:
                assigned = self.expression(c, assigned)
            yes = self.statement(body, here(set(assigned)))
            no = self.statement(other.children[0], here(set(assigned))) if other is not None and other.children else here(assigned)
            test = parts[0].kind
            return yes if test == "TrueLiteralExpression" else no if test == "FalseLiteralExpression" else self.join(yes, no)
        if kind in LOOPS:
            return self.loop(node, me, assigned, live)
        if kind == "SwitchStatement":
            return self.switch(node, me, assigned, live)
        if kind == "TryStatement":
            first = self.statement(parts[0], here(set(assigned)))
            ends = [first]
            for c in parts[1:]:
                if c.kind == "CatchClause":
                    inner = set(assigned)
                    for x in c.children[:-1]:
                        if x.kind == "CatchDeclaration":
                            if len(x.children) > 1:
                                inner = self.write(x.children[1].text, inner)
                        else:
                            inner = self.expression(x, inner)
                    ends.append(self.statement(c.children[-1], here(inner)))
            out = self.join(*ends)
            for c in parts[1:]:
                if c.kind == "FinallyClause":
                    always = self.statement(c.children[0], (out[0] or ({me} if live else set()), set(assigned)))
                    out = (always[0] if out[0] else set(), out[1] | always[1])
            return out
        if kind in ("LockStatement", "UsingStatement", "FixedStatement"):
            for c in parts[:-1]:
                assigned = self.expression(c, assigned)
            return self.statement(parts[-1], here(assigned))
        for c in parts:
            if c.kind == "Block":  # a local function's body, which runs where it is called
                self.expression(Node("AnonymousMethodExpression", c.at, [c]), assigned)
            else:
                assigned = self.expression(c, assigned)
        if kind in ("ReturnStatement", "ThrowStatement"):
            return self.leave(me, assigned, "return" if kind == "ReturnStatement" else "throw") if live else (set(), assigned)
        if kind in ("BreakStatement", "ContinueStatement"):
            for loop in reversed(self.jumps):
                if kind == "BreakStatement" or loop["loop"]:
                    loop["breaks" if kind == "BreakStatement" else "continues"].append(here(assigned))
                    break
            return set(), assigned
        if kind == "GotoStatement":
            return set(), assigned
        if kind == "YieldReturnStatement" and parts and parts[0].kind == "IdentifierName" and parts[0].text == "break":
            return self.leave(me, assigned, "return") if live else (set(), assigned)
        return here(assigned)

    def loop(self, node: Node, me: int, assigned: set[str], live: bool):
        kind, parts, body = node.kind, node.children[:-1], node.children[-1]
        if kind == "DoStatement":
            parts, body = node.children[1:], node.children[0]
        here = {me} if live else set()
        frame = {"loop": True, "breaks": [], "continues": []}
        self.jumps.append(frame)
        forever = any(p.kind == "TrueLiteralExpression" for p in parts[:1])
        if kind == "ForStatement":
            marks = [i for i, p in enumerate(parts) if p.kind == "SemicolonToken"]
            first, last = (marks + [len(parts)] * 2)[:2]
            head, test, steps = parts[:first], parts[first + 1 : last], parts[last + 1 :]
            for p in head:
                if p.kind != "PredefinedType":
                    assigned = self.expression(p, assigned)
            for p in test:
                assigned = self.expression(p, assigned)
            forever = not test or test[0].kind == "TrueLiteralExpression"
            inner = self.statement(body, (here, set(assigned)))
            again = self.join(inner, *frame["continues"])
            for p in steps:
                self.expression(p, set(again[1]))
        elif kind == "ForEachStatement":
            seen = False
            for p in parts:  # type, name, `in`, and what is gone through
                seen |= p.kind == "IdentifierName" and p.text == node.text
                if p.kind not in ("PredefinedType",) and not (p.kind == "IdentifierName" and p.text in (node.text, "var", "in")):
                    assigned = self.expression(p, assigned)
            inner = self.statement(body, (here, self.write(node.text, set(assigned))))
            again, forever = self.join(inner, *frame["continues"]), False
        elif kind == "DoStatement":
            inner = self.statement(body, (here, set(assigned)))
            again = self.join(inner, *frame["continues"])
            after = set(again[1])
            for p in parts:
                after = self.expression(p, after)
        else:
            for p in parts:
                assigned = self.expression(p, assigned)
            inner = self.statement(body, (here, set(assigned)))
            again = self.join(inner, *frame["continues"])
        self.jumps.pop()
        self.edges += [(p, me, "goto") for p in sorted(again[0])]
        if kind == "DoStatement":
            out = (set(again[0]), after)
        else:
            out = (set(here), assigned)
        return self.join(*([] if forever else [out]), *frame["breaks"]) if not forever or frame["breaks"] else (set(), assigned)

    def switch(self, node: Node, me: int, assigned: set[str], live: bool):
        frame = {"loop": False, "breaks": [], "continues": []}
        self.jumps.append(frame)
        sections = [c for c in node.children if c.kind == "SwitchSection"]
        for c in node.children:
            if c.kind != "SwitchSection":
                assigned = self.expression(c, assigned)
        ends, default = [], False
        for section in sections:
            state = ({me} if live else set(), set(assigned))
            for c in section.children:
                if c.kind.endswith("Label"):
                    default |= c.kind == "DefaultSwitchLabel"
                    for x in c.children:
                        if x.kind not in ("IdentifierName",):
                            state = (state[0], self.expression(x, state[1]))
                else:
                    state = self.statement(c, state)
            ends.append(state)
        self.jumps.pop()
        return self.join(*ends, *frame["breaks"], *([] if default else [({me} if live else set(), assigned)]))

    def roles(self) -> Iterator[tuple[str, str]]:
        """(variable, role): declared, read, written, captured, flows_in, flows_out, always_assigned."""
        out = [n for n, way in self.params.items() if way and n in self.written]
        found = {
            "declared": self.declared, "read": self.read, "written": self.written, "captured": self.captured,
            "flows_in": self.flows_in, "flows_out": out, "always_assigned": self.always,
        }
        for role, names in found.items():
            yield from ((n, role) for n in dict.fromkeys(names))


def flows(text: str | None) -> Iterator[tuple[str, Flow]]:
    for display, facts, body, _ in methods(text):
        if body is not None:
            yield display, Flow(parameters(facts["params"]), body)


def data_flow_facts(documents: DataFrame) -> DataFrame:
    """The flow facts (method, variable, role) of the methods in documents (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(m, *x) for t in batch.column(0).to_pylist() for m, f in flows(t) for x in f.roles()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["method", "variable", "role"])

    return spread(documents).select("text").mapInArrow(run, CONTRACTS["flow"])


def control_flow_facts(documents: DataFrame) -> DataFrame:
    """The flow_edges facts (method, src, dst, kind) of the methods in documents (text): statements are numbered from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(m, *e) for t in batch.column(0).to_pylist() for m, f in flows(t) for e in f.edges]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["method", "src", "dst", "kind"])

    return spread(documents).select("text").mapInArrow(run, CONTRACTS["flow_edges"])
