"""A lexical front end: C# texts to rule nodes and pragmas, without a compiler.

It knows comments, strings, interpolation and brackets, and reads declarations and
expressions by their shape. What needs types (AP009, the receiver in GR-SYNC-EF) is
filled from declarations in the same file where possible, else left null.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "project string, file string, line int, kind string, name string, text string, parent_kind string, modifiers array<string>,"
    " type string, params array<string>, args array<string>, bases array<string>, body string, assembly string, doc_ord long, pos int"
)

_LITERAL = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<inter>\$@?"(?:\\.|""|\{[^{}"]*(?:"[^"]*"[^{}"]*)*\}|[^"\\])*"|@\$"(?:""|[^"])*")
    |(?P<string>@"(?:""|[^"])*"|\"\"\".*?\"\"\"|"(?:\\.|[^"\\\n])*")
    |(?P<char>'(?:\\.|[^'\\\n])')""",
    re.S | re.X,
)
_WORD = r"[A-Za-z_]\w*"
_NAME = rf"{_WORD}(?:\s*\.\s*{_WORD})*"
_TYPE = rf"{_NAME}(?:\s*<[^;{{}}()]*?>)?(?:\s*\[[\s,]*\])*\??"
_MODIFIER = r"(?:public|private|protected|internal|static|async|override|virtual|abstract|sealed|partial|new|extern|unsafe|readonly)"
_METHOD = re.compile(rf"((?:\b{_MODIFIER}\s+)+)({_TYPE})\s+({_WORD})\s*(?:<[^<>()]*>)?\s*\(")
_CLASS = re.compile(rf"\b(class|record\s+struct|record|struct|interface)\s+({_WORD})\s*(?:<[^{{}}()]*?>)?\s*(\([^()]*\))?\s*(?::\s*([^{{;]+?))?\s*(?=where\b|\{{|;)")
_NEW = re.compile(rf"\bnew\s+({_NAME})\s*(?:<[^;{{}}()]*?>)?\s*[({{]")
_IMPLICIT_NEW = re.compile(rf"({_NAME})\??\s+{_WORD}\s*(?:\{{[^{{}}]*\}})?\s*=\s*new\s*\(")
_CATCH = re.compile(rf"\bcatch\b\s*(?:\(\s*({_NAME})(?:\s+{_WORD})?\s*\))?\s*(when\b)?")
_AWAIT = re.compile(r"\bawait\s+(?!foreach\b|using\b)")
_CHAIN = re.compile(rf"(?<![\w.])({_WORD})")
_PRAGMA = re.compile(r"^[ \t]*#pragma[ \t]+warning[ \t]+(disable|restore)\b[ \t]*([^\r\n/]*)", re.M)
_FIELD = re.compile(rf"\b({_TYPE})\s+({_WORD})\s*(?:[;={{]|=>)")
_KEYWORDS = frozenset("if while for foreach switch catch using lock return await new throw typeof nameof sizeof default when in is as base else do try var case yield".split())


def masked(text: str) -> tuple[str, list[tuple[int, str, str]]]:
    """The text with comments blank and literals as quotes of the same length, and the literals (place, kind, text)."""
    found = []

    def blank(m: re.Match) -> str:
        kind = m.lastgroup
        if kind != "comment":
            found.append((m.start(), {"inter": "InterpolatedStringExpression", "string": "StringLiteralExpression", "char": "CharacterLiteralExpression"}[kind], m[0]))
        inner = re.sub(r"[^\n]", " " if kind == "comment" else "\x01" if kind == "inter" else "\x02", m[0])
        return inner

    return _LITERAL.sub(blank, text), found


def closing(text: str, at: int, pair: str = "()") -> int:
    """The place of the bracket that closes the one at a place, or the end."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == pair[0]) - (text[i] == pair[1])
        if not depth:
            return i
    return len(text)


def last_called(text: str) -> str | None:
    """The method of a chain that ends with its call: b of a.b(c(d))."""
    depth = 0
    for i in range(len(text) - 1, -1, -1):
        depth += (text[i] == ")") - (text[i] == "(")
        if not depth:
            break
    found = re.search(rf"\.\s*({_WORD})\s*$", text[:i]) if text.endswith(")") else None
    return found[1] if found else None


def split_list(text: str) -> list[str]:
    """Parts between commas that stand in no bracket."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{<") - (c in ")]}>")
        if c == "," and depth <= 0:
            out.append(text[last:i].strip())
            last = i + 1
    tail = text[last:].strip()
    return [p for p in [*out, tail] if p]


def argument_kind(text: str) -> str:
    if "\x01" in text:
        return "InterpolatedStringExpression"
    if text.startswith("\x02"):
        return "StringLiteralExpression"
    return "Expression"


def chain_at(text: str, start: int) -> Iterator[tuple[str, int, bool]]:
    """Of a chain a.b(c).d: (text without arguments, place of an argument list or -1, whether it is called), longest last."""
    i, said = start, ""
    while True:
        m = re.compile(_WORD).match(text, i)
        if not m:
            return
        said += m[0]
        i = m.end()
        generic = re.compile(r"\s*<[\w\s,.<>?\[\]]*>(?=\s*\()").match(text, i)
        j = generic.end() if generic else i
        while j < len(text) and text[j].isspace():
            j += 1
        if j < len(text) and text[j] == "(":
            end = closing(text, j)
            yield said, j, True
            said += text[j : end + 1] if end - j < 3 else "()"
            i = end + 1
        else:
            yield said, -1, False
        dot = re.compile(r"\s*[?!]?\s*\.\s*(?=[A-Za-z_])").match(text, i)
        if not dot:
            return
        said += "."
        i = dot.end()


def rule_rows(text: str | None) -> list[dict]:
    """Rule nodes of one file, without its project and path."""
    code, literals = masked(text or "")
    starts = [m.end() for m in re.finditer("\n", code)]
    rows: list[dict] = []

    def add(at: int, kind: str, **more) -> None:
        rows.append({"line": bisect_right(starts, at) + 1, "pos": at, "kind": kind, **more})

    types = {name: re.sub(r"\s+", "", t) for t, name in _FIELD.findall(code) if t not in _KEYWORDS and t != "return"}
    spans, above = [], {m[2]: [re.sub(r"<.*$", "", b, flags=re.S).rsplit(".", 1)[-1].strip() for b in split_list(m[4] or "")] for m in _CLASS.finditer(code)}

    def bases_of(name: str) -> list[str]:
        """Every base that this file knows of a class it declares, `object` at least; nothing of another one."""
        out, todo = [], [name]
        while todo:
            for b in above.get(todo.pop(), ()):
                if b not in out:
                    out.append(b)
                    todo.append(b)
        return [*out, "object"] if name in above else []

    for m in _CLASS.finditer(code):
        kind = {"class": "ClassDeclaration", "record": "RecordDeclaration", "struct": "StructDeclaration", "interface": "InterfaceDeclaration"}.get(m[1], "RecordStructDeclaration")
        bases = split_list(m[4] or "")
        open_at = code.find("{", m.end())
        spans.append((m.start(), closing(code, open_at, "{}") if open_at >= 0 else m.end(), bases))
        add(m.start(2), kind, name=m[2], bases=bases)
    inside = lambda at: next((b for s, e, b in reversed(spans) if s <= at <= e), [])
    for m in _METHOD.finditer(code):
        end = closing(code, m.end() - 1)
        params = [re.sub(rf"\s+{_WORD}\s*(=.*)?$", "", re.sub(r"^(this|ref|out|in|params)\s+", "", p), flags=re.S) for p in split_list(code[m.end() : end])]
        brace = re.compile(r"\s*(?:where[^{;]*)?(\{|=>)").match(code, end + 1)
        body = ""
        if brace:
            stop = closing(code, brace.start(1), "{}") if brace[1] == "{" else code.find(";", brace.end())
            body = (text or "")[brace.start(1) : stop + 1]
        add(m.start(1), "MethodDeclaration", name=m[3], modifiers=m[1].split(), type=re.sub(r"\s+", "", m[2]), params=params, bases=inside(m.start()), body=body)
    for m in _NEW.finditer(code):
        add(m.start(), "ObjectCreationExpression", type=re.sub(r"\s+", "", m[1]))
    for m in _IMPLICIT_NEW.finditer(code):
        add(m.start(), "ImplicitObjectCreationExpression", type=re.sub(r"\s+", "", m[1]))
    for m in _CATCH.finditer(code):
        add(m.start(), "CatchClause", type=re.sub(r"\s+", "", m[1]) if m[1] else None, modifiers=["when"] if m[2] else [])
    for m in _AWAIT.finditer(code):
        end, depth = m.end(), 0
        while end < len(code) and not (depth <= 0 and code[end] in ";,)}]"):
            depth += (code[end] in "([{") - (code[end] in ")]}")
            end += 1
        said = re.sub(r"\s+", " ", code[m.end() : end]).strip()
        add(m.start(), "AwaitExpression", text=said, name=last_called(said))
    for m in _CHAIN.finditer(code):
        if m[1] in _KEYWORDS or re.search(r"\bnew\s+$", code[max(0, m.start() - 8) : m.start()]):
            continue
        steps = list(chain_at(code, m.start()))
        for said, args_at, called in steps:
            if called:
                args = [argument_kind(a) for a in split_list(code[args_at + 1 : closing(code, args_at)])]
                root = said.split(".")[0].removesuffix("()")
                prop = said.split(".")[1].removesuffix("()") if said.count(".") > 1 else ""
                declared = types.get(prop) or types.get(root)
                add(m.start(), "InvocationExpression", name=said.rsplit(".", 1)[-1], text=said, args=args, type=declared, bases=bases_of((declared or "").removesuffix("?")))
            if "." in said:
                add(m.start(), "MemberAccessExpression", name=said.rsplit(".", 1)[-1], text=said, parent_kind="InvocationExpression" if called else None)
    for at, kind, value in literals:
        if kind != "CharacterLiteralExpression":
            add(at, "StringLiteralExpression", text=value)
    return rows


def pragma_rows(text: str | None) -> list[tuple[int, str, str]]:
    """(line, action, code); one row a code, an empty code if none is named."""
    out = []
    for m in _PRAGMA.finditer(text or ""):
        line = (text or "").count("\n", 0, m.start()) + 1
        out += [(line, m[1], c) for c in (x.strip() for x in m[2].split(",")) if c] or [(line, m[1], "")]
    return out


def _arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in SCHEMA.split(", "))])


def spread(documents: DataFrame) -> DataFrame:
    """documents over all tasks: parsing costs far more than reading, and a file of very many short texts is one split.

    The number is fixed, as Spark would join parts again that are small in bytes.
    """
    spark = documents.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    own = [c for c in ("doc_id", "file_path", "file", "text") if c in documents.columns]
    return documents.repartition(parts, F.xxhash64(*own))


def rule_nodes(documents: DataFrame) -> DataFrame:
    """Rule nodes of all documents (project, file_path, text). A null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow_schema()
        for batch in batches:
            rows = []
            for d in batch.to_pylist():
                own = {"project": d["project"], "file": d["file"], "assembly": d["project"], "doc_ord": d["doc_ord"], "modifiers": [], "params": [], "args": [], "bases": []}
                rows += [own | r for r in rule_rows(d["text"])]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    order = F.col("doc_ord") if "doc_ord" in documents.columns else F.lit(None)
    return spread(documents).select("project", F.col("file_path").alias("file"), "text", order.cast("long").alias("doc_ord")).mapInArrow(run, SCHEMA)


def pragmas(documents: DataFrame) -> DataFrame:
    """(doc_id, line, action, code) of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("line", pa.int32()), ("action", pa.string()), ("code", pa.string())])
        for batch in batches:
            rows = [dict(zip(schema.names, (d["doc_id"], *r))) for d in batch.to_pylist() for r in pragma_rows(d["text"])]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return spread(documents).select("doc_id", "text").mapInArrow(run, "doc_id long, line int, action string, code string")
