"""Source code and API descriptions as chunks."""

from __future__ import annotations

import ast
import json
import re

_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.Assert, ast.match_case)


def complexity(node: ast.AST) -> int:
    """1, and 1 for each branch and each further operand of a boolean operator."""
    return 1 + sum(isinstance(n, _BRANCHES) + (len(n.values) - 1 if isinstance(n, ast.BoolOp) else 0) for n in ast.walk(node))


_FUNCTIONS = ast.AsyncFunctionDef, ast.FunctionDef


def signature(node: ast.AST) -> str:
    """A function's head as text."""
    head = ("async " if type(node) is ast.AsyncFunctionDef else "") + "def"
    return f"{head} {node.name}({ast.unparse(node.args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")


def python_chunks(path: str, data: bytes) -> list[tuple[int, str]]:
    """A chunk for each function, class head and method, with its place, signature and complexity."""
    text = data.decode("utf-8", "replace")
    tree, out = ast.parse(text), []

    def visit(nodes: list[ast.stmt], owner: str) -> None:
        for n in nodes:
            if isinstance(n, _FUNCTIONS):
                kind = "Method" if owner else "Function"
                doc = (ast.get_docstring(n) or "").split("\n")[0]
                out.append(f"[{kind}: {owner + '.' if owner else ''}{n.name} | Lines {n.lineno}-{n.end_lineno} | Complexity {complexity(n)}] {signature(n)}" + (f"\n{doc}" if doc else "") + f"\n{ast.get_source_segment(text, n)}")
            elif isinstance(n, ast.ClassDef):
                bases = ", ".join(map(ast.unparse, n.bases))
                methods = ", ".join(m.name for m in n.body if isinstance(m, _FUNCTIONS))
                out.append(f"[Class: {n.name}({bases}) | Lines {n.lineno}-{n.end_lineno}] methods: {methods}" + (f"\n{d}" if (d := ast.get_docstring(n)) else ""))
                visit(n.body, f"{owner + '.' if owner else ''}{n.name}")

    visit(tree.body, "")
    return list(enumerate(out)) or windows(path, data)


_HEADS = re.compile(r"^[ \t]*(?:(?:export|public|private|protected|static|async|final|abstract|default|pub|inline)\s+)*(?:func(?:tion)?|class|interface|struct|enum|trait|impl|fn|type|module)\b[^;{]*\{|^[ \t]*[A-Za-z_][\w<>\[\], *&:]*\s+\w+\s*\([^;{}]*\)\s*(?:throws [\w., ]+)?\{", re.M)


def bare(text: str) -> str:
    """Code with strings and comments blanked out, places kept."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    return re.sub(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", blank, text, flags=re.S)


def brace_chunks(path: str, data: bytes) -> list[tuple[int, str]]:
    """A chunk for each outermost definition of a language with braces, found by their balance."""
    text = data.decode("utf-8", "replace")
    clean, out, at = bare(text), [], 0
    while m := _HEADS.search(clean, at):
        depth, end = 1, m.end()
        while end < len(clean) and depth:
            depth += {"{": 1, "}": -1}.get(clean[end], 0)
            end += 1
        line = text.count("\n", 0, m.start()) + 1
        out.append(f"[Code: {' '.join(text[m.start() : m.end() - 1].split())} | Line {line}]\n{text[m.start() : end]}")
        at = end
    return list(enumerate(out)) or windows(path, data)


def windows(path: str, data: bytes, size: int = 50) -> list[tuple[int, str]]:
    """Windows of lines, for what has no definitions."""
    lines = data.decode("utf-8", "replace").split("\n")
    return [(i // size, f"[Lines {i + 1}-{min(i + size, len(lines))}]\n" + "\n".join(lines[i : i + size])) for i in range(0, len(lines), size) if "".join(lines[i : i + size]).strip()]


def openapi_chunks(path: str, data: bytes) -> list[tuple[int, str]]:
    """A chunk for each operation and each schema of an OpenAPI description."""
    spec, out = json.loads(data), []
    kind = lambda s: s.get("$ref", "").rsplit("/", 1)[-1] or s.get("type", "any")
    for route, item in (spec.get("paths") or {}).items():
        for verb in "get put post delete patch head options".split():
            if not isinstance(op := item.get(verb), dict):
                continue
            lines = [f"[Operation: {verb.upper()} {route}] {op.get('summary') or op.get('operationId') or ''}".strip()]
            lines += [f"Parameter {p.get('name')} ({p.get('in')}{', required' if p.get('required') else ''}): {kind(p.get('schema') or {})}" for p in [*item.get("parameters", []), *op.get("parameters", [])]]
            lines += [f"Body: {kind(c.get('schema') or {})}" for c in ((op.get("requestBody") or {}).get("content") or {}).values()]
            lines += [f"Response {code}: {r.get('description', '')}" for code, r in (op.get("responses") or {}).items()]
            out.append("\n".join(lines))
    for name, schema in ((spec.get("components") or {}).get("schemas") or {}).items():
        need = set(schema.get("required") or [])
        out.append("\n".join([f"[Schema: {name}]"] + [f"{k}: {kind(v)}{' (required)' if k in need else ''}" for k, v in (schema.get("properties") or {}).items()]))
    return list(enumerate(out))


def chunks(path: str, data: bytes) -> list[tuple[int, str]]:
    """By the file's ending; a JSON text with paths is an API description."""
    if path.endswith(".py"):
        return python_chunks(path, data)
    if path.endswith(".json"):
        return openapi_chunks(path, data)
    return brace_chunks(path, data)
