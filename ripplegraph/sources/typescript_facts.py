"""Facts of TypeScript source, by a small lexer and patterns."""

from __future__ import annotations

import re
from collections.abc import Iterator

from .lexing import Lines, Scopes, block_end, blanked

CLASS = re.compile(r"\bclass\s+(\w+)(?:<[^{>]*>)?(?:\s+extends\s+([\w.]+)(?:<[^{>]*>)?)?(?:\s+implements\s+([\w.,\s<>]+?))?\s*\{")
INTERFACE = re.compile(r"\binterface\s+(\w+)(?:<[^{>]*>)?(?:\s+extends\s+([\w.,\s<>]+?))?\s*\{")
ENUM = re.compile(r"\benum\s+(\w+)\s*\{")
ALIAS = re.compile(r"\btype\s+(\w+)(?:<[^=>]*>)?\s*=")
FUNCTION = re.compile(r"\bfunction\s*\*?\s*(\w+)\s*(?:<[^(>]*>)?\(")
ARROW = re.compile(r"\b(?:const|let|var)\s+(\w+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::\s*[^={\n]+)?=>")
VARIABLE = re.compile(r"^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=\n]+)?=(?!\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::\s*[^={\n]+)?=>)", re.M)
METHOD = re.compile(r"^[ \t]*(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*(\w+)\s*(?:<[^(>]*>)?\(([^)]*)\)\s*(?::\s*[^{;\n]+)?\{", re.M)
CALL = re.compile(r"(?:\b([\w.]+)\.)?\b(\w+)\s*\(")
IMPORT = re.compile(r"\bimport\s+(?:type\s+)?([^;'\"]*?)\s*from\s*['\"]([^'\"]+)['\"]")
REQUIRE = re.compile(r"\bimport\s*['\"]([^'\"]+)['\"]|\brequire\(\s*['\"]([^'\"]+)['\"]")
ROUTE = re.compile(r"\b(?:app|router|server)\.(get|post|put|patch|delete|all)\(\s*['\"`]([^'\"`]*)['\"`](?:[^()\n]*,\s*([\w.]+)\s*\))?")
DECORATED = re.compile(r"@(Get|Post|Put|Patch|Delete|All)\(\s*(?:['\"`]([^'\"`]*)['\"`])?\s*\)\s*(?:@\w+\([^)]*\)\s*)*(?:async\s+)?(\w+)\s*\(")
KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "function", "constructor", "super", "typeof", "await", "new", "import", "require", "async"}


def facts(source: str) -> Iterator[dict]:
    text = blanked(source)
    code, line, scopes = blanked(text, strings=True), Lines(source), Scopes()
    names = lambda s: [re.sub(r"<.*", "", x).strip() for x in s.split(",") if x.strip()] if s else []
    symbol = lambda name, kind, at, end, owner=None: {"fact": "symbol", "name": name, "owner": owner, "detail": kind, "line": line.of(at), "end_line": line.of(end)}
    for m in IMPORT.finditer(text):
        for part in re.split(r"[{},]", m[1]):
            if part.strip():
                name = re.sub(r"^(?:\*\s+as\s+|type\s+)", "", part.strip()).split(" as ")[0].strip()
                yield {"fact": "import", "name": name, "target": m[2], "detail": "from", "line": line.of(m.start())}
    for m in REQUIRE.finditer(text):
        yield {"fact": "import", "name": m[1] or m[2], "target": m[1] or m[2], "detail": "standard", "line": line.of(m.start())}
    for m in CLASS.finditer(code):
        end = block_end(code, m.end() - 1)
        yield symbol(m[1], "class", m.start(), end)
        scopes.add(m.end() - 1, end, "class", m[1])
        yield from ({"fact": "type", "name": m[1], "target": t, "detail": d, "line": line.of(m.start())} for d, group in (("extends", m[2]), ("implements", m[3])) for t in names(group))
    for m in INTERFACE.finditer(code):
        end = block_end(code, m.end() - 1)
        yield symbol(m[1], "interface", m.start(), end)
        scopes.add(m.end() - 1, end, "interface", m[1])
        yield from ({"fact": "type", "name": m[1], "target": t, "detail": "extends", "line": line.of(m.start())} for t in names(m[2]))
    for m in ENUM.finditer(code):
        yield symbol(m[1], "enum", m.start(), block_end(code, m.end() - 1))
    for m in ALIAS.finditer(code):
        yield symbol(m[1], "interface", m.start(), block_end(code, m.end()))
    declared = set()
    for m in [*FUNCTION.finditer(code), *ARROW.finditer(code)]:
        end = block_end(code, m.end())
        declared.add(m.start(1))
        yield symbol(m[1], "function", m.start(1), end)
        scopes.add(m.end() - 1, end, "function", m[1])
    for m in METHOD.finditer(code):
        cls = scopes.owner(m.start(1), "class")
        if cls and m[1] not in KEYWORDS - {"constructor"} and not scopes.owner(m.start(1), "function", "method"):
            end = block_end(code, m.end() - 1)
            declared.add(m.start(1))
            yield symbol(m[1], "method", m.start(1), end, cls)
            scopes.add(m.end() - 1, end, "method", m[1])
    for m in VARIABLE.finditer(code):
        yield symbol(m[1], "variable", m.start(1), m.end())
    for m in CALL.finditer(code):
        if m[2] not in KEYWORDS and m.start(2) not in declared and scopes.owner(m.start(2), "function", "method"):
            yield {"fact": "call", "name": m[2], "owner": scopes.owner(m.start(2), "class", "function", "method"), "target": m[1], "line": line.of(m.start(2))}
    for m in ROUTE.finditer(text):
        yield {"fact": "endpoint", "name": m[2], "owner": m[3], "target": m[3], "detail": "ANY" if m[1] == "all" else m[1].upper(), "line": line.of(m.start())}
    for m in DECORATED.finditer(text):
        cls = scopes.owner(m.start(3), "class")
        yield {"fact": "endpoint", "name": m[2] or "/", "owner": f"{cls}.{m[3]}" if cls else m[3], "target": m[3], "detail": "ANY" if m[1] == "All" else m[1].upper(), "line": line.of(m.start())}
