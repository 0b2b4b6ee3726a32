"""Facts of Java source, by patterns over text without comments and string contents."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

from .lexing import Lines, Scopes, block_end, blanked

CLASS = re.compile(r"\b(class|interface|enum|record)\s+(\w+)(?:<[^{>]*>)?(?:\s*\([^)]*\))?(?:\s+extends\s+([\w.,\s<>]+?))?(?:\s+implements\s+([\w.,\s<>]+?))?\s*\{")
METHOD = re.compile(r"(?:\b(?:public|protected|private|static|final|abstract|synchronized|default)\s+)*(?:<[^>]+>\s+)?([\w<>\[\],.?]+)\s+(\w+)\s*\(([^)]*)\)\s*(?:throws\s+[\w.,\s]+)?\{")
CALL = re.compile(r"(?:\b([\w.]+)\.)?\b(\w+)\s*\(")
IMPORT = re.compile(r"^\s*import\s+(static\s+)?([\w.]+(?:\.\*)?)\s*;", re.M)
MAPPING = re.compile(r"@(Get|Post|Put|Patch|Delete|Request)Mapping\s*(?:\(\s*(?:value\s*=\s*|path\s*=\s*)?\"([^\"]*)\"[^)]*\))?")
LISTENER = re.compile(r"@(?:EventListener|KafkaListener|RabbitListener|SqsListener|StreamListener)\s*(?:\([^)\"]*\"([^\"]*)\")?")
VALUE = re.compile(r"@Value\(\s*\"\$\{([^}:\"]+)")
GETENV = re.compile(r"System\.get(?:env|Property)\(\s*\"([^\"]+)\"")
PUBLISH = re.compile(r"\.(publish|publishEvent|emit|dispatch|send|broadcast)\(\s*(?:\"([^\"]*)\"|new\s+(\w+))")
FIELD = re.compile(r"(?:\b(?:public|protected|private|static|final|transient|volatile)\s+)*\b([A-Z][\w.]*)(?:<([^;={}()]*)>)?(?:\[\])?\s+(\w+)\s*[;=]")
RELATION = re.compile(r"@(OneToOne|OneToMany|ManyToOne|ManyToMany)\b")
COLUMN = re.compile(r"@(?:Column|JoinColumn)\s*\([^)]*?\bname\s*=\s*\"([^\"]*)\"")
REPOSITORY = re.compile(r"\b(\w*Repository)\s*<\s*(\w+)")
PLAIN = {"String", "Integer", "Long", "Short", "Byte", "Double", "Float", "Boolean", "Character", "Object"}
BEFORE = re.compile(r"(?:@|new)\s*\Z")
KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "new", "throw", "else", "super", "this", "synchronized", "try", "do", "assert"}


def facts(source: str) -> Iterator[dict]:
    text = blanked(source)
    code, line, scopes = blanked(text, strings=True), Lines(source), Scopes()
    names = lambda s: [re.sub(r"<.*", "", x).strip() for x in s.split(",") if x.strip()] if s else []
    models = set()
    for m in IMPORT.finditer(code):
        yield {"fact": "import", "name": m[2].rsplit(".", 1)[-1], "target": m[2], "detail": "static" if m[1] else "standard", "line": line.of(m.start(2))}
    for m in CLASS.finditer(code):
        end = block_end(code, m.end() - 1)
        kind = "class" if m[1] == "record" else m[1]
        yield {"fact": "symbol", "name": m[2], "owner": scopes.owner(m.start(), "class"), "detail": kind, "line": line.of(m.start(1)), "end_line": line.of(end)}
        scopes.add(m.end() - 1, end, "class", m[2])
        yield from ({"fact": "type", "name": m[2], "target": t, "detail": "extends", "line": line.of(m.start(1))} for t in names(m[3]))
        yield from ({"fact": "type", "name": m[2], "target": t, "detail": "implements", "line": line.of(m.start(1))} for t in names(m[4]))
        if a := REPOSITORY.search(m[3] or ""):
            yield {"fact": "repository", "name": m[2], "target": a[2], "detail": a[1], "line": line.of(m.start(1))}
        before = code[max(0, m.start() - 200) : m.start()].rsplit("}", 1)[-1]
        if re.search(r"@(Entity|Document|Table)\b", before):
            models.add(m[2])
            yield {"fact": "model", "name": m[2], "target": next(iter(re.findall(r"@Table\([^)]*name\s*=\s*\"([^\"]*)\"", text[max(0, m.start() - 200) : m.start()])), None), "line": line.of(m.start(1))}
    marks = [m.start() for m in re.finditer("[};{]", code)]
    after = lambda at: marks[k - 1] + 1 if (k := bisect.bisect_left(marks, at)) else 0  # noqa: E731  where what stands at a place begins
    starts = set()
    for m in METHOD.finditer(code):
        if m[1] in KEYWORDS or m[2] in KEYWORDS or m[1] in ("class", "new"):
            continue
        end, cls = block_end(code, m.end() - 1), scopes.owner(m.start(2), "class")
        starts.add(m.start(2))
        own = f"{cls}.{m[2]}" if cls else m[2]
        yield {"fact": "symbol", "name": m[2], "owner": cls, "detail": "method", "line": line.of(m.start(2)), "end_line": line.of(end)}
        scopes.add(m.end() - 1, end, "method", m[2])
        head = text[after(m.start()) : m.start(2)]
        for a in MAPPING.finditer(head):
            yield {"fact": "endpoint", "name": a[2] or "/", "owner": own, "target": m[2], "detail": "ANY" if a[1] == "Request" else a[1].upper(), "line": line.of(m.start(2))}
        for a in LISTENER.finditer(head):
            yield {"fact": "event", "name": a[1] or m[2], "owner": own, "detail": "subscribe", "line": line.of(m.start(2))}
        if re.search(r"@(Test|ParameterizedTest)\b", head):
            yield {"fact": "test", "name": m[2], "owner": cls, "detail": str(len(re.findall(r"\bassert\w*\s*\(", code[m.end() : end]))), "line": line.of(m.start(2)), "end_line": line.of(end)}
    for m in FIELD.finditer(code):
        cls = scopes.owner(m.start(1), "class")
        if not cls or scopes.owner(m.start(1), "method"):
            continue
        head, target = text[after(m.start()) : m.start(1)], (m[2] or m[1]).rsplit(",", 1)[-1].strip()
        if target not in PLAIN:
            yield {"fact": "type", "name": cls, "target": target, "detail": "composes", "line": line.of(m.start(3))}
        if cls.rsplit(".", 1)[-1] in models:
            yield {"fact": "field", "name": m[3], "owner": cls, "target": next(iter(COLUMN.findall(head)), None), "detail": m[1], "line": line.of(m.start(3))}
            yield from ({"fact": "relationship", "name": m[3], "owner": cls, "target": target, "detail": r, "line": line.of(m.start(3))} for r in RELATION.findall(head))
    for m in CALL.finditer(code):
        owner = scopes.owner(m.start(2), "class", "method")
        inside = scopes.owner(m.start(2), "method")
        if inside and m[2] not in KEYWORDS and m.start(2) not in starts and not BEFORE.search(code, max(0, m.start() - 40), m.start()):
            yield {"fact": "call", "name": m[2], "owner": owner, "target": m[1], "line": line.of(m.start(2))}
    for m in PUBLISH.finditer(text):
        yield {"fact": "event", "name": m[2] or m[3], "owner": scopes.owner(m.start(), "class", "method"), "detail": "publish", "line": line.of(m.start())}
    for m in [*VALUE.finditer(text), *GETENV.finditer(text)]:
        yield {"fact": "config", "name": m[1], "owner": scopes.owner(m.start(), "class", "method"), "detail": "property", "line": line.of(m.start())}
