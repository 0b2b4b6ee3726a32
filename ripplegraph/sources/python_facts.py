"""Facts of Python source, by the standard parser."""

from __future__ import annotations

import ast
from collections.abc import Iterator

HTTP = ("get", "post", "put", "patch", "delete", "options", "head")
PUBLISHERS = ("publish", "emit", "dispatch", "send", "send_robust", "broadcast", "trigger", "fire")
CONFIG = {"os.getenv": "environment", "os.environ.get": "environment", "getenv": "environment", "config.get": "config_file", "config.getint": "config_file", "settings.get": "settings"}
CONSUMERS = ("on_event", "subscribe", "consumer", "listen")
RELATIONS = ("ForeignKey", "OneToOne", "ManyToMany")
MODEL_BASES = ("Model", "Base", "DeclarativeBase", "Document")


def dotted(node: ast.AST) -> str:
    """a.b.c of names, attributes and what is called; empty for others."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = dotted(node.value)
        return f"{head}.{node.attr}" if head else node.attr
    return dotted(node.func) if isinstance(node, ast.Call) else ""


def text_of(args: list) -> str | None:
    return next((a.value for a in args[:1] if isinstance(a, ast.Constant) and isinstance(a.value, str)), None)


def facts(source: str) -> Iterator[dict]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return
    stack: list[tuple[ast.AST, str | None, str | None]] = [(tree, None, None)]
    while stack:
        node, cls, function = stack.pop()
        owner = ".".join(x for x in (cls, function) if x) or None
        if isinstance(node, ast.ClassDef):
            yield from _class(node, cls)
            cls, function = node.name, None
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            yield from _function(node, cls)
            function = node.name
        elif isinstance(node, ast.Import):
            yield from ({"fact": "import", "name": a.name, "target": a.name, "detail": "standard", "line": node.lineno} for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            yield from ({"fact": "import", "name": a.name, "target": module, "detail": "from", "line": node.lineno} for a in node.names)
        elif isinstance(node, ast.Call):
            yield from _call(node, owner)
        elif isinstance(node, ast.Subscript) and dotted(node.value).endswith("environ") and isinstance(node.slice, ast.Constant):
            yield {"fact": "config", "name": str(node.slice.value), "owner": owner, "detail": "environment", "line": node.lineno}
        stack.extend((child, cls, function) for child in reversed(list(ast.iter_child_nodes(node))))


def _class(node: ast.ClassDef, outer: str | None) -> Iterator[dict]:
    bases = [b for b in map(dotted, node.bases) if b]
    yield {"fact": "symbol", "name": node.name, "owner": outer, "detail": "class", "line": node.lineno, "end_line": node.end_lineno}
    yield from ({"fact": "type", "name": node.name, "target": b, "detail": "inherits", "line": node.lineno} for b in bases)
    if any(b.rsplit(".", 1)[-1] in MODEL_BASES for b in bases):
        fields = [t.id for s in node.body if isinstance(s, ast.Assign) for t in s.targets if isinstance(t, ast.Name)] + [s.target.id for s in node.body if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name)]
        table = next((s.value.value for s in node.body if isinstance(s, ast.Assign) and isinstance(s.value, ast.Constant) and any(isinstance(t, ast.Name) and t.id == "__tablename__" for t in s.targets)), None)
        meta = [s for c in node.body if isinstance(c, ast.ClassDef) and c.name == "Meta" for s in c.body if isinstance(s, ast.Assign)]
        table = table or next((s.value.value for s in meta if isinstance(s.value, ast.Constant) and any(isinstance(t, ast.Name) and t.id == "db_table" for t in s.targets)), None)
        for s in node.body:
            field = s.targets[0] if isinstance(s, ast.Assign) else s.target if isinstance(s, ast.AnnAssign) else None
            made = dotted(s.value).rsplit(".", 1)[-1] if isinstance(field, ast.Name) and isinstance(s.value, ast.Call) else ""
            if "relationship" in made.lower() or any(x in made for x in RELATIONS):
                target = next((text_of([a]) or dotted(a) for a in s.value.args[:1]), None)
                yield {"fact": "relationship", "name": field.id, "owner": node.name, "target": target or None, "detail": made, "line": s.lineno}
        yield {"fact": "model", "name": node.name, "target": table, "detail": ",".join(f for f in fields if not f.startswith("__")), "line": node.lineno}


def _function(node: ast.FunctionDef | ast.AsyncFunctionDef, cls: str | None) -> Iterator[dict]:
    yield {"fact": "symbol", "name": node.name, "owner": cls, "detail": "method" if cls else "function", "line": node.lineno, "end_line": node.end_lineno}
    own = f"{cls}.{node.name}" if cls else node.name
    for d in node.decorator_list:
        name, args = dotted(d), d.args if isinstance(d, ast.Call) else []
        last = name.rsplit(".", 1)[-1]
        if last in (*HTTP, "route") and "." in name and (route := text_of(args)) is not None:
            yield {"fact": "endpoint", "name": route, "owner": own, "target": node.name, "detail": "GET" if last == "route" else last.upper(), "line": node.lineno}
        if last in CONSUMERS:
            yield {"fact": "event", "name": text_of(args) or node.name, "owner": own, "detail": "subscribe", "line": node.lineno}
        if last == "fixture":
            yield {"fact": "fixture", "name": node.name, "owner": cls, "line": node.lineno, "end_line": node.end_lineno}
    if node.name.startswith("test_"):
        checks = sum(isinstance(x, ast.Assert) or isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute) and x.func.attr.startswith("assert") for x in ast.walk(node))
        yield {"fact": "test", "name": node.name, "owner": cls, "target": ",".join(a.arg for a in node.args.args if a.arg != "self"), "detail": str(checks), "line": node.lineno, "end_line": node.end_lineno}


def _call(node: ast.Call, owner: str | None) -> Iterator[dict]:
    name = dotted(node.func)
    receiver, _, last = name.rpartition(".")
    if last:
        yield {"fact": "call", "name": last, "owner": owner, "target": receiver or None, "line": node.lineno}
    if last in PUBLISHERS and (event := text_of(node.args)) is not None:
        yield {"fact": "event", "name": event, "owner": owner, "detail": "publish", "line": node.lineno}
    if name in CONFIG and (key := text_of(node.args)) is not None:
        yield {"fact": "config", "name": key, "owner": owner, "detail": CONFIG[name], "line": node.lineno}
