"""Python files by the standard library's syntax trees."""

from __future__ import annotations

import ast

from ..functions import test_rules as T
from .collect import Rows


def _call_name(node: ast.AST) -> str:
    return ast.unparse(node) if isinstance(node, (ast.Name, ast.Attribute)) else ""


class _Visitor:
    def __init__(self, out: Rows, tree: ast.Module):
        self.out, self.content = out, out.content
        self.starts = [0]
        for line in self.content.split("\n"):
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.raw_lines = self.content.split("\n")
        self.body(tree.body, None, None, None)

    def at(self, line: int, col: int) -> int:
        """Offset of a place that the tree gives in bytes of its line."""
        text = self.raw_lines[line - 1]
        return self.starts[line - 1] + (col if text.isascii() else len(text.encode("utf-8")[:col].decode("utf-8", "ignore")))

    def span(self, node) -> tuple[int, int]:
        first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
        start = self.at(node.lineno, node.col_offset) if first == node.lineno else self.starts[first - 1] + len(self.raw_lines[first - 1]) - len(self.raw_lines[first - 1].lstrip())
        return start, self.at(node.end_lineno, node.end_col_offset)

    def text(self, node) -> str:
        a, b = self.at(node.lineno, node.col_offset), self.at(node.end_lineno, node.end_col_offset)
        return self.content[a:b]

    def body(self, statements, parent, parent_class, owner):
        """parent: id of what holds the statements; parent_class: the name if it is a class; owner: the function around."""
        for s in statements:
            if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self.function(s, parent, parent_class)
            elif isinstance(s, ast.ClassDef):
                self.cls(s, parent)
            else:
                if isinstance(s, (ast.Import, ast.ImportFrom)):
                    self.imported(s, parent)
                elif isinstance(s, (ast.Assign, ast.AnnAssign)):
                    self.variable(s, parent)
                for f in ("body", "orelse", "finalbody", "handlers"):
                    for sub in getattr(s, f, []) or []:
                        self.body(sub.body if isinstance(sub, ast.ExceptHandler) else [sub], parent, None, owner)
                for case in getattr(s, "cases", []):
                    self.body(case.body, parent, None, owner)

    def function(self, f, parent, parent_class):
        start, end = self.span(f)
        decorators = ["@" + ast.unparse(d) for d in f.decorator_list]
        body = self.text(f)
        test = T.py_is_test(self.out.path, f.name, parent_class, decorators)
        calls = []
        todo = list(ast.iter_child_nodes(f))
        asserts = 0
        while todo:
            n = todo.pop()
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            if isinstance(n, ast.Call) and (name := _call_name(n.func)):
                calls.append((self.at(n.lineno, n.col_offset), name))
            asserts += isinstance(n, ast.Assert)
            todo += ast.iter_child_nodes(n)
        asserts += sum(T.py_is_assertion(c) for _, c in calls)
        more = {}
        if test:
            more = {"is_test": True, "test_framework": T.py_framework(self.content, f.name), "test_type": T.first(f.name.lower(), T.PY_TYPES, "unit"), "test_target": T.py_target(f.name), "assertion_count": asserts}
        label = "TestFunction" if test else "Method" if parent_class else "Function"
        props = {"return_type": ast.unparse(f.returns) if f.returns else None, "async": isinstance(f, ast.AsyncFunctionDef)}
        if test:
            props |= T.flags("\n".join([*decorators, body]), T.PY_FLAGS) | ({"has_decorators": True} if decorators else {})
        complexity = 1 + sum(isinstance(n, (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.BoolOp, ast.IfExp, ast.comprehension)) for n in ast.walk(f))
        ident = self.out.node(label, f.name, start, end, signature=f"({ast.unparse(f.args)})", body=body, doc_string=ast.get_docstring(f), decorators=decorators, receiver_type=parent_class, parent_id=parent, is_exported=not f.name.startswith("_"), complexity=complexity, props=props, **more)
        for at, name in sorted(calls):
            ref = f"{parent_class}.{name[5:]}" if parent_class and name.startswith("self.") and name.count(".") == 1 else name
            self.out.edge("CALLS", ident, ref, at)
            if test and not T.py_is_assertion(name) and T.py_production_call(name):
                self.out.edge("TESTS", ident, name.rsplit(".", 1)[-1], at, confidence_score=T.TEST_CONFIDENCE)
                self.out.edge("COVERS", ident, name.rsplit(".", 1)[-1], at, coverage_type="direct")
        for d in decorators:
            self.out.edge("DECORATES", ident, d[1:].split("(")[0], start, props={"decorator_name": d})
        self.body(f.body, ident, None, ident)

    def cls(self, c, parent):
        start, end = self.span(c)
        bases = [ast.unparse(b) for b in c.bases]
        decorators = ["@" + ast.unparse(d) for d in c.decorator_list]
        ident = self.out.node("Class", c.name, start, end, signature=f"({', '.join(bases)})" if bases else "", body=self.text(c), doc_string=ast.get_docstring(c), decorators=decorators, parent_id=parent, is_exported=not c.name.startswith("_"), props={"bases": ",".join(bases) or None})
        for b in bases:
            self.out.edge("INHERITS", ident, b.rsplit(".", 1)[-1], start)
        self.body(c.body, ident, c.name, None)

    def imported(self, s, parent):
        name = s.names[0].name if isinstance(s, ast.Import) else "." * s.level + (s.module or "")
        a, b = self.span(s)
        alias = s.names[0].asname
        self.out.node("Import", name, a, b, signature=self.text(s), parent_id=parent, props={"path": name, "alias": alias, "names": ",".join(n.name for n in s.names) if isinstance(s, ast.ImportFrom) else None})

    def variable(self, s, parent):
        targets = s.targets if isinstance(s, ast.Assign) else [s.target]
        for t in targets:
            for n in t.elts if isinstance(t, (ast.Tuple, ast.List)) else [t]:
                if isinstance(n, ast.Name):
                    a, b = self.span(s)
                    kind = ast.unparse(s.annotation) if isinstance(s, ast.AnnAssign) else None
                    self.out.node("Variable", n.id, a, b, parent_id=parent, type_definition=kind, is_exported=not n.id.startswith("_"), props={"value": ast.unparse(s.value) if s.value else None, "type": kind})


def extract(path: str, content: str) -> list[dict]:
    out = Rows(path, content, "python", T.py_is_test_file(path))
    _Visitor(out, ast.parse(content))
    out.file()
    return out.rows
