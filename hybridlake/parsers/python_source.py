"""Python source: modules, classes, methods and functions, with containment, imports, calls and annotations."""

from __future__ import annotations

import ast
from collections.abc import Iterator

from hybridlake.parsers.model import Parsed

_LEAVES = (ast.Name, ast.Constant, ast.expr_context)


def _inside(node: ast.AST) -> Iterator[ast.AST]:
    """The node and all within it, in any order, without names and constants."""
    todo = [node]
    while todo:
        one = todo.pop()
        yield one
        for field in one._fields:
            value = getattr(one, field, None)
            todo += [x for x in (value if type(value) is list else (value,)) if isinstance(x, ast.AST) and not isinstance(x, _LEAVES)]


class _Walk(ast.NodeVisitor):
    def __init__(self, out: Parsed, source: str) -> None:
        self.out, self.lines, self.source = out, source.split("\n"), source
        self.imported: dict[str, str] = {}
        self.owner: list[tuple[str, str, str]] = []  # (id, kind, fqn) from the module inwards

    def generic_visit(self, node: ast.AST) -> None:
        # Only statements hold imports and definitions, so expressions are left out, however deep.
        for field in node._fields:
            value = getattr(node, field, None)
            for one in value if type(value) is list else ():
                if isinstance(one, (ast.stmt, ast.excepthandler, ast.match_case)):
                    self.visit(one)

    def _text(self, node: ast.AST) -> str:
        return "\n".join(self.lines[node.lineno - 1 : node.end_lineno])

    def _target(self, name: str) -> str:
        return f"__unresolved_fqn__::{self.imported[name]}" if name in self.imported else f"__unresolved__::{name}"

    def visit_Module(self, node: ast.Module) -> None:
        name = self.out.path.rsplit("/", 1)[-1].removesuffix(".py")
        self.owner.append((self.out.add("module", name, self.out.path, 1, len(self.lines), "", "", docstring=ast.get_docstring(node)), "module", self.out.path))
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.out.link(self.owner[0][0], f"__unresolved__::{a.asname or a.name.split('.')[0]}", "IMPORTS", node.lineno)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names if node.module else ():
            full = f"{node.module}.{a.name}"
            self.imported[a.asname or a.name] = full
            self.out.link(self.owner[0][0], f"__unresolved_fqn__::{full}", "IMPORTS", node.lineno)

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        bases = ", ".join(map(ast.unparse, node.bases))
        at = self.out.add("class", node.name, f"{self.out.path}::{node.name}", node.lineno, node.end_lineno, f"class {node.name}" + (f"({bases}):" if bases else ":"), self._text(node), docstring=ast.get_docstring(node))
        self.owner.append((at, "class", f"{self.out.path}::{node.name}"))
        self.generic_visit(node)
        self.owner.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        holder, kind, fqn = self.owner[-1]
        method = kind == "class"
        prefix = fqn if method else self.out.path
        wait = isinstance(node, ast.AsyncFunctionDef)
        returns = ast.unparse(node.returns) if node.returns else None
        signature = f"{'async ' if wait else ''}def {node.name}({ast.unparse(node.args)}){f' -> {returns}' if returns else ''}:"
        at = self.out.add(
            "method" if method else "function", node.name, f"{prefix}::{node.name}", node.lineno, node.end_lineno, signature, self._text(node), docstring=ast.get_docstring(node), return_type=returns, is_async=wait
        )
        if method:
            self.out.link(holder, at, "CONTAINS", node.lineno)
        for hint in [*(a.annotation for a in node.args.args), node.returns]:
            for part in ast.walk(hint) if hint else ():
                if isinstance(part, ast.Name) and not part.id.startswith("_"):
                    self.out.link(at, self._target(part.id), "ANNOTATED_WITH", node.lineno)
        for part in _inside(node):
            if isinstance(part, ast.Call):
                name = part.func.id if isinstance(part.func, ast.Name) else part.func.attr if isinstance(part.func, ast.Attribute) else ""
                if name and not name.startswith("_"):
                    self.out.link(at, self._target(name), "CALLS", part.lineno)
        self.owner.append((at, "function", f"{prefix}::{node.name}"))
        self.generic_visit(node)
        self.owner.pop()

    visit_AsyncFunctionDef = visit_FunctionDef


def parse(path: str, source: str) -> Parsed:
    """Nodes and edges of a file; nothing for source that doesn't parse."""
    out = Parsed(path, "python")
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return out
    _Walk(out, source).visit(tree)
    return out
