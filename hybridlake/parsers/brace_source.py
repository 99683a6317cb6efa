"""Languages with braces (Java, C and C++, C#, TypeScript): types and functions found by patterns.

Strings and comments are blanked first (same length, same lines), so patterns and braces see code
only; bodies are cut from the source itself.
"""

from __future__ import annotations

import re
from bisect import bisect_left

from hybridlake.parsers.model import Parsed, node_id

_QUIET = re.compile(r"/\*.*?(?:\*/|\Z)|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)
_KEYWORDS = frozenset("if for while switch catch return else do new throw sizeof typeof using lock foreach await delete case in of function class".split())
# Words before a type's name, and kinds, by language.
_TYPES = {
    "java": r"\b(class|interface|enum|record)\s+(\w+)", "csharp": r"\b(class|interface|enum|record|struct)\s+(\w+)", "c": r"\b(class|struct|enum|union)\s+(\w+)(?=[^;(){}]*\{)", "typescript": r"\b(class|interface|enum)\s+(\w+)",
}
_NAMED = re.compile(r"(~?\w+)\s*(?:<[\w\s,.]*>\s*)?\(")
_OPENS = re.compile(r"[\w\s:,.<>\[\]|&?]*+\{")
# Possessive, so that a name without an arrow costs one pass over what follows it.
_ARROW = re.compile(r"\b(?:const|let)\s+(?P<name>\w++)\s*+(?::[^=\n]++)?+=\s*+(?P<head>async\s++)?+\(?(?P<args>[^()=]*+)\)?+\s*+(?::(?:\s*+[\w<>\[\]|., ]++|\s*+(?<= )))?+=>\s*+\{")
_IMPORT = {"typescript": re.compile(r"\bimport\b[^;'\"`]*['\"]([^'\"]+)['\"]"), "csharp": re.compile(r"\busing\s+([\w.]+)\s*;")}
_PROPERTY = re.compile(r"^[ \t]*(?:public|protected|private|internal)[\w<>\[\],.? \t]*[ \t](\w+)\s*\{\s*(?:get|set|init)\b", re.M)
_CALL = re.compile(r"\b([A-Za-z_]\w*)\s*\(")
# C# type names that are no references.
_CS_BUILT_IN = frozenset("Boolean Byte Char DateTime Decimal Dictionary Double Enumerable Exception Func Action Guid IDictionary IEnumerable IList Int16 Int32 Int64 List Nullable Object Single String Task Tuple Type Void".split())
_ABOVE = re.compile(r"[ \t]*(?:@[^\n]*)?\n?")
_BLANKS = re.compile(r"\s*+")


def blank(source: str) -> str:
    """The source with strings and comments as blanks."""
    return _QUIET.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def block_end(code: str, opening: int) -> int:
    """Just past the brace that closes the one at `opening`; the end if none does."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, opening):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.end()
    return len(code)


def _closing(code: str, opening: int) -> int:
    """Just past the parenthesis that closes the one at `opening`, if it does before any brace or semicolon; else -1."""
    depth = 0
    for m in re.compile(r"[(){};]").finditer(code, opening):
        if m[0] in "{};":
            return -1
        depth += 1 if m[0] == "(" else -1
        if depth == 0:
            return m.end()
    return -1


def callables(code: str) -> list[tuple[int, int, int, str]]:
    """(start of the head, start of the name, opening brace, name) of each `name(...) ... {` that is no statement or call."""
    out = []
    for m in _NAMED.finditer(code):
        name = m[1]
        close = _closing(code, m.end() - 1) if name not in _KEYWORDS and not name.isdigit() else -1
        opens = _OPENS.match(code, close) if close > 0 else None
        if opens:
            start = code.rfind("\n", 0, m.start()) + 1
            start = max(start, *(code.rfind(c, start, m.start()) + 1 for c in ";{}"))
            head = code[start : m.start()]
            if "=" not in head and "(" not in head and not head.rstrip().endswith(".") and not set(head.split()) & {"new", "return", "else", "throw", "case"}:
                out.append((start, m.start(), opens.end() - 1, name))
    return out


def doc_above(source: str, at: int) -> str | None:
    """The comment that ends right above a position, without its marks."""
    # Upwards, past blanks and annotations; at most one line end stands between comment and code.
    end, lines = at, 0
    while True:
        start = source.rfind("\n", 0, end) + 1
        line = source[start:end].strip()
        if line and not line.startswith("@"):
            break
        lines += not line and end < at
        if start == 0 or lines > 1:
            return None
        end = start - 1
    if line.endswith("*/"):
        close = source.rindex("*/", 0, end)
        opening = source.rfind("/*", 0, close)
        if opening < 0 or "*/" in source[opening:close]:
            return None
        text = source[opening + 2 : close]
    elif line.startswith("//"):
        first = start
        while first > 0:
            above = source.rfind("\n", 0, first - 1) + 1
            if not source[above : first - 1].lstrip().startswith("//"):
                break
            first = above
        text = source[first:end]
    else:
        return None
    return "\n".join(x for x in (re.sub(r"^[ \t]*(?:/{2,3}|\*+)?[ \t]?", "", s).strip() for s in text.split("\n")) if x) or None


def parse(path: str, source: str, language: str) -> Parsed:
    out = Parsed(path, language)
    code = blank(source)
    breaks = [m.start() for m in re.finditer("\n", source)]
    line = lambda i: bisect_left(breaks, i) + 1
    module = node_id(path)
    if language != "typescript":
        out.add("module", path.rsplit("/", 1)[-1].rsplit(".", 1)[0], path, 1, line(len(source)), "", "")
    for m in _IMPORT[language].finditer(source) if language in _IMPORT else ():
        out.link(module, f"__unresolved__::{re.split(r'[./]', m[1])[-1]}", "IMPORTS", line(m.start()))

    types: list[tuple[int, int, str, str]] = []
    for m in re.finditer(_TYPES[language], code):
        opening = code.find("{", m.end())
        stop = code.find(";", m.end())
        if opening < 0 or 0 <= stop < opening:
            continue
        end = block_end(code, opening)
        start = code.rfind("\n", 0, m.start()) + 1
        fqn = f"{path}::{m[2]}"
        at = out.add(m[1], m[2], fqn, line(m.start()), line(end - 1), source[start:opening].strip(), source[start:end], docstring=doc_above(source, start), is_exported=language != "typescript" or "export" in source[start : m.start()])
        types.append((opening, end, at, fqn))
        heritage = code[m.end() : opening]
        if language == "csharp":
            for i, base in enumerate(re.findall(r"[A-Z]\w*", re.sub(r"<[^<>]*>", "", heritage))):
                inherits = i == 0 and m[1] in ("class", "struct", "record") and not re.match(r"I[A-Z]", base) and "implements" not in heritage.split(base)[0]
                out.link(at, f"__unresolved__::{base}", "INHERITS" if inherits else "IMPLEMENTS", line(m.start()))

    found = callables(code)
    if language == "typescript":
        found += [(m.start(), m.start("name"), m.end() - 1, m["name"]) for m in _ARROW.finditer(code)]
    for start, named, opening, name in sorted(found, key=lambda f: f[1]):
        end = block_end(code, opening)
        head = code[start:named]
        start = _BLANKS.match(source, start).end()
        holder = max((t for t in types if t[0] < named < t[1]), default=None, key=lambda t: t[0])
        body, words = source[start:end], head.split()
        at = out.add(
            "method" if holder else "function", name, f"{holder[3] if holder else path}::{name}", line(start), line(end - 1), source[start:opening].strip(), body, docstring=doc_above(source, start),
            return_type=words[-1] if words and language != "typescript" else None, is_async="async" in words, is_exported=bool({"public", "export"} & set(words)) or language == "c",
        )
        if holder:
            out.link(holder[2], at, "CONTAINS", line(start))
        if language == "csharp":
            for call in dict.fromkeys(c for c in _CALL.findall(code[opening:end]) if c not in _KEYWORDS):
                out.link(at, f"__unresolved__::{call}", "CALLS")
            for kind in dict.fromkeys(t for t in re.findall(r"\b[A-Z]\w*", head + code[named + len(name) : opening]) if t not in _CS_BUILT_IN):
                out.link(at, f"__unresolved__::{kind}", "ANNOTATED_WITH", line(start))
    if language == "csharp":
        for m in _PROPERTY.finditer(code):
            holder = max((t for t in types if t[0] < m.start() < t[1]), default=None, key=lambda t: t[0])
            if holder:
                end = block_end(code, code.index("{", m.start(1)))
                out.link(holder[2], out.add("property", m[1], f"{holder[3]}::{m[1]}", line(m.start(1)), line(end - 1), source[m.start() : m.end()].split("{")[0].strip(), source[m.start() : end].strip()), "CONTAINS")
    return out
