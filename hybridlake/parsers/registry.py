"""Which parser reads which files, and parsing of a table of files in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hybridlake.operators.chunking import chunk_lines, chunks
from hybridlake.parsers import brace_source, python_source
from hybridlake.parsers.model import EDGE_COLUMNS, EDGE_DDL, NODE_COLUMNS, NODE_DDL, Parsed

Parser = Callable[[str, str], Parsed]


def _brace(language: str) -> Parser:
    return lambda path, source: brace_source.parse(path, source, language)


def parse_document(path: str, source: str) -> Parsed:
    """Chunks of a document as nodes; named by its folder if it's a skill or readme page, else by its stem."""
    out = Parsed(path, "markdown")
    folders = path.replace("\\", "/").split("/")
    name = folders[-2] if len(folders) > 1 and folders[-1] in ("SKILL.md", "README.md") else folders[-1].rsplit(".", 1)[0]
    parts = chunks(source)
    for i, (part, (first, last)) in enumerate(zip(parts, chunk_lines(source, parts), strict=True)):
        out.add("Skill" if "skills/" in path else "Document", f"{name} (Part {i + 1})", f"{name}::chunk_{i}", first, last, "", part)
        out.nodes[-1]["id"] = f"skill::{path}::chunk_{i}"
    return out


#: Extension -> parser; add to it to read further languages.
PARSERS: dict[str, Parser] = {
    ".py": python_source.parse, ".java": _brace("java"), ".cs": _brace("csharp"), ".ts": _brace("typescript"), ".tsx": _brace("typescript"),
    **{e: _brace("c") for e in (".c", ".h", ".cc", ".cpp", ".hpp")}, **{e: parse_document for e in (".md", ".html", ".css")},
}

#: Rows, and characters of the files they are from, that make one frame.
_STEP_ROWS, _STEP_CHARS = 10_000, 2_000_000


def parse_files(files: DataFrame, path: Column, source: Column, parsers: dict[str, Parser] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a table of files. Files of unknown kinds, without text, or that don't parse give none."""
    known, step_rows, step_chars = dict(parsers or PARSERS), _STEP_ROWS, _STEP_CHARS
    picked = files.select(path.alias("path"), source.alias("source")).where("path is not null and source is not null")

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[Parsed, int]]:
        for pdf in batches:
            for p, s in zip(pdf["path"], pdf["source"], strict=True):
                parser = known.get("." + p.rsplit(".", 1)[-1].lower())
                if parser:
                    yield parser(p, s), len(s)

    def gathered(batches: Iterator[pd.DataFrame], part: str) -> Iterator[list]:
        """Rows of many files at once, as a frame costs more than parsing a small file."""
        rows, held = [], 0
        for one, n in parsed(batches):
            rows += getattr(one, part)
            held += n
            if len(rows) >= step_rows or held >= step_chars:
                yield rows
                rows, held = [], 0
        yield rows

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in filter(None, gathered(batches, "nodes")):
            yield pd.DataFrame(rows, columns=NODE_COLUMNS)

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in filter(None, gathered(batches, "edges")):
            yield pd.DataFrame(rows, columns=EDGE_COLUMNS).astype({"call_site_line": "Int32"})

    return picked.mapInPandas(nodes, NODE_DDL), picked.mapInPandas(edges, EDGE_DDL)


def node_category(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("skills/")), "SKILL").when(path.startswith(".agents/"), "RULE").otherwise("SOURCE")


def module_of(path: Column, prefixes: dict[str, str] | None = None) -> Column:
    """The module whose configured path prefix the path has, else its first folder, else root."""
    out = F.when(~F.contains(path, F.lit("/")), "root").otherwise(F.split(path, "/")[0])
    for prefix, name in (prefixes or {}).items():
        out = F.when(path.startswith(prefix), name).otherwise(out)
    return out
