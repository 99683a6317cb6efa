"""Rows that parsers give, and helpers they share."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

# The columns of the tables, and the namespace of ids.
NODE_DDL = "id string, type string, name string, fqn string, file_path string, start_line int, end_line int, signature string, return_type string, docstring string, is_exported boolean, is_async boolean, is_test boolean, raw_body string, skeleton_standard string, skeleton_minimal string, language string"
EDGE_DDL = "source_id string, target_id string, type string, call_site_line int, confidence double"
NODE_COLUMNS = [c.split()[0] for c in NODE_DDL.split(", ")]
EDGE_COLUMNS = [c.split()[0] for c in EDGE_DDL.split(", ")]


def node_id(fqn: str) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, fqn))


@dataclass
class Parsed:
    path: str
    language: str
    nodes: list[dict] = field(default_factory=list)
    edges: list[tuple] = field(default_factory=list)
    linked: set[tuple] = field(default_factory=set)

    def add(self, kind: str, name: str, fqn: str, first: int, last: int, signature: str, body: str, **more) -> str:
        row = dict.fromkeys(NODE_COLUMNS) | {
            "id": node_id(fqn), "type": kind, "name": name, "fqn": fqn, "file_path": self.path, "start_line": first, "end_line": last, "signature": signature, "raw_body": body, "language": self.language,
            "is_exported": not name.startswith("_"), "is_async": False, "is_test": name.startswith("test"), "skeleton_minimal": signature,
        } | more
        doc = row["docstring"]
        row["skeleton_standard"] = signature + (f'\n    """{doc}"""' if doc else "")
        self.nodes.append(row)
        return row["id"]

    def link(self, source: str, target: str, kind: str, line: int | None = None) -> None:
        row = (source, target, kind, line, 1.0)
        if row not in self.linked:
            self.linked.add(row)
            self.edges.append(row)
