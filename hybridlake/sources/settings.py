"""Settings of a workspace: loading, merging, and what they make the scan leave out."""

from __future__ import annotations

from pathlib import Path

#: The part of the settings whose lists are joined instead of replaced.
JOINED = "indexing_rules"


def merged(base: dict, local: dict) -> dict:
    """base overridden by local; within `indexing_rules` lists are united, in order, each item once."""
    out = dict(base)
    for name, value in local.items():
        old = out.get(name)
        if name == JOINED and isinstance(old, dict) and isinstance(value, dict):
            out[name] = old | {k: list(dict.fromkeys([*old[k], *v])) if isinstance(v, list) and isinstance(old.get(k), list) else v for k, v in value.items()}
        else:
            out[name] = value
    return out


def load(*paths: str) -> dict:
    """The settings of YAML files, later ones over earlier ones; files that don't exist are empty."""
    import yaml

    out: dict = {}
    for p in paths:
        if Path(p).is_file():
            out = merged(out, yaml.safe_load(Path(p).read_text(encoding="utf-8", errors="ignore")) or {})
    return out


def gitignore_globs(text: str) -> list[str]:
    """The patterns of an ignore file; comments, blank lines and exceptions are left out."""
    lines = (x.strip() for x in text.splitlines())
    return [x.strip("/") for x in lines if x and x[0] not in "#!"]


def append_rotating(path: str, text: str, archive: str, most: int = 50 * 1024) -> None:
    """Appends to a text file; one that has reached `most` bytes is first moved to the archive folder."""
    p = Path(path)
    if p.is_file() and p.stat().st_size >= most:
        to = Path(archive)
        to.mkdir(parents=True, exist_ok=True)
        number = 1 + sum(1 for _ in to.glob(f"{p.stem}-*{p.suffix}"))
        p.rename(to / f"{p.stem}-{number:04d}{p.suffix}")
    p.parent.mkdir(parents=True, exist_ok=True)
    with p.open("a", encoding="utf-8") as f:
        f.write(text)
