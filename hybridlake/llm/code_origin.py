"""Files that weren't written by hand: generated, minified, vendored, or data stored as code.

Evidence is gathered per file, from its path and from all nodes parsed from it:
- vendored copies: token streams of the bodies (comments dropped, literals as placeholders, words in
  lower case) are fingerprinted by winnowing: of every `window` consecutive hashes of k tokens the
  least is kept. A file is a copy if most of its fingerprints recur in many repositories;
- path segments and file names that stand for third-party or generated files;
- notices of tools or origin in the comment at the head of the file: public conventions, and wordings
  learned from the files themselves. Head comments are winnowed too; a fingerprint of theirs is telling
  if it recurs in many repositories and nearly all files that hold it bear other evidence. A notice
  so worded marks the files that bear none;
- packed code (hardly any blanks, long lines) and bodies that are little else than literals.

Files that only deal with such things keep their place: a name counts as a whole segment or
suffix, a notice only in the leading comment, never in a string or below the first statement.
Rule and skill documents are written by hand.

Defined results: paths compare without `./` and the workspace root mark, with forward slashes; a
path of which no node is known is judged by the path alone; null paths are left out; null bodies
and docstrings hold no evidence; nodes without a repository don't count towards recurrence;
repeated rows change no share; empty tables give no rows; bodies are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hybridlake.operators.skew import join_by_count
from hybridlake.session import cut_lineage

# Path segments and file names by convention, as SQL patterns.
VENDORED_PATH = (
    r"(?i)(^|/)(third[_-]?party|3rd[_-]?party|vendor|vendors|vendored|extern|externals?|node_modules|bower_components|jspm_packages|site-packages|dist-packages|deps|carthage|pods)/"
    r"|(^|/)(packages|lib|libs)/[a-z][a-z0-9_-]*[.-]\d+(\.\d+)+(/|$)"
)
GENERATED_PATH = (
    r"(?i)(^|/)(generated|__generated__|autogen|auto_generated|gen-src|generated-sources|generated_src|openapi_client|\.next|__pycache__)/"
    r"|_pb2(_grpc)?\.pyi?$|\.pb\.(c|cc|h|go|js|ts)$|outerproto\.java$|_autogen\.\w+$|\.autogen\.\w+$|\.(gen|generated|g|designer)\.\w+$|\.(yy|tab|lex)\.[ch]\w*$|_moc\.\w+$|(^|/)moc_\w+\.\w+$|(^|/)(package-lock\.json|yarn\.lock)$"
)
MINIFIED_PATH = r"(?i)[.-]min\.(js|css|mjs)$|\.bundle\.(js|css)$|\.chunk\.(js|css)$|(^|/)bundle\.js$"
HAND_WRITTEN_PATH = r"(?i)\.(md|mdx|markdown|rst|txt)$"

# Notices at the head of a file.
_GENERATED = re.compile(
    r"@generated\b|<auto-?generated|\bauto-?generated (?:file|code|by|from|on)\b|\bautogenerated file\b|\bcode generated (?:by|from)\b|\b(?:file|code|source|module) (?:was|is|has been) (?:automatically |auto-?)?(?:generated|produced|created) (?:automatically|by|from)\b"
    r"|\bautomatically (?:generated|produced|created)\b|\bmachine[- ](?:written|generated)\b|\b(?:do not|don't) (?:edit|modify|change)\b.*\b(?:re)?generated\b|\bgenerated (?:by|with|from) .*\b(?:do not|don't) (?:edit|modify)\b"
    r"|자동(?:으로)? 생성|\b(?:wurde|ist) (?:von \S+ |automatisch |maschinell )+(?:erzeugt|generiert|erstellt)|\bgénéré (?:automatiquement|par)\b|\bgenerad[oa] (?:automáticamente|por)\b|自动生成|自動生成",
    re.I | re.S,
)
_VENDORED = re.compile(
    r"\bcopied (?:verbatim|unchanged|unmodified|as[- ]is) from\b|\bvendored\b|\bupstream (?:release|version|source|repository) (?:of|at|from)\b"
    r"|\bpart of (?:the )?\S+ (?:library|project|framework|package|toolkit),? version\b|^\W*!\s*\S+ v\d+(?:\.\d+)+ \||\bthird[- ]party (?:code|copy|library)\b",
    re.I | re.S,
)
_NEGATED = re.compile(r"\bnot (?:auto-?|automatically |machine[- ])?generated\b|\bwritten by hand\b|\bmethod stub\b|\bconstructor stub\b", re.I)
_HEAD = re.compile(r"\s*(?:﻿)?(?:#![^\n]*\n)?((?:\s*(?:/\*.*?\*/|//[^\n]*|#[^\n]*|<!--.*?-->|\"\"\".*?\"\"\"|'''.*?'''))+)", re.S)

_COMMENTS = re.compile(r"/\*.*?\*/|//[^\n]*|(?m:^[ \t]*#[^\n]*)|\"\"\".*?\"\"\"|'''.*?'''", re.S)
_TOKENS = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|\d[\w.]*|[^\W\d]\w*|[^\w\s]")
_LITERALS = re.compile(r"\"[^\"\s]*\"|'[^'\s]*'|\b0[xX][0-9a-fA-F]+\b|\b\d[\d.eE+-]*|[\s,\[\]{}();]")


#: Words in a row, and window, of the fingerprints of head comments.
_HEAD_K, _HEAD_WINDOW = 3, 2
_HEAD_WORD = re.compile(r"[^\W\d_]+")


def canonical_path(path: Column) -> Column:
    """Forward slashes, without leading `./` and `ROOT/`."""
    p = F.regexp_replace(F.regexp_replace(F.trim(path), r"\\", "/"), r"/{2,}", "/")
    return F.regexp_replace(p, r"^(?:\./)*(?:ROOT/)?(?:\./)*", "")


def head_notice(text: str | None, is_comment: bool = False) -> tuple[bool, bool]:
    """(tool's notice, notice of origin) in the leading comment."""
    if not text:
        return False, False
    if not is_comment:
        m = _HEAD.match(text)
        if not m:
            return False, False
        text = m[1]
    kept = [p for p in re.split(r"\n\s*\n|\*/", text) if not _NEGATED.search(p)]
    joined = "\n\n".join(kept)
    return bool(_GENERATED.search(joined)), any(_VENDORED.search(re.sub(r"^[\s/*#]*", "", p)) for p in kept)


def is_packed(body: str) -> bool:
    """Minified: at least 200 characters, hardly any blanks, on long lines, full of signs."""
    n = len(body)
    if n < 200:
        return False
    blanks = sum(map(body.count, " \t\r\n"))
    return blanks < 0.04 * n and n / (1 + body.count("\n")) >= 150 and sum(map(body.count, ";{}(),=:.&|!")) > 0.12 * n


def is_data(body: str) -> bool:
    """Little else than literals: at least 200 characters, of which names and operators are less than a fifth."""
    if len(body) < 200:
        return False
    full = len(body) - sum(map(body.count, " \t\r\n"))
    return full > 0 and len(_LITERALS.sub("", body)) < 0.2 * full


def winnow(body: str, k: int, window: int) -> np.ndarray:
    """Fingerprints of the normalized token stream (int64, distinct)."""
    return _winnowed([("0" if t[0].isdigit() else '"' if t[0] in "\"'" else t.lower()) for t in _TOKENS.findall(_COMMENTS.sub(" ", body))], k, window)


def winnow_head(texts: list[str]) -> np.ndarray:
    """Fingerprints of the words of a file's head comments, each taken by itself."""
    return np.unique(np.concatenate([np.empty(0, np.int64), *(_winnowed(_HEAD_WORD.findall(t.lower()), _HEAD_K, _HEAD_WINDOW) for t in texts)]))


def _winnowed(words: list[str], k: int, window: int) -> np.ndarray:
    if len(words) < k:
        return np.empty(0, np.int64)
    flat = np.empty(len(words), object)
    flat[:] = words
    base = pd.util.hash_array(flat, categorize=True)
    runs = len(base) - k + 1
    h = np.zeros(runs, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = (h ^ base[i : i + runs]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    if runs <= window:
        return h[[np.argmin(h)]].view(np.int64)
    least = np.lib.stride_tricks.sliding_window_view(h, window).min(axis=1)
    return np.unique(least).view(np.int64)


def node_evidence(nodes: DataFrame, k: int, window: int) -> DataFrame:
    """Per node: (path, repo, generated, vendored, packed, data, fingerprints, head)."""
    picked = nodes.select(canonical_path(F.col("file_path")).alias("path"), F.col("workspace_id").alias("repo"), "type", "raw_body", "docstring").where("path is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = {c: [] for c in ("generated", "vendored", "packed", "data", "fingerprints", "head")}
            for kind, body, doc in zip(pdf["type"], pdf["raw_body"], pdf["docstring"], strict=True):
                body, whole = body or "", kind == "module"
                g, v = head_notice(body)
                if whole:
                    g2, v2 = head_notice(doc, True)
                    g, v = g or g2, v or v2
                code = kind in ("module", "function", "method", "class")
                out["generated"].append(g and code)
                out["vendored"].append(v and code)
                out["packed"].append(whole and is_packed(body))
                out["data"].append(whole and is_data(body))
                m = _HEAD.match(body) if code else None
                out["head"].append(winnow_head([x for x in (m and m[1], doc if whole else None) if x]))
                out["fingerprints"].append(winnow(body, k, window) if kind in ("module", "function", "method") else np.empty(0, np.int64))
            yield pdf[["path", "repo"]].assign(**out)

    return picked.mapInPandas(run, "path string, repo string, generated boolean, vendored boolean, packed boolean, data boolean, fingerprints array<long>, head array<long>")


def recurring_share(evidence: DataFrame, least_repos: int) -> DataFrame:
    """(path, n_fingerprints, share of them that occur in at least `least_repos` repositories)."""
    prints = evidence.select("path", "repo", F.explode("fingerprints").alias("fp"))
    # Counted per repository first, in the map tasks: a hot fingerprint is a few rows when shuffled.
    per_repo = prints.groupBy("fp", "repo").agg(F.count(F.lit(1)).alias("n"))
    often = per_repo.groupBy("fp").agg(F.count("repo").alias("repos"), F.sum("n").alias("n")).where(F.col("repos") >= least_repos)
    often = cut_lineage(often.select("fp", "n"))
    held = prints.select("path", "fp").groupBy("path", "fp").agg(F.lit(1).alias("one"))
    total = evidence.agg(F.sum(F.size("fingerprints"))).first()[0] or 0
    hits = join_by_count(held, often, ["fp"], "n", total).groupBy("path").agg(F.count(F.lit(1)).alias("hits"))
    sizes = held.groupBy("path").agg(F.count(F.lit(1)).alias("n_fingerprints"))
    return sizes.join(hits, "path", "left").select("path", "n_fingerprints", (F.coalesce("hits", F.lit(0)) / F.col("n_fingerprints")).alias("recurring"))


def telling_heads(evidence: DataFrame, marked: DataFrame, least_repos: int, least_share: float) -> DataFrame:
    """(path) of files whose head comment holds a telling fingerprint; marked: (path, is_marked).

    Counted by file in the map tasks first; fingerprints that tell are joined by their counts, so a
    licence notice in every head is no hot key.
    """
    heads = evidence.select("path", "repo", F.explode("head").alias("fp")).groupBy("path", "fp").agg(F.min("repo").alias("repo"))
    known = cut_lineage(heads.join(marked, "path", "left").select("path", "repo", "fp", F.coalesce("is_marked", F.lit(False)).alias("is_marked")))
    per_repo = known.groupBy("fp", "repo").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_marked").alias("marked"))
    counts = per_repo.groupBy("fp").agg(F.sum("n").alias("n"), F.sum("marked").alias("marked"), F.count_if(F.col("marked") > 0).alias("repos"))
    telling = counts.where((F.col("repos") >= least_repos) & (F.col("marked") >= F.col("n") * F.lit(least_share))).select("fp", "n")
    total = known.count()
    return join_by_count(known.where(~F.col("is_marked")).select("path", "fp"), telling, ["fp"], "n", total).select("path").distinct()


def file_origins(files: DataFrame, nodes: DataFrame, *, k: int = 16, window: int = 8, least_repos: int = 8, least_share: float = 0.8, telling_repos: int = 8, telling_share: float = 0.35) -> DataFrame:
    """files: (file_path). One row per distinct path: its evidence, and `origin`
    (vendored, generated, minified, data, noticed for a telling head alone, or hand-written)."""
    evidence = cut_lineage(node_evidence(nodes, k, window))
    flags = evidence.groupBy("path").agg(*[F.max(c).alias(f"any_{c}") for c in ("generated", "vendored", "packed", "data")])
    prints = recurring_share(evidence, least_repos)
    paths = files.select("file_path").where("file_path is not null").distinct().withColumn("path", canonical_path(F.col("file_path")))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    # Read three times: one row per file.
    seen = cut_lineage(flags.join(prints, "path", "left"))
    copied = F.coalesce("recurring", F.lit(0.0)) >= least_share
    by = {
        "vendored": F.col("path").rlike(VENDORED_PATH) | yes("any_vendored") | copied,
        "generated": F.col("path").rlike(GENERATED_PATH) | yes("any_generated"),
        "minified": F.col("path").rlike(MINIFIED_PATH) | yes("any_packed"),
        "data": yes("any_data"),
    }
    written = F.col("path").rlike(HAND_WRITTEN_PATH)
    marked = seen.select("path", (~written & (by["vendored"] | by["generated"] | by["minified"] | by["data"])).alias("is_marked"))
    told = telling_heads(evidence, marked, telling_repos, telling_share).withColumn("told", F.lit(True))
    all_ = paths.join(seen, "path", "left").join(told, "path", "left")
    origin = F.when(written, "hand-written")
    for name, is_it in by.items():
        origin = origin.when(is_it, name)
    origin = origin.when(yes("told"), "noticed").otherwise("hand-written")
    return all_.select("file_path", origin.alias("origin"), F.coalesce("recurring", F.lit(0.0)).alias("recurring"), F.coalesce("n_fingerprints", F.lit(0)).alias("n_fingerprints"))
