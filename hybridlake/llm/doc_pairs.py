"""Functions paired with their documentation.

A body is searched for functions (the one it holds, and any defined inside it) and for comments
(comment blocks, runs of comment lines, string literals in the place of a docstring). Comments and
functions are matched one to one by an assignment of greatest total weight. A link's weight comes
from its place and distance, from parameter tags that name the function's parameters, and from
words of the function's name; links that place makes implausible (comments among statements,
after the end, or in front of something else) and comments that tell nothing are rejected. The
parser's own docstring takes part as one more comment of the outer function.

What a description must hold: without comment marks, parameter and result lines, at least four
words that aren't a restatement of the name, a remark that documentation is missing or inherited,
a tool's placeholder, a notice of licence or origin, or code.

Defined results: only functions and methods with a non-blank body take part; null and empty
docstrings are no comment; of repeated rows of an id one pair is kept, the greatest; line ends of
any kind are alike; an empty table gives no rows; bodies are read whole. Only the named columns
are read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What marks a sentence as telling nothing about the function.
_MISSING = re.compile(
    r"^\W*(?:todo|fixme|xxx|tbd|tba|hack|wip|n/?a|none|null|description|summary|_?summary_|placeholder)\b"
    r"|^\W*(?:no |the )?(?:documentation|docstring|description|docs?)\b\W{0,3}(?:\w+ ){0,3}(?:missing|pending|follows|to be (?:filled|written|added|done)|todo|yet)\b"
    r"|\b(?:to be (?:written|documented|filled in|described)|write (?:the )?(?:documentation|docs|docstring)|describe this|add (?:a )?(?:description|documentation)|not (?:yet )?documented|undocumented)\b"
    r"|추후|나중에 작성|작성 예정|설명 없음|noch zu (?:schreiben|dokumentieren|ergänzen)|dokumentation (?:fehlt|folgt)|à (?:compléter|documenter|rédiger)|por (?:documentar|escribir|completar)|pendiente de",
    re.I,
)
_INHERITED = re.compile(r"@?inherit_?doc|^\W*see (?:the )?(?:base|parent|super)\b|\b(?:overrid(?:es|den|ing)|inherit(?:s|ed)|implements?) (?:the |this |a )?(?:\w+ )?(?:method|function|member|documentation|docs?|description|definition)\b.*\b(?:class|interface|parent|base|super\w*)\b|\b(?:same as|see) (?:the )?(?:base|parent|super)[ -]?(?:class|method|implementation)", re.I)
_TOOL = re.compile(r"auto[- ]?generated|@generated|\(non-javadoc\)|generated (?:by|method|constructor|stub|from|code)|machine[- ]written|produced automatically|do not (?:edit|modify)|method stub|자동 생성|automatisch (?:erzeugt|generiert)|wurde von \S+ (?:erzeugt|generiert)", re.I)
_NOTICE = re.compile(r"copyright\b|\(c\)\s*\w|©|\blicen[cs]ed? |\blicen[cs]e\b\W*(?::|$)|^\W*licen[cs]e\b|spdx-|all rights (?:in|reserved)|(?:as long as|provided that) this notice|free to use in source|without warranty|no warranty of|copied verbatim|vendored|imported unmodified|upstream (?:release|for changes)|part of the \S+ library", re.I)
# Lines and elements that document parameters or results only.
_TAG = r"(?:[@\\](?:param|params?|arg|argument|tparam|returns?|retval|result|throws?|exception|raises?|see|since|author|deprecated|version|type|rtype|yields?)\b|:(?:param|parameter|arg|argument|type|returns?|rtype|raises?|yields?)\b[^:\n]*:)"
_TAG_LINE = re.compile(rf"(?m)^[ \t]*{_TAG}.*$")
_TAG_INLINE = re.compile(rf"[ \t]{{1,}}{_TAG}.*$", re.M)
_LAST_TAG = re.compile(r"(?:[@\\](?:param|arg)|:(?:param|arg))\s+\w+:?\s+(?:the\s+|a\s+)?\w+|(?:[@\\]returns?|:returns?:)\s+(?:the\s+|a\s+)?\w+")
_XML_TAGS = re.compile(r"<(param|returns|typeparam|exception|value|auto-?generated)\b[^>]*>.*?</\1>|<(?:param|returns|typeparam|exception|value|inheritdoc|seealso|see)\b[^>]*/>", re.S | re.I)
_XML_MARKS = re.compile(r"</?(?:summary|remarks|para|c|code|p|b|i|br|pre|ul|li|tt|example)\b[^>]*>", re.I)
_SECTION = re.compile(r"^[ \t]*(?:args|arguments|parameters|params|returns?|raises|yields|parameter|rückgabe)[ \t]*:?[ \t]*$", re.I)

_LINES = re.compile(r"(?:^[ \t]*(?://|#)[^\n]*(?:\n|\Z))+", re.M)
_BLOCK = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_STRING = re.compile(r'\s*(?:[rRbBuUfF]{0,2})("""|\'\'\')(.*?)(?:\1|\Z)|\s*(?:[rRuU]?)("|\')((?:(?!\3)[^\\\n]|\\.)*)\3', re.S)
_MARKS = re.compile(r"^[ \t]*(?:/\*+!?|\*+/|///?!?|#+!?|\*(?!\*)|--)?[ \t]?|[ \t]*\*+/[ \t]*$", re.M)
_BETWEEN = re.compile(r"\s*(?:(?:@[\w.]+(?:\([^()]*\))?|\[[^\[\]\n]*\]|#\[[^\n]*\]|export|default|public|private|protected|static|async|final)\s*)*\Z")
_INNER = re.compile(r"^[ \t]*(?:export\s+)?(?:(?:async\s+)?def\s+(\w+)\s*\(|(?:async\s+)?function\s*\*?\s+(\w+)\s*\()", re.M)
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_A-Za-z]+")
_FILLERS = frozenset("a an the this that function method procedure routine is of to for and".split())
_SENTENCE = re.compile(r"(?<=[.!?。])\s+|\n+")
_CODE = re.compile(
    r"[;{}]\s*$|^\s*[\w.\[\]\"']+(?:\s*,\s*[\w.\[\]]+)*\s*[-+*/|&]?=[^=]|^\s*[\w.]+\(.*\)[;:]?\s*$|^\s*(?:if|elif|while|for|with|try|except|else|switch|case|def|class|function)\b.*[:{(]\s*$"
    r"|^\s*(?:if|elif|while|for|with)\b.*(?:[=!<>]=|\) as |\bin \w+\(|[<>]\s*\d).*|^\s*(?:assert|del|raise|return|import|from|await|yield|throw|new)\s+[\w.]+(?:[(\[.,]|\s*(?:in|=|!=|as|import)\s|\s*;|\s*$)"
    r"|^\s*(?:int|var|let|const|double|float|bool|boolean|string|String|char|void|long|auto)\s+\*?\w+\s*(?:=|;|\()|^\s*log\.\w+\("
)


@dataclass
class Comment:
    text: str
    start: int
    end: int
    kind: str  # before (may stand in front of a function), string (at a body's start), given (the parser's)


@dataclass
class Function:
    name: str
    start: int
    body: int
    params: frozenset[str]


def unmarked(comment: str) -> str:
    """The comment's text without marks; line ends as \\n."""
    return _MARKS.sub("", comment).strip()


def description(text: str) -> str:
    """The text without parameter and result documentation and markup."""
    text = re.sub(r"\r\n?", "\n", text)
    if "\n" not in text and (last := [*_LAST_TAG.finditer(text)]):
        # All on one line: what follows the last tag's own few words is the description.
        rest = text[last[-1].end() :].split()
        return " ".join(rest) if len(rest) >= 6 else _XML_MARKS.sub("", _TAG_INLINE.sub("", " " + text)).strip()
    text = _XML_MARKS.sub("\n", _XML_TAGS.sub("\n", text))
    text = _TAG_INLINE.sub("", _TAG_LINE.sub("", text))
    out, skipping = [], False
    for line in text.split("\n"):
        if _SECTION.match(line):
            skipping = True
        elif skipping and (not line.strip() or line.startswith((" ", "\t"))):
            skipping = bool(line.strip())
        else:
            skipping = False
            out.append(line.strip())
    return "\n".join(x for x in out if x)


def telling(text: str, name: str) -> str:
    """The sentences of a description that say something; '' if they don't add up to four words."""
    if _NOTICE.search(text) and not [s for s in _SENTENCE.split(text) if not _NOTICE.search(s) and len(_WORD.findall(s)) > 5]:
        return ""
    # What stands in one line with a tool's notice is the tool's too.
    text = "\n".join(x for x in text.split("\n") if not _TOOL.search(x))
    own = {p.lower() for p in _NAME_PART.findall(name or "")}
    kept = []
    for s in _SENTENCE.split(text):
        s = s.strip()
        if not s or _MISSING.search(s) or _INHERITED.search(s) or _NOTICE.search(s) or _CODE.search(s):
            continue
        words = [w.lower() for w in _WORD.findall(s)]
        if not words or {p.lower() for w in _WORD.findall(s) for p in _NAME_PART.findall(w)} <= own | _FILLERS:
            continue
        kept.append(s)
    joined = " ".join(kept)
    return joined if len(_WORD.findall(joined)) >= 4 else ""


def functions_in(body: str, name: str, signature: str | None) -> list[Function]:
    """The outer function first; then those defined inside it."""
    at = body.find(signature) if signature else -1
    if at >= 0:
        end = at + len(signature)
    else:
        m = re.search(rf"^(?![ \t]*(?://|#|\*|/\*)).*\b{re.escape(name)}\s*\(", body, re.M) if name else None
        at, end = (m.start(), m.end()) if m else (0, 0)
        close = re.compile(r"\)[^\n{:]*[:{]?").search(body, end)
        end = close.end() if m and close else end
    names = lambda s: frozenset(re.findall(r"\w+", s))
    out = [Function(name or "", at, end, names(body[at:end]))]
    for m in _INNER.finditer(body, end):
        line_end = body.find("\n", m.end())
        out.append(Function(m[1] or m[2], m.start(), line_end if line_end >= 0 else len(body), names(body[m.end() : line_end])))
    return out


def comments_in(body: str) -> list[Comment]:
    """Comment blocks and runs of comment lines, in order."""
    out, blocks = [], []
    for m in _BLOCK.finditer(body):
        out.append(Comment(unmarked(m[0]), m.start(), m.end(), "before"))
        blocks.append(m.start())
    ends = [c.end for c in out]
    for m in _LINES.finditer(body):
        at = bisect_right(blocks, m.start()) - 1
        if at < 0 or m.start() >= ends[at]:
            out.append(Comment(unmarked(m[0]), m.start(), m.end(), "before"))
    return sorted(out, key=lambda c: c.start)


def links_of(f: Function, outer: bool, comments: list[Comment], ends: list[int], strings: dict[int, int], given: int, body: str) -> Iterator[tuple[int, float]]:
    """(comment, how near) of the comments whose place fits the function: the one the parser gave, a
    string at its start, and comments in front of it, with only others, marks and up to four lines between."""
    if outer and given >= 0:
        yield given, 1.0
    if f.body in strings:
        yield strings[f.body], 1.2
    at, start, lines, passed = bisect_right(ends, f.start) - 1, f.start, 0, 0
    while at >= 0:
        c = comments[at]
        between = body[c.end : start]
        lines += between.count("\n")
        if lines > 4 or not _BETWEEN.match(between):
            return
        yield at, 1.1 / (1 + passed + 0.2 * max(0, lines - 1))
        at, start, passed = at - 1, c.start, passed + 1


def weight(near: float, c: Comment, f: Function, name: str) -> float:
    """Weight of a link; 0 if the comment tells nothing."""
    if not telling(description(c.text), f.name or name):
        return 0.0
    tags = set(re.findall(r"(?:[@\\]param|:param|<param name=)\W*(\w+)", c.text))
    parts = {p.lower() for p in _NAME_PART.findall(f.name)}
    told = {w.lower() for w in _WORD.findall(c.text)}
    return near + (0.5 * len(tags & f.params) / len(tags) if tags else 0.0) + 0.2 * len(parts & told) / max(1, len(parts))


def assign(weights: list[list[float]]) -> list[int]:
    """Column of each row (or -1) in a one-to-one assignment of greatest total weight; weights are at least 0.

    Shortest augmenting paths with potentials, the shorter side as rows: O(rows^2 * columns).
    """
    rows, cols = len(weights), len(weights[0]) if weights else 0
    if rows > cols:
        out = [-1] * rows
        for j, i in enumerate(assign([list(c) for c in zip(*weights, strict=True)]) if cols else []):
            if i >= 0:
                out[i] = j
        return out
    u, v, owner = [0.0] * rows, [0.0] * (cols + 1), [-1] * (cols + 1)
    for i in range(rows):
        owner[cols], j = i, cols
        least, way, done = [float("inf")] * (cols + 1), [cols] * (cols + 1), [False] * (cols + 1)
        while owner[j] >= 0:
            done[j] = True
            r, step, to = owner[j], float("inf"), cols
            for k in range(cols):
                if not done[k]:
                    reduced = -weights[r][k] - u[r] - v[k]
                    if reduced < least[k]:
                        least[k], way[k] = reduced, j
                    if least[k] < step:
                        step, to = least[k], k
            for k in range(cols + 1):
                if done[k]:
                    u[owner[k]] += step
                    v[k] -= step
                else:
                    least[k] -= step
            j = to
        while j != cols:
            owner[j] = owner[way[j]]
            j = way[j]
    out = [-1] * rows
    for j in range(cols):
        if owner[j] >= 0 and weights[owner[j]][j] > 0:
            out[owner[j]] = j
    return out


def matched(links: dict[int, dict[int, float]], row: int) -> int:
    """The comment that an assignment of greatest total weight gives to function `row`, or -1.

    links: function -> {comment: weight above 0}. Only the part of the graph that hangs together
    with the function is solved; a function that shares no comment takes its best one.
    """
    of: dict[int, list[int]] = {}
    for f, cs in links.items():
        for c in cs:
            of.setdefault(c, []).append(f)
    rows, cols, todo = {row}, set(), [row]
    while todo:
        for c in links.get(todo.pop(), ()):
            if c not in cols:
                cols.add(c)
                new = [f for f in of[c] if f not in rows]
                rows.update(new)
                todo += new
    if not cols:
        return -1
    if len(rows) == 1:
        return max(links[row], key=lambda c: (links[row][c], -c))
    rs, cs = sorted(rows), sorted(cols)
    at = assign([[links[r].get(c, 0.0) for c in cs] for r in rs])[rs.index(row)]
    return cs[at] if at >= 0 else -1


def documented(body: str | None, name: str | None, signature: str | None, docstring: str | None) -> tuple[str, str] | None:
    """(description, where it stood) of the outer function, or None."""
    if not body or body.isspace():
        return None
    body = re.sub(r"\r\n?", "\n", body)
    signature = re.sub(r"\r\n?", "\n", signature) if signature else None
    name = name or ""
    functions = functions_in(body, name, signature)
    comments = comments_in(body)
    ends, strings, given = [c.end for c in comments], {}, -1
    for f in functions:
        m = _STRING.match(body, f.body)
        if m and f.body not in strings:
            strings[f.body] = len(comments)
            comments.append(Comment(m[2] if m[2] is not None else m[4], f.body, m.end(), "string"))
    if docstring and not docstring.isspace():
        given = len(comments)
        comments.append(Comment(unmarked(re.sub(r"\r\n?", "\n", docstring)), -1, -1, "given"))
    if not comments:
        return None
    links = {
        i: {c: w for c, near in links_of(f, i == 0, comments, ends, strings, given, body) if (w := weight(near, comments[c], f, name)) > 0}
        for i, f in enumerate(functions)
    }
    at = matched(links, 0)
    return (telling(description(comments[at].text), name), comments[at].kind) if at >= 0 else None


def pairs(nodes: DataFrame) -> DataFrame:
    """nodes: (id, type, name, signature, docstring, raw_body).

    (node_id, signature, code, description, stood), one row per documented function.
    """
    picked = nodes.where(F.col("type").isin("function", "method") & F.col("raw_body").rlike(r"\S")).select("id", "name", "signature", "docstring", "raw_body")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [documented(b, n, s, d) for b, n, s, d in zip(pdf["raw_body"], pdf["name"], pdf["signature"], pdf["docstring"], strict=True)]
            pdf = pdf.assign(description=[f and f[0] for f in found], stood=[f and f[1] for f in found]).rename(columns={"id": "node_id", "raw_body": "code"})
            yield pdf[pdf["description"].notna()][["node_id", "signature", "code", "description", "stood"]]

    return picked.mapInPandas(run, "node_id string, signature string, code string, description string, stood string")


def one_per_node(found: DataFrame) -> DataFrame:
    """Of each node the greatest pair; the code travels with it, once per delivery."""
    return found.groupBy("node_id").agg(F.max(F.struct("description", "stood", "code", "signature")).alias("m")).select("node_id", "m.signature", "m.code", "m.description", "m.stood")
