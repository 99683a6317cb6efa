"""Column functions on text: tokens, normalisation, front matter, hashes, skeletons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with diacritics and their base letters.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
BASE = "aaaaaaceeeeiiiinooooouuuuyy"
#: Namespace of URL-based identifiers (RFC 4122).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def fold(text: Column) -> Column:
    """Lower case without diacritics of Latin letters."""
    return F.translate(F.lower(text), ACCENTED, BASE)


def index_tokens(text: Column) -> Column:
    """Tokens of a full-text index: runs of letters and digits, folded."""
    return F.filter(F.split(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def word_tokens(text: Column, longer_than: int = 0) -> Column:
    """Lower-case words of letters, digits and underscores, longer than a number of characters."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda t: F.length(t) > longer_than)


def symbol_query(query: str) -> list[str]:
    """Terms of a symbol or skill query: split at blanks and - _ . , /; at least two characters."""
    import re

    return [t for t in re.split(r"[\s\-_.,/]+", query) if len(t) >= 2]


def memory_query(query: str) -> list[str]:
    """Terms of a knowledge query: quotes dropped, split at blanks; at least two characters."""
    return [t for t in query.replace('"', "").replace("'", "").split() if len(t) >= 2]


def strip_frontmatter(text: Column) -> Column:
    """The text without a front matter block at its very start."""
    return F.regexp_replace(text, r"(?s)\A---\s*\n.*?\n---\s*\n", "")


def frontmatter(text: Column) -> Column:
    """The front matter's lines, or ''."""
    return F.regexp_extract(text, r"(?s)\A---\s*\n(.*?)\n---", 1)


def front_field(text: Column, field: str) -> Column:
    value = F.regexp_extract(frontmatter(text), rf"(?m)^{field}:\s*(.+)$", 1)
    return F.regexp_replace(F.trim(value), r'^"+|"+$', "")


def title(text: Column, otherwise: Column) -> Column:
    """The first first-level heading, else the given value."""
    found = F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?m)^#\s+(.+)$", 1))
    return F.when(found != "", found).otherwise(otherwise)


def normalize_whitespace(text: Column) -> Column:
    """Lines without blanks around them, empty lines left out, runs of blanks as one."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"\s+", " "))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def uuid5_url(name: Column) -> Column:
    """Name-based UUID (version 5) in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def line_hash(line: Column) -> Column:
    return F.substring(F.sha2(line, 256), 1, 6)


def clamp_message(text: Column, most: int = 250) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def skeleton(signature: Column, docstring: Column, body: Column, detail: str) -> Column:
    """minimal: the signature; standard: with the docstring; other: the first five lines of the body."""
    if detail == "minimal":
        return signature
    if detail == "standard":
        return F.concat_ws("\n", signature, F.when(F.trim(docstring) != "", F.concat(F.lit('    """'), docstring, F.lit('"""'))))
    lines = F.split(body, "\n")
    return F.when(F.size(lines) > 5, F.concat(F.array_join(F.slice(lines, 1, 5), "\n"), F.lit("\n..."))).otherwise(body)


def embedding_text(kind: Column, fqn: Column, signature: Column, body: Column) -> Column:
    """The text of a symbol that is embedded."""
    return F.concat_ws("\n", F.concat_ws(" ", kind, fqn), F.concat(F.lit("Sig: "), signature), F.substring(body, 1, 1200))


def glob_to_regex(glob: str) -> str:
    """A path glob as a Java regular expression; * and ? stay within a path segment only in `**`-free use of fnmatch, so both match any character."""
    import re

    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob) + "$"


def syllables(word: Column) -> Column:
    """Vowel groups, less one for a final e, at least 1."""
    n = F.regexp_count(word, F.lit("[aeiou]+")) - F.when(word.endswith("e"), 1).otherwise(0)
    return F.greatest(n, F.lit(1))
