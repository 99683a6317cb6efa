"""Per-document text quality statistics, outlier scores from exact ranks, and the share of prose.

Statistics: number of words, mean word length, share of symbols among non-blank characters, share
of lines ending in sentence punctuation, share of common (function) words. Within each language
the exact empirical distribution of every statistic is found by a range-partitioned sort of its
distinct values and their counts, with the partitions' offsets added; a value's tail probabilities
P(X <= x) and P(X >= x) follow, and a document's outlier score is the sum over statistics of
-ln(smaller tail). Unlike a mean and deviation this needs no shape of the distribution.

Beside it, each line is judged by itself: prose if it has enough words and enough of them are
function words of any of the stated languages (or carry Korean particles and endings); list
entries, table rows, code, encoded and garbled lines and repetition aren't. `share_prose` is the
share of non-blank characters that is prose. `found` decides by that share where it is clear, and by
the outlier score where line by line judgement leaves a document in doubt: what a language consists
of mostly has no outlying score, prose or not.

Defined results: null and blank texts have no words, null shares and no score;
languages compare by their first two letters in lower case, unknown ones as `und`; tied values have
equal ranks; repeated rows are separate documents; an empty table gives no rows; texts are read
whole. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hybridlake.session import cut_lineage

# Function words by language.
FUNCTION_WORDS = frozenset(
    """
    the a an of to and in is it that for on with as was be by at from not but this are has have had which who so if when
    while they you we its them their then than only been out no does do did what because can could should would will may
    must after before once until until yet just into under over about how why where there here these those or nor both
    each any some all more most other such our your his her he she i me my us him were being also very too off up down
    der die das und ist nicht ein eine einen einem einer dem den des mit auf für von zu zum zur im in es wir sich so auch
    bis bevor wenn weil wie war nach noch er sie ohne kann dann aber oder als dass daß wird werden wurde sind hat haben
    bei aus an am um über unter nur schon wo was wer ihn ihm ihr uns euch mich dich man sehr mehr doch denn vor seit gilt
    el la los las un una unos unas de que y en no se es con por para del al su sus lo como más pero cuando si sí hay ha
    después antes está están sin este esta estos estas ese esa eso le les nos ya muy también entre sobre hasta desde o
    porque fue ser son era han donde quien todo toda cada
    le la les un une des du de et est que qui il elle ils elles ne pas en au aux pour dans sur se ce cet cette ces nous
    vous on avec plus son sa ses leur leurs quand si après avant sont par ou où mais sans été avait ont être comme tout
    il y c'est n'est qu'il entre depuis jusqu vers dont lui même
    두 번 서로 또는 및 등 우리는 우리 그래서 그리고 그러나 하지만 다시 먼저 따로 아직 함께 모두 매우 만약 때문에 뒤에 뒤에만 위해 대해 아니라
    """.split()
)
# Particles and endings that mark Korean words in sentences.
KOREAN_ENDINGS = ("을", "를", "에서", "에는", "에만", "에게", "까지", "부터", "으로", "니다", "라면", "는지", "나서", "어서", "아서", "리고", "읽고", "하고", "으면", "지만", "는데", "네요", "어요", "아요", "세요", "니까", "쪽은", "일이", "들이", "분이", "것은", "것이", "히는", "되는", "하는", "다는", "두면")

_EDGE = ".,;:!?()[]{}\"'«»„“”‘’…*`–—-¿¡<>。！？、"
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*\Z")
_LETTERS = re.compile(r"[^\W\d_]+")
_LINE_END = re.compile(r"\r\n|\r|\n")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|[\r\n]+")
_ENDS = re.compile(r"[.!?。！？…][\"')\]»”’*`]*\s*\Z")
_MARK = re.compile(r"\s*(?:[-*+•·‣◦▪–—]|\(?\d{1,3}[.)]|\(?[A-Za-z][.)]|\[[ xX]?\]|#{1,6}|>+)\s+")
_RULE = re.compile(r"[\s|+:=_\-]+\Z")
_BOX = re.compile("[─-╿]{2}")
_GARBLED = re.compile("[\x80-\x9f�]|[ÃÂâìíîïëêã][\x80-\xbf]")
_HANGUL = re.compile("[가-힣]")
#: Other scripts, of which no function words are stated.
_SCRIPTS = re.compile("[Ͱ-֏֐-ࣿऀ-࿿぀-ヿ㐀-鿿]")

OTHER, WORD, COMMON, LETTER = 0, 1, 2, 3


def token_class(token: str) -> int:
    """COMMON for function words, WORD for other words, LETTER for single letters, OTHER for numbers, code and signs."""
    core = token.strip(_EDGE)
    if not core:
        return OTHER
    if not _WORD.match(core):
        if "·" in core or len(core) > 40 or not core.isascii():
            return WORD if core.isalpha() else OTHER
        return OTHER
    low = core.lower()
    if low in FUNCTION_WORDS:
        return COMMON if len(low) > 1 else LETTER
    if _HANGUL.search(low):
        return COMMON if low.endswith(KOREAN_ENDINGS) else WORD
    if len(low) == 1:
        return LETTER
    for joint in ("'", "’"):
        if joint in low and any(part in FUNCTION_WORDS or len(part) == 1 for part in low.split(joint)):
            return COMMON
    return WORD


def _token(token: str) -> tuple[int, int, int, int, int]:
    """(class, letters, letter runs, letters and digits, characters)."""
    runs = _LETTERS.findall(token)
    return token_class(token), sum(map(len, runs)), len(runs), sum(map(str.isalnum, token)), len(token)


class Judge:
    """Statistics of texts; remembers the tokens seen."""

    def __init__(self) -> None:
        self.memo: dict[str, tuple[int, int, int, int, int]] = {}

    def tokens(self, line: str) -> list[tuple[int, int, int, int, int]]:
        memo, out = self.memo, []
        for token in line.split():
            known = memo.get(token)
            if known is None:
                known = _token(token)
                if len(token) < 64:
                    if len(memo) > 200_000:
                        memo.clear()
                    memo[token] = known
            out.append(known)
        return out

    def line(self, line: str) -> tuple[bool, bool, int, int, tuple[int, int, int, int]]:
        """(prose, may continue prose of the line before, words, common words, sums of the tokens' figures)."""
        tokens = self.tokens(line)
        kinds, *figures = zip(*tokens, strict=True)
        sums = letters_in, _, _, size = tuple(map(sum, figures))
        n, common, letters = len(kinds), kinds.count(COMMON), kinds.count(LETTER)
        words = kinds.count(WORD) + common
        no = False, False, words, common, sums
        if letters > 0.5 * n and n > 4:
            return no
        if line.count("|") > 1 or line.count("\t") > 1 or "...." in line or (words == 0 and _RULE.match(line)):
            return no
        ascii_ = line.isascii()
        if not ascii_ and (sum(map(len, _GARBLED.findall(line))) > 0.03 * size or _BOX.search(line)):
            return no
        if n >= 24 and len(set(line.split())) < 0.2 * min(n, 150):
            return no
        mark = _MARK.match(line)
        if mark:
            n = max(1, n - 1)
            size -= len(mark.group().strip())
        if not ascii_ and len(_SCRIPTS.findall(line)) > 0.5 * max(1, letters_in) and len(line) > 8:
            return bool(_ENDS.search(line)), True, words, common, sums
        enough = words >= 4 and common >= 0.18 * words or words >= 3 and common >= 0.34 * words
        # Code names and numbers may be mixed in, but not prevail.
        prose = enough and words + letters >= 0.4 * n and letters_in >= 0.5 * size
        return prose, not mark and words >= 0.6 * n, words, common, sums

    def text(self, text: str | None) -> tuple[int, float | None, float | None, float | None, float | None, float | None]:
        """(words, mean word length, symbols, punctuated lines, common words, prose); the last four are shares."""
        lines = [s for s in _LINE_END.split(text or "") if s and not s.isspace()]
        if not lines:
            return 0, None, None, None, None, None
        repeated, whole = self.repeated(text)
        size = prose_size = words = common = punctuated = in_words = runs = alnum = 0
        wrapped = False
        for s in lines:
            prose, continues, w, c, (n_letters, n_runs, n_alnum, n) = self.line(s)
            ends = bool(_ENDS.search(s))
            # The rest of a sentence that was broken off at a line's end.
            prose = prose or wrapped and continues
            size += n
            words += w
            common += c
            punctuated += ends
            in_words += n_letters
            runs += n_runs
            alnum += n_alnum
            if prose and not whole:
                prose_size += n - sum(len("".join(p.split())) for p in repeated if p in s) if repeated else n
            wrapped = prose and not ends and len(s) >= 40 and not s.rstrip().endswith(":")
        return runs, in_words / runs if runs else 0.0, 1 - alnum / size, punctuated / len(lines), common / words if words else 0.0, max(0, prose_size) / size

    @staticmethod
    def repeated(text: str) -> tuple[set[str], bool]:
        """(sentences that follow themselves at least three times, whether the whole text is one sentence repeated)."""
        parts = [p.strip() for p in _SENTENCE.split(text) if p and not p.isspace()]
        if len(parts) < 2 or len(set(parts)) == len(parts):
            return set(), False
        out, run = set(), 1
        for i in range(1, len(parts) + 1):
            if i < len(parts) and parts[i] == parts[i - 1]:
                run += 1
            else:
                if run >= 4:
                    out.add(parts[i - 1])
                run = 1
        return out, len(set(parts)) == 1


STATISTICS = ("n_words", "mean_word_length", "symbol_share", "punctuated_line_share", "common_word_share")


def language(lang: Column) -> Column:
    """First two letters in lower case; `und` if there are none."""
    two = F.regexp_extract(F.lower(F.trim(lang)), r"^([a-z]{2})(?:[-_].*)?$", 1)
    return F.when(F.length(F.coalesce(two, F.lit(""))) == 2, two).otherwise(F.lit("und"))


def statistics(docs: DataFrame, doc_id: Column, lang: Column, text: Column) -> DataFrame:
    """(doc_id, language, the five statistics, share_prose) of each document, in one pass over the texts."""
    picked = docs.select(doc_id.alias("doc_id"), language(lang).alias("language"), text.alias("_text"))
    kind = picked.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Judge()
        for pdf in batches:
            rows = [judge.text(t) for t in pdf.pop("_text")]
            yield pdf.join(pd.DataFrame(rows, columns=[*STATISTICS, "share_prose"], index=pdf.index, dtype=float))

    numbers = ", ".join(f"{c} double" for c in (*STATISTICS, "share_prose"))
    return picked.mapInPandas(run, f"doc_id {kind}, language string, {numbers}").withColumn("n_words", F.col("n_words").cast("long"))


def tails(values: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, n, tail): exact smaller tail probability of each distinct value within its group.

    Values are counted first, so ties, however many, are one row. The distinct values are sorted by
    range over partitions; each partition's count of a group becomes the offset of the next ones.
    """
    counts = values.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    # Written, since a range partitioning that is evaluated twice may draw other bounds.
    parts = cut_lineage(counts.repartitionByRange(*group, value).withColumn("part", F.spark_partition_id()))
    size = parts.groupBy("part", *group).agg(F.sum("n").alias("size"))
    offsets = size.withColumn("before", F.sum("size").over(Window.partitionBy(*group).orderBy("part")) - F.col("size"))
    offsets = offsets.withColumn("total", F.sum("size").over(Window.partitionBy(*group))).drop("size")
    ranked = parts.join(offsets, ["part", *group])
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("part", *group).orderBy(value))
    return ranked.withColumn("upto", upto).select(*group, value, "n", F.least(F.col("upto"), F.col("total") - F.col("upto") + F.col("n")).alias("k"), "total").select(*group, value, "n", (F.col("k") / F.col("total")).alias("tail"))


def outlier_scores(stats: DataFrame, least_group: int = 1) -> DataFrame:
    """stats with outlier_score; null for blank documents. Each language is ranked by itself; with a `least_group` above 1, those of fewer documents are ranked with the unknown ones."""
    rows = cut_lineage(stats.withColumn("_row", F.monotonically_increasing_id()))
    judged = rows.where("share_prose is not null")
    # Two-letter codes: at most 677 rows.
    size = F.broadcast(judged.groupBy("language").agg(F.count(F.lit(1)).alias("_n")))
    pooled = judged.join(size, "language").withColumn("language", F.when(F.col("_n") < least_group, "und").otherwise(F.col("language")))
    long = pooled.select("_row", "language", F.posexplode(F.array(*[F.round(F.col(c).cast("double"), 9) for c in STATISTICS])).alias("statistic", "value"))
    keys = ["language", "statistic", "value"]
    tail = cut_lineage(tails(long, ["language", "statistic"], "value"))
    # Values that hold more than a 128th of all rows are fewer than 128, and their ranks are sent to
    # every task; the others are joined by a shuffle that has no hot key.
    total = tail.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") > max(1, total // 128)
    marked = long.join(F.broadcast(tail.where(often).select(*keys, "tail")), keys, "left")
    cold = marked.where("tail is null").drop("tail").join(tail.where(~often).select(*keys, "tail"), keys)
    scored = marked.where("tail is not null").select("_row", "tail").unionByName(cold.select("_row", "tail"))
    score = scored.groupBy("_row").agg(F.sum(-F.ln("tail")).alias("outlier_score"))
    return rows.join(score, "_row", "left").drop("_row")


def found(scored: DataFrame, *, surely: float = 0.4, hardly: float = 0.7, full_score: float = 18.0) -> DataFrame:
    """Documents that aren't prose: those of which less than `surely` is prose, and in doubt, up to
    `hardly`, those whose outlier score outweighs the share: it must be at least `full_score` times
    the way from `surely` to `hardly` (6 where half is prose).

    A value that a share s of a language has scores at most -ln s, so a least score for all documents
    would drop junk that makes up most of its language.
    """
    way = (F.col("share_prose") - surely) / (hardly - surely)
    return scored.where(F.col("outlier_score").isNotNull() & ((way < 0) | ((way < 1) & (F.col("outlier_score") >= full_score * way))))
