"""Weakly supervised quality rules, with DataFrame functions only.

Each rule votes keep (1), drop (-1) or abstains (0) on a document, by how far one of its
properties lies from the table's own middle.  Taking the votes as independent given a
hidden class, expectation-maximisation estimates how often each rule casts each vote
on good and on bad documents; the posterior probability of the good class then
replaces a demand that all rules pass.  A vote's weight is bounded, so that no rule
decides alone, and no rule knows a language.

The estimation needs only how often each value of a property and each combination of
votes occurs: tables with a bounded number of rows, counted by Spark over all
documents, whatever their number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize

SPACE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
WINDOW = 5
MARKS = "#*$%&|<>"
#: A vote is keep within NEAR scales of the table's median, and drop beyond FAR.
NEAR, FAR = 2, 6
#: The largest log-likelihood ratios of a single drop and keep vote: a rule knows its own fault
#: when it sees it, but that the fault is missing says little.  The log-odds of good a priori
#: are as large as one drop vote, so that one fault doesn't condemn a document that is
#: otherwise as most are, and two that surely mark bad ones do.
DROP_LIMIT, KEEP_LIMIT = 2.0, 0.1
PRIOR = DROP_LIMIT
#: Values are counted in thousandths, up to this one.
TOP = 100_000


def _without(text: Column, characters: str) -> Column:
    return F.char_length(F.translate(text, characters, ""))


def text_statistics(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, the columns `more` and the counts that the rules use, one row per row; null text has no words.

    n_repeat_words counts the words inside five-word windows that occur twice or
    more in the text; windows are compared by 64-bit hashes within one text.
    """
    text = F.col("text")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)
    kept = [c for c in out.columns if c != "text"]
    out = out.select(*kept, "text", F.filter(F.split(text, SPACE), lambda w: w != "").alias("words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    out = out.select(
        *kept,
        F.size("words").cast("long").alias("n_words"),
        _without(text, " \t\n\x0b\x0c\r").cast("long").alias("word_chars"),
        (F.char_length(text) - _without(text, MARKS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count(text, F.lit(rf"[\p{{L}}\p{{M}}][{MARKS}]")).cast("long").alias("n_glued"),
        F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}\p{M}]++(?![^\x20\x09-\x0D])")).cast("long").alias("n_letterless"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D\p{L}\p{M}]")).cast("long").alias("n_other"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(text, F.lit(r"[.!?](?=\s|$)")).cast("long").alias("n_ends"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    counts = [c for c in out.columns if c != "h"]
    at = lambda i, k: F.get("h", i + k)
    windows = F.when(F.size("h") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    again = lambda k: F.size(F.filter("h", lambda x, i: F.coalesce(x == at(i, -k), F.lit(False)))).cast("long")
    out = out.select(*counts, F.size(F.array_distinct("h")).cast("long").alias("n_distinct"), again(1).alias("n_stutter"), again(2).alias("n_alternate"), windows.alias("windows"))
    counts += ["n_distinct", "n_stutter", "n_alternate"]
    paired = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.select(*counts, F.when(F.size(F.array_distinct("windows")) < F.size("windows"), paired).alias("p"))
    twice = F.filter("p", lambda x, i: F.coalesce(F.get("p", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("p", i + 1)["h"] == x["h"], F.lit(False)))
    out = out.select(*counts, F.when(F.col("p").isNotNull(), F.array_sort(F.transform(twice, lambda x: x["i"]))).alias("at"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate("at", start, lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"])
    return out.select(*counts, F.when(F.col("at").isNotNull(), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"))


def rules() -> dict[str, tuple[Column, int, int]]:
    """The rules: a name, a property of the text in thousandths (null where it can't be told),
    the side on which far values speak against a document (1: high, -1: low, 0: both),
    and the least scale, in thousandths, for tables in which nearly all values agree."""
    share = lambda a, b, least=10: F.when(F.col("n_words") >= least, F.least(F.floor(1000 * F.col(a) / F.when(F.col(b) > 0, F.col(b))), F.lit(TOP)))
    letters = F.when(F.col("n_words") >= 10, F.floor(1000 * (F.col("word_chars") - F.col("n_other")) / F.when(F.col("word_chars") > 0, F.col("word_chars"))))
    return {
        "symbols": (share("n_symbols", "word_chars"), 1, 30),
        "glued": (share("n_glued", "n_words"), 1, 30),
        "letterless": (share("n_letterless", "n_words"), 1, 20),
        "alternation": (share("n_alternate", "n_words"), 1, 20),
        "letters": (letters, -1, 20),
        "capitals": (share("n_upper", "word_chars", 30), 1, 20),
        "sentences": (F.when(F.col("n_words") >= 30, F.least(F.floor(1000 * F.col("n_words") / F.greatest("n_ends", F.lit(0.5))), F.lit(TOP))), 1, 3000),
        "word_length": (share("word_chars", "n_words"), 0, 350),
        "repetition": (share("n_repeat_words", "n_words"), 1, 25),
        "repeated_lines": (share("n_dup_lines", "n_lines"), 1, 50),
        "stutter": (share("n_stutter", "n_words"), 1, 25),
        "vocabulary": (share("n_distinct", "n_words", 30), -1, 100),
    }


def bands(counts: list[tuple[int, int]], least: int) -> tuple[int, int]:
    """(median, scale) of counted values: the scale is the distance of the quartiles, `least` at least."""
    ordered, total = sorted(counts), sum(n for _, n in counts)

    def at(quarter: int) -> int:
        seen = 0
        for value, n in ordered:
            seen += n
            if 4 * seen >= quarter * total:
                return value
        return 0

    return at(2), max(least, at(3) - at(1))


def _middles(stats: DataFrame) -> dict[str, tuple[int, int]]:
    """The band of each rule over the documents that pass the base rules, from a count of each
    value: at most TOP rows a rule."""
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), v.cast("long").alias("value")) for k, (v, *_) in rules().items()])).alias("x")
    rows = stats.where(~F.col("base_failed")).select(values).where("x.value is not null").groupBy("x.rule", "x.value").agg(F.count("*").alias("n")).collect()
    return {k: bands([(r.value, r.n) for r in rows if r.rule == k], least) for k, (_, _, least) in rules().items()}


def rule_votes(middles: dict[str, tuple[int, int]]) -> dict[str, Column]:
    """The vote of each rule from the columns of text_statistics and the bands."""

    def vote(value: Column, side: int, middle: int, scale: int) -> Column:
        off = value - middle if side > 0 else middle - value if side < 0 else F.abs(value - middle)
        return F.when(value.isNull(), 0).when(off > FAR * scale, -1).when(off <= NEAR * scale, 1).otherwise(0).cast("int")

    return {k: vote(v, side, *middles[k]) for k, (v, side, _) in rules().items()}


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> list[dict[int, float]]:
    """EM over counted vote patterns: for each rule the log-likelihood ratio of good
    against bad for each vote (0 for abstaining, which says nothing about the class),
    bounded by the limits above.

    Starts from taking documents with two drop votes or more as bad.  A rule is taken to
    be right more often than wrong: a drop vote never speaks for a document, a keep vote
    never against it.  Add-one smoothing keeps every probability inside (0, 1), and tables
    without rows or with one pattern too.
    """
    width = len(patterns[0][0]) if patterns else len(rules())
    good = [1 / (1 + math.exp(-2.0 * (1.5 - v.count(-1)))) for v, _ in patterns]
    ratios = [dict.fromkeys((-1, 0, 1), 0.0) for _ in range(width)]
    for _ in range(rounds):
        for j in range(width):
            a, b = ({x: sum((g if side else 1 - g) * n for g, (v, n) in zip(good, patterns, strict=True) if v[j] == x) for x in (-1, 1)} for side in (1, 0))
            for vote in (-1, 1):
                ratio = math.log((a[vote] + 1) / (a[-1] + a[1] + 2)) - math.log((b[vote] + 1) / (b[-1] + b[1] + 2))
                ratios[j][vote] = min(KEEP_LIMIT if vote > 0 else DROP_LIMIT, max(0.0, ratio * vote)) * vote
        good = [1 / (1 + math.exp(-max(-60.0, min(60.0, PRIOR + sum(r[x] for r, x in zip(ratios, v, strict=True)))))) for v, _ in patterns]
    return ratios


def _posterior(voted: DataFrame) -> Column:
    """Probability of the good class from the vote columns, estimated on all rows of `voted` that pass the base rules."""
    names = [f"vote_{k}" for k in rules()]
    counted = voted.where(~F.col("base_failed")).groupBy(*names).agg(F.count("*").alias("n")).collect()  # at most 3 ** len(names) rows
    ratios = estimate(sorted((tuple(r[:-1]), r["n"]) for r in counted))
    odds = F.lit(PRIOR)
    for name, ratio in zip(names, ratios, strict=True):
        odds = odds + F.when(F.col(name) == -1, ratio[-1]).when(F.col(name) == 0, ratio[0]).otherwise(ratio[1])
    return 1 / (1 + F.exp(-odds))


def _voted(docs: DataFrame, *more: Column) -> DataFrame:
    """The counts, base_failed and the votes for rows (doc_id, text), with the columns `more`; the texts are measured once."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = materialize(text_statistics(docs, *more).withColumn("base_failed", failed), "statistics")
    return stats.select("*", *[v.alias(f"vote_{k}") for k, v in rule_votes(_middles(stats)).items()])


def quality_rules(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """One row per row of `docs` (doc_id, text): the counts, base_failed, quality, kept, the votes.

    base_failed: fewer than 10 words, or more than 20 % of the words repeat in
    five-word windows.  Otherwise a document is kept when its posterior quality
    reaches `least`; bands and estimation use the documents that pass the base rules.
    Null, empty and wordless texts fail the base rules; repeated rows
    each get a row, null doc_ids too; other columns are ignored; an empty table gives none.
    """
    voted = _voted(docs)
    quality = _posterior(voted)
    votes = [f"vote_{k}" for k in rules()]
    return voted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (quality >= least)).alias("kept"), quality.alias("quality"), *votes)


def keep_good(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of `docs` that quality_rules keeps, columns unchanged.

    The rows travel with their votes, so each is judged by its own text, whatever
    doc_ids repeat or are null, and no join is needed.
    """
    voted = _voted(docs, F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"))
    return voted.where(~F.col("base_failed") & (_posterior(voted) >= least)).select("doc.*")
