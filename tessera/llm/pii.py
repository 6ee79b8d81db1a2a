"""Personal data by candidate gradient boosting, with DataFrame functions only.

Fixed patterns with validators give the base spans.  High-recall generators
propose further, overlapping spans; boosted trees score them from format and
context, and a threshold per kind, calibrated for precision, selects what is
redacted besides.  The trees learn from lines made by rule (pii_examples), in which it
is known what is personal data and what only looks like it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import boosting
from .pii_examples import examples
from .store import fields, materialize, numbered, unnumbered

SPAN = "array<struct<start:int,end:int,context:string,value:string>>"
CHUNK = 256  # matches whose places are summed up at once
CONTEXT = 24  # characters before a match that are looked at, back to the match before

#: Base kinds in order.  The patterns match what the plain ones match
#: (`[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+` and so on), but are
#: possessive and start only where a run starts, so no text makes them backtrack.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that a text must pass to be searched.
_NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]"}

#: Lengths of account numbers by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """The country's length, or else any of 15 to 35 characters; groups of four may have a space between."""

    def groups(size: int) -> str:
        return rf"(?: ?[A-Z0-9]{{4}}){{{size // 4}}}" + (rf" ?[A-Z0-9]{{{size % 4}}}" if size % 4 else "")

    known = [rf"(?:{v.replace(' ', '|')})[0-9]{{2}}{groups(k - 4)}" for k, v in IBAN_LENGTHS.items()]
    other = rf"[A-Z]{{2}}[0-9]{{2}}(?:(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?|{groups(11)})"
    return rf"(?<![A-Za-z0-9])(?:{'|'.join([*known, other])})(?![A-Za-z0-9])"


#: Generators of further candidates, by the kind that a selected span gets.
PROPOSED = {
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{16,}+",
    "hex": r"(?<![A-Za-z0-9])[0-9a-fA-F]{24,}+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local": r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "digits": r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){2,4}+(?![0-9])",
    "iban": _iban(),
}
#: As _NEEDS: what every match of a generator holds, so that no match depends on other text.
_PROPOSED_NEEDS = {
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16}", "hex": r"(?<![A-Za-z0-9])[0-9a-fA-F]{24}", "ssn": r"[0-9]{3}-[0-9]{2}-",
    "local": r"[0-9]{3}[ .-][0-9]{4}", "digits": r"[0-9]{4}[ -]?[0-9]{4}", "iban": r"[A-Z]{2}[0-9]{2}",
}
KINDS = list(PROPOSED)
#: What the characters before a candidate say, first that fits; its place from 1 is the feature.
CONTEXTS = [
    r"(?i)(?:token|secret|key|passw(?:or)?d|pass|pwd|auth|bearer|credentials?)[a-z_]{0,4}(?: is)?[^A-Za-z0-9]{1,6}$",
    r"(?i)(?:https?:|www\.)[^\s]*$|[A-Za-z0-9]/$",
    r"(?i)(?:commit|sha-?[0-9]*|md5|checksum|etag|hash|rev(?:ision)?|uuid|guid|digest|build|version|trace|request|session|id|object|blob)[^A-Za-z0-9]{1,6}$",
    r"(?i)(?:phone|tel|call|fax|mobile|cell|reach me at)[^A-Za-z0-9]{0,4}$",
    r"(?i)(?:ssn|social(?: security)?|tax id|card|visa|account|iban)(?: (?:number|no))?(?: is)?[^A-Za-z0-9]{1,4}$",
    r"(?i)(?:order|part|no|serial|ref|invoice|item|isbn|sku|case|ticket|article)[^A-Za-z0-9]{1,6}$",
]
FEATURES = ("kind", "length", "digits", "letters", "shape", "context", "quoted", "entropy", "evidence")
NOMINAL = frozenset(FEATURES.index(f) for f in ("kind", "letters", "shape", "context"))
PRECISION = 0.97
#: Examples, and the parts in which they are scored by trees that haven't seen them.
EXAMPLES, FOLDS = 6000, 3
_SSN = r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"
_LOCAL_NUMBER = r"^[2-9][0-9]{2}(?![0-9]11)[2-9][0-9]{6}$"


def _found(text: Column, pattern: str, needs: Column) -> Column:
    """Leftmost non-overlapping matches as (start, end, context, value), in code points, end exclusive.

    Places are running sums of lengths, over chunks of CHUNK matches and then over
    the chunks, so that a text with many matches isn't slower by their square.
    """
    piece = lambda a, b: F.struct(F.char_length(a).cast("int").alias("gap"), F.right(a, F.lit(CONTEXT)).alias("context"), b.alias("value"))
    matches = F.filter(F.zip_with(F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), piece), lambda x: x["value"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(s, x):
        first = s["at"] + x["gap"]
        end = first + F.char_length(x["value"])
        span = F.struct(first.alias("start"), end.alias("end"), x["context"].alias("context"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(span)).alias("out"))

    def placed(m):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / CHUNK).cast("int")), lambda c: F.aggregate(F.slice(m, c * CHUNK + 1, F.lit(CHUNK)), start, step))

    def moved(chunks):
        bases = F.aggregate(chunks, F.array(F.lit(0)), lambda at, c: F.concat(at, F.array(F.element_at(at, -1) + c["at"])))
        shift = lambda c, base: F.transform(c["out"], lambda s: F.struct((s["start"] + base).alias("start"), (s["end"] + base).alias("end"), s["context"].alias("context"), s["value"].alias("value")))
        return F.flatten(F.zip_with(chunks, F.slice(bases, F.lit(1), F.size(chunks)), shift))

    some = lambda m: F.when(F.size(m) > 0, _let(placed(m), moved)).otherwise(F.array().cast(SPAN))
    return F.when(needs, _let(matches, some)).otherwise(F.array().cast(SPAN))


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def step(total, i):
        d = F.substring(F.reverse(digits), i, F.lit(1)).try_cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), lambda t, i: F.coalesce(step(t, i), F.lit(0))) % 10 == 0


def _octet(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), _octet)
    size = F.length(_digits(value))
    if kind == "card":
        return size.between(16, 19) & F.when(size.between(16, 19), luhn(_digits(value))).otherwise(F.lit(False))
    return size.between(8, 15) if kind == "phone" else F.lit(True)


def iban(value: Column) -> Column:
    """Whether an account number has its country's length and the right check digits."""
    bare = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))
    known = F.create_map(*[F.lit(x) for size, names in IBAN_LENGTHS.items() for name in names.split() for x in (name, size)])

    def step(rest, i):
        code = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(code < 58, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    right = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(moved), F.lit(1))), F.lit(0), step) == 1
    return F.coalesce(F.length(bare) == F.try_element_at(known, F.substring(bare, 1, 2)), F.lit(False)) & right


def entropy(value: Column) -> Column:
    """Bits per character of the character frequencies."""
    size = F.char_length(value)
    share = lambda c: (size - F.char_length(F.replace(value, c, F.lit("")))) / size
    return F.aggregate(F.array_distinct(F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))), F.lit(0.0), lambda bits, c: bits - share(c) * F.log2(share(c)))


def _evidence(kind: str, value: Column) -> Column:
    """Whether the value itself speaks for its kind, by what is no feature."""
    if kind in ("secret", "hex"):
        mixed = 8 * F.regexp_count(value, F.lit("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")) >= F.char_length(value)
        return (entropy(value) >= 3) & mixed if kind == "secret" else (entropy(value) >= 2) & (mixed | ~value.rlike("[0-9]"))
    if kind == "digits":
        return F.length(_digits(value)).between(12, 19) & luhn(_digits(value))
    return iban(value) if kind == "iban" else value.rlike(_SSN) if kind == "ssn" else _digits(value).rlike(_LOCAL_NUMBER)


def _candidates(text: Column) -> Column:
    """All generators' spans with their features, evidence and part, as small integers."""

    def described(kind: str) -> Column:
        def one(s):
            value, size = s["value"], s["end"] - s["start"]
            before = s["context"]
            digits = F.length(_digits(value))
            letters = F.when(value.rlike("[a-z]"), 1).otherwise(0) + F.when(value.rlike("[A-Z]"), 2).otherwise(0)
            uuid = value.rlike("(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
            context = F.lit(0)
            for k, cue in reversed(list(enumerate(CONTEXTS, 1))):
                context = F.when(before.rlike(cue), k).otherwise(context)
            feature = {
                "kind": F.lit(KINDS.index(kind)),
                "length": F.when(size <= 12, 0).when(size <= 16, 1).when(size <= 20, 2).when(size <= 32, 3).when(size <= 64, 4).otherwise(5),
                "digits": F.floor(5 * digits / size).cast("int"),
                "letters": letters,
                # names of words between marks, and long runs of letters, are rarely drawn at random
                "shape": F.when(uuid, 1).when(value.rlike("^[0-9a-fA-F]+$"), 2).when(value.rlike("[a-z]{3,}[_-][a-z]{3,}|^[a-z]{4,}[_-]?[0-9]+$"), 3).otherwise(0),
                "context": context,
                "quoted": before.rlike("[\"'=:]\\s?$").cast("int"),
                "entropy": F.least(F.floor(2 * entropy(value)), F.lit(10)),
                "evidence": _evidence(kind, value),
            }
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), *[v.cast("int").alias(k) for k, v in feature.items()])

        return F.transform(_found(text, PROPOSED[kind], text.rlike(_PROPOSED_NEEDS[kind])), one)

    return F.concat(*[described(k) for k in KINDS])


def spans_of(docs: DataFrame) -> DataFrame:
    """row, doc_id, the arrays of valid base spans by kind, and the candidates, for rows (row, doc_id, text)."""
    own = docs.select("row", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    found = own.select("row", "doc_id", "text", *[_found(text, p, text.rlike(_NEEDS[k])).alias(k) for k, p in BASE.items()])
    place = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    keep = lambda kind: lambda s: _valid(kind, s["value"])
    valid = [F.transform(F.filter(k, keep(k)), place).alias(k) for k in BASE]
    return found.select("row", "doc_id", *valid, _candidates(text).alias("candidates"))


BUCKET = 64  # characters of the stretches in which spans are matched with each other


def _buckets(span: Column) -> Column:
    return F.explode(F.sequence(F.floor(span["start"] / BUCKET), F.floor((span["end"] - 1) / BUCKET)))


def _compared(kept: DataFrame) -> DataFrame:
    """The candidates, a row each (row, c), with `blocked`: a base span is met but not held whole
    and exceeded.

    Spans meet in stretches of BUCKET characters, so work grows with the text, not
    with pairs of spans.
    """
    one = kept.select("row", F.explode("candidates").alias("c"))
    base = kept.select("row", F.explode(F.concat(*BASE)).alias("b"))
    near = one.withColumn("at", _buckets(F.col("c"))).join(base.withColumn("at", _buckets(F.col("b"))), ["row", "at"])
    near = near.where((F.col("c.start") < F.col("b.end")) & (F.col("b.start") < F.col("c.end")))
    holds = (F.col("c.start") <= F.col("b.start")) & (F.col("c.end") >= F.col("b.end")) & (F.col("c.end") - F.col("c.start") > F.col("b.end") - F.col("b.start"))
    flags = near.groupBy("row", "c.kind", "c.start").agg(F.max((~holds).cast("int")).alias("blocked"))
    flags = flags.withColumnsRenamed({"row": "_row", "kind": "_kind", "start": "_start"})
    joined = one.join(flags, (F.col("row") == F.col("_row")) & (F.col("c.kind") == F.col("_kind")) & (F.col("c.start") == F.col("_start")), "left")
    return joined.select("row", "c", F.coalesce("blocked", F.lit(0)).alias("blocked"))


def _islands(spans: DataFrame, *more: Column) -> DataFrame:
    """(row, start, end, more) of each union of overlapping spans (row, start, end) of a row."""
    order = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.coalesce(F.col("start") >= F.max("end").over(order), F.lit(True)).cast("long")
    marked = spans.withColumn("_begins", begins)
    upto = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("_island", F.sum("_begins").over(upto))
    return marked.groupBy("row", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), *more).drop("_island")


def learn(spark: SparkSession, precision: float = PRECISION, count: int = EXAMPLES) -> tuple[tuple[float, list], list[float]]:
    """The trees and the threshold of each kind, from counts of equal feature combinations of `count` examples.

    Thresholds come from scores that trees of the other folds give to a fold.
    """
    lines = examples(spark, count)
    found = lines.select("id", "start", "positive", F.explode(_candidates(F.col("text"))).alias("c"))
    same = found.where(F.col("c.start") == F.col("start"))
    counted = same.groupBy(*[F.col(f"c.{f}").alias(f) for f in FEATURES], (F.crc32(F.col("id").cast("string").cast("binary")) % FOLDS).alias("fold")).agg(F.count("*").alias("n"), F.sum(F.col("positive").cast("int")).alias("p")).collect()
    rows = sorted((tuple(r[:-3]), r["fold"], float(r["n"]), float(r["p"])) for r in counted)
    scored = []
    for fold in range(FOLDS):
        part = boosting.fit(_pooled([(x, n, p) for x, f, n, p in rows if f != fold]), nominal=NOMINAL)
        scored += [(x[0], (boosting.predict(part, x), n, p)) for x, f, n, p in rows if f == fold]
    model = boosting.fit(_pooled([(x, n, p) for x, _, n, p in rows]), nominal=NOMINAL)
    return model, [boosting.threshold([s for k, s in scored if k == kind], precision) for kind in range(len(KINDS))]


def _pooled(rows: list[boosting.Pattern]) -> list[boosting.Pattern]:
    out: dict[tuple[int, ...], list[float]] = {}
    for x, n, p in rows:
        sums = out.setdefault(x, [0.0, 0.0])
        sums[0] += n
        sums[1] += p
    return [(x, n, p) for x, (n, p) in sorted(out.items())]


def _find(docs: DataFrame, precision: float) -> DataFrame:
    """row, doc_id, base and added of find_personal_data for rows (row, doc_id, text)."""
    kept = materialize(spans_of(docs), "spans")
    compared = materialize(_compared(kept), "candidates")
    model, least = learn(docs.sparkSession, precision)

    proved = (F.col("c.kind") == KINDS.index("iban")) & (F.col("c.evidence") == 1)
    score = F.when(proved, 2.0).otherwise(boosting.expression(model, [F.col(f"c.{f}") for f in FEATURES]))
    bar = F.element_at(F.array(*[F.lit(float(t) - 1e-9) for t in least]), F.col("c.kind") + 1)
    passed = compared.withColumn("score", score).where((F.col("score") >= bar) & (F.col("blocked") == 0))
    passed = passed.select("row", "c.start", "c.end", "c.kind", "score")
    best = F.max_by("kind", F.struct("score", F.col("end") - F.col("start"), -F.col("start"), -F.col("kind"))).alias("kind")
    names = F.array(*[F.lit({"hex": "secret", "local": "phone", "digits": "card"}.get(k, k)) for k in KINDS])
    entry = F.struct("start", "end", F.element_at(names, F.col("kind") + 1).alias("kind"))
    added = _islands(passed, best).groupBy("row").agg(F.sort_array(F.collect_list(entry)).alias("added"))
    added = added.select("row", F.transform("added", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("added"))

    named = lambda kind: lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    merged = F.concat(*[F.transform(k, named(k)) for k in BASE])
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return kept.join(added, "row", "left").select("row", "doc_id", merged.alias("base"), F.coalesce("added", none).alias("added"))


def find_personal_data(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, base (array of kind, start, end by
    kind as in BASE, then start), added (the selected candidates, by start).

    Offsets are code points, ends exclusive.  The trees learn from lines made by rule,
    with personal data after cue words and without, and with what only looks like it:
    digests of commits, identifiers in addresses, names of words, part numbers.
    Features are the format of a candidate, what stands before it and whether the value
    itself speaks for its kind (check digits, number rules, entropy).  Thresholds come from
    examples that the trees haven't seen.  An account
    number that passes its check is selected in any case.  A candidate that overlaps a base
    span is selected only when it holds all of that span and more.  Selected candidates that
    overlap become one span, with the kind of the best.  Counts of equal feature
    combinations are enough for the trees, so the driver sees a table that is bounded by
    the features' levels.  Null and empty texts have no spans; every row gets its own
    result, whatever doc_ids repeat or are null; other columns are ignored.
    """
    return _find(unnumbered(docs), precision).drop("row")


PART = 4096  # characters of the parts in which texts are redacted


def redact(docs: DataFrame, mask: str = "[redacted]") -> DataFrame:
    """`docs` with every span in its text replaced by `mask`, overlapping ones by a single one; columns as they were.

    Texts with spans are cut into parts, each of which is redacted by itself, so
    long texts with many spans take no more than in proportion.
    """
    rows = numbered(docs)
    spans = _find(fields(rows), PRECISION).select("row", F.explode(F.concat("base", "added")).alias("s")).select("row", "s.start", "s.end")
    spans = materialize(_islands(spans), "redacted")
    at = F.explode(F.sequence(F.floor(F.col("start") / PART), F.floor((F.col("end") - 1) / PART))).alias("at")
    low, high = F.col("start") - F.col("at") * PART, F.col("end") - F.col("at") * PART
    cuts = spans.select("*", at).groupBy("row", "at").agg(F.sort_array(F.collect_list(F.struct(F.greatest(low, F.lit(0)).cast("int").alias("a"), F.least(high, F.lit(PART)).cast("int").alias("b"), (low >= 0).alias("begins")))).alias("cuts"))
    parts = fields(rows).join(spans.select("row").distinct(), "row").select("row", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))).alias("at", "part"))

    def step(s, x):
        kept = F.concat(s["out"], F.substring(F.col("part"), s["at"] + 1, x["a"] - s["at"]), F.when(x["begins"], mask).otherwise(""))
        return F.struct(x["b"].alias("at"), kept.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    new = F.aggregate("cuts", start, step, lambda s: F.concat(s["out"], F.substring(F.col("part"), s["at"] + 1, F.lit(PART))))
    joined = parts.join(cuts, ["row", "at"], "left").select("row", "at", F.coalesce(new, "part").alias("part"))
    texts = joined.groupBy("row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "").alias("new"))
    return rows.join(texts, "row", "left").select(F.col("doc").withField("text", F.coalesce("new", F.col("doc.text"))).alias("doc")).select("doc.*")


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def summary(found: DataFrame) -> DataFrame:
    """The counts and digests of find_personal_data's result; n_spans counts all spans, n_added those the method adds."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    kinds = [*BASE, "secret", "ssn", "iban"]
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in kinds]), s["kind"])
    everything = F.transform(F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(rank(s).alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: F.struct(s["kind"], s["start"], s["end"]))
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(everything).alias("spans"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"), F.size("added").cast("long").alias("n_added"),
    )
