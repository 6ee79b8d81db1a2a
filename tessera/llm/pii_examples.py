"""Labelled lines for the trees of `pii`, made by rule with DataFrame functions only.

A line is filler, what stands before a value, the value and an end.  Values are drawn from
hashes of the line's number, so the lines are the same in every run and of any number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RANDOM = ["hex32", "hex40", "hex64", "base62", "prefixed", "upper"]
NAMES = ["slug", "snake"]
SECRET_CUES = ['token = "', "api_key: ", "secret=", "password: ", "Bearer ", 'auth_token="', "client_secret: '", 'secret key is "', "pwd=", "private key: ", "access key ", "credentials: ", "key=", "the passwd is "]
ASSIGNED = ['x = "', "value: '", 'conf = "', "set to: ", 'login: "']
PLAIN = ["", "use ", "it was ", "then ", "with ", "see "]
IDS = ["commit ", "sha256:", "md5 ", "checksum: ", 'etag: "', "hash=", "revision ", "digest: ", "trace ", "request ", "session id: ", "build ", "object ", "blob ", "uuid ", "guid="]
LINKS = ["https://example.org/a/", "http://a.example/?id=", "www.example.org/files/", "at images/", "https://b.example/x?v="]
PHONES = ["call ", "tel. ", "phone: ", "fax ", "reach me at ", "mobile: ", "or ", ""]
PEOPLE = ["SSN ", "ssn: ", "social security number: ", "SSN is ", "her number is ", "tax id "]
ACCOUNTS = ["card ", "visa: ", "account ", "card number: ", "account no: "]
PARTS = ["order ", "part no. ", "serial: ", "ref ", "invoice ", "item ", "case ", "ticket ", "sku ", "article "]
#: (what stands before, kinds of values, whether that is personal data); each triple is as likely as any other.
RULES = [
    (SECRET_CUES, RANDOM, True), (SECRET_CUES, RANDOM, True), (ASSIGNED, RANDOM, True), (PLAIN, ["base62", "prefixed", "upper"], True),
    (IDS, ["hex32", "hex40", "hex64", "uuid", "base62"], False), (LINKS, ["hex32", "hex40", "uuid", "base62", "slug"], False), (PLAIN, ["uuid", "hex40", "hex64"], False),
    (SECRET_CUES + ASSIGNED + PLAIN, NAMES, False), (SECRET_CUES + IDS, ["uuid"], False), (PHONES, ["local"], True), (PARTS + IDS, ["local", "odd_local"], False), (PHONES, ["odd_local"], False),
    (PEOPLE, ["ssn"], True), (PARTS + IDS, ["ssn", "odd_ssn"], False), (PEOPLE, ["odd_ssn"], False), (ACCOUNTS, ["digits", "long_digits"], True), (PARTS + IDS, ["digits", "long_digits"], False), (PLAIN, ["digits", "long_digits"], False), (PLAIN, ["digits", "long_digits"], False), (ACCOUNTS + PLAIN, ["odd_iban"], False),
]
WORDS = ["river", "stone", "report", "final", "green", "market", "update", "letter", "number", "garden"]


def _values(h: Column, number) -> dict[str, Column]:
    """Values by kind from a hash of 128 hex digits; number(k) is a whole number drawn anew for each k."""
    base62 = F.translate(F.base64(F.unhex(F.substring(h, 1, 64))), "+/=", "aZ")
    word = lambda k: F.element_at(F.array(*[F.lit(w) for w in WORDS]), (F.pmod(number(k), F.lit(len(WORDS))) + 1).cast("int"))
    figure = lambda k, low, high, width: F.lpad((F.pmod(number(k), F.lit(high - low + 1)) + low).cast("string"), width, "0")
    part = lambda a, n: F.substring(h, a, n)
    local = lambda area, office: F.concat(area, F.element_at(F.array(F.lit("-"), F.lit(" "), F.lit(".")), (F.pmod(number(20), F.lit(3)) + 1).cast("int")), office, F.lit("-"), figure(23, 0, 9999, 4))
    group = lambda k: figure(k, 0, 9999, 4)
    return {
        "hex32": part(1, 32), "hex40": part(1, 40), "hex64": part(1, 64),
        "base62": F.substring(base62, F.lit(1), (F.pmod(number(1), F.lit(20)) + 18).cast("int")),
        "prefixed": F.concat(F.element_at(F.array(F.lit("sk_live_"), F.lit("ghp_"), F.lit("xoxb-"), F.lit("pk_")), (F.pmod(number(2), F.lit(4)) + 1).cast("int")), F.substring(base62, 1, 26)),
        "upper": F.concat(F.lit("AK"), F.upper(F.translate(part(1, 18), "02468", "GKMQX"))),
        "uuid": F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)),
        "slug": F.concat_ws("-", word(3), word(4), word(5), figure(6, 1, 2030, 1)), "snake": F.concat_ws("_", word(7), word(8), word(9), figure(10, 1, 30, 1)),
        "ssn": F.concat_ws("-", figure(11, 1, 665, 3), figure(12, 1, 99, 2), figure(13, 1, 9999, 4)), "odd_ssn": F.concat_ws("-", F.element_at(F.array(F.lit("000"), F.lit("666"), F.lit("931")), (F.pmod(number(14), F.lit(3)) + 1).cast("int")), figure(15, 1, 99, 2), figure(16, 1, 9999, 4)),
        "local": local(figure(21, 201, 989, 3), figure(22, 220, 899, 3)), "odd_local": local(figure(21, 0, 199, 3), figure(22, 0, 199, 3)),
        "digits": F.concat_ws(" ", group(31), group(32), group(33), F.when(F.pmod(number(34), F.lit(2)) == 0, group(35))),
        "long_digits": F.concat(group(31), group(32), group(33), group(35)),
        "odd_iban": F.concat_ws(" ", F.concat(F.lit("DE"), figure(41, 0, 1, 2)), group(42), group(43), group(44), group(45), figure(46, 0, 99, 2)),
    }


def examples(spark: SparkSession, count: int, seed: int = 11) -> DataFrame:
    """(id, text, start, positive): `count` lines with one value each, its first place in code
    points, and whether it is personal data."""
    number = lambda k: F.xxhash64(F.col("id"), F.lit(seed), F.lit(k))
    drawn = lambda values, k: F.element_at(values, (F.pmod(number(k), F.size(values)) + 1).cast("int"))
    texts = lambda values: F.array(*[F.lit(v) for v in values])
    rule = F.array(*[F.struct(texts(cues).alias("cues"), texts(kinds).alias("kinds"), F.lit(label).alias("positive")) for cues, kinds, label in RULES])
    lines = spark.range(count).withColumn("rule", drawn(rule, 51)).select("id", "rule.positive", drawn(F.col("rule.cues"), 52).alias("cue"), drawn(F.col("rule.kinds"), 53).alias("kind"), F.sha2(F.concat_ws(":", "id", F.lit(str(seed))), 512).alias("h"))
    value = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in _values(F.col("h"), number).items()])
    before = F.concat(drawn(texts(["", "note: ", "we saw it. ", "in the log, "]), 54), "cue")
    close = F.when(F.col("cue").endswith('"'), '"').when(F.col("cue").endswith("'"), "'").otherwise("")
    return lines.select("id", F.concat(before, value, close, drawn(texts(["", " and more", ".", ", then"]), 55)).alias("text"), F.char_length(before).alias("start"), "positive")
