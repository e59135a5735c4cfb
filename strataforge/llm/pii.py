"""Personal data in texts: patterns propose spans, checksums confirm them, context words adjust their score. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.llm.common import table

#: Kinds in the order in which spans of one start stand; the first four are the base kinds, whose spans always stay.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE = 4
#: The patterns, each written so that no run of characters is tried from more than one of its starts: a match begins where
#: the last one ended (\G) or where no character of its first class stands before; possessive parts don't change what matches,
#: as what follows them can't begin with their characters.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: A span's score: its kind's, more where a context word stands within CONTEXT characters before it or after it.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT, BONUS = 40, 0.3
WORDS = {
    "email": "mail|contact|write",
    "ip": "ip|host|server|address",
    "card": "card|credit|visa|pay",
    "phone": "tel|phone|call|mobile",
    "iban": "iban|bank|account",
    "ssn": "ssn|social|security",
}
#: Spans of added kinds need such a score.
ENOUGH = 0.6
#: Matches that one array holds while positions are added up.
RUN = 128


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    d = F.split(F.reverse(digits), "")

    def part(c: Column, i: Column) -> Column:
        n = c.cast("int") * (1 + i % 2)
        return F.when(n > 9, n - 9).otherwise(n)

    return F.aggregate(F.transform(d, part), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number (two letters, two check digits, the rest) leaves 1 when divided by 97."""
    turned = F.split(F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4))), "")
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(turned, F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97) == 1


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return n.between(14, 19) & luhn(_digits(m))
    if kind == "phone":
        return n.between(10, 15)
    if kind == "iban":
        return mod97(m)
    return F.lit(True)


def _placed(text: Column, hits: Column, pattern: str) -> Column:
    """(s, e, m) of each match: the texts between matches and the matches themselves, added up from the left.

    Done spans are kept in arrays of RUN, so a text with many matches isn't copied once for each of them.
    """
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    one = "struct<s:int,e:int,m:string>"
    empty = F.array().cast(f"array<{one}>")
    zero = F.struct(F.lit(0).alias("at"), empty.alias("now"), F.array().cast(f"array<array<{one}>>").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        s = acc.at + F.length(x.p)
        e = s + F.length(x.m)
        span = F.array(F.struct(s.alias("s"), e.alias("e"), x.m.alias("m")))
        full = F.size(acc.now) >= RUN
        return F.struct(e.alias("at"), F.when(full, span).otherwise(F.concat(acc.now, span)).alias("now"), F.when(full, F.concat(acc.done, F.array(acc.now))).otherwise(acc.done).alias("done"))

    pairs = F.arrays_zip(between.alias("p"), hits.alias("m"))
    pairs = F.transform(pairs, lambda x: F.struct(x["p"].alias("p"), x["m"].alias("m")))
    return F.aggregate(pairs, zero, step, lambda acc: F.flatten(F.concat(acc.done, F.array(acc.now))))


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row with n_email, n_ip, n_card, n_phone (base spans) and found, all spans as (start, kind, stop, score) in order.

    Positions are code points, the end exclusive. Null texts count as empty. Account numbers (mod 97) and social security
    numbers (with a context word) are added where they overlap no base span. Equal texts get equal results, all columns
    of docs pass (those named here are replaced), an empty table gives an empty one.
    """
    kinds = list(enumerate(KINDS))
    docs = docs.drop("found", *(f"n_{k}" for k in KINDS[:BASE]))
    names = docs.columns
    out = docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    out = out.withColumns({f"_hits_{k}": F.regexp_extract_all("_text", F.lit(PATTERNS[k]), F.lit(0)) for k in KINDS})
    none = F.array().cast("array<struct<start:int,kind:int,stop:int,score:double>>")

    def spans(i: int, k: str) -> Column:
        def scored(x: Column) -> Column:
            near = F.lower(F.concat(F.substr("_text", F.greatest(F.lit(1), x.s + 1 - CONTEXT), F.least(x.s, F.lit(CONTEXT))), F.lit(" "), F.substr("_text", x.e + 1, F.lit(CONTEXT))))
            score = F.lit(SCORES[k]) + F.when(near.rlike(WORDS[k]), BONUS).otherwise(0.0)
            return F.struct(x.s.alias("start"), F.lit(i).alias("kind"), x.e.alias("stop"), F.least(F.lit(1.0), score).alias("score"))

        placed = F.filter(_placed(F.col("_text"), F.col(f"_hits_{k}"), PATTERNS[k]), lambda x: _valid(k, x.m))
        return F.when(F.size(f"_hits_{k}") > 0, F.transform(placed, scored)).otherwise(none)

    out = out.withColumns({f"_{k}": spans(i, k) for i, k in kinds})
    out = out.withColumn("_base", F.concat(*(F.col(f"_{k}") for k in KINDS[:BASE])))
    more = F.filter(F.concat(*(F.col(f"_{k}") for k in KINDS[BASE:])), lambda x: (x.score >= ENOUGH) & ~F.exists("_base", lambda b: (b.start < x.stop) & (x.start < b.stop)))
    return out.select(*names, *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:BASE]), F.array_sort(F.concat("_base", F.when(F.size("_iban") + F.size("_ssn") > 0, more).otherwise(none))).alias("found"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x.kind), x.start.cast("string"), x.stop.cast("string"))), ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("found", lambda x: x.kind < BASE)
    return docs.select("doc_id", *(f"n_{k}" for k in KINDS[:BASE]), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
