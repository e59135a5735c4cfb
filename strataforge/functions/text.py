"""Text functions: identifiers, slugs, secrets, diagnostics, paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of secrets, in the order in which they are replaced, and what replaces them.
SECRETS = [
    r"(AKIA[0-9A-Z]{16})",
    r"(gh[pousr]_[a-zA-Z0-9]{36})",
    r"-----BEGIN [A-Z ]+ PRIVATE KEY-----[\s\S]+?-----END [A-Z ]+ PRIVATE KEY-----",
    r"eyJ[A-Za-z0-9_=-]+\.[A-Za-z0-9_=-]+\.?[A-Za-z0-9_.+/=-]*",
    r"sk_(live|test)_[0-9a-zA-Z]{24}",
    r"rk_(live|test)_[0-9a-zA-Z]{24}",
    r"xox[baprs]-[0-9]{12}-[0-9]{12}-[0-9a-zA-Z]{24}",
    r"(?i)(?:api_?key|secret|token|password)[\s\S]{0,10}(?:[A-Za-z0-9/+=]{32,})",
]
MARK = "[REDACTED_SECRET]"


def identifier_tokens(text: Column) -> Column:
    """Lower-case parts of identifiers: camel and Pascal case, acronyms and all signs but letters and digits part them."""
    t = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    t = F.regexp_replace(t, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(t), "[^a-z0-9]+"), lambda x: x != "")


def query_tokens(text: Column) -> Column:
    """Distinct parts of a query of two characters at least."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: F.length(x) >= 2))


def slug(text: Column) -> Column:
    t = F.regexp_replace(F.trim(F.lower(text)), "[^a-z0-9]+", "-")
    return F.substr(F.regexp_replace(t, "^-+|-+$", ""), F.lit(1), F.lit(80))


def redact(text: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, MARK.replace("$", "\\$")), SECRETS, text)


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def fnv1a(token: Column) -> Column:
    """The 32-bit FNV-1a hash of an ASCII token."""
    return F.aggregate(F.transform(F.split(token, ""), F.ascii), F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c.cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(4294967295).cast("long")))


def reason(code: Column, severity: Column, message: Column, hint: Column) -> Column:
    """A diagnostic in one string."""
    return F.concat_ws("|", code, severity, message, F.concat(F.lit("hint="), hint))


def split_reason(r: Column) -> Column:
    """The struct of code, severity, message and hint that a diagnostic's string holds."""
    parts = F.split(r, r"\|")

    def of(code: Column, severity: Column, message: Column, hint: Column) -> Column:
        return F.struct(code.alias("code"), severity.alias("severity"), message.alias("message"), hint.alias("hint"))

    skipped = of(F.concat(F.lit("skipped:"), F.regexp_extract(r, "^skipped:([^ ]*)", 1)), F.lit("info"), r, F.lit("classified artifact"))
    whole = of(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), F.regexp_replace(F.array_join(F.slice(parts, 4, 1000), "|"), "^hint=", ""))
    parse = of(F.lit("PARSE_ERROR"), F.lit("warn"), r, F.lit("partial or unsupported syntax"))
    other = of(F.lit("UNKNOWN_BLINDSPOT"), F.lit("warn"), r, F.lit("inspect manually"))
    return F.when(F.startswith(r, F.lit("skipped:")), skipped).when(F.size(parts) >= 3, whole).when(F.startswith(r, F.lit("Parse error")), parse).otherwise(other)


def specifier_kind(spec: Column) -> Column:
    """What kind of target an import names."""
    starts = lambda *p: reduce(lambda a, b: a | b, (F.startswith(spec, F.lit(x)) for x in p))
    return F.when(starts("@/", "#"), "unresolved_alias").when(starts("."), "unresolved_relative").when(starts("/"), "unresolved_absolute").otherwise("external_package")


def extension(path: Column) -> Column:
    """The last dotted part of the file's name, lower case, or nothing."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def line_of(text: Column, offset: Column) -> Column:
    """The line, from 1, of an offset from 0."""
    return F.length(F.regexp_replace(F.substr(text, F.lit(1), offset.cast("int")), "[^\n]", "")) + 1


def contained(entry: Column) -> Column:
    """Whether an archive entry's path stays inside the folder it is unpacked to."""
    bad = entry.rlike(r"^[/\\]|^[A-Za-z]:|\\|(^|/)\.\.(/|$)")
    return ~bad & (entry != "")


def iso_time(ts: Column) -> Column:
    """A time in UTC as text, to milliseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
