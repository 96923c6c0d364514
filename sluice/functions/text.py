"""Text helpers as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sluice.functions.patterns import EDGE, SPACE


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def nfkc(text: Column) -> Column:
    """Unicode NFKC. Python runs only because no built-in has it."""
    return _nfkc(text)


def normalised(text: Column, most: int | None = None) -> Column:
    """Trimmed, white space collapsed, cut to `most` characters if given; null if nothing is left."""
    whole = F.trim(F.regexp_replace(text, f"{SPACE}+", " "))
    return F.nullif(whole if most is None else F.substring(whole, 1, most), F.lit(""))


def escaped(text: Column) -> Column:
    """A literal for use inside a pattern."""
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\/-])", r"\\$1")


def words(text: Column, least: int = 1) -> Column:
    """Distinct lower-case ASCII words and numbers of at least `least` characters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= least))


def fnv1a(text: Column) -> Column:
    """FNV-1a over code points, 32 bits, as eight hex digits."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda a, c: (a.bitwiseXOR(c) * 16777619).bitwiseAND(4294967295))
    return F.lpad(F.lower(F.hex(h)), 8, "0")


def price(text: Column) -> Column:
    """The first amount after a currency sign; null if there is none."""
    found = F.regexp_extract(text, r"(?i)(?:₹|Rs\.?|INR|\$)\s*([0-9][0-9,]*(?:\.[0-9]+)?)", 1)
    return F.nullif(F.regexp_replace(found, ",", ""), F.lit("")).try_cast("double")


def month_label(iso: Column) -> Column:
    """'October 2026' of an ISO date."""
    return F.date_format(F.try_to_date(F.concat(F.substring(iso, 1, 7), F.lit("-01")), "yyyy-MM-dd"), "MMMM yyyy")


def is_iso_date(text: Column) -> Column:
    """YYYY-MM-DD and a day that exists."""
    return text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull()


def journey(task: Column, workflow: str) -> Column:
    """The eight fields of a journey request that ends with `workflow`; null if any is missing or out of range."""
    head = F.trim(F.substring(task, F.lit(1), F.length(task) - len(workflow)))
    pattern = r"(?i)^Book a train from ([^;\n]+) to ([^;\n]+) on (\d{4}-\d{2}-\d{2}); travel class ([^;\n]+); quota ([^;\n]+); passenger age (\d{1,3}); gender ([^;\n]+); berth ([^;\n]+)\.$"
    names = ("from", "to", "date", "travel_class", "quota", "age", "gender", "berth")
    part = {n: F.regexp_extract(head, pattern, i + 1) for i, n in enumerate(names)}
    whole = task.endswith(workflow) & head.rlike(pattern) & (part["from"] != part["to"]) & F.nullif(part["age"], F.lit("")).cast("int").between(1, 120) & is_iso_date(part["date"])
    return F.when(whole, F.struct(*[(F.trim(v) if n not in ("date", "age") else v).alias(n) for n, v in part.items()]))


def share(value: Column, digits: int = 1) -> Column:
    """A percentage, 'Unavailable' for null."""
    return F.coalesce(F.concat(F.format_number(value * 100, digits), F.lit("%")), F.lit("Unavailable"))


def seconds(ms: Column) -> Column:
    return F.coalesce(F.concat(F.format_number(ms / 1000, 2), F.lit(" s")), F.lit("Unavailable"))


def mebibytes(n: Column) -> Column:
    return F.coalesce(F.concat(F.format_number(n / 1048576, 1), F.lit(" MiB")), F.lit("Unavailable"))


def gibibytes(n: Column) -> Column:
    return F.coalesce(F.concat(F.format_number(n / 1073741824, 2), F.lit(" GiB")), F.lit("Unavailable"))


def scrubbed(metadata: Column) -> Column:
    """Log metadata with the values of telling keys replaced."""
    from sluice.functions.patterns import FORBIDDEN_LOG_KEY

    return F.transform_values(metadata, lambda k, v: F.when(k.rlike(FORBIDDEN_LOG_KEY), F.lit("[REDACTED]")).otherwise(v))


def mentions(task: Column, name: Column) -> Column:
    """Whether a lower-case task names something: as whole words, two characters or more, not a number alone."""
    return (F.length(name) >= 2) & ~name.rlike(r"^\d+$") & F.regexp_like(task, F.concat(F.lit("(?i)(?<![A-Za-z0-9_])"), escaped(name), F.lit("(?![A-Za-z0-9_])")))


__all__ = ["EDGE", "escaped", "fnv1a", "gibibytes", "is_iso_date", "journey", "mebibytes", "mentions", "month_label", "nfkc", "normalised", "price", "scrubbed", "seconds", "share", "words"]
