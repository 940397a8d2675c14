"""Generalisers and buckets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_Y, _A = r"(?U)(?<!\d)((?:19|20)\d{2})", r"[-_.年]"
#: Fixed bands: upper bound and label of counts; bytes and label of sizes.
COUNTS = ((0, "0"), (4, "1-4"), (9, "5-9"), (19, "10-19"), (49, "20-49"), (99, "50-99"), (499, "100-499"), (999, "500-999"))
SIZES = ((1, "0 B"), (1 << 10, "<1 KB"), (10 << 10, "1-10 KB"), (100 << 10, "10-100 KB"), (1 << 20, "100 KB-1 MB"), (10 << 20, "1-10 MB"), (100 << 20, "10-100 MB"), (1 << 30, "100 MB-1 GB"))
ROLES = (("技术人员", "工程师 程序员 设计师 cto 技术"), ("管理人员", "经理 总监 总裁 董事长 ceo cfo coo"), ("医疗人员", "医生 护士 医师"), ("教育人员", "教师 老师 教授"))


def date(c: Column) -> Column:
    """One step coarser: a day to its month, a month to its year, a year to a mark."""
    day, month = _Y + _A + r"(\d{1,2})[-_.月]\d{1,2}日?(?!\d)", _Y + _A + r"\d{1,2}月?(?!\d)"
    return F.when(c.rlike(day), F.concat(F.regexp_extract(c, day, 1), F.lit("-"), F.lpad(F.regexp_extract(c, day, 2), 2, "0"))).when(c.rlike(month), F.regexp_extract(c, month, 1)).otherwise("[DATE]")


def location(c: Column) -> Column:
    """The city that a longer place names, else a mark."""
    city = "([一-鿿]{2,8}市)"
    return F.when(c.rlike(city) & ~c.endswith("市"), F.regexp_extract(c, city, 1)).otherwise("[LOCATION]")


def role(c: Column) -> Column:
    out = F.lit("[ROLE]")
    for label, words in reversed(ROLES):
        out = F.when(F.lower(c).rlike("|".join(words.split())), label).otherwise(out)
    return out


def school(c: Column) -> Column:
    return F.when(c.isNotNull(), F.lit("[EDUCATION_ORG]"))


def bucket_count(c: Column) -> Column:
    out = F.lit("1000+")
    for upper, label in reversed(COUNTS):
        out = F.when(c <= upper, label).otherwise(out)
    return F.when(c.isNotNull(), out)


def bucket_size(c: Column) -> Column:
    out = F.lit("1 GB+")
    for below, label in reversed(SIZES):
        out = F.when(c < below, label).otherwise(out)
    return F.when(c.isNotNull(), out)


def human_size(c: Column) -> Column:
    """Bytes in the largest unit that keeps a whole part, with one digit beyond bytes."""
    out = F.concat(F.format_number(c / float(1 << 40), 1), F.lit(" TB"))
    for power, unit in ((30, "GB"), (20, "MB"), (10, "KB")):
        out = F.when(c < float(1 << (power + 10)), F.concat(F.format_number(c / float(1 << power), 1), F.lit(f" {unit}"))).otherwise(out)
    return F.regexp_replace(F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B"))).otherwise(out), ",", "")


def apply(value: Column, operator: Column, replacement: Column) -> Column:
    """identity, drop, redact, generalize or substitute; the last two fail without a replacement."""
    must = F.coalesce(replacement, F.raise_error(F.concat(operator, F.lit(" needs a replacement"))).cast("string"))
    return (
        F.when(operator == "identity", value).when(operator == "drop", F.lit(None).cast("string")).when(operator == "redact", F.coalesce(replacement, F.lit("[REDACTED]")))
        .when(operator.isin("generalize", "substitute"), must).otherwise(F.raise_error(F.concat(F.lit("unknown operator "), operator)).cast("string"))
    )


def csv_safe(c: Column) -> Column:
    """A value that no spreadsheet takes for a formula."""
    return F.when(c.rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def active_value(c: Column) -> Column:
    """Whether a spreadsheet would run it."""
    return c.rlike(r"^[=+\-@\t\r]")


def display_text(c: Column) -> Column:
    """Control and direction characters shown as code points, so that a name cannot pose as another."""
    hidden = "[\\x00-\\x1f\\x7f-\\x9f\\u200e\\u200f\\u202a-\\u202e\\u2066-\\u2069]"
    shown = lambda x: F.when(x.rlike(hidden), F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(x))), 4, "0"))).otherwise(x)
    return F.when(c.rlike(hidden), F.array_join(F.transform(F.split(c, ""), shown), "")).otherwise(c)
