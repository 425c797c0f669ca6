"""Pure column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a token is a run of these characters in the lower-cased text.
TOKEN = "[a-z0-9+#._-]+"


def tokens(text: Column) -> Column:
    """Lower-cased tokens in order, repeats included; null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of runs of non-blank characters."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0))).cast("long")


def recency(at: Column, as_of: Column) -> Column:
    """1, .92, .84 or .72 by age in days (30, 180, 365); .65 for unknown times."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 86_400_000_000)
    return F.when(at.isNull(), 0.65).when(age <= 30, 1.0).when(age <= 180, 0.92).when(age <= 365, 0.84).otherwise(0.72)


def normalized(text: Column) -> Column:
    """Trimmed, lower case, white space collapsed, without signs other than a-z, 0-9 and blank."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), r"^\s+|\s+$", ""), r"\s+", " "), "[^a-z0-9 ]+", "")


def lookup_key(text: Column) -> Column:
    """Lower case with only a-z, 0-9 and +#./ - kept, collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9+#./ -]+", " "), " +", " "))


def slug(text: Column) -> Column:
    """Words joined by single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), r"[\s_]+", "-"), "[^a-z0-9-]", ""), "-+", "-"), "^-|-$", "")


def truncated(text: Column, n: int) -> Column:
    """Collapsed text of at most n signs; a cut text ends in three points."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.rtrim(F.substring(flat, 1, n - 1)), F.lit("..."))).otherwise(flat)


def stripped_html(html: Column) -> Column:
    """Tags become blanks, five entities their signs, white space is collapsed."""
    out = F.regexp_replace(html, "<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def url_key(url: Column) -> Column:
    """Lower-cased host without www, and the path without a closing slash; scheme, query and fragment don't count."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?#]*", 0)), r"^www\.", "")
    return F.concat(host, F.regexp_replace(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), "/+$", ""))


def sentences(text: Column) -> Column:
    """Split after . ! or ? with white space, and at line feeds; trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


#: Words that carry no content.
STOPWORDS = ["a", "an", "and", "as", "at", "by", "for", "from", "in", "into", "of", "on", "or", "the", "to", "using", "with"]


def content_tokens(text: Column) -> Column:
    """Different tokens of more than two signs that are no stop words."""
    return F.filter(F.array_distinct(tokens(text)), lambda t: (F.length(t) > 2) & ~t.isin(*STOPWORDS))


def year_month(date: Column) -> Column:
    """Year * 12 + month; open ends are year 9999, no year is 0, no month is June."""
    low = F.lower(F.trim(date))
    year = F.regexp_extract(date, r"(\d{4})", 1)
    month = F.array_position(F.array(*[F.lit(m) for m in ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")]), F.regexp_extract(low, r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)", 1))
    number = F.regexp_extract(date, r"\b(0?[1-9]|1[0-2])\b", 1)
    m = F.when(month > 0, month).when(number != "", F.try_to_number(number, F.lit("99")).cast("long")).otherwise(6)
    return F.when(date.isNull() | low.isin("present", "current", "now", ""), 9999 * 12).when(year == "", 0).otherwise(F.expr("0") + year.try_cast("long") * 12 + m).cast("long")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row, also where ``body`` uses it in the lambdas of array functions."""
    return F.element_at(F.transform(F.array(value), body), 1)
