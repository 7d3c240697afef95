"""Text functions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_message(c: Column) -> Column:
    """Without carriage returns and colons."""
    return F.translate(c, "\r:", "")


def flip_name(c: Column) -> Column:
    """"Last, First" to "First Last", at the first comma; other names stay."""
    parts = F.split(c, ",", 2)
    return F.when(F.size(parts) == 2, F.concat_ws(" ", F.ltrim(F.get(parts, F.lit(1))), F.get(parts, F.lit(0)))).otherwise(c)


def space_tokens(c: Column) -> Column:
    """Lower-case tokens parted by white space."""
    return F.filter(F.split(F.lower(c), r"\s+"), lambda t: t != "")


def non_word_tokens(c: Column) -> Column:
    """Lower-case runs of letters, digits and underscores of any script."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def clean_post(c: Column) -> Column:
    """Links and mentions become words, hash signs and other signs go; A-z keeps the signs between Z and a."""
    c = F.regexp_replace(c, r"((www\.[^\s]+)|(https?://[^\s]+))", "URL")
    c = F.regexp_replace(c, r"@[^\s]+", "AT_USER")
    c = F.regexp_replace(c, r"#([^\s]+)", "$1")
    c = F.lower(F.regexp_replace(c, r"[\n\r]", " "))
    return F.regexp_replace(c, r"[^a-zA-z0-9\s]", "")


def short_date(c: Column) -> Column:
    """Quoted M/D/YYYY to M/D/YY."""
    return F.regexp_replace(F.translate(c, '"', ""), r"/\d\d(\d\d)$", "/$1")
