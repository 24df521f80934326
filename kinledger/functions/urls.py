"""Hosts, domains and mail addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinledger.functions.text import clean

# Public mailbox providers, and suffixes of two labels.
MAIL_PROVIDERS = ["gmail.com", "googlemail.com", "yahoo.com", "yahoo.co.in", "yahoo.in", "hotmail.com", "outlook.com", "live.com", "rediffmail.com", "rediff.com", "aol.com", "icloud.com", "protonmail.com", "proton.me", "zoho.com"]
TWO_PART_SUFFIXES = ["co.in", "net.in", "org.in", "gen.in", "firm.in", "ind.in", "co.uk", "org.uk", "com.au", "co.jp", "com.sg", "co.za", "com.br"]
# Fixed value: shape of a mail address.
EMAIL_SHAPE = "^[^\\s@,;<>()\\[\\]]+@[^\\s@,;<>()\\[\\]]+\\.[A-Za-z]{2,}$"


def normalize_hostname(c: Column) -> Column:
    """Lower case without trailing dots and one leading 'www.'; null unless it has a dot and host characters only."""
    x = F.regexp_replace(F.regexp_replace(F.lower(clean(c)), "\\.+$", ""), "^www\\.", "")
    return F.when(x.rlike("^[a-z0-9.-]+$") & F.contains(x, F.lit(".")), x)


def extract_hostname(c: Column) -> Column:
    """Host of a web address, with or without scheme; null for other schemes, white space inside, or no dot."""
    x = clean(c)
    rest = F.regexp_replace(x, "(?i)^https?://", "")
    host = F.regexp_extract(rest, "^(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.when(x.rlike("\\s") | rest.rlike("(?i)^[a-z][a-z0-9+.-]*:(?![0-9])"), None).otherwise(normalize_hostname(host))


def domains_related(a: Column, b: Column) -> Column:
    """Equal or one below the other; false where either is null."""
    return F.coalesce((a == b) | F.endswith(a, F.concat(F.lit("."), b)) | F.endswith(b, F.concat(F.lit("."), a)), F.lit(False))


def domain_label(host: Column) -> Column:
    """The label left of the public suffix; null where there is none."""
    parts = F.filter(F.split(host, "\\."), lambda p: p != "")
    n = F.size(parts)
    two = F.array_join(F.slice(parts, F.greatest(n - 1, F.lit(1)), F.lit(2)), ".")
    at = F.when(two.isin(TWO_PART_SUFFIXES), n - 2).otherwise(n - 1)
    return F.when((n >= 2) & (at >= 1), F.get(parts, at - 1))


def parent_domains(host: Column) -> Column:
    """ARRAY<STRUCT<level, domain>>: the host and its parents, down to two labels, nearest first."""
    parts = F.split(host, "\\.")
    n = F.size(parts)
    levels = F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)))
    return F.when(
        n >= 2, F.transform(levels, lambda i: F.struct(i.alias("level"), F.array_join(F.slice(parts, i + 1, n), ".").alias("domain")))
    )


def parse_emails(c: Column) -> Column:
    """Distinct addresses of a cell in order; blanks beside dots and spelled-out signs are repaired, nothing guessed."""
    x = F.regexp_replace(clean(c), "\\s*\\.\\s*", ".")
    x = F.regexp_replace(x, "(?i)\\[\\s*at\\s*\\]|\\(\\s*at\\s*\\)", "@")
    x = F.regexp_replace(x, "(?i)\\[\\s*dot\\s*\\]|\\(\\s*dot\\s*\\)", ".")
    bare = F.transform(F.split(x, "[;,\\s]+"), lambda e: F.regexp_replace(F.regexp_replace(F.lower(F.trim(e)), "^[\"'<(]+", ""), "[\"'>).,;]+$", ""))
    return F.array_distinct(F.filter(bare, lambda e: e.rlike(EMAIL_SHAPE)))


def email_domain(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("@")), F.nullif(F.lower(F.trim(F.substring_index(c, "@", -1))), F.lit("")))


def is_mail_provider(c: Column) -> Column:
    return F.coalesce(normalize_hostname(c).isin(MAIL_PROVIDERS), F.lit(False))
