"""Public suffixes: one table out of three lists, and the suffixes of domain names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nxtide.functions.domains import base_domain, is_ascii, label_count, plain_characters, suffix_group, well_formed, without_suffix

GROUPS = ("tld", "icann", "private")
#: Suffixes up to which the table is broadcast, some 100 bytes each; beyond, names and suffixes are shuffled.
BROADCAST_ROWS = 500_000


def suffix_table(psl: DataFrame, tldlist: DataFrame, iana: DataFrame) -> DataFrame:
    """(suffix, group, ascii, nlabels, psl, tldlist, iana, psl_section, tldlist_type, iana_type): the three lists merged.

    psl: (suffix, section); tldlist: (suffix, type); iana: (suffix, type). How often a list has
    a suffix is counted; of several rows of a list the least value stays.
    """
    lists = (("psl", psl, "section"), ("tldlist", tldlist, "type"), ("iana", iana, "type"))
    sides = [df.groupBy("suffix").agg(F.count(F.lit(1)).alias(name), F.min(kind).alias(f"{name}_{kind}")) for name, df, kind in lists]
    merged = reduce(lambda a, b: a.join(b, "suffix", "full"), sides).na.fill(0, [n for n, *_ in lists])
    labels = label_count(F.col("suffix"))
    return merged.select("suffix", suffix_group(labels, F.col("psl_section")).alias("group"), is_ascii(F.col("suffix")).cast("int").alias("ascii"), labels.alias("nlabels"), *(n for n, *_ in lists), "psl_section", "tldlist_type", "iana_type")


def parse_domains(names: DataFrame, suffixes: DataFrame, column: str = "dn") -> DataFrame:
    """names with rcode (-1, or how many groups match), bdn, tld, icann, private, their dn_ forms without suffix, and is_valid.

    Each distinct name gives a row for each of its label-aligned endings but itself; those meet
    the suffixes by equality, and the longest of each group stays. Rules with a * are not
    used. The base domain is by the last group that matches.
    """
    usable = suffixes.filter(~F.col("suffix").contains("*") & F.col("group").isin(*GROUPS)).select("suffix", "group")
    if usable.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        usable = F.broadcast(usable)
    lower = F.lower(F.col(column))
    distinct = names.select(F.col(column)).filter(F.col(column).isNotNull()).distinct().withColumn("_dn", lower).withColumn("_good", well_formed(lower))
    labels = F.split("_dn", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, F.size(labels) - i + 1, i), "."))
    parts = distinct.filter("_good").select(column, "_dn", F.explode(endings).alias("suffix"))
    length = F.length("suffix")
    best = parts.join(usable, "suffix").groupBy(column).agg(*(F.max_by(F.when(F.col("group") == g, F.col("suffix")), F.when(F.col("group") == g, length)).alias(g) for g in GROUPS))
    found = distinct.join(best, column, "left")
    dn, tld, icann, private = (F.col(c) for c in ("_dn", *GROUPS))
    last = F.coalesce(private, icann, tld)
    icann_or, private_or = F.coalesce(icann, tld), F.coalesce(private, icann, tld)
    good = F.col("_good")
    keep = lambda c: F.when(good, c)
    matched = sum((c.isNotNull().cast("int") for c in (tld, icann, private)), F.lit(0))
    out = found.select(
        column, F.when(good, matched).otherwise(-1).alias("rcode"), keep(base_domain(dn, last)).alias("bdn"), *GROUPS,
        keep(without_suffix(dn, tld)).alias("dn_tld"), keep(without_suffix(dn, icann_or)).alias("dn_icann"), keep(without_suffix(dn, private_or)).alias("dn_private"), plain_characters(dn).alias("is_valid"),
    )
    return names.join(out, column, "left")
