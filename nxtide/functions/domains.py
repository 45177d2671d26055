"""Column functions for domain names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The encoder's characters, in the order of their ids from 1; others have 0.
VOCABULARY = "-.0123456789_abcdefghijklmnopqrstuvwxyz"


def reversed_labels(name: Column) -> Column:
    return F.array_join(F.reverse(F.split(name, r"\.")), ".")


def label_count(name: Column) -> Column:
    return F.size(F.split(name, r"\."))


def without_suffix(name: Column, suffix: Column) -> Column:
    """The name without its suffix and the dot before it; the name itself if there is no suffix."""
    cut = F.substring(name, F.lit(1), F.greatest(F.length(name) - F.length(suffix) - 1, F.lit(0)))
    return F.when(suffix.isNull() | (suffix == ""), name).otherwise(cut)


def base_domain(name: Column, suffix: Column) -> Column:
    """The suffix with one more label; the name where there is none."""
    return F.when(suffix.isNull(), name).otherwise(F.call_function("substring_index", name, F.lit("."), -1 - label_count(suffix)))


def last_labels(name: Column, count: int) -> Column:
    return F.substring_index(name, ".", -count)


def well_formed(name: Column) -> Column:
    """No dot at either end, three characters at least, and two labels at least."""
    return ~(name.startswith(".") | name.endswith(".") | (F.length(name) < 3) | (label_count(name) < 2))


def plain_characters(name: Column) -> Column:
    """Whether a name has none of the punctuation that no domain name has."""
    return ~name.rlike(r"""[!"#$%&'()*+,/:;<=>?@\[\\\]^`{|}~]""")


def is_ascii(name: Column) -> Column:
    return ~name.rlike(r"[^\x00-\x7F]")


def suffix_group(labels: Column, section: Column) -> Column:
    """tld for one label; private or icann by the section of the public list; unknown if that doesn't have it."""
    return F.when(labels == 1, "tld").when(section == "private", "private").when(section.isNotNull(), "icann").otherwise("unknown")


def encoded(name: Column, size: int = 60) -> Column:
    """The ids of a name's characters, labels last to first, cut and padded with 0 to a length."""
    letters = F.filter(F.split(F.substring(reversed_labels(F.lower(name)), 1, size), ""), lambda c: c != "")
    ids = F.transform(letters, lambda c: F.coalesce(F.array_position(F.array(*map(F.lit, VOCABULARY)), c), F.lit(0)).cast("int"))
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0), size)), 1, size)


def without_bidi_marks(text: Column) -> Column:
    """Without the marks for the direction of writing."""
    return F.translate(text, "\u200e\u200f\u202a\u202b\u202c\u202d\u202e", "")


def first_dot(text: Column, by: str) -> Column:
    """With the first dot replaced."""
    return F.regexp_replace(text, r"^([^.]*)\.", f"$1{by}")
