"""Column factories for DNS messages: packet types, first-seen tests, positives, logits, zones."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

PACKETS = ("qr", "q", "r", "nx", "ok")
#: Bounds of the zones of a score; the last lies beyond 1, so that 1 is in the last zone.
ZONES = (0.0, 0.1, 0.25, 0.5, 0.9, 1.1)
#: Values that stand for the infinite logits of scores 0 and 1.
NINF, PINF = -50.0, 50.0


def packet_predicate(packet: str) -> Column:
    """Whether a message is of a packet type: all, requests, responses, responses with rcode 3, with rcode 0."""
    response = F.col("is_r")
    return {
        "qr": F.lit(True),
        "q": ~response,
        "r": response,
        "nx": response & (F.col("rcode") == 3),
        "ok": response & (F.col("rcode") == 0),
    }[packet]


def first_seen_predicate(packet: str) -> Column:
    """Whether a message of that type is the first one for its name, by the ranks of with_first_seen()."""
    rank = {"qr": "rn", "q": "rn_qr", "r": "rn_qr", "nx": "rn_qr_rcode", "ok": "rn_qr_rcode"}[packet]
    return packet_predicate(packet) & (F.col(rank) == 1)


def positive(model: int, threshold: float, strict: bool = True) -> Column:
    score = F.col(f"eps{model}")
    return score > threshold if strict else score >= threshold


def logit(score: Column, ninf: float = NINF, pinf: float = PINF) -> Column:
    return F.when(score >= 1, F.lit(pinf)).when(score <= 0, F.lit(ninf)).otherwise(F.ln(score / (1 - score)))


def zone(value: Column, bounds: tuple = ZONES) -> Column:
    """The index of the zone [bounds[i], bounds[i + 1]) of a value; null outside."""
    out = F.lit(None).cast("int")
    for i in range(len(bounds) - 2, -1, -1):
        out = F.when((value >= bounds[i]) & (value < bounds[i + 1]), F.lit(i)).otherwise(out)
    return out


def whitelisted(rank: Column, limit: int) -> Column:
    return F.coalesce((rank > 0) & (rank < limit), F.lit(False))


def all_of(*conditions: Column | None) -> Column:
    """The conjunction of the conditions that are given."""
    return reduce(and_, [c for c in conditions if c is not None], F.lit(True))


def truncated(value: Column, step: int) -> Column:
    """The multiple of step that the floor of the value reaches, towards zero."""
    whole = F.floor(value)
    return (F.when(whole < 0, F.ceil(whole / step)).otherwise(F.floor(whole / step)) * step).cast("long")
