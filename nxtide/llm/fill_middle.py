"""Fill-in-the-middle transformation by escaped markers: text functions only, no Python workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nxtide.llm.common import free_names, text_of, without

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Ends a unit, and begins what stands for a mark or an escape that is part of a text. None of them is a letter.
MARK, ESCAPE, FOR_ESCAPE, FOR_MARK = "\x01", "\x02", "\x03", "\x04"
#: One unit of an escaped text: an escaped character, a run of letters, or any other code point.
UNIT = f"{ESCAPE}[{FOR_ESCAPE}{FOR_MARK}]|[A-Za-z]+|[^A-Za-z]"


def escaped(text: Column) -> Column:
    """text without MARK; every ESCAPE in it is followed by FOR_ESCAPE or FOR_MARK."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + FOR_ESCAPE)), F.lit(MARK), F.lit(ESCAPE + FOR_MARK))


def unescaped(text: Column) -> Column:
    """What escaped() and marks were made of."""
    bare = F.replace(text, F.lit(MARK), F.lit(""))
    return F.replace(F.replace(bare, F.lit(ESCAPE + FOR_MARK), F.lit(MARK)), F.lit(ESCAPE + FOR_ESCAPE), F.lit(ESCAPE))


def part(text: Column, mark: str, count: Column | int) -> Column:
    """What stands before the count-th mark; for a negative count, after that many marks from the end."""
    return F.call_function("substring_index", text, F.lit(mark), count if isinstance(count, Column) else F.lit(count))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 that depend on the seed and the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def holds_marker(text: Column) -> Column:
    return text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)


def restore(output: Column, form: Column) -> Column:
    """The text that an output of that form was made of; null for a null output.

    No part of a rearranged text holds a marker, and none arises where a part meets one, as markers
    begin with < and end with >: each marker is found where it was put.
    """
    body = F.substring(output, len(PREFIX) + 1, 2**31 - 1)
    outer, middle = part(body, MIDDLE, 1), part(body, MIDDLE, -1)
    psm = F.concat(part(outer, SUFFIX, 1), middle, part(outer, SUFFIX, -1))
    spm = F.concat(part(outer, PREFIX, -1), middle, part(outer, PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def transform(docs: DataFrame, seed: int = 1, percent: int = 90, suffix_first: int = 20) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output in place of text; columns of these names are replaced, others stay.

    A text is cut into n units (a run of A-Z and a-z, or any other code point) at two places that the seed and doc_id
    decide. `percent` of the texts are rearranged, `suffix_first` in a hundred of these with their suffix first. Empty texts
    (null is taken as empty) and those that hold a marker stay plain, with null lengths of parts. Rows are taken one by one, so
    that repeated ones give the same; a null id is drawn for as an empty one. An empty table stays empty. A text is
    marked, cut and put together in time linear in its length; nothing is left out of it. Marked, it has to fit into a
    string of 2 GB (some 700 MB of text at worst).
    """
    text, marked, units, a, b, h3, h4, head, prefix, middle, suffix = free_names(docs, *"text marked units a b h3 h4 head prefix middle suffix".split())
    kept = without(docs, "n", "form", "prefix_chars", "middle_chars", "output", "text")
    one, two, three, four = draws(F.col("doc_id"), seed)
    out = docs.select(*kept, text_of(F.col("text")).alias(text), one.alias(a), two.alias(b), three.alias(h3), four.alias(h4))
    out = out.withColumn(marked, F.regexp_replace(escaped(F.col(text)), UNIT, f"$0{MARK}"))
    # a mark is one byte, each unit has one, and nothing else holds any
    out = out.withColumn(units, (F.octet_length(marked) - F.octet_length(F.replace(F.col(marked), F.lit(MARK), F.lit("")))).cast("int"))
    places = [F.col(h) % (F.col(units) + 1) for h in (a, b)]
    out = out.withColumns({a: F.least(*places).cast("int"), b: F.greatest(*places).cast("int")})
    out = out.withColumn(head, part(F.col(marked), MARK, F.col(b)))
    ranked = lambda of, count: unescaped(part(of, MARK, count))
    # the last unit's mark ends the text, so that as many marks from the end leave one unit less
    last = lambda count: F.when(count > 0, ranked(F.col(marked), -count - 1)).otherwise("")
    out = out.withColumns({
        prefix: ranked(F.col(head), F.col(a)),
        middle: F.when(F.col(b) > F.col(a), ranked(F.col(head), F.col(a) - F.col(b))).otherwise(""),
        suffix: last(F.col(units) - F.col(b)),
    })
    plain = (F.col(text) == "") | holds_marker(F.col(text)) | (F.col(h3) % 100 >= percent)
    form = F.when(plain, "plain").when(F.col(h4) % 100 < suffix_first, "spm").otherwise("psm")
    psm, spm = [(PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle)], [(SUFFIX, suffix), (PREFIX, prefix), (MIDDLE, middle)]
    joined = lambda parts: F.concat(*(c for mark, column in parts for c in (F.lit(mark), F.col(column))))
    chars = lambda column: F.when(F.col("form") != "plain", F.length(column).cast("long"))
    return out.withColumn("form", form).select(
        *kept, F.col(units).cast("long").alias("n"), "form", chars(prefix).alias("prefix_chars"), chars(middle).alias("middle_chars"),
        F.when(F.col("form") == "plain", F.col(text)).when(F.col("form") == "psm", joined(psm)).otherwise(joined(spm)).alias("output"),
    )
