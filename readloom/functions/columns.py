"""Column expressions on reads. Binary columns are read as ISO-8859-1, so that a byte is a character."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.sinks import ALPHABETS, encoding


def chars(c: Column | str) -> Column:
    """A binary column as text, byte by byte; text columns hold such text already."""
    return F.decode((F.col(c) if isinstance(c, str) else c).cast("binary"), "ISO-8859-1")


def read_id(header: Column) -> Column:
    """Up to the first space or tab."""
    return F.regexp_extract(header, "^[^ \\t]*", 0)


def description(header: Column) -> Column:
    """After the first run of spaces and tabs; empty if there is none."""
    return F.regexp_replace(header, "(?s)^[^ \\t]*[ \\t]*", "")


def canonical_id(header: Column) -> Column:
    """The id less a mate suffix /0 to /9, .1 or .2, where something stands before it."""
    return F.regexp_replace(read_id(header), "(?s)^(.+)(?:/[0-9]|[.][12])\\z", "$1")


def read_length(seq: Column) -> Column:
    return F.length(seq).cast("long")


def is_empty(seq: Column) -> Column:
    return F.length(seq) == 0


def phred_scores(qual: Column, quality: str = "phred33") -> Column:
    """Scores as an array; codes below the offset count as 0. For text columns."""
    offset, _, _ = encoding(quality)
    codes = F.filter(F.split(qual, ""), lambda c: c != "")
    return F.transform(codes, lambda c: F.greatest(F.ascii(c) - offset, F.lit(0)))


def phred_sum(qual: Column, quality: str = "phred33") -> Column:
    return F.aggregate(phred_scores(qual, quality), F.lit(0).cast("long"), lambda s, x: s + x)


def in_range(code: Column, quality: str = "phred33") -> Column:
    """Whether a code lies in an encoding's inclusive range."""
    _, low, high = encoding(quality)
    return code.between(low, high)


def first_outside(text: Column, kept: str) -> Column:
    """The index of the first character outside a regular-expression class; null if there is none."""
    good = F.length(F.regexp_extract(text, f"(?s)^[{kept}]*+", 0))
    return F.when(good < F.length(text), good.cast("long"))


def first_bad_base(seq: Column, alphabet: str = "iupac") -> Column:
    return first_outside(seq, ALPHABETS[alphabet.lower()].replace(".-", ".\\-"))


def first_bad_quality(qual: Column, quality: str = "phred33") -> Column:
    """Like first_bad_base; a range whose least is above its most accepts everything."""
    _, low, high = encoding(quality)
    return first_outside(qual, f"\\x{low:02x}-\\x{high:02x}") if low <= high else F.lit(None).cast("long")


def virtual_offset(compressed: Column, inside: Column) -> Column:
    return F.shiftleft(compressed.cast("long"), 16).bitwiseOR(inside.cast("long"))


def virtual_compressed(voffset: Column) -> Column:
    return F.shiftrightunsigned(voffset, 16)


def virtual_inside(voffset: Column) -> Column:
    return voffset.bitwiseAND(F.lit(65535))


def find_lf(text: Column, start: int = 0) -> Column:
    """The index of the first line feed at or after start; -1 if there is none."""
    return (F.locate("\n", text, start + 1) - 1).cast("long")


def count_lf(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long")


def contains_line_break(text: Column) -> Column:
    return F.contains(text, F.lit("\n")) | F.contains(text, F.lit("\r"))


def map_offset(segs: Column, index: Column, fallback: Column) -> Column:
    """The offset in the stream of an index within a field joined of segments."""
    zero = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at"))

    def step(s: Column, x: Column) -> Column:
        here = s["at"].isNull() & (index < s["seen"] + x["len"])
        return F.struct((s["seen"] + x["len"]).alias("seen"), F.when(here, x["offset"] + index - s["seen"]).otherwise(s["at"]).alias("at"))

    return F.coalesce(F.aggregate(segs, zero, step, lambda s: s["at"]), fallback + index)


def record_text(header: Column, seq: Column, qual: Column) -> Column:
    """A record in four lines with a bare separator."""
    return F.concat(F.lit("@"), header, F.lit("\n"), seq, F.lit("\n+\n"), qual, F.lit("\n"))
