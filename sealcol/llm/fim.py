"""Fill-in-the-middle: texts cut into units, two of the cuts chosen by a hash of the id, and the three parts put in another order.

A unit grammar is stated as a regular expression whose matches, left to right, are the units. It is translated to a boundary: a
zero-width place between a character of one class on the left and one of another class on the right (a look-behind and a
look-ahead of one character). Splitting at a zero-width place takes no character away, so the pieces put together are the
text. A text without characters has no units, where splitting would give one empty piece: it is handled apart.

Everything is a column expression, in one scan without a shuffle; what a row needs grows with its own text alone.

Defined cases: a null text is an empty one, and an empty text has form plain, no units and itself as output; texts that hold a
sentinel are left plain; a null id has the empty text as its decimal; equal rows give equal results, whatever row they are;
very long texts are cut whole; an empty table gives no rows; of the input only the two named columns are looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Any sentinel; they do not overlap each other or themselves, so that what stands between them is found again exactly.
SENTINEL = f"{PREFIX}|{SUFFIX}|{MIDDLE}"
ANY = r"[\s\S]"


@dataclass(frozen=True)
class Unit:
    """A unit grammar, and the classes of characters between which its boundary lies."""

    grammar: str
    left: str
    right: str = ANY

    @property
    def boundary(self) -> str:
        return f"(?<={self.left})(?={self.right})"


#: A line with its end; a word with the spaces after it; a run of characters up to and with closing punctuation.
LINES = Unit(r"[^\n]*\n|[^\n]+", r"[\n]")
WORDS = Unit(r"[^ \t\r\n]+[ \t\r\n]*|[ \t\r\n]+", r"[ \t\r\n]", r"[^ \t\r\n]")
SENTENCES = Unit(r"[^.!?]*[.!?]+|[^.!?]+", r"[.!?]", r"[^.!?]")


def units(text: Column, unit: Unit = LINES) -> Column:
    """A text's units in order; none for an empty or null text."""
    return F.when(F.octet_length(text) > 0, F.split(text, unit.boundary, -1)).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Rates:
    """How many of a hundred texts are transformed, how many of those suffix first, and the seed of the choices."""

    seed: int = 7
    transformed: int = 100
    suffix_first: int = 50


def draws(id_: Column, seed: int) -> list[Column]:
    """Four unsigned numbers of 32 bits: the first groups of a SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, *, unit: Unit = LINES, rates: Rates = Rates(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n (units), form (plain, psm or spm), prefix, middle, suffix (null where plain) and output."""
    src = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    h1, h2, h3, h4 = draws(F.col("id"), rates.seed)
    cut = src.withColumns({"u": units(F.col("text"), unit)}).withColumns({"n": F.size("u").cast("long")})
    ends = F.col("n") + 1
    cut = cut.withColumns({"a": F.least(h1 % ends, h2 % ends).cast("int"), "b": F.greatest(h1 % ends, h2 % ends).cast("int")})
    plain = (F.col("n") == 0) | F.col("text").rlike(SENTINEL) | (h3 % 100 >= rates.transformed)
    cut = cut.withColumn("form", F.when(plain, "plain").when(h4 % 100 < rates.suffix_first, "spm").otherwise("psm"))

    def part(first: Column, count: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("u", first, count), ""))

    cut = cut.withColumns({"prefix": part(F.lit(1), F.col("a")), "middle": part(F.col("a") + 1, F.col("b") - F.col("a")), "suffix": part(F.col("b") + 1, F.size("u") - F.col("b"))})
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return cut.select(F.col("id").alias(id_col), "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of, from the output and its form alone."""
    parts = F.split(output, SENTINEL, -1)
    first, second, last = F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), F.get(parts, F.lit(3))
    return F.when(form == "psm", F.concat(first, last, second)).when(form == "spm", F.concat(second, last, first)).otherwise(output)
