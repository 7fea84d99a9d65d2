"""String expressions: lines, paths, names, fences, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scan import bound

#: What splits lines, as Python's splitlines() does.
ONE_END = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
LINE_ENDS = rf"\r\n|[{ONE_END}]"
WORD = r"[\p{L}\p{N}_]+"


def lines(text: Column) -> Column:
    """Lines of a text; no empty one after a last line end, none of an empty text."""
    return bound(F.split(text, LINE_ENDS, -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def words_and_chars(text: Column) -> Column:
    """Token estimates: word_based counts words, char_based a quarter of the characters."""
    words = F.regexp_count(text, F.lit(WORD)).cast("bigint")
    return F.struct(F.coalesce(words, F.lit(0)).alias("word_based"), F.coalesce(F.floor(F.length(text) / 4), F.lit(0)).cast("bigint").alias("char_based"))


def whitespace_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+")).cast("bigint")


def stripped(text: Column) -> Column:
    """Without white space at either end; null reads as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The base name without its last suffix; a name that begins with its only dot has none."""
    name = base_name(path)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.regexp_extract(base_name(path), r".(\.[^.]*)$", 1)


def shortened(text: Column, size: int) -> Column:
    """The first characters and an ellipsis, always."""
    return F.concat(F.left(text, F.lit(size)), F.lit("..."))


def fenced(content: Column, kind: Column) -> Column:
    """A fenced code block; empty content stays empty."""
    return F.when(F.coalesce(content, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("```"), kind, F.lit("\n"), content, F.lit("\n```")))


def unfenced(text: Column) -> Column:
    """The inside of a ```diff block, or of any block less the four characters before its end; other texts stay, null is empty."""
    first_line = F.instr(text, "\n")
    diff = text.startswith("```diff\n") & text.endswith("\n```")
    block = text.startswith("```") & text.endswith("```") & (first_line > 0)
    inside = lambda begin, drop: F.substring(text, begin, F.greatest(F.length(text) - begin + 1 - drop, F.lit(0)))
    return F.coalesce(F.when(diff, inside(F.lit(9), 4)).when(block, inside(first_line + 1, 4)).otherwise(text), F.lit(""))


def numbered(text: Column) -> Column:
    """Lines with their numbers from 1."""
    return F.array_join(F.transform(lines(text), lambda line, i: F.concat((i + 1).cast("string"), F.lit(": "), line)), "\n")


def decoded(base64: Column) -> Column:
    """UTF-8 text of base64, null if it is none."""
    return F.try_validate_utf8(F.try_to_binary(base64, F.lit("base64")).cast("string"))


def split_once(value: Column, mark: str) -> Column:
    """(head, tail) at the first mark; no mark: a null tail."""
    at = F.instr(value, mark)
    return F.struct(F.when(at > 0, F.substring(value, F.lit(1), at - 1)).otherwise(value).alias("head"), F.when(at > 0, F.substring(value, at + len(mark), F.length(value))).alias("tail"))


def version(label: Column) -> Column:
    """Ordered form of a label such as 12 or 12L: the letter comes between 12 and 13."""
    return F.struct(F.regexp_extract(label, r"^(\d+)", 1).cast("int").alias("major"), F.when(F.upper(label).endswith("L"), 1).otherwise(0).alias("minor"))


def joined_numbers(numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, lambda x: x.cast("string")), ",")


def composite_key(*parts: Column) -> Column:
    """Parts joined by an underscore; null reads nan."""
    return F.concat_ws("_", *(F.coalesce(p.cast("string"), F.lit("nan")) for p in parts))
