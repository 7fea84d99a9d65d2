"""Texts that ask for a repair, built from columns by templates, which a caller gives in its own words.

A template names fields in braces; doubled braces stand for themselves. A null field reads as empty.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import status, text

FIRST = "Repair the rejected hunks of {file}.\n\nFile, with line numbers:\n{source}\n\nRejected hunks:\n{rejects}\n\nWhole patch:\n{patch}\n"
AGAIN = "{first}\nAttempt {number} was:\n{diff}\n\n{advice}\n"
ADVICE = {"format": "It is no unified diff: {format_error}", "hunks": "Its hunks do not fit: {apply_error}", "apply": "It does not apply: {apply_error}", "none": "It was not accepted."}


def filled(template: str, fields: dict[str, Column]) -> Column:
    """A template with its fields; one that is not given is an error."""
    parts: list[Column] = []
    for literal, field, _, _ in Formatter().parse(template):
        parts += [F.lit(literal)] if literal else []
        parts += [F.coalesce(fields[field].cast("string"), F.lit(""))] if field is not None else []
    return F.concat(F.lit(""), *parts)


def first(file: Column, source: Column, rejects: Column, patch: Column, template: str = FIRST) -> Column:
    """What a first attempt is asked: its file's lines carry their numbers."""
    return filled(template, {"file": file, "source": text.numbered(F.coalesce(source, F.lit(""))), "rejects": rejects, "patch": patch})


def again(asked: Column, number: Column, diff: Column, format_error: Column, apply_error: Column, template: str = AGAIN, advice: dict[str, str] = ADVICE) -> Column:
    """What the attempt after a failed one is asked: the same, what was tried, and advice on each of its errors."""
    errors = {"format_error": format_error, "apply_error": apply_error}
    given = F.transform(status.feedback(format_error, apply_error), lambda kind: F.coalesce(*(F.when(kind == k, filled(v, errors)) for k, v in advice.items())))
    return filled(template, {"first": asked, "number": number, "diff": diff, "advice": F.array_join(given, "\n")})
