"""Column functions on delimited text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A quoted stretch: escapes are pairs; without a closing quote it runs to the end of the line.
_QUOTED = r'"(?:[^"\\]++|\\.)*+(?:"|\\?\z)'


def stripped(text: str | Column) -> Column:
    """The text without control characters and spaces (up to U+0020) at either end."""
    return F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"\A[\x00-\x20]+|[\x00-\x20]+\z", "")


def csv_fields(line: str | Column) -> Column:
    """The fields of a comma-separated line as an array, stripped.

    Commas inside quotes don't split, and a quote without its partner protects all that follows.
    Inside quotes a backslash escapes a quote or itself and stays before anything else; the quotes
    go. A null or empty line has no fields, one of white space has one empty field.
    """
    line = F.col(line) if isinstance(line, str) else line
    fields = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(rf'(?s),((?:[^",]++|{_QUOTED})*+)'), F.lit(1))

    def plain(part: Column) -> Column:
        closed = part.rlike(r'(?s)\A"(?:[^"\\]++|\\.)*+"\z')
        inner = F.substring(part, F.lit(2), F.length(part) - F.when(closed, 2).otherwise(1))
        return F.when(part.startswith('"'), F.regexp_replace(inner, r'\\(["\\])', "$1")).otherwise(part)

    def field(text: Column) -> Column:
        return stripped(F.array_join(F.transform(F.regexp_extract_all(text, F.lit(rf'(?s)[^"]++|{_QUOTED}'), F.lit(0)), plain), ""))

    return F.when(F.length(line) > 0, F.transform(fields, field)).otherwise(F.array().cast("array<string>"))
