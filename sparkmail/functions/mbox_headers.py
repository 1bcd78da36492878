"""Header section of one mbox record: framing, unfolding, three kept headers.

A record is the text between two separators, as the `lineSep="\\nFrom "` scan
delivers it: the rest of the separator line, the header lines, a blank line
and the body. The body is cut off first, so the work per message depends on
its headers only. Headers are handled as Latin-1 text, where one character is
one byte; values are decoded as UTF-8 at the end.
"""

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from sparkmail.functions.text import trim

# Kept headers and the field each one fills.
KEPT_HEADERS = {"message-id": "message_id", "from": "from_", "return-path": "return_path"}

# Joins a header to its continuation lines; no Latin-1 text contains it.
_FOLD = "\u0100"
_REST = 2**30


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` evaluated once: higher-order functions do not
    share common parts."""
    return F.get(F.transform(F.array(value), body), 0)


def _decode(latin1: Column) -> Column:
    return F.make_valid_utf8(F.encode(latin1, "ISO-8859-1").cast("string"))


def header_section(record: Column) -> Column:
    """The separator line, then one element per header with its folds."""
    head = F.substring_index(F.substring_index(record, "\n\n", 1), "\n\r\n", 1)
    text = F.decode(head.cast("binary"), "ISO-8859-1")
    for blank in (" ", "\t"):
        text = F.replace(text, F.lit("\n" + blank), F.lit(_FOLD + blank))
    return F.split(text, "\n")


def _is_header(header: Column, *names: str) -> Column:
    """Names match without ASCII case and outer ASCII whitespace."""
    return header.rlike(r"(?i)^[\t\n\x0c\r ]*(?:" + "|".join(names) + r")[\t\n\x0c\r ]*:")


def _is_broken(header: Column) -> Column:
    """A line without a name and a colon. Only the last line can be blank,
    when the record ends there."""
    first_line = F.substring_index(header, _FOLD, 1)
    return ~header.isin("", "\r") & (F.instr(first_line, ":") <= 1)


def _unfold(header: Column) -> Column:
    """Value of a header: its trimmed lines joined by spaces."""
    def text(line: Column, i: Column) -> Column:
        value = F.when(i == 0, F.substring(line, F.instr(line, ":") + 1, F.length(line))).otherwise(line)
        return trim(_decode(value))

    lines = F.transform(F.split(header, _FOLD), text)
    return F.array_join(F.filter(lines, lambda part: part != ""), " ")


def _first_value(headers: Column, name: str) -> Column:
    """Of repeated headers the first one with a value wins."""
    values = F.transform(F.filter(headers, lambda h: _is_header(h, name)), _unfold)
    return F.get(F.filter(values, lambda v: v != ""), 0)


def _parse(section: Column) -> Column:
    headers = F.slice(section, 2, _REST)
    # A continuation right after the separator has no header to belong to.
    bad = F.contains(F.get(section, 0), F.lit(_FOLD)) | F.exists(headers, _is_broken)
    kept = F.filter(headers, lambda h: _is_header(h, *KEPT_HEADERS))
    return _bind(kept, lambda k: F.struct(
        bad.alias("bad"), *[_first_value(k, name).alias(field) for name, field in KEPT_HEADERS.items()]
    ))


def parse_headers(record: Column) -> Column:
    """struct(bad, message_id, from_, return_path) of one record.

    `bad` marks a header section with a line that is neither a header nor a
    continuation; such a message is dropped by the importer.
    """
    return _bind(header_section(record), _parse)
