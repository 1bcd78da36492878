"""Who sent a message and which message it is."""

from pyspark.sql import Column, functions as F

from sparkmail.functions.text import trim

# An address is a local part of word characters, dots and dashes, then labels
# that each end in a dot, then a last label of two to four characters. (?Ud)
# gives Unicode word characters and newline-only line ends, \z is end of text.
# Labels repeat possessively: the JVM recurses into a plain repeated group, and
# a header of some thousand labels would overflow the stack of the executor.
_LOCAL, _LABELS = r"[\w\-.]+", r"(?:[\w-]++\.)++"
# Somewhere after the first label comes one of two or more characters.
_HAS_LAST_LABEL = r"(?=[\w-]++(?:\.[\w-](?![\w-]))*+\.[\w-]{2})"
_WITH_BRACKET = rf"(?Ud)^[^<]*<?({_LOCAL}@{_HAS_LAST_LABEL}{_LABELS}[\w-]*+).*\z"
_UP_TO_LAST_LABEL = rf"(?Ud)^({_LOCAL}@[\w.-]*\.[\w-]{{2,4}})"
_BARE = rf"(?Ud)^({_LOCAL}@{_LABELS}[\w-]{{2,4}})\z"

# Fixed value: ledger keys of imported messages live in their own namespace.
MID_PREFIX = "mid:"


def header_value(headers: Column, name: str) -> Column:
    """First non-null value of the header `name`, matched without case.

    A null value is passed over; an empty one is taken.
    """
    hits = F.filter(
        headers, lambda h: (F.lower(h["name"]) == name.lower()) & h["value"].isNotNull()
    )
    return F.get(hits, 0)["value"]


def pick_sender(from_: Column, return_path: Column) -> Column:
    return F.coalesce(from_, return_path, F.lit(""))


def clean_sender(sender: Column) -> Column:
    """The address inside a sender header, or the header as it is.

    Case is kept, a last domain label longer than four letters is cut to four
    inside brackets, and text that does not parse passes through.
    """
    bracketed = F.regexp_extract(F.regexp_extract(sender, _WITH_BRACKET, 1), _UP_TO_LAST_LABEL, 1)
    bare = F.regexp_extract(sender, _BARE, 1)
    address = (
        F.when(~F.contains(sender, F.lit("@")), F.lit(""))
        .when(F.contains(sender, F.lit("<")), bracketed)
        .otherwise(bare)
    )
    return F.coalesce(F.nullif(address, F.lit("")), sender)


def normalize_message_id(raw: Column) -> Column:
    """Message-ID without outer whitespace and one pair of angle brackets."""
    trimmed = trim(raw)
    paired = F.startswith(trimmed, F.lit("<")) & F.endswith(trimmed, F.lit(">"))
    inner = F.when(paired, F.substring(trimmed, F.lit(2), F.length(trimmed) - 2)).otherwise(trimmed)
    return F.nullif(trim(inner), F.lit(""))


def mid_key(message_id: Column) -> Column:
    """Ledger key of an imported message: the raw id, not the normalized one."""
    return F.concat(F.lit(MID_PREFIX), message_id)


def is_mid_key(mail_id: Column) -> Column:
    return mail_id.ilike("mid:%")


def embedded_message_id(mail_id: Column, rfc_message_id: Column) -> Column:
    """Fill the id of import rows from their key; '' when it holds none."""
    embedded = normalize_message_id(F.substring(mail_id, F.lit(len(MID_PREFIX) + 1), F.length(mail_id)))
    return F.when(
        is_mid_key(mail_id) & rfc_message_id.isNull(), F.coalesce(embedded, F.lit(""))
    ).otherwise(rfc_message_id)
