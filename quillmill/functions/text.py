"""Text functions, all native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode spaces that count as a plain space when a text is tidied.
UNICODE_SPACES = (
    "\u0085  ᠎               　"
)
CONTROL_SPACES = "\x00\x08\t\n\x0b\x0c\r"
#: Characters that end a sentence, and those that only separate tokens.
SENTENCE_END = "[.:;!?]"
TOKEN_GAP = "[ ,/\\\\|&\\x07\\x08\\t\\n\\x0B\\f\\r\\x00]+"


def tidy(text: Column) -> Column:
    """One space for any run of white space, none before . , : ; ) or after (, none at the ends."""
    t = F.translate(text, "﻿", "")
    t = F.translate(t, UNICODE_SPACES + CONTROL_SPACES, " " * (len(UNICODE_SPACES) + len(CONTROL_SPACES)))
    t = F.regexp_replace(t, " +", " ")
    t = F.regexp_replace(t, r" ([.,:;)])", "$1")
    t = F.regexp_replace(t, r"\( ", "(")
    return F.trim(t)


def encode_percentage(text: Column) -> Column:
    """Escapes percent signs that don't begin an escape."""
    return F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")


def join_values(values: Column, delimiter: str = "\n", ignore_empty: bool = True) -> Column:
    """Joins an array of texts; empty ones are left out if asked for."""
    kept = F.filter(values, lambda v: v != "") if ignore_empty else values
    return F.array_join(kept, delimiter)


def first_or_escape(option: str) -> str:
    """The delimiter that an option names: its first character, or a backslash escape."""
    if not option:
        return ""
    escapes = {"n": "\n", "t": "\t", "\\": "\\"}
    return escapes.get(option[1], "") if option[0] == "\\" and len(option) > 1 else option[0]


def to_bool(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("true", "yes", "on", "1")


def is_decimal(text: Column) -> Column:
    return text.rlike(r"^[0-9]+$")


def is_hex(text: Column) -> Column:
    return text.rlike(r"^[0-9A-Fa-f]+$")


def trim_space(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def replace_all(text: Column, what: str, by: str) -> Column:
    return text if what == "" else F.replace(text, F.lit(what), F.lit(by))


def split_text(text: Column, delimiter: str) -> Column:
    """Pieces between literal delimiters; the empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(text, "\\Q" + delimiter + "\\E") if delimiter else F.array(text)
    )


def text_hash(text: Column, case_sensitive: bool = True) -> Column:
    return F.crc32(text if case_sensitive else F.lower(text))


def utf8_length(text: Column) -> Column:
    return F.char_length(text)


def is_valid_utf8(data: Column) -> Column:
    return F.is_valid_utf8(data)


def repair_utf8(data: Column) -> Column:
    return F.make_valid_utf8(data)


def latin1_to_utf8(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def sentences(text: Column) -> Column:
    """The sentences of a text as arrays of tokens; neither is ever empty.

    No lower-casing and no stripping: tokens are what stands between gaps.
    """
    each = F.transform(
        F.split(text, SENTENCE_END), lambda s: F.filter(F.split(s, TOKEN_GAP), lambda t: t != "")
    )
    return F.filter(each, lambda s: F.size(s) > 0)


def placed_tokens(sents: Column) -> Column:
    """Tokens of sentences as structs (sent_ix, token), in order."""
    return F.flatten(
        F.transform(sents, lambda s, i: F.transform(s, lambda t: F.struct(i.alias("sent_ix"), t.alias("token"))))
    )


def matches(pattern: str) -> Callable[[Column], Column]:
    """Whether a token holds a pattern, for use with array functions."""
    return lambda t: t.rlike(pattern)
