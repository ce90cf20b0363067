"""Key expressions: normalising, validating and hashing entity keys."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Single plain spaces are left alone: they need no replacing.
_BLANKS = "[ \\t\\n\\r\\f\\x0B]{2,}|[\\t\\n\\r\\f\\x0B]"


def flat_text(text: Column) -> Column:
    """Lower case, trimmed, every run of blanks one space."""
    return F.lower(F.trim(F.regexp_replace(text, _BLANKS, " ")))


def text_key(text: Column) -> Column:
    """Case- and spacing-insensitive key of a text; null when nothing is left."""
    return F.when(has_text(text), flat_text(text))


def has_text(text: Column) -> Column:
    """Whether a text holds anything but blanks; stops at the first such character."""
    return F.coalesce(text.rlike("[^ \\t\\n\\r\\f\\x0B]"), F.lit(False))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An expression named inside the lambda of an array function is evaluated for
    every element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def key_digest(key: Column) -> Column:
    """128-bit stand-in for a long key, so that shuffles carry 32 bytes, not the text."""
    return F.md5(key)


# --- Fixed values: the tokens of the linear molecule notation -----------------
NOTATION_TOKEN = (
    r"\[[^\[\]]+\]|Cl|Br|[BCNOPSFI]|[bcnops]|->|<-|[-=#$:/\\.()]|%\d{2}|\d|\*"
)
_BRACKET = r"\[[^\[\]]*\]"
_LONG_CLOSURE = r"%\d{2}"


def _count_of(text: Column, piece: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)


def notation_depth(text: Column) -> Column:
    """Final nesting depth of the parentheses; negative once one closes unopened."""
    steps = F.transform(
        F.split(F.regexp_replace(text, r"[^()]", ""), ""),
        lambda c: F.when(c == "(", 1).when(c == ")", -1).otherwise(0),
    )
    return F.aggregate(steps, F.lit(0), lambda acc, s: F.when(acc < 0, acc).otherwise(acc + s))


def notation_is_valid(text: Column) -> Column:
    """Lexical screen of a linear molecule notation.

    True when the trimmed text consists of known tokens only, holds at least one
    atom, nests its parentheses and closes every ring it opens.  Necessary, not
    sufficient: valences and aromaticity are not checked.
    """
    t = F.trim(text)
    outside = F.regexp_replace(t, _BRACKET, "*")
    short = F.regexp_replace(outside, _LONG_CLOSURE, "")
    long_closures = F.length(outside) - F.length(short)
    even = long_closures % 6 == 0
    for digit in "0123456789":
        even = even & (_count_of(short, digit) % 2 == 0)
    ok = (
        (t != "")
        & (F.regexp_replace(t, NOTATION_TOKEN, "") == "")
        & outside.rlike("[A-Za-z*]")
        & (notation_depth(outside) == 0)
        & even
    )
    return F.coalesce(ok, F.lit(False))


def notation_key(text: Column) -> Column:
    """Trimmed notation when it passes the screen, else null."""
    return F.when(notation_is_valid(text), F.trim(text))


@dataclass(frozen=True)
class KeyRule:
    """A key's validity test and its canonical form (used on valid keys only).

    They are kept apart because a filter on the canonical form would make Spark
    compute that form twice, once to filter and once to show.
    """

    is_valid: Callable[[Column], Column]
    canonical: Callable[[Column], Column]


TEXT = KeyRule(has_text, flat_text)
NOTATION = KeyRule(notation_is_valid, F.trim)


def hex_int(hexes: Column, first: int = 1, digits: int = 8) -> Column:
    """A run of hex digits as a non-negative BIGINT."""
    return F.conv(F.substring(hexes, first, digits), 16, 10).cast("bigint")


def hash_int(text: Column, first: int = 1, digits: int = 8) -> Column:
    """A run of digits of the text's md5 as a non-negative BIGINT."""
    return hex_int(F.md5(text), first, digits)


def hash60(*parts: Column) -> Column:
    """60-bit hash of the parts as a BIGINT: eight bytes to shuffle, not thirty-two."""
    return hash_int(F.concat_ws("|", *[p.cast("string") for p in parts]), 1, 15)


def halves(h: Column) -> list[Column]:
    """Low and high 30 bits of a 60-bit hash; their sums stay exact for 2**33 terms."""
    return [h.bitwiseAND(F.lit(2**30 - 1)), F.shiftright(h, 30)]


def seeded_hash(seed: int, *parts: Column) -> Column:
    """Hex hash that orders rows at random but repeatably for a seed."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))
