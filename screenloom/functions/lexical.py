"""Descriptors read straight from a linear notation, without a parser."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: atom spellings of the notation ------------------------------
ATOM_TOKEN = r"Cl|Br|[BCNOPSFI]|[bcnops]|\*"
AROMATIC_TOKEN = "[bcnops]"
BRACKET = r"\[[^\[\]]*\]"
BRACKET_HYDROGEN = r"\[\d*H[+-]?\d*\]"
BRACKET_AROMATIC = r"\[\d*(?:se|as|[bcnops])"
LONG_CLOSURE = r"%\d{2}"


def heavy_atoms(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(text, BRACKET_HYDROGEN, ""), BRACKET, "*")
    return F.regexp_count(bare, F.lit(ATOM_TOKEN))


def aromatic_atoms(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(text, BRACKET, "*"), "Cl|Br", "*")
    return F.regexp_count(plain, F.lit(AROMATIC_TOKEN)) + F.regexp_count(
        text, F.lit(BRACKET_AROMATIC)
    )


def ring_count(text: Column) -> Column:
    bare = F.regexp_replace(text, BRACKET, "*")
    closures = F.regexp_count(bare, F.lit(LONG_CLOSURE)) + F.regexp_count(
        F.regexp_replace(bare, LONG_CLOSURE, ""), F.lit(r"\d")
    )
    return F.floor(closures / 2).cast("int")


def aromatic_fraction(text: Column) -> Column:
    return F.coalesce(F.try_divide(aromatic_atoms(text), heavy_atoms(text)), F.lit(0.0))
