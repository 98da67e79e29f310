"""Text: tokenizers by ASCII white space, and regular patterns without captures or backtracking semantics.

A pattern whose repetitions are of single characters, one after another at most once, is matched by Spark's own expression. Java tries other repetitions by
recursion, whose depth follows the text, so those go to an automaton in Arrow batches: linear in the text's length, whatever the pattern.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tessera.functions.equality import fold


def tokenize(c: Column, lower: bool = False) -> Column:
    """Words between ASCII white space (tab, line feed, form feed, carriage return, space)."""
    return F.filter(F.split(fold(c) if lower else c, r"[ \t\n\f\r]+"), lambda x: x != "")


@dataclass(frozen=True)
class Pattern:
    """A regular language over Unicode characters; a text matches if all of it is in the language."""

    kind: str
    parts: tuple = ()

    def __add__(self, other: Pattern) -> Pattern:
        return Pattern("concat", (self, other))

    def __or__(self, other: Pattern) -> Pattern:
        return Pattern("either", (self, other))

    def many(self) -> Pattern:
        return Pattern("many", (self,))

    def regex(self) -> str:
        match self.kind:
            case "never":
                return r"[^\x{0}-\x{10FFFF}]"
            case "empty":
                return r"(?:)"
            case "literal":
                return "".join(f"\\x{{{ord(ch):x}}}" for ch in self.parts[0])
            case "any":
                return r"(?s:.)"
            case "concat":
                return "".join(f"(?:{p.regex()})" for p in self.parts)
            case "either":
                return "|".join(f"(?:{p.regex()})" for p in self.parts)
        return f"(?:{self.parts[0].regex()})*"


    def repetitions(self) -> int:
        return (self.kind == "many") + sum(p.repetitions() for p in self.parts if isinstance(p, Pattern))

    def flat(self) -> bool:
        """Whether every repetition is of one character."""
        if self.kind == "many":
            inner = self.parts[0]
            return inner.kind == "any" or inner.kind == "literal" and len(inner.parts[0]) == 1
        return all(p.flat() for p in self.parts if isinstance(p, Pattern))


NEVER, EMPTY, ANY = Pattern("never"), Pattern("empty"), Pattern("any")


def literal_text(s: str) -> Pattern:
    return Pattern("literal", (s,)) if s else EMPTY


def matches(c: Column, p: Pattern) -> Column:
    """Whether all of the text is in the language; null for a null."""
    whole = f"\\A(?:{p.regex()})\\z"  # \z, not $, which would let a final line feed pass
    if p.flat() and p.repetitions() <= 1:
        return c.rlike(whole)

    @F.arrow_udf(BooleanType())
    def accepted(texts: pa.Array) -> pa.Array:
        return pc.match_substring_regex(texts, whole)

    return accepted(c)
