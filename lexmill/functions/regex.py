"""A small regular-expression language (F29, F30): letters, digits, ``|`` and ``*``.

Precedence is the usual one: ``*`` binds its character, characters follow each other, ``|`` separates alternatives.
The whole word must match. Anything else is refused, so a pattern means the same here and in ``rlike``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column


@dataclass(frozen=True)
class Symbol:
    char: str


@dataclass(frozen=True)
class Iter:
    of: Symbol


@dataclass(frozen=True)
class Concat:
    parts: tuple[Symbol | Iter, ...]


@dataclass(frozen=True)
class Or:
    parts: tuple[Concat, ...]


def parse(pattern: str) -> Or:
    """Syntax tree; ``ValueError`` for an empty alternative, a leading or doubled ``*`` and other characters."""
    alternatives: list[Concat] = []
    for part in pattern.split("|"):
        out: list[Symbol | Iter] = []
        for char in part:
            if char == "*":
                if not out or isinstance(out[-1], Iter):
                    raise ValueError(f"nothing to repeat in {pattern!r}")
                out[-1] = Iter(out[-1])
            elif char.isascii() and char.isalnum():
                out.append(Symbol(char))
            else:
                raise ValueError(f"{char!r} is not part of the language")
        if not out:
            raise ValueError(f"empty alternative in {pattern!r}")
        alternatives.append(Concat(tuple(out)))
    return Or(tuple(alternatives))


def to_java(tree: Or) -> str:
    def one(x: Symbol | Iter) -> str:
        return x.char if isinstance(x, Symbol) else x.of.char + "*"

    return "^(?:" + "|".join("".join(map(one, c.parts)) for c in tree.parts) + ")$"


def matches(word: Column, pattern: str) -> Column:
    return word.rlike(to_java(parse(pattern)))
