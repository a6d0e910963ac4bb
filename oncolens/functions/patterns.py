"""SIMILAR TO patterns as Spark conditions.

Such a pattern must match the whole text. ``%`` stands for any characters and ``_`` for
one; ``|`` separates alternatives, parentheses group, ``*``, ``+``, ``?`` and ``{m,n}``
repeat what precedes, brackets list characters, and a backslash takes away a character's
meaning. Anything else, a dot too, stands for itself.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column

from oncolens.functions.columns import any_like

MOST_FORMS = 32
REPEAT = re.compile(r"[*+?]|\{\d+(?:,\d*)?\}")
BRACKET = re.compile(r"\[(\^?)(\]?(?:\\.|[^\]\\])*)\]", re.DOTALL)


@dataclass(frozen=True)
class Part:
    """A piece of a pattern as a Java regex and, where it is plain enough, as the LIKE patterns it stands for."""

    regex: str
    forms: tuple[str, ...] | None


def _literal(c: str) -> Part:
    return Part("\\" + c if c in r"\.^$|?*+()[]{}" else c, ("\\" + c if c in "%_\\" else c,))


def _joined(items: list[Part]) -> Part:
    regex = "".join(item.regex for item in items)
    forms = [item.forms for item in items]
    if None in forms:
        return Part(regex, None)
    count = 1
    for f in forms:
        count *= len(f)
    return Part(regex, tuple(map("".join, product(*forms))) if count <= MOST_FORMS else None)


class _Reader:
    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0

    def wrong(self, what: str) -> ValueError:
        return ValueError(f"SIMILAR TO {self.pattern!r}: {what} at {self.at}")

    def item(self) -> Part:
        c = self.pattern[self.at]
        self.at += 1
        if c == "%":
            return Part(".*", ("%",))
        if c == "_":
            return Part(".", ("_",))
        if c == "(":
            inner = self.alternatives()
            if self.pattern[self.at : self.at + 1] != ")":
                raise self.wrong("a parenthesis is not closed")
            self.at += 1
            return Part(f"(?:{inner.regex})", inner.forms)
        if c == "[":
            found = BRACKET.match(self.pattern, self.at - 1)
            if not found or not found[2]:
                raise self.wrong("a bracket is not closed")
            self.at = found.end()
            return Part(f"[{found[1]}{re.sub(r'([&^\[\]])', r'\\\1', re.sub(r'\\(.)', r'\1', found[2]))}]", None)
        if c == "\\":
            if self.at == len(self.pattern):
                raise self.wrong("a backslash ends the pattern")
            self.at += 1
            return _literal(self.pattern[self.at - 1])
        if c in "*+?{":
            raise self.wrong("nothing to repeat")
        return _literal(c)

    def alternatives(self) -> Part:
        branches: list[list[Part]] = [[]]
        while self.at < len(self.pattern) and self.pattern[self.at] != ")":
            if self.pattern[self.at] == "|":
                self.at += 1
                branches.append([])
                continue
            part = self.item()
            if repeat := REPEAT.match(self.pattern, self.at):
                self.at = repeat.end()
                part = Part(f"(?:{part.regex}){repeat[0]}", None)
            branches[-1].append(part)
        found = [_joined(items) for items in branches]
        forms = [f.forms for f in found]
        plain = None not in forms and sum(map(len, forms)) <= MOST_FORMS
        return Part("|".join(f.regex for f in found), tuple(f for fs in forms for f in fs) if plain else None)

    def whole(self) -> Part:
        part = self.alternatives()
        if self.at < len(self.pattern):
            raise self.wrong("a parenthesis too many")
        return part


def similar_regex(pattern: str) -> str:
    """The pattern as a Java regex that must find the whole text."""
    return rf"(?s)\A(?:{_Reader(pattern).whole().regex})\z"


def similar_to(text: Column, pattern: str) -> Column:
    """``text SIMILAR TO pattern``; null stays null.

    Alternatives of ``%`` and ``_`` alone become LIKE patterns, which Spark turns into
    tests of beginnings, ends and contents; the rest becomes one regular expression.
    """
    part = _Reader(pattern).whole()
    return any_like(text, part.forms) if part.forms else text.rlike(similar_regex(pattern))
