"""Ordered rules over long texts in one pass.

The plain alternatives of all rules, word boundaries included, are compiled into one
automaton.  A text is read once, however many rule sets ask about it; the labels are then
set operations on the numbers of the alternatives found.  Only an alternative that is more
than plain text (``cef[a-z]+``) costs a regular expression, and only on texts that hold its
plain beginning.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from stayline.functions.text import alternatives, jvm_pattern, plain_forms

#: One plain alternative: text, boundary before it, boundary behind it.
Phrase = tuple[str, bool, bool]
_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


def _phrases(part: str) -> list[Phrase] | None:
    """The plain phrases an alternative stands for, else None."""
    opened, closed = part.startswith(r"\b"), part.endswith(r"\b")
    forms = plain_forms(part[2 * opened : len(part) - 2 * closed])
    if not forms or any(not f or opened and f[0] not in _WORD or closed and f[-1] not in _WORD for f in forms):
        return None
    return [(f, opened, closed) for f in forms]


def _start(part: str) -> Phrase | None:
    """The plain text that an alternative begins with, if it has two letters or more."""
    start = re.match(r"(\\b)?([\w /-]{2,})(?![?*{|])", part)
    return (start[2], False, False) if start else None


def phrase_finder(phrases: Sequence[Phrase]):
    """text -> sorted numbers of the ``phrases`` it holds, in one pass."""
    import ahocorasick

    automaton, numbers = ahocorasick.Automaton(), {}
    for number, (text, *_) in enumerate(phrases):
        numbers.setdefault(text, []).append(number)
    for text, own in numbers.items():
        automaton.add_word(text, own)
    automaton.make_automaton()

    def find(text: str | None) -> list[int] | None:
        if text is None:
            return None
        found: set[int] = set()
        for end, own in automaton.iter(text):
            for number in own:
                phrase, opened, closed = phrases[number]
                start = end + 1 - len(phrase)
                if opened and start and text[start - 1] in _WORD or closed and end + 1 < len(text) and text[end + 1] in _WORD:
                    continue
                found.add(number)
        return sorted(found)

    return find


def with_labels(
    df: DataFrame, text: Column, *, labels: dict[str, Sequence[tuple[str, str]]], flags: dict[str, str] | None = None
) -> DataFrame:
    """``df`` with one column per entry: for ``labels`` the label of the first rule (label,
    pattern) that the text holds, else NULL; for ``flags`` whether it holds the pattern.

    Patterns are searched, not anchored; ``\\b`` stands between ASCII word characters and
    others.  Of a NULL text labels and flags are NULL.  The new columns must not exist yet.
    """
    flags = flags or {}
    if taken := [c for c in (*labels, *flags, "_text", "_found") if c in df.columns]:
        raise ValueError(f"columns exist already: {', '.join(taken)}")
    phrases: dict[Phrase, int] = {}
    plans: dict[str, list[tuple[str | None, list[int], list[tuple[int | None, str]]]]] = {}
    for name, rules in [*labels.items(), *((n, [(None, p)]) for n, p in flags.items())]:
        plans[name] = []
        for label, pattern in rules:
            plain, regexes = [], []
            for part in alternatives(pattern):
                if (own := _phrases(part)) is not None:
                    plain += [phrases.setdefault(p, len(phrases)) for p in own]
                else:
                    start = _start(part)
                    regexes.append((start and phrases.setdefault(start, len(phrases)), part))
            plans[name].append((label, plain, regexes))
    known = list(phrases)

    @F.pandas_udf("array<int>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(phrase_finder(known), na_action="ignore")

    def test(plain: list[int], regexes: list[tuple[int | None, str]]) -> Column:
        tests = [F.arrays_overlap("_found", F.array(*map(F.lit, plain)))] if plain else []
        for start, part in regexes:
            regex = F.col("_text").rlike(jvm_pattern(part))
            tests.append(regex if start is None else F.array_contains("_found", start) & regex)
        return reduce(lambda a, b: a | b, tests)

    def first(rules) -> Column:
        tests = [(F.lit(label), test(plain, regexes)) for label, plain, regexes in rules]
        out = F.when(tests[0][1], tests[0][0])
        for label, held in tests[1:]:
            out = out.when(held, label)
        return out

    read = df.withColumn("_text", text).withColumn("_found", found("_text"))
    columns = {n: first(plans[n]) for n in labels} | {n: test(*plans[n][0][1:]) for n in flags}
    return read.select(*df.columns, *[c.alias(n) for n, c in columns.items()])
