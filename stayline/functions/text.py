"""Text predicates, ordered classifiers and comparison forms."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from stayline.functions.typing import strip

_ASCII_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def jvm_pattern(pattern: str) -> str:
    r"""Spell ``\b`` out over ASCII word characters.

    The JVM's own ``\b`` treats accented letters as word characters; the rules are
    defined over ASCII ones.  Next to a literal word character one look-around is enough.
    """
    opened = re.sub(r"\\b(?=[A-Za-z0-9_])", lambda m: r"(?<!\w)", pattern)
    closed = re.sub(r"(?<!\\)([A-Za-z0-9_])\\b", lambda m: m.group(1) + r"(?!\w)", opened)
    return closed.replace(r"\b", _ASCII_BOUNDARY)


def lowered(*parts: Column) -> Column:
    """Lower-cased text of the parts joined by one blank, NULL parts as empty text."""
    texts = [F.coalesce(part, F.lit("")) for part in parts]
    return F.lower(texts[0] if len(texts) == 1 else F.concat_ws(" ", *texts))


def alternatives(pattern: str) -> list[str]:
    """Top-level alternatives of a pattern; one group around the whole is taken off."""
    parts, depth, in_class, part, i = [], 0, False, "", 0
    while i < len(pattern):
        token = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        i += len(token)
        if token == "[":
            in_class = True
        elif token == "]":
            in_class = False
        elif not in_class:
            depth += (token == "(") - (token == ")")
            if token == "|" and depth == 0:
                parts.append(part)
                part = ""
                continue
        part += token
    parts.append(part)
    if len(parts) == 1 and re.fullmatch(r"\((?!\?)[^()]*\)", pattern):
        return alternatives(pattern[1:-1])
    return parts


def plain_forms(part: str) -> list[str] | None:
    """The texts that an alternative stands for, if it is plain text with choices such as
    ``(rule out|r/o) infection`` and optional letters; else None."""
    choice = re.search(r"\((?:\?:)?([\w /|-]*)\)(\?)?|([\w /-])\?", part)
    if choice is None:
        return [part] if re.fullmatch(r"[\w /-]+", part) else None
    options = [choice[3]] if choice[3] else choice[1].split("|")
    if choice[3] or choice[2]:
        options.append("")
    forms = [plain_forms(part[: choice.start()] + o + part[choice.end() :]) for o in options]
    return None if None in forms else [f for own in forms for f in own]


def matches(c: Column, pattern: str) -> Column:
    """Unanchored regular-expression search, for names and other short texts (notes and
    documents: ``stayline.operators.phrases``).

    Searching an alternation is the same as searching each alternative.  Plain words
    become substring tests, which cost a fraction of the regex engine's work on long
    texts; an alternative that starts with plain text is tried only where that occurs.
    """
    found = []
    for part in alternatives(pattern):
        if re.fullmatch(r"[\w /-]+", part):
            found.append(c.contains(part))
            continue
        regex = c.rlike(jvm_pattern(part))
        start = re.match(r"(?:\\b)?([\w /-]{3,})(?![?*{|])", part)
        found.append(c.contains(start.group(1)) & regex if start else regex)
    return reduce(lambda a, b: a | b, found)


def first_label(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Label of the first rule ``(label, pattern)`` that is found, else NULL."""
    (label, pattern), *rest = rules
    chosen = F.when(matches(text, pattern), F.lit(label))
    for label, pattern in rest:
        chosen = chosen.when(matches(text, pattern), F.lit(label))
    return chosen


def contains_any(columns: Sequence[Column], needle: str) -> Column:
    """True when one of the (nullable) text columns contains ``needle``, ignoring case."""
    found = F.lit(False)
    for c in columns:
        found = found | lowered(c).contains(needle)
    return found


def included(text: Column, include: str, *exclude: tuple[Column, str]) -> Column:
    """Include pattern on ``text`` and no exclude pattern on its own column."""
    keep = matches(lowered(text), include)
    for column, pattern in exclude:
        keep = keep & ~matches(lowered(column), pattern)
    return keep


def signature(c: Column) -> Column:
    """Comparison form of a label text: case-folded, white space collapsed.

    Folding is upper and then lower case, which also joins sharp s with ss and final sigma
    with sigma.
    """
    folded = F.translate(F.lower(F.upper(c)), "ς", "σ")
    return F.regexp_replace(strip(folded), r"(?U)\s+", " ")


def evidence_lines(c: Column) -> Column:
    """Text with every line trimmed; NULL when blank."""
    lines = F.split(strip(c), "\r\n|\r|\n")
    return F.nullif(F.array_join(F.transform(lines, strip), "\n"), F.lit(""))


def code_root(c: Column) -> Column:
    """Leading root of a dotted code: optional letter and two or three digits."""
    plain = F.upper(F.replace(F.coalesce(c, F.lit("")), F.lit("."), F.lit("")))
    return F.nullif(F.regexp_extract(plain, r"^[A-Z]?[0-9]{2,3}", 0), F.lit(""))


def file_safe(c: Column, fallback: str = "reviewer") -> Column:
    """A key made safe for use in a file or folder name."""
    cleaned = F.regexp_replace(strip(c), r"[^A-Za-z0-9._-]+", "_")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(fallback))
