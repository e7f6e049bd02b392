"""Keyword patterns and the one translation they need.

The patterns treat only ASCII letters, digits and underscore as word characters; Java's word boundary knows all of
Unicode, so boundaries are spelled out. Case is folded for all scripts.
"""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word lists and patterns below have to equal the specified ones for results to match.

REACTION = (
    r"\b(no way|clutch|wtf|insane|crazy|omg|wow|holy|bro|let'?s go|gg|rip)\b",
    r"\b(auf keinen|krass|wahnsinn|alter|scheiße|omg|wtf|heftig|unglaublich)\b",
    r"\b(jump scare|jumpscare|scared|scream|schrei|lacht|haha|lol)\b",
    r"\b(died|kill|killed|down|eliminated|victory|win|round|boss)\b",
    r"\b(gestorben|kill|eliminiert|sieg|gewonnen|runde|boss)\b",
)
LORE = (
    r"\b(so basically|let me explain|backstory|lore|story time|in this world|years ago)\b",
    r"\b(also basically|lass mich erklären|hintergrund|geschichte|vor jahren|in dieser welt)\b",
    r"\b(the reason is|what happened was|it all started|fun fact|did you know)\b",
    r"\b(der grund ist|es fing an|wusstest du|fun fact|erzähl)\b",
    r"\b(chapter|episode|part \d|kapitel|folge|teil \d)\b",
)
NEGATIVE = (
    r"\b(subscribe|like and subscribe|link in description|patreon|sponsor)\b",
    r"\b(abonnier|abonnieren|link in der beschreibung|sponsor)\b",
    r"\b(welcome back|intro|outro|thanks for watching|see you next)\b",
    r"\b(willkommen|intro|outro|danke fürs zuschauen|bis zum nächsten)\b",
)
SETUP_WORDS = r"\b(warum|why|how|wieso|wait|warte)\b"
KILL_WORDS = r"\b(ace|clutch|1v\d|headshot|frag|double|triple|quad|pick|trade|nade|one tap|last|got him|nice|killed|eliminated)\b"
BORING_WORDS = (
    r"\b(plant|planted|defus|holding|hold the|hold this|save|saving|eco|rotate|default|waiting|wait here|lädt|pflanzt|hält|post plant)\b"
)
PAYOFF_WORDS = r"\b(defus|defuse|defusing|plant|planted|bombe|bomb|clutch)\b"
FILLERS = r"\b(um|uh|like|you know|sort of|kind of|i mean|basically|actually|literally)\b"

_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
_EDGE_ASCII = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"  # the same where case is not folded, several times cheaper
_WORD = re.compile(r"[a-z0-9_]")


def java(pattern: str, fold: bool = True) -> str:
    """The pattern for Spark: ASCII word edges, case folded for all scripts."""
    return ("(?iu)" if fold else "") + pattern.replace(r"\b", _EDGE)


def java_lower(pattern: str) -> str:
    """The pattern for text that is already lower case. Where all alternatives of ``\\b(a|b)\\b`` start and end with
    ASCII word characters, an edge is one plain look-around, which is several times cheaper."""
    found = re.fullmatch(r"\\b\(([^()]*)\)\\b", pattern)
    plain = found and all(_WORD.match(a[0]) and (_WORD.match(a[-1]) or a.endswith(r"\d")) for a in found.group(1).split("|"))
    if plain:
        return rf"(?<!\w)(?:{found.group(1)})(?!\w)"
    return pattern.replace(r"\b", _EDGE_ASCII)


def lead_tokens(patterns) -> list[str]:
    """Word tokens one of which occurs in every text that matches one of ``\\b(a|b)\\b``-shaped patterns.

    The first run of ASCII word characters of an alternative is a whole token of the text, because the character after
    it is either not a word character or the closing edge. An optional apostrophe and a digit class are spelled out.
    """
    out: set[str] = set()
    for pattern in patterns:
        for alt in re.fullmatch(r"\\b\((.*)\)\\b", pattern).group(1).split("|"):
            alt = re.sub(r"^[^a-z0-9_]+", "", alt)
            run = re.match(r"[a-z0-9_]+", alt).group()
            rest = alt[len(run):]
            if rest.startswith(r"\d"):
                out.update(f"{run}{i}" for i in range(10))
            elif rest.startswith("'?"):
                out.update((run, run + re.match(r"[a-z0-9_]*", rest[2:]).group()))
            elif rest.startswith("+") or rest.startswith(".") or rest.startswith("["):
                raise ValueError(f"no fixed lead token in {alt}")
            else:
                out.add(run)
    return sorted(out)


def tokens(lower: Column) -> Column:
    """The distinct ASCII word tokens of lower-case text."""
    return F.array_distinct(F.split(lower, r"\W+"))


def may_hit(token_column: Column, patterns) -> Column:
    """A cheap test that is true wherever one of the patterns matches."""
    return one_of(token_column, lead_tokens(patterns))


def one_of(token_column: Column, words) -> Column:
    """Whether one of the tokens is in the list."""
    return F.exists(token_column, lambda w: w.isin(*sorted(words)))


def has(text: Column, pattern: str, fold: bool = True) -> Column:
    return F.coalesce(text.rlike(java(pattern, fold)), F.lit(False))


def has_lower(lower: Column, pattern: str) -> Column:
    return F.coalesce(lower.rlike(java_lower(pattern)), F.lit(False))


def count_of(text: Column, pattern: str, fold: bool = True) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(java(pattern, fold))), F.lit(0))


def hits(text: Column, patterns) -> Column:
    """How many of the patterns occur."""
    total = F.lit(0)
    for p in patterns:
        total = total + has(text, p).cast("int")
    return total


def hits_lower(lower: Column, patterns) -> Column:
    """How many of the patterns occur in lower-case text."""
    total = F.lit(0)
    for p in patterns:
        total = total + has_lower(lower, p).cast("int")
    return total


def any_lower(lower: Column, patterns) -> Column:
    test = F.lit(False)
    for p in patterns:
        test = test | has_lower(lower, p)
    return test


FILLER_TOKENS = frozenset(re.findall(r"[a-z]+", FILLERS.replace(r"\b", " ")))


def split_words(pattern: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The alternatives of ``\\b(a|b)\\b`` that are single ASCII words, and the others. A text matches a single word exactly
    if the word is one of its tokens; a word that stripping fillers may remove counts among the others."""
    alts = re.fullmatch(r"\\b\((.*)\)\\b", pattern).group(1).split("|")
    words = tuple(a for a in alts if re.fullmatch(r"[a-z0-9_]+", a) and a not in FILLER_TOKENS)
    return words, tuple(a for a in alts if a not in words)


def token_hit(token_column: Column, lower: Column, pattern: str) -> Column:
    """``has_lower`` of a ``\\b(a|b)\\b``-shaped pattern on text with these tokens, fillers stripped or not: single words are looked up
    among the tokens, and an expression of the other alternatives runs only on texts with a token of theirs."""
    words, rest = split_words(pattern)
    test = one_of(token_column, words) if words else F.lit(False)
    if rest:
        other = rf"\b({'|'.join(rest)})\b"
        guard = may_hit(token_column, [other])
        if all(re.fullmatch(r"[a-z0-9_äöüß ]+", a) for a in rest):
            guard = guard & any_of(lower, *rest)
        test = test | F.when(guard, has_lower(lower, other)).otherwise(False)
    return F.coalesce(test, F.lit(False))


def any_of(text: Column, *parts: str) -> Column:
    """Whether one of the plain parts occurs."""
    test = F.contains(text, F.lit(parts[0]))
    for p in parts[1:]:
        test = test | F.contains(text, F.lit(p))
    return test


def token_hits(token_column: Column, lower: Column, patterns) -> Column:
    """How many of the patterns occur in lower-case text with these tokens."""
    total = F.lit(0)
    for p in patterns:
        total = total + token_hit(token_column, lower, p).cast("int")
    return total
