"""Text rules on transcript lines."""
from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.numeric import half_up, nz
from tideline.functions.patterns import (
    BORING_WORDS, FILLERS, KILL_WORDS, LORE, NEGATIVE, REACTION, SETUP_WORDS, any_of, has_lower, hits_lower, java, java_lower, lead_tokens, may_hit, one_of, split_words, token_hit, token_hits, tokens)
from tideline.functions.profiles import PROFILES

SPACES = "\t\n\x0b\x0c\r\u00a0\ufeff\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CAPS = r"\b[A-ZÄÖÜ]{2,}\b"


def _squeeze_all(text: Column) -> Column:
    """``squeeze`` of an expression: it stands here once."""
    return F.trim(F.regexp_replace(F.translate(text, SPACES, " " * len(SPACES)), " {2,}", " "))


def squeeze(text: Column) -> Column:
    """Collapse white space and trim a column. Most texts have single blanks only and none of the ranges that hold other white space; in the rest
    characters are mapped first, which is far cheaper than replacing a wide character class."""
    wide = (F.octet_length(text) != F.length(text)) & (F.contains(text, F.lit("\u00a0")) | text.rlike("[\u1680-\uffff]"))
    return F.when(F.contains(text, F.lit("  ")) | text.rlike("[\t-\r]") | wide, _squeeze_all(text)).otherwise(F.trim(text))


#: Characters outside ASCII that equal an ASCII letter when case is folded for all scripts.
FOLDED = ("\u0130", "\u0131", "\u017f", "\u212a")


def _drop_fillers(text: Column) -> Column:
    """Without the folded characters, folding ASCII case and plain look-arounds match the same and are many times cheaper."""
    return F.when(any_of(text, *FOLDED), F.regexp_replace(text, java(FILLERS), "")).otherwise(F.regexp_replace(text, "(?i)" + java_lower(FILLERS), ""))


def strip_fillers(text: Column) -> Column:
    return _squeeze_all(_drop_fillers(text))


def words_of(text: Column) -> Column:
    return F.filter(F.split(squeeze(text), " "), lambda w: w != "")


def count_squeezed(clean: Column) -> Column:
    """Number of words of an already squeezed column, without building an array."""
    return F.when(clean == "", 0).otherwise(F.length(clean) - F.length(F.replace(clean, F.lit(" "), F.lit(""))) + 1)


def word_count(text: Column) -> Column:
    return count_squeezed(squeeze(text))


def profile_value(category: Column | None, field: str) -> Column:
    """A number of the line's category profile, as a constant lookup."""
    default = F.lit(float(PROFILES["generic"][field]))
    if category is None:
        return default
    out = default
    for name, profile in PROFILES.items():
        if name != "generic":
            out = F.when(category == name, float(profile[field])).otherwise(out)
    return out


def _may_fill(tok: Column, squeezed: Column) -> Column:
    """Whether stripping fillers may change a squeezed text with these tokens."""
    words, rest = [], []
    for alt in FILLERS[3:-3].split("|"):
        (rest if " " in alt else words).append(alt)
    phrase = may_hit(tok, [rf"\b({'|'.join(rest)})\b"]) & F.lower(squeezed).rlike("|".join([*rest, "[ſı]"]))
    return one_of(tok, words) | phrase


# Reactions that make an opening scene.
TEASER = (
    r"\b(oh my god|no way|what the|holy shit|holy|bro|wtf|omg|insane|crazy)\b",
    r"\b(oh mein gott|auf keinen|krass|wahnsinn|alter|scheiße|wtf|omg)\b",
    r"\b(laugh|lacht|haha|lol|hilarious)\b",
)
#: Patterns that rules on measured lines may ask for, and the tokens these ask for.
LINE_PATTERNS = (*REACTION, *LORE, *NEGATIVE, SETUP_WORDS, KILL_WORDS, BORING_WORDS, FILLERS, *TEASER,
                 *[p for profile in PROFILES.values() for p in profile["keywords"] + profile["lore"] if p.startswith(r"\b(")])
VOCABULARY = frozenset(lead_tokens(LINE_PATTERNS)) | {w for p in LINE_PATTERNS for w in split_words(p)[0]}


CAPS_JAVA = r"(?:(?<![A-Za-z0-9_])(?=[A-Z])|(?<=[A-Za-z0-9_])(?=[ÄÖÜ]))[A-ZÄÖÜ]{2,}(?:(?<=[A-Z])(?![A-Za-z0-9_])|(?<=[ÄÖÜ])(?=[A-Za-z0-9_]))"


def measure_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the helper columns the line rules read, in layers so that each is computed once per line:
    ``clean`` (filler-free text), ``low``/``raw_low`` (lower case), ``tok`` (tokens that some rule asks for), word counts and marks."""
    src = F.col(text)
    rows = df.withColumns({"raw_low": F.lower(src), "_sq": squeeze(src)})
    rows = rows.withColumns({"tok": F.filter(tokens(F.col("raw_low")), lambda w: w.isin(*sorted(VOCABULARY))), "words": count_squeezed(F.col("_sq"))})
    rows = rows.withColumn("clean", F.when(_may_fill(F.col("tok"), F.col("_sq")), _squeeze_all(_drop_fillers(F.col("_sq")))).otherwise(F.col("_sq")))
    rows = rows.withColumn("low", F.lower("clean"))
    upper = F.when((F.col("clean") != F.col("low")) & F.col("clean").rlike("[A-ZÄÖÜ]{2}"), F.regexp_count("clean", F.lit(CAPS_JAVA))).otherwise(0)
    return rows.withColumns({"n": count_squeezed(F.col("clean")), "caps": upper, "ask": F.contains("clean", F.lit("?")), "cry": F.contains("clean", F.lit("!"))}).drop("_sq")


HELPERS = ("raw_low", "tok", "low", "n", "caps", "ask", "cry")


def line_score(gap: Column, duration: Column, category: Column | None = None) -> Column:
    """Score of a measured line: short emphatic reactions win, monologues and adverts lose."""
    return score_with_pause(line_words(category), line_pace(duration), gap)


def line_words(category: Column | None = None) -> Column:
    """What the words of a measured line are worth, null for a line without any."""
    n, caps, ask, cry, low, tok = (F.col(c) for c in ("n", "caps", "ask", "cry", "low", "tok"))
    emphatic = ask | cry | (caps > 0)
    size = (F.when(n <= 4, F.when(emphatic, 12).otherwise(5)).when(n <= 8, F.when(emphatic, 9).otherwise(4)).when(n <= 14, 2)
            .when(n >= 32, -22).when(n >= 24, -14).when(n >= 18, -6).otherwise(0)).cast("double")
    marks = (F.when(ask, 7).otherwise(0) + F.when(cry, 8).otherwise(0) + F.when(ask & (n <= 12), 5).otherwise(0)
             + F.when(cry & (n <= 10), 6).otherwise(0) + F.when(any_of(F.col("clean"), "...", "—", "–", "…"), 2).otherwise(0))
    bonus, penalty = profile_value(category, "keyword_bonus"), profile_value(category, "lore_penalty")
    keywords = token_hits(tok, low, REACTION) * bonus - token_hits(tok, low, LORE) * penalty - token_hits(tok, low, NEGATIVE) * 28.0
    own = F.lit(0.0)
    if category is not None:
        for name, profile in PROFILES.items():
            plain = tuple(p for p in profile["keywords"] + profile["lore"] if p.startswith(r"\b("))
            marks_only = tuple(p for p in profile["keywords"] if p not in plain)
            if plain:
                value = (token_hits(tok, low, tuple(p for p in profile["keywords"] if p in plain)) * float(profile["keyword_bonus"] + 2)
                         - token_hits(tok, low, profile["lore"]) * float(int(profile["lore_penalty"] * 0.85 + 0.5)))
                value = value + hits_lower(low, marks_only) * float(profile["keyword_bonus"] + 2)
                own = F.when(category == name, value).otherwise(own)
    return F.when(F.col("clean") != "", size + marks + F.least(caps * 2, F.lit(8)) + keywords + own)


def line_pace(duration: Column) -> Column:
    """What the speaking rate of a measured line is worth."""
    n = F.col("n")
    rate = F.when(duration > 0, n / duration)
    return F.when(nz(rate >= 3.2, False) & (n <= 16), 6.0).otherwise(0.0) - F.when(nz(rate <= 1.4, False) & (n >= 20), 8.0).otherwise(0.0)


def score_with_pause(words: Column, pace: Column, gap: Column) -> Column:
    """Score of a line from :func:`line_words`, :func:`line_pace` and the pause before it."""
    pause = F.when(gap >= 0.8, F.least(gap * 2.5, F.lit(8.0))).otherwise(0.0)
    return F.coalesce(words + pause + pace, F.lit(-5.0))


def talk(pattern: str) -> Column:
    """Whether the raw text of a measured line contains the words of one of ``LINE_PATTERNS``."""
    if pattern not in LINE_PATTERNS:
        raise ValueError(f"not measured: {pattern}")
    return token_hit(F.col("tok"), F.col("raw_low"), pattern)


def _any(patterns) -> Column:
    test = F.lit(False)
    for p in patterns:
        test = test | talk(p)
    return test


def shooter_line_score(category: Column | None = None) -> Column:
    return F.when(talk(KILL_WORDS), line_score(F.lit(0.0), F.lit(1.0), category) + 12).otherwise(0.0)


def line_flags(text: str = "text") -> dict[str, Column]:
    """Flags of a measured line that window scores count."""
    src = F.col(text)
    mark = any_of(src, "?", "!")
    return {
        "mark": mark, "reaction": mark | _any(REACTION), "monologue": (F.col("words") >= 22) | _any(LORE), "setup": F.contains(src, F.lit("?")) | talk(SETUP_WORDS),
        "negative": token_hits(F.col("tok"), F.col("raw_low"), NEGATIVE),
        "kill_talk": talk(KILL_WORDS), "boring_talk": talk(BORING_WORDS)}


# Tease vocabulary for opening scenes.
TEASE = (
    r"\b(wait until|but then|what happens|you won't believe|and then)\b",
    r"\b(warte bis|und dann|was passiert|glaub mir|stell dir vor)\b",
    r"\b(secret|truth|reveal|geheim|wahrheit|enthüll)\b",
)
DANGLING = r"(?:^|\s)(sonst|und|oder|aber|weil|dass|wenn|ich|er|sie|es|dem|den|der|can|will|würde|muss|kann|bin|ist|have|can|will|would)\s*$"
OPENERS = r"^(was|wie|warum|wieso|what|how|why|wait|warte)\b"


def once(value: Column, body) -> Column:
    """``body`` over a value that is evaluated once, however often the body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _seen(clean: Column) -> Column:
    return once(clean, lambda c: F.struct(c.alias("c"), F.lower(c).alias("l"), count_squeezed(c).alias("n")))


def _teaser_words(base: Column, n: Column, hits: Column, cry: Column) -> Column:
    return base + (F.when(n.between(4, 16), 5).otherwise(0) - F.when(n <= 2, 4).otherwise(0) + hits * 9 + F.when(cry, 4).otherwise(0))


def measured_teaser_words(base: Column) -> Column:
    """What the words of a measured line are worth as opening scene, wherever in the clip it is; ``base`` is its line score."""
    return _teaser_words(base, F.col("n"), token_hits(F.col("tok"), F.col("low"), TEASER), F.col("cry"))


def teaser_place(ratio: Column) -> Column:
    """What a place in the clip is worth for an opening scene."""
    return (F.when((ratio >= 0.45) & (ratio <= 0.88), 6).when((ratio >= 0.35) & (ratio < 0.45), 1).otherwise(0)
            - F.when(ratio < 0.35, 18).otherwise(0) - F.when(ratio < 0.12, 8).otherwise(0) - F.when(ratio > 0.95, 5).otherwise(0))


def teaser_score(clean: Column, base: Column, ratio: Column) -> Column:
    """Value of a line as opening scene; ``base`` is its line score and ``ratio`` its place in the clip."""
    words = once(F.struct(base.alias("b"), _seen(clean).alias("v")), lambda x: _teaser_words(x["b"], x["v"]["n"], hits_lower(x["v"]["l"], TEASER), x["v"]["c"].contains("!")))
    return words + teaser_place(ratio)


def _valid(v: Column) -> Column:
    marked = v["c"].rlike(r"[?!…]\s*$")
    return (
        F.when((F.length(v["c"]) < 10) | (v["n"] < 4) | (v["n"] > 18), False)
        .when(has_lower(v["l"], DANGLING), False)
        .when(v["c"].rlike(r"[,;:]\s*$") & ~marked, False)
        .otherwise(marked | ((v["n"] >= 7) & v["c"].rlike(r"\.\s*$")) | (has_lower(v["l"], OPENERS) & (v["n"] >= 5)))
    )


def valid_cliffhanger(clean: Column) -> Column:
    """Whether the filler-free text reads as a complete tease."""
    return once(_seen(clean), _valid)


def cliffhanger_score(clean: Column, base: Column, ratio: Column, teaser_at: Column, at: Column) -> Column:
    lead = teaser_at - at
    place = (F.when((lead >= 2) & (lead <= 25), 8).otherwise(0) - F.when(at > teaser_at + 1, 12).otherwise(0) + F.when(ratio < 0.7, 5).otherwise(0) - F.when(ratio > 0.85, 6).otherwise(0))

    def words(v: Column) -> Column:
        return F.when(_valid(v), (
            F.when(v["c"].rlike(r"\?\s*$"), 14.0).otherwise(0.0) + F.when(v["c"].rlike(r"\.\.\.|…"), 9).otherwise(0) + F.when(v["c"].endswith("!") & (v["n"] <= 10), 3).otherwise(0)
            + hits_lower(v["l"], TEASE) * 11 + F.when(v["n"].between(5, 12), 6).otherwise(0) - F.when(v["n"] > 16, 10).otherwise(0)))

    return F.coalesce(once(_seen(clean), words) + base * 0.55 + place, F.lit(-999.0))


def format_cliffhanger(clean: Column, most: int = 72) -> Column:
    """The tease with closing mark, cut at a word; empty when the result is not a complete tease."""
    def shorten(marked: Column) -> Column:
        def close(short: Column) -> Column:
            return F.when(short.rlike(r"[?!…]$"), short).otherwise(F.concat(short, F.lit("…")))

        def cut_at(cut: Column) -> Column:
            space = F.length(cut) - F.instr(F.reverse(cut), " ")
            return F.trim(F.when(F.contains(cut, F.lit(" ")) & (space > 24), F.substring(cut, F.lit(1), space)).otherwise(cut))

        return F.when(F.length(marked) <= most, marked).otherwise(once(once(F.substring(marked, 1, most), cut_at), close))

    def checked(v: Column) -> Column:
        return F.when((v["c"] != "") & valid_cliffhanger(strip_fillers(v["o"])), v["o"]).otherwise("")

    def marked(c: Column) -> Column:
        return F.struct(c.alias("c"), once(F.when(c.rlike(r"[?!….]$"), c).otherwise(F.concat(c, F.lit("…"))), shorten).alias("o"))

    return once(once(clean, marked), checked)


#: Everything but word characters, listed one by one: Java then looks a character up in one table.
_NO_WORD = f"[^{string.ascii_letters}{string.digits}_äöüßÄÖÜ]+"


def long_words(text: Column) -> Column:
    """The lower-case words of more than three characters, repeats included."""
    return F.filter(F.split(F.lower(text), _NO_WORD), lambda w: F.length(w) > 3)


def words_shared(a: Column, b: Column) -> Column:
    """Share of the words of ``b`` that occur in ``a``, two arrays. Sets are met by hash; only words that ``b`` repeats are counted one by one."""
    def share(v: Column) -> Column:
        again = once(F.sort_array(v["b"]), lambda s: F.filter(s, lambda w, i: (i > 0) & (F.get(s, i - 1) == w)))
        more = once(again, lambda x: F.when(F.size(x) == 0, 0).otherwise(_among(x, v["s"])))
        return F.when((v["n"] == 0) | (F.size(v["b"]) == 0), 0.0).when(F.size(v["s"]) == 0, 0.0).otherwise((F.size(v["s"]) + more) / F.greatest(F.size(v["b"]), F.lit(1)))

    return once(F.struct(F.size(a).alias("n"), b.alias("b"), F.array_intersect(b, a).alias("s")), share)


def _among(words: Column, known: Column) -> Column:
    """How many of the words, repeats included, are among ``known``."""
    return once(F.array_intersect(words, known), lambda both: F.size(F.filter(words, lambda w: F.array_contains(both, w))))


def word_overlap(a: Column, b: Column) -> Column:
    """Share of the words of ``b`` (longer than three characters) that occur in ``a``."""
    return once(F.struct(long_words(a).alias("a"), long_words(b).alias("b")), lambda v: words_shared(v["a"], v["b"]))


def teaser_seconds(clean: Column) -> Column:
    n = count_squeezed(clean)
    return F.when(n <= 5, 1.5).when(n <= 10, 2.2).otherwise(2.8)


def scale_boost(points: Column, category: Column | None) -> Column:
    return half_up(points * profile_value(category, "audio_weight"))
