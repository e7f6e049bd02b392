"""Content category from titles, tags and spoken text."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.numeric import nz
from tideline.functions.patterns import BORING_WORDS, KILL_WORDS, any_of, has, java_lower, one_of
from tideline.functions.profiles import GAMING_WORDS, PROFILES, SHOOTER_GAMES, SOURCE_WEIGHTS, SPOKEN_MATCHERS, TITLE_MATCHERS
from tideline.operators.ordered import ordered, top_per_key, windowed

KEY = ["video_id"]
MATCH_CAP, KEYWORD_CAP, KEYWORD_LEAST, KEYWORD_POINTS = 3, 4, 3, 2.5
# Share of the transcript weight that title matchers and category keywords get.
TITLE_ON_SPEECH, KEYWORDS_ON_SPEECH = 0.55, 0.4
# No pattern spans more words than this, whatever lies between them, so a line and as many words behind it hold every match.
JUNCTION = 8
SOURCES = ("title", "description", "tags", "channel", "transcript", "visual")

RULES: list[dict] = []
for _i, (_cat, _game, _weight, _patterns) in enumerate(TITLE_MATCHERS):
    RULES += [{"set": "title", "pos": _i, "category": _cat, "game": _game, "weight": float(_weight), "pattern": p} for p in _patterns]
for _i, (_cat, _game, _weight, _patterns) in enumerate(SPOKEN_MATCHERS):
    RULES += [{"set": "spoken", "pos": 100 + _i, "category": _cat, "game": _game, "weight": float(_weight), "pattern": p} for p in _patterns]
for _i, (_cat, _profile) in enumerate(PROFILES.items()):
    RULES += [{"set": "keywords", "pos": 200 + _i, "category": _cat, "game": None, "weight": 1.0, "pattern": p} for p in _profile["keywords"]]


def _single_words(rule: dict) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The rule's alternatives that are single ASCII words, whose matches are equal tokens, and the others."""
    word = re.fullmatch(r"\\b([a-z0-9_]+)\\b", rule["pattern"])
    if word:
        return (word.group(1),), ()
    group = re.fullmatch(r"\\b\((.*)\)\\b", rule["pattern"])
    alts = (group.group(1) if group else rule["pattern"]).split("|")
    single = tuple(a for a in alts if group and re.fullmatch(r"[a-z0-9_]+", a))
    return single, tuple(a for a in alts if a not in single)


def _needs(rule: dict, only: tuple[str, ...] | None = None) -> tuple[set[str], set[str]]:
    """Whole tokens and plain substrings one of which occurs in every text the rule matches (by the alternatives ``only``): tokens
    where the alternatives are plain words, substrings where words may be glued together."""
    words, parts = set(), set()
    group = re.fullmatch(r"\\b\((.*)\)\\b", rule["pattern"])
    for alt in only if only is not None else (group.group(1) if group else rule["pattern"]).split("|"):
        plain = re.sub(r"\\b|\(\?[!:].*$", "", alt)
        run = re.match(r"[a-z0-9_]+", re.sub(r"^[^a-z0-9_]+", "", plain))
        if run is None:
            parts.update(ch for ch in "?!" if ch in alt)
        elif group and re.fullmatch(r"[a-z0-9_äöüß ]+", alt):
            words.add(run.group())
        else:
            parts.add(run.group())
    return words, parts


def _guard(low: Column, tok: Column, words: set[str], parts: set[str]) -> Column:
    """A cheap test that holds wherever a rule with these needs matches."""
    test = one_of(tok, words) if words else F.lit(False)
    for p in sorted(parts):
        test = test | F.contains(low, F.lit(p))
    return test


def rule_counts(texts: DataFrame, sets: tuple[str, ...], keys: list[str]) -> DataFrame:
    """Matches per text and rule, as long rows ``(keys, rule, n)``, for texts in column ``low``; ``more`` holds the
    start of the following text, whose own matches are subtracted again.

    Each text is cut into tokens once and only the tokens that start some rule are kept. A rule of single words counts its
    tokens. A pattern runs only on texts that hold the start of something else it can match, and beyond the text only if it
    can match several words.
    """
    rules = [(i, r, *_single_words(r)) for i, r in enumerate(RULES) if r["set"] in sets]
    words = set().union(*[set(single) | _needs(r)[0] for _, r, single, _ in rules])
    rows = texts.filter(F.col("low").isNotNull()).withColumn("_after", nz(F.col("more"), ""))
    rows = rows.withColumns({"_ext": F.concat("low", "_after"), "_glued": (F.col("_after") != "") & ~F.col("_after").rlike(r"^\s")})
    rows = rows.withColumn("_tok", F.filter(F.split("low", r"\W+"), lambda w: w.isin(*sorted(words))))

    def matches(pattern: str) -> Column:
        if not re.search(r" |\\s|\\W|(?<!\\)\.", pattern):
            return F.regexp_count("low", F.lit(java_lower(pattern)))
        return F.regexp_count("_ext", F.lit(java_lower(pattern))) - F.when(F.col("_after") == "", 0).otherwise(F.regexp_count("_after", F.lit(java_lower(pattern))))

    def count(rule: dict, single: tuple[str, ...], rest: tuple[str, ...]) -> Column:
        # What may match in several words starts in the text, unless the text behind it goes on without a space.
        other = F.col("_glued")
        phrases = [a for a in rest if re.fullmatch(r"[a-z0-9_äöüß ]+", a)]
        words, parts = _needs(rule, tuple(phrases))
        if phrases:
            other = other | (_guard(F.col("low"), F.col("_tok"), words, parts) & any_of(F.col("_ext"), *phrases))
        if len(phrases) < len(rest):
            other = other | _guard(F.col("low"), F.col("_tok"), *_needs(rule, tuple(a for a in rest if a not in phrases)))
        alone = F.size(F.filter("_tok", lambda w: w.isin(*single))) if single else F.lit(0)
        return F.when(other, matches(rule["pattern"])).otherwise(alone)

    found = F.array(*[F.struct(F.lit(i).alias("rule"), count(r, single, rest).alias("n")) for i, r, single, rest in rules])
    return rows.select(*keys, F.explode(F.filter(found, lambda x: x["n"] != 0)).alias("_m")).select(*keys, "_m.rule", "_m.n")


def _rule_value(field: str) -> Column:
    return F.element_at(F.array(*[F.lit(r[field]) for r in RULES]), F.col("rule") + 1)


def joined_lines(lines: DataFrame) -> DataFrame:
    """Lines with the words that follow them, over as many lines as that takes, so that phrases across line ends count
    without joining a recording's whole text in one place. Blank lines are left out but keep their space."""
    low = ordered(lines.withColumns({"low": F.lower("text"), "_one": F.lit(1)}), KEY, "seq", tile=4096, run_sum={"_at": "_one"})
    low = ordered(low.filter(F.col("low").rlike(r"\S")), KEY, "seq", tile=4096, lag={"_before": "_at"}, run_sum={"_pos": "_one"})
    space = F.repeat(F.lit(" "), (F.col("_at") - F.col("_before")).cast("int"))
    start = F.concat(nz(space, ""), F.regexp_extract("low", r"^\s*(?:\S+\s*){0,%d}" % JUNCTION, 0))
    next_ = lambda spec: F.collect_list("_start").over(spec.rowsBetween(1, JUNCTION))
    rows = windowed(low.withColumn("_start", start), KEY, "_pos", JUNCTION, ["seq"], {"_next": next_}, tile=4096)
    more = F.regexp_extract(F.array_join("_next", ""), r"^\s*(?:\S+\s+){0,%d}\S*" % (JUNCTION - 1), 0)
    return rows.withColumn("more", more).drop("_one", "_at", "_before", "_pos", "_start", "_next")


def metadata_points(texts: DataFrame) -> DataFrame:
    """Points per category and game from ``(video_id, source, text)``."""
    rows = texts.select(*KEY, "source", F.lower("text").alias("low"), F.lit(None).cast("string").alias("more"))
    counts = rule_counts(rows, ("title",), [*KEY, "source"])
    weight = F.lit(0.0)
    for name, value in SOURCE_WEIGHTS.items():
        weight = F.when(F.col("source") == name, value).otherwise(weight)
    order = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source")) * 1000
    points = counts.withColumns({"points": _rule_value("weight") * F.least(F.col("n"), F.lit(MATCH_CAP)) * weight, "pos": order + _rule_value("pos")})
    return points.select(*KEY, _rule_value("category").alias("category"), _rule_value("game").alias("game"), "points", "pos")


def transcript_points(lines: DataFrame) -> DataFrame:
    """Points per category and game from spoken lines: counts add up over lines, then the caps apply."""
    total = rule_counts(joined_lines(lines), ("title", "spoken", "keywords"), KEY).groupBy(*KEY, "rule").agg(F.sum("n").alias("n"))
    speech = SOURCE_WEIGHTS["transcript"]
    kind = _rule_value("set")
    base = 5000
    # A row per matched rule and one per category of keywords, in one pass over the counts.
    group = F.when(kind == "keywords", _rule_value("category")).otherwise(F.col("rule").cast("string"))
    sums = total.filter((kind == "keywords") | (F.col("n") > 0)).groupBy(*KEY, group.alias("_g")).agg(
        F.max("rule").alias("rule"), F.max("n").alias("n"), F.sum(F.least(F.col("n"), F.lit(KEYWORD_CAP))).alias("_h"), F.min(_rule_value("pos")).alias("pos"))
    single = _rule_value("weight") * F.least(F.col("n"), F.lit(MATCH_CAP)) * F.when(kind == "title", speech * TITLE_ON_SPEECH).otherwise(speech)
    points = F.when(kind == "keywords", F.col("_h") * KEYWORD_POINTS * speech * KEYWORDS_ON_SPEECH).otherwise(single)
    return sums.filter((kind != "keywords") | (F.col("_h") >= KEYWORD_LEAST)).select(
        *KEY, _rule_value("category").alias("category"), _rule_value("game").alias("game"), points.alias("points"), (F.col("pos") + base).alias("pos"))


def merged_scores(*points: DataFrame) -> DataFrame:
    out = points[0]
    for p in points[1:]:
        out = out.unionByName(p)
    return out.groupBy(*KEY, "category", "game").agg(F.round(F.sum("points"), 6).alias("score"), F.min("pos").alias("pos"))


def confidence_of(score: Column) -> Column:
    return (F.when(score >= 42, 94).when(score >= 28, 88).when(score >= 18, 80).when(score >= 12, 72).when(score >= 8, 62).when(score > 0, 52).otherwise(35))


def best_category(scores: DataFrame, videos: DataFrame) -> DataFrame:
    """Category per recording of ``videos (video_id, gaming)``; generic gaming where only gaming words occur."""
    best = scores.filter("score > 0").groupBy(*KEY).agg(F.max_by(F.struct("category", "game", "score"), F.struct("score", -F.col("pos"))).alias("_b"))
    out = videos.join(best, KEY, "left")
    plain = F.when(F.col("gaming"), F.struct(F.lit("generic").alias("category"), F.lit("Gaming").alias("game"), F.lit(6.0).alias("score"))).otherwise(
        F.struct(F.lit("generic").alias("category"), F.lit(None).cast("string").alias("game"), F.lit(0.0).alias("score")))
    out = out.withColumn("_b", F.coalesce("_b", plain)).select(*videos.columns, "_b.*")
    return out.withColumn("confidence", confidence_of(F.col("score")))


def visual_points(visual: DataFrame) -> DataFrame:
    """Points from a frame classification ``(video_id, category, game, score)``."""
    return visual.filter(F.col("category") != "generic").select(*KEY, "category", "game", (F.col("score") * 0.35 * SOURCE_WEIGHTS["visual"]).alias("points"), F.lit(9000).alias("pos"))


def signal_bonus(best: DataFrame, sources: Column) -> DataFrame:
    """More confidence when several kinds of signal were read."""
    kinds = F.array_distinct(sources)
    bonus = F.when(F.size(kinds) >= 3, 8).when(F.array_contains(kinds, "visual") & F.array_contains(kinds, "transcript"), 6).otherwise(0)
    return best.withColumn("confidence", F.least(F.lit(97), F.col("confidence") + bonus))


def is_gaming(text: Column) -> Column:
    return has(text, GAMING_WORDS)


def is_shooter(category: Column, game: Column) -> Column:
    return (category == "shooter") | has(nz(game, ""), SHOOTER_GAMES)


# Words that mark gameplay content.
GAMEPLAY_WORDS = r"\b(game|gameplay|stream|twitch|minecraft|fortnite|valorant|react|horror|jumpscare|let'?s play|gaming|boss|level|speedrun)\b"


def is_gameplay(text: Column) -> Column:
    return has(text, GAMEPLAY_WORDS)


def talk_counts(lines: DataFrame) -> DataFrame:
    """Kill and holding vocabulary over whole transcripts."""
    rows = joined_lines(lines)
    after = nz(F.col("more"), "")
    ext = F.concat("low", after)
    count = lambda p: F.regexp_count(ext, F.lit(java_lower(p))) - F.regexp_count(after, F.lit(java_lower(p)))
    return rows.groupBy(*KEY).agg(F.sum(count(KILL_WORDS)).alias("kill_terms"), F.sum(count(BORING_WORDS)).alias("boring_terms"))


def infer_shooter(videos: DataFrame) -> DataFrame:
    """``(video_id, clusters, peaks, kill_terms, boring_terms)`` with the first signal that says shooter, or null."""
    reason = (F.when(F.col("clusters") >= 1, "kill chains").when(F.col("peaks") >= 5, "combat spikes")
              .when((F.col("kill_terms") >= 4) & (F.col("kill_terms") > F.col("boring_terms")), "kill terms"))
    return videos.withColumn("reason", reason).filter(F.col("reason").isNotNull()).withColumn("confidence", F.lit(82))


def _shows(low: Column, pattern: str) -> Column:
    """Whether lower-case text matches; the pattern runs only on texts that hold its longest plain part."""
    part = max(re.findall(r"[a-z0-9]+", re.sub(r"\\[a-z]|.\?", " ", pattern)), key=len)
    held = F.contains(low, F.lit(part))
    return held if part == pattern else held & low.rlike(java_lower(pattern))


def frame_scores(frames: DataFrame, signatures: list[dict], layout: dict[str, dict[str, float]], running: bool = True) -> DataFrame:
    """Scores per category and game over sampled frames ``(video_id, frame, text, density map)``: each pattern counts
    once per frame, and a layout whose region densities pass their thresholds adds 8 x 0.35 per region to every
    game of the category. Densities add up over the frames unless ``running`` is off."""
    regions = sorted({r for rules in layout.values() for r in rules})
    plain = F.translate(F.lower(nz(F.col("text"), "")), "ſı", "si")  # as folding case for all scripts reads them
    rows = frames.select(*KEY, "frame", plain.alias("low"), *[nz(F.col("density")[r], 0.0).alias(f"_d_{r}") for r in regions])
    if running:
        rows = ordered(rows, KEY, "frame", tile=10000, run_sum={f"_d_{r}": f"_d_{r}" for r in regions})
    parts = []
    for i, sig in enumerate(signatures):
        text = F.lit(0.0)
        for p in sig["patterns"]:
            text = text + F.when(_shows(F.col("low"), p), float(sig["weight"])).otherwise(0.0)
        shape = F.lit(0.0)
        for r, limit in layout.get(sig["category"], {}).items():
            shape = shape + F.when(F.col(f"_d_{r}") >= limit, 8 * 0.35).otherwise(0.0)
        parts.append(F.struct(F.lit(sig["category"]).alias("category"), F.lit(sig["game"]).alias("game"), F.lit(i).alias("pos"), (text + shape).alias("points")))
    long = rows.select(*KEY, F.explode(F.filter(F.array(*parts), lambda x: x["points"] > 0)).alias("_p")).select(*KEY, "_p.*")
    return long.groupBy(*KEY, "category", "game").agg(F.round(F.sum("points"), 6).alias("score"), F.min("pos").alias("pos"))


def frame_layout(frames: DataFrame, regions: list[str]) -> DataFrame:
    """Frames of each recording and the mean density of each region over them."""
    mean = [(F.floor(F.sum(nz(F.col("density")[r], 0.0)) / F.count(F.lit(1)) * 10_000 + 0.5) / 10_000).alias(r) for r in regions]
    return frames.groupBy(*KEY).agg(F.count(F.lit(1)).alias("frames"), *mean)


def shown_scores(scores: DataFrame, most: int) -> DataFrame:
    """The best games of each recording with the confidence of the first one's score."""
    top = top_per_key(scores, KEY, [F.desc("score"), F.col("pos")], most, rank="place")
    return top.withColumn("confidence", F.when(F.col("place") == 1, frame_confidence(F.col("score"))))


def frame_confidence(score: Column) -> Column:
    return F.when(score >= 45, 94).when(score >= 30, 86).when(score >= 18, 76).when(score >= 10, 64).otherwise(50)


# Words that tell German and English apart, and language names.
GERMAN = r"\b(der|die|das|und|ich|nicht|ist|ein|eine|wir|ihr|schon|auch|mal)\b"
ENGLISH = r"\b(the|and|you|this|that|with|have|from|they|what)\b"
LANGUAGE_CODES = (
    "de", "nl", "he", "lt", "ml", "te", "sq", "fr", "ca", "hi", "fi", "vi", "da", "et", "br", "es", "uk", "no", "th", "az", "hy", "mn", "sd", "id",
    "lv", "bn", "bs", "gl", "so", "ka", "yi", "pl", "is", "kk", "km", "am", "lo", "mg", "ha", "bg", "ne", "mr", "sn", "gu", "ar", "ta", "hr", "mi",
    "fa", "tk", "tl", "su", "yue", "tr", "sv", "cs", "hu", "sr", "sl", "kn", "mk", "zh", "it", "sw", "be", "uz", "fo", "nn", "as", "ru", "cy", "yo",
    "tg", "my", "ln", "jv", "ur", "af", "ht", "ro", "sk", "lb", "bo", "tt", "haw", "pt", "pa", "si", "oc", "mt", "ja", "eu", "ps", "ko", "el", "ms",
    "la", "sa", "ba", "en",
)
LANGUAGE_NAMES = {
    "german": "de", "deutsch": "de", "english": "en", "french": "fr", "spanish": "es", "italian": "it", "portuguese": "pt", "dutch": "nl", "russian": "ru", "japanese": "ja",
    "korean": "ko", "chinese": "zh", "arabic": "ar", "hindi": "hi", "turkish": "tr", "polish": "pl", "swedish": "sv", "norwegian": "no", "danish": "da", "finnish": "fi",
    "czech": "cs", "hungarian": "hu", "romanian": "ro", "ukrainian": "uk", "greek": "el", "hebrew": "he", "indonesian": "id", "vietnamese": "vi", "thai": "th",
}


def guess_language(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.rlike(java_lower(GERMAN)), "de").when(low.rlike(java_lower(ENGLISH)), "en")


def language_code(name: Column) -> Column:
    """ISO code of a language code or English name, null when unknown."""
    low = F.lower(F.trim(name))
    pairs = F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])
    return F.when(low.isin(*LANGUAGE_CODES), low).otherwise(F.try_element_at(pairs, low))


# Labels that do not name a game.
NO_GAME = ("", "Gaming", "FPS", "Generic")


def game_label(game: Column) -> Column:
    name = F.trim(nz(game, ""))
    return F.when(name.isin(*NO_GAME), "unknown").otherwise(name)


def error_class(message: Column) -> Column:
    """Class of a failure message, first rule that fits."""
    low = F.lower(message)
    return (
        F.when(F.contains(message, F.lit("_API_KEY")) | low.rlike("authentication_error|invalid x-api-key"), "auth")
        .when(low.rlike("not_found_error|model.*not found"), "model").when(low.rlike("invalid json|json at position"), "json")
        .when(low.rlike("ffmpeg.*not found|ffmpeg-static"), "tool").when(F.contains(message, F.lit("cookies expired")) | F.contains(message, F.lit("cookies.txt not found at:")), "cookies")
        .when(F.startswith(message, F.lit("Video download failed:")) | F.contains(message, F.lit("Piped API")), "download")
        .when(F.contains(message, F.lit("Transcript is disabled")) | F.contains(message, F.lit("No transcript")), "captions")
        .when(F.contains(message, F.lit("Video unavailable")) | F.contains(message, F.lit("Private video")), "unavailable")
        .when(F.contains(message, F.lit("Invalid YouTube")), "url").otherwise("other"))


def shorten(message: Column, most: int = 200) -> Column:
    return F.when(F.length(message) > most, F.concat(F.left(message, F.lit(most)), F.lit("…"))).otherwise(message)


def video_id_of(url: Column) -> Column:
    """The eleven-character id of a watch, short, shorts or embed address, else null."""
    u = F.trim(url)
    found = F.coalesce(*[F.nullif(F.regexp_extract(u, p, 1), F.lit("")) for p in (
        r"(?:youtube\.com/watch\?v=|youtube\.com/watch\?.*&v=)([a-zA-Z0-9_-]{11})", r"youtu\.be/([a-zA-Z0-9_-]{11})",
        r"youtube\.com/shorts/([a-zA-Z0-9_-]{11})", r"youtube\.com/embed/([a-zA-Z0-9_-]{11})")])
    return found


def start_second_of(url: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(url, p, 1), F.lit("")).try_cast("bigint") for p in (r"(?i)[?&]t=(\d+)(?:s)?", r"(?i)[?&]start=(\d+)")])


def sample_times(duration: Column, count: int = 10) -> Column:
    """Evenly spaced frame times, away from both ends."""
    dur = F.greatest(F.lit(30.0), F.when(nz(duration, 0.0) == 0, 300.0).otherwise(duration))
    n = max(6, min(count, 14))
    start = F.least(F.lit(45.0), dur * 0.03)
    end = F.greatest(start + 30, dur * 0.92)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(start + i * ((end - start) / (n - 1)), 2))


def chunk_starts(duration: Column, chunk: float = 600.0, most: int = 24) -> Column:
    """Starts of transcription chunks; longer sources get ``most`` evenly spread ones."""
    n = F.ceil(duration / chunk).cast("int")
    full = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i * chunk).cast("double"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * (duration / most)).cast("double"))
    return F.when(n > most, spread).otherwise(full)
