"""Rules on single detection events, as boolean or numeric columns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.numeric import half_up, nz
from tideline.functions.patterns import BORING_WORDS, KILL_WORDS, PAYOFF_WORDS, has

# Reasons that count as a confirmed identity.
TRUSTED_REASONS = (
    "pov_killer_match", "pov_partial_killer", "pov_partial_any", "pov_partial_victim_foreign",
    "pov_foreign_killer_ocr", "pov_enemy_killer_field", "pov_assist_swap", "pov_name_in_line",
)
SPAWN_WINDOW_SEC = 90.0
EARLY_SEC = 150.0
SPAWN_PAIR_SEC = 6.0
FEED_MIN_SCORE = 0.055

_OPTIONAL = {
    "raw_time": "double", "text": "string", "method": "string", "activity": "double", "validated_by": "string",
    "pov_reason": "string", "kill_anchor_time": "double", "audio_peak_time": "double", "fingerprint": "string",
    "kill_quality_score": "double", "assist": "string", "highlight_color": "string",
}


def complete(df: DataFrame) -> DataFrame:
    """Add the optional event columns a source did not deliver, as typed nulls."""
    return df.withColumns({n: F.lit(None).cast(t) for n, t in _OPTIONAL.items() if n not in df.columns})


def event_time() -> Column:
    return F.coalesce(F.col("raw_time"), F.col("time"), F.lit(0.0))


def _flag(name: str) -> Column:
    return nz(F.col(name), False)


def top_right() -> Column:
    return nz(F.col("roi"), "").startswith("top_right")


def confirmed() -> Column:
    """A detection that can be a kill at all, by region, text and confidence."""
    text = F.trim(nz(F.col("text"), ""))
    named, kill = text != "", has(text, KILL_WORDS)
    conf, act = F.col("confidence"), nz(F.col("activity"), 0.0)
    other = named & ~kill & (has(text, PAYOFF_WORDS) | has(text, BORING_WORDS))
    marked = _flag("player_kill") | _flag("red_highlight") | nz(F.col("method"), "").contains("red-highlight")
    rule = (
        F.when(nz(conf < 0.4, False) | other, False)
        .when(F.col("roi") == "bottom_kills", nz(conf >= 0.65, False) & (_flag("player_kill") | (act >= 0.15)))
        .when(top_right(), marked | (nz(F.col("highlight_score"), 0.0) >= 0.03))
        .when(named, kill)
        .otherwise(nz(conf >= 0.72, False) & (act >= 0.1))
    )
    return rule


def quality(others: Column, kill_others: Column) -> Column:
    """The stricter gate on confirmed detections. ``others`` counts confirmed detections within six seconds and
    ``kill_others`` those among them that are kill icons or name a kill."""
    text = F.trim(nz(F.col("text"), ""))
    named, kill = text != "", has(text, KILL_WORDS)
    conf, act, t = nz(F.col("confidence"), 0.0), nz(F.col("activity"), 0.0), F.col("time")
    marked = _flag("player_kill") | _flag("red_highlight") | (nz(F.col("validated_by"), "") != "") | nz(F.col("method"), "").contains("red-highlight")
    return (
        F.when(F.col("roi") == "bottom_kills", (_flag("player_kill") & (conf >= 0.7)) | ((conf >= 0.8) & (act >= 0.2)))
        .when(top_right(), marked | (nz(F.col("highlight_score"), 0.0) >= 0.035))
        .when(F.col("roi").isin("center_banner", "top_left") & ~named, False)
        .when(named & ~kill, False)
        .when((t < SPAWN_WINDOW_SEC) & (~named | (conf < 0.72)), False)
        .when((t < EARLY_SEC) & ~named & (others >= 1) & (kill_others == 0), False)
        .otherwise(conf >= 0.55)
    )


def player_feed(min_score: float = FEED_MIN_SCORE) -> Column:
    return top_right() & (_flag("player_kill") | _flag("red_highlight")) & (nz(F.col("highlight_score"), 0.0) >= min_score)


def trusted() -> Column:
    marked = _flag("player_kill") | _flag("red_highlight") | (nz(F.col("validated_by"), "") == "red-highlight")
    return marked & nz(F.col("pov_reason").isin(*TRUSTED_REASONS), False) & (nz(F.col("confidence"), 0.0) >= 0.55)


def timeline_score(event: Column | None = None) -> Column:
    """Ranking of detections that describe the same moment."""
    get = (lambda n: event[n]) if event is not None else F.col
    return (
        F.when(nz(get("player_kill"), False) | nz(get("red_highlight"), False), 50.0).otherwise(0.0)
        + nz(get("highlight_score"), 0.0) * 30
        + nz(get("kill_quality_score"), 0.0) * 0.5
        + nz(get("confidence"), 0.0) * 12
        + F.when(nz(get("roi"), "").startswith("top_right"), 4.0).otherwise(0.0)
    )


def strength_of_reading() -> Column:
    return nz(F.col("highlight_score"), 0.0) * 100 + nz(F.col("confidence"), 0.0) * 10 + nz(F.col("activity"), 0.0) * 5


def kill_quality() -> Column:
    return half_up(F.lit(60.0) + nz(F.col("highlight_score"), 0.0) * 80).cast("double")


def anchor(event: Column | None = None, offset: float = 0.0) -> Column:
    """The moment of the kill behind a detection; ``offset`` is the timing profile's shift for marked kills."""
    get = (lambda n: event[n]) if event is not None else F.col
    red = nz(get("red_highlight"), False) | (nz(get("validated_by"), "") == "red-highlight")
    raw = F.coalesce(get("raw_time"), get("time"))
    lead = F.when(get("roi") == "bottom_kills", 0.65).when(get("roi") == "top_right", 0.85).otherwise(0.75)
    return (
        F.when(get("kill_anchor_time").isNotNull() & ~red, get("kill_anchor_time"))
        .when(red | nz(get("player_kill"), False), F.greatest(F.lit(0.0), nz(raw, 0.0) + offset))
        .when(get("audio_peak_time").isNotNull(), F.greatest(F.lit(0.0), get("audio_peak_time") - 0.2))
        .when(raw.isNull(), 0.0)
        .otherwise(F.greatest(F.lit(0.0), raw - lead))
    )
