"""Category profiles and title matchers as data."""
from __future__ import annotations

# Scoring profile per content category.
PROFILES: dict[str, dict] = {
    "shooter": {
        "keywords": (
            r"\b(ace|clutch|1v\d|one v|headshot|nade|frag|pick|trade|one tap|multikill)\b",
            r"\b(round win|won the round|gg|team kill|tk|awp|operator)\b",
            r"\b(kill|killed|died|down|eliminated|last alive|double|triple|quad)\b",
            r"\b(no way|insane|what|bro|let'?s go|nice|got him)\b",
        ),
        "lore": (
            r"\b(plant|planted|defus|holding|hold the|save round|waiting|rotate|default)\b",
            r"\b(buy round|economy|eco round|utility|smoke lineup|default call)\b",
            r"\b(taktik|strategie|buy|öko|smoke|callout|rotation|pflanzt|hält)\b",
        ),
        "keyword_bonus": 11, "lore_penalty": 14, "audio_weight": 1.35, "structure_weight": 1, "monologue_penalty": 1.3, "min_clip": 20, "max_clip": 35,
    },
    "moba": {
        "keywords": (
            r"\b(penta|quadra|triple kill|teamfight|baron|drake|dragon|elder|herald)\b",
            r"\b(ff|surrender|got him|nice|clean|outplay|flash|ult)\b",
            r"\b(kill|killed|ace|wipe|push|end|nexus|inhib)\b",
            r"\b(no way|insane|what|bro|let'?s go|clutch)\b",
        ),
        "lore": (
            r"\b(item build|runes|matchup|wave management|csing|last hit|farm phase)\b",
            r"\b(build|runen|matchup|lane|farmen|last hits)\b",
        ),
        "keyword_bonus": 10, "lore_penalty": 13, "audio_weight": 1.15, "structure_weight": 1.25, "monologue_penalty": 1.2, "min_clip": 14, "max_clip": 45,
    },
    "survival": {
        "keywords": (
            r"\b(died|death|killed|rip|gg|base|raid|loot|craft|build)\b",
            r"\b(gestorben|tod|base|raid|loot|craften|bauen)\b",
            r"\b(oh no|no way|help|run|escape|found|discovered)\b",
            r"\b(jump scare|scared|monster|creeper|boss)\b",
        ),
        "lore": (
            r"\b(crafting recipe|tutorial|how to build|let me show|guide)\b",
            r"\b(rezept|tutorial|anleitung|so baust du)\b",
        ),
        "keyword_bonus": 9, "lore_penalty": 16, "audio_weight": 1.2, "structure_weight": 1.1, "monologue_penalty": 1.25, "min_clip": 12, "max_clip": 40,
    },
    "horror": {
        "keywords": (
            r"\b(scared|scream|screaming|oh my god|no way|wtf|help|run)\b",
            r"\b(erschrocken|schrei|hilfe|lauf|grusel|angst)\b",
            r"\b(jump scare|jumpscare|heart attack|i can'?t)\b",
        ),
        "lore": (
            r"\b(lore|backstory|story explanation|plot twist explained)\b",
            r"\b(lore|hintergrund|geschichte erklärt)\b",
        ),
        "keyword_bonus": 10, "lore_penalty": 12, "audio_weight": 1.45, "structure_weight": 1, "monologue_penalty": 1.15, "min_clip": 10, "max_clip": 32,
    },
    "racing": {
        "keywords": (
            r"\b(overtake|overtook|crash|podium|win|won|goal|score|clutch)\b",
            r"\b(überhol|crash|unfall|sieg|tor|punkt)\b",
            r"\b(no way|insane|let'?s go|final lap|photo finish)\b",
        ),
        "lore": (r"\b(setup|tuning|car build|meta|tier list)\b",),
        "keyword_bonus": 9, "lore_penalty": 14, "audio_weight": 1.2, "structure_weight": 1.05, "monologue_penalty": 1.2, "min_clip": 12, "max_clip": 38,
    },
    "react": {
        "keywords": (
            r"\b(react|reaction|watching|oh my god|no way|wtf|insane|crazy)\b",
            r"\b(reagiert|reaction|schau|oh mein gott|krass|wahnsinn)\b",
            r"\b(wait|pause|rewind|look at|did you see)\b",
        ),
        "lore": (),
        "keyword_bonus": 10, "lore_penalty": 16, "audio_weight": 1.1, "structure_weight": 1.15, "monologue_penalty": 1.1, "min_clip": 12, "max_clip": 42,
    },
    "talk": {
        "keywords": (
            r"\b(wait|what|why|no way|actually|truth|secret|crazy|insane)\b",
            r"\b(warte|was|warum|krass|wahrheit|geheim)\b",
            r"\?|!",
        ),
        "lore": (r"\b(anyway|so yeah|moving on|as i was saying)\b",),
        "keyword_bonus": 8, "lore_penalty": 20, "audio_weight": 0.85, "structure_weight": 1.35, "monologue_penalty": 1.4, "min_clip": 14, "max_clip": 45,
    },
    "generic": {
        "keywords": (), "lore": (),
        "keyword_bonus": 9, "lore_penalty": 18, "audio_weight": 1, "structure_weight": 1, "monologue_penalty": 1, "min_clip": 12, "max_clip": 45,
    },
}

# Fixed values: (category, game, weight, patterns) for titles, descriptions, tags and channels.
TITLE_MATCHERS = (
    ("shooter", "Counter-Strike 2", 12, (r"counter[- ]?strike", r"\bcs2\b", r"\bcs\s*2\b", r"\bcsgo\b", r"\bcs:go\b")),
    ("shooter", "Valorant", 12, (r"\bvalorant\b",)),
    ("shooter", "Call of Duty", 11, (r"call of duty", r"\bcod\b(?!\s*of)", r"\bwarzone\b", r"\bmodern warfare\b")),
    ("shooter", "Apex Legends", 10, (r"\bapex legends\b", r"\bapex\b")),
    ("shooter", "Overwatch", 10, (r"\boverwatch\b",)),
    ("moba", "League of Legends", 12, (r"league of legends", r"\blol\b(?!\s*reaction)", r"\blol gameplay\b")),
    ("moba", "Dota 2", 12, (r"\bdota\s*2?\b",)),
    ("moba", "Smite", 10, (r"\bsmite\b",)),
    ("survival", "Minecraft", 12, (r"\bminecraft\b", r"\bmc\b(?!\s*donald)")),
    ("survival", "Rust", 11, (r"\brust\b(?!\s*lang)",)),
    ("survival", "ARK", 10, (r"\bark\b", r"\bark:\s*survival\b")),
    ("horror", "Horror Game", 11, (r"\bhorror game", r"\bphasmophobia\b", r"\boutlast\b", r"\bresident evil\b", r"\bfive nights\b", r"\bfnaf\b")),
    ("racing", "Racing", 10, (r"\bforza\b", r"\bgran turismo\b", r"\bf1\b", r"\bformula 1\b", r"\bneed for speed\b")),
    ("react", "Reaction", 8, (r"\breaction\b", r"\breact(?:s|ing)?\s+to\b", r"\bwatch(?:es|ing)\b")),
    ("talk", "Just Chatting", 8, (r"\bjust chatting\b", r"\birl\b", r"\bpodcast\b", r"\binterview\b", r"\bvlog\b")),
)
# Fixed values: (category, game, weight, patterns) for spoken text.
SPOKEN_MATCHERS = (
    ("shooter", "Counter-Strike 2", 9, (
        r"\b(cs2|csgo|counter.?strike)\b", r"\b(awp|ak|m4|deagle|eco round|save round|buy round)\b",
        r"\b(plant|defuse|bomb|a site|b site|mid|rotate|flash|smoke|molly)\b", r"\b(ct|t side|terrorist|counter.?terrorist)\b")),
    ("shooter", "Valorant", 9, (r"\bvalorant\b", r"\b(spike|ult|ultimate|operator|jett|sage|phoenix|omen|reyna)\b", r"\b(plant|defuse|site [ab])\b")),
    ("moba", "League of Legends", 9, (
        r"\b(league of legends|lol)\b", r"\b(baron|drake|dragon|elder|herald|inhib|nexus|jungler|gank)\b", r"\b(penta|quadra|triple kill|teamfight|ff)\b")),
    ("moba", "Dota 2", 9, (r"\bdota\b", r"\b(roshan|ancient|rampage|beyond godlike)\b")),
    ("survival", "Minecraft", 8, (r"\bminecraft\b", r"\b(creeper|nether|ender|diamond|redstone)\b")),
    ("horror", "Horror Game", 8, (r"\b(phasmophobia|outlast|resident evil|five nights|fnaf)\b",)),
)
# Weight of each text source.
SOURCE_WEIGHTS = {"title": 1.35, "description": 0.65, "tags": 1.15, "channel": 0.5, "transcript": 1.75, "visual": 2.1}
GAMING_WORDS = r"\b(game|gameplay|stream|twitch|let'?s play|gaming|speedrun|ranked|competitive)\b"
SHOOTER_GAMES = r"counter[- ]?strike|\bcs2\b|\bcsgo\b|\bcs:go\b|valorant|overwatch|apex legends|\bcod\b|call of duty|battlefield"
