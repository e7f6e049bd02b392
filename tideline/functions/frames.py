"""What on-screen text and layout say about the game that is played."""
from __future__ import annotations

# Patterns on the text of a frame and the points of each that matches, and region densities of a category's layout.
SIGNATURES = [
    {"category": "shooter", "game": "Counter-Strike 2", "weight": 14,
     "patterns": [r"counter.?terrorist", r"\bterrorist", r"\bct\b", r"\bawp\b", r"defus", r"bomb", r"molotov", r"smoke", r"flash", r"round\s+\d", r"buy\s+zone"]},
    {"category": "shooter", "game": "Valorant", "weight": 14,
     "patterns": [r"\bvalorant\b", r"\bspike\b", r"plant", r"defus", r"ultimate", r"\bult\b", r"operator", r"\bjett\b", r"\bsage\b", r"\bphoenix\b", r"round\s+\d"]},
    {"category": "shooter", "game": "Call of Duty", "weight": 12, "patterns": [r"warzone", r"loadout", r"gulag", r"uav", r"killstreak", r"team\s+death"]},
    {"category": "shooter", "game": "Apex Legends", "weight": 12, "patterns": [r"\bapex\b", r"knock", r"respawn", r"ring", r"champion", r"kill\s+leader"]},
    {"category": "moba", "game": "League of Legends", "weight": 14,
     "patterns": [r"league\s+of\s+legends", r"\blol\b", r"baron", r"dragon", r"drake", r"elder", r"herald", r"inhib", r"nexus", r"penta", r"quadra", r"gold"]},
    {"category": "moba", "game": "Dota 2", "weight": 14, "patterns": [r"\bdota\b", r"ancient", r"roshan", r"courier", r"rampage", r"beyond\s+godlike"]},
    {"category": "survival", "game": "Minecraft", "weight": 13, "patterns": [r"minecraft", r"creeper", r"ender", r"nether", r"diamond", r"redstone"]},
    {"category": "survival", "game": "Rust", "weight": 12, "patterns": [r"\brust\b", r"raid", r"tc\b", r"tool\s+cupboard", r"ak47", r"compound"]},
    {"category": "horror", "game": "Horror Game", "weight": 12, "patterns": [r"phasmophobia", r"outlast", r"resident\s+evil", r"five\s+nights", r"fnaf"]},
    {"category": "racing", "game": "Racing", "weight": 11, "patterns": [r"forza", r"gran\s+turismo", r"formula", r"podium", r"qualifying"]},
]
LAYOUT = {"moba": {"bottom_bar": 0.09}, "shooter": {"top_right": 0.05, "top_center": 0.04}, "survival": {"hotbar": 0.06}}
SHOWN_SCORES = 8
