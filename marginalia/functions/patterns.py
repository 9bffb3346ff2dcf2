"""Word lists and patterns that results depend on.

Patterns are written for Java with (?U), so \\w and \\b know all of Unicode.
"""

from __future__ import annotations

STOP_WORDS = (
    "a an and are as at be by for from has have he her him his i in is it its "
    "me my of on or our she that the their them they this to was we were what "
    "when where which who will with you your"
).split()

LINK = r"\[\[([^\]\|]+?)(?:\|[^\]]*)?\]\]"
CODE = (r"````[\s\S]*?````", r"```[\s\S]*?```", r"`[^`]+`")
INDEX_FILES = ("_CLOSETS.md", "_CLOSETS-archive.md")
CATALOG_FILE = "_MANIFEST.md"
EDGE_KEYS = ("people", "projects", "supersedes", "superseded-by", "blocks", "blocked-by")
INFRASTRUCTURE = (".git", ".claude", ".obsidian", "node_modules", "__pycache__", ".venv", "venv", "dist", "build")
TIER_ONE_FOLDERS = ("memory", "scratch")

CAPITALIZED = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\b"
RELATION_NAME = (
    r"(?i)\bmy\s+(?:brother|sister|cousin|friend|coworker|colleague|manager|boss|partner|husband|wife|"
    r"boyfriend|girlfriend|son|daughter|mom|dad|mother|father|uncle|aunt|nephew|niece|grandma|"
    r"grandpa|grandmother|grandfather|roommate|neighbor|teammate|classmate|teacher|doctor|"
    r"therapist|trainer|coach|landlord)\s+(?:named\s+|called\s+)?([A-Z][a-z]{2,15}|[a-z]{3,15})\b"
)
NAMED = r"(?i)\b(?:named|called)\s+([A-Z][a-z]{2,15}(?:\s+[A-Z][a-z]{2,15})?)"
NOT_NAMES = (
    "I We You They He She It My Your Our Their His Her And Or But So Then Now Today Yesterday Tomorrow "
    "January February March April May June July August September October November December "
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday If When Where What Why How The"
).split()

CLAIMS = (
    r"(?i)\bI\s+(?:am|'m)\s+[^.?!]{2,80}",
    r"(?i)\bI\s+(?:have|'ve)\s+[^.?!]{2,80}",
    r"(?i)\bI\s+(?:was|wasn't|used to)\s+[^.?!]{2,80}",
    r"(?i)\bI\s+(?:prefer|like|want|need|love|hate|enjoy|dislike|adore|miss)\s+[^.?!]{2,80}",
    r"(?i)\bmy\s+\w+(?:'s\s+\w+)?\s+(?:is|are|was|were|isn't|aren't|wasn't|weren't)\s+[^.?!]{2,80}",
    r"(?i)\bI\s+(?:work|live|grew up|came from|moved|study|train|practice)\s+[^.?!]{2,80}",
    r"(?i)\bI\s+(?:went|got|bought|made|tried|visited|saw|met|joined|started|stopped|quit)\s+[^.?!]{2,80}",
    r"(?i)\bI'?m\s+(?:a|an)\s+[^.?!]{2,80}",
    r"(?i)\b(?:named|called|name is|nicknamed)\s+[A-Z]\w+(?:\s+[A-Z]\w+)?",
    r"(?i)\ballergic\s+to\s+[\w\s]{2,40}",
    r"(?i)\bI\s+can'?t\s+(?:eat|drink|have|stand|stomach|tolerate)\s+[^.?!]{2,80}",
    r"(?i)\b\d+(?:\.\d+)?\s+(?:kids?|children|cats?|dogs?|years?\s+old|months?\s+old|siblings?|brothers?|sisters?|hours?|miles?|pounds?|kg|lbs)\b",
)
DECISIONS = (
    r"(?i)\bI\s+(?:decided|chose|picked|went with|opted)\s+[^.?!]{2,80}",
    r"(?i)\b(?:going|planning|plan)\s+(?:to|with)\s+[^.?!]{2,80}",
    r"(?i)\bI'?ll\s+(?:go|try|use|switch|stick|stay|start|stop)\s+[^.?!]{2,80}",
    r"(?i)\b(?:switched|switching|moving|migrated)\s+(?:to|from)\s+[^.?!]{2,80}",
    r"(?i)\b(?:rejected|abandoned|gave up on|dropped|ditched|removed)\s+[^.?!]{2,80}",
    r"\b(?:trying|testing|evaluating)\s+[A-Z]\w+\b[^.?!]{0,40}",
    r"(?i)\b(?:won'?t|will not|don'?t want to|not going to)\s+[^.?!]{2,80}",
    r"(?i)\b\w+\s+over\s+\w+(?:\s+\w+){0,3}",
)
DATES = (
    r"(?i)\b(?:January|February|March|April|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept?|Oct|Nov|Dec)\b[^.,!?\n;:]{0,30}",
    r"\bMay\b[^.,!?\n;:]{0,30}",
    r"\b(?:19[89]\d|20[0-9]\d)\b",
    r"(?i)\b(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)\b[^.,!?\n;:]{0,20}",
    r"(?i)\b(?:yesterday|tomorrow|today|tonight|this morning|this afternoon|this evening|last night|next week|last week|this week|next month|last month|this month|next year|last year|this year|next weekend|last weekend|this weekend)\b",
    r"(?i)\b\d+\s+(?:days?|weeks?|months?|years?|hours?|minutes?)\s+(?:ago|from\s+now|later|before|after)\b",
    r"\b\d{1,2}/\d{1,2}(?:/\d{2,4})?\b",
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"\b(?:1[0-2]|0?[1-9])(?::[0-5]\d)?\s*(?:am|pm|AM|PM)\b",
    r"\b(?:[01]?\d|2[0-3]):[0-5]\d\b",
)
QUOTED = r'"([^"\n]{4,80})"'
LIST_ITEM = r"(?m)^\s*(?:[-*]|\d+\.)\s+(.{4,100})$"
HEADING = r"(?m)^\s*#{1,4}\s+(.{3,80})$"
CAPITALS = r"\b[A-Z]{2,15}(?:[-_][A-Z]{1,15})?\b"
NOT_CAPITALS = ("I", "AM", "PM", "OK", "TO", "OF", "AT", "IS", "AS", "BY", "OR", "AND", "THE", "A", "AN")

#: Override language of audits; `update` leaves out the last.
OVERRIDES = ("supersedes", "replaces", "dropped", "no longer", "instead of", "reverses", "overrides")
STALE_MARKERS = ("outdated", "deprecated", "superseded", "archived", "do not use", "replaced by")
