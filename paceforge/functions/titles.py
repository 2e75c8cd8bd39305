"""Session classes from activity titles, by column expressions."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Title rules in order of precedence: class and the terms that name it (fixed values).
RULES = {
    "race": [r"\brace\b", r"\bracing\b", r"\btime\s+trial\b", r"\bcompetition\b", r"\bchampionship\b"],
    "hills": [r"\bhills?\b", r"\bhilly\b", r"\bclimbs?\b", r"\bcotes?\b"],
    "intervals": [r"\bintervals?\b", r"\brepeats?\b", r"\breps?\b", r"\bfartlek\b"],
    "tempo": [r"\btempo\b", r"\bthreshold\b", r"\blactate\s+threshold\b", r"\bsteady\s+state\b", r"\bseuil\b"],
    "progressive": [r"\bprogressive\b", r"\bprogression\b", r"\bnegative\s+split\b"],
    "long": [r"\blong(?:\s+run)?\b", r"\bsortie\s+longue\b"],
    "easy": [r"\beasy\b", r"\baerobic\b", r"\brecovery\b", r"\bshakeout\b", r"\bfooting\b", r"\bz(?:one\s*)?2\b"],
}
INTERVAL_NOTATION = r"\b\d+\s*x\s*\d+(?:\.\d+)?\s*(?:km|k|m|min|minute|minutes|s|sec|seconds)?\b"
QUALITY = ("race", "hills", "intervals", "tempo", "progressive")


@lru_cache(maxsize=1)
def _foldings() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters of the basic plane that decompose to one ASCII character, their stand-ins, and those that give several."""
    single, stand_in, several = [], [], []
    for code in range(0x80, 0x10000):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or c == "×":
            continue
        folded = "".join(x for x in unicodedata.normalize("NFKD", c) if x < "\x80").lower()
        if len(folded) == 1:
            single.append(c)
            stand_in.append(folded)
        elif len(folded) > 1:
            several.append((c, folded))
    return "".join(single), "".join(stand_in), tuple(several)


def normalized_title(title: Column) -> Column:
    """Multiplication signs as x, accents dropped, other signs as single blanks, lower case; null is empty."""
    single, stand_in, several = _foldings()
    text = F.translate(F.coalesce(title, F.lit("")), "×" + single, "x" + stand_in)
    # characters that give several letters are rare; only titles that have any are taken apart
    table = F.from_json(F.lit(json.dumps(dict(several))), "map<string,string>")
    expanded = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(table[c], c)), "")
    text = F.when(text.rlike("[^\\x00-\\x7f]"), F.regexp_replace(expanded, "[^\\x00-\\x7f]", "")).otherwise(text)
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9+]+", " "))


def classify(title: Column) -> Column:
    """struct(normalized, primary, tags, matched_terms, confidence, is_quality) of a title."""
    text = normalized_title(title)
    return classify_normalized(text)


def classify_normalized(text: Column) -> Column:
    tags = F.filter(F.array(*[F.when(text.rlike("|".join(terms)), F.lit(kind)) for kind, terms in RULES.items()]), lambda t: t.isNotNull())
    terms = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(term), F.lit(0)) for kind in RULES.values() for term in kind]))
    notation = F.regexp_extract(text, INTERVAL_NOTATION, 0)
    by_notation = (F.size(tags) == 0) & (notation != "")
    kinds = F.when(F.size(tags) > 0, tags).when(by_notation, F.array(F.lit("intervals"))).otherwise(F.array(F.lit("unclassified")))
    return F.struct(
        text.alias("normalized"),
        kinds[0].alias("primary"),
        kinds.alias("tags"),
        F.array_distinct(F.when(by_notation, F.array(notation)).otherwise(terms)).alias("matched_terms"),
        F.when(F.size(tags) > 0, "high").when(by_notation, "medium").otherwise("low").alias("confidence"),
        F.arrays_overlap(kinds, F.array(*map(F.lit, QUALITY))).alias("is_quality"),
    )


def title_from_file(path: Column) -> Column:
    """The file name without its sensor-file suffix and copy number, underscores as blanks."""
    name = F.element_at(F.split(path, "/"), -1)
    name = F.regexp_replace(name, r"(?i)\.fit(\.gz)?$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"\s*\(\d+\)$", ""), "_+", " "))


def coarse_type(title: Column) -> Column:
    """race, long, easy, workout or unknown by parts of the title, in that order."""
    text = F.lower(F.coalesce(title, F.lit("")))
    has = lambda *parts: F.greatest(*[F.contains(text, F.lit(p)) for p in parts]) if len(parts) > 1 else F.contains(text, F.lit(parts[0]))
    return F.when(has("race"), "race").when(has("long"), "long").when(has("easy", "aerobic"), "easy").when(has("interval", "tempo", "progressive", "workout", "hill"), "workout").otherwise("unknown")
