"""Column functions on names and text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN = r"[\p{IsAlphabetic}\p{N}]+"
#: Inside a run: between lower and upper case, and between a letter and an ASCII digit.
BOUNDARY = r"(?<=\p{Ll})(?=\p{Lu})|(?<=[0-9])(?=\p{IsAlphabetic})|(?<=\p{IsAlphabetic})(?=[0-9])"

# Groups of words that a search treats as one.
SYNONYMS = (
    "gun guns firearm firearms weapon weapons rifle pistol revolver handgun ak47 ak m4 m16 smg shotgun sniper",
    "sword blade katana dagger knife machete melee",
    "car vehicle truck automobile sedan suv van",
    "tree foliage plant bush shrub vegetation",
    "rock stone boulder cliff gravel",
    "brick bricks masonry wall",
    "wood timber plank planks bark log",
    "metal steel iron rust rusty rusted",
    "grass turf lawn meadow",
    "water ocean sea liquid fluid wave",
    "footstep footsteps foot step steps walk",
    "explosion explode blast boom detonation",
    "music song track tune melody soundtrack",
    "ambient ambience atmosphere background drone",
    "voice vocal speech dialogue dialog",
    "loop looping looped seamless",
    "character char hero npc person human humanoid",
    "building house structure architecture",
)


def nocase(column: Column) -> Column:
    """ASCII letters in lower case; others as they are."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def name_tokens(name: Column) -> Column:
    """Search tokens of a name: each alphanumeric run and its parts, lower case, two bytes or more, in order."""
    runs = F.regexp_extract_all(name, F.lit(RUN), F.lit(0))
    parts = F.flatten(F.transform(runs, lambda r: F.concat(F.array(r), F.split(F.regexp_replace(r, BOUNDARY, " "), " "))))
    return F.array_distinct(F.filter(F.transform(parts, F.lower), lambda t: F.octet_length(t) >= 2))


def folder_tokens(path: Column) -> Column:
    """Tokens of every directory of a path, without the file name."""
    segments = F.split(path, "/")
    return name_tokens(F.array_join(F.slice(segments, F.lit(1), F.greatest(F.size(segments) - 1, F.lit(0))), "/"))


def plain_tokens(text: Column) -> Column:
    """Lower-case alphanumeric runs of a text, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(RUN), F.lit(0))


def query_groups(text: str, synonyms: tuple[str, ...] = SYNONYMS) -> list[list[str]]:
    """The AND-ed groups of a query: each token with the members of all its synonym groups."""
    token, tokens = "", []
    for char in text + " ":
        if char.isalnum():
            token += char
        elif token:
            tokens.append(token.lower())
            token = ""
    groups = []
    for t in tokens:
        members = {t}
        for line in synonyms:
            if t in line.split():
                members |= set(line.split())
        groups.append(sorted(members))
    return groups


def matches(tokens: Column, groups: list[list[str]]) -> Column:
    """True where every group has a term that some token begins with."""

    def group(terms: list[str]) -> Column:
        return F.exists(tokens, lambda t: reduce(lambda a, b: a | b, [t.startswith(term) for term in terms]))

    return reduce(lambda a, b: a & b, [group(g) for g in groups], F.lit(True))


def fold(text: Column) -> Column:
    """Lower case without the common Latin diacritics."""
    return F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
