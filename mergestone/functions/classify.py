"""Tags and kinds of menu lines from word lists. Phrases in which a word does not count are taken out before its list is tried."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from mergestone.functions import vocabulary as V

ACCENTS = ("áàâäãåçéèêëíìîïñóòôöõúùûü", "aaaaaaceeeeiiiinooooouuuu")


#: What stands before and behind a whole word. Written out, since engines differ in which letters their word boundaries know.
BEFORE, BEHIND = r"(?:^|[^\pL\pN_])", r"(?:$|[^\pL\pN_])"


def any_of(*lists: tuple[str, ...]) -> str:
    """A pattern for any word of the lists, as a whole word."""
    return BEFORE + "(?:" + "|".join(w for ws in lists for w in ws) + ")" + BEHIND


def spelt_out(pattern: str) -> set[str]:
    """All strings that a pattern of the word lists stands for: letters, groups of alternatives, sets, and what may be left out;
    a set that may repeat stands for none and one, which is all that the first word of a phrase needs."""

    def alternatives(at: int) -> tuple[set[str], int]:
        out, done = {""}, set()
        while at < len(pattern) and pattern[at] != ")":
            if pattern[at] == "|":
                done |= out
                out, at = {""}, at + 1
                continue
            if pattern.startswith("(?:", at):
                part, at = alternatives(at + 3)
                at += 1
            elif pattern[at] == "[":
                end = pattern.index("]", at)
                part, at = set(pattern[at + 1 : end]), end + 1
            else:
                part, at = {pattern[at]}, at + 1
            if at < len(pattern) and pattern[at] in "?*":
                part, at = part | {""}, at + 1
            out = {a + b for a in out for b in part}
        return done | out, at

    return alternatives(0)[0]


def first_words(*lists: tuple[str, ...]) -> list[str]:
    """The first word of everything that the lists stand for: without one of these in it, a text holds none of them."""
    return sorted({re.match(r"\w+", s)[0] for ws in lists for w in ws for s in spelt_out(w)})


#: code -> (phrases that are taken out first, lists of words)
TAGS = {
    "vegan": ((), (("vegan",),)),
    "vegetarian": ((), (("vegetarian",),)),
    "plant_based": ((), (("plant[ -]based",),)),
    "gluten_free": ((), (("gluten[ /-]*(?:free|friendly|wheat friendly)",),)),
    "contains_alcohol": (V.NOT_BEER, (("beers?", "ales?", "brut", "bellini", "sour ale", "spritz", "(?:red|white) blends?"), V.BEER_STYLE_WORDS, V.WINE_WORDS, V.CIDER_WORDS, V.SPIRIT_WORDS, V.BREW_WORDS)),
    "spicy": (V.NOT_HEAT, (V.HEAT_WORDS,)),
    "contains_nuts": (V.NOT_NUTS, (V.NUT_WORDS,)),
    "contains_shellfish": ((), (V.SHELLFISH_WORDS,)),
}
FLAVOURS = {"sweet": (V.NOT_SWEET, (V.SWEET_WORDS,)), "savory": (V.NOT_SAVORY, (V.SAVORY_WORDS,))}
KINDS = (
    ("cider", (), (V.CIDER_WORDS,)),
    ("beer", V.NOT_BEER, (("beers?", "ales?"), V.BEER_STYLE_WORDS)),
    ("wine", (), (V.WINE_WORDS, V.WINE_ONLY_WORDS)),
    ("beer", (), (V.BEER_MAKER_WORDS,)),
    ("liquor", (), (V.SPIRIT_WORDS,)),
)
DRINK_AT_END = BEFORE + "(?:" + "|".join(V.DRINK_ENDINGS) + r")\s*[*.!]?$"

LAST_WORDS = sorted({re.search(r"\w+$", w)[0] for w in V.DRINK_ENDINGS})


def plain(text: Column) -> Column:
    """Lower-case, Latin letters without accents."""
    return F.translate(F.lower(text), *ACCENTS)


def words_of(text: Column) -> Column:
    return F.split(text, r"[^\pL\pN_]+")


def single_words(*lists: tuple[str, ...]) -> list[str]:
    """What the lists stand for that is one word: a text holds it as a whole word just if it is among the text's words."""
    return sorted({s for ws in lists for w in ws for s in spelt_out(w) if re.fullmatch(r"\w+", s)})


def begins_of_phrases(*lists: tuple[str, ...]) -> list[str]:
    """The first words of what the lists stand for in several words."""
    return sorted({re.match(r"\w+", s)[0] for ws in lists for w in ws for s in spelt_out(w) if not re.fullmatch(r"\w+", s)})


def _any(hits: Column, words: list[str]) -> Column:
    return F.arrays_overlap(hits, F.array(*map(F.lit, words))) if words else F.lit(False)


def _read(text: Column, rules: list[tuple[tuple[str, ...], tuple[tuple[str, ...], ...]]], f: Callable[[Column, Column], Column]) -> Column:
    """``f`` of the plain text and of those of its words that begin anything the rules name, each made once a text. Looking a
    word up takes the same time however long the lists are, and most texts have none."""
    named = sorted({w for out, lists in rules for w in first_words(out, *lists)})
    read = F.transform(F.array(plain(text)), lambda t: F.struct(t.alias("t"), F.array_distinct(F.filter(words_of(t), lambda w: w.isin(*named))).alias("hits")))
    return F.element_at(F.transform(read, lambda x: f(x["t"], x["hits"])), 1)


def _says(text: Column, hits: Column, out: tuple[str, ...], lists: tuple[tuple[str, ...], ...]) -> Column:
    """Where no phrase that doesn't count may begin, a single word of the lists is enough. Patterns are tried only on texts that hold
    the beginning of a phrase. What doesn't count is taken out twice, since two phrases side by side share what stands between them."""
    left = text
    for _ in range(2 if out else 0):
        left = F.regexp_replace(left, any_of(out), " ")
    plainly = _any(hits, single_words(*lists)) | (_any(hits, begins_of_phrases(*lists)) & text.rlike(any_of(*lists)))
    return F.when(_any(hits, first_words(out)), _any(hits, first_words(*lists)) & left.rlike(any_of(*lists))).otherwise(plainly) if out else plainly


DISCLAIMER = ((), (V.NOT_ALCOHOLIC_WORDS,))


def dietary_tags(text: Column) -> Column:
    """CLS1; a disclaimer takes contains_alcohol away."""

    def tags(t: Column, hits: Column) -> Column:
        marks = [F.when(_says(t, hits, *rule) & (~_says(t, hits, *DISCLAIMER) if code == "contains_alcohol" else F.lit(True)), F.lit(code)) for code, rule in TAGS.items()]
        return F.when(F.size(hits) == 0, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*marks)))

    return _read(F.coalesce(text, F.lit("")), [*TAGS.values(), DISCLAIMER], tags)


def flavour_tags(text: Column) -> Column:
    """CLS2"""
    tags = lambda t, hits: F.array_compact(F.array(*(F.when(_says(t, hits, *rule), F.lit(code)) for code, rule in FLAVOURS.items())))
    return _read(F.coalesce(text, F.lit("")), list(FLAVOURS.values()), tags)


def alcohol_kind(category: Column, text: Column) -> Column:
    """CLS3: the first list that speaks, for alcoholic drinks only."""
    kind = _read(text, [(out, lists) for _, out, lists in KINDS], lambda t, hits: F.coalesce(*(F.when(_says(t, hits, out, lists), F.lit(kind)) for kind, out, lists in KINDS)))
    return F.when(category == "alcoholic_beverage", kind)


def is_new(text: Column) -> Column:
    """CLS4: true or null, never false."""
    return F.when(text.rlike(r"(?i)\(\s*new\s*\)") & ~text.rlike(r"(?i)\blegacy item\b"), F.lit(True))


def category_of(section: Column, name: Column, tags: Column) -> Column:
    """CLS5: a drink is what a section of drinks holds, or what ends in the name of one."""
    words = F.filter(words_of(plain(name)), lambda w: w != "")
    # the pattern is tried on names whose last word ends one of a drink
    drink = (section == "beverage") | (F.coalesce(F.try_element_at(words, F.lit(-1)).isin(*LAST_WORDS), F.lit(False)) & plain(name).rlike(DRINK_AT_END))
    return F.when(~drink, section).when(F.array_contains(tags, "contains_alcohol"), "alcoholic_beverage").otherwise("non_alcoholic_beverage")


def consistent_category(category: Column, tags: Column) -> Column:
    """CLS6"""
    return F.when((category == "non_alcoholic_beverage") & F.array_contains(tags, "contains_alcohol"), "alcoholic_beverage").otherwise(category)


def conflict_kind(field: Column, entity: Column) -> Column:
    """CLS7: by null-ness of what the conflict names."""
    return F.when(field.isNotNull(), "field_value").when(entity.isNotNull(), "ambiguous_match").otherwise("missing_parent")
