"""Text of places: keys, title case, display names."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters without a canonical decomposition that are folded to a base letter all the same, pair by pair.
UNDECOMPOSED, THEIR_BASE = "đøł", "dol"


def _decomposed() -> dict[str, str]:
    """Each letter that has a canonical decomposition and no lower-case form of its own, with what it is without Latin accents."""
    letters = (chr(c) for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    plain = lambda c: "".join(x for x in unicodedata.normalize("NFD", c) if not "\u0300" <= x <= "\u036f").translate(str.maketrans(UNDECOMPOSED, THEIR_BASE))
    return {c: plain(c) for c in letters if unicodedata.category(c)[0] == "L" and c.lower() == c and unicodedata.normalize("NFD", c) != c}


_FORMS = _decomposed()
_ONE = {c: form for c, form in _FORMS.items() if len(form) == 1}
#: Letters of scripts whose marks stay: one letter is several in the other form. So is a Hangul syllable, by its number.
_SEVERAL = {c: form for c, form in _FORMS.items() if len(form) > 1 and not "\uac00" <= c <= "\ud7a3"}
ACCENTED = "".join(_ONE) + UNDECOMPOSED
BASE = "".join(_ONE.values()) + THEIR_BASE


def _class_of(letters: Iterable[str]) -> str:
    """Regular expression of one of these letters. A class is tried range by range, so neighbours are one, and letters before the first are turned away at once."""
    runs: list[list[int]] = []
    for c in sorted(map(ord, letters)):
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return f"[{chr(runs[0][0])}-{chr(runs[-1][1])}&&[{''.join(chr(a) if a == b else f'{chr(a)}-{chr(b)}' for a, b in runs)}]]"


COMPOSED = _class_of([*_SEVERAL, *map(chr, range(0xAC00, 0xD7A4))])
PARTS = max(map(len, _SEVERAL.values()))


# Accents that are characters of their own go like those that are part of a letter; the marks of other scripts stay.
DROPPED = r"[.'’`\"\u0300-\u036F]"
DROPPED_LETTERS = ".'’`\"" + "".join(map(chr, range(0x300, 0x370)))
BLANKED = r"[^\p{L}\p{M}\p{N},*#_&/-]+"

# A letter run with the possessive or contraction tails that stay lower case, or a run of anything else.
CASE_RUNS = r"(\p{L}+(?:(?<=\p{L}[a-zA-Z])'[A-Za-z]\p{L}*)*|\P{L}+)"


def _nth_part(letter: Column, nth: int) -> Column:
    """The ``nth`` character of a composed letter's other form, an empty text where it has fewer."""
    having = [c for c, form in _SEVERAL.items() if len(form) > nth]
    lacking = [c for c, form in _SEVERAL.items() if len(form) <= nth]
    return F.translate(letter, "".join(having + lacking), "".join(_SEVERAL[c][nth] for c in having))


def _syllable(letter: Column) -> Column:
    """The two or three letters of a Hangul syllable: 19 firsts of 21 middles of 27 lasts or none."""
    nth = F.ascii(letter) - 0xAC00
    one = lambda first, count, n: F.substring(F.lit("".join(map(chr, range(first, first + count)))), n.cast("int") + 1, F.lit(1))
    last = nth % 28
    return F.concat(one(0x1100, 19, F.floor(nth / 588)), one(0x1161, 21, F.floor(nth % 588 / 28)), F.when(last > 0, one(0x11A8, 27, last - 1)).otherwise(""))


def decomposed(text: Column) -> Column:
    """Letters that are several in their other form written in that form. Texts without such letters cost one search."""
    letters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    spelt = F.transform(letters, lambda c: F.when(c.between("\uac00", "\ud7a3"), _syllable(c)).when(
        _nth_part(c, 0) != c, F.concat(*[_nth_part(c, n) for n in range(PARTS)])).otherwise(c))
    return F.when(F.rlike(text, F.lit(COMPOSED)), F.array_join(spelt, "")).otherwise(text)


def cleaned(text: Column) -> Column:
    """Lower-case text without accents and full stops, any run of other characters a blank: what both forms of a key are made from."""
    lower = F.lower(text)
    folded = F.translate(decomposed(lower), ACCENTED + DROPPED_LETTERS, BASE)  # accents and full stops go in the same pass
    t = F.when(F.octet_length(text) == F.length(text), F.regexp_replace(lower, DROPPED, "")).otherwise(folded)  # ASCII needs no folding
    return F.regexp_replace(t, BLANKED, " ")


def key_of(clean: Column, remove_commas: bool = False) -> Column:
    """Key text from what :func:`cleaned` gives."""
    if remove_commas:
        return F.trim(F.regexp_replace(clean, "[ ,]+", " "))
    return F.trim(F.regexp_replace(clean, " *, *", ","))


def normalize(text: Column, remove_commas: bool = False) -> Column:
    """Canonical key text: lower case, no accents or full stops, single blanks, commas kept unless asked otherwise.

    A letter gives the same key whether it is one character or a base letter with marks after it. Where both forms of a long text are
    wanted, let a column hold :func:`cleaned` and take :func:`key_of` of it twice: Spark works shared texts out once for each form.
    """
    return key_of(cleaned(text), remove_commas)


def capwords(text: Column) -> Column:
    """Title case in which the letter after an apostrophe inside a word stays lower case."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(CASE_RUNS), F.lit(1)), F.initcap), "")


def strip_ends(text: Column) -> Column:
    """Blanks and commas off both ends."""
    return F.btrim(text, F.lit(", "))


def blank_to_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def long_name(city: Column, admin2: Column, admin1: Column, country: Column) -> Column:
    """Display name, narrowest part first, missing parts left out."""
    return F.concat_ws(", ", *[blank_to_null(part) for part in (city, admin2, admin1, country)])


def apply_rules(text: Column, rules: Column) -> Column:
    """Literal replacements in list order; ``rules`` is an array of (seq, orig, repl)."""
    return F.aggregate(rules, text, lambda done, rule: F.replace(done, rule["orig"], rule["repl"]))


def output_text(prefix: Column, name: Column) -> Column:
    """What is written back: title-cased prefix, a comma if there is one, the display name, ends stripped."""
    lead = F.when(F.length(prefix) > 0, F.concat(capwords(prefix), F.lit(","))).otherwise("")
    return strip_ends(F.concat(lead, name))


def part_from_end(text: Column, position: int) -> Column:
    """The comma-separated part at ``position`` from the end, untrimmed; null when there are fewer parts."""
    return F.try_element_at(F.split(text, ","), F.lit(-position))


def city_part(text: Column) -> Column:
    return part_from_end(text, 4)


def prefix_part(text: Column) -> Column:
    return part_from_end(text, 5)


def words(text: Column) -> Column:
    """Distinct blank-separated words of a normalised text."""
    return F.array_distinct(F.filter(F.split(text, " "), lambda w: w != ""))
