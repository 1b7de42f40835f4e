"""The interview's state machine as one table, for whole sessions, blocks of turns and streams.

A place in the machine is a number: the state, the language last detected, and which fields have a value. A turn is a number too:
which fields it offers, whether it is ambiguous or confirms, and the language detected. The table gives the next place for
each turn and place, so a block of turns is the map of places that its turns' rows make one after the other, and such maps compose in any grouping.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.extract import FIELDS

STATES = ("greeting", "collecting_info", "clarifying", "validating", "completing")
#: States in which a turn's fields are read.
READS = ("collecting_info", "clarifying")
#: From each state the first move whose condition holds; where none does, the state stays.
MOVES: dict[str, tuple[tuple[str, str], ...]] = {
    "greeting": (("always", "collecting_info"),),
    "collecting_info": (("ambiguous", "clarifying"), ("full", "validating")),
    "clarifying": (("always", "collecting_info"),),
    "validating": (("agreed", "completing"), ("always", "collecting_info")),
    "completing": (),
}
#: No language detected yet, so the session's own holds; then the detected ones.
LANGUAGES = (None, "en", "ar")
MASKS = 1 << len(FIELDS)
PLACES = len(STATES) * len(LANGUAGES) * MASKS
KINDS = MASKS * 8 * len(LANGUAGES)
START = 0
#: Where a session begins anew once its context was dropped: its language is English.
ANEW = MASKS


def kind() -> Column:
    """The number of a turn from its features."""
    bits = [F.col(f).isNotNull() for f in FIELDS] + [F.coalesce(c, F.lit(False)) for c in ("ambiguous", "confirmed_en", "confirmed_ar")]
    out = sum((F.when(b, 1 << at).otherwise(0) for at, b in enumerate(bits)), F.lit(0))
    return out + F.when(F.col("detected") == "en", 8 * MASKS).when(F.col("detected") == "ar", 16 * MASKS).otherwise(0)


@cache
def table(language: str = "en", restart: bool = False) -> np.ndarray:
    """The next place for each turn (row) and place. With ``restart`` a turn after the completing one begins a new interview."""
    turn, place = np.arange(KINDS)[:, None], np.arange(PLACES)[None]
    state, lang, mask = place // (MASKS * len(LANGUAGES)), place // MASKS % len(LANGUAGES), place % MASKS
    offered, flags, heard = turn % MASKS, turn // MASKS % 8, turn // MASKS // 8
    if restart:
        state, lang, mask = (np.where(state == STATES.index("completing"), new, old) for new, old in ((0, state), (1, lang), (0, mask)))
    lang = np.where(heard > 0, heard, lang)
    mask = np.where(np.isin(state, [STATES.index(s) for s in READS]), mask | offered, mask)
    arabic = (lang == 2) | ((lang == 0) & (language == "ar"))
    conditions = {
        "always": np.ones_like(mask, bool), "ambiguous": flags % 2 == 1, "full": mask == MASKS - 1,
        "agreed": np.where(arabic, flags // 4, flags // 2 % 2) == 1,
    }
    after = state + 0 * turn
    for at, name in enumerate(STATES):
        open_ = np.broadcast_to(state == at, after.shape).copy()
        for condition, to in MOVES[name]:
            hit = open_ & conditions[condition]
            after[hit] = STATES.index(to)
            open_ &= ~hit
    return ((after * len(LANGUAGES) + lang) * MASKS + mask).astype(np.int16)


def state_of(place: int) -> str:
    return STATES[place // (MASKS * len(LANGUAGES))]


def language_of(place: int, language: str) -> str:
    return LANGUAGES[place // MASKS % len(LANGUAGES)] or language


def mapped(kinds: list[int], language: str, restart: bool) -> np.ndarray:
    """The place after these turns for every place before them."""
    moves, places = table(language, restart), np.arange(PLACES, dtype=np.int16)
    for k in kinds:
        places = moves[k][places]
    return places


def step(place: int, values: list, turn: int, offered: list, language: str, restart: bool) -> tuple[int, list]:
    """The place and the fields' values after a turn; first values win."""
    fresh = restart and state_of(place) == "completing"
    after = int(table(language, restart)[turn, place])
    had = 0 if fresh else place % MASKS
    new = after % MASKS & ~had
    if fresh:
        values = [None] * len(FIELDS)
    return after, [x if new >> at & 1 else v for at, (v, x) in enumerate(zip(values, offered, strict=True))] if new else values
