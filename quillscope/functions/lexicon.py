"""Closed-class word lexicon and noun rules.

A statistical part-of-speech tagger is a per-row library and is not available
offline, so the part-of-speech features are re-aimed: function words
(determiners, pronouns, adpositions, auxiliaries, coordinating and subordinating
conjunctions, particles) are closed classes and come from a fixed lexicon; nouns
come from a suffix rule plus capitalised tokens that do not start a sentence.
"""

from __future__ import annotations

# --- fixed values: English closed-class words by part of speech (lower case) ---
DETERMINERS = (
    "a an the this that these those each every either neither some any no all both "
    "half several many much few fewer little less more most such what which whatever "
    "whichever another other my your his her its our their whose"
)
PRONOUNS = (
    "i me mine myself you yours yourself yourselves he him himself she hers herself "
    "it itself we us ours ourselves they them theirs themselves who whom whoever "
    "whomever someone somebody something anyone anybody anything everyone everybody "
    "everything nobody nothing one oneself"
)
ADPOSITIONS = (
    "about above across after against along amid among around as at before behind "
    "below beneath beside besides between beyond by despite down during except for "
    "from in inside into like near of off on onto out outside over past per since "
    "through throughout till to toward towards under underneath unlike until up upon "
    "via with within without"
)
AUXILIARIES = (
    "am is are was were be been being have has had having do does did can could may "
    "might must shall should will would ought"
)
COORDINATORS = "and but or nor yet so"
SUBORDINATORS = (
    "although because if unless whereas whether while though once than that lest "
    "provided"
)
PARTICLES = "not n't 's to"
# noun-forming suffixes (a token ending in one of these, optionally plural, is a noun)
NOUN_SUFFIXES = "tion sion ment ness ity ism ist ance ence ship hood dom ure age ery ogy"
# tokens that end a sentence (a capitalised token after one of these is not a proper noun)
SENTENCE_END_TOKENS = ". ! ? …"
# --- end of fixed values ---

POS_GROUPS = {
    "DET": DETERMINERS,
    "PRON": PRONOUNS,
    "ADP": ADPOSITIONS,
    "AUX": AUXILIARIES,
    "CCONJ": COORDINATORS,
    "SCONJ": SUBORDINATORS,
    "PART": PARTICLES,
}


def function_words() -> list[str]:
    """Sorted distinct function words over all closed classes."""
    words: set[str] = set()
    for group in POS_GROUPS.values():
        words.update(group.split())
    return sorted(words)


def lexicon_rows() -> list[tuple[str, str]]:
    """(token, pos) rows; a word in several classes keeps its first class in POS_GROUPS order."""
    seen: dict[str, str] = {}
    for pos, group in POS_GROUPS.items():
        for w in group.split():
            seen.setdefault(w, pos)
    return sorted(seen.items())


# shortest token the suffix rule can match: two letters + the shortest suffix
MIN_NOUN_SUFFIX_LEN = 2 + min(len(x) for x in NOUN_SUFFIXES.split())


def noun_suffix_regex() -> str:
    alts = "|".join(NOUN_SUFFIXES.split())
    return r"^[\p{L}\p{M}]{2,}(" + alts + r")s?$"


def sentence_end_tokens() -> list[str]:
    return SENTENCE_END_TOKENS.split()
