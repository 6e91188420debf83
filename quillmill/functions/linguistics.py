"""Stemmers, lemmas, token dictionaries and spelling.

Everything here works on single tokens; the corpus operators apply it to the
distinct tokens of a corpus and join the results back.
"""

from __future__ import annotations

import re

VOWELS = "aeiouy"
_DOUBLE = re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")

# Fixed values of the published English stemmer (Porter2): endings and what they become.
STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"),
    ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"),
    ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"),
    ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP3 = (
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""),
)
STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())


def _regions(word: str) -> tuple[int, int]:
    """Starts of R1 and R2: after the first non-vowel that follows a vowel, and once more."""
    starts = []
    at = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    if at is not None:
        starts.append(at)
    while len(starts) < 2:
        m = re.compile(f"[{VOWELS}][^{VOWELS}]").search(word, starts[-1] if starts else 0)
        starts.append(m.end() if m else len(word))
    return starts[0], starts[1]


def _short_end(word: str) -> bool:
    return bool(re.search(f"(?:[^{VOWELS}][{VOWELS}][^{VOWELS}wxY]|^[{VOWELS}][^{VOWELS}])$", word))


def stem_english(token: str) -> str:
    """The Porter2 stem of a token, lower-cased; ASCII punctuation around it is trimmed."""
    w = token.strip("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~ ").lower().replace("’", "'")
    if len(w) <= 2:
        return w
    w = w.removeprefix("'")
    if w in EXCEPTIONS:
        return EXCEPTIONS[w]
    w = re.sub(f"(^|[{VOWELS}])y", r"\1Y", w)
    r1, r2 = _regions(w)
    w = re.sub("('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{VOWELS}]", w[:-2]):
        w = w[:-1]
    if w in KEPT_AFTER_1A:
        return w
    if m := re.search("(eed|eedly)$", w):
        w = w[: m.start()] + "ee" if m.start() >= r1 else w
    elif (m := re.search("(ed|edly|ing|ingly)$", w)) and re.search(f"[{VOWELS}]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _DOUBLE.search(w):
            w = w[:-1]
        elif _short_end(w) and r1 >= len(w):
            w += "e"
    if re.search(f".[^{VOWELS}][yY]$", w):
        w = w[:-1] + "i"
    for end, by in STEP2:
        if w.endswith(end):
            at = len(w) - len(end)
            fine = {"ogi": w[at - 1 : at] == "l", "li": w[at - 1 : at] in "cdeghkmnrt" and at > 0}.get(end, True)
            if at >= r1 and fine:
                w = w[:at] + by
            break
    for end, by in STEP3:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= (r2 if end == "ative" else r1):
                w = w[:at] + by
            break
    for end in STEP4:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and (end != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


# Fixed values of the published German stemmer (CISTEM): letter groups that count as one, as masks.
GERMAN_MASKS = (("sch", "$"), ("ei", "%"), ("ie", "&"))


def stem_german(token: str) -> str:
    """The CISTEM stem of a token: prefix ge- off, then endings by length."""
    w = token.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ ")
    w = w.lower().translate(str.maketrans("äöü", "aou")).replace("ß", "ss")
    if len(w) >= 6 and w.startswith("ge"):
        w = w[2:]
    for group, mask in GERMAN_MASKS:
        w = w.replace(group, mask)
    w = re.sub(r"(.)\1", r"\1*", w)
    while len(w) > 3:
        if len(w) > 5 and (cut := re.sub("(em|er|nd)$", "", w)) != w or (cut := re.sub("t$", "", w)) != w or (cut := re.sub("[esn]$", "", w)) != w:
            w = cut
        else:
            break
    w = re.sub(r"(.)\*", r"\1\1", w)
    for group, mask in GERMAN_MASKS:
        w = w.replace(mask, group)
    return w


def trim_token(token: str, prefixes: list[str], suffixes: list[str]) -> str:
    """Takes dictionary prefixes, then suffixes off, shortest first and again, but never the whole token."""
    for ends, front in ((prefixes, True), (suffixes, False)):
        again = True
        while again:
            again = False
            for e in sorted(ends, key=lambda e: (len(e), e)):
                if e and len(e) < len(token) and (token.startswith(e) if front else token.endswith(e)):
                    token = token[len(e) :] if front else token[: -len(e)]
                    again = True
                    break
    return token


def edits(word: str) -> set[str]:
    """Words one deletion, transposition, replacement or insertion away (a to z)."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1}
    return out | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}


def correct(token: str, counts: dict[str, int]) -> str:
    """The most frequent known word one edit away, if the token isn't known itself."""
    if token in counts or token.lower() in counts:
        return token
    found = [w for w in edits(token.lower()) if w in counts]
    return min(found, key=lambda w: (-counts[w], w)) if found else token
