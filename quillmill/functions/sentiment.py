"""Rule-based sentence sentiment after Hutto and Gilbert (2014).

A lexicon gives the valence of words; boosters, negations, capitals, "but",
"least" and a few idioms change it. Punctuation does not amplify, and "no"
before a word of the lexicon keeps that word's valence.
"""

from __future__ import annotations

import string
from dataclasses import dataclass, field
from math import sqrt

ALPHA = 15.0
BOOST = 0.293
CAPS = 0.733
NEGATE = -0.74

# Words that strengthen or weaken, that negate, and idioms with a valence of their own.
STRENGTHEN = frozenset(
    "absolutely amazingly awfully completely considerable considerably decidedly deeply effing enormous enormously entirely especially "
    "exceptional exceptionally extreme extremely fabulously flipping flippin frackin fracking fricking frickin frigging friggin fully "
    "fuckin fucking fuggin fugging greatly hella highly hugely incredible incredibly intensely major majorly more most particularly "
    "purely quite really remarkably so substantially thoroughly total totally tremendous tremendously uber unbelievably unusually utter "
    "utterly very".split()
)
WEAKEN = frozenset(
    "almost barely hardly kinda kindof kind-of less little marginal marginally occasional occasionally partly scarce scarcely slight "
    "slightly somewhat sorta sortof sort-of".split()
)
WEAKEN_PHRASES = frozenset({"just enough", "kind of", "sort of"})
NEGATIONS = frozenset(
    "aint arent cannot cant couldnt darent didnt doesnt dont hadnt hasnt havent isnt mightnt mustnt neither neednt never none nope "
    "nor not nothing nowhere oughtnt rarely seldom shant shouldnt uhuh wasnt werent without wont wouldnt despite".split()
)
IDIOMS = {
    "the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "badass": 1.5, "bus stop": 0.0, "yeah right": -2.0, "kiss of death": -1.5,
    "to die for": 3.0, "beating heart": 3.1, "broken heart": -2.9,
}

# A small lexicon of our own, on the scale from -4 to 4; a full one is read from a file.
LEXICON = {
    "good": 1.9, "great": 3.1, "excellent": 2.7, "happy": 2.7, "love": 3.2, "like": 1.5, "best": 3.2, "better": 1.9, "nice": 1.8,
    "win": 2.8, "hope": 1.9, "fine": 0.8, "safe": 1.9, "free": 2.3, "friend": 2.2, "trust": 2.3, "bad": -2.5, "worse": -2.1,
    "worst": -3.1, "sad": -2.1, "hate": -2.7, "fear": -2.2, "angry": -2.3, "fail": -2.5, "loss": -1.3, "pain": -2.3, "war": -2.9,
    "kill": -3.7, "danger": -2.4, "wrong": -2.1, "problem": -1.7, "crisis": -3.1, "no": -1.2,
}


@dataclass
class Scorer:
    """Scores tokenised sentences with a lexicon and an emoji dictionary."""

    lexicon: dict[str, float] = field(default_factory=lambda: dict(LEXICON))
    emojis: dict[str, str] = field(default_factory=dict)

    def words(self, tokens: list[str]) -> list[str]:
        out: list[str] = []
        for t in tokens:
            bare = t.strip(string.punctuation + string.whitespace + "\0\x7f") or t
            out += self.emojis[bare].split() if bare in self.emojis else [bare]
        return out

    def score(self, tokens: list[str]) -> dict[str, float]:
        """compound in [-1, 1] and the shares pos, neg and neu."""
        words = self.words(tokens)
        upper = [w.upper() == w and w.lower() != w for w in words]
        mixed = 0 < sum(upper) < len(words)
        low = [w.lower() for w in words]
        values = [self._valence(low, i, mixed and upper[i], mixed, upper) for i in range(len(low))]
        if "but" in low:
            at = low.index("but")
            values = [v * (0.5 if i < at else 1.5 if i > at else 1.0) for i, v in enumerate(values)]
        return summary(values)

    def _valence(self, low: list[str], i: int, caps: bool, mixed: bool, upper: list[bool]) -> float:
        w = low[i]
        if w in STRENGTHEN or w in WEAKEN or (w == "kind" and low[i + 1 : i + 2] == ["of"]) or w not in self.lexicon:
            return 0.0
        value = self.lexicon[w]
        if w == "no" and i + 1 < len(low) and low[i + 1] in self.lexicon:
            return 0.0
        if caps:
            value += CAPS if value > 0 else -CAPS
        for back in (1, 2, 3):
            if i < back or low[i - back] in self.lexicon:
                continue
            value += self._boost(low[i - back], value, mixed and upper[i - back])
            value = self._negated(low, i, back, value)
            if back == 3:
                value = self._idiom(low, i, value)
        if i > 0 and low[i - 1] == "least" and "least" not in self.lexicon and (i < 2 or low[i - 2] not in ("at", "very")):
            value *= NEGATE
        return value

    @staticmethod
    def _boost(word: str, value: float, caps: bool) -> float:
        size = BOOST if word in STRENGTHEN else -BOOST if word in WEAKEN else 0.0
        if not size:
            return 0.0
        size = size if value > 0 else -size
        return size + (CAPS if value > 0 else -CAPS) * caps

    @staticmethod
    def _negated(low: list[str], i: int, back: int, value: float) -> float:
        word = low[i - back].replace("'", "").replace("’", "")
        if back > 1 and low[i - back] == "never" and {"so", "this"} & set(low[i - back + 1 : i]):
            return value * 1.25
        if back > 1 and low[i - back] == "without" and "doubt" in low[i - back + 1 : i]:
            return value
        return value * NEGATE if word in NEGATIONS or (low[i - back].endswith("n't")) else value

    @staticmethod
    def _idiom(low: list[str], i: int, value: float) -> float:
        for size in (2, 3):
            for start in range(max(0, i - size), i + 1):
                text = " ".join(low[start : start + size])
                if text in IDIOMS and start + size <= len(low):
                    return Scorer._weakened(low, i, IDIOMS[text])
        return Scorer._weakened(low, i, value)

    @staticmethod
    def _weakened(low: list[str], i: int, value: float) -> float:
        """Less BOOST for each phrase that weakens, right before the word or one word further."""
        return value - BOOST * sum(" ".join(low[i - k : i - k + 2]) in WEAKEN_PHRASES for k in (3, 2))


def summary(values: list[float]) -> dict[str, float]:
    total = sum(values)
    compound = max(-1.0, min(1.0, total / sqrt(total * total + ALPHA)))
    pos = sum(v + 1 for v in values if v > 0)
    neg = sum(v - 1 for v in values if v < 0)
    neu = sum(v == 0 for v in values)
    whole = pos - neg + neu
    share = (lambda x: abs(x) / whole) if whole else (lambda x: 0.0)
    return {"compound": compound, "pos": share(pos), "neg": share(neg), "neu": share(neu)}
