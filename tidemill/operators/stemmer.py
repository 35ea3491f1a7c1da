"""English suffix stripping after the published Porter2 (Snowball English) rules."""

from __future__ import annotations

VOWELS = set("aeiouy")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = set("cdeghkmnrt")
# Fixed values of the published algorithm: irregular words, and suffix replacements of steps 2 and 3.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al",
    "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def regions(w: str) -> tuple[int, int]:
    """Starts of R1 and R2."""

    def after(i: int) -> int:
        while i < len(w) and w[i] not in VOWELS:
            i += 1
        while i < len(w) and w[i] in VOWELS:
            i += 1
        return min(i + 1, len(w))

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def has_vowel(s: str) -> bool:
    return any(c in VOWELS for c in s)


def ends_short(w: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-3] not in VOWELS and w[-2] in VOWELS and w[-1] not in VOWELS and w[-1] not in "wxY"


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    w = word.lstrip("'")
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in VOWELS) else c for i, c in enumerate(w))
    r1, r2 = regions(w)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and has_vowel(w[:-2]):
        w = w[:-1]
    if w in KEPT_AFTER_1A:
        return w
    cut = next((s for s in ("eedly", "ingly", "edly", "eed", "ing", "ed") if w.endswith(s)), None)
    if cut in ("eed", "eedly"):
        if len(w) - len(cut) >= r1:
            w = w[: -len(cut)] + "ee"
    elif cut and has_vowel(w[: -len(cut)]):
        w = w[: -len(cut)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and ends_short(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    s = next((s for s in STEP2 if w.endswith(s)), None)
    if s:
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + STEP2[s]
    elif w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
        w = w[:-1]
    elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in LI_ENDINGS:
        w = w[:-2]
    s = next((s for s in STEP3 if w.endswith(s)), None)
    if s:
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + STEP3[s]
    elif w.endswith("ative") and len(w) - 5 >= r2:
        w = w[:-5]
    s = next((s for s in STEP4 if w.endswith(s)), None)
    if s:
        if len(w) - len(s) >= r2:
            w = w[: -len(s)]
    elif w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
        w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not ends_short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
