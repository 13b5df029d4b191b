"""The two published Snowball stemmers that the search index uses: English (Porter 2) and French."""

from __future__ import annotations

import re
from functools import lru_cache

#: Fixed values of the English stemmer.
_EN_VOWELS = "aeiouy"
_EN_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_EN_IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_EN_AS_IS_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
_EN_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion",
    "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous",
    "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate",
    "alli": "al", "bli": "ble",
}
_EN_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_EN_STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic".split()
#: Fixed values of the French stemmer.
_FR_VOWELS = "aeiouyâàëéêèïîôûù"
_FR_I_VERB = (
    "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant "
    "issante issantes issants isse issent isses issez issiez issions issons it"
).split()
_FR_VERB_KEEP = "ions".split()
_FR_VERB_CUT = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
_FR_VERB_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()


def _ends(word: str, endings, at: int = 0) -> str | None:
    """The longest of some endings that a word has from a place on."""
    found = [e for e in endings if word.endswith(e) and len(word) - len(e) >= at]
    return max(found, key=len) if found else None


def _after_vowel_and_consonant(word: str, vowels: str, start: int = 0) -> int:
    m = re.compile(f"[{vowels}][^{vowels}]").search(word, start)
    return m.end() if m else len(word)


@lru_cache(100_000)
def english(word: str) -> str:
    if len(word) <= 2:
        return word
    w = word.lstrip("'")
    if w in _EN_IRREGULAR:
        return _EN_IRREGULAR[w]
    w = re.sub(f"(^|[{_EN_VOWELS}])y", lambda m: m[1] + "Y", w)
    special = re.match("gener|commun|arsen", w)
    r1 = special.end() if special else _after_vowel_and_consonant(w, _EN_VOWELS)
    r2 = _after_vowel_and_consonant(w, _EN_VOWELS, r1)
    vowel = lambda x: re.search(f"[{_EN_VOWELS}]", x) is not None

    def short(x):
        ends = re.search(f"[^{_EN_VOWELS}][{_EN_VOWELS}][^{_EN_VOWELS}wxY]$", x) or re.fullmatch(f"[{_EN_VOWELS}][^{_EN_VOWELS}]", x)
        return bool(ends) and r1 >= len(x)

    w = re.sub("'s'$|'s$|'$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and vowel(w[:-2]):
        w = w[:-1]
    if w in _EN_AS_IS_1A:
        return w
    if end := _ends(w, ("eedly", "eed")):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif (end := _ends(w, ("ingly", "edly", "ing", "ed"))) and vowel(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_EN_DOUBLES):
            w = w[:-1]
        elif short(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _EN_VOWELS:
        w = w[:-1] + "i"
    end = _ends(w, [*_EN_STEP2, "ogi", "li"])
    if end and len(w) - len(end) >= r1:
        stem = w[: -len(end)]
        if end == "ogi":
            w = w[:-1] if stem.endswith("l") else w
        elif end == "li":
            w = stem if stem[-1:] in tuple("cdeghkmnrt") else w
        else:
            w = stem + _EN_STEP2[end]
    end = _ends(w, [*_EN_STEP3, "ative"])
    if end and len(w) - len(end) >= r1:
        if end != "ative":
            w = w[: -len(end)] + _EN_STEP3[end]
        elif len(w) - len(end) >= r2:
            w = w[: -len(end)]
    end = _ends(w, [*_EN_STEP4, "ion"])
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not short(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@lru_cache(100_000)
def french(word: str) -> str:
    v = _FR_VOWELS
    w = re.sub("qu", "qU", word)
    w = re.sub(f"(?<=[{v}])([ui])(?=[{v}])", lambda m: m[1].upper(), w)
    w = re.sub(f"y(?=[{v}])|(?<=[{v}])y", "Y", w)
    if re.match(f"[{v}]{{2}}|par|col|tap", w):
        rv = 3
    else:
        m = re.search(f"[{v}]", w[1:])
        rv = m.end() + 1 if m else len(w)
    r1 = _after_vowel_and_consonant(w, v)
    r2 = _after_vowel_and_consonant(w, v, r1)
    at = lambda end, place: len(w) - len(end) >= place
    done = suffix_like_verb = False
    start = w

    groups = (
        ("ance iqUe isme able iste eux ances iqUes ismes ables istes", "delete2"), ("atrice ateur ation atrices ateurs ations", "ation"),
        ("logie logies", "log"), ("usion ution usions utions", "u"), ("ence ences", "ent"), ("ement ements", "ement"), ("ité ités", "ite"),
        ("if ive ifs ives", "if"), ("eaux", "eau"), ("aux", "al"), ("euse euses", "eux"), ("issement issements", "issement"),
        ("amment", "ant"), ("emment", "ent_rv"), ("ment ments", "ment"),
    )
    of = {e: rule for endings, rule in groups for e in endings.split()}
    end = _ends(w, of)
    rule = of.get(end)
    if rule:
        stem = w[: -len(end)]
        if rule == "delete2" and at(end, r2):
            w, done = stem, True
        elif rule == "ation" and at(end, r2):
            w, done = stem, True
            if w.endswith("ic"):
                w = w[:-2] if len(w) - 2 >= r2 else w[:-2] + "iqU"
        elif rule == "log" and at(end, r2):
            w, done = stem + "log", True
        elif rule == "u" and at(end, r2):
            w, done = stem + "u", True
        elif rule == "ent" and at(end, r2):
            w, done = stem + "ent", True
        elif rule == "ement" and at(end, rv):
            w, done = stem, True
            if w.endswith("iv") and len(w) - 2 >= r2:
                w = w[:-2]
                if w.endswith("at") and len(w) - 2 >= r2:
                    w = w[:-2]
            elif w.endswith("eus"):
                w = w[:-3] if len(w) - 3 >= r2 else w[:-1] + "x" if len(w) - 3 >= r1 else w
            elif w.endswith(("abl", "iqU")) and len(w) - 3 >= r2:
                w = w[:-3]
            elif w.endswith(("ièr", "Ièr")) and len(w) - 3 >= rv:
                w = w[:-3] + "i"
        elif rule == "ite" and at(end, r2):
            w, done = stem, True
            if w.endswith("abil"):
                w = w[:-4] if len(w) - 4 >= r2 else w[:-4] + "abl"
            elif w.endswith("ic"):
                w = w[:-2] if len(w) - 2 >= r2 else w[:-2] + "iqU"
            elif w.endswith("iv") and len(w) - 2 >= r2:
                w = w[:-2]
        elif rule == "if" and at(end, r2):
            w, done = stem, True
            if w.endswith("at") and len(w) - 2 >= r2:
                w = w[:-2]
                if w.endswith("ic"):
                    w = w[:-2] if len(w) - 2 >= r2 else w[:-2] + "iqU"
        elif rule == "eau":
            w, done = stem + "eau", True
        elif rule == "al" and at(end, r1):
            w, done = stem + "al", True
        elif rule == "eux" and (at(end, r2) or at(end, r1)):
            w, done = stem if at(end, r2) else stem + "eux", True
        elif rule == "issement" and at(end, r1) and stem[-1:] and stem[-1] not in v:
            w, done = stem, True
        elif rule == "ant" and at(end, rv):
            w, done, suffix_like_verb = stem + "ant", True, True
        elif rule == "ent_rv" and at(end, rv):
            w, done, suffix_like_verb = stem + "ent", True, True
        elif rule == "ment" and len(stem) - 1 >= rv and stem[-1] in v:
            w, done, suffix_like_verb = stem, True, True
    if not done or suffix_like_verb:
        end = _ends(w, _FR_I_VERB, rv)
        if end and len(w) - len(end) - 1 >= rv and w[len(w) - len(end) - 1] not in v:
            w = w[: -len(end)]
            done = True
        else:
            end = _ends(w, [*_FR_VERB_KEEP, *_FR_VERB_CUT, *_FR_VERB_A], rv)
            if end in _FR_VERB_KEEP:
                if at(end, r2):
                    w, done = w[: -len(end)], True
            elif end in _FR_VERB_CUT:
                w, done = w[: -len(end)], True
            elif end:
                w, done = w[: -len(end)], True
                if w.endswith("e") and len(w) - 1 >= rv:
                    w = w[:-1]
    if w != start:
        w = w[:-1] + "i" if w.endswith("Y") else w[:-1] + "c" if w.endswith("ç") else w
    else:
        if w.endswith("s") and len(w) > 1 and w[-2] not in "aiouès":
            w = w[:-1]
        if (end := _ends(w, ("ière", "Ière", "ier", "Ier", "ion", "e", "ë"), rv)) is not None:
            if end == "ion":
                w = w[:-3] if len(w) - 3 >= r2 and w[-4:-3] in ("s", "t") and len(w) - 4 >= rv else w
            elif end in ("e",):
                w = w[:-1]
            elif end == "ë":
                w = w[:-1] if w.endswith("guë") else w
            else:
                w = w[: -len(end)] + "i"
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    w = re.sub(f"[éè]([^{v}]+)$", r"e\1", w)
    return w.lower()
