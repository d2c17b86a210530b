"""Base forms of English nouns, verbs and compared adjectives, by their endings: no dictionary, so a word's kind is told by its form alone.

A form in -ing or -ed is taken for a verb's; what is left of it gets back the e it lost, or loses the consonant it doubled, by how it
ends. What no ending tells stands in the tables below.
"""

from __future__ import annotations

import re

# Forms that no ending gives away.
NOUNS = {
    "axes": "axis", "caches": "cache", "children": "child", "cookies": "cookie", "crises": "crisis", "criteria": "criterion", "data": "datum", "feet": "foot", "geese": "goose", "halves": "half",
    "indices": "index", "knives": "knife", "leaves": "leaf", "lives": "life", "matrices": "matrix", "men": "man", "mice": "mouse", "movies": "movie", "people": "person", "phenomena": "phenomenon",
    "quizzes": "quiz", "selves": "self", "shelves": "shelf", "shoes": "shoe", "teeth": "tooth", "vertices": "vertex", "wolves": "wolf", "women": "woman",
}
VERBS = {
    "ate": "eat", "became": "become", "began": "begin", "begun": "begin", "bought": "buy", "broke": "break", "broken": "break", "brought": "bring", "built": "build", "came": "come", "caught": "catch",
    "chose": "choose", "chosen": "choose", "dealt": "deal", "drawn": "draw", "drew": "draw", "driven": "drive", "drove": "drive", "eaten": "eat", "fallen": "fall", "fell": "fall", "felt": "feel",
    "flew": "fly", "flown": "fly", "forgot": "forget", "forgotten": "forget", "found": "find", "gave": "give", "given": "give", "goes": "go", "gone": "go", "grew": "grow", "grown": "grow", "held": "hold",
    "hidden": "hide", "kept": "keep", "knew": "know", "known": "know", "led": "lead", "lost": "lose", "made": "make", "meant": "mean", "met": "meet", "paid": "pay", "ran": "run", "said": "say", "sang": "sing",
    "sat": "sit", "seen": "see", "sent": "send", "shown": "show", "sold": "sell", "sought": "seek", "spent": "spend", "spoke": "speak", "spoken": "speak", "stood": "stand", "swam": "swim", "taken": "take",
    "taught": "teach", "thought": "think", "threw": "throw", "thrown": "throw", "told": "tell", "took": "take", "understood": "understand", "went": "go", "won": "win", "wore": "wear", "worn": "wear",
    "written": "write", "wrote": "write", "agreed": "agree", "dying": "die", "freed": "free", "guaranteed": "guarantee", "lying": "lie", "tying": "tie",
}
ADJECTIVES = {"best": "good", "better": "good", "worse": "bad", "worst": "bad", "farther": "far", "further": "far"}
# Words that only look inflected, and adjectives short enough to be compared by an ending.
AS_THEY_ARE = frozenset(
    "alias always atlas bias canvas economics gas lens linguistics mathematics mechanics news perhaps physics semantics series species statistics "
    "anything ceiling during evening everything morning nothing sibling something "
    "bed embed exceed hundred indeed naked need proceed red sacred seed shed sled speed succeed wicked".split()
)
COMPARED = frozenset("big bright broad cheap clean clear close cold dark deep early easy fast few fine great happy hard heavy high hot large late light long loud low narrow near new nice old poor quick rich safe sharp short simple slow small soft strong sweet tall thick thin warm weak wide young".split())

_VOWELS = "aeiouy"
_ONE_BEAT = re.compile(r"(?:qu|[^aeiou])*[aeiouy][^aeiouwxy]")  # one vowel between consonants: it would have doubled the last one, had it not lost an e
_US = re.compile(r"(?:re|ab|mis|ex|acc|conf|f|m|ref|diff|inf|per)?use")
# Endings, after a consonant unless they name their own vowels, that are left where an e was lost ...
_LOST_E = re.compile(
    r"(?:[csuvz]|[^n]g|(?:ch|[^b]r)ang|leng|veng|plung|cach|[^aeiourwlm][lr]|(?:[^aeiouy]|qu)(?:at|ut|il|ul|ir|ar|ur|in|um|am|ib|id|od|ud|ad|ak|ok|ap|yp)|creat|[iu]at|guid|\b[ptw]ast|rout|writ|[^aeiou]cit|vit|gnit|\bunit|delet|plet|mpet|emot|romot|enot|quot"
    r"|consol|scal|stor|plor|gnor|scor|interfer|adher|postpon|com|clos|ced|persed)\Z"
)
# ... and those that look like them and lost none.
_LOST_NONE = re.compile(r"(?:(?<!ac)(?<!ex)cus|bias|canvas|sync|combat|audit|begin|origin|margin|custom|volum|(?<![qg])(?!ua|ia)[aeiou]{2}[^aeiouscvzg]|eg|fulfil)\Z")
_KEEPS_DOUBLE = re.compile(r"(?:[^aeiou]*[aeiou]ll|[aeiou]([^l])\1|.*(?:ss|ff|zz|(?<!n)(?<!qu)(?<!ot)[aiu]ll|(?<!cont)roll|spell))")


def _vowel(text: str) -> bool:
    return any(c in _VOWELS for c in text)


def base(stem: str) -> str:
    """The verb that is left of a form when -ing or -ed is taken away."""
    if len(stem) > 2 and stem[-1] == stem[-2] and stem[-1] not in "eo":
        return stem if _KEEPS_DOUBLE.fullmatch(stem) else stem[:-1]
    if stem.endswith("e") or (_LOST_NONE.search(stem) and not stem.endswith(("creat", "rout"))):
        return stem
    return stem + "e" if _ONE_BEAT.fullmatch(stem) or _LOST_E.search(stem) else stem


def _without_s(word: str) -> str:
    if word.endswith(("yses", "theses")):
        return word[:-2] + "is"
    if word.endswith("ies"):
        return word[:-3] + "y" if len(word) > 4 else word[:-1]
    if word.endswith("uses") and len(word) > 4 and word[-5] not in "aeiou" and not _US.fullmatch(word[:-1]):
        return word[:-2]
    if len(word) > 4 and (word.endswith(("sses", "shes", "ches", "xes", "oes")) or word in ("biases", "buses", "gases", "aliases", "canvases")):
        return word[:-2]
    if len(word) > 3 and word.endswith("s") and not word.endswith(("ss", "us", "is")):
        return word[:-1]
    return word


def lemma(word: str) -> str:
    """The base form of a lower-case English word; words of no known form stay as they are."""
    for table in (NOUNS, VERBS, ADJECTIVES):
        if word in table:
            return table[word]
    if word in AS_THEY_ARE:
        return word
    if word.endswith("s"):
        return _without_s(word)
    if word.endswith("ing") and len(word) > 4 and _vowel(word[:-3]):
        return base(word[:-3])
    if word.endswith("ied"):
        return word[:-3] + "y" if len(word) > 4 else word[:-1]
    if word.endswith("ed") and not word.endswith("eed") and len(word) > 3 and _vowel(word[:-2]):
        return base(word[:-2])
    for ending in ("er", "est"):
        if word.endswith(ending):
            stem = word[: -len(ending)]
            for found in (stem, stem + "e", stem[:-1], stem[:-1] + "y"):
                if found in COMPARED:
                    return found
    return word
