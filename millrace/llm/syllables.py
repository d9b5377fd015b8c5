"""Syllables of English words by hyphenation-style patterns.

A word has as many syllables as spoken vowel groups. Where neighbouring vowels are spoken apart (li-on, i-de-a) or together
(na-tion, peo-ple) is told by patterns in the notation that hyphenation programs use: a number between two letters holds
there, the highest of all that match wins, an odd one divides, an even one forbids it, a dot is the edge of the word. Which
e at or near the end is silent is told by rules on what is around it.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: Vowels spoken apart (odd) or together (even).
PATTERNS = """
i1a i1o i1u i1i u1a e1o u1u
ti2a ti3at ci2a ci3at si2a si3as xi2a gi2a .gi3a hi2a
ti2o si2o ci2o gi2o xi2o hi2on ni2on ni2or lli2on .li3o vi2or lli2a eli2or
ri2ag mili2ar culi2ar li2ame di2er. pi2er. .pli3er ci2ou ti2ou gi2ou xi2ou ti2u .ti3u
i1et i1ety i1ent i1ence i1ency ti2ent ci2ent ti2enc ci2enc i1en. sci3enc sci3ent nsci4en .cli3en
i1er. i1ers. i1est. i1ern .pi2er .ti2er .pri2es shi2er nti2er. ldi2er i1eti vi2et. .qwi3et
pe2opl le2op ge2on ge2or ge2ou te2ou ye2o je2op
cre1at cre2atu re1al re2al. re2ally re2alm ide1a are1a. ore1a. ne1ar. .ne2ar cle1ar. .cle2ar the1at pe1an. be1an. .be2an le1an. .le2an .cle2an me1ab le1ab re1act re1ap re1as. ncre1as.
e1ity e1ing be1it. re1inf re1inv re1ins re1int e1ist. e1um. pe2um
gu2a su2ad .sua2 .gu2a u1el. u1et. u1en u1ou gu2en
u1id u1in gu2i bu2i u1ity gu3ity u1itio tu1it ru2in. .ru3in u1ic ju2ic su2it ru2it cu2it
co1ale co1ali o1asis .bo1a. co1ag po1e co1ex co1ef o1ing o1ic. o1ics o1ical o1ev .do2es co1op co1ord zo1ol
a1os. a1or a1ic. na1iv a1ism e1ism o1ism
re1el re1ent re1ex pre1em pre1ex re1ev .re1en .re2el.
y1i ery1o y1er. y1ers. wy2er ay2e ue2t
""".split()

_LETTERS = re.compile(r"[^a-z]")
_VOWELS = frozenset("aeiouy")
#: Second parts of compounds and endings before which the e of the first part is silent.
_SECOND = (
    "ly less lessly lessness ful fully ment ments ness nesses some work works wall walls time times ware house houses thing things where place land body "
    "one how what like line lines man men point points book board guard fore life room way wide wise back day light smith yard"
).split()
_BEFORE = re.compile(r"(?<=[aeiouy][b-df-hj-np-tv-xz])e(?=(?:" + "|".join(_SECOND) + r")$)|(?<=[aeiouy]th)e(?=(?:less|ful|ly)$)|(?<=[aeiouy][lrnc][cgsv])e(?=(?:" + "|".join(_SECOND) + ")$)")
_EXCEPT = re.compile(r"^(?:element|elements|basement|cafe|recipe|apostrophe|catastrophe|vegetable)$")


def _compiled(patterns: list[str]) -> dict[str, tuple[int, ...]]:
    out = {}
    for p in patterns:
        letters = re.sub(r"\d", "", p)
        marks = [0] * (len(letters) + 1)
        at = 0
        for c in p:
            if c.isdigit():
                marks[at] = int(c)
            else:
                at += 1
        out[letters] = tuple(marks)
    return out


_COMPILED = _compiled(PATTERNS)
_LONGEST = max(map(len, _COMPILED))


def _divisions(word: str) -> list[int]:
    """The highest mark before each letter of ``.word.``."""
    w = f".{word}."
    marks = [0] * (len(w) + 1)
    for i in range(len(w)):
        for j in range(i + 2, min(i + _LONGEST, len(w)) + 1):
            found = _COMPILED.get(w[i:j])
            if found:
                for k, m in enumerate(found):
                    if m > marks[i + k]:
                        marks[i + k] = m
    return marks


def _silent(w: str) -> set[int]:
    """Positions of letters that look like vowels and aren't spoken."""
    out: set[int] = set()
    n = len(w)
    vowel = lambda i: 0 <= i < n and w[i] in _VOWELS
    syllabic = lambda i: i >= 1 and w[i] == "l" and not vowel(i - 1) and w[i - 1] not in "lrw" or i >= 1 and w[i] == "r" and w[i - 1] in "tcb" and not vowel(i - 1)
    if w.endswith(("gue", "gues")) and n > 4 and not w.startswith("argue"):
        out |= {w.rindex("gue") + 1, w.rindex("gue") + 2}
    elif w.endswith("e") and not vowel(n - 2) and not syllabic(n - 2):
        out.add(n - 1)
    elif w.endswith("es") and n > 3 and not vowel(n - 3) and not syllabic(n - 3) and not (w[n - 3] in "szxcg" or w[n - 4 : n - 2] in ("sh", "ch")):
        out.add(n - 2)
    elif w.endswith("ed") and n > 3 and not vowel(n - 3) and w[n - 3] not in "td" and not (w[n - 3] == "l" and syllabic(n - 3)) and not w.endswith(("dred", "cred", "naked", "wicked")):
        out.add(n - 2)
    if w not in ("element", "elements") and not _EXCEPT.match(w):
        out |= {m.start() for m in _BEFORE.finditer(w)}
    out |= {at for start, at in (("busine", 3), ("every", 2), ("evening", 2)) if w.startswith(start)}
    out |= {len(first) - 1 for first in ("some", "there", "where") if w.startswith(first) and n > len(first)}
    return out


def _part(word: str) -> int:
    w = word.replace("qu", "qw")
    if len(w) <= 2:
        return 1
    letters = list(w)
    for i, c in enumerate(w):
        # y before a vowel is a consonant at the beginning of a word or between vowels
        if c == "y" and i + 1 < len(w) and w[i + 1] in _VOWELS and (i == 0 or w[i - 1] in _VOWELS) and not w.startswith("eye"):
            letters[i] = "j"
    spoken = "".join(letters)
    silent, marks = _silent(spoken), _divisions(w)
    count, open_group = 0, False
    for i, c in enumerate(spoken):
        if c not in _VOWELS or i in silent:
            open_group = False
        elif not open_group or marks[i + 1] % 2:  # marks count the dot before the word
            count, open_group = count + 1, True
    return max(1, count + w.endswith(("sm", "sms", "thm", "thms")))


@lru_cache(maxsize=200_000)
def syllables(word: str) -> int:
    """Syllables of a word; parts with a hyphen between them count by themselves. At least 1."""
    low = word.lower()
    if not low.isascii():
        low = unicodedata.normalize("NFKD", low)
    total = 0
    for part in low.replace("’", "'").split("-"):
        stem, _, rest = part.partition("'")
        spoken = stem.endswith("n") and rest == "t" and stem[-2:-1] in ("s", "d")  # is-n't, did-n't
        letters = _LETTERS.sub("", stem if rest in ("s", "t", "d", "m", "ll", "re", "ve") else stem + rest)
        if letters:
            total += _part(letters[:-1] if spoken else letters) + spoken
    return max(1, total)
