"""Garbled text from wrong character encoding (problem 3).

For every pair (UTF-8 text, single-byte encoding it was wrongly read as) the garbled sequence of each plausible original
character is computed once and put into one multi-pattern automaton. A text is scanned once; only spans of matches are
replaced by their originals, so correct text around them stays as it is. Text garbled more than once is restored by
scanning the result again until nothing matches. Sequences that are ordinary text in their own right count only beside
further evidence. Letters of further scripts count from two in a row on. Replacement characters and C1 controls show wrong
decoding too: the latter are restored where the byte is printable in Windows-1252, the former can't be.

Two kinds of pairs have no sequences of their own and are told by whole words, for which tables are computed once:
text of one single-byte encoding read as another (SINGLE: a word that can't be as it stands, being four or more accented
letters without a plain one, or Cyrillic with its capitals the wrong way round, and that one pair turns into a word of
usual shape, as it does all others of the text); and UTF-8 read as a double-byte encoding (DOUBLE: a run of four or more
characters whose bytes are UTF-8 of one script, or a character between small Latin letters whose bytes are an accented one).

JVM side: only values with two characters beyond ASCII side by side, or with one that shows wrong decoding by itself, can
be garbled; no others reach Python. There is no shuffle. The automata are built once in each Python worker (a fixed
size, from a rule).

Defined results: null and empty values are never garbled; texts of any length are scanned whole; repeated rows give
repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

ENCODINGS = ["cp1252", "latin-1", "cp1250", "cp1251", "cp437", "mac_roman", "cp850", "cp1254", "iso8859-15"]
#: Code points that originals may have, as inclusive ranges.
ORIGINALS = [
    (0x80, 0xFF), (0x100, 0x17F), (0x192, 0x192), (0x1A0, 0x1A1), (0x1AF, 0x1B0), (0x2C6, 0x2DD), (0x300, 0x304), (0x306, 0x30C), (0x31B, 0x31B), (0x323, 0x328),
    (0x386, 0x3CE), (0x401, 0x45F), (0x490, 0x491), (0x1EA0, 0x1EF9), (0x200B, 0x200F), (0x2010, 0x2026), (0x202F, 0x203A),
    (0x20AB, 0x20AC), (0x2116, 0x2116), (0x2122, 0x2122), (0x2190, 0x2193), (0x2200, 0x226B), (0x2500, 0x257F), (0x2588, 0x25CF),
    (0x2600, 0x27BF), (0x3000, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFE0F, 0xFE0F), (0xFEFF, 0xFEFF), (0xFF01, 0xFF5E),
    (0x1F1E6, 0x1F1FF), (0x1F300, 0x1F64F), (0x1F680, 0x1F6FF), (0x1F900, 0x1F9FF),
]
#: Further scripts. Correct text of other scripts has some of their garbled letters by chance (Шёлк, најљепши), so they
#: count from two of a script in a row on.
FURTHER = [
    (0x531, 0x58A), (0x591, 0x5F4), (0x600, 0x6FF), (0x700, 0x77F), (0x780, 0x7B1), (0x900, 0x97F), (0x980, 0x9FE), (0xA01, 0xA76),
    (0xA81, 0xAFF), (0xB01, 0xB77), (0xB82, 0xBFA), (0xC00, 0xC7F), (0xC80, 0xCF2), (0xD00, 0xD7F), (0xD81, 0xDF4), (0xE01, 0xE5B),
    (0xE81, 0xEDF), (0xF00, 0xFDA), (0x1000, 0x109F), (0x10A0, 0x10FF), (0x1200, 0x139F), (0x13A0, 0x13FD), (0x1401, 0x167F), (0x1780, 0x17FF),
    (0x1820, 0x18AA), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC),
]
_C1 = re.compile("[\x80-\x9f]")
_BOXES = re.compile("[\u2500-\u25ff]+")
_LETTER = r"[^\W\d_]"


def _read_as(raw: bytes, encoding: str) -> str:
    """Bytes read one by one; a byte the encoding doesn't define stands for the control of its number."""
    out = []
    for b in raw:
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def sequences(originals: list[tuple[int, int]] = ORIGINALS) -> dict[str, str]:
    """Garbled sequence to original character, for all encodings; the first encoding listed wins."""
    out: dict[str, str] = {}
    for encoding in ENCODINGS:
        table = [_read_as(bytes([b]), encoding) for b in range(256)]
        for low, high in originals:
            for point in range(low, high + 1):
                raw = chr(point).encode()
                out.setdefault("".join(table[b] for b in raw), chr(point))
    return out


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for garbled, original in sequences().items():
        found.add_word(garbled, (len(garbled), original, _ordinary(garbled, original)))
    found.make_automaton()
    return found


@lru_cache(maxsize=1)
def further():
    """Automaton of the further scripts; what is found is (length, original, script)."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for garbled, original in sequences(FURTHER).items():
        found.add_word(garbled, (len(garbled), original, next(k for k, (low, high) in enumerate(FURTHER) if low <= ord(original) <= high)))
    found.make_automaton()
    return found


def _ordinary(garbled: str, original: str) -> bool:
    """Whether a sequence can stand in correct text: a letter before a quotation mark, dash, dots or a no-break space."""
    if len(garbled) != 2 or not garbled[0].isalpha() or garbled[1] not in "\xa0‘’“”„…–—»«›‹":
        return False
    return original < "\xa0" or garbled[0] not in "ÂÃ"


#: Scripts whose letters are leads of ordinary pairs and aren't mixed with Latin ones by chance.
_SCRIPTS = ["\u0370-\u03ff", "\u0400-\u052f"]


def _counts(text: str, begin: int, end: int) -> bool:
    """Whether an ordinary pair is evidence by itself: a capital within a word, a letter directly after a mark that stands
    at the end of words, or a lead letter of a script that the text, otherwise Latin, doesn't have."""
    lead, mark, before, after = text[begin], text[begin + 1], text[begin - 1 : begin], text[end : end + 1]
    if before.islower() and lead.isupper() or lead == "Ă" and not before.isalpha():
        return True
    if after.isalpha() and (mark not in "\xa0‘’–—" or mark in "‘–—" and after.islower() and not before.isalpha()):
        return True
    rest = text[:begin] + text[end:]
    return any(re.match(f"[{s}]", lead) and re.search("[A-Za-z]", rest) and not re.search(f"[{s}]", rest) for s in _SCRIPTS)


def _matches(text: str, found=None) -> Iterator[tuple[int, int, str, int]]:
    """(begin, end, original, ordinary or script) of the longest matches from left to right, without overlap."""
    end_before = 0
    for last, (length, original, kind) in (found or automaton()).iter_long(text):
        begin = last + 1 - length
        if begin >= end_before:
            yield begin, last + 1, original, kind
            end_before = last + 1


def _run(text: str, hits: list[tuple[int, int, str, int]]) -> bool:
    """Whether two letters of one further script stand side by side, not made of box-drawing characters only."""
    return any(a[1] == b[0] and a[3] == b[3] and not _BOXES.fullmatch(text, a[0], b[1]) for a, b in pairwise(hits))


def _once(text: str) -> str:
    hits = list(_matches(text, further()))
    if not _run(text, hits):
        hits = list(_matches(text))
        if not hits or all(h[3] and not _counts(text, h[0], h[1]) for h in hits):
            return text
    out, at = [], 0
    for begin, end, original, _ in hits:
        out += (text[at:begin], original)
        at = end
    return "".join(out) + text[at:]


#: (encoding of the text, encoding it was read as), in the order in which they are tried.
SINGLE = [(true, read) for read in ("cp1252", "latin-1") for true in ("cp1251", "koi8-r", "cp1253", "cp1255", "cp1256")] + [("koi8-r", "cp1251"), ("cp1251", "koi8-r")]
DOUBLE = ["gbk", "big5", "cp932", "euc_kr"]
#: Least share of frequent pairs.
LIKELY = 0.4
_ACCENTED = "[\u00aa\u00b5\u00ba\u00c0-\u00ffŠŒŽšœžŸƒ]"
_MAYBE_SINGLE = re.compile(rf"{_ACCENTED}{{4}}|[\u0430-\u044f\u0451][\u0410-\u042f\u0401]{{3}}")
_ALONE = re.compile(rf"(?<![A-Za-z]){_ACCENTED}+(?![A-Za-z])")
_TURNED = re.compile(r"(?<!\w)[\u0430-\u044f\u0451][\u0410-\u042f\u0401]{3,}(?!\w)")
_CYRILLIC_WORD = re.compile(r"[\u0400-\u045f]+")
_WIDE = re.compile(r"[\u00a1-\uffdc]+")
_IDEOGRAPH = re.compile(r"[\u3400-\u9fff\uac00-\ud7a3\uff61-\uff9f]")
_BETWEEN = re.compile(r"(?<=[a-z])[\u3400-\u9fff\uac00-\ud7a3\uff61-\uff9f]{1,3}(?=[a-z])")
#: Letters by script, with the vowels of those that write them all.
_WORDS = [("[\u0401\u0410-\u044f\u0451]", "аеёиоуыэюя"), ("[\u0386-\u03ce]", "αεηιουωάέήίόύώϊϋΐΰ"), ("[\u05d0-\u05ea]", ""), ("[\u0621-\u064a]", "")]


@lru_cache(maxsize=1)
def _single_tables() -> dict[tuple[str, str], dict[int, str]]:
    """Translation of the upper half for each pair of single-byte encodings."""
    out = {}
    for true, read in SINGLE:
        pairs = [(_read_as(bytes([b]), read), bytes([b])) for b in range(128, 256)]
        out[true, read] = {ord(c): raw.decode(true) for c, raw in pairs if raw.decode(true, "ignore")}
    return out


def _usual(word: str) -> bool:
    """Whether a word has the shape of one of its script: usual capitals, some vowels, not more than four consonants on end."""
    for letters, vowels in _WORDS:
        if re.fullmatch(f"{letters}+", word):
            if not vowels:
                return True
            low = word.lower()
            if "ς" in low[:-1] or low[-1] == "σ":
                return False
            share = sum(c in vowels for c in low) / len(low)
            return (word.islower() or word[1:].islower()) and 0.2 <= share <= 0.75 and not re.search(f"[^{vowels}]{{5}}", low)
    return False


#: Pairs of letters that are frequent in Russian; half of the pairs in its words are among these.
_FREQUENT = frozenset("ст но то на ен ов ни ра во ко ро пр по ал ли ре ер ка ет ос де ла те не го ин та ол ел ль ит ть ва ом от ми ри ор ес ас мо ло ан ты ле ат ть ия ие ый ая за да об эт ве ны ак же ем ам".split())


def _likely(words: list[str]) -> float:
    """How much words look like ones of their language: the share of frequent pairs of letters; 0 if any has no usual shape.
    Scripts without a table of pairs get the least that counts."""
    if not all(map(_usual, words)):
        return 0.0
    if not "а" <= words[0][-1].lower() <= "ё":
        return LIKELY
    pairs = [a + b for w in words for a, b in pairwise(w.lower())]
    return sum(p in _FREQUENT for p in pairs) / len(pairs)


def _from_single(text: str) -> str:
    if not _MAYBE_SINGLE.search(text):
        return text
    for words, within, pairs in ((_ALONE, _ALONE, SINGLE[:-2]), (_TURNED, _CYRILLIC_WORD, SINGLE[-2:])):
        long = [w for w in words.findall(text) if len(w) >= 4]
        if not long or _run(text, list(_matches(text, further()))):
            continue
        tables = [t for t in map(_single_tables().__getitem__, pairs) if all(ord(c) in t for w in long for c in w)]
        best = max(tables, key=lambda t: _likely([w.translate(t) for w in long]), default=None)
        if best and _likely([w.translate(best) for w in long]) >= LIKELY:
            return within.sub(lambda m: m[0].translate(best), text)
    return text


def _of_one_script(text: str) -> bool:
    kinds = ["[\u00c0-\u024f\u1ea0-\u1ef9A-Za-z]", "[\u0370-\u03ff]", "[\u0400-\u045f]", "[\u05d0-\u05ea]", "[\u0600-\u06ff]", "[\u3000-\u30ff\u4e00-\u9fff\uff01-\uff5e]", "[\uac00-\ud7a3]", "[\u0e01-\u0e5b]"]
    return any(re.fullmatch(f"{k}+", text) for k in kinds)


def _from_double(text: str) -> str:
    if not _IDEOGRAPH.search(text):
        return text
    for encoding in DOUBLE:

        def original(run: str, encoding: str = encoding) -> str | None:
            try:
                found = run.encode(encoding).decode("utf-8")
            except UnicodeError:
                return None
            return found if found != run and _of_one_script(found) else None

        long = any(len(w) >= 4 and original(w) for w in _WIDE.findall(text))
        if long or any((found := original(w)) and all("\xc0" <= c <= "\u024f" for c in found) for w in _BETWEEN.findall(text)):
            return _WIDE.sub(lambda m: original(m[0]) or m[0], text)
    return text


def restore(text: str) -> tuple[bool, str]:
    """(garbled, text with every restorable span replaced)."""
    now = _from_single(text)
    garbled = now != text or "�" in text
    while (after := _once(now)) != now:  # each pass makes the text shorter, so this ends
        now, garbled = after, True
    if _C1.search(now):
        garbled = True
        now = _C1.sub(lambda m: _read_as(m[0].encode("latin-1"), "cp1252"), now)
    after = _from_double(now)
    return garbled or after != now, after


_RESULT = StructType([StructField("garbled", StringType()), StructField("restored", StringType())])


@F.arrow_udf(StringType())
def _restored(texts: pa.Array) -> pa.Array:
    def one(t: str | None) -> str | None:
        if t is None:
            return None
        garbled, text = restore(t)
        return text if garbled else None

    return pa.array([one(t) for t in texts.to_pylist()], pa.string())


#: What every garbled value has: a sequence of two at least, a control, a replacement character, or a wide character.
SUSPECT = r"[^\x00-\x7F]{2}|[\x{80}-\x{9F}\x{FFFD}\x{3400}-\x{9FFF}\x{AC00}-\x{D7A3}\x{FF61}-\x{FF9F}]"


def restored(text: Column) -> Column:
    """The restored text of a garbled value; null where the value isn't garbled."""
    return _restored(F.when(suspect(text), text))


def suspect(text: Column) -> Column:
    """Whether a value may be garbled; plain ASCII, as most are, is told by its length alone."""
    return (F.octet_length(text) > F.length(text)) & text.rlike(SUSPECT)


def garbled_fields(articles: DataFrame, fields: tuple[str, ...] = ("title", "snippet")) -> DataFrame:
    """(article_id, field, original, restored): one row a garbled value; restored still has what can't be restored."""
    one_field = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("original")) for f in fields])).alias("v")
    rows = articles.select("article_id", one_field).select("article_id", "v.field", "v.original").where(suspect(F.col("original")))
    return rows.withColumn("restored", _restored("original")).where("restored is not null")
