"""PII: offset-preserving deobfuscation.

Base detectors find plain identifiers. Transducers then rewrite disguises (look-alike letters and digits, invisible
characters, spelled digits, at/dot words) as a list of edits, each a source span and what it stands for; the detectors
run again over the normalised text, and what touches an edit is mapped back to the source characters. Base spans stay; a
mapped span that reaches beyond all base spans it meets is added to them.

Every detector is linear in the text, whatever it holds: e-mails are found from their ``@`` outwards, runs of digits are
entered only at their start, disguises are found from their word or bracket outwards, and blanks around one are taken up by
a scan that no other disguise repeats.

Defined results: a null text is empty and has no spans; repeated rows are searched each for itself; an empty table gives
no rows; extra columns pass through ``redact`` untouched.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, place of the kind in KINDS, end

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_DIGIT = re.compile("[0-9]")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """Base spans, leftmost and non-overlapping per kind, by start, then kind."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, 0, end))
            at = text.find("@", end)
        else:
            end = max(end, at + 1)  # no later match begins at or before this sign
            at = text.find("@", at + 1)
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# -- transducers -------------------------------------------------------------------------------------------------------


#: Fixed values (Unicode's list of confusable characters, the letters of these scripts that look like one of ASCII).
_CONFUSABLE = {
    "аеорсухѕіјԁһӏԛԝкмтвнАВЕКМНОРСТУХЅІЈԚԜгүҽѵѡꙇԌҮѴӀ": "aeopcyxsijdhlqwkmtbhABEKMHOPCTYXSIJQWryevwiGYVl",
    "αορνιυκτγσϲϳϱΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿϺϜ": "aopviuktyocjpABEZHIKMNOPTYXCJMF",
    "ıɑɡɩɪʋʏǀᴄᴏᴑᴜᴠᴡᴢᶃꜱꞟꬲꬵꬽꭇꭎꭚɯɣẝỿꝚꞘꞲꞳꞴƦƼ": "iagiiuylcoouvwzgsueforuywyfyRFJXBR5",
    "ագզհոռսցքօՍՏՕ": "wqqhnnugfoUSO",
    "ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏂᏃᏟᏙᏞᏢᏦᏚᏕᏴᏔꮃꮓꮩꮪꮯꭵꮁ": "DRTiYAJEWMHYGhZCVLPKSSBWwzvscir",
    "ⲎⲒⲔⲘⲚⲞⲟⲢⲣⲤⲥⲦⲨⲬⲅ": "HlKMNOoPpCcTYXr",
}


def _look_alikes() -> dict[str, str]:
    """Characters that look like ASCII letters, digits or the signs of identifiers; invisible ones stand for nothing.

    Beside the letters above, whatever Unicode writes as a compatibility form (wide, mathematical, circled, Roman numeral,
    ligature) of such characters, and the decimal digits of all scripts. Superscripts are left out: they are foot notes.
    """
    wanted, pairs = _LOCAL | set("@() "), {}
    for cp in range(0x80, sys.maxunicode + 1):
        c = chr(cp)
        how = unicodedata.decomposition(c)
        if how.startswith(("<font>", "<wide>", "<narrow>", "<small>", "<compat>")) or how.startswith("<circle>") and unicodedata.category(c) == "So":
            plain = unicodedata.normalize("NFKC", c)
            if plain in wanted or plain.isascii() and plain.isalnum():
                pairs[c] = plain
        elif 0x660 <= cp < 0x11000 and unicodedata.category(c) == "Nd":
            pairs[c] = str(unicodedata.digit(c))
    for alike, plain in _CONFUSABLE.items():
        pairs |= zip(alike, plain, strict=True)
    pairs |= dict.fromkeys("​‌‍⁠﻿­", "")
    pairs |= {"․": ".", "。": ".", "｡": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " "}
    return pairs


LOOK_ALIKES = _look_alikes()
_LATIN_1_ALIKE = [c for c in LOOK_ALIKES if ord(c) < 256]
#: Words for digits in four languages. A text without any of them skips that transducer.
DIGIT_WORDS = {
    w: str(n)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for n, w in enumerate(words.split())
}
_DIGIT_SET, _DOTTED = frozenset(DIGIT_WORDS), ("dot", "punkt", "point", "punto")
_DIGIT_WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_DOT_WORD, _AT_WORD = r"(?:dot|punkt|point|punto)", r"(?:at|arroba|arobase)"
_OPEN, _CLOSE = r"[\[({<][ \t]*+", r"[ \t]*+[\])}>]"
_DOT = rf"(?:[ \t]*+{_OPEN}(?:{_DOT_WORD}|\.){_CLOSE}[ \t]*+|[ \t]++{_DOT_WORD}[ \t]++)"
_BETWEEN = rf"(?:[ \t,-]{{1,2}}|[ \t]++{_DOT_WORD}[ \t]++)"
#: Two digit words or more in a row, or one beside digits; a single one is a word like any other.
_SPELLED = re.compile(rf"(?<![^\W_]){_DIGIT_WORD}(?:{_BETWEEN}(?:{_DIGIT_WORD}|[0-9]+))+(?![^\W_])|(?<![^\W_])[0-9]+(?:{_BETWEEN}{_DIGIT_WORD})+(?:{_BETWEEN}(?:{_DIGIT_WORD}|[0-9]+))*(?![^\W_])", re.I)
_SPELLED_PART = re.compile(rf"({_DIGIT_WORD})|([ \t]++{_DOT_WORD}[ \t]++)|[ \t,-]+", re.I)
_PLUS = re.compile(r"(?<![^\W_])plus[ \t]++(?=\(?[0-9])", re.I)
_LABEL = "[A-Za-z0-9-]++"
#: Disguises without the blanks around them, which ``_widened`` takes up: in brackets, or bare between blanks.
_BRACKET_AT = re.compile(rf"{_OPEN}(?:{_AT_WORD}|@){_CLOSE}", re.I)
#: A bare "at" counts before a domain with a disguised dot; " @ " with blanks before any domain.
_SPACED_AT = re.compile(
    rf"(?<=[ \t]){_AT_WORD}(?=[ \t]++{_LABEL}(?:(?:{_DOT}|\.){_LABEL})*{_DOT}[A-Za-z0-9-])|(?<=[ \t])@(?=[ \t]*+{_LABEL}(?:{_DOT}|\.)[A-Za-z0-9-])|(?<=[A-Za-z0-9])@(?=[ \t]++{_LABEL}(?:{_DOT}|\.)[A-Za-z0-9-])",
    re.I,
)
_DOTS = re.compile(rf"{_OPEN}(?:{_DOT_WORD}|\.){_CLOSE}|(?<=[ \t]){_DOT_WORD}(?=[ \t])", re.I)
#: Before a domain with plain dots a bare "at" counts if the name before it can't be a word of prose, or a cue leads to it.
_PLAIN_AT = re.compile(rf"(?<=[ \t]){_AT_WORD}(?=[ \t]++{_LABEL}\.[A-Za-z0-9-])", re.I)
#: Longer names aren't looked at before a bare "at".
NAME_CHARS = 256
_NAME = re.compile(r"(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9%+-]*[._0-9][A-Za-z0-9._%+-]*(?<![.-])|[0-9]{5,}")
_CUE = re.compile(r"(?<![^\W_])(?:e-?mail|mail|mailto|correo|courriel)(?:[ \t]+(?:address|adresse|me|us|to|is|an|à|a|es|est|ist))*[ \t]*:?[ \t]*$", re.I)
_NOT_NAMES = frozenset("address addresse adresse addresses me us him her it them you mich uns nous moi nos to is an a es est ist or and server servers service services list lists sent only support here".split())
#: An address with bare "at" or bare "dot" must end in a country's two letters or a common domain, or have such a name.
_BARE = re.compile(rf"[ \t]{_AT_WORD}[ \t]", re.I)
_BARE_DOT = re.compile(rf"[ \t]{_DOT_WORD}[ \t]", re.I)
_TLD = re.compile(
    "[a-z]{2}|com|org|net|edu|gov|mil|int|info|biz|name|dev|app|test|example|invalid|local|online|shop|site|store|tech|cloud|blog|xyz|email|club|website"
    "|digital|agency|software|systems|network|media|mobi|pro|jobs|coop|travel|museum|aero|asia|tel|berlin|hamburg|koeln|bayern|wien|paris|london|gal|eus|onion",
    re.I,
)
_HAS_LOOK_ALIKE = re.compile("[" + re.escape("".join(LOOK_ALIKES)) + "]")
_WORD_HINT = re.compile(rf"[\[({{< \t]{_DOT_WORD}[\])}}> \t]|{_OPEN}(?:{_AT_WORD}|@|\.){_CLOSE}|[ \t]@|@[ \t]", re.I)


class Normalised:
    """A text after edits, and the way back: source offsets of each piece."""

    def __init__(self, text: str):
        self.text = text
        self.starts, self.sources, self.edited = [0], [(0, len(text))], [False]

    def apply(self, edits: list[tuple[int, int, str]]) -> Normalised:
        """edits: non-overlapping (start, end, replacement) over the present text, in order."""
        if not edits:
            return self
        cuts, at, out = [], 0, Normalised("")
        for a, b, new in edits:
            if a > at:
                cuts.append((at, a, None))
            cuts.append((a, b, new))
            at = b
        if at < len(self.text):
            cuts.append((at, len(self.text), None))
        pieces, n = [], 0
        out.starts, out.sources, out.edited = [], [], []
        for a, b, new in cuts:
            if new is not None:
                if new:
                    out._piece(n, (self.back(a, b)), True)
                    pieces.append(new)
                    n += len(new)
                continue
            k = bisect_right(self.starts, a) - 1
            while a < b:  # an untouched stretch may span several earlier pieces
                stop = min(b, self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text))
                s0, s1 = self.sources[k]
                off = a - self.starts[k]
                out._piece(n, (s0, s1) if self.edited[k] else (s0 + off, s0 + off + stop - a), self.edited[k])
                pieces.append(self.text[a:stop])
                n += stop - a
                a, k = stop, k + 1
        out.text = "".join(pieces)
        return out

    def _piece(self, start: int, source: tuple[int, int], edited: bool) -> None:
        self.starts.append(start)
        self.sources.append(source)
        self.edited.append(edited)

    def back(self, a: int, b: int) -> tuple[int, int]:
        """The source span of the characters from a to b (b > a)."""
        i, j = bisect_right(self.starts, a) - 1, bisect_right(self.starts, b - 1) - 1
        s = self.sources[i][0] if self.edited[i] else self.sources[i][0] + a - self.starts[i]
        e = self.sources[j][1] if self.edited[j] else self.sources[j][0] + b - self.starts[j]
        return s, e

    def touched(self, a: int, b: int) -> bool:
        """Whether an edit lies in, or was cut out of, the characters from a to b."""
        i, j = bisect_right(self.starts, a) - 1, bisect_right(self.starts, b - 1) - 1
        s, e = self.back(a, b)
        return any(self.edited[i : j + 1]) or e - s != b - a


def _spelled(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _SPELLED.finditer(text):
        for p in _SPELLED_PART.finditer(text, m.start(), m.end()):
            out.append((p.start(), p.end(), DIGIT_WORDS[p[1].lower()] if p[1] else "." if p[2] else ""))
    return out


def _may_look_alike(text: str) -> bool:
    """False at once for Latin-1 texts, most of which have accents but no look-alikes."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return True
    return any(c in text for c in _LATIN_1_ALIKE)


def _hints(text: str) -> tuple[bool, bool]:
    """Whether at/dot disguises, and spelled digits, are worth a search."""
    low = text.lower()
    words = ("@" in text or any(w in low for w in _DOTTED) or any(c in text for c in "[({<")) and bool(_WORD_HINT.search(text)) or bool(_PLAIN_AT.search(text))
    return words, not _DIGIT_SET.isdisjoint(low.replace("-", " ").replace(",", " ").split())


def _named(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] is a name that a bare "at" may follow."""
    if end - start > NAME_CHARS:
        return False
    name = text[start:end]
    return bool(_NAME.fullmatch(name)) or bool(name) and name.lower() not in _NOT_NAMES and bool(_CUE.search(text[max(0, start - 40) : start]))


def _plain_ats(text: str) -> Iterator[tuple[int, int]]:
    """Bare "at" between a name and a domain with plain dots."""
    done = 0
    for m in _PLAIN_AT.finditer(text):
        end = m.start()
        while end > done and text[end - 1] in " \t":
            end -= 1
        start = end
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if _named(text, start, end):
            yield m.start(), m.end()
        done = m.end()


def _widened(text: str, cores: dict[tuple[int, int], str]) -> list[tuple[int, int, str]]:
    """The cores that don't overlap an earlier one, each with the blanks on both sides.

    Each run of blanks is read at most twice, by the core before it and the one after it. A bare word whose blanks an earlier
    core has taken is left alone.
    """
    out, end = [], 0
    for (a, b), new in sorted(cores.items()):
        if a < end or a == end > 0 and text[a].isalpha():
            continue
        while a > end and text[a - 1] in " \t":
            a -= 1
        while b < len(text) and text[b] in " \t":
            b += 1
        out.append((a, b, new))
        end = b
    return out


def normalise(text: str) -> Normalised | None:
    """The text after all transducers; None where no disguise is found."""
    alike = _may_look_alike(text) and _HAS_LOOK_ALIKE.search(text)
    words, spelled = _hints(text)
    if not (alike or words or spelled):
        return None
    now = Normalised(text)
    if alike:
        now = now.apply([(m.start(), m.end(), LOOK_ALIKES[m[0]]) for m in _HAS_LOOK_ALIKE.finditer(text)])
        words, spelled = _hints(now.text)
    if spelled:
        now = now.apply(_spelled(now.text))
        now = now.apply([(m.start(), m.end(), "+") for m in _PLUS.finditer(now.text)])
    if words:
        edits = {(m.start(), m.end()): "@" for r in (_BRACKET_AT, _SPACED_AT) for m in r.finditer(now.text)} | dict.fromkeys(_plain_ats(now.text), "@") | {(m.start(), m.end()): "." for m in _DOTS.finditer(now.text)}
        now = now.apply(_widened(now.text, edits))
    return now


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and base with disguised ones; each by start, then kind."""
    text = text or ""
    base = detect(text)
    now = normalise(text)
    if now is None or len(now.starts) == 1 and not now.edited[0]:
        return base, base
    more = set()
    for a, k, b in detect(now.text):
        if now.touched(a, b):
            s, e = now.back(a, b)
            met = [x for x in base if x[1] == k and x[0] < e and s < x[2]]
            # what lies beyond the plain part must be a disguise, not prose: "look at the dot one day"
            bare = k == 0 and (_BARE.search(text, s, e) or met and _BARE_DOT.search(text, met[-1][2], e))
            if bare and not _TLD.fullmatch(now.text[a:b].rpartition(".")[2]) and not _named(text, s, s + now.text[a:b].index("@")):
                continue
            if all(s <= x[0] and x[2] <= e for x in met) and (s, k, e) not in met:
                more.add((s, k, e))
    return base, sorted({*base, *more})


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str | None) -> str | None:
    """The text with each span (overlapping ones as one) replaced by the kind of its first."""
    spans = find(text)[1]
    if not spans:
        return text
    out, at, k = [], 0, 0
    while k < len(spans):
        a, kind, b = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < b:
            k += 1
            b = max(b, spans[k][2])
        out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at, k = b, k + 1
    return "".join([*out, text[at:]])


def find_spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, counts of base spans by kind, digest of the base spans, all spans."""
    small_batches(docs.sparkSession)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [find(t) for t in b.column(1).to_pylist()]
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
            digests = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *counts, digests, pa.array([written(s) for _, s in found], pa.string())], names=names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the spans in ``text`` replaced; all other columns pass through."""
    small_batches(docs.sparkSession)

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(redacted, na_action="ignore")

    return docs.withColumn(text, F.pandas_udf(run, "string")(F.col(text)))


def op2_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_spans(table(spark, sf_dir, "documents"))
