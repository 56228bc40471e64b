"""Personal data in texts, plain and disguised, with offsets into the source.

Plain identifiers are found on the source. For disguised ones transducers rewrite the text: look-alike letters and
digits to ASCII, invisible characters to nothing, spelled digits to digits, and "(at)", " dot " and the like to "@" and
".". Each character written remembers the source characters it stands for, so what is detected on the rewritten text is
mapped back to a span of the source. Every detector takes time linear in the text.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lakelog.llm.rows import map_texts, texts_of

Span = tuple[int, int, int]  # start, kind, end; kinds by place in KINDS

KINDS = ("email", "ip", "card", "phone")
SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

# Letters of other scripts that look like ASCII ones, in pairs.
_LETTERS = dict(
    pair
    for pair in (
        "аa вb еe кk мm нh оo рp сc тt уy хx іi јj ѕs ԁd һh ԛq ԝw ɡg ӏl АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЈJ ЅS "
        "αa ιi κk νv οo ρp υu χx ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ıi ․. 。. ・. ‐- ‑- ‒- –- —- −- "
        "օo սu ոn հh ցg զq ՍU ՏS ԼL ՕO ᴀa ʙb ᴄc ᴅd ᴇe ɪi ᴊj ᴋk ʟl ᴍm ɴn ᴏo ᴘp ʀr ᴛt ᴜu ᴠv ᴡw ᴢz ﹒. ．. ﹫@ ＠@ ＋+"
    ).split()
)
_INVISIBLE = "­​‌‍⁠﻿"
_SPACES = "   "
# The digits 0 to 9 spelled in English, German, French and Spanish.
_SPELLED = {
    word: str(digit)
    for language in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for digit, word in enumerate(language.split())
}
_ODD = re.compile("[" + "".join(_LETTERS).translate({ord(v): None for v in set(_LETTERS.values())}) + _INVISIBLE + _SPACES + r"٠-٩۰-۹०-९！-～\U0001d400-\U0001d7ff]")
_WORDS = "|".join(sorted(_SPELLED, key=lambda w: (-len(w), w)))
_RUN = re.compile(rf"(?i)(?<!\w)(?:{_WORDS}|[0-9])(?:[ \t-]+(?:{_WORDS}|[0-9]++)(?!\w)){{2,}}")
_BESIDE_DOT = re.compile(r"(?i)(?<= dot)[ \t]|[ \t](?=dot )")
_WORD = re.compile(rf"(?i)(?<!\w)(?:{_WORDS})(?!\w)|[ \t]+(?=[A-Za-zéü0-9])")
_BRACKETED = re.compile(r"(?i)\s?[\[({<]\s?(?:(at|@)|(dot|\.))\s?[\])}>]\s?")
_AT = re.compile(r"(?i)@| at (?!(?:the|a|an|this|that|each|every) )")
_SPOKEN_DOMAIN = re.compile(r"(?i)[A-Za-z0-9-]++(?:(?:\.| dot )[A-Za-z0-9-]++)++")
_SPOKEN_IP = re.compile(r"(?i)(?<![0-9])[0-9]++(?:(?:\.| dot )[0-9]++){3}")
# Words that stand before " at " in prose, and so are not the name in an address; words that announce one.
_PROSE = frozenset(
    "about active advert all anyone are article arrive arrived arrives available back based be been book bought buy buys "
    "call called career careers check click come companies company customers deal deals developer director down "
    "download employed engineer everyone everything find followed found founder good here him hired hosted how item "
    "it's items it job jobs join launched life listed listen live lives located look looked looking looks manager me "
    "meet meeting met more news office offices online open opened order ordered out page pages people play post posted "
    "price prices product products published purchase purchased read register registered released running search see "
    "seen sell sells shop shopping sign site sold someone something start started starts stay store stores study team "
    "that them there they this time today tv up us video visit was watch web website were what work worked working "
    "works write writes you".split()
)
_CUE = re.compile(r"(?i)(?:mail|address|contact|reach|write to|write me|correo|adresse|courriel)\W+(?:\w+\W+){0,2}$")
_HYPHENED = re.compile(r"(?i)(?<=[a-z0-9])([-_])at\1(?=[a-z0-9])")
_HYPHENED_DOMAINS = {x: re.compile(rf"(?i)[a-z0-9]++(?:{x}dot{x}[a-z0-9]++)++") for x in "-_"}
_HYPHENED_DOTS = {x: re.compile(rf"(?i){x}dot{x}") for x in "-_"}
# Fixed values: "at" and "dot" in Spanish, French and German.
_FOREIGN = re.compile(r"(?i)(?<=[a-z0-9]) (?:arroba|arobase|klammeraffe) (?=[a-z0-9])")
_FOREIGN_DOMAIN = re.compile(r"(?i)[a-z0-9-]++(?:(?:\.| (?:punto|point|punkt) )[a-z0-9-]++)++")
_FOREIGN_DOT = re.compile(r"(?i) (?:punto|point|punkt) ")
_NUMERAL = rf"(?:{_WORDS})(?!\w)(?:[ \t-]+(?:{_WORDS})(?!\w))*"
_SPELLED_IP = re.compile(rf"(?i)(?<!\w){_NUMERAL}(?:(?: dot |\.){_NUMERAL}){{3}}")
_PLUS = re.compile(r"(?i)(?<!\w)plus[ \t]+(?=[0-9](?:[ -]?[0-9]){8})")
_DOT = re.compile(r"(?i) dot ")
_ANY_DOT = re.compile(r"(?i)\.| dot ")
_TOP = re.compile(r"[A-Za-z]{2,24}")
_BRACKET = re.compile(r"[\[({<]")
_BREAKS = str.maketrans(dict.fromkeys("-()[]{}<>,.:;!?\"'/+", " "))


# ------------------------------------------------------------------ detectors


def _emails(text: str):
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        floor = domain.end() if domain else at + 1
        at = text.find("@", floor)


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        n = int(digit) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """Plain identifiers, by start and then kind."""
    found = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


# ------------------------------------------------------------------ transducers


class Rewritten:
    """A text with, for each character, the start and end of what it stands for in the source."""

    def __init__(self, text: str) -> None:
        self.text, self.starts, self.ends = text, range(len(text)), range(1, len(text) + 1)

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Put a text in the place of each ``[start, end)``; the edits are in order and apart."""
        text, starts, ends, at = [], [], [], 0
        for start, end, new in edits:
            text += self.text[at:start], new
            starts += self.starts[at:start]
            ends += self.ends[at:start]
            if new:
                starts += [self.starts[start]] * len(new)
                ends += [self.ends[end - 1]] * len(new)
            at = end
        self.text = "".join([*text, self.text[at:]])
        self.starts = [*starts, *self.starts[at:]]
        self.ends = [*ends, *self.ends[at:]]


def _lookalikes(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _ODD.finditer(text):
        ch = m[0]
        if ch in _INVISIBLE:
            new = ""
        elif ch in _SPACES:
            new = " "
        elif ch in _LETTERS:
            new = _LETTERS[ch]
        else:
            digit = unicodedata.decimal(ch, None)
            new = str(digit) if digit is not None else unicodedata.normalize("NFKC", ch)
        if new != ch:
            edits.append((m.start(), m.end(), new))
    return edits


def _spelled_digits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    if _SPELLED.keys().isdisjoint(text.lower().translate(_BREAKS).split()):
        return edits
    runs = [*_RUN.finditer(text), *_SPELLED_IP.finditer(text)]
    at = 0
    for start, end in sorted((run.start(), run.end()) for run in runs):
        for m in _WORD.finditer(text, max(at, start), end):
            # The spaces around "dot" stay; other ones between digits go.
            joins = m[0].isspace() and not _BESIDE_DOT.match(text, m.start())
            if joins or not m[0].isspace():
                edits.append((m.start(), m.end(), "" if joins else _SPELLED.get(m[0].lower(), m[0])))
        at = max(at, end)
    return edits


def _plus(text: str) -> list[tuple[int, int, str]]:
    """The word "plus" before the digits of a phone number."""
    return [(m.start(), m.end(), "+") for m in _PLUS.finditer(text)]


def _joined_words(text: str) -> list[tuple[int, int, str]]:
    """"-at-" and "-dot-" of one address, and the words for both in other languages."""
    edits: list[tuple[int, int, str]] = []
    for found in (_HYPHENED, _FOREIGN):
        for at in found.finditer(text):
            hyphen = at[1] if found is _HYPHENED else None
            domain = (_HYPHENED_DOMAINS[hyphen] if hyphen else _FOREIGN_DOMAIN).match(text, at.end())
            if domain:
                dots = _HYPHENED_DOTS[hyphen] if hyphen else _FOREIGN_DOT
                edits.append((at.start(), at.end(), "@"))
                edits += [(d.start(), d.end(), ".") for d in dots.finditer(text, domain.start(), domain.end())]
    return _apart(edits)


def _apart(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The edits in order, without those that begin inside an earlier one."""
    apart, end = [], 0
    for edit in sorted(edits):
        if edit[0] >= end:
            apart.append(edit)
            end = edit[1]
    return apart


def _bracketed(text: str) -> list[tuple[int, int, str]]:
    if not _BRACKET.search(text):
        return []
    return [(m.start(), m.end(), "@" if m[1] else ".") for m in _BRACKETED.finditer(text)]


def _local_start(text: str, at: int, floor: int) -> int:
    """Where the local part that ends at ``at`` begins, its parts joined by ``.`` or " dot "."""
    start = at
    while True:
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        before = start - 5
        if start == at or before <= floor or text[before:start].lower() != " dot " or text[before - 1] not in _LOCAL:
            return start
        start = before


def _spoken_emails(text: str) -> Iterator[tuple[re.Match, int, int]]:
    """The "@" or " at " of each address, and the address' start and end; at and dots may be spoken or not."""
    floor = 0
    for at in _AT.finditer(text):
        domain = _SPOKEN_DOMAIN.match(text, at.end()) if at.start() and text[at.start() - 1] in _LOCAL else None
        if domain is None:
            continue
        end, dots = domain.end(), list(_ANY_DOT.finditer(text, domain.start(), domain.end()))
        while dots and not _TOP.fullmatch(text, dots[-1].end(), end):  # "example dot com dot 5" ends before " dot 5"
            end = dots.pop().start()
        start = _local_start(text, at.start(), floor)
        if not dots or start == at.start():
            continue
        if at[0] != "@" and text[start : at.start()].lower() in _PROSE and not _CUE.search(text, max(0, start - 40), start):
            continue  # "look at python.org" names a place
        yield at, start, end
        floor = end


def _at_and_dot(text: str) -> list[tuple[int, int, str]]:
    """" at " and " dot " of addresses and IP numbers, mixed with "@" and "." in any way."""
    edits = []
    for at, start, end in _spoken_emails(text):
        if at[0] != "@":
            edits.append((at.start(), at.end(), "@"))
        for side in ((start, at.start()), (at.end(), end)):
            edits += [(d.start(), d.end(), ".") for d in _DOT.finditer(text, *side)]
    if _DOT.search(text):
        for m in _SPOKEN_IP.finditer(text):
            edits += [(d.start(), d.end(), ".") for d in _DOT.finditer(text, m.start(), m.end())]
    return _apart(edits)


def rewrite(text: str) -> Rewritten | None:
    """The text after all transducers, or None if none of them changes it."""
    out, changed = Rewritten(text), False
    for transducer in (_lookalikes, _spelled_digits, _plus, _bracketed, _joined_words, _at_and_dot):
        if edits := transducer(out.text):
            out.replace(edits)
            changed = True
    return out if changed else None


def find_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Spans of plain identifiers, and the further ones of disguised identifiers.

    A further span touches no plain one, or holds all that it touches and more: the plain pattern found a part of it.
    """
    plain, more = detect(text), []
    if (new := rewrite(text)) is not None:
        taken = sorted((s, e) for s, _, e in plain)
        at = 0
        for start, kind, end in detect(new.text):
            s, e = new.starts[start], new.ends[end - 1]
            while at < len(taken) and taken[at][1] <= s and taken[at][0] <= s:
                at += 1
            touched = [(a, b) for a, b in taken[max(0, at - 4) : at + 4] if s < b and a < e]
            if all(s <= a and b <= e and (s, e) != (a, b) for a, b in touched):
                more.append((s, kind, e))
    return plain, more


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one, named after the first."""
    out, at, end = [], 0, -1
    for start, kind, stop in sorted(spans):
        if start >= end:
            out += text[at:start], f"[{KINDS[kind].upper()}]"
        end = at = max(end, stop)
    return "".join([*out, text[at:]])


# ------------------------------------------------------------------ operators


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Spans of personal data of every whole text.

    Needs ``doc_id`` and ``text``; other columns are ignored. ``n_*`` and ``base_sha256`` are of the plain
    identifiers, ``spans`` of all, ``n_added`` counts the disguised ones; offsets are code points, ends exclusive. A
    null text is empty; a null ``doc_id`` and repeated rows are kept, a row each; no rows give no rows.
    """

    def make():
        def run(part: pa.RecordBatch) -> dict:
            found = [find_spans(t) for t in texts_of(part)]
            out = {"doc_id": part.column("doc_id")}
            for i, kind in enumerate(KINDS):
                out[f"n_{kind}"] = [sum(k == i for _, k, _ in plain) for plain, _ in found]
            out["base_sha256"] = [hashlib.sha256(joined(plain).encode()).hexdigest() for plain, _ in found]
            out["spans"] = [joined(plain + more) for plain, more in found]
            out["n_added"] = [len(more) for _, more in found]
            return out

        return run

    return map_texts(docs.select(docs["doc_id"].cast("long"), docs["text"]), "text", make, SCHEMA)


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind in brackets, ``n_chars`` counted anew.

    A null text stays null; all columns and rows are kept in their order.
    """

    def make():
        def run(part: pa.RecordBatch) -> dict:
            texts = part.column("text").to_pylist()
            masks = [t if t is None else masked(t, [s for spans in find_spans(t) for s in spans]) for t in texts]
            return {name: masks if name == "text" else part.column(name) for name in part.schema.names}

        return run

    names = [f.name.replace("`", "``") for f in docs.schema]
    schema = ", ".join(f"`{name}` {f.dataType.simpleString()}" for name, f in zip(names, docs.schema, strict=True))
    out = map_texts(docs, "text", make, schema)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
