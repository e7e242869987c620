"""PII: find personal data, also where it is disguised, and give its place in the source text.

Plain identifiers (e-mail, IPv4, card, phone) are found by their patterns. Disguised ones are found in a normalised
copy: a chain of transducers folds homoglyphs and full-width forms, drops zero-width characters, writes spelled digits
as digits, and turns at/dot disguises into `@` and `.`. Each transducer gives, for every character that it writes,
the source characters it stands for; so a span of the normalised copy maps back to a span of the source.
A disguised identifier's span is added unless it cuts through a plain one of its kind or adds nothing to it.

A disguised address is grown from its `at`: to the right over labels and dots, of which the longest chain that ends in a
top domain counts, then to the left over the local part. Each separator of a disguised IP address may be plain or
disguised. Fewer than three spelled digits among plain ones count where the whole run of numbers, without its gaps, is an
IP address, card or phone number by its kind's test.

Limits: a mail address whose `at` isn't in brackets counts only under the top domains of TOP_DOMAINS, which are some
generic ones and all country codes; those of them that are words (WORD_DOMAINS, such as `in`) don't count after a dot that
is spelled out or stands between blanks without brackets. A free-standing dot counts only before a top domain of the list,
whatever the `at` looks like. So `look at example.com` counts as an address. A spelled digit counts only if it stands apart
from plain ones, and only English digits do.

Defined cases: null counts as empty text; empty texts have no spans; offsets are code points, end exclusive; repeated
rows give equal results; other columns are kept. A text is handled whole, one at a time, in time that grows with its
length: every run of characters is looked at a fixed number of times, however long it is.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Letters of other scripts that look like Latin ones, and characters without width.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ь": "b", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ѕ": "S", "Ј": "J",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "τ": "t", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l", "․": ".", "。": ".", "．": ".", "‧": ".", "＠": "@", "﹫": "@", "＋": "+", "－": "-", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", " ": " ", " ": " ", " ": " ", "　": " ", "（": "(", "）": ")",
    "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "",
}
NUMBER_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
TOP_DOMAINS = set("com org net edu gov mil int info biz name io co me tv ai app dev uk de fr es eu us ca au jp cn ru nl se ch be pt br mx pl example test invalid".split())
#: The other country codes; those that are common words apart.
WORD_DOMAINS = set("ad am an as at by do fm id in is it la ma mu my no pa pm so st to".split())
#: Codes that are common words of English, French, German or Spanish: after a plain `at` they count only where no word follows, or behind a dot in brackets.
SPOKEN_DOMAINS = WORD_DOMAINS | set("be me us de es se si su al et er im ne ni sa va".split())
TOP_DOMAINS |= WORD_DOMAINS | set("ac ae af ag al ao aq ar aw ax az ba bb bd bf bg bh bi bj bm bn bo bs bt bw bz cc cd cf cg ci ck cl cm cr cu cv cw cx cy cz dj dk dm dz ec ee eg er et fi fj fk fo ga gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu ie il im iq ir je jm jo ke kg kh ki km kn kp kr kw ky kz lb lc li lk lr ls lt lu lv ly mc md mg mh mk ml mm mn mo mp mq mr ms mt mv mw my mz na nc ne nf ng ni np nr nu nz om pe pf pg ph pk pn pr ps pw py qa re ro rs rw sa sb sc sd sg sh si sk sl sm sn sr ss sv sx sy sz tc td tf tg th tj tk tl tm tn tr tt tw tz ua ug uy uz va vc ve vg vi vn vu wf ws ye za zm zw su gb".split())
# End of fixed values. Full-width and other digits follow from their Unicode value.

_TABLE = HOMOGLYPHS | {chr(0xFF01 + i - 0x21): chr(i) for i in range(0x30, 0x7B) if chr(i).isalnum()}
_TABLE |= {chr(first + d): str(d) for first in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
_ODD = re.compile("[" + re.escape("".join(_TABLE)) + "]")

_WORDS = "|".join(NUMBER_WORDS)
_SPELLED = re.compile(rf"(?<![A-Za-z0-9])(?:(?:plus|\+)[ -]?)?(?:double[ -]|triple[ -])?(?:{_WORDS})(?:(?:[ ,-]{{1,3}}|[ ]?(?:dot|point|dash|hyphen)[ ]|\.)(?:double[ -]|triple[ -])?(?:{_WORDS}|[0-9]))+(?![A-Za-z0-9])", re.IGNORECASE)
_NUMBER = rf"(?:double[ -]|triple[ -])?(?:{_WORDS}|[0-9]++)"
_MIXED = re.compile(rf"(?<![A-Za-z0-9])(?:(?:plus|\+)[ -]?)?\(?{_NUMBER}(?:(?:[ ,().-]{{1,3}}|[ ]?(?:dot|point|dash|hyphen)[ ]){_NUMBER})+(?![A-Za-z0-9])", re.IGNORECASE)
_PART = re.compile(rf"(?P<plus>plus)|(?P<times>double|triple)|(?P<word>{_WORDS})|(?P<dot>dot|point)|(?P<dash>dash|hyphen)|(?P<char>[0-9+.-])|(?P<gap>[ ,]+)", re.IGNORECASE)

_L, _R = r"[\[\(\{<]", r"[\]\)\}>]"
#: What stands for @: in brackets (1), a word between blanks, hyphens or underscores (2), or itself. The blanks around belong to it.
_AT = re.compile(rf"({_L}\s*+(?:at|@)\s*+{_R})|(?<=[ \t-\r_-])(at)(?=[ \t-\r_-])|@", re.IGNORECASE)
#: What stands for a dot: in brackets (1), a word between blanks, hyphens or underscores (2), a dot between blanks (3).
_DOT = re.compile(rf"({_L}\s*+(?:dot|punkt|point|punto|\.)\s*+{_R})|(?<=[ \t-\r_-])(dot)(?=[ \t-\r_-])|(?<=[ \t-\r])(\.)(?=[ \t-\r])", re.IGNORECASE)
_LABEL = re.compile(r"[A-Za-z0-9-]++")
_GOES_ON = re.compile(r"[ \t]++[A-Za-z]")
_TOP = re.compile(r"[A-Za-z]{2,}+(?![0-9])")
_BLANKS = " \t\n\r\v\f"
_SPACES, _GAPS, _NO_DIGITS = re.compile(r"[ \t-\r]*+"), re.compile(r"[ \t-\r_-]*+"), re.compile(r"[^0-9]+")
_HIDDEN_IP = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:\s*+{_L}\s*+(?:dot|\.)\s*+{_R}\s*+|\s++dot\s++|\.)[0-9]{{1,3}}){{3}}(?![0-9])", re.IGNORECASE)
_HAS_WORD = re.compile(_WORDS, re.IGNORECASE)

Span = tuple[int, int]
Edit = tuple[int, int, str]  # start, end, what is written instead


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Grown from each @: the run of local characters before it, and labels with dots after it."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
        free = domain.end() if domain else at + 1
        at = text.find("@", free)
    return found


def _addresses(text: str) -> list[Span]:
    """Four numbers at a time of each chain of numbers that single dots join; those with a part over 255 are dropped."""
    found = []
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) < 4 and int(p[-3:]) <= 255 for p in four):
                found.append((at, end))
            at = end + 1
    return found


def base_spans(text: str) -> dict[str, list[Span]]:
    """Plain identifiers: leftmost matches of each kind that don't overlap; those that fail their test are dropped."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    found["email"] = _emails(text)
    if not _DIGIT.search(text):
        return found
    if "." in text:
        found["ip"] = _addresses(text)
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found["card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


class Tape:
    """A normalised text with the source span of each of its characters."""

    def __init__(self, text: str, starts: list[int] | range | None = None, ends: list[int] | range | None = None):
        self.text = text
        self.starts = range(len(text)) if starts is None else starts
        self.ends = range(1, len(text) + 1) if ends is None else ends

    def source(self, start: int, end: int) -> Span:
        return self.starts[start], self.ends[end - 1]

    def rewrite(self, edits: Iterable[Edit]) -> Tape:
        """One transducer: the edits of this tape's text, in order; the rest stays as it is."""
        out, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            out += [self.text[at:a], new]
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            starts += [self.starts[a]] * len(new)
            ends += [self.ends[b - 1]] * len(new)
            at = b
        if not at:
            return self
        out.append(self.text[at:])
        return Tape("".join(out), [*starts, *self.starts[at:]], [*ends, *self.ends[at:]])


def _folded(text: str) -> Iterator[Edit]:
    return ((m.start(), m.end(), _TABLE[m[0]]) for m in _ODD.finditer(text))


def _spelled(text: str) -> Iterator[Edit]:
    """Three number words or more in a row."""
    for m in _SPELLED.finditer(text):
        if len(_HAS_WORD.findall(m[0])) >= 3:
            yield from _written(m)


def _mixed(text: str) -> Iterator[Edit]:
    """Plain and spelled digits, if the whole is an identifier."""
    for m in _MIXED.finditer(text):
        if _HAS_WORD.search(m[0]):
            parts = _written(m)
            number = "".join(new for _, _, new in parts)
            if any((0, len(number)) in spans for spans in base_spans(number).values()):
                yield from parts


def _written(m: re.Match) -> list[Edit]:
    """The digits, dots, hyphens and plus of a run of numbers; what else stands between them goes."""
    out, times, at = [], 1, m.start()
    for p in _PART.finditer(m[0]):
        a, b, new = m.start() + p.start(), m.start() + p.end(), ""
        if p["times"]:
            times = 2 if p["times"].lower() == "double" else 3
        elif p["word"]:
            new, times = NUMBER_WORDS[p["word"].lower()] * times, 1
        elif p["plus"]:
            new = "+"
        elif p["dot"]:
            new = "."
        elif p["char"]:
            new, times = p["char"] * times, 1
        if a > at:
            out.append((at, a, ""))
        out.append((a, b, new))
        at = b
    return [*out, (at, m.end(), "")] if at < m.end() else out


@dataclass
class Sign:
    """What stands for an @ or a dot, with the blanks around it."""

    start: int
    end: int
    look: str  # brackets, word, free (a dot between blanks) or plain


def _signs(text: str, pattern: re.Pattern) -> list[Sign]:
    out, before = [], 0
    for m in pattern.finditer(text):
        word = m[2] is not None
        look = "brackets" if m[1] else "word" if word else "free" if pattern is _DOT else "plain"
        around = _BLANKS + "_-" if word else _BLANKS
        start = before + len(text[before : m.start()].rstrip(around))
        out.append(Sign(start, (_GAPS if word else _SPACES).match(text, m.end()).end(), look))
        before = m.end()
    return out


@dataclass
class Chain:
    """Labels that dots join: (start, end, the dot before it, None for a plain one); the last that may be a top domain, after an `at` in brackets or not."""

    labels: list[tuple[int, int, Sign | None]] = field(default_factory=list)
    marked: int = -1
    unmarked: int = -1
    spoken: int = -1  # after an `at` that is a plain word


class Addresses:
    """Disguised mail addresses of a text, each as the edits that write it plainly."""

    def __init__(self, text: str):
        self.text, self.ats = text, _signs(text, _AT)
        dots = _signs(text, _DOT) if self.ats else []
        self.by_start, self.by_end = {d.start: d for d in dots}, {d.end: d for d in dots}
        self.cut = [d.start for d in dots if d.look == "word"]  # a dot between hyphens ends a label
        self.chains: dict[int, tuple[Chain, int]] = {}  # end of a label -> its chain and place there
        self.run = (0, 0)

    def label(self, at: int) -> int | None:
        """The end of the label that begins at a place."""
        if not self.run[0] <= at < self.run[1]:
            m = _LABEL.match(self.text, at)
            self.run = m.span() if m else (at, at)
        end = self.run[1]
        k = bisect_right(self.cut, at)
        if k < len(self.cut) and self.cut[k] < end:
            end = self.cut[k]
        return end if end > at else None

    def chain(self, at: int) -> tuple[Chain, int] | None:
        """The chain that begins with the label at a place; labels with the same end share it."""
        end = self.label(at)
        if end is None or end in self.chains:
            return self.chains.get(end)
        made, dot = Chain(), None
        while end is not None:
            k = len(made.labels)
            made.labels.append((at, end, dot))
            top = _TOP.match(self.text, at, end) if k else None
            if top:
                name, look = top[0].lower(), dot.look if dot else "plain"
                listed = name in TOP_DOMAINS and (name not in WORD_DOMAINS or look in ("plain", "brackets"))
                if listed:
                    made.unmarked = k
                # `at home.It was late`, `at work.is it`: a sentence that ends, not a domain
                if listed and (look == "brackets" or not top[0].istitle() and not (name in SPOKEN_DOMAINS and _GOES_ON.match(self.text, end))):
                    made.spoken = k
                if listed or look != "free":
                    made.marked = k
            if end in self.chains:  # met in the middle: what follows is known
                known, place = self.chains[end]
                made.labels += known.labels[place + 1 :]
                shift = k - place
                made.marked = max(made.marked, known.marked + shift if known.marked > place else -1)
                made.unmarked = max(made.unmarked, known.unmarked + shift if known.unmarked > place else -1)
                made.spoken = max(made.spoken, known.spoken + shift if known.spoken > place else -1)
                break
            self.chains[end] = made, k
            dot = self.by_start.get(end)
            at = dot.end if dot else end + 1 if self.text[end : end + 1] == "." else len(self.text)
            end = self.label(at) if at < len(self.text) else None
        return made, 0

    def local(self, at: int, free: int) -> tuple[int, list[Sign]]:
        """Where the local part that ends at a place begins, and the dots in it."""
        dots: list[Sign] = []
        while True:
            start, step = at, 64
            while start > free:
                low = max(free, at - step)
                start = low + len(self.text[low:at].rstrip(_LOCAL))
                if start > low:
                    break
                step *= 2
            dot = self.by_end.get(start)
            if start == at or dot is None or dot.look == "free" or dot.start <= free or self.text[dot.start - 1] not in _LOCAL:
                return start, dots
            dots.append(dot)
            at = dot.start

    def edits(self) -> Iterator[Edit]:
        free = 0
        for sign in self.ats:
            if sign.start < free:
                continue
            marked = sign.look == "brackets"
            found = self.chain(sign.end)
            if not found or (last := found[0].marked if marked else found[0].spoken if sign.look == "word" else found[0].unmarked) <= found[1]:
                continue
            start, dots = self.local(sign.start, free)
            if start == sign.start:
                continue
            labels = found[0].labels[found[1] + 1 : last + 1]
            after = [d for _, _, d in labels if d]
            if sign.look == "plain" and sign.end - sign.start == 1 and not dots and not after:
                continue  # nothing is disguised
            yield from ((d.start, d.end, ".") for d in reversed(dots))
            yield sign.start, sign.end, "@"
            yield from ((d.start, d.end, ".") for d in after)
            free = labels[-1][1]


def _octets(text: str) -> Iterator[Edit]:
    for m in _HIDDEN_IP.finditer(text):
        if not _DOTTED.fullmatch(m[0]):
            yield from ((m.start() + p.start(), m.start() + p.end(), ".") for p in _NO_DIGITS.finditer(m[0]))


def normalise(text: str) -> Tape:
    """The chain of transducers; one is left out only where the text lacks what each of its matches holds."""
    tape = Tape(text)
    if not text.isascii():
        tape = tape.rewrite(_folded(text))
    if _HAS_WORD.search(tape.text):
        tape = tape.rewrite(_spelled(tape.text))
        tape = tape.rewrite(_mixed(tape.text))
    tape = tape.rewrite(Addresses(tape.text).edits())
    return tape.rewrite(_octets(tape.text))


def all_spans(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """The plain spans and those found in the normalised text that touch none of their kind, or hold more than one."""
    tape = normalise(text)
    if tape.text == text:
        return base
    out = {}
    for kind, found in base_spans(tape.text).items():
        taken, spans = base[kind], set(base[kind])
        ends = [e for _, e in taken]
        for a, b in found:
            start, end = tape.source(a, b)
            k = bisect_right(ends, start)  # the first plain span that doesn't end before this one
            while k < len(taken) and taken[k][0] < end and start <= taken[k][0] and taken[k][1] <= end and taken[k] != (start, end):
                k += 1
            if k == len(taken) or taken[k][0] >= end:
                spans.add((start, end))
        out[kind] = sorted(spans)
    return out


def digest(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in sorted(spans[k]))


def redact(text: str, spans: dict[str, list[Span]]) -> str:
    """text with each span replaced by its kind in brackets; spans that overlap go as one, named after the longest of them (the first of equals)."""
    out, at, merged = [], 0, []
    for start, end, kind in sorted((s, e, k) for k in KINDS for s, e in spans[k]):
        if merged and start < merged[-1][1]:
            first, last, longest, name = merged[-1]
            merged[-1] = first, max(last, end), max(longest, end - start), kind if end - start > longest else name
        else:
            merged.append((start, end, end - start, kind))
    for start, end, _, kind in merged:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]]) if out else text


def find(documents: DataFrame, text: str = "text") -> DataFrame:
    """doc_id with counts and digests of the spans of each document."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, x in zip(batch["doc_id"], batch[text], strict=True):
                x = x or ""
                base = base_spans(x)
                plain = digest(base)
                every = all_spans(x, base)
                rows.append((doc_id, *(len(base[k]) for k in KINDS), hashlib.sha256(plain.encode()).hexdigest(), plain if every is base else digest(every)))
            yield pd.DataFrame(rows, columns=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]).astype({"doc_id": "Int64"})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInPandas(found, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with personal data replaced in their texts; null stays null, other columns stay as they are."""

    @F.pandas_udf("string")
    def cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([x if x is None else redact(x, all_spans(x, base_spans(x))) for x in texts], dtype=object)

    return documents.withColumn(text, cleaned(F.col(text)))
