"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss.

Patterns find emails, IP addresses, card numbers and phone numbers of the plain forms. The random field reads the zones
of a text that hold a digit, an ``@`` or an "at" that stands for one: a zone is cut into atoms (runs of letters, runs of
digits, single other characters), and a segmentation of the atoms is scored as a whole. A segment is an entity of at most
``MAX_ATOMS`` atoms with a type, or one atom outside; an entity's score is that of features of its whole span (its shape,
how many digits, checksum, ranges, neighbours). Dynamic programming over segment ends chooses boundaries and types
jointly.

The field is trained here: on zones of a bounded sample of documents that the patterns have labelled, and on made-up
entities of every kind in plain and other forms, between words of those zones, beside numbers that are no personal data.
So a kind that is rare or absent in a corpus is learned all the same. Training maximises the likelihood, with expected
features from the forward and backward sums over all segmentations. Entities that the field is sure of, and that touch
no pattern's span, are added; spans of the patterns stay.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from .shared import fresh, quoted

KINDS = ("email", "ip", "card", "phone")
MAX_ATOMS = 24
#: Bounds of the training data: documents that are drawn, zones of each, zones of all, characters and atoms of a zone,
#: made-up examples of each kind, and of what is none.
SAMPLE, SAMPLE_ZONES, ZONES, ZONE_CHARS, ZONE_ATOMS = 4000, 8, 1500, 120, 80
MADE, MADE_NONE = 600, 1500
EPOCHS = 6
#: Spans whose best kind and score a field remembers.
KNOWN = 50_000
#: Log-odds that an added entity needs.
SURE = 2.0

EMAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
DIGITS = re.compile(r"[^0-9]+")
TRIGGER = re.compile(r"[0-9@]")
#: A sign for @, as a word or not; what follows it in an address, and what stands before it, marks and words for dots
#: included. An address is looked for around a sign only, and a local part has at most 64 characters.
AT = re.compile(r"(?<![^\W_])at(?![^\W_])|@", re.I)
MARK = r"(?:[^\w\s]|_)"
DOT = rf"(?:\.| \. | dot | ?{MARK} ?(?:dot|\.) ?{MARK} ?)"
AFTER = re.compile(rf"(?: ?{MARK})? ?[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+){{1,5}}", re.I)
BEFORE = re.compile(rf"[A-Za-z0-9._%+-]+(?:{DOT}[A-Za-z0-9._%+-]+){{0,3}} ?(?:{MARK} ?)?$", re.I)
LOCAL_CHARS = 70
WORD = re.compile(r"\S*")
#: What may stand between two words of one zone.
GAP = re.compile(r"  ?(?:(?:-|\.|dot|DOT) )?")
ATOM = re.compile(r"[^\W\d_]+|[0-9]+|.", re.S)
#: An address that goes on after a span, or began before it; atoms to look at for that.
GOES_ON = re.compile(rf"(?:-|\.|(?: | ?{MARK} ?)(?:dot|\.)(?: | ?{MARK} ?))\w", re.I)
BEGAN = re.compile(rf"\w(?:[._+-]|(?: | ?{MARK} ?)dot(?: | ?{MARK} ?))$", re.I)
NEAR = 6
#: Words and characters before an entity that are read with it, for what they say about its kind.
CONTEXT_WORDS, CONTEXT_CHARS, CONTEXT_ATOMS = 3, 40, 8

# Words that announce an entity of a kind, or a number that is none; common words before "at"; hosts of
# private mail; endings of domains that aren't countries'.
CUES = {
    "email": "mail email e contact write mailto reach address inbox",
    "ip": "ip ipv4 host server ping gateway dns router firewall client node address subnet login",
    "card": "card visa mastercard amex credit debit charge charged paid payment",
    "phone": "call phone tel telephone mobile cell fax ring dial text sms whatsapp hotline reach contact extension",
    None: "page pages isbn issn order invoice version serial model article section chapter chapters part id ref item items score ratio year years population total cost price row table flight zip code lot case patent doi",
}
COMMON = frozenset("a am an and are arrive arrived at be been but eat he her here him his home i is it just know left lives live look looked looking me meet met not now on one or out people read see seen she sit stay stayed stop that the them then there they this us visit was we were who work you".split())
FREE = frozenset("gmail googlemail yahoo hotmail outlook icloud aol gmx proton protonmail".split())
TOPS = frozenset("com org net edu gov mil int info biz io dev app".split())
KINDS_OF_CUE = {w: "+".join(sorted(str(k) for k, ws in CUES.items() if w in ws.split())) for ws in CUES.values() for w in ws.split()}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if k % 2:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of the patterns, in code points, by kind and then start."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(small, m.group().split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := DIGITS.sub("", m.group())) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(DIGITS.sub("", m.group())) <= 15]
    return out


# ---------------------------------------------------------------- the random field


def zones(text: str) -> list[tuple[int, int]]:
    """Stretches of words that hold a digit or an @, joined where one follows another after a blank or two, or a mark
    or "dot" between blanks, and addresses around a spelled-out @, each with the few words before it; in order, without
    overlaps."""
    found, end = [], 0
    for m in TRIGGER.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        end = WORD.match(text, m.end()).end()
        while (gap := GAP.match(text, end)) and TRIGGER.search(w := WORD.match(text, gap.end()).group()):
            end = gap.end() + len(w)
        found.append((start, end))
    spelled = []
    for m in AT.finditer(text):
        if after := AFTER.match(text, m.end()):
            low = max(0, m.start() - LOCAL_CHARS)
            if before := BEFORE.search(text[low : m.start()]):
                spelled.append((low + before.start(), after.end()))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found + spelled) if spelled else found:
        if merged and a < merged[-1][1]:
            merged[-1] = merged[-1][0], max(b, merged[-1][1])
        else:
            merged.append((a, b))
    out: list[tuple[int, int]] = []
    for a, b in merged:
        low = out[-1][1] if out else 0
        out.append((max(low, a - len(words_before(text, max(low, a - CONTEXT_CHARS), a))), b))
    return out


def words_before(text: str, low: int, at: int) -> str:
    """The last whole words of a line before a place, no farther back than ``low``."""
    line = text[low:at].rpartition("\n")[2]
    if len(line) == at - low and low and not text[low - 1].isspace():
        line = line[len(WORD.match(line).group()) :]
    words = list(re.finditer(r"\S+", line))
    return line[words[-CONTEXT_WORDS:][0].start() :] if words else ""


def atoms(zone: str) -> list[str]:
    return ATOM.findall(zone)


def kind_of(c: str) -> str:
    return "a" if c.isalpha() else "9" if c.isdigit() else "_" if c.isspace() else c if c else "$"


def segments(parts: list[str]) -> Iterator[tuple[int, int]]:
    """Spans of atoms that may be an entity: bounded, from a letter, digit, + or ( to a letter or digit, with seven digits
    or more, four numbers, or one @ or "at"."""
    for i, first in enumerate(parts):
        if not (first[0].isalnum() or first in "+("):
            continue
        digits = numbers = at = letters = 0
        for j in range(i, min(i + MAX_ATOMS, len(parts))):
            p = parts[j]
            if p[0].isdigit():
                digits += len(p)
                numbers += 1
            at += p == "@" or (p in ("at", "AT", "At") and j > i)
            letters += p[0].isalpha() and p.lower() != "dot"
            if p[0].isalnum() and (at == 1 or (not letters and (7 <= digits <= 19 or (numbers == 4 and digits >= 4)))):
                yield i, j + 1


def cue(parts: list[str], i: int) -> str:
    """The kinds that the nearest announcing word before a span speaks for; none has the empty string."""
    for p in reversed(parts[max(0, i - CONTEXT_ATOMS) : i]):
        if (w := p.lower()) in KINDS_OF_CUE:
            return KINDS_OF_CUE[w]
    return ""


def features(parts: list[str], i: int, j: int) -> list[str]:
    """What is said of a whole span: never its characters, but how its groups of digits, marks and words are built, so
    that forms nobody made up share features with those that were."""
    span = parts[i:j]
    left, right = (parts[i - 1][-1] if i else ""), (parts[j][0] if j < len(parts) else "")
    told = cue(parts, i)
    out = ["bias", f"left={kind_of(left)}", f"right={kind_of(right)}", f"cue={told}"]
    if any(p[0].isalpha() and p.lower() != "dot" for p in span):
        return out + features_of_address(span, "".join(parts[max(0, i - NEAR) : i]), "".join(parts[j : j + NEAR]), told)
    runs = [p for p in span if p[0].isdigit()]
    digits = "".join(runs)
    marks, mark = [], ""
    for p in span:
        if not p[0].isdigit():
            mark += "dot" if p.lower() == "dot" else p
        elif mark or marks:
            marks.append(mark)
            mark = ""
        else:
            marks.append("")
    inner = marks[1:] if not span[0][0].isdigit() or marks[0] == "" else marks
    alike = "one" if len(inner) < 2 else "same" if len(set(inner)) == 1 else "tail" if len(set(inner[1:])) == 1 else "mixed"
    size = len(digits) if len(digits) < 13 else "13-15" if len(digits) < 16 else "16-19"
    lead = "+" if span[0] == "+" else "(" if span[0] == "(" else "00" if digits.startswith("00") else "0" if digits[0] == "0" else "1" if runs[0] == "1" else ""
    groups = ".".join(str(min(len(r), 8)) for r in runs) if len(runs) <= 6 else "many"
    kinds = "".join(sorted(set("".join(inner))))
    out += [f"digits={size}", f"groups={groups}", f"count={min(len(runs), 6)}", f"marks={kinds}", f"alike={alike}", f"lead={lead}", f"lead={lead}&digits={size}", f"lead={lead}&count={min(len(runs), 6)}", f"cue={told}&digits={size}", f"cue={told}&count={min(len(runs), 6)}", f"cue={told}&lead={lead}", f"groups={groups}&lead={lead}", f"alike={alike}&count={min(len(runs), 6)}", f"in={left in '.,-/_:@' and left != ''}", f"edge={right in '.,-/_:@' and right != '' and j + 1 < len(parts) and parts[j + 1][0].isalnum()}"]
    if 13 <= len(digits) <= 19:
        right_sum = luhn(digits)
        out += [f"luhn={right_sum}", f"luhn={right_sum}&alike={alike}", f"luhn={right_sum}&even={len({len(r) for r in runs[:-1]}) <= 1}", f"luhn={right_sum}&lead={lead}"]
    if len(runs) == 4:
        octets, even = all(small(p) for p in runs), alike == "same"
        out += [f"octets={octets}&{even}", f"octets={octets}&{even}&marks={kinds}", f"octets={octets}&{even}&cue={told}", f"octets={octets}&{even}&dots={'.' in kinds or 'dot' in ''.join(inner)}"]
    return out


def features_of_address(span: list[str], before: str, after: str, told: str) -> list[str]:
    """Of a span with letters: its sign for @, those for dots, what is left and right of them."""
    sign = next((k for k, p in enumerate(span) if p == "@"), None) if "@" in span else next(k for k, p in enumerate(span) if k and p.lower() == "at")

    def form(k: int) -> str:
        """Of a sign or dot: bare, between blanks, or between marks."""
        sides = ["".join(span[max(0, k - 2) : k])[::-1], "".join(span[k + 1 : k + 3])]
        spaced = [x[:1] == " " for x in sides]
        closed = [not x.lstrip()[:1].isalnum() for x in sides]
        return "closed" if all(closed) else "broken" if any(closed) else "spaced" if all(spaced) else "ragged" if any(spaced) else "bare"

    local, host = span[:sign], span[sign + 1 :]
    at = ("@" if span[sign] == "@" else "at") + form(sign)
    dots = sorted({("." if span[k] == "." else "dot") + form(k) for k in range(sign + 1, len(span)) if span[k] == "." or span[k].lower() == "dot"})
    words, names = [p.lower() for p in local if p[0].isalpha()], [p.lower() for p in host if p[0].isalnum() and p.lower() != "dot"]
    top = span[-1].lower()
    ending = "known" if top in TOPS else "two" if len(top) == 2 and top.isalpha() else "number" if top.isdigit() else "other"
    plain, free = bool(words) and words[-1] in COMMON, any(p in FREE for p in names)
    mail, dot = "email" in told, "+".join(dots)
    # blanks that belong to no sign or dot: an address has none
    loose = sum(1 for k in range(1, len(span) - 1) if span[k] == " " and not any(x in (".", "@") or x.lower() in ("at", "dot") or not (x.isalnum() or x in " _%+-") for x in (span[k - 1], span[k + 1])))
    out = [f"at={at}", f"dots={dot}", f"at={at}&dots={dot}", f"end={ending}", f"end={ending}&at={at}", f"plain={plain}&at={at}", f"free={free}&at={at}", f"mail={mail}&at={at}", f"mail={mail}&at={at}&dots={dot}&free={free}", f"names={min(len(names), 4)}", f"loose={min(loose, 2)}", f"goes on={GOES_ON.match(after) is not None}", f"began={BEGAN.search(before) is not None}"]
    return out + [f"words={min(len(words), 4)}", f"host={bool(names)}", f"begins={span[0][0].isalnum()}", f"dotted={bool(dots)}", f"plain={plain}&free={free}&mail={mail}"]


class Field:
    def __init__(self) -> None:
        self.w: dict[tuple[str, str], float] = defaultdict(float)
        self.known: dict[tuple, tuple[str, float]] = {}

    def score(self, f: list[str], kind: str) -> float:
        return sum(self.w.get((kind, x), 0.0) for x in f)

    def lattice(self, parts: list[str]) -> list[tuple[int, int, list[str]]]:
        return [(i, j, features(parts, i, j)) for i, j in segments(parts)]

    def gradient(self, n: int, lattice: list[tuple[int, int, list[str]]], gold: dict[tuple[int, int], str]) -> dict[tuple[str, str], float]:
        """Observed less expected features of one zone of n atoms."""
        edges = [(i, j, k, s, f) for i, j, f in lattice for k in KINDS for s in (self.score(f, k),)]
        to, of = defaultdict(list), defaultdict(list)
        for e in edges:
            to[e[1]].append(e)
            of[e[0]].append(e)
        forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            terms = [forward[j - 1]] + [forward[e[0]] + e[3] for e in to[j]]
            top = max(terms)
            forward[j] = top + math.log(sum(math.exp(t - top) for t in terms))
        for i in range(n - 1, -1, -1):
            terms = [backward[i + 1]] + [backward[e[1]] + e[3] for e in of[i]]
            top = max(terms)
            backward[i] = top + math.log(sum(math.exp(t - top) for t in terms))
        g: dict[tuple[str, str], float] = defaultdict(float)
        for i, j, k, s, f in edges:
            p = math.exp(min(0.0, forward[i] + s + backward[j] - forward[n]))
            d = (gold.get((i, j)) == k) - p
            if abs(d) > 1e-4:
                for x in f:
                    g[k, x] += d
        return g

    def train(self, examples: list[tuple[list[str], dict[tuple[int, int], str]]], epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-3) -> None:
        """Stochastic ascent with per-feature rates (AdaGrad)."""
        prepared = [(len(p), self.lattice(p), gold) for p, gold in examples]
        rng, squares = random.Random(3), defaultdict(float)
        for _ in range(epochs):
            rng.shuffle(prepared)
            for n, lattice, gold in prepared:
                for k, d in self.gradient(n, lattice, gold).items():
                    d -= decay * self.w[k]
                    squares[k] += d * d
                    self.w[k] += rate * d / (1e-6 + math.sqrt(squares[k]))

    def decode(self, parts: list[str]) -> list[tuple[int, int, str, float]]:
        """The best segmentation's entities with their scores."""
        n = len(parts)
        to: dict[int, list[tuple[int, str, float]]] = defaultdict(list)
        for i, j in segments(parts):
            # all that features look at; long runs hold the same spans over and over
            seen = (tuple(parts[i:j]), tuple(parts[j : j + NEAR]), tuple(parts[max(0, i - NEAR) : i]), cue(parts, i))
            if seen not in self.known:
                if len(self.known) >= KNOWN:
                    self.known.clear()
                f = features(parts, i, j)
                self.known[seen] = max(((k, self.score(f, k)) for k in KINDS), key=lambda x: x[1])
            kind, s = self.known[seen]
            if s > 0:
                to[j].append((i, kind, s))
        if not to:
            return []
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for i, kind, s in to[j]:
                if best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, (i, kind, s)
        out, j = [], n
        while j:
            if back[j]:
                i, kind, s = back[j]
                out.append((i, j, kind, s))
                j = i
            else:
                j -= 1
        return out[::-1]


def example(zone: str, spans: list[tuple[str, int, int]]) -> tuple[list[str], dict[tuple[int, int], str]] | None:
    """Atoms of a zone and the spans on them; ``None`` if a span's ends are no atoms' ends or it is too long."""
    parts = atoms(zone)
    ends = {0: 0} | {int(e): k + 1 for k, e in enumerate(np.cumsum([len(p) for p in parts]))}
    gold = {}
    for kind, a, b in spans:
        if a not in ends or b not in ends or ends[b] - ends[a] > MAX_ATOMS:
            return None
        gold[ends[a], ends[b]] = kind
    return parts, gold


def letters(rng: random.Random, low: int, high: int) -> str:
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(low, high)))


def numbers(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def made(kind: str, rng: random.Random, told: bool = False) -> str:
    """An entity of a kind in one of the forms that people write; if it is ``told``, that is announced by a word before
    it, also in forms that say little by themselves."""
    if kind == "email":
        worded = rng.random() < 0.6
        between = [".", "_", "-", ""] + [" dot ", "."] * (worded and rng.random() < 0.4)
        name = rng.choice(between).join(letters(rng, 2, 9) for _ in range(rng.choice([1, 1, 2, 2, 3]))) + rng.choice(["", "", numbers(rng, 2)])
        host, top = letters(rng, 3, 10), rng.choice([*sorted(TOPS), *(letters(rng, 2, 2) for _ in range(6))])
        if worded:
            sign = rng.choice(["at", "at", "AT", "@"])
            opened, closed = rng.choice(["()", "[]", "{}", "<>", "__", "--", "**"])
            at = rng.choice([f" {sign} ", f"{opened}{sign}{closed}", f" {opened}{sign}{closed} "])
            dot = rng.choice([" dot ", " DOT ", ".", f"{opened}dot{closed}", f" {opened}dot{closed} "])
            if at == f" {sign} ":
                dot = rng.choice([" dot ", f" {opened}dot{closed} "]) if sign != "@" else rng.choice([".", " . ", " dot "])
                if dot != "." and rng.random() < 0.25 or told and rng.random() < 0.5:
                    dot = "."
                    host = host if told and rng.random() < 0.5 else rng.choice(sorted(FREE))
        else:
            at, dot = "@", rng.choice([".", " dot ", "[.]", "(dot)"])
        return name + at + host + (dot + letters(rng, 3, 7) if rng.random() < 0.2 else "") + dot + top
    if kind == "ip":
        marks = [".", "[.]", "(.)", " . ", "[dot]", " dot ", "{.}"] + [",", "-", "_", " ", ":", "/", ", "] * told
        return rng.choice(marks).join(str(rng.randint(0, rng.choice([9, 99, 255]))) for _ in range(4))
    if kind == "card":
        n = rng.choice([13, 14, 15, 16, 16, 16, 16, 19])
        d = rng.choice("3456") + numbers(rng, n - 2)
        d += next(c for c in "0123456789" if luhn(d + c))
        cuts = [4, 10] if n in (14, 15) and rng.random() < 0.7 else rng.choice([[4, 8, 12, 16], [4, 8, 12, 16], list(range(2, 18, 2)), []])
        cuts = [c for c in cuts if c < n]
        marks = ["", " ", "-", "_", "_", "/", ":", ","] + [".", ".", "  ", " - "] * (len(cuts) < 5)
        return rng.choice(marks).join(d[a:b] for a, b in zip([0, *cuts], [*cuts, n], strict=True))
    # groups of a number at home; those that begin with the 0 of a trunk line, and the rest with a prefix or a word before
    mark, x = rng.choice([" ", " ", "-", ".", "/"]), str(rng.randint(201, 989))

    def grouped(sizes: list[int], lead: str = "") -> str:
        first = lead + numbers(rng, sizes[0] - len(lead))
        return first + (rng.choice([mark, "/", "-"]) if rng.random() < 0.3 else mark) + mark.join(numbers(rng, n) for n in sizes[1:])

    area = rng.choice([f"{x}{mark}", f"({x}) ", f"({x})", f"{x}/"])
    forms = [area + numbers(rng, 3) + rng.choice([mark, "-"]) + numbers(rng, 4)] * 3
    forms += [rng.choice(["1", "+1"]) + rng.choice([mark, " "]) + forms[0]] * 2
    abroad = grouped(rng.choice([[2, 4, 4], [1, 2, 2, 2, 2], [2, 8], [3, 6], [2, 6], [3, 3, 3], [3, 7], [2, 3, 4]]))
    forms += [rng.choice(["+", "00"]) + str(rng.randint(20, 99)) + rng.choice([" ", mark, " (0)"]) + abroad] * 2
    home = grouped(rng.choice([[2, 2, 2, 2, 2], [2, 4, 4], [3, 6], [3, 7], [4, 6], [4, 7], [5, 6], [3, 8], [4, 3, 3], [3, 3, 4]]), "0")
    forms += [home] * 2
    if told:
        forms += [f"{x}{mark}{numbers(rng, 4)}", f"{x}{mark}{numbers(rng, 4)}", str(rng.randint(2, 9)) + numbers(rng, rng.choice([6, 9, 9, 10])), grouped(rng.choice([[4, 4], [3, 3, 3], [2, 3, 4], [3, 5], [2, 7]])), "(0)" + grouped(rng.choice([[2, 6], [3, 6], [2, 4, 4]]))] * 2
    return rng.choice(forms)


def made_none(rng: random.Random) -> str:
    """What looks like an entity and is none: dates, times, sums, versions, order and book numbers, a wrong checksum,
    people at places."""
    d = numbers(rng, 16)
    while luhn(d):
        d = numbers(rng, 16)
    day, month, year = f"{rng.randint(1, 28):02d}", f"{rng.randint(1, 12):02d}", str(rng.randint(1900, 2030))
    word, place, ending = rng.choice(sorted(COMMON)), letters(rng, 3, 9), rng.choice(sorted(TOPS))
    mark = rng.choice([" ", "-", ".", "/", ":", ", "])
    forms = [
        f"{year}-{month}-{day}", f"{day}/{month}/{year}", f"{day}.{month}.{year}", f"{day} {month} {year}", f"{year}-{month}-{day} {rng.randint(0, 23)}:{rng.randint(10, 59)}", f"{rng.randint(0, 23)}:{rng.randint(10, 59)}",
        f"{rng.randint(1, 999)},{numbers(rng, 3)},{numbers(rng, 3)}.00", " ".join([str(rng.randint(1, 999)), numbers(rng, 3), rng.choice(["000", numbers(rng, 3)])]), f"{rng.randint(1, 999)},{numbers(rng, 3)},{numbers(rng, 3)}",
        d, " ".join(d[k : k + 4] for k in range(0, 16, 4)), "-".join(d[k : k + 4] for k in range(0, 16, 4)), ".".join(d[k : k + 4] for k in range(0, 16, 4)),
        numbers(rng, rng.randint(7, 12)), f"978-{rng.randint(0, 9)}-{numbers(rng, 3)}-{numbers(rng, 5)}-{rng.randint(0, 9)}", f"{rng.randint(1, 40)}.{rng.randint(0, 30)}.{rng.randint(256, 9999)}.{rng.randint(256, 9999)}",
        ".".join(str(rng.randint(256, 999)) for _ in range(4)), f"{numbers(rng, 3)}-{numbers(rng, 2)}-{numbers(rng, 4)}", f"{numbers(rng, 4)}-{numbers(rng, 4)}", f"{numbers(rng, 5)} {numbers(rng, 5)}", f"{numbers(rng, 5)}-{numbers(rng, 4)}", f"{year}{mark}{int(year) + rng.randint(1, 9)}",
        mark.join(str(rng.randint(1, 99)) for _ in range(4)), mark.join(str(rng.randint(100, 999)) for _ in range(rng.randint(3, 5))), mark.join(str(int(year) + k) for k in range(rng.randint(2, 5))), f"{rng.randint(1, 9)} {rng.randint(1, 99)} {rng.randint(100, 999)} {rng.randint(1000, 9999)}",
        f"@{letters(rng, 3, 9)}", f"{letters(rng, 3, 6)} at {rng.randint(1, 12)} dot", f"{letters(rng, 3, 6)} @ {rng.randint(1, 12)}", f"v{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}",
        f"{word} at {place}.{ending}", f"{word} at {place} dot {ending}", f"{word} at {place}.{rng.choice(sorted(COMMON))}", f"{letters(rng, 3, 8)} at {place}.{ending}", f"{letters(rng, 3, 8)} at {place}.{letters(rng, 3, 7)}", f"{word} {letters(rng, 3, 8)} at {place} dot",
        f"{rng.randint(1000, 9999)} {rng.randint(1000, 9999)} {rng.randint(1000, 9999)}", f"{numbers(rng, 2)} {numbers(rng, 2)} {numbers(rng, 2)} {numbers(rng, 3)}", " ".join(str(rng.randint(10, 99)) for _ in range(rng.randint(4, 6))),
    ]
    return rng.choice(forms)


def announced(kind: str | None, rng: random.Random) -> str:
    """A word that announces a kind, and how it goes on."""
    word = rng.choice(CUES[kind].split())
    return rng.choice(["", "my ", "the "]) + rng.choice([word, word.capitalize()]) + rng.choice([" ", " ", ": ", ":", ". ", " is ", " number ", " me on ", " us at " if kind != "email" else " "])


def examples_made(words: list[str], rng: random.Random, per_kind: int, none: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """``(zone, spans)``: made-up entities and others, between words or marks, some announced by a word before them, and
    numbers announced as none that are built like entities."""
    out = []
    for kind in [k for k in (*KINDS, None) for _ in range(per_kind if k else none)]:
        told, some = rng.random() < 0.4, " ".join(rng.choices(words, k=rng.randint(1, 3))) + " "
        if kind:
            text = made(kind, rng, told)
            before = announced(kind, rng) if told else rng.choice(["", some, some, some, "(", '"', "id:", rng.choice(words) + ":", "<", *(announced(rng.choice(KINDS), rng) for _ in range(4))])
        else:
            built = told and rng.random() < 0.4
            text = made(rng.choice(["phone", "ip"]), rng, True) if built else made_none(rng)
            if built and (base_spans(text) or text[0] in "+("):
                text = made_none(rng)
            before = announced(None, rng) if told else rng.choice(["", some, some, some, "(", '"', "<"])
        after = rng.choice(["", "", ".", ",", ")", ";", '"', ">", ":"]) + rng.choice(["", "", " " + rng.choice(words)])
        out.append((before + text + after, [(kind, len(before), len(before) + len(text))] if kind else []))
    return out


def train_field(texts: list[str]) -> Field:
    rng, examples = random.Random(11), []
    for zone in texts:
        if x := example(zone, base_spans(zone)):
            examples.append(x)
    words = sorted({w for zone in texts for w in re.findall(r"[^\W\d_]+", zone)})[:2000] or ["number"]
    examples += [x for zone, spans in examples_made(words, rng, MADE, MADE_NONE) if (x := example(zone, spans))]
    field = Field()
    field.train([e for e in examples if len(e[0]) <= ZONE_ATOMS])
    field.w = {k: v for k, v in field.w.items() if abs(v) > 1e-4}
    return field


def added_spans(text: str, base: list[tuple[str, int, int]], field: Field) -> list[tuple[str, int, int]]:
    if not field.w:
        return []
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    out = []
    for a, b in zones(text):
        parts = atoms(text[a:b])
        if len(parts) < 2:
            continue
        found = field.decode(parts)
        if found:
            ends = [0, *np.cumsum([len(p) for p in parts]).tolist()]
            for i, j, kind, s in found:
                x, y = a + ends[i], a + ends[j]
                k = bisect_left(starts, y)
                if s >= SURE and not any(p < y and x < q for p, q in taken[max(0, k - 4) : k]):
                    out.append((kind, x, y))
    return out


def spans_of(text: str | None, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The patterns' spans and all spans, each by kind and then start."""
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + added_spans(text, base, field), key=lambda s: (KINDS.index(s[0]), s[1]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ---------------------------------------------------------------- on tables


def learn(docs: DataFrame, size: int = SAMPLE) -> Field:
    """A field trained on at most ``size`` documents and ``SAMPLE_ZONES`` zones of each, taken from all over the text."""
    chosen = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)

    @pandas_udf(ArrayType(StringType()))
    def some(text: pd.Series) -> pd.Series:
        def pick(t: str | None) -> list[str]:
            z = [(t or "")[a : min(b, a + ZONE_CHARS)] for a, b in zones(t or "")]
            return [z[k] for k in np.linspace(0, len(z) - 1, min(len(z), SAMPLE_ZONES)).astype(int)] if z else []

        return text.map(pick)

    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``size`` rows
    # zones are made distinct and cut to ZONES before they are collected: an id may have any number of rows
    one = met.select(F.explode(some("text")).alias("zone")).distinct()
    found = one.select("zone", F.md5("zone").alias("h")).orderBy("h", "zone").limit(ZONES).collect()
    return train_field([r["zone"] for r in found])


def find_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of ``struct(kind, start, end)``, by kind and then start.

    A null or empty text has none. Texts of any length are read whole. Repeated rows come back as often as they occur.
    Columns of the table that are named ``base`` or ``spans`` give way to these. An empty table gives no rows.
    """
    field = field or learn(docs)
    shared = docs.sparkSession.sparkContext.broadcast(dict(field.w))
    one = "array<struct<kind:string,start:long,end:long>>"

    def both(text: pd.Series) -> pd.DataFrame:
        f = Field()
        f.w = shared.value
        found = [spans_of(t, f) for t in text]
        return pd.DataFrame({"base": [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x, _ in found], "spans": [[{"kind": k, "start": a, "end": b} for k, a, b in y] for _, y in found]})

    both.__annotations__ = {"text": pd.Series, "return": pd.DataFrame}
    udf = pandas_udf(both, f"base {one}, spans {one}")
    others = [c for c in docs.columns if c not in ("base", "spans")]
    name = fresh("_pii", others)
    out = docs.select(*[F.col(quoted(c)) for c in others], udf(F.coalesce("text", F.lit(""))).alias(name))
    return out.select(*[F.col(quoted(c)) for c in others], F.col(quoted(name))["base"].alias("base"), F.col(quoted(name))["spans"].alias("spans"))


def mask(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first one counts."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"[{kind.upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]]) if out else text


def mask_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced by ``[EMAIL]``, ``[IP]``, ``[CARD]`` or ``[PHONE]``, and
    ``n_chars``, if there is such a column, counted anew. Null and empty texts stay as they are, texts of any length are
    read whole, and no row is dropped, repeated ones included. An empty table gives no rows; all other columns stay."""
    field = field or learn(docs)
    shared = docs.sparkSession.sparkContext.broadcast(dict(field.w))

    @pandas_udf(StringType())
    def masked(text: pd.Series) -> pd.Series:
        f = Field()
        f.w = shared.value
        return text.map(lambda t: mask(t, spans_of(t, f)[1]) if t else t)

    out = docs.withColumn("text", masked("text"))
    return out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
