"""Personal data: patterns, and a semi-Markov conditional random field that finds what they miss.

The model scores whole candidate segments (their shape, digits, checksums and surroundings) and picks
the best segmentation of a zone by dynamic programming over entities of bounded length, so boundaries
and types are chosen together. It is trained here, on sentences made up from a seed.
"""

from __future__ import annotations

import functools
import math
import random
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
#: The base patterns. Look-behinds and possessive repeats keep them linear and change no match.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){2}\.[0-9]+")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|[(\[][aA][tT][)\]]")


def luhn(digits: str) -> bool:
    d = [int(c) for c in digits[::-1]]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def octet(digits: str) -> bool:
    """Whether the number is at most 255, however many zeros lead it."""
    n = digits.lstrip("0")
    return len(n) <= 3 and int(n or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the patterns that hold, leftmost and not overlapping within a kind, by kind and start."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(octet(p) for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(d := only_digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(only_digits(m[0])) <= 15]
    return out


# The model

TOKEN = re.compile(r"[^\x20\x09-\x0D()\[\]{}<>,;:!?\"'|#=$&*/]+|[()\[\]{}<>,;:!?\"'|#=$&*/]")
LONGEST = 10  # tokens of an entity
OUTSIDE = "outside"


def tokenize(text: str, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    """Tokens of text[start:end]: runs, and single marks; full stops that end a run are tokens of their own."""
    out = []
    for m in TOKEN.finditer(text, start, len(text) if end is None else end):
        a, b = m.span()
        c = b
        while c > a + 1 and text[c - 1] == ".":
            c -= 1
        out.append((a, c))
        out += [(i, i + 1) for i in range(c, b)]
    return out


def shape(s: str) -> str:
    """Runs of digits with their length, runs of letters and of blanks as one sign, the rest as it is."""
    s = re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 20):02d}", re.sub(r"\s+", "_", re.sub(r"[^\W\d_]+", "a", s)))
    return s if len(s) <= 40 else s[:40] + "~"


def segment_features(text: str, toks: list[tuple[int, int]], i: int, j: int) -> list[str]:
    """Features of the whole span of tokens i .. j - 1."""
    a, b = toks[i][0], toks[j - 1][1]
    s = text[a:b]
    d = only_digits(s)
    before = text[toks[i - 1][0] : toks[i - 1][1]].lower()[:12] if i and toks[i - 1][1] > a - 3 else ""
    left, right = text[a - 1 : a], text[b : b + 1]
    edge = lambda c: "none" if not c else "blank" if c.isspace() else "word" if c.isalnum() else c if c in "+#=$.@/-_:\"" else "mark"
    parts = s.split(".")
    f = [f"shape={shape(s)}", f"digits={min(len(d), 20)}", f"tokens={j - i}", f"left={edge(left)}", f"right={edge(right)}", f"before={before}" if before.isalpha() else "before="]
    f.append(f"letters={min(3, sum(c.isalpha() for c in s))}")
    f.append(f"at={min(2, s.count('@'))}")
    f.append(f"marks={''.join(sorted(set(re.sub(r'[\w\s]', '', s))))[:6]}")
    f.append(f"open={s[0] in '+('},{s.count('(') - s.count(')')}")
    if 13 <= len(d) <= 19:
        f.append(f"luhn={luhn(d)},{len(d)}")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts):
        f.append(f"octets={all(len(p) <= 3 and int(p) <= 255 for p in parts)}")
    if re.fullmatch(r"[\w.+-]+\s?[(\[]\s?at\s?[)\]]\s?[\w-]+(\s?[(\[]\s?dot\s?[)\]]\s?|\.)[A-Za-z]{2,}", s, re.IGNORECASE):
        f.append("spelt")
    if d and len(d) < len(s) and not any(c.isalpha() for c in s):
        f.append(f"groups={'-'.join(str(min(len(g), 5)) for g in re.findall('[0-9]+', s))}")
    return f


class Lattice:
    """All segments of a zone: single tokens outside, and spans of up to LONGEST tokens of each kind."""

    def __init__(self, text: str, toks: list[tuple[int, int]]):
        self.text, self.toks, self.n = text, toks, len(toks)
        self.ending: list[list[tuple[int, str, list[str]]]] = [[] for _ in range(self.n + 1)]
        for i in range(self.n):
            for j in range(i + 1, min(self.n, i + LONGEST) + 1):
                f = segment_features(text, toks, i, j)
                if j == i + 1:
                    self.ending[j].append((i, OUTSIDE, f))
                s = text[toks[i][0] : toks[j - 1][1]]
                if "\n" in s or not re.search(r"[0-9@]|at", s):
                    continue
                self.ending[j] += [(i, k, f) for k in KINDS]


def weight_of(w: dict, kind: str, f: list[str]) -> float:
    return sum(w.get((kind, x), 0.0) for x in f)


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b > -1e290 else a


def _sums(x: Lattice, scores: list[list[float]]) -> tuple[list[float], list[float]]:
    """Log sums over segmentations of what ends, and of what starts, at each place."""
    fore, back = [0.0] + [-1e300] * x.n, [-1e300] * x.n + [0.0]
    for j in range(1, x.n + 1):
        for (i, _, _), s in zip(x.ending[j], scores[j], strict=True):
            fore[j] = _log_add(fore[j], fore[i] + s)
    for j in range(x.n, 0, -1):
        for (i, _, _), s in zip(x.ending[j], scores[j], strict=True):
            back[i] = _log_add(back[i], back[j] + s)
    return fore, back


def decode(x: Lattice, w: dict, sure: float) -> list[tuple[str, int, int]]:
    """The best segmentation's entities (kind, start, end) whose probability is `sure` or more."""
    scores = [[weight_of(w, k, f) for _, k, f in e] for e in x.ending]
    best, via = [0.0] + [-1e300] * x.n, [None] * (x.n + 1)
    for j in range(1, x.n + 1):
        for (i, k, _), s in zip(x.ending[j], scores[j], strict=True):
            if best[i] + s > best[j]:
                best[j], via[j] = best[i] + s, (i, k, s)
    out, j = [], x.n
    found = []
    while j:
        i, k, s = via[j]
        if k != OUTSIDE:
            found.append((i, j, k, s))
        j = i
    if found:
        fore, back = _sums(x, scores)
        out = [(k, x.toks[i][0], x.toks[j - 1][1]) for i, j, k, s in found if math.exp(fore[i] + s + back[j] - fore[x.n]) >= sure]
    return out[::-1]


def decode_zone(text: str, zone: list[tuple[int, int]], w: dict, sure: float, piece: int = 256) -> list[tuple[str, int, int]]:
    """The entities of a zone of any length, `piece` tokens at a time.

    An entity that the edge of a piece could cut is left to the next piece, which begins before it.
    """
    out, s = [], 0
    while s < len(zone):
        part = zone[s : s + piece]
        found = decode(Lattice(text, part), w, sure)
        if s + piece >= len(zone):
            return out + found
        s += piece - LONGEST
        whole = [x for x in found if x[1] < zone[s][0]]
        while whole and s < len(zone) and zone[s][0] < whole[-1][2]:
            s += 1
        out += whole
    return out


def zones(text: str, taken: list[tuple[int, int]], reach: int = 60) -> list[list[tuple[int, int]]]:
    """Tokens around digits, @ and spelt-out at signs, up to a few tokens away; tokens in taken spans break a zone."""
    windows: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - reach), min(len(text), m.end() + reach)
        if windows and a <= windows[-1][1]:
            windows[-1][1] = max(b, windows[-1][1])
        else:
            windows.append([a, b])
    taken, out, at, low = sorted(taken), [], 0, 0
    for a, b in windows:
        first, last = a, b
        while a > low and not text[a - 1].isspace() and first - a < 100:  # whole words, but for very long ones
            a -= 1
        while b < len(text) and not text[b].isspace() and b - last < 100:
            b += 1
        low = b
        if b <= a:
            continue
        toks, free = tokenize(text, a, b), []
        for s, e in toks:
            while at < len(taken) and taken[at][1] <= s:
                at += 1
            free.append(at >= len(taken) or taken[at][0] >= e)
        hot = [ok and bool(TRIGGER.search(text, s, e) or text[s:e].lower() == "at" and text[s - 1 : s] in ("(", "[")) for (s, e), ok in zip(toks, free, strict=True)]
        near = [any(hot[max(0, k - 7) : k + 8]) for k in range(len(toks))]
        zone: list[tuple[int, int]] = []
        for t, ok, close in zip(toks, free, near, strict=True):
            if ok and close:
                zone.append(t)
            elif zone:
                out.append(zone)
                zone = []
        if zone:
            out.append(zone)
    return out


def find(text: str, w: dict, sure: float = 0.9) -> list[tuple[str, int, int, bool]]:
    """All spans (kind, start, end, base) in code points, end exclusive, by kind and start."""
    if not TRIGGER.search(text):
        return []
    base = base_spans(text)
    more = [s for z in zones(text, [x[1:] for x in base]) for s in decode_zone(text, z, w, sure)] if w else []
    return sorted([(*x, True) for x in base] + [(*x, False) for x in more], key=lambda x: (KINDS.index(x[0]), x[1:]))


# Training

def _entity(r: random.Random, kind: str) -> str:
    digits = lambda n: "".join(r.choices("0123456789", k=n))
    word = lambda: "".join(r.choices("abcdefghijklmnoprstuvwz", k=r.randrange(3, 9)))
    if kind == "email":
        at, dot = r.choice([("@", ".")] + 2 * [(" [at] ", " [dot] "), (" (at) ", " (dot) "), (" (at) ", "."), (" [at] ", "."), ("[at]", "[dot]"), ("(at)", "(dot)"), ("(at)", ".")])
        return word() + r.choice(["", "." + word(), "." + digits(2), digits(2)]) + at + word() + dot + r.choice(["com", "org", "net", "de", "fr", "es"])
    if kind == "ip":
        return ".".join(str(r.randrange(256)) for _ in range(4))
    if kind == "card":
        n = r.choice([16, 16, 15])
        d = r.choice("3456") + digits(n - 2)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = r.choice(["", " ", "-", ".", "/", " - "])
        cuts = [4, 8, 12] if n == 16 else [4, 10]
        return sep.join(d[a:b] for a, b in zip([0, *cuts], [*cuts, n], strict=True))
    a, b, c = digits(3), digits(3), digits(4)
    return r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b}-{c}", f"+1-{a}-{b}-{c}", f"+1.{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"1 ({a}) {b}-{c}", f"+49/30/{digits(7)}", f"+1/{a}/{b}/{c}"])


def _decoy(r: random.Random) -> str:
    """What looks like personal data and is not."""
    digits = lambda n: "".join(r.choices("0123456789", k=n))
    d = r.choice("3456") + digits(14)
    wrong = d + r.choice([c for c in "0123456789" if not luhn(d + c)])
    return r.choice([
        digits(r.randrange(1, 8)), digits(r.randrange(8, 13)), f"{digits(1)}.{digits(1)}", f"v{digits(1)}.{digits(2)}.{digits(1)}", f"20{digits(2)}-0{digits(1)}-1{digits(1)}", f"1{digits(1)}/0{digits(1)}/20{digits(2)}",
        f"{digits(1)},{digits(3)}.{digits(2)}", f"${digits(3)}.{digits(2)}", f"1{digits(1)}:{digits(2)}", f"19{digits(2)}-20{digits(2)}", wrong, " ".join(wrong[i : i + 4] for i in range(0, 16, 4)),
        "".join(r.choices("0123456789abcdef", k=r.choice([8, 16, 32, 40]))), f'token = "{"".join(r.choices("0123456789abcdef", k=40))}"', f"password={''.join(r.choices('0123456789abcdef', k=24))}", f"CC BY-NC {digits(1)}.0",
        f"{r.randrange(300, 999)}.{r.randrange(300, 999)}.{digits(3)}.{digits(3)}", ".".join(digits(2) for _ in range(5)), ".".join(digits(1) for _ in range(3)), f"AKIA{digits(16)}", f"page {digits(2)}", f"{digits(3)} {digits(3)}", f"{digits(3)}-{digits(3)}",
        f"{digits(2)} (at) {digits(2)}", "look (at) this", "@", "@ " + digits(2), f"#{digits(6)}", f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", f"{digits(4)}-{digits(4)}", f"({digits(4)})", f"({digits(1)})", f"[{digits(2)}]", f"{digits(2)}%", f"{digits(4)}x{digits(4)}",
        f"{digits(5)}-{digits(4)}", f"{digits(3)}-{digits(2)}-{digits(4)}", f"id {digits(10)}", digits(20), digits(r.randrange(13, 18)) + "7.5",
    ])


def examples(seed: int, n: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Sentences with personal data in the forms of the patterns and in others, decoys, and plain words."""
    r, out = random.Random(seed), []
    for _ in range(n):
        text, gold = "", []
        for _ in range(r.randrange(1, 3)):
            text += " ".join("".join(r.choices("abcdefghilmnoprstuéä", k=r.randrange(2, 8))) for _ in range(r.randrange(0, 4))) + r.choice([" ", " ", " ", " (", ": ", ", ", "\n"]) if r.random() < 0.9 else ""
            if r.random() < 0.5:
                k = r.choice(KINDS)
                e = _entity(r, k)
                gold.append((k, len(text), len(text) + len(e)))
                text += e
            else:
                text += _decoy(r)
            text += r.choice([" ", " ", " ", ". ", ", ", ") ", ".\n", "; "])
        out.append((text + "".join(r.choices("abcdehilmnorst", k=4)), gold))
    return out


@functools.lru_cache(maxsize=4)
def _trained(seed: int, n: int, epochs: int, rate: float, ridge: float) -> tuple:
    made = []
    for text, gold in examples(seed, n):
        for z in zones(text, []):
            x = Lattice(text, z)
            at = {(s, e): k for k, s, e in gold}
            inside = {i for _, s, e in gold for i in range(s, e)}
            right = {(i, j) for j in range(1, x.n + 1) for i, k, _ in x.ending[j] if k == at.get((x.toks[i][0], x.toks[j - 1][1]), OUTSIDE) and (k != OUTSIDE or x.toks[i][0] not in inside)}
            covered = {i for i, j in right for i in range(i, j)}
            if len(covered) == x.n:  # no entity is cut by the zone's edge
                made.append((x, {(i, j, at.get((x.toks[i][0], x.toks[j - 1][1]), OUTSIDE)) for i, j in right}))
    w: dict[tuple[str, str], float] = {}
    seen: dict[tuple[str, str], float] = {}  # squared gradients, for the steps
    r = random.Random(seed)
    for _ in range(epochs):
        r.shuffle(made)
        for x, right in made:
            scores = [[weight_of(w, k, f) for _, k, f in e] for e in x.ending]
            fore, back = _sums(x, scores)
            grad: dict[tuple[str, str], float] = {}
            for j in range(1, x.n + 1):
                for (i, k, f), s in zip(x.ending[j], scores[j], strict=True):
                    g = ((i, j, k) in right) - math.exp(min(0.0, fore[i] + s + back[j] - fore[x.n]))
                    if abs(g) > 1e-4:
                        for name in f:
                            grad[k, name] = grad.get((k, name), 0.0) + g
            for key, g in grad.items():
                g -= ridge * w.get(key, 0.0)
                seen[key] = seen.get(key, 0.0) + g * g
                w[key] = w.get(key, 0.0) + rate * g / math.sqrt(seen[key] + 1e-8)
    return tuple((k, round(v, 4)) for k, v in sorted(w.items()) if abs(v) > 1e-3)


def train(seed: int = 7, n: int = 900, epochs: int = 4, rate: float = 0.3, ridge: float = 1e-3) -> dict[tuple[str, str], float]:
    """Weights by kind and feature, fitted by conditional likelihood to n made-up sentences; the same every time."""
    return dict(_trained(seed, n, epochs, rate, ridge))


def pii_spans(text: Column, weights: dict, sure: float = 0.9) -> Column:
    """All spans of a whole text, in code points, by kind and start; base tells the patterns' spans from the model's.

    The model adds spans where no base span is; base spans always stay. A null text is empty: no spans. Equal
    rows have equal spans, ties between segmentations go to the one met first, no rows give none, and a long
    text is read whole: the model works on zones around its digits and @ signs, whose tokens are bounded.
    """

    @F.arrow_udf(SPANS)
    def of(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        return pa.array([[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in find(t or "", weights, sure)] for t in texts.to_pylist()], kind)

    return of(text)


def covered(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span (kind, start, end) replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    out, at = [], 0
    for kind, a, b in merged:
        out += [text[at:a], f"<{kind}>"]
        at = b
    return "".join([*out, text[at:]])


def redact(text: Column, weights: dict, sure: float = 0.9) -> Column:
    """The whole text with each span that pii_spans() finds covered; null stays null. Found and covered in one pass, by one worker a task."""

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([t and covered(t, [x[:3] for x in find(t, weights, sure)]) for t in texts.to_pylist()], pa.string())

    return of(text)
