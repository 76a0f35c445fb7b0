"""Sentence boundaries in any language and script (problem 6), by a hidden-event n-gram language model.

Between words the model sees an event, boundary or none; in scripts written without spaces, between any two characters. Blank lines and list lines always end a unit. For every other event
it compares two continuations: the left token before a boundary token and the right tokens after one, against the same tokens running on. A terminal mark is what a boundary usually
shows itself by. Two models share the work:

* At a mark, the left token with its mark and the right tokens tell whether the mark ends a sentence. Tokens that are too rare speak through their class.
* Where there is no mark, n-grams with boundary tokens tell: how often the left tokens end a sentence, and how often the right ones start one, against how often they stand anywhere. A boundary without
  mark is as likely as the text's own marks leave room for: next to impossible in a text that has its marks, even odds in one that has none. Where it is so unlikely
  that no pair of tokens could make up for it, the place isn't looked at: its posterior is known to be below one half.

Events close to each other are tied, so posteriors come from a forward and a backward pass over the events of a unit.

Nothing is labelled. Units show how sentences start and end, tokens without a mark how they run on; expectation-maximisation does the rest. All counts cover all texts: places of the same
tokens are one row with a count, and every round of the expectation runs over these rows where they lie. The model holds the VOCAB most frequent entries of each table.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.session import materialize

#: Entries of each table of the model; rounds; entries that a task counts before it passes them on.
VOCAB, ROUNDS, FLUSH = 1 << 16, 3, 1 << 19
SEP = "\x1f"
CLOSERS = "\"'”’»)\\]』」）》〉】“"
BLOCK = re.compile(r"(?:[^\S\n]*\r?\n){2,}|[^\S\n]*\r?\n(?=- )|(?<=\n)(?=- )")
SPACED = re.compile(rf"(?:[.!?…‽؟।॥۔;;]+)(?:[{CLOSERS}]|[   ](?=»)|[  ])*(?=\s|$)|[。！？｡]+[{CLOSERS}]*")
BARE = re.compile(r"(?<=[฀-໿က-႟ក-៿])(?=[ \t]+[฀-໿က-႟ក-៿])")
BARE_LETTER = re.compile(r"[฀-໿က-႟ក-៿]")
RIGHT = re.compile(r"\s*([\"'“”„«»‘’‚(\[「『（《—–¿¡-]*)\s*([^\W_]+)?(?:[^\S\n]|\n)*(\S+)?")
HAN = re.compile(r"[぀-ヿ㐀-鿿]")
UNSPACED = re.compile(f"{HAN.pattern}|{BARE_LETTER.pattern}")
#: A word, or one character of a script without spaces with its marks.
TOKEN = regex.compile(r"[぀-ヿ㐀-鿿]|[฀-໿က-႟ក-៿]\p{M}*|[^\W_぀-ヿ㐀-鿿฀-໿က-႟ក-៿]+(?:['’-][^\W_぀-ヿ㐀-鿿฀-໿က-႟ក-៿]+)*")
PLAIN = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
GAP = re.compile(r"[\s\"'“”„«»‘’(\[「」『』]*")
#: Log odds that tokens can add at a place without mark, at most, and the chance of a boundary without mark in a text that has its marks.
MOST, STRAY = 8.0, 1e-4


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """Units that no sentence crosses: paragraphs, and single lines that start a list item."""
    at = 0
    for m in BLOCK.finditer(text):
        if text.startswith("- ", at) and text.find("\n", at, m.start()) >= 0:
            line = text.find("\n", at, m.start())
            yield at, line
            at = line + 1
        yield at, m.start()
        at = m.end()
    if text.startswith("- ", at) and (line := text.find("\n", at)) >= 0:
        yield at, line
        at = line + 1
    yield at, len(text)


def _left(token: str) -> tuple[str, str]:
    """The token ahead of the place, normalised, and its class."""
    core = token.rstrip("\"'”’»)]』」）》“   ")
    closed = len(core) < len(token)
    word = core.rstrip(".!?…‽؟।॥۔;;。！？｡៕។။")
    mark = core[len(word) :]
    word = word.lstrip("\"'“„«‘‚([「『（《—–")
    kind = "e" if "…" in mark or mark.startswith("..") else "q" if set(mark) & set("?!‽؟？！;;") else "d" if set(mark) & set("।॥۔。｡៕។။") else "p" if mark else "n"
    if not word:
        shape = "0"
    elif word[-1].isdigit():
        shape, word = "9", "9"
    elif len(word) == 1:
        shape = "i" if word.isupper() else "s"
    elif "." in word:
        shape = "a"
    elif HAN.search(word):
        shape, word = "h", word[-2:]
    else:
        shape = "s" if len(word) <= 3 else "m" if len(word) <= 5 else "l"
        if word[:1].isupper():
            shape = shape.upper()
    return word.lower() + mark[:1], kind + shape + ("c" if closed else "")


def _right(text: str, at: int, end: int) -> tuple[str, str, str]:
    """The token after the place, its class, and the token after that."""
    m = RIGHT.match(text, at, end)
    opener, word, more = m[1], m[2], m[3] or ""
    if word is None:
        return opener, "o" if opener else "x", ""
    if HAN.match(word):
        return word[:2], "h" + ("o" if opener else ""), word[2:4]
    if h := HAN.search(word):
        return "A", "A" + ("o" if opener else ""), word[h.start() : h.start() + 2]
    first = word[0]
    if len(word) == 1 and first.isupper() and more.startswith(".") is False and text[m.end(2) : m.end(2) + 1] == ".":
        return "<I>", "I" + ("o" if opener else ""), ""
    shape = "9" if first.isdigit() else "U" if first.isupper() else "l" if first.islower() else "u"
    if "¿" in opener or "¡" in opener:
        shape = "O"
    elif opener and opener[0] in "—–-":
        shape += "-"
    elif opener:
        shape += "o"
    return ("9" if first.isdigit() else word), shape, more.strip(",.!?;:\"'”’»)")


def script(token: str) -> str:
    """Group of scripts whose tokens are counted together."""
    for ch in token:
        if ch.isalpha():
            c = ord(ch)
            return "L" if c < 0x370 else "G" if c < 0x400 else "C" if c < 0x530 else "A" if 0x590 <= c < 0x780 else "D" if 0x900 <= c < 0xE00 else "S" if BARE_LETTER.match(ch) else "H" if 0x3040 <= c < 0xA000 else "?"
    return "L"


def _before(text: str, lo: int, at: int) -> str:
    """The token that ends at a place, from `lo` on."""
    part = text[lo:at]
    return part.rsplit(None, 1)[-1] if part and not part[-1].isspace() else ""


def places(text: str, lo: int, hi: int, cased: bool = True) -> list[tuple[int, str, str, str, str, str]]:
    """(place, left, its class, right, its class, second right) of every place in a block with a terminal mark, or a space in a script that has none; the block's end is none.

    A text that has no capitals at all is not `cased`: its words then count as in scripts without.
    """
    out = []
    since = lo
    for m in SPACED.finditer(text, lo, hi):
        at = m.end()
        if at >= hi or not text[at:hi].strip():
            continue
        if text[m.start()] in ";;" and not ("Ͱ" <= text[m.start() - 1 : m.start()] <= "Ͽ" or "ἀ" <= text[m.start() - 1 : m.start()] <= "῿"):
            continue
        left, kind = _left(_before(text, since, m.start()) + m[0])
        out.append((at, left, kind, *_right(text, at, hi)))
        since = at
    if BARE.search(text, lo, hi):
        for m in BARE.finditer(text, lo, hi):
            out.append((m.start(), *_left(_before(text, lo, m.start())), *_right(text, m.start(), hi)))
        out.sort()
    if not cased:
        out = [(at, left, kind, r, "v" + shape[1:] if shape[0] == "l" else shape, more) for at, left, kind, r, shape, more in out]
    return out


def group_of(token: str) -> str:
    """H for Han and kana, S for scripts without spaces and marks, L for all that part words by spaces."""
    return "H" if HAN.match(token) else "S" if BARE_LETTER.match(token) else "L"


def tokens_of(text: str, lo: int, hi: int) -> list[tuple[int, int, str]]:
    """(start, end, token) of the words and single characters of a block, lower-cased."""
    return [(m.start(), m.end(), m[0].lower()) for m in TOKEN.finditer(text, lo, hi)]


def grams(tokens: list[tuple[int, int, str]]) -> tuple[list[str], list[str]]:
    """What stands for the left side of the place after each token, and for the right side of the place before it: the word, or two characters."""
    left, right = [], []
    last = len(tokens) - 1
    for i, (a, b, t) in enumerate(tokens):
        if group_of(t) == "L":
            left.append(t)
            right.append(t)
        else:
            left.append(tokens[i - 1][2] + t if i and tokens[i - 1][1] == a else t)
            right.append(t + tokens[i + 1][2] if i < last and tokens[i + 1][0] == b else t)
    return left, right


def _guess(kind: str, shape: str) -> float:
    """Where expectation-maximisation starts: the chance of a boundary by the classes alone."""
    if kind[0] in "qd" and "c" not in kind:  # a mark that no abbreviation has
        return 0.98
    if kind[0] == "e" and shape[0] in "UIO":
        return 0.95
    if shape[0] == "l":
        return 0.01 if "o" not in shape else 0.2
    if shape[0] == "O" or (shape == "ho" and kind[0] in "qd"):
        return 0.98
    if shape in ("9", "x"):
        return 0.1 if kind[0] == "p" and kind[1] != "l" else 0.6
    if kind[0] == "n":
        return 0.3
    if kind[0] in "qd":
        return 0.7 if "c" in kind else 0.98
    if kind[0] == "e":
        return 0.85
    if kind[1] in "ia":
        return 0.2
    if kind[1] in "sS":
        return 0.6
    return 0.9


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def _evidence(n: float, k: float, rate: float) -> float:
    """How much k paragraph edges among n places speak for a token that stands at sentence edges (which then is at `rate` n paragraph edges) against one that doesn't."""
    if not rate:
        return 0.0
    stray = rate / 40
    return max(-8.0, min(3.0, k * math.log(rate / stray) - (rate - stray) * n))


class EventModel:
    """Log-odds of a boundary: P(boundary | left) P(right | boundary) against P(none | left) P(right | left, none)."""

    def __init__(self) -> None:
        self.prior: dict[str, float] = {}
        self.pair: dict[tuple[str, str], float] = {}
        self.edges_left: dict[str, float] = {}
        self.edges_right: dict[str, float] = {}
        self.left: dict[str, float] = {}
        self.start: dict[tuple[str, str], float] = {}
        self.starts: dict[str, tuple[float, int]] = {}
        self.start_class: dict[tuple[str, str], float] = {}
        self.run: dict[tuple[str, str], float] = {}
        self.runs: dict[str, float] = {}
        self.run_class: dict[tuple[str, str], float] = {}
        self.kinds_after: dict[str, int] = {}
        self.run_all: dict[str, float] = {}
        self.share: dict[str, float] = {}
        self.names: set[str] = set()
        self.tied = math.log(0.05)
        # n-grams with boundary tokens, for places without mark: how often a token stands, ends and starts sentences; tokens and boundaries of each group of scripts
        self.seen: dict[str, float] = {}
        self.ending: dict[str, float] = {}
        self.opening: dict[str, float] = {}
        self.total: dict[str, float] = {}
        self.bounds: dict[str, float] = {}

    def token(self, right: str, shape: str, more: str) -> str:
        """What stands for the right side: the token, or for names and other rare capitals the one after it."""
        if shape[0] == "A" or (shape[0] == "U" and right not in self.names):
            return f"U:{more}"
        return right

    def odds(self, site: tuple) -> float:
        _, left, kind, right, shape, more = site
        r = self.token(right, shape, more)
        out = self.prior.get(kind, _logit(_guess(kind, "U"))) + (max(self.left.get(left, 0.0), -1.5) if kind[1] in "lL" else self.left.get(left, 0.0))
        if kind[0] in "qd":  # a mark that no abbreviation has; only a closed quotation may run on, by what follows it
            if "c" not in kind or shape in ("ho", "O"):
                return self.pair.get((kind[0], shape), _logit(_guess(kind, shape)))
            out = 1.2
        if kind[0] == "e" and shape[0] in "UIO":
            return self.pair.get(("e", shape), _logit(_guess(kind, shape)))
        if kind[0] in "pn":
            # few abbreviations are long, so a long word is only doubted a little
            out += max(self.edges_left.get(left, 0.0), -1.0 if kind[1] in "lL" else -8.0)
            if kind[0] == "p" and kind[1] in "siSa9":
                out += self.edges_right.get(r, 0.0)
        g = script(left)
        if shape[0] in "vhuA":  # no capitals tell: the token as it starts sentences, against the token as it runs on
            begins, on = self.start.get((g, right.capitalize() if shape[0] == "v" else r), 0.0), self.run_all.get(right if shape[0] == "v" else r, 0.0)
            return out + (max(-4.0, min(4.0, math.log((begins + 0.5) / (on + 0.5)))) if begins + on >= 1 else 0.0)
        # the token given its class: seen there, else its share in the class
        word = self.share.get(r, 1e-4)
        total, t = self.starts.get(g, (0.0, 1))  # Witten-Bell: as much weight for the class as there are different tokens
        s = (self.start.get((g, r), 0.0) + t * self.start_class.get((g, shape), 1e-4) * word) / (total + t)
        back = self.run_class.get((kind, shape), self.run_class.get((kind[0], shape), 1e-4)) * word
        t = self.kinds_after.get(left, 0) + 1
        n = (self.run.get((left, r), 0.0) + t * back) / (self.runs.get(left, 0.0) + t)
        return out + max(-8.0, min(8.0, math.log(s / n)))

    def unmarked(self, text: str, marks: int) -> float:
        """Log chance that a boundary of the text shows no mark: what room the marks leave, given how many boundaries so long a text has elsewhere."""
        words = len(text.split())
        han, bare = (0, 0) if text.isascii() else (len(HAN.findall(text)), len(BARE_LETTER.findall(text)))
        rate = lambda g, least: max(least, self.bounds.get(g, 0.0) / max(1.0, self.total.get(g, 0.0)))
        due = (max(0, words - 1) if words > (han + bare) / 4 else 0) * rate("L", 1 / 40) + han * rate("H", 1 / 60) + bare * rate("S", 1 / 60)
        if due <= 0:
            return math.log(STRAY)
        room = max(0.0, 1 - 5 * marks / due)
        return math.log(STRAY + 0.95 * room * (1 - math.exp(-((due / 3) ** 2))))

    def bare(self, left: str, right: str) -> float:
        """Log odds of a boundary between two tokens, by n-grams with a boundary token on either side."""
        g = group_of(right)
        total, bounds = self.total.get(g, 0.0) + 2, self.bounds.get(g, 0.0) + 0.1
        base = bounds / total
        e = min(0.98, (self.ending.get(left, 0.0) + 2 * base) / (self.seen.get(left, 0.0) + 2))
        c = max(0.5, self.seen.get(right, 0.0))
        begins = min(self.opening.get(right, 0.0), c)
        s, u = (begins + 2 * c / total) / (bounds + 2), (c - 0.98 * begins + 2 * c / total) / (total - bounds + 2)
        return max(-MOST, min(MOST, _logit(e) + math.log(s / u)))

    def events(self, text: str, lo: int, hi: int, sites: list[tuple], unmarked: float) -> tuple[list[int], list[float], list[bool]]:
        """Places of a block, those with marks as `places` gave them, their log odds, and whether each is tied to the one ahead."""
        found = [(s[0], self.odds(s), True) for s in sites]
        if unmarked + MOST > 0:
            marked = {s[0] for s in sites}
            tokens = tokens_of(text, lo, hi)
            left, right = grams(tokens)
            for i in range(1, len(tokens)):
                a, b = tokens[i - 1][1], tokens[i][0]
                gap = GAP.match(text, a, b)
                if gap.end() == b and a not in marked and (a < b or group_of(tokens[i][2]) != "L") and not (marked and any(x in marked for x in range(a, b + 1))):
                    found.append((a, self.bare(left[i - 1], right[i]) + unmarked, False))
            found.sort()
        near = [False]
        for (a, _, x), (b, _, y) in zip(found, found[1:]):
            if x and y:
                near.append(text.count(" ", a, b) <= 1 and b - a < 20 and not UNSPACED.search(text, a, b))
            else:
                near.append(len(tokens_of(text, a, b)) <= 1)
        return [f[0] for f in found], [f[1] for f in found], near[: len(found)]

    def posteriors(self, odds: list[float], near: list[bool]) -> np.ndarray:
        """Chances of a boundary at the events of one block: forward and backward over the chain."""
        n = len(odds)
        p = np.array([1 / (1 + math.exp(-max(-30.0, min(30.0, o)))) for o in odds])
        i = 0
        while i < n:
            j = i + 1
            while j < n and near[j]:
                j += 1
            if j - i > 1:
                w = math.exp(self.tied)
                e = p[i:j]
                f, b = np.ones((j - i, 2)), np.ones((j - i, 2))
                f[0] = (1 - e[0], e[0])
                for k in range(1, j - i):
                    f[k, 0] = f[k - 1].sum() * (1 - e[k])
                    f[k, 1] = (f[k - 1, 0] + w * f[k - 1, 1]) * e[k]
                    f[k] /= f[k].sum()
                for k in range(j - i - 2, -1, -1):
                    b[k, 0] = b[k + 1, 0] * (1 - e[k + 1]) + b[k + 1, 1] * e[k + 1]
                    b[k, 1] = b[k + 1, 0] * (1 - e[k + 1]) + w * b[k + 1, 1] * e[k + 1]
                    b[k] /= b[k].sum()
                g = f * b
                p[i:j] = g[:, 1] / g.sum(1)
            i = j
        return p

    @classmethod
    def fit(cls, texts: list[str]) -> EventModel:
        """The model of some texts, counted here."""
        counts = Counter()
        for t in texts:
            count_text(t, counts)
        rows = [(what, key, float(n)) for (what, key), n in counts.items()]

        def total(found: Iterator[tuple[str, str, float, float]]) -> list[tuple[str, str, float, float]]:
            out: dict[tuple[str, str], list[float]] = defaultdict(lambda: [0.0, 0.0])
            for what, key, yes, no in found:
                out[what, key][0] += yes
                out[what, key][1] += no
            return [(*k, *v) for k, v in out.items()]

        self = cls()
        self.know_names([(k, n) for k, n in total_names(rows)], sum(n for what, _, n in rows if what == "s"))
        self.know_counts(total(self.static(rows)))
        for r in range(ROUNDS):
            self.maximise(total(self.expect(rows, r == 0)), r == ROUNDS - 1)
        return self

    def know_names(self, seen: list[tuple[str, float]], places_: float) -> None:
        """Tokens so frequent at places that they speak for themselves even with a capital."""
        self.places = max(1.0, places_)
        self.names = {w for w, n in seen if n >= 0.0005 * self.places + 3}

    def static(self, rows: Iterable[tuple[str, str, float]]) -> Iterator[tuple[str, str, float, float]]:
        """What doesn't depend on posteriors, from counted rows: (table, key, number, 0)."""
        for what, key, n in rows:
            if what == "s":
                left, _, right, shape, more = key.split(SEP)
                yield "l", left, n, 0.0
                yield "r", self.token(right, shape, more) + SEP + shape, n, 0.0
                yield "c", shape, n, 0.0
            elif what == "b":
                g, right, shape, more = key.split(SEP)
                r = self.token(right, shape, more)
                yield "S", r, n, 0.0
                yield "Sg", g + SEP + r, n, 0.0
                yield "Sc", g + SEP + shape, n, 0.0
                yield "k", "", n, 0.0
            elif what == "e":
                yield "E", key, n, 0.0
            else:
                yield what, key, n, 0.0

    def know_counts(self, found: list[tuple[str, str, float, float]]) -> None:
        """Tables from the sums of `static`."""
        t: dict[str, dict[str, float]] = defaultdict(dict)
        for what, key, n, _ in found:
            t[what][key] = n
        rate = t["k"].get("", 0.0) / max(1.0, 0.7 * self.places)
        rights: dict[str, float] = defaultdict(float)
        best: dict[str, tuple[float, str]] = {}
        for key, n in t["r"].items():
            r, shape = key.rsplit(SEP, 1)
            rights[r] += n
            best[r] = max(best.get(r, (0.0, "")), (n, shape))
        self.share = {r: n / (t["c"].get(best[r][1], n) + 1) for r, n in rights.items()}
        self.edges_left = {w: _evidence(n, t["E"].get(w, 0.0), rate) for w, n in t["l"].items()}
        self.edges_right = {w: _evidence(n, t["S"].get(w, 0.0), rate) / 2 for w, n in rights.items()}
        self.begun = {tuple(k.split(SEP)): n for k, n in t["Sg"].items()}
        self.begun_class = {tuple(k.split(SEP)): n for k, n in t["Sc"].items()}
        self.seen, self.edge_end, self.edge_start = t["w"], t["we"], t["wb"]
        self.total, self.units = t["wt"], t["wu"]

    def expect(self, rows: Iterable[tuple[str, str, float]], first: bool) -> Iterator[tuple[str, str, float, float]]:
        """Expected boundaries and others from counted rows: (table, key, boundaries, others). The first round goes by classes and edges of units."""
        for what, key, n in rows:
            if what != "s":
                continue
            left, kind, right, shape, more = key.split(SEP)
            r = self.token(right, shape, more)
            if first:
                o = _logit(_guess(kind, shape)) + (max(self.edges_left.get(left, 0.0), -1.0 if kind[1] in "lL" else -8.0) if kind[0] in "pn" else 0.0) + (self.edges_right.get(r, 0.0) if kind[0] == "p" and kind[1] in "siSa9" else 0.0)
            else:
                o = self.odds((0, left, kind, right, shape, more))
            p = 1 / (1 + math.exp(-max(-20.0, min(20.0, o))))
            yes, no = p * n, (1 - p) * n
            yield "kind", kind, yes, no
            yield "pair", kind[0] + SEP + shape, yes, no
            yield "left", left + SEP + kind, yes, no
            if shape[0] != "v":
                yield "start", script(left) + SEP + r, yes, 0.0
                yield "class", script(left) + SEP + shape, yes, 0.0
            yield "run", left + SEP + r, no, 0.0
            yield "rk", kind + SEP + shape, no, 0.0
            yield "rk", kind[0] + SEP + shape, no, 0.0
            core = left if kind[0] == "n" else left[:-1]
            yield "we", core, yes, 0.0
            yield "wb", right.lower(), yes, 0.0
            yield "wt", group_of(right), yes, 0.0

    def maximise(self, found: list[tuple[str, str, float, float]], last: bool) -> None:
        """The model from the sums of `expect`."""
        t: dict[str, dict[str, tuple[float, float]]] = defaultdict(dict)
        for what, key, yes, no in found:
            t[what][key] = yes, no
        self.prior = {k: math.log((y + 2 * g) / (n + 2 * (1 - g))) for k, (y, n) in t["kind"].items() for g in [_guess(k, "U")]}
        self.pair = {}
        for key, (y, n) in t["pair"].items():
            k, shape = key.split(SEP)
            g = _guess(k + "l", shape)
            self.pair[k, shape] = math.log((y + 20 * g) / (n + 20 * (1 - g)))
        left: dict[str, list] = {}
        for key, (y, n) in t["left"].items():
            l, kind = key.rsplit(SEP, 1)
            a = left.setdefault(l, [0.0, 0.0, kind])
            a[0] += n
            a[1] += y
        self.left, self.runs = {}, {}
        for l, (n, y, kind) in left.items():
            ky, kn = t["kind"].get(kind, (y, n))
            base = (ky + 1) / (kn + ky + 2)
            self.left[l] = max(-5.0, min(5.0, math.log((y + 2 * base) / (n + 2 * (1 - base))) - _logit(base)))
            self.runs[l] = n
        start = defaultdict(float, self.begun)
        for key, (y, _) in t["start"].items():
            start[tuple(key.split(SEP, 1))] += y
        shapes = defaultdict(float, self.begun_class)
        for key, (y, _) in t["class"].items():
            shapes[tuple(key.split(SEP))] += y
        total, different = defaultdict(float), Counter()
        for (g, _), v in shapes.items():
            total[g] += v
        for g, _ in start:
            different[g] += 1
        self.starts = {g: (v, different[g] + 1) for g, v in total.items()}
        self.start_class = {k: (v + 0.05) / (total[k[0]] + 1) for k, v in shapes.items()}
        self.start = {k: v for k, v in start.items() if v > 0.05}
        self.run = {tuple(k.split(SEP, 1)): n for k, (n, _) in t["run"].items() if n > 0.05}
        self.kinds_after = Counter(l for l, _ in self.run)
        run_all: dict[str, float] = defaultdict(float)
        for (_, r), v in self.run.items():
            run_all[r] += v
        self.run_all = dict(run_all)
        run_class = {tuple(k.split(SEP)): n for k, (n, _) in t["rk"].items()}
        run_kind: dict[str, float] = defaultdict(float)
        for (k, _), v in run_class.items():
            run_kind[k] += v
        self.run_class = {k: (v + 0.05) / (run_kind[k[0]] + 1) for k, v in run_class.items()}
        if last:
            add = lambda edge, key: {w: edge.get(w, 0.0) + t[key].get(w, (0.0, 0.0))[0] for w in {*edge, *t[key]}}
            self.ending, self.opening, self.bounds = add(self.edge_end, "we"), add(self.edge_start, "wb"), add(self.units, "wt")
            del self.begun, self.begun_class, self.edge_end, self.edge_start, self.units


def count_text(text: str, counts: Counter) -> None:
    """Adds what the model needs of one text: places (s), starts (b) and ends (e) of units by the token with its class, and for places without mark tokens (w), edges (we, wb) and totals (wt, wu)."""
    cased = text != text.lower()
    plain = text.isascii() or not UNSPACED.search(text)
    for lo, hi in blocks(text):
        if not text[lo:hi].strip():
            continue
        for _, left, kind, right, shape, more in places(text, lo, hi, cased):
            counts["s", SEP.join((left, kind, right, shape, more if shape[0] in "UA" else ""))] += 1
        end = lo + len(text[lo:hi].rstrip())
        token = _before(text, lo, end)
        last = _left(token)[0] if token else ""
        counts["e", last] += 1
        if cased or script(last) in "ADHS":
            right, shape, more = _right(text, lo, hi)
            counts["b", SEP.join((script(last), right, shape, more if shape[0] in "UA" else ""))] += 1
        if not plain:
            tokens = tokens_of(text, lo, hi)
            if tokens:
                left, right = grams(tokens)
                counts.update(("w", x) for x in right)
                for t in {x for x in left if group_of(x) != "L"} - set(right):
                    counts["w", t] += 1
                for _, _, t in tokens:
                    counts["wt", group_of(t)] += 1
                counts["we", left[-1]] += 1
                counts["wb", right[0]] += 1
                counts["wu", group_of(tokens[-1][2])] += 1
        elif (first := PLAIN.search(text, lo, hi)) is not None:
            ends = PLAIN.findall(token) or PLAIN.findall(text, first.start(), hi)
            counts["we", ends[-1].lower()] += 1
            counts["wb", first[0].lower()] += 1
            counts["wu", "L"] += 1
    if plain:  # words alone, so one pass finds them all
        words = PLAIN.findall(text.lower())
        counts["wt", "L"] += len(words)
        for w, n in Counter(words).items():
            counts["w", w] += n


def total_names(rows: Iterable[tuple[str, str, float]]) -> Iterator[tuple[str, float]]:
    out: dict[str, float] = defaultdict(float)
    for what, key, n in rows:
        if what in "sb":
            out[key.split(SEP)[2 if what == "s" else 1]] += n
    yield from out.items()


def spans(text: str, model: EventModel) -> list[tuple[int, int]]:
    """Starts and ends of the sentences, without outer white space."""
    out = []
    cased = text != text.lower()
    units = [(lo, hi, places(text, lo, hi, cased)) for lo, hi in blocks(text)]
    marks = sum(len(sites) + bool(SPACED.search(text, max(lo, hi - 8), hi)) for lo, hi, sites in units)
    unmarked = model.unmarked(text, marks)
    for lo, hi, sites in units:
        at, odds, near = model.events(text, lo, hi, sites, unmarked)
        cuts = [lo]
        if at:
            cuts += [x for x, p in zip(at, model.posteriors(odds, near)) if p > 0.5]
        cuts.append(hi)
        for a, b in zip(cuts, cuts[1:]):
            piece = text[a:b]
            start = a + len(piece) - len(piece.lstrip())
            end = a + len(piece.rstrip())
            if end > start:
                out.append((start, end))
    return out


def counted(texts: DataFrame) -> DataFrame:
    """(what, key, n): `count_text` over all of `texts(text)`; each task adds up its own ahead of the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows() -> pa.RecordBatch:
            keys = list(counts)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(counts.values()), pa.float64())], names=["what", "key", "n"])

        for b in batches:
            for t in b.column("text").to_pylist():
                count_text(t, counts)
                if len(counts) > FLUSH:
                    yield rows()
                    counts = Counter()
        yield rows()

    return texts.select("text").mapInArrow(run, "what string, key string, n double").groupBy("what", "key").agg(F.sum("n").alias("n"))


def _tables(rows: DataFrame, work) -> list[tuple[str, str, float, float]]:  # noqa: ANN001
    """Sums of what `work` gives for counted rows, the VOCAB largest of each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list[float]] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.string()), pa.array([v[0] for v in held.values()], pa.float64()), pa.array([v[1] for v in held.values()], pa.float64())], names=["what", "key", "yes", "no"])

        for b in batches:
            for what, key, yes, no in work(zip(*(b.column(c).to_pylist() for c in ("what", "key", "n")))):
                v = held.get((what, key))
                if v is None:
                    held[what, key] = [yes, no]
                else:
                    v[0] += yes
                    v[1] += no
            if len(held) > FLUSH:
                yield out()
                held = {}
        yield out()

    total = rows.mapInArrow(run, "what string, key string, yes double, no double").groupBy("what", "key").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    most = W.partitionBy("what").orderBy(F.desc(F.col("yes") + F.col("no")), "key")
    kept = total.withColumn("rn", F.row_number().over(most)).where(F.col("rn") <= VOCAB).drop("rn").toArrow()  # a bounded number of tables
    return list(zip(*(kept.column(c).to_pylist() for c in ("what", "key", "yes", "no"))))


def fit(texts: DataFrame) -> EventModel:
    """The model of all of `texts(text)`."""
    rows = materialize(counted(texts))
    model = EventModel()
    at = F.when(F.col("what") == "s", 2).otherwise(1)
    name = F.get(F.split("key", SEP), at)
    places_ = rows.where("what = 's'").agg(F.sum("n")).first()[0] or 0.0
    seen = rows.where("what in ('s', 'b')").groupBy(name.alias("w")).agg(F.sum("n").alias("n")).where(F.col("n") >= 0.0005 * places_ + 3)  # a few thousand by this bound
    model.know_names([(r.w, r.n) for r in seen.collect()], places_)
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(model)
    model.know_counts(_tables(rows, lambda r: shared.value.static(r)))
    for k in range(ROUNDS):
        now = spark.sparkContext.broadcast(model)
        model.maximise(_tables(rows.where("what = 's'"), lambda r, now=now, k=k: now.value.expect(r, k == 0)), k == ROUNDS - 1)
    return model


def sentences(docs: DataFrame) -> DataFrame:
    """(document_id, start_char, end_char) of every sentence of `docs(document_id, text)`, in code points, ends exclusive.

    Null texts and ids give no row, nor do blank texts; repeated rows give repeated rows.
    """
    own = docs.where("document_id is not null and text is not null").select("document_id", "text")
    model = docs.sparkSession.sparkContext.broadcast(fit(own))  # VOCAB entries a table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, starts, ends = [], [], []
            for d, t in zip(b.column("document_id").to_pylist(), b.column("text").to_pylist()):
                for s, e in spans(t, model.value):
                    ids.append(d)
                    starts.append(s)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["document_id", "start_char", "end_char"])

    return own.mapInArrow(run, "document_id string, start_char bigint, end_char bigint")
