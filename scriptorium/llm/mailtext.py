"""Which lines of an e-mail its sender newly wrote: the rules for one message, without its thread.

What recurs is known from outside: templates of lines and paragraphs that end messages of one sender or of many. The rules here know the layout of mail (front matter, header lines, quotation prefixes,
introductions, forwarding marks) and, as a fallback for what recurs too rarely, closing words and the like of some languages. With `lists=False` the word lists are off: header lines are then any run of
names with a colon, and an introduction is a line with a date or address that ends in a colon.
"""

from __future__ import annotations

import re
from collections.abc import Callable

# ---- fixed values: header names, introductions, closings and the like of English, German, French and Spanish mail ----
HEADER_NAMES = (
    "From To Cc Bcc Subject Date Sent Reply-To Sender Message-ID In-Reply-To References Received Return-Path Delivered-To Importance Attachments "
    "MIME-Version Content-Type Content-Transfer-Encoding Von An Betreff Datum Gesendet Kopie De À A Objet Envoyé Copie Para Asunto Fecha Enviado"
).split()
CLOSINGS = (
    "best", "best regards", "best wishes", "kind regards", "kindest regards", "warm regards", "regards", "all the best", "talk soon", "cheers", "yours", "yours sincerely",
    "yours faithfully", "yours truly", "sincerely", "thanks", "thanks again", "thank you", "many thanks", "thanks and regards", "br", "brgds", "rgds", "take care", "see you soon",
    "viele grüße", "mit freundlichen grüßen", "freundliche grüße", "beste grüße", "liebe grüße", "schöne grüße", "herzliche grüße", "danke und gruß", "vielen dank", "danke", "gruß", "lg", "vg", "mfg",
    "merci", "merci d’avance", "cordialement", "bien cordialement", "bonne journée", "bien à toi", "bien à vous", "sincères salutations", "salutations", "amicalement", "à bientôt",
    "un saludo", "saludos", "saludos cordiales", "atentamente", "gracias", "un abrazo", "hasta pronto",
)
DEVICE = re.compile(
    r"^(?:(?:Sent|Send) (?:from|via|with) (?:my |the |an? )?\S|Get the .{1,30} app\b|Get .{1,30} for (?:iOS|Android)|Gesendet (?:mit|von) |Von meinem .{1,40} gesendet|Diese Nachricht wurde von meinem .* gesendet|Envoyé (?:avec|de|depuis) |Enviado desde |Scanned for .* by |Virus-free\b)"
)
NOTICE = re.compile(
    r"(?i)^\W*(?:confidential(?:ity)?\s*(?:notice)?\s*:|legal notice\b|disclaimer\b|please consider (?:the|our) \w+ before|(?:this|the) (?:e-?mail|message)(?: and (?:its|any) attachments)? (?:is|are|may) |this message and its attachments|if you (?:got|received|have received) (?:it|this)\b.* in error|the information in this e-?mail|any copying or disclosure|views expressed (?:are|in)|"
    r"bitte prüfen sie, ob diese mail|diese (?:e-?mail|nachricht) (?:ist|enthält|kann)|pensez à |ce (?:message|courriel) (?:est|et)|antes de imprimir|este (?:mensaje|correo) )|^.{2,60} is registered in .{2,40} under number \d+\.?$|^.{2,60}, Sitz .{2,40}, Registernummer \d+\.?$|^.{2,60}, (?:siège (?:à|social)|RCS|SIREN|immatriculée?)\b.*\.?$|you (?:receive|received|are receiving|get) this (?:because|e-?mail because|message because)|(?:to )?unsubscribe\b|^\S+ mailing list$|sie erhalten diese|vous recevez ce"
)
INTRO_START = re.compile(r"^(?:On|In the message of|In a message dated|At|Am|Le|El|Em|Op|Il) ?\b|^.{0,60}<[^<>@\s]+@[^<>\s]+>")
INTRO_END = re.compile(r"(?:wrote|writes|said|schrieb|schrieben|a écrit|écrivit|escribió)\b[^:]*(?:\d{1,2}[:.h]\d{2}[^:]*)?\s*:\s*$")
FORWARD = re.compile(r"^\s*(?:-{3,}\s*[^-].*\s*-{3,}|Begin forwarded message\s*:|Anfang der weitergeleiteten (?:Nachricht|E-Mail)\s*:|Début du message (?:transféré|réexpédié)\s*:)\s*$")
# ---- end of fixed values ----
ANY_HEADER = re.compile(r"^\s*\*?[A-ZÀ-Ý][\w-]{0,24}\*?\s?:\*?\s+\S")
ADDRESS, LINK = re.compile(r"[\w.+-]+@[\w.-]+"), re.compile(r"(?:https?://|www\.)\S+")
#: Lines at the end of an own part that may belong to an ending.
TAIL = 8
MOMENT = re.compile(r"\d{1,2}[:.h]\d{2}")
YEAR = re.compile(r"\b(?:19|20)\d\d\b")
QUOTE = re.compile(r"^\s*(?:>|\||:(?=\s|$)|[A-Z]{1,3}>)")
HEADER = re.compile(r"^\s*\*?(?:" + "|".join(map(re.escape, HEADER_NAMES)) + r"|X-[\w-]+)\s?\*?:\*?(?:\s|$)")
RULE = re.compile(r"^\s*(?:--|[-–—=~*_#]{3,}|[—–]{1,})\s*$")
LIST_ITEM = re.compile(r"^\s*[-*·•]\s+\S")
CONTACT = re.compile(r"^(?:(?:Tel|Phone|Mobile|Fax|Email|E-Mail|Mail|Web|Tél|Telefon|Mobil|Courriel)\b\.?:?\s*\S+.*|www\.\S+|https?://\S+|[\w.+-]+@[\w.-]+|\+?[\d ()/-]{7,})$")
_CLOSING = {c: None for c in CLOSINGS}
NEW, OTHER = 1, 0


def unquoted(line: str) -> str:
    """The line without its quotation prefixes."""
    while m := QUOTE.match(line):
        line = line[m.end() :]
    return line.strip()


def _closing(line: str, names: set[str]) -> bool:
    """A closing formula, alone or with the sender's name after it."""
    text = line.strip().rstrip("!,.-–— ").strip()
    low = text.lower()
    if low in _CLOSING:
        return True
    for c in CLOSINGS:
        if low.startswith(c) and len(low) > len(c) and low[len(c)] in " ,!.-–":
            rest = text[len(c) :].strip(" ,!.-–—")
            if rest and (rest.lower() in names or (len(rest.split()) <= 2 and all(w[:1].isupper() for w in rest.split()) and len(rest) <= 30)):
                return True
    return False


def _named(line: str, names: set[str]) -> bool:
    """The sender's name, first name or initial, perhaps with a role after a comma, or a first name alone."""
    text = line.strip().lstrip("-–—").strip().rstrip(",.!").strip()
    low = text.lower()
    if low in names or re.fullmatch(r"[A-ZÀ-Ý]\.?", text):
        return True
    head = low.split(",")[0].strip()
    return "," in low and head in names and len(text) <= 60


def front_matter(lines: list[str]) -> tuple[int, dict[str, str]]:
    """Number of lines of the front matter and its plain fields."""
    if not lines or lines[0].lstrip("﻿").strip() != "---":
        return 0, {}
    for i in range(1, len(lines)):
        if lines[i].strip() in ("---", "..."):
            return i + 1, dict(x.split(":", 1) for x in lines[1:i] if ":" in x)
    return 0, {}


def template(text: str, names: set[str]) -> str:
    """What recurs of a line or paragraph: lower case, one space, without outer marks; the sender's names, addresses and links are placeholders."""
    t = LINK.sub("#link", ADDRESS.sub("#mail", " ".join(text.split()).lower()))
    for n in sorted(names, key=len, reverse=True):
        t = re.sub(rf"(?<!\w){re.escape(n)}(?!\w)", "@", t)
    return t.strip(" ,.!-–—*_")


def intro_length(lines: list[str], i: int, lists: bool = True) -> int:
    """How many lines an introduction of history takes from line i; 0 if there is none."""
    if lists and not INTRO_START.match(lines[i].strip()):
        return 0
    joined = ""
    for n in range(1, 4):
        if i + n > len(lines) or (n > 1 and (not lines[i + n - 1].strip() or QUOTE.match(lines[i + n - 1]))):
            return 0
        joined = f"{joined} {lines[i + n - 1].strip()}".strip()
        if (INTRO_END.search(joined) if lists else joined.endswith(":")) and (MOMENT.search(joined) or "@" in joined or YEAR.search(joined)):
            return n
    return 0


def header_run(lines: list[str], i: int, lists: bool = True) -> int:
    """Length of the run of header lines from line i (folded lines belong to it)."""
    n = 0
    header = HEADER if lists else ANY_HEADER
    while i + n < len(lines) and (header.match(lines[i + n]) or (n and lines[i + n][:1] in " \t" and lines[i + n].strip())):
        n += 1
    return n


def names_of(author: str | None, lines: list[str], author_id: str | None = None) -> set[str]:
    """Lower-case names of the sender, full and first, from the author columns, the front matter and the header."""
    found = set()
    start, fields = front_matter(lines)
    given = [author or "", fields.get("author", ""), re.sub(r"[-_.]+", " ", author_id or "")]
    i = start
    while i < len(lines) and not lines[i].strip():
        i += 1
    for line in lines[i : i + header_run(lines, i)]:
        m = re.match(r"^\s*\*?(?:From|Von|De)\*?\s?:\*?\s*([^<]*)", line)
        if m:
            given.append(m[1])
    for g in given:
        g = " ".join(g.replace('"', "").split()).lower()
        if g and "@" not in g and g not in ("unknown", "n/a"):
            found |= {g, g.split()[0]}
    return found


def observed(raw: str, author: str | None, author_id: str | None = None) -> tuple[list[str], list[tuple[int, str]]]:
    """The own lines of a message before any ending is known, and what may show what endings look like: (0, template) of lines further up, (1, template) of lines and (2, template) of paragraphs near an end."""
    lines, kind, stops, names = _structure(raw, author, author_id, None, True)
    seen: list[tuple[int, str]] = []
    own_lines: list[str] = []
    for own in _own_parts(lines, kind, stops):
        text = [lines[r].strip() for r in own]
        own_lines = text + own_lines
        starts = [p for p in range(len(own)) if p == 0 or own[p] - own[p - 1] > 1]
        seen += [(2, template(" ".join(text[p:q]), names)) for p, q in list(zip(starts, [*starts[1:], len(own)]))[-4:] if p]
        first = max(1, len(text) - TAIL)
        seen += [(int(k >= first), template(t, names)) for k, t in enumerate(text)]
    return own_lines, [(w, t) for w, t in seen if t]


def mark(raw: str, author: str | None, author_id: str | None = None, recurring: Callable[[str], bool] | None = None, inherited: list[int] | None = None, lists: bool = True) -> tuple[list[str], list[int]]:
    """Lines and their marks (1 for newly written).

    `recurring` tells the templates of lines and paragraphs that are known to end messages; `inherited` are line numbers that came from earlier in the thread.
    """
    lines, kind, stops, names = _structure(raw, author, author_id, inherited, lists)
    _strip_endings(lines, kind, stops, names, recurring or (lambda t: False), lists)
    return lines, kind


def _structure(raw: str, author: str | None, author_id: str | None, inherited: list[int] | None, lists: bool) -> tuple[list[str], list[int], list[int], set[str]]:
    """Lines, their marks by layout and inheritance, the places where history starts, and the sender's names."""
    lines = [x.rstrip("\r") for x in raw.split("\n")]
    n = len(lines)
    kind = [NEW if x.strip() else OTHER for x in lines]
    names = names_of(author, lines, author_id)
    i, _ = front_matter(lines)
    kind[:i] = [OTHER] * i
    while i < n and not lines[i].strip():
        i += 1
    head = header_run(lines, i, lists)
    kind[i : i + head] = [OTHER] * head
    i += head
    stops = []  # an own part ends ahead of each
    while i < n:
        line = lines[i]
        if not line.strip():
            i += 1
            continue
        if QUOTE.match(line):
            stops.append(i)
            while i < n and (QUOTE.match(lines[i]) or (not lines[i].strip() and i + 1 < n and QUOTE.match(lines[i + 1]))):
                kind[i] = OTHER
                i += 1
            continue
        k = intro_length(lines, i, lists)
        if k:
            stops.append(i)
            kind[i : i + k] = [OTHER] * k
            i += k
            j = i
            while j < n and not lines[j].strip():
                j += 1
            if j < n and not QUOTE.match(lines[j]):
                kind[i:] = [OTHER] * (n - i)
                break
            continue
        if FORWARD.match(line) or header_run(lines, i, lists) >= 3:
            stops.append(i)
            kind[i:] = [OTHER] * (n - i)
            break
        i += 1
    for j in inherited or ():
        kind[j] = OTHER
    return lines, kind, stops, names


def _own_parts(lines: list[str], kind: list[int], stops: list[int]) -> list[list[int]]:
    """Numbers of the new lines of each own part, that is ahead of each place where history starts and of the end."""
    out = []
    for stop in [*stops, len(lines)]:
        own = []
        j = stop - 1
        while j >= 0 and (kind[j] == NEW or not lines[j].strip()):
            if lines[j].strip():
                own.append(j)
            j -= 1
        if own:
            out.append(own[::-1])
    return out


def _strip_endings(lines: list[str], kind: list[int], stops: list[int], names: set[str], recurring: Callable[[str], bool], lists: bool) -> None:
    """Mark what follows the body of each own part as not new."""
    for own in _own_parts(lines, kind, stops):
        starts = [p for p in range(len(own)) if p == 0 or own[p] - own[p - 1] > 1]
        text = [lines[r].strip() for r in own]
        known = [p >= max(1, len(text) - TAIL) and recurring(template(t, names)) for p, t in enumerate(text)]
        formula = [k or (lists and _closing(t, names)) or _named(t, names) for k, t in zip(known, text)]
        ending = [f or bool(RULE.match(t) or (lists and (DEVICE.match(t) or NOTICE.match(t)))) for f, t in zip(formula, text)]
        # 1. a rule of a signature, near the end: all after it goes
        last = next((p for p in range(max(0, len(own) - 14), len(own)) if RULE.match(text[p])), len(own))
        moved = True
        while moved and last:
            moved = False
            # 2. from the bottom up: lines that only an ending holds, and paragraphs that recur
            while last and (ending[last - 1] or CONTACT.match(text[last - 1])):
                contact = CONTACT.match(text[last - 1])
                last, moved = last - 1, True
                while contact and last and own[last] - own[last - 1] == 1 and len(text[last - 1]) <= 45 and text[last - 1][-1] not in ".!?:;,":
                    last -= 1
            begin = max((p for p in starts if p < last), default=0)
            if begin and recurring(template(" ".join(text[begin:last]), names)):
                last, moved = begin, True
                continue
            # 3. a name or closing a few lines up, with only short lines below it: a signature block
            for p in range(max(1, last - 6), last):
                if formula[p] and all(len(t) <= 60 and t[-1] not in ".!?," for t in text[p + 1 : last]):
                    last, moved = p, True
                    break
        for r in own[last:]:
            kind[r] = OTHER
