"""Candidate segments of personal details, proposed generously, and what the model looks at in each.

Contact data and identity numbers are proposed by patterns of their form. A name is any short run of capitalised words, initials and
particles, whatever the words; which runs are names is left to the model.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass, field

KINDS = ("email", "phone", "id_number", "address", "name")
#: Fewest digits of a telephone number.
LEAST_DIGITS = 7
#: Classes of words (see Lexicon) that a run of name words may hold.
NAME_KINDS = "IifcbdprGhKSMP2"
#: Words of a lower rank in a vocabulary are function words.
FREQUENT = 1500
#: Words of a name at most, particles and initials included.
NAME_WORDS = 6
#: Vocabularies of public tokenizers that tell common words from others; a parameter everywhere.
VOCABULARIES = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")

#: Frequent given names, a hint for the model (no name is proposed or refused because of this list).
GIVEN = (
    "Adam Agnes Aisha Alan Alice Amina Andrea Anna Anselm Arthur Bram Carlos Carmen Charles Chen Clara Conrad Daniel David Davor Diego Elena Elizabeth Emil Emma Erik Eva Farida "
    "Fatima Francis George Goran Greta Hannah Hassan Helen Henry Hugh Ibrahim Inés Ingrid Isabel Ivy Jack James Jan Jane Javier Jean Jennifer Joan John Jonas Jorge José Joseph Juan "
    "Julia Karen Karl Katherine Kenji Kwabena Laura Lars Lena Leopold Li Linda Louis Lucia Luis Lukas Maria Marie Marcus Margaret Mark Martin Mary Matteo Mei Michael Miguel Mirela "
    "Mohammed Nadia Nancy Nina Noah Olga Oliver Omar Oskar Ottilie Pablo Patricia Paul Pedro Peter Philip Pierre Priska Rafael Rachel Renée Richard Robert Rosa Ruth Samuel Sara Sarah "
    "Selma Sofia Sophie Stefan Stephen Sunniva Susan Sven Søren Tariq Thea Thomas Tobias Victor Walter William Wilma Ximena Yuki Yusra Yvonne Zoë"
).split()
#: Titles, which do not belong to a name.
TITLES = frozenset("Mr Mrs Ms Miss Mx Dr Prof Sir Dame Herr Herrn Frau Mme Mlle Monsieur Madame Señor Señora señor señora Sr Sra Sig Dott".split())
#: Particles, which do belong to it.
PARTICLES = "van von der den de di da del della la le du dos ten ter bin al".split()
#: Ends of company names.
COMPANY = "Inc Corp Ltd LLC LLP PLC AG SA NV GmbH Co Company Holdings Group Foods Energy Mining Systems Logistics Biologics Materials Instruments Paper Trust Bank Partners Sons Associates".split()
#: Kinds of streets.
STREETS = (
    "Street St Road Rd Avenue Ave Boulevard Blvd Lane Ln Drive Dr Court Ct Way Place Pl Square Sq Terrace Crescent Close Row Parkway Pkwy Highway Hwy Heights Gardens Circle Mews Plaza Trail Walk Grove"
).split()
#: Months and days.
CALENDAR = frozenset(
    "January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
)
#: Words before a number that identifies a person.
ID_CUES = (
    r"passport|licen[cs]e|permit|social security|national insurance|insurance number|tax(?:payer)?[ -]?id|identity|identification|\bID\b|\bSSN\b|\bDNI\b|\bNIE\b|\bNIF\b|"
    r"[Aa]usweis|[Ss]teuer-I|documento|pasaporte|passeport|carte d|[Rr]eisepass|personal number"
)
#: Words that tell the language of a text.
TONGUES = {
    "de": frozenset("der die das und ist für mit von den wurde nicht im sich aus auf zu ein eine des als hat wird bei an".split()),
    "fr": frozenset("le les des est une pour dans du et au a été à par sur plus que avec ont sont d l".split()),
    "es": frozenset("el los las una para por del con fue en y que al se un su más son".split()),
    "en": frozenset("the of and to in is was for that on with at by from are has".split()),
}

_UP, _LOW = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
_CAP = rf"(?:[{_UP}][{_LOW}]+|[{_UP}]{{2,}})"
_S = r"[  ]{1,2}"
_TOWN = rf"{_CAP}(?:[  -]{_CAP}){{0,2}}"
_BREAK = r"(?:,[ \t]*\n?|[ \t]*\n|,? )[ \t]*"
_ROOM = r"(?:,? ?(?:(?:Suite|Ste\.?|Unit|Apt\.?|Apartment|Room|Flat|Floor) ?#?(?:\d\w*|[A-Z]\b)|#\d+|\d{1,3}(?:st|nd|rd|th) Floor))?"
_ZIP, _POST = rf"{_S}\d{{5}}(?:-\d{{4}})?", rf"{_S}[A-Z]{{1,2}}\d[\dA-Z]? ?\d[A-Z]{{2}}"
_TAIL = rf"{_ROOM}(?:(?:,[ \t]*\n?|[ \t]*\n)[ \t]*{_TOWN}(?:,?{_S}[A-Z]{{2}}(?![A-Z\d]))?(?:{_ZIP}|,?{_POST})?)?"
_CODED = rf"{_ROOM}(?:(?:,[ \t]*\n?|[ \t]*\n)[ \t]*{_TOWN}(?:,?{_S}[A-Z]{{2}}(?![A-Z\d]))?(?:{_ZIP}|,?{_POST}))"
_DASH = r"[ . -]"
_AT = r"\s?[\[({<]\s?(?:at|AT|@)\s?[\])}>]\s?"
_DOT = r"\s?[\[({<]\s?(?:dot|DOT|\.)\s?[\])}>]\s?"
#: Patterns of contact data and identity numbers: kind, name of the pattern, pattern.
PROPOSE: tuple[tuple[str, str, re.Pattern], ...] = (
    ("email", "at", re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")),
    ("email", "spelt", re.compile(rf"[A-Za-z0-9][A-Za-z0-9._%+-]*(?:{_AT}|\s@\s?|\s?@\s)[A-Za-z0-9-]+(?:(?:\.|{_DOT})[A-Za-z0-9-]+)*(?:\.|{_DOT})[A-Za-z]{{2,}}")),
    ("email", "words", re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*\s(?:at|AT)\s[A-Za-z0-9-]+(?:(?:\.|\s(?:dot|DOT)\s)[A-Za-z0-9-]+)*\s(?:dot|DOT)\s[A-Za-z]{2,}")),
    (
        "phone",
        "groups",
        re.compile(
            rf"(?<![\w+$€£#/.,-])(?:\+\d{{1,3}}{_DASH}?)?(?:\(\d{{1,5}}\){_DASH}?)?\d{{1,5}}(?:{_DASH}\d{{2,5}}){{1,6}}(?:\s?(?:ext\.?|x|extension|Durchwahl)\s?\d{{1,5}})?(?![\w/-]|[.,]\d)"
        ),
    ),
    ("phone", "run", re.compile(r"(?<![\w+$€£#/.,-])\+?\d{7,15}(?:\s?(?:ext\.?|x)\s?\d{1,5})?(?![\w/-]|[.,]\d)")),
    ("id_number", "3-2-4", re.compile(r"(?<![\w$€£#/.,-])\d{3}([- ]?)\d{2}\1\d{4}(?![\w/-]|[.,]\d)")),
    ("id_number", "letters", re.compile(r"(?<![\w-])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?!\w)")),
    ("id_number", "check", re.compile(r"(?<![\w-])(?:[XYZ]-?\d{7}|\d{8})-?[A-Z](?![\w-])")),
    ("id_number", "cued", re.compile(r"(?<![\w$€£#/.,-])(?=[A-Z -]*\d)[A-Z0-9]{1,18}(?:[ -](?=[A-Z]*\d)[A-Z0-9]{1,12}){0,5}(?![\w/-]|[.,]\d)")),
    ("address", "street", re.compile(rf"(?<![\w$€£.,/-])\d{{1,6}}[A-Za-z]?,?{_S}(?:[{_UP}][{_LOW}'’]+{_S}){{1,4}}(?:{'|'.join(STREETS)})\b\.?{_TAIL}")),
    ("address", "coded", re.compile(rf"(?<![\w$€£.,/-])\d{{1,6}}[A-Za-z]?,?{_S}(?:[{_UP}][{_LOW}'’]+{_S}){{0,3}}[{_UP}][{_LOW}'’]+\b\.?{_CODED}")),
    ("address", "box", re.compile(rf"\bP\.?[  ]?O\.?[  ]?Box{_S}\d+{_TAIL}")),
    (
        "address",
        "behind",
        re.compile(rf"(?<![\w])(?:[{_UP}][\w'’-]*\.?{_S}){{0,3}}[{_UP}][\w'’-]*\.?,?{_S}\d{{1,4}}[a-z]?{_BREAK}(?:[A-Z]{{1,2}}-)?\d{{4,5}}{_S}{_TOWN}"),
    ),
    (
        "address",
        "before",
        re.compile(
            rf"(?<![\w$€£.,/-])\d{{1,4}}(?: bis| ter)?,? (?:rue|avenue|quai|place|boulevard|bd|chemin|allée|impasse|cours|route|square)(?:{_S}[\w'’-]+){{1,5}}?(?:{_BREAK}\d{{5}}{_S}{_TOWN}|(?=[,.;\n]))"
        ),
    ),
    ("address", "calle", re.compile(rf"\b(?:[Cc]alle|C/|[Aa]venida|Avda\.?|[Pp]laza|[Pp]aseo)(?: [\w'’-]+){{1,5}}?,? (?:n\.?º ?)?\d{{1,4}}(?:{_BREAK}\d{{5}} {_TOWN})?")),
)
#: What every text that a pattern matches holds; other texts need not be searched (tested against the patterns alone).
NEEDS = {
    "at": lambda t: "@" in t,
    "spelt": re.compile(r"[\[({<]\s?(?:at|AT|@)\s?[\])}>]|\s@|@\s").search,
    "words": re.compile(r"\s(?:dot|DOT)\s").search,
    "cued": re.compile(ID_CUES, re.I).search,
    "box": lambda t: "Box" in t,
    "calle": re.compile(r"[Cc]alle|C/|[Aa]venida|Avda|[Pp]laza|[Pp]aseo").search,
}
_CUE = re.compile(ID_CUES, re.I)
#: Characters before a number within which a cue is looked for.
CUE_REACH = 48
_SENTENCE_END = re.compile(r"\w{3,}[.!?;]\s|\n")
_EXTENSION = re.compile(r"\s?(?:ext\.?|x|extension|Durchwahl)\s?\d{1,5}$")
_BREAK_LINE = re.compile(r",|\n")
# words (with inner apostrophes and hyphens, without a possessive s), blanks that markup spells out, numbers, marks
_TOKEN = re.compile(r"&nbsp;|[^\W\d_]+(?:(?!['’][sS]\b)['’-][^\W\d_]+)*|\d+|[^\w\s]|_|\n")
_GAP = re.compile(r"(?:[ \t ]|&nbsp;){1,3}")
_DIGITS = re.compile(r"\d+")
#: Marks that join what follows to what stands before.
_JOINED = frozenset("_'’@.+-")


@dataclass(frozen=True, slots=True)
class Segment:
    """A candidate: characters `start` to `end` of a text as a detail of some kind, the pattern that proposed it, and its name words."""

    start: int
    end: int
    kind: str
    how: str
    words: tuple[int, ...] = field(default=(), compare=False)


class Lexicon:
    """How a word stands in public vocabularies: f very frequent, c common (in lower case), b in both cases, p only capitalised, r in neither; and fixed kinds.

    `paths` are rank files of byte-pair vocabularies, whose entries with a blank before them are whole words.
    """

    def __init__(self, paths: Iterable[str] = VOCABULARIES):
        self.rank: dict[str, int] = {}
        for path in paths:
            with open(path, "rb") as f:
                for line in f:
                    a, b = line.split()
                    raw = base64.b64decode(a)
                    if raw[:1] == b" " and raw[1:2] != b" ":
                        try:
                            w = raw[1:].decode()
                        except UnicodeDecodeError:
                            continue
                        if len(w) > 1 and w.isalpha():
                            self.rank[w] = min(int(b), self.rank.get(w, 1 << 30))
        self.given = frozenset(g.lower() for g in GIVEN)
        fixed = {t.lower(): "T" for t in TITLES} | {p: "P" for p in PARTICLES} | {c.lower(): "K" for c in COMPANY} | {c.lower(): "M" for c in CALENDAR}
        self.fixed = fixed | {s.lower(): "S" for s in STREETS if len(s) > 3} | {g: "G" for g in self.given}
        self.known: dict[str, str] = {}

    def _plain(self, low: str) -> str:
        """f, c, b, d, p or r of a lower-cased word."""
        a, b = self.rank.get(low), self.rank.get(low.capitalize())
        if a is None and b is None:
            for end in ("s", "es", "ed", "d", "ing", "ly", "er", "en", "e", "n"):
                if low.endswith(end) and len(low) - len(end) > 3 and low[: -len(end)] in self.rank:
                    return "d"
            return "r"
        if a is None:
            return "p"
        if a < FREQUENT:
            return "f"
        return "c" if b is None or a <= b else "b"

    def of(self, word: str) -> str:
        """The class of a word as spelt: lower-case words are `w`, particles `P`, initials `I`; capitalised ones by vocabulary, `^` if all in capitals."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 300_000:
                self.known.clear()
            got = self.known[word] = self._of(word)
        return got

    def _of(self, word: str) -> str:
        low = word.lower()
        if not word[0].isupper():
            return "P" if low in PARTICLES else "w"
        if len(word) == 1:
            return "I"
        up = "^" if word.isupper() else ""
        if up and len(word) == 2 and low not in self.given:
            return "2"
        parts = re.split(r"['’-]", low)
        if len(parts) > 1:
            return "h" + self._plain(max(parts, key=len)) + up
        return self.fixed.get(low, self._plain(low)) + up


@dataclass(slots=True)
class Page:
    """A text taken apart once: its tokens, the runs of name words, and what the whole text tells about single words."""

    text: str
    spans: list[tuple[int, int]]
    tokens: list[str]
    kinds: list[str]
    runs: list[list[int]]
    told: dict[str, str]  # surname -> how sure the text is that it is one
    firm: set[str]  # words of company names
    small: set[str]  # words that also stand in lower case
    tongue: str
    starts: list[int]


def read(text: str, lexicon: Lexicon) -> Page:
    """Take a text apart."""
    spans, tokens, kinds = [], [], []
    for m in _TOKEN.finditer(text):
        t = m[0]
        if t == "&nbsp;":
            continue
        spans.append(m.span())
        tokens.append(t)
        kinds.append(lexicon.of(t) if t[0].isalpha() else "#" if t[0].isdigit() else t)
    for i, k in enumerate(kinds):
        if k == "I" and tokens[i + 1 : i + 2] != ["."]:
            kinds[i] = "i"  # a single letter, but no initial
    small = {t for t, k in zip(tokens, kinds) if k == "w"}
    tongue = max(TONGUES, key=lambda x: (len(TONGUES[x] & small), x))
    runs: list[list[int]] = []
    now: list[int] = []
    last = -1
    for i, k in enumerate(kinds):
        if k == "." and last == i - 1 and now and kinds[last] == "I":
            last = i
            continue
        member = k[0] in NAME_KINDS
        a = spans[i][0]
        if member and now and last == i - 1 and (_joins(text, spans[last][1], a) or kinds[last] == "." and spans[last][1] == a):
            now.append(i)
        else:
            if now:
                runs.append(now)
            now = [i] if member else []
        last = i if member else -2
    if now:
        runs.append(now)
    runs = [r for r in runs if any(kinds[i][0] not in "IiP" for i in r)]
    page = Page(text, spans, tokens, kinds, runs, {}, set(), small, tongue, [a for a, _ in spans])
    _tell(page)
    return page


def _joins(text: str, a: int, b: int) -> bool:
    return _GAP.fullmatch(text, a, b) is not None


def titled(page: Page, i: int) -> bool:
    """Whether a title stands before token `i`."""
    j = i - 1
    if j >= 0 and page.tokens[j] == ".":
        j -= 1
    return j >= 0 and page.tokens[j] in TITLES and page.spans[i][0] - page.spans[j][1] < 22


def _tell(page: Page) -> None:
    """Note surnames that the text introduces and words of its company names."""
    k, t = page.kinds, page.tokens
    for run in page.runs:
        end = run[-1]
        firm = next((n for n, i in enumerate(run) if k[i][0] == "K" and n), None)
        after = t[end + 1 : end + 4]
        sons = after[:1] == ["&"] or after[:2] == [",", "Inc"] or after[:1] == ["and"] and after[1:2] and after[1] in COMPANY
        if firm is not None or sons:
            page.firm.update(t[i].lower() for i in run[: firm if firm is not None else None])
            continue
        caps = [i for i in run if k[i][0] not in "IiP"]
        if titled(page, run[0]):
            page.told[t[caps[-1] if len(caps) < 4 else caps[0]].lower()] = "title"
        elif len(caps) > 1 or len(run) > 1 and k[run[0]] == "I":
            first = next((n for n, i in enumerate(run[:-1]) if k[i][0] in "GI" and run[n + 1 :]), None)
            if first is not None:
                rest = [i for i in run[first + 1 :] if k[i][0] not in "IiP"]
                if rest:
                    page.told.setdefault(t[rest[-1] if len(rest) < 3 else rest[0]].lower(), "given")
            elif 2 <= len(caps) <= 3 and all(k[i][0] in "prhG" for i in caps):
                page.told.setdefault(t[caps[-1]].lower(), "two")
        if t[end + 1 : end + 2] == [","] and len(caps) <= 2 and end + 2 < len(t) and k[end + 2][0] == "G":
            page.told.setdefault(t[caps[-1]].lower(), "given")


def _free(text: str, a: int, b: int) -> bool:
    """Whether characters a to b are no part of a longer word, address or file name."""
    before, after = text[a - 1 : a], text[b : b + 1]
    if before and (before.isalnum() or before in _JOINED and not (before == "." and not text[a - 2 : a - 1].isalnum())):
        return False
    return not after or not (after.isalnum() or after in "_@" or after == "." and text[b + 1 : b + 2].isalnum() and text[b + 1 : b + 2].islower())


def names(page: Page) -> Iterable[Segment]:
    """Every run of up to NAME_WORDS name words that begins and ends like a name, and every `Surname, Given`."""
    k, sp, text = page.kinds, page.spans, page.text
    for run in page.runs:
        for x, i in enumerate(run):
            if k[i] == "2" and x == len(run) - 1:
                continue
            for y in range(x, min(len(run), x + NAME_WORDS)):
                j = run[y]
                if k[j][0] in "IiP" and k[j] != "P^" or all(k[m][0] in "IiP" for m in run[x : y + 1]):
                    continue
                if _free(text, sp[i][0], sp[j][1]):
                    yield Segment(sp[i][0], sp[j][1], "name", "run", tuple(run[x : y + 1]))
        end = run[-1]
        if page.tokens[end + 1 : end + 2] == [","] and end + 2 < len(k) and k[end][0] not in "IiP#":
            g = end + 2
            if k[g][0] in NAME_KINDS and _joins(text, sp[end + 1][1], sp[g][0]):
                given = [g]
                while given[-1] + 1 < len(k):
                    n = given[-1] + 1
                    if k[n] == "." and k[given[-1]] == "I":
                        n += 1
                    if n < len(k) and k[n][0] in "IifcbdprGh" and len(given) < 3 and _joins(text, sp[n - 1][1], sp[n][0]):
                        given.append(n)
                    else:
                        break
                for x in range(max(0, len(run) - 3), len(run)):
                    for n in range(1, len(given) + 1):
                        last = given[n - 1]
                        stop = sp[last][1]
                        if k[last] == "I" and page.tokens[last + 1 : last + 2] == ["."] and sp[last + 1][0] == stop:
                            stop += 1
                        if _free(text, sp[run[x]][0], stop):
                            yield Segment(sp[run[x]][0], stop, "name", "turned", (*run[x:], *given[:n]))


def propose(page: Page) -> list[Segment]:
    """Candidate segments of a text, by end."""
    text = page.text
    out: dict[tuple[int, int, str], Segment] = {}

    def add(a: int, b: int, kind: str, how: str) -> None:
        out.setdefault((a, b, kind), Segment(a, b, kind, how))

    digits = "#" in page.kinds or any(c.isdigit() for c in text)
    for kind, how, pattern in PROPOSE:
        if (kind != "email" and not digits) or (how in NEEDS and not NEEDS[how](text)):
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            if kind == "phone" and sum(map(str.isdigit, m[0])) < LEAST_DIGITS:
                continue
            if how == "cued" and (sum(map(str.isdigit, m[0])) < 4 or not cued(text, a)):
                continue
            add(a, b, kind, how)
            if how == "groups":
                plain = _EXTENSION.search(m[0])
                if plain:
                    add(a, a + plain.start(), kind, how)
            if kind == "address" and how in ("street", "box", "coded"):
                short = _BREAK_LINE.split(m[0])[0]
                if len(short) < b - a and how != "coded":
                    add(a, a + len(short), kind, how + "-")
    for s in names(page):
        out.setdefault((s.start, s.end, s.kind), s)
    return sorted(out.values(), key=lambda c: (c.end, c.start, c.kind))


def cued(text: str, a: int) -> bool:
    """Whether a word that announces a person's number stands before position `a`, in the same line and sentence."""
    left = text[max(0, a - CUE_REACH) : a]
    ends = [m.end() for m in _SENTENCE_END.finditer(left)]
    return _CUE.search(left, ends[-1] if ends else 0) is not None


def _near(page: Page, i: int) -> str:
    """A token of the context: frequent lower-case words and marks as they are, other words by class."""
    if i < 0 or i >= len(page.tokens):
        return "^"
    k = page.kinds[i]
    return "." + page.tokens[i] if k in ("w", "P", "T") and len(page.tokens[i]) < 12 else k


def features(page: Page, c: Segment) -> list[str]:
    """What a whole segment and its surroundings look like."""
    text = page.text
    first = c.words[0] if c.words else bisect_right(page.starts, c.start - 1)
    after = c.words[-1] + 1 if c.words else bisect_right(page.starts, c.end - 1)
    if c.words and page.kinds[c.words[-1]] == "I" and page.tokens[after : after + 1] == ["."]:
        after += 1
    l1, l2, l3 = _near(page, first - 1), _near(page, first - 2), _near(page, first - 3)
    r1, r2 = _near(page, after), _near(page, after + 1)
    if c.kind == "name":
        return _name_features(page, c, first, after, l1, l2, r1, r2)
    own = text[c.start : c.end]
    f = ["b", "h=" + c.how, "l1=" + l1, "r1=" + r1, f"l={l2}_{l1}", f"hl={c.how}_{l1}", f"hr={c.how}_{r1}"]
    f += ["w=" + t for t in {l1, l2, l3, _near(page, first - 4), _near(page, first - 5)}]
    if c.kind in ("phone", "id_number"):
        branch = _EXTENSION.search(own)
        own = own[: branch.start()] if branch else own
        f.append(f"ext={bool(branch)}")
        runs = _DIGITS.findall(own)
        total = sum(map(len, runs))
        marks = "".join(sorted(set(re.sub(r"[\d ]", "", own)))) if c.kind == "phone" else "".join(sorted({"A" if x.isalpha() else x for x in own if not x.isdigit()}))
        shape = "-".join(str(len(r)) for r in runs[:7])
        f += ["n=" + shape, f"t={total}", "m=" + marks[:6], f"d={runs[0][:2] if runs and len(runs[0]) == 3 else ''}", "+=" + str(own[0] in "+(")]
        f += [f"n={shape}_{own[0] in '+('}", f"+t={own[0] == '+'}_{8 <= total <= 15}", f"cue={cued(text, c.start)}_{c.how}"]
    elif c.kind == "address":
        code = bool(re.search(r"[0-9]{5}|[A-Z]\d[\dA-Z]? ?\d[A-Z]{2}$", own))
        f += [f"zip={code}", f"com={min(own.count(','), 3)}", f"nl={chr(10) in own}", f"hz={c.how}_{code}"]
    else:
        f += [f"dots={min(own.count('.'), 3)}", f"sp={' ' in own}"]
    return [c.kind + ":" + x for x in f]


def _name_features(page: Page, c: Segment, first: int, after: int, l1: str, l2: str, r1: str, r2: str) -> list[str]:
    k, t = page.kinds, page.tokens
    ks = [k[i] for i in c.words]
    shape = ",".join(ks) if len(ks) < 5 else f"{ks[0]}..{ks[-1]}*{len(ks)}"
    if c.how == "turned":
        shape = "/" + shape
    title = titled(page, first)
    # a capitalised word right before or after means that the run goes on beyond the segment
    left = k[first - 1] if first and k[first - 1][0] in NAME_KINDS + "T" and _joins(page.text, page.spans[first - 1][1], page.spans[first][0]) else ""
    right = k[after] if after < len(k) and k[after][0] in NAME_KINDS and _joins(page.text, page.spans[after - 1][1], page.spans[after][0]) else ""
    caps = [i for i in c.words if k[i][0] not in "IiP"]
    last = t[caps[-1]].lower()
    told = page.told.get(last, "") if c.how == "run" else ""
    begin = l1 in ("^", ".", "!", "?", "\n", ":", ";", "•", "*") and not title
    firm = "K" if right[:1] == "K" else "&" if t[after : after + 1] == ["&"] or (t[after : after + 1] == [","] and t[after + 1 : after + 2] in (["Inc"], ["Ltd"], ["LLC"], ["Corp"])) else ""
    inside = any(x[0] in "KS" for x in ks)
    comp = "c" if all(t[i].lower() in page.firm for i in caps) else ""
    low = sum(t[i].lower() in page.small for i in caps)
    n = len(ks)
    one = "1" if n == 1 else "2"
    state = f"{one}{'t' if title else ''}{told}{comp}{firm}"
    f = ["b", f"k={n}", "s=" + shape, f"a={ks[0]}", f"z={ks[-1]}", "l=" + left, "r=" + right, f"lr={left}|{right}", f"st={state}", f"co={firm}", f"in={inside}", f"low={low}"]
    f += [f"s={shape}_{left}|{right}", f"s_t={shape}_{title}", f"st_b={state}_{begin}", f"s_b={shape}_{begin}", f"lang={page.tongue}_{shape}", f"lang={page.tongue}_{begin}_{one}"]
    f += ["l1=" + l1, "r1=" + r1, f"l1_k={l1}_{one}", f"r1_k={r1}_{one}", f"l={l2}_{l1}", f"r={r1}_{r2}", "l2=" + l2, f"s_l1={shape}_{l1}", f"s_r1={shape}_{r1}", f"cls={'m' if any(x[0] in 'cd' for x in ks) else ''}{one}_{l1}"]
    f += [f"end={page.tongue}_{one}_{last[-3:]}", f"end={one}_{last[-2:]}", f"len={min(len(last), 9)}_{one}", f"tb={page.tongue}_{state}_{begin}"]
    around = k[max(0, first - 4) : first] + k[after : after + 4]
    capital = sum(x[0] in "fcdb" for x in around)
    f += [f"cap={capital}_{one}", f"cap={capital}_{shape}"]
    if any(x[0] in "fcdb" for x in ks):
        f.append(f"common={sum(x[0] in 'cdb' for x in ks)}/{n}_{'t' if title else told}")
    return ["name:" + x for x in f]
