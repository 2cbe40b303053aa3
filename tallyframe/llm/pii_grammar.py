"""A grammar that writes labelled training texts for the model of personal details.

Its sentences are made up of frames of our own, filled with words drawn from a public vocabulary, so that the model learns the
build of a context and not its wording; people, places and numbers are invented.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

from .pii_candidates import GIVEN, STREETS, Lexicon

_ONSET = "b br c ch cl d dr f fl g gr h j k kr l m n p pr qu r s sh sk st t th tr v w y z".split()
_VOWEL = "a e i o u a e i o ai ea ie oa ou ee".split()
_CODA = "n nd nk l lt ll m r rd rn rk s st sk th x ck ng v".split()
_ENDS = "ova ev ich ski wala pour oglu sson dottir mann stein berg escu idis ez ira ano elli eau ier ova iya esh ani uki moto nathan swamy".split()
#: Given names and surnames of many languages, beside the invented ones.
_FIRST = "Abigail Ahmed Akira Alejandra Alexei Anjali Bogdan Brendan Camille Catherine Chloe Christopher Dariusz Diana Douglas Edward Eleanor Fernando Gareth Giulia Gustavo Haruka Heather Ilya Jasmine Joshua Kamala Kenneth Lakshmi Leila Malcolm Megan Mihai Naomi Nathan Nikhil Pavel Rajesh Rebecca Roberto Sanjay Sergei Shannon Tomasz Vanessa Vikram Wendy Xavier Yasmin Zhen".split()
_LAST = "Abbott Agarwal Ahn Barnes Becker Bianchi Brooks Carter Castillo Chopra Dalton Eriksen Farrell Ferrari Fischer Foster Gupta Hayes Horvat Hughes Ito Jensen Kaplan Khan Kovac Kumar Lambert Lindqvist Marsh Mehta Moreau Murphy Nakamura Novak Okafor Olsen Patel Petrov Quinn Reyes Romano Santos Schneider Shah Sutton Tanaka Turner Vargas Wallace Walsh Yamada Young".split()
_PARTS = "van von de der den du da di del la le ten bin al".split()


@lru_cache(maxsize=4)
def _words(lexicon: Lexicon) -> dict[str, list[str]]:
    """Words of the vocabulary by class, the frequent ones."""
    top = sorted(lexicon.rank, key=lambda w: (lexicon.rank[w], w))
    plain = [w for w in top if w.isascii() and 3 < len(w) < 12]
    return {
        "c": [w for w in plain if w.islower() and lexicon.of(w.capitalize()) in "fc"][:6000],
        "p": [w for w in plain if w.istitle() and lexicon.of(w) == "p"][:4000],
        "b": [w for w in plain if w.istitle() and lexicon.of(w) == "b"][:1500],
    }


class Writer:
    """Writes texts; `lexicon` lends it words."""

    def __init__(self, seed: int, lexicon: Lexicon):
        self.r = random.Random(seed)
        self.words = _words(lexicon)
        self.met: list[str] = []

    # -- words ------------------------------------------------------------------------------------------------------

    def rare(self, least: int = 1) -> str:
        r = self.r
        w = "".join(r.choice(_ONSET) + r.choice(_VOWEL) for _ in range(r.choice([least, least + 1, least + 1])))
        return w.capitalize() + (r.choice(_CODA) if r.random() < 0.6 else r.choice(_ENDS))

    def pick(self, kind: str) -> str:
        return self.r.choice(self.words[kind])

    def common(self) -> str:
        return self.pick("c")

    def heading(self) -> str:
        r = self.r
        ws = [self.pick("c").capitalize() if r.random() < 0.85 else self.pick("b") for _ in range(r.choice([1, 1, 2, 2, 3, 3, 4]))]
        if len(ws) > 2 and r.random() < 0.4:
            ws.insert(-1, r.choice(["of", "and", "for", "in"]))
        if len(ws) > 1 and r.random() < 0.35:
            ws[1:] = [w.lower() for w in ws[1:]]
        s = " ".join(ws)
        return s.upper() if r.random() < 0.1 else s

    def place(self) -> str:
        r = self.r
        w = r.choice([self.pick("p"), self.rare(), self.rare() + r.choice(["ton", "ford", "burg", "mere", "ville", "stadt"])])
        x = r.random()
        if x < 0.15:
            return r.choice(["New", "North", "South", "West", "Port", "San", "Saint", "Lake", "Upper"]) + " " + w
        return w + " " + self.pick("b" if r.random() < 0.5 else "c").capitalize() if x < 0.19 else w

    def house(self) -> str:
        r = self.r
        w = r.choice([self.pick("p"), self.rare(), self.rare(), self.pick("b"), self.pick("c").capitalize()])
        return w + " " + r.choice([self.pick("b"), self.pick("c").capitalize(), self.pick("c").capitalize()]) if r.random() < 0.35 else w

    def company(self) -> str:
        r = self.r
        end = r.choice("Inc. Corp. Ltd. PLC N.V. AG LLC GmbH S.A. Co. Limited Corporation LLP Inc Ltd".split())
        x = r.random()
        if x < 0.3:
            head = f"{self.given()} {self.surname(plain=True)} {r.choice(['& Sons', '& Co.', 'and Sons', 'Partners', 'Group', '& ' + self.surname(plain=True)])}"
        elif x < 0.4:
            head = f"{self.surname(plain=True)} & {self.surname(plain=True)}"
        else:
            head = self.house()
            if r.random() < 0.75:
                head += " " + r.choice("Energy Foods Mining Systems Logistics Biologics Paper Holdings Materials Instruments Group Bank Trust Capital Industries Technologies Pharma Services Partners International".split())
        return head + (" " if r.random() < 0.85 else ", ") + end if r.random() < 0.88 else head

    # -- people -----------------------------------------------------------------------------------------------------

    def given(self) -> str:
        r, x = self.r, self.r.random()
        return r.choice(GIVEN) if x < 0.45 else r.choice(_FIRST) if x < 0.7 else self.rare() if x < 0.9 else self.pick("p")

    def surname(self, plain: bool = False) -> str:
        r, x = self.r, self.r.random()
        s = self.rare() if x < 0.42 else r.choice(_LAST) if x < 0.62 else self.pick("p") if x < 0.74 else self.pick("b") if x < 0.88 else r.choice(GIVEN) if x < 0.91 else self.pick("c").capitalize()
        if plain:
            return s
        x = r.random()
        if x < 0.06:
            return "O'" + s
        if x < 0.08:
            return "Mc" + s
        if x < 0.15:
            return f"{s}-{self.rare()}"
        if x < 0.25:
            return f"{r.choice(_PARTS)} {s}" if r.random() < 0.8 else f"{r.choice(['van der', 'de la', 'von der'])} {s}"
        return s

    def initial(self) -> str:
        return self.r.choice("ABCDEFGHIJKLMNOPRSTVWY") + "."

    def name(self) -> str:
        """[[name]] in some form, with or without a title before it."""
        r = self.r
        g, s = self.given(), self.surname()
        x = r.random()
        if x < 0.5:
            n = f"{g} {s}"
        elif x < 0.6:
            n = f"{g} {self.initial()} {s}"
        elif x < 0.66:
            n = f"{g} {self.given()} {s}"
        elif x < 0.69:
            n = f"{g} {s} {self.surname(plain=True)}"
        elif x < 0.81:
            n = f"{s}, {g}" + (f" {self.initial()}" if r.random() < 0.12 else "")
        elif x < 0.92:
            n = f"{self.initial()} {s}" if r.random() < 0.8 else f"{self.initial()}{self.initial()} {s}" if r.random() < 0.5 else f"{self.initial()} {self.initial()} {s}"
        else:
            n = f"{g} {s}".upper()
        self.met.append(s)
        return f"{self.title() if r.random() < 0.12 else ''}[[name:{n}]]"

    def title(self) -> str:
        return self.r.choice(["Mr. ", "Mrs. ", "Ms. ", "Dr. ", "Mr ", "Ms ", "Prof. ", "Sir ", "Dame "])

    def titled(self) -> str:
        s = self.surname()
        self.met.append(s)
        return f"{self.title()}[[name:{s}]]"

    def again(self) -> str:
        """A surname met before, alone; without one, a titled surname."""
        return f"[[name:{self.r.choice(self.met)}]]" if self.met else self.titled()

    # -- contact data and numbers -----------------------------------------------------------------------------------

    def email(self) -> str:
        r = self.r
        word = lambda: self.rare().lower() if r.random() < 0.7 else self.common()
        u = r.choice([
            word() + str(r.randint(1, 99)), self.given().lower() + r.choice("._-") + word(), self.given().lower() + "+" + self.common(), r.choice(["ir", "info", "press", "legal"]),
            f"{self.common()}.{self.common()}", r.choice("abcdefghjkm") + word(), f"{self.given().lower()}_{word()}",
        ])
        u = u.encode("ascii", "ignore").decode()
        host = r.choice(["", "", "mail.", "corp."]) + word() + r.choice(["", "-ir", "-group", "mail", "-" + self.common()])
        tld = r.choice(["com", "org", "net", "co.uk", "de", "test", "invalid", "example", "example.com", "example.org"])
        at, dot = r.choices([("@", "."), (" [at] ", " [dot] "), (" (at) ", "."), (" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" @ ", "."), (" AT ", " DOT ")], [12, 2, 2, 1, 1, 1, 1, 1])[0]
        e = u + at + (host + "." + tld).replace(".", dot)
        return f"[[email:{e.upper() if r.random() < 0.05 else e}]]"

    def phone(self) -> str:
        r = self.r
        a, e, n = f"{r.randint(201, 989)}", f"{r.randint(200, 999)}", f"{r.randint(0, 9999):04d}"
        two = lambda: f"{r.randint(0, 99):02d}"
        extension = r.choice([" ext. ", " x", " ext ", " extension "]) + str(r.randint(1, 9999)) if r.random() < 0.1 else ""
        return "[[phone:" + r.choice([
            f"+1 {a} {e} {n}", f"+1 ({a}) {e}-{n}", f"({a}) {e}-{n}", f"{a}-{e}-{n}", f"{a}.{e}.{n}", f"1-{a}-{e}-{n}", f"+1{a}{e}{n}", f"{a} {e} {n}", f"{a} {e} {n}", self.abroad(), self.abroad(), f"+44 20 {r.randint(1000, 9999)} {n}", f"+44 {r.randint(1100, 1999)} {r.randint(100000, 999999)}", f"0{r.randint(20, 89)} {r.randint(1000, 9999)} {n}",
            f"+33 {r.randint(1, 9)} {two()} {two()} {two()} {two()}", f"0{r.randint(1, 9)} {two()} {two()} {two()} {two()}", f"+49 {r.randint(30, 89)} {r.randint(10000, 99999)} {r.randint(100, 999)}",
            f"+34 {r.randint(91, 98)} {r.randint(100, 999)} {two()} {two()}", f"+34 {r.randint(600, 699)} {r.randint(100, 999)} {r.randint(100, 999)}", f"({r.randint(20, 89)}) {r.randint(1000, 9999)} {n}",
        ]) + f"{extension}]]"

    def abroad(self) -> str:
        """A number with a country's prefix in groups of any size."""
        r = self.r
        mark = r.choice([" ", " ", "-", "."])
        return f"+{r.choice([1, 7, 20, 27, 31, 33, 34, 39, 41, 44, 46, 48, 49, 52, 55, 61, 81, 86, 91, 351, 353, 420, 971])}{mark}" + mark.join(
            "".join(r.choice("0123456789") for _ in range(r.choice([2, 3, 3, 4]))) for _ in range(r.choice([3, 3, 4]))
        )

    def social(self) -> str:
        s = self.r.choice(["-", "-", "-", " ", ""])
        return f"[[id_number:{self.r.choice(['000', '666', '987', str(self.r.randint(100, 899))])}{s}{self.r.randint(0, 99):02d}{s}{self.r.randint(0, 9999):04d}]]"

    def insurance(self) -> str:
        s = self.r.choice([" ", ""])
        return "[[id_number:" + s.join([self.r.choice(["QQ", "AB", "JK", "ZN"]), *(f"{self.r.randint(0, 99):02d}" for _ in range(3)), self.r.choice("ABCD")]) + "]]"

    def identity(self) -> str:
        r = self.r
        return "[[id_number:" + r.choice([f"{r.randint(0, 99999999):08d}{r.choice(['-', '-', ''])}{r.choice('ABCDEFGHJKLMNPQRSTVWXYZ')}", f"{r.choice('XYZ')}{r.randint(0, 9999999):07d}{r.choice('ABCDEFGH')}"]) + "]]"

    def document(self) -> str:
        """A passport or licence number, of a form that only its cue gives away."""
        r = self.r
        return "[[id_number:" + r.choice([
            f"{r.choice('CFGHKP')}{r.randint(0, 99999999):08d}", f"{r.choice('ABKL')}{r.choice('ABCZ')}{r.randint(100000, 9999999)}", f"{r.choice('DMSW')}{r.randint(100, 999)}-{r.randint(1000, 9999)}-{r.randint(1000, 9999)}",
            f"{r.choice(['MORGA', 'SMITH', 'VEIDT'])}{r.randint(100000, 999999)}{r.choice(['SM9IJ', 'AB1CD'])}", f"{r.randint(100000000, 999999999)}", f"{r.randint(10, 99)} {r.randint(100, 999)} {r.randint(100, 999)} {r.randint(100, 999)}",
        ]) + "]]"

    def town(self) -> str:
        r = self.r
        w = r.choice([self.rare(), self.rare(), self.pick("p")]) + ""
        return w + r.choice(["", "", "ton", "ford", " Falls", " Springs"]) if w else w

    def address(self) -> str:
        r = self.r
        sep = "\n" if r.random() < 0.15 else ", "
        state = r.choice(["NY", "TX", "CA", "MA", "WA", "IL", "ZZ", "OH", "QQ"])
        zipped = r.choice([f", {state} {r.randint(0, 99999):05d}", f" {r.randint(0, 99999):05d}", f", {state} {r.randint(10000, 99999)}-{r.randint(1000, 9999)}"])
        post = f" {r.choice(['SW', 'N', 'EC', 'LS', 'M'])}{r.randint(1, 20)}{r.choice(['', '', 'A'])} {r.randint(1, 9)}{r.choice('ABDEGH')}{r.choice('JLNPQR')}"
        tail = f"{sep}{self.town()}" + r.choice([zipped, zipped, "", post])
        if r.random() < 0.18:
            return f"[[address:{r.choice(['P.O. Box', 'PO Box', 'P. O. Box'])} {r.randint(10, 9999)}{tail}]]"
        part = lambda: r.choice([self.rare(), self.pick("b"), self.pick("c").capitalize(), self.pick("p"), r.choice(["Old", "North", "Upper", "Great"])])
        road = " ".join(part() for _ in range(r.choice([1, 1, 2])))
        coded = r.random() < 0.12
        kind = (" " + r.choice(["Rise", "Wharf", "View", "Ridge", "Chase", "Broadway", "Hollow", "Quay"])) if coded else " " + r.choice([s for s in STREETS if s not in ("Dr", "Pl", "Sq", "Row", "Close")])
        kind += "." if kind.strip() in ("St", "Rd", "Blvd", "Ave") and r.random() < 0.7 else ""
        room = r.choice(["", "", "", f", Suite {r.randint(1, 999)}", f", {r.choice([2, 3, 11, 12, 20, 37])}{'th'} Floor", f", Apt. {r.randint(1, 99)}", f" #{r.randint(1, 99)}"])
        if coded and not re.search(r"\d", tail):
            tail = f"{sep}{self.town()}" + r.choice([zipped, post])
        return f"[[address:{r.randint(1, 9999)}{r.choice(['', '', '', 'A', 'B'])} {road}{kind}{room}{tail}]]"

    def address_de(self) -> str:
        r = self.r
        street = r.choice(["Am " + self.rare(), "An der " + self.rare(), self.rare() + "straße", self.rare() + "weg", self.rare() + "allee", self.rare() + "platz", "Alte " + self.rare() + "gasse", "Lange Straße"])
        return f"[[address:{street} {r.randint(1, 180)}{r.choice(['', '', 'a'])}, {r.randint(0, 99999):05d} {self.town()}]]"

    def address_fr(self) -> str:
        r = self.r
        way = r.choice(["rue", "avenue", "quai", "place", "boulevard", "impasse"])
        of = r.choice(["des " + self.rare() + "s", "du " + self.rare(), "de la " + self.rare(), self.given() + " " + self.rare()])
        return f"[[address:{r.randint(1, 180)}{r.choice(['', '', ' bis'])} {way} {of}, {r.randint(0, 99999):05d} {self.town()}]]"

    def date(self) -> str:
        r = self.r
        y, m, d = r.randint(1998, 2029), r.randint(1, 12), r.randint(1, 28)
        month = r.choice("January February March April May June July August September October November December".split())
        return r.choice([f"{y}-{m:02d}-{d:02d}", f"{m:02d}/{d:02d}/{y}", f"{d} {month} {y}", f"{month} {d}, {y}", f"{d:02d}.{m:02d}.{y}"])

    def money(self) -> str:
        r = self.r
        return r.choice([f"${r.randint(1, 999)},{r.randint(0, 999):03d}", f"USD {r.randint(1, 9)},{r.randint(0, 999):03d},{r.randint(0, 999):03d}", f"${r.randint(1, 999)}.{r.randint(0, 9)} million", f"({r.randint(1, 99)},{r.randint(0, 999):03d})", f"EUR {r.randint(10, 999)} million"])

    def number(self) -> str:
        """A number that names a filing, a part, an account or an order."""
        r = self.r
        return r.choice([
            f"{r.randint(10**9, 10**10 - 1)}-{r.randint(10, 99)}-{r.randint(10**5, 10**6 - 1)}", f"{r.randint(10, 99):02d}-{r.randint(10**6, 10**7 - 1)}", f"{r.randint(1, 999):03d}-{r.randint(10**4, 10**5 - 1)}",
            f"{r.randint(10**9, 10**10 - 1)}", f"{r.randint(10, 99)}-{r.randint(10**4, 10**5 - 1)}-{r.randint(10, 99)}", f"{r.randint(100, 999)}-0{r.randint(1, 9)}", f"{r.randint(10**4, 10**5 - 1)}-{r.randint(10, 99)}", f"{r.randint(10, 99)}.{r.randint(100, 999)}.{r.randint(1, 9)}",
            f"{r.randint(1, 99)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}", f"{r.randint(100, 999)}{r.choice('ABKMZ')}{r.randint(10000, 99999)}", f"{r.randint(10**4, 10**5 - 1)} {r.randint(10**4, 10**5 - 1)}",
            f"{r.randint(10**6, 10**7 - 1)}{r.choice(['ZZ', 'QX'])}{r.randint(1, 99)}", f"{r.randint(600, 699)}-{r.randint(10, 99)}-{r.randint(1, 9)}",
        ])

    def german(self) -> str:
        r = self.r
        return r.choice(_NOUNS) if r.random() < 0.7 else r.choice(_NOUNS) + r.choice(_NOUNS).lower()

    def word(self, tongue: str, capital: bool = False) -> str:
        """An invented word with endings of a language."""
        r = self.r
        w = (r.choice(_ONSET) + r.choice(_VOWEL) + r.choice(_ONSET) + (r.choice(_VOWEL) + r.choice(_ONSET) if r.random() < 0.4 else "")) + r.choice(_ENDINGS[tongue])
        return w.capitalize() if capital else w

    # -- texts ------------------------------------------------------------------------------------------------------

    def fill(self, slot: str) -> str:
        make = {
            "N": self.name, "T": self.titled, "A": self.again, "s": lambda: f"[[name:{self.surname()}]]", "C": self.company, "E": self.email, "P": self.phone, "S": self.social, "I": self.insurance, "D": self.identity,
            "K": self.document, "L": self.address, "LD": self.address_de, "LF": self.address_fr, "date": self.date, "m": self.money, "num": self.number, "c": self.common,
            "Cc": lambda: self.common().capitalize(), "H": self.heading, "p": self.place, "h": self.house, "g": self.german, "n": lambda: str(self.r.randint(2, 99)), "y": lambda: str(self.r.randint(1998, 2029)),
            "v": lambda: self.r.choice(_VERBS), "role": lambda: self.r.choice(_ROLES), "Role": lambda: self.r.choice(_ROLES).title(), "body": lambda: self.r.choice(_BODIES),
            "aux": lambda: self.r.choice("is was has had will would may can did does could must".split()),
            "pn": lambda: self.r.choice("to of by with from for about against than via and or but like between".split()), "pp": lambda: self.r.choice("in at near from to of across outside around for".split()),
            "Job": lambda: self.r.choice(_JOBS), "Gn": lambda: self.word("de", True), "gw": lambda: self.word("de"), "fw": lambda: self.word("fr"), "Fw": lambda: self.word("fr", True), "ew": lambda: self.word("es"), "Ew": lambda: self.word("es", True),
            "Gl": lambda: self.r.choice(_LEADS["de"]), "Fl": lambda: self.r.choice(_LEADS["fr"]), "El": lambda: self.r.choice(_LEADS["es"]), "Lead": lambda: self.r.choice(_LEADS["en"]),
        }
        return make[slot]()

    def text(self) -> tuple[str, set[tuple[int, int, str]]]:
        r = self.r
        self.met = []
        marked = ""
        tongue = r.choices(["en", "de", "fr", "es"], [10, 1, 1, 1])[0]
        for _ in range(r.randint(2, 6)):
            good = r.random() < 0.5
            block = _FRAMES[tongue][0 if good else 1] if tongue != "en" and r.random() < 0.85 else _FRAMES["en"][0 if good else 1]
            frame = r.choice(block)
            s = _SLOT.sub(lambda m: self.fill(m[1]), frame)
            if not good and r.random() < 0.1:
                s = " ".join(w.capitalize() if w.isalpha() else w for w in s.split(" ")) if r.random() < 0.7 else s.upper()
            marked += (r.choice([" ", " ", " ", "  ", "\n\n", "\n", "\t", " &nbsp; "]) if marked else "") + s
        if r.random() < 0.1:
            marked = re.sub(r"(?<=\w) (?=\w)", lambda m: " " if r.random() < 0.1 else " &nbsp; "[1:-1] if r.random() < 0.03 else " ", marked)
        text, gold, at = "", set(), 0
        for m in _MARK.finditer(marked):
            text += marked[at : m.start()]
            gold.add((len(text), len(text) + len(m[2]), m[1]))
            text += m[2]
            at = m.end()
        return text + marked[at:], gold


_NOUNS = "Umsatz Ergebnis Aufsichtsrat Quartal Lieferant Zinssatz Hauptversammlung Vertrag Kunde Wachstum Werk Bericht Prüfung Markt Anlage Steuer Kosten Forderung Bilanz Aktie Anteil Gewinn Verlust Vermögen Standort Jahr Bank Preis Handel Absatz Lager Verkauf".split()
_VERBS = "said told wrote noted argued added resigned retired agreed declined replied objected spoke voted left joined explained confirmed denied signed testified warned".split()
_ROLES = "chief executive|finance director|general counsel|treasurer|company secretary|head of research|plant manager|chair|non-executive director|sales manager|controller|portfolio manager|engineer".split("|")
_BODIES = "the board|the committee|the bank|our auditors|the regulator|management|the court|the union|the lender|the council|the tribunal".split("|")
_JOBS = "Broker Banker Lawyer Economist Auditor Trader Surveyor Geologist Trustee Professor Actuary Reporter Treasurer Chairman Witness Senator Judge".split()
_ENDINGS = {
    "de": "ung ungen keit en er schaft satz liche ige ische isse te lich nis heit tum ern".split(),
    "fr": "tion tions ment ments eur euse ence ances ique iques ir é ée és aient ette age".split(),
    "es": "ción ciones dad dades mente ado ada ados ero era ía ías ar aron encia ivo".split(),
}
_LEADS = {
    "en": "The A An Our We It This These Those In At On By For With Yes No Thanks Please Also However Although While When Since After Before During Under Between Excluding Compared Had Of Neither Either Each Some Many There Here Then Now Management Shareholders They Its Such".split(),
    "de": "Der Die Das Ein Eine Im Am Zum Zur Nach Vor Bei Mit Ohne Unser Wir Es Diese Durch Seit Wegen Trotz Auch Alle Für".split(),
    "fr": "Au Aux Du Des Les Cette Ces Son Leur Avec Sans Selon Pour Sous Malgré Depuis Après Avant Pendant Une Un Nos Il Elle Le La".split(),
    "es": "Los Las Un Una Al Del Con Sin Según Para Por Desde Tras Durante Nuestro Su Sus Este Esta Hay No El La En".split(),
}
_SLOT = re.compile(r"\{(\w+)\}")
_MARK = re.compile(r"\[\[(\w+):(.*?)\]\]", re.S)
#: Frames of sentences with details (first block) and without any (second), by language. `|` parts frames.
_TEXTS = {
    "en": (
        """
{N} {v} that {c} and {c} were overdue.|{N} {v} on {date}.|"{Cc} is what we need," {v} {N}.|Speaking for {body}, {N} {v} the {c} plan.|{N} and {N} share an office in {p}.|{N}, {N} and {N} attended by video.|It was {N} who {v} first.|{body} wants {N} to chair the {c} group.
They hired {N} as {role}.|Ever since {N} took over, {c} has improved.|Because {N} {v}, the {c} was put off.|{C} named {N} {role}, replacing {N}.|{N} becomes {role} of {C} in {y}.|{N}, {role}|{N}, {role} of {C}, {v} yesterday.|our {role}, {N}, will {c} the {c}|{Role} {N} {v} to {body}.
A loan to {N} of {m} was repaid.|Shares held by {N}: {n} percent.|Trust deed in favour of {N} and of {N}.|Minutes taken by {N}.|Prepared by {N}, checked by {N}.|Witness: {N}|Witnesses: {N}; {N}|From: {N}\\nTo: {N}|From: {N} <{E}>|Sent by {N} ({E})|{N} ({role})|{N} | {role} | {P}|name: {N}; phone: {P}; mail: {E}|name={N},id={S}
Dear {T},|Dear {N},|Yours sincerely,\\n{N}|Kind regards\\n{N}\\n{role}|Best,\\n{N}\\n{P}\\n{E}|{N}\\n{L}|{N}\\n{L}\\n{P}|{N}\\n{E}|/s/ {N}|/s/ {N}\\n{N}\\n{Role}|Approved: {N}, {date}|Attention {N}|Attention: {N}, {L}, phone {P}.|To {N}, {L}, tel. {P}|{Cc}: {N}, {L}, {P}|{N}, {L}, {P}, {E}|{N}; {L}; tel. {P}|{c}: {N}, {L}, fax {P}.|{N}, {LD}, {P}|{Cc}: {N}, {LF}, {P}.|{Cc}: {L}, {P}|c/o {N}, {L}|cc {N}, {N}|Copy to: {N}, {E}
{T} {v} that the {c} of {p} mattered.|{T} and {T} {v}.|With {T} away, {T} {v} in their place.|According to {T}, {c} will {c}.|We are grateful to {T} and to {N}.|{T} of {C} {v} nothing.|A letter from {T} reached {body}.|the {c} that {T} {c}|Nobody but {T} {v}.|{T}: {Cc} the {c}?|{N}: Yes.|{N}: No, {c} first.|{N} - {Cc} {c} please
{N} {v}. {A} had {c} before.|{N} {v} and {A} {c} the {c}. Later {A} {v}.|{T} {v}; {A} did not.|As {A} {v}, {N} left.|{A}'s {c} was {c}.|{N}'s {c} and {A}'s {c} differ.|Then {A} {v}.|{A} {v} that {c} is {c}.|We asked {A} about {c}.
{N}'s {c} was {c} by {body}.|{Cc} the {c}, {N} {v}, or {c} it.|The {c} between {C} and {N} ended.|{N} sold {n} units to {C}.|On {date} {N} moved to {C}.|{N} of {p} {v}.|{N} will succeed {N} at {C}.|After the {c}, {body} thanked {N}.|What {N} {c} was {c}.|Neither {N} nor {N} {v}.
Ring {P} and ask for {N}.|Ring {P} or {P}.|Dial {P}, then press {n}.|Switchboard {P}, fax {P}.|mobile {P}|t: {P} f: {P}|Our number is {P}.|Text {P} to opt out.|Phone {P} between {n} and {n} hours.|hotline: {P}; web desk: {E}|Reach us under {E} or {P}.|Write to {E}.|E-mail {E} for a copy.|mail: {E}|Complaints: {E}|Forward it to {E}, please.|{E} or {E}|{E}|{P}|{L}
Deliver to {L}.|He moved to {L}.|Home: {L}|Office: {L}; {P}|Premises at {L} were searched.|The {c} came from {L} in {y}.|from {L} to {L}|{Cc} {c} from {L} on {date}.|{c} {c} at {L} or {P}|Visit us at {L}.|Registered office {L}.|The parcel for {N} went to {L}.|{N}, of {L}, {v}.|{N} lives at {L} with {N}.|Their post goes to {L} as before.|Summons served at {L} on {date}.|Return address: {L}.|The flat at {L} belongs to {N}.
{N}, SSN {S}|{N} ({S})|SSN: {S}|Her social security number is {S}.|Social security {S}, born {date}.|Form lists {S} as the worker's number.|NI number {I}|{N} (NI {I}) {v}.|His national insurance number, {I}, was printed.|taxpayer identification {S}|Individual tax ID {S} was shown.|ID card {D}|{N}, identity number {D}|Identity document {D} of {N}.
{N} holds passport {K}.|passport number {K} of {N}|Driving licence {K} was copied.|driver's license no. {K}|Passport: {K}|licence number {K}, {N}|travel with passport no. {K} only|Personal number {K} and {S}.|ID number {S} or {D}
{S}|{N};{S};{L}|{N}|{N} {date}|{c} log ({N}, {date})|{H} ({N}, {n})|{Cc} {c} ({N}, {date}): {c} {c}|{Cc} {c}. {N} was {c} {role} {c} {date}.|{Lead} {c} {N} {c} {c} {N}.|{Lead} {N} {c}, {c} {c}.|{c} {N} for {n} {c}|{Lead} {c} {pn} {N} {aux} {c}.|{N} {aux} {c} the {c} since {y}.|{N} {aux} {c} {c} {c}.|{Cc} {aux} {c} {pn} {N} by {c} {c}.|{Cc} {N} and the {c} {c}.|{Lead} {c} {aux} {N} {c}.|{Lead} {c}, {N} {c} the {c}.|{Lead} {c} {pn} {N} {c} {c}.|{Lead} {c} {c} {pn} {N} by {body}.|{c} {pn} {N} {c} {c}|{Lead} {c} {pn} {N}.|{Cc} {c} {c} {pn} {N} at {m}.|{Lead} {c} {c} {N} {c} the {c}.|{Lead} {c} {N} to {c} the {c} {c}.|{N}, {date}: {c} {c}|Notes of {N}|Chair: {N}. Secretary: {N}.|Counsel for {C}: {N}|Present were {N}, {N}, {N} and {N}.|Absent: {N}.|Nominees: {N} ({n}), {N} ({n}).|in the matter of {N}|{Job} {N} {v}.|{Job} {T} {v}.|{Lead} {c} {Job} {N}.|{Job} {N}, {P}|{Lead} {c} thanks {N} for {n} {c} of {c}.|{N} {v} {C} in {y}.|({c}) {N}|({c}) {N} {C} {v} {c}.|{N} v. {C}|The heirs of {N} {v}.|a claim by {N} against {C}|{N} (deceased)
""",
        """
{Cc} {c} and {c} {c} in {y}.|{Cc} {c} the {c} of {p}.|{H}|{H}\\n{Cc} {c} {c}.|{n}. {H}|{H}: {m}|Part {n} - {H}|The {H} was {c}.|{H} rose to {m} from {m}.|{H} and {H} were {c}.|In {p} the {c} is {c}.|from {p} to {p}|offices in {p}, {p} and {p}|{p} and {p} are {c}.|The {p} plant {c} {n} {c}.|our {p} site|near {p}
{C} {c} the {c}.|{C} and {C} {v} on {date}.|{C} {v} that {c} is {c}.|Shares of {C} fell.|{C}, a {c} of {C}, {v}.|the {c} with {C}|{C} acquired {C} for {m}.|{C}|{C} ({p})|the {h} {c}|{h} {c} {c}|We sold {h} in {y}.|The {h} brand|{h} and {h} are trademarks.|{h} products|a {h} licence|At {h}, we {c} {c}.|Under the {h} Act
{date}|{date}: {c} {c}|Between {date} and {date} {c} {c}.|Due {date} or {date}.|{m} and {m}|Of {m}, some {m} was {c}.|{n} percent, after {n}.{n} percent|Rule {n}.{n} and section {num}|See {num}.|Ref. {num}|Docket {num}|Ticket {num}, lot {num}|part no. {num}|Serial {num}|Registration {num}; index {num}|employer no. {num}|accession {num}|the SKU {num}|CUSIP {num}
Order {num} of {date}|account {num}|Contract {num} with {C}|ISIN XX{num}|firmware {n}.{n}.{n}|Box {n} of {n}|Rooms {n} and {n}|Level {n} {c}|Gate {n}, Hall {n}|Units of {n} x {n} mm|sold at {n} @ {n} each|@{c} on the web|Tweet @{c}{n}|#{c}|v{n}.{n}|pages {n}-{n}|ratio {n}:{n}|{n} {c} {n} {c}|route {n}|Highway {n} works|Pier {n}
The {h} Street {c} reopened.|the {h} Road depot|{h} Square and {h} Lane are {c}.|{n} {c} Street traders|Wall Street {v}.|High Street {c}|the {h} Park project|{h} Hill mine|{h} River {c}|Mount {h}|the {h} Bridge {c}|{h} Mill|{p} Airport|the {p} Court|{p} University {c}
The {Role} {v}.|The {Role} of {C}|{Role}:|{Role}s {c} {c}.|our {role} and our {role}|Chief Executive and {Role} {c}|{Cc} Committee|the {Cc} and {Cc} Committee {c}|Department of {Cc}|Ministry of {H}|Board of {Cc}s|the {Cc} Agreement|{Cc} Plan {y}|Series {n} {Cc} Notes|Class B {Cc}|Form {n}-{c}|Exhibit {n}.{n}|Schedule C|Annex B, {H}|Item {n}A. {H}
{Lead} {c} {c} {c}.|{Lead}, {c} {c}.|{Lead} {c}, {c} {c} {c} {m}.|{Lead} {H} {c} {c}.|{Lead}, {Lead} {c} {c}|{Lead} {c} {c} the {h} plant.|{c} {c} licence {c}. {Cc} file number {num}.|passport {c}. {Lead} {c} number {num}; {c}.|tax identity {c}; batch {num}
{Cc}: {Cc}, {Cc}, {Cc}|{Cc}, {Cc} and {Cc} {c}|{Cc}, {c}; {Cc}, {c}|Yes, {c} {c}.|No. {Cc} {c}.|Thanks, {c}.|Um, {c} {c} {c}.|Q: {Cc} {c}?|A: {Cc} {c}.|Moderator: {Cc} {c}.|Speaker: {Cc}|Note: {Cc} {c}|Source: {C}|{Cc} / {Cc}|{Cc} ({Cc})|"{Cc} {Cc}"|{Cc} {n}, {Cc} {n}|{Cc} & {Cc}|{Cc} - {Cc}
If {Cc} is {c}, {c} {c}.|of {Cc} and {Cc}|by {H}|with {Cc}|in {H}|for {Cc}|{Cc} was {m}, mainly {c}.|{Cc} {c} came to {m}.|We {c} {H} in {y}.|at {H}|to {H}|the {c} of {H}|{H} is {c} in {c}|{H}, {H} and {H}|{Cc} {Cc} {c} {m}|despite {H}|{Lead} {c} {pp} {p} {c} {c}.|{Lead} {c} {pp} {p} and {p} {c}.|{Lead} {c} {pn} {h} {c}.|{Lead} {c} {c} {pn} {C} by {body}.|{Lead} {c} {pn} {H}.|{Lead} {p} and {p} {c} {c}.|{Lead} {p} {c}, {c} {c}.|{Lead} {c} {pn} {p} {aux} {c}.|{h} {aux} {c} {c} since {y}.|{C} {aux} {c} the {c}.|{H} {aux} {c} {c}.|{Lead} {c} {pn} {H} {aux} {c}.|{Cc} {h} and the {c} {c}.|{Lead} {h} {c} {c} {C}.|asked about {H}|under {H} rules|{c} {c}, {c} {c} {c}.
On Monday {c} {c}.|By Friday, {date}|In March {y} {c} {c}.|Easter {c}|January and February {c}|Q{n} {y}|fiscal {y} and {y}|the {y} {Cc} Report|European {c}|Asian {Cc}|an American {c}|{p}-based {c}|the {p} Exchange|the {p} office of {C}|{p}, {p}|{p}, {n} {c}|Bank of {p}|Gulf of {p}|Republic of {p}
Employee {c} and {c}|Director {c}|Analysts {v}.|Investors {c} {c}.|Lenders to {C} {v}.|Dear shareholders,|Dear Sirs,|Ladies and gentlemen,|To whom it may concern|Sincerely,|Very truly yours,|Signature page|Contact {c}|Telephone {c}|Address {c}|E-mail is {c}.|a call on {n} {c}|P.O. {c}|passport {c} {n}|licence fees of {m}|Insurance {c} {n}|the ID {c} {n}
Patent {num} lapsed.|invoice {num} dated {date}|employer identification {num}|a driver's licence costs {m}|the permit {num} of {C}|Tax file of {C}: {num}|licence {num} for {h}|IBAN of {C} {num}|Purchase {num}, {num}, {num}
""",
    ),
    "de": (
        """
Herr {s} und Frau {s} leiten das {g}.|Frau {s} hat den {g} verlassen.|Das {g} wird von {N} geprüft.|{N} ist neuer Leiter {g}.|Nach Auskunft von Dr. {s} steigt der {g}.|Wir danken Herrn {s}.|Bitte wenden Sie sich an {N}, {E}.|Tel. {P}, Fax {P}|Anschrift: {LD}|{N}, {LD}|Sitz: {LD}, Telefon {P}
Post an {LD} oder {E}.|Ausweis {D} von {N}|Mit freundlichen Grüßen\\n{N}|{N}: der {g} ist gut.|Vorsitz: {N}|Kontakt: {N}, {LD}, Tel. {P}.|{Gn}: {N}, {LD}, {Gn} {P}.|{Gn}: {LD}, {P}|{N}, {LD}, Mobil {P}, {E}|{Gn} {LD} {gw}.|Ausweisnummer {K}|Die Stimme von {N} fehlte, Frau {s} war da.
""",
        """
Der {g} ist im {g} gestiegen.|Die {g} und das {g} bleiben im {g} stabil.|Für den {g} wurden {m} gezahlt.|Das {g} der {C} wurde für {m} verkauft.|{C} baut ein {g} in {p}.|Im {g} {y} sank der {g} um {n} Prozent.|{g} und {g}|{g}: {m}|Anhang {n}: {g}|Wegen des {g} wird der {g} nicht erhöht.
Der {g} erwartet von dem {g} mehr {g}.|Am {date} wurde das {g} mit der {g} geschlossen.|Ein {g} von {m} ist für die {g} nicht nötig.|{g} entstehen aus {g}.|Zum {g} siehe {num}.|Unser {g} in {p} hat {n} {g}.|{Gl} {Gn} {gw} {gw} {Gn}.|{Gn} {Gn} {gw} sich aus {gw} {Gn}.|{Gl} {gw} {Gn} {gw} auf {m}.|{Gn} {gw} an {Gn}.|{Gl} {Gn} {y} {gw} {n} {Gn} {gw}.|{Gn}, {Gn} und {Gn}|{Gl} {Gn} der {C} {gw} {m}.
""",
    ),
    "fr": (
        """
Mme {s} et M. {s} dirigent le groupe.|Monsieur {s} a quitté le conseil.|Le rapport est de {N}.|{N} est la nouvelle directrice des ventes.|Merci à {N} et à Mme {s} pour le travail.|Adresse : {LF}|Écrivez au {LF} ou à {E}.|Tél. {P}|Joindre {N} au {P}.|Le siège, {LF}, est fermé.|passeport {K} de {N}
Selon {N}, la dette est une charge.|Signé : {N}|{Fw} : {N}, {LF}, {fw}. {P}, {E}|{N}, {LF}, {P}|{N} ({E})|Fait par {N} le {date}.
""",
        """
Le chiffre est en hausse dans la région de {p}.|Les ventes de {C} ont baissé de {n} %.|La société {C} a cédé une usine pour {m}.|Au premier trimestre {y}, la marge est stable.|{H}|Les résultats du groupe sont bons.|Une provision de {m} a été passée.|La Banque de {p} et le Conseil sont d'accord.|Note {n} : dettes et charges|L'exercice {y} est clos.
Le Conseil a approuvé les comptes.|Dans la zone de {p}, la demande est en baisse.|{Fl} {fw} de l'{fw} {y}, {n} {fw} {fw}.|{Fl} {fw} {fw} à {m}.|{Fl} {fw} {fw} des {fw} {fw}.|{Fw} {fw} {fw}.|{Fl} {fw}, {fw} {fw} {C}.|{Fw} et {fw} {fw} {n} %.
""",
    ),
    "es": (
        """
La señora {s} y el señor {s} dejan el consejo.|El informe es de {N}.|{N} es la nueva directora de ventas.|Según {N}, la deuda baja.|Teléfono {P}, correo {E}|Llame a {N} al {P}.|DNI {D} de {N}|Con documento {D}|Firmado: {N}|{Ew}: {N}, {L}, {ew} {P}|{N}, {ew} {P}, {E}|Gracias a {N} por el trabajo.|pasaporte {K} de {N}|Sr. {s}: los costes bajan.|{N}, con domicilio en {L}, dice que no.
""",
        """
La deuda de {C} bajó en {y} a {m}.|El margen fue del {n} % en la zona de {p}.|Los activos de {C} suman {m}.|{H}|Durante el año {y} los costes suben.|En {p} la demanda fue débil.|Las ventas del grupo en {p} y {p} crecen.|Nota {n}: deudas y costes|El Consejo aprobó las cuentas de {y}.|Una provisión de {m} para el pleito.|El contrato {num} con {C} vence.|{El} {ew} {ew} {ew} de {m}.|{El} {ew} {y} {ew} {n} {ew}.|{Ew} {ew} {ew}.|{El} {ew} de {ew} {ew} {C}.|{Ew} y {ew} {ew} {n} %.
""",
    ),
}
_FRAMES = {k: tuple([f.replace("\\n", "\n") for line in block.strip().split("\n") for f in re.split(r"(?<! )\|(?! )", line) if f] for block in blocks) for k, blocks in _TEXTS.items()}


def frames() -> list[str]:
    """All frames of sentences."""
    return [f for blocks in _FRAMES.values() for b in blocks for f in b]


def write(count: int, seed: int, lexicon: Lexicon) -> list[tuple[str, set[tuple[int, int, str]]]]:
    """`count` texts, each with its details as (start, end, kind)."""
    w = Writer(seed, lexicon)
    return [w.text() for _ in range(count)]
