"""Mapping labels typed by hand to the entries of a canonical list."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Short forms that are no beginning or thinning of the words they stand for.
ALIASES = {
    "cogs": "cost of goods sold",
    "ppe": "property plant and equipment",
    "pp and e": "property plant and equipment",
    "p p and e": "property plant and equipment",
    "d and a": "depreciation and amortization",
    "g and a": "general and administrative",
    "r and d": "research and development",
    "eps": "earnings per share",
    "rou": "right of use",
    "sbc": "stock based compensation",
    "ar": "accounts receivable",
    "ap": "accounts payable",
}
#: Words that say little about which entry is meant.
LIGHT = frozenset("a an and at by for from in less of on or other than the to under".split())
#: Digits and marks that stand for letters they look like.
LOOKALIKES = str.maketrans({"0": "o", "1": "l", "3": "e", "5": "s", "8": "b", "@": "a", "$": "s"})
#: Least token-set similarity of an accepted entry.
LEAST = 0.74
#: Entries of a canonical list at most.
MOST_ENTRIES = 100_000
#: Least share of a label's letters that an embedded mention must make up.
LEAST_MENTION = 0.6

_NOISE = re.compile(r"\(\s*(?:notes?\s*\d+|unaudited|audited|restated|[a-z]|\d{1,2})\s*\)|\[\d+\]|\bnotes?\s+\d+\b", re.I)
_LEAD = re.compile(r"^\s*(?:\(?\d{1,3}[.)]\s+|[-*•]\s+)")
_TAIL = re.compile(r"[\s*:;,†‡]+$")
_CUT = re.compile(r"(?:…|\.{2,})[\s.:;*]*$")
_TOKEN = re.compile(r"[a-z]+")


def normalise(text: str) -> tuple[str, bool]:
    """(plain lower-case words, whether the label was visibly cut off)."""
    s = unicodedata.normalize("NFKC", text.replace("…", "\x00")).replace("\x00", "…").lower()
    s = re.sub(r"\s+", " ", _LEAD.sub("", s))
    s = _NOISE.sub(" ", s)
    s = _TAIL.sub("", s)
    cut = bool(_CUT.search(s))
    s = _CUT.sub("", s)
    s = re.sub(r"(?<=[a-z])[013458@$](?=[a-z]|\b|$)|(?<![\w])[013458@$](?=[a-z]{2})", lambda m: m[0].translate(LOOKALIKES), s)
    s = re.sub(r"\b(?:non |([a-z]{2,4})-)(?=[a-z])", lambda m: "non" if m[1] is None or distance(m[1], "non") < 2 else m[0], s)
    s = re.sub(r"[&+/]", " and ", s).replace("’", "'").replace("'", "")
    return " ".join(_TOKEN.findall(s)), cut


def _deletes(w: str, most: int = 2) -> set[str]:
    out, edge = {w}, {w}
    for _ in range(most):
        edge = {x[:i] + x[i + 1 :] for x in edge for i in range(len(x))}
        out |= edge
    return out


def distance(a: str, b: str) -> int:
    """Edits between two words: insertion, deletion, substitution and the swap of neighbours."""
    before, now = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, now = before, now, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            now.append(d)
    return now[-1]


def _thinned(short: str, word: str) -> bool:
    """Whether `short` has the first letter of `word` and its other letters in order."""
    if short[0] != word[0]:
        return False
    rest = iter(word)
    return all(c in rest for c in short)


class Matcher:
    """Maps typed labels to the entries of one canonical list.

    1. An automaton over the normalised names and their aliases finds the mentions embedded in the label; the longest
       non-overlapping one wins if the mentions make up most of the label.
    2. Other labels go to token-set similarity: words are matched whatever their order, forgiving up to two edits, short
       forms and a cut end; words shared by many entries weigh little. The best entry counts if it is similar enough.
    Labels that meet neither mean no entry (0).
    """

    def __init__(self, entries: Sequence[tuple[int, str]]):
        import ahocorasick

        self.ids = [i for i, _ in entries]
        self.names = [normalise(label)[0] for _, label in entries]
        self.tokens = [list(dict.fromkeys(n.split())) for n in self.names]
        seen = Counter(t for ts in self.tokens for t in ts)
        self.weight = {t: 0.25 if t in LIGHT else 1 + 0.25 * math.log(len(entries) / n) for t, n in seen.items()}
        self.total = [sum(self.weight[t] for t in ts) for ts in self.tokens]
        self.of = defaultdict(list)
        for k, ts in enumerate(self.tokens):
            for t in ts:
                self.of[t].append(k)
        self.longest = max(map(len, self.weight), default=0)
        self.by_first = defaultdict(list)  # a short form or beginning has the first letter of its word
        for t in self.weight:
            self.by_first[t[0]].append(t)
        self.near = defaultdict(set)
        for t in self.weight:
            for d in _deletes(t, 2 if len(t) > 4 else 1 if len(t) > 2 else 0):
                self.near[d].add(t)
        self.automaton = ahocorasick.Automaton()
        for k, n in enumerate(self.names):
            for form in {n, *(n.replace(full, short) for short, full in ALIASES.items() if full in n)}:
                if form and f" {form} " not in self.automaton:
                    self.automaton.add_word(f" {form} ", (k, len(form)))
        self.automaton.make_automaton()
        self.similar: dict[str, dict[str, float]] = {}
        self.known: dict[str, int] = {}

    def mention(self, words: str) -> int | None:
        """The longest of the mentions that do not overlap (of equally long ones the first), if they make up most of the label."""
        padded = f" {words} "
        found = sorted(((n, -end, k) for end, (k, n) in self.automaton.iter(padded)), reverse=True)
        taken: list[tuple[int, int, int]] = []
        for n, end, k in found:
            a, b = -end - n - 1, -end  # the blanks around a mention may be shared
            if all(b <= x or a >= y for x, y, _ in taken):
                taken.append((a, b, k))
        return taken[0][2] if taken and sum(b - a for a, b, _ in taken) >= LEAST_MENTION * len(padded) else None

    def alike(self, token: str) -> dict[str, float]:
        """Canonical words a typed word may stand for, with how alike they are."""
        if token in self.similar:
            return self.similar[token]
        out: dict[str, float] = {}
        if token in self.weight:
            out[token] = 1.0
        if 2 < len(token) <= self.longest + 3:  # a longer one is more than three edits from every word
            for d in _deletes(token, 2 if len(token) > 4 else 1):
                for t in self.near.get(d, ()):
                    e = distance(token, t)
                    if 0 < e <= (2 if len(t) > 4 else 1):
                        out[t] = max(out.get(t, 0), 1 - e * (0.9 / max(len(t), 4)) - 0.02)
            if not out and len(token) > 4:
                for t in self.by_first[token[0]]:
                    if len(t) > 5 and abs(len(t) - len(token)) < 4 and distance(token, t) == 3:
                        out[t] = 1 - 2.7 / len(t) - 0.02
            for t in self.by_first[token[0]]:
                if len(token) < len(t) - 1 and len(t) > 4:
                    if t.startswith(token):
                        out[t] = max(out.get(t, 0), 0.86)
                    elif len(token) > 3 and len(token) * 2 >= len(t) - 2 and _thinned(token, t) or len(token) == 3 and len(t) < 9 and _thinned(token, t):
                        out[t] = max(out.get(t, 0), 0.72)
        if len(self.similar) > 200_000:
            self.similar.clear()
        self.similar[token] = out
        return out

    def similarity(self, words: str, cut: bool) -> tuple[float, int]:
        """(similarity, index) of the best entry."""
        typed = list(dict.fromkeys(words.split()))
        if not typed:
            return 0.0, -1
        like = [self.alike(t) for t in typed]
        last = typed[-1]
        begun = {t for t in self.by_first[last[0]] if t.startswith(last) and t != last} if len(last) < 3 or cut else set()
        worth = [0.25 if t in LIGHT or len(t) < 2 else 1.3 for t in typed]
        most = sum(w * max(al.values(), default=0.0) for w, al in zip(worth[:-1], like)) + worth[-1]
        if 2 * most < (LEAST - 1e-6) * (most + sum(worth)):  # too many foreign words: an entry found in full would not be similar enough
            return 0.0, -1
        score: dict[int, dict[str, float]] = defaultdict(dict)
        for i, al in enumerate(like):
            for t, s in [*al.items(), *((t, 0.9) for t in begun if i == len(like) - 1)]:
                for k in self.of[t]:
                    if s > score[k].get(t, 0):
                        score[k][t] = s
        best = (0.0, 0, -1)
        for k, got in score.items():
            ours = sum(self.weight[t] * s for t, s in got.items())
            need = self.total[k]
            # what a label of few words that is cut off leaves out does not count against it in full
            name = self.names[k]
            short = len(name) > len(words) and (cut or len(words) >= 8) and self.tokens[k][0] in got
            if short and (name.startswith(words) or (len(words) > 7 and distance(words, name[: len(words)]) <= 1 + len(words) // 12)):
                need = min(need, ours + (0.25 if cut else 0.6) * max(0.0, need - ours))
            back = full = 0.0
            have = set(self.tokens[k])
            for i, t in enumerate(typed):
                hit = max((s for x, s in like[i].items() if x in have), default=0.0)
                if i == len(typed) - 1 and hit < 0.9 and any(x in have for x in begun):
                    hit = 0.9
                back += worth[i] * hit
                full += worth[i]
            r, p = ours / need, back / full
            f = 2 * r * p / (r + p) if r + p else 0.0
            best = max(best, (round(f, 6), -k, k))
        return best[0], best[2]

    def __call__(self, text: str) -> int:
        if text not in self.known:
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[text] = self.find(text)
        return self.known[text]

    def find(self, text: str) -> int:
        """The entry meant by a typed label, 0 if none."""
        words, cut = normalise(text)
        k = self.mention(words)
        if k is None:
            spelt = f" {words} "
            for short, full in ALIASES.items():
                spelt = spelt.replace(f" {short} ", f" {full} ")
            words = spelt.strip()
            k = self.mention(words)
        if k is None:
            s, k = self.similarity(words, cut)
            if s < LEAST:
                k = self.run_together(words)
        return self.ids[k] if k is not None else 0

    def run_together(self, words: str) -> int | None:
        """The entry a label differs from by at most two edits when blanks are left out (words joined or parted by mistake)."""
        s = words.replace(" ", "")
        if len(s) < 8:
            return None
        near = [(distance(s, n.replace(" ", "")), k) for k, n in enumerate(self.names) if abs(len(s) - len(n.replace(" ", ""))) <= 2]
        d, k = min(near, default=(9, 0))
        return k if d <= 2 else None


def map_labels(df: DataFrame, label: str, entries: Sequence[tuple[int, str]], name: str = "label_id") -> DataFrame:
    """Add `name`: the id of the entry each typed label means, 0 if none, null for a null label.

    `entries` is the canonical list of (id, label), bounded by its author. Empty labels mean no entry. Each distinct
    label is mapped once, wherever it stands, and joined back (skew in the labels is left to the adaptive join).
    All columns of `df` are kept; `name` must not be one of them. An empty table stays empty.
    """
    if name in df.columns:
        raise ValueError(f"column {name} exists")
    entries = list(entries)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(entries)
        for b in batches:
            yield pd.DataFrame({"__label": b["__label"], name: [matcher.find(x) for x in b["__label"]]})

    # few bytes but much work a row: dealt to a fixed number of tasks, which adaptive execution leaves alone
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    typed = df.select(F.col(label).alias("__label")).where("__label is not null").distinct().repartition(tasks)
    mapped = typed.mapInPandas(find, f"__label string, {name} int")
    return df.join(mapped, df[label] == mapped["__label"], "left").drop("__label")


def canonical(df: DataFrame, kinds: Sequence[str]) -> list[tuple[int, str]]:
    """The canonical list of some kinds; a list of more than MOST_ENTRIES raises, since every worker holds it."""
    rows = df.where(F.col("kind").isin(*kinds)).orderBy("label_id").limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"a canonical list has at most {MOST_ENTRIES} entries")
    return [(r.label_id, r.label) for r in rows]


def typed_rows(df: DataFrame, field: str, row_key: Column, label: str) -> DataFrame:
    """(field, row_key, typed) of a table whose column `label` was typed by hand."""
    return df.select(F.lit(field).alias("field"), row_key.alias("row_key"), F.col(label).alias("typed"))
