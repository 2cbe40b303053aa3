"""Passages of evaluation items inside documents, whole, in part, or with other numbers, names and units."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, small

#: Consecutive words (or template tokens) a passage and a text must share.
WINDOW = 13
#: Fewest literal words of a window that is compared up to a change of its slots; rows of numbers alone are no passage.
LITERALS = 6
#: Bits of the maps of words and of windows that go to the workers: their size is fixed, whatever the number of items.
WORD_BITS, WINDOW_BITS = 1 << 23, 1 << 24
#: Words typed as units, and number words.
UNITS = frozenset(
    "percent pct usd eur gbp dollar dollars euro euros cent cents thousand million billion trillion hundred dozen day days week weeks month months "
    "quarter quarters year years hour hours minute minutes second seconds kg g km m cm mm mile miles ton tons tonne tonnes litre litres liter liters "
    "barrel barrels share shares unit units bps mwh kwh".split()
)
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fifteen twenty thirty forty fifty sixty seventy eighty ninety".split())
#: Codes of the placeholders; literal words have codes of 4 and more.
NUM, NAME, UNIT = 1, 2, 3
_WORD = re.compile(r"[A-Za-z0-9]+")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SENTENCE = re.compile(r"(?:^|[.!?;:]\W*|\n\s*)$")


def plain(text: str) -> str:
    """The text with the two letters that become ASCII only when lower-cased."""
    return text if text.isascii() else text.replace("K", "k").replace("İ", "i̇")


def _code(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word) | 4


@dataclass(frozen=True)
class BitMap:
    """A set of hashes as a map of a fixed number of bits: never forgets one, and takes few others for members."""

    bits: np.ndarray
    size: int

    @classmethod
    def of(cls, df: DataFrame, column: str, size: int) -> BitMap:
        """The map of a column of hashes, put together by an aggregation; at most size / 32,768 pieces of 4 KB reach the driver."""
        at = F.pmod(F.col(column), F.lit(size)) + 1
        parts = df.select(at.alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("m")).collect()
        out = np.zeros(size // 8, np.uint8)
        for r in parts:
            m = np.frombuffer(bytes(r.m), np.uint8)
            a = (r.b - 1) * len(m)
            out[a : a + len(m)] = m[: max(0, len(out) - a)]
        return cls(out, size)

    def has(self, h: np.ndarray) -> np.ndarray:
        """Whether each of the hashes (signed) may be a member."""
        p = np.mod(h, self.size)
        return (self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1

    def __contains__(self, h: int) -> bool:
        p = h % self.size
        return bool(self.bits[p >> 3] >> (p & 7) & 1)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def passage_words(items: DataFrame, passage: str) -> DataFrame:
    """word (its hash) and is_name of every word of the passages: a name is always capitalised, at least once inside a sentence."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["t"]:
                t = plain(t)
                for m in _WORD.finditer(t):
                    start = _SENTENCE.search(t[max(0, m.start() - 6) : m.start()]) is not None
                    rows.append((_signed(_code(m[0].lower())), not m[0][0].isupper(), m[0][0].isupper() and not start))
            yield pd.DataFrame(rows, columns=["word", "low", "inside"])

    found = items.select(F.col(passage).alias("t")).where("t is not null").mapInPandas(split, "word long, low boolean, inside boolean")
    return found.groupBy("word").agg((F.max("inside") & ~F.max("low")).alias("is_name"))


class Template:
    """Words to template codes, and texts to windows of them.

    Numbers, units and names become typed placeholders. A word that is a name in the passages is one in any text, whatever its case, so that
    a shared window has one template on both sides. In the coarse reading, for texts with other values, a whole number (with its
    marks) or a run of name words is one token, and a word that no passage has, or that is capitalised among words that are not, counts as a name.
    """

    def __init__(self, known: BitMap, names: BitMap, limit: int = 1_000_000):
        self.known, self.names, self.limit = known, names, limit
        self.codes: dict[str, tuple[int, bool]] = {}

    def code(self, spelt: str) -> tuple[int, bool]:
        """(code of the word alone, whether some passage may have it)."""
        got = self.codes.get(spelt)
        if got is None:
            w = spelt.lower()
            h = _code(w)
            known = _signed(h) in self.known
            if any(c.isdigit() for c in w) or w in NUMBER_WORDS:
                got = (NUM, True)
            elif w in UNITS:
                got = (UNIT, True)
            else:
                got = (NAME if known and _signed(h) in self.names else h, known)
            if len(self.codes) >= self.limit:
                self.codes.clear()
            self.codes[spelt] = got
        return got

    def read(self, words: list[str]) -> list[tuple[int, bool]]:
        """The code of each word alone, and whether some passage may have it."""
        get, code = self.codes.get, self.code
        return [get(w) or code(w) for w in words]

    def coarse(self, text: str, found: list[re.Match], words: list[str], read: list[tuple[int, bool]]) -> tuple[np.ndarray, dict[int, str], np.ndarray]:
        """(codes, surfaces of the placeholders by token in lower case, positions of the first word) of the tokens of the coarse reading.

        `text` is plain, `found` and `words` are its words and `read` their codes.
        """
        upper = [w[0].isupper() for w in words]
        before = np.concatenate(([0], np.cumsum(upper))).tolist()
        codes = np.array([c for c, _ in read], dtype=np.uint64)
        keep = np.ones(len(words), bool)
        surfaces: dict[int, str] = {}
        last, last_code = -2, 0  # the last placeholder: its last word's position, its code
        head = -1
        # words that are, or may become, placeholders
        for i in [i for i, (c, k) in enumerate(read) if c <= UNIT or not k or upper[i]]:
            code, known = read[i]
            w = words[i]
            gap = text[found[i - 1].end() : found[i].start()] if i else ""
            if code > UNIT:
                if not known:
                    code = NAME
                elif i and len(gap) < 6 and _SENTENCE.search(gap) is None:
                    a, b = max(0, i - 4), min(len(words), i + 5)
                    if 2 * (before[b] - before[a] - 1) < b - a - 1:
                        code = NAME
            if code > UNIT:
                continue
            low = w.lower()
            joined = False
            if last == i - 1 and last_code == code:
                if code == NAME:
                    joined = gap in _NAME_GAPS
                elif code == NUM:
                    joined = gap in (",", ".") and w[0].isdigit() or gap in (" ", "-") and low in NUMBER_WORDS and words[i - 1].lower() in NUMBER_WORDS
            if joined:
                keep[i] = False
                surfaces[head] += "_" + low
            else:
                head = i
                surfaces[i] = low
                codes[i] = code
            last, last_code = i, code
        at = np.flatnonzero(keep)
        token = {int(i): n for n, i in enumerate(at)} if surfaces else {}
        return codes[at], {token[i]: x for i, x in surfaces.items()}, at


def windows(codes: np.ndarray, size: int = WINDOW, least: int = 0, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(positions, signed hashes) of the windows with at least `least` literal words."""
    n = len(codes) - size + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.full(n, seed, np.uint64)
    for j in range(size):
        h = h * _BASE + codes[j : j + n]
    h ^= h >> np.uint64(29)
    at = np.arange(n)
    if least:
        run = np.concatenate(([0], np.cumsum(codes > UNIT)))
        at = np.flatnonzero(run[size:] - run[:-size] >= least)
    return at, h[at].view(np.int64)


_NAME_GAPS = frozenset((" ", "  ", "\u00a0", "-", ".", ". ", "'", "\u2019"))


def _slots(surfaces: list[str] | dict[int, str], codes: np.ndarray, at: int, size: int) -> str:
    """The surfaces of a window's placeholders, in order."""
    return " ".join(surfaces[i] for i in range(at, at + size) if codes[i] <= UNIT)


def consistent(ours: str, theirs: str) -> bool:
    """Whether replacing each slot value by another, one to one throughout the window, turns one list into the other."""
    a, b = ours.split(" "), theirs.split(" ")
    return len(a) == len(b) and len(set(zip(a, b))) == len(set(a)) == len(set(b))


def leaked_windows(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", size: int = WINDOW,
    changed: bool = True, literals: int = LITERALS,
) -> DataFrame:
    """Windows of `size` words that a document shares with a passage, up to a consistent change of its slots.

    Output: doc_id, item_id, doc_pos, item_pos (word positions), verbatim (all words equal) or not (same template, the
    slot values replaced one to one; not looked for without `changed`). Words are the longest runs of a-z and 0-9 in the lower-cased text.
    A window with changed slots has `size` tokens, whole numbers and whole names among them, `literals` of them literal words.
    Null and short texts or passages have no windows; repeated documents and items each count; empty tables give no
    rows; extra columns are ignored.

    Three maps of fixed size (the passages' words, their names, their windows) go to the workers, built by aggregations, so nothing
    that is sent grows with the items. Documents are read once, whole; a window leaves its worker only if the map of windows has it,
    and is joined by hash with those of the passages (broadcast only if small, else shuffled).
    """
    id_type, item_type = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    vocabulary = cut(passage_words(items, passage))
    known = BitMap.of(vocabulary, "word", WORD_BITS)
    names = BitMap.of(vocabulary.where("is_name"), "word", WORD_BITS)

    def emitter(only: BitMap | None):
        def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            template = Template(known, names)
            for b in batches:
                rows = []
                for i, t in zip(b["i"], b["t"]):
                    t = plain(t)
                    found = list(_WORD.finditer(t))
                    words = [m[0] for m in found]
                    read = template.read(words)
                    codes = np.array([c for c, _ in read], dtype=np.uint64)
                    at, h = windows(codes, size)
                    if only is not None and len(h):
                        kept = only.has(h)
                        at, h = at[kept], h[kept]
                    if len(at):
                        low = [w.lower() for w in words]
                        rows += [(i, int(p), int(x), _slots(low, codes, p, size), True) for p, x in zip(at, h)]
                    if changed:
                        codes, surfaces, first = template.coarse(t, found, words, read)
                        at, h = windows(codes, size, max(1, literals), 1)
                        if only is not None and len(h):
                            kept = only.has(h)
                            at, h = at[kept], h[kept]
                        rows += [(i, int(first[p]), int(x), _slots(surfaces, codes, p, size), False) for p, x in zip(at, h)]
                yield pd.DataFrame(rows, columns=["i", "pos", "h", "slots", "fine"])

        return emit

    def of(df: DataFrame, key: str, column: str, kind: str, only: BitMap | None) -> DataFrame:
        rows = df.select(F.col(key).alias("i"), F.col(column).alias("t")).where("t is not null")
        return rows.mapInPandas(emitter(only), f"i {kind}, pos long, h long, slots string, fine boolean")

    passages = cut(of(items, item_id, passage, item_type, None))
    theirs = passages.select(F.col("i").alias("item_id"), F.col("pos").alias("item_pos"), "h", "fine", F.col("slots").alias("item_slots"))
    ours = of(docs, doc_id, text, id_type, BitMap.of(passages, "h", WINDOW_BITS)).withColumnsRenamed({"i": "doc_id", "pos": "doc_pos"})

    @F.pandas_udf("boolean")
    def same_parameters(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([consistent(x, y) for x, y in zip(a, b)])

    met = ours.join(small(theirs), ["h", "fine"])
    cols = ["doc_id", "item_id", "doc_pos", "item_pos", "verbatim"]
    equal = met.where("fine and slots = item_slots").withColumn("verbatim", F.lit(True)).select(cols)
    if not changed:
        return equal
    other = met.where("not fine and slots <> item_slots").where(same_parameters("slots", "item_slots")).withColumn("verbatim", F.lit(False))
    return equal.unionByName(other.select(cols))


def leaks(found: DataFrame) -> DataFrame:
    """One row per affected document and item: how many windows of the passage stand in it verbatim and re-parameterised."""
    return found.groupBy("doc_id", "item_id").agg(
        F.countDistinct(F.when(F.col("verbatim"), F.col("item_pos"))).alias("verbatim_windows"),
        F.countDistinct(F.when(~F.col("verbatim"), F.col("item_pos"))).alias("changed_windows"),
        F.min("doc_pos").alias("first_pos"),
    )
