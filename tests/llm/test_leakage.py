import random
import re

import numpy as np

from tallyframe.llm.leakage import WORD_BITS, BitMap, _code, _signed, consistent, leaked_windows, leaks

WORDS = "the a reset date warehouse receipt of examiner should ringfence each duties under escrowed when pledged again its by and clause".split()


def words(t):
    return re.findall("[a-z0-9]+", t.lower())


def brute(docs, items, n=13):
    grams = lambda t: {tuple(w[i : i + n]) for w in [words(t)] for i in range(len(w) - n + 1)}
    e = {i: grams(p) for i, p in items if p}
    return {(d, i) for d, t in docs if t for i, g in e.items() if grams(t) & g}


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "'x' as slots")
    e = spark.createDataFrame(items, "item_id int, passage string")
    return leaked_windows(d, e)


def test_against_brute_force(spark):
    r = random.Random(5)
    items = [(i, " ".join(r.choice([*WORDS, "Skennenn", "Mokal", "12", "percent"]) for _ in range(40))) for i in range(12)] + [(50, None), (51, "too short")]
    docs = []
    for d in range(150):
        w = items[r.randrange(12)][1].split()
        a, n = r.randrange(25), r.choice([11, 12, 13, 14, 20])
        part = w[a : a + n]
        if r.random() < 0.4:
            part[r.randrange(len(part))] = r.choice(["other", "13", "Vievin"])
        text = " ".join(r.choice(WORDS) for _ in range(9)) + r.choice([". ", "\n", " -- "]) + r.choice([" ", ", ", "  "]).join(part) + ". The end"
        docs.append((d, r.choice([str, str.upper, str.lower, str.title])(text)))
    docs += [(900, None), (901, ""), (902, docs[0][1]), (903, "x " * 50000 + items[0][1]), (904, items[1][1].replace("k", "K"))]
    got = found(spark, docs, items).where("verbatim").select("doc_id", "item_id").distinct().collect()
    assert {tuple(r) for r in got} == brute(docs, items)


def test_changed_parameters(spark):
    passage = "When the warehouse receipt of Skennenn is pledged for 12 months then Skennenn should ringfence each levy of it"
    other = passage.replace("Skennenn", "Vievin").replace("12", "30")
    mixed = passage.replace("Skennenn", "Vievin", 1).replace("12", "30")
    rows = {r.doc_id: r for r in leaks(found(spark, [(1, passage), (2, other), (3, mixed), (4, "When the " * 20)], [(1, passage)])).collect()}
    assert rows[1].verbatim_windows == 7 and rows[1].changed_windows == 0
    assert rows[2].verbatim_windows == 0 and rows[2].changed_windows == 7
    # one name became two different ones: windows that hold both are no leak
    assert rows[3].verbatim_windows == 0 and 0 < rows[3].changed_windows < 7
    assert 4 not in rows
    assert consistent("a b a", "x y x") and not consistent("a b a", "x y z") and not consistent("a b", "x x")


def test_empty(spark):
    assert found(spark, [], [(1, "a " * 20)]).count() == 0
    assert found(spark, [(1, "a " * 20)], []).count() == 0


#: Passages with slots: numbers of any size, names of one to three words, units, written by hand for this test.
PASSAGES = [
    "In the spring quarter {n0} crates of copper wire were sold by {a} to {b}, who paid {n1} {u} for each of them and kept the rest in a shed near the canal",
    "{a} borrowed {n0} {u} from a local lender at a rate of {n1} percent and repaid the whole sum after the harvest because the price of barley had doubled",
    "If a train leaves the northern depot with {n0} passengers and {n1} {u} of coal while {a} waits at the southern gate, how long until both have met again",
    "The committee heard that {a} had moved {n0} pallets across the yard in {n1} {u}, which was faster than what {b} had promised when the deal was signed",
    "A farmer called {a} plants {n0} rows of beans and each row yields {n1} {u} of seed, so the barn that {b} built last year will soon be full to the roof",
]
NUMBERS = ["9", "12", "950", "1,250", "95.5", "12,400,318", "7", "3.25", "twenty", "40"]
NAMES = ["Skennenn", "Anna Vievin", "J. Mokal", "Olga Petrova Trask", "Brimholt", "Tove Ane Lund", "vievin"]
UNIT_WORDS = ["dollars", "tons", "hours", "weeks", "litres"]


def written(r, passage):
    a, b = r.sample(NAMES[:-1], 2) if r.random() < 0.8 else [NAMES[-1], NAMES[0]]
    n0, n1 = r.sample(NUMBERS, 2)
    return passage.format(n0=n0, n1=n1, a=a, b=b, u=r.choice(UNIT_WORDS))


def test_changed_values_of_other_lengths(spark):
    """Recall over passages whose numbers, names and units are all replaced, and precision over other texts."""
    r = random.Random(11)
    items = [(i, written(random.Random(1), p)) for i, p in enumerate(PASSAGES)]
    docs, want = [], set()
    for d in range(200):
        i = r.randrange(len(PASSAGES))
        docs.append((d, f"Before it stood some other text. {written(r, PASSAGES[i])}. And then more."))
        want.add((d, i))
    other = "The yard of the depot was full when a farmer signed the deal and the committee paid for the rest of the coal"
    docs += [(1000 + d, " ".join(r.sample(other.split(), 18)) + " " + " ".join(str(r.randrange(10**6)) for _ in range(30))) for d in range(100)]
    got = {(x.doc_id, x.item_id) for x in leaks(found(spark, docs, items)).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.95 * len(got), (len(got & want), len(want), len(got))
    # rows of numbers alone are no passage
    assert found(spark, [(1, " ".join(str(7 * k) for k in range(40)))], [(1, " ".join(str(3 * k) for k in range(30)))]).count() == 0


def test_maps_never_forget(spark):
    words = [f"w{k}" for k in range(20_000)]
    codes = [_signed(_code(w)) for w in words]
    m = BitMap.of(spark.createDataFrame([(c,) for c in codes], "h long"), "h", WORD_BITS)
    assert m.has(np.array(codes)).all() and all(c in m for c in codes[:500])
    assert m.has(np.array([_signed(_code(f"x{k}")) for k in range(20_000)])).mean() < 0.01
    assert not BitMap.of(spark.createDataFrame([], "h long"), "h", WORD_BITS).bits.any()
