import random

import pytest

from tallyframe.llm.labels import Matcher, distance, map_labels, normalise

ENTRIES = [
    (1, "Total net revenue"), (2, "Cost of goods sold"), (3, "Earnings per share, basic"), (4, "Earnings per share, diluted"), (5, "Deferred revenue, current"),
    (6, "Deferred revenue, non-current"), (7, "Property, plant and equipment, net"), (8, "Research and development expenses"), (9, "Deferred tax assets"), (10, "Deferred tax liabilities"),
    (11, "Right-of-use assets under operating leases"), (12, "Gross margin"), (13, "Operating costs [heading]"), (14, "Depreciation and amortization"),
]


@pytest.mark.parametrize(
    ("typed", "entry"),
    [
        ("TOTAL NET REVENUE", 1), ("13. Total net revenue (Note 9) *", 1), ("Total nct reevenue", 1), ("COGS", 2), ("5. Cost of good…", 2), ("Diluted EPS", 4), ("EPS, basic:", 3), ("Current deferred revenue", 5),
        ("Deferred rev., noncurr.", 6), ("Deferred  revenue (non-current) (unaudited)", 6), ("P.P. & E., net", 7), ("PP&E, net", 7), ("R & D exp.", 8), ("Research and dev. exp.", 8), ("Deferred tax liabi...", 10),
        ("ROU assets under operating leases", 11), ("margin Gross", 12), ("Operating c0sts [heading]", 13), ("d&a", 14), ("Vaccine cold-chain surcharge", 0), ("Deferred hatchery feed", 0), ("Operating ferry concessions", 0),
        ("Research vessel charter", 0), ("", 0), ("…", 0), ("*" * 5000, 0), ("12", 0),
    ],
)
def test_typed_labels(typed, entry):
    assert Matcher(ENTRIES).find(typed) == entry


@pytest.mark.parametrize("pad", [" " * 500, " (Note 9)" * 60, " (unaudited)" + "\u00a0" * 450 + "*"])
@pytest.mark.parametrize(("typed", "entry"), [("Total nct reevenue", 1), ("Diluted EPS", 4), ("margin Gross", 12), ("Def erredtax assets", 9), ("Vaccine cold-chain surcharge", 0)])
def test_padded_labels(typed, entry, pad):
    m = Matcher(ENTRIES)
    assert m.find(typed) == m.find(typed + pad) == m.find(pad + " " + typed) == entry


def test_long_texts_mean_no_entry():
    m = Matcher(ENTRIES)
    assert m.find("x" * 100_000) == m.find("deferred " + "revenues" * 1000) == m.find(" ".join(f"deferred{i:x}z tax" for i in range(5000))) == 0


def test_names_find_themselves_and_survive_typos():
    m, r = Matcher(ENTRIES), random.Random(1)
    right = total = 0
    for i, name in ENTRIES:
        assert m.find(name) == i and m.find(name.upper() + " ") == i
        for _ in range(30):
            k = r.randrange(len(name) - 1)
            typo = r.choice([name[:k] + name[k + 1 :], name[:k] + name[k + 1] + name[k] + name[k + 2 :], name[:k] + name[k] * 2 + name[k + 1 :]])
            total += 1
            right += m.find(typo) == i
    assert right / total > 0.98


def test_longest_mention_wins():
    m = Matcher(ENTRIES)
    assert m.find("Total net revenue and Cost of goods sold") == 2  # the longer of the two
    assert m.find("Gross margin; Deferred tax assets") == 9
    assert m.find("Gross margin of the ferry concession in the northern harbour district") == 0


def retyped(r, name):
    """A label as somebody else might type it: none of these ways was tuned on."""
    words = name.split(" ")
    for _ in range(r.choice([1, 1, 2])):
        x = r.random()
        k = r.randrange(len(words))
        if x < 0.35 and len(words[k]) > 4:
            i = r.randrange(1, len(words[k]) - 1)
            words[k] = r.choice([words[k][:i] + words[k][i + 1 :], words[k][:i] + words[k][i + 1] + words[k][i] + words[k][i + 2 :], words[k][:i] + r.choice("aeinrst") + words[k][i + 1 :]])
        elif x < 0.5 and len(words[k]) > 8:
            words[k] = words[k][:5] + "."
        elif x < 0.65:
            words = [r.choice([str.upper, str.lower, str.title])(w) for w in words]
        elif x < 0.8:
            words.append(r.choice(["(note 4)", "*", ":", "(restated)", "[2]"]))
        elif x < 0.9:
            words = [w for w in words if w.lower() not in ("of", "and", "the", "in", "on", "for")] or words
        else:
            words[k] = "  " + words[k]
    return " ".join(words)


def test_labels_of_another_typist():
    """Held out: entries retyped by a generator of this test, and labels of things that no entry stands for."""
    m, r = Matcher(ENTRIES), random.Random(77)
    total = right = 0
    for i, name in ENTRIES:
        for _ in range(60):
            total += 1
            right += m.find(retyped(r, name)) == i
    assert right / total > 0.97, right / total
    nouns = "Ferry Orchard Lantern Quarry Vessel Museum Pasture Gallery Aquarium Theatre".split()
    strange = [f"{a} {b} {c}" for a in nouns for b in ("revenue", "charter", "upkeep", "tickets") for c in ("fund", "costs", "sold")]
    assert sum(m.find(x) == 0 for x in strange) / len(strange) > 0.95


def test_distance_and_normalise():
    assert [distance(a, b) for a, b in (("", "ab"), ("ab", "ba"), ("kitten", "sitting"), ("same", "same"))] == [2, 1, 3, 0]
    assert normalise("  12. Cash & cash equiv…  ") == ("cash and cash equiv", True)


def test_tables(spark):
    df = spark.createDataFrame([(1, "COGS", 7), (2, None, 7), (3, "COGS", 7), (4, "nothing known", 7), (5, "", 7)], "id int, typed string, `__label` int")
    got = map_labels(df, "typed", ENTRIES)
    assert {r.id: r.label_id for r in got.collect()} == {1: 2, 2: None, 3: 2, 4: 0, 5: 0}
    assert map_labels(df.limit(0), "typed", ENTRIES).count() == 0
    with pytest.raises(ValueError):
        map_labels(df.withColumnRenamed("id", "label_id"), "typed", ENTRIES)
