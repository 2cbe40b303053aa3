import os
import re
from collections import Counter

import duckdb
import pytest
from pii_cases import PLAIN, cases

from tallyframe.llm import pii, pii_candidates, pii_grammar

LEXICON = pii_candidates.Lexicon()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def find(text):
    return [(c.kind, text[c.start : c.end]) for c in pii.find(text, LEXICON, pii.model())]


def test_held_out_texts():
    """Other texts of the grammar."""
    right = wrong = missed = 0
    for text, gold in pii_grammar.write(300, 1234, LEXICON):
        got = {(c.start, c.kind) for c in pii.find(text, LEXICON, pii.model())}
        want = {(a, k) for a, _, k in gold}
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert right / (right + wrong) > 0.93 and right / (right + missed) > 0.9


def test_unseen_people_and_sentences():
    """Recall and precision per kind over names, frames and numbers that the grammar does not have."""
    every, right, wrong = Counter(), Counter(), Counter()
    for kind, detail, text in cases():
        got = find(text)
        every[kind] += 1
        right[kind] += (kind, detail) in got
        wrong.update(k for k, d in got if (k, d) != (kind, detail))
    for text in PLAIN:
        wrong.update(k for k, _ in find(text))
    for kind in pii_candidates.KINDS:
        assert right[kind] >= 0.9 * every[kind], (kind, right[kind], every[kind])
        assert right[kind] >= 0.9 * (right[kind] + wrong[kind]), (kind, right[kind], wrong[kind])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_grammar_and_cases_share_no_sentence_with_the_documents():
    folder = DATA.replace("sf0.001", "sf0.01")
    texts = "\n".join(t for (t,) in duckdb.sql(f"SELECT text FROM '{folder}/documents.parquet' WHERE text IS NOT NULL").fetchall())
    for f in pii_grammar.frames():
        for part in re.split(r"\{\w+\}", f):
            assert len(part) < 15 or part not in texts, part


def test_gates_lose_nothing(monkeypatch):
    """A text that a pattern's gate turns away holds no match of the pattern."""
    texts = [t for t, _ in pii_grammar.write(400, 5, LEXICON)] + [t for *_, t in cases()]
    texts += ["ir at host dot\ntest", "ir at host dot\u00a0test", "a\t@ b.test", "a[\nat\n]b.test", "PO Box 12", "Plaza Mayor 5", "C/ Sol 3"]
    gated = [pii_candidates.propose(pii_candidates.read(t, LEXICON)) for t in texts]
    monkeypatch.setattr(pii_candidates, "NEEDS", {})
    assert gated == [pii_candidates.propose(pii_candidates.read(t, LEXICON)) for t in texts]


def test_nothing_is_too_long_or_too_short():
    mail = "a" * 500 + "@" + "b" * 300 + ".example"
    assert ("email", mail) in find(f"Write to {mail}, please.")
    assert find("Anna Li. Li will retire") == [("name", "Anna Li"), ("name", "Li")]
    assert ("name", "van Zapras") in find("Mr. Konrad Veidt and Mr. van Zapras met. Then van Zapras left.")
    assert [d for k, d in find("The board asked Anna Maria Schmidt and Jan Dvořák to stay.")] == ["Anna Maria Schmidt", "Jan Dvořák"]


@pytest.mark.parametrize(
    ("text", "details"),
    [
        ("Mrs. Anna van Zapras met Dr. O'Flikorm.", [("name", "Anna van Zapras"), ("name", "O'Flikorm")]),
        ("Attn: Prenclanth-Boatrox, Tobias, 1508 Ferry Street, Suite 489, Felpalton, ZZ 00208, tel. +17135550134.",
         [("name", "Prenclanth-Boatrox, Tobias"), ("address", "1508 Ferry Street, Suite 489, Felpalton, ZZ 00208"), ("phone", "+17135550134")]),
        ("Questions? yusra+filings [at] ranfleaxmail [dot] test, or (206) 555-0151.", [("email", "yusra+filings [at] ranfleaxmail [dot] test"), ("phone", "(206) 555-0151")]),
        ("Taxpayer ID on the W-9: 666-61-1156. Insurance number QQ 43 53 62 C, line 206.555.0111.", [("id_number", "666-61-1156"), ("id_number", "QQ 43 53 62 C"), ("phone", "206.555.0111")]),
        ("Davor Tinhorciell & Sons Ltd. makes parts. Follow @quincarnd for updates. Inputs at 3.20 @ cost plus 3%.", []),
        ("Filed under accession number 9000000668-16-677842; central index key 9899997168; employer number 00-5619878. See sections 404.302.1 and 12-34-5678 of the manual.", []),
        ("The Main Street loan programme ended in 2018. Room 14 of the Mill Road site was sold for $825,249.", []),
        ("", []),
    ],
)
def test_texts(text, details):
    assert find(text) == details


@pytest.mark.parametrize("blank", ["\n", "\u00a0", "\t", " "])
def test_spelt_out_address_with_any_blank(blank):
    mail = f"ir at ranfleaxmail dot{blank}test"
    assert ("email", mail) in find(f"Questions? Write to {mail}, please.")


def test_tables(spark):
    rows = [(1, "Call back on +1 206 555 0151."), (2, None), (3, ""), (4, "nothing here"), (1, "Call back on +1 206 555 0151."), (5, "filler text. " * 60_000 + "Call back on +1 206 555 0151.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as kind", "2 as start_pos")
    got = sorted(tuple(r) for r in pii.details(docs).collect())
    assert got == [(1, "phone", 13, 28), (1, "phone", 13, 28), (5, "phone", 780_013, 780_028)]
    text = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert (text[1], text[2], text[3], text[4]) == ("Call back on [PHONE].", None, "", "nothing here")
    assert pii.details(docs.limit(0)).count() == 0
