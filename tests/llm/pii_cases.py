"""Held-out cases of personal details: people, places and sentences that the training grammar does not know."""

from __future__ import annotations

import random
import re

_FIRST = "Priya Dmitri Wei Aaron Brian Deborah Kevin Emily Ngozi Ricardo Bethany Tadashi Imani Clifford Rosalind Hamish Svetlana Oluwaseun Beatriz Ewan Dvora Łukasz".split()
_LAST = "Raghunathan Volkov Zhang Smith Cole Hale Park Stone Okonkwo Villanueva Thornton Watanabe Baptiste Hargreaves Lindholm MacLeod Sokolova Adeyemi Carvalho Pritchard Dvořák".split()
_FRAMES = {
    "name": "The board asked {} to oversee the coatings unit.|After {} left, output fell.|Questions were put to {} by two lenders.|{} will run the Leeds branch from May.|A settlement with {} was reached in June.|We met {} at the fair.|"
    "The pension of {} is unchanged.|{} has chaired the panel since 2011.|Invoices were approved by {}.|In her reply, {} called the offer too low.|Hence {} and the insurer fell out.|Auditor's contact: {}.|The estate of {} owns the barn.|"
    "Please copy {} on this.|Mr. {} did not attend.",
    "email": "You may drop a line to {} at any hour.|Replies were routed via {} last week.|The box {} is read daily.|Invoices go by mail ({}).",
    "phone": "You may ring the desk on {} at any hour.|The night line is {}.|Try {} before noon.|Voicemail was left under {} twice.",
    "id_number": "Her SSN, {}, had been copied.|A social security number ({}) was visible.|The worker with social security no. {} complained.",
    "address": "The depot keeper rents {} for storage.|Samples were shipped to {}.|The van was last seen near {}.|Bring the keys to {} by noon.",
}
#: Sentences without any detail.
PLAIN = """The Riverside Shopping Centre opened in Leeds.|Goldman Ridge Capital bought bonds.|Shares in Northern Copper rose.|The Annual General Meeting took place in Cape Town.|Deferred Tax Assets and Trade Payables fell.
On Tuesday Standard Chartered Bank cut its forecast.|The Clean Air Act applies in New South Wales.|Net Interest Margin was flat in South Korea.|Heavy rain closed the Mersey Tunnel.|Bluebird Airlines ordered jets from Airbus.
United Nations staff visited Lake Victoria.|Windows and Excel are trademarks of Microsoft.|The Black Friday sale helped Crown Retail.|Part Two covers Market Risk and Credit Risk.|Pump 4471-88 and valve 20-1184-07 failed in 2019.
Revenue was 1,204,331 in 2018, 1,100,280 in 2017.|File 0001193125-21-233411 replaced exhibit 10.14.|The fee is 0.125 % @ 90 days.|See rule 144.12 and note 17-4.|Sales of 20 Grand Pianos rose.""".replace("\n", "|").split("|")


def _detail(r: random.Random, kind: str) -> str:
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    if kind == "name":
        return f"{r.choice(_FIRST)} {r.choice(_LAST)}"
    if kind == "email":
        who = re.sub(r"[^a-z]", "", r.choice(_FIRST).lower())
        return r.choice([f"{who}@kestrel-lumber.com", f"{who}.desk@northquay.co.uk", f"{who}{n(2)} [at] quarrystone [dot] org", f"{who} (at) millbrookfarm.net"])
    if kind == "phone":
        return r.choice([f"+1 (4{n(2)}) 7{n(2)}-{n(4)}", f"2{n(2)}-8{n(2)}-{n(4)}", f"+44 161 {n(3)} {n(4)}", f"+33 6 {n(2)} {n(2)} {n(2)} {n(2)}", f"+1 3{n(2)} 4{n(2)} {n(4)} ext. {n(3)}"])
    if kind == "id_number":
        return f"5{n(2)}-{n(2)}-{n(4)}"
    way = r.choice(["Rosewood Heights", "Acacia Gardens", "Elm Street", "Fairview Avenue", "Harbor Drive", "Old Chapel Lane", "Sycamore Court"])
    return f"{r.randint(2, 980)} {way}, " + r.choice([f"Boston, MA 0{n(4)}", f"London SW{r.randint(1, 9)}A {r.randint(1, 9)}AB", f"Duluth, MN 5{n(4)}", "Suite 12, Salem, OR 97301"])


def cases(each: int = 8, seed: int = 3) -> list[tuple[str, str, str]]:
    """(kind, detail, sentence)."""
    r = random.Random(seed)
    out = []
    for kind, frames in _FRAMES.items():
        for f in frames.split("|"):
            for _ in range(each):
                d = _detail(r, kind)
                out.append((kind, d, f.format(d)))
    return out
