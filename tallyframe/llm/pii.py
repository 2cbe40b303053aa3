"""Personal details inside free text, found by a semi-Markov conditional random field and replaced by placeholders.

Candidate segments are proposed generously, overlapping and of several kinds (`pii_candidates`); the model scores each whole segment with
its context, and a dynamic programme over the segments of a text chooses boundaries and kinds together.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pii_candidates import VOCABULARIES, Lexicon, Page, Segment, features, propose, read

#: Two details with at most so many characters between them influence each other.
NEAR = 3


def _links(cands: list[Segment]) -> tuple[list[int], list[range]]:
    """Per candidate: how many candidates end so early that they have no influence, and which end just before it."""
    ends = [c.end for c in cands]
    far = [bisect_right(ends, c.start - NEAR - 1) for c in cands]
    return far, [range(f, bisect_right(ends, c.start)) for f, c in zip(far, cands)]


def _pair(text: str, a: Segment, b: Segment) -> str:
    return f"{a.kind}>{b.kind}:{text[a.end : b.start].strip() or '_'}"


def find(text: str, lexicon: Lexicon, w: dict[str, float]) -> list[Segment]:
    """The details of a text: the non-overlapping choice of candidates with the greatest total score."""
    page = read(text, lexicon)
    return decode(page, propose(page), w)


def decode(page: Page, cands: list[Segment], w: dict[str, float]) -> list[Segment]:
    """The non-overlapping choice of segments with the greatest total score."""
    if not cands:
        return []
    far, near = _links(cands)
    get = w.get
    score = [sum([get(f, 0.0) for f in features(page, c)]) for c in cands]
    best: list[tuple[float, int]] = [(0.0, -1)]  # up to candidate i: value, last chosen
    value, back = [0.0] * len(cands), [-1] * len(cands)
    for i, c in enumerate(cands):
        v, last = best[far[i]]
        for j in near[i]:
            x = value[j] + get(_pair(page.text, cands[j], c), 0.0)
            if x > v:
                v, last = x, j
        value[i], back[i] = v + score[i], last
        best.append(max(best[-1], (value[i], i)))
    out, i = [], best[-1][1]
    while i >= 0:
        out.append(cands[i])
        i = back[i]
    return out[::-1]


def _log_add(xs: Sequence[float]) -> float:
    m = max(xs)
    return m + math.log(sum([math.exp(x - m) for x in xs]))


def fit(texts: list[tuple[str, set[tuple[int, int, str]]]], lexicon: Lexicon, rounds: int = 4, rate: float = 0.2, decay: float = 2e-3, least: int = 3) -> dict[str, float]:
    """Weights that maximise the conditional likelihood of the labelled segmentations (AdaGrad, one text at a time, averaged
    over the rounds after the first).

    `texts` pairs a text with its details as (start, end, kind). What fewer than `least` candidates show has no weight. Expectations come from the forward and backward sums over all
    segmentations of the text's candidates.
    """
    index: dict[str, int] = {}
    data = []
    for text, gold in texts:
        page = read(text, lexicon)
        cands = propose(page)
        if not cands:
            continue
        far, near = _links(cands)
        feats = [[index.setdefault(f, len(index)) for f in features(page, c)] for c in cands]
        pairs = [[(j, index.setdefault(_pair(text, cands[j], c), len(index))) for j in near[i]] for i, c in enumerate(cands)]
        after: list[list[tuple[int, int]]] = [[] for _ in cands]
        for i, js in enumerate(pairs):
            for j, p in js:
                after[j].append((i, p))
        order = sorted(range(len(cands)), key=lambda i: cands[i].start)
        starts = [cands[i].start for i in order]
        # candidates that start so late that they are beyond the influence of a pair
        beyond = [bisect_left(starts, c.end + NEAR + 1) for c in cands]
        on = frozenset(i for i, c in enumerate(cands) if (c.start, c.end, c.kind) in gold)
        data.append((feats, far, pairs, after, order, beyond, on))
    shown = [0] * len(index)
    for feats, _, pairs, *_ in data:
        for fs in feats:
            for f in fs:
                shown[f] += 1
        for ps in pairs:
            for _, p in ps:
                shown[p] += 1
    for feats, *_ in data:
        feats[:] = [[f for f in fs if shown[f] >= least] for fs in feats]
    w, seen, mean = [0.0] * len(index), [0.0] * len(index), [0.0] * len(index)
    steps = taken = 0
    exp = math.exp
    for turn in range(rounds):
        for feats, far, pairs, after, order, beyond, on in data:
            n = len(feats)
            s = [sum([w[f] for f in fs]) for fs in feats]
            fwd, upto = [0.0] * n, [0.0]
            for i in range(n):
                fwd[i] = s[i] + _log_add([upto[far[i]], *[fwd[j] + w[p] for j, p in pairs[i]]])
                upto.append(_log_add((upto[-1], fwd[i])))
            total = upto[-1]
            # backward: sum over what may follow a candidate; later starts come first
            bwd, rest = [0.0] * n, [0.0] * (n + 1)
            for x in range(n - 1, -1, -1):
                i = order[x]
                bwd[i] = _log_add([rest[beyond[i]], *[s[k] + bwd[k] + w[p] for k, p in after[i]]])
                rest[x] = _log_add((rest[x + 1], s[i] + bwd[i]))
            grad: dict[int, float] = {}
            for i in range(n):
                g = (i in on) - exp(min(0.0, fwd[i] + bwd[i] - total))
                if abs(g) > 1e-3:
                    for f in feats[i]:
                        grad[f] = grad.get(f, 0.0) + g
                for j, p in pairs[i]:
                    g = (i in on and j in on) - exp(min(0.0, fwd[j] + w[p] + s[i] + bwd[i] - total))
                    if abs(g) > 1e-3:
                        grad[p] = grad.get(p, 0.0) + g
            for f, g in grad.items():
                g -= decay * w[f]
                seen[f] += g * g
                w[f] += rate * g / math.sqrt(seen[f] + 1e-6)
            steps += 1
            if turn and steps % 50 == 0:
                mean = [a + b for a, b in zip(mean, w)]
                taken += 1
    if taken:
        w = [x / taken for x in mean]
    return {f: round(w[i], 3) for f, i in index.items() if abs(w[i]) > 0.01}


@lru_cache(maxsize=2)
def model(samples: int = 4000, seed: int = 7, vocabularies: tuple[str, ...] = VOCABULARIES) -> dict[str, float]:
    """Weights fitted to `samples` labelled texts that the training grammar writes (a documented bound; always the same)."""
    from .pii_grammar import write

    lexicon = Lexicon(vocabularies)
    return fit(write(samples, seed, lexicon), lexicon)


def details(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", weights: dict[str, float] | None = None, vocabularies: tuple[str, ...] = VOCABULARIES
) -> DataFrame:
    """One row per personal detail: doc_id, kind, start_pos and end_pos (characters before it and before what follows).

    Null and empty texts have none; repeated documents each count; an empty table gives no rows; extra columns are ignored.
    Texts and details of any length are read whole.
    """
    w = weights or model(vocabularies=vocabularies)
    kind = dict(docs.dtypes)[doc_id]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(vocabularies)
        for b in batches:
            rows = [(i, c.kind, c.start, c.end) for i, t in zip(b["i"], b["t"]) for c in find(t, lexicon, w)]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "start_pos", "end_pos"])

    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).where("t is not null and t <> ''")
    return rows.mapInPandas(each, f"doc_id {kind}, kind string, start_pos int, end_pos int")


def redact(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", weights: dict[str, float] | None = None, vocabularies: tuple[str, ...] = VOCABULARIES
) -> DataFrame:
    """Every document with each detail replaced by a placeholder of its kind, such as [EMAIL]: doc_id, text, n_details.

    Null texts stay null. See `details`.
    """
    w = weights or model(vocabularies=vocabularies)
    kind = dict(docs.dtypes)[doc_id]

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(vocabularies)
        for b in batches:
            out = []
            for i, t in zip(b["i"], b["t"]):
                if t is None:
                    out.append((i, None, 0))
                    continue
                found, parts, at = find(t, lexicon, w), [], 0
                for c in found:
                    parts += [t[at : c.start], f"[{c.kind.upper()}]"]
                    at = c.end
                out.append((i, "".join([*parts, t[at:]]), len(found)))
            yield pd.DataFrame(out, columns=["doc_id", "text", "n_details"])

    return docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).mapInPandas(rewrite, f"doc_id {kind}, text string, n_details int")
