"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import concept_key
from ..plans.registry import Registry
from ..session import cut, small
from ..sources.tables import table
from . import labels, leakage, packing, pii, survivors

R = Registry()
SQL_KEY = "regexp_replace(lower(regexp_replace(concept, '[\\s\\x{00A0}]+', '', 'g')), '^([^:_]*)[:_]', '\\1:')"

# -- best representative of each duplicate group --------------------------------------------------------------------

LINE = ["company_id", "statement", "concept_key", "axis", "member", "period_end"]
#: A 10-K or 10-Q followed by an A, however written.
AMENDMENT = r"^\s*10-?\s*[KQ]\s*[/-]?\s*A\b"


def dated_facts(spark: SparkSession, root: str) -> DataFrame:
    """Non-abstract facts with the filing date of their filing and what their trust is made of."""
    filings = table(spark, root, "filings").select(F.col("id").alias("filing_id"), "filing_date")
    facts = table(spark, root, "financial_facts").where("not is_abstract").withColumn("concept_key", concept_key("concept"))
    dated = facts.join(small(filings), "filing_id", "left")
    there = [F.col(c).isNotNull().cast("int") for c in ("weight", "unit", "comparative_value")]
    return dated.withColumns({
        "is_amendment": F.coalesce(F.upper("form_type").rlike(AMENDMENT), F.lit(False)),
        "present": there[0] + there[1] + there[2],
        "unit_key": F.lower(F.trim("unit")),
    })


#: Points of trust: an amendment, each of weight, unit and comparison on the measure's record, a comparison at all, a presentation at all.
POINTS = {"amended": 4, "present": 2, "comparison": 4, "comparison_amended": 2, "presentation": 2, "presentation_amended": 1}


def fact_bundles(points: bool) -> dict[str, survivors.Bundle]:
    """The measure with its source, the comparison, and the presentation.

    With `points`, trust adds up over the bundles, so that a record with a comparison may outweigh a measure that is trusted a little more; without,
    the measure alone decides and the other bundles follow it.
    """
    amended = F.col("is_amendment").cast("int")
    source = [F.col("is_amendment"), F.col("filing_date")]
    give = lambda c: c if points else None
    return {
        "measure": survivors.Bundle(
            ["value", "unit", "form_type", "filing_id", "period"], F.col("value").isNotNull(), [*source, F.col("present")], give(amended * POINTS["amended"] + F.col("present") * POINTS["present"])
        ),
        "comparison": survivors.Bundle(
            ["comparative_value", "comparative_period_end"], F.col("comparative_value").isNotNull(), source, give(amended * POINTS["comparison_amended"] + POINTS["comparison"])
        ),
        "presentation": survivors.Bundle(
            ["label", "weight", "position", "parent_id", "abstract_id"], F.col("weight").isNotNull() & F.col("label").isNotNull(), source,
            give(amended * POINTS["presentation_amended"] + POINTS["presentation"]),
        ),
    }


def fact_determinants() -> list[Column]:
    """What a survivor may have only one of: a unit, and an edition (amended or as first filed)."""
    return [F.col("unit_key"), F.col("is_amendment")]


_SQL_DATED = f"""
    f AS (SELECT f.*, {SQL_KEY} AS k, g.filing_date, coalesce(regexp_matches(upper(f.form_type), '^\\s*10-?\\s*[KQ]\\s*[/-]?\\s*A\\b'), false) AS amended,
                 (f.weight IS NOT NULL)::INT + (f.unit IS NOT NULL)::INT + (f.comparative_value IS NOT NULL)::INT AS present, lower(trim(f.unit)) AS u
          FROM financial_facts f LEFT JOIN filings g ON g.id = f.filing_id WHERE NOT f.is_abstract),
    n AS (SELECT *, count(*) OVER line AS n, min(id) OVER line AS line FROM f WINDOW line AS (PARTITION BY company_id, statement, k, axis, member, period_end)),
    g AS (SELECT * FROM n WHERE n >= 2),
    m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY value IS NULL, amended DESC, filing_date DESC NULLS LAST, present DESC, id) AS rn FROM g)
          WHERE rn = 1 AND value IS NOT NULL)"""


@R.add(f"WITH {_SQL_DATED} SELECT id FROM m")
def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Ids of the surviving facts: the records that give the measure bundle, whose order alone decides here."""
    facts = dated_facts(spark, root)
    return survivors.choose_bundles(facts, LINE, "id", fact_bundles(points=False), fact_determinants()).select(F.col("measure").alias("id"))


# every combination of whole bundles of a line is tried
_SQL_TRIED = f"""
    {_SQL_DATED},
    c AS (SELECT line, id, u, amended, filing_date, comparative_value, amended::INT * {POINTS["comparison_amended"]} + {POINTS["comparison"]} AS points FROM g WHERE comparative_value IS NOT NULL
          UNION ALL SELECT DISTINCT line, NULL::BIGINT, NULL, NULL, NULL, NULL, 0 FROM g),
    p AS (SELECT line, id, u, amended, filing_date, weight, label, amended::INT * {POINTS["presentation_amended"]} + {POINTS["presentation"]} AS points FROM g WHERE weight IS NOT NULL AND label IS NOT NULL
          UNION ALL SELECT DISTINCT line, NULL::BIGINT, NULL, NULL, NULL, NULL, NULL, 0 FROM g),
    tried AS (
        SELECT a.line, a.company_id, a.period_end, a.statement, a.k AS concept, a.axis, a.member, a.id AS measure, c.id AS comparison, p.id AS presentation, a.value, a.unit, c.comparative_value, p.weight, p.label,
               a.amended::INT * {POINTS["amended"]} + a.present * {POINTS["present"]} + c.points + p.points AS points,
               row_number() OVER (PARTITION BY a.line ORDER BY a.amended::INT * {POINTS["amended"]} + a.present * {POINTS["present"]} + c.points + p.points DESC,
                   a.amended::INT * {POINTS["amended"]} + a.present * {POINTS["present"]} DESC, a.amended DESC, a.filing_date DESC NULLS LAST, a.present DESC, a.id,
                   c.id IS NULL, c.points DESC, c.amended DESC, c.filing_date DESC NULLS LAST, c.id, p.id IS NULL, p.points DESC, p.amended DESC, p.filing_date DESC NULLS LAST, p.id) AS rn
        FROM g a JOIN c ON c.line = a.line JOIN p ON p.line = a.line
        WHERE a.value IS NOT NULL AND (c.id IS NULL OR c.amended = a.amended AND coalesce(c.u = a.u, true)) AND (p.id IS NULL OR p.amended = a.amended AND coalesce(p.u = a.u, true))
          AND (c.id IS NULL OR p.id IS NULL OR coalesce(p.u = c.u, true)))"""


@R.add(f"WITH {_SQL_TRIED} SELECT * EXCLUDE (line, rn, points) FROM tried WHERE rn = 1")
def p2_survivors(spark: SparkSession, root: str) -> DataFrame:
    """The surviving facts themselves, built from whole bundles whose trust adds up."""
    facts, bundles = dated_facts(spark, root), fact_bundles(points=True)
    chosen = cut(survivors.choose_bundles(facts, LINE, "id", bundles, fact_determinants()))
    built = survivors.build_survivors(facts, chosen, "id", bundles, LINE)
    return built.select(
        "company_id", "period_end", "statement", F.col("concept_key").alias("concept"), "axis", "member",
        "measure", "comparison", "presentation", "value", "unit", "comparative_value", "weight", "label",
    )


@R.add(f"WITH {_SQL_TRIED} SELECT m.id, t.measure FROM m JOIN tried t ON t.line = m.line WHERE t.rn = 1 AND t.measure <> m.id")
def p2_outweighed(spark: SparkSession, root: str) -> DataFrame:
    """Lines whose most trusted measure gives way to another one that comes with more: id of the one, measure of the other."""
    facts = dated_facts(spark, root)
    one, other = (survivors.choose_bundles(facts, LINE, "id", fact_bundles(points=p), fact_determinants()).select(*LINE, F.col("measure").alias(n)) for p, n in ((False, "id"), (True, "measure")))
    same = [one[c].eqNullSafe(other[c]) for c in LINE]
    return one.join(other, same).where("id <> measure").select("id", "measure")


@R.add()
def p2_branching(spark: SparkSession, root: str) -> DataFrame:
    """How many lines have a survivor, and in how many of them the search branches."""
    return survivors.branching(dated_facts(spark, root), LINE, "id", fact_bundles(points=True), fact_determinants())


# -- mapping free-entered values to the canonical list --------------------------------------------------------------


def typed_labels(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(labels of lines, labels of members) that are not an entry of the canonical list as they stand."""
    entries = table(spark, root, "canonical_labels")
    exact = small(entries.select(F.col("label").alias("typed")).distinct())
    o = table(spark, root, "concept_normalization_overrides")
    lines = labels.typed_rows(table(spark, root, "financial_facts"), "label", F.col("id").cast("string"), "label").unionByName(
        labels.typed_rows(o, "normalized_label", F.concat_ws("/", F.col("company_id").cast("string"), "statement", "concept"), "normalized_label")
    )
    members = labels.typed_rows(table(spark, root, "dimension_normalization_overrides"), "member_label", F.col("id").cast("string"), "member_label")
    odd = lambda df: df.where("typed is not null").join(exact, "typed", "left_anti").select("field", "row_key", "typed")
    return odd(lines), odd(members)


def mapped_labels(spark: SparkSession, root: str) -> DataFrame:
    """field, row_key, typed and label_id of every label typed otherwise than the canonical list has it."""
    lines, members = typed_labels(spark, root)
    entries = table(spark, root, "canonical_labels")
    return labels.map_labels(lines, "typed", labels.canonical(entries, ["line_item", "heading"])).unionByName(
        labels.map_labels(members, "typed", labels.canonical(entries, ["member"]))
    )


@R.add()
def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """The entry meant by each typed label, 0 if there is none."""
    return mapped_labels(spark, root).select("field", "row_key", "label_id")


@R.add()
def p4_unmatched(spark: SparkSession, root: str) -> DataFrame:
    """Report of typed labels that stand for no entry, with the number of rows that carry them."""
    return mapped_labels(spark, root).where("label_id = 0").groupBy("field", "typed").agg(F.count("*").alias("n_rows"))


# -- filling containers ---------------------------------------------------------------------------------------------


@R.add()
def p7_containers(spark: SparkSession, root: str) -> DataFrame:
    """The container of every document, or of every piece of a document that exceeds one."""
    return packing.fill_containers(packing.pieces(table(spark, root, "documents")))


@R.add()
def p7_report(spark: SparkSession, root: str) -> DataFrame:
    """How well the containers of all documents are filled, limit by limit."""
    return packing.fill_report(p7_containers(spark, root))


@R.add("SELECT doc_id, true AS whole, true AS within_limits FROM documents")
def p7_checked(spark: SparkSession, root: str) -> DataFrame:
    """Every document once: whether its pieces follow each other without a gap and are full but for the last, and whether its containers keep the limits."""
    packed = cut(p7_containers(spark, root))
    limits = packing.containers(packed).select(
        "container",
        ((F.col("tokens") <= packing.CAPACITY) & (F.col("segments") <= packing.SEGMENTS) & ((F.col("loss") <= packing.LOSS) | (F.col("loss") == F.col("most_loss")))).alias("kept"),
    )
    last = F.max("piece")
    whole = (F.count("*") == last + 1) & (F.sum("first_token") == packing.CAPACITY * last * (last + 1) / 2) & (
        F.sum(F.when(F.col("n_tokens") == packing.CAPACITY, 1).otherwise(0)) >= last
    )
    return packed.join(limits, "container").groupBy("doc_id").agg(whole.alias("whole"), F.min("kept").alias("within_limits"))


# -- evaluation texts leaking into training text --------------------------------------------------------------------


def _leaked(spark: SparkSession, root: str, changed: bool = True) -> DataFrame:
    return leakage.leaked_windows(table(spark, root, "documents"), table(spark, root, "eval_items"), changed=changed)


_SQL_WORDS = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_SQL_WINDOWS = f"""
    d AS (SELECT doc_id, {_SQL_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
    e AS (SELECT item_id, {_SQL_WORDS.format("passage")} AS w FROM eval_items WHERE passage IS NOT NULL),
    dw AS (SELECT doc_id, i AS pos, array_to_string(w[i:i + 12], ' ') AS win FROM d, unnest(range(1, len(w) - 11)) t(i)),
    ew AS (SELECT item_id, i AS pos, array_to_string(w[i:i + 12], ' ') AS win FROM e, unnest(range(1, len(w) - 11)) t(i))"""


@R.add(f"WITH {_SQL_WINDOWS} SELECT DISTINCT doc_id, item_id FROM dw JOIN ew USING (win)")
def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents that contain at least 13 consecutive words of an item's passage."""
    return _leaked(spark, root, changed=False).select("doc_id", "item_id").distinct()


@R.add(f"WITH {_SQL_WINDOWS} SELECT doc_id, item_id, count(DISTINCT ew.pos) AS verbatim_windows, min(dw.pos) - 1 AS first_pos FROM dw JOIN ew USING (win) GROUP BY ALL")
def p8_verbatim(spark: SparkSession, root: str) -> DataFrame:
    """Affected documents and items: how many windows of the passage stand in the text word for word, and where the first begins."""
    return leakage.leaks(_leaked(spark, root, changed=False)).drop("changed_windows")


@R.add()
def p8_leaks(spark: SparkSession, root: str) -> DataFrame:
    """Affected documents and items, with verbatim and re-parameterised windows counted apart."""
    return leakage.leaks(_leaked(spark, root))


# -- personal information -------------------------------------------------------------------------------------------


@R.add()
def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """One row per personal detail of a document."""
    return pii.details(table(spark, root, "documents")).select("doc_id", "kind", "start_pos")


@R.add()
def p9_redacted(spark: SparkSession, root: str) -> DataFrame:
    """Every document with its personal details replaced by placeholders."""
    return pii.redact(table(spark, root, "documents"))
