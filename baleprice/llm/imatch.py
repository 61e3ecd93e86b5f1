"""I-Match fingerprints, with DataFrame functions only.

Document frequencies are counted by the 64-bit hash of each term, over every document. The lexicon is the terms whose
inverse document frequency lies within a band: a table, joined with the terms of each text by whatever strategy its
measured size allows. A document keeps its distinct terms that are in the lexicon, sorted, and one hash of them for each
of several randomised subsets of the lexicon.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baleprice.llm.common import fresh, written

#: Terms are runs of letters, digits and non-ASCII characters, lower-cased.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The lexicon itself, then subsets that hold one in 2**level of it, three independent ones a level. A subset of which a
#: document has few terms is often kept by an edit; documents of any length have such subsets.
LEVELS, REPLICAS = (2, 4, 5, 6, 7, 8, 9, 10), 3
SUBSETS = tuple([(0, 0)] + [(level, r) for level in LEVELS for r in range(REPLICAS)])


def term_hashes(text: Column) -> Column:
    """The distinct terms of a text as 64-bit hashes, array<bigint>; null and empty texts: empty."""
    terms = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAKS), "")
    return F.array_distinct(F.transform(terms, lambda t: F.xxhash64(t)))


def lexicon(docs: DataFrame, text_col: str = "text", idf_band: tuple[float, float] = (3.0, 6.0)) -> DataFrame:
    """The terms (column ``term``, their hashes) whose ln(documents / document frequency) lies within the band, both ends
    included, written to the shared folder. Counts cover every document.

    A term of the band is in at least documents / e**high of them, so the lexicon has at most e**high (403) times as many
    terms as a document has distinct ones on average, however large the vocabulary or the corpus."""
    n = docs.count()
    low, high = (n / math.exp(b) for b in reversed(idf_band))
    counts = docs.select(F.explode(term_hashes(F.col(text_col))).alias("term")).groupBy("term").count()
    return written(counts.filter(F.col("count").between(low, high)).select("term"), "lexicon")


def _hashes(kept: Column, outside: Column) -> Column:
    """The hashes of a text, array<bigint> by subset, from its lexicon terms; null where the subset holds none of them.
    Without lexicon terms ``outside`` comes first, then nulls."""
    def subset(level: int, replica: int) -> Column:
        mask = ((1 << level) - 1) << (replica * 16)
        return F.filter(kept, lambda h: h.bitwiseAND(F.lit(mask)) == 0) if level else kept

    without = F.concat(F.array(outside), F.array_repeat(F.lit(None).cast("long"), len(SUBSETS) - 1))
    return F.when(F.size(kept) == 0, without).otherwise(F.transform(
        F.array(*[subset(*s) for s in SUBSETS]), lambda part: F.when(F.size(part) > 0, F.xxhash64(part))))


def fingerprints(rows: DataFrame, key: list[str], texts: dict[str, str], terms: DataFrame) -> DataFrame:
    """``rows`` with each column of ``texts`` replaced by the hashes of its text, array<bigint> under the name given.

    ``key`` is unique and not null. ``terms`` is a lexicon. A text with terms but none of the lexicon has the hash of all
    its terms first; one without terms has nulls only. A row's terms are filtered by the join before they are brought
    together, so only those of the lexicon are shuffled, and a group holds the terms of one row; the row's other columns
    go with an entry of its own (under a hash of the key), so that rows without lexicon terms stay and the join has no
    common key for them."""
    of, term, held, own = fresh(rows, "of", "term", "held", "own")
    other = [c for c in rows.columns if c not in key and c not in texts.values()]
    hashed = rows.select(*key, *other, *[term_hashes(F.col(c)).alias(f"{term}{i}") for i, c in enumerate(texts.values())])
    outside = [F.when(F.size(f"{term}{i}") > 0, F.xxhash64(F.array_sort(f"{term}{i}"))).alias(f"{term}{i}")
               for i in range(len(texts))]
    carried = hashed.select(*key, F.struct(*key, *other, *outside).alias(own),
                            *[f"{term}{i}" for i in range(len(texts))])
    nothing = F.lit(None).cast(carried.schema[own].dataType)

    def entry(i: int):
        return lambda t: F.struct(F.lit(i).alias(of), t.alias(term), nothing.alias(own))

    entries = carried.select(*key, F.inline(F.concat(
        F.array(F.struct(F.lit(-1).alias(of), F.xxhash64(*key).alias(term), F.col(own))),
        *[F.transform(f"{term}{i}", entry(i)) for i in range(len(texts))])))
    in_lexicon = terms.select(F.col("term").alias(term), F.lit(True).alias(held))
    kept = entries.join(in_lexicon, term, "left").filter((F.col(of) < 0) | F.col(held))
    found = kept.groupBy(*key).agg(
        F.first(own, ignorenulls=True).alias(own),
        *[F.sort_array(F.collect_list(F.when(F.col(of) == i, F.col(term)))).alias(f"{term}{i}") for i in range(len(texts))])
    return found.select(*[F.col(f"{own}.{c}") for c in key + other],
                        *[_hashes(F.col(f"{term}{i}"), F.col(f"{own}.{term}{i}")).alias(name) for i, name in enumerate(texts)])


def as_text(prints: Column) -> Column:
    """16 hexadecimal digits per subset, dashes where it is empty."""
    return F.array_join(F.transform(prints, lambda h: F.coalesce(
        F.lower(F.lpad(F.hex(h), 16, "0")), F.lit("-" * 16))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets that aren't empty in both; 1 if neither text has a term."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    held = F.size(F.filter(pairs, lambda p: p["a"].isNotNull() | p["b"].isNotNull()))
    same = F.size(F.filter(pairs, lambda p: p["a"] == p["b"]))
    return F.when(held == 0, F.lit(1.0)).otherwise(same / held)


def imatch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           idf_band: tuple[float, float] = (3.0, 6.0), terms: DataFrame | None = None) -> DataFrame:
    """One row per input row: id, prints (array<bigint>), fingerprint (string).

    Equal texts have equal fingerprints. A null text counts as empty; texts without any term have all dashes; ids may be
    null or repeated, as each row stands for itself (rows get a number before they are written); an empty table gives no
    rows. ``terms`` takes a lexicon fitted before, so that other texts can be compared with a corpus."""
    if terms is None:
        terms = lexicon(docs, text_col, idf_band)
    row, text = fresh(docs.select(id_col), "row", "text")
    rows = written(docs.select(F.col(id_col), F.col(text_col).alias(text), F.monotonically_increasing_id().alias(row)), "texts")
    return fingerprints(rows, [row], {"prints": text}, terms).drop(row).withColumn("fingerprint", as_text(F.col("prints")))
