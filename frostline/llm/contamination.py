"""Benchmark decontamination: MinHash containment search, partitioned by size, with exact verification.

A test item is short and a document may be long, so their Jaccard similarity says nothing; containment does. Items are partitioned by
the power of two under their number of distinct word shingles. In a partition every item is sketched by its m smallest shingle hashes (its
bottom-m MinHash), where m is over (1 - c) times the partition's largest size: a document that holds the part c of an item's shingles must
hold one of the m. So the search loses nothing, at any document length. Candidates (document, item) whose sizes allow the containment
are verified by intersecting the whole shingle sets. An item of under five words is one shingle, all its words; documents give their runs of
as many words too, for each such length that an item has.

Documents are never shuffled in the search: shingles meet the sketches in a broadcast join while the sketches' counted number allows it,
in a shuffled join of hashes beyond. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm.common import Scratch, maybe_broadcast, packed, text_or_empty, unpacked

WORDS, CONTAINMENT = 5, 0.8
#: Most sketch rows (16 bytes each), candidates and items that are broadcast.
SKETCH_ROWS, CANDIDATE_ROWS, ITEM_ROWS = 2_000_000, 200_000, 20_000


def words(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))


def _runs_of(ws: Column, k: int) -> Column:
    return F.transform(F.slice(ws, 1, F.size(ws) - (k - 1)), lambda _, i: F.xxhash64(F.concat_ws(" ", F.slice(ws, i + 1, F.lit(k)))))


def shingles(text: Column, short: tuple[int, ...] = ()) -> Column:
    """Distinct hashes of all runs of five words; of all the words where there are fewer; none where there are none. And those of all runs of each length in ``short``, under five."""
    w = words(text)

    def of(ws: Column) -> Column:
        runs = F.transform(
            F.slice(ws, 1, F.size(ws) - (WORDS - 1)), lambda x, i: F.xxhash64(x, *[F.get(ws, i + k) for k in range(1, WORDS)])
        )
        found = F.when(F.size(ws) >= WORDS, runs).when(F.size(ws) > 0, F.array(F.xxhash64(F.concat_ws(" ", ws)))).otherwise(F.array().cast("array<bigint>"))
        fewer = [F.when(F.size(ws) >= k, _runs_of(ws, k)).otherwise(F.array().cast("array<bigint>")) for k in short]
        return F.concat(found, *fewer) if fewer else found

    # one lambda argument for the words, so that they are found once and not in each use
    return F.array_distinct(F.flatten(F.transform(F.array(w), of)))


def sketches(items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(h, item_id, n, size_class) from items (item_id, sh): the m smallest hashes of each item, m by its size class."""
    n = F.size("sh")
    sized = items.where(n > 0).select("item_id", "sh", n.alias("n"), F.floor(F.log2(n.cast("double")) + 1e-9).cast("int").alias("size_class"))
    largest = F.pow(F.lit(2.0), F.col("size_class") + 1) - 1
    m = (F.floor((1 - containment) * largest + 1e-9) + 1).cast("int")
    return sized.select("item_id", "n", "size_class", F.explode(F.slice(F.array_sort("sh"), F.lit(1), m)).alias("h"))


def find_contamination(docs: DataFrame, items: DataFrame, scratch: Scratch, containment: float = CONTAINMENT) -> DataFrame:
    """Pairs (doc_id, item_id, n_shingles, n_found, containment, mark): documents that hold at least the part ``containment`` of an item.

    Shingles are five lower-case words; repeated shingles count once. An item of fewer words is found wherever they follow one another in a text. Texts without words, null and
    empty ones match nothing, so without documents or items there are no pairs; a text of any length is searched whole. A pair stands once however often rows repeat; rows that share a doc_id but not the text are judged
    each by its own text, and ``mark`` (a hash of id and text) tells them apart. Null ids are ids like others. Other columns are ignored.
    """
    items = items.select("item_id", shingles(text_or_empty()).alias("sh"), F.size(words(text_or_empty())).alias("n_words")).where(F.size("sh") > 0).distinct()
    items = scratch.stage("items", items)
    short = tuple(sorted(r["n_words"] for r in items.where(F.col("n_words") < WORDS).select("n_words").distinct().collect()))  # four numbers at most
    items = items.select("item_id", "sh").distinct()
    texts = docs.select("doc_id", text_or_empty().alias("text")).withColumn("mark", F.xxhash64("doc_id", "text"))
    floor = F.ceil(F.lit(containment) * F.col("n") - 1e-9)
    search = maybe_broadcast(sketches(items, containment).select("h", "item_id", "n"), SKETCH_ROWS)
    found = texts.select("doc_id", "mark", shingles(F.col("text"), short).alias("sh")).select("doc_id", "mark", F.size("sh").alias("held"), F.explode("sh").alias("h"))
    found = found.join(search, "h").where(F.col("held") >= floor).select("mark", "item_id").distinct()
    candidates = scratch.stage("candidates", found)
    pairs = texts.join(maybe_broadcast(candidates, CANDIDATE_ROWS), "mark")
    whole = maybe_broadcast(items.withColumnRenamed("item_id", "item").withColumnRenamed("sh", "item_sh"), ITEM_ROWS)
    pairs = pairs.join(whole, F.col("item_id").eqNullSafe(F.col("item")))
    n_found = F.size(F.array_intersect("item_sh", shingles(F.col("text"), short)))
    judged = pairs.select("doc_id", "mark", "item_id", F.size("item_sh").alias("n_shingles"), n_found.alias("n_found"))
    judged = judged.where(F.col("n_found") >= F.ceil(F.lit(containment) * F.col("n_shingles") - 1e-9))
    return judged.distinct().withColumn("containment", F.round(F.col("n_found") / F.col("n_shingles"), 6))


def remove_contaminated(docs: DataFrame, items: DataFrame, scratch: Scratch, containment: float = CONTAINMENT) -> DataFrame:
    """The rows of docs, with their columns, whatever their names, whose text holds no item.

    Null and empty texts hold none and stay, as do rows with a null doc_id and a clean text; repeated rows stay or go together; an empty table gives none.
    """
    found = find_contamination(docs, items, scratch, containment)
    bad = scratch.stage("bad", found.select(F.col("mark").alias("b_mark"), F.col("doc_id").alias("b_id")).distinct())
    scratch.drop("items", "candidates")
    marked = packed(docs, F.col("doc_id").alias("id"), F.xxhash64("doc_id", text_or_empty()).alias("m"))
    return unpacked(marked.join(maybe_broadcast(bad), (F.col("m") == F.col("b_mark")) & F.col("id").eqNullSafe(F.col("b_id")), "left_anti"), docs)


ORACLE = r"""
WITH texts AS (
  SELECT DISTINCT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') AS w FROM documents
  UNION ALL SELECT DISTINCT 'i', item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') FROM benchmark),
shingles AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM texts
  UNION SELECT kind, id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) FROM texts,
    (SELECT DISTINCT len(w) AS k FROM texts WHERE kind = 'i' AND len(w) BETWEEN 1 AND 4) WHERE kind = 'd' AND len(w) >= k),
sizes AS (SELECT id, count(*) AS n FROM shingles WHERE kind = 'i' GROUP BY id),
found AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_found FROM shingles d JOIN shingles i ON d.s = i.s AND d.kind = 'd' AND i.kind = 'i' GROUP BY ALL)
SELECT doc_id, item_id, n::INTEGER AS n_shingles, n_found::INTEGER AS n_found, round(n_found / n, 6) AS containment
FROM found JOIN sizes ON id = item_id WHERE n_found >= ceil(0.8 * n - 1e-9)
"""
