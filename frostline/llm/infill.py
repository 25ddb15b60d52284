"""Fill-in-middle transformation by an injected delimiter: texts are cut into ranked units with string functions alone.

A delimiter that texts hold is escaped, regexp_replace appends the delimiter to each unit, their number is the growth of the text, and substring_index
takes the units before, between and after two ranks. The parts lose the delimiters again, are unescaped, and are put together in the form drawn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm.common import text_or_empty

#: The delimiter and the escape, the separators of units and records in ASCII; escaped they are the escape and a letter.
DELIMITER, ESCAPE = "\x1f", "\x1e"
#: Units, as patterns over escaped texts. No unit ends between an escape and its letter.
UNITS = {"character": rf"(?s){ESCAPE}.|.", "word": r"\S+\s*|\s+", "line": r"[^\n]*\n|[^\n]+"}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents so many are transformed, and of 100 of these so many have the suffix first.
RATE, SUFFIX_FIRST = 90, 20


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(DELIMITER), F.lit(ESCAPE + "d"))


def unescaped(part: Column) -> Column:
    """The text of a part: without delimiters, with what was escaped. An escape is always written "e", so the first replacement meets none of the text's own."""
    plain = F.replace(part, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(plain, F.lit(ESCAPE + "d"), F.lit(DELIMITER)), F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def draws(doc_id: Column) -> list[Column]:
    """Four numbers below 2^32 from the sha256 of "1:" and the id (a null id: of "1:" alone)."""
    digest = F.sha2(F.encode(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), "UTF-8"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, unit: str = "character", rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of docs (doc_id, text; other columns are ignored, whatever their names).

    n is the number of units of a text: characters (code points), words with the white space after them, or lines. Two draws of the id below n + 1 cut
    the text into prefix, middle and suffix, any of which may be empty. form is "psm", "spm" (suffix first), or "plain" where the text is empty, names a
    marker, or is not drawn; plain texts stay as they are, with null lengths of parts. The lengths are of characters, whatever the unit.

    Null texts are empty ones, null ids share their draws, repeated rows give equal rows, an empty table gives none. Everything happens within the row:
    no shuffle, no group. A text is handled whole; with a delimiter a unit it must fit into a column's 2 GB, so up to 500 million characters.
    """
    if unit not in UNITS:
        raise ValueError(f"units are {', '.join(UNITS)}")
    text, marked = F.col("text"), F.col("marked")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("marked", F.regexp_replace(escaped(text), UNITS[unit], f"$0{DELIMITER}"))
    rows = rows.withColumn("n", (F.length("marked") - F.length(F.replace(marked, F.lit(DELIMITER), F.lit("")))).cast("long"))
    h = F.col("h")
    rows = rows.withColumn("h", F.array(*draws(F.col("doc_id")))).withColumn("a", F.least(h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1))).withColumn("b", F.greatest(h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)))
    named = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    rows = rows.withColumn("form", F.when((text == "") | named | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm"))
    # of n units each followed by the delimiter: the first a, those after them up to b, and all after b with the empty part at the end
    count = lambda x: x.cast("int")
    part = lambda s, k: F.call_function("substring_index", s, F.lit(DELIMITER), count(k))
    cut = F.col("form") != "plain"
    head = part(marked, F.col("b"))
    rows = rows.withColumn("head", F.when(cut, head))
    rows = rows.select(
        "doc_id", "n", "form", "text",
        unescaped(part(F.col("head"), F.col("a"))).alias("prefix"),
        unescaped(part(F.col("head"), F.col("a") - F.col("b"))).alias("middle"),
        F.when(cut, unescaped(part(marked, F.col("b") - F.col("n") - 1))).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(text)
    return rows.select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), output.alias("output"))


def restored(form: Column, output: Column) -> Column:
    """The text of an output. No marker overlaps itself or another, so where none stood in the text the first of each kind is the one put in."""
    after = lambda s, m: F.call_function("substring_index", s, F.lit(m), F.lit(-1))
    before = lambda s, m: F.call_function("substring_index", s, F.lit(m), F.lit(1))
    middle, head = after(output, MIDDLE), before(output, MIDDLE)
    psm = F.concat(after(before(head, SUFFIX), PREFIX), middle, after(head, SUFFIX))
    spm = F.concat(after(head, PREFIX), middle, after(before(head, PREFIX), SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(made: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the sha256 of the output and of the text that is restored from it."""
    sha = lambda x: F.sha2(F.encode(x, "UTF-8"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("form"), F.col("output"))).alias("restored_sha256"))


ORACLE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT doc_id, t, n, ('0x' || substr(s, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(s, 9, 8))::BIGINT % (n + 1) AS y, ('0x' || substr(s, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(s, 25, 8))::BIGINT % 100 AS h4 FROM d),
f AS (SELECT doc_id, t, n, least(x, y) AS a, greatest(x, y) AS b, CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 >= {RATE} THEN 'plain' WHEN h4 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1, n - b) AS z FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || z || '{MIDDLE}' || m WHEN 'spm' THEN '{SUFFIX}' || z || '{PREFIX}' || p || '{MIDDLE}' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
