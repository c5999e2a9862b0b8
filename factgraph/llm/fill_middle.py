"""Fill-in-middle: texts cut into prefix, middle and suffix, and put together in another order.

A text becomes a numpy array of its code points (UTF-32). Each has a class; where
neighbours differ in class a unit ends, and flatnonzero over the comparison gives all
boundaries at once. Two ranks, drawn from a hash of the document's id, choose among them,
and the three slices between are encoded again. What a document gets depends on its id and
its text alone, so tasks can be repeated and tables split in any way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm.common import table

#: Strings before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
UNITS = ("codepoints", "words", "lines")


def classes(codes: np.ndarray, unit: str) -> np.ndarray:
    """A class for each code point; a unit is a longest run of one class.

    codepoints: each is a unit. words: white space (space, \\t to \\r) and the rest.
    lines: a line with its \\n, by the parity of the line's number.
    """
    if unit == "codepoints":
        out = np.zeros(len(codes), np.uint8)
        out[1::2] = 1
        return out
    if unit == "words":
        return ((codes == 32) | ((codes >= 9) & (codes <= 13))).view(np.uint8)
    if unit == "lines":
        ends = (codes == 10).view(np.uint8)
        return np.bitwise_xor.accumulate(ends) ^ ends  # a \n belongs to the line that it ends
    raise ValueError(f"unit must be one of {UNITS}")


def boundaries(codes: np.ndarray, unit: str) -> np.ndarray:
    """Where units begin, and the end: n + 1 places for n units; 0 alone for an empty text."""
    if not len(codes):
        return np.zeros(1, np.int64)
    kinds = classes(codes, unit)
    return np.concatenate([[0], np.flatnonzero(kinds[1:] != kinds[:-1]) + 1, [len(codes)]])


def cut(text: str, draw: str, unit: str, plain_from: int, spm_below: int, markers: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output) of one text.

    draw: at least 32 hexadecimal digits; the first four groups of eight choose the first
    rank, the second one, whether the text stays plain, and the order of the pieces.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    at = boundaries(codes, unit)
    n = len(at) - 1
    h1, h2, h3, h4 = (int(draw[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or h3 % 100 >= plain_from or any(m in text for m in markers):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = int(at[low]), int(at[high])
    prefix, middle, suffix = (x.tobytes().decode("utf-32-le", "surrogatepass") for x in (codes[:a], codes[a:b], codes[b:]))
    p, s, m = markers
    if h4 % 100 < spm_below:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_middle(
    docs: DataFrame, unit: str = "codepoints", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20,
    markers: tuple[str, str, str] = MARKERS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of docs: id, n, form, prefix_chars, middle_chars, output.

    unit: what is never cut through, `codepoints`, `words` or `lines`; n: units of the
    text. form: `psm`, `spm`, or `plain`, for `plain_percent` of the texts and for those
    that are empty or hold a marker; then output is the text, and the two lengths (code
    points) are null. spm_percent is of those that are left. The draw is a sha256 of seed and id: rows that
    repeat an id are cut by the same draw, each row by its own text; a null id is written
    as nothing. A null text counts as empty. Texts are cut whole, however long: one takes some 20 bytes a code
    point for a while. Extra columns are ignored, an empty table gives no rows. Markers must
    begin with a character that none of them has elsewhere, so that texts can be restored.
    """
    heads = {m[:1] for m in markers}
    if len(set(markers)) != 3 or "" in heads or any(h in m[1:] for m in markers for h in heads):
        raise ValueError("markers must be different, and begin with a character that none of them has elsewhere")
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["n", "form", "prefix_chars", "middle_chars", "output"], [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for low in range(0, batch.num_rows, 256):  # bounded memory, however large the batch
                some = batch.slice(low, 256)
                rows = [cut(t, d, unit, 100 - plain_percent, spm_percent, markers) for t, d in zip(some.column(1).to_pylist(), some.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([some.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], names=["id", *names])

    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), draw.alias("draw"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text again, from output and form alone."""
    p, s, m = markers

    def pieces(first: str, second: str) -> tuple[Column, Column, Column]:
        # pieces hold no marker, so the first one of a kind is the one that was put there
        here, there = F.substring_index(output, second, 1), F.substring_index(output, m, 1)
        rest = lambda of, begin: F.substring(of, begin + 1, F.length(of))
        return rest(here, F.lit(len(first))), rest(there, F.length(here) + len(second)), rest(output, F.length(there) + len(m))

    prefix, suffix, middle = pieces(p, s)
    last, first, inner = pieces(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(first, inner, last)).otherwise(output)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    out = fill_middle(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), r AS (
  SELECT doc_id, t, n, CAST('0x' || h[1:8] AS UBIGINT) % (n + 1) AS x, CAST('0x' || h[9:16] AS UBIGINT) % (n + 1) AS y,
    CAST('0x' || h[17:24] AS UBIGINT) % 100 AS z, CAST('0x' || h[25:32] AS UBIGINT) % 100 AS o
  FROM d
), f AS (
  SELECT doc_id, t, n, least(x, y)::BIGINT AS a, greatest(x, y)::BIGINT AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR z >= 90 THEN 'plain' WHEN o < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM r
), p AS (
  SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1, n) AS suf FROM f
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
