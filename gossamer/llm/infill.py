"""Fill-in-the-middle texts: prefix, middle and suffix cut at word ends and put in another order.

One Arrow-batched pandas UDF walks each text once with the regex library and keeps only where units end,
in a compact array; two of these offsets cut the text. Where to cut and which form a document takes is
read off a digest of its id, so that every run, and every task that is run again, gives the same text.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.llm.groups import quoted
from gossamer.session import bounded_batches, table

SEED = "42"
#: Of 100 documents so many are transformed, and of 100 of those so many have the suffix first.
RATE, SPM_RATE = 50, 80
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")

#: A unit: a word with the white space before it, or the white space at the end.
UNIT = regex.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
MADE = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, output_sha256 string"


def draws(seed: str, doc_id: str) -> list[int]:
    """The first four groups of eight hexadecimal digits of the digest of ``seed:doc_id``."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def unit_ends(text: str) -> array:
    """Where each unit ends, in code points, after a 0."""
    ends = array("q", [0])
    ends.extend(m.end() for m in UNIT.finditer(text))
    return ends


def infill_one(doc_id: str, text: str, seed: str = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple:
    """(units, form, characters of prefix and of middle, output) of one text."""
    ends = unit_ends(text)
    n = len(ends) - 1
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or h3 % 100 >= rate or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = ends[a], ends[b]
    before, middle, after = text[:i], text[i:j], text[j:]
    if h4 % 100 < spm_rate:
        return n, "spm", i, j - i, "".join((SUFFIX, after, PREFIX, before, MIDDLE, middle))
    return n, "psm", i, j - i, "".join((PREFIX, before, SUFFIX, after, MIDDLE, middle))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def infill(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output, output_sha256) of every row.

    Form is plain (the text as it is), psm (prefix, suffix, middle) or spm (suffix, prefix, middle), with
    a mark before each part. Null texts are empty; an empty text and one that holds a mark are plain, so
    that ``restored`` is exact. A null id draws as the empty string; repeated ids draw alike. Texts of any
    length are taken whole; an empty table gives an empty one. No other column is looked at.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(MADE)
    def run(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [infill_one(i, t, seed, rate, spm_rate) for i, t in zip(ids, texts)]
        n, form, before, middle, output = zip(*rows) if rows else [[]] * 5
        return pd.DataFrame({
            "n": pd.Series(n, dtype="int64"), "form": pd.Series(form, dtype=object), "prefix_chars": pd.Series(before, dtype="Int64"), "middle_chars": pd.Series(middle, dtype="Int64"),
            "output": pd.Series(output, dtype=object), "output_sha256": pd.Series([sha256(o) for o in output], dtype=object),
        })

    empty = F.lit("")
    made = run(F.coalesce(quoted(id_col).cast("string"), empty), F.coalesce(quoted(text_col).cast("string"), empty))
    return docs.select(quoted(id_col).alias(id_col), made.alias("_made")).select(quoted(id_col), "_made.*")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of: marks occur in it once each."""
    inner = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    last = lambda a: F.substring_index(output, a, -1)
    psm = F.concat(inner(PREFIX, SUFFIX), last(MIDDLE), inner(SUFFIX, MIDDLE))
    spm = F.concat(inner(PREFIX, MIDDLE), last(MIDDLE), inner(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS d, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents
), h AS (
  SELECT doc_id, text, units, len(units) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM u
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT doc_id, n, form, text, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:n], '') AS s FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p"""
