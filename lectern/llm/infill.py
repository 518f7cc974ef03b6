"""Fill-in-middle transformation: documents cut at two random places and put together in another order.

The tokenizers library's Split pre-tokenizer, with every match of a pattern a unit of its own
(isolated, nothing trained), gives code-point offsets of the units of a text. Their number is n;
the offsets at two ranks drawn from a hash of the document's id cut prefix, middle and suffix.

Defined cases: a null text is empty; an empty text has no units and stays plain, as does a text
that holds one of the marks; a null id is hashed as an empty string; repeated rows are cut alike;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.llm.tokens import slices

#: A unit: a word with the white space before it, or white space at the end of the text.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
SEED = 42
#: Percent of documents that are transformed, and of these percent with the suffix first.
TRANSFORMED, SUFFIX_FIRST = 50, 80


def unit_starts(pattern: str = UNIT) -> Callable[[str], list[int]]:
    """A function from a text to the code points at which its units start."""
    from tokenizers import Regex, pre_tokenizers

    cut = pre_tokenizers.Split(Regex(pattern), behavior="isolated").pre_tokenize_str
    return lambda text: [place[0] for _, place in cut(text)] if text else []


def draws(id_: object, seed: int) -> list[int]:
    """Four unsigned 32-bit numbers of a document's id."""
    told = hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).hexdigest()
    return [int(told[k : k + 8], 16) for k in range(0, 32, 8)]


def transform(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, transformed: int = TRANSFORMED,
              suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Per document: doc_id, n (units), form (plain, psm or spm), prefix, middle, suffix (null if plain) and output."""
    schema = T.StructType().add("doc_id", documents.schema[id_col].dataType).add("n", "long").add("form", "string")
    for name in ("prefix", "middle", "suffix", "output"):
        schema = schema.add(name, "string")
    arrow = to_arrow_schema(schema)
    before, behind, between = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = unit_starts()

        def one(id_: object, text: str) -> tuple:
            at = starts(text)
            n = len(at)
            h1, h2, h3, h4 = draws(id_, seed)
            if not text or h3 % 100 >= transformed or any(m in text for m in marks):
                return n, "plain", None, None, None, text
            first, second = ([*at, len(text)][k] for k in sorted((h1 % (n + 1), h2 % (n + 1))))
            prefix, middle, suffix = text[:first], text[first:second], text[second:]
            if h4 % 100 < suffix_first:
                return n, "spm", prefix, middle, suffix, f"{behind}{suffix}{before}{prefix}{between}{middle}"
            return n, "psm", prefix, middle, suffix, f"{before}{prefix}{behind}{suffix}{between}{middle}"

        for batch in batches:
            for at, to in slices(batch.column(1)):
                ids, texts = batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at).to_pylist()
                made = [one(i, t or "") for i, t in zip(ids.to_pylist(), texts, strict=True)]
                cols = [pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), list(arrow)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *cols], schema=arrow)

    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text from which an output of the given form was made.

    No text with a mark is transformed, and no end of a mark begins one, so the marks are the only places to cut.
    """
    parts = F.split(output, "|".join(re.escape(m) for m in marks), -1)
    return (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
            .when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output))


def digest(made: DataFrame) -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    return made.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
             CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
             CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS z,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:z], '') AS middle, array_to_string(w[z + 1:n], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
