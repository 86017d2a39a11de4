"""Fill-in-the-middle forms of texts.

A text's units are its runs of letters A-Z, a-z and every other single code point.  A document's
hash draws two ranks among its units; prefix, middle and suffix are what lies before, between
and after them.  Texts become arrays of code points; where neighbouring ones aren't both letters,
a unit begins, so that ranks are places in one array and pieces are slices.

Forms: psm is <P>prefix<S>suffix<M>middle, spm is <S>suffix<P>prefix<M>middle, plain is the text.
Plain are empty and null texts, texts that hold a mark, and the share PLAIN of the rest.

A null text counts as empty.  The draw depends on the id alone: repeated rows give equal results,
and a null id draws as an empty one.  Long texts are handled one at a time, whole.  An empty table gives no rows.
All other columns stay, but n, form, prefix_chars, middle_chars and output replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.llm.frames import documents, hidden, restored, text_or_empty
from listwright.llm.words import as_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, PLAIN, SPM = 1, 10, 20
_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
#: Rows whose outputs a task's Python side holds at once.
_ROWS = 256
_OWN = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}


def bounds(points: np.ndarray) -> np.ndarray:
    """Where each unit begins, and the length of the text."""
    letter = ((points | np.uint32(32)) - np.uint32(97)) < 26
    inner = np.flatnonzero(~(letter[1:] & letter[:-1])) + 1
    return np.concatenate([[0], inner, [len(points)]]) if len(points) else np.zeros(1, np.int64)


def transform(text: bytes, h: list[int], plain_percent: int = PLAIN, spm_percent: int = SPM) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of a text, with the four numbers of its document's hash."""
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    at = bounds(points)
    n = len(at) - 1
    if not n or h[2] % 100 >= 100 - plain_percent or any(m in text for m in _MARKS):
        return n, "plain", None, None, text
    a, b = (int(at[r]) for r in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = (p.tobytes().decode("utf-32-le").encode() for p in (points[:a], points[a:b], points[b:]))
    p, s, m = _MARKS
    if h[3] % 100 < spm_percent:
        return n, "spm", a, b - a, s + suffix + p + prefix + m + middle
    return n, "psm", a, b - a, p + prefix + s + suffix + m + middle


def draws(id_: Column, seed: int = SEED) -> Column:
    """Four numbers below 2**32 from the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, plain_percent: int = PLAIN, spm_percent: int = SPM) -> DataFrame:
    """docs with n (units), form, prefix_chars and middle_chars (code points; null if plain) and output."""
    rows, names = hidden(docs)
    own = {n: c for c, n in names.items()}
    rows = rows.withColumn("draws", draws(F.col(own[id_col]), seed))
    text = own[text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, _ROWS):
                part = batch.slice(a, _ROWS)
                out = [transform(t, h, plain_percent, spm_percent) for t, h in zip(as_bytes(part[text]), part["draws"].to_pylist())]
                n, form, prefix, middle, output = zip(*out)
                own_ = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *own_], names=[*part.schema.names, *_OWN])

    schema = ", ".join([*(f"{c} {t}" for c, t in rows.dtypes), *(f"{c} {t}" for c, t in _OWN.items())])
    return restored(rows.mapInArrow(run, schema), names, **{c: c for c in _OWN})


def original(output: Column, form: Column) -> Column:
    """The text that fill_in_middle made output from."""
    first, second = F.when(form == "psm", SUFFIX).otherwise(PREFIX), F.lit(MIDDLE)
    i, j, w = F.instr(output, first), F.instr(output, second), len(PREFIX)
    one, two, middle = F.substr(output, F.lit(w + 1), i - w - 1), F.substr(output, i + w, j - i - w), F.substr(output, j + w)
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def op13_infill(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", text_or_empty().alias("text"))
    out = fill_in_middle(docs).drop("text")
    digests = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(original(F.col("output"), F.col("form")), 256)}
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *(c.alias(n) for n, c in digests.items()))


OP13_SQL = """
with d as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || coalesce(doc_id::varchar, '')) as x from documents
), h as (
  select *, len(u) as n, list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(x, k, 8))::bigint) as h from d
), r as (
  select *, least(h[1] % (n + 1), h[2] % (n + 1)) as a, greatest(h[1] % (n + 1), h[2] % (n + 1)) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 90 then 'plain' when h[4] % 100 < 20 then 'spm' else 'psm' end as form from h
), p as (
  select *, array_to_string(u[1 : a], '') as prefix, array_to_string(u[a + 1 : b], '') as middle, array_to_string(u[b + 1 :], '') as suffix from r
)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(t) as restored_sha256 from p
"""
