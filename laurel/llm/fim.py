"""Fill-in-middle transformation, cut by the offsets of a Split pre-tokenizer.

The pre-tokenizer isolates each match of a regular expression that matches one code point, so its offsets are those of the text's code
points; nothing is trained. The number of offsets is n, and the offsets of two ranks drawn from the document's key cut the text into
prefix, middle and suffix. Matches never span two code points, so a text may be handed over in pieces: parts of words of at most three code
points and what stands between words. A piece is handed over when it is met first, and its number of offsets kept; n is the sum of the numbers, and a
cut lies at an offset inside the piece that holds its rank. Memory is the text, the pieces of `CHUNK` code points, a number for each chunk
and `KEPT` numbers of pieces.

A form is `plain` (the text), `psm` (prefix, suffix, middle) or `spm` (suffix, prefix, middle); the parts follow their sentinels. Texts that
hold a sentinel stay plain, and no sentinel's end is another's beginning, so what is put together has each sentinel once and `restored` finds the
exact text again.

Defined results: null and empty texts are plain with n = 0 and an empty output; a null doc_id draws as the empty string; repeated rows have one
result each, equal for equal rows; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One code point, line breaks included.
UNIT = r"[\s\S]"
#: What is given to the pre-tokenizer at once; every code point is in one piece.
PIECE = re.compile(r"\w{1,3}|\W")
#: Code points whose pieces are held at once, and pieces whose numbers of offsets are kept.
CHUNK, KEPT = 1 << 11, 1 << 18
#: Bytes of output in one Arrow batch.
BATCH_BYTES = 4 << 20
SENTINELS = ("<P>", "<S>", "<M>")
_OUT = "doc_id {}, n long, form string, prefix_chars long, middle_chars long, output string"


class Units(dict):
    """piece -> its number of offsets, of the pieces kept."""

    def __init__(self, split):
        super().__init__()
        self.split = split

    def __missing__(self, piece: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        n = self[piece] = len(self.split(piece))
        return n


def splitter() -> Units:
    """What knows the offsets of the code points of a piece, and their number."""
    from tokenizers import Regex, pre_tokenizers

    return Units(pre_tokenizers.Split(Regex(UNIT), "isolated").pre_tokenize_str)


def units(known: Units, text: str) -> list[int]:
    """Running counts of the offsets of a text's chunks; the last is n."""
    ends, n = [], 0
    for a in range(0, len(text), CHUNK):
        n += sum(map(known.__getitem__, PIECE.findall(text, a, a + CHUNK)))
        ends.append(n)
    return ends


def offset(known: Units, text: str, ends: list[int], rank: int) -> int:
    """Where the unit of a rank begins; the text's end for rank n."""
    k = bisect_right(ends, rank)
    if k == len(ends):
        return len(text)
    at = k * CHUNK
    pieces = PIECE.findall(text, at, at + CHUNK)
    inside = list(accumulate(map(known.__getitem__, pieces), initial=ends[k - 1] if k else 0))
    j = bisect_right(inside, rank) - 1
    return at + sum(map(len, pieces[:j])) + known.split(pieces[j])[rank - inside[j]][1][0]


def drawn(key: Column, seed: int = 1) -> Column:
    """The eight 32-bit numbers of the digest of a seed and a key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(8)))


def transform(docs: DataFrame, seed: int = 1, percent: int = 90, spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of each row: percent of them cut, and spm_percent of those with the suffix first."""
    h, text, (p, s, m) = drawn(F.col("doc_id"), seed), F.coalesce("text", F.lit("")), sentinels
    held = F.lit(False)
    for x in sentinels:
        held |= F.contains("text", F.lit(x))
    plain = (text == "") | held | (h[2] % 100 >= percent)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    rows = docs.select("doc_id", text.alias("text"), form.alias("form"), h[0].alias("h1"), h[1].alias("h2"))

    def run(batches):
        known, schema = splitter(), None
        for batch in batches:
            schema = schema or pa.schema([("doc_id", batch.schema.field(0).type), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
            rows, size = [], 0
            for key, body, kind, h1, h2 in zip(*batch.columns, strict=True):
                t, kind = body.as_py(), kind.as_py()
                ends = units(known, t)
                n = ends[-1] if ends else 0
                row = {"doc_id": key.as_py(), "n": n, "form": kind, "output": t}
                if kind != "plain":
                    lo, hi = sorted((h1.as_py() % (n + 1), h2.as_py() % (n + 1)))
                    a, b = offset(known, t, ends, lo), offset(known, t, ends, hi)
                    head = f"{p}{t[:a]}{s}{t[b:]}" if kind == "psm" else f"{s}{t[b:]}{p}{t[:a]}"
                    row |= {"prefix_chars": lo, "middle_chars": hi - lo, "output": f"{head}{m}{t[a:b]}"}
                rows.append(row)
                size += len(t)
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return rows.mapInArrow(run, _OUT.format(docs.schema["doc_id"].dataType.simpleString()))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact text, from an output and its form alone."""
    p, s, m = sentinels
    before = lambda text, mark: F.substring_index(text, mark, 1)
    after = lambda text, mark: F.substring_index(text, mark, -1)
    head, middle = before(output, m), after(output, m)
    psm = F.concat(after(before(head, s), p), middle, after(head, s))
    spm = F.concat(after(head, p), middle, after(before(head, p), s))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13(spark, sf_dir: str) -> DataFrame:
    out = transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    whole = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(whole, 256).alias("restored_sha256"))


OP13_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents
), r AS (
  SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS c1, ('0x' || h[9:16])::BIGINT % (n + 1) AS c2,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), c AS (
  SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b FROM r
), p AS (
  SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1, n - b) AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
