"""Fill-in-middle: documents cut at two places between tokens and put together in another order, for infilling.

A token is a run of ASCII letters or any other single character. A text's bytes are bits of big integers: ``bytes.translate``
makes the masks of letters and of characters' first bytes, a shifted AND marks where tokens begin, ``bit_count`` counts them, and
the byte at which a token of a given rank begins is found by halving the mask again and again. No token is ever made.

The cuts and the form follow from a hash of the id alone, so a run gives the same rows on any number of executors.

Defined results: a null or empty text has no tokens and stays plain, as an empty text; so does a text that contains one of the
marks. A null id hashes as the empty string. Repeated rows give repeated rows. A text's masks take a quarter of its bytes, and
making them a few times its bytes; texts are otherwise handled in parts of a batch. An empty table gives no rows. Other columns
are carried if they are named, without those that have the name of an output.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, field, pieces, read, share_path, strings, tidied

SEED = 1
#: Of a hundred documents, how many are rearranged, and how many of these have the suffix first.
REARRANGED, SUFFIX_FIRST = 90, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
OUTPUTS = ("n", "form", "prefix_chars", "middle_chars", "output")

_LETTERS = bytes(ord("1") if chr(b).isascii() and chr(b).isalpha() else ord("0") for b in range(256))
_HEADS = bytes(ord("0") if 0x80 <= b < 0xC0 else ord("1") for b in range(256))


def masks(body: bytes) -> tuple[int, int]:
    """(bits of the bytes at which tokens begin, bits of the bytes at which characters begin); bit i is byte i."""
    if not body:
        return 0, 0
    last_first = body[::-1]
    letters, heads = int(last_first.translate(_LETTERS), 2), int(last_first.translate(_HEADS), 2)
    return heads & ~(letters & (letters << 1)), heads


def ranked(mask: int, rank: int) -> int:
    """Place of the set bit with ``rank`` set bits below it."""
    at, size = 0, mask.bit_length()
    while size > 1:
        half = size >> 1
        low = mask & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            mask, size = low, half
        else:
            mask, size, rank, at = mask >> half, size - half, rank - below, at + half
    return at


def rearranged(body: bytes, key: bytes, share: int = REARRANGED, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, bytes]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    starts, heads = masks(body)
    n = starts.bit_count()
    h1, h2, h3, h4 = struct.unpack(">4I", hashlib.sha256(key).digest()[:16])
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if not body or h3 % 100 >= share or any(x in body for x in (p, s, m)):
        return n, "plain", None, None, body
    a, b = (ranked(starts, k) if k < n else len(body) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    before, within = (heads & ((1 << a) - 1)).bit_count(), (heads & ((1 << b) - 1) & ~((1 << a) - 1)).bit_count()
    if h4 % 100 < suffix_first:
        return n, "spm", before, within, b"".join((s, body[b:], p, body[:a], m, body[a:b]))
    return n, "psm", before, within, b"".join((p, body[:a], s, body[b:], m, body[a:b]))


def _run(columns: list[str], share: int, suffix_first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column("__text"))
            keys = batch.column("__key")
            for lo, hi in pieces(offsets):
                body, at = data[offsets[lo] : offsets[hi]].tobytes(), (offsets[lo : hi + 1] - offsets[lo]).tolist()
                rows = [rearranged(body[x:y], k.encode(), share, suffix_first) for x, y, k in zip(at[:-1], at[1:], keys[lo:hi].to_pylist(), strict=True)]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
                made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                output = pa.array([r[4] for r in rows], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[lo:hi] for c in columns), *made, output], [*columns, *OUTPUTS])

    return run


def fill_in_middle(docs: DataFrame, carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, share: int = REARRANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``docs``' id and ``carry`` columns, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), and
    output, the text in its new order with its marks."""
    share_path(docs.sparkSession)
    carry = carried([id_col, *(carry or [])], *OUTPUTS)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    schema = ", ".join([*(field(docs, c) for c in carry), "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"])
    return docs.select(*carry, F.col(text_col).alias("__text"), key.alias("__key")).mapInArrow(tidied(_run(carry, share, suffix_first)), schema)


def restored() -> F.Column:
    """The text that ``output`` was made from, by ``form``. The first marks are those that were put there: the text has none."""
    def between(left: str | None, right: str | None) -> str:
        start = f"instr(output, '{left}') + {len(left)}"
        return f"substring(output, {start})" if right is None else f"substring(output, {start}, instr(output, '{right}') - ({start}))"

    psm = f"concat({between(PREFIX, SUFFIX)}, {between(MIDDLE, None)}, {between(SUFFIX, MIDDLE)})"
    spm = f"concat({between(PREFIX, MIDDLE)}, {between(MIDDLE, None)}, {between(SUFFIX, PREFIX)})"
    return F.expr(f"CASE form WHEN 'psm' THEN {psm} WHEN 'spm' THEN {spm} ELSE output END")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}

ORACLE = {
    "op11_fill_in_middle": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens,
    list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(sha256('1:' || coalesce(doc_id::VARCHAR, '')), k, 8))::BIGINT) AS h
  FROM documents
), c AS (
  SELECT *, len(tokens) AS n, least(h[1] % (len(tokens) + 1), h[2] % (len(tokens) + 1)) AS a, greatest(h[1] % (len(tokens) + 1), h[2] % (len(tokens) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
      WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM t
), p AS (
  SELECT doc_id, n, form, text, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle, array_to_string(tokens[b + 1:], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p"""
}
