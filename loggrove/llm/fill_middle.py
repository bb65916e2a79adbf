"""Fill-in-the-middle transformation of texts, as one pyarrow.compute pipeline.

A unit is a word with the white space before it, or white space at the end of a
text. Two cuts, drawn from a hash of the document's id, part the units into
prefix, middle and suffix. Within a batch the units of all texts are one list
array: it is flattened, every unit gets the ordinal that it has in its text and
by it a role, the units of each role are filtered and put back into lists, one a
text, and these are joined to pieces. ``restore`` is the way back.

Nulls: a null text is empty; a null id is hashed as an empty one. Empty texts and
texts that hold one of the marks stay plain. Cuts may fall together, so pieces
may be empty. Rows that repeat an id have the same draws; repeated rows each get
a row. Of very long texts all units are cut; texts go through in parts of a
batch. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loggrove.llm.common import slices, whole_text

#: The marks of prefix, suffix and middle; a text that holds one stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FILLED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def units(texts: pa.Array) -> pa.LargeListArray:
    """The units of each text (none is null). A unit ends where a byte other than
    white space has white space behind it, and at the end of the text; white
    space is ASCII, so the bytes of UTF-8 show it."""
    texts = texts.cast(pa.large_string())
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    low, high = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, high - low, low) if high > low else np.zeros(0, np.uint8)
    white = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
    last = ~white
    last[:-1] &= white[1:]
    if len(raw):
        last[-1] = False
    ends = offsets[1:][offsets[1:] > offsets[:-1]] - low  # of texts that are not empty
    last[ends - 1] = True
    cuts = np.concatenate([[0], np.flatnonzero(last) + 1]).astype(np.int64)
    values = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(raw)])
    return pa.LargeListArray.from_arrays(pa.array(np.searchsorted(cuts, offsets - low), pa.int64()), values)


def pieces(texts: pa.Array, first: pa.Array, second: pa.Array) -> list[pa.Array]:
    """Prefix, middle and suffix of each text; ``first`` and ``second`` say how
    many units lie before its cuts."""
    lists = units(texts)
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    begin = pc.take(lists.offsets.slice(0, len(lists)), parent)
    ordinal = pc.subtract(pa.array(np.arange(len(flat)), pa.int64()), begin)
    in_prefix = pc.less(ordinal, pc.take(first, parent))
    in_suffix = pc.greater_equal(ordinal, pc.take(second, parent))
    out = []
    for role in (in_prefix, pc.invert(pc.or_(in_prefix, in_suffix)), in_suffix):
        own = pc.filter(parent, role).to_numpy()
        offsets = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(lists)))]).astype(np.int64)
        rebuilt = pa.LargeListArray.from_arrays(pa.array(offsets), pc.filter(flat, role))
        out.append(pc.binary_join(rebuilt, pa.scalar("", pa.large_string())))
    return out


def transform(batch: pa.RecordBatch, fim_percent: int, spm_percent: int) -> pa.RecordBatch:
    """FILLED of a batch of doc_id, text and the four draws h1 to h4."""
    text = batch.column("text").cast(pa.large_string())
    h = [batch.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4)]
    n = pc.list_value_length(units(text)).to_numpy()
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    marked = pc.or_(pc.or_(pc.match_substring(text, PREFIX), pc.match_substring(text, SUFFIX)), pc.match_substring(text, MIDDLE))
    plain = pc.or_(pc.or_(pc.equal(text, ""), marked), pa.array(h[2] % 100 >= fim_percent))
    spm = pa.array(h[3] % 100 < spm_percent)
    prefix, middle, suffix = pieces(text, pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)))
    p, s, m, none = (pa.scalar(x, pa.large_string()) for x in (PREFIX, SUFFIX, MIDDLE, ""))
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none)
    flipped = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none)
    no_count = pa.scalar(None, pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            pa.array(n, pa.int64()),
            pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm")),
            pc.if_else(plain, no_count, pc.utf8_length(prefix).cast(pa.int64())),
            pc.if_else(plain, no_count, pc.utf8_length(middle).cast(pa.int64())),
            pc.if_else(plain, text, pc.if_else(spm, flipped, psm)).cast(pa.string()),
        ],
        names=[f.split()[0] for f in FILLED.split(", ")],
    )


def fill_in_middle(docs: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """FILLED: number of units, form (plain, psm or spm), code points of prefix
    and middle (null if plain) and the output of every row. Nothing is shuffled."""
    own = F.col(id_column).cast("long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(own.cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield transform(part, fim_percent, spm_percent)

    return docs.select(own.alias("doc_id"), whole_text(text_column).alias("text"), *draws).mapInArrow(run, FILLED)


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of. A text that was cut holds no mark, and
    no mark can begin in a piece and end in the mark behind it, so splitting at
    the marks gives the pieces."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    at = lambda *order: F.concat(*[F.get(parts, F.lit(k)) for k in order])
    return F.when(form == "plain", output).when(form == "psm", at(1, 3, 2)).otherwise(at(2, 3, 1))
