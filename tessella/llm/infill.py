"""Fill-in-the-middle rewriting of whole texts, by run-length class encoding.

Encoding: a text's characters are of two classes, white space or not. Its maximal
runs of one class are stored with the byte at which they start and the cumulative
count of units that end in or before them. A token is a run outside white space with
the white space before it; white space at the end of the text is one of its own. So
a run outside white space ends one unit, a run of white space none, unless it is the
text's last. Counting characters instead, each run ends as many units as it has.

A cut after u units is found by binary search of u among the cumulative counts; the
place inside the run found is arithmetic: its start and the units that are left
times the bytes of a unit in it. No token is looked at and none is copied.

Defined cases: a null text is empty; an empty text has no unit and stays plain; a
text that holds one of the marks stays plain; cuts may leave any of the three parts
empty; a text without white space, or of white space alone, is one token; a null id
is hashed as an empty one; rows that repeat come out alike; an empty table gives an
empty table; other columns are carried through, and the operator's own columns take
underscores where their names are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessella.llm import bytesops as B
from tessella.llm.shared import unique_names

MARKS = ("<P>", "<S>", "<M>")


@dataclass
class Runs:
    """Maximal class runs of texts that lie in one buffer."""

    start: np.ndarray  # first byte of each run, and the end of the last
    units: np.ndarray  # units that end before each run, counted over all texts
    base: np.ndarray  # units before each text
    count: np.ndarray  # units of each text
    offsets: np.ndarray

    def cut(self, units: np.ndarray) -> np.ndarray:
        """The byte after ``units`` (0 to count) of each text."""
        want = self.base + units
        run = np.searchsorted(self.units[1:], want, "left")
        run = np.minimum(run, max(len(self.start) - 2, 0))
        if len(self.start) < 2:
            return self.offsets[:-1].copy()
        ends = self.units[run + 1] - self.units[run]  # a unit of a run is as long as the run's share
        width = (self.start[run + 1] - self.start[run]) // np.maximum(ends, 1)
        return np.where(units == 0, self.offsets[:-1], self.start[run] + (want - self.units[run]) * width)


def runs(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = B.SPACE) -> Runs:
    """Class runs of the texts ``data[offsets[i] : offsets[i + 1]]``, with token units."""
    n = len(data)
    white = space[data]
    edge = np.zeros(n + 1, bool)
    edge[1:n] = white[1:] != white[:-1]
    edge[offsets] = True
    edge[n] = False
    start = np.flatnonzero(edge)
    ends = (~white[start]).astype(np.int64) if n else np.zeros(0, np.int64)
    last = np.searchsorted(start, offsets[1:][np.diff(offsets) > 0], "left") - 1  # last run of each text that has one
    ends[last] = 1
    units = np.append(0, np.cumsum(ends))
    at = np.searchsorted(start, offsets, "left")
    return Runs(np.append(start, n), units, units[at][:-1], np.diff(units[at]), offsets)


def _rewrite(names: list[str], n_input: int):
    """Adds n, prefix_chars, middle_chars and output to batches whose last columns are text, form and the hash groups of the cuts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(n_input)
            forms = batch.column(n_input + 1)
            for a, b, data, o in B.chunks(text):
                form = forms.slice(a, b - a).to_pylist()
                h1, h2 = (batch.column(n_input + i).slice(a, b - a).to_numpy() for i in (2, 3))
                r = runs(data, o)
                one, two = h1 % (r.count + 1), h2 % (r.count + 1)
                p, q = r.cut(np.minimum(one, two)), r.cut(np.maximum(one, two))
                chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))
                pre, mid = (chars[p] - chars[o[:-1]]).tolist(), (chars[q] - chars[p]).tolist()
                raw, out = data.tobytes(), []
                for f, x, y, z, e in zip(form, o[:-1].tolist(), p.tolist(), q.tolist(), o[1:].tolist()):
                    if f == "plain":
                        out.append(raw[x:e])
                    elif f == "psm":
                        out.append(b"<P>" + raw[x:y] + b"<S>" + raw[z:e] + b"<M>" + raw[y:z])
                    else:
                        out.append(b"<S>" + raw[z:e] + b"<P>" + raw[x:y] + b"<M>" + raw[y:z])
                rewritten = np.array([f != "plain" for f in form], bool)
                none = lambda v: pa.array(v, pa.int64(), mask=~rewritten)
                own = [pa.array(r.count, pa.int64()), none(np.array(pre, np.int64)), none(np.array(mid, np.int64)), pa.array(out, pa.binary()).cast(pa.string())]
                kept = [batch.column(i).slice(a, b - a) for i in range(n_input)]
                yield pa.RecordBatch.from_arrays([*kept, forms.slice(a, b - a), *own], names)

    return run


def rewrite(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with form (plain, psm or spm), n (tokens), prefix_chars, middle_chars and output.

    ``rate`` and ``spm`` are percentages: of texts rewritten, and of those in spm form.
    Cuts and forms follow from sha256 of seed and id alone.
    """
    names = unique_names(docs.columns, ["form", "n", "prefix_chars", "middle_chars", "output"])
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    group = lambda i: F.conv(F.substr(hashed, F.lit(8 * i + 1), F.lit(8)), 16, 10).cast("long")
    plain = (text == "") | (group(2) % 100 >= rate)
    for mark in MARKS:
        plain = plain | F.contains(text, F.lit(mark))
    form = F.when(plain, "plain").when(group(3) % 100 < spm, "spm").otherwise("psm")
    helpers = zip((text, form, group(0), group(1)), unique_names(docs.columns, ["text_", "form_", "h1", "h2"]))
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *[x.alias(c) for x, c in helpers])
    kinds = ["string", "long", "long", "long", "string"]
    schema = StructType(list(docs.schema.fields))
    for name, kind in zip(names, kinds):
        schema.add(name, kind)
    return rows.mapInArrow(_rewrite([*docs.columns, *names], len(docs.columns)), schema)


def restored(output: Column, form: Column) -> Column:
    """The text from its output and form; a mark's string is in the output once, as texts that hold one stay plain."""
    part = F.split(output, "<P>|<S>|<M>", -1)
    return (
        F.when(form == "psm", F.concat(part[1], part[3], part[2]))
        .when(form == "spm", F.concat(part[2], part[3], part[1]))
        .otherwise(output)
    )


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = rewrite(docs)
    sha = lambda c: F.sha2(c, 256)
    digests = {"output_sha256": sha(F.col("output")), "restored_sha256": sha(restored(F.col("output"), F.col("form")))}
    return out.withColumns(digests).select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)
