"""Fill-in-middle: a text is cut in three and put together again in another order.

A pandas UDF takes Arrow batches. For each text a pattern of the regex library finds the units from left to right; the places
where they end stand in one compact array. Two numbers of units, drawn from a digest of the seed and the row's id, are looked up
in it and give the places of both cuts; what stands behind the last unit goes with the suffix. ``restore`` rebuilds the text from
output and form alone.

Null is the empty text, which stays plain, as does a text that holds a marker. A row without an id takes the seed alone. Repeated
rows give equal results. Texts of any length are handled whole: beside the text a row needs four bytes a unit. An empty table gives
an empty one. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archsieve.llm.common import tidy

#: Units: a code point each, or a word with the white space behind it.
CODE_POINT, WORD = r"(?s:.)", r"\s*\S+\s*"
#: Rows of a batch that are worked on at once.
ROWS = 512
CUT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


@dataclass(frozen=True)
class Markers:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        """No marker may begin inside another or inside itself: then the first place of each in an output is its own."""
        every = astuple(self)
        if not all(every) or len(set(every)) < 3 or any(b[k:] and a.startswith(b[k:]) for a in every for b in every for k in range(a == b, len(b))) or any(a in b for a in every for b in every if a != b):
            raise ValueError(f"markers that cannot be told apart: {every}")


def parts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[tuple[pd.Series, pd.Series]]:
    """The batches in pieces, so that no task holds the results of a whole batch."""
    for a, b in batches:
        for start in range(0, len(a), ROWS):
            yield a.iloc[start : start + ROWS], b.iloc[start : start + ROWS]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def draws(seed: str, row: str) -> list[int]:
    """The first four 32-bit numbers of a row's digest."""
    hexadecimal = digest(f"{seed}:{row}")
    return [int(hexadecimal[8 * i : 8 * i + 8], 16) for i in range(4)]


def transform(docs: DataFrame, seed: str = "1", unit: str = CODE_POINT, plain_percent: int = 10, spm_percent: int = 20, markers: Markers = Markers(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, output_sha256); n: units, form: plain, psm or spm."""

    @F.pandas_udf(CUT)
    @tidy
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        units = regex.compile(unit).finditer

        def one(row: str, body: str) -> tuple:
            ends = array("I", (m.end() for m in units(body)))
            n = len(ends)
            first, second, plain, form = draws(seed, row)
            if not body or any(m in body for m in astuple(markers)) or plain % 100 >= 100 - plain_percent:
                return n, "plain", None, None, body, digest(body)
            few, many = sorted((first % (n + 1), second % (n + 1)))
            start, stop = (ends[k - 1] if k else 0 for k in (few, many))
            prefix, middle, suffix = body[:start], body[start:stop], body[stop:]
            if form % 100 < spm_percent:
                name, out = "spm", f"{markers.suffix}{suffix}{markers.prefix}{prefix}{markers.middle}{middle}"
            else:
                name, out = "psm", f"{markers.prefix}{prefix}{markers.suffix}{suffix}{markers.middle}{middle}"
            return n, name, start, stop - start, out, digest(out)

        for ids, bodies in parts(batches):
            found = pd.DataFrame([one(i, b) for i, b in zip(ids, bodies)], columns=["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"])
            yield found.astype({"n": "Int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    row, body = (F.coalesce(docs[c].cast("string"), F.lit("")) for c in (doc_id, text))
    return docs.select(docs[doc_id].alias("doc_id"), cut(row, body).alias("cut")).select("doc_id", "cut.*")


def restored(form: str, output: str, markers: Markers) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return output
    first, second = (markers.prefix, markers.suffix) if form == "psm" else (markers.suffix, markers.prefix)
    one, _, rest = output.removeprefix(first).partition(second)
    two, _, middle = rest.partition(markers.middle)
    return one + middle + two if form == "psm" else two + middle + one


def restore(cuts: DataFrame, markers: Markers = Markers()) -> DataFrame:
    """The rows of ``transform`` with ``restored`` and ``restored_sha256``, from form and output alone."""

    @F.pandas_udf("restored string, restored_sha256 string")
    @tidy
    def rebuild(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for forms, outputs in parts(batches):
            bodies = [restored(f, o, markers) for f, o in zip(forms, outputs)]
            yield pd.DataFrame({"restored": bodies, "restored_sha256": list(map(digest, bodies))}, dtype=object)

    return cuts.withColumn("back", rebuild("form", "output")).select(*cuts.columns, "back.*")
