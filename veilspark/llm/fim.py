"""Fill-in-middle: texts reordered so that a model learns to fill a gap, and the exact way back.

Method: run-length class encoding. A character's class is the number of bytes that UTF-8 gives it. The maximal runs of one class are
stored with the units (code points) and bytes that stand before them; a cut is a number of units, the run that holds it is found by binary
search over the running unit counts, and its byte follows by arithmetic: bytes before the run plus units into it times the class. So no
text is decoded, and a text of one script is one run however long it is.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import flat, mapped, slices

MARKS = ("<P>", "<S>", "<M>")
#: Bytes of a character by its first byte; 0 for the bytes that go on with one.
CLASS = np.zeros(256, np.int64)
CLASS[:0x80], CLASS[0xC0:0xE0], CLASS[0xE0:0xF0], CLASS[0xF0:] = 1, 2, 3, 4


class ClassRuns:
    """The class runs of a slice of texts, each with the units and bytes before it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        """offsets: where texts start and end in data, relative to it."""
        kinds = CLASS[data]
        # Bytes that go on with a character belong to the run of their first byte; a text's start opens a run.
        leads = np.flatnonzero(kinds)
        kinds = kinds[leads]
        opens = np.ones(len(leads), bool)
        opens[1:] = kinds[1:] != kinds[:-1]
        texts = np.searchsorted(leads, offsets)
        opens[texts[:-1][texts[:-1] < len(leads)]] = True
        at = np.flatnonzero(opens)
        self.units_before, self.bytes_before, self.kind = at, leads[at], kinds[at]
        self.text_units, self.offsets = texts, offsets
        self.units = np.diff(texts)

    def bytes_of(self, rows: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The byte, relative to the slice, at which each row's first `cuts` units end."""
        unit = self.text_units[rows] + cuts
        if not len(self.kind):
            return self.offsets[rows].copy()
        run = np.maximum(np.searchsorted(self.units_before, unit, side="right") - 1, 0)
        place = self.bytes_before[run] + (unit - self.units_before[run]) * self.kind[run]
        # A cut behind the last unit is the text's end: the run that holds that unit number is the next text's, or none.
        return np.where(cuts == self.units[rows], self.offsets[rows + 1], place)


def check_marks(marks: Sequence[str]) -> tuple[str, str, str]:
    """Marks that can be told from each other and from any text without them: none holds another, no end of one begins one."""
    p, s, m = marks
    for i, a in enumerate(marks):
        for j, b in enumerate(marks):
            if not a or (i != j and b in a) or any(b.startswith(a[k:]) for k in range(1, len(a))):
                raise ValueError(f"marks {marks} can run into each other")
    return p, s, m


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from the seed and the key, the same in every run and wherever the row is."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, keep: Sequence[str] = (), *, key: str = "doc_id", text: str = "text", seed: int = 1, percent: int = 90, spm_percent: int = 20, marks: Sequence[str] = MARKS) -> DataFrame:
    """One row per row of docs: the columns `keep`, then n, form, prefix_chars, middle_chars and output.

    n counts code points. Two of the row's draws cut the text into prefix, middle and suffix. form `psm` is mark, prefix, mark, suffix,
    mark, middle; `spm` (spm_percent of what is reordered) puts the suffix first; `plain` is the text itself: if it is empty or null,
    if it holds a mark, or for the share of rows that `percent` leaves. A null key draws as an empty one, so equal keys cut equal texts
    alike; repeated rows give repeated results; columns of other names are not looked at. Whole texts are worked on, however long.
    """
    p, s, m = check_marks(marks)
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    h = draws(F.col(f"`{key}`"), seed)
    plain = (t == "") | F.contains(t, F.lit(p)) | F.contains(t, F.lit(s)) | F.contains(t, F.lit(m)) | (h[2] % 100 >= percent)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    kept = {c: f"_k{i}" for i, c in enumerate(keep)}
    slim = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in kept.items()], t.alias("_t"), form.alias("form"), h[0].alias("_h1"), h[1].alias("_h2"))
    fields = {f.name: f for f in slim.schema.fields}
    schema = ", ".join([f"`{k}` {fields[k].dataType.simpleString()}" for k in kept.values()] + ["n long, form string, prefix_chars long, middle_chars long, output string"])
    open_, mid, end = p.encode(), s.encode(), m.encode()
    names = list(kept.values())

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column("_t"))
            forms = batch.column("form").to_pylist()
            first, second = (batch.column(c).to_numpy() for c in ("_h1", "_h2"))
            for i, j in slices(offsets):
                own = offsets[i : j + 1] - offsets[i]
                raw = data[offsets[i] : offsets[j]]
                runs = ClassRuns(raw, own)
                rows = np.arange(j - i)
                a, b = first[i:j] % (runs.units + 1), second[i:j] % (runs.units + 1)
                low, high = np.minimum(a, b), np.maximum(a, b)
                x, y = runs.bytes_of(rows, low), runs.bytes_of(rows, high)
                whole, out = raw.tobytes(), []
                for r, kind in enumerate(forms[i:j]):
                    u, v, c, d = own[r], x[r], y[r], own[r + 1]
                    if kind == "plain":
                        out.append(whole[u:d])
                    elif kind == "psm":
                        out.append(b"".join((open_, whole[u:v], mid, whole[c:d], end, whole[v:c])))
                    else:
                        out.append(b"".join((mid, whole[c:d], open_, whole[u:v], end, whole[v:c])))
                moved = np.array([k == "plain" for k in forms[i:j]])
                cols = [batch.column(c).slice(i, j - i) for c in names]
                cols += [pa.array(runs.units), pa.array(forms[i:j], pa.string()), pa.array(low, mask=moved), pa.array(high - low, mask=moved), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "n", "form", "prefix_chars", "middle_chars", "output"])

    out = mapped(slim, run, schema)
    return out.select(*[F.col(k).alias(c) for c, k in kept.items()], "n", "form", "prefix_chars", "middle_chars", "output")


def restore(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text that an output and its form stand for. The marks of a reordered text part it, as the text itself holds none."""
    p, s, m = check_marks(marks)

    def between(left: str, right: str | None) -> Column:
        rest = F.substr(output, F.instr(output, left) + len(left))
        return F.substring_index(rest, right, 1) if right else rest

    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
