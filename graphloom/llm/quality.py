"""Quality rules by repetition coverage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import BASE, BYTE, U, WORD_BASE, covered, mix, pieces, prefix, repeated, rows_of, span, totals, words

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
#: Largest share of word characters that may lie inside n-grams found twice or more, by n.
NGRAM_SHARE = {5: 0.25, 7: 0.22, 10: 0.20}
#: Largest share of characters that may lie in lines equal to an earlier line.
LINE_SHARE = 0.30
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = ", ".join(f"{c} long" for c in COUNTS) + ", dup_line_chars long, line_chars long, " + ", ".join(f"dup_chars_{n} long" for n in NGRAM_SHARE) + ", base_failed boolean, kept boolean"


def measure(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """All counts of a run of texts, by row."""
    n = len(offs) - 1
    start, end, row = words(data, offs)
    sums = prefix(BYTE[data], BASE)
    per = lambda of, weight=None: np.bincount(of, weight, minlength=n).astype(np.int64)
    lead = (data & 0xC0) != 0x80
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=chars[1:])
    size = chars[end] - chars[start]
    out = {"n_words": per(row), "word_chars": per(row, size), "n_symbols": totals(SYMBOL[data], offs)}

    full = offs[:-1] < offs[1:]
    opens = np.union1d(offs[:-1][full], (nl := np.flatnonzero(data == 10)) + 1)
    opens = opens[opens < len(data)]
    closes = np.minimum(np.append(nl, len(data))[np.searchsorted(nl, opens)], offs[1:][line_row := rows_of(opens, offs)])
    some = np.searchsorted(start, closes) > np.searchsorted(start, opens)
    opens, closes, line_row = opens[some], closes[some], line_row[some]
    _, later = repeated(span(sums, opens, closes, BASE) ^ mix(line_row.astype(U)))
    width = chars[closes] - chars[opens]
    out |= {"n_dup_lines": per(line_row[later]), "dup_line_chars": per(line_row[later], width[later]), "line_chars": per(line_row, width)}

    ordered = prefix(span(sums, start, end, BASE), WORD_BASE)
    salt = mix(row.astype(U) + U(1))
    for k in NGRAM_SHARE:
        at = np.arange(max(0, len(start) - k + 1))
        at = at[row[at] == row[at + k - 1]]
        many, _ = repeated(span(ordered, at, at + k, WORD_BASE) ^ salt[at])
        inside = covered(len(start), at[many], k)
        out[f"dup_chars_{k}"] = per(row[inside], size[inside])
        if k == 5:
            out["n_repeat_words"] = per(row[inside])
    out["base_failed"] = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
    kept = ~out["base_failed"] & (out["dup_line_chars"] <= LINE_SHARE * out["line_chars"])
    for k, share in NGRAM_SHARE.items():
        kept &= out[f"dup_chars_{k}"] <= share * out["word_chars"]
    return out | {"kept": kept}


def _measured(batches, columns):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        for a, b, data, offs in pieces(batch.column("text")):
            got = measure(data, offs)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in columns), *(pa.array(got[c]) for c in names)], [*columns, *names])


def quality(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Repetition counts and verdict of every text, one narrow pass without a shuffle.

    Null text counts as empty: all counts 0, base_failed. A null doc_id is carried as it is; repeated rows
    are measured each for itself; other columns don't matter unless named in carry. An empty table gives
    no rows. A text is measured whole however long it is.
    """
    own = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(*dict.fromkeys((*carry, "text"))).mapInArrow(lambda it: _measured(it, carry), f"{own}, {SCHEMA}")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with their own columns, whatever their names."""
    names = tuple(f"c{i}" for i in range(len(docs.columns)))
    plain = docs.toDF(*names)
    own = plain.select(*names, plain[names[docs.columns.index("text")]].alias("text"))
    return quality(own, names).where("kept").select(*names).toDF(*docs.columns)
