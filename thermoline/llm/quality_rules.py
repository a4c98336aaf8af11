"""Quality rules by repetition coverage.

Rolling hashes of word n-grams, several lengths, are sorted inside each text; an n-gram
that was seen before marks its words, and the characters of marked words over all word
characters is the coverage of that length. Repeated lines are measured alike. Of 2 to 4
words, the n-gram with the most characters, times its number, is held against a limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermoline.llm import textkit as tk

# The published limits of repetition.
#: Largest share, in percent, of word characters inside repeated n-grams, by n; and in all places of one n-gram that comes twice or more.
NGRAM_PERCENT = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
TOP_PERCENT = {2: 20, 3: 18, 4: 16}
#: Largest share, in percent, of characters in repeated lines, and of repeated lines.
LINE_CHAR_PERCENT, LINE_PERCENT = 20, 30
MIN_WORDS, REPEAT_PERCENT = 50, 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "line_chars", "dup_line_chars", *(f"top{n}_chars" for n in TOP_PERCENT), *(f"dup{n}_chars" for n in NGRAM_PERCENT)]
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, line_chars long, dup_line_chars long, " + ", ".join(f"{x}_chars long" for x in (*(f"top{n}" for n in TOP_PERCENT), *(f"dup{n}" for n in NGRAM_PERCENT)))


def _later(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal keys: which places hold any, and which hold another than the first."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    any_, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:][same]] = True
    any_[order[:-1][same]] = True
    return any_ | later, later


def _covered(places: np.ndarray, n: int, words: int) -> np.ndarray:
    """The words inside n-word windows that begin at these places."""
    edge = np.zeros(words + 1, np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """Counts of each text, and whether the base and the method keep it."""
    data, off = tk.utf8(column)
    w = tk.Words(data, off)
    docs, total = w.docs, len(w.start)
    cp = tk.code_points(data)
    size = cp[w.end] - cp[w.start]
    sums = lambda doc, x=None: np.bincount(doc, x, minlength=docs).astype(np.int64)
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOL[data], out=symbols[1:])
    out = {"n_words": w.count.astype(np.int64), "word_chars": sums(w.doc, size), "n_symbols": symbols[off[1:]] - symbols[off[:-1]]}

    breaks = np.flatnonzero(data == 10)
    start, end = np.sort(np.concatenate([off[:-1], breaks + 1])), np.sort(np.concatenate([breaks, off[1:]]))
    full = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end = start[full], end[full]
    line_doc, line_size = np.searchsorted(off, start, "right") - 1, cp[end] - cp[start]
    _, again = _later(tk.per_doc(tk.digests(data, start, end), line_doc))
    out |= {"n_dup_lines": sums(line_doc[again]), "n_lines": sums(line_doc), "line_chars": sums(line_doc, line_size), "dup_line_chars": sums(line_doc[again], line_size[again])}

    h = w.hashes()
    key, inside = tk.window_hash(h, w.doc, 3)
    places = np.flatnonzero(inside)
    twice, _ = _later(tk.per_doc(key[places], w.doc[places]))
    found = np.zeros(total, bool)
    found[places[twice]] = True
    out["n_repeat_words"] = sums(w.doc[_covered(places[twice], 3, total)])
    ends = np.concatenate([[0], np.cumsum(size)])
    for n in TOP_PERCENT:
        key, inside = tk.window_hash(h, w.doc, n)
        at = np.flatnonzero(inside)
        _, first, count = np.unique(tk.per_doc(key[at], w.doc[at]), return_index=True, return_counts=True)
        first, count = at[first[count > 1]], count[count > 1]
        out[f"top{n}_chars"] = np.zeros(docs, np.int64)
        np.maximum.at(out[f"top{n}_chars"], w.doc[first], count * (ends[first + n] - ends[first]))
    for n in NGRAM_PERCENT:
        m = max(0, total - n + 1)
        at = np.flatnonzero(found[:m] & found[n - 3 : n - 3 + m] & (w.doc[:m] == w.doc[n - 1 : n - 1 + m]))  # a repeated n-gram begins and ends with repeated 3-grams
        key, _ = tk.window_hash(h, w.doc, n)
        _, again = _later(tk.per_doc(key[at], w.doc[at]))
        cover = _covered(at[again], n, total)
        out[f"dup{n}_chars"] = sums(w.doc[cover], size[cover])

    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * out["n_words"])
    bad = (100 * out["dup_line_chars"] > LINE_CHAR_PERCENT * out["line_chars"]) | (100 * out["n_dup_lines"] > LINE_PERCENT * out["n_lines"])
    for n, most in NGRAM_PERCENT.items():
        bad |= 100 * out[f"dup{n}_chars"] > most * out["word_chars"]
    for n, most in TOP_PERCENT.items():
        bad |= 100 * out[f"top{n}_chars"] > most * out["word_chars"]
    out["kept"] = ~out["base_failed"] & ~bad
    return out


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`, with its counts and verdict.

    A null or empty text has no words and fails the base; a null id stays null; repeated
    rows are judged each by itself; an empty table gives no rows; other columns are not looked
    at, whatever their names. Of n-grams with as many characters in all, any gives the share.
    Needs no shuffle: memory is that of a slice of texts, or of the longest text.
    """

    names = [x.split()[0] for x in SCHEMA.split(", ")[1:]]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                got = measure(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(got[x]) for x in names)], ["doc_id", *names])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(judged, SCHEMA)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, whose text is kept.

    Null and empty texts go, as they fail the base; repeated rows stay or go alike; an empty
    table stays empty; long texts as above.
    """

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, text_col):
                yield part.filter(pa.array(measure(part.column(text_col))["kept"]))

    return docs.mapInArrow(kept, docs.schema)
