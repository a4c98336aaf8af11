"""Personal data by weak supervision.

Patterns propose spans. Five labelers vote on each proposal - yes, no or nothing: the
pattern's own strict form, a checksum or range test, a gazetteer, the words before it, and
how it is bounded. Expectation-maximisation over the counts of vote patterns, of the whole
corpus, estimates how often each labeler is right for each kind, without a labelled row. Its
probabilities are the soft labels of the final classifier, a logistic regression over what no
labeler looks at, the words on both sides and the form of the span; a candidate's odds are
those of the classifier times those that its votes add to the kind's. Base spans are always
reported, others where these odds are sure.

Votes take at most 5 x 3**5 values, so their table is bounded; the classifier is fit on at
most `sample` different candidates. Nothing else reaches the driver.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermoline.llm import textkit as tk
from thermoline.llm.workspace import stored

KINDS = ("email", "ip", "card", "phone", "name")
BASE_KINDS = 4
LABELERS = 5
ROUNDS, SURE = 60, 0.9
#: Most different candidates that the classifier is fit on: those with the least hash.
SAMPLE = 20_000
#: Weights of hashed words and forms.
HASHED = 1 << 14

# The base patterns of the contract. A match of the digit patterns can only begin where no digit precedes.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Wider proposals.
_SPELLED_HOST = re.compile(r"[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]++)+")
_HOME_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])")
# Gazetteers and trigger words in English, German, French and Spanish. Longer lists of names are a parameter.
GIVEN = """James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica
Thomas Sarah Charles Karen Christopher Lisa Daniel Nancy Matthew Betty Anthony Sandra Mark Margaret Donald Ashley Steven Kimberly
Andrew Emily Paul Donna Joshua Michelle Kenneth Carol Kevin Amanda Brian Melissa George Deborah Timothy Stephanie Ronald Rebecca
Edward Laura Jason Helen Jeffrey Sharon Ryan Cynthia Jacob Kathleen Nicholas Amy Gary Angela Eric Shirley Jonathan Anna Stephen
Ruth Larry Brenda Justin Pamela Scott Nicole Brandon Katherine Benjamin Samantha Samuel Christine Peter Maria Hans Klaus Jürgen
Wolfgang Dieter Manfred Uwe Günter Horst Stefan Andreas Sabine Petra Monika Ursula Renate Heike Birgit Anja Katrin Lukas Leon
Pierre Jean Jacques Michel Philippe Alain Nicolas Olivier Marie Claire Nathalie Isabelle Sylvie Camille Luc Antoine José Carmen
Pablo Lucía Javier Elena Antonio Manuel Francisco Juan Carlos Miguel Rafael Pedro Alejandro Isabel Dolores Pilar Teresa Rosa Marta
Cristina Sofía Raúl Diego""".split()
_TITLE = re.compile(r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\b")
_TLDS = frozenset("com org net edu gov mil int info biz io app dev name pro museum coop aero online site shop store tech cloud".split())
_ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35")
_TRIGGERS = {
    "email": ("mail", "contact", "write to", "reach", "address", "kontakt", "schreib", "correo", "escrib", "courriel", "écri"),
    "ip": ("ip", "host", "server", "address", "client", "login from", "gateway", "dns", "ping", "adresse", "servidor", "serveur"),
    "card": ("card", "visa", "master", "amex", "credit", "debit", "payment", "karte", "kredit", "carte", "tarjeta", "pago"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "dial", "sms", "whatsapp", "appel", "anruf", "handy", "llam", "móvil"),
    "name": ("name", "contact", "dear", "signed", "author", "regards", "sincerely", "customer", "patient", "liebe", "grüße", "cher", "cordialement", "estimad", "saludos"),
}
_AGAINST = {
    "email": ("example of", "format of", "such as"),
    "ip": ("version", "release", "build", "v.", "section", "chapter", "kapitel", "capítulo"),
    "card": ("isbn", "order", "invoice", "serial", "id:", "number of", "tracking", "rechnung", "facture", "factura"),
    "phone": ("isbn", "part no", "serial", "lat", "order", "tracking", "version"),
    "name": ("street", "university", "theorem", "effect", "award", "straße", "rue", "calle", "saint", "hospital"),
}
_TOKEN = re.compile(r"[^\W\d_]+|\d+")
_FORM = str.maketrans({**{chr(c): "9" for c in range(48, 58)}, **{chr(c): "A" for c in range(65, 91)}, **{chr(c): "a" for c in range(97, 123)}})
_RUN = re.compile(r"(.)\1+", re.S)


@lru_cache(maxsize=8)
def _names(given: tuple[str, ...]) -> re.Pattern:
    last = "[A-ZÀ-Þ][a-zà-ÿ]+"
    return re.compile(rf"\b(?:{_TITLE.pattern}\.? {last}|(?:{'|'.join(map(re.escape, given))}) {last})(?: {last})?")


@lru_cache(maxsize=8)
def _known(given: tuple[str, ...]) -> frozenset[str]:
    return frozenset(given)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if k % 2:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @: the local part can only be the run before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _EMAIL.match(text, start)):
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Kind, start and end of the base spans, by kind, then start."""
    out = [(0, s, e) for s, e in _emails(text)]
    if re.search("[0-9]", text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split("."))]
        out += [(2, *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def _spelled(text: str) -> Iterator[tuple[int, int]]:
    """Around each spelled at: the local part can only be the run before it."""
    done = 0
    for m in _SPELLED_HOST.finditer(text):
        end = start = m.start() - (m.start() > 0 and text[m.start() - 1] == " ")
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < end:
            yield start, m.end()
            done = m.end()


def proposals(text: str, given: tuple[str, ...] = tuple(GIVEN)) -> list[tuple[int, int, int]]:
    """Spans that only the wider patterns propose, the stronger pattern first."""
    out = []
    if "at)" in text or "at]" in text:
        out += [(0, s, e) for s, e in _spelled(text)]
    if re.search("[0-9]", text):
        out += [(3, *m.span()) for m in _HOME_PHONE.finditer(text)]
        out += [(2, *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and len(_digits(m[0])) in (13, 14, 15)]
    out += [(4, *m.span()) for m in _names(given).finditer(text)]
    return out


def _apart(taken: list[tuple[int, int]], s: int, e: int) -> bool:
    """Whether a span meets none of the sorted spans, of which none meet."""
    k = bisect_left(taken, (e, -1))
    return k == 0 or taken[k - 1][1] <= s


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _votes(text: str, kind: int, start: int, end: int, base: bool, given: tuple[str, ...]) -> list[int]:
    """What the labelers say: -1, 0 or 1."""
    name, s = KINDS[kind], text[start:end]
    digits, low = _digits(s), s.lower()
    before = text[max(0, start - 48) : start].lower()
    votes = [1 if base else 0]
    if kind == 0:
        tld = re.split(r"[.\s)\]]+", low)[-1]
        votes += [1 if 2 <= len(tld) <= 24 and tld.isalpha() else -1, 1 if tld in _TLDS or (len(tld) == 2 and tld.isalpha()) else 0]
    elif kind == 1:
        first = int(s.split(".")[0])
        votes += [1 if base else -1, 1 if first in range(1, 224) else -1]
    elif kind == 2:
        votes += [1 if luhn(digits) else -1, 1 if _ISSUERS.match(digits) else -1]
    elif kind == 3:
        votes += [1 if 10 <= len(digits) <= 13 else -1, 1 if "(" in s or s[0] == "+" else 0]
    else:
        votes += [1 if " " in s and not s.isupper() else 0, 1 if any(x in _known(given) for x in s.split()) else 0]
    votes.append(-1 if any(x in before for x in _AGAINST[name]) else 1 if any(x in before for x in _TRIGGERS[name]) or (kind == 4 and _TITLE.match(s)) else 0)
    glued = (start > 0 and (text[start - 1].isalnum() or text[start - 1] == "_")) or (end < len(text) and (text[end].isalnum() or text[end] == "_"))
    votes.append(-1 if glued else 1)
    return votes


def _cells(text: str, kind: int, start: int, end: int) -> list[int]:
    """Places of the classifier's weights: the kind, then hashed words on both sides and form of the span."""
    words = [f"-{k}{x}" for k, x in enumerate(_TOKEN.findall(text[max(0, start - 48) : start].lower())[:-4:-1])]
    words += [f"+{k}{x}" for k, x in enumerate(_TOKEN.findall(text[end : end + 32].lower())[:2])]
    form = text[start : min(end, start + 64)].translate(_FORM)
    words += [f"={form[:24]}", f"~{_RUN.sub(lambda m: m[1], form)[:16]}", f"#{min(16, (end - start) // 4)}"]
    return [kind] + [len(KINDS) + zlib.crc32(f"{kind}{x}".encode()) % HASHED for x in words]


WEIGHTS = len(KINDS) + HASHED
Found = tuple[int, int, int, bool, int, list[int]]


def candidates(text: str | None, given: tuple[str, ...] = tuple(GIVEN)) -> list[Found]:
    """Kind, start, end, whether it is a base span, code of kind and votes, and weights.

    A proposal that meets a base span, or one of a stronger pattern, is dropped.
    """
    text = text or ""
    base = base_spans(text)
    out = [(k, s, e, True) for k, s, e in base]
    taken = _merged([(s, e) for _, s, e in base])
    for k, group in groupby(proposals(text, given), lambda x: x[0]):
        new = [(s, e) for _, s, e in group if _apart(taken, s, e)]
        out += [(k, s, e, False) for s, e in new]
        taken = _merged(taken + new)
    found = []
    for k, s, e, strict in out:
        votes, code = _votes(text, k, s, e, strict, given), k
        for v in votes:
            code = code * 3 + v + 1
        found.append((k, s, e, strict, code, _cells(text, k, s, e)))
    return found


def _unpack(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rest, votes = codes, np.empty((len(codes), LABELERS), int)
    for k in range(LABELERS - 1, -1, -1):
        votes[:, k] = rest % 3
        rest = rest // 3
    return rest, votes


def reliabilities(votes: np.ndarray, count: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation for one kind: probability that each vote pattern is personal data, and P(vote | class)."""
    p = np.clip(0.5 + 0.2 * (votes - 1).sum(axis=1), 0.05, 0.95)
    table = np.empty((2, votes.shape[1], 3))
    for _ in range(rounds):
        weight = np.stack([(1 - p) * count, p * count])
        for k in range(votes.shape[1]):
            for v in range(3):
                table[:, k, v] = 1.0 + weight[:, votes[:, k] == v].sum(axis=1)
        # A labeler is taken to be better than chance: votes are counted as if some known cases were among them.
        table[1, :, 2] += 4.0
        table[0, :, 0] += 4.0
        table /= table.sum(axis=2, keepdims=True)
        prior = (weight.sum(axis=1) + 2.0) / (count.sum() + 4.0)
        said = np.log(prior)[:, None] + sum(np.log(table[:, k, votes[:, k]]) for k in range(votes.shape[1]))
        p = 1 / (1 + np.exp(np.clip(said[0] - said[1], -50, 50)))
    return p, table


def posteriors(codes: np.ndarray, count: np.ndarray) -> dict[int, float]:
    """Probability of each code of kind and votes, the kinds each by itself."""
    kind, votes = _unpack(codes)
    p = np.zeros(len(codes))
    for k in np.unique(kind):
        p[kind == k], _ = reliabilities(votes[kind == k], count[kind == k].astype(float))
    return dict(zip(codes.tolist(), p.tolist(), strict=True))


def train(kind: np.ndarray, cells: list[list[int]], count: np.ndarray, label: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Weights of a logistic regression on soft labels; each kind weighs alike, frequent candidates by the root of their number."""
    row, at = np.repeat(np.arange(len(cells)), [len(c) for c in cells]), np.concatenate([np.array(c, np.int64) for c in cells])
    weight = np.sqrt(count)
    weight /= np.bincount(kind, weight, minlength=len(KINDS))[kind]
    w, seen = np.zeros(WEIGHTS), np.full(WEIGHTS, 1e-8)
    for _ in range(rounds):
        got = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[at], minlength=len(cells)), -30, 30)))
        slope = np.bincount(at, (weight * (got - label))[row], minlength=len(w)) + 1e-5 * w
        seen += slope * slope
        w -= 0.3 * slope / np.sqrt(seen)
    return w


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 0.0025, 0.9975)
    return np.log(p / (1 - p))


class Judge:
    """The classifier's weights and what each code of votes adds to the odds of its kind."""

    def __init__(self, codes: np.ndarray, count: np.ndarray, some: list[tuple[int, list[int], float]]):
        """From the counts of all codes, and (code, cells, number) of the candidates that the classifier is fit on."""
        known = posteriors(codes, count)
        kind, p = _unpack(codes)[0], np.array([known[c] for c in codes.tolist()])
        prior = np.bincount(kind, count * p, minlength=len(KINDS)) / np.maximum(1, np.bincount(kind, count, minlength=len(KINDS)))
        self.added = np.zeros(len(KINDS) * 3**LABELERS)
        self.added[codes] = _logit(p) - _logit(prior[kind])
        rows = np.array([c for c, _, _ in some])
        self.weights = train(_unpack(rows)[0], [x for _, x, _ in some], np.array([n for _, _, n in some], float), np.array([known[c] for c in rows.tolist()]))

    def scores(self, codes: np.ndarray, cells: pa.ListArray) -> np.ndarray:
        """The probability of each candidate."""
        size = cells.value_lengths().to_numpy(zero_copy_only=False)
        said = np.bincount(np.repeat(np.arange(len(size)), size), self.weights[cells.flatten().to_numpy()], minlength=len(size))
        return 1 / (1 + np.exp(-np.clip(said + self.added[codes], -30, 30)))


def judge_of(found: DataFrame, sample: int = SAMPLE) -> Judge | None:
    """From all rows of candidates: the votes of all are counted, `sample` different candidates are fit. None without any."""
    each = found.select(F.explode(F.arrays_zip("code", "cells")).alias("x")).select("x.*")
    votes = each.groupBy("code").agg(F.count("*").alias("n")).orderBy("code").collect()  # at most as many as there are codes
    if not votes:
        return None
    some = each.groupBy("code", "cells").agg(F.count("*").alias("n")).orderBy(F.xxhash64("code", "cells"), "code", "cells").limit(sample).collect()
    return Judge(np.array([r["code"] for r in votes]), np.array([r["n"] for r in votes]), [tuple(r) for r in some])


_FOUND = "doc_id long, kind array<int>, start array<int>, stop array<int>, base array<boolean>, code array<int>, cells array<array<int>>"
_FIELDS = ("kind", "start", "stop", "base", "code", "cells")
_TYPES = {"base": pa.list_(pa.bool_()), "cells": pa.list_(pa.list_(pa.int32()))}


def _found(docs: DataFrame, id_col: str, text_col: str, given: tuple[str, ...]) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                got = [list(zip(*candidates(x, given), strict=True)) or [()] * len(_FIELDS) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([list(x[k]) for x in got], _TYPES.get(f, pa.list_(pa.int32()))) for k, f in enumerate(_FIELDS))], ["doc_id", *_FIELDS])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, _FOUND)


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sure: float = SURE, sample: int = SAMPLE, given: tuple[str, ...] = tuple(GIVEN)) -> DataFrame:
    """One row for each row of `docs`: counts by base kind, digest of the base spans, all spans.

    A null text is empty; an id may be null or repeated, repeated rows are reported each; an
    empty table gives no rows; other columns, whatever their names, aren't looked at. Spans of
    a kind never meet; of proposals of several kinds that meet the stronger pattern's stays.
    Work grows with the length of a text in proportion, and one text is held at a time. Texts
    are read once; the candidates, without text, are stored, counted and then judged.
    """
    found = stored(_found(docs, id_col, text_col, given), "found")
    known = found.sparkSession.sparkContext.broadcast(judge_of(found, sample))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("cells")
            good = pa.array(known.value.scores(batch.column("code").flatten().to_numpy(), cells.flatten()) >= sure if len(cells.flatten()) else [], pa.bool_())
            size = np.concatenate([[0], np.cumsum(cells.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "kind", "start", "stop", "base")), pa.ListArray.from_arrays(size, good)], ["doc_id", "kind", "start", "stop", "base", "good"])

    rows = found.mapInArrow(judged, "doc_id long, kind array<int>, start array<int>, stop array<int>, base array<boolean>, good array<boolean>")
    order = F.array(*(F.lit(k) for k in KINDS))
    spans = F.arrays_zip("kind", "start", "stop", "base", "good")
    rows = rows.select("doc_id", F.array_sort(F.filter(spans, lambda x: x["base"])).alias("based"), F.array_sort(F.filter(spans, lambda x: x["base"] | x["good"])).alias("kept"))
    said = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", F.get(order, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))))
    count = lambda k: F.size(F.filter("based", lambda x: x["kind"] == k)).cast("long")
    return rows.select("doc_id", *(count(k).alias(f"n_{KINDS[k]}") for k in range(BASE_KINDS)), F.sha2(said("based").cast("binary"), 256).alias("base_sha256"), said("kept").alias("spans"))


def mask(text: str, found: list[Found], good: np.ndarray) -> str:
    """The text with each reported span replaced by its kind in brackets; spans that meet are one."""
    out, done = [], 0
    for s, e, k in sorted((s, e, k) for (k, s, e, base, *_), sure in zip(found, good, strict=True) if base or sure):
        if s >= done:
            out += [text[done:s], f"[{KINDS[k].upper()}]"]
            done = e
        elif e > done:
            done = e
    return "".join(out) + text[done:]


def masked(docs: DataFrame, text_col: str = "text", sure: float = SURE, sample: int = SAMPLE, given: tuple[str, ...] = tuple(GIVEN)) -> DataFrame:
    """The rows of `docs`, with all their columns, personal data masked; `n_chars`, where there is one, follows the new text.

    Null and empty texts stay as they are; repeated rows are masked alike; an empty table stays
    empty. Texts are searched twice, once for the model and once to mask, rather than stored.
    """
    found = stored(_found(docs.select(F.lit(None).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", given).where(F.size("kind") > 0), "found")
    known = docs.sparkSession.sparkContext.broadcast(judge_of(found, sample))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, text_col):
                texts = part.column(text_col)
                found = [(x, candidates(x, given)) for x in texts.to_pylist()]
                good = [known.value.scores(np.array([f[4] for f in got]), pa.array([f[5] for f in got], pa.list_(pa.int32()))) >= sure if got else () for _, got in found]
                new = pa.array([None if x is None else mask(x, got, g) if got else x for (x, got), g in zip(found, good, strict=True)], texts.type)
                yield part.set_column(part.schema.get_field_index(text_col), part.schema.field(text_col), new)

    out = docs.mapInArrow(put, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out
