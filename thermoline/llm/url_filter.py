"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into one multiword Shift-And state: each rule owns a start bit
and a bit for every literal byte, and a wildcard is a self-loop on the bit before it. One
step for a byte c is `state = (state << 1 & step[c]) | (state & loop[c])`, for every rule
and, in numpy, for every URL of the batch at once.

A glob is matched against the whole canonical URL, host and path: `*` is any run of bytes
without a slash, `**` any run of bytes. Host labels are thus never matched inside a path.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermoline.llm import textkit as tk


@dataclass(frozen=True)
class HostRule:
    """Fits a host and its subdomains where the path begins with `/` + path."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}/{self.path}"

    @property
    def globs(self) -> tuple[str, ...]:
        return (f"{self.name}**", f"*.{self.name}**")


#: The rules of the contract.
RULES = (HostRule("block", "com", "en/"), HostRule("allow", "example.com", "en/7"), HostRule("allow", "net", "de/"), HostRule("block", "example.net", "de/8"), HostRule("block", "org", "es/"))
#: Globs that block where no rule fits: advertising, tracking and link-farm hosts.
BLOCK_GLOBS = ("ads-*", "ads-*/**", "*.ads-*", "*.ads-*/**", "*-track.*", "*-track.*/**", "spam-*", "spam-*/**", "*.spam-*", "*.spam-*/**")


#: Bytes of state that URLs advance in together, so that a long list of globs takes fewer URLs at a time.
STATE_BYTES = 16 << 20


class GlobAutomaton:
    def __init__(self, globs: list[str]):
        self.last: list[int] = []
        loops: list[tuple[int, bool]] = []
        steps: list[tuple[int, int]] = []
        bit, self.first = 0, []
        for glob in globs:
            self.first.append(bit)
            raw, at = glob.encode(), 0
            while at < len(raw):
                if raw[at] == 0x2A:
                    deep = raw[at : at + 2] == b"**"
                    loops.append((bit, deep))
                    at += 1 + deep
                else:
                    bit += 1
                    steps.append((bit, raw[at]))
                    at += 1
            self.last.append(bit)
            bit += 1
        self.words = max(1, -(-bit // 64))
        self.step, self.loop, self.begin = (np.zeros(shape, np.uint64) for shape in ((256, self.words), (256, self.words), (self.words,)))
        for at, byte in steps:
            self.step[byte, at // 64] |= np.uint64(1 << at % 64)
        for at, deep in loops:
            self.loop[:, at // 64] |= np.uint64(1 << at % 64)
            if not deep and not any(b == at and d for b, d in loops):
                self.loop[0x2F, at // 64] &= ~np.uint64(1 << at % 64)
        for at in self.first:
            self.begin[at // 64] |= np.uint64(1 << at % 64)

    def match(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """matched[text, glob]: all texts advance together; those that have ended drop out."""
        size = np.diff(off)
        order = np.argsort(-size, kind="stable")
        state = np.tile(self.begin, (len(size), 1))
        longest_first, start = size[order], off[:-1][order]
        for k in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-longest_first, -k, "left"))  # those longer than k
            c = data[start[:live] + k]
            now = state[:live]
            moved = now << np.uint64(1)
            if self.words > 1:
                moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.step[c]) | (now & self.loop[c])
        out = np.empty((len(size), len(self.last)), bool)
        for g, at in enumerate(self.last):
            out[order, g] = (state[:, at // 64] >> np.uint64(at % 64)) & np.uint64(1)
        return out


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end; A to Z in lower case."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_verdicts(pages: DataFrame, rules: tuple[HostRule, ...] = RULES, block_globs: tuple[str, ...] = BLOCK_GLOBS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of `pages`: host, path, the longest rule that fits and the verdict.

    A null URL and one without `://` have an empty host and path, which no rule fits: allowed.
    Equal rules: the first wins. Null and repeated ids stay, a row each; an empty table gives no
    rows. Only the id and URL columns are read, whatever others are called, and nothing is
    shuffled. A long URL takes a step for each of its bytes and no more memory than a short one.
    """

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = GlobAutomaton([g for r in rules for g in r.globs] + list(block_globs))
        ranked = sorted(range(len(rules)), key=lambda k: len(rules[k].name), reverse=True)
        some = max(16, STATE_BYTES // (8 * automaton.words))
        for batch in batches:
            for part in (batch.slice(at, some) for at in range(0, batch.num_rows, some)):
                got = automaton.match(*tk.utf8(part.column("canonical")))
                rule = np.full(len(got), -1)
                for k in reversed(ranked):
                    rule[got[:, 2 * k] | got[:, 2 * k + 1]] = k
                other = got[:, 2 * len(rules) :].any(axis=1)
                verdict = [rules[k].action if k >= 0 else "block" if bad else "allow" for k, bad in zip(rule, other, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("host"), part.column("path"), pa.array([rules[k].name if k >= 0 else None for k in rule], pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    return rows.withColumn("canonical", F.concat("host", "path")).mapInArrow(judged, "page_id long, host string, path string, rule string, verdict string")
