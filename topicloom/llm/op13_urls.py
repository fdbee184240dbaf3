r"""URL filters by a bit-parallel wildcard automaton.

A url's host stands between its first `://` and the next `/`, `?`, `#` or the end, A-Z lower-cased; its path follows, up to `?`, `#` or the end. The canonical
url is a dot, the host and the path, so that `.example.com/` marks a host and its subdomains alike.

Globs are made of literal bytes, `*` (any bytes but `/`) and `**` (any bytes). Each has a bit for every count of its bytes that may have been met, and all globs together are packed into
64-bit words (Shift-And): at a byte c the words become ((D << 1) & MOVE[c]) | (D & STAY[c]), with the carry of each word going to the next. MOVE has the bits whose byte is c, STAY those before a wildcard that takes c. A glob fits
if the bit of all its bytes is set at the end. The urls of a batch run together, longest first, so that each step works on those that still have bytes.

Rules (host, path) become globs `*.host` + path + `**`. Of the rules that fit, the longest decides; if none does, the longest of the other globs; if none does, the verdict is `default`. Ties go to the earlier.

Defined results: null urls and those without `://` have an empty host and path, which no rule fits; very long urls cost a step a byte; repeated rows get a row each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm.common import ascii_lower, bounded_batches, table

# Rules by host and path, longest first where they overlap.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: What the filter blocks and allows where no rule fits: pages without an address, farms of spam, files that aren't pages, feeds and logins.
GLOBS = (
    ("block", "."), ("block", "*.spam-*.**"), ("block", "**.exe"), ("block", "**.zip"), ("block", "**/login/**"), ("block", "*.m.*.org/**"), ("allow", "*.m.*.org/en/**"), ("block", "*.org/*/*.html"),
)
DEFAULT = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    found = lambda group: F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)([^?#]*)", group), F.lit(""))
    return ascii_lower(found(1)), found(2)


class Automaton:
    """Globs as the masks of one automaton: MOVE and STAY by byte, the bits at the start, and of each glob the word and bit of its end."""

    def __init__(self, globs: Sequence[str]) -> None:
        self.ends: list[int] = []
        moves, stays, starts, at = [], [], [], 0
        for glob in globs:
            starts.append(at)
            raw, i = glob.encode(), 0
            while i < len(raw):
                if raw[i : i + 1] == b"*":
                    double = raw[i : i + 2] == b"**"
                    stays.append((at, double))
                    i += 1 + double
                else:
                    at += 1
                    moves.append((at, raw[i]))
                    i += 1
            self.ends.append(at)
            at += 1
        words = max(1, -(-at // 64))
        self.move, self.stay = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
        self.start = np.zeros(words, np.uint64)
        one = lambda bit: np.uint64(1 << bit % 64)
        for bit, byte in moves:
            self.move[byte, bit // 64] |= one(bit)
        for bit, double in stays:
            self.stay[:, bit // 64] |= one(bit)
            if not double and (bit, True) not in stays:
                self.stay[ord("/"), bit // 64] &= ~one(bit)
        for bit in starts:
            self.start[bit // 64] |= one(bit)

    def fits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """[texts, globs]: which globs fit which of the texts in data[offsets[i]:offsets[i + 1]]."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        begin, left = offsets[:-1][order], np.sort(lengths)
        states = np.repeat(self.start[None, :], len(order), axis=0)
        carried = np.uint64(63)
        for step in range(int(left[-1]) if len(left) else 0):
            n = len(order) - int(np.searchsorted(left, step, "right"))  # those longer than step
            byte, now = data[begin[:n] + step], states[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> carried
            states[:n] = (moved & self.move[byte]) | (now & self.stay[byte])
        out = np.zeros((len(order), len(self.ends)), bool)
        for k, bit in enumerate(self.ends):
            out[order, k] = states[:, bit // 64] >> np.uint64(bit % 64) & np.uint64(1)
        return out


def first_fit(fits: np.ndarray, order: Sequence[int]) -> np.ndarray:
    """The first column of `order` that holds in each row, or -1."""
    out = np.full(len(fits), -1)
    for k in reversed(order):
        out[fits[:, k]] = k
    return out


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, globs: Sequence[tuple[str, str]] = GLOBS, default: str = DEFAULT) -> DataFrame:
    """(key, host, path, rule, own_rule, verdict): the rule that decides, like `net/fr/`, or else the glob (`own_rule`); null where there is none."""
    names = [h + p for _, h, p in rules] + [g for _, g in globs]
    verdicts = np.array([v for v, *_ in (*rules, *globs)] + [default], object)
    patterns = [f"*.{h}{p}**" for _, h, p in rules] + [g for _, g in globs]
    longest = lambda ks: sorted(ks, key=lambda k: -len(names[k]))
    base, own = longest(range(len(rules))), longest(range(len(rules), len(names)))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, said = Automaton(patterns), np.array([*names, None], object)
        for b in it:
            if not b.num_rows:
                continue
            texts = pa.array([f".{h}{p}" for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)], pa.large_string())
            _, offsets, data = texts.buffers()
            fits = automaton.fits(np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), np.frombuffer(offsets, np.int64)[: len(texts) + 1])
            rule, glob = first_fit(fits, base), first_fit(fits, own)
            glob = np.where(rule < 0, glob, -1)
            verdict = verdicts[np.where(rule >= 0, rule, glob)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said[rule], pa.string()), pa.array(said[glob], pa.string()), pa.array(verdict, pa.string())], names=names_out)

    names_out = ["key", "host", "path", "rule", "own_rule", "verdict"]
    bounded_batches(pages.sparkSession, 20_000)
    host, path = host_and_path(F.col(url).cast("string"))
    slim = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    return slim.mapInArrow(batches, f"key {dict(pages.dtypes)[key]}, host string, path string, rule string, own_rule string, verdict string").withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _regex(glob: str) -> str:
    out = "".join("(?s:.*)" if x == "**" else "[^/]*" if x == "*" else "".join(c if c.isalnum() or c == "/" else f"\\{c}" for c in x) for x in _parts(glob))
    return f"\\A{out}\\z"


def _parts(glob: str) -> list[str]:
    return [p for i, piece in enumerate(glob.split("**")) for p in (["**"] if i else []) + [q for j, x in enumerate(piece.split("*")) for q in (["*"] if j else []) + [x]]]


_BASE = " ".join(f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{i}}}'" for i, (_, h, p) in sorted(enumerate(RULES), key=lambda x: -len(x[1][1] + x[1][2])))
_OWN = " ".join(f"WHEN regexp_matches('.' || host || path, '{_regex(g)}') THEN '{v}'" for v, g in sorted(GLOBS, key=lambda x: -len(x[1])))
ORACLE_SQL = f"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)\\A.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)\\A.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
j AS (SELECT *, CASE {_BASE.format(*[h + p for _, h, p in RULES])} END AS rule, CASE {_BASE.format(*[v for v, _, _ in RULES])} {_OWN} ELSE '{DEFAULT}' END AS verdict,
    CASE {_BASE.format(*["" for _ in RULES])} {" ".join(f"WHEN regexp_matches('.' || host || path, '{_regex(g)}') THEN '{g}'" for _, g in sorted(GLOBS, key=lambda x: -len(x[1])))} END AS own_rule FROM u)
SELECT page_id, host, path, rule, nullif(own_rule, '') AS own_rule, verdict FROM j
"""
