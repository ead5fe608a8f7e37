"""Secrets in whole texts by finite automata.

One minimal automaton for all rules reads each byte once, for all rules together, and
marks where matches can end. From each mark an automaton of that rule read backward finds where the match begins, and one
read forward how far it goes. Only the bytes of matches are read again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from terrafold.llm.arrow_map import map_texts
from terrafold.llm.automaton import BREAK, Walk, compile_rules, scan


@dataclass(frozen=True)
class Rule:
    """Matches are ``head`` and then as many bytes of the class ``body`` as there are, one at least.

    A match is a span if it has ``least`` bytes or more, counted behind the head if ``behind``. ``sure``: whether each run of body
    bytes that could be a span belongs to the match that begins first; then only runs long enough are marked. Else shorter matches count
    too: they take the bytes that they cover from matches behind them.
    """

    kind: str
    head: str
    body: str
    least: int = 1
    behind: bool = False
    fold: bool = False
    sure: int = 1


_KEYS = "(password|passwd|secret|token|api_?key)"
# The rules whose spans the contract of the scan names.
BASE_RULES = (
    Rule("assign", _KEYS + r"""["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]", 6, True, True),
    Rule("access", "AKIA", "[A-Z0-9]", 20, sure=16),
    Rule("hex", "", "[0-9a-f]", 24, sure=24),
)
#: Rules beside these.
MORE_RULES = (
    Rule("pem", "-----BEGIN [A-Z0-9 ]*PRIVATE KEY----", "-"),
    Rule("vcs", "gh[pousr]_", "[A-Za-z0-9]", 24),
    Rule("chat", "xox[abeoprs]-", "[A-Za-z0-9-]", 20, sure=8),
)

SPANS = StructType([StructField("secrets", ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])))])


class Reader:
    """The spans of one rule in bytes, from the places where its matches can end."""

    def __init__(self, rule: Rule):
        self.rule, whole = rule, f"{rule.head}{rule.body}+"
        self.back, self.on, self.head = Walk(whole, rule.fold, True), Walk(whole, rule.fold), Walk(rule.head, rule.fold) if rule.behind else None

    def spans(self, data: bytes, ends: list[int]) -> list[tuple[int, int]]:
        """Leftmost spans (start, end) that do not overlap; ``ends``: last bytes of marked matches, rising."""
        out, at = [], 0
        for end in ends:
            if end < at or (start := self.back.furthest(data, end + 1, at)) is None:
                continue
            at = self.on.furthest(data, start, len(data))
            counted = self.head.furthest(data, start, at) if self.head else start
            if at - counted >= self.rule.least:
                out.append((start, at))
        return out


def find_secrets(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """``keep`` columns and ``secrets``: spans (kind, start, end) by start, then by the order of ``rules``.

    Start and end count code points, end exclusive. A null text is read as empty
    and has no spans; a row stays a row, however often it repeats; an empty table
    gives an empty result; columns outside ``keep`` take no part.
    """
    # Behind the sure length the automaton stays where it is, so that lanes agree in runs of any length; one mark a run is enough.
    step, column, hits = compile_rules([(f"{r.head}{r.body}{{{r.sure}{',' if r.sure > 1 else ''}}}", r.fold) for r in rules])
    once = sum(1 << k for k, r in enumerate(rules) if r.sure > 1)

    def make():
        readers = [Reader(r) for r in rules]

        def run(texts: list) -> list:
            raw = [(t or "").encode() for t in texts]
            starts = np.cumsum([0] + [len(x) + 1 for x in raw])
            where, bits = scan(bytes([BREAK]).join(raw), step, column, hits, once)
            of = np.searchsorted(starts, where, "right") - 1
            out: list[list] = [[] for _ in raw]
            for i, a, z in zip(*np.unique(of, return_index=True), np.flatnonzero(np.append(np.diff(of) != 0, True)) + 1, strict=True) if of.size else ():
                found = []
                for k, reader in enumerate(readers):
                    ends = (where[a:z][bits[a:z] >> k & 1 > 0] - starts[i]).tolist()
                    found += [(s, k, e) for s, e in reader.spans(raw[i], ends)]
                if found:
                    # Code points before a byte: those bytes before it that begin one.
                    points = None if raw[i].isascii() else np.concatenate([[0], np.cumsum((np.frombuffer(raw[i], np.uint8) & 0xC0) != 0x80)])
                    place = (lambda x: x) if points is None else (lambda x: int(points[x]))
                    out[i] = [{"kind": rules[k].kind, "start": place(s), "end": place(e)} for s, k, e in sorted(found)]
            return [out]

        return run

    return map_texts(df, text, list(keep), SPANS, make)


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def secret_report(df: DataFrame) -> DataFrame:
    """Counts and digest of the base rules' spans, and all spans, by document."""
    found = find_secrets(df)
    base = F.filter("secrets", lambda s: s["kind"].isin(*[r.kind for r in BASE_RULES]))
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[of(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
