"""Secret scans: all rules in one byte pass of a combined deterministic automaton.

The automaton says where a rule's match ends. Between two places where it is in
its start state no match is under way, so the stretch around an end holds the
whole match; there the rule's own expression gives the exact spans.
"""

from __future__ import annotations

import bisect
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from insight_spark.llm import automaton as dfa
from insight_spark.llm.common import id_type, map_chunks, text_column

MARK = "[REDACTED]"


class Rule(NamedTuple):
    """``pattern`` finds candidates; those whose ``group`` has ``least`` characters or more are kept.

    ``scan`` is the same with the length in it, for the automaton. ``fold``:
    ASCII letters in either case.
    """

    kind: str
    pattern: str
    group: int
    least: int
    scan: str
    fold: bool = False


_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{%s,})"""
RULES = (
    Rule("assign", _ASSIGN % 1, 2, 6, _ASSIGN % 6, fold=True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24,}"),
)
SPAN = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"


def find_spans(texts: list[str | None], rules: tuple[Rule, ...], machine: dfa.Automaton) -> dict[int, list[tuple]]:
    """Text number -> (kind, start, end, base) in code points, by start and the order of the rules.

    Base spans are the leftmost non-overlapping matches of each rule that are
    long enough. Others end where the automaton accepts a rule too, but a match
    before them hides them; of those with the same end the longest is given.
    """
    encoded = [(text or "").encode("utf-8", "surrogatepass") for text in texts]
    data = bytes([dfa.SEPARATOR]).join([*encoded, b""])
    starts = np.concatenate(([0], np.cumsum([len(e) + 1 for e in encoded])))
    states = dfa.scan(machine, data)
    patterns = [dfa.compiled(rule.pattern, rule.fold) for rule in rules]
    found: dict[int, list[tuple]] = {}
    last = shift = counted = -1
    for begin, end in _windows(states, machine):
        text_no = bisect.bisect_right(starts, begin) - 1
        if text_no != last:
            last, shift, counted = text_no, 0, int(starts[text_no])
        # Code points since the window before: a text's bytes are counted once.
        shift += int(np.count_nonzero((np.frombuffer(data, np.uint8, begin - counted, counted) & 0xC0) != 0x80))
        counted = begin
        window, accepted = data[begin:end].decode("ascii"), machine.accepts[states[begin:end]]
        spans = found.setdefault(text_no, [])
        for number, (rule, pattern) in enumerate(zip(rules, patterns)):
            on = (accepted >> number & 1).astype(bool)
            if not on.any():
                continue
            ends = np.flatnonzero(on & ~np.append(on[1:], False)) + 1
            spans += [(shift + a, number, shift + b, base) for a, b, base in _exact(window, ends, rule, pattern)]
    return {
        text_no: [(rules[number].kind, a, b, base) for a, number, b, base in sorted(spans)]
        for text_no, spans in found.items()
    }


def _windows(states: np.ndarray, machine: dfa.Automaton) -> list[tuple[int, int]]:
    """Stretches that hold an accepting state and begin after the last start state before it."""
    on = states >= machine.first_accepting
    if not on.any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate(([False], on, [False])).astype(np.int8)))
    idle = np.flatnonzero(states == 0)
    begins = np.searchsorted(idle, edges[::2])
    begins = np.where(begins > 0, idle[np.maximum(begins - 1, 0)] + 1, 0) if len(idle) else np.zeros(len(begins), np.int64)
    out: list[tuple[int, int]] = []
    for begin, end in zip(begins.tolist(), edges[1::2].tolist()):
        if out and begin < out[-1][1]:  # no start state since the window before
            begin = out.pop()[0]
        out.append((begin, end))
    return out


def _exact(window: str, ends: np.ndarray, rule: Rule, pattern) -> list[tuple[int, int, bool]]:
    spans, taken = [], set()
    for match in pattern.finditer(window):
        if match.end(rule.group) - match.start(rule.group) >= rule.least:
            spans.append((match.start(), match.end(), True))
            taken.add(match.end())
    for end in ends.tolist():
        at = 0
        while end not in taken and (match := pattern.search(window, at, end)):
            if match.end() == end and match.end(rule.group) - match.start(rule.group) >= rule.least:
                spans.append((match.start(), end, False))
                taken.add(end)
            at = match.start() + 1
    return spans


def _machine(rules: tuple[Rule, ...]) -> dfa.Automaton:
    return dfa.compile_patterns(tuple((rule.scan, rule.fold) for rule in rules))


def scan(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """(``id_col``, spans) per row, whole texts.

    Null and empty texts have no span. Rows are scanned one by one: repeated
    rows and null ids stay, an empty table gives no rows, other columns are not
    read. A text's length is bounded only by what one row may hold.
    """
    machine = _machine(rules)

    def work(chunk: pa.RecordBatch) -> pa.RecordBatch:
        found = find_spans(text_column(chunk, text_col).to_pylist(), rules, machine)
        spans = [
            [{"kind": k, "start": a, "end": b, "base": base} for k, a, b, base in found.get(i, ())]
            for i in range(chunk.num_rows)
        ]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        return pa.RecordBatch.from_arrays([chunk.column(0), pa.array(spans, kind)], names=[id_col, "spans"])

    return map_chunks(df.select(id_col, text_col), work, f"`{id_col}` {id_type(df, id_col)}, spans {SPAN}")


def redact(
    df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, mark: str = MARK, flag: str = "redacted"
) -> DataFrame:
    """All columns, with every span (merged where they overlap) replaced by ``mark``, and a boolean ``flag``.

    A null text stays null. Rows, order within a task and other columns stay.
    ``flag`` must be a new name.
    """
    if flag in df.columns:
        raise ValueError(f"column {flag} exists")
    machine = _machine(rules)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    place = df.columns.index(text_col)

    def work(chunk: pa.RecordBatch) -> pa.RecordBatch:
        texts = chunk.column(place).cast(pa.string()).to_pylist()
        found = find_spans(texts, rules, machine)
        for i, spans in found.items():
            texts[i] = cut_out(texts[i], [(a, b) for _, a, b, _ in spans], mark)
        columns = [*chunk.columns]
        columns[place] = pa.array(texts, pa.string())
        hit = pa.array([i in found for i in range(chunk.num_rows)], pa.bool_())
        return pa.RecordBatch.from_arrays([*columns, hit], names=[*df_columns, flag])

    df_columns = list(df.columns)
    return map_chunks(df, work, f"{fields}, `{flag}` boolean")


def cut_out(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    parts, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _joined(spans: str) -> Column:
    return F.expr(f"concat_ws(',', transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)))")


def digest(scanned: DataFrame, id_col: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of base spans per kind, their SHA-256, and all spans as text."""
    base = scanned.withColumn("_base", F.expr("filter(spans, s -> s.base)"))
    counts = [
        F.expr(f"cast(size(filter(_base, s -> s.kind = '{rule.kind}')) AS bigint)").alias(f"n_{rule.kind}")
        for rule in rules
    ]
    return base.select(
        id_col, *counts, F.sha2(_joined("_base"), 256).alias("base_sha256"), _joined("spans").alias("spans")
    )
