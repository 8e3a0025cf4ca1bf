"""Secret scans: patterns, and zstandard novelty in sensitive context (operator 1).

Three base patterns find assigned secrets, access keys and long hex runs.  The
method adds ``novel`` spans: in and next to lines that speak of credentials, each string
mixing letters and digits is compressed with zstandard, primed with a dictionary
of identifiers that the corpus uses in such places and with the text around it.
What the candidate adds in
bytes, over its length, is its novelty; strings that stay incompressible are
reported.  Long strings whose symbols are equally frequent are held against what
their own alphabet needs, as hex digits can't take a byte each.  The body of a
private key is judged as one string and reported by line.  A string that its text
repeats costs a few bytes only.

Defined results: a null text is an empty text and has no spans.  Rows that
repeat an id are scanned each on its own.  Spans count code points, ends are
exclusive; ``novel`` spans never overlap base spans.  Extra columns are kept by
``redact_secrets`` and ignored by ``scan_secrets``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loftline.llm.kernels import runs, text_blocks, utf8_view
from loftline.llm.store import attach, lean

#: In the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: A line with one of these words is a sensitive context.
CONTEXT = re.compile(r"(?i:passw|secret|token|api[_\x20-]?key|credential|bearer|private[_\x20-]?key|access[_\x20-]?key|authorization)")
#: Lines before and after it that belong to it.
LINES_BEFORE, LINES_AFTER = 1, 2
#: The body of a private key, behind its header lines.
PEM = re.compile(r"BEGIN\x20(?:[A-Z0-9]++\x20)*?PRIVATE\x20KEY-+\s*+(?:[A-Za-z0-9-]++:[^\n]*+\n\s*+)*+((?:[A-Za-z0-9+/=]++\s++)*+[A-Za-z0-9+/=]*+)(?=-+END|\Z)")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])")
#: Words of code and configuration: what the identifier dictionary holds before anything is learned.
IDENTIFIERS = " ".join(
    "password passwd secret token api_key apikey access_key private_key public_key client_id client_secret authorization bearer credential username user_id "
    "session_id database hostname localhost endpoint connection configuration environment application development production response request content-type "
    "application/json default function return import export const string integer boolean undefined https://www. http:// .com .org sha256 base64 utf-8 "
    "BEGIN PRIVATE KEY END CERTIFICATE 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ".split()
)
#: An identifier of the corpus has no digits, so that no secret becomes one; the dictionary takes the most frequent ones.
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9])[A-Za-z_][A-Za-z_.-]{2,40}(?![A-Za-z0-9])")
DICTIONARY_WORDS = 2000
#: Code points on either side of a candidate that prime the compressor: zstandard's window, in effect.
AROUND = 1 << 14
MIN_NOVELTY = 0.72
#: Strings from this length on may show that their symbols are equally frequent: entropy over that of their alphabet.
LONG, EVEN_SHARE = 40, 0.96
_WORDS = (b"passw", b"secret", b"token", b"key", b"credential", b"bearer", b"authorization")
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())])
SPAN_DDL = "array<struct<kind:string,start:bigint,end:bigint,novelty:double>>"


def novelty(candidate: str, before: str, after: str, identifiers: str = IDENTIFIERS) -> float:
    """Bytes that ``candidate`` adds to its surroundings when compressed, over its own bytes."""
    raw = candidate.encode()
    primer = zstandard.ZstdCompressionDict(f"{identifiers}\n{after}\n{before}".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=19, dict_data=primer, write_checksum=False, write_content_size=False, write_dict_id=False)
    return (len(press.compress(raw)) - len(press.compress(b""))) / max(1, len(raw))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the three base patterns."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def least_novelty(candidate: str, least: float) -> float:
    """``least``, or its share of what the alphabet needs where a long string uses all its symbols alike."""
    n, counts = len(candidate), np.array(list(Counter(candidate).values()))
    if n < LONG or len(counts) < 2:
        return least
    # Entropy with Miller and Madow's correction for short samples.
    entropy = float(-(counts / n * np.log2(counts / n)).sum()) + (len(counts) - 1) / (2 * n * np.log(2))
    bits = float(np.log2(len(counts)))
    return least * bits / 8 if entropy >= EVEN_SHARE * bits else least


def _windows(text: str) -> list[tuple[int, int]]:
    """Disjoint ranges of whole lines in or next to which a sensitive word stands."""
    out: list[tuple[int, int]] = []
    for word in CONTEXT.finditer(text):
        first, last = word.start(), word.end()
        for k in range(LINES_BEFORE + 1):
            first = text.rfind("\n", 0, max(0, first - (k > 0))) + 1
        if out and first <= out[-1][1]:
            first = out.pop()[0]
        for k in range(LINES_AFTER + 1):
            end = text.find("\n", min(len(text), last + (k > 0)))
            last = len(text) if end < 0 else end
        out.append((first, last))
    return out


def _surroundings(text: str, s: int, e: int) -> tuple[str, str]:
    """What stands before and after; first of all another place of the same string, however far it is."""
    before, after = text[max(0, s - AROUND) : s], text[e : e + AROUND]
    other = text.find(text[s:e])
    if other == s:
        other = text.find(text[s:e], e)
    if other >= 0 and not s - AROUND <= other < e + AROUND:
        before = f"{text[other : other + e - s]}\n{before}"
    return before, after


def novel_spans(text: str, base: list[tuple[int, int, int]], least: float = MIN_NOVELTY, identifiers: str = IDENTIFIERS) -> list[tuple[int, int, int, float]]:
    """Incompressible candidates in sensitive context, clear of the base spans."""
    found = []
    taken = sorted((s, e) for s, _, e in base)
    starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))

    def clear(s: int, e: int) -> bool:
        """Whether no span that begins before ``e`` reaches beyond ``s``."""
        k = bisect_left(starts, e)
        return not k or reach[k - 1] <= s

    for key in PEM.finditer(text):
        whole = "".join(key[1].split())
        if len(whole) < 16:
            continue
        score = novelty(whole, *_surroundings(text, *key.span(1)), identifiers)
        if score >= least_novelty(whole, least):
            own = [m.span() for m in re.finditer(r"\S+", key[1])]
            own = [(key.start(1) + s, key.start(1) + e) for s, e in own]
            found += [(s, 3, e, score) for s, e in own if clear(s, e)]
            taken = sorted([*taken, *own])
            starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    for first, last in _windows(text):
        for m in CANDIDATE.finditer(text, first, last):
            s, e = m.span()
            if not MIXED.match(m[0]) or not clear(s, e):
                continue
            score = novelty(m[0], *_surroundings(text, s, e), identifiers)
            if score >= least_novelty(m[0], least):
                found.append((s, 3, e, score))
    return found


def _rows_to_scan(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows that can hold a span: those with a sensitive word, AKIA or 16 hex digits in a row."""
    hits: list[int] = []
    raw = buf.tobytes()
    low = raw.lower()
    for where, word in [*((low, w) for w in _WORDS), (raw, b"AKIA")]:
        at = where.find(word)
        while at >= 0:
            row = int(np.searchsorted(offs, at, "right"))
            hits.append(row - 1)
            # One find in a row is enough.
            at = where.find(word, int(offs[row]) if row < len(offs) else len(where))
    digit = (buf >= 0x30) & (buf <= 0x39) | (buf >= 0x61) & (buf <= 0x66)
    # A mark between two rows keeps their runs apart.
    shift = np.arange(len(offs) - 1)
    apart = np.zeros(len(buf) + len(shift), bool)
    keep = np.ones(len(apart), bool)
    keep[offs[1:] + shift] = False
    apart[keep] = digit
    starts, ends = runs(apart)
    long = starts[ends - starts >= 16]
    return np.unique(np.concatenate([np.array(hits, np.int64), np.searchsorted(offs[1:] + shift, long, "right")]))


def identifiers_of(docs: DataFrame, words: int = DICTIONARY_WORDS) -> str:
    """The identifiers that stand most often in sensitive contexts of all texts, the commonest last, behind ``IDENTIFIERS``."""
    attach(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for block in text_blocks(batches, "text"):
            buf, offs = utf8_view(block["text"])
            for row in _rows_to_scan(buf, offs).tolist():
                text = buf[offs[row] : offs[row + 1]].tobytes().decode()
                for first, last in _windows(text):
                    held.update(m[0] for m in IDENTIFIER.finditer(text, first, last))
            if len(held) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], ["word", "n"])
                held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(count), "word string, n long")
    top = found.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "word").limit(words).collect()
    # The compressor reaches what comes last most cheaply.
    return " ".join([IDENTIFIERS, *(r["word"] for r in reversed(top))])


def _scan(batches: Iterator[pa.RecordBatch], least: float, identifiers: str) -> Iterator[pa.RecordBatch]:
    for block in text_blocks(batches, "text"):
        buf, offs = utf8_view(block["text"])
        spans: list[list[dict]] = [[] for _ in range(block.num_rows)]
        for row in _rows_to_scan(buf, offs).tolist():
            text = buf[offs[row] : offs[row + 1]].tobytes().decode()
            base = base_spans(text)
            every = sorted([(*s, 1.0) for s in base] + novel_spans(text, base, least, identifiers))
            spans[row] = [{"kind": KINDS[k], "start": s, "end": e, "novelty": v} for s, k, e, v in every]
        columns = [block[c].combine_chunks() for c in block.column_names]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, pa.list_(_SPAN))], [*block.column_names, "spans"])


def scan_secrets(docs: DataFrame, least: float = MIN_NOVELTY, with_text: bool = False) -> DataFrame:
    """``doc_id`` and ``spans`` of each document, by start and then kind."""
    identifiers = identifiers_of(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(lean(lambda batches: _scan(batches, least, identifiers)), f"doc_id long, text string, spans {SPAN_DDL}")
    return out if with_text else out.drop("text")


def redact_secrets(docs: DataFrame, least: float = MIN_NOVELTY, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with the spans in ``text`` replaced by ``mask``; ``n_chars`` follows where there is one.

    Documents without secrets are unchanged, and none is dropped.
    """
    identifiers = identifiers_of(docs)
    schema = docs.schema

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text"):
            buf, offs = utf8_view(block["text"])
            texts, sizes = {}, {}
            for row in _rows_to_scan(buf, offs).tolist():
                text = buf[offs[row] : offs[row + 1]].tobytes().decode()
                base = base_spans(text)
                at, parts = 0, []
                for s, e in sorted((x[0], x[2]) for x in [*base, *novel_spans(text, base, least, identifiers)]):
                    if e > at:
                        if s >= at:
                            parts += [text[at:s], mask]
                        at = e
                if parts:
                    texts[row] = "".join(parts) + text[at:]
                    sizes[row] = len(texts[row])
            columns = []
            for name in block.column_names:
                column = block[name].combine_chunks()
                change = texts if name == "text" else sizes if name == "n_chars" else {}
                if change:
                    rows = np.fromiter(change, np.int64)
                    mark = np.zeros(block.num_rows, bool)
                    mark[rows] = True
                    column = pa.compute.replace_with_mask(column, pa.array(mark), pa.array([change[r] for r in sorted(change)], column.type))
                columns.append(column)
            yield pa.RecordBatch.from_arrays(columns, block.column_names)

    return docs.mapInArrow(lean(redact), schema)
