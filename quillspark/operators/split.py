"""Chapters, chunks and segments of texts.  Splitting is recursive or needs match positions: UDFs, a text at a time.

Rows go to Python by the hundred, as plain UDFs have them: an Arrow batch of 10,000 whole texts and their pieces is as large
as the texts are.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import vocabulary as V

SEGMENT = "array<struct<number:int,title:string,content:string,start:int,end:int,strategy:string,confidence:double>>"
CHUNK = "array<struct<chunk_index:int,content:string,start:int,end:int>>"
#: Sizes of chunks (least, most, ideal): modern and classical.
MODERN, CLASSICAL = (800, 1500, 1200), (300, 700, 500)


def fixed_blocks(text: str, size: int = 5000, gap: str = "\n\n") -> list[dict]:
    """Blocks of about `size` characters, moved to a gap less than half a block away."""
    out, at, number = [], 0, 0
    while at < len(text):
        number += 1
        end = min(at + size, len(text))
        if end < len(text):
            back, ahead = text.rfind(gap, at, end), text.find(gap, end)
            if back > at + size // 2:
                end = back
            elif ahead >= 0 and ahead - end < size // 2:
                end = ahead
        body = text[at:end].strip()
        if body:
            out.append({"number": number, "title": f"第{number}章", "content": body, "start": at, "end": end, "strategy": "fixed_length", "confidence": 0.3})
        at = end
    return out


def headed(text: str, patterns: Sequence[re.Pattern]) -> list[dict]:
    """Chapters at headings anywhere in the text (of several at one place the first pattern's); else fixed blocks."""
    counts = [0] * len(patterns)
    found: dict[int, str] = {}
    for i, p in enumerate(patterns):
        for m in p.finditer(text):
            counts[i] += 1
            found.setdefault(m.start(), m.group().strip())
    marks = sorted(found.items())
    if marks and marks[0][0] > 0:
        marks.insert(0, (0, "前言"))
    if len(marks) < 2:
        return fixed_blocks(text)
    sure = min(1.0, max(counts) / 50)
    ends = [at for at, _ in marks[1:]] + [len(text)]
    return [{"number": i, "title": title, "content": body, "start": at, "end": end, "strategy": "regex_chapter", "confidence": sure} for i, ((at, title), end) in enumerate(zip(marks, ends, strict=True), 1) if (body := text[at:end].strip())]


def split_chapters(df: DataFrame, text: str, patterns: Sequence[str] = V.CHAPTER_PATTERNS, keep: Sequence[str] = ()) -> DataFrame:
    """Each text's chapters, one a row; patterns are a parameter, nothing leaks from one book to the next."""
    ready = [re.compile(p) for p in patterns]

    @F.udf(SEGMENT, useArrow=False)
    def run(t: str | None) -> list[dict]:
        return headed(t or "", ready)

    return df.select(*keep, F.explode(run(text)).alias("s")).select(*keep, "s.*")


def split_fixed(df: DataFrame, text: str, size: int = 5000, gap: str = "\n\n", keep: Sequence[str] = ()) -> DataFrame:
    @F.udf(SEGMENT, useArrow=False)
    def run(t: str | None) -> list[dict]:
        return fixed_blocks(t or "", size, gap)

    return df.select(*keep, F.explode(run(text)).alias("s")).select(*keep, "s.*")


def _nearest(text: str, mid: int, mark: str, inclusive: bool, window: int) -> int | None:
    ahead, back = text.find(mark, mid, min(len(text), mid + window)), text.rfind(mark, max(0, mid - window), mid)
    spots = [x for x in (ahead, back) if x >= 0]
    if not spots:
        return None
    # the nearer; ahead if both are as near
    return min(spots, key=lambda x: (abs(x - mid), x < mid)) + (len(mark) if inclusive else 0)


def halves(text: str, most: int, marks: Sequence[tuple] = V.SPLIT_DELIMITERS, window: int = 1000) -> list[tuple[str, str]]:
    """(piece, strategy) of a text cut near the middle, again and again, at the best delimiter there is."""
    if len(text) <= most:
        return [(text, "none")]
    mid = len(text) // 2
    cut, how = mid, "exact_half"
    for mark, inclusive, name in marks:
        at = _nearest(text, mid, mark, inclusive, window)
        if at is not None and 0 < at < len(text):
            cut, how = at, name
            break
    both = halves(text[:cut], most, marks, window) + halves(text[cut:], most, marks, window)
    return [(t, how if s == "none" else s) for t, s in both]


def classical_halves(text: str, most: int) -> list[str]:
    """Pieces of a classical text, cut near the middle after the marks that end its sentences."""
    if len(text) <= most:
        return [text]
    mid, reach = len(text) // 2, most // 4
    cut = None
    for mark in (*V.CLASSICAL_ENDS, "。", "！", "？", "\n"):
        at = text.find(mark, mid - reach, mid + reach)
        if at >= 0:
            cut = at + len(mark)
            break
    if cut is None or not 0 < cut < len(text):
        cut = mid
    return classical_halves(text[:cut], most) + classical_halves(text[cut:], most)


def smart_split(df: DataFrame, text: str, most: int = 50_000, marks: Sequence[tuple] = V.SPLIT_DELIMITERS, keep: Sequence[str] = ()) -> DataFrame:
    """Segments of oversized texts: split_index, total_splits, content, strategy."""

    @F.udf("array<struct<split_index:int,total_splits:int,content:string,strategy:string>>", useArrow=False)
    def run(t: str | None) -> list[dict] | None:
        if t is None:
            return None
        got = halves(t, most, marks)
        return [{"split_index": i, "total_splits": len(got), "content": c, "strategy": s} for i, (c, s) in enumerate(got)]

    # texts that stay whole do not go to Python
    cut = run(F.when(F.char_length(text) > most, F.col(text)))
    whole = F.array(F.struct(F.lit(0).alias("split_index"), F.lit(1).alias("total_splits"), F.coalesce(text, F.lit("")).alias("content"), F.lit("none").alias("strategy")))
    return df.select(*keep, F.explode(F.coalesce(cut, whole)).alias("s")).select(*keep, "s.*")


def looks_classical(text: str) -> bool:
    if len(text) < 50:
        return False
    old = sum(map(text.count, V.CLASSICAL_PARTICLES)) * 1000 / len(text)
    new = sum(map(text.count, V.MODERN_PARTICLES)) * 1000 / len(text)
    pairs = len(re.findall("者[^。]*也", text)) * 1000 / len(text)
    return old > 50 and new < 10 or old > 30 and pairs > 2 or old / max(new, 1) > 5


def packed(text: str, gap: str = "\n\n", sizes: tuple | None = None) -> list[dict]:
    """Paragraphs packed to chunks: a chunk ends when the next would pass the most and it has the least; longer ones are cut."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    old = sizes is None and looks_classical(text)
    least, most, ideal = sizes or (CLASSICAL if old else MODERN)
    out: list[tuple[str, int]] = []
    held: list[tuple[str, int]] = []
    at = 0

    def flush():
        if held:
            out.append((gap.join(p for p, _ in held), held[0][1]))
            held.clear()

    for raw in text.split(gap):
        para, start = raw.strip(), at + len(raw) - len(raw.lstrip())
        at += len(raw) + len(gap)
        if not para:
            continue
        size = sum(len(p) for p, _ in held)
        if len(para) > most:
            flush()
            for piece in classical_halves(para, ideal) if old else [t for t, _ in halves(para, most)]:
                out.append((piece, start))
                start += len(piece)
        else:
            if size + len(para) > most and size >= least:
                flush()
            held.append((para, start))
    flush()
    return [{"chunk_index": i, "content": c, "start": s, "end": s + len(c)} for i, (c, s) in enumerate(out)]


def chunk(df: DataFrame, text: str, gap: str = "\n\n", sizes: tuple | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Chunks of chapters, one a row; offsets are those of the text."""

    @F.udf(CHUNK, useArrow=False)
    def run(t: str | None) -> list[dict]:
        return packed(t or "", gap, sizes)

    return df.select(*keep, F.explode(run(text)).alias("s")).select(*keep, "s.*")
