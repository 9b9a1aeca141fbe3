"""Heading-aware chunks of Markdown texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TOKENS, MIN_TOKENS, OVERLAP = 800, 100, 100
_HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")
_FENCE = re.compile(r"^\s*(```+|~~~+)")
_ITEM = re.compile(r"^\s*([-*+]|\d+[.)])\s+")
_SPACE = re.compile(r"[ \t\r\n]+")


def count_tokens(text: str) -> int:
    return sum(1 for w in _SPACE.split(text) if w)


@dataclass
class Block:
    """Lines [first, last] of one kind; headings also have a level and a title."""

    kind: str
    first: int
    last: int
    level: int = 0
    title: str = ""


def blocks(lines: list[str]) -> list[Block]:
    """Frontmatter, fenced code, headings, tables, lists and paragraphs; an unclosed fence runs to the end."""
    out: list[Block] = []
    at = 0
    if lines and lines[0].strip() == "---":
        end = next((i for i in range(1, len(lines)) if lines[i].strip() == "---"), None)
        if end is not None:
            out.append(Block("frontmatter", 0, end))
            at = end + 1
    while at < len(lines):
        line = lines[at]
        if not line.strip():
            at += 1
            continue
        if fence := _FENCE.match(line):
            end = next((i for i in range(at + 1, len(lines)) if lines[i].strip().startswith(fence[1])), len(lines) - 1)
            out.append(Block("code", at, end))
            at = end + 1
            continue
        if heading := _HEADING.match(line):
            out.append(Block("heading", at, at, len(heading[1]), heading[2]))
            at += 1
            continue
        kind = "table" if line.lstrip().startswith("|") else "list" if _ITEM.match(line) else "paragraph"
        end = at
        while end + 1 < len(lines) and lines[end + 1].strip() and not _HEADING.match(lines[end + 1]) and not _FENCE.match(lines[end + 1]):
            end += 1
        out.append(Block(kind, at, end))
        at = end + 1
    return out


def chunks(text: str, most: int = MAX_TOKENS, least: int = MIN_TOKENS, overlap: int = OVERLAP) -> list[tuple[int, int, str, str]]:
    """(first line, last line, heading path, content), lines from 1.

    Blocks are packed greedily: a chunk ends before a block that would take it over `most` tokens, and before a heading
    once it has `least`. A chunk that follows another starts with the last lines of that one, up to `overlap` tokens and
    at least one line. A larger block is a chunk of its own.
    """
    lines = text.split("\n")
    tokens = [count_tokens(x) for x in lines]
    out: list[tuple[int, int, str, str]] = []
    path: list[tuple[int, str]] = []
    begin = end = None
    size = 0

    def flush() -> None:
        nonlocal begin, end, size
        if begin is None:
            return
        out.append((begin + 1, end + 1, " > ".join(t for _, t in path), "\n".join(lines[begin : end + 1])))
        begin = end = None
        size = 0

    for b in blocks(lines):
        n = sum(tokens[b.first : b.last + 1])
        if begin is not None and (size + n > most or (b.kind == "heading" and size >= least)):
            last = end
            flush()
            if b.kind != "heading" and n < most:
                start, carried = last, tokens[last]
                while start > 0 and carried + tokens[start - 1] <= overlap and start - 1 > out[-1][0] - 1:
                    start -= 1
                    carried += tokens[start]
                begin, size = start, carried
        if b.kind == "heading":
            while path and path[-1][0] >= b.level:
                path.pop()
            path.append((b.level, b.title))
        if begin is None:
            begin = b.first
        end, size = b.last, size + n
        if n >= most:
            flush()
    flush()
    return out


def chunk_documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chunk_index, line_start, line_end, heading_path, content) of every whole text; null texts have no chunks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, i, *c) for k, t in zip(frame["k"], frame["t"], strict=True) for i, c in enumerate(chunks(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "line_start", "line_end", "heading_path", "content"])

    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInPandas(run, "doc_id long, chunk_index int, line_start int, line_end int, heading_path string, content string")
