"""Atomic facts against a plain left-to-right version over random Markdown, with nulls, empty texts and repeated keys."""

import random
import re

from pyspark.sql import functions as F

from lodestar.operators import facts, markdown

WHITE = "\t-\r    -     　﻿"


def strip(x):
    return re.sub(f"^[{WHITE}]+|[{WHITE}]+$", "", x)


def plain_sentences(text):
    out, start = [], 0
    for i, c in enumerate(text):
        if c not in ".!?" or i + 1 == len(text) or not re.match(f"[{WHITE}]", text[i + 1]):
            continue
        if not re.match(r"[A-Z0-9\"'(\[]", re.sub(f"^[{WHITE}]+", "", text[i + 1 :])):
            continue
        word = re.search(f"[^{WHITE}]*$", text[start:i])[0].lower()
        if c == "." and (word in markdown.ABBREVIATIONS or word.removesuffix(".") in markdown.ABBREVIATIONS or re.fullmatch("[a-z]", word)):
            continue
        out.append(text[start : i + 1])
        start = i + 1
    return [s for s in map(strip, [*out, text[start:]]) if s]


def plain_facts(text):
    out, heads, para, begin, fence, front = [], [], [], 0, False, False

    def push(raw, line, n, kind):
        said = re.sub(f"[{WHITE}]+", " ", re.sub(r"`[^`\n]*`", " ", raw)).strip(" ")[:300]
        if len(said) >= 15:
            out.append((line, n, kind, [t for _, t in heads], said))

    def flush():
        for n, s in enumerate(plain_sentences(" ".join(para)), 1):
            push(s, begin, n, "sentence")
        para.clear()

    for i, line in enumerate(re.split(r"\r?\n", text or "")):
        body = strip(line)
        if i == 0 and body == "---":
            front = True
        elif front:
            front = body != "---"
        elif body.startswith(("```", "~~~")):
            flush()
            fence = not fence
        elif fence:
            pass
        elif body == "" or body.startswith(">"):
            flush()
        elif m := re.match(f"(#{{1,6}})[{WHITE}]+(.*)$", body):
            flush()
            while heads and heads[-1][0] >= len(m[1]):
                heads.pop()
            heads.append((len(m[1]), re.sub(f"[{WHITE}]+", " ", m[2]).strip(" ")[:300]))
        elif m := re.match(rf"[{WHITE}]*(?:[-*+]|\d{{1,3}}[.)])[{WHITE}]+(.+)$", line):
            flush()
            for n, s in enumerate(x if len(x := plain_sentences(m[1])) > 1 else [m[1]], 1):
                push(s, i + 1, n, "list_item")
        else:
            begin = begin if para else i + 1
            para.append(body)
    flush()
    return out


def test_facts_against_the_plain_version(spark):
    rng = random.Random(9)
    lines = ["---", "", " ", "# One two", "## Sub head", "#### Deep", "#no heading", "> quoted text is left out. Really", "```", "~~~ x", "- item of a list that is long", "  12) First thing is so. Second thing too", "* short", "A long sentence that stands here. Another one follows it! e.g. This", "Dr. Who met J. R. Smith etc.. And so on? \"Yes\" he said to them", "code `x = 1. Y` within the line of text", " padded line of prose　", "x" * 400, "--- not a rule", "été commence. Été suit, mais. 3 choses"]
    texts = [None, "", "---\nonly front matter", "---\na: b\n---\nBody text that counts here.", "\r\n".join(lines), "a. B. C. Long enough sentence here. Next one is here"] + ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 30))) for _ in range(150)]
    rows = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "key long, text string")  # keys repeat
    got = sorted((r.key, r.line, r.n, r.kind, r.headings, r.statement) for r in facts.atomic_facts(rows, "key", "text").collect())
    assert got == sorted((i // 2, *f) for i, t in enumerate(texts) for f in plain_facts(t))
    assert len(got) > 500 and facts.atomic_facts(rows.limit(0), "key", "text").count() == 0


def test_sentences_against_the_plain_version(spark):
    rng = random.Random(10)
    bits = ["e.g.", "i.e.", "Cf.", "MR.", "etc..", "A.", "b.", "Word.", "really?!", "no", "(Yes.)", "\"Quoted", "3", "[x]", "été.", "Été", "end!", "　Wide", "..."]
    texts = [None, "", ".", "One.", "  One. \n\n Two.  "] + [rng.choice(["", " "]).join(rng.choice(bits) + rng.choice([" ", "  ", "\n", " "]) for _ in range(12)) for _ in range(400)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", markdown.sentences(F.col("t")).alias("s"))
    assert {r.i: r.s for r in rows.collect()} == {i: plain_sentences(t or "") for i, t in enumerate(texts)}
