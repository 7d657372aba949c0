"""Evaluation texts inside documents, found by a generalised suffix automaton."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shirabe.llm.bare import MARKER_LINE, bare_text

#: Characters of items in one automaton (about 0.5 KB of memory each); more items are taken in several blocks.
BLOCK_CHARS = 200_000


class SuffixAutomaton:
    """All substrings of several texts; says which texts hold a matched string.

    Memory grows with the texts' total length. ``needs`` has for each text the
    length from which a match counts; only states whose strings can reach the
    least of these keep the set of their texts.
    """

    def __init__(self, texts: list[str], needs: list[int]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.needs, self.least = needs, min(needs, default=1)
        for text in texts:
            last = 0
            for c in text:
                last = self._extend(last, c)
        self.texts: dict[int, list[int]] = {}
        for number, text in enumerate(texts):
            at = 0
            for c in text:
                at = self.next[at][c]
                up = at
                while up > 0 and self.length[up] >= self.least:
                    held = self.texts.setdefault(up, [])
                    if held and held[-1] == number:
                        break
                    held.append(number)
                    up = self.link[up]

    def _extend(self, last: int, c: str) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: str, q: int) -> int:
        twin = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def _reached(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(end, state, length) of the longest match that ends at each place, where that has the least needed length."""
        nxt, link, length, least = self.next, self.link, self.length, self.least
        state = size = 0
        for at, c in enumerate(text):
            to = nxt[state].get(c)
            if to is None:
                while to is None and state:
                    state = link[state]
                    to = nxt[state].get(c)
                if to is None:
                    size = 0
                    continue
                size = length[state]
            state = to
            size += 1
            if size >= least:
                yield at + 1, state, size

    def longest(self, text: str) -> dict[int, tuple[int, int]]:
        """text number -> (length, end in ``text``) of its longest stretch in ``text``, where that reaches what it needs."""
        best: dict[int, tuple[int, int]] = {}
        for end, up, matched in self._reached(text):
            while up > 0 and matched >= self.least:
                for number in self.texts.get(up, ()):
                    if matched >= self.needs[number] and matched > best.get(number, (0, 0))[0]:
                        best[number] = (matched, end)
                up = self.link[up]
                matched = self.length[up]
        return best

    def stretches(self, text: str) -> list[tuple[int, int]]:
        """(start, end) in ``text`` of all stretches that reach what some text needs; those that overlap or touch are one."""
        out: list[tuple[int, int]] = []
        for end, up, matched in self._reached(text):
            while up > 0 and matched >= self.least:
                # Shorter matches with the same end lie inside this one.
                if any(matched >= self.needs[number] for number in self.texts.get(up, ())):
                    start = end - matched
                    while out and out[-1][1] >= start:
                        start = min(start, out.pop()[0])
                    out.append((start, end))
                    break
                up = self.link[up]
                matched = self.length[up]
        return out


#: Blocks that one pass over the documents looks for; more take further passes, so that a worker's memory stays bounded.
PASS_BLOCKS = 4

_BUILT: list = [None, None]


def _automata(shared) -> list[SuffixAutomaton]:
    """The automata of a pass's broadcast blocks, built once per Python worker."""
    if _BUILT[0] is not shared.value:
        _BUILT[:] = shared.value, [SuffixAutomaton([t for _, t, _ in block], [n for _, _, n in block]) for block in shared.value]
    return _BUILT[1]


def item_blocks(items: DataFrame, share: float, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str, int]]]:
    """Blocks of (item_id, bare text, needed length) of at most ``block_chars`` characters or one item."""
    block: list[tuple[int, str, int]] = []
    size = 0
    for row in items.select("item_id", "text").where("text IS NOT NULL").toLocalIterator():
        bare = bare_text(row["text"])
        if not bare:
            continue
        if block and size + len(bare) > block_chars:
            yield block
            block, size = [], 0
        block.append((row["item_id"], bare, max(1, math.ceil(share * len(bare) - 1e-9))))
        size += len(bare)
    if block:
        yield block


def _passes(items: DataFrame, share: float, block_chars: int) -> Iterator[list[list[tuple[int, str, int]]]]:
    """Up to ``PASS_BLOCKS`` item blocks at a time."""
    blocks = item_blocks(items, share, block_chars)
    while some := list(islice(blocks, PASS_BLOCKS)):
        yield some


_FOUND = "doc_id bigint, item_id bigint, matched_chars int, item_chars int, matched_share double"


def leaks(documents: DataFrame, items: DataFrame, share: float = 0.4, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, matched_chars, item_chars, matched_share) of leaked items.

    The bare texts of the items make one generalised suffix automaton per block;
    each document is read and normalized once for up to ``PASS_BLOCKS`` of them
    and streams through each in one task, without a shuffle. An
    item leaked where its longest unbroken stretch in the document has at least
    ``share`` of its length. Null and empty texts leak nothing; an item without
    letters and digits cannot leak; repeated items each have their own row.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text").where("text IS NOT NULL AND text <> ''")
    out = None
    for blocks in _passes(items, share, block_chars):
        shared = spark.sparkContext.broadcast(blocks)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            automata = _automata(shared)
            for b in batches:
                rows = []
                for doc_id, text in zip(b["doc_id"], b["text"]):
                    bare = bare_text(text)
                    for automaton, names in zip(automata, shared.value):
                        for number, (size, _) in automaton.longest(bare).items():
                            item, whole, _ = names[number]
                            rows.append((doc_id, item, size, len(whole), size / len(whole)))
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "matched_chars", "item_chars", "matched_share"])

        found = docs.mapInPandas(run, _FOUND)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else _empty(spark, _FOUND)


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _placed(text: str) -> tuple[str, list[int]]:
    """The bare text and, for each of its characters, where in ``text`` it comes from."""
    gone = [(m.start(), m.end()) for m in MARKER_LINE.finditer(text.replace("﻿", " "))]
    out, places, k = [], [], 0
    i, n = 0, len(text)
    while i < n:
        while k < len(gone) and gone[k][1] <= i:
            k += 1
        j = i + 1
        while j < n and (unicodedata.combining(text[j]) or text[j] in "ﾞﾟ"):
            j += 1
        if not (k < len(gone) and gone[k][0] <= i < gone[k][1]):
            for c in bare_text(text[i:j]):
                out.append(c)
                places.append(i)
        i = j
    return "".join(out), places


def _without(text: str | None, cuts: list[int]) -> str | None:
    """The text without the stretches of ``cuts``: starts and ends in turn."""
    if not len(cuts):
        return text
    gone = bytearray(len(text))
    for low, high in zip(cuts[::2], cuts[1::2]):
        gone[low:high] = b"\1" * (high - low)
    return "".join(c for c, g in zip(text, gone) if not g)


def cleaned(documents: DataFrame, items: DataFrame, share: float = 0.4, drop_share: float = 0.5, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, text, removed_chars, dropped): documents without the stretches that leaked.

    Every stretch that reaches the needed share of an item is cut from the text,
    also where an item stands several times. All are found in the whole text,
    then cut. ``dropped`` marks documents of which more than ``drop_share`` would
    go; their text is null. Documents without leaks come out unchanged. No
    shuffle: lengths and cuts travel with the text.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text", F.array().cast("array<int>").alias("cuts"))
    for blocks in _passes(items, share, block_chars):
        shared = spark.sparkContext.broadcast(blocks)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            automata = _automata(shared)
            for b in batches:
                cuts = []
                for text, before in zip(b["text"], b["cuts"]):
                    found = list(before)
                    plain = bare_text(text)
                    if any(automaton.stretches(plain) for automaton in automata):
                        bare, places = _placed(text)
                        for automaton in automata:
                            for start, end in automaton.stretches(bare):
                                found += places[start], places[end - 1] + 1
                    cuts.append(found)
                yield b[["doc_id", "text"]].assign(cuts=cuts)

        docs = docs.mapInPandas(run, "doc_id bigint, text string, cuts array<int>")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            left = [_without(text, cuts) for text, cuts in zip(b["text"], b["cuts"])]
            removed = [len(text or "") - len(new or "") for text, new in zip(b["text"], left)]
            dropped = [gone > len(text or "") * drop_share for text, gone in zip(b["text"], removed)]
            kept = [None if drop else new for new, drop in zip(left, dropped)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": pd.Series(kept, dtype=object), "removed_chars": removed, "dropped": dropped})

    return docs.mapInPandas(cut, "doc_id bigint, text string, removed_chars int, dropped boolean")
