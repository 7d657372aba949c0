"""Bare text: what two documents are compared by."""

from __future__ import annotations

import unicodedata

import regex

#: A page-marker line, once the BOM is gone.
MARKER_LINE = regex.compile(r"(?m)^[^\S\n]*\[\[PAGE\s+\d+\]\][^\S\n]*$")
_OTHER = regex.compile(r"[^\p{L}\p{N}]+")


def bare_text(text: str | None) -> str:
    """Without BOM and page-marker lines, NFKC, lower case, letters and digits only; null gives ''."""
    if not text:
        return ""
    if "[[" in text:
        text = MARKER_LINE.sub("", text.replace("﻿", ""))
    return _OTHER.sub("", unicodedata.normalize("NFKC", text).lower())
