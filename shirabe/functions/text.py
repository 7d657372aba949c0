"""Text rules of the extraction as Column builders; only NFKC leaves the JVM."""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from shirabe.functions import constants as k
from shirabe.functions.normalize import nfkc

# Patterns of the text rules.
BLANKS = r"[ \t\r\f\x0B]+"
OUTER = r"^[\s\x0B\x1c-\x1f\x85\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x0B\x1c-\x1f\x85\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$"
LINE_ENDS = r"[\x1c-\x1e\x85\x{2028}\x{2029}]"
MARKER = r"(?m)^ *\[\[PAGE +([0-9]+)\]\] *$"
ENUMERATOR = r"^\(?[0-9０-９]+\)?[)）.．\-－\s]*"
NUMBER_PAIR = r"^[0-9０-９]+[-－][0-9０-９]+\s*"
CHAPTER = r"^第[0-9０-９]+[章節項編]\s*"
#: A run of candidate characters.
RUN = re.compile(f"[{k.CANDIDATE_CLASS}]{{{k.CANDIDATE_MIN},{k.CANDIDATE_MAX}}}")


def strip(text: Column) -> Column:
    """Without outer white space of any script."""
    return F.regexp_replace(text, OUTER, "")


def normalize_text(text: Column, already_nfkc: bool = False) -> Column:
    """NFKC, no BOM, runs of blanks to one, at most one empty line, stripped; null gives ''."""
    text = F.coalesce(text if already_nfkc else nfkc(text), F.lit(""))
    text = F.regexp_replace(F.replace(text, F.lit("﻿"), F.lit("")), BLANKS, " ")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def split_sentences(text: Column, terminators: str = k.TERMINATORS) -> Column:
    """Array of the sentences of a normalized text: split after terminators and at line ends, two characters at least."""
    pieces = F.regexp_extract_all(text, F.lit(f"([^{terminators}\\n]*[{terminators}]|[^{terminators}\\n]+)"), F.lit(1))
    return F.filter(F.transform(pieces, strip), lambda s: F.length(s) >= 2)


def paged_sentences(text: Column, terminators: str = k.TERMINATORS) -> Column:
    """Array of (page, sentence) of a normalized text, in order, without its page-marker lines.

    A line that is wholly a page marker sets the page of what follows; before
    the first it is null. The text is split at its markers, so no row-by-row
    carrying forward, and no shuffle, is needed.
    """
    lines = F.regexp_replace(text, LINE_ENDS, "\n")
    numbers = F.transform(F.regexp_extract_all(lines, F.lit(MARKER), F.lit(1)), lambda n: n.try_cast("int"))
    pages = F.concat(F.array(F.lit(None).cast("int")), numbers)
    parts = F.split(lines, MARKER, -1)
    return F.flatten(
        F.transform(F.arrays_zip(pages.alias("page"), parts.alias("part")), lambda p: F.transform(split_sentences(p["part"], terminators), lambda s: F.struct(p["page"].alias("page"), s.alias("sentence"))))
    )


def unpaged_sentences(text: Column, terminators: str = k.TERMINATORS) -> Column:
    """Array of (page, sentence) of a normalized text that has nothing but markers: these, without a page."""
    return F.transform(split_sentences(text, terminators), lambda s: F.struct(F.lit(None).cast("int").alias("page"), s.alias("sentence")))


def clean_candidate(text: Column) -> Column:
    """Without leading enumerators, white space and outer punctuation; ``text`` is NFKC."""
    text = strip(F.regexp_replace(text, BLANKS, " "))
    for pattern in (ENUMERATOR, NUMBER_PAIR, CHAPTER, r"[\s\x{3000}]+"):
        text = F.regexp_replace(text, pattern, "")
    return F.regexp_replace(text, f"^[{k.STRIPPED}]+|[{k.STRIPPED}]+$", "")


def valid_candidate(term: Column) -> Column:
    """2 to 40 characters, no digit first, not all hiragana, at least one kanji, katakana or ASCII letter or digit."""
    return (
        F.length(term).between(k.CANDIDATE_MIN, k.CANDIDATE_MAX)
        & ~term.rlike(k.ALL_HIRAGANA)
        & ~term.rlike(k.DIGIT_FIRST)
        & term.rlike(k.TERM_CHARACTER)
    )


_SPANS = ArrayType(StructType([StructField("start_char", IntegerType(), False), StructField("end_char", IntegerType(), False), StructField("candidate", StringType(), False)]), False)
_EDGES = re.compile(f"^[{k.STRIPPED}]+|[{k.STRIPPED}]+$")
_LEADING = [re.compile(p) for p in (ENUMERATOR, NUMBER_PAIR, CHAPTER)]
_BARRED = re.compile(f"{k.ALL_HIRAGANA}|{k.DIGIT_FIRST}")
_NEEDED = re.compile(k.TERM_CHARACTER)
_TWO_KANJI, _KATAKANA = re.compile(k.TWO_KANJI), re.compile(k.KATAKANA)


@lru_cache(maxsize=65536)
def _term_of(run: str) -> str | None:
    """The valid candidate that a run of candidate characters cleans to; only a leading digit or chapter sign gives cleaning work."""
    if run[0] in "0123456789第":
        for pattern in _LEADING:
            run = pattern.sub("", run)
        run = _EDGES.sub("", run)
    fits = k.CANDIDATE_MIN <= len(run) <= k.CANDIDATE_MAX
    return run if fits and not _BARRED.search(run) and _NEEDED.search(run) else None


#: The patterns of ``clean_candidate``; white space is ASCII's, as in the JVM.
_ANY_OUTER = re.compile(re.sub(r"\\x\{(\w{4})\}", r"\\u\1", OUTER), re.ASCII)
_ANY_LEADING = [re.compile(p, re.ASCII) for p in (ENUMERATOR, NUMBER_PAIR, CHAPTER, r"[\s\u3000]+")]
_ANY_BLANKS = re.compile(BLANKS)


@lru_cache(maxsize=65536)
def term_of_text(text: str) -> str | None:
    """The valid candidate that any NFKC text cleans to: ``clean_candidate`` and ``valid_candidate`` inside a Python stage."""
    term = _ANY_OUTER.sub("", _ANY_BLANKS.sub(" ", text))
    for pattern in _ANY_LEADING:
        term = pattern.sub("", term)
    term = _EDGES.sub("", term)
    fits = k.CANDIDATE_MIN <= len(term) <= k.CANDIDATE_MAX
    return term if fits and not _BARRED.search(term) and _NEEDED.search(term) else None


def pattern_spans(sentence: str) -> list[tuple[int, int, str]]:
    """(start_char, end_char, term) of the pattern generator: ``candidate_spans`` inside a Python stage."""
    return [(*found.span(), term) for found in RUN.finditer(sentence) if (term := _term_of(found.group())) is not None]


@F.arrow_udf(_SPANS)
def _candidate_spans(sentences: pa.Array) -> pa.Array:
    offsets, starts, ends, terms = [0], [], [], []
    for sentence in sentences.to_pylist():
        for found in RUN.finditer(sentence or ""):
            term = _term_of(found.group())
            if term is not None:
                starts.append(found.start())
                ends.append(found.end())
                terms.append(term)
        offsets.append(len(starts))
    columns = [pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(terms, pa.string())]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, ["start_char", "end_char", "candidate"]))


def candidate_spans(sentence: Column) -> Column:
    """Array of (start_char, end_char, candidate) of the valid candidates of a sentence; none for null.

    Offsets refer to the raw run of candidate characters, not to the cleaned
    term. Spark has no expression for the places of a pattern's matches, and sums
    over the pieces inside a row copy them once per piece; so this is the second
    Arrow stage of the extraction, in time that grows with the text.
    """
    return _candidate_spans(sentence)


_INT = IntegerType()
_TERMS = StructType([StructField("term", StringType()), StructField("frequency", _INT), StructField("traits", _INT), StructField("page", _INT), StructField("pages", ArrayType(_INT)), StructField("seen", ArrayType(_INT)), StructField("sentence_idx", _INT), StructField("start_char", _INT), StructField("end_char", _INT)])
_PLACES = StructType([StructField("sentence_idx", _INT), StructField("start_char", _INT), StructField("end_char", _INT)])


def lists_of(rows: list[list], values: pa.Array | None = None, kind: pa.DataType = pa.int32()) -> pa.ListArray:
    """An array of lists; of ``values`` cut to their lengths, or of the rows' own."""
    offsets = [0]
    for row in rows:
        offsets.append(offsets[-1] + len(row))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values if values is not None else pa.array([x for row in rows for x in row], kind))


def _places(spans: list[tuple[int, int, int]]) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array([x[i] for x in spans], pa.int32()) for i in range(3)], _PLACES.fieldNames())


@lru_cache(maxsize=65536)
def _traits(term: str) -> int:
    """What the score looks for in a term, a bit for each, in the order of ``_traits_of``."""
    return (len(term) >= k.LONG_TERM) | bool(_TWO_KANJI.search(term)) << 1 | bool(_KATAKANA.search(term)) << 2 | any(hint in term for hint in k.HINTS) << 3


@lru_cache(maxsize=65536)
def term_score(term: str, frequency: int) -> float:
    """``heuristic_score`` inside a Python stage."""
    traits, score = _traits(term), k.SCORE_BASE
    for i, value in enumerate((k.SCORE_LONG, k.SCORE_KANJI, k.SCORE_KATAKANA, k.SCORE_HINT)):
        score += value if traits >> i & 1 else 0.0
    if frequency >= 2:
        score += min(k.SCORE_REPEAT, math.log2(frequency) * k.SCORE_REPEAT_STEP)
    return round(min(score, k.SCORE_CAP), 4)


def _grouped(records: pa.Array, every: bool) -> pa.Array:
    """For each document's (page, sentence) records its terms, in no order."""
    bounds = records.offsets.to_pylist()
    values = records.values.slice(bounds[0], bounds[-1] - bounds[0])
    sentences, pages = values.field("sentence").to_pylist(), values.field("page").to_pylist()
    documents, terms, places, of_pages, seen = [], [], [], [], []
    for low, high in zip(bounds, bounds[1:]):
        low, high = low - bounds[0], high - bounds[0]
        found: dict[str, list[tuple[int, int, int]]] = {}
        for index in range(low, high):
            for run in RUN.finditer(sentences[index]):
                term = _term_of(run.group())
                if term is not None:
                    place = (index - low, *run.span())
                    if term in found:
                        found[term].append(place)
                    else:
                        found[term] = [place]
        documents.append(found)
        for term, at in found.items():
            terms.append(term)
            places.append(at)
            first = at[0][0]
            if len(at) == 1:
                of_pages.append([] if pages[low + first] is None else [pages[low + first]])
                seen.append([first])
                continue
            at.sort(key=lambda p: (p[0], p[1] - p[2], p[1]))
            of_pages.append(sorted({pages[low + p[0]] for p in at} - {None}))
            shown: dict[str, int] = {}
            for p in at:
                shown.setdefault(sentences[low + p[0]], p[0])
                if len(shown) == k.MAX_EXAMPLES:
                    break
            seen.append(list(shown.values()))
    columns = [
        pa.array(terms, pa.string()),
        pa.array([len(at) for at in places], pa.int32()),
        pa.array([_traits(term) for term in terms], pa.int32()),
        pa.array([p[0] if p else None for p in of_pages], pa.int32()),
        lists_of(of_pages),
        lists_of(seen),
        *[pa.array([at[0][i] for at in places], pa.int32()) for i in range(3)],
    ]
    names = _TERMS.fieldNames()
    if every:
        columns.append(lists_of(places, _places([p for at in places for p in at])))
        names = [*names, "places"]
    return lists_of(documents, pa.StructArray.from_arrays(columns, names))


def _in_slices(records: pa.Array, every: bool, size: int = 256) -> pa.Array:
    """``_grouped`` for a few documents at a time, so that a batch never stands whole as Python objects."""
    return pa.concat_arrays([_grouped(records.slice(i, size), every) for i in range(0, max(len(records), 1), size)])


@F.arrow_udf(ArrayType(_TERMS))
def _document_terms(records: pa.Array) -> pa.Array:
    return _in_slices(records, False)


@F.arrow_udf(ArrayType(StructType([*_TERMS.fields, StructField("places", ArrayType(_PLACES))])))
def _document_terms_and_places(records: pa.Array) -> pa.Array:
    return _in_slices(records, True)


def document_terms(records: Column, places: bool = False) -> Column:
    """The terms of a document's array of (page, sentence), in no order.

    For each its frequency, pages, the sentences of its examples (``seen``, by
    number: the first three that differ), and its first place, by sentence, length
    (longest first) and start; with ``places`` all of them in that order.
    """
    return (_document_terms_and_places if places else _document_terms)(records)


def _traits_of(term: Column, hints: tuple[str, ...]) -> tuple[Column, ...]:
    """What the score looks for: length, two kanji, katakana, a domain word."""
    return F.length(term) >= k.LONG_TERM, term.rlike(k.TWO_KANJI), term.rlike(k.KATAKANA), term.rlike("|".join(hints))


def heuristic_score(term: Column, frequency: Column, hints: tuple[str, ...] = k.HINTS, traits: Column | None = None) -> Column:
    """Score of a term from its length, scripts, domain words and count in the document; ``traits`` has what ``_traits_of`` tells as bits, where it is known."""
    conditions = _traits_of(term, hints) if traits is None else tuple(traits.bitwiseAND(F.lit(1 << i)) != 0 for i in range(4))
    score = F.lit(k.SCORE_BASE)
    for condition, value in zip(conditions, (k.SCORE_LONG, k.SCORE_KANJI, k.SCORE_KATAKANA, k.SCORE_HINT)):
        score = score + F.when(condition, F.lit(value)).otherwise(F.lit(0.0))
    score = score + F.when(frequency >= 2, F.least(F.lit(k.SCORE_REPEAT), F.log2(frequency.cast("double")) * k.SCORE_REPEAT_STEP)).otherwise(F.lit(0.0))
    return F.round(F.least(score, F.lit(k.SCORE_CAP)), 4)


def group_tag(term: Column, hints: tuple[str, ...] = k.HINTS) -> Column:
    return F.when(term.isin(*hints), k.HINT_GROUP).otherwise(k.NEW_GROUP)


def csv_cell(value: Column) -> Column:
    """Quoted cell: null as empty, inner quotes doubled, formula signs made harmless."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    guarded = F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_line(*values: Column) -> Column:
    return F.concat_ws(",", *map(csv_cell, values))


def iso_time(moment: Column) -> Column:
    """ISO 8601 in UTC with milliseconds; null stays null."""
    return F.date_format(moment.cast("timestamp_ntz").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def short_name(name: Column) -> Column:
    """Names over 28 characters cut to 25 and an ellipsis; null gives ''."""
    text = F.coalesce(name, F.lit(""))
    return F.when(F.length(text) > 28, F.concat(F.substring(text, 1, 25), F.lit("…"))).otherwise(text)


def file_key(name: Column) -> Column:
    """What file names are compared by: NFKC, no white space, lower case."""
    return F.lower(F.regexp_replace(nfkc(F.coalesce(name, F.lit(""))), r"[\s\x{3000}]+", ""))


def same_file(a: Column, b: Column) -> Column:
    """Equal file keys, or one inside the other."""
    return (a == b) | F.contains(a, b) | F.contains(b, a)


def source_key(first_file: str, first_page: str) -> Column:
    """What terms are sorted by: their first file and its lowest page, eight digits wide; 999999 stands for no page."""
    return F.concat_ws("-", F.coalesce(F.col(first_file), F.lit("")), F.lpad(F.coalesce(F.col(first_page), F.lit(999999)).cast("string"), 8, "0"))


def score_band(score: Column) -> Column:
    return F.when(score >= 0.9, "high").when(score >= 0.75, "medium").otherwise("low")


def percent(score: Column) -> Column:
    return F.floor(score * 100 + 0.5).cast("int")


def evidence_text(example: Column, file: Column) -> Column:
    """An example without the file name that it may begin with."""
    lead = F.concat(file, F.lit(": "))
    return F.when(F.startswith(example, lead), F.substring(example, F.length(lead) + 1, F.length(example))).otherwise(example)


def highlighted(sentence: Column, term: Column) -> Column:
    """The sentence with every occurrence of the term between marks; an empty term marks nothing."""
    return F.when(F.length(term) > 0, F.replace(sentence, term, F.concat(F.lit("<mark>"), term, F.lit("</mark>")))).otherwise(sentence)


def mojibake_repaired(name: Column) -> Column:
    """A name whose UTF-8 was read as Latin-1, put right; kept where that gives no valid text."""
    narrow = name.rlike(r"^[\x00-\xff]*$")
    raw = F.encode(F.when(narrow, name), "ISO-8859-1").cast("string")
    return F.when(narrow & F.is_valid_utf8(raw), raw).otherwise(name)


def extension(name: Column) -> Column:
    """The lower-case extension with its dot, '' for none."""
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"[^/\\](\.[^./\\]*)$", 1))


def mime_type(ext: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in k.MIME_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, ext), F.lit(k.MIME_DEFAULT))


def is_uuid(value: Column) -> Column:
    return F.coalesce(value.rlike(k.UUID_PATTERN), F.lit(False))


def is_status(value: Column) -> Column:
    return F.coalesce(value.isin(*k.STATUSES), F.lit(False))


def status_label(status: Column) -> Column:
    """The key of a review status's label; any other value is shown as unreviewed."""
    return F.when(is_status(status), F.concat(status, F.lit("Status"))).otherwise("unreviewedStatus")


def uri_component(text: Column) -> Column:
    """Percent-encoded UTF-8; letters, digits and ``-_.!~*'()`` stay."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for sign in "!~'()":
        out = F.replace(out, F.lit(f"%{ord(sign):02X}"), F.lit(sign))
    return out


def local_date_time(moment: Column) -> Column:
    """yyyy/MM/dd HH:mm, a dash for null."""
    return F.coalesce(F.date_format(moment, "yyyy/MM/dd HH:mm"), F.lit("—"))
