"""Candidates from tagged words, and places where a tagger and a language model come in.

No model or tagger comes with this project; what is made of their output is here
and tested with deterministic ones in their place.
"""

from __future__ import annotations

import math
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from shirabe.functions import constants as k
from shirabe.functions import text as t
from shirabe.operators import extract

#: (sentence) -> ([(word, part of speech, start)], [(noun chunk, start)]), made once per Python worker.
Tagger = Callable[[str], tuple[list[tuple[str, str, int]], list[tuple[str, int]]]]
#: (sentences, terms) -> probabilities, called with batches, made once per Python worker.
Scorer = Callable[[list[str], list[str]], list[float]]
_LOADED: dict[str, object] = {}
_HIRAGANA = re.compile(k.ALL_HIRAGANA)
_CANDIDATE = StructType([StructField("start_char", IntegerType()), StructField("end_char", IntegerType()), StructField("term", StringType()), StructField("source", StringType())])
_KEPT = StructType([StructField("sentence_idx", IntegerType()), StructField("overlap_rank", IntegerType()), *_CANDIDATE.fields, StructField("raw_frequency", IntegerType()), StructField("score", DoubleType())])
#: Documents that stand as Python objects at a time.
SLICE = 256


def mode_of(model_dir: str | None) -> str:
    """``bert`` where a model's config.json is there and its libraries load, else ``demo``."""
    if not model_dir or not os.path.exists(os.path.join(model_dir, "config.json")):
        return "demo"
    try:
        import torch  # noqa: F401
        import transformers  # noqa: F401
    except ImportError:
        return "demo"
    return "bert"


def _loaded(name: str, load: Callable[[], object]) -> object:
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def compounds(words: list[tuple[str, str, int]]) -> Iterator[tuple[str, int, int]]:
    """(text, start_char, end_char) of the longest rows of words whose part of speech a term can have.

    Words wholly in hiragana end a row like any other part of speech.
    """
    row: list[str] = []
    first = end = 0
    for text, pos, start in words:
        if pos in k.TERM_POS and text is not None and not _HIRAGANA.search(text):
            if not row:
                first = start
            row.append(text)
            end = start + len(text)
        elif row:
            yield "".join(row), first, end
            row = []
    if row:
        yield "".join(row), first, end


def _generated(sentence: str, tag: Tagger | None) -> list[tuple[int, int, str, str]]:
    """(start_char, end_char, term, source) of a sentence's noun chunks and then its compounds; of the pattern generator where neither gives a valid term."""
    found = []
    if tag:
        words, chunks = tag(sentence)
        for text, start in chunks:
            if (term := t.term_of_text(text)) is not None:
                found.append((start, start + len(text), term, k.CHUNK_SOURCE))
        for text, start, end in compounds(words):
            if (term := t.term_of_text(text)) is not None:
                found.append((start, end, term, k.COMPOUND_SOURCE))
    return found or [(*span, k.REGEX_SOURCE) for span in t.pattern_spans(sentence)]


def _array(kind: StructType, groups: list[list], rows: list[tuple]) -> pa.Array:
    """``rows``, cut to the lengths of ``groups``, as lists of structs."""
    kinds = {IntegerType(): pa.int32(), StringType(): pa.string(), DoubleType(): pa.float64()}
    columns = [pa.array([r[i] for r in rows], kinds[f.dataType]) for i, f in enumerate(kind.fields)]
    return t.lists_of(groups, pa.StructArray.from_arrays(columns, kind.fieldNames()))


def tagged_candidates(sentences: DataFrame, load: Callable[[], Tagger], name: str, key: str = "doc_id") -> DataFrame:
    """Sentences with the candidates of two generators, noun chunks and compounds; a span that both give has two rows.

    Sentences that give no valid candidate fall back to the pattern generator.
    """

    @F.arrow_udf(ArrayType(_CANDIDATE, False))
    def run(batch: pa.Array) -> pa.Array:
        tag = _loaded(name, load)
        found = [_generated(x, tag) for x in batch.to_pylist()]
        return _array(_CANDIDATE, found, [span for spans in found for span in spans])

    return sentences.select(key, "sentence_idx", "page", "sentence", F.inline(run("sentence")))


def _distinct_kept(spans: list[tuple[int, int, str, str]], often: dict[str, int], score: Callable[[str], float], threshold: float) -> list[tuple]:
    """A sentence's candidates once each (the first one's source), from the threshold on, those that overlap none before them; as ``extract.resolve_overlaps``."""
    once: dict[tuple[int, int, str], str] = {}
    for start, end, term, source in spans:
        once.setdefault((start, end, term), source)
    rated = [(start, end, term, source, often[term], score(term)) for (start, end, term), source in once.items()]
    order = lambda s: (s[0] - s[1], -s[5] if s[5] == s[5] else math.inf, -s[4], s[0], s[1], s[2])
    kept: list[tuple] = []
    for s in sorted((s for s in rated if not s[5] < threshold), key=order):
        if not any(s[0] < o[1] and o[0] < s[1] and s[0] < s[1] and o[0] < o[1] for o in kept):
            kept.append(s)
    return kept


def _kept_spans(records: pa.Array, tag: Tagger | None, scorer: Scorer | None, threshold: float) -> pa.Array:
    """The kept spans of a few documents' (page, sentence) records. Each different sentence of these is tagged once, and a model gets the different (sentence, term) pairs at once."""
    bounds = records.offsets.to_pylist()
    texts = records.values.slice(bounds[0], bounds[-1] - bounds[0]).field("sentence").to_pylist()
    spans_of = {x: _generated(x, tag) for x in dict.fromkeys(texts)}
    documents = [texts[low - bounds[0] : high - bounds[0]] for low, high in zip(bounds, bounds[1:])]
    found = [[spans_of[x] for x in d] for d in documents]
    scores: dict[tuple[str, str], float] = {}
    if scorer:
        pairs = [(x, term) for x, spans in spans_of.items() for term in dict.fromkeys(s[2] for s in spans)]
        scores = {pair: round(float(x), 4) for pair, x in zip(pairs, scorer([x for x, _ in pairs], [term for _, term in pairs]) if pairs else ())}
    groups, rows = [], []
    for d, of in zip(documents, found):
        often = Counter(s[2] for spans in of for s in spans)
        first = len(rows)
        for i, (sentence, spans) in enumerate(zip(d, of)):
            score = (lambda term, x=sentence: scores[x, term]) if scorer else (lambda term: t.term_score(term, often[term]))
            rows += [(i, rank, *s) for rank, s in enumerate(_distinct_kept(spans, often, score, threshold))]
        groups.append(range(first, len(rows)))
    return _array(_KEPT, groups, rows)


def softmax(logits: list[float]) -> list[float]:
    top = max(logits)
    parts = [math.exp(x - top) for x in logits]
    return [p / sum(parts) for p in parts]


def extract_with(documents: DataFrame, threshold: float, tagger: tuple[Callable[[], Tagger], str] | None = None, scorer: tuple[Callable[[], Scorer], str] | None = None, key: str = "doc_id", sentences: bool = True) -> DataFrame:
    """The general extraction: any generator and scorer, duplicates and overlaps resolved, one row per kept span.

    A term is counted over all generated candidates of its document, before
    duplicates and the threshold; the heuristic scores by that count. All of it
    is in the document's row, so nothing is shuffled and each sentence is tagged
    once; a pair of sentence and term is scored once in 256 documents. With
    ``sentences`` the rows also have the span's page and sentence.
    """

    @F.arrow_udf(ArrayType(_KEPT, False))
    def run(records: pa.Array) -> pa.Array:
        tag = _loaded(*reversed(tagger)) if tagger else None
        score = _loaded(*reversed(scorer)) if scorer else None
        return pa.concat_arrays([_kept_spans(records.slice(i, SLICE), tag, score, threshold) for i in range(0, max(len(records), 1), SLICE)])

    found = extract.records(documents, key, "text").withColumn("_kept", run("_records"))
    if sentences:
        found = found.withColumn("_kept", F.transform("_kept", lambda x: x.withField("page", F.get("_records", x["sentence_idx"])["page"]).withField("sentence", F.get("_records", x["sentence_idx"])["sentence"])))
    # Outer, as else Spark asks for the size of the list before the Python stage that makes it.
    rows = found.select(key, F.explode_outer("_kept").alias("_s")).select(key, "_s.*").where(F.col("term").isNotNull())
    return rows.withColumn("group", t.group_tag(F.col("term")))
