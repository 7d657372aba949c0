"""Sentence units by semi-Markov dynamic programming over possible spans."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter, deque
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = " \t\r\n\v\f\x1c\x1d\x1e\x1f\x85\xa0                　﻿"
MARKER = regex.compile(r"\[\[PAGE\s+(\d+)\]\]")
CLOSERS = "」』）)\"”»’'］]】〉》｣"
#: A run of sentence marks with what closes after it. A full stop inside a word, a number or an address is none.
MARKS = regex.compile(rf"(?:[。｡！？!?।॥]|\.(?!\w|\.)|(?<![\dA-Za-zＡ-Ｚａ-ｚ])．|．(?![\dA-Za-zＡ-Ｚａ-ｚ]))+[{regex.escape(CLOSERS)}]*")
#: Without a match before the last character a text is one unit.
POSSIBLE = regex.compile(r"[。｡！？!?।॥．\n\r 　]|\.(?!\w)|[฀-๿][^฀-๿]* |\[\[PAGE")
THAI = regex.compile(r"[฀-๿]")
IDEOGRAPHIC = regex.compile(r"[぀-ヿ㐀-鿿\U00020000-\U0003ffff]")

# Abbreviations in lower case without their last full stop.
#: Something always follows these.
LEADING = frozenset(
    "mr mrs ms mx dr prof st sts no nos nr fig figs sec secs art arts ch vol pp p vs cf approx e.g eg i.e ie viz ver rev ed abb abs tab kap bzw ca z d u s zzgl inkl evtl ggf sog env ex av bd m mm mme mlle mgr gen col lt sgt capt hr fr frl hrn jan feb apr jun jul aug sep sept oct okt nov dec dez no.s n°".split()
)
#: These may end a sentence.
TRAILING = frozenset("p.m a.m pm am co ltd inc corp plc gmbh etc ave rd blvd str sq jr sr usw u.s u.k cie ltda कि.मी मि.मी से.मी रु डॉ मी".split())
MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember".split())
#: Words with which a text goes on after a closed quotation or bracket.
GOING_ON = tuple("と が の を に は で も や へ か から まで より って という など 、 ， ､ , ・ ： : ； ; …".split())
_NAME_AFTER = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}々ヶ]{1,3}(?:氏|様|さん|殿|君|先生|係長|課長|主任|班長|駅長|助役|部長|社長)(?:[のはがをにへとで、，､（）()]|$)")
_LIST_MARK = regex.compile(r"[(（]?\s*(?:\d{1,3}|[A-Za-z]|[ivxIVX]{1,4})\s*[.)）．:]|[-–—・*•■●○◆□]+")

FORCED = 5.0
WEAKEST = -6.0


def _token_before(text: str, at: int) -> str:
    """The word before a full stop at ``at``, with full stops inside it."""
    low = at
    while low and not text[low - 1].isspace() and text[low - 1] not in "(（「『“„\"«[【、，,；;：:/":
        low -= 1
        if at - low > 24:
            break
    return text[low:at]


def _next_word(text: str, at: int) -> tuple[str, bool]:
    """The word after ``at`` and whether white space comes first."""
    low = at
    n = len(text)
    while low < n and text[low] in BLANK:
        low += 1
    high = low
    while high < n and high - low < 24 and text[high] not in BLANK:
        high += 1
    return text[low:high], low > at


def _mark_score(text: str, found: regex.Match) -> float:
    """How far the marks and words around a possible end speak for an end."""
    run = found.group()
    marks = run.rstrip(CLOSERS)
    closed = len(run) > len(marks)
    word, spaced = _next_word(text, found.end())
    if not word:
        return FORCED
    first = word[0]
    last = marks[-1]
    if closed:
        if word.startswith(GOING_ON) or first.islower():
            return -7.0
        if not spaced and not text[found.end()] in "\n":
            return -7.0 if run[len(marks)] not in "）)］]】" else -4.5
        bare = word.lstrip("(（「『“„\"«[")
        return 4.0 if bare and (bare[0].isupper() or bare[0].isdigit() or IDEOGRAPHIC.match(bare[0])) else -3.0
    if last in "。｡．！？।॥":
        if last == "．":
            token = _token_before(text, found.start()).lower()
            ascii_token = regex.search(r"[a-zａ-ｚ.]+$", token)
            if ascii_token and ascii_token.group() in LEADING | TRAILING:
                return -7.0
        if first in "、，､,」』）)":
            return -7.0
        return 6.0
    if last in "!?":
        if first.islower():
            return -4.0
        return 6.0 if spaced else 0.0
    token = _token_before(text, found.start())
    low = token.lower()
    if text[found.start() - len(token) - 1 : found.start() - len(token)] == "/":  # a unit, as in km/h
        low = token = "/" + token
    if len(marks) > 1:  # an ellipsis
        return -4.0 if first.islower() else 2.0
    if not spaced:
        return -5.0
    tail = regex.search(r"[^\d\s().]+(?:\.[^\d\s().]+)*$", low)
    short = tail.group() if tail and token[0] != "/" else ""
    bare = word.lstrip("(（「『“„\"«[")
    opening = bool(bare) and (bare[0].isupper() or bare[0].isdigit() or word[0] in "\"“„«「『")
    if low in LEADING or short in LEADING:
        return -7.0
    if low in TRAILING or short in TRAILING:
        if bare.lower().rstrip(".,") in TRAILING:
            return -7.0
        if IDEOGRAPHIC.match(first):
            return -6.0
        if regex.match(r"[ऀ-ॿ]", token[-1:]):
            return -5.0
        return 2.0 if opening and not bare[0].isdigit() else -5.0
    if len(token) == 1 and token.islower():
        return -7.0
    if len(token) == 1 and token.isalpha() and token.isupper() and not regex.search(r"\d\s$", text[max(0, found.start() - 3) : found.start() - 1]):
        return -2.0
    if token.isdigit() and len(token) <= 2 and (bare.lower().rstrip(".,;:") in MONTHS):
        return -7.0
    if first.islower():
        return -5.0
    return 5.0 if opening else 3.0


def _depths(text: str) -> list[tuple[int, int]]:
    """(start, end) of the outermost quotations and brackets that open and close in ``text``."""
    pairs = {"」": "「", "』": "『", "）": "（", ")": "(", "”": "“", "»": "«", "］": "［", "]": "[", "】": "【", "》": "《", "〉": "〈", "｣": "｢"}
    opens = frozenset(pairs.values()) | {"„"}
    stack: list[tuple[str, int]] = []
    held: Counter[str] = Counter()
    spans: list[tuple[int, int]] = []
    for m in _BRACKET.finditer(text):
        c, at = m.group(), m.start()
        if c == '"' and held['"']:
            want = '"'
        elif c == "“" and held["„"] or c == "”" and not held["“"]:
            want = "„"
        elif c == '"' or c in opens:
            stack.append((c, at))
            held[c] += 1
            continue
        else:
            want = pairs[c]
        while held[want]:  # those that are left open in between close nothing
            opened, start = stack.pop()
            held[opened] -= 1
            if opened == want:
                spans.append((start, at))
                break
    spans.sort()
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if not out or a > out[-1][1]:
            out.append((a, b))
    return out


_BRACKET = regex.compile(r"[「」『』（）()“”„\"«»［］\[\]【】《》〈〉｢｣]")


class _Quoted:
    """Which places of a text lie inside its outermost quotations and brackets."""

    def __init__(self, text: str):
        self.pairs = _depths(text)
        self.starts = [a for a, _ in self.pairs]

    def holds(self, at: int) -> bool:
        """Whether a cut at ``at`` would part what opens before it from what closes after it."""
        k = bisect_left(self.starts, at) - 1
        return k >= 0 and self.pairs[k][1] >= at


def _marked_ends(text: str) -> list[tuple[int, float]]:
    """(position, score) of the possible ends at sentence marks of a block."""
    return [(m.end(), _mark_score(text, m)) for m in MARKS.finditer(text)]


def _clear_ends(text: str, ends: list[tuple[int, float]], least: float) -> set[int]:
    """Those of a block's ends that score so much and lie in no quotation."""
    found = [at for at, s in ends if s >= least]
    quoted = _Quoted(text) if found else None
    return {at for at in found if not quoted.holds(at)}


#: A span pays for its length beyond this, by so much for a character.
LONG, PER_CHAR = 300, 0.002
#: What a break inside a line's width and a cut after a full line cost in a document of fixed width.
SHORT_LINE, FULL_LINE, LIST_MARK = 12.0, 8.0, 9.0
#: What an edge inside a quotation costs the span on either side of it.
UNBALANCED = 7.0


def _best_spans(text: str, ends: list[tuple[int, float]], width: int, wide: bool) -> list[tuple[int, int]]:
    """The best row of spans that covers ``text``.

    A span earns the score of its end, and loses for each of its edges that lies
    inside a quotation or bracket which it thus does not hold whole, for being a
    bare list mark, very short or very long, and for line breaks that do not fit
    the document's line width. ``ends`` has the possible ends inside ``text`` in
    order.

    Every span is weighed, none is left out. For spans of more than ``near``
    characters all that they lose is a sum of a part of their start and a part
    of their end, so the best start of these is a running maximum; time grows
    with the number of ends times the ends within ``near`` characters.
    """
    n = len(text)
    points = [0] + [at for at, s in ends if s > WEAKEST and at < n] + [n]
    scores = [0.0] + [s for at, s in ends if s > WEAKEST and at < n] + [0.0]
    count = len(points)
    quoted = _Quoted(text)
    torn = [UNBALANCED if 0 < at < n and quoted.holds(at) else 0.0 for at in points] if quoted.pairs else [0.0] * count
    starts, stops = _bare_edges(text, points)
    near = max(LONG, width + 30)
    lines = _Lines(text, points, starts, ends, quoted, width, wide)
    best = [0.0] + [float("-inf")] * (count - 1)
    back = [0] * count
    ahead = [0.0] * count  # of a start that is far: what its spans earn and lose by it
    far = broken = 0  # starts before ``far`` are far; those before ``broken`` have a line break between
    over, over_from = float("-inf"), 0  # the best far start with a line break between
    same: deque[int] = deque()  # far starts in the same line, best first
    for j in range(1, count):
        inside = lines.before[j]
        tail = lines.tail(j)
        for i in range(j - 1, -1, -1):
            size = stops[j] - starts[i]
            if size > near:
                break
            score = best[i] - torn[i] + scores[j] - torn[j]
            if size < 8 and (size <= 0 or _LIST_MARK.fullmatch(text, starts[i], stops[j])):
                score -= LIST_MARK
            elif size > LONG:
                score -= (size - LONG) * PER_CHAR
            if lines.breaks:
                first = lines.first[i]
                score -= lines.head[i] + lines.sums[inside] - lines.sums[first + 1] + tail if first < inside else lines.end(j, min(starts[i], points[j]))
            if score > best[j]:
                best[j], back[j] = score, i
        while far < j and stops[j] - starts[far] > near:
            ahead[far] = best[far] - torn[far] + starts[far] * PER_CHAR
            while same and ahead[same[-1]] <= ahead[far]:
                same.pop()
            same.append(far)
            far += 1
        while broken < far and lines.first[broken] < inside:
            value = ahead[broken] - lines.head[broken] + lines.sums[lines.first[broken] + 1]
            if value >= over:
                over, over_from = value, broken
            broken += 1
        while same and same[0] < broken:
            same.popleft()
        ended = scores[j] - torn[j] - (stops[j] - LONG) * PER_CHAR
        if same and (score := ahead[same[0]] + ended - lines.end(j, starts[same[0]])) > best[j]:
            best[j], back[j] = score, same[0]
        if broken and (score := over + ended - lines.sums[inside] - tail) > best[j]:
            best[j], back[j] = score, over_from
    out = []
    j = count - 1
    while j:
        out.append((points[back[j]], points[j]))
        j = back[j]
    return out[::-1]


def _bare_edges(text: str, points: list[int]) -> tuple[list[int], list[int]]:
    """For each point the first place from it on, and the last place before it, that is no blank."""
    starts, stops = [len(text)] * len(points), [0] * len(points)
    for i in range(len(points) - 2, -1, -1):
        at = points[i]
        while at < points[i + 1] and text[at] in BLANK:
            at += 1
        starts[i] = at if at < points[i + 1] else starts[i + 1]
    for j in range(1, len(points)):
        at = points[j]
        while at > points[j - 1] and text[at - 1] in BLANK:
            at -= 1
        stops[j] = at if at > points[j - 1] else stops[j - 1]
    return starts, stops


class _Lines:
    """What spans lose for line breaks in a document of fixed width; without a width nothing.

    breaks: their places; first: of each point, the first break from its start
    on; before: how many breaks lie before the last character up to a point;
    head: the loss of a start whose line ends too early; sums: the running loss of
    whole lines.
    """

    def __init__(self, text: str, points: list[int], starts: list[int], ends: list[tuple[int, float]], quoted: _Quoted, width: int, wide: bool):
        self.text, self.points, self.width, self.wide = text, points, width, wide
        self.breaks = [i for i, c in enumerate(text) if c == "\n"] if width else []
        breaks, zero = self.breaks, [0.0] * len(points)
        self.first, self.before, self.head, self.sums = [0] * len(points), [0] * len(points), zero, [0.0] * (len(breaks) + 2)
        if not breaks:
            return
        self.ended = {at for at, s in ends if s >= 3.0 and text[at - 1] != "\n" and not quoted.holds(at)}
        self.first = [bisect_left(breaks, at) for at in starts]
        self.before = [bisect_left(breaks, at - 1) for at in points]
        lost = lambda start, at: 0.0 if _fits(text, start, at, width, wide) else SHORT_LINE
        self.head = [lost(at, breaks[k]) if k < len(breaks) else 0.0 for at, k in zip(starts, self.first)]
        for k in range(1, len(breaks)):
            self.sums[k + 1] = self.sums[k] + lost(breaks[k - 1] + 1, breaks[k])
        self.sums[len(breaks) + 1] = self.sums[len(breaks)]

    def end(self, j: int, start: int) -> float:
        """Loss of a span for ending at a break after a full line that began at ``start``."""
        at = self.points[j] - 1
        if not self.breaks or self.text[at] != "\n" or at in self.ended:
            return 0.0
        return FULL_LINE if _fits(self.text, start, at, self.width, self.wide) else 0.0

    def tail(self, j: int) -> float:
        """``end`` of a span that holds the break before its last line."""
        return self.end(j, self.breaks[self.before[j] - 1] + 1) if self.before[j] else 0.0


def _fits(text: str, start: int, at: int, width: int, wide: bool) -> bool:
    """Whether a line from ``start`` that breaks at ``at`` is full; it may run over where a value is not to be broken."""
    size = at - start
    if wide:
        return size >= width - 1
    return size + 1 + len(_next_word(text, at)[0]) > width


def _line_width(blocks: list[str], wide: bool) -> int:
    """The width at which a document breaks its sentences, 0 for none.

    It is the least length of a piece that breaks off in mid-sentence and goes
    on to a sentence mark, such that no unbroken piece is much longer.
    """
    broken: list[int] = []
    longest = 0
    for block in blocks:
        ends = _clear_ends(block, _marked_ends(block), 2.0)
        cuts = sorted({*ends, *[i + 1 for i, c in enumerate(block) if c == "\n"], len(block)})
        start = 0
        for cut in cuts:
            at_break = block[cut - 1 : cut] == "\n"
            size = len(block[start:cut].strip(BLANK))
            if at_break and size and cut - 1 not in ends and _sentence_follows(block, cut):
                broken.append(size)
            else:
                longest = max(longest, size)
            start = cut
    slack = 2 if wide else 12  # a last mark or word may hang over the edge
    return min((w for w in broken if w >= (24 if wide else 40) and longest <= w + slack), default=0)


def _sentence_follows(block: str, at: int) -> bool:
    """Whether the line after a break has a sentence mark or is itself broken off late."""
    end = block.find("\n", at)
    end = len(block) if end < 0 else end
    return end - at >= 38 or bool(MARKS.search(block[at:end]))


def units(text: str | None, documents: bool = True) -> list[tuple[int, int, int]]:
    """(start, end, page) of the sentence units of a text, in order.

    Offsets are code points of ``text``, the end exclusive. ``page`` is that of
    the last page marker before the unit, 0 for none. Null, empty and blank texts
    have no units. ``documents`` says that lines may break at a fixed width and
    that page-marker lines may occur.
    """
    if not text:
        return []
    if not documents or "\n" not in text:
        size = len(text.rstrip(BLANK))
        start = len(text) - len(text.lstrip(BLANK))
        if start >= size:
            return []
        if not POSSIBLE.search(text, start, size - 1):
            whole = MARKER.fullmatch(text, start, size)
            return [] if whole else [(start, size, 0)]
    lines: list[tuple[int, int]] = []  # of each content line; (0, 0) for an empty one; (-1, page) for a marker
    at = 0
    for raw in text.split("\n"):
        line = raw.strip(BLANK)
        if not line:
            lines.append((0, 0))
        elif line.startswith("[[PAGE") and (m := MARKER.fullmatch(line)):
            lines.append((-1, min(int(m.group(1)), 2**31 - 1)))
        else:
            low = at + len(raw) - len(raw.lstrip(BLANK))
            lines.append((low, low + len(line)))
        at += len(raw) + 1
    wide = bool(IDEOGRAPHIC.search(text))
    width = 0
    if documents and len(lines) > 1:
        width = _line_width(["\n".join(text[a:b] for a, b, _ in block) for block in _blocks(lines)], wide)
    blocks = _blocks(lines) if width else [[(a, b, page)] for block in _blocks(lines) for a, b, page in block]
    bodies = ["\n".join(text[a:b] for a, b, _ in block) for block in blocks]
    ends = [_marked_ends(body) for body in bodies]
    blanks = _blank_mode(text, bodies, ends)
    out: list[tuple[int, int, int]] = []
    for block, body, found in zip(blocks, bodies, ends):
        if blanks:
            found = sorted(found + _blank_ends(body, blanks))
        if "\n" in body:
            found = sorted(found + [(i + 1, 4.0) for i, c in enumerate(body) if c == "\n"])
        if not found:
            out.append((block[0][0], block[-1][1], block[0][2]))
            continue
        firsts, total = [], 0
        for a, b, _ in block:
            firsts.append(total)
            total += b - a + 1
        for low, high in _best_spans(body, found, width, wide):
            piece = body[low:high]
            low += len(piece) - len(piece.lstrip(BLANK))
            high = low + len(piece.strip(BLANK))
            if low < high:
                k, e = bisect_right(firsts, low) - 1, bisect_right(firsts, high - 1) - 1
                out.append((block[k][0] + low - firsts[k], block[e][0] + high - firsts[e], block[k][2]))
    return out


def _blocks(lines: list[tuple[int, int]]) -> list[list[tuple[int, int, int]]]:
    """Runs of content lines (start, end, page) without an empty line between them."""
    out: list[list[tuple[int, int, int]]] = []
    page, open_ = 0, False
    for a, b in lines:
        if a < 0:
            page = b
        elif a == b:
            open_ = False
        elif open_:
            out[-1].append((a, b, page))
        else:
            out.append([(a, b, page)])
            open_ = True
    return out


def _blank_mode(text: str, bodies: list[str], ends: list[list[tuple[int, float]]]) -> str:
    """The blank that ends units in a text without sentence marks: '' for none."""
    if any(found and _clear_ends(body, found, 3.0) for body, found in zip(bodies, ends)):
        return ""
    if THAI.search(text):
        return " "
    return "　" if "　" in text else ""


def _blank_ends(body: str, blank: str) -> list[tuple[int, float]]:
    inside = _depths(body)
    firsts = [a for a, _ in inside]
    out = []
    for m in regex.finditer(r"[\s]+" if blank == " " else "　+", body):
        k = bisect_left(firsts, m.start()) - 1
        if (k >= 0 and m.start() < inside[k][1]) or (blank != " " and _NAME_AFTER.match(body, m.end())):
            continue
        out.append((m.end(), 6.0))
    return out


_OUT = "record_id string, page_number int, start_char int, end_char int"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["record_id", "page_number", "start_char", "end_char"])


def document_units(documents: DataFrame) -> DataFrame:
    """(record_id, page_number, start_char, end_char) of the units of documents (id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _frame([(i, page, s, e) for i, text in zip(b["id"], b["text"]) for s, e, page in units(text)])

    return documents.select("id", "text").where("text IS NOT NULL AND text <> ''").mapInPandas(run, _OUT)


def occurrence_units(occurrences: DataFrame) -> DataFrame:
    """The units of occurrences (id, page_number, sentence_text); rows delivered twice count once, a null page is 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pages = b["page_number"].fillna(0).astype("int64")
            yield _frame([(i, page, s, e) for i, page, text in zip(b["id"], pages, b["sentence_text"]) for s, e, _ in units(text, False)])

    rows = occurrences.select("id", F.col("page_number").cast("int"), "sentence_text").where("sentence_text IS NOT NULL AND sentence_text <> ''")
    return rows.mapInPandas(run, _OUT).distinct()


def sentence_units(documents: DataFrame, occurrences: DataFrame) -> DataFrame:
    """The units of both tables."""
    return document_units(documents).unionByName(occurrence_units(occurrences))
