import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shirabe.llm import sentences as s


def cut(text, documents=True):
    return [text[a:b] for a, b, _ in s.units(text, documents)]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("一つ目。二つ目！三つ目？四つ目", ["一つ目。", "二つ目！", "三つ目？", "四つ目"]),
        ("係員は「正常です。以上。」と答えた。次。", ["係員は「正常です。以上。」と答えた。", "次。"]),
        ("温度は1.5℃（平常時は2.0℃である。）が下がった。", ["温度は1.5℃（平常時は2.0℃である。）が下がった。"]),
        ("仕様書 No．５４ の Ver．２では定める．次は２０２０．５．１に行う．", ["仕様書 No．５４ の Ver．２では定める．", "次は２０２０．５．１に行う．"]),
        ("Mr. Hall came at 5 p.m. The shop, e.g. ours, was shut. Why?", ["Mr. Hall came at 5 p.m.", "The shop, e.g. ours, was shut.", "Why?"]),
        ('He said, "Stop it. Now." and left. "Go." was all.', ['He said, "Stop it. Now." and left.', '"Go." was all.']),
        ("Works Co. Ltd. delivered 3 sets. No. 5 fits approx. 2 mm.", ["Works Co. Ltd. delivered 3 sets.", "No. 5 fits approx. 2 mm."]),
        ("Am 13. Mai war z. B. Frost. Die Spannung beträgt 2.98 V. Gut.", ["Am 13. Mai war z. B. Frost.", "Die Spannung beträgt 2.98 V.", "Gut."]),
        ("Er sagte: „Halt. Weg.“ und ging. Ende.", ["Er sagte: „Halt. Weg.“ und ging.", "Ende."]),
        ("Ne touchez pas ! Le chef a dit : « Non. Jamais. » puis rien.", ["Ne touchez pas !", "Le chef a dit : « Non. Jamais. » puis rien."]),
        ("गति 7 कि.मी. तक है। क्या यह ठीक है?", ["गति 7 कि.मी. तक है।", "क्या यह ठीक है?"]),
        ("他说：“停用。不要启动。”随后离开。好！", ["他说：“停用。不要启动。”随后离开。", "好！"]),
        ("อุปกรณ์A1มีค่า2 ทดสอบB2\nแรงดัน", ["อุปกรณ์A1มีค่า2", "ทดสอบB2", "แรงดัน"]),
        ("点検した　次を確認した　終了", ["点検した", "次を確認した", "終了"]),
        ("1. First thing\n2. Second thing\n・項目", ["1. First thing", "2. Second thing", "・項目"]),
        ("Speed is 7 km/h. Next is 8 km/h.", ["Speed is 7 km/h.", "Next is 8 km/h."]),
        ("wait...  unless closed. Fine... Next.", ["wait...  unless closed.", "Fine...", "Next."]),
        ("送付先はａ＠ｅｘａｍｐｌｅ．ｊｐである。次。", ["送付先はａ＠ｅｘａｍｐｌｅ．ｊｐである。", "次。"]),
    ],
)
def test_units(text, wanted):
    assert cut(text) == wanted


def test_pages_layout_and_offsets():
    text = "﻿見出し\r\n[[PAGE 4]]\r\n 一。二。 \r\n\r\n[[PAGE 5]]\n　三"
    assert [(text[a:b], p) for a, b, p in s.units(text)] == [("見出し", 0), ("一。", 4), ("二。", 4), ("三", 5)]
    for blank in (None, "", " \n　", "﻿", "[[PAGE 1]]", "\n[[PAGE 1]]\n"):
        assert s.units(blank) == []


def test_fixed_width():
    lines = "章\n\n" + "あ" * 37 + "い\nうえお。短い。" + "か" * 38 + "\n[[PAGE 2]]\nき。\n次の行。"
    got = [(lines[a:b], p) for a, b, p in s.units("[[PAGE 1]]\n" + lines)]
    whole = "[[PAGE 1]]\n" + lines
    got = [(whole[a:b], p) for a, b, p in s.units(whole)]
    assert got == [("章", 1), ("あ" * 37 + "い\nうえお。", 1), ("短い。", 1), ("か" * 38 + "\n[[PAGE 2]]\nき。", 1), ("次の行。", 2)]
    assert cut("あ" * 38 + "\nうえ。", documents=False) == ["あ" * 38, "うえ。"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="あいA b.。！!?」「()\n　﻿1[]…\"、๏กข", max_size=60))
def test_units_cover_the_text_once(text):
    got = s.units(text)
    assert all(a < b and text[a] not in s.BLANK and text[b - 1] not in s.BLANK for a, b, _ in got)
    assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))
    covered = set().union(*[range(a, b) for a, b, _ in got]) if got else set()
    assert all(c in s.BLANK for i, c in enumerate(text) if i not in covered)


def test_long_text_is_quick():
    assert len(s.units("短い文です。" * 20000)) == 20000
    assert len(s.units("a" * 300000)) == 1


def test_tables(spark):
    docs = spark.createDataFrame([("d", "一。二。", 5), ("e", None, 1), ("f", "", 1)], "id string, text string, page_number int")
    occ = spark.createDataFrame([("o", 3, "文。"), ("o", 3, "文。"), ("p", None, " 一\n二 "), ("q", 1, None)], "id string, page_number int, sentence_text string")
    got = {tuple(r) for r in s.sentence_units(docs, occ).collect()}
    assert got == {("d", 0, 0, 2), ("d", 0, 2, 4), ("o", 3, 0, 2), ("p", 0, 1, 2), ("p", 0, 3, 4)}
    assert s.sentence_units(docs.limit(0), occ.limit(0)).count() == 0


def slow_spans(text, ends, width, wide):
    """The best spans by weighing each of them on its own."""
    points = [0] + [at for at, x in ends if x > s.WEAKEST and at < len(text)] + [len(text)]
    scores = dict(ends) | {len(text): 0.0}
    quoted = s._Quoted(text)
    breaks = [i for i, c in enumerate(text) if c == "\n"] if width else []
    ended = {at for at, x in ends if x >= 3.0 and text[at - 1] != "\n" and not quoted.holds(at)}

    def worth(low, high):
        piece = text[low:high].strip(s.BLANK)
        score = scores[high] - sum(s.UNBALANCED for at in (low, high) if 0 < at < len(text) and quoted.holds(at))
        if len(piece) < 8 and (not piece or s._LIST_MARK.fullmatch(piece)):
            score -= s.LIST_MARK
        elif len(piece) > s.LONG:
            score -= (len(piece) - s.LONG) * s.PER_CHAR
        if not breaks:
            return score
        start = low + len(text[low:high]) - len(text[low:high].lstrip(s.BLANK))
        for at in (b for b in breaks if start <= b < high - 1):
            score -= 0.0 if s._fits(text, start, at, width, wide) else s.SHORT_LINE
            start = at + 1
        if text[high - 1] == "\n" and high - 1 not in ended and s._fits(text, start, high - 1, width, wide):
            score -= s.FULL_LINE
        return score

    best = {0: 0.0}
    for j in range(1, len(points)):
        best[points[j]] = max(best[i] + worth(i, points[j]) for i in points[:j])
    return best[len(text)], worth


def test_every_span_is_weighed():
    random.seed(4)
    parts = ["あいうえおかきくけこ", "。", "\n", "「", "」", "(1) ", "第三条 ", "線路" * 45, "！", "\n\n"]
    for k in range(150):
        text = "".join(random.choice(parts) for _ in range(random.randint(2, 60))).strip() or "x"
        width = random.choice([0, 10, 24])
        ends = sorted(dict(s._marked_ends(text) + [(i + 1, 4.0) for i, c in enumerate(text) if c == "\n"]).items())
        spans = s._best_spans(text, ends, width, True)
        most, worth = slow_spans(text, ends, width, True)
        assert [a for a, _ in spans] + [len(text)] == [0] + [b for _, b in spans]
        assert abs(sum(worth(a, b) for a, b in spans) - most) < 1e-6


def test_long_texts_take_time_by_their_length():
    random.seed(5)
    body = "".join(random.choice(["列車は駅を出発した。", "信号を確認し、進路を開通させること。", "「止めろ。動くな。」と述べた。"]) for _ in range(30000))
    fixed = "\n".join(body[i : i + 40] for i in range(0, len(body), 40))
    begun = time.process_time()
    assert len(s.units(fixed)) > 20000
    for text in ("あ。" * 100000, "abc\n" * 50000, "(" * 100000 + '"a" ' * 20000, "「あ。" * 30000, "ไทย " * 50000):
        s.units(text)
    assert time.process_time() - begun < 30
