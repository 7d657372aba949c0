import pytest
from hypothesis import given
from hypothesis import strategies as st

from shirabe.llm import pii


def found(text):
    return [(k, text[a:b]) for k, a, b in pii.find(text)]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("担当者：梢戸森（a_b1@ops.invalid）まで", [("person", "梢戸森"), ("email", "a_b1@ops.invalid")]),
        ("議事録はx.y [at] mail [dot] example [dot] orgへ", [("email", "x.y [at] mail [dot] example [dot] org")]),
        ("ｋｓａｗａ２＠ｅｘａｍｐｌｅ．ｊｐ）", [("email", "ｋｓａｗａ２＠ｅｘａｍｐｌｅ．ｊｐ")]),
        ("write to a@b.example. Next", [("email", "a@b.example")]),
        ("定格は140kVA@636Hzである", []),
        ("夜間連絡先は03(0365)6744（楓立野梨央係長）とする", [("phone", "03(0365)6744"), ("person", "楓立野梨央")]),
        ("折り返し０８０－０９６２－９４３６へ", [("phone", "０８０－０９６２－９４３６")]),
        ("Ring me on (415) 555-0140.\" was", [("phone", "(415) 555-0140")]),
        ("appelez le 01.99.00.95.67. La rame", [("phone", "01.99.00.95.67")]),
        ("郗云岫女士的电话是100-0873-1392。", [("person", "郗云岫"), ("phone", "100-0873-1392")]),
        ("管理番号05-0928-2792の分岐器、製造番号094088932153", []),
        ("個人番号0046-5300-8214を、社員番号第９４８７００６６２８９４号）", [("id_number", "0046-5300-8214"), ("id_number", "第９４８７００６６２８９４号")]),
        ("Employee ID E-201704 belongs to driver Jorwin Wexcombe.", [("id_number", "E-201704"), ("person", "Jorwin Wexcombe")]),
        ("新住所は〒983-0062 西峯府榎野市新地8丁目27番8号 ハイツ汐風105号室である", [("address", "〒983-0062 西峯府榎野市新地8丁目27番8号 ハイツ汐風105号室")]),
        ("请将资料寄往碧岚省鸢湖市汐见路44号5栋505室，收件人岑清禾先生。", [("address", "碧岚省鸢湖市汐见路44号5栋505室"), ("person", "岑清禾")]),
        ("went to Mrs. Marrabel, 52 Tallow Ave., Coldmere Z6 9QX.", [("person", "Marrabel"), ("address", "52 Tallow Ave., Coldmere Z6 9QX")]),
        ("an Frau R. Vogt, Lindwerther Str. 58, 00952 Tiefenrode.", [("person", "R. Vogt"), ("address", "Lindwerther Str. 58, 00952 Tiefenrode")]),
        ("chez Mme Delvaque, 158, chemin du Vallorne, 00030 Aubrisse.", [("person", "Delvaque"), ("address", "158, chemin du Vallorne, 00030 Aubrisse")]),
        ("遺失物の受取人汐ヶ浜　琉生様へ、仕様書", [("person", "汐ヶ浜　琉生")]),
        ("「菱目里詩乃と申します。", [("person", "菱目里詩乃")]),
        ("榎目里駅の仕様を審議し、お客様と渚代橋駅長へ伝えた。", []),
    ],
)
def test_find(text, wanted):
    assert found(text) == wanted


def test_nothing():
    assert pii.find(None) == pii.find("") == []


@given(st.text(alphabet="0123456789", min_size=1, max_size=24))
def test_digits_round_trip(value):
    cipher = pii.FormatPreserving(b"k")
    new = cipher.digits(value)
    assert len(new) == len(value) and new.isdigit() and cipher.digits(new, back=True) == value


def test_permutation():
    cipher = pii.FormatPreserving(b"k")
    assert len({cipher.digits(f"{i:03d}") for i in range(1000)}) == 1000
    assert cipher.undo(cipher.value("EM-0046 5300")) == "EM-0046 5300"
    assert pii.FormatPreserving(b"j").digits("123456") != cipher.digits("123456")


def test_check_digits_stay_right_or_wrong():
    cipher = pii.FormatPreserving(b"k")
    assert pii.individual_check("12345678901") == 8 and pii._CN_SIGNS[pii.resident_check("11010519491231002")] == "X"
    seen = set()
    for i in range(300):
        payload = f"{i * 334214459:011d}"[-11:]
        check = pii.individual_check(payload)
        new = cipher.identity(f"{payload[:4]}-{payload[4:8]}-{payload[8:]}{check}")
        bare = new.replace("-", "")
        assert int(bare[11]) == pii.individual_check(bare[:11]) and new[4] == new[9] == "-"
        assert cipher.identity(payload + str(check)) == bare and cipher.identity(new, back=True).replace("-", "") == payload + str(check)
        wrong = cipher.identity(payload + str((check + 3) % 10))
        assert int(wrong[11]) != pii.individual_check(wrong[:11])
        seen.add(bare)
    assert len(seen) == 300
    for number in ("11010519491231002X", "110105199902300021"):  # the second has no such day
        new = cipher.identity(number)
        right = lambda x: pii._CN_SIGNS[pii.resident_check(x[:17])] == x[17]
        assert new != number and new[:2] == "11" and cipher.identity(new, back=True) == number and right(new) == right(number)
        assert (pii._ordinal(int(new[6:10]), int(new[10:12]), int(new[12:14])) is None) == (number[10:14] == "0230")


def test_one_number_in_several_notations():
    cipher = pii.FormatPreserving(b"k")
    plain = lambda t: "".join(c for c in t if c.isdigit())
    new = cipher.phone("090-1234-5678")
    assert new[:4] == "090-" and new != "090-1234-5678" and cipher.phone("０９０（１２３４）５６７８") == f"090({new[4:8]}){new[9:]}"
    assert cipher.phone("+81-90-1234-5678") == "+81-" + new[1:] and plain(cipher.phone("+81 (0)90 1234 5678")) == "81" + plain(new)
    assert cipher.phone("03-1234-5678").startswith("03-") and cipher.phone("(415) 555-0140")[1] == "4"
    assert plain(cipher.phone("+1 415 555 0140")) == "1" + plain(cipher.phone("(415) 555-0140")) == plain(cipher.phone("1-415-555-0140"))
    for text in ("090-1234-5678", "+81-90-1234-5678", "+49 (0) 89 123456", "01.99.00.95.67", "13912345678", "+999 12345678"):
        assert cipher.phone(cipher.phone(text), back=True) == text


def test_letters_are_part_of_the_permutation():
    cipher = pii.FormatPreserving(b"k")
    new = {cipher.value(f"{a}{b}-{n}") for a in "ABCDE" for b in "XYZ" for n in range(10)}
    assert len(new) == 150 and len({x[:2] for x in new}) > 50  # a fixed shift would give 15
    assert all(cipher.undo(x)[2] == "-" for x in new)


def test_dates():
    cipher = pii.FormatPreserving(b"k")
    new = cipher.date("1984-02-29")
    y, m, d = map(int, new.split("-"))
    assert cipher.date("1984年2月29日") == f"{y}年{m}月{d}日" and cipher.date("29.2.1984") == f"{d}.{m}.{y}"
    assert cipher.date(new, back=True) == "1984-02-29" and pii._ordinal(y, m, d) is not None
    assert cipher.date("1985-02-29") == "1985-02-29" and cipher.date("x") == "x"
    days = {cipher.date(f"{2000 + k // 12}-{k % 12 + 1:02d}-15") for k in range(600)}
    assert len(days) == 600
    text = "生年月日：1984年2月29日、点検日は2020年1月5日。Born on 1984-02-29."
    assert pii.redact(text, cipher) == f"生年月日：[BIRTH_DATE:{y}年{m}月{d}日]、点検日は2020年1月5日。Born on [BIRTH_DATE:{new}]."
    assert [k for k, *_ in pii.find(text)] == []


def test_redacted(spark):
    rows = [(1, "梢戸森さんの連絡先は090-0735-4607である。", "x"), (2, "折り返し０９０－０７３５－４６０７へ。梢戸森様は", "x"), (3, None, "x"), (4, "平文", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, pii_type string")
    got = {r["doc_id"]: r["text"] for r in pii.redacted(docs, b"key").collect()}
    assert got[3] is None and got[4] == "平文"
    phone = lambda t: t.split("[PHONE:")[1].split("]")[0]
    person = lambda t: t.split("[PERSON:")[1].split("]")[0]
    assert phone(got[1]) == phone(got[2]) != "090-0735-4607" and person(got[1]) == person(got[2])
    assert got[1].endswith("]である。") and "さんの連絡先は[" in got[1]
    assert {r["pii_type"] for r in pii.person_spans(docs).collect()} == {"person", "phone"}
