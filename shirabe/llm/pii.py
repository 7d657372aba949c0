"""Personal information in free text: spans, typed placeholders, format-preserving pseudonyms."""

from __future__ import annotations

import hashlib
import hmac
import math
import re
import unicodedata
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame

# What personal information is written with and beside.
HAN = "一-鿿㐀-䶿々〆\U00020000-\U0003ffff"
_KANA = "ぁ-ゖァ-ヺー"
_DASH = "-‐‑–—−ー"
#: Full-width ASCII and the ideographic blank to their plain forms, one to one, so offsets stay.
_PLAIN = {0xFF01 + k: 0x21 + k for k in range(94)} | {0x3000: 0x20, 0x2010: 0x2D, 0x2011: 0x2D, 0x2212: 0x2D}

_WIDE = re.compile(r"[！-～　‐‑−]+")

_EMAIL = re.compile(
    r"(?<![A-Za-z0-9_.+\-])[A-Za-z0-9_][A-Za-z0-9_.+\-]*"
    r"(?:\s?(?:@|[(\[{<]\s?(?:at|AT|a)\s?[)\]}>]|アット(?:マーク)?)\s?[A-Za-z0-9\-]+(?:(?:\.|\s?[(\[{<]\s?(?:dot|DOT|\.)\s?[)\]}>]\s?|\s?ドット\s?)[A-Za-z0-9\-]+)*(?:\.|\s?[(\[{<]\s?(?:dot|DOT|\.)\s?[)\]}>]\s?|\s?ドット\s?)[A-Za-z]{2,}"
    r"|\s(?:at|AT)\s[A-Za-z0-9\-]+(?:\s(?:dot|DOT)\s[A-Za-z0-9\-]+)*\s(?:dot|DOT)\s[A-Za-z]{2,})"
)
_EMAIL_HINT = re.compile(r"@|[(\[{<]\s?(?:at|AT|a)\s?[)\]}>]|アット|\s(?:dot|DOT)\s")

_NUMBER = re.compile(r"(?<![A-Za-z0-9@_.\-/+])(?:\+\d|\(\d{2,5}\)|\d)(?:(?:[ \-()/]{0,2}|\.)\d){7,13}(?!\d)")
#: A number after one of these is that of a thing or a person, not of a telephone.
_OTHER_NUMBER = re.compile(r"(?:番号|編号|编号|号码|図番|图号|品番|工号|証|证|serial|numbers?|No\.?|Nr\.?|numéro|[Nn]ummer|matricule|n°|संख्या|หมายเลข|ID|Drawing|Version|第|№|#)\s*[:：はが]?\s*(?:第)?\s*$", re.I)
_CALLING = re.compile(r"電話|携帯|連絡先|内線|折り返し|ＦＡＸ|FAX|电话|手机|拨打|联系|热线|\b(?:call|ring|phone|tel|telephone|mobile|fax|reached|reach|dial|text|unter|erreichbar|anruf\w*|Rückfragen|Telefon|appelez|répond|téléphone|joindre)\b|फ़ोन|मोबाइल|โทร", re.I)

_ID = re.compile(
    r"(?:個人番号|マイナンバー|(?:社員|職員|従業員|組合員|会員|乗務員)番号|(?:運転)?免許証?(?:の)?(?:番号)?|旅券番号|資格証番号|身分証(?:明書)?番号|工号|身份证(?:号码|号)?|(?:驾驶)?执照(?:号码|号)?|证件号码?|护照号码?"
    r"|(?:[Ee]mployee|[Ss]taff|[Pp]ersonnel|[Pp]ersonal|[Nn]ational)\s(?:ID|No\.?|[Nn]umber)|(?:[Dd]riving\s)?[Ll]icen[cs]e\s(?:ID|No\.?|[Nn]umber)|[Pp]assport(?:\s(?:No\.?|[Nn]umber))?|[Bb]adge(?:\s(?:No\.?|[Nn]umber))?"
    r"|(?:Personal|Ausweis|Führerschein|Dienst)nummer|[Mm]atricule|(?:[Pp]ermis|[Ll]icence)\s(?:n°|numéro))"
    r"\s?(?:[:：はが]|No\.?|n°)?\s?(第\s?[A-Z]?\d[\d\-]*\s?号|[A-Z]{1,3}-?\d{4,12}|\d{4}[ \-]?\d{4}[ \-]?\d{4}(?!\d)|\d[\d\-]{4,15}\d)"
)

_JA_BUILDING = rf"(?:\s?[^\s、。，．,.「」()（）:：]{{1,14}}?\d+号室|\s?\d+号室)?"
_JA_ADDRESS = re.compile(
    rf"(?:〒?\s?\d{{3}}-\d{{4}}\s?)?(?:[{HAN}]{{1,3}}[都道府県])[{HAN}ヶケのノツ]{{1,7}}?[市区郡町村](?:[{HAN}ヶケのノツ{_KANA}]{{1,12}}?)"
    rf"(?:\d+丁目(?:\d+番(?:地)?(?:\d+号?)?|\d+(?:-\d+){{0,2}})?|\d+番地(?:の?\d+)?|\d+番\d+号|\d+(?:-\d+){{1,3}}){_JA_BUILDING}"
)
_JA_LEAD = re.compile(rf"^(?:現住所|新住所|旧住所|住所|宛先|送付先|所在地|勤務先)")
_ZH_ADDRESS = re.compile(rf"(?:\d{{6}}\s?)?[{HAN}]{{2,3}}省[{HAN}]{{1,6}}?[市州](?:[{HAN}]{{1,5}}?[区县镇])?[{HAN}]{{1,8}}?(?:路|街|道|巷|弄|村)(?:\d+弄)?\d+号(?:楼)?(?:\d+(?:栋|幢|座|号楼))?(?:\d+单元)?(?:\d+室)?")
_ZH_LEAD = re.compile("^(?:寄往|寄到|送到|送往|地址|住址|住在|位于|往|到|至|于|在|为|是)+")
_NAME = r"[A-ZÀ-ÝŒ][a-zà-ÿœ'’]+(?:[A-ZÀ-Ý][a-zà-ÿ]+)?(?:-[A-ZÀ-Ý][a-zà-ÿœ'’]+)*"
_STREETS = re.compile(
    # number first, then street, place and postal code
    rf"(?:(?:Flat|Apt\.?|Unit|Suite|Room)\s\w+,\s)?\d{{1,4}}[A-Za-z]?\s(?:{_NAME}\s){{1,3}}(?:St|Street|Ave|Avenue|Rd|Road|Lane|Ln|Drive|Dr|Way|Close|Court|Ct|Crescent|Blvd|Boulevard|Terrace|Row|Place|Pl|Square|Sq|Gate|Hill|Walk)\b\.?,?"
    rf"(?:\s(?:Flat|Apt\.?|Unit|Suite|Room)\s\w+,)?\s(?:{_NAME}\s?){{1,3}},?\s?(?:[A-Z]{{1,2}}\d{{1,2}}[A-Z]?\s\d[A-Z]{{2}}|(?:[A-Z]{{2}}\s)?\d{{5}}(?:-\d{{4}})?)"
    # street, then number, postal code and place
    rf"|(?:{_NAME}\s){{0,2}}(?:{_NAME}|[A-ZÄÖÜ][a-zäöüß]+(?:str\.?|straße))(?:\s(?:Str\.|Straße|Weg|Platz|Allee|Gasse|Ring|Damm))?\s\d{{1,4}}[a-z]?,\s(?:[A-Z]-)?\d{{5}}\s{_NAME}(?:\s(?:am|an der|im|bei)\s{_NAME})?"
    # number, then street in small letters, postal code and place
    rf"|\d{{1,4}}(?:\s(?:bis|ter))?,?\s(?:rue|avenue|av\.|boulevard|bd\.?|chemin|place|pl\.|impasse|allée|quai|route|cours|square)\s(?:(?:de\sla|de\sl['’]|du|des|de|d['’])\s?)?(?:{_NAME}\s?){{1,4}},\s\d{{5}}\s{_NAME}"
)
#: Every address of _STREETS has one of these, every number of _ID one of those.
_POSTAL = re.compile(r"[A-Z]\d[A-Z\d]? \d[A-Z]{2}|\d{5}")
_ID_HINT = re.compile(r"(?:人|イナンバー|員|証|証の|転|可|許|許証|旅券|書)(?:番号|証|\s?[：:はが第A-Z0-9])|工号|份证|执照|证件|护照|[a-zA-Z]\s(?:ID|No|[Nn]umber)|nummer|atricule|assport|adge|n°|numéro|許")

_TITLED = re.compile(rf"\b(?:(?:Mr|Mrs|Ms|Mx|Dr|Prof)\b\.?|Miss|Herrn?|Frau|M\.|Mme|Mlle|Mgr|Me|Monsieur|Madame|Mademoiselle|Sir|[Dd]river|[Cc]onductor|[Ii]nspector|[Ff]oreman|[Ff]ahrer(?:in)?|[Ll]okführer(?:in)?|[Cc]onduct(?:eur|rice))\s{{1,2}}(?:(?:Dr|Prof)\.\s)?((?:[A-ZÀ-Ý]\.\s?){{0,2}}{_NAME}(?: {_NAME}){{0,2}})")
_ACTING = re.compile(rf"((?:[A-ZÀ-Ý]\. ?)?{_NAME}(?: {_NAME}){{0,2}})(?= (?:can be reached|can be called|is reachable|may be reached|ist unter [+0]|est joignable|répond au))")

_JA_TITLE = re.compile(r"(?:さん|様|氏|殿|君|ちゃん|係長|課長|部長|主任|班長|次長|主査|助役|社長|会長|先生|女士|小姐|师傅|经理|老师|同志)(?![書子式々相態名格])|と申します|と申し|といいます|と名乗")
_HAN_NAME = re.compile(rf"[{HAN}][{HAN}ヶヵケノツ]{{0,11}}(?: [{HAN}{_KANA}]{{1,3}})?$")
_ZH_ONLY = frozenset("女士 小姐 师傅 经理 老师 同志".split())
_ROLE = re.compile(r"^.*(?:受取人|届出人|差出人|申告者|申請人|担当者|担当|責任者|見学者|利用者|所有者|関係者|当事者|証人|本人|運転士|車掌|乗務員|作業員|係員|職員|社員|保守員|検査員|駅員|指令員|教官|講師|技師|氏名|乗客|旅客|收件人|寄件人|联系人|负责人|经办人|申请人|司机|列车长|调度员|检查员|维修员|由|请|向|给|和|与|是|为|叫)(?=..)")
_NO_NAME = frozenset("皆 客 お客 神 王 両 同 貴 各 奥 何 仕 多 有 模 異 一 諸 某 本 先 彼 旧 現 新 前 元 各位 乗客 旅客 利用者 担当者 受取人 届出人 係 現場".split())
_NO_TAIL = re.compile(r"(?:駅|站|線|线|区|市|県|町|村|踏切|所|社|部|課|室|編成|保守|電車|列車|番線|盤|器|装置)$")
_LABELLED = re.compile(rf"(?:担当者?|責任者|氏名|名前|届出人|受取人|申請者|連絡者|联系人|负责人|姓名|收件人)\s?:\s?([{HAN}][{HAN}ヶヵケノツ]{{1,5}}(?: [{HAN}{_KANA}]{{1,3}})?)(?=[(（,、，。.\s]|$)")


def _digits(text: str) -> int:
    return sum(c.isdigit() for c in text)


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(type, start, end) of the personal information in a text, in order and without overlaps.

    Types: email, phone, id_number, address, person. Offsets are code points of
    ``text``, the end exclusive. Null and empty texts have none. Where two
    readings overlap, e-mail goes before address, identity number, phone, person.
    """
    if not text:
        return []
    plain = _WIDE.sub(lambda m: m.group().translate(_PLAIN), text)
    spans: list[tuple[int, int, str]] = []

    def take(kind: str, start: int, end: int) -> None:
        while start < end and plain[start].isspace():
            start += 1
        while end > start and plain[end - 1].isspace():
            end -= 1
        if start < end and all(end <= s or start >= e for s, e, _ in spans):
            spans.append((start, end, kind))

    if _EMAIL_HINT.search(plain):
        for m in _EMAIL.finditer(plain):
            take("email", *m.span())
    if "県" in plain or "都" in plain or "府" in plain or "道" in plain:
        for m in _JA_ADDRESS.finditer(plain):
            lead = _JA_LEAD.match(m.group())
            take("address", m.start() + (lead.end() if lead else 0), m.end())
    if "省" in plain:
        for m in _ZH_ADDRESS.finditer(plain):
            at = m.start() + _lead(m.group())
            take("address", at, m.end())
    if _POSTAL.search(plain):
        for m in _STREETS.finditer(plain):
            take("address", *m.span())
    if _ID_HINT.search(plain):
        for m in _ID.finditer(plain):
            take("id_number", *m.span(1))
    for m in _NUMBER.finditer(plain):
        if _is_phone(plain, m):
            take("phone", *m.span())
    for m in _TITLED.finditer(plain):
        take("person", *m.span(1))
    for m in _ACTING.finditer(plain):
        take("person", *m.span(1))
    for m in _JA_TITLE.finditer(plain):
        found = _han_name(plain, m)
        if found:
            take("person", *found)
    for m in _LABELLED.finditer(plain):
        if not _NO_TAIL.search(m.group(1)):
            take("person", *m.span(1))
    spans.sort()
    return [(kind, s, e) for s, e, kind in spans]


def _lead(address: str) -> int:
    """Characters before a Chinese province's name that belong to the sentence."""
    head = address.split("省", 1)[0]
    found = _ZH_LEAD.match(head)
    if found and len(head) - found.end() >= 2:
        return found.end()
    return len(head) - 2 if len(head) == 3 and head[0] in "往到至于在为是寄住给向" else 0


def _is_phone(plain: str, m: re.Match) -> bool:
    number = m.group()
    n = _digits(number)
    before = plain[max(0, m.start() - 24) : m.start()]
    if _OTHER_NUMBER.search(before) or re.match(r"\d{1,2}\.\d{1,2}\.\d{4}|\d{4}[-.]\d{1,2}[-.]\d{1,2}\b", number):
        return False
    if before.endswith("〒"):
        return False
    if number[0] == "+":
        return 9 <= n <= 14
    calling = bool(_CALLING.search(plain[max(0, m.start() - 40) : m.start()] + "|" + plain[m.end() : m.end() + 16]))
    if number.lstrip("(")[0] == "0":
        return 9 <= n <= 11
    return calling and 9 <= n <= 12


def _han_name(plain: str, title: re.Match) -> tuple[int, int] | None:
    """The name in Han characters before a title, without the role it follows."""
    head = plain[max(0, title.start() - 16) : title.start()]
    m = _HAN_NAME.search(head)
    if not m:
        return None
    name = m.group()
    role = _ROLE.match(name)
    cut = role.end() if role else 0
    name = name[cut:]
    start = title.start() - len(head) + m.start() + cut
    if title.group() in _ZH_ONLY or (title.group() == "先生" and not re.search(r"[ヶヵケノツ ]", name) and len(name) <= 4 and not re.search(f"[{_KANA}]", plain[max(0, start - 6) : start])):
        if len(name) > 3:
            start, name = start + len(name) - 3, name[-3:]
    family = name.split(" ")[0]
    if not name or name in _NO_NAME or family in _NO_NAME or _NO_TAIL.search(name) or len(family) > 7:
        return None
    if len(name) < 2 and title.group() in ("君", "殿", "様"):
        return None
    return start, start + len(name)


def person_spans(documents: DataFrame) -> DataFrame:
    """(doc_id, pii_type, start_char, end_char) of all documents; works on each text alone, without a shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, kind, s, e) for d, text in zip(b["doc_id"], b["text"]) for kind, s, e in find(text)]
            yield pd.DataFrame(rows, columns=["doc_id", "pii_type", "start_char", "end_char"])

    return documents.select("doc_id", "text").where("text IS NOT NULL AND text <> ''").mapInPandas(run, "doc_id bigint, pii_type string, start_char int, end_char int")


# Calling codes of countries whose national numbers begin with a 0 that the code replaces, and of those where nothing is replaced.
_TRUNK = ("33", "44", "49", "66", "81")
_NO_TRUNK = ("1", "86", "91")
_MOBILE = re.compile(r"0[5-9]0\d{8}|1[3-9]\d{9}")
# Weights and signs of the check digit of Chinese resident numbers.
_CN_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
_CN_SIGNS = "10X98765432"
_FIRST_DAY, _LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
_DATE = r"(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{4}年\d{1,2}月\d{1,2}日|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})"
_BIRTH = re.compile(rf"(?:生年月日|出生日期|出生年月日?|[Bb]orn(?:\son)?|[Dd]ate\sof\s[Bb]irth|DOB|[Gg]eboren(?:\sam)?|Geburtsdatum|[Nn]ée?\sle|[Dd]ate\sde\snaissance)\s?[:：はが]?\s?({_DATE})(?!\d)")


def individual_check(payload: str) -> int:
    """The check digit that follows the eleven digits of a Japanese individual number."""
    rest = sum(int(c) * (n + 1 if n <= 6 else n - 5) for n, c in enumerate(reversed(payload), 1)) % 11
    return 0 if rest <= 1 else 11 - rest


def resident_check(payload: str) -> int:
    """Place among the check signs of the one that follows the seventeen digits of a Chinese resident number."""
    return sum(int(c) * w for c, w in zip(payload, _CN_WEIGHTS)) % 11


def _ordinal(year: int, month: int, day: int) -> int | None:
    """Days of a date of the years 1900 to 2099 since their first; None if there is no such date."""
    try:
        at = date(year, month, day).toordinal()
    except ValueError:
        return None
    return at - _FIRST_DAY if _FIRST_DAY <= at <= _LAST_DAY else None


class FormatPreserving:
    """Keyed permutations of numbers, identity numbers, telephone numbers and dates within their formats.

    A Feistel network of ten rounds with HMAC-SHA-256 over the two halves of the
    signs that change: digits and ASCII capitals, each within its kind; one sign
    alone is shifted. Everything else stays, so a pseudonym has its value's
    format, equal values have equal pseudonyms, and going ``back`` gives the value.
    Separators and width don't count, so one number in two notations stays linked.
    """

    ROUNDS = 10

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: str, number: int, value: int) -> int:
        return int.from_bytes(hmac.new(self.key, f"{tweak}|{number}|{value}".encode(), hashlib.sha256).digest()[:24], "big")

    def permute(self, signs: list[int], sizes: list[int], tweak: str = "", back: bool = False) -> list[int]:
        """A permutation of all rows of signs below ``sizes``; another one for each ``tweak``."""
        tweak = f"{tweak}|{','.join(map(str, sizes))}"
        if len(signs) < 2:
            return [(x + (-1 if back else 1) * self._round(tweak, 0, 0)) % n for x, n in zip(signs, sizes)]
        half = len(signs) // 2
        whole = [math.prod(sizes[:half]), math.prod(sizes[half:])]
        parts = [0, 0]
        for i, (x, n) in enumerate(zip(signs, sizes)):
            parts[i >= half] = parts[i >= half] * n + x
        for k in reversed(range(self.ROUNDS)) if back else range(self.ROUNDS):
            step = self._round(tweak, k, parts[1 - k % 2])
            parts[k % 2] = (parts[k % 2] + (-step if back else step)) % whole[k % 2]
        out = []
        for i in reversed(range(len(signs))):
            parts[i >= half], x = divmod(parts[i >= half], sizes[i])
            out.append(x)
        return out[::-1]

    def digits(self, value: str, back: bool = False, tweak: str = "") -> str:
        return "".join(map(str, self.permute([int(c) for c in value], [10] * len(value), tweak, back)))

    def value(self, text: str, back: bool = False, keep: int = 0) -> str:
        """``text`` with its digits and ASCII capitals permuted together; the first ``keep`` of them stay."""
        out, spots = _signs(text)
        kept, spots = spots[:keep], spots[keep:]
        sizes = [10 if out[i].isdecimal() else 26 for i in spots]
        signs = [unicodedata.decimal(out[i]) if n == 10 else ord(out[i]) - 65 for i, n in zip(spots, sizes)]
        for i, x, n in zip(spots, self.permute(signs, sizes, "".join(out[i] for i in kept), back), sizes):
            out[i] = str(x) if n == 10 else chr(65 + x)
        return "".join(out)

    def undo(self, text: str, keep: int = 0) -> str:
        return self.value(text, True, keep)

    def phone(self, text: str, back: bool = False) -> str:
        """A telephone number with its country code, its leading 0 and the digit after it, or its mobile prefix, left as they are.

        What is permuted is the national number, so ``+81-90-…`` and ``090-…`` stay linked.
        """
        out, spots = _signs(text)
        spots = [i for i in spots if out[i].isdecimal()]
        number = "".join(str(unicodedata.decimal(out[i])) for i in spots)
        code, lead = "", ""
        if "+" in out:
            code = next((c for c in _TRUNK + _NO_TRUNK if number.startswith(c)), "")
            lead = "0" if code in _TRUNK else ""
        elif len(number) == 11 and re.match(r"1[ \-.(]", "".join(out)):
            code = "1"
        rest = number[len(code) :]
        if lead and rest.startswith("0"):  # as in +49 (0) 89
            code, rest = code + "0", rest[1:]
        national = lead + rest
        keep = 3 if _MOBILE.fullmatch(national) else 2 if national.startswith("0") else 1
        new = national[:keep] + self.digits(national[keep:], back, f"phone {national[:keep]}")
        for i, c in zip(spots, code + new[len(lead) :]):
            out[i] = c
        return "".join(out)

    def identity(self, text: str, back: bool = False) -> str:
        """An identity number; a right check digit, and a right date of birth within the number, stay right, and wrong ones wrong."""
        out, spots = _signs(text)
        number = "".join(str(unicodedata.decimal(out[i])) if out[i].isdecimal() else out[i] for i in spots)
        if re.fullmatch(r"\d{12}", number):
            new = self.digits(number[:11], back, "individual")
            new += str((individual_check(new) + int(number[11]) - individual_check(number[:11])) % 10)
        elif re.fullmatch(r"\d{17}[\dX]", number):
            new = number[:2] + self._resident(number[2:17], back)
            new += _CN_SIGNS[(resident_check(new) + _CN_SIGNS.index(number[17]) - resident_check(number[:17])) % 11]
        else:
            return self.value(text, back)
        for i, c in zip(spots, new):
            out[i] = c
        return "".join(out)

    def _resident(self, digits: str, back: bool) -> str:
        """District, date of birth and serial number: permuted among those with a right date, or among those without."""
        day = lambda d: _ordinal(int(d[4:8]), int(d[8:10]), int(d[10:12]))
        right = day(digits) is not None
        while True:
            if right:
                district, at, serial = self._steps([int(digits[:4]), day(digits), int(digits[12:])], back)
                born = date.fromordinal(_FIRST_DAY + at)
                return f"{district:04d}{born.year:04d}{born.month:02d}{born.day:02d}{serial:03d}"
            digits = self.digits(digits, back, "resident")
            if day(digits) is None:
                return digits

    def _steps(self, signs: list[int], back: bool) -> list[int]:
        return self.permute(signs, [10_000, _LAST_DAY - _FIRST_DAY + 1, 1000], "resident", back)

    def date(self, text: str, back: bool = False) -> str:
        """A date of the years 1900 to 2099 as another one in the same notation, the same for one day in all notations; what is no such date stays."""
        out, _ = _signs(text)
        found = re.findall(r"\d+", "".join(out))
        if len(found) != 3:
            return text
        first = len(found[0]) == 4
        year, month, day = (found[0], found[1], found[2]) if first else (found[2], found[1], found[0])
        at = _ordinal(int(year), int(month), int(day))
        if at is None:
            return text
        days = _LAST_DAY - _FIRST_DAY + 1
        wide = math.isqrt(days) + 1
        while True:  # on along the permutation until it is within the range again
            high, low = self.permute(list(divmod(at, wide)), [wide, wide], "date", back)
            at = high * wide + low
            if at < days:
                break
        born = date.fromordinal(_FIRST_DAY + at)
        padded = any(len(p) == 2 and p[0] == "0" for p in (month, day)) or (len(month) == len(day) == 2 and "年" not in text and first)
        show = lambda n: f"{n:02d}" if padded else str(n)
        parts = iter([str(born.year), show(born.month), show(born.day)] if first else [show(born.day), show(born.month), str(born.year)])
        return re.sub(r"\d+", lambda m: next(parts), "".join(out))

    def tag(self, kind: str, text: str) -> str:
        """A short keyed mark for values without a number format; spaces and letter case don't count."""
        plain = re.sub(r"\s+", "", unicodedata.normalize("NFKC", text)).lower()
        return hmac.new(self.key, f"{kind}|{plain}".encode(), hashlib.sha256).hexdigest()[:10]


def _signs(text: str) -> tuple[list[str], list[int]]:
    """The signs of the text after NFKC, and the places of its digits and ASCII capitals."""
    out = list(unicodedata.normalize("NFKC", text))
    return out, [i for i, c in enumerate(out) if c.isdecimal() or "A" <= c <= "Z"]


def birth_dates(text: str) -> list[tuple[str, int, int]]:
    """("birth_date", start, end) of the dates that a text names as someone's birth; all other dates are no personal information."""
    plain = _WIDE.sub(lambda m: m.group().translate(_PLAIN), text)
    return [("birth_date", *m.span(1)) for m in _BIRTH.finditer(plain)]


def redact(text: str | None, cipher: FormatPreserving) -> str | None:
    """The text with typed placeholders; all else stays as it is. Null stays null.

    Dates of birth are replaced too, though they are none of the types that ``find`` gives.
    """
    if not text:
        return text
    spans = find(text)
    spans += [d for d in birth_dates(text) if all(d[2] <= s or d[1] >= e for _, s, e in spans)]
    marks = {"phone": cipher.phone, "id_number": cipher.identity, "birth_date": cipher.date}
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: x[1]):
        value = text[s:e]
        mark = marks[kind](value) if kind in marks else cipher.tag(kind, value)
        out += [text[at:s], f"[{kind.upper()}:{mark}]"]
        at = e
    return "".join(out) + text[at:]


def redacted(documents: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text) of all documents with typed placeholders, equal values linked by equal pseudonyms."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cipher = FormatPreserving(key)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [redact(t, cipher) for t in b["text"]]})

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id bigint, text string")
