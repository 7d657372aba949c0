"""Word lists, patterns and limits that results depend on."""

from __future__ import annotations

# Fixed values, in natural order.
HINTS = (
    "鉄道", "列車", "車両", "線路", "駅", "駅長", "乗務員", "運転士", "車掌", "指令",
    "踏切", "信号", "閉そく", "架線", "軌道", "分岐器", "ホーム", "新幹線", "運転", "制御",
    "保安装置", "ATS", "ATC", "CTC", "ダイヤ", "異常時", "故障", "旅客",
)

#: Characters of a candidate, as the inside of a character class.
CANDIDATE_CLASS = "一-龥々〆ヵヶァ-ヴーA-Za-z0-9%℃°+\\-"
CANDIDATE_MIN, CANDIDATE_MAX = 2, 40
#: Stripped from both ends of a candidate, as the inside of a character class.
STRIPPED = "、。，．・:：;；（）()\\[\\]［］「」『』【】<>〈〉《》/\\\\|｜* "
TERMINATORS = "。"
#: Patterns of the validity and score rules.
ALL_HIRAGANA, DIGIT_FIRST, TERM_CHARACTER = "^[ぁ-んー]+$", "^[0-9０-９]", "[一-龥々〆ヵヶァ-ヴーA-Za-z0-9]"
TWO_KANJI, KATAKANA = "[一-龥].*[一-龥]", "[ァ-ヴー]"

SCORE_BASE, SCORE_LONG, SCORE_KANJI, SCORE_KATAKANA, SCORE_HINT = 0.42, 0.14, 0.10, 0.08, 0.22
SCORE_REPEAT, SCORE_REPEAT_STEP, SCORE_CAP = 0.12, 0.04, 0.98
LONG_TERM = 4

MAX_TERMS_PER_DOCUMENT = 300
MAX_EXAMPLES = 3
MAX_EVIDENCE = 200
MAX_RESPONSE_OCCURRENCES = 20
#: File names joined at a time; results don't depend on it.
FILE_RUN = 4096
PAGE_LIMIT_DEFAULT, PAGE_LIMIT_MAX = 50, 100
SEARCH_MAX, NOTE_MAX = 100, 2000
THRESHOLD_DEFAULT, THRESHOLD_LOW, THRESHOLD_HIGH = 0.9, 0.5, 0.98
UPLOAD_FILES, UPLOAD_BYTES = 20, 30 * 1024 * 1024

STATUSES = ("unreviewed", "approved", "rejected", "uncertain")
#: Parts of speech that a term's words can have.
TERM_POS = ("NOUN", "PROPN", "NUM", "SYM", "X", "ADJ")
CHUNK_SOURCE, COMPOUND_SOURCE = "ginza_noun_chunk", "ginza_compound"
REGEX_SOURCE, HINT_GROUP, NEW_GROUP = "regex_candidate", "railway_dictionary_hint", "new_potential_term"

MIME_TYPES = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".csv": "text/csv; charset=utf-8",
    ".md": "text/markdown; charset=utf-8",
    ".txt": "text/plain; charset=utf-8",
}
MIME_DEFAULT = "application/octet-stream"
TEXT_EXTENSIONS = (".txt", ".csv", ".md", "")
UUID_PATTERN = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
