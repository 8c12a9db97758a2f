"""Title and small function vectors."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from revtrack.functions import dates, rules, text, urls
from revtrack.functions.html import mentioned_extensions
from revtrack.functions.question import answer_is_yes, answer_reason, question

# title, key, label, class, item type, category
TITLES = [
    ("개인정보 처리 가이드라인(2025년판)", "개인정보 처리 가이드라인", "2025년", True, "guideline", "privacy"),
    ("SW사업 대가산정 가이드 (2025년 개정판)", "SW사업 대가산정 가이드", "2025년", True, "guideline", "software"),
    ("국가 망 보안체계(N²SF) 보안가이드라인 1.0", "국가 망 보안체계(N²SF) 보안가이드라인", "v1.0", True, "guideline", "info_security"),
    ("공공부문 초거대 AI 도입·활용 가이드라인 v2.0", "공공부문 초거대 AI 도입·활용 가이드라인", "v2.0", True, "guideline", "ai"),
    ("클라우드 보안 안내서 2024", "클라우드 보안 안내서", "2024년", True, "guideline", "cloud"),
    ("정보보호 지침 전부개정", "정보보호 지침", None, True, "announcement", "info_security"),
    ("2025", "", "2025년", None, "guideline", "other"),
    ("가이드 2024 안내", "가이드 2024", None, True, "guideline", "other"),
    ("정보보호 교육과정 안내", "정보보호 교육과정", None, False, "guideline", "info_security"),
    ("개인정보보호위원회, '가이드라인' 발표", "개인정보보호위원회, '가이드라인' 발표", None, True, "announcement", "privacy"),
    ("2026년 업무보고", "2026년 업무보고", None, None, "guideline", "other"),
    ("금융AI 가이드라인", "금융AI 가이드라인", None, True, "guideline", "ai"),
    ("Thai 안내서", "Thai 안내서", None, True, "guideline", "ai"),
    ("OWASP Top 10 for LLM Applications 2025", "OWASP Top 10 for LLM Applications", "2025년", None, "guideline", "ai"),
]
NAMES = [t[0] for t in TITLES]


@pytest.mark.parametrize(
    "fn,i",
    [(text.normalize_title, 1), (text.version_label, 2), (rules.classify_title, 3), (rules.classify_item_type, 4), (rules.categorize, 5)],
)
def test_title_vectors(evaluate, fn, i):
    assert evaluate(fn, NAMES) == [t[i] for t in TITLES]


def test_title_whitespace_is_unicode(evaluate):
    assert evaluate(text.normalize_title, ["　보안  안내서  2024\t", None]) == ["보안 안내서", None]
    assert evaluate(text.strip, ["　 a b\x1f\n"]) == ["a b"]


def test_is_guideline_title(evaluate):
    assert evaluate(rules.is_guideline_title, NAMES) == [t[3] is True for t in TITLES]


def test_category_falls_back_to_the_agency(evaluate):
    rows = [("2026년 업무보고", "FSC"), ("2026년 업무보고", "KISA"), ("2026년 업무보고", "MOIS"), ("보험 안내", "KISA")]
    assert evaluate(lambda t, a: rules.categorize(t, a), rows, "t string, a string") == ["finance", "info_security", "other", "finance"]


def test_rules_frame_keeps_the_order(spark):
    rows = rules.rules_frame(spark).orderBy("priority").collect()
    assert [r.category for r in rows] == ["finance", "ai", "privacy", "info_security", "cloud", "software", "data", "e_gov"]
    assert [r.category for r in rows if r.ignore_case] == ["ai"]


def test_pdf_url(evaluate):
    assert evaluate(text.pdf_url, [(["a.hwp", "B.PDF"],), (["a.hwp"],), ([],), (None,)], "x array<string>") == ["B.PDF", "a.hwp", None, None]


def test_date_from_text(evaluate):
    values = ["20260415", "20269999", "등록 2026.4.5 오전", "2026-13-45", "x", "2026/04/15", "2026-02-30", " 2026.04.13조회수 235", None, "0000-01-01"]
    got = evaluate(dates.date_from_text, values)
    assert got == [date(2026, 4, 15), None, date(2026, 4, 5), None, None, date(2026, 4, 15), None, date(2026, 4, 13), None, None]


def test_compact_date(evaluate):
    assert evaluate(dates.compact_date, ["20260415", "2026", None, "20260415T10"]) == [date(2026, 4, 15), None, None, date(2026, 4, 15)]


def test_feed_date_is_the_day_in_utc(evaluate):
    rows = [
        ("Wed, 15 Apr 2026 08:30:00 +0900", None), ("Wed, 15 Apr 2026 08:30:00 GMT", None), ("15 Apr 2026 20:30 EST", None),
        ("2026-04-15T08:30:00+09:00", None), ("2026-04-15", None), ("2026.04.15 09:00", None), ("", "2026/04/16"), ("nope", None),
        (None, "Thu, 16 Apr 2026 23:00:00 +0000"),
    ]
    got = evaluate(dates.feed_date, rows, "p string, u string")
    assert got == [
        date(2026, 4, 14), date(2026, 4, 15), date(2026, 4, 16), date(2026, 4, 14), date(2026, 4, 15), date(2026, 4, 15),
        date(2026, 4, 16), None, date(2026, 4, 16),
    ]


def test_keyword_filters(evaluate):
    rows = [("AI Guide", []), ("AI Guide", ["guide"]), ("AI Guide", ["Guide"]), ("AI Guide", ["zzz"])]
    schema = "t string, k array<string>"
    assert evaluate(rules.board_keyword_match, rows, schema) == [True, True, False, False]
    assert evaluate(rules.detail_keyword_match, rows, schema) == [False, False, True, False]
    assert evaluate(rules.publication_keyword_match, rows, schema) == [True, False, True, False]


def test_law_relevance_ignores_the_agency_name(evaluate):
    rows = [("개인정보보호위원회 회의규칙", ["개인정보보호위원회"]), ("개인정보보호위원회 암호 기준", ["개인정보보호위원회"])]
    assert evaluate(rules.relevant_law_title, rows, "t string, n array<string>") == [False, True]


def test_rule_types(evaluate):
    assert evaluate(rules.rule_type, ["규칙", "훈령", "공고", None]) == ["고시", "훈령", "공고", "고시"]
    assert evaluate(rules.basis_type, ["고시", "훈령", "예규", "공고"]) == ["gosi", "hunryeong", "yegyu", "gosi"]


def test_mentioned_extensions(evaluate):
    assert evaluate(mentioned_extensions, ["x.pdf 가.hwpx b.DOC"]) == [[".pdf", ".hwp", ".DOC"]]


def test_question_and_answer(evaluate):
    got = evaluate(lambda t, s: question(t, F.lit("게시판"), F.lit("기관"), s), [("제목", ""), ("제목", "본문 a.pdf b.hwp")], "t string, s string")
    assert "본문: (추출 불가)" in got[0] and "제목: 제목\n게시판: 게시판\n기관: 기관\n" in got[0]
    assert "본문 첫 500자: 본문 a.pdf b.hwp\n첨부파일 확장자: .pdf, .hwp\n" in got[1]
    assert evaluate(answer_is_yes, [" yes.", "NO", "y", None]) == [True, False, False, False]
    assert evaluate(answer_reason, [("yes", ""), ("no", "a.pdf b.hwp"), ("yes", "본문")], "a string, s string") == [
        "LLM=YES | 본문추출실패", "LLM=NO | 첨부=.pdf,.hwp", "LLM=YES",
    ]


def test_small_formats(evaluate):
    assert evaluate(text.clean_title_attribute, ["제목(새 글)-첨부파일 있음"]) == ["제목"]
    assert evaluate(text.breaks_to_blanks, [" 가<br/>나</br>다 <br> 라"]) == ["가 나 다 라"]
    assert evaluate(text.compact_list, ["a,b", "", None]) == [["a", "b"], [], []]
    assert evaluate(text.label_changed, [(None, ""), ("v1", "v2"), (None, "v1")], "a string, b string") == [False, True, True]
    assert evaluate(lambda x: text.iso_timestamp(x.cast("timestamp")), ["2026-04-15 01:02:03", "2026-04-15 01:02:03.5"]) == [
        "2026-04-15T01:02:03+00:00", "2026-04-15T01:02:03.500000+00:00",
    ]


def test_url_discriminator(evaluate):
    assert evaluate(urls.url_discriminator, ["http://h/d?menuNo=222&no={id}", "http://h/{id}"]) == ["menuNo=222", ""]
