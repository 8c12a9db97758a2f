"""Curated document lists."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: documents entered by hand (agency, title, category, description, url, date, exam references)
EXAM_DOCUMENTS = (
    ("KCC", "생성형 인공지능 서비스 이용자 보호 가이드라인", "ai", "생성형 AI 서비스 이용자 보호를 위한 4가지 기본원칙 + 6가지 실행방식. 138회 관리 2교시 출제.",
     "https://www.korea.kr/briefing/pressReleaseView.do?newsId=156676724", date(2025, 2, 28), "138회 관리 2교시"),
    ("NIA", "공공부문 초거대 AI 도입·활용 가이드라인 v2.0", "ai", "공공부문 초거대AI 도입 원칙, 사전 고려사항, 보안통제항목, RAG 기술 도입방식. 134회 응용 2교시, 137회 관리 출제.",
     "https://www.nia.or.kr/site/nia_kor/ex/bbs/View.do?cbIdx=99953&bcIdx=27985", date(2025, 4, 16), "134회 응용 2교시, 137회 관리"),
    ("SPRI", "SW사업 대가산정 가이드 (2025년 개정판)", "software", "SW 사업 대가산정 방법 비교, AI 도입사업 대가체계, DevOps 대가기준 신설. 117~137회 거의 매 회차 출제 단골 주제.",
     "https://www.sw.or.kr/site/sw/ex/board/View.do?cbIdx=276&bcIdx=63607", date(2025, 8, 11), "117~137회 다수 출제"),
    ("NIS", "국가 망 보안체계(N²SF) 보안가이드라인 1.0", "info_security", "국가 망 보안 체계 N2SF 보안통제항목 260여개, 정보서비스 모델 11개. 135회 응용, 137회 관리 출제.",
     "https://www.ncsc.go.kr:4018/main/cop/bbs/selectBoardArticle.do?bbsId=Notification_main&nttId=218022", date(2025, 9, 9), "135회 응용, 137회 관리"),
    ("NIA", "AI 신뢰성 검인증(CAT 2.0) 가이드", "ai", "ISO/IEC 23894, 42001 기반 AI 신뢰성 인증 체계. 기능/성능 시험 강화, 기업규모별 차등 적용. 133회, 137회 관리 출제.",
     "https://tta-trustworthy-ai.gitbook.io/cat/cat-2.0/aisystem", date(2025, 4, 1), "133회 관리 1교시, 137회 관리"),
    ("MSIT", "인공지능 윤리기준 (3대 기본원칙 + 10대 핵심요건)", "ai", "인간 존엄성·사회 공공선·기술 합목적성 3대 원칙, 인권보장~투명성 10대 요건. 129~136회 다수 출제.",
     "https://www.msit.go.kr/bbs/view.do?sCode=user&mPid=112&mId=113&bbsSeqNo=94&nttSeqNo=3179742", date(2020, 12, 23), "129회 관리, 131회 관리, 136회 관리"),
    ("NIA", "정보시스템 운영 및 유지보수 감리 점검 가이드 Ver.2.0", "e_gov", "정보시스템 감리기준(행안부 고시) 제24조 근거. 운영 16개 + 유지보수 34개 점검분야. 137회 관리 출제.",
     "https://www.nia.or.kr/site/nia_kor/ex/bbs/View.do?cbIdx=99860&bcIdx=19572", date(2022, 1, 1), "137회 관리"),
    ("MSIT", "소프트웨어사업 영향평가 가이드라인", "software", "소프트웨어진흥법 제43조 근거. 대상기관, 평가체계, 평가항목 규정. 128회 응용 1교시, 132회 응용, 137회 응용 출제.",
     "https://www.nipa.kr/home/2-8/8899", date(2021, 12, 1), "128회 응용, 132회 응용, 137회 응용"),
    ("KISA", "OWASP Top 10 for LLM Applications 2025", "info_security", "LLM 애플리케이션 보안 취약점 Top 10 (Prompt Injection ~ Unbounded Consumption). 136회 관리, 137회 응용 출제.",
     "https://genai.owasp.org/resource/owasp-top-10-for-llm-applications-2025/", date(2025, 1, 1), "136회 관리, 137회 응용"),
    ("KISA", "클라우드 보안인증제도(CSAP) 가이드", "cloud", "공공부문 민간 클라우드 서비스 보안인증 절차, SaaS/PaaS/IaaS 평가기준. 128회 관리, 129회 응용, 134회 응용 출제.",
     "https://isms.kisa.or.kr/main/csap/intro/", date(2024, 1, 1), "128회 관리, 129회 응용, 134회 응용"),
    ("NIA", "지능정보기술 감리 실무 가이드", "ai", "빅데이터, AI, 클라우드 등 지능정보기술 사업의 단계별 감리 점검항목. 130회 관리, 134회 응용 출제.",
     "https://www.nia.or.kr/site/nia_kor/ex/bbs/List.do?cbIdx=99860", date(2023, 2, 1), "130회 관리, 134회 응용"),
)
MANUAL_DOCUMENTS = (
    ("FSI", "내부업무망 SaaS 망분리 예외 적용에 따른 보안 해설서", "finance",
     "전자금융감독규정 개정으로 내부업무망에서 SaaS 이용이 가능해짐에 따른 금융권 대상 보안 해설서",
     "https://www.fsec.or.kr/bbs/detail?menuNo=222&bbsNo=11929",
     "https://www.fsec.or.kr/bbs/downloadFile?fileNo=13550&filePage=board", date(2026, 4, 20), "v1.0 (2026.04)"),
)
EXAM_SUMMARY = "기출 참조 수동 시드 ({refs})"

_SCHEMA = (
    "agency_code string, title string, category string, description string, source_url string, pdf_url string, "
    "published_date date, version_label string, change_summary string"
)


def exam_documents(spark: SparkSession) -> DataFrame:
    rows = [(a, t, c, d, u, None, day, None, EXAM_SUMMARY.format(refs=refs)) for a, t, c, d, u, day, refs in EXAM_DOCUMENTS]
    return spark.createDataFrame(rows, _SCHEMA)


def manual_documents(spark: SparkSession) -> DataFrame:
    rows = [(a, t, c, d, u, pdf, day, label, None) for a, t, c, d, u, pdf, day, label in MANUAL_DOCUMENTS]
    return spark.createDataFrame(rows, _SCHEMA)


def with_agency_id(documents: DataFrame, agencies: DataFrame) -> DataFrame:
    own = agencies.select(F.col("code").alias("agency_code"), F.col("id").alias("agency_id"))
    return documents.join(own, "agency_code")
