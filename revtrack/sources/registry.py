"""Publisher registry, site profiles and keyword lists as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv

_G, _A = fv.GUIDELINE_KEYWORDS, fv.ANNOUNCEMENT_KEYWORDS

# --- fixed values: publishers (code, name, short name, homepage, description) ------------------
PUBLISHERS = (
    ("PIPC", "개인정보보호위원회", "개인정보위", "https://www.pipc.go.kr", "개인정보 보호 정책 수립, 고시·가이드라인 발행"),
    ("MSIT", "과학기술정보통신부", "과기정통부", "https://www.msit.go.kr", "ICT 정책, 정보보호, SW산업 관련 고시·훈령 발행"),
    ("KISA", "한국인터넷진흥원", "KISA", "https://www.kisa.or.kr", "정보보호·개인정보 기술 가이드라인, 보안 안내서 발행"),
    ("NIS", "국가사이버안보센터", "NCSC", "https://www.ncsc.go.kr", "보안적합성 검증, 암호모듈 검증기준, 사이버보안 가이드"),
    ("FSC", "금융위원회", "금융위", "https://www.fsc.go.kr", "전자금융감독규정, 금융보안 가이드라인 발행"),
    ("NIA", "한국지능정보사회진흥원", "NIA", "https://www.nia.or.kr", "전자정부 표준프레임워크, 정보화 가이드, AI 윤리 가이드"),
    ("MOIS", "행정안전부", "행안부", "https://www.mois.go.kr", "정보시스템 구축·운영 지침, 클라우드 보안, 전자정부 가이드"),
    ("SPRI", "소프트웨어정책연구소", "SPRi", "https://www.spri.kr", "SW대가기준, SW산업 동향, 정책 연구 보고서"),
    ("TTA", "한국정보통신기술협회", "TTA", "https://www.tta.or.kr", "ICT 표준 제정, AI 표준 평가, 표준화 가이드라인 발행. AI 기본법 지원기관."),
    ("FSI", "금융보안원", "금융보안원", "https://www.fsec.or.kr", "금융분야 IT 보안 가이드·해설서 발행 (금융위 산하)"),
    ("KCC", "방송통신위원회", "방통위", "https://www.kmcc.go.kr", "이용자보호 기준, 스팸방지 가이드, 통신 관련 고시"),
)
# --- fixed values: targets (code, label, source type, schedule, item type, url, paging parameter,
#     pages, (list, title, date, link selector), keywords) -------------------------------------
_NO = (None, None, None, None)
_FSC_LIST = (".board-list-wrap > ul > li", ".subject a", None, None)
_NIA_LIST = (".board_type01 li", "a", "span.src", None)
TARGETS = (
    ("PIPC", "법령정보 (고시·훈령)", "bbs_list", "weekly", "guideline", "https://www.pipc.go.kr/np/cop/bbs/selectBoardList.do?bbsId=BS217&mCode=D010030000", "pageIndex", 8, _NO, _G),
    ("PIPC", "보도자료", "bbs_list", "daily", "announcement", "https://www.pipc.go.kr/np/cop/bbs/selectBoardList.do?bbsId=BS074&mCode=C020010000", "pageIndex", 3, _NO, _A),
    ("MSIT", "훈령·예규·고시 (법제처 API)", "law_api", "weekly", "guideline", "https://www.law.go.kr", None, 3, _NO, _G),
    ("MSIT", "AI 기본법 가이드라인 (KOSA 통합)", "bbs_list", "weekly", "guideline", "https://www.sw.or.kr/AI_act_helpdesk/main.jsp", None, 3, _NO, _G),
    ("KISA", "정보보호 안내서", "bbs_list", "weekly", "guideline", "https://www.kisa.or.kr/2060204", "page", 5, _NO, ()),
    ("KISA", "정보보호 매뉴얼·사례집", "bbs_list", "weekly", "guideline", "https://www.kisa.or.kr/2060205", "page", 5, _NO, ()),
    ("KISA", "개인정보보호 가이드라인", "bbs_list", "weekly", "guideline", "https://www.kisa.or.kr/2060202", "page", 5, _NO, ()),
    ("KISA", "가이드라인 자료실 (통합)", "bbs_list", "weekly", "guideline", "https://www.kisa.or.kr/2060207", "page", 3, _NO, ()),
    ("NIS", "자료실", "bbs_list", "monthly", "guideline", "https://www.ncsc.go.kr:4018/main/cop/bbs/selectBoardList.do?bbsId=SecurityAdvice_main", None, 3, _NO, _G),
    ("NIS", "NCSC 지침", "bbs_list", "weekly", "guideline", "https://www.ncsc.go.kr:4018/main/cop/bbs/selectBoardList.do?bbsId=InstructionGuide_main", None, 3, _NO, _G),
    ("NIS", "국정원 보도자료", "bbs_list", "weekly", "announcement", "https://www.nis.go.kr:4016/CM/1_4/list.do", "currentPage", 3, ("table tbody tr", "a.text-table-ellipsis", None, "a.text-table-ellipsis"), _A),
    ("NIS", "사이버·AI안보 발간자료", "bbs_list", "monthly", "guideline", "https://www.nis.go.kr:4016/AF/1_7_7_1.do", None, 3, _NO, _G),
    ("FSC", "보도자료", "bbs_list", "daily", "announcement", "https://www.fsc.go.kr/no010101", "curPage", 3, _FSC_LIST, _A + ("전자금융", "금융보안", "핀테크")),
    ("FSC", "고시·훈령", "bbs_list", "weekly", "announcement", "https://www.fsc.go.kr/po040200", "curPage", 5, _FSC_LIST, _A),
    ("FSC", "RSS 보도자료", "rss", "daily", "announcement", "https://www.fsc.go.kr/about/fsc_bbs_rss/?fid=0111", None, 3, _NO, _A),
    ("NIA", "발간물", "bbs_list", "monthly", "guideline", "https://www.nia.or.kr/site/nia_kor/ex/bbs/List.do?cbIdx=39485", "pageIndex", 3, _NIA_LIST, ()),
    ("NIA", "공지사항", "bbs_list", "weekly", "guideline", "https://www.nia.or.kr/site/nia_kor/ex/bbs/List.do?cbIdx=99835", "pageIndex", 15, _NIA_LIST, _G + ("배포", "발간")),
    ("NIA", "보도자료", "bbs_list", "weekly", "announcement", "https://www.nia.or.kr/site/nia_kor/ex/bbs/List.do?cbIdx=90549", "pageIndex", 3, _NIA_LIST, _A),
    ("MOIS", "보도자료", "bbs_list", "daily", "announcement", "https://www.mois.go.kr/frt/bbs/type010/commonSelectBoardList.do?bbsId=BBSMSTR_000000000008", "pageIndex", 3, _NO, _A + ("정보시스템", "클라우드", "전자정부")),
    ("MOIS", "정보화 표준·지침 자료실", "bbs_list", "weekly", "guideline", "https://www.mois.go.kr/frt/bbs/type001/commonSelectBoardList.do?bbsId=BBSMSTR_000000000045", "pageIndex", 5, _NO, ()),
    ("MOIS", "훈령·예규·고시", "bbs_list", "weekly", "guideline", "https://www.mois.go.kr/frt/bbs/type001/commonSelectBoardList.do?bbsId=BBSMSTR_000000000016", "pageIndex", 5, _NO, _G + ("정보시스템", "클라우드", "전자정부", "보안")),
    ("MOIS", "RSS 피드", "rss", "daily", "announcement", "https://www.mois.go.kr/gpms/view/jsp/rss/rss.jsp?ctxCd=1012", None, 3, _NO, _A),
    ("SPRI", "발간물", "bbs_list", "monthly", "guideline", "https://www.spri.kr/posts?code=data_all", "data_page", 3, (".com_list_box > ul > li", ".title a", ".data_list_area .list li:first-child .text", None), ()),
    ("FSI", "자료마당 가이드 (bbsNo 증분 스캔)", "bbs_list", "weekly", "guideline", "https://www.fsec.or.kr/bbs/list?menuNo=222", None, 3, _NO, _G),
    ("FSI", "보도자료 (bbsNo 증분 스캔)", "bbs_list", "weekly", "announcement", "https://www.fsec.or.kr/bbs/list?menuNo=69", None, 3, _NO, _A),
    ("KCC", "고시·훈령 (법제처 API)", "law_api", "weekly", "guideline", "https://www.law.go.kr", None, 3, _NO, _G),
    ("KCC", "보도자료", "bbs_list", "weekly", "announcement", "https://kcc.go.kr/user.do?boardId=1113&page=A05030000", "cp", 3, ("tbody tr", "a[href*='boardSeq']", None, "a[href*='boardSeq']"), _A),
)
# --- fixed values: detail-scan sites -----------------------------------------------------------
_FSI_DETAIL = {
    "agency_code": "FSI", "id_param_name": "bbsNo", "error_marker": "요청하신 페이지에서 오류가 발생",
    "title_section_marker": "titleBox", "title_regex": r"<h3>([^<]+)</h3>",
    "date_regex": r'class="date"[^>]*>(\d{4}-\d{2}-\d{2})',
    "file_regex": r'(?s)fileNo="(\d+)"\s*[^>]*filePage="board"[^>]*>([^<]+)</a>',
    "file_download_template": "https://www.fsec.or.kr/bbs/downloadFile?fileNo={file_id}&filePage=board",
}
DETAIL_PROFILES = (
    {**_FSI_DETAIL, "list_url": "https://www.fsec.or.kr/bbs/list?menuNo=222",
     "url_template": "https://www.fsec.or.kr/bbs/detail?menuNo=222&bbsNo={id}", "baseline_id": 11900, "scan_window": 100},
    {**_FSI_DETAIL, "list_url": "https://www.fsec.or.kr/bbs/list?menuNo=69",
     "url_template": "https://www.fsec.or.kr/bbs/detail?menuNo=69&bbsNo={id}", "baseline_id": 11500, "scan_window": 200},
)
# --- fixed values: single-page sites -----------------------------------------------------------
PAGE_PROFILES = (
    {"agency_code": "NIS", "config_label": "사이버·AI안보 발간자료", "url": "https://www.nis.go.kr:4016/AF/1_7_7_1.do",
     "block_splitter": r'(?=<img[^>]*class="border-gray01"[^>]*alt=")',
     "title_regex": r'<img[^>]*class="border-gray01"[^>]*alt="([^"]+)"',
     "seq_regex": r'href="/common/download\.do\?seq=([A-F0-9]+)"',
     "date_regex": r"(?s)등록일자.*?(\d{4}-\d{2}-\d{2})",
     "download_url_template": "https://www.nis.go.kr:4016/common/download.do?seq={seq}"},
    {"agency_code": "MSIT", "config_label": "AI 기본법 가이드라인 (KOSA 통합)", "url": "https://www.sw.or.kr/AI_act_helpdesk/main.jsp",
     "block_splitter": r'(?=<a[^>]*class="guide-item")',
     "title_regex": r"<span>([^<]+(?:<br\s*/?>[^<]+|</br>[^<]+)*)</span>",
     "seq_regex": r'href="(https://www\.sw\.or\.kr/common/files/Download\.do\?[^"]+)"',
     "date_regex": None, "download_url_template": "{seq}"},
)

DETAIL_SCHEMA = (
    "agency_code string, list_url string, id_param_name string, url_template string, error_marker string, "
    "title_section_marker string, title_regex string, date_regex string, file_regex string, "
    "file_download_template string, file_has_name boolean, baseline_id long, scan_window long, position int"
)
PAGE_SCHEMA = (
    "agency_code string, config_label string, url string, block_splitter string, title_regex string, "
    "seq_regex string, date_regex string, download_url_template string, position int"
)


def publishers(spark: SparkSession) -> DataFrame:
    """One row per publisher with its targets as an array; a publisher may have none."""
    targets: dict[str, list] = {row[0]: [] for row in PUBLISHERS}
    for code, label, source, schedule, kind, url, param, pages, (rows, title, date, link), keywords in TARGETS:
        targets[code].append((label, source, schedule, url, rows, title, date, link, param, pages, list(keywords), kind))
    schema = (
        "code string, name string, short_name string, homepage_url string, description string, targets array<struct<"
        "label:string,source_type:string,schedule:string,url:string,list_selector:string,title_selector:string,"
        "date_selector:string,link_selector:string,pagination_param:string,max_pages:int,"
        "keyword_filter:array<string>,item_type:string>>"
    )
    return spark.createDataFrame([(*row, targets[row[0]]) for row in PUBLISHERS], schema)


def targets(spark: SparkSession) -> DataFrame:
    """One row per target; a publisher without targets keeps one row of nulls."""
    return publishers(spark).select("code", F.explode_outer("targets").alias("target")).select("code", "target.*")


def publisher(spark: SparkSession, code: str) -> DataFrame:
    return publishers(spark).where(F.col("code") == code)


def detail_profiles(spark: SparkSession, profiles=DETAIL_PROFILES) -> DataFrame:
    """Site profiles of the detail scan; a new site is one more record."""
    rows = [
        {"date_regex": None, "file_regex": None, "file_download_template": None, "title_section_marker": "", "baseline_id": 1,
         "scan_window": 100, **p, "file_has_name": re.compile(p.get("file_regex") or "").groups >= 2, "position": i}
        for i, p in enumerate(profiles)
    ]
    return spark.createDataFrame(rows, DETAIL_SCHEMA)


def page_profiles(spark: SparkSession, profiles=PAGE_PROFILES) -> DataFrame:
    return spark.createDataFrame([{"date_regex": None, "download_url_template": "", **p, "position": i} for i, p in enumerate(profiles)], PAGE_SCHEMA)


def first_profile(profiles: DataFrame, agency_code: str) -> DataFrame:
    """The first registered profile of an agency."""
    return profiles.where(F.col("agency_code") == agency_code).orderBy("position").limit(1)


def keyword_lists(spark: SparkSession) -> DataFrame:
    rows = [(kind, text, i, word) for kind, text, words in fv.KEYWORD_LISTS for i, word in enumerate(words)]
    return spark.createDataFrame(rows, "kind string, description string, position int, keyword string")
