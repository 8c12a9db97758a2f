"""Word lists, patterns and lookup tables that results depend on.

Patterns are written for Java regex; callers add the flags (`(?dU)`, `(?diU)`), so `\\s`, `\\w` and
`\\b` are Unicode-aware and only a line feed ends a line.
"""

# --- fixed values: title normalisation ---------------------------------------------------------
PAREN_SUFFIX = r"\s*[\(\[][^\)\]]*[\)\]]\s*$"
YEAR_SUFFIX = (
    r"[\(\[\s]?(20\d{2})\s*[년판]?[\)\]\s]?[\s]*(?:개정|수정|제정)?(?:판|본|버전|version|v\d+)?[\s]*$"
)
NUMBER_SUFFIX = r"[\s_\-]?v?(\d+(?:\.\d+)?)\s*(?:판|본|버전|version)?[\s]*$"
NOISE_SUFFIX = r"[\s]*(안내|배포|공고|공지|게시|알림|발간|제정|개정|수정|전부개정|일부개정)[\s]*$"
PAREN_YEAR = r"[\(\[](20\d{2})\s*[년판본]?[^\)\]]*[\)\]]"

# --- fixed values: title classification --------------------------------------------------------
STRONG_TITLE = (
    "가이드라인", "가이드(?!라인)", "안내서", "지침서", "지침(?!서)",
    "핸드북", "해설서", "매뉴얼", "사례집", "체크리스트", "점검표",
    r"표준\(?안?\)?", "규격", "모음집", "이용지침",
    "백서", "연례보고서", "연간보고서", r"정보보호\s*보고서",
)
EXCLUDED_TITLE = (
    r"설명회\s*안내", r"개최\s*안내", r"모집\s*안내", r"조사\s*안내",
    r"공모전?\s*안내", r"신청\s*안내", r"세미나\s*안내", r"포럼\s*안내",
    r"교육생?\s*안내", r"과정\s*안내", r"장애\s*안내", r"사칭\s*안내",
    r"주의\s*안내", r"변경\s*안내", r"결과\s*안내", r"청강\s*안내",
    "콘퍼런스", "해커톤", "Hackathon", "경진대회", "공모전", "서포터즈",
    "인턴십", "공청회", "투표단", "시상", "검증$", "공개검증",
    "재분류", r"선정기준을\s*마련", r"채용자와\s*재직", r"친인척\s*현황",
    r"청렴도\s*평가", "탄소중립", "사전조사", "수요조사", r"만족도\s*조사",
    r"공표\s*예정일", r"시스템\s*장애", r"이름\s*공모",
    r"사업자\s*선정", "수요기관", "평가위원", r"컨설팅\s*지원",
    "Alliance", r"공개\s*모집", "참여기업", r"설명회\s*자료",
    "오피스텔", "지방공무원", "지방세", "시가표준액", "보수업무",
    "정주생활지원금", "개방형직위", "공모직위", "지방규제",
    "지방별정직", "인사운영", "민원행정", r"제도개선\s*기본",
    "국가표준.*시행계획", "국가표준기본계획",
    "합동.*발표$", r"국제표준\s*됐다",
    r"시행계획\s*공고", "입안예고",
    r"추진계획\s*[\(（]", r"추진계획\s*$", r"종합계획\s*수립", "수립결과", r"선정제품\s*목록",
    "교육교재", r"교육과정\s*안내", r"인식제고\s*교육", r"수칙\s*팜플렛",
    r"운영방안\s*안내", r"평가\s*운영방안",
    r"안내서\s*전체\s*목록",
)
ANNOUNCEMENT_TITLE = (
    r"(?:^|\s|['\"’”])발표(?:$|\s|['\"‘“])",
    r"발표\s*$",
    "보도자료",
    "공고$", r"공고\s",
    r"배포\s*(?:안내|알림)?\s*$",
    r"제정\s*(?:안내|알림)?\s*$",
    r"개정\s*(?:안내|알림)?\s*$",
    r"발간\s*(?:안내|알림)?\s*$",
)

# --- fixed values: category rules, first match wins --------------------------------------------
CATEGORY_RULES = (
    ("finance", False, (
        "전자금융", "금융보안", "핀테크", "자본시장", "신용정보", "ETF", "ELS", "IPO", "코너스톤",
        "상장", "증권", "채무조정", "공모주", "펀드", "자산운용", "보험", "은행", "여신", "대출",
        "금융기관", "금융회사", "금융규제", "금융투자", "금융감독",
    )),
    ("ai", True, (
        "인공지능", r"AI\b", "AI[가-힣]", "자율주행", "로봇", "드론", "지능정보", "LLM",
        "생성형", "메타버스", "머신러닝", "딥러닝",
    )),
    ("privacy", False, (
        "개인정보", "프라이버시", "가명정보", "가명.*익명", "영상정보", "CCTV", "생체정보",
        "마이데이터", "CPO", "위치정보", "접근배제", "정보주체",
    )),
    ("info_security", False, (
        "정보보호", "정보보안", "사이버", "보안모델", "취약점", "침해", "제로트러스트", "ISMS",
        "암호", "시큐어코딩", "보안약점", "OWASP", "CSAP", "IoT", "보안가이드",
        "보안취약", "보안인증", "보안업무", "보안관리", "통신비밀", "주요정보통신기반",
        "해운.*보안", "항만.*보안", "기반시설.*보안", "포렌식", "악성", "랜섬", "해킹",
    )),
    ("cloud", False, ("클라우드", "Cloud", "SaaS", "PaaS", "IaaS")),
    ("software", False, (
        "소프트웨어", r"SW\s", "SW사업", "SW융합", "대가산정", "개발보안", "공개SW", "영향평가",
        "ISP", "ISMP", r"프로젝트\s*규모", "오토파일럿", "SW안전",
    )),
    ("data", False, ("데이터", "빅데이터", "공공데이터", r"품질관리\s*지침", "블록체인", "전력거래")),
    ("e_gov", False, (
        "전자정부", "정보시스템", "감리", "정보화", "웹사이트", "UI/UX", "표준운영",
        "정보자원", "코드표준", "스마트워크", "모바일.*서비스", "전자민원",
        "스마트빌리지", "영상회의", "인터넷전화", "정보통신서비스", "GNS",
        r"디지털\s*(정부|공공|서비스|포용|혁신|전환)", "공공기관", "행정",
    )),
)
CATEGORY_BY_AGENCY = {
    "FSC": "finance",
    "FSI": "finance",
    "KISA": "info_security",
    "NIS": "info_security",
    "PIPC": "privacy",
    "SPRI": "software",
}
DEFAULT_CATEGORY = "other"

# --- fixed values: collection keywords ---------------------------------------------------------
GUIDELINE_KEYWORDS = (
    "가이드라인", "가이드", "지침", "안내서", "매뉴얼", "기준",
    "해설서", "안내", "표준", "핸드북", "가이드북", "점검표",
    "보고서", "백서", "사례집",
)
ANNOUNCEMENT_KEYWORDS = GUIDELINE_KEYWORDS + (
    "고시", "시행령", "시행규칙", "훈령", "예규", "규정",
    "개정", "제정", "폐지",
    "방안", "대책",
)
KEYWORD_LISTS = (
    ("guideline", "가이드라인/안내서/매뉴얼 관련 게시판에서 사용하는 키워드", GUIDELINE_KEYWORDS),
    ("announcement", "보도자료/공지사항 게시판에서 가이드라인·법령 발표성 글만 필터링하는 키워드", ANNOUNCEMENT_KEYWORDS),
)

# --- fixed values: law search ------------------------------------------------------------------
LAW_SEARCH_TERMS = {
    "PIPC": ("개인정보보호위원회",),
    "MSIT": ("과학기술정보통신부",),
    "KISA": ("한국인터넷진흥원",),
    "NIS": ("국가정보원",),
    "FSC": ("금융위원회",),
    "NIA": ("한국지능정보사회진흥원",),
    "MOIS": ("행정안전부",),
    "KCC": ("방송통신위원회",),
}
LAW_RELEVANCE_KEYWORDS = (
    "정보보호", "정보보안", "개인정보", "사이버", "보안",
    "소프트웨어", "전자정부", "클라우드", "인공지능", "데이터",
    "전자금융", "핀테크", "암호", "인증", "접근통제",
    "정보통신", "전자서명", "전자문서", "망분리", "정보시스템",
    "주요정보통신기반", "통신비밀", "스팸", "이용자보호",
)
LAW_RULE_TYPES = {"고시": "고시", "훈령": "훈령", "예규": "예규", "규칙": "고시"}
LAW_DEFAULT_RULE_TYPE = "고시"
LEGAL_BASIS_TYPES = {"고시": "gosi", "훈령": "hunryeong", "예규": "yegyu"}
DEFAULT_LEGAL_BASIS_TYPE = "gosi"
LAW_HOST = "https://www.law.go.kr"
LAW_TITLE_PATH = "/행정규칙/"
LAW_AUTH_FAILURE = "검증에 실패"
LAW_FIELDS = {
    "title": "행정규칙명",
    "serial": "행정규칙일련번호",
    "rule_type": "행정규칙종류",
    "promulgated": "발령일자",
    "enforced": "시행일자",
    "link": "행정규칙상세링크",
    "ministry": "소관부처명",
}

# --- fixed values: page text -------------------------------------------------------------------
DROPPED_ELEMENTS = ("script", "style", "nav", "header", "footer")
DROPPED_CLASSES = ("gnb", "lnb")
CONTENT_CONTAINERS = (
    ("class", "board_view_con"),
    ("class", "bbs_view_con"),
    ("class", "view_con"),
    ("class", "board_view"),
    ("class", "bbs_detail"),
    ("id", "contents"),
    ("tag", "article"),
    ("tag", "main"),
)
ATTACHMENT_EXTENSION = r"[\w가-힣\-_]+\.(pdf|hwp|hwpx|docx?|xlsx?|pptx?)"
DETAIL_ATTACHMENT_SUFFIXES = (".pdf", ".hwp", ".hwpx")
NEW_POST_MARK = r"\(새 글\)"
ATTACHMENT_MARK = r"-첨부파일 있음$"
SCRIPT_LINK_HREFS = ("#view", "#", "#LINK")
# (pattern on onclick, url template; {1} and {2} are its groups)
SCRIPT_LINK_RULES = (
    (r"doBbsFView\('(\d+)','(\d+)'", "/site/nia_kor/ex/bbs/View.do?cbIdx={1}&bcIdx={2}"),
    (r"fn_inqire_notice\('(\d+)','([^']+)'", "/main/cop/bbs/selectBoardArticle.do?bbsId={2}&nttId={1}"),
)
URL_DISCRIMINATOR = r"(menuNo=\d+|cbIdx=\d+|boardId=\d+|bbsId=[^&]+)"

# --- fixed values: borderline question ---------------------------------------------------------
BORDERLINE_QUESTION = """\
다음 게시물이 IT/정보보안/개인정보/SW 분야의 \
가이드라인·지침·안내서·표준·매뉴얼·해설서·프레임워크·백서·로드맵·권고 문서인지 판단하세요.

제목: {title}
게시판: {board_label}
기관: {agency_name}
{body_section}

판단 기준:
- 실제 문서(PDF/HWP) 형태로 배포되는 기술 지침·기준이면 YES
- 보도자료, 행사 안내, 뉴스, 채용, 홍보성 글이면 NO
- 비-IT 분야(인사, 세금, 부동산, 복지 등)면 NO
- 법령 개정 소식만 전하는 글이면 NO (법령 자체의 해설서는 YES)
- 추진계획, 종합계획, 업무계획 등 정책 계획서면 NO
- 선정제품 목록, 평가결과 등 단순 리스트면 NO
- 교육교재, 교육과정, 인식제고 자료면 NO
- 운영방안, 사업계획, 수립결과 등 내부 운영문서면 NO

YES 또는 NO만 답하세요."""
BODY_PART = "본문 첫 500자: "
ATTACHMENT_PART = "첨부파일 확장자: "
NO_BODY_PART = "본문: (추출 불가)"
REASON_ANSWER = "LLM="
REASON_ATTACHMENTS = "첨부="
REASON_NO_BODY = "본문추출실패"
SNIPPET_CHARS = 500

# --- fixed values: report thresholds and texts -------------------------------------------------
MIN_REVISION_GAP_DAYS = 7
STALE_DAYS = 14
RECENT_DAYS = 30
MANIFEST_SCHEMA_VERSION = "1.0.0"
MANIFEST_TTL_HOURS = 48
HEALTH_DETAIL = {
    "never_crawled": "크롤 이력 없음",
    "all_failed": "크롤 실패: ",
    "zero_keyword_match": "대상 키워드 매칭 게시물 없음 (게시판 접근은 정상)",
    "stale": "최근 2주+ 미실행",
}
