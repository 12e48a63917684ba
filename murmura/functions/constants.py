"""Fixed values that must equal the behaviour being reproduced.

They are operator defaults; every operator takes them as parameters.
"""

# --- fixed values ---------------------------------------------------------
# Board / document categories excluded before relevance scoring.
EXCLUDE_CATEGORIES = ["장터", "중고", "팝니다", "삽니다", "판매", "스포츠", "게임", "정치"]

# Sentiment labels: positive, negative, neutral.
POSITIVE = "긍정"
NEGATIVE = "부정"
NEUTRAL = "중립"

# Terms that disqualify a text from being quoted as a top opinion.
PROFANITY = ["시발", "씨발", "개새", "병신", "좆", "보지", "자지", "쌍년", "새끼야", "미친놈", "존나", "지랄"]

# Topic names containing one of these markers are dropped.
TOPIC_DROP_MARKERS = ["무관", "의견이 없"]
TOPIC_MAX_NAME_LEN = 30

# Run id format (Java pattern) and its strftime twin.
RUN_ID_PATTERN = "yyyy-MM-dd'T'HH'h'mm'm'ss's'"

# Document templates (the conversation and the report variant).
CHAT_DOCUMENT_TEMPLATE = "내용 : {page_content}, 날짜 : {postdate}"
REPORT_DOCUMENT_TEMPLATE = "내용 : {page_content}, 날짜 : {postdate}, 출처 : {site}, 조회수 : {views}, 공감수 : {likes}"

# Relevance instruction; {keyword} and {text} are filled per row.
RELEVANCE_PROMPT = (
    "다음 텍스트가 '{keyword}'의 실제 사용 경험, 서비스 품질, 제품 평가에 대한 "
    "사용자 의견을 담고 있으면 'yes'로 시작하여 답하세요.\n"
    "다음의 경우는 반드시 'no'로 답하세요:\n"
    "- 중고거래, 판매글, 구매 문의\n"
    "- '{keyword}'가 단순 언급만 된 글 (글의 주제가 아닌 경우)\n"
    "- 스포츠, 정치, 사회 이슈 등 서비스/제품과 무관한 글\n"
    "- 단순 기술 설정 오류 문의 ('{keyword}' 서비스 경험과 무관한 경우)\n\n"
    "User: {text}"
)

# Sentiment instruction; {keyword} and {text} are filled per row.
SENTIMENT_PROMPT = (
    "다음 텍스트에서 '{keyword}'에 대한 사용자 감성을 분류하세요.\n"
    "'{keyword}' 서비스/제품에 대한 직접적인 의견이 없으면 '중립'으로 분류하세요.\n"
    "'긍정', '부정', '중립' 중 하나로만 답하세요.\n\n{text}"
)

# Topic naming instruction; {keyword} and {sample} are filled per cluster,
# the sample being "- " + the first 150 chars of each of the first 5 texts.
TOPIC_NAME_PROMPT = (
    "다음은 '{keyword}' 관련 커뮤니티 사용자 의견들입니다.\n"
    "이 의견들의 공통 주제를 '{keyword}' 맥락에서 한국어로 5~10자 이내로 간결하게 표현하세요.\n"
    "예: '요금제 불만', '고객센터 불편', '속도/품질 문제', '가격 경쟁력'\n"
    "'{keyword}'와 무관한 의견들이면 '무관'으로만 답하세요.\n\n{sample}"
)
TOPIC_NAME_SAMPLES = 5
TOPIC_NAME_SAMPLE_CHARS = 150

# Report text blocks.
SENTIMENT_HEADER = "[감성 분석 결과 - 전체 {total}개 문서]"
SENTIMENT_LINE = "- {name}: {n}개 ({pct}%)"
TOP_POS_HEADER = "[긍정 대표 의견]"
TOP_NEG_HEADER = "[부정 대표 의견]"
TOPIC_HEADER = "[토픽 클러스터링 결과 - 상위 {n}개 주제]"
TOPIC_LINE = "{i}. {topic}: {count}건 ({pct}%)"
DETAIL_HEADER = "[상세 의견 데이터]"

# Diagram link prefixes (png and svg renderings of a base64 diagram).
DIAGRAM_PNG_PREFIX = "https://mermaid.ink/img/"
DIAGRAM_SVG_PREFIX = "https://mermaid.ink/svg/"
DIAGRAM_MARKER = "mermaid;"

# Page size of the search result pager.
RESULTS_PER_PAGE = 21

# Template parameters shorter than this fall back to their default.
MIN_TEMPLATE_LEN = 6

# Report check: accepted anyway from this iteration on.
MAX_REPORT_ITERATIONS = 2
# --------------------------------------------------------------------------
