"""Names, weights, bounds, cue words and templates.

Everything in this module is a constant of the data model, stated as text in
its natural order. Nothing here is derived from data.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: graph domains -------------------------------------------
NODE_TYPES = ("topic", "entity", "event", "emotion", "audience", "product")
NODE_COLORS = {
    "topic": "#4f9dff",
    "entity": "#27c2a0",
    "event": "#f5a623",
    "emotion": "#ff5d73",
    "audience": "#a06bff",
    "product": "#ffd166",
}
UNKNOWN_COLOR = "#8892a6"
RELATION_WEIGHTS = {
    "related_to": 0.5,
    "causes": 0.8,
    "similar_to": 0.4,
    "leads_to": 0.6,
    "monetizes_via": 0.9,
    "triggers_emotion": 0.7,
    "belongs_to_event": 0.65,
}
DEFAULT_EDGE_WEIGHT = 0.5
CAMPAIGN_TYPES = ("trending", "seasonal", "breaking", "planned")

# --- fixed values: scoring -------------------------------------------------
GRAPH_SCORE_WEIGHTS = {"edge_sum": 0.30, "centrality": 0.25, "trend_score": 0.30, "event_boost": 0.15}
RANK_BLEND = {"graph": 0.4, "revenue": 0.4, "probability": 0.2}
MIN_GRAPH_SCORE = 0.35
CTR_PRIORS = {
    "blog": (2.0, 98.0),
    "youtube": (4.0, 96.0),
    "instagram": (3.5, 96.5),
    "newsletter": (5.0, 95.0),
    "shorts": (4.5, 95.5),
}
DEFAULT_CTR_PRIOR = (1.0, 99.0)
CPM = {"blog": 4.5, "youtube": 7.0, "instagram": 5.5, "shorts": 3.0, "newsletter": 12.0}
DEFAULT_CPM = 1.0
STREAM_WEIGHTS = {"cpm_ads": 0.30, "affiliate": 0.35, "subscription": 0.20, "digital_product": 0.15}
STREAM_FACTORS = {"cpm_ads": 1.0, "affiliate": 1.5, "subscription": 3.0, "digital_product": 2.0}
RISK_WEIGHTS = {"copyright_risk": 0.40, "controversy_risk": 0.30, "saturation_risk": 0.30}
EMOTION_BOOST = {"joy": 1.2, "fear": 1.4, "anger": 1.3, "surprise": 1.5, "sadness": 0.8, "neutral": 1.0}
EMOTION_BOUNDS = (0.5, 1.8)
WEIGHT_BOUNDS = (0.01, 10.0)
LEARNING_RATE = 0.01
GRADIENT_CLIP = 1.0
MIN_PORTFOLIO_WEIGHT = 0.01
MAX_PER_TOPIC = 2

# --- fixed values: time ----------------------------------------------------
HALF_LIFE_DAYS = 7.0
VELOCITY_HOURS = 24
ACCELERATION_HOURS = 6
SEASONAL_BOUNDS = (0.5, 2.0)
EVENT_BOOST_BOUNDS = (1.0, 3.0)
EVENT_JACCARD_MIN = 0.30
CHECKPOINTS = {"1h": (1, 0.10), "24h": (24, 0.40), "72h": (72, 0.75), "7d": (168, 0.95), "30d": (720, 1.00)}

# --- fixed values: metric log ----------------------------------------------
METRIC_KEYS = ("views", "clicks", "ctr", "watch_time", "shares", "revenue_est", "attributed_revenue")
RUN_BUCKETS = (0.1, 0.5, 1.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0, 600.0)
REQUEST_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)

# --- fixed values: platforms (max_chars, daily quota, hashtag limit) ---------
PLATFORMS = {
    "naver": (100000, 25000, 0),
    "reddit": (40000, 10000, 0),
    "youtube": (5000, 10000, 15),
    "rss": (100000, 100000, 0),
    "google_news": (100000, 5000, 0),
    "blog": (30000, 1000, 10),
    "instagram": (2200, 200, 30),
    "shorts": (200, 200, 15),
    "newsletter": (50000, 5000, 0),
    "music": (2000, 5000, 10),
    "ecommerce": (5000, 10000, 0),
}
BLOG_MAX_CHARS = {"naver_blog": 10000, "wordpress": 20000, "blog": 20000}
BLOG_MAX_CHARS_DEFAULT = 5000
FEATURE_PLATFORMS = ("blog", "youtube", "instagram", "shorts", "newsletter")
SHORT_VIDEO_MAX_WORDS = 160

# --- fixed values: text cues -----------------------------------------------
EMOTION_CUES = {
    "joy": ["happy", "great", "love", "awesome", "기쁘", "행복", "좋아", "うれし", "楽し"],
    "anger": ["angry", "furious", "hate", "outrage", "화나", "분노", "怒", "むかつく"],
    "fear": ["afraid", "scared", "fear", "danger", "두려", "무서", "공포", "怖", "不安"],
    "sadness": ["sad", "depressed", "cry", "슬프", "우울", "悲し", "つらい"],
    "surprise": ["surprise", "shock", "wow", "amazing", "놀라", "충격", "驚", "びっくり"],
    "disgust": ["disgust", "gross", "nasty", "역겨", "혐오", "気持ち悪", "嫌"],
}
INTENT_CUES = {
    "transactional": ["buy", "order", "purchase", "checkout", "구매", "주문", "결제", "購入", "買"],
    "commercial": ["best", "review", "compare", "vs", "추천", "리뷰", "비교", "おすすめ", "比較"],
    "navigational": ["login", "website", "official", "homepage", "로그인", "공식", "홈페이지", "ログイン"],
    "informational": ["how", "what", "why", "guide", "방법", "무엇", "왜", "とは", "方法"],
}
EMOTION_CONF_MIN = 0.70
INTENT_CONF_MIN = 0.65
STOPWORDS = ("the a an and or of to in on for is are this that with it as be by at from").split()

# --- fixed values: entity aliases (surface -> qid, canonical) ----------------
ENTITY_QIDS = {
    "openai": "Q21708200",
    "open ai": "Q21708200",
    "nvidia": "Q182477",
    "google": "Q95",
    "alphabet": "Q20800404",
}
ENTITY_ALIASES = {
    "openai": ("Q21708200", "OpenAI"),
    "open ai": ("Q21708200", "OpenAI"),
    "nvidia": ("Q182477", "Nvidia"),
    "google": ("Q95", "Google"),
    "alphabet inc": ("Q20800404", "Alphabet Inc."),
}
ENTITY_CONFIDENCE = 0.90
ENTITY_CONFIDENCE_MIN = 0.85

# --- fixed values: compliance and quality ------------------------------------
LICENSE_RISK = {
    "cc0": 0.0,
    "cc-by": 0.05,
    "cc-by-sa": 0.10,
    "public-domain": 0.0,
    "mit": 0.0,
    "fair-use": 0.30,
    "all-rights-reserved": 0.60,
}
LICENSE_RISK_DEFAULT = 0.40
COPYRIGHT_SAFE_MAX = 0.30
BANNED_TERMS = ("100% safe", "clickbait", "get rich quick", "guaranteed profit", "miracle cure")
READABILITY_MIN = 60.0
CRAWL_DELAY_DEFAULT = 1.0
# Patterns in claim order, with the token that replaces a hit.
PII_PATTERNS = (
    ("email", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    ("krrn", r"\b\d{6}[-\s]?\d{7}\b", "[RRN]"),
    ("credit_card", r"\b(?:\d[ -]?){13,16}\b", "[CARD]"),
    ("phone_kr", r"\b01[016789][-\s]?\d{3,4}[-\s]?\d{4}\b", "[PHONE]"),
    ("phone_intl", r"\+?\d{1,3}[-\s]?\(?\d{2,4}\)?[-\s]?\d{3,4}[-\s]?\d{4}\b", "[PHONE]"),
)

# --- fixed values: output templates -----------------------------------------
EMOTION_EMOJI = {
    "joy": "😊",
    "anger": "😤",
    "fear": "😨",
    "sadness": "😢",
    "surprise": "😲",
    "disgust": "🤢",
    "unknown": "📝",
}
VIDEO_HOOKS = {
    "surprise": "You won't believe what just happened with",
    "fear": "Here's the hidden risk in",
    "joy": "This is the best thing about",
    "anger": "Why everyone is furious about",
    "sadness": "The hard truth about",
    "disgust": "The ugly side of",
}
VIDEO_HOOK_DEFAULT = "Here's what you should know about"
VIDEO_CTA = {"shorts": "Follow for daily shorts!", "instagram": "Save this and follow for more!"}
VIDEO_CTA_DEFAULT = "Like and follow for more!"
BLOG_TITLE = "%s %s 완전 분석 — 알아야 할 모든 것"
BLOG_BODY = (
    "## %1$s이란?\n\n%1$s에 대한 최신 트렌드와 핵심 정보를 정리했습니다.\n\n"
    "## 왜 중요한가?\n\n현재 %1$s은 많은 주목을 받고 있습니다. 특히 %2$s 측면에서 중요한 변화가 있습니다.\n\n"
    "## 앞으로의 전망\n\n전문가들은 %1$s의 지속적인 성장을 예측하고 있습니다."
)
BLOG_CTA = "구독하고 최신 트렌드를 놓치지 마세요!"
BLOG_PROMPT = (
    "당신은 한국어 콘텐츠 마케터입니다.\n주제: %s\n감정: %s %s\n키워드: %s\n\n"
    "다음 구조로 블로그 포스트를 작성해주세요:\n1. 제목 (50자 이내, 감정 유발)\n"
    "2. 리드 문단 (100자, 핵심 요약)\n3. 본문 섹션 3개 (각 200자, H2 제목 포함)\n"
    "4. CTA (30자, 구독/공유 유도)\n5. 해시태그 5개\n\n"
    "응답 형식: JSON {'title': ..., 'body': ..., 'cta': ..., 'hashtags': [...]}"
)
DIGEST_TITLE = "Your Weekly Digest"
DIGEST_SUBTITLE = "The top stories we picked for you"
DIGEST_FOOTER = "You are receiving this because you subscribed. Unsubscribe anytime."


def literal_map(values: dict) -> Column:
    """A constant MAP column; lookups of missing keys give NULL."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def lookup(values: dict, key: Column, default=None) -> Column:
    """``values[key]`` as a CASE-free literal-map lookup with a default."""
    hit = F.try_element_at(literal_map(values), key)
    return hit if default is None else F.coalesce(hit, F.lit(default))


def literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])
