"""Lexicons, weights and limits as data. Everything here is a default; each operator takes its own."""

from __future__ import annotations

from dataclasses import dataclass, field

# Patterns of the noise rules, in the order in which they are tried.
DROP_URL = [r"/issues/\d+", r"/pull/\d+", r"/commit/[a-f0-9]+", r"/actions/"]
KEEP_TITLE = [r"(?i)^(feat|release|breaking)(\(|:)", r"v\d+\.\d+"]
DROP_TITLE = [r"(?i)^(fix|chore|ci|docs|build|test|refactor)(\(|:)", r"^Merge pull request", r"^Bump "]

# Lexicons.
TOPIC_KEYWORDS = [
    "artificial intelligence", "machine learning", "deep learning", "large language model", "LLM", "GPT", "Claude", "Gemini", "OpenAI", "Anthropic", "DeepSeek", "Meta AI", "Google AI",
    "transformer", "neural network", "AGI", "AI safety", "computer vision", "NLP", "reinforcement learning", "diffusion model", "generative AI", "foundation model", "fine-tuning", "RAG", "agent",
    "multimodal", "Llama", "Mistral", "Gemma", "Copilot", "ChatGPT", "人工智能", "大模型", "深度学习", "机器学习", "大语言模型", "AI", "智能体", "向量数据库",
    "百度", "文心", "通义", "千问", "豆包", "Kimi", "智谱", "百川", "月之暗面", "MiniMax", "零一万物", "商汤", "科大讯飞", "寒武纪", "Qwen",
]
TOP_ENTITIES = ["OpenAI", "Google", "DeepMind", "Anthropic", "Meta", "Apple", "Microsoft", "DeepSeek", "NVIDIA", "xAI", "Mistral"]
SECOND_ENTITIES = ["Hugging Face", "Stability AI", "Cohere", "AI21", "Inflection", "Character.AI", "Midjourney", "Runway", "Perplexity", "百度", "阿里", "字节跳动", "腾讯", "华为", "小米"]
CHINESE_ENTITIES = [
    "36氪", "36Kr", "商汤", "科大讯飞", "寒武纪", "旷视", "云从", "第四范式", "蚂蚁集团", "京东", "美团", "网易", "快手", "哔哩哔哩", "阶跃星辰", "StepFun", "面壁智能", "ModelBest", "昆仑万维",
    "文心一言", "文心大模型", "通义千问", "通义", "豆包", "Kimi", "智谱", "GLM", "ChatGLM", "百川", "MiniMax", "零一万物", "月之暗面", "DeepSeek", "Qwen", "SenseTime",
    "可灵", "Kling", "即梦", "Jimeng", "讯飞星火", "星火", "SparkDesk", "天工AI", "天工", "Skywork", "Yi", "MiniCPM", "CPM", "杨植麟", "王小川", "李彦宏", "马化腾", "张一鸣", "何恺明", "朱松纯",
]
NOTABLE_ENTITIES = ["Sam Altman", "Demis Hassabis", "Yann LeCun", "Ilya Sutskever", "Dario Amodei", "李彦宏", "马斯克", "Elon Musk", "John Jumper", "Noam Shazeer"]
OFFICIAL_BLOGS = ["openai.com", "anthropic.com", "ai.meta.com", "blogs.nvidia.com", "blog.google", "mistral.ai", "deepmind.google"]
STOP_WORDS = ["the", "a", "an", "is", "are", "was", "in", "on", "at", "to", "for", "of", "and", "or", "with", "的", "了", "在", "是", "和", "与"]
SOURCE_WHITELIST = [
    "openai.com", "anthropic.com", "ai.meta.com", "blogs.nvidia.com", "blog.google", "deepmind.google", "mistral.ai", "huggingface.co", "huggingface", "openai", "anthropic", "meta",
    "google deepmind", "google ai", "techcrunch", "theverge", "wired", "arxiv.org", "export.arxiv.org", "apple", "lesswrong", "qbitai",
]
HARD_REJECT = [
    "ipo", "ipo上市", "上市申请", "过会", "招股书", "股价", "市值", "股权投资", "股权质押", "娱乐圈", "影视", "综艺", "票房", "网播", "漫画", "动画", "小说", "游戏攻略", "菜谱", "健身", "穿搭", "美妆",
    "起诉", "侵权", "赔偿", "商标", "维权", "胜诉", "败诉", "房价", "楼市", "土拍", "房贷", "中超", "CBA", "NBA", "奥运会", "leetcode每日一题",
]
RELEVANT = [
    "ai", "artificial intelligence", "machine learning", "deep learning", "large language model", "llm", "gpt", "claude", "gemini", "openai", "anthropic", "deepseek", "meta ai", "google ai",
    "transformer", "neural network", "agi", "diffusion model", "generative ai", "foundation model", "fine-tuning", "rag", "agent", "multimodal", "attention", "mixture-of-experts", "forecasting",
    "recommender", "diffusion", "rlhf", "dpo", "reinforcement learning", "llama", "mistral", "gemma", "copilot", "chatgpt", "人工智能", "大模型", "深度学习", "机器学习", "大语言模型", "智能体",
    "向量数据库", "模型发布", "开源模型", "新模型", "gpu", "hpc", "算力", "芯片", "自动驾驶", "机器人", "外骨骼", "仿生", "融资", "funding", "收购", "量化", "quantitative", "交易", "模型", "算法", "数据", "训练",
]
NEUTRAL = ["企业", "公司", "科技", "创新", "数字化", "转型", "战略", "合作", "投资"]
HOT_TOPICS = ["agent", "reasoning", "alignment", "multimodal", "AGI", "safety", "scaling law", "RLHF", "DPO", "diffusion", "context", "long context", "token"]
MODEL_NAMES = ["GPT", "Claude", "Gemini", "Llama", "DeepSeek", "Mistral", "Gemma", "Qwen"]
SOTA_WORDS = ["SOTA", "state-of-the-art", "outperform", "surpass", "beat"]
#: alias, canonical name, publisher type, trust.
PUBLISHERS = [
    ("techcrunch", "TechCrunch", "media", 4), ("theverge", "The Verge", "media", 4), ("wired", "Wired", "media", 4), ("arstechnica", "Ars Technica", "media", 4), ("semafor", "Semafor", "media", 3),
    ("axios", "Axios", "media", 4), ("mit-technology-review", "MIT Technology Review", "media", 4), ("simon-willison", "Simon Willison Blog", "personal", 3), ("lesswrong", "LessWrong", "community", 3),
    ("hacker-news", "Hacker News", "community", 2), ("arxiv-cs-ai", "arXiv CS.AI", "academic", 5), ("arxiv-cs-cl", "arXiv CS.CL", "academic", 5), ("openai", "OpenAI", "official", 5),
    ("anthropic", "Anthropic", "official", 5), ("google-ai", "Google AI", "official", 5), ("meta-ai", "Meta AI", "official", 5), ("nvidia", "NVIDIA", "official", 5), ("huggingface", "HuggingFace", "official", 5),
    ("aws-ml", "AWS ML", "official", 5), ("deepmind", "DeepMind", "official", 5), ("36kr", "36氪", "media", 3), ("huxiu", "虎嗅", "media", 3), ("qbitai", "量子位", "media", 3),
]


@dataclass(frozen=True)
class EventType:
    name: str
    score: int
    keywords: tuple[str, ...] = ()
    pattern: str | None = None


# Event types in declaration order.
EVENT_TYPES = [
    EventType("model_release", 10, ("发布", "release", "launch", "announce", "unveil", "新模型", "新版本"), r"(?i)(?<![A-Za-z0-9_])(GPT-\d|Claude\s*\d|Gemini\s*\d|V\d|Llama\s*\d|Mistral)(?![A-Za-z0-9_])"),
    EventType("funding", 8, ("融资", "funding", "raised", "valuation", "估值"), r"(\$[\d.]+[bBmM]|[\d.]+亿|[\d.]+亿美元|(?<![A-Za-z0-9_])billion(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])million(?![A-Za-z0-9_]))"),
    EventType("policy", 7, ("政策", "regulation", "ban", "监管", "立法", "government", "EU", "白宫")),
    EventType("breakthrough", 7, ("breakthrough", "state-of-the-art", "SOTA", "突破", "首次", "first")),
    EventType("open_source", 5, ("开源", "open source", "open-source", "GitHub", "Apache")),
    EventType("talent_movement", 5, ("加入", "离开", "joins", "leaves", "hires", "appointed", "离职", "跳槽")),
    EventType("partnership", 4, ("合作", "partnership", "collaboration")),
    EventType("acquisition", 6, ("收购", "acquire", "acquisition", "合并")),
]


@dataclass(frozen=True)
class EntityTier:
    name: str
    entities: tuple[str, ...]
    score: int


ENTITY_TIERS = [
    EntityTier("top_tier", tuple(TOP_ENTITIES), 10), EntityTier("second_tier", tuple(SECOND_ENTITIES), 6),
    EntityTier("chinese_tech", tuple(CHINESE_ENTITIES), 6), EntityTier("notable", tuple(NOTABLE_ENTITIES), 5),
]


@dataclass(frozen=True)
class Scoring:
    tier_scores: dict[int, int] = field(default_factory=lambda: {1: 20, 2: 15, 3: 7})
    #: (most hours, score), then the score of anything older and of rows without a date.
    freshness: tuple[tuple[float, int], ...] = ((1, 15), (3, 13), (6, 11), (12, 8), (24, 5))
    oldest: int = 2
    entity_tiers: tuple[EntityTier, ...] = tuple(ENTITY_TIERS)
    multi_entity_bonus: int = 2
    event_types: tuple[EventType, ...] = tuple(EVENT_TYPES)
    general_score: int = 2
    auto: int = 70
    review: int = 55
    source_caps: dict[str, int] = field(default_factory=lambda: {"arxiv-cs-ai": 5, "arxiv-cs-cl": 5, "techcrunch": 3, "36kr": 3})
    default_cap: int = 3
    skip_after_hours: float = 48.0


@dataclass(frozen=True)
class Lane:
    lane: str
    domain: str
    most: int


LANES = [Lane("research", "research", 20), Lane("industry", "industry", 20), Lane("policy", "policy", 10), Lane("opensource", "opensource", 10), Lane("fallback", "__fallback__", 5)]


@dataclass(frozen=True)
class Editorial:
    pool_size: int = 40
    boost_cap: int = 30
    per_category: int = 8
    follow_up_weight: int = -10
    follow_up_days: int = 3
    memory_days: int = 7
    top_entities: tuple[str, ...] = tuple(TOP_ENTITIES)
    official_blogs: tuple[str, ...] = tuple(OFFICIAL_BLOGS)
    breaking_types: tuple[str, ...] = ("model_release", "acquisition")
    backfill_below: int = 20
    backfill_most: int = 10
    backfill_score: int = 40
    backfill_sources: tuple[str, ...] = ("huggingface-blog", "openai", "anthropic", "google-ai-blog", "deepmind")
    non_ai_ratio: float = 0.05
    single_source_ratio: float = 0.35
