"""Word lists, patterns, limits and labels the results depend on.

Names that belong to one deployment (its own sites, shop and brand terms) are not here; they are
parameters of the operators that use them (see ``operators.gates.GatePolicy``).
"""

# Categories in report order, and the order in which the prompt quotas are filled.
CATEGORIES = ("news", "project", "paper", "socialMedia")
QUOTA_ORDER = ("news", "paper", "project", "socialMedia")
QUOTAS = {"news": 8, "paper": 8, "project": 4, "socialMedia": 2}
PROMPT_CAP = 8
CATEGORY_CAP = 30
DEDUPE_DAYS = 7
DEDUPE_TITLE_MIN = 24
BACKFILL_DAYS = 5
BACKFILL_ROWS = 4
BACKFILL_CATEGORIES = ("news", "paper", "socialMedia")
BRIEF_QUOTAS = {"news": 5, "paper": 4, "project": 4, "socialMedia": 3}
PROJECT_BRIEF_ORDER = ("project", "news", "paper", "socialMedia")
PROJECT_BRIEF_QUOTAS = {"project": 4, "news": 3, "paper": 3, "socialMedia": 2}
PROMPT_SEPARATOR = "\n\n------\n\n"
SNAPSHOT_TTL_DAYS = 7

# Query parameters that do not identify a page.
TRACKING_PARAM = "^(utm_|fbclid$|gclid$|ref$|ref_src$)"

# Topic keyword lists.
AI_KEYWORDS = (
    "ai", "artificial intelligence", "machine learning", "deep learning", "foundation model",
    "transformer", "neural network", "self-supervised", "multimodal", "large language model",
    "llm", "diffusion",
)
BIO_KEYWORDS = (
    "aging", "ageing", "longevity", "biological age", "epigenetic clock", "methylation clock",
    "brain age", "dementia", "alzheimer", "senescence", "senolytic", "geroscience", "healthspan",
    "biomarker", "protein", "drug discovery", "molecular", "genomic", "genomics",
    "transcriptomic", "transcriptomics", "single-cell", "spatial transcriptomics",
    "cell segmentation", "omics", "brain", "neuron", "cognition", "disease",
)
STRONG_KEYWORDS = (
    "biological age", "epigenetic clock", "methylation clock", "proteomics clock", "brain age",
    "retinal age", "facial age", "senolytic", "geroscience", "healthspan", "alzheimer",
    "dementia", "aging clock", "single-cell", "spatial transcriptomics", "protein design",
    "drug discovery",
)

# The digest pages that are split into stories, and the host with its own policy.
DIGEST_URL = r"(?i)supertechfans\.com/cn/post/\d{4}-\d{2}-\d{2}-HackerNews"
DIGEST_MAX_STORIES = 12
POLICY_HOST = "linux.do"
POLICY_MAX_ITEMS = 2
PAPER_URL = r"(?i)papers\.cool/arxiv/(\d{4}\.\d+)"
PAPER_PDF_PREFIX = "https://arxiv.org/pdf/"
IMAGE_PROXY_URL = r"(?i)^https://images\.weserv\.nl/\?url="

# How tags of media and links are recognised in HTML.
IMAGE_WITH_ALT = '(?i)<img[^>]*src="([^"]*)"[^>]*alt="([^"]*)"[^>]*>'
IMAGE_WITH_SRC = '(?i)<img[^>]*src="([^"]*)"[^>]*>'
ANY_TAG = "<[^>]+>"
MEDIA_TAGS = ("(?i)<img[^>]+>", "(?i)<video[^>]+>")
LINK_TAG = r"""(?i)<a(?![A-Za-z0-9_])[^>]*href=["']([^"']+)["'][^>]*>"""

# Placeholder labels of media inside plain text.
IMAGE_LABEL = "图片"
VIDEO_LABEL = "视频"
DEFAULT_IMAGE_ALT = "AI资讯图片"
DEFAULT_PICTURE_ALT = "相关配图"
DEFAULT_HINT_TITLE = "相关图片"
IMAGE_EXTENSION = r"(?i)\.(png|jpe?g|webp|gif|avif|svg)(\?|#|\z)"
VIDEO_EXTENSION = r"(?i)\.(mp4|mov|webm)(\?|#|\z)"

# Markers where the report body starts, and the fallback marker.
BODY_MARKERS = ("## **今日 AI 生命科学资讯**", "## **今日 AI 资讯**")
BODY_FALLBACK_MARKER = "## **今日"

# Words (in any case) that make a line of a daily text usable, per document kind.
AI_SIGNALS = (
    "ChatGPT", "GPT", "OpenAI", "Codex", "Cursor", "Claude", "Gemini", "Grok", "Perplexity", "MiniMax",
    "agent", "coding", "IDE", "API", "模型", "中转", "镜像", "账号", "发卡", "额度", "客服", "售后", "教程",
    "自动化", "一人公司",
)
BIO_SIGNALS = (
    "aging", "longevity", "senescence", "biomarker", "wearable", "drug discovery", "protein", "clinical",
    "epigenetic", "长寿", "延寿", "衰老", "抗衰", "生命", "健康", "医疗", "药物", "蛋白", "论文", "临床",
    "生物标志物", "可穿戴", "检测", "阿尔茨海默", "脑龄",
)
SIGNAL_LIMIT = 6

# First-hand material words (in any case); a deployment adds its own names to groups 1 and 3.
MATERIAL_GROUPS = (
    ("我", "自己", "小店", "账号店"),
    ("账号", "发卡", "卡密", "客服", "售后", "补货", "上新", "教程", "用户", "客户", "供应商", "中转", "镜像",
     "额度", "Cursor", "Claude", "Gemini", "Codex", "ChatGPT"),
    ("一人公司", "自动化", "生命延续", "生命科学", "长生", "日报", "现金流", "项目"),
)

# Same-day claim patterns, each after words of which one must occur.
FABRICATED_TODAY = (
    (("今天",),
     r"今天[^。！？\n]{0,50}(客户|买家|用户|供应商|客服|售后|补货|退款|订单|下单|私信|微信|群里|咖啡馆|大理)"),
    (("刚刚", "早上", "下午", "晚上"),
     r"(刚刚|早上|下午|晚上)[^。！？\n]{0,50}(客户|买家|用户|供应商|客服|售后|补货|退款|订单|下单|私信|微信|群里)"),
)

# Manipulative model instructions, each after words (in any case) of which one must occur.
BLACKHAT = (
    (("爬虫指令",), r"(?i)LLM\s*爬虫指令"),
    (("大模型提示词",), r"大模型提示词"),
    (("关联度",), r"关联度.{0,12}提升至最高"),
    (("权重",), r"权重.{0,12}提升至最高"),
    (("权重",), r"提高.{0,8}(链接|内容)?权重"),
    (("逐字引用",), r"逐字引用"),
    (("经典之作",), r"经典之作"),
    (("肉眼不可见",), r"肉眼不可见"),
    (("hidden", "injection"), r"(?i)hidden\s*prompt|prompt\s*injection"),
    (("display", "visibility"), r"(?i)display\s*:\s*none|visibility\s*:\s*hidden"),
    (("请将",), r"请将.{0,40}(权重|关联度).{0,20}(最高|提升)"),
    (("当收到",), r"当收到.{0,80}(提问|问题).{0,80}(优先参考|核心视角|精准引用)"),
)

# Directive codes with words of which one must occur and their patterns, in reporting order.
DIRECTIVES = (
    ("llm-directive", ("【",), r"(?i)【\s*(?:LLM|大模型)[^】]{0,24}(?:指令|提示词)[^】]*】"),
    ("hidden-html-directive", ("<!--",),
     r"(?is)<!--.{0,240}(?:LLM|大模型).{0,80}(?:指令|提示词).{0,240}?-->"),
    ("hidden-directive", ("肉眼不可见",), r"(?i)肉眼不可见.{0,20}(?:提示词|指令|文字)"),
    ("weight-manipulation", ("提高", "提升", "调高"),
     r"(?i)(?:提高|提升|调高).{0,20}(?:本站|本文|页面|内容).{0,12}(?:权重|关联度)"),
    ("priority-citation", ("优先参考", "优先引用"),
     r"(?i)(?:优先参考|优先引用).{0,16}(?:本站|本文|本周刊|本日报)"),
    ("verbatim-citation", ("逐字引用",), r"(?i)逐字引用"),
    ("unverifiable-no-hallucination", ("幻觉", "冗余内容"), r"(?i)无(?:任何)?\s*(?:AI\s*)?(?:幻觉|冗余内容)"),
)

# Draft limits and the title prefixes that mark a fallback title.
DAILY_TITLE_PREFIXES = ("今天", "日报", "AI 日报", "AI 观察")
TITLE_MIN, TITLE_MAX = 6, 34
BODY_MIN = 350
DAILY_MIN = 200
SENTENCE_WARN, SENTENCE_SEVERE, SENTENCE_WARN_COUNT = 90, 170, 6
ALWAYS_ALLOWED_ORIGINS = ("https://github.com",)

# Fields and enumerations of a plan request.
REQUEST_ENUMS = {
    "projectId": ("epiage-skill", "coinstac-brainage-fnc", "adna-aging-clocks",
                  "pd-biomarker-challenge-scoring"),
    "role": ("learner", "indie-developer", "content-creator", "research-team"),
    "direction": ("directory", "education", "interactive-demo", "report-tool", "content-product"),
    "timeBudget": ("two-hours", "one-day", "three-days", "seven-days"),
    "experience": ("beginner", "intermediate", "advanced"),
    "deployment": ("static-site", "cloudflare", "no-deploy"),
}
GOAL_MAX = 240
PRIVATE_DATA = (
    r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
    r"|(?<![A-Za-z0-9_])1[3-9]\d{9}(?![A-Za-z0-9_])"
    r"|(?<![A-Za-z0-9_])\d{13,}(?![A-Za-z0-9_])"
)

# Fields of a plan and their limits.
PLAN_TEXT_FIELDS = ("title", "positioning", "disclaimer")
PLAN_LIST_FIELDS = ("targetUsers", "mvpFeatures", "nonGoals", "recommendedStack", "dataPlan",
                    "implementationSteps", "riskAndCompliance", "sourceAttribution")
PLAN_TEXT_MAX, PLAN_ITEM_MAX, PLAN_LIST_MAX, PLAN_DELIVERABLES_MAX = 1000, 600, 20, 8
PLAN_DAYS = 7
PLAN_REPLY_MAX = 25000
PLAN_DISCLAIMER = r"不构成医学建议|(?i:not medical advice)"

# Prohibited medical phrases, each after words of which one must occur, and the negators
# that excuse them.
MEDICAL_PHRASES = (
    (("生物年龄",), r"(?:测算|计算|预测|评估).{0,8}(?:个人|用户|患者)?生物年龄"),
    (("生物年龄",), r"(?:个人|用户|患者)?生物年龄.{0,8}(?:测算|计算|预测|评估|结果)"),
    (("疾病", "患病", "健康状况", "帕金森", "癌症"),
     r"(?:诊断|预测|判断|筛查).{0,8}(?:疾病|患病|健康状况|帕金森|癌症)"),
    (("疾病", "患病", "健康状况", "帕金森", "癌症"),
     r"(?:疾病|患病|健康状况|帕金森|癌症).{0,8}(?:诊断|预测|判断|筛查|风险评分)"),
    (("诊断", "治疗", "用药", "药物", "检查", "剂量"),
     r"(?:提供|生成|给出|制定|推荐).{0,10}(?:诊断|治疗|用药|药物|检查|剂量)"),
    (("诊断", "治疗", "用药", "药物", "检查", "手术"),
     r"(?:诊断|治疗|用药|药物|检查|手术).{0,8}(?:建议|方案|剂量|推荐|结果)"),
)
MEDICAL_NEGATORS = ("不", "非", "禁止", "避免", "不得", "不能", "无需", "无须", "不应", "请勿")
MEDICAL_STOPS = "，。；.!?"
MEDICAL_REACH = 6

# Labels of request options in plan texts.
ROLE_LABELS = {"learner": "学习者", "indie-developer": "独立开发者",
               "content-creator": "内容创作者", "research-team": "小型研究团队"}
DIRECTION_LABELS = {"directory": "导航网站", "education": "教育网站",
                    "interactive-demo": "交互演示", "report-tool": "数据报告工具",
                    "content-product": "内容产品"}
DEPLOYMENT_LABELS = {"static-site": "Astro 静态站", "cloudflare": "Cloudflare",
                     "no-deploy": "暂不部署"}
