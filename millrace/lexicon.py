"""Default word lists and lookup tables. Every operator takes them as parameters."""

# --- fixed values ------------------------------------------------------------------------------------
PATH_BLACKLIST = [
    "/entertainment/", "/politics/", "/sports/", "/movies/", "/tv/", "/music/", "/celebrity/", "/lifestyle/",
    "/health/", "/food/", "/news/919", "/news/920", "/news/921",
]
TITLE_BLACKLIST = [
    "shooting", "election", "trump", "biden", "putin", "xi jinping", "kim jong", "war in", "ukraine war", "gaza", "israel",
    "celebrity", "kardashian", "taylor swift", "kanye", "beyonce", "royal family", "king charles", "met gala", "oscars",
    "grammy", "nfl", "nba", "world cup", "super bowl", "olympics", "horoscope", "weight loss", "recipe", "gift guide",
    "best gifts", "amazon prime day",
]
PENALTY_WORDS = [
    "review", "hands-on", "hands on", "opinion", "editorial", "first look", "rumor", "rumors", "rumour", "leak", "leaked",
    "leaks", "deal", "deals", "sale", " buy ", "discount", "best price", "accessory", "accessories", "gift guide",
    "sponsored", "promoted", "paid post",
]
BOOST_WORDS = [
    "unveil", "unveils", "introduce", "introduces", "rollout", "rolls out", "benchmark", "model", "reasoning", "agent",
    "agentic", "inference", "training", "fine-tune", "fine-tuning", "multimodal", "embedding", "transformer", "diffusion",
    "chips", "gpu", "tpu", "datacenter", "data center", "openai", "anthropic", "deepmind", "nvidia", "google deepmind",
    "meta ai", "hugging face", "mistral", "stability ai", "security", "vulnerability", "vulnerabilities", "cve-",
    "zero-day", "exploit", "outage", "breach", "data breach", "github", "kubernetes", "postgres", "rust", "typescript",
]
NEWS_VERBS = [
    "launches", "launched", "released", "releases", "announces", "announced", "raises", "raised", "acquires", "acquired",
    "acquisition", "partners with", "open source", "open-source", "open sources", "open-sources", "generally available",
    "general availability",
]
FLUFF_WORDS = [
    "celebrating", "anniversary", "years of", "fun facts", "fun fact", "tips and tricks", "tips & tricks", "for beginners",
    "getting started", "what is", "a beginner", "beginner's guide", "beginners guide", "introduction to",
]
PAPER_WORDS = [
    "llm", "large language model", "language model", "agent", "agentic", "rag ", "retrieval-augmented",
    "retrieval augmented", "reasoning", "multimodal", "vision", "alignment", "safety", "benchmark", "transformer",
    "diffusion", "fine-tun", "fine tun", "instruction tun", "rlhf", "rlaif", "code generation", "robotics", "embodied",
    "world model", "video generation", "image generation", "speech", "tts", "asr", "moe", "mixture of experts",
    "long context", "context window", "token", "evaluation", "eval", "gpt", "claude", "gemini", "llama", "mistral", "qwen",
]
#: Points a hit and the most points, by list.
BOOST_POINTS, PENALTY_POINTS, VERB_POINTS, FLUFF_POINTS = (10, 30), (15, 40), (20, 40), (15, 30)
#: In order; the first domain that equals the host or is a suffix of it at a dot decides.
DOMAIN_TRUST = [
    ("openai.com", 25), ("anthropic.com", 25), ("deepmind.google", 25), ("deepmind.com", 25), ("ai.google", 25),
    ("blog.google", 20), ("huggingface.co", 25), ("meta.com", 20), ("ai.facebook.com", 20), ("ai.meta.com", 20),
    ("mistral.ai", 25), ("x.ai", 25), ("cohere.com", 20), ("arxiv.org", 20), ("paperswithcode.com", 15),
    ("techcrunch.com", 15), ("theverge.com", 15), ("wired.com", 15), ("arstechnica.com", 15), ("bbc.co.uk", 12),
    ("bbc.com", 12), ("nytimes.com", 12), ("wsj.com", 12), ("bloomberg.com", 12), ("reuters.com", 12), ("ft.com", 12),
    ("github.blog", 15), ("github.com", 10), ("stripe.com", 15), ("cloudflare.com", 15), ("vercel.com", 15),
    ("netflixtechblog.com", 15), ("stackoverflow.blog", 12), ("aws.amazon.com", 12), ("azure.microsoft.com", 12),
    ("simonwillison.net", 15), ("latent.space", 15), ("thezvi.substack.com", 10), ("interconnects.ai", 10),
    ("technologyreview.com", 20), ("news.mit.edu", 22), ("nvidia.com", 18), ("blogs.nvidia.com", 20),
    ("newsletter.pragmaticengineer.com", 22), ("pragmaticengineer.com", 18), ("linear.app", 12), ("ycombinator.com", 18),
]
BLOCKED_DOMAINS = [
    "androidauthority.com", "androidpolice.com", "androidcentral.com", "phonearena.com", "gsmarena.com", "9to5mac.com",
    "9to5google.com", "macrumors.com", "appleinsider.com", "dealnews.com", "slickdeals.net", "thedailybeast.com",
    "buzzfeed.com", "mashable.com", "lifehacker.com", "gizmodo.com", "tomsguide.com", "tomshardware.com", "pcmag.com",
    "businessinsider.com",
]
LAB_SOURCES = [
    "OpenAI Blog", "Google AI Blog", "DeepMind Blog", "Anthropic News", "Meta AI Blog", "Hugging Face Blog", "NVIDIA Blog",
    "MIT News AI",
]
ENGINEERING_SOURCES = [
    "GitHub Blog", "Netflix Tech Blog", "Stack Overflow Blog", "Stripe Blog", "Cloudflare Blog", "Vercel Blog",
    "Pragmatic Engineer", "Linear Blog",
]
CATEGORIES = ["core", "ai", "dev", "research", "trend"]
DAILY_QUOTA = {"core": 8, "ai": 7, "dev": 6, "research": 3, "trend": 4}
SOURCE_WEIGHT = {1: 100, 2: 70, 3: 40}
LAB_POINTS, ENGINEERING_POINTS, DEPTH_POINTS, DEPTH_CHARS = 30, 20, 10, 500
AGGREGATOR, AGGREGATOR_POINTS = "Hacker News", 25
BLOCK_POINTS, PATH_POINTS = 1000, 30
RECENCY_POINTS, RECENCY_HOURS, FRESH_HOURS = 100, 48, 30
#: Path segments of pages that tell of changes only: in any place, and in the first place on a host.
PATH_SEGMENTS, FIRST_SEGMENTS = ["release-notes"], {"vercel.com": "changelog"}
#: A count of years in a headline.
YEARS = r"\b\d+\s+years?\b"
#: What a failed image delivery says when it may be repeated as text.
IMAGE_TROUBLE = [
    "wrong file identifier", "wrong remote file identifier", "wrong remote photo url", "webpage_curl_failed",
    "photo_invalid_dimensions", "image_process_failed", "wrong type of the web page content",
    "failed to get http url content", "wrong url", "wrong url host", "url host is empty", "photo url", "media_invalid",
    "file is too big", "file_part_invalid", "wrong padding in the string", "caption is too long",
]
#: What a list item may begin with.
BULLET_MARKERS = r"^[\s\-•*·–—]+"
NAMED_ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "hellip": "…", "mdash": "—", "ndash": "–",
    "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“",
}
# --- end of fixed values -----------------------------------------------------------------------------
