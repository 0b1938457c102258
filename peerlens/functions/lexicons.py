"""Fixed values of the domain: word lists, aliases and bands. They are data, and most operators take others as a parameter."""

from __future__ import annotations

# Accent folding, character by character (fixed values).
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLDED = "aaaaaaceeeeiiiinooooouuuuyy"

# Corporate suffixes that an entity key drops (fixed values).
CORPORATE_SUFFIXES = ["inc", "llc", "ltd", "limited", "corp", "co", "gmbh", "s.a.", "s.a", "sa", "bv", "plc", "ag", "oy", "ab", "srl"]

# Substrings of a status that mean the company is dead, and those that mean it operates (fixed values).
DEAD_MARKERS = ["inactive", "dead", "failed", "shutdown", "shut down", "closed", "defunct"]
OPERATING_MARKERS = ["seed", "series", "public", "late stage", "ipo", "operating", "active", "live"]

# Words that begin a negated span, and the number of words it covers (fixed values).
NEGATION_MARKERS = ["not", "no", "never", "n't", "nao", "sem", "nunca", "ninguem", "nunca jamais", "ni", "nadie", "ningun", "pas", "aucun", "jamais"]
NEGATION_WINDOW = 3

# Headcount bands: from, to, ordinal (fixed values).
HEADCOUNT_BANDS = [(1, 1, 0), (2, 5, 1), (6, 10, 2), (11, 25, 3), (26, 50, 4), (51, 100, 5), (101, 250, 6), (251, 500, 7), (501, 1000, 8), (1001, 10000, 9)]

# Stage names and their ordinals, in order of precedence (fixed values).
STAGES = [
    ("idea", 0), ("ideia", 0), ("concept", 0),
    ("pre-seed", 1), ("preseed", 1), ("pre seed", 1), ("prototipo", 1), ("prototype", 1),
    ("seed", 2), ("mvp", 2),
    ("early revenue", 3), ("early", 3), ("post-seed", 3),
    ("series a", 4), ("serie a", 4),
    ("series b", 5), ("serie b", 5),
    ("series c", 6), ("serie c", 6), ("growth", 6),
    ("series d+", 7), ("late stage", 7), ("late-stage", 7),
    ("ipo", 8), ("public", 8), ("pre-ipo", 8),
]

# Lifespan bands in years: from, below, name (fixed values).
LIFESPAN_BANDS = [(0, 2, "early_death"), (2, 5, "scale_failure"), (5, 10, "market_disruption"), (10, 999, "long_tail")]

# Weights of the match dimensions, the bonus of convergence and the least score of a match (fixed values).
WEIGHTS = {"macro": 16.0, "category": 10.0, "model": 8.0, "lexical": 15.0, "semantic": 24.0, "cause": 28.0, "cause_inferred": 16.0, "secondary": 8.0, "country": 7.0, "era": 5.0}
CONVERGENCE_BONUS = 20.0
MIN_SCORE = 18.0
MIN_LEXICAL = 0.08
MIN_SEMANTIC = 0.22

# Weights of the profile similarity (fixed values).
PROFILE_WEIGHTS = {"country": 0.35, "decade": 0.20, "headcount": 0.20, "stage": 0.15, "model": 0.10}

# Days from registration to each follow-up (fixed values).
FOLLOWUP_DAYS = [90, 180, 365, 730]

# A short English stop list; other lists are a parameter.
STOPWORDS = ["the", "and", "for", "with", "that", "this", "from", "are", "was", "not", "but", "its", "has", "have", "der", "die", "das", "und", "les", "des", "que", "los", "las", "una", "por", "para"]

# Sectors of the open-company register: the first part that a sector contains decides (fixed values).
REGISTER_SECTORS = [
    ("ENERGIA ELETRICA", "Energy"), ("PETROLEO", "Energy"), ("GAS", "Energy"), ("MINERACAO", "Mining"), ("SIDERURG", "Steel"),
    ("METALURG", "Metals"), ("TELECOMUNIC", "Telecom"), ("TRANSPORT", "Transport"), ("FINANCAS", "Finance"), ("BANCO", "Banking"),
    ("SEGURO", "Insurance"), ("AGRICULTURA", "Agriculture"), ("AGROPECUARIA", "Agriculture"), ("CONSTRUCAO", "Construction"),
    ("ALIMENTO", "Food"), ("BEBIDA", "Food"), ("COMERCIO", "Retail"), ("VAREJ", "Retail"), ("TECNOLOG", "Technology"),
    ("SOFTWARE", "Technology"), ("TEXTIL", "Textile"), ("PAPEL", "Paper"), ("QUIMIC", "Chemicals"), ("FARMAC", "Pharma"),
    ("SAUDE", "Healthcare"), ("EDUCA", "Education"), ("HOTEL", "Hospitality"), ("IMOBIL", "Real Estate"), ("AUTOMOT", "Automotive"),
    ("AERONAUT", "Aerospace"), ("SERVICO", "Services"),
]

# Sectors of the equity holdings: the first whose first ten characters a sector begins with decides (fixed values).
HOLDING_SECTORS = [
    ("PETROLEO, COMBUSTIVEIS E QUIMICA", "Energy"), ("SIDERURGIA", "Steel"), ("MINERACAO", "Mining"), ("ENERGIA ELETRICA", "Energy"),
    ("TELECOMUNICACOES", "Telecom"), ("TRANSPORTES", "Transport"), ("FINANCAS E SEGUROS", "Finance"), ("AGROPECUARIA", "Agriculture"),
    ("CONSTRUCAO", "Construction"), ("ALIMENTOS E BEBIDAS", "Food"), ("COMERCIO VAREJISTA", "Retail"), ("SERVICOS", "Services"),
    ("TECNOLOGIA", "Technology"), ("OUTROS SETORES", ""),
]

# Categories of the startup rankings (fixed values).
RANKING_CATEGORIES = {
    "IndTechs": "Industrial", "LogTechs": "Logistics", "LegalTechs": "Legal", "EdTechs": "Education", "HealthTechs": "Health",
    "FinTechs": "Fintech", "AgTechs": "Agriculture", "FoodTechs": "Food", "PropTechs": "Proptech", "RetailTechs": "Retail",
    "EnergyTechs": "Energy", "Mobility": "Mobility", "HRTechs": "HR", "MarTechs": "Marketing", "GovTechs": "Govtech",
    "CleanTechs": "Cleantech", "ConstruTechs": "Construction", "InsurTechs": "Insurtech", "SportTechs": "Sports",
    "SecurityTechs": "Security", "HomeTechs": "Home", "BeautyTechs": "Beauty", "TravelTechs": "Travel", "MediaTechs": "Media",
    "MusicTechs": "Music", "PetTechs": "Pet", "RecruitTechs": "Recruiting", "SocialTechs": "Social Impact", "AdTechs": "AdTech",
    "CyberTechs": "Cybersecurity",
}

# Keywords of the light macro table: a category must equal one (fixed values).
LITE_MACROS = {
    "finance": ["fintech", "finance", "financial", "banking", "payments", "lending", "insurance", "insurtech", "crypto", "blockchain"],
    "health": ["healthcare", "health tech", "healthtech", "biotech", "medical", "medtech", "diagnostics", "telehealth"],
    "software": ["saas", "software", "b2b", "b2b2c", "developer tools", "devtools", "infrastructure", "api", "platform", "enterprise", "cloud", "productivity"],
    "consumer": ["consumer", "b2c", "marketplace", "e-commerce", "retail", "lifestyle", "social", "entertainment", "gaming"],
    "ai": ["ai", "artificial intelligence", "machine learning", "deep learning", "data", "analytics"],
    "education": ["education", "edtech", "learning", "training"],
    "logistics": ["logistics", "supply chain", "transport", "mobility", "delivery"],
    "energy": ["energy", "climate", "cleantech", "sustainability", "renewable"],
    "industrial": ["industrial", "manufacturing", "robotics", "hardware"],
    "media": ["media", "content", "publishing", "advertising", "marketing"],
    "real_estate": ["real estate", "proptech", "construction"],
    "agri": ["agriculture", "agtech", "food", "farming"],
    "security": ["security", "cybersecurity", "privacy"],
    "hr": ["hr", "recruiting", "talent", "people", "human resources"],
    "legal": ["legal", "legaltech", "compliance", "regulatory"],
}

# Situations of the tax register: status and outcome (fixed values).
REGISTRY_SITUATIONS = {"ATIVA": ("Active", "operating"), "BAIXADA": ("Inactive", "dead"), "SUSPENSA": ("Inactive", "unknown"), "INAPTA": ("Inactive", "unknown"), "NULA": ("Inactive", "unknown")}

# Labels of interview pages and the fields they fill (fixed values).
INTERVIEW_LABELS = {
    "category": "industry", "industry": "industry", "country": "country", "location": "location", "started": "founded", "started in": "founded",
    "founded": "founded", "outcome": "outcome", "cause": "reason", "cause of failure": "reason", "specific cause of failure": "reason",
    "reason of failure": "reason", "reason": "reason", "closed": "closed", "closed in": "closed", "number of founders": "n_founders",
    "name of founders": "founder", "founder": "founder", "founders": "founder", "number of employees": "employees", "employees": "employees",
    "number of funding rounds": "funding_rounds", "total funding amount": "funding", "funding amount": "funding", "funding": "funding",
    "number of investors": "n_investors", "revenue": "revenue",
}
INTERVIEW_BOILERPLATE = ["subscribe", "newsletter", "related posts", "read more"]

# Texts that mark a section behind a paywall, in raw reports (fixed values).
PAYWALL_MARKERS = ["does not have a completed analysis", "monthly pro research", "commission the"]

# Country names and the key they go by (fixed values).
COUNTRY_ALIASES = {
    "brasil": "brazil", "br": "brazil", "brazilian": "brazil", "usa": "united states", "us": "united states", "u.s.": "united states",
    "u.s.a.": "united states", "eua": "united states", "estados unidos": "united states", "american": "united states", "uk": "united kingdom",
    "reino unido": "united kingdom", "inglaterra": "united kingdom", "alemanha": "germany", "franca": "france", "espanha": "spain", "italia": "italy",
    "holanda": "netherlands", "paises baixos": "netherlands", "suecia": "sweden", "suica": "switzerland", "india": "india", "china": "china",
    "japao": "japan", "russia": "russia", "mexico": "mexico", "argentina": "argentina", "chile": "chile", "colombia": "colombia", "canada": "canada",
    "australia": "australia",
}

# Phrases that tell why a company failed, by cause, in order of precedence (fixed values).
CAUSE_LEXICON = {
    "Lack of Funds": ["ran out of money", "ran out of cash", "ran out of funds", "couldn't raise", "could not raise", "unable to raise", "failed to raise", "funding dried", "no more capital", "out of runway", "couldn't secure funding", "failed fundraise"],
    "No Market Need": ["no market need", "no demand", "nobody wanted", "no one wanted", "users didn't want", "no real need", "solution looking for a problem", "didn't solve a real problem", "no product-market fit", "no product market fit", "lacked demand"],
    "Bad Market Fit": ["market too small", "wrong market", "niche was too small", "market fit", "tam too small", "couldn't find product-market fit"],
    "Bad Business Model": ["unit economics", "couldn't monetize", "couldn't make money", "margins too thin", "business model didn't work", "business model failed", "unprofitable", "couldn't turn a profit", "unable to charge", "pricing problem"],
    "Bad Marketing": ["couldn't acquire users", "couldn't acquire customers", "acquisition was too expensive", "cac was too high", "couldn't get customers", "growth stalled", "bad marketing", "marketing failed", "no growth"],
    "Poor Product": ["product was bad", "poor product", "product didn't work", "too many bugs", "quality issues", "product wasn't ready", "technical problems"],
    "Bad Management": ["cofounder left", "co-founder left", "cofounder conflict", "founder conflict", "management issues", "team fell apart", "founder dispute", "founders fought"],
    "Mismanagement of Funds": ["spent too much", "overspent", "burn rate too high", "burned through cash", "burned too much", "misallocated"],
    "Competition": ["outcompeted", "bigger competitor", "lost to", "couldn't compete", "competition was too strong", "dominant player", "incumbents won"],
    "Lack of Focus": ["too many pivots", "pivoted too many", "spread too thin", "lost focus", "scope creep", "tried to do too much"],
    "Lack of Experience": ["first-time founder", "first time founder", "inexperienced", "didn't know the industry", "no domain expertise"],
    "Legal Challenges": ["lawsuit", "regulatory", "regulation", "legal issue", "legal challenge", "banned", "compliance", "sued", "regulator", "illegal"],
    "Bad Timing": ["too early", "too late", "ahead of its time", "timing was wrong", "market wasn't ready"],
    "Dependence on Others": ["api changed", "platform changed", "depended on", "blocked by", "shut out of", "access revoked", "api deprecated", "kicked off"],
}

# Words that go with a declared business model (fixed values).
MODEL_WORDS = {
    "saas": ["saas", "subscription", "software", "platform", "cloud", "assinatura"],
    "marketplace": ["marketplace", "match", "connect", "platform", "two-sided", "vendedores", "compradores"],
    "b2b": ["b2b", "enterprise", "business", "company", "companies", "empresa", "empresas"],
    "b2c": ["b2c", "consumer", "users", "user", "customer", "usuario", "usuarios", "pessoas"],
    "b2b2c": ["b2b2c", "platform", "enterprise", "consumer"],
    "e-commerce": ["ecommerce", "commerce", "shop", "store", "retail", "buy", "sell", "loja", "varejo"],
    "app": ["app", "mobile", "ios", "android", "aplicativo"],
    "hardware": ["hardware", "device", "devices", "iot", "sensor", "dispositivo"],
    "agency": ["agency", "services", "consulting", "consultoria"],
    "subscription": ["subscription", "recurring", "monthly", "assinatura", "mensalidade"],
}

# Signs and codes before an amount of money, the factors of its units, words for rounds and for staff (fixed values).
CURRENCIES = ["us$", "u$s", "r$", "$", "€", "£", "usd", "brl", "eur", "gbp"]
MONEY_UNITS = {
    "k": 1e3, "mil": 1e3,
    "m": 1e6, "mm": 1e6, "milhão": 1e6, "milhões": 1e6, "milhao": 1e6, "milhoes": 1e6, "million": 1e6, "millions": 1e6,
    "bi": 1e9, "b": 1e9, "bn": 1e9, "bilhão": 1e9, "bilhões": 1e9, "billion": 1e9,
}
ROUND_WORDS = ["pre-seed", "pre seed", "preseed", "seed", "ipo", "anjo", "angel", "bootstrap", "bootstrapped", "revenue-based", "revenue based", "revenuebased"]
ROUND_SERIES = ["series", "série", "serie"]
STAFF_WORDS = ["funcionario", "funcionarios", "funcionário", "funcionários", "employee", "employees", "people", "pessoas", "func", "funcs", "dev", "devs", "staff", "colab", "colabs", "colaboradores"]

# Phrases before the name of a competitor; those of the second list want a colon or a space behind them (fixed values).
RIVAL_CUES = ["vs.", "vs", "versus", "compete with", "competes with", "competed with"]
RIVAL_TITLES = ["competitor", "competitors"]

# Company pages: statuses in order of precedence, seasons of batches, parts of addresses that are no website, labels of places, words of locked
# reports, headings of known sections, words of build plans; stages of listed companies that are statuses (fixed values).
PAGE_STATUSES = ["Acquired", "Inactive", "Active", "Parted Ways", "Public"]
BATCH_SEASONS = {"W": "Winter", "S": "Summer", "F": "Fall", "Sp": "Spring"}
NOT_A_WEBSITE = ["ycombinator", "x.com", "twitter.com", "producthunt"]
PLACE_LABELS = ["location", "hq", "headquarters", "based in"]
LOCKED_MARKERS = ["locked", "upgrade to pro", "pro subscription", "unlock this"]
PAGE_SECTIONS = {
    "overview": ["overview"], "founding_story": ["founding story"], "timeline": ["timeline"], "what_they_built": ["what they built", "what it built"],
    "market_position": ["market position"], "business_model": ["business model"], "traction": ["traction"],
    "post_mortem": ["post-mortem", "post mortem", "postmortem", "why it failed", "why they failed"], "key_lessons": ["key lessons", "lessons", "lessons learned"], "sources": ["sources"],
}
BUILD_PLAN_WORDS = ["build plan", "rebuild", "technical spec"]
LISTED_STAGES = ["Public", "Acquired", "Seed", "Series A", "Series B", "Series C", "Series D", "Series E", "Series F", "Late Stage", "Deadpooled", "Unfunded"]

# Texts that sell a report in place of showing it, in quality reports (fixed values).
UPSELL_MARKERS = ["go pro", "commission", "monthly pro", "does not have a completed analysis", "unlock the full", "upgrade to pro", "subscribe"]
