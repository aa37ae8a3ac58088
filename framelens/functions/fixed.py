"""Word lists, formats and tables that results depend on."""

# --- fixed values: answer words by language code ---------------------------
YES_WORDS: dict[str, tuple[str, ...]] = {
    "af": ("ja",),
    "ar": ("نعم",),
    "az": ("bəli",),
    "be": ("так",),
    "bg": ("да",),
    "bn": ("হ্যাঁ",),
    "crh": ("evet",),
    "cs": ("ano",),
    "da": ("ja",),
    "de": ("ja",),
    "el": ("ναι",),
    "en": ("yes",),
    "es": ("sí", "si"),
    "et": ("jah",),
    "fa": ("بله",),
    "fi": ("kyllä",),
    "fr": ("oui",),
    "he": ("כן",),
    "hi": ("हाँ", "हां"),
    "hr": ("da",),
    "hu": ("igen",),
    "hy": ("այո",),
    "id": ("ya",),
    "is": ("já", "ja"),
    "it": ("sì", "si"),
    "ja": ("はい",),
    "ka": ("კი", "დიახ"),
    "kk": ("иә", "ия"),
    "ko": ("예", "네"),
    "lt": ("taip",),
    "lv": ("jā",),
    "mk": ("да",),
    "nl": ("ja",),
    "no": ("ja",),
    "pl": ("tak",),
    "pt": ("sim",),
    "ro": ("da",),
    "ru": ("да",),
    "sk": ("áno", "ano"),
    "sl": ("da",),
    "sq": ("po",),
    "sr": ("да", "da"),
    "sv": ("ja",),
    "sw": ("ndiyo",),
    "th": ("ใช่",),
    "tr": ("evet",),
    "uk": ("так",),
    "ur": ("ہاں",),
    "vi": ("có",),
    "zh": ("是",),
}

NO_WORDS: dict[str, tuple[str, ...]] = {
    "af": ("nee",),
    "ar": ("لا",),
    "az": ("xeyr", "yox"),
    "be": ("не",),
    "bg": ("не",),
    "bn": ("না",),
    "crh": ("yoq",),
    "cs": ("ne",),
    "da": ("nej",),
    "de": ("nein",),
    "el": ("όχι",),
    "en": ("no",),
    "es": ("no",),
    "et": ("ei",),
    "fa": ("خیر", "نه"),
    "fi": ("ei",),
    "fr": ("non",),
    "he": ("לא",),
    "hi": ("नहीं",),
    "hr": ("ne",),
    "hu": ("nem",),
    "hy": ("ոչ",),
    "id": ("tidak",),
    "is": ("nei",),
    "it": ("no",),
    "ja": ("いいえ",),
    "ka": ("არა",),
    "kk": ("жоқ",),
    "ko": ("아니오", "아니요"),
    "lt": ("ne",),
    "lv": ("nē",),
    "mk": ("не",),
    "nl": ("nee",),
    "no": ("nei",),
    "pl": ("nie",),
    "pt": ("não", "nao"),
    "ro": ("nu",),
    "ru": ("нет",),
    "sk": ("nie",),
    "sl": ("ne",),
    "sq": ("jo",),
    "sr": ("не", "ne"),
    "sv": ("nej",),
    "sw": ("hapana",),
    "th": ("ไม่",),
    "tr": ("hayır",),
    "uk": ("ні",),
    "ur": ("نہیں",),
    "vi": ("không",),
    "zh": ("否", "不", "不是"),
}

# --- fixed values: hedge words of forced-choice answers --------------------
HEDGE_WORDS = (
    "disputed", "complex", "complicated", "depends", "debated",
    "спорн", "спірн", "залежить", "зависит", "сложн", "складн",
    "umstritten", "contesté", "disputado", "conteso", "contest",
    "тартышлу",
)

# --- fixed values: hedge phrases of open answers ---------------------------
OPEN_HEDGES = (
    "i cannot", "i can't", "i don't know", "unclear", "disputed",
    "complex", "complicated", "cannot provide", "cannot answer",
    "не знаю", "складн", "не можу",
)

# --- fixed values: academic hosts, tried in this order ---------------------
ACADEMIC_HOSTS = (
    "jstor.org", "springer.com", "wiley.com", "sciencedirect.com", "researchgate.net",
    "academia.edu", "arxiv.org", "doi.org", "semantic-scholar", "s2-research",
    "ncbi.nlm.nih.gov", "pubmed", "scopus.com", "tandfonline.com", "sagepub.com",
    "cambridge.org", "oxford.ac.uk", "oup.com", "nature.com", "science.org",
    "elsevier.com", "mdpi.com", "frontiersin.org", "plos.org", "biorxiv.org",
    "ssrn.com",
)

# --- fixed values: DOI and citation formats --------------------------------
DOI_PATTERN = r"\b10\.\d{4,}/[^\s\]>)}\x22]+"
DOI_TRAILING = ".,;:"
DOI_RESOLVERS = ("https://doi.org/", "http://doi.org/")
CITATION_PATTERNS = (
    r"\([A-Z][a-z]+(?:\s+(?:et\s+al\.)?)?,\s*[0-9]{4}\)",
    r"\[[0-9]+(?:\s*[,\-]\s*[0-9]+)*\]",
    r"\bet\s+al\.\b",
    r"\bJournal\s+of\s+[A-Z]",
    r"\bVol\.\s*[0-9]+",
    r"\bpp\.\s*[0-9]+",
    r"\bISSN\s*:?\s*[0-9]{4}-?[0-9]{3}[0-9Xx]",
    r"\bISBN\s*:?\s*(?:978|979)[0-9\- ]{10,}",
)

# --- fixed values: publishers by DOI prefix --------------------------------
PREFIX_PUBLISHERS = {
    "10.1002": "Wiley",
    "10.1007": "Springer Nature",
    "10.1016": "Elsevier",
    "10.1017": "Cambridge University Press",
    "10.1051": "EDP Sciences",
    "10.1080": "Taylor & Francis",
    "10.1088": "IOP Publishing",
    "10.1093": "Oxford University Press",
    "10.1097": "Wolters Kluwer",
    "10.1109": "IEEE",
    "10.1134": "Pleiades Publishing (Springer)",
    "10.1177": "SAGE Publications",
    "10.1515": "De Gruyter",
    "10.15405": "Future Academy",
    "10.2139": "SSRN (Elsevier)",
    "10.3389": "Frontiers",
    "10.3390": "MDPI",
    "10.4324": "Routledge (Taylor & Francis)",
    "10.5281": "Zenodo (CERN)",
}

# --- fixed values: top-level domains ---------------------------------------
COMPOUND_TLDS = (".co.uk", ".com.au", ".co.nz", ".com.br", ".co.za")
TLD_COUNTRY = {
    "ae": "UAE", "br": "Brazil", "by": "Belarus", "cn": "China", "co.uk": "UK",
    "cz": "Czechia", "de": "Germany", "es": "Spain", "fr": "France", "in": "India",
    "it": "Italy", "jp": "Japan", "kr": "South Korea", "nl": "Netherlands", "pl": "Poland",
    "ru": "Russia", "su": "Russia", "tr": "Turkey", "ua": "Ukraine", "uk": "UK",
}
SOURCE_COUNTRY = {
    ".ae": "UAE", ".ar": "Argentina", ".au": "Australia", ".br": "Brazil", ".ca": "Canada",
    ".cn": "China", ".co": "Colombia", ".co.uk": "United Kingdom", ".cz": "Czech Republic", ".de": "Germany",
    ".eg": "Egypt", ".es": "Spain", ".fr": "France", ".in": "India", ".it": "Italy",
    ".mx": "Mexico", ".nl": "Netherlands", ".pl": "Poland", ".ru": "Russia", ".sa": "Saudi Arabia",
    ".tr": "Turkey", ".ua": "Ukraine",
}
ORIGIN_TLDS = (
    ("ukrainian", (".ua",)),
    ("russian", (".ru", ".su")),
    ("british", (".uk",)),
    ("german", (".de",)),
    ("french", (".fr",)),
    ("european", (".eu",)),
)
ORIGIN_MARKS = (
    ("russian", (".gov.ru", ".edu.ru", ".ac.ru")),
    ("ukrainian", (".gov.ua", ".edu.ua")),
)

# --- fixed values: directory types that keep their name --------------------
DIRECTORY_TYPES = {
    "blog": "blog", "commerce": "commerce", "culture": "culture", "education": "education",
    "government": "government", "health": "health", "news": "news", "society": "society_org",
    "sports": "sports", "tech": "tech", "travel": "travel",
}

# --- fixed values: HTML clean-up -------------------------------------------
HTML_BLOCKS = ("script", "style", "nav", "footer", "header", "aside")
HTML_ENTITIES = (
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&#39;", "'"), ("&quot;", '"'),
)

# --- fixed values: wikis that are no encyclopaedia edition -----------------
NON_EDITIONS = ("commonswiki", "mediawikiwiki", "metawiki", "specieswiki", "wikidatawiki")

# --- fixed values: tier weights by scheme ----------------------------------
WEIGHT_SCHEMES = {
    "primary": {"D": 0.10, "L": 0.50, "I": 0.20, "R": 0.20},
    "monotonic": {"D": 0.10, "L": 0.20, "I": 0.30, "R": 0.40},
    "uniform": {"D": 0.25, "L": 0.25, "I": 0.25, "R": 0.25},
    "geometric": {"D": 1 / 15, "L": 2 / 15, "I": 4 / 15, "R": 8 / 15},
    "free_only": {"D": 0.0, "L": 0.0, "I": 0.0, "R": 1.0},
    "forced_only": {"D": 0.30, "L": 0.30, "I": 0.40, "R": 0.0},
}

# --- fixed values: statistics ----------------------------------------------
Z_95 = 1.96
CHI2_BANDS = ((10.83, "<0.001"), (3.84, "<0.05"))
EFFECT_BANDS = ((0.3, "small"), (0.5, "medium"))
KAPPA_BANDS = ((0.81, "almost perfect"), (0.61, "substantial"), (0.41, "moderate"), (0.21, "fair"))
