"""Short word lists, patterns and maps that results depend on. Longer tables are parameters of the operators."""

# Trailing product-form terms, longest first.
CONCENTRATIONS = ("extrait de parfum", "eau de parfum", "eau de toilette", "body spray", "body mist", "extrait", "parfum", "edp", "edt")
# Suffixes that aggregation keys lose.
KEY_SUFFIXES = ("extrait de parfum", "eau de parfum", "eau de toilette", "eau de cologne", "eau fraiche", "extrait", "parfum")
# Label and pattern of concentration detection, in order.
CONCENTRATION_PATTERNS = (
    ("body_spray", r"\bbody spray\b"), ("body_spray", r"\bbody mist\b"), ("edp", r"\bedp\b"), ("edp", r"\beau de parfum\b"),
    ("edt", r"\bedt\b"), ("edt", r"\beau de toilette\b"), ("extrait", r"\bextrait\b"), ("extrait", r"\bextrait de parfum\b"), ("parfum", r"\bparfum\b"),
)
# Abbreviations of brand names.
BRAND_ABBREVIATIONS = {
    "parfums de marly": "pdm", "maison francis kurkdjian": "mfk", "yvessaintlaurent": "ysl", "yves saint laurent": "ysl", "maison margiela": "mm",
}
# Single words too generic for an alias.
GENERIC_BASES = (
    "love", "dark", "light", "pure", "clean", "fresh", "warm", "cool", "wild", "free", "brave", "rush", "sport", "dream", "bloom", "glow",
    "icon", "luxe", "spark", "gold", "jade", "silk", "velvet", "intense", "original", "classic", "summer", "winter", "spring", "night", "day",
    "musk", "scent", "essence", "wood", "woods", "amber", "iris", "oud", "cedar", "moss", "fig", "tea", "rose", "noir", "bleu", "rouge",
    "red", "white", "black", "blue", "green", "or", "eau", "pour", "homme", "femme", "nuit", "soleil",
)
# Words that tickers skip, in two variants.
TICKER_STOP = ("de", "du", "la", "le", "les", "by", "of", "the", "a", "an", "and", "et", "maison", "parfums", "parfum", "eau")
INITIALS_STOP = ("de", "du", "la", "le", "les", "for", "of", "and", "the", "von", "der")
# Stop words of candidate phrases.
PHRASE_STOP = (
    "top", "best", "what", "are", "is", "for", "the", "and", "with", "this", "that", "from", "into", "your", "get", "grab", "last", "longer",
    "through", "here", "these", "those", "have", "has", "popular", "new", "about", "chat", "thoughts", "would", "could", "should", "also",
    "very", "more", "most", "some", "many", "much", "attractive", "unique", "shorts", "far",
)
GENERIC_PERFUME_WORDS = ("fragrance", "fragrances", "perfume", "perfumes", "cologne", "colognes", "scent", "scents")
# Phrases that are never candidates.
PHRASE_BLACKLIST = (
    r"\btop\s+\d+\b", r"\bout\s+of\s+\d+\b", r"\bworst\s+to\s+best\b", r"\bbest\s+to\s+worst\b", r"\bthrough\s+the\s+links\b",
    r"\bgrab\s+them\s+here\b", r"\bit\s+would\s+be\b", r"\blast\s+longer\s+than\b", r"\bnew\s+fragrance\s+releases\b",
    r"\bcomplimented\s+fragrances\b", r"\bwe\s+chat\b", r"\bfar\s+from\b",
)
# Stop words of candidate validation, English function words and contraction tails.
STOPWORDS = (
    "a", "an", "the", "and", "or", "but", "not", "no", "nor", "so", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "shall", "can", "i", "me", "my",
    "we", "our", "you", "your", "he", "she", "it", "they", "his", "her", "its", "their", "this", "that", "these", "those", "in", "on", "at",
    "to", "for", "of", "with", "by", "from", "up", "out", "about", "into", "through", "during", "before", "after", "above", "below", "between",
    "if", "then", "as", "than", "when", "while", "each", "here", "there", "where", "what", "who", "how", "all", "both", "few", "more", "most",
    "other", "some", "such", "only", "own", "same", "just", "also", "get", "got", "very", "really", "quite", "already", "still", "yet",
    "s", "t", "re", "ll", "ve", "d", "m",
)
CONTEXT_LEADS = (
    "review", "reviews", "reviewed", "reviewing", "compares", "compared", "compare", "comparing", "similar", "inspired", "featuring",
    "features", "unboxing", "watch", "watching", "check", "best", "top", "worst", "vs",
)
CONTRACTION_SUFFIXES = ("t", "s", "re", "ll", "ve", "d", "m")
CONTRACTION_TAILS = ("t", "nt", "s", "ll", "re", "ve", "d", "m")
URL_TOKENS = ("http", "https", "www", "bit", "com", "org", "net", "html", "php", "utm", "ref", "url", "link", "click", "ly")
# Single words that are never matched alone, and phrases that are never matched.
BLOCKED_WORDS = ("don", "pink", "dot", "smart", "standard", "heritage", "moth", "jack", "man", "two", "11", "21", "revolution", "five")
BLOCKED_PHRASES = ("so so", "i am so so", "so i am so so")
# Note names that texts are searched for.
NOTE_TERMS = (
    "lily of the valley", "ylang ylang", "rose", "jasmine", "iris", "violet", "peony", "lily", "magnolia", "tuberose", "gardenia", "freesia",
    "carnation", "heliotrope", "neroli", "orris", "oud", "amber", "benzoin", "labdanum", "cistus", "ambergris", "frankincense", "myrrh",
    "incense", "tonka", "vanilla", "caramel", "honey", "sandalwood", "cedar", "cedarwood", "vetiver", "patchouli", "musk", "leather", "oakmoss",
    "tobacco", "wood", "bergamot", "lemon", "orange", "grapefruit", "lime", "mandarin", "tangerine", "cardamom", "pepper", "ginger", "nutmeg",
    "cinnamon", "clove", "saffron", "raspberry", "blackcurrant", "peach", "apple", "strawberry", "lychee", "plum", "lavender", "rosemary",
    "thyme", "mint", "basil", "aquatic", "marine", "sea salt", "coffee", "chocolate", "almond", "moss", "fern", "hay",
)
