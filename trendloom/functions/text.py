"""String functions as Column expressions.

Only what the JVM has no function for is a pandas UDF: Unicode normal forms and
similarity ratios. Java patterns carry (?U) where word characters of all scripts count.
"""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from trendloom.functions import vocabulary as V


def words_of(text: Column) -> Column:
    """Tokens between blanks; none for an empty text."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(x) with x the value, worked out once: an expression that stands inside a lambda is worked out for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def isin_list(x: Column, values) -> Column:
    return F.array_contains(F.array(*[F.lit(v) for v in values]), x)


#: A word character of ASCII, whatever flags stand around it.
ASCII_WORD = "(?-iu:[0-9A-Za-z_])"


def ascii_bounds(pattern: str) -> str:
    """The pattern with \\b as in SQL, between ASCII word characters and all else; what Java's takes for a word goes by its version.

    Beside a letter or digit that stands for ASCII alone in either case (s and k do not), one look to the other side tells.
    """
    single = re.sub(r"\\b(?=[a-jl-rt-z0-9](?![?*{]))", f"(?<!{ASCII_WORD})", pattern)
    single = re.sub(r"(?<![\\][a-z])(?<=[a-jl-rt-z0-9])\\b", f"(?!{ASCII_WORD})", single)
    return single.replace(r"\b", f"(?:(?<={ASCII_WORD})(?!{ASCII_WORD})|(?<!{ASCII_WORD})(?={ASCII_WORD}))")


def any_ascii(patterns) -> str:
    """One pattern for all of them, with ascii_bounds: each begins with \\b and a letter other than s and k, so the left side is looked at once."""
    return f"(?<!{ASCII_WORD})(?:{'|'.join(ascii_bounds(p.removeprefix(chr(92) + 'b')) for p in patterns)})"


# --- Unicode normal forms (no built-in) -------------------------------------------------


def normal_form(form: str):
    """A pandas UDF to the given Unicode normal form."""

    @F.pandas_udf(StringType())
    def to_form(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize(form, x), na_action="ignore")

    return to_form


@F.pandas_udf(StringType())
def without_accents(s: pd.Series) -> pd.Series:
    """Canonical decomposition without combining marks."""
    return s.map(lambda x: "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)), na_action="ignore")


@F.pandas_udf(StringType())
def to_ascii(s: pd.Series) -> pd.Series:
    """Compatibility decomposition reduced to ASCII."""
    return s.map(lambda x: unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode(), na_action="ignore")


def compatible(text: Column) -> Column:
    """Compatibility composed form; ASCII texts, which are in it already, stay in the JVM."""
    return F.coalesce(normal_form("NFKC")(F.when(F.octet_length(text) != F.length(text), text)), text)


# --- normalisation -----------------------------------------------------------------------


def normalize_text(text: Column, composed: bool = True) -> Column:
    """Lower case, possessives dropped, apostrophes and punctuation to blanks, white space collapsed.

    composed says that the text is in compatibility composed form already (as
    ASCII is, or what compatible() gave); else that form is made first.
    """
    t = text if composed else compatible(text)
    t = F.regexp_replace(F.lower(t), r"(?U)'s\b", "")
    return collapse(F.regexp_replace(F.replace(t, F.lit("'"), F.lit(" ")), r"(?U)[^\w\s]+", " "))


def normalized_words(text: Column) -> Column:
    """The words of normalize_text(text, composed=False), without spelling that text out: all that is no word character divides them."""
    t = F.lower(compatible(text))
    t = F.when(t.contains("'"), F.regexp_replace(t, r"(?U)'s\b", "")).otherwise(t)
    return F.filter(F.split(t, r"(?U)\W+"), lambda w: w != "")


def sql_words(text: Column) -> Column:
    """Lower case, words of letters, digits, marks and underscores of all scripts with one blank between, as SQL has them: each letter is lowered by itself."""
    single = F.when(text.contains("İ") | text.contains("Σ"), F.translate(text, "İΣ", "iσ")).otherwise(text)
    return F.trim(F.regexp_replace(F.lower(F.coalesce(single, F.lit(""))), r"[^\p{L}\p{N}\p{M}_]+", " "))


def without_concentration(words: Column) -> Column:
    """The text of sql_words() without the first concentration term found; most have none, which one look tells."""
    out = F.when(~words.rlike(any_ascii([p for _, p in V.CONCENTRATION_PATTERNS])), words)
    for _, pattern in V.CONCENTRATION_PATTERNS:
        p = ascii_bounds(pattern)
        out = out.when(words.rlike(p), collapse(F.regexp_replace(words, p, "")))
    return out


def normalize_with_concentration(text: Column) -> Column:
    """struct(text, concentration): the first concentration term found is removed and named."""
    t = collapse(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s]", " "))
    label, out = F, F
    for name, pattern in V.CONCENTRATION_PATTERNS:
        label = label.when(t.rlike(pattern), name)
        out = out.when(t.rlike(pattern), collapse(F.regexp_replace(t, pattern, "")))
    return F.struct(out.otherwise(t).alias("text"), label.otherwise(F.lit(None).cast("string")).alias("concentration"))


def strip_concentration(name: Column) -> Column:
    """The name without one trailing term, dash form first; a name that is only such a term stays."""
    terms = "|".join(V.CONCENTRATIONS)
    t = F.trim(name)
    dashed = rf"(?i)^(.+?)\s*-\s*(?:{terms})\s*$"
    return F.when(t.rlike(dashed), F.trim(F.regexp_extract(t, dashed, 1))).otherwise(F.trim(F.regexp_replace(t, rf"(?i) (?:{terms})$", "")))


def base_name(name: Column) -> Column:
    """All trailing suffixes stripped, but never to nothing: a suffix has something before it. Most names end in none, which their last letter tells."""
    terms = "|".join(x.replace(" ", r"\s+") for x in V.KEY_SUFFIXES)
    ends = sorted({x[-1] for x in V.KEY_SUFFIXES})
    t = F.trim(name)
    cut = F.trim(F.regexp_replace(t, rf"(?i)(?<=\S)(?:\s+(?:{terms}))+\s*$", ""))
    return F.when(F.lower(F.right(t, F.lit(1))).isin(*ends, *"\t\n\r\f\v"), cut).otherwise(t)


def compact(text: Column) -> Column:
    return F.regexp_replace(normalize_text(text), r"\s+", "")


def tokenize_ascii(text: Column) -> Column:
    return words_of(collapse(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")))


def slug(text: Column) -> Column:
    """Runs of other than a-z and 0-9 to one dash."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug_words(text: Column) -> Column:
    """Word characters of all scripts stay, blanks and underscores become dashes."""
    t = F.regexp_replace(F.lower(F.trim(text)), r"(?U)[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(t, r"[\s_]+", "-"), "^-+|-+$", "")


def slug_canonical(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(name, "[^a-zA-Z0-9]+", "-")), "^-+|-+$", "")


# --- aliases and tickers -----------------------------------------------------------------


def brand_aliases(brand: Column) -> Column:
    """The normalised brand and its abbreviation, sorted."""
    table = F.create_map(*[F.lit(x) for kv in V.BRAND_ABBREVIATIONS.items() for x in kv])
    n = normalize_text(brand)
    all_ = F.array(n, F.element_at(table, compact(brand)), F.element_at(table, n))
    return F.array_sort(F.array_distinct(F.filter(all_, lambda a: a.isNotNull() & (a != ""))))


def perfume_aliases(brand: Column, perfume: Column) -> Column:
    """Alias strings of a perfume: with and without brand, abbreviation and concentration, sorted."""
    p, base = normalize_text(perfume), normalize_text(strip_concentration(perfume))
    with_brands = lambda tail: F.transform(brand_aliases(brand), lambda b: F.trim(F.concat_ws(" ", b, tail)))
    full = F.concat(F.array(p, F.concat_ws(" ", p, F.lit("perfume"))), with_brands(p))
    differs = (base != "") & (base != p) & (F.length(base) > 1)
    alone = F.size(words_of(base)) >= 2
    specific = alone | ~isin_list(base, V.GENERIC_BASES)
    none = F.array().cast("array<string>")
    short = F.when(differs, with_brands(base)).otherwise(none)
    bare = F.when(differs & specific, F.array(base, F.concat_ws(" ", base, F.lit("perfume")))).otherwise(none)
    return F.when(p == "", none).otherwise(F.array_sort(F.array_distinct(F.filter(F.concat(full, short, bare), lambda a: a != ""))))


def dedupe(values: Column) -> Column:
    return F.array_distinct(values)


def ticker(name: Column) -> Column:
    """Up to eight characters from the significant words and the first number."""
    words = words_of(name)
    digits = F.regexp_extract(name, r"\d+", 0)
    plain = F.filter(words, lambda w: ~w.rlike(r"^\d+$"))
    kept = F.filter(plain, lambda w: ~isin_list(F.lower(w), V.TICKER_STOP))
    sig = F.when(F.size(kept) > 0, kept).when(F.size(plain) > 0, plain).otherwise(words)
    first, second = F.get(sig, F.lit(0)), F.get(sig, F.lit(1))
    initials = F.array_join(F.transform(F.slice(sig, 1, 6), lambda w: F.substring(w, 1, 1)), "")
    base = F.upper(F.when(F.size(sig) == 1, F.substring(first, 1, 5)).when(F.size(sig) == 2, F.concat(F.substring(first, 1, 2), F.substring(second, 1, 3))).otherwise(initials))
    return F.substring(F.when(digits != "", F.concat(F.substring(base, 1, 4), digits)).otherwise(F.substring(base, 1, 6)), 1, 8)


def initials_ticker(name: Column, is_brand: Column, longest: int = 6) -> Column:
    words = words_of(F.upper(name))
    kept = F.filter(words, lambda w: ~isin_list(F.lower(w), V.INITIALS_STOP))
    sig = F.when(is_brand | (F.size(kept) == 0), words).otherwise(kept)
    letters = F.array_join(F.transform(F.slice(sig, 1, longest), lambda w: F.substring(w, 1, 1)), "")
    return F.when(F.size(sig) == 1, F.substring(F.get(sig, F.lit(0)), 1, longest)).otherwise(letters)


def title_case(text: Column) -> Column:
    return F.initcap(text)


# --- phrases -----------------------------------------------------------------------------


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """All n-grams of low..high tokens as array<struct<phrase, pos, n>>; a bounded number for each token."""
    def of(t, n):
        last = F.size(t) - n
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(F.array_join(F.slice(t, i + 1, n), " ").alias("phrase"), i.alias("pos"), F.lit(n).alias("n")))

    return let(tokens, lambda t: F.flatten(F.array(*[of(t, n) for n in range(low, high + 1)])))


def trim_words(tokens: Column, stop_start, stop_end) -> Column:
    """Tokens without the stop words at either end."""
    def cut(t):
        marked = lambda stops: F.transform(t, lambda w: ~w.isin(*stops))
        first, tail = F.array_position(marked(stop_start), True), F.array_position(F.reverse(marked(stop_end)), True)
        return let(F.struct(first.alias("a"), tail.alias("b"), (F.size(t) - tail + 1).alias("z")), lambda x: F.when(
            (x["a"] > 0) & (x["b"] > 0) & (x["z"] >= x["a"]),
            F.slice(t, F.greatest(x["a"], F.lit(1)).cast("int"), F.greatest(x["z"] - x["a"] + 1, F.lit(0)).cast("int")),
        ).otherwise(F.array().cast("array<string>")))

    return let(tokens, cut)


def proposed_form(text: Column) -> Column:
    """Context words at the start and stop words at both ends stripped, unless three characters or fewer would stay."""
    cut = F.array_join(trim_words(words_of(text), (*V.STOPWORDS, *V.CONTEXT_LEADS), V.STOPWORDS), " ")
    return F.when(F.length(cut) > 3, cut).otherwise(text)


def candidate_phrases(text: Column, longest: int = 4) -> Column:
    """Distinct cleaned n-grams, most words and then longest first."""
    whole = normalize_with_concentration(text)["text"]
    grams = let(whole, lambda w: F.concat(F.transform(ngrams(words_of(w), 1, longest), lambda g: g["phrase"]), F.filter(F.array(w), lambda p: p != "")))
    allowed = F.filter(F.array_distinct(grams), lambda p: ~p.rlike("|".join(V.PHRASE_BLACKLIST)))
    cleaned = F.transform(allowed, lambda p: F.array_join(trim_words(words_of(p), V.GENERIC_PERFUME_WORDS, V.GENERIC_PERFUME_WORDS), " "))
    good = F.filter(cleaned, lambda p: (F.length(p) >= 2) & ~p.rlike(r"^\d+$") & F.exists(words_of(p), lambda w: ~isin_list(w, V.PHRASE_STOP)))
    keyed = F.transform(F.array_distinct(good), lambda p: F.struct((-F.size(words_of(p))).alias("w"), (-F.length(p)).alias("l"), p.alias("p")))
    return F.transform(F.array_sort(keyed), lambda k: k["p"])


def stopword_ratio(tokens: Column) -> Column:
    return F.when(F.size(tokens) == 0, 1.0).otherwise(F.size(F.filter(tokens, lambda w: isin_list(w, V.STOPWORDS))) / F.size(tokens))


def content_tokens(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: ~isin_list(w, V.STOPWORDS))


def is_contraction(tokens: Column) -> Column:
    ends = isin_list(F.get(tokens, F.lit(1)), V.CONTRACTION_SUFFIXES) | isin_list(F.get(tokens, F.lit(0)), V.CONTRACTION_SUFFIXES)
    return (F.size(tokens) == 2) & ends


def is_url_artifact(tokens: Column) -> Column:
    return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in V.URL_TOKENS]))


def looks_like_handle(text: Column) -> Column:
    """One lower-case word of five and more characters with four in a row that are not vowels."""
    t = F.trim(text)
    return t.rlike("^[a-z][a-z0-9]{4,}$") & t.rlike("[^aeiou]{4}")


def query_keywords(text: Column, most: int = 4) -> Column:
    """Longest distinct content words, at most `most`."""
    keyed = F.transform(F.array_distinct(content_tokens(tokenize_ascii(text))), lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w")))
    return F.slice(F.transform(F.array_sort(keyed), lambda k: k["w"]), 1, most)


# --- similarity --------------------------------------------------------------------------


def token_similarity(a: Column, b: Column) -> Column:
    """Shared tokens over the larger set, at least 0.9 where one name contains the other."""
    x, y = F.array_distinct(tokenize_ascii(a)), F.array_distinct(tokenize_ascii(b))
    p, q = F.array_join(tokenize_ascii(a), ""), F.array_join(tokenize_ascii(b), "")
    share = F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y), F.lit(1))
    inside = (p != "") & (q != "") & (p.contains(q) | q.contains(p))
    return F.when(inside, F.greatest(share, F.lit(0.9))).otherwise(share)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two strings, null where either is."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="float64")


def common_subsequence(x: str, y: str) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    places: dict[str, int] = {}
    for i, c in enumerate(x):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for c in y:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(x) - row.bit_count()


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity by insertions and deletions alone, 0 to 1, null where either is."""
    ratio = lambda x, y: 2 * common_subsequence(x, y) / (len(x) + len(y)) if x or y else 1.0
    return pd.Series([ratio(x, y) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="float64")


# --- URLs and handles --------------------------------------------------------------------


def url_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), r"^(?:www\.|m\.)", "")


def normalize_url(url: Column, dropped=("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref")) -> Column:
    """Lower-case scheme and host without www. or m., no fragment, no tracking parameters, no trailing slash."""
    t = F.trim(url)
    scheme = F.lower(F.regexp_extract(t, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    path = F.regexp_replace(F.regexp_extract(t, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    params = F.filter(F.split(F.regexp_extract(t, r"\?([^#]*)", 1), "&"), lambda p: (p != "") & ~isin_list(F.lower(F.substring_index(p, "=", 1)), dropped))
    query = F.array_join(params, "&")
    return F.concat(scheme, F.lit("://"), url_host(t), F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def platform_of(url: Column) -> Column:
    h = url_host(url)
    return (
        F.when(h.contains("youtube.com") | h.contains("youtu.be"), "youtube").when(h.contains("tiktok.com"), "tiktok")
        .when(h.contains("instagram.com"), "instagram").when(h.contains("reddit.com"), "reddit")
    )


def channel_id(url: Column) -> Column:
    found = F.regexp_extract(url, r"/channel/(UC[A-Za-z0-9_-]{22})", 1)
    return F.when(found != "", found)


def is_channel_id(x: Column) -> Column:
    return x.rlike("^UC[A-Za-z0-9_-]{22}$")


def video_url_type(url: Column) -> Column:
    h = url_host(url)
    path, query = F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.regexp_extract(url, r"\?([^#]*)", 1)
    return (
        F.when(h == "youtu.be", "video").when(h != "youtube.com", "other").when(channel_id(url).isNotNull(), "channel_direct")
        .when(path.startswith("/@") | path.contains("/c/") | path.contains("/user/"), "handle").when(path.contains("/shorts/"), "shorts")
        .when(path.contains("/watch") | query.contains("v="), "video").otherwise("other")
    )


def handle(raw: Column) -> Column:
    """The bare handle of a name or profile address; null for video addresses and anything else."""
    t = F.trim(raw)
    profile = F.regexp_extract(t, r"^https?://(?:www\.|m\.)?tiktok\.com/@([A-Za-z0-9_.]+)/?(?:\?.*)?$", 1)
    bare = F.when(t.rlike("^https?://"), profile).otherwise(F.regexp_replace(t, "^@+", ""))
    return F.when(bare.rlike("^[A-Za-z0-9_.]{1,24}$") & ~t.rlike("/video/"), bare)


def rebuilt_source_url(platform: Column, url: Column, external_id: Column) -> Column:
    """The stored address, else one built from the platform's id."""
    built = F.when(platform == "youtube", F.concat(F.lit("https://www.youtube.com/watch?v="), external_id)).when(
        platform == "reddit", F.concat(F.lit("https://www.reddit.com/comments/"), external_id)
    )
    return F.coalesce(F.when(F.trim(url) != "", url), built)


# --- labels and search -------------------------------------------------------------------


def branded_label(name: Column, brand: Column) -> Column:
    """The name with its brand in front, unless it begins with it."""
    begins = F.lower(name).startswith(F.lower(brand))
    return F.when(brand.isNull() | (F.trim(brand) == "") | begins, name).otherwise(F.concat_ws(" ", brand, name))


def hierarchy_label(parent: Column, node: Column) -> Column:
    """Parent and node, the parent's name not repeated at the node's start."""
    begins = F.lower(node).startswith(F.concat(F.lower(parent), F.lit(" ")))
    short = F.when(begins, F.substring(node, F.length(parent) + 2, F.length(node))).otherwise(node)
    return F.when(parent.isNull(), F.initcap(node)).otherwise(F.concat(F.initcap(parent), F.lit(" · "), F.initcap(short)))


def mentions_word(text: Column, words) -> Column:
    """Case-insensitive whole-word match of any of the words."""
    return F.coalesce(text.rlike(r"(?i)\b(" + "|".join(words) + r")\b"), F.lit(False))


def search(text: Column, needle: str) -> Column:
    return F.contains(F.lower(text), F.lit(needle.lower()))


def displayable(name: Column, generic=V.GENERIC_PERFUME_WORDS) -> Column:
    """At least two letters, begins with a letter or digit, not a bare generic word."""
    letters = F.length(F.regexp_replace(name, "[^A-Za-z]", "")) >= 2
    return letters & name.rlike("^[A-Za-z0-9]") & ~isin_list(F.lower(F.trim(name)), generic)
