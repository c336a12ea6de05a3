"""Every registered query against its SQL, run by DuckDB on the same files."""

import difflib
import html
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from trendloom.functions import text as T
from trendloom.operators import topics as P
from trendloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cells(frame: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
            return "NULL"
        if isinstance(x, (int, float, np.integer, np.floating)) and not isinstance(x, (bool, np.bool_)):
            return repr(round(float(x), 6) + 0.0)
        if isinstance(x, pd.Timestamp) or type(x).__name__ == "date":
            return str(pd.Timestamp(x))
        return str(list(x)) if isinstance(x, (list, np.ndarray)) else str(x)

    return sorted(tuple(cell(x) for x in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, sf_dir, duck, name):
    got, want = catalog.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)


#: Queries that SQL cannot express, each with a test of its own below.
WITHOUT_SQL = {"promotion_precheck", "promoted_aliases", "fuzzy_names", "fuzzy_bands", "parsed_pages", "semantic_profiles", "create_bucket_review"}


def test_every_query_has_sql_or_a_test():
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == WITHOUT_SQL


def _ratio(a, b):
    return difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()


def _indel(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b))


def _best(text, names, least):
    found = max((_ratio(text, n), n) for n in names)
    return found if found[0] >= least else None


@pytest.fixture(scope="module")
def parts(duck):
    return duck.sql("SELECT * FROM part").df()


def test_fuzzy_names(spark, sf_dir, parts):
    names = sorted(set(parts.p_name))
    want = {}
    for n in names:
        for t in (n + "s", n[:1] + "x" + n[2:], n[1:]):
            if found := _best(t, names, 0.8):
                want[t] = (found[1], round(found[0], 9))
    got = {r.text: (r.match, round(r.ratio, 9)) for r in catalog.QUERIES["fuzzy_names"](spark, sf_dir).collect()}
    assert got == want and len(want) > 150


def test_fuzzy_bands(spark, sf_dir, parts):
    aliases = parts.assign(a=parts.p_name.str.lower()).groupby("a").p_partkey.min().to_dict()
    texts = {}
    for a, k in aliases.items():
        texts[int(k)] = (a, a[:1] + "x" + a[2:], a[1 : len(a) - 3], "zq " + a[::-1])[k % 4]
    frame = spark.createDataFrame(list(texts.items()), "id long, text string")
    candidates = {r.id: r.c for r in frame.select("id", T.candidate_phrases(frame.text).alias("c")).collect()}
    got = {r.id: r for r in catalog.QUERIES["fuzzy_bands"](spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for i, cs in candidates.items():
        exact = next((c for c in cs if c in aliases), None)
        if exact is not None:
            want = ("exact", exact, aliases[exact], 1.0)
        else:
            score, _, c, e = min(((-_indel(c, a), k, c, e) for k, c in enumerate(cs) for a, e in aliases.items()), default=(0, 0, None, None))
            want = ("fuzzy_high" if -score >= 0.92 else "fuzzy_mid", c, e, round(-score, 3)) if -score >= 0.8 else ("unresolved", texts[i], None, 0.0)
        assert (got[i].method, got[i].candidate, got[i].entity_id, got[i].confidence) == want
    assert {r.method for r in got.values()} >= {"exact", "unresolved"} and any(r.method.startswith("fuzzy") for r in got.values())


def _refused(t):
    w = t.split(" ")
    hit = [x for x in w if x in ("dupe", "dupes", "clone", "scent", "dna", "fragrance", "perfume")]
    if len(t) <= 3:
        return "too_short"
    if re.search(r"[^\x00-\x7F]", t):
        return "non_ascii"
    if hit:
        return "descriptor_token:" + hit[0]
    if len(w) == 1 and len(t) < 5:
        return "single_token_too_short"
    return "digit_start" if re.match("[0-9]", w[0]) else None


def test_promotion_precheck(spark, sf_dir, parts):
    names = sorted(set(parts.p_name))
    brands = {n.split(" ")[0]: n.split(" ")[0].title() for n in names}
    want = {}
    for t in {"ab", "x dupe", *names, *(n + "s" for n in names), *parts.p_type.str.lower()}:
        merge, first = _best(t, names, 0.88), t.split(" ")[0]
        if bad := _refused(t):
            want[t] = ("reject", bad)
        elif t in names and t < "m":
            want[t] = ("exact", t)
        elif merge:
            want[t] = ("merge", merge[1])
        else:
            want[t] = ("create", brands[first]) if first in brands else ("review", None)
    got = {r.text: (r.decision, r.target) for r in catalog.QUERIES["promotion_precheck"](spark, sf_dir).collect()}
    assert got == want and {d for d, _ in want.values()} >= {"reject", "exact", "merge", "review"}


def test_promoted_aliases(spark, sf_dir, parts):
    names = sorted(set(parts.p_name))
    want = {(n + "s", _best(n + "s", names, 0.88)[1]) for n in names if not _refused(n + "s") and _best(n + "s", names, 0.88)}
    assert {tuple(r) for r in catalog.QUERIES["promoted_aliases"](spark, sf_dir).collect()} == want


def test_parsed_pages(spark, sf_dir, duck):
    pages = {i: h for i, h in duck.sql("SELECT page_id, html FROM pages").fetchall()}
    got = catalog.QUERIES["parsed_pages"](spark, sf_dir).collect()
    assert {r.page_id for r in got} == set(pages)
    for r in got:
        title = re.search("<title>([^<]*)</title>", pages[r.page_id])
        assert (r.title or "").strip() == html.unescape(title[1] if title else "").strip()
        assert r.n_links == len(re.findall(r"<a\s[^>]*href=", pages[r.page_id])) and r.n_text <= len(pages[r.page_id])


def test_semantic_profiles(spark, sf_dir):
    from pyspark.sql import functions as F

    base = P.STOPLIST + P.DIFFERENTIATORS + P.INTENTS + P.POSITIONING
    label = F.get(F.array(*[F.lit(x) for x in base]), F.pmod(F.xxhash64("event_id"), F.lit(len(base))).cast("int"))
    counts = {}
    for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", label.alias("t")).collect():
        counts.setdefault(r.user_id, Counter())[r.t] += 1
    got = {r.entity_id: r for r in catalog.QUERIES["semantic_profiles"](spark, sf_dir).collect()}
    for e, c in counts.items():
        original, kinds = e % 2 == 0, {"differentiators": [], "positioning": [], "intents": []}
        for t, n in c.items():
            moved = original and t == "dupe / alternative"
            name = "alternative demand" if moved else t
            for k, hit in (("differentiators", t in P.DIFFERENTIATORS and not moved), ("positioning", t in P.POSITIONING), ("intents", t in P.INTENTS or moved)):
                if hit:
                    kinds[k].append((-n, name))
        kinds = {k: [x for _, x in sorted(v)[:5]] for k, v in kinds.items()}
        if not any(kinds.values()):
            assert e not in got
            continue
        d, i = kinds["differentiators"], kinds["intents"]
        known = sum(x in P.INTENTS for x in i)
        flags = {
            "clone_market": "dupe / alternative" in d and not original, "alternative_demand": ("dupe / alternative" in d and original) or "alternative demand" in i,
            "affordable_alt": "affordable" in d, "high_intent": known >= 2 or (known >= 1 and len(i) - known >= 2), "competitive_comparison": "comparison" in i, "gifting": "gift idea" in i,
            "viral_momentum": "trending / viral" in i, "launch_window": "new release" in i or "flanker" in i, "social_validation": "compliment getter" in d, "performance_leader": "longevity / projection" in d,
        }
        sentence = f"E{e} is rising" + (", known as " + " and ".join(kinds["positioning"][:2]) if kinds["positioning"] else "") + (", driven by " + " and ".join(d[:2]) if d else "") + "."
        r = got[e]
        assert (r.differentiators, r.positioning, r.intents) == (d, kinds["positioning"], i)
        assert set(r.flags) == {k for k, v in flags.items() if v} and r.narrative == sentence


def test_create_bucket_review(spark, sf_dir, parts):
    """The ordered rules, applied one by one to every candidate."""
    from trendloom.operators import review as V

    names = sorted(set(parts.p_name))
    brands = {n.split(" ")[0]: n.split(" ")[0].capitalize() for n in names} | {"noir": "Noir"}
    aliases, master = {n.split(" ")[-1] for n in names if n > "p"}, [n.lower() for n in names]
    merges = {n + "s": n for n in names if n.startswith("f")}
    known = {n for n in names if n < "d"}
    texts = {"le parfum", "ab"}
    for n in names:
        a, z = n.split(" ")[0], n.split(" ")[-1]
        texts |= {n, n + "s", f"{a} notes", f"{a} amber", a, f"{a} zq {z}", f"noir {z}", f"quark {z}", f"{a} with {z}", f"{a} {n[::-1]}", f"{a} {z} é"}

    def decide(text, kind):
        words = text.split(" ")
        first = lambda xs, listed: next((x for x in xs if x in listed), None)
        no = "reject_create_candidate"
        if text in known:
            return "exact_now_in_kb", "now_in_kb_after_seed"
        if len(text) <= 3:
            return no, "too_short"
        if not text.isascii():
            return no, "non_ascii"
        if hit := first(words, V.FOREIGN_WORDS):
            return no, f"foreign_function_word:{hit}"
        if hit := next((p for p in V.CONTENT_PHRASES if p in text), None):
            return no, f"content_phrase:{hit}"
        if kind == "brand":
            return (no, "single_short_token_brand") if len(words) == 1 and len(text) < 4 else ("keep_as_valid_create", "new_brand")
        if kind == "note":
            return "defer_create", "unknown_entity_type:note"
        two = " ".join(words[:2])
        brand, rest = (brands[two], words[2:]) if two in brands and len(words) > 1 else (brands.get(words[0]), words[1:])
        if brand is None:
            return (no, "single_token_no_brand") if len(words) == 1 else ("defer_create", "brand_not_resolvable")
        for listed, tag in ((V.PRODUCT_FRAGMENTS, "brand_part_is_product_fragment"), (V.GENERIC_BRANDS, "brand_part_is_generic")):
            if brand.lower() in listed:
                return no, f"{tag}:{brand.lower()}"
        if not rest:
            return no, "no_perfume_part_after_brand"
        for listed, tag in ((V.PYRAMID_WORDS, "perfume_part_is_pyramid_position"), (V.CONTEXT_WORDS, "perfume_part_context_token")):
            if hit := first(rest, listed):
                return no, f"{tag}:{hit}"
        if len(rest) == 1 and rest[0] in V.NOTE_WORDS:
            return no, f"single_note_word_perfume_part:{rest[0]}"
        if " ".join(rest) in aliases:
            return "convert_to_merge", f"perfume_part_in_aliases:{' '.join(rest)}"
        if text in merges:
            return "convert_to_merge", f"fuzzy_merge:{merges[text]}"
        if close := _best(" ".join([brand.lower(), *rest]), master, V.LENIENT):
            return "convert_to_merge", f"lenient_fuzzy:{close[0]:.2f}:{close[1]}"
        return "keep_as_valid_create", f"new_perfume:brand={brand}"

    got = {(r.text, r.kind): (r.decision, r.reason) for r in catalog.QUERIES["create_bucket_review"](spark, sf_dir).collect()}
    assert got == {(t, k): decide(t, k) for t in texts for k in ("perfume", "brand", "note")}
    assert {d for d, _ in got.values()} == {"exact_now_in_kb", "reject_create_candidate", "convert_to_merge", "keep_as_valid_create", "defer_create"}
