"""The Merkle manifest against a plain construction: roots, proofs, folding, edges."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from trendloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def tree(hashes):
    """(root, for each leaf the (left, right) siblings level by level)."""
    paths, owners = [[] for _ in hashes], [[k] for k in range(len(hashes))]
    while len(hashes) > 1:
        above, above_owners = [], []
        for a in range(0, len(hashes), 8):
            run = hashes[a : a + 8]
            above.append(h("".join(run)))
            for x in range(len(run)):
                for o in owners[a + x]:
                    paths[o].append(("".join(run[:x]), "".join(run[x + 1 :])))
            above_owners.append([o for part in owners[a : a + 8] for o in part])
        hashes, owners = above, above_owners
    return hashes[0], paths


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda name: b"" if name is None else b"=" + name.encode())
    trees = {}
    for name in langs:
        by[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[name] = tree([leaf(r, r[4]) for r in by[name]])
    root, top = tree([trees[name][0] for name in langs]) if langs else (None, [])
    out = []
    for j, name in enumerate(langs):
        for k, r in enumerate(by[name]):
            path = trees[name][1][k] + top[j]
            tampered = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            now = leaf(r, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]) if tampered else r[4])
            for left, right in path:
                now = h(left + now + right)
            out.append((r[0], leaf(r, r[4]), trees[name][0], root, h("".join(a + b for a, b in path)), now, now == root))
    return sorted(out, key=str)


def run(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return sorted((tuple(r) for r in merkle.query(spark, str(path)).collect()), key=str)


def table(n, seed):
    random.seed(seed)
    langs = [None, "", "de", "en", "en", "en", "zé", *[f"l{k}" for k in range(9)]]
    text = lambda k: random.choice([None, "", f"Äpfel {k}", f"ABC {k}", "same Text", "x" * 5000])
    return [(k, random.choice([None, "web", "ß"]), random.choice(langs), random.choice([None, 0, k]), text(k)) for k in range(n)]


@pytest.mark.parametrize("rows", [table(150, 1), table(9, 2), table(1, 3), [(5, None, None, None, None)], []], ids=["150", "9", "1", "nulls", "empty"])
def test_equals_plain_construction(spark, tmp_path, rows):
    assert run(spark, rows, tmp_path) == brute(rows)


def test_repeated_rows_and_null_ids(spark, tmp_path):
    rows = [(7, "s", "en", 3, "Abc")] * 70 + [(None, "s", "en", 3, "Abc")] * 3 + [(7, "s", "en", 3, "other")] * 2
    assert run(spark, rows, tmp_path) == brute(rows)


def test_equal_leaves_over_many_partitions(spark, tmp_path):
    rows = [(k // 40, "s", "en" if k % 3 else None, 3, "Abc") for k in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((tuple(r) for r in merkle.query(spark, str(tmp_path)).collect()), key=str) == brute(rows)


def test_clashing_columns_stay_apart_and_changes_show(spark):
    docs = spark.createDataFrame([(k, "s", "en", 1, f"T{k}", "mine", 1, 2) for k in range(20)], SCHEMA + ", Leaf string, _g int, _i int")
    one = merkle.verified(docs, merkle.FIELDS, "lang", "doc_id", {}, F.lit(True))
    assert [c.lower() for c in one.columns] == [*[x.split()[0] for x in SCHEMA.split(", ")], "_g", "_i", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert all(r.verified and len(r.leaf) == 64 for r in one.collect())
    other = merkle.verified(docs, merkle.FIELDS, "lang", "doc_id", {"source": F.lit("t")}, F.col("doc_id") == 3)
    assert [r.doc_id for r in other.collect() if not r.verified] == [3]
