"""License scan, Merkle manifest and spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import merkle_manifest
from ledgerlens.llm.license_rules import KINDS, RULES, Rule
from ledgerlens.llm.license_scan import scan_licenses
from ledgerlens.llm.merkle_manifest import climbed, descended, folded, hashed, merkle_proofs
from ledgerlens.llm.spelling_variants import spelling_variants, variant_groups, word_counts
from tests.llm.frames import SCHEMA, edge_rows, frame

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# --- licenses --------------------------------------------------------------------------------------------------------

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def brute_licenses(doc_id, text):
    """Every rule on every text, every pair of places compared."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    base = [(k, label) for p, label in PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    joined = " " + " ".join(w) + " " if w else " "
    found = []
    for number, rule in enumerate(RULES):
        for m in re.finditer(f" (?:{rule.pattern})(?= )", joined):
            start = joined[: m.start()].count(" ")
            found.append((start, start + m[0].count(" "), number, list(KINDS).index(rule.kind)))

    def beats(a, b):
        order = lambda x: (x[0], -x[1], x[2])
        return a[0] <= b[0] and a[1] >= b[1] and (a[3] < b[3] or (a[3] == b[3] and order(a) < order(b)))

    kept = [x for x in found if x[3] == 0 or not any(beats(y, x) for y in found)]
    places = [k for k, _ in base]
    return (
        doc_id, len(w), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base})),
        ",".join(sorted({RULES[x[2]].label for x in kept})), max((KINDS[RULES[x[2]].kind] for x in kept), default=0.0), sorted(x[:3] for x in kept),
    )


SNIPPETS = [
    "Licensed under CC BY-NC 4.0.", "MIT License", "mit\n\tlicense", "Apache License, Version 2.0", "licensed under the terms of the Apache License v2",
    "This program is free software under the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "GNU Lesser General Public License version 2.1", "SPDX-License-Identifier: GPL-3.0-or-later", "https://creativecommons.org/licenses/by-sa/4.0/", "CC BY", "cc by cc by", "GPLv3",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "All rights reserved.", "bsd style license", "3-Clause BSD License",
    "Redistribution and use in source and binary forms, with or without modification, are permitted", "gnu general public licenses", "émit license", "MIT LICENSE\x00mit license", "ＭＩＴ license",
]


def test_licenses_against_brute_force(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice([*SNIPPETS, "river", "İstanbul", "a 12 b", "...", "_"]) for _ in range(r.randint(0, 12)))) for i in range(200)]
    rows += [(i + 1000, s) for i, s in enumerate(SNIPPETS)] + [(2000, "x " * 60_000 + "cc by " + "mit license " * 20_000), (2001, None), (2002, ""), (2003, " .-; ")]
    found = {x["doc_id"]: x for x in scan_licenses(frame(spark, rows, clashes=True)).collect()}
    assert len(found) == len(rows)
    for doc_id, text in rows:
        if doc_id == 2000:
            continue
        x = found[doc_id]
        got = (doc_id, x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"], x["labels"], x["score"], sorted((p["start"], p["stop"], p["rule"]) for p in x["places"]))
        assert got == brute_licenses(doc_id, text), text
    long = found[2000]
    assert (long["n_words"], long["n_base"], long["first_word"], long["last_word"], long["labels"]) == (100_002, 20_001, 60_000, 100_000, "cc-by,mit")


def test_rules_hold_their_keywords():
    assert len(RULES) > 300
    assert [r.kind for r in RULES[:4]] == ["base"] * 4
    order = [list(KINDS).index(r.kind) for r in RULES]
    assert order == sorted(order)
    for rule in RULES:
        spelled = re.sub(r"\(\?:[^()]*\)\?|\S\?", "", rule.pattern)
        words = [w for w in re.findall(r"[a-z0-9]+", rule.keyword)]
        assert all(w[:4] in spelled or w[:4] in rule.pattern for w in words), rule


def test_base_rules_come_first(spark):
    with pytest.raises(ValueError):
        scan_licenses(frame(spark, []), [Rule("a", "name", "a", "a"), Rule("b", "base", "b", "b")])


# --- proofs ----------------------------------------------------------------------------------------------------------


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def brute_tree(digests):
    paths, owners, now = [[] for _ in digests], [[i] for i in range(len(digests))], list(digests)
    while len(now) > 1:
        after, after_owners = [], []
        for s in range(0, len(now), 3):
            run = now[s : s + 3]
            for k in range(len(run)):
                for o in owners[s + k]:
                    paths[o].append(("".join(run[:k]), "".join(run[k + 1 :])))
            after.append(hashed(*run))
            after_owners.append(sum(owners[s : s + 3], []))
        now, owners = after, after_owners
    return now[0], paths


def brute_proofs(rows, tamper):
    leaf = lambda r, text: hashed(*[field(v) for v in (r[0], r[3], r[2], r[4], text)])
    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append((r, leaf(r, r[1])))
    trees = {}
    for source, found in groups.items():
        found.sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[source] = brute_tree([d for _, d in found])
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    root, top = brute_tree([trees[s][0] for s in order]) if order else ("", [])
    out = []
    for source, found in groups.items():
        for (r, digest), path in zip(found, trees[source][1], strict=True):
            path = path + top[order.index(source)]
            again = leaf(r, tamper(r))
            for a, b in path:
                again = hashed(a, again, b)
            out.append((r[0], digest, trees[source][0], root, hashed(*[a + b for a, b in path]), again, again == root))
    return sorted(out, key=str)


def tampered(doc_id, text):
    return text.replace("\n", "") if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 else text


def proofs(docs):
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle_proofs(docs, F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))


@pytest.mark.parametrize("block_levels", [1, 2, 5])
def test_proofs_against_brute_force(spark, monkeypatch, block_levels):
    monkeypatch.setattr(merkle_manifest, "BLOCK_LEVELS", block_levels)
    r = random.Random(block_levels)
    sources = [None, "", "b", "é", "hot", "hot", "hot", "𐍈", "zz"]
    rows = [(i if i % 50 else None, r.choice(["a\nb", "", None, f"text {i}", "\n\n"]), r.choice(["en", None]), r.choice(sources), r.choice([None, i])) for i in range(320)]
    rows += [(7, "same", "en", "lone", 4)] + [(8, "twice\n", "en", "hot", 4)] * 3
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("grp", "idx", "n", "row", "digest", "name", "path", "leaf")})
    found = sorted((tuple(x) for x in proofs(docs).collect()), key=str)
    assert found == brute_proofs(rows, lambda x: tampered(x[0], x[1]))
    assert {x[-1] for x in found} == {True, False}


def test_proofs_of_edges(spark):
    assert proofs(frame(spark, [])).collect() == []
    one = proofs(frame(spark, [(1, "a\n")])).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == sha256(b"").hexdigest()
    found = sorted((tuple(x) for x in proofs(frame(spark, edge_rows(), clashes=True)).collect()), key=str)
    full = [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in edge_rows()]
    assert found == brute_proofs(full, lambda x: tampered(x[0], x[1]))


def test_sweeps_of_one_block():
    for n in (1, 2, 3, 4, 9, 10, 28, 81):
        digests = [hashed(str(i)) for i in range(n)]
        root, paths = brute_tree(digests)
        nodes = climbed(digests, merkle_manifest.levels_over(n))
        assert nodes[-1] == [root]
        told = descended(nodes, "")
        assert [[tuple(s.split(".")) for s in p.split(";")[:-1]] for p in told] == paths
        assert {folded(d, p) for d, p in zip(digests, told, strict=True)} == {root}


# --- spelling variants -----------------------------------------------------------------------------------------------


def brute_counts(rows, min_length, min_count, typo_every):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if typo_every and h % typo_every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= min_length:
                counts[word] += 1
    return {w: n for w, n in counts.items() if n >= min_count}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute_variants(counts, ratio):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    best = {w: min(near[w], key=lambda v: (-counts[v], v), default=None) for w in counts}
    form = {w: b if b is not None and counts[b] >= ratio * counts[w] else None for w, b in best.items()}
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


@pytest.mark.parametrize("typo_every", [None, 5])
def test_variants_against_brute_force(spark, typo_every):
    r = random.Random(3)
    base = ["calendar", "Straßenbahn", "ÀÉÎcôtés", "aabbaabb", "letters", "settler", "trestle", "zzzzzzzzz", "oooooooooo", "abcdefg×÷"]
    rows = []
    for i in range(400):
        words = []
        for _ in range(r.randint(0, 20)):
            w = r.choice(base)
            if r.random() < 0.15:
                k = r.randrange(len(w))
                w = w[:k] + r.choice(["", "e", "é", w[k] + "s", w[k] * 2]) + w[k + 1 :]
            words.append(w.upper() if r.random() < 0.1 and w.isascii() else w)
        rows.append((i if i % 37 else None, r.choice([" ", ", ", "\n", "1"]).join(words)))
    rows += [(5000, None), (5001, ""), (5002, "a" * 50_000 + " " + "a" * 50_000)]
    docs = frame(spark, rows, clashes=True)
    expected = brute_counts(rows, 7, 2, typo_every)
    assert {x["word"]: x["n"] for x in word_counts(docs, 7, 2, typo_every).collect()} == expected
    found = sorted((tuple(x) for x in spelling_variants(docs, 7, 2, 10, typo_every).collect()), key=lambda x: x[0])
    assert found == brute_variants(expected, 10)
    assert any(x[1] for x in found)


def test_all_words_of_one_edit_meet(spark):
    r = random.Random(9)
    words = {"".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(700)}
    counts = {w: r.choice([1, 2, 30, 400, 5000, 60_000]) for w in words}
    found = variant_groups(spark.createDataFrame(sorted(counts.items()), "word string, n long")).collect()
    assert sorted((tuple(x) for x in found), key=lambda x: x[0]) == brute_variants(counts, 10)
    assert any(x["root"] != x["form"] for x in found if x["form"])


def test_variants_of_edges(spark):
    assert spelling_variants(frame(spark, [])).collect() == []
    assert spelling_variants(frame(spark, [(None, None), (1, ""), (2, "one two")])).collect() == []
    assert spelling_variants(frame(spark, edge_rows(), clashes=True)).count() > 0
