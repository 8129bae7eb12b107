import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from ledgerlens.llm import suffix_dedup
from ledgerlens.llm.components import connected_components
from ledgerlens.llm.embedding_dedup import embedding_components, quantised, tile_strips
from ledgerlens.llm.line_dedup import remove_repeated_lines
from ledgerlens.llm.simhash_dedup import block_masks, near_links, simhash_components, simhashes
from ledgerlens.llm.suffix_dedup import contexts, longest_previous, previous_smaller, remove_repeats
from tests.llm.frames import frame, prose


def smallest_reachable(nodes, edges):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def repeats_by_hand(rows, length=50):
    seen, out = {}, {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if seen.setdefault(raw[i : i + length], doc_id) < doc_id:
                gone[i : i + length] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out[doc_id] = (len(raw), int(gone.sum()), int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1)), hashlib.sha256(kept).hexdigest())
    return out


def planted(n=40):
    r, rows = random.Random(9), []
    passages = [prose(100 + k, 30) for k in range(4)]
    for i in range(n):
        text = prose(i, r.randint(0, 60))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            cut = r.randint(0, len(p))
            text = text[:cut] + p[: r.randint(0, len(p))] + text[cut:]
        rows.append((i, text if r.random() < 0.8 else r.choice(passages)))
    return rows


def test_repeats_equal_brute_force(spark):
    rows = planted()
    expected = repeats_by_hand(rows)
    assert sum(e[1] for e in expected.values()) > 1000
    for crowd in (suffix_dedup.CROWD, 1):  # by arrays, and by strings for every anchor
        found = remove_repeats(frame(spark, rows), crowd=crowd)
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found.collect()} == expected


def test_a_crowded_filter_changes_nothing(spark):
    rows = planted(15)
    found = remove_repeats(frame(spark, rows), bits=9, keep_bytes=False)
    assert {r["doc_id"]: r["n_removed"] for r in found.collect()} == {k: v[1] for k, v in repeats_by_hand(rows).items()}


def test_contexts_hold_every_string_once(monkeypatch):
    r = random.Random(3)
    rows = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 300))) for _ in range(20)] + [b"a" * 500]
    data, at = np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
    found = []
    for chunk in (1 << 20, 97):
        monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
        start, count, h = contexts(data, at, 20, 8)
        assert count.max() <= 13
        filed = [(s + k, anchor) for s, n, anchor in zip(start.tolist(), count.tolist(), h.tolist(), strict=True) for k in range(n)]
        assert [s for s, _ in filed] == [s for i in range(len(rows)) for s in range(at[i], at[i + 1] - 19)]
        found.append(filed)
    assert found[0] == found[1]
    by_string = {}
    assert all(by_string.setdefault(bytes(data[s : s + 20]), anchor) == anchor for s, anchor in found[0])


def test_longest_previous_factors():
    r = random.Random(3)
    rows = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 120))) for _ in range(12)]
    data, at = np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
    spot, factor = longest_previous(data, at, np.arange(12), 20)
    for s, found in zip(spot.tolist(), factor.tolist(), strict=True):
        own = int(np.searchsorted(at, s, "right")) - 1
        text = rows[own][s - at[own] :]
        best = 0
        for j in range(own):
            for k in range(len(rows[j]) - 19):
                same = 0
                while same < 20 and rows[j][k + same] == text[same]:
                    same += 1
                best = max(best, same)
        assert found == best


def test_previous_smaller():
    values = np.array([3, 1, 4, 1, 5, 9, 2, 6, 5, 3])
    assert previous_smaller(values).tolist() == [max((j for j in range(i) if values[j] < values[i]), default=-1) for i in range(10)]


def lines_by_hand(rows):
    first, gone = {}, {}
    for doc_id, text in sorted(rows):
        lines = text.split("\n")
        for i in range(len(lines) - 2):
            block = tuple(lines[i : i + 3])
            if any(x.strip(" ") for x in block):
                d, k = first.setdefault(block, (doc_id, i))
                if d != doc_id or i >= k + 3:
                    gone.setdefault(doc_id, set()).update(range(i, i + 3))
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ())) for d, t in rows}


def test_lines_equal_brute_force(spark):
    r = random.Random(4)
    rows = [(i, "\n".join(r.choice(("a", "b", "", " ", "c")) for _ in range(r.randint(0, 12)))) for i in range(60)]
    found = {x["doc_id"]: x["text"] for x in remove_repeated_lines(frame(spark, rows)).collect()}
    assert found == lines_by_hand(rows)


def test_a_run_of_equal_lines_keeps_the_first_three(spark):
    found = remove_repeated_lines(frame(spark, [(1, "\n".join("x" * 10)), (2, None), (3, "x\nx")])).collect()
    assert {r["doc_id"]: r["text"] for r in found} == {1: "x\nx\nx", 2: None, 3: "x\nx"}


def simhash_by_hand(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    rows = ["", " \n\t", "One", "A b C", "a b c d", "É É é é a\x0bb", prose(1, 300), "x " * 50]
    assert [int(x) for x in simhashes(pa.array(rows))] == [simhash_by_hand(t) for t in rows]


def test_close_fingerprints_share_a_key():
    r, masks = random.Random(1), [m % (1 << 64) for m in block_masks(4)]
    for _ in range(500):
        flips = sum(1 << b for b in r.sample(range(64), 4))
        assert any(not flips & m for m in masks)


def test_components_of_fingerprints(spark):
    r = random.Random(8)
    seeds = [r.getrandbits(64) for _ in range(6)]
    values = {s ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for s in seeds for _ in range(40)}
    nodes = {i: v for i, v in enumerate(sorted(values))}
    edges = [(a, b) for a in nodes for b in nodes if a < b and (nodes[a] ^ nodes[b]).bit_count() <= 4]
    table = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in nodes.items()], "node long, bits long")
    for tile in (2048, 4):  # the second splits keys into tiles
        links = near_links(table, 4, tile=tile)
        found = {x["node"]: x["label"] for x in connected_components(links).collect()}
        assert {i: found.get(i, i) for i in nodes} == smallest_reachable(nodes, edges)


def test_simhash_of_documents(spark):
    base = prose(5, 400)
    rows = [(5, base), (3, base), (9, base.replace(" ", " \n", 1).upper()), (1, ""), (2, None), (4, " "), (7, prose(6, 400))]
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_components(frame(spark, rows)).collect()}
    assert found[5] == (format(simhash_by_hand(base), "016x"), 3) and found[9][1] == 3 and found[7][1] == 7
    assert found[1] == found[2] == found[4] == ("0" * 16, 1)


def test_a_long_path_is_one_component(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (200, 200)]
    found = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_quantisation_bounds_hold():
    r = np.random.default_rng(1)
    unit = r.normal(size=(300, 48))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    codes, scale, error = quantised(unit)
    product = (codes.astype(int) @ codes.astype(int).T) * scale[:, None] * scale[None, :]
    assert (np.abs(unit @ unit.T - product) <= error[:, None] + (1 + error[:, None]) * error[None, :]).all()


def test_tiles_find_every_pair():
    r = np.random.default_rng(2)
    unit = r.normal(size=(20, 16))[r.integers(0, 20, 700)] + 0.25 * r.normal(size=(700, 16))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    for threshold in (0.9, 0.1, -0.5):
        strips = list(tile_strips(unit, unit, threshold, True))
        i, j, checked = np.concatenate([x[0] for x in strips]), np.concatenate([x[1] for x in strips]), sum(x[2] for x in strips)
        expected = {(a, b) for a, b in zip(*np.nonzero(np.einsum("ik,jk->ij", unit, unit) >= threshold), strict=True) if a < b}
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == expected and checked >= len(expected)


def test_a_tile_of_near_vectors_needs_little_memory():
    import tracemalloc

    r = np.random.default_rng(4)
    unit = 1 + 0.01 * r.normal(size=(3000, 16))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    tracemalloc.start()
    assert sum(len(i) for i, _, _ in tile_strips(unit, unit, 0.9, True)) == 3000 * 2999 // 2
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def test_vectors_without_id_link_others(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.72, 0.69]), (None, [0.93, 0.3676]), (None, [-1.0, 0.0]), (None, [-1.0, 0.1]), (5, [0.0, -1.0])]
    found = embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {x["vec_id"]: (x["n_links"], x["component_id"]) for x in found if x["vec_id"]} == {1: (1, 1), 2: (1, 1), 5: (0, 5)}
    assert sorted((x["n_links"], x["component_id"] or -1, x["kept"]) for x in found if x["vec_id"] is None) == [(1, -1, False), (1, -1, False), (2, 1, False)]
    bare = spark.createDataFrame([(None, [1.0]), (None, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(x) for x in embedding_components(bare).collect()] == [(None, 1, None, False)] * 2


def test_crowded_strings_over_many_batches(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SETTLED_ROWS", 50)
    rows = [(i, prose(7, 12) + prose(i, 3) * (i % 3)) for i in range(60)] + [(100 + i, "ab" * 60) for i in range(5)]
    found = remove_repeats(frame(spark, rows).repartition(7), crowd=1)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found.collect()} == repeats_by_hand(rows)


def test_fingerprints_of_rows_without_id(spark):
    text = prose(5, 200)
    rows = [(None, text), (9, text + " end"), (None, prose(6, 200)), (4, prose(8, 200))]
    found = [(r["doc_id"], r["component_id"]) for r in simhash_components(frame(spark, rows)).collect()]
    assert sorted(found, key=str) == sorted([(None, 9), (9, 9), (None, None), (4, 4)], key=str)


def test_vectors_equal_brute_force(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(25, 12))[r.integers(0, 25, 300)] + 0.2 * r.normal(size=(300, 12))
    base[50:60] = base[49]
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(r.permutation(300), base.astype(np.float32), strict=True)]
    unit = np.array([v for _, v in sorted(rows)])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    label = smallest_reachable(range(300), list(zip(*map(list, np.nonzero(near)), strict=True)))
    for block in (4096, 64):
        found = embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=block).collect()
        assert {x["vec_id"]: (x["n_links"], x["component_id"]) for x in found} == {i: (int(near[i].sum()) - 1, label[i]) for i in range(300)}
