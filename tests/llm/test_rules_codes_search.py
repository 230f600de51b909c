"""Fertility rules, vector codes and ranked search against brute force, with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

import cueloom.llm.fertility as fertility
import cueloom.llm.ranked_search as ranked
import cueloom.llm.vector_codes as codes
from tests.llm.test_llm_texts import ODD, prose, table


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    again = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(again), failed


def test_fertility_rules(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randrange(60, 300), "etaoinshr")) for i in range(300)]
    rows += [(i, "".join(f"{w}{'$%&'[j % 3] * 3} " for j, w in enumerate(prose(rng, 120, "etaoinshr").split()))) for i in range(300, 306)]  # junk signs
    rows += [(306, "a b c " * 40), (307, "one line\n\none line \none line\nx\x0by\x1cz # < >\n" * 2), (308, "é漢 " * 49 + "z"), (309, prose(rng, 200_000, "etaoinshr")), (310, "x" * 1_000_000 + " " + prose(rng, 60, "etaoinshr"))]
    rows += [(311 + i, " ".join(chr(0x10300 + rng.randrange(30)) * 3 for _ in range(80))) for i in range(2)]  # a script that pieces spell in bytes
    rows += ODD
    got = fertility.fertility_rules(table(spark, rows), lang_col=None).collect()
    assert len(got) == len(rows)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_words"])
    want = sorted(((doc is None, doc or 0, *plain_counts(text)) for doc, text in rows), key=str)
    assert sorted(((*key(r)[:2], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got), key=str) == want
    by = {r["doc_id"]: r for r in got}
    assert all(not r["kept"] and r["piece_chars"] is None for r in got if r["base_failed"])
    assert np.mean([by[i]["kept"] for i in range(300)]) == 1 and not any(by[i]["kept"] for i in range(300, 306))
    assert by[311]["fallback"] > 500 and by[311]["band_group"] == "script:other" and by[0]["fallback"] == 0
    assert fertility.fertility_rules(table(spark, []).drop("lang"), lang_col=None).count() == 0


def test_fertility_measures_and_bands(spark):
    import sentencepiece

    words = "the quick bröwn fox 漢字 jumps over it and runs away from all lazy dogs " * 3 + " ".join(f"w{i}" for i in range(60))
    pieces, byte = fertility.default_vocabularies()
    script, n, chars, *_, size, piece_chars, byte_chars, fallback, entropy = fertility.measure(words.encode(), fertility.Vocabularies(pieces, byte))
    model = sentencepiece.SentencePieceProcessor(model_file=pieces)
    tokens = [t for w in words.split() for t in model.encode(w)]
    share = np.array(list(Counter(tokens).values())) / len(tokens)
    assert (script, piece_chars, size) == ("latin", round(1000 * chars / len(tokens)), len(tokens).bit_length())
    assert fallback == round(1000 * sum(map(model.is_byte, tokens)) / len(tokens)) and entropy == round(1000 * -(share * np.log2(share)).sum())
    rows = [(g, False, 5, v, v, 0, v) for g in ("a", "b") for v in (100, 101, 103, 110, 200)] + [("c", False, 5, 7, 7, 300, 7), ("a", True, None, None, None, None, None)]
    got = {(r["measure"], r["band_group"]): r for r in fertility.bands(spark.createDataFrame(rows, "band_group string, base_failed boolean, size_class int, piece_chars int, byte_chars int, fallback int, entropy int"), 2.0).collect()}
    assert got["piece_chars", "a"]["least"] == 103 - max(2 * 1.4826 * 3, 0.08 * 103) and got["fallback", "c"]["most"] == 350 and got["fallback", "c"]["least"] == -math.inf
    assert len(got) == 12 and got["entropy", "b"]["at"] == 5


def lloyd(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, label, [math.floor(scale * np.float64(x)) for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            taken = [near(p, c[p])[1] for c in cut]
            for e in set(taken):
                mine = [c[p] for c, t in zip(cut, taken) if t == e]
                books[p][e] = tuple(sum(x) // len(mine) for x in zip(*mine))
    error, out = Counter(), []
    for (i, label, _), c in zip(kept, cut):
        best = [near(p, c[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
        error[label] += out[-1][3]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, code, e, error[label]) for i, label, code, e in out), key=str), digest


@pytest.mark.parametrize("leaves", [4, 4096])
def test_vector_codes(spark, leaves, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK", 40)
    monkeypatch.setattr(codes.walk, "__defaults__", (leaves,))
    rng = np.random.default_rng(5)
    f = lambda v: [float(np.float32(x)) for x in v]
    rows = [(int(i) * 3 % 211, int(i) % 3 if i % 5 else None, f(rng.normal(0, 0.2, 16))) for i in range(150)]
    rows += [(500 + i, 0, rows[7][2]) for i in range(60)] + [rows[9], rows[9], (None, 1, rows[3][2])]  # copies, repeated rows, a null id
    rows += [(900, 1, None), (901, 1, f([math.nan] + [0] * 15)), (902, None, f([math.inf] * 16)), (903, 2, [None] + [0.5] * 15), (904, 2, [0.0] * 16)]
    frame = lambda r: spark.createDataFrame(r, "vec_id long, label int, embedding array<float>").selectExpr("*", "1 as code", "2 as v", "3 as key", "4 as error")
    found, books = codes.compress(frame(rows))
    got = sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in codes.with_group_error(found).collect()), key=str)
    want, digest = lloyd(rows)
    assert got == want and codes.codebooks_digest(books) == digest
    for few in (rows[:3], [(1, None, None)], []):
        found, books = codes.compress(frame(few))
        assert codes.with_group_error(found).count() == (3 if few == rows[:3] else 0) and (books is None) == (few != rows[:3])
    odd, _ = codes.compress(frame([(1, 1, [0.5] * 11), (2, 1, [3e38] * 11), (3, 1, [0.1] * 4)]))  # 11 components are filled up, another length is left out
    assert {(r["vec_id"], r["code"]) for r in odd.collect()} == {(1, "00" * 8), (2, "01" * 5 + "01" + "00" * 2)}


def test_walk_shares_prefixes():
    rng = np.random.default_rng(1)
    parts = rng.integers(-3, 4, (3000, 5)).astype(np.int32)
    leaves, copies, place = codes.trie(parts)
    assert (leaves[place] == parts).all() and copies.sum() == 3000 and len({tuple(x) for x in parts}) == len(leaves)
    entries = rng.integers(-3, 4, (7, 5))
    for at_most in (1, 3, 50, 10_000):
        seen = sorted(codes.walk(leaves, entries, at_most), key=lambda x: x[0])
        assert [x[1] for x in seen[:-1]] == [x[0] for x in seen[1:]] and (seen[0][0], seen[-1][1]) == (0, len(leaves))
        assert (np.concatenate([x[2] for x in seen]) == ((leaves[:, None].astype(int) - entries[None]) ** 2).sum(axis=2)).all()


def rank(docs, items, k=10):
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s or "")
    held = [(i, Counter(re.findall(pattern, low(t)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms, df = len(held), sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(re.findall(pattern, low(text))) if c[t])
            scored.append((-score, doc is None, doc or 0))
        out += [(item, r, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(x for x in scored if x[0] < 0)[:k], 1)]
    return sorted(out, key=str)


def test_ranked_search(spark, monkeypatch):
    monkeypatch.setattr(ranked, "SHARD_BYTES", 300)
    monkeypatch.setattr(ranked, "ITEM_STEP", 2)
    monkeypatch.setattr(ranked, "BLOCK_DOCS", 8)
    rng = random.Random(8)
    words = [prose(rng, 1, "etaoinshr") + str(i % 7) for i in range(400)]
    text = lambda n: " ".join(words[min(399, int(rng.expovariate(0.02)))] for _ in range(n))
    docs = [(i, text(rng.randrange(1, 80))) for i in range(400)]
    docs += [(1000 + i, docs[5][1].upper()) for i in range(40)] + [docs[6], docs[6], (None, docs[6][1]), (2000, text(60_000)), *ODD, (905, "!!! ...")]
    items = [(i, docs[i * 7][1]) for i in range(12)] + [(5, "Ünï 漢字-ETA"), (5, docs[5][1]), (None, docs[9][1]), (21, None), (22, ""), (23, "zzzz unknown")]
    found = ranked.search(ranked.build_index(table(spark, docs)), table(spark, items, "item_id long, text string"))
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()), key=str) == rank(docs, items)
    index = ranked.build_index(table(spark, []))
    assert ranked.search(index, table(spark, items, "item_id long, text string")).count() == 0
    assert ranked.search(ranked.build_index(table(spark, docs[:9])), table(spark, [], "item_id long, text string")).count() == 0
