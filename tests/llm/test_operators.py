"""Each operator on awkward documents, on none, and against a plain version."""

import hashlib
import itertools
import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelwright.llm import cover_tree, encode, jaccard_join, language_id, mixing, packing, pii, quality_mcd, shingles, token_files, toxic_crf, url_rules
from panelwright.llm.components import connected_components
from tests.llm.helpers import LONG, PROSE, SCHEMA, TEXTS, documents, rows, words

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- tokens ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_library(path):
    rng = random.Random(1)
    letters = [*" \n\t.,;!abcDEF's12é-–\"|<>_$\r\x0b", "  ", "'ll", " don't", "<|endoftext|>", "\x1c", "日本", "İ", "\u00a0", "\u2028"]
    texts = ["".join(rng.choices(letters, k=rng.choice([0, 1, 3, 9, 60]))) for _ in range(1500)] + [t for _, t in TEXTS]
    own, whole = encode.Encoder(path), Tokenizer.from_file(path)
    got = [ids[o[i] : o[i + 1]].tolist() for ids, o in own.rows(pa.array(texts, pa.string())) for i in range(len(o) - 1)]
    assert got == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_encoder_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(encode, "CACHE_CHUNKS", 50)
    monkeypatch.setattr(encode, "STEP_BYTES", 200)
    own, whole = encode.Encoder(WORDS), Tokenizer.from_file(WORDS)
    texts = [f"alpha{i} beta{i % 7}, gamma" for i in range(300)]
    got = [ids[o[i] : o[i + 1]].tolist() for ids, o in own.rows(pa.array(texts)) for i in range(len(o) - 1)]
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts] and len(own.slot) < 200


def test_token_files_round_trip(docs, none, tmp_path):
    manifest = token_files.write_token_files(docs, BYTES, str(tmp_path), length=16, rows=4)
    got = token_files.read_token_files(manifest, with_ids=True).collect()
    whole = Tokenizer.from_file(BYTES)
    wanted = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    ids = [whole.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in wanted]
    starts = np.cumsum([0, *map(len, ids)])
    assert sorted((r["start"], r["n_tokens"], r["ids_crc32"], r["doc_id"], r["ids"]) for r in got) == [
        (int(s), len(x), zlib.crc32(np.array(x, "<u4").tobytes()), r[0], x) for s, x, r in zip(starts, ids, wanted)
    ]
    flat, at = [i for x in ids for i in x], 0
    for m in manifest.orderBy("shard").collect():
        one, filled = token_files.SequenceFile(m["path"]), 0
        for k in range(len(one)):
            tokens, mask = one[k]
            assert len(tokens) == len(mask) == 16 and tokens[mask].tolist() == flat[at : at + mask.sum()]
            at += int(mask.sum())
            filled += int(mask.sum())
        assert filled == m["n_tokens"]
    assert at == len(flat)
    assert token_files.read_token_files(token_files.write_token_files(none, BYTES, str(tmp_path / "none"))).count() == 0


def test_packing(docs, none):
    got = packing.pack_documents(docs, WORDS, size=64, with_ids=True).collect()
    whole = Tokenizer.from_file(WORDS)
    ids = {(r[0], r[1]): whole.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in rows()}
    wanted = Counter((r[0], k, lo, tuple(ids[r[0], r[1]][lo : lo + 64])) for r in rows() for k, lo in enumerate(range(0, len(ids[r[0], r[1]]), 64)))
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(r["ids"])) for r in got) == wanted
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) for r in got)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist() and sum(n for _, n in own) <= 64
    assert sorted(bins) == list(range(len(bins)))
    assert packing.pack_documents(none, WORDS).count() == 0


def test_plan_uses_all_and_fills_well():
    rng = random.Random(2)
    for size, top in ((100, 100), (100, 40), (4096, 4096), (30, 16)):
        counts = Counter(rng.randint(1, top) for _ in range(2000))
        bins = packing.plan_bins(dict(counts), size)
        used = Counter()
        for own, n in bins:
            assert sum(k * m for k, m in own.items()) <= size
            for k, m in own.items():
                used[k] += m * n
        assert used == counts
        least = -(-sum(k * n for k, n in counts.items()) // size)
        assert sum(n for _, n in bins) <= least * 1.02 + 1 or top > size / 2


def test_best_two_replace_the_shortest():
    # greedy takes 6 and 3, which leaves 1; 2 + 2 fill the 4 that the 3 leaves
    assert packing.plan_bins({6: 1, 3: 1, 2: 2}, 10)[0] == ({6: 1, 2: 2}, 1)


# ---- shingles, components, Jaccard ----------------------------------------------------------------------------


def shingle_set(text, width):
    w = words((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def test_shingle_sets_have_the_right_sizes_and_overlaps():
    texts = [t for _, t in TEXTS]
    data, offsets = shingles_input(texts)
    for width in (1, 3, 5):
        own, plain = list(shingles.shingle_sets(data, offsets, width)), [shingle_set(t, width) for t in texts]
        assert [len(x) for x in own] == [len(x) for x in plain]
        assert all(len(np.intersect1d(own[i], own[j])) == len(plain[i] & plain[j]) for i in range(len(texts)) for j in range(i))


def shingles_input(texts):
    from panelwright.llm.common import text_bytes

    return text_bytes(pa.array(texts, pa.string()))


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(70)] + [(500, i) for i in range(501, 560)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame([*links, (None, 3), (7, 7)], "a long, b long"), "a", "b").collect()}
    want = components({x for p in links for x in p}, links)
    assert got == {k: v for k, v in want.items() if k in got} and all(k in got for p in links for k in p if p[0] != p[1])
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize(("width", "threshold"), [(3, Fraction(9, 10)), (5, Fraction(8, 10))])
def test_jaccard_against_all_pairs(spark, none, monkeypatch, width, threshold):
    monkeypatch.setattr(jaccard_join, "PAIRS_UP_TO", 6)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 900)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 7)
    rng, texts = random.Random(4), list(TEXTS)
    for g in range(12):
        base = [rng.choice("abcdefgh") + str(rng.randrange(60)) for _ in range(rng.choice([4, 20, 120]))]
        for k in range(rng.choice([2, 5, 30])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = f"new{rng.randrange(10)}"
            texts.append((1000 + 100 * g + k, " ".join(own)))
    got = jaccard_join.jaccard_classes(documents(spark, texts), width=width, threshold=threshold).collect()
    sets = {i: shingle_set(t, width) for i, t in texts if i is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    want = components(sets, links)
    assert len(got) == len(texts)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["component_id"], r["n_shingles"]) == (want[r["doc_id"]], len(sets[r["doc_id"]]))
    assert jaccard_join.jaccard_classes(none).count() == 0


def test_shared_shingles_come_last_where_all_cells_are_full(spark, monkeypatch):
    """262 shingles of others in each cell: those of 60 documents must still stand out, or prefixes fill with them."""
    monkeypatch.setattr(jaccard_join, "SKETCH_BITS", 8)
    monkeypatch.setattr(jaccard_join, "SLICE_BITS", 6)
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(44)) for _ in range(1600)]
    passages = [" ".join(f"p{k}x{j}" for j in range(3)) for k in range(20)]
    for i in range(20 * 60):
        texts[i] += " " + passages[i % 20]
    levels = jaccard_join.rarity_levels(documents(spark, list(enumerate(texts))), "text", 3)
    data = [p.encode() for p in passages]
    own = np.concatenate(list(shingles.shingle_sets(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), 3)))
    below = [(levels < x).mean() for x in levels[(own & np.uint64(255)).astype(int)]]
    assert np.median(below) > 0.95 and min(below) > 0.6


def test_jaccard_keeps_no_prefixes_of_all_rows(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(jaccard_join, "cut", lambda df: kept.append(df.dtypes) or df)
    jaccard_join.jaccard_classes(documents(spark)).collect()
    assert kept and not [c for columns in kept[:3] for c, kind in columns if kind.startswith("array")]


def test_jaccard_of_repeated_rows_and_ids(spark):
    """Rows that share an id, or repeat, may only add candidates: links are those of all texts of the id."""
    first = [f"a{j}" for j in range(60)]
    near, other = [*first[:59], "z"], [f"b{j}" for j in range(60)]
    texts = [(5, first), (5, first), (5, other), (7, near), (7, near), (9, [*other[:59], "y"]), (3, other), (2, ["alone"] * 40)]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard_join.jaccard_classes(documents(spark, [(i, " ".join(w)) for i, w in texts])).collect()}
    assert {got[7, 58], got[9, 58], got[3, 58], got[5, 58]} == {3} and got[2, 1] == 2


# ---- quality --------------------------------------------------------------------------------------------------


def test_word_statistics_and_rules(docs, none):
    got = quality_mcd.quality_outliers(docs).collect()
    assert len(got) == len(TEXTS)
    plain = Counter()
    for i, t in TEXTS:
        w = words(t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        plain[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), failed] += 1
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == plain
    assert not any(r["kept"] for r in got if r["base_failed"])
    assert quality_mcd.quality_outliers(none).count() == 0


def test_outliers_against_numpy(spark):
    """The same concentration steps in numpy give the same distances; junk goes, the rest stays."""
    rng = random.Random(5)
    texts = [(i, " ".join("".join(rng.choices("abcdefghijk", k=rng.randint(2, 9))) for _ in range(rng.randint(60, 300)))) for i in range(120)]
    texts += [(200 + i, " ".join(rng.choice(["%%%###", "abc$$$", "||||&"]) + str(k) for k in range(100))) for i in range(12)]
    settings = quality_mcd.McdSettings()
    got = {r["doc_id"]: r for r in quality_mcd.quality_outliers(documents(spark, texts).withColumns({"source": F.lit("one"), "lang": F.lit("en")}), settings=settings).collect()}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    s = np.array([[got[i][n] for n in names] for i, _ in texts], float)
    x = np.column_stack([np.log1p(s[:, 0]), np.log1p(s[:, 1] / s[:, 0]), *[np.log1p(100 * s[:, k] / s[:, d]) for k, d in ((2, 1), (3, 0), (4, 0))]])
    x = np.floor(x * 1000 + 0.5) / 1000
    tens = np.floor(x * 100 + 0.5) * 10
    mid = np.median(tens, axis=0)
    mean, cov = mid / 1000, np.diag((np.median(np.abs(tens - mid), axis=0) * 1.4826 / 1000) ** 2)
    p, floor = len(names), np.diag(np.array(settings.floors) ** 2)
    factor = settings.share / quality_mcd.chi_square_cdf(quality_mcd.chi_square_quantile(settings.share, p), p + 2)
    shape = cov + floor
    for _ in range(settings.steps):
        d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(shape), x - mean)
        far = np.floor(np.log(d2 + 1e-6) * 200 + 0.5)
        near = x[far <= np.quantile(far, settings.share)]
        mean, shape = near.mean(axis=0), np.cov(near.T, ddof=0) * factor + floor
    want = np.sqrt(np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(shape), x - mean))
    assert np.allclose([got[i]["distance"] for i, _ in texts], want, rtol=1e-6)
    assert all(got[i]["kept"] == (i < 200) for i, _ in texts)


def test_small_groups_fall_back_on_all_of_their_language(spark):
    """Junk is judged in a source of its own, in one beside a large source only, and in a language of its own."""
    rng = random.Random(6)
    prose = lambda: " ".join("".join(rng.choices("abcdefghijk", k=rng.randint(2, 9))) for _ in range(rng.randint(60, 300)))
    junk = " ".join("%%%###" + str(k) for k in range(100))
    made = [(i, prose(), "en", "large") for i in range(100)] + [(200, junk, "en", "tiny"), (201, prose(), "en", "tiny"), (202, junk, "xx", "rare"), (203, prose(), "xx", "rare")]
    frame = spark.createDataFrame(made, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality_mcd.quality_outliers(frame).collect()}
    assert len(got) == 104 and all(r["distance"] is not None for r in got.values())
    assert all(r["kept"] == (i not in (200, 202)) for i, r in got.items())


@pytest.mark.parametrize(("variable", "per_cent"), [("symbols", 8), ("lines", 15), ("repeats", 25)])
def test_each_share_can_reject_alone(variable, per_cent):
    settings = quality_mcd.McdSettings()
    limit = quality_mcd.chi_square_quantile(settings.confidence, len(settings.floors)) ** 0.5
    assert np.log1p(per_cent) / settings.floors[quality_mcd.VARIABLES.index(variable)] > limit


def test_chi_square():
    assert abs(quality_mcd.chi_square_cdf(quality_mcd.chi_square_quantile(0.975, 5), 5) - 0.975) < 1e-9
    assert abs(quality_mcd.chi_square_quantile(0.95, 2) - 5.991464547) < 1e-6


# ---- URLs -----------------------------------------------------------------------------------------------------

RULES = [url_rules.Rule(v, h, p) for v, h, p in (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "a.b.net", "/"), ("allow", "b.net", "/"), ("block", "com", "/en/x"))]


def test_url_rules_against_loops(spark):
    rng = random.Random(6)
    urls = [None, "", "no scheme", "http://", "://", "https://EXAMPLE.com", "http://example.com?x", "http://notexample.com/en/", "a://b://c/d", "http://com/", "http://x.example.com/en/#y", "http://\x01.com/en/"]
    urls += [f"http://{'.'.join(rng.choices(['www', 'example', 'a', 'b', 'com', 'net', 'EN'], k=rng.randint(1, 4)))}{rng.choice(['', '/', '/en/', '/en/x?q', '/es/1', '?z/en/'])}" for _ in range(600)]
    urls += ["http://www.example.com/en/1"] * 50
    pages = spark.createDataFrame([(None if i == 3 else i, u, "h", "k") for i, u in enumerate(urls)], "page_id long, url string, html string, key string")
    got = Counter(tuple(r) for r in url_rules.judge_urls(pages, RULES, default="other").collect())
    want = Counter()
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [(len(r.host + r.path), -k, r.host + r.path, r.verdict) for k, r in enumerate(RULES) if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, default=(0, 0, None, "other"))
        want[None if i == 3 else i, host, path, best[2], best[3]] += 1
    assert got == want
    assert url_rules.judge_urls(pages.limit(0), RULES).count() == 0
    assert url_rules.judge_urls(pages, []).where("rule IS NOT NULL").count() == 0


def test_sweep_keeps_a_stack():
    ends = dict(url_rules.swept(RULES[:3]))
    inside = ends["com\x01example\x01www\x01"]
    assert [r.host for _, r in inside] == ["com", "example.com", "www.example.com"] and [r.host for _, r in ends["com\x01example\x02"]] == ["com"]


# ---- models ---------------------------------------------------------------------------------------------------


def made_texts(n, seed=8):
    rng = random.Random(seed)
    kinds = {"en": "the of and with tion ing he", "de": "der und schaft ung ei ich", "fr": "le que eau ment oui ré"}
    return [(i, " ".join("".join(rng.choices(kinds[lang].split(), k=rng.randint(1, 3))) for _ in range(30)), lang) for i, lang in enumerate(rng.choices([*kinds], k=n))]


def test_language_held_out_accuracy(spark, docs, none):
    made = made_texts(400)
    frame = spark.createDataFrame([(i, t, lang, "s", 1, *[None] * 7) for i, t, lang in made], SCHEMA)
    model = language_id.train_language(frame)
    got = {r["doc_id"]: r for r in language_id.predict_language(frame, model).collect()}
    held = [(i, lang) for i, _, lang in made if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i]["lang_pred"] == lang for i, lang in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    odd = language_id.predict_language(docs, model).collect()
    by_id = {r["doc_id"]: r["lang_pred"] for r in odd}
    assert len(odd) == len(TEXTS) and all(by_id[i] == "und" for i in (4, 5, 6, 12)) and by_id[7] != "und"
    assert language_id.predict_language(none, model).count() == 0
    kept = language_id.keep_languages(docs, model, least=0.0)
    assert kept.columns == docs.columns and kept.where("doc_id IN (4, 5, 6, 12)").count() == 0
    assert {r["lang_pred"] for r in language_id.predict_language(docs, language_id.train_language(none)).collect()} == {"und"}


def test_marginals_against_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    scores, starts, trans, start = rng.normal(size=23), np.array([0, 7, 8, 15]), rng.normal(size=(2, 2)), rng.normal(size=2)
    want = []
    for a, b in zip(starts, [*starts[1:], 23]):
        own, total = np.zeros(b - a), 0.0
        for y in itertools.product((0, 1), repeat=b - a):
            w = np.exp(start[y[0]] + scores[a:b] @ y + sum(trans[p, q] for p, q in zip(y, y[1:])))
            own, total = own + w * np.array(y), total + w
        want.append(own / total)
    assert np.allclose(toxic_crf.marginals(scores, starts, trans, start), np.concatenate(want))


def test_toxic_held_out_and_spans(spark, docs, none):
    rng, made, labels = random.Random(9), [], []
    for i in range(500):
        w = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(rng.randint(5, 80))]
        bad = rng.random() < 0.4
        for _ in range(3 * bad):
            w[rng.randrange(len(w))] = rng.choice(["Vilain!", "rascal", "knave."])
        made.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    frame, marks = documents(spark, made), spark.createDataFrame([*labels, (None, 1, 1), (3000, 0, None)], "doc_id long, quality int, toxic int")
    model = toxic_crf.train_toxic(frame, marks)
    got = {r["doc_id"]: r for r in toxic_crf.tag_toxic(frame, model).collect()}
    held = [(i, bad) for i, _, bad in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i]["predicted"] == bad for i, bad in held) >= 0.97 * len(held)
    texts = dict(made)
    spans = {re.sub(r"\W", "", texts[i][s["start"] : s["end"]].lower()) for i, r in got.items() for s in r["spans"] if " " not in texts[i][s["start"] : s["end"]]}
    assert {"rascal", "knave", "vilain"} <= spans
    odd = toxic_crf.tag_toxic(docs, model).collect()
    assert len(odd) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in odd) and not any(r["predicted"] for r in odd if r["doc_id"] in (4, 5, 6))
    assert toxic_crf.tag_toxic(none, model).count() == 0
    assert toxic_crf.tag_toxic(docs, toxic_crf.train_toxic(none, marks.limit(0))).where("predicted = 1").count() == 0


def test_toxic_marginals_equal_trying_all_labels():
    rng = np.random.default_rng(0)
    for lengths in ([1], [2, 1, 3], [4, 0, 2, 3]):
        scores, trans, start = rng.normal(size=sum(lengths)), rng.normal(size=(2, 2)), rng.normal(size=2)
        p, pairs, firsts = toxic_crf.marginals(scores, np.cumsum([0, *lengths])[:-1], trans, start, with_pairs=True)
        want, want_pairs, want_firsts, at = np.zeros(len(scores)), np.zeros((2, 2)), np.zeros(2), 0
        for n in filter(None, lengths):
            paths = {y: math.exp(start[y[0]] + sum(scores[at + i] * y[i] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1))) for y in itertools.product((0, 1), repeat=n)}
            for y, w in paths.items():
                w /= sum(paths.values())
                want[at : at + n] += w * np.array(y)
                want_firsts[y[0]] += w
                for i in range(n - 1):
                    want_pairs[y[i], y[i + 1]] += w
            at += n
        assert np.allclose(p, want) and np.allclose(pairs, want_pairs) and np.allclose(firsts, want_firsts)


FOREIGN = """
import sys
sys.path.insert(0, sys.argv[1])
from panelwright.session import session
from panelwright.llm import language_id, pii, toxic_crf
spark = session("local[2]", 2)
docs = spark.createDataFrame([(i, "the house is big and old, mail a.b@example.com" if i % 2 else "das haus ist sehr gross und alt", "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
assert pii.find_pii(docs, model=pii.PiiModel(pii.PiiSettings())).where("n_email = 1").count() == 20
assert language_id.predict_language(docs, language_id.train_language(docs)).where("lang_pred = 'de'").count() == 20
assert toxic_crf.tag_toxic(docs, toxic_crf.fit_toxic(["you knave"] * 9 + ["good day"] * 9, [1] * 9 + [0] * 9)).where("score BETWEEN 0 AND 1").count() == 40
"""


def test_executors_need_no_package(tmp_path):
    """Workers that cannot import the package, as on a cluster where only the driver holds it."""
    own = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    (tmp_path / "foreign.py").write_text(FOREIGN)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "foreign.py", root], cwd=tmp_path, env=own, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]


def base_plain(text):
    out = []
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text):
            digits = re.sub(r"\D", "", m[0])
            if k == 1 and max(map(int, m[0].split("."))) > 255 or k == 2 and not (16 <= len(digits) <= 19 and pii.luhn(digits)) or k == 3 and not 8 <= len(digits) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return out


def test_pii_patterns():
    rng = random.Random(10)
    texts = ["".join(rng.choices("0123456789.@+-() ab,\n5", k=rng.choice([5, 30, 80]))) for _ in range(6000)]
    assert all(pii.base_spans(t) == base_plain(t) for t in texts)
    assert pii.base_spans("a" * 200_000 + " " + "1" * 200_000 + "." * 50_000) == []


def test_pii_gradient():
    model = pii.PiiModel(pii.PiiSettings(window=8, hidden=3, embed=2))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(0)
    ids, gold = rng.integers(0, 127, (8, 2)), np.array([[0, 1, 2, 2, 0, 3, 4, 0], [0, 0, 5, 6, 6, 0, 7, 8]]).T
    _, grad = model.step(ids, gold)
    for k, at in (("E", (ids[2, 0], 1)), ("O", (1, 2)), ("T", (0, 1)), ("Wf", (4, 1)), ("Wb", (5, 2)), ("Wf", (3, -1)), ("Wb", (9, 4))):
        held = model.p[k][at]
        model.p[k][at] = held + 1e-3
        up, _ = model.step(ids, gold)
        model.p[k][at] = held - 1e-3
        down, _ = model.step(ids, gold)
        model.p[k][at] = held
        assert abs((up - down) / 2e-3 - grad[k][at]) < 1e-5
    assert np.abs(model.emissions(ids)[0] - model.fast(ids, model.prepare())).max() < 1e-5


def test_pii_decoding_equals_trying_all_tags():
    model, rng = pii.PiiModel(pii.PiiSettings(hidden=3, embed=2)), np.random.default_rng(4)
    model.p["T"] = rng.normal(0, 1, model.p["T"].shape)
    e = rng.normal(0, 2, (4, pii.TAGS, 20))
    e[:, 0] += 3
    trans, best = model._potentials(), []
    for b in range(e.shape[2]):
        paths = [y for y in itertools.product(range(pii.TAGS), repeat=4) if model.allowed[0][y[0]]]
        best.append(max(paths, key=lambda y: sum(e[j, y[j], b] for j in range(4)) + sum(trans[y[j], y[j + 1]] for j in range(3))))
    assert model.viterbi(e).T.tolist() == [list(y) for y in best]
    assert set(model.above_none(e).tolist()) == {b for b, y in enumerate(best) if any(y)} and 0 < sum(map(any, best)) < len(best)


@pytest.mark.parametrize("seed", range(12))
def test_pii_bound_by_spans_drops_no_sequence_and_most_without_begins(seed):
    model, rng = pii.PiiModel(pii.PiiSettings(hidden=3, embed=2)), np.random.default_rng(seed)
    model.p["T"] = rng.normal(0, 1, model.p["T"].shape)
    e = rng.normal(0, 2, (4, pii.TAGS, 20))
    e[:, 0] += 1 + seed % 6
    e[:, :, :5], e[:, 2::2, :5] = np.where(np.arange(pii.TAGS)[:, None] == 0, 0, -30), 3  # insides that no span begins
    trans, want = model._potentials(), set()
    total = lambda y, b: sum(e[j, y[j], b] for j in range(4)) + sum(trans[y[j], y[j + 1]] for j in range(3))
    for b in range(e.shape[2]):
        if max(total(y, b) for y in itertools.product(range(pii.TAGS), repeat=4) if model.allowed[0][y[0]]) > total((0,) * 4, b) + 1e-3:
            want.add(b)
    assert want <= set(model.may_hold(e.astype(np.float32)).tolist()) and not set(range(5)) & set(model.may_hold(e.astype(np.float32)).tolist())
    assert want == set(model.above_none(e.astype(np.float32)).tolist())


def test_pii_windows_cover_and_reconcile():
    settings = pii.PiiSettings(window=16, margin=4)
    text, start = pii.windows(np.array([0, 1, 16, 17, 100]), settings)
    for i, n in enumerate((0, 1, 16, 17, 100)):
        own = start[text == i].tolist()
        assert set(range(n)) == {p for a in own for p in range(a, min(a + 16, n))} and all(b - a == 8 for a, b in zip(own, own[1:]))
    content = "call 030 1234567 or 030 7654321 now"
    found = [(0.99, 1, (3, 5, 12)), (0.95, 8, (3, 5, 16)), (0.5, 9, (3, 20, 31)), (0.99, 0, (3, 20, 31))]
    assert pii.reconcile(content, [], found, 0.9) == [(3, 5, 16)]
    assert pii.reconcile(content, [(3, 4, 6)], found, 0.9) == [(3, 4, 6)]
    assert pii.reconcile(content, [], [(0.95, 8, (3, 19, 31)), (0.95, 8, (3, 31, 35))], 0.9) == [(3, 20, 31)]


def spans_of(model, text, base):
    points = pii.characters(text)
    found = pii.method_spans(points, np.array([0, len(points)]), model, model.prepare())
    return pii.reconcile(text, base, [tuple(x) for _, *x in found], model.settings.least)


def test_pii_network_and_masks(docs, none):
    """Recall on held-out lines with the network and without, by overlap; then the operators."""
    model = pii.train_pii()
    met = lambda s, others: any(s[1] < o[2] and o[1] < s[2] for o in others)
    real = by_patterns = by_all = wrong = 0
    for text, spans in pii.labelled_lines(200, seed=99):
        base = pii.base_spans(text)
        both = spans_of(model, text, base)
        real, by_patterns, by_all = real + len(spans), by_patterns + sum(met(s, base) for s in spans), by_all + sum(met(s, both) for s in spans)
        wrong += sum(not met(s, spans) for s in both if s not in base)
    assert by_patterns < 0.45 * real and by_all > 0.8 * real and wrong <= 0.01 * real
    far = LONG + " card no. 4111 2222 3333 4444 and (030) 123-4567 today, " + LONG  # in no first window: whole texts are read
    assert {far[a:b] for _, a, b in spans_of(model, far, [])} == {"4111 2222 3333 4444", "(030) 123-4567"}
    got = {r["doc_id"]: r for r in pii.find_pii(docs, model=model).collect()}
    texts = dict(TEXTS)
    assert {i: r["base_sha256"] for i, r in got.items()} == {i: hashlib.sha256(pii.spell(base_plain(texts[i] or "")).encode()).hexdigest() for i in got}
    assert (got[11]["n_email"], got[11]["n_ip"], got[11]["n_card"], got[11]["n_phone"]) == (1, 1, 1, 1)
    assert set(got[11]["spans"].split(",")) >= set(pii.spell(base_plain(texts[11])).split(","))
    assert all(not got[i]["spans"] for i in (1, 4, 5, 6, 9, 13))
    masked = {r["doc_id"]: r for r in pii.mask_pii(docs, model=model).collect()}
    assert masked[11]["text"] == "mail me at <EMAIL> or <PHONE> from <IP> with <CARD>" and masked[11]["n_chars"] == len(masked[11]["text"])
    assert masked[4]["text"] is None and masked[9]["text"] == LONG and pii.mask_pii(docs, model=model).columns == docs.columns
    assert pii.find_pii(none, model=model).count() == 0


# ---- mixing ---------------------------------------------------------------------------------------------------


def raking_case(spark, n, seed):
    rng = np.random.default_rng(seed)
    tokens = rng.integers(1, 1000, n).astype(float)
    places = [np.arange(n) // (n // 3), np.arange(n) % 4, np.arange(n) // 4 % 5]
    cells = spark.createDataFrame([(str(a), str(b), str(c), int(t)) for a, b, c, t in zip(*places, tokens)], "source string, lang string, topic string, tokens long")
    return tokens, places, cells


def test_raking_meets_marginals_under_the_cap(spark):
    """The expected tokens by value, cells kept whole included, are as asked; the table path gives the same weights."""
    tokens, places, cells = raking_case(spark, 60, 1)
    targets = {"source": {"0": 0.25, "1": 0.45, "2": 0.3}, "lang": {str(i): x for i, x in enumerate((0.15, 0.2, 0.3, 0.35))}}
    raked = {}
    for most in (100, 0):
        rows = mixing.raked_cells(cells, targets, 0.7, 0.55, 400, 1e-9, most).collect()
        raked[most] = {(r["source"], r["lang"], r["topic"]): r["weight"] for r in rows}
        kept = np.array([min(1.0, raked[most][str(a), str(b), str(c)]) for a, b, c in zip(*places)]) * tokens
        for place, d in zip(places, ("source", "lang")):
            want = np.array([targets[d][str(i)] for i in range(len(targets[d]))])
            assert np.allclose(np.bincount(place, kept) / kept.sum(), want, atol=1e-7)
        assert max(raked[most].values()) > 1 and kept.sum() > 0.4 * tokens.sum()
    assert np.allclose([raked[0][k] for k in raked[100]], list(raked[100].values()), rtol=1e-6)


def test_raking_without_a_cap_is_proportional_fitting(spark):
    tokens, places, _ = raking_case(spark, 60, 2)
    wanted = [0.1 * tokens.sum() * np.array(t) for t in ((0.2, 0.5, 0.3), (0.1, 0.2, 0.3, 0.4), (0.2,) * 5)]
    got, gap = mixing.rake(tokens, places, wanted, np.full(60, 0.1), 400, 1e-10)
    plain = np.full(60, 0.1)
    for _ in range(400):
        for place, want in zip(places, wanted):
            plain = plain * (want / np.bincount(place, plain * tokens))[place]
    assert gap < 1e-10 and plain.max() < 1 and np.allclose(got, plain, rtol=1e-8)


def test_targets_that_cannot_be_met(spark):
    """A tempered target stays within what there is; given ones lower the budget; what conflicts is told."""
    totals = np.array([1000.0, 10.0, 0.0, 1.0])
    share = mixing.reachable(totals, 0.5, 800.0)
    assert abs(share.sum() - 1) < 1e-12 and (share * 800 <= 0.98 * totals + 1e-9).all()
    table = spark.createDataFrame([(str(i), int(t)) for i, t in enumerate(totals)], "value string, tokens long")
    found = {r["value"]: r["target"] for r in mixing.reachable_table(table, 0.5, 800.0).collect()}
    assert np.allclose([found.get(str(i), 0.0) for i in range(4)], share)
    cells = spark.createDataFrame([("a", "x", "t", 900), ("b", "x", "t", 100)], "source string, lang string, topic string, tokens long")
    for most in (10, 0):
        got = {r["source"]: r["weight"] for r in mixing.raked_cells(cells, {"source": {"a": 0.5, "b": 0.5}}, 1.0, 0.9, 100, 1e-9, most).collect()}
        assert abs(got["b"] - 1) < 1e-6 and abs(got["a"] - 1 / 9) < 1e-6
    apart = spark.createDataFrame([("a", "x", "t", 500), ("b", "y", "t", 500)], "source string, lang string, topic string, tokens long")
    with pytest.warns(UserWarning, match="off by"):
        mixing.raked_cells(apart, {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}}, 1.0, 0.5, 20, 1e-9)


def test_mixing_on_awkward_documents(docs, none):
    got = mixing.mix_sources(docs, mixing.form_topic(F.col("text"))).collect()
    texts = {i: t for i, t in TEXTS}
    assert len(got) == len(TEXTS) and all(0 <= r["mix_probability"] <= 1 for r in got) and {r["mix_source"] for r in got if r["doc_id"] == 7} == {"(null)"}
    assert all(r["mix_tokens"] == len(words(texts[r["doc_id"]])) for r in got)
    assert len({(r["mix_probability"], r["mix_kept"]) for r in got if r["doc_id"] == 13}) == 1
    named = docs.withColumn("mix_tokens", F.concat(F.lit("own "), F.coalesce("doc_id", F.lit(0))))
    kept = mixing.keep_mixed(named, mixing.form_topic(F.col("text")), budget=0.9)
    assert kept.columns == named.columns and kept.where("mix_tokens NOT LIKE 'own %'").count() == 0 and 0 < kept.count() <= len(TEXTS)
    for f in (mixing.mix_sources, mixing.keep_mixed):
        assert f(none, mixing.form_topic(F.col("text"))).count() == 0


def test_sampling_follows_the_probabilities(spark):
    frame = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit(PROSE).alias("text"), F.when(F.col("id") % 3 == 0, "rare").otherwise("hot").alias("source"), F.lit("en").alias("lang"))
    targets = {"source": {"rare": 0.5, "hot": 0.5}}
    for most in (100, 0):
        got = mixing.mix_sources(frame, F.lit("t"), targets=targets, budget=0.4, rounds=2, driver_cells=most).where("mix_kept").groupBy("mix_source").count().collect()
        n = {r["mix_source"]: r["count"] for r in got}
        assert abs(n["rare"] - 1200) < 110 and abs(n["hot"] - 1200) < 110


# ---- blocks ---------------------------------------------------------------------------------------------------


def test_blocks_of_short_texts_stay_small():
    """3,000 sets of nine shingles in one meeting: memory follows the sets that meet, and links equal a plain count."""
    import tracemalloc

    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2000, 9).astype(np.uint64)) for _ in range(1500)]
    sets += [np.unique(np.append(s[:-1], rng.integers(0, 2000)).astype(np.uint64)) if k % 3 else s for k, s in enumerate(sets)]
    first = np.arange(3000) < 1500
    tracemalloc.start()
    a, b = jaccard_join._forest(np.arange(3000), sets, first, Fraction(8, 10))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 250 << 20
    parts = cover_tree._roots(3000, np.append(a, 0), np.append(b, 0))
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s.tolist():
            holders[g].append(i)
    shared = Counter((i, j) for h in holders.values() for i in h for j in h if first[i] and not first[j])
    links = [p for p, c in shared.items() if 10 * c >= 8 * (len(sets[p[0]]) + len(sets[p[1]]) - c)]
    assert parts.tolist() == cover_tree._roots(3000, np.array([0, *[i for i, _ in links]]), np.array([0, *[j for _, j in links]])).tolist()


def test_size_steps_keep_all_links(spark):
    for t in (Fraction(9, 10), Fraction(8, 10)):
        rows = spark.range(1, 4000).select(F.col("id").alias("n"), jaccard_join.size_step(F.col("id"), t).alias("s")).collect()
        step = {r["n"]: r["s"] for r in rows}
        assert all(step[math.floor(n / t)] - step[n] <= 1 for n in step if math.floor(n / t) in step)


# ---- vectors --------------------------------------------------------------------------------------------------


def test_cover_tree_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "CELL", 40)
    monkeypatch.setattr(cover_tree, "CHUNK", 100)
    rng = np.random.default_rng(2)
    vectors, labels = [], []
    for g in range(25):
        base = rng.normal(size=12)
        for _ in range(rng.integers(1, 14)):
            vectors.append((base + rng.choice([0.0, 0.03, 0.08]) * rng.normal(size=12)).astype(np.float32).tolist())
            labels.append(int(g % 3))
    hot = vectors[0]
    vectors += [hot] * 30
    labels += [labels[0]] * 30
    odd = [(None, 0), ([0.0] * 12, 0), ([float("nan")] + [1.0] * 11, 0), ([float("inf")] + [1.0] * 11, 0), ([None] + [1.0] * 11, 0), (vectors[3], None), ([1.0, 2.0], 0), ([], 0), ([1.0, 2.0], 0)]
    data = [(i, v, k, "x") for i, (v, k) in enumerate([*zip(vectors, labels), *odd])] + [(None, vectors[1], labels[1], "x")]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, rep string")
    got = {r["vec_id"]: r for r in cover_tree.near_vectors(frame).collect()}
    assert len(got) == len(data)

    def sound(v, k):
        return v is not None and k is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    points = [(i, np.array(v, np.float64), k) for i, v, k, _ in data if i is not None and sound(v, k)]
    links = [(i, j) for i, u, k in points for j, v, m in points if i < j and k == m and len(u) == len(v) and u @ v / (np.sqrt(u @ u) * np.sqrt(v @ v)) >= 0.98]
    want, degree = components([r[0] for r in data if r[0] is not None], links), Counter(x for p in links for x in p)
    for i, r in got.items():
        if i is None:
            assert r["component_id"] is None and not r["kept"]
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (degree[i], want[i], i == want[i])
    assert cover_tree.near_vectors(frame.limit(0)).count() == 0


def test_tree_levels_nest_and_halve():
    x = np.random.default_rng(3).normal(size=(300, 5))
    x /= np.linalg.norm(x, axis=1)[:, None]

    def check(node):
        assert cover_tree.distances(x[node.points], x[node.centre : node.centre + 1]).max() <= node.radius + 1e-6
        if node.children:
            assert sorted(p for c in node.children for p in c.points) == sorted(node.points) and node.children[0].centre == node.centre
            for c in node.children:
                assert c.radius <= node.radius
                check(c)

    check(cover_tree.build(x))
