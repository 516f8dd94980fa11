"""Operators on small frames: brute force, edge cases, round trips."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from notelake.llm import components, decontaminate, embed_dedup, html_extract, minhash, mixing, pii, quality, token_output, toxicity, url_filter
from notelake.llm.workspace import fresh_path

DOCS = "doc_id long, text string, lang string, source string, component_id string, score string"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def docs_of(spark, texts, source=lambda k: f"s{k % 3}"):
    return spark.createDataFrame([(k, t, "en", source(k), "x", "y") for k, t in enumerate(texts)], DOCS).repartition(3)


def union_find(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(210, 240)] + [(300, 300)]
    want = union_find(301, links)
    got = {x["node"]: x["component"] for x in components.connected_components(spark.createDataFrame([*links, (None, 1)], "a long, b long")).collect()}
    assert got == {n: want[n] for link in links for n in link}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("shingle", [2, 5])
def test_minhash_against_brute_force(spark, shingle):
    r = random.Random(7)
    words = [f"v{k}" for k in range(500)]
    base = [r.choice(words) for _ in range(120)]
    texts = [None, "", "  ", "One", "one", "one two", "ONE  two"]
    for _ in range(60):  # a dense group around the threshold
        t = list(base)
        for at in r.sample(range(120), r.randint(0, 9)):
            t[at] = r.choice(words)
        texts.append(" ".join(t))
    texts += [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(60)] + [" ".join(base)] * 5
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(set(zip(*[w[k:] for k in range(shingle)])) if len(w) >= shingle else ({tuple(w)} if w else set()))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = union_find(len(sets), links)
    docs = docs_of(spark, texts)
    params = minhash.MinHashParams(shingle=shingle, small_bucket=4, outlier_chunk=3, member_chunk=8)
    got = {x["doc_id"]: x for x in minhash.near_duplicates(docs, params).collect()}
    assert [got[k]["component_id"] for k in range(len(texts))] == want
    assert all(got[k]["n_shingles"] == len(sets[k]) and got[k]["kept"] == (want[k] == k) for k in got)
    if shingle == 5:
        assert minhash.near_duplicates(docs.limit(0), params).count() == 0
        odd = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "d e f"), (4, "D e f")], "doc_id long, text string")
        rows = sorted((x["doc_id"] or -1, x["component_id"], x["kept"]) for x in minhash.near_duplicates(odd, params).collect())
        assert rows == [(-1, None, True), (3, 3, True), (3, 3, True), (4, 3, False)]


def test_embeddings_against_brute_force(spark):
    r = np.random.default_rng(5)
    x = r.standard_normal((240, 16))
    x[100:160] = x[0] + 0.05 * r.standard_normal((60, 16))
    x[160:165] = x[1]
    label = [int(k) % 2 for k in range(240)]
    rows = [(k, x[k].astype(float).tolist(), label[k], "extra") for k in range(240)]
    rows += [(240, None, 0, ""), (241, [0.0] * 16, 0, ""), (242, [float("nan")] * 16, 0, ""), (243, [math.inf] + [0.0] * 15, 0, ""), (244, x[0].tolist(), None, ""), (245, [None] * 16, 0, ""), (246, [], 0, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links string")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    links = [(i, j) for i in range(240) for j in range(i) if label[i] == label[j] and unit[i] @ unit[j] >= 0.98]
    degree, want = Counter(k for link in links for k in link), union_find(247, links)
    got = {g["vec_id"]: g for g in embed_dedup.near_duplicates(df, embed_dedup.MultiIndexParams(block=16, rows_per_cell=30)).collect()}
    assert {k: g["n_links"] for k, g in got.items()} == {k: degree[k] for k in range(247)}
    assert [got[k]["component_id"] for k in range(247)] == want
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def reference_ratio(counts, order, gram):
    """The smoothed log ratio of one run, straight from the definition."""
    letters = {g[-1] for g in counts}
    out = []
    for side in (0, 1):
        p = 1 / len(letters)
        for k in range(order + 1):
            ctx = gram[order - k : order]
            seen = defaultdict(int)
            for g, n in counts.items():
                if g[order - k : order] == ctx:
                    seen[g[-1]] += n[side]
            n, t = sum(seen.values()), sum(v > 0 for v in seen.values())
            p = (seen[gram[-1]] + t * p) / (n + t) if n else p
        out.append(p)
    return math.log(out[0] / out[1])


def test_url_model_against_brute_force(spark):
    order = 3
    counts = defaultdict(lambda: [0, 0])
    for url, side in (("abcab", 0), ("abd", 0), ("bcb", 1), ("ccab", 1), ("zz", None)):
        text = "\u0002" * order + url
        for k in range(len(url)):
            counts[text[k : k + order + 1]]
            if side is not None:
                counts[text[k : k + order + 1]][side] += 1
    df = spark.createDataFrame([(g, *n) for g, n in counts.items()], "gram string, good long, bad long")
    for row in url_filter.log_ratios(df, order).collect():
        assert row["ratio"] == pytest.approx(reference_ratio(counts, order, row["gram"]), abs=1e-9)


def test_url_verdicts(spark):
    urls = ["http://a.com/en/1", "http://example.com/en/7x", "https://x.NET/de/1?q", "http://m.example.net/de/81", "http://b.org/es/", "http://b.org/fr/", None, "nothing", "http://net", "ftp://é.com/en/#f", "http://notcom/en/1", "http://b.org/" + "x/" * 4000]
    rows = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [rows[k]["rule"] for k in range(len(urls))] == ["com/en/", "example.com/en/7", "net/de/", "example.net/de/8", "org/es/", None, None, None, None, "com/en/", None, None]
    assert (rows[2]["host"], rows[2]["path"]) == ("x.net", "/de/1") and (rows[6]["host"], rows[6]["path"]) == ("", "") and rows[6]["verdict"] == "allow"
    assert rows[0]["verdict"] == "block" and rows[1]["verdict"] == "allow" and {r["verdict"] for r in rows.values()} <= {"allow", "block"}
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_html_edge_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (None, None, "", "x"), (2, "v", "<article><p>" + "word " * 20000 + "</p></article>", "x"), (2, "v", "<", "x")], "page_id long, url string, html string, text string")
    rows = html_extract.extract(df).collect()
    assert sorted(r["n_chars"] for r in rows) == [0, 0, 0, 99999] or sorted(r["n_chars"] for r in rows)[:2] == [0, 0]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_toxicity_learns_and_tells_quotation(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghijklm") for _ in range(6)) for _ in range(600)]
    plain = [" ".join(["stone", *(r.choice(words) for _ in range(30))]) for _ in range(200)]
    bad = [p.replace("stone", r.choice(["zorbak", "zorbaks", "zorbaki", "zorbakel", "zorbako"]), 1) for p in plain[:100]]
    docs = docs_of(spark, bad + plain[100:] + [None, "", "you are a worthles idiot", 'he said "idiot" was the term quoted there', "word " * 30000])
    labels = spark.createDataFrame([(k, int(k < 100)) for k in range(200)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert any(e.text.startswith("zorb") for e in model.entries)
    scores = {x["doc_id"]: x["__score"] for x in toxicity.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[200] == scores[201] < 0.5
    right = sum((scores[k] >= 0.5) == (k < 100) for k in range(200))
    assert right >= 195 and scores[202] >= 0.5 > scores[203]
    empty = toxicity.fit(docs.limit(0), labels.limit(0))
    assert toxicity.score(docs.limit(0), empty).count() == 0


def test_toxicity_counts_every_text_but_copies(spark):
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghijklm") for _ in range(6)) for _ in range(30)]
    texts = [" ".join(r.sample(words, 12)) for _ in range(120)]
    copies = [t.upper() + " !" for t in texts[:40]]
    labels = spark.createDataFrame([(k, 1) for k in range(160)], "doc_id long, toxic int")
    rows = toxicity._sample(docs_of(spark, [*texts, *copies]), labels, toxicity.ToxicityParams(), "doc_id", "text", "toxic", "doc_id").collect()
    alike = {x["i"]: x["alike"] for x in rows}
    assert len(alike) == 160 and len(set(alike.values())) == len({frozenset(t.split()) for t in texts})
    assert all(alike[k] == alike[120 + k] for k in range(40))


def test_toxicity_has_no_longest_word_and_no_most_terms(spark):
    scanner = toxicity.Scanner(toxicity._terms(spark.createDataFrame([], "i long, text string, toxic int, alike binary"), toxicity.ToxicityParams()), 6)
    for token in ("idiot" + "!" * 60, "!" * 100 + "idiot", "-".join(["you", "are", "an", "idiot"] * 9), "who_is_this/moron/" * 9, "you-idiot"):
        assert scanner.features(token)[1] > 0, token
    assert scanner.features("a" + "!" * 300_000 + "b")[1] == 0
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghijklm") for _ in range(6)) for _ in range(80)]
    texts = [" ".join([*r.sample(words, 40), *(["zorbak"] if k < 30 and k % 3 else [])]) for k in range(90)]
    rows = [(k, t, int(k < 30), bytes([k])) for k, t in enumerate(texts)]
    sample = spark.createDataFrame(rows, "i long, text string, toxic int, alike binary")
    of = lambda most: set(toxicity._terms(sample, toxicity.ToxicityParams(most_terms=most)))
    assert of(60) == of(50_000) and any(e.text.startswith("zor") for e in of(60))


def test_quality(spark):
    good = ["The river ran past the old mill and nobody came to see it that day or the next." + str(k) for k in range(60)]
    junk = ["### buy $$$ now %%% ### " * 6 + str(k) for k in range(60)]
    docs = docs_of(spark, good + junk + [None, ""], lambda k: None if k == 0 else f"s{k % 4}")
    labels = spark.createDataFrame([(k, int(k < 60)) for k in range(0, 120, 2)], "doc_id long, quality int")
    rows = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    assert len(rows) == 122 and sum(rows[k]["keep"] == (k < 60) for k in range(120)) >= 116
    assert quality.judge(docs.limit(0), labels).count() == 0


def test_quality_shrinks_sparse_sites(spark):
    rows = [("big", "p", 0.9)] * 200 + [("low", "p", 0.2)] * 200 + [("tiny", "p", 0.2)]
    out = {r["host"]: r for r in quality.posteriors(spark.createDataFrame(rows, "host string, path string, p double"), quality.QualityParams()).collect()}
    assert abs(out["big"]["path_mean"] - 0.9) < 0.05 and abs(out["low"]["path_mean"] - 0.2) < 0.05
    assert out["tiny"]["path_mean"] > out["low"]["path_mean"] + 0.05


def test_pii_rows(spark):
    docs = docs_of(spark, ["mail a.1@x.example.com now", "again a.1@x.example.com", None, ""])
    rows = {r["doc_id"]: r for r in pii.pseudonymize(docs).collect()}
    assert rows[0]["n_values"] == 1 and rows[2]["text"] is None and rows[3]["text"] == ""
    assert rows[0]["text"].split()[1] == rows[1]["text"].split()[1] != "a.1@x.example.com"
    assert rows[0]["text"][rows[0]["starts"][0] : rows[0]["ends"][0]] == rows[0]["text"].split()[1]


def test_token_store_round_trip(spark):
    texts = ["b c d", None, "", "Ünï <|endoftext|> x", "word " * 9000, "b c d"]
    docs = docs_of(spark, texts)
    path = fresh_path(spark, "test-store")
    token_output.write_store(docs, path, TOKENIZER, 1, block_tokens=500, lanes=16, segment=256)
    rows = sorted(token_output.read_store(spark, path, with_ids=True).collect(), key=lambda r: r["doc_id"])
    whole, start = Tokenizer.from_file(TOKENIZER), 0
    for k, t in enumerate(texts):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        data = np.array(ids, "<u4").tobytes()
        assert (rows[k]["start"], rows[k]["n_tokens"], rows[k]["ids_crc32"], bytes(rows[k]["ids"])) == (start, len(ids), zlib.crc32(data), data)
        start += len(ids)
    empty = fresh_path(spark, "test-store")
    token_output.write_store(docs.limit(0), empty, TOKENIZER, 1)
    assert token_output.read_store(spark, empty).count() == 0


def test_mixing_meets_its_targets(spark):
    r = random.Random(8)
    docs = docs_of(spark, ["w " * r.randint(5, 30) for _ in range(900)] + [None], lambda k: "big" if k < 700 else "small" if k < 890 else None)
    params = mixing.MixingParams(repetition_limit=2.0, block_rows=50)
    rows = mixing.with_copies(docs, params).select("source", "__tokens", "__copies").collect()
    own, mixed = Counter(), Counter()
    for s, n, c in rows:
        assert c >= 1
        own[s] += n
        mixed[s] += n * c
    e = {s: mixed[s] / own[s] for s in own}
    assert e["big"] == 1 and e[None] == pytest.approx(2.0, rel=0.1) and 1 < e["small"] < 2
    table = mixing.shares(docs)
    alpha = mixing.solve_exponent(table, mixing.MixingParams(repetition_limit=None, target_entropy=0.9))
    total = sum(own.values())
    w = [(n / total) ** alpha for n in own.values()]
    entropy = -sum(x / sum(w) * math.log(x / sum(w)) for x in w)
    assert entropy == pytest.approx(0.9, abs=1e-6)
    assert mixing.mix(docs, params).count() == sum(c for _, _, c in rows)
    assert mixing.mix(docs.limit(0), params).count() == 0


def test_decontamination_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi"
    bench = spark.createDataFrame([(7, item), (8, None), (9, "too short"), (None, item)], "item_id long, text string")
    copied = item.upper().replace("ZETA", "changed")
    docs = docs_of(spark, [f"before {copied} after", "clean text " * 50, None, "", item[:40]])
    rows = decontaminate.contaminated(docs, bench).collect()
    assert [(r["doc_id"], r["item_id"], r["doc_word"], r["n_words"], r["n_equal"]) for r in rows] == [(0, 7, 1, 16, 15)]
    assert decontaminate.drop_contaminated(docs, bench).count() == 4
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_pipeline_on_small_tables(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(6)
    words = [f"t{k}" for k in range(400)]
    texts = [" ".join(r.choice(words) for _ in range(40)) for _ in range(60)]
    item = " ".join(r.choice(words) for _ in range(20))
    texts += [texts[0], texts[1] + " end", "you idiot moron scum " + texts[2], texts[3] + " " + item]
    docs = docs_of(spark, texts).withColumn("n_chars", F.length("text").cast("long")).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(0, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in rows} == set(range(60))
    whole = Tokenizer.from_file(TOKENIZER)
    at = 0
    for x in sorted(rows, key=lambda x: x["start"]):
        assert x["start"] == at and x["n_tokens"] == len(whole.encode(texts[x["doc_id"]], add_special_tokens=False).ids) + 1
        at += x["n_tokens"]
