import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from trailcast.llm import bpe, common, components, cross_polytope, gated_lm, html_text, language_id, mixing, order_minhash
from trailcast.llm import pstable, substring_dedup, tokenizer_files, url_filter
from trailcast.llm.queries import URL_RULES


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_words_of_arrow_texts():
    texts = [None, "", " a b", "b\x0bc ", "ñ é", "x" * 700_000, "last"]
    data, offsets = common.buffers(pa.array(texts))
    starts, ends, bounds = common.word_bounds(data, offsets)
    got = [[bytes(data[a:b]).decode() for a, b in zip(starts[x:y], ends[x:y])] for x, y in zip(bounds[:-1], bounds[1:])]
    assert got == [words_of(t) for t in texts]
    hashes = common.word_hashes(data, starts, ends)
    assert hashes[1] == hashes[2] and len(set(hashes.tolist())) == len(hashes) - 1


# ---- URL filters ----


def test_hosts_paths_and_rules(spark):
    urls = ["http://WWW.Example.NET/en/x?y#z", "https://example.com/de/", "http://a.net", "ftp://xnet/", None, "no scheme",
            "http://org/fr/", "http://b.org/fr", "x://h?q=://other/p", "http://example.net/de/1"]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, URL_RULES, None).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(len(urls))] == [
        ("www.example.net", "/en/x", "example.net/en/", "allow"), ("example.com", "/de/", "example.com/de/", "block"),
        ("a.net", "", None, "allow"), ("xnet", "/", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("org", "/fr/", "org/fr/", "allow"), ("b.org", "/fr", None, "allow"), ("h", "", None, "allow"),
        ("example.net", "/de/1", "net/", "block")]


def test_url_model_tells_unseen_hosts(spark):
    model = url_filter.fit(url_filter.labelled_urls(spark))
    urls = ["http://m.free-casino.example.org/en/3", "https://www.cheap-pills.example.com/x", "http://thread.example.com/en/5"]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r["verdict"] for r in url_filter.judge(pages, [], model).collect()] == ["block", "block", "allow"]
    assert url_filter.fit(url_filter.labelled_urls(spark).where("label = 1")) is None


# ---- language ----


def test_language_edges_and_accuracy(spark, edge_docs, sf_dir):
    said = {r["doc_id"]: r for r in language_id.held_out_predictions(edge_docs).collect()}
    assert [said[i]["lang_pred"] for i in range(4)] == ["und"] * 4 and said[4]["lang_pred"] == "en"
    assert language_id.held_out_predictions(edge_docs.where("false")).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    joined = language_id.held_out_predictions(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert joined.where("lang = lang_pred").count() >= 0.97 * joined.count()


# ---- mixing ----


def test_exponent_meets_targets(spark):
    tokens = [1000, 300, 100, 50]
    sources = spark.createDataFrame([(t, sum(tokens)) for t in tokens], "tokens long, total long")
    for target in (1.0, 1.3):
        a = mixing.exponent(sources, mixing.Target(entropy=target), sum(tokens))
        p = np.array([t**a for t in tokens])
        p /= p.sum()
        assert -(p * np.log(p)).sum() == pytest.approx(target, abs=1e-6)
    a = mixing.exponent(sources, mixing.Target(max_repeats=1.5), sum(tokens))
    p = np.array([t**a for t in tokens])
    assert max(p / p.sum() * sum(tokens) / tokens) == pytest.approx(1.5, abs=1e-5)


def test_mixture_against_plain_python(spark, edge_docs):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 20))), None if i % 11 == 0 else f"s{min(3, i % 7)}", i)
            for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, block long")
    got = mixing.mix(docs, mixing.Target(max_repeats=1.6)).collect()
    sizes, n = Counter(), {}
    for i, t, s, _ in rows:
        n[i] = len(t.split())
        sizes[s] += n[i]
    spent = Counter()
    for r in got:
        spent[r["source"]] += r["n_tokens"]
        assert r["n_tokens"] == n[r["doc_id"]]
    powers = {s: 0.0 for s in sizes}
    low, high = 0.0, 1.0
    for _ in range(60):
        a = (low + high) / 2
        powers = {s: (x / sum(sizes.values()))**a for s, x in sizes.items()}
        z = sum(powers.values())
        low, high = (low, a) if max(powers[s] / z * sum(sizes.values()) / sizes[s] for s in sizes) <= 1.6 else (a, high)
    for s in sizes:
        quota = powers[s] / z * sum(sizes.values())
        assert quota - 25 <= spent[s] <= quota + 1
        blocks = Counter(r["block"] for r in got if r["source"] == s)
        whole = sum(1 for x in rows if x[2] == s)
        assert all(c == whole for b, c in blocks.items() if b < int(quota // sizes[s]))
    assert len({(r["doc_id"], r["block"]) for r in got}) == len(got)
    assert mixing.mix(edge_docs, mixing.Target(max_repeats=2.0)).count() > 0
    assert mixing.mix(edge_docs.where("false"), mixing.Target(entropy=1.0)).count() == 0


# ---- HTML ----


@pytest.mark.parametrize("page, text", [
    ("<p>a<p>b &amp; c", "a\n\nb & c"), ("<ul><li>x<li>y</ul>", "- x\n- y"), ("<ol start=3><li>q<li>r</ol>", "3. q\n4. r"),
    ("<table><tr><td>1<td>long<tr><th>xx<td>y</table>", "1   long\nxx  y"), ("a<br>b", "a\nb"), ("", ""),
    ("<div style='display: none'>no</div><span hidden>no</span>yes", "yes"), ("<script>var a='</p>'</script>t", "t"),
    ("<pre> a\n  b</pre>", " a\n  b"), ("x<!-- c -->y", "xy"), ("</div><b>bold</i></b>er", "bolder"), ("1 < 2 & 3", "1 < 2 & 3"),
    ("<div>" * 3000 + "deep", "deep"), ("<ul><li>" * 200 + "in", None), ("<table>" * 300 + "<td>x", None)])
def test_rendered_text(page, text):
    got = html_text.text_of(page)
    assert got == text if text is not None else isinstance(got, str)
    assert html_text.text_of(None) is None


# ---- near duplicates ----


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment_equals_full():
    rng = random.Random(1)
    left, right = [], []
    for _ in range(150):
        a = [rng.randint(2, 40) * 2 + 1 for _ in range(rng.randint(0, 90))]
        b = [x for x in a if rng.random() > 0.1] + [7] * rng.randint(0, 4)
        left.append(np.array(a, np.uint64))
        right.append(np.array(b, np.uint64))
    limits = order_minhash.allowed(np.array([len(x) for x in left]), np.array([len(x) for x in right]))
    want = [min(levenshtein(list(a), list(b)), m + 1) for a, b, m in zip(left, right, limits)]
    assert order_minhash.distances(left, right, limits).tolist() == want


def test_classes_against_brute_force(spark, edge_docs):
    rng = random.Random(5)
    bases = [[f"w{rng.randint(0, 999)}" for _ in range(rng.randint(40, 120))] for _ in range(25)]
    rows = []
    for base in bases:
        for _ in range(rng.randint(1, 6)):
            w = [x if rng.random() > 0.04 else f"e{rng.randint(0, 99)}" for x in base]
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.classes(docs).collect()}
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in rows:
        for j, b in rows[:i]:
            a_words, b_words = a.split(), b.split()
            if levenshtein(a_words, b_words) <= 0.2 * max(len(a_words), len(b_words)):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert got == {i: find(i) for i, _ in rows}
    edge = order_minhash.classes(edge_docs).collect()
    assert len(edge) == edge_docs.count()
    assert {r["class_id"] for r in edge if r["text"] and r["text"].split() == ["same", "words", "here"]} == {4}
    assert sum(r["kept"] for r in edge if r["class_id"] == 4) == 1
    assert order_minhash.classes(edge_docs.where("false")).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (None, 1), (9, 4), (9, 4), *((100 + k, 101 + k) for k in range(40))]
    got = {r["node"]: r["component"] for r in components.components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 4, 4: 4, 9: 4, **{100 + k: 100 for k in range(41)}}


# ---- vectors ----


def vector_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 16))
    x[100:140] = x[5] + 0.05 * rng.standard_normal((40, 16))
    rows = [(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [None, 1.0], 1), (304, [], 1),
             (305, rows[6][1], None), (306, rows[6][1], 0), (307, rows[6][1][:8], 0), (None, rows[6][1], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), rows


def test_vector_links_against_brute_force(spark):
    df, rows = vector_rows(spark)
    ok = [r for r in rows if r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1]) and r[2] is not None]
    links = {id(r): [s for s in ok if s is not r and s[2] == r[2] and len(s[1]) == len(r[1])
                     and np.dot(r[1], s[1]) / np.linalg.norm(r[1]) / np.linalg.norm(s[1]) >= 0.93] for r in ok}
    got = {r["vec_id"]: r for r in cross_polytope.link(df).collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r[0]]["n_links"] == len(links.get(id(r), []))
    assert got[306]["component_id"] == 6 and not got[306]["kept"] and got[305]["kept"] and got[301]["component_id"] == 301
    assert cross_polytope.link(df.where("false")).count() == 0


def test_neighbours_recall_ties_and_small_tables(spark):
    df, rows = vector_rows(spark)
    x = {r[0]: np.array(r[1]) for r in rows if r[0] is not None and r[0] < 300}
    x |= {305: x[6], 306: x[6]}
    got = pstable.search(df.where("size(embedding) = 16"), df.where("vec_id % 20 = 0 and vec_id < 300"), k=10).collect()
    found, hit = {}, 0
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q, best in found.items():
        want = sorted(((-float((x[v] * x[q]).sum()), v) for v in x if v != q))[:10]
        hit += len({v for _, v in want} & {v for _, v, _ in best})
        assert [r for r, _, _ in sorted(best)] == list(range(1, 11))
        assert [(-s, v) for _, v, s in sorted(best)] == sorted((-s, v) for _, v, s in best)
    assert len(found) == 15 and hit >= 0.9 * 150
    few = pstable.search(df.where("vec_id < 6"), df.where("vec_id = 0"), k=20).collect()
    assert len(few) == 5
    assert pstable.search(df.where("false"), df.where("false")).count() == 0


# ---- language model ----


def test_language_model_scores(spark, edge_docs, sf_dir):
    def tokens(text):
        return words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [None]

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    counts = Counter(t for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 10 for t in tokens(r["text"]))
    n, v = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in gated_lm.score_held_out(docs).collect()}
    for r in rows:
        own, said = tokens(r["text"]), got[r["doc_id"]]
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
        assert said["base_score"] == pytest.approx(base, rel=1e-9) and said["n_tokens"] == len(own)
        assert said["n_known"] == sum(counts[t] > 0 for t in own) and said["train_tokens"] == n
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    edge = gated_lm.score_held_out(edge_docs).collect()
    assert len(edge) == edge_docs.count() and all(math.isfinite(r["score"]) and r["score"] < 0 for r in edge)
    assert gated_lm.score_held_out(edge_docs.where("false")).count() == 0


def small_model():
    words = np.sort(np.append(common.mix(np.arange(1, 70, dtype=np.uint64)), gated_lm.END))
    index = np.where(words == gated_lm.END, 0, np.cumsum(words != gated_lm.END))
    n = np.full(70, 5)
    counts = gated_lm.Counts(350, 70, words, n, index, 70, n, np.log10(np.full(gated_lm.TAIL_CLASSES, 0.1)))
    return counts, gated_lm.Network.start(counts)


def test_model_probabilities_sum_to_one_and_windows_do_not_matter():
    counts, network = small_model()
    state = np.random.default_rng(1).standard_normal((1, gated_lm.HIDDEN)).astype(np.float32)
    everything = np.arange(70 + gated_lm.TAIL_CLASSES)
    p = np.exp(network.log_prob(np.repeat(state, len(everything), axis=0), everything))
    assert p.sum() == pytest.approx(1, abs=1e-4)
    docs = [np.random.default_rng(k).integers(0, 70, size) for k, size in enumerate((1, 7, 300, 299, 64))]
    whole = gated_lm._log_probs(network, docs)
    before, gated_lm.WINDOW_TOKENS = gated_lm.WINDOW_TOKENS, 8
    try:
        assert gated_lm._log_probs(network, docs) == pytest.approx(whole, rel=1e-4)
    finally:
        gated_lm.WINDOW_TOKENS = before


def test_gradients_are_the_slopes():
    _, network = small_model()
    rng = np.random.default_rng(2)
    network = gated_lm.Network({k: x.astype(np.float64) for k, x in network.w.items()})
    ids, targets = rng.integers(0, 100, (6, 3)), rng.integers(0, 100, (6, 3))
    state = np.zeros((3, gated_lm.HIDDEN))

    def loss():
        states = network.steps(ids, state)
        return -network.log_prob(states.reshape(-1, gated_lm.HIDDEN).astype(np.float64), targets.ravel()).mean()

    g, rows, _ = network.gradients(ids, targets, np.ones_like(ids, bool), state)
    for name, at in (("state", (3, 40)), ("class", (2, 1)), ("word", (5, 4)), ("state", (1, 70)), ("class_bias", (2,))):
        keep = network.w[name][at]
        network.w[name][at] = keep + 1e-2
        high = loss()
        network.w[name][at] = keep - 1e-2
        slope = (high - loss()) / 2e-2
        network.w[name][at] = keep
        assert g[name][at] == pytest.approx(slope, rel=0.05, abs=2e-5)
    keep = network.w["inputs"][rows[0], 5]
    network.w["inputs"][rows[0], 5] = keep + 1e-2
    high = loss()
    network.w["inputs"][rows[0], 5] = keep - 1e-2
    assert g["inputs"][0, 5] == pytest.approx((high - loss()) / 2e-2, rel=0.05, abs=2e-5)


# ---- BPE ----


def test_bpe_equals_the_library(spark, edge_docs):
    spec, pattern = tokenizer_files.byte_bpe()
    library = Tokenizer.from_str(spec)
    encoder = bpe.Encoder(bpe.load(spec), pattern)
    rng = random.Random(3)
    letters = "aaabbcdeehilnorstt  \n\t'éñß漢字🙂0123!?-_ THE.　\x1c\x85"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(200)]
    texts += ["a" * 5000, "ab" * 3000, "it's<|endoftext|> we'll<|endoftext|>", "", " ", "x  ", " " * 70_000 + "x", "=-" * 700]
    for text in texts:
        ids = [i for part in encoder.encode(text) for i in part]
        assert ids == library.encode(text, add_special_tokens=False).ids
        decoder = bpe.Decoder(encoder.vocabulary)
        assert "".join([decoder.feed([i]) for i in ids]) + decoder.end() == library.decode(ids, skip_special_tokens=False)
    rows = bpe.encode(edge_docs, spec, pattern).collect()
    assert len(rows) == edge_docs.count() and all(list(r["ids"]) == library.encode(r["text"] or "").ids for r in rows)


def test_stable_tokens_leave_early():
    spec, pattern = tokenizer_files.byte_bpe()
    vocabulary = bpe.Vocabulary(__import__("json").loads(spec))
    word = ("lowering" * 400).encode()
    want = list(vocabulary.encode_word(word))
    vocabulary.lookahead = 300
    assert list(vocabulary.encode_word(word)) == want


# ---- substring ----


def test_substring_edges_and_full_sketch(spark, edge_docs):
    shared = " ".join(f"p{k}" for k in range(40))
    rows = [(1, f"alpha {shared} omega", "x"), (2, f"{shared}\nend", "y"), (3, "short", "z"), (4, None, "n"), (5, "", "e"),
            (6, " ".join(["again"] * 36), "r"), (7, " ".join(["once"] * 35), "o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string")
    for most in (substring_dedup.MOST_COUNTERS, 8):
        before, substring_dedup.MOST_COUNTERS = substring_dedup.MOST_COUNTERS, most
        try:
            got = {r["doc_id"]: (r["kept_text"], r["n_words"], r["n_removed"], r["block"])
                   for r in substring_dedup.remove_repeats(docs).collect()}
        finally:
            substring_dedup.MOST_COUNTERS = before
        assert got == {1: ("alpha omega", 42, 40, "x"), 2: ("end", 41, 40, "y"), 3: ("short", 1, 0, "z"), 4: (None, 0, 0, "n"),
                       5: ("", 0, 0, "e"), 6: ("", 36, 36, "r"), 7: (" ".join(["once"] * 35), 35, 0, "o")}
    assert substring_dedup.remove_repeats(edge_docs).count() == edge_docs.count()
    assert substring_dedup.remove_repeats(edge_docs.where("false")).count() == 0
