"""The training-data operators: edge cases for each, and brute-force versions where SQL cannot express them."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.llm import chat_format, components, exact_dedup, fingerprint, html_extract, jaccard_join, licenses, packing, quality, sentencepiece, toxicity
from glossa.llm.common import shingle_set, shingle_sets, raw

SF = "/root/testdata/sf0.001"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "Lorem ipsum dolor sit amet, " * 4000
# Columns whose names are those used inside operators.
CLASH = "_row string, _text string, _id string, _norm string, _digest string, key string, c string, n string, label string, score string, kept string, _score string"
TEXTS = [(1, "One two three four five six"), (2, "one TWO three four five six"), (3, None), (4, ""), (5, LONG), (5, LONG), (6, "É"), (7, "é"), (None, "one two three four five six"), (None, None), (8, "\n\t ")]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, "en", "s", len(t or ""), *["x"] * 12) for i, t in TEXTS]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, 0) for i in range(1, 7)] + [(7, None, None), (None, 1, 1), (5, 0, 1)], "doc_id long, quality int, toxic int")


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# --- exact dedup ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(spark, edge, keep, weak):
    """With a digest of one byte most texts collide, and byte verification has to part them."""
    digest = (lambda n: F.unhex(F.concat(F.lit("0"), F.substring(F.sha2(n, 256), 1, 1)))) if weak else exact_dedup.sha256_digest
    pick = max if keep == "largest" else min
    for docs in (edge, table(spark, "documents"), edge.limit(0)):
        rows = [(r["doc_id"], (r["text"] or "").translate(LOWER)) for r in docs.collect()]
        groups = defaultdict(list)
        for i, t in rows:
            groups[t].append(i)
        best = {t: pick([i for i in v if i is not None], default=None) for t, v in groups.items()}
        found = exact_dedup.verdicts(docs, keep=keep, digest=digest)
        got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found.collect())
        assert got == Counter((i, best[t], len(groups[t]), i == best[t]) for i, t in rows)
        stay = exact_dedup.deduplicate(docs, keep=keep, digest=digest)
        assert stay.columns == docs.columns
        assert Counter((r["doc_id"], (r["text"] or "").translate(LOWER)) for r in stay.collect()) == Counter((best[t], t) for t in groups)


# --- n-gram Jaccard join -------------------------------------------------------------------------------------------------------


def brute_components(rows, percent=75):
    """Component of each row by comparing all pairs of sets of words themselves; rows of empty sets are alone."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set() for w in words]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    least = {k: min([i for i in v if i is not None], default=None) for k, v in least.items()}
    return [(i, len(sets[k]), least[find(k)] if sets[k] else i) for k, (i, _) in enumerate(rows)]


def near_copies(seed, groups=6, size=40, words=60):
    """Groups of copies edited more and less, so that similarities run from 0.2 to 1, with a passage shared by all."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    shared = rng.choices(vocabulary, k=25)
    rows = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=words) + shared
        for _ in range(size):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4, 6, 9])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(text[: rng.randint(len(text) - 12, len(text))])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_is_exact_on_near_copies(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 4000 if seed == 2 else 1 << 20)
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.components(docs).collect()}
    assert got == set(brute_components(rows))


def test_jaccard_join_edges(spark, edge):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.components(edge).collect())
    assert got == Counter(brute_components(rows))
    stay = jaccard_join.keep_one(edge)
    assert stay.columns == edge.columns
    # The six words, the long text once, É and é as one word each, and all five rows without words.
    assert Counter(r["doc_id"] for r in stay.collect()) == Counter([1, 3, 4, 5, 6, 7, None, 8])
    assert jaccard_join.components(edge.limit(0)).count() == 0 == jaccard_join.keep_one(edge.limit(0)).count()


def test_jaccard_join_on_documents(spark):
    docs = table(spark, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.components(docs).collect()} == set(brute_components(rows))


def test_shingles():
    words = "A b\tC d\x0be f g h".split(" ")
    text = " ".join(words)
    assert len(shingle_set(text)) == len(re.findall(r"[^\x20\x09-\x0D]+", text)) - 4
    assert len(shingle_set("a b")) == 1 and (shingle_set("a b") == shingle_set("A  B")).all() and len(shingle_set(" \n")) == 0
    import pyarrow as pa

    texts = ["", "a b c d e f", "x", "a b c d e", LONG, "f g"]
    for a, t in zip(shingle_sets(*raw(pa.array(texts))), texts, strict=True):
        assert (a == shingle_set(t)).all()


@pytest.mark.parametrize("hub", [100_000, 3])
def test_connected_components(spark, hub, monkeypatch):
    monkeypatch.setattr(components, "HUB", hub)
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 300), rng.randint(100, 300)) for _ in range(90)] + [(7, 7)]
    found = {r["node"]: r["label"] for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert found == {x: find(x) for pair in links if pair[0] != pair[1] for x in pair}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- licences ------------------------------------------------------------------------------------------------------------------


def test_license_base_by_brute_force(spark, edge):
    extra = spark.createDataFrame([(90, "GNU  general-public\nLicense, mit license; CC BY-SA 4.0 and Apache License 2.0. É mit licenses"), (91, "cc by")], "doc_id long, text string")
    docs = edge.select("doc_id", "text").unionByName(extra).unionByName(table(spark, "documents").select("doc_id", "text"))
    expected = []
    for r in docs.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r["text"] or "").translate(LOWER))
        at = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        places = [i for i, _ in at]
        expected.append((r["doc_id"], len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))))
    found = licenses.summarise(docs).collect()
    assert Counter(expected) == Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in found)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1 for r in found)
    assert licenses.summarise(docs.limit(0)).count() == 0 == licenses.detect(docs.limit(0)).count()


def test_license_rules():
    assert len(licenses.rules()) > 400
    labels = lambda t: {d.rule.label for d in licenses.scan(t.lower().encode())}
    assert "mpl" in labels("released under the Mozilla Public License, version 2.0")
    assert labels("GNU Lesser General Public License") == {"lgpl"}  # the shorter name lies within the longer one
    assert labels("nothing here") == set() and "bsd-3-clause" in labels("a 3-Clause BSD style")
    assert "mit" in labels("Permission is hereby granted, free of charge, to any person obtaining a copy") and "mit" in labels("// SPDX-License-Identifier: MIT")
    assert "apache" in labels("https://www.apache.org/licenses/LICENSE-2.0")


def example(pattern):
    """A text that a rule's regular expression matches: the first of alternatives, one of each class, separators as blanks."""
    out = re.sub(r"\(\?:([^|()]*)(?:\|[^()]*)?\)\?? ?", lambda m: m[1] + ("" if m[1].endswith(" ") or not m[1] else " "), pattern)
    out = re.sub(r"\(\?:([^|()]*)(?:\|[^()]*)?\)\?? ?", lambda m: m[1] + " ", out)
    out = re.sub(r"\[(.)[^\]]*\]\+?", r"\1", out).replace(".{1,80}?", "someone").replace(" ?", " ").replace("?", "")
    return out.replace("  ", " ").strip()


def test_every_rule_finds_its_own_text():
    """Of every kind and form, through gate and keyword, in a sentence of its own."""
    plain = [(label, p) for label, _, p in licenses.GRANTS]
    plain += [(label, "spdx license identifier " + licenses._plain(n)) for label, names in licenses.SPDX.items() for n in names.split()]
    plain += [(label, licenses._plain(a)) for label, a in licenses.ADDRESSES]
    plain += [(label, before + name + after.replace("[0-9]+", "2")) for label, _, *names in licenses.NAMES for name in names for before, after, _, _ in licenses.FORMS]
    assert len(plain) + len(licenses.BASE) == len(licenses.rules())
    for label, pattern in plain:
        text = f"xx {example(pattern)} yy".encode()
        rules = [r for r in licenses.rules() if r.label == label and r.pattern.search(text)]
        assert rules and licenses._GATE.search(text) and any(r.keyword.encode() in text for r in rules), (label, pattern, text)
        assert licenses.scan(text), text


def test_suppression_by_comparing_all_pairs():
    rng = random.Random(4)
    words = "gnu lesser general public license version 2 mit apache cc by sa 4 0 the spdx identifier released under terms of".split()
    for _ in range(200):
        text = " ".join(rng.choices(words, k=rng.randint(1, 60))).encode()
        found = [licenses.Detection(r, m.start(), m.end()) for r in licenses.rules() if r.keyword.encode() in text for m in r.pattern.finditer(text)]
        order = {r.name: i for i, r in enumerate(licenses.rules())}

        def held(d):
            for x in found:
                if x is not d and x.start <= d.start and x.end >= d.end:
                    longer, earlier = x.end - x.start > d.end - d.start, order[x.rule.name] < order[d.rule.name]
                    if x.rule.priority > d.rule.priority or (x.rule.priority == d.rule.priority and (longer or earlier)):
                        return True
            return False

        expected = {(d.rule.name, d.start, d.end) for d in found if d.rule.base or not held(d)} if licenses._GATE.search(text) else set()
        assert {(d.rule.name, d.start, d.end) for d in licenses.scan(text)} == expected


def test_a_text_of_many_licence_lines_takes_linear_time():
    import time

    began = time.perf_counter()
    assert len(licenses.scan(b"released under the mit license version 2. " * 50_000)) >= 50_000
    assert time.perf_counter() - began < 60


# --- chat formatting -----------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "<|end|>\n<|turn|>assistant\n\\"), (1, 1, "assistant", "[INST]\\<|x|></s>"), (2, 0, None, None), (2, 0, "assistant", ""), (None, None, "assistant", "a\nb"), (3, 1, "assistant", "later"), (3, 0, "user\nx", "same"), (3, 0, "user\nx", "same")]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("output", F.lit("x"))
    out = {r["conv_id"]: r for r in chat_format.digest(chat_format.format_conversations(docs)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for conv in (1, 2, None, 3):
        turns = sorted(((t if t is not None else -1), r or "", x or "") for c, t, r, x in rows if c == conv)
        said = "".join(x for _, r, x in turns if r == "assistant")
        got = out[conv]
        assert (got["n_turns"], got["turns_sha256"], got["loss_chars"], got["loss_sha256"], got["rewrites"]) == (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(said), sha(said), 0)
    assert chat_format.format_conversations(docs.limit(0)).count() == 0


def test_chat_template_that_rewrites_history():
    forget = lambda turns: "".join(f"{r}:{'' if r == 'think' and k < len(turns) - 1 else t};" for k, (r, t) in enumerate(turns))
    output, spans, rewrites = chat_format.locate(forget, [("user", "a"), ("think", "b"), ("user", "c")])
    assert rewrites == 1 and output == "user:a;think:;user:c;"
    assert output[spans[2].text_start : spans[2].text_end] == "c" and spans[1].text_start == -1
    assert chat_format.locate(forget, [("user", "a"), ("user", "b")])[2] == 0


# --- quality and toxicity ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("classify", [quality.classify, toxicity.classify])
def test_classifier_edges(edge, labels, classify):
    found = classify(edge, labels)
    assert found.count() == len(TEXTS) and all(0 <= r["score"] <= 1 for r in found.collect())
    assert classify(edge.limit(0), labels).count() == 0 and classify(edge, labels.limit(0)).count() == len(TEXTS)
    equal = {r["doc_id"]: r["score"] for r in found.collect()}
    assert equal[3] == equal[4]


def test_filters_keep_columns(edge, labels):
    assert quality.keep_good(edge, labels, threshold=0.0).columns == edge.columns
    assert toxicity.keep_clean(edge, labels, threshold=1.1).count() == len(TEXTS)


@pytest.mark.parametrize("classify, label, least", [(quality.classify, "quality", 0.97), (toxicity.classify, "toxic", 0.9)])
def test_held_out_accuracy(spark, classify, label, least):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = classify(docs, marks).where("held_out").join(marks, "doc_id").select("predicted", label).collect()
    right = [r["predicted"] == r[label] for r in rows]
    assert len(rows) > 500 and sum(right) / len(right) >= least


def test_labels_of_held_out_rows_never_count(spark):
    docs, marks = table(spark, "documents"), table(spark, "labels")
    flipped = marks.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda m: sorted((r["doc_id"], r["score"]) for r in quality.classify(docs, m).collect())
    assert score(marks) == score(flipped)


def test_sample_keeps_its_limit_when_ids_repeat(spark):
    from glossa.llm.common import labelled_sample

    docs = spark.range(3000).select((F.col("id") % 7).alias("doc_id"), F.col("id").cast("string").alias("text"))
    marks = spark.range(7).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    assert labelled_sample(docs, marks, "toxic", 4).count() <= 4
    assert labelled_sample(docs, marks, "toxic", 4, each=True).count() <= 4


def test_forest_traversal_matches_walking_each_tree():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 5))
    forest = quality.fit(x, (x[:, 0] * x[:, 1] > 0).astype(float), trees=20)
    for row in x[:50]:
        total = forest.base
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += leaf[node - len(f)]
        assert abs(total - forest.raw_score(row[None])[0]) < 1e-9
    assert ((forest.predict(x) > 0.5) == (x[:, 0] * x[:, 1] > 0)).mean() > 0.9


def test_network_gradients_match_differences():
    net = toxicity.Network(3)
    t = toxicity.Tokens(*toxicity._pack(["some words here and there", "é"]))
    e, _ = net.embed(t)
    weights = np.array([0.7, -1.3], np.float32)
    run = lambda: float((net.forward(net.inputs(e), t.window) * weights).sum())
    x = net.inputs(e)
    g, d_x = net.backward(t.window, net.forward(x, t.window, keep=True)[1], weights, t.n + 1)
    g["wx"] = e.T @ d_x.transpose(1, 0, 2).reshape(t.n + 1, -1)
    for name in ("u", "wa", "va", "wo", "wx"):
        w = net.p[name]
        at = np.unravel_index(np.abs(g[name]).argmax(), w.shape)
        old, eps = w[at], 2e-2
        w[at] = old + eps
        up = run()
        w[at] = old - eps
        down = run()
        w[at] = old
        assert abs((up - down) / (2 * eps) - g[name][at]) < 0.05 * max(abs(g[name][at]), 0.02), name


def test_windows_cover_and_overlap():
    for n in (0, 1, 32, 33, 48, 49, 500):
        text, start = toxicity.windows(np.array([n]))
        seen = {i for s in start for i in range(s, min(s + toxicity.WINDOW, n))}
        assert seen == set(range(n)) and all(b - a <= toxicity.STRIDE for a, b in zip(start, start[1:], strict=False))


# --- HTML ----------------------------------------------------------------------------------------------------------------------


def test_html_article(spark):
    page = (
        "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/x'>Menu</a></ul></nav><!-- ad --><div class=\"ad\">Buy</div>"
        "<article><header><h1>Head &amp; line</h1></header><p><b>One<br>two<p>three&nbsp;&eacute;\n x</p><div class='comments'>no</div><aside>no</aside><form>no<input></form>after</article><footer>&copy; no</footer></body></html>"
    )
    rows = [(1, "https://h/a", page), (2, None, None), (3, "https://h/b", ""), (4, "https://h/c", "plain &lt;text"), (1, "https://h/a", page)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_host", F.lit("x"))
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract(docs).collect()), key=str)
    text = "Head & line One two three é x after"
    assert got == sorted([(1, text, len(text)), (1, text, len(text)), (2, "", 0), (3, "", 0), (4, "plain <text", 11)], key=str)
    assert html_extract.extract(docs.limit(0)).count() == 0


def test_html_repeats_of_a_host_go_where_markup_does_not_decide(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdef", k=6))
    banner = " ".join(word() for _ in range(12))
    own = {i: " ".join(word() for _ in range(30)) for i in range(40)}
    rows = [(i, f"https://h{i % 2}.org/{i}", f"<div>{banner}</div><div>{own[i]} {banner}</div>") for i in own]
    found = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["page_id"]: r["text"] for r in found.collect()} == own


def brute_cover(texts, least, share):
    """For each token of each page (text blocks, a line each) whether a run common on enough distinct pages covers it."""
    n, where = html_extract.REPEAT, defaultdict(set)
    streams = [t.split() for t in texts]
    for text, s in zip(texts, streams, strict=True):
        for k in range(len(s) - n + 1):
            where[tuple(s[k : k + n])].add(text)
    out = []
    for s in streams:
        cover = [False] * len(s)
        for k in range(len(s) - n + 1):
            if len(where[tuple(s[k : k + n])]) >= max(least, share * len(set(texts))):
                cover[k : k + n] = [True] * n
        out.append(cover)
    return out


def test_suffix_array_covers_what_brute_force_finds(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choices("ab", k=rng.randint(0, 40))) or "a" for _ in range(30)]
    texts += ["\n".join(rng.choices(["a b a b a", "b b b b b b b b b", "x"], k=3)) for _ in range(9)] + texts[:3] + [""]
    for least, share in ((2, 0.0), (3, 0.2), (4, 0.4)):
        monkeypatch.setattr(html_extract, "LEAST", least)
        monkeypatch.setattr(html_extract, "SHARE", share)
        shard = html_extract.Shard(list(range(len(texts))), texts, [b""] * len(texts), texts)
        assert shard.boilerplate()[0].tolist() == sum(brute_cover(texts, least, share), [])


def test_suffix_ranks_are_those_of_the_sorted_prefixes():
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 2, 400)
    ranks = html_extract.suffix_ranks(tokens)
    prefixes = [tuple(tokens[i : i + html_extract.REPEAT]) for i in range(len(tokens))]
    order = {p: i for i, p in enumerate(sorted(set(prefixes)))}
    assert ranks.tolist() == [order[p] for p in prefixes]


def test_html_of_the_pages_table_by_brute_force(spark, monkeypatch):
    """All pages, by the markup as it stands and with every block undecided, in one part a host and in many, for few and many partitions."""
    docs = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = docs.collect()
    articles = {r["page_id"]: re.sub(r"\s+", " ", html_of(re.search(r"<article>(.*)</article>", r["html"], re.S)[1])).strip() for r in rows}
    assert {r["page_id"]: r["text"] for r in html_extract.extract(docs).collect()} == articles
    bare = docs.withColumn("html", F.regexp_replace("html", "</?(article|nav|footer|div)[^>]*>", "<p>"))
    bare = bare.withColumn("html", F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("<p>Subscribe to our letter and never miss any of our stories again</p>"))).otherwise(F.col("html")))
    pages = [(r["page_id"], r["url"].split("/")[2].lower(), html_extract.blocks(r["html"])) for r in bare.collect()]
    expected = {}
    for host in {h for _, h, _ in pages}:
        own = [(i, found) for i, h, found in pages if h == host]
        for (i, found), cover in zip(own, brute_cover(["\n".join(t for _, t in f) for _, f in own], html_extract.LEAST, html_extract.SHARE), strict=True):
            words = [(w, p) for p, t in found for w in t.split(" ")]
            expected[i] = " ".join(w for (w, p), c in zip(words, cover, strict=True) if p and not c), sum(cover)
    for size, partitions in ((4_000_000, 4), (20_000, 4), (20_000, 64)):
        monkeypatch.setattr(html_extract, "SHARD_CHARS", size)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            assert {r["page_id"]: (r["text"], r["n_repeated"]) for r in html_extract.extract(bare).collect()} == expected
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)


def html_of(article):
    """The text of an article whose tags are plain: block tags part words, others do not."""
    import html

    return html.unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", article)))


def test_html_what_nearly_every_page_says_is_not_the_article(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdef", k=6))
    letter, licence = (" ".join(word() for _ in range(12)) for _ in range(2))
    own = {i: " ".join(word() for _ in range(30)) for i in range(40)}
    rows = [(i, f"https://h.org/{i}", f"<article><p>{own[i]}</p><p>{letter}</p>" + f"<p>{licence}</p>" * (i % 2) + "</article>") for i in own]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (1_000_000, 500):
        monkeypatch.setattr(html_extract, "SHARD_CHARS", size)
        assert {r["page_id"]: r["text"] for r in html_extract.extract(docs).collect()} == {i: own[i] + f" {licence}" * (i % 2) for i in own}


def test_html_lexing_is_linear():
    import time

    began = time.perf_counter()
    for n in (60, 100_000):
        for page in ("<p>x</p><a " + '"' * (n + 1) + "> text", '<a href="' * n + ">", "<a b='" * n + "> y", "<" * n, "<p" * n, "<!" * n, "<!--" * n, "<script" * n, "<script>" * n, "<p><b>" * n, '<div class="' + "1" * n + 'x">', "&" * n, "</p>" * n):
            html_extract.blocks(page)
    assert time.perf_counter() - began < 30
    assert html_extract.blocks('<p>a</p><p title="x>b</p><p>c</p>') == [(1, "a"), (1, "b"), (1, "c")]
    assert html_extract.blocks("a<!-- > b") == [(1, "a")] and html_extract.blocks("a > b < c") == [(1, "a > b < c")]


def test_html_main_text_outside_the_article_and_whole_names_only():
    page = '<main><h1>Title</h1><article class="post"><p class="social-science">a</p><p class="legal-history">b</p><div id="search-results">c</div><header class="article-header">d</header><div class="cookie-banner">no</div><div class="nav-menu">no</div><section id="comments">no</section></article></main><div class="header">no</div>'
    assert [t for p, t in html_extract.blocks(page) if p >= html_extract.MAIN] == ["Title", "a", "b", "c", "d"]


def test_html_repeats_are_found_over_the_whole_of_a_large_host(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdef", k=6))
    notice = " ".join(word() for _ in range(12))
    own = {i: " ".join(word() for _ in range(30)) for i in range(60)}
    rows = [(i, f"https://h.org/{i}", f"<div>{own[i]}</div>" + (f"<div>{notice}</div>" if i % 4 == 0 else "")) for i in own]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (1_000_000, 500):
        monkeypatch.setattr(html_extract, "SHARD_CHARS", size)
        found = {r["page_id"]: (r["text"], r["n_repeated"]) for r in html_extract.extract(docs).collect()}
        assert found == {i: (own[i], 12 if i % 4 == 0 else 0) for i in own}


def test_html_keeps_copied_pages_and_shared_quotations(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdef", k=6))
    banner, quote = (" ".join(word() for _ in range(12)) for _ in range(2))
    own = {i: " ".join(word() for _ in range(30)) + (f" {quote}" if i < 2 else "") for i in range(40)}
    own |= {i: own[i - 40] for i in range(45, 50)}  # copies under other ids
    rows = [(i, f"https://h.org/{i}", f"<div>{banner}</div><p>{own[i]}</p>") for i in own]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    pair = spark.createDataFrame([(i, "https://two.org/", f"<p>{own[9]}</p>") for i in (1, 2)], docs.schema)
    for size in (1_000_000, 500):
        monkeypatch.setattr(html_extract, "SHARD_CHARS", size)
        found = html_extract.extract(docs).collect()
        assert {r["page_id"]: r["text"] for r in found} == own
        assert {r["n_repeated"] for r in found} == {12}  # the quotation stands on two pages only
        assert [r["text"] for r in html_extract.extract(pair).collect()] == [own[9]] * 2


# --- packing -------------------------------------------------------------------------------------------------------------------


def test_packing(spark, edge):
    docs = table(spark, "documents")
    for frame, capacity in ((docs, 512), (edge, 64)):
        rows = packing.pack(frame, capacity=capacity, shard=100).collect()
        words = [len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) + 1 for r in frame.collect()]
        assert sum(r["n_tokens"] for r in rows) == sum(words)
        bins = defaultdict(list)
        for r in rows:
            bins[r["bin_id"]].append(r)
        for b in bins.values():
            at = 0
            for r in sorted(b, key=lambda r: r["position"]):
                assert r["position"] == at
                at += r["n_tokens"]
            assert at <= capacity and len({r["source"] for r in b}) == len(b) == len({r["cluster"] for r in b})
    assert packing.pack(edge.limit(0)).count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = random.Random(9)
    sizes = sorted((rng.randint(1, 60) for _ in range(300)), reverse=True)
    sources, clusters = [rng.choice([None, *"abcdefgh"]) for _ in sizes], [rng.choice([None, *range(40)]) for _ in sizes]
    bins = []
    for (b, at), size, s, c in zip(packing.pack_shard(sizes, sources, clusters, 100), sizes, sources, clusters, strict=True):
        left = [100 - sum(x[0] for x in y) for y in bins]
        clash = [any((s is not None and x[1] == s) or (c is not None and x[2] == c) for x in y) for y in bins]
        fit = [v for v, no in zip(left, clash, strict=True) if v >= size and not no]
        if fit:  # of equally tight bins any will do
            assert left[b] == min(fit) and not clash[b] and at == 100 - left[b]
        else:
            assert b == len(bins) and at == 0
            bins.append([])
        bins[b].append((size, s, c))


# --- SentencePiece -------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepiece.Vocabulary.load(VOCABULARY)


def test_sentencepiece_is_the_best_segmentation():
    pieces = [("<unk>", 0.0, 2), *[(f"<0x{b:02X}>", 0.0, 6) for b in range(256)], *[(p, s, 1) for p, s in [("▁", -4.0), ("a", -3.0), ("b", -3.5), ("ab", -5.0), ("▁a", -5.5), ("ba", -7.0), ("aba", -9.0), ("▁ab", -8.25)]]]
    v = sentencepiece.Vocabulary.build(pieces)
    rng = random.Random(8)

    def best(text):
        value = [0.0] + [-1e18] * len(text)
        for j in range(1, len(text) + 1):
            for i in range(max(0, j - 4), j):
                s = v.score.get(text[i:j])
                if s is None and j == i + 1:
                    s = v.unknown
                if s is not None:
                    value[j] = max(value[j], value[i] + s)
        return value[-1]

    for _ in range(300):
        text = "".join(rng.choices("ab é", k=rng.randint(1, 14)))
        total, ids, k = 0.0, v.encode(text), 0
        assert v.decode(ids) == text
        while k < len(ids):
            piece = v.text[ids[k]].decode("utf-8", "ignore") if ids[k] > 256 else None
            if piece is None:  # a character as bytes
                k += 2
                total += v.unknown
            else:
                k += 1
                total += v.score[piece]
        assert abs(total - best(" " + text)) < 1e-9


def test_sentencepiece_scan_equals_one_go(vocabulary):
    v, rng = vocabulary, random.Random(3)
    for k in range(120):
        text = "".join(rng.choice("ehtano ,." if k % 2 else "ehtaa中é") for _ in range(rng.randint(1, 90)))
        size, spaced = rng.choice([16, 17, 20, 31]), " " + text
        parts = [(spaced[i : i + size + v.longest - 1], min(size, len(spaced) - i)) for i in range(0, len(spaced), size)]
        reached = sentencepiece.reach(np.stack([v.transfer(*p) for p in parts]))
        borders = sentencepiece.compose([v.entries(*p, reached[i]) for i, p in enumerate(parts)])
        assert [x for i, p in enumerate(parts) for x in v.between(*p, borders[i], borders[i + 1])] == v.encode(text)


def test_max_plus_products_are_associative():
    a, b, c = np.random.default_rng(1).integers(-50, 0, (3, 5, 5)).astype(float)
    product = sentencepiece.max_plus
    assert (product(product(a, b), c) == product(a, product(b, c))).all()
    assert (sentencepiece.scan(np.stack([a, b, c]))[-1] == product(product(a, b), c)).all()


def test_sentencepiece_frames(spark, edge, vocabulary):
    docs = edge.unionByName(edge.select(*[F.lit("a  b ▁ 中\u0000").alias(c) if c == "text" else F.col(c) for c in edge.columns]).limit(1))
    for chunk in (1 << 15, 50):
        rows = sentencepiece.summarise(docs, vocabulary, chunk=chunk).collect()
        expected = Counter((r["doc_id"], *sentencepiece._digest_row(vocabulary.encode(r["text"] or ""), vocabulary)) for r in docs.collect())
        assert Counter(tuple(r) for r in rows) == expected
        assert Counter(r["decoded_sha256"] for r in rows) == Counter(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in docs.collect())
    assert sentencepiece.summarise(docs.limit(0), vocabulary).count() == 0


# --- fingerprints --------------------------------------------------------------------------------------------------------------


def test_fingerprints(spark, edge):
    docs = table(spark, "documents")
    for frame in (docs, edge, edge.limit(1), edge.limit(0)):
        rows = sorted(((r["doc_id"], r["text"] or "") for r in frame.collect()), key=lambda r: (-(2**63) if r[0] is None else r[0], r[1].encode()))
        expected = []
        for k, (i, t) in enumerate(rows):
            after, cut = rows[(k + 1) % len(rows)][1], len(t) // 4
            edited = t[: len(t) - cut] + after[:cut]
            a, b, c = (fingerprint.order_minhash(x) for x in (t, edited, after))
            expected.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprint.to_text(a), fingerprint.to_text(b), fingerprint.likeness(a, b), fingerprint.likeness(a, c)))
        assert Counter(tuple(r) for r in fingerprint.edited_fingerprints(frame).collect()) == Counter(expected)
    added = fingerprint.add_fingerprints(edge)
    assert added.columns == [*edge.columns, "fingerprint"] and added.count() == len(TEXTS)


def test_fingerprints_take_minima_over_all_kmers_of_a_text():
    rng = random.Random(3)
    wrap = lambda x: x & (2**64 - 1)
    mixed = lambda x: int(fingerprint.mix(np.array([wrap(x)], dtype=np.uint64))[0])
    factors = [mixed(s * 0x9E3779B97F4A7C15) | 1 for s in range(1, fingerprint.SKETCHES + 1)]
    for n in (5, 8, 9, 150, 600, 3000):
        data = np.frombuffer("".join(rng.choice("ab c") for _ in range(n)).encode(), dtype=np.uint8)
        k = min(fingerprint.K, n)
        starts = np.arange(n - k + 1)
        seen, grams = Counter(), []
        for place, h in enumerate(fingerprint.span_hashes(data, starts, starts + k).tolist()):
            h >>= 24
            grams.append((mixed(h * 0x9E3779B97F4A7C15 + seen[h] * 0xC2B2AE3D27D4EB4F + 1), place))
            seen[h] += 1
        expected = []
        for f in factors:
            least = sorted(grams, key=lambda g: wrap(g[0] * f))[: fingerprint.TUPLE]
            out = len(least)
            for value, _ in sorted(least, key=lambda g: g[1]):
                out = mixed(out * 0x100000001B3 + value)
            expected.append(max(out >> 48, 1))
        assert fingerprint.order_minhash(data.tobytes().decode()).tolist() == expected


def test_fingerprints_follow_order():
    rng = random.Random(2)
    words = [f"{rng.randrange(10**6)}" for _ in range(200)]
    text, moved = " ".join(words), " ".join(words[100:] + words[:100])
    edited = " ".join(words[:190] + ["x"] * 10)
    a = fingerprint.order_minhash(text)
    assert fingerprint.likeness(a, a) == 1
    assert fingerprint.likeness(a, fingerprint.order_minhash(edited)) > fingerprint.likeness(a, fingerprint.order_minhash(moved)) > 0
    assert fingerprint.likeness(a, fingerprint.order_minhash(" ".join(map(str, range(300))))) < 0.3


# --- pipeline ------------------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    docs = table(spark, "documents")
    marks = table(spark, "labels")
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in kept.collect()}
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns, name
        after = {r["doc_id"] for r in kept.collect()}
        if name == "quality_classifier":
            expected = {r["doc_id"] for r in quality.classify(docs, marks).where("predicted = 1").collect()}
        elif name == "toxicity":
            rows = spark.createDataFrame(list(before.items()), "doc_id long, text string")
            expected = {r["doc_id"] for r in toxicity.classify(rows, marks).where("predicted = 0").collect()}
        elif name == "exact_dedup":
            expected = set({(t or "").translate(LOWER): i for i, t in sorted(before.items())}.values())
        else:
            expected = {c for _, _, c in brute_components(list(before.items()))}
        assert after == expected, name
    final = pipeline.run(spark, SF)
    assert {r["doc_id"] for r in final.select("doc_id").distinct().collect()} == after
