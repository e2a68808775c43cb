"""Line labels, vector codes and token alignment against plain second versions."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from glossa.llm import chat_format, fingerprint, line_quality, queries, token_align, vector_codes
from glossa.llm.common import raw

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n \n", "a▁b", "  lead  and trail \n\n x\t", "日本語 の テキスト 　 wide è", "<s> </s> <|endoftext|> <0x41>", "x" * 3000, "same same", "same same", "a \x1c b \u0085 c", " it's we'll 'tis 12 345", "🙂 🙂🙂 ok"]


def counted(text):
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_line_counts_against_plain_counting(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = [(-1 - k, t) for k, t in enumerate([*ODD, "b\na\n\nb\r\nb\n a\na", "one two three four five six seven eight " * 4, "w " * 19, "w " * 20])]
    docs = docs.union(spark.createDataFrame(more, "doc_id long, text string"))
    texts = dict((r.doc_id, r.text or "") for r in docs.collect())
    found = line_quality.judge(docs, line_quality.Field.blank(), ["doc_id"]).collect()
    assert len(found) == len(texts)
    for r in found:
        expected = counted(texts[r._row.doc_id])
        assert (r._n_words, r._word_chars, r._n_symbols, r._n_dup_lines, r._n_repeat_words) == expected
        assert r._base_failed == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])
        assert r._kept == (not r._base_failed)  # a blank field calls every line content


@pytest.fixture(scope="module")
def some_field():
    rng = np.random.default_rng(3)
    return line_quality.Field(rng.normal(size=line_quality.N_FEATURES), rng.normal(size=(2, 2)), rng.normal(size=2))


def paths(field, x):
    """All label paths of one text with their scores."""
    emit = field.emit(x)
    for path in itertools.product((0, 1), repeat=len(x)):
        yield path, field.start[path[0]] + sum(emit[t, k] for t, k in enumerate(path)) + sum(field.step[a, b] for a, b in itertools.pairwise(path))


def test_viterbi_and_gradient_against_all_paths(some_field):
    rng = np.random.default_rng(4)
    sizes = [1, 5, 3, 7, 1]
    x, owner = rng.normal(size=(sum(sizes), line_quality.N_FEATURES)), np.repeat(np.arange(len(sizes)), sizes)
    label = some_field.viterbi(x, owner)
    gold = rng.integers(0, 2, len(x))
    expected, reached = 0.0, []
    for k in range(len(sizes)):
        every = dict(paths(some_field, x[owner == k]))
        assert max(every, key=every.get) == tuple(label[owner == k])
        expected += every[tuple(gold[owner == k])] - np.logaddexp.reduce(list(every.values()))
    value, slope = line_quality.gradient(some_field, x, owner, gold)
    assert abs(value - expected) < 1e-9
    for name in ("weights", "step", "start"):
        for at in np.ndindex(getattr(some_field, name).shape):
            moved = []
            for d in (1e-5, -1e-5):
                other = line_quality.Field(some_field.weights.copy(), some_field.step.copy(), some_field.start.copy())
                getattr(other, name)[at] += d
                moved.append(line_quality.gradient(other, x, owner, gold)[0])
            reached.append(abs((moved[0] - moved[1]) / 2e-5 - getattr(slope, name)[at]))
    assert max(reached) < 1e-4


def test_line_rules_tell_held_out_documents_apart(spark):
    at = "/root/testdata/sf0.01"
    found = queries.op11_line_quality_rules(spark, at)
    labels = spark.read.parquet(f"{at}/labels.parquet").select("doc_id", "quality")
    rows = found.join(labels, "doc_id").where("not base_failed").selectExpr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 as held", "quality", "kept").collect()
    held = [r for r in rows if r.held]
    assert len(held) > 30 and sum(r.kept == (r.quality == 1) for r in held) >= 0.97 * len(held)
    assert all(r.kept for r in rows if r.quality == 1)


def test_line_rules_keep_columns_and_take_odd_tables(spark):
    docs = spark.createDataFrame([(None, "w " * 30, "x"), (1, None, "y"), (1, "w v " * 3, "z")], "doc_id long, text string, _row string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert line_quality.keep_content(docs, labels).columns == docs.columns
    assert line_quality.classify(docs.where("false"), labels).count() == 0
    unrepeated = spark.createDataFrame([(1, " ".join(map(str, range(25))), "x")], "doc_id long, text string, _row string")
    assert line_quality.keep_content(unrepeated, labels).collect() == unrepeated.collect()


def coded(rows, parts=8, entries=16, rounds=6):
    """Product codes by all distances."""
    rows = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: r[0])
    whole = np.floor(np.array([r[1] for r in rows], dtype=np.float64) * 4096).astype(np.int64)
    cut = whole.reshape(len(rows), parts, -1).transpose(1, 0, 2)
    books = cut[:, :entries].copy()
    near = lambda p: ((cut[p][:, None] - books[p][None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        fresh = books.copy()
        for p in range(parts):
            won = near(p).argmin(axis=1)
            for e in set(won.tolist()):
                fresh[p, e] = cut[p][won == e].sum(axis=0) // (won == e).sum()
        books = fresh
    all_far = [near(p) for p in range(parts)]
    error = sum(f.min(axis=1) for f in all_far)
    by_label = defaultdict(int)
    for r, e in zip(rows, error, strict=True):
        by_label[r[2]] += int(e)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return [(r[0], "".join(f"{f[k].argmin():02x}" for f in all_far), int(error[k]), by_label[r[2]], digest) for k, r in enumerate(rows)]


def test_vector_codes_against_all_distances(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert sorted(map(tuple, vector_codes.compress(table).collect())) == coded([tuple(r) for r in table.collect()])
    # Few values, so that distances tie often, in several partitions and with odd rows.
    rng = np.random.default_rng(5)
    rows = [(k, (rng.integers(-2, 3, 16) / 4096).tolist(), None if k % 3 else k % 4) for k in range(300)]
    odd = [(400, None, 1), (401, [1.0, None] * 8, 1), (402, [float("nan")] * 16, 1), (403, [float("inf")] * 16, 1)]
    table = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<double>, label long, _id string").repartition(7)
    assert sorted(map(tuple, vector_codes.compress(table).collect())) == coded(rows)


def test_vector_codes_of_few_and_of_unfit_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert vector_codes.compress(make([])).count() == 0
    found = vector_codes.compress(make([(1, [1.0] * 8, None), (1, [0.5] * 8, None), (None, [2.0] * 8, 3), (7, [], 1), (8, [1.0] * 16, 1), (9, [1.0] * 7, 1)])).collect()
    assert sorted((r.vec_id or 99, r.code) for r in found) == [(1, "00" * 8), (1, "01" * 8), (99, "02" * 8)]
    with pytest.raises(Exception, match="would overflow"):
        vector_codes.compress(make([(1, [1e9] * 8, 1)])).count()


def test_tree_finds_the_lowest_of_equal_entries():
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 16, 40):
        entries, points = rng.integers(-2, 3, (n, 4)), rng.integers(-3, 4, (500, 4))
        far = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        index, best = vector_codes.Tree.build(entries).nearest(points)
        assert (index == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()


@pytest.fixture(scope="module")
def pair():
    return token_align.Pair.load(queries.BYTE_VOCABULARY, queries.VOCABULARY)


def aligned(texts):
    """Both tokenizers on whole texts, tokens walked one by one."""
    import sentencepiece
    import tokenizers

    a_model, b_model = tokenizers.Tokenizer.from_file(queries.BYTE_VOCABULARY), sentencepiece.SentencePieceProcessor(model_file=queries.VOCABULARY)
    a_model.encode_special_tokens = True
    signs, names = token_align._byte_of_sign(), {i: s for s, i in a_model.get_vocab().items()}
    count, rows = Counter(), []
    for text in texts:
        a, b = a_model.encode(f" {text}", add_special_tokens=False).ids if text else [], b_model.encode(text) if text else []
        a_bytes = [bytes(signs[c] for c in names[i]) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_model.id_to_piece(i)) for i in b)]
        if not text or {b"".join(a_bytes), b"".join(b_bytes)} != {f" {text}".encode()}:
            rows.append(None)
            continue
        i = j = x = y = 0
        links, groups = [], [([], [])]
        while i < len(a):
            links.append((a[i], b[j]))
            x_end, y_end = x + len(a_bytes[i]), y + len(b_bytes[j])
            if x_end <= y_end:
                groups[-1][0].append(a[i])
                i, x = i + 1, x_end
            if y_end <= x_end:
                groups[-1][1].append(b[j])
                j, y = j + 1, y_end
            if x_end == y_end:
                groups.append(([], []))
        count.update(links)
        rows.append((len(a), len(b), groups[:-1], links))
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    for r in rows:
        if r is None:
            yield 0, 0, 0, 0, 0, 0, ""
        else:
            shown = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in r[2])
            yield r[0], r[1], len(r[2]), len(r[3]), sum(count[x] == most[x[1]] for x in r[3]), sum(count[x] for x in r[3]), hashlib.sha256(shown.encode()).hexdigest()


def test_alignment_against_token_by_token(spark, pair):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(str(k), t) for k, t in enumerate(ODD)] + [(None, "same same")], "doc_id string, text string")
    docs = docs.selectExpr("concat('d', doc_id) as doc_id", "text").union(more).repartition(3)
    given = [tuple(r) for r in docs.collect()]
    expected = Counter((i, *x) for (i, _), x in zip(given, aligned([t for _, t in given]), strict=True))
    for block in (token_align.BLOCK, 2000):
        assert Counter(map(tuple, token_align.align(docs, pair, block_bytes=block).collect())) == expected


def test_alignment_of_an_empty_table_and_clashing_names(spark, pair):
    docs = spark.createDataFrame([(1, "a b", "x", 2)], "doc_id int, text string, _text string, block int")
    assert token_align.align(docs.where("false"), pair).count() == 0
    assert token_align.align(docs, pair).first().n_groups == 2


def test_words_stay_whole_where_a_piece_could_reach_across(pair):
    model = token_align.Aligner(pair)
    texts = pa.array(["a bc  d e", "", " x", "one two three"])
    cut = model.align(texts)
    model.cuts = False
    whole = model.align(texts)
    assert all((getattr(cut, f) == getattr(whole, f)).all() for f in ("a", "b", "a_at", "b_at", "groups_at", "links_at"))


def test_word_cuts_leave_white_space_of_any_kind_alone():
    data, offsets = raw(pa.array([" ab cd", "  x y\t z　 w"]))
    at, plain = token_align.word_cuts(data, offsets[:-1])
    pieces = [bytes(data[p:q]).decode() for p, q in zip(at, [*at[1:], len(data)], strict=True)]
    assert pieces == [" ab", " cd", "  x", " y\t z　 w"] and plain.tolist() == [True, True, False, True]


def test_fingerprints_of_text_ids_follow_their_order(spark):
    texts = ["alpha beta gamma delta", None, "alpha beta gamma epsilon", "", "zeta eta theta iota kappa", "alpha beta gamma delta"]
    numbers = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    named = spark.createDataFrame([(f"d{k}" if k else None, t) for k, t in enumerate(texts)], "doc_id string, text string").repartition(3)
    expected = {(f"d{r[0]}" if r[0] else None, *r[1:]) for r in map(tuple, fingerprint.edited_fingerprints(numbers).collect())}
    assert set(map(tuple, fingerprint.edited_fingerprints(named).collect())) == expected
    assert fingerprint.edited_fingerprints(named.where("false")).count() == 0


def test_a_probe_that_a_conversation_holds_is_not_taken():
    turns = [("user" + chat_format.PROBE, "hi"), ("assistant", chat_format.PROBE[:-1] + "1" + chat_format.PROBE[-1])]
    output, spans, rewrites = chat_format.locate(chat_format.TurnTemplate(), turns)
    assert rewrites == 0 and [output[s.text_start : s.text_end] for s in spans] == [t for _, t in turns]
    told = lambda turns: "".join(f"<{r}>{t}" for r, t in turns) + f" of {len(turns)}"  # noqa: E731  it rewrites its end
    output, spans, rewrites = chat_format.locate(told, turns)
    assert rewrites and [output[s.text_start : s.text_end] for s in spans] == [t for _, t in turns]
