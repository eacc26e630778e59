"""Each operator against brute force or an exact round trip, with the edge cases of its docstring."""

import base64
import hashlib
import itertools
import random
import tempfile

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lexigraph.llm import attention_lm, bpe, decontaminate, html_text, near_duplicates, preferences, quality, repeats, run_length, topk, warc

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id bigint, text string, ids string, score string, h string, kept string, n bigint"


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "x", "y", "z", "k", i) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, reference):
    texts = ["", None, "it's we'll 12 \n\n  \t x", "aaaa" * 900, " " * 700, "żółć 😀 　中文", "same", "same"]
    got = bpe.encode(docs(spark, texts), "text", PATH, public_tokenizers.PATTERN, "ids", "raw").orderBy("doc_id").collect()
    assert [r["ids"] for r in got] == [reference.encode_ordinary(t or "") for t in texts]
    assert [bytes(r["raw"]).decode() for r in got] == [t or "" for t in texts]
    back = bpe.decode(spark.createDataFrame([(1, got[5]["ids"]), (2, None)], "k int, ids array<int>"), "ids", PATH, public_tokenizers.PATTERN).orderBy("k").collect()
    assert bytes(back[0]["decoded"]).decode() == texts[5] and bytes(back[1]["decoded"]) == b""
    assert bpe.digests(docs(spark, []), "text", PATH, public_tokenizers.PATTERN).count() == 0


def test_decontamination(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([3, 6, 12, 20, 35, 60])] + [(90, ""), (91, None), (92, "!!")]
    noise = lambda n: " ".join(rng.choices([f"z{i}" for i in range(50)], k=n))
    texts = [f"{noise(30)} {items[i][1]} {noise(30)}" for i in range(6)] + ["", None, noise(200), noise(20000)]
    words = items[4][1].split()
    words[7] = "other"
    texts.append(noise(9) + " " + " ".join(words).upper() + ", " + noise(9))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    assert got == {**{(i, i): 0 for i in range(6)}, (10, 4): 1}
    assert {r["doc_id"] for r in decontaminate.without_items(docs(spark, texts), bench).collect()} == {6, 7, 8, 9}
    assert decontaminate.contaminated(docs(spark, texts), bench.limit(0)).count() == 0


def test_decontamination_wherever_the_edits_are(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    items, texts = [], []
    for n in (8, 20, 57, 200):
        for edit in ("front", "back", "cut", "spread") * 3:
            words, edits = rng.choices(vocabulary, k=n), int(0.15 * n)
            items.append((len(items), " ".join(words)))
            if edit == "front":
                words[:edits] = ["x"] * edits
            elif edit == "back":
                words[-edits:] = ["x"] * edits
            elif edit == "cut":
                del words[:edits]
            else:
                for _ in range(edits):
                    words[rng.randrange(len(words))] = "x"
            texts.append(" ".join(rng.choices(vocabulary, k=30) + words + rng.choices(vocabulary, k=30)))
    found = decontaminate.contaminated(docs(spark, texts), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(i, i) for i in range(len(items))}


def test_decontamination_against_exact_distances():
    """Short texts over few words, so that many near misses occur; every pair is measured by edit distance."""
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 7, 9, 14, 21, 30])))) for i in range(60)]
    texts: list[str | None] = ["", None]
    for _, item in items * 3:
        words = item.split()
        for _ in range(rng.randrange(0, max(1, len(words) // 5) + 1)):
            k = rng.randrange(len(words))
            words[k : k + rng.randrange(2)] = rng.choices(vocabulary, k=rng.randrange(2))
            words = words or ["w0"]
        texts.append(" ".join(rng.choices(vocabulary, k=rng.randrange(9)) + words + rng.choices(vocabulary, k=rng.randrange(9))))
    number = {w: i + 1 for i, w in enumerate(vocabulary)}
    coded = lambda t: np.array([number[w] for w in (t or "").split()], dtype=np.int32)
    want = {}
    for r, text in enumerate(texts):
        for i, item in items:
            distance = decontaminate.edit_distance_within(coded(item), coded(text))[0]
            if distance <= int(decontaminate.SHARE * len(item.split())):
                want[r, i] = distance
    got = {(r, i): d for r, i, d, _ in decontaminate.Index(items).find(texts)}
    assert got.items() <= want.items() and len(got) >= 0.99 * len(want) and len(want) > 150


def test_decontamination_after_a_quote_at_the_begin():
    item = [f"w{i}" for i in range(200)]
    for quoted, between in ((10, 60), (12, 75), (30, 40)):
        text = " ".join(item[:quoted] + [f"z{i}" for i in range(between)] + item)
        assert decontaminate.Index([(7, " ".join(item))]).find([text]) == [(0, 7, 0, quoted + between + 200)]


def test_warc_round_trip(spark):
    rows = [(3, "u3", "aa"), (1, "u1", "bb"), (2, "u2", "aa"), (5, None, None), (4, "u4", ""), (7, "u7", "aa"), (7, "u7", "aa"), (None, "x", "y")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    one, two = (f"file://{tempfile.mkdtemp()}" for _ in range(2))
    assert warc.write(pages, one) == warc.write(pages.repartition(3), two)
    got = sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.read(spark, one).collect())
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    aa, none = (2, digest("aa")), (0, digest(""))
    assert got == [
        (1, "response", None, 2, digest("bb")), (2, "response", None, *aa), (3, "revisit", 2, *aa), (4, "response", None, *none), (5, "revisit", 4, *none), (7, "revisit", 2, *aa), (7, "revisit", 2, *aa),
    ]
    rolled = f"file://{tempfile.mkdtemp()}"
    assert len(warc.write(pages, rolled, roll_bytes=1)) == 7 and warc.read(spark, rolled).count() == 7
    empty = f"file://{tempfile.mkdtemp()}"
    assert warc.write(pages.limit(0), empty) == [] and warc.read(spark, empty).count() == 0


def test_warc_keeps_rows_that_share_an_id_and_outlying_ids(spark):
    rows = [(2, "", "aa"), (5, "u", "aa"), (5, "u", "zz"), (2, "u", "aa"), (9 * 10**17, "u", "aa"), (-9 * 10**17, "u", "qq")] + [(100 + i, "u", "x" * 3000 + str(i % 50)) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    root = f"file://{tempfile.mkdtemp()}"
    made = warc.write(pages, root, part_bytes=100_000)
    assert warc.write(pages.repartition(5), f"file://{tempfile.mkdtemp()}", part_bytes=100_000) == made and len(made) >= 10
    got = warc.read(spark, root).collect()
    text = {r["payload_digest"]: r["payload"] for r in got if r["record_type"] == "response"}
    assert sorted((r["page_id"], bytes(text[r["payload_digest"]]).decode()) for r in got) == sorted((i, t) for i, _, t in rows)
    assert sum(r["record_type"] == "response" for r in got) == 53
    assert sorted(str(r["refers_to"]) for r in got if r["page_id"] in (2, 5)) == ["2", "2", "None", "None"]
    assert "" in {r["url"] for r in got}


def test_html(spark):
    page = "<html><head><title>T</title><script>var a='<p>x</p>'</script></head><body><nav><ul><li><a href=/>Menu</a></ul></nav><header>Site</header><article><h1>Head &amp; more</h1><p><b>bold \n text<br>line<p>For.<aside>side</aside><div class='comments'>reader</div><form>f<input></form></article><div class=ad>buy</div><footer>&copy;</footer>"
    flat = "<div id=menu><a href=1>a</a></div><p>One long line of real text in a page without any article element.<p>Two is long as well, as such lines tend to be.<div class=notice>cookies</div>"
    texts = [page, flat, "", None, "<", "<p>a</p>" * 5000]
    df = spark.createDataFrame([(i, t, "t") for i, t in enumerate(texts)], "page_id bigint, html string, text string")
    got = [(r["text"], r["n_chars"]) for r in html_text.extract(df).orderBy("page_id").collect()]
    assert got[0][0] == "Head & more bold text line For."
    assert got[1][0].startswith("One long line") and got[1][0].endswith("tend to be.")
    assert got[2] == got[3] == ("", 0) and got[5][0] == " ".join("a" * 5000)


def test_html_keeps_paragraphs_whose_class_only_sounds_like_noise(spark):
    page = "<article><p class='related-work'>one</p><div id='search-trees'><p>two</p></div><p>three</p><div class='comment-list'>no</div><div class='cookieBanner'>no</div></article>"
    assert html_text.main_text(page) == "one two three"
    df = spark.createDataFrame([(1, "<p>a</p>", 9)], "page_id bigint, html string, N_Chars int")
    assert [r.asDict() for r in html_text.extract(df).collect()] == [{"page_id": 1, "text": "a", "n_chars": 1}] and html_text.extract(df.limit(0)).count() == 0
    assert html_text.main_text("<div>" * 20000 + "</b>" * 20000 + "x") == "x"


def test_html_after_an_unknown_marked_section():
    for section in ("<![vml]>", "<![ if IE ]>", "<![endif]>", "<![CDATA[x]]>", "<![1]>"):
        assert html_text.main_text(f"<p>one line of text</p>{section}<p>two lines of text</p>") == "one line of text two lines of text"


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 8)))]
    rows += [(400, None), (401, [1.0, None] * 4), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, [1.0, 2.0]), (405, rows[0][1]), (406, rows[0][1]), (450, [])]
    ints = topk.integers(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    got = topk.search(ints, F.pmod("vec_id", F.lit(50)) == 0).collect()
    vectors = {r["vec_id"]: np.array(r["v"], dtype=np.int64) for r in ints.collect()}
    want = []
    for q in vectors:
        if q % 50 == 0:
            near = sorted((-int(vectors[q] @ v), c) for c, v in vectors.items() if c != q and len(v) == len(vectors[q]))[:5]
            want += [(q, k, c, -s) for k, (s, c) in enumerate(near, 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_drops_no_large_vector(spark):
    rows = [(0, [1.0, 2.0]), (1, [1e9, 0.0]), (2, [float("inf"), 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="leaves the range"):
        topk.integers(vectors).collect()
    assert topk.integers(vectors.where("vec_id <> 1")).count() == 1


def test_quality(spark):
    good = ["The quick fox went home, and the long road was quiet. It had rained." + f" Word{i} more." for i in range(30)]
    bad = [f"BUY{i}!! NOW!! BUY{i}!! NOW!! $$$ ### " * 5 for i in range(30)]
    df = docs(spark, good + bad + ["", None])
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(60)] + [(None, 1), (5, None)], "doc_id bigint, quality int")
    model = quality.train(df, labels, held_out=F.col("doc_id") % 4 == 0)
    got = {r["doc_id"]: r["score"] for r in quality.score(df, model).collect()}
    assert len(got) == 62 and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= quality.CUT) == (i < 30) for i in range(60))
    assert quality.keep_good(df, model).columns == df.columns
    none = quality.train(df, labels.limit(0))
    assert [r["score"] for r in quality.score(df, none).collect()] == [pytest.approx(quality.CUT)] * 62


def test_repeats(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdeéż", k=rng.randrange(1, 9))) for _ in range(60)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passage = text(40)
    texts = [text(60) + passage + text(9), passage, None, "", "a" * 700, "ab" * 300, text(30) + passage[30:200] + text(5), passage * 3, "b" + "a" * 120, text(900)]
    got = sorted(map(tuple, repeats.digests(docs(spark, texts)).collect()))
    assert got == repeats.brute_force(list(enumerate(texts)))
    kept = repeats.without_repeats(docs(spark, texts)).collect()
    assert len(kept) == len(texts) and "�" not in "".join(r["text"] for r in kept)
    assert {r["kept"] for r in kept} == {"k"}  # a column of the documents, not of the operator
    clash = docs(spark, texts).withColumn("N_Removed", F.lit(7)).drop("kept").withColumn("Kept", F.lit("mine"))
    assert {(r["Kept"], r["N_Removed"]) for r in repeats.without_repeats(clash).collect()} == {("mine", 7)}
    assert repeats.digests(docs(spark, [])).count() == 0


def test_run_length_index():
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab", k=rng.randrange(0, 60))).encode() for _ in range(40)] + [b"", b"abab" * 30, "żółć".encode() * 9] * 2
    for length in (1, 5, 12):
        for shard in (1, 300, 10**6):
            seen, want = set(), []
            for t in texts:
                starts = []
                for i in range(len(t) - length + 1):
                    if t[i : i + length] in seen:
                        starts.append(i)
                    seen.add(t[i : i + length])
                want.append(starts)
            assert [x.tolist() for x in run_length.repeated_starts(texts, shard, length)] == want
    corpus, pattern = texts[:20], texts[20:]
    for t, got in zip(pattern, run_length.RunLengthIndex(corpus, 12).matching(pattern)):
        longest = [max(k for k in range(0, 13) if i + k <= len(t) and any(t[i : i + k] in c for c in corpus)) for i in range(len(t))]
        assert got.tolist() == longest


def _jaccard(texts):
    sets = []
    for t in texts:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).split()
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set())
    links = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] & sets[j] and 100 * len(sets[i] & sets[j]) >= 70 * len(sets[i] | sets[j])}
    lead = list(range(len(texts)))
    for _ in texts:
        for i, j in links:
            lead[i] = lead[j] = min(lead[i], lead[j])
    return [(i, len(s), sum(i in p for p in links), lead[i]) for i, s in enumerate(sets)]


def test_near_duplicates(spark):
    rng = random.Random(5)
    base = [rng.choices([f"w{i}" for i in range(400)], k=n) for n in (40, 80, 15)]
    texts = [None, "", "  \n", "one", "ONE", "one two", "one two"]
    for words in base:
        for _ in range(14):
            copy = list(words)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(99)}"
            texts.append(" ".join(copy))
        texts += [" ".join(words)] * 3
    got = near_duplicates.similar(docs(spark, texts)).select("doc_id", "n_shingles", "n_similar", "component_id").collect()
    assert sorted(map(tuple, got)) == _jaccard(texts)
    assert near_duplicates.similar(docs(spark, [])).count() == 0


@pytest.mark.parametrize("hot, side, n, length, edits", [(256, 512, 500, 70, 6), (3, 5, 70, 45, 6), (6, 9, 60, 30, 5)])
def test_near_duplicates_in_a_large_cluster(spark, monkeypatch, hot, side, n, length, edits):
    """Copies of one text, few of them equal: no rows for pairs of them, and the links of all."""
    monkeypatch.setattr(near_duplicates, "HOT", hot)
    monkeypatch.setattr(near_duplicates, "SIDE", side)
    monkeypatch.setattr(near_duplicates, "CELL", side)
    rows, stored = {}, near_duplicates.stored

    def counted(df, label):
        rows[label] = (out := stored(df, label)).count()
        return out

    monkeypatch.setattr(near_duplicates, "stored", counted)
    rng = random.Random(n)
    words = rng.choices([f"w{i}" for i in range(900)], k=length)
    texts = [" ".join(rng.choices(words, k=length)) for _ in range(9)]
    for i in range(n):
        copy = list(words)
        for _ in range(rng.randrange(0, edits)):
            copy[rng.randrange(length)] = f"x{rng.randrange(60)}"
        if i % 10 == 0:
            copy = copy[rng.randrange(0, 4) :]
        texts.append(" ".join(copy))
    got = near_duplicates.similar(docs(spark, texts)).select("doc_id", "n_shingles", "n_similar", "component_id").collect()
    assert sorted(map(tuple, got)) == _jaccard(texts)
    assert rows["near-stars"] > 10 and (hot < 256 or rows["near-pairs"] + rows["near-links"] < 20 * n)


def test_near_duplicates_compare_a_star_in_many_tasks(spark, monkeypatch):
    """Cells of close copies are left out, and the others do not share the task that reads the small table."""
    monkeypatch.setattr(near_duplicates, "SIDE", 10)
    n = 100
    rows = [(7, i, i, 1, abs(k), k, list(range(i % 5 + 4)), k < 5) for i, k in enumerate(range(-80, n - 80))]
    stars = spark.createDataFrame(rows, "center bigint, group_id bigint, x bigint, class_size bigint, d bigint, k bigint, delta array<bigint>, inside boolean").coalesce(1)
    met = near_duplicates._compared(stars, stars, 70, True)
    want = {(a[2], b[2]) for a in rows for b in rows if a[2] != b[2] and 0 < a[5] + b[5] <= 340 * min(a[4], b[4], len(a[6]), len(b[6]))}
    assert {(r["x"], r["y"]) for r in met.collect()} == want and met.rdd.getNumPartitions() >= 32
    both = {(r["x"], r["y"]) for r in near_duplicates._compared(stars.where("not inside"), stars, 70, False).collect()}
    assert both == {(a[2], b[2]) for a in rows if not a[7] for b in rows if a[2] != b[2] and a[5] + b[5] <= 340 * min(a[4], b[4], len(a[6]), len(b[6]))}


def test_near_duplicates_far_from_the_center_of_a_large_cluster(spark, monkeypatch):
    """Copies that are linked with each other and not with the center make no rows for pairs either."""
    monkeypatch.setattr(near_duplicates, "HOT", 8)
    monkeypatch.setattr(near_duplicates, "SIDE", 16)
    rows, stored = {}, near_duplicates.stored

    def counted(df, label):
        rows[label] = (out := stored(df, label)).count()
        return out

    monkeypatch.setattr(near_duplicates, "stored", counted)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(90)]
    far = words[:58] + [f"y{i}" for i in range(32)]
    texts = [" ".join(words)]
    for base, n in ((words, 60), (far, 60)):
        for i in range(n):
            copy = list(base)
            for _ in range(rng.randrange(1, 5)):
                copy[rng.randrange(90)] = f"x{rng.randrange(60)}"
            texts.append(" ".join(copy))
    # farther ones: some with a link or two, some with none
    for i in range(24):
        texts.append(" ".join(w if k % 24 != i and k % 11 != i % 11 else f"z{i}" for k, w in enumerate(far if i % 2 else words)))
    rng.shuffle(texts)
    want = _jaccard(texts)
    assert 2 < len({x[3] for x in want}) < 40
    kept = near_duplicates.keep_one(docs(spark, texts)).collect()
    assert sorted(r["doc_id"] for r in kept) == [x[0] for x in want if x[0] == x[3]]
    assert rows["near-pairs"] < 900, rows
    got = near_duplicates.similar(docs(spark, texts)).select("doc_id", "n_shingles", "n_similar", "component_id").collect()
    assert sorted(map(tuple, got)) == want


def test_near_duplicates_with_repeated_ids_in_a_large_cluster(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(60):
        copy = list(words)
        for _ in range(rng.randrange(0, 5)):
            copy[rng.randrange(50)] = f"x{rng.randrange(60)}"
        rows.append((i % 50, " ".join(copy)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    plain = sorted(map(tuple, near_duplicates.similar(frame).collect()))
    monkeypatch.setattr(near_duplicates, "HOT", 4)
    assert sorted(map(tuple, near_duplicates.similar(frame).collect())) == plain


def test_language_model(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["alpha", "beta", "Gamma", "delta,", "eps"], weights=[9, 5, 3, 2, 1], k=rng.randrange(1, 90))) for _ in range(80)] + ["", None, "Xyzzy " * 3]
    held_out = F.pmod("doc_id", F.lit(5)) == 0
    got = {r["doc_id"]: r for r in attention_lm.score(docs(spark, texts), held_out, PATH, public_tokenizers.PATTERN).collect()}
    counts: dict[str, int] = {}
    rows = [(t or "").lower().split() + ["\n"] for t in texts]
    for i, r in enumerate(rows):
        for w in r if i % 5 else []:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, r in enumerate(rows):
        base = sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in r)
        assert got[i]["base_score"] == pytest.approx(base) and got[i]["n_tokens"] == len(r) and got[i]["train_tokens"] == n
        assert got[i]["n_known"] == sum(w in counts for w in r) and got[i]["score"] < 0
    few = attention_lm.windows(np.array([0, 5]), np.array([5, 100]))
    seen = [(o, b + k) for o, b, s, f in zip(*few) for k in range(f, s)]
    assert len(seen) == len(set(seen)) == 105


def test_language_model_trains_on_every_id(spark):
    n = np.ones(3000)
    row = attention_lm._rows(n)
    table = np.zeros((attention_lm.ROWS, attention_lm.ROWS))
    lengths = np.array([2, 3, 5, 24, 25, 26, 100, 3000, 2])
    starts = np.concatenate([[0], np.cumsum(lengths)])
    ids = np.random.default_rng(1).integers(0, 199, starts[-1]).astype(np.int32)
    trainer = attention_lm.Trainer(attention_lm.assemble(n, row, table))
    trainer.texts(iter([(ids[: starts[4]], starts[:5]), (ids[starts[4] :], starts[4:] - starts[4])]))
    assert trainer.tokens == (lengths - 1).sum()
    outs = []
    for doc_id in (1, 16):  # a text counts whatever its id
        coded = attention_lm.encoded(attention_lm.lowered(docs(spark, ["alpha beta gamma alpha"], doc_id), F.lit(False)), PATH, public_tokenizers.PATTERN)
        outs.append(attention_lm.train(coded, PATH).out)
    assert (outs[0] == outs[1]).all()


def _random_model(seed=3):
    rng = np.random.default_rng(seed)
    n = rng.integers(0, 50, 3000).astype(float)
    row = attention_lm._rows(n)
    table = rng.poisson(0.05, (attention_lm.ROWS, attention_lm.ROWS)).astype(float)
    table[:, np.setdiff1d(np.arange(attention_lm.ROWS), row)] = 0  # no id has these rows
    w = attention_lm.assemble(n, row, table)
    w.out = rng.normal(0, 0.5, w.out.shape).astype(np.float32)
    return w, rng


def test_language_model_scores_as_one_id_at_a_time():
    w, rng = _random_model()
    ids = rng.integers(0, 3000, 130).astype(np.int32)
    starts = np.array([0, 2, 20, 45, 130])
    got = attention_lm.log_probabilities(w, ids, starts)
    q, k, v = (w.embedding @ t for t in (w.query, w.key, w.value))
    step = attention_lm.WINDOW - attention_lm.CONTEXT
    for r, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
        row, total = ids[a:b], 0.0
        for t in range(1, len(row)):
            window = 0 if t - 1 < attention_lm.WINDOW else (t - 1 - attention_lm.CONTEXT) // step
            seen = [w.row[i] for i in row[window * step : t]]
            s = np.array([np.exp(q[seen[-1]] @ k[j] / 4 + w.bias[len(seen) - 1 - at]) for at, j in enumerate(seen)])
            p = np.exp((s / s.sum()) @ v[seen] @ w.out) * w.bigram[seen[-1]]
            total += np.log(p[w.group[row[t]]] / p.sum()) + w.follow[seen[-1], w.row[row[t]]] + w.inner[row[t]]
        assert got[r] == pytest.approx(total, rel=1e-4)


def test_language_model_is_a_distribution():
    w, _ = _random_model()
    sums = np.zeros(len(w.row))
    for last in (0, 7, 2000):
        ids = np.array([[last, i] for i in range(3000)], dtype=np.int32).ravel()
        sums = np.exp(attention_lm.log_probabilities(w, ids, np.arange(0, 6001, 2))).sum()
        assert sums == pytest.approx(1.0, rel=1e-3)


def test_language_model_gradient():
    w, rng = _random_model()
    rows, groups = (rng.integers(0, m, (3, attention_lm.WINDOW)).astype(np.int32) for m in (attention_lm.ROWS, attention_lm.CLASSES))
    size = np.array([24, 24, 9])
    for name in attention_lm.Weights.NAMES:
        seen = []

        def loss(shift, at):
            tried = attention_lm.Trainer(attention_lm.Weights(**{k: np.copy(getattr(w, k)) for k in w.__dataclass_fields__ if k != "tables"}))
            getattr(tried.w, name).ravel()[at] += shift
            value = tried.step(rows, size, groups)
            seen.append(np.sign(tried.first[attention_lm.Weights.NAMES.index(name)].ravel()[at]))
            return value, tried.first[attention_lm.Weights.NAMES.index(name)].ravel()[at] * 10

        for at in (0, 5):
            (up, _), (down, _), (_, g) = loss(1e-2, at), loss(-1e-2, at), loss(0.0, at)
            assert g == pytest.approx((up - down) / 2e-2, rel=0.05, abs=2e-4)


def test_language_model_keeps_every_row(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (None, "a b"), (None, "a b"), (None, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = attention_lm.score(df, F.col("doc_id") == 2, PATH, public_tokenizers.PATTERN).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 1), (0, 3), (0, 3), (1, 2), (1, 3), (1, 3), (2, 1)]
    assert len({r["score"] for r in got if r["n_tokens"] == 3}) == 1 and {r["held_out"] for r in got if r["doc_id"] == 2} == {True}
    assert attention_lm.score(df.limit(0), F.col("doc_id") == 2, PATH, public_tokenizers.PATTERN).count() == 0


def test_preferences(spark):
    rows = [
        (1, "chosen", 0, "user", "q"), (1, "chosen", 1, "assistant", "good"), (1, "rejected", 0, "user", "q"), (1, "rejected", 1, "assistant", "bad one"),
        (2, "chosen", 0, "user", "only"), (3, "chosen", 0, "user", None), (3, "rejected", 0, "user", None), (None, "chosen", 0, "user", "x"), (4, "other", 0, "user", "x"),
    ]
    got = {r["pair_id"]: r for r in preferences.format_pairs(spark.createDataFrame(rows, "pair_id bigint, side string, turn bigint, role string, text string")).collect()}
    assert sorted(got) == [1, 2, 3]
    one = got[1]
    assert one["n_prompt_turns"] == 1 and one["prompt"] == "<|im_start|>user\nq<|im_end|>\n"
    spans = [one["rejected"][s["start"] : s["stop"]] for s in one["rejected_mask"]]
    assert spans == ["bad one<|im_end|>"] and one["chosen"].count("good") == 1
    assert got[2]["n_prompt_turns"] == 0 and got[2]["prompt"] == "" and got[2]["rejected"] == "" and got[3]["chosen"] == "" and got[3]["n_prompt_turns"] == 1
