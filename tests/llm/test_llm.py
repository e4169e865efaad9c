"""The pipeline operators against brute force, and on null, empty, repeated and clashing input."""

import base64
import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomspark.llm import byte_bpe, exact_dedup, html_text, langid, mixing, ngram_join, nn_descent, suffix_dedup, token_store, toxicity
from loomspark.llm.suffix_array import permuted_lcp, suffix_array

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, digest string, size long, id long, h long, root long"
EXTRA = ("x", 1, 2, 3, 4)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def corpus(n=60, seed=1):
    """Random texts, with near copies, exact copies, nulls, empty texts, repeated rows and null ids."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(rng.randint(1, 120))]
        rows.append((i, " ".join(words), rng.choice(["en", "de", None]), rng.choice(["a", "b", None])))
        for k in range(rng.randint(0, 3)):
            near = list(words)
            near[rng.randrange(len(near))] = "changed" + str(k)
            rows.append((1000 + 10 * i + k, " ".join(near), "en", "a"))
    rows += [(2000, rows[0][1], "en", "a"), (2001, rows[0][1], "en", "b"), (2002, None, "en", "a"), (2003, "", "en", None), (2004, "", None, None), rows[3], rows[3], (None, rows[5][1], "en", "a"), (None, "lonely text", None, None)]
    return [(*r, None, *EXTRA) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def texts(rows):
    return [(r[0], r[1] or "") for r in rows]


def test_exact_dedup(docs, none):
    groups = {}
    for i, t in texts(corpus()):
        groups.setdefault(t, []).append(i)
    for support in (1e-3, 0.03):
        got = exact_dedup.exact_dedup(docs, support=support).collect()
        assert len(got) == len(corpus())
        by = {hashlib.sha256(t.encode()).digest(): v for t, v in groups.items()}
        for r in got:
            ids = by[bytes(r["digest"])]
            assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
        assert sum(r["kept"] for r in got) == len(groups)
        kept = exact_dedup.drop_copies(docs, support=support)
        assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


def test_mixing(docs, none):
    got = mixing.mix_sizes(docs).collect()
    assert len(got) == len(corpus()) and mixing.mix_sizes(none).count() == 0 and mixing.mix(none).count() == 0
    total = sum(r["size"] for r in got)
    targets = {(r["source_size"], r["target"]) for r in got}
    assert abs(sum(t for _, t in targets) - 1.5 * total) < 1e-6
    for size, target in targets:
        assert target <= 2 * size + 1e-9
        taken = sum(r["size"] * r["copies"] for r in got if r["source_size"] == size)
        assert abs(taken - target) <= max(r["size"] for r in got if r["source_size"] == size)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)


def brute_components(rows, n, percent):
    sets = []
    for i, t in rows:
        w = t.encode().lower().split()
        sets.append((i, frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    comp = {}
    for k, (i, s) in enumerate(sets):
        comp.setdefault(find(k), []).append(i)
    return sorted(str((i, len(s), min((j for j in comp[find(k)] if j is not None), default=None) if s else i)) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_ngram_join(docs, none, n, percent):
    got = ngram_join.ngram_components(docs, n=n, percent=percent).collect()
    assert sorted(str((r["id"], r["n_shingles"], r["component_id"])) for r in got) == brute_components(texts(corpus()), n, percent)
    assert ngram_join.ngram_components(none).count() == 0
    assert ngram_join.one_of_each(docs, n=n, percent=percent).columns == docs.columns


def brute_kept(rows, n, percent):
    """(id, text) of the rows that stay: of each component the rows like its first one, one if it has no id."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    left, kept = set(range(len(rows))), []
    while left:
        group = todo = {left.pop()}
        while todo:
            todo = {b for b in left if any(sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) for a in todo)}
            left, group = left - todo, group | todo
        kept.append([rows[k] for k in group])
    return kept


def test_one_of_each(spark, docs, none):
    near = [" ".join(f"{w}{k}" for k in range(30)) for w in ("p", "q", "r", "s", "t")]
    clash = [(None, near[0] + " x"), (7001, near[0]), (None, "alone one"), (None, "alone two"), (None, None), (None, ""), (None, " \t"), (None, " \t")]
    clash += [(7002, near[1]), (7003, near[1] + " x"), (7003, "nothing like it"), (7003, near[2] + " x"), (7004, near[2])]
    clash += [(None, near[3]), (None, near[3]), (None, near[3] + " x"), (7005, near[4]), (7005, near[4] + " x"), (7005, near[4] + " y"), (7006, near[4]), (7007, "twice"), (7007, "twice")]
    rows = [(r[0], r[1]) for r in corpus()] + clash
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _goneid int").repartition(3)
    got = ngram_join.one_of_each(df, n=5, percent=80)
    assert got.columns == df.columns
    got = got.collect()
    places = [r["_goneid"] for r in got]
    assert len(set(places)) == len(places) and all((r["doc_id"], r["text"]) == rows[r["_goneid"]] for r in got)
    left = sorted(str((r["doc_id"], r["text"])) for r in got)
    for group in brute_kept(rows, 5, 80):
        first = min((i for i, _ in group if i is not None), default=None)
        stay = [g for g in group if str(g) in left]
        assert stay and len(set(stay)) == 1 and stay[0][0] == first
        many = group.count(stay[0]) if first is not None or not (stay[0][1] or "").split() else 1
        for g in stay[:many]:
            left.remove(str(g))
    assert not left
    assert ngram_join.one_of_each(none).count() == 0


def test_long_posting_lists_meet_in_blocks(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "MEET", 2)
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)
    got = ngram_join.ngram_components(docs, n=4, percent=85).collect()
    assert sorted(str((r["id"], r["n_shingles"], r["component_id"])) for r in got) == brute_components(texts(corpus()), 4, 85)


def brute_cut(rows):
    first = {}
    for i, t in rows:
        raw, o = t.encode(), -(2**63) if i is None else i
        for k in range(len(raw) - 99):
            w = raw[k : k + 100]
            first[w] = min(first.get(w, (o, k)), (o, k))
    out = []
    for i, t in rows:
        raw, o = t.encode(), -(2**63) if i is None else i
        mask = bytearray(len(raw))
        for k in range(len(raw) - 99):
            if first[raw[k : k + 100]] < (o, k):
                mask[k : k + 100] = b"\1" * 100
        out.append((str(i), bytes(c for c, m in zip(raw, mask, strict=True) if not m)))
    return sorted(out)


@pytest.mark.parametrize("crowd", [2048, 1])
def test_suffix_dedup(docs, none, crowd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    got = suffix_dedup.remove_repeats(docs).collect()
    assert sorted((str(r["id"]), bytes(r["kept"])) for r in got) == brute_cut(texts(corpus()))
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_runs_of_one_character(spark):
    rows = [(1, "a" * 350), (2, "b" + "a" * 120), (3, "ab" * 90)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["id"]), bytes(r["kept"])) for r in got) == brute_cut(rows)


def test_anchors_are_shuffled_in_parts(spark, monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(3000)]
    passages = [" ".join(rng.choices(words, k=60)) for _ in range(30)]
    rows = [(k, " ".join([*rng.choices(words, k=20), rng.choice(passages), *rng.choices(words, k=20)])) for k in range(200)]
    saved, save = [], suffix_dedup.Scratch.save

    def noted(self, df, name):
        out = save(self, df, name)
        if name == "places":
            saved.append({r["h"]: r["count"] for r in out.groupBy("h").count().collect()})
        return out

    monkeypatch.setattr(suffix_dedup.Scratch, "save", noted)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["id"]), bytes(r["kept"])) for r in got) == brute_cut(rows)
    sizes = [sum(x.values()) for x in saved]
    assert sum(map(len, saved)) == len(set().union(*saved)) and max(sizes) < 0.7 * sum(sizes)


def test_suffix_arrays_of_many_symbols():
    rng = random.Random(4)
    for _ in range(100):
        t = np.array([rng.randint(1, rng.choice([1, 2, 5000])) for _ in range(rng.randint(1, 90))] + [0])
        assert suffix_array(t, 5001).tolist() == sorted(range(len(t)), key=lambda i: tuple(t[i:]))  # noqa: B023
    assert suffix_array(np.array([3] * 20000 + [0]), 5001).tolist() == list(range(20000, -1, -1))


def test_suffix_array():
    rng = random.Random(2)
    for _ in range(150):
        t = np.array([rng.randint(1, rng.choice([2, 200])) for _ in range(rng.randint(1, 60))] + [0])
        sa = suffix_array(t, 201)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: tuple(t[i:]))  # noqa: B023
        lcp = permuted_lcp(t, sa)
        for a, b in zip(sa[:-1], sa[1:], strict=True):
            k = 0
            while t[a + k] == t[b + k]:
                k += 1
            assert lcp[b] == k


def test_byte_bpe(docs, none):
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = byte_bpe.ByteBPE(path, public_tokenizers.PATTERN)
    rng = random.Random(5)
    odd = ["", " ", "a  b", "x\n \ny", "é" * 3000, "ab" * 2500, "<|endoftext|>", "日本 語"] + ["".join(rng.choice(" \n\tab'1é. 日") for _ in range(50)) for _ in range(300)]
    ids = bpe.encode(odd)
    assert [x.tolist() for x in ids] == [library.encode_ordinary(t) for t in odd]
    assert [bpe.decode(x) for x in ids] == [t.encode() for t in odd]
    got = byte_bpe.encode_decode(docs, path, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r["decoded"]).decode() for r in got) == sorted(t for _, t in texts(corpus()))
    assert byte_bpe.encode(none, path, public_tokenizers.PATTERN).count() == 0


def odd_spaces():
    """Texts with white space of every kind, alone, in runs, and balancing surplus spaces."""
    rng = random.Random(11)
    made = ["".join(rng.choice("ab1'é  \n\t\r\x0b\x0c\x1c\x85\u00a0\u2003\u2028\u3000") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    return ["a\u00a0b\u00a0d \u00a0 \u00a0 \u00a0c", "a\tb  c", "a\rb  c", "a\x0bb  c", *made]


def test_units_are_cut_at_single_spaces_only():
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.ByteBPE(path, public_tokenizers.PATTERN).encode(odd_spaces())
    assert [x.tolist() for x in got] == [library.encode_ordinary(t) for t in odd_spaces()]
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = tokenizers.Tokenizer.from_file(path), token_store.Encoder(path)
    for t in odd_spaces()[:4]:
        assert own([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_units_meet_at_line_ends():
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = tokenizers.Tokenizer.from_file(path), token_store.Encoder(path)
    odd = ["foo", "\u00a0\u00a0bar", "bar\u00a0", "", " ", " x", "  x", "\u2003", "\r", "x\r", "\tx", "x \u00a0 y", *odd_spaces()]
    assert [x.tolist() for x in own(odd)] == [library.encode(t, add_special_tokens=False).ids for t in odd]
    units = ["", "foo", "\u00a0\u00a0bar", " ", " x", " \u00a0", "y"]
    assert own._many(units) == own._ids(units)


def test_words_are_encoded_apart_from_marks_and_line_ends(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = tokenizers.Tokenizer.from_file(path), token_store.Encoder(path)
    given, many = [], own._many
    monkeypatch.setattr(own, "_many", lambda units: given.extend(units) or many(units))
    plain = "foo bar, bar. bar; bar!? foo.\nbar bar\nfoo, bar bar"
    assert own([plain])[0].tolist() == library.encode(plain, add_special_tokens=False).ids
    assert sorted(given) == sorted([" bar", " foo", "foo", "bar", ",", ".", ";", "!?", "\n"])
    rng = random.Random(9)
    odd = ["".join(rng.choice(["a", "É", "ſ", "×", "中", "e\u0301", "7", "²", "ª", "'s", ".", ",", "!?", "'", "-", "\n", " ", "\u00a0", "\x1c", "\r", "<|endoftext|>"]) for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    odd += ["", ".", "\n", " \n", "\n a", "a\n", "a.\n\nb", "a .\nb", "we'll.", "x\n.y", "\nfoo bar"]
    assert [x.tolist() for x in own(odd)] == [library.encode(t, add_special_tokens=False).ids for t in odd]


def test_units_of_many_texts_are_encoded_once_without_separators(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = tokenizers.Tokenizer.from_file(path), token_store.Encoder(path)
    given = []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            out = library.encode_batch_fast(texts, **options)
            given.extend(k for e in out for k in e.ids)
            return out

    monkeypatch.setattr(own, "tokenizer", Counted())
    words = [" " + "".join(w) for w in itertools.product("qxzjkv", repeat=3)]
    for _ in range(2):
        ids = own(["a" + "".join(words), "a" + "".join(reversed(words)) + "."])
        assert [x.tolist() for x in ids] == [library.encode(t, add_special_tokens=False).ids for t in ("a" + "".join(words), "a" + "".join(reversed(words)) + ".")]
    assert sorted(given) == sorted(k for t in ["a\n.", *words] for k in library.encode(t, add_special_tokens=False).ids)
    rng = random.Random(8)
    odd = ["".join(rng.choice(["a", "Ġ", "ſ", "中", "7", "'s", ".", "!?", "\0", "\n", "\n\n", " ", "  ", "\u00a0", "\x1c", "\x85", "\u180e", "\u200b", "\t", "<|endoftext|>"]) for _ in range(rng.randint(0, 12))) for _ in range(6000)]
    odd += ["\0", "\n", "\n.", "\n\n\n", " .", ". ", "a\n", "\na.", "a \n", "\n a!", "\0 a\0"]
    every = "".join(map(chr, range(0xD800)))  # leaves no sign to cut at
    for some in (odd, [every, "a b"], ["", ""], []):
        assert [x.tolist() for x in own(some)] == [library.encode(t, add_special_tokens=False).ids for t in some]


def test_token_shards(spark, docs, none):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    manifest, folder = token_store.tokenize_to_shards(docs, path)
    got = sorted(token_store.read_shards(spark, manifest).collect(), key=lambda r: r["start"])
    want = sorted((i is not None, i or 0, [*library.encode(t, add_special_tokens=False).ids, 2]) for i, t in texts(corpus()))
    assert sorted((r["id"] is not None, r["id"] or 0, r["ids"]) for r in got) == want
    assert [r["id"] for r in got] == sorted((r["id"] for r in got), key=lambda i: (i is not None, i or 0))
    start = 0
    for r in got:
        assert r["start"] == start and r["crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += len(r["ids"])
    row = manifest.orderBy("shard").first()
    fs, at = token_store._open(row["uri"])
    with fs.open_input_file(at) as f:
        reader = token_store.Reader(f)
        keys = [k for k, _, _ in reader.scan()]
        assert all(reader.get(k) for k in keys) and not reader.get(token_store.key_of(10**9))
    empty, _ = token_store.tokenize_to_shards(none, path)
    assert token_store.read_shards(spark, empty).count() == 0


def test_language(spark, none):
    texts_ = {"en": "the house is with this and the other thing", "de": "das Haus ist über die Straße und größer", "fr": "la maison est très élégante où ça", "es": "la casa está aquí mañana señor"}
    rows = [(k, " ".join(random.Random(k).sample(t.split(), 5)), lang, *[None] * 7) for k, (lang, t) in enumerate(list(texts_.items()) * 30)] + [(900, None, "en", *[None] * 7), (901, "12 34 !", None, *[None] * 7)]
    df = spark.createDataFrame(rows, COLUMNS)
    model = langid.train(df, F.col("id") % 5 != 2)
    got = {r["id"]: r for r in langid.predict(df, model).collect()}
    assert all(got[r[0]]["lang_pred"] == r[2] for r in rows[:-2]) and got[900]["lang_pred"] == got[901]["lang_pred"] == "und"
    assert langid.with_language(df, model, 0.5).count() == len(rows) - 2
    assert langid.with_language(df, langid.train(none, F.lit(True)), 0.5).count() == len(rows) - 2
    assert langid.predict(df, langid.train(none, F.lit(True))).where("lang_pred <> 'und'").count() == 0


def test_toxicity(spark, none):
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choices(WORDS, k=30) + (["rotten", "vile"] if k % 4 == 0 else [])), *[None] * 8) for k in range(400)]
    df = spark.createDataFrame([*rows, (None, "", *[None] * 8)], COLUMNS)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    got = {r["id"]: r["score"] for r in toxicity.score(df, toxicity.train(df, labels, F.col("id") % 5 != 0)).collect()}
    assert all((got[k] >= 0.5) == (k % 4 == 0) for k in range(400))
    assert toxicity.score(none, None).count() == 0
    assert toxicity.train(df, labels.where("toxic = 0"), F.lit(True)) is None


def test_html():
    page = "<title>no</title><style>.x{display:none}</style><p>One <b>two</b>&amp;three<p>P<br>q<ul><li>a<ol start=3><li>x</ol><li>b</ul><div class=x>no</div><table><tr><th>Name<th>V<tr><td>ab<td>1</table><p hidden>no</p><script>no</script>end"
    assert html_text.render(page) == "One two&three\n\nP\nq\n\n- a\n  3. x\n- b\n\nName | V\nab   | 1\n\nend"
    assert html_text.render(None) == html_text.render("") == ""
    assert html_text.render("a < b & c") == "a < b & c"
    assert html_text.render("<div>" * 20000 + "deep") == "deep"
    assert html_text.render('<a title="x>y">l</a><p id=\'z') == "l"


def test_nn_descent(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    vectors = [base[k % 40] + (0.02 * rng.standard_normal(16) if k >= 40 else 0) for k in range(160)]
    rows = [(k, [float(x) for x in v], k) for k, v in enumerate(vectors)] + [(200, [float(x) for x in vectors[0]], 0), (201, None, 0), (202, [0.0] * 16, 0), (203, [float("nan")] * 16, 0), (204, [1.0, 2.0], 0), (205, [None] * 16, 0), (None, [float(x) for x in vectors[1]], 0)]
    got, recall = nn_descent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = {r["id"]: r for r in got.collect()}
    good = [(i, np.asarray(v, np.float32).astype(float)) for i, v, _ in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)]
    x = np.array([v / np.linalg.norm(v) for _, v in good])
    links = (x @ x.T >= 0.95).sum(1) - 1
    assert recall >= 0.99 and [got[i]["n_links"] for i, _ in good] == links.tolist()
    assert all(got[i]["component_id"] == i % 40 for i in range(160)) and got[200]["component_id"] == 0
    assert [got[i]["n_links"] for i in (201, 202, 203, 204, 205)] == [0] * 5
    empty, recall = nn_descent.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert empty.count() == 0 and recall is None
    lone, recall = nn_descent.near_duplicates(spark.createDataFrame([(k, [float(k == j) for j in range(8)]) for k in range(8)], "vec_id long, embedding array<float>"))
    assert recall is None and all(r["n_links"] == 0 for r in lone.collect())


def test_html_keeps_what_a_screen_shows():
    r = html_text.render
    css = "@charset 'x';@media print{.x, nav{display:none}}@media (max-width:600px){.y{display:none}}@media screen and (min-width:40em){.z{display:none}}@font-face{src:url(a)}"
    assert r(f"<style>{css}</style><nav>a</nav><p class=x>b<p class=y>c<p class=z>no") == "a\n\nb\n\nc"
    assert r("<style media=print>p{display:none}</style><p>a") == r("<noscript><style>p{display:none}</style></noscript><p>a") == "a"
    assert r("<style>.x{display:none}p{display:none}.x{display:block}</style><p class=x>a<p>no") == "a"
    assert r("<style>p{display:none!important}#i{display:block}nav.open{display:block}nav{display:none}</style><p id=i>no</p><nav class=open>a</nav><nav>no</nav>") == "a"
    assert r("<p>a<style>p{display:block}</style><style>@supports (display:grid){p{display:none}}</style>") == ""
    assert r("x <math><mi>E</mi><mo>=</mo><mi>m</mi><semantics><annotation>no</annotation></semantics></math> y") == "x E=m y"
    assert r("<svg><title>no</title><defs/><text>a</text><g><path/><text>b &lt; c</text></g></svg>d") == "a\nb < c\nd"
    assert r("<textarea>\na &amp; b\n c</textarea>") == "a & b\n c"
    assert r("<p>in <select><option>a<option selected>b<option>c</select> now") == "in b now"
    assert r("<select multiple><option>a<option>b</select><select><option disabled>no<option>c</select>") == "a\nb\nc"


def isolated_pairs():
    """Vectors without structure, with a dense group and pairs of a cosine of 0.965 that nothing leads to."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((300, 64))
    side -= (side * x[:300]).sum(1, keepdims=True) * x[:300]
    x[300:600] = 0.965 * x[:300] + (1 - 0.965**2) ** 0.5 * side / np.linalg.norm(side, axis=1, keepdims=True)
    x[600:900] = x[600] + 0.01 * rng.standard_normal((300, 64))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_nn_descent_finds_isolated_pairs(spark, monkeypatch):
    x = isolated_pairs()
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    # as on inputs so large that lists don't lead to the pairs and a blocking misses many
    monkeypatch.setattr(nn_descent, "BLOCKINGS", 1)
    monkeypatch.setattr(nn_descent._Graph, "descend", lambda g: None)
    got, recall = nn_descent.near_duplicates(df)
    got = {r["id"]: r["n_links"] for r in got.collect()}
    want = (x @ x.T >= 0.95).sum(1) - 1
    assert want[:600].max() == 1 and want[600:900].min() == 299
    assert recall >= 0.99 and np.mean([got[k] == want[k] for k in range(600)]) >= 0.98


def test_nn_descent_says_when_it_fails(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "PATIENCE", 1)
    monkeypatch.setattr(nn_descent._Graph, "link", lambda g: setattr(g, "links", g.edges.select(F.col("u").alias("a"), F.col("v").alias("b")).limit(0)))
    df = spark.createDataFrame([(k, [1.0, 0.001 * k]) for k in range(50)], "vec_id long, embedding array<double>")
    with pytest.raises(RuntimeError, match="recall"):
        nn_descent.near_duplicates(df)


def test_pipeline(spark, tmp_path):
    rows = [(r[0], r[1], r[2], r[3], len(r[1] or "")) for r in corpus(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.where("not decoded_ok").count() == 0
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert got.count() == docs.count()
